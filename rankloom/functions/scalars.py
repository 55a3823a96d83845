"""Date, number and rounding functions, and one-byte floats, as Column expressions."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Resolution -> (format of the sortable string, unit of truncation); fixed formats.
RESOLUTIONS = {"year": ("yyyy", "year"), "month": ("yyyyMM", "month"), "day": ("yyyyMMdd", "day"), "hour": ("yyyyMMddHH", "hour"), "minute": ("yyyyMMddHHmm", "minute"),
               "second": ("yyyyMMddHHmmss", "second"), "millisecond": ("yyyyMMddHHmmssSSS", "millisecond")}


def date_to_string(ts: Column, resolution: str = "millisecond") -> Column:
    return F.date_format(ts, RESOLUTIONS[resolution][0])


def string_to_date(text: Column) -> Column:
    """Any of the sortable formats, told apart by length."""
    full = F.concat(text, F.substring(F.lit("00000101000000000"), F.length(text) + 1, F.lit(17)))
    return F.to_timestamp(F.regexp_replace(full, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)(\d{3})$", "$1-$2-$3 $4:$5:$6.$7"))


def round_date(ts: Column, resolution: str) -> Column:
    return F.date_trunc(RESOLUTIONS[resolution][1], ts)


def long_to_sortable(value: Column) -> Column:
    """A sign mark and 13 digits in base 36, in the order of the numbers."""
    shifted = F.when(value < 0, value.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).otherwise(value.cast("decimal(20,0)"))
    return F.concat(F.when(value < 0, "-").otherwise("0"), F.lpad(F.lower(F.conv(shifted.cast("string"), 10, 36)), 13, "0"))


def sortable_to_long(text: Column) -> Column:
    digits = F.conv(F.substring(text, 2, 13), 36, 10).cast("decimal(20,0)")
    return F.when(text.startswith("-"), digits - F.lit("9223372036854775808").cast("decimal(20,0)")).otherwise(digits).cast("long")


def round_to(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


def byte_float(code: int, mantissa: int = 3, zero: int = 15) -> float:
    """The value of a one-byte float with ``mantissa`` bits and exponent point ``zero``."""
    if code == 0:
        return 0.0
    return struct.unpack(">f", struct.pack(">I", (code << (24 - mantissa)) + ((63 - zero) << 24)))[0]


def float_to_byte(value: Column, mantissa: int = 3, zero: int = 15) -> Column:
    """The largest code whose value is not above ``value`` (at least 1 for positive values): a search in the 256 values."""
    values = [byte_float(code, mantissa, zero) for code in range(256)]
    fits = F.size(F.filter(F.array(*map(F.lit, values)), lambda v: v <= value)) - 1
    return F.when(value <= 0, F.lit(0)).otherwise(F.greatest(fits, F.lit(1)))


def byte_to_float(code: Column, mantissa: int = 3, zero: int = 15) -> Column:
    return F.element_at(F.array(*(F.lit(byte_float(c, mantissa, zero)) for c in range(256))), code + 1)


def quantized_length(dl: Column) -> Column:
    """A document's length as the one-byte norm 1 / sqrt(length) gives it back."""
    norm = byte_to_float(float_to_byte(1 / F.sqrt(dl.cast("double"))))
    return 1 / (norm * norm)


def strip_html(html: Column) -> Column:
    """Text of a web page: no scripts, styles, comments and tags; common entities decoded; blanks folded."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, plain in {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}.items():
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(text, r"\s+", " "))
