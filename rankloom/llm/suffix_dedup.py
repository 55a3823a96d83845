"""Suffix-array dedup: removes every byte that a repeated string of ``SPAN`` bytes covers.

A corpus doesn't fit one suffix array, so its strings of ``SPAN`` bytes are first dealt to groups that can
be sorted on their own.  Every such string has one anchor: of the ``ANCHOR``-byte strings in it, the first
with the smallest hash.  Equal strings have equal anchors, at the same place.  Neighbouring strings with
the same anchor form one segment (``SPAN`` to ``2 * SPAN - ANCHOR`` bytes), and:

1. One pass cuts all documents into segments and ships, for each, the anchor's and the segment's hash,
   packed by bucket.  Equal segments of one task are settled as repeats there and shipped once.
2. An anchor seen once ends there.  Of the others, one copy of each distinct segment is read again.
3. The segments of a bucket are sorted by suffix, anchors together, in bounded chunks.  A stack scan of
   the common prefixes of neighbours builds the common-prefix intervals of at least ``SPAN`` bytes; one
   whose suffixes differ in the byte to their left is a maximal repeat, with all its occurrences.  An
   anchor with more than ``GROUP`` distinct segments is dealt on by the hash of each single string, and streamed.
4. The occurrences of the segments carry the repeats back to the documents: as merged spans
   (:func:`suffix_dedup`), or as groups with all their occurrences (:func:`repeat_groups`).

Documents are joined twice by key, and no stage holds more than a chunk; only step 2 holds a bucket's entries, as they came.

Defined results: null and empty text have no bytes and lose none; a text shorter than ``SPAN`` bytes loses
none; rows that repeat id and text are two documents, and repeat each other; a null id is kept as null;
other columns are ignored.  Hashes have 104 bits for a segment and 128 for a single string of a large group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, drop_scratch, keyed, partitions, public_id, read_docs, released, scratch, tune
from .kernels import BYTE, POWERS, mix, prefix_sums

#: Bytes of a string that counts as repeated, and of its anchor.
SPAN, ANCHOR = 200, 100
#: Distinct segments of one anchor that are sorted together, and bytes of segments in one sorted chunk.
GROUP, CHUNK = 2048, 1 << 18
#: Segments that a task holds before it ships them, entries of a bucket that are compared together, suffixes whose prefixes are.
HELD, COMPARED, SLICE = 1 << 20, 1 << 18, 1 << 13
#: Bytes that are cut into segments at a time.
PIECE = 1 << 19
#: Values of bytes for the second hash of a single string.
SECOND = mix(BYTE)

ENTRY = np.dtype([("anchor", "<u4"), ("anchor_low", "u1"), ("hash", "<u8"), ("doc", "<u4"), ("start", "<u4"), ("size", "<u2"), ("many", "u1")])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def segments(data: np.ndarray, ends: np.ndarray, span: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of texts that follow each other in ``data`` up to ``ends``: (anchor hash, segment hash, start, size) by position."""
    n = len(data) - span + 1
    none = np.zeros(0, np.uint64)
    if n <= 0:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    sums, (_, down) = prefix_sums(BYTE[data]), POWERS.get(len(data) + 1)
    of = mix((sums[anchor:] - sums[:-anchor]) * down[: len(data) - anchor + 1])
    place = np.uint64(PIECE * 2 - 1).item().bit_length() if len(data) < PIECE * 2 else int(len(data)).bit_length()
    low = np.uint64((1 << place) - 1)
    at = (sliding_min((of & ~low) | np.arange(len(of), dtype=np.uint64), span - anchor + 1) & low).astype(np.int64)
    begin = np.arange(n)
    inside = np.searchsorted(ends, begin, side="right")
    valid = begin + span <= ends[np.minimum(inside, len(ends) - 1)]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + span
    whole = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
    return of[at[start]], whole, start, stop - start


def cut_documents(texts: list[bytes], span: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, start in it, anchor hash, segment hash, size) in bounded pieces; long texts in pieces that overlap."""
    pieces: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        ends = np.cumsum([len(p[2]) for p in pieces])
        anchors, whole, start, length = segments(data, ends, span, anchor)
        of = np.searchsorted(ends, start, side="right")
        base = np.array([p[1] for p in pieces]) - (ends - np.array([len(p[2]) for p in pieces]))
        return np.array([p[0] for p in pieces])[of], start + base[of], anchors, whole, length

    for doc, text in enumerate(texts):
        for at in range(0, max(1, len(text) - span + 1), PIECE):
            part = text[at : at + PIECE + span - 1]
            if len(part) < span:
                continue
            pieces.append((doc, at, part))
            size += len(part)
            if size >= PIECE:
                yield flush()
                pieces, size = [], 0
    if pieces:
        yield flush()


def spot_names() -> list[str]:
    return ["bucket", "blob", "_id", "_key", "start", "size", "seg", "hash"]


SPOTS = "bucket int, blob binary, _id long, _key long, start int, size int, seg long, hash long"


def segment_id(anchor: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Of both hashes; with the segment's own hash beside it, it stands for all their bits."""
    return mix(mix(anchor) + whole).view(np.int64)


def spots(ids, keys, start, size, seg, whole) -> pa.RecordBatch:
    n = len(seg)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(np.asarray(start, np.int32)),
                                       pa.array(np.asarray(size, np.int32)), pa.array(np.asarray(seg, np.int64)), pa.array(whole.view(np.int64))], names=spot_names())


def ship(span: int, anchor: int, buckets: int):
    """Step 1: blobs of entries by bucket, and the places of segments that repeat within the task's buffer."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        ids, keys, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            anchors, whole = (np.concatenate([h[k] for h in held]) for k in (2, 3))
            of = ((anchors >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)) << np.uint64(40) | low40(anchors)  # bucket, then what travels
            del anchors
            order = np.lexsort((whole, of))
            of, whole = of[order], whole[order]
            doc, start, length = (np.concatenate([h[k] for h in held])[order] for k in (0, 1, 4))
            held.clear()
            del order
            begin = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (whole[1:] != whole[:-1])))
            counts = np.diff(np.append(begin, len(doc)))
            id_array, key_array = np.array(ids, np.int64), np.array(keys, np.int64)
            more = np.repeat(counts > 1, counts)
            for lo in range(0, len(doc), 1 << 17):
                at = lo + np.flatnonzero(more[lo : lo + (1 << 17)])
                if len(at):
                    yield spots(id_array[doc[at]], key_array[doc[at]], start[at], length[at], segment_id(low40(of[at]), whole[at]), whole[at])
            out = np.zeros(len(begin), ENTRY)
            a = of[begin]
            out["anchor"], out["anchor_low"], out["hash"] = (low40(a) >> np.uint64(8)).astype(np.uint32), a.astype(np.uint8), whole[begin]
            out["doc"], out["start"], out["size"], out["many"] = doc[begin], start[begin], length[begin], counts > 1
            cut = np.searchsorted(a >> np.uint64(40), np.arange(buckets + 1, dtype=np.uint64))
            at = [b for b in range(buckets) if cut[b] < cut[b + 1]]
            for lo in range(0, len(at), 64):
                part = at[lo : lo + 64]
                blobs, n = [pack(out[cut[b] : cut[b + 1]], id_array, key_array) for b in part], len(part)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blobs, pa.binary()), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=spot_names())

        for batch in batches:
            base = len(ids)
            ids += batch.column("_id").to_pylist()
            keys += batch.column("_key").to_pylist()
            for doc, *rest in cut_documents(binaries(batch.column("_text")), span, anchor):
                start, anchors, whole, length = rest
                held.append(((doc + base).astype(np.int32), start.astype(np.int32), anchors, whole, length.astype(np.int16)))
                size += len(doc)
            if size > HELD:
                yield from flush()
                held, ids, keys, size = [], [], [], 0
        if size:
            yield from flush()

    return run


def low40(anchors: np.ndarray) -> np.ndarray:
    """The part of an anchor's hash that travels."""
    return anchors & np.uint64((1 << 40) - 1)


def pack(entries: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> bytes:
    """Entries column by column, after the ids and keys of their documents."""
    docs, entries["doc"] = np.unique(entries["doc"], return_inverse=True)
    columns = [entries[c].tobytes() for c in ENTRY.names]
    return b"".join([len(docs).to_bytes(4, "little"), len(entries).to_bytes(4, "little"), ids[docs].tobytes(), keys[docs].tobytes(), *columns])


def unpack(blob: bytes) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The columns of the entries, ids and keys, as views of the blob."""
    d, n = (int.from_bytes(blob[k : k + 4], "little") for k in (0, 4))
    at, out = 8 + 16 * d, {}
    for c in ENTRY.names:
        out[c] = np.frombuffer(blob, ENTRY[c], n, at)
        at += n * ENTRY[c].itemsize
    return out, np.frombuffer(blob, np.int64, d, 8), np.frombuffer(blob, np.int64, d, 8 + 8 * d)


#: Kinds of rows: a place of a segment whose anchor repeats; the copy of it that is read; the same in a large group.
PLACE, COPY, COPY_LARGE = 0, 1, 2
FOUND = "kind int, _id long, _key long, start int, size int, seg long, hash long, anchor long, many boolean"


def repeated(group: int):
    """Step 2: the places of a bucket's segments with repeated anchors, and one copy of each distinct segment.

    The blobs of a bucket stay as they came; ranges of their anchors are compared one after the other.
    """

    def compared(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        column = lambda c: np.concatenate([p[0][c][p[3] : p[4]] for p in parts])
        doc = [p[0]["doc"][p[3] : p[4]] for p in parts]
        id_array, key_array = (np.concatenate([p[k][d] for p, d in zip(parts, doc, strict=True)]) for k in (1, 2))
        anchors, whole, many = column("anchor").astype(np.uint64) << np.uint64(8) | column("anchor_low"), column("hash"), column("many")
        start, size = column("start"), column("size")
        order = np.lexsort((whole, anchors))
        anchors, many = anchors[order], many[order]
        begin = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
        sizes = np.diff(np.append(begin, len(anchors)))
        keep = np.repeat((sizes > 1) | (np.maximum.reduceat(many, begin) > 0), sizes)
        order, anchors, many = order[keep], anchors[keep], many[keep]
        if not len(order):
            return
        whole, start, size, id_array, key_array = whole[order], start[order], size[order], id_array[order], key_array[order]
        seg = segment_id(anchors, whole)
        begin = np.flatnonzero(np.append(True, (anchors[1:] != anchors[:-1]) | (whole[1:] != whole[:-1])))
        counts = np.diff(np.append(begin, len(seg)))
        repeats = (counts > 1) | (np.maximum.reduceat(many, begin) > 0)
        # distinct segments of each anchor
        of = anchors[begin]
        edge = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        distinct = np.diff(np.append(edge, len(of)))
        kind = np.where(np.repeat(distinct, distinct) > group, COPY_LARGE, COPY)
        places = np.flatnonzero(many == 0)  # those of the others are out already
        for at, kinds, manys in ((places, np.full(len(places), PLACE), np.zeros(len(places), bool)), (begin, kind, repeats)):
            for lo in range(0, len(at), 1 << 16):
                p, part = at[lo : lo + (1 << 16)], slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds[part].astype(np.int32)), pa.array(id_array[p]), pa.array(key_array[p]), pa.array(start[p].astype(np.int32)), pa.array(size[p].astype(np.int32)),
                     pa.array(seg[p]), pa.array(whole[p].view(np.int64)), pa.array(anchors[p].view(np.int64)), pa.array(manys[part])], names=[x.split()[0] for x in FOUND.split(", ")])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [unpack(blob) for batch in batches for blob in batch.column("blob").to_pylist()]
        ranges = max(1, -(-sum(len(b[0]["doc"]) for b in blobs) // COMPARED))
        bounds = [[0] * len(blobs)]
        for k in range(1, ranges):
            bounds.append([int(np.searchsorted(b[0]["anchor"], np.uint32((k << 32) // ranges))) for b in blobs])
        bounds.append([len(b[0]["doc"]) for b in blobs])
        for low, high in pairwise(bounds):
            parts = [(*blob, a, b) for blob, a, b in zip(blobs, low, high, strict=True) if a < b]
            if parts:
                yield from compared(parts)

    return run


def read_copies(span: int):
    """Step 3, reading: (anchor, check, seg, hash, many, at, bytes); in large groups each string of ``span`` bytes by two hashes, without bytes."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "check", "seg", "hash", "many", "at", "bytes"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
        for batch in batches:
            out: list[tuple] = []
            for text, copies in zip(binaries(batch.column("_text")), batch.column("copies").to_pylist(), strict=True):
                for c in copies:
                    part = text[c["start"] : c["start"] + c["size"]]
                    if c["kind"] == COPY:
                        out.append((c["anchor"], 0, c["seg"], c["hash"], c["many"], 0, part))
                    else:
                        data, n = np.frombuffer(part, np.uint8), len(part) - span + 1
                        two = []
                        for values in (BYTE, SECOND):
                            sums = prefix_sums(values[data])
                            two.append(mix((sums[span:] - sums[:-span]) * POWERS.get(n)[1]).view(np.int64).tolist())
                        out += [(x, y, c["seg"], c["hash"], c["many"], at, None) for at, (x, y) in enumerate(zip(*two, strict=True))]
                    if len(out) >= 1 << 13:
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)
                        out = []
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)

    return run


def maximal_repeats(strings: list[bytes], span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, string numbers, offsets) of each maximal repeat of at least ``span`` bytes, shorter ones after longer inside.

    An enhanced suffix array of the suffixes with at least ``span`` bytes.  A suffix at the begin of its
    string has an unknown byte to the left, which counts as different from all others.
    """
    which = np.repeat(np.arange(len(strings)), [max(0, len(s) - span + 1) for s in strings])
    if not len(which):
        return
    counts = np.bincount(which, minlength=len(strings))
    offset = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    suffixes = [strings[w][o:] for w, o in zip(which.tolist(), offset.tolist(), strict=True)]
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    lengths = np.array([len(suffixes[i]) for i in order])
    common = np.zeros(len(order) - 1, np.int64)
    for lo in range(0, len(order) - 1, SLICE):
        part = lengths[lo : lo + SLICE + 1]
        width = int(part.max())
        table = np.zeros((len(part), width), np.uint8)
        table[np.arange(width) < part[:, None]] = np.frombuffer(b"".join([suffixes[i] for i in order[lo : lo + SLICE + 1]]), np.uint8)
        differs = np.ones((len(part) - 1, width + 1), bool)
        np.not_equal(table[1:], table[:-1], out=differs[:, :width])
        common[lo : lo + len(part) - 1] = np.minimum(differs.argmax(axis=1), np.minimum(part[1:], part[:-1]))
    del suffixes
    which, offset = which[order], offset[order]
    left = np.array([strings[w][o - 1] if o else -1 - i for i, (w, o) in enumerate(zip(which.tolist(), offset.tolist(), strict=True))])
    changes = np.concatenate(([0], np.cumsum(left[1:] != left[:-1])))  # a range has one left byte if this is the same at both ends
    stack: list[tuple[int, int]] = []  # (common prefix, first suffix) of the open intervals
    long_ = np.flatnonzero(common >= span)
    if not len(long_):
        return
    values = common.tolist()
    for begin, end in zip(long_[np.append(True, np.diff(long_) > 1)].tolist(), long_[np.append(np.diff(long_) > 1, True)].tolist(), strict=True):
        for i in range(begin, end + 2):
            value = values[i] if i <= end else 0
            first = i
            while stack and stack[-1][0] > value:
                length, first = stack.pop()
                if changes[i] != changes[first]:
                    yield length, which[first : i + 1], offset[first : i + 1]
            if value >= span and (not stack or stack[-1][0] < value):
                stack.append((value, first))
        stack.clear()


def covered(strings: list[bytes], many: list[bool], span: int) -> list[list[tuple[int, int]]]:
    """For each distinct string what maximal repeats cover; one that stands in several places is repeated as a whole."""
    best = [np.zeros(max(0, len(s) - span + 1), np.int64) for s in strings]
    flat = np.concatenate(best) if best else np.zeros(0, np.int64)
    base = np.cumsum([0, *map(len, best)])
    for length, which, offset in maximal_repeats(strings, span):
        at = base[which] + offset
        flat[at] = np.maximum(flat[at], length)
    out = []
    for k, text in enumerate(strings):
        if many[k]:
            out.append([(0, len(text))])
            continue
        lengths = flat[base[k] : base[k + 1]]
        at = np.flatnonzero(lengths)
        out.append(merged(np.stack([at, at + lengths[at]], axis=1).tolist()))
    return out


def groups_of(strings: list[bytes], many: list[bool], span: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(length, string numbers, offsets) of each repeat group; a string that stands in several places is a group as a whole."""
    whole = {k for k, repeats in enumerate(many) if repeats}
    for length, which, offset in maximal_repeats(strings, span):
        numbers, offsets = which.tolist(), offset.tolist()
        whole -= {w for w, o in zip(numbers, offsets, strict=True) if not o and len(strings[w]) == length}
        yield length, numbers, offsets
    for k in sorted(whole):
        yield len(strings[k]), [k], [0]


def repeat_id(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def merged(spans: list) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(map(tuple, spans)):
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((begin, end))
    return out


#: What :func:`sort_segments` returns: covered ranges of a segment; with groups, the repeat that each place in it belongs to.
COVERED = {"seg": "long", "hash": "long", "begin": "int", "end": "int"}
GROUPED = COVERED | {"repeat": "long"}


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def sort_segments(span: int, groups: bool = False):
    """Step 3, sorting: rows in order of anchor and check -> (seg, hash, begin, end) of what is repeated; with ``groups``
    one row for each place of each repeat group, and the group's id."""
    columns = GROUPED if groups else COVERED
    arrow = [{"long": pa.int64(), "int": pa.int32()}[kind] for kind in columns.values()]
    names = ("anchor", "check", "seg", "hash", "many", "at", "bytes")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: list[tuple] = []
        single: list[tuple] = []  # places of a string of a large group that is repeated; or its first place so far
        current, size, repeated_ = None, 0, False

        def emit(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(arrow)], names=list(columns))

        def flush() -> Iterator[pa.RecordBatch]:
            texts, many = [x[6] for x in chunk], [x[4] for x in chunk]
            if not groups:
                yield emit([(x[2], x[3], a, b) for x, s in zip(chunk, covered(texts, many, span), strict=True) for a, b in s])
                return
            found: list[tuple] = []
            for length, which, offsets in groups_of(texts, many, span):
                name = repeat_id(texts[which[0]][offsets[0] : offsets[0] + length])
                for w, o in zip(which, offsets, strict=True):
                    found.append((chunk[w][2], chunk[w][3], o, o + length, name))
                    if len(found) >= 1 << 13:
                        yield emit(found)
                        found = []
            yield emit(found)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                anchor, check, seg, whole, many, at, text = row
                fresh = (anchor, check, text is None) != current
                if text is None:
                    if fresh:
                        if current and current[2] and not repeated_:
                            single.pop()
                        repeated_ = False
                        if len(single) > 1 << 13:
                            yield emit(single)
                            single = []
                    elif len(single) > 1 << 13 and repeated_:
                        yield emit(single)
                        single = []
                    repeated_ |= many or not fresh
                    single.append((seg, whole, at, at + span, anchor))
                else:
                    if fresh and current and current[2] and not repeated_:
                        single.pop()
                    if fresh and size > CHUNK:
                        yield from flush()
                        chunk, size = [], 0
                    chunk.append(row)
                    size += len(text)
                current = anchor, check, text is None
        if current and current[2] and not repeated_:
            single.pop()
        if chunk:
            yield from flush()
        if single:
            yield emit(single)

    return run


@dataclass(frozen=True)
class Segments:
    """Steps 1 to 3: segments in order of their anchors, ready to be sorted by suffix, and the places of all of them."""

    sorted: DataFrame
    places: DataFrame
    tables: tuple[DataFrame, ...]


def segments_of(docs: DataFrame, id_col: str, text_col: str, span: int, anchor: int, group: int) -> Segments:
    spark = tune(docs.sparkSession)
    parts = partitions(spark)
    rows = keyed(docs, id_col, text_col)
    shipped = scratch(rows.mapInArrow(ship(span, anchor, parts), SPOTS), "segments")
    blobs = shipped.where("blob IS NOT NULL").select("bucket", "blob").repartition(parts, "bucket")
    found = scratch(blobs.mapInArrow(repeated(group), FOUND), "repeated-segments")
    copies = found.where(F.col("kind") != PLACE).groupBy("_id", "_key").agg(F.collect_list(F.struct("kind", "start", "size", "seg", "hash", "anchor", "many")).alias("copies"))
    texts = rows.join(copies, ["_id", "_key"]).select("_text", "copies").mapInArrow(read_copies(span), "anchor long, check long, seg long, hash long, many boolean, at int, bytes binary")
    dealt = texts.repartition(parts, "anchor").sortWithinPartitions("anchor", F.col("bytes").isNull(), "check")
    places = found.where(F.col("kind") == PLACE).select("_id", "_key", "start", "seg", "hash").unionByName(shipped.where("blob IS NULL").select("_id", "_key", "start", "seg", "hash"))
    return Segments(dealt, places, (shipped, found))


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """(_id, _key, spans): for each document with repeats, the byte ranges in which they stand, not yet merged."""
    cut = segments_of(docs, id_col, text_col, span, anchor, group)
    # written, so that the join below can split the places of a very common segment
    spans = scratch(cut.sorted.mapInArrow(sort_segments(span), ddl(COVERED)).groupBy("seg", "hash").agg(F.collect_set(F.struct("begin", "end")).alias("spans")), "segment-spans")
    hits = cut.places.join(spans, ["seg", "hash"]).select("_id", "_key", F.transform("spans", lambda s: F.struct((s["begin"] + F.col("start")).alias("begin"), (s["end"] + F.col("start")).alias("end"))).alias("spans"))
    out = scratch(hits.groupBy("_id", "_key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "document-spans")
    drop_scratch(*cut.tables, spans)
    return out


def repeat_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """(repeat, length, _id, _key, begin): the maximal repeat groups of at least ``span`` bytes, one row for each occurrence.

    ``repeat`` names a string of ``length`` bytes.  Groups are the common-prefix intervals with different left bytes, so
    a group is maximal inside its segments, of up to ``2 * span - anchor`` bytes: a longer passage is a chain of groups
    that overlap.  An anchor with more than ``group`` distinct segments gives groups of just ``span`` bytes, and a text
    over ``PIECE`` bytes ends a segment at each piece.  Together the occurrences cover what :func:`suffix_dedup` removes;
    rows that repeat id and text give an occurrence each.
    """
    cut = segments_of(docs, id_col, text_col, span, anchor, group)
    # a segment lies in a bounded number of groups, at a bounded number of places
    of = scratch(cut.sorted.mapInArrow(sort_segments(span, groups=True), ddl(GROUPED)).groupBy("seg", "hash").agg(F.collect_list(F.struct("repeat", "begin", "end")).alias("groups")), "segment-groups")
    hits = cut.places.join(of, ["seg", "hash"]).select("_id", "_key", "start", F.explode("groups").alias("g"))
    out = scratch(hits.select("g.repeat", (F.col("g.end") - F.col("g.begin")).alias("length"), "_id", "_key", (F.col("start") + F.col("g.begin")).alias("begin")), "repeat-groups")
    drop_scratch(*cut.tables, of)
    return out


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Every row of ``docs`` as (_id, _key, n_bytes, spans, kept): merged byte ranges that go, and the bytes that stay."""

    @released
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, cuts, kept = [], [], []
            for text, spans in zip(binaries(batch.column("_text")), batch.column("spans").to_pylist(), strict=True):
                cut = merged([(s["begin"], s["end"]) for s in spans or []])
                ends = [0, *(e for _, e in cut)]
                sizes.append(len(text))
                cuts.append([{"begin": a, "end": b} for a, b in cut])
                kept.append(b"".join(text[a:b] for a, b in zip(ends, [*(b for b, _ in cut), len(text)], strict=True)))
            struct = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_key"), pa.array(sizes, pa.int64()), pa.array(cuts, struct), pa.array(kept, pa.binary())],
                                             names=["_id", "_key", "n_bytes", "spans", "kept"])

    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, **options)
    joined = keyed(docs, id_col, text_col).join(spans, ["_id", "_key"], "left").select("_id", "_key", "_text", "spans")
    return joined.mapInArrow(remove, "_id long, _key long, n_bytes long, spans array<struct<begin:int,end:int>>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup(read_docs(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return rows.select(public_id().alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
