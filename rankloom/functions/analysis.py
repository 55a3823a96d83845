"""Tokenizers and token filters as Column expressions; stemming runs over distinct terms only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters and digits, with runs of Chinese and Japanese characters apart.  Latin letters and digits come first and runs are
#: possessive: a class with an intersection costs ten times as much for each character.
_EAST = r"ᄀ-ᇿ぀-㆏㄀-ㄯㆠ-ㆿㇰ-ㇿ㌀-㍿㐀-䶿一-鿿豈-﫿･-ﾟ"
_LATIN = "a-zA-Z0-9À-ÖØ-öø-ÿ"
_OTHER = r"\p{L}\p{N}&&[^\x00-\x7FÀ-ÖØ-öø-ÿᄀ-ᇿ぀-㆏ㆠ-ㆿㇰ-ㇿ㌀-㍿㐀-䶿一-鿿豈-﫿･-ﾟ]"
_REST = f"(?:[{_LATIN}]++|[{_OTHER}]++)*+"
GENERAL = f"[{_LATIN}]{_REST}|[{_EAST}]++|[{_OTHER}]{_REST}"
#: Host, e-mail, acronym, company, apostrophe and number forms before plain words, the longest form first.
STANDARD = (
    r"[\p{L}\p{N}]+(?:[._-][\p{L}\p{N}]+)*@[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)+"
    r"|\p{L}\.(?:\p{L}\.)+"
    r"|\p{L}+[&@]\p{L}+"
    r"|\p{L}+(?:'\p{L}+)+"
    r"|[\p{L}\p{N}]*\p{N}[\p{L}\p{N}]*(?:[._,/-][\p{L}\p{N}]+)+"
    r"|[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)+"
    r"|[\p{L}\p{N}]+"
)


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def whitespace(text: Column) -> Column:
    return matches(text, r"\S+")


def letters(text: Column) -> Column:
    return matches(text, r"\p{L}+")


def lower_letters(text: Column) -> Column:
    return letters(F.lower(text))


def marked_letters(text: Column) -> Column:
    """Runs of letters and of the marks that stand over or under them."""
    return matches(text, r"[\p{L}\p{Mn}]+")


def keyword(text: Column) -> Column:
    return F.when(text.isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>"))


def general(text: Column) -> Column:
    """The default: lower-cased runs of letters and digits."""
    return matches(F.lower(text), GENERAL)


def standard(text: Column) -> Column:
    return matches(F.lower(text), STANDARD)


def cjk_bigrams(text: Column) -> Column:
    """Latin words as they are, runs of ideographs as overlapping pairs."""
    runs = matches(F.lower(text), r"[a-z0-9_+#]+|[぀-㆏ㆠ-ㆿㇰ-ㇿ㌀-㍿㐀-䶿一-鿿豈-﫿가-힯]+")
    pairs = lambda r: F.when(r.rlike("^[a-z0-9_+#]") | (F.length(r) < 2), F.array(r)).otherwise(char_ngrams(r, 2, 2))
    return F.flatten(F.transform(runs, pairs))


def han_unigrams(text: Column) -> Column:
    return matches(F.lower(text), r"\p{IsHan}|[a-z0-9]+")


def by_pattern(text: Column, pattern: str) -> Column:
    """What stands between matches of ``pattern``."""
    return F.filter(F.split(text, pattern), lambda t: t != "")


def char_ngrams(term: Column, low: int, high: int) -> Column:
    def of_size(k: int) -> Column:
        begins = F.sequence(F.lit(1), F.length(term) - (k - 1))
        return F.when(F.length(term) >= k, F.transform(begins, lambda i: F.substring(term, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of_size, range(low, high + 1)))


def edge_ngrams(term: Column, low: int, high: int, front: bool = True) -> Column:
    n = F.length(term)
    ends = F.transform(F.sequence(F.lit(low), F.least(F.lit(high), n)), lambda k: F.substring(term, F.lit(1), k) if front else F.substring(term, n - k + 1, k))
    return F.when(n >= low, ends).otherwise(F.array().cast("array<string>"))


def shingles(tokens: Column, size: int, unigrams: bool = False, separator: str = " ") -> Column:
    n = F.size(tokens)
    grams = F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.array_join(F.slice(tokens, i, size), separator))).otherwise(F.array().cast("array<string>"))
    return F.concat(tokens, grams) if unigrams else grams


def shingle_matrix(columns: Column, low: int, high: int, separator: str = "_") -> Column:
    """``low`` to ``high`` neighbouring columns (arrays of alternatives) joined, one string for each choice of alternatives."""
    def longer(rows: Column, column: Column) -> Column:
        return F.flatten(F.transform(rows, lambda r: F.transform(column, lambda t: F.concat(r, F.lit(separator), t))))

    def of_size(made: Column, k: int) -> Column:
        begins = F.sequence(F.lit(1), F.size(made) - (k - 1))
        chosen = lambda i: F.aggregate(F.slice(made, i + 1, F.lit(k - 1)), F.element_at(made, i), longer)
        return F.when(F.size(made) >= k, F.flatten(F.transform(begins, chosen))).otherwise(F.array().cast("array<string>"))

    # the columns are made once, not once for each begin
    return F.element_at(F.transform(F.array(columns), lambda made: F.concat(*(of_size(made, k) for k in range(low, high + 1)))), 1)


def token_range(tokens: Column, low: int, high: int) -> Column:
    """The tokens at places ``low`` (from 0) to ``high`` (left out)."""
    return F.slice(tokens, low + 1, high - low)


def date_tokens(tokens: Column, form: str) -> Column:
    """Tokens that are dates of this form."""
    return F.filter(tokens, lambda t: F.try_to_timestamp(t, F.lit(form)).isNotNull())


def joined_streams(*streams: Column | str) -> Column:
    """Streams one after the other; a string is a stream of one token."""
    return F.concat(*(F.array(F.lit(s)) if isinstance(s, str) else s for s in streams))


def stop(tokens: Column, words: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(words))


def length_between(tokens: Column, low: int, high: int) -> Column:
    return F.filter(tokens, lambda t: F.length(t).between(low, high))


def index_unit(tokens: Column, longest: int = 20, digits: int = 4) -> Column:
    """Drops terms that are long, have many digits or the same character four times in a row."""
    return F.filter(tokens, lambda t: (F.length(t) < longest) & (F.length(F.regexp_replace(t, "[^0-9]", "")) <= digits) & ~t.rlike(r"(.)\1{3}"))


def number_filter(tokens: Column, combined: bool = False) -> Column:
    """Drops terms of zeros and nines; with ``combined`` all terms that aren't letters only, but for ps2."""
    keep = lambda t: ~t.rlike("^[09]+$") & ((t == "ps2") | t.rlike(r"^\p{L}+$") if combined else F.lit(True))
    return F.filter(tokens, keep)


#: Latin-1 and Latin Extended-A letters and the ASCII letters they fold to (fixed values).
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"


def fold_accents(text: Column) -> Column:
    folded = F.translate(text, ACCENTED, PLAIN)
    for mark, plain in {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss", "Þ": "TH", "þ": "th", "Ð": "D", "ð": "d"}.items():
        folded = F.replace(folded, F.lit(mark), F.lit(plain))
    return folded


def map_chars(text: Column, mapping: dict[str, str]) -> Column:
    """Replaces strings before tokenizing, longer ones first."""
    for old in sorted(mapping, key=len, reverse=True):
        text = F.replace(text, F.lit(old), F.lit(mapping[old]))
    return text


def elision(term: Column, articles: str = "l|m|t|qu|n|s|j|d|c") -> Column:
    return F.regexp_replace(term, f"^(?:{articles})['’]", "")


def standard_filter(term: Column) -> Column:
    """Drops a final 's, and the dots of acronyms."""
    return F.when(term.rlike(r"^\p{L}\.(\p{L}\.)+$"), F.replace(term, F.lit("."), F.lit(""))).otherwise(F.regexp_replace(term, "'s$", ""))


def reverse(tokens: Column) -> Column:
    return F.transform(tokens, F.reverse)


def dictionary_compounds(term: Column, words: list[str], low: int = 2, high: int = 15) -> Column:
    """The term and the dictionary's words inside it."""
    return F.concat(F.array(term), F.filter(char_ngrams(F.lower(term), low, high), lambda g: g.isin(words)))


def delimited_payload(token: Column, mark: str = "|") -> Column:
    return F.struct(F.substring_index(token, mark, 1).alias("term"), F.when(F.instr(token, mark) > 0, F.substring_index(token, mark, -1)).alias("payload"))


def limit(tokens: Column, n: int = 10000) -> Column:
    """The first n tokens of a field."""
    return F.slice(tokens, 1, n)


def with_increments(tokens: Column, increment: int = 0) -> Column:
    """(term, increment) of each token: the first has 1, all others ``increment``."""
    return F.transform(tokens, lambda t, i: F.struct(t.alias("term"), F.when(i == 0, F.lit(1)).otherwise(F.lit(increment)).alias("increment")))


#: Letters that Arabic texts write in several ways and the one form they get; marks that go (fixed values).
ARABIC_FORMS = {"آ": "ا", "أ": "ا", "إ": "ا", "ى": "ي", "ة": "ه"}
ARABIC_MARKS = "ـًٌٍَُِّْ"
#: Article, conjunction and preposition prefixes, and endings, of Arabic light stemming; a stem keeps two letters or more (fixed values).
ARABIC_PREFIXES = ("ال", "وال", "بال", "كال", "فال", "لل", "و")
ARABIC_SUFFIXES = ("ها", "ان", "ات", "ون", "ين", "يه", "ية", "ه", "ة", "ي")
#: Persian forms of shared letters (fixed values).
PERSIAN_FORMS = {"ی": "ي", "ے": "ي", "ک": "ك", "ۀ": "ه", "ہ": "ه", "ٔ": ""}
#: Greek letters with marks, and the final sigma, and their plain small letters (fixed values).
GREEK_FORMS = {"ά": "α", "έ": "ε", "ή": "η", "ί": "ι", "ϊ": "ι", "ΐ": "ι", "ό": "ο", "ύ": "υ", "ϋ": "υ", "ΰ": "υ", "ώ": "ω", "ς": "σ"}


def by_forms(text: Column, forms: dict[str, str], drop: str = "") -> Column:
    """``text`` with each letter in its plain form, without the letters of ``drop``."""
    kept = {k: v for k, v in forms.items() if v}
    gone = drop + "".join(k for k, v in forms.items() if not v)
    return F.translate(text, "".join(kept) + gone, "".join(kept.values()))


def arabic(text: Column) -> Column:
    return by_forms(text, ARABIC_FORMS, ARABIC_MARKS)


def persian(text: Column) -> Column:
    return by_forms(text, PERSIAN_FORMS)


def greek(text: Column) -> Column:
    return by_forms(F.lower(text), GREEK_FORMS)


def arabic_stem(word: str) -> str:
    """Light stemming: at most one prefix, then endings in the order of their list."""
    for prefix in ARABIC_PREFIXES:
        least = 4 if prefix == "و" else len(prefix) + 2
        if word.startswith(prefix) and len(word) >= least:
            word = word[len(prefix) :]
            break
    for suffix in ARABIC_SUFFIXES:
        if word.endswith(suffix) and len(word) >= len(suffix) + 2:
            word = word[: -len(suffix)]
    return word


ANALYZERS: dict[str, Callable[[Column], Column]] = {
    "whitespace": whitespace, "letters": letters, "simple": lower_letters, "keyword": keyword, "general": general, "standard": standard, "cjk": cjk_bigrams, "han": han_unigrams,
}

_VOWEL = "aeiou"


def porter(word: str) -> str:
    """The Porter stemmer (M. F. Porter, An algorithm for suffix stripping, 1980)."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word

    def shape(s: str) -> str:
        out = ""
        for i, c in enumerate(s):
            vowel = c in _VOWEL or (c == "y" and i > 0 and out[-1] == "c")
            out += "v" if vowel else "c"
        return out

    def measure(s: str) -> int:
        return shape(s).count("vc")

    def double(s: str) -> bool:
        return len(s) > 1 and s[-1] == s[-2] and shape(s)[-1] == "c"

    def cvc(s: str) -> bool:
        return len(s) > 2 and shape(s)[-3:] == "cvc" and s[-1] not in "wxy"

    def swap(s: str, rules: list[tuple[str, str]], least: int) -> str:
        for end, new in rules:
            if s.endswith(end):
                stem = s[: len(s) - len(end)]
                return stem + new if measure(stem) > least else s
        return s

    w = word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    w = swap(w, [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
                 ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")], 0)
    w = swap(w, [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")], 0)
    for end in "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split():
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            if measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not cvc(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


def stem_terms(terms: DataFrame, stemmer: Callable[[str], str] = porter) -> DataFrame:
    """(term, stem) of the distinct terms; join it back, so that each term is stemmed once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"term": frame["term"], "stem": [stemmer(t) for t in frame["term"]]})

    return terms.select("term").where("term IS NOT NULL").distinct().mapInPandas(run, "term string, stem string")
