"""Benchmark decontamination with an FM-index over each shard of the corpus.

A shard is a bounded run of documents.  Its words are numbered by the benchmark's vocabulary; a word that
no benchmark text holds can't be part of a match, so a run of such words is one separator.  Over that
sequence the shard gets a suffix array, its Burrows-Wheeler transform in a wavelet tree, and every
``SAMPLE``-th position of the text as located sample.  All windows of all benchmark items whose words the shard
holds are searched backward at the same time (one numpy step for each word of the window), each match is located by
walking to a sampled position, and the spans are merged for each document.

Nothing is shuffled: documents are read once and every row gets its answer where it is read.

Defined results: null text has no words; an item of fewer than ``window`` words is one window of all its
words, and an item without words never matches; an item with a null id is left out; repeated rows are
judged one by one; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, public_id, read_docs, released, row_id, scratch, tune

#: Words of one benchmark window.
WINDOW = 10
#: A shard is closed when it holds this many symbols.
SHARD_SYMBOLS = 1 << 20
#: Every so many positions of a shard's text one is stored for locating.
SAMPLE = 8
#: Benchmark words in one block; a larger benchmark is searched block by block.
BLOCK_WORDS = 1 << 21

#: A-Z to a-z; ASCII that is no letter or digit to a space; bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(FOLD).split()


class WaveletTree:
    """Ranks of symbols in a sequence: level by level the next lower bit, zeros moved before ones."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.n, self.bits = len(seq), bits
        self.ranks: list[np.ndarray] = []  # of zeros before each place
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            zero = (seq >> level & 1) == 0
            self.ranks.append(np.concatenate(([0], np.cumsum(zero, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(self.ranks[-1][-1]))
            seq = np.concatenate((seq[zero], seq[~zero]))

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros(len(places), np.int64), places.astype(np.int64)
        for level, (ranks, zeros) in enumerate(zip(self.ranks, self.zeros, strict=True)):
            one = (symbols >> (self.bits - 1 - level) & 1) == 1
            low0, high0 = ranks[low], ranks[high]
            low, high = np.where(one, zeros + low - low0, low0), np.where(one, zeros + high - high0, high0)
        return high - low

    def access(self, places: np.ndarray) -> np.ndarray:
        """The symbols at the places."""
        out, at = np.zeros(len(places), np.int64), places.astype(np.int64)
        for ranks, zeros in zip(self.ranks, self.zeros, strict=True):
            before = ranks[at]
            one = ranks[at + 1] == before
            out = out * 2 + one
            at = np.where(one, zeros + at - before, before)
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol must be smaller than all others."""
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    n, step = len(seq), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        if fresh[order[-1]] == n - 1:
            return order
        rank, step = fresh, step * 2


class FMIndex:
    """Backward search over a sequence of symbols from 1 upward; 0 ends it."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE) -> None:
        text = np.append(np.asarray(seq, np.int64), 0)
        order = suffix_array(text)
        self.n = len(text)
        self.tree = WaveletTree(text[order - 1], max(1, int(text.max()).bit_length()))
        counts = np.bincount(text, minlength=(1 << self.tree.bits) + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.marked = order % sample == 0
        self.mark_rank = np.concatenate(([0], np.cumsum(self.marked)))
        self.samples = order[self.marked]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges of patterns, given as rows of equal length; empty where there is no match."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for at in range(patterns.shape[1] - 1, -1, -1):
            symbols = patterns[live, at]
            fits = symbols < 1 << self.tree.bits
            symbols = np.where(fits, symbols, 0)
            low[live] = self.first[symbols] + self.tree.rank(symbols, low[live])
            high[live] = np.where(fits, self.first[symbols] + self.tree.rank(symbols, high[live]), low[live])
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array places: step back to a sampled one, then add the steps."""
        out, at, steps, open_ = np.zeros(len(places), np.int64), places.copy(), 0, np.arange(len(places))
        while len(open_):
            hit = self.marked[at]
            out[open_[hit]] = self.samples[self.mark_rank[at[hit]]] + steps
            open_, at = open_[~hit], at[~hit]
            symbols = self.tree.access(at)
            at = self.first[symbols] + self.tree.rank(symbols, at)
            steps += 1
        return out


class Windows:
    """The windows of a block of benchmark items, numbered by the block's own vocabulary."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text)]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if ids else 0):
                found.setdefault(size, {}).setdefault(tuple(ids[at : at + size]), set()).add(item)
        self.by_size = [(size, np.array(list(p), np.int64).reshape(len(p), size), list(p.values())) for size, p in sorted(found.items())]
        self.shortest = min(found, default=0)

    def symbols(self, text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """(symbols, word positions, words): 1 separates, benchmark words count from 2."""
        known = self.vocabulary.get
        ids = np.array([known(w, 1) for w in words_of(text)], np.int32)
        keep = ids > 1
        keep[1:] |= keep[:-1]  # the first unknown word after a known one separates
        at = np.flatnonzero(keep)
        return ids[at], at, len(ids)


def shard_hits(windows: Windows, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[int]]]:
    """For each text: its words, the merged word spans of the matches, the items that match."""
    parts, places, counts, starts, at = [], [], [], [], 0
    for text in texts:
        ids, where, n = windows.symbols(text)
        starts.append(at)
        counts.append(n)
        parts += [ids, np.ones(1, np.int32)]
        places += [where, np.full(1, -1)]
        at += len(ids) + 1
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    seq = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    if (seq > 1).any():
        # A run of known words shorter than the shortest window can't match and needs no place in the index.
        known = np.concatenate(([False], seq > 1, [False]))
        edge = np.flatnonzero(known[1:] != known[:-1])
        runs = [(a, b) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= windows.shortest]
        if runs:
            kept = np.concatenate([np.append(np.arange(a, b), b if b < len(seq) else a) for a, b in runs])
            ends = np.cumsum([b - a + 1 for a, b in runs]) - 1
            text = seq[kept].astype(np.int64)
            text[ends] = 1
            index, word = FMIndex(text), np.concatenate(places)
            held = np.zeros(len(windows.vocabulary) + 2, bool)
            held[text] = True
            for size, patterns, owners in windows.by_size:
                asked = np.flatnonzero(held[patterns].all(axis=1))
                low, high = index.ranges(patterns[asked])
                hit = np.flatnonzero(low < high)
                if not len(hit):
                    continue
                low, high, hit = low[hit], high[hit], asked[hit]
                counts_of = high - low
                rows = np.repeat(low - np.concatenate(([0], np.cumsum(counts_of)[:-1])), counts_of) + np.arange(counts_of.sum())
                found = kept[index.locate(rows)]
                docs = np.searchsorted(starts, found, side="right") - 1
                for doc, begin, which in zip(docs.tolist(), word[found].tolist(), np.repeat(hit, counts_of).tolist(), strict=True):
                    spans[doc].append((begin, begin + size))
                    items[doc] |= owners[which]
    return counts, [merged(s) for s in spans], items


def judged(windows: Windows, batches: Iterator[pa.RecordBatch], text_col: str = "_text") -> Iterator[tuple[pa.RecordBatch, tuple[list, list, list]]]:
    """Each batch with what ``shard_hits`` says of its rows; a shard takes texts of many batches, or a part of one."""
    waiting: list[pa.RecordBatch] = []
    texts: list[bytes] = []
    found: tuple[list, list, list] = ([], [], [])
    size = 0

    def close() -> None:
        nonlocal size
        for whole, part in zip(found, shard_hits(windows, texts), strict=True):
            whole.extend(part)
        texts.clear()
        size = 0

    def ready() -> Iterator[tuple[pa.RecordBatch, tuple[list, list, list]]]:
        while waiting and len(found[0]) >= waiting[0].num_rows:
            n = waiting[0].num_rows
            yield waiting.pop(0), tuple(f[:n] for f in found)
            for f in found:
                del f[:n]

    for batch in batches:
        waiting.append(batch)
        for text in binaries(batch.column(text_col)):
            texts.append(text)
            size += len(text) // 4
            if size >= SHARD_SYMBOLS:
                close()
        yield from ready()
    if texts:
        close()
    yield from ready()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((begin, end))
    return out


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, bytes]]]:
    """Items in blocks of a bounded number of words; only one block is on the driver at a time."""
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    block, words = [], 0
    for item, text in rows.toLocalIterator():
        data = text.encode()
        block.append((item, data))
        words += len(words_of(data))
        if words >= block_words:
            yield block
            block, words = [], 0
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, keep_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: _id, n_words, starts and ends (merged removal spans, in words), items.

    ``keep_text`` adds _text.  A benchmark of more than ``block_words`` words is taken block by block; the
    answers of the blocks so far travel with the rows, in the shared folder.
    """
    spark = tune(docs.sparkSession)
    out = docs.select(row_id(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.lit(0).cast("long").alias("n_words"),
                      *(F.array().cast("array<long>").alias(c) for c in ("starts", "ends", "items")))
    blocks = blocks_of(benchmark, item_col, item_text, block_words)
    block, first = next(blocks, []), True
    while block or first:
        after = next(blocks, [])
        if not first:
            out = scratch(out, "decontaminate")
        out, block, first = one_block(out, Windows(block, window), keep_text or bool(after)), after, False
    return out


def one_block(rows: DataFrame, windows: Windows, with_text: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(windows)  # bounded by the block's words
    schema = rows.schema if with_text else rows.drop("_text").schema

    @released
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (n_words, spans, items) in judged(shared.value, batches):
            old = [list(zip(a, b, strict=True)) for a, b in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)]
            spans = [merged(a + b) if a else b for a, b in zip(old, spans, strict=True)]
            items = [sorted(set(a) | b) for a, b in zip(batch.column("items").to_pylist(), items, strict=True)]
            longs = pa.list_(pa.int64())
            found = [pa.array(n_words, pa.int64()), *(pa.array([[s[k] for s in x] for x in spans], longs) for k in (0, 1)), pa.array(items, longs)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *([batch.column("_text")] if with_text else []), *found], names=schema.names)

    return rows.mapInArrow(search, schema)


def strip_spans(text: str, starts: list[int], ends: list[int]) -> str:
    """``text`` without the words of the spans and what stands between them."""
    import regex

    words = [m.span() for m in regex.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate(read_docs(spark, sf_dir), read_docs(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, b: a + b)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return hits.select(
        public_id().alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def items_digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


#: The same in DuckDB.
SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM bi),
di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k),
hits AS (SELECT doc_id, di.k, i, item_id FROM di JOIN windows b ON b.k = di.k AND b.s = array_to_string(w[i:i + di.k - 1], ' ')),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cover.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, coalesce(items.s, sha256('')) AS items_sha256, coalesce(cover.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""
