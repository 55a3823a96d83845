"""SentencePiece encoding and decoding by a relational lattice.

A text gets a blank in front, and is cut into units: blanks with the letters, or with the other characters, that follow,
and line feeds.  No piece of the vocabulary reaches over such a border (this is checked), so the best segmentation
of a text is that of its units.
Each distinct unit is encoded once, in DataFrame operations only: all its substrings of up to the longest piece's
length are exploded, joined with the piece table on the piece, grouped by unit as edges of a lattice, and folded
by a Viterbi pass over the edges (higher-order ``aggregate``): the path with the largest sum of piece
scores wins; of equal sums the one whose last differing piece is the longest.  A character without piece goes
as its UTF-8 bytes.  A unit of more than ``MAX_UNIT`` characters (a rule of dashes, a run of letters) isn't a row of
these tables, as the fold copies its array of places at each step: it is encoded whole where its document is read, by the
same Viterbi pass in time linear in its length.

The vocabulary is a public one and is not trained here.  Its own encoder merges pairs greedily; this operator
maximises the score instead, so ids may differ from that encoder's, and decoding gives the text back exactly.

The encoded units are looked up in two ways.  The ``TABLE`` most frequent ones (of all units' counts) are broadcast
as packed arrays of bounded size, and documents made of these only are encoded where they are read.  For the other
documents the remaining units are joined by shuffle.  Workers tell units by 64-bit hashes of their characters, computed
over arrays of code points; no string is made for a unit that isn't new.

Defined results: a null or empty text has no pieces and decodes to the empty text; a null id is kept as null;
repeated rows are encoded one by one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_scratch, partitions, public_id, read_docs, released, row_id, scratch, strings, tune
from .kernels import BASE, INVERSE, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a unit of the tables, units that are broadcast (about 24 bytes each).
MAX_UNIT, TABLE = 512, 1 << 22
#: Distinct units of one partition of the lattice, some 25 edges each of which are sorted together; and how many times the
#: session's partitions there may be.
EACH, SPREAD = 1 << 13, 16
#: Characters that are hashed at a time; units and characters that a task counts at a time.
BLOCK, COUNTED, READ = 1 << 16, 1 << 19, 1 << 23
#: Score of a byte piece that stands for a part of a character without piece.
BYTE_SCORE = -1e6

_UNIT = regex.compile(r" *[\p{L}\p{M}]+| *[^ \n\p{L}\p{M}]+| +|\n")
OTHER, LETTER, BLANK, FEED = range(4)


def units(text: str) -> list[str]:
    """The units of a text, in order; together they are a blank and the text."""
    return _UNIT.findall(f" {text}") if text else []


@cache
def kinds() -> np.ndarray:
    """The kind of each code point."""
    out = np.zeros(0x110000, np.uint8)
    for found in regex.finditer(r"[\p{L}\p{M}]+", "".join(map(chr, range(0x110000)))):
        out[found.start() : found.end()] = LETTER
    out[ord(" ")], out[ord("\n")] = BLANK, FEED
    return out


@cache
def values() -> np.ndarray:
    """A 64-bit value for each code point of the basic plane."""
    return mix(np.arange(1, 0x10001, dtype=np.uint64) * BASE)


def values_of(code: np.ndarray) -> np.ndarray:
    if len(code) and int(code.max()) > 0xFFFF:
        return mix((code.astype(np.uint64) + np.uint64(1)) * BASE)
    return values()[code]


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    up, down = (np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64)))) for b in (BASE, INVERSE))
    return up, down


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashes_between(code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(max(BLOCK, 1 << len(code).bit_length()))
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(values_of(code) * up[: len(code)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin])


def hash_units(found: list[str]) -> np.ndarray:
    ends = np.cumsum([len(u) for u in found], dtype=np.int64)
    return hashes_between(codes("".join(found)), np.append(0, ends[:-1]), ends) if found else np.zeros(0, np.uint64)


def unit_spans(joined: str, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, begins, ends) of the units of ``joined``, block by block; at each of ``starts`` a text begins."""
    at, size = 0, BLOCK
    while at < len(joined):
        stop = min(len(joined), at + size)
        code = codes(joined[at:stop])
        kind = kinds()[code]
        fresh = np.ones(len(code), bool)
        fresh[1:] = (kind[1:] != kind[:-1]) & ((kind[:-1] != BLANK) | (kind[1:] == FEED)) | (kind[1:] == FEED)
        fresh[starts[np.searchsorted(starts, at) : np.searchsorted(starts, stop)] - at] = True
        begin = np.flatnonzero(fresh)
        if stop == len(joined):
            end = np.append(begin[1:], len(code))
        elif len(begin) > 1:  # the last unit may go on
            begin, end = begin[:-1], begin[1:]
        else:
            size *= 2
            continue
        yield hashes_between(code[: end[-1]], begin, end), begin + at, end + at
        at, size = at + int(end[-1]), BLOCK


def join_texts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """(texts that aren't empty, each after a blank; where these begin; their numbers)."""
    of = np.array([k for k, t in enumerate(texts) if t], np.int64)
    sizes = np.array([len(texts[k]) + 1 for k in of.tolist()], np.int64)
    return "".join([f" {t}" for t in texts if t]), np.cumsum(sizes) - sizes, of


class Pieces:
    """The vocabulary: (piece with blanks, id, score) of all ordinary pieces, and the ids of bytes."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.text: list[bytes] = []
        self.rows: list[tuple[str, int, float]] = []
        self.of_byte = [sp.unk_id()] * 256
        for i in range(sp.vocab_size()):
            piece, score = sp.id_to_piece(i), sp.get_score(i)
            if sp.is_byte(i):
                self.of_byte[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
            else:
                plain = piece.replace("▁", " ")
                self.text.append(plain.encode())
                # a symbol defined by the user has no score of its own
                self.rows.append((plain, i, score if score > -1e8 else 0.0))
        bad = [p for p, _, _ in self.rows if len(_UNIT.findall(p)) > 1]
        if bad:
            raise ValueError(f"pieces that reach over a unit's border: {bad[:5]}")
        self.longest = max(len(p) for p, _, _ in self.rows)

    @cached_property
    def best(self) -> dict[str, tuple[int, float]]:
        """The id and score of each piece."""
        out: dict[str, tuple[int, float]] = {}
        for piece, i, score in self.rows:
            if piece not in out or score > out[piece][1]:
                out[piece] = i, score
        return out

    def encode(self, unit: str) -> np.ndarray:
        """The ids of a long unit; the same path as that of ``lattice``."""
        best, n = self.best, len(unit)
        value, begin, last = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for e in range(1, n + 1):
            top = None
            for s in range(max(0, e - self.longest), e):
                found = best.get(unit[s:e])
                if found is None:
                    if e - s > 1:
                        continue
                    found = -1 - ord(unit[s]), BYTE_SCORE * len(unit[s].encode())
                if top is None or value[s] + found[1] > top:
                    top = value[e] = value[s] + found[1]
                    begin[e], last[e] = s, found[0]
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = begin[at]
        return np.array([i for x in reversed(ids) for i in ([x] if x >= 0 else [self.of_byte[b] for b in chr(-1 - x).encode()])], np.int32)

    def decode(self, ids: np.ndarray) -> str:
        text = self.text
        return b"".join([text[i] for i in ids.tolist()]).decode("utf-8", "replace")[1:]

    @cached_property
    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the bytes of all pieces, where each begins, how many it has)."""
        size = np.array([len(t) for t in self.text], np.int64)
        return np.frombuffer(b"".join(self.text), np.uint8), np.cumsum(size) - size, size

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the texts of these ids, number of bytes of each text); each text loses the blank in front."""
        data, begin, size = self.flat
        first = (np.cumsum(counts) - counts)[counts > 0]
        begin, size = begin[ids], size[ids]
        begin[first] += 1
        size[first] -= 1
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))]
        parts = [gather(data, begin[lo : lo + BLOCK], size[lo : lo + BLOCK]) for lo in range(0, len(ids), BLOCK)]
        return np.concatenate([np.zeros(0, np.uint8), *parts]), np.diff(ends)


def lattice(distinct: DataFrame, pieces: Pieces) -> DataFrame:
    """``distinct`` (unit, other columns) with ids: array<int>, a negative number -1 - c for a character c without piece."""
    spark = distinct.sparkSession
    table = F.broadcast(spark.createDataFrame(pieces.rows, "piece string, id int, score double"))  # a vocabulary of fixed size
    # two plain explosions: the ends of substrings, then their begins
    ends = distinct.select("unit", F.explode(F.expr("sequence(1, length(unit))")).alias("e"))
    both = ends.select("unit", "e", F.explode(F.expr(f"sequence(greatest(0, e - {pieces.longest}), e - 1)")).alias("s"))
    met = both.select("unit", "s", "e", F.expr("substring(unit, s + 1, e - s)").alias("piece")).join(table, "piece", "left").where("id IS NOT NULL OR e - s = 1")
    edge = F.struct("e", "s", F.coalesce(F.col("id"), -1 - F.ascii("piece")).alias("id"), F.coalesce("score", F.lit(BYTE_SCORE) * F.octet_length("piece")).alias("score"))
    grouped = met.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    # one entry for each place that is done: its best score, where its last piece begins, which piece it is
    fold = """aggregate(edges, struct(array(struct(0D AS v, -1 AS s, -1 AS id)) AS done, 0 AS e, 0D AS v, 0 AS s, 0 AS id),
      (a, x) -> if(x.e = a.e,
        if(a.done[x.s].v + x.score > a.v, struct(a.done AS done, a.e AS e, a.done[x.s].v + x.score AS v, x.s AS s, x.id AS id), a),
        if(a.e = 0, struct(a.done AS done, x.e AS e, a.done[x.s].v + x.score AS v, x.s AS s, x.id AS id),
          struct(concat(a.done, array(struct(a.v AS v, a.s AS s, a.id AS id))) AS done, x.e AS e, if(x.s = a.e, a.v, a.done[x.s].v) + x.score AS v, x.s AS s, x.id AS id))),
      a -> concat(a.done, array(struct(a.v AS v, a.s AS s, a.id AS id))))"""
    back = """aggregate(sequence(size(best) - 1, 1), struct(size(best) - 1 AS p, CAST(array() AS array<int>) AS ids),
      (a, i) -> if(a.p = i, struct(best[i].s AS p, concat(array(best[i].id), a.ids) AS ids), a), a -> a.ids)"""
    return grouped.select("unit", F.expr(fold).alias("best")).select("unit", F.expr(back).alias("ids"))


@released
def count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []  # hashes, counts, text, begin, end of one place
    texts: list[str] = []

    def rows() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        _, first, of = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
        n = np.bincount(of, np.concatenate([h[1] for h in held])).astype(np.int64)
        where = [np.concatenate([h[k] for h in held])[first] for k in (2, 3, 4)]
        for lo in range(0, len(first), 1 << 14):
            part = [texts[t][a:b] for t, a, b in zip(*(w[lo : lo + (1 << 14)].tolist() for w in where), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(n[lo : lo + (1 << 14)])], names=["unit", "n"])

    for batch in batches:
        joined, starts, _ = join_texts(strings(batch.column("_text")))
        for hashes, begin, end in unit_spans(joined, starts):
            short = end - begin <= MAX_UNIT
            found, first, n = np.unique(hashes[short], return_index=True, return_counts=True)
            held.append((found, n, np.full(len(found), len(texts), np.int32), begin[short][first], end[short][first]))
        texts.append(joined)
        if sum(len(h[0]) for h in held) > COUNTED or sum(map(len, texts)) > READ:
            yield from rows()
            held.clear()
            texts.clear()
    yield from rows()


def encoded_units(rows: DataFrame, pieces: Pieces) -> tuple[DataFrame, DataFrame, int]:
    """(unit, n) and (unit, ids) of all distinct units that aren't long, in the shared folder; their number."""
    counts = scratch(rows.select("_text").mapInArrow(count_units, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")), "units")
    total, parts = counts.count(), partitions(rows.sparkSession)
    spread = counts.select("unit").repartition(max(parts, min(total // EACH, SPREAD * parts)), "unit")  # kept by the explosions and the grouping
    return counts, scratch(lattice(spread, pieces), "encoded-units"), total


def packed(pieces: Pieces):
    """Encoded units as blobs (hashes, sizes, ids) of many units each."""
    kind = np.uint16 if len(pieces.text) < 1 << 16 else np.int32

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            hashes, sizes, ids = (np.concatenate([p[k] for p in parts]) for k in range(3))
            return pa.RecordBatch.from_arrays([pa.array([hashes.tobytes()], pa.binary()), pa.array([sizes.astype(np.uint16).tobytes()], pa.binary()), pa.array([ids.astype(kind).tobytes()], pa.binary())], names=["hashes", "sizes", "ids"])

        for batch in batches:
            if batch.num_rows:
                parts.append((hash_units(batch.column("unit").to_pylist()), *expand(batch.column("ids"), pieces)))
            if len(parts) >= 256:
                yield flush()
                parts = []
        if parts:
            yield flush()

    return run


#: Begins the packed table inside the file of its broadcast.
MARK = b"rankloom units 1"


def padding() -> int:
    """Bytes after mark and lengths, so that the arrays lie at multiples of 8 in a file of the pickled table."""
    return -(pickle.dumps(bytes(1 << 20), pickle.HIGHEST_PROTOCOL).index(bytes(64)) + len(MARK) + 24) % 8


class Table:
    """Encoded units as packed arrays: sorted hashes, offsets, sizes, ids."""

    def __init__(self, hashes: np.ndarray, begins: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.hashes, self.begins, self.sizes, self.ids = hashes, begins, sizes, ids

    @staticmethod
    def collect(encoded: DataFrame, pieces: Pieces) -> Table:
        kind = np.uint16 if len(pieces.text) < 1 << 16 else np.int32
        rows = encoded.select("unit", "ids").mapInArrow(packed(pieces), "hashes binary, sizes binary, ids binary").toArrow()
        join = lambda name, of: np.concatenate([np.zeros(0, of), *(np.frombuffer(b.as_buffer(), of) for b in rows[name])])
        hashes, size, flat = join("hashes", np.uint64), join("sizes", np.uint16), join("ids", kind)
        del rows
        begin = np.cumsum(size, dtype=np.int32) - size
        order = np.argsort(hashes)
        return Table(hashes[order], begin[order].astype(np.int32), size[order], flat)  # ids stay in place; an entry knows where its own begin

    def payload(self) -> bytes:
        head = np.array([len(self.hashes), len(self.ids), self.ids.itemsize], "<i8").tobytes()
        return b"".join([MARK, head, bytes(padding()), *(x.tobytes() for x in (self.hashes, self.begins, self.ids, self.sizes))])

    @staticmethod
    def view(data: np.ndarray, pad: int) -> Table:
        n, m, width = np.frombuffer(data[len(MARK) : len(MARK) + 24].tobytes(), "<i8").tolist()
        at, out = len(MARK) + 24 + pad, []
        for count, kind in ((n, np.uint64), (n, np.int32), (m, np.uint16 if width == 2 else np.int32), (n, np.uint16)):
            part = data[at : at + count * np.dtype(kind).itemsize]
            out.append(part.view(kind) if part.ctypes.data % np.dtype(kind).itemsize == 0 else np.frombuffer(part.tobytes(), kind))
            at += len(part)
        return Table(out[0], out[1], out[3], out[2])

    @staticmethod
    def opened(shared: Broadcast, pad: int) -> Table:
        """From the local file of the broadcast, which all workers of an executor map; from its value where there is none."""
        if path := getattr(shared, "_path", None):
            data = np.memmap(path, np.uint8, "r")
            if (at := data[:4096].tobytes().find(MARK)) >= 0:
                return Table.view(data[at:], pad)
        return Table.view(np.frombuffer(shared.value, np.uint8), pad)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of these hashes in the table, -1 for units that aren't there."""
        at = np.searchsorted(self.hashes, wanted)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == wanted, at, -1) if len(self.hashes) else np.full(len(wanted), -1)

    def given(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each of these places, all their ids)."""
        size = self.sizes[at].astype(np.int64)
        return size, gather(self.ids, self.begins[at], size)


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``flat[begin : begin + size]`` of all, after each other."""
    ends = np.cumsum(size)
    return flat[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def look_up(texts: list[str], table: Table, pieces: Pieces, extra: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
    """(ids of all texts, number of ids of each text, units of texts that are neither in the table, in ``extra`` nor long)."""
    joined, starts, of = join_texts(texts)
    counts, out, lacking = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)], {}
    for hashes, begin, end in unit_spans(joined, starts):
        found, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = table.find(found)
        hit, rest = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        sizes, pool = np.zeros(len(found), np.int64), []
        sizes[hit], flat = table.given(at[hit])
        begins = np.zeros(len(found), np.int64)
        begins[hit] = np.cumsum(sizes[hit]) - sizes[hit]
        held = len(flat)
        for k in rest.tolist():
            ids = extra.get(int(found[k]))
            if ids is None and end[first[k]] - begin[first[k]] > MAX_UNIT:
                ids = pieces.encode(joined[begin[first[k]] : end[first[k]]])
            if ids is not None:
                begins[k], sizes[k] = held, len(ids)
                pool.append(ids)
                held += len(ids)
        size = sizes[which]
        out.append(gather(np.concatenate([flat.astype(np.int32), *pool]), begins[which], size))
        text = of[np.searchsorted(starts, begin, side="right") - 1]
        counts += np.bincount(text, size, len(texts)).astype(np.int64)
        for k in np.flatnonzero(size == 0).tolist():
            lacking.setdefault(int(text[k]), set()).add(joined[begin[k] : end[k]])
    return np.concatenate(out), counts, lacking


def expand(column: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids of each list, all ids), characters without piece as bytes."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(column.offsets.to_numpy()).astype(np.int64)
    if (flat < 0).any():
        lists = [[i for x in ids for i in ([x] if x >= 0 else [pieces.of_byte[b] for b in chr(-1 - x).encode("utf-8", "replace")])] for ids in column.to_pylist()]
        size, flat = np.array([len(x) for x in lists], np.int64), np.array([i for x in lists for i in x], np.int32)
    return size, flat


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, table: int = TABLE, decoded: bool = True) -> DataFrame:
    """Every row of ``docs`` as (_id, ids: binary of 32-bit ids, n_pieces) and, if asked for, decoded: the text of the ids."""
    spark = tune(docs.sparkSession)
    pieces = Pieces(model)
    rows = docs.select(row_id(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    counts, encoded, total = encoded_units(rows, pieces)
    if total <= table:
        chosen, rest = encoded, None
    else:
        least = counts.orderBy(F.desc("n"), "unit").select("unit", "n").offset(table - 1).limit(1).first()
        often = counts.where((F.col("n") > least["n"]) | ((F.col("n") == least["n"]) & (F.col("unit") <= least["unit"]))).select("unit")
        chosen, rest = encoded.join(often, "unit", "left_semi"), encoded.join(often, "unit", "left_anti")
    payload = Table.collect(chosen, pieces).payload()  # ``table`` units at most
    pad = padding()
    packed_units, vocabulary = spark.sparkContext.broadcast(payload), spark.sparkContext.broadcast(pieces)
    del payload
    kind = "_id long, ids binary, n_pieces long" + ", decoded string" * decoded

    def result(doc: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        columns = [doc, binary(ids.astype("<i4").view(np.uint8), 4 * counts), pa.array(counts)]
        if decoded:
            columns.append(binary(*vocabulary.value.decode_all(ids, counts)).cast(pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=["_id", "ids", "n_pieces", "decoded"][: len(columns)])

    @released
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Table.opened(packed_units, pad), vocabulary.value
        for batch in batches:
            ids, counts, lacking = look_up(strings(batch.column("_text")), *known, {})
            keep = np.ones(len(counts), bool)
            keep[list(lacking)] = False
            yield result(batch.column("_id").filter(pa.array(keep)), ids[np.repeat(keep, counts)] if lacking else ids, counts[keep])

    @released
    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the other documents (id, text, units that aren't in the table)."""
        known = Table.opened(packed_units, pad), vocabulary.value
        for batch in batches:
            _, _, lacking = look_up(strings(batch.column("_text")), *known, {})
            take = pa.array(sorted(lacking), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(take), batch.column("_text").take(take), pa.array([sorted(lacking[k]) for k in sorted(lacking)], pa.list_(pa.string()))], names=["_id", "_text", "missing"])

    done = rows.mapInArrow(whole, kind)
    if rest is None:
        drop_scratch(counts, encoded)
        return done

    @released
    def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary.value
        known = Table.opened(packed_units, pad), own
        for batch in batches:
            more = {m["unit"]: m["ids"] for row in batch.column("more").to_pylist() for m in row}
            given = [expand(pa.array([ids], pa.list_(pa.int32())), own)[1].astype(np.int32) for ids in more.values()]
            ids, counts, _ = look_up(strings(batch.column("_text")), *known, dict(zip(hash_units(list(more)).tolist(), given, strict=True)))
            yield result(batch.column("_id"), ids, counts)

    left = scratch(rows.mapInArrow(others, "_id long, _text string, missing array<string>").withColumn("_key", F.xxhash64("_text")), "other-documents")
    asked = left.select("_id", "_key", F.explode("missing").alias("unit")).distinct()
    given = asked.join(rest, "unit").groupBy("_id", "_key").agg(F.collect_list(F.struct("unit", "ids")).alias("more"))
    return done.unionByName(left.select("_id", "_key", "_text").join(given, ["_id", "_key"]).select("_id", "_text", "more").mapInArrow(mended, kind))


def binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values that follow each other in ``data``."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_docs(spark, sf_dir)).select(public_id().alias("doc_id"), "n_pieces", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def digest(ids: list[int]) -> str:
    return hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
