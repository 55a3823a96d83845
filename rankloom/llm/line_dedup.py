"""Line dedup by range-partitioned hashes.

Every line's key (the line with ``[\\x20\\x09-\\x0D]`` stripped and A-Z lower-cased) is hashed to 128 bits
where the document is read.  The rows (hash, document, position) are range-partitioned on all three
columns and sorted inside the partitions, so a very frequent line spreads over several partitions.  One
streaming pass then knows, for every hash that lies inside one partition, its first occurrence and the
number of its documents.  Only the first and the last hash of a partition may go on in a neighbour;
their counts, two rows for each partition, are put together on the driver and settle the rows left open.
What comes back is one compressed bitmap of kept lines for each document that loses any; text is never
shuffled for the decision.

Two modes: ``first`` keeps the first occurrence (smallest document id, then position) of each key;
``frequent`` drops every line whose key stands in at least ``min_docs`` documents.

Defined results: null or empty text is one empty line; keys of fewer than ``min_chars`` code points are
always kept; a null document id counts as one document, repeated ids as one document; rows that repeat
id and text get the same bitmap; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, drop_scratch, keyed, partitions, public_id, read_docs, released, scratch, tune

#: Documents from which on a key counts as frequent.
MIN_DOCS = 10
#: Code points that a key has at least.
MIN_CHARS = 1

FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = b" \t\n\x0b\x0c\r"
HASHES = "h1 long, h2 long, _id long, _key long, pos int"
MARKS = "kind int, h1 long, h2 long, _id long, _key long, pos int, part int, n_docs long, last_id long"
#: Kinds of marks: a dropped line, a line that the neighbours settle, the sum of a partition's first or last hash.
DROP, OPEN, EDGE = 0, 1, 2


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip(SPACE) for line in text.translate(FOLD).split(b"\n")]


def hash_lines(min_chars: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, rows, places = [], [], []
            for row, text in enumerate(binaries(batch.column("_text"))):
                for pos, key in enumerate(line_keys(text)):
                    if key and (min_chars <= 1 or len(key.decode()) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        rows.append(row)
                        places.append(pos)
            h = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            at = np.array(rows, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column("_id").take(pa.array(at)), batch.column("_key").take(pa.array(at)), pa.array(places, pa.int32())],
                names=["h1", "h2", "_id", "_key", "pos"])

    return run


def stream_marks(mode: str, min_docs: int):
    """Reads a partition in order of (hash, document, position); holds the hash that is still open, at most.

    Of an open hash in ``frequent`` mode only its first ``min_docs`` documents' rows must wait: beyond them
    it is known to be frequent and its rows pass through.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = [x.split()[0] for x in MARKS.split(", ")]

        def rows(kind, c, open_hash) -> pa.RecordBatch:
            n = len(c[0])
            fill = lambda t: pa.nulls(n, t)
            keep = [pa.array(c[0]), pa.array(c[1])] if open_hash else [fill(pa.int64())] * 2
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *keep, pa.array(c[2]), pa.array(c[3]), pa.array(c[4].astype(np.int32)),
                                               pa.array(np.full(n, part, np.int32)), fill(pa.int64()), fill(pa.int64())], names=names)

        def edge(h, n_docs, first, last) -> pa.RecordBatch:
            one = lambda v, t: pa.array([v], t)
            return pa.RecordBatch.from_arrays([one(EDGE, pa.int32()), one(h[0], pa.int64()), one(h[1], pa.int64()), one(first, pa.int64()), one(None, pa.int64()), one(None, pa.int32()),
                                               one(part, pa.int32()), one(n_docs, pa.int64()), one(last, pa.int64())], names=names)

        current, n_docs, first_id, last_id, waiting, edges = None, 0, 0, 0, [], 0
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            n = len(cols[0])
            if not n:
                continue
            cut = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            begins, ends = np.append(0, cut), np.append(cut, n)
            new_doc = np.append(True, (cols[2][1:] != cols[2][:-1])).astype(np.int64)
            new_doc[begins] = 1
            docs_in = np.add.reduceat(new_doc, begins)
            # Runs that lie inside the batch are settled at once; the first may continue, the last may go on.
            inner = np.ones(len(begins), bool)
            inner[[0, -1]] = False
            if mode == "frequent":
                chosen = np.repeat(inner & (docs_in >= min_docs), ends - begins)
            else:
                chosen = np.repeat(inner, ends - begins)
                chosen[begins] = False
            if chosen.any():
                yield rows(DROP, [c[chosen] for c in cols], False)
            for at in dict.fromkeys((0, len(begins) - 1)):
                a, b = int(begins[at]), int(ends[at])
                piece, h = [c[a:b] for c in cols], (int(cols[0][a]), int(cols[1][a]))
                if h != current:
                    if current is not None:  # the run before is over; only a partition's first one may have begun elsewhere
                        if edges == 0:
                            yield edge(current, n_docs, first_id, last_id)
                            for w in waiting:
                                yield rows(OPEN, w, True)
                        else:
                            yield from settled(mode, min_docs, n_docs, waiting, rows)
                        edges += 1
                    current, n_docs, first_id, waiting = h, 0, int(piece[2][0]), []
                    last_id = None
                n_docs += int(docs_in[at]) - (last_id == int(piece[2][0]))
                last_id = int(piece[2][-1])
                waiting.append(piece)
                known = n_docs >= min_docs if mode == "frequent" else True
                if known and edges > 0:
                    yield from settled(mode, min_docs, n_docs, waiting, rows)
                    waiting = [[c[:1] for c in waiting[0]]] if mode == "first" else []
                elif edges == 0:
                    for w in waiting:
                        yield rows(OPEN, w, True)
                    waiting = []
        if current is not None:
            yield edge(current, n_docs, first_id, last_id)
            for w in waiting:
                yield rows(OPEN, w, True)

    return run


def settled(mode, min_docs, n_docs, waiting, rows):
    """The dropped rows of a run that began in this partition."""
    if mode == "frequent":
        if n_docs >= min_docs:
            for w in waiting:
                yield rows(DROP, w, False)
    elif waiting:  # the first row stays, and waits on in case a neighbour asks for it
        for w in [[c[1:] for c in waiting[0]], *waiting[1:]]:
            if len(w[0]):
                yield rows(DROP, w, False)


def edge_verdicts(edges: list, mode: str, min_docs: int) -> dict[tuple[int, int], tuple[int, int]]:
    """For each hash at a partition's edge: its documents, and the partition that has its first occurrence."""
    out: dict[tuple[int, int], list[int]] = {}
    for e in sorted(edges, key=lambda e: (e["h1"], e["h2"], e["part"])):
        seen = out.get((e["h1"], e["h2"]))
        if seen is None:
            out[e["h1"], e["h2"]] = [e["n_docs"], e["part"], e["last_id"]]
        else:
            seen[0] += e["n_docs"] - (seen[2] == e["_id"])
            seen[2] = e["last_id"]
    return {h: (n, part) for h, (n, part, _) in out.items()}


def dropped_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mode: str = "frequent", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_id, _key, pos) of every line that goes."""
    if mode not in ("frequent", "first"):
        raise ValueError(f"unknown mode {mode}")
    spark = tune(docs.sparkSession)
    names = ["h1", "h2", "_id", "pos"]
    # repeatedly read by the range partitioner, so it is written once
    hashes = scratch(keyed(docs, id_col, text_col).mapInArrow(hash_lines(min_chars), HASHES), "line-hashes")
    sorted_ = hashes.select("h1", "h2", "_id", "_key", "pos").repartitionByRange(partitions(spark), *names).sortWithinPartitions(*names, "_key")
    marks = scratch(sorted_.mapInArrow(stream_marks(mode, min_docs), MARKS), "line-marks")
    drop_scratch(hashes)
    edges = marks.where(F.col("kind") == EDGE).select("h1", "h2", "_id", "part", "n_docs", "last_id").collect()  # two for each partition at most
    verdicts = edge_verdicts(edges, mode, min_docs)
    gone = marks.where(F.col("kind") == DROP).select("_id", "_key", "pos")
    open_ = marks.where(F.col("kind") == OPEN)
    if mode == "frequent":
        rows = [h for h, (n, _) in verdicts.items() if n >= min_docs]
        more = open_.join(F.broadcast(spark.createDataFrame(rows, "h1 long, h2 long")), ["h1", "h2"], "left_semi")
    else:
        # of an edge hash all rows go but the first of its first partition
        firsts = open_.groupBy("h1", "h2").agg(F.min(F.struct("_id", "pos", "_key")).alias("f"))
        more = open_.join(firsts, ["h1", "h2"]).where((F.col("_id") != F.col("f._id")) | (F.col("pos") != F.col("f.pos")) | (F.col("_key") != F.col("f._key")))
    return gone.unionByName(more.select("_id", "_key", "pos"))


def encode_bitmap(n_lines: int, dropped: list[int]) -> bytes:
    keep = np.ones(n_lines, np.uint8)
    keep[dropped] = 0
    return n_lines.to_bytes(4, "little") + zlib.compress(np.packbits(keep).tobytes(), 1)


def decode_bitmap(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return np.unpackbits(np.frombuffer(zlib.decompress(data[4:]), np.uint8), count=n).astype(bool)


def keep_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """(_id, _key, bitmap) of each document that loses lines; the bitmap covers its lines up to the last one dropped."""

    @released
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [encode_bitmap(max(p) + 1, p) for p in batch.column("gone").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_key"), pa.array(maps, pa.binary())], names=["_id", "_key", "bitmap"])

    gone = dropped_lines(docs, **options).groupBy("_id", "_key").agg(F.collect_set("pos").alias("gone"))
    return gone.mapInArrow(encode, "_id long, _key long, bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as (_id, _key, _text, kept text, n_lines, n_dropped)."""

    @released
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, bitmap in zip(binaries(batch.column("_text")), batch.column("bitmap").to_pylist(), strict=True):
                if bitmap is None:
                    texts.append(text)
                    n_lines.append(text.count(b"\n") + 1)
                    n_dropped.append(0)
                else:
                    lines, keep = text.split(b"\n"), decode_bitmap(bitmap)
                    texts.append(b"\n".join([x for x, k in zip(lines, keep, strict=False) if k] + lines[len(keep) :]))
                    n_lines.append(len(lines))
                    n_dropped.append(int(len(keep) - keep.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_key"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=["_id", "_key", "kept", "n_lines", "n_dropped"])

    joined = keyed(docs, id_col, text_col).join(bitmaps, ["_id", "_key"], "left").select("_id", "_key", "_text", "bitmap")
    return joined.mapInArrow(kept, "_id long, _key long, kept string, n_lines long, n_dropped long")


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mode: str = "frequent", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every row of ``docs`` as (_id, _key, kept, n_lines, n_dropped)."""
    bitmaps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, mode=mode, min_docs=min_docs, min_chars=min_chars)
    return apply_bitmaps(docs, bitmaps, id_col=id_col, text_col=text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup(read_docs(spark, sf_dir))
    return rows.select(public_id().alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


#: The same in DuckDB.
SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM docs),
keys AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k FROM keys WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k IN (FROM frequent)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (k NOT IN (FROM frequent)), '')) AS kept_sha256
FROM keys GROUP BY doc_id
"""
