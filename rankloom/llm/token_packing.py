"""Token ids packed into rows of fixed length by best-fit decreasing.

Texts are encoded with a public byte-level BPE vocabulary.  A document of more than ``length`` tokens is cut into
pieces of ``length``, in order and without loss.  A task gathers pieces of a bounded number of tokens, takes them
from the longest to the shortest, and puts each into the row with the least room that it fits; a segment
tree over the rooms finds that row in logarithmic time.  The rows of a batch form one matrix of ids
(little-endian), padded at the end of each row; with each row come the cumulative lengths of its segments, the
places where positions begin again, and which piece of which document each segment is.

Nothing is shuffled, and documents are read once.  Which pieces share a row depends on how the input is dealt
to tasks; which tokens a document has does not.

Defined results: a null or empty text has no tokens and no segment; a null id is kept as null; repeated
rows are packed one by one; control strings in a text are ordinary text; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import public_id, read_docs, released, row_id, strings, tune

#: Tokens in a row, and tokens that are packed together.
LENGTH, BATCH_TOKENS = 2048, 1 << 20
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts were split into words: a fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    """Ids of a text."""

    def __init__(self, vocabulary: bytes) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pad = len(ranks)

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32)


class Rooms:
    """A segment tree over the rooms 0 to ``length``: how many rows have each room, and which."""

    def __init__(self, length: int) -> None:
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self.change(room, 1)

    def change(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes a row with the least room of at least ``need``: (room, row)."""
        count, at = self.count, need + self.size
        if not count[at]:
            while at > 1 and not (at % 2 == 0 and count[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        self.change(room, -1)
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """The pieces of each row; pieces are taken from the longest to the shortest, equal ones in order."""
    rooms, rows = Rooms(length), []
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = rooms.take(sizes[piece])
        if found is None:
            found = length, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(piece)
        if room > sizes[piece]:
            rooms.add(room - sizes[piece], row)
    return rows


PACKED = "ids binary, n_tokens int, cu_lengths array<int>, resets array<int>, segments array<struct<doc_id:long,piece:int,n:int>>"


def pack_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """One row for each packed row: ids (``length`` of them, 16 bits each, or 32 for a large vocabulary), cu_lengths, resets, segments."""
    spark = tune(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())  # a file of fixed size; executors needn't have it

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(shared.value)
        kind = np.uint16 if tokenizer.pad < 1 << 16 else np.int32
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = best_fit([len(p[2]) for p in pieces], length)
            matrix = np.full((len(rows), length), tokenizer.pad, kind)
            lengths, segments = [], []
            for at, row in enumerate(rows):
                parts = [pieces[i] for i in row]
                ids = np.concatenate([p[2] for p in parts])
                matrix[at, : len(ids)] = ids
                lengths.append([0, *np.cumsum([len(p[2]) for p in parts]).tolist()])
                segments.append([{"doc_id": p[0], "piece": p[1], "n": len(p[2])} for p in parts])
            struct = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("n", pa.int32())])
            ints = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([m.tobytes() for m in matrix], pa.binary()), pa.array([x[-1] for x in lengths], pa.int32()), pa.array(lengths, ints), pa.array([x[:-1] for x in lengths], ints),
                                               pa.array(segments, pa.list_(struct))], names=["ids", "n_tokens", "cu_lengths", "resets", "segments"])

        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), strings(batch.column("_text")), strict=True):
                ids = tokenizer.encode(text)
                for piece, lo in enumerate(range(0, len(ids), length)):
                    pieces.append((doc, piece, ids[lo : lo + length]))
                    size += len(pieces[-1][2])
                if size >= batch_tokens:
                    yield flush()
                    pieces, size = [], 0
        if pieces:
            yield flush()

    rows = docs.select(row_id(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.select(public_id().alias("doc"), "_text").mapInArrow(run, PACKED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(read_docs(spark, sf_dir))
