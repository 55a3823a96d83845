"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the n-grams (``ORDERS`` code points) that it holds at least once after lower-casing and
with one blank for all that stands between words, hashed to ``2 ** BITS`` numbers.  From labelled texts each feature gets the log ratio of its smoothed shares in
toxic and other texts; the ``FEATURES`` features that tell the classes apart best are kept, scaled by that
ratio, and a logistic regression with an L2 penalty is fitted on them in numpy, in which both classes weigh the same
(toxic texts are few).  A score is its probability.

Training draws at most about ``max_train`` labelled rows, those with the smallest hashes of their id; their
counts are summed by slices of the feature numbers.  Scoring reads every code point of every text and
shuffles nothing.

Defined results: null and empty texts hold no n-gram and get the prior; a null label, and a label without
document, is left out; of repeated labels the largest holds; a null id hashes as the empty text does; with
labels of one class only, or none, every score is that class, or 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import public_id, read_docs, released, row_id, strings, tune
from .kernels import PLACE
from .language_id import held_out

#: Code points of an n-gram, and bits of a feature's number.
ORDERS, BITS = (3, 4, 5, 6, 7), 20
#: Labelled rows that are learned from, about; features that are kept; texts that hold a kept feature at least.
MAX_TRAIN, FEATURES, MIN_TEXTS = 6000, 4096, 3
#: Slices of the feature numbers when counts are summed, and tasks that count.
SLICES, TASKS = 16, 8
#: Passes, rows of a step, step size and penalty of the regression.
EPOCHS, BATCH, RATE, PENALTY, SEED = 12, 128, 0.3, 1e-4, 5
#: Code points that are hashed at a time.
PIECE = 1 << 18


def normal(points: np.ndarray) -> np.ndarray:
    """White space and ASCII that is neither letter nor digit as blanks, runs of blanks as one, one at the begin."""
    points = np.append(np.uint32(32), points)
    points[(points < 48) | (points > 57) & (points < 97) | (points > 122) & (points < 0xAA)] = 32
    blank = points == 32
    return points[~(blank & np.append(False, blank[:-1]))]


def pieces(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, code points, ends of the texts in them); a long text comes in pieces that overlap."""
    overlap = max(ORDERS) - 1
    held: list[np.ndarray] = []
    first, size = 0, 0
    for at, text in enumerate(texts):
        points = normal(np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32))
        while len(points) > PIECE + overlap:
            if held:
                yield first, np.concatenate(held), np.cumsum([len(h) for h in held])
                held, size = [], 0
            yield at, points[: PIECE + overlap], np.array([PIECE + overlap])
            points, first = points[PIECE:], at
        if not held:
            first = at
        held.append(points)
        size += len(points)
        if size >= PIECE:
            yield first, np.concatenate(held), np.cumsum([len(h) for h in held])
            held, size = [], 0
    if held:
        yield first, np.concatenate(held), np.cumsum([len(h) for h in held])


def grams(points: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order (text number, feature number) of all n-grams that lie inside one text."""
    n = len(points)
    wide = points.astype(np.uint64)
    left = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(n)  # code points up to the text's end
    of = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    rolled = wide * PLACE[0] + np.uint64(0x9E37)
    for order in range(2, max(ORDERS) + 1):
        if n < order:
            return
        rolled = (rolled[: n - order + 1] ^ (rolled[: n - order + 1] >> np.uint64(29))) * PLACE[1] + wide[order - 1 :] * PLACE[order]
        if order in ORDERS:
            inside = left[: n - order + 1] >= order
            mixed = (rolled ^ (rolled >> np.uint64(31))) * PLACE[20]
            yield of[: n - order + 1][inside], (mixed >> np.uint64(64 - BITS)).astype(np.int64)[inside]


def features_of(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs; ``table`` gives a feature for a feature number, or -1."""
    found, size = [], int(table.max()) + 1 if len(table) else 0
    for first, points, ends in pieces(texts):
        for of, number in grams(points, ends):
            got = table[number]
            hit = got >= 0
            found.append((of[hit] + first) * size + got[hit])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return (pairs // size, pairs % size) if size else (pairs, pairs)


class Model:
    def __init__(self, table: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.table, self.weights, self.bias = table, weights, bias

    def scores(self, texts: list[str]) -> np.ndarray:
        of, feature = features_of(texts, self.table)
        raw = np.bincount(of, self.weights[feature], minlength=len(texts)) if len(of) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(raw + self.bias, -500, 500)))


def constant(value: float) -> Model:
    return Model(np.full(1 << BITS, -1, np.int32), np.zeros(0), 500.0 if value else -500.0)


def fit(present: np.ndarray, ratio: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on 0/1 features scaled by ``ratio``."""
    x = present.astype(np.float32) * ratio.astype(np.float32)
    x /= (scale := max(1e-6, float(np.abs(x).sum(axis=1).mean())))
    y, w, b = toxic.astype(np.float32), np.zeros(x.shape[1], np.float32), 0.0
    weight = np.where(toxic == 1, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean())).astype(np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    rng, step = np.random.default_rng(SEED), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            rows, step = order[lo : lo + BATCH], step + 1
            part = x[rows]
            error = (1 / (1 + np.exp(-np.clip(part @ w + b, -30, 30))) - y[rows]) * weight[rows]
            g, gb = error @ part / len(rows) + PENALTY * w / len(w) ** 0.5, float(error.mean())
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            b -= 0.1 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return w.astype(np.float64) * ratio / scale, b


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """From labelled rows of ``docs``; ``max_train`` of them, about."""
    tune(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg((F.max(F.col(label_col).cast("int")) > 0).cast("int").alias("_toxic"))
    total = known.count()
    if not total:
        return constant(0)
    chosen = known.where(F.pmod(F.xxhash64("_id", F.lit(6)), F.lit(2**31)) < int(min(1.0, max_train / total) * 2**31))
    rows = docs.select(row_id(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), "_id").select("_text", "_toxic").repartition(TASKS).cache()  # max_train ids, about
    try:
        sums = {r["_toxic"]: r["n"] for r in rows.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
        if len(sums) < 2:
            return constant(next(iter(sums), 0))
        return train_on(rows, sums)
    finally:
        rows.unpersist()


def train_on(rows: DataFrame, sums: dict[int, int]) -> Model:
    every = np.arange(1 << BITS, dtype=np.int32)

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            toxic = batch.column("_toxic").to_numpy(zero_copy_only=False)
            of, feature = features_of(strings(batch.column("_text")), every)
            for side in (0, 1):
                counts[side] += np.bincount(feature[toxic[of] == side], minlength=1 << BITS).astype(np.int32)
        parts = counts.reshape(2, SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([np.ascontiguousarray(parts[:, s]).tobytes() for s in range(SLICES)], pa.binary())], names=["slice", "counts"])

    @released
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, blob in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                held[at] = held.get(at, 0) + np.frombuffer(blob, np.int32).reshape(2, -1).astype(np.int64)
        for at, (clean, toxic) in held.items():
            p, q = (toxic + 1) / (sums[1] + 2), (clean + 1) / (sums[0] + 2)
            pooled = (toxic + clean + 2) / (sums[0] + sums[1] + 4)
            worth = np.abs(p - q) / np.sqrt(pooled * (1 - pooled) * (1 / sums[0] + 1 / sums[1]) + 1e-12)
            best = np.argsort(-np.where(toxic + clean >= MIN_TEXTS, worth, -1), kind="stable")[:FEATURES]
            best = best[(toxic + clean)[best] >= MIN_TEXTS]
            yield pa.RecordBatch.from_arrays([pa.array(best + at * len(clean)), pa.array(np.log(p[best] / q[best])), pa.array(worth[best])], names=["number", "ratio", "worth"])

    slices = rows.mapInArrow(count, "slice int, counts binary").repartition(SLICES, "slice")
    kept = slices.mapInArrow(select, "number long, ratio double, worth double").orderBy(F.desc("worth"), "number").limit(FEATURES).toArrow()
    if not kept.num_rows:
        return constant(int(sums[1] > sums[0]))
    table = np.full(1 << BITS, -1, np.int32)
    table[kept["number"].to_numpy()] = np.arange(kept.num_rows, dtype=np.int32)

    @released
    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column("_text"))
            flags = np.zeros((len(texts), kept.num_rows), np.uint8)
            flags[features_of(texts, table)] = 1
            yield pa.RecordBatch.from_arrays([batch.column("_toxic"), pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())], names=["_toxic", "flags"])

    got = rows.mapInArrow(present, "_toxic int, flags binary").orderBy("_toxic", "flags").toArrow()
    flags = np.unpackbits(np.frombuffer(b"".join(got["flags"].to_pylist()), np.uint8).reshape(got.num_rows, -1), axis=1)[:, : kept.num_rows]
    ratio = kept["ratio"].to_numpy()
    weights, bias = fit(flags, ratio, got["_toxic"].to_numpy())
    return Model(table, weights, bias)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, score) for every row of ``docs``."""
    spark = tune(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(shared.value.scores(strings(batch.column("_text"))))], names=["_id", "score"])

    return docs.select(row_id(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_docs(spark, sf_dir), read_docs(spark, sf_dir, "labels")
    model = train(docs.where(~held_out(modulus=5, rest=0)), labels.where(~held_out(modulus=5, rest=0)))
    scored = score(docs, model).select(public_id().alias("doc_id"), "score")
    return scored.select("doc_id", held_out(modulus=5, rest=0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
