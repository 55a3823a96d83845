"""Language ID with a byte convolutional network, trained here in numpy.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes that cover all of it (the last is padded with
zeros).  A byte's embedding goes through filters of several widths, each filter keeps its maximum over the
window, and a softmax over the languages follows.  A text's distribution is the mean over its windows,
weighted by their bytes.

Training draws at most about ``PER_LANGUAGE`` documents of each language (those with the smallest hashes of
their id) and ``WINDOWS_EACH`` windows of each; scoring reads every byte of every text.

Defined results: null text, and text without a letter, is ``und`` with score 1; rows with a null language
are scored and never learned from; a null id hashes as the empty text does; with nothing to learn from
every text is ``und`` with score 0; repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, read_docs, released, tune

#: Bytes of a window.
WINDOW = 128
#: Documents of a language that are learned from, about, and windows of each of them.
PER_LANGUAGE, WINDOWS_EACH = 600, 8
#: Languages that can be learned; more are an error.
MAX_LANGUAGES = 4096
#: Widths of the filters, filters of each width, size of a byte's embedding.
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 12, 8
EPOCHS, RATE, BATCH, SEED = 4, 0.01, 128, 7
UNKNOWN = "und"


class ByteCNN:
    """Embedding, filters of several widths as one matrix over the widest, max pooling, softmax."""

    def __init__(self, classes: int, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.wide, self.features = max(WIDTHS), len(WIDTHS) * FILTERS
        mask = np.zeros((self.wide, EMBEDDING, self.features), np.float32)
        for k, width in enumerate(WIDTHS):
            mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = mask.reshape(-1, self.features)
        self.weights = {
            "embedding": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
            "filters": (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32),
            "bias": np.zeros(self.features, np.float32),
            "dense": rng.normal(0, 0.2, (self.features, classes)).astype(np.float32),
            "out": np.zeros(classes, np.float32),
        }

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unfolded embeddings, filter outputs by place) of byte windows."""
        x = self.weights["embedding"][windows]
        places = windows.shape[1] - self.wide + 1
        unfolded = np.concatenate([x[:, j : j + places] for j in range(self.wide)], axis=2)
        return unfolded, unfolded @ self.weights["filters"]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        w = self.weights
        top = np.maximum(self.pooled(windows)[1].max(axis=1) + w["bias"], 0)
        return softmax(top @ w["dense"] + w["out"])

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.weights, len(windows)
        unfolded, outputs = self.pooled(windows)
        at = outputs.argmax(axis=1)  # window, filter
        row, column = np.arange(n)[:, None], np.arange(self.features)[None]
        raw = outputs[row, at, column] + w["bias"]
        top = np.maximum(raw, 0)
        error = softmax(top @ w["dense"] + w["out"])
        error[np.arange(n), target] -= 1
        error /= n
        back = (error @ w["dense"].T) * (raw > 0)
        seen = unfolded[row, at]  # window, filter, input
        filters = np.einsum("nfi,nf->if", seen, back) * self.mask
        inputs = (back[:, :, None] * w["filters"].T[None]).reshape(n, self.features, self.wide, EMBEDDING)
        which = windows[row[:, :, None], at[:, :, None] + np.arange(self.wide)]
        embedding = np.stack([np.bincount(which.ravel(), inputs[..., d].ravel(), 256) for d in range(EMBEDDING)], axis=1)
        return {"embedding": embedding, "filters": filters, "bias": back.sum(axis=0), "dense": top.T @ error, "out": error.sum(axis=0)}

    def fit(self, windows: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> ByteCNN:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.weights.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for lo in range(0, len(order), BATCH):
                part, step = order[lo : lo + BATCH], step + 1
                for k, g in self.gradients(windows[part], target[part]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.weights[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover the texts, and how many each text has; an empty text has one of zeros."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
    padded = b"".join(t + bytes(int(c) * WINDOW - len(t)) for t, c in zip(texts, counts, strict=True))
    return np.frombuffer(padded, np.uint8).reshape(-1, WINDOW), counts


def held_out(id_col: str = "doc_id", modulus: int = 3, rest: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(0)) == rest


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, windows_each: int = WINDOWS_EACH) -> tuple[ByteCNN | None, list[str]]:
    """The network and its languages, from the rows of ``docs``: about ``per_language`` of each language, with at most ``windows_each`` windows."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} values")
    languages = sorted(counts)
    if not languages:
        return None, []
    cuts = docs.sparkSession.createDataFrame([(lang, int(min(1.0, per_language / counts[lang]) * 2**31)) for lang in languages], "_lang string, _cut long")
    chosen = rows.join(F.broadcast(cuts), "_lang").where(F.pmod(F.xxhash64(F.coalesce("_id", F.lit(""))), F.lit(2**31)) < F.col("_cut")).select("_text", "_lang")  # MAX_LANGUAGES rows at most
    number = {lang: k for k, lang in enumerate(languages)}

    @released
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, langs = [], []
            for text, lang in zip(binaries(batch.column("_text")), batch.column("_lang").to_pylist(), strict=True):
                every = windows_of([text])[0]
                for k in np.unique(np.linspace(0, len(every) - 1, windows_each).astype(int)):
                    found.append(every[k].tobytes())
                    langs.append(number[lang])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(langs, pa.int32())], names=["window", "lang"])

    got = chosen.mapInArrow(sample, "window binary, lang int").orderBy("lang", "window").toArrow()
    if not got.num_rows:
        return None, languages
    windows = np.frombuffer(b"".join(got["window"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    return ByteCNN(len(languages)).fit(windows, got["lang"].to_numpy()), languages


def classify(docs: DataFrame, model: ByteCNN | None, languages: list[str], *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added; columns of these names are replaced."""
    spark = tune(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    source = docs.select(*kept, (F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))).alias("lang_pred"))
    schema = docs.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    shared = spark.sparkContext.broadcast((model, languages))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, names = shared.value
        for batch in batches:
            lettered = np.array(batch.column("lang_pred").to_pylist(), bool)
            pred, score = np.full(batch.num_rows, UNKNOWN, object), np.where(lettered, 0.0, 1.0)
            rows = np.flatnonzero(lettered)
            if net is not None and len(rows):
                texts = binaries(batch.column(text_col).cast(pa.string()))
                for part in portions(rows, texts):
                    windows, counts = windows_of([texts[i] for i in part])
                    p = np.concatenate([net.probabilities(windows[lo : lo + 256]) for lo in range(0, len(windows), 256)]).astype(np.float64)
                    begin = np.cumsum(counts) - counts
                    sizes = np.full(len(windows), WINDOW)
                    sizes[begin + counts - 1] = [max(1, len(texts[i])) - (int(c) - 1) * WINDOW for i, c in zip(part, counts, strict=True)]
                    mean = np.add.reduceat(p * sizes[:, None], begin, axis=0) / np.add.reduceat(sizes, begin)[:, None]
                    pred[part] = np.array(names, object)[mean.argmax(axis=1)]
                    score[part] = np.minimum(1, mean.max(axis=1))
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred.tolist(), pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def portions(rows: np.ndarray, texts: list[bytes], size: int = 1 << 22) -> Iterator[np.ndarray]:
    """Rows whose texts hold about ``size`` bytes together."""
    ends = np.cumsum([len(texts[i]) for i in rows])
    yield from (x for x in np.split(rows, np.flatnonzero(np.diff(ends // size)) + 1) if len(x))


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Every row of ``docs`` as (id, held_out, lang_pred, score), by a network that learns from the rest."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    tune(docs.sparkSession)
    model, languages = train(docs.where(~held_out()))
    scored = classify(docs.select("doc_id", "text"), model, languages)
    return scored.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_docs(spark, sf_dir))
