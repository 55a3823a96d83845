"""Feedback by proximity: how near the candidate terms stand to the query's terms in the feedback documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import lg
from ..sources.storage import kept
from . import spans
from .feedback import QE_MODELS, best_terms
from .index import Index, bounded

#: Kernels over two position arrays and the document's length.
KERNELS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "hal": lambda a, b, dl: spans.hal(a, b, 10),
    "gaussian": lambda a, b, dl: spans.gaussian(a, b, 25.0),
    "sigmoid": lambda a, b, dl: spans.nearest_sigmoid(a, b),
    "windows": lambda a, b, dl: spans.windows_with_all([a, b], dl, 20).cast("double"),
}


def met(feedback: DataFrame, index: Index, query: DataFrame, itself: bool = False) -> DataFrame:
    """(topic_id, doc_id, term, tf, dl, positions, q, q_positions): candidate terms with each query term of their document.

    A query term meets itself only if ``itself``.
    """
    rows = kept(index.postings.join(bounded(feedback.select("topic_id", "doc_id")), "doc_id").select("topic_id", "doc_id", "term", "tf", "dl", "positions"), "feedback")  # one scan of the postings
    own = rows.join(F.broadcast(query.select("topic_id", "term")), ["topic_id", "term"]).select("topic_id", "doc_id", F.col("term").alias("q"), F.col("positions").alias("q_positions"))
    pairs = rows.join(own, ["topic_id", "doc_id"])
    return pairs if itself else pairs.where("term <> q")


def associations(feedback: DataFrame, index: Index, query: DataFrame, kernel: str = "gaussian") -> DataFrame:
    """(topic_id, term, q, value): the kernel's sum over the topic's documents."""
    pairs = met(feedback, index, query)
    return pairs.groupBy("topic_id", "term", "q").agg(F.sum(KERNELS[kernel](F.col("positions"), F.col("q_positions"), F.col("dl"))).alias("value"))


def select_cooccurring(feedback: DataFrame, index: Index, query: DataFrame, kernel: str = "windows", k: int = 40, delta: float = 0.01) -> DataFrame:
    """The square root of the product over query terms of delta + idf of the candidate * log10(1 + value)."""
    idf = index.lexicon.crossJoin(F.broadcast(index.stats)).select("term", lg(F.col("N") / F.col("df")).alias("idf"))
    cells = associations(feedback, index, query, kernel).join(idf, "term").groupBy("topic_id", "term").agg(F.sum(F.log(delta + F.col("idf") * F.log10(1 + F.col("value")))).alias("logs"), F.count("*").alias("hits"))
    total = query.groupBy("topic_id").agg(F.count("*").alias("n_query"))
    weight = F.exp((F.col("logs") + (F.col("n_query") - F.col("hits")) * F.log(F.lit(delta))) / 2)
    return best_terms(cells.join(F.broadcast(total), "topic_id").select("topic_id", "term", weight.alias("weight")), k)


def select_contextual(feedback: DataFrame, index: Index, query: DataFrame, k: int = 40, width: int = 500) -> DataFrame:
    """The square root of a term's windows shared with each query term, weighed by both their idf, relative to the largest.

    The idf is log10(N / df) / 5, 1 at most.
    """
    idf = index.lexicon.crossJoin(F.broadcast(index.stats)).select("term", F.least(F.lit(1.0), F.log10(F.col("N") / F.col("df")) / 5).alias("idf"))
    own = query.select("topic_id", "term").join(idf, "term").select("topic_id", F.col("term").alias("q"), F.col("idf").alias("q_idf"))
    shared = spans.windows_with_all([F.col("positions"), F.col("q_positions")], F.col("dl"), width)
    cells = met(feedback, index, query, itself=True).join(bounded(own, query), ["topic_id", "q"])
    found = cells.groupBy("topic_id", "term").agg(F.sum(shared * F.col("q_idf")).alias("windows")).join(idf, "term")
    weight = F.sqrt(F.col("windows") * F.col("idf"))
    return best_terms(found.select("topic_id", "term", weight.alias("weight")).where("weight > 0"), k)


def select_near(feedback: DataFrame, index: Index, query: DataFrame, kernel: str = "gaussian", model: str = "Bo1", k: int = 40, min_docs: int = 2) -> DataFrame:
    """A term's frequency in a document is what the kernel leaves of it near the query's terms; then a pooled expansion model."""
    pairs = met(feedback, index, query).groupBy("topic_id", "doc_id", "term").agg(F.sum(KERNELS[kernel](F.col("positions"), F.col("q_positions"), F.col("dl"))).alias("near"))
    lengths = index.postings.join(bounded(feedback.select("topic_id", "doc_id")), "doc_id").groupBy("topic_id", "doc_id").agg(F.first("dl").alias("dl")).groupBy("topic_id").agg(F.sum("dl").alias("fb_len"))
    pooled = pairs.groupBy("topic_id", "term").agg(F.sum("near").alias("fb_tf"), F.count("*").alias("fb_df")).where(F.col("fb_df") >= min_docs)
    rows = pooled.join(F.broadcast(lengths), "topic_id").join(index.lexicon, "term").crossJoin(F.broadcast(index.stats))
    return best_terms(rows.select("topic_id", "term", QE_MODELS[model]().alias("weight")), k)


def select_positional(feedback: DataFrame, index: Index, query: DataFrame, k: int = 40, sd: float = 25.0, weight: float = 0.1, min_docs: int = 2, by_position: bool = False) -> DataFrame:
    """Positional relevance model: counts spread by a Gaussian to the query terms' places, smoothed by the collection.

    ``by_position`` divides each document's sum by the number of those places.
    """
    bell = lambda d: F.exp(-d * d / (2 * sd * sd))
    spread = spans.pair_sum(F.col("q_positions"), F.col("positions"), bell)
    mass = sd * 2.5066282746310002
    pairs = met(feedback, index, query).groupBy("topic_id", "doc_id", "term").agg(F.sum(spread / mass).alias("plm"), F.sum(F.size("q_positions")).alias("places"))
    rows = pairs.join(index.lexicon, "term").crossJoin(F.broadcast(index.stats))
    value = (1 - weight) * F.col("plm") / (F.col("places") if by_position else F.lit(1.0)) + weight * F.col("ctf") / F.col("T")
    return best_terms(rows.groupBy("topic_id", "term").agg(F.sum(value).alias("weight"), F.count("*").alias("fb_df")).where(F.col("fb_df") >= min_docs).select("topic_id", "term", "weight"), k, "sum")


def dependence_score(index: Index, pairs: DataFrame, width: int, model: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """(topic_id, doc_id, score) of term pairs (topic_id, first, second): windows of ``width`` with both, scored as one term.

    ``model`` takes (tf, dl, df, N).
    """
    a = index.postings.join(F.broadcast(pairs), F.col("term") == F.col("first")).select("topic_id", "first", "second", "doc_id", "dl", F.col("positions").alias("a"))
    b = index.postings.join(F.broadcast(pairs), F.col("term") == F.col("second")).select("topic_id", "first", "second", "doc_id", F.col("positions").alias("b"))
    both = a.join(b, ["topic_id", "first", "second", "doc_id"]).withColumn("tf", spans.windows_with_all([F.col("a"), F.col("b")], F.col("dl"), width)).where("tf > 0")
    counts = both.groupBy("topic_id", "first", "second").agg(F.count("*").alias("df"))
    rows = both.join(F.broadcast(counts), ["topic_id", "first", "second"]).crossJoin(F.broadcast(index.stats))
    return rows.groupBy("topic_id", "doc_id").agg(F.sum(model(F.col("tf"), F.col("dl"), F.col("df"), F.col("N"))).alias("score"))


def binomial_l2(tf: Column, dl: Column, avdl: Column, pairs_in_collection: Column) -> Column:
    """Divergence of a pair's count from a binomial over the document's windows, with an L2 after-effect; log-gamma by Stirling."""
    def lgamma2(x: Column) -> Column:
        z = x + 7
        shift = sum((F.log2(x + i) for i in range(1, 7)), F.log2(x))
        return (z - 0.5) * F.log2(z) + (-z + 0.9189385332046727 + 1 / (12 * z)) * 1.4426950408889634 - shift

    n, p = avdl - 1, 1 / (avdl - 1)
    x = F.least(tf * F.log2(1 + avdl / dl), n - 1)
    return (-lgamma2(n + 1) + lgamma2(x + 1) + lgamma2(n - x + 1) - x * F.log2(p) - (n - x) * F.log2(1 - p)) / (1 + x)
