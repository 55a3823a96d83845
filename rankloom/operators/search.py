"""Batch retrieval: postings joined with query terms, one scoring expression, a top-k window per topic."""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.analysis import general
from ..functions.models import MODELS, Model, burst, squash
from ..sources.storage import kept
from .index import Index, analysed, bounded, lexicon_of, postings_of, statistics, stored_part


def query_terms(topics: DataFrame, analyzer=general, id_col: str = "topic_id", text_col: str = "query") -> DataFrame:
    """(topic_id, term, qtf, ql): the bag of words of each topic."""
    split = topics.select(F.col(id_col).alias("topic_id"), analyzer(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    return split.select("topic_id", F.size("tokens").cast("double").alias("ql"), F.explode("tokens").alias("term")).groupBy("topic_id", "term").agg(F.count("*").cast("double").alias("qtf"), F.first("ql").alias("ql"))


def normalise_qtf(terms: DataFrame, by: str = "max") -> DataFrame:
    total = (F.max if by == "max" else F.sum)("qtf").over(Window.partitionBy("topic_id"))
    return terms.withColumn("qtf", F.col("qtf") / total)


def index_for(docs: DataFrame, terms: DataFrame, positions: bool = False, **options) -> Index:
    """The part of an index that these query terms need, straight from the documents."""
    split = analysed(docs, **options)
    postings = postings_of(split, terms, positions)
    return Index(postings, lexicon_of(postings), statistics(split))


def columns(**more: Column) -> SimpleNamespace:
    named = {k: F.col(k).cast("double") for k in ("tf", "dl", "df", "ctf", "qtf", "ql", "N", "T", "avdl", "atf")}
    return SimpleNamespace(**(named | more))


def term_rows(index: Index, terms: DataFrame) -> DataFrame:
    """One row for each topic, document and query term in it, with all statistics."""
    sized = bounded(terms.join(index.lexicon, "term").crossJoin(index.stats), terms)  # as many rows as there are query terms
    return index.postings.join(sized, "term")


def explain(index: Index, terms: DataFrame, model: str | Model = "BM25", extra: dict[str, Column] | None = None, **params) -> DataFrame:
    """The rows whose scores add up: (topic_id, doc_id, term, tf, dl, df, score)."""
    chosen = MODELS[model] if isinstance(model, str) else model
    rows = term_rows(index, terms)
    return rows.select("topic_id", "doc_id", "term", "tf", "dl", "df", chosen.score(columns(**(extra or {})), **params).alias("score"))


def score(index: Index, terms: DataFrame, model: str | Model = "BM25", extra: dict[str, Column] | None = None, **params) -> DataFrame:
    """(topic_id, doc_id, score) of all documents with any term of a topic.

    A model with mass for unseen terms adds, for every candidate, the unseen value of all the topic's terms and,
    for each term in it, what the term has beyond that.  The topic's terms are one array on each candidate.
    """
    chosen = MODELS[model] if isinstance(model, str) else model
    rows = term_rows(index, terms)
    s = columns(**(extra or {}))
    if chosen.unseen is None:
        return rows.groupBy("topic_id", "doc_id").agg(F.sum(chosen.score(s, **params)).alias("score"))
    beyond = rows.groupBy("topic_id", "doc_id").agg(F.sum(chosen.score(s, **params) - chosen.unseen(s, **params)).alias("beyond"), F.first("dl").alias("dl"), F.first("atf").alias("atf"))
    every = terms.join(index.lexicon, "term").groupBy("topic_id").agg(F.collect_list(F.struct("df", "ctf", "qtf", "ql")).alias("terms")).crossJoin(index.stats)
    joined = beyond.join(bounded(every, terms), "topic_id")  # one row for each topic
    part = lambda t: chosen.unseen(columns(**({k: t[k].cast("double") for k in ("df", "ctf", "qtf", "ql")} | dict.fromkeys(extra or {}, F.lit(1.0)))), **params)
    return joined.select("topic_id", "doc_id", (F.col("beyond") + F.aggregate("terms", F.lit(0.0), lambda a, t: a + part(t))).alias("score"))


def top_k(scored: DataFrame, k: int = 1000, start: int = 1) -> DataFrame:
    """Ranks ``start`` to ``k`` of each topic: score down, then document id up."""
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("score"), F.asc("doc_id")))
    return scored.withColumn("rank", rank).where(F.col("rank").between(start, k))


def range_ranks(rows: DataFrame, order: list[Column], groups: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """``rows`` with their place in this order, from 1, in each group: ranges are ranked apart, after the counts of earlier ones.

    For groups of any size, as no task takes more than a range.  The order must tell all rows apart.
    """
    placed = rows.repartitionByRange(*(F.col(g) for g in groups), *order).withColumn("_range", F.spark_partition_id())
    placed = kept(placed, "ranges")
    same = reduce(Column.__and__, (F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups), F.col("_range") == F.col("_at"))
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    before = placed.groupBy(*groups, "_range").count().select(*(F.col(g).alias(f"_of_{g}") for g in groups), F.col("_range").alias("_at"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(*order))
    return placed.withColumn("_within", within).join(F.broadcast(before), same).withColumn(name, (F.col("_before") + F.col("_within")).cast("int")).select(*rows.columns, name)


def search(docs: DataFrame, topics: DataFrame, model: str | Model = "BM25", k: int = 1000, **params) -> DataFrame:
    terms = query_terms(topics)
    return top_k(score(stored_part(docs, terms), terms, model, **params), k)


def bm25f(fields: dict[str, tuple[DataFrame, float, float]], terms: DataFrame, k1: float = 1.2, idf_field: str | None = None) -> DataFrame:
    """Over fields {name: (documents with that field's text as ``text``, boost, b)}: one saturation over the fields' sum."""
    parts, idf = [], None
    for name, (docs, boost, b) in fields.items():
        index = index_for(docs, terms)
        parts.append(index.postings.crossJoin(F.broadcast(index.stats)).select("term", "doc_id", (boost * F.col("tf") / (1 - b + b * F.col("dl") / F.col("avdl"))).alias("x")))
        if idf is None or name == idf_field:
            idf = index.lexicon.crossJoin(index.stats).select("term", F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    weight = both.groupBy("term", "doc_id").agg(F.sum("x").alias("x")).join(F.broadcast(terms.join(idf, "term")), "term")
    return weight.groupBy("topic_id", "doc_id").agg(F.sum(F.col("x") / (k1 + F.col("x")) * F.col("idf")).alias("score"))


def topics_frame(spark: SparkSession, topics: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(topics.items()), "topic_id string, query string")


def with_document_norms(index: Index) -> Index:
    """Postings with ``norm``: the document's sum of squashed bursts, over all its terms."""
    part = squash(burst(SimpleNamespace(tf=F.col("tf").cast("double"), atf=F.col("atf"))))
    norms = index.postings.groupBy("doc_id").agg(F.sum(part).alias("norm"))
    return Index(index.postings.join(norms, "doc_id"), index.lexicon, index.stats)


def with_term_norms(index: Index) -> Index:
    """Postings with ``critf``: the term's sum of squashed bursts, over all documents."""
    part = squash(burst(SimpleNamespace(tf=F.col("tf").cast("double"), atf=F.col("atf"))))
    norms = index.postings.groupBy("term").agg(F.sum(part).alias("critf"))
    return Index(index.postings.join(bounded(norms, index.lexicon), "term"), index.lexicon, index.stats)  # a frequent term's postings stay apart
