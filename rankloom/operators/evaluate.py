"""Effectiveness metrics over run (topic_id, doc_id, rank from 1) and qrels (topic_id, doc_id, grade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed cut-offs and recall levels of the reports.
CUTS = (1, 2, 3, 4, 5, 10, 15, 20, 30, 50, 100, 200, 500, 1000)
LEVELS = tuple(k / 10 for k in range(11))


def topic_number(topic_id: Column) -> Column:
    """The last run of digits as a number."""
    return F.regexp_extract(topic_id, r"(\d+)\D*$", 1).cast("int")


def judged(run: DataFrame, qrels: DataFrame, positive_only: bool = False, drop_empty: bool = False) -> DataFrame:
    """Rows of the run of topics that are judged: (topic_id, doc_id, rank, relevant, found: so far, R: relevant in all).

    A grade other than 0 counts as relevant (``positive_only``: above 0).  Topics without relevant documents stay in,
    unless ``drop_empty``.
    """
    relevant = F.col("grade") > 0 if positive_only else F.col("grade") != 0
    marks = qrels.groupBy("topic_id", "doc_id").agg(F.max(relevant.cast("int")).alias("relevant"))
    totals = marks.groupBy("topic_id").agg(F.sum("relevant").alias("R"))
    if drop_empty:
        totals = totals.where("R > 0")
    rows = run.select("topic_id", "doc_id", "rank").join(F.broadcast(totals), "topic_id").join(marks, ["topic_id", "doc_id"], "left").fillna(0, ["relevant"])
    return rows.withColumn("found", F.sum("relevant").over(Window.partitionBy("topic_id").orderBy("rank")))


def per_topic(run: DataFrame, qrels: DataFrame, **options) -> DataFrame:
    """ap, r_precision, p_<k>, ip_<level>, rr, retrieved, relevant, relevant_retrieved of each topic."""
    rows = judged(run, qrels, **options)
    hit, rank, R = F.col("relevant") == 1, F.col("rank"), F.col("R")
    precision = F.col("found") / rank
    aggs = [F.coalesce(F.sum(F.when(hit, precision)) / F.nullif(F.first("R"), F.lit(0)), F.lit(0.0)).alias("ap"), F.coalesce(F.count_if(hit & (rank <= R)) / F.nullif(F.first("R"), F.lit(0)), F.lit(0.0)).alias("r_precision"),
            *((F.count_if(hit & (rank <= k)) / k).alias(f"p_{k}") for k in CUTS),
            *(F.coalesce(F.max(F.when(hit & (F.col("found") >= level * R), precision)), F.lit(0.0)).alias(f"ip_{int(level * 100)}") for level in LEVELS),
            F.coalesce(1 / F.min(F.when(hit, rank)), F.lit(0.0)).alias("rr"), F.count("*").alias("retrieved"), F.first("R").alias("relevant"), F.sum("relevant").alias("relevant_retrieved")]
    return rows.groupBy("topic_id").agg(*aggs)


def graded(run: DataFrame, qrels: DataFrame, depth: int = 10) -> DataFrame:
    """(topic_id, dcg, ndcg) to ``depth``: gain 2 ** grade - 1 over log2(rank + 1), against the best order of the judged documents."""
    gain = lambda rank: (F.pow(F.lit(2.0), F.greatest(F.col("grade"), F.lit(0))) - 1) / F.log2(rank + 1)
    marks = qrels.groupBy("topic_id", "doc_id").agg(F.max("grade").alias("grade"))
    best = marks.withColumn("place", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("grade")))).where(F.col("place") <= depth)
    ideal = best.groupBy("topic_id").agg(F.sum(gain(F.col("place"))).alias("ideal"))
    got = run.where(F.col("rank") <= depth).join(marks, ["topic_id", "doc_id"]).groupBy("topic_id").agg(F.sum(gain(F.col("rank"))).alias("dcg"))
    joined = ideal.join(got, "topic_id", "left").fillna(0.0, ["dcg"])
    return joined.select("topic_id", "dcg", F.coalesce(F.col("dcg") / F.nullif(F.col("ideal"), F.lit(0.0)), F.lit(0.0)).alias("ndcg"))


def report_lines(topics: DataFrame, names: tuple[str, ...] = ("ap", "r_precision", "p_10")) -> DataFrame:
    """(topic_id, value): a report's line of each topic, tab-separated, and one of the means, whose topic is ``all``."""
    means = topics.agg(*(F.avg(n).alias(n) for n in names), *(F.sum(n).alias(n) for n in ("retrieved", "relevant", "relevant_retrieved"))).withColumn("topic_id", F.lit("all"))
    rows = topics.select("topic_id", *names, "retrieved", "relevant", "relevant_retrieved").unionByName(means)
    return rows.select("topic_id", F.concat_ws("\t", "topic_id", *(F.format_string("%.4f", n) for n in names), *(F.col(n).cast("string") for n in ("retrieved", "relevant", "relevant_retrieved"))).alias("value"))


def write_report(topics: DataFrame, path: str) -> None:
    report_lines(topics).coalesce(1).sortWithinPartitions(F.col("topic_id") == "all", "topic_id").select("value").write.mode("overwrite").text(path)


def summary(topics: DataFrame) -> DataFrame:
    """Means over the topics, and totals."""
    means = [c for c in topics.columns if c not in ("topic_id", "retrieved", "relevant", "relevant_retrieved")]
    return topics.agg(F.count("*").alias("topics"), *(F.avg(c).alias(c) for c in means), *(F.sum(c).alias(c) for c in ("retrieved", "relevant", "relevant_retrieved")))


def named_page(run: DataFrame, qrels: DataFrame, deepest: int = 50) -> DataFrame:
    """Reciprocal rank within ``deepest``, and in how many topics the first relevant page stands in the top 1, 5, 10, 20, 50."""
    first = judged(run, qrels).groupBy("topic_id").agg(F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("rank"))
    within = F.when(F.col("rank") <= deepest, 1 / F.col("rank")).otherwise(0.0)
    return first.agg(F.avg(within).alias("mrr"), *(F.count_if(F.col("rank") <= k).alias(f"top_{k}") for k in (1, 5, 10, 20, 50)))
