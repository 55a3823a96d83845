"""Topics, relevance judgements and runs: readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Deepest rank that a run writes.
DEPTH = 1000


def section(name: str, following: str) -> Column:
    """The text after an open tag without end tag, up to the next of the ``following`` ones."""
    found = F.regexp_extract("value", rf"(?is)<{name}>(.*?)(?=<(?:{following})\b|</?top>|$)", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(found, r"(?i)^\s*(Number|Description|Narrative|Topic)\s*:", " "), r"(?:<[^>]*>|\s)+", " "))


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic_id, title, desc, narr) of <top> records."""
    raw = spark.read.option("lineSep", "</top>").text(path).where(F.col("value").rlike("(?i)<num>"))
    tags = "num|title|desc|narr|querytime|querytweettime"
    return raw.select(F.regexp_extract(section("num", tags), r"(\S+)\s*$", 1).alias("topic_id"), *(section(n, tags).alias(n) for n in ("title", "desc", "narr")))


def read_timed_topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic_id, title, querytime, querytweettime) of topics that are asked at a time."""
    raw = spark.read.option("lineSep", "</top>").text(path).where(F.col("value").rlike("(?i)<num>"))
    part = lambda n: F.trim(F.regexp_extract("value", rf"(?is)<{n}>(.*?)</{n}>", 1))
    number = F.trim(F.regexp_replace(part("num"), r"(?i)Number\s*:", ""))
    stamp = F.try_to_timestamp(F.regexp_replace(part("querytime"), r"^\w{3} ", ""), F.lit("MMM dd HH:mm:ss Z yyyy"))
    title = F.coalesce(F.nullif(part("title"), F.lit("")), part("query"))
    return raw.select(number.alias("topic_id"), title.alias("title"), stamp.alias("querytime"), F.expr("try_cast(trim(regexp_extract(value, '(?is)<querytweettime>(.*?)</querytweettime>', 1)) AS bigint)").alias("querytweettime"))


def read_numbered_topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic_id, query) of lines ``<number>words`` or ``number words`` (the genomics and medical form)."""
    rows = spark.read.text(path)
    number, rest = F.regexp_extract("value", r"^\s*<?(\w+?)>?[\s:>]", 1), F.regexp_extract("value", r"^\s*<?\w+?>?[\s:>]\s*(.*)$", 1)
    return rows.select(number.alias("topic_id"), F.trim(rest).alias("query")).where("topic_id <> '' AND query <> ''")


def read_web_topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic_id, query) of lines ``prefix-number:query``; the prefix goes."""
    rows = read_line_topics(spark, path)
    return rows.select(F.regexp_replace("topic_id", r"^.*-", "").alias("topic_id"), "query")


def read_line_topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic_id, query) of lines ``id:query``."""
    rows = spark.read.text(path).where(F.col("value").contains(":"))
    return rows.select(F.trim(F.substring_index("value", ":", 1)).alias("topic_id"), F.trim(F.expr("substring(value, instr(value, ':') + 1)")).alias("query"))


def patent_queries(index_postings: DataFrame, lexicon: DataFrame, stats: DataFrame, k: int = 20) -> DataFrame:
    """(topic_id, term, qtf): each document's k terms of the largest tf * log2(N / df), as a query."""
    weight = F.col("tf") * F.log2(F.col("N") / F.col("df"))
    rows = index_postings.join(lexicon, "term").crossJoin(F.broadcast(stats)).select(F.col("doc_id").alias("topic_id"), "term", F.col("tf").alias("qtf"), weight.alias("weight"))
    place = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc(F.round("weight", 9)), "term"))
    return rows.withColumn("place", place).where(F.col("place") <= k).select("topic_id", "term", "qtf")


def subset(topics: DataFrame, first: int | None = None, last: int | None = None, parity: str | None = None) -> DataFrame:
    """Topics whose number lies in a range, and is even or odd."""
    number = F.regexp_extract("topic_id", r"(\d+)\D*$", 1).cast("int")
    if first is not None:
        topics = topics.where(number >= first)
    if last is not None:
        topics = topics.where(number <= last)
    return topics.where(number % 2 == (0 if parity == "even" else 1)) if parity else topics


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(topic_id, docno, grade); the topic is the last number in its field."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(parts) >= 4)
    return rows.select(F.regexp_extract(parts[0], r"(\d+)\D*$", 1).alias("topic_id"), parts[2].alias("docno"), parts[3].cast("int").alias("grade"))


def read_prels(spark: SparkSession, path: str) -> DataFrame:
    """(topic_id, docno, grade, alg, prob) of sampled judgements."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(parts) >= 5)
    return rows.select(parts[0].alias("topic_id"), parts[1].alias("docno"), parts[2].cast("int").alias("grade"), parts[3].cast("int").alias("alg"), parts[4].cast("double").alias("prob"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(topic_id, docno, rank, score, tag)."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(parts) >= 6)
    return rows.select(parts[0].alias("topic_id"), parts[2].alias("docno"), parts[3].cast("int").alias("rank"), parts[4].cast("double").alias("score"), parts[5].alias("tag"))


def run_lines(run: DataFrame, tag: str, docno: str = "docno", depth: int = DEPTH) -> DataFrame:
    """Lines ``topic Q0 docno rank score tag``: without null ids, each docno once at its best place, ranks from 0."""
    rows = run.where(F.col(docno).isNotNull()).groupBy("topic_id", docno).agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("score"), docno))
    kept = rows.withColumn("place", place).where(F.col("place") <= depth)
    return kept.select("topic_id", "place", F.concat_ws(" ", "topic_id", F.lit("Q0"), docno, (F.col("place") - 1).cast("string"), F.col("score").cast("string"), F.lit(tag)).alias("value"))


def write_run(run: DataFrame, path: str, tag: str, docno: str = "docno", depth: int = DEPTH, compression: str = "gzip") -> None:
    lines = run_lines(run, tag, docno, depth)
    lines.repartitionByRange("topic_id", "place").sortWithinPartitions("topic_id", "place").select("value").write.mode("overwrite").text(path, compression=compression)


def translate_ids(qrels: DataFrame, ids: DataFrame) -> DataFrame:
    """Judgements by document number as judgements by id: ids (docno, doc_id)."""
    return qrels.join(ids, "docno").select("topic_id", "doc_id", "grade")


def fit_for_posts(run: DataFrame, posts: DataFrame, topics: DataFrame, letters: float = 0.7) -> DataFrame:
    """Drops posts later than the topic's last post, forwarded ones, and those with too few Latin letters."""
    rows = run.join(posts.select("doc_id", "content"), "doc_id").join(F.broadcast(topics.select("topic_id", "querytweettime")), "topic_id")
    bare = F.regexp_replace("content", r"\s+", "")
    share = F.length(F.regexp_replace(bare, "[^A-Za-z]", "")) / F.greatest(F.length(bare), F.lit(1))
    return rows.where((F.col("doc_id") <= F.col("querytweettime")) & ~F.col("content").rlike(r"^\s*RT\b") & (share >= letters)).select(*run.columns)
