"""Incremental indexing: micro-batches of documents append postings; statistics are aggregated again when read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.analysis import general
from ..operators.index import Index, analysed, lexicon_of, postings_of, statistics


def index_stream(docs: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends the postings and lengths of a stream of documents (doc_id, text); a batch that is replayed replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        split = analysed(batch)
        postings_of(split, positions=True).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        split.select("doc_id", "dl").write.mode("overwrite").parquet(f"{path}/lengths/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def reopen(spark: SparkSession, path: str, upto: int | None = None) -> Index:
    """The index of all batches so far (or up to one of them)."""
    chosen = lambda name: spark.read.parquet(f"{path}/{name}").where(F.col("batch") <= (upto if upto is not None else 1 << 62)).drop("batch")
    postings = chosen("postings")
    return Index(postings, lexicon_of(postings), statistics(chosen("lengths")))


def fresh_hits(posts: DataFrame, topics: DataFrame, terms: DataFrame) -> DataFrame:
    """Stream-static filter: posts (doc_id, ts, text) that hold a topic's term and lie in [asked, newest] of the topic."""
    tokens = posts.select("doc_id", "ts", F.explode(F.array_distinct(general(F.coalesce("text", F.lit(""))))).alias("term"))
    wanted = F.broadcast(terms.select("topic_id", "term").join(topics.select("topic_id", "asked", "newest"), "topic_id"))
    return tokens.join(wanted, "term").where("ts BETWEEN asked AND newest").select("topic_id", "doc_id", "ts", "term")
