"""Filters and document-set algebra: each set is a one-column DataFrame of doc_id, or a predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_range(col: Column, low=None, high=None, include_low: bool = True, include_high: bool = True) -> Column:
    """Lexicographic or numeric range with open ends."""
    out = col.isNotNull()
    if low is not None:
        out &= (col >= low) if include_low else (col > low)
    if high is not None:
        out &= (col <= high) if include_high else (col < high)
    return out


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").join(b.select("doc_id"), "doc_id", "left_semi").distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").union(b.select("doc_id")).distinct()


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").join(b.select("doc_id"), "doc_id", "left_anti").distinct()


def sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, in_a, in_b) with one shuffle; all set operations and cardinalities are filters on it."""
    flagged = a.select("doc_id", F.lit(True).alias("in_a"), F.lit(False).alias("in_b")).union(b.select("doc_id", F.lit(False).alias("in_a"), F.lit(True).alias("in_b")))
    return flagged.groupBy("doc_id").agg(F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b"))


def xor(a: DataFrame, b: DataFrame) -> DataFrame:
    return sides(a, b).where("in_a <> in_b").select("doc_id")


def cardinalities(a: DataFrame, b: DataFrame) -> DataFrame:
    count = lambda cond: F.count_if(F.expr(cond))
    return sides(a, b).agg(count("in_a").alias("a"), count("in_b").alias("b"), count("in_a AND in_b").alias("intersection"), count("in_a OR in_b").alias("union"),
                           count("in_a AND NOT in_b").alias("and_not"), count("in_a <> in_b").alias("xor"))


def intersects(a: DataFrame, b: DataFrame) -> bool:
    return bool(a.select("doc_id").join(b.select("doc_id"), "doc_id", "left_semi").limit(1).count())


def stop_terms(lexicon: DataFrame, stats: DataFrame, share: float) -> DataFrame:
    """Terms in more than ``share`` of all documents."""
    return lexicon.crossJoin(F.broadcast(stats)).where(F.col("df") > share * F.col("N")).select("term")


def wildcard_pattern(pattern: str) -> str:
    """``*`` and ``?`` as a LIKE pattern."""
    plain = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return plain.replace("*", "%").replace("?", "_")


def fuzzy(lexicon: DataFrame, term: str, least: float = 0.5, prefix: int = 0) -> DataFrame:
    """(term, boost): terms within the edit-distance similarity, boosted by how far they exceed it."""
    head, tail = term[:prefix], term[prefix:]
    rest = F.substring("term", prefix + 1, 1 << 20)
    size = F.length(rest)
    similarity = 1 - F.levenshtein(rest, F.lit(tail)) / (prefix + F.least(size, F.lit(len(tail))))
    near = lexicon.where(F.col("term").startswith(head)) if head else lexicon
    # terms whose length alone rules them out never reach the distance
    longest = (prefix + len(tail)) * (2 - least) + 1
    near = near.where(F.length("term") <= longest)
    if not tail:
        return near.where(size == 0).select("term", F.lit(1.0).alias("boost"))
    return near.where((size > 0) | (F.lit(prefix) > 0)).withColumn("similarity", similarity).where(F.col("similarity") > least).select("term", ((F.col("similarity") - least) / (1 - least)).alias("boost"))
