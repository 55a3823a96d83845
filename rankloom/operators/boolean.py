"""Classic boolean retrieval: a query tree compiled to one conditional aggregate or to joins."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sets
from .index import Index
from .spans import phrase_matches, spans_of

MUST, SHOULD, MUST_NOT = "must", "should", "must_not"
#: Clauses of one boolean query, at most.
MAX_CLAUSES = 1024


@dataclass(frozen=True)
class Query:
    boost: float = field(default=1.0, kw_only=True)

    def boosted(self, boost: float) -> Query:
        return replace(self, boost=self.boost * boost)


@dataclass(frozen=True)
class Term(Query):
    text: str
    field: str | None = None


@dataclass(frozen=True)
class Phrase(Query):
    terms: tuple[str, ...]
    slop: int = 0
    field: str | None = None


@dataclass(frozen=True)
class Prefix(Query):
    text: str
    field: str | None = None


@dataclass(frozen=True)
class Wildcard(Query):
    text: str
    field: str | None = None


@dataclass(frozen=True)
class Fuzzy(Query):
    text: str
    least: float = 0.5
    prefix: int = 0
    field: str | None = None


@dataclass(frozen=True)
class Range(Query):
    low: str | None
    high: str | None
    inclusive: bool = True
    field: str | None = None


@dataclass(frozen=True)
class MatchAll(Query):
    pass


@dataclass(frozen=True)
class ConstantScore(Query):
    query: Query


@dataclass(frozen=True)
class DisMax(Query):
    queries: tuple[Query, ...]
    tie: float = 0.0


@dataclass(frozen=True)
class Boolean(Query):
    clauses: tuple[tuple[str, Query], ...]
    min_should: int = 0
    coord: bool = True

    def __post_init__(self) -> None:
        if len(self.clauses) > MAX_CLAUSES:
            raise ValueError(f"more than {MAX_CLAUSES} clauses")


@dataclass(frozen=True)
class Similarity:
    """The vector-space parts of a score, as Column functions; replace any of them."""

    def tf(self, freq: Column) -> Column:
        return F.sqrt(freq)

    def idf(self, df: Column, n: Column) -> Column:
        return F.log(n / (df + 1)) + 1

    def length_norm(self, dl: Column) -> Column:
        return 1 / F.sqrt(F.greatest(dl, F.lit(1)))

    def coord(self, overlap: Column, most: int) -> Column:
        return overlap / most


def terms_of(query: Query) -> set[str]:
    """All terms a query names."""
    if isinstance(query, Term):
        return {query.text}
    if isinstance(query, Phrase):
        return set(query.terms)
    if isinstance(query, Boolean):
        return set().union(*(terms_of(q) for _, q in query.clauses))
    if isinstance(query, DisMax):
        return set().union(*(terms_of(q) for q in query.queries))
    return terms_of(query.query) if isinstance(query, ConstantScore) else set()


def rewrite(query: Query) -> Query:
    """Single-clause booleans, one-term phrases and single disjuncts as what they hold; wildcards without marks as terms."""
    if isinstance(query, Boolean):
        clauses = tuple((occur, rewrite(q)) for occur, q in query.clauses)
        if len(clauses) == 1 and clauses[0][0] != MUST_NOT and query.min_should <= 1:
            return clauses[0][1].boosted(query.boost)
        return replace(query, clauses=clauses)
    if isinstance(query, Phrase) and len(query.terms) == 1:
        return Term(query.terms[0], query.field, boost=query.boost)
    if isinstance(query, DisMax):
        inner = tuple(map(rewrite, query.queries))
        return inner[0].boosted(query.boost) if len(inner) == 1 else replace(query, queries=inner)
    if isinstance(query, Wildcard) and not set("*?") & set(query.text):
        return Term(query.text, query.field, boost=query.boost)
    return replace(query, query=rewrite(query.query)) if isinstance(query, ConstantScore) else query


class Searcher:
    """Compiles a query to (doc_id, score) over an index (or one index for each field)."""

    def __init__(self, index: Index | dict[str, Index], documents: DataFrame, similarity: Similarity | None = None, default_field: str | None = None) -> None:
        self.indexes, self.documents, self.similarity = index, documents.select("doc_id"), similarity or Similarity()
        self.default = default_field

    def index(self, name: str | None) -> Index:
        return self.indexes[name or self.default] if isinstance(self.indexes, dict) else self.indexes

    def search(self, query: Query) -> DataFrame:
        return self.run(rewrite(query))

    def weighted(self, postings: DataFrame, index: Index, boost: Column | float) -> DataFrame:
        s = self.similarity
        idf = s.idf(F.col("df"), F.col("N"))
        value = s.tf(F.col("tf")) * idf * idf * boost * s.length_norm(F.col("dl"))
        return postings.join(F.broadcast(index.stats), how="cross").select("doc_id", value.alias("score"))

    def expanded(self, index: Index, terms: DataFrame, boost: float) -> DataFrame:
        """All documents with any of the terms, with one score for each: a multi-term query."""
        return index.postings.join(terms, "term", "left_semi").select("doc_id").distinct().withColumn("score", F.lit(float(boost)))

    def run(self, query: Query) -> DataFrame:
        s = self.similarity
        if isinstance(query, MatchAll):
            return self.documents.withColumn("score", F.lit(float(query.boost)))
        if isinstance(query, ConstantScore):
            return self.run(query.query).select("doc_id", F.lit(float(query.boost)).alias("score"))
        if isinstance(query, Term):
            index = self.index(query.field)
            rows = index.postings.where(F.col("term") == query.text).join(F.broadcast(index.lexicon.where(F.col("term") == query.text)), "term")
            return self.weighted(rows, index, query.boost)
        if isinstance(query, Prefix | Wildcard | Range):
            index = self.index(query.field)
            term = F.col("term")
            if isinstance(query, Prefix):
                chosen = index.lexicon.where(term.startswith(query.text))
            elif isinstance(query, Wildcard):
                chosen = index.lexicon.where(term.like(sets.wildcard_pattern(query.text)))
            else:
                chosen = index.lexicon.where(sets.in_range(term, query.low, query.high, query.inclusive, query.inclusive))
            return self.expanded(index, chosen.select("term"), query.boost)
        if isinstance(query, Fuzzy):
            index = self.index(query.field)
            chosen = sets.fuzzy(index.lexicon, query.text, query.least, query.prefix).join(index.lexicon, "term")
            rows = index.postings.join(chosen, "term")
            return self.weighted(rows, index, query.boost * F.col("boost")).groupBy("doc_id").agg(F.sum("score").alias("score"))
        if isinstance(query, Phrase):
            index = self.index(query.field)
            found = phrase_matches(index.only(list(query.terms)).postings, list(query.terms), query.slop).where("freq > 0")
            idf = index.lexicon.where(F.col("term").isin(*query.terms)).crossJoin(index.stats).agg(F.sum(s.idf(F.col("df"), F.col("N"))).alias("idf"))
            value = s.tf(F.col("freq")) * F.col("idf") * F.col("idf") * query.boost * s.length_norm(F.col("dl"))
            return found.join(F.broadcast(idf), how="cross").select("doc_id", value.alias("score"))
        if isinstance(query, DisMax):
            rows = self.union([self.run(q) for q in query.queries])
            return rows.groupBy("doc_id").agg(((F.max("score") + (F.sum("score") - F.max("score")) * query.tie) * query.boost).alias("score"))
        if isinstance(query, Boolean):
            return self.boolean(query)
        raise TypeError(query)

    @staticmethod
    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def term_rows(self, query: Boolean, index: Index) -> DataFrame:
        """(doc_id, score, occur) of term clauses: one scan of the postings for all of them."""
        asked = index.only([q.text for _, q in query.clauses])
        clauses = self.documents.sparkSession.createDataFrame([(q.text, occur, float(q.boost)) for occur, q in query.clauses], "term string, occur string, boost double")
        sized = F.broadcast(clauses.join(asked.lexicon, "term").crossJoin(asked.stats))  # MAX_CLAUSES rows at most
        s = self.similarity
        idf = s.idf(F.col("df"), F.col("N"))
        value = s.tf(F.col("tf")) * idf * idf * F.col("boost") * s.length_norm(F.col("dl"))
        return asked.postings.join(sized, "term").select("doc_id", value.alias("score"), "occur")

    def boolean(self, query: Boolean) -> DataFrame:
        """One aggregate over all clauses: required clauses counted, prohibited ones absent, enough optional ones."""
        required = sum(occur == MUST for occur, _ in query.clauses)
        optional = sum(occur == SHOULD for occur, _ in query.clauses)
        if not required + optional:
            return self.documents.where(F.lit(False)).withColumn("score", F.lit(0.0))
        plain = {q.field for _, q in query.clauses if isinstance(q, Term)} if all(isinstance(q, Term) for _, q in query.clauses) else set()
        if len(plain) == 1:
            rows = self.term_rows(query, self.index(plain.pop()))
        else:
            rows = self.union([self.run(q).select("doc_id", "score", F.lit(occur).alias("occur")) for occur, q in query.clauses])
        count = lambda occur: F.count_if(F.col("occur") == occur)
        agg = rows.groupBy("doc_id").agg(F.sum(F.when(F.col("occur") != MUST_NOT, F.col("score"))).alias("score"), count(MUST).alias("must"), count(SHOULD).alias("should"), count(MUST_NOT).alias("not"))
        least = query.min_should or (0 if required else 1)
        kept = agg.where((F.col("must") == required) & (F.col("not") == 0) & (F.col("should") >= least))
        coord = self.similarity.coord(F.col("must") + F.col("should"), required + optional) if query.coord else F.lit(1.0)
        return kept.select("doc_id", (F.col("score") * coord * query.boost).alias("score"))


def field_scores(documents: DataFrame, column: str, kind: str = "float", boost: float = 1.0) -> DataFrame:
    """(doc_id, score) of every document with a value: a field read as a number is the score."""
    return documents.select("doc_id", (F.col(column).cast(kind).cast("double") * boost).alias("score")).where("score IS NOT NULL")


def explain_clauses(searcher: Searcher, query: Boolean) -> DataFrame:
    """(doc_id, term, occur, tf, df, idf, norm, value, overlap, coord) of the term clauses that a hit meets; score = coord * sum of the values."""
    s = searcher.similarity
    index = searcher.index(next((q.field for _, q in query.clauses if isinstance(q, Term)), None)).only(sorted(terms_of(query)))
    required = sum(occur == MUST for occur, _ in query.clauses)
    most = sum(occur != MUST_NOT for occur, _ in query.clauses)
    clauses = searcher.documents.sparkSession.createDataFrame([(q.text, occur, float(q.boost)) for occur, q in query.clauses], "term string, occur string, boost double")
    rows = index.postings.join(F.broadcast(clauses.join(index.lexicon, "term").crossJoin(index.stats)), "term")
    idf, norm = s.idf(F.col("df"), F.col("N")), s.length_norm(F.col("dl"))
    rows = rows.select("doc_id", "term", "occur", "tf", "df", idf.alias("idf"), norm.alias("norm"), (s.tf(F.col("tf")) * idf * idf * F.col("boost") * norm).alias("value"))
    doc = Window.partitionBy("doc_id")
    for name in (MUST, SHOULD, MUST_NOT):
        rows = rows.withColumn(f"n_{name}", F.count_if(F.col("occur") == name).over(doc))
    least = query.min_should or (0 if required else 1)
    kept = rows.where((F.col(f"n_{MUST}") == required) & (F.col(f"n_{MUST_NOT}") == 0) & (F.col(f"n_{SHOULD}") >= least))
    overlap = F.col(f"n_{MUST}") + F.col(f"n_{SHOULD}")
    return kept.select("doc_id", "term", "occur", "tf", "df", "idf", "norm", "value", overlap.alias("overlap"), (s.coord(overlap, most) if query.coord else F.lit(1.0)).alias("coord"))


# The same conjunctions as joins; results agree with the aggregate form.


def conjunction(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.alias("a").join(b.alias("b"), "doc_id").select("doc_id", (F.col("a.score") + F.col("b.score")).alias("score"))


def required_optional(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.alias("a").join(b.alias("b"), "doc_id", "left").select("doc_id", (F.col("a.score") + F.coalesce(F.col("b.score"), F.lit(0.0))).alias("score"))


def required_excluded(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_id", "left_anti")


def filtered(scored: DataFrame, allowed: DataFrame) -> DataFrame:
    return scored.join(allowed.select("doc_id"), "doc_id", "left_semi")


__all__ = ["Boolean", "ConstantScore", "DisMax", "Fuzzy", "MatchAll", "Phrase", "Prefix", "Query", "Range", "Searcher", "Similarity", "Term", "Wildcard", "spans_of"]
