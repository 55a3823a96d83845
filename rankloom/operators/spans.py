"""Positional operators: phrases, spans and proximity kernels over postings with position arrays.

Positions of one document meet in arrays inside a row, so a positional query costs one shuffle by document.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from .boolean import Similarity
    from .index import Index


def gathered(postings: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, dl, p0, p1, ...): the positions of each term in documents that have them all."""
    distinct = list(dict.fromkeys(terms))
    rows = postings.where(F.col("term").isin(distinct)).groupBy("doc_id").agg(F.first("dl").alias("dl"), *(F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"t{k}") for k, t in enumerate(distinct)))
    whole = rows.where(reduce(Column.__and__, (F.col(f"t{k}").isNotNull() for k in range(len(distinct)))))
    return whole.select("doc_id", "dl", *(F.col(f"t{distinct.index(t)}").alias(f"p{k}") for k, t in enumerate(terms)))


def moved(places: Column, offset: int) -> Column:
    return F.transform(places, lambda p: p - offset)


#: Stands for a place that isn't there.
NOWHERE = 1 << 30


def let(value: Column, use) -> Column:
    """``use(value)``, in which the value is made once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def highest(places: Column, offsets: list[int], low: Column, high: Column) -> Column:
    """The least upper end, in the phrase's own places and ``high`` at least, of one place for each offset, none of them under ``low``.

    Offsets rise, and places are taken as early as can be, each once; no choice of places ends lower.
    """
    def take(state: Column, offset: Column) -> Column:
        following = F.array_min(F.filter(places, lambda q: (q > state["last"]) & (q >= low + offset)))
        return let(F.coalesce(following, F.lit(NOWHERE)), lambda q: F.struct(q.alias("last"), F.greatest(state["high"], q - offset).alias("high")))

    begin = F.struct(F.lit(-1).alias("last"), high.alias("high"))
    return F.aggregate(F.array(*map(F.lit, sorted(offsets))), begin, take, lambda state: state["high"])


def displacement(first: Column, terms: dict[str, tuple[Column, list[int]]], own: str, offset: int, slop: int) -> Column:
    """The smallest spread, within the slop, of a match whose first term stands at ``first``; null without one.

    Each lower end within the slop is tried, over places near the first term only.
    """
    reach = [o for _, offsets in terms.values() for o in offsets]
    close = lambda q: q.between(first - slop + min(reach), first + slop + max(reach))
    apart = lambda q: close(q) & (q != first + offset)
    near = F.struct(*(F.filter(places, apart if t == own else close).alias(f"n{k}") for k, (t, (places, _)) in enumerate(terms.items())))

    def spread(near_: Column, low: Column) -> Column:
        high = first
        for k, (_, offsets) in enumerate(terms.values()):
            high = highest(near_[f"n{k}"], offsets, low, high)
        return high - low

    return let(near, lambda n: F.array_min(F.filter(F.transform(F.sequence(first - slop, first), lambda low: spread(n, low)), lambda d: d <= slop)))


def phrase_matches(postings: DataFrame, terms: list[str], slop: int = 0, offsets: list[int] | None = None) -> DataFrame:
    """(doc_id, dl, freq): exact phrases count their alignments; sloppy ones add 1 / (displacement + 1) for each begin.

    A sloppy match moves terms by up to ``slop`` places in total from the phrase's own offsets; for each place of
    the first term the smallest displacement counts, and repeated terms take different places.  The work for a place
    of the first term grows with the slop and the places near it, whatever the number of their combinations.
    """
    offsets = offsets or list(range(len(terms)))
    docs = gathered(postings, terms)
    shifted = [moved(F.col(f"p{k}"), o) for k, o in enumerate(offsets)]
    if not slop or len(terms) == 1:
        both = reduce(F.array_intersect, shifted)
        return docs.select("doc_id", "dl", F.size(both).cast("double").alias("freq"))
    others: dict[str, tuple[Column, list[int]]] = {}
    for k, (term, offset) in enumerate(zip(terms, offsets, strict=True)):
        if k:
            others.setdefault(term, (F.col(f"p{k}"), []))[1].append(offset)
    best = F.filter(F.transform(shifted[0], lambda f: displacement(f, others, terms[0], offsets[0], slop)), lambda d: d.isNotNull())
    freq = F.aggregate(best, F.lit(0.0), lambda a, d: a + 1 / (d + 1.0))
    return docs.select("doc_id", "dl", freq.alias("freq"))


def multi_phrase(postings: DataFrame, slots: list[list[str]]) -> DataFrame:
    """(doc_id, freq): each slot may be any of its terms."""
    every = sorted({t for slot in slots for t in slot})
    rows = postings.where(F.col("term").isin(every)).groupBy("doc_id").agg(*(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("term").isin(slot), moved(F.col("positions"), k))))).alias(f"s{k}") for k, slot in enumerate(slots)))
    return rows.select("doc_id", F.size(reduce(F.array_intersect, [F.col(f"s{k}") for k in range(len(slots))])).cast("double").alias("freq")).where("freq > 0")


def spans_of(postings: DataFrame, term: str) -> DataFrame:
    """(doc_id, start, end) of a term."""
    return postings.where(F.col("term") == term).select("doc_id", F.explode("positions").alias("start")).select("doc_id", "start", (F.col("start") + 1).alias("end"))


def span_first(spans: DataFrame, end: int) -> DataFrame:
    return spans.where(F.col("end") <= end)


def span_or(*spans: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, spans).distinct()


def listed(spans: DataFrame, name: str) -> DataFrame:
    return spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(name))


def span_near(clauses: list[DataFrame], slop: int, ordered: bool = True) -> DataFrame:
    """(doc_id, start, end): one span of every clause, within ``slop`` places that belong to none.

    Ordered: the spans follow each other without overlap, and for each last span the shortest match counts.
    """
    return in_order(clauses, slop) if ordered else in_any_order(clauses, slop)


def in_order(clauses: list[DataFrame], slop: int) -> DataFrame:
    """One join a clause, on the document and a range of places; of matches that end at one place and skip as many, the last begin stays."""
    width = slop + 1
    paths = clauses[0].select("doc_id", "start", "end", F.lit(0).alias("skipped"))
    for clause in clauses[1:]:
        reached = paths.select("*", F.explode(F.array_distinct(F.array(F.floor(F.col("end") / width), F.floor((F.col("end") + slop) / width)))).alias("range"))
        following = clause.select("doc_id", F.col("start").alias("next"), F.col("end").alias("next_end"), F.floor(F.col("start") / width).alias("range")).distinct()
        gap = F.col("next") - F.col("end")
        met = reached.join(following, ["doc_id", "range"]).where(gap.between(0, slop - F.col("skipped")))
        paths = met.groupBy("doc_id", F.col("next_end").alias("end"), (F.col("skipped") + gap).alias("skipped")).agg(F.max("start").alias("start"))
    return paths.groupBy("doc_id", "end").agg(F.max("start").alias("start")).select("doc_id", "start", "end")


def in_any_order(clauses: list[DataFrame], slop: int) -> DataFrame:
    """Paths by document, one span of each clause; a path goes on while the clauses to come could still fill its gaps."""
    docs = reduce(lambda a, b: a.join(b, "doc_id"), [listed(c, f"c{k}") for k, c in enumerate(clauses)])
    size = lambda s: s["end"] - s["start"]
    longest = [F.array_max(F.transform(f"c{k}", size)) for k in range(len(clauses))]
    paths = F.transform("c0", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), size(s).alias("held"), F.array(s).alias("used")))

    def longer(clause: Column, most: Column):
        def step(m: Column) -> Column:
            def fits(s: Column) -> Column:
                gap = F.greatest(m["end"], s["end"]) - F.least(m["start"], s["start"]) - m["held"] - size(s)
                return ~F.array_contains(m["used"], s) & (gap <= most)

            grown = lambda s: F.struct(F.least(m["start"], s["start"]).alias("start"), F.greatest(m["end"], s["end"]).alias("end"), (m["held"] + size(s)).alias("held"), F.array_sort(F.concat(m["used"], F.array(s))).alias("used"))
            return F.transform(F.filter(clause, fits), grown)

        return step

    for k in range(1, len(clauses)):
        most = reduce(Column.__add__, longest[k + 1 :], F.lit(slop))
        paths = F.array_distinct(F.flatten(F.transform(paths, longer(F.col(f"c{k}"), most))))
    rows = docs.select("doc_id", F.explode(paths).alias("m")).where(F.col("m.end") - F.col("m.start") - F.col("m.held") <= slop)
    return rows.select("doc_id", "m.start", "m.end").distinct()


def span_not(include: DataFrame, exclude: DataFrame) -> DataFrame:
    """Spans of ``include`` that overlap none of ``exclude``."""
    out = include.join(listed(exclude, "others"), "doc_id", "left")
    clash = F.exists("others", lambda o: (o["start"] < F.col("end")) & (o["end"] > F.col("start")))
    return out.where(~F.coalesce(clash, F.lit(False))).select("doc_id", "start", "end")


def span_scores(spans: DataFrame) -> DataFrame:
    """(doc_id, freq): shorter spans count for more."""
    return spans.groupBy("doc_id").agg(F.sum(1 / (F.col("end") - F.col("start") + 1)).alias("freq"))


def span_query(spans: DataFrame, index: Index, terms: list[str], similarity: Similarity, boost: float = 1.0) -> DataFrame:
    """(doc_id, score) of spans over these terms: tf of the span frequency, the terms' summed idf squared, and the length norm."""
    asked = index.only(terms)
    idf = asked.lexicon.where(F.col("term").isin(terms)).crossJoin(asked.stats).agg(F.sum(similarity.idf(F.col("df"), F.col("N"))).alias("idf"))
    lengths = asked.postings.where(F.col("term").isin(terms)).select("doc_id", "dl").distinct()
    value = similarity.tf(F.col("freq")) * F.col("idf") * F.col("idf") * boost * similarity.length_norm(F.col("dl"))
    return span_scores(spans).join(lengths, "doc_id").crossJoin(F.broadcast(idf)).select("doc_id", value.alias("score"))


def spans_with_payloads(spans: DataFrame, payloads: DataFrame) -> DataFrame:
    """(doc_id, start, end, payloads): the payloads (doc_id, pos, payload) at the places of each span, in order."""
    s, p = spans.alias("s"), payloads.alias("p")
    met = s.join(p, (F.col("s.doc_id") == F.col("p.doc_id")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))
    listed_ = F.transform(F.array_sort(F.collect_list(F.struct("pos", "payload"))), lambda x: x["payload"])
    return met.groupBy(F.col("s.doc_id").alias("doc_id"), "start", "end").agg(listed_.alias("payloads"))


def payload_scores(spans: DataFrame, payloads: DataFrame) -> DataFrame:
    """(doc_id, freq, payload): span frequency and the mean payload (doc_id, pos, payload) at the spans."""
    met = spans.join(payloads, (spans["doc_id"] == payloads["doc_id"]) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")), "left")
    return met.groupBy(spans["doc_id"]).agg(F.sum(1 / (F.col("end") - F.col("start") + 1)).alias("freq"), F.avg("payload").alias("payload"))


# Proximity kernels over two arrays of positions.


def pair_sum(a: Column, b: Column, value) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, i: x + F.aggregate(b, F.lit(0.0), lambda y, j: y + value(F.abs(i - j).cast("double"))))


def hal(a: Column, b: Column, window: int) -> Column:
    return pair_sum(a, b, lambda d: F.when(d > 0, F.greatest(F.lit(0.0), window - (d - 1))).otherwise(0.0))


def gaussian(a: Column, b: Column, sd: float, window: int | None = None) -> Column:
    bell = lambda d: F.exp(-d * d / (2 * sd * sd)) / (sd * 2.5066282746310002)
    return pair_sum(a, b, lambda d: bell(d) if window is None else F.when(d < window, bell(d)).otherwise(0.0))


def min_distance(a: Column, b: Column) -> Column:
    return F.array_min(F.transform(a, lambda i: F.array_min(F.transform(b, lambda j: F.abs(i - j)))))


def nearest_sigmoid(a: Column, b: Column) -> Column:
    """Sum over the shorter list of a falling sigmoid of the distance to the nearest position of the other."""
    short, long_ = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    near = lambda i: F.array_min(F.transform(long_, lambda j: F.abs(i - j))).cast("double")
    return F.aggregate(short, F.lit(0.0), lambda x, i: x + 2 / (1 + F.exp(near(i))))


def windows_with_any(places: Column, dl: Column, width: int) -> Column:
    """How many of the windows of ``width`` places hold one of the sorted ``places``: one pass over runs of begins."""
    final = F.greatest(dl - width, F.lit(0)).cast("long")

    def further(state: Column, place: Column) -> Column:
        low, high = F.greatest(place - (width - 1), state["next"]), F.least(place.cast("long"), final)
        return F.struct((state["n"] + F.greatest(high - low + 1, F.lit(0))).alias("n"), F.greatest(state["next"], high + 1).alias("next"))

    none = F.lit(0).cast("long")
    return F.aggregate(places, F.struct(none.alias("n"), none.alias("next")), further, lambda state: state["n"])


def windows_with_all(positions: list[Column], dl: Column, width: int) -> Column:
    """How many of the windows of ``width`` places hold every term; of two terms, those with each less those with any."""
    if len(positions) == 2:
        both = F.array_sort(F.concat(*positions))
        return sum((windows_with_any(p, dl, width) for p in positions), F.lit(0)) - windows_with_any(both, dl, width)
    last = F.greatest(dl - width, F.lit(0)).cast("int")
    begins = lambda p: F.array_distinct(F.flatten(F.transform(p, lambda i: F.sequence(F.greatest(i - (width - 1), F.lit(0)), F.greatest(F.least(i, last), F.greatest(i - (width - 1), F.lit(0)))))))
    inside = lambda p: F.filter(begins(p), lambda w: w <= last)
    return F.size(reduce(F.array_intersect, [inside(p) for p in positions])).cast("long")


def windows_in_order(first: Column, second: Column, dl: Column, width: int) -> Column:
    """Windows of ``width`` places with any place of the second term, if somewhere it follows the first within the width; else 0."""
    follows = F.exists(second, lambda b: F.exists(first, lambda a: (b > a) & (b - a < width)))
    return F.when(follows, windows_with_all([second], dl, width)).otherwise(F.lit(0).cast("long"))
