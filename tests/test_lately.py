"""Contextual expansion, ranks by ranges, window counts and token streams, against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rankloom.functions import analysis as A
from rankloom.operators import index as I
from rankloom.operators import proximity as P
from rankloom.operators import search as R
from rankloom.operators import spans

RNG = random.Random(4)
TEXTS = [" ".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(1, 40))) for _ in range(25)]


def windows(text, terms, width):
    words = text.split()
    return sum(set(terms) <= set(words[w : w + width]) for w in range(max(len(words) - width, 0) + 1))


@pytest.mark.parametrize("width", [3, 10, 60])
def test_windows_of_two_terms(spark, width):
    p = I.build(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")).postings
    got = spans.gathered(p, ["a", "b"]).select("doc_id", spans.windows_with_all([F.col("p0"), F.col("p1")], F.col("dl"), width).alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {k: windows(t, "ab", width) for k, t in enumerate(TEXTS) if {"a", "b"} <= set(t.split())}


@pytest.mark.parametrize("width", [4, 500])
def test_contextual_expansion(spark, width):
    index = I.build(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string"))
    query = spark.createDataFrame([("t", "a", 1.0, 2.0), ("t", "b", 1.0, 2.0)], "topic_id string, term string, qtf double, ql double")
    chosen = [1, 3, 5, 7]
    got = P.select_contextual(spark.createDataFrame([("t", k) for k in chosen], "topic_id string, doc_id int"), index, query, 100, width).collect()
    df = Counter(w for t in TEXTS for w in set(t.split()))
    idf = {w: min(1, math.log10(len(TEXTS) / n) / 5) for w, n in df.items()}
    value = defaultdict(float)
    for k in chosen:
        held = set(TEXTS[k].split())
        for w in held:
            value[w] += idf[w] * sum(idf[q] * windows(TEXTS[k], {w, q}, width) for q in ("a", "b") if q in held)
    expected = {w: round(math.sqrt(v / max(value.values())), 9) for w, v in value.items() if v > 0}
    assert {r.term: round(r.weight, 9) for r in got} == expected


def test_ranks_by_ranges(spark):
    rows = [(k % 3 if k % 11 else None, RNG.randrange(5), k) for k in range(400)]
    got = R.range_ranks(spark.createDataFrame(rows, "g int, a int, b int").repartition(7), [F.desc("a"), F.asc("b")], ("g",)).collect()
    expected = {}
    for g in {r[0] for r in rows}:
        for place, (_, a, b) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            expected[g, a, b] = place
    assert {(r.g, r.a, r.b): r["rank"] for r in got} == expected
    assert R.range_ranks(spark.createDataFrame([], "a int"), [F.col("a")]).count() == 0


def test_token_streams(spark):
    columns = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")), F.array(F.lit("d"), F.lit("e")))
    row = spark.range(1).select(
        A.shingle_matrix(columns, 1, 3).alias("m"), A.date_tokens(F.array(*map(F.lit, ("2001-02-03", "x", "2001-13-01"))), "yyyy-MM-dd").alias("d"),
        A.token_range(F.array(*map(F.lit, "abcdef")), 1, 3).alias("r"), A.joined_streams("<", F.array(F.lit("x")), ">").alias("j"), A.shingle_matrix(columns, 4, 4).alias("none"),
    ).first()
    assert row.m == ["a", "b", "c", "d", "e", "a_c", "b_c", "c_d", "c_e", "a_c_d", "a_c_e", "b_c_d", "b_c_e"]
    assert (row.d, row.r, row.j, row.none) == (["2001-02-03"], ["b", "c"], ["<", "x", ">"], [])
