"""Versions of an index, proximity feedback, feedback choice, re-ranking."""

import math

import pytest
from pyspark.sql import functions as F

from rankloom.operators import feedback as FB
from rankloom.operators import index as I
from rankloom.operators import proximity as P
from rankloom.operators import search as R
from rankloom.operators.versions import Store, compact


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    one, two = I.build(docs(spark, "a b")), I.build(docs(spark, "a b", "b c"))
    assert store.commits() == [] and store.commit(one) == 0
    assert store.open().stats.first().N == 1
    prepared = store.prepare(two)
    assert store.is_current(0) and store.open().stats.first().N == 1  # nobody sees it yet
    store.roll_back()
    assert prepared == 1 and store.commit(two, keep=1, snapshots=(0,)) == 1
    assert store.commits() == [0, 1] and store.open(0).stats.first().N == 1 and store.open().stats.first().N == 2
    store.commit(two)
    assert store.commits() == [2] and compact(store.open().postings, 1).rdd.getNumPartitions() == 1


@pytest.fixture(scope="module")
def parts(spark):
    index = I.build(docs(spark, "q x y y z", "q y x", "z z z w", "w w"))
    query = R.query_terms(R.topics_frame(spark, {"1": "q"}))
    run = spark.createDataFrame([("1", 0, 1, 3.0), ("1", 1, 2, 2.0), ("1", 2, 3, 1.0), ("1", 3, 4, 0.5)], "topic_id string, doc_id int, rank int, score double")
    return index, query, run


def test_proximity(spark, parts):
    index, query, run = parts
    fb = FB.pseudo(run, 2)
    near = {r.term: r.value for r in P.associations(fb, index, query, "hal").collect()}
    assert near == {"x": 10 + 9, "y": (9 + 8) + 10, "z": 7}
    spread = {r.term: r.weight for r in P.select_positional(fb, index, query, sd=2.0).collect()}
    bell = lambda *ds: sum(math.exp(-d * d / 8) / (2 * 2.5066282746310002) for d in ds)
    raw = {t: 0.9 * bell(*ds) + 2 * 0.1 * c / 14 for t, ds, c in (("x", (1, 2), 2), ("y", (2, 3, 1), 3))}
    assert spread.keys() == raw.keys() and all(abs(spread[t] - raw[t] / sum(raw.values())) < 1e-9 for t in raw)
    for kernel in P.KERNELS:
        assert P.select_cooccurring(fb, index, query, kernel).count() == 3 and P.select_near(fb, index, query, kernel).count() == 2


def test_dependence(spark, parts):
    index, _, _ = parts
    pairs = spark.createDataFrame([("1", "x", "y")], "topic_id string, first string, second string")
    got = {r.doc_id: r.score for r in P.dependence_score(index, pairs, 3, lambda tf, dl, df, n: tf * n / df).collect()}
    assert got == {0: 2 * 4 / 2, 1: 1 * 4 / 2}
    v = spark.range(1).select(P.binomial_l2(F.lit(2.0), F.lit(10.0), F.lit(12.0), F.lit(0.0)).alias("v")).first().v
    n, p, x = 11, 1 / 11, 2 * math.log2(1 + 1.2)
    lg = lambda a: math.lgamma(a) / math.log(2)
    assert abs(v - (-lg(n + 1) + lg(x + 1) + lg(n - x + 1) - x * math.log2(p) - (n - x) * math.log2(1 - p)) / (1 + x)) < 1e-3


def test_choice_of_documents(spark, parts):
    _, _, run = parts
    qrels = spark.createDataFrame([("1", 2, 1), ("1", 3, 0)], "topic_id string, doc_id int, grade int")
    assert [r.doc_id for r in FB.judged_first(run, qrels, 2).collect()] == [2]
    assert sorted((r.doc_id, r.weight) for r in FB.mixed(run, qrels, 2).collect()) == [(0, 0.5), (1, 0.5), (2, 1.0)]
    assert sorted((r.doc_id, r["rank"]) for r in FB.residual(run, qrels).collect()) == [(0, 1), (1, 2)]
    times = spark.sql("SELECT * FROM VALUES (0, 5), (1, 1), (2, 2), (3, 9) t(doc_id, ts)")
    assert sorted(r.doc_id for r in FB.before(run, times, spark.sql("SELECT '1' AS topic_id, 2 AS ts")).collect()) == [1, 2]


def test_classifier(spark, parts):
    index, _, run = parts
    terms = spark.createDataFrame([("1", t) for t in "qxyzw"], "topic_id string, term string")
    got = {r.doc_id: r.score for r in FB.rerank_by_classifier(run, index, terms, top=2, bottom=2, share=1.0).collect()}
    assert min(got[0], got[1]) > max(got[2], got[3])
