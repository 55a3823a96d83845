"""Steps that must not grow faster than their input: what is shuffled, read twice or put in one task."""

import glob
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankloom.functions import analysis as A
from rankloom.operators import feedback as FB
from rankloom.operators import index as I
from rankloom.operators import proximity as P
from rankloom.operators import search as R
from rankloom.operators.versions import Store
from rankloom.plans.catalogue import QUERIES

TEXTS = [(k, f"red fish {'blue ' * (k % 3)}no{k} été the") for k in range(60)] + [(60, None), (61, ""), (62, "中文 ㄅx ab中")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("growth"))
    docs.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture
def no_small_tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def plain(rows):
    """Postings with positions, in plain Python."""
    found = {}
    for doc_id, words in rows:
        for pos, word in enumerate(words):
            found.setdefault((word, doc_id), []).append(pos)
    return {k: (len(v), v) for k, v in found.items()}


@pytest.mark.parametrize("positions", [True, False])
def test_documents_are_counted_where_they_are_split(spark, docs, positions):
    split = I.analysed(docs)
    postings = I.postings_of(split, positions=positions)
    assert "Exchange" not in plan(postings)
    expected = plain((r.doc_id, r.tokens) for r in split.collect())
    got = {(r.term, r.doc_id): (r.tf, r.positions if positions else expected[r.term, r.doc_id][1]) for r in postings.collect()}
    assert got == expected
    lengths = {r.doc_id: (r.dl, r.atf) for r in split.collect()}
    assert all(lengths[r.doc_id] == (r.dl, r.atf) for r in postings.collect())


def test_repeated_ids_are_still_one_document(spark):
    docs = spark.createDataFrame([("x", "a b a"), ("x", "a c"), (None, "a"), (None, "b a"), ("y", "")], "doc_id string, text string")
    rows = {(r.term, r.doc_id): (r.tf, r.positions) for r in I.build(docs).postings.collect()}
    assert rows == {("a", "x"): (3, [0, 0, 2]), ("b", "x"): (1, [1]), ("c", "x"): (1, [1]), ("a", None): (2, [0, 1]), ("b", None): (1, [0])}


def test_general_tokens_of_mixed_scripts(spark):
    text = "AB1é中文ㄅㄆxㄅ Ωλ2'²ª가나 x_y"
    assert spark.range(1).select(A.general(F.lit(text))).first()[0] == ["ab1é", "中文ㄅㄆ", "x", "ㄅ", "ωλ2", "²ª가나", "x", "y"]


def test_a_version_counts_its_lexicon_from_its_files(spark, docs, tmp_path, monkeypatch):
    counted, lexicon_of = [], I.lexicon_of
    index = I.build(docs, positions=False)
    monkeypatch.setattr(I, "lexicon_of", lambda postings: counted.append(postings.inputFiles()) or lexicon_of(postings))
    store = Store(spark, str(tmp_path))
    store.commit(index)
    assert len(counted) == 1 and all("/postings/" in f for f in counted[0])
    assert sorted(store.open().lexicon.collect()) == sorted(index.lexicon.collect())


def test_check_counts_the_postings_once(spark, docs):
    index = I.build(docs, positions=False)
    found = I.check(index)
    assert plan(found).count("MapInArrow") == 1
    assert {r.name: r.failures for r in found.collect()} == {"counts": 0, "df_at_most_n": 0}
    wrong = I.Index(index.postings, index.lexicon.where("term <> 'red'").withColumn("df", F.when(F.col("term") == "fish", 99).otherwise(F.col("df"))), index.stats)
    assert {r.name: r.failures for r in I.check(wrong).collect()} == {"counts": 2, "df_at_most_n": 1}


def test_deletes_leave_postings_where_they_are(spark, docs, no_small_tables):
    left = I.delete(I.build(docs), docs.where("doc_id < 10").select("doc_id"))
    assert "BroadcastHashJoin" in plan(left.postings) and "Exchange hash" not in plan(left.postings)
    assert left.lexicon.where("term = 'red'").first().df == 50


def test_a_stream_is_dealt_to_many_tasks(spark, folder):
    rows = Counter(tuple(r) for r in QUERIES["stream_index"](spark, folder).collect())
    assert rows == Counter(tuple(r) for r in QUERIES["index_lexicon"](spark, folder).collect())
    newest = max(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/stream-source-*"), key=lambda p: glob.os.stat(p).st_mtime)
    assert len(glob.glob(f"{newest}/part-*")) > 3


def test_a_terms_postings_are_not_brought_together_for_its_norm(spark, docs, no_small_tables):
    found = R.with_term_norms(I.build(docs)).postings
    assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)


@pytest.mark.parametrize("name", ["filter_accents", "filter_index_unit", "filter_elision", "char_ngrams", "shingle_matrix"])
def test_maps_of_tokens_run_on_distinct_ones(spark, folder, name):
    assert plan(QUERIES[name](spark, folder)).count("HashAggregate") == 4


def test_shingle_matrix_of_neighbours(spark, folder):
    words = [r.tokens for r in I.analysed(spark.read.parquet(f"{folder}/documents.parquet")).collect()]
    expected = Counter(f"{a}_{b}" for ws in words for v, w in zip(ws, ws[1:]) for a in (v, v[:1]) for b in (w, w[:1]))
    assert {r.term: r.n for r in QUERIES["shingle_matrix"](spark, folder).collect()} == expected


@pytest.mark.parametrize("select", ["KL", "Lemur_TFIDF", "rm3", "contextual", "classifier"])
def test_feedback_reads_the_postings_once(spark, folder, select):
    index = I.stored(spark.read.parquet(f"{folder}/documents.parquet"))
    terms = R.query_terms(R.topics_frame(spark, {"1": "red blue"}))
    run = spark.createDataFrame([("1", d, d + 1, 1.0 / (d + 1)) for d in range(30)], "topic_id string, doc_id long, rank int, score double")
    fb = FB.pseudo(run, 3)
    if select == "rm3":
        found = FB.select_rm3(fb, index, terms, 20)
    elif select == "contextual":
        found = P.select_contextual(fb, index, terms, 20)
    elif select == "classifier":
        found = FB.rerank_by_classifier(run, index, terms)
    else:
        found = FB.select_pooled(fb, index, select, 20)
    assert not any("/postings/" in f for f in found.inputFiles())
    assert found.count() > 0
