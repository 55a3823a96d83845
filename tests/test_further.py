"""Changes of an index, plug-ins, date ranges, further topics and stems."""

import pytest
from pyspark.sql import functions as F

from rankloom.functions import analysis as A
from rankloom.operators import boolean as B
from rankloom.operators import index as I
from rankloom.operators import process, spans
from rankloom.plans import language
from rankloom.sources import trec

DOCS = [(1, "red fish blue fish"), (2, "one fish"), (3, "green eggs and ham"), (4, None), (5, "two fish red")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def lexicon(index):
    return {r.term: (r.df, r.ctf) for r in index.lexicon.collect()}


def test_stored_index_follows_its_files(spark, docs, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    docs.write.parquet(path)
    first = I.stored(spark.read.parquet(path))
    assert lexicon(first) == lexicon(I.build(docs)) and I.stored(spark.read.parquet(path)).postings.inputFiles() == first.postings.inputFiles()
    stats = first.stats.first()
    assert (stats.N, stats["T"], stats.avdl) == (5, 13, 2.6)
    spark.createDataFrame([(9, "new fish")], docs.schema).write.mode("append").parquet(path)
    assert lexicon(I.stored(spark.read.parquet(path)))["fish"] == (4, 5)
    assert lexicon(I.stored(docs)) == lexicon(first)  # no files
    assert I.stored(spark.read.parquet(path).where("doc_id < 0")).stats.first().N == 0


def test_look_up_of_few_terms_is_a_filter_of_the_scan(spark, docs, tmp_path):
    index = I.build(docs)
    index.write(f"{tmp_path}/a/one")
    read = I.Index.read(spark, f"{tmp_path}/a/one")
    plan = read.only(["fish", "red"]).postings._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan
    assert lexicon(read.only(["fish", "none"])) == {"fish": (3, 4)}
    index.write(f"{tmp_path}/a/two")
    assert [p.rsplit("/", 1)[1] for p in I.discover(spark, f"{tmp_path}/a")] == ["one", "two"] and I.discover(spark, f"{tmp_path}/none") == []


def test_delete_and_update(spark, docs):
    index = I.build(docs)
    left = I.delete_terms(index, ["red"])
    assert lexicon(left) == lexicon(I.build(docs.where("doc_id IN (2, 3)")))
    new = spark.createDataFrame([(2, "red ham"), (7, "seven")], docs.schema)
    assert lexicon(I.update(index, new)) == lexicon(I.build(docs.where("doc_id <> 2").unionByName(new)))


def test_term_clauses_agree_with_their_union(spark, docs):
    searcher = B.Searcher(I.build(docs), docs)
    query = B.Boolean(((B.MUST, B.Term("fish")), (B.SHOULD, B.Term("red", boost=2.0)), (B.SHOULD, B.Term("blue")), (B.MUST_NOT, B.Term("one"))))
    mixed = B.Boolean((*query.clauses, (B.SHOULD, B.Prefix("zzz"))), coord=False)
    plain = B.Boolean(query.clauses, coord=False)
    rows = lambda q: {r.doc_id: round(r.score, 9) for r in searcher.search(q).collect()}
    assert rows(plain) == rows(mixed) and set(rows(query)) == {1, 5}
    told = B.explain_clauses(searcher, query).groupBy("doc_id").agg((F.sum("value") * F.first("coord")).alias("score"))
    assert {r.doc_id: round(r.score, 9) for r in told.collect()} == rows(query)


def test_date_ranges():
    parse = lambda t: language.parse(t, date_resolution={"day": "day", "at": "second"})
    assert parse("day:[1/2/2002 TO 1/4/02]") == B.Range("20020102", "20020104", True, "day")
    assert parse("at:[1/2/2002 TO 2002-01-04]") == B.Range("20020102000000", "20020104235959", True, "at")
    assert parse("at:{1/2/2002 TO 1/4/2002}") == B.Range("20020102000000", "20020104000000", False, "at")
    assert parse("other:[1/2/2002 TO b]") == B.Range("1/2/2002", "b", True, "other")


def test_topics_and_chain(spark, tmp_path):
    (tmp_path / "n").write_text("<100>How do cells grow?\n101: two words\n\n")
    (tmp_path / "w").write_text("wt09-1:family tree: old\n")
    assert [tuple(r) for r in trec.read_numbered_topics(spark, f"{tmp_path}/n").collect()] == [("100", "How do cells grow?"), ("101", "two words")]
    assert [tuple(r) for r in trec.read_web_topics(spark, f"{tmp_path}/w").collect()] == [("1", "family tree: old")]
    run = spark.createDataFrame([("t", k, 1.0 - k / 10, k) for k in range(1, 6)], "topic_id string, doc_id long, score double, rank int")
    judged = spark.createDataFrame([("t", 1), ("t", 3)], "topic_id string, doc_id long")
    assert [(r.doc_id, r["rank"]) for r in process.chain(run, [process.without(judged), process.cut(2)]).collect()] == [(2, 1), (4, 2)]
    assert {"pooled", "rm3", "lca", "matf"} <= set(process.TERM_SELECTORS) and "pseudo" in process.FEEDBACK_SELECTORS


def test_letters_and_stems(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t"))).first()[0]
    assert one(A.arabic, "أَحمَد إلى مدرسة") == "احمد الي مدرسه" and one(A.greek, "Σοφός ΆΝΘΡΩΠΟΣ") == "σοφοσ ανθρωποσ" and one(A.persian, "کتاب") == "كتاب"
    assert [A.arabic_stem(w) for w in ("الكتاب", "والكتاب", "وزن", "معلمون", "مدرسه")] == ["كتاب", "كتاب", "وزن", "معلم", "مدرس"]
    got = one(lambda t: A.with_increments(A.general(t)), "a b c")
    assert [(x.term, x.increment) for x in got] == [("a", 1), ("b", 0), ("c", 0)]


def test_windows_in_order(spark):
    rows = spark.createDataFrame([([0, 9], [3], 12), ([5], [3], 12), ([], [3], 12)], "a array<int>, b array<int>, dl long")
    assert [r[0] for r in rows.select(spans.windows_in_order(F.col("a"), F.col("b"), F.col("dl"), 4)).collect()] == [4, 0, 0]


def test_queries_are_split_as_documents_are(spark):
    texts = ["Ein Wort_und 日本語テキスト mixed日本x", "x7 naïve Été ½ Ⅷ", "नमस्ते दुनिया", "", "ＡＢＣ ｱｲｳ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", A.general(F.col("t")).alias("w")).collect()
    assert {r.t: r.w for r in rows} == {t: language.words(t) for t in texts}


def test_broadcast_only_within_a_bound(spark):
    few = spark.range(10).toDF("doc_id")
    hinted = lambda f: "broadcast" in f._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(I.bounded(few, most=10)) and not hinted(I.bounded(few, most=9)) and not hinted(I.bounded(few, few.union(few), most=15))


def test_prels_ids_and_posts(spark, tmp_path):
    (tmp_path / "p").write_text("1 clueweb09-en0003-55-31884 0 0 1\n2 d 1 2 0.25\nshort line\n")
    assert [tuple(r) for r in trec.read_prels(spark, f"{tmp_path}/p").collect()] == [("1", "clueweb09-en0003-55-31884", 0, 0, 1.0), ("2", "d", 1, 2, 0.25)]
    qrels = spark.createDataFrame([("1", "d", 1), ("1", "x", 1)], "topic_id string, docno string, grade int")
    assert [tuple(r) for r in trec.translate_ids(qrels, spark.createDataFrame([("d", 7)], "docno string, doc_id long")).collect()] == [("1", 7, 1)]
    posts = spark.createDataFrame([(1, "plain words"), (2, "RT forwarded words"), (3, "日本語 語 x"), (9, "too late")], "doc_id long, content string")
    run = spark.createDataFrame([("1", k) for k in (1, 2, 3, 9)], "topic_id string, doc_id long")
    topics = spark.createDataFrame([("1", 5)], "topic_id string, querytweettime long")
    assert [r.doc_id for r in trec.fit_for_posts(run, posts, topics).collect()] == [1]


def test_nothing_outside_imports_the_optional_subpackage():
    import pathlib

    import rankloom

    root = pathlib.Path(rankloom.__file__).parent
    files = [p for p in root.rglob("*.py") if p.relative_to(root).parts[0] != "llm"]
    assert len(files) > 20 and not [p for p in files if "llm" in p.read_text()]
