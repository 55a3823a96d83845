"""Readers, writers and incremental indexing, by round trips."""

import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from rankloom.operators import index as I
from rankloom.sources import collections as C
from rankloom.sources import trec as T
from rankloom.streaming import append


def write(path, text):
    path.write_text(text)
    return str(path)


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_topics(spark, tmp_path):
    path = write(tmp_path / "t", "<top>\n<num> Number: 301\n<title> Crime\n<desc> Description:\nWhat is it?\n<narr> Narrative:\nAll <b>of</b> it.\n</top>\n<top>\n<num> Number: 302\n<title> Polio\n<desc> Description:\nWhere?\n<narr> Narrative:\n</top>\n")
    assert rows(T.read_topics(spark, path)) == [("301", "Crime", "What is it?", "All of it."), ("302", "Polio", "Where?", "")]
    assert [r.topic_id for r in T.subset(T.read_topics(spark, path), parity="even").collect()] == ["302"]
    line = write(tmp_path / "l", "rf09-1:family tree: old\n\n")
    assert rows(T.read_line_topics(spark, line)) == [("rf09-1", "family tree: old")]
    timed = write(tmp_path / "m", "<top>\n<num> Number: MB001 </num>\n<title> BBC cuts </title>\n<querytime> Tue Feb 08 12:30:27 +0000 2011 </querytime>\n<querytweettime> 34952194402811904 </querytweettime>\n</top>\n")
    r = T.read_timed_topics(spark, timed).select("topic_id", "title", F.date_format("querytime", "yyyyMMddHHmmss").alias("t"), "querytweettime").first()
    assert tuple(r) == ("MB001", "BBC cuts", "20110208123027", 34952194402811904)


def test_judgements_and_runs(spark, tmp_path):
    q = write(tmp_path / "q", "301 0 CR93E-10279 0\nMB302 0 FT1 2\n")
    assert rows(T.read_qrels(spark, q)) == [("301", "CR93E-10279", 0), ("302", "FT1", 2)]
    run = spark.createDataFrame([("1", "a", 2.0), ("1", "a", 3.0), ("1", "b", 2.5), ("1", None, 9.0), ("2", "c", 1.0)], "topic_id string, docno string, score double")
    T.write_run(run, str(tmp_path / "run"), "tag")
    assert rows(T.read_run(spark, str(tmp_path / "run"))) == [("1", "a", 0, 3.0, "tag"), ("1", "b", 1, 2.5, "tag"), ("2", "c", 0, 1.0, "tag")]


def test_collections(spark, tmp_path):
    sgml = write(tmp_path / "s", "<DOC>\n<DOCNO> A1 </DOCNO>\n<HEAD>no</HEAD><TEXT>one <b>two</b></TEXT><TEXT>three</TEXT>\n</DOC>\n<DOC><DOCNO>A2</DOCNO><TEXT>x</TEXT></DOC>\n")
    assert rows(C.read_sgml(spark, sgml)) == [("A1", "one two three"), ("A2", "x")]
    warc = write(tmp_path / "w", "WARC/0.18\nWARC-Type: response\nWARC-TREC-ID: c-1\nWARC-Target-URI: http://h/x\nContent-Length: 9\n\nHTTP/1.1 200 OK\nX: y\n\n<html><title>T</title><script>no</script>a &amp; b</html>\n")
    assert rows(C.read_warc(spark, warc)) == [("c-1", "http://h/x", "T", "T a & b")]
    xml = write(tmp_path / "x", "<Set><MedlineCitation><PMID>1</PMID><ArticleTitle>T</ArticleTitle><AbstractText>A</AbstractText><DescriptorName>M</DescriptorName><NameOfSubstance>C</NameOfSubstance></MedlineCitation></Set>")
    assert rows(C.read_medline(spark, xml)) == [("1", "T A M C")]
    posts = write(tmp_path / "p", "1\tu\t200\tTue Feb 08 12:30:27 +0000 2011\thello \"x\n")
    r = C.read_posts(spark, posts).first()
    assert r.content == 'hello "x' and r.time is not None


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.txt", "1")
    with tarfile.open(tmp_path / "b.tgz", "w:gz") as t:
        info = tarfile.TarInfo("two.txt")
        info.size = 1
        t.addfile(info, io.BytesIO(b"2"))
    got = [(r.name, bytes(r.content)) for r in C.read_archives(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("one.txt", b"1"), ("two.txt", b"2")]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "c c c")], "doc_id long, text string")
    for k in (1, 2, 3):
        docs.where(F.col("doc_id") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    append.index_stream(stream, str(tmp_path / "index"), str(tmp_path / "state")).awaitTermination()
    got, whole = append.reopen(spark, str(tmp_path / "index")), I.build(docs)
    assert rows(got.lexicon) == rows(whole.lexicon) and rows(got.stats) == rows(whole.stats)


def test_fresh_hits(spark):
    posts = spark.sql("SELECT 1L AS doc_id, TIMESTAMP'2020-01-02' AS ts, 'News now' AS text UNION ALL SELECT 2L, TIMESTAMP'2020-02-02', 'news later'")
    topics = spark.sql("SELECT '1' AS topic_id, TIMESTAMP'2020-01-01' AS asked, TIMESTAMP'2020-01-31' AS newest")
    terms = spark.createDataFrame([("1", "news")], "topic_id string, term string")
    assert [r.doc_id for r in append.fresh_hits(posts, topics, terms).collect()] == [1]
