import re

import pytest
import xxhash

from rankloom.llm import decontaminate as d
from rankloom.llm import sentencepiece as sp
from tests.llm import cases
from tests.llm.test_text import benchmark

pipeline = pytest.importorskip("corpus_pipeline")


def expected(rows, items):
    rows = [(i, t) for i, t in rows if t and re.search(r"[^\W\d_]", t)]
    keys = [[cases.lower(x).strip(" \t\n\x0b\x0c\r") for x in t.split("\n")] for _, t in rows]
    holders = {}
    for (i, _), ks in zip(rows, keys, strict=True):
        for k in ks:
            holders.setdefault(k, set()).add(i)
    rows = [(i, "\n".join(x for x, k in zip(t.split("\n"), ks, strict=True) if not k or len(holders[k]) < 10)) for (i, t), ks in zip(rows, keys, strict=True)]
    found = cases.brute_jaccard(rows)
    rows = [r for r, (i, n, c) in zip(rows, found, strict=True) if n == 0 or i == c]
    windows = d.Windows([(i, t.encode()) for i, t in items if i is not None and t])
    out = []
    for i, t in rows:
        spans = d.shard_hits(windows, [t.encode()])[1][0]
        out.append((i, d.strip_spans(t, [a for a, _ in spans], [b for _, b in spans])))
    return out


def test_run(spark, tmp_path):
    rows = [(i, t) for i, t in cases.corpus() if i is not None]
    rows = list({i: t for i, t in rows}.items())
    items = benchmark(rows)
    cases.frame(spark, rows).selectExpr("doc_id", "text", "CASE doc_id % 2 WHEN 0 THEN 'aa' ELSE 'bb' END AS lang", "'s' AS source", "length(text) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pieces = sp.Pieces(sp.MODEL)
    got = [(r.doc_id, pieces.decode(__import__("numpy").frombuffer(r.ids, "<i4"))) for r in pipeline.run(spark, str(tmp_path)).collect()]
    cases.same(got, expected(rows, items))


def test_stage_columns(spark, tmp_path):
    docs = cases.frame(spark, cases.corpus(20)).selectExpr("doc_id", "text", "'aa' AS lang", "n_words", "1 AS score")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_copies_with_null_and_repeated_ids(spark, tmp_path):
    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    rows = [*cases.corpus(), (None, text("p")), (None, text("q")), (None, text("q") + " more"), (5, text("r")), (500, text("r") + " more"), (501, text("s")), (501, text("t"))]
    group = [c for _, _, c in cases.brute_jaccard([(k, t) for k, (_, t) in enumerate(rows)])]
    rank = lambda i, t: (i is None, i or 0, (xxhash.xxh64_intdigest(t.encode(), 42) ^ 1 << 63) if t else 0)
    first = {}
    for row, g in zip(rows, group, strict=True):
        first[g] = min(first.get(g, row), row, key=lambda x: rank(*x))
    expected = [row for row, g in zip(rows, group, strict=True) if not (row[1] or "").split() or row == first[g]]
    got = pipeline.drop_near_copies(spark, cases.frame(spark, rows), str(tmp_path)).select("doc_id", "text").collect()
    cases.same([tuple(r) for r in got], expected)


@pytest.mark.parametrize("block", [1 << 21, 12])
def test_passages_of_many_blocks(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK_WORDS", block)
    words = [f"w{k}" for k in range(60)]
    cut = words[:5] + words[30:35]  # neighbours only after words 5 to 29 are gone
    items = [(1, " ".join(words[5:20])), (2, " ".join(words[15:30])), (3, " ".join(cut)), (4, " ".join(words[40:52]))]
    rows = [(1, " ".join(words)), (2, ", ".join(words[10:26])), (3, None), (4, "clean text"), (None, " ".join(cut))]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.drop_benchmark_passages(spark, cases.frame(spark, rows), str(tmp_path)).select("doc_id", "text").collect()
    assert {r.doc_id: r.text.split() for r in got} == {1: words[:5] + words[30:40] + words[52:], 2: [], 3: [], 4: ["clean", "text"], None: []}
