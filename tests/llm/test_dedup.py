import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from rankloom.llm import embedding_dedup as e
from rankloom.llm import jaccard_join as j
from rankloom.llm import line_dedup as lines
from rankloom.llm import suffix_dedup as s
from rankloom.llm.common import keyed, public_id
from rankloom.llm.components import components
from tests.llm import cases

EMPTY = "doc_id long, text string"


@pytest.mark.parametrize("min_docs", [2, 5, 15])
def test_lines_frequent(spark, min_docs):
    rows = cases.corpus()
    got = lines.line_dedup(cases.frame(spark, rows), min_docs=min_docs).select(public_id().alias("doc_id"), "n_lines", "n_dropped", "kept").collect()
    cases.same([(r[0], r[1], r[2], cases.sha(r[3])) for r in got], cases.brute_lines(rows, min_docs))


def test_lines_first(spark):
    rows = [(i, t) for i, t in cases.corpus() if i is not None and (i, t) != (7, "another text for the same id")]
    rows = list({i: t for i, t in rows}.items())
    seen, expected = set(), []
    for i, t in sorted(rows):
        kept = []
        for line in (t or "").split("\n"):
            key = cases.lower(line).strip(" \t\n\x0b\x0c\r")
            if not key or key not in seen:
                kept.append(line)
            if key:
                seen.add(key)
        expected.append((i, "\n".join(kept)))
    got = lines.line_dedup(cases.frame(spark, rows), mode="first").select("_id", "kept").collect()
    cases.same([tuple(r) for r in got], expected)


def test_lines_one_hot_line_over_many_partitions(spark):
    rows = [(i, "the same line\n" + f"own line {i}") for i in range(3000)]
    got = lines.line_dedup(cases.frame(spark, rows), min_docs=2900).select("n_dropped").distinct().collect()
    assert [r[0] for r in got] == [1]
    first = lines.line_dedup(cases.frame(spark, rows), mode="first").where("n_dropped = 0").select("_id").collect()
    assert [r[0] for r in first] == [0]


def test_bitmap_round_trip():
    keep = lines.decode_bitmap(lines.encode_bitmap(19, [0, 3, 18]))
    assert [k for k in range(19) if not keep[k]] == [0, 3, 18]


@pytest.mark.parametrize(("span", "group"), [(200, 8192), (40, 8192), (40, 1)])
def test_suffix_dedup(spark, span, group):
    rows = cases.corpus()
    out = s.suffix_dedup(cases.frame(spark, rows), span=span, anchor=span // 2, group=group).collect()
    got = [(None if r._id == -(2**63) else r._id, r.n_bytes, sum(x.end - x.begin for x in r.spans), len(r.spans), cases.sha(bytes(r.kept))) for r in out]
    cases.same(got, cases.brute_spans(rows, span))


def test_maximal_repeats_have_all_occurrences():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(6)]
    found = {}
    for length, which, offset in s.maximal_repeats(texts, 5):
        places = set(zip(which.tolist(), offset.tolist(), strict=True))
        strings = {texts[w][o : o + length] for w, o in places}
        assert len(strings) == 1
        found[strings.pop()] = places
    for text, places in found.items():
        assert places == {(w, o) for w, t in enumerate(texts) for o in range(len(t) - len(text) + 1) if t[o : o + len(text)] == text}
    # every repeated 5-byte string lies in a group
    for w, t in enumerate(texts):
        for o in range(len(t) - 4):
            if sum(u[x : x + 5] == t[o : o + 5] for u in texts for x in range(len(u) - 4)) > 1:
                assert any((w, p) in places and p <= o and o + 5 <= p + len(text) for text, places in found.items() for p in range(o + 1))


@pytest.mark.parametrize("group", [8192, 1])
def test_repeat_groups_have_all_occurrences(spark, group):
    rows, span = cases.corpus(), 40
    docs = cases.frame(spark, rows)
    texts = [(r._id, r._key, (r._text or "").encode()) for r in keyed(docs).collect()]
    at = {(i, key): text for i, key, text in texts}
    groups, found = defaultdict(Counter), {(i, key): bytearray(len(text)) for i, key, text in texts}
    for r in s.repeat_groups(docs, span=span, anchor=span // 2, group=group).collect():
        text = at[r._id, r._key][r.begin : r.begin + r.length]
        groups[r.repeat, text][r._id, r._key, r.begin] += 1
        found[r._id, r._key][r.begin : r.begin + r.length] = b"\1" * r.length
    assert len({name for name, _ in groups}) == len({text for _, text in groups}) == len(groups) > 0
    for (_, text), places in groups.items():
        assert len(text) >= span
        every = Counter((i, key, o) for i, key, t in texts for o in range(len(t) - len(text) + 1) if t.startswith(text, o))
        assert places == every
        assert sum(every.values()) > 1
    for out in s.suffix_dedup(docs, span=span, anchor=span // 2).select("_id", "_key", "spans").collect():
        gone = bytearray(len(at[out._id, out._key]))
        for x in out.spans:
            gone[x.begin : x.end] = b"\1" * (x.end - x.begin)
        assert gone == found[out._id, out._key]


@pytest.mark.parametrize("k", [5, 2])
def test_jaccard(spark, k):
    rows = cases.corpus()
    got = j.jaccard_join(cases.frame(spark, rows), k=k).select(public_id().alias("doc_id"), "n_shingles", "component").collect()
    cases.same([tuple(r) for r in got], cases.brute_jaccard(rows, k))


def test_jaccard_frequent_tokens(spark, monkeypatch):
    """All tokens are frequent, so that every set is indexed by pairs."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(80):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words[: rng.randint(45, 60)])))
    got = j.jaccard_join(cases.frame(spark, rows)).select("_id", "n_shingles", "component").collect()
    cases.same([tuple(r) for r in got], cases.brute_jaccard(rows))


def test_jaccard_blocks(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK_TOKENS", 300)
    rows = cases.corpus(30)
    rows += [(1000 + k, rows[5][1].replace(" ", f" new{k} ", 1)) for k in range(12)]
    got = j.jaccard_join(cases.frame(spark, rows), k=2).select(public_id().alias("doc_id"), "n_shingles", "component").collect()
    cases.same([tuple(r) for r in got], cases.brute_jaccard(rows, 2))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, 5001 + k) for k in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for edge in edges for x in edge if edge[0] != edge[1]})
    at = {x: k for k, x in enumerate(nodes)}
    groups = cases.components(len(nodes), [(at[a], at[b]) for a, b in edges if a != b])
    assert got == {x: nodes[min(groups[at[x]])] for x in nodes}


@pytest.mark.parametrize("settings", [{}, {"PER_PIVOT": 10}, {"PER_PIVOT": 20, "BLOCK": 8}])
def test_embeddings(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(e, name, value)
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        v = rng.normal(size=8)
        rows += [(10 * i + k, (v + rng.normal(size=8) * 0.12 * k).tolist(), i % 3) for k in range(3)]
    rows += [(2000, rows[0][1], 0), (2001, [2 * x for x in rows[0][1]], 0), (0, rows[0][1], 0), (None, rows[0][1], 0), (2002, rows[0][1], None), (2003, None, 0), (2004, [], 0), (2005, [0.0] * 8, 0),
             (2006, [None] + [1.0] * 7, 0), (2007, [float("nan")] + [1.0] * 7, 0), (2008, [float("inf")] + [1.0] * 7, 0), (2009, [1.0, 2.0], 0), (2010, [1.0, 2.0], 0), (2011, [-x for x in rows[0][1]], 0)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, cls int")
    good = lambda r: r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
    links = []
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a], rows[b]
            if good(x) and good(y) and x[2] == y[2] and len(x[1]) == len(y[1]) and np.dot(x[1], y[1]) / np.linalg.norm(x[1]) / np.linalg.norm(y[1]) >= 0.98:
                links.append((a, b))
    groups = cases.components(len(rows), links)
    n = [sum(k in link for link in links) for k in range(len(rows))]
    expected = [(rows[k][0], n[k], min((rows[x][0] for x in groups[k] if rows[x][0] is not None), default=None)) for k in range(len(rows))]
    cases.same([tuple(r) for r in e.embedding_dedup(frame).select("_id", "n_links", "component").collect()], expected)


def test_empty_tables(spark):
    none = spark.createDataFrame([], EMPTY)
    assert lines.line_dedup(none).count() == 0
    assert s.suffix_dedup(none).count() == 0
    assert s.repeat_groups(none).count() == 0
    assert j.jaccard_join(none).count() == 0
    assert e.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
