"""Paths that small inputs don't reach by themselves, and plain versions of the learned operators."""

import random
import re

import numpy as np
import pytest

from rankloom.llm import chat_format as chat
from rankloom.llm import decontaminate as d
from rankloom.llm import jaccard_join as j
from rankloom.llm import kernels
from rankloom.llm import language_id as lang
from rankloom.llm import sentencepiece as sp
from rankloom.llm import suffix_dedup as s
from rankloom.llm import toxicity as tox
from rankloom.llm.common import public_id
from tests.llm import cases
from tests.llm.test_text import benchmark


def spans_of(out):
    return [(None if r._id == -(2**63) else r._id, r.n_bytes, sum(x.end - x.begin for x in r.spans), len(r.spans), cases.sha(bytes(r.kept))) for r in out]


@pytest.mark.parametrize("small", [{"PIECE": 700}, {"HELD": 300, "CHUNK": 500}, {"COMPARED": 64, "SLICE": 16}])
def test_suffix_dedup_in_small_steps(spark, monkeypatch, small):
    for name, value in small.items():
        monkeypatch.setattr(s, name, value)
    rows = cases.corpus()
    cases.same(spans_of(s.suffix_dedup(cases.frame(spark, rows), span=40, anchor=20).collect()), cases.brute_spans(rows, 40))


@pytest.mark.parametrize("group", [2048, 4])
def test_suffix_dedup_of_a_common_passage_with_different_neighbours(spark, group):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage = noise(90)
    rows = [(i, noise(30) + passage + noise(30)) for i in range(60)] + [(100, noise(400))]
    cases.same(spans_of(s.suffix_dedup(cases.frame(spark, rows), span=60, anchor=30, group=group).collect()), cases.brute_spans(rows, 60))


def test_suffix_dedup_of_a_text_over_a_piece(spark):
    rng = random.Random(9)
    passage, long_ = "".join(rng.choice("klmnop") for _ in range(300)), bytearray(rng.choice(b"abcdefgh") for _ in range(s.PIECE + 2000))
    long_[s.PIECE - 150 : s.PIECE + 150] = passage.encode()
    rows = [(1, long_.decode()), (2, passage), (3, "x" * 150)]
    got = {r._id: [(x.begin, x.end) for x in r.spans] for r in s.suffix_dedup(cases.frame(spark, rows)).collect()}
    assert got == {1: [(s.PIECE - 150, s.PIECE + 150)], 2: [(0, 300)], 3: []}


@pytest.mark.parametrize("symbols", [40, 3000, 1 << 20])
def test_decontaminate_shards(spark, monkeypatch, symbols):
    monkeypatch.setattr(d, "SHARD_SYMBOLS", symbols)
    rows = cases.corpus()
    items = benchmark(rows)
    texts = [(t or "").encode() for _, t in rows]
    windows = d.Windows([(i, t.encode()) for i, t in items if i is not None and t])
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 7], pa.binary())], names=["_text"]) for k in range(0, len(texts), 7)]
    found = [(n, sum(b - a for a, b in sp_), len(i)) for _, parts in d.judged(windows, iter(batches)) for n, sp_, i in zip(*parts, strict=True)]
    assert found == [(n, hit, k) for _, n, hit, k, _, _ in cases.brute_windows(rows, items)]


@pytest.mark.parametrize("small", [{"POSTED": 50}, {"JOINED": 1}, {"SMALL": 0}])
def test_jaccard_in_small_steps(spark, monkeypatch, small):
    for name, value in small.items():
        monkeypatch.setattr(j, name, value)
    rows = cases.corpus(30)
    got = j.jaccard_join(cases.frame(spark, rows), k=2).select(public_id().alias("doc_id"), "n_shingles", "component").collect()
    cases.same([tuple(r) for r in got], cases.brute_jaccard(rows, 2))


def test_word_hashes_in_small_blocks(monkeypatch):
    texts = [(t or "").encode() for _, t in cases.corpus(20)]
    whole = kernels.word_hashes(texts)
    monkeypatch.setattr(kernels, "BLOCK", 50)
    assert all((a == b).all() for a, b in zip(whole, kernels.word_hashes(texts), strict=True))


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_units_in_blocks(monkeypatch, block):
    monkeypatch.setattr(sp, "BLOCK", block)
    texts = [t or "" for _, t in cases.corpus(12)[:40]] + ["  two  blanks \n\n and 🙂🙂 emoji", " ", "\n", "a1b2 ", "é" * 100]
    texts = [t[:3000] for t in texts]
    joined, starts, of = sp.join_texts(texts)
    got, hashes = {k: [] for k in range(len(texts))}, {}
    for h, begin, end in sp.unit_spans(joined, starts):
        for key, a, b in zip(h.tolist(), begin.tolist(), end.tolist(), strict=True):
            got[int(of[np.searchsorted(starts, a, side="right") - 1])].append(joined[a:b])
            assert hashes.setdefault(key, joined[a:b]) == joined[a:b]
    assert got == {k: sp.units(t) for k, t in enumerate(texts)}
    assert set(sp.hash_units(sorted(set(hashes.values()))).tolist()) == set(hashes)


def test_deep_conversations_share_their_turns(spark):
    rows = [(c, t, "user", f"turn {t}" if t < 20 else f"own {c}") for c in range(400) for t in range(21)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    packs = [r.asDict(True) for r in chat.chat_format(frame).collect()]
    assert sum(p["text"].count("turn 0[") + p["text"].count("]turn 0<") for p in packs) == len(packs) <= 4
    back = {c: turns for p in packs for c, turns, _, _ in chat.read_back(p)}
    assert back == {c: [("user", f"turn {t}") for t in range(20)] + [("user", f"own {c}")] for c in range(400)}


def test_network_by_loops():
    net = lang.ByteCNN(3, seed=4)
    windows = np.random.default_rng(5).integers(0, 256, (3, lang.WINDOW)).astype(np.uint8)
    w = net.weights
    filters = (w["filters"] * net.mask).reshape(net.wide, lang.EMBEDDING, -1)
    for window, got in zip(windows, net.probabilities(windows), strict=True):
        best = [-np.inf] * net.features
        for at in range(lang.WINDOW - net.wide + 1):
            for f in range(net.features):
                value = w["bias"][f] + sum(float(w["embedding"][window[at + k]] @ filters[k, :, f]) for k in range(net.wide))
                best[f] = max(best[f], value)
        raw = np.maximum(best, 0) @ w["dense"] + w["out"]
        p = np.exp(raw - raw.max())
        assert np.allclose(got, p / p.sum(), atol=1e-4)


def test_toxicity_features_and_scores_by_loops():
    texts = ["You are VILE, vile!", "", "a" * 30, "été  naïve\tx", "日本語 テキスト"]
    every = np.arange(1 << tox.BITS, dtype=np.int32)
    of, number = tox.features_of(texts, every)
    for k, text in enumerate(texts):
        plain = re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\xa9]+", " ", " " + text.lower())
        grams = {plain[a : a + n] for n in tox.ORDERS for a in range(len(plain) - n + 1)}
        # each distinct n-gram has its own number, but for the rare clash of 20 bits
        assert len(grams) - 2 <= (of == k).sum() <= len(grams)
    rng = np.random.default_rng(1)
    model = tox.Model(every, rng.normal(size=1 << tox.BITS), -0.3)
    for k, score in enumerate(model.scores(texts)):
        raw = sum(model.weights[f] for f in number[of == k]) - 0.3
        assert abs(score - 1 / (1 + np.exp(-raw))) < 1e-9


def test_toxicity_of_repeated_rows_and_clashing_names(spark):
    rows = [(i, f"calm words {i % 7} of prose" if i % 3 else f"you vile thing {i % 7}", int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame([(i, t, "x", 2, 3) for i, t, _ in rows + rows[:5]], "doc_id long, text string, _id string, _text int, _toxic int")
    labels = spark.createDataFrame([(i, x, 9) for i, _, x in rows + rows[:5]], "doc_id long, toxic int, _toxic int")
    got = tox.score(docs, tox.train(docs, labels)).collect()
    truth = {i: x for i, _, x in rows}
    assert len(got) == 95 and all((r.score >= 0.5) == bool(truth[r._id]) for r in got)
    assert len({(r._id, r.score) for r in got}) == 90
