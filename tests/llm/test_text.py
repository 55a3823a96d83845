import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import chat_format as chat
from rankloom.llm import decontaminate as d
from rankloom.llm import language_id as lang
from rankloom.llm import sentencepiece as sp
from rankloom.llm import token_packing as pack
from rankloom.llm import toxicity as tox
from rankloom.llm.common import public_id
from tests.llm import cases


def benchmark(rows):
    words = [t.split() for _, t in rows[:20]]
    return [(k, " ".join(w[2:20]).title()) for k, w in enumerate(words)] + [(50, " ".join(rows[3][1].split()[:3])), (51, None), (52, ""), (53, "...."), (None, rows[4][1]), (54, " ".join(words[0][2:20]))]


@pytest.mark.parametrize("block", [1 << 21, 25])
def test_decontaminate(spark, block):
    rows = cases.corpus()
    items = benchmark(rows)
    frame = spark.createDataFrame(items, "item_id long, text string")
    out = d.decontaminate(cases.frame(spark, rows), frame, block_words=block).select(public_id().alias("doc_id"), "n_words", "starts", "ends", "items").collect()
    got = [(r.doc_id, r.n_words, sum(r.ends) - sum(r.starts), len(r["items"]), d.items_digest(r["items"]), bool(r.starts)) for r in out]
    cases.same(got, cases.brute_windows(rows, items))
    assert d.decontaminate(cases.frame(spark, rows), frame.limit(0)).where("size(items) > 0").count() == 0
    assert d.decontaminate(cases.frame(spark, []), frame).count() == 0


def test_fm_index():
    rng = random.Random(4)
    seq = [rng.randint(1, 3) for _ in range(200)]
    index = d.FMIndex(np.array(seq))
    patterns = np.array([[rng.randint(1, 5) for _ in range(4)] for _ in range(80)])
    low, high = index.ranges(patterns)
    for p, a, b in zip(patterns.tolist(), low, high, strict=True):
        expected = [k for k in range(197) if seq[k : k + 4] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


def test_strip_spans():
    assert d.strip_spans("Eins, zwei drei; vier!", [1], [3]) == "Eins, ; vier!"


def conversations():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"shared {t}" if t < c % 4 else f"own {c} {t} \\ <s></s>[INST] [/INST]<\\s>") for c in range(40) for t in range(1 + c % 6)]
    return rows + [(90, None, None, None), (90, 1, "assistant", None), (90, 1, "assistant", "b"), (90, 1, "assistant", "b"), (None, 0, "user", "no id"), (91, 0, "assistant", "</s>" * 3 + "日本"), (92, 0, "system", "long " * 5000)]


@pytest.mark.parametrize("size", [256, 3])
def test_chat_round_trip(spark, monkeypatch, size):
    monkeypatch.setattr(chat, "PACK_CONVERSATIONS", size)
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, path int")
    packs = [r.asDict(True) for r in chat.chat_format(frame).collect()]
    whole = {}
    for c, t, role, text in rows:
        whole.setdefault(c, []).append((t, role or "", text or ""))
    got = {c: (turns, losses, n) for p in packs for c, turns, losses, n in chat.read_back(p)}
    got = {None if c == -(2**63) else c: x for c, x in got.items()}
    assert got.keys() == whole.keys()
    for c, turns in whole.items():
        turns = [(r, x) for _, r, x in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))]
        assert got[c][0] == turns
        assert "".join(got[c][1]) == "".join(x for r, x in turns if r == "assistant")
    for p in packs:  # nodes tile the text, positions follow the ancestors, ancestors are earlier
        at = 0
        for node in p["nodes"]:
            assert node["begin"] == at and node["position"] == sum(a["end"] - a["begin"] for a in node["ancestors"])
            at = node["end"]
        assert at == len(p["text"])
    shared = sum(len(p["text"]) for p in packs)
    assert shared < sum(n for _, _, n in got.values())
    assert chat.chat_format(frame.limit(0)).count() == 0


def test_escape():
    for text in ("", "\\", "<s>", "a\\<s>", "<\\s>", "[[INST]]</s></s>", "\\\\[/INST]\\"):
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def viterbi(unit, pieces):
    scores = {p: (i, x) for p, i, x in pieces.rows}
    best = [(0.0, 0, None)]
    for e in range(1, len(unit) + 1):
        top = None
        for s in range(max(0, e - pieces.longest), e):
            found = scores.get(unit[s:e]) or ((None, sp.BYTE_SCORE * len(unit[s].encode())) if e - s == 1 else None)
            if found and (top is None or best[s][0] + found[1] > top[0]):
                top = best[s][0] + found[1], s, found[0]
        best.append(top)
    out, e = [], len(unit)
    while e:
        _, s, i = best[e]
        out = ([i] if i is not None else [pieces.of_byte[b] for b in unit[s:e].encode()]) + out
        e = s
    return out


@pytest.mark.parametrize("table", [1 << 22, 60])
def test_sentencepiece(spark, table):
    rows = [*cases.corpus(25), (400, "  two  blanks \n\n and 🙂 emoji ȸ"), (401, "x" * 300)]
    pieces = sp.Pieces(sp.MODEL)
    out = sp.encode(cases.frame(spark, rows), table=table).select(public_id().alias("doc_id"), "ids", "decoded").collect()
    memory = {}
    expected = []
    for i, t in rows:
        ids = []
        for u in sp.units(t or ""):
            if u not in memory:
                memory[u] = viterbi(u, pieces)
            ids += memory[u]
        expected.append((i, ids, t or ""))
    cases.same([(r.doc_id, np.frombuffer(r.ids, "<i4").tolist(), r.decoded) for r in out], expected)
    assert sp.encode(cases.frame(spark, [])).count() == 0


@pytest.mark.parametrize("table", [1 << 22, 3])
def test_sentencepiece_long_units(spark, table):
    texts = ["-" * 80, "internationalization" * 5, "see " + "=" * 130 + " and " + "." * 65 + "\n" + " " * 90 + "x", "ȸ" * 70 + "é" * 70, "-" * 63, "-" * 64, "short", "-" * 70000]
    pieces = sp.Pieces(sp.MODEL)
    out = sp.encode(cases.frame(spark, list(enumerate(texts))), table=table).select("_id", "ids", "decoded").collect()
    got = {r._id: (np.frombuffer(r.ids, "<i4").tolist(), r.decoded) for r in out}
    assert got == {i: (viterbi(f" {t}", pieces), t) for i, t in enumerate(texts)}


def test_packing(spark):
    rows = cases.corpus(40)
    out = pack.pack_tokens(cases.frame(spark, rows), length=64, batch_tokens=2000).collect()
    encode = pack.Tokenizer(open(pack.VOCABULARY, "rb").read()).encoding.encode_ordinary
    pieces = []
    for r in out:
        ids = np.frombuffer(r.ids, np.uint16)
        assert len(ids) == 64 and r.cu_lengths[-1] == r.n_tokens and r.resets == r.cu_lengths[:-1] and (ids[r.n_tokens :] == 50256).all()
        pieces += [(x.doc_id, x.piece, ids[a : a + x.n].tolist()) for a, x in zip(r.resets, r.segments, strict=True)]
    expected = [(i, k, ids[k * 64 : k * 64 + 64]) for i, t in rows for ids in [encode(t or "")] for k in range(-(-len(ids) // 64))]
    cases.same(pieces, expected)
    assert pack.pack_tokens(cases.frame(spark, [])).count() == 0


def test_best_fit():
    rng = random.Random(0)
    sizes = [rng.randint(1, 50) for _ in range(300)]
    rows = pack.best_fit(sizes, 50)
    rooms, order = [], sorted(range(300), key=lambda i: (-sizes[i], i))
    for i in order:  # the plain search takes as many rows, each as full
        fits = [r for r in rooms if r >= sizes[i]]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 50) - sizes[i])
    assert sorted(i for r in rows for i in r) == list(range(300))
    assert sorted(50 - sum(sizes[i] for i in r) for r in rows) == sorted(rooms)


def labelled(n=400):
    rng = random.Random(9)
    words = {"aa": "alpha beta gamma delta omega kappa".split(), "bb": "éta öre ñandu straße garçon über".split()}
    rows = []
    for i in range(n):
        kind = "aa" if rng.random() < 0.5 else "bb"
        text = [rng.choice(words[kind]) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["rotten", "vile"]))
        rows.append((i, " ".join(text), kind, toxic))
    return rows


def test_language_id(spark):
    rows = labelled()
    extra = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !?", None), (1003, "alpha beta " * 3000, None), (None, "gamma delta", "aa"), (1, rows[1][1], rows[1][2])]
    frame = spark.createDataFrame([(*r[:3], "x") for r in rows] + [(*r, "x") for r in extra], "doc_id long, text string, lang string, score string")
    out = {r.doc_id: r for r in lang.language_id(frame).collect()}
    right = [out[i].lang_pred == kind for i, _, kind, _ in rows if out[i].held_out]
    assert len(right) > 80 and sum(right) >= 0.97 * len(right)
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1003].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in out.values()) and lang.language_id(frame).count() == len(rows) + len(extra)
    assert lang.language_id(frame.limit(0)).count() == 0


def test_network_gradients():
    net = lang.ByteCNN(3, seed=1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rng = np.random.default_rng(2)
    windows, target = rng.integers(0, 256, (4, lang.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])
    loss = lambda: -np.log(net.probabilities(windows)[np.arange(4), target]).mean()
    for name, g in net.gradients(windows, target).items():
        flat = net.weights[name].reshape(-1)
        for at in np.argsort(-np.abs(g).reshape(-1))[:3]:
            old, step = flat[at], 1e-5
            flat[at] = old + step
            up = loss()
            flat[at] = old - step
            down = loss()
            flat[at] = old
            assert abs((up - down) / (2 * step) - g.reshape(-1)[at]) < 1e-4


def test_toxicity(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, 1) for i, t, _, _ in rows] + [(1000, None, 1), (1001, "", 1), (None, "vile", 1), (1002, "alpha " * 90000 + "vile", 1)], "doc_id long, text string, number int")
    labels = spark.createDataFrame([(i, x) for i, _, _, x in rows] + [(5, None), (9999, 1), (None, 1)], "doc_id long, toxic int")
    learn, test = (lambda f: f.where(~lang.held_out(modulus=5, rest=0))), dict(modulus=5, rest=0)
    model = tox.train(learn(docs), learn(labels))
    out = tox.score(docs, model).select(public_id().alias("doc_id"), "score").withColumn("held_out", lang.held_out(**test)).collect()
    score = {r.doc_id: r.score for r in out}
    held = [(score[i] >= 0.5) == bool(x) for i, _, _, x in rows if next(r.held_out for r in out if r.doc_id == i)]
    assert len(held) > 50 and sum(held) >= 0.95 * len(held)
    assert score[1000] == score[1001] < 0.5 and score[1002] > 0.5 and all(0 <= r.score <= 1 for r in out)
    assert tox.score(docs, tox.train(docs, labels.limit(0))).where(F.col("score") > 1e-9).count() == 0
    assert tox.score(docs.limit(0), model).count() == 0
