"""Small corpora with nulls, empty and long texts, ties and repeated rows, and brute-force versions of the operators."""

import hashlib
import random
import re
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, _id string, _text int, n_words double, spans string"


def corpus(n=60, seed=3):
    """Documents that share lines, passages and most of their words; with copies, nulls and odd texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 7))) for _ in range(400)] + ["Été", "naïve", "x7"]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared, passage = [line(8) for _ in range(3)], line(70)
    out = []
    for i in range(n):
        parts = [line(rng.randint(3, 30)) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), "  " + shared[i % 2].upper() + "\t")
        if i % 7 == 0:
            parts.append(passage)
        out.append((i, "\n".join(parts)))
    base = out[5][1]
    for k in range(4):
        words_ = base.split(" ")
        words_[rng.randrange(len(words_))] = f"new{k}"
        out.append((100 + k, " ".join(words_)))
    out += [(200, out[7][1]), (201, out[7][1]), (7, out[7][1]), (7, "another text for the same id"), (300, None), (301, ""), (302, "\n\n"), (303, "..!"), (304, "one two three"), (305, "one two three"),
            (None, out[9][1]), (None, None), (306, line(6000)), (307, "ab" * 700), (308, "日本語 テキスト " * 40)]
    return out


def frame(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 0.5, None) for i, t in rows], DOCS)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def same(got, expected):
    """Equal as bags."""
    assert Counter(map(repr, got)) == Counter(map(repr, expected))


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    groups = defaultdict(list)
    for x in range(n):
        groups[find(x)].append(x)
    return {x: g for g in groups.values() for x in g}


def brute_lines(rows, min_docs, mode="frequent"):
    keys = [[lower(x).strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n")] for _, t in rows]
    docs = defaultdict(set)
    for (i, _), ks in zip(rows, keys):
        for k in ks:
            docs[k].add(i)
    out = []
    for (i, t), ks in zip(rows, keys):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, ks) if not k or len(docs[k]) < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def brute_windows(rows, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    found = defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text))
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if k and item is not None else 0):
            found[tuple(w[a : a + k])].add(item)
    out = []
    for i, text in rows:
        w, hit, which = word.findall(lower(text)), set(), set()
        for k in {len(x) for x in found}:
            for a in range(len(w) - k + 1):
                if owners := found.get(tuple(w[a : a + k])):
                    which |= owners
                    hit |= set(range(a, a + k))
        out.append((i, len(w), len(hit), len(which), sha(",".join(sorted(map(str, which)))), bool(hit)))
    return out


def brute_spans(rows, span):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[s : s + span] for t in texts for s in range(len(t) - span + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for s in range(len(t) - span + 1):
            if seen[t[s : s + span]] > 1:
                gone[s : s + span] = b"\1" * span
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def brute_jaccard(rows, k=5, num=75, den=100):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    groups = components(len(rows), links)
    least = lambda g: min((rows[x][0] for x in g if rows[x][0] is not None), default=None)
    return [(rows[x][0], len(sets[x]), least(groups[x])) for x in range(len(rows))]
