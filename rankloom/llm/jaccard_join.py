"""n-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct 5-word shingles, each a 64-bit hash.  Two documents link when
100 * intersection >= 75 * union.  The steps:

1. One pass gives every document its set's signature.  Documents with the same set are one class, and only
   classes are joined.  Order a set's tokens by hash: a set of n tokens can miss e = n - ceil(0.75 n) tokens of a
   partner, so of its first e + l tokens (l = n / 12) l are in the partner too.  These are posted, and a
   class with fewer than l' tokens that any other class has posted, too, links with nothing and is done (l' is
   the l of its smallest partner).  The rest, the survivors, are read again.
2. The survivors' tokens are counted, and each survivor orders its own by count, then hash.  Tokens of
   ``FREQUENT`` survivors and more are the frequent class, the others are rare.  If a set has e + 1 rare tokens,
   the first e + 1 are its prefix, and each is indexed alone.  If not, the prefix is extended into the
   frequent tokens, which are split into groups by hash and indexed as pairs within a group.  A group with c
   prefix tokens can only lose all its pairs when c - 1 of them are missing, so the prefix grows until
   rare + sum(c - 1) > e: two sets that link then share a rare token or a pair.  The number of groups
   follows the size of the set, and so the number of pairs is linear in it; a set is indexed under all
   group counts that a smaller partner may use.
3. Classes under one key are chained in order of size where the sizes allow a link, which keeps them
   connected with one edge for each class, never all pairs.  The components of these edges hold all links.
4. The sets of a component's classes are verified exactly, in blocks: a component of many
   tokens is cut into blocks, and each pair of blocks is one task.  A pair that is known to be
   connected needn't be counted again; all others are.
5. The components of the verified links are the result.

Defined results: a set of one or two tokens links only with an equal set; null and empty texts have an
empty set and link with nothing; repeated rows are members of the same class; a null document id is a
member too, and its component is the smallest id that is not null, or null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, drop_scratch, keyed, partitions, public_id, read_docs, released, scratch, tune
from .components import components, forest
from .kernels import PLACE, mix, shingle_sets

#: Words in a shingle, and the similarity NUM / DEN.
SHINGLE, NUM, DEN = 5, 75, 100
#: Survivors that have a frequent token, at least.
FREQUENT = 16
#: Rows of a table that may be broadcast (about 48 bytes each); a larger one is joined by shuffle.
SMALL = 1 << 20
#: Tokens of the sets in one block of a verification.
BLOCK_TOKENS = 1 << 22
#: Index entries that a task holds before it sends them.
POSTED = 1 << 22
#: Edges of a forest that a task holds.
JOINED = 1 << 19


def needed(n: int, num: int, den: int) -> int:
    """Tokens that a set of n shares with any set it links with, at least."""
    return -(-num * n // den)


def size_bounds(num: int, den: int) -> np.ndarray:
    """First size of each size class; sizes of linked sets lie in the same class or in neighbours."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * den // num + 1)
    return np.array(out, np.int64)


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """A set's two 64-bit hashes; the lower 14 bits of the first are its size, in steps of 1/512 of a doubling."""
    size = int(np.log2(len(tokens)) * 512)
    a, b = (int(mix(np.array([np.sum(mix(tokens ^ PLACE[k])) + np.uint64(len(tokens))], np.uint64))[0]) for k in (60, 61))
    return (a >> 14 << 14 | size) - (1 << 63), b - (1 << 63)


def spare(n: int) -> int:
    """Tokens beyond the ones that may be missing that a set of n posts."""
    return max(1, n // 12)


def describe(k: int):
    """A row for each document."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(binaries(batch.column("_text")), k)
            signs = [signature(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_key"), *(pa.array([s[j] for s in signs], pa.int64()) for j in (0, 1)), pa.array([len(s) for s in sets], pa.int64())],
                                             names=["_id", "_key", "sid", "sid2", "n"])

    return run


def bucket_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """By bits 31 to 62 of the token; bits 0 to 39 travel."""
    return ((tokens >> np.uint64(31) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def deal(buckets: int, of: np.ndarray, columns: list[np.ndarray], of_more: np.ndarray, more: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    """Blobs by bucket, each with two tables of columns."""
    order, order_more = np.argsort(of, kind="stable"), np.argsort(of_more, kind="stable")
    cut, cut_more = np.searchsorted(of[order], np.arange(buckets + 1)), np.searchsorted(of_more[order_more], np.arange(buckets + 1))
    columns, more = [c[order] for c in columns], [c[order_more] for c in more]
    at, blobs = [], []
    for b in range(buckets):
        n, m = int(cut[b + 1] - cut[b]), int(cut_more[b + 1] - cut_more[b])
        if n or m:
            parts = [c[cut[b] : cut[b + 1]].tobytes() for c in columns] + [c[cut_more[b] : cut_more[b + 1]].tobytes() for c in more]
            at.append(b)
            blobs.append(b"".join([n.to_bytes(4, "little"), m.to_bytes(4, "little"), *parts]))
    return at, blobs


def gather(blobs: list[bytes], kinds: list[str], kinds_more: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The two tables of many blobs."""
    found: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in [*kinds, *kinds_more]]
    for blob in blobs:
        n, m = (int.from_bytes(blob[k : k + 4], "little") for k in (0, 4))
        at = 8
        for column, (kind, size) in enumerate([*((k, n) for k in kinds), *((k, m) for k in kinds_more)]):
            found[column].append(np.frombuffer(blob, kind, size, at))
            at += size * np.dtype(kind).itemsize
    columns = [np.concatenate(f) for f in found]
    return columns[: len(kinds)], columns[len(kinds) :]


def travelling(tokens: np.ndarray) -> list[np.ndarray]:
    return [(tokens >> np.uint64(8)).astype(np.uint32), tokens.astype(np.uint8)]


def arrived(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.uint64) << np.uint64(8) | low


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of the runs of equal values."""
    begin = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(values)))


def announce(k: int, num: int, den: int, buckets: int):
    """Step 1: blobs of (token, signature) by bucket of the token; tokens that repeat in the buffer are settled here and sent once."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        sids: list[np.ndarray] = []
        size, seen = 0, set()

        def flush() -> pa.RecordBatch:
            token, sid = np.concatenate(tokens), np.concatenate(sids)
            order = np.argsort(token)
            token, sid = token[order], sid[order]
            begin, counts = runs(token)
            again = np.repeat(counts > 1, counts)
            hit, hits = np.unique(sid[again], return_counts=True)
            sid[begin[counts > 1]] = 0  # stands for all of them
            keep = ~again
            keep[begin] = True
            token, sid = token[keep], sid[keep]
            at, blobs = deal(buckets, bucket_of(token, buckets), [*travelling(token), sid], hit % buckets, [hit, hits.astype(np.uint32)])
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for s in shingle_sets(binaries(batch.column("_text")), k):
                n = len(s)
                if n > 2 and (sid := signature(s)[0]) not in seen:
                    seen.add(sid)
                    tokens.append(s[: n - needed(n, num, den) + spare(n)])
                    sids.append(np.full(len(tokens[-1]), sid, np.int64))
                    size += len(tokens[-1])
            if size > POSTED:
                yield flush()
                tokens, sids, size, seen = [], [], 0, set()
        if size:
            yield flush()

    return run


def count_hits(buckets: int):
    """How many tokens of a bucket each class shares with another, as blobs by bucket of the class."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b for batch in batches for b in batch.column("blob").to_pylist()]
        (high, low, sid), (more, hits) = gather(blobs, ["u4", "u1", "i8"], ["i8", "u4"])
        del blobs
        token = arrived(high, low)
        order = np.argsort(token)
        token, sid = token[order], sid[order]
        counts = runs(token)[1]
        found = sid[np.repeat(counts > 1, counts)]
        found, n = np.unique(found[found != 0], return_counts=True)
        found, n = np.concatenate([found, more]), np.concatenate([n.astype(np.uint32), hits])
        at, out = deal(buckets, found % buckets, [found, n], np.zeros(0, np.int64), [])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out, pa.binary())], names=["bucket", "blob"])

    return run


@released
def add_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, hits) of a bucket's classes."""
    blobs = [b for batch in batches for b in batch.column("blob").to_pylist()]
    (sid, n), _ = gather(blobs, ["i8", "u4"], [])
    order = np.argsort(sid, kind="stable")
    sid, n = sid[order], n[order].astype(np.int64)
    begin = runs(sid)[0]
    if len(begin):
        sid, n = sid[begin], np.add.reduceat(n, begin)
    for lo in range(0, len(sid), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(sid[lo : lo + (1 << 17)]), pa.array(n[lo : lo + (1 << 17)])], names=["sid", "hits"])


def ask_counts(buckets: int):
    """Step 2: blobs of (token, class, place in its set) by bucket; tokens that are frequent in the buffer alone are settled here."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        cids: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            token, sizes = np.concatenate(held), np.array([len(h) for h in held])
            cid = np.repeat(np.array(cids, np.int64), sizes)
            place = (np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint32)
            order = np.argsort(token, kind="stable")
            begin, counts = runs(token[order])
            often = np.zeros(len(token), bool)
            often[order] = np.repeat(counts >= FREQUENT, counts)
            first = order[begin[counts >= FREQUENT]]
            # the first of them goes along with a place that says so
            told = np.full(len(first), 0xFFFFFFFF, np.uint32)
            send = np.flatnonzero(~often)
            token_ = np.concatenate([token[send], token[first]])
            at, blobs = deal(buckets, bucket_of(token_, buckets), [*travelling(token_), np.concatenate([cid[send], cid[first]]), np.concatenate([place[send], told])], cid[often] % buckets, [cid[often], place[often]])
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for cid, blob in zip(batch.column("cid").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                held.append(np.frombuffer(blob, np.uint64))
                cids.append(cid)
                size += len(held[-1])
            if size > POSTED:
                yield flush()
                held, cids, size = [], [], 0
        if size:
            yield flush()

    return run


def answer_counts(buckets: int):
    """Blobs of (class, place, count) by bucket of the class, for tokens with a count of two or more."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b for batch in batches for b in batch.column("blob").to_pylist()]
        (high, low, cid, place), (more, more_place) = gather(blobs, ["u4", "u1", "i8", "u4"], ["i8", "u4"])
        del blobs
        token = arrived(high, low)
        order = np.argsort(token)
        counts = runs(token[order])[1]
        known = np.maximum.reduceat((place[order] == 0xFFFFFFFF).astype(np.uint8), np.cumsum(counts) - counts) if len(counts) else counts
        count = np.empty(len(token), np.uint8)
        count[order] = np.repeat(np.where(known > 0, FREQUENT, np.minimum(counts, FREQUENT)), counts)
        keep = (count > 1) & (place != 0xFFFFFFFF)
        cid, place, count = np.concatenate([cid[keep], more]), np.concatenate([place[keep], more_place]), np.concatenate([count[keep], np.full(len(more), FREQUENT, np.uint8)])
        order = np.lexsort((place, cid))
        cid, place, count = cid[order], place[order], count[order]
        none = np.zeros(0, np.int64)
        at, out = deal(buckets, cid % buckets, [cid, place, count], none, [])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out, pa.binary())], names=["bucket", "blob"])

    return run


def prefix_keys(tokens: np.ndarray, counts: np.ndarray, bounds: np.ndarray, num: int, den: int) -> np.ndarray:
    """The index keys of a set sorted by hash, with the count of each token."""
    n = len(tokens)
    want = n - needed(n, num, den) + 1
    order = np.lexsort((tokens, counts))
    tokens, often = tokens[order], counts[order] >= FREQUENT
    rare = tokens[~often][:want]
    if len(rare) == want:
        return mix(rare)
    often = tokens[often]
    missing = want - len(rare)
    keys = [mix(rare)]
    first, last = np.searchsorted(bounds, [needed(n, num, den), n], side="right") - 1
    for size in range(int(first), int(last) + 1):
        groups = max(1, int(bounds[size]) // 24)
        group = (often >> np.uint64(20)) % np.uint64(groups)
        # the prefix grows token by token until the groups together can lose `missing` pairs and still keep one
        order = np.argsort(group, kind="stable")
        g = group[order]
        begin = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        place = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
        worth = np.empty(len(g), np.int64)
        worth[order] = place > 0  # a group's first token makes no pair
        end = int(np.searchsorted(np.cumsum(worth), missing)) + 1
        inside = order[order < end]
        t, g = often[inside], group[inside]
        salt = mix(np.array([size], np.uint64))
        step = 1
        while step < len(t):
            same = g[step:] == g[:-step]
            if not same.any():
                break
            a, b = t[:-step][same], t[step:][same]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            keys.append(mix(mix(lo + salt) + hi * PLACE[62]))
            step += 1
    return np.concatenate(keys)


def post(num: int, den: int, buckets: int):
    """Step 2, indexing: of a bucket's counts (first) and sets, blobs of (40 bits of the key, signature) by bucket of the key."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = size_bounds(num, den)
        counted: list[bytes] = []
        table = None
        keys: list[np.ndarray] = []
        sids: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            key, sid = np.concatenate(keys), np.concatenate(sids)
            at, blobs = deal(buckets, bucket_of(key, buckets), [*travelling(key), sid], np.zeros(0, np.int64), [])
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for sid, cid, blob, tokens in zip(*(batch.column(c).to_pylist() for c in ("sid", "cid", "blob", "tokens")), strict=True):
                if blob is not None:
                    counted.append(blob)
                    continue
                if table is None:
                    table = gather(counted, ["i8", "u4", "u1"], [])[0]
                    order = np.argsort(table[0], kind="stable")
                    table = [c[order] for c in table]
                    counted.clear()
                tokens = np.frombuffer(tokens, np.uint64)
                counts = np.ones(len(tokens), np.uint8)
                a, b = np.searchsorted(table[0], [cid, cid + 1])
                counts[table[1][a:b]] = table[2][a:b]
                keys.append(prefix_keys(tokens, counts, bounds, num, den))
                sids.append(np.full(len(keys[-1]), sid, np.int64))
                size += len(keys[-1])
            if size > POSTED:
                yield flush()
                keys, sids, size = [], [], 0
        if size:
            yield flush()

    return run


def chain(num: int, den: int, slots: int):
    """Of a bucket's index entries, a forest of the edges between classes next to each other in size under one key, as a blob."""
    gap = int(np.ceil(np.log2(den / num) * 512)) + 1

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b for batch in batches for b in batch.column("blob").to_pylist()]
        if not blobs:
            return
        (high, low, sid), _ = gather(blobs, ["u4", "u1", "i8"], [])
        key = arrived(high, low)
        del blobs
        size = (sid & (1 << 14) - 1).astype(np.uint64)
        order = np.argsort(key << np.uint64(14) | size, kind="stable")
        key, sid, size = key[order], sid[order], size[order].astype(np.int64)
        near = (key[1:] == key[:-1]) & (sid[1:] != sid[:-1]) & (size[1:] - size[:-1] <= gap)
        a, b = sid[1:][near], sid[:-1][near]
        if len(a):
            a, b = forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % slots], pa.int32()), pa.array([np.concatenate([a, b]).tobytes()], pa.binary())], names=["slot", "blob"])

    return run


@released
def join_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of some buckets' forests: most buckets hold the same groups.  One of more than JOINED edges is sent as it is."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            more = np.frombuffer(blob, np.int64).reshape(2, -1)
            a, b = forest(np.concatenate([a, more[0]]), np.concatenate([b, more[1]]))
            if len(a) > JOINED:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                a = b = np.zeros(0, np.int64)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


class Verifier:
    """Exact links of sets, added one by one; sets that are connected aren't compared again."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int) -> None:
        self.sets, self.num, self.den = sets, num, den
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order]
        # only tokens of two sets or more count towards an intersection
        cut = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        self.token, self.begin = tokens[cut], np.append(cut, len(tokens))

    def overlaps(self, at: int) -> np.ndarray:
        """Sizes of the intersections of a set with all."""
        where = np.searchsorted(self.token, self.sets[at])
        a, n = self.begin[where], self.begin[where + 1] - self.begin[where]
        rows = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.owner[rows], minlength=len(self.sets))

    def links(self, x: int, others: np.ndarray, overlap: np.ndarray) -> np.ndarray:
        return others[self.den * overlap >= self.num * (self.sizes[x] + self.sizes[others] - overlap)]

    def linked(self, x: int, y: int) -> bool:
        a, b = self.sets[x], self.sets[y]
        if self.den * min(len(a), len(b)) < self.num * max(len(a), len(b)):
            return False
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        both = int((b[at] == a).sum())
        return self.den * both >= self.num * (len(a) + len(b) - both)

    def edges(self, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        """A forest of the links between left and right (index arrays; the same array for links within)."""
        of, out, hubs = np.arange(len(self.sets)), [], []  # the group of each set

        def unite(x: int, y: int) -> None:
            if of[x] != of[y]:
                of[of == of[y]] = of[x]
                out.append((x, y))

        for x in left.tolist():
            # the sets that have linked most others so far are tried first
            for y in hubs[:4]:
                if of[x] != of[y] and self.linked(x, y):
                    unite(x, y)
            rest = right[of[right] != of[x]]
            if not len(rest):
                continue
            if len(rest) > 8:
                found = self.links(x, rest, self.overlaps(x)[rest])
            else:
                found = np.array([y for y in rest.tolist() if self.linked(x, y)], np.int64)
            for y in found.tolist():
                unite(x, y)
            if len(found) > 1:
                hubs.insert(0, x)
        return out


def verify(num: int, den: int):
    """Groups (comp, left, right) of rows (side, class id, set) -> links of class ids."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sides, sets = None, [], [], []

        def flush():
            first = dict(zip(ids[::-1], range(len(ids) - 1, -1, -1), strict=True))  # repeated rows of a class are one
            at = np.array(sorted(first.values()), np.int64)
            if len(at) < 2:
                return None
            both = Verifier([np.frombuffer(sets[i], np.uint64) for i in at], num, den)
            side = np.array([sides[i] for i in at])
            within = group[1] == group[2]
            order = np.argsort(-both.sizes, kind="stable")
            left = order if within else order[side[order] == 0]
            right = order if within else order[side[order] == 1]
            found = both.edges(left, right) if len(left) and len(right) else []
            names = [ids[i] for i in at]
            return pa.RecordBatch.from_arrays([pa.array([names[x] for x, _ in found], pa.int64()), pa.array([names[y] for _, y in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for comp, left, right, side, cid, blob in zip(*(batch.column(c).to_pylist() for c in ("comp", "left", "right", "side", "cid", "tokens")), strict=True):
                if (comp, left, right) != group:
                    if ids and (found := flush()) is not None:
                        yield found
                    group, ids, sides, sets = (comp, left, right), [], [], []
                ids.append(cid)
                sides.append(side)
                sets.append(blob)
        if ids and (found := flush()) is not None:
            yield found

    return run


def fetch_sets(k: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [s.tobytes() for s in shingle_sets(binaries(batch.column("_text")), k)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("sid", "cid")), pa.array(blobs, pa.binary())], names=["sid", "cid", "tokens"])

    return run


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """Every row of ``docs`` as (_id, _key, n_shingles, component, root): the smallest id reachable by links.

    ``root`` tells groups apart where ids are null or repeat; it is null for an empty set.
    """
    spark = tune(docs.sparkSession)
    parts = partitions(spark)
    rows = keyed(docs, id_col, text_col)
    described = scratch(rows.mapInArrow(describe(k), "_id long, _key long, sid long, sid2 long, n long").withColumn("cid", F.xxhash64("sid", "sid2")), "jaccard-sets")

    # 1: classes that share enough with any other
    posted = rows.select("_text").mapInArrow(announce(k, num, den, parts), "bucket int, blob binary").repartition(parts, "bucket")
    hits = posted.mapInArrow(count_hits(parts), "bucket int, blob binary").repartition(parts, "bucket").mapInArrow(add_hits, "sid long, hits long")
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * num / den) / 12))
    classes = described.where("n > 2").groupBy("sid", "cid").agg(F.min(F.struct("_id", "_key")).alias("doc"), F.first("n").alias("n"))
    survivors = scratch(classes.join(hits, "sid").where(F.col("hits") >= least).select("sid", "cid", "n", "doc._id", "doc._key"), "jaccard-survivors")
    wanted = survivors.select("sid", "cid", "_id", "_key")
    if survivors.count() <= SMALL:
        wanted = F.broadcast(wanted)
    sets = scratch(rows.join(wanted, ["_id", "_key"]).select("sid", "cid", "_text").mapInArrow(fetch_sets(k), "sid long, cid long, tokens binary"), "jaccard-tokens")

    # 2 and 3: candidates
    asked = sets.mapInArrow(ask_counts(parts), "bucket int, blob binary").repartition(parts, "bucket")
    counts = asked.mapInArrow(answer_counts(parts), "bucket int, blob binary").select("bucket", F.lit(None).cast("long").alias("sid"), F.lit(None).cast("long").alias("cid"), "blob", F.lit(None).cast("binary").alias("tokens"))
    own = sets.select(F.pmod("cid", F.lit(parts)).cast("int").alias("bucket"), "sid", "cid", F.lit(None).cast("binary").alias("blob"), "tokens")
    met = counts.unionByName(own).repartition(parts, "bucket").sortWithinPartitions(F.col("blob").isNull())
    keys = met.mapInArrow(post(num, den, parts), "bucket int, blob binary").repartition(parts, "bucket")
    slots = max(1, round(parts**0.5))
    forests = keys.mapInArrow(chain(num, den, slots), "slot int, blob binary").repartition(slots, "slot")
    near = components(forests.mapInArrow(join_forests, "a long, b long"), thinned=True)

    # 4: each set goes to all pairs of blocks that its own block is part of
    found = scratch(survivors.join(near.select(F.col("node").alias("sid"), F.col("root").alias("comp")), "sid").select("comp", "cid", "n", "_id"), "jaccard-candidates")
    blocks = found.groupBy("comp").agg(F.count("*").alias("c"), F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS), F.lit(1)).cast("int").alias("blocks")).where("c > 1").drop("c")
    chosen = sets.select("cid", "tokens").join(found.join(blocks, "comp").select("comp", "cid", "blocks"), "cid")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = chosen.withColumn("own", own).withColumn("other", other).select(
        "comp", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cid", "tokens")
    links = dealt.repartition(parts, "comp", "left", "right").sortWithinPartitions("comp", "left", "right").mapInArrow(verify(num, den), "a long, b long")
    linked = components(links)

    names = found.select(F.col("cid").alias("node"), "_id").join(linked, "node")
    least = names.groupBy("root").agg(F.min(public_id()).alias("least"))
    joined = scratch(names.join(least, "root").select(F.col("node").alias("cid"), "least", "root"), "jaccard-links")
    drop_scratch(sets, found, survivors)
    alone = described.groupBy("cid").agg(F.min(public_id()).alias("own"))
    final = alone.join(joined, "cid", "left").select("cid", F.coalesce("least", "own").alias("component"), F.coalesce("root", "cid").alias("root"))
    whole = described.where("n > 0").join(final, "cid").select("_id", "_key", F.col("n").alias("n_shingles"), "component", "root")
    return whole.unionByName(described.where("n = 0").select("_id", "_key", F.col("n").alias("n_shingles"), public_id().alias("component"), F.lit(None).cast("long").alias("root")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_docs(spark, sf_dir)).select(public_id().alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


#: The same in DuckDB.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(y) FROM reach WHERE reach.x = d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
"""
