"""Embedding near-dedup: an exact metric range join of vectors by cosine.

Vectors of the same label and length link when their cosine is at least ``min_cosine``, which for unit
vectors is a distance of at most eps = sqrt(2 - 2 * min_cosine).  Equal vectors become one class first.  A
bounded number of pivots (the classes with the smallest hashes) cuts the space: a vector's home is the cell
of its nearest pivot.  It is copied to every other cell that may hold a partner: by the triangle inequality
its distance to that pivot is at most 2 eps more than to its own, and its distance to the plane between
the two pivots is at most eps.  So all partners of a vector are in its home cell, and each cell is joined
on its own, by matrix products in double precision.  There are as many pivots as the largest label needs.  The vectors at
home in a cell and all vectors of it are cut into blocks of ``BLOCK``, each pair of which is one task.  Only counts and a spanning forest of the links leave a task.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors
without a label, link with nothing; rows that repeat a vector, or even its id, are vectors of their own
that link; null ids are kept as null, and count for a component's id only if it has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_scratch, partitions, read_docs, released, scratch
from .components import components

#: Cosine from which on two vectors link.
MIN_COSINE = 0.98
#: Classes of the largest label for one pivot, pivots at most, and vectors in one block of a cell.
PER_PIVOT, MAX_PIVOTS, BLOCK = 2000, 256, 4096


def assign(pivots: list[np.ndarray], min_cosine: float):
    """Rows (cls, label, n, v) -> (cls, label, dim, cell, home, n, unit vector) for each cell that a vector goes to."""
    eps = float(np.sqrt(2 - 2 * min_cosine)) + 1e-9
    by_dim = {d: np.array([p / np.linalg.norm(p) for p in pivots if len(p) == d]) for d in {len(p) for p in pivots}}

    def cells(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = by_dim.get(unit.shape[1])
        if p is None:
            return np.zeros(len(unit), np.int64), np.ones((len(unit), 1), bool)
        dots = unit @ p.T
        home = dots.argmax(axis=1)
        best = dots[np.arange(len(unit)), home][:, None]
        far = np.sqrt(np.maximum(0, 2 - 2 * dots))
        gap = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[home]  # between the pivots
        near = (far <= np.sqrt(np.maximum(0, 2 - 2 * best)) + 2 * eps) & (best - dots <= eps * gap + 1e-12)
        near[np.arange(len(unit)), home] = True
        return home, near

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cls", "label", "dim", "cell", "home", "n", "unit"]
        for batch in batches:
            vectors = batch.column("v").to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                unit = np.array([vectors[i] for i in rows], np.float64)
                unit /= np.abs(unit).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                home, near = cells(unit)
                for lo in range(0, len(rows), 256):
                    row, cell = np.nonzero(near[lo : lo + 256])
                    row += lo
                    take = pa.array(rows[row])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("cls").take(take), batch.column("label").take(take), pa.array(np.full(len(row), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(cell == home[row]),
                         batch.column("n").take(take), pa.array([unit[i].tobytes() for i in row], pa.binary())], names=names)

    return run


def block_links(home: np.ndarray, home_cls: list[int], member: np.ndarray, member_cls: list[int], weight: np.ndarray, min_cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For each home vector the weight of its links; a forest of the links as pairs of classes."""
    counts, edges = np.zeros(len(home), np.int64), []
    place = {c: i for i, c in enumerate(member_cls)}
    names = np.array(member_cls + [c for c in home_cls if c not in place])
    place |= {c: len(member_cls) + i for i, c in enumerate(names[len(member_cls) :].tolist())}
    of = np.arange(len(names))
    for lo in range(0, len(home), 512):
        linked = home[lo : lo + 512] @ member.T >= min_cosine
        counts[lo : lo + 512] = linked @ weight
        for i in np.flatnonzero(linked.sum(axis=1) > 1 - (len(names) > len(member_cls))) + lo:
            me = place[home_cls[i]]
            roots, first = np.unique(of[linked[i - lo].nonzero()[0]], return_index=True)
            if len(roots) and (len(roots) > 1 or roots[0] != of[me]):
                others = linked[i - lo].nonzero()[0][first]
                edges += [(home_cls[i], int(names[o])) for o in others if of[o] != of[me]]
                of[np.isin(of, np.append(roots, of[me]))] = min(int(roots[0]), int(of[me]))
    return counts, edges


def join_cells(min_cosine: float):
    """Rows in order of (label, dim, cell, i, j) -> (cls, links) of the home vectors, and edges (a, b)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []

        def flush() -> pa.RecordBatch | None:
            homes, members = [r for r in rows if r[1]], [r for r in rows if r[2]]
            if not homes or not members:
                return None
            matrix = lambda part: np.frombuffer(b"".join(r[4] for r in part), np.float64).reshape(len(part), -1)
            counts, edges = block_links(matrix(homes), [r[0] for r in homes], matrix(members), [r[0] for r in members], np.array([r[3] for r in members], np.int64), min_cosine)
            n, e = len(homes), len(edges)
            column = lambda x, y: pa.array([*x, *y], pa.int64())
            return pa.RecordBatch.from_arrays([column((r[0] for r in homes), [None] * e), column(counts.tolist(), [None] * e), column([None] * n, (a for a, _ in edges)), column([None] * n, (b for _, b in edges))],
                                              names=["cls", "links", "a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("label", "dim", "cell", "i", "j", "cls", "as_home", "as_member", "n", "unit")]
            for *key, cls, as_home, as_member, n, unit in zip(*columns, strict=True):
                if key != current:
                    if rows and (out := flush()) is not None:
                        yield out
                    current, rows = key, []
                rows.append((cls, as_home, as_member, n, unit))
        if rows and (out := flush()) is not None:
            yield out

    return run


def embedding_dedup(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", min_cosine: float = MIN_COSINE) -> DataFrame:
    """Every row of ``vectors`` as (_id, n_links, component): rows linked directly, the smallest id reachable."""
    spark = vectors.sparkSession
    parts = partitions(spark)
    v = F.col("v")
    sound = v.isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("cls", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("label", "v")))
    classes = scratch(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("_id").alias("least")), "vector-classes")
    largest = classes.groupBy("label", F.size("v")).count().agg(F.max("count")).first()[0] or 0
    pivots = min(MAX_PIVOTS, -(-largest // PER_PIVOT))
    chosen = [np.array(r["v"]) for r in classes.orderBy(F.xxhash64("cls", F.lit(1)), "cls").select("v").limit(pivots).collect()] if pivots else []  # MAX_PIVOTS vectors at most
    dealt = scratch(classes.select("cls", "label", "n", "v").mapInArrow(assign(chosen, min_cosine), "cls long, label long, dim int, cell int, home boolean, n long, unit binary"), "vector-cells")
    where = ["label", "dim", "cell"]
    sizes = [F.ceil(n / BLOCK).cast("int") for n in (F.count_if("home"), F.count("*"))]
    blocks = dealt.groupBy(*where).agg(sizes[0].alias("rows"), sizes[1].alias("columns")).where("rows > 0")
    own = {name: F.pmod(F.xxhash64("cls", F.lit(name)), F.col(name)).cast("int") for name in ("rows", "columns")}
    each = lambda name: F.sequence(F.lit(0), F.col(name) - 1)
    pairs = F.array_distinct(F.concat(F.when(F.col("home"), F.transform(each("columns"), lambda x: F.struct(F.col("row").alias("i"), x.alias("j")))).otherwise(F.array()),
                                      F.transform(each("rows"), lambda x: F.struct(x.alias("i"), F.col("column").alias("j")))))
    tasks = dealt.join(blocks, where).withColumns({"row": own["rows"], "column": own["columns"]}).withColumn("p", F.explode(pairs)).select(
        *where, "p.i", "p.j", "cls", (F.col("home") & (F.col("p.i") == F.col("row"))).alias("as_home"), (F.col("p.j") == F.col("column")).alias("as_member"), "n", "unit")
    keys = [*where, "i", "j"]
    found = scratch(tasks.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(join_cells(min_cosine), "cls long, links long, a long, b long"), "vector-links")
    drop_scratch(dealt)
    links = found.where("cls IS NOT NULL").groupBy("cls").agg((F.sum("links") - 1).alias("n_links"))
    linked = components(found.where("a IS NOT NULL").select("a", "b"))
    names = classes.select("cls", "least").join(linked.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = names.groupBy("root").agg(F.min("least").alias("component"))
    final = links.join(names.join(least, "root").select("cls", "component"), "cls")
    whole = rows.where("cls IS NOT NULL").select("_id", "cls").join(final, "cls").select("_id", "n_links", "component")
    return whole.unionByName(rows.where("cls IS NULL").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedding_dedup(read_docs(spark, sf_dir, "embeddings"))
    return rows.select(F.col("_id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("_id") == F.col("component"), F.lit(True)).alias("kept"))


#: The same in DuckDB.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
least AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings LEFT JOIN counts ON counts.x = vec_id LEFT JOIN least ON least.x = vec_id
"""
