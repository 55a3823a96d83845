"""Helpers shared by the training-data operators: scratch tables, row keys and Arrow plumbing."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch that goes to a Python worker.  Texts may be long, so batches stay short.
BATCH_ROWS = 512
#: Stands for a null document id inside numpy arrays.
NULL_ID = -(2**63)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives free memory back: workers stay, and share the executor with its JVM."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return task


def tune(spark: SparkSession) -> SparkSession:
    """Short Arrow batches, so that a batch of long texts fits a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary folder only where none is configured and all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="rankloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(*tables: DataFrame) -> None:
    """Delete tables made by :func:`scratch` that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_id(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as (_id, _key, _text): the id with a stand-in for null, a hash of the text, the text.

    Rows that repeat id and text share a key and so get the same verdict; rows that repeat only the id
    are kept apart.  Other columns are dropped, so their names can't clash.
    """
    return docs.select(
        row_id(id_col).alias("_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_key"), F.col(text_col).cast("string").alias("_text")
    )


def read_docs(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def public_id(name: str = "_id") -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name)).cast("long")


def strings(column: pa.Array) -> list[str]:
    """A batch's texts, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def binaries(column: pa.Array) -> list[bytes]:
    """A batch's texts as UTF-8, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]
