"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where none is set and all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="rankloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back, so that it's computed once however often a plan uses it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def signature(df: DataFrame) -> tuple[str, ...]:
    """What tells one state of the files under ``df`` from another: names, and sizes and times of the first of them."""
    spark, files = df.sparkSession, sorted(df.inputFiles())
    out = [str(len(files)), df._jdf.queryExecution().analyzed().canonicalized().toString()]
    for name in files:
        out.append(name)
        if len(out) < 256:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
            out.append(f"{status.getLen()} {status.getModificationTime()}")
    return tuple(out) if files else ()
