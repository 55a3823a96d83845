"""Versions of an index: prepare, commit, roll back, snapshots and deletion policies, as directories and one pointer table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .index import Index


class Store:
    """Versions live in ``path/v=<n>``; the last row of ``path/commits`` names the current one.

    A reader sees a version only after its pointer is written, so a writer that fails leaves the last commit in place.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def commits(self) -> list[int]:
        fs, path = self._fs(f"{self.path}/commits")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def prepare(self, index: Index) -> int:
        """Writes a version that nobody sees yet."""
        fs, path = self._fs(self.path)
        taken = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")] if fs.exists(path) else []
        version = max(taken, default=-1) + 1
        index.write(f"{self.path}/v={version}")
        return version

    def publish(self, version: int) -> None:
        fs, path = self._fs(f"{self.path}/commits/{version:012d}")
        fs.create(path, False).close()

    def commit(self, index: Index, keep: int = 1, snapshots: tuple[int, ...] = ()) -> int:
        """Publishes a new version, then drops commits but the last ``keep`` and the snapshots."""
        version = self.prepare(index)
        self.publish(version)
        for old in self.commits()[:-keep]:
            if old not in snapshots:
                self.drop(old)
        return version

    def drop(self, version: int) -> None:
        for part in (f"{self.path}/commits/{version:012d}", f"{self.path}/v={version}"):
            fs, path = self._fs(part)
            fs.delete(path, True)

    def roll_back(self) -> None:
        """Drops versions that were prepared but not published."""
        fs, path = self._fs(self.path)
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("v=") and int(name[2:]) not in self.commits():
                fs.delete(status.getPath(), True)

    def open(self, version: int | None = None) -> Index:
        found = self.commits()
        return Index.read(self.spark, f"{self.path}/v={found[-1] if version is None else version}")

    def is_current(self, version: int) -> bool:
        return self.commits()[-1:] == [version]


def compact(frame: DataFrame, files: int) -> DataFrame:
    """The same rows in fewer files, ready to be written again."""
    return frame.repartition(files, "term").sortWithinPartitions("term", "doc_id")
