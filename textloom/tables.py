"""Tables that end a lineage: written once to the folder that driver and executors share, and deleted with their scope."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session in one process may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="textloom-"))


class Scope:
    """Tables that are deleted when the ``with`` block ends, but for those that are kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scope:
        return self

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/textloom/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths[path] = name
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, whose files stay."""
        for file in df.inputFiles()[:1]:
            for path in list(self.paths):
                if path.rsplit("/", 1)[-1] in file:
                    del self.paths[path]
        return df

    def discard(self, df: DataFrame) -> None:
        for path in [p for p in self.paths if any(p.rsplit("/", 1)[-1] in f for f in df.inputFiles()[:1])]:
            self._delete(path)

    def _delete(self, path: str) -> None:
        self.paths.pop(path, None)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __exit__(self, *_) -> None:
        for path in list(self.paths):
            self._delete(path)
