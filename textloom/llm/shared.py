"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Only a session without executors of its own may leave that unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    return _own_folder.setdefault(app, "file://" + tempfile.mkdtemp(prefix="textloom-"))


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: its lineage ends there.

    ``partition_by`` names a column that has a folder for each of its values. Unlike ``checkpoint()`` this computes the rows once, and a lost executor costs nothing that was written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=partition_by)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave and that nothing reads any more."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often lambdas in ``use`` read it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def held_out(id_column: Column) -> Column:
    """True for the documents that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def unit_hash(*columns: Column) -> Column:
    """A repeatable number in [0, 1) from the columns' values."""
    return (F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)).cast("double")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
