"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a word is made of, for Java's regular expressions.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"

_fallback: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in
    a session without it (tests on one machine) a temporary one."""
    global _fallback
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        if _fallback is None:
            _fallback = tempfile.mkdtemp(prefix="loomrows-")
            atexit.register(shutil.rmtree, _fallback, True)
        return f"file://{_fallback}"
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone when the interpreter ends
        return


_written: dict[str, SparkSession] = {}


class Kept:
    """A frame written to the shared folder and read again, which cuts lineage
    and survives lost executors. ``drop`` deletes it as soon as nothing reads
    it; tables that a returned frame reads go by ``clear`` or when the
    interpreter ends. With ``by``, a column, a reader of one of its values reads
    only those rows."""

    def __init__(self, df: DataFrame, by: str | None = None):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/loomrows-{uuid.uuid4().hex}"
        if not _written:
            atexit.register(lambda: [_delete(s, p) for p, s in _written.items()])
        _written[self.path] = spark
        (df.write.partitionBy(by) if by else df.write).parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        if spark := _written.pop(self.path, None):
            _delete(spark, self.path)


def clear() -> None:
    """Deletes all tables that are still kept. For long sessions, when no frame
    that an operator has returned is needed any more."""
    for path, spark in list(_written.items()):
        _written.pop(path, None)
        _delete(spark, path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value), where value is computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")
