"""Writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..operators.seeds import remaining, upserted
from . import readers


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """With a header; quotes are doubled inside quotes, as ``readers.csv`` expects them."""
    df.write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, keys: list[str], schema: str) -> int:
    """Appends the rows whose keys the log does not hold yet; how many. Running it twice adds nothing."""
    if readers.exists(df.sparkSession, path):
        df = remaining(df, readers.jsonl(df.sparkSession, path, schema), keys)
    df = df.persist()
    n = df.count()
    if n:
        df.write.mode("append").json(path)
    df.unpersist()
    return n


def upsert_json(new: DataFrame, path: str, key: str, schema: str) -> None:
    """Puts rows in place of those of the same key, in key order. Written beside, then moved in place: the old
    table is moved aside first and deleted last, so that a crash at any point leaves one of the two."""
    spark = new.sparkSession
    if readers.exists(spark, path):
        new = upserted(readers.jsonl(spark, path, schema), new, key)
    beside, aside = f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}"
    new.orderBy(key).write.json(beside)
    jvm = spark.sparkContext._jvm
    to, fro, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, beside, aside))
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(to):
        fs.rename(to, old)
    if not fs.rename(fro, to):
        raise OSError(f"could not move {beside} to {path}; the rows before are in {aside}")
    fs.delete(old, True)


def backup_once(spark, path: str, to: str) -> bool:
    """A copy of ``path`` at ``to``, unless there is one."""
    if readers.exists(spark, to) or not readers.exists(spark, path):
        return False
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    return bool(jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf))
