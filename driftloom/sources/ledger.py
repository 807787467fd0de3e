"""A transactional log of records: Parquet parts, of which only those count that a manifest names.

Tasks write parts under names of their own and report them; the driver then writes one manifest with all of them, in
one move. So a reader sees a whole append or none of it, whatever becomes of tasks, executors or the driver in between,
and parts of failed attempts are named nowhere. An append may carry a batch id: a batch that is there already is not added again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.seeds import remaining
from .readers import exists

FORMAT = "ledger"


@dataclass
class Part(WriterCommitMessage):
    name: str | None
    rows: int


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system that a path names (a local one if it names none) and the path on it."""
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pyarrow.fs.LocalFileSystem(), path


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str | None):
        self.path, self.batch = path.rstrip("/"), batch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, root = _store(self.path)
        name, out, rows = None, None, 0
        try:
            for b in iterator:
                if not b.num_rows:
                    continue
                if out is None:
                    fs.create_dir(f"{root}/parts", recursive=True)
                    name = f"{uuid.uuid4().hex}.parquet"
                    out = pyarrow.parquet.ParquetWriter(f"{root}/parts/{name}", b.schema, filesystem=fs)
                out.write_batch(b)
                rows += b.num_rows
        finally:
            if out is not None:
                out.close()
        return Part(name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m is not None and m.name]
        fs, root = _store(self.path)
        fs.create_dir(f"{root}/manifests", recursive=True)
        name = f"batch-{self.batch}" if self.batch else f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        final = f"{root}/manifests/{name}.json"
        if self.batch and fs.get_file_info(final).type != pyarrow.fs.FileType.NotFound:
            self.abort(messages)
            return
        body = json.dumps({"parts": [m.name for m in parts], "rows": sum(m.rows for m in parts), "at": time.time_ns()}).encode()
        beside = f"{root}/manifests/.{uuid.uuid4().hex}"
        with fs.open_output_stream(beside) as f:
            f.write(body)
        fs.move(beside, final)

    def abort(self, messages: list[Part | None]) -> None:
        """Deletes the parts of tasks that ended; those of tasks that didn't are named by no manifest."""
        fs, root = _store(self.path)
        for m in messages:
            if m is not None and m.name and fs.get_file_info(f"{root}/parts/{m.name}").type != pyarrow.fs.FileType.NotFound:
                fs.delete_file(f"{root}/parts/{m.name}")


class Ledger(DataSource):
    """``df.write.format("ledger").mode("append").option("batch", ...).save(path)``, once it is registered."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("a ledger is appended to")
        return Writer(self.options["path"], self.options.get("batch"))


def append(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Appends all rows or, on any failure, none. With ``batch``, once for each id, however often it is called."""
    df.sparkSession.dataSource.register(Ledger)
    w = df.write.format(FORMAT).mode("append")
    (w.option("batch", batch) if batch else w).save(path)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(parts, rows, at): one row for each append."""
    return spark.read.schema("parts array<string>, rows bigint, at bigint").json(f"{path.rstrip('/')}/manifests")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all appends that were committed, with ``schema``; no rows where there is no ledger. Parts are read by Spark itself."""
    path = path.rstrip("/")
    if not exists(spark, f"{path}/manifests"):
        return spark.createDataFrame([], schema)
    names = [r[0] for r in manifests(spark, path).select(F.explode("parts")).collect()]  # a name for each file, as a table's listing has
    return spark.read.schema(schema).parquet(*[f"{path}/parts/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def append_new(df: DataFrame, path: str, keys: list[str], schema: str, batch: str | None = None) -> None:
    """Appends the rows whose keys the ledger does not hold yet."""
    append(remaining(df, read(df.sparkSession, path, schema), keys), path, batch)
