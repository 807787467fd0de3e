"""What iterative operators share: tables that cut a lineage, gapless numbers and chains followed in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode one of our own where it is unset."""
    jsc = spark.sparkContext._jsc.sc()
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder and jsc.getCheckpointDir().isDefined():
        folder = jsc.getCheckpointDir().get()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="driftloom-"))
        folder = jsc.getCheckpointDir().get()
    return folder.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and there when an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/rounds-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``settled`` that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("rounds-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _sorted_over_files(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` sorted by ``keys`` over all files of a table, with ``__file`` and ``__row``, the place in it. Rows that are equal in
    ``keys`` are parted by a number of their own, so that they don't all meet in one file."""
    salted = rows.withColumn("__salt", F.monotonically_increasing_id())
    table = settled(salted.repartitionByRange(*keys, "__salt").sortWithinPartitions(*keys, "__salt"), name)
    return table.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def _with_runs(placed: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """``placed`` with the columns of ``runs``, which has a row for each ``by`` and file."""
    named = runs.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__file").alias("__of"), *[c for c in runs.columns if c not in (*by, "__file")])
    same = F.col("__file") == F.col("__of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return placed.join(named, same)


def _earlier_files(by: list[str]):
    return Window.partitionBy(*by).orderBy(F.length("__file"), "__file").rowsBetween(Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, by: list[str], order: list[str], number: str = "position") -> DataFrame:
    """``rows`` with ``number`` (long): their place, gapless from 1, within ``by`` in ascending ``order`` (null first).

    A window would sort each group in one task. Here rows are sorted over all tasks by a range shuffle and written; a row's
    place is its row in its file and how many rows of its group earlier files hold. So a group may hold any share of the
    rows. Rows that are equal in ``by`` and ``order`` are numbered in any order.
    """
    placed = _sorted_over_files(rows, [*by, *[c for c in order if c not in by]], "numbered")
    runs = placed.groupBy(*by, "__file").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    runs = runs.select(*by, "__file", (F.coalesce(F.sum("__n").over(_earlier_files(by)), F.lit(0)) - F.col("__first")).alias("__start"))
    return _with_runs(placed, runs, by).select(*rows.columns, (F.col("__start") + F.col("__row") + 1).alias(number))


def running_max(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the largest ``value`` up to and with each row, within ``by`` in ascending ``order``. As in ``numbered``, a
    group is spread over files: each one's maximum goes on to the later ones, and windows end with a file."""
    placed = _sorted_over_files(rows, [*by, *[c for c in order if c not in by]], "running")
    runs = placed.groupBy(*by, "__file").agg(F.max(value).alias("__max"))
    runs = runs.select(*by, "__file", F.max("__max").over(_earlier_files(by)).alias("__before"))
    upto = Window.partitionBy(*by, "__file").orderBy("__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _with_runs(placed.withColumn("__own", F.max(value).over(upto)), runs, by).select(*rows.columns, F.greatest("__own", "__before").alias(name))


def followed(links: DataFrame, on: list[str], most_rounds: int = 60) -> DataFrame:
    """Where each chain of ``links`` (``on``, source, target) begins: rows (``on``, node, head, steps) of all nodes that a link touches.

    Each node has one link to its source at most (``target`` is unique within ``on``), so links are chains or trees, and
    pointers are doubled: after k rounds a node knows its forebear 2 ** k steps back. Rounds grow with the logarithm of
    the longest chain; a cycle never settles and raises.
    """
    up = links.select(*on, F.col("target").alias("node"), F.col("source").alias("head")).withColumn("steps", F.lit(1).cast("long"))
    roots = links.select(*on, F.col("source").alias("node")).distinct().join(links.select(*on, F.col("target").alias("node")), [*on, "node"], "left_anti")
    now = settled(up.unionByName(roots.select(*on, "node", F.col("node").alias("head"), F.lit(0).cast("long").alias("steps"))), "followed")
    for _ in range(most_rounds):
        over = now.where("steps > 0").select(*on, F.col("node").alias("head"), F.col("head").alias("__head"), F.col("steps").alias("__steps"))
        then = now.join(over, [*on, "head"], "left").select(
            *on, "node", F.coalesce("__head", "head").alias("head"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), F.col("__head").isNotNull().alias("__moved")
        )
        before, table = now, settled(then, "followed")
        now = table.drop("__moved")
        moved = table.where("__moved").limit(1).count()
        dropped(before)
        if not moved:
            return now
    raise ValueError(f"links did not settle in {most_rounds} rounds: there is a cycle")
