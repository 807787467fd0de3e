"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_clashing(df: DataFrame, *names: str) -> DataFrame:
    """Without the columns whose names equal one of ``names``, upper or lower case alike."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of ``df`` has, upper or lower case alike."""
    taken, prefix = [c.lower() for c in df.columns], "_"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return [prefix + n for n in names]


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster; in local mode, where it is unset, a folder of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not shared:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = current.get() if current.isDefined() else ""
    if not shared:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="driftloom-")
        spark.sparkContext.setCheckpointDir(shared)
        shared = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return shared.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/driftloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if path.rsplit("/", 1)[-1].startswith("driftloom-"):
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


#: Rows of an Arrow batch at most: whole texts can be long, and a batch is held in memory.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, where they are not smaller yet."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def crc32_mod(column: str, n: int) -> F.Column:
    """crc32 of the column's decimal text, modulo ``n``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


#: Links up to which one task finds components (16 bytes each); beyond, all tasks do in rounds.
ONE_TASK_LINKS = 500_000


#: Vertices that a task joins at a time.
FOREST = 2_000_000


def _forest(batches):
    """Each vertex of a task's links with the smallest one that it reaches by them; of a bounded number of links at a time."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    def told():
        at = list(parent)
        for lo in range(0, len(at), 100_000):
            part = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(map(find, part), pa.int64())], names=["u", "v"])
        parent.clear()

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= FOREST:
            yield from told()
    yield from told()


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (v, root), root the smallest vertex.

    Up to ``one_task`` distinct links are joined by union-find in one task of bounded memory. Beyond, each task first
    joins its own links; then large-star and small-star steps alternate until nothing changes, each of them two
    shuffles and a written table: the minimum of a vertex is pre-aggregated before its shuffle and written
    before the join, which lets adaptive execution split a hub. No link or component reaches the driver. Self
    links are ignored; without links the result is empty. Vertices without links are not returned.
    """
    e = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        f"{name}-edges",
    )
    if e.count() <= one_task:
        roots = written(e.coalesce(1).mapInArrow(_forest, "u long, v long").select(F.col("u").alias("v"), F.col("v").alias("root")), f"{name}-roots")
        discard(e)
        return roots
    e = written(e.mapInArrow(_forest, "u long, v long").where("u <> v").distinct(), f"{name}-forest")
    print_of = None
    for k in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-low")
        large = both.where("v > u").join(first, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), f"{name}-large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        before, e = (e, first, large, low), written(small.where("u <> v").distinct(), f"{name}-small")
        discard(*before)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u") % 1000003)).first()
        if now == print_of:
            break
        print_of = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("u").alias("v"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct())


def block_rank(df: DataFrame, by: list[str], key: F.Column, ties: list[F.Column], blocks: int, rank: str, groups: int) -> DataFrame:
    """Adds ``rank`` (long, gapless from 0 within ``by``) in the order of (block, key, *ties).

    ``key`` must be a hash that depends only on a row's columns. Rows of a group are dealt over
    ``blocks`` hash blocks, ranked within each, and shifted by the counts of the blocks before, so a
    group with a third of all rows is spread over many tasks. ``groups``: how many there are at most; the blocks'
    starts are broadcast while they are few.
    """
    from pyspark.sql import Window

    k, block, n, start, r, *t = fresh(df, "key", "block", "n", "start", "r", *[f"tie{x}" for x in range(len(ties))])
    keyed = df.select("*", key.alias(k), *[tie.alias(x) for tie, x in zip(ties, t, strict=True)]).withColumn(block, F.pmod(F.shiftrightunsigned(k, 40), F.lit(blocks)))
    counts = keyed.groupBy(*by, block).agg(F.count("*").alias(n))
    before = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, block, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(*by, block).orderBy(k, *t)
    ranked = keyed.withColumn(r, F.row_number().over(within))
    on = [ranked[c].eqNullSafe(starts[c]) for c in (*by, block)]
    out = ranked.join(F.broadcast(starts) if groups * blocks <= 200_000 else starts, on, "inner")
    return out.select(*[ranked[c] for c in df.columns], (F.col(start) + F.col(r) - 1).alias(rank))


def bounded(ids: DataFrame, most: int, seed: int, column: str = "doc_id") -> DataFrame:
    """About nine tenths of ``most`` rows at most, chosen by a hash of ``column``; never more than ``most``."""
    n = ids.count()
    if n <= most:
        return ids
    span = 1 << 30
    return ids.where(F.pmod(F.xxhash64(F.lit(seed), column), F.lit(span)) < int(span * 0.9 * most / n)).limit(most)


def texts_of(docs: DataFrame, ids: DataFrame, tasks: int = 16) -> DataFrame:
    """The documents of a bounded list of ids, dealt over a few tasks."""
    return docs.join(F.broadcast(ids), "doc_id").repartition(tasks)
