"""Sharding by a hypergeometric communication matrix, in DataFrame functions only."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import drop_clashing, fresh, table

#: The matrix goes to the tasks as a broadcast table up to this many entries (8 bytes each), else by a shuffled join.
BROADCAST_ENTRIES = 2_000_000


def _stirling_error(n: float) -> float:
    """log(n!) less its Stirling approximation."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n**2) / n**2) / n**2) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation where the two are near each other."""
    d = (x - mean) / (x + mean)
    if abs(d) >= 0.1:
        return x * math.log(x / mean) + mean - x
    out, power, k = (x - mean) * d, 2 * x * d * d * d, 3
    while out + power / k != out:
        out, power, k = out + power / k, power * d * d, k + 2
    return out


def _binomial(k: int, n: int, p: float) -> float:
    """The binomial probability by its saddle point, right to some 15 digits at any n."""
    if k == 0:
        return math.exp(n * math.log1p(-p))
    if k == n:
        return math.exp(n * math.log(p))
    log = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - _deviance(k, n * p) - _deviance(n - k, n * (1 - p))
    return math.exp(log) * math.sqrt(n / (2 * math.pi * k * (n - k)))


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One exact draw. Beyond numpy's limit of 10**9: inversion outwards from the mode."""
    if good == 0 or draws == 0:
        return 0
    if bad == 0:
        return draws
    if draws == good + bad:
        return good
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    p = draws / (good + bad)
    at = _binomial(mode, good, p) * _binomial(draws - mode, bad, p) / _binomial(draws, good + bad, p)
    u, left, right, p_left, p_right = rng.random() - at, mode, mode, at, at
    if u <= 0:
        return mode
    while left > low or right < high:
        if right < high:
            p_right *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > low:
            p_left *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= p_left
            if u <= 0:
                return left
        if p_left + p_right < 1e-30:  # what is left of u is rounding
            break
    return mode


def communication_matrix(row_counts: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """How many rows each input partition sends to each shard, as a uniform shuffle of all rows would.

    Row sums are ``row_counts``, column sums ``shard_sizes``. Partition by partition, the shard of each
    row is a draw without replacement from the places that are still free.
    """
    rng = np.random.default_rng(seed)
    free, out = list(shard_sizes), []
    for n in row_counts:
        row, left, places = [], n, sum(free)
        for k, c in enumerate(free):
            places -= c
            got = _hypergeometric(rng, c, places, left)
            row.append(got)
            free[k] -= got
            left -= got
        out.append(row)
    return out


def shard_uniform(df: DataFrame, n_shards: int, seed: int = 42, rows_per_block: int = 1024, most_blocks: int = 4096) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard): a uniform random shuffle.

    Shard sizes are exact: they differ by one row at most. The matrix of row counts from input partition to
    shard is drawn on the driver from the partitions' row counts (one number a partition). Then each
    partition permutes its rows, deals them out by the matrix, rows are exchanged by (shard, block), and
    each block is permuted again. Blocks only split a shard's sort over tasks; at most ``most_blocks`` a shard.

    The input is read twice and must give the same rows in the same partitions both times (a file scan does;
    write anything else to a table first); a partition that grew meanwhile raises an error.
    Null and very long values pass through; equal rows are separate rows; an empty input gives an empty
    result; columns named shard or slot are replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 at least")
    spark = df.sparkSession
    df = drop_clashing(df, "shard", "slot")
    c_p, c_ends, c_rank, c_shard, c_block, c_first, c_row, c_n, c_chunk, c_held, c_start, c_r = fresh(df, "p", "ends", "rank", "shard", "block", "first", "row", "n", "chunk", "held", "start", "r")
    counts = {r[0]: r[1] for r in df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()}
    parts = sorted(counts)
    total = sum(counts.values())
    sizes = [total // n_shards + (k < total % n_shards) for k in range(n_shards)]
    matrix = communication_matrix([counts[p] for p in parts], sizes, seed)
    cumulative = np.cumsum(np.array(matrix, dtype=np.int64).reshape(len(parts), n_shards), axis=1).tolist()
    blocks = int(min(most_blocks, max(1, math.ceil(total / n_shards / rows_per_block))))

    text = json.dumps([{"p": p, "ends": c} for p, c in zip(parts, cumulative, strict=True)])
    ends = spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<struct<p:bigint,ends:array<bigint>>>")).alias("x"))
    ends = ends.select(F.col("x.p").alias(c_p), F.col("x.ends").alias(c_ends))
    small = len(parts) * n_shards <= BROADCAST_ENTRIES
    joined = lambda left: left.join(F.broadcast(ends) if small else ends, c_p)
    place = lambda d: d.withColumn(c_shard, F.size(F.filter(c_ends, lambda e: e <= F.col(c_rank)))).withColumn(
        c_block, F.pmod(F.xxhash64(F.lit(seed), F.lit(1), c_p, c_rank), F.lit(blocks))
    )

    row = F.monotonically_increasing_id()
    sent = df.withColumn(c_first, F.rand(seed)).sortWithinPartitions(c_first).drop(c_first).withColumn(c_row, row)
    sent = sent.withColumn(c_p, F.shiftright(c_row, 33)).withColumn(c_rank, F.col(c_row).bitwiseAND((1 << 33) - 1))
    sent = place(joined(sent))
    sent = sent.where(F.assert_true(F.col(c_rank) < F.element_at(c_ends, -1), F.lit("the input changed between two reads")).isNull())

    # Where each block starts: the same placing over the rows' numbers alone.
    step = 4096
    ranks = ends.withColumn(c_n, F.element_at(c_ends, -1)).where(F.col(c_n) > 0)
    ranks = ranks.withColumn(c_chunk, F.explode(F.expr(f"sequence(0L, ({c_n} - 1) div {step})"))).repartition(c_p, c_chunk)
    ranks = ranks.withColumn(c_rank, F.explode(F.expr(f"sequence({c_chunk} * {step}, least({c_n}, ({c_chunk} + 1) * {step}) - 1)")))
    held = place(ranks).groupBy(c_shard, c_block).agg(F.count("*").alias(c_held))
    before = Window.partitionBy(c_shard).orderBy(c_block).rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(c_shard, c_block, F.coalesce(F.sum(c_held).over(before), F.lit(0)).alias(c_start))

    again = Window.partitionBy(c_shard, c_block).orderBy(F.xxhash64(F.lit(seed), F.lit(2), c_p, c_rank), c_p, c_rank)
    out = sent.select(*df.columns, c_shard, c_block, c_p, c_rank).withColumn(c_r, F.row_number().over(again))
    starts = F.broadcast(starts) if n_shards * blocks <= 65_536 else starts
    return out.join(starts, [c_shard, c_block]).select(
        *df.columns, F.col(c_shard).cast("int").alias("shard"), (F.col(c_start) + F.col(c_r) - 1).cast("long").alias("slot")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards whose row counts are one apart at most.

    A null text counts as no bytes and has the checksum of an empty one. ``grown_shard`` is null: the law is ``rows``.
    """
    placed = shard_uniform(table(spark, sf_dir, "documents"), 16)
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op1_sharding": op1_sharding}
ORACLES: dict[str, str] = {}
