"""Mixing sources to target weights by Pfair scheduling.

A source's blocks are unit jobs: with weight a out of W, its j-th block (from 1) is released at slot
floor((j - 1) * W / a) and due at slot ceil(j * W / a). Earliest deadline first over the released blocks
meets all of them, so at every slot a source is less than one block from its target. The schedule repeats
every W slots: one cycle is computed on the driver, and a block's slot follows from its number. Where a source runs
out within a cycle, the driver computes the slots up to there only.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import block_rank, drop_clashing, fresh, table

#: Sources at most; the driver holds a count for each.
MOST_SOURCES = 10_000


def cycle(weights: list[int], most: list[int] | None = None) -> list[int]:
    """Which source each slot of a cycle of sum(weights) slots takes. Of equal deadlines the earlier source's goes first.

    ``most``: ends at the slot with which a source has had so many blocks.
    """
    total = sum(weights)
    waiting = [(0, i, 1) for i, a in enumerate(weights) if a]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * total // weights[i]), i, j))
        due, i, j = heapq.heappop(ready)
        assert due > slot
        out.append(i)
        if most and j == most[i]:
            break
        if j < weights[i]:
            heapq.heappush(waiting, (j * total // weights[i], i, j + 1))
    return out


def segments(weights: list[int], blocks: list[int]) -> list[list[tuple[int, int, int, int, int, list[int]]]]:
    """For each source: (first block, end block, first slot, weight, cycle, its slots in a cycle), without gaps.

    When a source's blocks end, it leaves and the others share its time by their weights, in a new cycle.
    """
    left, done, now = list(blocks), [0] * len(blocks), 0
    out: list[list] = [[] for _ in blocks]
    while any(left):
        active = [a if n else 0 for a, n in zip(weights, left, strict=True)]
        total = sum(active)
        times = min(n // a for a, n in zip(active, left, strict=True) if a)
        order = cycle(active, None if times else left)
        slots: dict[int, list[int]] = {}
        for t, i in enumerate(order):
            slots.setdefault(i, []).append(t)
        if times:
            for i, at in slots.items():
                out[i].append((done[i], done[i] + times * len(at), now, len(at), total, at))
                done[i] += times * len(at)
                left[i] -= times * len(at)
            now += times * total
            continue
        for i, at in slots.items():
            out[i].append((done[i], done[i] + len(at), now, len(at), total, at))
            done[i] += len(at)
            left[i] -= len(at)
        now += len(order)
    return out


def tempered(counts: dict, temperature: float = 2.0) -> dict:
    """Weights that grow with the sources' sizes to the power 1 / temperature."""
    return {k: n ** (1 / temperature) for k, n in counts.items()}


def mix(docs: DataFrame, weights=tempered, column: str = "source", key: str = "doc_id", text: str = "text", block_rows: int = 64, resolution: int = 1000, seed: int = 2) -> DataFrame:
    """``docs`` with ``source_row``, ``block``, ``block_slot`` and ``position`` (long): all rows, in a mixed order.

    ``weights``: a positive number for each source, or a function of the sources' row counts; whole parts of
    ``resolution``, one at least. ``source_row`` is a random order of a source's rows (by a hash of ``key``, then by
    ``key`` and a hash of ``text`` where there is such a column; rows that are equal in both may change places),
    ``block`` its block of ``block_rows`` rows, ``block_slot`` the block's place among all blocks and
    ``position`` the row's place among all rows, both gapless from 0. No row is dropped or repeated: a source
    that has run out leaves the mix to the others. A null source is a source, a null key a key, and null, empty and very long
    texts are rows like any other. Columns of those four names are replaced; an empty input gives an empty result.
    """
    docs = drop_clashing(docs, "source_row", "block", "block_slot", "position")
    rows = docs.groupBy(column).count().limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    counts = {r[0]: r["count"] for r in sorted(rows, key=lambda r: (r[0] is not None, str(r[0])))}
    share = weights(counts) if callable(weights) else weights
    total = sum(share[k] for k in counts) or 1
    parts = [max(1, round(resolution * share[k] / total)) for k in counts]
    blocks = [-(-n // block_rows) for n in counts.values()]
    plan = segments(parts, blocks)

    spark = docs.sparkSession
    kind = docs.schema[column].dataType.simpleString()
    of, pieces, piece, gaps = fresh(docs, "of", "plan", "piece", "gaps")
    short = []
    for (k, n), b, p in zip(counts.items(), blocks, plan, strict=True):
        lo, _, at, a, w, slots = p[-1]
        last = b - 1 - lo
        short.append((at + last // a * w + slots[last % a], b * block_rows - n))
    plans = spark.createDataFrame(
        [(k, p) for k, p in zip(counts, plan, strict=True)], f"{of} {kind}, {pieces} array<struct<lo:bigint,hi:bigint,at:bigint,a:bigint,w:bigint,slots:array<bigint>>>"
    )
    # Rows that the sources' last blocks lack, up to each of their slots: at most one entry a source.
    lacking = spark.createDataFrame([([x for x in sorted(short) if x[1]],)], f"{gaps} array<struct<slot:bigint,n:bigint>>")

    ties = [F.col(key), *([F.xxhash64(text)] if text in docs.columns else [])]
    n_rows = sum(counts.values())
    ranked = block_rank(docs, [column], F.xxhash64(F.lit(seed), key), ties, min(4096, max(1, math.ceil(n_rows / 2048))), "source_row", len(counts))
    out = ranked.join(F.broadcast(plans), F.col(column).eqNullSafe(F.col(of))).crossJoin(F.broadcast(lacking))
    out = out.withColumn("block", F.floor(F.col("source_row") / block_rows).cast("long"))
    out = out.withColumn(piece, F.element_at(F.filter(pieces, lambda p: (p["lo"] <= F.col("block")) & (F.col("block") < p["hi"])), 1))
    k = F.col("block") - F.col(f"{piece}.lo")
    slot = F.col(f"{piece}.at") + F.floor(k / F.col(f"{piece}.a")) * F.col(f"{piece}.w") + F.element_at(F.col(f"{piece}.slots"), (k % F.col(f"{piece}.a") + 1).cast("int"))
    out = out.withColumn("block_slot", slot)
    before = F.aggregate(F.filter(gaps, lambda g: g["slot"] < F.col("block_slot")), F.lit(0).cast("long"), lambda s, g: s + g["n"])
    position = F.col("block_slot") * block_rows + F.col("source_row") % block_rows - before
    return out.select(*docs.columns, "source_row", "block", "block_slot", position.alias("position"))


def mixed(docs: DataFrame, parts: int, **options) -> DataFrame:
    """The rows of ``docs`` in the order of the mix: dealt over ``parts`` partitions by position, and sorted. Written as
    Parquet, the order of file names and of rows in a file is that of the mix: see ``written_position``."""
    out = mix(docs, **options)
    n = max(1, docs.count())
    out = out.repartitionById(parts, F.expr(f"cast(position * {parts} div {n} as int)")).sortWithinPartitions("position")
    return out.select(*docs.columns)


def written_position(docs: DataFrame, name: str = "position") -> DataFrame:
    """``docs``, a scan of Parquet files, with ``name`` (long): each row's place, gapless from 0, by file name and row in the file.

    A scan reads files in any order (it packs them by size); this is the order in which they were written.
    """
    file, at, start, n = fresh(docs, "file", "at", "start", "n")
    placed = docs.select(*[c for c in docs.columns if c.lower() != name.lower()], F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
    counts = placed.groupBy(file).agg(F.count("*").alias(n))  # a row for each file
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(file, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    return placed.join(F.broadcast(starts), file).withColumn(name, F.col(start) + F.col(at)).drop(file, at, start)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents in the mix of sources, weighted by the square roots of their sizes."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "source_row", "block", "block_slot", "position")


QUERIES = {"op2_mixing": op2_mixing}
ORACLES: dict[str, str] = {}
