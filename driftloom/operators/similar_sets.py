"""Pairs of like sets within a key, without making all pairs of the key."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import dropped, settled

#: Sets of one token that meet in one tile, about; tokens that a task of tiles reads, about; and cells that it holds at a time.
TILE, TASK_TOKENS, CELLS = 4096, 500_000, 1 << 22


def candidate_pairs(left: DataFrame, right: DataFrame, on: list[str], name: str, tokens: str, least: float, sets: bool = False) -> DataFrame:
    """Rows (``on``, left_id, right_id), each once: rows of both sides that agree in ``on`` and may share ``least`` of the larger set.

    ``name``: a column that is unique within ``on`` on each side; ``tokens``: an array column. Two sets that share at least
    ``least`` of the larger one share one of the first ``n - ceil(least * n) + 1`` tokens of each, in any one order. The
    order here is from the rarest token of the key to the most frequent, so the sets meet at rare tokens. A pair is
    made at the first such token that both have, so once; sets without tokens meet nothing. All that is at least as like
    as asked is among the pairs, whatever else is; sets whose sizes alone forbid it are not. With ``sets``, pairs have both
    sides' distinct tokens too, as ``left_set`` and ``right_set``.
    """
    rows = [s.select(*on, F.col(name).alias("id"), F.array_distinct(tokens).alias("set")).where(F.size("set") > 0).withColumn("side", F.lit(k)) for k, s in enumerate((left, right))]
    each = rows[0].unionByName(rows[1]).select(*on, "side", "id", F.explode("set").alias("token"))
    counts = each.groupBy(*on, "token").agg(F.count("*").alias("n"))
    ordered = each.join(counts, [*on, "token"]).groupBy(*on, "side", "id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("set"))
    kept = F.size("set") - F.ceil(F.size("set") * F.lit(float(least)) - F.lit(1e-9)).cast("int") + 1
    heads = ordered.select(*on, "side", "id", F.size("set").alias("n"), F.greatest(kept, F.lit(1)).alias("kept"), F.transform("set", lambda t: t["token"]).alias("set"))
    if not sets:
        heads = heads.withColumn("set", F.slice("set", 1, F.col("kept")))

    def at(side: int, name: str) -> DataFrame:
        own = heads.where(F.col("side") == side).select(*on, *[F.col(c).alias(f"{name}_{c}") for c in ("id", "n", "kept", "set")])
        return own.select("*", F.explode(F.slice(f"{name}_set", 1, F.col(f"{name}_kept"))).alias("token"))

    met = at(0, "left").join(at(1, "right"), [*on, "token"]).where(F.least("left_n", "right_n") >= F.greatest("left_n", "right_n") * F.lit(float(least)) - F.lit(1e-9))
    head = lambda name: F.slice(f"{name}_set", 1, F.col(f"{name}_kept"))
    first = F.get(F.array_intersect(head("left"), head("right")), F.lit(0)) == F.col("token")
    return met.where(first).select(*on, "left_id", "right_id", *(["left_set", "right_set"] if sets else []))


def _codes(columns: list[pa.ChunkedArray]) -> np.ndarray:
    """A number for each row, the same for rows that agree in all columns."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        values = c.combine_chunks().dictionary_encode()
        at = values.indices.fill_null(len(values.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.unique(out * (len(values.dictionary) + 1) + at, return_inverse=True)[1]
    return out


def _best_of(left: list[np.ndarray], right: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each set of ``left`` the place and the likeness of its most similar in ``right``, the first among equals; and the same for ``right``. 0 and 0.0: none of ``least``."""
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    token, of = np.concatenate(right), np.repeat(np.arange(len(right)), sizes[1])
    by = np.argsort(token, kind="stable")
    token, of = token[by], of[by]
    best = [np.zeros(len(left), np.int64), np.zeros(len(left)), np.zeros(len(right), np.int64), np.zeros(len(right))]
    step = max(1, CELLS // len(right))
    for lo in range(0, len(left), step):
        some = slice(lo, lo + step)
        wanted, row = np.concatenate(left[some]), np.repeat(np.arange(len(sizes[0][some])), sizes[0][some])
        start = np.searchsorted(token, wanted)
        n = np.searchsorted(token, wanted, side="right") - start
        at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
        shared = np.bincount(np.repeat(row, n) * len(right) + of[at], minlength=len(sizes[0][some]) * len(right)).reshape(-1, len(right))
        like = shared / np.maximum(sizes[0][some][:, None], sizes[1])
        like[like < least] = 0.0
        best[0][some] = to = like.argmax(1)
        best[1][some] = like[np.arange(len(like)), to]
        back = like.argmax(0)
        value = like[back, np.arange(len(right))]
        more = value > best[3]
        best[2][more], best[3][more] = back[more] + lo, value[more]
    return tuple(best)


def most_similar(left: DataFrame, right: DataFrame, on: list[str], name: str, tokens: str, least: float) -> DataFrame:
    """(``on``, side - 0 for ``left``, id, other, similarity): for each set the most similar one of the other side that agrees in ``on``.

    Sets and ``least`` (above 0): see ``candidate_pairs``; ``name`` is a whole number, the smallest is taken among equally similar ones. Sets
    meet at their rare tokens, as there; a frequent token's are dealt over tiles of some ``TILE``, of which each pair of both
    sides meets. Tiles are dealt to tasks, which count shared tokens by arrays and hand on only each set's best: no pair is
    shuffled, sorted or written.
    """
    rows = [s.select(*on, F.col(name).cast("long").alias("id"), F.array_distinct(tokens).alias("set")).where(F.size("set") > 0).withColumn("side", F.lit(k)) for k, s in enumerate((left, right))]
    each = rows[0].unionByName(rows[1]).select(*on, "side", "id", F.explode("set").alias("token"))
    counts = each.groupBy(*on, "token").agg(F.count("*").alias("n"))
    ordered = each.join(counts, [*on, "token"]).groupBy(*on, "side", "id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("by"))
    kept = F.greatest(F.size("by") - F.ceil(F.size("by") * F.lit(float(least)) - F.lit(1e-9)).cast("int") + 1, F.lit(1))
    met = ordered.select(*on, "side", "id", F.transform("by", lambda t: t["token"]).alias("set"), F.explode(F.slice("by", 1, kept)).alias("at"))
    met = settled(met.select(*on, "side", "id", "set", F.col("at.token").alias("token"), F.ceil(F.col("at.n") / F.lit(float(TILE))).cast("int").alias("tiles")), "tiles")
    total = met.agg(F.sum(F.size("set") * F.col("tiles").cast("long"))).first()[0] or 0
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    dealt = met.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("their"))
    dealt = dealt.select(*on, "side", "id", "set", "token", *[F.when(F.col("side") == k, F.col("own")).otherwise(F.col("their")).alias(c) for k, c in enumerate("ab")])
    bucket = F.pmod(F.xxhash64(*on, "token", "a", "b"), F.lit(max(1, math.ceil(total / TASK_TOKENS))))

    def compared(t: pa.Table) -> pa.Table:
        group, side, ids = _codes([t[c] for c in (*on, "token", "a", "b")]), t["side"].to_numpy(), t["id"].to_numpy()
        sets = t["set"].combine_chunks()
        ends = sets.offsets.to_numpy()
        values = sets.values.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, side, group))
        bounds = np.searchsorted(2 * group[order] + side[order], np.arange(2 * group.max() + 3))
        found = [[], [], []]
        for lo, mid, hi in zip(bounds[:-2:2].tolist(), bounds[1:-1:2].tolist(), bounds[2::2].tolist(), strict=True):
            if lo == mid or mid == hi:
                continue
            both = order[lo:mid], order[mid:hi]
            there, a, back, b = _best_of(*[[values[ends[k] : ends[k + 1]] for k in x.tolist()] for x in both], least)
            for mine, other, at, like in ((both[0], both[1], there, a), (both[1], both[0], back, b)):
                some = like > 0
                for to, x in zip(found, (mine[some], ids[other[at[some]]], like[some]), strict=True):
                    to.append(x)
        mine, other, like = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in zip(found, (np.int64, np.int64, np.float64), strict=True))
        return t.select([*on, "side", "id"]).take(pa.array(mine)).append_column("other", pa.array(other)).append_column("similarity", pa.array(like))

    kinds = ", ".join(f"{met.schema[c].name} {met.schema[c].dataType.simpleString()}" for c in (*on, "side", "id"))
    best = dealt.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(compared, f"{kinds}, other long, similarity double")
    best = best.groupBy(*on, "side", "id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "other")).alias("x"))
    out = settled(best.select(*on, "side", "id", F.col("x.other").alias("other"), (-F.col("x.s")).alias("similarity")), "best")
    dropped(met)
    return out
