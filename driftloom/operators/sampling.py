"""Reproducible samples: allocation, strata, quotas, backups. Random orders are md5 orders, the same on every engine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .rounds import numbered
from .selection import first_of_each


def proportional_allocation(counts: DataFrame, total: int, stratum: str = "stratum", n: str = "n") -> DataFrame:
    """``counts`` with ``allocated``: largest remainders of n * total / sum(n), in whole numbers; all of a stratum at most.

    Ties: the larger stratum, then the name. ``counts`` has a row for each stratum and is small.
    """
    everything = F.sum(n).over(Window.partitionBy())
    aim = F.least(F.lit(total), everything)
    base = counts.withColumn("__n", everything).withColumn("__aim", aim)
    base = base.withColumn("__floor", F.expr(f"{n} * __aim div __n")).withColumn("__rest", F.expr(f"({n} * __aim) % __n"))
    order = Window.orderBy(F.desc("__rest"), F.desc(n), F.asc(stratum))
    base = base.withColumn("__left", F.col("__aim") - F.sum("__floor").over(Window.partitionBy())).withColumn("__r", F.row_number().over(order))
    return base.withColumn("allocated", F.col("__floor") + (F.col("__r") <= F.col("__left")).cast("bigint")).select(*counts.columns, "allocated")


def stratified(rows: DataFrame, strata: list[str], key: str, total: int, seed: int = 42) -> DataFrame:
    """``rows`` with ``in_sample``: the first by md5 in each stratum, as many as ``total`` allots to it."""
    counts = rows.groupBy(*strata).agg(F.count("*").alias("n")).withColumn("stratum", F.concat_ws(" | ", *strata))
    return first_of_each(rows, strata, C.digest(key, seed=seed), [key], proportional_allocation(counts, total).select(*strata, "allocated"))


def backup_rank(rows: DataFrame, strata: list[str], by: str, key: str) -> DataFrame:
    """``rows`` with ``backup_rank``, from 1 in each stratum: most of ``by`` first, null last, then by ``key``."""
    ordered = rows.withColumn("__last", F.col(by).isNull()).withColumn("__most", -F.col(by))
    return numbered(ordered, strata, ["__last", "__most", key], "backup_rank").drop("__last", "__most")


def floor_quota(rows: DataFrame, stratum: str, keys: list[str], floors: dict[str, int], target: int, seed: int = 42) -> DataFrame:
    """A sample with a floor for each stratum and the rest drawn from what is left, at random; with ``event_id``."""
    quota = rows.sparkSession.createDataFrame(list(floors.items()), f"{stratum} string, allocated bigint")
    ranked = first_of_each(rows, [stratum], C.digest(*keys, seed=seed), keys, quota, "__first")
    rest = C.digest(*keys, seed=seed + 1)
    more = ranked.where("not __first").orderBy(rest, *keys).limit(max(0, target - sum(floors.values())))
    out = ranked.where("__first").unionByName(more).drop("__first")
    final = Window.orderBy(C.digest(*keys, seed=seed + 2), *keys)  # the sample is of target rows
    return out.withColumn("event_id", F.format_string("E%03d", F.row_number().over(final)))


def fixed_per_group(rows: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` of each group by md5."""
    quota = rows.select(group).distinct().withColumn("allocated", F.lit(n))
    return first_of_each(rows, [group], C.digest(key, seed=seed), [key], quota, "__first").where("__first").drop("__first")


def exact_backups(needy: DataFrame, backups: DataFrame, strata: list[str], key: str) -> DataFrame:
    """The k-th row that needs a backup in a stratum gets its k-th backup; beyond them, none."""
    ranked = numbered(needy, strata, [key], "backup_rank")
    right = backups.select(*strata, "backup_rank", F.col(key).alias("backup"), *[c for c in ("usable",) if c in backups.columns])
    return ranked.join(right, [*strata, "backup_rank"], "left")


def greedy_backups(needy: DataFrame, backups: DataFrame, language: str = "language", bucket: str = "bucket", key: str = "key", attempts: int = 5) -> DataFrame:
    """Backups one after another: the best rank of the same bucket, else of the language, each used once, up to
    ``attempts`` until a usable one. Order matters, so a language is one group; languages run side by side. Each row
    that needs one uses ``attempts`` backups at most, so of a bucket only so many times the language's needy rows can be reached:
    the group grows with the rows that need a backup, which a sample bounds, and not with the backups.
    """
    wanted = needy.groupBy(language).agg((F.count("*") * attempts).alias("__most"))
    backups = backups.join(wanted, language).where(F.col("backup_rank") <= F.col("__most")).drop("__most")
    left = needy.select(language, bucket, key, F.lit(None).cast("long").alias("rank"), F.lit(None).cast("boolean").alias("usable"), F.lit(0).alias("side"))
    right = backups.select(language, bucket, key, F.col("backup_rank").cast("long").alias("rank"), "usable", F.lit(1).alias("side"))
    kind = needy.schema[key].dataType.simpleString()

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pool = pdf[pdf["side"] == 1].sort_values(["rank", bucket, key]).to_dict("records")
        rows = []
        for r in pdf[pdf["side"] == 0].sort_values(key).to_dict("records"):
            taken = None
            for attempt in range(1, attempts + 1):
                at = next((k for k, b in enumerate(pool) if b[bucket] == r[bucket]), 0 if pool else None)
                if at is None:
                    break
                b = pool.pop(at)
                if b["usable"]:
                    taken = (b[key], attempt, "same" if b[bucket] == r[bucket] else "cross")
                    break
            rows.append((r[language], r[bucket], r[key], *(taken or (None, None, "unfilled"))))
        return pd.DataFrame(rows, columns=["language", "bucket", "key", "backup", "attempt", "fill"]).astype({"backup": "Int64", "attempt": "Int64"} if kind == "bigint" else {"attempt": "Int64"})

    return left.unionByName(right).groupBy(language).applyInPandas(choose, f"language string, bucket string, key {kind}, backup {kind}, attempt long, fill string")


def filled(planned: DataFrame, drawn: DataFrame, backups: DataFrame, strata: list[str]) -> DataFrame:
    """Planned and achieved rows of each stratum, and where they come from.

    ``planned``: strata, planned; ``drawn``: strata, ok (whether a row of the sample can be used itself); ``backups``: strata of rows that
    could not, and fill (``same``, ``cross``, else unfilled), see ``greedy_backups``. Strata without rows have zeros.
    """
    own = drawn.groupBy(*strata).agg(F.count_if("ok").alias("primary_ok"))
    other = backups.groupBy(*strata).agg(*[F.count_if(F.col("fill") == k).alias(f"backup_{k}") for k in ("same", "cross")])
    counts = ["primary_ok", "backup_same", "backup_cross"]
    out = planned.join(own, strata, "left").join(other, strata, "left").na.fill(0, counts)
    out = out.withColumn("achieved", F.col("primary_ok") + F.col("backup_same") + F.col("backup_cross"))
    pct = F.round(100.0 * F.col("achieved") / F.nullif(F.col("planned"), F.lit(0)), 6)
    return out.select(*strata, "planned", "achieved", (F.col("achieved") - F.col("planned")).alias("delta"), pct.alias("pct_achieved"), *counts, F.greatest(F.col("planned") - F.col("achieved"), F.lit(0)).alias("unfilled"))
