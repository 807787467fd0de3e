"""Counts, rates, pivots and other group-by reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import exact_quantiles


def rate(hits: Column, of: Column, digits: int = 6) -> Column:
    return F.round(100.0 * hits / F.nullif(of, F.lit(0)), digits)


def value_counts(rows: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, n, pct), most frequent first by rank; beyond ``top``, one row ``other``. Null is ``(unknown)``."""
    counts = rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(unknown)")).alias("value")).agg(F.count("*").alias("n"))
    if top is not None:
        first = counts.orderBy(F.desc("n"), "value").limit(top).select("value", F.lit(True).alias("__top"))
        counts = counts.join(F.broadcast(first), "value", "left").groupBy(F.when(F.col("__top"), F.col("value")).otherwise("other").alias("value")).agg(F.sum("n").alias("n"))
    return with_total(counts, "n", "__all").select("value", "n", rate(F.col("n"), F.col("__all")).alias("pct"))


def with_total(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``column`` over all of them: a one-row frame, so that no task gathers the rows."""
    return rows.crossJoin(F.broadcast(rows.agg(F.sum(column).alias(name))))


def pivot_totals(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and column with forced columns, zeros, and totals both ways."""
    each = [F.count_if(F.col(column) == v).alias(v) for v in values]
    table = rows.groupBy(F.col(row).cast("string").alias(row)).agg(*each)
    total = table.agg(F.lit("total").alias(row), *[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values])
    return table.unionByName(total).withColumn("total", reduce(lambda a, b: a + b, [F.col(v) for v in values]))


def quantiles(rows: DataFrame, column: str, at=(0.25, 0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """Exact quantiles, linear between neighbours, and the largest value. Ranks are found by rounds of counted bins, so no
    task holds the column's values; what reaches the driver is bounded by the number of bins and of quantiles."""
    exact = [F.lit(None if v is None else round(v, 6)).cast("double").alias(f"p{round(100 * q)}") for q, v in zip(at, exact_quantiles(rows, column, at), strict=True)]
    return rows.agg(F.max(column).alias("max")).select(*exact, "max")


def summary(rows: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    (median,) = exact_quantiles(rows, column, [0.5])
    out = rows.agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.max(c).alias("max"), rate(F.count_if(c == 0), F.count(c)).alias("zero_pct"))
    return out.select("n", F.lit(None if median is None else round(median, 6)).cast("double").alias("median"), "mean", "max", "zero_pct")


def crosstab(events: DataFrame, by: str, both: Column, second: Column, repo: str = "repo") -> DataFrame:
    """Events, repositories, and how many percent of each show drift, by segment. Counted by repository first: no distinct over events."""
    each = events.withColumn("__b", both).withColumn("__s", second).groupBy(by, repo).agg(
        F.count("*").alias("events"), F.count_if("__b").alias("n_both"), F.count_if("__s").alias("n_second"),
    )
    out = each.groupBy(by).agg(
        F.sum("events").alias("events"), F.count(repo).alias("repos"), F.sum("n_both").alias("n_both"), F.sum("n_second").alias("n_second"),
        F.count_if(F.col(repo).isNotNull() & (F.col("n_second") > 0)).alias("repos_drifting"),
    )
    return out.select(
        by, "events", "repos", rate(F.col("n_both"), F.col("events")).alias("pct_both"), rate(F.col("n_second"), F.col("events")).alias("pct_second"),
        rate(F.col("repos_drifting"), F.col("repos")).alias("pct_repos"),
    )


def concentration(events: DataFrame, by: str, k: int) -> DataFrame:
    """The k groups of most events and their shares. A group is one row before the ranking."""
    counts = events.groupBy(by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), by).limit(k)
    w = Window.orderBy(F.desc("n"), by)
    out = top.withColumn("rank", F.row_number().over(w).cast("bigint")).withColumn("running", F.sum("n").over(w)).crossJoin(F.broadcast(total))
    return out.select(by, "rank", "n", rate(F.col("n"), F.col("total")).alias("pct"), rate(F.col("running"), F.col("total")).alias("cumulative_pct"))


def leave_out(events: DataFrame, by: str, hit: Column, k: int) -> DataFrame:
    """The rate of hits after the groups of most hits have been left out, one after another."""
    groups = events.withColumn("__h", hit).groupBy(by).agg(F.count("*").alias("n"), F.count_if("__h").alias("hits"))
    total = groups.agg(F.sum("n").alias("all_n"), F.sum("hits").alias("all_hits"))
    top = groups.orderBy(F.desc("hits"), F.desc("n"), by).limit(k)
    w = Window.orderBy(F.desc("hits"), F.desc("n"), by)
    out = top.withColumn("removed", F.row_number().over(w).cast("bigint")).withColumn("gone_n", F.sum("n").over(w)).withColumn("gone_hits", F.sum("hits").over(w)).crossJoin(F.broadcast(total))
    left_n, left_hits = F.col("all_n") - F.col("gone_n"), F.col("all_hits") - F.col("gone_hits")
    first = total.select(F.lit(0).cast("bigint").alias("removed"), F.lit(None).cast(events.schema[by].dataType).alias(by), rate(F.col("all_hits"), F.col("all_n")).alias("rate"))
    return first.unionByName(out.select("removed", by, rate(left_hits, left_n).alias("rate")))


def funnel(stages: DataFrame) -> DataFrame:
    """(ord, stage, n) with percent of the first stage."""
    first = F.first_value("n").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stages.withColumn("pct", rate(F.col("n"), first))


def share_delta(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Each group's share in a and in b, in percent, and their difference."""
    share = lambda d, name: with_total(d.groupBy(by).count(), "count", "__all").select(by, (F.col("count") / F.nullif("__all", F.lit(0)) * 100.0).alias(name))
    both = share(a, "a").join(share(b, "b"), by, "full").na.fill(0.0, ["a", "b"])
    return both.select(by, F.round("a", 6).alias("pct_a"), F.round("b", 6).alias("pct_b"), F.round(F.col("a") - F.col("b"), 6).alias("delta"))


def count_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """How counts moved between two runs, by category. A key that is missing in one run has 0 there."""
    both = old.select(key, F.col("n").alias("o")).join(new.select(key, F.col("n").alias("w")), key, "full").na.fill(0, ["o", "w"])
    o, w = F.col("o"), F.col("w")
    kind = (
        F.when((o > 0) & (w == 0), "to_zero").when((w > 0) & (w < o), "fewer").when((o > 0) & (w > o), "more")
        .when((o == 0) & (w > 0), "from_zero").when((o == 0) & (w == 0), "stays_zero").otherwise("unchanged")
    )
    return both.groupBy(kind.alias("category")).agg(F.count("*").alias("n"), F.sum(w - o).alias("delta"))


def coverage_gate(before: int, after: int, least: float = 0.8) -> bool:
    """Whether a step has kept enough of its rows."""
    return before == 0 or after / before >= least


def stability(runs: DataFrame, subject: list[str], side: str, signature: str) -> DataFrame:
    """A subject's side is stable if all its runs share one signature; a finding, if both sides are."""
    each = runs.groupBy(*subject, side).agg(F.count_distinct(signature).alias("variants"), F.count("*").alias("runs"), F.min(signature).alias("signature"))
    out = each.groupBy(*subject).agg(
        F.sum("runs").alias("runs"), F.max("variants").alias("variants"), F.count("*").alias("sides"), F.count_distinct("signature").alias("signatures"),
    )
    stable = F.col("variants") == 1
    return out.withColumn("finding_stable", stable & (F.col("sides") == 2)).withColumn("differs", stable & (F.col("sides") == 2) & (F.col("signatures") == 2))
