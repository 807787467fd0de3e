"""Order statistics of a column and the first of each group, by counts of bins: no group is sorted whole."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .rounds import dropped, settled

#: Bins of an interval in each round of a rank's search.
BINS = 1024
#: Rows of a stratum's bin, about, among which the last of a sample are sorted.
EDGE_ROWS = 4096


def _bin(c: Column, lo, hi, bins: int, whole: bool) -> Column:
    """The bin of equal width that a value of [lo, hi] is in; ascending with the value."""
    if whole:
        wide = lambda x: x.cast("decimal(20,0)")
        at = (wide(c) - wide(F.lit(lo))) * bins / (wide(F.lit(hi)) - wide(F.lit(lo)) + 1)
    else:
        half = 1.0 if math.isfinite(hi - lo) else 2.0  # the difference of two doubles may be none
        at = (c / F.lit(half) - F.lit(lo / half)) / F.lit(hi / half - lo / half) * bins
    return F.least(F.floor(at).cast("int"), F.lit(bins - 1))


def ranked_values(values: DataFrame, column: str, ranks: Iterable[int], bins: int = BINS) -> dict[int, object]:
    """The values of ``column`` (a number, never null) at some ranks, from 0, in ascending order.

    Each round counts the rows of ``bins`` bins of the intervals that still hold a rank, with the least and the largest value
    of each, and goes on with the bins that hold it, until they hold one value. A task keeps ``bins`` counters for
    each interval, whatever the rows are; rounds grow with the logarithm of the range over the spacing of values.
    """
    whole = isinstance(values.schema[column].dataType, IntegralType)
    c = F.col(column) if whole else F.col(column).cast("double")
    n, lo, hi = values.agg(F.count(c), F.min(c), F.max(c)).first()
    found: dict[int, object] = {}
    wanted = sorted({r for r in ranks if 0 <= r < n})
    open_ = [(lo, hi, 0, wanted)] if wanted else []
    while open_:
        for k in [k for k, (lo, hi, _, _) in enumerate(open_) if lo == hi]:
            found |= dict.fromkeys(open_[k][3], open_[k][0])
        open_ = [x for x in open_ if x[0] != x[1]]
        if not open_:
            break
        at = F.lit(None).cast("int")
        for k, (lo, hi, _, _) in enumerate(open_):
            at = F.when(c.between(lo, hi), _bin(c, lo, hi, bins, whole) + k * bins).otherwise(at)
        counts = values.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).where("at is not null").collect()
        nexts: dict[int, tuple] = {}
        for k, (_, _, below, own) in enumerate(open_):
            for b in sorted((r for r in counts if r["at"] // bins == k), key=lambda r: r["at"]):
                inside = [r for r in own if below <= r < below + b["n"]]
                if inside:
                    nexts[b["at"]] = (b["lo"], b["hi"], below, inside)
                below += b["n"]
        open_ = list(nexts.values())
    return found


def exact_quantiles(rows: DataFrame, column: str, at: Iterable[float], bins: int = BINS) -> list[float | None]:
    """Quantiles, linear between the two neighbours, of the values of ``column`` that are neither null nor NaN; None without any."""
    at = list(at)
    values = rows.select(F.col(column).alias("v")).where("v is not null")
    if not isinstance(values.schema["v"].dataType, IntegralType):
        values = values.select(F.col("v").cast("double").alias("v")).where(~F.isnan("v"))
    table = settled(values, "values")
    n = table.count()
    places = [q * (n - 1) for q in at]
    found = ranked_values(table, "v", {r for p in places for r in (math.floor(p), math.ceil(p))}, bins) if n else {}
    dropped(table)
    if not n:
        return [None] * len(at)
    return [float(found[math.floor(p)]) + (float(found[math.ceil(p)]) - float(found[math.floor(p)])) * (p - math.floor(p)) for p in places]


def first_of_each(rows: DataFrame, strata: list[str], digest: Column, keys: list[str], quota: DataFrame, name: str = "in_sample", edge_rows: int = EDGE_ROWS) -> DataFrame:
    """``rows`` with ``name`` (boolean): whether they are among the first ``quota`` of their stratum in the order of ``digest``, then ``keys``.

    ``digest``: hexadecimal text that is spread evenly, as md5 is; ``quota``: strata and ``allocated``, a row for each stratum. The
    digests' first digits, as many as leave ``edge_rows`` rows of the largest stratum to each, are counted; below the bin in which
    a stratum's quota ends all rows are in, above it none, and only the rows of that bin are sorted. So no stratum is
    sorted, however large it is. A null stratum is a stratum; one without a quota has none. ``rows`` are computed once and
    written, as they are read four times.
    """
    d = settled(rows.withColumn("__digest", digest), "sampled")
    sizes = d.groupBy(*strata).agg(F.count("*").alias("__n"))
    largest = sizes.agg(F.max("__n")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(1, largest / edge_rows), 16)))
    d = d.withColumn("__bin", F.substring("__digest", 1, digits))
    bins = d.groupBy(*strata, "__bin").agg(F.count("*").alias("__n"))
    upto = bins.withColumn("__upto", F.sum("__n").over(Window.partitionBy(*strata).orderBy("__bin"))).withColumn("__all", F.sum("__n").over(Window.partitionBy(*strata)))
    q = quota.select(*[F.col(c).alias(f"__q_{c}") for c in strata], F.col("allocated").alias("__quota"))
    same = F.lit(True)
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"__q_{c}"))
    ends = upto.join(q, same).withColumn("__quota", F.least("__quota", "__all")).where("__upto - __n < __quota and __quota <= __upto")
    ends = ends.select(*[f"__q_{c}" for c in strata], F.col("__bin").alias("__edge"), (F.col("__quota") - F.col("__upto") + F.col("__n")).alias("__left"))
    met = d.join(ends, same, "left")
    clear = met.where("__edge is null or __bin <> __edge").select(*rows.columns, F.coalesce(F.col("__bin") < F.col("__edge"), F.lit(False)).alias(name))
    w = Window.partitionBy(*strata).orderBy("__digest", *keys)
    edge = met.where("__bin = __edge").withColumn("__r", F.row_number().over(w)).select(*rows.columns, (F.col("__r") <= F.col("__left")).alias(name))
    return clear.unionByName(edge)
