"""Agreement of raters, in plain aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cohen_kappa(ratings: DataFrame, a: str, b: str) -> DataFrame:
    """(n, observed, expected, kappa) of two raters, unweighted; null if chance alone explains all."""
    cells = ratings.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("x").alias("l"), F.col("n").alias("na"), F.lit(0).alias("nb")), F.struct(F.col("y").alias("l"), F.lit(0).alias("na"), F.col("n").alias("nb")))).alias("s"))
    margins = sides.groupBy("s.l").agg(F.sum("s.na").alias("na"), F.sum("s.nb").alias("nb"))
    chance = margins.agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("c"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    n = F.col("n").cast("double")
    out = total.crossJoin(chance).select("n", F.try_divide(F.col("same").cast("double"), n).alias("observed"), F.try_divide(F.col("c"), n * n).alias("expected"))
    return out.withColumn("kappa", F.try_divide(F.col("observed") - F.col("expected"), F.nullif(1 - F.col("expected"), F.lit(0.0))))


def fleiss_kappa(ratings: DataFrame, raters: list[str], subject: str) -> DataFrame:
    """(n, observed, expected, kappa) of several raters; null if chance alone explains all."""
    r = float(len(raters))
    votes = ratings.select(subject, F.explode(F.array(*raters)).alias("label"))
    cells = votes.groupBy(subject, "label").agg(F.count("*").cast("double").alias("v"))
    each = cells.groupBy(subject).agg((F.sum(F.col("v") * F.col("v")) - r).alias("p"))
    observed = each.agg(F.count("*").alias("n"), (F.sum("p") / (r * (r - 1))).alias("p"))
    margin = cells.groupBy("label").agg(F.sum("v").alias("v")).agg(F.sum(F.col("v") * F.col("v")).alias("e"))
    out = observed.crossJoin(margin).select("n", F.try_divide(F.col("p"), F.col("n")).alias("observed"), F.try_divide(F.col("e"), F.col("n") * F.col("n") * r * r).alias("expected"))
    return out.withColumn("kappa", F.try_divide(F.col("observed") - F.col("expected"), F.nullif(1 - F.col("expected"), F.lit(0.0))))


def confusion(ratings: DataFrame, a: str, b: str, labels: list) -> DataFrame:
    return ratings.groupBy(a).pivot(b, labels).count().na.fill(0)


def patterns(ratings: DataFrame, h: str, p: str, q: str) -> DataFrame:
    """How three raters agree: all, two of them, none."""
    kind = (
        F.when((F.col(h) == F.col(p)) & (F.col(p) == F.col(q)), "all")
        .when(F.col(h) == F.col(p), "first_second")
        .when(F.col(h) == F.col(q), "first_third")
        .when(F.col(p) == F.col(q), "second_third")
        .otherwise("none")
    )
    return ratings.groupBy(kind.alias("pattern")).agg(F.count("*").alias("n"))


def transitions(ratings: DataFrame, p: str, q: str) -> DataFrame:
    return ratings.where(F.col(p) != F.col(q)).groupBy(p, q).agg(F.count("*").alias("n"))


def distribution(ratings: DataFrame, raters: list[str]) -> DataFrame:
    """Counts of each label by rater."""
    votes = ratings.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rater"), F.col(r).alias("label")) for r in raters])).alias("v"))
    counts = [F.count_if(F.col("v.rater") == r).alias(r) for r in raters]
    return votes.groupBy(F.col("v.label").alias("label")).agg(*counts)


def aligned(sample: DataFrame, human: DataFrame, machine: DataFrame, keys: list[str], labels: list) -> DataFrame:
    """Three raters side by side: sampled ids with human labels, and the last machine record of their key; labels of the domain only."""
    latest = machine.groupBy(*keys).agg(F.max_by(F.struct("pass1", "pass2"), "seq").alias("m"))
    both = sample.join(human, "event_id").join(latest, keys)
    out = both.select("event_id", *keys, F.upper(F.trim("human")).alias("human"), "m.pass1", "m.pass2")
    for c in ("human", "pass1", "pass2"):
        out = out.where(F.col(c).isin(*labels))
    return out
