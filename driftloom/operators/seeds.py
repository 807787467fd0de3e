"""Seed lists: canonical columns, validation, de-duplication, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def canonical(rows: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """The first present of each column's aliases, under its canonical name; columns without one are left out."""
    have = {c.lower(): c for c in rows.columns}
    found = {to: next((have[a.lower()] for a in aliases if a.lower() in have), None) for to, aliases in names.items()}
    return rows.select(*[F.col(f"`{c}`").alias(to) for to, c in found.items() if c])


def validated(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with ``violations``: the names of the rules that do not hold. A rule that is null does not hold."""
    return rows.withColumn("violations", F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()])))


def definition_rules(of: str = "") -> dict[str, Column]:
    """Of a definition, or of a struct column ``of`` that holds one: all fields are required, a schema is a JSON object, a sha is not blank."""
    c = lambda name: F.col(f"{of}.{name}" if of else name)
    required = {name: c(name).isNotNull() for name in ("tool", "description", "source_file", "commit_date", "repo")}
    return required | {"schema": F.substring(F.ltrim(F.get_json_object(c("schema"), "$")), 1, 1) == "{", "sha": F.trim(c("sha")) != ""}


def seed_rules() -> dict[str, Column]:
    return {"repo_url": F.col("repo_url").isNotNull(), "registry_source": F.col("registry_source").isNotNull(), "stars": F.col("stars").isNull() | (F.col("stars") >= 0)}


def event_rules() -> dict[str, Column]:
    """Of a change: its two definitions and its classification."""
    return {
        "tool": F.col("before.tool").eqNullSafe(F.col("after.tool")) & F.col("tool").eqNullSafe(F.col("before.tool")),
        "repo": F.col("before.repo").eqNullSafe(F.col("after.repo")),
        "sha": (F.trim("before.sha") != "") & (F.trim("after.sha") != ""),
        "classified_by": F.col("classified_by").isNotNull(),
        "confidence": F.col("confidence").between(0.0, 1.0),
        "change_type": F.col("change_type").isin("cosmetic", "schema_change", "permission_change", "description_semantic_change", "name_unchanged_behavior_changed"),
    }


def merged(sources: list[DataFrame]) -> DataFrame:
    """All sources' rows with a usable URL, once each: most stars first, then the earlier source, then its order."""
    parts = [s.withColumn("__source", F.lit(k)) for k, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out = out.withColumn("repo_url", C.canonical_url("repo_url")).where(F.col("repo_url").startswith("https://"))
    order = [F.desc_nulls_last("stars"), F.asc("__source"), *[F.asc(c) for c in ("seq",) if c in out.columns]]
    return first_per_key(out, ["repo_url"], order).drop("__source")


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def last_per_key(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last write wins. Pre-aggregated before the shuffle, so a key of many writes is no hot spot."""
    rest = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("x"))
    return latest.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def remaining(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that a checkpoint does not hold yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def queued(events: DataFrame, seeds: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """The seeds' events first, then the others, each in md5 order; with ``priority``."""
    listed = seeds.select(*keys).distinct()
    first = events.join(listed, keys, "left_semi").withColumn("priority", F.lit(0))
    rest = events.join(listed, keys, "left_anti").withColumn("priority", F.lit(1))
    return first.unionByName(rest).withColumn("ticket", C.digest(*keys, seed=seed))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def walk_targets(records: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Repositories whose history is walked: no replacements, nothing to replace, at least one tool."""
    ok = F.col("is_replacement_for").isNull() & ~F.coalesce("replacement_needed", F.lit(False)) & (F.col("tools_found") > 0)
    return records.where(ok if wanted is None else ok & C.slug("repo_url").isin(*wanted))


def with_results(results: DataFrame, candidates: DataFrame, slot: str, columns: list[str]) -> DataFrame:
    """Each result with the definitions of its slot's candidate, as JSON text; ``{}`` where the candidate or its definition is missing.

    Of several candidates of a slot the last one by all their columns counts. A result without a slot has none.
    """
    one = candidates.where(F.col(slot).isNotNull()).groupBy(slot).agg(F.max(F.struct(*columns)).alias("__c"))
    filled = [F.coalesce(F.col(f"__c.{c}"), F.lit("{}")).alias(c) for c in columns]
    return results.join(one, slot, "left").select(*results.columns, *filled)
