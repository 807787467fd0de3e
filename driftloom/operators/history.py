"""Version histories: consecutive pairs, their differences, and which snapshot a difference belongs to.

Frames of versions have: repo, tool, commit_date (string, ordered as text), seq (ingest order), sha,
description, props (map of property to type), source_file. Windows are partitioned by (repo, tool), never by repo alone:
changes crowd in few repositories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import diffs as D
from .rounds import settled
from .similar_sets import candidate_pairs


def consecutive(versions: DataFrame) -> DataFrame:
    """Each version with the one before it in ``prev``; the first one's is null. One shuffle on (repo, tool)."""
    w = Window.partitionBy("repo", "tool").orderBy("commit_date", "seq")
    n = F.count("*").over(Window.partitionBy("repo", "tool"))
    return versions.withColumn("prev", F.lag(F.struct("sha", "commit_date", "seq", "description", "props", "source_file")).over(w)).withColumn("n_versions", n)


def diffs(versions: DataFrame, firsts: bool = False) -> DataFrame:
    """One row for each consecutive pair, changed or not. A null description is an empty one, null props are none. With
    ``firsts`` an entity's first version has a row too: without a from side, and never valid."""
    pairs = consecutive(versions)
    if not firsts:
        pairs = pairs.where("prev is not null")
    none = F.create_map().cast("map<string,string>")
    before, after = F.coalesce("prev.props", none), F.coalesce("props", none)
    out = pairs.select(
        "repo", "tool", F.col("prev.seq").alias("from_seq"), F.col("seq").alias("to_seq"),
        F.substring("prev.sha", 1, 8).alias("from_sha"), F.substring("sha", 1, 8).alias("to_sha"),
        F.col("prev.commit_date").alias("from_date"), F.col("commit_date").alias("to_date"),
        F.coalesce("prev.description", F.lit("")).alias("before"), F.coalesce("description", F.lit("")).alias("after"),
        (F.coalesce("prev.description", F.lit("")) != F.coalesce("description", F.lit(""))).alias("description_changed"),
        C.fields_added(before, after).alias("fields_added"), C.fields_removed(before, after).alias("fields_removed"),
        C.type_changes(before, after).alias("type_changes"),
        before.alias("before_props"), after.alias("after_props"),
        (~F.col("prev.source_file").eqNullSafe(F.col("source_file"))).alias("source_file_changed"),
        F.col("prev.source_file").alias("from_file"), F.col("source_file").alias("to_file"), F.col("prev").isNotNull().alias("follows"), "n_versions",
    )
    sizes = [F.size(c) for c in ("fields_added", "fields_removed", "type_changes")]
    changed = F.col("description_changed") | (sizes[0] > 0) | (sizes[1] > 0) | (sizes[2] > 0)
    return (
        out.withColumn("is_inplace_mutation", F.lit(True))
        .withColumn("changed", changed & F.col("follows"))
        .withColumn("valid", F.col("changed") & ~F.col("from_sha").eqNullSafe(F.col("to_sha")))
        .withColumn("structural_type", F.when(F.col("changed"), C.structural_type("description_changed", *sizes)))
        .drop("follows")
    )


def change_rates(versions: DataFrame) -> DataFrame:
    """(repo, tool, n, c): each entity's versions and its valid changes, in one pass over the versions."""
    return diffs(versions, firsts=True).groupBy("repo", "tool").agg(F.count("*").alias("n"), F.count_if("valid").alias("c"))


def records(versions: DataFrame) -> DataFrame:
    """The record of a history: a row for each consecutive pair (status ``drift_event``), and one for each entity that has a single
    version (``no_drift_observed``), which has no from side and no differences; all from one pass over the versions.

    ``description_diff`` is the unified diff of the two descriptions, empty if they are equal.
    """
    e = diffs(versions, firsts=True).withColumn("alone", F.col("from_seq").isNull()).where("not alone or n_versions = 1")
    pair = lambda c: F.when(~F.col("alone"), F.col(c)).alias(c)
    return e.withColumn("description_diff", D.unified_diff("before", "after")).select(
        "repo", "tool", F.when(F.col("alone"), F.lit(1)).alias("snapshot_count"), "from_seq", "to_seq", "from_sha", "to_sha", "from_date", "to_date",
        *[pair(c) for c in ("description_changed", "description_diff", "fields_added", "fields_removed", "type_changes", "is_inplace_mutation", "source_file_changed")],
        F.when(F.col("alone"), "no_drift_observed").otherwise("drift_event").alias("status"),
    )


def single_versions(versions: DataFrame) -> DataFrame:
    """Entities that have one version only: nothing can have changed."""
    one = versions.groupBy("repo", "tool").agg(F.count("*").alias("snapshot_count"), F.substring(F.min("sha"), 1, 8).alias("sha"), F.min("commit_date").alias("commit_date"))
    return one.where("snapshot_count = 1").withColumn("status", F.lit("no_drift_observed"))


def moves(versions: DataFrame) -> DataFrame:
    """Consecutive versions in different files, as ``a -> b``."""
    d = diffs(versions).where("source_file_changed")
    return d.select("repo", "tool", "to_seq", F.concat_ws(" -> ", "from_file", "to_file").alias("moved"))


def last_versions(versions: DataFrame, n: int) -> DataFrame:
    """The last ``n`` versions of each (repo, source_file)."""
    w = Window.partitionBy("repo", "source_file").orderBy(F.desc("commit_date"), F.desc("seq"))
    return versions.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def picked_snapshots(events: DataFrame, versions: DataFrame) -> DataFrame:
    """``events`` with ``before`` and ``after``: the version (seq, description, props, source_file) that each side of a change shows.

    Of several versions at a side's sha, the first that has all removed (before) or added (after) fields, else the last;
    null without one. Both sides look in one join, and each takes the least of an aggregate, so a sha of many versions
    is nowhere sorted. ``events``: one row for each (repo, tool, from_seq, to_seq).
    """
    keys, event = ["repo", "tool", "__sha"], ["repo", "tool", "from_seq", "to_seq"]
    side = lambda name, sha, target: F.struct(F.lit(name).alias("side"), F.col(sha).alias("sha"), F.col(target).alias("target"))
    wanted = events.select(*event, F.explode(F.array(side("before", "from_sha", "fields_removed"), side("after", "to_sha", "fields_added"))).alias("w"))
    wanted = wanted.select(*event, "w.side", F.col("w.sha").alias("__sha"), "w.target")
    there = versions.select("repo", "tool", F.substring("sha", 1, 8).alias("__sha"), F.struct("seq", "description", "props", "source_file").alias("v"))
    met = wanted.join(there, keys)
    fits = F.coalesce((F.size("target") > 0) & (F.size(F.array_except("target", F.map_keys("v.props"))) == 0), F.lit(False))
    rank = F.struct((~fits).alias("unfit"), F.when(fits, F.col("v.seq")).otherwise(-F.col("v.seq")).alias("at"))
    picked = met.groupBy(*event).pivot("side", ["before", "after"]).agg(F.min_by("v", rank))
    return events.join(picked, event, "left")


def rename_candidates(versions: DataFrame, few: int = 256) -> DataFrame:
    """Names that a file lost at one version and gained at the next, alike in properties (0.5) and words (0.3).

    A file's version is one row of its names, so versions are read and shuffled once. A step of ``few`` pairs at most makes
    them in its row. In larger ones, names that were removed and added meet at rare words of their descriptions (see
    ``similar_sets.candidate_pairs``), so a step that renames thousands makes few pairs beside those that are alike. Names
    with nothing to describe them meet at their properties; without those too, all of a step are alike.
    """
    props = F.coalesce("props", F.create_map().cast("map<string,string>"))
    known = versions.dropna(subset=["repo", "source_file", "commit_date", "tool"]).select("repo", "source_file", "commit_date", "tool", "seq", "description", props.alias("props"))
    one = known.repartition("repo", "source_file").groupBy("repo", "source_file", "commit_date", "tool").agg(F.max_by(F.struct("description", F.map_keys("props").alias("keys")), "seq").alias("x"))
    step = Window.partitionBy("repo", "source_file").orderBy("commit_date")
    names = one.groupBy("repo", "source_file", "commit_date").agg(F.collect_list(F.struct("tool", "x.description", "x.keys")).alias("new"))
    steps = names.withColumn("old", F.lag("new").over(step)).withColumn("from_date", F.lag("commit_date").over(step)).where("old is not null")
    steps = steps.withColumn("gone", F.array_except("old.tool", "new.tool")).withColumn("come", F.array_except("new.tool", "old.tool")).where("size(gone) > 0 and size(come) > 0")
    small = F.size("gone").cast("long") * F.size("come") <= few
    # Only a small step looks its names up in the row: that takes as many comparisons as it has names and changes.
    own = lambda side, changed: F.when(small, F.filter(side, lambda t: F.array_contains(changed, t["tool"]))).otherwise(F.col(side)).alias(side)
    steps = settled(steps.select("repo", "source_file", "from_date", F.col("commit_date").alias("to_date"), "gone", "come", own("old", "gone"), own("new", "come")), "steps")
    on = ["repo", "source_file", "from_date", "to_date"]

    def alike(pairs: DataFrame) -> DataFrame:
        pairs = pairs.withColumn("schema_jaccard", C.jaccard("o_keys", "n_keys")).where("schema_jaccard >= 0.5").withColumn("text_jaccard", C.jaccard("o_words", "n_words"))
        pairs = pairs.where("text_jaccard >= 0.3").withColumn("tier", C.rename_tier("schema_jaccard", "text_jaccard"))
        return pairs.select(*on, F.col("left_id").alias("old_tool"), F.col("right_id").alias("new_tool"), "schema_jaccard", "text_jaccard", "tier")

    each = steps.where(small).select(*on, F.explode("old").alias("o"), "new").select(*on, "o", F.explode("new").alias("n"))
    words = lambda side, mark: [C.word_set(f"{side}.description").alias(f"{mark}_words"), F.col(f"{side}.keys").alias(f"{mark}_keys")]
    near = alike(each.select(*on, F.col("o.tool").alias("left_id"), F.col("n.tool").alias("right_id"), *words("o", "o"), *words("n", "n")))
    large = steps.where(~small)
    if not large.limit(1).count():
        return near

    def moved(side: str, changed: str) -> DataFrame:
        out = large.select(*on, F.explode(side).alias("t")).select(*on, F.col("t.tool").alias("tool"), C.word_set("t.description").alias("words"), F.col("t.keys").alias("keys"))
        return settled(out.join(large.select(*on, F.explode(changed).alias("tool")), [*on, "tool"]), "moved")

    gone, come = moved("old", "gone"), moved("new", "come")
    silent = "size(words) = 0"
    pairs = candidate_pairs(gone, come, on, "tool", "words", 0.3).unionByName(candidate_pairs(gone.where(silent), come.where(silent), on, "tool", "keys", 0.5))
    bare = f"{silent} and size(keys) = 0"
    pairs = pairs.unionByName(gone.where(bare).select(*on, F.col("tool").alias("left_id")).join(come.where(bare).select(*on, F.col("tool").alias("right_id")), on))
    side = lambda df, name, mark: df.select(*on, F.col("tool").alias(name), F.col("words").alias(f"{mark}_words"), F.col("keys").alias(f"{mark}_keys"))
    return near.unionByName(alike(pairs.join(side(gone, "left_id", "o"), [*on, "left_id"]).join(side(come, "right_id", "n"), [*on, "right_id"])))
