"""Named queries over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import diffs as D
from ..operators import agreement, extraction, history, reports, sampling, seeds
from . import views as V
from .views import RATERS, SEEDS, VERSIONS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LANGUAGES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
BUCKETS = [*C.STAR_LABELS, "nan"]
CUTOFF = "1998-01-01"


def _counts(sql: str) -> str:
    """``sql`` with each count_if cast to BIGINT: DuckDB gives a HUGEINT."""
    out, at = [], 0
    while (k := sql.find("count_if(", at)) >= 0:
        end, depth = k + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[at:k], "CAST(", sql[k:end], " AS BIGINT)"]
        at = end
    return "".join(out) + sql[at:]


def query(sql: str | None = None, views: str = "", name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = (f"WITH {views} " if views else "") + _counts(sql)
        return f

    return register


def _changes(spark, d):
    return history.diffs(V.versions(spark, d))


def _drifting(spark, d):
    return V.labelled(_changes(spark, d).where("valid"))


def _moved(c="type_changes"):
    return F.array_join(F.transform(c, lambda x: F.concat(x["field"], F.lit(":"), x["from_type"], F.lit(">"), x["to_type"])), ",")


def _bucketed(spark, d):
    s = V.seeds(spark, d).withColumn("bucket", C.star_bucket("stars"))
    return s.withColumn("reason", C.exclusion_reason("stars", "archived", "pushed", F.lit(CUTOFF).cast("timestamp_ntz")))


def _eligible(spark, d):
    return _bucketed(spark, d).where("reason = 'eligible'")


# --- Histories ----------------------------------------------------------------------------------------------


@query(
    "SELECT repo, tool, from_seq, to_seq, from_sha, to_sha, description_changed, added AS fields_added, removed AS fields_removed, types AS type_changes, source_file_changed, changed, valid, structural_type FROM diffs",
    VERSIONS,
)
def consecutive_diff(spark, d):
    return _changes(spark, d).select(
        "repo", "tool", "from_seq", "to_seq", "from_sha", "to_sha", "description_changed", C.joined("fields_added", ",").alias("fields_added"),
        C.joined("fields_removed", ",").alias("fields_removed"), _moved().alias("type_changes"), "source_file_changed", "changed", "valid", "structural_type",
    )


@query("SELECT repo, tool, count(*) AS snapshot_count, min(sha) AS sha, min(commit_date) AS commit_date, 'no_drift_observed' AS status FROM versions GROUP BY repo, tool HAVING count(*) = 1", VERSIONS)
def no_drift_singletons(spark, d):
    return history.single_versions(V.versions(spark, d))


@query(
    """SELECT repo, tool, CAST(NULL AS INT) AS snapshot_count, from_sha, to_sha, to_seq, description_changed, CASE WHEN description_changed THEN concat('--- before+++ after@@ -1 +1 @@-', before, '+', after) ELSE '' END AS description_diff,
    added AS fields_added, removed AS fields_removed, types AS type_changes, source_file_changed, 'drift_event' AS status FROM diffs
    UNION ALL SELECT repo, tool, 1, NULL, min(sha), min(seq), NULL, NULL, '', '', NULL, NULL, 'no_drift_observed' FROM versions GROUP BY repo, tool HAVING count(*) = 1""",
    VERSIONS,
)
def diff_records(spark, d):
    """Pairs and entities without one in a single frame, with the descriptions' diff; descriptions are of one line here."""
    return history.records(V.versions(spark, d)).select(
        "repo", "tool", "snapshot_count", "from_sha", "to_sha", "to_seq", "description_changed", "description_diff", C.joined("fields_added", ",").alias("fields_added"),
        C.joined("fields_removed", ",").alias("fields_removed"), _moved().alias("type_changes"), "source_file_changed", "status",
    )


@query(
    """SELECT count(*) AS entities, count_if(n >= 2) AS with_history, round(100.0 * count_if(n >= 2) / count(*), 6) AS pct_history, count_if(c > 0) AS changed, round(100.0 * count_if(c > 0) / count(*), 6) AS pct_changed,
    count(DISTINCT repo) AS repos, count(DISTINCT CASE WHEN c > 0 THEN repo END) AS repos_changed
    FROM (SELECT v.repo, v.tool, v.n, coalesce(x.c, 0) AS c FROM (SELECT repo, tool, count(*) AS n FROM versions GROUP BY repo, tool) v
    LEFT JOIN (SELECT repo, tool, count_if(valid) AS c FROM diffs GROUP BY repo, tool) x ON x.repo = v.repo AND x.tool = v.tool)""",
    VERSIONS,
)
def tool_change_rate(spark, d):
    x = history.change_rates(V.versions(spark, d))
    return x.agg(
        F.count("*").alias("entities"), F.count_if(F.col("n") >= 2).alias("with_history"), reports.rate(F.count_if(F.col("n") >= 2), F.count("*")).alias("pct_history"),
        F.count_if(F.col("c") > 0).alias("changed"), reports.rate(F.count_if(F.col("c") > 0), F.count("*")).alias("pct_changed"),
        F.count_distinct("repo").alias("repos"), F.count_distinct(F.when(F.col("c") > 0, F.col("repo"))).alias("repos_changed"),
    )


@query(
    """SELECT count(*) AS events, count_if(description_changed) AS described, count_if(na > 0) AS added, count_if(nr > 0) AS removed, count_if(nt > 0) AS retyped, count_if(source_file_changed) AS moved,
    count_if(changed) AS changed, count_if(changed AND from_sha = to_sha) AS same_sha, count_if(valid) AS valid, count_if(NOT changed) AS unchanged FROM diffs""",
    VERSIONS,
)
def change_breakdown(spark, d):
    some = lambda c: F.count_if(F.size(c) > 0)
    return _changes(spark, d).agg(
        F.count("*").alias("events"), F.count_if("description_changed").alias("described"), some("fields_added").alias("added"), some("fields_removed").alias("removed"),
        some("type_changes").alias("retyped"), F.count_if("source_file_changed").alias("moved"), F.count_if("changed").alias("changed"),
        F.count_if(F.col("changed") & (F.col("from_sha") == F.col("to_sha"))).alias("same_sha"), F.count_if("valid").alias("valid"), F.count_if(~F.col("changed")).alias("unchanged"),
    )


@query(
    "SELECT structural_type, count(*) AS events, count_if(pass1 AND pass2) AS both, count_if(pass2) AS second, round(100.0 * count_if(pass1 AND pass2) / count(*), 6) AS pct_both, round(100.0 * count_if(pass2) / count(*), 6) AS pct_second FROM drifting GROUP BY structural_type",
    VERSIONS,
)
def drift_rate_by_structural_type(spark, d):
    both = F.count_if(F.col("pass1") & F.col("pass2"))
    return _drifting(spark, d).groupBy("structural_type").agg(
        F.count("*").alias("events"), both.alias("both"), F.count_if("pass2").alias("second"), reports.rate(both, F.count("*")).alias("pct_both"), reports.rate(F.count_if("pass2"), F.count("*")).alias("pct_second")
    )


def _crosstab(by: str):
    sql = f"""SELECT s.{by}, count(*) AS events, count(DISTINCT repo) AS repos, round(100.0 * count_if(pass1 AND pass2) / count(*), 6) AS pct_both, round(100.0 * count_if(pass2) / count(*), 6) AS pct_second,
    round(100.0 * count(DISTINCT CASE WHEN pass2 THEN repo END) / count(DISTINCT repo), 6) AS pct_repos FROM drifting JOIN bucketed s ON s.key = repo GROUP BY s.{by}"""

    def run(spark, d):
        joined = _drifting(spark, d).join(_bucketed(spark, d).select(F.col("key").alias("repo"), by), "repo")
        return reports.crosstab(joined, by, F.col("pass1") & F.col("pass2"), F.col("pass2"))

    query(sql, f"{VERSIONS}, {SEEDS}", f"drift_crosstab_{by}")(run)


for _by in ("language", "bucket", "category"):
    _crosstab(_by)


@query(
    """SELECT repo, row_number() OVER (ORDER BY n DESC, repo) AS rank, n, round(100.0 * n / total, 6) AS pct, round(100.0 * sum(n) OVER (ORDER BY n DESC, repo) / total, 6) AS cumulative_pct
    FROM (SELECT repo, count(*) AS n, sum(count(*)) OVER () AS total FROM drifting WHERE pass2 GROUP BY repo) ORDER BY n DESC, repo LIMIT 10""",
    VERSIONS,
)
def drift_concentration_topk(spark, d):
    return reports.concentration(_drifting(spark, d).where("pass2"), "repo", 10)


@query(
    """SELECT removed, repo, round(100.0 * hits / n, 6) AS rate FROM (SELECT r AS removed, repo, h - sum(hits) OVER w AS hits, a - sum(n) OVER w AS n FROM
    (SELECT repo, n, hits, sum(n) OVER () AS a, sum(hits) OVER () AS h, row_number() OVER (ORDER BY hits DESC, n DESC, repo) AS r FROM (SELECT repo, count(*) AS n, count_if(pass2) AS hits FROM drifting GROUP BY repo))
    WINDOW w AS (ORDER BY r)) WHERE removed <= 5 UNION ALL SELECT 0, NULL, round(100.0 * count_if(pass2) / count(*), 6) FROM drifting""",
    VERSIONS,
)
def drift_leave_out(spark, d):
    return reports.leave_out(_drifting(spark, d), "repo", F.col("pass2"), 5)


@query("SELECT repo, tool, to_seq, concat(from_file, ' -> ', to_file) AS moved FROM diffs WHERE source_file_changed", VERSIONS)
def file_moves(spark, d):
    return history.moves(V.versions(spark, d))


@query("SELECT repo, source_file, seq FROM versions QUALIFY row_number() OVER (PARTITION BY repo, source_file ORDER BY commit_date DESC, seq DESC) <= 2", VERSIONS)
def last_versions_per_file(spark, d):
    return history.last_versions(V.versions(spark, d), 2).select("repo", "source_file", "seq")


@query(
    """SELECT repo, tool, from_seq, to_seq, b.seq AS before_seq, a.seq AS after_seq FROM diffs e
    LEFT JOIN (SELECT to_seq AS k, seq FROM before_pick) b ON b.k = e.to_seq LEFT JOIN (SELECT to_seq AS k, seq FROM after_pick) a ON a.k = e.to_seq WHERE valid""",
    VERSIONS
    + """, options AS (SELECT e.to_seq, side, v.seq, CASE WHEN side = 'before' THEN e.nr ELSE e.na END AS wanted, (SELECT count(*) FROM lines l WHERE l.k = v.seq AND
      list_contains(string_split(CASE WHEN side = 'before' THEN e.removed ELSE e.added END, ','), l.p)) AS have FROM diffs e CROSS JOIN (VALUES ('before'), ('after')) s(side)
      JOIN versions v ON v.repo = e.repo AND v.tool = e.tool AND v.sha = CASE WHEN side = 'before' THEN e.from_sha ELSE e.to_sha END WHERE e.valid),
    best AS (SELECT * FROM options QUALIFY row_number() OVER (PARTITION BY to_seq, side ORDER BY (wanted > 0 AND have = wanted) DESC, CASE WHEN wanted > 0 AND have = wanted THEN seq ELSE -seq END) = 1),
    before_pick AS (SELECT to_seq, seq FROM best WHERE side = 'before'), after_pick AS (SELECT to_seq, seq FROM best WHERE side = 'after')""",
)
def snapshot_pick(spark, d):
    v = V.versions(spark, d)
    e = _changes(spark, d).where("valid").drop("before", "after")
    both = history.picked_snapshots(e, v)
    return both.select("repo", "tool", "from_seq", "to_seq", F.col("before.seq").alias("before_seq"), F.col("after.seq").alias("after_seq"))


@query(
    """SELECT repo, tool, to_seq, concat('--- before+++ after@@ -1 +1 @@-', before, '+', after) AS diff,
    concat_ws(chr(10), concat('  - ', before), concat('  + ', after), '', '  ── word diff ──', concat('  - ', before), concat('  + ', after)) AS view FROM diffs WHERE description_changed""",
    VERSIONS,
)
def description_unified_diff(spark, d):
    """Descriptions are of one line here, and two different ones share no word."""
    e = _changes(spark, d).where("description_changed")
    return e.select("repo", "tool", "to_seq", D.unified_diff("before", "after").alias("diff"), F.array_join(D.diff_lines("before", "after"), "\n").alias("view"))


@query(
    """SELECT o.repo, o.source_file, o.tool AS old_tool, n.tool AS new_tool, o.commit_date AS from_date, n.commit_date AS to_date, round(s, 6) AS schema_jaccard, round(t, 6) AS text_jaccard,
    CASE WHEN s >= 1 AND t >= 1 THEN 'Perfect' WHEN s >= 0.8 AND t >= 0.5 THEN 'High' ELSE 'Medium' END AS tier FROM
    (SELECT o, n, CASE WHEN len(list_distinct(list_concat(o.p, n.p))) = 0 THEN 1.0 ELSE CAST(len(list_intersect(o.p, n.p)) AS DOUBLE) / len(list_distinct(list_concat(o.p, n.p))) END AS s,
      CAST(len(list_intersect(o.w, n.w)) AS DOUBLE) / len(list_distinct(list_concat(o.w, n.w))) AS t FROM steps JOIN named o ON o.repo = steps.repo AND o.source_file = steps.source_file AND o.commit_date = steps.prev
      JOIN named n ON n.repo = steps.repo AND n.source_file = steps.source_file AND n.commit_date = steps.commit_date
      WHERE NOT list_contains(steps.tools, o.tool) AND NOT list_contains(steps.old, n.tool)) WHERE s >= 0.5 AND t >= 0.3""",
    VERSIONS
    + """, named AS (SELECT v.*, coalesce(l.p, []) AS p, list_distinct(list_filter(regexp_split_to_array(lower(description), '\\s+'), lambda x: x <> '')) AS w FROM
      (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY repo, source_file, commit_date, tool ORDER BY seq DESC) = 1) v LEFT JOIN (SELECT k, list(p) AS p FROM lines GROUP BY k) l ON l.k = v.seq),
    steps AS (SELECT * FROM (SELECT repo, source_file, commit_date, list(DISTINCT tool) AS tools, lag(list(DISTINCT tool)) OVER w AS old, lag(commit_date) OVER w AS prev FROM versions GROUP BY repo, source_file, commit_date
      WINDOW w AS (PARTITION BY repo, source_file ORDER BY commit_date)) WHERE prev IS NOT NULL)""",
)
def rename_candidates(spark, d):
    out = history.rename_candidates(V.versions(spark, d))
    return out.select("repo", "source_file", "old_tool", "new_tool", "from_date", "to_date", F.round("schema_jaccard", 6).alias("schema_jaccard"), F.round("text_jaccard", 6).alias("text_jaccard"), "tier")


@query("SELECT count(*) AS events, count_if(source_file_changed AND pa = 0 AND pb = 0) AS risky FROM (SELECT d.*, (SELECT count(*) FROM lines WHERE k = to_seq) AS pa, (SELECT count(*) FROM lines WHERE k = from_seq) AS pb FROM diffs d)", VERSIONS)
def coordinate_risk_counts(spark, d):
    risk = C.coordinate_risk("source_file_changed", F.map_keys("before_props"), F.map_keys("after_props"), "to_file")
    return _changes(spark, d).agg(F.count("*").alias("events"), F.count_if(risk).alias("risky"))


@query(
    """SELECT to_seq, concat_ws('; ', CASE WHEN description_changed THEN 'description changed' END, CASE WHEN na > 0 THEN concat('fields added: [''', replace(added, ',', ''', '''), ''']') END,
    CASE WHEN nr > 0 THEN concat('fields removed: [''', replace(removed, ',', ''', '''), ''']') END,
    CASE WHEN nt > 0 THEN concat('type changes: [''', replace(replace(replace(types, ',', ''', '''), ':', ': '), '>', '→'), ''']') END) AS summary FROM diffs WHERE changed""",
    VERSIONS,
)
def change_summaries(spark, d):
    return _changes(spark, d).where("changed").select("to_seq", C.change_summary("description_changed", "fields_added", "fields_removed", "type_changes").alias("summary"))


@query(
    """SELECT to_seq, concat('Tool ', tool, ' of ', CAST(repo AS VARCHAR), ': ', CASE WHEN bp IS NULL THEN '(none)' ELSE concat('{', bp, '}') END, ' to ', CASE WHEN ap IS NULL THEN '(none)' ELSE concat('{', ap, '}') END) AS prompt FROM diffs
    LEFT JOIN (SELECT k, string_agg(concat(p, ': ', f), ', ' ORDER BY p) AS bp FROM lines GROUP BY k) b ON b.k = from_seq LEFT JOIN (SELECT k, string_agg(concat(p, ': ', f), ', ' ORDER BY p) AS ap FROM lines GROUP BY k) a ON a.k = to_seq WHERE valid""",
    VERSIONS,
)
def rendered_prompts(spark, d):
    e = _changes(spark, d).where("valid")
    text = C.prompt("Tool {tool} of {repo}: {before} to {after}", tool="tool", repo="repo", before=C.rendered_properties("before_props"), after=C.rendered_properties("after_props"))
    return e.select("to_seq", text.alias("prompt"))


# --- Seeds and samples --------------------------------------------------------------------------------------


@query(
    "SELECT key, stars, src FROM (SELECT s_nationkey AS key, CAST(floor(s_acctbal) AS BIGINT) AS stars, 1 AS src, s_suppkey AS seq FROM supplier UNION ALL SELECT c_nationkey, CAST(floor(c_acctbal) AS BIGINT), 0, c_custkey FROM customer) QUALIFY row_number() OVER (PARTITION BY key ORDER BY stars DESC NULLS LAST, src, seq) = 1"
)
def seed_dedup_keep_max(spark, d):
    url = lambda c: F.concat(F.lit("http://github.com/owner/"), F.col(c).cast("string"), F.lit("/"))
    a = table(spark, d, "customer").select(url("c_nationkey").alias("repo_url"), F.col("c_nationkey").alias("key"), F.floor("c_acctbal").alias("stars"), F.lit(0).alias("src"), F.col("c_custkey").alias("seq"))
    b = table(spark, d, "supplier").select(url("s_nationkey").alias("repo_url"), F.col("s_nationkey").alias("key"), F.floor("s_acctbal").alias("stars"), F.lit(1).alias("src"), F.col("s_suppkey").alias("seq"))
    return seeds.merged([a, b]).select("key", "stars", "src")


@query("SELECT key, reason, bucket FROM bucketed", SEEDS)
def exclusion_reason(spark, d):
    return _bucketed(spark, d).select("key", "reason", "bucket")


@query("SELECT reason AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM bucketed GROUP BY reason", SEEDS)
def exclusion_counts(spark, d):
    return reports.value_counts(_bucketed(spark, d), "reason")


_PIVOT = ", ".join(f"count_if(bucket = '{b}') AS \"{b}\"" for b in BUCKETS)


@query(f"SELECT coalesce(language, 'total') AS language, {_PIVOT}, count(*) AS total FROM bucketed GROUP BY GROUPING SETS ((language), ())", SEEDS)
def star_bucket_pivot(spark, d):
    return reports.pivot_totals(_bucketed(spark, d), "language", "bucket", BUCKETS)


@query("SELECT CASE WHEN stars IS NULL THEN '0' WHEN stars >= 10 THEN '>=10' WHEN stars >= 5 THEN '5-9' WHEN stars >= 1 THEN '1-4' WHEN stars = 0 THEN '0' ELSE '<0' END AS band, count(*) AS n FROM seeds GROUP BY 1", SEEDS)
def star_bands(spark, d):
    return V.seeds(spark, d).groupBy(C.star_band("stars").alias("band")).agg(F.count("*").alias("n"))


@query("SELECT " + ", ".join(f"round(quantile_cont(stars, {q}), 6) AS p{round(100 * q)}" for q in (0.25, 0.5, 0.75, 0.9, 0.99)) + ", max(stars) AS max FROM seeds", SEEDS)
def stars_quantiles(spark, d):
    return reports.quantiles(V.seeds(spark, d), "stars")


@query("SELECT count(stars) AS n, round(median(stars), 6) AS median, round(avg(stars), 6) AS mean, max(stars) AS max, round(100.0 * count_if(stars = 0) / count(stars), 6) AS zero_pct FROM seeds", SEEDS)
def stars_summary(spark, d):
    return reports.summary(V.seeds(spark, d), "stars")


_QUOTA = """strata AS (SELECT language, bucket, concat(language, ' | ', bucket) AS stratum, count(*) AS n FROM eligible GROUP BY language, bucket),
  shares AS (SELECT *, sum(n) OVER () AS total FROM strata), aims AS (SELECT *, least(120, total) AS aim FROM shares),
  parts AS (SELECT *, CAST(n * aim // total AS BIGINT) AS fl, n * aim % total AS rest FROM aims),
  quotas AS (SELECT language, bucket, stratum, n, fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, n DESC, stratum) <= aim - sum(fl) OVER () THEN 1 ELSE 0 END AS allocated FROM parts)"""


@query("SELECT stratum, n, allocated FROM quotas", f"{SEEDS}, {_QUOTA}")
def proportional_allocation(spark, d):
    counts = _eligible(spark, d).groupBy(F.concat_ws(" | ", "language", "bucket").alias("stratum")).agg(F.count("*").alias("n"))
    return sampling.proportional_allocation(counts, 120)


_DRAWN = "drawn AS (SELECT e.*, row_number() OVER (PARTITION BY e.language, e.bucket ORDER BY md5(concat(CAST(key AS VARCHAR), '|42')), key) <= allocated AS in_sample FROM eligible e JOIN quotas q ON q.language = e.language AND q.bucket = e.bucket)"


@query("SELECT key, language, bucket, in_sample FROM drawn", f"{SEEDS}, {_QUOTA}, {_DRAWN}")
def stratified_sample(spark, d):
    return sampling.stratified(_eligible(spark, d), ["language", "bucket"], "key", 120).select("key", "language", "bucket", "in_sample")


def _backups(spark, d):
    drawn = sampling.stratified(_eligible(spark, d), ["language", "bucket"], "key", 120)
    return drawn, sampling.backup_rank(drawn.where("not in_sample"), ["language", "bucket"], "stars", "key")


_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY language, bucket ORDER BY stars DESC NULLS LAST, key) AS backup_rank FROM drawn WHERE NOT in_sample)"


@query("SELECT key, language, bucket, backup_rank FROM ranked", f"{SEEDS}, {_QUOTA}, {_DRAWN}, {_RANKED}")
def backup_rank(spark, d):
    return _backups(spark, d)[1].select("key", "language", "bucket", "backup_rank")


@query(
    "SELECT p.key, p.language, p.bucket, p.backup_rank, r.key AS backup FROM (SELECT *, row_number() OVER (PARTITION BY language, bucket ORDER BY key) AS backup_rank FROM drawn WHERE in_sample AND status = 'F') p LEFT JOIN ranked r ON r.language = p.language AND r.bucket = p.bucket AND r.backup_rank = p.backup_rank",
    f"{SEEDS}, {_QUOTA}, {_DRAWN}, {_RANKED}",
)
def backup_allocation_exact(spark, d):
    drawn, backups = _backups(spark, d)
    needy = drawn.where("in_sample and status = 'F'").select("key", "language", "bucket")
    return sampling.exact_backups(needy, backups, ["language", "bucket"], "key")


@query()
def backup_allocation_greedy(spark, d):
    drawn, backups = _backups(spark, d)
    needy = drawn.where("in_sample and status = 'F'").select("key", "language", "bucket")
    return sampling.greedy_backups(needy, backups.withColumn("usable", F.col("status") != "F"))


FLOORS = {"desc_only": 20, "schema_add_only": 12, "desc_and_schema_add": 10, "schema_remove_only": 8, "desc_and_schema_remove": 6, "schema_mixed": 6, "type_change": 5}


@query(
    "SELECT to_seq, structural_type, concat('E', lpad(CAST(row_number() OVER (ORDER BY md5(concat(CAST(to_seq AS VARCHAR), '|44')), to_seq) AS VARCHAR), 3, '0')) AS event_id FROM (SELECT to_seq, structural_type FROM firsts WHERE first UNION ALL SELECT to_seq, structural_type FROM more)",
    VERSIONS
    + ", firsts AS (SELECT to_seq, structural_type, row_number() OVER (PARTITION BY structural_type ORDER BY md5(concat(CAST(to_seq AS VARCHAR), '|42')), to_seq) <= CASE structural_type "
    + " ".join(f"WHEN '{k}' THEN {n}" for k, n in FLOORS.items())
    + " END AS first FROM diffs WHERE valid), more AS (SELECT to_seq, structural_type FROM firsts WHERE NOT first ORDER BY md5(concat(CAST(to_seq AS VARCHAR), '|43')), to_seq LIMIT 8)",
)
def floor_quota_sample(spark, d):
    e = _changes(spark, d).where("valid").select("to_seq", "structural_type")
    return sampling.floor_quota(e, "structural_type", ["to_seq"], FLOORS, 75)


@query("SELECT key, language FROM eligible QUALIFY row_number() OVER (PARTITION BY language ORDER BY md5(concat(CAST(key AS VARCHAR), '|42')), key) <= 3", SEEDS)
def pilot_batch(spark, d):
    return sampling.fixed_per_group(_eligible(spark, d), "language", "key", 3).select("key", "language")


@query(
    "SELECT lang, planned, achieved, achieved - planned AS delta, round(100.0 * achieved / planned, 6) AS pct_achieved FROM (SELECT stratum AS lang, allocated AS planned, coalesce(a, 0) AS achieved FROM quotas LEFT JOIN (SELECT concat(language, ' | ', bucket) AS s, count(*) AS a FROM drawn WHERE in_sample AND status <> 'F' GROUP BY 1) ON s = stratum WHERE allocated > 0)",
    f"{SEEDS}, {_QUOTA}, {_DRAWN}",
)
def planned_vs_achieved(spark, d):
    e = _eligible(spark, d).withColumn("lang", F.concat_ws(" | ", "language", "bucket"))
    planned = sampling.proportional_allocation(e.groupBy("lang").agg(F.count("*").alias("n")), 120, "lang").where("allocated > 0").select("lang", F.col("allocated").alias("planned"))
    drawn = sampling.stratified(_eligible(spark, d), ["language", "bucket"], "key", 120).where("in_sample and status <> 'F'")
    got = drawn.groupBy(F.concat_ws(" | ", "language", "bucket").alias("lang")).agg(F.count("*").alias("achieved"))
    out = planned.join(got, "lang", "left").na.fill(0, ["achieved"])
    return out.select("lang", "planned", "achieved", (F.col("achieved") - F.col("planned")).alias("delta"), reports.rate(F.col("achieved"), F.col("planned")).alias("pct_achieved"))


@query(
    """SELECT q.language, q.bucket, planned, ok + same AS achieved, ok + same - planned AS delta, round(100.0 * (ok + same) / planned, 6) AS pct_achieved, ok AS primary_ok, same AS backup_same, CAST(0 AS BIGINT) AS backup_cross, planned - ok - same AS unfilled
    FROM (SELECT q.language, q.bucket, q.allocated AS planned, count_if(d.status <> 'F') AS ok, count_if(d.status = 'F' AND coalesce(r.status <> 'F', false)) AS same FROM quotas q JOIN (SELECT *, CASE WHEN status = 'F' THEN row_number() OVER (PARTITION BY language, bucket, status ORDER BY key) END AS k
    FROM drawn WHERE in_sample) d ON d.language = q.language AND d.bucket = q.bucket LEFT JOIN ranked r ON r.language = d.language AND r.bucket = d.bucket AND r.backup_rank = d.k WHERE q.allocated > 0 GROUP BY ALL) q""",
    f"{SEEDS}, {_QUOTA}, {_DRAWN}, {_RANKED}",
)
def fill_sources(spark, d):
    """What came of the sample: rows that can be used themselves, and the stratum's backups for those that can't."""
    e, strata = _eligible(spark, d), ["language", "bucket"]
    planned = sampling.proportional_allocation(e.groupBy(*strata).agg(F.count("*").alias("n")).withColumn("stratum", F.concat_ws(" | ", *strata)), 120)
    drawn, backups = _backups(spark, d)
    got = sampling.exact_backups(drawn.where("in_sample and status = 'F'").select("key", *strata), backups.withColumn("usable", F.col("status") != "F"), strata, "key")
    got = got.withColumn("fill", F.when(F.col("usable"), "same").otherwise("unfilled"))
    own = drawn.where("in_sample").withColumn("ok", F.col("status") != "F")
    return sampling.filled(planned.where("allocated > 0").select(*strata, F.col("allocated").alias("planned")), own, got, strata)


@query(
    "SELECT language, kind, n FROM (SELECT language, count(*) AS planned, count_if(reason = 'eligible') AS achieved FROM bucketed GROUP BY language) UNPIVOT (n FOR kind IN (planned, achieved))",
    SEEDS,
)
def melt_planned_achieved(spark, d):
    wide = _bucketed(spark, d).groupBy("language").agg(F.count("*").alias("planned"), F.count_if(F.col("reason") == "eligible").alias("achieved"))
    return wide.unpivot(["language"], ["planned", "achieved"], "kind", "n")


@query(
    "SELECT ord, stage, n, round(100.0 * n / first_value(n) OVER (ORDER BY ord), 6) AS pct FROM (SELECT 1 AS ord, 'all' AS stage, count(*) AS n FROM bucketed UNION ALL SELECT 2, 'starred', count_if(stars >= 10) FROM bucketed UNION ALL SELECT 3, 'eligible', count_if(reason = 'eligible') FROM bucketed)",
    SEEDS,
)
def funnel_pct(spark, d):
    one = _bucketed(spark, d).agg(F.count("*").alias("a"), F.count_if(F.col("stars") >= 10).alias("s"), F.count_if(F.col("reason") == "eligible").alias("e"))
    stages = [F.struct(F.lit(k).alias("ord"), F.lit(n).alias("stage"), F.col(c).alias("n")) for k, n, c in ((1, "all", "a"), (2, "starred", "s"), (3, "eligible", "e"))]
    return reports.funnel(one.select(F.inline(F.array(*stages))))


@query(
    "SELECT language, round(a, 6) AS pct_a, round(b, 6) AS pct_b, round(a - b, 6) AS delta FROM (SELECT coalesce(x.language, y.language) AS language, coalesce(x.s, 0.0) AS a, coalesce(y.s, 0.0) AS b FROM (SELECT language, count(*) * 100.0 / sum(count(*)) OVER () AS s FROM bucketed GROUP BY language) x FULL JOIN (SELECT language, count(*) * 100.0 / sum(count(*)) OVER () AS s FROM eligible GROUP BY language) y ON x.language = y.language)",
    SEEDS,
)
def representativeness_delta(spark, d):
    return reports.share_delta(_bucketed(spark, d), _eligible(spark, d), "language")


@query(
    "SELECT CASE WHEN r <= 2 THEN value ELSE 'other' END AS value, sum(n)::BIGINT AS n, round(100.0 * sum(n) / sum(sum(n)) OVER (), 6) AS pct FROM (SELECT event_type AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY event_type) GROUP BY 1"
)
def value_counts_topn_other(spark, d):
    return reports.value_counts(table(spark, d, "events"), "event_type", 2)


@query(
    "SELECT language, bucket, sum(stars)::BIGINT AS stars, count(*) AS n FROM bucketed GROUP BY language, bucket HAVING count(*) >= 2",
    SEEDS,
)
def group_sums(spark, d):
    return _bucketed(spark, d).groupBy("language", "bucket").agg(F.sum("stars").alias("stars"), F.count("*").alias("n")).where("n >= 2")


# --- Joins and logs -----------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def metadata_left_join(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return table(spark, d, "documents").select("doc_id", "lang").join(labels, "doc_id", "left").na.fill(-1, ["quality", "toxic"])


@query(
    "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000) THEN 0 ELSE 1 END AS priority, md5(concat(CAST(o_custkey AS VARCHAR), '|42')) AS ticket FROM orders"
)
def seed_queue(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return seeds.queued(orders, orders.where("o_totalprice > 490000"), ["o_custkey"]).select("o_orderkey", "priority", "ticket")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def resume_antijoin(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return seeds.remaining(table(spark, d, "customer"), done, ["c_custkey"]).select("c_custkey")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def latest_wins(spark, d):
    return seeds.last_per_key(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT p_partkey, coalesce(n, p_size) AS size FROM (SELECT p_partkey, p_size FROM part) LEFT JOIN (SELECT p_partkey AS k, p_size * 2 AS n FROM part WHERE p_size > 25) ON k = p_partkey")
def upsert_by_slot(spark, d):
    old = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("size"))
    return seeds.upserted(old, old.where("size > 25").select("p_partkey", (F.col("size") * 2).alias("size")), "p_partkey")


@query(
    "SELECT category, count(*) AS n, sum(w - o)::BIGINT AS delta FROM (SELECT o, w, CASE WHEN o > 0 AND w = 0 THEN 'to_zero' WHEN w > 0 AND w < o THEN 'fewer' WHEN o > 0 AND w > o THEN 'more' WHEN o = 0 AND w > 0 THEN 'from_zero' WHEN o = 0 AND w = 0 THEN 'stays_zero' ELSE 'unchanged' END AS category FROM (SELECT coalesce(a.n, 0) AS o, coalesce(b.n, 0) AS w FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.o_custkey = b.o_custkey)) GROUP BY category"
)
def rerun_delta_categories(spark, d):
    n = lambda s: table(spark, d, "orders").where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return reports.count_changes(n("F"), n("O"), "o_custkey")


@query(
    "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'status' END, CASE WHEN o_totalprice < 100000 THEN 'price' END) AS violations FROM orders WHERE o_orderstatus = 'P' OR o_totalprice < 100000"
)
def row_validation(spark, d):
    rules = {"status": F.col("o_orderstatus") != "P", "price": F.col("o_totalprice") >= 100000}
    out = seeds.validated(table(spark, d, "orders"), rules).where(F.size("violations") > 0)
    return out.select("o_orderkey", C.joined("violations", ",").alias("violations"))


@query(
    """SELECT doc_id, concat_ws(',', CASE WHEN source IS NULL OR doc_id % 11 = 0 THEN 'description' END, CASE WHEN lang = 'de' THEN 'schema' END, CASE WHEN n_chars < 100 THEN 'sha' END) AS violations
    FROM documents WHERE source IS NULL OR doc_id % 11 = 0 OR lang = 'de' OR n_chars < 100"""
)
def definition_validation(spark, d):
    """Definitions made of documents: some without a description, with an array for a schema, or with a blank sha."""
    lang, size, key = F.col("lang"), F.col("n_chars"), F.col("doc_id")
    made = table(spark, d, "documents").select(
        "doc_id", key.cast("string").alias("tool"), F.when(key % 11 != 0, F.col("source")).alias("description"), F.lit("a.py").alias("source_file"), F.lit("2024-01-01").alias("commit_date"),
        F.lit("r").alias("repo"), F.when(lang == "de", "[1]").otherwise('{"type": "object"}').alias("schema"), F.when(size < 100, " ").otherwise("abc").alias("sha"),
    )
    out = seeds.validated(made, seeds.definition_rules()).where(F.size("violations") > 0)
    return out.select("doc_id", C.joined("violations", ",").alias("violations"))


@query("SELECT to_seq, structural_type, added AS fields FROM diffs WHERE valid AND regexp_matches(lower(after), '^[12]-') AND structural_type IN ('schema_mixed', 'type_change')", VERSIONS)
def event_search(spark, d):
    e = _changes(spark, d).where("valid").where(C.matches("^[12]-", "after") & F.col("structural_type").isin("schema_mixed", "type_change"))
    return e.select("to_seq", "structural_type", C.joined("fields_added", ",").alias("fields"))


# --- Raters -------------------------------------------------------------------------------------------------


def _kappa_sql(a, b):
    return f"""SELECT '{a}{b}' AS pair, n, round(observed, 9) AS observed, round(expected, 9) AS expected, round((observed - expected) / nullif(1 - expected, 0), 9) AS kappa FROM
    (SELECT count(*) AS n, count_if({a} = {b}) / count(*) AS observed, (SELECT sum(CAST(x.c AS DOUBLE) * y.c) FROM (SELECT {a} AS l, count(*) AS c FROM raters GROUP BY 1) x JOIN (SELECT {b} AS l, count(*) AS c FROM raters GROUP BY 1) y ON x.l = y.l) / (count(*) * CAST(count(*) AS DOUBLE)) AS expected FROM raters)"""


@query(" UNION ALL ".join(_kappa_sql(*p) for p in ("hp", "hq", "pq")), RATERS)
def kappa_cohen(spark, d):
    r = V.raters(spark, d)
    one = lambda a, b: agreement.cohen_kappa(r, a, b).select(F.lit(a + b).alias("pair"), "n", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")])
    return one("h", "p").unionByName(one("h", "q")).unionByName(one("p", "q"))


@query(
    """SELECT n, round(observed, 9) AS observed, round(expected, 9) AS expected, round((observed - expected) / nullif(1 - expected, 0), 9) AS kappa FROM (SELECT count(*) AS n, avg((s1 * s1 + (3 - s1) * (3 - s1) - 3) / 6.0) AS observed,
    (sum(s1) * CAST(sum(s1) AS DOUBLE) + sum(3 - s1) * CAST(sum(3 - s1) AS DOUBLE)) / (9.0 * count(*) * count(*)) AS expected FROM (SELECT h + p + q AS s1 FROM raters))""",
    RATERS,
)
def kappa_fleiss(spark, d):
    return agreement.fleiss_kappa(V.raters(spark, d), ["h", "p", "q"], "doc_id").select("n", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")])


@query('SELECT h, count_if(p = 0) AS "0", count_if(p = 1) AS "1" FROM raters GROUP BY h', RATERS)
def confusion_matrix(spark, d):
    return agreement.confusion(V.raters(spark, d), "h", "p", [0, 1])


@query("SELECT CASE WHEN h = p AND p = q THEN 'all' WHEN h = p THEN 'first_second' WHEN h = q THEN 'first_third' WHEN p = q THEN 'second_third' ELSE 'none' END AS pattern, count(*) AS n FROM raters GROUP BY 1", RATERS)
def agreement_patterns(spark, d):
    return agreement.patterns(V.raters(spark, d), "h", "p", "q")


@query("SELECT p, q, count(*) AS n FROM raters WHERE p <> q GROUP BY p, q", RATERS)
def disagreement_transitions(spark, d):
    return agreement.transitions(V.raters(spark, d), "p", "q")


@query("SELECT l AS label, count_if(r = 'h') AS h, count_if(r = 'p') AS p, count_if(r = 'q') AS q FROM (SELECT h AS l, 'h' AS r FROM raters UNION ALL SELECT p, 'p' FROM raters UNION ALL SELECT q, 'q' FROM raters) GROUP BY l", RATERS)
def label_distribution(spark, d):
    return agreement.distribution(V.raters(spark, d), ["h", "p", "q"])


@query(
    "SELECT s.doc_id AS event_id, s.source, CASE WHEN quality = 1 THEN 'A' ELSE 'B' END AS human, m.pass1, m.pass2 FROM (SELECT doc_id, source FROM documents) s JOIN labels USING (doc_id) JOIN (SELECT source, arg_max(CASE WHEN n_chars % 2 = 0 THEN 'A' ELSE 'B' END, doc_id) AS pass1, arg_max(CASE WHEN n_chars % 3 = 0 THEN 'A' ELSE 'B' END, doc_id) AS pass2 FROM documents GROUP BY source) m ON m.source = s.source"
)
def rater_alignment(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    human = table(spark, d, "labels").select(F.col("doc_id").alias("event_id"), F.when(F.col("quality") == 1, " a ").otherwise("b").alias("human"))
    ab = lambda k: F.when(F.col("n_chars") % k == 0, "A").otherwise("B")
    machine = docs.select("source", F.col("doc_id").alias("seq"), ab(2).alias("pass1"), ab(3).alias("pass2"))
    return agreement.aligned(docs.select(F.col("doc_id").alias("event_id"), "source"), human, machine, ["source"], ["A", "B"])


@query(
    """SELECT user_id, event_type, sum(n)::BIGINT AS runs, max(v) AS variants, count(*) AS sides, count(DISTINCT s) AS signatures, max(v) = 1 AND count(*) = 2 AS finding_stable, max(v) = 1 AND count(*) = 2 AND count(DISTINCT s) = 2 AS differs
    FROM (SELECT user_id, event_type, event_id % 2 AS side, count(*) AS n, count(DISTINCT g) AS v, min(g) AS s FROM (SELECT *, json_extract_string(props, '$.k')::INT // 50 AS g FROM events) GROUP BY ALL) GROUP BY user_id, event_type"""
)
def stability_verdict(spark, d):
    runs = table(spark, d, "events").select("user_id", "event_type", (F.col("event_id") % 2).alias("side"), F.expr("cast(get_json_object(props, '$.k') as int) div 50").alias("g"))
    return reports.stability(runs, ["user_id", "event_type"], "side", "g")


@query(
    """SELECT event_id, CASE WHEN value > 0 THEN concat('k=', k) ELSE '__not_called__' END AS signature, CASE WHEN value > 5 AND k = '1' THEN 'No meaningful parameter difference — both agents called identically.'
    WHEN value > 5 THEN concat('k: BEFORE=', k, ' vs AFTER=1.') WHEN value > 2 THEN 'AFTER called the tool; BEFORE did not.' ELSE 'Neither agent called the tool.' END AS comparison
    FROM (SELECT event_id, value, json_extract_string(props, '$.k') AS k FROM events)"""
)
def call_signatures(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", D.call_signature(F.col("value") > 0, "props").alias("signature"), D.call_comparison(F.col("value") > 5, "props", F.col("value") > 2, F.lit('{"k": 1}')).alias("comparison"))


# --- Texts --------------------------------------------------------------------------------------------------


@query(
    "SELECT page_id, CASE WHEN u = '' THEN NULL ELSE u END AS url, CASE WHEN len(p) >= 2 THEN p[1] END AS owner, CASE WHEN len(p) >= 2 THEN p[2] END AS repo FROM (SELECT page_id, rtrim(trim(url), '/') AS u, string_split(trim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), '/') AS p FROM pages)"
)
def url_normalise(spark, d):
    owner, repo = C.owner_repo("url")
    return table(spark, d, "pages").select("page_id", C.canonical_url("url").alias("url"), owner.alias("owner"), repo.alias("repo"))


_SAID = [(-1, "I'm not sure which one"), (-2, "I cannot call it"), (-3, "Could you provide the id?"), (-4, "done"), (-5, "That is unclear; it should not run")]


@query(
    rf"SELECT id, regexp_matches(text, '(?i)\b({C.DOUBT.replace(chr(39), chr(39) * 2)})\b') AS doubt, regexp_matches(text, '(?i)\b({C.REFUSAL.replace(chr(39), chr(39) * 2)})\b') AS refusal FROM (SELECT conv_id * 1000 + turn AS id, text FROM conversations UNION ALL VALUES "
    + ", ".join("({}, '{}')".format(k, t.replace("'", "''")) for k, t in _SAID)
    + ")"
)
def hedging_flags(spark, d):
    said = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    both = said.unionByName(spark.createDataFrame(_SAID, "id long, text string"))
    return both.select("id", C.expresses_doubt("text").alias("doubt"), C.expresses_refusal("text").alias("refusal"))


@query(
    "SELECT doc_id, list_has_any(string_split(p, '/')[:-2], ["
    + ", ".join(f"'{x}'" for x in C.TEST_DIRECTORIES)
    + "]) OR regexp_matches(lower(string_split(p, '/')[-1]), '(\\.(test|spec)\\.(ts|tsx|js|mjs|py)|_test\\.go)$') AS test, list_has_any(string_split(p, '/'), ["
    + ", ".join(f"'{x}'" for x in C.SKIPPED_DIRECTORIES)
    + "]) AS skipped FROM (SELECT doc_id, concat(source, '/', CASE WHEN lang = 'en' AND n_chars < 1000 THEN 'tests/a.py' WHEN lang = 'en' THEN 'b_Test.go' WHEN lang = 'de' THEN 'node_modules/x/b.ts' WHEN lang = 'fr' THEN 'test.ts' WHEN n_chars < 1000 THEN concat('lib/', CAST(n_chars AS VARCHAR), '.spec.js') ELSE concat(CAST(n_chars AS VARCHAR), '.py') END) AS p FROM documents)"
)
def test_path_filter(spark, d):
    n, short, lang = F.col("n_chars").cast("string"), F.col("n_chars") < 1000, F.col("lang")
    name = F.when((lang == "en") & short, "tests/a.py").when(lang == "en", "b_Test.go").when(lang == "de", "node_modules/x/b.ts").when(lang == "fr", "test.ts")
    name = name.when(short, F.concat(F.lit("lib/"), n, F.lit(".spec.js"))).otherwise(F.concat(n, F.lit(".py")))
    out = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", name).alias("p"))
    return out.select("doc_id", C.is_test_path("p").alias("test"), C.is_skipped_path("p").alias("skipped"))


@query(
    "SELECT event_id, CASE CAST(json_extract_string(props, '$.k') AS INT) % 4 WHEN 0 THEN 'k:string' WHEN 1 THEN 'k:oneOf' WHEN 2 THEN 'k:object' ELSE '' END AS types FROM events"
)
def json_schema_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("int") % 4
    schema = F.when(k == 0, '{"type":"object","properties":{"k":{"type":"string"}}}').when(k == 1, '{"properties":{"k":{"oneOf":[]}}}').when(k == 2, '{"properties":{"k":{}}}')
    entries = F.transform(F.map_entries(C.property_types(schema)), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return table(spark, d, "events").select("event_id", F.array_join(entries, ",").alias("types"))


@query(
    """SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'COSMETIC' WHEN toxic = 1 THEN 'BEHAVIORAL_DRIFT' ELSE 'PARSE_ERROR' END AS label FROM labels JOIN (SELECT doc_id, source FROM documents) USING (doc_id)"""
)
def reply_labels(spark, d):
    """Replies written from labelled documents: fenced, padded, with a label that is none, or without JSON."""
    reply = F.when(F.col("toxic") == 1, F.to_json(F.struct(F.lit(" behavioral_drift ").alias("label"), F.col("source").alias("justification"))))
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.lit("cosmetic").alias("label"), F.col("source").alias("justification"))), F.lit("\n```"))
    other = F.when(F.col("n_chars") < 500, F.col("source")).otherwise(F.to_json(F.struct(F.col("source").alias("label"))))
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    text = F.when(reply.isNotNull(), reply).when(F.col("quality") == 1, fenced).otherwise(other)
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", C.reply_label(text).alias("label"))


@query("SELECT event_id, '{\"type\":\"object\",\"required\":[\"k\"]}' AS schema, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def schema_sanitise(spark, d):
    raw = F.concat(F.lit('{"anyOf":[],"required":["k"],"type":"object","x":'), "props", F.lit("}"))
    loose = F.concat(F.lit("{k: "), F.get_json_object("props", "$.k"), F.lit(", b: 'c',}"))
    return table(spark, d, "events").select("event_id", C.sanitised_schema(raw).alias("schema"), F.try_variant_get(C.relaxed_json(loose), "$.k", "bigint").alias("k"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN concat(left(text, 80), '…') ELSE text END AS preview FROM documents")
def text_previews(spark, d):
    return table(spark, d, "documents").select("doc_id", C.preview("text").alias("preview"))


@query(
    """SELECT o_orderkey, strftime(t, '%Y-%m-%d') AS day, coalesce(t < TIMESTAMP '2000-08-01', true) AS stale FROM
    (SELECT o_orderkey, try_cast(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE concat(' ', strftime(o_orderdate, '%Y-%m-%d'), 'T00:00:00 ') END AS TIMESTAMP) AS t FROM orders)"""
)
def stale_before_cutoff(spark, d):
    """Dates given as text, of which those of open orders are none, against the day twelve months before a given one."""
    text = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00 ")))
    t = C.timestamp_or_null(text).cast("timestamp_ntz")
    old = F.coalesce(t < C.months_before("2001-08-01", 12), F.lit(True))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(t, "yyyy-MM-dd").alias("day"), old.alias("stale"))


@query(
    """SELECT o_orderkey, slot, coalesce(before, '{}') AS before, coalesce(after, '{}') AS after FROM (SELECT o_orderkey, o_custkey AS slot FROM orders) LEFT JOIN
    (SELECT s_suppkey AS s, concat('{"name":"', s_name, '"}') AS before, CASE WHEN s_acctbal > 0 THEN concat('{"nation":', CAST(s_nationkey AS VARCHAR), '}') END AS after FROM supplier) ON s = slot"""
)
def results_by_slot(spark, d):
    """Orders as results, suppliers as the candidates of their slots, some of which lack a definition after."""
    results = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("slot"))
    after = F.when(F.col("s_acctbal") > 0, F.to_json(F.struct(F.col("s_nationkey").alias("nation"))))
    candidates = table(spark, d, "supplier").select(F.col("s_suppkey").alias("slot"), F.to_json(F.struct(F.col("s_name").alias("name"))).alias("before"), after.alias("after"))
    return seeds.with_results(results, candidates, "slot", ["before", "after"])


@query(
    """SELECT o_orderkey, CASE WHEN n IS NULL THEN '[]' ELSE concat('[''', n, ''']') END AS required FROM orders LEFT JOIN
    (SELECT l_orderkey, string_agg(CAST(l AS VARCHAR), ''', ''' ORDER BY l) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber AS l FROM lineitem WHERE l_returnflag = 'R') GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""
)
def rendered_required(spark, d):
    """An order's schema, of which the returned lines are required."""
    names = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).cast("array<string>").alias("required"))
    schema = F.to_json(F.struct(F.lit("object").alias("type"), "required"))
    orders = table(spark, d, "orders").join(names, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return orders.select("o_orderkey", C.rendered_required(schema).alias("required"))


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'clone_failed' WHEN tools > 0 THEN NULL WHEN o = 'F' AND c_mktsegment <> 'BUILDING' AND c_mktsegment <> 'MACHINERY' THEN 'zero_tools_found' ELSE 'not_a_server' END AS reason,
    CASE WHEN c_acctbal < 0 OR tools > 0 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 'remote_hosted_server' WHEN c_mktsegment = 'MACHINERY' THEN 'curator_list' END AS note
    FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o, count_if(o_totalprice > 400000) AS tools FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey"""
)
def replacement_notes(spark, d):
    """Customers as repositories: a negative balance stands for a failed clone, large orders for tools."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("o"), F.count_if(F.col("o_totalprice") > 400000).alias("tools"))
    c = table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    segment = F.col("c_mktsegment")
    why = C.replacement(F.col("c_acctbal") >= 0, "tools", segment == "BUILDING", segment == "MACHINERY", F.col("o") == "F")
    return c.select("c_custkey", why.alias("w")).select("c_custkey", "w.reason", "w.note")


# --- Extraction ---------------------------------------------------------------------------------------------


#: Each part as a repository of one file, in a language by its type; cheap parts have no description.
_LANGUAGE = {"ECONOMY": ("Python", "src/s.py"), "SMALL": ("Go", "m.go"), "MEDIUM": ("TypeScript", "i.ts"), "LARGE": ("Rust", "l.rs"), "PROMO": (None, "p.json"), "STANDARD": ("JavaScript", "j.js")}


def _part_files(spark, d):
    """Sources made of the table's names: (repo, language, path, content)."""
    key, text, kind = F.concat(F.lit("part_"), F.col("p_partkey").cast("string")), F.col("p_name"), F.col("p_type")
    told = F.col("p_retailprice") >= 950
    shapes = {
        "ECONOMY": F.concat(F.lit("import x\n\n@mcp.tool()\ndef "), key, F.lit("(a: int):\n"), F.when(told, F.concat(F.lit('    """'), text, F.lit('"""\n'))).otherwise("    pass\n")),
        "SMALL": F.concat(F.lit('t := mcp.NewTool("'), key, F.lit('"'), F.when(told, F.concat(F.lit(', mcp.WithDescription("'), text, F.lit('")'))).otherwise(""), F.lit(")\n")),
        "MEDIUM": F.concat(F.lit('server.tool("'), key, F.lit('", "'), text, F.lit('", {}, h);\n')),
        "LARGE": F.concat(F.lit('let t = Tool::new("'), key, F.lit('").description("'), text, F.lit('");\n')),
        "PROMO": F.concat(F.lit('{"name": "'), key, F.lit('", "description": "'), text, F.lit('", "inputSchema": {"type": "object"}}\n')),
        "STANDARD": F.concat(F.lit('s.registerTool("'), key, F.lit('", { description: "'), text, F.lit('" }, h);\n')),
    }
    pick = lambda of: F.coalesce(*[F.when(kind == k, v) for k, v in of.items()])
    parts = table(spark, d, "part").where(kind.isin(*shapes))
    return parts.select(
        key.alias("repo"), pick({k: F.lit(v[0]) for k, v in _LANGUAGE.items()}).alias("language"), pick({k: F.lit(v[1]) for k, v in _LANGUAGE.items()}).alias("path"), pick(shapes).alias("content")
    )


@query(
    """SELECT concat('part_', CAST(p_partkey AS VARCHAR)) AS repo, CASE p_type WHEN 'ECONOMY' THEN 'src/s.py' WHEN 'SMALL' THEN 'm.go' WHEN 'MEDIUM' THEN 'i.ts' WHEN 'LARGE' THEN 'l.rs' WHEN 'PROMO' THEN 'p.json' ELSE 'j.js' END AS path,
    concat('part_', CAST(p_partkey AS VARCHAR)) AS tool, CASE WHEN p_type = 'SMALL' AND p_retailprice < 950 THEN '' ELSE p_name END AS description,
    CASE p_type WHEN 'ECONOMY' THEN 'python-ast-decorator' WHEN 'SMALL' THEN 'go-regex-newtool' WHEN 'MEDIUM' THEN 'ts-regex-server-tool' WHEN 'LARGE' THEN 'rust-tool-builder' WHEN 'PROMO' THEN 'generic-inputSchema-search' ELSE 'ts-registertool' END AS extractor
    FROM part WHERE p_type IN ('SMALL', 'MEDIUM', 'LARGE', 'PROMO', 'STANDARD') OR (p_type = 'ECONOMY' AND p_retailprice >= 950)"""
)
def extract_tools(spark, d):
    """Definitions of sources that are made of all parts: in five languages and in none, some without what a definition needs."""
    return extraction.located(_part_files(spark, d)).select("repo", "path", "tool", "description", "extractor")


@query(
    """SELECT concat('s/', CAST(s_suppkey AS VARCHAR)) AS repo, s_nationkey < 5 AS server_signals, s_nationkey >= 5 AND s_nationkey < 10 AND s_acctbal > 0 AS hosted, s_nationkey >= 10 AND s_nationkey < 15 AS curated FROM supplier"""
)
def repository_signals(spark, d):
    """Suppliers as repositories: code of a server, a hosted server's document (complete with a positive balance), a curated list, or neither."""
    n, name, good = F.col("s_nationkey"), F.col("s_name"), F.col("s_acctbal") > 0
    hosted = F.concat(F.lit('{"$schema": "https://static.modelcontextprotocol.io/schemas/server.json", "name": "'), name, F.when(good, '", "remotes": []}').otherwise('"}'))
    path = F.when(n < 5, "src/server.py").when(n < 10, "server.json").when(n < 15, "README.md").otherwise("src/client.py")
    text = F.when(n < 5, F.concat(F.lit("from fastmcp import FastMCP\n# "), name)).when(n < 10, hosted).when(n < 15, F.concat(F.lit("# Awesome "), name, F.lit("\n\nA list of things\n"))).otherwise(F.concat(F.lit("# "), name))
    files = table(spark, d, "supplier").select(F.concat(F.lit("s/"), F.col("s_suppkey").cast("string")).alias("repo"), F.lit("Python").alias("language"), path.alias("path"), text.alias("content"))
    return extraction.repository_signals(files)


@query(
    """SELECT o_custkey AS repo, lower(concat('set_', o_orderstatus)) AS tool, o_orderkey AS seq, o_orderpriority AS description FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"""
)
def history_walk(spark, d):
    """Orders as versions of a customer's file to snapshots; those without lines have no content."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    source = F.concat(F.lit("@mcp.tool()\ndef set_"), F.lower("o_orderstatus"), F.lit('(a: int):\n    """'), F.col("o_orderpriority"), F.lit('"""\n'))
    versions = table(spark, d, "orders").join(lines, F.col("k") == F.col("o_orderkey"), "left").select(
        F.col("o_custkey").cast("string").alias("repo"), F.lit("s.py").alias("path"), F.lit("x").alias("sha"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("commit_date"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("k").isNotNull(), source).alias("content"),
    )
    return extraction.snapshots(versions).select(F.col("repo").cast("long").alias("repo"), "tool", "seq", "description")


from . import repository_queries  # noqa: E402, F401  registers its own
