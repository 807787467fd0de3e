"""Queries over whole repositories: lineages of files, the order of commits, trees, statistics of a walk, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import commits, history, metrics
from . import views as V
from .queries import query
from .views import VERSIONS, table


def order_changes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as files of nations: each is added in the commit of its year and removed in the next one's; its lines are its chunks."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    chunk = F.concat(F.col("l_linenumber").cast("string"), "f")
    content = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    files = (
        table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(content, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(F.col("c_nationkey").alias("repo"), F.col("o_orderkey").cast("string").alias("path"), F.year("o_orderdate").cast("long").alias("year"), F.array_join("chunks", ",").alias("blob"), "chunks")
    )
    both = F.explode(F.array(F.struct(F.col("year").alias("commit"), F.lit("A").alias("status")), F.struct((F.col("year") + 1).alias("commit"), F.lit("D").alias("status"))))
    return files.select("repo", "path", "blob", "chunks", both.alias("at")).select("repo", "at.commit", "path", "at.status", "blob", "chunks")


_CHANGES = """lines AS (SELECT l_orderkey AS k, CAST(l_linenumber AS VARCHAR) AS p, min(l_returnflag) AS f FROM lineitem GROUP BY l_orderkey, l_linenumber),
content AS (SELECT k, list(concat(p, f) ORDER BY concat(p, f)) AS chunks, string_agg(concat(p, f), ',' ORDER BY concat(p, f)) AS blob FROM lines GROUP BY k),
files AS (SELECT c_nationkey AS repo, CAST(o_orderkey AS VARCHAR) AS path, CAST(year(o_orderdate) AS BIGINT) AS y, chunks, blob FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN content ON k = o_orderkey),
come AS (SELECT repo, y AS cm, path, blob, chunks, row_number() OVER (PARTITION BY repo, y, blob ORDER BY path) AS n FROM files),
gone AS (SELECT repo, cm + 1 AS cm, path, blob, chunks, n FROM come),
same AS (SELECT g.repo, g.cm, g.path AS old_path, c.path AS new_path FROM gone g JOIN come c ON c.repo = g.repo AND c.cm = g.cm AND c.blob = g.blob AND c.n = g.n),
alike AS (SELECT * FROM (SELECT g.repo, g.cm, g.path AS old_path, c.path AS new_path, CAST(len(list_intersect(g.chunks, c.chunks)) AS DOUBLE) / greatest(len(g.chunks), len(c.chunks)) AS s
  FROM gone g JOIN come c ON c.repo = g.repo AND c.cm = g.cm ANTI JOIN same x ON x.repo = g.repo AND x.cm = g.cm AND x.old_path = g.path ANTI JOIN same z ON z.repo = c.repo AND z.cm = c.cm AND z.new_path = c.path) WHERE s >= 0.5),
moves AS (SELECT repo, cm, old_path, new_path, 1.0 AS s FROM same UNION ALL SELECT repo, cm, old_path, new_path, s FROM (SELECT *, row_number() OVER (PARTITION BY repo, cm, old_path ORDER BY s DESC, new_path) AS a,
  row_number() OVER (PARTITION BY repo, cm, new_path ORDER BY s DESC, old_path) AS b FROM alike) WHERE a = 1 AND b = 1)"""


@query("SELECT repo, cm AS commit_year, old_path, new_path, round(s, 6) AS similarity FROM moves", _CHANGES)
def file_renames(spark, d):
    out = commits.renames(order_changes(spark, d))
    return out.select("repo", F.col("commit").alias("commit_year"), "old_path", "new_path", F.round("similarity", 6).alias("similarity"))


@query(
    "SELECT repo, path, cm AS commit_year, lineage, renames FROM chain",
    "RECURSIVE " + _CHANGES
    + """, chain(repo, path, cm, lineage, renames) AS (SELECT repo, path, y, concat(path, '@', y), CAST(0 AS BIGINT) FROM files f WHERE NOT EXISTS (SELECT 1 FROM moves m WHERE m.repo = f.repo AND m.new_path = f.path)
    UNION ALL SELECT m.repo, m.new_path, m.cm, c.lineage, c.renames + 1 FROM chain c JOIN moves m ON m.repo = c.repo AND m.old_path = c.path)""",
)
def file_lineage(spark, d):
    """One id for each chain of renames."""
    changes = order_changes(spark, d)
    out = commits.lineages(changes, commits.renames(changes))
    return out.select("repo", "path", F.col("commit").alias("commit_year"), "lineage", "renames")


def _commits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as a customer's commits. Each follows the last one of its status, a branch, or else the last one before it; urgent ones merge that too."""
    o = table(spark, d, "orders")
    by = lambda *c: F.lag("o_orderkey").over(Window.partitionBy(*c).orderBy("o_orderkey"))
    rows = o.select(
        F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("sha"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("time"),
        by("o_custkey", "o_orderstatus").alias("branch"), by("o_custkey").alias("last"), (F.col("o_orderpriority") == "1-URGENT").alias("merges"),
    )
    parents = F.array_compact(F.array(F.coalesce("branch", "last"), F.when(F.col("merges"), F.col("last"))))
    return rows.select("repo", "sha", "time"), rows.select("repo", "sha", F.explode(parents).alias("parent"))


@query(
    "SELECT repo, sha, time, corrected, row_number() OVER (PARTITION BY repo ORDER BY corrected, time, sha) AS position FROM base JOIN (SELECT repo AS r, sha AS s, max(t) AS corrected FROM reach GROUP BY repo, sha) ON r = repo AND s = sha",
    """RECURSIVE base AS (SELECT o_custkey AS repo, o_orderkey AS sha, CAST(epoch(o_orderdate) AS BIGINT) AS time, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS branch,
      lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS last, o_orderpriority = '1-URGENT' AS merges FROM orders),
    parents AS (SELECT repo, sha, coalesce(branch, last) AS parent FROM base WHERE last IS NOT NULL UNION SELECT repo, sha, last FROM base WHERE merges AND last IS NOT NULL),
    reach(repo, sha, t) AS (SELECT repo, sha, time FROM base UNION SELECT p.repo, p.sha, r.t + 1 FROM reach r JOIN parents p ON p.repo = r.repo AND p.parent = r.sha)""",
)
def commit_order(spark, d):
    """A DAG of orders whose keys and dates disagree, oldest first and parents before children."""
    return commits.commit_order(*_commits(spark, d))


@query(
    """SELECT repo, sha, path, seq FROM (SELECT c.repo, c.sha, v.path, v.seq, v.deleted FROM vers c JOIN vers v ON v.repo = c.repo AND v.time <= c.time
    QUALIFY row_number() OVER (PARTITION BY c.sha, v.path ORDER BY v.time DESC, v.seq DESC) = 1) WHERE NOT deleted""",
    """vers AS (SELECT o_custkey AS repo, o_orderkey AS sha, o_orderpriority AS path, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS time, o_orderkey AS seq, k IS NULL AS deleted
    FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) ON k = o_orderkey)""",
)
def tree_at_commit(spark, d):
    """Priorities as a customer's files, of which each order is a version, one without lines a removal: the tree at every order's day."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    rows = table(spark, d, "orders").join(lines, F.col("k") == F.col("o_orderkey"), "left").select(
        F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("sha"), F.col("o_orderpriority").alias("path"), F.unix_date(F.to_date("o_orderdate")).cast("long").alias("time"),
        F.col("o_orderkey").alias("seq"), F.col("k").isNull().alias("deleted"),
    )
    return commits.trees_at(rows.drop("sha"), rows.select("repo", "sha", "time")).select("repo", "sha", "path", "seq")


@query(
    """SELECT (SELECT count(*) FROM versions) AS versions_read, (SELECT count(*) FROM versions WHERE NOT EXISTS (SELECT 1 FROM lines WHERE k = seq)) AS without_properties, count(*) AS records, count_if(first) AS entities,
    count_if(moved) AS renames_found, count_if(valid) AS changes, strftime(min(commit_date)::TIMESTAMP, '%Y-%m-%d') AS first_day, strftime(max(commit_date)::TIMESTAMP, '%Y-%m-%d') AS last_day
    FROM (SELECT v.commit_date, d.to_seq IS NULL AS first, coalesce(d.source_file_changed, false) AS moved, coalesce(d.valid, false) AS valid FROM versions v LEFT JOIN diffs d ON d.to_seq = v.seq)""",
    VERSIONS,
)
def walk_statistics(spark, d):
    """What a walk has read and made, from the one pass that made it."""
    seen = metrics.Gauge("read", versions_read=F.count("*"), without_properties=F.count_if(F.col("props").isNull()))
    rows = history.diffs(seen.on(V.versions(spark, d)), firsts=True)
    first = F.col("from_seq").isNull()
    _, out = metrics.measured(rows, {
        "records": F.count("*"), "entities": F.count_if(first), "renames_found": F.count_if(F.col("source_file_changed") & ~first), "changes": F.count_if("valid"),
        "first_day": F.substring(F.min("to_date"), 1, 10), "last_day": F.substring(F.max("to_date"), 1, 10),
    })
    both = seen.read() | out
    return spark.createDataFrame([both], ", ".join(f"{k} {'string' if k.endswith('_day') else 'bigint'}" for k in both))
