"""The test tables seen as versions, seeds, raters and runs; for each view its SQL, as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of (customer, status): dates order them, lines are properties."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    props = lines.groupBy("l_orderkey").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("k"), F.col("f").alias("v"))))).alias("props")
    )
    date = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return (
        table(spark, sf_dir, "orders")
        .join(props, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_custkey").alias("repo"), F.col("o_orderstatus").alias("tool"), date.alias("commit_date"), F.col("o_orderkey").alias("seq"),
            F.date_format("o_orderdate", "MMyyyydd").alias("sha"), F.col("o_orderpriority").alias("description"), "props",
            F.concat(F.lit("f"), (F.col("o_orderkey") % 3).cast("string")).alias("source_file"),
        )
    )


VERSIONS = """
lines AS (SELECT l_orderkey AS k, CAST(l_linenumber AS VARCHAR) AS p, min(l_returnflag) AS f FROM lineitem GROUP BY l_orderkey, l_linenumber),
versions AS (SELECT o_custkey AS repo, o_orderstatus AS tool, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS commit_date, o_orderkey AS seq,
  strftime(o_orderdate, '%m%Y%d') AS sha, o_orderpriority AS description, concat('f', CAST(o_orderkey % 3 AS VARCHAR)) AS source_file FROM orders),
pairs AS (SELECT * FROM (SELECT *, lag(seq) OVER w AS from_seq, lag(sha) OVER w AS from_sha, lag(description) OVER w AS before, lag(source_file) OVER w AS from_file
  FROM versions WINDOW w AS (PARTITION BY repo, tool ORDER BY commit_date, seq)) WHERE from_seq IS NOT NULL),
plus AS (SELECT s.seq, string_agg(a.p, ',' ORDER BY a.p) AS x, count(*) AS n FROM pairs s JOIN lines a ON a.k = s.seq LEFT JOIN lines b ON b.k = s.from_seq AND b.p = a.p WHERE b.p IS NULL GROUP BY s.seq),
minus AS (SELECT s.seq, string_agg(b.p, ',' ORDER BY b.p) AS x, count(*) AS n FROM pairs s JOIN lines b ON b.k = s.from_seq LEFT JOIN lines a ON a.k = s.seq AND a.p = b.p WHERE a.p IS NULL GROUP BY s.seq),
moved AS (SELECT s.seq, string_agg(concat(a.p, ':', b.f, '>', a.f), ',' ORDER BY a.p) AS x, count(*) AS n FROM pairs s JOIN lines a ON a.k = s.seq JOIN lines b ON b.k = s.from_seq AND b.p = a.p WHERE a.f <> b.f GROUP BY s.seq),
events0 AS (SELECT s.repo, s.tool, s.from_seq, s.seq AS to_seq, s.from_sha, s.sha AS to_sha, s.before <> s.description AS description_changed, coalesce(plus.x, '') AS added, coalesce(minus.x, '') AS removed,
  coalesce(moved.x, '') AS types, coalesce(plus.n, 0) AS na, coalesce(minus.n, 0) AS nr, coalesce(moved.n, 0) AS nt, s.from_file <> s.source_file AS source_file_changed, s.from_file, s.source_file AS to_file,
  s.before, s.description AS after FROM pairs s LEFT JOIN plus ON plus.seq = s.seq LEFT JOIN minus ON minus.seq = s.seq LEFT JOIN moved ON moved.seq = s.seq),
diffs AS (SELECT *, description_changed OR na > 0 OR nr > 0 OR nt > 0 AS changed, (description_changed OR na > 0 OR nr > 0 OR nt > 0) AND from_sha <> to_sha AS valid,
  CASE WHEN nt > 0 THEN 'type_change' WHEN na > 0 AND nr > 0 THEN 'schema_mixed' WHEN na > 0 AND description_changed THEN 'desc_and_schema_add' WHEN nr > 0 AND description_changed THEN 'desc_and_schema_remove'
  WHEN na > 0 THEN 'schema_add_only' WHEN nr > 0 THEN 'schema_remove_only' WHEN description_changed THEN 'desc_only' END AS structural_type FROM events0),
drifting AS (SELECT *, structural_type IN ('type_change', 'desc_and_schema_remove') AS pass1, structural_type IN ('type_change', 'desc_and_schema_remove', 'schema_mixed') AND to_seq % 3 <> 0 AS pass2 FROM diffs WHERE valid)
"""


def labelled(events: DataFrame) -> DataFrame:
    """A stand-in for two passes of labels, by rule from the structural type: the labels themselves come as tables."""
    kind = F.col("structural_type")
    return events.withColumn("pass1", kind.isin("type_change", "desc_and_schema_remove")).withColumn(
        "pass2", kind.isin("type_change", "desc_and_schema_remove", "schema_mixed") & (F.col("to_seq") % 3 != 0)
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as seed repositories with stars, language, region, a date of their last order and a status flag."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("pushed"), F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    return (
        c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("language"), F.col("r_name").alias("category"), F.floor("c_acctbal").alias("stars"),
            (F.col("c_custkey") % 7 == 0).alias("archived"), "pushed", "status",
        )
    )


SEEDS = """
seeds AS (SELECT c_custkey AS key, c_mktsegment AS language, r_name AS category, CAST(floor(c_acctbal) AS BIGINT) AS stars, c_custkey % 7 = 0 AS archived, pushed, status FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS pushed, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey),
bucketed AS (SELECT *, CASE WHEN stars >= 1000 THEN '1000+' WHEN stars >= 200 THEN '200-999' WHEN stars >= 50 THEN '50-199' WHEN stars >= 10 THEN '10-49' ELSE 'nan' END AS bucket,
  coalesce(nullif(concat_ws('+', CASE WHEN stars IS NULL OR stars < 10 THEN 'low_stars' END, CASE WHEN archived THEN 'archived' END, CASE WHEN pushed IS NULL OR pushed < TIMESTAMP '1998-01-01' THEN 'stale' END), ''), 'eligible') AS reason FROM seeds),
eligible AS (SELECT * FROM bucketed WHERE reason = 'eligible')
"""


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as two raters, the document's length as a third."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("h"), F.col("toxic").alias("p"), (F.col("n_chars") > 500).cast("int").alias("q"))


RATERS = "raters AS (SELECT doc_id, quality AS h, toxic AS p, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS q FROM labels JOIN documents USING (doc_id))"
