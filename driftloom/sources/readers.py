"""Readers. All paths go through Spark, so any store that it can open will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import BY_SUFFIX

#: Repository metadata, as its service returns it.
METADATA = (
    "repo_url string, status string, pushed_at string, gh_stars long, archived boolean, fork boolean, size_kb long, default_branch string, "
    "visibility string, open_issues long, created_at string, gh_language string"
)
SNAPSHOTS = (
    "repo_url string, language string, star_bucket string, tool_name string, commit_sha string, commit_date string, description string, "
    "input_schema string, source_file string, extractor string"
)
CLASSIFICATIONS = (
    "repo_url string, tool_name string, from_sha string, to_sha string, from_date string, to_date string, description_changed boolean, description_diff string, "
    "schema_fields_added array<string>, schema_fields_removed array<string>, schema_type_changes array<struct<field:string,from_type:string,to_type:string>>, "
    "is_inplace_mutation boolean, source_file_changed boolean, status string, pass1_label string, pass1_justification string, pass2_label string, "
    "pass2_justification string, agreement boolean"
)


def csv(spark: SparkSession, path: str, schema: str | None = None, delimiter: str = ",", infer: bool = False) -> DataFrame:
    """With a header; without a schema all columns are strings, or with ``infer`` of the types that all their cells have, which reads
    the file twice. Blank cells are null; quotes are doubled inside quotes."""
    r = spark.read.option("header", True).option("nullValue", "").option("sep", delimiter).option("multiLine", True).option("escape", '"')
    return r.schema(schema).csv(path) if schema else r.csv(path, inferSchema=infer)


def jsonl(spark: SparkSession, path: str, schema: str | None = None, tolerant: bool = False) -> DataFrame:
    """One document a line; blank lines are passed over, and broken ones if ``tolerant``, else they are an error."""
    r = spark.read.option("mode", "DROPMALFORMED" if tolerant else "FAILFAST")
    return (r.schema(schema) if schema else r).json(path)


def checkpoint(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """A log of records, of which the last of each key counts; broken lines are passed over.

    A line's place is its file's time of writing, then the file's name and its place in it: what is appended later counts.
    """
    from ..operators.seeds import last_per_key

    at = [F.col(f"_metadata.{c}") for c in ("file_modification_time", "file_name", "file_block_start")]
    rows = jsonl(spark, path, schema, tolerant=True)
    rows = rows.select("*", F.struct(*at, F.monotonically_increasing_id().alias("i")).alias("__seq"))
    return last_per_key(rows, keys, "__seq").drop("__seq")


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A document that is an array of records."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def optional(spark: SparkSession, path: str, reader, required: list[str] = ()) -> DataFrame | None:
    """What ``reader(spark, path)`` reads, or None without the file; an error without one of the required columns."""
    if not exists(spark, path):
        return None
    df = reader(spark, path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df


def source_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = tuple(BY_SUFFIX)) -> DataFrame:
    """(repo, path, content binary) of the files under root/<repo>/ with one of the suffixes."""
    names = "*{" + ",".join(suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    base = F.regexp_replace(F.lit(root), r"^[a-z]+:/*|/+$", "")
    rest = F.expr("substring_index(path, '/', -1)")
    full = F.regexp_replace("path", r"^[a-z]+:/*", "")
    rel = F.substring(full, F.length(F.regexp_replace(base, "^/+", "")) + 2, F.length(full))
    parts = F.split(rel, "/")
    return files.select(parts[0].alias("repo"), F.array_join(F.slice(parts, 2, F.size(parts)), "/").alias("path"), "content", rest.alias("name"))


def source_files(spark: SparkSession, root: str, repos: DataFrame, suffixes: tuple[str, ...] = tuple(BY_SUFFIX)) -> DataFrame:
    """(repo, language, path, content binary) of the files under root/<repo>/ that count: in no skipped directory, and no tests.

    ``repos``: repo and language, one row each; a repository that it lacks has no language. What ``extraction.located`` takes.
    """
    from ..operators.extraction import readable

    files = readable(source_tree(spark, root, suffixes)).select("repo", "path", "content")
    return files.join(repos.select("repo", "language"), "repo", "left").select("repo", "language", "path", "content")


def markdown_intro(spark: SparkSession, path: str) -> DataFrame:
    """(intro): the text between a document's first heading and its first second-level heading."""
    text = spark.read.text(path, wholetext=True)
    body = F.substring_index(F.regexp_replace("value", r"\A\s*#[^\n]*\n", ""), "\n## ", 1)
    return text.select(F.trim(body).alias("intro"))


def commit_log(lines: DataFrame) -> DataFrame:
    """A log's lines (repo, seq, line), ``COMMIT:<sha> <date>`` each followed by its paths, as (repo, sha, date, path, seq)."""
    from pyspark.sql import Window

    w = Window.partitionBy("repo").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.regexp_extract("line", r"^COMMIT:(\S+)\s+(\S+)", 0)
    rows = lines.withColumn("head", F.last(F.when(head != "", F.col("line")), ignorenulls=True).over(w)).where((head == "") & (F.trim("line") != ""))
    first = Window.partitionBy("repo", "head").orderBy("seq")
    rows = rows.withColumn("__r", F.row_number().over(first)).where("__r = 1 and head is not null")
    return rows.select("repo", F.regexp_extract("head", r"^COMMIT:(\S+)", 1).alias("sha"), F.regexp_extract("head", r"^COMMIT:\S+\s+(\S+)", 1).alias("date"), F.trim("line").alias("path"), "seq")


def metadata_status(code) -> F.Column:
    """The status of a metadata request from its HTTP code; null: no answer."""
    c = F.col(code) if isinstance(code, str) else code
    return F.when(c.isNull(), "error").when(c == 200, "ok").when(c == 404, "not_found").when(c.isin(403, 429), "rate_limited").otherwise(F.concat(F.lit("http_"), c.cast("string")))
