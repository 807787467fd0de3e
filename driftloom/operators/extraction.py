"""Extraction over tables of files: rows (repo, language, path, content) to rows of definitions.

Files are parsed where they lie, one Python pass over Arrow batches; what has to look across a repository's files
(cross-file names, the first yielding file, first of a name) is a join or a window.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import extract as X
from .rounds import settled

_OUT = "repo string, path string, mode string, pos int, tool string, description string, input_schema string, extractor string"


def _suffix(c: str = "path"):
    return F.regexp_extract(F.element_at(F.split(c, "/"), -1), r".(\.[^.]+)$", 1)


def readable(files: DataFrame) -> DataFrame:
    """Files that count: in no skipped directory, and no tests. Paths are relative to the repository."""
    return files.where(~C.is_skipped_path("path") & ~C.is_test_path("path"))


def _parsed(batches):
    """Definitions of a file by its own language (``own``) and by the search in any language (``any``), the names it
    registers (``use``) and the docstrings it has (``doc``)."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            text = r["content"] if isinstance(r["content"], str) else X.decoded(r["content"])
            if not text:
                continue
            repo, path, suffix, lang = r["repo"], r["path"], r["suffix"], (r["language"] or "").lower()
            by_suffix = X.BY_SUFFIX[suffix](text) if suffix in X.BY_SUFFIX else []
            found = [("own", d) for d in by_suffix] if suffix in X.BY_LANGUAGE.get(lang, ()) else []
            if suffix in X.ANY_LANGUAGE:
                found += [("any", d) for d in X.extract_generic(text) + by_suffix]
            if suffix == ".py" and ".py" in X.BY_LANGUAGE.get(lang, ()):
                used, docs = X.python_links(text)
                found += [("use", X.Definition(n, "", {}, "")) for n in used]
                found += [("doc", X.Definition(n, t, {}, "python-ast-mcp-tool-call")) for n, t in docs.items()]
            rows += [(repo, path, mode, k, d.name, d.description, json.dumps(d.schema), d.extractor) for k, (mode, d) in enumerate(found)]
        names = ("repo", "path", "mode", "pos", "tool", "description", "input_schema", "extractor")
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "pos" else pa.string()) for n, c in zip(names, columns, strict=True)], names=list(names))


def located(files: DataFrame) -> DataFrame:
    """(repo, path, tool, description, input_schema, extractor): each repository's definitions, once a name.

    First what its language's files hold, notebooks after scripts; then names registered across files, with the
    first docstring in path order; and if that is nothing, all finds of the first file, in path order, in which
    the search in any language finds something.
    """
    some = readable(files).withColumn("suffix", _suffix()).where(F.col("suffix").isin(*sorted({*X.BY_SUFFIX, *X.ANY_LANGUAGE})))
    parsed = settled(some.select("repo", "language", "path", "suffix", "content").mapInArrow(_parsed, _OUT), "parsed")  # read four times below
    order = ["path", "pos"]
    own = parsed.where("mode = 'own'").withColumn("stage", F.when(F.col("path").endswith(".ipynb"), 1).otherwise(0))
    docs = parsed.where("mode = 'doc'").groupBy("repo", "tool").agg(F.min_by(F.struct("path", "description", "input_schema", "extractor"), F.struct(*order)).alias("d"))
    uses = parsed.where("mode = 'use'").groupBy("repo", "tool").agg(F.min(F.struct(*order)).alias("u"))
    linked = uses.join(docs, ["repo", "tool"]).select("repo", F.col("d.path").alias("path"), F.lit("own").alias("mode"), F.col("u.pos").alias("pos"), "tool", "d.description", "d.input_schema", "d.extractor", F.lit(2).alias("stage"))
    found = own.unionByName(linked)
    fall = parsed.where("mode = 'any'").join(found.select("repo").distinct(), "repo", "left_anti")
    fall = fall.join(fall.groupBy("repo").agg(F.min("path").alias("path")), ["repo", "path"], "left_semi").withColumn("stage", F.lit(3))
    once = Window.partitionBy("repo", "tool").orderBy("stage", *order)
    out = found.unionByName(fall).withColumn("__r", F.row_number().over(once)).where("__r = 1")
    return out.select("repo", "path", "tool", "description", "input_schema", "extractor")


def snapshots(versions: DataFrame) -> DataFrame:
    """One row for each definition of each file version (repo, path, sha, commit_date, seq, content): the first of a
    name in its file. Versions without content are passed over."""
    some = readable(versions.where("content is not null")).withColumn("suffix", _suffix()).where(F.col("suffix").isin(*X.WALKED))

    def parse(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                text = r["content"] if isinstance(r["content"], str) else X.decoded(r["content"])
                seen: dict[str, X.Definition] = {}
                for d in X.BY_SUFFIX[r["suffix"]](text):
                    seen.setdefault(d.name, d)
                rows += [(r["repo"], r["path"], r["sha"], r["commit_date"], r["seq"], d.name, d.description, json.dumps(d.schema), d.extractor) for d in seen.values()]
            names = ("repo", "source_file", "sha", "commit_date", "seq", "tool", "description", "input_schema", "extractor")
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "seq" else pa.string()) for n, c in zip(names, columns, strict=True)], names=list(names))

    out = some.select("repo", "path", "sha", "commit_date", F.col("seq").cast("long").alias("seq"), "content", "suffix")
    out = out.mapInArrow(parse, "repo string, source_file string, sha string, commit_date string, seq long, tool string, description string, input_schema string, extractor string")
    return out.withColumn("props", C.property_types("input_schema"))


# What code of a server holds, by language.
SIGNALS = {
    "python": (r"from\s+mcp\.server\b", r"from\s+fastmcp\b", r"FastMCP\s*\(", r"from\s+mcp\s+import\b.*\bServer\b", r"@mcp\.tool\b", r"@server\.tool\b", r"mcp\.server\.Server"),
    "typescript": (r"@modelcontextprotocol/sdk/server", r"new\s+McpServer\s*\(", r"new\s+Server\s*\(\s*\{", r"ListToolsRequestSchema", r"CallToolRequestSchema", r"server\.setRequestHandler", r"\.addTool\s*\("),
    "javascript": (r"@modelcontextprotocol/sdk/server", r"new\s+McpServer\s*\(", r"ListToolsRequestSchema", r"server\.setRequestHandler"),
    "go": (r'"github\.com/mark3labs/mcp-go', r"mcp\.NewServer\b", r"mcpserver\.", r"mcp\.NewMCPServer\b", r"mcp\.NewTool\b"),
    "rust": (r"\brmcp\b", r"#\[tool\b", r"#\[tool_router\]", r"\bServerHandler\b", r"\brmcp_macros\b"),
}
SIGNAL_SUFFIXES = {"python": (".py",), "typescript": (".ts", ".tsx"), "javascript": (".js", ".mjs", ".cjs"), "go": (".go",), "rust": (".rs",)}
# The files that describe a package.
MANIFESTS = ("package.json", "pyproject.toml", "Cargo.toml", "go.mod")


def repository_signals(files: DataFrame) -> DataFrame:
    """(repo, server_signals, hosted, curated boolean) of each repository, from text files (content string)."""
    lang, name = F.lower(F.coalesce("language", F.lit(""))), F.element_at(F.split("path", "/"), -1)
    suffix, text = _suffix(), F.col("content")
    counts = ~C.is_skipped_path("path") & ~C.is_test_path("path")
    either = F.lit(False)
    for k, patterns in SIGNALS.items():
        either = either | ((lang == k) & suffix.isin(*SIGNAL_SUFFIXES[k]) & text.rlike("(?i)" + "|".join(patterns)))
    anything = "(?i)" + "|".join(dict.fromkeys(p for ps in SIGNALS.values() for p in ps))
    either = either | (~lang.isin(*SIGNALS) & suffix.isin(".py", ".ts", ".js", ".go", ".rs") & text.rlike(anything))
    outside = ~F.array_contains(F.split("path", "/"), ".git")
    manifest = name.isin(*MANIFESTS) & outside & text.rlike("(?i)mcp|modelcontextprotocol") & text.rlike("(?i)server|tool")
    hosted = (name == "server.json") & outside & text.contains('"$schema"') & text.contains("modelcontextprotocol.io/schemas")
    parsed = F.try_parse_json(text)
    hosted = hosted & (F.try_variant_get(parsed, "$.remotes", "variant").isNotNull() | F.try_variant_get(parsed, "$.url", "variant").isNotNull())
    start = F.lower(F.left(text, F.lit(2048)))
    curated = (F.col("path") == "README.md") & ((start.contains("awesome") & start.contains("list")) | start.contains("curated list"))
    awesome = F.lower(F.element_at(F.split("repo", "/"), -1)).contains("awesome")
    any_of = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    return files.groupBy("repo").agg(any_of((counts & either) | manifest).alias("server_signals"), any_of(hosted).alias("hosted"), any_of(curated | awesome).alias("curated"))
