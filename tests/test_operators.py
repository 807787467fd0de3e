"""Operators on small frames: edge rows, identities and published goldens."""

import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from driftloom.functions import columns as C
from driftloom.functions import diffs as D
from driftloom.operators import agreement, extraction, history, reports, sampling, seeds
from driftloom.plans import queries as Q

from .source_files import EXPECTED, FILES

VERSION = "repo string, tool string, commit_date string, seq long, sha string, description string, props map<string,string>, source_file string"


def _versions(spark, rows):
    return spark.createDataFrame(rows, VERSION)


def test_diffs_edges(spark):
    rows = [
        ("r", "one", "2024-01-01", 1, "a" * 40, "d", {}, "f"),  # single
        ("r", "t", "2024-01-01T00:00:00Z", 2, "a" * 40, None, None, "f"),
        ("r", "t", "2024-01-02T00:00:00Z", 3, "b" * 40, "", {"x": "integer"}, "f"),  # null description is empty; field added
        ("r", "t", "2024-01-03T00:00:00Z", 4, "c" * 40, "", {"x": "object"}, "f"),  # annotation lost
        ("r", "t", "2024-01-03T00:00:00Z", 5, "c" * 40, "new", {"y": "object"}, "f"),  # same sha, tie by seq
        ("r", "t", "2024-01-04T00:00:00Z", 6, "d" * 40, "new", {"y": "object"}, "g"),  # moved only
        ("r", "u", "2024-01-02T00:00:00+09:00", 7, "a" * 40, "first", {}, "f"),
        ("r", "u", "2024-01-01T23:00:00Z", 8, "b" * 40, "by text", {}, "f"),  # ordered as text
    ]
    got = {(r.tool, r.to_seq): r for r in history.diffs(_versions(spark, rows)).collect()}
    assert set(got) == {("t", 3), ("t", 4), ("t", 5), ("t", 6), ("u", 7)}
    a = got["t", 3]
    assert not a.description_changed and a.fields_added == ["x"] and a.structural_type == "schema_add_only" and a.valid
    assert got["t", 4].type_changes == [Row(field="x", from_type="integer", to_type="object")]
    assert got["t", 5].changed and not got["t", 5].valid and got["t", 5].structural_type == "schema_mixed"
    assert not got["t", 6].changed and got["t", 6].source_file_changed
    assert [r.tool for r in history.single_versions(_versions(spark, rows)).collect()] == ["one"]
    assert history.diffs(_versions(spark, [])).count() == 0


def test_identities(spark):
    d = "/root/testdata/sf0.001"
    v = Q.V.versions(spark, d)
    e = history.diffs(v)
    n, tools, single = v.count(), v.select("repo", "tool").distinct().count(), history.single_versions(v).count()
    assert e.count() == n - tools
    assert e.where("changed").count() - e.where("changed and from_sha = to_sha").count() == e.where("valid").count()
    assert single == tools - e.select("repo", "tool").distinct().count()


def _ratings(spark, cells):
    rows, k = [], 0
    for h, line in enumerate(cells):
        for p, n in enumerate(line):
            for _ in range(n):
                rows.append((k, h, p))
                k += 1
    return spark.createDataFrame(rows, "id int, h int, p int")


def test_published_kappas(spark):
    first = [[6, 4, 0, 0, 3], [1, 10, 0, 1, 1], [0, 0, 23, 0, 1], [0, 0, 0, 7, 0], [0, 3, 1, 8, 5]]
    second = [[5, 3, 1, 0, 4], [1, 10, 0, 1, 1], [0, 0, 22, 0, 2], [0, 0, 0, 7, 0], [0, 1, 0, 7, 9]]
    assert abs(agreement.cohen_kappa(_ratings(spark, first), "h", "p").first().kappa - 0.604738) < 1e-6
    assert abs(agreement.cohen_kappa(_ratings(spark, second), "h", "p").first().kappa - 0.637509) < 1e-6
    same = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "id int, h int, p int")
    assert agreement.cohen_kappa(same, "h", "p").first().kappa is None
    assert agreement.fleiss_kappa(same, ["h", "p"], "id").first().kappa is None


def test_published_fleiss(spark):
    # 48 subjects of one label by all, 24 by two, 2 by none; label totals 26, 44, 71, 38, 43.
    votes, left = [], [26, 44, 71, 38, 43]

    def take(*ks):
        for k in ks:
            left[k] -= 1
        votes.append(ks)

    take(0, 1, 3)
    take(0, 1, 4)
    for k, n in enumerate((6, 8, 20, 6, 8)):
        for _ in range(n):
            take(k, k, k)
    doubles = [k for k, n in enumerate((2, 6, 4, 6, 6)) for _ in range(n)]
    singles = [k for k, n in enumerate((2, 6, 3, 7, 6)) for _ in range(n)]
    for a, b in zip(doubles, singles[8:] + singles[:8], strict=True):
        assert a != b
        take(a, a, b)
    assert left == [0] * 5
    r = spark.createDataFrame([(k, *v) for k, v in enumerate(votes)], "id int, a int, b int, c int")
    assert abs(agreement.fleiss_kappa(r, ["a", "b", "c"], "id").first().kappa - 0.687308) < 1e-6


def test_allocation_is_largest_remainder(spark):
    def brute(counts, total):
        n = sum(counts.values())
        total = min(total, n)
        fl = {k: v * total // n for k, v in counts.items()}
        rest = sorted(counts, key=lambda k: (-(counts[k] * total % n), -counts[k], k))
        for k in rest[: total - sum(fl.values())]:
            fl[k] += 1
        return fl

    for counts, total in (({"a": 5, "b": 3, "c": 1}, 4), ({"a": 1, "b": 1, "c": 1}, 2), ({"a": 5, "b": 3}, 100), ({"a": 7}, 0)):
        df = spark.createDataFrame(list(counts.items()), "stratum string, n long")
        assert {r.stratum: r.allocated for r in sampling.proportional_allocation(df, total).collect()} == brute(counts, total)


def test_greedy_backups(spark):
    needy = spark.createDataFrame([("py", "a", 1), ("py", "a", 2), ("py", "b", 3), ("go", "a", 4)], "language string, bucket string, key long")
    backups = spark.createDataFrame([("py", "a", 10, 1, False), ("py", "a", 11, 2, True), ("py", "c", 12, 1, True)], "language string, bucket string, key long, backup_rank long, usable boolean")
    got = {r.key: (r.backup, r.attempt, r.fill) for r in sampling.greedy_backups(needy, backups).collect()}
    assert got == {1: (11, 2, "same"), 2: (12, 1, "cross"), 3: (None, None, "unfilled"), 4: (None, None, "unfilled")}


def test_urls(spark):
    rows = [(" http://github.com/o/r/ ",), ("o/r",), ("",), (None,), ("https://x.org/a",), ("plain",)]
    df = spark.createDataFrame(rows, "u string")
    assert [r[0] for r in df.select(C.canonical_url("u")).collect()] == ["https://github.com/o/r", "https://github.com/o/r", None, None, "https://x.org/a", "plain"]
    o, r = C.owner_repo("u")
    assert df.where("u like ' http%'").select(o, r).first() == ("o", "r") or df.select(C.owner_repo(C.canonical_url("u"))[0]).first()[0] == "o"
    assert df.select(C.slug(C.canonical_url("u"))).first()[0] == "o__r"


def test_schema_types(spark):
    schema = json.dumps({"properties": {"a": {"type": "string"}, "b": {}, "c": {"oneOf": []}, "d": {"anyOf": [1]}, "e": {"type": ["string", "null"]}, "f": {"type": ""}, "g": None}})
    df = spark.createDataFrame([(schema,), (None,), ("{}",), ("no json",)], "s string")
    got = [r[0] for r in df.select(C.property_types("s")).collect()]
    assert got[0] == {"a": "string", "b": "object", "c": "oneOf", "d": "anyOf", "e": '["string","null"]', "f": "object", "g": None}
    assert got[1:] == [{}, {}, {}]
    assert json.loads(df.select(C.sanitised_schema(F.lit('{"x":1,"type":"object","required":["a"]}'))).first()[0]) == {"type": "object", "required": ["a"]}
    assert json.loads(df.select(C.sanitised_schema(F.lit("{}"))).first()[0]) == {"type": "object", "properties": {}}


def test_text_diffs(spark):
    assert D.unified("a", "a") == "" and D.unified(None, "") == ""
    assert D.unified("a\n", "b\n") == "--- before+++ after@@ -1 +1 @@-a\n+b\n"
    assert D.line_view("a b", "a c")[:2] == ["  - a b", "  + a c"] and D.line_view("a b", "a c")[-1] == "  + c"
    assert D.signature(False, None) == "__not_called__"
    assert D.signature(True, '{"b": [1, 2], "a": {"x": 1}, "c": "v"}') == 'a={...}|b=[2 items]|c="v"'
    assert D.compared(True, "{}", False, None) == "BEFORE called the tool; AFTER did not."
    assert D.compared(True, '{"a": 1, "b": 2}', True, '{"b": 3}') == "BEFORE sent ['a']; AFTER omitted them; b: BEFORE=2 vs AFTER=3."
    df = spark.createDataFrame([("a\n", "b\n"), (None, None)], "x string, y string")
    assert [r[0] for r in df.select(D.unified_diff("x", "y")).collect()] == ["--- before+++ after@@ -1 +1 @@-a\n+b\n", ""]


def test_flags_and_labels(spark):
    df = spark.createDataFrame([("I'm not sure",), ("I can't",), ("fine",), (None,)], "t string")
    assert [tuple(r) for r in df.select(C.expresses_doubt("t"), C.expresses_refusal("t")).collect()] == [(True, False), (False, True), (False, False), (False, False)]
    assert df.select(C.reply_label(F.lit('```json\n{"label":"cosmetic"}\n```'))).first()[0] == "COSMETIC"
    assert df.select(C.reply_label(F.lit("x"))).first()[0] == "PARSE_ERROR"


def test_structural_types(spark):
    cases = {(True, 0, 0, 1): "type_change", (False, 1, 1, 0): "schema_mixed", (True, 1, 0, 0): "desc_and_schema_add", (True, 0, 1, 0): "desc_and_schema_remove", (False, 1, 0, 0): "schema_add_only", (False, 0, 1, 0): "schema_remove_only", (True, 0, 0, 0): "desc_only"}
    df = spark.createDataFrame(list(cases), "d boolean, a int, r int, t int").withColumn("k", C.structural_type("d", "a", "r", "t"))
    assert {(r.d, r.a, r.r, r.t): r.k for r in df.collect()} == cases


def test_extraction_over_files(spark):
    files = spark.createDataFrame(FILES, "repo string, language string, path string, content string")
    got = {(r.repo, r.path, r.tool, r.description, r.extractor) for r in extraction.located(files).collect()}
    assert got == set(EXPECTED)
    signals = {r.repo: (r.server_signals, r.hosted, r.curated) for r in extraction.repository_signals(files).collect()}
    assert signals == {k: (k in ("a/go", "a/py", "a/rs", "a/ts"), False, False) for k in ("a/go", "a/js", "a/nb", "a/py", "a/rs", "a/ts")}


def test_hosted_servers_and_curated_lists(spark):
    """Each with what it needs, and without."""
    schema = '"$schema": "https://static.modelcontextprotocol.io/schemas/2025/server.schema.json"'
    rows = [
        ("o/remotes", "server.json", f'{{{schema}, "remotes": [{{"type": "sse"}}]}}'), ("o/url", "a/server.json", f'{{{schema}, "url": "https://x"}}'), ("o/neither", "server.json", f"{{{schema}}}"),
        ("o/broken", "server.json", f'{{{schema}, "url": '), ("o/other", "server.json", '{"url": "https://x"}'), ("o/awesome-things", "main.py", "x = 1"), ("o/list", "README.md", "# An Awesome List\n"),
        ("o/curated", "README.md", "A curated list of servers"), ("o/deep", "docs/README.md", "A curated list"), ("o/late", "README.md", " " * 2100 + "curated list"), ("o/manifest", "package.json", '{"name": "mcp-server"}'),
    ]
    files = spark.createDataFrame([(r, "Python", p, c) for r, p, c in rows], "repo string, language string, path string, content string")
    got = {r.repo: (r.server_signals, r.hosted, r.curated) for r in extraction.repository_signals(files).collect()}
    assert {k for k, v in got.items() if v[1]} == {"o/remotes", "o/url"}
    assert {k for k, v in got.items() if v[2]} == {"o/awesome-things", "o/list", "o/curated"}
    assert {k for k, v in got.items() if v[0]} == {"o/manifest"}


def test_event_rules(spark):
    side = "struct<repo:string,tool:string,sha:string>"
    rows = [(("r", "t", "a"), ("r", "t", "b"), "t", 0.9, "cosmetic"), (("r", "t", " "), ("q", "u", "b"), "t", 1.01, "odd"), (("r", "t", "a"), ("r", "t", "b"), "x", -0.001, "cosmetic")]
    df = spark.createDataFrame(rows, f"before {side}, after {side}, tool string, confidence double, change_type string").withColumn("classified_by", F.lit("x"))
    got = [r.violations for r in seeds.validated(df, seeds.event_rules()).collect()]
    assert got == [[], ["tool", "repo", "sha", "confidence", "change_type"], ["tool", "confidence"]]


def test_required_fields(spark):
    """A field that is absent is a violation, as is a blank sha or a schema that is no object."""
    of = "tool string, description string, source_file string, commit_date string, repo string, schema string, sha string"
    rows = [("t", "", "f", "d", "r", "{}", "a"), (None, None, None, None, None, None, None), ("t", "x", "f", "d", "r", "[]", " "), ("t", "x", "f", "d", "r", "nope", "a")]
    got = [r.violations for r in seeds.validated(spark.createDataFrame(rows, of), seeds.definition_rules()).collect()]
    assert got == [[], ["tool", "description", "source_file", "commit_date", "repo", "schema", "sha"], ["schema", "sha"], ["schema"]]
    side = "struct<repo:string,tool:string,sha:string>"
    event = spark.createDataFrame([(None, None, "t", None, None, None)], f"before {side}, after {side}, tool string, confidence double, change_type string, classified_by string")
    assert set(seeds.validated(event, seeds.event_rules()).first().violations) == {"tool", "sha", "classified_by", "confidence", "change_type"}


def test_single_versions_have_short_shas(spark):
    one = _versions(spark, [("r", "t", "2024-01-01", 1, "0123456789abcdef0123", "d", {}, "f.py")])
    assert [r.sha for r in history.single_versions(one).collect()] == ["01234567"]


def test_a_property_that_is_null_keeps_its_name(spark):
    df = spark.createDataFrame([('{"properties": {"a": null, "b": {"type": "string"}}}',)], "s string")
    assert df.select(C.property_types("s")).first()[0] == {"a": None, "b": "string"}


def test_seed_rules_and_canonical(spark):
    df = spark.createDataFrame([("u", None, -1), (None, "s", None)], "URL string, registry_source string, stargazers int")
    out = seeds.canonical(df, {"repo_url": ["repo_url", "url"], "registry_source": ["registry_source"], "stars": ["stars", "stargazers"], "language": ["lang"]})
    assert out.columns == ["repo_url", "registry_source", "stars"]
    assert [r.violations for r in seeds.validated(out, seeds.seed_rules()).collect()] == [["registry_source", "stars"], ["repo_url"]]


def test_concentration_and_gate(spark):
    df = spark.createDataFrame([(k % 3,) for k in range(10)], "repo int")
    assert [(r.repo, r.n, r.cumulative_pct) for r in reports.concentration(df, "repo", 2).orderBy("rank").collect()] == [(0, 4, 40.0), (1, 3, 70.0)]
    assert reports.coverage_gate(10, 8) and not reports.coverage_gate(10, 7) and reports.coverage_gate(0, 0)
