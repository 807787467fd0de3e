"""Coerced times, cutoffs, lists, notes, orders of one's own, loose JSON, slots, fills, metrics, records and source files."""

import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from driftloom.functions import columns as C
from driftloom.functions import extract as X
from driftloom.operators import extraction, history, metrics, sampling, seeds
from driftloom.plans import queries as Q
from driftloom.sources import readers


def test_times_that_are_none_are_null(spark):
    df = spark.createDataFrame([(" 2024-02-03T04:05:06Z ",), ("2024-02-03T04:05:06+09:00",), ("2024-02-03",), ("nan",), ("",), (None,), ("2024-02-31",)], "t string")
    got = [r[0] for r in df.select(F.date_format(C.timestamp_or_null("t"), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2024-02-03 04:05", "2024-02-02 19:05", "2024-02-03 00:00", None, None, None, None]


def test_cutoffs_keep_the_day_or_take_the_months_last(spark):
    got = spark.range(1).select(*[C.months_before(t, n).cast("string").alias(f"c{k}") for k, (t, n) in enumerate([("2024-03-31 10:20:30", 1), ("2024-02-29", 12), ("2024-05-15", 24), ("2024-01-15", 0)])]).first()
    assert list(got) == ["2024-02-29 10:20:30", "2023-02-28 00:00:00", "2022-05-15 00:00:00", "2024-01-15 00:00:00"]


def test_required_lists(spark):
    df = spark.createDataFrame([('{"required": ["a", "b"]}',), ('{"required": []}',), ("{}",), ("nope",), (None,), ('{"required": null}',)], "s string")
    assert [r[0] for r in df.select(C.rendered_required("s")).collect()] == ["['a', 'b']", "[]", "[]", "[]", "[]", "[]"]


def test_replacement_notes(spark):
    of = "cloned boolean, tools int, hosted boolean, curated boolean, signals boolean"
    rows = [(False, 3, True, True, True), (True, 2, True, True, True), (True, 0, True, True, True), (True, 0, False, True, True), (True, 0, False, False, True), (True, None, None, None, None), (None, None, None, None, None)]
    got = [tuple(r.w) for r in spark.createDataFrame(rows, of).select(C.replacement("cloned", "tools", "hosted", "curated", "signals").alias("w")).collect()]
    assert got == [("clone_failed", None), (None, None), ("not_a_server", "remote_hosted_server"), ("not_a_server", "curator_list"), ("zero_tools_found", None), ("not_a_server", None), ("clone_failed", None)]


def test_an_order_of_ones_own(spark):
    df = spark.createDataFrame([("low",), ("high",), (None,), ("odd",), ("mid",)], "v string")
    assert [r.v for r in df.orderBy(C.category_order("v", ["high", "mid", "low"])).collect()] == ["high", "mid", "low", "odd", None]


LOOSE = [
    ("{a: 1, b: 'x',}", {"a": 1, "b": "x"}), ('{"a": [1, 2, ], \'b\': {c: null}}', {"a": [1, 2], "b": {"c": None}}), ('{"a": "it\'s, {k: 1,}"}', {"a": "it's, {k: 1,}"}), ("{}", {}), ('{"a": 1}', {"a": 1}),
]


def test_loose_objects_in_both_forms(spark):
    """A file's fragments and a column's values are read alike, and strings stay as they are."""
    assert [X.relaxed(t) for t, _ in LOOSE] == [v for _, v in LOOSE]
    assert X.relaxed("{broken") == {} == X.relaxed("")
    df = spark.createDataFrame([(t,) for t, _ in LOOSE] + [("{broken",), (None,)], "t string")
    got = [r[0] for r in df.select(F.to_json(C.relaxed_json("t"))).collect()]
    assert [json.loads(x) for x in got[:-2]] == [v for _, v in LOOSE] and got[-2:] == [None, None]


def test_results_meet_their_slots_candidate(spark):
    results = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "slot int, r string")
    candidates = spark.createDataFrame([(1, "x", "y"), (2, "x", None), (2, "w", "z"), (None, "n", "n")], "slot int, before string, after string")
    got = {r.r: (r.before, r.after) for r in seeds.with_results(results, candidates, "slot", ["before", "after"]).collect()}
    assert got == {"a": ("x", "y"), "b": ("x", "{}"), "c": ("{}", "{}"), "d": ("{}", "{}")}


def test_fills_by_source(spark):
    planned = spark.createDataFrame([("a", "1", 3), ("a", "2", 1), ("b", "1", 2)], "language string, bucket string, planned bigint")
    drawn = spark.createDataFrame([("a", "1", True), ("a", "1", False), ("a", "1", None), ("a", "2", False)], "language string, bucket string, ok boolean")
    backups = spark.createDataFrame([("a", "1", "same"), ("a", "1", "cross"), ("a", "2", "unfilled")], "language string, bucket string, fill string")
    got = {(r.language, r.bucket): tuple(r)[2:] for r in sampling.filled(planned, drawn, backups, ["language", "bucket"]).collect()}
    assert got == {("a", "1"): (3, 3, 0, 100.0, 1, 1, 1, 0), ("a", "2"): (1, 0, -1, 0.0, 0, 0, 0, 1), ("b", "1"): (2, 0, -2, 0.0, 0, 0, 0, 2)}


def test_metrics_come_from_the_pass_that_writes(spark):
    """Inputs are read once for the rows and for all numbers."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    gauge = metrics.Gauge("in", read=F.count("*"), odd=F.count_if(F.col("id") % 2 == 1))
    rows = gauge.on(spark.range(0, 100, 1, 4).mapInArrow(counted, "id long")).where("id < 60")
    table, out = metrics.measured(rows, {"kept": F.count("*"), "top": F.max("id")})
    assert out == {"kept": 60, "top": 59} and gauge.read() == {"read": 100, "odd": 50}
    assert table.count() == 60 and seen.value == 100


def test_walk_statistics_scan_each_table_once(spark):
    """The plan that makes the rows is the only one that reads the tables."""
    d = "/root/testdata/sf0.001"
    plan = history.diffs(Q.V.versions(spark, d), firsts=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2  # orders and lineitem
    assert Q.QUERIES["walk_statistics"](spark, d).first().records == Q.V.versions(spark, d).count()


def test_records_hold_pairs_and_single_versions(spark):
    of = "repo string, tool string, commit_date string, seq long, sha string, description string, props map<string,string>, source_file string"
    rows = [("r", "one", "2024", 1, "a" * 40, "d", {}, "f"), ("r", "t", "2024", 2, "a" * 40, "old\nline", None, "f"), ("r", "t", "2025", 3, "b" * 40, "new\nline", {"x": "integer"}, "g"), ("r", "t", "2026", 4, "c" * 40, "new\nline", {"x": "integer"}, "g")]
    got = {(r.tool, r.to_seq): r for r in history.records(spark.createDataFrame(rows, of)).collect()}
    assert set(got) == {("one", 1), ("t", 3), ("t", 4)}
    one, first, same = got["one", 1], got["t", 3], got["t", 4]
    assert (one.status, one.snapshot_count, one.to_sha, one.from_sha, one.description_diff, one.fields_added) == ("no_drift_observed", 1, "a" * 8, None, None, None)
    assert (first.status, first.snapshot_count, first.fields_added, first.source_file_changed) == ("drift_event", None, ["x"], True)
    assert first.description_diff == "--- before+++ after@@ -1,2 +1,2 @@-old\n+new\n line"
    assert (same.status, same.description_changed, same.description_diff, same.type_changes) == ("drift_event", False, "", [])


def test_source_files_have_a_language_and_no_tests(spark, tmp_path):
    for name, text in (("a/src/s.py", '@tool\ndef f():\n    """F."""\n'), ("a/tests/t.py", "x"), ("a/node_modules/m.js", "x"), ("b/l.rs", 'Tool::new("n").description("d");'), ("b/notes.txt", "x")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = readers.source_files(spark, str(tmp_path), spark.createDataFrame([("a", "Python")], "repo string, language string"))
    assert sorted((r.repo, r.language, r.path) for r in files.collect()) == [("a", "Python", "src/s.py"), ("b", None, "l.rs")]
    assert sorted(tuple(r)[:4] for r in extraction.located(files).collect()) == [("a", "src/s.py", "f", "F."), ("b", "l.rs", "n", "d")]


def test_csv_types(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("url,stars,rate,archived\nx,5,1.5,true\n,,,\n")
    assert dict(readers.csv(spark, str(p), infer=True).dtypes) == {"url": "string", "stars": "int", "rate": "double", "archived": "boolean"}
    assert readers.csv(spark, str(p)).first() == Row(url="x", stars="5", rate="1.5", archived="true")
