"""Readers, writers and the stream."""

import os

from driftloom.sources import readers, sinks


def test_csv_and_jsonl(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('repo_url,stars\nhttps://x/a,5\n"q ""u"", v",\n')
    rows = readers.csv(spark, str(p), "repo_url string, stars long").collect()
    assert [tuple(r) for r in rows] == [("https://x/a", 5), ('q "u", v', None)]
    assert readers.csv(spark, str(p)).dtypes == [("repo_url", "string"), ("stars", "string")]
    q = tmp_path / "a.jsonl"
    q.write_text('{"k": 1, "v": "a"}\n\n{bad\n{"k": 1, "v": "b"}\n{"k": 2, "v": "c"}\n')
    assert readers.jsonl(spark, str(q), "k int, v string", tolerant=True).count() == 3
    assert {(r.k, r.v) for r in readers.checkpoint(spark, str(q), "k int, v string", ["k"]).collect()} == {(1, "b"), (2, "c")}
    d = tmp_path / "a.json"
    d.write_text('[{"k": 1}, {"k": 2}]')
    assert readers.json_document(spark, str(d)).count() == 2
    assert readers.optional(spark, str(tmp_path / "none"), readers.csv) is None


def test_csv_round_trip(spark, tmp_path):
    rows = [('q "u", v\nw', 1), ("a,b", 2), ("it's", None), ("\"", 4)]
    sinks.write_csv(spark.createDataFrame(rows, "t string, n int"), str(tmp_path / "c"))
    assert sorted(readers.csv(spark, str(tmp_path / "c"), "t string, n int").collect()) == sorted(rows)


def test_what_is_appended_later_counts(spark, tmp_path):
    import time

    log, schema = str(tmp_path / "log"), "k int, v int"
    for k in range(4):
        spark.createDataFrame([(1, k), (k, 10)], schema).coalesce(1).write.mode("append").json(log)
        time.sleep(0.05)
    assert {(r.k, r.v) for r in readers.checkpoint(spark, log, schema, ["k"]).collect()} == {(0, 10), (1, 3), (2, 10), (3, 10)}


def test_append_and_upsert(spark, tmp_path):
    log, schema = str(tmp_path / "log"), "k int, v string"
    df = spark.createDataFrame([(1, "a"), (2, "b")], schema)
    assert sinks.append_new(df, log, ["k"], schema) == 2
    assert sinks.append_new(df, log, ["k"], schema) == 0
    sinks.upsert_json(spark.createDataFrame([(2, "z"), (3, "c")], schema), log, "k", schema)
    assert [tuple(r) for r in readers.jsonl(spark, log, schema).orderBy("k").collect()] == [(1, "a"), (2, "z"), (3, "c")]
    assert sinks.backup_once(spark, log, str(tmp_path / "b")) and not sinks.backup_once(spark, log, str(tmp_path / "b"))
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_csv(df, str(tmp_path / "c"), append=True)
    assert readers.csv(spark, str(tmp_path / "c")).count() == 4


def test_source_tree_and_markdown(spark, tmp_path):
    (tmp_path / "r" / "src").mkdir(parents=True)
    (tmp_path / "r" / "src" / "a.py").write_text("x = 1")
    (tmp_path / "r" / "b.txt").write_text("no")
    assert [(r.repo, r.path) for r in readers.source_tree(spark, str(tmp_path)).collect()] == [("r", "src/a.py")]
    m = tmp_path / "m.md"
    m.write_text("# Title\n\nIntro here.\n\n## Next\nrest\n")
    assert readers.markdown_intro(spark, str(m)).first().intro.strip() == "Intro here."


def test_commit_log(spark):
    lines = ["COMMIT:aa 2024-01-01", "", "src/a.py", "src/b.py", "COMMIT:bb 2024-01-02", "src/c.py"]
    df = spark.createDataFrame([("r", k, x) for k, x in enumerate(lines)], "repo string, seq long, line string")
    assert [(r.sha, r.date, r.path) for r in readers.commit_log(df).orderBy("seq").collect()] == [("aa", "2024-01-01", "src/a.py"), ("bb", "2024-01-02", "src/c.py")]
