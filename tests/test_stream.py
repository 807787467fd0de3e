"""The stream of changes against the batch operator, with versions in any order."""

import os
import random
from datetime import datetime, timedelta

from driftloom.operators import history
from driftloom.streaming.changes import stream_changes

SCHEMA = "repo string, tool string, date timestamp, seq long, description string"
START = datetime(2024, 1, 1)


def told(spark, tmp_path, batches, name, **options):
    """The changes of a stream that reads each batch by itself."""
    src = str(tmp_path / name)
    os.makedirs(src)
    out = None
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        out = stream_changes(stream, **options).writeStream.format("parquet").option("path", f"{src}-out").option("checkpointLocation", f"{src}-at").trigger(availableNow=True).start()
        out.awaitTermination(240)
        assert out.exception() is None
    df = spark.read.parquet(f"{src}-out")
    return sorted((r.repo, r.tool, r.from_seq, r.to_seq, r.description_changed) for r in df.collect())


def test_shuffled_versions_give_the_batch_result(spark, tmp_path):
    rng = random.Random(5)
    rows = [("r", f"t{k % 3}", START + timedelta(minutes=k // 2 * 7), k, rng.choice(["a", "b", None])) for k in range(60)]
    end = [("r", "end", START + timedelta(days=30), 1000, "x")]  # moves the watermark past all others
    shuffled = rows[:]
    rng.shuffle(shuffled)
    got = told(spark, tmp_path, [shuffled[:25], shuffled[25:], end], "shuffled", delay="20 hours")
    versions = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "repo", "tool", "cast(date as string) commit_date", "seq", "'x' sha", "description", "cast(null as map<string,string>) props", "'f' source_file"
    )
    expected = sorted((r.repo, r.tool, r.from_seq, r.to_seq, r.description_changed) for r in history.diffs(versions).collect())
    assert got == expected and len(got) == 57


def test_late_and_repeated_versions_are_dropped(spark, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    batches = [
        [("r", "t", at(0), 1, "a"), ("r", "t", at(0), 1, "a"), ("r", "t", at(10), 2, "b")],
        [("r", "t", at(2), 9, "late")],  # the watermark is at 9 hours
        [("r", "t", at(12), 3, "b"), ("r", "end", at(99), 4, "x")],
        [("r", "end", at(200), 5, "x")],
    ]
    assert told(spark, tmp_path, batches, "late", delay="1 hour") == [("r", "end", 4, 5, False), ("r", "t", 1, 2, True), ("r", "t", 2, 3, False)][1:]
