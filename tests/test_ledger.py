"""Appends that fail, stop half-way or are repeated leave the ledger as it was."""

import os

import pytest
from pyspark.sql import functions as F

from driftloom.sources import ledger

SCHEMA = "id bigint, name string, tags array<string>"


def rows(spark, lo, hi, parts=3):
    return spark.range(lo, hi, 1, parts).select("id", F.concat(F.lit("n"), "id").alias("name"), F.array(F.lit("a"), F.lit(None).cast("string")).alias("tags"))


def ids(spark, path):
    return sorted(r["id"] for r in ledger.read(spark, path, SCHEMA).collect())


def test_appends_add_up(spark, tmp_path):
    path = str(tmp_path / "log")
    assert ids(spark, path) == []
    ledger.append(rows(spark, 0, 10), path)
    ledger.append(rows(spark, 10, 15), f"file://{path}")
    assert ids(spark, path) == list(range(15))
    assert ledger.read(spark, path, SCHEMA).where("id = 3").first().asDict() == {"id": 3, "name": "n3", "tags": ["a", None]}
    assert sorted(r["rows"] for r in ledger.manifests(spark, path).collect()) == [5, 10]


def test_an_empty_append_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    ledger.append(rows(spark, 0, 0), path)
    assert ids(spark, path) == []


@pytest.mark.parametrize("how", ["raise", "exit"])
def test_a_task_that_dies_leaves_the_ledger_as_it_was(spark, tmp_path, how):
    """One task is killed while others have written their parts."""
    path = str(tmp_path / "log")
    ledger.append(rows(spark, 0, 4), path)

    def broken(batches):
        for b in batches:
            if 17 in b.column("id").to_pylist():
                if how == "exit":
                    os._exit(1)
                raise ValueError("lost")
            yield b

    with pytest.raises(Exception):
        ledger.append(rows(spark, 10, 20, 4).mapInArrow(broken, SCHEMA), path)
    assert ids(spark, path) == [0, 1, 2, 3]
    assert ledger.manifests(spark, path).count() == 1
    ledger.append(rows(spark, 4, 6), path)
    assert ids(spark, path) == list(range(6))


def test_parts_without_a_manifest_are_not_read(spark, tmp_path):
    """The driver dies after the tasks and before the manifest: what was left behind is no row."""
    path = str(tmp_path / "log")
    ledger.append(rows(spark, 0, 4), path)
    rows(spark, 50, 60).coalesce(1).write.parquet(f"{path}/stray")
    stray = next(f for f in os.listdir(f"{path}/stray") if f.endswith(".parquet"))
    os.rename(f"{path}/stray/{stray}", f"{path}/parts/stray.parquet")
    assert ids(spark, path) == [0, 1, 2, 3]


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "log")
    for _ in range(2):
        ledger.append(rows(spark, 0, 4), path, batch="day-1")
    ledger.append(rows(spark, 4, 5), path, batch="day-2")
    assert ids(spark, path) == list(range(5))
    assert len(os.listdir(f"{path}/parts")) == sum(len(r["parts"]) for r in ledger.manifests(spark, path).collect())


def test_only_new_keys_are_added(spark, tmp_path):
    path = str(tmp_path / "log")
    for hi in (4, 7, 7):
        ledger.append_new(rows(spark, 0, hi), path, ["id"], SCHEMA)
    assert ids(spark, path) == list(range(7))


def test_overwriting_is_refused(spark, tmp_path):
    spark.dataSource.register(ledger.Ledger)
    with pytest.raises(Exception, match="appended"):
        rows(spark, 0, 1).write.format(ledger.FORMAT).mode("overwrite").save(str(tmp_path / "log"))
