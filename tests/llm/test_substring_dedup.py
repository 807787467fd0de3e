"""Removal of repeats against windows compared one by one."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftloom.llm import substring_dedup as S

WORD = r"[^\x20\x09-\x0D]+"


def brute(rows, window):
    import re

    texts = [re.findall(WORD, t or "") for _, t in rows]
    n = Counter(tuple(w[k : k + window]) for w in texts for k in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if n[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def ours(spark, rows, parts=3, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    for c in ("chunk", "BUCKET", "n", "spans", "sizes", "anchors", "body"):
        docs = docs.withColumn(c, F.lit("x"))
    got = S.without_repeats(docs, **options).collect()
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
    return [(r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got]


def sample(seed, n=120, longest=90, alphabet=400):
    """Texts with shared passages at all offsets, copies, near copies and runs of one word."""
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(alphabet)}" for _ in range(rng.randrange(3, 40))] for _ in range(6)]
    rows = []
    for k in range(n):
        w = [f"w{rng.randrange(alphabet)}" for _ in range(rng.randrange(longest))]
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(len(w) + 1), rng.choice(passages)
            lo = rng.randrange(len(p))
            w[at:at] = p[lo : lo + rng.randrange(1, 40)]
        if rng.random() < 0.05:
            w += ["same"] * rng.randrange(1, 30)
        rows.append((k, rng.choice([" ", "\n", " \t"]).join(w)))
    for k in range(n // 5):
        text = rows[rng.randrange(n)][1].split()
        if text and rng.random() < 0.6:
            text[rng.randrange(len(text))] = "edited"
        rows.append((n + k, " ".join(text)))
    return rows


@pytest.mark.parametrize(
    ("window", "options"),
    [(35, {}), (10, {"chunk_words": 300}), (7, {"chunk_words": 1, "bucket": 50}), (4, {"chunk_words": 1000, "bucket": 500}), (1, {}), (2, {"chunk_words": 64})],
)
def test_equals_windows_compared_one_by_one(spark, window, options):
    rows = sample(window)
    got = ours(spark, rows, window=window, **options)
    assert sorted(got, key=repr) == sorted(brute(rows, window), key=repr)
    assert any(r[2] for r in got) and (window == 1 or any(not r[2] for r in got))


def test_odd_rows(spark):
    long = " ".join(f"x{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "one two"), (5, "one two"), (None, "three four " * 20), (None, None), (6, "ünï çödé " * 17 + "end"), (7, "word " * 200), (8, "Word " * 34), (9, f"y {long[:4000]}")]
    got = ours(spark, rows)
    assert sorted(got, key=repr) == sorted(brute(rows, 35), key=repr)


def test_windows_of_one_document_overlapping_themselves(spark):
    """A run of one word of a window and one more holds the window twice; a single window stands alone."""
    rows = [(1, "a " * 36), (2, "b " * 35), (3, "c " * 34)]
    assert sorted((r[0], r[2]) for r in ours(spark, rows)) == [(1, 36), (2, 0), (3, 0)]


def test_no_rows(spark):
    assert ours(spark, []) == []


def test_query_hashes_what_is_kept(spark):
    got = S.op13_substring_dedup(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    expected = {r[0]: (r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in brute([(d["doc_id"], d["text"]) for d in docs], 35)}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == expected
