"""The manifest against a tree built node by node, on small fixtures with nulls, ties, repeated rows and several rounds of blocks."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from driftloom.llm import merkle_manifest as M

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def up(nodes, fanout):
    return [sha("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]


def brute(rows, fanout=16):
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), by lists of whole trees."""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append(up(levels[-1], fanout))
        return levels

    trees = {}
    for s, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in own])
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    over = climb([trees[s][-1][0] for s in names])
    out = []
    for s in names:
        for i, r in enumerate(by[s]):
            proof, digest = "", leaf(r, lower=r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for levels, k in ((trees[s], i), (over, names.index(s))):
                for nodes in levels[:-1]:
                    lo = k // fanout * fanout
                    run = nodes[lo : lo + fanout]
                    left, right = "".join(run[: k - lo]), "".join(run[k - lo + 1 :])
                    proof, digest, k = proof + left + right, sha(left + digest + right), k // fanout
            out.append((r[0], leaf(r), trees[s][-1][0], over[-1][0], sha(proof), digest, digest == over[-1][0]))
    return out


def ours(docs, **options):
    rows = M.manifest(M.document_leaves(docs), **options)
    out = rows.select("doc_id", "leaf", "subroot", "root", M.proof_digest().alias("p"), M.folded(F.coalesce("tampered", "leaf")).alias("f"))
    return [tuple(r) for r in out.withColumn("v", F.col("f") == F.col("root")).collect()]


def rows_of(sizes):
    k, rows = 0, []
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((k * 7 % 1009, f"Text {k} ÜÄ of {s}", "en" if k % 3 else None, s, k))
            k += 1
    return rows


@pytest.mark.parametrize(
    ("sizes", "options"),
    [
        ({"a": 1}, {}),
        ({"a": 16, "b": 17, "c": 1, None: 5}, {}),
        ({"a": 300, "é": 2, "z": 33, "": 1}, {}),
        ({"a": 300, **{f"s{k}": 1 + k % 3 for k in range(70)}}, {"fanout": 4, "block_levels": 2}),
        ({"a": 64, "b": 65, "c": 4, "d": 5}, {"fanout": 4, "block_levels": 1}),
    ],
)
def test_equals_trees_built_whole(spark, sizes, options):
    rows = rows_of(sizes)
    got = ours(spark.createDataFrame(rows, DOCS).repartition(5), **options)
    assert sorted(got, key=repr) == sorted(brute(rows, options.get("fanout", 16)), key=repr)
    assert any(not r[-1] for r in got) or len(rows) < 10


def test_nulls_repeated_rows_and_clashing_names(spark):
    rows = [(None, None, None, None, None), (None, "A", None, None, 1), (3, "", "en", "a", 0), (5, "Copy", "en", "b", 4), (5, "Copy", "en", "b", 4), (5, "Other", "en", "b", 5), (9, "WORD " * 30_000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("leaf", "path", "root", "tree", "AT", "n", "digest", "tampered", "_file"):
        docs = docs.withColumn(c, F.lit("x"))
    assert sorted(ours(docs), key=repr) == sorted(brute(rows), key=repr)


def test_no_rows(spark):
    assert ours(spark.createDataFrame([], DOCS)) == []


def test_lower_case_texts_stay_verified(spark):
    """Tampering that changes nothing leaves the leaf; any other is seen."""
    rows = [(k, "lower" if k % 2 else "Upper", "en", "s", 1) for k in range(60)]
    got = {r[0]: r[-1] for r in ours(spark.createDataFrame(rows, DOCS))}
    assert {k for k, ok in got.items() if not ok} == {k for k in range(0, 60, 2) if zlib.crc32(str(k).encode()) % 5 == 0}
