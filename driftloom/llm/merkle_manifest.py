"""Merkle manifest of a dataset: a digest tree for each source, one over the sources, and a proof for each row.

Nodes are lower-case hex text and a run of ``FANOUT`` of them is hashed as it stands, so in an aligned block the nodes of
a level are one contiguous (n, 64) byte matrix: reshaped by the fanout its rows are what is hashed, and the siblings of
node i are the two slices beside it in its run. Blocks of a level are independent of each other. Block tops
climb in rounds until each tree has one node; then paths come down the same rounds. No tree passes whole
through a task: a group is a block, however large its source.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import discard, table, written

FANOUT = 16
#: Levels that a block spans; it holds FANOUT ** BLOCK_LEVELS nodes.
BLOCK_LEVELS = 3

_PATH = "array<struct<left:string,right:string>>"
_PATH_ARROW = pa.struct([("left", pa.string()), ("right", pa.string())])


def field(column: str) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = F.col(column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: str | Column) -> Column:
    """sha256, as lower-case hex, of the columns' fields one after another."""
    return F.sha2(F.concat(*[field(c) if isinstance(c, str) else c for c in columns]).cast("binary"), 256)


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]).cast("binary"), 256))


def proof_digest(path: str = "path") -> Column:
    """sha256 of all siblings of a path, from the bottom up and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "").cast("binary"), 256)


def levels_of(n: int, fanout: int, most: int) -> int:
    """Levels above ``n`` nodes until one is left, ``most`` at most."""
    k = 0
    while n > 1 and k < most:
        n, k = -(-n // fanout), k + 1
    return k


def block_matrices(nodes: np.ndarray, fanout: int, levels: int) -> list[np.ndarray]:
    """The (n, 64) matrices of a block, level by level from ``nodes`` up."""
    out = [nodes]
    for _ in range(levels):
        m = out[-1]
        full = len(m) // fanout * fanout
        runs = [*m[:full].reshape(-1, fanout * 64), *([m[full:].reshape(-1)] if full < len(m) else [])]
        out.append(np.frombuffer("".join(hashlib.sha256(r).hexdigest() for r in runs).encode(), np.uint8).reshape(-1, 64))
    return out


def siblings(matrices: list[np.ndarray], i: int, fanout: int) -> list[tuple[bytes, bytes]]:
    """What stands left and right of node ``i`` of the block's lowest level in its run, and so on upwards."""
    out = []
    for m in matrices[:-1]:
        lo = i // fanout * fanout
        hi = min(lo + fanout, len(m))
        out.append((m[lo:i].tobytes(), m[i + 1 : hi].tobytes()))
        i //= fanout
    return out


def _matrix(digests: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer("".join(digests.to_pylist()).encode(), np.uint8).reshape(-1, 64)


def _placed(df: DataFrame, order: list[str], name: str, at: str) -> DataFrame:
    """``df`` as a table sorted by ``order`` over all its files, with each row's place, gapless from 0, in ``at``."""
    sorted_ = written(df.repartitionByRange(*order).sortWithinPartitions(*order), name)
    rows = sorted_.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = Window.orderBy(F.length("_file"), "_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_file").agg(F.count("*").alias("_n")).select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row for each file
    return rows.join(starts, "_file").withColumn(at, F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def _climbed(nodes: DataFrame, rounds: int, fanout: int, block_levels: int) -> list[DataFrame]:
    """Tables of (tree, at, n, digest): ``nodes`` and, block tops by block tops, up to one node for each tree."""
    size = fanout**block_levels

    def top(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        n = t["n"][0].as_py()
        levels = levels_of(n, fanout, block_levels)
        digest = block_matrices(_matrix(t["digest"]), fanout, levels)[-1].tobytes().decode()
        return pa.table({"tree": [key[0].as_py()], "at": [key[1].as_py()], "n": [-(-n // fanout**levels)], "digest": [digest]})

    out = [nodes]
    for _ in range(rounds):
        blocks = out[-1].select("tree", "at", "n", "digest", F.expr(f"at div {size}").alias("block")).groupBy("tree", "block")
        out.append(written(blocks.applyInArrow(top, "tree long, at long, n long, digest string"), "merkle-tops"))
    return out


def _with_paths(extra: list[str], fanout: int, block_levels: int):
    """A block's nodes with their paths: their own siblings in the block, then what its top has above itself."""

    def paths(nodes: pa.Table, up: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("at")
        rest = up["path"][0].as_py()
        over = [[step[side] for step in rest] for side in ("left", "right")]
        matrices = block_matrices(_matrix(nodes["digest"]), fanout, levels_of(nodes["n"][0].as_py(), fanout, block_levels))
        left, right = [], []
        for i in range(len(nodes)):
            for a, b in siblings(matrices, i, fanout):
                left.append(a)
                right.append(b)
            left += over[0]
            right += over[1]
        steps = pa.StructArray.from_arrays([pa.array(side, pa.binary()).cast(pa.string()) for side in (left, right)], fields=list(_PATH_ARROW))
        path = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1) * (len(matrices) - 1 + len(rest)), pa.int32()), steps)
        roots = {c: pa.array([up[c][0].as_py()] * len(nodes), pa.string()) for c in ("subroot", "root")}
        return pa.table({c: nodes[c] for c in ("tree", "at", *extra)} | {"path": path} | roots)

    return paths


def _descended(tables: list[DataFrame], above: DataFrame, carried: list[str], fanout: int, block_levels: int) -> DataFrame:
    """``carried``, path, subroot and root of the nodes of ``tables[0]``. ``above``: (tree, at, path, subroot, root) of the tops."""
    for k in reversed(range(len(tables) - 1)):
        extra = carried if k == 0 else []
        kept = tables[k].select("tree", "at", "n", "digest", *[c for c in extra if c != "digest"])
        kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in ["tree", "at", *extra])
        blocks = kept.withColumn("block", F.expr(f"at div {fanout**block_levels}")).groupBy("tree", "block")
        ups = above.withColumnRenamed("at", "block").groupBy("tree", "block")
        above = blocks.cogroup(ups).applyInArrow(_with_paths(extra, fanout, block_levels), f"{kinds}, path {_PATH}, subroot string, root string")
    return above


def manifest(leaves: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``leaves`` with ``path`` (array of (left, right): the siblings beside the node, from the bottom up to the root), ``subroot`` and ``root``.

    ``leaves``: source, doc_id, leaf (lower-case hex sha256), and columns of other names to carry along. Of a source
    leaves ascend by doc_id (null first), then by leaf; rows that are equal in both change nothing by their order.
    Every ``fanout`` consecutive nodes, fewer in the last run, become the digest of their text, as long as a source has
    several; a lone leaf is its subroot. Subroots in the order of source (null first, by bytes) give the root in the
    same way. An empty input gives an empty result. One range shuffle orders the leaves, then each round's blocks
    are groups of bounded size; number and size of sources don't matter.
    """
    for c in ("tree", "at", "n", "digest", "path", "subroot", "root", "block"):
        if c in leaves.columns:
            raise ValueError(f"column {c} is made here: rename it")
    order = ["source", "doc_id", "leaf", "_salt"]  # the last parts rows that are equal
    placed = _placed(leaves.withColumn("_salt", F.monotonically_increasing_id()), order, "merkle-order", "_place")
    sources = written(placed.groupBy("source").agg(F.min("_place").alias("_from"), F.count("*").alias("n")), "merkle-sources")
    ranked = written(_placed(sources, ["_from"], "merkle-ranks", "tree"), "merkle-trees")
    joined = placed.join(ranked.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    nodes = written(joined.select(*leaves.columns, F.col("leaf").alias("digest"), "tree", (F.col("_place") - F.col("_from")).alias("at"), "n"), "merkle-leaves")

    n_sources, longest = ranked.agg(F.count("*"), F.max("n")).first()
    rounds = lambda n: max(1, -(-levels_of(n or 1, fanout, 64) // block_levels))
    trees = _climbed(nodes, rounds(longest), fanout, block_levels)
    subroots = trees[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(n_sources).cast("long").alias("n"), "digest")
    over = _climbed(written(subroots, "merkle-subroots"), rounds(n_sources), fanout, block_levels)

    nothing = F.array().cast(_PATH)
    top = over[-1].select("tree", F.lit(0).cast("long").alias("at"), nothing.alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    above = _descended(over, top, ["digest"], fanout, block_levels)
    above = above.select(F.col("at").alias("tree"), F.lit(0).cast("long").alias("at"), "path", F.col("digest").alias("subroot"), "root")
    out = _descended(trees, written(above, "merkle-paths"), leaves.columns, fanout, block_levels)
    discard(sources)
    return out.select(*leaves.columns, "path", "subroot", "root")


#: What a leaf holds, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def document_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): the leaf of each document, and that of one whose text's A-Z are lower-cased where
    5 divides crc32 of the id's decimal text, else null. A null id is not tampered with; a null text stays null."""
    lower = F.coalesce(F.concat(F.octet_length("text").cast("string"), F.lit(":"), F.translate("text", _UPPER, _UPPER.lower())), F.lit("-"))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select("doc_id", "source", leaf_digest(*FIELDS).alias("leaf"), F.when(chosen, leaf_digest(*FIELDS[:-1], lower)).alias("tampered"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether each leaf, a fifth of them tampered with, still leads to the root."""
    rows = manifest(document_leaves(table(spark, sf_dir, "documents")))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), folded(F.coalesce("tampered", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLES: dict[str, str] = {}
