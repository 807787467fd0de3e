"""Embedding near-duplicates: an exact metric range join by pivots.

Unit vectors are dealt to the cell of their nearest pivot, and also to every cell that holds something
within reach: if x lies nearer to q than to p, and |x - y| <= r, then y is at most r beyond the plane between p
and q (the triangle inequality along p - q). Each cell joins its own vectors with all dealt to it, apart
from the others, in tiles of two blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import components, table, written

#: Vectors for each pivot, and pivots at most (a broadcast of so many vectors); beyond, cells have more tiles.
PER_PIVOT, MOST_PIVOTS = 16_384, 4096
#: Vectors of a block; a tile holds two.
BLOCK = 8192

_FOUND = "kind int, a long, b long"
_PA_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _near(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each unit vector, and which cells it goes to."""
    dots = x @ pivots.T
    home = dots.argmax(1)
    own = dots[np.arange(len(x)), home][:, None]
    # Rounding of the pivots' distances makes cells larger by a hair, never smaller.
    apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0) + 1e-9)
    there = np.empty(dots.shape, bool)
    for lo in range(0, len(x), 256):
        part = slice(lo, lo + 256)
        there[part] = own[part] - dots[part] <= reach * apart[home[part]] + 1e-9
    return home, there


def _assigned(pivots: dict[int, np.ndarray], reach: float, counts: dict[int, tuple[int, int]] | None):
    """Cells as numbers: MOST_PIVOTS for each length of vectors. Without counts: (cell, home) pairs; with them: tiles."""

    def spread(batches):
        for b in batches:
            rows = b.to_pylist()
            groups: dict[int, list[int]] = {}
            for k, r in enumerate(rows):
                groups.setdefault(len(r["v"]), []).append(k)
            out: list[tuple] = []
            for size, at in groups.items():
                if size in pivots:
                    home, there = _near(_unit([rows[k]["v"] for k in at]), pivots[size], reach)
                else:
                    home, there = np.zeros(len(at), np.int64), np.ones((len(at), 1), bool)
                for k, h, cells in zip(at, home.tolist(), there, strict=True):
                    r = rows[k]
                    for c in np.flatnonzero(cells).tolist():
                        cell = size * MOST_PIVOTS + c
                        if counts is None:
                            out.append((cell, int(c == h)))
                            continue
                        own, members = (-(-n // BLOCK) for n in counts[cell])
                        v = np.array(r["v"], "<f8").tobytes()
                        if c == h:
                            out += [(cell, r["h"] % own, j, 0, r["rep"], r["m"], v) for j in range(members)]
                        out += [(cell, i, r["h"] % members, 1, r["rep"], r["m"], v) for i in range(own)]
            names = ["cell", "home"] if counts is None else ["cell", "i", "j", "side", "rep", "m", "v"]
            kinds = [pa.int64(), pa.int32()] if counts is None else [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            for lo in range(0, len(out), 16_384):
                columns = list(zip(*out[lo : lo + 16_384], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return spread


def _joined(least: float):
    """Kind 0: links of a vector found in this tile, counting copies. Kind 1: links enough to connect what the tile connects."""

    def join(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        rep, m = t.column("rep").to_numpy(), t.column("m").to_numpy()
        x = _unit([np.frombuffer(v, "<f8") for v in t.column("v").to_pylist()])
        own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links = np.zeros(len(own), np.int64)
        ids, label = np.unique(rep, return_inverse=True)
        found = []
        y = x[other].T.copy()
        root = np.arange(len(ids))
        for lo in range(0, len(own), 256):
            part = own[lo : lo + 256]
            close = (x[part] @ y >= least) & (rep[part][:, None] != rep[other][None])
            links[lo : lo + 256] = close @ m[other]
            for k in np.flatnonzero(close.any(1)).tolist():
                a = label[part[k]]
                linked = label[other[close[k]]]
                roots, first = np.unique(root[linked], return_index=True)
                for r, b in zip(roots.tolist(), linked[first].tolist(), strict=True):
                    if r != root[a]:
                        found.append((ids[a], ids[b]))
                        root[root == r] = root[a]
        some = links > 0
        kind = np.r_[np.zeros(some.sum(), np.int32), np.ones(len(found), np.int32)]
        a = np.r_[rep[own][some], np.array([f[0] for f in found], np.int64)]
        b = np.r_[links[some], np.array([f[1] for f in found], np.int64)]
        return pa.Table.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PA_FOUND)

    return join


def near_vectors(vectors: DataFrame, least: float = 0.95, column: str = "embedding", per_pivot: int = PER_PIVOT) -> DataFrame:
    """(vec_id, n_links, component_id long, kept boolean) for each row of ``vectors`` (vec_id, ``column``).

    Two vectors link when their cosine, in double precision, is ``least`` or more. A vector that is null or empty,
    has a null or non-finite component or is zero links with nothing, as do vectors of different
    lengths with each other. Copies of one vector are joined as one and counted as many. ``n_links`` counts
    other vec_ids, ``component_id`` is the smallest vec_id reachable, ``kept`` marks that one. A null
    vec_id is returned with null in the other columns. Other columns are ignored; an empty input gives an empty
    result; rows that repeat a vec_id are one vector, of several different ones that with the smallest md5. The larger a
    cell, the more tiles it has; ``per_pivot`` vectors make a cell on average.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    keyed = vectors.withColumn("key", F.when(good & F.col("vec_id").isNotNull(), F.md5(F.col("v").cast("string").cast("binary"))))
    keys = written(keyed.where("key is not null").groupBy("vec_id").agg(F.min("key").alias("key")), "embedding-keys")
    firsts = written(keys.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "embedding-firsts")
    of = written(keys.join(firsts, "key").select("vec_id", "rep", "m"), "embedding-reps")
    heads = firsts.select(F.col("rep").alias("vec_id"), "key", "m")
    reps = keyed.where("key is not null").join(heads, ["vec_id", "key"]).select(F.col("vec_id").alias("rep"), "m", "v", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).alias("h"))
    reps = written(reps.dropDuplicates(["rep", "v"]), "embedding-vectors")

    n = reps.count()
    chosen: dict[int, list] = {}
    for r in reps.orderBy(F.xxhash64("h"), "rep").limit(min(MOST_PIVOTS, n // per_pivot + 1)).collect():
        chosen.setdefault(len(r["v"]), []).append(r["v"])
    pivots = {k: _unit(v) for k, v in chosen.items()}
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    cells = reps.mapInArrow(_assigned(pivots, reach, None), "cell long, home int").groupBy("cell").agg(F.sum("home").alias("own"), F.count("*").alias("all"))
    counts = {r["cell"]: (r["own"], r["all"]) for r in cells.collect()}
    tiles = reps.mapInArrow(_assigned(pivots, reach, counts), "cell long, i int, j int, side int, rep long, m long, v binary")
    found = written(tiles.groupBy("cell", "i", "j").applyInArrow(_joined(least), _FOUND), "embedding-found")
    links = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    roots = components(found.where("kind = 1").select("a", "b"), "embedding").withColumnRenamed("v", "rep")
    each = firsts.select("rep").distinct().join(links, "rep", "left").join(roots, "rep", "left")
    each = written(each.select("rep", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root")), "embedding-roots")
    out = of.join(each, "rep").select("vec_id", (F.col("links") + F.col("m") - 1).alias("n_links"), F.col("root").alias("component_id"))
    lone = keyed.where("key is null").select("vec_id", F.when(F.col("vec_id").isNotNull(), F.lit(0)).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(lone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_embedding_join": op4_embedding_join}
ORACLES = {
    "op4_embedding_join": """
WITH RECURSIVE u AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = e.vec_id) AS BIGINT) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = e.vec_id
"""
}
