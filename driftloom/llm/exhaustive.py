"""The packing search over all rests of a corpus: exact, for corpora whose rests' lengths the driver can hold.

In rounds, the seeds of a round are scored against every unused rest, the best of all shards are merged, and the
windows are filled one after another. A seed whose best have been taken by windows of the same round waits for the
next one, so each window holds the best rests that were unused. Work grows with the square of the number of rests.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing
from ._common import scratch, written

#: Neighbours that a round finds for all its seeds together, and for one of them at first.
ROUND_NEIGHBOURS, FIRST_NEIGHBOURS = 1 << 18, 32
#: Seeds that are scored at a time.
SEEDS = 256


def scores_of(index: packing.Index, queries: list[np.ndarray]) -> np.ndarray:
    """``index.scores`` of several queries, a row each."""
    out, often = np.zeros((len(queries), index.n), np.float32), np.zeros((len(queries), len(index._many)), np.float32)
    for k, terms in enumerate(queries):
        rows = index._row[terms]
        often[k, rows[rows >= 0]] = 1
        terms = terms[rows < 0].astype(np.int64)
        lo = index._at[terms]
        n = index._at[terms + 1] - lo
        if n.sum():
            at = np.arange(n.sum()) + np.repeat(lo - n.cumsum() + n, n)
            out[k] = np.bincount(index._doc[at], index._weight[at], index.n)
    return out + often @ index._many


def _highest(keys: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` highest keys of each row, in any order."""
    return keys if keys.shape[1] <= most else np.partition(keys, keys.shape[1] - most, axis=1)[:, -most:]


_LOW = (1 << 32) - 1


def _split(ids: bytes, lengths: bytes) -> list[np.ndarray]:
    ends = np.cumsum(np.frombuffer(lengths, "<u4"))
    return np.split(np.frombuffer(ids, "<u2"), ends[:-1])


def _found(held: DataFrame, first: dict[int, int], left: np.ndarray, seeds: np.ndarray, most: int, idf, n: int, mean: float) -> np.ndarray:
    """The ``most`` best unused rests for each seed, of all shards: a row of keys each, best first, -1 where there are no more.

    A key is the score in thousandths and, below it, how far the rest lies behind the seed: seeds with equal
    neighbours begin with different ones.
    """
    context = held.sparkSession.sparkContext
    sent = context.broadcast((first, seeds))

    def terms(batches):
        first, seeds = sent.value
        for b in batches:
            out = []
            for shard, ids, lengths in zip(*(b.column(c).to_pylist() for c in ("shard", "ids", "lengths")), strict=True):
                lo, size = first[shard], len(lengths) // 4
                mine = np.flatnonzero((seeds >= lo) & (seeds < lo + size))
                if len(mine):
                    rests = _split(ids, lengths)
                    out += [(k, packing._distinct(rests[seeds[k] - lo])[0].tobytes()) for k in mine.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.binary()))], names=["seed", "terms"])

    queries: list = [None] * len(seeds)
    for r in held.mapInArrow(terms, "seed long, terms binary").collect():  # the seeds of a round bound them
        queries[r["seed"]] = np.frombuffer(r["terms"], "<u2")
    asked = context.broadcast((left, queries))

    def search(batches):
        (first, seeds), (left, queries) = sent.value, asked.value
        best = np.full((len(seeds), most), -1, np.int64)
        for b in batches:
            for shard, ids, lengths in zip(*(b.column(c).to_pylist() for c in ("shard", "ids", "lengths")), strict=True):
                lo, size = first[shard], len(lengths) // 4
                free = np.flatnonzero(left[lo : lo + size])
                if not len(free):
                    continue
                rests = _split(ids, lengths)
                index = packing.Index([rests[k] for k in free.tolist()], idf.value, mean)
                for k in range(0, len(seeds), SEEDS):
                    behind = (lo + free[None] - seeds[k : k + SEEDS, None]) % n
                    keys = (np.rint(1000.0 * scores_of(index, queries[k : k + SEEDS])).astype(np.int64) << 32) | (_LOW - behind)
                    keys[behind == 0] = -1  # the seed itself
                    best[k : k + SEEDS] = _highest(np.hstack([best[k : k + SEEDS], keys]), most)
        for k in range(0, len(seeds), SEEDS):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([best[k : k + SEEDS].tobytes()], pa.binary())], names=["at", "keys"])

    def merged(t: pa.Table) -> pa.Table:
        best = None
        for x in t.column("keys").to_pylist():
            x = np.frombuffer(x, np.int64).reshape(-1, most)
            best = x if best is None else _highest(np.hstack([best, x]), most)
        return pa.table({"at": pa.array(t.column("at")[:1].to_pylist(), pa.int64()), "keys": pa.array([best.tobytes()], pa.binary())})

    out = np.full((len(seeds), most), -1, np.int64)
    for r in held.mapInArrow(search, "at long, keys binary").groupBy("at").applyInArrow(merged, "at long, keys binary").collect():
        out[r["at"] : r["at"] + SEEDS] = np.frombuffer(r["keys"], np.int64).reshape(-1, most)
    sent.unpersist()
    asked.unpersist()
    return -np.sort(-out, axis=1)


def packed_by_rounds(lengths: np.ndarray, found, window: int, neighbours: int = ROUND_NEIGHBOURS, each: int = FIRST_NEIGHBOURS):
    """Windows as in ``packed``, a list for each round: ``found(left, seeds, most)`` gives the seeds' best unused rests.

    The first seed of a round finds its neighbours as they are; a later one waits if those that it found are used
    up before its window is full. Where many wait, the next round has fewer seeds and finds more for each.
    """
    n = len(lengths)
    left, used = lengths.astype(np.int32), np.zeros(n, np.int32)
    order, cut = np.argsort(-left, kind="stable"), []
    while True:
        order = order[left[order] > 0]
        if not len(order):
            return
        cut = [k for k in dict.fromkeys(reversed(cut)) if left[k]]
        seeds = np.array(list(dict.fromkeys(cut + order[: neighbours // each].tolist()))[: max(1, neighbours // each)], np.int64)
        keys = found(left, seeds, each)
        round_, tried = [], 0
        for seed, row in zip(seeds.tolist(), keys, strict=True):
            if not left[seed]:
                continue
            tried += 1
            row = row[row >= 0]
            room, pieces = window - int(left[seed]), [(seed, int(left[seed]))]
            for k in ((seed + _LOW - (row & _LOW)) % n).tolist() if room else ():
                take = min(room, int(left[k]))
                if take:
                    pieces.append((k, take))
                    room -= take
                    if not room:
                        break
            if room and len(row) == each:
                continue  # there may be more
            for k, take in pieces:
                left[k] -= take
                used[k] += take
            if left[pieces[-1][0]]:
                cut.append(pieces[-1][0])
            round_.append([(k, int(used[k]) - take, take) for k, take in pieces])
        if 2 * len(round_) < tried:
            each = min(each * 4, max(window, FIRST_NEIGHBOURS))
        elif 10 * len(round_) > 9 * tried:
            each = max(each // 2, FIRST_NEIGHBOURS)
        yield round_


_HELD = "shard int, ids binary, lengths binary, doc_id array<long>, row array<long>, start array<long>, doc_tokens array<long>"
_PA_PLACE = pa.schema([("shard", pa.int32()), ("rest", pa.int32()), *((c, pa.int64()) for c in ("used", "length", "sequence_id", "offset"))])


def pack_all(rests: DataFrame, idf, n: int, mean: float, shards: int, window: int) -> DataFrame:
    """Pieces of all rests, each window from the best unused rests of all shards.

    The driver holds the lengths of all rests (8 bytes each) and a round's neighbours; ids stay in the shards.
    """
    spark = rests.sparkSession

    def gathered(t: pa.Table) -> pa.Table:
        t = t.sort_by([("row", "ascending")])
        ids = t.column("ids").to_pylist()
        whole = [t.column("shard")[0].as_py(), b"".join(ids), np.array([len(x) // 2 for x in ids], "<u4").tobytes()]
        whole += [t.column(c).to_pylist() for c in ("doc_id", "row", "start", "doc_tokens")]
        kinds = (pa.int32(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 4)
        return pa.Table.from_arrays([pa.array([x], k) for x, k in zip(whole, kinds, strict=True)], names=[c.split()[0] for c in _HELD.split(", ")])

    dealt = rests.select("shard", "doc_id", "row", "start", "doc_tokens", "ids").repartition(min(shards, 4 * spark.sparkContext.defaultParallelism), "shard")
    held = written(dealt.groupBy("shard").applyInArrow(gathered, _HELD), "packing-shards")
    lengths, first, at = [], {}, 0
    for r in held.select("shard", "lengths").orderBy("shard").collect():
        first[r["shard"]] = at
        lengths.append(np.frombuffer(r["lengths"], "<u4"))
        at += len(lengths[-1])
    shard_of, starts = np.array(list(first), np.int32), np.array(list(first.values()), np.int64)
    search = held.select("shard", "ids", "lengths")
    path, sequence = f"{scratch(spark)}/driftloom-packing-places-{uuid.uuid4().hex}", 0
    for windows in packed_by_rounds(np.concatenate(lengths), lambda left, seeds, most: _found(search, first, left, seeds, most, idf, n, mean), window):
        places = []
        for pieces in windows:
            sequence, offset = sequence - 1, 0
            for rest, used, length in pieces:
                k = int(np.searchsorted(starts, rest, "right")) - 1
                places.append((int(shard_of[k]), rest - int(starts[k]), used, length, sequence, offset))
                offset += length
        if places:
            spark.createDataFrame(pa.Table.from_batches([packing._table(places, _PA_PLACE)])).coalesce(1).write.mode("append").parquet(path)
    places = spark.read.parquet(path)

    def pieces(held: pa.Table, places: pa.Table) -> pa.Table:
        r = {c: held.column(c)[0].as_py() for c in held.column_names}
        ids, out = _split(r["ids"], r["lengths"]), []
        for p in places.to_pylist():
            k, used, length = p["rest"], p["used"], p["length"]
            crc = packing._crc(ids[k][used : used + length])
            out.append((r["doc_id"][k], r["start"][k] + used, length, crc, r["doc_tokens"][k], p["sequence_id"], p["offset"], r["row"][k]))
        return pa.Table.from_batches([packing._table(out, packing._PA_PIECE)])

    return held.groupBy("shard").cogroup(places.groupBy("shard")).applyInArrow(pieces, packing._PIECE)
