"""Removal of repeated passages: fixed blocks as anchors, probed by every rolling window, extended to maximal exact repeats.

A window is ``window`` consecutive words of a document. Each document is cut into blocks of (window + 1) // 2 words
that don't overlap; they are the index. Wherever a window lies it holds a whole block, so of two places of one window, the
first holds a block that the second's rolling windows of that length hit. Places near a hit are the candidates: a
repeated window is one, and all windows at candidates are then counted by a hash of their whole length. Windows
that come twice or more touch or overlap in maximal repeats, whose words go.

Texts travel as chunks: compressed words of some documents in one row. A chunk sends its anchors to the buckets of their
hashes, sorted, as differences, about three bytes each; a bucket answers with a bit for each, so an answer is read against
the same anchors made anew. A passage that stands in any number of documents is one entry of each chunk at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import shuffle_partitions, small_batches, table, written
from ._text import mixed, windows, word_hashes, words

#: Words of a window: a repeat that goes has as many at least.
WINDOW = 35
#: Words of a chunk; a longer document is a chunk of its own.
CHUNK_WORDS = 1 << 19
#: Anchors of a bucket, on average.
BUCKET = 1 << 22

_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _packed(values: np.ndarray) -> bytes:
    """Ascending values as differences, their bytes parted by significance, compressed."""
    d = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, d.itemsize).T).tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1), dtype=kind)


class Chunk:
    """Words of some documents, one after another."""

    def __init__(self, body: bytes, sizes: np.ndarray, window: int):
        self.words = zstandard.decompress(body).split(b" ") if sizes.sum() else []
        self.sizes, self.window, self.block = sizes, window, (window + 1) // 2
        n = len(self.words)
        ends = np.cumsum(sizes)
        self.starts = ends - sizes
        at = np.arange(n)
        inside, left = at - np.repeat(self.starts, sizes), np.repeat(ends, sizes) - at
        b = min(self.block, n)
        #: A hash of the block that starts at each word, for those with enough words after them.
        self.hashes = windows(word_hashes(self.words), b) if n >= self.block else np.zeros(0, np.uint64)
        m = len(self.hashes)
        self.probe = ((left >= self.block) & (np.repeat(sizes, sizes) >= window))[:m]
        self.aligned = self.probe & (inside % self.block == 0)[:m]
        self.whole = (left >= window)[:m]

    def anchors(self, buckets: int) -> Anchors:
        at = np.flatnonzero(self.probe)
        h = self.hashes[at]
        return Anchors(at, (h >> _HALF) % np.uint64(buckets) << _HALF | (h & _LOW), self.aligned[at])

    def candidates(self, buckets: int, answers: list[dict]) -> np.ndarray:
        """Places of windows near an anchor that stands elsewhere too."""
        hit = np.zeros(len(self.hashes) + 1, np.int64)
        hit[1:][self.anchors(buckets).alive(answers)] = 1
        until = np.cumsum(hit)
        at = np.flatnonzero(self.whole)
        # The anchors of a window start at its first window - block + 1 words.
        return at[until[at + self.window - self.block + 1] > until[at]]

    def window_keys(self, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and hash of the windows at some places, from the hashes of the blocks at both of their ends."""
        first, last = self.hashes[at], self.hashes[at + self.window - self.block]
        return first % np.uint64(buckets), mixed(first * _ODD + last)


class Anchors:
    """Distinct keys (bucket and 32 bits) at some places of a chunk, ascending, and whether a block has them."""

    def __init__(self, at: np.ndarray, keys: np.ndarray, aligned: np.ndarray):
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        self.at, self.keys, self.n = at[order], keys[first], np.diff(first, append=len(keys))
        self.indexed = np.logical_or.reduceat(aligned[order], first) if len(first) else np.zeros(0, bool)

    def alive(self, answers: list[dict]) -> np.ndarray:
        """Places whose key comes twice here and is a block's, or is said to stand elsewhere."""
        alive = self.indexed & (self.n > 1)
        kinds = [np.flatnonzero(self.indexed), np.flatnonzero(~self.indexed)]
        slices = [_slices(self.keys[k]) for k in kinds]
        for a in answers:
            own = np.concatenate([k[s.get(a["bucket"], slice(0, 0))] for k, s in zip(kinds, slices, strict=True)])
            alive[own] |= _bits(a["bits"], len(own))
        return self.at[np.repeat(alive, self.n)]


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _distinct(bucket: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, how often each comes, and the order that brings equal ones together."""
    order = np.lexsort((h, bucket))
    bucket, h = bucket[order], h[order]
    first = np.flatnonzero((np.diff(bucket, prepend=~bucket[:1]) != 0) | (np.diff(h, prepend=~h[:1]) != 0))
    return bucket[first], h[first], np.diff(first, append=len(h)), order


def _chunks(docs: DataFrame, chunk_words: int) -> DataFrame:
    """Rows (chunk, doc_ids, sizes, body): compressed words of documents up to ``chunk_words`` words, or of a longer one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        ids, sizes, body, n, k = [], [], [], 0, TaskContext.get().partitionId() << 32

        def row():
            flat = pa.concat_arrays(ids)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (flat, pa.array(sizes, pa.int32()))]
            data = zstandard.compress(b" ".join(b" ".join(w) for w in body if w), 3)
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *lists, pa.array([data], pa.binary())], names=["chunk", "doc_ids", "sizes", "body"])

        for b in batches:
            doc_ids = b.column("doc_id")
            for i, text in enumerate(b.column("text")):
                w = words(text.as_py())
                if ids and n + len(w) > chunk_words:
                    yield row()
                    ids, sizes, body, n, k = [], [], [], 0, k + 1
                ids.append(doc_ids.slice(i, 1))
                sizes.append(len(w))
                body.append(w)
                n += len(w)
        if ids:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(cut, f"chunk long, doc_ids array<{kind}>, sizes array<int>, body binary")


def _each(b: pa.RecordBatch, window: int):
    for i in range(b.num_rows):
        yield i, Chunk(b.column("body")[i].as_py(), b.column("sizes")[i].values.to_numpy(zero_copy_only=False).astype(np.int64), window)


def _slices(keys: np.ndarray) -> dict[int, slice]:
    """Where each bucket's keys stand in ascending ones."""
    of, first = np.unique(keys >> _HALF, return_index=True)
    return {k: slice(lo, hi) for k, lo, hi in zip(of.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=False)}


def _sent_anchors(window: int, buckets: int):
    """Of each chunk and bucket: blocks and other probes, 32 bits each."""

    def sent(batches):
        for b in batches:
            for i, chunk in _each(b, window):
                anchors = chunk.anchors(buckets)
                keys = [anchors.keys[k] for k in (anchors.indexed, ~anchors.indexed)]
                at = [_slices(x) for x in keys]
                low = [(x & _LOW).astype(np.uint32) for x in keys]
                of = sorted(at[0].keys() | at[1].keys())
                data = [[_packed(x[s.get(k, slice(0, 0))]) for k in of] for x, s in zip(low, at, strict=True)]
                yield _rows(of, b.column("chunk")[i].as_py(), {"blocks": data[0], "probes": data[1]})

    return sent


def _rows(buckets: list[int], chunk: int, data: dict[str, list[bytes]]) -> pa.RecordBatch:
    columns = [pa.array(buckets, pa.int64()), pa.array([chunk] * len(buckets), pa.int64()), *[pa.array(x, pa.binary()) for x in data.values()]]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", *data])


def _answered(t: pa.Table, values: list[np.ndarray], indexed: np.ndarray | None = None) -> pa.Table:
    """A bit for each value of each row: whether another row has it too, and, with ``indexed``, any row has it as a block."""
    all_ = np.concatenate(values)
    _, of, n = np.unique(all_, return_inverse=True, return_counts=True)
    alive = n > 1
    if indexed is not None:
        held = np.zeros(len(n), bool)
        held[of[indexed]] = True
        alive &= held
    bits = np.split(alive[of], np.cumsum([len(x) for x in values])[:-1])
    return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "bits": pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())})


def _answer_anchors(t: pa.Table) -> pa.Table:
    blocks, probes = ([_unpacked(x, np.uint32) for x in t[c].to_pylist()] for c in ("blocks", "probes"))
    indexed = np.concatenate([np.arange(len(x) + len(y)) < len(x) for x, y in zip(blocks, probes, strict=True)])
    return _answered(t, [np.concatenate(xy) for xy in zip(blocks, probes, strict=True)], indexed)


def _answer_windows(t: pa.Table) -> pa.Table:
    return _answered(t, [_unpacked(x, np.uint64) for x in t["hashes"].to_pylist()])


def _sent_windows(window: int, buckets: int):
    """Of each chunk and bucket: hashes of its windows near an anchor that stands elsewhere too."""

    def sent(batches):
        for b in batches:
            for i, chunk in _each(b, window):
                at = chunk.candidates(buckets, b.column("anchors")[i].as_py() or [])
                bucket, h, _, _ = _distinct(*chunk.window_keys(at, buckets))
                of, first = np.unique(bucket, return_index=True)
                data = [_packed(h[lo:hi]) for lo, hi in zip(first, [*first[1:], len(h)], strict=False)]
                yield _rows(of.tolist(), b.column("chunk")[i].as_py(), {"hashes": data})

    return sent


def _repeated(chunk: Chunk, buckets: int, anchors: list[dict], answers: list[dict]) -> np.ndarray:
    """Whether each word is in a window that stands elsewhere too."""
    at = chunk.candidates(buckets, anchors)
    bucket, _, n, order = _distinct(*chunk.window_keys(at, buckets))
    twice = n > 1
    for a in answers:
        lo, hi = np.searchsorted(bucket, np.array([a["bucket"], a["bucket"] + 1], np.uint64))
        twice[lo:hi] |= _bits(a["bits"], hi - lo)
    at = at[order[np.repeat(twice, n)]]
    step = np.zeros(len(chunk.words) + 1, np.int64)
    step[at] = 1  # each place comes once
    step[at + chunk.window] -= 1
    return np.cumsum(step)[:-1] > 0


def _spans(gone: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    return [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]


def _without_repeats(window: int, buckets: int, id_type: pa.DataType):
    def kept(batches):
        for b in batches:
            for i, chunk in _each(b, window):
                gone = _repeated(chunk, buckets, b.column("anchors")[i].as_py() or [], b.column("answers")[i].as_py() or [])
                rows = []
                for lo, n in zip(chunk.starts.tolist(), chunk.sizes.tolist(), strict=True):
                    own, w = gone[lo : lo + n], chunk.words[lo : lo + n]
                    removed = int(own.sum())
                    left = [w[k] for k in np.flatnonzero(~own)] if removed else w
                    rows.append((n, removed, _spans(own) if removed else [], b" ".join(left)))
                n, removed, spans, texts = zip(*rows, strict=True)
                columns = [b.column("doc_ids")[i].values.cast(id_type), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "spans", "text"])

    return kept


def without_repeats(docs: DataFrame, window: int = WINDOW, chunk_words: int = CHUNK_WORDS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_words, n_removed, spans - array of (start, end) in words, text - the words kept, joined by a space).

    Words ``[^\\x20\\x09-\\x0D]+`` of whole texts, unchanged. A word goes if it is in a window of ``window`` words of its
    document whose words also start anywhere else, in another document, row or in the same one, also overlapping it;
    windows are judged on the input, so no place of a repeat stays. Equal texts, repeated rows and rows of one doc_id are
    separate places. Texts that are null, empty or shorter than a window lose nothing. One row for each row of
    ``docs``; a null doc_id stays null, other columns are not read, an empty input gives an empty result.

    Windows are equal if 64 bits of hash and their bucket are. Chunks that read like ``chunk_words`` words and buckets of
    about ``bucket`` anchors bound each task's memory, whatever is repeated how often.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chunks = written(_chunks(docs, chunk_words), "repeats-chunks")
    total = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, n: s + n))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), math.ceil(total / bucket))
    answer = "chunk long, bucket long, bits binary"
    by_chunk = lambda rows, name: rows.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))

    sent = chunks.mapInArrow(_sent_anchors(window, buckets), "bucket long, chunk long, blocks binary, probes binary")
    anchors = written(sent.groupBy("bucket").applyInArrow(_answer_anchors, answer), "repeats-anchors")
    met = chunks.join(by_chunk(anchors, "anchors"), "chunk", "left")
    sent = met.mapInArrow(_sent_windows(window, buckets), "bucket long, chunk long, hashes binary")
    answers = written(sent.groupBy("bucket").applyInArrow(_answer_windows, answer), "repeats-windows")
    met = met.join(by_chunk(answers, "answers"), "chunk", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_words long, n_removed long, spans array<struct<start:bigint,end:bigint>>, text string"
    return met.mapInArrow(_without_repeats(window, buckets, to_arrow_type(docs.schema["doc_id"].dataType)), out)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 35 words or more that stand elsewhere too."""
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.size("spans").alias("n_spans"))


QUERIES = {"op13_substring_dedup": op13_substring_dedup}
ORACLES: dict[str, str] = {}
