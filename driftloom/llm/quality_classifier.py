"""Quality scores: random-indexing word vectors, pooled per document, and a calibrated two-layer network.

Words fall into hash buckets. Each bucket has a sparse random index vector, and a context vector: the sum of the index
vectors of the words around its words, over all documents of the corpus. A bounded sample of labelled documents
teaches the network alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded, crc32_mod, fresh, small_batches, table, texts_of
from ._text import mixed

#: Buckets of words, components of a vector, and how many of an index vector are set.
BUCKETS, DIMENSIONS, SET = 1 << 15, 64, 6
#: Labelled documents that are learned from, at most.
MOST_DOCUMENTS = 3000
#: Neighbours on each side whose index vectors a word's vector adds up.
CONTEXT = 2
#: Buckets of a row in which a task hands on its sums; tasks whose sums are added up at first.
ROWS, TOGETHER = 512, 32
#: Partitions of the input that one task reads at most.
READ = 32
#: Characters of a text that are hashed at a time, about.
STRETCH = 1 << 18
#: Words whose pairs are counted at a time; and pairs that are added up at a time.
COUNTED, ADDED = 1 << 21, 1 << 19

_STEP = np.uint64(0x9E3779B97F4A7C15)


#: Of each code point: 0 white space, 1 letter, 2 decimal digit, 3 a word by itself; 255: not met yet.
_kinds = np.full(0x110000, 255, np.uint8)


def _kinds_of(codes: np.ndarray) -> np.ndarray:
    kinds = _kinds[codes]
    if (new := kinds == 255).any():
        for code in np.unique(codes[new]).tolist():
            c = chr(code)
            _kinds[code] = 0 if c.isspace() else 2 if c.isdecimal() else 1 if c.isalnum() else 3
        kinds = _kinds[codes]
    return kinds


def _stretch_buckets(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds_of(codes)
    first = (kinds != 0) & ((kinds == 3) | (np.r_[np.uint8(0), kinds[:-1]] != kinds))
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.int32)
    place = np.arange(starts[0], len(codes)) - np.repeat(starts, np.diff(starts, append=len(codes)))
    powers = np.cumprod(np.r_[np.uint64(1), np.full(place.max(), _STEP)])
    each = (codes[starts[0] :] + np.uint64(1)) * powers[place] * (kinds[starts[0] :] != 0)
    return (mixed(np.add.reduceat(each, starts - starts[0])) & np.uint64(BUCKETS - 1)).astype(np.int32)


def buckets_of(text: str | None) -> np.ndarray:
    """Buckets of a text's words: runs of letters, runs of decimal digits, and each other character but white space by itself.

    Words are hashed in arrays, as most of a corpus' words are seldom; long texts are cut at blanks.
    """
    text, parts, at = text or "", [], 0
    while 0 <= at < len(text):
        end = text.find(" ", at + STRETCH)
        parts.append(_stretch_buckets(text[at:end] if end >= 0 else text[at:]))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def index_places() -> np.ndarray:
    """Which components of each bucket's index vector are set, half of them to 1 and half to -1."""
    return np.random.default_rng(10).random((BUCKETS, DIMENSIONS)).argsort(1)[:, :SET].astype(np.int64)


def index_signs(places: np.ndarray) -> np.ndarray:
    """The index vectors' components as 1, -1 and 0."""
    out = np.zeros((BUCKETS, DIMENSIONS), np.int32)
    np.put_along_axis(out, places, np.where(np.arange(SET) % 2, -1, 1).astype(np.int32), 1)
    return out


def index_vectors(places: np.ndarray) -> np.ndarray:
    return index_signs(places).astype(np.float32) / np.float32(np.sqrt(SET))


def add_contexts(sums: np.ndarray, ids: np.ndarray, signs: np.ndarray) -> None:
    """Adds the signs of the index vectors of the words around each word to its bucket's row; -1 parts documents.

    Pairs of buckets are counted first; then each pair adds what is set of the one's vector to the other's row, both ways.
    """
    places = np.nonzero(signs)[1].reshape(len(signs), -1)
    values = np.take_along_axis(signs, places, 1).astype(np.float64)
    pairs = []
    for d in range(1, CONTEXT + 1):
        a, b = ids[:-d].astype(np.int64), ids[d:].astype(np.int64)
        near = (a >= 0) & (b >= 0)
        if d > 1:
            near &= ids[1:-1] >= 0
        pairs.append(a[near] * BUCKETS + b[near])
    pairs, n = np.unique(np.concatenate(pairs), return_counts=True)
    flat = sums.reshape(-1)
    for lo in range(0, len(pairs), ADDED):
        some = np.divmod(pairs[lo : lo + ADDED], BUCKETS)
        for word, other in (some, some[::-1]):
            at = word[:, None] * sums.shape[1] + places[other]
            # Sums of whole numbers below 2 ** 53 are exact.
            flat += np.bincount(at.ravel(), (values[other] * n[lo : lo + ADDED, None]).ravel(), len(flat)).astype(np.int64)


def _summed(t: pa.Table) -> pa.Table:
    out = sum(np.frombuffer(x, "<i8") for x in t.column("sums").to_pylist())
    n = sum(np.frombuffer(x, "<i8") for x in t.column("n").to_pylist())
    return pa.table({"row": t.column("row")[:1].cast(pa.int32()), "part": t.column("part")[:1].cast(pa.int32()), "sums": pa.array([out.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A unit context vector for each bucket (zeros where none of its words stands), and how often its words stand, over all documents.

    Every task adds up its own documents in one table of fixed size; the tables are added up in two steps, some
    tasks at a time. What comes to the driver has the size of one table.
    """
    spark = docs.sparkSession

    def gathered(batches):
        signs, sums, n = index_signs(index_places()), np.zeros((BUCKETS, DIMENSIONS), np.int64), np.zeros(BUCKETS, np.int64)
        apart = np.array([-1], np.int32)

        def add(parts: list[np.ndarray]) -> None:
            ids = np.concatenate([apart, *parts])
            n[:] += np.bincount(ids[ids >= 0], minlength=BUCKETS)
            add_contexts(sums, ids, signs)

        parts, held = [], 0
        for b in batches:
            for text in b.column("text").to_pylist():
                parts += [buckets_of(text), apart]
                held += len(parts[-2])
                if held >= COUNTED:
                    add(parts)
                    parts, held = [], 0
        add(parts)
        part = TaskContext.get().partitionId() % TOGETHER
        for row in range(BUCKETS // ROWS):
            some = slice(row * ROWS, (row + 1) * ROWS)
            if n[some].any():
                columns = [pa.array([row], pa.int32()), pa.array([part], pa.int32()), pa.array([sums[some].astype("<i8").tobytes()], pa.binary()), pa.array([n[some].astype("<i8").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "part", "sums", "n"])

    small_batches(spark)
    kind = "row int, part int, sums binary, n binary"
    # A task's table has a fixed size, so there are not many more tasks than can run, but never more than ``READ`` partitions
    # in one of them, however few executors run at first.
    texts = docs.select("text")
    parts = texts.rdd.getNumPartitions()
    texts = texts.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-parts // READ)))
    found = texts.mapInArrow(gathered, kind).groupBy("row", "part").applyInArrow(_summed, kind).groupBy("row").applyInArrow(_summed, kind)
    vectors, counts = np.zeros((BUCKETS, DIMENSIONS)), np.zeros(BUCKETS, np.int64)
    for r in found.collect():
        some = slice(r["row"] * ROWS, (r["row"] + 1) * ROWS)
        vectors[some] = np.frombuffer(r["sums"], "<i8").reshape(-1, DIMENSIONS)
        counts[some] = np.frombuffer(r["n"], "<i8")
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
    return vectors.astype(np.float32), counts


class Model:
    """Word vectors, the network over pooled vectors, and its temperature."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.both = np.hstack([words, index_vectors(index_places())])
        self.rarity = np.log1p(counts.max() / (counts + 1.0)).astype(np.float32) / 10 if counts.any() else np.zeros(BUCKETS, np.float32)

    def pooled(self, text: str | None) -> np.ndarray:
        """Mean word vector, mean index vector's size by part, how rare the words are and how many; zeros for no word."""
        ids = buckets_of(text)
        out = np.zeros(2 * DIMENSIONS + 3, np.float32)
        if len(ids):
            seen, n = np.unique(ids, return_counts=True)
            share = (n / len(ids)).astype(np.float32)
            for lo in range(0, len(seen), 8192):
                out[: 2 * DIMENSIONS] += share[lo : lo + 8192] @ self.both.take(seen[lo : lo + 8192], 0)
            mean = out[DIMENSIONS : 2 * DIMENSIONS]
            out[-3:] = np.linalg.norm(mean), share @ self.rarity[seen], np.log1p(len(ids)) / 10
            out[DIMENSIONS : 2 * DIMENSIONS] = np.abs(mean)
        return out

    def fit(self, x: np.ndarray, labels: list[int], seed: int = 10) -> Model:
        """Learns from pooled vectors and their labels, 0 or 1."""
        self._fit(x.astype(np.float64), np.array(labels, np.float64), np.random.default_rng(seed))
        return self

    def _fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, hidden: int = 32, steps: int = 500) -> None:
        d = x.shape[1]
        self.mean = x.mean(0) if len(x) else np.zeros(d)
        self.scale = x.std(0) + 1e-3 if len(x) else np.ones(d)
        self.temperature = 1.0
        p = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.net = p
        if len(set(y.tolist())) < 2:  # one class or none: its share, smoothed
            share = (y.sum() + 1) / (len(y) + 2)
            self.net = [p[0] * 0, p[1], p[2] * 0, np.array([np.log(share / (1 - share))])]
            return
        x = (x - self.mean) / self.scale
        held = rng.random(len(x)) < 0.2
        tx, ty = (x[~held], y[~held]) if 0 < y[~held].sum() < (~held).sum() else (x, y)
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for k in range(1, steps + 1):
            h = np.tanh(tx @ p[0] + p[1])
            g = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - ty) / len(ty)
            gh = np.outer(g, p[2]) * (1 - h * h)
            grads = [tx.T @ gh + 1e-3 * p[0], gh.sum(0), h.T @ g + 1e-3 * p[2], np.array([g.sum()])]
            for a, grad, i in zip(p, grads, range(4), strict=True):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                a -= 0.01 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
        if held.any():
            z, t = self._logits(x[held]), y[held]
            loss = lambda s: np.logaddexp(0, np.where(t > 0, -z, z) / s).mean()
            self.temperature = float(min(np.geomspace(0.25, 8, 80), key=loss))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.net[0] + self.net[1]) @ self.net[2] + self.net[3]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = (np.stack([self.pooled(t) for t in texts]) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self._logits(x) / self.temperature, -50, 50)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_DOCUMENTS, seed: int = 10) -> Model:
    """Word vectors of all ``docs``; the network learns from ``most`` labelled documents at most, chosen by a hash of doc_id,
    of which the driver gets the pooled vectors. Null labels teach nothing."""
    model = Model(*word_vectors(docs))
    (name,) = fresh(docs, "label")
    labels = labels.select("doc_id", F.col(label).cast("int").alias(name)).where(F.col("doc_id").isNotNull() & F.col(name).isNotNull())
    labels = bounded(labels.groupBy("doc_id").agg(F.max(name).alias(name)), most, seed)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def pooled(batches):
        for b in batches:
            made = [sent.value.pooled(t).astype("<f4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(name), b.column("place"), pa.array(made, pa.binary())], names=["label", "place", "x"])

    some = texts_of(docs.select("doc_id", "text"), labels).select("text", name, F.xxhash64("doc_id", "text").alias("place"))
    # A doc_id may stand in many rows: of those, the first by a hash.
    rows = some.mapInArrow(pooled, "label int, place long, x binary").orderBy("place").limit(2 * most).collect()
    rows.sort(key=lambda r: (r["place"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], "<f4") for r in rows]) if rows else np.zeros((0, 2 * DIMENSIONS + 3))
    return model.fit(x, [int(r["label"] > 0) for r in rows], seed)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score double): how likely label 1 is for each whole text. Null and empty texts get the score of
    no words, very long texts are pooled whole. Other columns are not read; equal rows get equal scores; an empty input gives an empty result."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two vectors a bucket

    def predict(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            s = sent.value.scores(texts) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents that score ``least`` or more. All columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(sent.value.scores(b.column("text").to_pylist()) >= least, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; learned from labels where crc32(doc_id) mod 3 is not 1. A row without doc_id is not held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels").where(crc32_mod("doc_id", 3) != 1))
    return score(docs, model).select(
        "doc_id", F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLES: dict[str, str] = {}
