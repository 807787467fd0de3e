"""Language identification by hyperdimensional letter n-gram profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import crc32_mod, discard, small_batches, table, written

#: Components of a vector; letters of an n-gram.
DIMENSIONS, WIDTH = 1024, 3
#: Documents of each label that its prototype is learned from, at most.
MOST_DOCUMENTS = 1024
#: Standard deviations below the mean likeness of a language's own documents of like length from which on a text is in none.
DEVIATIONS = 4.0
#: Documents of a language and length that make a mean of their own; of fewer, the language's counts.
ENOUGH = 16
#: n-gram vectors that a worker keeps, at most.
KEPT = 40_000
UNKNOWN = "und"

_SPACE = 32


class Encoder:
    """Bundles the n-gram vectors of a text: each binds its letters' random vectors, permuted by place."""

    def __init__(self, dimensions: int = DIMENSIONS, width: int = WIDTH, seed: int = 9):
        self.dimensions, self.width, self.seed = dimensions, width, seed
        self._rows: dict[int, int] = {}
        self._letters: dict[int, np.ndarray] = {}
        self._kept = np.zeros((KEPT, dimensions), np.int8)
        self._alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def _letter(self, c: int) -> np.ndarray:
        if c not in self._letters:
            if len(self._letters) > 4096:
                self._letters.clear()
            self._letters[c] = np.random.default_rng((self.seed, c)).integers(0, 2, self.dimensions, np.int8) * np.int8(2) - np.int8(1)
        return self._letters[c]

    def _gram(self, gram: int) -> np.ndarray:
        out = np.ones(self.dimensions, np.int8)
        for k in range(self.width):
            out = out * np.roll(self._letter((gram >> (21 * k)) & 0x1FFFFF), k)
        return out

    def letters(self, text: str | None) -> np.ndarray:
        """Code points of the lower-cased text, each run of anything but letters as one space."""
        if not text:
            return np.zeros(0, np.uint64)
        c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
        c = np.where(self._alpha[c], c, _SPACE).astype(np.uint64)
        if not (c != _SPACE).any():
            return np.zeros(0, np.uint64)
        c = np.r_[np.uint64(_SPACE), c, np.uint64(_SPACE)]
        return c[np.r_[True, (c[1:] != _SPACE) | (c[:-1] != _SPACE)]]

    def __call__(self, text: str | None) -> np.ndarray | None:
        """The bundle, or None for a text without a letter."""
        c = self.letters(text)
        if not len(c):
            return None
        n = max(1, len(c) - self.width + 1)
        grams = np.zeros(n, np.uint64)
        for k in range(self.width):
            grams |= c[k : k + n] << np.uint64(21 * k)
        grams, counts = np.unique(grams, return_counts=True)
        out, at, new = np.zeros(self.dimensions, np.float32), [], []
        for g in grams.tolist():
            row = self._rows.get(g)
            if row is None and len(self._rows) < KEPT:
                row = self._rows[g] = len(self._rows)
                self._kept[row] = self._gram(g)
            at.append(-1 if row is None else row)
            new.append(g)
        at, counts = np.array(at), counts.astype(np.float32)
        known = at >= 0
        for lo in range(0, int(known.sum()), 4096):
            out += counts[known][lo : lo + 4096] @ self._kept[at[known][lo : lo + 4096]].astype(np.float32)
        for g, n_g in zip(np.array(new, np.uint64)[~known].tolist(), counts[~known], strict=True):
            out += n_g * self._gram(g)
        return out


_encoders: dict[tuple, Encoder] = {}


def _encoder(*key) -> Encoder:
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


class Prototypes(dict):
    """A unit vector for each label; ``likeness`` has the mean and the standard deviation of its own documents' cosines to
    it, by label and size (the bit length of a text's bytes), as short texts hold few n-grams; and by label for all sizes (None)."""

    likeness: dict[tuple[str, int | None], tuple[float, float]] = {}

    def bar(self, label: str, text: str, deviations: float) -> float:
        """The cosine from which on a text counts as one of the label's."""
        mean, sd = self.likeness.get((label, _size(text))) or self.likeness.get((label, None), (2.0, 0.0))
        return mean - deviations * sd


def _size(text: str) -> int:
    return len(text.encode("utf-8", "replace")).bit_length()


def learn(docs: DataFrame, label: str = "lang", most: int = MOST_DOCUMENTS, seed: int = 9) -> Prototypes:
    """A prototype for each label: the bundle of its documents' unit vectors. Null labels and null texts teach nothing.

    At most ``most`` documents a label are read, chosen by a hash of doc_id, so that a rare label has as good a
    prototype as its documents allow; their bundles are added up in 16 tasks, and the driver gets 16 vectors a label at
    most. How like its documents are to it is counted over the same documents.
    """
    key = (DIMENSIONS, WIDTH, seed)

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                v = _encoder(*key)(text)
                if v is not None and (size := np.linalg.norm(v)):
                    sums[lang] = sums.get(lang, 0) + v / size
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[k].astype("<f8").tobytes() for k in names], pa.binary())], names=["label", "v"])

    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.col(label).cast("string").alias("label")).where("label is not null and text is not null")
    counts = docs.groupBy("label").agg(F.count("*").alias("n"))  # a row for each label
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    some = docs.join(F.broadcast(counts), "label").withColumn("place", place).where(F.col("place") * F.col("n") < (1 << 30) * 0.95 * most)
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("place", "doc_id"))).where(F.col("k") <= most)
    some = written(some.select("text", "label").repartition(16), "language-sample")
    sums: dict[str, np.ndarray] = {}
    for r in some.mapInArrow(bundle, "label string, v binary").collect():
        sums[r["label"]] = sums.get(r["label"], 0) + np.frombuffer(r["v"], "<f8")
    out = Prototypes({k: v / np.linalg.norm(v) for k, v in sorted(sums.items()) if np.linalg.norm(v)})

    def likeness(batches):
        for b in batches:
            found = []
            for text, lang in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                v = _encoder(*key)(text)
                if v is not None and (size := np.linalg.norm(v)) and lang in out:
                    found.append((lang, _size(text), float(out[lang] @ v / size)))
            columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "size", "cosine"])

    rows = some.mapInArrow(likeness, "label string, size int, cosine double").rollup("label", "size").agg(F.count("*").alias("n"), F.avg("cosine").alias("mean"), F.stddev_pop("cosine").alias("sd"))
    out.likeness = {(r["label"], r["size"]): (r["mean"], r["sd"]) for r in rows.collect() if r["label"] is not None and (r["size"] is None or r["n"] >= ENOUGH)}
    discard(some)
    return out


def _predictor(prototypes: dict[str, np.ndarray], seed: int):
    """Texts to (label, score) pairs."""
    names = list(prototypes)
    matrix = np.stack([prototypes[k] for k in names]).astype(np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)
    key = (DIMENSIONS, WIDTH, seed)

    def predict(texts: list[str | None]) -> list[tuple[str, float]]:
        encode, out = _encoder(*key), []
        for text in texts:
            v = encode(text) if names else None
            size = float(np.linalg.norm(v)) if v is not None else 0.0
            if not size:
                out.append((UNKNOWN, 0.0))
                continue
            cosines = matrix @ v / size
            best = int(cosines.argmax())
            out.append((names[best], min(1.0, max(0.0, (1 + float(cosines[best])) / 2))))
        return out

    return predict


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], seed: int = 9) -> DataFrame:
    """(doc_id, lang_pred string, score double): the prototype of the largest cosine, as (1 + cosine) / 2.

    Whole texts. A text that is null, empty or has no letter gets ``und`` and 0, as does every text where
    there is no prototype. Of equal cosines the first label in order wins. Other columns are not read.
    """
    predict = _predictor(prototypes, seed)

    def predicted(batches):
        for b in batches:
            found = predict(b.column("text").to_pylist())
            columns = [b.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(predicted, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, prototypes: Prototypes, label: str = "lang", deviations: float = DEVIATIONS, seed: int = 9) -> DataFrame:
    """The documents in one of the languages; a null ``label`` becomes the predicted one. All other columns as they are.

    Rejected are texts without a letter, and those less like the language that they are most like than
    ``deviations`` standard deviations below the mean of that language's own documents of like length. Without prototypes none is kept.
    """
    predict = _predictor(prototypes, seed)
    at = docs.columns.index(label) if label in docs.columns else None

    def kept(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            found = predict(texts)
            if at is not None:
                filled = [old if old is not None else new for old, (new, _) in zip(b.column(at).to_pylist(), found, strict=True)]
                b = b.set_column(at, b.schema.field(at), pa.array(filled, b.schema.field(at).type))
            yield b.filter(pa.array([x != UNKNOWN and 2 * s - 1 >= prototypes.bar(x, t, deviations) - 1e-6 for t, (x, s) in zip(texts, found, strict=True)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted languages of all documents; learned where crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    prototypes = learn(docs.where(crc32_mod("doc_id", 4) != 2))
    return identify(docs, prototypes).select("doc_id", F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
ORACLES: dict[str, str] = {}
