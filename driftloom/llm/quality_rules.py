"""Quality rules: base counts of a text, and line labels of a linear-chain conditional random field.

Every line is content or boilerplate. The field is trained here, on all labelled documents, by gradients that tasks add up. Of
bad documents all lines are boilerplate; of good ones those that stood in the text before, and those that stand in
many surroundings in the corpus; their other lines are content. A document stays if enough of its words stand in lines that
Viterbi decoding marks as content.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, small_batches, table, written
from ._text import windows, word_hashes, words

#: Lines of a block of chains, which go forward and backward together, about.
BLOCK = 20_000
#: Shared lines that are broadcast at most; beyond, each text is joined with its own.
MOST_KNOWN = 1 << 20
#: Passes over all labelled documents at most, and the largest component of a gradient at which training ends.
PASSES, STILL = 100, 1e-5
#: Different surroundings (the lines before and after) from which on a line is shared: copies of a document keep theirs.
SHARED = 8
#: Share of a document's words that must stand in content lines.
CONTENT_SHARE = 0.5
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\r\x0b\x0c"
N_FEATURES = 13
_SYMBOLS, _UPPER, _DIGITS = SYMBOLS.encode(), string.ascii_uppercase.encode(), string.digits.encode()
_ASCII = re.compile(r"[\x00-\x7f]+")


def base_counts(text: str | None) -> dict[str, int]:
    """Counts of a whole text; a null one has none. Long texts cost time in proportion."""
    text = text or ""
    tokens = words(text)
    repeated = 0
    if len(tokens) > 5:
        _, back, n = np.unique(windows(word_hashes(tokens), 5), return_inverse=True, return_counts=True)
        twice = n[back] > 1
        if twice.any():
            covered = np.zeros(len(tokens) + 1, np.int64)
            starts = np.flatnonzero(twice)
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + 5, -1)
            repeated = int((covered.cumsum()[:-1] > 0).sum())
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(_BLANKS):
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return {
        "n_words": len(tokens),
        "word_chars": len(text) - sum(map(text.count, _BLANKS)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": dup,
        "n_repeat_words": repeated,
    }


def _n_upper(line: str, raw: bytes) -> int:
    """Upper-case characters of a line; ``raw`` is its UTF-8."""
    n = len(raw) - len(raw.translate(None, _UPPER))
    return n if len(raw) == len(line) else n + sum(map(str.isupper, _ASCII.sub("", line)))


def line_features(text: str | None, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line with a word, and the lines' words. ``known``: hashes of shared lines, ascending; the last feature marks them."""
    rows, n_words, seen = [], [], set()
    for line in (text or "").split("\n"):
        tokens = line.split()
        if not line.strip(_BLANKS):
            continue
        n, size, raw = max(1, len(tokens)), len(line), line.encode("utf-8", "replace")
        distinct = len(set(tokens)) / n
        rows.append((
            1.0,
            min(1.0, n / 40),
            min(1.0, size / n / 20),
            min(1.0, 8 * (len(raw) - len(raw.translate(None, _SYMBOLS))) / size),
            min(1.0, 8 * line.count("!") / size),
            min(1.0, 2 * _n_upper(line, raw) / size),
            1.0 - distinct,
            float(n > 8 and distinct < 0.4),
            float(line.rstrip()[-1:] in ".?!\"'"),
            min(1.0, 8 * (len(raw) - len(raw.translate(None, _DIGITS))) / size),
            float(line in seen),
            min(1.0, 16 * line.count("|") / size),
            0.0,
        ))
        n_words.append(len(tokens))
        seen.add(line)
    out = np.array(rows, np.float64).reshape(len(rows), N_FEATURES)
    if known is not None and len(known):
        out[:, -1] = _among(line_hashes(text)[0], known)
    return out, np.array(n_words, np.int64)


def _among(at: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``at`` are in ``known``, which ascends and is not empty."""
    return known[np.minimum(np.searchsorted(known, at), len(known) - 1)] == at


def line_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word, in the lines' order: a hash, a hash of the lines around it, and whether the line stood before."""
    lines = [line for line in (text or "").split("\n") if line.strip(_BLANKS)]
    at = np.array([xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace")) for line in lines], np.uint64).view(np.int64)
    again = np.ones(len(at), bool)
    again[np.unique(at, return_index=True)[1]] = False
    around = np.r_[0, at, 0].view(np.uint64)
    return at, (around[:-2] * np.uint64(0x9E3779B97F4A7C15) + around[2:]).view(np.int64), again


class Field:
    """Weights of the field: ``emit`` (features x 2) and ``move`` (2 x 2). Label 1 is content. ``known``: hashes of shared lines, ascending."""

    known: np.ndarray | None = None
    #: The same as a table (line long), where they are too many to be held.
    lines: DataFrame | None = None

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((N_FEATURES, 2)) if emit is None else emit
        self.move = np.zeros((2, 2)) if move is None else move

    @classmethod
    def trained(cls, documents: list[np.ndarray], labels: list, steps: int = 200, penalty: float = 1e-3) -> Field:
        """Maximum likelihood by gradient steps; a document is a chain, and all go forward and backward together.

        ``labels``: of each document one label for all of its lines, or an array of its lines' labels. Each document weighs the
        same: if those without content weighed as much as all others, boilerplate would draw in the lines around it.
        """
        chains = sorted(((x, y) for x, y in zip(documents, labels, strict=True) if len(x)), key=lambda c: -len(c[0]))
        self = cls()
        if not chains:
            self.emit[0] = (-1.0, 1.0)  # nothing is known against any line
            return self
        lengths = np.array([len(x) for x, _ in chains])
        y = np.concatenate([np.broadcast_to(label, len(x)) for x, label in chains])
        weight = 1.0 / (len(lengths) * lengths)
        x = np.concatenate([rows for rows, _ in chains])
        sums = [np.zeros_like(self.emit), np.zeros_like(self.move)]
        for _ in range(steps):
            _, g_emit, g_move = self.loss(x, lengths, y, weight)
            for p, g, s in zip((self.emit, self.move), (g_emit + penalty * self.emit, g_move + penalty * self.move), sums, strict=True):
                s += g * g
                p -= 0.5 * g / (np.sqrt(s) + 1e-8)
        return self

    def loss(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Weighted negative log-likelihood of chains, and its gradients.

        ``x`` has the lines of all chains, one after another, the longest chain first; ``y`` has a label for each line, or for each chain.
        """
        node, pair, total = self.marginals(x, lengths)
        chain = np.repeat(np.arange(len(lengths)), lengths)
        w, label = weight[chain], y if len(y) == len(x) else y[chain]
        gold, last = np.eye(2)[label], np.roll(label, 1)
        inner = np.r_[True, chain[1:] != chain[:-1]]  # pair[k] joins a line with the one before; a chain's first line has none
        moved = np.where(inner[:, None, None], 0.0, np.eye(2)[last][:, :, None] * gold[:, None, :])
        score = (x @ self.emit)[np.arange(len(x)), label] + np.where(inner, 0.0, self.move[last, label])
        value = float(weight @ total - w @ score)
        return value, x.T @ (w[:, None] * (node - gold)), (w[:, None, None] * (pair - moved)).sum(0)

    def marginals(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of each line's labels and of those of the line before and it; and each chain's log of the sum over all labellings."""
        score = x @ self.emit
        starts = np.cumsum(lengths) - lengths
        active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # chains of at least so many lines
        ahead, back = score.copy(), np.zeros_like(score)
        for t in range(1, lengths[0]):
            at = starts[: active[t]] + t
            ahead[at] += np.logaddexp.reduce(ahead[at - 1, :, None] + self.move, axis=1)
        for t in range(lengths[0] - 2, -1, -1):
            at = starts[: active[t + 1]] + t
            back[at] = np.logaddexp.reduce(self.move + (score[at + 1] + back[at + 1])[:, None, :], axis=2)
        node = ahead + back
        total = np.logaddexp(*ahead[starts + lengths - 1].T)
        z = np.repeat(total, lengths)
        pair = np.zeros((len(x), 2, 2))
        later = np.setdiff1d(np.arange(len(x)), starts)
        pair[later] = np.exp(ahead[later - 1, :, None] + self.move + (score[later] + back[later])[:, None, :] - z[later, None, None])
        return np.exp(node - z[:, None]), pair, total

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most likely labels of a document's lines; of equal ones, boilerplate first."""
        score, ((m00, m01), (m10, m11)) = (x @ self.emit).tolist(), self.move.tolist()
        if not score:
            return np.zeros(0, np.int64)
        (a, b), came = score[0], []
        for s0, s1 in score[1:]:
            f0, f1 = b + m10 > a + m00, b + m11 > a + m01
            came.append((f0, f1))
            a, b = (b + m10 if f0 else a + m00) + s0, (b + m11 if f1 else a + m01) + s1
        label = int(b > a)
        out = [label]
        for step in reversed(came):
            label = int(step[label])
            out.append(label)
        return np.array(out[::-1])


def often(docs: DataFrame, least: int = SHARED, wanted: np.ndarray | None = None) -> DataFrame:
    """(line long): hashes of the lines (of ``wanted``; None: of all) that stand in ``least`` different surroundings or more in ``docs``.

    A task hands on each line and surrounding of a batch once; these are counted by all tasks. Null texts have no lines.
    """
    spark = docs.sparkSession
    sent = None if wanted is None else spark.sparkContext.broadcast(np.unique(wanted))

    def found(batches):
        for b in batches:
            made = [line_hashes(t)[:2] for t in b.column("text").to_pylist()]
            at, around = (np.concatenate([np.zeros(0, np.int64), *[m[k] for m in made]]) for k in (0, 1))
            known = slice(None) if sent is None else _among(at, sent.value)
            pairs = np.unique(np.stack([at[known], around[known]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["line", "around"])

    small_batches(spark)
    pairs = docs.select("text").mapInArrow(found, "line long, around long").distinct()
    return pairs.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("line")


def shared_lines(docs: DataFrame, wanted: np.ndarray, least: int = SHARED) -> np.ndarray:
    """``often`` of the line hashes ``wanted``, which are few, ascending."""
    if not len(wanted):
        return wanted
    return np.sort(np.array([r["line"] for r in often(docs, least, wanted).collect()], np.int64))  # some of ``wanted``


def _hashes_of(cell: str | bytes | None) -> np.ndarray:
    """Hashes of the lines of a text, or those that are written out already."""
    return np.frombuffer(cell, "<i8") if isinstance(cell, bytes) else line_hashes(cell)[0]


def _with_known(docs: DataFrame, field: Field, of: str = "text") -> DataFrame:
    """``docs`` with ``known``: the shared lines of a text, null where the field has them all itself. ``of``: texts, or their lines' hashes."""
    if field.lines is None:
        return docs.withColumn("known", F.lit(None).cast("array<bigint>"))

    def found(batches):
        for b in batches:
            for key, cell in zip(b.column("key").to_pylist(), b.column(of).to_pylist(), strict=True):
                at = np.unique(_hashes_of(cell))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.string()), pa.array(at, pa.int64())], names=["key", "line"])

    keyed = docs.withColumn("key", F.sha2(of, 256))
    lines = keyed.select("key", of).mapInArrow(found, "key string, line long").distinct()
    own = lines.join(field.lines, "line").groupBy("key").agg(F.collect_set("line").alias("known"))
    return keyed.join(own, "key", "left").withColumn("known", F.coalesce("known", F.array().cast("array<bigint>"))).drop("key")


def _known_of(batch, field_known: np.ndarray | None) -> list[np.ndarray | None]:
    return [field_known if own is None else np.sort(np.array(own, np.int64)) for own in batch.column("known").to_pylist()]


def _fitted(blocks: DataFrame, field: Field, penalty: float = 1e-3) -> None:
    """Sets the field's weights to those of the penalised maximum likelihood of all ``blocks``: quasi-Newton steps, of which each
    is a pass of all tasks that hands one row of sums a task to the next aggregate."""
    n = blocks.agg(F.sum("chains")).first()[0] or 0
    if not n:
        field.emit[0] = (-1.0, 1.0)  # nothing is known against any line
        return
    shape, size = (N_FEATURES, 2), 2 * N_FEATURES

    def passed(w: np.ndarray) -> tuple[float, np.ndarray]:
        def sums(batches):
            now, total = Field(w[:size].reshape(shape), w[size:].reshape(2, 2)), np.zeros(size + 5)
            for b in batches:
                for r in b.to_pylist():
                    lengths = np.frombuffer(r["lengths"], "<i4").astype(np.int64)
                    x, y = np.frombuffer(r["x"], "<f4").reshape(-1, N_FEATURES).astype(np.float64), np.frombuffer(r["y"], np.int8).astype(np.int64)
                    value, emit, move = now.loss(x, lengths, y, 1.0 / lengths)
                    total += np.r_[value, emit.ravel(), move.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

        out = blocks.mapInArrow(sums, "v array<double>").agg(*[F.sum(F.col("v")[k]) for k in range(size + 5)]).first()
        out = np.array(out, np.float64) / n
        return out[0] + penalty / 2 * w @ w, out[1:] + penalty * w

    w, inverse = np.zeros(size + 4), np.eye(size + 4)
    value, g = passed(w)
    left = PASSES
    while left > 0 and abs(g).max() > STILL:
        d, rate = -inverse @ g, 1.0
        while True:
            to, h = passed(w + rate * d)
            left -= 1
            if to <= value + 1e-4 * rate * (g @ d) or left <= 0 or rate < 1e-6:
                break
            rate /= 2
        if to > value:
            break
        s, y = rate * d, h - g
        if (sy := s @ y) > 1e-14:
            if left >= PASSES - 1:
                inverse *= sy / (y @ y)
            u = np.eye(len(w)) - np.outer(s, y) / sy
            inverse = u @ inverse @ u.T + np.outer(s, s) / sy
        w, value, g = w + s, to, h
    field.emit, field.move = w[:size].reshape(shape).copy(), w[size:].reshape(2, 2).copy()


def _traits(docs: DataFrame) -> DataFrame:
    """(doc_id, x, again, lines binary): features of a document's lines, column by column, whether they stood before, and their hashes.

    They are what the labels are joined with, as they are shorter than the texts. Documents without an id or lines teach nothing.
    """

    def told(batches):
        for b in batches:
            ids, rows = [], []
            for doc_id, text in zip(b.column("doc_id"), b.column("text").to_pylist(), strict=True):
                x = line_features(text)[0]
                if len(x):
                    at, _, again = line_hashes(text)
                    ids.append(doc_id.as_py())
                    rows.append((x.T.astype("<f4").tobytes(), again.tobytes(), at.tobytes()))
            columns = [pa.array(ids, b.schema.field("doc_id").type), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(3)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "x", "again", "lines"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(told, f"doc_id {kind}, x binary, again binary, lines binary")


def taught(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(x, again, lines binary, label int) of all labelled documents. Both sides are shuffled at any size, as labels grow with the documents; no text is."""
    labels = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    labels = labels.groupBy("doc_id").agg(F.max("label").alias("label"))
    return _traits(docs).join(labels.hint("merge"), "doc_id").select("x", "again", "lines", "label")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", shared: int = SHARED) -> Field:
    """Trained on all lines of all labelled documents; null labels teach nothing, and without labels every line is content.

    In how many surroundings any line stands is counted over all documents; ``shared`` of them make it boilerplate, and the
    field knows it wherever it stands. Features stay on the executors; each pass of the training brings a row of sums to the driver.
    """
    small_batches(docs.sparkSession)
    field = Field()
    lines = written(often(docs, shared), "quality-shared")
    if lines.limit(MOST_KNOWN + 1).count() > MOST_KNOWN:
        field.lines = lines
    else:
        field.known = np.sort(np.array([r["line"] for r in lines.collect()], np.int64))
        discard(lines)
    field_known = field.known

    def blocked(batches):
        for b in batches:
            chains = []
            for known, *cells in zip(_known_of(b, field_known), *[b.column(c).to_pylist() for c in ("x", "again", "lines", "label")], strict=True):
                x, again, at = (np.frombuffer(c, t) for c, t in zip(cells, ("<f4", bool, "<i8"), strict=False))
                x = x.reshape(N_FEATURES, -1).T.copy()
                if known is not None and len(known):
                    x[:, -1] = _among(at, known)
                chains.append((x, ((x[:, -1] == 0) & ~again & (cells[-1] > 0)).astype(np.int8)))
            chains.sort(key=lambda c: -len(c[0]))
            ends = np.cumsum([len(c[0]) for c in chains])
            for k in np.unique(ends // BLOCK).tolist():
                some = [chains[i] for i in np.flatnonzero(ends // BLOCK == k)]
                columns = [[len(some)], [np.array([len(c[0]) for c in some], "<i4").tobytes()], *[[np.concatenate([c[j] for c in some]).tobytes()] for j in (0, 1)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["chains", "lengths", "x", "y"])

    rows = _with_known(taught(docs, labels, label), field, "lines")
    blocks = written(rows.select("x", "again", "lines", "label", "known").mapInArrow(blocked, "chains int, lengths binary, x binary, y binary"), "quality-lines")
    _fitted(blocks, field)
    discard(blocks)
    return field


def apply_rules(docs: DataFrame, field: Field, content_share: float = CONTENT_SHARE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words long, content_share double, base_failed, kept boolean).

    ``base_failed``: fewer than 10 words, or more than a fifth of them in 5-word windows that stand twice or
    more in the text. ``kept``: not base_failed, and ``content_share`` of the words in content lines or
    more. Null and empty texts have no words and fail; very long texts are taken whole. Of equally likely labels boilerplate
    is taken. Equal rows get equal results; other columns are not read; an empty input gives an empty result.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    held = Field(field.emit, field.move)  # without the table, which stays on the driver
    field_known = field.known

    def judged(batches):
        for b in batches:
            counts, shares, failed, kept = [], [], [], []
            for text, own in zip(b.column("text").to_pylist(), _known_of(b, field_known), strict=True):
                c = base_counts(text)
                x, n = line_features(text, own)
                share = float(n[held.decode(x) == 1].sum() / n.sum()) if n.sum() else 0.0
                bad = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
                counts.append(c)
                shares.append(share)
                failed.append(bad)
                kept.append(not bad and share >= content_share)
            columns = [b.column("doc_id"), *[pa.array([c[k] for c in counts], pa.int64()) for k in names]]
            columns += [pa.array(shares, pa.float64()), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "content_share", "base_failed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{n} long' for n in names)}, content_share double, base_failed boolean, kept boolean"
    return _with_known(docs.select("doc_id", "text"), field).select("doc_id", "text", "known").mapInArrow(judged, schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the field's verdict on all documents."""
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, learn(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES: dict[str, str] = {}
