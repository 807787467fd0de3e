"""Packing documents into token windows with lexically near neighbours.

Documents are cut into full windows and a rest. The rests are put in a lexical order: each takes a few of its terms
by weighted sampling (the same random numbers for all rests, the BM25 weights of the whole corpus), so that rests
that share much of their weight tend to take the same terms, and rests are sorted by what they took. Runs of
``SHARD`` rests of that order are the shards of a BM25 inverted index. From the longest unused rest on, the window
of each seed is filled by its best unused neighbours of the shard, the last of which is cut where the window
ends; what is left of it stays in the index. What a shard can't fill goes on to the next one of the task.

The search is over a shard and not over the corpus, as the buffer of documents in published BM25 packing is: a search
over all unused rests for each window takes work that grows with the square of the corpus.
"""

from __future__ import annotations

import base64
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import small_batches, table, written

WINDOW = 2048
#: Id behind each document.
END = 1
#: Rests of a shard of the index, and of a task.
SHARD, PER_TASK = 1536, 6144
#: BM25's two constants.
K1, B = 1.2, 0.75
#: Terms that a rest takes for its place in the lexical order.
TAKEN = 4
#: Characters without white space from which on a text's ids come from ``tokenizers``, which is slower but merges in a heap.
LONG_PIECE = 10_000


def _vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokens:
    """Byte-level BPE ids of a text, those of ``tokenizers`` with add_special_tokens=False: the text of a special token is its id.

    They are made by ``tiktoken`` from the same vocabulary as ranks, in a fraction of the time.
    """

    def __init__(self, path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {t.content: k for k, t in self._tokenizer.get_added_tokens_decoder().items()}
        if max([*ranks.values(), *special.values()]) >= 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if len(text) >= LONG_PIECE and max(map(len, text.split()), default=0) >= LONG_PIECE:
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)
        return self._fast.encode_to_numpy(text, allowed_special="all").astype(np.uint16)


_tokens: dict[tuple[str, str], Tokens] = {}


def tokens(*paths: str) -> Tokens:
    if paths not in _tokens:
        _tokens[paths] = Tokens(*paths)
    return _tokens[paths]


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row long"
_CUT = f"{_PIECE}, at long, kind int, ids binary, terms array<int>, counts array<int>"
_PA_PIECE = pa.schema([(c.split()[0], pa.int64()) for c in _PIECE.split(", ")])
_PA_CUT = pa.schema([*_PA_PIECE, ("at", pa.int64()), ("kind", pa.int32()), ("ids", pa.binary()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _table(rows: list[tuple], schema: pa.Schema):
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_place = np.zeros(1 << 16, np.int32)


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and how often each stands there, without a sort."""
    at = np.arange(len(ids), dtype=np.int32)
    _place[ids] = at
    terms = ids[_place[ids] == at]
    _place[terms] = at[: len(terms)]
    return terms, np.bincount(_place[ids])


def _cut(paths: tuple[str, str], window: int):
    """Kind 0: a full window. Kind 1: a rest with its ids. Kind 2: documents of this task that hold each id in their rest."""

    def cut(batches):
        frequency = np.zeros(1 << 16, np.int64)
        for b in batches:
            out = []
            for doc, row, at, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "at", "text")), strict=True):
                ids = np.append(tokens(*paths)(text or ""), np.uint16(END))
                full = len(ids) // window
                for k in range(full):
                    out.append((doc, k * window, window, _crc(ids[k * window : (k + 1) * window]), len(ids), None, 0, row, at, 0, None, None, None))
                rest = ids[full * window :]
                if len(rest):
                    frequency[_distinct(rest)[0]] += 1
                    out.append((doc, full * window, len(rest), None, len(ids), None, None, row, at, 1, rest.astype("<u2").tobytes(), None, None))
            for lo in range(0, len(out), 512):
                yield _table(out[lo : lo + 512], _PA_CUT)
        terms = np.flatnonzero(frequency)
        yield _table([(None,) * 9 + (2, None, terms.tolist(), frequency[terms].tolist())], _PA_CUT)

    return cut


def inverse_frequency(frequency: np.ndarray, n_docs: int) -> np.ndarray:
    """BM25's weight of a term by the number of documents that hold it."""
    return np.log1p((n_docs - frequency + 0.5) / (frequency + 0.5)).clip(0)


def _weights(idf, count, length, mean_length):
    return idf * count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean_length))


def _exponentials(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).exponential(size=(TAKEN, 1 << 16)).astype(np.float32)


def taken_terms(ids: np.ndarray, idf: np.ndarray, mean_length: float, exponentials: np.ndarray) -> list[int]:
    """A sample of a rest's terms: each is taken by the smallest of the terms' exponential numbers over their weights, so
    two rests take the same term as likely as their weights overlap."""
    terms, count = _distinct(ids)
    weight = _weights(idf[terms], count, len(ids), mean_length) + np.float32(1e-9)
    return terms[(exponentials[:, terms] / weight).argmin(1)].tolist()


class Index:
    """A shard's inverted index of rests: for each term the rests that hold it, with their BM25 weights."""

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray, mean_length: float):
        term, doc, count = [], [], []
        self.terms = []
        for k, ids in enumerate(rests):
            t, c = _distinct(ids)
            self.terms.append(np.sort(t))
            term.append(t)
            doc.append(np.full(len(t), k, np.int64))
            count.append(c)
        term, doc, count = np.concatenate(term), np.concatenate(doc), np.concatenate(count)
        weight = _weights(idf[term], count, np.array([len(x) for x in rests])[doc], mean_length)
        order = np.argsort(term, kind="stable")
        term, doc, weight = term[order], doc[order], weight[order]
        self.n = len(rests)
        at = np.searchsorted(term, np.arange((1 << 16) + 1))
        # Terms of many rests are rows of a matrix, the others runs of postings: the scores are the same.
        often = np.flatnonzero(np.diff(at) > self.n // 16)
        self._row = np.full(1 << 16, -1)
        self._row[often] = np.arange(len(often))
        self._many = np.zeros((len(often), self.n), np.float32)
        dense = self._row[term] >= 0
        self._many[self._row[term[dense]], doc[dense]] = weight[dense]
        term, self._doc, self._weight = term[~dense], doc[~dense], weight[~dense].astype(np.float64)
        self._at = np.searchsorted(term, np.arange((1 << 16) + 1))

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 of every rest for a query of distinct terms."""
        rows = self._row[terms]
        out, terms = self._many[rows[rows >= 0]].sum(0), terms[rows < 0]
        runs = [slice(lo, hi) for lo, hi in zip(self._at[terms].tolist(), self._at[terms + np.int64(1)].tolist(), strict=True)]
        if runs:
            doc, weight = (np.concatenate([x[r] for r in runs]) for x in (self._doc, self._weight))
            out = out + np.bincount(doc, weight, self.n)
        return out


def packed(lengths: list[int], neighbours, window: int, begun: int = 0) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (rest, start in the rest, length): greedy, each from the longest unused rest.

    ``neighbours(seed)`` scores all rests. Every window but the last is full, as a neighbour is cut at its end.
    The first ``begun`` rests come from a shard before and are seeds before all others.
    """
    left, used = np.array(lengths), np.zeros(len(lengths), np.int64)
    order, out, at = np.argsort(-left, kind="stable"), [], 0
    cut = list(range(begun))[::-1]
    while True:
        while at < len(order) and not left[order[at]]:
            at += 1
        if at == len(order):
            return out
        seed = int(order[at])
        while cut:  # what a window's end has cut off a rest starts the next one
            k = cut.pop()
            if left[k]:
                seed = k
                break
        room, pieces = window, []
        take = min(room, int(left[seed]))
        pieces.append((seed, int(used[seed]), take))
        used[seed] += take
        left[seed] -= take
        room -= take
        if room:
            score = neighbours(seed)
            free = np.flatnonzero(left)
            for k in free[np.argsort(-score[free], kind="stable")].tolist():
                take = min(room, int(left[k]))
                pieces.append((k, int(used[k]), take))
                used[k] += take
                left[k] -= take
                room -= take
                if left[k]:
                    cut.append(k)
                if not room:
                    break
        out.append(pieces)


def _fill(sent, mean: float, window: int, per_shard: int):
    """Windows of the rests of a task, shard by shard in the order that they come in; full windows pass through, with numbers in the same order.

    Sequence ids: the task's number above 2^33, counted up in the task; negative, or in the given order positive.
    """

    def fill(batches):
        sequence = TaskContext.get().partitionId() << 33
        idf = sent.value
        rows: list[tuple] = []  # doc_id, row, start, doc_tokens, ids
        begun, out = 0, []

        def shard(last: bool):
            nonlocal rows, begun, sequence
            ids = [r[4] for r in rows]
            index = None

            def scores(seed: int) -> np.ndarray:
                nonlocal index
                index = index or Index(ids, idf, mean)
                return index.scores(index.terms[seed])

            windows, kept = packed([len(x) for x in ids], scores, window, begun), []
            if not last and windows and sum(p[2] for p in windows[-1]) < window:
                kept = windows.pop()
            for pieces in windows:
                at = 0
                for rest, start, length in pieces:
                    doc, row, first, doc_tokens, x = rows[rest]
                    out.append((doc, first + start, length, _crc(x[start : start + length]), doc_tokens, sequence, at, row))
                    at += length
                sequence += 1
            rows = [(*rows[k][:2], rows[k][2] + start, rows[k][3], rows[k][4][start : start + n]) for k, start, n in kept]
            begun = len(rows)

        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("kind", "doc_id", "row", "start", "doc_tokens", "length", "ids_crc32", "ids"))
            for kind, doc, row, start, doc_tokens, length, crc, ids in zip(*columns, strict=True):
                if kind == 0:
                    out.append((doc, start, length, crc, doc_tokens, sequence, 0, row))
                    sequence += 1
                    continue
                rows.append((doc, row, start, doc_tokens, np.frombuffer(ids, "<u2")))
                if len(rows) >= per_shard + begun:
                    shard(False)
            if len(out) > 4096:
                yield _table(out, _PA_PIECE)
                out.clear()
        if rows:
            shard(True)
        yield _table(out, _PA_PIECE)

    return fill


def pack(docs: DataFrame, vocabulary: tuple[str, str] | None = None, window: int = WINDOW, per_shard: int = SHARD, order: Column | None = None, exhaustive: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row - all long) of ``docs`` (doc_id, text).

    Each document is its ids and END; each id is in one piece, and a sequence's offsets have no gaps. All
    sequences are full but one a task of PER_TASK rests. ``row`` tells rows of one doc_id apart. Null and empty texts are
    END alone; ``vocabulary``: the paths of one vocabulary's two files. Equal texts and very long ones are treated like
    any other, a null doc_id stays null; neighbours of equal scores are taken in the order of the shard. Other columns are not read; an empty
    input gives an empty result. Sequence ids are unique, not consecutive. ``order`` (long): shards are runs of
    the documents in that order in place of the lexical one, and sequence ids grow with it. ``exhaustive``: each window
    gets the best unused rests of the whole corpus; work grows with its square, and the driver holds all rests' lengths.
    """
    paths = vocabulary or (_vocabulary_path("byte_bpe_50k.json"), _vocabulary_path("byte_bpe_50k.tiktoken"))
    spark = docs.sparkSession
    small_batches(spark)
    at = F.lit(None) if order is None else order
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", at.cast("long").alias("at")).withColumn("row", F.monotonically_increasing_id())
    cut = written(docs.mapInArrow(_cut(paths, window), _CUT), "packing-cut")
    rests = cut.where("kind = 1")
    n, total = rests.agg(F.count("*"), F.sum("length")).first()
    whole = cut.where("kind = 0").select(*[f.name for f in _PA_PIECE])
    if not n:
        return whole.withColumn("sequence_id", F.monotonically_increasing_id())
    terms = cut.where("kind = 2").select(F.arrays_zip("terms", "counts").alias("x")).select(F.inline("x"))
    frequency = np.zeros(1 << 16)  # the vocabulary bounds what comes to the driver
    for r in terms.groupBy("terms").agg(F.sum("counts").alias("n")).collect():
        frequency[r["terms"]] = r["n"]
    sent = spark.sparkContext.broadcast(inverse_frequency(frequency, n).astype(np.float32))
    mean, parts = total / n, max(1, math.ceil(n / PER_TASK))
    columns = ["kind", "doc_id", "row", "start", "doc_tokens", "length", "ids_crc32", "ids"]

    if exhaustive:
        from .exhaustive import pack_all

        shards = max(1, math.ceil(n / per_shard))
        rests = rests.withColumn("shard", F.pmod(F.xxhash64("row", "doc_id"), F.lit(shards)).cast("int"))
        return pack_all(rests, sent, n, mean, shards, window).unionByName(whole.withColumn("sequence_id", F.monotonically_increasing_id()))
    if order is not None:
        rows = cut.where("kind < 2").select("at", *columns)
        return _in_parts(rows, parts, "at", "row", "start").select(*columns).mapInArrow(_fill(sent, mean, window, per_shard), _PIECE)

    names = [f"k{k}" for k in range(TAKEN)]

    def keyed(batches):
        exponentials = _exponentials()
        for b in batches:
            taken = [taken_terms(np.frombuffer(x, "<u2"), sent.value, mean, exponentials) for x in b.column("ids").to_pylist()]
            keys = [pa.array([t[k] for t in taken], pa.int32()) for k in range(TAKEN)]
            yield pa.RecordBatch.from_arrays([*keys, *[b.column(c) for c in columns]], names=[*names, *columns])

    kinds = {f.name: f.dataType.simpleString() for f in rests.schema.fields}
    keys = rests.select(*columns).mapInArrow(keyed, ", ".join([*[f"{x} int" for x in names], *[f"{c} {kinds[c]}" for c in columns]]))
    # Rests that took the same terms lie in the order of a hash, so that a great many of them are split.
    keys = written(keys.withColumn("h", F.xxhash64("row", "doc_id")), "packing-keys")
    filled = _in_parts(keys, parts, *names, "h", "row").select(*columns).mapInArrow(_fill(sent, mean, window, per_shard), _PIECE)
    # Full windows count from zero up, the others from zero down.
    filled = filled.withColumn("sequence_id", -1 - F.col("sequence_id"))
    return filled.unionByName(whole.withColumn("sequence_id", F.monotonically_increasing_id()))


def _in_parts(rows: DataFrame, parts: int, *by: str) -> DataFrame:
    return rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents")).drop("row")


QUERIES = {"op7_packing": op7_packing}
ORACLES: dict[str, str] = {}
