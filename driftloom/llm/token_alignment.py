"""Alignment of two tokenizers' tokens by the byte offsets at which they end.

Arrow batches only tokenise: each text gives both sides' tokens, as numbers that begin with the end, in ascending order. What
follows are higher-order functions: tokens that end together stand next to each other, so that ``filter`` of a ``sequence`` gives
the cuts, ``transform`` and ``slice`` read the links and the groups off in linear time, and a second ``filter`` counts groups. How often
a pair of ids is linked in the corpus is a count pre-aggregated by tasks.

Both sides' tokens end where a single space stands between two words, so a text's groups are those of its parts between
such spaces. ``parted`` tokenises the different parts of some texts once, ``aligned_parts`` aligns each of them once, and a
``transform`` of a text's parts puts its groups and links together; ``tokenised`` and ``aligned`` do the same by whole texts.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, small_batches, table, written

#: Stands for a space in pieces.
MARK = "▁"
#: Of pairs that hold one in so many links at least, there are as many at most: what is broadcast.
COMMON_PAIRS = 1 << 18
#: Characters without white space from which on ``tokenizers`` encodes, which merges in a heap.
LONG = 10_000
#: Rows of a batch of tokens, which take several times their texts' bytes.
ROWS = 100
#: Bytes of the texts whose different parts are tokenised and aligned together, but for a longer text.
TOGETHER = 1 << 21
#: Parts that one call of the piece model encodes, whose time grows faster than its text.
CALL = 64
#: What marks a token of the second side in a number that holds an end and an id.
_SECOND = 1 << 30
#: What marks the last token of a part.
_STOP = 1 << 31

_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class _Encoder:
    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.sizes = np.array([len(p) for p in pieces], np.int32)

    def same(self, ids: np.ndarray, text: str) -> np.ndarray | None:
        """``ids``, or None where their bytes are not those of ``text``."""
        return ids if b"".join(map(self.pieces.__getitem__, ids.tolist())) == text.encode() else None


class ByteLevel(_Encoder):
    """Byte-level BPE without special tokens: their strings are plain text. Ids come from ``tiktoken`` with the same
    vocabulary, whose entries are bytes already, but for texts with a very long stretch without a space."""

    def __init__(self, path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, k in ranks.items():
            pieces[k] = piece
        super().__init__(pieces)
        self._fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._path, self._whole = path, None

    def _slow(self, text: str) -> list[int]:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._path)
            self._whole.encode_special_tokens = True
        return self._whole.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray | None:
        """Ids of ``text``; None if their bytes are others than its own."""
        long = len(text) >= LONG and max(map(len, text.split(" "))) >= LONG
        ids = self._slow(text) if long else self._fast.encode_to_numpy(text, disallowed_special=())
        return self.same(np.asarray(ids, np.int64), text)


class Pieces(_Encoder):
    """SentencePiece, which puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self._model.id_to_piece(k) for k in range(self._model.get_piece_size())]
        is_byte = [self._model.is_byte(k) for k in range(len(names))]
        super().__init__([bytes([int(_BYTE.fullmatch(p)[1], 16)]) if b else p.replace(MARK, " ").encode() for p, b in zip(names, is_byte, strict=True)])

    def __call__(self, text: str) -> np.ndarray | None:
        """Ids of ``text``; None if their bytes are others than those of a space and the text."""
        return self.same(np.array(self._model.encode(text, num_threads=1), np.int64), f" {text}")

    def parted(self) -> bool:
        """Whether no piece goes on with a space behind another character, so that tokens end there."""
        return not any(re.search(rb"[^ ] ", p) for p in self.pieces)


_encoders: dict[tuple[str, ...], tuple[ByteLevel, Pieces]] = {}


def encoders(*paths: str) -> tuple[ByteLevel, Pieces]:
    if paths not in _encoders:
        _encoders[paths] = ByteLevel(*paths[:2]), Pieces(paths[2])
    return _encoders[paths]


def _lists(sizes, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def tokenised(docs: DataFrame, byte_path: str, ranks_path: str, piece_path: str) -> DataFrame:
    """(doc_id, n_a, n_b - int, tokens - array of long) of a space and the text, and of the text.

    ``tokens`` holds both sides' tokens as one number each, ascending: the byte offset where it ends, from bit 32 on, bit 30
    for the second side, and the id. It is empty for texts that are null or empty or whose bytes either of the
    two doesn't give back.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encoded(batches):
        a, b = encoders(byte_path, ranks_path, piece_path)
        nothing = np.zeros(0, np.int64)
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            sizes: tuple[list[int], list[int]] = ([], [])
            tokens = []
            for text in batch.column("text").to_pylist():
                x, y = (a(f" {text}"), b(text)) if text else (None, None)
                if x is None or y is None:
                    x = y = nothing
                for to, own in zip(sizes, (x, y), strict=True):
                    to.append(len(own))
                at = [np.cumsum(e.sizes[ids], dtype=np.int64) for e, ids in ((a, x), (b, y))]
                both = np.concatenate([at[0] << 32 | x, at[1] << 32 | _SECOND | y])
                both.sort(kind="stable")
                tokens.append(both)
            columns = [batch.column("doc_id"), *[pa.array(own, pa.int32()) for own in sizes], _lists(list(map(len, tokens)), np.concatenate([np.zeros(0, np.int64), *tokens]))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(encoded, f"doc_id {kind}, n_a int, n_b int, tokens array<bigint>")


def _edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes begin and which end a character that is surely no white space: visible ASCII, U+00C0 to U+07FF, U+4000 to U+DFFF."""
    ascii = data - np.uint8(33) < 94
    two, three = data - np.uint8(0xC3) < 29, data - np.uint8(0xE4) < 10
    closes = ascii.copy()
    closes[1:] |= two[:-1]
    closes[2:] |= three[:-2]
    return ascii | two | three, closes


def _parts(texts: pa.Array, split: bool) -> tuple[np.ndarray, pa.Array]:
    """Where each text's parts begin among all parts, their number at the end, and all parts, each with the space before it.

    A text, which must not be null, gets a space before it and is cut before each space between two characters that are surely no
    white space, if ``split``.
    """
    spaced = [f" {t}".encode() for t in texts.to_pylist()]
    at = np.cumsum([0, *map(len, spaced)], dtype=np.int64)
    joined = b"".join(spaced)
    data = np.frombuffer(joined, np.uint8)
    cuts = at[:0]
    if split:
        opens, closes = _edges(data)
        cuts = np.flatnonzero((data[1:-1] == 32) & closes[:-2] & opens[2:]) + 1
    starts = np.concatenate([at, cuts])
    starts.sort(kind="stable")
    starts = starts[np.diff(starts, prepend=-1) > 0]
    return np.searchsorted(starts, at), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(joined)])


def _bytes(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all parts in one row, and where each begins; at the end, their number."""
    _, offsets, data = parts.buffers()
    at = np.frombuffer(offsets, np.int64, len(parts) + 1, 8 * parts.offset)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _plain(parts: pa.Array) -> np.ndarray:
    """Which parts may stand in a row with others: they are short, neither begin nor end with white space and don't hold the mark."""
    data, at = _bytes(parts)
    opens, closes = _edges(data)
    marked = pc.match_substring(parts, MARK.encode()).to_numpy(zero_copy_only=False).astype(bool)
    return opens[at[:-1] + 1] & closes[at[1:] - 1] & (np.diff(at) < LONG) & ~marked


def _part_tokens(parts: pa.Array, plain: int, a: ByteLevel, b: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many tokens of either side each part has, and all tokens, ascending, with ends counted over all parts.

    The first ``plain`` parts are encoded in a row. A part whose bytes either side doesn't give back has no tokens.
    """
    data, at = _bytes(parts)
    whole = data.tobytes()
    found: tuple[list, list] = ([np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)])
    text = lambda k, n: whole[at[k] + 1 : at[n]].decode()

    def add(start: int, x: np.ndarray | None, y: np.ndarray | None) -> bool:
        if x is None or y is None:
            return False
        for to, own, ids in zip(found, (a, b), (x, y), strict=True):
            to.append(np.stack([start + np.cumsum(own.sizes[ids], dtype=np.int64), ids]))
        return True

    rows = [b(text(k, min(k + CALL, plain))) for k in range(0, plain, CALL)]
    in_row = plain > 0 and all(r is not None for r in rows) and add(0, a(f" {text(0, plain)}"), np.concatenate(rows))
    for k in range(plain if in_row else 0, len(parts)):
        add(int(at[k]), a(f" {text(k, k + 1)}"), b(text(k, k + 1)))
    (ends_a, ids_a), (ends_b, ids_b) = (np.concatenate(f, axis=1) for f in found)
    n_a, n_b = (np.diff(np.searchsorted(ends, at, "right")) for ends in (ends_a, ends_b))
    tokens = np.concatenate([ends_a << 32 | ids_a, ends_b << 32 | _SECOND | ids_b])
    tokens.sort(kind="stable")
    return n_a, n_b, tokens


def _together(batches):
    """The batches' rows (doc_id, text) by some ``TOGETHER`` bytes, a longer text whole."""
    held, now, size = [], 0, 0
    for batch in batches:
        own = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        of = (size + np.cumsum(own) - own) // TOGETHER
        size += int(own.sum())
        at = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(at, at[1:]):
            if lo < hi:
                if held and of[lo] != now:
                    yield held
                    held = []
                held.append(batch.slice(lo, hi - lo))
                now = of[lo]
    if held:
        yield held


def parted(docs: DataFrame, byte_path: str, ranks_path: str, piece_path: str) -> DataFrame:
    """Rows (docs - array of (doc_id, n_a, n_b - long, parts - array of int), tokens - array of long) of a bounded number of texts each.

    ``tokens`` holds the tokens of the different parts of the texts in a row, as ``tokenised`` gives them, the last of each
    part marked by bit 31; ``parts`` are a text's parts in order, by their number in that row. Texts that are null or empty or
    whose bytes either side doesn't give back have no parts. The byte-level side splits words as ``public_tokenizers``
    does; a piece vocabulary with a piece that goes on with a space behind another character has whole texts as parts.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encoded(batches):
        a, b = encoders(byte_path, ranks_path, piece_path)
        split = b.parted()
        for held in _together(batches):
            ids, texts = (pa.concat_arrays([h.column(c) for h in held]) for c in ("doc_id", "text"))
            full = np.flatnonzero(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            begins, parts = _parts(texts.take(pa.array(full)), split)
            different = parts.dictionary_encode()
            plain = _plain(different.dictionary)
            order = np.argsort(~plain, kind="stable")
            place = np.argsort(order)[different.indices.to_numpy(zero_copy_only=False)]
            n_a, n_b, tokens = _part_tokens(different.dictionary.take(pa.array(order)), int(plain.sum()), a, b)
            tokens[np.cumsum(n_a + n_b)[n_a > 0] - 1] |= _STOP
            # A text with a part without tokens has none.
            total = lambda n: np.diff(np.concatenate([[0], np.cumsum(n[place])])[begins])  # noqa: E731, B023
            good = total(n_a == 0) == 0
            counts = np.zeros((3, len(ids)), np.int64)
            counts[:, full] = np.stack([total(n_a), total(n_b), np.diff(begins)]) * good
            own = _lists(counts[2], (np.cumsum(n_a > 0) - 1)[place[np.repeat(good, np.diff(begins))]].astype(np.int32))
            rows = pa.StructArray.from_arrays([ids, pa.array(counts[0]), pa.array(counts[1]), own], names=["doc_id", "n_a", "n_b", "parts"])
            yield pa.RecordBatch.from_arrays([_lists([len(rows)], rows), _lists([len(tokens)], tokens)], names=["docs", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(encoded, f"docs array<struct<doc_id:{kind},n_a:bigint,n_b:bigint,parts:array<int>>>, tokens array<bigint>")


def _id(token: Column) -> Column:
    return token.bitwiseAND(_SECOND - 1)


def _run(tokens: Column, second: bool) -> Column:
    """The ids of one side of a group's tokens, apart by commas."""
    own = F.filter(tokens, lambda t: (t.bitwiseAND(_SECOND) != 0) if second else (t.bitwiseAND(_SECOND) == 0))
    return F.array_join(F.transform(own, lambda t: _id(t).cast("string")), ",")


def _cuts(tokens: Column) -> Column:
    """Where a token of the second side stands behind one of the first that ends together with it."""
    token = lambda i: F.get(tokens, i)
    cuts = F.filter(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.shiftright(token(i).bitwiseXOR(token(i - 1)), 32) == 0)
    return F.when(F.size(tokens) > 1, cuts).otherwise(F.array().cast("array<int>"))


def _since(at: Column) -> Column:
    """Where the group before ends: -1 for the first."""
    return F.concat(F.array(F.lit(-1)), at)


def _texts(tokens: Column, at: Column, since: Column) -> Column:
    """The text of each group; those of two or three tokens, nearly all, are written without a look at their sides' lists."""
    size = lambda i, k: i - F.get(since, k)  # noqa: E731  tokens of a group
    text = lambda i: _id(F.get(tokens, i)).cast("string")
    inside = lambda i, k: F.slice(tokens, F.get(since, k) + 2, size(i, k))
    bar, comma = F.lit("|"), F.lit(",")
    two = lambda i: F.concat(text(i - 1), bar, text(i))
    second = lambda i: F.get(tokens, i).bitwiseAND(_SECOND) != 0
    three = lambda i: F.when(second(i - 2), F.concat(text(i - 1), bar, text(i - 2), comma, text(i))).otherwise(F.concat(text(i - 2), comma, text(i - 1), bar, text(i)))
    more = lambda i, k: F.concat(_run(inside(i, k), False), bar, _run(inside(i, k), True))
    return F.transform(at, lambda i, k: F.when(size(i, k) == 2, two(i)).when(size(i, k) == 3, three(i)).otherwise(more(i, k)))


def _links(tokens: Column, at: Column) -> Column:
    return F.transform(at, lambda i: F.shiftleft(_id(F.get(tokens, i - 1)), 32).bitwiseOR(_id(F.get(tokens, i))))


def aligned(tokens: DataFrame) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_single - long, groups - string ``a1,a2|b1;a3|b2,b3``, links - array of long: both ids, the second from bit 0 on, the first from bit 32 on).

    ``tokens``: see ``tokenised``. A group lies between two places where tokens of both end; ``n_single`` groups have one
    token of each. A link is a pair of tokens that end together, and the k-th link closes the k-th group. Tokens
    without bytes do not exist, so ends ascend.
    """
    row, at, since = F.col("tokens"), F.col("at"), F.col("since")
    met = tokens.select("doc_id", "n_a", "n_b", "tokens", _cuts(row).alias("at")).select("*", _since(at).alias("since"))
    single = F.size(F.filter("at", lambda i, k: i - F.get(since, k) == 2))
    long = lambda c: F.col(c).cast("long").alias(c)
    return met.select("doc_id", long("n_a"), long("n_b"), F.size("at").cast("long").alias("n_groups"), single.cast("long").alias("n_single"), F.array_join(_texts(row, at, since), ";").alias("groups"), _links(row, at).alias("links"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def aligned_parts(batches: DataFrame) -> DataFrame:
    """What ``aligned`` gives, of ``batches``, see ``parted``: the different parts are aligned once, in a row, and a text's parts put together."""

    def of_part(texts: Column, links: Column, stops: Column) -> Column:
        since = lambda k: F.coalesce(F.get(stops, k - 1), F.lit(-1))
        own = lambda of, stop, k: F.slice(of, since(k) + 2, stop - since(k))
        single = lambda groups: F.size(F.filter(groups, lambda x: ~F.contains(x, F.lit(","))))
        return F.transform(stops, lambda stop, k: F.struct(F.array_join(own(texts, stop, k), ";").alias("groups"), single(own(texts, stop, k)).alias("n_single"), own(links, stop, k).alias("links")))

    def of_text(doc: Column, parts: Column) -> Column:
        each = lambda name: F.transform(doc["parts"], lambda k: F.get(parts, k)[name])
        single = F.aggregate(each("n_single"), F.lit(0), lambda n, x: n + x)
        return F.struct(*[doc[c].alias(c) for c in ("doc_id", "n_a", "n_b")], F.array_join(each("groups"), ";").alias("groups"), single.alias("n_single"), F.flatten(each("links")).alias("links"))

    tokens = F.col("tokens")
    # Groups that close a part.
    stops = lambda at: F.filter(F.transform(at, lambda i, k: F.when(F.get(tokens, i).bitwiseAND(_STOP) != 0, k).otherwise(-1)), lambda k: k >= 0)
    parts = _bound(_cuts(tokens), lambda at: _bound(_since(at), lambda since: _bound(_texts(tokens, at, since), lambda texts: _bound(_links(tokens, at), lambda links: _bound(stops(at), lambda k: of_part(texts, links, k))))))
    found = batches.select(F.inline(_bound(parts, lambda own: F.transform("docs", lambda doc: of_text(doc, own)))))
    return found.select("doc_id", "n_a", "n_b", F.size("links").cast("long").alias("n_groups"), F.col("n_single").cast("long").alias("n_single"), "groups", "links")


def scored(documents: DataFrame, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """``documents``, rows with ``links`` (see ``aligned``), with n_links, n_best and count_sum (long) in place of them.

    A pair's count: its links in all documents. ``n_best``: a document's links whose count is the highest of their B id, ties
    included; ``count_sum``: the sum of its links' counts. Pairs that hold one in ``common_pairs`` of all links are
    that many at most and are broadcast; all others are joined by a shuffle, none of them with more links than that.
    """
    rows = written(documents.withColumn("row", F.monotonically_increasing_id()), "alignment-rows")
    links = rows.select("row", F.explode("links").alias("pair"))
    pairs = written(links.groupBy("pair").agg(F.count("*").alias("n")).withColumn("b", F.col("pair").bitwiseAND(_SECOND - 1)), "alignment-pairs")
    top = pairs.groupBy("b").agg(F.max("n").alias("top"))  # a row for each id of a vocabulary
    ranked = written(pairs.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best")), "alignment-ranked")
    total = ranked.agg(F.sum("n")).first()[0] or 0
    is_common = F.col("n") * common_pairs >= total
    common, rest = F.broadcast(ranked.where(is_common)), ranked.where(~is_common)
    sums = lambda x: x.groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    seldom = links.join(common.select("pair"), "pair", "left_anti")
    both = sums(links.join(common, "pair")).unionByName(sums(seldom.join(rest, "pair")))
    of = both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    discard(pairs)
    out = rows.select(*[c for c in rows.columns if c != "links"], F.size("links").cast("long").alias("n_links")).join(of, "row", "left")
    return out.drop("row").na.fill(0, ["n_best", "count_sum"])


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of all documents under a byte-level and a piece vocabulary, and the counts of their linked pairs."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    batches = parted(docs, *[public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")])
    groups = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    out = scored(aligned_parts(batches).withColumn("groups_sha256", groups).drop("groups"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_single")


QUERIES = {"op12_token_alignment": op12_token_alignment}
ORACLES: dict[str, str] = {}
