"""Exact n-gram Jaccard self-join: prefix tiles by size, hashed bitmaps as a bound, sorted-array intersection.

Copies of one text are first brought together. A sketch then counts the shingles of all texts: cells that hold
more than an even share are common, and every text orders its hashes with the common ones last. It posts the first of them -
a prefix so long that two texts over the threshold share a posted hash - to the tile of each hash. A
tile's documents are sorted by set size, and only sizes that can reach the threshold meet. A short tile gives
all its pairs. A tile of more than ``SHORT`` documents gives pairs with the smallest document of each
size band alone, and its documents go on, with more of their hashes, to further rounds, in which documents that
are linked already need not meet and tiles of widely shared hashes are passed over wherever the document has
enough others. A common hash never gathers its documents in one tile: each task links its own, and passes on the
smallest of each size band alone. What is left then (documents made of widely shared shingles nearly throughout, that
are not linked yet) meets in size-banded tiles of two bitmap blocks each. No step drops a pair over the threshold.

Bitmaps are made with the postings; hashes are made anew from the texts for the few documents whose
bitmaps leave a pair open, which costs less than keeping the hashes of all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import components, discard, shuffle_partitions, small_batches, table, written
from ._text import mixed, shingle_set

#: Documents of a tile up to which all its pairs are compared: in the first round, and in further ones.
SHORT, SHORTER = 16, 16
#: Ids up to which a list of documents is broadcast; beyond, it is joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Documents of a block in the last round.
BLOCK = 2048
#: Postings that a task gathers before it hands them on.
GATHERED = 600_000
#: Postings of a bucket, in the mean. A pair is found in each bucket that holds a hash of both, and packed with others for the part that keeps it once.
POSTED = 1_000_000
#: Cells of the sketch (a byte each in every task), and those whose counts make a row.
CELLS, STRETCH = 1 << 22, 1 << 12
#: Of a document's hashes, the shares among which the further rounds look for settled tiles.
ROUNDS = (0.3, 1.0)

_POSTINGS = "bucket int, docs binary, sizes binary, groups binary, counts binary, inner binary, tokens binary"
_FOUND = "kind int, a long, b long"
_MORE = "kind int, a long, b long, docs binary, counts binary"
_SETS = "doc_id long, n int, bits binary, hashes binary"


def _prefix(n: int) -> int:
    """Hashes of which two sets of Jaccard similarity 0.8 share one: those that a partner may lack, and one."""
    return n - -(-4 * n // 5) + 1


def _needed(s, t):
    """Smallest intersection of two sets of s and t with 100 * intersection >= 80 * union."""
    return -(-4 * (s + t) // 9)


def _bits(n: int) -> int:
    return min(1 << 17, max(64, 1 << (2 * n - 1).bit_length()))


def _bitmap(hashes: np.ndarray) -> bytes:
    size = _bits(len(hashes))
    flags = np.zeros(size, np.uint8)
    flags[(hashes & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_PA_POSTINGS = pa.schema([("bucket", pa.int32()), *((k, pa.binary()) for k in ("docs", "sizes", "groups", "counts", "inner", "tokens"))])
_PARTED = "kind int, part long, a binary, b binary"
_PA_PARTED = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_PA_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
_PA_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("bits", pa.binary()), ("hashes", pa.binary())])


def _dealt(docs, sizes, groups, within, taken, n_buckets: int):
    """A batch of blocks, one a bucket: documents, their sizes and groups, and their hashes in it, how many of
    them among the document's ``within`` first."""
    lengths = np.array([len(t) for t in taken])
    token = np.concatenate(taken)
    at = np.repeat(np.arange(len(taken)), lengths)
    rank = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    early = rank < np.repeat(np.array(within), lengths)
    bucket = (token % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, at, early, token = bucket[order], at[order], early[order].astype("<i4"), (token[order] >> np.uint64(32)).astype("<u4")
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    docs, sizes, groups = np.array(docs, "<i8"), np.array(sizes, "<i4"), np.array(groups, "<i8")
    rows = [[] for _ in range(7)]
    for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(bucket)], strict=True):
        first = np.flatnonzero(np.r_[True, np.diff(at[lo:hi]) != 0])
        own = at[lo:hi][first]
        values = (int(bucket[lo]), docs[own].tobytes(), sizes[own].tobytes(), groups[own].tobytes(), np.diff(np.r_[first, hi - lo]).astype("<i4").tobytes(), np.add.reduceat(early[lo:hi], first).astype("<i4").tobytes(), token[lo:hi].tobytes())
        for r, v in zip(rows, values, strict=True):
            r.append(v)
    return _batch(_PA_POSTINGS, *rows)


def _sketched(batches):
    """How many shingles of a task's texts fall in each cell of the sketch, by stretches of cells: (stretch, counts)."""
    counts = np.zeros(CELLS, np.uint32)
    for b in batches:
        for text in b.column("text").to_pylist():
            np.add.at(counts, (shingle_set(text) & np.uint64(CELLS - 1)).astype(np.int64), 1)
    rows = counts.reshape(-1, STRETCH)
    # In as few bytes as the stretch's largest count takes.
    blobs = [x.astype(np.min_scalar_type(m)).tobytes() for x, m in zip(rows, rows.max(1), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)), pa.int32()), pa.array(blobs, pa.binary())], names=["stretch", "counts"])


def _added(t: pa.Table) -> pa.Table:
    n = sum(np.frombuffer(x, f"<u{len(x) // STRETCH}").astype(np.int64) for x in t.column("counts").to_pylist())
    return pa.table({"stretch": t.column("stretch")[:1], "counts": pa.array([n.tobytes()], pa.binary()), "total": pa.array([n.sum()], pa.int64())})


def _above(least: float):
    def cells(batches):
        for b in batches:
            for stretch, blob in zip(b.column("stretch").to_pylist(), b.column("counts").to_pylist(), strict=True):
                n = np.frombuffer(blob, "<i8")
                at = np.flatnonzero(n > least)
                rank = np.minimum(255, np.floor(np.log2(n[at] / least)) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(at + stretch * STRETCH, pa.int32()), pa.array(rank.astype(np.int32))], names=["cell", "rank"])

    return cells


def _common_cells(texts: DataFrame) -> tuple[np.ndarray, int]:
    """A class for each cell of the sketch: 0 for most, higher the more shingles it holds; and how many shingles there are.

    The sketch bounds what comes to the driver.

    Tasks' counts are added up whole, so that a shingle spread over all tasks stands out as one that a single task holds.
    Which cells are common changes only how work is dealt, not the links that are found.
    """
    # A task's counts have a fixed size, so there are not many more tasks than can run.
    few = texts.select("text").coalesce(4 * texts.sparkSession.sparkContext.defaultParallelism)
    added = few.mapInArrow(_sketched, "stretch int, counts binary").groupBy("stretch").applyInArrow(_added, "stretch int, counts binary, total long")
    held = written(added, "jaccard-sketch")
    total = held.agg(F.sum("total")).first()[0] or 0
    mean = total / CELLS
    found = held.select("stretch", "counts").mapInArrow(_above(max(SHORT, mean + 3 * math.sqrt(mean))), "cell int, rank int").toArrow()
    out = np.zeros(CELLS, np.uint8)
    out[found.column("cell").to_numpy()] = found.column("rank").to_numpy()
    discard(held)
    return out, total


def _ordered(h: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes with those of common cells last, the commonest at the end; and the ranks of their cells."""
    rank = ranks[(h & np.uint64(CELLS - 1)).astype(np.int64)]
    if not rank.any():
        return h, rank
    order = np.lexsort((h, rank))
    return h[order], rank[order]


def _stars(run, doc, size):
    """Pairs of each document with the smallest of its run that its size may link with, and the places of these smallest.

    Sorted by run (numbers from 0) and size.
    """
    key = run.astype(np.int64) << 32 | size
    first = np.flatnonzero(np.r_[True, np.diff(run) != 0]) if len(run) else np.zeros(0, np.int64)
    last, a, b, heads = np.r_[first[1:], len(run)] if len(first) else first, [], [], []
    while len(first):
        end = np.searchsorted(key, (run[first].astype(np.int64) << 32) | (size[first].astype(np.int64) * 5 // 4), side="right")
        n = end - first - 1
        a.append(np.repeat(doc[first], n))
        b.append(doc[np.arange(n.sum()) + np.repeat(first + 1 - n.cumsum() + n, n)])
        heads.append(first)
        more = end < last
        first, last = end[more], last[more]
    none = doc[:0]
    return np.concatenate(a or [none]), np.concatenate(b or [none]), np.concatenate(heads or [np.zeros(0, np.int64)])


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, the smaller id first."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    if len(a):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.r_[True, (np.diff(a) != 0) | (np.diff(b) != 0)]
        a, b = a[new], b[new]
    return a, b


def _row(bucket: int, docs=None, sizes=None, groups=None, tokens=None) -> pa.RecordBatch:
    """A block of one of the kinds that are no tile, by bucket: SIZES, PAIRS, MARKED, CELLS_SEEN or CELLS_OF."""
    blob = lambda x, kind: b"" if x is None else x if isinstance(x, bytes) else np.asarray(x, kind).tobytes()
    return _batch(_PA_POSTINGS, [bucket], [blob(docs, "<i8")], [blob(sizes, "<i4")], [blob(groups, "<i8")], [b""], [b""], [blob(tokens, "<u4")])


#: Buckets below 0. Sizes and bitmaps; pairs of a task's common hashes; documents that go on; groups by cell; cells by document.
SIZES, PAIRS, MARKED, CELLS_SEEN, CELLS_OF = -1, -2, -3, -4, -5


def _post_prefixes(n_buckets: int, ranks):
    def post(batches):
        held: list[list] = [[], [], []]  # documents, their set sizes, posted hashes
        common: list[list] = [[], [], []]
        seen: list[tuple[int, int, bytes]] = []

        def told():
            if common[0]:
                lengths = [len(h) for h in common[2]]
                doc, size, token = np.repeat(common[0], lengths), np.repeat(common[1], lengths), np.concatenate(common[2])
                order = np.lexsort((doc, size, token))
                doc, size, token = doc[order].astype("<i8"), size[order].astype("<i4"), token[order]
                run = np.cumsum(np.r_[0, np.diff(token) != 0])
                a, b, heads = _stars(run, doc, size)
                a, b = _pairs(a[a != b], b[a != b])
                yield _row(PAIRS, docs=a, groups=b)
                yield _row(MARKED, docs=np.unique(common[0]))
                # The smallest of each size band stands for its task.
                order = np.argsort(doc[heads], kind="stable")
                heads = heads[order]
                at = np.flatnonzero(np.r_[True, np.diff(doc[heads]) != 0])
                for part in np.split(heads, at[1:]):
                    held[0].append(int(doc[part[0]]))
                    held[1].append(int(size[part[0]]))
                    held[2].append(token[part])
            if held[0]:
                yield _dealt(held[0], held[1], held[0], [0] * len(held[0]), held[2], n_buckets)
            if seen:
                d, n, bits = zip(*seen, strict=True)
                yield _row(SIZES, docs=d, sizes=n, tokens=b"".join(bits))
            for x in (*held, *common, seen):
                x.clear()

        count, bytes_ = 0, 0
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                h = shingle_set(text)
                bits = _bitmap(h)
                seen.append((doc, len(h), bits))
                bytes_ += len(bits)
                if len(h):
                    h, rank = _ordered(h, ranks.value)
                    h, rank = h[: _prefix(len(h))], rank[: _prefix(len(h))]
                    rare = int(np.searchsorted(rank, 1))
                    for to, part in ((held, h[:rare]), (common, h[rare:])):
                        if len(part):
                            for x, v in zip(to, (doc, int(seen[-1][1]), part), strict=True):
                                x.append(v)
                    count += len(h)
                if count >= GATHERED or bytes_ >= 16 * GATHERED:
                    yield from told()
                    count = bytes_ = 0
        yield from told()

    return post


def _post_more(n_buckets: int, share: float, ranks):
    """The first ``share`` of the hashes and those that a partner's first ``share`` can reach: a partner is larger
    by a quarter at most, and a fifth of the document's own hashes, those it lacks, can stand before.

    Common hashes are not posted: the groups by cell of the sketch are, and the cells of each document's first hashes.
    """

    def post(batches):
        held: list[list] = [[], [], [], [], []]
        cells: list[list] = [[], [], [], []]  # documents, groups, how many first, cells

        def told():
            if held[0]:
                yield _dealt(*held, n_buckets)
            if cells[0]:
                doc, group, early, cell = cells
                lengths, of = np.array([len(c) for c in cell]), np.concatenate(cell)
                group = np.repeat(np.array(group, np.int64), lengths)
                order = np.lexsort((group, of))
                at = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0])
                yield _row(CELLS_SEEN, docs=group[order][at], groups=group[order][np.r_[at[1:], len(order)] - 1], tokens=of[order][at])
                yield _row(CELLS_OF, docs=doc, sizes=early, tokens=np.concatenate([c[:n] for c, n in zip(cell, early, strict=True)]))
            for x in (*held, *cells):
                x.clear()

        count = 0
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("doc_id", "text", "grp"))
            for doc, text, group in zip(*columns, strict=True):
                h, rank = _ordered(shingle_set(text), ranks.value)
                n, first = len(h), math.floor(share * len(h))
                h, rank = h[: math.ceil((1.25 * share + 0.2) * n) + 1], rank[: math.ceil((1.25 * share + 0.2) * n) + 1]
                rare = int(np.searchsorted(rank, 1))
                if rare:
                    for x, v in zip(held, (doc, n, group, min(first, rare), h[:rare]), strict=True):
                        x.append(v)
                if rare < len(h):
                    cell = (h[rare:] & np.uint64(CELLS - 1)).astype("<u4")
                    for x, v in zip(cells, (doc, group, max(0, first - rare), cell), strict=True):
                        x.append(v)
                count += len(h)
                if count >= GATHERED:
                    yield from told()
                    count = 0
        yield from told()

    return post


def _cells_seen(batches):
    for b in batches:
        for lo, hi, cell in zip(*(b.column(c).to_pylist() for c in ("docs", "groups", "tokens")), strict=True):
            columns = [pa.array(np.frombuffer(x, kind), t) for x, kind, t in ((cell, "<u4", pa.int64()), (lo, "<i8", pa.int64()), (hi, "<i8", pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "lo", "hi"])


def _by_part(docs: np.ndarray, counts: np.ndarray, n_parts: int):
    """Numbers of parts of the documents, and each part's documents and counts as bytes."""
    part = (mixed(docs.astype(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, docs, counts = part[order], docs[order].astype("<i8"), counts[order].astype("<i8")
    at = np.flatnonzero(np.r_[True, np.diff(part) != 0]) if len(part) else part
    ends = np.r_[at[1:], len(part)] if len(part) else part
    return part[at], [[x[lo:hi].tobytes() for lo, hi in zip(at, ends, strict=True)] for x in (docs, counts)]


def _open_cells(n_parts: int, open_):
    """(kind 2) How many of each document's first hashes lie in common cells of several groups."""

    def count(batches):
        is_open = np.zeros(CELLS, bool)
        is_open[open_.value] = True
        for b in batches:
            for docs, n, cell in zip(*(b.column(c).to_pylist() for c in ("docs", "sizes", "tokens")), strict=True):
                docs, n, cell = np.frombuffer(docs, "<i8"), np.frombuffer(n, "<i4"), np.frombuffer(cell, "<u4")
                many = np.bincount(np.repeat(np.arange(len(docs)), n), is_open[cell], len(docs)).astype(np.int64)
                part, blobs = _by_part(docs[many > 0], many[many > 0], n_parts)
                arrays = [pa.array(np.full(len(part), 2), pa.int32()), pa.array(part, pa.int64()), pa.array(np.zeros(len(part)), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(x, pa.binary()) for x in blobs], names=["kind", "a", "b", "docs", "counts"])

    return count


def _parted(kind: int, a: np.ndarray, b: np.ndarray, n_parts: int) -> list[tuple]:
    """Pairs packed by parts (kind, part, both sides as bytes): the same pair comes to the same part, wherever it is found."""
    part = (mixed(a.astype(np.uint64) * np.uint64(3) ^ mixed(b.astype(np.uint64))) % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, a, b = part[order], a[order].astype("<i8"), b[order].astype("<i8")
    of, at = np.unique(part, return_index=True)
    return [(kind, int(k), a[lo:hi].tobytes(), b[lo:hi].tobytes()) for k, lo, hi in zip(of, at, [*at[1:], len(part)], strict=False)]


def _packed(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PA_PARTED)]


def _pairs_of(n_parts: int):
    """The pairs and the documents that go on of a task's own common hashes, by parts."""

    def parted(batches):
        for b in batches:
            rows = []
            for bucket, x, y in zip(*(b.column(c).to_pylist() for c in ("bucket", "docs", "groups")), strict=True):
                x = np.frombuffer(x, "<i8")
                rows += _parted(0, x, np.frombuffer(y, "<i8"), n_parts) if bucket == PAIRS else _parted(1, x, np.zeros(len(x), "<i8"), n_parts)
            yield pa.RecordBatch.from_arrays(_packed(rows), schema=_PA_PARTED)

    return parted


def _once(t: pa.Table) -> pa.Table:
    """What a part holds, each once."""
    kinds, (a, b) = t.column("kind").to_pylist(), ([np.frombuffer(x, "<i8") for x in t.column(c).to_pylist()] for c in ("a", "b"))
    pairs = [(x, y) for k, x, y in zip(kinds, a, b, strict=True) if k == 0]
    marked = np.unique(np.concatenate([np.zeros(0, "<i8"), *[x for k, x in zip(kinds, a, strict=True) if k == 1]]))
    return _found(pairs, [(1, marked, np.zeros(len(marked), np.int64))])


def _entries(t: pa.Table):
    """The postings of a bucket, sorted by hash, size and document, once each; documents with one twice; where the
    runs of a hash begin, and how long they are."""
    read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in t.column(name).to_pylist()])
    counts = read("counts", "<i4")
    rank = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    early = rank < np.repeat(read("inner", "<i4"), counts)
    doc, size, group = (np.repeat(read(n, k), counts) for n, k in (("docs", "<i8"), ("sizes", "<i4"), ("groups", "<i8")))
    token = read("tokens", "<u4")
    order = np.lexsort((doc, size, token))
    token, doc, size, group, early = token[order], doc[order], size[order], group[order], early[order]
    keep = np.r_[True, (np.diff(token) != 0) | (np.diff(doc) != 0)]
    twice = doc[~keep & early]
    token, doc, size, group, early = token[keep], doc[keep], size[keep], group[keep], early[keep]
    begin = np.flatnonzero(np.r_[True, np.diff(token) != 0])
    return token, doc, size, group, early, twice, begin, np.diff(np.r_[begin, len(token)])


def _all_pairs(token, doc, size, group, some, most: int):
    """Pairs in sorted runs of ``most`` at most whose sizes may reach the threshold, one of them in ``some``."""
    a, b = [], []
    for d in range(1, most):
        if len(token) <= d:
            break
        ok = (token[d:] == token[:-d]) & (5 * size[:-d].astype(np.int64) >= 4 * size[d:].astype(np.int64)) & (group[d:] != group[:-d])
        ok &= some[d:] | some[:-d]
        a.append(doc[:-d][ok])
        b.append(doc[d:][ok])
    return (np.concatenate(a), np.concatenate(b)) if a else (doc[:0], doc[:0])


def _found(pairs, singles) -> pa.Table:
    none = np.zeros(0, "<i8")
    a, b = _pairs(np.concatenate([p[0] for p in pairs] or [none]), np.concatenate([p[1] for p in pairs] or [none]))
    kind = np.zeros(len(a), np.int32)
    for k, docs, n in singles:
        kind, a, b = np.r_[kind, np.full(len(docs), k, np.int32)], np.r_[a, docs], np.r_[b, n]
    return pa.Table.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PA_FOUND)


def _first_round(n_parts: int):
    """Of a bucket's tiles the pairs, and the documents that go on, by parts."""
    return lambda t: pa.Table.from_arrays(_packed(_first_tiles(t, n_parts)), schema=_PA_PARTED)


def _first_tiles(t: pa.Table, n_parts: int) -> list[tuple]:
    token, doc, size, group, _, _, begin, length = _entries(t)
    few = np.repeat((length > 1) & (length <= SHORT), length)
    pairs = [_all_pairs(token[few], doc[few], size[few], group[few], few[few], SHORT)]
    many = np.repeat(length > SHORT, length)
    run = np.cumsum(np.r_[0, np.diff(token[many]) != 0])[: many.sum()]
    pairs.append(_stars(run, doc[many], size[many])[:2])
    hot = np.unique(doc[many])
    a, b = _pairs(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
    return [*_parted(0, a, b, n_parts), *_parted(1, hot, np.zeros(len(hot), np.int64), n_parts)]


def _further_round(n_parts: int):
    """Pairs, and (kind 2) for each of ``n_parts`` parts of the documents how many of their first hashes have no
    settled tile here: a short one, or of one group. The counts of a part are one row, in arrays.

    Pairs count only where one of the two has the hash among its first: that is where a settled one finds its partner.
    """

    def meet(t: pa.Table) -> pa.Table:
        token, doc, size, group, early, twice, begin, length = _entries(t)
        one = np.minimum.reduceat(group, begin) == np.maximum.reduceat(group, begin)
        few = np.repeat((length > 1) & (length <= SHORTER) & ~one, length)
        pairs = _found([_all_pairs(token[few], doc[few], size[few], group[few], early[few], SHORTER)], [])
        open_, n = np.unique(np.r_[twice, doc[early & np.repeat((length > SHORTER) & ~one, length)]], return_counts=True)
        part, blobs = _by_part(open_, n, n_parts)
        none = [None] * pairs.num_rows
        columns = [np.r_[pairs.column("kind"), np.full(len(part), 2)], np.r_[pairs.column("a"), part], np.r_[pairs.column("b"), np.zeros(len(part), np.int64)]]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)] + [pa.array(none + x, pa.binary()) for x in blobs]
        return pa.Table.from_arrays(arrays, names=["kind", "a", "b", "docs", "counts"])

    return meet


def _summed(t: pa.Table) -> pa.Table:
    docs, counts = (np.concatenate([np.frombuffer(x, "<i8") for x in t.column(c).to_pylist()]) for c in ("docs", "counts"))
    doc, at = np.unique(docs, return_inverse=True)
    n = np.bincount(at, counts).astype(np.int64)
    return pa.Table.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "unsettled"])


def _bounded(batches):
    """Pairs whose bitmaps leave room for the intersection that they need."""
    for b in batches:
        a_, b_ = [], []
        for r in b.to_pylist():
            x, y = np.frombuffer(r["bits_a"], np.uint8), np.frombuffer(r["bits_b"], np.uint8)
            size = min(len(x), len(y))
            x, y = _folded(x, size), _folded(y, size)
            most = min(r["n_a"] - int(np.bitwise_count(x & ~y).sum()), r["n_b"] - int(np.bitwise_count(y & ~x).sum()))
            if most >= _needed(r["n_a"], r["n_b"]):
                a_.append(r["a"])
                b_.append(r["b"])
        yield _batch(_PA_FOUND, [0] * len(a_), a_, b_)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def _exact(batches):
    for b in batches:
        a_, b_ = [], []
        for r in b.to_pylist():
            x, y = np.frombuffer(r["hashes_a"], "<u8"), np.frombuffer(r["hashes_b"], "<u8")
            if _shared(x, y) >= _needed(len(x), len(y)):
                a_.append(r["a"])
                b_.append(r["b"])
        yield _batch(_PA_FOUND, [0] * len(a_), a_, b_)


def _tile(t: pa.Table) -> pa.Table:
    """Links between two blocks that join different groups: enough of them to tell which groups belong together."""
    rows = t.to_pylist()
    size = min(len(r["bits"]) for r in rows)
    bits = np.stack([_folded(np.frombuffer(r["bits"], np.uint8), size) for r in rows]).view(np.uint64)
    n = np.array([r["n"] for r in rows], np.int64)
    side = np.array([r["side"] for r in rows])
    label = np.array([r["grp"] for r in rows], np.int64)
    inner = not (side == 1).any()
    sets, found = [np.frombuffer(r["hashes"], "<u8") for r in rows], []
    for i in np.flatnonzero(side == 0):
        near = (label != label[i]) & (5 * np.minimum(n, n[i]) >= 4 * np.maximum(n, n[i]))
        near &= (np.arange(len(rows)) > i) if inner else (side == 1)
        near = np.flatnonzero(near)
        if not len(near):
            continue
        over = np.bitwise_count(bits[i] & ~bits[near]).sum(1), np.bitwise_count(bits[near] & ~bits[i]).sum(1)
        for j in near[np.minimum(n[i] - over[0], n[near] - over[1]) >= _needed(n[i], n[near])]:
            if label[i] != label[j] and _shared(sets[i], sets[j]) >= _needed(int(n[i]), int(n[j])):
                found.append((rows[i]["doc_id"], rows[j]["doc_id"]))
                label[label == label[j]] = label[i]
    a, b = np.array([x for x, _ in found], "<i8"), np.array([y for _, y in found], "<i8")
    return _found([(a, b)], [])


def _hashed(batches):
    for b in batches:
        sets = [shingle_set(x) for x in b.column("text").to_pylist()]
        yield _batch(_PA_SETS, b.column("doc_id").to_pylist(), [len(s) for s in sets], [_bitmap(s) for s in sets], [s.tobytes() for s in sets])


def _sizes(batches):
    for b in batches:
        for docs, sizes, bits in zip(*(b.column(c).to_pylist() for c in ("docs", "sizes", "tokens")), strict=True):
            docs, sizes = np.frombuffer(docs, "<i8"), np.frombuffer(sizes, "<i4")
            ends = np.cumsum([_bits(n) // 8 for n in sizes.tolist()])
            bits = [bits[lo:hi] for lo, hi in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())], names=["doc_id", "n", "bits"])


def _verified(pairs: DataFrame, sizes: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    side = lambda of, x, *cols: of.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])
    bits = pairs.join(side(sizes, "a", "n", "bits"), "a").join(side(sizes, "b", "n", "bits"), "b")
    likely = written(bits.mapInArrow(_bounded, _FOUND).select("a", "b"), f"{name}-likely")
    ids = written(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-ids")
    sets = written(_chosen(texts, ids, "left_semi").mapInArrow(_hashed, _SETS).select("doc_id", "hashes").dropDuplicates(["doc_id"]), f"{name}-sets")
    links = written(likely.join(side(sets, "a", "hashes"), "a").join(side(sets, "b", "hashes"), "b").mapInArrow(_exact, _FOUND).select("a", "b"), f"{name}-links")
    discard(likely, ids, sets)
    return links


def _chosen(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Documents (not) among ``ids``: a broadcast up to BROADCAST_IDS, a shuffled join beyond."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id long, n_shingles long, component_id long) for each row of ``docs`` (doc_id long, text string, ...).

    Two documents link when their sets of 5-word shingles have a Jaccard similarity of 0.8 or more; a
    component's id is its smallest doc_id. Texts without words, and null ones, have an empty set and link
    with nothing. Rows of one doc_id are one document: it has the links of each of its texts and the size of the largest
    set, in all its rows. A null doc_id has null in the other columns. Very long texts are taken whole (a set is held by one
    task); further columns are ignored. An empty input gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    made: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, f"jaccard-{name}"))
        return made[-1]

    keys = written(docs.select("doc_id", key.alias("key")), "jaccard-keys")
    named = keys.where("doc_id is not null")
    firsts = kept(named.groupBy("key").agg(F.min("doc_id").alias("rep")), "firsts")
    # Documents of several texts: each text has a vertex of its own, and they are linked.
    several = kept(named.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("doc_id"), "several")
    some = not several.isEmpty()
    vertices = firsts.withColumn("v", F.col("rep"))
    if some:
        above = named.agg(F.max("doc_id")).first()[0]
        again = firsts.join(firsts.groupBy("rep").agg(F.min("key").alias("main")), "rep").where("key <> main").select("key", (above + 1 + F.monotonically_increasing_id()).alias("v"))
        again = kept(again, "again")
        vertices = kept(firsts.join(again, "key", "left").select("key", "rep", F.coalesce("v", "rep").alias("v")), "vertices")
    # A key that holds many rows: both sides are written, so that adaptive execution can split it.
    vertex_of = written(keys.join(vertices, "key").select("doc_id", "v", "rep"), "jaccard-vertices")
    others = kept(vertex_of.where("doc_id <> rep").select("doc_id").distinct(), "copies")
    if some:
        others = kept(others.union(several).distinct(), "others")
    texts = _chosen(docs.where("doc_id is not null"), others, "left_anti")
    if some:
        odd = _chosen(docs, several, "left_semi").withColumn("key", key).join(vertices, "key").where("doc_id = rep")
        texts = texts.unionByName(odd.select(F.col("v").alias("doc_id"), "text"))

    ranks, total = _common_cells(texts)
    n_buckets = max(shuffle_partitions(spark), math.ceil(_prefix(total) / POSTED))
    ranks = spark.sparkContext.broadcast(ranks)
    posted = kept(texts.mapInArrow(_post_prefixes(n_buckets, ranks), _POSTINGS), "postings")
    sizes = posted.where(f"bucket = {SIZES}").select("docs", "sizes", "tokens").mapInArrow(_sizes, "doc_id long, n int, bits binary")
    sizes = kept(sizes.dropDuplicates(["doc_id"]), "sizes")
    found = posted.where("bucket >= 0").groupBy("bucket").applyInArrow(_first_round(n_buckets), _PARTED)
    found = found.unionByName(posted.where(f"bucket in ({PAIRS}, {MARKED})").mapInArrow(_pairs_of(n_buckets), _PARTED))
    found = kept(found.groupBy("part").applyInArrow(_once, _FOUND), "first")
    links = kept(_verified(found.where("kind = 0").select("a", "b"), sizes, texts, "jaccard-first"), "links")
    left = kept(found.where("kind = 1").select(F.col("a").alias("doc_id")), "hot")

    for share in ROUNDS:
        if left.isEmpty():
            break
        left = kept(_grouped(left, links), "left")
        posted = kept(_chosen(texts, left, "inner").select("doc_id", "text", "grp").mapInArrow(_post_more(n_buckets, share, ranks), _POSTINGS), "more-postings")
        cells = posted.where(f"bucket = {CELLS_SEEN}").mapInArrow(_cells_seen, "cell long, lo long, hi long")
        cells = cells.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("cell").toArrow()
        open_ = spark.sparkContext.broadcast(cells.column("cell").to_numpy())  # a part of the sketch's common cells
        found = posted.where("bucket >= 0").groupBy("bucket").applyInArrow(_further_round(n_buckets), _MORE)
        found = kept(found.unionByName(posted.where(f"bucket = {CELLS_OF}").mapInArrow(_open_cells(n_buckets, open_), _MORE)), "more")
        more = _verified(found.where("kind = 0").select("a", "b").distinct(), sizes, texts, "jaccard-more")
        links = kept(links.unionByName(more), "links")
        discard(more)
        unsettled = found.where("kind = 2").select("a", "docs", "counts").groupBy("a").applyInArrow(_summed, "doc_id long, unsettled long")
        n = F.col("n").cast("long")
        rest = left.join(sizes.select("doc_id", "n"), "doc_id").join(unsettled, "doc_id", "left")
        rest = rest.where(F.floor(F.lit(share) * n) - F.coalesce("unsettled", F.lit(0)) < n - F.ceil(4 * n / 5) + 1)
        left = kept(rest.select("doc_id"), "left")
    if not left.isEmpty():
        rest = kept(_chosen(texts, left, "left_semi").mapInArrow(_hashed, _SETS).join(kept(_grouped(left, links), "left"), "doc_id"), "rest")
        links = links.unionByName(kept(_blocks(rest), "blocks"))

    if some:
        of_one = vertex_of.join(several, "doc_id").join(sizes.where("n > 0").select(F.col("doc_id").alias("v")), "v")
        links = links.unionByName(of_one.join(of_one.groupBy("doc_id").agg(F.min("v").alias("b")), "doc_id").select(F.col("v").alias("a"), "b"))
    roots = components(links, "jaccard")
    of = sizes.join(roots, sizes.doc_id == roots.v, "left").select(
        F.col("doc_id").alias("v"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "doc_id")).alias("root")
    )
    of = written(of, "jaccard-roots")
    out = vertex_of.join(of, "v").select("doc_id", "n_shingles", "root")
    if some:
        ids = written(several, "jaccard-several")
        whole = written(out.join(ids, "doc_id").groupBy("doc_id").agg(F.max("n_shingles").alias("n"), F.min("root").alias("r")), "jaccard-several")
        out = out.join(whole, "doc_id", "left").select("doc_id", F.coalesce("n", "n_shingles").alias("n_shingles"), F.coalesce("r", "root").alias("root"))
    discard(roots, *made)
    out = out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    nameless = keys.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless)


def _grouped(left: DataFrame, links: DataFrame) -> DataFrame:
    """The documents with the component that they are in so far."""
    roots = components(links, "jaccard-part")
    return left.join(roots, F.col("doc_id") == F.col("v"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("grp"))


def _blocks(rest: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links among documents of widely shared shingles: blocks of one size band, or of two next to each other, meet.

    A band is as wide as the ratio of sizes that can link, so a partner is in the same band or the next two.
    """
    rest = rest.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(1.25) + 1e-9).cast("int"))
    counts = {r["band"]: -(-r["count"] // block) for r in rest.groupBy("band").count().collect()}  # a band for each quarter of size
    spread = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    blocks = lambda d: F.coalesce(F.try_element_at(spread, F.col("band") + d), F.lit(0))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks(0)).cast("int"))

    def tiles(lo, hi, made):
        return F.when(lo < hi, F.transform(F.sequence(lo, hi - 1), made)).otherwise(F.array().cast(_TILES))

    tile = lambda b, i, c, j, side: F.struct(b.alias("b"), i.alias("i"), c.alias("c"), j.alias("j"), F.lit(side).alias("side"))
    band, own, zero = F.col("band"), F.col("block"), F.lit(0)
    placed = [tiles(own, blocks(0), lambda j: tile(band, own, band, j, 0)), tiles(zero, own, lambda i: tile(band, i, band, own, 1))]
    for d in (1, 2):
        placed.append(tiles(zero, blocks(d), lambda j, d=d: tile(band, own, band + d, j, 0)))
        placed.append(tiles(zero, blocks(-d), lambda i, d=d: tile(band - d, i, band, own, 1)))
    placed = rest.withColumn("t", F.explode(F.concat(*placed)))
    found = placed.select("t.*", "doc_id", "n", "grp", "bits", "hashes").groupBy("b", "i", "c", "j").applyInArrow(_tile, _FOUND)
    return found.select("a", "b")


_TILES = "array<struct<b:int,i:int,c:int,j:int,side:int>>"


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest doc_id; rows with a null doc_id stay. All columns as they are."""
    others = written(near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct(), "jaccard-rest")
    return _chosen(docs, others, "left_anti").select(*docs.columns)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLES = {
    "op3_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
  ELSE list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) END AS sh FROM w),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = s.doc_id
"""
}
