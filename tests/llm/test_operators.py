"""The operators against brute force, on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing names."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftloom.llm import (
    embedding_join,
    jaccard_join,
    language_id,
    license_scan,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    token_counts,
)
from driftloom.llm._common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **more):
    rows = [(k, t, "en", f"s{k % 3}", 0) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing names."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 3), (4, "word " * 30_000, "en", "a", 1), (5, "one two", "en", "b", 7)]
    rows += [(5, "one two", "en", "b", 7), (None, "one two three four five six", "en", "b", 7), (6, "ünï çödé — 日本語 text", None, "c", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("shard", "slot", "position", "BLOCK", "score", "hits", "words", "n", "v", "key", "row", "rep", "u", "_p", "_row", "_rank", "_first", "_R", "_key", "_plan", "_of", "_piece", "_at", "_file"):
        df = df.withColumn(c, F.lit("x"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


# --- Sharding


def test_large_draws_have_the_right_probability():
    """The probability at the mode against exact fractions, and the whole mass, at populations beyond numpy's limit."""
    from fractions import Fraction

    for good, bad, draws in ((10, 25, 12), (300, 700, 200)):
        p = draws / (good + bad)
        for k in range(max(0, draws - bad), min(good, draws) + 1, 7):
            ours = sharding._binomial(k, good, p) * sharding._binomial(draws - k, bad, p) / sharding._binomial(draws, good + bad, p)
            exact = Fraction(math.comb(good, k) * math.comb(bad, draws - k), math.comb(good + bad, draws))
            assert ours == pytest.approx(float(exact), rel=1e-9)
    for good, bad, draws in ((10**9, 15 * 10**9, 10**7), (10**11, 15 * 10**11, 10**8)):
        mode, p = (draws + 1) * (good + 1) // (good + bad + 2), draws / (good + bad)
        at = sharding._binomial(mode, good, p) * sharding._binomial(draws - mode, bad, p) / sharding._binomial(draws, good + bad, p)
        mass, up, down = at, at, at
        for k in range(60_000):
            x, y = mode + k, mode - k
            up *= (good - x) * (draws - x) / ((x + 1) * (bad - draws + x + 1))
            down *= y * (bad - draws + y) / ((good - y + 1) * (draws - y + 1))
            mass += up + down
        assert mass == pytest.approx(1, abs=1e-7)


def test_matrix_entries_are_hypergeometric():
    """The entries' means and variances over many seeds are those of a uniform shuffle."""
    rows, shards = [40, 7, 25], [18, 18, 18, 18]
    m = np.array([sharding.communication_matrix(rows, shards, s) for s in range(4000)])
    for i, n in enumerate(rows):
        mean, variance = n / 4, n * 0.25 * 0.75 * (72 - n) / 71
        assert np.allclose(m[:, i].mean(0), mean, atol=5 * math.sqrt(variance / 4000))
        assert np.allclose(m[:, i].var(0), variance, rtol=0.12)


def test_communication_matrix_margins():
    m = sharding.communication_matrix([5, 0, 17, 3], [7, 6, 6, 6], 1)
    assert [sum(r) for r in m] == [5, 0, 17, 3]
    assert [sum(c) for c in zip(*m, strict=True)] == [7, 6, 6, 6]


def test_hypergeometric_by_inversion():
    rng = np.random.default_rng(0)
    draws = [sharding._hypergeometric(rng, 2_000_000_000, 6_000_000_000, 400) for _ in range(2000)]
    assert abs(np.mean(draws) - 100) < 1 and abs(np.var(draws) - 75) < 9


def test_sharding_is_exact_and_uniform(spark):
    df = spark.range(5000).repartition(3).withColumn("text", F.col("id").cast("string"))
    from driftloom.llm._common import written

    out = sharding.shard_uniform(written(df, "t"), 7, rows_per_block=100).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append((r.slot, r.id))
    assert sorted(len(v) for v in by.values()) == [714] * 5 + [715] * 2
    for v in by.values():
        assert [s for s, _ in sorted(v)] == list(range(len(v)))
    assert sorted(r.id for r in out) == list(range(5000))
    # Neighbouring ids are spread: the rank correlation of slot and id within a shard is small.
    for v in by.values():
        ids = np.argsort(np.argsort([i for _, i in sorted(v)]))
        assert abs(np.corrcoef(ids, np.arange(len(ids)))[0, 1]) < 0.15


def test_sharding_edges(spark, tmp_path):
    odd_docs(spark).write.parquet(str(tmp_path / "d"))
    out = sharding.shard_uniform(spark.read.parquet(str(tmp_path / "d")), 16)
    assert out.count() == 8 and [c.lower() for c in out.columns].count("shard") == 1
    assert sharding.shard_uniform(empty_docs(spark), 4).count() == 0


# --- Mixing


@pytest.mark.parametrize("weights", [[1], [1, 1], [3, 5, 7], [1, 999], [10, 200, 1, 37, 99]])
def test_pfair_deviation(weights):
    order, total, count = mixing.cycle(weights), sum(weights), [0] * len(weights)
    for t, i in enumerate(order, 1):
        count[i] += 1
        assert all(abs(c - w * t / total) < 1 for c, w in zip(count, weights, strict=True))
    assert count == weights


def test_segments_keep_all_blocks():
    for weights, blocks in (([2, 3], [7, 1]), ([1, 1, 5], [4, 9, 2]), ([3], [2]), ([2, 2], [0, 3])):
        slots = []
        for i, plan in enumerate(mixing.segments(weights, blocks)):
            for b in range(blocks[i]):
                (lo, _, at, a, w, s) = next(p for p in plan if p[0] <= b < p[1])
                slots.append(at + (b - lo) // a * w + s[(b - lo) % a])
        assert sorted(slots) == list(range(sum(blocks)))


def test_mixing_rows(spark):
    rows = [(k, "t", "en", "hot" if k % 3 else None if k % 6 else "c", 0) for k in range(900)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS), block_rows=8).orderBy("position").collect()
    assert [r.position for r in out] == list(range(900)) and len({r.doc_id for r in out}) == 900
    weights = mixing.tempered({"c": 150, None: 150, "hot": 600})
    total, seen = sum(weights.values()), {}
    for t, r in enumerate(out[:480], 1):  # until the first source runs out
        seen[r.source] = seen.get(r.source, 0) + 1
        if t % 8 == 0:
            assert all(abs(seen.get(k, 0) - w / total * t) < 9 for k, w in weights.items())
    assert mixing.mix(odd_docs(spark)).count() == 8
    assert mixing.mix(empty_docs(spark)).count() == 0


# --- Components and the Jaccard join


def test_components(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(100, 1), (1, 7), (5, 5), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 10 for k in range(10, 41)} | {100: 1, 1: 1, 7: 1, 200: 200, 201: 200}
    rounds = dict(components(spark.createDataFrame(edges, "a long, b long").repartition(4), one_task=3).collect())
    assert rounds == got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute_jaccard(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_jaccard_join(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = [None, "", " \n", "a b", "A  b", "a b c", "x " * 3000, "X\n" * 2999]
    hub = [word() for _ in range(60)]
    texts.append(" ".join(hub))
    for k in range(110):  # copies that link with the hub, not with each other
        w = list(hub)
        w[k % 56 + 2] = word()
        texts.append(" ".join(w))
    passage = [word() for _ in range(40)]
    texts += [" ".join(passage + [word() for _ in range(rng.choice((3, 60, 200)))]) for _ in range(120)]
    texts += [" ".join(passage)] * 60
    chain = [word() for _ in range(80)]
    for _ in range(60):  # each is near the one before
        chain = chain[1:] + [word()]
        texts.append(" ".join(chain))
    texts += [" ".join(word() for _ in range(rng.randint(4, 400))) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_jaccard(rows)


def test_jaccard_of_widely_shared_passages(spark, monkeypatch):
    """Texts of nothing but shared passages pass through both further rounds and the blocks, split over several tiles."""
    blocks, rounds, real, grouped = [], [], jaccard_join._blocks, jaccard_join._grouped
    monkeypatch.setattr(jaccard_join, "_blocks", lambda rest: blocks.append(rest.count()) or real(rest, 40))
    monkeypatch.setattr(jaccard_join, "_grouped", lambda left, links: rounds.append(left.count()) or grouped(left, links))
    rng = random.Random(8)
    passages = [" ".join(f"{k}w{j}" for j in range(30)) for k in range(16)]
    texts = [" ".join(rng.sample(passages, rng.choice((6, 7, 8)))) for _ in range(230)]
    for k in range(0, 60, 2):
        texts[k + 1] = texts[k] + " and a few more words"
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_jaccard(rows)
    assert blocks and blocks[0] > 100 and len(rounds) == 3


def test_jaccard_of_a_shingle_in_half_of_all_texts(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    notice = " ".join(word() for _ in range(9))
    texts = [(notice + " " if k % 2 else "") + " ".join(word() for _ in range(rng.randint(3, 30))) for k in range(3000)]
    for k in range(0, 300, 3):
        texts[k + 1] = texts[k] + " end"
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_jaccard(rows)


def test_jaccard_of_a_document_with_two_texts(spark):
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve thirteen", "a text of its own that no other has")
    rows = [(2, b), (5, a), (5, b), (7, a), (9, c), (9, c + " x y"), (9, ""), (11, ""), (12, c + " x y"), (3, "alone"), (None, a)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id)
    assert got == [(2, 2, 2), (3, 1, 3), (5, 3, 2), (5, 3, 2), (7, 3, 2), (9, 7, 9), (9, 7, 9), (9, 7, 9), (11, 0, 11), (12, 7, 9)]
    assert jaccard_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).count() == 7


def test_stars_join_each_size_band():
    rng = np.random.default_rng(2)
    run, size = np.sort(rng.integers(0, 9, 200)), rng.integers(1, 60, 200)
    order = np.lexsort((size, run))
    run, size, doc = run[order], size[order], np.arange(200)
    a, b, heads = jaccard_join._stars(run, doc, size)
    pairs, at = set(), 0
    tops = []
    while at < 200:
        tops.append(at)
        end = at
        while end < 200 and run[end] == run[at] and 4 * size[end] <= 5 * size[at]:
            end += 1
        pairs |= {(at, k) for k in range(at + 1, end)}
        at = end
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == pairs and sorted(heads) == tops


def test_jaccard_edges(spark):
    rows = sorted((r.doc_id is not None, r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(odd_docs(spark)).collect() if r.doc_id is not None)
    assert [r[1:] for r in rows] == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 5), (5, 1, 5), (6, 1, 6)]
    assert jaccard_join.near_duplicates(empty_docs(spark)).count() == 0
    assert jaccard_join.keep_first(odd_docs(spark)).columns == odd_docs(spark).columns


def test_tile_links_what_belongs_together():
    rng = random.Random(1)
    base = [str(rng.random()) for _ in range(100)]
    rows = []
    for k in range(20):
        w = list(base if k < 12 else [str(rng.random()) for _ in range(100)])
        w[k] = "x"
        h = jaccard_join.shingle_set(" ".join(w))
        rows.append({"tile": 0, "side": k % 2, "doc_id": k, "n": len(h), "grp": k, "bits": jaccard_join._bitmap(h), "hashes": h.tobytes()})
    import pyarrow as pa

    found = jaccard_join._tile(pa.Table.from_pylist(rows)).to_pylist()
    linked = {x for f in found for x in (f["a"], f["b"])}
    assert linked == set(range(12)) and len(found) <= 11


# --- Embeddings


def test_embedding_join(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 8))
    x[20:60] = x[:40] + rng.normal(scale=0.12, size=(40, 8))
    x[60:70] = x[0]
    x[70] = 3 * x[1]
    rows = [(k, [float(v) for v in np.float32(v)]) for k, v in enumerate(x)]
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] * 8), (204, [None] * 8), (205, [float("inf")] + [1.0] * 7), (206, rows[0][1][:4])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_join.near_vectors(df).collect()}
    y = np.float32(x).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = (y @ y.T >= 0.95) & ~np.eye(120, dtype=bool)
    root = list(range(120))
    for _ in range(120):
        for a, b in np.argwhere(link):
            root[a] = min(root[a], root[b])
    expected = {k: (int(link[k].sum()), root[k], root[k] == k) for k in range(120)} | {k: (0, k, True) for k in range(200, 207)}
    assert got == expected
    assert embedding_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("per_pivot", [1000, 40, 8])
def test_embedding_join_through_many_cells(spark, per_pivot):
    """Clustered vectors, copies and ties through one, eight and forty cells: links, components and counts by brute force."""
    rng = np.random.default_rng(per_pivot)
    centres = rng.normal(size=(14, 7))
    x = np.float32(centres[rng.integers(0, 14, 320)] + rng.normal(scale=0.3, size=(320, 7))).astype(float)
    x[100:130] = x[0:30]
    x[130:140] = 2 * x[0:10]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += rows[5:9]  # repeated rows
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), per_pivot=per_pivot).collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (y @ y.T >= 0.95) & ~np.eye(320, dtype=bool)
    root = np.arange(320)
    for _ in range(320):
        new = np.minimum(root, np.where(link, root[None], 320).min(1))
        if (new == root).all():
            break
        root = new
    assert got == {k: (int(link[k].sum()), int(root[k]), bool(root[k] == k)) for k in range(320)}


def test_a_vector_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.001]), (3, [0.001, 1.0]), (4, [1.0, 0.0])]
    got = {r.vec_id: r.n_links for r in embedding_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == 4 and got[2] in (1, 2) and got[1] in (1, 2)


def test_cells_hold_all_within_reach():
    rng = np.random.default_rng(5)
    centres = embedding_join._unit(rng.normal(size=(12, 6)).tolist())
    x = embedding_join._unit((centres[rng.integers(0, 12, 600)] + rng.normal(scale=0.12, size=(600, 6))).tolist())
    reach = math.sqrt(0.1)
    home, there = embedding_join._near(x, centres, reach)
    a, b = np.where(x @ x.T >= 0.95)
    assert there[b, home[a]].all() and there.mean() < 0.9


# --- Quality rules


def brute_counts(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_base_counts():
    rng = random.Random(6)
    texts = [None, "", "a", "a b c d e f a b c d e", "x " * 40, "a\n\n \na\na ", "é # |\x0b<>&", "a\x1cb c"]
    texts += [" ".join(rng.choices("ab", k=rng.randint(1, 60))) for _ in range(40)]
    for t in texts:
        assert quality_rules.base_counts(t) == brute_counts(t)


@pytest.mark.parametrize("size", [4095, 4096, 5000, 6143, 8191, 50_000])
def test_capitals_of_long_lines(size):
    """All capitals count at every size, wherever they stand."""
    for line in ("A" * (size // 4) + "b" * (size - size // 4), "bbbA" * (size // 4) + "b" * (size % 4)):
        rows, _ = quality_rules.line_features(line)
        assert rows[0, 5] == 2 * (size // 4) / size


def test_field_decodes_the_best_path():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 8):
        f = quality_rules.Field(rng.normal(size=(quality_rules.N_FEATURES, 2)), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, quality_rules.N_FEATURES))
        score = lambda y: sum((x[t] @ f.emit)[y[t]] for t in range(n)) + sum(f.move[y[t - 1], y[t]] for t in range(1, n))  # noqa: E731,B023
        assert tuple(f.decode(x)) == max(itertools.product((0, 1), repeat=n), key=score)


def test_marginals_and_gradients_by_brute_force():
    rng = np.random.default_rng(6)
    f = quality_rules.Field(rng.normal(size=(quality_rules.N_FEATURES, 2)), rng.normal(size=(2, 2)))
    lengths, y = np.array([6, 4, 4, 1]), np.array([1, 0, 1, 0])
    x, weight = rng.normal(size=(15, quality_rules.N_FEATURES)), rng.random(4)
    node, pair, total = f.marginals(x, lengths)
    at = 0
    for n, z in zip(lengths, total, strict=True):
        score = x[at : at + n] @ f.emit
        paths = list(itertools.product((0, 1), repeat=int(n)))
        p = np.array([sum(score[t, k] for t, k in enumerate(q)) + sum(f.move[a, b] for a, b in itertools.pairwise(q)) for q in paths])
        assert np.logaddexp.reduce(p) == pytest.approx(z)
        p = np.exp(p - z)
        for t in range(n):
            assert node[at + t, 1] == pytest.approx(sum(w for q, w in zip(paths, p, strict=True) if q[t]))
            if t:
                assert pair[at + t, 1, 0] == pytest.approx(sum(w for q, w in zip(paths, p, strict=True) if (q[t - 1], q[t]) == (1, 0)))
        at += n
    _, g_emit, g_move = f.loss(x, lengths, y, weight)
    for values, g in ((f.emit, g_emit), (f.move, g_move)):
        for k in itertools.islice(np.ndindex(values.shape), 8):
            out = []
            for step in (1e-5, -2e-5):
                values[k] += step
                out.append(f.loss(x, lengths, y, weight)[0])
            values[k] += 1e-5
            assert (out[0] - out[1]) / 2e-5 == pytest.approx(g[k], abs=1e-6)


def test_verdict_on_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = quality_rules.op5_quality_rules(spark, d).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    print(len(good), len(bad), np.mean(good), np.mean(bad))
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.3


def test_field_learns():
    rng = np.random.default_rng(8)
    docs, labels = [], []
    for k in range(60):
        x = rng.normal(size=(int(rng.integers(1, 120)), quality_rules.N_FEATURES)) * 0.1
        x[:, 1] += k % 2
        docs.append(x)
        labels.append(k % 2)
    f = quality_rules.Field.trained(docs, labels)
    assert all((f.decode(x) == y).mean() > 0.9 for x, y in zip(docs, labels, strict=True))


def test_rules_edges(spark):
    labels = spark.createDataFrame([(4, 0, None), (5, 1, 0), (6, None, 1)], "doc_id long, quality int, toxic int")
    out = quality_rules.apply_rules(odd_docs(spark), quality_rules.learn(odd_docs(spark), labels)).collect()
    assert len(out) == 8 and all(r.base_failed and not r.kept for r in out if r.doc_id in (1, 2, 3, 4, 5))
    f = quality_rules.learn(empty_docs(spark), labels.limit(0))
    assert quality_rules.apply_rules(empty_docs(spark), f).count() == 0
    assert quality_rules.apply_rules(docs_of(spark, ["a clean line of more than ten words that stands here alone."]), f).first().kept


# --- Token counts


def test_counts_equal_the_tokenizer():
    from tokenizers import Tokenizer, models, pre_tokenizers

    rng = random.Random(9)
    for trial in range(30):
        pieces = {token_counts.MARK: -9} | {"".join(rng.choices("abc▁", k=1)[0:1]) + "".join(rng.choices("abc", k=rng.randint(0, 3))): -rng.randint(1, 9) for _ in range(12)}
        if trial % 3 == 0:
            pieces = {p: -3 for p in pieces}  # nothing but ties
        vocab = [(p, float(s)) for p, s in pieces.items()] + [("<unk>", float(min(pieces.values())))]
        t = Tokenizer(models.Unigram(vocab, unk_id=len(pieces)))
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.MARK, prepend_scheme="always", split=False)
        count = token_counts.Counter({p: 1000 * s for p, s in pieces.items()})
        for _ in range(40):
            w = ["".join(rng.choices("abcdé", k=rng.randint(1, 8))) for _ in range(rng.randint(1, 5))]
            assert count(w)[0] == len(t.encode(" ".join(w)).tokens), (pieces, w)


def test_counts_of_real_texts_equal_the_tokenizer():
    """The 32k vocabulary over whole documents, with unknown characters and odd blanks, against the usual unigram tokenizer."""
    import duckdb
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    import public_tokenizers

    pieces = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    vocab = [(p, s / 1000) for p, s in pieces.items()] + [("<unk>", min(pieces.values()) / 1000)]
    t = Tokenizer(models.Unigram(vocab, unk_id=len(pieces)))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex("[\\x20\\x09-\\x0D]+"), "removed"), pre_tokenizers.Metaspace(replacement=token_counts.MARK, prepend_scheme="always", split=False)])
    count = token_counts.Counter(pieces)
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' where text is not null").fetchall()]
    texts += ["ab\u00a0cd \u4e9c\u5516\ud7a3 x\U0001f98a\U0001f98ay", "a\x1cb\x85c", "\u2603\u2603\u2603 \U0001f98a"]
    for text in texts:
        got, expected = count(token_counts.words_of(text))[0], len(t.encode(text).tokens)
        assert got == expected, text[:100]


def test_token_counts_edges(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    out = {r.doc_id: r for r in token_counts.count_tokens(odd_docs(spark), path).collect()}
    assert (out[1].n_tokens, out[2].n_tokens, out[3].n_tokens) == (0, 0, 0) and out[4].n_words == 30_000
    assert token_counts.count_tokens(empty_docs(spark), path).count() == 0


# --- Packing


def check_packing(texts, rows, window):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by, sequences = {}, {}
    for r in rows:
        by.setdefault((r.doc_id, r.row), []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(by) == len(texts)
    for (doc, _), pieces in by.items():
        ids = [*t.encode(texts[doc] or "", add_special_tokens=False).ids, packing.END]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
    return sequences


def test_packing_round_trip(spark):
    rng = random.Random(10)
    texts = [" ".join(rng.choices(["alpha", "beta", "Γάμμα", "it's", "42", "\n", "  ", "<|endoftext|>"], k=rng.randint(0, 400))) for _ in range(60)]
    texts += [None, "", " ", "a\n", "\n\na", "x" * 9000, "tab\tand\x85odd\x1c"]
    out = packing.pack(docs_of(spark, texts), window=256, per_shard=40).collect()
    sequences = check_packing(texts, out, 256)
    partial = sum(1 for s in sequences.values() if sum(n for _, n in s) < 256)
    assert partial <= 8
    assert packing.pack(empty_docs(spark)).count() == 0
    assert packing.pack(odd_docs(spark)).select("doc_id", "row").distinct().count() == 8
    assert packing.pack(odd_docs(spark), order=F.col("n_chars")).select("doc_id", "row").distinct().count() == 8


def test_ids_equal_the_tokenizer():
    """Id for id, on all documents of the smallest table and on texts with special tokens, odd blanks and long words."""
    import duckdb
    from tokenizers import Tokenizer

    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ours = packing.tokens(*(packing._vocabulary_path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken")))
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' where text is not null").fetchall()]
    texts += ["<|endoftext|>", "a<|endoftext|>b <|endoftext|> c", "x" * 20_000, " " * 20_000, "it's we'll \u00a0 \x1c \x85 \u3000日本語 ١٢٣ \r\n\n\n", "", "e\u0301 👩‍👩‍👧 \ufffd"]
    for text in texts:
        assert ours(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packing_in_order(spark):
    """Windows follow the given order, whatever that of the rows; only a task's last window has room."""
    texts = [f"{k} " + "word " * (k % 37) for k in range(400)]
    docs = docs_of(spark, texts).withColumn("at", 1000 - F.col("doc_id")).orderBy(F.rand(1))
    rows = packing.pack(docs, window=128, per_shard=20, order=F.col("at")).collect()
    sequences = check_packing(texts, rows, 128)
    assert sum(1 for s in sequences.values() if sum(n for _, n in s) < 128) == 1
    for before, after in itertools.pairwise(sorted(sequences)):
        at = [np.mean([1000 - r.doc_id for r in rows if r.sequence_id == s]) for s in (before, after)]
        assert at[1] > at[0] - 45  # a shard of 20 rests and what is carried on


def test_lexical_order_brings_alike_rests_together(spark):
    """Shards of the lexical order lose less than half as much of the best neighbours' scores as shards at random."""
    rng = random.Random(3)
    topics = [rng.sample(range(1000, 40_000), 60) for _ in range(30)]
    rests = [np.array(rng.choices(topics[k % 30], k=40) + rng.choices(range(100), k=20), np.uint16) for k in range(1500)]
    frequency = np.zeros(1 << 16)
    for r in rests:
        frequency[np.unique(r)] += 1
    idf = packing.inverse_frequency(frequency, len(rests)).astype(np.float32)
    keys = [tuple(packing.taken_terms(r, idf, 60.0, packing._exponentials())) for r in rests]
    whole = packing.Index(rests, idf, 60.0)

    def lost(order: list[int]) -> float:
        """How much less the five best neighbours of a shard score than the five best of all."""
        out = 0.0
        for lo in range(0, len(order), 150):
            shard = order[lo : lo + 150]
            for seed in shard[::15]:
                score = whole.scores(whole.terms[seed])
                score[seed] = 0
                out += np.sort(score)[-5:].sum() - np.sort(score[shard])[-5:].sum()
        return out

    everything = list(range(len(rests)))
    assert lost(sorted(everything, key=lambda k: (keys[k], k))) < 0.5 * lost(rng.sample(everything, len(everything)))


def test_neighbours_are_alike():
    a, b = np.arange(100, 130), np.arange(200, 230)
    rests = [np.r_[a, k].astype("<u2") for k in range(5)] + [np.r_[b, k].astype("<u2") for k in range(5)]
    frequency = np.zeros(1 << 16, np.float32)
    for r in rests:
        frequency[np.unique(r)] += 1
    idf = packing.inverse_frequency(frequency, 10)
    index = packing.Index(rests, idf, 31.0)
    score = index.scores(index.terms[7])
    assert set(np.argsort(-score)[:5]) == {5, 6, 7, 8, 9}
    brute = [sum(idf[t] * 2.2 / (1 + 1.2 * (0.25 + 0.75)) for t in np.intersect1d(index.terms[7], r)) for r in rests]
    assert np.allclose(score, brute, rtol=1e-5)


def test_packing_searches_all_shards(spark):
    """Each window holds the best unused rests of the whole corpus, though every shard holds about 10 of 120."""
    rng = random.Random(7)
    topics = [[f"{c}{rng.randint(100, 999)}" for _ in range(30)] for c in "abcdefghijkl" for _ in range(1)]
    texts = [" ".join(rng.choices(topics[k % 12], k=rng.randint(10, 60))) for k in range(115)] + ["same words here"] * 5
    rows = packing.pack(docs_of(spark, texts), window=512, per_shard=10, exhaustive=True).collect()
    sequences = check_packing(texts, rows, 512)
    assert sum(1 for s in sequences.values() if sum(n for _, n in s) < 512) == 1
    encode = packing.tokens(*(packing._vocabulary_path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken")))
    rests = [np.append(encode(t), np.uint16(packing.END)) for t in texts]
    assert max(map(len, rests)) < 512
    frequency = np.zeros(1 << 16, np.float32)
    for r in rests:
        frequency[np.unique(r)] += 1
    index = packing.Index(rests, packing.inverse_frequency(frequency, len(rests)), sum(map(len, rests)) / len(rests))
    left = np.array([len(r) for r in rests])
    for s in sorted(sequences, reverse=True):
        seed, *others = sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset)
        left[seed.doc_id] -= seed.length
        score = index.scores(index.terms[seed.doc_id])
        for r in others:
            assert score[r.doc_id] >= score[left > 0].max() - 0.002
            left[r.doc_id] -= r.length
    assert not left.any()


# --- License scan


def test_license_scan(spark):
    cases = {
        "Licensed under the Apache License, Version 2.0.": ("apache", "apache,apache-2.0", 1),
        "MIT License mit-license MIT\nLicense": ("mit", "mit", 3),
        "under the GNU General Public License, version 3": ("gpl", "gpl,gpl-3.0", 1),
        "SPDX-License-Identifier: BSD-3-Clause": ("", "bsd-3-clause", 0),
        "see https://creativecommons.org/licenses/by-nc/4.0/": ("", "cc-by-nc-4.0", 0),
        "This work is licensed under CC BY-NC 4.0.": ("", "cc-by-nc-4.0", 0),
        "Lesser General Public License v2.1": ("gpl", "gpl,lgpl-2.1", 1),
        "Permission is hereby granted, free of charge, to any person obtaining a copy": ("", "mit", 0),
        "nothing to see": ("", "", 0),
        "permit licenseé": ("", "", 0),
    }
    df = docs_of(spark, list(cases))
    rows = license_scan.scan(df).orderBy("doc_id").collect()
    for (text, (base, labels, n)), r in zip(cases.items(), rows, strict=True):
        got = sorted({*(r.base["labels"] or []), *(h["label"] for h in r.hits)})
        assert (",".join(sorted(r.base["labels"] or [])), ",".join(got), r.base["places"] or 0) == (base, labels, n), text


def test_license_rules_hold_their_keywords():
    rng = random.Random(5)
    assert len(license_scan.RULES) > 200 and len({r["pattern"] for r in license_scan.RULES}) == len(license_scan.RULES)
    for r in license_scan.RULES:
        held = r["pattern"].replace("licen[cs]e", "license")
        assert any(stem in held for stem in license_scan.STEMS) or "cc by" in held, r
        parsed = re._parser.parse(r["pattern"])
        assert all(r["keyword"] in a_match(parsed, rng) for _ in range(20)), r


def a_match(parts, rng):
    """Some text that the parts of a parsed pattern match; what looks around is not heeded."""
    out = ""
    for op, x in parts:
        op = str(op)
        if op == "LITERAL":
            out += chr(x)
        elif op == "IN":
            kind, of = rng.choice(x)
            out += "7" if str(kind) == "CATEGORY" else chr(of if str(kind) == "LITERAL" else of[0])
        elif op == "ANY":
            out += "x"
        elif op == "BRANCH":
            out += a_match(rng.choice(x[1]), rng)
        elif op == "SUBPATTERN":
            out += a_match(x[-1], rng)
        elif op == "MAX_REPEAT":
            out += "".join(a_match(x[2], rng) for _ in range(rng.randint(x[0], min(x[1], x[0] + 1))))
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op
    return out


def test_license_gate_shuts_out_no_match(spark):
    """Whatever a rule matches alone has a hit in the scan, if no other word stands by it."""
    rng, texts = random.Random(8), []
    for r in license_scan.RULES:
        made = {a_match(re._parser.parse(r["pattern"]), rng) for _ in range(12)}
        made = sorted(t for t in made if re.search(r["pattern"], f" {t} "))
        assert made, r
        texts += made
    texts += ["Released under the MIT.", "distributed under\nMIT terms", "Licence: MIT"]
    rows = license_scan.scan(docs_of(spark, texts)).select("text", F.size("hits").alias("n")).collect()
    assert [r.text for r in rows if not r.n] == []


def test_license_needs_more_than_mit(spark):
    rows = license_scan.scan(docs_of(spark, ["wir gehen mit dem Hund", "mit permission", "the MIT licence"])).orderBy("doc_id").collect()
    assert [[h["label"] for h in r.hits] for r in rows] == [[], [], ["mit"]]


def brute_hits(text):
    """All detections in the text's words, and those that stay, by comparing each with all others."""
    norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) + " "
    hits = [(m.start(), m.end(), r["priority"], r["rule"], r["label"]) for r in license_scan.RULES for m in re.finditer(r["pattern"], norm)]
    inside = lambda g, h: g[0] <= h[0] and g[1] >= h[1] and (g[2] < h[2] or (g[2] == h[2] and (g[:2] != h[:2] or g[3] < h[3])))
    return [h for h in hits if not any(inside(g, h) for g in hits)]


def test_license_suppression(spark):
    r = license_scan.scan(docs_of(spark, ["licensed under the mit license"])).first()
    assert [h["label"] for h in r.hits] == ["mit"]  # the notice covers the name
    assert license_scan.scan(odd_docs(spark)).count() == 8
    assert license_scan.scan(empty_docs(spark)).count() == 0
    rng = random.Random(12)
    parsed = [re._parser.parse(r["pattern"]) for r in license_scan.RULES]
    texts = [" ".join(a_match(rng.choice(parsed), rng) if rng.random() < 0.6 else rng.choice(("the", "or,\n", "MIT", "License", "GNU", "KELVIN \u212a", "İ")) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    texts.append(" ".join(["Licensed under the Apache License, Version 2.0 or the GNU General Public License v3."] * 300))
    for text, r in zip(texts, license_scan.scan(docs_of(spark, texts)).orderBy("doc_id").collect(), strict=True):
        assert sorted((h["start"], h["stop"], h["priority"], h["rule"], h["label"]) for h in r.hits) == sorted(brute_hits(text)), text


def test_license_scan_of_a_long_text_takes_time_in_proportion(spark):
    import time

    notice = "Licensed under the Apache License, Version 2.0 and the MIT license.\n"
    took = []
    for n in (20, 2000, 8000):
        df = docs_of(spark, [notice * n]).cache()
        df.count()
        start = time.time()
        assert license_scan.scan(df).select(F.size("hits")).first()[0] == 2 * n
        took.append(time.time() - start)
    assert took[2] < 8 * max(took[1], 1)


def test_license_scan_stands_what_comes_after_it(spark):
    """A filter, an order, a join and a count on the result take about as long as the result: nothing is put into them again."""
    import time

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = license_scan.op8_license_scan(spark, "/root/testdata/sf0.01")
    plain = out.count()
    start = time.time()
    labelled = out.where("labels <> ''")
    n = labelled.count()
    assert 0 < n < plain
    assert len(labelled.orderBy("score", "doc_id").collect()) == n
    assert labelled.join(docs, "doc_id").count() == n
    assert sum(r["count"] for r in out.groupBy("labels").count().collect()) == plain
    assert 0 < license_scan.scan(docs).where(F.size("hits") > 0).count() <= n
    assert time.time() - start < 120


def test_license_contract_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in license_scan.op8_license_scan(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for doc, text in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(k, label) for k in range(len(words)) for p, label in phrases.items() if tuple(words[k : k + len(p)]) == p]
        base = sorted({label for _, label in at})
        labels = sorted({*base, *(h[4] for h in brute_hits(text))})
        r = got[doc]
        assert (r.n_words, r.n_base, r.base_labels, r.labels) == (len(words), len(at), ",".join(base), ",".join(labels))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(brute_hits(text))


# --- Classifiers


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    p = language_id.learn(docs_of(spark, ["hello there my friend"] * 3))
    out = {r.doc_id: r for r in language_id.identify(odd_docs(spark).withColumn("text", F.when(F.col("doc_id") == 5, "12 !").otherwise(F.col("text"))), p).collect()}
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (1, 2, 3, 5)) and out[6].lang_pred == "en"
    assert language_id.learn(empty_docs(spark)) == {}
    assert language_id.identify(docs_of(spark, ["abc"]), {}).first().lang_pred == "und"
    assert language_id.keep_identified(odd_docs(spark), p).columns == odd_docs(spark).columns


def test_quality_classifier(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_classifier.op10_quality_classifier(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_quality_scores_are_calibrated(spark):
    """Over held-out documents, mean scores and shares of label 1 are near each other, in all and where the model is sure."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = quality_classifier.op10_quality_classifier(spark, d).join(labels, "doc_id").where("held_out").select("score", "quality").collect()
    s, y = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    assert abs(s.mean() - y.mean()) < 0.03 and np.mean((s >= 0.5) == y) > 0.95
    for part in (s < 0.2, s > 0.8):
        assert abs(s[part].mean() - y[part].mean()) < 0.05


def test_contexts_by_brute_force(spark):
    texts = ["a b c a d", "b a", "", None, "d d d e"]
    words, counts = quality_classifier.word_vectors(docs_of(spark, texts))
    index, of = quality_classifier.index_vectors(quality_classifier.index_places()), lambda w: int(quality_classifier.buckets_of(w)[0])
    expected = np.zeros_like(index)
    for text in texts:
        tokens = (text or "").split()
        for i, w in enumerate(tokens):
            for j in range(max(0, i - 2), min(len(tokens), i + 3)):
                if i != j:
                    expected[of(w)] += index[of(tokens[j])]
    expected /= np.maximum(np.linalg.norm(expected, axis=1, keepdims=True), 1e-6)
    assert np.allclose(words, expected, atol=1e-5) and counts[of("d")] == 4 and counts.sum() == 11


def test_buckets_are_those_of_words_and_need_no_word_one_by_one(monkeypatch):
    """Against the words' regular expression; words that are all different take less time than the expression and a look-up each."""
    import re
    import time

    word = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
    for text in ("a_b\x1cc d1.. x", "é́  b ²½٣x三", "_", "", "  ", "a b " * 50):
        tokens = word.findall(text)
        buckets = quality_classifier.buckets_of(text).tolist()
        assert buckets == [int(quality_classifier.buckets_of(w)[0]) for w in tokens]
        monkeypatch.setattr(quality_classifier, "STRETCH", 5)
        assert buckets == quality_classifier.buckets_of(text).tolist()
        monkeypatch.undo()
    text = " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)}end" for k in range(200_000))
    took = []
    for f in (quality_classifier.buckets_of, lambda t: [xxhash.xxh3_64_intdigest(w.encode()) for w in word.findall(t)]):
        began = time.process_time()
        f(text)
        took.append(time.process_time() - began)
    assert took[0] < took[1]


def test_quality_edges(spark):
    labels = spark.createDataFrame([(4, 0), (5, 1), (6, None), (None, 1)], "doc_id long, quality int")
    m = quality_classifier.learn(odd_docs(spark), labels)
    out = quality_classifier.score(odd_docs(spark), m).collect()
    assert len(out) == 8 and all(0 <= r.score <= 1 for r in out)
    m = quality_classifier.learn(empty_docs(spark), labels.limit(0))
    assert quality_classifier.score(docs_of(spark, ["x", None]), m).count() == 2
    assert quality_classifier.score(empty_docs(spark), m).count() == 0


# --- Pipeline


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "jaccard_join", "mixing", "packing"]
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, d), "t")
        if k < 4:
            assert docs.columns == columns and docs.count() <= before.count()
        if k == 3:
            assert docs.exceptAll(before).count() == 0 and docs.count() == before.count()
        if k == 2:
            expected = {d_ for d_, (_, root) in brute_jaccard([(r.doc_id, r.text) for r in before.collect()]).items() if d_ == root}
            assert {r.doc_id for r in docs.collect()} == expected
        if k == 3:
            placed = mixing.written_position(docs).select("doc_id", "position")
            expected = mixing.mix(before).select("doc_id", "position")
            assert placed.exceptAll(expected).count() == 0
        if k == 4:
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}


def test_pipeline_stages_on_odd_tables(spark):
    import corpus_pipeline

    odd = corpus_pipeline.written(odd_docs(spark), "odd")
    for docs in (odd, corpus_pipeline.written(empty_docs(spark), "empty")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "/root/testdata/sf0.001")
            if k < 4:
                assert out.columns == docs.columns
            assert out.count() >= 0


def test_language_stage_rejects_what_is_in_no_language(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    junk = docs_of(spark, ["12 34 +++ 99", "", None, "zqx " * 400]).withColumn("doc_id", F.col("doc_id") + 10_000_000).withColumn("lang", F.lit(None).cast("string"))
    prototypes = language_id.learn(docs)
    kept = language_id.keep_identified(docs.unionByName(junk.select(*docs.columns)), prototypes)
    assert kept.where("doc_id >= 10000000").count() == 0
    clean = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").join(docs, "doc_id")
    assert kept.join(clean.select("doc_id"), "doc_id").count() >= 0.98 * clean.count()
    unlabelled = language_id.keep_identified(docs.withColumn("lang", F.lit(None).cast("string")), prototypes).join(docs.select("doc_id", F.col("lang").alias("real")), "doc_id")
    assert unlabelled.where("lang = real").count() >= 0.97 * unlabelled.count()
