"""Labels of single lines: what the field learns from, and what it then decides."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from driftloom.llm import quality_rules as Q


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_line_hashes():
    at, around, again = Q.line_hashes("a\n \nb\na\nb\r\n\na")
    assert len(at) == 5 and at[0] == at[2] == at[4] and len(set(at.tolist())) == 3
    assert again.tolist() == [False, False, True, False, True]
    assert around[1] == around[3] and len(set(around.tolist())) == 4  # both stand between two lines "a"
    assert all(len(x) == 0 for x in Q.line_hashes(None)) and all(len(x) == 0 for x in Q.line_hashes(" \n\t"))


def test_shared_lines_by_brute_force(spark):
    r = random.Random(3)
    texts = ["\n".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(6))) for _ in range(200)] + ["copy\nof one"] * 500 + [None, ""]
    seen: dict[str, set] = {}
    for lines in ([x for x in (t or "").split("\n") if x] for t in texts):
        for before, line, after in zip(["", *lines], lines, [*lines[1:], ""], strict=False):
            seen.setdefault(line, set()).add((before, after))
    asked = sorted(seen)[::2]
    want = {int(Q.line_hashes(x)[0][0]) for x in asked if len(seen[x]) >= 30}
    got = Q.shared_lines(docs_of(spark, texts), np.array([Q.line_hashes(x)[0][0] for x in asked]), 30)
    assert want and got.tolist() == sorted(want)
    assert not len(Q.shared_lines(docs_of(spark, texts), np.zeros(0, np.int64)))
    assert not len(Q.shared_lines(docs_of(spark, texts).limit(0), got))


def test_gradients_with_a_label_a_line():
    rng = np.random.default_rng(9)
    f = Q.Field(rng.normal(size=(Q.N_FEATURES, 2)), rng.normal(size=(2, 2)))
    lengths, x, weight = np.array([5, 3, 1]), rng.normal(size=(9, Q.N_FEATURES)), rng.random(3)
    y = np.array([1, 0, 0, 1, 1, 0, 1, 0, 1])
    value, at = 0.0, 0
    for n, w in zip(lengths, weight, strict=True):
        score = lambda q: sum(x[at + t] @ f.emit[:, k] for t, k in enumerate(q)) + sum(f.move[a, b] for a, b in itertools.pairwise(q))  # noqa: E731,B023
        value += w * (np.logaddexp.reduce([score(q) for q in itertools.product((0, 1), repeat=int(n))]) - score(y[at : at + n]))
        at += n
    got, g_emit, g_move = f.loss(x, lengths, y, weight)
    assert got == pytest.approx(value)
    for values, g in ((f.emit, g_emit), (f.move, g_move)):
        for k in itertools.islice(np.ndindex(values.shape), 8):
            out = []
            for step in (1e-5, -2e-5):
                values[k] += step
                out.append(f.loss(x, lengths, y, weight)[0])
            values[k] += 1e-5
            assert (out[0] - out[1]) / 2e-5 == pytest.approx(g[k], abs=1e-6)


def test_most_mixed_documents_get_both_labels(spark):
    """Documents of the table that hold shared lines or lines again beside others: the field parts them."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    field = Q.learn(docs, labels)
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    rows = [r for r in docs.select("doc_id", "text").collect() if r.doc_id not in bad]
    every = np.unique(np.concatenate([Q.line_hashes(r.text)[0] for r in rows]))
    shared = Q.shared_lines(docs, every)
    mixed, both, found, n = 0, 0, 0, 0
    for r in rows:
        at, _, again = Q.line_hashes(r.text)
        gold, label = again | np.isin(at, shared), field.decode(Q.line_features(r.text, field.known)[0])
        if 0 < gold.sum() < len(gold):
            mixed, both = mixed + 1, both + (0 < label.sum() < len(label))
        found, n = found + ((label == 0) & gold).sum(), n + gold.sum()
    print(mixed, both, found, n)
    assert mixed > 100 and both > 0.8 * mixed and found > 0.85 * n


def test_a_very_long_chain(spark):
    field = Q.learn(docs_of(spark, []), spark.createDataFrame([], "doc_id long, quality int"))
    text = "\n".join(f"line {k} is one of very many that this document has." for k in range(60_000))
    row = Q.apply_rules(docs_of(spark, [text]), field).first()
    assert row.n_words == 660_000 and row.content_share == 1.0


def test_all_labelled_documents_teach(spark, monkeypatch):
    """2,300 short ones and one of 600 lines; the weights are those at which the gradient over all of them vanishes."""
    r = random.Random(8)
    texts = ["\n".join(r.choice(["Prose that ends well.", "| a | b |", "MENU !!"]) + f" {r.random()}" for _ in range(r.randrange(1, 4))) for _ in range(2300)] + ["\n".join(f"line {k}" for k in range(600))]
    labels = spark.createDataFrame([(k, k % 2) for k in range(len(texts))], "doc_id long, quality int")
    seen, fitted = [], Q._fitted
    monkeypatch.setattr(Q, "_fitted", lambda blocks, field: seen.append(sum(r.chains for r in blocks.collect())) or fitted(blocks, field))
    monkeypatch.setattr(Q, "BLOCK", 900)
    field = Q.learn(docs_of(spark, texts), labels)
    assert seen == [len(texts)]
    chains = sorted(((Q.line_features(t, field.known)[0].astype("f4").astype(float), k % 2) for k, t in enumerate(texts)), key=lambda c: -len(c[0]))
    lengths = np.array([len(x) for x, _ in chains])
    _, emit, move = field.loss(np.concatenate([x for x, _ in chains]), lengths, np.array([y for _, y in chains]), 1 / (len(chains) * lengths))
    assert max(abs(emit + 1e-3 * field.emit).max(), abs(move + 1e-3 * field.move).max()) < 1e-4


def test_more_shared_lines_than_are_broadcast(spark, monkeypatch):
    texts = [f"start {k}\nshared line\nend {k}" for k in range(20)] + [f"other {k}" for k in range(20)] + [None, "", "shared line"]
    docs, labels = docs_of(spark, texts), spark.createDataFrame([(k, 1) for k in range(0, 40, 3)], "doc_id long, quality int")
    few = Q.learn(docs, labels)
    monkeypatch.setattr(Q, "MOST_KNOWN", 0)
    many = Q.learn(docs, labels)
    assert len(few.known) == 1 and many.known is None and np.allclose(few.emit, many.emit, atol=1e-6)
    rows = [sorted(map(tuple, Q.apply_rules(docs, f).collect())) for f in (few, many)]
    assert rows[0] == rows[1] and len(rows[0]) == len(texts)


def shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_are_not_shuffled_to_learn(spark):
    """Whether or not the labels are few enough to be broadcast: their number grows with the documents."""
    r = random.Random(4)
    texts = ["\n".join(r.randbytes(400).hex() for _ in range(4)) for _ in range(600)]
    docs, labels = docs_of(spark, texts).repartition(4).localCheckpoint(), spark.createDataFrame([(k, k % 2) for k in range(0, 600, 2)], "doc_id long, quality int")
    before, key = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), "spark.sql.autoBroadcastJoinThreshold"
    sent, fields = [], []
    try:
        for most in ("-1", before):
            spark.conf.set(key, most)
            start = shuffled(spark)
            fields.append(Q.learn(docs, labels))
            sent.append(shuffled(spark) - start)
    finally:
        spark.conf.set(key, before)
    assert 0 < sent[0] < 0.25 * sum(map(len, texts)) and abs(sent[1] - sent[0]) < 0.2 * sent[0]
    assert np.allclose(fields[0].emit, fields[1].emit, atol=1e-4)


def test_features_count_all_characters():
    r, alphabet = random.Random(5), "aB9 .!|#*$%&<>\tÄßДяÉ日ǅⅣ😀\ud800\x0b\x1c"
    for _ in range(500):
        line = "".join(r.choice(alphabet) for _ in range(r.randrange(1, 30)))
        x, _ = Q.line_features(line)
        if len(x):
            size = len(line)
            want = [8 * sum(map(line.count, Q.SYMBOLS)), 8 * line.count("!"), 2 * sum(map(str.isupper, line))]
            assert x[0, 3:6].tolist() == [min(1.0, n / size) for n in want]
            assert x[0, 9] == min(1.0, 8 * sum(map(line.count, "0123456789")) / size)
