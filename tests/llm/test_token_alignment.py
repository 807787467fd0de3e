"""Alignment against both tokenizers over whole texts and groups found one by one."""

import hashlib
import os
import random
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftloom.llm import token_alignment as T

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
ODD = [
    None, "", " ", "a", "one two", " leading", "trailing ", "two  spaces", "line\nline\n\n  indented\tend\n", "ünï çödé — 日本語 текст", "<|endoftext|> <s> </s> <unk> <0x41>",
    "▁mark", "a▁b", "don't they'll I'M 3'4", "\x1cfour\x1d \x1f", "no break em　wide", "é combining ﬁ ligature ①", "😀😀 emoji‍", "\r\n\r\n x", "1234567890 12 3", "x" * 50, "word " * 500 + "end", "...!!! ??",
]


@pytest.fixture(scope="module")
def exact():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[2])


def brute_tokens(exact, encoders, text):
    a, b = exact
    if not text:
        return [], []
    x, y = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    for ids, e in ((x, encoders[0]), (y, encoders[1])):
        if b"".join(e.pieces[k] for k in ids) != f" {text}".encode():
            return [], []
    return x, y


def brute(exact, rows):
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by walking both lists."""
    encoders = T.encoders(*PATHS)
    found, out = [], []
    for _, text in rows:
        x, y = brute_tokens(exact, encoders, text)
        ends, groups, links = [], [], []
        for ids, e in ((x, encoders[0]), (y, encoders[1])):
            at, own = 0, []
            for k in ids:
                at += len(e.pieces[k])
                own.append((at, k))
            ends.append(own)
        i = j = 0
        cuts = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        for c in cuts:
            left, right = [], []
            while i < len(x) and ends[0][i][0] <= c:
                left.append(x[i])
                i += 1
            while j < len(y) and ends[1][j][0] <= c:
                right.append(y[j])
                j += 1
            groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
            links.append((left[-1], right[-1]))
        found.append((x, y, groups, links))
    n = Counter(p for f in found for p in f[3])
    top = {}
    for (_, b), c in n.items():
        top[b] = max(top.get(b, 0), c)
    for (doc_id, _), (x, y, groups, links) in zip(rows, found, strict=True):
        out.append((doc_id, len(x), len(y), len(groups), len(links), sum(n[p] == top[p[1]] for p in links), sum(n[p] for p in links), ";".join(groups)))
    return out


def ours(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("row", "a", "B", "links", "groups", "n", "cuts", "merged", "tokens", "pair"):
        docs = docs.withColumn(c, F.lit("x"))
    out = T.scored(T.aligned(T.tokenised(docs, *PATHS)), **options)
    return [tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()]


@pytest.mark.parametrize("common_pairs", [1 << 18, 40, 0])
def test_equals_a_walk_over_both_lists(spark, exact, common_pairs):
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()] if os.path.exists("/root/testdata") else []
    rows = [(k, t) for k, t in enumerate([*ODD, *texts])] + [(1, "one two"), (None, "null id"), (None, None)]
    assert sorted(ours(spark, rows, common_pairs=common_pairs), key=repr) == sorted(brute(exact, rows), key=repr)


def test_encoders_give_the_libraries_ids(exact):
    """Both encoders against the libraries on whole texts, of odd characters in any order."""
    a, b = T.encoders(*PATHS)
    rng = random.Random(7)
    alphabet = ["a", "B", "the", "ing", " ", " ", "  ", "\n", "\t", "'s", "'", ".", ",", "9", "é", "日", "😀", " ", " ", "▁", "\x1f", "<s>", "<0x0A>", "<|endoftext|>", "\r\n", "ﬁ", "́", "-"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 24)))
        for mine, whole, given in ((a, exact[0].encode(f" {text}", add_special_tokens=False).ids, f" {text}"), (b, exact[1].encode(text), text)):
            same = b"".join(mine.pieces[k] for k in whole) == f" {text}".encode()
            got = mine(given)
            assert (None if got is None else got.tolist()) == (whole if same else None), repr(text)


def test_pieces_have_the_bytes_of_their_entries(exact):
    """The byte-level entries, decoded by the usual rule: printable bytes stand for themselves, the others for characters from 256 on."""
    a, b = T.encoders(*PATHS)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    entries = exact[0].get_vocab(with_added_tokens=False)
    entries.pop("<|endoftext|>", None)
    assert {k: bytes(of[c] for c in piece) for piece, k in entries.items()} == dict(enumerate(a.pieces))
    assert b.pieces[3] == b"\x00" and b.pieces[258] == b"\xff" and len(b.pieces) == 32000


def test_no_rows(spark):
    assert ours(spark, []) == []


def test_query_hashes_groups(spark):
    got = T.op12_token_alignment(spark, "/root/testdata/sf0.001").collect()
    with_tokens = [r for r in got if r["n_a"]]
    assert with_tokens and all(len(r["groups_sha256"]) == 64 and r["n_groups"] == r["n_links"] for r in with_tokens)
    assert all(r["groups_sha256"] == "" for r in got if not r["n_a"])
    one = T.aligned(T.tokenised(spark.createDataFrame([(1, "one two")], "doc_id long, text string"), *PATHS)).first()
    assert one["groups"].count("|") == one["n_groups"] and hashlib.sha256(one["groups"].encode()).hexdigest()


def test_tokens_come_in_order_and_are_not_sorted_again(spark, exact):
    """A text's tokens ascend, so that the plan neither sorts them nor looks the cuts up in sets."""
    tokens = T.tokenised(spark.createDataFrame([(1, "one two three ünï")], "doc_id long, text string"), *PATHS)
    got = tokens.first()["tokens"]
    assert got == sorted(got) and len(got) > 6
    plan = T.aligned(tokens)._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" not in plan and "array_intersect" not in plan and "filter(" in plan


def test_groups_of_any_tokens(spark):
    """Made-up tokens: groups of one to nine on either side, single ones, none, and tokens behind the last cut."""
    rng, rows, want = random.Random(11), [], []
    for doc in range(200):
        end, made, groups, links = 0, [], [], []
        for _ in range(rng.randrange(6)):
            sides, size = ([rng.randrange(60_000) for _ in range(rng.choice((1, 1, 1, 2, 5, 9)))] for _ in range(2)), 40
            sides = list(sides)
            for k, ids in enumerate(sides):
                ends = [*sorted(rng.sample(range(end + 1 + k, end + size, 2), len(ids) - 1)), end + size]
                made += [(e << 32) | k * T._SECOND | x for e, x in zip(ends, ids, strict=True)]
            end += size
            groups.append("|".join(",".join(map(str, ids)) for ids in sides))
            links.append(sides[0][-1] << 32 | sides[1][-1])
        if rng.random() < 0.3:
            made.append((end + 5) << 32 | 7)
        rows.append((doc, len(made), 0, sorted(made)))
        want.append((doc, len(groups), sum("," not in g for g in groups), ";".join(groups), links))
    got = T.aligned(spark.createDataFrame(rows, "doc_id long, n_a int, n_b int, tokens array<bigint>"))
    assert sorted(map(tuple, got.select("doc_id", "n_groups", "n_single", "groups", "links").collect())) == want


@pytest.mark.parametrize("together", [1, 2000, T.TOGETHER])
def test_parts_give_the_rows_of_whole_texts(spark, monkeypatch, together):
    monkeypatch.setattr(T, "TOGETHER", together)
    rng, alphabet = random.Random(5), ["a", "the", "ing", " ", " ", "  ", "\n", "\t", "'s", "'", ",", "9", "é", "日", "😀", " ", "▁", "<s>", "\r\n", "Thstin", "edere", "ö", "ß", "\xa0", "\x85", "\u3000", "한", "\u0301", "Ω"]
    texts = [*ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(300)), "y" * 10_050 + " end", "one ▁ two"]
    rows = [*enumerate(texts), (1, "one two"), (None, "null id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    whole, parts = T.aligned(T.tokenised(docs, *PATHS)), T.aligned_parts(T.parted(docs, *PATHS))
    assert parts.columns == whole.columns and sorted(map(tuple, parts.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_each_different_part_is_aligned_once(spark):
    """What the higher-order functions read doesn't grow with a part's repetitions."""
    one, many = (T.parted(spark.createDataFrame([(k, "Thstinnt, ünï thndhain " * n + "end") for k in range(n)], "doc_id long, text string").coalesce(1), *PATHS).first() for n in (1, 40))
    assert len(one["tokens"]) == len(many["tokens"]) and len(many["docs"]) == 40 and len(many["docs"][0]["parts"]) == 40 * 3 + 1
