"""Renames, lineages, commit orders and trees against walks over small lists."""

import random

import pytest
from pyspark.sql import functions as F

from driftloom.operators import commits, history, rounds, sampling, selection, similar_sets
from driftloom.operators.similar_sets import candidate_pairs

CHANGES = "repo string, commit long, path string, status string, blob string, chunks array<string>"


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


# --- Renames and lineages


def brute_renames(rows, least):
    out = []
    for key in {(r[0], r[1]) for r in rows}:
        gone = sorted((r for r in rows if r[:2] == key and r[3] == "D"), key=lambda r: r[2])
        come = sorted((r for r in rows if r[:2] == key and r[3] == "A"), key=lambda r: r[2])
        used = set()
        for b in {r[4] for r in gone if r[4] is not None}:
            for g, c in zip([r for r in gone if r[4] == b], [r for r in come if r[4] == b]):
                out.append((*key, g[2], c[2], 1.0))
                used |= {("D", g[2]), ("A", c[2])}
        like = {}
        for g in gone:
            for c in come:
                x, y = set(g[5] or ()), set(c[5] or ())
                if ("D", g[2]) in used or ("A", c[2]) in used or not x or not y:
                    continue
                s = len(x & y) / max(len(x), len(y))
                if s >= least:
                    like[g[2], c[2]] = s
        best = lambda k, p: min((x for x in like if x[k] == p), key=lambda x: (-like[x], x[1 - k]))  # noqa: E731, B023
        out += [(*key, g, c, s) for (g, c), s in like.items() if best(0, g) == (g, c) == best(1, c)]
    return out


def some_changes(seed, n=6):
    rng = random.Random(seed)
    rows = []
    for repo in ("r", "s"):
        for commit in range(n):
            for status in "DA":
                for k in range(rng.randrange(7)):
                    chunks = rng.sample([f"c{x}" for x in range(9)], rng.randrange(7))
                    rows.append((repo, commit, f"{status}{commit}-{k}", status, rng.choice(["x", "y", None, None, f"{rng.random()}"]), rng.choice([chunks, chunks, [*chunks, *chunks[:1]], None])))
    return [*rows, ("r", 0, "m", "M", "x", ["c1"]), (None, 0, "n", "A", "x", [])]


@pytest.mark.parametrize("least", [0.5, 0.3, 1.0])
def test_renames_equal_comparing_all(spark, least):
    rows = [r for seed in range(3) for r in some_changes(seed) if seed == 0 or r[0] == "r"][:400]
    rows = list({(r[0], r[1], r[2], r[3]): r for r in rows}.values())
    got = [tuple(r) for r in commits.renames(spark.createDataFrame(rows, CHANGES), least).collect()]
    assert sorted(got) == sorted(brute_renames([r for r in rows if r[0]], least))


def test_files_of_equal_chunks_make_no_product(spark, monkeypatch):
    """2,000 removed and 2,000 added files of two contents that are alike: one pair of contents, not 4 million of files."""
    tables = []
    monkeypatch.setattr(commits, "settled", lambda df, name: tables.append(rounds.settled(df, name)) or tables[-1])
    side = lambda status, last: spark.range(2000).selectExpr("'r' repo", "1L commit", f"format_string('{status}%04d', id) path", f"'{status}' status", f"if(id % 2 = 0, concat('{status}', id), null) blob", f"array('a', 'b', '{last}') chunks")
    got = commits.renames(side("D", "c").unionByName(side("A", "d")))
    assert [(r.old_path, r.new_path, round(r.similarity, 6)) for r in got.collect()] == [("D0000", "A0000", 0.666667)]
    assert max(t.count() for t in tables) == 4000


def records_moved(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).outputRecords() + stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_pairs_of_a_commit_are_not_written(spark):
    """200 removed and 200 added files, all three quarters alike: 40,000 pairs, of which only each file's best is handed on."""
    rows = [("r", 1, f"{s}{k:03}", s, f"{s}{k}", ["x", "y", "z", f"{s}{k}"]) for s in "DA" for k in range(200)]
    before = records_moved(spark)
    got = commits.renames(spark.createDataFrame(rows, CHANGES)).collect()
    assert [tuple(r) for r in got] == [("r", 1, "D000", "A000", 0.75)]
    assert 0 < records_moved(spark) - before < 20_000


@pytest.mark.parametrize("least", [0.34, 0.5, 1.0])
def test_most_similar_over_tiles_equals_comparing_all(spark, monkeypatch, least):
    monkeypatch.setattr(similar_sets, "TILE", 7)
    monkeypatch.setattr(similar_sets, "TASK_TOKENS", 300)
    monkeypatch.setattr(similar_sets, "CELLS", 20)
    rng = random.Random(4)
    sides = [[(rng.choice("pq"), k, [rng.choice("abcdefgh") for _ in range(rng.randrange(5))]) for k in rng.sample(range(1000), 60)] for _ in range(2)]
    want = set()
    for side in (0, 1):
        for on, k, x in sides[side]:
            like = [(-len(set(x) & set(y)) / max(len(set(x)), len(set(y))), j) for o, j, y in sides[1 - side] if o == on and x and y]
            if like and -min(like)[0] >= least:
                want.add((on, side, k, min(like)[1], -min(like)[0]))
    left, right = (spark.createDataFrame(x, "on string, id long, t array<string>") for x in sides)
    assert {tuple(r) for r in similar_sets.most_similar(left, right, ["on"], "id", "t", least).collect()} == want and want


def test_lineages_follow_paths_that_are_used_again(spark):
    blob = lambda k: (f"b{k}", [])
    rows = [
        ("r", 1, "a", "A", *blob(1)), ("r", 2, "a", "D", *blob(2)), ("r", 2, "b", "A", *blob(2)), ("r", 3, "b", "D", *blob(3)), ("r", 3, "c", "A", *blob(3)),
        ("r", 4, "a", "A", *blob(4)), ("r", 5, "a", "D", *blob(5)), ("r", 5, "d", "A", *blob(5)), ("r", 6, "z", "A", *blob(9)), ("s", 2, "b", "A", *blob(2)),
    ]
    df = spark.createDataFrame(rows, CHANGES)
    got = {(r.repo, r.path, r.commit): (r.lineage, r.renames) for r in commits.lineages(df, commits.renames(df)).collect()}
    assert got == {
        ("r", "a", 1): ("a@1", 0), ("r", "b", 2): ("a@1", 1), ("r", "c", 3): ("a@1", 2), ("r", "a", 4): ("a@4", 0), ("r", "d", 5): ("a@4", 1), ("r", "z", 6): ("z@6", 0), ("s", "b", 2): ("b@2", 0),
    }
    none = spark.createDataFrame([], CHANGES)
    assert commits.lineages(none, commits.renames(none)).count() == 0


def test_a_long_chain_takes_few_rounds_and_a_cycle_raises(spark):
    links = spark.range(1, 1001).selectExpr("'r' repo", "id - 1 source", "id target")
    got = rounds.followed(links, ["repo"]).agg(F.count("*"), F.max("head"), F.sum("steps")).first()
    assert tuple(got) == (1001, 0, 1000 * 1001 // 2)
    with pytest.raises(ValueError, match="cycle"):
        rounds.followed(spark.createDataFrame([("r", 1, 2), ("r", 2, 1)], "repo string, source long, target long"), ["repo"], most_rounds=4)


# --- Orders and trees


def test_commit_order_of_random_histories(spark):
    rng = random.Random(3)
    rows, parents = [], []
    for repo, n in (("a", 60), ("b", 25), ("line", 40), ("one", 1)):
        for k in range(n):
            rows.append((repo, f"{k:03d}", rng.randrange(30) if repo != "line" else 5))
            up = {k - 1} if repo == "line" else {rng.randrange(max(0, k - 6), k) for _ in range(rng.choice([0, 1, 1, 1, 2, 3])) if k}
            parents += [(repo, f"{k:03d}", f"{p:03d}") for p in up if p >= 0]
    parents += [("a", "003", "missing"), ("a", "004", "004"), parents[0]]
    got = commits.commit_order(spark.createDataFrame(rows, "repo string, sha string, time long"), spark.createDataFrame(parents, "repo string, sha string, parent string")).collect()
    known, corrected = {(r[0], r[1]): r[2] for r in rows}, {}
    for repo, sha, time in rows:  # parents stand before their children here
        corrected[repo, sha] = max([time, *(corrected[repo, p] + 1 for r, s, p in parents if (r, s) == (repo, sha) and (repo, p) in known and p != sha)])
    assert {(r.repo, r.sha): r.corrected for r in got} == corrected
    for repo in {r[0] for r in rows}:
        order = [r.sha for r in sorted((r for r in got if r.repo == repo), key=lambda r: r.position)]
        assert order == sorted(order, key=lambda s: (corrected[repo, s], known[repo, s], s))
        assert sorted(r.position for r in got if r.repo == repo) == list(range(1, len(order) + 1))
        assert all(order.index(p) < order.index(s) for r, s, p in parents if r == repo and (repo, p) in known and p != s)


def test_merges_with_wrong_clocks_settle(spark):
    """A side branch with a late clock pushes all that comes after its merge."""
    rows = [("r", s, t) for s, t in (("a", 1), ("b", 90), ("c", 2), ("m", 3), ("n", 4), ("o", 95))]
    parents = [("r", *p) for p in (("b", "a"), ("c", "a"), ("m", "b"), ("m", "c"), ("n", "m"), ("o", "n"))]
    got = commits.commit_order(spark.createDataFrame(rows, "repo string, sha string, time long"), spark.createDataFrame(parents, "repo string, sha string, parent string"))
    assert [(r.sha, r.corrected) for r in got.orderBy("position").collect()] == [("a", 1), ("c", 2), ("b", 90), ("m", 91), ("n", 92), ("o", 95)]


@pytest.mark.parametrize("small", [0, 70, 4096])
def test_small_and_large_repositories_are_ordered_alike(spark, monkeypatch, small):
    rng = random.Random(11)
    rows = [(repo, f"{k:03d}", rng.choice([None, *range(30)])) for repo, n in (("a", 50), ("b", 20), ("c", 1), ("d", 30)) for k in range(n)]
    parents = [(repo, sha, f"{rng.randrange(max(0, int(sha) - 5), int(sha)):03d}") for repo, sha, _ in rows for _ in range(rng.randrange(3)) if int(sha)] + [("a", "001", "none"), ("e", "1", "0"), ("b", "002", "002")]
    frames = spark.createDataFrame(rows, "repo string, sha string, time long"), spark.createDataFrame(parents, "repo string, sha string, parent string")
    tables = []
    monkeypatch.setattr(commits, "settled", lambda df, name: tables.append(name) or rounds.settled(df, name))
    got = sorted(map(repr, commits.commit_order(*frames, small=small).collect()))
    assert small < 4096 or tables == ["commits", "parents", "large"]
    assert got == sorted(map(repr, commits.long_commit_order(*frames).collect())) and len(got) == len(rows)


def test_trees_equal_looking_at_all_versions(spark):
    rng = random.Random(9)
    versions = [(repo, rng.choice("abcd"), rng.randrange(70), k, rng.random() < 0.2) for k in range(150) for repo in [rng.choice(["r", "s"])]]
    points = [(repo, f"{repo}{t}", t) for repo in ("r", "s", "none") for t in (0, 1, 2, 7, 8, 31, 32, 63, 64, 69, 200)]
    of = "repo string, path string, time long, seq long, deleted boolean"
    got = commits.trees_at(spark.createDataFrame(versions, of), spark.createDataFrame(points, "repo string, sha string, time long"))
    expected = []
    for repo, sha, t in points:
        for path in "abcd":
            before = sorted((v for v in versions if v[0] == repo and v[1] == path and v[2] <= t), key=lambda v: (v[2], v[3]))
            if before and not before[-1][4]:
                expected.append((repo, sha, path, before[-1][3]))
    assert sorted(tuple(r) for r in got.select("repo", "sha", "path", "seq").collect()) == sorted(expected)
    assert commits.trees_at(spark.createDataFrame([], of), spark.createDataFrame([], "repo string, sha string, time long")).count() == 0


def test_ranges_and_points_meet_once(spark):
    rng = random.Random(1)
    ranges = [(k % 2, k, lo, rng.choice([None, lo, lo + rng.randrange(20)])) for k in range(80) for lo in [rng.randrange(40)]]
    points = [(k % 3, k, rng.randrange(50)) for k in range(60)]
    got = commits.stabbed(spark.createDataFrame(ranges, "g int, r int, lo long, hi long"), spark.createDataFrame(points, "g int, p int, at long"), ["g"], "lo", "hi", "at")
    expected = [(r[1], p[1]) for r in ranges for p in points if r[0] == p[0] and r[2] <= p[2] and (r[3] is None or p[2] < r[3])]
    assert sorted((r.r, r.p) for r in got.collect()) == sorted(expected)


def test_ranges_and_points_are_never_broadcast(spark, tmp_path):
    """A small file of points grows by a row a level, which no estimate knows."""
    spark.range(50).selectExpr("0 g", "id p", "id at").write.parquet(f"{tmp_path}/points")
    spark.range(50).selectExpr("0 g", "id r", "id lo", "id + 5 hi").write.parquet(f"{tmp_path}/ranges")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    got = commits.stabbed(read("ranges"), read("points"), ["g"], "lo", "hi", "at")
    assert got.count() == sum(min(5, 50 - k) for k in range(50))
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


# --- Numbers, ranks and samples


def test_numbers_and_running_maxima(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(20)]), k, rng.randrange(100)) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, o int, k int, v int").repartition(5)
    got = rounds.running_max(rounds.numbered(df, ["g"], ["o", "k"]), ["g"], ["o", "k"], "v", "top").collect()
    for g in ("hot", "b", None):
        own = sorted((r for r in got if r.g == g), key=lambda r: (r.o is not None, r.o or 0, r.k))
        assert [r.position for r in own] == list(range(1, len(own) + 1))
        assert [r.top for r in own] == [max(r.v for r in own[: k + 1]) for k in range(len(own))]


@pytest.mark.parametrize("kind", ["double", "bigint", "int"])
@pytest.mark.parametrize("bins", [2, 5, 1024])
def test_quantiles_equal_sorting(spark, kind, bins):
    import numpy as np

    rng = random.Random(bins)
    special = [-(2**63), 2**63 - 1, 2**53, 2**53 + 1] if kind == "bigint" else [5e-324, -1.7e308, 1.7e308, 1.0, 1.0 + 2e-16] if kind == "double" else [2**31 - 1, -(2**31)]
    make = (lambda: rng.choice([rng.gauss(0, 1), rng.gauss(0, 1) * 1e-200, 0.0])) if kind == "double" else (lambda: rng.choice([rng.randrange(-9, 9), 7]))
    values = [make() for _ in range(500)] + special
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] + ([(float("nan"),)] if kind == "double" else []), f"x {kind}")
    table = df.where("x is not null" + (" and not isnan(x)" if kind == "double" else ""))
    ranks = [0, 1, 2, 100, 250, len(values) - 2, len(values) - 1]
    assert selection.ranked_values(table, "x", ranks, bins) == {r: sorted(values)[r] for r in ranks}
    calm = [v for v in values if v not in special]
    got = selection.exact_quantiles(spark.createDataFrame([(v,) for v in calm], f"x {kind}"), "x", [0, 0.1, 0.5, 0.99, 1], bins)
    assert np.allclose(got, np.quantile(np.array(calm, float), [0, 0.1, 0.5, 0.99, 1]), rtol=1e-12, atol=1e-210)


def test_quantiles_of_nothing(spark):
    assert selection.exact_quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]


@pytest.mark.parametrize("edge_rows", [1, 8, 4096])
def test_the_first_of_each_stratum_equal_sorting(spark, edge_rows):
    import hashlib

    rng = random.Random(4)
    rows = [(k, rng.choice(["hot", "hot", "hot", "b", "c", None])) for k in range(400)] + [(7, "hot"), (7, "hot")]
    df = spark.createDataFrame(rows, "k long, s string")
    quota = {"hot": 37, "b": 0, "c": 10_000, None: 5}
    q = spark.createDataFrame(list(quota.items()), "s string, allocated bigint")
    digest = F.md5(F.col("k").cast("string").cast("binary"))
    got = selection.first_of_each(df, ["s"], digest, ["k"], q, edge_rows=edge_rows).collect()
    assert sorted((r.k, str(r.s)) for r in got) == sorted((k, str(s)) for k, s in rows)
    for s, n in quota.items():
        own = sorted((hashlib.md5(str(k).encode()).hexdigest(), k) for k, x in rows if x == s)
        assert sorted(k for _, k in own[:n]) == sorted(r.k for r in got if r.s == s and r.in_sample)


def test_rows_of_a_sample_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(200).selectExpr("id k", "if(id % 3 = 0, 'a', 'b') s").mapInArrow(counted, "k long, s string")
    got = sampling.floor_quota(df, "s", ["k"], {"a": 5, "b": 7}, 20)
    assert sorted(r.event_id for r in got.collect()) == [f"E{k:03d}" for k in range(1, 21)]
    assert seen.value == 200


# --- Sets


@pytest.mark.parametrize("least", [0.3, 0.5, 0.9, 1.0])
def test_candidates_hold_all_that_are_alike_and_none_twice(spark, least):
    rng = random.Random(6)
    make = lambda n: [(rng.choice("gh"), k, [f"w{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randrange(9))]) for k in range(n)]
    left, right = make(60), make(50)
    of = "g string, id int, w array<string>"
    got = [tuple(r) for r in candidate_pairs(spark.createDataFrame(left, of), spark.createDataFrame(right, of), ["g"], "id", "w", least).collect()]
    assert len(got) == len(set(got))
    alike = {(g, a, b) for g, a, x in left for h, b, y in right if g == h and x and y and len(set(x) & set(y)) / max(len(set(x)), len(set(y))) >= least}
    assert alike <= set(got) and len(got) < 60 * 50 // 2


VERSION = "repo string, tool string, commit_date string, seq long, sha string, description string, props map<string,string>, source_file string"


def test_rename_candidates_equal_comparing_all(spark):
    rng = random.Random(8)
    rows, k = [], 0
    for repo in ("r", "s"):
        for date in range(5):
            for _ in range(rng.randrange(2, 9)):
                k += 1
                words = rng.choice([None, "", " ".join(rng.sample(["get", "the", "list", "of", "user", "Items", "by", "id"], rng.randrange(1, 6)))])
                props = rng.choice([None, {}, dict.fromkeys(rng.sample("abcd", rng.randrange(1, 4)), "string")])
                rows.append((repo, f"t{rng.randrange(12)}", f"2024-01-0{date + 1}", k, "x", words, props, "f"))
    got = history.rename_candidates(spark.createDataFrame(rows, VERSION)).collect()
    expected = set()
    for repo in ("r", "s"):
        dates = sorted({r[2] for r in rows if r[0] == repo})
        for a, b in zip(dates, dates[1:]):
            at = [{r[1]: r for r in rows if r[0] == repo and r[2] == d} for d in (a, b)]
            for o in at[0].keys() - at[1].keys():
                for n in at[1].keys() - at[0].keys():
                    x, y = at[0][o], at[1][n]
                    s = jaccard(set(x[6] or ()), set(y[6] or ()))
                    t = jaccard(set((x[5] or "").lower().split()), set((y[5] or "").lower().split()))
                    if s >= 0.5 and t >= 0.3:
                        expected.add((repo, a, b, o, n))
    assert {(r.repo, r.from_date, r.to_date, r.old_tool, r.new_tool) for r in got} == expected and len(got) == len(expected)


def test_a_mass_rename_makes_no_product(spark):
    """5,000 names become 5,000 others in one step: 25 million pairs, of which few share a rare word."""
    n = 5000
    rows = spark.range(n).selectExpr("id", "concat('the a', id, ' b', id, ' c', id % 2500, ' d', id % 2500, ' e', id % 1000) words")
    side = lambda mark, date, seq: rows.selectExpr("'r' repo", f"concat('{mark}', id) tool", f"'{date}' commit_date", f"id + {seq} seq", "'x' sha", "words description", "map('a', 'string', 'b', 'string') props", "'f' source_file")
    got = history.rename_candidates(side("old", "2024-01-01", 0).unionByName(side("new", "2024-01-02", n)))
    same = got.selectExpr("cast(substring(old_tool, 4) as int) o", "cast(substring(new_tool, 4) as int) n", "text_jaccard t").groupBy("t", (F.col("o") % 2500 == F.col("n") % 2500).alias("near")).count().collect()
    assert {(round(r["t"], 3), r["near"]): r["count"] for r in same} == {(1.0, True): n, (round(3 / 9, 3), True): n}


def test_steps_of_few_and_of_many_pairs_agree_and_versions_are_read_once(spark):
    rng = random.Random(5)
    rows = [("r", f"t{rng.randrange(9)}", f"2024-01-0{1 + k % 4}", k, "x", rng.choice([None, "get the list", "get a list", "drop it"]), rng.choice([None, {"a": "string"}, {"b": "string"}]), rng.choice("fg")) for k in range(60)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = [sorted(map(repr, history.rename_candidates(spark.createDataFrame(rows, VERSION).mapInArrow(counted, VERSION), few).collect())) for few in (0, 2, 256)]
    assert got[0] == got[1] == got[2] and got[0]
    assert seen.value == 3 * len(rows)
