"""Distribution points, identities between the statistics and brute-force checks."""

import math
import random
import time
from statistics import NormalDist

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from limnetic.catalog import QUERIES, registry, stats
from limnetic.functions import dist
from limnetic.operators import aggregates, smoothers, statistics, trees
from limnetic.operators.grouped import grouped_line


def frame(spark, groups=3, n=40, seed=7):
    rnd = random.Random(seed)
    rows = [
        (g, rnd.choice("abc"), float(rnd.randint(0, 12)), rnd.gauss(10 + g, 2)) for g in range(groups) for _ in range(n)
    ]
    return rows, spark.createDataFrame(rows, "g int, f string, x double, y double")


def test_published_points():
    assert dist.f_tail(2.228138852**2, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.f_tail(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.tukey_tail(3.877, 3, 10) == pytest.approx(0.05, abs=2e-4)
    assert dist.tukey_tail(3.314, 3, 1e6) == pytest.approx(0.05, abs=3e-4)
    assert dist.tukey_critical(0.05, 3, 10) == pytest.approx(3.877, abs=2e-3)
    assert dist.f_tail(0.0, 2, 10) == 1.0


def test_t_points(spark):
    df = spark.createDataFrame([(0,), (1,), (10,), (30,), (40,), (100,), (10**6,)], "v long")
    got = [r[0] for r in df.select(dist.t975(F.col("v"))).collect()]
    assert got[0] is None
    assert got[1:] == pytest.approx([12.7062, 2.22814, 2.04227, 2.02108, 1.98397, 1.95997], abs=2e-5)


def test_numeric_anova_is_squared_t(spark):
    _, df = frame(spark)
    a = {r["g"]: r["f"] for r in statistics.anova_numeric(df, ["g"], F.col("x"), F.col("y")).collect()}
    b = {r["g"]: r["slope_t"] for r in statistics.regression_summary(df, ["g"], F.col("x"), F.col("y")).collect()}
    assert a == pytest.approx({g: t * t for g, t in b.items()})


def test_oneway_by_hand(spark):
    rows, df = frame(spark)
    got = {r["g"]: r for r in statistics.anova_oneway(df, ["g"], "f", "y").collect()}
    for g in range(3):
        parts = [[r[3] for r in rows if r[0] == g and r[1] == f] for f in "abc"]
        every = np.concatenate(parts)
        ssb = sum(len(p) * (np.mean(p) - every.mean()) ** 2 for p in parts)
        ssw = sum(((np.array(p) - np.mean(p)) ** 2).sum() for p in parts)
        assert got[g]["f"] == pytest.approx(ssb / 2 / (ssw / (len(every) - 3)))
        assert got[g]["ges"] == pytest.approx(ssb / (ssb + ssw))


def test_tukey_table(spark):
    _, df = frame(spark)
    pairs = statistics.with_tukey_p(statistics.tukey_pairs(df, ["g"], "f", "y")).collect()
    assert len(pairs) == 9
    for r in pairs:
        assert r["conf_low"] < r["estimate"] < r["conf_high"]
        outside = r["conf_low"] > 0 or r["conf_high"] < 0
        assert outside == (r["p_adj"] < 0.05)


def test_grouped_closure_equals_aggregate(spark):
    _, df = frame(spark)
    a = {r["g"]: (r["n"], r["slope"]) for r in grouped_line(df, ["g"], "x", "y").collect()}
    b = {r["g"]: (r["n"], r["slope"]) for r in statistics.ols(df, ["g"], F.col("x"), F.col("y")).collect()}
    assert {g: n for g, (n, _) in a.items()} == {g: n for g, (n, _) in b.items()}
    assert {g: s for g, (_, s) in a.items()} == pytest.approx({g: s for g, (_, s) in b.items()})


def test_bootstrap_brackets_the_mean(spark):
    rows = [(0, i, float(i % 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, id long, y double")
    a = statistics.mean_ci_boot(df, ["g"], "y", reps=200).first()
    b = statistics.mean_ci_normal(df, ["g"], "y").first()
    assert a["mean"] == b["mean"] and a["lower"] < a["mean"] < a["upper"]
    assert a["upper"] - a["lower"] == pytest.approx(b["upper"] - b["lower"], rel=0.25)
    again = statistics.mean_ci_boot(df.repartition(7), ["g"], "y", reps=200).first()
    assert (again["lower"], again["upper"]) == pytest.approx((a["lower"], a["upper"]))


def test_binomial_numbers_of_many_draws_take_little_time():
    """A thousand numbers of draws, each tried at thousands of counts, need no logarithm of a factorial each."""
    draws = np.arange(1000) * 7 + 10**7
    u = statistics.uniforms("node", 1000)
    start = time.process_time()
    x = statistics.binomials(draws, 0.4, u)
    assert time.process_time() - start < 1.2
    expected = [n * 0.4 + math.sqrt(n * 0.24) * NormalDist().inv_cdf(v) for n, v in zip(draws.tolist(), u.tolist())]
    assert np.abs(x - expected).max() < 3


def test_each_resample_has_as_many_rows_as_the_group():
    """Draws dealt out over the tree sum up in every replicate, and follow the shares of the rows."""
    r = np.random.default_rng(5)
    hashes, counts, values = r.integers(0, 1 << 32, 300).astype(np.uint64), r.integers(1, 9, 300), r.normal(size=300)
    hashes[10:14] = hashes[10]  # alike in all bits
    rows = int(counts.sum())
    dealt = dict(statistics.split_draws("g", np.full(500, rows), hashes, counts, values))
    assert sorted(dealt) == list(range(300))
    table = np.array([dealt[i] for i in range(300)])
    assert (table.sum(0) == rows).all() and table.min() >= 0
    assert np.abs(table.mean(1) - counts).max() < 5 * math.sqrt(8 / 500)
    expected = counts * (1 - counts / rows)
    assert table.var(1).mean() == pytest.approx(expected.mean(), rel=0.05)


def test_binomial_numbers():
    for n, p in ((1, 0.3), (7, 0.5), (50, 0.02), (3000, 0.4), (10**7, 1e-6)):
        u = (np.arange(20_000) + 0.5) / 20_000
        x = statistics.binomials(np.full(20_000, n), p, u)
        assert (np.diff(x) >= 0).all() and x.max() <= n
        assert x.mean() == pytest.approx(n * p, rel=2e-3) and x.var() == pytest.approx(n * p * (1 - p), rel=2e-2)
    u = statistics.uniforms("a node", 50_000)
    assert np.histogram(u, 20, (0, 1))[0].std() < 3 * math.sqrt(2500) and len(set(u)) == 50_000


def test_nodes_split_over_several_tasks_change_nothing(spark, monkeypatch):
    rows = [("a", float(i % 211)) for i in range(900)] + [(None, 1.0), (None, 2.0), ("", 5.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, y double")
    plain = {r["g"]: tuple(r) for r in statistics.mean_ci_boot(df, ["g"], "y", reps=100).collect()}
    monkeypatch.setattr(statistics, "NODE_CELLS", 2)
    monkeypatch.setattr(statistics, "FAN_BITS", 3)
    again = {r["g"]: tuple(r) for r in statistics.mean_ci_boot(df.repartition(5), ["g"], "y", reps=100).collect()}
    assert plain.keys() == again.keys() == {"a", None, ""}
    for g in plain:
        assert plain[g][1:] == pytest.approx(again[g][1:])
    assert plain[""][2:] == (5.0, 5.0, 5.0) and plain[None][1] == 2


def test_median_sketch_keeps_its_rank_error(spark):
    """Of skewed continuous groups much larger than the sketch; small groups have the lower median."""
    df = spark.range(300_000).select((F.col("id") % 3 == 0).alias("hot"), F.exp(F.randn(1) * 3).alias("x")).repartition(7)
    rows = aggregates.sketch_ranks(df, ["hot"], "x", rank_error=1e-3).collect()
    assert len(rows) == 2 and all(0 <= r["rank_error"] <= 1e-3 for r in rows) and sum(r["n"] for r in rows) == 300_000
    few = spark.createDataFrame([(1, 5.0), (1, 1.0), (1, 9.0), (1, 7.0), (1, None), (2, None)], "g int, x double")
    assert [(r["g"], r["n"], r["median"], r["rank_error"]) for r in aggregates.sketch_ranks(few, ["g"], "x").collect()] == [(1, 4, 5.0, 0.0)]


def test_best_split_by_hand(spark):
    rows, df = frame(spark, groups=1, n=60)
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])

    def sse(v):
        return ((v - v.mean()) ** 2).sum()

    gains = {
        cut: sse(y) - sse(y[x <= cut]) - sse(y[x > cut])
        for cut in sorted(set(x))
        if (x <= cut).sum() >= 3 and (x > cut).sum() >= 3
    }
    best = max(gains, key=gains.get)
    got = trees.best_split(df, ["x"], "y", min_bucket=3).first()
    assert got["split_at"] == best and got["gain"] == pytest.approx(gains[best], abs=1e-3)


def test_tree_starts_at_the_best_split(spark):
    _, df = frame(spark, groups=1, n=60)
    model = trees.regression_tree(df, ["x"], "y", min_bucket=3, cp=0.0, max_depth=1)
    best = trees.best_split(df, ["x"], "y", min_bucket=3).first()
    data = df.withColumn("left", F.col("x") <= best["split_at"])
    means = {r["left"]: r["m"] for r in data.groupBy("left").agg(F.avg("y").alias("m")).collect()}
    for r in trees.predict(model, data, ["x"], "y", ["left"]).collect():
        assert r["predicted"] == pytest.approx(means[r["left"]])


def test_tree_stops_at_cp_of_the_root(spark):
    """1,000 distinct values with one step: one split, at the step itself."""
    rows = [(float(i), 10.0 if i >= 950 else i * 1e-3) for i in range(1000)]
    df = spark.createDataFrame(rows, "x double, y double")
    tree = trees.regression_tree(df, ["x"], "y", min_bucket=7, cp=0.1)
    assert [(s.node, s.at) for s in tree.splits.values()] == [(1, 949.0)]
    deep = trees.regression_tree(df, ["x"], "y", min_bucket=7, cp=1e-6)
    assert len(deep.splits) > 3 and trees.prune(deep, 0.1).splits.keys() == {1}
    table = {r["cp"]: r for r in trees.tree_cv_table(df.withColumn("id", F.col("x").cast("long")), ["x"], "y", "id", folds=4, cps=(0.1, 1e-3), min_bucket=7).collect()}
    assert table[0.1]["splits"] == 1 and 0 < table[0.1]["relative_error"] < 0.02 and table[0.1]["cv_error"] < 0.05
    few = trees.regression_tree(df.limit(20), ["x"], "y", min_bucket=7)
    assert not few.splits


def test_registered_tree_isolates_a_few_extreme_catches(spark, small, monkeypatch):
    """Three of 60 rows hold nearly all of the squared error, which no leaf of 7 rows shows."""
    rows = [(i, float(i), *(0.0,) * 4, 1000.0 if i in (30, 31, 32) else float(i % 2)) for i in range(60)]
    names = ["op_id long", *(f"{f} double" for f in stats.FEATURES), "fish double"]
    monkeypatch.setattr(stats, "tree_rows", lambda s: spark.createDataFrame(rows, ", ".join(names)))
    got = {r["op_id"]: r["predicted"] for r in QUERIES["regression_tree_bucket2"](spark, small).collect()}
    assert all(got[i] == 1000 for i in (30, 31, 32)) and max(got[i] for i in got if i not in (30, 31, 32)) < 1.5
    wide = {r["op_id"]: r["predicted"] for r in QUERIES["regression_tree"](spark, small).collect()}
    assert max(wide.values()) < 500


def test_each_row_has_a_held_out_prediction_at_each_cp(spark):
    """Their squared errors are those of the cp table, and no row helps to predict itself."""
    rows = [(i, float(i % 50), (5.0 if i % 50 > 30 else 1.0) + (i * 37 % 11) / 10) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    given = dict(folds=5, cps=(0.1, 0.01), min_bucket=2)
    found = trees.cv_predictions(df, ["x"], "y", "id", **given).collect()
    assert sorted((r["id"], r["cp"]) for r in found) == sorted((i, cp) for i in range(200) for cp in (0.1, 0.01))
    sse = sum((y - np.mean([r[2] for r in rows])) ** 2 for _, _, y in rows)
    for r in trees.tree_cv_table(df, ["x"], "y", "id", **given).collect():
        held = sum((p["label"] - p["predicted"]) ** 2 for p in found if p["cp"] == r["cp"])
        assert r["cv_error"] == pytest.approx(held / sse)
    row = next(r for r in found if r["id"] == 0 and r["cp"] == 0.1)
    fold = {r["id"] for r in found if r["fold"] == row["fold"]}
    rest = df.filter(~F.col("id").isin(list(fold)))
    model = trees.regression_tree(rest, ["x"], "y", min_bucket=2, cp=0.1)
    assert trees.predict(model, df.filter("id = 0"), ["x"], "y", ["id"]).first()["predicted"] == pytest.approx(row["predicted"])


def test_reference_cp_is_registered(spark, small):
    assert {r["cp"] for r in QUERIES["tree_cp_table"](spark, small).collect()} == {0.1, 0.03, 0.01}
    pruned = {r["predicted"] for r in QUERIES["tree_pruned"](spark, small).collect()}
    assert len(pruned) <= len({r["predicted"] for r in QUERIES["regression_tree_bucket2"](spark, small).collect()})


def test_tree_queries_equal_their_sql_where_trees_are_deep(spark, small, monkeypatch):
    """The small tables have no split; these rows have many."""
    rnd = random.Random(8)
    rows = [(i, *(float(rnd.randint(0, 9)) for _ in stats.FEATURES), float(round(rnd.expovariate(1) ** 4, 2))) for i in range(150)]
    df = spark.createDataFrame(rows, ", ".join(["op_id long", *(f"{f} double" for f in stats.FEATURES), "fish double"]))
    monkeypatch.setattr(stats, "tree_rows", lambda s: df)
    con = duckdb.connect()
    con.sql(f"CREATE TABLE made (op_id BIGINT, {', '.join(f'{f} DOUBLE' for f in stats.FEATURES)}, raw DOUBLE)")
    con.executemany(f"INSERT INTO made VALUES ({', '.join('?' * 7)})", rows)
    con.sql("CREATE TABLE o_tree_rows AS SELECT *, raw - avg(raw) OVER () AS y FROM made")
    leaf, held, cv = stats.leaf_means_sql, stats.held_out_sql, stats.cv_sql
    bucket, levels = stats.SMALL_BUCKET, stats.SMALL_LEVELS
    bodies = {
        "regression_tree_bucket2": leaf(0.01, bucket, levels),
        "tree_pruned": leaf(0.1, bucket, levels),
        "tree_cp_table": " UNION ALL ".join(cv(cp, stats.FOLDS, bucket, levels) for cp in stats.SMALL_CPS),
        "tree_cv_predictions": " UNION ALL ".join(held(cp) for cp in stats.SMALL_CPS),
    }
    for key, body in bodies.items():
        got = QUERIES[key](spark, small)
        want = con.sql(registry._rounding(body))
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall()), key
    assert len({r["predicted"] for r in QUERIES["regression_tree_bucket2"](spark, small).collect()}) > 5


def gappy_rows(n, seed=8, gaps=0.2):
    """Rows whose target follows the first two features, which stand in for each other, and noise; each value may be missing."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rnd.randint(0, 9), 0, rnd.randint(0, 5), rnd.randint(0, 3), rnd.randint(0, 9)]
        x[1] = 9 - x[0] if rnd.random() < 0.8 else rnd.randint(0, 9)
        y = 10.0 * (x[0] > 4) + 3.0 * (x[2] > 2) * (x[0] > 4) + round(rnd.expovariate(1), 2)
        rows.append((i, *(None if rnd.random() < gaps else float(v) for v in x), y))
    return rows


def test_tree_queries_equal_their_sql_where_predictors_are_missing(spark, small, monkeypatch):
    """The SQL copies the rows for every fold; splits have surrogates, and some rows lack all of them."""
    rows = gappy_rows(160)
    df = spark.createDataFrame(rows, ", ".join(["op_id long", *(f"{f} double" for f in stats.FEATURES), "fish double"]))
    monkeypatch.setattr(stats, "tree_rows", lambda s: df)
    con = duckdb.connect()
    con.sql(f"CREATE TABLE made (op_id BIGINT, {', '.join(f'{f} DOUBLE' for f in stats.FEATURES)}, raw DOUBLE)")
    con.executemany(f"INSERT INTO made VALUES ({', '.join('?' * 7)})", rows)
    con.sql("CREATE TABLE o_tree_rows AS SELECT *, raw - avg(raw) OVER () AS y FROM made")
    bucket, levels, folds = stats.SMALL_BUCKET, 10, stats.FOLDS
    bodies = {
        "regression_tree_bucket2": stats.leaf_means_sql(0.01, bucket, levels),
        "tree_cp_table": stats.cv_sql(stats.SMALL_CPS, folds, bucket, levels),
        "tree_cv_predictions": stats.held_out_sql(stats.SMALL_CPS, folds, bucket, levels),
        "tree_cp_sequence": stats.cp_sequence_sql(folds, bucket, levels),
    }
    for key, body in bodies.items():
        got, want = QUERIES[key](spark, small), con.sql(registry._rounding(body))
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall()), key
    model = trees.regression_tree(df, stats.FEATURES, "fish", min_bucket=2)
    first = model.splits[1]
    assert (first.feature, first.at) == (stats.FEATURES[0], 4.0)
    assert first.surrogates[0].feature == stats.FEATURES[1] and first.surrogates[0].turned
    assert QUERIES["tree_cp_sequence"](spark, small).count() > 2


def test_surrogates_send_rows_without_the_feature(spark):
    """The stand-in that agrees most, turned or not, then the next, then the majority."""
    swapped = {11: 12, 12: 11}
    rows = [(float(i), -float(swapped.get(i, i)), float(i // 5 * 5), 100.0 * (i >= 12)) for i in range(20)]
    rows += [(None, -19.0, None, 100.0), (None, None, 0.0, 0.0), (None, None, None, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    tree = trees.regression_tree(df, ["a", "b", "c"], "y", cp=0.01)
    split = tree.splits[1]
    assert (split.feature, split.at, split.majority_left) == ("a", 11.0, True)
    assert [(s.feature, s.at, s.turned, s.agree) for s in split.surrogates] == [("b", -13.0, True, 19), ("c", 5.0, False, 18)]
    assert not tree.splits.keys() - {1} and tree.nodes[2].n == 14 and tree.nodes[3].n == 9
    got = trees.predict(tree, df.filter("a is null"), ["a", "b", "c"], "y", ["c"]).collect()
    assert {r["c"]: r["predicted"] for r in got if r["c"] is not None} == {0.0: 0.0}
    assert all(r["predicted"] == r["label"] for r in got)


def test_weakest_link_keeps_a_weak_split_above_strong_ones(spark):
    """No split of an exclusive or takes away much before the other is made; its own share would drop it."""
    rows = [(float(a), float(b), float(a != b) + 0.05 * a + i * 1e-3) for a in (0, 1) for b in (0, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    full = trees.regression_tree(df, ["a", "b"], "y", min_bucket=2, cp=0.0)
    root = full.nodes[1].risk
    first = root - full.nodes[2].risk - full.nodes[3].risk
    assert first / root < 0.1  # less than cp by itself
    kept = trees.prune(full, 0.1)
    assert kept.splits.keys() == {1, 2, 3}
    links = trees.weakest_links(full)
    below = sum(kept.nodes[k].risk for k in (4, 5, 6, 7))
    assert links[1] == links[2] == links[3] == pytest.approx(((root - below) / 3) / root, abs=1e-6) or links[1] >= 0.3
    assert trees.prune(full, 0.35).splits == {}


def test_weakest_links_are_where_the_best_subtree_changes(spark):
    """Against all subtrees: at each cost, the smallest one of least squared error plus cost a leaf."""
    df = spark.createDataFrame(gappy_rows(60, seed=3), ", ".join(["id long", *(f"{f} double" for f in "abcde"), "y double"]))
    full = trees.regression_tree(df, list("abcde"), "y", min_bucket=4, cp=1e-4)

    def subtrees(node):
        yield (full.nodes[node].risk, 1, frozenset())
        if node in full.splits:
            for ra, la, a in list(subtrees(2 * node)):
                for rb, lb, b in list(subtrees(2 * node + 1)):
                    yield (ra + rb, la + lb, a | b | {node})

    every, root, links = list(subtrees(1)), full.nodes[1].risk, trees.weakest_links(full)
    assert len(full.splits) > 4
    for cp in (0.001, 0.004, 0.01, 0.03, 0.1, 0.3):
        best = min(every, key=lambda t: (round((t[0] + cp * root * t[1]) / root, 9), t[1]))
        assert trees.prune(full, cp).splits.keys() == best[2] == {n for n, g in links.items() if g > cp}


def test_blocks_of_values_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(gappy_rows(300, seed=5), ", ".join(["id long", *(f"{f} double" for f in "abcde"), "y double"])).withColumn("a", F.col("a") + F.col("id") / 1000)
    plain = trees.cp_table(df, list("abcde"), "y", "id", folds=4, min_bucket=2, max_depth=4).collect()
    monkeypatch.setattr(trees, "BLOCK_ROWS", 60)
    monkeypatch.setattr(trees, "TREES_AT_ONCE", 2)
    blocks = trees.cp_table(df, list("abcde"), "y", "id", folds=4, min_bucket=2, max_depth=4).collect()
    key = lambda r: -r["cp"]
    assert len(plain) > 2
    for a, b in zip(sorted(plain, key=key), sorted(blocks, key=key)):
        assert tuple(a) == pytest.approx(tuple(b), abs=1e-8)


def test_few_blocks_of_many_values_are_searched(spark, monkeypatch):
    """Tasks hand on sums of blocks, not of values, and the cuts are those among all values."""
    rnd = random.Random(4)
    rows = [(i, i * 0.37 + rnd.random(), None if rnd.random() < 0.1 else rnd.random(), 5.0 * (i > 1234) + rnd.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    given = dict(folds=3, cps=(0.01, 0.0005), min_bucket=2, max_depth=5)
    key = lambda r: (r["id"], r["cp"])
    want = [tuple(r) for r in sorted(trees.cv_predictions(df, ["a", "b"], "y", "id", **given).collect(), key=key)]
    looked, inside = [], trees._Table._inside
    monkeypatch.setattr(trees._Table, "_inside", lambda self, forest, search, blocks: looked.append(blocks) or inside(self, forest, search, blocks))
    monkeypatch.setattr(trees, "BLOCKS", 200)
    got = [tuple(r) for r in sorted(trees.cv_predictions(df, ["a", "b"], "y", "id", **given).collect(), key=key)]
    assert len(got) == 6000 and all(g == pytest.approx(w) for g, w in zip(got, want))
    assert looked and len(looked[0].groupby(["f", "block"])) < 40


def test_levels_read_chunks_of_block_numbers(spark, monkeypatch):
    """A feature of some more values than there are blocks is searched at once; chunks and lists of rows change nothing."""
    rnd = random.Random(9)
    rows = [(*r[:5], None if r[0] % 11 == 0 else float(rnd.randint(0, 249)), r[6]) for r in gappy_rows(600, seed=11)]
    df = spark.createDataFrame(rows, ", ".join(["id long", *(f"{f} double" for f in "abcde"), "y double"]))
    given = dict(folds=4, cps=(0.05, 0.002), min_bucket=2, max_depth=6)
    key = lambda r: (r["id"], r["cp"])
    want = [tuple(r) for r in sorted(trees.cv_predictions(df, list("abcde"), "y", "id", **given).collect(), key=key)]
    assert len({w[4] for w in want}) > 8
    monkeypatch.setattr(trees._Table, "_inside", lambda *_: pytest.fail("a second look at the rows"))
    monkeypatch.setattr(trees, "BLOCKS", 100)
    for chunk, listed in ((7, 0.0), (50, 2.0), (1000, 0.3)):
        monkeypatch.setattr(trees, "CHUNK_ROWS", chunk)
        monkeypatch.setattr(trees, "LISTED", listed)
        got = [tuple(r) for r in sorted(trees.cv_predictions(df, list("abcde"), "y", "id", **given).collect(), key=key)]
        assert len(got) == 1200 and all(g == pytest.approx(w) for g, w in zip(got, want))


def test_many_folds_do_not_copy_rows(spark, monkeypatch):
    """500 folds write the rows once and place each once; a row in a fold of its own is left out alone."""
    sizes = []
    plain = trees.written
    monkeypatch.setattr(trees, "written", lambda df, name: sizes.append(plain(df, name)) or sizes[-1])
    rows = gappy_rows(120, seed=6, gaps=0.0)
    df = spark.createDataFrame(rows, ", ".join(["id long", *(f"{f} double" for f in "abcde"), "y double"]))
    found = trees.cv_predictions(df, list("abcde"), "y", "id", folds=500, cps=(0.05,), min_bucket=5).collect()
    assert [d.count() for d in sizes] == [120] and len(found) == 120
    alone = next(r for r in found if sum(q["fold"] == r["fold"] for q in found) == 1)
    model = trees.regression_tree(df.filter(F.col("id") != alone["id"]), list("abcde"), "y", min_bucket=5, cp=0.05)
    assert trees.predict(model, df.filter(F.col("id") == alone["id"]), list("abcde"), "y", ["id"]).first()["predicted"] == pytest.approx(alone["predicted"])


def test_a_table_without_targets_has_no_tree(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "id long, x double, y double")
    assert trees.regression_tree(df, ["x"], "y").nodes == {}
    assert trees.cp_table(df, ["x"], "y", "id").count() == 0 and trees.cv_predictions(df, ["x"], "y", "id").count() == 0


@pytest.mark.parametrize("k, df, q", [(10, 1, 49.07), (20, 1, 59.56), (3, 1, 26.98), (2, 2, 6.085), (20, 2, 16.77), (5, 3, 7.502), (10, 5, 6.995), (3, 20, 3.578)])
def test_studentised_range_points(k, df, q):
    assert dist.tukey_critical(0.05, k, df) == pytest.approx(q, rel=2e-3)


@pytest.mark.parametrize("k, df, q", [(3, 20, 3.578), (10, 5, 6.995), (5, 3, 7.502), (2, 2, 6.085), (4, 120, 3.685)])
def test_studentised_range_points_in_sql(k, df, q):
    body = f"SELECT q95 FROM ({stats.range_point_sql(f'SELECT {k} AS levels, {df} AS df')})"
    found = duckdb.sql(registry.oracle(body)).fetchall()[0][0]
    assert found == pytest.approx(q, rel=2e-4) and found == pytest.approx(dist.tukey_critical(0.05, k, df), rel=1e-5)


def test_local_smoother_recovers_a_parabola(spark):
    rows = [(x, 0.5 * x * x - 3 * x + 1) for x in range(40)]
    df = spark.createDataFrame([(1, x, y) for x, y in rows], "g int, x int, y double")
    for r in smoothers.smooth_local(df, ["g"], "x", "y", points=9).collect():
        assert r["fit"] == pytest.approx(0.5 * r["x"] ** 2 - 3 * r["x"] + 1, abs=1e-6)


def test_too_few_points_have_no_fit(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0)], "g int, x int, y double")
    assert all(r["fit"] is None for r in smoothers.smooth_local(df, ["g"], "x", "y", points=3).collect())


def noisy(spark, n=3000, seed=2, gap=True):
    """Continuous x with a dense stretch and a gap, in two groups; the second has few rows."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x = rnd.uniform(0, 2) if rnd.random() < 0.5 else rnd.uniform(3 if gap else 2, 10)
        rows.append(("a", x, math.sin(x) * 3 + rnd.gauss(0, 0.5)))
    rows += [("b", float(i % 7), float(i % 5)) for i in range(40)] + [("c", 1.0, 1.0)] * 5 + [("a", None, 1.0), ("a", 1.0, None)]
    return rows, spark.createDataFrame(rows, "g string, x double, y double").repartition(4)


def curve(df):
    return {(r["g"], r["point"]): r["fit"] for r in df.collect()}


def test_interpolated_smoother_recovers_a_parabola(spark):
    rows = [(x, 0.5 * x * x - 3 * x + 1) for x in range(40)]
    df = spark.createDataFrame([(1, x, y) for x, y in rows], "g int, x int, y double")
    found = smoothers.smooth_interpolated(df, ["g"], "x", "y", points=9).collect()
    assert len(found) == 9
    for r in found:
        assert r["fit"] == pytest.approx(0.5 * r["x"] ** 2 - 3 * r["x"] + 1, abs=1e-6)


def test_interpolated_smoother_equals_local_fits_at_its_vertices(spark):
    """And keeps near them between; few or many bins of distances change nothing."""
    rows, df = noisy(spark)
    direct, between = curve(smoothers.smooth_local(df, ["g"], "x", "y", points=60)), curve(smoothers.smooth_interpolated(df, ["g"], "x", "y", points=60))
    assert {k for k in between if k[0] == "a"} == {k for k in direct if k[0] == "a"}
    # The data swing by 6; a vertex's slope is that of its own fit, not of the curve of all fits.
    assert max(abs(direct[k] - between[k]) for k in between if k[0] == "a") < 0.5
    assert np.mean([abs(direct[k] - between[k]) for k in between if k[0] == "a"]) < 0.1
    xs = sorted(r[1] for r in rows if r[0] == "a" and r[1] is not None and r[2] is not None)
    n = len(xs)
    cut = (xs[(n + 1) // 2 - 1] + xs[(n + 1) // 2]) / 2  # the first cut halves the rows
    # A grid of three points whose middle one is that cut.
    low, high = xs[0], xs[-1]
    both = df.filter("g = 'a'")
    share = (cut - low) / (high - low)
    points = 200_001
    at = round(share * (points - 1))
    fine = smoothers.smooth_interpolated(both, ["g"], "x", "y", points=points).filter(F.col("point") == at).first()
    x = np.array([r[1] for r in rows if r[0] == "a" and r[1] is not None and r[2] is not None])
    y = np.array([r[2] for r in rows if r[0] == "a" and r[1] is not None and r[2] is not None])
    d = np.abs(x - fine["x"])
    h = np.sort(d)[math.floor(0.75 * n) - 1]
    w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
    fit = np.polyfit(x - fine["x"], y, 2, w=np.sqrt(w))[2]
    assert fine["fit"] == pytest.approx(fit, abs=1e-4)


def test_interpolated_smoother_needs_no_sorted_group(spark, monkeypatch):
    _, df = noisy(spark, 800)
    plain = curve(smoothers.smooth_interpolated(df, ["g"], "x", "y", points=20))
    monkeypatch.setattr(smoothers, "DISTANCE_BINS", 3)
    assert curve(smoothers.smooth_interpolated(df, ["g"], "x", "y", points=20)) == pytest.approx(plain, abs=1e-9)
    assert not [k for k in plain if k[0] == "c"]
    assert smoothers.smooth_interpolated(df.limit(0), ["g"], "x", "y").count() == 0


def dense_spline(x, y, points, size=10):
    """The same fit from the whole design matrix, by recursion of B-splines."""
    n, low, high = size - 3, x.min(), x.max()
    knots = np.arange(-3, n + 4, dtype=float)

    def basis(t):
        t = np.minimum(t, np.nextafter(float(n), 0))
        b = [((knots[i] <= t) & (t < knots[i + 1])).astype(float) for i in range(len(knots) - 1)]
        for d in range(1, 4):
            b = [(t - knots[i]) / d * b[i] + (knots[i + d + 1] - t) / d * b[i + 1] for i in range(len(b) - 1)]
        return np.array(b).T

    design, mean = basis((x - low) / (high - low) * n), y.mean()
    fine = np.linspace(0, n, 20 * n * 50 + 1)
    second = np.gradient(np.gradient(basis(fine), fine, axis=0), fine, axis=0)
    rough = smoothers._roughness(size)
    approx = np.trapezoid(second[:, :, None] * second[:, None, :], fine, axis=0)
    assert np.allclose(rough, approx, atol=0.02)
    best = None
    for share in smoothers.PENALTIES:
        m = design.T @ design + share * np.trace(design.T @ design) / np.trace(rough) * rough
        b = np.linalg.solve(m, design.T @ (y - mean))
        edf = np.trace(np.linalg.solve(m, design.T @ design))
        score = len(x) * ((y - mean - design @ b) ** 2).sum() / (len(x) - edf) ** 2
        if best is None or score <= best[0]:
            best = (score, b, edf)
    return mean + basis(np.arange(points) / (points - 1) * n) @ best[1], best[2]


def test_spline_equals_the_dense_fit(spark):
    rows, df = noisy(spark)
    found = smoothers.smooth_spline(df, ["g"], "x", "y", points=25).collect()
    for g in ("a", "b"):
        x, y = (np.array([r[i] for r in rows if r[0] == g and None not in r]) for i in (1, 2))
        fit, edf = dense_spline(x, y, 25)
        own = sorted((r["point"], r["fit"], r["edf"], r["x"]) for r in found if r["g"] == g)
        assert [r[1] for r in own] == pytest.approx(fit, abs=1e-6) and own[0][2] == pytest.approx(edf, abs=1e-6)
        assert (own[0][3], own[-1][3]) == pytest.approx((x.min(), x.max()))
    assert {r["g"] for r in found} == {"a", "b"}
    truth = [abs(r["fit"] - 3 * math.sin(r["x"])) for r in found if r["g"] == "a" and (r["x"] < 2 or r["x"] > 3)]
    assert max(truth) < 0.4


def test_spline_of_a_line_is_the_line(spark):
    df = spark.createDataFrame([(1, float(i), 2.0 * i + 1) for i in range(50)], "g int, x double, y double")
    for r in smoothers.smooth_spline(df, ["g"], "x", "y", points=5).collect():
        assert r["fit"] == pytest.approx(2 * r["x"] + 1, abs=1e-3)
    assert smoothers.smooth_spline(df.limit(0), ["g"], "x", "y").count() == 0


def test_default_smoother_goes_by_the_largest_group(spark, monkeypatch):
    _, df = noisy(spark, 300)
    local = curve(smoothers.smooth_interpolated(df, ["g"], "x", "y", points=10))
    assert curve(smoothers.smooth(df, ["g"], "x", "y", points=10)) == pytest.approx(local)
    monkeypatch.setattr(smoothers, "SPLINE_ROWS", 300)
    spline = curve(smoothers.smooth_spline(df, ["g"], "x", "y", points=10))
    assert curve(smoothers.smooth(df, ["g"], "x", "y", points=10)) == pytest.approx(spline)


def test_density_integrates_to_one(spark):
    rnd = random.Random(3)
    rows = [("f", g, rnd.gauss(10, 2 + g)) for g in (0, 1) for _ in range(300)]
    df = spark.createDataFrame(rows, "f string, g int, x double")
    points = smoothers.density_ridges(df, "f", "g", "x", points=200, min_height=0.0).collect()
    for g in (0, 1):
        curve = sorted((r["x"], r["density"]) for r in points if r["g"] == g)
        step = curve[1][0] - curve[0][0]
        assert sum(d for _, d in curve) * step == pytest.approx(1, abs=0.01)
        median = np.median([r[2] for r in rows if r[1] == g])
        assert points[[p["g"] for p in points].index(g)]["median"] == pytest.approx(median)


def test_density_quartiles_need_no_buffer_of_a_group(spark, monkeypatch):
    """The quartiles behind the bandwidth, and the median, at even, odd and tied counts and a missing group."""

    def refused(*_):
        raise AssertionError("one buffer holds a group's values")

    monkeypatch.setattr(smoothers.F, "percentile", refused)
    rnd = random.Random(4)
    rows = [("f", g, float(round(rnd.expovariate(1), d))) for g, d, n in ((0, 9, 400), (1, 1, 401), (None, 9, 6), (3, 9, 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "f string, g int, x double")
    points = smoothers.density_ridges(df, "f", "g", "x", points=60, min_height=0.0).collect()
    widths = []
    for g in (0, 1, None, 3):
        own = [x for _, h, x in rows if h == g]
        sd = np.std(own, ddof=1) if len(own) > 1 else 0
        spread = min(sd, np.subtract(*np.quantile(own, (0.75, 0.25))) / 1.34)
        widths.append(0.9 * (spread or 1) * len(own) ** -0.2)
        assert [p["median"] for p in points if p["g"] == g] == pytest.approx([np.median(own)] * 60)
    assert min(p["x"] for p in points) == pytest.approx(min(r[2] for r in rows) - 3 * np.mean(widths))
