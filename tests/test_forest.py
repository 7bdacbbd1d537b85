"""Forests and boosted trees: few jobs, the same trees wherever the passes are made, and trees of a plain search."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from millrace.operators import boosting, forest, mining
from millrace.operators.blocks import blocks, fewer_parts, parts_of
from millrace.operators.boosting import Growth, Tree

K = 4


def rows(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, (n, K)).astype(float)
    return x, 2.0 * (x[:, 0] > 4) - (x[:, 1] > 6) * (x[:, 0] > 2) + 0.1 * rng.normal(size=n)


def frame(spark, x, y):
    held = [(f"2024-{1 + i // 80:02}-01", i, Vectors.dense(r), v) for i, (r, v) in enumerate(zip(x.tolist(), y.tolist(), strict=True))]
    return spark.createDataFrame(held, ["date", "stock_id", "features", "label"]).repartition(3)


def jobs_of(spark, run):
    spark.sparkContext.setJobGroup("trees", "trees")
    out = run()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("trees"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, jobs


def test_two_hundred_boosted_trees_and_a_forest_take_few_jobs(spark):
    x, y = rows()
    data, names = frame(spark, x, y), list("abcd")
    found, jobs = jobs_of(spark, lambda: mining.METHODS["boosted"](data, names))
    assert list(found)[:2] == ["a", "b"] and sum(found.values()) == pytest.approx(1) and jobs < 20
    found, jobs = jobs_of(spark, lambda: mining.tree_selection(data, names, numTrees=40))
    assert list(found)[0] == "a" and jobs < 40
    for kind in ("forest", "boosted"):
        assert mining.tree_selection(data.limit(0), names, kind) == {} == mining.tree_selection(frame(spark, x, np.ones(len(y))), names, kind, numTrees=2)


@pytest.mark.parametrize("how", [Growth(trees=12, depth=3, rate=0.3, patience=4), Growth(trees=12, rate=0.3, leaves=6, penalty=0.0, least_weight=9.0, rows=1.0)])
def test_trees_are_the_same_in_one_task_and_in_many(spark, how, monkeypatch):
    x, y = rows(600)
    x[300:] = x[:300]
    data = boosting.binned_rows(frame(spark, x, y), K, "2024-06-01")[0].repartition(5).persist()
    here, best = boosting.boost(data, K, how)
    monkeypatch.setattr(boosting, "ROWS_HERE", 0)
    monkeypatch.setattr(boosting, "REFRESH", 5)
    monkeypatch.setattr(boosting, "fewer_parts", lambda df: df)
    spread, most = boosting.boost(data, K, how)
    assert len(here) == len(spread) and best == most
    for a, b in zip(here, spread, strict=True):
        assert a.feature == b.feature and a.cut == b.cut and a.value == pytest.approx(b.value) and a.gain == pytest.approx(b.gain)
    data.unpersist()


def test_large_tasks_come_in_whole_rounds_and_look_up_few_trees(spark):
    context = spark.sparkContext
    cores = context.defaultParallelism
    assert [parts_of(context, n) for n in (0, 1, 16384, 16385)] == [1, 1, 1, 2] and parts_of(context, cores * (1 << 21)) == cores
    assert parts_of(context, cores * (1 << 21) + 1) == 2 * cores
    x, y = rows(60)
    tree = Tree({0: 0}, {0: 3}, {0: 1.0}, {1: -0.5, 2: 0.5})
    for largest, kept in ((1 << 24, 4), (1 << 18, 8), (1, boosting.REFRESH)):
        held = boosting.Spread(blocks(boosting.binned_rows(frame(spark, x, y), K, None)[0], lambda b: boosting._block(b, K)), largest)
        before = np.concatenate(held.rows.map(lambda b: b[3] + kept * tree.predict(b[1])).collect())
        for _ in range(kept - 1):
            held.add(tree)
        assert len(held.fresh) == kept - 1
        held.add(tree)
        assert not held.fresh and np.allclose(np.concatenate(held.rows.map(lambda b: b[3]).collect()), before)
        held.rows.unpersist()


@pytest.mark.parametrize("depth", [1, 3, 4, 6, 8])
def test_leaves_equal_those_of_a_walk(depth):
    rng = np.random.default_rng(depth)
    tree = Tree()
    for node in range((1 << depth) - 1):
        if not node or ((node - 1) // 2 in tree.feature and rng.random() < 0.9):
            tree.feature[node], tree.cut[node] = int(rng.integers(K)), int(rng.integers(254))
    bins = rng.integers(0, 255, (5000, K)).astype(np.uint8)
    assert (tree.leaf_of(bins) == tree._walked(bins)).all()
    tree.value = {e: float(e) for e in range(2 << depth)}
    assert (tree.predict(bins) == tree._walked(bins)).all() and (Tree().leaf_of(bins) == 0).all()


def test_forest_equals_a_plain_search(spark):
    x, y = rows(500)
    binned = boosting.binned_rows(frame(spark, x, y), K, None)[0].persist()
    trees = forest.grow(blocks(fewer_parts(binned), lambda b: forest._block(b, K)), K, 5, 3, 20, 7)
    held = binned.toPandas()
    bins, h, off = np.array([list(b) for b in held.bins]), held.h.to_numpy(), (held.y - held.pred).to_numpy()
    assert len({tuple(sorted(t.feature.items())) for t in trees}) > 1
    for number, tree in enumerate(trees):
        times = forest.drawn(h, 7, number)
        at, want = {0: np.arange(len(h))}, {}
        score = lambda i: (times[i] @ off[i]) ** 2 / times[i].sum()
        for node in range(7):
            if node not in at:
                continue
            level = (node + 1).bit_length() - 1
            best = None
            for f in forest.tried(K, 7, number, level)[node + 1 - (1 << level)]:
                for cut in range(254):
                    left, right = at[node][bins[at[node], f] <= cut], at[node][bins[at[node], f] > cut]
                    if min(times[left].sum(), times[right].sum()) >= 20:
                        gain = score(left) + score(right) - score(at[node])
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, int(f), cut, left, right)
            if best:
                want[node] = best[:3]
                at[2 * node + 1], at[2 * node + 2] = best[3:]
        assert {n: (pytest.approx(tree.gain[n]), tree.feature[n], tree.cut[n]) for n in tree.feature} == want
    binned.unpersist()


def test_draws_have_mean_and_variance_one_and_differ_by_tree():
    h = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 40000)
    draws = [forest.drawn(h, 42, t) for t in range(9)]
    assert all(abs(d.mean() - 1) < 0.02 and abs(d.var() - 1) < 0.05 and d.min() == 0 for d in draws)
    assert all(abs(np.corrcoef(draws[a], draws[b])[0, 1]) < 0.02 for a in range(9) for b in range(a))
