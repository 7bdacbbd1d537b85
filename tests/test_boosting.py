"""Boosted trees against a plain search over all rows."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from millrace.operators import boosting
from millrace.operators.boosting import Growth

K = 3


def rows(n=240, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (n, K)).astype(float)
    y = np.where(x[:, 0] > 2, 1.0, -1.0) + 0.5 * (x[:, 1] > 3) * (x[:, 0] > 2) + 0.05 * rng.normal(size=n)
    return x, y, np.array([f"2024-{1 + i // 60:02}-01" for i in range(n)])


def frame(spark, x, y, dates):
    return spark.createDataFrame([(d, i, Vectors.dense(r), v) for i, (d, r, v) in enumerate(zip(dates.tolist(), x.tolist(), y.tolist(), strict=True))], ["date", "stock_id", "features", "label"]).repartition(4)


def plain_tree(x, g, how, columns):
    """One tree by trying each value of each feature on the rows of each leaf."""
    leaves, splits = {0: np.arange(len(g))}, {}

    def best(at):
        found = None
        for f in columns:
            for cut in sorted(set(x[:, f]))[:-1]:
                left, right = at[x[at, f] <= cut], at[x[at, f] > cut]
                if min(len(left), len(right)) < how.least_weight:
                    continue
                score = lambda i: g[i].sum() ** 2 / (len(i) + how.penalty)
                gain = 0.5 * (score(left) + score(right) - score(at))
                if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, f, cut, left, right)
        return found

    while how.leaves is None or len(leaves) < how.leaves:
        ready = [(s[0], -node, s) for node, at in leaves.items() if (node + 1).bit_length() <= how.depth and (s := best(at))]
        if not ready:
            break
        gain, node, (_, f, cut, left, right) = max(ready, key=lambda r: r[:2])
        splits[-node] = (f, cut, gain)
        leaves.pop(-node)
        leaves[2 * -node + 1], leaves[2 * -node + 2] = left, right
    out = np.zeros(len(g))
    for at in leaves.values():
        out[at] = -how.rate * g[at].sum() / (len(at) + how.penalty)
    return splits, out


@pytest.mark.parametrize("how", [
    Growth(trees=6, depth=3, rate=0.3, rows=1.0, columns=1.0), Growth(trees=6, depth=4, rate=0.3, leaves=5, penalty=0.0, least_weight=10.0, rows=1.0, columns=0.7)])
def test_trees_equal_those_of_a_plain_search(spark, how, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 4)
    x, y, dates = rows()
    data, mean = boosting.binned_rows(frame(spark, x, y, dates), K, None)
    assert abs(mean - y.mean()) < 1e-12
    trees, best = boosting.boost(data, K, how)
    assert len(trees) == best == 6
    pred = np.full(len(y), y.mean())
    for i, t in enumerate(trees):
        splits, step = plain_tree(x, pred - y, how, boosting.drawn_columns(K, how, i))
        assert {n: (t.feature[n], pytest.approx(t.gain[n], rel=1e-6)) for n in t.feature} == {n: (f, gain) for n, (f, _, gain) in splits.items()}
        pred = pred + step
    binned = data.toPandas()
    got = binned.pred + sum(t.predict(np.frombuffer(b"".join(binned.bins), dtype=np.uint8).reshape(-1, K)) for t in trees)
    assert np.allclose(sorted(got), sorted(pred))
    assert np.mean((pred - y) ** 2) < 0.2 * np.var(y)


def test_it_stops_after_patience_and_counts_trees_of_least_error(spark):
    rng = np.random.default_rng(4)
    x, y, dates = rows(400, 1)
    late = dates > "2024-03-01"
    y = np.where(late, rng.normal(size=len(y)), y)
    how = Growth(trees=60, depth=2, rate=0.5, patience=3, rows=0.8, columns=1.0)
    trees, best = boosting.boost(boosting.binned_rows(frame(spark, x, y, dates), K, "2024-03-01")[0], K, how)
    assert len(trees) == best + 3 < 60


def test_sampled_rows_and_columns_are_shares():
    how = Growth(rows=0.8, columns=0.5)
    h = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 20000)
    shares = [boosting._sampled(h, how, t) for t in range(3)]
    assert all(abs(s.mean() - 0.8) < 0.02 for s in shares) and (shares[0] != shares[1]).any()
    drawn = [boosting.drawn_columns(10, how, t) for t in range(40)]
    assert all(len(d) == 5 for d in drawn) and len({tuple(d) for d in drawn}) > 20 and {f for d in drawn for f in d} == set(range(10))
    assert boosting.drawn_columns(3, Growth(columns=0.1), 0)


def test_selection_names_what_matters_and_empty_or_flat_tables_choose_nothing(spark):
    x, y, dates = rows()
    data = frame(spark, x, y, dates)
    for how in (Growth(trees=8, rate=0.3), Growth(trees=8, rate=0.3, leaves=15, penalty=0.0, least_weight=20.0, rows=1.0)):
        got = boosting.boosted_selection(data, ["a", "b", "c"], how, "2024-03-01", top=2)
        assert list(got)[0] == "a" and len(got) == 2 and sum(got.values()) <= 1 + 1e-9
        assert boosting.boosted_selection(data.limit(0), ["a", "b", "c"], how) == {}
        assert boosting.boosted_selection(frame(spark, x, np.ones(len(y)), dates), ["a", "b", "c"], how) == {}
