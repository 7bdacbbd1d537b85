"""Factor selection by regularised and tree models, votes, walk-forward splits and formula search."""

from __future__ import annotations

import gc
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fractions import Fraction
from functools import partial

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.language import evaluate, prepared
from millrace.operators.blocks import fewer_parts
from millrace.operators.boosting import LEAF_WISE, SECOND_ORDER, Growth, binned_rows, boost, boosted_selection
from millrace.operators.coefficients import rank_coefficients
from millrace.operators.forest import forest, shares
from millrace.operators.neural import neural_selection
from millrace.operators.summary import ic_series
from millrace.sources.scratch import settled

#: What start formulas are made of: functions of a factor's cross-section, functions of those, and pairs.
HEADS, WRAPPERS, PAIRED = ("cs_rank", "cs_zscore", "cs_demean"), ("square", "sqrt_abs", "log_abs", "sign", "neg"), ("+", "-", "*", "/")
#: Mixtures whose ranks are found by one query.
AT_ONCE = 64
#: Penalties that the linear selectors try.
PENALTIES = tuple(float(p) for p in np.logspace(-4, 0, 50))


def features(panel: DataFrame, factors: Sequence[str], ret: str = "forward_1d_ret") -> DataFrame:
    """``(date, stock_id, features vector, label)``; nulls are zero."""
    from pyspark.ml.feature import VectorAssembler

    filled = panel.select("date", "stock_id", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in factors], F.col(ret).cast("double").alias("label")).where("label is not null")
    return VectorAssembler(inputCols=list(factors), outputCol="features").transform(filled).select("date", "stock_id", "features", "label")


def walk_forward(panel: DataFrame, folds: int = 5, first: float = 0.5, least: int = 60, margin: int = 20) -> DataFrame:
    """``(fold, train_end, test_start, test_end)`` as dates.

    Training begins with share ``first`` of the dates, ``least`` at least, and
    grows by equal steps; a test goes on to the date on which the next one
    begins. Folds whose training ends within ``margin`` dates of the end are
    left out.
    """
    place = F.row_number().over(Window.orderBy("date")) - 1  # one row per date
    days = panel.select("date").distinct().select("date", place.alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    start = F.greatest(F.floor(F.col("n") * first).cast("int"), F.lit(least))
    step = F.floor((F.col("n") - start) / folds).cast("int")
    out = days.select("date", "i", "n", start.alias("s"), step.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    cut = F.col("s") + F.col("fold") * F.col("w")
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("date")))
    return out.where((cut < F.col("n") - margin) & (cut > 0)).groupBy("fold").agg(at(cut - 1).alias("train_end"), at(cut).alias("test_start"), at(F.least(cut + F.col("w"), F.col("n") - 1)).alias("test_end"))


@dataclass(frozen=True)
class Moments:
    """Count, means and summed products of deviations of all features and, last, the label."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n, d = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + d * other.n / n, self.scatter + other.scatter + np.outer(d, d) * self.n * other.n / n)


def moments(data: DataFrame, k: int, part: Column | None = None) -> dict[int, Moments]:
    """Moments of each ``part`` of the rows, of which there are few; one aggregation gives all."""
    from pyspark.ml.functions import vector_to_array

    x = vector_to_array("features")
    names = [f"x{i}" for i in range(k)] + ["y"]
    wide = data.select((F.lit(0) if part is None else part).alias("part"), *[x[i].alias(f"x{i}") for i in range(k)], F.col("label").alias("y"))
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    rows = wide.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in names], *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in rows:
        scatter = np.zeros((k + 1, k + 1))
        for i, j in pairs:
            scatter[i, j] = scatter[j, i] = r[f"c{i}_{j}"] * r["n"]
        out[r["part"]] = Moments(r["n"], np.array([r[f"m_{c}"] for c in names]), scatter)
    return out


def descend(gram: np.ndarray, xy: np.ndarray, penalty: float, mix: float, w: np.ndarray, least: float, sweeps: int = 10000) -> np.ndarray:
    """Minimum of half the mean squared error plus penalty (mix |w| + (1 - mix) w w / 2) by coordinate descent from ``w``."""
    w = w.copy()
    for _ in range(sweeps):
        moved = 0.0
        for j in np.flatnonzero(np.diag(gram) > 0):
            pull = xy[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - penalty * mix, 0.0) / (gram[j, j] + penalty * (1 - mix))
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved <= least:
            break
    return w


def linear_selection(data: DataFrame, factors: Sequence[str], penalties: Sequence[float] = PENALTIES, mixes: Sequence[float] = (1.0,), folds: int = 5) -> dict[str, float]:
    """Coefficients over 1e-6 in size of the lasso (mix 1) or elastic net of least error over expanding folds.

    Moments of the stretches between the folds' dates hold all that fits and
    errors need, so any number of penalties takes one pass of the rows.
    """
    k = len(factors)
    ends = [e for e in walk_forward(data, folds, least=2, margin=0).collect() if e.test_end and e.train_end and e.test_end > e.train_end]  # one row per fold
    bounds = sorted({d for e in ends for d in (e.train_end, e.test_end)})
    parts = moments(data, k, sum(((F.col("date") > d).cast("int") for d in bounds), F.lit(0)))
    none = Moments(0, np.zeros(k + 1), np.zeros((k + 1, k + 1)))
    join = lambda lo, hi: sum((parts[i] for i in range(lo, hi) if i in parts), none)
    whole = join(0, len(bounds) + 1)
    if not whole.n:
        return {}
    dev = np.sqrt(np.diag(whole.scatter) / whole.n)
    small, dev = 1e-9 * dev[-1], np.append(np.where(dev[:-1] > 0, dev[:-1], 1.0), 1.0)
    scaled = lambda m: Moments(m.n, m.mean / dev, m.scatter / np.outer(dev, dev))
    splits = [(scaled(join(0, bounds.index(e.train_end) + 1)), scaled(join(bounds.index(e.train_end) + 1, bounds.index(e.test_end) + 1))) for e in ends]
    splits = [(a, b) for a, b in splits if a.n and b.n]
    falling = sorted(penalties, reverse=True)

    def path(m: Moments, mix: float) -> list[np.ndarray]:
        out = [np.zeros(k)]
        for p in falling:
            out.append(descend(m.scatter[:k, :k] / m.n, m.scatter[:k, k] / m.n, p, mix, out[-1], small))
        return out[1:]

    def errors(train: Moments, test: Moments, mix: float) -> list[float]:
        off = [np.append(-w, 1.0) for w in path(train, mix)]
        return [float(v @ test.scatter @ v / test.n + (v @ (test.mean - train.mean)) ** 2) for v in off]

    cost = {mix: np.mean([errors(a, b, mix) for a, b in splits], axis=0) if splits else np.zeros(len(falling)) for mix in mixes}
    best = min(mixes, key=lambda mix: cost[mix].min())
    fitted = path(scaled(whole), best)[int(cost[best].argmin())]
    return {f: float(c) for f, c in zip(factors, fitted, strict=True) if abs(c) > 1e-6}


def elastic_selection(data: DataFrame, factors: Sequence[str], penalties: Sequence[float] = PENALTIES, mixes: Sequence[float] = (0.1, 0.3, 0.5, 0.7, 0.9), folds: int = 5) -> dict[str, float]:
    """``linear_selection`` of an elastic net."""
    return linear_selection(data, factors, penalties, mixes, folds)


def early_end(data: DataFrame, share: float = 0.8):
    """The last date up to which at most ``share`` of the rows lie, if any."""
    days = data.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    so_far, n = F.sum("n").over(Window.orderBy("date")), F.sum("n").over(Window.partitionBy())  # one row per date
    return days.select("date", (so_far <= share * n).alias("early")).where("early").agg(F.max("date")).first()[0]


def tree_selection(data: DataFrame, factors: Sequence[str], kind: str = "forest", top: int = 10, seed: int = 42, **options) -> dict[str, float]:
    """The ``top`` importances of a random forest or of boosted trees: mean shares in the gains of a tree."""
    k = len(factors)
    if kind == "forest":
        o = {"numTrees": 500, "maxDepth": 6, "minInstancesPerNode": 20} | options
        trees = forest(data, k, o["numTrees"], o["maxDepth"], o["minInstancesPerNode"], seed)
    else:
        o = {"maxIter": 200, "stepSize": 0.05, "maxDepth": 4} | options
        how = Growth(trees=o["maxIter"], depth=o["maxDepth"], rate=o["stepSize"], penalty=0.0, rows=1.0, columns=1.0, seed=seed)
        trees, _ = boost(binned_rows(data, k, None)[0], k, how)
    return dict(sorted(((f, float(w)) for f, w in zip(factors, shares(trees, k), strict=True) if w > 0), key=lambda x: -x[1])[:top])


def histogram_selection(data: DataFrame, factors: Sequence[str], how: Growth = SECOND_ORDER, top: int = 10) -> dict[str, float]:
    """``boosted_selection`` that stops by the last fifth of the rows by date."""
    return boosted_selection(data, factors, how, early_end(data), top)


def ridge_selection(data: DataFrame, factors: Sequence[str], least: float = 1.0, steps: int = 300) -> dict[str, float]:
    """Bayesian ridge by evidence maximisation; factors whose coefficient exceeds ``least`` deviations.

    The cluster sums products (k x k numbers); the driver solves.
    """
    k = len(factors)
    found = moments(data, k).get(0)
    if found is None:
        return {}
    cov = found.scatter / found.n
    dev = np.where(np.diag(cov) > 0, np.sqrt(np.maximum(np.diag(cov), 0)), 1.0)
    n, gram, xy, yy = found.n, cov[:k, :k] / np.outer(dev[:k], dev[:k]) * found.n, cov[:k, k] / dev[:k] * found.n, cov[k, k] * found.n
    noise, prior = (n / yy if yy > 0 else 1.0), 1.0
    eig = np.maximum(np.linalg.eigvalsh(gram), 0)
    for _ in range(steps):
        s = np.linalg.inv(noise * gram + prior * np.eye(k))
        w = noise * s @ xy
        used = float((noise * eig / (noise * eig + prior)).sum())
        left = max(yy - 2 * w @ xy + w @ gram @ w, 1e-12)
        new = used / max(float(w @ w), 1e-12), max(n - used, 1e-12) / left
        done = abs(new[0] - prior) <= 1e-6 * prior and abs(new[1] - noise) <= 1e-6 * noise
        prior, noise = new
        if done:
            break
    return {f: float(c) for f, c, v in zip(factors, w, np.diag(s), strict=True) if abs(c) > least * np.sqrt(v)}


def votes(selected: DataFrame, methods: int) -> DataFrame:
    """``(factor, n_votes)`` of factors that at least max(2, methods // 2) of ``selected(method, factor)`` chose."""
    return selected.distinct().groupBy("factor").agg(F.count(F.lit(1)).alias("n_votes")).where(F.col("n_votes") >= max(2, methods // 2))


def start_formula(rng: random.Random, names: Sequence[str]) -> str:
    """A random formula of one or two factors."""
    leaf = lambda: f"{rng.choice(HEADS)}({rng.choice(list(names))})"
    shape = rng.randrange(4)
    if shape == 0:
        return leaf()
    if shape == 1:
        return f"{rng.choice(WRAPPERS)}({leaf()})"
    if shape == 2:
        return f"{rng.choice(('max', 'min'))}({leaf()}, {leaf()})"
    return f"{leaf()} {rng.choice(PAIRED)} {leaf()}"


def fitness(panel: DataFrame, formulas: Sequence[str], ret: str = "forward_1d_ret", least: int = 10) -> dict[str, float]:
    """Mean rank coefficient of each formula, in size; all are columns of one frame and share one aggregation."""
    named = {f"_f{i}": text for i, text in enumerate(formulas)}
    scored = evaluate(panel, named, panel.columns).select("date", "stock_id", ret, *named)
    rows = ic_series(scored, list(named), ret, least).groupBy("factor").agg(F.avg("ic").alias("ic")).collect()  # one row per formula
    got = {r["factor"]: abs(r["ic"]) for r in rows if r["ic"] is not None}
    return {text: got.get(name, 0.0) for name, text in named.items()}


#: A mixture of start formulas: their places and weights, by place.
Mixture = tuple[tuple[int, Fraction], ...]


def mixed(a: Mixture, b: Mixture) -> Mixture:
    """The mean of two mixtures."""
    out: dict[int, Fraction] = {}
    for i, w in (*a, *b):
        out[i] = out.get(i, Fraction(0)) + w / 2
    return tuple(sorted(out.items()))


def mixture_text(mixture: Mixture, formulas: Sequence[str]) -> str:
    """The mixture in the factor language."""
    if len(mixture) == 1:
        return formulas[mixture[0][0]]
    return " + ".join(f"{float(w)!r} * ({formulas[i]})" for i, w in mixture)


def mixture_fitness(wide: DataFrame, formulas: Sequence[Column], mixtures: Sequence[Mixture], ret: str, least: int) -> dict[Mixture, float]:
    """Mean rank coefficient of each mixture of ``formulas``, columns over ``wide``, in size.

    Mixtures are taken ``AT_ONCE``; what Spark has shuffled for the last ones is
    let go before the next.
    """
    got: dict[Mixture, float] = {}
    for lo in range(0, len(mixtures), AT_ONCE):
        some = mixtures[lo : lo + AT_ONCE]
        used = sorted({i for m in some for i, _ in m})
        sums = [[(used.index(i), float(w)) for i, w in m] for m in some]
        ic = rank_coefficients(wide, ret, [formulas[i] for i in used], sums=sums).where((F.col("n") >= least) & F.col("ic").isNotNull())
        got |= {some[r["i"]]: abs(r["ic"]) for r in ic.groupBy("i").agg(F.avg("ic").alias("ic")).collect()}  # one row per mixture
        del ic
        gc.collect()
        wide.sparkSession.sparkContext._jvm.System.gc()  # shuffle files go once the driver has forgotten their query
    return {m: got.get(m, 0.0) for m in mixtures}


def search_formulas(panel: DataFrame, names: Sequence[str], generations: int = 20, size: int = 100, crossover: float = 0.6, mutation: float = 0.2, seed: int = 42, least: int = 10, ret: str = "forward_1d_ret") -> list[tuple[str, float]]:
    """Genetic search: ``(formula, mean absolute rank coefficient)`` of the last generation, best first.

    A tenth, two at least, goes on; a child is the mean of two parents, a new
    formula or a parent, by the two rates. Means of means are weights of start
    formulas, whose cross-sections are written once; a formula is a sum of
    columns over these, however old it is. New formulas come from as many as
    the first generation has.
    """
    rng = random.Random(seed)
    formulas = list(dict.fromkeys(start_formula(rng, names) for _ in range(2 * size)))
    wide, columns = prepared(panel, {f"_b{i}": text for i, text in enumerate(formulas)}, panel.columns)
    wide, columns = settled(wide.select("date", ret, *[c for c in wide.columns if c not in ("date", ret)])), list(columns.values())
    one = lambda: ((rng.randrange(len(formulas)), Fraction(1)),)
    known: dict[Mixture, float] = {}
    pool = [one() for _ in range(size)]
    for step in range(generations + 1):
        if fresh := sorted(set(pool) - set(known)):
            known |= mixture_fitness(wide, columns, fresh, ret, least)
        ranked = sorted(set(pool), key=lambda m: (-known[m], mixture_text(m, formulas)))
        if step == generations:
            break
        children = ranked[: max(2, size // 10)]
        while len(children) < size:
            if rng.random() < crossover:
                children.append(mixed(rng.choice(ranked), rng.choice(ranked)))
            else:
                children.append(one() if rng.random() < mutation else rng.choice(ranked))
        pool = children
    return [(mixture_text(m, formulas), known[m]) for m in ranked]


#: Selectors that run side by side: their jobs are short, so that one's tasks run while others' are planned and gathered.
SELECTORS_AT_ONCE = 4
#: Every selector with its own parameters.
METHODS = {
    "ridge": ridge_selection, "lasso": linear_selection, "elastic": elastic_selection, "neural": neural_selection, "forest": tree_selection,
    "boosted": partial(tree_selection, kind="boosted"), "second_order": histogram_selection, "leaf_wise": partial(histogram_selection, how=LEAF_WISE),
}


def mine(panel: DataFrame, factors: Sequence[str], methods: dict | None = None) -> DataFrame:
    """``(method, factor, weight)`` that each of ``methods(data, factors) -> {factor: weight}`` selects on ``panel``."""
    methods, spark = methods or METHODS, panel.sparkSession
    data = fewer_parts(settled(features(panel, factors))).persist()
    data.count()  # held before several selectors read it
    with ThreadPoolExecutor(SELECTORS_AT_ONCE) as pool:
        found = list(pool.map(inheritable_thread_target(spark)(lambda select: select(data, factors)), methods.values()))
    data.unpersist()
    rows = [(m, f, w) for m, chosen in zip(methods, found, strict=True) for f, w in chosen.items()]  # at most one row per method and factor
    return spark.createDataFrame(rows, "method string, factor string, weight double")


def mine_walk_forward(panel: DataFrame, factors: Sequence[str], methods: dict | None = None, **folds) -> DataFrame:
    """``(fold, method, factor, weight)`` of each fold's training rows."""
    out = None
    for e in walk_forward(panel, **folds).orderBy("fold").collect():  # one row per fold
        found = mine(panel.where(F.col("date") <= F.lit(e["train_end"])), factors, methods).select(F.lit(e["fold"]).alias("fold"), "method", "factor", "weight")
        out = found if out is None else out.union(found)
    return out if out is not None else panel.sparkSession.createDataFrame([], "fold int, method string, factor string, weight double")


def consensus(selected: DataFrame, share: float = 0.5) -> DataFrame:
    """``(factor, n_votes, share)`` of factors that at least ``share`` of all (fold, method) pairs of ``selected`` chose."""
    every = selected.select("fold", "method").distinct().agg(F.count(F.lit(1)).alias("_n"))
    votes_ = selected.select("fold", "method", "factor").distinct().groupBy("factor").agg(F.count(F.lit(1)).alias("n_votes"))
    return votes_.crossJoin(F.broadcast(every)).select("factor", "n_votes", (F.col("n_votes") / F.col("_n")).alias("share")).where(F.col("share") >= share)  # one row
