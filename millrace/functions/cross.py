"""Functions of a row's cross-section (the rows of its date), from aggregates that are joined back to the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.order import average_rank, cumulative, joined_on, quantiles
from millrace.sources.scratch import settled

EPS = 1e-10


@dataclass(frozen=True)
class Cross:
    """A function of ``value`` and of statistics of its group: aggregates, quantiles at ``shares``, the rank as a share."""

    value: Column
    build: Callable[..., Column]
    stats: tuple[Callable[[Column], Column], ...] = ()
    shares: tuple[float, ...] = ()
    rank: bool = False


def pct_rank(x: Column) -> Cross:
    """Average rank of ``x`` as a share of the group's values; null stays null."""
    return Cross(x, lambda _, share: share, rank=True)


def zscore(x: Column, eps: float = EPS) -> Cross:
    """Distance from the group's mean in its deviations (``eps`` added)."""
    return Cross(x, lambda x, mean, dev: (x - mean) / (dev + eps), (F.avg, F.stddev_samp))


def guarded_zscore(x: Column) -> Cross:
    """As ``zscore`` without ``eps``; zero where the group's values do not vary."""

    def of(x: Column, mean: Column, dev: Column) -> Column:
        dev = F.coalesce(dev, F.lit(0.0))
        return F.when(dev == 0, x * 0).otherwise(F.try_divide(x - mean, dev))

    return Cross(x, of, (F.avg, F.stddev_samp))


def winsorized(x: Column, limit: float = 0.01) -> Cross:
    """``x`` clipped to the group's ``limit`` and 1 - ``limit`` quantiles; null stays null."""
    return Cross(x, lambda x, edges: F.when(x.isNotNull(), F.least(F.greatest(x, edges[0]), edges[1])), shares=(limit, 1 - limit))


def bucket(x: Column, n: int) -> Cross:
    """Which of ``n`` quantile buckets of its group holds ``x``, from 0; equal edges merge."""
    below = lambda x, edges: F.size(F.filter(F.array_distinct(edges), lambda e: e < x)) - 1
    return Cross(x, lambda x, edges: F.when(x.isNotNull(), F.greatest(below(x, edges), F.lit(0))), shares=tuple(i / n for i in range(n + 1)))


def minmax(x: Column) -> Cross:
    return Cross(x, lambda x, low, high: (x - low) / (high - low + EPS), (F.min, F.max))


def demean(x: Column) -> Cross:
    return Cross(x, lambda x, mean: x - mean, (F.avg,))


def with_cross(df: DataFrame, new: dict[str, Cross], by: Sequence[str] = ("date",)) -> DataFrame:
    """``df`` with a column for each of ``new``; nulls of ``by`` are a group of their own.

    One aggregation gives all moments. Ranks and quantiles of a column come
    from the counts of its distinct values, which meet the rows again by value;
    so the rows are written once first, lest a sum comes out otherwise in a
    second computation.
    """
    out = df.withColumns({f"_x_{name}": c.value for name, c in new.items()})
    if any(c.rank or c.shares for c in new.values()):
        out = settled(out)
    kept = lambda *more: out.select(*by, *more)
    if moments := [agg(F.col(f"_x_{name}")).alias(f"_s{i}_{name}") for name, c in new.items() for i, agg in enumerate(c.stats)]:
        out = joined_on(out, kept(*[f"_x_{name}" for name in new]).groupBy(*by).agg(*moments), by)
    for name, c in new.items():
        if c.rank or c.shares:
            places = cumulative(kept(f"_x_{name}"), by, f"_x_{name}")
            if c.shares:
                out = joined_on(out, quantiles(places, by, f"_x_{name}", c.shares, f"_q_{name}"), by)
            if c.rank:
                out = joined_on(out, places.select(*by, f"_x_{name}", (average_rank() / F.col("total")).alias(f"_r_{name}")), [*by, f"_x_{name}"])
    built = {}
    for name, c in new.items():
        given = [F.col(f"_s{i}_{name}") for i in range(len(c.stats))] + ([F.col(f"_q_{name}")] if c.shares else []) + ([F.col(f"_r_{name}")] if c.rank else [])
        built[name] = c.build(F.col(f"_x_{name}"), *given)
    return out.select(*[c for c in df.columns if c not in new], *[v.alias(k) for k, v in built.items()])


def combined(df: DataFrame, factors: Sequence[str], name: str, weights: Sequence[float] | None = None, signs: Sequence[int] | None = None) -> DataFrame:
    """``df`` with ``name``: the weighted mean of the factors' guarded z-scores; null where one of them is."""
    weights = weights or [1.0] * len(factors)
    signs = signs or [1] * len(factors)
    total = sum(abs(w) for w in weights) or 1.0
    scored = with_cross(df, {f"_z{i}": guarded_zscore(F.col(f)) for i, f in enumerate(factors)})
    score = sum((F.lit(w * s / total) * F.col(f"_z{i}") for i, (w, s) in enumerate(zip(weights, signs, strict=True))), F.lit(0.0))
    return scored.withColumn(name, score).drop(*[f"_z{i}" for i in range(len(factors))])
