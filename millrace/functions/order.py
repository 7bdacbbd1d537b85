"""Places of values in their groups: exact ranks and quantiles without a group's rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stretches into which a large group's values are dealt, and distinct values that a stretch should hold at least.
STRETCHES, LEAST_VALUES = 64, 4096


def joined_on(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``df`` with the columns of ``table`` for equal ``keys``, nulls being equal."""
    named = table.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys]
    return df.join(named, on, how).drop(*[f"_on_{k}" for k in keys])


def cumulative(df: DataFrame, by: Sequence[str], value: str, stretches: int = STRETCHES, least: int = LEAST_VALUES) -> DataFrame:
    """``(*by, value, n, before, total)``: each distinct value of a group, how often it occurs, and how many smaller ones the group has.

    Equal values are counted first, so no tie is ever split or gathered. A
    group's stretches end at values whose hash falls under a share, about
    ``stretches`` of them, which any recomputation chooses alike; values are
    summed within their stretch and stretches (a bounded number) over the group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.greatest(F.lit(least), F.ceil(F.count(F.lit(1)) / stretches)).cast("long").alias("_every"))
    sized = joined_on(counts, sizes, by, "inner")
    chosen = F.pmod(F.xxhash64(*by, value), F.col("_every")) == 0
    edges = sized.where(chosen).groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("_edges"))
    placed = joined_on(sized, edges, by).withColumn("_s", F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col(value))), F.lit(0))).drop("_edges", "_every")
    ahead = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    offsets = placed.groupBy(*by, "_s").agg(F.sum("n").alias("_n")).select(*by, "_s", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"))
    here = Window.partitionBy(*by, "_s").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_here", F.coalesce(F.sum("n").over(here), F.lit(0)))
    return joined_on(local, offsets, [*by, "_s"], "inner").select(*by, value, "n", (F.col("_offset") + F.col("_here")).alias("before"), "total")


def average_rank() -> Column:
    """Mean place, from 1, of the rows that share a value of ``cumulative``."""
    return F.col("before") + (F.col("n") + 1) / 2


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a b + c, rounded once: the product's and the sum's own errors are added last (Dekker, Knuth)."""

    def halves(x: Column) -> tuple[Column, Column]:
        wide = x * F.lit(134217729.0)
        upper = wide - (wide - x)
        return upper, x - upper

    product = a * b
    (a1, a2), (b1, b2) = halves(a), halves(b)
    off = ((a1 * b1 - product) + a1 * b2 + a2 * b1) + a2 * b2
    total = product + c
    part = total - product
    lost = (product - (total - part)) + (c - part)
    exact = total + (off + lost)
    return F.when(F.isnan(exact), total).otherwise(exact)  # infinite values and NaN have no halves


def quantiles(places: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], name: str) -> DataFrame:
    """``(*by, name array)``: values at ``shares`` of the way from a group's least to its greatest, between two values in proportion.

    The proportion is taken as ``quantile_cont`` takes it: ``low (1 - d)`` is not
    rounded before ``high d`` is added, and also between two equal values, where
    the last bit may fall beside them.

    ``places`` is what ``cumulative`` gives; the values around each place are
    picked by one aggregation.
    """
    at = [(F.col("total") - 1) * F.lit(float(q)) for q in shares]
    holds = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("n"))
    picked = places.groupBy(*by).agg(F.max("total").alias("total"), *[x for i, p in enumerate(at) for x in (
        F.max(F.when(holds(F.floor(p)), F.col(value))).alias(f"_l{i}"), F.max(F.when(holds(F.ceil(p)), F.col(value))).alias(f"_h{i}"))])
    between = []
    for i, p in enumerate(at):
        low, high, d = F.col(f"_l{i}").cast("double"), F.col(f"_h{i}").cast("double"), p - F.floor(p)
        between.append(F.when(F.ceil(p) == F.floor(p), low).otherwise(_fused(low, 1 - d, high * d)))
    return picked.select(*by, F.array(*between).alias(name))
