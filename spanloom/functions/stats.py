"""Statistics as aggregates, expressions and small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECENT = 200
EPSILON = 1e-6


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def baseline_aggregates(value: str) -> list[Column]:
    """count, mean, variance (sample, 0 for one value), min, max of the finite values."""
    x = finite(F.col(value))
    return [F.count(x).alias("count"), F.avg(x).alias("mean"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("variance"), F.min(x).alias("min"), F.max(x).alias("max")]


def merged_moments(n1: Column, mean1: Column, m1: Column, n2: Column, mean2: Column, m2: Column) -> tuple[Column, Column, Column]:
    """count, mean and sum of squared deviations of two parts together."""
    n = n1 + n2
    delta = mean2 - mean1
    return n, F.when(n > 0, mean1 + delta * n2 / n).otherwise(F.lit(0.0)), m1 + m2 + F.when(n > 0, delta * delta * n1 * n2 / n).otherwise(F.lit(0.0))


def zscore(x: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd > 0, (x - mean) / sd).otherwise(F.lit(0.0))


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, mean, median, min, max; 0 where there are no values."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*keys).agg(zero(F.avg(value)).alias("mean"), zero(F.median(value)).alias("median"), zero(F.min(value)).alias("min"), zero(F.max(value)).alias("max"))


def mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, med, mad: the median and the median absolute deviation from it."""
    med = df.groupBy(*keys).agg(F.median(value).alias("med"))
    return df.join(med, keys).groupBy(*keys).agg(F.first("med").alias("med"), F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))


def modified_zscore(x: Column, med: Column, deviation: Column) -> Column:
    return F.when(deviation > 0, 0.6745 * (x - med) / deviation).otherwise(F.lit(0.0))


def percentile_nr(value: str, p: float, exact: bool = True) -> Column:
    """Aggregate: the nearest-rank percentile, p in 0..100."""
    if exact:
        return F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})")
    return F.percentile_approx(value, p / 100, 10_000)


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """The equal-width bin of x, clamped; without a range all are in bin 0."""
    width = (high - low) / bins
    return F.when(width > 0, F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((x - low) / width)))).otherwise(F.lit(0)).cast("int")


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 10) -> DataFrame:
    """keys, bin, n over each group's own range; empty bins are left out."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return df.join(ends, keys).groupBy(*keys, bin_of(F.col(value), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count("*").alias("n"))


def shares(df: DataFrame, keys: list[str], value: str, side: str, bins: int = 10) -> DataFrame:
    """keys, bin, p, q: each group's histograms of two sides (boolean column side) over their common range, as shares."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count_if(~F.col(side)).alias("n0"), F.count_if(F.col(side)).alias("n1"))
    counts = df.join(ends, keys).groupBy(*keys, bin_of(F.col(value), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count_if(~F.col(side)).alias("c0"), F.count_if(F.col(side)).alias("c1"))
    each = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counts, [*keys, "bin"], "left")
    share = lambda c, n: F.coalesce(c, F.lit(0)) / F.greatest(n, F.lit(1))
    return each.select(*keys, "bin", share(F.col("c0"), F.col("n0")).alias("p"), share(F.col("c1"), F.col("n1")).alias("q"))


def psi(binned: DataFrame, keys: list[str]) -> DataFrame:
    """keys, psi: population stability index of shares()."""
    p, q = F.greatest("p", F.lit(EPSILON)), F.greatest("q", F.lit(EPSILON))
    return binned.groupBy(*keys).agg(F.abs(F.sum((q - p) * F.log(q / p))).alias("psi"))


def js_divergence(binned: DataFrame, keys: list[str]) -> DataFrame:
    """keys, js: Jensen-Shannon divergence of shares() to base 2, in 0..1."""
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(c > 0, c * F.log2(c / m)).otherwise(F.lit(0.0))
    return binned.groupBy(*keys).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(part(F.col("p")) + part(F.col("q"))) / 2)).alias("js"))


def norm_entropy(values: Column) -> Column:
    """Shannon entropy of an array of non-negative numbers over its greatest value; 0 for one value or none, or a sum of 0."""
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    entropy = F.aggregate(values, F.lit(0.0), lambda a, v: F.when(v > 0, a - v / total * F.log(v / total)).otherwise(a))
    return F.when((F.size(values) <= 1) | (total <= 0), F.lit(0.0)).otherwise(entropy / F.log(F.size(values)))
