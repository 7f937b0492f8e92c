"""Percentiles by nearest rank, exact and without any buffer of all values, and as mergeable sketches.

A quantile sketch of bounded size gives, for each percentile, two values that its rank lies between, and only the
values between them (a few in ten thousand) are looked at further: counted, bracketed again while there are too many, and
at last numbered by their counts. A bracket that the rank turns out to lie outside of is moved, so that the result never rests on
the sketch's error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import written

#: A sketch's rank error is one in so many rows; brackets are twice as wide to both sides.
ACCURACY = 10_000
#: Values between a percentile's bracket that are numbered in one task.
MOST_INSIDE = 200_000
#: Rows of a side that is broadcast.
BROADCAST_ROWS = 20_000


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def percentiles(df: DataFrame, keys: list[str], value: str, ps: list[int], most: int = MOST_INSIDE, accuracy: int = ACCURACY) -> DataFrame:
    """keys and p<percentile> for each of ps (whole numbers, 0 to 100) of the non-null values of each group: the least value that at least so many of 100 values don't exceed.

    Groups without values have no row. Keys may be null. The values are written down once, and read two or three times.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    rows = written(df.where(F.col(value).isNotNull()).select(key.alias("_k"), F.col(value).alias("v")), "percentile-values")
    ends = [x for p in ps for x in (max(0.0, p / 100 - 2 / accuracy), min(1.0, p / 100 + 2 / accuracy))]
    g = rows.groupBy("_k").agg(F.count("*").alias("n"), F.percentile_approx("v", ends, accuracy).alias("q"))
    asked = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.greatest(F.lit(1), F.ceil(F.col("n") * p / 100)).cast("long").alias("rank"), F.col("q")[2 * i].alias("lo"), F.col("q")[2 * i + 1].alias("hi")) for i, p in enumerate(ps)]))
    # a bracket without an end is open there
    state, done = written(g.select("_k", asked.alias("a")).select("_k", "a.*", F.lit(None).cast("long").alias("before")), "percentile-brackets"), None
    above, below = F.col("lo").isNull() | (F.col("v") >= F.col("lo")), F.col("hi").isNull() | (F.col("v") <= F.col("hi"))
    while True:
        met = rows.join(_sized(state), "_k")
        inside = above & below
        c = met.groupBy("_k", "p", "rank", "lo", "hi", "before").agg(F.count_if(~above).alias("under"), F.count_if(inside).alias("inside"), F.min(F.when(inside, F.col("v"))).alias("least"), F.max(F.when(inside, F.col("v"))).alias("greatest"))
        c = written(c, "percentile-counts")
        found = c.where((F.col("rank") > F.col("under")) & (F.col("rank") <= F.col("under") + F.col("inside")))
        # values that a narrower bracket doesn't part, as few are so many times there, are numbered as they are
        enough = (F.col("inside") <= most) | (F.col("least") == F.col("greatest")) | F.coalesce(2 * F.col("inside") > F.col("before"), F.lit(False))
        ready = found.where(enough)
        done = ready if done is None else done.unionByName(ready)
        wide = found.where(~enough).select("_k", "p", "rank", "lo", "hi", "under", "inside")
        moved = c.where((F.col("rank") <= F.col("under")) | (F.col("rank") > F.col("under") + F.col("inside")))
        null = F.lit(None).cast(rows.schema["v"].dataType)
        moved = moved.select("_k", "p", "rank", F.when(F.col("rank") > F.col("under"), F.col("hi")).otherwise(null).alias("lo"), F.when(F.col("rank") <= F.col("under"), F.col("lo")).otherwise(null).alias("hi"), F.lit(None).cast("long").alias("before"))
        if not wide.isEmpty():
            # quantiles have to be constants: those of all shares that are asked for, in steps of a hundredth
            steps = [i / 100 for i in range(101)]
            again = rows.join(_sized(wide), "_k").where(above & below).groupBy("_k", "p", "rank", "under", "inside").agg(F.percentile_approx("v", steps, max(accuracy, ACCURACY)).alias("q"))
            share = F.floor((F.col("rank") - F.col("under") - 1) * 100 / F.col("inside")).cast("int")
            at = lambda i: F.element_at("q", F.least(F.lit(101), F.greatest(F.lit(1), i)))
            moved = moved.unionByName(again.select("_k", "p", "rank", at(share).alias("lo"), at(share + 3).alias("hi"), F.col("inside").alias("before")))
        state = written(moved, "percentile-brackets")
        if state.isEmpty():
            break
    last = rows.join(_sized(written(done, "percentile-done")), "_k").where(above & below)
    upto = F.sum("n").over(Window.partitionBy("_k", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    numbered = last.groupBy("_k", "p", "rank", "under", "v").agg(F.count("*").alias("n")).withColumn("upto", F.col("under") + upto)
    out = numbered.where(F.col("upto") >= F.col("rank")).groupBy("_k").agg(*[F.min(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in ps])
    return out.select(*[F.col(f"_k.{k}").alias(k) for k in keys], *[f"p{p}" for p in ps])


def _kind(value: str, df: DataFrame) -> str:
    return "bigint" if df.schema[value].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "double"


def sketches(df: DataFrame, keys: list, value: str, k: int = 800) -> DataFrame:
    """keys and sketch: a rollup of the values that can be merged further (merged_percentiles()). k sets its size, and with it the error of ranks: about 0.4 % at 800."""
    kind = _kind(value, df)
    cast = F.col(value).cast(kind)
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.call_function(f"kll_sketch_agg_{kind}", cast, F.lit(k)).alias("sketch"))


def merged_percentiles(rollup: DataFrame, keys: list[str], ps: list[int], kind: str = "bigint") -> DataFrame:
    """keys and p<percentile>, approximate, from the sketches of a rollup: of any range of its rows, without the values."""
    g = rollup.groupBy(*keys).agg(F.call_function(f"kll_merge_agg_{kind}", F.col("sketch")).alias("_s"))
    return g.select(*keys, *[F.call_function(f"kll_sketch_get_quantile_{kind}", F.col("_s"), F.lit(p / 100)).alias(f"p{p}") for p in ps])
