"""Mixing sources to target weights by hash-threshold histograms.

Each document has a hash; each source takes its documents whole, k times, and those whose hash lies below a
threshold once more. The threshold is found from histograms: words are summed by source and hash bucket, the
bucket in which the budget ends is split into finer buckets, and so on until a single hash is left. Nothing is
sorted and no row is moved but the sums; the mix itself is a filter on the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, lookup, table, written

#: Weights of the sources in order of code points, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
MOST_REPEATS = 3
#: Sources at most; the directory of all of them is one task's work.
MOST_SOURCES = 1_000_000
HASH_BITS = 48
LEVEL_BITS = 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed(doc_id: Column) -> Column:
    """The first 48 bits of the id's MD5 as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """From one row a source (source, source_key, source_size): target, repeats (whole copies of each document) and rest (words beyond them).

    The cap binds for the sources with the least size for their weight; taken in that order, source k is capped
    while its size is below its share of what the sources before it leave. The windows over all sources are one task,
    of a row a source; more than MOST_SOURCES are an error.
    """
    if sizes.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    every = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("weight", F.element_at(every, (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long"))
    s = s.withColumn("cap", F.lit(most) * F.col("source_size"))
    all_rows = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("words", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", F.col("cap").cast("double") * F.col("weights") < F.col("words").cast("double") * F.col("weight"))
        .withColumn("left_words", F.max(F.when(~F.col("capped"), F.col("words"))).over(all_rows).cast("double"))
        .withColumn("left_weights", F.max(F.when(~F.col("capped"), F.col("weights"))).over(all_rows).cast("double"))
    )
    share = F.col("weight") * F.col("left_words")
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share / F.col("left_weights"))
    s = s.withColumn("target", F.coalesce(target, F.lit(0.0)))
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    s = s.withColumn("repeats", F.least(repeats, F.lit(most)).cast("long"))
    return s.select("source_key", "source_size", "target", "repeats", (F.col("target") - F.col("repeats") * F.col("source_size")).alias("rest"))


def thresholds(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source_key, threshold): documents with a hash below it are taken once more. Of equal hashes (one id's rows) all or none are; the last group is in if its middle lies within the budget."""
    state = targets.where("rest > 0").select("source_key", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    found = targets.where("rest <= 0").select("source_key", F.lit(0).cast("long").alias("threshold"))
    shift = HASH_BITS
    rows = docs.where("size > 0").select("source_key", "size", "h")
    while shift > 0:
        inside = lookup(rows, state, "source_key").where(F.shiftright("h", shift) == F.col("prefix"))
        shift -= LEVEL_BITS
        sums = inside.groupBy("source_key", "rest", "below", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        up_to = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.col("below") + F.sum("words").over(up_to))
        cut = (F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest"))
        level = sums.groupBy("source_key", "rest").agg(
            F.max(F.when(F.col("upto") <= F.col("rest"), F.col("hi") + 1)).alias("full"),
            F.max(F.when(cut, F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "words", "lo", "hi"))).alias("cut"),
        )
        level = written(level, "mix-level")
        done = F.col("cut").isNull() | (F.col("cut.lo") == F.col("cut.hi"))
        last_in = 2 * F.col("cut.before") + F.col("cut.words") <= 2 * F.col("rest")
        found = found.unionByName(
            level.where(done).select("source_key", F.when(F.col("cut").isNull(), F.coalesce("full", F.lit(0).cast("long"))).when(last_in, F.col("cut.hi") + 1).otherwise(F.col("cut.lo")).alias("threshold"))
        )
        state = level.where(~done).select("source_key", "rest", F.col("cut.bucket").alias("prefix"), F.col("cut.before").alias("below"))
        if state.isEmpty():
            break
    return found


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, carry: tuple = ()) -> DataFrame:
    """For each row of docs (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken, and the columns of docs named in carry.

    size is the number of words (null text: 0); a null source is a source of its own, the last. Documents without
    words are taken 0 times. Rows with one doc_id share a hash, hence their fate. An empty table gives an empty
    result. Other columns are ignored. Reruns agree, as nothing depends on the order of rows; rows without an id share
    the hash of an empty one.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    d = written(docs.select("doc_id", "source", key.alias("source_key"), n_words(F.col("text")).alias("size"), hashed(F.col("doc_id")).alias("h"), F.struct(F.lit(0), *carry).alias("carried")), "mix-docs")
    sizes = written(d.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), "mix-sizes")
    targets = written(source_targets(sizes, weights, most), "mix-targets")
    rule = written(targets.join(thresholds(d, targets), "source_key", "left"), "mix-rule")
    copies = F.when(F.col("size") > 0, F.col("repeats") + (F.col("h") < F.coalesce("threshold", F.lit(0).cast("long"))).cast("long")).otherwise(F.lit(0).cast("long"))
    return lookup(d, rule, "source_key").select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *[F.col(f"carried.{c}") for c in carry])


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("source")


#: The same mix by sorting: cumulated sizes in order of the hash.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, 3 * source_size AS cap FROM s0),
s2 AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE
            - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS a,
         (sum(w) OVER ())::DOUBLE
            - coalesce(sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS b
  FROM s1),
s3 AS (SELECT *, cap::DOUBLE * b < a * w AS capped FROM s2),
s4 AS (SELECT *, max(CASE WHEN NOT capped THEN a END) OVER () AS aa, max(CASE WHEN NOT capped THEN b END) OVER () AS bb FROM s3),
s5 AS (SELECT source, source_size, coalesce(CASE WHEN capped THEN cap::DOUBLE ELSE w * aa / bb END, 0) AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS k FROM s5),
g AS (SELECT source, h, sum(size)::BIGINT AS gs FROM d GROUP BY source, h),
c AS (SELECT *, sum(gs) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - gs AS before FROM g)
SELECT d.doc_id, d.size, s6.source_size, s6.target,
       CASE WHEN d.size = 0 THEN 0
            ELSE k + CASE WHEN target - k * source_size > 0 AND 2 * c.before + c.gs <= 2 * (target - k * source_size) THEN 1 ELSE 0 END END::BIGINT AS copies,
       copies * d.size AS taken
FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""
