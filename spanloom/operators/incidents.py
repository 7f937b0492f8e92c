"""Incidents as a table that is kept up to date.

An incident is an interval: the anchors of one code and operation that follow each other without a longer gap than
gap_ms. Intervals merge like anchors do, so a batch of anchors is first grouped by itself and its intervals are then
merged with those stored: one that touches a stored incident widens it, one that comes late between two bridges
them. What an incident keeps (the last summary, the latest cohorts, the last traces) is kept with the time that it is
of, so that the order of batches makes no difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import severity_rank
from ..schema import THRESHOLDS
from ..shared import exists, written
from ..taxonomy import MODES
from .causes import KEPT_TRACES, gap_sessions

_KEY = ("code", "operation")
#: Parts of the stored table, by a hash of code and operation.
PARTS = 32


def incident_intervals(anchors: DataFrame, gap_ms: int = THRESHOLDS["incident_window_ms"], kept: int = KEPT_TRACES) -> DataFrame:
    """code, operation, severity, count, first_seen_ms, last_seen_ms, recent, said, shown, known_ids of the incidents within anchors.

    anchors are trace_id, code, operation, severity, ts_ms and, where there are any, summary (string) and cohorts
    (array<string>; empty ones count as none).
    """
    a = anchors
    for c, kind in (("summary", "string"), ("cohorts", "array<string>")):
        a = a if c in a.columns else a.withColumn(c, F.lit(None).cast(kind))
    a = gap_sessions(a.select("trace_id", *_KEY, "severity", "ts_ms", "summary", "cohorts"), list(_KEY), "ts_ms", "trace_id", gap_ms, "_n")
    keys = [*_KEY, "_n"]
    g = a.groupBy(*keys).agg(
        F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"), F.count("*").alias("count"), F.min("ts_ms").alias("first_seen_ms"), F.max("ts_ms").alias("last_seen_ms"),
        F.max(F.when(F.col("summary").isNotNull(), F.struct("ts_ms", "trace_id", "summary"))).alias("said"), F.max(F.when(F.size("cohorts") > 0, F.struct("ts_ms", "trace_id", "cohorts"))).alias("shown"),
    )
    newest = Window.partitionBy(*keys).orderBy(F.desc("ts_ms"), F.desc("trace_id"))
    last = a.select(*keys, "ts_ms", "trace_id").withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= kept)
    last = last.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ts_ms", "trace_id"))).alias("recent"))
    return g.join(last, keys).drop("_n").withColumn("known_ids", F.array().cast("array<string>"))


def merge_intervals(intervals: DataFrame, gap_ms: int = THRESHOLDS["incident_window_ms"], kept: int = KEPT_TRACES) -> DataFrame:
    """intervals (of incident_intervals(), of several batches) with those merged whose gap is no longer than gap_ms."""
    order = Window.partitionBy(*_KEY).orderBy("first_seen_ms", "last_seen_ms")
    reach = F.max("last_seen_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("first_seen_ms") - reach > gap_ms).cast("int"), F.lit(1))
    i = intervals.withColumn("_begins", begins).withColumn("_n", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy(*_KEY, "_n").agg(
        F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"), F.sum("count").alias("count"), F.min("first_seen_ms").alias("first_seen_ms"), F.max("last_seen_ms").alias("last_seen_ms"),
        F.max("said").alias("said"), F.max("shown").alias("shown"), F.slice(F.reverse(F.sort_array(F.flatten(F.collect_list("recent")))), 1, kept).alias("recent"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("known_ids")))).alias("known_ids"),
    ).drop("_n").withColumn("recent", F.reverse("recent"))


def incident_id():
    return F.sha2(F.concat_ws("|", *_KEY, F.col("first_seen_ms").cast("string")), 256)


def incidents_of(intervals: DataFrame) -> DataFrame:
    """intervals as incidents: with id, title, status, the last summary as hypothesis, the latest cohorts, trace_ids, and earlier_ids: the ids that an incident had before a late anchor moved its start or joined it with another."""
    names = F.create_map(*[F.lit(x) for c, n, *_ in MODES for x in (c, n)])
    return intervals.select(
        incident_id().alias("incident_id"), *_KEY, "severity", "count", "first_seen_ms", "last_seen_ms", F.transform("recent", lambda x: x["trace_id"]).alias("trace_ids"), F.lit("open").alias("status"),
        F.concat_ws(" in ", F.try_element_at(names, F.col("code")), "operation").alias("title"), F.col("said.summary").alias("hypothesis"), F.coalesce("shown.cohorts", F.array().cast("array<string>")).alias("cohorts"),
        F.filter("known_ids", lambda x: x != incident_id()).alias("earlier_ids"),
    )


def incidents_to(place: str, gap_ms: int = THRESHOLDS["incident_window_ms"], kept: int = KEPT_TRACES, parts: int = PARTS):
    """A foreachBatch function on anchors that keeps the incidents at place up to date.

    Of the stored table only the parts of the batch's codes and operations are read and written anew. Rows carry the
    batch that a part was last written in, so that parts which a batch that broke off has merged aren't merged again.
    """

    def update(anchors: DataFrame, epoch: int) -> None:
        spark = anchors.sparkSession
        part = F.pmod(F.xxhash64(*_KEY), F.lit(parts)).cast("int")
        new = written(incident_intervals(anchors, gap_ms, kept).withColumn("part", part), "incident-intervals")
        # at most `parts` numbers
        touched = [r["part"] for r in new.select("part").distinct().collect()]
        if exists(spark, place):
            old = spark.read.schema(new.schema.add("epoch", "long")).parquet(place).where(F.col("part").isin(touched))
            merged = {r["part"] for r in old.where(F.col("epoch") >= epoch).select("part").distinct().collect()}
            touched = [p for p in touched if p not in merged]
            old = old.where(F.col("part").isin(touched)).withColumn("known_ids", F.array_append("known_ids", incident_id())).drop("epoch")
            new = new.where(F.col("part").isin(touched)).unionByName(old)
        if touched:
            whole = written(merge_intervals(new, gap_ms, kept).withColumn("part", part).withColumn("epoch", F.lit(epoch).cast("long")), "incident-parts")
            whole.repartition("part").write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(place)

    return update


def read_incidents(spark: SparkSession, place: str) -> DataFrame:
    return incidents_of(spark.read.parquet(place))
