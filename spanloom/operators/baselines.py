"""Rolling baselines by metric and scope, as of each trace, and the detectors that compare with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import EPSILON, RECENT, finite, merged_moments, zscore
from ..functions.text import bucket_start, let
from ..schema import THRESHOLDS
from .detectors import Detector, evidence, finished, tagged
from .traces import money, span_cost

#: Metrics whose drift is watched.
DRIFT_METRICS = ("trace.duration_ms", "trace.cost_usd", "trace.output_tokens", "trace.span_count")
#: Bins of the stability index, and samples that each side needs.
BINS, LEAST_SIDE = 10, 15


def baseline_samples(spans: DataFrame) -> DataFrame:
    """metric, scope, trace_id, trace_start_ms, span_id, value: what the baselines are made of; one scan of the spans for the spans' metrics, one grouping for the traces'."""
    starts = Window.partitionBy("trace_id")
    s = spans.withColumn("trace_start_ms", F.min("start_ms").over(starts))
    top1 = F.array_max(F.transform("retrieval.documents", lambda d: d["score"]))
    sample = lambda metric, scope, value: F.struct(F.lit(metric).alias("metric"), F.coalesce(scope, F.lit("unknown")).alias("scope"), value.cast("double").alias("value"))
    llm, ret, tool = F.col("kind") == "llm", F.col("kind") == "retriever", F.col("kind") == "tool"
    index = F.coalesce("retrieval.index_name", F.lit("default"))
    each = F.array(
        F.when(llm, sample("llm.duration_ms", F.col("llm.request_model"), F.col("duration_ms"))),
        F.when(llm, sample("llm.output_tokens", F.col("llm.request_model"), F.col("llm.output_tokens"))),
        F.when(ret, sample("retrieval.duration_ms", index, F.col("duration_ms"))),
        F.when(ret, sample("retrieval.top1_score", index, top1)),
        F.when(ret & (index != "default"), sample("retrieval.top1_score", F.lit("default"), top1)),
        F.when(tool, sample("tool.duration_ms", F.coalesce("tool.tool_name", "name"), F.col("duration_ms"))),
    )
    by_span = s.select("trace_id", "trace_start_ms", "span_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x"))
    t = spans.groupBy("trace_id").agg(
        F.min("start_ms").alias("trace_start_ms"), (F.max("end_ms") - F.min("start_ms")).alias("d"), money(F.when(F.col("llm").isNotNull(), span_cost())).alias("c"),
        F.coalesce(F.sum("llm.output_tokens"), F.lit(0)).alias("o"), F.count("*").alias("n"),
    )
    whole = F.array(*[sample(m, F.lit("global"), F.col(c)) for m, c in zip(("trace.duration_ms", "trace.cost_usd", "trace.output_tokens", "trace.span_count"), "dcon", strict=True)])
    by_trace = t.select("trace_id", "trace_start_ms", F.lit(None).cast("string").alias("span_id"), F.explode(whole).alias("x"))
    return by_span.unionByName(by_trace).select("x.metric", "x.scope", "trace_id", "trace_start_ms", "span_id", finite(F.col("x.value")).alias("value")).where("value is not null")


def _per_trace(samples: DataFrame) -> DataFrame:
    return samples.groupBy("metric", "scope", "trace_id", "trace_start_ms").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.min("value").alias("low"), F.max("value").alias("high"))


def _moments(df: DataFrame) -> DataFrame:
    n, s, q = F.coalesce("n", F.lit(0)), F.coalesce("s", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    variance = F.when(n > 1, F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1))).otherwise(F.lit(0.0))
    return df.select("metric", "scope", "trace_id", "trace_start_ms", n.alias("count"), F.when(n > 0, s / n).alias("mean"), F.sqrt(variance).alias("sd"), "low", "high")


def asof_baselines(samples: DataFrame, bucket_ms: int | None = 3_600_000) -> DataFrame:
    """metric, scope, trace_id, trace_start_ms, count, mean, sd, low, high over the strictly earlier traces (by start, then id) of the series.

    With a bucket, prefix sums are taken in two levels: over the buckets' totals, and within each bucket, so that a
    series of all traces is no single task; without, by one window over each series.
    """
    t = _per_trace(samples)
    order = ["trace_start_ms", "trace_id"]
    if bucket_ms is None:
        before = Window.partitionBy("metric", "scope").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return _moments(t.select("metric", "scope", "trace_id", "trace_start_ms", *[f(c).over(before).alias(c) for f, c in ((F.sum, "n"), (F.sum, "s"), (F.sum, "q"), (F.min, "low"), (F.max, "high"))]))
    t = t.withColumn("bucket", bucket_start(F.col("trace_start_ms"), bucket_ms))
    totals = t.groupBy("metric", "scope", "bucket").agg(F.sum("n").alias("bn"), F.sum("s").alias("bs"), F.sum("q").alias("bq"), F.min("low").alias("bl"), F.max("high").alias("bh"))
    earlier = Window.partitionBy("metric", "scope").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("metric", "scope", "bucket", *[f(c).over(earlier).alias(c) for f, c in ((F.sum, "bn"), (F.sum, "bs"), (F.sum, "bq"), (F.min, "bl"), (F.max, "bh"))])
    inside = Window.partitionBy("metric", "scope", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = t.select("metric", "scope", "bucket", "trace_id", "trace_start_ms", *[f(c).over(inside).alias(c) for f, c in ((F.sum, "n"), (F.sum, "s"), (F.sum, "q"), (F.min, "low"), (F.max, "high"))])
    both = own.join(carried, ["metric", "scope", "bucket"])
    add = lambda a, b: F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))
    return _moments(both.select("metric", "scope", "trace_id", "trace_start_ms", add("n", "bn").alias("n"), add("s", "bs").alias("s"), add("q", "bq").alias("q"), F.least("low", "bl").alias("low"), F.greatest("high", "bh").alias("high")))


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: str, name: str) -> DataFrame:
    """df with name: each row's number (from 0) in its series (keys) by order. Rows are numbered within buckets, a column that the order begins with, and the buckets' totals are added up, so that no series is one task."""
    totals = df.groupBy(*keys, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(inside)).join(carried, [*keys, bucket]).withColumn(name, F.col("_before") + F.col("_nth") - 1).drop("_nth", "_before")


def recent_samples(samples: DataFrame, size: int = RECENT, bucket_ms: int = 3_600_000, block: int = 4096) -> DataFrame:
    """metric, scope, trace_id, trace_start_ms, recent: the last `size` values of strictly earlier traces; for series with one value a trace.

    The series are cut into blocks of so many rows, and the last rows of each block also go to the next one, so that
    a window over a block sees all that it needs.
    """
    keys, block = ["metric", "scope"], max(block, size)
    s = samples.select(*keys, "trace_id", "trace_start_ms", "value", bucket_start(F.col("trace_start_ms"), bucket_ms).alias("_bucket"))
    s = numbered(s, keys, ["trace_start_ms", "trace_id"], "_bucket", "_at").drop("_bucket")
    home = F.floor(F.col("_at") / block)
    last = F.col("_at") % block >= block - size
    s = s.select("*", F.explode(F.when(last, F.array(home, home + 1)).otherwise(F.array(home))).alias("_block"))
    w = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(-size, -1)
    return s.withColumn("recent", F.collect_list("value").over(w)).where(home == F.col("_block")).select(*keys, "trace_id", "trace_start_ms", "recent")


def baselines(samples: DataFrame) -> DataFrame:
    """metric, scope, count, mean, m2, min, max, samples (the last 200): the state after all samples."""
    order = Window.partitionBy("metric", "scope").orderBy(F.desc("trace_start_ms"), F.desc("trace_id"), F.desc("span_id"))
    last = samples.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= RECENT).groupBy("metric", "scope").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "value")), asc=False), lambda x: x["value"]).alias("samples"))
    g = samples.groupBy("metric", "scope").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), (F.coalesce(F.var_pop("value"), F.lit(0.0)) * F.count("value")).alias("m2"), F.min("value").alias("min"), F.max("value").alias("max"))
    return g.join(last, ["metric", "scope"])


def merge_baselines(old: DataFrame, new: DataFrame) -> DataFrame:
    """The state of both: moments combined, the samples of the new one after those of the old one."""
    o, n = old.select("metric", "scope", *[F.col(c).alias(f"o_{c}") for c in ("count", "mean", "m2", "min", "max", "samples")]), new
    b = n.join(o, ["metric", "scope"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    none = F.array().cast("array<double>")
    count, mean, m2 = merged_moments(zero("o_count"), zero("o_mean"), zero("o_m2"), zero("count"), zero("mean"), zero("m2"))
    joined = F.concat(F.coalesce("o_samples", none), F.coalesce("samples", none))
    return b.select("metric", "scope", count.alias("count"), mean.alias("mean"), m2.alias("m2"), F.least("o_min", "min").alias("min"), F.greatest("o_max", "max").alias("max"), F.slice(joined, F.greatest(F.lit(1), F.size(joined) - RECENT + 1), F.lit(RECENT)).alias("samples"))


def list_baselines(state: DataFrame, metric: str | None = None, scope: str | None = None) -> DataFrame:
    out = state if metric is None else state.where(F.col("metric") == metric)
    return out if scope is None else out.where(F.col("scope") == scope)


# --- detectors


def outliers(samples: DataFrame, asof: DataFrame, metric: str, th: dict) -> DataFrame:
    """Samples of a metric with z against the baseline as of their trace, which has enough samples."""
    s = samples.where(F.col("metric") == metric)
    if metric == "retrieval.top1_score":
        s = s.where("scope <> 'default'")
    a = asof.where((F.col("metric") == metric) & (F.col("count") >= th["min_baseline_samples"])).select("scope", "trace_id", "count", "mean", "sd")
    return s.join(a, ["scope", "trace_id"]).withColumn("z", zscore(F.col("value"), F.col("mean"), F.col("sd")))


def outlier_findings(samples: DataFrame, asof: DataFrame, metric: str, code: str, th: dict) -> DataFrame:
    o = outliers(samples, asof, metric, th)
    if metric == "retrieval.top1_score":
        o, c = o.where(F.col("z") <= -th["retrieval_score_z"]), F.least(F.lit(0.95), 0.6 + 0.05 * F.abs("z"))
    else:
        o, c = o.where(F.col("z") >= th["z_score"]), F.least(F.lit(0.9), 0.5 + 0.05 * F.col("z"))
    return o.select("trace_id", "span_id", F.lit("").alias("k"), F.lit(code).alias("code"), F.lit(None).cast("string").alias("severity"), c.alias("confidence"), evidence(("value", F.round("value", 6)), ("mean", F.round("mean", 6)), ("z", F.round("z", 4)), ("samples", F.col("count"))).alias("evidence"))


def cost_spikes(spans: DataFrame, samples: DataFrame, asof: DataFrame, th: dict) -> DataFrame:
    top = spans.where("llm is not null").groupBy("trace_id").agg(F.max_by("span_id", F.struct(F.coalesce("llm.input_tokens", F.lit(0)) + F.coalesce("llm.output_tokens", F.lit(0)), "span_id")).alias("top"))
    f = outlier_findings(samples.where("metric <> 'trace.cost_usd' or value > 0"), asof, "trace.cost_usd", "ECO-002", th)
    return f.join(top, "trace_id", "left").withColumn("span_id", F.col("top")).drop("top")


def stability(recent, bins: int = BINS):
    """The stability index of an array of samples: its newest quarter against its oldest half, in bins over the range of both; null where either is too small."""
    n = F.size(recent)
    half, quarter = F.floor(n / 2).cast("int"), F.floor(n / 4).cast("int")

    def ranged(v):
        both = F.concat(v["old"], v["new"])
        return let(F.struct(v["old"].alias("old"), v["new"].alias("new"), F.array_min(both).alias("low"), F.array_max(both).alias("high")), binned)

    def binned(v):
        at = lambda x: F.when(v["high"] > v["low"], F.least(F.lit(bins - 1), F.floor((x - v["low"]) / ((v["high"] - v["low"]) / bins)))).otherwise(F.lit(0)).cast("int")
        return let(F.struct(F.transform(v["old"], at).alias("old"), F.transform(v["new"], at).alias("new")), index)

    def index(v):
        share = lambda side, i: F.greatest(F.lit(EPSILON), F.size(F.filter(v[side], lambda x: x == i)) / F.size(v[side]))
        each = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.struct(share("new", i).alias("q"), share("old", i).alias("p")))
        return F.abs(F.aggregate(each, F.lit(0.0), lambda a, s: a + (s["q"] - s["p"]) * F.log(s["q"] / s["p"])))

    halves = F.struct(F.slice(recent, F.lit(1), half).alias("old"), F.slice(recent, n - quarter + 1, quarter).alias("new"))
    return F.when((half >= LEAST_SIDE) & (quarter >= LEAST_SIDE), let(halves, ranged))


def feature_drift(samples: DataFrame, th: dict) -> DataFrame:
    """At most one finding a metric and bucket of event time: the first trace whose recent samples drift."""
    # with fewer there is no index, and none is worked out
    r = recent_samples(samples.where(F.col("metric").isin(*DRIFT_METRICS))).where(F.size("recent") >= 4 * LEAST_SIDE).withColumn("psi", stability(F.col("recent"))).where(F.col("psi") > th["psi_significant"])
    r = r.withColumn("bucket", bucket_start(F.col("trace_start_ms"), th["drift_bucket_ms"]))
    first = Window.partitionBy("metric", "bucket").orderBy("trace_start_ms", "trace_id")
    r = r.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return r.select("trace_id", F.lit(None).cast("string").alias("span_id"), F.col("metric").alias("k"), F.lit("ECO-003").alias("code"), F.lit("medium").alias("severity"), F.lit(0.8).alias("confidence"), evidence(("metric", F.col("metric")), ("psi", F.round("psi", 4))).alias("evidence"))


BASELINE_DETECTORS = (
    (Detector("inf.latency", "L2", ("INF-005",), None, needs_baseline=True), "llm.duration_ms"),
    (Detector("ret.quality", "L2", ("RET-002",), None, needs_baseline=True), "retrieval.top1_score"),
    (Detector("ret.latency", "L2", ("RET-004",), None, needs_baseline=True), "retrieval.duration_ms"),
    (Detector("tol.latency", "L2", ("TOL-006",), None, needs_baseline=True), "tool.duration_ms"),
    (Detector("eco.cost-spike", "L2", ("ECO-002",), None, needs_baseline=True), "trace.cost_usd"),
    (Detector("eco.drift", "L2", ("ECO-003",), None, needs_baseline=True), None),
)
#: Ordinals of these come after those of the detectors on one trace.
FIRST_ORDINAL = 100


def detect_baseline(spans: DataFrame, th: dict | None = None, disabled=(), bucket_ms: int | None = 3_600_000) -> DataFrame:
    th = th or THRESHOLDS
    samples = baseline_samples(spans)
    asof = asof_baselines(samples, bucket_ms)
    out = None
    for n, (d, metric) in enumerate(BASELINE_DETECTORS):
        if d.id in disabled:
            continue
        if metric is None:
            f = feature_drift(samples, th)
        elif metric == "trace.cost_usd":
            f = cost_spikes(spans, samples, asof, th)
        else:
            f = outlier_findings(samples, asof, metric, d.emits[0], th)
        f = tagged(f, d, FIRST_ORDINAL + n)
        out = f if out is None else out.unionByName(f)
    return finished(out)
