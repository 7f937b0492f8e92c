"""Read queries over traces, findings and incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import severities_from, severity_rank
from ..schema import SEVERITIES_ORDER
from ..taxonomy import taxonomy
from .causes import in_range
from .percentiles import percentiles
from .traces import money

DEFAULT_LIMIT, MOST_LIMIT, MOST_BUCKETS = 50, 500, 500
DAY_MS = 86_400_000


def checked_range(from_ms: int | None, to_ms: int | None, as_of_ms: int) -> tuple[int, int]:
    """The range asked for; by default the day before as_of_ms. ValueError if it ends before it begins."""
    to_ms = as_of_ms if to_ms is None else to_ms
    from_ms = to_ms - DAY_MS if from_ms is None else from_ms
    if from_ms > to_ms:
        raise ValueError("the range ends before it begins")
    return from_ms, to_ms


def page(df: DataFrame, ts: str, key: str, limit: int = DEFAULT_LIMIT, after: tuple | None = None) -> DataFrame:
    """The newest rows by (ts, key), from behind the cursor `after` on; one row more than the limit tells that there are more."""
    if after is not None:
        df = df.where((F.col(ts) < after[0]) | ((F.col(ts) == after[0]) & (F.col(key) < after[1])))
    return df.orderBy(F.desc(ts), F.desc(key)).limit(min(limit, MOST_LIMIT))


def chosen_traces(traces: DataFrame, findings: DataFrame, *, from_ms=None, to_ms=None, service=None, environment=None, session=None, status=None, has_findings=None, least_severity=None, code=None) -> DataFrame:
    t = in_range(traces, from_ms, to_ms)
    for column, value in (("service", service), ("environment", environment), ("session_id", session), ("status", status)):
        t = t if value is None else t.where(F.col(column) == value)
    if has_findings is not None:
        t = t.join(findings.select("trace_id").distinct(), "trace_id", "left_semi" if has_findings else "left_anti")
    if least_severity is not None:
        t = t.join(findings.where(F.col("severity").isin(severities_from(least_severity))).select("trace_id"), "trace_id", "left_semi")
    if code is not None:
        t = t.join(findings.where(F.col("code") == code).select("trace_id"), "trace_id", "left_semi")
    return t


def list_traces(traces: DataFrame, findings: DataFrame, *, limit=DEFAULT_LIMIT, after=None, **chosen) -> DataFrame:
    """A page of the traces that chosen_traces() gives for the other arguments."""
    return page(chosen_traces(traces, findings, **chosen), "start_ms", "trace_id", limit, after)


def count_traces(traces: DataFrame, findings: DataFrame, **chosen) -> DataFrame:
    """One row, total: how many traces all pages of list_traces() have."""
    return chosen_traces(traces, findings, **chosen).agg(F.count("*").alias("total"))


def list_findings(findings: DataFrame, *, from_ms=None, to_ms=None, code=None, family=None, severity=None, tier=None, role=None, trace=None, limit=DEFAULT_LIMIT, after=None) -> DataFrame:
    f = in_range(findings, from_ms, to_ms, "created_ms")
    for column, value in (("code", code), ("family", family), ("severity", severity), ("tier", tier), ("role", role), ("trace_id", trace)):
        f = f if value is None else f.where(F.col(column) == value)
    return page(f, "created_ms", "finding_id", limit, after)


def list_incidents(incidents: DataFrame, *, status=None, code=None, least_severity=None, limit=DEFAULT_LIMIT, after=None) -> DataFrame:
    i = incidents if status is None else incidents.where(F.col("status") == status)
    i = i if code is None else i.where(F.col("code") == code)
    i = i if least_severity is None else i.where(F.col("severity").isin(severities_from(least_severity)))
    return page(i, "last_seen_ms", "incident_id", limit, after)


def incident_detail(incidents: DataFrame, findings: DataFrame, incident_id: str, traces_kept: int = 50, limit: int = 200) -> DataFrame:
    """The newest findings of the incident's code in its last traces, with the mode's card."""
    i = incidents.where(F.col("incident_id") == incident_id).select("incident_id", "code", F.explode(F.slice("trace_ids", F.greatest(F.lit(1), F.size("trace_ids") - traces_kept + 1), F.lit(traces_kept))).alias("trace_id"))
    f = findings.join(F.broadcast(i), ["trace_id", "code"])
    cards = F.broadcast(taxonomy(findings.sparkSession).select("code", F.col("name").alias("mode_name"), F.col("severity").alias("mode_severity")))
    return f.orderBy(F.desc("created_ms"), "finding_id").limit(limit).join(cards, "code", "left")


def trace_detail(traces: DataFrame, spans: DataFrame, findings: DataFrame, trace_id: str) -> DataFrame:
    """One row: the trace, its spans by start, its findings (origin, symptoms, others; then by confidence)."""
    own = lambda df: df.where(F.col("trace_id") == trace_id)
    rank = F.when(F.col("role") == "origin", 0).when(F.col("role") == "symptom", 1).otherwise(2)
    s = own(spans).groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("start_ms", "span_id", "name", "kind", "status"))).alias("spans"))
    f = own(findings).groupBy("trace_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(rank.alias("r"), (-F.col("confidence")).alias("c"), "finding_id", "code", "severity", "role", "confidence"))), lambda x: x.dropFields("r", "c")).alias("findings"))
    return own(traces).join(s, "trace_id", "left").join(f, "trace_id", "left")


def overview(traces: DataFrame, findings: DataFrame, incidents: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """One row of totals in the range; findings by severity are zero-filled. Tokens are summed where traces have input_tokens and output_tokens."""
    t = in_range(traces, from_ms, to_ms)
    tokens = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens") if c in t.columns]
    p = percentiles(t, [], "duration_ms", [50, 95]).agg(*[F.coalesce(F.max(f"p{x}"), F.lit(0)).alias(f"p{x}_ms") for x in (50, 95)])
    a = t.agg(
        F.count("*").alias("traces"), F.count_if(F.col("status") == "error").alias("errors"), money(F.col("cost_usd")).alias("cost_usd"), *tokens,
    )
    f = findings.join(t.select("trace_id"), "trace_id", "left_semi").agg(*[F.count_if(F.col("severity") == s).alias(f"{s}_findings") for s in SEVERITIES_ORDER])
    i = in_range(incidents, from_ms, to_ms, "last_seen_ms").agg(F.count("*").alias("incidents"), F.count_if(F.col("status") == "open").alias("open_incidents"))
    return a.crossJoin(p).crossJoin(f).crossJoin(i).withColumn("failure_rate", F.when(F.col("traces") > 0, F.col("errors") / F.col("traces")).otherwise(F.lit(0.0)))


def timeseries(traces: DataFrame, findings: DataFrame, from_ms: int, to_ms: int, bucket_ms: int) -> DataFrame:
    """bucket_ms and traces, errors, findings, cost, p95 in it, zero-filled; buckets are widened until there are at most 500 and the first."""
    bucket = max(bucket_ms, -(-(to_ms - from_ms) // MOST_BUCKETS), 1)
    at = (F.col("start_ms") - F.pmod(F.col("start_ms"), F.lit(bucket))).alias("bucket_ms")
    t = in_range(traces, from_ms, to_ms)
    per = findings.groupBy("trace_id").agg(F.count("*").alias("n"))
    g = t.join(per, "trace_id", "left").groupBy(at).agg(F.count("*").alias("traces"), F.count_if(F.col("status") == "error").alias("errors"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), money(F.col("cost_usd")).alias("cost_usd"))
    p95 = percentiles(t.select(at, "duration_ms"), ["bucket_ms"], "duration_ms", [95]).withColumnRenamed("p95", "p95_ms")
    first = from_ms - from_ms % bucket
    slots = traces.sparkSession.range(first, to_ms + 1, bucket).select(F.col("id").alias("bucket_ms"))  # at most 501 rows
    return slots.join(g, "bucket_ms", "left").join(p95, "bucket_ms", "left").select("bucket_ms", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("traces", "errors", "findings", "cost_usd", "p95_ms")])


def code_frequency(findings: DataFrame, top: int = 20, traces: DataFrame | None = None, from_ms=None, to_ms=None) -> DataFrame:
    """code, severity, count, name, family, the most frequent first."""
    f = findings if traces is None else findings.join(in_range(traces, from_ms, to_ms).select("trace_id"), "trace_id", "left_semi")
    g = f.groupBy("code", "severity").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "code", "severity").limit(top)
    return g.join(F.broadcast(taxonomy(findings.sparkSession).select("code", "name", "family")), "code", "left").select("code", "severity", "count", "name", "family")


def cost_by_cohort(traces: DataFrame, key: str, top: int = 10, from_ms=None, to_ms=None) -> DataFrame:
    """value, traces, cost_usd, share: the costliest values of a column or attribute; the share is of what is returned."""
    value = F.col(key) if key in traces.columns else F.try_element_at("attributes", F.lit(key))
    g = in_range(traces, from_ms, to_ms).groupBy(value.cast("string").alias("value")).agg(F.count("*").alias("traces"), money(F.col("cost_usd")).alias("cost_usd"))
    g = g.orderBy(F.desc("cost_usd"), F.col("value").asc_nulls_last()).limit(top).where("value is not null")
    total = g.agg(money(F.col("cost_usd")).alias("total"))
    return g.crossJoin(F.broadcast(total)).select("value", "traces", "cost_usd", F.when(F.col("total") > 0, F.col("cost_usd") / F.col("total")).otherwise(F.lit(0.0)).alias("share"))


def worst_first(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc(severity_rank(F.col("severity"))), F.desc("confidence"), "finding_id")
