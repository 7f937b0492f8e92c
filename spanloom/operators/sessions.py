"""Sessions: turns, adjacent pairs, what gets lost between them, lists and details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import severity_rank, stable_hash
from ..schema import THRESHOLDS
from .detectors import Detector, evidence, finished, tagged
from .traces import money, span_cost


def session_turns(spans: DataFrame) -> DataFrame:
    """One row a trace of a session: its llm payload with the most messages (the first on ties), their number and fingerprints (role and hash), tokens, cost, status."""
    own = F.coalesce("llm.input_message_count", F.size("llm.input_messages").cast("long"))
    n = F.when(F.col("llm").isNotNull(), F.coalesce(F.when(own >= 0, own), F.lit(0).cast("long")))
    prints = F.transform("llm.input_messages", lambda m: F.concat_ws(":", m["role"], stable_hash(F.coalesce(m["content"], F.lit("")))))
    first = F.struct(n, -F.col("start_ms"), F.col("span_id"))
    t = spans.groupBy("trace_id").agg(
        F.min("session_id").alias("session_id"), F.min("start_ms").alias("start_ms"), F.max_by(F.struct(n.alias("n"), prints.alias("p"), F.col("span_id").alias("span_id")), first).alias("m"),
        F.coalesce(F.sum(F.coalesce("llm.input_tokens", F.lit(0)) + F.coalesce("llm.output_tokens", F.lit(0))), F.lit(0)).alias("tokens"),
        money(F.when(F.col("llm").isNotNull(), span_cost())).alias("cost_usd"), F.when(F.bool_or(F.col("status") == "error"), "error").otherwise("ok").alias("status"),
    )
    return t.where("session_id is not null").select("trace_id", "session_id", "start_ms", F.col("m.n").alias("message_count"), F.col("m.p").alias("fingerprints"), F.col("m.span_id").alias("span_id"), "tokens", "cost_usd", "status")


def session_pairs(turns: DataFrame) -> DataFrame:
    """turns with turn_index (1 and the number of strictly earlier turns) and the previous turn: the latest that starts strictly before, of equal starts the one with the largest trace_id."""
    same = Window.partitionBy("session_id", "start_ms")
    rows = turns.withColumn("_last", F.max(F.struct("trace_id", "message_count", *(["fingerprints"] if "fingerprints" in turns.columns else []))).over(same))
    earlier = Window.partitionBy("session_id").orderBy("start_ms").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_prev", F.last("_last").over(earlier)).withColumn("turn_index", F.count("*").over(earlier) + 1)
    out = rows.withColumn("previous_trace_id", F.col("_prev.trace_id")).withColumn("previous_count", F.col("_prev.message_count"))
    if "fingerprints" in turns.columns:
        out = out.withColumn("previous_fingerprints", F.col("_prev.fingerprints"))
    return out.drop("_last", "_prev")


def session_findings(pairs: DataFrame, th: dict | None = None) -> DataFrame:
    """History lost and conversations restarted between adjacent turns."""
    th = th or THRESHOLDS
    prints = "fingerprints" in pairs.columns
    p = pairs.where("previous_trace_id is not null")
    have = (F.coalesce(F.size("fingerprints"), F.lit(0)) > 0) & (F.coalesce(F.size("previous_fingerprints"), F.lit(0)) > 0) if prints else F.lit(False)
    fell = F.col("previous_count") - F.col("message_count")
    gone = F.when(have, F.size(F.filter("previous_fingerprints", lambda x: ~F.array_contains(F.col("fingerprints"), x)))) if prints else F.lit(None).cast("int")
    carried = F.when(have, F.arrays_overlap("previous_fingerprints", "fingerprints")) if prints else F.lit(None).cast("boolean")
    span = F.col("span_id") if "span_id" in pairs.columns else F.lit(None).cast("string")
    base = lambda df, code, c, *e: df.select("trace_id", span.alias("span_id"), F.lit("").alias("k"), F.lit(code).alias("code"), F.lit(None).cast("string").alias("severity"), c.alias("confidence"), evidence(*e).alias("evidence"))
    lost = p.where((fell >= th["history_loss_messages"]) & (gone.isNull() | (gone >= th["history_loss_messages"])))
    sure = F.when(gone.isNotNull(), F.least(F.lit(0.78), 0.45 + 0.05 * gone)).otherwise(F.least(F.lit(0.6), 0.35 + 0.03 * fell))
    a = tagged(base(lost, "CTX-003", sure, ("previous", F.col("previous_count")), ("current", F.col("message_count"))), Detector("session.history-loss", "L1", ("CTX-003",), None), 200)
    again = p.where((F.col("previous_count") >= th["reset_min_prior_messages"]) & (F.col("message_count") <= 1) & ~F.coalesce(carried, F.lit(False)))
    b = tagged(base(again, "CTX-004", F.lit(0.75), ("previous", F.col("previous_count")), ("current", F.col("message_count"))), Detector("session.reset", "L1", ("CTX-004",), None), 201)
    return finished(a.unionByName(b))


def list_sessions(traces: DataFrame, findings: DataFrame, least_traces: int = 1, from_ms: int | None = None, to_ms: int | None = None, limit: int = 50) -> DataFrame:
    """One row a session, the last seen first: service, environment, traces, first and last seen, cost, tokens, findings, errors, worst severity."""
    t = traces.where("session_id is not null")
    t = t if from_ms is None else t.where(F.col("start_ms") >= from_ms)
    t = t if to_ms is None else t.where(F.col("start_ms") <= to_ms)
    per = findings.groupBy("trace_id").agg(F.count("*").alias("n"), F.max(severity_rank(F.col("severity"))).alias("rank"), F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"))
    s = t.join(per, "trace_id", "left").groupBy("session_id").agg(
        F.min("service").alias("service"), F.min("environment").alias("environment"), F.count("*").alias("traces"), F.min("start_ms").alias("first_seen_ms"), F.max("end_ms").alias("last_seen_ms"),
        money(F.col("cost_usd")).alias("cost_usd"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), F.count_if(F.col("status") == "error").alias("errors"), F.max_by("severity", "rank").alias("worst_severity"),
    )
    return s.where(F.col("traces") >= least_traces).orderBy(F.desc("last_seen_ms"), "session_id").limit(min(limit, 500))


def session_detail(traces: DataFrame, findings: DataFrame, session_id: str, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """The session's turns, oldest first, and all findings of those."""
    t = traces.where(F.col("session_id") == session_id).orderBy("start_ms", "trace_id").limit(limit)
    return t, findings.join(t.select("trace_id"), "trace_id", "left_semi")
