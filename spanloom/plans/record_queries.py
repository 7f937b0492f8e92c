"""Queries of sources, bundles, bookkeeping and small functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import causes, detectors, judge, serving, traces
from ..operators.baselines import BASELINE_DETECTORS
from ..shared import new_path
from ..sources import spans as src
from . import views
from .queries import ALL, CODE_OF, CUT, DAY, DETECTED, FOUND, INCIDENTS, TRACES, _SET, anchors, both, events, finding_set, on_spans, query, shown, sql_found

# --- sources

PLACED = "trace_id::BIGINT % 50"


@query("src1_read_spans", on_spans(f"SELECT CASE {PLACED} WHEN 0 THEN 'not readable' WHEN 1 THEN 'kind: unknown' WHEN 2 THEN 'name: must have 0 to 256 characters' ELSE 'ok' END AS reason, count(*) AS n FROM spans GROUP BY 1"))
def read_spans(spark, d):
    n = F.col("trace_id").cast("long") % 50
    s = views.spans(spark, d).withColumns({"kind": F.when(n == 1, "odd").otherwise(F.col("kind")), "name": F.when(n == 2, F.repeat(F.col("name"), 60)).otherwise(F.col("name"))})
    line = F.to_json(F.struct(*s.columns))
    place = new_path(spark, "span-lines")
    s.select(F.when(n == 0, F.substring(line, F.lit(1), F.length(line) - 9)).otherwise(line).alias("value")).write.text(place)
    good, bad = src.validate_spans(src.read_spans(spark, place))
    return good.select(F.lit("ok").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


TOLD = "list_filter(m, lambda x: x.c <> '')"
GIVEN = f"CASE mode WHEN 3 THEN [] WHEN 2 THEN list_filter({TOLD}, lambda x: x.r = 'user') ELSE {TOLD} END"


@query("src4_otel_messages", f"""WITH {views.DUCK_HISTORY}, h AS (SELECT trace_id, session_id::BIGINT % 4 AS mode, list({{'r': role, 'c': content}} ORDER BY nr) AS m FROM history GROUP BY ALL)
SELECT trace_id, len({GIVEN})::INTEGER AS n_in, CASE WHEN mode = 2 THEN len(list_filter({TOLD}, lambda x: x.r = 'assistant')) ELSE 0 END::INTEGER AS n_out, md5(array_to_string(list_transform({GIVEN}, lambda x: x.r || ':' || x.c), '|')) AS given FROM h""")
def otel_messages(spark, d):
    mode = F.col("session_id").cast("long") % 4
    h = views.history(spark, d).groupBy("trace_id", "session_id").agg(F.sort_array(F.collect_list(F.struct("nr", "role", "content"))).alias("m"))
    plain = F.to_json(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))
    parts = F.to_json(F.transform("m", lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(x["content"].alias("content"))).alias("parts"))))
    given = F.when(mode == 0, plain).when(mode == 1, parts).when(mode == 3, F.lit('[{"role": '))
    event = lambda x: F.struct(F.when(x["role"] == "assistant", "gen_ai.assistant.message").otherwise("gen_ai.user.message").alias("name"), F.lit(0).cast("long").alias("timestamp_ms"), F.create_map(F.lit("content"), x["content"]).alias("attributes"))
    h = h.withColumn("attributes", F.map_filter(F.create_map(F.lit("gen_ai.input.messages"), given), lambda _k, v: v.isNotNull())).withColumn("events", F.when(mode == 2, F.transform("m", event)))
    i, o = src.otel_messages(F.col("attributes"), F.col("events"))
    return h.select("trace_id", i.alias("i"), o.alias("o")).select("trace_id", F.size("i").alias("n_in"), F.size("o").alias("n_out"), F.md5(F.array_join(F.transform("i", lambda x: F.concat_ws(":", x["role"], x["content"])), "|")).alias("given"))


@query("src6_normalise_responses", """SELECT concat(conv_id, '-', turn) AS trace_id, CASE WHEN conv_id % 2 = 0 THEN 'anthropic' ELSE 'openai' END AS provider, length(text)::BIGINT AS input_tokens, turn::BIGINT AS output_tokens, 3::BIGINT AS cache_read_tokens,
 CASE WHEN conv_id % 2 = 0 THEN 'end_turn' ELSE 'stop' END AS finish_reason, md5(text) AS said, CASE WHEN conv_id % 2 = 0 THEN 'hm' || chr(10) || 'so' END AS thought, CASE WHEN conv_id % 2 = 1 THEN 7::BIGINT END AS reasoning_tokens, 'f:{"a":1}' AS calls
 FROM conversations WHERE role = 'assistant' AND text IS NOT NULL""")
def responses(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").where("role = 'assistant' and text is not null").select(F.concat_ws("-", "conv_id", "turn").alias("trace_id"), (F.col("conv_id") % 2 == 0).alias("even"), "turn", "text")
    n = F.length("text").cast("long")
    block = lambda kind, **more: F.struct(F.lit(kind).alias("type"), *[more.get(k, F.lit(None).cast("string")).alias(k) for k in ("text", "thinking", "id", "name")], more.get("input", F.lit(None).cast("struct<a:int>")).alias("input"))
    blocks = F.array(block("thinking", thinking=F.lit("hm")), block("text", text=F.col("text")), block("thinking", thinking=F.lit("so")), block("tool_use", id=F.lit("c"), name=F.lit("f"), input=F.struct(F.lit(1).alias("a"))))
    one = F.to_json(F.struct(F.lit("m").alias("model"), F.lit("end_turn").alias("stop_reason"), F.struct(n.alias("input_tokens"), F.col("turn").alias("output_tokens"), F.lit(3).alias("cache_read_input_tokens")).alias("usage"), blocks.alias("content")))
    call = F.struct(F.lit("c").alias("id"), F.struct(F.lit("f").alias("name"), F.lit('{"a":1}').alias("arguments")).alias("function"))
    usage = F.struct(n.alias("prompt_tokens"), F.col("turn").alias("completion_tokens"), F.struct(F.lit(3).alias("cached_tokens")).alias("prompt_tokens_details"), F.struct(F.lit(7).alias("reasoning_tokens")).alias("completion_tokens_details"))
    two = F.to_json(F.struct(F.lit("m").alias("model"), usage.alias("usage"), F.array(F.struct(F.lit("stop").alias("finish_reason"), F.struct(F.col("text").alias("content"), F.array(call).alias("tool_calls")).alias("message"))).alias("choices")))
    made = src.normalise_responses(c.where("even").withColumn("response", one), "anthropic").unionByName(src.normalise_responses(c.where("not even").withColumn("response", two), "openai"))
    said = F.get(F.col("llm.output_messages"), F.lit(0))
    calls = F.array_join(F.transform(said["tool_calls"], lambda t: F.concat_ws(":", t["name"], t["arguments"])), ",")
    return made.select("trace_id", "llm.provider", "llm.input_tokens", "llm.output_tokens", "llm.cache_read_tokens", "llm.finish_reason", F.md5(said["content"]).alias("said"), F.col("llm.reasoning_text").alias("thought"), "llm.reasoning_tokens", calls.alias("calls"))


@query("src10_write_bundle", on_spans("SELECT CASE WHEN trace_id::BIGINT % 3 = 0 THEN 'second' ELSE 'first' END AS code, count(DISTINCT trace_id) AS traces, count(*) AS spans FROM spans GROUP BY 1"))
def bundles(spark, d):
    s = views.shared_spans(spark, d).select("span_id", "trace_id", "parent_span_id", "name", "start_ms", "end_ms", "status", "service", "environment", "session_id", "attributes")
    place = new_path(spark, "bundle")
    for code, own in (("first", s), ("second", s.where(F.col("trace_id").cast("long") % 3 == 0))):
        t = traces.assemble_traces(own)
        src.write_bundle(place, t, own, t.select("trace_id", F.lit(code).alias("code")), t.select("trace_id", F.lit("d").alias("detector_id")))
    found = src.read_bundle(spark, place, "findings")
    kept = src.read_bundle(spark, place, "spans").groupBy("trace_id").agg(F.count("*").alias("n"))
    return found.join(kept, "trace_id").groupBy("code").agg(F.count("*").alias("traces"), F.sum("n").alias("spans"))


# --- text and scalars

_LEVEL = "CASE user_id % 5 WHEN 0 THEN 'info' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END"
query("tx13_severity", f"WITH e AS (SELECT event_id // 7 AS g, user_id % 5 AS r FROM events) SELECT g, CASE max(r) WHEN 0 THEN 'info' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS worst, count(*) FILTER (r >= 2) AS severe FROM e GROUP BY 1")(
    lambda spark, d: events(spark, d).select(F.floor(F.col("event_id") / 7).alias("g"), F.expr(_LEVEL).alias("s")).groupBy("g").agg(text.max_severity(F.col("s")).alias("worst"), F.count_if(F.col("s").isin(text.severities_from("medium"))).alias("severe"))
)
query("tx16_attribute_lookup", "SELECT event_id, CASE event_id % 4 WHEN 1 THEN 500.0 WHEN 3 THEN NULL ELSE value END::DOUBLE AS n FROM events")(
    lambda spark, d: events(spark, d).select("event_id", text.first_number(F.map_filter(F.create_map(F.lit("http.status_code"), F.when(F.col("event_id") % 4 == 0, "x").when(F.col("event_id") % 4 == 1, "500").when(F.col("event_id") % 4 == 2, "Infinity").otherwise("NaN"), F.lit("status_code"), F.when(F.col("event_id") % 4 != 3, F.col("value").cast("string"))), lambda _k, v: v.isNotNull()), detectors.STATUS_KEYS).alias("n"))
)

# --- incidents, ranges, sweeps


@query("q4_incident_detail", f"WITH {INCIDENTS}, x AS (SELECT * FROM i ORDER BY count DESC, operation, first_seen_ms LIMIT 1) SELECT t.trace_id, 'GEN-008' AS code, ev.start_ms AS created_ms, 'Unexpected refusal' AS mode_name FROM (SELECT unnest(list_slice(trace_ids, -50, -1)) AS trace_id FROM x) t JOIN ev USING (trace_id)")
def incident_detail(spark, d):
    a = anchors(spark, d)
    i = causes.cluster_incidents(a, DAY)
    largest = i.orderBy(F.desc("count"), "operation", "first_seen_ms").select("incident_id").first()
    f = a.select("trace_id", "code", F.col("trace_id").alias("finding_id"), F.col("ts_ms").alias("created_ms"))
    return serving.incident_detail(i, f, largest["incident_id"] if largest else "").select("trace_id", "code", "created_ms", "mode_name")


@query("q11_default_range", f"WITH {views.DUCK_EVENTS}, m AS (SELECT max(start_ms) AS t FROM ev) SELECT status, count(*) AS n FROM ev, m WHERE start_ms BETWEEN t - 86400000 AND t GROUP BY 1")
def default_range(spark, d):
    e = views.event_traces(spark, d)
    first, last = serving.checked_range(None, None, e.agg(F.max("start_ms").alias("t")).first()["t"] or 0)
    return causes.in_range(e, first, last).groupBy("status").agg(F.count("*").alias("n"))


@query("sm11_sweep_stale", on_spans(f"SELECT f.trace_id, code, count(*) AS n FROM f JOIN (SELECT trace_id FROM t WHERE start_ms < {CUT} AND status <> 'error' ORDER BY start_ms, trace_id LIMIT 25) USING (trace_id) GROUP BY 1, 2", TRACES + ", f AS (" + " UNION ALL ".join(f"({sql_found(i)})" for i in DETECTED) + ")"))
def sweep(spark, d):
    s = views.shared_spans(spark, d)
    done = traces.assemble_traces(s).where("status = 'error'")
    _due, found = traces.sweep_stale(s, done, CUT, 25, detectors=tuple(x for x in detectors.DETECTORS if x.id in DETECTED))
    return found.groupBy("trace_id", "code").agg(F.count("*").alias("n"))


BURSTS = """h AS (SELECT trace_id, start_ms // 3600000 * 3600000 AS hour_ms FROM t), th AS (SELECT hour_ms, count(*) AS total FROM h GROUP BY 1),
nh AS (SELECT code, hour_ms, count(*) AS n FROM (SELECT DISTINCT trace_id, code FROM f) JOIN h USING (trace_id) GROUP BY 1, 2), rh AS (SELECT code, hour_ms, n / total AS rate FROM nh JOIN th USING (hour_ms)),
wh AS (SELECT *, avg(rate) OVER (PARTITION BY code ORDER BY hour_ms RANGE BETWEEN 86400000 PRECEDING AND 1 PRECEDING) AS "trailing" FROM rh)"""
query("x1_failure_bursts", on_spans("SELECT code, hour_ms, round(rate, 6) AS rate, round(\"trailing\", 6) AS \"trailing\" FROM wh WHERE rate >= 3 * \"trailing\"", ALL + ", " + BURSTS))(lambda spark, d: (lambda t, f: causes.failure_bursts(f, t))(*both(spark, d)))

# --- bookkeeping

_EVERY = [*((x.id, x.tier, x.cost, x.needs_baseline) for x in detectors.DETECTORS), *((x.id, x.tier, x.cost, x.needs_baseline) for x, _ in BASELINE_DETECTORS), *((i, "L3", "billed", False) for i, _c, _r in judge.RUBRICS)]
_OFF = ("tol.tool-error", "judge.safety")
_ROWS = ", ".join(f"('{i}', '{t}', '{c}', {str(b).lower()})" for i, t, c, b in _EVERY)
_IDS = ", ".join(f"('{CODE_OF[x]}', '{x}')" for x in _SET)
query("k4_catalogue", on_spans(f"SELECT c.id AS detector_id, tier, cost, needs, tier <> 'L2' AND c.id NOT IN {_OFF} AS enabled, coalesce(n, 0)::BIGINT AS n FROM (VALUES {_ROWS}) c(id, tier, cost, needs) LEFT JOIN (SELECT i.id, count(*) AS n FROM f JOIN (VALUES {_IDS}) i(code, id) USING (code) GROUP BY 1) x ON x.id = c.id", FOUND))(
    lambda spark, d: judge.catalogue(spark, _OFF, ("L0", "L1", "L3")).join(finding_set(spark, d).groupBy("detector_id").agg(F.count("*").alias("n")), "detector_id", "left").select("detector_id", "tier", "cost", F.col("needs_baseline").alias("needs"), "enabled", F.coalesce("n", F.lit(0)).alias("n"))
)


def slow_or_broken(span: dict):
    if span["duration_ms"] >= 1960:
        raise ValueError("too long")
    return ("GEN-002", 0.5) if span["duration_ms"] < 200 else ("GEN-001", 0.5) if span["kind"] == "llm" else None


def unbuildable(_spans, _th):
    raise KeyError("no such threshold")


_OWN = on_spans(f"""SELECT detector, code, severity, count(*) AS n FROM (SELECT 'tol.tool-error' AS detector, code, severity FROM ({sql_found('tol.tool-error')})
 UNION ALL SELECT 'own.slow', 'GEN-002', 'medium' FROM spans WHERE duration_ms < 200
 UNION ALL SELECT 'own.slow', 'INF-006', 'low' FROM (SELECT DISTINCT trace_id FROM spans WHERE duration_ms >= 1960) UNION ALL SELECT 'own.broken', 'INF-006', 'low' FROM (SELECT DISTINCT trace_id FROM spans)) GROUP BY 1, 2, 3""")


@query("k2_k3_own_detectors", _OWN)
def own_detectors(spark, d):
    """A user's detectors beside one of the library: one that fails on some spans and reports a code that it doesn't declare on others, and one that can't be built."""
    r = judge.Registry(x for x in detectors.DETECTORS if x.id == "tol.tool-error")
    r.add(judge.function_detector("own.slow", "L1", ("GEN-002",), slow_or_broken, ("trace_id", "span_id", "kind", "duration_ms")))
    r.add(detectors.Detector("own.broken", "L1", ("GEN-003",), unbuildable))
    f = r.detect(views.shared_spans(spark, d))
    failed = F.get(F.filter("evidence", lambda e: e["label"] == "detector"), F.lit(0))["value"]
    return f.select(F.coalesce(failed, "detector_id").alias("detector"), "code", "severity").groupBy("detector", "code", "severity").agg(F.count("*").alias("n"))


# --- sessions with fingerprints

SESSION = f"""{views.DUCK_HISTORY}, tu AS (SELECT trace_id, session_id, start_ms, count(*) AS n, list(role || ':' || md5(content) ORDER BY nr) AS p FROM history GROUP BY ALL),
se AS (SELECT *, lag(trace_id) OVER w AS pt, lag(n) OVER w AS pn, lag(p) OVER w AS pp FROM tu WINDOW w AS (PARTITION BY session_id ORDER BY start_ms)),
lost AS (SELECT *, len(list_filter(pp, lambda x: NOT list_contains(p, x))) AS gone, len(list_intersect(p, pp)) > 0 AS carried FROM se WHERE pt IS NOT NULL)"""


def turns_of_spans(spark, d):
    from ..operators import sessions

    return sessions.session_turns(views.turn_spans(spark, d))


query("se1_session_turns", f"WITH {SESSION} SELECT trace_id, session_id, start_ms, n AS message_count, md5(array_to_string(p, ',')) AS fingerprints, trace_id || '-s' AS span_id, 10 * n + 5 AS tokens, round((10 * n * 2.5 + 5 * 10) / 1000000, 8) AS cost_usd, 'ok' AS status FROM tu")(
    lambda spark, d: turns_of_spans(spark, d).withColumn("fingerprints", F.md5(F.array_join("fingerprints", ","))).withColumn("cost_usd", F.round("cost_usd", 8))
)


@query("det_session_fingerprints", f"""WITH {SESSION} SELECT trace_id, trace_id || '-s' AS span_id, 'CTX-003' AS code, 'high' AS severity, round(least(0.78, 0.45 + 0.05 * gone), 4) AS confidence FROM lost WHERE pn - n >= 2 AND gone >= 2
UNION ALL SELECT trace_id, trace_id || '-s', 'CTX-004', 'medium', 0.75 FROM lost WHERE pn >= 3 AND n <= 1 AND NOT carried""")
def session_fingerprints(spark, d):
    from ..operators import sessions

    return shown(sessions.session_findings(sessions.session_pairs(turns_of_spans(spark, d))))
