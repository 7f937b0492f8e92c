"""Queries of the detectors that read texts, over documents seen as traces, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import taxonomy as tax
from ..functions import redact as red
from ..functions import text
from ..operators import detectors, judge
from . import views
from .queries import CODE_OF, query, shown, sql_content, sql_luhn, sql_sentences, sql_tokens


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def on_texts(select: str, more: str = "") -> str:
    return f"WITH {views.DUCK_TEXTS}{', ' + more if more else ''} {select}"


def row(id_: str, slot: str, confidence: str, source: str, severity: str | None = None) -> str:
    code = CODE_OF[id_]
    return f"SELECT trace_id, trace_id || '-{slot}' AS span_id, '{code}' AS code, '{severity or tax.SEVERITY_OF[code]}' AS severity, round(({confidence})::DOUBLE, 4) AS confidence FROM {source}"


ASKED = "question || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || 'go on' END"
BEFORE = "list_concat([question], CASE WHEN doc_id % 2 = 1 THEN lines ELSE ['ok', 'ok', 'ok'] END)"
NOW = "CASE WHEN doc_id % 3 = 0 THEN [question] ELSE [question, 'ok', 'go on'] END"
INJECTED = lambda t: "(" + " OR ".join(f"regexp_matches({t}, {quoted(p)})" for _n, p in detectors.INJECTIONS) + ")"
SECRET = " OR ".join(f"regexp_matches(answer, {quoted(p)})" if n != "credit_card" else f"len(list_filter(regexp_extract_all(answer, {quoted(p)}), lambda c: {sql_luhn('c')})) > 0" for n, p, _r, on in red.PATTERNS if on and n not in detectors.NOT_SECRET)
FENCE = quoted(r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$")
GRAMS4 = "list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' '))"
RUN = lambda a, b: f"coalesce(list_max(list_transform(range(1, len({a}) + 1), lambda n: CASE WHEN len(list_filter(range(1, len({a}) - n + 2), lambda i: contains({b}, substr({a}, i, n)))) > 0 THEN n ELSE 0 END)), 0)"

SOURCES = f"""src AS (SELECT DISTINCT trace_id, unnest(flatten(list_transform(list_concat(docs, CASE WHEN result IS NULL THEN [] ELSE [result] END), lambda d: {sql_content('d')}))) AS token FROM v),
se AS (SELECT trace_id, {sql_sentences('answer')} AS ss FROM v WHERE answer <> ''), st AS (SELECT trace_id, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS nr FROM se),
sw AS (SELECT trace_id, nr, {sql_content('s')} AS words FROM st), w AS (SELECT trace_id, nr, unnest(words) AS token FROM sw WHERE len(words) >= 6),
ov AS (SELECT w.trace_id, nr, count(src.token) / count(*) AS overlap FROM w LEFT JOIN src USING (trace_id, token) GROUP BY 1, 2),
un AS (SELECT trace_id, count(*) FILTER (overlap < 0.15) / count(*) AS ratio FROM ov GROUP BY 1)"""
KEPT = f"""d AS (SELECT trace_id, unnest(docs) AS doc, unnest(range(1, len(docs) + 1)) AS nr FROM v), dw AS (SELECT trace_id, nr, unnest(list_distinct({sql_content('doc')})) AS token FROM d WHERE len(doc) > 20),
pr AS (SELECT trace_id, 'a' AS p, concat_ws(chr(10), system, array_to_string({BEFORE}, chr(10))) AS prompt FROM v UNION ALL SELECT trace_id, 'b', concat_ws(chr(10), system, array_to_string({NOW}, chr(10))) FROM v),
pt AS (SELECT DISTINCT trace_id, p, unnest({sql_content('prompt')}) AS token FROM pr), sz AS (SELECT trace_id, nr, count(*) AS n FROM dw GROUP BY 1, 2),
kp AS (SELECT trace_id, nr, max(k) AS k FROM (SELECT trace_id, nr, p, count(*) AS k FROM dw JOIN pt USING (trace_id, token) GROUP BY 1, 2, 3) GROUP BY 1, 2),
lo AS (SELECT trace_id, count(*) AS docs, count(*) FILTER (coalesce(k, 0) / n < 0.5) AS lost FROM sz LEFT JOIN kp USING (trace_id, nr) GROUP BY 1)"""
PAIRED = f"""dt AS (SELECT trace_id, list_transform(list_filter(docs, lambda d: len(d) > 0), lambda d: list_distinct({sql_tokens('d')})) AS s FROM v), di AS (SELECT trace_id, s, unnest(range(1, len(s) + 1)) AS i FROM dt WHERE len(s) >= 3),
dp AS (SELECT trace_id, s, i, unnest(range(i + 1, len(s) + 1)) AS j FROM di),
du AS (SELECT trace_id, count(*) AS n, count(*) FILTER (CASE WHEN len(list_distinct(list_concat(s[i], s[j]))) = 0 THEN 1.0 ELSE len(list_intersect(s[i], s[j])) / len(list_distinct(list_concat(s[i], s[j]))) END >= 0.8) AS same FROM dp GROUP BY 1)"""
DEGENERATE = f"""g AS (SELECT *, {sql_tokens('answer')} AS t FROM v), gr AS (SELECT *, CASE WHEN len(t) < 8 THEN 0 ELSE 1 - len(list_distinct({GRAMS4})) / len({GRAMS4}) END AS r FROM g)"""
PLANS = """pl AS (SELECT *, list_filter(['alpha', 'beta', 'gamma'], lambda x: contains(lower(thought), x)) AS said FROM v WHERE thought IS NOT NULL), pn AS (SELECT *, len(list_filter(said, lambda x: x <> tool_name)) + CASE WHEN list_contains(said, tool_name) THEN 0 ELSE 1 END AS n FROM pl)"""
VAGUE = "(len(regexp_extract_all(question, '(?i)\\bit\\b')) > len(regexp_extract_all(question, '(?i)\\bit\\s+is\\b')) OR " + " OR ".join(f"regexp_matches(question, {quoted(p)})" for p in detectors.VAGUE[1:]) + ")"
ASKS = "greatest(len(regexp_extract_all(question, '\\?')), len(regexp_extract_all(question, '(?:^|\\n)\\s*(?:\\d+[.)]|[-*])\\s+')))"
ACTUAL = "coalesce(in_tokens, ceil(len(question) / 4) + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 + 2 END)"
ARGUMENTS = """ar AS (SELECT *, CASE WHEN NOT json_valid(args) THEN 1 ELSE CASE WHEN json_exists(args, '$.q') THEN 0 ELSE 1 END
 + CASE WHEN json_exists(args, '$.n') AND json_type(args, '$.n') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 1 ELSE 0 END + CASE WHEN json_exists(args, '$.q') AND json_type(args, '$.q') <> 'VARCHAR' THEN 1 ELSE 0 END END AS n FROM v)"""
LEAKS = f"le AS (SELECT *, {RUN('lower(system)', 'lower(answer)')} AS run FROM v WHERE system IS NOT NULL AND answer <> '')"

SQL_OF = {
    "gen.ungrounded": (row("gen.ungrounded", "b", "least(0.75, 0.3 + ratio)", "un WHERE ratio > 0.3 AND trace_id IN (SELECT trace_id FROM src)"), SOURCES),
    "gen.schema-violation": (row("gen.schema-violation", "b", "0.95", f"v WHERE fmt = 'json' AND answer <> '' AND NOT json_valid(CASE WHEN regexp_matches(answer, {FENCE}) THEN regexp_extract(answer, {FENCE}, 1) ELSE answer END)"), ""),
    "gen.degenerate": (row("gen.degenerate", "b", "CASE WHEN out_tokens = 0 THEN 0.9 ELSE least(0.85, 0.4 + r) END", "gr WHERE out_tokens = 0 OR r >= 0.35"), DEGENERATE),
    "gen.refusal": (row("gen.refusal", "b", "0.6", "v WHERE answer <> '' AND (" + " OR ".join(f"regexp_matches(answer, {quoted(p)})" for p in detectors.REFUSALS) + ")"), ""),
    "gen.incomplete": (row("gen.incomplete", "b", "0.5", f"v WHERE answer <> '' AND {ASKS} >= 2 AND len({sql_sentences('answer')}) < {ASKS}"), ""),
    "agt.reasoning-mismatch": (row("agt.reasoning-mismatch", "g", "least(0.8, 0.45 + 0.1 * n)", "pn WHERE len(said) > 0 AND n > 0"), PLANS),
    "agt.missing-clarification": (row("agt.missing-clarification", "b", "0.5", f"v WHERE answer <> '' AND len({sql_content('question')}) <= 8 AND {VAGUE} AND NOT suffix(trim(answer), '?')"), ""),
    "ctx.truncation": (row("ctx.truncation", "b", "0.85", f"v WHERE intended > 0 AND {ACTUAL} < 0.98 * intended"), ""),
    "ctx.history-loss": (row("ctx.history-loss", "b", "0.65", f"v WHERE len({BEFORE}) - len({NOW}) >= 2"), ""),
    "ctx.reset": (row("ctx.reset", "b", "0.7", f"v WHERE len({BEFORE}) >= 3 AND len({NOW}) <= 1"), ""),
    "ctx.malformed-input": (row("ctx.malformed-input", "a", "0.9", "v WHERE trim(question) = ''"), ""),
    "ret.consolidation-loss": (row("ret.consolidation-loss", "b", "least(0.75, 0.35 + 0.5 * lost / docs)", "lo WHERE lost > 0"), KEPT),
    "ret.redundant": (row("ret.redundant", "r", "0.7", "du WHERE same / n >= 0.4"), PAIRED),
    "ret.staleness": (row("ret.staleness", "r", "0.75", "v WHERE (500 + age_days::BIGINT * 86400000) / 86400000 >= 180"), ""),
    "sec.injection-direct": (row("sec.injection-direct", "a", "0.7", f"v WHERE {INJECTED('question')}") + " UNION ALL " + row("sec.injection-direct", "b", "0.7", f"v WHERE {INJECTED('(' + ASKED + ')')}"), ""),
    "sec.injection-indirect": (row("sec.injection-indirect", "r", "0.75", f"(SELECT trace_id, unnest(docs) AS x FROM v) WHERE {INJECTED('x')}") + " UNION ALL " + row("sec.injection-indirect", "t", "0.75", f"v WHERE result IS NOT NULL AND {INJECTED('result')}"), ""),
    "sec.egress": (row("sec.egress", "b", "0.85", f"v WHERE answer <> '' AND ({SECRET})"), ""),
    "sec.prompt-leak": (row("sec.prompt-leak", "b", "least(0.9, 0.5 + run / 240)", "le WHERE len(system) >= 60 AND len(answer) >= 60 AND run >= 60"), LEAKS),
    "tol.arguments": (row("tol.arguments", "t", "0.9", "ar WHERE n > 0"), ARGUMENTS),
}


def detector(id_: str):
    chosen = tuple(x for x in detectors.DETECTORS if x.id == id_)
    return lambda spark, d: shown(detectors.detect(views.text_spans(spark, d), None, chosen))


for _id, (_select, _more) in SQL_OF.items():
    query(f"det_{_id.replace('.', '_').replace('-', '_')}", on_texts(_select, _more))(detector(_id))

query("tx9_longest_common_run", on_texts("SELECT trace_id, run::INTEGER AS run FROM le", LEAKS))(
    lambda spark, d: views.texts(spark, d).where("system is not null and answer <> ''").select("trace_id", text.longest_common_run(F.lower("system"), F.lower("answer")).alias("run"))
)
query("tx10_truncate", on_texts("SELECT trace_id, md5(CASE WHEN len(answer) > 40 THEN left(answer, 40) || '…' ELSE answer END) AS short FROM v"))(lambda spark, d: views.texts(spark, d).select("trace_id", F.md5(text.truncate(F.col("answer"), 40)).alias("short")))
query("tx11_stable_hash", on_texts("SELECT md5(answer) AS hash, count(*) AS n FROM v GROUP BY 1"))(lambda spark, d: views.texts(spark, d).groupBy(text.stable_hash(F.col("answer")).alias("hash")).agg(F.count("*").alias("n")))

# --- requests to a judge

_Q = ("judge.faithfulness", "judge.extraction", "judge.specificity", "judge.specification", "judge.derailment", "judge.safety")
_CONTEXT = {
    "judge.faithfulness": "array_to_string(docs, chr(10) || '---' || chr(10))", "judge.extraction": "array_to_string(docs, chr(10) || '---' || chr(10))", "judge.specificity": "''", "judge.specification": "''",
    "judge.derailment": "'1. agent step-g' || chr(10) || '2. retriever step-r' || chr(10) || '3. llm step-a' || chr(10) || '4. tool step-t' || chr(10) || '5. llm step-b'", "judge.safety": "''",
}
query("j1_judge_requests", on_texts(" UNION ALL ".join(f"SELECT trace_id, trace_id || '-b' AS span_id, '{q}' AS detector_id, 'help' AS question, md5({_CONTEXT[q]}) AS context, md5(answer) AS output FROM v WHERE answer <> ''" for q in _Q)))(
    lambda spark, d: judge.judge_requests(views.text_spans(spark, d)).select("trace_id", "span_id", "detector_id", "question", F.md5("context").alias("context"), F.md5("output").alias("output"))
)


@query("j5_apply_verdicts", on_texts("""SELECT trace_id, trace_id || '-b' AS span_id, CASE doc_id % 3 WHEN 0 THEN 'SEC-005' WHEN 1 THEN 'GEN-001' ELSE 'AGT-004' END AS code,
 CASE doc_id % 3 WHEN 0 THEN 'critical' ELSE 'high' END AS severity, round(doc_id % 10 / 10, 4) AS confidence FROM v WHERE answer <> '' AND doc_id % 4 < 2"""))
def verdicts(spark, d):
    names = F.create_map(*[F.lit(x) for kv in ((0, "judge.safety"), (1, "judge.extraction"), (2, "judge.derailment")) for x in kv])
    r = judge.judge_requests(views.text_spans(spark, d)).where(F.col("detector_id") == F.element_at(names, (F.col("trace_id").cast("long") % 3).cast("int")))
    n = F.col("trace_id").cast("long")
    reply = F.when(n % 4 < 2, F.format_string('{"verdict": true, "confidence": %s, "rationale": "r"}', (n % 10 / 10).cast("string"))).when(n % 4 == 2, F.lit('{"verdict": false}')).otherwise(F.lit("no idea"))
    return shown(judge.apply_verdicts(judge.parse_verdicts(r.withColumn("reply", reply))))
