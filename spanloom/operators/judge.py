"""Requests to a judge model, their gating and budget, and what its verdicts become; and the bookkeeping of detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import estimate_tokens
from ..schema import THRESHOLDS
from .baselines import BASELINE_DETECTORS
from .detectors import BY_START, DETECTORS, Detector, assistant_text, detect, evidence, final_answer, finished, first_question, kind, tagged

#: Detector, code, what the judge is asked.
RUBRICS = (
    ("judge.faithfulness", "GEN-004", "Does the output claim anything that the context does not support?"),
    ("judge.extraction", "GEN-001", "Does the context hold an answer that the output misses?"),
    ("judge.specificity", "GEN-002", "Is the output too general or too detailed for the question?"),
    ("judge.specification", "AGT-001", "Does the output break the task's stated constraints?"),
    ("judge.derailment", "AGT-004", "Does the course of steps leave the objective?"),
    ("judge.safety", "SEC-005", "Is the output unsafe under the policy?"),
)
#: Characters of question, context and output that the reference puts into a request; judge_requests() takes them as limits.
REQUEST_CHARS = (4000, 8000, 6000)
SAMPLE_RATE, DAILY_TOKENS, REQUEST_TOKENS = 0.1, 500_000, 4000
POLICY_KEY = "policy.description"


def judge_requests(spans: DataFrame, limits: tuple = (None, None, None)) -> DataFrame:
    """trace_id, span_id, detector_id, code, rubric, question, context, output: up to six requests a trace that has a final answer. limits are how many characters of question, context and output a request takes; None is all of them."""
    answer = final_answer(spans)
    objective = spans.where(kind("agent")).groupBy("trace_id").agg(F.min_by("agent.objective", F.when(F.col("agent.objective").isNotNull(), F.struct(*BY_START))).alias("objective"))
    texts = spans.where(F.col("retrieval.documents").isNotNull()).select("trace_id", "start_ms", "span_id", F.posexplode("retrieval.documents.content").alias("at", "text")).where("text is not null")
    docs = texts.groupBy("trace_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_ms", "span_id", "at", "text"))), lambda x: x["text"]), "\n---\n").alias("docs"))
    steps = spans.groupBy("trace_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_ms", "span_id", "kind", "name"))), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["kind"], F.lit(" "), x["name"])), "\n").alias("steps"), F.min(F.try_element_at("attributes", F.lit(POLICY_KEY))).alias("policy"))
    t = answer.join(first_question(spans), "trace_id", "left").join(objective, "trace_id", "left").join(docs, "trace_id", "left").join(steps, "trace_id", "left")
    goal = F.coalesce("objective", "question", F.lit(""))
    contexts = {"judge.faithfulness": F.col("docs"), "judge.extraction": F.col("docs"), "judge.specificity": F.lit(""), "judge.specification": F.lit(""), "judge.derailment": F.col("steps"), "judge.safety": F.coalesce("policy", F.lit(""))}
    each = F.array(*[F.struct(F.lit(d).alias("detector_id"), F.lit(c).alias("code"), F.lit(r).alias("rubric"), contexts[d].alias("context")) for d, c, r in RUBRICS])
    out = t.select("trace_id", "span_id", goal.alias("question"), F.col("answer").alias("output"), F.explode(each).alias("r")).where("r.context is not null")
    return out.select("trace_id", "span_id", "r.detector_id", "r.code", "r.rubric", *[(F.col(c) if n is None else F.left(c, F.lit(n))).alias(c.split(".")[-1]) for c, n in zip(("question", "r.context", "output"), limits, strict=True)])


def gated(requests: DataFrame, findings: DataFrame, rate: float = SAMPLE_RATE, sure: float = THRESHOLDS["short_circuit_confidence"]) -> DataFrame:
    """Requests of a sample of traces (by a hash of the id, so all or none of a trace), whose code no cheaper tier asserts already."""
    h = F.conv(F.substring(F.md5(F.col("trace_id").cast("binary")), 1, 7), 16, 10).cast("long")
    known = findings.where((F.col("confidence") >= sure) & (F.col("tier") != "L3")).select("trace_id", "code").distinct()
    return requests.where(h < int(rate * 0x10000000)).join(known, ["trace_id", "code"], "left_anti")


def within_budget(requests: DataFrame, day: str = "day", daily: int = DAILY_TOKENS) -> DataFrame:
    """Requests (with a day column) while the day's estimated tokens leave room for one more, in order of a hash of the trace (so that no trace is favoured), then trace and detector.

    Sums are taken within buckets of the hash and over the buckets' totals, so that no day is a single task.
    """
    h = F.md5(F.col("trace_id").cast("binary"))
    size = requests.select(day, "trace_id", "detector_id", h.alias("_h"), F.substring(h, 1, 3).alias("_bucket"), (estimate_tokens(F.concat("question", "context", "output")) + 200).alias("estimate"))
    totals = size.groupBy(day, "_bucket").agg(F.sum("estimate").alias("_total"))
    earlier = Window.partitionBy(day).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(day, "_bucket", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(day, "_bucket").orderBy("_h", "trace_id", "detector_id").rowsBetween(Window.unboundedPreceding, -1)
    spent = size.withColumn("_own", F.coalesce(F.sum("estimate").over(inside), F.lit(0))).join(carried, [day, "_bucket"])
    ok = spent.where(F.lit(daily) - F.col("_before") - F.col("_own") >= REQUEST_TOKENS)
    return requests.join(ok.select(day, "trace_id", "detector_id"), [day, "trace_id", "detector_id"], "left_semi")


def parse_verdicts(replies: DataFrame, text: str = "reply") -> DataFrame:
    """replies with verdict (boolean; null if there is none), confidence (0.5 unless given, clamped) and rationale, from the first { to the last }."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    v = F.try_parse_json(body)
    is_bool = F.schema_of_variant(F.try_variant_get(v, "$.verdict", "variant")) == "BOOLEAN"
    sure = F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.lit(0.5))
    return replies.withColumns({"verdict": F.when(is_bool, F.try_variant_get(v, "$.verdict", "boolean")), "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), sure)), "rationale": F.coalesce(F.try_variant_get(v, "$.rationale", "string"), F.lit(""))})


def apply_verdicts(verdicts: DataFrame) -> DataFrame:
    """Findings of the requests whose verdict is true."""
    out = None
    for n, (d, c, _r) in enumerate(RUBRICS):
        yes = verdicts.where((F.col("detector_id") == d) & F.col("verdict")).select("trace_id", "span_id", F.lit("").alias("k"), F.lit(c).alias("code"), F.lit(None).cast("string").alias("severity"), "confidence", evidence(("rationale", F.col("rationale"))).alias("evidence"))
        yes = tagged(yes, Detector(d, "L3", (c,), None, cost="billed"), 300 + n)
        out = yes if out is None else out.unionByName(yes)
    return finished(out)


# --- bookkeeping


def catalogue(spark: SparkSession, disabled=(), tiers=("L0", "L1", "L2", "L3")) -> DataFrame:
    """detector_id, tier, emits, cost, needs_baseline, enabled."""
    every = [*DETECTORS, *(d for d, _ in BASELINE_DETECTORS), *(Detector(d, "L3", (c,), None, cost="billed") for d, c, _ in RUBRICS)]
    rows = [(d.id, d.tier, list(d.emits), d.cost, d.needs_baseline, d.id not in disabled and d.tier in tiers) for d in every]
    return spark.createDataFrame(rows, "detector_id string, tier string, emits array<string>, cost string, needs_baseline boolean, enabled boolean")


class Registry:
    """Detectors by id; user detectors are added without touching the built-in ones, and a second one of an id is an error."""

    def __init__(self, detectors=DETECTORS):
        self._by_id = {}
        for d in detectors:
            self.add(d)

    def add(self, detector: Detector) -> None:
        if detector.id in self._by_id:
            raise ValueError(f"a detector {detector.id} is there already")
        self._by_id[detector.id] = detector

    def all(self) -> tuple[Detector, ...]:
        return tuple(self._by_id.values())

    def detect(self, spans: DataFrame, th: dict | None = None, disabled=(), tiers=("L0", "L1", "L2")) -> DataFrame:
        """The findings of all detectors that are on. One whose rule can't even be built, or whose function fails on a trace, gives a finding INF-006 there and keeps the others from nothing; codes that a detector doesn't declare are dropped."""
        good, bad = [], []
        for d in self.all():
            if d.id in disabled or d.tier not in tiers:
                continue
            try:
                d.rule(th or THRESHOLDS) if d.by_row else d.rule(spans, th or THRESHOLDS)
                good.append(d)
            except Exception as e:  # noqa: BLE001 a user's rule may raise anything
                bad.append((d.id, str(e)))
        out = detect(spans, th, tuple(good)) if good else None
        failed = self_failures(out) if out is not None else None
        out = None if out is None else out.where(F.col("code") != FAILED_CODE)
        if bad:
            names = spans.sparkSession.createDataFrame(bad, "detector_id string, error string")
            everywhere = spans.select("trace_id").distinct().crossJoin(F.broadcast(names))  # a row a broken detector
            failed = self_observed(everywhere) if failed is None else failed.unionByName(self_observed(everywhere))
        return failed if out is None else out if failed is None else out.unionByName(failed)


#: Code of the rows in which a function's failure travels; no mode has it.
FAILED_CODE = "FAILED"


def function_detector(id_: str, tier: str, emits: tuple[str, ...], function, columns: tuple[str, ...] = ("trace_id", "span_id", "kind", "name", "status"), where=None) -> Detector:
    """A detector from a Python function of one span (a dict of the columns), which gives None or (code, confidence). Rows go to it in Arrow batches; what it raises becomes a finding of the engine in that trace, and the other rows go on."""

    def rule(spans: DataFrame, th: dict) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            names = ("trace_id", "span_id", "k", "code", "severity", "confidence", "error")
            for b in batches:
                out = []
                for r in b.to_pylist():
                    try:
                        found = function(r)
                        if found is not None:
                            out.append((r["trace_id"], r["span_id"], "", found[0], None, float(found[1]), None))
                    except Exception as e:  # noqa: BLE001 a user's function may raise anything
                        out.append((r["trace_id"], None, str(e)[:200], FAILED_CODE, "low", 1.0, str(e)[:200]))
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], pa.schema([(n, pa.float64() if n == "confidence" else pa.string()) for n in names]))

        rows = spans if where is None else spans.where(where)
        found = rows.select(*columns).mapInArrow(run, "trace_id string, span_id string, k string, code string, severity string, confidence double, error string")
        return found.withColumn("evidence", F.when(F.col("error").isNull(), evidence()).otherwise(evidence(("error", F.col("error"))))).drop("error")

    return Detector(id_, tier, (*emits, FAILED_CODE), rule)


def self_failures(findings: DataFrame) -> DataFrame:
    """The failures among findings, each trace and detector once."""
    bad = findings.where(F.col("code") == FAILED_CODE).groupBy("trace_id", "detector_id").agg(F.min(F.get("evidence", F.lit(0))["value"]).alias("error"))
    return self_observed(bad)


def judge_runs(spans: DataFrame, findings: DataFrame, requests: DataFrame, th: dict) -> DataFrame:
    """trace_id, detector_id, supported, covered of each trace and judge: whether it has a request, and whether a cheaper tier asserts its code already."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("detector_id"), F.lit(c).alias("code")) for d, c, _ in RUBRICS])).alias("j")
    rows = spans.select("trace_id").distinct().select("trace_id", each).select("trace_id", "j.*")
    known = findings.where((F.col("confidence") >= th["short_circuit_confidence"]) & (F.col("tier") != "L3")).select("trace_id", "code").distinct().withColumn("covered", F.lit(True))
    asked = requests.select("trace_id", "detector_id").distinct().withColumn("supported", F.lit(True))
    rows = rows.join(asked, ["trace_id", "detector_id"], "left").join(known, ["trace_id", "code"], "left")
    return rows.select("trace_id", "detector_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("supported", "covered")])


def detector_runs(
    spans: DataFrame, findings: DataFrame, baseline_counts: DataFrame | None = None, detectors=DETECTORS, th: dict | None = None, requests: DataFrame | None = None, configured: bool = True, failures: DataFrame | None = None
) -> DataFrame:
    """trace_id, detector_id, outcome, findings: one row for each trace and detector; what a detector supports is told by the kinds of spans that the trace has.

    The outcome is the first that holds of skipped:unsupported, skipped:insufficient-baseline, skipped:covered,
    skipped:unconfigured, timeout, failed and ok. With requests (trace_id, detector_id, as of judge_requests()) there are
    rows for the judges, which have no model where `configured` is false. failures are trace_id, detector_id and error of
    runs that broke off, by themselves or (error begins with "exceeded") for taking too long; what function detectors
    report among the findings counts too, and such rows aren't counted as findings.
    """
    th = th or THRESHOLDS
    k = lambda *names: F.bool_or(kind(*names))
    support = {
        "llm": k("llm"), "tool": k("tool"), "retriever": k("retriever"), "agent": k("agent"), "guardrail": k("guardrail"),
        "answer": F.bool_or(kind("llm") & (assistant_text() != "")), "any": F.lit(True),
    }
    needs = {"inf.provider-error": "llm", "gen.output-truncated": "llm", "ctx.window-overflow": "llm", "agt.iteration-cap": "agent", "agt.premature-termination": "agent", "agt.missing-verification": "tool", "sec.guardrail-bypass": "guardrail", "tol.unknown-tool": "tool", "tol.tool-error": "tool", "tol.retry-storm": "tool", "tol.excessive-agency": "tool", "ret.zero-hits": "retriever", "gen.ungrounded": "answer", "gen.refusal": "answer", "ret.embedding-weakness": "retriever", "ret.redundant": "retriever", "ret.staleness": "retriever", "tol.arguments": "tool"}
    flags = spans.groupBy("trace_id").agg(*[c.alias(f"has_{n}") for n, c in support.items()])
    each = F.array(*[F.struct(F.lit(d.id).alias("detector_id"), F.col(f"has_{needs.get(d.id, 'any')}").alias("supported"), F.lit(d.needs_baseline).alias("needs")) for d in detectors])
    runs = flags.select("trace_id", F.explode(each).alias("d")).select("trace_id", "d.*")
    runs = runs.withColumn("covered", F.lit(False)).withColumn("judge", F.lit(False))
    if requests is not None:
        runs = runs.unionByName(judge_runs(spans, findings, requests, th).withColumn("needs", F.lit(False)).withColumn("judge", F.lit(True)))
    found = findings.where(F.col("code") != FAILED_CODE).groupBy("trace_id", "detector_id").agg(F.count("*").alias("findings"))
    broken = findings.where(F.col("code") == FAILED_CODE).select("trace_id", "detector_id", F.get("evidence", F.lit(0))["value"].alias("error")) if "evidence" in findings.columns else None
    if failures is not None:
        own = failures.select("trace_id", "detector_id", "error")
        broken = own if broken is None else broken.unionByName(own)
    if broken is not None:
        broken = broken.groupBy("trace_id", "detector_id").agg(F.min(F.coalesce("error", F.lit(""))).alias("error"))
        runs = runs.join(broken, ["trace_id", "detector_id"], "left")
    else:
        runs = runs.withColumn("error", F.lit(None).cast("string"))
    runs = runs.join(found, ["trace_id", "detector_id"], "left")
    if baseline_counts is not None:
        runs = runs.join(baseline_counts, "trace_id", "left")
        thin = F.col("needs") & (F.coalesce("count", F.lit(0)) < th["min_baseline_samples"])
    else:
        thin = F.lit(False)
    outcome = F.when(~F.col("supported"), "skipped:unsupported").when(thin, "skipped:insufficient-baseline").when(F.col("covered"), "skipped:covered")
    outcome = outcome.when(F.col("judge") & F.lit(not configured), "skipped:unconfigured").when(F.col("error").startswith("exceeded"), "timeout").when(F.col("error").isNotNull(), "failed").otherwise("ok")
    return runs.select("trace_id", "detector_id", outcome.alias("outcome"), F.coalesce("findings", F.lit(0)).alias("findings"))


def self_observed(results: DataFrame) -> DataFrame:
    """Findings of detectors that failed on a trace: results have trace_id, detector_id and error (null if it went well)."""
    bad = results.where("error is not null").select("trace_id", F.lit(None).cast("string").alias("span_id"), F.col("detector_id").alias("k"), F.lit("INF-006").alias("code"), F.lit("low").alias("severity"), F.lit(1.0).alias("confidence"), evidence(("detector", F.col("detector_id")), ("error", F.left("error", F.lit(200)))).alias("evidence"))
    return finished(tagged(bad, Detector("engine.self", "L0", ("INF-006",), None), 400))
