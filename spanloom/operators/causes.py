"""Attribution of findings to causes, incidents, cohorts and alerts."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import severity_rank
from ..schema import THRESHOLDS
from ..taxonomy import MODES, causal_closure, edges

MAX_CHAIN = 8
KEPT_TRACES = 200
COHORT_KEYS = ("service", "environment", "model", "route")


def _placed(findings: DataFrame, spans: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """findings with span_name, parent, depth and ancestors of their spans, trace_start_ms and at_ms.

    Findings, spans and tree come together as rows of one table, and what spans know is told by windows: where all are
    partitioned by trace_id already, nothing is exchanged, as it would be for joins by trace and span.
    """
    rows = findings.withColumn("_finding", F.lit(True)).unionByName(spans.select("trace_id", "span_id", F.col("start_ms").alias("_start"), F.col("name").alias("_name"), F.col("parent_span_id").alias("_parent")), allowMissingColumns=True)
    if tree is not None:
        n = int(findings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.unionByName(tree.select("trace_id", "span_id", F.col("depth").alias("_depth"), F.col("ancestors").alias("_ancestors")).repartition(n, "trace_id"), allowMissingColumns=True)
    else:
        rows = rows.withColumns({"_depth": F.lit(None).cast("int"), "_ancestors": F.lit(None).cast("array<string>")})
    of_span, of_trace = Window.partitionBy("trace_id", "span_id"), Window.partitionBy("trace_id")
    own = lambda c: F.when(F.col("span_id").isNotNull(), F.max(c).over(of_span))
    rows = rows.withColumns({"start_ms": own("_start"), "span_name": own("_name"), "parent": own("_parent"), "depth": own("_depth"), "ancestors": own("_ancestors"), "trace_start_ms": F.min("_start").over(of_trace)})
    return rows.where("_finding").withColumn("at_ms", F.coalesce("start_ms", "trace_start_ms")).drop("_finding", "_start", "_name", "_parent", "_depth", "_ancestors", "start_ms")


def order_findings(findings: DataFrame, spans: DataFrame, tree: DataFrame) -> DataFrame:
    """findings with at_ms, depth, ancestors and position in their trace: by span start (the trace's for findings without a span), depth, severity downwards, detection order."""
    f = _placed(findings, spans, tree).drop("parent").withColumn("rank", severity_rank(F.col("severity")))
    w = Window.partitionBy("trace_id").orderBy("at_ms", F.coalesce("depth", F.lit(0)), F.desc("rank"), "ordinal", "finding_id")
    return f.withColumn("position", F.row_number().over(w))


def link_causes(ordered: DataFrame, spark) -> DataFrame:
    """ordered with role, caused_by and cause_position: of the earlier findings of the trace whose code reaches this one's, the nearest in the taxonomy, then the earliest.

    Of findings of one code and detector, with a span or all without, only the first can be a cause: what comes later is
    neither nearer nor earlier. So each finding is held against those of its trace, which are no more than the taxonomy
    and the detectors allow. Only where no span of a trace has a start do ancestors decide, and then each span has its own.
    """
    reach = causal_closure(edges(spark)).groupBy(F.col("effect").alias("code")).agg(F.map_from_entries(F.collect_list(F.struct("cause", "distance"))).alias("_reach"))
    f = ordered.join(F.broadcast(reach), "code", "left")  # fixed by the taxonomy: a row a mode
    alike = Window.partitionBy("trace_id", "code", "ordinal", F.col("span_id").isNull(), F.when(F.col("at_ms").isNull(), F.col("span_id"))).orderBy("position")
    first = F.when(F.col("_nth") == 1, F.struct(F.col("position").alias("p"), "finding_id", "code", "ordinal", "span_id"))
    f = f.withColumn("_nth", F.row_number().over(alike)).withColumn("_firsts", F.collect_list(first).over(Window.partitionBy("trace_id")))

    def precedes(c: Column) -> Column:
        timed = F.col("span_id").isNotNull() & c["span_id"].isNotNull()
        # of timed ones, those that are earlier by position don't start later
        return F.when(timed, F.col("at_ms").isNotNull() | F.coalesce(F.array_contains("ancestors", c["span_id"]), F.lit(False))).otherwise(c["ordinal"] <= F.col("ordinal"))

    causes = F.filter("_firsts", lambda c: (c["p"] < F.col("position")) & F.map_contains_key("_reach", c["code"]) & precedes(c))
    f = f.withColumn("_best", F.array_min(F.transform(causes, lambda c: F.struct(F.try_element_at("_reach", c["code"]).alias("distance"), c["p"].alias("p"), c["finding_id"].alias("finding_id")))))
    f = f.withColumns({"caused_by": F.col("_best.finding_id"), "cause_position": F.col("_best.p")})
    return f.withColumn("role", F.when(F.col("caused_by").isNotNull(), "symptom").otherwise("standalone")).drop("_reach", "_nth", "_firsts", "_best")


def pick_origin(linked: DataFrame) -> DataFrame:
    """The most severe, then most confident, then first of each trace's findings that are no symptoms becomes the origin."""
    w = Window.partitionBy("trace_id").orderBy(F.col("role") == "symptom", F.desc("rank"), F.desc("confidence"), "position")
    return linked.withColumn("_n", F.row_number().over(w)).withColumn("role", F.when((F.col("_n") == 1) & (F.col("role") != "symptom"), "origin").otherwise(F.col("role"))).drop("_n")


def causal_chain(roles: DataFrame, longest: int = MAX_CHAIN) -> DataFrame:
    """trace_id, origin_id, chain (finding ids), codes: from the origin along the most severe direct effect; effects lie later than causes, so nothing repeats."""
    trace = Window.partitionBy("trace_id")
    link = lambda *by: F.struct(*by, F.col("finding_id").alias("id"), F.col("code").alias("code"))
    # a step is the same for all rows of a trace, so that each needs a window and no join
    steps = roles.withColumn("_at0", F.max(F.when(F.col("role") == "origin", link())).over(trace))
    for n in range(1, longest):
        effect = F.when(F.col("caused_by") == F.col(f"_at{n - 1}.id"), link(F.col("rank"), F.col("confidence"), (-F.col("position")).alias("p")))
        steps = steps.withColumn(f"_at{n}", F.max(effect).over(trace))
    chain = lambda x: F.array_compact(F.array(*[F.col(f"_at{n}.{x}") for n in range(longest)]))
    return steps.where("role = 'origin'").select("trace_id", F.col("finding_id").alias("origin_id"), chain("id").alias("chain"), chain("code").alias("codes"))


def summarise(roles: DataFrame) -> DataFrame:
    """trace_id, summary: the origin's mode and place, and its direct symptoms."""
    trace = Window.partitionBy("trace_id")
    origin = F.max(F.when(F.col("role") == "origin", F.col("finding_id"))).over(trace)
    own = roles.withColumn("_origin", origin).where("_origin is not null").withColumn("_direct", F.col("caused_by") == F.col("_origin"))
    o = own.groupBy("trace_id").agg(
        F.max(F.when(F.col("role") == "origin", F.struct("title", "span_name"))).alias("o"),
        F.count_if("_direct").alias("n"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("_direct"), F.col("title")))), ", ").alias("which"),
    )
    place = F.coalesce(F.concat(F.lit(' at "'), "o.span_name", F.lit('"')), F.lit(""))
    tail = F.when(F.col("n") == 0, F.lit("")).otherwise(F.concat(F.lit(" led to "), F.col("n").cast("string"), F.lit(" finding(s): "), "which"))
    return o.select("trace_id", F.concat("o.title", place, tail).alias("summary"))


def attribute(findings: DataFrame, spans: DataFrame, tree: DataFrame) -> DataFrame:
    return pick_origin(link_causes(order_findings(findings, spans, tree), findings.sparkSession))


def to_order(spans: DataFrame, findings: DataFrame) -> DataFrame:
    """The spans of traces with two findings or more: only there do depth and ancestors matter to order and links, so that the span tree needs no others."""
    many = findings.groupBy("trace_id").agg(F.count("*").alias("n")).where("n >= 2").select("trace_id")
    return spans.join(many, "trace_id", "left_semi")


def tied_spans(spans: DataFrame, findings: DataFrame) -> DataFrame:
    """trace_id, span_id, parent_span_id of the traces in which depth or ancestors can matter to order and links: findings of different spans, or of a span and the trace, are at one time and one of the spans has its parent there, or nothing has a time."""
    f = _placed(findings, spans)
    at, key = Window.partitionBy("trace_id", "at_ms"), F.coalesce("span_id", F.lit(""))
    f = f.withColumns({"_least": F.min(key).over(at), "_most": F.max(key).over(at)})
    f = f.where("at_ms is null or (_least <> _most and parent is not null)").select("trace_id", F.col("parent").alias("key"), F.lit(True).alias("wanted"), F.col("at_ms").isNull().alias("always"))
    there = spans.select("trace_id", F.col("span_id").alias("key"), F.lit(True).alias("there"))
    met = f.unionByName(there, allowMissingColumns=True).groupBy("trace_id", "key").agg(F.max("wanted").alias("wanted"), F.max("always").alias("always"), F.max("there").alias("there"))
    traces = met.where("always or (wanted and there)").select("trace_id").distinct()
    return spans.select("trace_id", "span_id", "parent_span_id").join(traces, "trace_id", "left_semi")


def trace_rollup(traces: DataFrame, findings: DataFrame) -> DataFrame:
    f = findings.groupBy("trace_id").agg(F.count("*").alias("finding_count"), F.max_by("severity", severity_rank(F.col("severity"))).alias("worst_severity"))
    return traces.join(f, "trace_id", "left").withColumn("finding_count", F.coalesce("finding_count", F.lit(0)))


def incident_anchor(roles: DataFrame, traces: DataFrame) -> DataFrame:
    """One finding a trace: the origin, else the most severe and confident; operation is its span's name, else the trace's."""
    w = Window.partitionBy("trace_id").orderBy(F.col("role") != "origin", F.desc(severity_rank(F.col("severity"))), F.desc("confidence"), "finding_id")
    a = roles.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return a.join(traces.select("trace_id", F.col("name").alias("trace_name"), F.col("start_ms").alias("ts_ms")), "trace_id").withColumn("operation", F.coalesce("span_name", "trace_name"))


def gap_sessions(df: DataFrame, keys: list[str], ts: str, tie: str, gap_ms: int, name: str) -> DataFrame:
    """df with name: the number of the session of each row in its series (keys); a session ends where the next row comes later than gap_ms.

    Gaps are found within buckets of time and then between them, from the buckets' first and last rows, so that a
    series of all rows is no single task.
    """
    bucket = F.floor(F.col(ts) / gap_ms)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts, tie)
    rows = df.withColumn("_bucket", bucket).withColumn("_gap", F.coalesce((F.col(ts) - F.lag(ts).over(inside) > gap_ms).cast("int"), F.lit(0)))
    rows = rows.withColumn("_inner", F.sum("_gap").over(inside))
    ends = rows.groupBy(*keys, "_bucket").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.sum("_gap").alias("_gaps"))
    series = Window.partitionBy(*keys).orderBy("_bucket")
    begins = F.coalesce((F.col("_first") - F.lag("_last").over(series) > gap_ms).cast("int"), F.lit(1))
    ends = ends.withColumn("_begins", begins)
    ends = ends.select(*keys, "_bucket", (F.sum(F.col("_begins") + F.col("_gaps")).over(series) - F.col("_gaps")).alias("_base"))
    return rows.join(ends, [*keys, "_bucket"]).withColumn(name, F.col("_base") + F.col("_inner")).drop("_bucket", "_gap", "_inner", "_base")


def cluster_incidents(anchors: DataFrame, gap_ms: int = THRESHOLDS["incident_window_ms"], kept: int = KEPT_TRACES) -> DataFrame:
    """anchors (trace_id, code, operation, severity, ts_ms) grouped by code and operation wherever no gap is longer than gap_ms; trace_ids are the last `kept` of an incident, by time."""
    a = gap_sessions(anchors, ["code", "operation"], "ts_ms", "trace_id", gap_ms, "_n")
    g = a.groupBy("code", "operation", "_n").agg(F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"), F.count("*").alias("count"), F.min("ts_ms").alias("first_seen_ms"), F.max("ts_ms").alias("last_seen_ms"))
    newest = Window.partitionBy("code", "operation", "_n").orderBy(F.desc("ts_ms"), F.desc("trace_id"))
    last = a.select("code", "operation", "_n", "ts_ms", "trace_id").withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= kept)
    last = last.groupBy("code", "operation", "_n").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts_ms", "trace_id"))), lambda x: x["trace_id"]).alias("trace_ids"))
    names = F.create_map(*[F.lit(x) for c, n, *_ in MODES for x in (c, n)])
    return g.join(last, ["code", "operation", "_n"]).select(
        F.sha2(F.concat_ws("|", "code", "operation", F.col("first_seen_ms").cast("string")), 256).alias("incident_id"), "code", "operation", "severity", "count", "first_seen_ms", "last_seen_ms",
        "trace_ids", F.lit("open").alias("status"), F.concat_ws(" in ", F.try_element_at(names, F.col("code")), "operation").alias("title"),
    )


def auto_resolve(incidents: DataFrame, as_of_ms: int, after_ms: int = THRESHOLDS["auto_resolve_ms"]) -> DataFrame:
    old = (F.col("status") == "open") & (F.col("last_seen_ms") < as_of_ms - after_ms)
    return incidents.withColumn("status", F.when(old, "resolved").otherwise(F.col("status")))


def in_range(df: DataFrame, from_ms: int | None, to_ms: int | None, col: str = "start_ms") -> DataFrame:
    df = df if from_ms is None else df.where(F.col(col) >= from_ms)
    return df if to_ms is None else df.where(F.col(col) <= to_ms)


def code_rate(traces: DataFrame, findings: DataFrame, code: str, from_ms=None, to_ms=None) -> DataFrame:
    """with_code, total: one row."""
    hit = findings.where(F.col("code") == code).select("trace_id").distinct().withColumn("hit", F.lit(1))
    return in_range(traces, from_ms, to_ms).join(hit, "trace_id", "left").agg(F.count("hit").alias("with_code"), F.count("*").alias("total"))


def cohort_value(traces: DataFrame, key: str) -> Column:
    """A trace's value of a cohort key: a column, or looked up in attributes."""
    return (F.col(key) if key in traces.columns else F.try_element_at("attributes", F.lit(key))).cast("string")


def cohort_counts(traces: DataFrame, findings: DataFrame, code: str | None = None, keys=COHORT_KEYS, from_ms=None, to_ms=None) -> DataFrame:
    """code, key, value, with_code, total for every code (or one) and every key at once; traces without a value are left out. Keys that are no columns are looked up in attributes."""
    t = in_range(traces, from_ms, to_ms)
    v = t.select("trace_id", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), cohort_value(t, k).alias("value")) for k in keys])).alias("c")).select("trace_id", "c.*").where("value is not null")
    total = v.groupBy("key", "value").agg(F.count("*").alias("total"))
    f = findings if code is None else findings.where(F.col("code") == code)
    hits = v.join(f.select("trace_id", "code").distinct(), "trace_id").groupBy("code", "key", "value").agg(F.count("*").alias("with_code"))
    return hits.join(total, ["key", "value"]).select("code", "key", "value", "with_code", "total")


def cohort_lift(traces: DataFrame, findings: DataFrame, code: str | None = None, keys=COHORT_KEYS, th: dict | None = None, top: int = 5, from_ms=None, to_ms=None) -> DataFrame:
    """code, key, value, rate, base_rate, lift, samples of the cohorts in which a code is over-represented, the `top` best for each code."""
    th = th or THRESHOLDS
    t = in_range(traces, from_ms, to_ms)
    n = t.agg(F.count("*").alias("n"))
    f = findings if code is None else findings.where(F.col("code") == code)
    base = f.select("trace_id", "code").distinct().join(t.select("trace_id"), "trace_id", "left_semi").groupBy("code").agg(F.count("*").alias("hits")).crossJoin(F.broadcast(n)).select("code", (F.col("hits") / F.col("n")).alias("base_rate"), "n")
    base = base.where((F.col("n") >= th["cohort_min_samples"]) & (F.col("base_rate") > 0) & (F.col("base_rate") < 0.9))
    c = cohort_counts(traces, findings, code, keys, from_ms, to_ms).where(F.col("total") >= th["cohort_min_samples"]).join(base, "code")
    c = c.withColumn("rate", F.col("with_code") / F.col("total")).withColumn("lift", F.col("rate") / F.col("base_rate")).where(F.col("lift") >= th["cohort_lift"])
    w = Window.partitionBy("code").orderBy(F.desc("lift"), "key", "value")
    c = c.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top)
    said = F.format_string("%s is %.1f times as frequent where %s is %s", "code", "lift", "key", "value")
    return c.select("code", "key", "value", F.round("rate", 4).alias("rate"), F.round("base_rate", 4).alias("base_rate"), F.round("lift", 2).alias("lift"), F.col("total").alias("samples"), said.alias("hypothesis"))


def cube(df: DataFrame, keys, most: int, more: list[str], n: str) -> DataFrame:
    """cohort_keys (names with commas), keys, more, n: sums of n over each combination of up to `most` keys, by grouping sets; rows without a value of a key in a set are left out of it, and keys not in a set are null."""
    sets = [c for size in range(1, most + 1) for c in combinations(keys, size)]
    apart = [F.grouping(k).alias(f"_{k}") for k in keys]
    g = df.groupingSets([[*(F.col(k) for k in c), *(F.col(m) for m in more)] for c in sets], *keys, *more).agg(F.sum(n).alias(n), *apart)
    g = g.where(" and ".join(f"(`_{k}` = 1 or `{k}` is not null)" for k in keys))
    return g.select(F.concat_ws(",", *[F.when(F.col(f"_{k}") == 0, k) for k in keys]).alias("cohort_keys"), *keys, *more, n)


def cohort_cube(traces: DataFrame, findings: DataFrame, keys=COHORT_KEYS, most: int = 2, from_ms=None, to_ms=None) -> DataFrame:
    """cohort_keys, keys, code, with_code, total: traces with a code, and all, in each cohort of up to `most` keys at once.

    Traces are counted by all keys together before the grouping sets copy rows, so that what is copied is groups. A
    trace that has a code several times counts once; traces without a value of a key are in no cohort of that key.
    """
    # names that neither clash with other columns nor need quotes within the sets
    named = {k: f"key{i}" for i, k in enumerate(keys)}
    t = in_range(traces, from_ms, to_ms)
    t = t.select("trace_id", *[cohort_value(t, k).alias(c) for k, c in named.items()])
    cols = list(named.values())
    totals = cube(t.groupBy(*cols).agg(F.count("*").alias("total")), cols, most, [], "total")
    hits = t.join(findings.select("trace_id", "code").distinct(), "trace_id").groupBy(*cols, "code").agg(F.count("*").alias("with_code"))
    hits = cube(hits, cols, most, ["code"], "with_code")
    same = [hits["cohort_keys"] == totals["cohort_keys"], *[hits[c].eqNullSafe(totals[c]) for c in cols]]
    names = F.concat_ws(",", *[F.when(F.array_contains(F.split(hits["cohort_keys"], ","), c), k) for k, c in named.items()])
    return hits.join(totals, same).select(names.alias("cohort_keys"), *[hits[c].alias(k) for k, c in named.items()], "code", "with_code", "total")


def cohort_divergence(traces: DataFrame, findings: DataFrame, keys=COHORT_KEYS, most: int = 2, th: dict | None = None, from_ms=None, to_ms=None) -> DataFrame:
    """Cohorts whose mix of codes departs from that of the rest (ECO-006): cohort_keys, keys, samples, findings, js, top_code, lift, code.

    js is the Jensen-Shannon divergence, to base 2, of the cohort's shares of codes from the other cohorts' of the same
    keys; top_code is the one whose rate is the most over theirs, by lift. Cohorts without findings, those that are all
    there is of their keys, and those below the least number of samples or the least lift are left out. A code that only
    the cohort has counts in js, but has no lift.
    """
    th = th or THRESHOLDS
    c = cohort_cube(traces, findings, keys, most, from_ms, to_ms)
    # a row a cohort and code; what other cohorts of the keys have comes from sums over few codes and sets of keys
    codes = c.groupBy("cohort_keys", "code").agg(F.sum("with_code").alias("g"))
    sets = codes.groupBy("cohort_keys").agg(F.sum("g").alias("all_g"))
    t = in_range(traces, from_ms, to_ms)
    t = t.select(*[cohort_value(t, k).alias(f"key{i}") for i, k in enumerate(keys)])
    known = [F.col(f"key{i}").isNotNull() for i in range(len(keys))]
    chosen = [x for size in range(1, most + 1) for x in combinations(range(len(keys)), size)]
    have = F.array(*[F.struct(F.lit(",".join(keys[i] for i in x)).alias("cohort_keys"), reduce(and_, [known[i] for i in x]).alias("there")) for x in chosen])
    # which keys a trace has, counted before it is taken apart
    have = t.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(known)]).agg(F.count("*").alias("n"), F.first(have).alias("h")).select("n", F.explode("h").alias("h"))
    totals = have.where("h.there").groupBy("h.cohort_keys").agg(F.sum("n").alias("all_total"))
    of = ["cohort_keys", *keys]
    own = c.groupBy(*of).agg(F.sum("with_code").alias("findings"))
    a, b = c.alias("a"), own.alias("b")
    r = a.join(b, reduce(and_, [F.col(f"a.`{x}`").eqNullSafe(F.col(f"b.`{x}`")) for x in of])).select("a.*", "b.findings")
    r = r.join(codes, ["cohort_keys", "code"]).join(sets, "cohort_keys").join(totals, "cohort_keys").where((F.col("all_g") > F.col("findings")) & (F.col("all_total") > F.col("total")))
    p, q = F.col("with_code") / F.col("findings"), (F.col("g") - F.col("with_code")) / (F.col("all_g") - F.col("findings"))
    part = p * F.log2(2 * p / (p + q)) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0)
    lift = F.when(F.col("g") > F.col("with_code"), F.col("with_code") / F.col("total") / ((F.col("g") - F.col("with_code")) / (F.col("all_total") - F.col("total"))))
    r = r.withColumns({"part": part, "q": q, "lift": lift})
    # codes that the cohort lacks add all of their share among the others
    js = F.greatest(F.lit(0.0), (F.sum("part") + 1 - F.sum("q")) / 2)
    g = r.groupBy(*of).agg(F.first("total").alias("samples"), F.first("findings").alias("findings"), js.alias("js"), F.max_by("code", F.when(F.col("lift").isNotNull(), F.struct("lift", "code"))).alias("top_code"), F.max("lift").alias("lift"))
    g = g.where((F.col("samples") >= th["cohort_min_samples"]) & (F.col("js") > 0) & (F.col("lift") >= th["cohort_lift"]))
    return g.select(*of, "samples", "findings", F.round("js", 6).alias("js"), "top_code", F.round("lift", 4).alias("lift"), F.lit("ECO-006").alias("code"))


def alerts_to_send(incidents: DataFrame, alerted: DataFrame, severities=("high", "critical")) -> DataFrame:
    """incident_id, payload of incidents severe enough that no alert has been sent for; the payload holds no content."""
    new = incidents.where(F.col("severity").isin(*severities)).join(alerted.select("incident_id"), "incident_id", "left_anti")
    return new.select("incident_id", F.to_json(F.struct("incident_id", "code", "operation", "severity", "count", "first_seen_ms", "last_seen_ms")).alias("payload"))


def failure_bursts(findings: DataFrame, traces: DataFrame, th: dict | None = None, hours: int = 24) -> DataFrame:
    """code, hour_ms, rate, trailing: hours whose rate of a code is several times its mean over the hours before (extension)."""
    th = th or THRESHOLDS
    hour = F.floor(F.col("start_ms") / 3_600_000) * 3_600_000
    total = traces.groupBy(hour.alias("hour_ms")).agg(F.count("*").alias("total"))
    hits = findings.select("trace_id", "code").distinct().join(traces.select("trace_id", hour.alias("hour_ms")), "trace_id").groupBy("code", "hour_ms").agg(F.count("*").alias("n"))
    r = hits.join(total, "hour_ms").withColumn("rate", F.col("n") / F.col("total"))
    w = Window.partitionBy("code").orderBy("hour_ms").rangeBetween(-hours * 3_600_000, -1)
    return r.withColumn("trailing", F.avg("rate").over(w)).where(F.col("rate") >= th["burst_rate_ratio"] * F.col("trailing")).select("code", "hour_ms", F.round("rate", 6).alias("rate"), F.round("trailing", 6).alias("trailing"))
