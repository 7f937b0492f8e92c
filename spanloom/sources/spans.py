"""Reading spans in several shapes and checking them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KINDS, LLM, RETRIEVAL, SESSION_KEY, SPAN, STATUSES, TOOL
from .bundle import read_bundle, write_bundle  # noqa: F401 - part of this module's API

MOST_DOCUMENTS, MOST_MESSAGES, MOST_EVENTS, MOST_TOOLS = 1000, 2000, 1000, 500
MESSAGES = "array<struct<role:string,content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>>"
#: Fixed values of the GenAI convention.
OPERATION_KINDS = {"chat": "llm", "generate_content": "llm", "text_completion": "llm", "embeddings": "embedding", "retrieval": "retriever", "execute_tool": "tool", "invoke_agent": "agent", "create_agent": "agent", "invoke_workflow": "chain"}
MAPPED_KEYS = (
    "gen_ai.provider.name", "gen_ai.system", "gen_ai.request.model", "gen_ai.response.model", "gen_ai.usage.input_tokens", "gen_ai.usage.output_tokens",
    "gen_ai.usage.cache_read.input_tokens", "gen_ai.usage.cache_creation.input_tokens", "gen_ai.usage.reasoning.output_tokens", "gen_ai.response.finish_reasons",
    "gen_ai.request.temperature", "gen_ai.request.max_tokens", "gen_ai.operation.name", "gen_ai.tool.name", "gen_ai.tool.type", "gen_ai.tool.call.id",
    "gen_ai.conversation.id", "gen_ai.agent.name", "gen_ai.agent.id",
)


def read_spans(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Native spans with a fixed schema, and of JSON lines _file and _at: the file and the row's place in the part of it that a task reads (in files of one part the line, from 0). A record that can't be read is a row with nothing else but _corrupt."""
    if fmt == "json":
        raw = spark.read.schema(SPAN + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
        # the lower 33 bits number the rows of a task
        return raw.withColumns({"_file": F.input_file_name(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    return spark.read.schema(SPAN).format(fmt).load(path)


def reject_report(rejects: DataFrame, most: int = 20) -> DataFrame:
    """file, index, message of the first `most` rejects of validate_spans(), by file and place."""
    return rejects.orderBy("_file", "_at").limit(most).select(F.col("_file").alias("file"), F.col("_at").alias("index"), F.col("reason").alias("message"))


def read_span_stream(spark: SparkSession, path: str, fmt: str = "json", files: int = 100) -> DataFrame:
    return spark.readStream.schema(SPAN).option("maxFilesPerTrigger", files).format(fmt).load(path)


def violations(df: DataFrame) -> Column:
    def length(c: str, low: int, high: int) -> Column:
        n = F.length(c)
        return F.when(F.col(c).isNull() | (n < low) | (n > high), F.lit(f"{c}: must have {low} to {high} characters"))

    def at_most(c: str, n: int) -> Column:
        return F.when(F.size(c) > n, F.lit(f"{c}: more than {n} items"))

    checks = [
        length("span_id", 1, 64), length("trace_id", 1, 64), length("name", 0, 256), F.when(F.length("parent_span_id") > 64, F.lit("parent_span_id: too long")), F.when(F.length("status_message") > 2000, F.lit("status_message: too long")),
        F.when(~F.col("kind").isin(*KINDS) | F.col("kind").isNull(), F.lit("kind: unknown")), F.when(~F.col("status").isin(*STATUSES) | F.col("status").isNull(), F.lit("status: unknown")),
        F.when(F.col("start_ms").isNull() | (F.col("start_ms") < 0), F.lit("start_ms: must be a number from 0")), F.when(F.col("end_ms").isNull() | (F.col("end_ms") < 0), F.lit("end_ms: must be a number from 0")), F.when(F.col("duration_ms") < 0, F.lit("duration_ms: negative")),
        F.when(F.col("llm.input_tokens") < 0, F.lit("llm.input_tokens: negative")), F.when(F.col("llm.output_tokens") < 0, F.lit("llm.output_tokens: negative")),
        at_most("retrieval.documents", MOST_DOCUMENTS), at_most("llm.input_messages", MOST_MESSAGES), at_most("llm.output_messages", MOST_MESSAGES), at_most("events", MOST_EVENTS), at_most("tool.available_tools", MOST_TOOLS),
    ]
    return F.slice(F.array_compact(F.array(*checks)), 1, 5)


def validate_spans(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The spans that keep all rules, and the others with reason (the first five violations)."""
    v = df.withColumn("_v", violations(df))
    corrupt = F.col("_corrupt").isNotNull() if "_corrupt" in df.columns else F.lit(False)
    good = v.where((F.size("_v") == 0) & ~corrupt).drop("_v", "_corrupt", "_file", "_at")
    bad = v.where((F.size("_v") > 0) | corrupt).withColumn("reason", F.when(corrupt, F.lit("not readable")).otherwise(F.array_join("_v", "; "))).drop("_v")
    return good, bad


def to_ms(value: Column) -> Column:
    """Milliseconds from a number of milliseconds or (above 1e14) nanoseconds, as number or text, or an ISO time."""
    n = value.try_cast("double")
    return F.coalesce(F.when(n > 1e14, F.floor(n / 1_000_000)).otherwise(n).cast("long"), F.unix_millis(F.try_to_timestamp(value)))


def otel_status(code: Column) -> Column:
    return F.when(code.isin("2", "ERROR", "STATUS_CODE_ERROR"), "error").when(code.isin("1", "OK", "STATUS_CODE_OK"), "ok").otherwise("unset")


def parsed_messages(text: Column) -> Column:
    """Messages from a JSON array of {role, content} or {role, parts:[{content}]}; unknown roles are users, empty ones go, and what is no such array gives none."""
    raw = F.from_json(text, "array<struct<role:string,content:string,parts:array<struct<content:string>>>>")
    role = lambda m: F.when(m["role"].isin("system", "user", "assistant", "tool"), m["role"]).otherwise("user")
    body = lambda m: F.coalesce(m["content"], F.array_join(F.transform(m["parts"], lambda p: p["content"]), "\n"))
    made = F.transform(F.coalesce(raw, F.array().cast("array<struct<role:string,content:string,parts:array<struct<content:string>>>>")), lambda m: F.struct(role(m).alias("role"), body(m).alias("content"), F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>").alias("tool_calls")))
    return F.filter(made, lambda m: F.coalesce(F.length(m["content"]), F.lit(0)) > 0).cast(MESSAGES)


def event_messages(events: Column, roles: dict[str, str]) -> Column:
    """Messages from span events named in roles; the body is content, message or body."""
    role = lambda e: F.element_at(F.create_map(*[F.lit(x) for kv in roles.items() for x in kv]), e["name"])
    body = lambda e: F.coalesce(*[F.try_element_at(e["attributes"], F.lit(k)) for k in ("content", "message", "body")])
    own = F.filter(events, lambda e: e["name"].isin(*roles) & (F.coalesce(F.length(body(e)), F.lit(0)) > 0))
    return F.transform(own, lambda e: F.struct(role(e).alias("role"), body(e).alias("content"), F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>").alias("tool_calls"))).cast(MESSAGES)


def otel_messages(attributes: Column, events: Column) -> tuple[Column, Column]:
    """Input and output messages: those in attributes, then those in events."""
    at = lambda k: F.try_element_at(attributes, F.lit(k))
    events = F.coalesce(events, F.array().cast("array<struct<name:string,timestamp_ms:bigint,attributes:map<string,string>>>"))
    given = F.concat(parsed_messages(at("gen_ai.input.messages")), event_messages(events, {"gen_ai.user.message": "user", "gen_ai.system.message": "system", "gen_ai.tool.message": "tool"}))
    made = F.concat(parsed_messages(at("gen_ai.output.messages")), event_messages(events, {"gen_ai.choice": "assistant", "gen_ai.assistant.message": "assistant"}))
    return given, made


def finish(df: DataFrame) -> DataFrame:
    """df with all columns of a span, in order."""
    missing = df.sparkSession.createDataFrame([], SPAN).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in missing.fields])


def normalise_otel(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans from GenAI records (trace_id, span_id, parent_span_id, name, start, end, status_code, status_message, attributes map, events), and the records without usable times."""
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    whole = lambda k: at(k).try_cast("double").cast("long")
    operation = at("gen_ai.operation.name")
    kinds = F.create_map(*[F.lit(x) for kv in OPERATION_KINDS.items() for x in kv])
    given, made = otel_messages(F.col("attributes"), F.col("events"))
    provider = F.coalesce(at("gen_ai.provider.name"), at("gen_ai.system"))
    reasons = at("gen_ai.response.finish_reasons")
    first_reason = F.coalesce(F.get(F.from_json(reasons, "array<string>"), F.lit(0)), reasons)
    null = lambda t: F.lit(None).cast(t)
    is_llm = provider.isNotNull() | at("gen_ai.request.model").isNotNull() | whole("gen_ai.usage.input_tokens").isNotNull() | whole("gen_ai.usage.output_tokens").isNotNull() | at("gen_ai.system_instructions").isNotNull() | (F.size("_in") > 0) | (F.size("_out") > 0)
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    llm = F.struct(
        provider.alias("provider"), at("gen_ai.request.model").alias("request_model"), at("gen_ai.response.model").alias("response_model"), whole("gen_ai.usage.input_tokens").alias("input_tokens"), whole("gen_ai.usage.output_tokens").alias("output_tokens"),
        whole("gen_ai.usage.cache_read.input_tokens").alias("cache_read_tokens"), whole("gen_ai.usage.cache_creation.input_tokens").alias("cache_creation_tokens"), whole("gen_ai.usage.reasoning.output_tokens").alias("reasoning_tokens"), first_reason.alias("finish_reason"),
        at("gen_ai.request.temperature").try_cast("double").alias("temperature"), whole("gen_ai.request.max_tokens").alias("max_tokens"), null("bigint").alias("context_limit"), at("gen_ai.system_instructions").alias("system_instructions"),
        F.when(F.size("_in") > 0, F.size("_in").cast("long")).alias("input_message_count"), some("_in").alias("input_messages"), some("_out").alias("output_messages"), null("string").alias("reasoning_text"), null("double").alias("cost_usd"),
    )
    tool = F.struct(at("gen_ai.tool.name").alias("tool_name"), at("gen_ai.tool.type").alias("tool_type"), *[null(t).alias(n) for n, t in (("arguments", "string"), ("result", "string"), ("error", "string"), ("attempt", "int"), ("mutating", "boolean"), ("privileged", "boolean"), ("parameter_schema", "string"), ("available_tools", "array<string>"))])
    passed = F.transform_values(F.map_filter("attributes", lambda k, _v: ~k.isin(*MAPPED_KEYS)), lambda _k, v: F.left(v, F.lit(2000)))
    session = at("gen_ai.conversation.id")
    d = df.withColumn("_in", given).withColumn("_out", made).withColumn("_s", to_ms(F.col("start"))).withColumn("_e", to_ms(F.col("end")))
    good = d.where("_s is not null and _e is not null").select(
        "span_id", "trace_id", "parent_span_id", F.coalesce("name", operation, F.lit("otel-span")).alias("name"), F.coalesce(F.try_element_at(kinds, operation), F.lit("unknown")).alias("kind"), F.col("_s").alias("start_ms"), F.col("_e").alias("end_ms"),
        F.greatest(F.lit(0), F.col("_e") - F.col("_s")).cast("double").alias("duration_ms"), otel_status(F.col("status_code").cast("string")).alias("status"), "status_message",
        F.when(session.isNull(), passed).otherwise(F.map_concat(passed, F.create_map(F.lit(SESSION_KEY), session))).alias("attributes"), "events", F.when(is_llm, llm).cast(LLM).alias("llm"), F.when(at("gen_ai.tool.name").isNotNull(), tool).cast(TOOL).alias("tool"), session.alias("session_id"),
    )
    return finish(good), d.where("_s is null or _e is null").drop("_in", "_out", "_s", "_e")


def normalise_openinference(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans from OpenInference records (ids, name, start, end, status_code, status_message, attributes map), and the records without usable times. Retrieved documents are those of the indexed keys up to the first gap."""
    at = lambda k: F.try_element_at("attributes", F.lit(k) if isinstance(k, str) else k)
    whole = lambda k: at(k).try_cast("double").cast("long")
    declared = F.lower(at("openinference.span.kind"))
    key = lambda i, f: F.concat(F.lit("retrieval.documents."), i.cast("string"), F.lit(f".document.{f}"))
    there = lambda i: at(key(i, "content")).isNotNull() | at(key(i, "id")).isNotNull() | at(key(i, "score")).isNotNull()
    gap = F.coalesce(F.get(F.filter(F.sequence(F.lit(0), F.lit(99)), lambda i: ~there(i)), F.lit(0)), F.lit(100))
    doc = lambda i: F.struct(F.coalesce(at(key(i, "id")), F.concat(F.lit("doc-"), i.cast("string"))).alias("id"), at(key(i, "score")).try_cast("double").alias("score"), at(key(i, "content")).alias("content"), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(None).cast("long").alias("timestamp_ms"))
    docs = F.when(F.col("_n") > 0, F.transform(F.sequence(F.lit(0), F.col("_n") - 1), doc))
    message = lambda k, role: F.when(at(k).isNotNull() & F.col("_llm"), F.array(F.struct(F.lit(role).alias("role"), at(k).alias("content"), F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>").alias("tool_calls"))))
    null = lambda t: F.lit(None).cast(t)
    llm = F.struct(
        at("llm.provider").alias("provider"), at("llm.model_name").alias("request_model"), null("string").alias("response_model"), whole("llm.token_count.prompt").alias("input_tokens"), whole("llm.token_count.completion").alias("output_tokens"),
        null("bigint").alias("cache_read_tokens"), null("bigint").alias("cache_creation_tokens"), null("bigint").alias("reasoning_tokens"), null("string").alias("finish_reason"), null("double").alias("temperature"), null("bigint").alias("max_tokens"), null("bigint").alias("context_limit"),
        null("string").alias("system_instructions"), F.when(at("input.value").isNotNull(), F.lit(1).cast("long")).alias("input_message_count"), message("input.value", "user").alias("input_messages"), message("output.value", "assistant").alias("output_messages"), null("string").alias("reasoning_text"), null("double").alias("cost_usd"),
    )
    retrieval = F.struct(at("input.value").alias("query"), null("string").alias("index_name"), null("int").alias("top_k"), null("double").alias("score_threshold"), F.col("_docs").alias("documents"))
    tool = F.struct(F.coalesce(at("tool.name"), F.col("name")).alias("tool_name"), null("string").alias("tool_type"), at("input.value").alias("arguments"), at("output.value").alias("result"), *[null(t).alias(n) for n, t in (("error", "string"), ("attempt", "int"), ("mutating", "boolean"), ("privileged", "boolean"), ("parameter_schema", "string"), ("available_tools", "array<string>"))])
    passed = F.map_filter("attributes", lambda k, _v: ~k.rlike(r"^(openinference\.|llm\.|retrieval\.documents\.|input\.|output\.|tool\.)"))
    kind = F.when(declared.isin(*KINDS), declared).otherwise("unknown")
    d = df.withColumn("_s", to_ms(F.col("start"))).withColumn("_e", to_ms(F.col("end"))).withColumn("_n", gap).withColumn("_docs", docs).withColumn("_kind", kind).withColumn("_llm", F.col("_kind") == "llm")
    good = d.where("_s is not null and _e is not null").select(
        "span_id", "trace_id", "parent_span_id", F.coalesce("name", F.lit("span")).alias("name"), F.col("_kind").alias("kind"), F.col("_s").alias("start_ms"), F.col("_e").alias("end_ms"), F.greatest(F.lit(0), F.col("_e") - F.col("_s")).cast("double").alias("duration_ms"),
        otel_status(F.col("status_code").cast("string")).alias("status"), "status_message", passed.alias("attributes"), F.when(F.col("_llm"), llm).cast(LLM).alias("llm"), F.when((F.col("_kind") == "retriever") | (F.col("_n") > 0), retrieval).cast(RETRIEVAL).alias("retrieval"), F.when(F.col("_kind") == "tool", tool).cast(TOOL).alias("tool"), at("session.id").alias("session_id"),
    )
    return finish(good), d.where("_s is null or _e is null").drop("_s", "_e", "_n", "_docs", "_kind", "_llm")


def normalise_responses(df: DataFrame, provider: str, body: str = "response") -> DataFrame:
    """df with llm: the payload in a provider's raw response (anthropic or openai) as JSON."""
    null = lambda t: F.lit(None).cast(t)
    if provider == "anthropic":
        r = F.from_json(body, "struct<model:string,stop_reason:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>,content:array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string>>>")
        text = F.array_join(F.transform(F.filter(r["content"], lambda b: b["type"] == "text"), lambda b: b["text"]), "")
        thought = F.array_join(F.transform(F.filter(r["content"], lambda b: b["type"] == "thinking"), lambda b: b["thinking"]), "\n")
        calls = F.transform(F.filter(r["content"], lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name"), b["input"].alias("arguments")))
        u, model, stop, thoughts = r["usage"], r["model"], r["stop_reason"], F.when(F.length(thought) > 0, thought)
        n_in, n_out, read, made, reasoned = u["input_tokens"], u["output_tokens"], u["cache_read_input_tokens"], u["cache_creation_input_tokens"], null("bigint")
    elif provider == "openai":
        r = F.from_json(body, "struct<model:string,usage:struct<prompt_tokens:bigint,completion_tokens:bigint,prompt_tokens_details:struct<cached_tokens:bigint>,completion_tokens_details:struct<reasoning_tokens:bigint>>,choices:array<struct<finish_reason:string,message:struct<content:string,tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>>>>")
        c = F.get(r["choices"], F.lit(0))
        text, thoughts = F.coalesce(c["message"]["content"], F.lit("")), null("string")
        calls = F.transform(c["message"]["tool_calls"], lambda t: F.struct(t["id"].alias("id"), t["function"]["name"].alias("name"), t["function"]["arguments"].alias("arguments")))
        u, model, stop = r["usage"], r["model"], c["finish_reason"]
        n_in, n_out, read, made, reasoned = u["prompt_tokens"], u["completion_tokens"], u["prompt_tokens_details"]["cached_tokens"], null("bigint"), u["completion_tokens_details"]["reasoning_tokens"]
    else:
        raise ValueError(f"no such provider: {provider}")
    said = F.array(F.struct(F.lit("assistant").alias("role"), text.alias("content"), F.when(F.size(calls) > 0, calls).alias("tool_calls")))
    llm = F.struct(
        F.lit(provider).alias("provider"), null("string").alias("request_model"), model.alias("response_model"), n_in.alias("input_tokens"), n_out.alias("output_tokens"), read.alias("cache_read_tokens"), made.alias("cache_creation_tokens"), reasoned.alias("reasoning_tokens"), stop.alias("finish_reason"),
        null("double").alias("temperature"), null("bigint").alias("max_tokens"), null("bigint").alias("context_limit"), null("string").alias("system_instructions"), null("bigint").alias("input_message_count"), null(MESSAGES).alias("input_messages"), said.cast(MESSAGES).alias("output_messages"), thoughts.alias("reasoning_text"), null("double").alias("cost_usd"),
    )
    return df.withColumn("llm", F.when(r.isNotNull() & model.isNotNull(), llm.cast(LLM)))
