"""Schemas of spans, findings and what is derived from them."""

MESSAGE = "role:string,content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>"
LLM = (
    "struct<provider:string,request_model:string,response_model:string,input_tokens:bigint,output_tokens:bigint,"
    "cache_read_tokens:bigint,cache_creation_tokens:bigint,reasoning_tokens:bigint,finish_reason:string,temperature:double,"
    "max_tokens:bigint,context_limit:bigint,system_instructions:string,input_message_count:bigint,"
    f"input_messages:array<struct<{MESSAGE}>>,output_messages:array<struct<{MESSAGE}>>,reasoning_text:string,cost_usd:double>"
)
DOCUMENT = "struct<id:string,score:double,content:string,metadata:map<string,string>,timestamp_ms:bigint>"
RETRIEVAL = f"struct<query:string,index_name:string,top_k:int,score_threshold:double,documents:array<{DOCUMENT}>>"
TOOL = (
    "struct<tool_name:string,tool_type:string,arguments:string,result:string,error:string,attempt:int,mutating:boolean,"
    "privileged:boolean,parameter_schema:string,available_tools:array<string>>"
)
AGENT = (
    "struct<agent_name:string,agent_role:string,objective:string,iteration:int,max_iterations:int,declared_subtasks:array<string>,"
    "completed_subtasks:array<string>,terminated:boolean,reasoning_text:string>"
)
EVENT = "struct<name:string,timestamp_ms:bigint,attributes:map<string,string>>"
SPAN = (
    "span_id string, trace_id string, parent_span_id string, name string, kind string, start_ms bigint, end_ms bigint, "
    "duration_ms double, status string, status_message string, attributes map<string,string>, "
    f"events array<{EVENT}>, llm {LLM}, retrieval {RETRIEVAL}, tool {TOOL}, agent {AGENT}, "
    "service string, environment string, session_id string, received_ms bigint"
)
EVIDENCE = "array<struct<label:string,value:string>>"
FINDING = (
    "finding_id string, trace_id string, span_id string, code string, family string, severity string, confidence double, "
    f"detector_id string, tier string, title string, evidence {EVIDENCE}, ordinal int"
)

#: Fixed values of the data model.
KINDS = ("llm", "embedding", "chain", "retriever", "reranker", "tool", "agent", "guardrail", "evaluator", "prompt", "unknown")
STATUSES = ("ok", "error", "unset")
SESSION_KEY = "session_id"
SEVERITIES_ORDER = ("info", "low", "medium", "high", "critical")

#: Thresholds; every operator takes a changed copy.
THRESHOLDS = {
    "context_utilisation_warn": 0.9,
    "step_repetition_count": 3,
    "step_repetition_similarity": 0.9,
    "retry_storm_attempts": 3,
    "excessive_tool_calls": 25,
    "token_budget_per_trace": 150_000,
    "groundedness_support": 0.15,
    "unsupported_ratio": 0.3,
    "repetition_ratio": 0.35,
    "duplicate_retrieval_ratio": 0.4,
    "duplicate_similarity": 0.8,
    "index_staleness_days": 180,
    "system_prompt_leak_chars": 60,
    "cache_hit_ratio_floor": 0.2,
    "min_cached_prompt_tokens": 4000,
    "history_loss_messages": 2,
    "reset_min_prior_messages": 3,
    "z_score": 3.0,
    "retrieval_score_z": 3.0,
    "psi_significant": 0.25,
    "burst_rate_ratio": 3.0,
    "cohort_lift": 2.0,
    "cohort_min_samples": 20,
    "score_entropy_floor": 0.95,
    "min_baseline_samples": 30,
    "short_circuit_confidence": 0.8,
    "incident_window_ms": 6 * 3_600_000,
    "auto_resolve_ms": 24 * 3_600_000,
    "drift_bucket_ms": 6 * 3_600_000,
    "max_age_days": 30,
}


def thresholds(**changed) -> dict:
    unknown = set(changed) - set(THRESHOLDS)
    if unknown:
        raise ValueError(f"unknown thresholds: {sorted(unknown)}")
    return THRESHOLDS | changed
