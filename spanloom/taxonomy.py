"""The failure taxonomy: modes, default severities, tiers and causal edges, and their closure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.1.0"
#: Code, name, default severity, tier, codes it causes, observed frequency.
MODES = (
    ("INF-001", "Provider API error", "high", "L0", ("GEN-007", "AGT-007"), None),
    ("INF-002", "Provider timeout", "high", "L0", ("AGT-007", "TOL-004"), None),
    ("INF-003", "Rate limit exhaustion", "high", "L0", ("TOL-004", "ECO-002"), None),
    ("INF-004", "Authentication failure", "critical", "L0", (), None),
    ("INF-005", "Latency outlier", "medium", "L2", ("INF-002",), None),
    ("INF-006", "Detector execution failure", "low", "L0", (), None),
    ("CTX-001", "Context window overflow", "high", "L0", ("CTX-002", "RET-003", "GEN-003"), None),
    ("CTX-002", "Context truncation", "high", "L1", ("GEN-003", "GEN-001", "RET-003"), None),
    ("CTX-003", "Conversation history loss", "high", "L1", ("AGT-003", "AGT-009", "GEN-001"), 0.0333),
    ("CTX-004", "Conversation reset", "medium", "L1", ("AGT-003", "CTX-003"), 0.0233),
    ("CTX-005", "Malformed input", "medium", "L1", ("GEN-007", "SEC-001"), None),
    ("RET-001", "Zero retrieval hits", "high", "L0", ("GEN-004", "GEN-001", "GEN-008"), None),
    ("RET-002", "Retrieval quality collapse", "high", "L2", ("GEN-004", "GEN-001", "GEN-002"), None),
    ("RET-003", "Consolidation loss", "high", "L1", ("GEN-001", "GEN-003", "GEN-004"), None),
    ("RET-004", "Retrieval latency degradation", "medium", "L2", ("INF-002",), None),
    ("RET-005", "Redundant retrieval", "low", "L1", ("CTX-001", "RET-003"), None),
    ("RET-006", "Index staleness", "medium", "L1", ("GEN-004",), None),
    ("RET-007", "Embedding space weakness", "medium", "L2", ("RET-002",), None),
    ("GEN-001", "Answer not extracted", "high", "L3", ("GEN-003", "GEN-008"), None),
    ("GEN-002", "Incorrect specificity", "medium", "L3", (), None),
    ("GEN-003", "Incomplete answer", "high", "L1", ("GEN-008",), None),
    ("GEN-004", "Ungrounded claim", "critical", "L1", ("GEN-008", "SEC-005"), None),
    ("GEN-005", "Schema violation", "high", "L1", ("TOL-003", "INF-001"), None),
    ("GEN-006", "Output truncated", "high", "L0", ("GEN-003", "GEN-005"), None),
    ("GEN-007", "Degenerate output", "high", "L1", ("GEN-003",), None),
    ("GEN-008", "Unexpected refusal", "medium", "L1", (), None),
    ("AGT-001", "Disobey task specification", "high", "L3", ("AGT-004", "GEN-002"), 0.1098),
    ("AGT-002", "Disobey role specification", "medium", "L3", ("AGT-004", "TOL-005"), 0.005),
    ("AGT-003", "Step repetition", "high", "L0", ("ECO-002", "AGT-005", "INF-002"), 0.1714),
    ("AGT-004", "Task derailment", "high", "L3", ("AGT-007", "ECO-002"), 0.0715),
    ("AGT-005", "Unaware of termination conditions", "high", "L0", ("ECO-001", "ECO-002", "AGT-003"), 0.0982),
    ("AGT-006", "Reasoning-action mismatch", "high", "L1", ("AGT-004", "AGT-007", "GEN-004"), 0.1398),
    ("AGT-007", "Premature termination", "high", "L0", ("GEN-003", "AGT-008"), 0.0782),
    ("AGT-008", "No or incomplete verification", "high", "L0", ("AGT-012", "GEN-004"), 0.0682),
    ("AGT-009", "Fail to ask for clarification", "medium", "L1", ("AGT-001", "GEN-002", "GEN-004"), 0.1165),
    ("AGT-010", "Information withholding", "medium", "L3", ("AGT-011", "AGT-012"), 0.0166),
    ("AGT-011", "Ignored peer input", "low", "L3", ("AGT-004",), 0.0017),
    ("AGT-012", "Incorrect verification", "high", "L3", ("GEN-004",), 0.0666),
    ("TOL-001", "Unknown tool invoked", "high", "L0", ("AGT-003", "GEN-005"), None),
    ("TOL-002", "Tool execution error", "high", "L0", ("AGT-003", "TOL-004", "GEN-004"), None),
    ("TOL-003", "Tool argument validation failure", "medium", "L1", ("TOL-002", "AGT-003"), None),
    ("TOL-004", "Retry storm", "critical", "L0", ("ECO-002", "INF-003"), None),
    ("TOL-005", "Excessive agency", "critical", "L0", ("SEC-005", "AGT-002"), None),
    ("TOL-006", "Tool latency degradation", "medium", "L2", ("INF-002", "TOL-004"), None),
    ("SEC-001", "Direct prompt injection", "critical", "L1", ("SEC-004", "SEC-005", "TOL-005"), None),
    ("SEC-002", "Indirect prompt injection", "critical", "L1", ("SEC-004", "SEC-005", "TOL-005"), None),
    ("SEC-003", "Sensitive information disclosure", "critical", "L1", ("SEC-005",), None),
    ("SEC-004", "System prompt leakage", "high", "L1", ("SEC-005",), None),
    ("SEC-005", "Unsafe output", "critical", "L3", (), None),
    ("SEC-006", "Guardrail bypass", "critical", "L0", ("SEC-005", "SEC-003"), None),
    ("SEC-007", "Injection-consequent action", "critical", "L1", ("SEC-003", "SEC-005", "TOL-005"), None),
    ("ECO-001", "Token budget exceeded", "high", "L0", ("ECO-002",), None),
    ("ECO-002", "Cost spike", "high", "L2", ("ECO-001",), None),
    ("ECO-003", "Feature drift", "medium", "L2", (), None),
    ("ECO-004", "Failure rate burst", "high", "L2", (), None),
    ("ECO-005", "Cache inefficiency", "low", "L1", ("ECO-002",), None),
    ("ECO-006", "Cohort divergence", "medium", "L2", ("ECO-004",), None),
)
#: Hops that a cause can be away.
MAX_HOPS = 4

SEVERITY_OF = {code: severity for code, _n, severity, *_ in MODES}


def taxonomy(spark: SparkSession) -> DataFrame:
    """code, name, family, severity, tier, frequency: one row a mode."""
    rows = [(c, n, c[:3], s, t, f) for c, n, s, t, _e, f in MODES]
    return spark.createDataFrame(rows, "code string, name string, family string, severity string, tier string, frequency double")


def mode(spark: SparkSession, code: str) -> DataFrame:
    return taxonomy(spark).where(F.col("code") == code)


def family(spark: SparkSession, name: str) -> DataFrame:
    return taxonomy(spark).where(F.col("family") == name).orderBy("code")


def by_frequency(spark: SparkSession) -> DataFrame:
    """Modes with an observed frequency, the most frequent first."""
    return taxonomy(spark).where("frequency is not null").orderBy(F.desc("frequency"), "code")


def edges(spark: SparkSession) -> DataFrame:
    """cause, effect: the direct causal edges."""
    return spark.createDataFrame([(c, e) for c, _n, _s, _t, causes, _f in MODES for e in causes], "cause string, effect string")


def causal_closure(links: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """cause, effect, distance: the shortest number of edges from cause to another code, up to hops; a self-join a hop, each reduced at once."""
    reach = links.select("cause", "effect", F.lit(1).alias("distance")).distinct()
    step = links.select(F.col("cause").alias("mid"), F.col("effect").alias("next")).distinct()
    last = reach
    for d in range(2, hops + 1):
        last = last.join(step, last["effect"] == step["mid"]).select("cause", F.col("next").alias("effect"), F.lit(d).alias("distance")).distinct()
        reach = reach.unionByName(last)
    return reach.where("cause <> effect").groupBy("cause", "effect").agg(F.min("distance").alias("distance"))
