"""Redaction of sensitive classes in text, and counts of them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ascii_bounds, let

#: Class, pattern, replacement, whether it is on unless asked for. They apply in this order.
PATTERNS = (
    ("api_key", r"\b(sk-ant-[A-Za-z0-9_-]{20,}|sk-[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,})\b", "[REDACTED:api_key]", True),
    ("aws_key", r"\b((?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{16})\b", "[REDACTED:aws_key]", True),
    ("connection_string", r"(?i)\b([a-z][a-z0-9+.-]*://)([^\s:@/]+):([^\s@/]+)@", "$1$2:[REDACTED:connection_string]@", True),
    ("bearer_token", r"\b[Bb]earer\s+[A-Za-z0-9._~+/-]{16,}={0,2}", "Bearer [REDACTED:bearer_token]", True),
    ("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----", "[REDACTED:private_key]", True),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", "[REDACTED:jwt]", True),
    ("email", r"\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,24}\b", "[REDACTED:email]", True),
    ("credit_card", r"\b(?:\d[ -]?){13,19}\b", "[REDACTED:credit_card]", True),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED:ssn]", True),
    ("phone", r"\+\d{1,3}[ -]?\(?\d{2,4}\)?[ -]?\d{3,4}[ -]?\d{3,4}\b", "[REDACTED:phone]", True),
    ("ipv4", r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b", "[REDACTED:ipv4]", False),
)
#: What a match begins with, where that is always a part of a word.
STARTS = {"api_key": "[sx]", "aws_key": "A", "connection_string": "[a-z]", "bearer_token": "[Bb]", "jwt": "e", "credit_card": r"\d", "ssn": r"\d"}


def _spelt_out(name: str, pattern: str) -> str:
    """The pattern with bounds of ASCII words spelt out, and those that it begins with so that most places are left after one character."""
    if name in STARTS:
        pattern = pattern.replace(r"\b", rf"(?={STARTS[name]})(?<!\w)", 1)
    if name == "email":
        # no '@' is among the characters before it, so that fewer of them never help
        pattern = pattern.replace(r"\b[A-Za-z0-9._%+-]{1,64}@", r"(?:(?<!\w)(?=\w)|(?<=\w)(?=[.%+-]))[\w.%+-]{1,64}+@")
    return ascii_bounds(pattern)


_RULES = tuple((name, _spelt_out(name, pattern), replacement, on) for name, pattern, replacement, on in PATTERNS)
#: What any match of a class holds, found at a fraction of the pattern's cost: texts without it aren't searched. Literals (one of them), or a pattern without bounds.
NEEDED = {
    "api_key": ("sk-", "xox"), "aws_key": ("AKIA", "ASIA", "AIDA", "AROA"), "connection_string": ("://",), "bearer_token": ("earer",), "private_key": ("-----BEGIN ",), "jwt": ("eyJ",), "email": ("@",),
    "credit_card": r"\d(?:[ -]?\d){12}", "ssn": r"\d{3}-\d{2}-\d{4}", "phone": ("+",), "ipv4": r"\d\.\d",
}
DEFAULT = tuple(name for name, _p, _r, on in PATTERNS if on)
#: Characters of a text that the reference searches, keeping the rest as it is. It holds only where it is given as `limit`; else texts are searched whole.
SCAN_LIMIT = 200_000
#: Levels down to which the reference redacts nested values. It holds only where it is given as `depth`.
DEPTH = 8


def luhn_valid(text: Column) -> Column:
    """13 to 19 digits, without separators, whose check digit is right."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _cards(text: Column, pattern: str) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), luhn_valid)


def _may_have(text: Column, name: str) -> Column:
    """Whether a match of the class is possible."""
    needed = NEEDED[name]
    return text.rlike(needed) if isinstance(needed, str) else reduce(or_, [F.contains(text, F.lit(x)) for x in needed])


def _count(text: Column, name: str, pattern: str) -> Column:
    count = F.size(_cards(text, pattern)) if name == "credit_card" else F.regexp_count(text, F.lit(pattern))
    return F.when(_may_have(text, name), count).otherwise(0).cast("int")


def _applied(text: Column, name: str, pattern: str, replacement: str) -> Column:
    def cards(t: Column) -> Column:
        """What is between matches as it is, and each match either so or replaced."""
        kept = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: F.when(luhn_valid(m), F.lit(replacement)).otherwise(m))
        return F.when(t.rlike(pattern), F.array_join(F.zip_with(F.split(t, pattern, -1), kept, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")).otherwise(t)

    def replaced(t: Column) -> Column:
        return cards(t) if name == "credit_card" else F.regexp_replace(t, pattern, replacement)

    return let(text, lambda t: F.when(_may_have(t, name), replaced(t)).otherwise(t))


def _searched(text: Column, limit: int | None) -> Column:
    return text if limit is None else F.left(text, F.lit(limit))


def redact(text: Column, classes=DEFAULT, limit: int | None = None) -> Column:
    """text with each class's matches replaced, one class after the other, in its first `limit` characters or all of it."""
    out = _searched(text, limit)
    for name, pattern, replacement, _on in _RULES:
        if name in classes:
            out = _applied(out, name, pattern, replacement)
    if limit is None:
        return out
    return F.when(F.length(text) > limit, F.concat(out, F.substring(text, F.lit(limit + 1), F.length(text)))).otherwise(out)


def with_secret_counts(df: DataFrame, text: str, out: str = "secrets", classes=DEFAULT, limit: int | None = None) -> DataFrame:
    """df with out: array of (class, count) found as the replacement proceeds; never a value."""
    return df.withColumn(out, scan_secrets(F.col(text), classes, limit))


def scan_secrets(text: Column, classes=DEFAULT, limit: int | None = None) -> Column:
    """array of (class, count) as one expression, for texts inside arrays.

    Each step is used once, by the next one: steps in columns of their own would be written out in each other, and
    double with each class, where a filter on the result is pushed below them.
    """
    start = F.struct(_searched(text, limit).alias("t"), F.array().cast("array<struct<class:string,count:int>>").alias("f"))
    for name, pattern, replacement, _on in _RULES:
        if name not in classes:
            continue

        start = let(start, _counted(name, pattern, replacement))
    return F.filter(start["f"], lambda f: f["count"] > 0)


def _counted(name: str, pattern: str, replacement: str):
    def step(s: Column) -> Column:
        found = F.struct(F.lit(name).alias("class"), _count(s["t"], name, pattern).alias("count"))
        return F.struct(_applied(s["t"], name, pattern, replacement).alias("t"), F.array_append(s["f"], found).alias("f"))

    return step


def redact_frame(df: DataFrame, classes=DEFAULT, depth: int | None = None, limit: int | None = None) -> DataFrame:
    """df with every string in it redacted, in structs, arrays and map values, down to `depth` or at all levels; map keys stay."""

    def walk(c: Column, kind: T.DataType, level: int) -> Column:
        if depth is not None and level > depth:
            return c
        if isinstance(kind, T.StringType):
            return redact(c, classes, limit)
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType, level + 1).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType, level + 1))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _k, v: walk(v, kind.valueType, level + 1))
        return c

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType, 0).alias(f.name) for f in df.schema.fields])
