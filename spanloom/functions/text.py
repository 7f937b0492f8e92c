"""Text and scalar functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SEVERITIES_ORDER

#: Words without content.
STOP_WORDS = (
    "a an the and or but if then else of to in on at by for with about as is are was were be been being it its this that these those "
    "i you he she they we do does did have has had will would can could should may might must not no so than there here from into "
    "your their our his her them us me my"
).split()


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_bounds(pattern: str) -> str:
    r"""A pattern in which \b is a bound of ASCII words, as the reference's patterns mean it; Java's also takes other letters for parts of words."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits, apostrophes and hyphens."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s'-]", " ")
    return F.filter(F.split(kept, r"\s+"), lambda t: t != "")


def content_tokens(text: Column) -> Column:
    """Tokens longer than two characters that are no stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def sentences(text: Column) -> Column:
    """Pieces that end after . ! or ? where an upper-case letter, a quote or a bracket follows."""
    pieces = F.split(text, r"""(?<=[.!?])\s+(?=[\p{Lu}"'(\[])""")
    return F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda s: s != "")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; both empty: 1."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def overlap_ratio(claim: Column, source: Column) -> Column:
    """Share of the claim's tokens, repeats counted, that the source has; no tokens: 1."""
    hit = F.size(F.filter(claim, lambda t: F.array_contains(source, t)))
    return F.when(F.size(claim) == 0, F.lit(1.0)).otherwise(hit / F.size(claim))


def ngrams(words: Column, n: int) -> Column:
    return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")))


def ngram_repetition(text: Column, n: int = 4) -> Column:
    """Share of n-grams that repeat earlier ones; 0 for fewer than 2n tokens."""

    def ratio(words: Column) -> Column:
        grams = ngrams(words, n)
        return F.when(F.size(words) < 2 * n, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(grams)) / F.size(grams))

    return let(tokens(text), ratio)


def longest_repeated_ngram(df: DataFrame, key: str, text: str, n: int = 4) -> DataFrame:
    """key, gram, times: each row's most frequent n-gram, the first seen on ties; rows with fewer than 2n tokens have none."""
    words = df.select(key, tokens(F.col(text)).alias("_w")).where(F.size("_w") >= 2 * n)
    grams = words.select(key, F.posexplode(ngrams(F.col("_w"), n)).alias("at", "gram"))
    counted = grams.groupBy(key, "gram").agg(F.count("*").alias("times"), F.min("at").alias("at"))
    return counted.groupBy(key).agg(F.max_by("gram", F.struct("times", -F.col("at"))).alias("gram"), F.max("times").alias("times"))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def _runs():
    """prefixes(text) and shared(s, t, hashed, n), as closures, so that workers get them with the function that uses them."""

    def prefixes(text: str):
        """Sums of code times a power of a base, and the powers of its inverse, modulo 2^64: hashes of all runs of a length come from them at once."""
        import numpy as np

        base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, len(codes) - 1), base)]), dtype=np.uint64)
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes), inverse)]), dtype=np.uint64)
        return np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)], dtype=np.uint64)]), back

    def shared(s: str, t: str, hashed: list, n: int) -> bool:
        """Whether two texts, with their prefixes, share a run of n characters, no more than either has."""
        import numpy as np

        one, two = ((sums[n:] - sums[:-n]) * back[: len(sums) - n] for sums, back in hashed)
        _same, i, j = np.intersect1d(one, two, return_indices=True)
        return any(s[p : p + n] == t[q : q + n] for p, q in zip(i, j, strict=True))

    return prefixes, shared


def shares_run(a: Column, b: Column, n: int, most: int | None = None) -> Column:
    """Whether two texts share a run of n characters, of their first `most` or all. Runs are hashed from one pass over a text, as taking each out of it would go through the text once a run."""

    prefixes, same = _runs()

    def shared(x: pd.Series, y: pd.Series) -> pd.Series:
        import pandas as pd

        def of(s, t):
            s, t = (v or "" if most is None else (v or "")[:most] for v in (s, t))
            return len(s) >= n and len(t) >= n and same(s, t, [prefixes(s), prefixes(t)], n)

        return pd.Series([of(s, t) for s, t in zip(x, y, strict=True)], dtype="bool")

    return F.pandas_udf(shared, T.BooleanType())(a, b)


def longest_common_run(a: Column, b: Column, most: int | None = None) -> Column:
    """Length of the longest common substring of two texts, of their first `most` characters or all; use it behind shares_run()."""

    prefixes, same = _runs()

    def lengths(x: pd.Series, y: pd.Series) -> pd.Series:
        import pandas as pd

        def of(s, t):
            s, t = (v or "" if most is None else (v or "")[:most] for v in (s, t))
            hashed = [prefixes(v) for v in (s, t)]
            low, high = 0, min(len(s), len(t))
            while low < high:
                n = (low + high + 1) // 2
                low, high = (n, high) if same(s, t, hashed, n) else (low, n - 1)
            return low

        return pd.Series([of(s, t) for s, t in zip(x, y, strict=True)], dtype="int32")

    return F.pandas_udf(lengths, T.IntegerType())(a, b)


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def stable_hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def bucket_start(ms: Column, bucket_ms) -> Column:
    bucket = bucket_ms if isinstance(bucket_ms, Column) else F.lit(bucket_ms)
    return (ms - F.pmod(ms, bucket)).cast("long")


def severity_rank(severity: Column) -> Column:
    out = F.when(severity == SEVERITIES_ORDER[0], 0)
    for i, s in enumerate(SEVERITIES_ORDER[1:], 1):
        out = out.when(severity == s, i)
    return out


def max_severity(severity: Column) -> Column:
    """Aggregate: the highest severity."""
    return F.max_by(severity, severity_rank(severity))


def severities_from(floor: str) -> list[str]:
    return list(SEVERITIES_ORDER[SEVERITIES_ORDER.index(floor):])


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence < 0.5, "possible").when(confidence < 0.8, "likely").otherwise("confirmed")


def without_fence(text: Column) -> Column:
    """The text in a Markdown fence, if it is all in one."""
    inner = F.regexp_extract(text, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)
    return F.when(text.rlike(r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$"), inner).otherwise(text)


def json_valid(text: Column) -> Column:
    """Whether the whole text is one JSON value."""
    one = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    items = F.try_variant_get(one, "$", "array<variant>")
    return F.coalesce(F.size(items) == 1, F.lit(False))


def first_number(attributes: Column, keys) -> Column:
    """The first of the keys whose value is a finite number or numeric string."""
    def value(k: str) -> Column:
        v = F.expr("try_cast(NULL as double)") if k is None else F.try_element_at(attributes, F.lit(k)).try_cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)

    return F.coalesce(*[value(k) for k in keys])
