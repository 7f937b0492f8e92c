"""Secret scans: known shapes by pattern, unknown ones by a battery of randomness tests.

A candidate is a run of token characters. Its encoding is inferred from the characters it uses; the characters
become numbers 0..k-1 of that alphabet, and three tests ask whether they look drawn at random: chi-squared of
their counts against uniformity, the number of runs above and below the middle, and the correlation of neighbours.
The least of the three p-values, times three, is the candidate's p-value for "random". Words, paths and counters
fail; the Benjamini-Hochberg rule, run apart for each encoding and band of lengths (as short strings fail less
easily), bounds the share of random strings among those dismissed, that is the keys that the scan misses among what
it drops. It doesn't bound the share of spans that are no keys: of strings that look random though they are not
(long names in mixed case with digits) some stay. What is not dismissed is reported as a span, where the encoding and
the length leave the tests enough power. All of it is column expressions; only histograms of p-values are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, table, written

#: The base kinds in the order in which their spans are listed: kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Something that every match of a base pattern has; it is cheap to look for.
HINTS = {"assign": r"(?i:pass|secret|token|api)", "access": "AKIA", "hex": r"[0-9a-f]{32}"}
#: Runs of these are candidates of the tests: token characters, and '=' as padding after them only, so that what is before an inner '=' is apart.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_=-]{20})[A-Za-z0-9+/_-]++(?:=++(?![A-Za-z0-9+/_-]))?"
#: Encodings by the characters they may use: kind, pattern, alphabet (its order gives the numbers), least length. The first that fits is taken; which characters must occur is left to the tests, but for digits alone.
ENCODINGS = (
    ("random16", r"^(?=.*[0-9])(?=.*[a-fA-F])([0-9a-f]+|[0-9A-F]+)=*$", "0123456789abcdef", 24),
    ("random32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 24),
    ("random36", r"^[a-z0-9]+=*$", "abcdefghijklmnopqrstuvwxyz0123456789", 24),
    ("random64", r"^(?![a-z0-9]+=*$)(?![A-Z0-9]+=*$)[A-Za-z0-9+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 20),
    ("random36u", r"^[A-Z0-9]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 24),
)
#: Share of random strings that may be among the dismissed, and the lower ends of the bands of lengths.
RATE = 0.05
BANDS = (20, 32, 48, 64, 128)
BINS = 400
#: Characters of a candidate that the tests look at are all; the p-value's bin is its logarithm, down to exp(-40).
LEAST_LOG = -40.0

#: Steps of running sums and bisections: a text of at most 2^31 characters has fewer matches than twice the last.
DOUBLINGS = tuple(2**i for i in range(28))


def running(sizes: Column) -> Column:
    """Running sums of an array of int, by doubling: after the step d each element holds the sum of the last 2 d elements up to it. n log n work, and no array that grows an element at a time."""
    steps = F.filter(F.array(*map(F.lit, DOUBLINGS)), lambda d: d < F.size(sizes))
    return F.aggregate(steps, sizes, lambda acc, d: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - d), F.lit(0))))


def located(text: Column, pattern: str, group: int, least: int, hint: str) -> Column:
    """array of (start, end, match) of the matches, leftmost and without overlap, whose group has `least` characters. The places are running sums over the lengths of matches and of what lies between them."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def places(v: Column) -> Column:
        sizes = F.transform(v["found"], lambda m, i: F.length(F.get(v["gaps"], i)) + F.length(m))

        def rows(ends: Column) -> Column:
            all_rows = F.transform(v["found"], lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match")))
            return F.filter(all_rows, lambda _r, i: F.length(F.get(v["kept"], i)) >= least)

        return let(sizes, lambda x: let(running(x), rows))

    gaps = F.split(text, pattern, -1)
    some = let(F.struct(whole.alias("found"), part.alias("kept"), gaps.alias("gaps")), lambda v: F.when(F.size(v["found"]) > 0, places(v)).otherwise(empty))
    return F.when(text.rlike(hint), some).otherwise(empty)


def touches(span: Column, others: Column) -> Column:
    """Whether span overlaps one of others, which are sorted and apart from each other: bisection finds the last that starts before span's end."""
    steps = F.filter(F.array(*map(F.lit, reversed(DOUBLINGS))), lambda d: d <= F.size(others))
    before = F.aggregate(steps, F.lit(0), lambda at, d: F.when(F.get(others, at + d - 1)["start"] < span["end"], at + d).otherwise(at))
    return F.coalesce(F.get(others, before - 1)["end"] > span["start"], F.lit(False))


def upper_normal(z: Column) -> Column:
    """Natural logarithm of the chance that a standard normal is above z (for z >= 0, within 1% of the chance; below 0: of a half)."""
    x = F.greatest(z, F.lit(0.0))
    # 1 / (sqrt(2 pi) (0.661 x + 0.339 sqrt(x^2 + 5.51))) exp(-x^2 / 2), a known bound-like fit of the tail
    return -x * x / 2 - F.log(F.lit(2.5066282746) * (0.661 * x + 0.339 * F.sqrt(x * x + 5.51)))


def log_p_random(s: Column, alphabet: str) -> Column:
    """Logarithm of the p-value of s (over the alphabet) for being random: three times the least of those of the three tests, at most 1."""
    k = len(alphabet)

    def tests(v: Column) -> Column:
        x = F.transform(F.filter(F.split(v, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
        return let(F.filter(x, lambda i: i >= 0), statistics)

    def statistics(x: Column) -> Column:
        n = F.size(x).cast("double")
        counts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.size(F.filter(x, lambda i: i == j)).cast("double"))
        chi = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) * k / n - n
        # Wilson-Hilferty: the cube root of chi-squared over its degrees of freedom is near normal
        f = float(k - 1)
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / f, F.lit(1 / 3)) - (1 - 2 / (9 * f))) / ((2 / (9 * f)) ** 0.5)
        pairs = F.arrays_zip(F.slice(x, 1, F.size(x) - 1).alias("a"), F.slice(x, 2, F.size(x) - 1).alias("b"))
        high = lambda i: i >= k // 2
        n1 = F.size(F.filter(x, high)).cast("double")
        n2 = n - n1
        runs = 1 + F.size(F.filter(pairs, lambda p: high(p["a"]) != high(p["b"]))).cast("double")
        mean_runs = 1 + 2 * n1 * n2 / n
        var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
        z_runs = F.when(var_runs > 0, F.abs(runs - mean_runs) / F.sqrt(var_runs)).otherwise(F.sqrt(n))
        mid = (k - 1) / 2
        var = (k * k - 1) / 12
        serial = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mid) * (p["b"] - mid)) / var
        z_serial = F.abs(serial) / F.sqrt(n - 1)
        two_sided = lambda z: upper_normal(z) + F.log(F.lit(2.0))
        return F.least(F.lit(0.0), F.log(F.lit(3.0)) + F.least(upper_normal(z_chi), two_sided(z_runs), two_sided(z_serial)))

    return let(s, tests)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans of the base kinds) and tried (candidates with encoding, band and bin of their p-value) of each row."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text"))
    found = found.select("doc_id", *[located(F.col("text"), p, g, n, HINTS[kind]).alias(kind) for kind, p, g, n in BASE], located(F.col("text"), CANDIDATE, 0, BANDS[0], CANDIDATE).alias("candidates"))

    def of_kind(i: int, column: str) -> Column:
        return F.transform(column, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end")))

    spans = [of_kind(i, kind) for i, (kind, *_rest) in enumerate(BASE)]
    found = found.withColumn("base", F.array_sort(F.concat(*spans)))
    # each base kind's spans are sorted and apart, all of them together needn't be
    free = F.filter("candidates", lambda c: ~(touches(c, F.col("assign")) | touches(c, F.col("access")) | touches(c, F.col("hex"))))

    def tried(c: Column) -> Column:
        out = F.lit(None).cast("struct<start:int,kind:int,end:int,band:int,bin:int>")
        for i, (_kind, pattern, alphabet, least) in reversed(list(enumerate(ENCODINGS))):
            s = F.regexp_replace(c["match"], "=+$", "")
            s = F.lower(s) if alphabet.startswith("0123") else F.translate(s, "-_", "+/")
            band = sum((F.length(c["match"]) >= b).cast("int") for b in BANDS[1:])
            p_bin = F.floor(F.least(log_p_random(s, alphabet) / LEAST_LOG, F.lit(0.999999)) * BINS).cast("int")
            row = F.struct(c["start"].alias("start"), F.lit(len(BASE) + i).alias("kind"), c["end"].alias("end"), band.alias("band"), p_bin.alias("bin"))
            out = F.when(c["match"].rlike(pattern) & (F.length(c["match"]) >= least), row).otherwise(out)
        return out

    return found.select("doc_id", "base", F.filter(F.transform(free, tried), lambda t: t.isNotNull()).alias("tried"))


def dismissals(scan: DataFrame, rate: float = RATE) -> DataFrame:
    """kind, band, from_bin: candidates in bins from from_bin on (small p-values) are dismissed, by the step-up rule on the bins' upper ends. At most one row for each encoding and band."""
    bins = scan.select(F.explode("tried").alias("t")).groupBy("t.kind", "t.band", "t.bin").agg(F.count("*").alias("n"))
    of = Window.partitionBy("kind", "band")
    # bin 0 holds the p-values next to 1, the last one the least
    upto = F.sum("n").over(of.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    highest = F.exp(F.col("bin") * F.lit(LEAST_LOG / BINS))
    passed = bins.withColumn("ok", highest <= upto * F.lit(rate) / F.sum("n").over(of))
    return passed.where("ok").groupBy("kind", "band").agg(F.min("bin").alias("from_bin"))


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, spans (start, kind, end; sorted) and added (how many the tests gave) of each row of docs (doc_id, text).

    Places are code points, ends exclusive. Null and empty texts have no spans. Repeated rows are found each, and
    count each in the control of false discoveries. Other columns are ignored.
    """
    scan = written(scanned(docs), "secret-scan")
    # At most len(ENCODINGS) * len(BANDS) rows, so this broadcast has a fixed bound.
    cut = F.broadcast(dismissals(scan, rate).groupBy().agg(F.map_from_entries(F.collect_list(F.struct((F.col("kind") * 100 + F.col("band")).alias("key"), "from_bin"))).alias("cut")))
    both = scan.crossJoin(cut)
    kept = F.filter("tried", lambda t: t["bin"] < F.coalesce(F.element_at("cut", t["kind"] * 100 + t["band"]), F.lit(BINS)))
    added = F.transform(kept, lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end")))
    return both.select("doc_id", F.array_sort(F.concat("base", added)).alias("spans"), F.size(added).alias("added"))


KINDS = tuple(x[0] for x in (*BASE, *ENCODINGS))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *[count(i).alias(f"n_{k[0]}") for i, k in enumerate(BASE)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
