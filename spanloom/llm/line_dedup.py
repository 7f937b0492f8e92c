"""Line dedup by content-defined line chunks.

Every line has a hash. A rolling hash over the hashes of WINDOW lines decides whether a chunk ends with the last of
them, so that a passage is cut alike wherever it stands in a document: lines put in before or after it move no
boundary inside. Chunks have at least two lines. Of chunks that recur anywhere in the corpus all but the first
occurrence are removed, after their bytes are found equal. The work is column expressions, counts by chunk hashes,
and one join of the texts with the places of their recurring chunks.

At a passage's ends chunks hold foreign lines, and a short passage may have no boundary inside. passages() therefore
gives a second kind of chunk, which depends on its own lines only: the shortest runs of enough words from each line
and up to each line. They cover a repeated passage to its ends, and those of one long line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, counted_join, discard, let, lookup, table, written

#: Lines that the rolling hash sees. A line is marked if its hash leaves 0 when divided by SPACING; a chunk ends with a marked line that follows an unmarked one.
WINDOW, SPACING = 4, 3
LEAST_LINES, MOST_LINES = 2, 16
#: Words of a run that can be removed; runs of MOST_LINES lines can be in any case.
LEAST_WORDS = 20
#: The rolling hash of lines: the hash of those before times the factor plus that of the next, modulo a prime.
FACTOR, PRIME = 1_000_003, 2_147_483_629


def line_hash(line: Column) -> Column:
    """The first 28 bits of the line's MD5 as a number."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def marks(hashes: Column) -> Column:
    """array of whether the rolling hash up to each line marks it; lines before the first count as hash 0."""

    def marked(_h: Column, i: Column) -> Column:
        rolling = F.lit(0).cast("long")
        for back in range(WINDOW - 1, -1, -1):
            rolling = (rolling * FACTOR + F.when(i >= back, F.get(hashes, i - back)).otherwise(F.lit(0))) % PRIME
        return rolling % SPACING == 0

    return F.transform(hashes, marked)


def chunk_starts(lines: Column) -> Column:
    """array of the 1-based lines at which the chunks of an array of lines begin. A line begins one if the line before it is marked and the one before that is not; neither the second nor the last line does, so that a chunk has LEAST_LINES lines, unless it is what is left of MOST_LINES or the text has one line only."""

    def begun(v: Column) -> Column:
        inner = F.filter(F.sequence(F.lit(3), F.greatest(v["n"] - 1, F.lit(3))), lambda i: (i < v["n"]) & F.get(v["marks"], i - 2) & ~F.get(v["marks"], i - 3))
        return let(F.struct(F.concat(F.array(F.lit(1)), inner).alias("starts"), v["n"].alias("n")), bounded)

    def bounded(v: Column) -> Column:
        def split(start: Column, k: Column) -> Column:
            return F.sequence(start, F.coalesce(F.get(v["starts"], k + 1), v["n"] + 1) - 1, F.lit(MOST_LINES))

        return F.flatten(F.transform(v["starts"], split))

    return let(F.struct(let(F.transform(lines, line_hash), marks).alias("marks"), F.size(lines).alias("n")), begun)


def chunked(docs: DataFrame) -> DataFrame:
    """row_key, doc_id and chunks (array of line, n_lines, text) of each row of docs; the key is equal only for rows with equal id and text."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("text"), row_key(F.col("doc_id"), text).alias("row_key"))

    def chunks(lines: Column) -> Column:
        def texts(v: Column) -> Column:
            def chunk(start: Column, k: Column) -> Column:
                end = F.coalesce(F.get(v["starts"], k + 1), F.size(v["lines"]) + 1)
                return F.struct(start.alias("line"), (end - start).alias("n_lines"), F.array_join(F.slice(v["lines"], start, end - start), "\n").alias("text"))

            return F.transform(v["starts"], chunk)

        return let(F.struct(chunk_starts(lines).alias("starts"), lines.alias("lines")), texts)

    return d.select("row_key", "doc_id", let(F.split("text", "\n", -1), chunks).alias("chunks"))


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that stand for a row's id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("\n"), text).cast("binary")))


def chunk_text(lines: Column, line: Column, n_lines: Column) -> Column:
    return F.array_join(F.slice(lines, line, n_lines), "\n")


def removable(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, line, n_lines and two hashes (h1, h2) of the chunks that may be removed: those of LEAST_LINES lines."""
    c = chunked(docs).select("row_key", "doc_id", F.explode("chunks").alias("c")).select("row_key", "doc_id", "c.*")
    return c.where(F.col("n_lines") >= LEAST_LINES).select("row_key", "doc_id", "line", "n_lines", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))


def passages(docs: DataFrame) -> DataFrame:
    """The columns of removable() for runs of lines: of each line the shortest run from it, and the shortest up to it, that has LEAST_WORDS words or MOST_LINES lines.

    Whether a run is one depends on its own lines only, and in a passage of LEAST_WORDS words each line is in such
    a run that leaves the passage on neither side.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("text"), row_key(F.col("doc_id"), text).alias("row_key"))

    def length(words: Column) -> Column:
        def step(acc: Column, w: Column) -> Column:
            return F.when(acc["words"] >= LEAST_WORDS, acc).otherwise(F.struct((acc["n"] + 1).alias("n"), (acc["words"] + w).alias("words")))

        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"))
        return F.aggregate(words, zero, step, lambda acc: F.when((acc["words"] >= LEAST_WORDS) | (acc["n"] >= MOST_LINES), acc["n"]).otherwise(0))

    def from_each(v: Column) -> Column:
        each = F.transform(v["words"], lambda _w, i: length(F.slice(v["words"], i + 1, F.lit(MOST_LINES))))
        return let(F.struct(v["lines"].alias("lines"), v["words"].alias("words"), each.alias("ahead")), runs)

    def runs(v: Column) -> Column:
        def back(_w: Column, i: Column) -> Column:
            n = length(F.reverse(F.slice(v["words"], F.greatest(i + 2 - MOST_LINES, F.lit(1)), F.least(i + 1, F.lit(MOST_LINES)))))
            return let(n, lambda n: F.struct((i + 2 - n).alias("line"), n.alias("n_lines")))

        ahead = F.transform(v["ahead"], lambda n, i: F.struct((i + 1).alias("line"), n.alias("n_lines")))
        # a run up to a line that is a run from its first line is listed already
        more = F.filter(F.transform(v["words"], back), lambda r: (r["n_lines"] > 0) & (F.get(v["ahead"], r["line"] - 1) != r["n_lines"]))
        return F.transform(F.concat(F.filter(ahead, lambda r: r["n_lines"] > 0), more), lambda r: let(chunk_text(v["lines"], r["line"], r["n_lines"]), lambda t: F.struct(r["line"].alias("line"), r["n_lines"].alias("n_lines"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2"))))

    found = let(F.split("text", "\n", -1), lambda lines: let(F.struct(lines.alias("lines"), F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD))).alias("words")), from_each))
    return d.select("row_key", "doc_id", F.explode(found).alias("r")).select("row_key", "doc_id", "r.*")


def recurring(docs: DataFrame, whole: bool = True) -> DataFrame:
    """row_key and again: the document's chunks whose hashes recur, as (line, n_lines, h1, h2, first); first is the occurrence with the least (doc_id, line), rows without an id before others."""
    keys, place = removable(docs), F.struct("doc_id", "line", "row_key")
    if whole:
        keys = keys.unionByName(passages(docs))
    keys = written(keys, "line-chunks")
    # a chunk may be a run as well, and is no repeat of itself
    firsts = keys.groupBy("h1", "h2").agg(F.min(place).alias("head"), F.max(place).alias("last"), F.count("*").alias("n")).where("head <> last").drop("last")
    firsts = written(firsts, "line-firsts")
    found = counted_join(keys, firsts, ["h1", "h2"], "n")
    first = (F.col("row_key") == F.col("head.row_key")) & (F.col("line") == F.col("head.line"))
    again = written(found.groupBy("row_key").agg(F.collect_set(F.struct("line", "n_lines", "h1", "h2", first.alias("first"))).alias("again")), "line-again")
    discard(keys, firsts)
    return again


def unequal(marked: DataFrame) -> DataFrame:
    """row_key and keep: chunks whose hashes recur with other bytes somewhere. All occurrences of a pair of hashes are compared, as the least and the greatest text of the pair; where two differ, none of the pair is taken for a repeat."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    texts = F.transform("_again", lambda a: F.struct(a["h1"].alias("h1"), a["h2"].alias("h2"), chunk_text(lines, a["line"], a["n_lines"]).alias("text")))
    each = marked.where("_again is not null").select(F.explode(texts).alias("t")).select("t.*")
    clash = each.groupBy("h1", "h2").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low <> high").select("h1", "h2")
    held = marked.where("_again is not null").select("_key", F.explode("_again").alias("a")).select("_key", "a.h1", "a.h2")
    return held.join(written(clash, "line-clash"), ["h1", "h2"]).groupBy("_key").agg(F.collect_set(F.struct("h1", "h2")).alias("_keep"))


def dedup_lines(docs: DataFrame, passages: bool = True) -> DataFrame:
    """docs with text without the repeated chunks, and n_lines, lines_removed, chunks_removed.

    Repeated runs of lines (see passages()) go as well, unless passages is False, and chunks_removed counts them too.
    Each line that goes still stands at an earlier place, as the first occurrence of its chunk or run is earlier.

    Lines end at line feeds; a null text stays null and counts as one empty line; an empty one has one too.
    A document all of whose chunks repeat earlier ones ends up with an empty text; no document goes. Rows equal
    in id and text are one document: all of them keep what it is the first to have. Columns of docs named like
    the three counts are replaced by them.
    """
    cols = [c for c in docs.columns if c not in ("n_lines", "lines_removed", "chunks_removed", "_key", "_again", "_keep")]
    text = F.coalesce(F.col("text"), F.lit(""))
    again = recurring(docs, passages)
    marked = docs.select(*cols, row_key(F.col("doc_id"), text).alias("_key")).join(again.withColumnRenamed("row_key", "_key").withColumnRenamed("again", "_again"), "_key", "left")
    # the only time that whole texts are moved; what follows reads them from here
    marked = written(marked, "line-marked")
    discard(again)
    d = lookup(marked, written(unequal(marked), "line-unequal"), "_key", "left")
    sure = F.filter("_again", lambda a: ~a["first"] & ~F.coalesce(F.array_contains("_keep", F.struct(a["h1"].alias("h1"), a["h2"].alias("h2"))), F.lit(False)))
    d = d.withColumn("_gone", F.when(F.size(sure) > 0, sure))

    def dropped(gone: Column) -> Column:
        drop = F.flatten(F.transform(gone, lambda g: F.sequence(g["line"], g["line"] + g["n_lines"] - 1)))
        return F.array_distinct(drop) if passages else drop

    def kept(v: Column) -> Column:
        return let(F.struct(v["lines"].alias("lines"), F.array_sort(dropped(v["gone"])).alias("drop")), remaining)

    def remaining(v: Column) -> Column:
        # what stays is what lies between the lines that go
        ends = F.concat(F.array(F.lit(0)), v["drop"], F.array(F.size(v["lines"]) + 1))
        return let(ends, lambda e: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda i: F.slice(v["lines"], F.get(e, i) + 1, F.get(e, i + 1) - F.get(e, i) - 1))), "\n"))

    lines = F.split(text, "\n", -1)
    new = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(let(F.struct(lines.alias("lines"), F.col("_gone").alias("gone")), kept))
    counts = [
        F.size(lines).alias("n_lines"),
        F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size(dropped(F.col("_gone")))).alias("lines_removed") if passages else F.coalesce(F.aggregate("_gone", F.lit(0), lambda a, g: a + g["n_lines"]), F.lit(0)).alias("lines_removed"),
        F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).alias("chunks_removed"),
    ]
    return d.select(*[new.alias("text") if c == "text" else F.col(c) for c in cols], *counts)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "lines_removed", "chunks_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


#: The same by lists and an explicit order of occurrences.
OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
h AS (
  SELECT doc_id, lines, len(lines) AS n, list_transform(lines, lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT) AS hs,
         list_transform(lines, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS ws FROM l),
m AS (
  SELECT *, list_transform(range(1, n + 1), lambda i:
         ((((CASE WHEN i > 3 THEN hs[i - 3] ELSE 0 END % 2147483629 * 1000003 + CASE WHEN i > 2 THEN hs[i - 2] ELSE 0 END) % 2147483629 * 1000003
           + CASE WHEN i > 1 THEN hs[i - 1] ELSE 0 END) % 2147483629 * 1000003 + hs[i]) % 2147483629) % 3 = 0) AS marked FROM h),
s AS (
  SELECT *, list_filter(range(1, n + 1), lambda i: i = 1 OR (i > 2 AND i < n AND marked[greatest(i - 1, 1)] AND NOT marked[greatest(i - 2, 1)])) AS st FROM m),
b AS (
  SELECT *, flatten(list_transform(range(1, len(st) + 1), lambda k: range(st[k], coalesce(st[k + 1], n + 1), 16))) AS cs FROM s),
w AS (
  SELECT *, list_transform(range(1, n + 1), lambda i: list_filter(range(1, 17), lambda k: i + k - 1 <= n AND (k = 16 OR list_sum(ws[i:i + k - 1]) >= 20))[1]) AS ahead,
         list_transform(range(1, n + 1), lambda i: list_filter(range(1, 17), lambda k: i - k + 1 >= 1 AND (k = 16 OR list_sum(ws[i - k + 1:i]) >= 20))[1]) AS back FROM b),
p AS (
  SELECT doc_id, lines, list_distinct(list_concat(
         list_filter(list_transform(range(1, len(cs) + 1), lambda k: {'line': cs[k], 'n': coalesce(cs[k + 1], n + 1) - cs[k]}), lambda c: c.n >= 2),
         list_transform(list_filter(range(1, n + 1), lambda i: ahead[i] IS NOT NULL), lambda i: {'line': i, 'n': ahead[i]}),
         list_transform(list_filter(range(1, n + 1), lambda i: back[i] IS NOT NULL), lambda i: {'line': i - back[i] + 1, 'n': back[i]}))) AS ps FROM w),
u AS (SELECT doc_id, lines, unnest(ps) AS p FROM p),
o AS (SELECT doc_id, p.line AS line, p.n AS n, array_to_string(lines[p.line:p.line + p.n - 1], chr(10)) AS text FROM u),
r AS (SELECT doc_id, line, n, row_number() OVER (PARTITION BY text ORDER BY doc_id, line) AS nth FROM o),
g AS (SELECT doc_id, list_distinct(flatten(list(range(line, line + n)))) AS gone, count(*) AS chunks_removed FROM r WHERE nth > 1 GROUP BY doc_id)
SELECT l.doc_id, len(lines)::INTEGER AS n_lines, coalesce(len(gone), 0)::INTEGER AS lines_removed, coalesce(chunks_removed, 0)::INTEGER AS chunks_removed,
       md5(array_to_string(list_filter(lines, lambda x, i: NOT coalesce(list_contains(gone, i), false)), chr(10))) AS text_md5
FROM l LEFT JOIN g USING (doc_id)
"""
