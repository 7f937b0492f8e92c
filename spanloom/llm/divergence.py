"""Which terms and sources of a language stand apart: an audit by dominance skybands.

Terms are counted by language and source; a language keeps those in enough of its documents. A source's term diverges
by f = floor((p - q)^2 / (p + q)), where p and q are scaled shares of it in the source and in the language. Among terms
with p > q, f grows with the source's count and falls with the language's, so a term that at least k others surpass in
both and precede in UTF-8 can't be among the k first: it is dominated k times. Each partition keeps only its terms that
are dominated less often (its skyband), skybands are merged in two levels, and what is left is ranked exactly.

Pairs of sources are compared over all kept terms without listing the terms that one of them lacks: such terms differ
from a term that both lack only by the count in one source, so they are summed over that source's distinct counts, and
only terms that both have are met pair by pair, within a task, to sums by pairs of sources.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, small_batches, table, written
from .simhash import sized

#: Terms are runs of anything but these; fixed by the contract.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]"
LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Terms by language and source that a task counts before it gives them out.
HELD = 500_000
#: Parts in which a group's skybands are merged first.
SALTS = 16
#: Rows that are met with the skyband at a time.
BLOCK = 512

#: Bits for a count in a task.
COUNT_BITS = 40
COUNT, ONE_DOC = (1 << COUNT_BITS) - 1, 1 << COUNT_BITS
_TERM_BYTES = bytes(32 if re.match(BETWEEN, chr(c)) else c for c in range(256)).lower()
_GROUP = ("lang", "source")


def split(text: str) -> list[bytes]:
    """The terms of a text in UTF-8, A-Z lower-cased: in it, what is no ASCII is bytes of 128 and more, which are all of terms."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: partial counts of the terms of all texts; null texts and names are empty."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        # of each group and term one number: the count, and above its bits the documents
        held: dict = {}
        size = 0

        def flushed():
            for (lang, source), own in held.items():
                both = list(own.values())
                terms = pa.array(list(own), pa.binary()).cast(pa.string())
                columns = [pa.array([lang] * len(both), pa.string()), pa.array([source] * len(both), pa.string()), terms, pa.array([x & COUNT for x in both], pa.int64()), pa.array([x >> COUNT_BITS for x in both], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "count", "docs"])
            held.clear()

        for b in batches:
            for text, *group in zip(*(b.column(c).to_pylist() for c in ("text", *_GROUP)), strict=True):
                own = held.setdefault(tuple(group), {})
                size -= len(own)
                known = own.get
                for t, n in Counter(split(text)).items():
                    own[t] = known(t, 0) + n + ONE_DOC
                size += len(own)
            if size > HELD:
                yield from flushed()
                size = 0
        yield from flushed()

    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", *_GROUP)])
    return read.mapInArrow(run, "lang string, source string, term string, count long, docs long")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), exactly."""
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    a, b = F.lit(SCALE).cast("decimal(10,0)") * whole(count + 2, 19), whole(total + 2 * kept, 19)
    return F.lit(1).cast("long") + F.call_function("div", a, b)


def f_of(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, count, lang_count, first (one row of each lang and term has it) of the terms that a language keeps, where they occur."""
    sums = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    each = Window.partitionBy("lang", "term")
    sums = sums.withColumn("lang_count", F.sum("count").over(each)).withColumn("lang_docs", F.sum("docs").over(each)).withColumn("least", F.min("source").over(each))
    return sums.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "count", "lang_count", (F.col("source") == F.col("least")).alias("first"))


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n, lang_n, v, p0 of every group of docs: its kept terms' occurrences, the language's, the number of kept terms, and the share of a term that the group lacks (null without kept terms)."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in _GROUP]).distinct()
    of_group = kept.groupBy(*_GROUP).agg(F.sum("count").alias("n"))
    of_lang = kept.groupBy("lang").agg(F.sum("count").alias("lang_n"), F.sum(F.col("first").cast("long")).alias("v"))
    none = F.lit(0).cast("long")
    every = groups.join(of_group, [*_GROUP], "left").join(of_lang, "lang", "left")
    every = every.select(*_GROUP, *[F.coalesce(c, none).alias(c) for c in ("n", "lang_n", "v")])
    return every.withColumn("p0", F.when(F.col("v") > 0, share(none, F.col("n"), F.col("v"))))


def in_skyband(high: np.ndarray, low: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    """Which of some rows fewer than k others dominate: by a `high` no less, a `low` no more and a `word` (a rank without ties) that is less.

    Rows are taken in an order in which those that dominate a row come before it. It is enough to count what was kept
    and what is in the same block: whatever dominates one that was left out dominates all that this one does.
    """
    order = np.lexsort((word, low, -high))
    kept = np.zeros(0, np.int64)
    for at in range(0, len(order), BLOCK):
        new = order[at : at + BLOCK]
        over = np.zeros(len(new), np.int64)
        for some in (kept, new):
            over += ((high[some][:, None] >= high[new]) & (low[some][:, None] <= low[new]) & (word[some][:, None] < word[new])).sum(axis=0)
        kept = np.concatenate([kept, new[over < k]])
    out = np.zeros(len(order), bool)
    out[kept] = True
    return out


def skyband(rows: DataFrame, k: int) -> DataFrame:
    """The rows (lang, source, term, count, lang_count, ...) of each partition that fewer than k others of their group there dominate. A group's rows are taken in pieces, with what is kept of those before."""
    names = rows.columns

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def cut(t):
            terms = t.column("term").to_pylist()
            word = np.empty(len(terms), np.int64)
            word[sorted(range(len(terms)), key=lambda i: terms[i].encode())] = np.arange(len(terms))
            return t.filter(pa.array(in_skyband(t.column("count").to_numpy(), t.column("lang_count").to_numpy(), word, k)))

        group, held = None, None
        for b in batches:
            t = pa.Table.from_batches([b])
            langs, sources = (t.column(c).combine_chunks() for c in _GROUP)
            new = [0, *[int(i) + 1 for i in np.flatnonzero((pc.not_equal(langs[1:], langs[:-1]).to_numpy(zero_copy_only=False)) | (pc.not_equal(sources[1:], sources[:-1]).to_numpy(zero_copy_only=False)))], len(t)] if len(t) else [0]
            for start, end in zip(new[:-1], new[1:], strict=True):
                here = (langs[start].as_py(), sources[start].as_py())
                part = t.slice(start, end - start)
                if here == group:
                    held = cut(pa.concat_tables([held, part]))
                    continue
                if held is not None:
                    yield from held.combine_chunks().to_batches()
                group, held = here, cut(part)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return rows.sortWithinPartitions(*_GROUP).mapInArrow(run, rows.schema).select(*names)


def top_terms(rated: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: the first `top` terms of each group by f, then UTF-8, of rows (lang, source, term, count, lang_count, p, q)."""
    rows = rated.where("p > q").select(*_GROUP, "term", "count", "lang_count", "p", "q")
    for keys in ([], [*_GROUP, F.pmod(F.xxhash64("term"), F.lit(SALTS))], [*_GROUP]):
        rows = skyband(rows.repartition(*keys) if keys else rows, top)
    first = Window.partitionBy(*_GROUP).orderBy(F.col("value").desc(), "item")
    ranked = rows.select(*_GROUP, F.col("term").alias("item"), f_of(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(first))
    return ranked.where(F.col("rank") <= top)


def common_terms(rated: DataFrame) -> DataFrame:
    """lang, a, b, value: for each two sources a < b with common terms, what these add to the sum of f over what the two counts add one by one."""
    terms = rated.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "p0"))).alias("own")).where(F.size("own") > 1)

    def run(batches):
        import pyarrow as pa

        held: Counter = Counter()

        def flushed():
            if held:
                keys = list(held)
                yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array([held[k] for k in keys], pa.int64())], ["lang", "a", "b", "value"])
                held.clear()

        f = lambda x, y: (x - y) * (x - y) // (x + y)
        for batch in batches:
            own = batch.column("own")
            size = np.diff(own.offsets.to_numpy())
            flat = own.flatten()
            p, p0 = flat.field("p").to_numpy(), flat.field("p0").to_numpy()
            langs, sources = batch.column("lang").dictionary_encode(), flat.field("source").dictionary_encode()
            lang, source, n = np.repeat(langs.indices.to_numpy(), size).astype(np.int64), sources.indices.to_numpy().astype(np.int64), len(sources.dictionary)
            last = np.repeat(np.cumsum(size), size)
            for d in range(1, int(size.max(initial=1))):
                i = np.flatnonzero(np.arange(len(p)) + d < last)
                j = i + d
                value = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
                keys, at = np.unique((lang[i] * n + source[i]) * n + source[j], return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, at, value)
                for key, s in zip(keys.tolist(), sums.tolist(), strict=True):
                    held[langs.dictionary[key // n // n].as_py(), sources.dictionary[key // n % n].as_py(), sources.dictionary[key % n].as_py()] += s
            if len(held) > HELD:
                yield from flushed()
        yield from flushed()

    return terms.select("lang", "own").mapInArrow(run, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_pairs(rated: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: for each two sources of a language, in both directions, f summed over all its kept terms."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    both = groups.select(*_GROUP, "v", "p0").join(other, "lang").where("source <> item")
    # as if both lacked every term
    base = both.select(*_GROUP, "item", F.when(F.col("v") > 0, F.col("v") * f_of(F.col("p0"), F.col("q0"))).otherwise(F.lit(0).cast("long")).alias("value"))
    # what each count of a source adds, as if the other lacked the term
    counts = rated.groupBy(*_GROUP, "p", "p0").agg(F.count("*").alias("terms"))
    alone = counts.join(other, "lang").where("source <> item").groupBy(*_GROUP, "item").agg(F.sum(F.col("terms") * (f_of(F.col("p"), F.col("q0")) - f_of(F.col("p0"), F.col("q0")))).alias("value"))
    common = common_terms(rated).withColumnRenamed("a", "source").withColumnRenamed("b", "item")
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    every = base.unionByName(alone).unionByName(turned(alone)).unionByName(common).unionByName(turned(common))
    return every.groupBy(*_GROUP, "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of the groups (lang, source) of docs (text, lang, source).

    Part `term`: the first `top` kept terms that the group has more of than its language, q being the language's share.
    Part `pair`: every other source of the language, with f summed over all kept terms. Ranks are by value, then UTF-8.
    Null texts, langs and sources are empty; groups without terms have pairs all the same, with value 0 where the
    language keeps no term. Repeated rows count each, other columns are ignored, and an empty table gives an empty
    result. Sums of counts are exact up to 4.6e18.
    """
    kept = written(kept_terms(docs, least_docs), "divergence-kept")
    groups = written(group_sizes(docs, kept), "divergence-groups")
    p = share(F.col("count"), F.col("n"), F.col("v"))
    q = share(F.col("lang_count"), F.col("lang_n"), F.col("v"))
    rated = written(kept.join(sized(groups), [*_GROUP]).select(*_GROUP, "term", "count", "lang_count", p.alias("p"), q.alias("q"), "p0"), "divergence-rated")
    discard(kept)
    first = Window.partitionBy(*_GROUP).orderBy(F.col("value").desc(), "item")
    pairs = source_pairs(rated, sized(groups)).withColumn("rank", F.row_number().over(first))
    named = lambda df, part: df.select(*_GROUP, F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return named(pairs, "pair").unionByName(named(top_terms(rated, top), "term"))


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


#: Every term in every group, and every term in every pair of sources.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT i, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS c FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce((SELECT sum(c) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) x),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 2)) // (g.n + 2 * v.v) AS p, 1 + (1000000000 * (k.c + 2)) // (v.n + 2 * v.v) AS q
      FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10
"""
