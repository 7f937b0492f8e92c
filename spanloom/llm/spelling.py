"""Spelling variants by a bit-sliced position index.

The vocabulary is the words of all texts with their counts. Two words one edit apart are equal before and behind the
edit, so they share the first or the last half of the shorter one's letters; words that share a half are a block. In a
block each position and letter has a bitset of the words with that letter there. A word is looked up in all words of
the block at once: going through its letters, one bitset holds the words that have matched so far (zero errors), and
three more those with one error behind them, by the shift that the error left: none (a replaced letter), one position
on (the other word has a letter more) and one back (a letter less). Each step is a few ANDs and ORs of bitsets.

A block gives a row a word (how many near words, and the first of them in the order of counts), so that what leaves it
is in proportion to the words, not to the pairs. Small blocks share an index, large ones are dealt in parts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ship, table, written
from .simhash import sized

#: Letters of words, and how many a word has at least; fixed by the contract.
LETTER = r"[A-Za-zÀ-ÿ]"
LEAST_LETTERS, LEAST_COUNT, LEAST_RATIO = 6, 5, 5
#: One run in so many loses a letter (the contract's misspellings); 0: none does.
DAMAGE = 199
#: Words that share an index where their blocks are smaller, and letters of the words of one index at most, beyond which a block is dealt in parts.
SHARED, PART_LETTERS = 768, 60_000
#: Bits of a step's bitsets.
STEP_BITS = 1 << 22


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, damage: int = DAMAGE) -> DataFrame:
    """word, n: the distinct words of at least so many code points and occurrences over all texts of docs (doc_id, text).

    Words are maximal runs of the letters, lower-cased in A-Z only. With damage, a run loses a code point where the CRC-32 of
    `<doc_id>:<run>` is divided by it (a null doc_id is empty). Null and empty texts have no words; repeated rows count
    each; other columns are ignored.
    """
    pattern = f"({LETTER}{{{least_letters},}})"
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(1))).alias("run"))
    run = run.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    word = F.col("run")
    if damage:
        run = run.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
        at = F.pmod("h", F.length("run")).cast("int")
        word = F.when(F.col("h") % damage != 0, F.col("run")).otherwise(F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run"))))
    return run.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def halves(words: DataFrame, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """side, class, half, word, n: the blocks of each word of at least so many letters.

    A class is the shorter length of the pairs that its blocks are for, so a word is in that of its own length and in
    that of one less. Two words of class c that are one edit apart agree in c - 1 letters before and behind it, hence in
    the first or the last c / 2 (rounded down).
    """
    c = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("class")
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    k = F.floor(F.col("class") / 2).cast("int")
    half = F.when(F.col("side") == 0, F.col("word").substr(F.lit(1), k)).otherwise(F.col("word").substr(F.length("word") - k + 1, k))
    return words.select("word", "n", c).select("*", sides).where(F.col("class") >= least_letters).select("side", "class", half.alias("half"), "word", "n")


def packed(rows: np.ndarray) -> np.ndarray:
    """Bitsets (uint64) of the rows of a boolean matrix."""
    bits = np.packbits(rows, axis=1, bitorder="little")
    wide = np.zeros((len(rows), -(-bits.shape[1] // 8) * 8), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return wide.view(np.uint64)


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words as a matrix (0 behind a word's end), and their lengths."""
    length = np.array([len(w) for w in words])
    out = np.zeros((len(words), int(length.max()) if len(words) else 0), np.uint32)
    out[np.arange(out.shape[1])[None, :] < length[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return out, length


class PositionIndex:
    """Bitsets by position and letter over words, for looking up those that are one edit apart."""

    def __init__(self, words: list[str]):
        self.codes, self.length = letters_of(words)
        self.width = -(-len(words) // 64)
        self.slices = []
        for p in range(self.codes.shape[1]):
            letters = np.unique(self.codes[:, p])
            letters = letters[letters > 0]
            # the last row is of letters that no word has there
            sets = np.zeros((len(letters) + 1, self.width), np.uint64)
            sets[:-1] = packed(self.codes[None, :, p] == letters[:, None])
            self.slices.append((letters, sets))

    def having(self, p: int, letter: np.ndarray) -> np.ndarray:
        """The bitsets of the words with the letters at position p, a row a letter; none before or behind the words."""
        if not 0 <= p < len(self.slices):
            return np.zeros((len(letter), self.width), np.uint64)
        letters, sets = self.slices[p]
        at = np.searchsorted(letters, letter)
        known = (at < len(letters)) & (letters[np.minimum(at, len(letters) - 1)] == letter)
        return sets[np.where(known, at, len(letters))]

    def of_length(self, lengths: np.ndarray) -> np.ndarray:
        return packed(self.length[None, :] == lengths[:, None])

    def near(self, codes: np.ndarray, length: int) -> np.ndarray:
        """The bitsets of the words exactly one edit from each of some words of one length."""
        everything = np.full((len(codes), self.width), np.uint64(0xFFFFFFFFFFFFFFFF))
        zero, same = everything, np.zeros_like(everything)
        more, less = np.zeros_like(everything), np.zeros_like(everything)
        for i in range(length):
            here = self.having(i, codes[:, i])
            same = (same & here) | zero
            more = (more | zero) & self.having(i + 1, codes[:, i])
            less = (less & self.having(i - 1, codes[:, i])) | zero
            zero = zero & here
        at = lambda n: self.of_length(np.array([n]))
        # an equal word is in `same` too, as a letter may have been replaced by itself
        return (same & ~zero & at(length)) | ((more | zero) & at(length + 1)) | (less & at(length - 1))


def near_in(index: list[tuple], calls: list[tuple], side: int, least: int):
    """word, n_near, best_n, best of each of calls that has near words in index (both: half, word, n), of those pairs that this side of class `least` stands for: of equal halves, one of them of that length, and for last halves the first ones differ."""
    index = sorted(index, key=lambda r: (-r[2], r[1]))
    found = PositionIndex([r[1] for r in index])
    k = least // 2
    names: dict = {}
    group = lambda rows, of: np.array([names.setdefault(of(r), len(names)) for r in rows])
    half_i, half_c = group(index, lambda r: r[0]), group(calls, lambda r: r[0])
    first_i, first_c = group(index, lambda r: (r[1][:k],)), group(calls, lambda r: (r[1][:k],))
    codes, length = letters_of([r[1] for r in calls])
    short = found.of_length(np.array([least]))
    step = max(1, STEP_BITS // (64 * found.width))
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        for s in range(0, len(rows), step):
            part = rows[s : s + step]
            hit = found.near(codes[part], int(n)) & packed(half_i[None, :] == half_c[part, None])
            if n > least:
                hit &= short
            if side:
                hit &= ~packed(first_i[None, :] == first_c[part, None])
            some = np.flatnonzero(hit.any(axis=1))
            bits = np.unpackbits(hit[some].view(np.uint8), axis=1, bitorder="little")[:, : len(index)]
            for row, count, best in zip(part[some], bits.sum(axis=1, dtype=np.int64), bits.argmax(axis=1), strict=True):
                yield calls[row][1], int(count), index[best][2], index[best][1]


FOUND = "word string, n_near long, best_n long, best string"


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: partial results of each word from its blocks; n_near are to be added, and of the best the one of largest n, then smallest word, taken."""
    ship(words.sparkSession)
    keys = ["side", "class", "half"]
    blocks = written(halves(words), "spelling-blocks")
    counted = written(blocks.groupBy(*keys).agg(F.count("*").alias("members")).where("members > 1"), "spelling-sizes")
    large = counted.where(F.col("members") * (F.col("class") + 1) > PART_LETTERS).withColumn("parts", F.ceil(F.col("members") * (F.col("class") + 1) / PART_LETTERS).cast("int"))
    large = sized(written(large.drop("members"), "spelling-large"))
    calm = blocks.join(large, keys, "left_anti").select("*", F.lit(0).alias("part"), F.lit(0).alias("against"), F.lit(2).alias("role"))
    dealt = blocks.join(large, keys).withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    out = calm.unionByName(dealt.select(*keys, "word", "n", F.col("own").alias("part"), every.alias("against"), F.lit(0).alias("role")))
    out = out.unionByName(dealt.select(*keys, "word", "n", every.alias("part"), F.col("own").alias("against"), F.lit(1).alias("role")))
    order = ["side", "class", "part", "against", "half"]

    def run(batches):
        import pyarrow as pa

        def results(place, index, calls):
            if not index or not calls:
                return
            rows = list(near_in(index, calls, *place[:2]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["word", "n_near", "best_n", "best"])

        place, half, index, calls, weight = None, None, [], [], 0
        for b in batches:
            for side, c, part, against, h, word, n, role in zip(*(b.column(x).to_pylist() for x in [*order, "word", "n", "role"]), strict=True):
                here = (side, c, part, against)
                if here != place or (h != half and (len(index) >= SHARED or weight >= PART_LETTERS)):
                    yield from results(place or (0, 0), index, calls)
                    place, index, calls, weight = here, [], [], 0
                half = h
                if role != 1:
                    calls.append((h, word, n))
                if role != 0:
                    index.append((h, word, n))
                    weight += len(word)
        yield from results(place or (0, 0), index, calls)

    return out.repartition("side", "class", "part", "against", F.col("half").substr(1, 3)).sortWithinPartitions(*order).mapInArrow(run, FOUND)


def roots(forms: DataFrame, most: int) -> DataFrame:
    """word, root for each word with a form (word, form), by doubling: a round takes each word as far as its root has got.

    A form has at least LEAST_RATIO times its word's count, so that a chain has no more steps than `most`, the largest
    count, has powers of it, and the rounds end there.
    """
    at, steps, reach = forms.select("word", F.col("form").alias("root")), 1, 1
    while LEAST_RATIO**steps <= most:
        steps += 1
    while reach < steps:
        on = sized(at.select(F.col("word").alias("root"), F.col("root").alias("further")))
        at = written(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        reach *= 2
    return at


def variants(docs: DataFrame, damage: int = DAMAGE) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of docs (doc_id, text), as vocabulary() gives them.

    Near words are one inserted, deleted or replaced code point apart. The form is the near word of largest n (ties:
    smallest in code-point order) if it has at least 5 times the word's n, else null (form_n too); root follows forms to
    the last, the word itself if it has none. Tables without words give an empty result.
    """
    words = written(vocabulary(docs, damage=damage), "spelling-words")
    near = near_words(words).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))
    rated = words.join(near, "word", "left")
    is_form = -F.col("best.n") >= LEAST_RATIO * F.col("n")
    rated = written(rated.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")), "spelling-rated")
    formed = rated.where("form is not null")
    most = rated.agg(F.max("form_n")).first()[0]
    discard(words)
    if most is None:
        return rated.select("word", "form", F.col("word").alias("root"), "n", "n_near", "form_n")
    return rated.join(roots(formed, most), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: Near words through the strings that a deletion leaves; CRC-32 by its table.
OP11_SQL = r"""
WITH RECURSIVE bits AS (SELECT i, 0 AS step, i::BIGINT AS r FROM range(256) t(i)
  UNION ALL SELECT i, step + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END FROM bits WHERE step < 8),
crc AS (SELECT list(r ORDER BY i) AS t FROM bits WHERE step = 8),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM runs WHERE length(run) >= 6 GROUP BY id, run),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, (length(x) / 2)::INT), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM d, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
less AS MATERIALIZED (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM cut),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM pairs GROUP BY word),
form AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 5 * v.n THEN (SELECT min(near) FROM pairs WHERE pairs.word = v.word AND pairs.n = top) END AS form, CASE WHEN top >= 5 * v.n THEN top END::BIGINT AS form_n
         FROM v LEFT JOIN best USING (word)),
up(word, root) AS (SELECT word, word FROM form UNION SELECT up.word, form.form FROM up JOIN form ON form.word = up.root WHERE form.form IS NOT NULL)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM form f JOIN up USING (word) JOIN form e ON e.word = up.root AND e.form IS NULL
"""
