"""SimHash near-dedup by multi-index hashing.

A document's fingerprint has a bit set where more than half of its shingles' hashes have it. Equal fingerprints
become one; the different ones are split into two segments of 32 bits. Of two fingerprints at most 3 bits apart,
one segment differs in at most one bit, so each fingerprint looks up the 33 values of the radius-1 ball around
each of its segments in the table of segments, and the full distance decides. Where a segment value is shared by
many fingerprints, the lookup also needs one of four bytes of the other segment to be equal (which it must be
for one of them, as at most 3 bits differ there), so that no bucket is compared as a whole.
Components come from rounds that contract links, all on tables; a fingerprint or component with many members is
joined apart from the others.

Links by a similarity of shingles need more bits, as two sets of similarity 0.8 differ in some 15 of 100. There a wide
fingerprint has the signs of weighted sums: a shingle has a weight for each bit by its hash, and two sets' bits differ
with the chance of their angle. Segments are runs of bits in several shuffled orders; sets that have one segment equal
meet, and the distance of the whole fingerprints decides who is a candidate. Length and number of segments go by the
number of sets, so that values of a segment have few of them, and follow from the chance of a miss that is asked for.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, counted_join, discard, small_batches, table, written

BITS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints with one segment value beyond which its lookups need an equal byte too.
CROWDED = 64
#: Bits of a wide fingerprint.
WIDE = 256
#: Chance that two sets of just the similarity share no segment; a third of it that they are beyond the radius, or beyond that of the first half.
MISS = 3e-5
#: Added to the chance that a bit differs: weights are bytes, so that sums over few shingles are no normal ones (4 of 5 shingles: 0.158 for 0.148).
SLACK = 0.0085
#: Sets that a value of a segment has on average, at most, and beyond twice of which it is compared in parts; bits of a segment, at least.
BUCKET, LEAST_BITS = 1 << 16, 4
#: Shingles whose weights are summed, and pairs that are compared, at a time.
SUMMED, COMPARED = 1 << 11, 1 << 18

_made = np.random.default_rng(SEED)
_A = (_made.integers(0, 1 << 63, WIDE // 8, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _made.integers(0, 1 << 63, WIDE // 8, dtype=np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_WORD = re.compile(WORD)
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text as an unsigned number."""
    import xxhash

    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        hashes = np.array([h64(" ".join(words[i : i + shingle]), SEED) for i in range(at, min(n, at + (1 << 14)))], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def close_pairs(points: DataFrame, bits: int = BITS) -> DataFrame:
    """a, b: pairs a < b of different fingerprints (column fp, distinct) that differ in at most `bits` (up to 3) bits."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    sides = points.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("side"), high.alias("seg"), low.alias("rest")), F.struct(F.lit(1).alias("side"), low.alias("seg"), high.alias("rest")))).alias("s")).select("fp", "s.*")
    crowd = written(sides.groupBy("side", "seg").count().where(F.col("count") > CROWDED).select("side", "seg"), "simhash-crowded")
    any_crowd = not crowd.isEmpty()

    def byte(col: str) -> Column:
        return F.explode(F.expr(f"transform(sequence(0, 3), j -> j * 256L + (shiftright({col}, 8 * j) & 255L))"))

    ball = F.explode(F.expr("concat(array(seg), transform(sequence(0, 31), i -> seg ^ shiftleft(1L, i)))"))
    probes = sides.select("fp", "side", "rest", ball.alias("seg"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    entries = sides.select(F.col("fp").alias("b"), "side", "seg", F.col("rest").alias("rest_b"))
    calls = probes.select(F.col("fp").alias("a"), "side", "seg", "rest")
    if not any_crowd:
        pairs = calls.join(entries, ["side", "seg"]).where((F.col("a") < F.col("b")) & near)
        return pairs.select("a", "b").distinct()
    calm = entries.join(crowd, ["side", "seg"], "left_anti")
    pairs = calls.join(calm, ["side", "seg"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    thick = entries.join(crowd, ["side", "seg"], "left_semi").select("b", "side", "seg", byte("rest_b").alias("byte"))
    more = calls.join(crowd, ["side", "seg"], "left_semi").select("a", "side", "seg", byte("rest").alias("byte")).join(thick, ["side", "seg", "byte"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    return pairs.unionByName(more).distinct()


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The words of the wide fingerprint of a set of hashes: bits are 1 where the sum of the weights, odd numbers from -255 to 255, is positive."""
    sums = np.zeros(WIDE, np.int64)
    for at in range(0, len(hashes), SUMMED):
        x = hashes[at : at + SUMMED, None] * _A + _B
        x ^= x >> np.uint64(32)
        x *= _MIX
        x ^= x >> np.uint64(29)
        weights = x.astype("<u8", copy=False).view(np.int8)
        sums += 2 * weights.sum(axis=0, dtype=np.int32).astype(np.int64) + len(x)
    return np.packbits(sums > 0, bitorder="little").view("<u8")


def _beyond(n: int, p: float, most: float) -> int:
    """The least number that of n bits, each different with chance p, no more differ but with a chance of `most`."""
    left, k = 1.0, -1
    while left > most and k < n:
        k += 1
        left -= math.comb(n, k) * p**k * (1 - p) ** (n - k)
    return k


def segments(points: int, similarity: float) -> tuple[np.ndarray, int, int]:
    """Segments for so many sets (a row of places of bits each), and the most bits that may differ in all and in the first half."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi + SLACK
    bits = min(WIDE // 4, max(LEAST_BITS, math.ceil(math.log2(max(1, points) / BUCKET))))
    differ = [(math.comb(WIDE, d) * p**d * (1 - p) ** (WIDE - d), math.comb(WIDE - d, bits) / math.comb(WIDE, bits)) for d in range(WIDE + 1)]
    n = 1
    while sum(chance * (1 - equal) ** n for chance, equal in differ) > MISS:
        n += 1 + n // 64
    made, per = np.random.default_rng(SEED + 1), WIDE // bits
    orders = [made.permutation(WIDE)[: per * bits].reshape(per, bits) for _ in range(-(-n // per))]
    return np.concatenate(orders)[:n], _beyond(WIDE, p, MISS / 3), _beyond(WIDE // 2, p, MISS / 3)


def least_linked(prints: np.ndarray, radius: int, half: int) -> np.ndarray:
    """The least member of each one's component, by links between wide fingerprints (rows of words) that differ in at most `radius` bits, and `half` in the first half."""
    n = len(prints)
    top, step = np.arange(n), max(1, COMPARED // max(1, n))
    words = np.ascontiguousarray(prints.T)
    for at in range(0, n - 1, step):
        end = min(n, at + step)
        differ = np.zeros((end - at, n - at), np.uint8)
        for w in words[: len(words) // 2]:
            differ += np.bitwise_count(w[at:end, None] ^ w[None, at:])
        a, b = np.divmod(np.flatnonzero(differ <= half), n - at)
        a, b = a[a < b] + at, b[a < b] + at
        apart = top[a] != top[b]
        a, b = a[apart], b[apart]
        near = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64) <= radius
        a, b = a[near], b[near]
        while len(a):
            low = np.minimum(top[a], top[b])
            np.minimum.at(top, top[a], low)
            np.minimum.at(top, top[b], low)
            while (top[top] != top).any():
                top = top[top]
            apart = top[a] != top[b]
            a, b = a[apart], b[apart]
    return top


def close_sets(points: DataFrame, similarity: float) -> DataFrame:
    """a, b: links whose chains join all nodes (node, wide; each node once) that share a segment and differ in few enough bits for the similarity.

    A value of a segment gives a link a node at most. One of too many nodes is compared in parts, each pair of parts apart.
    """
    small_batches(points.sparkSession)
    places, radius, half = segments(points.count(), similarity)
    powers = 1 << np.arange(places.shape[1], dtype=np.int64)
    numbers = np.arange(len(places), dtype=np.int64) << places.shape[1]

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            wide = b.column("wide").flatten().to_numpy().reshape(-1, WIDE // 64)
            bits = np.unpackbits(np.ascontiguousarray(wide).astype("<i8", copy=False).view(np.uint8), axis=1, bitorder="little")
            keys = bits[:, places].astype(np.int64) @ powers + numbers
            again = np.repeat(np.arange(len(wide)), len(places))
            columns = [pa.array(keys.reshape(-1)), b.column("node").take(pa.array(again)), *(pa.array(np.ascontiguousarray(w)) for w in wide[again].T)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "node", *words])

    def compare(batches):
        import pyarrow as pa

        def links(held):
            nodes, prints = (np.concatenate(x) for x in zip(*held, strict=True))
            top = least_linked(prints, radius, half)
            moved = np.flatnonzero(top != np.arange(len(top)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[top[moved]])], ["a", "b"])

        last, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            key, tile, node = (b.column(c).to_numpy() for c in ("key", "tile", "node"))
            prints = np.stack([b.column(w).to_numpy() for w in words], axis=1).view(np.uint64)
            starts = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1
            for start, end in zip([0, *starts], [*starts, len(key)], strict=True):
                if (key[start], tile[start]) != last and held:
                    yield links(held)
                    held = []
                last = (key[start], tile[start])
                held.append((node[start:end], prints[start:end]))
        if held:
            yield links(held)

    words = [f"w{i}" for i in range(WIDE // 64)]
    keyed = points.select("node", "wide").mapInArrow(cut, ", ".join(["key long", "node long", *(f"{w} long" for w in words)]))
    full = written(keyed.groupBy("key").count().where(F.col("count") > 2 * BUCKET).select("key", F.ceil(F.col("count") / BUCKET).cast("int").alias("parts")), "simhash-full")
    if full.isEmpty():
        dealt = keyed.withColumn("tile", F.lit(0))
    else:
        part = F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")
        tile = F.expr("explode(if(parts is null, array(0), transform(filter(sequence(0, ifnull(parts, 1) - 1), j -> j <> part), j -> least(j, part) * parts + greatest(j, part))))")
        dealt = keyed.join(sized(full), "key", "left").withColumn("part", part).withColumn("tile", tile)
    return dealt.select("key", "tile", "node", *words).repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(compare, "a long, b long")


def sized(df: DataFrame) -> DataFrame:
    """df, broadcast if it is counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def components(pairs: DataFrame) -> DataFrame:
    """node, root: a node of its component, the same for all of them, for each node of pairs (a, b); nodes without links to others are not listed.

    Each round sends every node to the one with the least hash among itself and its neighbours, and keeps the links
    between the nodes that are left. As hashes are in no order, a chain is cut in pieces at each round; the node of the
    greatest hash goes in any case, so that rounds end.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
    ends = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    links, steps = written(pairs.where("a <> b").select(*ends("a", "b")).distinct(), "links"), []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        step = written(least.select(F.col("a").alias("node"), F.least(order("a"), "m")["node"].alias("to")), "link-steps")
        steps.append(step)
        at = sized(step)
        of = lambda side, at=at: at.select(F.col("node").alias(side), F.col("to").alias(f"to_{side}"))
        new = written(links.join(of("a"), "a").join(of("b"), "b").where("to_a <> to_b").select(*ends("to_a", "to_b")).distinct(), "links")
        discard(links)
        links = new
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0].select("node", F.col("to").alias("root"))
    discard(links)
    for step in steps[1:]:
        found = found.join(sized(step).select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return found


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of docs (doc_id, text).

    Texts are lower-cased in A-Z only; fewer words than a shingle make one shingle, none (null, empty, blank) the
    fingerprint zero, which is linked like any other. component_id is the least doc_id that chains of links reach;
    rows without an id have fingerprints and link others, but never name a component (null if all lack one).
    Repeated rows count once each; other columns are ignored.

    With a similarity, links are between texts whose sets of shingles are that similar, which fingerprints of 64 bits
    can't tell: candidates are close by their wide fingerprints (close_sets), near_copies() in minhash confirms them on
    the whole sets, and gives row keys in place of fingerprints.
    """
    if similarity is not None:
        from .minhash import near_copies

        return near_copies(docs, similarity, shingle)
    fps = written(fingerprints(docs, shingle), "simhash-fps")
    points = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "simhash-points")
    roots = components(close_pairs(points.select("fp"), bits))
    named = written(points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "least_id", F.coalesce("root", "fp").alias("root")), "simhash-named")
    names = written(named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("members")), "simhash-names")
    class_of = written(counted_join(named, names, ["root"], "members").select("fp", "n", "component_id"), "simhash-classes")
    discard(points, named, names)
    return counted_join(fps, class_of, ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
