"""Near-dedup by circulant MinHash.

A document's set is its distinct shingles. MinHash needs many random permutations of all shingles; here two do for any
number of them. The first scatters the shingles over a ring of 2^64 places, so that no structure of theirs is left. The
second gives each place of the ring its rank, and turned by one step more for each coordinate it is a new permutation:
coordinate k is the least rank of the set's places after k turns. Coordinates are banded; sets that share a band are
candidates, and the sets themselves decide, in whole: chains of candidates are compared as in minhash.py, so that
copies in their thousands are linked without listing their pairs.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, counted_join, discard, small_batches, table, written
from .minhash import CROWD, MEMO, large_crowds, small_crowds
from .simhash import _LOWER, SEED, components, sized

SHINGLE, SIMILARITY = 2, 0.8
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^32, 3e-6.
BANDS, ROWS = 32, 5
#: One turn of the ring: odd, so that turns come to every place, and far from small multiples of it.
TURN = np.uint64(0x9E3779B97F4A7C15)
#: Shingles that are turned at a time, so that their ranks stay in a core's cache.
BLOCK = 256
#: Nodes whose keys are broadcast, to leave sets that no other shares a band with out of a shuffle: 8 MB of keys.
BROADCAST_KEYS = 1_000_000

_WORD = re.compile(WORD)


def scattered(x: np.ndarray) -> np.ndarray:
    """The first permutation of 64-bit numbers: multiplications by odd numbers and shifts, each of which can be undone."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rank_at(x: np.ndarray) -> np.ndarray:
    """The second permutation: the rank of each place of the ring. x is overwritten."""
    shifted = np.empty_like(x)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        np.right_shift(x, np.uint64(shift), out=shifted)
        np.bitwise_xor(x, shifted, out=x)
        if factor != 1:
            np.multiply(x, np.uint64(factor), out=x)
    return x


def signature(hashes: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """The coordinates of a set that isn't empty."""
    places, turns = scattered(hashes), np.arange(coordinates, dtype=np.uint64) * TURN
    least = np.full(coordinates, np.iinfo(np.uint64).max)
    for at in range(0, len(places), BLOCK):
        np.minimum(least, rank_at(places[at : at + BLOCK, None] + turns[None, :]).min(axis=0), out=least)
    return least


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The different hashes of a text's shingles, ascending. Fewer words than a shingle make one, none the empty set."""
    import xxhash

    words = _WORD.findall((text or "").translate(_LOWER))
    h64 = xxhash.xxh64_intdigest
    shingles = {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else ()
    return np.unique(np.fromiter((h64(s, SEED) for s in shingles), np.uint64, len(shingles)))


def band_values(coordinates: np.ndarray, rows: int = ROWS) -> list[int]:
    """The values of the bands as signed longs; different bands have different values."""
    import xxhash

    return [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(coordinates.reshape(-1, rows))]


SKETCH = "doc_id long, node long, n_shingles long, bands array<long>, set array<long>"


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, node (a hash of the set; null if it is empty), n_shingles, and bands and set (hashes of shingles) of each row; a task gives the latter two once for each node, about, so that many copies have few sets."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        import xxhash

        seen, copies = set(), {}
        for b in batches:
            nodes, sizes, values, sets = [], [], [], []
            for t in b.column("text").to_pylist():
                text = xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass"))
                if text in copies:
                    node, n = copies[text]
                    nodes.append(node)
                    sizes.append(n)
                    values.append(None)
                    sets.append(None)
                    continue
                hashes = shingle_set(t, size)
                node = xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63) if len(hashes) else None
                known = node is None or node in seen
                if not known and len(seen) < MEMO:
                    seen.add(node)
                if len(copies) < MEMO:
                    copies[text] = node, len(hashes)
                nodes.append(node)
                sizes.append(len(hashes))
                values.append(None if known else band_values(signature(hashes)))
                sets.append(None if known else hashes.view(np.int64))
            columns = [b.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(values, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SKETCH.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def near_sets(rows: DataFrame, similarity: float) -> DataFrame:
    """node, root of the nodes of rows (as of sketches()) that are linked to others, and perhaps of some that aren't."""
    entries = rows.where("bands is not null").select("node", F.explode("bands").alias("value"))
    # a task gives a node's values once, so that a value has few rows of one node
    groups = written(entries.groupBy("value").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").drop("high"), "circulant-values")
    chained = counted_join(entries, groups, ["value"], "n").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    crowd = written(components(chained).withColumnRenamed("root", "crowd"), "circulant-crowds")
    sizes = written(crowd.groupBy("crowd").agg(F.count("*").alias("members")), "circulant-sizes")
    member = counted_join(crowd, sizes, ["crowd"], "members")
    sets = rows.where("set is not null").select("node", "set")
    if crowd.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        sets = sets.join(F.broadcast(crowd.select("node")), "node", "left_semi")
    sets = sets.join(member, "node").groupBy("node")
    sets = written(sets.agg(F.first("set").alias("set"), F.first("crowd").alias("crowd"), F.first("members").alias("members")), "circulant-sets")
    root = small_crowds(sets.where(F.col("members") <= CROWD), similarity)
    large = sets.where(F.col("members") > CROWD)
    if not large.isEmpty():
        root = root.unionByName(large_crowds(large, similarity))
    root = written(root, "circulant-roots")
    discard(groups, crowd, sizes, sets)
    return root


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text).

    Sets are of shingles of words, lower-cased in A-Z only; a text of fewer words than a shingle is one. Links are
    between sets of at least the similarity (Jaccard), found through bands and confirmed on the whole sets.
    component_id is the least doc_id that chains of links reach, and the document of that id is kept. Texts without
    words (null, empty, blank) have an empty set and are linked with nothing, so each is its own component. Rows
    without an id link others but name no component (null if all lack one) and aren't kept. Repeated rows each have a
    row; other columns are ignored; an empty table gives an empty result.
    """
    rows = written(sketches(docs, size), "circulant-sketches")
    filled = rows.where("node is not null")
    nodes = written(filled.groupBy("node").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least")), "circulant-nodes")
    root = near_sets(rows, similarity)
    named = written(nodes.join(sized(root), "node", "left").select("node", "rows", "least", F.coalesce("root", "node").alias("root")), "circulant-named")
    names = written(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "circulant-names")
    of_node = written(counted_join(named, names, ["root"], "members").select("node", "rows", "component_id"), "circulant-classes")
    discard(nodes, root, named, names)
    found = counted_join(filled.select("doc_id", "node", "n_shingles"), of_node, ["node"], "rows").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op13_circulant(spark, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


#: All pairs with a common shingle, and what links reach.
OP13_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
f AS (SELECT DISTINCT doc_id, n, x FROM e),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.x = b.x AND a.doc_id <> b.doc_id AND 5 * b.n >= 4 * a.n AND 5 * a.n >= 4 * b.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT s.doc_id, len(s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id FROM s LEFT JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, len(s))
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM c
"""
