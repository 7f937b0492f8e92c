"""Near copies by similarity of shingles: wide SimHash fingerprints find candidates, the shingles themselves decide.

A document's set is the hashes of its shingles (runs of words). Equal sets become one node. close_sets() in simhash
looks nodes up by segments of their fingerprints and joins those within the radius of the similarity, with a chance of
5e-5 at most that it misses a pair of just that similarity; chains of candidates are a crowd. A pair that is missed
may be in one crowd all the same; no other pair is left out. The sets of a small crowd are compared with each other in
one go. A large crowd is dealt in parts, each of which is compared with the same few of its nodes, which links most
copies of one text; then what is left outside of the largest component is compared with all, in blocks. Only links
between what isn't linked yet are given out, so that no crowd's pairs are listed.

The module has its name from the bands of minima that found candidates before; there are none any more.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, counted_join, discard, small_batches, written
from .line_dedup import row_key
from .simhash import _LOWER, SEED, close_sets, components, sized, wide_fingerprint

SHINGLE, SIMILARITY = 5, 0.8
#: Nodes of a crowd that are compared in one go; of a larger one so many are compared with all, and make a block.
CROWD = 256
#: Shingles whose columns are multiplied at a time.
COLUMNS = 1 << 15
#: Sets that a task remembers to have given already.
MEMO = 500_000

_WORD = re.compile(WORD)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The different hashes of a text's shingles, ascending. Fewer words than a shingle make one, none the empty one."""
    import xxhash

    words = _WORD.findall((text or "").translate(_LOWER))
    h64 = xxhash.xxh64_intdigest
    return np.unique(np.array([h64(" ".join(words[i : i + size]), SEED) for i in range(max(1, len(words) - size + 1))], dtype=np.uint64))


SKETCH = "row_key binary, doc_id long, node long, wide array<long>, set array<int>"


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """row_key, doc_id, node (a hash of the set), and wide (the fingerprint's words) and set (the shingles' hashes cut to 32 bits) of each row; a task gives the latter two once for each node, about, so that many copies have few sets."""
    keyed = docs.select(row_key(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        import xxhash

        seen = set()
        for b in batches:
            nodes, values, sets = [], [], []
            for t in b.column("text").to_pylist():
                hashes = shingles(t, size)
                node = xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)
                again = node in seen
                if not again and len(seen) < MEMO:
                    seen.add(node)
                nodes.append(node)
                values.append(None if again else wide_fingerprint(hashes).view(np.int64))
                sets.append(None if again else np.unique(hashes.astype(np.uint32)).view(np.int32))
            columns = [b.column("row_key"), b.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(values, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SKETCH.split(", ")])

    return keyed.mapInArrow(run, SKETCH)


def alike(a: list[np.ndarray], b: list[np.ndarray], least: float) -> np.ndarray:
    """Whether each set of a and each of b are so similar (Jaccard), as a matrix. Sets are ascending arrays without repeats."""
    size_a, size_b = np.array([len(x) for x in a], float), np.array([len(x) for x in b], float)
    both = np.zeros((len(a), len(b)), np.float32)
    if len(a) * len(b) <= 4:
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                both[i, j] = len(x) if x is y else len(np.intersect1d(x, y, assume_unique=True))
    else:
        all_a, all_b = np.concatenate(a), np.concatenate(b)
        known = np.intersect1d(all_a, all_b)
        row_a, row_b = np.repeat(np.arange(len(a)), size_a.astype(int)), np.repeat(np.arange(len(b)), size_b.astype(int))
        place = lambda x: np.minimum(np.searchsorted(known, x), max(0, len(known) - 1))
        at_a, at_b = place(all_a), place(all_b)
        in_a, in_b = (known[at_a] == all_a, known[at_b] == all_b) if len(known) else (np.zeros(len(all_a), bool), np.zeros(len(all_b), bool))
        for c in range(0, len(known), COLUMNS):
            width = min(COLUMNS, len(known) - c)
            one, two = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
            for m, rows, at, there in ((one, row_a, at_a, in_a), (two, row_b, at_b, in_b)):
                own = there & (at >= c) & (at < c + width)
                m[rows[own], at[own] - c] = 1
            both += one @ two.T
    return both >= least * (size_a[:, None] + size_b[None, :] - both) - 1e-6


def tops(links: np.ndarray) -> np.ndarray:
    """The least member of each one's component, by a symmetric matrix of links."""
    top = np.full(len(links), -1)
    for i in range(len(links)):
        if top[i] >= 0:
            continue
        front = np.zeros(len(links), bool)
        front[i], seen = True, np.zeros(len(links), bool)
        while front.any():
            seen |= front
            front = links[front].any(axis=0) & ~seen
        top[seen] = i
    return top


def _sets(batch) -> list[np.ndarray]:
    column = batch.column("set")
    values, ends = column.flatten().to_numpy(), np.cumsum([len(x) for x in column])
    return [values[e - n : e] for e, n in zip(ends, np.diff(np.concatenate([[0], ends])), strict=True)]


def small_crowds(sets: DataFrame, least: float) -> DataFrame:
    """node, root of the nodes (node, set, crowd) of crowds that are compared in one go."""

    def run(batches):
        import pyarrow as pa

        held: list = [None, [], []]

        def done():
            out = tops(alike(held[2], held[2], least)) if held[1] else []
            return pa.RecordBatch.from_arrays([pa.array(held[1], pa.int64()), pa.array([held[1][t] for t in out], pa.int64())], ["node", "root"])

        for b in batches:
            for crowd, node, own in zip(b.column("crowd").to_pylist(), b.column("node").to_pylist(), _sets(b), strict=True):
                if crowd != held[0]:
                    if held[1]:
                        yield done()
                    held[:] = [crowd, [], []]
                held[1].append(node)
                held[2].append(own.copy())
        if held[1]:
            yield done()

    return sets.select("crowd", "node", "set").repartition("crowd").sortWithinPartitions("crowd", "node").mapInArrow(run, "node long, root long")


def crossed(left: DataFrame, right: DataFrame, keys: list[str], least: float) -> DataFrame:
    """a, b: links between similar sets of left and right (node, set, top, *keys) of equal keys and different tops. Of the links of one node to nodes of one top, or to nodes that are linked among themselves, one is given."""

    def both(x, y):
        import pandas as pd

        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []})
        y.columns = [c.removeprefix("r_") for c in y.columns]
        own, other = [np.asarray(v) for v in x["set"]], [np.asarray(v) for v in y["set"]]
        names = y["top"].to_numpy()
        inner = alike(other, other, least) | (names[:, None] == names[None, :])
        group = tops(inner)
        hit = alike(own, other, least) & (x["top"].to_numpy()[:, None] != names[None, :])
        out = []
        for g in np.unique(group):
            members = np.flatnonzero(group == g)
            rows = np.flatnonzero(hit[:, members].any(axis=1))
            out.append(np.stack([x["node"].to_numpy()[rows], y["node"].to_numpy()[members[hit[rows][:, members].argmax(axis=1)]]], axis=1))
            # the members of a group are linked among themselves, or have one top
            far = [m for m in members[1:] if names[m] != names[members[0]]]
            out.append(np.stack([y["node"].to_numpy()[[members[0]] * len(far)], y["node"].to_numpy()[far]], axis=1).reshape(-1, 2))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    # both sides come from one table, and need names of their own
    renamed = right.toDF(*[f"r_{c}" for c in right.columns])
    return left.groupBy(*keys).cogroup(renamed.groupBy(*[f"r_{k}" for k in keys])).applyInPandas(both, "a long, b long")


def large_crowds(sets: DataFrame, least: float) -> DataFrame:
    """node, root of the nodes (node, set, crowd, members) of crowds that are too large for one go."""
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("members") / CROWD)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = sets.withColumn("part", part).withColumn("top", F.col("node"))
    # about CROWD nodes of each crowd, by a hash, so that none is ranked
    few = sets.where(F.pmod(F.xxhash64("node", F.lit(3)), F.col("members")) < CROWD)
    few = few.withColumn("part", every(F.ceil(F.col("members") / CROWD).cast("int"))).withColumn("top", F.col("node"))
    links = written(crossed(dealt.select("crowd", "part", "node", "set", "top"), few.select("crowd", "part", "node", "set", "top"), ["crowd", "part"], least).distinct(), "minhash-links")
    root = written(components(links), "minhash-roots")
    named = written(sets.select("node", "crowd", "members").join(sized(root), "node", "left").select("node", "crowd", "members", F.coalesce("root", "node").alias("top")), "minhash-tops")
    largest = named.groupBy("crowd", "top").agg(F.count("*").alias("n")).groupBy("crowd").agg(F.max(F.struct("n", "top"))["top"].alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).where(F.col("all") > F.col("most"))
    left_out = written(named.join(sized(largest), "crowd").where(F.col("top") != F.col("main")).select("node", "crowd", "top", "members", (F.col("all") - F.col("most")).alias("strays")), "minhash-strays")
    if not left_out.isEmpty():
        blocks = F.ceil(F.col("strays") / CROWD).cast("int")
        counts = left_out.groupBy("crowd").agg(F.first("strays").alias("strays"))
        own = sets.select("node", "set", "crowd", "members").join(named.select("node", "top"), "node").join(sized(counts), "crowd")
        members = own.withColumn("part", part).withColumn("block", every(blocks)).select("crowd", "part", "block", "node", "set", "top")
        strays = sets.select("node", "set").join(left_out, "node").withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), blocks).cast("int"))
        strays = strays.withColumn("part", every(F.ceil(F.col("members") / CROWD).cast("int"))).select("crowd", "part", "block", "node", "set", "top")
        more = written(crossed(members, strays, ["crowd", "part", "block"], least).distinct(), "minhash-links")
        if not more.isEmpty():
            root = written(components(links.unionByName(more)), "minhash-roots")
    return sets.select("node").join(sized(root), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """row_key, doc_id, component_id, keep_key of each row of docs (doc_id, text).

    Components are of links between texts whose shingle sets have at least the similarity. component_id is the least
    doc_id of the component, keep_key the row key of the least (doc_id, row key); rows without an id link others but
    are no keepers (both null if all lack one). Texts are lower-cased in A-Z only; null, empty and blank texts have
    the same set. Repeated rows each have a row; other columns are ignored; an empty table gives an empty result.
    """
    rows = written(sketches(docs, size), "minhash-sketches")
    place = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row_key"))
    nodes = written(rows.groupBy("node").agg(F.count("*").alias("rows"), F.min(place).alias("least"), F.max("wide").alias("wide")), "minhash-nodes")
    chained = close_sets(nodes, similarity)
    crowd = written(components(chained).withColumnRenamed("root", "crowd"), "minhash-crowds")
    sizes = written(crowd.groupBy("crowd").agg(F.count("*").alias("members")), "minhash-sizes")
    member = counted_join(crowd, sizes, ["crowd"], "members")
    sets = written(rows.where("set is not null").select("node", "set").join(member, "node").groupBy("node").agg(F.first("set").alias("set"), F.first("crowd").alias("crowd"), F.first("members").alias("members")), "minhash-sets")
    root = small_crowds(sets.where(F.col("members") <= CROWD), similarity)
    large = sets.where(F.col("members") > CROWD)
    if not large.isEmpty():
        root = root.unionByName(large_crowds(large, similarity))
    root = written(root, "minhash-roots")
    named = written(nodes.join(sized(root), "node", "left").select("node", "rows", "least", F.coalesce("root", "node").alias("root")), "minhash-named")
    keepers = written(named.groupBy("root").agg(F.min("least").alias("keep"), F.count("*").alias("members")), "minhash-keepers")
    per_node = written(counted_join(named, keepers, ["root"], "members").select("node", "rows", "keep"), "minhash-classes")
    discard(nodes, crowd, sizes, sets, root, named, keepers)
    found = counted_join(rows.select("row_key", "doc_id", "node"), per_node, ["node"], "rows")
    return found.select("row_key", "doc_id", F.col("keep.doc_id").alias("component_id"), F.col("keep.row_key").alias("keep_key"))
