"""What the two vector searches share: usable vectors, cells and pages of bounded size, shards of neighbouring pages, blocks of queries, and the top of all answers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Rows in a page (a piece of a cell) and queries in a block, at most, about; fewer where vectors are long.
PAGE_ROWS, BLOCK_QUERIES = 1024, 256
PAGE_VALUES, BLOCK_VALUES = 1 << 17, 1 << 15
#: Pages in a shard and blocks that a task searches in it, at most; small tables have smaller shards, so that they have FEW_SHARDS all the same.
SHARD_PAGES, GROUP_BLOCKS, FEW_SHARDS = 32, 64, 16
#: Values (rows times dimensions) at most in the sample on which cells are fitted, and rows at most.
SAMPLE_VALUES, SAMPLE_ROWS = 4_000_000, 20_000
#: Different dimensions that one table may have; each is searched apart.
MOST_DIMENSIONS = 64
#: Components beyond it are cut to it where centres, codes and bounds are worked out, so that squares stay finite.
HUGE = 1e100


def usable(df: DataFrame, is_query: Column, nonzero: bool) -> DataFrame:
    """vec_id, is_query and v (array<double>) of the rows that take part: those with an id and a vector whose components are all finite (and, if asked for, not all zero)."""
    v = df.select("vec_id", F.coalesce(is_query, F.lit(False)).alias("is_query"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(finite & F.exists("v", lambda x: x != 0)) if nonzero else v.where(finite)


def by_dimension(v: DataFrame, search, schema: str) -> DataFrame:
    """What search(rows, dimension, number of rows) gives for the vectors of each dimension; a product of vectors of two dimensions is none. More than MOST_DIMENSIONS are an error."""
    dims = [(r["d"], r["count"]) for r in v.groupBy(F.size("v").alias("d")).count().orderBy("d").limit(MOST_DIMENSIONS + 1).collect()]
    if len(dims) > MOST_DIMENSIONS:
        raise ValueError(f"vectors of more than {MOST_DIMENSIONS} dimensions")
    out = None
    for d, n in dims:
        found = search(v.where(F.size("v") == d), d, n)
        out = found if out is None else out.unionByName(found)
    return v.sparkSession.createDataFrame([], schema) if out is None else out


def sample(v: DataFrame, dim: int) -> np.ndarray:
    """A bounded sample, the same in every run: the rows with the least hashes of their ids."""
    n = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // dim))
    rows = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("v").toPandas()["v"]
    return matrix(rows, dim)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre (Euclid) of each row."""
    step, half = max(1, (1 << 22) // len(centres)), 0.5 * (centres * centres).sum(1)
    return np.concatenate([np.empty(0, np.int64), *(np.argmax(x[i : i + step] @ centres.T - half, axis=1) for i in range(0, len(x), step))])


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k centres; starts from evenly spaced rows."""
    different = np.unique(x, axis=0)
    if len(different) <= k:
        return different
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def matrix(column, dim: int) -> np.ndarray:
    return np.array([np.asarray(x, dtype=np.float64) for x in column]).reshape(-1, dim)


def cut(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -HUGE, HUGE)


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def lined_up(centres: np.ndarray) -> np.ndarray:
    """An order of the centres in which neighbours are near each other: halves by the direction between two far ones, and so on."""
    todo, out = [np.arange(len(centres))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= 2:
            out.append(rows)
            continue
        m = centres[rows]
        a = m[np.argmax(((m - m[0]) ** 2).sum(1))]
        b = m[np.argmax(((m - a) ** 2).sum(1))]
        order = rows[np.argsort(m @ (b - a), kind="stable")]
        todo += [order[len(order) // 2 :], order[: len(order) // 2]]
    return np.concatenate([np.empty(0, np.int64), *out]).astype(np.int64)


class Layout:
    """Where pages lie: the cells in an order of neighbours, their pages one after the other, and each shard a stretch of them. A cell with a large share of all vectors has many pages, and lies in many shards."""

    def __init__(self, centres: np.ndarray, pages: dict[int, int]):
        self.pages = np.zeros(len(centres), np.int64)
        self.pages[list(pages)] = list(pages.values())
        self.first = np.zeros(len(centres), np.int64)
        order = lined_up(centres)
        self.first[order] = np.cumsum(self.pages[order]) - self.pages[order]
        self.size = max(1, min(SHARD_PAGES, int(self.pages.sum()) // FEW_SHARDS))

    def shard(self, cell: int, page: int) -> int:
        return int(self.first[cell] + page) // self.size

    def shards(self, cells: np.ndarray) -> list[int]:
        """The shards in which pages of the cells lie."""
        cells = cells[self.pages[cells] > 0]
        low, high = self.first[cells] // self.size, (self.first[cells] + self.pages[cells] - 1) // self.size
        return np.unique(np.concatenate([np.empty(0, np.int64), *(np.arange(a, b + 1) for a, b in zip(low, high, strict=True))])).astype(int).tolist()


def page_rows(dim: int) -> int:
    return max(16, min(PAGE_ROWS, PAGE_VALUES // dim))


def with_pages(assigned: DataFrame, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """assigned (cell, shell, row, ...) with the page of each row, and the number of pages of each cell (of which there is a bounded number): each shell of a cell is dealt by row numbers over as many pages as it needs, so that no page grows with the input."""
    shells = assigned.groupBy("cell", "shell").agg(F.ceil(F.count("*") / rows).cast("int").alias("_slices"))
    shells = written(shells.withColumn("_before", F.sum("_slices").over(Window.partitionBy("cell").orderBy("shell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_slices")), "vector-shells")
    pages = {r["cell"]: r["n"] for r in shells.groupBy("cell").agg(F.sum("_slices").alias("n")).collect()}
    return assigned.join(shells, ["cell", "shell"]).withColumn("page", (F.col("_before") + F.pmod("row", F.col("_slices"))).cast("int")).drop("_slices", "_before"), pages


def asking(assigned: DataFrame) -> DataFrame:
    """vec_id, cell, vec of the queries; rows that share an id ask once, with the least of their vectors."""
    return assigned.where("is_query").groupBy("vec_id").agg(F.min(F.struct("vec", "cell")).alias("q")).select("vec_id", "q.cell", "q.vec")


def query_blocks(queries: DataFrame, layout: Layout, dim: int, extra: tuple = ()) -> DataFrame:
    """queries (vec_id, vec binary, cell, cells binary, *extra doubles) put into blocks of queries of neighbouring cells: block, ids, vecs, cells (packed bits for each query and cell), extra, and shards (those with a page of a cell that any of them visits)."""
    most, n_cells = max(16, min(BLOCK_QUERIES, BLOCK_VALUES // dim)), len(layout.pages)
    # neighbouring cells share blocks where they have few queries
    counts = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    of, run, filled = {}, 0, 0
    for c in sorted(counts, key=lambda c: (layout.first[c], c)):
        if filled and filled + counts[c] > most:
            run, filled = run + 1, 0
        of[c] = run
        filled += counts[c]
    parts: dict[int, int] = {}
    for c, r in of.items():
        parts[r] = parts.get(r, 0) + counts[c]
    spark = queries.sparkSession
    # a row a cell
    runs = spark.createDataFrame([(int(c), r, -(-parts[r] // most)) for c, r in of.items()], "cell int, run int, parts int")

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        bits = np.frombuffer(b"".join(b["cells"]), np.uint8).reshape(len(b), -1)
        wanted = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits, axis=0), count=n_cells))
        row = {"block": f"{b['run'].iloc[0]}-{b['part'].iloc[0]}", "ids": packed(b["vec_id"].to_numpy(np.int64)), "vecs": b"".join(b["vec"]), "cells": packed(bits), "shards": layout.shards(wanted)}
        return pd.DataFrame([row | {x: packed(b[x].to_numpy(np.float64)) for x in extra}])

    dealt = queries.join(F.broadcast(runs), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    return dealt.groupBy("run", "part").applyInPandas(pack, "block string, ids binary, vecs binary, cells binary, shards array<int>" + "".join(f", {x} binary" for x in extra))


def search_shards(blocks: DataFrame, pages: DataFrame, scan, schema: str) -> DataFrame:
    """What scan(blocks, pages) gives for the blocks of queries that visit a shard and the pages of that shard; both are lists of named tuples.

    A block goes to the shards that it visits only, and a shard's pages once to every GROUP_BLOCKS such blocks, so
    that what is moved is in proportion to what is visited, and a task holds a bounded part of either side.
    """
    blocks = written(blocks, "query-blocks")
    calls = blocks.withColumn("shard", F.explode("shards"))
    groups = calls.groupBy("shard").agg(F.ceil(F.count("*") / GROUP_BLOCKS).cast("int").alias("_groups"))
    left = calls.join(groups, "shard").withColumn("group", F.pmod(F.xxhash64("block"), F.col("_groups")).cast("int")).drop("_groups")
    right = pages.join(groups, "shard").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))).drop("_groups")
    names = [x.split()[0] for x in schema.split(", ")]

    def both(of_blocks: pd.DataFrame, of_pages: pd.DataFrame) -> pd.DataFrame:
        found = [x for x in scan(list(of_blocks.itertuples(index=False)), list(of_pages.itertuples(index=False))) if len(x)]
        return pd.concat(found) if found else pd.DataFrame({n: [] for n in names})

    return left.groupBy("shard", "group").cogroup(right.groupBy("shard", "group")).applyInPandas(both, schema)


class Tops:
    """The k best of each query of a block, as matrices of ids and scores, filled up with -1 and a score below all others."""

    def __init__(self, queries: np.ndarray, k: int, lowest):
        self.queries, self.lowest = queries, lowest
        self.ids, self.scores = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), lowest)

    def add(self, rows: np.ndarray, new_ids: np.ndarray, new_scores: np.ndarray) -> None:
        """Puts new candidates (row, id, score) among the best of their rows: higher scores first, ties to the smaller id."""
        if not len(rows):
            return
        k = self.ids.shape[1]
        touched = np.unique(rows)
        r = np.concatenate([np.repeat(touched, k), rows])
        i, s = np.concatenate([self.ids[touched].ravel(), new_ids]), np.concatenate([self.scores[touched].ravel(), new_scores])
        order = np.lexsort((i, -s, r))
        r, i, s = r[order], i[order], s[order]
        first = np.searchsorted(r, touched)
        place = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
        keep = place < k
        self.ids[r[keep], place[keep]], self.scores[r[keep], place[keep]] = i[keep], s[keep]

    def rows(self) -> pd.DataFrame:
        there = self.scores > self.lowest
        return pd.DataFrame({"query_id": np.repeat(self.queries, there.sum(1)), "vec_id": self.ids[there], "score": self.scores[there]})


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
