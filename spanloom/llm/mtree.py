"""Exact top-k search in an M-tree of integer vectors, best nodes first.

The tree's nodes are pivots, over all vectors that are nearest to them; pages, of bounded size, each a shell of a
pivot's vectors by their distance to it; the pages' leaves; and the vectors. Pages and leaves have a routing object, a
covering radius and their distance to the node above, vectors the distance to their leaf's routing object. With |q|,
|x| known, the inner product is (|q|^2 + |x|^2 - d(q,x)^2) / 2, so that a lower bound of the distance is an upper bound
of the score. Stored parent distances bound the distance to a page, leaf or vector before d(q, it) is computed, and
covering radii bound what is below it. Each query first searches its own pivot; the k-th score found there rules out
pivots before anything is sent to their pages, and pages, leaves and vectors in the search of the rest. Pages and
leaves are taken in order of their bounds. Bounds have slack for rounding, and scores are integers, computed exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, table, written
from .vectors import Layout, Tops, asking, best, by_dimension, cut, k_means, matrix, nearest, packed, page_rows, query_blocks, sample, search_shards, usable, with_pages

SCALE = 1024
#: One pivot for so many vectors, at most so many; shells of a pivot, at most.
PIVOT_ROWS, MOST_PIVOTS, MOST_SHELLS = 1024, 1024, 256
#: Vectors in a leaf, at most.
LEAF = 64
#: Scores beyond 64 bits count as the largest or smallest number that a long can hold and its negative can.
HIGHEST = np.iinfo(np.int64).max
LOWEST = -HIGHEST
#: Below all bounds but those of what is ruled out, which are minus infinity.
ANY = -1e300
RESULT = "query_id long, rank int, vec_id long, score long"


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of q with those of x: in doubles while all sums stay below 2^53, else in integers of any size, cut to 64 bits."""
    out = np.empty((len(q), len(x)), np.int64)
    if not out.size:
        return out
    small = np.abs(q).max(axis=1) * float(np.abs(x).max()) * q.shape[1] < 2.0**53
    out[small] = (q[small] @ x.T).astype(np.int64)
    if not small.all():
        whole = [[int(b) for b in r] for r in x]
        for i in np.flatnonzero(~small):
            a = [int(v) for v in q[i]]
            out[i] = [min(HIGHEST, max(LOWEST + 1, sum(map(int.__mul__, a, r)))) for r in whole]
    return out


def leaves(x: np.ndarray) -> list[np.ndarray]:
    """Rows of x in groups of at most LEAF near ones: a group is split by two members that are far apart."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        m = x[rows]
        a = m[np.argmax(((m - m[0]) ** 2).sum(1))]
        b = m[np.argmax(((m - a) ** 2).sum(1))]
        side = ((m - a) ** 2).sum(1) < ((m - b) ** 2).sum(1)
        if side.all() or not side.any():
            side = np.arange(len(rows)) % 2 == 0
        todo += [rows[side], rows[~side]]
    return out


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a from those of b."""
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))


def middle(x: np.ndarray) -> np.ndarray:
    return x[np.argmin(((x - x.mean(0)) ** 2).sum(1))]


PAGE = "objects binary, leaves binary, members binary, stored binary, to_object binary, centre binary, reach binary"


def build_page(x: np.ndarray, ids: np.ndarray, pivot: np.ndarray) -> dict:
    """The arrays of one page: its routing object (centre) with radius, distance to the pivot and largest square of a norm (reach); its leaves (routing objects; radius, distance to the centre, largest square, end); and its vectors in order of the leaves (id, vector, distance to the leaf's object)."""
    c = cut(x)
    groups = leaves(c)
    order = np.concatenate(groups)
    centre, objects = middle(c), np.array([middle(c[g]) for g in groups])
    to_object = np.concatenate([apart(c[g], o[None])[:, 0] for g, o in zip(groups, objects, strict=True)])
    ends = np.cumsum([len(g) for g in groups])
    starts = ends - [len(g) for g in groups]
    squares = (c[order] ** 2).sum(1)
    info = np.stack([np.maximum.reduceat(to_object, starts), apart(objects, centre[None])[:, 0], np.maximum.reduceat(squares, starts), ends.astype(float)])
    reach = np.array([apart(c, centre[None]).max(), np.sqrt(((centre - pivot) ** 2).sum()), squares.max()])
    return {"objects": packed(objects), "leaves": packed(info), "members": packed(ids[order]), "stored": packed(x[order]), "to_object": packed(to_object), "centre": packed(centre), "reach": packed(reach)}


def upper(q2, x2, least_distance):
    """Upper bound of the score of vectors with square norms up to x2 at distances of at least least_distance, with slack for rounding."""
    low = np.maximum(least_distance, 0)
    return np.maximum((q2 + x2 - low * low) / 2 + 1 + 1e-9 * (q2 + x2), float(LOWEST))


class Search:
    """A block of queries and its best so far; floor is a score that each query's k-th best of all has at least."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.q, self.c, self.given = ids, q, cut(q), floor
        self.q2, self.tops, self.computed = (self.c * self.c).sum(1), Tops(ids, k, LOWEST), 0

    def floor(self) -> np.ndarray:
        return np.maximum(self.given, np.where(self.tops.scores[:, -1] > LOWEST, self.tops.scores[:, -1].astype(float), -np.inf))

    def pages(self, pages: list, visited: np.ndarray, pivots: np.ndarray, dim: int) -> None:
        """Searches pages, those with the best bounds first; visited says for each query and cell whether it is to be searched."""
        if not pages:
            return
        cells = np.array([p.cell for p in pages])
        radius, parent, largest = np.array([np.frombuffer(p.reach) for p in pages]).T
        to_pivot = np.stack([np.sqrt(((self.c - pivots[c]) ** 2).sum(1)) for c in cells], axis=1)
        bound = upper(self.q2[:, None], largest, np.abs(to_pivot - parent) - radius)
        bound[~visited[:, cells] | (bound < self.floor()[:, None])] = -np.inf
        able = np.flatnonzero((bound > -np.inf).any(axis=0))
        distance = np.zeros(bound.shape)
        distance[:, able] = apart(self.c, np.array([np.frombuffer(pages[p].centre) for p in able]).reshape(-1, dim))
        bound[:, able] = np.minimum(bound[:, able], upper(self.q2[:, None], largest[able], distance[:, able] - radius[able]))
        for p in able[np.argsort(-bound[:, able].max(axis=0), kind="stable")]:
            rows = np.flatnonzero(bound[:, p] >= np.maximum(self.floor(), ANY))
            if len(rows):
                self.page(pages[p], rows, distance[rows, p], dim)

    def page(self, page, rows: np.ndarray, to_centre: np.ndarray, dim: int) -> None:
        objects = np.frombuffer(page.objects).reshape(-1, dim)
        radius, parent, largest, ends = np.frombuffer(page.leaves).reshape(4, -1)
        members, x, to_object = np.frombuffer(page.members, np.int64), np.frombuffer(page.stored).reshape(-1, dim), np.frombuffer(page.to_object)
        bound = upper(self.q2[rows, None], largest, np.abs(to_centre[:, None] - parent) - radius)
        bound[bound < self.floor()[rows, None]] = -np.inf
        able = np.flatnonzero((bound > -np.inf).any(axis=0))
        if not len(able):
            return
        distance = np.zeros(bound.shape)
        distance[:, able] = apart(self.c[rows], objects[able])
        bound[:, able] = np.minimum(bound[:, able], upper(self.q2[rows, None], largest[able], distance[:, able] - radius[able]))
        for leaf in able[np.argsort(-bound[:, able].max(axis=0), kind="stable")]:
            floor = np.maximum(self.floor()[rows], ANY)
            here = np.flatnonzero(bound[:, leaf] >= floor)
            if not len(here):
                continue
            start, end = int(ends[leaf - 1]) if leaf else 0, int(ends[leaf])
            c = cut(x[start:end])
            hope = upper(self.q2[rows[here], None], (c * c).sum(1), np.abs(distance[here, leaf, None] - to_object[start:end])) >= floor[here, None]
            some = np.flatnonzero(hope.any(axis=0))
            scores = products(self.q[rows[here]], x[start:end][some])
            self.computed += scores.size
            at, of = np.nonzero(hope[:, some] & (scores >= floor[here, None]) & (members[start:end][some] != self.ids[rows[here], None]))
            self.tops.add(rows[here][at], members[start:end][some][of], scores[at, of])


def search(vectors: DataFrame, is_query, k: int, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of floor(scale * component) vectors for each row of vectors (vec_id, embedding) that is_query holds for, among all rows with another vec_id.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an id; a zero
    vector is like any other. Vectors are compared with those of their own dimension. Ties go to the smaller vec_id; a
    repeated row counts each time as a candidate, and asks once. Scores beyond 64 bits count as the largest (or
    smallest) long, their order among themselves is that of the ids. Fewer candidates than k give fewer rows, an empty
    table none. Other columns are ignored.
    """
    small_batches(vectors.sparkSession, 2000)
    return by_dimension(usable(vectors, is_query, nonzero=False), lambda v, dim, n: search_one(v, dim, n, k, scale), RESULT)


def search_one(v: DataFrame, dim: int, n: int, k: int, scale: int) -> DataFrame:
    spark = v.sparkSession

    def scaled(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.nan_to_num(np.floor(x * float(scale)))

    x = cut(scaled(sample(v, dim)))
    n_pivots = max(1, min(MOST_PIVOTS, n // PIVOT_ROWS))
    pivots = spark.sparkContext.broadcast(k_means(x, n_pivots, 4))  # at most MOST_PIVOTS vectors

    def assign(batches):
        row = 0
        for b in batches:
            m = scaled(matrix(b["v"], dim))
            c = cut(m)
            cell = nearest(c, pivots.value)
            yield pd.DataFrame({"vec_id": b["vec_id"], "is_query": b["is_query"], "row": range(row, row + len(b)), "cell": cell.astype(np.int32), "vec": [packed(r) for r in m], "distance": np.sqrt(((c - pivots.value[cell]) ** 2).sum(1)), "square": (c * c).sum(1)})
            row += len(b)

    assigned = written(v.mapInPandas(assign, "vec_id long, is_query boolean, row long, cell int, vec binary, distance double, square double"), "mtree-vectors")
    roots = assigned.groupBy("cell").agg(F.count("*").alias("_n"), F.max("distance").alias("_radius"), F.max("square").alias("_square"))
    radius, largest = np.full(len(pivots.value), -np.inf), np.full(len(pivots.value), -np.inf)
    for r in roots.collect():  # a row a pivot
        radius[r["cell"]], largest[r["cell"]] = r["_radius"], r["_square"]
    # a shell for each page's worth of vectors, of equal width
    shells = F.least(F.lit(MOST_SHELLS), F.ceil(F.col("_n") / page_rows(dim)))
    shell = F.least(shells - 1, F.floor(F.coalesce(F.try_divide(F.col("distance"), F.col("_radius")), F.lit(0.0)) * shells)).cast("int")
    shelled = assigned.join(F.broadcast(roots), "cell").select("vec_id", "cell", "vec", "row", shell.alias("shell"))
    paged, n_pages = with_pages(shelled, page_rows(dim))
    layout = Layout(pivots.value, n_pages)

    def build(b: pd.DataFrame) -> pd.DataFrame:
        cell, page, m = int(b["cell"].iloc[0]), int(b["page"].iloc[0]), np.frombuffer(b"".join(b["vec"]), np.float64).reshape(-1, dim)
        return pd.DataFrame([{"shard": layout.shard(cell, page), "cell": cell, "page": page} | build_page(m, b["vec_id"].to_numpy(np.int64), pivots.value[cell])])

    pages = written(paged.select("vec_id", "cell", "page", "vec").groupBy("cell", "page").applyInPandas(build, f"shard int, cell int, page int, {PAGE}"), "mtree-pages")
    n_cells = len(pivots.value)

    def scan(blocks, of_shard):
        for b in blocks:
            ids, q = np.frombuffer(b.ids, np.int64), np.frombuffer(b.vecs, np.float64).reshape(-1, dim)
            visited = np.unpackbits(np.frombuffer(b.cells, np.uint8).reshape(len(ids), -1), axis=1, count=n_cells).astype(bool)
            s = Search(ids, q, np.frombuffer(b.floor, np.float64), k)
            s.pages(of_shard, visited, pivots.value, dim)
            yield s.tops.rows()

    answer = "query_id long, vec_id long, score long"
    queries = written(asking(assigned), "mtree-queries")
    discard(assigned)

    def only_own(batches):
        for b in batches:
            mask = np.arange(n_cells)[None, :] == b["cell"].to_numpy()[:, None]
            yield b.assign(cells=[packed(r) for r in np.packbits(mask, axis=1)], floor=-np.inf)

    schema = "vec_id long, cell int, vec binary, cells binary, floor double"
    # the innermost page of each query's own pivot
    first = search_shards(query_blocks(queries.mapInPandas(only_own, schema), layout, dim, ("floor",)), pages.where("page = 0"), scan, answer)
    floors = best(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))

    def promising(batches):
        for b in batches:
            q = cut(np.frombuffer(b"".join(b["vec"]), np.float64).reshape(-1, dim))
            floor = b["floor"].fillna(-np.inf).to_numpy(np.float64)
            q2 = (q * q).sum(1)
            mask = np.zeros((len(q), n_cells), bool)
            for c in np.flatnonzero(np.isfinite(radius)):
                mask[:, c] = upper(q2, largest[c], np.sqrt(((q - pivots.value[c]) ** 2).sum(1)) - radius[c]) >= floor
            yield b.assign(cells=[packed(r) for r in np.packbits(mask, axis=1)], floor=floor)

    second = written(queries.join(floors, "vec_id", "left").mapInPandas(promising, schema), "mtree-asked")
    return best(search_shards(query_blocks(second, layout, dim, ("floor",)), pages, scan, answer), k)


def op7_mtree(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
