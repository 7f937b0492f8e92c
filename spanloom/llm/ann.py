"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Every vector belongs to the list of its nearest centroid and is stored as the codes of its residual, a byte for
each group of components, beside the vector itself. A query visits the lists whose centroids score best, empty ones
passed over, and goes on while these hold too few vectors; within a list a table of inner products of the query with
all code words (the asymmetric distances) scores the codes by lookups, and the best of them are scored again on the
original vectors in double precision. Centroids and code books are fitted on a bounded sample; how many lists a query
visits is measured on the sample too, so that it is as small as the data allow; every vector is indexed. Lists are
stored in pages of bounded size, so that a list with a large share of all vectors is many pages, and queries go to the
shards of the lists that they visit only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, written
from .vectors import Layout, Tops, asking, best, by_dimension, cut, k_means, matrix, nearest, packed, page_rows, query_blocks, sample, search_shards, usable, with_pages

#: One list for so many vectors, at most so many.
LIST_ROWS, MOST_LISTS = 256, 1024
#: Components in a group, and code words for each.
GROUP, WORDS = 4, 256
#: Share of true neighbours whose lists a query should visit, as measured on the sample with so many queries.
COVER, TRIALS = 0.97, 400
#: Best codes of a page that are scored again while a query has no k answers, in multiples of k; later those whose
#: score by codes comes within so many standard errors of its k-th best.
RERANK, ERRORS = 4, 3.0


class Index:
    """Centroids, code books and the number of lists to visit."""

    def __init__(self, x: np.ndarray, n_rows: int, k: int):
        dim = x.shape[1]
        self.centres = k_means(x, max(1, min(MOST_LISTS, n_rows // LIST_ROWS)))
        self.groups = [range(i, min(i + GROUP, dim)) for i in range(0, dim, GROUP)]
        residual = x - self.centres[nearest(x, self.centres)]
        self.books = [k_means(residual[:, g], WORDS, 5) for g in self.groups]
        # how far a score by codes is off, for a query of unit length
        coded = np.concatenate([b[nearest(residual[:, g], b)] for g, b in zip(self.groups, self.books, strict=True)], axis=1)
        self.error = float(np.sqrt(((residual - coded) ** 2).mean()))
        self.visits = self.measured(x, k)

    def measured(self, x: np.ndarray, k: int) -> int:
        """The least number of lists that hold COVER of the sample's true neighbours within the sample. The full table has nearer ones, which lie in nearer lists, so this errs to more lists."""
        n_lists = len(self.centres)
        if len(x) <= k + 1 or n_lists == 1:
            return n_lists
        at = np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int)
        scores = x[at] @ x.T
        scores[np.arange(len(at)), at] = -np.inf
        top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        order = np.argsort(-(x[at] @ self.centres.T), axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(n_lists)[None, :], axis=1)
        seen = np.sort(np.take_along_axis(rank, nearest(x, self.centres)[top], axis=1).ravel())
        return int(seen[min(len(seen) - 1, int(COVER * len(seen)))]) + 1

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        residual = x - self.centres[cell]
        return np.stack([nearest(residual[:, g], b) for g, b in zip(self.groups, self.books, strict=True)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each group the inner products of each query with the code words."""
        return [q[:, g] @ b.T for g, b in zip(self.groups, self.books, strict=True)]


RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, is_query, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products found for each row of vectors (vec_id, embedding) that the condition is_query holds for, among all rows with another vec_id.

    Vectors that are null, zero, empty or hold null or non-finite components take no part, nor do rows without an id.
    Vectors are compared with those of their own dimension. Ties go to the smaller vec_id; a repeated row counts each
    time as a candidate, and asks once. Products beyond the range of doubles count as the largest or smallest double,
    undefined ones (infinity less infinity) as the smallest. Fewer than k candidates give fewer rows, an empty table
    none. Other columns are ignored.
    """
    small_batches(vectors.sparkSession, 2000)
    return by_dimension(usable(vectors, is_query, nonzero=True), lambda v, dim, n: search_one(v, dim, n, k), RESULT)


def search_one(v: DataFrame, dim: int, n: int, k: int) -> DataFrame:
    spark = v.sparkSession
    index = spark.sparkContext.broadcast(Index(cut(sample(v, dim)), n, k))  # bounded by MOST_LISTS and WORDS

    def assign(batches):
        row = 0
        for b in batches:
            m = matrix(b["v"], dim)
            c = cut(m)
            cell = nearest(c, index.value.centres)
            yield pd.DataFrame({"vec_id": b["vec_id"], "is_query": b["is_query"], "row": range(row, row + len(b)), "cell": cell.astype(np.int32), "vec": [packed(r) for r in m], "codes": [packed(r) for r in index.value.codes(c, cell)]})
            row += len(b)

    assigned = written(v.mapInPandas(assign, "vec_id long, is_query boolean, row long, cell int, vec binary, codes binary"), "ann-index")
    paged, n_pages = with_pages(assigned.select("vec_id", "cell", "vec", "codes", "row", F.lit(0).alias("shell")), page_rows(dim))
    layout, n_lists = Layout(index.value.centres, n_pages), len(index.value.centres)

    def page(b: pd.DataFrame) -> pd.DataFrame:
        cell, number = int(b["cell"].iloc[0]), int(b["page"].iloc[0])
        return pd.DataFrame([{"shard": layout.shard(cell, number), "cell": cell, "page": number, "members": packed(b["vec_id"].to_numpy(np.int64)), "stored": b"".join(b["vec"]), "codes": b"".join(b["codes"])}])

    pages = paged.select("vec_id", "cell", "page", "vec", "codes").groupBy("cell", "page").applyInPandas(page, "shard int, cell int, page int, members binary, stored binary, codes binary")

    held = np.zeros(n_lists, np.int64)
    for r in assigned.groupBy("cell").count().collect():  # a row a list: MOST_LISTS at most
        held[r["cell"]] = r["count"]
    filled = np.flatnonzero(held)

    def route(batches):
        for b in batches:
            q = cut(np.frombuffer(b"".join(b["vec"]), np.float64).reshape(-1, dim))
            near = filled[np.argsort(-(q @ index.value.centres[filled].T), axis=1)]
            # before a list: how many vectors the better ones hold
            before = np.cumsum(held[near], axis=1) - held[near]
            visit = (np.arange(len(filled)) < index.value.visits) | (before < RERANK * k)
            mask = np.zeros((len(q), n_lists), bool)
            np.put_along_axis(mask, near, visit, axis=1)
            yield b[["vec_id", "cell", "vec"]].assign(cells=[packed(r) for r in np.packbits(mask, axis=1)])

    queries = written(asking(assigned).mapInPandas(route, "vec_id long, cell int, vec binary, cells binary"), "ann-queries")

    def scan(blocks, of_shard):
        for b in blocks:
            ids, q = np.frombuffer(b.ids, np.int64), np.frombuffer(b.vecs, np.float64).reshape(-1, dim)
            mask = np.unpackbits(np.frombuffer(b.cells, np.uint8).reshape(len(ids), -1), axis=1, count=n_lists).astype(bool)
            c, tops = cut(q), Tops(ids, k, -np.inf)
            tables, by_centre, slack = index.value.tables(c), c @ index.value.centres.T, ERRORS * index.value.error * np.sqrt((c * c).sum(1))
            for p in of_shard:
                visit = np.flatnonzero(mask[:, p.cell])
                if not len(visit):
                    continue
                members, stored = np.frombuffer(p.members, np.int64), np.frombuffer(p.stored, np.float64).reshape(-1, dim)
                codes = np.frombuffer(p.codes, np.uint8).reshape(len(members), -1)
                near = by_centre[visit, p.cell][:, None] + np.zeros(len(members))
                for g, t in enumerate(tables):
                    near += t[visit].take(codes[:, g], axis=1)
                floor = tops.scores[visit, k - 1] - slack[visit]
                most = RERANK * k
                if len(members) > most and not np.isfinite(floor).all():
                    # without k answers yet: the best of the page by codes, all ties with the last of them included
                    empty = ~np.isfinite(floor)
                    floor[empty] = np.partition(near[empty], len(members) - most, axis=1)[:, len(members) - most]
                rows, at = np.nonzero((near >= floor[:, None]) & (members[None, :] != ids[visit][:, None]))
                rows = visit[rows]
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = np.nan_to_num(np.einsum("ij,ij->i", stored[at], q[rows]), nan=-np.finfo(float).max)
                tops.add(rows, members[at], scores)
            yield tops.rows()

    return best(search_shards(query_blocks(queries, layout, dim), pages, scan, "query_id long, vec_id long, score double"), k)


def op6_ann(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
