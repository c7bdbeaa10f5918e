"""Approximate nearest neighbours: inverted lists searched with an adaptive scan of rotated dimensions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafuse.llm.common import cut, table

K = 10
EVERY = 100
#: The index is fitted on a sample of PER_LIST vectors a list, within these bounds; every vector is indexed. Lists grow with
#: the root of the table, up to MOST_SAMPLE / PER_LIST of them.
LEAST_SAMPLE, MOST_SAMPLE, PER_LIST, ROUNDS = 16384, 131072, 32, 8
#: Of the sample so many vectors bound each query's search.
BOUNDING = 16384
#: Lists to probe are set so that the sample's own neighbours are found at this rate.
RECALL = 0.98
#: Vectors and queries of a list are dealt in blocks of about so many.
BLOCK = 4096
#: Columns that one step of the scan adds, and the width of its hypothesis test.
COLUMNS, EPSILON = 16, 2.4
SEED = 17
OUT = "query_id long, rank int, vec_id long, score double"


def usable(vector: Column) -> Column:
    """True for a vector that has only finite components, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Index:
    """Rotation, centroids, number of lists to probe, and the sample that bounds each query's search."""

    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    sample_ids: np.ndarray
    sample: np.ndarray

    def lists(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each row, nearest first."""
        near = (self.centroids**2).sum(axis=1) / 2 - x @ self.centroids.T
        if n == 1:
            return near.argmin(axis=1)[:, None]
        return np.argsort(near, axis=1, kind="stable")[:, :n]

    def probed(self, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists of each row, nearest first, how many of them it probes, and a distance within which these hold k neighbours.

        A row probes more lists than usual until they hold k others of the sample for sure; the distance is
        that of the k-th of these. If the sample has not k others, all lists are probed without a bound.
        """
        order = self.lists(x, len(self.centroids)) if len(self.centroids) > 1 else np.zeros((len(x), 1), int)
        own = self.lists(self.sample, 1)[:, 0] if len(self.sample) else np.empty(0, int)
        size = np.bincount(own, minlength=len(self.centroids))
        enough = np.cumsum(size[order], axis=1) > k  # one of them may be the row itself
        probes = np.where(enough[:, -1], np.maximum(self.probes, enough.argmax(axis=1) + 1), len(self.centroids))
        if len(self.sample) <= k:
            return order, probes, np.full(len(x), np.inf)
        d = np.maximum((x**2).sum(axis=1)[:, None] + (self.sample**2).sum(axis=1) - 2 * x @ self.sample.T, 0)
        place = np.argsort(order, axis=1)
        d[(ids[:, None] == self.sample_ids) | (place[:, own] >= probes[:, None])] = np.inf
        return order, probes, np.sqrt(np.partition(d, k - 1, axis=1)[:, k - 1]) * (1 + 1e-9) + 1e-6


def lists_for(total: int) -> int:
    return int(min(MOST_SAMPLE // PER_LIST, max(1, math.sqrt(total) / 2)))


def fit_index(ids: np.ndarray, x: np.ndarray, total: int, k: int = K, recall: float = RECALL) -> Index:
    """An index from a sample of `total` vectors: k-means lists, and probes set by the recall on the sample itself."""
    rng = np.random.default_rng(SEED)
    dim = x.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    n = int(min(lists_for(total), max(1, len(x) // PER_LIST)))
    centroids = x[rng.choice(len(x), n, replace=False)] if len(x) else np.zeros((1, dim))
    for _ in range(ROUNDS if n > 1 else 0):
        half = (centroids**2).sum(axis=1) / 2
        own = np.concatenate([(half - x[at : at + 4096] @ centroids.T).argmin(axis=1) for at in range(0, len(x), 4096)])
        sums, size = np.zeros_like(centroids), np.bincount(own, minlength=n)
        np.add.at(sums, own, x)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centroids)
    index = Index(rotation, centroids, n, ids, x)
    if n > 1:
        own = np.concatenate([index.lists(x[at : at + 4096], 1)[:, 0] for at in range(0, len(x), 4096)])
        asked = rng.choice(len(x), min(256, len(x)), replace=False)
        d = (x**2).sum(axis=1) - 2 * x[asked] @ x.T
        d[np.arange(len(asked)), asked] = np.inf
        near = np.argpartition(d, min(k, len(x) - 1), axis=1)[:, : min(k, len(x) - 1)]
        place = np.argsort(index.lists(x[asked], n), axis=1)
        needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
        index.probes = min(n, int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1)
        # rows are in a random order, so the first ones are a sample themselves
        index.sample_ids, index.sample = ids[:BOUNDING], x[:BOUNDING]
    return index


def scan(q: np.ndarray, bound: np.ndarray, v: np.ndarray, columns: int = COLUMNS, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of q, row of v) of rotated vectors that are not abandoned.

    After each block of columns the distance so far, scaled up to all columns, estimates the whole
    one; a pair goes when the estimate is so far beyond the query's bound that the hypothesis "it is within" is
    rejected (width epsilon / sqrt of the columns seen). After the last block the bound itself decides.
    """
    dim, limit = q.shape[1], bound**2
    part = slice(0, columns)
    first = np.maximum((q[:, part] ** 2).sum(axis=1)[:, None] + (v[:, part] ** 2).sum(axis=1) - 2 * q[:, part] @ v[:, part].T, 0)

    def allowed(seen: int) -> np.ndarray:
        return limit * (1.0 if seen >= dim else (1 + epsilon / math.sqrt(seen)) ** 2 * seen / dim) + 1e-9

    i, j = np.nonzero(first <= allowed(columns)[:, None])
    so_far = first[i, j]
    for at in range(columns, dim, columns):
        part = slice(at, at + columns)
        so_far = so_far + ((q[i, part] - v[j, part]) ** 2).sum(axis=1)
        keep = so_far <= allowed(min(dim, at + columns))[i]
        i, j, so_far = i[keep], j[keep], so_far[keep]
    return i, j


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = EVERY,
    k: int = K,
    block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean) of the k nearest found of every row whose id is divisible by `every`.

    Rows take no part if their id or vector is null, the vector is zero or has null or non-finite
    components. Vectors are compared with those of their own size. Rows with the query's own id are not its
    candidates; an id that repeats is one candidate, at its smallest distance. Equal distances go to the smaller id.
    Lists of any size are dealt in blocks of bounded size, and so are the queries of a list, so neither a hot list nor a
    vector repeated very often ends up in one task. A query whose lists gave fewer than k is compared with every
    vector, so that only a table with fewer candidates gives fewer rows.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect()  # a row for each size that occurs
    out = None
    for r in sizes:
        found = _nearest(rows.where(F.size("v") == r["dim"]), r["dim"], r["count"], every, k, block)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else vectors.sparkSession.createDataFrame([], OUT)


def _nearest(rows: DataFrame, dim: int, total: int, every: int, k: int, block: int) -> DataFrame:
    """nearest() among vectors of one size."""
    ring, wanted = 1 << 30, min(MOST_SAMPLE, max(LEAST_SAMPLE, lists_for(total) * PER_LIST))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(ring)) < int(ring * min(1.0, 0.95 * wanted / total)) + 1)
    got = drawn.groupBy("vec_id").agg(F.min("v").alias("v")).toArrow()  # an id counts once, however often it is there
    index = fit_index(*_bounded(got["vec_id"].to_numpy(), matrix(got["v"], dim), wanted), total, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                own = index.lists(matrix(b.column("v"), dim), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(own, pa.int32())], ["vec_id", "v", "list"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), dim)
            ids = b.column("vec_id").to_numpy()
            for at in range(0, len(x), 64):  # each query comes out once for every list that it probes
                part = x[at : at + 64]
                order, probes, bound = index.probed(ids[at : at + 64], part, k)
                row = np.repeat(np.arange(len(part)), probes)
                lists = order[np.arange(order.shape[1]) < probes[:, None]]
                which = at + row
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(pa.array(which)), b.column("v").take(pa.array(which)), pa.array(lists, pa.int32()), pa.array(bound[row])],
                    ["query_id", "q", "list", "bound"],
                )

    placed = rows.mapInArrow(assign, "vec_id long, v array<double>, list int")
    # at most MOST_SAMPLE / PER_LIST rows
    n_vectors = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}
    queries = rows.where(F.col("vec_id") % every == 0)
    asked = cut(queries.mapInArrow(probe, "query_id long, q array<double>, list int, bound double"))
    first = cut(_ranked(_search(placed, asked, index, n_vectors, dim, k, block), k))
    full = first.groupBy("query_id").count().where(F.col("count") >= k)
    short = cut(queries.join(full, F.col("vec_id") == F.col("query_id"), "left_anti").distinct())
    if short.isEmpty():
        return first
    lists = F.explode(F.array(*[F.lit(x).cast("int") for x in sorted(n_vectors)]))
    again = cut(short.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), lists.alias("list"), F.lit(float("inf")).alias("bound")))
    more = _ranked(_search(placed, again, index, n_vectors, dim, k, block), k)
    return first.join(full, "query_id", "left_semi").unionByName(more)


def _search(placed: DataFrame, asked: DataFrame, index: Index, n_vectors: dict[int, int], dim: int, k: int, block: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block that a query meets."""
    n_queries = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}
    blocks = placed.sparkSession.createDataFrame(
        [(x, math.ceil(n / block), max(1, math.ceil(n_queries.get(x, 0) / block))) for x, n in n_vectors.items()], "list int, v_blocks int, q_blocks int"
    )

    def dealt(df: DataFrame, id_: str, own: str, other: str) -> DataFrame:
        # by id and vector, so that an id that holds a large part of the table is spread as well
        place = F.pmod(F.xxhash64(*id_, F.lit(3)), F.col(own)).cast("int")
        df = df.join(F.broadcast(blocks), "list").withColumn(own, place)  # one row a list
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    def best(ids: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest different ids of each query row of one block."""
        order = np.lexsort((d, ids[j], i))
        i, j, d = i[order], j[order], d[order]
        new = np.r_[True, (i[1:] != i[:-1]) | (ids[j][1:] != ids[j][:-1])][: len(i)]
        i, j, d = i[new], j[new], d[new]
        order = np.lexsort((ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        start = np.r_[True, i[1:] != i[:-1]][: len(i)]
        rank = np.arange(len(i)) - np.maximum.accumulate(np.where(start, np.arange(len(i)), 0)) if len(i) else np.empty(0, int)
        return i[rank < k], j[rank < k], d[rank < k]

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, nv = left["vec_id"].to_numpy(), left.num_rows
        v = matrix(left["v"], dim) if nv else np.empty((0, dim))
        turned = v @ index.rotation
        q_ids, bound = right["query_id"].to_numpy(), right["bound"].to_numpy()
        q = matrix(right["q"], dim) if right.num_rows else np.empty((0, dim))
        out = []
        step = 8 if np.isinf(bound).any() else 64  # without a bound every pair is kept to the end
        for at in range(0, len(q) if nv else 0, step):
            part = q[at : at + step]
            i, j = scan(part @ index.rotation, bound[at : at + step], turned)
            other = q_ids[at + i] != ids[j]
            i, j = i[other], j[other]
            i, j, d = best(ids, i, j, np.sqrt(((part[i] - v[j]) ** 2).sum(axis=1)))
            out.append((q_ids[at + i], ids[j], d))
        cat = lambda n, kind: np.concatenate([np.empty(0, kind), *(x[n] for x in out)]).astype(kind)
        return pa.table({"query_id": cat(0, np.int64), "vec_id": cat(1, np.int64), "score": cat(2, np.float64)})

    left = dealt(placed, ["vec_id", "v"], "v_blocks", "q_blocks").groupBy("list", "v_blocks", "q_blocks")
    right = dealt(asked, ["query_id"], "q_blocks", "v_blocks").groupBy("list", "v_blocks", "q_blocks")
    return left.cogroup(right).applyInArrow(search, "query_id long, vec_id long, score double")


def _ranked(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    single = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _bounded(ids: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most so many rows in a random order that does not depend on how the table is split."""
    order = np.argsort(ids)
    step = np.random.default_rng(SEED).permutation(len(order))[:most]
    return ids[order][step], x[order][step]


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
