"""Approximate nearest neighbours over balanced posting lists.

A bounded sample is halved again and again into equal parts whose means are the
centroids. Every vector is stored in the list of its nearest centroid, and a
vector near a border also in those of other centroids hardly farther away. A
query walks a neighbour graph of the
centroids and takes all lists within a ratio of the nearest, and a least number
of them that is tried out beforehand: the exact neighbours of a few queries,
found by one pass over the table, must be in the lists taken. Lists and queries
meet in blocks of bounded size, and the distances kept are exact.

Defined results: vectors that are null, all zero, of another length than most,
or hold a null or non-finite component, and rows without an id, take no part; a
query never finds its own id; equal distances go to the smaller id; equal
vectors are found one by one; rows that repeat an id with another vector are
candidates of their own, the nearest one counts; an empty table has no result.
"""
from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import written

#: Rows that the centroids are fitted on, taken by the hash of their id.
SAMPLE_ROWS = 20_000
#: Vectors for each list, and the rows of the sample that a centroid is the mean of, at least.
LIST_ROWS, FIT_ROWS = 256, 50
#: A vector is stored in up to COPIES lists whose centroids are at most EDGE times as far as the nearest.
COPIES, EDGE = 3, 1.03
#: A query takes lists up to NEAR times as far as the nearest, LEAST_LISTS at least.
NEAR, LEAST_LISTS = 1.15, 12
#: More lists are taken until so much of the exact neighbours of TRIAL_QUERIES queries is in them.
TRIAL_RECALL, TRIAL_QUERIES = 0.95, 200
NEIGHBOURS = 16
#: Rows of a block of vectors, of queries.
VECTOR_BLOCK, QUERY_BLOCK = 8192, 8192


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (doubles) of the rows that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    found = (rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
             .filter(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)))
    sizes = found.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return found.filter(F.size("v") == (sizes[0]["d"] if sizes else 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0))


def balanced_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Means of `lists` equal parts of the sample."""
    rng, done, open_ = np.random.default_rng(7), [], [(sample, lists)]
    while open_:
        part, n = open_.pop()
        if n <= 1 or len(part) < 2:
            done.append(part.mean(0))
            continue
        two = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(6):
            lean = _distances(part, two) @ np.array([1.0, -1.0])
            order = np.argsort(lean, kind="stable")
            cut = len(part) * (n // 2) // n
            halves = part[order[:cut]], part[order[cut:]]
            two = np.stack([h.mean(0) for h in halves])
        open_ += [(halves[0], n // 2), (halves[1], n - n // 2)]
    return np.array(done)


@dataclass
class CentroidGraph:
    """Each centroid with its nearest ones and a few far ones, and the walk over them."""
    centroids: np.ndarray
    links: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> CentroidGraph:
        n, rng = len(centroids), np.random.default_rng(11)
        near = np.argsort(_distances(centroids, centroids), 1)[:, 1:NEIGHBOURS + 1]
        return cls(centroids, np.concatenate([near, rng.integers(0, n, (n, 4))], 1))

    def lists(self, query: np.ndarray, ratio: float, least: int) -> list[int]:
        """Best first: centroids within the ratio of the nearest met, and the `least` nearest."""
        def far(at: np.ndarray) -> list[float]:
            return np.sqrt(((self.centroids[at] - query) ** 2).sum(1)).tolist()
        if 4 * least >= len(self.centroids):  # the walk would meet most of them one by one
            d = np.sqrt(((self.centroids - query) ** 2).sum(1))
            ranked = np.argsort(d, kind="stable")
            return ranked[:max(least, int((d <= d.min() * ratio).sum()))].tolist()
        entry = np.linspace(0, len(self.centroids) - 1, min(8, len(self.centroids))).astype(int)
        seen = dict(zip(entry.tolist(), far(entry)))
        open_ = [(d, i) for i, d in seen.items()]
        heapq.heapify(open_)
        best = min(seen.values())
        while open_:
            d, i = heapq.heappop(open_)
            if d > best * ratio and d > heapq.nsmallest(2 * least, seen.values())[-1]:
                break
            new = [j for j in dict.fromkeys(self.links[i].tolist()) if j not in seen]
            if new:
                for j, e in zip(new, far(np.array(new))):
                    seen[j] = e
                    best = min(best, e)
                    heapq.heappush(open_, (e, j))
        ranked = sorted(seen, key=seen.get)
        return [i for k, i in enumerate(ranked) if k < least or seen[i] <= best * ratio]


def posting_lists(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of every copy: the nearest centroid, and others near the border."""
    d = _distances(vectors, centroids)
    n = min(COPIES, d.shape[1])
    near = np.argpartition(d, n - 1, 1)[:, :n]
    row, col = np.nonzero(np.take_along_axis(d, near, 1) <= d.min(1, keepdims=True) * EDGE)
    return row, near[row, col]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def nearest_in_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """The k nearest of a block for each query: query id, id, exact distance."""
    out = []
    square = (vectors * vectors).sum(1)
    for a in range(0, len(queries), 64):
        part = queries[a:a + 64]
        near = square - 2 * part @ vectors.T
        slack = 1e-9 * (square.max() + (part * part).sum(1))
        for i, row in enumerate(near):
            own = ids == query_ids[a + i]
            row[own] = np.inf
            if len(row) > k:
                at = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + slack[i])
            else:
                at = np.arange(len(row))
            at = at[~own[at]]
            d = np.sqrt(((vectors[at] - part[i]) ** 2).sum(1))
            pick = np.lexsort((ids[at], d))[:k]
            out.append((np.full(len(pick), query_ids[a + i]), ids[at][pick], d[pick]))
    return [np.concatenate(x) for x in zip(*out)]


def exact_nearest(base: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> dict[int, list[int]]:
    """The ids of the k nearest rows of each of a few queries, by one pass over all rows."""
    def scan(batches):
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            found = nearest_in_block(vectors, ids, _matrix(batch.column(1)), batch.column(0).to_numpy(), k)
            best = found if best is None else [np.concatenate(x) for x in zip(best, found)]
            order = np.lexsort((best[1], best[2], best[0]))
            q = best[0][order]
            order = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
            best = [x[order] for x in best]
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(best[0], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[2], pa.float64())], ["query_id", "vec_id", "score"])
    each = base.mapInArrow(scan, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out: dict[int, list[int]] = {}
    for r in each.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def least_lists(graph: CentroidGraph, base: DataFrame, index: DataFrame, queries_of, k: int) -> int:
    """The fewest lists to take such that TRIAL_RECALL of the exact neighbours of some queries is in them; all where none are enough."""
    n = len(graph.centroids)
    if n <= LEAST_LISTS:
        return LEAST_LISTS
    # another hash than the sample's: most of these queries did not shape the centroids
    some = base.filter(queries_of).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(TRIAL_QUERIES).toArrow()
    ids, first = np.unique(some.column("id").to_numpy(), return_index=True)
    if not len(ids):
        return LEAST_LISTS
    vectors = _matrix(some.column("v"))[first]
    near = exact_nearest(base, ids, vectors, k)
    wanted = sorted({x for found in near.values() for x in found})
    spark = base.sparkSession
    stored: dict[int, set[int]] = {}
    for r in index.join(F.broadcast(spark.createDataFrame([(x,) for x in wanted], "id long")), "id").select("id", "list").distinct().collect():
        stored.setdefault(r["id"], set()).add(r["list"])
    total = sum(map(len, near.values()))

    def enough(least: int) -> bool:
        met = 0
        for q, v in zip(ids.tolist(), vectors):
            taken = set(graph.lists(v, NEAR, least))
            met += sum(not taken.isdisjoint(stored[x]) for x in near.get(q, ()))
        return met >= TRIAL_RECALL * total

    low, high = LEAST_LISTS, n
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle + 1, high)
    return low


def search(rows: DataFrame, queries_of, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each row for which `queries_of` (a condition on `id`) holds: query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    base = written(usable(rows, id_col, vector_col), "vectors")
    total = base.count()
    result = "query_id long, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(2 * SAMPLE_ROWS / total * (1 << 20)) + 1)
    sample = _matrix(base.filter(share).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toArrow().column("v"))
    sample = np.unique(sample if len(sample) else _matrix(base.limit(1).toArrow().column("v")), axis=0)
    lists = min(max(1, total // LIST_ROWS), max(1, len(sample) // FIT_ROWS))
    centroids = balanced_centroids(sample, lists)
    graph = CentroidGraph.of(centroids)

    def store(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                row, of = posting_lists(_matrix(part.column(1)), centroids)
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], ["list", "id", "v"])

    def probe(batches):
        for batch in batches:
            found = [graph.lists(q, NEAR, least) for q in _matrix(batch.column(1))]
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array([x for f in found for x in f], pa.int64()), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["list", "id", "v"])

    kinds = "list long, id long, v array<double>"
    index = written(base.mapInArrow(store, kinds), "postings")
    least = least_lists(graph, base, index, queries_of, k)
    asked = written(base.filter(queries_of).mapInArrow(probe, kinds), "probes")
    # a row a list, SAMPLE_ROWS / FIT_ROWS at most, so they may be broadcast
    stored = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / VECTOR_BLOCK).alias("vectors"))
    wanted = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("queries"))
    blocks = F.broadcast(written(stored.join(wanted, "list"), "blocks"))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        """Each row to one block of its own side and to all of the other."""
        return (side.join(blocks, "list").withColumn(own, F.pmod(F.xxhash64("id", F.hash("v")), F.col(own)))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, i, d = nearest_in_block(_matrix(left.column("v")), left.column("id").to_numpy(), _matrix(right.column("v")), right.column("id").to_numpy(), k)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(d, pa.float64())})

    keys = ["list", "vectors", "queries"]
    found = (dealt(asked, "queries", "vectors").groupBy(keys)
             .cogroup(dealt(index, "vectors", "queries").groupBy(keys)).applyInArrow(scan, result))
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
