"""Approximate nearest neighbours by low-dimensional stable projections (SRS).

Unit vectors are projected on a few Gaussian directions; the squared projected distance
of two vectors over their squared distance is then chi-square.  A query verifies
vectors by the exact cosine in the order of their projected distance, and stops where a
nearer vector would, with probability ``confidence``, have been met already: at the
projected radius ``chi-square quantile x squared distance of its k-th neighbour``.

The projections are indexed by a kd-tree.  Its upper part is fitted on a bounded sample
and cuts the table into cells; a cell's rows are dealt into shards of bounded size, and
each shard is a kd-tree of its own.  A query first searches one shard of its own cell;
the radius that follows is what every other shard starts with, and cells beyond it are
not visited at all.  Copies of a vector are one point, which keeps the k + 1 smallest of
its ids, so they neither crowd out others nor split ties, and no hot vector fills a task.

Vectors meet queries as (cell, shard, block of queries) groups of bounded size, and only
those groups are made that some query visits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm._common import compact, durable, name, small_side

#: Cells of the upper tree at the most, and rows that it is fitted on: both bound what the driver holds.
MOST_CELLS, SAMPLE_ROWS = 16_384, 50_000


def chi_square_cdf(x: float, m: int) -> float:
    """For an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for j in range(1, m // 2):
        term *= half / j
        total += term
    return 1 - math.exp(-half) * total if half < 700 else 1.0


def chi_square_quantile(confidence: float, m: int) -> float:
    low, high = 0.0, 10.0 * m + 100
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, m) < confidence else (low, middle)
    return high


class KdTree:
    """Leaves of at most ``leaf`` points, split at the median of the widest direction."""

    def __init__(self, points: np.ndarray, leaf: int = 32):
        self.leaves, self.splits = [], []
        stack = [(np.arange(len(points)), self._node())]
        while stack:
            own, at = stack.pop()
            part = points[own]
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            order = np.argpartition(part[:, axis], len(own) // 2)
            value = part[order[len(own) // 2], axis]
            if len(own) <= leaf or part[:, axis].min() == value:
                self.splits[at] = (-1, float(len(self.leaves)), -1, -1)
                self.leaves.append(own)
                continue
            low, high = self._node(), self._node()
            self.splits[at] = (axis, float(value), low, high)
            below = part[:, axis] < value
            stack += ((own[below], low), (own[~below], high))
        self.low = np.array([points[x].min(axis=0) for x in self.leaves])
        self.high = np.array([points[x].max(axis=0) for x in self.leaves])

    def _node(self) -> int:
        self.splits.append(None)
        return len(self.splits) - 1

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The number of the leaf that every point falls into (also points that the tree was not built from)."""
        axis, value, low, high = (np.array(x) for x in zip(*self.splits, strict=True))
        at = np.zeros(len(points), int)
        while len(inner := np.flatnonzero(axis[at] >= 0)):
            here = at[inner]
            at[inner] = np.where(points[inner, axis[here]] < value[here], low[here], high[here])
        return value[at].astype(int)


def least_distances(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Least squared distances of boxes from a point."""
    gap = np.maximum(np.maximum(low - at, at - high), 0.0)
    return np.einsum("ij,ij->i", gap, gap)


def cosines(vectors: np.ndarray, norms: np.ndarray, query: np.ndarray, query_norm: float) -> np.ndarray:
    return (vectors * query).sum(axis=1) / (norms * query_norm)


def directions(width: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, m))


def projected(vectors: np.ndarray, m: int, seed: int) -> np.ndarray:
    return (vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]) @ directions(vectors.shape[1], m, seed)


def distinct_ids(near: list[tuple[float, int]], query_id: int, k: int) -> list[tuple[float, int]]:
    """The k first of (minus score, id), each id once and the query's never."""
    first = {}
    for s, i in sorted(near):
        if i != query_id:
            first.setdefault(i, s)
    return [(s, i) for i, s in first.items()][:k]


def search_shard(
    ids: list[list[int]], vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, worst: np.ndarray, *, k: int, m: int, seed: int, limit: float, step: int = 8
) -> tuple[list[tuple[int, int, float]], list[int]]:
    """(query_id, vec_id, score) of up to k neighbours of each query, and how many vectors each query verified.

    ``vectors`` are distinct points with their ids; ``worst`` is the cosine of each
    query's k-th neighbour found elsewhere (-1 if none is known): nothing below it counts;
    ``limit`` is the chi-square quantile of the stopping test.
    """
    norms, at_points = np.sqrt((vectors * vectors).sum(axis=1)), projected(vectors, m, seed)
    tree = KdTree(at_points)
    out, verified = [], []
    for query_id, query, start, at in zip(query_ids.tolist(), queries, worst.tolist(), projected(queries, m, seed), strict=True):
        norm, bound, near, count = math.sqrt((query * query).sum()), start, [], 0
        least = least_distances(tree.low, tree.high, at)
        order = np.argsort(least, kind="stable")
        waits, waits_at, first, take, most = np.zeros(0, int), np.zeros(0), 0, step, 64
        while True:
            radius = limit * max(0.0, 2 - 2 * bound) + 1e-12
            ahead = least[order[first]] if first < len(order) else math.inf
            if min(ahead, waits_at.min(initial=math.inf)) > radius:
                break
            # Vectors whose turn has come: no leaf that is still closed can hold one nearer in projection.
            turn = waits_at <= min(ahead, radius)
            if turn.any():
                own, waits, waits_at = waits[turn], waits[~turn], waits_at[~turn]
                if len(own) > most:  # the nearest first, as they may end the search
                    part = np.argpartition(near_at := least_of(at_points, own, at), most)
                    waits, waits_at = np.r_[waits, own[part[most:]]], np.r_[waits_at, near_at[part[most:]]]
                    own, most = own[part[:most]], 2 * most
                count += len(own)
                score = cosines(vectors[own], norms[own], query, norm)
                hits = np.flatnonzero(score >= bound)
                if len(hits):
                    near = distinct_ids(near + [(-s, i) for p, s in zip(own[hits].tolist(), score[hits].tolist(), strict=True) for i in ids[p]], query_id, k)
                    if len(near) == k:
                        bound = max(bound, -near[-1][0])
            else:
                own = np.concatenate([tree.leaves[i] for i in order[first : first + take]])
                first, take = first + take, 2 * take
                own_at = least_of(at_points, own, at)
                inside = own_at <= radius
                waits, waits_at = np.r_[waits, own[inside]], np.r_[waits_at, own_at[inside]]
        out += [(query_id, i, -s) for s, i in near]
        verified.append(count)
    return out, verified


def least_of(points: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
    gap = points[own] - at
    return np.einsum("ij,ij->i", gap, gap)


def usable(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _upper_tree(points: DataFrame, n: int, shard_rows: int, m: int, seed: int) -> KdTree:
    """The upper part of the kd-tree, from about SAMPLE_ROWS vectors chosen by a hash."""
    part = points if n <= SAMPLE_ROWS else points.where(F.pmod(F.xxhash64("v", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * SAMPLE_ROWS / n))
    sample = projected(np.stack([np.array(r.v) for r in part.select("v").limit(2 * SAMPLE_ROWS).toLocalIterator()]), m, seed)
    cells = min(MOST_CELLS, -(-n // shard_rows))
    return KdTree(sample, leaf=max(1, -(-len(sample) // cells)))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    projections: int = 24,
    confidence: float = 0.9,
    seed: int = 11,
    shard_rows: int = 8192,
    block_queries: int = 2048,
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score, verified: for each query its k nearest by cosine, ties to smaller vec_id.

    Queries are the rows where ``is_query`` holds, candidates all rows but those with the
    query's own id; ``verified`` counts the distinct vectors whose cosine the query took.
    Rows without an id, with an unusable vector (see ``usable``) or of another length than
    most take no part; of rows with one id, the query vector is the smallest, and as a
    candidate the id counts once, with its best score.  Repeated rows are one.  All vectors
    are indexed.  An empty table, or one without queries, gives no rows.  Other columns,
    whatever their names, are not read.  ``projections`` must be even.
    """
    rows = vectors.select(
        name(key).cast("long").alias("id"), name(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    ).where(F.col("id").isNotNull() & usable(F.col("v")))
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("q"))
    common = widths.orderBy(F.desc("n"), "width").first()
    width, n, q = (common.width, common.n, common.q) if common else (0, 0, 0)
    near_schema = "query_id long, vec_id long, score double, verified long"
    if not q:
        none = rows.sparkSession.createDataFrame([], near_schema)
        return none.select("query_id", F.lit(1).alias("rank"), "vec_id", "score", "verified")
    rows = rows.where(F.size("v") == width).groupBy("id", "v").agg(F.max("q").alias("q"))
    few = rows.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("at") <= k + 1)
    points = durable(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    upper, m = _upper_tree(points, n, shard_rows, projections, seed), projections

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            if batch.num_rows:
                at = projected(flat.reshape(batch.num_rows, -1), m, seed)
                boxes = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * m, at.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upper.leaf_of(at)), boxes], ["v", "ids", "cell", "p"])

    index = durable(points.select("v", "ids").mapInArrow(placed, "v array<double>, ids array<long>, cell long, p array<double>"))
    ends = [f(F.col("p")[i]).alias(f"{s}{i}") for s, f in (("low", F.min), ("high", F.max)) for i in range(m)]
    cells = index.groupBy("cell").agg(F.count("*").alias("n"), *ends).orderBy("cell").collect()  # at most MOST_CELLS rows, each of fixed width
    low, high = (np.array([[r[f"{s}{i}"] for i in range(m)] for r in cells]) for s in ("low", "high"))
    numbers, shards = np.array([r.cell for r in cells]), np.array([-(-r.n // shard_rows) for r in cells])
    asked = rows.where("q").groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.lit(-1.0).alias("worst"))
    blocks = max(1, -(-q // block_queries))
    limit = chi_square_quantile(confidence, m)

    def visits(home: bool):
        """Where a query goes: one shard of its own cell, or all others that its radius reaches."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                at = projected(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), m, seed)
                own = np.searchsorted(numbers, upper.leaf_of(at))
                ids, worst = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                row, cell, shard = [], [], []
                for j in range(batch.num_rows):
                    mine = int(ids[j] % shards[own[j]])
                    if home:
                        row, cell, shard = [*row, j], [*cell, own[j]], [*shard, mine]
                        continue
                    reached = np.flatnonzero(least_distances(low, high, at[j]) <= limit * (2 - 2 * worst[j]) + 1e-12)
                    for c in reached.tolist():
                        also = [s for s in range(shards[c]) if (c, s) != (own[j], mine)]
                        row += [j] * len(also)
                        cell += [c] * len(also)
                        shard += also
                columns = [c.take(pa.array(row, pa.int64())) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers[np.array(cell, int)]), pa.array(shard, pa.int64())], ["id", "v", "worst", "cell", "shard"])

        return run

    def search(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score", "verified"]
        if not len(own) or not len(queries):
            return pd.DataFrame([], columns=columns).astype({"query_id": "int64", "vec_id": "Int64", "score": "float64", "verified": "Int64"})
        query_ids = queries["id"].to_numpy(np.int64)
        found, counts = search_shard(
            [x.tolist() for x in own["ids"]], np.stack(own["v"].to_list()), query_ids, np.stack(queries["v"].to_list()), queries["worst"].to_numpy(),
            k=k, m=m, seed=seed, limit=limit,
        )
        rows = [(*x, None) for x in found] + [(i, None, None, c) for i, c in zip(query_ids.tolist(), counts, strict=True)]
        return pd.DataFrame(rows, columns=columns).astype({"query_id": "int64", "vec_id": "Int64", "score": "float64", "verified": "Int64"})

    per_cell = rows.sparkSession.createDataFrame([(int(r.cell), int(s)) for r, s in zip(cells, shards, strict=True)], "cell long, shards long")
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    held = index.join(F.broadcast(per_cell), "cell").select("cell", F.pmod(F.xxhash64("v"), F.col("shards")).alias("shard"), "v", "ids")

    def pass_over(queries: DataFrame, home: bool) -> DataFrame:
        """A shard goes only to the blocks of queries that visit it."""
        sent = durable(queries.mapInArrow(visits(home), "id long, v array<double>, worst double, cell long, shard long").withColumn("block", block("id")))
        visited = compact(sent.select(F.col("cell").alias("c"), F.col("shard").alias("s"), F.col("block").alias("b")).distinct())
        met = held.join(small_side(visited, broadcast_rows), (F.col("cell") == F.col("c")) & (F.col("shard") == F.col("s")))
        left = met.select("cell", "shard", F.col("b").alias("block"), "v", "ids").groupBy("cell", "shard", "block")
        return left.cogroup(sent.groupBy("cell", "shard", "block")).applyInPandas(search, near_schema)

    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "vec_id")
    asked = durable(asked)
    first = durable(pass_over(asked, True))
    ranked = first.where("vec_id is not null").withColumn("at", F.row_number().over(order))
    bounds = ranked.where(F.col("at") == k).select(F.col("query_id").alias("id"), F.col("score").alias("best"))
    others = asked.select("id", "v").join(bounds, "id", "left").select("id", "v", F.coalesce("best", F.lit(-1.0)).alias("worst"))
    near = first.unionByName(pass_over(others, False)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("verified").alias("verified"))
    whole = Window.partitionBy("query_id")
    near = near.withColumn("verified", F.sum("verified").over(whole)).withColumn("rank", F.row_number().over(order))
    return near.where((F.col("rank") <= k) & F.col("vec_id").isNotNull()).select("query_id", "rank", "vec_id", "score", "verified")
