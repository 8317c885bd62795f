"""Nearest neighbours with vantage-point trees, one or more per input partition.

Every input partition builds trees of at most ``tree_rows`` vectors: a node holds a vantage point and, for the nearer
and the farther half of its vectors, the range of their distances to it. A search skips a half when the triangle
inequality puts all of it beyond the k-th distance found so far. ``factor`` relaxes the bound: a half is skipped if
``factor`` times its least possible distance is beyond the k-th; 1 is exact search, larger values skip more and may
miss neighbours.

Queries are dealt into blocks, trees into slots. Every slot meets every block in a task of its own, which holds a few
trees and one block; each gives its best k per query, and a ranked window keeps the best of all.

Distance: Euclidean, in double precision on the stored values. Ties: the smaller id. A query's own id is no candidate.
Null ids, null or zero vectors, and vectors with null or non-finite components take no part; vectors of another
length than the query's are no candidates. Equal vectors split by rank, so a tree of copies stays balanced. Repeated
rows: each is a candidate. Fewer candidates than k: all of them. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF = 128


def usable(vec: str) -> Column:
    """The vector is given, has finite components only, and is not zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(vec, lambda x: x == 0)
    return F.col(vec).isNotNull() & ~F.coalesce(bad, F.lit(True)) & ~F.coalesce(zero, F.lit(True))


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distance of every query to every point, from the differences themselves."""
    out = np.empty((len(queries), len(points)))
    for i in range(0, len(queries), 64):
        diff = queries[i:i + 64, None, :] - points[None, :, :]
        out[i:i + 64] = np.sqrt(np.einsum("qpd,qpd->qp", diff, diff))
    return out


class VPTree:
    """Nodes are tuples: ("leaf", begin, end) or (vantage, near, far, near range, far range); points are ordered so
    that a leaf's are contiguous."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.points, order = points, np.arange(len(ids))
        wide = points.astype(np.float64)
        placed: list = []

        def build(own: np.ndarray):
            if len(own) <= LEAF:
                begin = sum(map(len, placed))
                placed.append(own)
                return ("leaf", begin, begin + len(own))
            # of a few points, the one with the widest spread of distances
            tries = own[np.linspace(0, len(own) - 1, 4).astype(int)]
            probe = wide[own[:: max(1, len(own) // 64)]]
            spread = distances(wide[tries], probe).std(axis=1)
            vantage = wide[tries[int(spread.argmax())]]
            d = distances(vantage[None], wide[own])[0]
            ranked = np.argsort(d, kind="stable")
            half = len(own) // 2
            near, far, d = own[ranked[:half]], own[ranked[half:]], d[ranked]
            return (vantage, build(near), build(far), (d[0], d[half - 1]), (d[half], d[-1]))

        self.root = build(order)
        order = np.concatenate(placed) if placed else order
        self.ids, self.points = ids[order], points[order]

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances (queries x k, padded by infinite distances) of the nearest points."""
        wide = self.points.astype(np.float64)
        dist = np.full((len(queries), k), np.inf)
        near_ids = np.full((len(queries), k), np.iinfo(np.int64).max)

        def out_of_reach(rows: np.ndarray, d: np.ndarray, span: tuple) -> np.ndarray:
            least = np.maximum(0.0, np.maximum(d - span[1], span[0] - d))
            reach = dist[rows, k - 1]
            return factor * least > reach + 1e-9 * (1.0 + np.where(np.isfinite(reach), reach, 0.0))

        def visit(node: tuple, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if node[0] is not None and isinstance(node[0], str):
                d = distances(queries[rows], wide[node[1]:node[2]])
                own = self.ids[node[1]:node[2]]
                d[own[None, :] == ids[rows, None]] = np.inf
                every = np.concatenate([dist[rows], d], axis=1)
                names = np.concatenate([near_ids[rows], np.broadcast_to(own, d.shape)], axis=1)
                best = np.lexsort((names, every), axis=1)[:, :k]
                dist[rows] = np.take_along_axis(every, best, axis=1)
                near_ids[rows] = np.take_along_axis(names, best, axis=1)
                return
            vantage, near, far, near_span, far_span = node
            d = distances(queries[rows], vantage[None])[:, 0]
            inside = d <= (near_span[1] + far_span[0]) / 2
            visit(near, rows[inside])
            visit(far, rows[~inside])
            visit(far, rows[inside][~out_of_reach(rows[inside], d[inside], far_span)])
            visit(near, rows[~inside][~out_of_reach(rows[~inside], d[~inside], near_span)])

        visit(self.root, np.arange(len(queries)))
        return near_ids, dist


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def build_trees(vectors: DataFrame, slots: int, tree_rows: int) -> DataFrame:
    """``slot``, ``tree`` (pickled ids, points and nodes) for usable ``vec_id``, ``vec`` rows."""
    def run(batches):
        part, made, held = TaskContext.get().partitionId(), 0, {}

        def tree(rows: list) -> pa.RecordBatch:
            nonlocal made
            ids = np.concatenate([r[0] for r in rows])
            blob = pickle.dumps(VPTree(ids, np.concatenate([r[1] for r in rows])))
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([(part + (made - 1) * 7919) % slots], pa.int32()),
                                               pa.array([blob], pa.binary())], names=["slot", "tree"])

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            flat, lengths = _matrix(b.column(1))
            ends = np.cumsum(lengths)
            for n in np.unique(lengths):
                at = np.nonzero(lengths == n)[0]
                points = flat[(ends[at] - n)[:, None] + np.arange(n)]
                for s in range(0, len(at), tree_rows):
                    own = held.setdefault(int(n), [])
                    own.append((ids[at[s:s + tree_rows]], points[s:s + tree_rows]))
                    if sum(len(r[0]) for r in own) >= tree_rows:
                        yield tree(held.pop(int(n)))
        for own in held.values():
            yield tree(own)

    return vectors.select("vec_id", "vec").mapInArrow(run, "slot int, tree binary")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, factor: float = 1.0, id_col: str = "vec_id",
            vec_col: str = "embedding", tree_rows: int = 8192, block_rows: int = 512) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (distance) of each query's ``k`` nearest."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable("vec"))
    n, asked = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    slots, blocks = max(1, math.ceil(n / tree_rows)), max(1, math.ceil(asked / block_rows))
    trees = build_trees(rows, slots, tree_rows).select(
        "slot", "tree", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = rows.where("asks").select("vec_id", "vec", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
                                        F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))

    def search(own_trees: pa.Table, own: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        if own.num_rows and own_trees.num_rows:
            own = own.combine_chunks()
            ids = own.column("vec_id").to_numpy()
            flat, lengths = _matrix(own.column("vec").combine_chunks())
            ends = np.cumsum(lengths)
            for blob in own_trees.column("tree"):
                tree = pickle.loads(blob.as_py())
                size = tree.points.shape[1]
                at = np.nonzero(lengths == size)[0]
                if not len(at):
                    continue
                points = flat[(ends[at] - size)[:, None] + np.arange(size)].astype(np.float64)
                names, dist = tree.search(ids[at], points, k, factor)
                found = np.isfinite(dist)
                out[0].append(np.repeat(ids[at], found.sum(axis=1)))
                out[1].append(names[found])
                out[2].append(dist[found])
        cols = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols)))

    found = trees.groupBy("slot", "block").cogroup(queries.groupBy("slot", "block")).applyInArrow(
        search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
