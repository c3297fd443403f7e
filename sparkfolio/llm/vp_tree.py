"""Nearest neighbours by cosine with a vantage-point tree per shard.

Vectors are dealt to shards of SHARD bytes by a hash of their id (equal sizes whatever the data). Each shard is written
once, with the tree over its distinct vectors. Queries go past the shards in blocks of BLOCK bytes, which bounds what is
broadcast; a task keeps the k nearest over all the shards it reads, so what one shard found already prunes the next, and
sends k rows for each query. Vectors are shuffled once, to make the shards; nothing is sent again for further queries.

On unit vectors the Euclidean distance is a metric that orders like the cosine; each tree node keeps a vantage point and
the median distance to it, and a branch is skipped when the triangle inequality puts it further than `factor` times the
distance of the k-th neighbour found so far. Factor 1 is exact; less skips more. Scores are computed again in double
precision from the original vectors, scaled by powers of two where they would leave the range.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; only vectors of
one length meet; equal vectors tie by vec_id; repeated rows count once; rows without id take no part; vectors of any length
are compared whole (a shard holds one vector at least); other columns are ignored; fewer candidates than k: all of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, small_batches, tidy, tidy_group

SHARD, BLOCK, LEAF = 4 << 20, 16 << 20, 48


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares stay in range; cosines don't change."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of a and b, pair by pair."""
    a, b = scaled(a), scaled(b)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


class Tree:
    """A vantage-point tree over the rows of unit vectors."""

    def __init__(self, unit: np.ndarray, root=None, seed: int = 3):
        self.unit, self.random = unit, np.random.default_rng(seed)
        self.root = self._node(np.arange(len(unit))) if root is None else root

    def _node(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        pick = rows[self.random.integers(len(rows), size=8)]
        spread = [np.linalg.norm(self.unit[rows[:256]] - self.unit[p], axis=1).std() for p in pick]
        point = pick[int(np.argmax(spread))]
        d = np.linalg.norm(self.unit[rows] - self.unit[point], axis=1)
        radius = float(np.median(d))
        near = d <= radius
        if near.all() or not near.any():
            near = np.arange(len(rows)) < len(rows) // 2
            near = near[np.argsort(np.argsort(d, kind="stable"), kind="stable")]
            radius = float(d[near].max())
        return point, radius, self._node(rows[near]), self._node(rows[~near])

    def search(self, queries: np.ndarray, k: int, factor: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and squared distances of each query's k nearest found; -1 where there are fewer. known: of each query, the
        squared distance beyond which nothing is wanted."""
        best = np.full((len(queries), k), np.inf)
        limit = np.full(len(queries), np.inf) if known is None else known
        which = np.full((len(queries), k), -1, dtype=np.int64)

        def visit(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, np.ndarray):
                d = np.maximum(0.0, 2.0 - 2.0 * (queries[at] @ self.unit[node].T))
                both = np.concatenate((best[at], d), axis=1)
                names = np.concatenate((which[at], np.broadcast_to(node, d.shape)), axis=1)
                order = np.argpartition(both, k - 1, axis=1)[:, :k]
                best[at], which[at] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
                return
            point, radius, near, far = node
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (queries[at] @ self.unit[point])))
            inner = d <= radius
            visit(near, at[inner])
            visit(far, at[~inner])
            reach = factor * np.sqrt(np.minimum(best[at].max(axis=1), limit[at])) + 1e-9
            visit(far, at[inner & (radius - d <= reach)])
            visit(near, at[~inner & (d - radius <= reach)])

        if len(self.unit):
            visit(self.root, np.arange(len(queries)))
        return which, best


def _shard(table: pa.Table) -> pa.Table:
    """A shard as one row: its distinct vectors, their tree, and the ids of each in order."""
    ids = table.column("vec_id").to_numpy()
    values = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    distinct, owner = np.unique(values, axis=0, return_inverse=True)
    order = np.lexsort((ids, owner.ravel()))
    owner, ids = owner.ravel()[order], ids[order]
    fresh = np.append(True, (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1]))  # repeated rows count once
    owner, ids = owner[fresh], ids[fresh]
    starts = np.searchsorted(owner, np.arange(len(distinct) + 1))
    tree = pickle.dumps((ids, starts, distinct, Tree(unit(distinct)).root))
    return pa.table({"dim": table.column("dim")[:1], "tree": pa.array([tree], pa.binary())})


def _search(k: int, factor: float, held):
    """Over a task's shards: k rows for each query that has so many."""
    wide = k + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            for dim, blob in zip(batch.column("dim").to_pylist(), batch.column("tree").to_pylist()):
                if dim not in held.value:
                    continue
                asked, queries, units = held.value[dim]
                ids, starts, distinct, root = pickle.loads(blob)
                known = best.setdefault(dim, np.full(len(asked), np.inf))
                which, _ = Tree(unit(distinct), root).search(units, wide, factor, known)
                qi, col = np.nonzero(which >= 0)
                d = which[qi, col]
                score = cosines(queries[qi], distinct[d]) if len(qi) else np.zeros(0)
                each = np.minimum(starts[d + 1] - starts[d], k + 1)  # of equal vectors the least ids are enough
                place = np.arange(each.sum()) + np.repeat(starts[d] - (np.cumsum(each) - each), each)
                q, v, s = np.repeat(asked[qi], each), ids[place], np.repeat(score, each)
                other = q != v
                found.setdefault(dim, []).append((q[other], v[other], s[other]))
                q, v, s = _nearest(*map(np.concatenate, zip(*found[dim])), k)
                found[dim] = [(q, v, s)]
                last = np.flatnonzero(np.append(q[1:] != q[:-1], True))[: len(q)]  # the worst of each query's
                many = np.diff(np.append(-1, last))
                single = np.searchsorted(asked, q[last], side="right") - np.searchsorted(asked, q[last]) == 1  # ids of one vector
                last, many = last[single], many[single]
                known[np.searchsorted(asked, q[last])] = np.where(many >= k, 2.0 - 2.0 * s[last] + 1e-9, np.inf)
        for (rows,) in found.values():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["query_id", "vec_id", "score"])

    return run


def _nearest(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((-s, v, q))
    q, v, s = q[order], v[order], s[order]
    once = np.append(True, (q[1:] != q[:-1]) | (v[1:] != v[:-1]))[: len(q)]
    q, v, s = q[once], v[once], s[once]
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))[: len(q)]
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[rank < k], v[rank < k], s[rank < k]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 0.35) -> DataFrame:
    """vectors, queries: vec_id, embedding. Per query its k nearest rows of vectors with another id, nearest first:
    query_id, rank, vec_id, score. Of queries with one id and several vectors, each neighbour counts with its best score."""
    spark = vectors.sparkSession

    def sound(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(~bad & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))

    def parts(df: DataFrame, size: int) -> DataFrame:
        """df with a part, so that the vectors of one length and part have about `size` bytes."""
        many = F.ceil(F.col("n") * F.col("dim") * 8 / size)
        counts = [(r.dim, r.parts) for r in df.groupBy("dim").agg(F.count("*").alias("n")).select("dim", many.cast("long").alias("parts")).collect()]  # a row for each length of vectors
        table = F.create_map(*(F.lit(x) for pair in counts for x in pair)) if counts else F.create_map(F.lit(0), F.lit(1).cast("long"))
        return df.withColumn("part", F.pmod(F.xxhash64("vec_id"), table[F.col("dim")]))

    small_batches(vectors, rows=256)
    shards = materialise(parts(sound(vectors), SHARD).groupBy("dim", "part").applyInArrow(tidy_group(_shard), "dim int, tree binary"), "shards")
    asked = materialise(parts(sound(queries).dropDuplicates(), BLOCK), "queries")
    blocks = (asked.agg(F.max("part")).first()[0] or 0) + 1
    out = None
    for block in range(blocks):
        rows = (asked.where(F.col("part") == block) if blocks > 1 else asked).toArrow()  # about BLOCK bytes for each length
        dims, ids = rows.column("dim").to_numpy(), rows.column("vec_id").to_numpy()
        data = {}
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            order = at[np.argsort(ids[at], kind="stable")]
            values = rows.column("v").take(pa.array(order)).combine_chunks().flatten().to_numpy().reshape(len(at), dim)
            data[dim] = (ids[order], values, unit(values))
        found = shards.mapInArrow(tidy(_search(k, factor, spark.sparkContext.broadcast(data))), "query_id long, vec_id long, score double")
        out = found if out is None else out.unionByName(found)
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
