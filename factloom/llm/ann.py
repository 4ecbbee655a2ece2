"""Approximate nearest neighbours by learned partitions.

Method: on a bounded sample a neighbour graph is built and cut into equal parts (recursive spectral
bisection with swap refinement); a small network learns from the sample which part a vector and its
neighbours belong to.  The network then assigns every vector to its most probable part and routes
each query to its several most probable parts, where exact distances decide.  How many parts are
probed is measured on the sample, so that ``target`` of the true neighbours lie in them.

Scale: the index is one row a vector (its part beside it).  The number of parts follows the number
of rows up to ``max_sample / 32``.  A part is searched in blocks of at most about ``block_rows``
vectors by ``block_queries`` queries, so a part that holds a third of all vectors becomes many tasks
and none grows with the data; each block returns its nearest ``k`` a query.  The driver holds the
sample and a count for each part, both bounded.

Defined cases: rows with a null id, a null, empty or zero vector, or one with null or non-finite
components take no part, nor do vectors of another length than the commonest (the shorter of equally
common ones); ids name rows, repeated identical rows count once and are never their own neighbours;
ties go to the smaller id; with fewer than ``k`` candidates all are returned; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def neighbours(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """Row numbers of the k nearest other rows of each row."""
    x = x.astype(np.float32)
    square = (x * x).sum(axis=1)
    out = np.empty((len(x), k), dtype=np.int64)
    for lo in range(0, len(x), block):
        part = x[lo : lo + block]
        far = square[None, :] - 2 * (part @ x.T)
        far[np.arange(len(part)), np.arange(lo, lo + len(part))] = np.inf
        out[lo : lo + block] = np.argpartition(far, k - 1, axis=1)[:, :k]
    return out


def _bisect(a: np.ndarray, b: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Sides (0 or 1, equal in number) of a graph given by both directions of its edges."""
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(a, minlength=n)))
    trivial = 1 / scale / np.linalg.norm(1 / scale)
    v = rng.standard_normal(n)
    for _ in range(80):  # power iteration towards the second eigenvector
        v = v + scale * np.bincount(a, weights=(scale * v)[b], minlength=n)
        v -= trivial * (trivial @ v)
        v /= np.linalg.norm(v) + 1e-30
    side = np.zeros(n, dtype=np.int64)
    side[np.argsort(v * scale, kind="stable")[n // 2 :]] = 1
    cut = (side[a] != side[b]).sum()
    for _ in range(8):  # swap equally many vertices that gain most
        gain = np.bincount(a, weights=np.where(side[a] != side[b], 1.0, -1.0), minlength=n)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        left = left[np.argsort(-gain[left], kind="stable")]
        right = right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right), max(1, n // 20))
        good = gain[left[:m]] + gain[right[:m]] > 0
        trial = side.copy()
        trial[left[:m][good]], trial[right[:m][good]] = 1, 0
        new = (trial[a] != trial[b]).sum()
        if new >= cut:
            break
        side, cut = trial, new
    return side


def balanced_parts(near: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Part of each vertex of a neighbour graph: 2^j parts of equal size (give or take one)."""
    n = len(near)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part, rng, count = np.zeros(n, dtype=np.int64), np.random.default_rng(seed), 1
    while count < parts:
        local, out = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        inner = part[a] == part[b]
        a, b = a[inner], b[inner]
        for p in range(count):
            mine = np.flatnonzero(part == p)
            local[mine] = np.arange(len(mine))
            own = part[a] == p
            out[mine] = 2 * p + _bisect(local[a[own]], local[b[own]], len(mine), rng)
        part, count = out, 2 * count
    return part


class Router:
    """One hidden layer and a softmax over parts, in numpy."""

    def __init__(self, x: np.ndarray, soft: np.ndarray, hidden: int = 128, epochs: int = 30, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0).mean() + 1e-12
        x = (x - self.mean) / self.scale
        d, p = x.shape[1], soft.shape[1]
        w = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, p)) * np.sqrt(1 / hidden), np.zeros(p)]
        m, v, t = [0.0] * 4, [0.0] * 4, 0
        total = epochs * -(-len(x) // 256)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), 256):
                rows, t = order[lo : lo + 256], t + 1
                h = np.maximum(0, x[rows] @ w[0] + w[1])
                g = (self._softmax(h @ w[2] + w[3]) - soft[rows]) / len(rows)
                back = (g @ w[2].T) * (h > 0)
                rate = 3e-3 * (1 - t / (total + 1))
                for k, grad in enumerate((x[rows].T @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0))):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.w = w

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.mean) / self.scale
        return self._softmax(np.maximum(0, x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3])


def learn(x: np.ndarray, parts: int, k: int, target: float) -> tuple[Router | None, int]:
    """(router, number of parts to probe) from the sample ``x``."""
    if parts <= 1:
        return None, 1
    near = neighbours(x, k)
    part = balanced_parts(near, parts)
    soft = np.full((len(x), parts), 0.0)
    np.add.at(soft, (np.repeat(np.arange(len(x)), k), part[near].ravel()), 0.5 / k)
    soft[np.arange(len(x)), part] += 0.5
    router = Router(x, soft)
    chance = router(x)
    rank = np.empty_like(chance, dtype=np.int64)
    np.put_along_axis(rank, np.argsort(-chance, axis=1, kind="stable"), np.arange(parts)[None, :], axis=1)
    held = chance.argmax(axis=1)  # where the index will put each vector
    reached = np.sort(rank[np.repeat(np.arange(len(x)), k), held[near].ravel()])
    return router, int(reached[min(len(reached) - 1, int(np.ceil(target * len(reached))))]) + 1


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0)


def search(
    vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
    part_rows: int = 800, max_sample: int = 8192, target: float = 0.93, block_rows: int = 1024,
    block_queries: int = 2048,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, nearest first.

    ``is_query`` is a condition on ``id_col``; every usable row is indexed and is a candidate.
    """
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    rows, n = rows.filter(F.size("v") == sizes.width), sizes["count"]
    parts = 1
    while parts * part_rows < n and parts * 32 < max_sample:
        parts *= 2
    x = np.zeros((0, sizes.width))
    if parts > 1:
        picked = rows.select(F.xxhash64("vec_id", F.lit("sample")).alias("h"), "vec_id", "v")
        x = np.array([r.v for r in picked.orderBy("h", "vec_id").limit(max_sample).collect()], dtype=float)
    router, probes = learn(x, parts, min(k, max(1, len(x) - 1)), target)

    def assign(batches):
        for batch in batches:
            if len(batch):
                chance = router(np.stack(batch["v"].to_numpy()).astype(float))
                yield batch.assign(part=chance.argmax(axis=1).astype(np.int32))

    if router is None:
        index = rows.withColumn("part", F.lit(0))
    else:
        index = rows.mapInPandas(assign, f"vec_id long, v array<{element}>, asks boolean, part int")
    index = written(index, "index")
    held = np.zeros(parts, dtype=np.int64)
    for r in index.groupBy("part").count().collect():  # one row a part
        held[r.part] = r["count"]

    def route(batches):
        for batch in batches:
            if not len(batch):
                continue
            chance = np.ones((len(batch), 1)) if router is None else router(np.stack(batch["v"].to_numpy()).astype(float))
            order = np.argsort(-chance, axis=1, kind="stable")
            # further parts until they hold more than k rows besides the query
            full = np.cumsum(held[order], axis=1) > k
            least = np.where(full.any(axis=1), full.argmax(axis=1) + 1, parts)
            yield batch.assign(parts=[o[: max(probes, m)].astype(np.int32) for o, m in zip(order, least, strict=True)])

    asked = index.filter("asks").select("vec_id", "v").mapInPandas(route, f"vec_id long, v array<{element}>, parts array<int>")
    asked = written(asked.select("vec_id", "v", F.explode("parts").alias("part")), "routes")
    asking = np.zeros(parts, dtype=np.int64)
    for r in asked.groupBy("part").count().collect():  # one row a part
        asking[r.part] = r["count"]
    row_blocks = F.array(*(F.lit(max(1, int(-(-c // block_rows)))) for c in held))[F.col("part")]
    query_blocks = F.array(*(F.lit(int(-(-c // block_queries))) for c in asking))[F.col("part")]
    queries = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit("q")), F.greatest(query_blocks, F.lit(1))).cast("int"))
    queries = queries.withColumn("rb", F.explode(F.sequence(F.lit(0), row_blocks - 1)))
    data = index.select("vec_id", "v", "part").withColumn("many", query_blocks).filter("many > 0")
    data = data.withColumn("rb", F.pmod(F.xxhash64("vec_id", F.lit("r")), row_blocks).cast("int"))
    data = data.withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).drop("many")

    def nearest(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        asked = asked.drop_duplicates("vec_id")
        held = held.sort_values("vec_id").drop_duplicates("vec_id")
        if len(asked) and len(held):
            ids = held["vec_id"].to_numpy()
            base = np.stack(held["v"].to_numpy()).astype(float)
            step = max(1, (1 << 21) // base.size)
            for lo in range(0, len(asked), step):
                part = asked.iloc[lo : lo + step]
                own = part["vec_id"].to_numpy()
                q = np.stack(part["v"].to_numpy()).astype(float)
                far = np.sqrt(((q[:, None, :] - base[None, :, :]) ** 2).sum(axis=2))
                far[own[:, None] == ids[None, :]] = np.inf
                best = np.argsort(far, axis=1, kind="stable")[:, :k]  # stable: ties to the smaller id
                for one, places, row in zip(own.tolist(), best, far, strict=True):
                    out += [(one, i, s) for i, s in zip(ids[places].tolist(), row[places].tolist(), strict=True) if s != np.inf]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ["part", "rb", "qb"]
    found = queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(
        nearest, "query_id long, vec_id long, score double"
    )
    ranked = found.selectExpr("*", "row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank")
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
