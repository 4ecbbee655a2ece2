"""Helpers of the operators: shared scratch folder, checked broadcasts, checkpoints, fixpoints."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured bytes stay below this.
BROADCAST_BYTES = 32 << 20
#: Graphs of up to so many edges are searched whole, many in one task; larger ones in rounds of joins.
GROUP_EDGES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` or the context's own.

    Only on one machine a temporary folder is made where neither is set; on a cluster that is an error.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        held = context._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if where is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="factloom-")
        context.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` checkpointed into the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def _width(df: DataFrame) -> Column:
    """Bytes of a row: strings and binaries by their length, anything else by a flat amount."""
    parts = [F.lit(16)]
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)) + 16)
        elif kind in ("array", "map", "struct", "variant"):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)))
        else:
            parts.append(F.lit(16))
    return sum(parts[1:], parts[0])


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df``, measured, may be broadcast."""
    rows = df.limit(limit // 16 + 1)  # no row is narrower, so more than these are too many
    return (rows.agg(F.sum(_width(rows).cast("long"))).first()[0] or 0) <= limit


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(df) if fits(df, limit) else df


def closure(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], *, levels: int | None = None) -> DataFrame:
    """All rows that ``step`` derives from ``seed``, semi-naively and to the fixpoint.

    Each round expands only the rows that are new by ``keys``; it ends when none is.  ``levels`` is for
    relations that are defined by a number of steps (callers three levels up), never a safety stop.
    Known rows are kept as one table: every few rounds the new ones are merged into it.
    """
    known = fresh = saved(seed.dropDuplicates(keys))
    tables, done = 1, 0
    while levels is None or done < levels:
        new = step(fresh).select(*known.columns).dropDuplicates(keys)
        fresh = saved(new.join(known.select(*keys), keys, "left_anti").select(*known.columns))
        if fresh.isEmpty():
            break
        known, tables, done = known.unionByName(fresh), tables + 1, done + 1
        if tables == 8:
            known, tables = saved(known), 1
    return known


def _levels(source: np.ndarray, target: np.ndarray, starts: np.ndarray, nodes: int, levels: int | None) -> np.ndarray:
    """Least number of edges from any start to each node, -1 where none leads: breadth first."""
    order = np.argsort(source, kind="stable")
    target, first = target[order], np.searchsorted(source[order], np.arange(nodes + 1))
    depth = np.full(nodes, -1, dtype=np.int32)
    front, at = np.unique(starts), 0
    while len(front):
        depth[front] = at
        if levels is not None and at >= levels:
            break
        sizes = first[front + 1] - first[front]
        ends = np.cumsum(sizes)
        where = np.repeat(first[front] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        front, at = np.unique(target[where]), at + 1
        front = front[depth[front] < 0]
    return depth


def _contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but roots with the least node linked to it."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = code[: len(a)], code[len(a) :], np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        before = root.copy()
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            below = np.flatnonzero(root < np.arange(len(nodes)))
            return nodes[below], nodes[root[below]]


def connected(links: DataFrame, part_rows: int = 1 << 20) -> DataFrame:
    """(node, root): the least node that the undirected links (a, b), of longs, lead to; a node that no other
    links is left out.  Links are contracted in parts of about ``part_rows``, then hung below the least node
    in alternating rounds over larger and smaller neighbours, whose number grows with the logarithm of a path.
    """
    parts = max(1, math.ceil(links.count() / part_rows))

    def contract(batches):
        held = pd.concat([pd.DataFrame({"a": [], "b": []}, dtype="int64"), *batches], ignore_index=True)
        u, v = _contracted(held["a"].to_numpy(), held["b"].to_numpy())
        yield pd.DataFrame({"u": u, "v": v})

    edges = saved(links.repartitionByRange(parts, "a").mapInPandas(contract, "u long, v long").distinct())
    mark = None
    while True:
        seen = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            own = edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(own).distinct()
        mark = seen
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", "u").alias("low"))
        large = both.join(lows, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("low"))
        hung = large.join(lows, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = saved(hung.union(lows.select("u", F.col("low").alias("v"))).distinct())


def reached(
    edges: DataFrame, seeds: DataFrame, *, group: str = "bin", levels: int | None = None, group_edges: int = GROUP_EDGES,
) -> DataFrame:
    """(group, node, depth): what the edges (group, src, dst) lead to from the seeds (group, node).

    ``depth`` is the least number of edges; seeds have 0, whether or not an edge holds them.  Nulls name
    no group and no node.  Groups of at most ``group_edges`` edges are searched in one go, about that many
    edges to a task, so a whole table of them takes one shuffle however deep they are.  Larger groups fall
    into their connected pieces, which are searched so too; pieces beyond that size are searched in rounds of
    joins, which no size stops.
    """
    steps = saved(edges.select(F.col(group).alias("g"), "src", F.col("dst").cast(edges.schema["src"].dataType)).dropna().distinct())
    start = seeds.select(*(F.col(a).cast(steps.schema[b].dataType).alias(b if b == "g" else a) for a, b in ((group, "g"), ("node", "src"))))
    start = start.dropna().distinct()
    sizes = steps.groupBy("g").agg(F.count("*").alias("n"))
    sums = sizes.agg(F.sum(F.when(F.col("n") <= group_edges, F.col("n"))), F.count_if(F.col("n") > group_edges)).first()
    light, heavy = sums[0] or 0, sums[1]
    plain, hot = steps.withColumn("piece", F.xxhash64("g")), None
    start = start.withColumn("piece", F.xxhash64("g"))
    if heavy:
        # pieces are named by hashes: two of one name only share a task, as groups and nodes keep theirs
        big = small(saved(sizes.filter(F.col("n") > group_edges).select("g")))
        large = saved(steps.join(big, "g", "left_semi").withColumn("node", F.xxhash64("g", "src")))
        roots = saved(connected(large.select(F.col("node").alias("a"), F.xxhash64("g", "dst").alias("b"))))
        named = lambda df: df.join(roots, "node", "left").withColumn("piece", F.coalesce("root", "node")).drop("node", "root")
        parts = saved(named(large))
        counts = saved(parts.groupBy("piece").agg(F.count("*").alias("n")))
        sums = counts.agg(F.sum(F.when(F.col("n") <= group_edges, F.col("n"))), F.count_if(F.col("n") > group_edges)).first()
        light += sums[0] or 0
        begun = named(start.join(big, "g", "left_semi").select("g", F.col("node").alias("at"), F.xxhash64("g", "node").alias("node")))
        begun = begun.select("g", F.col("at").alias("node"), "piece")
        if sums[1]:
            huge = small(counts.filter(F.col("n") > group_edges).select("piece"))
            hot, parts = saved(parts.join(huge, "piece", "left_semi").select("g", "src", "dst")), parts.join(huge, "piece", "left_anti")
            hot_start, begun = begun.join(huge, "piece", "left_semi").select("g", "node"), begun.join(huge, "piece", "left_anti")
        plain = plain.join(big, "g", "left_anti").unionByName(parts)
        start = start.join(big, "g", "left_anti").unionByName(begun)
    buckets = max(1, math.ceil(light / group_edges), min(edges.sparkSession.sparkContext.defaultParallelism, light // 4096))
    kinds = {f.name: f.dataType.simpleString() for f in start.schema.fields}

    def search(e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        groups, _ = pd.factorize(pd.concat([e["g"], s["g"]], ignore_index=True))
        names, _ = pd.factorize(pd.concat([e["src"], e["dst"], s["node"]], ignore_index=True))
        span, n = int(names.max(initial=0)) + 1, len(e)
        keys = np.concatenate([groups[:n], groups[:n], groups[n:]]).astype(np.int64) * span + names
        places, first, code = np.unique(keys, return_index=True, return_inverse=True)
        depth = _levels(code[:n], code[n : 2 * n], code[2 * n :], len(places), levels)
        hit = np.flatnonzero(depth >= 0)
        g = pd.concat([e["g"], e["g"], s["g"]], ignore_index=True).iloc[first[hit]]
        node = pd.concat([e["src"], e["dst"], s["node"]], ignore_index=True).iloc[first[hit]]
        return pd.DataFrame({"g": g.to_numpy(), "node": node.to_numpy(), "depth": depth[hit]})

    deal = F.pmod(F.xxhash64("piece"), F.lit(buckets)).alias("deal")
    found = plain.select("g", "src", "dst", deal).groupBy("deal").cogroup(start.select("g", "node", deal).groupBy("deal")).applyInPandas(
        search, f"g {kinds['g']}, node {kinds['node']}, depth int"
    )
    if hot is not None:
        onward = hot.withColumnRenamed("src", "node")

        def step(fresh: DataFrame) -> DataFrame:
            return fresh.join(onward, ["g", "node"]).select("g", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"))

        found = found.unionByName(closure(hot_start.withColumn("depth", F.lit(0)), step, ["g", "node"], levels=levels))
    return found.withColumnRenamed("g", group)


def numbered(df: DataFrame, order: list[str], out: str = "number") -> DataFrame:
    """``df`` in order with its place (from 1): sorted by ranges, each range numbered by itself from where
    the one before it ends; the driver holds one count a range."""
    ranges = saved(df.orderBy(*order).withColumn("__range", F.spark_partition_id()))
    base, total = {}, 0
    for r in sorted(ranges.groupBy("__range").count().collect()):
        base[r["__range"]], total = total, total + r["count"]
    if not base:
        return df.withColumn(out, F.lit(0).cast("bigint")).limit(0)
    start = F.create_map(*(F.lit(x) for pair in base.items() for x in pair))[F.col("__range")]
    keys = ", ".join(f"`{c}`" for c in order)
    placed = ranges.selectExpr("*", f"row_number() OVER (PARTITION BY __range ORDER BY {keys}) AS __place")
    return placed.withColumn(out, (start + F.col("__place")).cast("bigint")).drop("__range", "__place")
