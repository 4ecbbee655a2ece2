"""Statistics of functions, runs, channels and buffers, and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params


def function_stats(blocks: DataFrame, compares: DataFrame) -> DataFrame:
    """func_stats(bin, func, n_blocks, n_branch, n_memcmp): blocks, blocks with several successors,
    comparisons with a string.  ``blocks``: bin, func, block, succ; ``compares``: bin, func, call_addr."""
    each = blocks.groupBy("bin", "func", "block").agg(F.countDistinct("succ").alias("n"))
    counts = each.groupBy("bin", "func").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("n") > 1).alias("n_branch"))
    calls = compares.groupBy("bin", "func").agg(F.countDistinct("call_addr").alias("n_memcmp"))
    return counts.join(calls, ["bin", "func"], "left").withColumn("n_memcmp", F.coalesce("n_memcmp", F.lit(0)))


def largest_buffer(buffers: DataFrame, *, owner: str, size: str) -> DataFrame:
    """(owner, max_size): a buffer of unknown size counts as unbounded."""
    return buffers.groupBy(owner).agg(F.max(F.coalesce(F.col(size), F.lit(params.UNKNOWN_SIZE))).alias("max_size"))


def suspicious_sizes(buffers: DataFrame, size: str) -> DataFrame:
    return buffers.filter((F.col(size) >= params.BIG_SIZE) & (F.col(size) < params.UNKNOWN_SIZE))


def channel_stats(uses: DataFrame, *, owner: str, channel: str, key: str, channels: list[str]) -> DataFrame:
    """(owner, <channel>_all, <channel>_keys ...): uses and distinct keys of each channel."""
    aggregates = []
    for c in channels:
        mine = F.col(channel) == c
        aggregates += [F.count_if(mine).alias(f"{c}_all"), F.countDistinct(F.when(mine, F.col(key))).alias(f"{c}_keys")]
    return uses.groupBy(owner).agg(*aggregates)


def run_stats(runs: DataFrame, *, owner: str, seconds: str, blocks: str, timed_out: str) -> DataFrame:
    """(owner, n_runs, n_timeouts, visited, avg_seconds, avg_visited) of analysis runs."""
    return runs.groupBy(owner).agg(
        F.count("*").alias("n_runs"), F.count_if(timed_out).alias("n_timeouts"), F.sum(blocks).alias("visited"),
        F.avg(seconds).alias("avg_seconds"), F.avg(blocks).alias("avg_visited"),
    )


def variable_sizes(accesses: DataFrame, *, owner: list[str], offset: str) -> DataFrame:
    """(owner, offset, size): gap to the next distinct offset of the same frame; the last has none."""
    keys = ", ".join(owner)
    rows = accesses.select(*owner, offset).distinct()
    return rows.selectExpr(*owner, offset, f"lead({offset}) OVER (PARTITION BY {keys} ORDER BY {offset}) - {offset} AS size")


def last_value(events: DataFrame, *, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``events`` with the last value seen up to each row, in order."""
    frame = f"OVER (PARTITION BY {', '.join(by)} ORDER BY {', '.join(order)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return events.selectExpr("*", f"last({value}, true) {frame} AS {out}")


def alert_counts(found: DataFrame, *, owner: str, kind: str, key: list[str]) -> DataFrame:
    """(owner, kind, alerts): distinct alerts of each kind."""
    return found.select(owner, kind, *key).distinct().groupBy(owner, kind).agg(F.count("*").alias("alerts"))


def line_counters(lines: DataFrame, *, value: str = "value") -> DataFrame:
    """One row: distinct sinks and distinct parameters of result lines."""
    sink, param = F.regexp_extract(value, r"(0x[0-9a-f]+) -> \w+\s*$", 1), F.regexp_extract(value, r'\[Param "([^"]*)"', 1)
    return lines.agg(F.countDistinct(F.nullif(sink, F.lit(""))).alias("sinks"), F.countDistinct(F.nullif(param, F.lit(""))).alias("parameters"))


def compared(a: DataFrame, b: DataFrame, *, group: str, key: str) -> DataFrame:
    """(group, both, only_a, only_b): distinct keys that two runs share or have alone."""
    rows = a.select(group, key, F.lit(1).alias("side")).union(b.select(group, key, F.lit(2).alias("side"))).distinct()
    sides = rows.groupBy(group, key).agg(F.sum("side").alias("sides"))
    return sides.groupBy(group).agg(*(F.count_if(F.col("sides") == n).alias(name) for n, name in ((3, "both"), (1, "only_a"), (2, "only_b"))))


def only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows of ``a`` whose keys are not in ``b``."""
    return a.distinct().join(b.select(*keys).distinct(), keys, "left_anti")


def merged_roles(*tables: DataFrame) -> DataFrame:
    """Union of role tables without duplicates and without unknown roles."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out.filter("role <> 'UNKNOWN'").dropDuplicates()
