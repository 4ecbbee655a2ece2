"""Range and as-of joins over addresses (or any ordered keys) by buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(
    points: DataFrame, spans: DataFrame, *, at: Column, low: Column, high: Column, width: int, by: list[str] | None = None,
) -> DataFrame:
    """Points joined to every span with low <= at <= high, on equal ``by`` columns.

    ``at``, ``low`` and ``high`` are whole numbers over ``points`` and ``spans``; spans are indexed
    under each bucket of ``width`` they touch, so the join is an equi-join.  Choose a width near the
    usual length of a span: rows are spans x (length / width + 1).
    """
    by = by or []
    left = points.withColumn("__at", at).withColumn("__bucket", F.floor(at / width))
    right = spans.withColumn("__low", low).withColumn("__high", high).filter("__low <= __high")
    right = right.withColumn("__bucket", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    joined = left.join(right, [*by, "__bucket"]).filter("__at BETWEEN __low AND __high")
    return joined.drop("__at", "__low", "__high", "__bucket")


def referring_functions(references: DataFrame, functions: DataFrame, width: int = 4096) -> DataFrame:
    """string_refs with the function that holds each: direct ones, else one hop over a pointer.

    ``references``: bin, to_addr, from_addr.  Returns bin, to_addr, ref_addr, func, ref_kind.
    """
    spans = functions.select("bin", "func", "entry", "end_addr")
    bound = {"low": F.col("entry"), "high": F.col("end_addr"), "width": width, "by": ["bin"]}
    held = within(references, spans, at=F.col("from_addr"), **bound).select("bin", "to_addr", F.col("from_addr").alias("ref_addr"), "func")
    loose = references.join(held.select("bin", F.col("ref_addr").alias("from_addr")).distinct(), ["bin", "from_addr"], "left_anti")
    second = references.select("bin", F.col("to_addr").alias("via"), F.col("from_addr").alias("ref_addr"))
    hop = loose.select("bin", "to_addr", F.col("from_addr").alias("via")).join(second, ["bin", "via"])
    hop = within(hop, spans, at=F.col("ref_addr"), **bound).select("bin", "to_addr", "ref_addr", "func")
    return held.withColumn("ref_kind", F.lit("direct")).union(hop.withColumn("ref_kind", F.lit("pointer"))).distinct()


def latest_before(points: DataFrame, bases: DataFrame, *, at: str, base: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Points with the value of the nearest base not above them (null below the first): as-of.

    Both sides are merged in one order; one sort, no pairs.
    """
    by = by or []
    tagged = points.select("*", F.lit(None).cast(bases.schema[base].dataType).alias("__base"), F.lit(None).cast(bases.schema[value].dataType).alias("__value"), F.col(at).alias("__at"), F.lit(1).alias("__side"))
    marks = bases.select(
        *(F.col(c) if c in by else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns),
        F.col(base).alias("__base"), F.col(value).alias("__value"), F.col(base).alias("__at"), F.lit(0).alias("__side"),
    )
    keys = ", ".join(by) or "1"
    frame = f"OVER (PARTITION BY {keys} ORDER BY __at, __side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    found = tagged.unionByName(marks).selectExpr(
        *points.columns, "__side", f"last(__base, true) {frame} AS {base}", f"last(__value, true) {frame} AS {value}"
    )
    return found.filter("__side = 1").drop("__side")
