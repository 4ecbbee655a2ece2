"""Helpers shared by the training-data operators: written tables, size checks, components."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import fits, shared_dir

#: Rows in an Arrow batch at most: whole texts are long.
BATCH_ROWS = 1000
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


def col(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, each lengthened until no column in ``taken`` has it, whatever its case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def short_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches of texts short, so that workers hold a few MB each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def trim() -> None:
    """Gives memory that a worker has freed back to the machine; workers live on after a task."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when this driver ends, or with its scope."""
    path = f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    if (held := _scope.get()) is not None:
        held.append(path)
    return path


@contextlib.contextmanager
def scope() -> Iterator[list[str]]:
    """Collects the paths that this thread makes inside, for ``remove`` once they are not needed any more."""
    held: list[str] = []
    token = _scope.set(held)
    try:
        yield held
    finally:
        _scope.reset(token)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone; the folder is scratch space
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, and a lost
    executor costs nothing that was done before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """``df`` (a written table) marked for broadcast if its rows, measured, are few enough.

    Beyond that it is returned as it is, and the join shuffles (AQE splits skewed partitions).
    """
    return F.broadcast(df) if fits(df) else df


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``links``: pairs of long node ids.  Returns (node, root) for every linked node, ``root`` the
    smallest node reachable.  Each round is a written table; rows never exceed the distinct links.
    """
    edges = written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges"
    )
    mark = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", "u").alias("low"))
        large = (
            both.join(lows, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        )
        # small-star: every node and its lower neighbours are hung below the lowest of them
        lows = large.groupBy("u").agg(F.min("v").alias("low"))
        hung = large.join(lows, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = written(hung.union(lows.select("u", F.col("low").alias("v"))).distinct(), "edges")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return edges.select(
                F.col("u").alias("node"), F.col("v").alias("root")
            ).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = tuple(seen)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
