"""Quality rules whose thresholds adapt to each language and source.

Method: each metric of each document falls into a logarithmic bucket (relative error ``ERROR``); the
counts of a group's buckets are a quantile sketch that merges by addition, so partial aggregation
builds it before the shuffle and a source with a third of all documents costs one row a bucket and
task.  A group's quantiles (``LOW``, median, ``HIGH``) are shrunk towards its language's, and these
towards the corpus's, the more the fewer documents it has, so no count switches a threshold.  The
fence is where an exponential tail through median and ``HIGH`` quantile is exceeded by one document
in ``rare``, plus a small slack for what counts of few words cannot resolve (and the same below for
the mean word length).  Documents join their fences and are kept within all of them.

Defined cases: a null or empty text has no words and fails the base rules; null languages and
sources are groups of their own; repeated rows count as often as they occur; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import operator
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, small, trim, written

#: Relative error of a sketched quantile.
ERROR = 0.01
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter"]
_SYMBOLS = re.compile(rb"[#*$%&|<>]")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in ``words``, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    base = len(number)
    code = ids[:n].copy()
    room = base
    for k in range(1, window):  # exact: codes are renumbered before they could overflow
        if room > (1 << 62) // base:
            _, code = np.unique(code, return_inverse=True)
            room = n
        code = code * base + ids[k : k + n]
        room *= base
    _, where, times = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[where] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The ``COUNTS`` of one text; n_lines: those with a word; n_stutter: words equal to the one before."""
    if not isinstance(text, str) or not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    symbols = len(_SYMBOLS.findall(raw))
    stutter = sum(map(operator.eq, words, words[1:]))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), stutter


def counts(docs: DataFrame, id_col: str, text_col: str, groups: list[str]) -> DataFrame:
    """(doc_id, groups as g0, g1.., the counts)."""
    kinds = [docs.schema[c].dataType.simpleString() for c in [id_col, *groups]]
    names = ["doc_id", *(f"g{k}" for k in range(len(groups)))]

    def scan(batches):
        for batch in batches:
            found = pd.DataFrame([text_counts(t) for t in batch["text"]], columns=COUNTS, dtype=np.int64)
            for name, kind in zip(names, kinds, strict=True):
                found[name] = batch[name].astype("Int64") if kind == "bigint" else batch[name]
            yield found[[*names, *COUNTS]]
        trim()

    picked = [col(c).alias(n) for c, n in zip([id_col, *groups], names, strict=True)]
    schema = ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds, strict=True)), *(f"{c} long" for c in COUNTS)])
    return docs.select(*picked, col(text_col).alias("text")).mapInPandas(scan, schema)


#: metric: (expression over the counts, in thousandths; slack of the fence; has a lower fence too)
METRICS = {
    "symbols": ("1000 * n_symbols / greatest(word_chars, 1)", 10.0, False),
    "dup_lines": ("1000 * n_dup_lines / (n_lines + 10)", 100.0, False),
    "repeats": ("1000 * n_repeat_words / greatest(n_words, 1)", 150.0, False),
    "stutter": ("1000 * n_stutter / greatest(n_words, 1)", 50.0, False),
    "word_length": ("1000 * word_chars / greatest(n_words, 1)", 500.0, True),
}
#: Quantiles of a sketch that make its fences beside the median; they are far enough in that junk of less
#: than a quarter of a group does not move them.
LOW, HIGH = 0.25, 0.75


def reach(rare: float) -> float:
    """Distances between median and ``HIGH`` quantile from there to what one document in ``rare`` exceeds,
    if the tail is exponential."""
    return math.log((1 - HIGH) * rare) / math.log(0.5 / (1 - HIGH))


def _bucket(value: Column) -> Column:
    gamma = (1 + ERROR) / (1 - ERROR)
    return F.when(value > 0, F.ceil(F.round(F.log(value) / float(np.log(gamma)), 9)).cast("int"))


def _quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, docs, low, mid, high): quantiles of each group from its merged sketch."""
    gamma = (1 + ERROR) / (1 - ERROR)
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    order = ", ".join([*by, "metric"])
    ranked = merged.selectExpr(
        "*",
        f"sum(n) OVER (PARTITION BY {order} ORDER BY bucket NULLS FIRST) AS upto",
        f"sum(n) OVER (PARTITION BY {order}) AS docs",
    ).withColumn("value", F.coalesce(F.pow(F.lit(gamma), F.col("bucket")) * 2 / (1 + gamma), F.lit(0.0)))
    found = [F.min(F.when(F.col("upto") >= F.col("docs") * q, F.col("value"))).alias(n) for q, n in ((LOW, "low"), (0.5, "mid"), (HIGH, "high"))]
    return ranked.groupBy(*by, "metric").agg(F.max("docs").alias("docs"), *found)


def thresholds(counted: DataFrame, levels: int, rare: float, strength: float) -> DataFrame:
    """(g0, g1.., fences map<metric, struct<low, high>>) for every group of all ``levels`` columns."""
    groups = [f"g{k}" for k in range(levels)]
    values = F.array(*(F.struct(F.lit(m).alias("metric"), F.expr(e).alias("value")) for m, (e, *_) in METRICS.items()))
    rows = counted.select(*groups, F.explode(values).alias("v"))
    finest = written(
        rows.groupBy(*groups, F.col("v.metric").alias("metric"), _bucket(F.col("v.value")).alias("bucket")).agg(
            F.count("*").alias("n")
        ),
        "sketches",
    )
    out = finest.select(*groups, "metric").distinct()
    shrunk: dict[str, Column] = {}
    for depth in range(levels + 1):  # corpus, language, language and source
        by = groups[:depth]
        own = _quantiles(finest, by).select(
            *(F.col(g).alias(f"k_{g}") for g in by),
            F.col("metric").alias("k_metric"), *(F.col(c).alias(f"{c}{depth}") for c in ("docs", "low", "mid", "high")),
        )
        on = F.col("metric") == F.col("k_metric")
        for g in by:
            on = on & F.col(g).eqNullSafe(F.col(f"k_{g}"))
        out = out.join(own, on).drop("k_metric", *(f"k_{g}" for g in by))
        for c in ("low", "mid", "high"):
            mine, docs = F.col(f"{c}{depth}"), F.col(f"docs{depth}")
            shrunk[c] = (docs * mine + strength * shrunk[c]) / (docs + strength) if depth else mine
    far = reach(rare)
    slack = F.create_map(*(x for m, (_, s, _) in METRICS.items() for x in (F.lit(m), F.lit(s))))[F.col("metric")]
    low = F.round(shrunk["low"] - (shrunk["mid"] - shrunk["low"]) * far - slack, 6)
    high = F.round(shrunk["high"] + (shrunk["high"] - shrunk["mid"]) * far + slack, 6)
    out = out.select(*groups, "metric", F.struct(low.alias("low"), high.alias("high")).alias("fence"))
    return written(
        out.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("metric", "fence"))).alias("fences")),
        "fences",
    )


def judge(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"),
    rare: float = 10000.0, strength: float = 100.0, min_words: int = 10, max_repeat_percent: int = 20,
) -> DataFrame:
    """doc_id, the counts, base_failed and kept: one row per row of ``docs``.

    ``strength``: documents that a parent's quantiles weigh against a group's own.
    """
    counted = written(counts(docs, id_col, text_col, list(groups)), "counts")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    # what fails the base rules has no say in the thresholds
    fences = thresholds(counted.filter(~failed), len(groups), rare, strength)
    names = [f"g{k}" for k in range(len(groups))]
    on: Column = F.lit(True)
    for g in names:
        on = on & F.col(g).eqNullSafe(F.col(f"k_{g}"))
    joined = counted.join(small(fences.select(*(F.col(g).alias(f"k_{g}") for g in names), "fences")), on, "left")
    inside: Column = F.lit(True)
    for metric, (value, _, lower) in METRICS.items():
        fence = F.col("fences")[metric]
        within = F.expr(value) <= fence["high"]
        inside = inside & ((within & (F.expr(value) >= fence["low"])) if lower else within)
    return joined.select(
        "doc_id", *COUNTS, failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(True))).alias("kept")
    )
