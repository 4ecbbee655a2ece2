"""Hashed text features and linear models in numpy, shared by the two text classifiers."""

from __future__ import annotations

import operator
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

BUCKETS = 1 << 20
_TRIM = b".,;:!?\"'()[]{}#*$%&|<>-_~/\\"
_PREFIX = 4


def word_features(word: bytes) -> tuple[int, ...]:
    """Buckets of a lower-cased word: the trimmed word, and its first characters if it has more."""
    core = word.strip(_TRIM)
    if not core:
        return (zlib.crc32(b"\0" + word) % BUCKETS,)
    whole = zlib.crc32(core) % BUCKETS
    start = core.decode("utf-8", "replace")[:_PREFIX].encode("utf-8", "replace")
    return (whole, zlib.crc32(b"^" + start) % BUCKETS) if len(start) < len(core) else (whole,)


def text_features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a whole text's words."""
    if not isinstance(text, str) or not text:
        return np.zeros(0, dtype=np.int32)
    found: set[int] = set()
    for word in set(text.encode("utf-8", "surrogatepass").lower().split()):
        found.update(word_features(word))
    return np.sort(np.fromiter(found, dtype=np.int32, count=len(found)))


def shape(text: str | None) -> np.ndarray:
    """Surface measures of a whole text, each between about -1 and 1."""
    if not isinstance(text, str) or not text.strip():
        return np.array([1.0, *[0.0] * (SHAPES - 1)])
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(1, sum(map(len, words)))
    octets = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:], strict=False))
    return np.array(
        [
            0.0,
            min(1.0, np.log1p(n) / 10),
            min(1.0, size / n / 20),
            octets[65:91].sum() / size,
            octets[48:58].sum() / size,
            (octets[33:48].sum() + octets[58:65].sum() + octets[91:97].sum() + octets[123:127].sum()) / size,
            octets[[35, 42, 36, 37, 38, 124, 60, 62]].sum() / size,
            octets[33] / size,
            1 - len(set(lines)) / len(lines),
            len(set(words)) / n,
            1 - len(pairs) / max(1, n - 1),
            sum(map(operator.eq, words, words[1:])) / n,
            1.0 if n < 10 else 0.0,
        ]
    )


SHAPES = 13


#: Features of one text that training sees at most: those of the smallest hashes.  Scoring sees all.
MAX_FEATURES = 4096


def sampled(frame: DataFrame, key: str, size: int) -> DataFrame:
    """At most ``size`` distinct rows, the same whatever the partitions: those of the smallest key hashes.

    Only keys below a hash that leaves about twice as many are made distinct; if too few are left, more.
    """
    order = F.xxhash64(F.col(key).cast("string"), F.lit("sample"))
    found = frame.agg(F.approx_count_distinct(key)).first()[0]
    share = min(1.0, 2 * size / max(1, found))
    while True:
        picked = frame if share >= 1 else frame.filter(order < F.lit(int(share * 2**64) - 2**63).cast("long"))
        picked = picked.distinct()
        if share >= 1 or picked.limit(size).count() >= size:
            return picked.orderBy(order, key).limit(size)
        share = min(1.0, 2 * share)


def one_text(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(the columns of ``keys``, text): one row for each of the few ``keys`` that ``docs`` holds.

    Of rows with the same id the text of the least hash is taken, by partial aggregation, so that an id
    repeated a million times is one row a task.
    """
    rows = docs.select(col(id_col).alias("key"), col(text_col).alias("text"))
    picked = rows.join(F.broadcast(keys), "key")
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")
    return picked.groupBy(*keys.columns).agg(first).select(*keys.columns, F.col("first.text").alias("text"))


def collected(docs: DataFrame, text_col: str, keep: list[str], with_shape: bool = False) -> pd.DataFrame:
    """The ``keep`` columns and the features (as bytes) of a bounded set of documents, each at most
    ``MAX_FEATURES`` features."""

    def scan(batches):
        for batch in batches:
            out = batch[keep].copy()
            out["features"] = [bounded(text_features(t)).tobytes() for t in batch[text_col]]
            out["shape"] = [shape(t).tobytes() if with_shape else b"" for t in batch[text_col]]
            yield out

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*keep, text_col).mapInPandas(scan, f"{kinds}, features binary, shape binary").collect()
    return pd.DataFrame([tuple(r) for r in rows], columns=[*keep, "features", "shape"])


def bounded(features: np.ndarray, most: int = MAX_FEATURES) -> np.ndarray:
    """At most ``most`` of sorted buckets, chosen by a hash of the bucket."""
    if len(features) <= most:
        return features
    order = np.argsort(features.astype(np.uint32) * np.uint32(2654435761), kind="stable")[:most]
    return np.sort(features[order])


class Design:
    """Sparse 0/1 rows over the buckets that matter, with dense columns beside them."""

    def __init__(self, features: list[np.ndarray], dense: np.ndarray, active: np.ndarray):
        self.active, self.dense = active, dense
        where = [np.searchsorted(active, f) for f in features]
        hits = [w[(w < len(active)) & (active[np.minimum(w, len(active) - 1)] == f)] if len(active) else w[:0] for w, f in zip(where, features, strict=True)]
        self.cols = np.concatenate(hits) if hits else np.zeros(0, dtype=np.int64)
        self.rows = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
        self.size = len(features)

    def dot(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.cols], minlength=self.size) + self.dense @ v

    def back(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.cols, weights=g[self.rows], minlength=len(self.active)), self.dense.T @ g


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def telling(positive: list[np.ndarray], other: list[np.ndarray], least: int = 5, z: float = 4.0) -> np.ndarray:
    """Buckets whose share of texts differs between the two sets by ``z`` standard errors."""
    a = np.bincount(np.concatenate(positive), minlength=BUCKETS) if positive else np.zeros(BUCKETS)
    b = np.bincount(np.concatenate(other), minlength=BUCKETS) if other else np.zeros(BUCKETS)
    n, m = max(1, len(positive)), max(1, len(other))
    p = (a + b) / (n + m)
    error = np.sqrt(p * (1 - p) * (1 / n + 1 / m)) + 1e-12
    return np.flatnonzero((a + b >= least) & (np.abs(a / n - b / m) >= z * error))


def adam(step, start: list[np.ndarray], rounds: int, rate: float = 0.05) -> list[np.ndarray]:
    """``step`` gives the gradients at the parameters; full batches, so runs are reproducible; the rate
    falls to nothing."""
    x = [s.copy() for s in start]
    m, v = [np.zeros_like(s) for s in start], [np.zeros_like(s) for s in start]
    for t in range(1, rounds + 1):
        for k, g in enumerate(step(x)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            x[k] = x[k] - rate * (1 - t / (rounds + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return x


class Scorer:
    """Scores whole texts with bucket weights; a bounded memo spares known words."""

    MEMO = 100_000

    def __init__(self, active: np.ndarray, weights: np.ndarray, dense: np.ndarray, with_shape: bool = False):
        self.weight = {int(a): float(w) for a, w in zip(active, weights, strict=True) if w}
        self.dense, self.with_shape, self.memo = dense, with_shape, {}

    def __call__(self, text: str | None) -> float:
        z = float(self.dense[0])
        if self.with_shape:
            z += float(shape(text) @ self.dense[1:])
        if not isinstance(text, str) or not text:
            return z
        hits: set[int] = set()
        memo = self.memo
        if len(memo) > self.MEMO:
            memo.clear()
        for word in set(text.encode("utf-8", "surrogatepass").lower().split()):
            found = memo.get(word)
            if found is None:
                found = memo[word] = tuple(f for f in word_features(word) if f in self.weight)
            if found:
                hits.update(found)
        return z + sum(map(self.weight.__getitem__, sorted(hits)))
