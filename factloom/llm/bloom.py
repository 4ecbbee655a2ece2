"""Bloom filters over 64-bit hashes, in numpy, and bit maps that tell which rows need a join."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits set for a hash, and room for a hash.
PROBES, BITS_PER_KEY = 4, 16


def places_of(hashes: np.ndarray, segments: int, segment_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each hash, and the bits (hash x probe) it sets there."""
    h = hashes.view(np.uint64)
    segment = ((h >> np.uint64(40)) % np.uint64(segments)).astype(np.int64)
    low = h & np.uint64((1 << 40) - 1)
    step = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(31)) | np.uint64(1)
    bits = low[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)
    return segment, (bits % np.uint64(segment_bits)).astype(np.int64)


def holds(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1)


def set_bits(bits: np.ndarray, places: np.ndarray) -> None:
    flat = places.ravel()
    np.bitwise_or.at(bits, flat >> 3, np.left_shift(1, flat & 7).astype(np.uint8))


def marked(hashes: DataFrame, max_bytes: int = 64 << 20) -> Callable[[Column], Column]:
    """A test for a column of hashes: whether the column ``hash`` (long) of ``hashes`` may hold it.

    The bit map has 16 bits a hash up to ``max_bytes`` and is handed out; a full one only lets more rows
    pass, which the join behind it then decides.
    """
    size = max(1, min(max_bytes, hashes.count() * BITS_PER_KEY // 8))

    def mark(batches):
        bits = np.zeros(size, dtype=np.uint8)
        for batch in batches:
            set_bits(bits, places_of(batch["hash"].to_numpy(), 1, size * 8)[1])
        yield pd.DataFrame({"bits": [bits.tobytes()]})

    whole = np.zeros(size, dtype=np.uint8)
    for row in hashes.coalesce(8).mapInPandas(mark, "bits binary").toLocalIterator():  # at most eight
        whole |= np.frombuffer(row.bits, dtype=np.uint8)
    shared = hashes.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        bits = shared.value
        return pd.Series(holds(bits, places_of(values.to_numpy(), 1, len(bits) * 8)[1]))

    return test
