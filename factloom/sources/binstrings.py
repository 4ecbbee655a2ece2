"""Printable strings of binaries."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strings(files: DataFrame, *, key: str = "path", content: str = "content", least: int = 4) -> DataFrame:
    """bin_strings(bin, s): distinct runs of at least ``least`` printable characters, in the JVM."""
    shown = F.decode(F.col(content).cast("binary"), "ISO-8859-1")
    runs = F.regexp_extract_all(shown, F.lit(r"([\x09\x20-\x7E]{%d,})" % least), F.lit(1))
    return files.select(F.col(key).alias("bin"), F.explode(F.array_distinct(runs)).alias("s"))


def runs_at(content: Column, least: int = 2) -> Column:
    """Array of (off, s): every run of printable characters but line feeds, with its byte offset.  A column
    of its row, so that contents stay where they are."""
    pattern = re.compile(rb"[\x09\x0B-\x0D\x20-\x7E]{%d,}" % least)

    @F.arrow_udf("array<struct<off: bigint, s: string>>")
    def scan(data: pa.Array) -> pa.Array:
        first, at, ends, held = array("i", [0]), array("q"), array("i", [0]), bytearray()  # Arrow's own buffers: no object a string
        for d in data:
            for m in pattern.finditer(d.as_py() or b""):
                at.append(m.start())
                held += m[0]
                ends.append(len(held))
            first.append(len(at))
        text = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(held))
        runs = pa.StructArray.from_arrays([pa.array(np.frombuffer(at, dtype=np.int64)), text], names=["off", "s"])
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(first, dtype=np.int32)), runs)

    return scan(content.cast("binary"))


def strings_at(files: DataFrame, *, key: str = "path", content: str = "content", least: int = 2) -> DataFrame:
    """bin_strings(bin, off, s): the rows of ``runs_at``."""
    found = files.select(F.col(key).alias("bin"), F.explode(runs_at(F.col(content), least)).alias("r"))
    return found.select("bin", "r.off", "r.s")
