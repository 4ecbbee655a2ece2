"""Line deduplication with two Bloom filters.

Method: every document's distinct line keys are hashed once and dealt by hash to filter segments.
Each segment streams its hashes through two Bloom filters - one for hashes seen once, one for those
seen again - and only the second one is kept.  Documents are then tested against it where they are;
only lines it suspects are shuffled (as digests, without text), counted exactly, and the keys that
enough documents hold keep their lines in the largest document id alone.

Scale: what is dealt for all lines is 9 bytes a distinct key and batch, counted to two before the
shuffle, so a line in a third of all documents costs one row a batch.  There are as many segments as
the hashes need at ``BITS_PER_KEY`` bits each, so filters are never overfull; a task gets at most
``max_filter_bytes`` of them at once, and a corpus with more is tested in passes over ranges of
segments, each of which scans the texts again.  Suspects are counted with partial aggregation, so a
hot line is a row a task.  No text is shuffled while the repeated keys fit in ``max_keys_bytes``:
they are handed out, and each document drops its lines where it is.  Beyond that the documents that
lose a line - known from a bit map of their ids, handed out - join their lost keys; the others stay
where they are.

Defined cases: a null or empty text is one empty line and its kept text is empty; rows with the same
id are one document for counting; a null id counts as one document that keeps a line only if no
other holds it; repeated rows are treated alike; an empty table gives no rows; other columns,
whatever their names, pass through ``deduplicate`` untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import BITS_PER_KEY, holds, marked, places_of, set_bits
from .common import col, fresh, trim, written

def line_keys(text: str | None, min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, key) of the lines long enough to be compared.

    A key is the line without white space (space, U+0009 to U+000D) at its ends, A-Z lower-cased.
    """
    if not isinstance(text, str) or len(text) < min_chars:
        return []
    found = []
    for n, line in enumerate(text.encode("utf-8", "surrogatepass").lower().split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip()
            size = len(key)
            if size < min_chars:
                continue
            if size >= 4 * min_chars or key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars:
                found.append((n, key))
    return found


def digest(key: bytes) -> bytes:
    """128 bits that stand for a key where rows are counted exactly."""
    return hashlib.blake2b(key, digest_size=16).digest()


def seen_again(docs: DataFrame, text_col: str, min_chars: int, segment_bits: int) -> tuple[DataFrame, int]:
    """(filters(segment, bits), segments): the filters of hashes seen in more than one row; segments
    without any are left out."""

    def hashed(batches):
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                rows = [
                    np.unique(np.array([xxhash.xxh64_intdigest(k) for _, k in line_keys(t, min_chars)], dtype=np.uint64))
                    for t in batch["text"].iloc[lo : lo + 1024]
                ]
                h, n = np.unique(np.concatenate(rows), return_counts=True)
                yield pd.DataFrame({"hash": h.view(np.int64), "n": np.minimum(n, 2).astype(np.int8)})
        trim()

    hashes = written(docs.select(col(text_col).alias("text")).mapInPandas(hashed, "hash long, n tinyint"), "lines")
    segments = max(1, -(-hashes.count() * BITS_PER_KEY // segment_bits))

    def fill(batches):
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            h, where = np.unique(batch["hash"].to_numpy(), return_inverse=True)
            n = np.bincount(where, weights=batch["n"].to_numpy())
            segment, places = places_of(h, segments, segment_bits)
            for s in np.unique(segment).tolist():
                if s not in once:
                    once[s] = np.zeros(segment_bits // 8, dtype=np.uint8)
                    twice[s] = np.zeros(segment_bits // 8, dtype=np.uint8)
                mine = segment == s
                at = places[mine]
                again = holds(once[s], at) | (n[mine] > 1)
                set_bits(twice[s], at[again])
                set_bits(once[s], at)
        for s, bits in twice.items():
            if bits.any():
                yield pd.DataFrame({"segment": [s], "bits": [bits.tobytes()]})

    segment = F.pmod(F.shiftrightunsigned("hash", 40), F.lit(segments)).cast("int")
    filled = hashes.withColumn("segment", segment)
    filled = filled.repartition(min(segments, 65536), "segment").select("hash", "n")
    return written(filled.mapInPandas(fill, "segment int, bits binary"), "filters"), segments


def suspected(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, max_filter_bytes: int = 64 << 20,
    segment_bits: int = 1 << 20,
) -> DataFrame:
    """(doc_id, digest), written: the distinct keys of each row that the filters suspect of repeating."""
    filters, segments = seen_again(docs, text_col, min_chars, segment_bits)
    step = max(1, max_filter_bytes * 8 // segment_bits)
    found = None
    for lo in range(0, segments, step):  # a scan for each range of segments that is handed out at once
        width = min(step, segments - lo)
        bits = np.zeros((width, segment_bits // 8), dtype=np.uint8)
        for row in filters.filter(F.col("segment").between(lo, lo + width - 1)).toLocalIterator():
            bits[row.segment - lo] = np.frombuffer(row.bits, dtype=np.uint8)
        one = written(_suspects(docs, id_col, text_col, min_chars, bits, lo, segments, segment_bits), "suspects")
        found = one if found is None else found.unionByName(one)
    return found


def _suspects(docs: DataFrame, id_col: str, text_col: str, min_chars: int, bits: np.ndarray, first: int, segments: int, segment_bits: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("array<binary>")
    def suspects(texts: pd.Series) -> pd.Series:
        again, out = shared.value, []
        for text in texts:
            keys = list({k for _, k in line_keys(text, min_chars)})
            if keys:
                h = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
                segment, places = places_of(h, segments, segment_bits)
                segment -= first
                inside = (segment >= 0) & (segment < len(again))
                row = np.where(inside, segment, 0)
                held = inside & ((again[row[:, None], places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1)
                keys = [digest(k) for k, hit in zip(keys, held, strict=True) if hit]
            out.append(keys)
        return pd.Series(out, dtype=object)

    rows = docs.select(col(id_col).alias("doc_id"), suspects(col(text_col)).alias("digests"))
    return rows.select("doc_id", F.explode("digests").alias("digest"))


def repeated_keys(suspects: DataFrame, min_docs: int) -> DataFrame:
    """(digest, keeper), written: keys that at least ``min_docs`` documents hold, and the largest of their ids."""
    # one row a document and key first, so that the exact count needs no set of ids
    held = suspects.groupBy("digest", "doc_id").agg(F.lit(1).alias("one"))
    keys = held.groupBy("digest").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"))
    return written(keys.filter(F.col("docs") >= min_docs).select("digest", "keeper"), "keys")


def _without(text: str | None, min_chars: int, gone) -> tuple[str, int]:
    """(text without the lines whose digest ``gone`` accepts, how many these are)."""
    if not isinstance(text, str):
        return "", 0
    lost = {n for n, key in line_keys(text, min_chars) if gone(digest(key))}
    if not lost:
        return text, 0
    return "\n".join([x for n, x in enumerate(text.split("\n")) if n not in lost]), len(lost)


def deduplicate(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5,
    max_filter_bytes: int = 64 << 20, segment_bits: int = 1 << 20, max_keys_bytes: int = 64 << 20, counts: bool = False,
) -> DataFrame:
    """``docs`` with ``text_col`` without its repeated lines, the others joined by a line feed.

    ``counts`` adds n_lines (before) and n_dropped.
    """
    context = docs.sparkSession.sparkContext
    suspects = suspected(
        docs, id_col=id_col, text_col=text_col, min_chars=min_chars, max_filter_bytes=max_filter_bytes, segment_bits=segment_bits,
    )
    keys = repeated_keys(suspects, min_docs)
    named = keys.select("digest", F.col("keeper").cast("string").alias("keeper"))
    size = named.agg(F.sum(F.lit(64) + F.coalesce(F.octet_length("keeper"), F.lit(0)))).first()[0] or 0
    result = "text string, dropped long"
    lost, done = fresh(docs.columns, "lost", "done")
    text = col(text_col)
    if size <= max_keys_bytes:
        pairs = sorted((bytes(r.digest), r.keeper) for r in named.toLocalIterator())
        starts = np.zeros(1 << 21, dtype=np.uint8)  # which first three bytes any key has
        for d, _ in pairs:
            starts[int.from_bytes(d[:3]) >> 3] |= 1 << (d[2] & 7)
        shared = context.broadcast((starts.tobytes(), b"".join(d for d, _ in pairs), [k for _, k in pairs]))

        @F.pandas_udf(result)
        def kept(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
            starts, raw, keepers = shared.value

            def gone(own: str | None):
                def test(d: bytes) -> bool:
                    if not starts[int.from_bytes(d[:3]) >> 3] >> (d[2] & 7) & 1:
                        return False
                    at = _find(raw, d, len(keepers))
                    return at is not None and keepers[at] != own

                return test

            rows = [_without(t, min_chars, gone(i)) for t, i in zip(texts, ids, strict=True)]
            return pd.DataFrame(rows, columns=["text", "dropped"])

        out = docs.withColumn(done, kept(text, col(id_col).cast("string")))
    else:
        own, these = fresh([*docs.columns, lost, done], "own", "these")
        rows = suspects.join(keys, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        rows = written(rows.select("doc_id", "digest").distinct().groupBy("doc_id").agg(F.collect_list("digest").alias("digests")), "lost")
        loses = marked(rows.select(F.xxhash64("doc_id").alias("hash")), max_keys_bytes)

        @F.pandas_udf(result)
        def stripped(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
            held = [frozenset() if g is None else frozenset(map(bytes, g)) for g in gone]
            return pd.DataFrame([_without(t, min_chars, g.__contains__) for t, g in zip(texts, held, strict=True)], columns=["text", "dropped"])

        flagged = docs.withColumn(lost, loses(F.xxhash64(col(id_col))))
        whole = flagged.filter(~F.col(lost)).drop(lost).withColumn(done, F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(0).cast("long").alias("dropped")))
        named = rows.select(F.col("doc_id").alias(own), F.col("digests").alias(these))
        cut = flagged.filter(F.col(lost)).drop(lost).join(named, col(id_col).eqNullSafe(F.col(own)), "left")
        out = whole.unionByName(cut.withColumn(done, stripped(text, F.col(these))).drop(own, these))
    columns = [F.col(f"{done}.text").alias(c) if c == text_col else col(c) for c in docs.columns]
    if counts:
        whole_text = F.coalesce(text, F.lit(""))
        columns += [
            (F.length(whole_text) - F.length(F.replace(whole_text, F.lit("\n"))) + 1).cast("long").alias("n_lines"),
            F.col(f"{done}.dropped").alias("n_dropped"),
        ]
    return out.select(*columns)


def _find(sorted_digests: bytes, wanted: bytes, n: int) -> int | None:
    """Place of a digest among ``n`` sorted ones laid end to end."""
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi) // 2
        if sorted_digests[16 * mid : 16 * mid + 16] < wanted:
            lo = mid + 1
        else:
            hi = mid
    return lo if lo < n and sorted_digests[16 * lo : 16 * lo + 16] == wanted else None
