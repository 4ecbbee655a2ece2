"""Best-fit packing of tokenised documents into fixed-length training sequences.

Method: vector best fit.  A sequence has three capacities - tokens, number of documents and
attention cost (sum of squared piece lengths).  Pieces come in falling size; each goes to that open
sequence, among those where it fits under every capacity, which the weighted residual norm after
placement (or the weighted dot product of demand and residual) picks as the tightest.

Scale: a piece's token ids never leave the task that made them; only one small row per piece is
dealt, at random, into groups of about ``group_size`` pieces, and each group packs by itself, so
memory and time per task stay bounded while only a group's last sequences stay partly empty.

Defined cases: a null or empty text is one piece holding the end token alone; rows are packed as
often as they occur; null ids pass through; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, trim, written

_ENCODERS: dict[str, object] = {}
#: Runs of white space, and of anything else, that go to the tokenizer itself: the fast encoder's pattern
#: engine backtracks along the former and its stack would not hold.
_LONG_SPACE, LONG_WORD = re.compile(r"\s{512}"), 4096


class Encoder:
    """Ids of whole texts exactly as the tokenizer file's own library gives them (special tokens are not
    added; its added tokens are found in texts).

    A byte-level BPE file with a known pattern and no normalizer is encoded by a faster library with the
    same ranks, but only for texts on which both are alike: without any added token's string, and
    without very long runs.  All other texts, and files of another kind, go to the library itself.
    """

    def __init__(self, path: str):
        import tokenizers

        self.exact = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = self._fast(spec)

    def _fast(self, spec: dict):
        import public_tokenizers
        import tiktoken

        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain_file = model["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
        if not plain_file or spec.get("normalizer") or spec.get("truncation"):
            return None
        # byte-level vocabularies write each byte as a printable character
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in printable}
        shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        added = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(shown[c] for c in token): rank for token, rank in model["vocab"].items() if token not in added}
        return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> list[int]:
        odd = self.fast is None or (self.special is not None and self.special.search(text)) or _LONG_SPACE.search(text)
        if odd or (len(text) >= LONG_WORD and max(map(len, text.split()), default=0) >= LONG_WORD):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast(text)


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file; a worker reads each file once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 2048,
    end_id: int = 0,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and its end token, cut only if
    longer than ``seq_len``, the shorter piece first.  ``tokenizer`` is the file's name among the
    public tokenizers, so that every executor finds its own copy."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        import public_tokenizers

        encode = encoder(public_tokenizers.path(tokenizer))
        for batch in batches:
            for lo in range(0, len(batch), 512):
                rows = []
                part = batch.iloc[lo : lo + 512]
                for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                    ids = np.array([*encode(text if isinstance(text, str) else ""), end_id], dtype="<u4")
                    n = len(ids)
                    edges = [0, *range(n % seq_len or min(n, seq_len), n + 1, seq_len)]
                    rows += [
                        (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
                    ]
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                out["doc_id"] = out["doc_id"].astype("Int64") if id_type == "bigint" else out["doc_id"]
                yield out
        trim()

    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInPandas(
        cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(
    lengths: np.ndarray, *, seq_len: int, max_docs: int, max_cost: float, rule: str = "norm",
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece of one group, by vector best fit in falling length."""
    caps = np.array([seq_len, max_docs, max_cost], dtype=float)
    weight = np.array(weights, dtype=float)
    order = np.argsort(-lengths, kind="stable")
    bins = np.full(len(lengths), -1, dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    left = np.empty((3, 1024))  # residual capacities of open sequences
    name = np.empty(1024, dtype=np.int64)
    used, made = 0, 0
    shortest = lengths[order[-1]] if len(order) else 0
    for n, i in enumerate(order.tolist()):
        size = float(lengths[i])
        need = np.array([size, 1.0, size * size])
        at = -1
        if used:
            fits = (left[0, :used] >= size) & (left[1, :used] >= 1) & (left[2, :used] >= need[2])
            spots = np.flatnonzero(fits)
            if len(spots):
                rest = left[:, spots]
                if rule == "dot":
                    score = (weight * need / caps**2) @ rest
                else:
                    score = weight @ ((rest - need[:, None]) / caps[:, None]) ** 2
                at = int(spots[np.argmin(score)])
        if at < 0:
            if used == left.shape[1]:
                left = np.concatenate([left, np.empty_like(left)], axis=1)
                name = np.concatenate([name, np.empty_like(name)])
            at, used = used, used + 1
            left[:, at], name[at] = caps, made
            made += 1
        bins[i], offsets[i] = name[at], seq_len - left[0, at]
        left[:, at] -= need
        if left[0, at] < shortest or left[1, at] < 1 or left[2, at] < shortest**2:
            used -= 1  # closed: the last open one takes its place
            left[:, at], name[at] = left[:, used], name[used]
    return bins, offsets


def pack(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", *, id_col: str = "doc_id", text_col: str = "text",
    seq_len: int = 2048, max_docs: int | None = None, max_cost: float | None = None, rule: str = "norm",
    group_size: int = 16384,
) -> DataFrame:
    """Spans of the packed sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``max_docs`` (default ``seq_len``) and ``max_cost`` (default ``seq_len ** 2``) are the other two
    capacities of a sequence; at their defaults neither binds, as tokens bind first.  A piece that alone
    exceeds one of them gets a sequence of its own.
    """
    cost, most = float(max_cost or seq_len**2), max_docs or seq_len
    pieces = written(
        token_pieces(docs, tokenizer, id_col=id_col, text_col=text_col, seq_len=seq_len).withColumn(
            "deal", F.monotonically_increasing_id()
        ),
        "pieces",
    )
    groups = max(1, round(pieces.count() / group_size))
    kept = [c for c in pieces.columns if c != "deal"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "deal")

    def place(key, group):
        group = group.sort_values(["length", "deal"], ascending=[False, True], ignore_index=True)
        bins, offsets = best_fit(
            group["length"].to_numpy(), seq_len=seq_len, max_docs=most, max_cost=cost, rule=rule
        )
        return group[kept].assign(sequence_id=(np.int64(key[0]) << 40) + bins, offset=offsets)

    return (
        pieces.withColumn("deal_group", F.pmod(F.xxhash64("deal"), F.lit(groups)))
        .groupBy("deal_group")
        .applyInPandas(place, f"{schema}, sequence_id long, offset long")
    )
