"""SimHash near-duplicate detection with deletion-variant signatures.

Method: a fingerprint is cut into so few segments (``max_bits // 2 + 1``) that in two fingerprints
with at most ``max_bits`` differing bits one segment differs in at most one.  Each distinct
fingerprint is indexed under the variants of its segments with one bit wiped, an equality join on
the variants yields candidates, and the whole fingerprints verify them.

Scale: copies collapse to one fingerprint before anything is indexed, so rows grow with distinct
fingerprints (64 each), not with copies.  A pair is emitted once - by its first near segment, at the
wiped bit in which that segment differs.  A bucket of more than ``crowd`` fingerprints gives a
spanning forest of its links instead of all of them, so that a large group of near copies makes rows
in proportion to its size.  Variants shared by more than ``hot`` fingerprints are indexed once more
by the rest of the fingerprint, in the same way; that second key fixes most of the 64 bits, so no
bucket is searched as a whole however common its segment is, and nothing is capped.

With ``similar`` the links of fingerprints are candidates only: a link of two texts stays where the
exact Jaccard similarity of their sets of ``SHINGLE``-word shingles is at least that, and components are of
texts.  First, of the texts of one fingerprint the first ``HUBS`` stand for it towards others and are
compared with all of its texts, and of what is linked in a crowded bucket more than ``crowd`` members give
spanning forests in ``ORDERS`` orders, all others all of their links.  What this leaves untested - texts beyond
the hubs, pairs of large linked groups - is then searched whole (``_untested``) where it holds more than one
component: each pair of texts of two components is either compared or ruled out by a bound on the similarity
that sizes and parities of shingle hashes give (``sketch``), which excludes no pair that is similar enough.

Defined cases: a null or empty text, or one of white space, has fingerprint zero, which links like
any other; fewer words than a shingle count as one shingle; repeated rows stay and share their
class; null ids take part but never name a component (it is null if it has no other id); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import marked
from .common import col, components, fits, fresh, small, trim, written

BITS = 64
SHINGLE = 5
HUBS = 8
ORDERS = 4
#: Bits of the parities of a text's shingles.
PARITIES = 1024


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> tuple[int, int]:
    """(unsigned fingerprint, number of shingles) of one text."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not w:
        return 0, 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(w)
    if len(w) <= words:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum([len(x) + 1 for x in w]) - 1
        starts = [0, *(ends[: len(w) - words] + 1).tolist()]
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    votes = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[lo : lo + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0]), len(hashes)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp, shingles): ``fp`` is the fingerprint's 64 bits as a long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            found = [fingerprint(t, words) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64") if id_type == "bigint" else batch["doc_id"],
                    "text_hash": batch["text_hash"],
                    "fp": np.array([f for f, _ in found], dtype=np.uint64).view(np.int64),
                    "shingles": np.array([n for _, n in found], dtype=np.int64),
                }
            )
        trim()

    rows = docs.select(
        col(id_col).alias("doc_id"), col(text_col).alias("text"), F.xxhash64(col(text_col)).alias("text_hash")
    )
    return rows.mapInPandas(scan, f"doc_id {id_type}, text_hash long, fp long, shingles long")


def shingle_set(text: str | None, words: int = SHINGLE) -> set[bytes]:
    """The distinct shingles of one text, over the words of its fingerprint."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def similarity(a: set[bytes], b: set[bytes]) -> float:
    """Jaccard similarity; two empty sets are equal."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def sketch(shingles: set[bytes]) -> bytes:
    """For each of ``PARITIES`` values of a hash whether an odd number of shingles has it.  Two sketches differ in
    at most as many bits as there are shingles in only one of the two sets."""
    found = np.array([xxhash.xxh64_intdigest(s) % PARITIES for s in shingles], dtype=np.int64)
    return np.packbits((np.bincount(found, minlength=PARITIES) & 1).astype(np.uint8)).tobytes()


def _cuts(count: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of each of ``count`` nearly equal segments."""
    edges = [round(k * bits / count) for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _mask(width: int, wiped: int | None = None) -> Column:
    """A long with the lowest ``width`` bits set, one of them wiped."""
    mask = ((1 << width) - 1) & ~(0 if wiped is None else 1 << wiped)
    return F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("long")


def _segment(x: Column, cut: tuple[int, int]) -> Column:
    first, width = cut
    return F.shiftrightunsigned(x, first).bitwiseAND(_mask(width))


def _variants(fp: Column, cuts: list[tuple[int, int]]) -> Column:
    """Array of (bit wiped, segment without it), a struct for each of the bits in the cuts."""
    return F.array(
        *(
            F.struct(
                F.lit(first + i).alias("at"),
                _segment(fp, (first, width)).bitwiseAND(_mask(width, i)).alias("rest"),
            )
            for first, width in cuts
            for i in range(width)
        )
    )


def _first_meeting(x: Column, at: Column, cuts: list[tuple[int, int]]) -> Column:
    """Whether, for two fingerprints with xor ``x``, the variant wiped at ``at`` is the one that
    emits them: of the first segment with at most one differing bit, at that bit or at its lowest."""
    found: Column = F.lit(False)
    for k, (first, width) in reversed(list(enumerate(cuts))):
        part = _segment(x, (first, width))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(at - first, F.lit(0)))
        here = (at >= first) & (at < first + width) & F.when(part == 0, at == first).otherwise(part == bit)
        found = F.when(F.bit_count(part) <= 1, here).otherwise(found) if k < len(cuts) - 1 else here
    return found


def forest(fps: np.ndarray, sizes: np.ndarray | None, max_bits: int, ratio: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    left, a, b = np.arange(len(fps)), [], []
    bits = fps.view(np.uint64)
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(bits[left] ^ bits[at]) <= max_bits
            if ratio:
                low, high = np.minimum(sizes[left], sizes[at]), np.maximum(sizes[left], sizes[at])
                near &= low >= ratio * high
            found, left = left[near], left[~near]
            queue += found.tolist()
            a += [at] * len(found)
            b += found.tolist()
    return fps[np.array(a, dtype=np.int64)], fps[np.array(b, dtype=np.int64)]


def links(
    classes: DataFrame, max_bits: int = 2, hot: int = 4096, ratio: float | None = None, crowd: int = 32,
) -> DataFrame:
    """(a, b): pairs of distinct ``fp`` within ``max_bits`` bits that connect all those that are."""
    return _links(classes, max_bits, hot, ratio, crowd)[0]


def _links(
    classes: DataFrame, max_bits: int, hot: int, ratio: float | None, crowd: int, orders: int = 1, whole: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """The links, and with ``whole`` (g, fp): groups in which links may be missing, if there are any.

    With ``orders`` above 1, crowded buckets walk their members in so many different orders.  With ``whole``
    only groups of more than ``crowd`` linked members give forests; any pair that may be linked is among the
    links or in one of the groups.

    With ``ratio`` the classes carry ``size``, and a pair also needs sizes within that ratio.  The
    size's step on the scale of that ratio then belongs to the key: sizes within the ratio are at
    most one step apart, so each row is indexed at its own step and the next.
    """
    cuts = _cuts(max_bits // 2 + 1)
    keep, on = ["fp"], ["at", "rest"]
    near = F.bit_count(F.expr("a ^ b")) <= max_bits
    # each row becomes 64 or more: spread them before, over as many tasks as a shuffle has
    rows = classes.repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    if ratio:
        keep, on = ["fp", "size", "step"], ["at", "rest", "bin"]
        near = near & (F.least("a_size", "b_size") >= ratio * F.greatest("a_size", "b_size"))
        near = near & (F.col("bin") == F.greatest("a_step", "b_step"))
        rows = rows.withColumn("size", F.greatest("size", F.lit(1)))
        step = F.floor(F.log("size") / -math.log(ratio)).cast("int")
        rows = rows.withColumn("step", step).withColumn("bin", F.explode(F.array(F.col("step"), F.col("step") + 1)))
    rows = rows.select(*keep, *on[2:], F.explode(_variants(F.col("fp"), cuts)).alias("v"))
    rows = rows.select(*keep, *on[2:], F.col("v.at").alias("at"), F.col("v.rest").alias("rest"))
    shared = written(
        rows.selectExpr("*", f"count(*) OVER (PARTITION BY {', '.join(on)}) AS n").filter("n > 1"), "variants"
    )
    few = shared.filter(F.col("n") <= crowd)
    left = few.select(*on, *(F.col(c).alias("a" if c == "fp" else f"a_{c}") for c in keep))
    right = few.select(*on, *(F.col(c).alias("b" if c == "fp" else f"b_{c}") for c in keep))
    first = _first_meeting(F.expr("a ^ b"), F.col("at"), cuts)
    found = left.join(right, on).filter(F.col("a") < F.col("b")).filter(near & first).select("a", "b")

    firsts = {first + turn for first, width in cuts for turn in range(min(orders, width))}

    def span(key, group):
        """Links that connect what is linked inside a bucket.  Members that agree in the whole segment meet in
        every wiped variant of it: only those of its first bits connect them, one for each order, the others
        only link members that differ in the wiped bit.  So a large group gives a few rows a member, not one
        for each variant."""
        none = pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in "abg"})
        at = int(key[0])
        fps = group["fp"].to_numpy()
        side = (fps >> at) & 1
        if at not in firsts and side.min() == side.max():
            return none
        if ratio and not (group["step"] == key[2]).any():
            return none  # all one step below: they meet in their own step's bucket
        odd = np.uint64(2 * (at % orders) + 0x9E3779B97F4A7C15)  # the same order wherever members meet
        order = np.argsort(fps.view(np.uint64) * odd, kind="stable")
        fps, sizes = fps[order], group["size"].to_numpy()[order] if ratio else None
        if whole:
            linked = _has_near(fps, max_bits)
            fps, sizes = fps[linked], sizes[linked] if ratio else None
            if not len(fps):
                return none
        a, b = forest(fps, sizes, max_bits, ratio)
        g = np.zeros(len(a), dtype=np.int64)
        if whole:
            a, b, g = _all_links(fps, sizes, a, b, max_bits, ratio, crowd, xxhash.xxh64_intdigest(repr(tuple(map(int, key)))))
        a, b = np.minimum(a, b), np.maximum(a, b)
        kept = (((a ^ b) >> at) & 1 == 1) | (at in firsts)
        if (g != 0).any():
            # a group whose members agree in the wiped bit meets in every variant: once is enough
            ones = pd.Series((a >> at) & 1).groupby(g).transform("nunique").to_numpy()
            kept = np.where(g != 0, (ones > 1) | (at in heads), kept)
        return pd.DataFrame({"a": a[kept], "b": b[kept], "g": g[kept]})

    heads = {first for first, _ in cuts}

    def spanned(rows: DataFrame, on: list[str]) -> DataFrame:
        return rows.select(*on, *keep).groupBy(*on).applyInPandas(span, "a long, b long, g long")

    many, groups = shared.filter(F.col("n") > crowd), None
    if not many.isEmpty():
        spans = spanned(many.filter(F.col("n") <= hot), on)
        huge = many.filter(F.col("n") > hot)
        # outside the shared segment at most max_bits bits differ, so the same cut holds once more
        for own in cuts if not huge.isEmpty() else []:
            rest = [c for c in cuts if c != own] or cuts
            parts = -(-(max_bits // 2 + 1) // len(rest))
            others = [(at + a, w) for at, width in rest for a, w in _cuts(parts, width)]
            again = huge.filter((F.col("at") >= own[0]) & (F.col("at") < own[0] + own[1]))
            again = again.select(*on, *keep, F.explode(_variants(F.col("fp"), others)).alias("v"))
            again = again.select(*on, *keep, F.col("v.at").alias("at2"), F.col("v.rest").alias("rest2"))
            spans = spans.union(spanned(again, [*on, "at2", "rest2"]))
        if whole:
            spans = written(spans.distinct(), "spans")
            groups = spans.filter("g <> 0").select("g", F.col("a").alias("fp"))
        found = found.union(spans.filter("g = 0").select("a", "b")).distinct()
    return found, groups


def _has_near(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether any other fingerprint is within ``max_bits`` bits."""
    bits, step = fps.view(np.uint64), max(1, (1 << 21) // max(1, len(fps)))
    near = lambda lo: np.bitwise_count(bits[lo : lo + step, None] ^ bits[None]) <= max_bits
    return np.concatenate([near(lo).sum(axis=1) > 1 for lo in range(0, len(bits), step)])


def _all_links(
    fps: np.ndarray, sizes: np.ndarray | None, a: np.ndarray, b: np.ndarray, max_bits: int, ratio: float | None, crowd: int, name: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, g): of a forest's trees of up to ``crowd`` members all links, of larger ones the forest's and the
    members themselves (a = b) with the name of the tree's group, which is not 0."""
    order = np.argsort(fps)
    place = lambda x: order[np.searchsorted(fps, x, sorter=order)]
    root = np.arange(len(fps))
    u, v = place(a), place(b)
    for x, y in zip(u.tolist(), v.tolist(), strict=True):  # in the order of the walk: x is in the tree already
        root[y] = root[x]
    count = np.bincount(root, minlength=len(fps))
    dense = count[root] > crowd
    out = [(a[dense[u]], b[dense[u]], np.zeros(int(dense[u].sum()), dtype=np.int64))]
    bits = fps.view(np.uint64)
    for r in np.flatnonzero(count > 1).tolist():
        own = np.flatnonzero(root == r)
        if count[r] > crowd:
            g = np.array([(name ^ xxhash.xxh64_intdigest(int(fps[r]).to_bytes(8, "little", signed=True))) | 1], dtype=np.uint64).view(np.int64)
            out.append((fps[own], fps[own], np.repeat(g, len(own))))
            continue
        i, j = np.triu_indices(len(own), 1)
        i, j = own[i], own[j]
        near = np.bitwise_count(bits[i] ^ bits[j]) <= max_bits
        if ratio:
            near &= np.minimum(sizes[i], sizes[j]) >= ratio * np.maximum(sizes[i], sizes[j])
        out.append((fps[i[near]], fps[j[near]], np.zeros(int(near.sum()), dtype=np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def candidates(numbered: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): pairs of text hashes, of one fingerprint or of two linked ones, one of each the first ``HUBS``.

    ``numbered`` has (fp, text_hash, place), ``found`` the links of fingerprints.
    """
    hubs = numbered.filter(F.col("place") <= HUBS)
    inside = hubs.select("fp", F.col("text_hash").alias("a"), F.col("place").alias("first")).join(
        numbered.filter("place > 1").select("fp", F.col("text_hash").alias("b"), "place"), "fp"
    )
    inside = inside.filter("first < place").select("a", "b")
    across = found.join(hubs.select(F.col("fp").alias("a"), F.col("text_hash").alias("ha")), "a")
    across = across.join(hubs.select(F.col("fp").alias("b"), F.col("text_hash").alias("hb")), "b")
    across = across.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    return inside.union(across).distinct()


def compared(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """(a, b): the pairs of text hashes, a written table, whose texts (text_hash, text) are similar enough."""
    # only texts of a pair are shuffled, each once
    paired = pairs.select(F.explode(F.array("a", "b")).alias("text_hash")).distinct()
    held = written(texts.join(paired, "text_hash", "left_semi").dropDuplicates(["text_hash"]), "paired")
    sides = pairs.join(held.select(F.col("text_hash").alias("a"), F.col("text").alias("ta")), "a")
    sides = sides.join(held.select(F.col("text_hash").alias("b"), F.col("text").alias("tb")), "b")

    def compare(batches):
        for batch in batches:
            alike = [similarity(shingle_set(x), shingle_set(y)) >= similar for x, y in zip(batch["ta"], batch["tb"], strict=True)]
            yield batch.loc[np.array(alike, dtype=bool), ["a", "b"]]
        trim()

    return sides.mapInPandas(compare, "a long, b long")


def _untested(
    numbered: DataFrame, found: DataFrame, groups: DataFrame | None, roots: DataFrame, classes: DataFrame, texts: DataFrame,
    max_bits: int, ratio: float | None, similar: float,
) -> DataFrame | None:
    """(a, b): every pair of texts of two components that ``candidates`` may have left out and that may be
    similar enough; none if no group has two components."""
    crowd = numbered.filter(F.col("place") == HUBS + 1).select("fp")
    held = crowd.select(F.xxhash64("fp").alias("g"), "fp")
    for side in "ab":
        pair = found.join(crowd, found[side] == crowd["fp"], "left_semi")
        held = held.union(pair.select(F.xxhash64("a", "b").alias("g"), F.explode(F.array("a", "b")).alias("fp")))
    held = (held.union(groups) if groups is not None else held).distinct()
    rows = held.join(numbered.select("fp", "text_hash"), "fp").join(roots.withColumnRenamed("node", "text_hash"), "text_hash", "left")
    rows = written(rows.select("g", "fp", "text_hash", F.coalesce("root", "text_hash").alias("root")), "groups")
    mixed = rows.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("g")
    rows = written(rows.join(mixed, "g", "left_semi").join(classes.select("fp", "size"), "fp"), "mixed")
    if rows.isEmpty():
        return None
    wanted = small(written(rows.select("text_hash").distinct(), "wanted"))

    def sketched(batches):
        for batch in batches:
            sets = [shingle_set(t) for t in batch["text"]]
            yield pd.DataFrame({"text_hash": batch["text_hash"], "held": np.array([len(s) for s in sets], dtype=np.int64), "parities": [sketch(s) for s in sets]})
        trim()

    short = texts.join(wanted, "text_hash", "left_semi").mapInPandas(sketched, "text_hash long, held long, parities binary")
    short = written(short.dropDuplicates(["text_hash"]), "sketches")

    def meet(group):
        texts, fps, roots = group["text_hash"].to_numpy(), group["fp"].to_numpy().view(np.uint64), group["root"].to_numpy()
        size, held = np.maximum(group["size"].to_numpy(), 1), group["held"].to_numpy()
        parities = np.frombuffer(b"".join(group["parities"]), dtype=np.uint64).reshape(len(group), -1)
        step, found = max(1, (1 << 21) // len(group)), [np.zeros((0, 2), dtype=np.int64)]
        for lo in range(0, len(group), step):
            near = np.bitwise_count(fps[lo : lo + step, None] ^ fps[None]) <= max_bits
            i, j = np.nonzero(near & (texts[lo : lo + step, None] < texts[None]) & (roots[lo : lo + step, None] != roots[None]))
            i += lo
            # common / all >= similar: so few at most are in one set only
            apart = (held[i] + held[j]) * (1 - similar) / (1 + similar) + 1e-6
            fit = np.abs(held[i] - held[j]) <= apart
            if ratio:
                fit &= np.minimum(size[i], size[j]) >= ratio * np.maximum(size[i], size[j])
            i, j, apart = i[fit], j[fit], apart[fit]
            for k in range(0, len(i), 1 << 16):
                x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                fit = np.bitwise_count(parities[x] ^ parities[y]).sum(axis=1, dtype=np.int64) <= apart[k : k + (1 << 16)]
                found.append(np.stack([texts[x[fit]], texts[y[fit]]], axis=1))
        return pd.DataFrame(np.concatenate(found), columns=["a", "b"])

    return rows.join(short, "text_hash").groupBy("g").applyInPandas(meet, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2,
    ratio: float | None = None, hot: int = 4096, similar: float | None = None, crowd: int = 32,
) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id): one row per document.

    ``root`` names the component by a fingerprint (with ``similar`` by a text hash), ``component_id``
    by its smallest id.
    """
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "prints")
    least = [F.min("doc_id").alias("least"), F.min("shingles").alias("size")]
    classes = written(prints.groupBy("fp").agg(*least), "classes")
    if similar is not None:
        found, groups = _links(classes, max_bits, hot, ratio, crowd, ORDERS, whole=True)
        found = written(found, "links")
        texts = docs.select(F.xxhash64(col(text_col)).alias("text_hash"), col(text_col).alias("text"))
        place = F.expr("row_number() OVER (PARTITION BY fp ORDER BY text_hash)")
        numbered = written(prints.select("fp", "text_hash").distinct().withColumn("place", place), "texts")
        pairs = written(candidates(numbered, found), "pairs")
        alike = written(compared(pairs, texts, similar), "alike")
        roots = components(alike)
        rest = _untested(numbered, found, groups, roots, classes, texts, max_bits, ratio, similar)
        if rest is not None:
            rest = written(rest.join(pairs, ["a", "b"], "left_anti"), "rest")
            more = written(compared(rest, texts, similar), "alike")
            roots = roots if more.isEmpty() else components(alike.union(more))
        roots = roots.withColumnRenamed("node", "text_hash")
        own = prints.groupBy("text_hash").agg(F.min("doc_id").alias("least")).join(roots, "text_hash", "left")
        own = own.withColumn("root", F.coalesce("root", "text_hash"))
        names = own.groupBy("root").agg(F.min("least").alias("component_id"))
        named = written(own.join(names, "root").select("text_hash", "root", "component_id"), "named")
        return prints.join(named, "text_hash").select("doc_id", "text_hash", "fp", "root", "component_id")
    roots = components(links(classes, max_bits, hot, ratio, crowd)).withColumnRenamed("node", "fp")
    rooted = classes.select("fp", "least").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(names, "root").select("fp", "root", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each component, that of the smallest id, with its own columns."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    stays = written(found.groupBy("root").agg(first).select("first.doc_id", "first.text_hash"), "stays")
    rows = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"))
    kept = stays.select(F.col("doc_id").alias("k"), F.col("text_hash").alias("d"), F.lit(True).alias("stays"))
    on = F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("d"))
    verdicts = written(rows.join(kept, on, "left").select("doc_id", "text_hash", "rows", F.col("stays").isNotNull().alias("stays")), "verdicts")
    # texts are moved only for rows that a bit map takes for ones that go, and not even these if few go
    key, digest, maybe = fresh(docs.columns, "key", "digest", "maybe")
    names = [F.col("doc_id").alias(key), F.col("text_hash").alias(digest)]
    gone = written(verdicts.filter("NOT stays").select(*names), "gone")
    on = col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(col(text_col)) == F.col(digest))
    if fits(gone):
        out = docs.join(F.broadcast(gone), on, "left_anti")
    else:
        test = marked(gone.select(F.xxhash64(key, digest).alias("hash")))
        flagged = docs.withColumn(maybe, test(F.xxhash64(col(id_col), F.xxhash64(col(text_col)))))
        checked = flagged.filter(F.col(maybe)).drop(maybe).join(gone, on, "left_anti")
        out = flagged.filter(~F.col(maybe)).drop(maybe).unionByName(checked)
    again = verdicts.filter("stays AND rows > 1").select(*names)
    if again.isEmpty():
        return out
    # a kept row that occurs again: one of its occurrences, the least by all its columns
    again = small(written(again, "again"))
    once = out.join(again, on, "left_anti")
    return once.unionByName(_least_rows(out.join(again, on, "left_semi"), id_col, text_col))


def _least_rows(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each id and text: the least by its other columns, as text where they have no order."""
    others = [f for f in rows.schema.fields if f.name not in (id_col, text_col)]
    ordered = [F.to_json(F.struct(col(f.name))) if f.dataType.typeName() in ("map", "variant") else col(f.name) for f in others]
    place, whole = fresh(rows.columns, "place", "whole")
    keyed = rows.withColumn(place, F.struct(F.lit(0).alias("first"), *(o.alias(f"o{k}") for k, o in enumerate(ordered))))
    keyed = keyed.withColumn(whole, F.struct(*(col(c) for c in rows.columns)))
    least = keyed.groupBy(col(id_col), F.xxhash64(col(text_col))).agg(F.min_by(whole, place).alias("least"))
    return least.select(*(F.col("least").getField(c).alias(c) for c in rows.columns))
