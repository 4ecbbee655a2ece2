"""Matching front-end names against the strings of units (binaries, or any owner of texts).

Containment is no equi-join.  Three physical forms give the same rows: an Aho-Corasick scan with the
names broadcast (one pass over each string, for names within a checked size), an equi-join on the
strings' substrings of the names' lengths (any number of names, JVM only), and a broadcast
nested-loop join (a handful of names, JVM only).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .common import fits, saved

try:
    import ahocorasick
except ImportError:  # the scan then gives way to the substring join
    ahocorasick = None


def contains_pairs(strings: DataFrame, names: DataFrame, *, owner: str = "bin", s: str = "s", method: str = "auto") -> DataFrame:
    """(owner, name), distinct: names contained in any string of an owner.

    ``method``: scan, explode, loop, or auto, which counts the names.
    """
    names = saved(names.select("name").filter("name <> ''").distinct())  # counted, measured and joined
    rows = strings.select(F.col(owner).alias("owner"), F.col(s).alias("s")).filter("s IS NOT NULL")
    if method == "auto":
        method = "loop" if names.limit(9).count() < 9 else "scan" if ahocorasick and fits(names) else "explode"
    if method == "loop":
        found = rows.join(F.broadcast(names), F.contains(F.col("s"), F.col("name"))).select("owner", "name")
    elif method == "explode":
        lengths = sorted(r[0] for r in names.select(F.length("name")).distinct().collect())  # few: lengths of names

        def substrings(k: int) -> Column:
            every = F.sequence(F.lit(1), F.length("s") - (k - 1))
            cut = F.transform(every, lambda at: F.substr(F.col("s"), at, F.lit(k)))
            return F.when(F.length("s") >= k, cut).otherwise(F.array().cast("array<string>"))

        pieces = [substrings(k) for k in lengths]
        if not pieces:
            return rows.select("owner", F.lit("").alias("name")).limit(0)
        parts = rows.select("owner", F.explode(F.array_distinct(F.concat(*pieces))).alias("name"))
        found = parts.join(names, "name", "left_semi").select("owner", "name")
    else:
        kind = rows.schema["owner"].dataType.simpleString()
        shared = strings.sparkSession.sparkContext.broadcast([r.name for r in names.collect()])  # within BROADCAST_BYTES

        def scan(batches):
            machine = ahocorasick.Automaton()
            for word in shared.value:
                machine.add_word(word, word)
            machine.make_automaton()
            for batch in batches:
                hits: dict = {}
                for who, line in zip(batch["owner"], batch["s"], strict=True):
                    hits.setdefault(who, set()).update(w for _, w in (machine.iter(line) if len(machine) else ()))
                pairs = [(who, w) for who, words in hits.items() for w in words]
                yield pd.DataFrame(pairs, columns=["owner", "name"])

        found = rows.mapInPandas(scan, f"owner {kind}, name string")
    return found.distinct().withColumnRenamed("owner", owner)


def segment_pairs(strings: DataFrame, names: DataFrame, *, owner: str = "bin", s: str = "s") -> DataFrame:
    """(owner, name, full_str), distinct: strings with slashes one of whose segments is a name.

    An equi-join on exploded segments; every such string is reported, whatever else matched.
    """
    rows = strings.filter(F.contains(F.col(s), F.lit("/"))).select(F.col(owner), F.col(s).alias("full_str"))
    parts = rows.select(owner, "full_str", F.explode(F.array_distinct(F.split("full_str", "/"))).alias("name"))
    return parts.join(names.select("name").distinct(), "name").select(owner, "name", "full_str").distinct()


def keyword_matches(strings: DataFrame, keywords: DataFrame, *, owner: str = "bin", s: str = "s", method: str = "auto") -> DataFrame:
    """(owner, name, match_str, full_str): contained in a string without slash, or a segment of one
    with; ``full_str`` is the string where it can be taken over as a path."""
    plain = strings.filter(~F.contains(F.col(s), F.lit("/")))
    inside = contains_pairs(plain, keywords, owner=owner, s=s, method=method).withColumn("full_str", F.lit(None).cast("string"))
    parts = segment_pairs(strings, keywords, owner=owner, s=s)
    parts = parts.withColumn("full_str", F.when(text.path_string_ok(F.col("full_str")), F.col("full_str")))
    return inside.select(owner, "name", "full_str").union(parts.select(owner, "name", "full_str")).distinct().select(
        owner, "name", F.col("name").alias("match_str"), "full_str"
    )


def api_matches(strings: DataFrame, apis: DataFrame, *, owner: str = "bin", s: str = "s", method: str = "auto") -> DataFrame:
    """(owner, name, match_str): API names contained whole, else their segments that are contained."""
    apis = apis.select("name").distinct()
    whole = contains_pairs(strings, apis, owner=owner, s=s, method=method)
    parts = apis.filter(F.contains("name", F.lit("/"))).select("name", F.explode(F.array_distinct(F.split("name", "/"))).alias("part"))
    parts = parts.filter("part <> ''")
    found = contains_pairs(strings, parts.select(F.col("part").alias("name")), owner=owner, s=s, method=method)
    fallback = found.withColumnRenamed("name", "part").join(parts, "part").join(whole, [owner, "name"], "left_anti")
    return whole.select(owner, "name", F.col("name").alias("match_str")).union(fallback.select(owner, "name", F.col("part").alias("match_str")))


def urn_strings(strings: DataFrame, *, owner: str = "bin", s: str = "s") -> DataFrame:
    """(owner, urn), distinct: device names that a unit mentions."""
    return strings.filter(F.col(s).startswith("urn:")).select(owner, F.col(s).alias("urn")).distinct()


def terminated(strings: DataFrame, names: DataFrame, *, owner: str = "bin", s: str = "s") -> DataFrame:
    """(owner, name, s): strings that end with a name: it is found at any start, and a zero follows.

    An equi-join on the strings' suffixes of the names' lengths.
    """
    names = names.select("name").filter("name <> ''").distinct()
    lengths = [r[0] for r in names.select(F.length("name")).distinct().collect()]
    if not lengths:
        return strings.select(owner, F.lit("").alias("name"), s).limit(0)
    ends = F.array_distinct(F.array(*(F.when(F.length(s) >= k, F.right(F.col(s), F.lit(k))) for k in sorted(lengths))))
    rows = strings.select(owner, s, F.explode(ends).alias("name")).filter("name IS NOT NULL")
    return rows.join(names, "name").select(owner, "name", s).distinct()


def by_presence(strings: DataFrame, keys: DataFrame, *, owner: str = "bin", s: str = "s", ignore: str = "lib") -> DataFrame:
    """(owner, name): units, but libraries, in which a data key is found anywhere."""
    return contains_pairs(strings.filter(~F.contains(F.col(owner), F.lit(ignore))), keys, owner=owner, s=s)


def by_dual(strings: DataFrame, call_args: DataFrame, keys: DataFrame, dual: str, *, owner: str = "bin", s: str = "s") -> DataFrame:
    """(owner, name): units with the key and the dual function's name, where the key is a constant
    argument of a call to it (``call_args``: bin, callee, const_str)."""
    named = strings.filter(F.contains(F.col(s), F.lit(dual))).select(owner).distinct()
    present = by_presence(strings, keys, owner=owner, s=s).join(named, owner, "left_semi")
    used = call_args.filter(F.contains("callee", F.lit(dual))).select(F.col("bin").alias(owner), F.col("const_str").alias("name"))
    return present.join(used, [owner, "name"], "left_semi")


def by_binding(contents: DataFrame, bindings: DataFrame, *, owner: str = "bin") -> DataFrame:
    """(owner, port, ip): units whose bytes hold a binding's address text and its port, low byte first."""
    wide = F.upper(F.lpad(F.hex(F.col("port")), 4, "0"))
    marks = bindings.select("port", "ip", F.unhex(F.concat(F.substring(wide, 3, 2), F.substring(wide, 1, 2))).alias("mark")).distinct()
    shown = contents.select(owner, F.decode(F.col("content"), "ISO-8859-1").alias("s"))
    named = contains_pairs(shown, bindings.select(F.col("ip").alias("name")), owner=owner).withColumnRenamed("name", "ip")
    pairs = contents.select(owner, "content").join(named.join(marks, "ip"), owner)
    return pairs.filter(F.contains("content", "mark")).select(owner, "port", "ip").distinct()
