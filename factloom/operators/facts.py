"""Smaller rules over program facts: references, symbols, wrappers, seeds, presence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import text
from . import matching, ranges, ranking


def key_references(strings: DataFrame, direct: DataFrame, offsets: DataFrame, pointers: DataFrame) -> DataFrame:
    """(bin, s, ref_addr, ref_kind): references to strings by address, by offset from the table of
    globals, and over a pointer.

    ``strings``: bin, str_addr, s; the others: bin, str_addr, ref_addr.
    """
    kinds = (("direct", direct), ("offset", offsets), ("pointer", pointers))
    refs = None
    for kind, table in kinds:
        one = table.select("bin", "str_addr", "ref_addr", F.lit(kind).alias("ref_kind"))
        refs = one if refs is None else refs.union(one)
    return refs.join(strings.select("bin", "str_addr", "s"), ["bin", "str_addr"]).select("bin", "s", "ref_addr", "ref_kind").distinct()


def string_addresses(strings: DataFrame, names: DataFrame, base: int = 0) -> DataFrame:
    """(bin, name, str_addr): addresses of strings that equal a name (bin, off, s)."""
    return strings.join(names.select(F.col("name").alias("s")).distinct(), "s").select("bin", F.col("s").alias("name"), (F.col("off") + base).alias("str_addr"))


def similar_references(strings: DataFrame, words: tuple[str, ...], references: DataFrame, functions: DataFrame) -> DataFrame:
    """(bin, word, func): for strings similar to a word the function at the least referring address.

    ``strings``: bin, str_addr, s; ``references``: bin, to_addr, from_addr.
    """
    hits = None
    for word in words:
        one = strings.filter(text.similar(F.col("s"), word)).select("bin", F.col("str_addr").alias("to_addr"), F.lit(word).alias("word"))
        hits = one if hits is None else hits.union(one)
    found = ranges.referring_functions(references.join(hits.select("bin", "to_addr").distinct(), ["bin", "to_addr"], "left_semi"), functions)
    joined = hits.join(found, ["bin", "to_addr"])
    return joined.groupBy("bin", "word").agg(F.min(F.struct("ref_addr", "func")).alias("first")).select("bin", "word", F.col("first.func").alias("func"))


def resolved_symbols(calls: DataFrame, linked: DataFrame, symbols: DataFrame) -> DataFrame:
    """``calls`` with the callee's name: from the linkage table, else from the symbol table, else null.

    ``calls``: bin, target; the tables: bin, addr, name.
    """
    out = calls
    for k, table in enumerate((linked, symbols)):
        out = out.join(table.select("bin", F.col("addr").alias("target"), F.col("name").alias(f"__n{k}")), ["bin", "target"], "left")
    return out.withColumn("name", F.coalesce("__n0", "__n1")).drop("__n0", "__n1")


def index_uses(uses: DataFrame, taints: DataFrame) -> DataFrame:
    """Accesses whose address was computed by an addition or subtraction with a tainted operand.

    ``uses``: bin, block, idx, op, var; an access (op load or store) follows the arithmetic in its block.
    """
    sums = uses.filter(F.col("op").isin("add", "sub")).join(taints.select("bin", "var").distinct(), ["bin", "var"], "left_semi")
    first = sums.groupBy("bin", "block").agg(F.min("idx").alias("at"))
    return uses.filter(F.col("op").isin("load", "store")).join(first, ["bin", "block"]).filter("idx > at").drop("at")


def wrappers(history: DataFrame) -> DataFrame:
    """(path, func): the last caller on each path that received taint stands for the role function.

    ``history``: path, seq, func, tainted.
    """
    rows = history.filter("tainted").groupBy("path").agg(F.max(F.struct("seq", "func")).alias("last"))
    return rows.select("path", F.col("last.func").alias("func"))


def real_starts(functions: DataFrame, predecessors: DataFrame) -> DataFrame:
    """Functions but those whose only predecessor block ends where they start: no call leads to them.

    ``predecessors``: bin, func, block_end.
    """
    counted = predecessors.groupBy("bin", "func").agg(F.count("*").alias("n"), F.max("block_end").alias("end"))
    false = functions.select("bin", "func", "entry").join(counted, ["bin", "func"]).filter("n = 1 AND end = entry").select("bin", "func")
    return functions.join(false, ["bin", "func"], "left_anti")


def two_hops(edges: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """(bin, caller, callee): calls of functions that themselves call one of the targets."""
    inner = edges.filter(F.col("callee").isin(*targets)).select("bin", F.col("caller").alias("callee")).distinct()
    return edges.join(inner, ["bin", "callee"], "left_semi").select("bin", "caller", "callee").distinct()


def seeds_or_http(seeds: DataFrame, strings: DataFrame) -> DataFrame:
    """(bin, s): the seeds of each unit, and for units without any the strings of request handling."""
    bare = strings.select("bin", "s").join(seeds.select("bin").distinct(), "bin", "left_anti")
    pattern = text.any_of(params.HTTP_SEEDS)
    return seeds.select("bin", "s").union(bare.filter(F.col("s").rlike(pattern))).distinct()


def entry_blocks(cases: DataFrame, blocks: DataFrame, width: int = 256) -> DataFrame:
    """``cases`` (bin, ref_addr, ..) with the block that holds the reference (bin, block, block_end)."""
    return ranges.within(
        cases, blocks.select("bin", "block", "block_end"), at=F.col("ref_addr"), low=F.col("block"), high=F.col("block_end"), width=width, by=["bin"]
    ).drop("block_end")


def presence_rank(strings: DataFrame, names: DataFrame, *, owner: str = "bin", s: str = "s") -> DataFrame:
    """Units ranked by how many of a fixed list of names they hold; no name is too short or too common."""
    hits = matching.keyword_matches(strings, names, owner=owner, s=s)
    return ranking.border_rank(strings, hits, hits.limit(0), owner=owner, least_keywords=1)


def exact_presence(strings: DataFrame, names: DataFrame, *, owner: str = "bin", s: str = "s") -> DataFrame:
    """(owner, name): names that are a whole string of a unit."""
    return strings.select(owner, F.col(s).alias("name")).distinct().join(names.select("name").distinct(), "name", "left_semi").select(owner, "name")


def not_in_unit(present: DataFrame, unit: str, *, owner: str = "bin") -> DataFrame:
    """(name): what any unit has and the given one has not."""
    mine = present.filter(F.col(owner) == unit).select("name")
    return present.select("name").distinct().join(mine, "name", "left_anti")


def allocations(calls: DataFrame, returns: DataFrame) -> DataFrame:
    """(bin, base, size) of heap blocks: the size argument of a call with the address it returned."""
    return calls.select("bin", "path", "call_addr", "size").join(returns.select("bin", "path", "call_addr", "base"), ["bin", "path", "call_addr"]).select("bin", "base", "size").distinct()
