"""Call graphs: closure, pruned simple-path search from references to sensitive calls, formatting.

Facts: ``edges(bin, caller, call_addr, callee)`` and ``args(bin, call_addr, pos, const_str)``; a
missing row of ``args`` is an argument that is no known constant.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import text
from .common import reached, saved


def reachable(edges: DataFrame, seeds: DataFrame, *, backward: bool = False, levels: int | None = None) -> DataFrame:
    """(bin, func): functions reachable from ``seeds(bin, func)`` (or that reach them), seeds included,
    over any number of calls, or at most ``levels``."""
    source, target = ("callee", "caller") if backward else ("caller", "callee")
    steps = edges.select("bin", F.col(source).alias("src"), F.col(target).alias("dst"))
    found = reached(steps, seeds.select("bin", F.col("func").alias("node")), levels=levels)
    return found.select("bin", F.col("node").alias("func"))


def constant_calls(edges: DataFrame, args: DataFrame, positions: dict[str, int] | None = None) -> DataFrame:
    """(bin, call_addr) of calls whose checked argument is a non-empty constant string."""
    positions = params.CONSTANT_POSITION if positions is None else positions
    if not positions:
        return edges.select("bin", "call_addr").limit(0)
    at = F.create_map(*(F.lit(x) for pair in positions.items() for x in pair))[F.col("callee")]
    checked = edges.select("bin", "call_addr", at.alias("pos")).filter("pos IS NOT NULL")
    return checked.join(args.filter("length(const_str) > 0"), ["bin", "call_addr", "pos"]).select("bin", "call_addr").distinct()


def safe_formats(edges: DataFrame, args: DataFrame, positions: dict[str, int] | None = None) -> DataFrame:
    """(bin, call_addr) of calls with a constant format all of whose ``%s`` arguments are constants.

    Arguments after the fourth are never known; without a known format a call is not safe.
    """
    positions = params.FORMAT_POSITION if positions is None else positions
    if not positions:
        return edges.select("bin", "call_addr").limit(0)
    at = F.create_map(*(F.lit(x) for pair in positions.items() for x in pair))[F.col("callee")]
    calls = edges.select("bin", "call_addr", at.alias("pos")).filter("pos IS NOT NULL")
    known = calls.join(args.filter("const_str IS NOT NULL"), ["bin", "call_addr", "pos"])
    kinds = known.select("bin", "call_addr", "pos", F.posexplode_outer(text.format_specifiers(F.col("const_str"))).alias("n", "kind"))
    kinds = kinds.select("bin", "call_addr", "kind", (F.col("pos") + F.col("n") + 1).alias("pos"))
    constant = args.filter("length(const_str) > 0").select("bin", "call_addr", "pos", F.lit(True).alias("constant"))
    checked = kinds.join(constant, ["bin", "call_addr", "pos"], "left")
    fine = (F.col("kind").isNull()) | (F.col("kind") != "%s") | ((F.col("pos") <= 3) & F.coalesce("constant", F.lit(False)))
    return checked.groupBy("bin", "call_addr").agg(F.bool_and(fine).alias("safe")).filter("safe").select("bin", "call_addr")


def harmless_calls(edges: DataFrame, args: DataFrame) -> DataFrame:
    """(bin, call_addr): calls that a constant argument or a safe format makes harmless."""
    return constant_calls(edges, args).union(safe_formats(edges, args)).distinct()


def digest_flags(edges: DataFrame, harmless: DataFrame | None = None, digests: tuple[str, ...] = params.DIGESTS, *, starts: DataFrame | None = None) -> DataFrame:
    """``edges`` with ``digest``: whether this or an earlier call of its function copies input that is
    not constant.  ``starts(bin, func, ref_addr)`` adds a row set for each start, counted from its
    reference on (columns ref_addr then set)."""
    rows = edges
    if harmless is not None:
        rows = rows.join(harmless.withColumn("harmless", F.lit(True)), ["bin", "call_addr"], "left")
        own = F.col("callee").isin(*digests) & F.col("harmless").isNull()
    else:
        own = F.col("callee").isin(*digests)
    keys = ["bin", "caller"]
    if starts is not None:
        rows = rows.join(starts.select("bin", F.col("func").alias("caller"), "ref_addr").distinct(), keys).filter("call_addr >= ref_addr")
        keys = [*keys, "ref_addr"]
    flagged = rows.withColumn("own", own.cast("int"))
    return flagged.selectExpr(
        *edges.columns, *(["ref_addr"] if starts is not None else []),
        f"max(own) OVER (PARTITION BY {', '.join(keys)} ORDER BY call_addr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS digest",
    )


def sink_paths(
    edges: DataFrame, args: DataFrame, references: DataFrame, sinks: tuple[str, ...] = params.COMMAND_SINKS, *,
    digests: tuple[str, ...] = params.DIGESTS,
) -> DataFrame:
    """sink_paths: simple call paths from the function of a reference to a sensitive call.

    ``references``: bin, param, str_addr, func, ref_addr.  Only calls after the reference count in
    its own function; a harmless call of a sink ends a path without result; no callee occurs twice
    and the start never again.  Edges that cannot come to a sink are cut beforehand by backward
    reachability, so the frontier holds live paths alone.  The search ends when no path is open: as no
    callee repeats, that is sure, and no length is cut off.
    """
    harmless = saved(harmless_calls(edges, args))
    live_sinks = edges.filter(F.col("callee").isin(*sinks)).join(harmless, ["bin", "call_addr"], "left_anti")
    useful = reachable(edges.filter(~F.col("caller").isin(*sinks)), live_sinks.select("bin", F.col("caller").alias("func")).distinct(), backward=True)
    flagged = digest_flags(edges, harmless, digests)
    ends = F.col("callee").isin(*sinks)
    onward = flagged.join(useful.withColumnRenamed("func", "callee"), ["bin", "callee"], "left_semi").filter(~ends)
    closing = flagged.filter(ends).join(harmless, ["bin", "call_addr"], "left_anti")
    steps = saved(onward.withColumn("last", F.lit(False)).unionByName(closing.withColumn("last", F.lit(True))))
    first = digest_flags(edges, harmless, digests, starts=references).withColumnRenamed("digest", "flag")
    first = first.join(steps.select("bin", "call_addr", "caller", "callee", "last"), ["bin", "call_addr", "caller", "callee"])
    hop = lambda flag: F.struct(F.col("call_addr").alias("addr"), "callee", F.col(flag).alias("digest"))
    start = references.select("bin", "param", "str_addr", F.col("func").alias("start_func"), "ref_addr").distinct()
    paths = start.join(first.withColumnRenamed("caller", "start_func"), ["bin", "start_func", "ref_addr"]).filter("callee <> start_func")
    paths = paths.select(*start.columns, F.array(hop("flag")).alias("path"), F.array("callee").alias("seen"), F.col("callee").alias("at"), "last")
    done = []
    while True:
        paths = saved(paths)
        done.append(paths.filter("last").select(*start.columns, "path"))
        open_paths = paths.filter("NOT last")
        if open_paths.isEmpty():
            break
        if len(done) == 8:  # one table of what is done, not a branch for each round
            done = [saved(_union(done))]
        grown = open_paths.drop("last").join(steps.withColumnRenamed("caller", "at"), ["bin", "at"])
        new = ~F.array_contains("seen", F.col("callee")) & (F.col("callee") != F.col("start_func"))
        paths = grown.filter(new).select(
            *start.columns, F.concat("path", F.array(hop("digest"))).alias("path"), F.concat("seen", F.array("callee")).alias("seen"),
            F.col("callee").alias("at"), "last",
        )
    return _union(done)


def _union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def sink_reachable(edges: DataFrame, args: DataFrame, references: DataFrame, sinks: tuple[str, ...] = params.COMMAND_SINKS) -> DataFrame:
    """The rows of ``references`` from which some path leads to a sensitive call that is not harmless:
    backward reachability alone, without listing paths, whose number may grow with every branch."""
    live = edges.filter(F.col("callee").isin(*sinks)).join(harmless_calls(edges, args), ["bin", "call_addr"], "left_anti")
    inner = edges.filter(~F.col("caller").isin(*sinks))
    useful = saved(reachable(inner, live.select("bin", F.col("caller").alias("func")), backward=True))
    first = edges.join(references.select("bin", F.col("func").alias("caller"), "ref_addr").distinct(), ["bin", "caller"]).filter("call_addr >= ref_addr")
    direct = first.join(live.select("bin", "call_addr"), ["bin", "call_addr"], "left_semi")
    onward = first.filter(~F.col("callee").isin(*sinks)).join(useful.withColumnRenamed("func", "callee"), ["bin", "callee"], "left_semi")
    hit = direct.select("bin", F.col("caller").alias("func"), "ref_addr").union(onward.select("bin", F.col("caller").alias("func"), "ref_addr")).distinct()
    return references.join(hit, ["bin", "func", "ref_addr"], "left_semi")


def formatted(paths: DataFrame, head: Column | None = None) -> DataFrame:
    """(value): path lines; ``>>`` follows a call into a function that copied input before its next call."""
    if head is None:
        head = F.format_string('[Param "%s"(%s), Referenced at %s : %s]', "param", text.hex_address(F.col("str_addr")), "start_func", text.hex_address(F.col("ref_addr")))
    hops = F.transform(
        "path",
        lambda h, i: F.concat(
            F.lit(">> "), text.hex_address(h["addr"]),
            F.when((i + 1 < F.size("path")) & F.coalesce(F.get("path", i + 1)["digest"], F.lit(False)), F.lit(" >> ")).otherwise(F.lit(" -> ")), h["callee"],
        ),
    )
    return paths.select(F.concat(head, F.lit(" "), F.array_join(hops, " ")).alias("value"))


def new_parameters(edges: DataFrame, args: DataFrame, targets: DataFrame, least: int = params.HEURISTIC_LEAST, ignored: tuple[str, ...] = params.HEURISTIC_IGNORED) -> DataFrame:
    """(bin, func, name): constants at argument positions that take known targets ``least`` times in a function."""
    used = edges.join(args.filter("length(const_str) > 0"), ["bin", "call_addr"]).select("bin", F.col("caller").alias("func"), "callee", "pos", F.col("const_str").alias("name"))
    known = targets.select("name").distinct()
    counts = used.join(known, "name", "left_semi").groupBy("bin", "func", "callee", "pos").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    fresh = used.filter(~F.col("callee").isin(*ignored) & F.col("name").rlike("[a-zA-Z_]{4}")).join(known, "name", "left_anti")
    return fresh.join(counts, ["bin", "func", "callee", "pos"], "left_semi").select("bin", "func", "name").distinct()


def shared_settings(edges: DataFrame, args: DataFrame, references: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(paths to setters of shared data, shares(func, key)): the value must not be constant; an
    unknown key is ``*unknown*``."""
    value = {name: pos[1] for name, pos in params.SHARE_SETTERS.items()}
    key = {name: pos[0] for name, pos in params.SHARE_SETTERS.items()}
    keyed = F.create_map(*(F.lit(x) for pair in key.items() for x in pair))
    # the setter's own rule replaces that of the table of constants
    others = {k: v for k, v in params.CONSTANT_POSITION.items() if k not in value} | value
    constant = constant_calls(edges, args, others)
    kept = edges.filter(F.col("callee").isin(*params.SHARE_SINKS)).join(constant, ["bin", "call_addr"], "left_anti")
    trimmed = edges.filter(~F.col("callee").isin(*params.SHARE_SINKS)).unionByName(kept.select(*edges.columns))
    paths = sink_paths(trimmed, args, references, params.SHARE_SINKS, **options)
    last = paths.select("bin", F.element_at("path", -1)["addr"].alias("call_addr"), F.element_at("path", -1)["callee"].alias("func")).distinct()
    last = last.withColumn("pos", keyed[F.col("func")])
    named = last.join(args.filter("length(const_str) > 0"), ["bin", "call_addr", "pos"], "left")
    return paths, named.select("func", F.coalesce("const_str", F.lit("*unknown*")).alias("key")).distinct()


def share_references(edges: DataFrame, args: DataFrame, shares: DataFrame) -> DataFrame:
    """References for a search that starts where any unit's getter reads a shared key: the equi-join of
    setter and getter on (getter's name, key)."""
    at = F.create_map(*(F.lit(x) for pair in params.SHARE_GETTERS.items() for x in pair))[F.col("callee")]
    calls = edges.select("bin", "caller", "call_addr", "callee", at.alias("pos")).filter("pos IS NOT NULL")
    keyed = calls.join(args.filter("length(const_str) > 0"), ["bin", "call_addr", "pos"])
    wanted = shares.select(text.getter_of(F.col("func")).alias("callee"), F.col("key").alias("const_str")).distinct()
    hits = keyed.join(wanted, ["callee", "const_str"])
    return hits.select("bin", F.col("const_str").alias("param"), F.col("call_addr").alias("str_addr"), F.col("caller").alias("func"), F.col("call_addr").alias("ref_addr")).distinct()


def cross_unit_paths(edges: DataFrame, args: DataFrame, references: DataFrame, **options) -> DataFrame:
    """Paths from a keyword to a setter of shared data joined, over the shared keys, to paths from the
    getters of any unit to a command: one plan, no files between."""
    _, shares = shared_settings(edges, args, references, **options)
    return sink_paths(edges, args, share_references(edges, args, saved(shares)), params.SHARED_COMMAND_SINKS, **options)


def path_counts(edges: DataFrame, length: int) -> DataFrame:
    """(bin, start, end, paths): exact number of walks of ``length`` calls between functions: sparse
    matrix powers, one equi-join and sum a step.  Numbers are decimals of 38 digits; more than these is an
    error, whether or not ``spark.sql.ansi.enabled`` is set, and never a wrong number."""
    whole = lambda c: F.coalesce(c.cast("decimal(38,0)"), F.raise_error(F.lit("more walks than 38 digits hold")).cast("decimal(38,0)"))
    one = saved(edges.groupBy("bin", F.col("caller").alias("start"), F.col("callee").alias("end")).agg(F.count("*").cast("decimal(38,0)").alias("paths")))
    walks = one
    step = one.select("bin", F.col("start").alias("end"), F.col("end").alias("to"), F.col("paths").alias("times"))
    for _ in range(length - 1):
        longer = walks.join(step, ["bin", "end"]).groupBy("bin", "start", F.col("to").alias("end"))
        walks = longer.agg(whole(F.sum(whole(F.col("paths") * F.col("times")))).alias("paths"))
    return walks
