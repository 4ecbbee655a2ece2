"""Taint as rules over facts: seeds, flows, sanitizers, summaries, guards, and alerts at sinks.

This is a path-insensitive over-approximation with trace guidance: whether a path is feasible is not
checked.  Facts: ``flows(bin, src, dst)`` - data moves between variables; variables are any values
that name a place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from .common import reached


def call_flows(calls: DataFrame, args: DataFrame, summaries: DataFrame) -> DataFrame:
    """flows(bin, src, dst) of calls to summarised functions.

    ``calls``: bin, call_addr, callee; ``args``: bin, call_addr, pos, var (-1: the result);
    ``summaries``: fn, effect, src_pos, dst_pos (-1 as source: every argument after the destination).
    """
    known = calls.join(summaries.filter("effect = 'propagate'").withColumnRenamed("fn", "callee"), "callee")
    source = args.select("bin", "call_addr", F.col("pos").alias("s_pos"), F.col("var").alias("src"))
    target = args.select("bin", "call_addr", F.col("pos").alias("dst_pos"), F.col("var").alias("dst"))
    hits = known.join(source, ["bin", "call_addr"]).filter("(src_pos >= 0 AND s_pos = src_pos) OR (src_pos = -1 AND s_pos > dst_pos)")
    return hits.join(target, ["bin", "call_addr", "dst_pos"]).select("bin", "src", "dst").distinct()


def keyed_flows(calls: DataFrame, args: DataFrame, keys: DataFrame, summaries: DataFrame) -> DataFrame:
    """flows over keyed stores: what a setter stores under a key, a getter of that key returns.

    ``keys``: bin, call_addr, key - the constant key of each call."""
    named = calls.join(summaries.withColumnRenamed("fn", "callee"), "callee").join(keys, ["bin", "call_addr"])
    stored = named.filter("effect = 'keyed_set'").join(args.withColumnRenamed("pos", "src_pos"), ["bin", "call_addr", "src_pos"]).select("key", F.col("bin"), F.col("var").alias("src"))
    read = named.filter("effect = 'keyed_get'").join(args.withColumnRenamed("pos", "dst_pos"), ["bin", "call_addr", "dst_pos"]).select("key", F.col("bin"), F.col("var").alias("dst"))
    return stored.join(read, ["bin", "key"]).select("bin", "src", "dst").distinct()


def unfollowed_flows(calls: DataFrame, args: DataFrame, followed: DataFrame) -> DataFrame:
    """flows of calls that are not entered: the result depends on every argument."""
    loose = calls.join(followed, ["bin", "call_addr"], "left_anti")
    ins = loose.join(args.filter("pos >= 0"), ["bin", "call_addr"]).select("bin", "call_addr", F.col("var").alias("src"))
    return ins.join(args.filter("pos = -1").select("bin", "call_addr", F.col("var").alias("dst")), ["bin", "call_addr"]).select("bin", "src", "dst").distinct()


def sanitized(calls: DataFrame, args: DataFrame, summaries: DataFrame, seeds: DataFrame) -> DataFrame:
    """(bin, var): what conversions and one-sided comparisons bound.  A comparison of two operands
    untaints one only if the other is no seed."""
    known = calls.join(summaries.filter("effect = 'sanitize'").withColumnRenamed("fn", "callee"), "callee")
    a = args.select("bin", "call_addr", F.col("pos").alias("src_pos"), F.col("var").alias("var"))
    b = args.select("bin", "call_addr", F.col("pos").alias("dst_pos"), F.col("var").alias("other"))
    # a comparison of so many bytes bounds nothing if the input sets their number
    sizes = F.create_map(*(F.lit(x) for pair in params.SIZED_COMPARISONS.items() for x in pair))[F.col("callee")]
    lengths = args.join(seeds.select("bin", "var").distinct(), ["bin", "var"], "left_semi").select("bin", "call_addr", "pos")
    loose = known.select("bin", "call_addr", sizes.alias("pos")).join(lengths, ["bin", "call_addr", "pos"], "left_semi")
    known = known.join(loose.select("bin", "call_addr"), ["bin", "call_addr"], "left_anti")
    both = known.join(a, ["bin", "call_addr", "src_pos"]).join(b, ["bin", "call_addr", "dst_pos"])
    single = both.filter("src_pos = dst_pos").select("bin", "var")
    seed = seeds.select("bin", F.col("var").alias("seed"))
    pairs = both.filter("src_pos <> dst_pos")
    sides = pairs.select("bin", "var", "other").union(pairs.select("bin", F.col("other").alias("var"), F.col("var").alias("other")))
    tainted = sides.join(seed.withColumnRenamed("seed", "var"), ["bin", "var"], "left_semi")
    alone = tainted.join(seed.withColumnRenamed("seed", "other"), ["bin", "other"], "left_anti").select("bin", "var")
    return single.union(alone).distinct()


def bounded(guards: DataFrame, seeds: DataFrame) -> DataFrame:
    """(bin, var): variables that a comparison with an untainted side bounds; tests for zero do not.

    ``guards``: bin, op, lhs_var, rhs_var, rhs_const.
    """
    rows = guards.filter(F.col("op").isin("==", "<=", "!=", "SLE", "SGT", ">=") & F.coalesce(F.col("rhs_const") != 0, F.lit(True)))
    sides = rows.select("bin", F.col("lhs_var").alias("var"), F.col("rhs_var").alias("other")).union(
        rows.select("bin", F.col("rhs_var").alias("var"), F.col("lhs_var").alias("other"))
    ).filter("var IS NOT NULL")
    free = sides.join(seeds.select("bin", F.col("var").alias("other")), ["bin", "other"], "left_anti")
    return free.join(seeds.select("bin", "var"), ["bin", "var"], "left_semi").select("bin", "var").distinct()


def tainted(flows: DataFrame, seeds: DataFrame, clean: DataFrame | None = None, *, depth: int | None = None) -> DataFrame:
    """(bin, var, depth): variables that taint reaches; ``clean(bin, var)`` neither hold nor pass it on.

    ``depth`` bounds how many flows are followed; without it every flow is, however long the chain.
    """
    edges = flows.select("bin", "src", "dst")
    start = seeds.select("bin", F.col("var").alias("node"))
    if clean is not None:
        gone = clean.select("bin", "var").distinct()
        edges = edges.join(gone.withColumnRenamed("var", "dst"), ["bin", "dst"], "left_anti")
        start = start.join(gone.withColumnRenamed("var", "node"), ["bin", "node"], "left_anti")
    return reached(edges, start, levels=depth).select("bin", F.col("node").alias("var"), "depth")


def dependents(links: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(bin, var): what is untainted with its masters: the closure of ``links(bin, master, slave)``."""
    steps = links.select("bin", F.col("master").alias("src"), F.col("slave").alias("dst"))
    return reached(steps, cleaned.select("bin", F.col("var").alias("node"))).select("bin", F.col("node").alias("var"))


def followed_calls(calls: DataFrame, depth: int = params.CALL_DEPTH) -> DataFrame:
    """``calls`` with ``follow``: the order of the rules decides.

    Columns: never, black, external, summarised, white, depth, smart, any_taint, arg_taint.
    """
    rule = (
        F.when(F.col("never") | F.col("black") | F.col("external"), False).when(F.col("summarised"), False)
        .when(F.col("white"), True).when(F.col("depth") >= depth, False).when(~F.col("smart"), True)
        .when(~F.col("any_taint"), False).otherwise(F.col("arg_taint"))
    )
    return calls.withColumn("follow", rule)


def unguided_flows(calls: DataFrame, args: DataFrame, traces: DataFrame, uses_result: DataFrame) -> DataFrame:
    """flows of internal calls off the recorded trace, which are not entered: what goes in comes out.

    Where the caller uses the result (``uses_result``: bin, call_addr) every argument flows into it
    (pos -1); where it does not, into every argument that can be written.  ``calls``: bin, call_addr,
    block, external; ``args``: bin, call_addr, pos, var, writable; ``traces``: bin, block.
    """
    off = calls.filter("NOT external").join(traces.select("bin", "block").distinct(), ["bin", "block"], "left_anti").select("bin", "call_addr")
    used = uses_result.select("bin", "call_addr").distinct().withColumn("used", F.lit(True))
    off = off.join(used, ["bin", "call_addr"], "left").withColumn("used", F.coalesce("used", F.lit(False)))
    ins = off.join(args.filter("pos >= 0"), ["bin", "call_addr"]).select("bin", "call_addr", "used", F.col("var").alias("src"))
    outs = args.select("bin", "call_addr", F.col("var").alias("dst"), (F.col("pos") == -1).alias("used"), ((F.col("pos") == -1) | F.col("writable")).alias("open"))
    moved = ins.join(outs.filter("open").drop("open"), ["bin", "call_addr", "used"])
    return moved.filter("src <> dst").select("bin", "src", "dst").distinct()


def pointing(taints: DataFrame, points_to: DataFrame) -> DataFrame:
    """(bin, var): tainted variables and those that point to one (``points_to``: bin, var, target)."""
    known = taints.select("bin", "var").distinct()
    over = points_to.join(known.withColumnRenamed("var", "target"), ["bin", "target"], "left_semi").select("bin", "var")
    return known.union(over).distinct()


def tainted_callers(calls: DataFrame, args: DataFrame, taints: DataFrame, points_to: DataFrame | None = None) -> DataFrame:
    """(bin, func, call_addr, pos): calls that get tainted data, or a pointer to it, and where.

    ``calls``: bin, func, call_addr; taint is followed without sanitizers, to see where a key leads."""
    known = taints.select("bin", "var").distinct() if points_to is None else pointing(taints, points_to)
    passed = args.filter("pos >= 0").join(known, ["bin", "var"], "left_semi").select("bin", "call_addr", "pos")
    return calls.select("bin", "func", "call_addr").join(passed, ["bin", "call_addr"]).select("bin", "func", "call_addr", "pos").distinct()


def directives(calls: DataFrame, constants: DataFrame) -> DataFrame:
    """(bin, call_addr, n): how many arguments the known format string of a call takes.

    ``constants``: bin, call_addr, pos, const_str."""
    kinds = F.create_map(*(F.lit(x) for name, (pos, _) in params.DIRECTIVES.items() for x in (name, pos)))[F.col("callee")]
    rows = calls.select("bin", "call_addr", "callee", kinds.alias("pos")).filter("pos IS NOT NULL").join(constants.filter("const_str IS NOT NULL"), ["bin", "call_addr", "pos"])
    counts = None
    for name, (_, patterns) in params.DIRECTIVES.items():
        n = sum((F.regexp_count("const_str", F.lit(p)) for p in patterns), F.lit(0))
        counts = F.when(F.col("callee") == name, n) if counts is None else counts.when(F.col("callee") == name, n)
    return rows.select("bin", "call_addr", counts.alias("n")).distinct()


def guided(calls: DataFrame, traces: DataFrame) -> DataFrame:
    """Calls made from a block of the recorded trace (``traces``: bin, block): only these are entered."""
    return calls.join(traces.select("bin", "block").distinct(), ["bin", "block"], "left_semi")


def alerts(
    calls: DataFrame, args: DataFrame, taints: DataFrame, sinks: DataFrame, *, classes: tuple[str, ...] = ("command", "overflow"),
    allowed: DataFrame | None = None, points_to: DataFrame | None = None, formats: DataFrame | None = None,
) -> DataFrame:
    """(bin, call_addr, callee, class, pos): calls of sinks with a tainted argument in a checked position.

    ``sinks``: name, class, arg_positions (-1: every later one too); ``allowed(bin, call_addr)``
    restricts to recorded sink addresses; with ``points_to`` an argument counts whose pointee is tainted;
    ``formats(bin, call_addr, n)`` bounds the later positions to as many as the format takes.
    """
    rows = calls if allowed is None else calls.join(allowed, ["bin", "call_addr"], "left_semi")
    known = taints.select("bin", "var").distinct() if points_to is None else pointing(taints, points_to)
    table = sinks.filter(F.col("class").isin(*classes)).withColumnRenamed("name", "callee")
    hits = rows.join(table, "callee").join(args, ["bin", "call_addr"]).join(known, ["bin", "var"])
    later = F.array_contains("arg_positions", F.lit(-1)) & (F.col("pos") >= F.array_max("arg_positions"))
    exact = F.array_contains("arg_positions", F.col("pos"))
    if formats is not None:
        hits = hits.join(formats.select("bin", "call_addr", "n"), ["bin", "call_addr"], "left")
        taken = F.col("n").isNull() | ~F.array_contains("arg_positions", F.lit(-1)) | (F.col("pos") < F.array_max("arg_positions") + F.col("n"))
        later, exact = later & taken, exact & taken
    return hits.filter(exact | later).select("bin", "call_addr", "callee", "class", "pos").distinct()


def loop_alerts(jumps: DataFrame, taints: DataFrame) -> DataFrame:
    """Back-jumps inside a function whose condition compares two tainted variables.

    ``jumps``: bin, func, block, succ, lhs_var, rhs_var.
    """
    t = taints.select("bin", "var").distinct()
    back = jumps.filter("succ <= block")
    return back.join(t.withColumnRenamed("var", "lhs_var"), ["bin", "lhs_var"], "left_semi").join(t.withColumnRenamed("var", "rhs_var"), ["bin", "rhs_var"], "left_semi").select("bin", "func", "block", "succ").distinct()


def indirect_alerts(calls: DataFrame, args: DataFrame, taints: DataFrame) -> DataFrame:
    """(bin, call_addr): calls through a tainted register (``target_var``) with a tainted argument."""
    t = taints.select("bin", "var").distinct()
    through = calls.join(t.withColumnRenamed("var", "target_var"), ["bin", "target_var"], "left_semi")
    return through.join(args.join(t, ["bin", "var"], "left_semi"), ["bin", "call_addr"], "left_semi").select("bin", "call_addr").distinct()


def limited_jumps(jumps: DataFrame, most: int = params.BACK_JUMPS) -> DataFrame:
    """The first ``most`` times that a back-jump is taken under the same guards.

    ``jumps``: path, seq, guards, source, target.
    """
    ranked = jumps.selectExpr("*", "row_number() OVER (PARTITION BY path, guards, source, target ORDER BY seq) AS n")
    return ranked.filter(F.col("n") <= most).drop("n")


def surrogate_addresses(symbols: DataFrame, name: str = "symbol") -> DataFrame:
    """One address for each symbol name: the same name always gets the same one; all 64 bits of its hash
    are kept, so that names do not meet and merge their taint."""
    return symbols.withColumn("address", F.xxhash64(name))


def table_of(spark, kind: str) -> DataFrame:
    """The default sink or summary table."""
    if kind == "sinks":
        return spark.createDataFrame([(n, c, list(p)) for n, c, p in params.TAINT_SINKS], "name string, class string, arg_positions array<int>")
    return spark.createDataFrame(list(params.SUMMARIES), "fn string, effect string, src_pos int, dst_pos int")
