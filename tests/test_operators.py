"""Matching, ranking, graphs, units and taint against hand-computed cases and brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom import params
from factloom.operators import common, graph, matching, ranges, ranking, stats, taint, units
from factloom.plans import lifecycle


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect())


# --- matching --------------------------------------------------------------------------------------

def test_contains_segments_and_fallback(spark):
    strings = spark.createDataFrame([("b", "get_wan_mtu_x"), ("b", "/cfg/wan_mtu"), ("c", "/cfg/wan_mtu2"), ("c", "goform"), ("d", "/cfg/wan-x/wan_mtu")], "bin string, s string")
    names = spark.createDataFrame([("wan_mtu",)], "name string")
    got = {(r.bin, r.full_str) for r in matching.keyword_matches(strings, names).collect()}
    assert got == {("b", None), ("b", "/cfg/wan_mtu"), ("d", None)}
    apis = spark.createDataFrame([("/goform/set",), ("/cfg/wan_mtu",)], "name string")
    assert rows(matching.api_matches(strings, apis)) == [("b", "/cfg/wan_mtu", "/cfg/wan_mtu"), ("c", "/cfg/wan_mtu", "/cfg/wan_mtu"), ("c", "/goform/set", "goform"), ("d", "/cfg/wan_mtu", "cfg"), ("d", "/cfg/wan_mtu", "wan_mtu")]


def test_all_forms_of_the_containment_join_agree(spark):
    rng = random.Random(0)
    strings = [(f"b{i % 7}", "".join(rng.choices("abé ", k=rng.randrange(30)))) for i in range(120)] + [("b0", None), ("b1", "")]
    names = sorted({"".join(rng.choices("abé", k=rng.randrange(1, 5))) for _ in range(40)})
    want = sorted({(b, n) for b, s in strings if s for n in names if n in s})
    s = spark.createDataFrame(strings, "bin string, s string")
    n = spark.createDataFrame([(x,) for x in names] + [("",)], "name string")
    for method in ("loop", "explode", "scan", "auto"):
        assert rows(matching.contains_pairs(s, n, method=method)) == want
    ends = sorted({(b, x, t) for b, t in strings if t for x in names if t.endswith(x)})
    assert rows(matching.terminated(s, n)) == ends
    none = n.limit(0)
    for method in ("loop", "explode", "scan"):
        assert matching.contains_pairs(s, none, method=method).count() == 0


def test_discovery_of_units(spark):
    strings = spark.createDataFrame([("bin/a", "k1 getenv"), ("lib/b", "k1"), ("bin/c", "k1"), ("bin/d", "urn:x")], "bin string, s string")
    keys = spark.createDataFrame([("k1",)], "name string")
    assert rows(matching.by_presence(strings, keys)) == [("bin/a", "k1"), ("bin/c", "k1")]
    args = spark.createDataFrame([("bin/a", "getenv", "k1"), ("bin/c", "getenv", "k1")], "bin string, callee string, const_str string")
    assert rows(matching.by_dual(strings, args, keys, "getenv")) == [("bin/a", "k1")]
    assert rows(matching.urn_strings(strings)) == [("bin/d", "urn:x")]
    contents = spark.createDataFrame([("a", bytearray(b"..127.0.0.1..\x90\x1f")), ("b", bytearray(b"127.0.0.1\x1f\x90"))], "bin string, content binary")
    bindings = spark.createDataFrame([(8080, "127.0.0.1")], "port int, ip string")
    assert rows(matching.by_binding(contents, bindings)) == [("a", 8080, "127.0.0.1")]


# --- ranking ---------------------------------------------------------------------------------------

def test_rank_order_and_least_hits(spark):
    hits = [("A", f"k{i}") for i in range(12)] + [("B", f"k{i}") for i in range(12)] + [("C", f"k{i}") for i in range(9)]
    apis = [("B", f"f{i}") for i in range(3)] + [("C", f"f{i}") for i in range(50)]
    make = lambda x: spark.createDataFrame(x, "bin string, name string")
    strings = spark.createDataFrame([(b, "s") for b in "ABC"], "bin string, s string")
    ranked = ranking.border_rank(strings, make(hits), make(apis))
    assert [(r.bin, r.keywords_count, r.functions_count) for r in ranked.collect()] == [("B", 12, 3), ("A", 12, 0)]
    files = make([]).select(F.lit("").alias("name"), F.lit("").alias("path")).limit(0)
    more = spark.createDataFrame([("k1", "p1"), ("k1", "p2")], "name string, path string")
    detail = {r.bin: r for r in ranking.border_detail(ranked, make(hits), make(apis), more, files).collect()}
    assert detail["A"].keyword_source_files == ["p1", "p2"] and len(detail["A"].keywords) == 12 and detail["A"].functions is None


@pytest.mark.parametrize("scores,want", [
    ([9, 8, 7], [9]), ([90, 70, 50, 30, 10, 9.7, 9.3, 5], [90, 70, 50, 30, 10, 9.7, 9.3]), ([90, 70, 50, 30, 10, 5], [90, 70, 50, 30, 10]), ([1, 1, 1, 1, 1, 1], [1] * 6), ([], []),
])
def test_first_cluster(spark, scores, want):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(scores)], "bin int, score double")
    assert sorted((r.score for r in ranking.first_cluster(df).collect()), reverse=True) == want


def first_density_cluster(scores, gap=0.5, core=5):
    """By definition: scores joined by chains of core members, where a score's neighbourhood is every score
    not lower than itself less ``gap``.  Of equal neighbouring clusters from the top the first one counts;
    with no core member there is none, and the best score stands alone."""
    s = np.sort(np.array(scores))[::-1]
    near = s[:, None] - s[None, :] <= gap  # [i, j]: j is in the neighbourhood of i
    cores = near.sum(axis=1) >= core
    if not cores.any():
        return s[:1].tolist()
    member = np.zeros(len(s), dtype=bool)
    member[np.argmax(cores)] = True
    while (grown := member | (near & (member & cores)[:, None]).any(axis=0)).sum() > member.sum():
        member = grown
    out = [float(x) for x, _ in itertools.takewhile(lambda p: p[1], zip(s, member, strict=True))]
    return out or s[member].tolist()


def test_first_run_needs_no_clustering(spark):
    """The closed form, on plain lists, against the clustering it stands for."""
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.uniform(0, rng.choice([3, 20])) for _ in range(rng.randrange(1, 14))]
        s = sorted(scores, reverse=True)
        if len(s) < 5:
            want = s[:1]
        else:
            n = 5
            while n < len(s) and s[n - 1] - s[n] <= 0.5:
                n += 1
            want = s[:n]
        assert first_density_cluster(scores) == want


# --- ranges ----------------------------------------------------------------------------------------

def test_ranges_equal_brute_force(spark):
    rng = random.Random(4)
    points = [(rng.randrange(3), rng.randrange(-50, 2000)) for _ in range(150)]
    spans = [(rng.randrange(3), a := rng.randrange(0, 1900), a + rng.randrange(0, 300)) for _ in range(40)]
    p = spark.createDataFrame(points, "bin int, at long")
    s = spark.createDataFrame(spans, "bin int, entry long, end_addr long")
    got = ranges.within(p, s, at=F.col("at"), low=F.col("entry"), high=F.col("end_addr"), width=64, by=["bin"])
    assert rows(got, "bin", "at", "entry") == sorted((b, x, lo) for b, x in points for c, lo, hi in spans if b == c and lo <= x <= hi)
    marks = sorted({(b, lo): hi for b, lo, hi in spans}.items())
    base = spark.createDataFrame([(b, lo, hi) for (b, lo), hi in marks], "bin int, base long, size long")
    near = ranges.latest_before(p, base, at="at", base="base", value="size", by=["bin"])
    best = lambda b, x: max(((lo, hi) for (c, lo), hi in marks if c == b and lo <= x), default=(None, None))
    assert sorted(map(tuple, near.collect()), key=str) == sorted(((b, x, *best(b, x)) for b, x in points), key=str)


def test_references_take_one_pointer_hop(spark):
    refs = spark.createDataFrame([("b", 900, 15), ("b", 800, 500), ("b", 500, 25), ("b", 700, 600)], "bin string, to_addr long, from_addr long")
    funcs = spark.createDataFrame([("b", "f", 10, 19, 0), ("b", "g", 20, 29, 0)], "bin string, func string, entry long, end_addr long, param_count int")
    got = rows(ranges.referring_functions(refs, funcs), "to_addr", "ref_addr", "func", "ref_kind")
    assert got == [(500, 25, "g", "direct"), (800, 25, "g", "pointer"), (900, 15, "f", "direct")]


# --- call graphs -----------------------------------------------------------------------------------

EDGES = [("b", "f0", 0x08, "log"), ("b", "f0", 0x18, "g"), ("b", "g", 0x3C, "strcpy"), ("b", "g", 0x40, "system")]
REFS = [("b", "wan_mtu", 0x900, "f0", 0x10)]


def search(spark, args, sinks=params.COMMAND_SINKS, edges=EDGES, refs=REFS):
    e = spark.createDataFrame(edges, "bin string, caller string, call_addr long, callee string")
    a = spark.createDataFrame(args, "bin string, call_addr long, pos int, const_str string")
    r = spark.createDataFrame(refs, "bin string, param string, str_addr long, func string, ref_addr long")
    return graph.sink_paths(e, a, r, sinks)


@pytest.mark.parametrize("args,line", [
    ([], ['[Param "wan_mtu"(0x900), Referenced at f0 : 0x10] >> 0x18 >> g >> 0x40 -> system']),
    ([("b", 0x3C, 1, "x")], ['[Param "wan_mtu"(0x900), Referenced at f0 : 0x10] >> 0x18 -> g >> 0x40 -> system']),
    ([("b", 0x40, 0, "reboot")], []),
    ([("b", 0x40, 0, "")], ['[Param "wan_mtu"(0x900), Referenced at f0 : 0x10] >> 0x18 >> g >> 0x40 -> system']),
])
def test_paths_digests_and_constants(spark, args, line):
    assert [r.value for r in graph.formatted(search(spark, args)).collect()] == line


def test_safe_formats(spark):
    edges = [("b", "f", 1, "doSystemCmd"), ("b", "f", 2, "doSystemCmd"), ("b", "f", 3, "doSystemCmd"), ("b", "f", 4, "doSystemCmd"), ("b", "f", 5, "doSystemCmd")]
    args = [("b", 1, 0, "rm %s %d"), ("b", 1, 1, "x"), ("b", 2, 0, "rm %s"), ("b", 3, 0, "plain %%s"), ("b", 4, 0, "%d%d%d%s"), ("b", 4, 4, "x")]
    e = spark.createDataFrame(edges, "bin string, caller string, call_addr long, callee string")
    a = spark.createDataFrame(args, "bin string, call_addr long, pos int, const_str string")
    assert rows(graph.safe_formats(e, a), "call_addr") == [(1,), (3,)]


def depth_first(edges, refs, sinks):
    """All simple paths by depth-first search without memo."""
    calls = {}
    for _, caller, addr, callee in edges:
        calls.setdefault(caller, []).append((addr, callee))
    out = []

    def go(start, func, path, least):
        if func in sinks and path:
            out.append((start, tuple(path)))
            return
        for addr, callee in sorted(calls.get(func, [])):
            if addr >= least and callee != start and callee not in [c for _, c in path]:
                go(start, callee, [*path, (addr, callee)], 0)

    for _, _, _, func, at in refs:
        go(func, func, [], at)
    return sorted(out)


def test_paths_equal_depth_first_search(spark):
    rng = random.Random(11)
    names = [f"f{i}" for i in range(9)] + ["system", "popen"]
    edges = [("b", rng.choice(names[:9]), a, rng.choice(names)) for a in range(1, 30)]
    refs = [("b", "p", 1, f"f{i}", rng.randrange(10)) for i in range(4)]
    got = search(spark, [], edges=edges, refs=refs).collect()
    assert sorted((r.start_func, tuple((h.addr, h.callee) for h in r.path)) for r in got) == depth_first(edges, refs, {"system", "popen"})


def test_new_parameters(spark):
    def run(known):
        e = spark.createDataFrame([("b", "f", i, "getp") for i in range(known + 1)], "bin string, caller string, call_addr long, callee string")
        a = spark.createDataFrame([("b", i, 1, f"known{i}") for i in range(known)] + [("b", known, 1, "lan_gate")], "bin string, call_addr long, pos int, const_str string")
        t = spark.createDataFrame([(f"known{i}",) for i in range(known)], "name string")
        return rows(graph.new_parameters(e, a, t))

    assert run(4) == [("b", "f", "lan_gate")] and run(3) == []


def test_shared_data_across_units(spark):
    edges = [("a", "f", 0x20, "nvram_safe_set"), ("a", "f", 0x24, "setenv"), ("c", "main", 0x30, "nvram_safe_get"), ("c", "main", 0x34, "run"), ("c", "run", 0x40, "system"), ("c", "other", 0x50, "nvram_safe_get")]
    args = [("a", 0x20, 0, "lan_ip"), ("a", 0x24, 1, "fixed"), ("c", 0x30, 0, "lan_ip"), ("c", 0x50, 0, "elsewhere")]
    e = spark.createDataFrame(edges, "bin string, caller string, call_addr long, callee string")
    a = spark.createDataFrame(args, "bin string, call_addr long, pos int, const_str string")
    r = spark.createDataFrame([("a", "wan_mtu", 1, "f", 0x10)], "bin string, param string, str_addr long, func string, ref_addr long")
    paths, shares = graph.shared_settings(e, a, r)
    assert paths.count() == 1 and rows(shares) == [("nvram_safe_set", "lan_ip")]
    got = graph.cross_unit_paths(e, a, r).collect()
    assert [(p.bin, p.param, [h.callee for h in p.path]) for p in got] == [("c", "lan_ip", ["run", "system"])]


def test_heuristic_round_of_the_plan(spark):
    edges = [("b", "f", i, "getp") for i in range(5)] + [("b", "f", 50, "system")]
    args = [("b", i, 0, f"known{i}") for i in range(4)] + [("b", 4, 0, "lan_gate")]
    refs = [("b", "known0", 1, "f", 0), ("b", "lan_gate", 2, "f", 4), ("b", "unused", 3, "f", 4)]
    e = spark.createDataFrame(edges, "bin string, caller string, call_addr long, callee string")
    a = spark.createDataFrame(args, "bin string, call_addr long, pos int, const_str string")
    r = spark.createDataFrame(refs, "bin string, param string, str_addr long, func string, ref_addr long")
    n = spark.createDataFrame([(f"known{i}",) for i in range(4)], "name string")
    f = spark.createDataFrame([("b", "f", 0, 99, 0)], "bin string, func string, entry long, end_addr long, param_count int")
    assert {p.param for p in lifecycle.keyword_paths(e, a, r, n, f).collect()} == {"known0", "lan_gate"}
    calls = e.select("bin", "call_addr", "callee")
    places = spark.createDataFrame([("b", 50, 0, "cmd"), ("b", 50, -1, "rc")], "bin string, call_addr long, pos int, var string")
    flows = spark.createDataFrame([("b", "in", "cmd")], "bin string, src string, dst string")
    seeds = spark.createDataFrame([("b", "in")], "bin string, var string")
    found = lifecycle.confirmed(search(spark, [], edges=edges, refs=[("b", "known0", 1, "f", 0)]), calls, places, flows, seeds)
    assert rows(found, "call_addr", "callee", "pos") == [(50, "system", 0)]
    checked = calls.union(spark.createDataFrame([("b", 60, "atoi")], calls.schema))
    bound = places.union(spark.createDataFrame([("b", 60, 0, "in")], places.schema))
    paths = search(spark, [], edges=edges, refs=[("b", "known0", 1, "f", 0)])
    assert lifecycle.confirmed(paths, checked, bound, flows, seeds).count() == 0  # the input was converted to a number


# --- units -----------------------------------------------------------------------------------------

def test_unit_graph(spark):
    make = lambda x: spark.createDataFrame(x, "unit string, key string")
    setters, getters = make([("A", "k1"), ("A", "k2")]), make([("B", "k1"), ("C", "k9")])
    assert rows(units.key_edges(setters, getters)) == [("A", "B", 1)]
    got = {r.unit: r for r in units.key_roles(setters, getters).collect()}
    assert got["A"].is_root and not got["A"].is_leaf and got["A"].role == "SETTER"
    assert got["C"].is_orphan and got["B"].is_leaf and got["C"].is_leaf and not got["B"].is_orphan
    assert rows(units.schedule(units.key_edges(setters, getters), make([("A", "")]))) == [("A", 0), ("B", 1)]
    assert rows(units.child_keys(make([("B", "k1"), ("B", "k3")]), setters, units.key_edges(setters, getters))) == [("B", "k1")]
    assert rows(units.generated_edges(make([("A", "wan_")]), make([("B", "wan_mtu"), ("A", "wan_x"), ("B", "lan-1")]))) == [("B", "A")]
    assert rows(units.discovered_roles(make([("", "k1")]), make([("A", "k1"), ("A", "k2"), ("B", "k2"), ("B", "k3"), ("C", "k4")]))) == [("A", "k1"), ("A", "k2"), ("B", "k2"), ("B", "k3")]


def test_channels_and_callers(spark):
    calls = spark.createDataFrame([("b", "f", "setenv", "k", True), ("b", "f", "websSetVar", "k", True), ("b", "g", "recv_all", "k", True), ("b", "h", "sendto", "k", False), ("b", "i", "apGetVar", "k", True)], "bin string, func string, callee string, key string, tainted boolean")
    assert rows(units.channel_roles(calls), "func", "channel", "role") == [("f", "environment", "SETTER"), ("g", "socket", "GETTER"), ("i", "setter_getter", "GETTER")]
    uses = spark.createDataFrame([("b", "f", "index_load", False, 1), ("b", "g", "compare", True, 3), ("b", "h", "compare", False, 3), ("b", "i", "compare", True, 2)], "bin string, func string, kind string, in_loop boolean, arity int")
    assert rows(units.semantic_roles(uses), "func", "role") == [("f", "GETTER"), ("g", "SETTER"), ("i", "GETTER")]
    edges = spark.createDataFrame([("b", "x", 1, "getcfg"), ("b", "y", 2, "getcfg")], "bin string, caller string, call_addr long, callee string")
    args = spark.createDataFrame([("b", 1, 0, "wan:%d"), ("b", 2, 1, "no")], "bin string, call_addr long, pos int, const_str string")
    roles = spark.createDataFrame([("b", "getcfg", 0)], "bin string, func string, pos int")
    assert rows(units.caller_keys(roles, edges, args)) == [("b", "wan")]
    stat = spark.createDataFrame([("my_memcmp", 9, False, False, 99), ("loopy", 2, True, True, 8), ("big", 2, True, True, 9)], "func string, arity int, loop_compare boolean, loop_increment boolean, n_blocks int")
    assert rows(units.parser_like(stat), "func") == [("loopy",), ("my_memcmp",)]
    graph_edges = spark.createDataFrame([("b", "top", 1, "reader"), ("b", "reader", 2, "recv"), ("b", "top", 3, "checker"), ("b", "checker", 4, "strcmp")], "bin string, caller string, call_addr long, callee string")
    assert rows(units.connection_marks(graph_edges)) == [("b", "top")]
    merged = stats.merged_roles(spark.createDataFrame([("a", "SETTER"), ("b", "UNKNOWN")], "bin string, role string"), spark.createDataFrame([("a", "SETTER")], "bin string, role string"))
    assert rows(merged) == [("a", "SETTER")]


# --- taint -----------------------------------------------------------------------------------------

def test_summaries_and_alerts(spark):
    calls = spark.createDataFrame([("b", 1, "sprintf"), ("b", 2, "system"), ("b", 3, "atoi"), ("b", 4, "strcpy"), ("b", 5, "sprintf"), ("b", 6, "memcpy")], "bin string, call_addr long, callee string")
    args = spark.createDataFrame([
        ("b", 1, 0, "d"), ("b", 1, 1, "fmt"), ("b", 1, 2, "x"), ("b", 1, 3, "y"), ("b", 2, 0, "d"), ("b", 3, 0, "n"), ("b", 4, 0, "o"), ("b", 4, 1, "n"),
        ("b", 5, 0, "e"), ("b", 5, 2, "x"), ("b", 5, 3, "d"), ("b", 6, 0, "m"), ("b", 6, 1, "y"), ("b", 6, 2, "len"),
    ], "bin string, call_addr long, pos int, var string")
    summaries, sinks = taint.table_of(spark, "summaries"), taint.table_of(spark, "sinks")
    seeds = spark.createDataFrame([("b", "y"), ("b", "n")], "bin string, var string")
    flows = taint.call_flows(calls, args, summaries)
    clean = taint.sanitized(calls, args, summaries, seeds)
    assert rows(clean) == [("b", "n")]
    reached = taint.tainted(flows, seeds, clean)
    assert {r.var for r in reached.collect()} == {"y", "d", "m", "e"}
    got = rows(taint.alerts(calls, args, reached, sinks), "call_addr", "class", "pos")
    assert got == [(1, "overflow", 3), (2, "command", 0), (5, "overflow", 3)]
    assert rows(taint.alerts(calls, args, reached, sinks, classes=("command",)), "call_addr") == [(2,)]
    only = spark.createDataFrame([("b", 1)], "bin string, call_addr long")
    assert rows(taint.alerts(calls, args, reached, sinks, allowed=only), "call_addr") == [(1,)]


def test_comparisons_untaint_one_side(spark):
    calls = spark.createDataFrame([("b", 1, "strcmp"), ("b", 2, "strcmp")], "bin string, call_addr long, callee string")
    args = spark.createDataFrame([("b", 1, 0, "t"), ("b", 1, 1, "c"), ("b", 2, 0, "u"), ("b", 2, 1, "v")], "bin string, call_addr long, pos int, var string")
    seeds = spark.createDataFrame([("b", "t"), ("b", "u"), ("b", "v")], "bin string, var string")
    assert rows(taint.sanitized(calls, args, taint.table_of(spark, "summaries"), seeds)) == [("b", "t")]
    guards = spark.createDataFrame([("b", "<=", "t", "c", None), ("b", "==", "u", None, 0), ("b", "<=", "u", "v", None), ("b", "xor", "v", "c", None)], "bin string, op string, lhs_var string, rhs_var string, rhs_const long")
    assert rows(taint.bounded(guards, seeds)) == [("b", "t")]


def test_fixpoints_equal_brute_force(spark):
    rng = random.Random(2)
    flows = [("b", rng.randrange(40), rng.randrange(40)) for _ in range(60)]
    clean = {5, 9}
    reached, front = {0}, {0}
    while front:
        front = {d for _, s, d in flows if s in front and d not in clean} - reached
        reached |= front
    f = spark.createDataFrame(flows, "bin string, src int, dst int")
    seeds = spark.createDataFrame([("b", 0)], "bin string, var int")
    gone = spark.createDataFrame([("b", x) for x in clean], "bin string, var int")
    assert {r.var for r in taint.tainted(f, seeds, gone).collect()} == reached
    assert {r.var for r in taint.tainted(f, seeds, gone, depth=1).collect()} == {0} | {d for _, s, d in flows if s == 0 and d not in clean}


def test_keyed_stores_calls_and_loops(spark):
    calls = spark.createDataFrame([("b", 1, "setenv"), ("b", 2, "getenv"), ("b", 3, "mystery")], "bin string, call_addr long, callee string")
    args = spark.createDataFrame([("b", 1, 1, "in"), ("b", 2, -1, "out"), ("b", 3, 0, "out"), ("b", 3, -1, "r")], "bin string, call_addr long, pos int, var string")
    keys = spark.createDataFrame([("b", 1, "k"), ("b", 2, "k")], "bin string, call_addr long, key string")
    assert rows(taint.keyed_flows(calls, args, keys, taint.table_of(spark, "summaries"))) == [("b", "in", "out")]
    followed = calls.filter("callee <> 'mystery'").select("bin", "call_addr")
    assert rows(taint.unfollowed_flows(calls, args, followed)) == [("b", "out", "r")]
    links = spark.createDataFrame([("b", "a", "c"), ("b", "c", "d")], "bin string, master string, slave string")
    assert {r.var for r in taint.dependents(links, spark.createDataFrame([("b", "a")], "bin string, var string")).collect()} == {"a", "c", "d"}
    jumps = spark.createDataFrame([("b", "f", 9, 3, "x", "y"), ("b", "f", 9, 12, "x", "y"), ("b", "f", 9, 3, "x", "z")], "bin string, func string, block long, succ long, lhs_var string, rhs_var string")
    t = spark.createDataFrame([("b", "x"), ("b", "y")], "bin string, var string")
    assert rows(taint.loop_alerts(jumps, t)) == [("b", "f", 9, 3)]
    through = spark.createDataFrame([("b", 7, "x"), ("b", 8, "q")], "bin string, call_addr long, target_var string")
    used = spark.createDataFrame([("b", 7, 0, "y"), ("b", 8, 0, "y")], "bin string, call_addr long, pos int, var string")
    assert rows(taint.indirect_alerts(through, used, t)) == [("b", 7)]
    flags = "never black external summarised white".split()
    table = [(i, *[i == k for k in range(5)], 5 if i == 5 else 0, i != 6, i != 7, i == 8) for i in range(10)]
    calls = spark.createDataFrame(table, "i int, " + ", ".join(f"{x} boolean" for x in flags) + ", depth int, smart boolean, any_taint boolean, arg_taint boolean")
    assert [r.follow for r in taint.followed_calls(calls).orderBy("i").collect()] == [False, False, False, False, True, False, True, False, True, False]
    guided = taint.guided(spark.createDataFrame([("b", 1), ("b", 2)], "bin string, block long"), spark.createDataFrame([("b", 2)], "bin string, block long"))
    assert rows(guided) == [("b", 2)]
    symbols = spark.createDataFrame([("s",), ("s",), ("t",)], "symbol string")
    assert len({r.address for r in taint.surrogate_addresses(symbols).collect()}) == 2


# --- depth -----------------------------------------------------------------------------------------

def test_searches_have_no_depth_limit(spark, monkeypatch):
    n = 200
    chain = [("b", f"f{i}", i, f"f{i + 1}") for i in range(n)]
    e = spark.createDataFrame(chain, "bin string, caller string, call_addr long, callee string")
    start = spark.createDataFrame([("b", "f0")], "bin string, func string")
    assert graph.reachable(e, start).count() == n + 1
    assert graph.reachable(e, spark.createDataFrame([("b", f"f{n}")], start.schema), backward=True).count() == n + 1
    flows = e.select("bin", F.col("caller").alias("src"), F.col("callee").alias("dst"))
    reach = taint.tainted(flows, start.withColumnRenamed("func", "var"))
    assert reach.count() == n + 1 and reach.agg(F.max("depth")).first()[0] == n
    links = flows.withColumnsRenamed({"src": "master", "dst": "slave"})
    assert taint.dependents(links, start.withColumnRenamed("func", "var")).count() == n + 1
    pairs = e.select(F.col("caller").alias("setter"), F.col("callee").alias("getter"))
    assert units.schedule(pairs, spark.createDataFrame([("f0",)], "unit string")).agg(F.max("depth")).first()[0] == n
    uses = spark.createDataFrame([(f"u{i}", f"k{j}") for i in range(n) for j in (i, i + 1)], "unit string, key string")
    assert units.discovered_roles(spark.createDataFrame([("k0",)], "key string"), uses).count() == 2 * n


def test_large_groups_go_in_rounds_with_the_same_result(spark):
    rng = random.Random(8)
    edges = [(b, rng.randrange(30), rng.randrange(30)) for b in range(4) for _ in range(8 + 10 * b)]
    e = spark.createDataFrame([*edges, (0, None, 1), (None, 1, 2)], "bin int, src int, dst int")
    s = spark.createDataFrame([(b, 0) for b in range(5)] + [(None, 1), (1, None)], "bin int, node int")
    want = rows(common.reached(e, s))
    assert want == rows(common.reached(e, s, group_edges=12)) == rows(common.reached(e, s, group_edges=1))
    assert [r for r in want if r[0] == 4] == [(4, 0, 0)]
    assert rows(common.reached(e, s, levels=1)) == [r for r in want if r[2] <= 1] == rows(common.reached(e, s, levels=1, group_edges=1))
    assert common.reached(e.limit(0), s).count() == 5 and common.reached(e, s.limit(0)).count() == 0


def test_long_paths_are_found(spark):
    edges = [("b", f"f{i}", 10 * i, f"f{i + 1}") for i in range(40)] + [("b", "f40", 400, "system"), ("b", "f3", 31, "f7")]
    found = search(spark, [], edges=edges, refs=[("b", "wan_mtu", 1, "f0", 0)])
    assert sorted(len(r.path) for r in found.collect()) == [38, 41]
    e = spark.createDataFrame(edges, "bin string, caller string, call_addr long, callee string")
    none = spark.createDataFrame([], "bin string, call_addr long, pos int, const_str string")
    refs = spark.createDataFrame([("b", "wan_mtu", 1, "f0", 0), ("b", "late", 1, "f0", 5), ("b", "end", 2, "f40", 0)], "bin string, param string, str_addr long, func string, ref_addr long")
    assert rows(graph.sink_reachable(e, none, refs), "param") == [("end",), ("wan_mtu",)]


# --- trace, pointers, formats ----------------------------------------------------------------------

def test_calls_off_the_trace(spark):
    calls = spark.createDataFrame([("b", 1, 100, False), ("b", 2, 200, False), ("b", 3, 300, False), ("b", 4, 100, True)], "bin string, call_addr long, block long, external boolean")
    args = spark.createDataFrame([
        ("b", 1, 0, "in", True), ("b", 1, 1, "out", True), ("b", 1, -1, "r1", None), ("b", 2, 0, "in", True), ("b", 2, -1, "r2", None),
        ("b", 3, 0, "in", True), ("b", 3, 1, "buf", True), ("b", 3, 2, "ro", False), ("b", 3, -1, "r3", None), ("b", 4, 0, "in", True), ("b", 4, -1, "r4", None),
    ], "bin string, call_addr long, pos int, var string, writable boolean")
    traces = spark.createDataFrame([("b", 200)], "bin string, block long")
    used = spark.createDataFrame([("b", 1), ("b", 2)], "bin string, call_addr long")
    got = rows(taint.unguided_flows(calls, args, traces, used))
    assert got == [("b", "buf", "in"), ("b", "in", "buf"), ("b", "in", "r1"), ("b", "out", "r1"), ("b", "ro", "buf"), ("b", "ro", "in")]


def test_pointers_formats_and_callers(spark):
    calls = spark.createDataFrame([("b", "f", 1, "system"), ("b", "f", 2, "sprintf"), ("b", "f", 3, "sprintf"), ("b", "g", 4, "fwrite"), ("b", "g", 5, "doSystemCmd")], "bin string, func string, call_addr long, callee string")
    args = spark.createDataFrame([("b", 1, 0, "p"), ("b", 2, 3, "t"), ("b", 3, 3, "t"), ("b", 4, 0, "t"), ("b", 5, 1, "q"), ("b", 5, 2, "t")], "bin string, call_addr long, pos int, var string")
    consts = spark.createDataFrame([("b", 2, 1, "%s"), ("b", 5, 0, "a %s %%")], "bin string, call_addr long, pos int, const_str string")
    taints = spark.createDataFrame([("b", "t")], "bin string, var string")
    points = spark.createDataFrame([("b", "p", "t"), ("b", "q", "x")], "bin string, var string, target string")
    sinks = taint.table_of(spark, "sinks")
    classes = ("command", "overflow", "write")
    assert rows(taint.alerts(calls, args, taints, sinks, classes=classes), "call_addr", "pos") == [(2, 3), (3, 3), (4, 0), (5, 2)]
    formats = taint.directives(calls, consts)
    assert rows(formats, "call_addr", "n") == [(2, 1), (5, 3)]
    exact = taint.alerts(calls, args, taints, sinks, classes=classes, points_to=points, formats=formats)
    assert rows(exact, "call_addr", "pos") == [(1, 0), (3, 3), (4, 0), (5, 2)]
    assert rows(taint.tainted_callers(calls, args, taints, points), "func", "call_addr", "pos") == [("f", 1, 0), ("f", 2, 3), ("f", 3, 3), ("g", 4, 0), ("g", 5, 2)]
    sized = spark.createDataFrame([("b", 7, "strncmp"), ("b", 8, "strncmp")], "bin string, call_addr long, callee string")
    places = spark.createDataFrame([("b", 7, 0, "t"), ("b", 7, 1, "c"), ("b", 7, 2, "n"), ("b", 8, 0, "u"), ("b", 8, 1, "c"), ("b", 8, 2, "t")], "bin string, call_addr long, pos int, var string")
    seeds = spark.createDataFrame([("b", "t"), ("b", "u")], "bin string, var string")
    assert rows(taint.sanitized(sized, places, taint.table_of(spark, "summaries"), seeds)) == [("b", "t")]


def test_numbering_in_ranges(spark):
    names = [(f"n{i % 37:02d}{i}",) for i in range(200)]
    got = common.numbered(spark.createDataFrame(names, "name string").repartition(7), ["name"])
    assert sorted((r.number, r.name) for r in got.collect()) == list(enumerate(sorted(n for n, in names), 1))
    assert common.numbered(spark.createDataFrame([], "name string"), ["name"]).count() == 0


def test_path_counts_beyond_a_long(spark):
    calls = spark.range(3000).select(F.lit(0).alias("bin"), F.lit("f").alias("caller"), F.lit("f").alias("callee"))
    assert graph.path_counts(calls, 6).first()["paths"] == 3000**6
    with pytest.raises(Exception, match="38 digits|OVERFLOW|OUT_OF_RANGE"):
        graph.path_counts(calls, 12).collect()


def _pairs_of_units(spark):
    rng = random.Random(11)
    make = lambda n, keys: spark.createDataFrame([(rng.randrange(30), rng.choice(keys)) for _ in range(n)] + [(None, keys[0]), (1, None)], "unit long, key string")
    return make


def _unshuffled(df):
    """Whether no exchange or aggregate stands above the last join of the plan, where pairs of units are."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan.split("Join")[0] for x in ("Exchange", "Aggregate"))


def test_generated_edges_are_made_once_each(spark):
    make = _pairs_of_units(spark)
    made, used = make(60, ["a_", "b-", "c_", "d_"]), make(90, ["a_x", "a_y", "b-1", "c_", "d", "e_1"])
    got = units.generated_edges(made, used)
    g, k = {tuple(r) for r in made.collect()}, {tuple(r) for r in used.collect()}
    prefix = lambda key: key[:2] if key and key[1:2] in ("_", "-") and key[:1] else None
    want = {(u, m) for u, key in k for m, p in g if None not in (u, m, p) and prefix(key) == p and u != m}
    assert rows(got) == sorted(want)
    assert _unshuffled(got)


def test_child_keys_of_lower_units(spark):
    make = _pairs_of_units(spark)
    child, parents = make(40, ["k1", "k2", "k3"]), make(20, ["k1", "k2", "k4"])
    lower = units.key_edges(parents, child).filter("setter < getter").select("setter", "getter")
    got = units.child_keys(child, parents)
    assert rows(got) == rows(units.child_keys(child, parents, lower))
    assert "least" in got._jdf.queryExecution().analyzed().toString()


def test_large_groups_fall_into_pieces(spark, monkeypatch):
    rng = random.Random(12)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)]
    e = spark.createDataFrame(pairs, "a long, b long")
    root = {r.node: r.root for r in common.connected(e, part_rows=20).collect()}
    least = {n: n for p in pairs for n in p}
    while any(least[a] != least[b] for a, b in pairs):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    alone = {n for n in least if all(a == b for a, b in pairs if n in (a, b))}
    assert root == {n: r for n, r in least.items() if n not in alone}
    monkeypatch.setattr(common, "closure", lambda *a, **k: pytest.fail("searched in rounds"))
    chains = [(0, 100 * c + i, 100 * c + i + 1) for c in range(20) for i in range(40)] + [(1, 0, 1)]
    e = spark.createDataFrame(chains, "bin int, src int, dst int")
    s = spark.createDataFrame([(0, 100 * c) for c in range(20)] + [(0, -5), (1, 0)], "bin int, node int")
    got = rows(common.reached(e, s, group_edges=100))
    assert got == sorted([(0, 100 * c + i, i) for c in range(20) for i in range(41)] + [(0, -5, 0), (1, 0, 0), (1, 1, 1)])
