"""Smaller fact rules."""

from factloom.operators import facts, stats


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect())


def test_references_and_symbols(spark):
    strings = spark.createDataFrame([("b", 900, "http_host"), ("b", 910, "other")], "bin string, str_addr long, s string")
    ref = lambda x: spark.createDataFrame(x, "bin string, str_addr long, ref_addr long")
    got = facts.key_references(strings, ref([("b", 900, 1)]), ref([("b", 900, 2)]), ref([("b", 910, 3), ("b", 1, 4)]))
    assert rows(got, "ref_addr", "ref_kind") == [(1, "direct"), (2, "offset"), (3, "pointer")]
    names = spark.createDataFrame([("other",)], "name string")
    at = spark.createDataFrame([("b", 5, "other"), ("b", 9, "others")], "bin string, off long, s string")
    assert rows(facts.string_addresses(at, names, 100)) == [("b", "other", 105)]
    refs = spark.createDataFrame([("b", 900, 25), ("b", 900, 12)], "bin string, to_addr long, from_addr long")
    funcs = spark.createDataFrame([("b", "f", 10, 19, 0), ("b", "g", 20, 29, 0)], "bin string, func string, entry long, end_addr long, param_count int")
    assert rows(facts.similar_references(strings, ("http_",), refs, funcs)) == [("b", "http_", "f")]
    calls = spark.createDataFrame([("b", 1), ("b", 2), ("b", 3)], "bin string, target long")
    table = lambda x: spark.createDataFrame(x, "bin string, addr long, name string")
    got = facts.resolved_symbols(calls, table([("b", 1, "plt")]), table([("b", 1, "sym"), ("b", 2, "two")]))
    assert [(r.target, r.name) for r in got.orderBy("target").collect()] == [(1, "plt"), (2, "two"), (3, None)]


def test_roles_and_entries(spark):
    uses = spark.createDataFrame([("b", 1, 0, "load", "x"), ("b", 1, 1, "add", "t"), ("b", 1, 2, "store", "y"), ("b", 2, 3, "load", "y")], "bin string, block long, idx int, op string, var string")
    assert rows(facts.index_uses(uses, spark.createDataFrame([("b", "t")], "bin string, var string")), "idx") == [(2,)]
    history = spark.createDataFrame([(1, 1, "a", True), (1, 2, "b", True), (1, 3, "c", False)], "path int, seq int, func string, tainted boolean")
    assert rows(facts.wrappers(history)) == [(1, "b")]
    funcs = spark.createDataFrame([("b", "f", 10), ("b", "g", 20), ("b", "h", 30)], "bin string, func string, entry long")
    before = spark.createDataFrame([("b", "f", 10), ("b", "g", 20), ("b", "g", 99)], "bin string, func string, block_end long")
    assert rows(facts.real_starts(funcs, before), "func") == [("g",), ("h",)]
    edges = spark.createDataFrame([("b", "a", "net"), ("b", "net", "recv"), ("b", "c", "d")], "bin string, caller string, callee string")
    assert rows(facts.two_hops(edges, ("recv",))) == [("b", "a", "net")]
    seeds = spark.createDataFrame([("x", "own")], "bin string, s string")
    strings = spark.createDataFrame([("x", "http_a"), ("y", "http_b"), ("y", "no")], "bin string, s string")
    assert rows(facts.seeds_or_http(seeds, strings)) == [("x", "own"), ("y", "http_b")]
    cases = spark.createDataFrame([("b", 15)], "bin string, ref_addr long")
    blocks = spark.createDataFrame([("b", 10, 19), ("b", 20, 29)], "bin string, block long, block_end long")
    assert rows(facts.entry_blocks(cases, blocks)) == [("b", 15, 10)]


def test_presence_and_allocations(spark):
    strings = spark.createDataFrame([("a", "lan_ip"), ("a", "xwan"), ("b", "wan"), ("c", "zzz")], "bin string, s string")
    names = spark.createDataFrame([("wan",), ("lan_ip",)], "name string")
    assert [(r.bin, r.keywords_count) for r in facts.presence_rank(strings, names).collect()] == [("a", 2), ("b", 1)]
    present = facts.exact_presence(strings, names)
    assert rows(present) == [("a", "lan_ip"), ("b", "wan")]
    assert rows(facts.not_in_unit(present, "a")) == [("wan",)]
    calls = spark.createDataFrame([("b", 1, 7, 64)], "bin string, path int, call_addr long, size long")
    back = spark.createDataFrame([("b", 1, 7, 4096)], "bin string, path int, call_addr long, base long")
    assert rows(facts.allocations(calls, back)) == [("b", 4096, 64)]
    big = spark.createDataFrame([(1, 2**16), (2, 10), (3, 2**32 - 1)], "i int, size long")
    assert rows(stats.suspicious_sizes(big, "size"), "i") == [(1,)]
    lines = spark.createDataFrame([('[Param "a"(0x1), Referenced at f : 0x2] >> 0x3 -> system',), ('[Param "b"(0x1), Referenced at f : 0x2] >> 0x3 -> system',)], "value string")
    assert rows(stats.line_counters(lines)) == [(1, 2)]
    found = spark.createDataFrame([("b", "sink", 1), ("b", "sink", 1), ("b", "loop", 2)], "bin string, kind string, at int")
    assert rows(stats.alert_counts(found, owner="bin", kind="kind", key=["at"])) == [("b", "loop", 1), ("b", "sink", 1)]
