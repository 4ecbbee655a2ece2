"""Files, strings, pages, scripts, XML, device descriptions, text interchange."""

import pytest

from factloom import fact_queries, schemas
from factloom.operators import keywords
from factloom.plans import lifecycle
from factloom.sources import binstrings, devices, files, reports, web


def test_schemas_parse(spark):
    assert all(schemas.schema(name).fieldNames() for name in schemas._DDL)


def test_tree_to_border_binaries(spark, tmp_path):
    root = tmp_path / "fs"
    (root / "www").mkdir(parents=True)
    (root / "bin").mkdir()
    names = [f"field_{c}" for c in "abcdefghijkl"]
    inputs = "".join(f'<input name="{n}">' for n in names)
    (root / "www/a.HTML").write_bytes(f'<form action="/goform/set">{inputs}<script src="x/app.js?v=1"></script></form>'.encode() + b"\xff")
    (root / "www/app.js").write_text('var a = "js_literal_name"; api.sendSOAPAction("SetThing", b, c); x("/cgi/call")')
    (root / "www/jquery.js").write_text('"never_read_name"')
    (root / "www/hnap.xml").write_text("<e:Env xmlns:e='u'><e:Body><SetWan><WanName><Deep/></WanName></SetWan></e:Body></e:Env>")
    elf = b"\x7fELF\x01\x01" + b"\0".join(n.encode() for n in names) + b"\0/goform/set\0js_literal_name\0"
    (root / "bin/httpd").write_bytes(elf)
    (root / "bin/ls").write_bytes(elf)
    (root / "bin/lib.so").write_bytes(elf)
    (root / "bin/few").write_bytes(b"\x7fELF\x01\x01" + b"field_a\0")
    tree = files.file_tree(spark, str(root))
    assert {r.name for r in tree.collect()} == {"a.HTML", "app.js", "hnap.xml", "httpd", "ls", "lib.so", "few"}
    assert {r.name for r in files.with_suffix(tree, "html").collect()} == {"a.HTML"}
    assert {r.name for r in files.executables(tree).collect()} >= {"httpd", "ls"}
    assert files.named(tree, tree.filter("name = 'ls'")).count() == 1
    front = lifecycle.front_end(tree)
    found = {r.name for r in front.keywords.collect()}
    assert set(names) <= found and {"js_literal_name", "WanName", "Deep"} <= found and "never_read_name" not in found
    apis = {(r.name, r.source) for r in front.apis.collect()}
    assert {("/goform/set", "HTML"), ("SetThing", "HTML"), ("/cgi/call", "JS"), ("SetWan", "HTML")} <= apis
    ranked = lifecycle.border_binaries(tree).collect()
    assert [r.bin.rsplit("/", 1)[1] for r in ranked] == ["httpd"]
    assert ranked[0].keywords_count == 13 and ranked[0].functions_count == 1  # the segments of /cgi/call are in no string


def test_script_literals():
    script = """// "no"
    /* 'no' */ var a = "x\\"y", b = 'q', c = `t`, d = 0x1F, e = /re"g[/]x/i, f = true; g = h / 2 / 3;
    o.sendSOAPAction("Act", p(1, 2), cb); o.sendSOAPAction("Two", p); o.sendSOAPAction("Four", a, b, c);"""
    got = web.literals(script)
    assert [v for k, v in got if k == "soap"] == ["Act"]
    values = [v for k, v in got if k == "literal"]
    assert values[:5] == ['x"y', "q", "0x1F", '/re"g[/]x/i', "True"] and "no" not in values and "2" in values
    assert web.literals(None) == [] and web.literals("\"unclosed") == []


def test_xml_walk():
    assert web.tag_depths("<a><n:b xmlns:n='u'><c/></n:b></a>") == [(1, "a"), (2, "b"), (3, "c")]
    assert web.tag_depths("<a>") == [] and web.tag_depths('<!DOCTYPE a [<!ENTITY x "y">]><a/>') == []


def test_pages(spark):
    html = '<a name="one" id="two"><b name="one"><script src="p/q.js?z"></script><script>x()</script><script type="text/javascript">y("A",1)</script>'
    pages = spark.createDataFrame([("p", html)], "path string, html string")
    assert {r.value for r in web.attributes(pages).collect()} == {"one", "two"}
    assert [r.script for r in web.script_references(pages).collect()] == ["q.js"]
    assert pages.select(web.inline_scripts(pages["html"]).alias("s")).first().s == ["x()", 'y("A",1)']


def test_binary_strings(spark):
    rows = spark.createDataFrame([("b", bytearray(b"abcd\x00ab\x01\tx y z\nlast"))], "path string, content binary")
    assert {r.s for r in binstrings.strings(rows).collect()} == {"abcd", "\tx y z", "last"}
    assert [(r.off, r.s) for r in binstrings.strings_at(rows).collect()] == [(0, "abcd"), (5, "ab"), (8, "\tx y z"), (15, "last")]


def test_device_descriptions(spark):
    listing = """<serviceList><service><serviceType>urn:t:W:1</serviceType><serviceId>urn:i:Wan</serviceId><SCPDURL>/scpd/wan.xml</SCPDURL>
      <controlURL>/c</controlURL><eventSubURL>/e</eventSubURL></service></serviceList>"""
    scpd = """<scpd xmlns="u"><actionList><action><name>Do</name><argumentList><argument><name>In</name><direction>in</direction>
      <relatedStateVariable>V</relatedStateVariable></argument><argument><name>Out</name><direction>out</direction></argument></argumentList></action></actionList>
      <serviceStateTable><stateVariable sendEvents="no"><name>V</name><dataType>ui1</dataType></stateVariable></serviceStateTable></scpd>"""
    docs = spark.createDataFrame([("/r/dev.xml", listing), ("/r/scpd/wan.xml", scpd), ("/r/bad.xml", "<x>")], "path string, content string")
    found = devices.services(docs)
    assert [r.scpd_path for r in devices.described(found, docs).collect()] == ["/r/scpd/wan.xml"]
    described = devices.service_descriptions(docs.filter("path <> '/r/dev.xml'"))
    assert [r.path for r in described.collect()] == ["/r/scpd/wan.xml"]
    assert {r.name for r in devices.device_keywords(found, described).collect()} == {"urn:t:W:1", "urn:i:Wan", "Wan", "Do", "In", "V"}
    assert devices.find_action(described, "Do").count() == 1
    given = spark.createDataFrame([("Do", "Other")], "action string, argument string")
    assert [r.argument for r in devices.missing_arguments(described, given).collect()] == ["In"]


def test_text_interchange(spark, tmp_path):
    (tmp_path / "kw").write_text("wan_mtu lan_ip\nwan_mtu ")
    assert {r.name for r in reports.keyword_file(spark, str(tmp_path / "kw")).collect()} == {"wan_mtu", "lan_ip"}
    (tmp_path / "share").write_text("paths\nShares:\nnvram_safe_set k1\nsetenv k2\n")
    assert {tuple(r) for r in reports.share_file(spark, str(tmp_path / "share")).collect()} == {("nvram_safe_get", "k1"), ("getenv", "k2")}
    line = '[Param "{}"(0x900), Referenced at f0 : 0x10] >> 0x18 >> g >> 0x40 -> system'
    lines = spark.createDataFrame([(line.format(w),) for w in ("wan_mtu", "ok", "123", "x", "wan_mtu")] + [("no quote 0x1 0x2 0x3",)], "value string")
    cases = reports.merged_cases(reports.kept_lines(reports.path_lines(lines)))
    assert [tuple(r) for r in cases.collect()] == [(0x900, 0x10, [0x18], [0x40])]
    reports.case_lines(cases).coalesce(1).write.text(str(tmp_path / "alter"))
    assert [tuple(r) for r in reports.read_cases(spark, str(tmp_path / "alter" / "part*")).collect()] == [(0x900, 0x10, [0x18], [0x40])]


def test_keyword_limits(spark):
    rows = [("often", f"p{i}", True) for i in range(11)] + [("seldom", "p1", True), ("_loose", "p1", True), ("_loose", "p2", False), ("abc", "p", False)]
    seen = spark.createDataFrame(rows, "name string, path string, checked boolean")
    accepted = keywords.accepted(seen)
    assert {r.name for r in accepted.collect()} == {"often", "seldom", "_loose"}
    assert accepted.filter("name = '_loose'").count() == 2  # every occurrence counts once one passed
    assert [r.name for r in keywords.limited(accepted, keep=False).collect()] == ["often"]
    gone = keywords.limited(accepted, keep=False)
    assert {r.name for r in keywords.without(accepted, gone).collect()} == {"seldom", "_loose"}
    assert keywords.removals(gone, gone).count() == 1


def test_string_offsets_of_repeated_and_empty_documents(spark, tmp_path):
    texts = [(1, "ab\nc\u00e9de"), (1, "xyz"), (2, None), (3, "\n"), (4, "a" * 300_000 + "\u00e9bb")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = fact_queries.string_offsets(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, 7, True), (4, 2, 300_002, True)]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()  # no text goes with each of its strings


def test_records_cross_byte_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reports, "RANGE_BYTES", 64)
    (tmp_path / "c").mkdir()
    want = []
    for f in range(3):
        cases = [(100 * f + k, k, list(range(k % 5)), [] if k % 4 == 0 else [k, k + 1]) for k in range(50 + f)]
        lines = [" ".join(map(hex, part)) for s, r, t, e in cases for part in ((s, r), t, e)]
        (tmp_path / "c" / f"part-{f}").write_text(("\n", "\r\n", "\n")[f].join(lines) + ("\n", "\r\n", "")[f])
        want += cases
    found = reports.read_cases(spark, str(tmp_path / "c" / "part-*"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert found.rdd.getNumPartitions() > 3
    records = [f"Program name : p{k}\nHits : h {k}\n" + "\n".join(f"field {j} : {j}" for j in range(12)) for k in range(40)]
    (tmp_path / "d").write_text("\n".join(records) + "\n")
    got = reports.read_clusters(spark, str(tmp_path / "d")).collect()
    assert sorted((r.name, r.fields["Hits"], len(r.fields)) for r in got) == sorted((f"p{k}", f"h {k}", 14) for k in range(40))
    (tmp_path / "e").write_text("0x1 0x2\n0x3\n")
    assert [tuple(r) for r in reports.read_cases(spark, str(tmp_path / "e")).collect()] == [(1, 2, [3], [])]
    (tmp_path / "e").write_text("0x1 0x2\n0x3")
    with pytest.raises(Exception, match="no case in"):
        reports.read_cases(spark, str(tmp_path / "e")).collect()


def test_records_of_a_file_of_one_range_are_read_once(spark, tmp_path):
    lines = ["0x1 0x2", "0x3 0xABc", "0x4", " 0x1\t2 ", "", "9223372036854775807  0x7FFFFFFFFFFFFFFF", "", "", "", "0x5 6", "0x7", "", "0x8 0x9", "0xa"]
    (tmp_path / "f").write_text("\r\n".join(lines) + "\n")
    found = reports.read_cases(spark, str(tmp_path / "f"))
    top = 2**63 - 1
    assert [tuple(r) for r in found.collect()] == [(1, 2, [3, 0xABC], [4]), (1, 2, [], [top, top]), (5, 6, [7], []), (8, 9, [10], [])]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1  # neither counted nor dealt out before
    for bad in ("0x1\n0x2\n0x3\n", "0x1 0x2\nx\n0x3\n", "0x1 0x2 0x3\n\n\n", "0x1 0x2\n0x3 0xg\n0x4\n"):
        (tmp_path / "g").write_text("0x1 0x2\n\n\n" + bad)
        with pytest.raises(Exception, match="no case in .*/g, record 1"):
            reports.read_cases(spark, str(tmp_path / "g")).collect()
