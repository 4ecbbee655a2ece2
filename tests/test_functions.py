"""Name rules, string functions and device values."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import devices, text


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", make(F.col("v"))).orderBy("i").collect()]


def test_keyword_rule(spark):
    names = ["ssid", "abc", "1wan_name", "_hidden", "wan_mtu", "lan-ip", "a" * 25, "a" * 24, "wan mtu", "名字名字名字"]
    assert column(spark, names, lambda c: text.keyword_ok(c, False)) == [True, False, False, True, True, True, True, True, True, True]
    assert column(spark, names, text.keyword_ok) == [False, False, False, False, True, False, False, True, False, True]


def test_api_rule(spark):
    values = ["/goform/set?", "/a/b", "goform", "/x.asp", "  /goform/x \n", "/goform/set??", "/goform/a=b"]
    assert column(spark, values, text.api_name) == ["/goform/set", None, None, None, "/goform/x", "/goform/set?", None]
    kinds = column(spark, ["wan_mtu", "/goform/set", "no"], text.keyword_or_api)
    assert [k and (k.kind, k.name) for k in kinds] == [("keyword", "wan_mtu"), ("api", "/goform/set"), None]


def test_path_rules(spark):
    paths = ["/bin/ls", "/bin/utils", "/bin/httpd", "/lib/a.so", ".so", "/lib/x.ko.so"]
    assert column(spark, paths, text.not_command) == [False, False, True, True, True, True]
    assert column(spark, paths, text.not_library) == [True, True, True, False, True, False]
    assert column(spark, ["a/b.js?x", "?x", "a"], text.query_cut) == ["a/b.js", "?x", "a"]
    assert column(spark, ["/cfg/wan_mtu", "/cfg/a-b", "plain"], text.path_string_ok) == [True, False, False]


@pytest.mark.parametrize("name,setter,getter", [
    ("set_x", True, False), ("setx", True, False), ("offset", True, False), ("offsets", False, False), ("reSetX", True, False),
    ("websGetVar", False, True), ("get", False, True), ("budget", False, True), ("budgets", False, False), ("x_get", False, True), ("nvram_set", True, False),
])
def test_role_names_are_symmetric(spark, name, setter, getter):
    assert column(spark, [name], text.is_setter) == [setter]
    assert column(spark, [name], text.is_getter) == [getter]


def test_strings_and_addresses(spark):
    assert column(spark, ["wan_mtu_x", "wan_mtu-2", "wan_mtu_a-b", "mtu", "wan_mtu"], lambda c: text.similar(c, "wan_mtu")) == [True, True, False, False, True]
    assert column(spark, ["http_x", "-GET", "POST", "post", "none"], text.is_network_word) == [True, False, True, False, False]
    assert column(spark, ["%s %% %d%%%x", "%", None], text.format_specifiers) == [["%s", "%d", "%x"], [], None]
    assert column(spark, ["nvram_safe_set", "SETenv", "Setter"], text.getter_of) == ["nvram_safe_get", "GETenv", "Getter"]
    assert column(spark, ["a:%x", "b"], text.data_key) == ["a", "b"]
    assert column(spark, ["wan_mtu", "a-b", "none"], text.key_prefix) == ["wan_", "a-", None]
    assert column(spark, ["abc\x01d", "ab", "\x01abc"], text.memory_string) == ["abc", None, None]
    assert column(spark, ["12ab"], text.swapped) == ["ab12"]
    assert column(spark, ["taint_buf_12_32"], text.variable_name) == ["taint_buf"]
    row = spark.range(1).select(
        text.hex_address(F.lit(255)).alias("h"), text.address(F.lit("0xff")).alias("n"), text.rebased(F.lit(0x10010)).alias("r"),
        text.longest(F.lit("ab"), F.lit("abc"), F.lit(None).cast("string"), F.lit("xyz")).alias("l"),
        text.guard_hash(F.array(*map(F.lit, (3, 1, 3)))).alias("g"), text.byte_order(F.unhex(F.lit("7F454C460101"))).alias("b"),
        text.is_private_key(F.lit("-----BEGIN RSA PRIVATE KEY").cast("binary")).alias("k"),
    ).first()
    assert (row.h, row.n, row.r, row.l, row.g, row.b, row.k) == ("0xff", 255, 0x400010, "abc", "1,3", "little", True)


@pytest.mark.parametrize("kind,good,bad", [
    ("ui1", ["0", "255"], ["256", "-1", "x", None]), ("i4", ["-2147483648"], ["2147483648"]), ("r4", ["1.5", "-2e10", "0"], ["1e39", "1e-39", "x"]),
    ("r8", ["1e300"], ["1e999"]), ("char", ["x"], ["xy", ""]), ("date", ["2020-02-29"], ["2021-02-29", "2020-01-01T00:00:00"]),
    ("dateTime", ["2020-01-01T10:00:00"], ["2020-01-01T10:00:00Z"]), ("dateTime.tz", ["2020-01-01T10:00:00+01:00"], ["10:00"]),
    ("time", ["10:00:00"], ["10:00:00Z", "2020-01-01"]), ("boolean", ["yes", "TRUE", "0"], ["2"]), ("bin.base64", ["QUJD", ""], ["QUJ"]),
    ("bin.hex", ["0aFF"], ["0a0"]), ("uuid", ["00000000-0000-0000-0000-00000000000A"], ["0"]), ("uri", ["http://x"], []), ("other", [], ["x"]),
])
def test_device_values(spark, kind, good, bad):
    for value in good:
        assert column(spark, [value], lambda c: devices.valid(c, F.lit(kind))) == [True], value
    for value in bad:
        assert column(spark, [value], lambda c: devices.valid(c, F.lit(kind))) == [False], value


def test_device_lists_and_headers(spark):
    allowed = F.array(F.lit("a"), F.lit("b"))
    assert column(spark, ["a", "c"], lambda c: devices.valid(c, F.lit("string"), allowed)) == [True, False]
    assert column(spark, ["anything"], lambda c: devices.valid(c, F.lit("string"), F.array().cast("array<string>"))) == [True]
    assert column(spark, ["SID: x:y\r\nTimeout: Second-30\r\nsid: z"], devices.headers) == [{"sid": "z", "timeout": "Second-30"}]
    assert column(spark, ["Second-30", "infinite"], devices.subscription_seconds) == [30, None]
    assert column(spark, ["urn:a:serviceId:WAN"], devices.service_name) == ["WAN"]
