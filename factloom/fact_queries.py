"""More registered queries: the operators over facts, each on proxies made from the driver's tables.

The proxies are SQL that both engines read alike; a query applies its operator to them, and its DuckDB
SQL derives the same rows from the same proxies.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import params
from .functions import devices as device_values
from .functions import text
from .operators import facts, graph, keywords, matching, ranges, ranking, stats, taint, units
from .operators.common import saved, scratch
from .queries import query
from .sources import binstrings, devices, files, reports, web

_TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def _in(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A proxy: SQL over the driver's tables."""
    used = [t for t in _TABLES if re.search(rf"\bFROM {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def _listed(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --- files and names -------------------------------------------------------------------------------

_PATHS = """SELECT p_partkey, concat('/usr/bin/', replace(p_name, ' ', ''), CASE p_partkey % 5 WHEN 0 THEN '.so.1' WHEN 1 THEN '/ls' WHEN 2 THEN '/httpd'
  WHEN 3 THEN '.ko' ELSE '/utils' END) AS path FROM part"""


@query(f"""SELECT p_partkey, path FROM ({_PATHS}) WHERE p_partkey % 3 = 0 AND NOT regexp_matches(path, '({'|'.join(params.COMMANDS)})$')
  AND instr(path, '.so') <= 1 AND instr(path, '.ko') <= 1""")
def analysed_binaries(spark, sf_dir):
    content = F.when(F.col("p_partkey") % 3 == 0, F.unhex(F.lit("7F454C460101"))).otherwise(F.lit("MZ").cast("binary"))
    tree = _in(spark, sf_dir, _PATHS).withColumn("content", content).withColumn("kind", text.file_kind(F.col("path"), content))
    return files.binaries(tree).select("p_partkey", "path")


@query("SELECT c_mktsegment AS segment, 'txt' AS suffix, sum(length(c_name) + 1)::BIGINT AS bytes, count(*) AS lines FROM customer GROUP BY c_mktsegment")
def file_tree(spark, sf_dir):
    """Writes a tree of text files, one a segment, and reads it as a firmware tree."""
    where = scratch(spark, "tree")
    rows = _in(spark, sf_dir, "SELECT c_mktsegment, c_name FROM customer")
    rows.repartition(1).write.partitionBy("c_mktsegment").text(where)
    tree = files.with_suffix(files.file_tree(spark, where, glob="*.txt"), "txt")
    lines = F.size(F.split(files.readable(F.col("content")), "\n")) - 1
    found = tree.select(F.regexp_extract("path", "c_mktsegment=([^/]+)/", 1).alias("segment"), "suffix", F.col("length").alias("bytes"), lines.cast("bigint").alias("lines"))
    return found.groupBy("segment", "suffix").agg(F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"))


@query("SELECT doc_id, count(*) AS strings, sum(length(s))::BIGINT AS characters, true AS placed FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\x09\\x0B-\\x0D -~]{2,}')) AS s FROM documents) GROUP BY doc_id")
def string_offsets(spark, sf_dir):
    """Every printable string stands in the bytes where its offset says."""
    docs = _in(spark, sf_dir, "SELECT doc_id, text FROM documents")
    found = docs.select("doc_id", F.col("text").cast("binary").alias("held"), binstrings.runs_at(F.col("text")).alias("runs")).filter("size(runs) > 0")
    each = found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n"), F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + F.length(r["s"])).alias("c"),
        F.forall("runs", lambda r: F.substr(F.col("held"), (r["off"] + 1).cast("int"), F.length(r["s"])) == r["s"].cast("binary")).alias("there"),
    )
    return each.groupBy("doc_id").agg(F.sum("n").alias("strings"), F.sum("c").alias("characters"), F.bool_and("there").alias("placed"))


_MIXED = "SELECT p_partkey, concat(' ', replace(p_name, ' ', CASE p_size % 3 WHEN 0 THEN '/' WHEN 1 THEN '%' ELSE '_' END), CASE WHEN p_size % 2 = 0 THEN '/x' ELSE '' END) AS s FROM part"


@query(f"SELECT p_partkey, contains(s, '/') AND NOT regexp_matches(trim(s), '[@^&*(){{}}\\[\\]:;,<>|，？ +.%-]') AS ok FROM ({_MIXED})")
def path_strings(spark, sf_dir):
    return _in(spark, sf_dir, _MIXED).select("p_partkey", text.path_string_ok(F.col("s")).alias("ok"))


_VALUES = "SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN concat('/', p_type, '/', p_brand, '?') WHEN 1 THEN lower(p_type) WHEN 2 THEN concat(' /cgi/', lower(p_type)) ELSE p_brand END AS v FROM part"


@query(f"""SELECT v, CASE WHEN kw THEN 'keyword' WHEN api THEN 'api' END AS kind, CASE WHEN kw THEN v WHEN api THEN regexp_replace(t, '\\?$', '') END AS name FROM (
  SELECT v, t, length(v) BETWEEN 5 AND 24 AND NOT regexp_matches(v, '^[0-9_]') AND NOT regexp_matches(v, '[ !@#$%^&*()\\-+{{}}\\[\\]:;''",.?/<>\\\\|，？！=]') AS kw,
    length(t) >= 5 AND contains(t, '/') AND NOT regexp_matches(t, '[@^&*(){{}}\\[\\]:;,<>|，？ +.=]') AS api FROM (SELECT v, trim(v) AS t FROM ({_VALUES})))""")
def value_kinds(spark, sf_dir):
    rows = _in(spark, sf_dir, _VALUES).withColumn("found", text.keyword_or_api(F.col("v")))
    return rows.select("v", "found.kind", "found.name")


_KEYS = """SELECT p_partkey, concat(p_type, CASE p_size % 3 WHEN 0 THEN '_' WHEN 1 THEN '-' ELSE '' END, lower(p_type), CASE WHEN p_size % 2 = 0 THEN ':%d' ELSE '' END) AS raw,
  concat(lower(p_type), '_set', p_type, 'SET') AS setter, concat('v_', p_size, '_', p_partkey, '_32') AS symbol FROM part"""


@query(f"""SELECT p_partkey, key, nullif(regexp_extract(key, '^([^_-]*[_-])', 1), '') AS prefix, replace(replace(replace(setter, 'set', 'get'), 'SET', 'GET'), 'Set', 'Get') AS getter,
  regexp_replace(symbol, '_\\d+_\\d+$', '') AS variable FROM (SELECT *, split_part(raw, ':%', 1) AS key FROM ({_KEYS}))""")
def key_names(spark, sf_dir):
    key = text.data_key(F.col("raw"))
    return _in(spark, sf_dir, _KEYS).select(
        "p_partkey", key.alias("key"), text.key_prefix(key).alias("prefix"), text.getter_of(F.col("setter")).alias("getter"), text.variable_name(F.col("symbol")).alias("variable")
    )


@query("""SELECT o_orderkey, concat(substr(h, 7, 2), substr(h, 5, 2), substr(h, 3, 2), substr(h, 1, 2)) AS swapped, CASE o_orderkey % 3 WHEN 0 THEN 'little' WHEN 1 THEN 'big' END AS byte_order
  FROM (SELECT o_orderkey, lpad(lower(to_hex(o_orderkey)), 8, '0') AS h FROM orders)""")
def byte_orders(spark, sf_dir):
    orders = _in(spark, sf_dir, "SELECT o_orderkey FROM orders")
    order = F.when(F.col("o_orderkey") % 3 == 0, "01").when(F.col("o_orderkey") % 3 == 1, "02").otherwise("00")
    head = F.unhex(F.concat(F.lit("7F454C4601"), order))
    return orders.select("o_orderkey", text.swapped(F.lpad(F.lower(F.hex("o_orderkey")), 8, "0")).alias("swapped"), text.byte_order(head).alias("byte_order"))


@query("""SELECT p_partkey, CASE WHEN coalesce(length(b), -1) > coalesce(length(a), -1) THEN b ELSE a END AS decoded FROM (
  SELECT p_partkey, CASE WHEN length(a) >= 3 THEN a END AS a, CASE WHEN length(b) >= 3 THEN b END AS b FROM (
    SELECT p_partkey, regexp_extract(p_name, '^[0-9A-Za-z_/\\-]*') AS a, regexp_extract(substr(p_type, 1 + p_size % 8), '^[0-9A-Za-z_/\\-]*') AS b FROM part))""")
def memory_candidates(spark, sf_dir):
    rows = _in(spark, sf_dir, "SELECT p_partkey, p_name, substr(p_type, 1 + p_size % 8) AS other FROM part")
    decoded = [text.memory_string(F.col(c), extended=False) for c in ("p_name", "other")]
    return rows.select("p_partkey", text.longest(*decoded).alias("decoded"))


# --- scripts, forms, devices -----------------------------------------------------------------------

@query("SELECT p_partkey, 'api' AS kind, concat('api', p_size) AS value FROM part UNION ALL SELECT p_partkey, 'keyword', concat('key', p_partkey) FROM part")
def protocol_tags(spark, sf_dir):
    xml = "SELECT p_partkey, concat('<r><m><api', p_size, '><key', p_partkey, '/></api', p_size, '></m></r>') AS content FROM part"
    return web.protocol_tags(_in(spark, sf_dir, xml), key="p_partkey")


@query("""SELECT p_partkey, 'pattern' AS way, p_type AS value FROM part UNION ALL SELECT p_partkey, 'tokens', p_type FROM part""")
def soap_calls(spark, sf_dir):
    """First arguments by pattern, and by tokens: only calls of three arguments."""
    script = """SELECT p_partkey, concat('x.sendSOAPAction("', p_type, '", a, b); y.sendSOAPAction("', p_brand, '", c)') AS content FROM part"""
    rows = _in(spark, sf_dir, script)
    by_token = web.script_literals(rows, key="p_partkey").filter("kind = 'soap'").select("p_partkey", F.lit("tokens").alias("way"), "value")
    return rows.select("p_partkey", F.lit("pattern").alias("way"), F.explode(web.soap_actions(F.col("content"))).alias("value")).union(by_token)


@query("""SELECT p_partkey, 'action' AS kind, concat('/goform/', p_type) AS name FROM part UNION ALL SELECT p_partkey, 'script', concat(p_brand, '.js') FROM part""")
def forms_and_scripts(spark, sf_dir):
    html = """SELECT p_partkey, concat('<form action="/goform/', p_type, '"></form><script src="/js/', p_brand, '.js?v=', p_size, '"></script>') AS html FROM part"""
    pages = _in(spark, sf_dir, html)
    scripts = web.script_references(pages, key="p_partkey").select(F.col("html_path").alias("p_partkey"), F.lit("script").alias("kind"), F.col("script").alias("name"))
    return web.actions(pages, key="p_partkey").select("p_partkey", F.lit("action").alias("kind"), "name").union(scripts)


_LISTS = """SELECT p_partkey AS path, concat('<root><serviceList><service><serviceType>urn:T:', p_type, '</serviceType><serviceId>urn:x:', p_brand, '</serviceId>',
  '<controlURL>/ctl</controlURL><eventSubURL>/e</eventSubURL><SCPDURL>/svc/s', p_partkey, '.xml</SCPDURL></service></serviceList></root>') AS content FROM part"""
_SCPD = """SELECT p_partkey AS path, concat('<scpd><actionList><action><name>Set', p_brand, '</name><argumentList><argument><name>New', p_type, '</name><direction>in</direction>',
  '<relatedStateVariable>V</relatedStateVariable></argument></argumentList></action></actionList><serviceStateTable><stateVariable sendEvents="no"><name>V', p_size,
  '</name><dataType>ui2</dataType></stateVariable></serviceStateTable></scpd>') AS content FROM part"""


@query("""SELECT p_partkey AS path, concat('urn:T:', p_type) AS service_type, concat('/svc/s', p_partkey, '.xml') AS scpd_url, concat('/fw/svc/s', p_partkey, '.xml') AS scpd_path FROM part WHERE p_partkey % 2 = 0""")
def device_services(spark, sf_dir):
    listed = devices.services(_in(spark, sf_dir, _LISTS))
    paths = _in(spark, sf_dir, "SELECT concat('/fw/svc/s', p_partkey, '.xml') AS path FROM part WHERE p_partkey % 2 = 0")
    return devices.described(listed, paths).select("path", "service_type", "scpd_url", "scpd_path")


@query("""SELECT DISTINCT p_partkey AS path, unnest([concat('urn:T:', p_type), concat('urn:x:', p_brand), p_brand, concat('Set', p_brand), concat('New', p_type), concat('V', p_size)]) AS name FROM part""")
def device_keywords(spark, sf_dir):
    listed, inner = devices.services(_in(spark, sf_dir, _LISTS)), devices.service_descriptions(_in(spark, sf_dir, _SCPD))
    return devices.device_keywords(listed, inner)


_GIVEN = "SELECT DISTINCT concat('Set', p_brand) AS action, concat('New', p_type) AS argument FROM part WHERE p_brand > 'Brand#2'"


@query(f"""SELECT p_partkey AS path, concat('Set', p_brand) AS action, concat('New', p_type) AS argument FROM part
  WHERE (concat('Set', p_brand), concat('New', p_type)) NOT IN (SELECT (action, argument) FROM ({_GIVEN}))""")
def missing_arguments(spark, sf_dir):
    return devices.missing_arguments(devices.service_descriptions(_in(spark, sf_dir, _SCPD)), _in(spark, sf_dir, _GIVEN))


@query("SELECT min(p_partkey) AS path, 'SetBrand#2' AS name FROM part WHERE p_brand = 'Brand#2'")
def first_action(spark, sf_dir):
    return devices.find_action(devices.service_descriptions(_in(spark, sf_dir, _SCPD)), "SetBrand#2").select("path", F.col("action.name").alias("name"))


@query("SELECT p_partkey, p_type AS host, p_size::BIGINT AS seconds, p_brand AS service FROM part")
def device_headers(spark, sf_dir):
    rows = _in(spark, sf_dir, "SELECT * FROM part")
    head = F.concat(F.lit("HOST: "), "p_brand", F.lit("\r\nTIMEOUT: Second-"), F.col("p_size").cast("string"), F.lit("\nhost:  "), "p_type")
    named = rows.select("p_partkey", device_values.headers(head).alias("h"), device_values.service_name(F.concat(F.lit("urn:upnp:"), "p_brand")).alias("service"))
    return named.select("p_partkey", F.col("h")["host"].alias("host"), device_values.subscription_seconds(F.col("h")["timeout"]).alias("seconds"), "service")


_HOLD = "SELECT p_brand AS bin, CASE WHEN p_size % 2 = 0 THEN concat('urn:', p_type, p_size) ELSE p_name END AS s FROM part"
_WORDS = "SELECT DISTINCT split_part(p_name, ' ', 1) AS name, CAST(p_partkey % 40 AS VARCHAR(9)) AS path FROM part"


@query(f"""WITH s AS ({_HOLD}), w AS ({_WORDS}), hits AS (SELECT DISTINCT bin, name FROM s JOIN (SELECT DISTINCT name FROM w) ON contains(s, name))
  SELECT bin, n + coalesce(u, 0) AS keywords_count, f AS source_files FROM (SELECT bin, count(*) AS n FROM hits GROUP BY bin HAVING count(*) >= 2)
  LEFT JOIN (SELECT bin, count(DISTINCT s) AS u FROM s WHERE s LIKE 'urn:%' GROUP BY bin) USING (bin)
  JOIN (SELECT bin, count(DISTINCT path) AS f FROM hits JOIN w USING (name) GROUP BY bin) USING (bin)""")
def device_rank(spark, sf_dir):
    strings, names = _in(spark, sf_dir, _HOLD), _in(spark, sf_dir, _WORDS)
    return ranking.device_rank(matching.keyword_matches(strings, names), matching.urn_strings(strings), names, least_keywords=2)


# --- interchange files -----------------------------------------------------------------------------

@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part")
def keyword_file(spark, sf_dir):
    where = scratch(spark, "keywords")
    _in(spark, sf_dir, "SELECT concat(p_name, '  ') AS value FROM part").write.text(where)
    return reports.keyword_file(spark, where)


@query("SELECT DISTINCT 'nvram_safe_get' AS function, n_name AS key FROM nation UNION SELECT DISTINCT 'getenv', concat('r', n_regionkey) FROM nation")
def share_file(spark, sf_dir):
    where = scratch(spark, "shares")
    rows = _in(spark, sf_dir, "SELECT n_nationkey, n_name, n_regionkey FROM nation")
    value = F.concat(F.lit("0x1 -> run\nShares:\nnvram_safe_set "), "n_name", F.lit("\nsetenv r"), F.col("n_regionkey").cast("string"), F.lit("\nno pair here\n"))
    rows.select("n_nationkey", value.alias("value")).repartition(1).write.partitionBy("n_nationkey").text(where)
    return reports.share_file(spark, f"{where}/*")


@query("""SELECT l_orderkey AS str_addr, l_suppkey AS ref_addr, array_to_string(list_sort(list_distinct(list(l_partkey))), ' ') AS trace, l_suppkey::VARCHAR AS sinks
  FROM lineitem GROUP BY l_orderkey, l_suppkey""")
def case_file(spark, sf_dir):
    where = scratch(spark, "cases")
    rows = _in(spark, sf_dir, "SELECT l_orderkey AS str_addr, l_suppkey AS ref_addr, l_partkey FROM lineitem")
    cases = rows.groupBy("str_addr", "ref_addr").agg(F.array_sort(F.collect_set("l_partkey")).alias("trace")).withColumn("sinks", F.array("ref_addr"))
    reports.case_lines(cases).write.text(where)
    back = reports.read_cases(spark, f"{where}/part-*")
    return back.select("str_addr", "ref_addr", F.array_join("trace", " ").alias("trace"), F.array_join("sinks", " ").alias("sinks"))


@query("SELECT concat(p_brand, '/', p_partkey) AS name, p_type AS held, 14::BIGINT AS lines FROM part")
def cluster_file(spark, sf_dir):
    where = scratch(spark, "clusters")
    rows = _in(spark, sf_dir, "SELECT concat(p_brand, '/', p_partkey) AS name, p_type FROM part")
    more = [F.lit(f"field {k} : {k}") for k in range(12)]
    rows.select(F.concat_ws("\n", F.concat(F.lit("Program name : "), "name"), F.concat(F.lit("Hits : "), "p_type"), *more).alias("value")).write.text(where)
    return reports.read_clusters(spark, f"{where}/part-*").select("name", F.col("fields")["Hits"].alias("held"), F.size("fields").cast("bigint").alias("lines"))


_CASES = "SELECT o_custkey AS str_addr, o_orderkey AS ref_addr, o_orderstatus FROM orders"


@query(f"""SELECT concat('0x', lower(to_hex(str_addr)), ' 0x', lower(to_hex(ref_addr)), '   ', CASE WHEN o_orderstatus = 'F' THEN concat('found : 0x', lower(to_hex(ref_addr * 2))) ELSE 'not found' END) AS value
  FROM ({_CASES})""")
def verdict_lines(spark, sf_dir):
    cases = _in(spark, sf_dir, _CASES).withColumn("sinks", F.array(F.col("ref_addr") * 2, F.col("ref_addr") * 2 + 1))
    found = cases.filter("o_orderstatus = 'F'").select("str_addr", "ref_addr", (F.col("ref_addr") * 2).alias("call_addr"))
    return reports.verdict_lines(cases, found).select("value")


@query(f"SELECT count(*) AS cases, count(*) FILTER (WHERE o_orderstatus = 'F') AS found FROM ({_CASES})")
def verdict_totals(spark, sf_dir):
    cases = _in(spark, sf_dir, _CASES).withColumn("sinks", F.array(F.col("ref_addr") * 2))
    found = cases.filter("o_orderstatus = 'F'").select("str_addr", "ref_addr", (F.col("ref_addr") * 2).alias("call_addr"))
    return reports.verdict_totals(reports.verdict_lines(cases, found))


@query("""SELECT p_type AS api, concat('API Name: ', p_type, chr(10), 'from bin match: ', string_agg(DISTINCT p_brand, ' ' ORDER BY p_brand), chr(10), 'Action: ', chr(10), 'Keyword: ', p_type, chr(10)) AS value
  FROM part GROUP BY p_type""")
def split_report(spark, sf_dir):
    rows = _in(spark, sf_dir, "SELECT p_type AS api, p_brand FROM part").groupBy("api").agg(F.collect_set("p_brand").alias("match_strs"))
    return reports.split_lines(rows.withColumn("actions", F.array().cast("array<string>")).withColumn("keywords", F.array("api")))


@query("""SELECT p_brand AS name, concat('FileName: ', p_brand, chr(10), 'Cited: ', count(DISTINCT p_type), chr(10), 'FilePath: /js/', p_brand, chr(10), 'Referenced file : ', chr(10),
  string_agg(DISTINCT concat(chr(9), p_type), chr(10) ORDER BY concat(chr(9), p_type)), chr(10)) AS value FROM part GROUP BY p_brand""")
def skipped_report(spark, sf_dir):
    rows = _in(spark, sf_dir, "SELECT p_brand AS name, concat('/js/', p_brand) AS path, p_type FROM part").groupBy("name", "path").agg(F.collect_set("p_type").alias("pages"))
    return reports.skipped_lines(rows).select("name", "value")


@query("""SELECT p_brand AS bin, concat('Program name : ', p_brand, chr(10), 'Upnp Para: ', chr(10), chr(9), 'Hits Para count: ', count(DISTINCT p_type), chr(10), chr(9), 'Hits Para : ', chr(10),
  chr(9), chr(9), string_agg(DISTINCT p_type, ' ' ORDER BY p_type), chr(10), chr(9), 'Number of UPnp Para source files: 1', chr(10)) AS value FROM part GROUP BY p_brand""")
def device_report(spark, sf_dir):
    names = _in(spark, sf_dir, "SELECT p_brand AS bin, p_type AS name FROM part")
    ranks = names.groupBy("bin").agg(F.countDistinct("name").alias("keywords_count")).withColumn("source_files", F.lit(1))
    return reports.device_lines(ranks, names)


@query("""SELECT 'keyword_simple' AS report, count(DISTINCT p_name) AS lines FROM part UNION ALL SELECT 'api_simple', count(DISTINCT p_type) FROM part
  UNION ALL SELECT 'matched', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'path_strings', count(DISTINCT (p_brand, p_name)) FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT 'info', 2""")
def report_tables(spark, sf_dir):
    where = scratch(spark, "reports")
    rows = _in(spark, sf_dir, "SELECT * FROM part")
    names, apis = rows.select(F.col("p_name").alias("name"), F.col("p_brand").alias("path")), rows.select(F.col("p_type").alias("name"), F.col("p_brand").alias("path"))
    matched = rows.select(F.col("p_brand").alias("bin"), F.col("p_name").alias("name"), F.col("p_name").alias("match_str"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("/"), "p_name")).alias("full_str"))
    ranks = rows.groupBy(F.col("p_brand").alias("bin")).agg(F.countDistinct("p_name").alias("keywords_count"))
    totals = rows.agg(F.count("*").alias("values"), F.countDistinct("p_name").alias("values_kept"))
    reports.write_reports(where, keywords=names, apis=apis, matches=matched, ranks=ranks, removed=names.limit(0), occurrences=names, totals=totals)
    out = None
    for name in ("keyword_simple", "api_simple", "matched", "path_strings", "info"):
        one = (spark.read.text if name == "info" else spark.read.parquet)(f"{where}/{name}").agg(F.lit(name).alias("report"), F.count("*").alias("lines"))
        out = one if out is None else out.union(one)
    return out


# --- names over units ------------------------------------------------------------------------------

_SEEN = "SELECT concat(p_name, p_partkey % 997) AS name, p_brand AS path FROM part"


@query(f"""WITH o AS (SELECT DISTINCT name, path FROM ({_SEEN})), gone AS (SELECT name FROM o GROUP BY name HAVING count(*) > 3 UNION SELECT name FROM o WHERE path = 'Brand#2')
  SELECT name, path FROM o WHERE name NOT IN (SELECT name FROM gone)""")
def removed_names(spark, sf_dir):
    seen = _in(spark, sf_dir, _SEEN).distinct()
    gone = keywords.removals(keywords.limited(seen, 3, keep=False), seen.filter("path = 'Brand#2'"))
    return keywords.without(seen, gone)


@query("""SELECT count(DISTINCT p_name) AS keywords, count(DISTINCT p_type) FILTER (WHERE p_size > 25) AS functions FROM part""")
def effective_names(spark, sf_dir):
    rows = _in(spark, sf_dir, "SELECT p_brand AS bin, p_name, p_type, p_size FROM part")
    return keywords.effective(rows.select("bin", F.col("p_name").alias("name")), rows.filter("p_size > 25").select("bin", F.col("p_type").alias("name")))


@query("""WITH p AS (SELECT DISTINCT p_brand AS bin, p_type AS name FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_size > 48))
  SELECT DISTINCT name, name NOT IN (SELECT name FROM p WHERE bin = 'Brand#2') AS elsewhere_only FROM p""")
def exact_names(spark, sf_dir):
    rows = _in(spark, sf_dir, "SELECT p_brand AS bin, p_type AS s, p_size FROM part")
    present = saved(facts.exact_presence(rows, rows.filter("p_size > 48").select(F.col("s").alias("name"))))
    other = facts.not_in_unit(present, "Brand#2").withColumn("elsewhere_only", F.lit(True))
    return present.select("name").distinct().join(other, "name", "left").select("name", F.coalesce("elsewhere_only", F.lit(False)).alias("elsewhere_only"))


_GLOBALS = f"SELECT unnest([{_listed(params.GLOBAL_NAMES)}]) AS name"


@query(f"""WITH g AS ({_GLOBALS}), n AS (SELECT name, row_number() OVER () - 1 AS i FROM g), s AS (SELECT p_brand AS bin, concat('cfg ', name) AS s FROM part JOIN n ON p_partkey % {len(params.GLOBAL_NAMES)} = i)
  SELECT bin, strings_count, keywords_count, 0::BIGINT AS functions_count FROM (SELECT bin, count(DISTINCT name) AS keywords_count FROM s JOIN g ON contains(s, name) GROUP BY bin)
  JOIN (SELECT bin, count(*) AS strings_count FROM s GROUP BY bin) USING (bin)""")
def global_names(spark, sf_dir):
    """Units ranked by the fixed list of configuration names."""
    pick = F.get(F.array(*map(F.lit, params.GLOBAL_NAMES)), F.col("p_partkey") % len(params.GLOBAL_NAMES))
    strings = _in(spark, sf_dir, "SELECT p_brand AS bin, p_partkey FROM part").select("bin", F.concat(F.lit("cfg "), pick).alias("s"))
    return facts.presence_rank(strings, spark.createDataFrame([(n,) for n in params.GLOBAL_NAMES], "name string"))


_UNITS = "SELECT concat(CASE WHEN p_size % 5 = 0 THEN 'lib/' ELSE 'bin/' END, p_brand) AS bin, concat(p_name, CASE WHEN p_size % 2 = 0 THEN ' getenv' ELSE '' END) AS s FROM part"
_DATA = "SELECT DISTINCT split_part(p_name, ' ', 2) AS name FROM part WHERE p_size > 40"
_HELD = f"SELECT DISTINCT bin, name FROM ({_UNITS}) JOIN ({_DATA}) ON contains(s, name) WHERE NOT contains(bin, 'lib')"


@query(_HELD)
def key_presence(spark, sf_dir):
    return matching.by_presence(_in(spark, sf_dir, _UNITS), _in(spark, sf_dir, _DATA))


_USED = "SELECT concat('bin/', p_brand) AS bin, 'getenv_s' AS callee, split_part(p_name, ' ', 2) AS const_str FROM part WHERE p_size % 2 = 0 AND p_partkey % 2 = 0"


@query(f"""SELECT DISTINCT bin, name FROM ({_HELD}) h WHERE bin IN (SELECT bin FROM ({_UNITS}) WHERE contains(s, 'getenv')) AND (bin, name) IN (SELECT (bin, const_str) FROM ({_USED}))""")
def dual_use(spark, sf_dir):
    return matching.by_dual(_in(spark, sf_dir, _UNITS), _in(spark, sf_dir, _USED), _in(spark, sf_dir, _DATA), "getenv")


@query("SELECT p_partkey AS bin, 8000 + p_size % 3 AS port, concat('10.0.', p_size, '.1') AS ip FROM part WHERE p_size < 30")
def socket_bindings(spark, sf_dir):
    rows = _in(spark, sf_dir, "SELECT p_partkey AS bin, p_size FROM part")
    mark = F.concat(F.hex(F.lit(64) + F.col("p_size") % 3), F.lit("1F"))  # 8000 is 1F40
    content = F.concat(F.lit("..").cast("binary"), F.concat(F.lit("10.0."), F.col("p_size").cast("string"), F.lit(".1 ")).cast("binary"), F.unhex(mark))
    bindings = rows.filter("p_size < 30").select((F.lit(8000) + F.col("p_size") % 3).alias("port"), F.concat(F.lit("10.0."), F.col("p_size").cast("string"), F.lit(".1")).alias("ip")).distinct()
    return matching.by_binding(rows.select("bin", content.alias("content")), bindings)


# --- references and symbols ------------------------------------------------------------------------

_REFS = "SELECT DISTINCT l_suppkey AS bin, l_partkey AS str_addr, l_orderkey AS ref_addr, l_linenumber % 3 AS way FROM lineitem"


@query(f"""SELECT DISTINCT bin, concat('k', str_addr) AS s, ref_addr, CASE way WHEN 0 THEN 'direct' WHEN 1 THEN 'offset' ELSE 'pointer' END AS ref_kind FROM ({_REFS}) WHERE str_addr % 2 = 0""")
def key_references(spark, sf_dir):
    refs = saved(_in(spark, sf_dir, _REFS))
    strings = refs.filter("str_addr % 2 = 0").select("bin", "str_addr", F.concat(F.lit("k"), F.col("str_addr").cast("string")).alias("s")).distinct()
    return facts.key_references(strings, *(refs.filter(f"way = {k}") for k in range(3)))


_POINTS = "SELECT user_id AS bin, event_id AS to_addr, event_id * 7 % 1000 AS from_addr FROM events"
_BODIES = "SELECT DISTINCT user_id AS bin, concat('f', event_id % 10) AS func, event_id % 10 * 100 AS entry, event_id % 10 * 100 + 49 AS end_addr FROM events WHERE event_id % 10 % 3 = 0"


@query(f"""WITH r AS ({_POINTS}), f AS ({_BODIES}), held AS (SELECT DISTINCT r.bin, to_addr, from_addr AS ref_addr, func FROM r JOIN f ON r.bin = f.bin AND from_addr BETWEEN entry AND end_addr),
  loose AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.bin = r.bin AND h.ref_addr = r.from_addr)),
  hop AS (SELECT l.bin, l.to_addr, s.from_addr AS ref_addr FROM loose l JOIN r s ON s.bin = l.bin AND s.to_addr = l.from_addr)
  SELECT bin, to_addr, ref_addr, func, 'direct' AS ref_kind FROM held UNION SELECT h.bin, to_addr, ref_addr, func, 'pointer' FROM hop h JOIN f ON h.bin = f.bin AND ref_addr BETWEEN entry AND end_addr""")
def referring_functions(spark, sf_dir):
    return ranges.referring_functions(_in(spark, sf_dir, _POINTS), _in(spark, sf_dir, _BODIES), width=64)


_STRINGS = "SELECT user_id AS bin, event_id AS off, event_type AS s FROM events"


@query(f"SELECT bin, s AS name, off + 4096 AS str_addr FROM ({_STRINGS}) WHERE s IN ('view', 'error')")
def string_addresses(spark, sf_dir):
    return facts.string_addresses(_in(spark, sf_dir, _STRINGS), spark.createDataFrame([("view",), ("error",), ("absent",)], "name string"), 4096)


@query(f"""WITH f AS ({_BODIES}), r AS ({_POINTS}), s AS (SELECT user_id AS bin, event_id AS to_addr FROM events WHERE event_type = 'view'),
  found AS (SELECT r.bin, from_addr, func FROM r JOIN s USING (bin, to_addr) JOIN f ON f.bin = r.bin AND from_addr BETWEEN entry AND end_addr)
  SELECT bin, 'view' AS word, arg_min(func, from_addr) AS func FROM found GROUP BY bin""")
def similar_references(spark, sf_dir):
    """The function at the least reference to a string like a word; strings end in letters, so all are alike."""
    strings = _in(spark, sf_dir, "SELECT user_id AS bin, event_id AS str_addr, concat(event_type, 'er') AS s FROM events WHERE event_type <> 'error'")
    direct = _in(spark, sf_dir, f"SELECT r.* FROM ({_POINTS}) r JOIN ({_BODIES}) f ON r.bin = f.bin AND from_addr BETWEEN entry AND end_addr")
    return facts.similar_references(strings, ("view",), direct, _in(spark, sf_dir, _BODIES))


@query("""SELECT event_id AS call_addr, CASE WHEN event_id % 50 < 20 THEN concat('plt', event_id % 50) WHEN event_id % 50 < 35 THEN concat('sym', event_id % 50) END AS name FROM events""")
def resolved_symbols(spark, sf_dir):
    calls = _in(spark, sf_dir, "SELECT 0 AS bin, event_id AS call_addr, event_id % 50 AS target FROM events")
    linked = spark.range(20).selectExpr("0 AS bin", "id AS addr", "concat('plt', id) AS name")
    symbols = spark.range(35).selectExpr("0 AS bin", "id AS addr", "concat('sym', id) AS name")
    return facts.resolved_symbols(calls, linked, symbols).select("call_addr", "name")


_CASE_REFS = "SELECT user_id AS bin, event_id AS ref_addr FROM events WHERE event_type = 'click'"
_BLOCKS = "SELECT DISTINCT user_id AS bin, event_id - event_id % 64 AS block, event_id - event_id % 64 + 47 AS block_end FROM events"


@query(f"SELECT c.bin, ref_addr, block FROM ({_CASE_REFS}) c JOIN ({_BLOCKS}) b ON c.bin = b.bin AND ref_addr BETWEEN block AND block_end")
def entry_blocks(spark, sf_dir):
    return facts.entry_blocks(_in(spark, sf_dir, _CASE_REFS), _in(spark, sf_dir, _BLOCKS), width=64)


_USES = "SELECT user_id AS bin, event_id % 20 AS block, event_id AS idx, CASE event_type WHEN 'view' THEN 'load' WHEN 'click' THEN 'store' WHEN 'error' THEN 'add' ELSE 'move' END AS op, concat('v', CAST(floor(value) AS BIGINT) % 10) AS var FROM events"
_MARKS = "SELECT DISTINCT user_id AS bin, concat('v', CAST(floor(value) AS BIGINT) % 10) AS var FROM events WHERE event_id % 10 < 3"


@query(f"""WITH u AS ({_USES}), t AS ({_MARKS}), s AS (SELECT bin, block, min(idx) AS first_sum FROM u WHERE op = 'add' AND (bin, var) IN (SELECT (bin, var) FROM t) GROUP BY ALL)
  SELECT u.bin, u.block, idx, op FROM u JOIN s ON s.bin = u.bin AND s.block = u.block WHERE op IN ('load', 'store') AND idx > first_sum""")
def index_uses(spark, sf_dir):
    return facts.index_uses(_in(spark, sf_dir, _USES), _in(spark, sf_dir, _MARKS)).select("bin", "block", "idx", "op")


@query("SELECT user_id AS path, arg_max(event_type, event_id) AS func FROM events WHERE value < 400 GROUP BY user_id")
def wrapper_functions(spark, sf_dir):
    return facts.wrappers(_in(spark, sf_dir, "SELECT user_id AS path, event_id AS seq, event_type AS func, value < 400 AS tainted FROM events"))


_FUNCTIONS = "SELECT 0 AS bin, o_orderkey AS func, o_orderkey * 10 AS entry FROM orders"
_BEFORE = "SELECT 0 AS bin, l_orderkey AS func, CASE WHEN l_partkey % 2 = 0 THEN l_orderkey * 10 ELSE l_partkey END AS block_end FROM lineitem"


@query(f"""SELECT func FROM ({_FUNCTIONS}) f WHERE NOT EXISTS (SELECT 1 FROM (SELECT func, count(*) AS n, max(block_end) AS e FROM ({_BEFORE}) GROUP BY func) p WHERE p.func = f.func AND n = 1 AND e = entry)""")
def real_starts(spark, sf_dir):
    return facts.real_starts(_in(spark, sf_dir, _FUNCTIONS), _in(spark, sf_dir, _BEFORE)).select("func")


_GRAPH = "SELECT DISTINCT l_suppkey % 50 AS bin, concat('f', l_partkey % 30) AS caller, l_orderkey AS call_addr, CASE WHEN l_linenumber = 7 AND l_partkey % 5 = 0 THEN 'recv' WHEN l_linenumber = 6 AND l_partkey % 5 = 1 THEN 'strcmp' ELSE concat('f', l_orderkey % 30) END AS callee FROM lineitem"


@query(f"SELECT DISTINCT bin, caller, callee FROM ({_GRAPH}) e WHERE (bin, callee) IN (SELECT (bin, caller) FROM ({_GRAPH}) WHERE callee = 'recv')")
def two_hops(spark, sf_dir):
    return facts.two_hops(_in(spark, sf_dir, _GRAPH), ("recv",))


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT bin, caller, callee FROM ({_GRAPH})),
  n AS (SELECT DISTINCT bin, caller AS func, 0 AS d FROM e WHERE callee IN ('recv', 'read') UNION SELECT e.bin, caller, d + 1 FROM n JOIN e ON e.bin = n.bin AND e.callee = n.func WHERE d < {params.CALLER_LEVELS}),
  c AS (SELECT DISTINCT bin, caller AS func, 0 AS d FROM e WHERE callee = 'strcmp' UNION SELECT e.bin, caller, d + 1 FROM c JOIN e ON e.bin = c.bin AND e.callee = c.func WHERE d < {params.CALLER_LEVELS})
  SELECT DISTINCT bin, func FROM n WHERE (bin, func) IN (SELECT (bin, func) FROM c)""")
def connection_marks(spark, sf_dir):
    return units.connection_marks(_in(spark, sf_dir, _GRAPH))


@query("SELECT user_id AS bin, props AS s FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0 UNION SELECT user_id, concat('http_', event_type) FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0) AND event_type IN ('view', 'click')")
def seeds_or_http(spark, sf_dir):
    seeds = _in(spark, sf_dir, "SELECT user_id AS bin, props AS s FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0")
    return facts.seeds_or_http(seeds, _in(spark, sf_dir, "SELECT user_id AS bin, concat(CASE WHEN event_type IN ('view', 'click') THEN 'http_' ELSE 'x' END, event_type) AS s FROM events"))


@query("SELECT DISTINCT user_id AS bin, event_id * 16 AS base, CAST(floor(value) AS BIGINT) AS size FROM events WHERE event_type = 'view' AND event_id % 2 = 0")
def allocations(spark, sf_dir):
    calls = _in(spark, sf_dir, "SELECT user_id AS bin, 0 AS path, event_id AS call_addr, CAST(floor(value) AS BIGINT) AS size FROM events WHERE event_type = 'view'")
    return facts.allocations(calls, _in(spark, sf_dir, "SELECT user_id AS bin, 0 AS path, event_id AS call_addr, event_id * 16 AS base FROM events WHERE event_id % 2 = 0"))


# --- paths -----------------------------------------------------------------------------------------

_CHAIN = """SELECT p_partkey - p_partkey % 250 AS bin, p_partkey AS src, p_partkey + 1 AS dst FROM part WHERE p_partkey % 250 < 249
  UNION ALL SELECT p_partkey - p_partkey % 250, p_partkey, p_partkey + 3 FROM part WHERE p_partkey % 250 < 240 AND p_partkey % 60 = 0"""
_DEPTHS = f"""WITH RECURSIVE e AS ({_CHAIN}), r AS (SELECT DISTINCT bin, bin AS node, 0 AS depth FROM e UNION SELECT e.bin, dst, depth + 1 FROM r JOIN e ON e.bin = r.bin AND src = node)
  SELECT bin, node, min(depth) AS depth FROM r GROUP BY bin, node"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in(spark, sf_dir, _CHAIN)


@query(f"SELECT bin, node AS func FROM ({_DEPTHS})")
def deep_reach(spark, sf_dir):
    """Closure over chains of some 250 calls."""
    edges = _chain(spark, sf_dir).withColumnsRenamed({"src": "caller", "dst": "callee"})
    return graph.reachable(edges, edges.select("bin", F.col("bin").alias("func")))


@query(f"SELECT bin, node AS var, depth FROM ({_DEPTHS})")
def deep_taint(spark, sf_dir):
    flows = _chain(spark, sf_dir)
    return taint.tainted(flows, flows.select("bin", F.col("bin").alias("var")))


@query(f"SELECT bin, node AS var FROM ({_DEPTHS})")
def untainted_dependents(spark, sf_dir):
    links = _chain(spark, sf_dir).withColumnsRenamed({"src": "master", "dst": "slave"})
    return taint.dependents(links, links.select("bin", F.col("bin").alias("var")))


@query(f"SELECT node AS unit, depth FROM ({_DEPTHS})")
def unit_schedule(spark, sf_dir):
    edges = _chain(spark, sf_dir).select(F.col("src").alias("setter"), F.col("dst").alias("getter"), "bin")
    return units.schedule(edges, edges.select(F.col("bin").alias("unit")))


_CALL_CHAIN = """SELECT p_partkey - p_partkey % 50 AS bin, concat('f', p_partkey % 50) AS caller, p_partkey * 10 AS call_addr, CASE WHEN p_partkey % 50 = 49 THEN 'system' ELSE concat('f', p_partkey % 50 + 1) END AS callee FROM part
  UNION ALL SELECT p_partkey - p_partkey % 50, concat('f', p_partkey % 50), p_partkey * 10 + 1, concat('f', p_partkey % 50 + 4) FROM part WHERE p_partkey % 50 IN (3, 20, 35)"""


@query(f"""WITH RECURSIVE e AS ({_CALL_CHAIN}), p AS (SELECT bin, call_addr::VARCHAR AS hops, callee AS last, 1 AS calls FROM e WHERE caller = 'f0'
    UNION ALL SELECT p.bin, hops || ' ' || e.call_addr, e.callee, calls + 1 FROM p JOIN e ON e.bin = p.bin AND e.caller = p.last)
  SELECT bin, hops, calls FROM p WHERE last = 'system'""")
def deep_paths(spark, sf_dir):
    """Simple paths of some fifty calls to a command."""
    edges = _in(spark, sf_dir, _CALL_CHAIN)
    refs = edges.filter("caller = 'f0'").select("bin", F.lit("key").alias("param"), F.lit(0).cast("bigint").alias("str_addr"), F.col("caller").alias("func"), F.lit(0).cast("bigint").alias("ref_addr")).distinct()
    none = edges.select("bin", "call_addr", F.lit(0).alias("pos"), F.lit("").alias("const_str")).limit(0)
    paths = graph.sink_paths(edges, none, refs)
    return paths.select("bin", F.array_join(F.transform("path", lambda h: h["addr"].cast("string")), " ").alias("hops"), F.size("path").alias("calls"))


_UNIT_EDGES = """SELECT user_id AS bin, concat('h', event_id) AS caller, event_id * 10 + 1 AS call_addr, 'nvram_safe_set' AS callee FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT user_id, 'main', event_id * 10, concat('h', event_id) FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT user_id, concat('g', event_id), event_id * 10 + 2, 'nvram_safe_get' FROM events WHERE event_type = 'view'
  UNION ALL SELECT user_id, concat('g', event_id), event_id * 10 + 3, 'system' FROM events WHERE event_type = 'view' AND event_id % 3 = 0
  UNION ALL SELECT user_id, 'main', event_id * 10 + 4, concat('c', event_id) FROM events WHERE event_type = 'click'
  UNION ALL SELECT user_id, concat('c', event_id), event_id * 10 + 5, 'strcpy' FROM events WHERE event_type = 'click'"""
_UNIT_ARGS = """SELECT user_id AS bin, event_id * 10 + 1 AS call_addr, 0 AS pos, props AS const_str FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT user_id, event_id * 10 + 1, 1, 'fixed' FROM events WHERE event_type = 'purchase' AND event_id % 4 = 0
  UNION ALL SELECT user_id, event_id * 10 + 2, 0, props FROM events WHERE event_type = 'view'
  UNION ALL SELECT user_id, event_id * 10 + 5, 1, 'fixed' FROM events WHERE event_type = 'click' AND event_id % 4 = 0"""
_UNIT_REFS = "SELECT DISTINCT user_id AS bin, 'key' AS param, CAST(16 AS BIGINT) AS str_addr, 'main' AS func, CAST(0 AS BIGINT) AS ref_addr FROM events"


def _unit_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return saved(_in(spark, sf_dir, _UNIT_EDGES)), saved(_in(spark, sf_dir, _UNIT_ARGS)), saved(_in(spark, sf_dir, _UNIT_REFS))


@query("SELECT user_id AS bin, event_id * 10 + 5 AS sink FROM events WHERE event_type = 'click' AND event_id % 4 <> 0")
def overflow_paths(spark, sf_dir):
    paths = graph.sink_paths(*_unit_graph(spark, sf_dir), params.OVERFLOW_SINKS)
    return paths.select("bin", F.element_at("path", -1)["addr"].alias("sink"))


@query("SELECT user_id AS bin, count(*) AS paths, 1::BIGINT AS parameters, 1::BIGINT AS functions, count(*) AS sinks FROM events WHERE event_type = 'click' AND event_id % 4 <> 0 GROUP BY user_id")
def search_counters(spark, sf_dir):
    return reports.search_counters(graph.sink_paths(*_unit_graph(spark, sf_dir), params.OVERFLOW_SINKS))


@query("""SELECT concat('[Param "key"(0x10), Referenced at main : 0x0] >> 0x', lower(to_hex(event_id * 10 + 4)), ' >> c', event_id, ' >> 0x', lower(to_hex(event_id * 10 + 5)), ' -> strcpy') AS value
  FROM events WHERE event_type = 'click' AND event_id % 4 <> 0""")
def path_lines(spark, sf_dir):
    return graph.formatted(graph.sink_paths(*_unit_graph(spark, sf_dir), params.OVERFLOW_SINKS))


@query("SELECT count(*) AS sinks, 1::BIGINT AS parameters FROM events WHERE event_type = 'click' AND event_id % 4 <> 0")
def line_counters(spark, sf_dir):
    return stats.line_counters(graph.formatted(graph.sink_paths(*_unit_graph(spark, sf_dir), params.OVERFLOW_SINKS)))


@query("SELECT DISTINCT user_id AS bin FROM events WHERE event_type = 'click' AND event_id % 4 <> 0")
def sink_reachable(spark, sf_dir):
    return graph.sink_reachable(*_unit_graph(spark, sf_dir), params.OVERFLOW_SINKS).select("bin")


_SHARED = "SELECT props FROM events WHERE event_type = 'purchase' AND event_id % 4 <> 0"


@query(f"""SELECT 'path' AS kind, concat(user_id, ':', event_id * 10 + 1) AS item FROM events WHERE event_type = 'purchase' AND event_id % 4 <> 0
  UNION ALL SELECT 'share', concat('nvram_safe_set:', props) FROM (SELECT DISTINCT props FROM ({_SHARED}))""")
def shared_settings(spark, sf_dir):
    paths, shares = graph.shared_settings(*_unit_graph(spark, sf_dir))
    found = paths.select(F.lit("path").alias("kind"), F.concat_ws(":", F.col("bin").cast("string"), F.element_at("path", -1)["addr"].cast("string")).alias("item"))
    return found.union(shares.select(F.lit("share"), F.concat_ws(":", "func", "key")))


@query(f"SELECT user_id AS bin, props AS param, concat('g', event_id) AS func, event_id * 10 + 2 AS ref_addr FROM events WHERE event_type = 'view' AND props IN ({_SHARED})")
def share_references(spark, sf_dir):
    edges, args, refs = _unit_graph(spark, sf_dir)
    return graph.share_references(edges, args, graph.shared_settings(edges, args, refs)[1]).select("bin", "param", "func", "ref_addr")


@query(f"SELECT user_id AS bin, props AS param, concat('g', event_id) AS start_func, event_id * 10 + 3 AS sink FROM events WHERE event_type = 'view' AND event_id % 3 = 0 AND props IN ({_SHARED})")
def cross_unit_paths(spark, sf_dir):
    paths = graph.cross_unit_paths(*_unit_graph(spark, sf_dir))
    return paths.select("bin", "param", "start_func", F.element_at("path", -1)["addr"].alias("sink"))


# --- units -----------------------------------------------------------------------------------------

_GEN = "SELECT DISTINCT user_id AS unit, concat(event_type, '_') AS key FROM events WHERE event_id % 200 = 0"
_NAMED = "SELECT DISTINCT user_id AS unit, concat(event_type, CASE WHEN event_id % 2 = 0 THEN '_' ELSE '' END, props) AS key FROM events WHERE event_id % 5 = 0"


@query(f"SELECT DISTINCT k.unit, g.unit AS generator FROM ({_NAMED}) k JOIN ({_GEN}) g ON g.key = nullif(regexp_extract(k.key, '^([^_-]*[_-])', 1), '') WHERE k.unit <> g.unit")
def generated_edges(spark, sf_dir):
    return units.generated_edges(_in(spark, sf_dir, _GEN), _in(spark, sf_dir, _NAMED))




@query("""WITH RECURSIVE u AS (SELECT DISTINCT user_id AS unit, concat(props, event_type) AS key FROM events WHERE event_id % 9 = 0), s AS (SELECT min(key) AS key FROM u),
  r AS (SELECT DISTINCT u.unit FROM u JOIN s USING (key) UNION SELECT b.unit FROM r JOIN u a ON a.unit = r.unit JOIN u b ON b.key = a.key) SELECT unit, key FROM u WHERE unit IN (SELECT unit FROM r)""")
def discovered_roles(spark, sf_dir):
    uses = saved(_in(spark, sf_dir, "SELECT DISTINCT user_id AS unit, concat(props, event_type) AS key FROM events WHERE event_id % 9 = 0"))
    return units.discovered_roles(uses.agg(F.min("key").alias("key")), uses)


@query("""WITH RECURSIVE u AS (SELECT DISTINCT user_id AS unit, concat(event_type, event_id % 97, '_', event_id) AS key FROM events), k AS (SELECT unit, key, regexp_extract(key, '^([^_-]*[_-])', 1) AS p FROM u),
  r AS (SELECT DISTINCT unit FROM k WHERE p = 'view5_' UNION SELECT b.unit FROM r JOIN k a ON a.unit = r.unit JOIN k b ON b.p = a.p) SELECT unit, key FROM u WHERE unit IN (SELECT unit FROM r)""")
def prefix_roles(spark, sf_dir):
    uses = _in(spark, sf_dir, "SELECT DISTINCT user_id AS unit, concat(event_type, event_id % 97, '_', event_id) AS key FROM events")
    return units.discovered_roles(spark.createDataFrame([("view5_seed",)], "key string"), uses, by_prefix=True)


_EDGE = f"SELECT DISTINCT s.unit AS setter, g.unit AS getter FROM (SELECT DISTINCT user_id AS unit, props AS key FROM events WHERE event_type = 'purchase') s JOIN (SELECT DISTINCT user_id AS unit, props AS key FROM events WHERE event_type = 'view') g ON s.key = g.key WHERE s.unit < g.unit"


@query(f"""WITH p AS (SELECT DISTINCT user_id AS unit, props AS key FROM events WHERE event_type = 'purchase'), c AS (SELECT DISTINCT user_id AS unit, props AS key FROM events WHERE event_type = 'view')
  SELECT unit, key FROM c WHERE EXISTS (SELECT 1 FROM ({_EDGE}) e JOIN p ON p.unit = e.setter WHERE e.getter = c.unit AND p.key = c.key)""")
def child_keys(spark, sf_dir):
    uses = "SELECT DISTINCT user_id AS unit, props AS key FROM events WHERE event_type = '{}'"
    return units.child_keys(_in(spark, sf_dir, uses.format("view")), _in(spark, sf_dir, uses.format("purchase")))


_ROLE_USES = "SELECT user_id AS bin, concat('f', event_id % 40) AS func, CASE event_type WHEN 'view' THEN 'index_load' WHEN 'click' THEN 'index_store' WHEN 'error' THEN 'compare' WHEN 'signup' THEN 'copy_global' ELSE 'other' END AS kind, event_id % 2 = 0 AS in_loop, CAST(floor(value) AS BIGINT) % 5 AS arity FROM events"


@query(f"""SELECT DISTINCT bin, func, CASE kind WHEN 'index_store' THEN 'SETTER' WHEN 'index_load' THEN 'GETTER' WHEN 'copy_global' THEN 'SETTER' ELSE CASE WHEN arity > 2 THEN 'SETTER' ELSE 'GETTER' END END AS role
  FROM ({_ROLE_USES}) WHERE kind IN ('index_store', 'index_load', 'copy_global') OR (kind = 'compare' AND in_loop)""")
def semantic_roles(spark, sf_dir):
    return units.semantic_roles(_in(spark, sf_dir, _ROLE_USES))


_ROLES = "SELECT DISTINCT l_suppkey AS bin, concat('f', l_partkey % 30) AS func, l_linenumber % 3 AS pos FROM lineitem WHERE l_partkey % 30 < 5"
_ROLE_CALLS = "SELECT l_suppkey AS bin, 'c' AS caller, l_orderkey * 10 + l_linenumber AS call_addr, concat('f', l_partkey % 30) AS callee FROM lineitem"
_ROLE_ARGS = "SELECT l_suppkey AS bin, l_orderkey * 10 + l_linenumber AS call_addr, l_linenumber % 2 AS pos, concat('k', l_partkey, CASE WHEN l_partkey % 2 = 0 THEN ':%s' ELSE '' END) AS const_str FROM lineitem"


@query(f"""SELECT DISTINCT e.bin, split_part(const_str, ':%', 1) AS key FROM ({_ROLE_CALLS}) e JOIN ({_ROLES}) r ON r.bin = e.bin AND r.func = e.callee
  JOIN ({_ROLE_ARGS}) a ON a.bin = e.bin AND a.call_addr = e.call_addr AND a.pos = r.pos""")
def caller_keys(spark, sf_dir):
    return units.caller_keys(_in(spark, sf_dir, _ROLES), _in(spark, sf_dir, _ROLE_CALLS), _in(spark, sf_dir, _ROLE_ARGS))


_SHAPES = "SELECT p_partkey AS func, concat(CASE WHEN p_size % 10 = 0 THEN 'my_memcmp' ELSE 'f' END, p_partkey) AS name, p_size % 4 AS arity, p_partkey % 2 = 0 AS loop_compare, p_partkey % 3 = 0 AS loop_increment, p_size % 12 AS n_blocks FROM part"


@query(f"SELECT func FROM ({_SHAPES}) WHERE regexp_matches(name, '({'|'.join((*params.COMPARISONS, 'memcpy'))})') OR (arity BETWEEN 2 AND 3 AND loop_compare AND loop_increment AND n_blocks <= 8)")
def parser_like(spark, sf_dir):
    return units.parser_like(_in(spark, sf_dir, _SHAPES), F.col("name")).select("func")


@query("SELECT DISTINCT user_id AS bin, event_type AS role FROM events WHERE event_type <> 'error'")
def merged_roles(spark, sf_dir):
    rows = _in(spark, sf_dir, "SELECT user_id AS bin, CASE WHEN event_type = 'error' THEN 'UNKNOWN' ELSE event_type END AS role, event_id FROM events")
    return stats.merged_roles(rows.filter("event_id % 2 = 0").drop("event_id"), rows.filter("event_id % 3 <> 0").drop("event_id"), rows.drop("event_id"))


@query("SELECT event_id FROM events WHERE value >= 1.5 AND event_type <> 'error'")
def suspicious_sizes(spark, sf_dir):
    rows = _in(spark, sf_dir, "SELECT event_id, CASE WHEN event_type = 'error' THEN 4294967295 WHEN value >= 1.5 THEN 65536 + event_id ELSE 7 END AS size FROM events")
    return stats.suspicious_sizes(rows, "size").select("event_id")


@query("SELECT user_id AS bin, event_type AS kind, count(DISTINCT props) AS alerts FROM events GROUP BY ALL")
def alert_counts(spark, sf_dir):
    return stats.alert_counts(_in(spark, sf_dir, "SELECT user_id AS bin, event_type AS kind, props FROM events"), owner="bin", kind="kind", key=["props"])


# --- taint -----------------------------------------------------------------------------------------

_T_CALLS = """SELECT user_id AS bin, event_id AS call_addr, concat('f', event_id % 9) AS func, CASE event_id % 8 WHEN 0 THEN 'sprintf' WHEN 1 THEN 'strcpy' WHEN 2 THEN 'atoi' WHEN 3 THEN 'strncmp' WHEN 4 THEN 'setenv' WHEN 5 THEN 'getenv' WHEN 6 THEN 'fwrite' ELSE 'mystery' END AS callee,
  event_id % 16 AS block, event_id % 5 = 0 AS external FROM events"""
_T_ARGS = """SELECT user_id AS bin, event_id AS call_addr, 0 AS pos, concat('a', CAST(floor(value) AS BIGINT) % 12) AS var, true AS writable FROM events
  UNION ALL SELECT user_id, event_id, 1, concat('a', CAST(floor(value * 7) AS BIGINT) % 12), event_id % 2 = 0 FROM events
  UNION ALL SELECT user_id, event_id, 2, concat('a', CAST(floor(value * 13) AS BIGINT) % 12), true FROM events
  UNION ALL SELECT user_id, event_id, -1, concat('r', event_id), CAST(NULL AS BOOLEAN) FROM events"""
_T_SEEDS = "SELECT DISTINCT user_id AS bin, concat('a', user_id % 12) AS var FROM events UNION SELECT DISTINCT user_id, concat('a', user_id % 7) FROM events"
_T_KEYS = "SELECT user_id AS bin, event_id AS call_addr, event_type AS key FROM events"


def _calls_args(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _in(spark, sf_dir, _T_CALLS), _in(spark, sf_dir, _T_ARGS)


def _arg(n: int) -> str:
    return f"(SELECT bin, call_addr, var FROM ({_T_ARGS}) WHERE pos = {n})"


@query(f"""SELECT DISTINCT c.bin, s.var AS src, d.var AS dst FROM ({_T_CALLS}) c JOIN {_arg(1)} s USING (bin, call_addr) JOIN {_arg(0)} d USING (bin, call_addr) WHERE callee IN ('strcpy', 'sprintf')
  UNION SELECT DISTINCT c.bin, s.var, d.var FROM ({_T_CALLS}) c JOIN {_arg(2)} s USING (bin, call_addr) JOIN {_arg(0)} d USING (bin, call_addr) WHERE callee = 'sprintf'""")
def call_flows(spark, sf_dir):
    calls, args = _calls_args(spark, sf_dir)
    return taint.call_flows(calls, args, taint.table_of(spark, "summaries"))


@query(f"""SELECT DISTINCT s.bin, s.var AS src, g.var AS dst FROM (SELECT c.bin, key, var FROM ({_T_CALLS}) c JOIN {_arg(1)} USING (bin, call_addr) JOIN ({_T_KEYS}) USING (bin, call_addr) WHERE callee = 'setenv') s
  JOIN (SELECT c.bin, key, var FROM ({_T_CALLS}) c JOIN {_arg(-1)} USING (bin, call_addr) JOIN ({_T_KEYS}) USING (bin, call_addr) WHERE callee = 'getenv') g ON g.bin = s.bin AND g.key = s.key""")
def keyed_flows(spark, sf_dir):
    calls, args = _calls_args(spark, sf_dir)
    return taint.keyed_flows(calls, args, _in(spark, sf_dir, _T_KEYS), taint.table_of(spark, "summaries"))


@query(f"""SELECT DISTINCT c.bin, a.var AS src, r.var AS dst FROM ({_T_CALLS}) c JOIN ({_T_ARGS}) a USING (bin, call_addr) JOIN {_arg(-1)} r USING (bin, call_addr) WHERE callee = 'mystery' AND a.pos >= 0""")
def unfollowed_flows(spark, sf_dir):
    calls, args = _calls_args(spark, sf_dir)
    return taint.unfollowed_flows(calls, args, calls.filter("callee <> 'mystery'").select("bin", "call_addr"))


@query(f"""WITH off AS (SELECT bin, call_addr, call_addr % 3 = 0 AS used FROM ({_T_CALLS}) WHERE NOT external AND block >= 6)
  SELECT DISTINCT o.bin, a.var AS src, b.var AS dst FROM off o JOIN ({_T_ARGS}) a USING (bin, call_addr) JOIN ({_T_ARGS}) b USING (bin, call_addr)
  WHERE a.pos >= 0 AND a.var <> b.var AND ((used AND b.pos = -1) OR (NOT used AND b.pos >= 0 AND b.writable))""")
def unguided_flows(spark, sf_dir):
    calls, args = _calls_args(spark, sf_dir)
    traces = calls.filter("block < 6").select("bin", "block")
    return taint.unguided_flows(calls, args, traces, calls.filter("call_addr % 3 = 0").select("bin", "call_addr"))


@query(f"SELECT bin, call_addr FROM ({_T_CALLS}) WHERE block < 6")
def guided_calls(spark, sf_dir):
    calls, _ = _calls_args(spark, sf_dir)
    return taint.guided(calls, calls.filter("block < 6").select("bin", "block")).select("bin", "call_addr")


@query(f"""WITH s AS ({_T_SEEDS}), c AS ({_T_CALLS}), cmp AS (SELECT c.bin, a.var AS x, b.var AS y FROM c JOIN {_arg(0)} a USING (bin, call_addr) JOIN {_arg(1)} b USING (bin, call_addr) JOIN {_arg(2)} n USING (bin, call_addr)
    WHERE callee = 'strncmp' AND (c.bin, n.var) NOT IN (SELECT (bin, var) FROM s)), sides AS (SELECT bin, x AS var, y AS other FROM cmp UNION ALL SELECT bin, y, x FROM cmp)
  SELECT DISTINCT c.bin, a.var FROM c JOIN {_arg(0)} a USING (bin, call_addr) WHERE callee = 'atoi'
  UNION SELECT bin, var FROM sides WHERE (bin, var) IN (SELECT (bin, var) FROM s) AND (bin, other) NOT IN (SELECT (bin, var) FROM s)""")
def sanitized(spark, sf_dir):
    calls, args = _calls_args(spark, sf_dir)
    return taint.sanitized(calls, args, taint.table_of(spark, "summaries"), _in(spark, sf_dir, _T_SEEDS))


_GUARDS = "SELECT user_id AS bin, CASE event_id % 4 WHEN 0 THEN '==' WHEN 1 THEN '<=' WHEN 2 THEN 'xor' ELSE 'SGT' END AS op, concat('a', CAST(floor(value) AS BIGINT) % 12) AS lhs_var, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('a', event_id % 12) END AS rhs_var, CASE WHEN event_id % 3 = 0 THEN event_id % 2 END AS rhs_const FROM events"


@query(f"""WITH s AS ({_T_SEEDS}), g AS (SELECT * FROM ({_GUARDS}) WHERE op <> 'xor' AND coalesce(rhs_const <> 0, true)), sides AS (SELECT bin, lhs_var AS var, rhs_var AS other FROM g UNION ALL SELECT bin, rhs_var, lhs_var FROM g)
  SELECT DISTINCT bin, var FROM sides WHERE var IS NOT NULL AND (bin, var) IN (SELECT (bin, var) FROM s) AND (other IS NULL OR (bin, other) NOT IN (SELECT (bin, var) FROM s))""")
def guard_bounds(spark, sf_dir):
    return taint.bounded(_in(spark, sf_dir, _GUARDS), _in(spark, sf_dir, _T_SEEDS))


_FLAGS = "SELECT event_id, event_id % 11 = 0 AS never, event_id % 13 = 0 AS black, event_id % 7 = 0 AS external, event_id % 5 = 0 AS summarised, event_id % 3 = 0 AS white, event_id % 9 AS depth, event_id % 2 = 0 AS smart, value > 100 AS any_taint, value > 250 AS arg_taint FROM events"


@query(f"""SELECT event_id, CASE WHEN never OR black OR external OR summarised THEN false WHEN white THEN true WHEN depth >= {params.CALL_DEPTH} THEN false WHEN NOT smart THEN true WHEN NOT any_taint THEN false ELSE arg_taint END AS follow FROM ({_FLAGS})""")
def followed_calls(spark, sf_dir):
    return taint.followed_calls(_in(spark, sf_dir, _FLAGS)).select("event_id", "follow")


_POINTERS = "SELECT DISTINCT user_id AS bin, concat('a', event_id % 12) AS var, concat('a', CAST(floor(value) AS BIGINT) % 12) AS target FROM events WHERE event_id % 10 = 0"
_POINTING = f"(SELECT bin, var FROM ({_T_SEEDS}) UNION SELECT p.bin, p.var FROM ({_POINTERS}) p JOIN ({_T_SEEDS}) s ON s.bin = p.bin AND s.var = p.target)"


@query(f"SELECT bin, var FROM {_POINTING}")
def pointing(spark, sf_dir):
    return taint.pointing(_in(spark, sf_dir, _T_SEEDS), _in(spark, sf_dir, _POINTERS))


@query(f"SELECT DISTINCT c.bin, func, c.call_addr, pos FROM ({_T_CALLS}) c JOIN ({_T_ARGS}) a ON a.bin = c.bin AND a.call_addr = c.call_addr WHERE pos >= 0 AND (a.bin, a.var) IN (SELECT (bin, var) FROM {_POINTING})")
def tainted_callers(spark, sf_dir):
    calls, args = _calls_args(spark, sf_dir)
    return taint.tainted_callers(calls, args, _in(spark, sf_dir, _T_SEEDS), _in(spark, sf_dir, _POINTERS))


@query(f"""SELECT DISTINCT c.bin, c.call_addr, callee, CASE callee WHEN 'fwrite' THEN 'write' ELSE 'overflow' END AS class, pos FROM ({_T_CALLS}) c JOIN ({_T_ARGS}) a ON a.bin = c.bin AND a.call_addr = c.call_addr
  WHERE (a.bin, a.var) IN (SELECT (bin, var) FROM {_POINTING}) AND ((callee = 'fwrite' AND pos = 0) OR (callee = 'strcpy' AND pos = 1) OR (callee = 'sprintf' AND pos = 2 AND c.call_addr % 3 <> 0))""")
def pointer_alerts(spark, sf_dir):
    """Alerts through pointers; a format without directives has no later argument."""
    calls, args = _calls_args(spark, sf_dir)
    constants = calls.filter("callee = 'sprintf' AND call_addr % 3 < 2").select("bin", "call_addr", F.lit(1).alias("pos"), F.when(F.col("call_addr") % 3 == 0, "plain").otherwise("%s %d").alias("const_str"))
    return taint.alerts(
        calls, args, _in(spark, sf_dir, _T_SEEDS), taint.table_of(spark, "sinks"), classes=("command", "overflow", "write"),
        points_to=_in(spark, sf_dir, _POINTERS), formats=taint.directives(calls, constants),
    )


_JUMPS = "SELECT user_id AS bin, event_id % 9 AS func, event_id % 50 AS block, event_id * 7 % 50 AS succ, concat('a', event_id % 12) AS lhs_var, concat('a', CAST(floor(value) AS BIGINT) % 12) AS rhs_var FROM events"


@query(f"SELECT DISTINCT bin, func, block, succ FROM ({_JUMPS}) WHERE succ <= block AND (bin, lhs_var) IN (SELECT (bin, var) FROM ({_T_SEEDS})) AND (bin, rhs_var) IN (SELECT (bin, var) FROM ({_T_SEEDS}))")
def loop_alerts(spark, sf_dir):
    return taint.loop_alerts(_in(spark, sf_dir, _JUMPS), _in(spark, sf_dir, _T_SEEDS))


@query(f"""SELECT DISTINCT bin, call_addr FROM ({_T_ARGS}) a WHERE (bin, var) IN (SELECT (bin, var) FROM ({_T_SEEDS})) AND (bin, concat('a', call_addr % 12)) IN (SELECT (bin, var) FROM ({_T_SEEDS}))""")
def indirect_alerts(spark, sf_dir):
    calls, args = _calls_args(spark, sf_dir)
    through = calls.withColumn("target_var", F.concat(F.lit("a"), (F.col("call_addr") % 12).cast("string")))
    return taint.indirect_alerts(through, args, _in(spark, sf_dir, _T_SEEDS))


@query("SELECT count(DISTINCT p_name) AS names, count(DISTINCT p_name) AS addresses FROM part")
def surrogate_addresses(spark, sf_dir):
    found = taint.surrogate_addresses(_in(spark, sf_dir, "SELECT p_name AS symbol FROM part"))
    return found.agg(F.countDistinct("symbol").alias("names"), F.countDistinct("address").alias("addresses"))
