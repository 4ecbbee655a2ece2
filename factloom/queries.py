"""The registered queries: each operator applied to the driver's tables, with DuckDB SQL for the same rows.

The tables hold no firmware, so proxies stand in: pages for front-end files, documents for units with
strings, lineitem rows for calls, events for runs and key uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import devices, text
from .operators import graph, keywords, matching, ranges, ranking, stats, taint, units
from .operators.common import saved, scratch
from .sources import binstrings, reports, web
from .streaming import counts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    from . import fact_queries  # noqa: F401  it registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import fact_queries  # noqa: F401

    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- front end -------------------------------------------------------------------------------------

_ATTRS = """SELECT DISTINCT page_id, value FROM (
  SELECT page_id, unnest(list_concat(regexp_extract_all(html, 'href="([^\\n]*?)"', 1), regexp_extract_all(html, 'class="([^\\n]*?)"', 1))) AS value FROM pages)"""
_SEGMENTS = f"""SELECT DISTINCT page_id, name FROM (SELECT page_id, unnest(string_split(value, '/')) AS name FROM ({_ATTRS})) WHERE name <> ''"""
_LOOSE = "(length(name) > 3 AND NOT regexp_matches(name, '^[0-9]'))"
_STRICT = f"""({_LOOSE} AND length(name) BETWEEN 5 AND 24 AND name NOT LIKE '\\_%' ESCAPE '\\' AND
  NOT regexp_matches(name, '[ !@#$%^&*()\\-+{{}}\\[\\]:;''",.?/<>\\\\|，？！=]'))"""
_KEYWORDS = f"SELECT DISTINCT page_id, name FROM ({_SEGMENTS}) WHERE {_STRICT}"
_APIS = """SELECT DISTINCT page_id, regexp_replace(v, '\\?$', '') AS name FROM (
  SELECT page_id, regexp_replace(regexp_replace(value, '^\\s+', ''), '\\s+$', '') AS v FROM (""" + _ATTRS + """))
  WHERE length(v) >= 5 AND contains(v, '/') AND NOT regexp_matches(v, '[@^&*(){}\\[\\]:;,<>|，？ +.=]')"""


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.attributes(_t(spark, sf_dir, "pages"), ("href", "class"), key="page_id")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _attributes(spark, sf_dir).select("page_id", F.explode(F.split("value", "/")).alias("name"))
    return parts.filter("name <> ''").distinct()


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir).select("name", F.col("page_id").alias("path"), F.lit(True).alias("checked"))
    return keywords.accepted(rows)


def _apis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _attributes(spark, sf_dir).select("value", F.col("page_id").alias("path"), F.lit("JS").alias("source"))
    return keywords.api_names(rows)


@query(_ATTRS)
def kw_extract(spark, sf_dir):
    return _attributes(spark, sf_dir)


@query(f"SELECT DISTINCT name, {_LOOSE} AS loose, {_STRICT} AS strict FROM ({_SEGMENTS})")
def kw_filter(spark, sf_dir):
    name = F.col("name")
    return _segments(spark, sf_dir).select("name").distinct().select("name", text.keyword_ok(name, False).alias("loose"), text.keyword_ok(name).alias("strict"))


@query(f"SELECT DISTINCT name, page_id AS path FROM ({_APIS})")
def api_filter(spark, sf_dir):
    return _apis(spark, sf_dir).select("name", "path")


@query(f"SELECT name, count(DISTINCT page_id) AS places FROM ({_KEYWORDS}) GROUP BY name HAVING count(DISTINCT page_id) <= 10")
def kw_provenance(spark, sf_dir):
    return keywords.limited(_keywords(spark, sf_dir))


@query(f"SELECT name, count(DISTINCT page_id) AS places FROM ({_SEGMENTS}) WHERE {_LOOSE} GROUP BY name HAVING count(DISTINCT page_id) > 5")
def kw_removed(spark, sf_dir):
    rows = _segments(spark, sf_dir).select("name", F.col("page_id").alias("path"), F.lit(False).alias("checked"))
    return keywords.limited(keywords.accepted(rows), 5, keep=False)


@query(f"SELECT name, string_agg(DISTINCT page_id::VARCHAR, ' ' ORDER BY page_id::VARCHAR) AS files FROM ({_KEYWORDS}) GROUP BY name")
def kw_files(spark, sf_dir):
    found = keywords.provenance(_keywords(spark, sf_dir).withColumn("path", F.col("path").cast("string")))
    return found.select("name", F.array_join("text_files", " ").alias("files"))


@query(f"SELECT value AS script, count(DISTINCT page_id) AS pages FROM ({_ATTRS}) GROUP BY value HAVING count(DISTINCT page_id) < 5")
def citation_limit(spark, sf_dir):
    cited = _attributes(spark, sf_dir).select(F.col("value").alias("script"), F.col("page_id").alias("html_path"))
    scripts = cited.select(F.col("script").alias("name"), F.col("script").alias("path")).distinct()
    kept = keywords.analysed_scripts(scripts, cited).select(F.col("name").alias("script"))
    return keywords.citations(cited).join(kept, "script", "left_semi")


@query("""SELECT DISTINCT page_id, 'literal' AS kind, value FROM (SELECT page_id, unnest(list_concat(
  regexp_extract_all(s, '"([^"]*)"', 1), regexp_extract_all(s, '\\(([0-9]+)\\)', 1))) AS value FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<script>((?:.|\\n|\\r)+?)</script>', 1)) AS s FROM pages))""")
def script_literals(spark, sf_dir):
    scripts = _t(spark, sf_dir, "pages").select("page_id", F.explode(web.inline_scripts(F.col("html"))).alias("content"))
    return web.script_literals(scripts, key="page_id").distinct()


@query("""SELECT CASE WHEN lower(suffix) IN ('html','htm','shtml') THEN 'html' WHEN lower(suffix) = 'js' THEN 'js'
  WHEN lower(suffix) = 'xml' THEN 'xml' END AS kind, suffix, count(*) AS n FROM (
  SELECT string_split(string_split(url, '/')[-1], '.')[-1] AS suffix FROM pages) GROUP BY ALL""")
def file_kinds(spark, sf_dir):
    url = F.col("url")
    return _t(spark, sf_dir, "pages").select(text.file_kind(url).alias("kind"), text.suffix(url).alias("suffix")).groupBy("kind", "suffix").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS "values", sum(kept)::BIGINT AS values_kept, count(*) FILTER (WHERE kind = 'keyword') AS keywords,
  sum(CASE WHEN kind = 'keyword' THEN kept ELSE 0 END)::BIGINT AS keywords_kept, count(*) FILTER (WHERE kind = 'api') AS apis,
  sum(CASE WHEN kind = 'api' THEN kept ELSE 0 END)::BIGINT AS apis_kept FROM (
  SELECT 'keyword' AS kind, CASE WHEN """ + _STRICT + f""" THEN 1 ELSE 0 END AS kept FROM ({_SEGMENTS})
  UNION ALL SELECT 'api', CASE WHEN EXISTS (SELECT 1 FROM ({_APIS}) a WHERE a.page_id = v.page_id AND a.name = regexp_replace(v.value, '\\?$', '')) THEN 1 ELSE 0 END FROM ({_ATTRS}) v)""")
def step_totals(spark, sf_dir):
    words = _segments(spark, sf_dir).select(F.lit("keyword").alias("kind"), text.keyword_ok(F.col("name")).alias("kept"))
    values = _attributes(spark, sf_dir).select(F.lit("api"), text.api_name(F.col("value")).isNotNull())
    return keywords.totals(words.union(values))


@query(f"""SELECT api, string_agg(DISTINCT CASE WHEN k THEN part END, ' ' ORDER BY CASE WHEN k THEN part END) AS keywords,
  string_agg(DISTINCT CASE WHEN a THEN part END, ' ' ORDER BY CASE WHEN a THEN part END) AS actions FROM (
  SELECT DISTINCT api, part, part IN (SELECT name FROM ({_KEYWORDS})) AS k, part IN (SELECT p_type FROM part) AS a FROM (
    SELECT name AS api, unnest(string_split(name, '/')) AS part FROM ({_APIS}))) WHERE part <> '' AND (k OR a) GROUP BY api""")
def split_apis(spark, sf_dir):
    actions = _t(spark, sf_dir, "part").select(F.col("p_type").alias("name"))
    found = keywords.split_apis(_apis(spark, sf_dir), _keywords(spark, sf_dir), actions)
    joined = lambda c: F.nullif(F.array_join(c, " "), F.lit("")).alias(c)
    return found.select("api", joined("keywords"), joined("actions"))


# --- matching and ranking --------------------------------------------------------------------------

_IN_DOCS = f"SELECT DISTINCT source, name FROM documents JOIN (SELECT DISTINCT name FROM ({_KEYWORDS})) ON contains(text, name) WHERE NOT contains(text, '/')"
_DOC_SEGMENTS = f"""SELECT DISTINCT source, part AS name, text FROM (SELECT source, text, unnest(string_split(text, '/')) AS part FROM documents WHERE contains(text, '/'))
  WHERE part IN (SELECT name FROM ({_KEYWORDS}))"""
_API_WHOLE = f"SELECT DISTINCT source, name FROM documents JOIN (SELECT DISTINCT name FROM ({_APIS})) ON contains(text, name)"
_API_PARTS = f"""SELECT DISTINCT source, name, part FROM (SELECT DISTINCT source, part FROM documents JOIN (
    SELECT DISTINCT unnest(string_split(name, '/')) AS part FROM ({_APIS})) ON part <> '' AND contains(text, part))
  JOIN (SELECT DISTINCT name, unnest(string_split(name, '/')) AS part FROM ({_APIS})) USING (part)"""
_API_MATCH = f"""SELECT source, name, name AS match_str FROM ({_API_WHOLE})
  UNION ALL SELECT source, name, part FROM ({_API_PARTS}) p WHERE NOT EXISTS (SELECT 1 FROM ({_API_WHOLE}) w WHERE w.source = p.source AND w.name = p.name)"""


def _strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.col("source").alias("bin"), F.col("text").alias("s"))


@query(_IN_DOCS)
def match_contains(spark, sf_dir):
    plain = _strings(spark, sf_dir).filter(~F.contains("s", F.lit("/")))
    return matching.contains_pairs(plain, _keywords(spark, sf_dir)).withColumnRenamed("bin", "source")


@query("SELECT DISTINCT page_id, name, url AS full_str FROM (SELECT page_id, url, unnest(string_split(url, '/')) AS name FROM pages) WHERE name IN (SELECT lang FROM documents)")
def match_segment(spark, sf_dir):
    urls, names = _t(spark, sf_dir, "pages").select("page_id", "url"), _t(spark, sf_dir, "documents").select(F.col("lang").alias("name"))
    return matching.segment_pairs(urls, names, owner="page_id", s="url")


@query(_API_MATCH)
def match_fallback(spark, sf_dir):
    return matching.api_matches(_strings(spark, sf_dir), _apis(spark, sf_dir)).withColumnRenamed("bin", "source")


@query(f"""SELECT source, strings_count, keywords_count, functions_count FROM (
  SELECT source, count(*) AS strings_count FROM documents GROUP BY source) JOIN (
  SELECT source, count(DISTINCT name) FILTER (WHERE k = 0) AS keywords_count, count(DISTINCT name) FILTER (WHERE k = 1) AS functions_count FROM (
    SELECT source, name, 0 AS k FROM ({_IN_DOCS}) UNION ALL SELECT source, name, 0 FROM ({_DOC_SEGMENTS})
    UNION ALL SELECT source, name, 1 FROM ({_API_MATCH})) GROUP BY source) USING (source)
  WHERE keywords_count >= 10 AND functions_count >= 0 ORDER BY keywords_count DESC, functions_count DESC, source LIMIT 3""")
def border_rank(spark, sf_dir):
    """Which units share most with the front end: extraction, acceptance, matching, ranking."""
    strings, names, apis = _strings(spark, sf_dir), _keywords(spark, sf_dir), _apis(spark, sf_dir)
    found = matching.keyword_matches(strings, names)
    ranked = ranking.border_rank(strings, found, matching.api_matches(strings, apis), top=3)
    return ranked.withColumnRenamed("bin", "source")


@query("""SELECT DISTINCT p_name AS s, name FROM part JOIN (SELECT DISTINCT string_split(p_name, ' ')[-1] AS name FROM part) ON suffix(p_name, name)""")
def suffix_match(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    names = part.select(F.substring_index("p_name", " ", -1).alias("name"))
    return matching.terminated(part.select("p_name"), names, owner="p_name", s="p_name").select(F.col("p_name").alias("s"), "name")


@query("""SELECT name, contains(name, 'R') AND regexp_matches(replace(name, 'R', ''), '^([A-Za-z0-9]*|[A-Za-z0-9_]*|[A-Za-z0-9-]*)$') AS hit
  FROM (SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT o_orderpriority FROM orders UNION SELECT DISTINCT c_mktsegment FROM customer)""")
def similar_strings(spark, sf_dir):
    names = _t(spark, sf_dir, "part").select(F.col("p_type").alias("name"))
    names = names.union(_t(spark, sf_dir, "orders").select("o_orderpriority")).union(_t(spark, sf_dir, "customer").select("c_mktsegment")).distinct()
    return names.withColumn("hit", text.similar(F.col("name"), "R"))


@query("""SELECT page_id, tail, NOT starts_with(tail, '-') AND (regexp_matches(lower(tail), 'query_string|username|http_|remote_addr|boundary=|content-type|content-length|http|query|remote|user-agent|soap|index\\.')
  OR regexp_matches(tail, 'GET|POST|PUT|DELETE|HEAD')) AS hit FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS tail FROM pages)""")
def network_words(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("tail"))
    return rows.withColumn("hit", text.is_network_word(F.col("tail")))


_NAMES = """SELECT DISTINCT concat(CASE p_size % 6 WHEN 0 THEN 'set_' WHEN 1 THEN 'reGet' WHEN 2 THEN 'offset' WHEN 3 THEN 'getData' WHEN 4 THEN 'NVRAM_SET-' ELSE 'bread' END, p_brand) AS name FROM part"""


def _role_sql(words: tuple[str, ...]) -> str:
    """A word's first place counts if an end, a separator or a change of case borders it."""
    tests = []
    for w in words:
        at, n = f"instr(lower(name), '{w}')", len(w)
        after, before = f"substr(name, {at} + {n}, 1)", f"substr(name, {at} - 1, 1)"
        tests.append(
            f"({at} > 0 AND ({after} = '' OR regexp_matches({after}, '[_A-Z-]') OR {at} = 1 OR regexp_matches({before}, '[_-]')"
            f" OR (regexp_matches(substr(name, {at}, 1), '[A-Z]') AND regexp_matches({before}, '[a-z]'))))"
        )
    return " OR ".join(tests)


@query(f"SELECT name, {_role_sql(('set', 'insert', 'add', 'nvram_set'))} AS setter, {_role_sql(('get', 'read', 'nvram_get'))} AS getter FROM ({_NAMES})")
def role_names(spark, sf_dir):
    start = F.when(F.col("p_size") % 6 == 0, "set_").when(F.col("p_size") % 6 == 1, "reGet").when(F.col("p_size") % 6 == 2, "offset")
    start = start.when(F.col("p_size") % 6 == 3, "getData").when(F.col("p_size") % 6 == 4, "NVRAM_SET-").otherwise("bread")
    names = _t(spark, sf_dir, "part").select(F.concat(start, "p_brand").alias("name")).distinct()
    return names.select("name", text.is_setter(F.col("name")).alias("setter"), text.is_getter(F.col("name")).alias("getter"))


# --- strings ---------------------------------------------------------------------------------------

@query("SELECT DISTINCT doc_id AS bin, unnest(regexp_extract_all(text, '[\\t -~]{4,}')) AS s FROM documents")
def printable_strings(spark, sf_dir):
    return binstrings.strings(_t(spark, sf_dir, "documents"), key="doc_id", content="text")


@query("""SELECT doc_id, nullif(CASE WHEN length(m) >= 3 THEN m ELSE '' END, '') AS decoded FROM (
  SELECT doc_id, regexp_extract(substr(text, 1, 255), '^[0-9A-Za-z_/\\-]*') AS m FROM documents)""")
def memory_strings(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.memory_string(F.col("text"), extended=False).alias("decoded"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(text, '%%|%[^%]'), lambda x: x <> '%%'))::BIGINT AS directives FROM documents")
def format_directives(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(text.format_specifiers(F.col("text"))).cast("bigint").alias("directives"))


@query("""SELECT o_orderkey, concat('0x', lower(to_hex(o_orderkey))) AS hex, o_orderkey AS back, o_orderkey + 4128768 AS rebased FROM orders""")
def addresses(spark, sf_dir):
    key = F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select(key, text.hex_address(key).alias("hex"), text.address(text.hex_address(key)).alias("back"), text.rebased(key).alias("rebased"))


@query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_partkey))), ',') AS guards FROM lineitem GROUP BY l_orderkey")
def guard_hashes(spark, sf_dir):
    groups = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("g"))
    return groups.select("l_orderkey", text.guard_hash(F.col("g")).alias("guards"))


# --- call graphs -----------------------------------------------------------------------------------

_CALLS = """SELECT l_orderkey AS bin, l_orderkey * 10 + l_linenumber AS call_addr, min(l_suppkey) AS s, min(l_partkey) AS p,
  CASE min(l_returnflag) WHEN 'A' THEN 'system' WHEN 'N' THEN 'strcpy' ELSE 'sprintf' END AS callee,
  min(l_tax) AS tax, min(l_discount) AS discount, min(l_linestatus) AS status FROM lineitem GROUP BY l_orderkey, l_linenumber"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("bin"), "l_linenumber").agg(
        F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("flag"),
        F.min("l_tax").alias("tax"), F.min("l_discount").alias("discount"), F.min("l_linestatus").alias("status"),
    )
    callee = F.when(F.col("flag") == "A", "system").when(F.col("flag") == "N", "strcpy").otherwise("sprintf")
    return rows.select("bin", F.lit("f").alias("caller"), (F.col("bin") * 10 + F.col("l_linenumber")).alias("call_addr"), callee.alias("callee"), "s", "p", "tax", "discount", "status")


def _args(calls: DataFrame) -> DataFrame:
    constants = F.array(
        F.struct(F.lit(0).alias("pos"), F.when(F.col("status") == "O", "o").alias("const_str")),
        F.struct(F.lit(1).alias("pos"), F.when(F.col("tax") < 0.04, "fmt %s %d").alias("const_str")),
        F.struct(F.lit(2).alias("pos"), F.when(F.col("discount") < 0.05, "k").alias("const_str")),
    )
    rows = calls.select("bin", "call_addr", F.explode(constants).alias("a"))
    return rows.select("bin", "call_addr", "a.pos", "a.const_str").filter("const_str IS NOT NULL")


@query(f"""SELECT bin, call_addr FROM ({_CALLS}) WHERE (callee = 'system' AND status = 'O') OR (callee = 'strcpy' AND tax < 0.04)
  OR (callee = 'sprintf' AND tax < 0.04 AND discount < 0.05)""")
def harmless_calls(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    return graph.harmless_calls(calls, _args(calls))


@query(f"""SELECT bin, call_addr, bool_or(callee IN ('strcpy', 'sprintf') AND NOT ((callee = 'strcpy' AND tax < 0.04) OR (callee = 'sprintf' AND tax < 0.04 AND discount < 0.05)))
  OVER (PARTITION BY bin ORDER BY call_addr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS digest FROM ({_CALLS})""")
def digest_flags(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    edges = calls.select("bin", "caller", "call_addr", "callee")
    return graph.digest_flags(edges, graph.harmless_calls(calls, _args(calls))).select("bin", "call_addr", "digest")


_FUNCS = """SELECT l_orderkey AS bin, 'f' || l_suppkey AS caller, l_orderkey * 10 + l_linenumber AS call_addr, 'f' || min((l_partkey % 100) + 1) AS callee
  FROM lineitem GROUP BY l_orderkey, l_suppkey, l_linenumber"""
_SINKS = tuple(f"f{n}" for n in range(7, 101, 10))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("bin"), "l_suppkey", "l_linenumber").agg(F.min(F.col("l_partkey") % 100 + 1).alias("to"))
    named = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"))
    return rows.select("bin", named("l_suppkey").alias("caller"), (F.col("bin") * 10 + F.col("l_linenumber")).alias("call_addr"), named("to").alias("callee"))


_DAY = "strftime(l_shipdate, '%Y%m%d')::BIGINT"


def _day(c: str) -> Column:
    return F.date_format(c, "yyyyMMdd").cast("bigint")


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT {_DAY} AS bin, l_suppkey AS f, (l_partkey % 100) + 1 AS c FROM lineitem),
  r AS (SELECT bin, min(f) AS func FROM e GROUP BY bin UNION SELECT e.bin, e.c FROM r JOIN e ON e.bin = r.bin AND e.f = r.func) SELECT bin, func FROM r""")
def reach(spark, sf_dir):
    edges = _t(spark, sf_dir, "lineitem").select(_day("l_shipdate").alias("bin"), F.col("l_suppkey").alias("caller"), (F.col("l_partkey") % 100 + 1).alias("callee"))
    return graph.reachable(edges, edges.groupBy("bin").agg(F.min("caller").alias("func")))


@query(f"""WITH RECURSIVE e AS ({_FUNCS}), ref AS (SELECT bin, min(caller) AS start FROM e GROUP BY bin),
  p AS (SELECT e.bin, start, [callee] AS path, call_addr || ':' || callee AS hops, callee AS last FROM ref JOIN e ON e.bin = ref.bin AND e.caller = start WHERE callee <> start
    UNION ALL SELECT p.bin, start, list_append(path, e.callee), hops || ' ' || e.call_addr || ':' || e.callee, e.callee FROM p JOIN e ON e.bin = p.bin AND e.caller = p.last
    WHERE NOT regexp_matches(p.last, '^f[0-9]?7$') AND e.callee <> start AND NOT list_contains(path, e.callee))
  SELECT bin, start AS start_func, hops FROM p WHERE regexp_matches(last, '^f[0-9]?7$')""")
def sink_paths(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    starts = edges.groupBy("bin").agg(F.min("caller").alias("func"))
    refs = starts.select("bin", F.lit("key").alias("param"), F.lit(0).cast("bigint").alias("str_addr"), "func", F.lit(0).cast("bigint").alias("ref_addr"))
    none = edges.select("bin", "call_addr", F.lit(0).alias("pos"), F.lit("").alias("const_str")).limit(0)
    paths = graph.sink_paths(edges, none, refs, _SINKS)
    hops = F.array_join(F.transform("path", lambda h: F.concat_ws(":", h["addr"].cast("string"), h["callee"])), " ")
    return paths.select("bin", "start_func", hops.alias("hops"))


@query("""WITH u AS (SELECT l_suppkey AS func, l_linenumber AS callee, p_name || '_' || l_partkey AS name, p_size = 1 AS target, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey),
  c AS (SELECT func, callee FROM u WHERE target GROUP BY ALL HAVING count(*) >= 4)
  SELECT DISTINCT func, name FROM u JOIN c USING (func, callee) WHERE NOT target""")
def heuristic_params(spark, sf_dir):
    item, part = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part")
    name = F.concat_ws("_", "p_name", F.col("p_partkey").cast("string"))
    rows = item.join(part, item["l_partkey"] == part["p_partkey"]).select(
        F.lit(0).alias("bin"), F.col("l_suppkey").alias("caller"), F.col("l_linenumber").cast("string").alias("callee"), name.alias("name"), "p_size",
    ).groupBy("bin", "caller", "callee", "name", "p_size").agg(F.count("*").alias("n"))
    rows = saved(rows.withColumn("call", F.monotonically_increasing_id()))
    calls = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).withColumn("call_addr", F.col("call") * 1000 + F.col("k"))
    args = calls.select("bin", "call_addr", F.lit(0).alias("pos"), F.col("name").alias("const_str"))
    found = graph.new_parameters(calls.select("bin", "caller", "call_addr", "callee"), args, rows.filter("p_size = 1").select("name"))
    return found.select("func", "name")


@query("""SELECT l_orderkey AS str_addr, l_suppkey AS ref_addr, array_to_string(list_sort(list_distinct(list(l_partkey))), ' ') AS trace,
  array_to_string(list_sort(list_distinct(list(l_linenumber::BIGINT))), ' ') AS sinks FROM lineitem GROUP BY l_orderkey, l_suppkey""")
def path_merge(spark, sf_dir):
    at = lambda c: text.hex_address(F.col(c).cast("bigint"))
    line = F.concat(
        F.lit('[Param "'), "l_returnflag", "l_linestatus", F.lit('"('), at("l_orderkey"), F.lit("), Referenced at f : "), at("l_suppkey"),
        F.lit("] >> "), at("l_partkey"), F.lit(" -> g >> "), at("l_linenumber"), F.lit(" -> system"),
    )
    cases = reports.merged_cases(reports.kept_lines(reports.path_lines(_t(spark, sf_dir, "lineitem").select(line.alias("value")))))
    return cases.select("str_addr", "ref_addr", F.array_join("trace", " ").alias("trace"), F.array_join("sinks", " ").alias("sinks"))


@query("""WITH e AS (SELECT l_linenumber % 4 AS s, l_suppkey % 4 AS d, count(*) AS n FROM lineitem GROUP BY ALL)
  SELECT a.s::BIGINT AS start, c.d::BIGINT AS "end", sum(a.n * b.n * c.n)::HUGEINT::DOUBLE AS paths FROM e a JOIN e b ON a.d = b.s JOIN e c ON b.d = c.s GROUP BY ALL""")
def path_counts(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.lit(0).alias("bin"), (F.col("l_linenumber") % 4).cast("bigint").alias("caller"), (F.col("l_suppkey") % 4).cast("bigint").alias("callee"))
    return graph.path_counts(rows, 3).select("start", "end", F.col("paths").cast("double").alias("paths"))


# --- ranges and order ------------------------------------------------------------------------------

@query("""SELECT e.event_id, p.event_id AS span_id FROM events e JOIN events p ON p.event_type = 'purchase' AND e.user_id = p.user_id AND e.event_id BETWEEN p.event_id AND p.event_id + 500""")
def range_owner(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("event_id", "user_id")
    spans = _t(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span_id"))
    found = ranges.within(events, spans, at=F.col("event_id"), low=F.col("span_id"), high=F.col("span_id") + 500, width=512, by=["user_id"])
    return found.select("event_id", "span_id")


@query("""SELECT e.event_id, p.event_id AS base, p.value AS size FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
  ON e.user_id = p.user_id AND e.event_id >= p.event_id WHERE e.event_type = 'view'""")
def nearest_base(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    views = events.filter("event_type = 'view'").select("event_id", "user_id")
    bases = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("base"), F.col("value").alias("size"))
    return ranges.latest_before(views, bases, at="event_id", base="base", value="size", by=["user_id"]).select("event_id", "base", "size")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS port FROM events""")
def last_port(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("seen", F.when(F.col("event_type") == "purchase", F.col("value")))
    return stats.last_value(rows, by=["user_id"], order=["event_id"], value="seen", out="port").select("event_id", "port")


@query("""SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS n FROM events) WHERE n <= 2""")
def back_jumps(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("path"), F.col("event_id").alias("seq"), F.col("event_type").alias("guards"), F.col("props").alias("source"), F.lit(0).alias("target"))
    return taint.limited_jumps(rows).select("event_id")


@query("""SELECT l_orderkey, l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - l_partkey AS size FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)""")
def variable_sizes(spark, sf_dir):
    return stats.variable_sizes(_t(spark, sf_dir, "lineitem"), owner=["l_orderkey"], offset="l_partkey")


# --- scores and statistics -------------------------------------------------------------------------

@query("""WITH b AS (SELECT l_suppkey AS bin, l_linenumber AS func, l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY ALL),
  s AS (SELECT bin, func, count(*) AS n_blocks, count(*) FILTER (WHERE n > 1) AS n_branch FROM b GROUP BY ALL),
  c AS (SELECT l_suppkey AS bin, l_linenumber AS func, count(DISTINCT l_orderkey) AS n_memcmp FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
  SELECT bin, round(max((n_blocks * 0.5 + n_branch * 0.4 + n_memcmp * 0.7) * CASE WHEN func = 1 THEN 2.0 ELSE 1.0 END)::DOUBLE, 6) AS score
  FROM s JOIN c USING (bin, func) WHERE n_branch > 0 GROUP BY bin""")
def parsing_scores(spark, sf_dir):
    item = _t(spark, sf_dir, "lineitem")
    func = (F.col("l_suppkey").alias("bin"), F.col("l_linenumber").alias("func"))
    blocks = item.select(*func, F.col("l_partkey").alias("block"), F.col("l_orderkey").alias("succ"))
    compares = item.filter("l_returnflag = 'R'").select(*func, F.col("l_orderkey").alias("call_addr"))
    found = stats.function_stats(blocks, compares).withColumn("net_marks", F.lit(0)).withColumn("net_checked", F.col("func") == 1)
    return ranking.parsing_scores(found).select("bin", F.round("score", 6).alias("score"))


@query("""WITH r AS (SELECT s_suppkey, s_acctbal, row_number() OVER w AS n, lag(s_acctbal) OVER w - s_acctbal AS step, count(*) OVER () AS c FROM supplier WINDOW w AS (ORDER BY s_acctbal DESC, s_suppkey)),
  k AS (SELECT *, max(CASE WHEN step > 25 AND n > 5 THEN 1 ELSE 0 END) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS past FROM r)
  SELECT s_suppkey, s_acctbal FROM k WHERE CASE WHEN c < 5 THEN n = 1 ELSE past = 0 END""")
def score_cluster(spark, sf_dir):
    return ranking.first_cluster(_t(spark, sf_dir, "supplier"), owner="s_suppkey", score="s_acctbal", gap=25.0)


@query("SELECT user_id, max(coalesce(CASE WHEN event_type <> 'error' OR value < 490 THEN floor(value)::BIGINT END, 4294967295)) AS max_size FROM events GROUP BY user_id")
def max_size(spark, sf_dir):
    size = F.when((F.col("event_type") != "error") | (F.col("value") < 490), F.floor("value").cast("bigint"))
    return stats.largest_buffer(_t(spark, sf_dir, "events").withColumn("size", size), owner="user_id", size="size")


_TYPES = ["view", "click", "purchase", "signup", "error"]


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{c}') AS {c}_all, count(DISTINCT props) FILTER (WHERE event_type = '{c}') AS {c}_keys" for c in _TYPES) + " FROM events GROUP BY user_id")
def channel_stats(spark, sf_dir):
    return stats.channel_stats(_t(spark, sf_dir, "events"), owner="user_id", channel="event_type", key="props", channels=_TYPES)


@query("""SELECT event_type, count(*) AS n_runs, count(*) FILTER (WHERE value > 400) AS n_timeouts, sum(user_id)::BIGINT AS visited,
  round(avg(value), 6) AS avg_seconds, round(avg(user_id), 6) AS avg_visited FROM events GROUP BY event_type""")
def run_stats(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("late", F.col("value") > 400)
    found = stats.run_stats(rows, owner="event_type", seconds="value", blocks="user_id", timed_out="late")
    return found.withColumns({c: F.round(c, 6) for c in ("avg_seconds", "avg_visited")})


@query("""WITH a AS (SELECT DISTINCT event_type, props FROM events WHERE value < 100), b AS (SELECT DISTINCT event_type, props FROM events WHERE value >= 100)
  SELECT event_type, count(*) FILTER (WHERE x AND y) AS "both", count(*) FILTER (WHERE x AND NOT y) AS only_a, count(*) FILTER (WHERE y AND NOT x) AS only_b FROM (
    SELECT coalesce(a.event_type, b.event_type) AS event_type, a.props IS NOT NULL AS x, b.props IS NOT NULL AS y FROM a FULL JOIN b ON a.event_type = b.event_type AND a.props = b.props) GROUP BY event_type""")
def set_compare(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    return stats.compared(events.filter("value < 100"), events.filter("value >= 100"), group="event_type", key="props")


@query("SELECT DISTINCT o_orderpriority, o_custkey FROM orders WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderstatus = 'O' AND p.o_custkey = orders.o_custkey AND p.o_orderpriority = orders.o_orderpriority)")
def line_difference(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    pick = lambda s: orders.filter(F.col("o_orderstatus") == s).select("o_orderpriority", "o_custkey")
    return stats.only_in(pick("F"), pick("O"), ["o_orderpriority", "o_custkey"])


@query("""SELECT n, found, CASE WHEN n = found THEN '1' ELSE printf('%.2f', found / (n - found)) END AS ratio FROM (
  SELECT count(*) AS n, count(*) FILTER (WHERE p_name IN (SELECT p_name FROM part WHERE p_size > 45)) AS found FROM (SELECT DISTINCT p_name FROM part))""")
def coverage(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    return ranking.coverage(part, part.filter("p_size > 45"), "p_name")


@query("SELECT p_name, count(*) AS n FROM part WHERE NOT list_has_any(string_split(p_name, '.'), ['so', 'ko']) GROUP BY p_name ORDER BY n DESC, p_name LIMIT 5")
def top_names(spark, sf_dir):
    return ranking.named_top(_t(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n")), name="p_name")


@query("SELECT row_number() OVER (ORDER BY p_name) AS number, p_name FROM (SELECT DISTINCT p_name FROM part WHERE regexp_matches(p_name, '(ring|gear)'))")
def server_names(spark, sf_dir):
    return ranking.server_names(_t(spark, sf_dir, "part"), name="p_name", pattern="(ring|gear)")


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN k BETWEEN 0 AND 255 WHEN 'click' THEN k BETWEEN -128 AND 127 WHEN 'error' THEN k IN (0, 1)
  WHEN 'purchase' THEN regexp_matches(value::VARCHAR, '^[0-9]+$') WHEN 'signup' THEN k < 10 END AS ok FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)""")
def value_checks(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    kind = F.when(F.col("event_type") == "view", "ui1").when(F.col("event_type") == "click", "i1").when(F.col("event_type") == "error", "boolean")
    kind = kind.when(F.col("event_type") == "purchase", "ui2").otherwise("char")
    value = F.when(F.col("event_type") == "purchase", F.col("value").cast("string")).otherwise(k)
    return _t(spark, sf_dir, "events").select("event_id", devices.valid(value, kind).alias("ok"))


# --- units that share keys -------------------------------------------------------------------------

_KEY = "props || strftime(ts, '%Y%m%d')"
_SETS = f"SELECT DISTINCT user_id AS unit, {_KEY} AS key FROM events WHERE event_type = 'purchase'"
_GETS = f"SELECT DISTINCT user_id AS unit, {_KEY} AS key FROM events WHERE event_type = 'view'"


def _uses(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    return rows.select(F.col("user_id").alias("unit"), F.concat("props", F.date_format("ts", "yyyyMMdd")).alias("key"))


@query(f"SELECT s.unit AS setter, g.unit AS getter, count(*) AS keys FROM ({_SETS}) s JOIN ({_GETS}) g ON s.key = g.key AND s.unit <> g.unit GROUP BY ALL")
def shared_keys(spark, sf_dir):
    return units.key_edges(_uses(spark, sf_dir, "purchase"), _uses(spark, sf_dir, "view"))


@query(f"""WITH s AS ({_SETS}), g AS ({_GETS}), e AS (SELECT DISTINCT s.unit AS a, g.unit AS b FROM s JOIN g ON s.key = g.key AND s.unit <> g.unit),
  u AS (SELECT unit FROM s UNION SELECT unit FROM g), f AS (SELECT unit, unit IN (SELECT unit FROM s) AS sets, unit IN (SELECT unit FROM g) AS gets,
    unit IN (SELECT a FROM e) AS up, unit IN (SELECT b FROM e) AS down FROM u)
  SELECT unit, sets, gets, NOT gets AS is_root, NOT up AND NOT down AS is_orphan, NOT up AS is_leaf,
    CASE WHEN NOT up THEN 'GETTER' WHEN NOT gets THEN 'SETTER' ELSE 'SETTER_GETTER' END AS role FROM f""")
def unit_roles(spark, sf_dir):
    return units.key_roles(_uses(spark, sf_dir, "purchase"), _uses(spark, sf_dir, "view"))


@query("""SELECT DISTINCT bin, func, key, CASE rank WHEN 0 THEN 'environment' WHEN 2 THEN 'file' ELSE 'socket' END AS channel,
  CASE WHEN callee IN ('setenv', 'fprintf', 'send') THEN 'SETTER' ELSE 'GETTER' END AS role FROM (
  SELECT *, row_number() OVER (PARTITION BY bin, func, key ORDER BY rank, CASE WHEN callee IN ('setenv', 'fprintf', 'send') THEN 2 ELSE 1 END) AS n FROM (
    SELECT user_id AS bin, event_type AS func, props AS key, CASE floor(value)::INT % 6 WHEN 0 THEN 'setenv' WHEN 1 THEN 'getenv' WHEN 2 THEN 'fprintf' WHEN 3 THEN 'memcmp' WHEN 4 THEN 'send' ELSE 'recv' END AS callee,
      CASE WHEN floor(value)::INT % 6 < 2 THEN 0 WHEN floor(value)::INT % 6 < 4 THEN 2 ELSE 3 END AS rank FROM events WHERE value < 300)) WHERE n = 1""")
def channel_roles(spark, sf_dir):
    six = F.floor("value").cast("int") % 6
    callee = F.when(six == 0, "setenv").when(six == 1, "getenv").when(six == 2, "fprintf").when(six == 3, "memcmp").when(six == 4, "send").otherwise("recv")
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("bin"), F.col("event_type").alias("func"), F.col("props").alias("key"), callee.alias("callee"), (F.col("value") < 300).alias("tainted"))
    return units.channel_roles(rows)


# --- taint -----------------------------------------------------------------------------------------

_FLOWS = f"SELECT DISTINCT {_DAY} AS bin, l_suppkey AS src, (l_partkey % 100) + 1 AS dst FROM lineitem"


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem")
    return rows.select(_day("l_shipdate").alias("bin"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100 + 1).alias("dst")).distinct()


def _tainted(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = _flows(spark, sf_dir)
    seeds = flows.groupBy("bin").agg(F.min("src").alias("var"))
    clean = flows.select("bin", F.col("dst").alias("var")).filter("var % 7 = 0")
    return taint.tainted(flows, seeds, clean)


_TAINTED = f"""WITH RECURSIVE f AS ({_FLOWS}), g AS (SELECT bin, min(src) AS var FROM f GROUP BY bin),
  r AS (SELECT bin, var, 0 AS depth FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.bin = g.bin AND f.dst = g.var AND f.dst % 7 = 0)
  UNION SELECT f.bin, f.dst, depth + 1 FROM r JOIN f ON f.bin = r.bin AND f.src = r.var WHERE f.dst % 7 <> 0 AND depth < 50)
  SELECT bin, var, min(depth) AS depth FROM r GROUP BY bin, var"""


@query(_TAINTED)
def taint_fixpoint(spark, sf_dir):
    return _tainted(spark, sf_dir)


@query(f"""SELECT DISTINCT {_DAY} AS bin, l_orderkey * 10 + l_linenumber AS call_addr, 'system' AS callee, 'command' AS class, 0 AS pos FROM lineitem
  JOIN ({_TAINTED}) t ON t.bin = {_DAY} AND t.var = l_suppkey WHERE l_linestatus = 'O'""")
def taint_alerts(spark, sf_dir):
    calls = _t(spark, sf_dir, "lineitem").select(
        _day("l_shipdate").alias("bin"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_addr"),
        F.when(F.col("l_linestatus") == "O", "system").otherwise("puts").alias("callee"), F.col("l_suppkey").alias("var"),
    )
    plain = calls.filter("callee = 'system'").select("bin", "call_addr", "callee")
    own = calls.filter("callee = 'system'").select("bin", "call_addr", F.lit(0).alias("pos"), "var")
    return taint.alerts(plain.distinct(), own.distinct(), _tainted(spark, sf_dir), taint.table_of(spark, "sinks"))


# --- streaming (an extension) ----------------------------------------------------------------------

@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/events.parque[t]")
    where = scratch(spark, "stream")
    # event times carry no zone, as the tables' do
    found = counts.windowed(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    out = counts.drained(spark, found, f"{where}/out", f"{where}/state", keys=["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
