"""The three analyses as plans over shared tables, without files between their stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..operators import graph, keywords, matching, ranking, taint
from ..operators.common import saved
from ..sources import binstrings, files, reports, web


@dataclass(frozen=True)
class FrontEnd:
    """keywords(name, path), apis(name, path, source) and the names removed."""

    keywords: DataFrame
    apis: DataFrame
    removed: DataFrame
    skipped_scripts: DataFrame


def front_end(tree: DataFrame, *, most_files: int = params.MOST_TEXT_FILES) -> FrontEnd:
    """Names from pages (html, asp, php), scripts that few pages cite, inline scripts and protocol files."""
    text = tree.select("path", "name", "kind", "suffix", files.readable(F.col("content")).alias("content"))
    pages = text.filter((F.col("kind") == "html") | F.col("suffix").isin("asp", "php")).select("path", F.col("content").alias("html"))
    cited = web.script_references(pages)
    scripts = text.filter("kind = 'js'")
    used = keywords.analysed_scripts(scripts, cited)
    inline = pages.select("path", F.explode(web.inline_scripts(F.col("html"))).alias("content"))
    literals = web.script_literals(used.select("path", "content").union(inline))
    tags = web.protocol_tags(text.filter("kind = 'xml'"))
    strict = F.lit(True)
    seen = web.attributes(pages).select(F.col("value").alias("name"), "path", (~strict).alias("checked"))
    seen = seen.union(literals.filter("kind = 'literal'").select("value", "path", strict)).union(tags.filter("kind = 'keyword'").select("value", "path", ~strict))
    accepted = saved(keywords.accepted(seen))
    removed = keywords.limited(accepted, most_files, keep=False)
    apis = literals.filter("kind = 'literal'").select("value", "path", F.lit("JS").alias("source"))
    taken = web.actions(pages).select(F.col("name").alias("value"), "path", F.lit("HTML").alias("source"))
    taken = taken.union(literals.filter("kind = 'soap'").select("value", "path", F.lit("HTML"))).union(tags.filter("kind = 'api'").select("value", "path", F.lit("HTML")))
    return FrontEnd(keywords.without(accepted, removed), keywords.api_names(apis.union(taken)), removed, keywords.skipped_scripts(scripts, cited))


def border_binaries(tree: DataFrame, *, top: int = params.TOP_BINARIES, least_keywords: int = params.LEAST_KEYWORDS) -> DataFrame:
    """(bin, strings_count, keywords_count, functions_count): where front-end input likely arrives."""
    front = front_end(tree)
    strings = saved(binstrings.strings(files.binaries(tree)))
    return ranking.border_rank(
        strings, matching.keyword_matches(strings, front.keywords), matching.api_matches(strings, front.apis),
        least_keywords=least_keywords, top=top,
    )


def keyword_paths(edges: DataFrame, args: DataFrame, references: DataFrame, names: DataFrame, functions: DataFrame, *, sinks: tuple[str, ...] = params.COMMAND_SINKS) -> DataFrame:
    """Paths from keyword references to sensitive calls, with one round of parameters found in the
    functions that led to one.  ``references``: bin, param, str_addr, func, ref_addr."""
    wanted = references.join(names.select(F.col("name").alias("param")).distinct(), "param", "left_semi")
    paths = saved(graph.sink_paths(edges, args, wanted, sinks))
    sources = paths.select("bin", F.col("start_func").alias("func")).distinct()
    fresh = graph.new_parameters(edges, args, names).join(sources, ["bin", "func"], "left_semi")
    again = references.withColumnRenamed("param", "name").join(fresh, ["bin", "func", "name"], "left_semi").withColumnRenamed("name", "param")
    return paths.unionByName(graph.sink_paths(edges, args, again.select(*references.columns), sinks)).distinct()


def confirmed(
    paths: DataFrame, calls: DataFrame, args: DataFrame, flows: DataFrame, seeds: DataFrame, *, classes: tuple[str, ...] = ("command", "overflow"),
    constants: DataFrame | None = None, keys: DataFrame | None = None, guards: DataFrame | None = None, points_to: DataFrame | None = None,
    traces: DataFrame | None = None, uses_result: DataFrame | None = None,
) -> DataFrame:
    """Alerts of sinks on recorded paths that taint from the referenced keyword reaches.

    ``calls``: bin, call_addr, callee (and block, external with ``traces``); ``args``: bin, call_addr, pos,
    var (and writable); ``seeds``: bin, var.  Optional facts sharpen the rules: ``constants`` the formats'
    arguments, ``keys`` stores under keys, ``guards`` comparisons, ``points_to`` pointers, ``traces`` with
    ``uses_result`` the calls off the trace.
    """
    spark = paths.sparkSession
    kept = paths.filter(reports.kept_parameter(F.col("param")))
    allowed = kept.select("bin", F.element_at("path", -1)["addr"].alias("call_addr")).distinct()
    summaries = taint.table_of(spark, "summaries")
    moves = flows.select("bin", "src", "dst").union(taint.call_flows(calls, args, summaries))
    if keys is not None:
        moves = moves.union(taint.keyed_flows(calls, args, keys, summaries))
    if traces is not None and uses_result is not None:
        moves = moves.union(taint.unguided_flows(calls, args, traces, uses_result))
    clean = taint.sanitized(calls, args, summaries, seeds)
    if guards is not None:
        clean = clean.union(taint.bounded(guards, seeds))
    reached = taint.tainted(moves, seeds, clean)
    formats = None if constants is None else taint.directives(calls, constants)
    return taint.alerts(calls, args, reached, taint.table_of(spark, "sinks"), classes=classes, allowed=allowed, points_to=points_to, formats=formats)
