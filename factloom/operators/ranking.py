"""Ranking of units by what they share with the front end, and by how they parse input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from .common import numbered, saved


def border_rank(
    strings: DataFrame, keyword_matches: DataFrame, api_matches: DataFrame, *, owner: str = "bin",
    least_keywords: int = params.LEAST_KEYWORDS, least_apis: int = params.LEAST_APIS, top: int | None = None,
) -> DataFrame:
    """(owner, strings_count, keywords_count, functions_count), best first, ties by name.

    Units with fewer keywords or API names than the least are left out; ``top`` limits the rows.
    """
    hits = keyword_matches.select(owner, F.lit(0).alias("k"), "name").union(api_matches.select(owner, F.lit(1).alias("k"), "name")).distinct()
    counted = hits.groupBy(owner).agg(F.count_if(F.col("k") == 0).alias("keywords_count"), F.count_if(F.col("k") == 1).alias("functions_count"))
    counted = counted.filter((F.col("keywords_count") >= least_keywords) & (F.col("functions_count") >= least_apis))
    sizes = strings.groupBy(owner).agg(F.count("*").alias("strings_count"))
    rows = counted.join(sizes, owner).select(owner, "strings_count", "keywords_count", "functions_count")
    ordered = rows.orderBy(F.desc("keywords_count"), F.desc("functions_count"), owner)
    return ordered.limit(top) if top is not None else ordered


def border_detail(ranks: DataFrame, keyword_matches: DataFrame, api_matches: DataFrame, keyword_files: DataFrame, api_files: DataFrame, *, owner: str = "bin") -> DataFrame:
    """The ranked units with their names and the files these come from (name, path)."""
    out = ranks
    for label, matches, files in (("keyword", keyword_matches, keyword_files), ("function", api_matches, api_files)):
        names = matches.groupBy(owner).agg(F.array_sort(F.collect_set("name")).alias(f"{label}s"))
        paths = matches.select(owner, "name").distinct().join(files.select("name", "path").distinct(), "name")
        paths = paths.groupBy(owner).agg(F.array_sort(F.collect_set("path")).alias(f"{label}_source_files"))
        out = out.join(names, owner, "left").join(paths, owner, "left")
    return out


def device_rank(matches: DataFrame, urns: DataFrame, files: DataFrame, *, owner: str = "bin", least_keywords: int = params.LEAST_KEYWORDS) -> DataFrame:
    """(owner, keywords_count, source_files), best first: units by the device names they hold, those that
    start with ``urn:`` (owner, urn) counted beside the matched ones, with the files these come from."""
    hits = matches.select(owner, "name").distinct()
    counted = hits.groupBy(owner).agg(F.count("*").alias("n")).filter(F.col("n") >= least_keywords)
    more = urns.select(owner, "urn").distinct().groupBy(owner).agg(F.count("*").alias("u"))
    places = hits.join(files.select("name", "path").distinct(), "name").select(owner, "path").distinct().groupBy(owner).agg(F.count("*").alias("f"))
    rows = counted.join(more, owner, "left").join(places, owner, "left")
    total = F.col("n") + F.coalesce("u", F.lit(0))
    return rows.select(owner, total.alias("keywords_count"), F.coalesce("f", F.lit(0)).alias("source_files")).orderBy(F.desc("keywords_count"), owner)


def parsing_scores(stats: DataFrame, *, owner: str = "bin") -> DataFrame:
    """(owner, score): the best weighted count of a unit's functions.

    ``stats``: n_blocks, n_branch, n_memcmp, net_marks, net_checked; a function without one of the
    three counts has no say.
    """
    a, b, c = params.SCORE_WEIGHTS
    score = F.col("n_blocks") * a + F.col("n_branch") * b + F.col("n_memcmp") * c
    score = score * F.when(F.col("net_checked"), params.SCORE_CHECKED).otherwise(1.0)
    score = score * F.when(F.col("net_marks") > 0, F.col("net_marks") * params.SCORE_MARK).otherwise(1.0)
    rows = stats.filter("n_blocks > 0 AND n_branch > 0 AND n_memcmp > 0")
    return rows.groupBy(owner).agg(F.max(score).alias("score"))


def first_cluster(scores: DataFrame, *, owner: str = "bin", score: str = "score", gap: float = 0.5, core: int = 5) -> DataFrame:
    """The first density cluster of the scores, highest first.

    With fewer than ``core`` rows it is the best one; otherwise the best ``core`` and what follows
    them while neighbours are at most ``gap`` apart.  Neighbours in one bucket of width ``gap`` are
    never too far apart, so only each bucket's least and greatest score are put in order.
    """
    best = scores.select(owner, score).orderBy(F.desc(score), owner).limit(core)
    rows = best.collect()  # at most ``core``
    if len(rows) < core:
        return best.limit(1)
    last = F.lit(rows[-1][score])
    below = scores.filter(F.col(score) <= last).groupBy(F.floor((last - F.col(score)) / gap).alias("bucket")).agg(
        F.min(score).alias("low"), F.max(score).alias("high")
    )
    below = saved(below)
    # what is near a bucket lies one bucket up, or two where a quotient was rounded
    near = below.select(F.explode(F.array(F.col("bucket") + 1, F.col("bucket") + 2)).alias("bucket"), F.col("low").alias("above"))
    near = near.groupBy("bucket").agg(F.min("above").alias("above"))
    apart = F.coalesce(F.col("above") - F.col("high") > gap, F.lit(True)) & (F.col("bucket") > 0)
    cut = below.join(near, "bucket", "left").filter(apart).agg(F.max("high")).first()[0]
    found = scores.select(owner, score)
    return found if cut is None else found.filter(F.col(score) > cut)


def named_top(counts: DataFrame, *, name: str = "name", count: str = "n", top: int = 5) -> DataFrame:
    """The ``top`` most frequent names that are no libraries (no dot-separated part so or ko)."""
    parts = F.split(F.col(name), r"\.")
    return counts.filter(~F.arrays_overlap(parts, F.array(F.lit("so"), F.lit("ko")))).orderBy(F.desc(count), name).limit(top)


def server_names(names: DataFrame, *, name: str = "name", pattern: str = "(cgi|httpd|upnp|boa)") -> DataFrame:
    """(number, name): names that look like servers, numbered in order."""
    hits = names.filter(F.col(name).rlike(pattern)).select(name).distinct()
    return numbered(hits, [name]).select("number", name)


def coverage(base: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """One row: how much of ``base`` is in ``target``, as found / missing with two decimals, 1 if none is missing."""
    both = base.select(key).distinct().join(target.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
    sums = both.agg(F.count("*").alias("n"), F.count("hit").alias("found"))
    missing = F.col("n") - F.col("found")
    return sums.select("n", "found", F.when(missing == 0, F.lit("1")).otherwise(F.format_string("%.2f", F.col("found") / missing)).alias("ratio"))
