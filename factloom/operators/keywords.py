"""Keywords and API names of the front end: acceptance, provenance, limits, removals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import text


def accepted(occurrences: DataFrame) -> DataFrame:
    """(name, path) of names that any occurrence lets pass; every occurrence of a name then counts.

    ``occurrences``: name, path, checked - checked occurrences must pass the strict rule.
    """
    name = F.col("name")
    passes = F.when(F.col("checked"), text.keyword_ok(name)).otherwise(text.keyword_ok(name, strict=False))
    rows = occurrences.withColumn("passes", passes)
    good = rows.groupBy("name").agg(F.bool_or("passes").alias("ok")).filter("ok").select("name")
    return rows.select("name", "path").join(good, "name").distinct()


def api_names(occurrences: DataFrame) -> DataFrame:
    """(name, path, source): values of scripts pass the API rule, form actions are taken as they are."""
    name = F.when(F.col("source") == "HTML", F.col("value")).otherwise(text.api_name(F.col("value")))
    return occurrences.select(name.alias("name"), "path", "source").filter("name IS NOT NULL").distinct()


def provenance(names: DataFrame) -> DataFrame:
    """(name, text_files, files): sorted distinct files of each name and their number."""
    return names.groupBy("name").agg(
        F.array_sort(F.collect_set("path")).alias("text_files"), F.countDistinct("path").alias("files")
    )


def frequency(names: DataFrame, key: str = "name", place: str = "path") -> DataFrame:
    """(name, places): in how many distinct places each name occurs, without collecting them."""
    return names.select(key, place).distinct().groupBy(key).agg(F.count("*").alias("places"))


def limited(names: DataFrame, most: int = params.MOST_TEXT_FILES, *, key: str = "name", place: str = "path", keep: bool = True) -> DataFrame:
    """Names in at most ``most`` places, or with ``keep=False`` the removed ones, with their number."""
    counted = frequency(names, key, place)
    return counted.filter(F.col("places") <= most) if keep else counted.filter(F.col("places") > most)


def without(names: DataFrame, removed: DataFrame, key: str = "name") -> DataFrame:
    return names.join(removed.select(key).distinct(), key, "left_anti")


def removals(*removed: DataFrame) -> DataFrame:
    """Union of the names that several filters removed."""
    out = removed[0].select("name")
    for more in removed[1:]:
        out = out.union(more.select("name"))
    return out.distinct()


def citations(cited: DataFrame) -> DataFrame:
    """(script, pages): distinct citing pages of each script."""
    return frequency(cited, "script", "html_path").withColumnRenamed("places", "pages")


def analysed_scripts(scripts: DataFrame, cited: DataFrame, limit: int = params.CITATION_LIMIT) -> DataFrame:
    """Scripts (name, path) cited by fewer than ``limit`` pages; uncited ones are not analysed."""
    rare = citations(cited).filter(F.col("pages") < limit).select(F.col("script").alias("name"))
    return scripts.join(rare, "name", "left_semi")


def skipped_scripts(scripts: DataFrame, cited: DataFrame, limit: int = params.CITATION_LIMIT) -> DataFrame:
    return scripts.join(analysed_scripts(scripts, cited, limit).select("path"), "path", "left_anti")


def totals(occurrences: DataFrame) -> DataFrame:
    """One row: values seen and kept, in all and by kind."""
    kept = F.col("kept").cast("int")
    sums = [F.count("*").alias("values"), F.sum(kept).alias("values_kept")]
    for kind in ("keyword", "api"):
        one = F.col("kind") == kind
        sums += [F.count_if(one).alias(f"{kind}s"), F.sum(F.when(one, kept).otherwise(0)).alias(f"{kind}s_kept")]
    return occurrences.agg(*sums)


def split_apis(apis: DataFrame, keywords: DataFrame, actions: DataFrame) -> DataFrame:
    """(api, keywords, actions): segments of script API names that are keywords or form actions."""
    parts = apis.select(F.col("name").alias("api"), F.explode(F.array_distinct(F.split("name", "/"))).alias("name")).filter("name <> ''")
    kinds = keywords.select("name").distinct().withColumn("kind", F.lit("k")).union(actions.select("name").distinct().withColumn("kind", F.lit("a")))
    hits = parts.join(kinds, "name")
    pick = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("name"))))
    return hits.groupBy("api").agg(pick("k").alias("keywords"), pick("a").alias("actions"))


def effective(keyword_matches: DataFrame, api_matches: DataFrame) -> DataFrame:
    """One row: distinct keywords and API names that any unit holds."""
    rows = keyword_matches.select("name", F.lit(0).alias("k")).union(api_matches.select("name", F.lit(1).alias("k"))).distinct()
    return rows.agg(F.count_if(F.col("k") == 0).alias("keywords"), F.count_if(F.col("k") == 1).alias("functions"))
