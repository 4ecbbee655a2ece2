"""Firmware file trees as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params
from ..functions import text


def file_tree(spark: SparkSession, root: str, *, skipped_paths: tuple[str, ...] = (), glob: str | None = None) -> DataFrame:
    """files(path, name, suffix, kind, length, content): one row a file, read recursively.

    Links do not reach the table as the reader lists regular files; unwanted names and paths are
    dropped before content is used, and ``content`` is only read where a query selects it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    name = text.basename(F.col("path"))
    wanted = ~name.isin(*params.SKIPPED_FILES)
    for part in skipped_paths:
        wanted = wanted & ~F.contains(F.col("path"), F.lit(part))
    return raw.filter(wanted).select(
        "path", name.alias("name"), text.suffix(F.col("path")).alias("suffix"),
        text.file_kind(F.col("path"), F.col("content")).alias("kind"), "length", "content",
    )


def with_suffix(files: DataFrame, suffix: str) -> DataFrame:
    """Files of one kind (html, js, xml) or of an exact suffix (asp, php and the like)."""
    if suffix in ("html", "js", "xml"):
        return files.filter(F.col("kind") == suffix)
    return files.filter(F.col("suffix") == suffix)


def named(files: DataFrame, names: DataFrame) -> DataFrame:
    """For each wanted base name the first path that has it, in path order."""
    return files.join(names.select("name").distinct(), "name").groupBy("name").agg(F.min("path").alias("path"))


def binaries(files: DataFrame, filtered: bool = True) -> DataFrame:
    """ELF files; ``filtered`` leaves out commands, libraries and kernel modules."""
    elf = files.filter(F.col("kind") == "elf")
    path = F.col("path")
    return elf.filter(text.not_command(path) & text.not_library(path)) if filtered else elf


def executables(files: DataFrame) -> DataFrame:
    """Files that are neither images nor text, by their first bytes."""
    head = F.hex(F.substring(F.col("content"), 1, 8))
    image = head.rlike("^(89504E47|FFD8FF|47494638|424D|00000100)")
    printable = F.decode(F.substring(F.col("content"), 1, 512), "ISO-8859-1").rlike(r"^[\x09-\x0D\x20-\x7E\x80-\xFF]*$")
    return files.filter((F.col("length") > 0) & ~image & ~printable)


def readable(content: Column) -> Column:
    """UTF-8 text of a file; what is no UTF-8 is left out."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))
