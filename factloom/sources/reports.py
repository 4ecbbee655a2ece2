"""Readers and writers of the text interchange formats; Parquet is the format between stages."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params
from ..functions import text
from ..operators.common import saved


def keyword_file(spark: SparkSession, path: str) -> DataFrame:
    """keywords(name): distinct words of a text file."""
    words = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("name"))
    return words.filter("name <> ''").distinct()


def share_file(spark: SparkSession, path: str) -> DataFrame:
    """(function, key): what follows the line ``Shares:`` of each file, under the getters' names."""
    lines = spark.read.option("lineSep", "\x00").text(path)
    tail = F.substring_index("value", "Shares:", -1)
    rows = lines.filter(F.contains("value", F.lit("Shares:"))).select(F.explode(F.split(tail, r"\r?\n")).alias("line"))
    pairs = rows.select(F.split(F.trim("line"), r"\s+").alias("p")).filter("size(p) = 2 AND p[0] <> ''")
    return pairs.select(text.getter_of(F.col("p")[0]).alias("function"), F.col("p")[1].alias("key")).distinct()


def path_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(line, hex, quoted): addresses and first quoted argument of result lines."""
    found = lines.select(
        F.col(value).alias("line"), F.regexp_extract_all(F.col(value), F.lit("(0x[0-9a-fA-F]+)"), F.lit(1)).alias("hex"),
        F.regexp_extract(F.col(value), '"(.*)"', 1).alias("quoted"), F.contains(F.col(value), F.lit('"')).alias("has"),
    )
    return found.filter("has").drop("has")


def kept_parameter(name: Column) -> Column:
    """A parameter longer than one character that is no interface label and not a number.  (A check for
    ``%`` and ``$`` never had an effect and has none here.)"""
    return (F.length(name) > 1) & ~F.lower(name).isin(*params.LABELS) & ~name.rlike("^[0-9]+$")


def kept_lines(parsed: DataFrame) -> DataFrame:
    """Lines with over two addresses and a parameter that is kept."""
    return parsed.filter((F.size("hex") > 2) & kept_parameter(F.col("quoted")))


def merged_cases(parsed: DataFrame) -> DataFrame:
    """taint_cases: lines merged by string and reference address, as sorted distinct addresses."""
    numbers = F.transform("hex", text.address)
    rows = parsed.select(
        numbers[0].alias("str_addr"), numbers[1].alias("ref_addr"), F.slice(numbers, 3, F.size("hex") - 3).alias("trace"),
        F.element_at(numbers, -1).alias("sink"),
    )
    return rows.groupBy("str_addr", "ref_addr").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("trace")))).alias("trace"),
        F.array_sort(F.collect_set("sink")).alias("sinks"),
    )


def case_lines(cases: DataFrame) -> DataFrame:
    """(value): three lines a case - string and reference, trace, sinks - as one text."""
    line = lambda c: F.array_join(F.transform(c, text.hex_address), " ")
    head = F.concat_ws(" ", text.hex_address(F.col("str_addr")), text.hex_address(F.col("ref_addr")))
    return cases.select(F.concat_ws("\n", head, line("trace"), line("sinks")).alias("value"))


#: Bytes of a byte range of a text file at most.
RANGE_BYTES = 16 << 20


def _ranged(spark: SparkSession) -> SparkSession:
    """A session of its own over the same cluster, whose scans always split files alike."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.files.maxPartitionBytes", str(RANGE_BYTES))
    own.conf.set("spark.sql.files.openCostInBytes", str(RANGE_BYTES // 16))
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    return own


def _records(
    spark: SparkSession, path: str, size: int, parse: Callable[[pa.Array], list[pa.Array]] | None = None, kinds: str = "lines array<string>",
) -> DataFrame:
    """(file, record, lines): ``size`` lines each, counted from the start of their file; the last may have
    fewer.  As in a split at line feeds, an empty line follows a last line feed.

    Files are read in byte ranges.  A file of one range is read once; of larger files the lines of each range
    are counted first, so that a task knows which of its lines open a record.  Of these only the outermost lines
    of a range are shuffled, so a file may have any size.  No row in a task has a file's name, only its hash.

    ``parse`` makes the columns ``kinds`` of an array of records, in the task that holds them; the first is
    ``lines``, which it may leave null where others have all of it (there ``file`` is null too).
    """
    own = _ranged(spark)
    listed = own.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "length")
    known, salt = [tuple(r) for r in listed.collect()], 0
    while True:
        hashed = own.createDataFrame(known, "file string, length long").select(F.xxhash64(F.lit(salt), "file"), "file", "length")
        held = {h: (name, length) for h, name, length in hashed.collect()}
        if len(held) == len(known):
            break
        salt += 1
    value = F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    raw = own.read.option("lineSep", "\n").text(path)
    many = F.col("_metadata.file_size") > RANGE_BYTES
    columns = [
        F.xxhash64(F.lit(salt), F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("start"),
        (F.octet_length("value") + 1).cast("long").alias("bytes"), F.make_valid_utf8(value).alias("line"),
    ]

    def runs(batches):
        """Runs of lines of one range: file and start, whether the range begins, bytes of each line, lines."""
        key = None
        for batch in batches:
            files, starts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = (np.flatnonzero((np.diff(files) != 0) | (np.diff(starts) != 0)) + 1).tolist() if len(files) else []
            for a, b in zip([0, *cuts], [*cuts, len(files)], strict=True):
                if a < b:
                    here = (int(files[a]), int(starts[a]))
                    yield here, here != key, batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a)
                    key = here

    def outer(batches):
        """A row a range: how many lines and bytes it holds, and its outermost lines."""
        def row():
            one = [[key[0]], [key[1]], [n], [used], [head.to_pylist()], [tail.to_pylist()]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(one, [pa.int64()] * 4 + [pa.list_(pa.string())] * 2, strict=True)], ["file", "start", "n", "bytes", "head", "tail"])

        key = None
        for here, begins, lengths, lines in runs(batches):
            if begins:
                if key is not None:
                    yield row()
                key, n, used, head, tail = here, 0, 0, lines.slice(0, 0), lines.slice(0, 0)
            head = pa.concat_arrays([head, lines.slice(0, max(0, size - 1 - n))])
            tail = pa.concat_arrays([tail, lines.slice(max(0, len(lines) - size + 1))])
            tail = tail.slice(max(0, len(tail) - size + 1))
            n, used = n + len(lines), used + pc.sum(lengths).as_py()
        if key is not None:
            yield row()

    ranges: dict[tuple[int, int], tuple[int, int]] = {}
    ends: list[tuple[int, int, str]] = []
    large = any(length > RANGE_BYTES for _, length in held.values())
    if large:
        # a filter by a file's size leaves out files, not lines
        edges = saved(raw.filter(many).select(*columns).mapInArrow(outer, "file long, start long, n long, bytes long, head array<string>, tail array<string>"))
        file, at, used = None, 0, 0
        found = sorted(tuple(r) for r in edges.select("file", "start", "n", "bytes").collect())
        for k, (name, start, n, bytes_) in enumerate(found):
            if name != file:
                file, at, used = name, 0, 0
            ranges[name, start] = (at, n)
            at, used = at + n, used + bytes_
            if (k + 1 == len(found) or found[k + 1][0] != name) and used == held[name][1] and at % size:
                ends.append((name, at, ""))

    def built(file, number, lines):
        """Records of lines, the last of which may be short."""
        n = -(-len(lines) // size)
        offsets = np.minimum(np.arange(n + 1) * size, len(lines)).astype(np.int32)
        parts = pa.ListArray.from_arrays(pa.array(offsets), lines)
        return named(pa.array([held[file][0]] * n, pa.string()), pa.array(np.arange(number, number + n, dtype=np.int64)), parts)

    def named(files, records, parts):
        made = parse(parts) if parse else [parts]
        files = pc.if_else(made[0].is_null(), pa.scalar(None, pa.string()), files)
        return pa.RecordBatch.from_arrays([files, records, *made], [*"fr", *map(str, range(len(made)))])

    def whole(batches):
        """Records that lie in one range; of a file of one range these are all."""
        key = None
        for here, begins, lengths, lines in runs(batches):
            if begins:
                if key is not None and key not in ranges and len(left):
                    yield built(key[0], number, closed(left, used == held[key[0]][1]))
                if here[0] not in held or (here[1] and here not in ranges):
                    raise ValueError("a file changed while it was read")
                key, seen, used, left = here, 0, 0, lines.slice(0, 0)
                base, n = ranges.get(key, (0, None))
                first, last = -(-base // size) * size - base, None if n is None else (base + n) // size * size - base
                number = (base + first) // size
            if n is not None and seen + len(lines) > n:
                raise ValueError(f"{held[key[0]][0]} changed while it was read")
            a, b = max(0, first - seen), len(lines) if last is None else min(len(lines), last - seen)
            seen, used = seen + len(lines), used + pc.sum(lengths).as_py()
            if a < b:
                left = pa.concat_arrays([left, lines.slice(a, b - a)])
                count = len(left) // size
                if count:
                    yield built(key[0], number, left.slice(0, count * size))
                number, left = number + count, left.slice(count * size)
        if key is not None and key not in ranges and len(left):
            yield built(key[0], number, closed(left, used == held[key[0]][1]))

    def closed(left, fed):
        return pa.concat_arrays([left, pa.array([""], left.type)]) if fed else left

    def crossing(batches):
        """Lines of records that lie in more than one range."""
        for batch in batches:
            for r in batch.to_pylist():
                base, n = ranges[r["file"], r["start"]]
                lines = dict(enumerate(r["head"], base)) | dict(enumerate(r["tail"], base + n - len(r["tail"])))
                rest = sorted(k for k in lines if k < -(-base // size) * size or k >= (base + n) // size * size)
                if rest:
                    yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(rest), pa.int64()), pa.array(rest, pa.int64()), pa.array([lines[k] for k in rest], pa.string())], ["file", "number", "line"])

    def joined(batches):
        for batch in batches:
            if batch.num_rows:
                yield named(pa.array([held[f][0] for f in batch.column(0).to_pylist()], pa.string()), batch.column(1), batch.column(2))

    made = f"file string, record long, {kinds}"
    out = raw.select(*columns).mapInArrow(whole, made)
    if large:
        rest = edges.mapInArrow(crossing, "file long, number long, line string").union(own.createDataFrame(ends, "file long, number long, line string"))
        rest = rest.groupBy("file", F.floor(F.col("number") / size).alias("record")).agg(F.array_sort(F.collect_list(F.struct("number", "line"))).alias("x"))
        out = out.unionByName(rest.select("file", "record", F.col("x.line").alias("lines")).mapInArrow(joined, made))
    return out


def _plain_cases(records: pa.Array) -> list[pa.Array]:
    """lines, head, trace, sinks of three-line records: numbers of those that hold nothing but ``0x`` numbers
    of up to 15 digits and single spaces, of others the lines."""
    n, lines = len(records), records.flatten()
    full = pc.equal(records.value_lengths(), 3).to_numpy(zero_copy_only=False)
    at = np.repeat((np.cumsum(records.value_lengths().to_numpy()) - 3)[full], 3).reshape(-1, 3) + np.arange(3)
    number, plain = "0x[0-9a-fA-F]{1,15}", full.copy()
    parts = [lines.take(pa.array(at[:, k])) for k in range(3)]
    shapes = [rf"\A{number} {number}\z", *[rf"\A({number}( {number})*)?\z"] * 2]
    fits = [pc.match_substring_regex(p, shape).to_numpy(zero_copy_only=False) for p, shape in zip(parts, shapes, strict=True)]
    plain[full] = np.logical_and.reduce(fits)
    found = []
    for part in parts:
        rows = np.full(n, -1, dtype=np.int64)
        rows[full] = np.arange(len(part))
        rows = rows[plain]
        tokens = pc.split_pattern(part.take(pa.array(rows)), " ")
        flat = tokens.flatten()
        values = pc.if_else(pc.equal(flat, ""), pa.scalar(None, flat.type), flat).cast(pa.int64())
        there = np.append(0, np.cumsum(values.is_valid().to_numpy(zero_copy_only=False)))
        ends = np.cumsum(tokens.value_lengths().to_numpy()) if len(tokens) else np.zeros(0, dtype=np.int64)
        sizes = np.zeros(n, dtype=np.int64)
        sizes[plain] = np.diff(np.append(0, there[ends]))
        offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        found.append(pa.ListArray.from_arrays(offsets, values.drop_null()))
    return [pc.if_else(pa.array(plain), pa.scalar(None, records.type), records), *found]


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """taint_cases of files of three-line records.  A record whose lines are no numbers, or whose first
    line has not two of them, is an error: none is passed over."""
    numbers = lambda k, plain: F.when(F.col("lines").isNull(), F.col(plain)).otherwise(F.transform(F.filter(F.split(F.get("lines", F.lit(k)), r"\s+"), lambda x: x != ""), _number)).alias(plain)
    rows = _records(spark, path, 3, _plain_cases, "lines array<string>, head array<bigint>, trace array<bigint>, sinks array<bigint>")
    plain, blank = F.col("lines").isNull(), F.forall("lines", lambda x: x == "")
    whole = rows.filter(plain | ~blank).select("file", "record", numbers(0, "head"), numbers(1, "trace"), numbers(2, "sinks"), plain.alias("plain"))
    bad = F.col("head").isNull() | (F.size("head") != 2) | F.col("sinks").isNull() | F.exists(F.concat("head", "trace", "sinks"), lambda x: x.isNull())
    error = F.raise_error(F.concat(F.lit("no case in "), "file", F.lit(", record "), F.col("record").cast("string"))).cast("array<bigint>")
    checked = F.when(F.col("plain"), F.col("head")).when(bad, error).otherwise(F.col("head"))
    return whole.withColumn("head", checked).select(F.col("head")[0].alias("str_addr"), F.col("head")[1].alias("ref_addr"), "trace", "sinks")


def _number(token: Column) -> Column:
    """A decimal or ``0x`` number, null if it is none."""
    return F.when(token.rlike("^0x[0-9a-fA-F]+$"), text.address(token)).otherwise(token.try_cast("bigint"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(name, fields map) of the older cluster report: records of 14 lines ``label : value``; the first
    value names the unit."""
    pair = lambda x: F.transform(F.split(x, r"\s*:\s*", 2), lambda y: F.trim(y))
    pairs = F.transform(F.filter("lines", lambda x: F.contains(x, F.lit(":"))), pair)
    whole = _records(spark, path, 14).select(pairs.alias("pairs")).filter("size(pairs) > 0")
    return whole.select(
        F.col("pairs")[0][1].alias("name"), F.map_from_entries(F.transform("pairs", lambda x: F.struct(x[0], x[1]))).alias("fields"),
    )


def write_table(df: DataFrame, path: str, order: list[str]) -> None:
    """Parquet in a total order, so that files read one after the other are sorted."""
    df.orderBy(*order).write.mode("overwrite").parquet(path)


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """The text column ``value`` in a total order."""
    lines.orderBy(*order).select("value").write.mode("overwrite").text(path)


def write_reports(
    path: str, *, keywords: DataFrame, apis: DataFrame, matches: DataFrame, ranks: DataFrame, removed: DataFrame,
    occurrences: DataFrame, totals: DataFrame, skipped: DataFrame | None = None, splits: DataFrame | None = None,
) -> None:
    """The tables of one front-end run: details, names alone, matches by binary, ranks, files, removals,
    totals, strings taken over, and where given the scripts left out and the split API names."""
    for name, table, order in (
        ("keyword_detail", keywords, ["name"]), ("api_detail", apis, ["name"]), ("removed", removed, ["name"]),
        ("file_detail", occurrences, ["path"]), ("border_rank", ranks, ["keywords_count"]),
    ):
        write_table(table, f"{path}/{name}", order)
    write_table(keywords.select("name").distinct(), f"{path}/keyword_simple", ["name"])
    write_table(apis.select("name").distinct(), f"{path}/api_simple", ["name"])
    matched = matches.groupBy("bin").agg(F.array_join(F.array_sort(F.collect_set("match_str")), " ").alias("matched"))
    write_table(matched, f"{path}/matched", ["bin"])
    taken = matches.filter("full_str IS NOT NULL").select("bin", "match_str", "full_str").distinct()
    write_table(taken, f"{path}/path_strings", ["bin", "match_str", "full_str"])
    write_lines(info_lines(totals), f"{path}/info", ["place"])
    if skipped is not None:
        write_lines(skipped_lines(skipped), f"{path}/skipped_scripts", ["name", "path"])
    if splits is not None:
        write_lines(split_lines(splits), f"{path}/api_split", ["api"])


def info_lines(totals: DataFrame, seconds: dict[str, float] | None = None) -> DataFrame:
    """(place, value): the seconds of each step, then every total of a one-row table, a line each."""
    spent = [F.struct(F.lit(k).alias("place"), F.lit(f"{name} Elapsed Time: {s:.3f}S").alias("value")) for k, (name, s) in enumerate((seconds or {}).items())]
    counts = [
        F.struct(F.lit(len(spent) + k).alias("place"), F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("0"))).alias("value"))
        for k, c in enumerate(totals.columns)
    ]
    return totals.select(F.explode(F.array(*spent, *counts)).alias("x")).select("x.place", "x.value")


def skipped_lines(scripts: DataFrame) -> DataFrame:
    """(name, path, value) of scripts that are not analysed (name, path, pages array<string>)."""
    lines = F.concat_ws(
        "\n", F.concat(F.lit("FileName: "), "name"), F.concat(F.lit("Cited: "), F.size("pages").cast("string")), F.concat(F.lit("FilePath: "), "path"),
        F.lit("Referenced file : "), F.array_join(F.transform(F.array_sort("pages"), lambda p: F.concat(F.lit("\t"), p)), "\n"), F.lit(""),
    )
    return scripts.select("name", "path", lines.alias("value"))


def split_lines(splits: DataFrame) -> DataFrame:
    """(api, value) of split API names (api, match_strs, actions, keywords: arrays of strings)."""
    joined = lambda c: F.array_join(F.array_sort(c), " ")
    lines = F.concat_ws(
        "\n", F.concat(F.lit("API Name: "), "api"), F.concat(F.lit("from bin match: "), joined("match_strs")),
        F.concat(F.lit("Action: "), joined("actions")), F.concat(F.lit("Keyword: "), joined("keywords")), F.lit(""),
    )
    return splits.select("api", lines.alias("value"))


def device_lines(ranks: DataFrame, names: DataFrame, *, owner: str = "bin") -> DataFrame:
    """(owner, value): the device report of ranked units (owner, keywords_count, source_files) with their
    names (owner, name)."""
    held = names.select(owner, "name").distinct().groupBy(owner).agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("held"))
    lines = F.concat_ws(
        "\n", F.concat(F.lit("Program name : "), owner), F.lit("Upnp Para: "), F.concat(F.lit("\tHits Para count: "), F.col("keywords_count").cast("string")),
        F.lit("\tHits Para : "), F.concat(F.lit("\t\t"), F.coalesce("held", F.lit(""))),
        F.concat(F.lit("\tNumber of UPnp Para source files: "), F.col("source_files").cast("string")), F.lit(""),
    )
    return ranks.join(held, owner, "left").select(owner, lines.alias("value"))


def verdict_lines(cases: DataFrame, alerts: DataFrame) -> DataFrame:
    """(str_addr, ref_addr, value): for each case whether taint came to one of its sinks, and which.

    ``cases``: str_addr, ref_addr, sinks; ``alerts``: str_addr, ref_addr, call_addr."""
    hits = cases.select("str_addr", "ref_addr", F.explode("sinks").alias("call_addr")).join(alerts.select("str_addr", "ref_addr", "call_addr").distinct(), ["str_addr", "ref_addr", "call_addr"], "left_semi")
    found = hits.distinct().groupBy("str_addr", "ref_addr").agg(F.array_join(F.transform(F.array_sort(F.collect_list("call_addr")), text.hex_address), " ").alias("at"))
    head = F.concat(text.hex_address(F.col("str_addr")), F.lit(" "), text.hex_address(F.col("ref_addr")), F.lit("   "))
    rows = cases.select("str_addr", "ref_addr").distinct().join(found, ["str_addr", "ref_addr"], "left")
    return rows.select("str_addr", "ref_addr", F.concat(head, F.coalesce(F.concat(F.lit("found : "), "at"), F.lit("not found"))).alias("value"))


def verdict_totals(verdicts: DataFrame) -> DataFrame:
    """One row: cases and found cases."""
    return verdicts.agg(F.count("*").alias("cases"), F.count_if(F.contains("value", F.lit("   found"))).alias("found"))


def search_counters(paths: DataFrame) -> DataFrame:
    """(bin, paths, parameters, functions, sinks): the counters of a path search's result."""
    return paths.groupBy("bin").agg(
        F.count("*").alias("paths"), F.countDistinct("param").alias("parameters"), F.countDistinct("start_func").alias("functions"),
        F.countDistinct(F.element_at("path", -1)["addr"]).alias("sinks"),
    )
