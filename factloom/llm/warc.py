"""WARC archives: written by the text sink, read back by boundary-chain verification.

Method: archives are read in byte ranges, split at the magic of a record.  Every task turns each
magic it meets into a candidate record with the offset of its successor (from the declared length),
and follows its own candidates to the first offset outside its range.  Pointer jumping over these
range exits, from the start of each file, finds where the true chain enters every range; candidates
that the chain does not reach are magic inside payloads and are put back into the record around them.

Scale: ranges are Spark's own file splits, so a file of any size is read by many tasks and from any
store Spark reads; their size is fixed when a read begins, so that every scan meets the same ranges
whatever executors or settings change meanwhile.  What is shuffled is one row of offsets a candidate; rounds are the logarithm of
the ranges a file has.  Payloads move only for records that hold a false magic.  Duplicates are
found on digests; pages are joined with their verdicts by broadcast if those are few, and a payload
shared by a third of all pages is one partial aggregate a task and a splittable join.

Defined cases: a null page is an empty payload; the smallest id among equal payloads is the
response, and rows that repeat this id are responses too; null ids are never smallest; control
characters and spaces in an address are percent-encoded, a null address is left out; records of an
empty table are no records (and no files); other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, new_path, small, written

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
_D, _E = len(MAGIC), len(END)
_LENGTH = re.compile(rb"^Content-Length:[ \t]*(\d{1,15})[ \t]*\r?$", re.I | re.M)
#: Bytes of a range at least and at most.
RANGE_BYTES = (1 << 20, 128 << 20)
#: No offset: the chain breaks here.
DEAD = -1


def base32_sha1(data: Column) -> Column:
    """SHA-1 as 32 upper-case base32 characters: four groups of 40 bits."""
    digest = F.upper(F.sha1(data))
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    parts = (F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4))
    return F.translate(F.concat(*parts), digits, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, key, refers_to) of the rows whose payload an earlier id has: ``pages`` has page_id, html."""
    keys = written(pages.select("page_id", _key("html"), F.octet_length("html").alias("size")), "digests")
    keys = keys.filter(F.col("size") >= min_bytes)
    groups = keys.groupBy("key").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    groups = written(groups.filter("n > 1 AND refers_to IS NOT NULL").select("key", "refers_to"), "repeated")
    later = keys.join(groups, "key").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return written(later.select("page_id", "key", "refers_to").distinct(), "revisits")


def _key(html: str) -> Column:
    return F.sha2(F.col(html).cast("binary"), 256).alias("key")


def write(
    pages: DataFrame, path: str, *, id_col: str = "page_id", html_col: str = "html", url_col: str = "url",
    min_bytes: int = 0,
) -> None:
    """One record a row of ``pages`` under ``path``; equal payloads are stored once."""
    rows = pages.select(
        col(id_col).cast("long").alias("page_id"), col(url_col).alias("url"),
        F.coalesce(col(html_col), F.lit("")).alias("html"),
    )
    later = revisits(rows, min_bytes)
    later = small(later.select(F.col("page_id").alias("r_id"), F.col("key").alias("r_key"), "refers_to"))
    on = F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("key") == F.col("r_key"))
    rows = rows.withColumn("key", _key("html")).join(later, on, "left")
    again = F.col("refers_to").isNotNull()
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    fields = [
        ("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", name(F.col("page_id"))),
        ("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("html").cast("binary")))),
        ("WARC-Refers-To", F.when(again, name(F.col("refers_to")))),
        ("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.when(again, F.lit(0)).otherwise(F.octet_length("html")).cast("string")),
    ]
    lines = [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in fields]
    record = F.concat(F.lit(MAGIC), *lines, F.lit("\r\n"), F.when(again, F.lit("")).otherwise(F.col("html")))
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def _pinned(spark: SparkSession, path: str, range_bytes: int | None) -> SparkSession:
    """A session of its own over the same cluster, whose scans of ``path`` always split files alike.

    Spark takes the size of a split from the session's settings and the cores it has at that moment; here
    it is set once, so that every scan, however late and whatever executors come and go, meets the same
    ranges.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    if range_bytes is None:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        held = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
        range_bytes = min(RANGE_BYTES[1], max(RANGE_BYTES[0], held // (4 * spark.sparkContext.defaultParallelism)))
    own.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes))
    own.conf.set("spark.sql.files.openCostInBytes", "0")
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    return own


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between one magic and the next, in order within each byte range."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def _walk(batches, each):
    """Calls ``each(file, block, at, value)`` for the pieces of a task; ``at``: bytes since the range's first."""
    here, at = None, 0
    for batch in batches:
        files, blocks, values = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for n in range(batch.num_rows):
            key = (files[n], blocks[n])
            if key != here:
                here, at = key, 0
            value = values[n].as_buffer()
            value = memoryview(value) if value is not None else memoryview(b"")
            yield from each(key[0], key[1], at, value)
            at += len(value) + _D


def _head(value: memoryview) -> tuple[int, int]:
    """(bytes of the header with its blank line, declared length) or (DEAD, DEAD)."""
    block = bytes(value[:4096])
    stop = block.find(b"\r\n\r\n")
    if stop < 0 and len(value) > 4096:
        block = bytes(value)
        stop = block.find(b"\r\n\r\n")
    found = _LENGTH.search(block, 0, stop + 2) if stop >= 0 else None
    return (stop + _E, int(found[1])) if found else (DEAD, DEAD)


def _candidates(pieces: DataFrame) -> DataFrame:
    """(file, block, at, bytes, next, exit): successor of each piece taken as a record, and the first
    offset outside the range that its chain comes to; all relative to the range's first piece."""

    def scan(batches):
        rows: list[list] = []

        def finish():
            end = rows[-1][2] + rows[-1][3] if rows else 0
            exits: dict[int, int] = {}
            for row in reversed(rows):
                after = row[4]
                row[5] = after if after >= end or after == DEAD else exits.get(after, DEAD)
                exits[row[2]] = row[5]
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
            )
            rows.clear()
            return out

        names = ["file", "block", "at", "bytes", "next", "exit"]
        kinds = [pa.string(), *[pa.int64()] * 5]

        def each(file, block, at, value):
            if rows and (rows[-1][0], rows[-1][1]) != (file, block):
                yield finish()
            head, size = _head(value)
            after = DEAD if head == DEAD else at + head + size + _E + _D
            rows.append([file, block, at, len(value) + _D, after, DEAD])

        yield from _walk(batches, each)
        if rows:
            yield finish()

    return pieces.mapInArrow(scan, "file string, block long, at long, bytes long, next long, exit long")


def chain(pieces: DataFrame) -> DataFrame:
    """(file, block, at, off, owner): of every piece; ``off`` is its byte offset in the file, just after
    the magic, and ``owner`` that of the true record it belongs to (null before the first one)."""
    found = written(_candidates(pieces), "candidates")
    ranges = found.groupBy("file", "block").agg(F.sum("bytes").alias("bytes"))
    ranges = written(
        ranges.selectExpr(
            "file", "block",
            "coalesce(sum(bytes) OVER (PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base",
        ),
        "ranges",
    )
    shift = lambda c: F.when(F.col(c) == DEAD, F.lit(DEAD)).otherwise(F.col("base") + F.col(c)).alias(c)
    nodes = written(
        found.join(ranges, ["file", "block"]).select(
            "file", "block", "at", (F.col("base") + F.col("at")).alias("off"), shift("next"), shift("exit")
        ),
        "nodes",
    )
    # a file's chain starts with the magic at its first byte; every other entry is another range's exit
    start = nodes.filter(F.col("off") == _D).select("file", "off")
    entries = nodes.select("file", F.col("exit").alias("off")).filter(F.col("off") != DEAD).union(start).distinct()
    jumps = written(
        nodes.join(entries, ["file", "off"]).filter(F.col("exit") != DEAD).select("file", "off", F.col("exit").alias("to")), "jumps"
    )
    reached = written(start, "reached")
    known = reached.count()
    while True:
        ahead = reached.join(jumps, ["file", "off"]).select("file", F.col("to").alias("off"))
        reached = written(reached.union(ahead).distinct(), "reached")
        now = reached.count()
        if now == known:
            break
        known = now
        # where twice as many ranges lead; what leads out of the file stays
        far = jumps.select("file", F.col("off").alias("to"), F.col("to").alias("end"))
        jumps = jumps.join(far, ["file", "to"], "left").select("file", "off", F.coalesce("end", "to").alias("to"))
        jumps = written(jumps, "jumps")
    entry = nodes.join(reached, ["file", "off"]).groupBy("file", "block").agg(F.min("off").alias("entry"))

    def follow(key, held):
        """The true records of one range, and the record each other piece lies in."""
        held = held.sort_values("off", ignore_index=True)
        after = dict(zip(held["off"].tolist(), held["next"].tolist(), strict=True))
        at, true = held["entry"].iloc[0], set()
        while at in after and at not in true:
            true.add(at)
            at = after[at]
        own = held["off"].where(held["off"].isin(true))
        return held.assign(owner=own.ffill().astype("Int64"))[["file", "block", "at", "off", "owner"]]

    marked = nodes.join(entry, ["file", "block"], "left").groupBy("file", "block").applyInPandas(
        follow, "file string, block long, at long, off long, owner long"
    )
    marked = written(marked, "marked")
    # a record may reach over whole ranges: what opens a range belongs to the last record before it
    last = marked.groupBy("file", "block").agg(F.max("owner").alias("own")).selectExpr(
        "file", "block",
        "max(own) OVER (PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before",
    )
    return written(
        marked.join(last, ["file", "block"]).select("file", "block", "at", "off", F.coalesce("owner", "before").alias("owner")),
        "chain",
    )


_FIELDS = {
    "record_type": b"warc-type", "record_id": b"warc-record-id", "refers_to": b"warc-refers-to",
    "target_uri": b"warc-target-uri", "declared_digest": b"warc-payload-digest",
}
_RECORD = "file string, block long, at long, " + ", ".join(f"{k} string" for k in _FIELDS) + ", payload binary"


def _parsed(rows: DataFrame) -> DataFrame:
    """Records of whole pieces (file, block, at, value)."""

    def parse(batches):
        schema = pa.schema(
            [("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), *((k, pa.string()) for k in _FIELDS), ("payload", pa.binary())]
        )
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, rows = batch.slice(lo, 256), []
                for n in range(part.num_rows):
                    file, block, at, value = (part.column(k)[n].as_py() for k in range(4))
                    head, size = _head(memoryview(value))
                    if head == DEAD:
                        continue
                    fields = {}
                    for line in value[: head - _E].split(b"\r\n"):
                        name, _, content = line.partition(b":")
                        fields[name.strip().lower()] = content.strip().decode("utf-8", "replace")
                    rows.append((file, block, at, *(fields.get(k) for k in _FIELDS.values()), value[head : head + size]))
                if rows:
                    columns = zip(zip(*rows, strict=True), schema, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], schema=schema)

    return rows.mapInArrow(parse, _RECORD)


def _numbered(pieces: DataFrame) -> DataFrame:
    """(file, block, at, value) of every piece."""

    def number(batches):
        here, at = None, 0
        for batch in batches:
            sizes = pc.binary_length(batch.column(2)).to_pylist()
            ats = []
            for file, block, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sizes, strict=True):
                if (file, block) != here:
                    here, at = (file, block), 0
                ats.append(at)
                at += size + _D
            columns = [batch.column(0), batch.column(1), pa.array(ats, pa.int64()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "at", "value"])

    return pieces.mapInArrow(number, "file string, block long, at long, value binary")


def read(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """Every record under ``path``: file, type, ids, address, digest, payload.

    ``range_bytes``: of the byte ranges; by default so many that every core gets about four.
    """
    spark = _pinned(spark, path, range_bytes)
    links = chain(_pieces(spark, path))
    inside = written(links.filter("owner IS NOT NULL AND off <> owner"), "inside")
    torn = written(  # pieces that are not a whole record: before the first, or with false magic in them
        links.join(inside.select("file", "owner").distinct(), ["file", "owner"], "left_semi")
        .unionByName(links.filter("owner IS NULL")).select("file", "block", "at", "off", "owner"),
        "torn",
    )
    keys = ["file", "block", "at"]
    rows = _numbered(_pieces(spark, path))
    out = _parsed(rows.join(small(torn.select(*keys)), keys, "left_anti"))
    if inside.limit(1).count():
        parts = rows.join(small(torn.filter("owner IS NOT NULL")), keys)
        whole = parts.groupBy("file", "owner").agg(
            F.array_sort(F.collect_list(F.struct("off", "block", "at", "value"))).alias("parts")
        )
        value = F.aggregate(
            F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.col("parts")[0]["value"],
            lambda done, part: F.concat(done, F.lit(MAGIC).cast("binary"), part["value"]),
        )
        first = F.col("parts")[0]
        out = out.union(_parsed(whole.select("file", first["block"].alias("block"), first["at"].alias("at"), value.alias("value"))))
    return out.drop("block", "at")


def round_trip(
    pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", min_bytes: int = 0,
    range_bytes: int | None = None,
) -> DataFrame:
    """Writes ``pages`` as archives and reads them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to; for revisits size and digest are those of the response they refer to."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, id_col=id_col, html_col=html_col, url_col=url_col, min_bytes=min_bytes)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    records = written(
        read(spark, path, range_bytes).select(
            number("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"),
            base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
            F.substring_index("declared_digest", ":", -1).alias("declared"),
        ),
        "records",
    )
    whole = records.filter("record_type = 'response'")
    stored = written(
        whole.select(F.col("page_id").alias("s_id"), F.col("payload_digest").alias("s_digest"), F.col("payload_bytes").alias("s_bytes")).distinct(),
        "stored",
    )
    on = (F.col("refers_to") == F.col("s_id")) & (F.col("declared") == F.col("s_digest"))
    later = records.filter("record_type = 'revisit'").join(stored, on, "left")
    later = later.select("page_id", F.col("s_bytes").alias("payload_bytes"), F.col("declared").alias("payload_digest"), "record_type", "refers_to")
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).union(later)
