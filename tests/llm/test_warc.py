import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def rows():
    out = [(i, f"http://h/{i} x\r\n", f"<p>page {i} é " + "t" * (i * 37 % 400)) for i in range(60)]
    out += [(100, None, None), (101, "u", ""), (102, "u", FAKE), (103, "u", "a" + FAKE * 3 + "WARC/1.1\r\n"), (104, "u", "WARC/1.1\r\n")]
    out += [(105, "u", FAKE + "x" * 3000 + FAKE), (106, "u", "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n"), (107, "u", "\r\n\r\nWARC/1.1\r\n\r\n")]
    out += [(200 + i, "u", out[5][2]) for i in range(10)] + [(3, "u", out[40][2]), (None, "u", "nobody"), (300, "u", "z" * 20000)]
    return out + [(7, "u", out[7][2])]


def brute(table, min_bytes=0):
    data = [(i, (h or "").encode()) for i, _, h in table]
    least = {}
    for i, b in data:
        if i is not None and len(b) >= min_bytes:
            least[b] = min(i, least.get(b, i))
    out = []
    for i, b in data:
        first = least.get(b, i) if len(b) >= min_bytes else i
        again = first is not None and i != first
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out.append((i, len(b), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [None, 600, 4000])
def test_round_trip_equals_brute_force(spark, split):
    pages = spark.createDataFrame([r + ("c",) for r in rows()], "page_id long, url string, html string, value string")
    pages = pages.repartition(3, F.coalesce("page_id", F.lit(0)))
    for least in (0, 300):
        got = warc.round_trip(pages, min_bytes=least, range_bytes=split).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows(), least)


def test_settings_may_change_between_plan_and_action(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write(spark.createDataFrame(rows(), "page_id long, url string, html string").repartition(2), path)
    found = warc.read(spark, path, 700)
    keys = {"spark.sql.files.maxPartitionBytes": "333", "spark.sql.files.minPartitionNum": "50", "spark.sql.files.openCostInBytes": "100"}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        # also as the other side of a plan of the caller's own session
        ids = spark.range(1).select(F.lit("<urn:page:1>").alias("record_id"))
        assert ids.join(found, "record_id").count() == 1
        got = found.collect()
    finally:
        for key in keys:
            spark.conf.unset(key)
    texts = {(f"<urn:page:{'null' if i is None else i}>", (h or "").encode()) for i, _, h in rows()}
    assert len(got) == len(rows())
    assert all(r.record_type == "revisit" or (r.record_id, bytes(r.payload)) in texts for r in got)


def test_payloads_come_back_whole_and_fakes_are_no_records(spark, tmp_path):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write(pages, path)
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "archive").glob("part-*")))
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows())
    assert not any(r.record_id == "<urn:page:999>" for r in got)
    texts = {(f"<urn:page:{'null' if i is None else i}>", (h or "").encode()) for i, _, h in rows()}
    for r in got:
        assert r.record_type == "revisit" or (r.record_id, bytes(r.payload)) in texts
    assert next(r for r in got if r.record_id == "<urn:page:1>").target_uri == "http://h/1%20x%20%20"


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 0
