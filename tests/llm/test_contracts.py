"""The registered queries themselves: columns, types and rows, over small tables with odd rows."""

import math
import zlib

import numpy as np
import pytest

from factloom.llm import mixing, queries, quality, simhash

SF = "/root/testdata/sf0.001"
EXTRA = ", part int, `a.b` int, fp int, evidence int"


def store(spark, folder, name, rows, schema):
    width = len(schema.split(", "))
    frame = spark.createDataFrame([(*r[:width], 1, 2, 3, 4) for r in rows], schema + EXTRA)
    frame.repartition(2).write.parquet(str(folder / f"{name}.parquet"))


def types(frame):
    return {f.name: f.dataType.simpleString() for f in frame.schema.fields}


def test_op1_gives_the_nearest_with_recall(spark):
    """Recall of the query's own output over a whole table."""
    sf = "/root/testdata/sf0.1"
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None}
    frame = queries.op1_ann(spark, sf)
    assert {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}.items() <= types(frame).items()
    got = {}
    for r in frame.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    usable = {i: v for i, v in rows.items() if np.isfinite(v).all() and v.any()}
    ids, base = np.array(list(usable)), np.stack(list(usable.values()))
    assert set(got) == {i for i in usable if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        far = np.sqrt(((base - usable[q]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        best = {int(ids[k]) for k in np.lexsort((ids, far))[:10]}
        found = sorted(found)
        assert [f[0] for f in found] == list(range(1, 11))
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        assert all(math.isclose(s, np.sqrt(((usable[v] - usable[q]) ** 2).sum()), rel_tol=1e-12) for _, v, s in found)
        hits += len(best & {f[1] for f in found})
    assert hits >= 0.9 * 10 * len(got)


def test_op2_and_op4_give_a_row_a_document(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    frame = queries.op2_quality(spark, SF)
    assert sorted(r.doc_id for r in frame.collect()) == ids and types(frame)["kept"] == "boolean"
    assert {r.doc_id: r.kept for r in frame.collect()} == {r.doc_id: r.kept for r in quality.classify(docs, labels).collect()}
    mixed = queries.op4_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in mixed) == ids
    assert {(r.doc_id, r.copies) for r in mixed} == {(r.doc_id, r.copies) for r in mixing.mix(docs, labels).collect()}


def test_op5_follows_its_threshold_and_fold(spark, tmp_path):
    rows = [(i, ("nasty " if i % 4 == 0 else "") + f"w{i % 7} x{i % 11} y{i % 5}", "en", "s") for i in range(400)]
    rows += [(1000, None, None, None), (1001, "", "en", "s"), (None, "nasty", "en", "s")]
    store(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string")
    store(spark, tmp_path, "labels", [(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    frame = queries.op5_toxicity(spark, str(tmp_path))
    assert {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}.items() <= types(frame).items()
    got = frame.collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) > 0.95 * len(held)


def test_op7_renders_every_page(spark, tmp_path):
    rows = [(1, "u", "<p>a<p>b"), (2, "u", None), (3, "u", ""), (None, "u", "<b>x</b>"), (1, "u", "<p>a<p>b")]
    store(spark, tmp_path, "pages", rows, "page_id long, url string, html string")
    got = queries.op7_layout(spark, str(tmp_path)).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "a\n\nb", 4), ("1", "a\n\nb", 4), ("2", "", 0), ("3", "", 0), ("None", "x", 1)]


def test_op10_writes_fingerprints_in_hex(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (2, text.upper()), (3, None), (4, ""), (5, "some other words of a text"), (6, text + " tail")]
    store(spark, tmp_path, "documents", rows, "doc_id long, text string")
    frame = queries.op10_simhash(spark, str(tmp_path))
    assert {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}.items() <= types(frame).items()
    got = {r.doc_id: r for r in frame.collect()}
    for i, t in rows:
        assert got[i].fingerprint == f"{simhash.fingerprint(t)[0]:016x}"
    assert got[1].component_id == got[2].component_id == 1 and got[3].component_id == got[4].component_id == 3


@pytest.mark.parametrize("name", ["op3_warc", "op6_linededup", "op8_rules"])
def test_the_others_take_odd_tables(spark, tmp_path, name):
    docs = [(1, "a line of text\nanother", "en", "s"), (2, None, None, None), (None, "", "en", None), (1, "a line of text\nanother", "en", "s")]
    store(spark, tmp_path, "documents", docs, "doc_id long, text string, lang string, source string")
    store(spark, tmp_path, "pages", [(1, "u", "<p>x"), (2, None, None), (3, "u", "<p>x")], "page_id long, url string, html string")
    assert queries.queries()[name](spark, str(tmp_path)).count() == (3 if name == "op3_warc" else 4)
