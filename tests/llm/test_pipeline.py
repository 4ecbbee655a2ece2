import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from factloom.llm import mixing, quality, simhash
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_simhash import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs, after)
        docs = after
    return out


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_all_but_the_last_keep_the_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name


def test_quality(spark, stages):
    before, after = stages["quality classifier"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdicts = quality.classify(before, labels).collect()
    assert ids(after) == sorted(r.doc_id for r in verdicts if r.kept)
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert len(good - set(ids(after))) <= 0.02 * len(good)


def test_lines(stages):
    before, after = stages["line dedup"]
    want = {(i, h) for i, _, _, h in brute_lines([(r.doc_id, r.text) for r in before.collect()])}
    assert {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in after.collect()} == want


def test_near_copies(stages):
    """Texts are copies whose five-word shingles are similar by 0.8 or more, among fingerprints within 11 bits."""
    before, after = stages["SimHash near-dedup"]
    rows = {r.doc_id: r.text for r in before.collect()}
    sets = {i: simhash.shingle_set(t) for i, t in rows.items()}
    prints = {i: simhash.fingerprint(t)[0] for i, t in rows.items()}

    def near(i, j):
        return bin(prints[i] ^ prints[j]).count("1") <= 11 and simhash.similarity(sets[i], sets[j]) >= 0.8

    assert ids(after) == sorted(set(brute_components({i: i for i in rows}, near).values()))


def test_mixing(spark, stages):
    before, after = stages["mixing to target weights"]
    copies = mixing.mix(before, spark.read.parquet(f"{SF}/labels.parquet"), grow=True)
    want = Counter({r.doc_id: r.copies for r in copies.collect() if r.copies})
    assert Counter(ids(after)) == want and set(want) == set(ids(before))


def test_packing(stages):
    before, after = stages["best-fit packing"]
    pieces = after.collect()
    places = Counter()
    for r in pieces:
        places[r.sequence_id] += r.length
    assert max(places.values()) <= 2048
    total = sum(places.values())
    assert len(places) <= -(-total // 2048) * 1.05 + 1
    assert after.filter("start = 0").count() == before.count()


def test_run_is_the_stages_one_after_the_other(spark, stages):
    cells = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF).select(*cells)
    want = stages["best-fit packing"][1].select(*cells)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert got.agg(F.sum("length")).first() == want.agg(F.sum("length")).first()


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents_pass_every_stage(spark, tmp_path, empty):
    long = "Ein langer Satz mit vielen verschiedenen Wörtern darin, der Absatz %d.\n"
    rows = [
        (1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (3, " \n\t", "en", "s", 3, "x"), (None, long % 7 * 3, "de", None, 5, "x"),
        (4, "".join(long % i for i in range(3000)), "de", "s", 9, "x"), (5, "same words here and there again", "en", "s", 9, "x"),
        (5, "same words here and there again", "en", "s", 9, "x"), (6, "same words here and there again", None, "s", 9, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rate string")
    docs = docs.limit(0) if empty else docs
    before = None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns, name
        if empty:
            assert after.count() == 0, name
        before, docs = docs, after
    if not empty:
        held = {r.doc_id for r in before.collect()}
        assert 4 in held and not {5, 6} <= held
        assert {r.doc_id for r in docs.collect()} == held
