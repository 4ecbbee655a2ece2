import math
import random

import numpy as np

from factloom.llm import linear, quality


def corpus(n=1200):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(200)]
    rows = []
    for i in range(n):
        host = "hot" if i % 3 else f"h{i % 20}"
        good = rng.random() < (0.95 if host in ("hot", "h3") else 0.3)
        text = " ".join(w if good else w + rng.choice(["###", "&&&"]) for w in rng.choices(words, k=30))
        if i % 40 == 0:
            text = "short text only"  # no evidence: the site decides
        rows.append((i, text, host, None if i % 50 == 0 else "p", int(good)))
    return rows


def test_held_out_accuracy_and_shrinkage(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:4] + ("c",) for r in rows], "doc_id long, text string, source string, lang string, docs string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] % 2], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [r for r in rows if not r[0] % 2 and r[0] % 40]
    assert np.mean([got[r[0]].kept == bool(r[4]) for r in held]) > 0.98
    assert got[1].host_rate > 0.85 and got[9].host_rate < 0.7  # h9
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_site_rates_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(f"h{rng.randrange(6)}", rng.choice(["a", "b", None]), rng.uniform(-3, 3)) for _ in range(400)]
    rows += [("one", "a", 8.0)]
    scored = spark.createDataFrame(rows, "host string, path string, llr double")
    prior = 0.7
    got = {(r.host, r.path): r for r in quality.sites(scored, prior).collect()}
    p = [1 / (1 + math.exp(-(z + math.log(prior / (1 - prior))))) for *_, z in rows]
    n = len(rows)
    m = sum(p) / n
    hosts, paths = {}, {}
    for (h, q, _), x in zip(rows, p):
        hosts.setdefault(h, []).append(x)
        paths.setdefault((h, q), []).append(x)
    s = sum(len(v) * (np.mean(v) - m) ** 2 for v in hosts.values()) / (m * (1 - m))
    k = quality._strength(s, len(hosts) - 1, n - sum(len(v) ** 2 for v in hosts.values()) / n - (len(hosts) - 1))
    host = {h: (sum(v) + k * m) / (len(v) + k) for h, v in hosts.items()}
    s = sum(len(v) * (np.mean(v) - np.mean(hosts[h])) ** 2 for (h, _), v in paths.items()) / (m * (1 - m))
    room = n - sum(len(v) ** 2 / len(hosts[h]) for (h, _), v in paths.items()) - (len(paths) - len(hosts))
    kp = quality._strength(s, len(paths) - len(hosts), room)
    for (h, q), v in paths.items():
        assert abs(got[h, q].host_rate - host[h]) < 1e-6
        assert abs(got[h, q].path_rate - (sum(v) + kp * host[h]) / (len(v) + kp)) < 1e-6


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "h", "p"), (None, "some words here", "h", "p"), (3, "w " * 50000, "h", None), (3, "w " * 50000, "h", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(docs, none).collect()
    assert len(got) == 5 and all(r.evidence == 0 and r.kept for r in got)
    assert quality.classify(docs.limit(0), none).count() == 0
    assert quality.keep_good(docs, none).count() == 5


def test_odd_column_names(spark):
    extra = ["__host", "__docs", "__rate", "__llr", "evidence", "host", "path", "docs", "a.b", "Path_Rate"]
    rows = corpus(300)
    docs = spark.createDataFrame([(*r[:4], *range(115, 115 + len(extra))) for r in rows], "doc_id long, text string, source string, lang string, " + ", ".join(f"`{c}` long" for c in extra))
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < 300
    assert all(tuple(r)[4:] == tuple(range(115, 115 + len(extra))) for r in kept.collect())


def test_training_rows_are_bounded_whatever_ids_repeat(spark):
    rows = [(i % 10, f"word{i} text number {i}", i % 2) for i in range(3000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    keys = spark.createDataFrame([(i, i % 2) for i in range(10)], "key long, label int")
    picked = linear.one_text(docs, keys, "doc_id", "text")
    assert picked.count() == 10
    assert sorted(r.key for r in linear.sampled(docs.withColumnRenamed("doc_id", "key").select("key"), "key", 4).collect()) == sorted(
        r.key for r in linear.sampled(docs.repartition(7).withColumnRenamed("doc_id", "key").select("key"), "key", 4).collect()
    )
    assert len(linear.bounded(np.arange(10000, dtype=np.int32), 100)) == 100


def test_verdicts_equal_brute_force(spark):
    """Evidence from the model by itself, then sites and posteriors as the method defines them."""
    rows = corpus(400)
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] % 2], "doc_id long, quality int")
    model, prior = quality.fit(docs, labels), quality._prior(labels, "quality")
    llr = {r[0]: min(8.0, max(-8.0, model(r[1]))) for r in rows}
    scored = spark.createDataFrame([(r[2], r[3], llr[r[0]]) for r in rows], "host string, path string, llr double")
    site = {(r.host, r.path): r for r in quality.sites(scored, prior).collect()}
    for got in quality.classify(docs, labels).collect():
        s, z = site[got.host, got.path], llr[got.doc_id]
        own = 1 / (1 + math.exp(-(z + math.log(prior / (1 - prior)))))
        rate = min(1 - 1e-3, max(1e-3, (s.path_rate * (s.docs + s.path_strength) - own) / (s.docs - 1 + s.path_strength)))
        posterior = 1 / (1 + math.exp(-(z + math.log(rate / (1 - rate)))))
        assert abs(got.evidence - z) < 1e-9 and abs(got.posterior - posterior) < 1e-6 and got.kept == (got.posterior >= 0.5)
