import random
import zlib

import numpy as np

from factloom.llm import linear, toxicity


def corpus(n=1500):
    rng = random.Random(2)
    plain = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    bad = ["nastyword", "vileword", "foulword"]
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.15
        words = rng.choices(plain, k=40) + (rng.choices(bad, k=3) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    # labels of the held-out fold are turned round: learning from any of them would show
    fold = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    labels = [(i, 1 - y if fold(i) else y, "x") for i, _, y in rows if i % 2 or y] + [(None, 1, "x"), (10**6, 1, "x")]
    table = [(i, t, "en") for i, t, _ in rows] + [(5000, None, "en"), (5001, "", "en"), (None, "nastyword", None)]
    table += [(3, rows[3][1], "en"), (5002, "nastyword " * 60000, "en")]
    docs = spark.createDataFrame(table, "doc_id long, text string, key string")
    got = toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int, text string"), max_positive=150, max_unlabelled=600).collect()
    assert len(got) == len(table)
    assert all(r.held_out == fold(r.doc_id) for r in got if r.doc_id is not None)
    truth = {i: y for i, _, y in rows}
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[5000].score == by_id[5001].score < 0.7 and by_id[5002].predicted == 1


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, none).collect()] == [0.0]
    some = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs.limit(0), some).count() == 0


def test_risk_is_corrected_for_the_prior():
    """With unlabelled text that is all positive at the prior, the model still tells the classes apart."""
    pos = [np.array([1]) for _ in range(50)]
    unl = [np.array([1]) if i % 10 < 3 else np.array([2]) for i in range(500)]  # exactly the prior
    active, w, v = toxicity.train(pos, unl, 0.3)
    score = dict(zip(active.tolist(), linear.sigmoid(w + v[0]), strict=True))
    assert score[1] > 0.9 and score[2] < 0.1


def test_risk_and_gradients_equal_brute_force():
    rng = np.random.default_rng(3)
    sets = [[np.sort(rng.choice(12, rng.integers(1, 6), replace=False)).astype(np.int32) for _ in range(n)] for n in (9, 25)]
    active = np.arange(0, 12, 2)
    p, u = (linear.Design(rows, np.ones((len(rows), 1)), active) for rows in sets)
    loss = lambda z, y: np.log1p(np.exp(-z if y else z))
    for prior in (0.1, 0.45, 0.9):
        x = [rng.standard_normal(len(active)), rng.standard_normal(1)]

        def score(rows, x):
            return [sum(x[0][k] for k, b in enumerate(active) if b in row) + x[1][0] for row in rows]

        def parts(x):
            zp, zu = score(sets[0], x), score(sets[1], x)
            known = prior * sum(loss(z, 1) for z in zp) / len(zp)
            return known, sum(loss(z, 0) for z in zu) / len(zu) - prior * sum(loss(z, 0) for z in zp) / len(zp)

        zp, zu = p.dot(*x), u.dot(*x)
        assert np.allclose(toxicity.risk(zp, zu, prior), parts(x))
        goal = (lambda x: sum(parts(x))) if parts(x)[1] >= 0 else (lambda x: -parts(x)[1])
        for k, got in enumerate(toxicity.gradients(p, u, x, prior, 0.0)):
            for i in range(len(got)):
                step = [v.copy() for v in x]
                step[k][i] += 1e-6
                up = goal(step)
                step[k][i] -= 2e-6
                assert abs(got[i] - (up - goal(step)) / 2e-6) < 1e-5


def test_prior_is_estimated_without_negatives():
    rng = np.random.default_rng(6)

    def text(toxic):
        words = rng.choice(200, 30, replace=False).tolist()
        return np.array(sorted({*words, *(rng.choice(np.arange(200, 206), 3) if toxic else [])}), dtype=np.int32)

    positive = [text(True) for _ in range(400)]
    for share in (0.05, 0.2):
        unlabelled = [text(i < share * 2000) for i in range(2000)]
        found = toxicity.estimated_prior(positive, [unlabelled[i] for i in rng.permutation(2000)])
        assert 0.75 * share < found < 1.5 * share
