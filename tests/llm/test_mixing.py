import math
import random
import re
from collections import Counter, defaultdict

import pytest

from factloom.llm import mixing


def corpus(n=300):
    rng = random.Random(8)
    vocab = {d: [d + "".join(rng.choices("abcdef", k=3)) for _ in range(40)] for d in ("x", "y", "z")}
    rows = []
    for i in range(n):
        d = rng.choices(["x", "y", "z"], [0.7, 0.2, 0.1])[0]
        words = [rng.choice(vocab[d if rng.random() < 0.9 else rng.choice("xyz")]) for _ in range(rng.randrange(1, 30))]
        rows.append((i, " ".join(words), d))
    return rows


def brute(posterior, tokens, share_targets, rounds=40):
    """Projected gradient over plain lists."""
    total = sum(tokens)
    k = len(share_targets)
    share = [sum(n * p[j] for n, p in zip(tokens, posterior)) / total for j in range(k)]
    x = [1.0] * len(tokens)
    for _ in range(rounds):
        got = [sum(n * p[j] * r for n, p, r in zip(tokens, posterior, x)) / total for j in range(k)]
        off = [(a - b) / s for a, b, s in zip(got, share_targets, share)]
        if all(abs(a - b) <= 1e-4 * max(b, 1e-9) for a, b in zip(got, share_targets)):
            break
        x = [max(0.0, r - sum(a * b for a, b in zip(p, off))) for r, p in zip(x, posterior)]
    return x


@pytest.mark.parametrize("targets", [{"x": 0.2, "y": 0.5, "z": 0.3}, {"x": 1.0}])
def test_rates_meet_targets_and_equal_brute_force(spark, targets):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i,) for i in range(0, 300, 2)], "doc_id long")
    plain = docs.select("doc_id", "text")
    labelled = docs.filter("doc_id % 2 = 0").selectExpr("lang AS domain", "text")
    names, priors, weights = mixing.train(labelled)
    members = mixing.posteriors(plain, names, priors, weights).orderBy("doc_id").collect()
    goal = [targets.get(d, 0.0) for d in names]
    want = brute([m.p for m in members], [m.tokens for m in members], goal)
    got = mixing.mix(docs, labels, targets=targets).orderBy("doc_id").collect()
    assert [m.tokens for m in members] == [len(t.split()) for _, t, _ in rows]
    for a, b in zip(got, want, strict=True):
        assert a.rate >= 0 and abs(a.rate - b) < 1e-6
        assert abs(a.copies - a.rate) <= 1
    total = sum(m.tokens for m in members)
    for j, d in enumerate(names):
        reached = sum(m.tokens * m.p[j] * g.rate for m, g in zip(members, got)) / total
        if len(targets) == 3:
            assert abs(reached - targets[d]) < 1e-3


def test_posteriors_equal_naive_bayes_without_hashing(spark):
    rows = corpus()
    labelled = spark.createDataFrame([(d, t) for _, t, d in rows], "domain string, text string")
    names, priors, weights = mixing.train(labelled, buckets=1 << 16)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {m.doc_id: m.p for m in mixing.posteriors(docs, names, priors, weights, 1 << 16).collect()}
    counts, words, docs_of = defaultdict(Counter), Counter(), Counter(d for *_, d in rows)
    for _, t, d in rows:
        counts[d].update(t.split())
        words[d] += len(t.split())
    for i, t, _ in rows:
        s = [
            math.log(docs_of[d] / len(rows)) + sum(math.log((counts[d][w] + 0.5) / (words[d] + 0.5 * (1 << 16))) for w in t.split())
            for d in names
        ]
        e = [math.exp(v - max(s)) for v in s]
        assert all(abs(a - b / sum(e)) < 1e-6 for a, b in zip(got[i], e))


def test_growing_mix_and_odd_rows(spark):
    rows = [r + ("c",) for r in corpus()] + [(900, None, None, "c"), (901, "", "x", "c"), (None, "xabc", "x", "c")]
    rows += [rows[3], (902, "xaaa " * 100000, "x", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rate string")
    labels = spark.createDataFrame([(i, "c") for i in range(0, 300, 2)] + [(None, "c")], "doc_id long, text string")
    got = mixing.mix(docs, labels, grow=True).collect()
    assert len(got) == len(rows) and min(r.rate for r in got if r.membership > 0.999) > 0.98
    out = mixing.mixed(docs, labels, grow=True)
    assert out.columns == docs.columns
    copies = {r.doc_id: r.copies for r in got}
    repeats = Counter(r[0] for r in rows)
    want = Counter({i: n * repeats[i] for i, n in copies.items() if n})
    assert Counter(r.doc_id for r in out.collect()) == want
    assert mixing.mix(docs.limit(0), labels).count() == 0
    none = mixing.mix(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and {r.rate for r in none} == {1.0}
    words = re.compile(r"[^\x20\x09-\x0D]+")
    assert all(r.tokens == len(words.findall(dict((a, b) for a, b, *_ in rows)[r.doc_id] or "")) for r in got)


def test_growing_mix_drops_no_document(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    got = mixing.mix(docs, docs.select("doc_id").filter("doc_id % 2 = 0"), grow=True).collect()
    assert min(r.rate for r in got) >= 1 and min(r.copies for r in got) >= 1


def test_odd_column_names(spark):
    extra = ["__id", "__hash", "__copies", "key", "digest", "copies", "a.b", "domain", "P"]
    rows = corpus(80)
    docs = spark.createDataFrame([(*r, *range(len(extra))) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"`{c}` long" for c in extra))
    labels = docs.select("doc_id").filter("doc_id % 2 = 0")
    out = mixing.mixed(docs, labels, grow=True)
    assert out.columns == docs.columns
    assert all(tuple(r)[3:] == tuple(range(len(extra))) for r in out.collect())
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.copies for r in mixing.mix(docs, labels, grow=True).collect()})
