import collections
import math
import random
import re

from factloom.llm import rules


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
        len(covered), len(lines), sum(a == b for a, b in zip(words, words[1:])),
    )


def texts():
    rng = random.Random(3)
    words = ["alpha", "bété", "gamma", "de|ta", "eps", "zeta", "#eta", "theta"]
    out = [None, "", " \n\t\x0b", "one", "a b c d e a b c d e", "x\nx \nx\n\nx", "a\x85b c\xa0d", "w " * 3000]
    return out + [" ".join(rng.choice(words) + rng.choice(["", "", "\n"]) for _ in range(rng.randrange(60))) for _ in range(80)]


def test_counts_equal_brute_force():
    for text in texts():
        assert rules.text_counts(text) == brute_counts(text)
    many = [f"w{i % 7001}" for i in range(15000)]  # too many distinct words for one code
    assert rules.repeated_words([w.encode() for w in many]) == brute_counts(" ".join(many))[4]


def quantile(values, q):
    values = sorted(values)
    return values[max(0, math.ceil(q * len(values)) - 1)]


def test_verdicts_follow_group_thresholds(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        lang, source = ("en", "hot") if i < 600 else ("en", None) if i < 890 else ("fr", "few")
        share = 0.3 if source is None else 0.0  # one source is full of symbols
        text = " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(4, 9))) + ("#" if rng.random() < share else "") for _ in range(60))
        rows.append((i, text + ("".join(" " + "#" * rng.randrange(1, 20) for _ in range(9)) if i % 50 == 7 and source == "hot" else ""), lang, source, "clash"))
    rows += [(1000, None, None, None, "c"), (1001, "", "en", "hot", "c"), (5, rows[5][1], "en", "hot", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fences string")
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    counted = {r[0]: brute_counts(r[1]) for r in rows}
    for doc_id, *_ in rows:
        assert tuple(got[doc_id][c] for c in rules.COUNTS) == counted[doc_id]
    measure = {
        "symbols": (lambda b: 1000 * b[2] / max(b[1], 1), 10), "dup_lines": (lambda b: 1000 * b[3] / (b[5] + 10), 100),
        "repeats": (lambda b: 1000 * b[4] / max(b[0], 1), 150), "stutter": (lambda b: 1000 * b[6] / max(b[0], 1), 50),
        "word_length": (lambda b: 1000 * b[1] / max(b[0], 1), 500),
    }
    far = math.log(2500) / math.log(2)  # one in ten thousand, from the quantiles 0.5 and 0.75
    good = [r for r in rows if not got[r[0]].base_failed]
    sure = collections.Counter()
    inside = {r[0]: True for r in good}
    doubtful = set()
    for lang, source in {r[2:4] for r in good}:
        for metric, (value, slack) in measure.items():
            q = None
            for level in (lambda r: True, lambda r: r[2] == lang, lambda r: r[2:4] == (lang, source)):
                values = [value(counted[r[0]]) for r in good if level(r)]
                own = [quantile(values, x) for x in (0.25, 0.5, 0.75)]
                q = own if q is None else [(len(values) * a + 100 * b) / (len(values) + 100) for a, b in zip(own, q)]
            high, low = q[2] + (q[2] - q[1]) * far + slack, q[0] - (q[1] - q[0]) * far - slack
            for r in good:
                if r[2:4] == (lang, source):
                    x = value(counted[r[0]])
                    if abs(x - high) < 0.06 * high or (metric == "word_length" and abs(x - low) < 0.06 * abs(low)):
                        doubtful.add(r[0])  # within the error of the sketch
                    inside[r[0]] &= x <= high and (metric != "word_length" or x >= low)
    for r in good:
        if r[0] not in doubtful:
            assert got[r[0]].kept == inside[r[0]], r[0]
            sure[inside[r[0]]] += 1
    assert sure[True] > 700 and sure[False] >= 12
    assert not got[1000].kept and got[1000].base_failed and not got[1001].kept
    assert sum(not got[i].kept for i in range(600)) == 12  # what the hot source has and the other has by nature
    assert sum(not got[i].kept for i in range(600, 890)) <= 3
    assert rules.judge(docs.limit(0)).count() == 0


def test_every_threshold_can_reject(spark):
    """In clean company, one document for each metric that the base rules let pass."""
    rng = random.Random(2)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(4, 9))) for _ in range(n))
    rows = [(i, "\n".join(line(12) for _ in range(6))) for i in range(400)]
    again = line(9)
    rows += [
        (1000, line(60) + " ###" * 3), (1001, "\n".join([line(6), *["same four words here"] * 9])), (1002, " ".join([line(66), again, line(16), again])),
        (1003, " ".join(w for k, w in enumerate(line(60).split()) for _ in range(2 if k % 6 == 0 else 1))), (1004, " ".join("x" * 30 for _ in range(1)) + " " + " ".join("y" * 25 + str(k) for k in range(40))),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    assert all(got[i].kept for i in range(400))
    assert {i for i in range(1000, 1005) if not got[i].kept} >= {1000, 1002, 1003, 1004}
    assert not got[1002].base_failed and not got[1003].base_failed
