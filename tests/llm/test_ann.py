import math

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import ann


def brute(rows, query, k):
    own = rows[query]
    found = sorted((float(np.sqrt(((own - v) ** 2).sum())), i) for i, v in rows.items() if i != query)
    return found[:k]


def test_parts_are_equal_and_follow_the_graph():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((64, 8)) + 20 * np.eye(8)[c] for c in range(4)])
    part = ann.balanced_parts(ann.neighbours(x, 8), 4)
    assert np.bincount(part).tolist() == [64] * 4
    assert all(len(set(part[c * 64 : c * 64 + 64].tolist())) == 1 for c in range(4))


def test_small_tables_are_exact_with_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = {i: np.round(rng.standard_normal(4), 1).astype(np.float32).astype(float) for i in range(300)}
    rows[7] = rows[100].copy()  # ties with a query
    rows[8] = rows[100].copy()
    table = [(i, v.tolist(), "x") for i, v in rows.items()] + [(200, rows[200].tolist(), "x")]
    table += [(1000, None, "x"), (1100, [0.0] * 4, "x"), (1200, [1.0, None, 2.0, 3.0], "x"), (None, [1.0] * 4, "x")]
    table += [(1300, [1.0, math.nan, 2.0, 3.0], "x"), (1400, [math.inf, 1.0, 1.0, 1.0], "x"), (1500, [1.0, 2.0], "x"), (1600, [], "x")]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<float>, part string")
    got = ann.search(frame, F.col("vec_id") % 100 == 0).collect()
    assert {r.query_id for r in got} == {0, 100, 200}
    for q in (0, 100, 200):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in mine] == brute(rows, q, 10)
    few = ann.search(frame.filter("vec_id < 4"), F.col("vec_id") % 100 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]
    assert ann.search(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_recall_against_brute_force_with_a_hot_part(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16)) * 3
    x = np.concatenate([centres[rng.integers(0, 20, 1600)] + rng.standard_normal((1600, 16)), centres[0] + 0.01 * rng.standard_normal((800, 16))])
    rows = {i: v.astype(np.float32).astype(float) for i, v in enumerate(x)}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<float>")
    got = ann.search(frame, F.col("vec_id") % 40 == 0, part_rows=150, max_sample=1024, block_rows=100, block_queries=8).collect()
    hits = total = 0
    for q in range(0, 2400, 40):
        want = {i for _, i in brute(rows, q, 10)}
        mine = [r for r in got if r.query_id == q]
        assert len(mine) == 10
        for r in mine:
            assert abs(r.score - np.sqrt(((rows[q] - rows[r.vec_id]) ** 2).sum())) < 1e-12
        hits, total = hits + len(want & {r.vec_id for r in mine}), total + 10
    assert hits / total >= 0.9
