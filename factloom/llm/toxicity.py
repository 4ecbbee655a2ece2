"""Toxicity by non-negative positive-unlabelled learning.

Method: the only labels are confirmed toxic examples; everything else is unlabelled text in which
toxic text hides at the class prior.  A linear model on hashed word features is trained in numpy on
the prior-corrected risk  prior * R(positive as 1) + max(0, R(unlabelled as 0) - prior * R(positive
as 0)); where the corrected part would turn negative its gradient is stepped back, so that the model
cannot win by overfitting the positives.  The class prior is estimated from the same two sets, without
any negative label: the share of unlabelled text in the region where a separator trained on one half
puts the other half's positives bounds it from above, and the least such bound is taken.

Scale: training takes at most ``max_positive`` confirmed and ``max_unlabelled`` other texts, one for
an id and at most ``linear.MAX_FEATURES`` features of each (documented bounds, chosen by hash so that
they do not depend on partitions), found by a broadcast of their ids; features are made where the
texts are.  Scoring is one map over all whole texts with the weights alone shipped; nothing is
shuffled.

Defined cases: null, empty and unknown texts get the model's score of no evidence; a null id is
never held out; with no confirmed example every score is 0; repeated rows are scored alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import col


def held_out(id_col: str | Column) -> Column:
    """Whether a row belongs to the fold whose labels are never learnt from."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 600, decay: float = 1e-4, corrected: bool = True):
    """(active buckets, weights, bias) by the non-negative risk with the logistic loss; uncorrected it
    only separates the two sets."""
    active = linear.telling(positive, unlabelled)
    ones = lambda rows: np.ones((len(rows), 1))
    p = linear.Design(positive, ones(positive), active)
    u = linear.Design(unlabelled, ones(unlabelled), active)

    def step(x):
        return gradients(p, u, x, prior, decay, corrected)

    start = [np.zeros(len(active)), np.array([np.log(prior / (1 - prior))])]
    w, v = linear.adam(step, start, rounds)
    return active, w, v


def gradients(p: linear.Design, u: linear.Design, x: list[np.ndarray], prior: float, decay: float, corrected: bool = True) -> list[np.ndarray]:
    """Gradients of the risk at weights and bias ``x``; where the corrected part is negative, back along it."""
    w, v = x
    zp, zu = p.dot(w, v), u.dot(w, v)
    sp, su = linear.sigmoid(zp), linear.sigmoid(zu)
    gu, gp, known = u.back(su / u.size), p.back(sp / p.size), p.back((sp - 1) / p.size)
    if not corrected:
        return [prior * k + (1 - prior) * g + decay * y for k, g, y in zip(known, gu, (w, 0 * v), strict=True)]
    hidden = [a - prior * b for a, b in zip(gu, gp, strict=True)]
    if risk(zp, zu, prior)[1] < 0:
        return [-h for h in hidden]
    return [prior * k + h + decay * y for k, h, y in zip(known, hidden, (w, 0 * v), strict=True)]


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk of the positives, corrected risk of the unlabelled before it is held at zero)."""
    return prior * float(np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def estimated_prior(positive: list[np.ndarray], unlabelled: list[np.ndarray], least: float = 0.2, z: float = 1.0) -> float | None:
    """Share of positives among the unlabelled, from the two sets alone.

    In any region the unlabelled hold at least the prior times the positives' share, so the least ratio
    of the two shares over regions is an upper bound, and tight where negatives are absent.  Regions are
    score ranges of a separator fitted to half of each set, on the other half, that hold ``least`` of the
    positives; ``z`` standard errors are added, so that a range empty by chance does not decide.
    """
    if len(positive) < 10 or len(unlabelled) < 10:
        return None
    found = []
    for side in (0, 1):
        p, u = positive[side::2], unlabelled[side::2]
        active, w, v = train(p, u, 0.5, rounds=150, corrected=False)
        test = [linear.Design(rows, np.ones((len(rows), 1)), active).dot(w, v) for rows in (positive[1 - side :: 2], unlabelled[1 - side :: 2])]
        zp, zu = np.sort(test[0]), np.sort(test[1])
        n, m = len(zp), len(zu)
        cut = zp[: n - int(np.ceil(least * n)) + 1]  # each leaves that share of the positives above it
        a = (n - np.searchsorted(zp, cut)) / n
        b = (m - np.searchsorted(zu, cut)) / m
        found.append(float(((b + z * np.sqrt((b + 1 / m) * (1 - b) / m)) / a).min()))
    return min(0.99, max(1 / len(unlabelled), sum(found) / 2))


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    prior: float | None = None, max_positive: int = 4000, max_unlabelled: int = 12000,
) -> linear.Scorer:
    """Learn from rows outside the held-out fold; of the labels only the confirmed ones are read.
    Without ``prior`` it is estimated."""
    known = labels.select(col(id_col).alias("key"), col(label_col).alias("label"))
    known = known.filter((F.col("label") == 1) & F.col("key").isNotNull() & ~held_out("key"))
    confirmed = linear.sampled(known.select("key"), "key", max_positive)
    open_ids = docs.select(col(id_col).alias("key")).filter(F.col("key").isNotNull() & ~held_out("key"))
    others = linear.sampled(open_ids, "key", max_unlabelled)
    ids = confirmed.withColumn("kind", F.lit(1)).union(others.withColumn("kind", F.lit(0)))
    # at most max_positive + max_unlabelled rows
    rows = linear.collected(linear.one_text(docs, ids, id_col, text_col), "text", ["key", "kind"]).sort_values(["kind", "key"])
    features = [np.frombuffer(b, dtype=np.int32) for b in rows["features"]]
    kinds = rows["kind"].to_numpy()
    positive = [f for f, k in zip(features, kinds, strict=True) if k == 1]
    unlabelled = [f for f, k in zip(features, kinds, strict=True) if k == 0]
    if not positive or not unlabelled:
        return linear.Scorer(np.zeros(0, dtype=np.int64), np.zeros(0), np.array([-np.inf]))
    if prior is None:
        prior = estimated_prior(positive, unlabelled) or len(positive) / (len(positive) + len(unlabelled))
    active, w, v = train(positive, unlabelled, min(0.99, prior))
    return linear.Scorer(active, w, v)


def score(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7,
    **options,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)

    @F.pandas_udf("double")
    def toxic(text: pd.Series) -> pd.Series:
        z = np.array([model(t) for t in text], dtype=float)
        return pd.Series(np.where(np.isneginf(z), 0.0, linear.sigmoid(z)))

    scored = docs.select(
        col(id_col).alias("doc_id"), held_out(col(id_col)).alias("held_out"), toxic(col(text_col)).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
