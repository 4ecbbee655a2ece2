"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Method: a logistic document classifier (hashed words and surface measures, trained in numpy on
labelled rows) gives each document's evidence.  Expected good documents are summed by path and host;
beta priors are fitted by moments, and a host's rate is shrunk to the corpus rate, a path's rate to
its host's, the more the fewer documents the site has.  A document's posterior log-odds are its own
log-likelihood ratio plus the log-odds of its path without its own share.

Scale: training takes at most ``max_labelled`` labelled rows, one for an id and at most
``linear.MAX_FEATURES`` features of each (documented bounds, chosen by hash).
Sites are summed with partial aggregation, so a host with a third of all documents costs a row a
task; fitted priors are four numbers.  Sites join back to (id, site, score) rows without texts; the
site table is broadcast only if its measured size allows.

Defined cases: a null or empty text is scored by its surface measures alone; null hosts and paths
are sites of their own; rows with a null id are never trained on but are scored; repeated rows count
as often as they occur; without labelled rows of both classes the evidence is even; an empty table
gives no rows; clashing column names are left alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import col, fresh, small, written


def train(features: list[np.ndarray], shapes: np.ndarray, good: np.ndarray, rounds: int = 600, decay: float = 1e-3):
    """(active buckets, weights, dense weights): class-balanced logistic regression."""
    yes = [f for f, g in zip(features, good, strict=True) if g]
    no = [f for f, g in zip(features, good, strict=True) if not g]
    active = linear.telling(yes, no)
    dense = np.concatenate([np.ones((len(good), 1)), shapes], axis=1)
    design = linear.Design(features, dense, active)
    weight = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum()))

    def step(x):
        w, v = x
        w_grad, v_grad = design.back(weight * (linear.sigmoid(design.dot(w, v)) - good))
        return [w_grad + decay * w, v_grad + decay * 0.01 * v]

    w, v = linear.adam(step, [np.zeros(len(active)), np.zeros(dense.shape[1])], rounds, rate=0.1)
    return active, w, v


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_labelled: int = 8000,
) -> linear.Scorer:
    """The document classifier.  Classes are balanced, so its output is a log-likelihood ratio."""
    known = labels.select(col(id_col).alias("key"), col(label_col).alias("label")).dropna()
    ids = linear.sampled(known.select("key"), "key", max_labelled)
    known = known.join(F.broadcast(ids), "key", "left_semi").groupBy("key").agg(F.max("label").alias("label"))
    rows = linear.collected(linear.one_text(docs, known, id_col, text_col), "text", ["key", "label"], with_shape=True)
    rows = rows.sort_values("key")
    good = rows["label"].to_numpy() == 1
    if not len(rows) or good.all() or not good.any():
        return linear.Scorer(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(1))
    features = [np.frombuffer(b, dtype=np.int32) for b in rows["features"]]
    shapes = np.array([np.frombuffer(b) for b in rows["shape"]])
    active, w, v = train(features, shapes, good)
    return linear.Scorer(active, w, v, with_shape=True)


def evidence(model: linear.Scorer, text: Column) -> Column:
    """The classifier's log-likelihood ratio of a text column, bounded to +-8."""

    @F.pandas_udf("double")
    def ratio(texts: pd.Series) -> pd.Series:
        return pd.Series(np.clip([model(t) for t in texts], -8.0, 8.0), dtype=float)

    return ratio(text)


def _strength(excess: float, groups: float, room: float) -> float:
    """Prior documents of a beta prior by moments, from the scaled spread of group rates."""
    if room <= 0:
        return 1e6
    rho = min(0.999, max(1e-6, (excess - groups) / room))
    return (1 - rho) / rho


def sites(scored: DataFrame, prior: float) -> DataFrame:
    """(host, path, docs, good, host_rate, path_rate, path_strength) from rows (host, path, llr).

    ``prior`` is the share of good documents that turns a log-likelihood ratio into a probability.
    """
    offset = math.log(prior / (1 - prior))
    p = 1 / (1 + F.exp(-(F.col("llr") + F.lit(offset))))
    paths = written(
        scored.groupBy("host", "path").agg(F.count("*").alias("docs"), F.sum(p).alias("good")), "paths"
    )
    hosts = written(
        paths.groupBy("host").agg(
            F.sum("docs").alias("host_docs"), F.sum("good").alias("host_good"),
            F.count("*").alias("host_paths"), F.sum(F.col("docs") * F.col("docs")).alias("squares"),
        ),
        "hosts",
    )
    rate = F.col("host_good") / F.col("host_docs")
    total = hosts.agg(
        F.sum("host_docs").alias("n"), F.sum("host_good").alias("s"), F.count("*").alias("h"),
        F.sum(F.col("host_docs") * F.col("host_docs")).alias("nn"), F.sum("host_paths").alias("p"),
        F.sum(F.col("squares") / F.col("host_docs")).alias("pp"), F.sum(rate * F.col("host_good")).alias("rs"),
    ).first()
    if not total.n:
        return paths.select("*", *(F.lit(0.5).alias(c) for c in ("host_rate", "path_rate", "path_strength")))
    mean = min(1 - 1e-6, max(1e-6, total.s / total.n))
    spread = mean * (1 - mean)
    inner = paths.agg(F.sum(F.col("good") * F.col("good") / F.col("docs"))).first()[0]
    host_k = _strength((total.rs - total.n * mean**2) / spread, total.h - 1, total.n - total.nn / total.n - (total.h - 1))
    path_k = _strength((inner - total.rs) / spread, total.p - total.h, total.n - total.pp - (total.p - total.h))
    hosts = hosts.select(
        F.col("host").alias("k_host"),
        ((F.col("host_good") + host_k * mean) / (F.col("host_docs") + host_k)).alias("host_rate"),
    )
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("k_host"))).drop("k_host")
    shrunk = (F.col("good") + path_k * F.col("host_rate")) / (F.col("docs") + path_k)
    return written(joined.withColumn("path_rate", shrunk).withColumn("path_strength", F.lit(path_k)), "sites")


def _prior(labels: DataFrame, label_col: str) -> float:
    share = labels.agg(F.avg(col(label_col).cast("double"))).first()[0]
    return 0.5 if share is None else min(0.99, max(0.01, share))


def _judged(scored: DataFrame, host: str, path: str, llr: str, prior: float) -> tuple[DataFrame, Column, Column, Column]:
    """(``scored`` joined with its sites, host rate, path rate without the document itself, posterior)."""
    by_site = sites(scored.select(col(host).alias("host"), col(path).alias("path"), col(llr).alias("llr")), prior)
    names = dict(zip(by_site.columns, fresh(scored.columns, *by_site.columns), strict=True))
    at = {c: F.col(n) for c, n in names.items()}
    on = col(host).eqNullSafe(at["host"]) & col(path).eqNullSafe(at["path"])
    joined = scored.join(small(by_site.select(*(F.col(c).alias(n) for c, n in names.items()))), on)
    own = 1 / (1 + F.exp(-(col(llr) + F.lit(math.log(prior / (1 - prior))))))
    others = (at["docs"] - 1 + at["path_strength"]) * 1.0
    rate = (at["path_rate"] * (at["docs"] + at["path_strength"]) - own) / others
    rate = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), rate))
    return joined, at["host_rate"], rate, 1 / (1 + F.exp(-(col(llr) + F.log(rate / (1 - rate)))))


def classify(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    path_col: str = "lang", label_col: str = "quality", threshold: float = 0.5, max_labelled: int = 8000,
) -> DataFrame:
    """(doc_id, host, path, evidence, host_rate, path_rate, posterior, kept) of every row."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_labelled=max_labelled)
    picked = [col(c).alias(n) for c, n in ((id_col, "doc_id"), (host_col, "host"), (path_col, "path"))]
    scored = written(docs.select(*picked, evidence(model, col(text_col)).alias("evidence")), "scores")
    joined, host_rate, path_rate, posterior = _judged(scored, "host", "path", "evidence", _prior(labels, label_col))
    return joined.select(
        *(col(c) for c in scored.columns), host_rate.alias("host_rate"), path_rate.alias("path_rate"),
        posterior.alias("posterior"), (posterior >= threshold).alias("kept"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    path_col: str = "lang", label_col: str = "quality", threshold: float = 0.5, max_labelled: int = 8000,
) -> DataFrame:
    """The rows of ``docs`` whose posterior reaches ``threshold``, with their own columns.

    Texts are scored once: the rows are written beside their scores and read again for the verdicts,
    which is cheaper than scoring twice and shuffles no text.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_labelled=max_labelled)
    (llr,) = fresh(docs.columns, "evidence")
    scored = written(docs.withColumn(llr, evidence(model, col(text_col))), "scored")
    joined, _, _, posterior = _judged(scored, host_col, path_col, llr, _prior(labels, label_col))
    return joined.filter(posterior >= threshold).select(*(col(c) for c in docs.columns))
