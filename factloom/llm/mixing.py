"""Mixing documents to target domain weights with soft domain membership, in DataFrame operations only.

Method: a naive Bayes classifier is counted from a labelled table (hashed words by domain) and gives
every document its domain posteriors.  Document rates x >= 0 then solve the least squares problem
sum_k (sum_d tokens_d p_dk x_d - target_k)^2 / share_k by projected gradient from x = 1: each round
is one distributed sum of the expected token totals and one map x <- max(0, x - p . residual).  With
the domains' shares as metric the step matrix is row-stochastic, so the unit step is stable.  Where
the budget grows, rates are held at x >= 1, so that every document stays; totals then settle as near
to their targets as that allows.

Scale: weights are one array of ``buckets`` x domains, a fixed bound, that every task holds; a text's
words are hashed and summed in its own row, so nothing of a text is shuffled.  A round reads (tokens,
posteriors, rate) rows and returns as many sums as there are domains; the rate is written out every few
rounds to cut lineage.  The residuals of the rounds are all that a rate depends on beside the
posteriors, so ``mixed`` works out each document's copies where its text is, without a join.  No group
is keyed by domain or source, so a source with a third of all rows is like any other.

Defined cases: a null or empty text has no tokens and the prior as posteriors; a null domain in the
labelled table is not a label; a target domain without labelled rows is ignored, a domain without
target weighs nothing; repeated rows are separate variables with equal rates; without labels every
rate is 1; an empty table gives no rows; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, written

#: Domains are listed on the driver and weights broadcast: more is an error, not a cut.
MAX_DOMAINS = 256


def _words(text: str) -> Column:
    return F.explode_outer(F.split(F.col(text), r"[\x20\x09-\x0D]+"))


def _bucket(word: str, buckets: int) -> Column:
    return F.when(F.col(word) != "", F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int"))


def train(labelled: DataFrame, buckets: int = 4096, smoothing: float = 0.5) -> tuple[list[str], list[float], DataFrame | None]:
    """(domains, their log priors, weights(bucket, w0, w1..)) from rows (domain, text)."""
    found = labelled.filter("domain IS NOT NULL").groupBy("domain").agg(F.count("*").alias("n"))
    rows = found.orderBy("domain").limit(MAX_DOMAINS + 1).collect()
    if len(rows) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    if not rows:
        return [], [], None
    names, total = [r.domain for r in rows], sum(r.n for r in rows)
    prior = [F.log(F.lit(r.n / total)) for r in rows]
    words = labelled.select("domain", _words("text").alias("word")).select("domain", _bucket("word", buckets).alias("bucket"))
    counts = written(
        words.filter("bucket IS NOT NULL").groupBy("bucket").agg(
            *(F.sum((F.col("domain") == d).cast("long")).alias(f"c{k}") for k, d in enumerate(names))
        ),
        "words",
    )
    sums = counts.agg(*(F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"c{k}") for k in range(len(names)))).first()
    every = labelled.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    weights = every.join(counts, "bucket", "left").select(
        "bucket",
        *(
            F.log((F.coalesce(f"c{k}", F.lit(0)) + smoothing) / (sums[k] + smoothing * buckets)).alias(f"w{k}")
            for k in range(len(names))
        ),
    )
    logs = labelled.sparkSession.range(1).select(*prior).first()
    return names, list(logs), written(weights, "weights")


def _member(text: Column, names: list[str], priors: list[float], weights: DataFrame, buckets: int) -> tuple[Column, Callable[[Column], Column]]:
    """(hashed words of a text, a function of them that gives their posteriors)."""
    k = len(names)
    table = weights.orderBy("bucket").select(*(f"w{i}" for i in range(k))).collect()  # ``buckets`` rows
    # one constant of the plan: text that the optimizer reads into an array once
    flat = F.from_json(F.lit("[" + ",".join(repr(x) for row in table for x in row) + "]"), "array<double>")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.coalesce(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int") * k), F.array().cast("array<int>"))

    def adding(domain: int) -> Callable[[Column, Column], Column]:
        return lambda total, at: total + F.get(flat, at + domain)

    def scores(hashed: Column) -> Column:
        return F.array(*(F.aggregate(hashed, F.lit(priors[i]), adding(i)) for i in range(k)))

    return hashed, scores


def _softmax(frame: DataFrame, s: str, e: str, p: str) -> DataFrame:
    """``frame`` with column ``s`` of log scores replaced by ``p``, their shares; each step once a row."""
    kept = [col(c) for c in frame.columns if c != s]
    powers = frame.select(*kept, F.transform(F.col(s), lambda x: F.exp(x - F.array_max(F.col(s)))).alias(e))
    total = F.aggregate(F.col(e), F.lit(0.0), lambda a, x: a + x)
    return powers.select(*kept, F.transform(F.col(e), lambda x: x / total).alias(p))


def posteriors(docs: DataFrame, names: list[str], priors: list[float], weights: DataFrame, buckets: int = 4096) -> DataFrame:
    """(doc_id, text_hash, tokens, p array<double>) of rows (doc_id, text)."""
    hashed, scores = _member(F.col("text"), names, priors, weights, buckets)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), hashed.alias("words"))
    rows = rows.select("doc_id", "text_hash", F.size("words").cast("long").alias("tokens"), scores(F.col("words")).alias("s"))
    return _softmax(rows, "s", "e", "p")


def rates(
    members: DataFrame, names: list[str], targets: dict[str, float] | None, *, power: float = 0.7,
    grow: bool = False, rounds: int = 40, tolerance: float = 1e-4, cut: int = 6,
) -> tuple[DataFrame, list[list[float]], float]:
    """(``members`` with its rate, the residuals of each round, the largest relative miss of a target).

    Projected gradient until every domain total is within tolerance, or with ``grow`` moves no more, or
    ``rounds`` are over; the miss tells how near it came.
    """
    p = [F.col("p")[k] for k in range(len(names))]
    first = members.agg(
        F.sum("tokens").alias("all"), *(F.sum(F.col("tokens") * x).alias(f"a{k}") for k, x in enumerate(p))
    ).first()
    if not first["all"]:
        return members.withColumn("rate", F.lit(1.0)), [], 0.0
    share = [max(1e-12, first[f"a{k}"] / first["all"]) for k in range(len(names))]
    raw = [share[k] ** power if targets is None else max(0.0, targets.get(d, 0.0)) for k, d in enumerate(names)]
    if not sum(raw):
        raise ValueError("no target names a domain that has labelled rows")
    weight = [x / sum(raw) for x in raw]
    budget = max((s / w for s, w in zip(share, weight, strict=True) if w > 0), default=1.0) if grow else 1.0
    target = [w * budget for w in weight]
    state, totals, history = members.withColumn("rate", F.lit(1.0)), share, []
    for n in range(1, rounds + 1):
        off = [(t - g) / s for t, g, s in zip(totals, target, share, strict=True)]
        if all(abs(t - g) <= tolerance * max(g, 1e-9) for t, g in zip(totals, target, strict=True)):
            break
        history.append(off)
        step = sum((x * F.lit(r) for x, r in zip(p, off, strict=True)), F.lit(0.0))
        state = state.withColumn("rate", F.greatest(F.lit(_least(grow)), F.col("rate") - step))
        if n % cut == 0:
            state = written(state, "rates")
        sums = state.agg(
            *(F.sum(F.col("tokens") * x * F.col("rate")).alias(f"a{k}") for k, x in enumerate(p))
        ).first()
        last, totals = totals, [x / first["all"] for x in sums]
        if grow and all(abs(t - o) <= tolerance / 10 * max(g, 1e-9) for t, o, g in zip(totals, last, target, strict=True)):
            break
    return state, history, max(abs(t - g) / max(g, 1e-9) for t, g in zip(totals, target, strict=True))


def _least(grow: bool) -> float:
    return 1.0 if grow else 0.0


def _followed(p: Column, history: list[list[float]], grow: bool) -> Column:
    """The rate that the rounds lead to, from the posteriors alone: the same steps in the same order."""
    if not history:
        return F.lit(1.0)
    rounds = F.array(*(F.array(*map(F.lit, off)) for off in history))
    dot = lambda p, off: F.aggregate(F.zip_with(p, off, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    state = lambda x, p: F.struct(x.alias("x"), p.alias("p"))
    # the posteriors go along as state: inside the function they would be worked out again each round
    stepped = lambda held, off: state(F.greatest(F.lit(_least(grow)), held["x"] - dot(held["p"], off)), held["p"])
    return F.aggregate(rounds, state(F.lit(1.0), p), stepped, lambda held: held["x"])


def _copies(rate: Column, key: Column) -> Column:
    chance = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + chance).cast("int")


def _model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, domain_col: str, max_labelled: int, buckets: int):
    """Domains, priors and weights learnt from at most ``max_labelled`` listed documents, one row an id."""
    key = col(id_col).alias("doc_id")
    listed = labels.select(key).dropna().distinct()
    listed = listed.orderBy(F.xxhash64("doc_id", F.lit("mix")), "doc_id").limit(max_labelled)
    labelled = docs.select(key, col(text_col).alias("text"), col(domain_col).cast("string").alias("domain"))
    labelled = labelled.join(F.broadcast(listed), "doc_id", "left_semi")
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "domain")).alias("first")
    labelled = written(labelled.groupBy("doc_id").agg(first).select("first.domain", "first.text"), "labelled")
    return train(labelled, buckets)


def mix(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang",
    targets: dict[str, float] | None = None, power: float = 0.7, grow: bool = False, max_labelled: int = 20000,
    buckets: int = 4096,
) -> DataFrame:
    """(doc_id, text_hash, tokens, domain, membership, rate, copies, miss) of every row.

    The classifier learns from at most ``max_labelled`` rows of ``docs`` listed in ``labels``, whose
    domain is ``domain_col``; it is never read elsewhere.  ``targets`` maps domains to weights;
    without them a domain weighs its token share to the ``power``.  The token total stays, or with
    ``grow`` rises until no domain shrinks.  ``copies`` rounds the rate by the hash of the id, so
    that its expectation is the rate; ``miss`` is how far the worst domain total is from its target.
    """
    plain = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    names, priors, weights = _model(docs, labels, id_col, text_col, domain_col, max_labelled, buckets)
    if weights is None:
        found = plain.select("doc_id", F.xxhash64("text").alias("text_hash"), F.lit(0).cast("long").alias("tokens"))
        return found.select(
            "*", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("membership"),
            F.lit(1.0).alias("rate"), F.lit(1).alias("copies"), F.lit(0.0).alias("miss"),
        )
    members = written(posteriors(plain, names, priors, weights, buckets), "members")
    state, _, miss = rates(members, names, targets, power=power, grow=grow)
    best = F.array_max("p")
    return state.select(
        "doc_id", "text_hash", "tokens",
        F.element_at(F.array(*map(F.lit, names)), F.array_position("p", best).cast("int")).alias("domain"),
        best.alias("membership"), "rate", _copies(F.col("rate"), F.col("doc_id")).alias("copies"), F.lit(miss).alias("miss"),
    )


def mixed(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang",
    targets: dict[str, float] | None = None, power: float = 0.7, grow: bool = False, max_labelled: int = 20000,
    buckets: int = 4096,
) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, with their own columns; parameters as in ``mix``."""
    names, priors, weights = _model(docs, labels, id_col, text_col, domain_col, max_labelled, buckets)
    if weights is None:
        return docs
    plain = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    members = written(posteriors(plain, names, priors, weights, buckets).select("tokens", "p"), "members")
    _, history, _ = rates(members, names, targets, power=power, grow=grow)
    words, s, e, p, copies = fresh(docs.columns, "words", "s", "e", "p", "copies")
    hashed, scores = _member(col(text_col), names, priors, weights, buckets)
    own = [col(c) for c in docs.columns]
    rows = docs.select(*own, hashed.alias(words))
    rows = _softmax(rows.select(*own, scores(F.col(words)).alias(s)), s, e, p)
    number = _copies(_followed(F.col(p), history, grow), col(id_col))
    # a column that is not deterministic keeps the filter, and with it a second reading of the text, above
    rows = rows.select(*own, (number + F.monotonically_increasing_id() * 0).cast("int").alias(copies)).filter(F.col(copies) > 0)
    return rows.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*own)
