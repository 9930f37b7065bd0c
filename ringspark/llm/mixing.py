"""Mixing documents to target weights by soft membership, in DataFrame functions only.

Figures of each text (tokens, and the shares of symbols, shouting, list bars and abuse) go
through a Gaussian naive Bayes classifier, whose means and variances by domain come from the
labelled table.  A document belongs to domain d with posterior p_d.  Document rates r >= 0 are
sought whose expected domain totals  A_d = sum of r * tokens * p_d  match the targets: starting
from r = 1, each step of projected gradient descent on the weighted squared error lowers r by a
product of p and a vector of domain errors and cuts it off at 0.  A step is a few numbers, so
rates are never stored: each pass computes them from the steps so far and sums the totals.

Each step is scaled by the moments of the documents that still have a rate, so that the steps
close in fast.  They go on until every total is within CLOSE of its target, as a share of it; if
they stall before that, as with posteriors that cannot tell the domains apart, the residual is
logged as a warning.

By default the total is the largest for which no domain has to grow.  A document stays floor(r)
times, and once more with the remaining share, by a hash of its id; the rates shown have nine
decimals, the copies come from the rates before that.

Defined results: a null or empty text has no tokens and gets its rate from the prior; without
labels the posteriors are equal and so are the rates; an id that is labelled twice counts in
both domains; repeated rows each have their rate; a null id is hashed like any value; an empty
table gives no rows; extra columns are not read by :func:`rates` and are kept by :func:`mix`.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, texts
from .toxicity import WORDS

STALL, CLOSE, FLOOR = 4, 1e-5, 1e-3
FIGURES = ("size", "word_length", "symbols", "bars", "shouts", "abuse")


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, figures) of each text; tokens are runs of other than white space."""
    rows = texts(docs, id_col, text_col)
    n = F.greatest(F.col("tokens"), F.lit(1))
    share = lambda pattern: F.regexp_count("text", F.lit(pattern)) / n
    counted = rows.withColumn("tokens", F.regexp_count("text", F.lit(r"\S+")).cast("long"))
    abuse = F.log1p(F.regexp_count("text", F.lit(rf"(?i)\b(?:{'|'.join(WORDS)})\b")).cast("double"))
    return counted.select(
        "doc_id", "tokens", F.log1p("tokens").alias("size"), (F.length("text") / n).alias("word_length"), share(r"[#*$%&<>]+").alias("symbols"),
        share(r"\|").alias("bars"), share(r"[A-Z]{3,}|!").alias("shouts"), abuse.alias("abuse"),
    )


def posteriors(rows: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """Add p_0, p_1, ... : the posterior of each domain; labelled has (doc_id, domain)."""
    known = rows.join(labelled.filter(F.col("domain").isin(domains)).select("doc_id", "domain").distinct(), "doc_id")
    sums = known.groupBy("domain").agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{c}") for c in FIGURES for k, f in (("m", F.avg), ("v", F.var_pop))))
    learned = {r["domain"]: r for r in sums.collect()}
    total = sum(r["n"] for r in learned.values())
    logs: list[Column] = []
    for d in domains:
        if not (r := learned.get(d)):
            # a domain without labelled documents: the smoothed prior, and no say of the figures
            logs.append(F.lit(float(np.log(1 / (total + len(domains))))) if learned else F.lit(0.0))
            continue
        term = F.lit(float(np.log((r["n"] + 1) / (total + len(domains)))))
        for c in FIGURES:
            variance = float(r[f"v_{c}"]) + FLOOR
            term = term - (F.col(c) - F.lit(float(r[f"m_{c}"]))) ** 2 / F.lit(2 * variance) - F.lit(float(np.log(variance)) / 2)
        logs.append(term)
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    scored = rows.select("doc_id", "tokens", *(x.alias(f"l_{i}") for i, x in enumerate(logs)), top.alias("top"))
    mass = [F.exp(F.col(f"l_{i}") - F.col("top")) for i in range(len(domains))]
    return scored.select("doc_id", "tokens", *((m / sum(mass[1:], mass[0])).alias(f"p_{i}") for i, m in enumerate(mass)))


def rate(steps: list[np.ndarray]) -> Column:
    """A document's rate after the given steps."""
    r = F.lit(1.0)
    for step in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.col(f"p_{i}") * F.lit(float(g)) for i, g in enumerate(step[1:], 1)), F.col("p_0") * F.lit(float(step[0]))))
    return r


def fit(rows: DataFrame, weights: np.ndarray, total: float | None = None) -> list[np.ndarray]:
    """Steps of projected gradient descent towards the weights; rows has tokens and p_0, p_1, ..."""
    k = len(weights)
    p = [F.col(f"p_{i}") for i in range(k)]
    everything = float(rows.agg(F.sum("tokens")).first()[0] or 0)
    if not everything:
        return []

    def sums(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Totals of the domains after the steps, and moments of the documents with a rate."""
        own = rows.select("*", rate(steps).alias("_rate"))
        alive = F.when(F.col("_rate") > 0, F.col("tokens"))
        once = own.agg(*(F.sum(F.col("tokens") * F.col("_rate") * p[i]).alias(f"a_{i}") for i in range(k)), *(F.sum(alive * p[i] * p[j]).alias(f"m_{i}_{j}") for i in range(k) for j in range(k))).first()
        return tuple(np.array([once[c] or 0.0 for c in once.asDict() if c[0] == x]) / everything for x in "am")

    now, moments = sums([])
    goal = weights * (total / everything if total else float((now / weights).min()))
    steps: list[np.ndarray] = []
    left = [float((np.abs(now - goal) / goal).max())]
    # a stall: of the last steps none has halved the residual
    while left[-1] > CLOSE and (len(left) <= STALL or min(left[-STALL:]) < 0.5 * min(left[:-STALL])):
        steps.append(np.linalg.inv(moments.reshape(k, k) + 1e-6 * np.eye(k)) @ (now - goal))
        now, moments = sums(steps)
        left.append(float((np.abs(now - goal) / goal).max()))
    best = int(np.argmin(left))
    if left[best] > CLOSE:
        logging.getLogger(__name__).warning("mixing stops with totals up to %.3g of their targets away", left[best])
    return steps[:best]


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, p_0.., rate, copies) for each row; domains in the order of ``targets``."""
    domains = list(targets)
    if not domains or min(targets.values()) <= 0:
        raise ValueError("every domain needs a positive target weight")
    weights = np.array([targets[d] for d in domains], dtype=float)
    named = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain"))
    rows = cut(posteriors(cut(figures(docs, id_col, text_col), "figures"), named, domains), "posteriors")
    own = rate(fit(rows, weights / weights.sum(), total))
    share = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1_000_000)) / 1_000_000
    return rows.select("*", F.round(own, 9).alias("rate"), F.floor(own + share).cast("long").alias("copies"))


def by_quality(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain")).filter("domain is not null")


def by_use(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain")).filter("domain is not null")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its rate has it; rows of one id and text share theirs."""
    own_id, key, copies, found_key, copy = (fresh(docs, c) for c in ("own_id", "key", "copies", "found_key", "copy"))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    marked = docs.withColumn(own_id, docs[id_col].cast("long")).withColumn(key, F.xxhash64(F.coalesce(docs[id_col].cast("long"), F.lit(-1)), text))
    named = labelled.select(F.col("doc_id").cast("long").alias(own_id), "domain")
    by_key = marked.select(own_id, key).join(named, own_id).select(F.col(key).alias("doc_id"), "domain")
    found = rates(marked.select(F.col(key).alias("doc_id"), F.col(text_col)), by_key, targets, total, "doc_id", text_col)
    often = found.groupBy("doc_id").agg(F.max("copies").alias(copies)).filter(F.col(copies) > 0).withColumnRenamed("doc_id", found_key)
    out = marked.join(often, F.col(key) == F.col(found_key))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
