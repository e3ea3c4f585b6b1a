"""Quality of documents by hierarchical empirical Bayes.

A logistic classifier, fitted to a bounded sample of labelled documents, gives each document its
own evidence: the log-odds by which its measures change the odds of the labelled sample.  The mean
quality of each host and of each path below it is estimated from the classifier's chances of all their
documents and shrunk: paths towards their host, hosts towards all.  How strongly follows from the data: the
moments of the groups' means against the spread that chance alone would give.  A document's score joins its
evidence with its path's mean, from which its own share is taken out, so nothing counts twice.

Chances are summed in millionths, as whole numbers, so sums do not depend on their order.  Groups
are aggregated before anything is joined; one row per group goes back to the documents, those of a hot
group spread over tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.joins import spread_join
from corpusgauge.functions.text import settled
from corpusgauge.llm.common import GAPS, key_of, table, words_of
from corpusgauge.session import written_once

#: Labelled documents that the classifier is fitted to at most: those of the smallest hashed ids.
FIT_ROWS = 20_000
RIDGE = 1.0
FEATURES = ["words", "symbols", "bangs", "capitals", "letters", "digits", "repeated", "length", "variety"]
MILLION = 1_000_000


def without(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"{characters}+", ""))


def measured(docs: DataFrame, host: str, path: str) -> DataFrame:
    """doc_id, group keys and ``FEATURES`` per document; null texts measure like empty ones."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = settled(
        docs.select("doc_id", key_of(F.col(host)).alias("host"), key_of(F.col(path)).alias("path"), text.alias("text")),
        ["doc_id", "host", "path"],
        n=F.length("text"), w=words_of(F.col("text")), lines=F.split("text", "\n", -1),
        n_symbols=F.length("text") - without(F.col("text"), "[#*$%&|<>]"),
        n_bangs=F.length("text") - without(F.col("text"), "!"),
        n_letters=without(F.col("text"), r"\P{L}"), n_capitals=without(F.col("text"), r"\P{Lu}"),
        n_digits=without(F.col("text"), r"\P{N}"), n_solid=without(F.col("text"), GAPS.rstrip("+")),
    )
    sized = settled(
        counted, ["doc_id", "host", "path", "n_symbols", "n_bangs", "n_letters", "n_capitals", "n_digits", "n_solid"],
        n=F.greatest("n", F.lit(1)), words=F.size("w"), own=F.size(F.array_distinct("w")),
        n_lines=F.size("lines"), distinct_lines=F.size(F.array_distinct("lines")),
    )
    per_word = F.greatest("words", F.lit(1))
    return sized.select(
        "doc_id", "host", "path",
        F.log1p("words").alias("words"), (F.col("n_symbols") / per_word).alias("symbols"),
        (F.col("n_bangs") / per_word).alias("bangs"),
        (F.col("n_capitals") / F.greatest("n_letters", F.lit(1))).alias("capitals"),
        (F.col("n_letters") / F.col("n")).alias("letters"), (F.col("n_digits") / F.col("n")).alias("digits"),
        (1 - F.col("distinct_lines") / F.col("n_lines")).alias("repeated"),
        F.least(F.col("n_solid") / per_word, F.lit(40.0)).alias("length"), (F.col("own") / per_word).alias("variety"),
    )


@dataclass(frozen=True)
class Model:
    """Standardised logistic model and the log-odds of the sample that it was fitted to."""

    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float
    base: float

    def log_odds(self) -> Column:
        found = F.lit(self.intercept)
        for name, m, s, w in zip(FEATURES, self.means, self.scales, self.weights, strict=True):
            found = found + (F.col(name) - m) * (w / s)
        return found


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Ridge logistic regression by Newton steps; with a class missing, evidence is 0 everywhere."""
    k, good = len(FEATURES), int(y.sum())
    base = math.log((good + 1) / (len(y) - good + 1))
    if not good or good == len(y):
        return Model((0.0,) * k, (1.0,) * k, (0.0,) * k, base, base)
    means, scales = x.mean(0), x.std(0)
    scales[scales < 1e-9] = 1.0
    z = np.column_stack([np.ones(len(x)), np.clip((x - means) / scales, -10, 10)])
    w, penalty = np.zeros(k + 1), np.diag([0.0, *[RIDGE] * k])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(tuple(means.tolist()), tuple(scales.tolist()), tuple(w[1:].tolist()), float(w[0]), base)


def fitted(rows: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    """The model of at most ``most`` labelled rows; labels other than 0 and 1 are left out.

    Of many labels only those of the smallest hashed ids, about twice as many as are
    needed, are joined and sorted, so what tasks send to the driver does not grow.
    """
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    share = 2 * most / max(known.count(), 1)
    if share < 1:
        known = known.where(F.xxhash64("doc_id") < int(-(2**63) + share * 2**64))
    sample = (
        rows.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(most)
        .select(*FEATURES, "_quality").toPandas()
    )
    return fit(sample[FEATURES].to_numpy(float), sample["_quality"].to_numpy(float))


def strength(groups: DataFrame, mean: Column) -> float:
    """How many documents the prior counts for: chance spread over the spread between groups.

    ``groups`` have n and s (millionths).  Groups of one document tell nothing and count little; no
    spread beyond chance gives a prior of as many documents as there are.
    """
    own = F.col("s") / F.lit(MILLION) / F.col("n")
    found = groups.agg(
        F.sum(F.col("n") * (own - mean) * (own - mean)).alias("between"), F.sum(mean * (1 - mean)).alias("chance"),
        F.sum("n").alias("n"), (F.sum(F.col("n") * mean * (1 - mean)) / F.sum("n")).alias("spread"),
        F.count(F.lit(1)).alias("groups"),
    ).first()
    if not found["n"]:
        return 1.0
    beyond = (found["between"] - found["chance"]) / found["n"]
    if beyond <= 0 or found["spread"] / beyond > found["n"]:
        return float(found["n"])
    return round(max(1.0, found["spread"] / beyond - 1), 6)


def chance(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(log_odds, F.lit(30.0)), F.lit(-30.0))))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` of :func:`measured` with doc_score, host and path posteriors, score and kept.

    ``doc_score`` is the classifier's alone.  A path with no other document falls back on its host,
    and a host without evidence on all; null hosts and paths are groups like others.
    """
    rows = rows.withColumn("_odds", F.round(model.log_odds(), 6))
    rows = written_once(
        rows.select("doc_id", "host", "path", "_odds", F.round(chance(F.col("_odds")) * MILLION).cast("long").alias("_p"))
    )
    paths = written_once(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("_p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = F.lit(total["s"] / MILLION / total["n"] if total["n"] else 0.5)
    weight = strength(hosts, mean)
    hosts = written_once(
        hosts.select("host", ((F.col("s") / F.lit(MILLION) + mean * weight) / (F.col("n") + weight)).alias("host_posterior"))
    )
    paths = written_once(spread_join(paths, hosts, ["host"], "inner", spread_by=["path"]))
    below = strength(paths, F.col("host_posterior"))
    joined = spread_join(rows, paths.withColumnsRenamed({"n": "_n", "s": "_s"}), ["host", "path"], "inner", spread_by=["doc_id"])
    others = (F.col("_s") - F.col("_p")) / F.lit(MILLION) + F.col("host_posterior") * below
    prior = others / (F.col("_n") - 1 + below)
    evidence = F.col("_odds") - F.lit(model.base)
    held = F.greatest(F.least(prior, F.lit(0.999999)), F.lit(0.000001))
    return (
        joined.withColumn("path_posterior", (F.col("_s") / F.lit(MILLION) + F.col("host_posterior") * below) / (F.col("_n") + below))
        .withColumn("score", F.round(chance(evidence + F.log(held / (1 - held))), 6))
        .select(
            "doc_id", (F.col("_p") / F.lit(MILLION)).alias("doc_score"),
            F.round("host_posterior", 6).alias("host_posterior"), F.round("path_posterior", 6).alias("path_posterior"),
            "score", (F.col("score") >= 0.5).alias("kept"),
        )
    )


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """All documents; a source is a host, and its languages are the paths below it."""
    rows = written_once(measured(table(spark, sf_dir, "documents"), "source", "lang"))
    return scored(rows, fitted(rows, table(spark, sf_dir, "labels")))
