"""Metrics from judge verdicts, and scores blended with similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.joins import spread_join
from corpusgauge.functions.numbers import half_up, ratio
from corpusgauge.schema import BASELINE, DENSITIES, FACET_METRICS, METRICS, RATIO_METRICS, facet_of


def structure_score(verdicts: DataFrame, docs: DataFrame | None = None, keys: Sequence[str] = ("doc",)) -> DataFrame:
    """Depth-weighted share of accepted children, 0-100 with 4 digits.

    ``verdicts`` has one row per child of the answer: keys, ``parent_pos``,
    ``depth`` of the parent, ``max_depth`` of the whole outline, ``child`` and
    ``is_included``.  Every child counts, judged or not; a parent without any
    has a null ``child`` and scores 1.  Documents in ``docs`` without any
    parent score 100.
    """
    keys = list(keys)
    children = F.count("child")
    accepted = F.count_if(F.col("child").isNotNull() & (F.lower("is_included") == "yes"))
    parents = verdicts.groupBy(*keys, "parent_pos", "depth").agg(
        F.when(children > 0, accepted / children).otherwise(1.0).alias("score"),
        F.max("max_depth").alias("deepest"),
    )
    # score and weight share the factor 1 / max depth, so it cancels out of
    # the weighted mean, but depth must be counted from the deepest level
    per_doc = parents.groupBy(*keys).agg(
        F.max("deepest").alias("deepest"),
        F.sum("score").alias("s"),
        F.sum(F.col("score") * F.col("depth")).alias("sd"),
        F.count("*").alias("n"),
        F.sum("depth").alias("d"),
    )
    top = F.col("deepest") + 1
    value = (top * F.col("s") - F.col("sd")) / (top * F.col("n") - F.col("d")) * 100
    out = per_doc.select(*keys, half_up(value, 4).alias("value"))
    if docs is not None:
        out = docs.select(*keys).distinct().join(out, keys, "left").fillna(100.0, ["value"])
    return out


def _support(verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return verdicts.groupBy(*keys).agg(
        F.coalesce(F.sum("supported"), F.lit(0)).alias("supported"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
    )


def faithfulness(verdicts: DataFrame, keys: Sequence[str], sentence: str | None = "sentence") -> DataFrame:
    """Supported share of citations; a sentence repeated in a document counts once.

    Of several answers about one sentence the one that supports most counts, of those the one with most citations.
    """
    if sentence is not None:
        best = F.max(F.struct("supported", "total")).alias("best")
        verdicts = verdicts.groupBy(*keys, sentence).agg(best).select(*keys, "best.supported", "best.total")
    share = ratio(F.col("supported"), F.col("total"))
    return _support(verdicts, keys).select(*keys, half_up(F.round(F.round(share, 10), 4) * 100, 2).alias("value"))


def reference_quality(verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Supported share of references over all batches, percent with 2 digits."""
    share = ratio(F.col("supported"), F.col("total"))
    return _support(verdicts, keys).select(*keys, half_up(share * 100, 2).alias("value"))


def sim_adjust(
    scores: DataFrame, similarity: DataFrame, baseline: str = BASELINE, unbased: bool = False
) -> DataFrame:
    """Blend each score with the baseline's by the facet similarity ``s``.

    ``balanced`` is ``(1-s)*score + s*baseline score``, ``perfect`` puts 5 or
    100 in place of the baseline score.  Missing scores and similarities count
    as zero; a document whose baseline has no result at all gives no rows, or with ``unbased`` rows with zeros
    for the baseline's.  Both inputs are keyed by document; ``similarity`` is long with ``facet`` and ``mean_score``.
    """
    doc = ["category", "topic", "system", "model"]
    # one row per result file, so that the joins move a tenth of the rows
    wide = scores.groupBy(*doc).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in METRICS]
    )
    own = scores.filter(F.col("system") == baseline).groupBy("category", "topic", "model").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"base_{m}") for m in METRICS]
    )
    means = similarity.groupBy("category", "topic", "system").agg(
        *[F.max(F.when(F.col("facet") == f, F.col("mean_score"))).alias(f"sim_{f}") for f in FACET_METRICS]
    )
    joined = spread_join(wide, own, ["category", "topic", "model"], "left" if unbased else "inner", spread_by=doc).join(
        means, ["category", "topic", "system"], "left"
    )

    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    def cell(m: str) -> Column:
        plain, base, s = known(m), known(f"base_{m}"), known(f"sim_{facet_of(m)}")
        best = F.lit(100.0 if m in RATIO_METRICS else 5.0)
        return F.struct(
            F.lit(m).alias("metric"), plain.alias("plain"),
            ((1 - s) * plain + s * base).alias("balanced"),
            ((1 - s) * plain + s * best).alias("perfect"),
        )

    return joined.select(*doc, F.inline(F.array(*[cell(m) for m in METRICS])))


def swap_of(*key: str, seed: int = 0) -> Column:
    """Whether the compared pair changes places; a fair hash of the key."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 1), 16, 10).cast("int") % 2 == 1


def pairwise_assign(
    pairs: DataFrame, first: str, second: str, key: Sequence[str], seed: int = 0
) -> DataFrame:
    """Put the two texts of each pair in a position fixed by a hash."""
    swapped = swap_of(*key, seed=seed)
    return pairs.withColumn("swapped", swapped).withColumns(
        {
            "position_1": F.when(F.col("swapped"), F.col(second)).otherwise(F.col(first)),
            "position_2": F.when(F.col("swapped"), F.col(first)).otherwise(F.col(second)),
        }
    )


def pairwise_unswap(verdicts: DataFrame) -> DataFrame:
    """Turn "position 1 is better" back into "the system is better"."""
    return verdicts.withColumn(
        "is_better", F.when(F.col("swapped"), ~F.col("is_better")).otherwise(F.col("is_better"))
    )


def win_rates(comparisons: DataFrame) -> DataFrame:
    """Wins, losses and rate per category, system and metric, and over all categories.

    The overall rows (null ``category``) add up the per-category counts, so
    the comparisons are read once.
    """
    counts = comparisons.filter(F.col("is_better").isNotNull()).groupBy(
        "category", "system", "model", "metric"
    ).agg(F.count_if("is_better").alias("wins"), F.count("*").alias("total"))
    both = counts.groupingSets(
        [
            [F.col("category"), F.col("system"), F.col("model"), F.col("metric")],
            [F.col("system"), F.col("model"), F.col("metric")],
        ],
        "category", "system", "model", "metric",
    ).agg(F.sum("wins").alias("wins"), F.sum("total").alias("total"))
    rate = F.col("wins") / F.col("total")
    return both.select(
        "category", "system", "model", "metric", "wins",
        (F.col("total") - F.col("wins")).alias("losses"),
        "total",
        F.format_string("%.2f%%", half_up(rate * 100, 2)).alias("win_rate"),
    )


def win_rate_spread(rates: DataFrame, run: str = "model") -> DataFrame:
    """Mean and sample deviation of win rates over runs, per system and metric."""
    share = F.regexp_replace("win_rate", "%$", "").try_cast("double") / 100
    return rates.select("system", "metric", run, share.alias("rate")).groupBy("system", "metric").agg(
        F.count("rate").alias("runs"),
        half_up(F.avg("rate"), 6).alias("mean_rate"),
        half_up(F.stddev_samp("rate"), 6).alias("std_rate"),
    )


def density_similarity(
    densities: DataFrame, baseline: str = BASELINE, columns: Sequence[str] = DENSITIES
) -> DataFrame:
    """``1 / (1 + distance of the ratios from 1)``; the baseline scores 1.

    A model without a baseline row has no score.
    """
    models = densities.filter(F.col("system") == baseline).select("model").distinct().withColumn("known", F.lit(True))
    squares = sum(
        (F.coalesce(F.pow(F.col(c).cast("double") - 1, 2), F.lit(0.0)) for c in columns), F.lit(0.0)
    )
    score = F.when(F.col("system") == baseline, F.lit(1.0)).when(F.col("known"), 1 / (1 + F.sqrt(squares)))
    return spread_join(densities, models, ["model"]).select(
        *[c for c in densities.columns if c not in columns], half_up(score, 6).alias("similarity_score")
    )


def density_pca(
    densities: DataFrame,
    columns: Sequence[str] = DENSITIES,
    include_baseline: bool = True,
    baseline: str = BASELINE,
) -> DataFrame:
    """First two principal components of the density ratios, nulls as 0."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    if not include_baseline:
        densities = densities.filter(F.col("system") != baseline)
    names = list(columns)
    numbers = densities.select(
        *[c for c in densities.columns if c not in names],
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names],
    )
    vectors = VectorAssembler(inputCols=names, outputCol="raw").transform(numbers)
    centred = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(vectors).transform(vectors)
    scored = PCA(k=2, inputCol="centred", outputCol="pc").fit(centred).transform(centred)
    parts = vector_to_array("pc")
    return scored.select(
        *[c for c in densities.columns if c not in names],
        parts[0].alias("pc1"), parts[1].alias("pc2"),
    )
