"""Averages, leaderboards and the tables behind the figures.

Scores are long: ``category, topic, system, model, metric, value``.  Every
roll-up aggregates first (partial sums on the map side) and joins only the
aggregated rows, so a category or system that holds a large share of the
scores costs no more than its number of groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.joins import spread_join
from corpusgauge.functions.numbers import average_over, half_up
from corpusgauge.schema import (
    BASELINE,
    CONTENT_CRITERIA,
    DENSITIES,
    METRICS,
    RATIO_METRICS,
    ZERO_FILLED_METRICS,
)


def avg_by_files(scores: DataFrame) -> DataFrame:
    """Sum over result files divided by the number of files, 4 digits.

    A metric absent from a file counts as zero there.
    """
    group = ["category", "system", "model"]
    files = scores.select(*group, "topic").distinct().groupBy(*group).agg(F.count("*").alias("files"))
    sums = scores.groupBy(*group, "metric").agg(F.sum("value").alias("total"))
    return sums.join(files, group).select(
        *group, "metric", half_up(F.col("total") / F.col("files"), 4).alias("value")
    )


def avg_macro_system(file_averages: DataFrame) -> DataFrame:
    """Mean of category averages over the categories that have the pair, 4 digits."""
    pair = ["system", "model"]
    present = (
        file_averages.select(*pair, "category").distinct().groupBy(*pair).agg(F.count("*").alias("cats"))
    )
    sums = file_averages.groupBy(*pair, "metric").agg(F.sum("value").alias("total"))
    return sums.join(present, pair).select(
        *pair, "metric", half_up(F.col("total") / F.col("cats"), 4).alias("value")
    )


def zero_fill(scores: DataFrame, metrics: Sequence[str] = ZERO_FILLED_METRICS) -> DataFrame:
    """Replace zeros by the system's non-zero mean in the category, all models."""
    key = ["category", "system", "metric"]
    means = (
        scores.filter(F.col("metric").isin(list(metrics)) & (F.col("value") != 0))
        .groupBy(*key)
        .agg(F.avg("value").alias("mean"))
    )
    filled = F.when(
        F.col("metric").isin(list(metrics)) & (F.col("value") == 0), F.coalesce("mean", "value")
    ).otherwise(F.col("value"))
    names = [filled.alias("value") if c == "value" else F.col(c) for c in scores.columns]
    return spread_join(scores, means, key).select(*names)


def avg_category(scores: DataFrame) -> DataFrame:
    """Mean of present values per category, system, model and metric, 4 digits."""
    return scores.groupBy("category", "system", "model", "metric").agg(
        half_up(F.avg("value"), 4).alias("value")
    )


def avg_category_filled(
    scores: DataFrame, metrics: Sequence[str] = ZERO_FILLED_METRICS
) -> DataFrame:
    """``avg_category(zero_fill(scores))`` without touching the rows twice.

    A zero becomes a mean, so the filled average follows from three partial
    aggregates: the non-zero sum and count, and the number of zeros.
    """
    value, fillable = F.col("value"), F.col("metric").isin(list(metrics))
    is_zero = fillable & (value == 0)
    parts = scores.groupBy("category", "system", "model", "metric").agg(
        F.sum(F.when(~is_zero, value).otherwise(0.0)).alias("total"),
        F.count(F.when(~is_zero, value)).alias("n"),
        F.count(F.when(is_zero, value)).alias("zeros"),
    )
    key = ["category", "system", "metric"]
    fills = parts.groupBy(*key).agg(
        average_over(F.sum("total"), F.sum("n")).alias("fill")
    )
    mean = (F.col("total") + F.col("zeros") * F.coalesce("fill", F.lit(0.0))) / (
        F.col("n") + F.col("zeros")
    )
    return parts.join(fills, key).select(
        "category", "system", "model", "metric", half_up(mean, 4).alias("value")
    )


def avg_global(category_averages: DataFrame, round_stages: bool = True) -> DataFrame:
    """Mean of category averages, each first cut to 2 digits; 2 digits."""
    value = half_up(F.col("value"), 2) if round_stages else F.col("value")
    return (
        category_averages.withColumn("value", value)
        .groupBy("system", "model", "metric")
        .agg(half_up(F.avg("value"), 2).alias("value"))
    )


def _wide(long: DataFrame, group: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One column per metric of a fixed list; no pass to find the list."""
    cells = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    return long.groupBy(*group).agg(*cells)


def results_table(scores: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per result file, a column per metric: the table written as CSV."""
    return _wide(scores, ["topic", "system", "model", "category"], metrics)


def leaderboard(adjusted: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Three rows per system and model: plain, balanced and perfect.

    ``adjusted`` is long with columns ``plain``, ``balanced`` and
    ``perfect`` and is read once.  A missing score counts as zero; the baseline shows its plain
    scores three times; ratio metrics are brought to the 0-5 scale.
    """
    who, kinds = ["system", "model"], ("plain", "balanced", "perfect")
    own = F.col("system") == baseline
    shown = {k: F.when(own, F.col("plain")).otherwise(F.col(k)) for k in kinds}
    # documents first, so that one reading of the blend gives their number and the sums
    cells = {f"{k}_{m}": F.sum(F.when(F.col("metric") == m, shown[k])) for k in kinds for m in METRICS}
    per_doc = adjusted.groupBy(*who, "category", "topic").agg(*[c.alias(n) for n, c in cells.items()])
    sums = per_doc.groupBy(*who).agg(F.count("*").alias("docs"), *[F.sum(n).alias(n) for n in cells])

    def cell(kind: str, m: str) -> Column:
        value = F.col(f"{kind}_{m}") / F.col("docs") / (20.0 if m in RATIO_METRICS else 1.0)
        return F.struct(F.lit(kind).alias("type"), F.lit(m).alias("metric"), value.alias("value"))

    long = sums.select(*who, F.inline(F.array(*[cell(k, m) for k in kinds for m in METRICS])))
    wide = _wide(long, [*who, "type"], METRICS)
    filled = {m: F.coalesce(F.col(m), F.lit(0.0)) for m in METRICS}
    normalized = sum((filled[m] for m in RATIO_METRICS), F.lit(0.0)) / len(RATIO_METRICS)
    return wide.select(
        *who,
        "type",
        half_up(normalized, 2).alias("normalized_average"),
        *[half_up(filled[m], 2).alias(m) for m in METRICS],
    )


def reorganize(
    averages: DataFrame,
    systems: Sequence[str] | None = None,
    models: Sequence[str] | None = None,
    metrics: Sequence[str] = METRICS,
) -> DataFrame:
    """Fixed column order, two-digit text, empty text where nothing is known."""
    if systems is not None:
        averages = averages.filter(F.col("system").isin(list(systems)))
    if models is not None:
        averages = averages.filter(F.col("model").isin(list(models)))
    wide = _wide(averages, ["system", "model"], metrics)
    cells = [
        F.coalesce(F.format_string("%.2f", half_up(F.col(m), 2)), F.lit("")) for m in metrics
    ]
    shown = [F.when(F.col(m).isNull(), F.lit("")).otherwise(c).alias(m) for m, c in zip(metrics, cells)]
    return wide.select("system", "model", *shown)


def ratio_to_baseline(averages: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Each average divided by the baseline's of the same model; 2 digits."""
    own = averages.filter(F.col("system") == baseline).select(
        "model", "metric", F.col("value").alias("base")
    )
    ratio = (
        F.when(F.col("system") == baseline, F.lit(1.0))
        .when(F.col("base") != 0, half_up(F.col("value") / F.col("base"), 2))
    )
    return averages.join(own, ["model", "metric"], "left").select(
        "system", "model", "metric", ratio.alias("ratio")
    )


def heatmap_matrix(
    category_averages: DataFrame, systems: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """Per category a full system x metric grid, scaled to 0-1.

    The ``_domain`` variant of a metric is shown when the table has it.  Zero
    and absent cells are masked.
    """
    means = category_averages.groupBy("category", "system", "metric").agg(F.avg("value").alias("value"))
    domain = means.filter(F.col("metric").endswith("_domain")).select(F.col("metric").alias("shown")).distinct()
    grid = (
        means.select("category").distinct()
        .withColumn("system", F.explode(F.array(*[F.lit(s) for s in systems])))
        .withColumn("metric", F.explode(F.array(*[F.lit(m) for m in metrics])))
        .withColumn("wanted", F.concat("metric", F.lit("_domain")))
    )
    grid = grid.join(domain, F.col("wanted") == F.col("shown"), "left").select(
        "category", "system", "metric", F.coalesce("shown", "metric").alias("shown")
    )
    value = F.col("value")
    scaled = F.when(F.col("shown").endswith("_domain"), (value - 1) / 4).otherwise(value / 100)
    cells = means.withColumnRenamed("metric", "shown")
    return grid.join(cells, ["category", "system", "shown"], "left").select(
        "category", "system", "metric", "shown",
        F.when(scaled != 0, half_up(scaled, 6)).alias("cell"),
        F.coalesce(scaled == 0, F.lit(True)).alias("masked"),
    )


def feature_minmax(features: DataFrame) -> DataFrame:
    """Scale each feature to 0-1 over its categories (``category, feature, value``)."""
    ends = features.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    span = F.col("high") - F.col("low")
    return spread_join(features, ends, ["feature"]).select(
        "category", "feature", "value",
        F.when(span != 0, half_up((F.col("value") - F.col("low")) / span, 6)).alias("scaled"),
    )


def radar_series(
    scores: DataFrame,
    metrics: Sequence[str],
    names: Mapping[str, str] | None = None,
    floor: float | None = None,
) -> DataFrame:
    """Mean per system and metric under display names.

    The metric ``Content`` stands for the mean of the five content criteria
    of a system.
    """
    parts = sorted({m for m in metrics if m != "Content"} | set(CONTENT_CRITERIA if "Content" in metrics else []))
    means = scores.filter(F.col("metric").isin(parts)).groupBy("system", "metric").agg(F.avg("value").alias("value"))
    wide = _wide(means, ["system"], parts)
    content: Column = F.lit(None).cast("double")
    if "Content" in metrics:
        known = F.filter(F.array(*[F.col(c) for c in CONTENT_CRITERIA]), lambda x: x.isNotNull())
        content = F.when(
            F.size(known) > 0,
            F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known),
        )
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), (content if m == "Content" else F.col(m)).alias("value"))
            for m in metrics
        ]
    )
    shown = F.col("system")
    if names:
        shown = F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("system")], shown)
    value = F.col("cell.value")
    if floor is not None:
        value = F.when(value.isNotNull(), F.greatest(value, F.lit(float(floor))))
    return wide.select("system", shown.alias("display"), F.explode(cells).alias("cell")).select(
        "system", "display", F.col("cell.metric").alias("metric"), half_up(value, 6).alias("value")
    )


def informativeness(densities: DataFrame, columns: Sequence[str] = DENSITIES) -> DataFrame:
    """Five times the mean of the known densities, 5 once the mean exceeds 1."""
    known = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
    keep = [c for c in densities.columns if c not in columns]
    score = F.when(mean > 1, F.lit(5.0)).otherwise(mean * 5)
    return densities.select(*keep, half_up(score, 6).alias("informativeness"))


def domain_composite(
    category_averages: DataFrame, domain_metrics: Sequence[str], ratio_metrics: Sequence[str]
) -> DataFrame:
    """Per system and category: (mean of means of each metric group, added) / 20."""
    wanted = [*domain_metrics, *ratio_metrics]
    means = (
        category_averages.filter(F.col("metric").isin(wanted))
        .groupBy("system", "category", "metric")
        .agg(F.avg("value").alias("value"))
    )
    halves = means.groupBy("system", "category").agg(
        F.avg(F.when(F.col("metric").isin(list(domain_metrics)), F.col("value"))).alias("domain"),
        F.avg(F.when(F.col("metric").isin(list(ratio_metrics)), F.col("value"))).alias("ratio"),
    )
    return halves.select(
        "system", "category", half_up((F.col("domain") + F.col("ratio")) / 20, 6).alias("composite")
    )


def score_all(
    scores: DataFrame,
    systems: Sequence[str] | None = None,
    models: Sequence[str] | None = None,
) -> DataFrame:
    """Long scores to the final table in one plan: fill, average twice, lay out."""
    return reorganize(avg_global(avg_category_filled(scores)), systems, models)
