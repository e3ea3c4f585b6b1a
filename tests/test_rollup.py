import random

import pytest
from pyspark.sql import functions as F

from corpusgauge.operators import metrics as M
from corpusgauge.operators import rollup as R
from corpusgauge.schema import METRICS

SCORES = "category string, topic string, system string, model string, metric string, value double"


def scores(spark, rows):
    return spark.createDataFrame(rows, SCORES)


def random_scores(spark, n=400, seed=1):
    rng = random.Random(seed)
    cells = {}
    for _ in range(n):
        key = (rng.choice("ab"), str(rng.randint(0, 5)), rng.choice(["x", "y", "pdfs"]), rng.choice("mn"), rng.choice(METRICS))
        cells[key] = rng.choice([0.0, 0.0, round(rng.uniform(1, 5), 2)])
    return scores(spark, [(*k, v) for k, v in cells.items()])


def as_dict(df, *keys, value="value"):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def test_three_averages_differ_on_absent_metrics(spark):
    df = scores(spark, [("c", "1", "s", "m", "Outline", 4.0), ("c", "2", "s", "m", "Coverage", 3.0)])
    by_files = as_dict(R.avg_by_files(df), "metric")
    assert by_files == {("Outline",): 2.0, ("Coverage",): 1.5}
    assert as_dict(R.avg_category(df), "metric") == {("Outline",): 4.0, ("Coverage",): 3.0}
    macro = as_dict(R.avg_macro_system(R.avg_by_files(df)), "metric")
    assert macro == by_files


def test_zero_fill(spark):
    df = scores(
        spark,
        [
            ("c", "1", "s", "m", "Outline", 0.0), ("c", "2", "s", "n", "Outline", 4.0), ("c", "3", "s", "m", "Outline", 2.0),
            ("c", "1", "s", "m", "Coverage", 0.0), ("c", "1", "s", "m", "Unlisted", 0.0), ("c", "2", "s", "m", "Unlisted", 1.0),
            ("d", "1", "s", "m", "Outline", 0.0),
        ],
    )
    got = as_dict(R.zero_fill(df), "category", "topic", "metric")
    assert got["c", "1", "Outline"] == 3.0  # mean over both models
    assert got["c", "1", "Coverage"] == 0.0 and got["d", "1", "Outline"] == 0.0  # nothing to fill with
    assert got["c", "1", "Unlisted"] == 0.0


def test_filled_average_is_the_composition(spark):
    df = random_scores(spark)
    keys = ("category", "system", "model", "metric")
    assert as_dict(R.avg_category_filled(df), *keys) == as_dict(R.avg_category(R.zero_fill(df)), *keys)


def test_rounding_at_each_stage(spark):
    averages = spark.createDataFrame(
        [("a", "s", "m", "Outline", 1.004), ("b", "s", "m", "Outline", 1.004), ("c", "s", "m", "Outline", 1.0149)],
        "category string, system string, model string, metric string, value double",
    )
    assert as_dict(R.avg_global(averages), "metric") == {("Outline",): 1.0}
    assert as_dict(R.avg_global(averages, round_stages=False), "metric") == {("Outline",): 1.01}


def test_blend_ends(spark):
    df = random_scores(spark)
    docs = df.select("category", "topic", "system").distinct()
    facets = F.explode(F.array(*[F.lit(f) for f in ("outline", "content", "reference")]))
    for s in (0.0, 1.0):
        sim = docs.withColumn("facet", facets).withColumn("mean_score", F.lit(s))
        rows = M.sim_adjust(df, sim).collect()
        base = {(r.category, r.topic, r.model, r.metric): r.plain for r in rows if r.system == "pdfs"}
        for r in rows:
            if s == 0:
                assert r.balanced == r.perfect == r.plain
            else:
                assert r.balanced == base.get((r.category, r.topic, r.model, r.metric), 0.0)
                assert r.perfect == (100.0 if r.metric in ("Outline_structure", "Faithfulness", "Reference_quality") else 5.0)


def test_blend_of_documents_without_a_baseline_result(spark):
    cells = "category string, topic string, system string, model string, metric string, value double"
    df = spark.createDataFrame([("c", "1", "s", "m", "Outline", 4.0), ("c", "2", "pdfs", "m", "Outline", 3.0)], cells)
    sim = spark.createDataFrame([("c", "1", "s", "outline", 0.5)], "category string, topic string, system string, facet string, mean_score double")
    assert {r.topic for r in M.sim_adjust(df, sim).collect()} == {"2"}
    got = {(r.topic, r.metric): (r.plain, r.balanced, r.perfect) for r in M.sim_adjust(df, sim, unbased=True).collect()}
    assert len(got) == 20 and got["1", "Outline"] == (4.0, 2.0, 4.5) and got["1", "Coverage"] == (0.0, 0.0, 0.0)


def of_all_topics(spark, key):
    """Whether a query blends every document of v_scores, in all metrics."""
    from corpusgauge.plans import load
    from corpusgauge.plans.views import view

    doc = ["category", "topic", "system", "model"]
    sf_dir = "/root/testdata/sf0.001"
    rows = load()[0][key](spark, sf_dir)
    docs = view(spark, sf_dir, "v_scores").select(*doc).distinct()
    return rows.groupBy(*doc).count().where("count = 10").select(*doc).exceptAll(docs).isEmpty() and rows.count() == 10 * docs.count()


def test_balanced_blend_is_of_all_documents(spark):
    assert of_all_topics(spark, "sim_adjust_balanced")


def test_perfect_blend_is_of_all_documents(spark):
    assert of_all_topics(spark, "sim_adjust_perfect")


def test_leaderboard(spark):
    rows = [
        ("c", "1", "s", "m", "Outline", 4.0, 3.0, 5.0), ("c", "2", "s", "m", "Faithfulness", 50.0, 60.0, 80.0),
        ("c", "1", "pdfs", "m", "Faithfulness", 90.0, 1.0, 1.0),
    ]
    adjusted = spark.createDataFrame(
        rows, "category string, topic string, system string, model string, metric string, plain double, balanced double, perfect double"
    )
    got = {(r.system, r.type): r for r in R.leaderboard(adjusted).collect()}
    assert len(got) == 6
    assert got["s", "plain"].Outline == 2.0 and got["s", "plain"].Faithfulness == 1.25
    assert got["s", "perfect"].normalized_average == round(80 / 2 / 20 / 3, 2)
    assert {got["pdfs", t].Faithfulness for t in ("plain", "balanced", "perfect")} == {4.5}


def test_reorganize_fills_columns(spark):
    averages = spark.createDataFrame(
        [("s", "m", "Outline", 3.456), ("t", "m", "Outline", 1.0)], "system string, model string, metric string, value double"
    )
    rows = R.reorganize(averages, systems=["s"]).collect()
    assert len(rows) == 1 and rows[0].Outline == "3.46" and rows[0].Coverage == ""
    assert rows[0].__fields__ == ["system", "model", *METRICS]


def test_ratio_to_baseline(spark):
    averages = spark.createDataFrame(
        [("pdfs", "m", "x", 4.0), ("s", "m", "x", 1.0), ("s", "n", "x", 1.0), ("pdfs", "m", "z", 0.0), ("s", "m", "z", 1.0)],
        "system string, model string, metric string, value double",
    )
    got = as_dict(R.ratio_to_baseline(averages), "system", "model", "metric", value="ratio")
    assert got == {
        ("pdfs", "m", "x"): 1.0, ("s", "m", "x"): 0.25, ("s", "n", "x"): None,
        ("pdfs", "m", "z"): 1.0, ("s", "m", "z"): None,
    }


def test_heatmap_prefers_domain_columns(spark):
    averages = spark.createDataFrame(
        [("c", "s", "m", "Outline", 80.0), ("c", "s", "m", "Outline_domain", 3.0), ("c", "s", "m", "Faithfulness", 0.0)],
        "category string, system string, model string, metric string, value double",
    )
    got = {(r.system, r.metric): r for r in R.heatmap_matrix(averages, ["s", "gone"], ["Outline", "Faithfulness"]).collect()}
    assert got["s", "Outline"].shown == "Outline_domain" and got["s", "Outline"].cell == 0.5
    assert got["s", "Faithfulness"].masked and got["gone", "Outline"].masked and not got["s", "Outline"].masked


def test_composites(spark):
    df = scores(spark, [("c", "1", "s", "m", "Coverage", 2.0), ("c", "1", "s", "m", "Language", 4.0), ("c", "1", "s", "m", "Faithfulness", 20.0)])
    got = as_dict(R.radar_series(df, ["Content", "Faithfulness", "Outline"], {"s": "S!"}, floor=50), "display", "metric")
    assert got == {("S!", "Content"): 50.0, ("S!", "Faithfulness"): 50.0, ("S!", "Outline"): None}
    averages = df.drop("topic")
    composite = as_dict(R.domain_composite(averages, ["Coverage", "Language"], ["Faithfulness"]), "system", value="composite")
    assert composite == {("s",): (3 + 20) / 20}
    dens = spark.createDataFrame([("a", 1.2, 1.4), ("b", 0.5, None), ("d", None, None)], "system string, p double, q double")
    assert as_dict(R.informativeness(dens, ["p", "q"]), "system", value="informativeness") == {("a",): 5.0, ("b",): 2.5, ("d",): None}
    feats = spark.createDataFrame([("a", "f", 1.0), ("b", "f", 3.0), ("a", "g", 2.0)], "category string, feature string, value double")
    assert as_dict(R.feature_minmax(feats), "category", "feature", value="scaled") == {("a", "f"): 0.0, ("b", "f"): 1.0, ("a", "g"): None}


def test_structure_score(spark):
    rows = [
        ("d", 0, 1, 3, 0, "Yes"), ("d", 0, 1, 3, 1, "no"), ("d", 4, 2, 3, 0, "YES"), ("d", 5, 2, 3, None, None),
        ("e", 0, 1, 2, 0, "Yes"), ("e", 0, 1, 2, 1, None),  # an unjudged child is one of two
        ("f", 0, 1, 3, 0, "Yes"), ("f", 1, 2, 3, 0, "No"),  # parents at 1 and 2 of three levels
    ]
    verdicts = spark.createDataFrame(rows, "doc string, parent_pos int, depth int, max_depth int, child int, is_included string")
    docs = spark.createDataFrame([("d",), ("flat",)], "doc string")
    got = as_dict(M.structure_score(verdicts, docs), "doc")
    want = (0.5 * 3 / 3 + 1 * 2 / 3 + 1 * 2 / 3) / (3 / 3 + 2 / 3 + 2 / 3) * 100
    assert got == {("d",): round(want, 4), ("flat",): 100.0}
    every = as_dict(M.structure_score(verdicts), "doc")
    assert every[("e",)] == 50.0 and every[("f",)] == 60.0


def test_support_shares(spark):
    rows = [("d", "same", 3, 1), ("d", "same", 3, 1), ("d", "other", 3, 2), ("e", "x", 0, 0)]
    verdicts = spark.createDataFrame(rows, "doc string, sentence string, total int, supported int")
    assert as_dict(M.faithfulness(verdicts, ["doc"]), "doc") == {("d",): 50.0, ("e",): 0.0}
    assert as_dict(M.reference_quality(verdicts, ["doc"]), "doc") == {("d",): 44.44, ("e",): 0.0}


def test_win_rates_add_up(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice("xy"), rng.choice("mn"), "outline", rng.choice([True, False, None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "category string, system string, model string, metric string, is_better boolean")
    rates = M.win_rates(df).collect()
    assert all(r.wins + r.losses == r.total > 0 for r in rates)
    total = sum(r.total for r in rates if r.category is None)
    assert total == sum(r.total for r in rates if r.category is not None) == sum(r[4] is not None for r in rows)
    spread = M.win_rate_spread(M.win_rates(df).filter("category IS NULL")).collect()
    assert all(r.runs == 2 for r in spread)


def test_swap_is_fair_and_undone(spark):
    pairs = spark.range(2000).select(F.col("id").cast("string").alias("k"), F.lit("sys").alias("a"), F.lit("base").alias("b"))
    placed = M.pairwise_assign(pairs, "a", "b", ["k"], seed=3)
    share = placed.agg(F.avg(F.col("swapped").cast("int"))).first()[0]
    assert 0.4 < share < 0.6
    judged = M.pairwise_unswap(placed.withColumn("is_better", F.col("position_1") == "sys"))
    assert judged.filter("NOT is_better").count() == 0


def test_density_similarity(spark):
    rows = [("s0", "m", 1.0, 1.0), ("s", "m", 1.0, 3.0), ("s", "m", None, 1.0), ("s", "lone", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "system string, model string, p double, q double")
    got = [r.similarity_score for r in M.density_similarity(df, "s0", ["p", "q"]).orderBy("model", "system", "similarity_score").collect()]
    assert got == [None, pytest.approx(1 / 3, abs=1e-6), 1.0, 1.0]


def test_pca_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 3)) * [3, 1, 0.1]
    df = spark.createDataFrame([(f"s{n}", *map(float, v)) for n, v in enumerate(x)], "system string, p double, q double, r double")
    got = M.density_pca(df, ["p", "q", "r"]).orderBy(F.substring("system", 2, 9).cast("int")).collect()
    centred = x - x.mean(0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    want = np.abs(centred @ vt[:2].T)
    assert np.allclose(np.abs([[r.pc1, r.pc2] for r in got]), want, atol=1e-6)
