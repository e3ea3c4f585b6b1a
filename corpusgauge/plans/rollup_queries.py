"""Registered roll-ups with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgauge.operators import metrics as M
from corpusgauge.operators import rollup as R
from corpusgauge.plans.registry import half_up_sql as hu
from corpusgauge.plans.registry import register
from corpusgauge.schema import CONTENT_CRITERIA, DENSITIES, METRICS, RATIO_METRICS, ZERO_FILLED_METRICS, facet_of

SYSTEMS = ["click", "error", "purchase", "signup", "view", "absent"]
_IN = ", ".join(f"'{m}'" for m in ZERO_FILLED_METRICS)
_RATIO = ", ".join(f"'{m}'" for m in RATIO_METRICS)

FILLED = f"""
filled AS (
 SELECT s.category, s.topic, s.system, s.model, s.metric,
  CASE WHEN s.metric IN ({_IN}) AND s.value = 0 THEN coalesce(m.mean, s.value) ELSE s.value END AS value
 FROM v_scores s LEFT JOIN (
  SELECT category, system, metric, avg(value) AS mean FROM v_scores WHERE value <> 0 GROUP BY ALL) m
 ON s.category = m.category AND s.system = m.system AND s.metric = m.metric)
"""
CAT_AVG = f"""
cat_avg AS (SELECT category, system, model, metric, {hu('avg(value)', 4)} AS value FROM filled GROUP BY category, system, model, metric)
"""
GLOBAL = f"""
overall AS (SELECT system, model, metric, {hu('avg(v2)', 2)} AS value
 FROM (SELECT *, {hu('value', 2)} AS v2 FROM cat_avg) x GROUP BY system, model, metric)
"""
PLAIN_AVG = f"""
plain_avg AS (SELECT category, system, model, metric, {hu('avg(value)', 4)} AS value FROM v_scores GROUP BY category, system, model, metric)
"""
BY_FILES = f"""
by_files AS (
 SELECT t.category, t.system, t.model, t.metric, {hu('t.total / f.files', 4)} AS value
 FROM (SELECT category, system, model, metric, sum(value) AS total FROM v_scores GROUP BY ALL) t
 JOIN (SELECT category, system, model, count(DISTINCT topic) AS files FROM v_scores GROUP BY ALL) f
 ON t.category = f.category AND t.system = f.system AND t.model = f.model)
"""


def _cells(source: str) -> str:
    return ", ".join(
        f"coalesce(printf('%.2f', max(CASE WHEN metric = '{m}' THEN {source} END)), '') AS {m}" for m in METRICS
    )


@register("avg_by_files", ("v_scores",), f"WITH {BY_FILES} SELECT * FROM by_files")
def avg_by_files(t):
    return R.avg_by_files(t.v_scores)


@register("avg_macro_system", ("v_scores",), f"""WITH {BY_FILES}
SELECT a.system, a.model, a.metric, {hu('sum(a.value) / max(c.cats)', 4)} AS value FROM by_files a
JOIN (SELECT system, model, count(DISTINCT category) AS cats FROM by_files GROUP BY ALL) c ON a.system = c.system AND a.model = c.model
GROUP BY a.system, a.model, a.metric""")
def avg_macro_system(t):
    return R.avg_macro_system(R.avg_by_files(t.v_scores))


@register("zero_fill", ("v_scores",), f"WITH {FILLED} SELECT category, topic, system, model, metric, {hu('value', 6)} AS value FROM filled")
def zero_fill(t):
    return R.zero_fill(t.v_scores).withColumn("value", R.half_up(F.col("value"), 6))


@register("avg_category", ("v_scores",), f"WITH {FILLED}, {CAT_AVG} SELECT * FROM cat_avg")
def avg_category(t):
    return R.avg_category(R.zero_fill(t.v_scores))


@register("avg_category_filled", ("v_scores",), f"WITH {FILLED}, {CAT_AVG} SELECT * FROM cat_avg")
def avg_category_filled(t):
    return R.avg_category_filled(t.v_scores)


@register("avg_global", ("v_scores",), f"WITH {FILLED}, {CAT_AVG}, {GLOBAL} SELECT * FROM overall")
def avg_global(t):
    return R.avg_global(R.avg_category_filled(t.v_scores))


@register("reorganize", ("v_scores",), f"""WITH {PLAIN_AVG}, p2 AS (SELECT system, model, metric, {hu('avg(v2)', 2)} AS value
 FROM (SELECT *, {hu('value', 2)} AS v2 FROM plain_avg) x GROUP BY system, model, metric)
SELECT system, model, {_cells('value')} FROM p2 WHERE system IN ('click', 'view', 'error') GROUP BY system, model""")
def reorganize(t):
    return R.reorganize(R.avg_global(R.avg_category(t.v_scores)), systems=["click", "view", "error"])


@register("score_all", ("v_scores",), f"WITH {FILLED}, {CAT_AVG}, {GLOBAL} SELECT system, model, {_cells('value')} FROM overall GROUP BY system, model")
def score_all(t):
    return R.score_all(t.v_scores)


@register("ratio_to_baseline", ("v_scores",), f"""WITH {FILLED}, {CAT_AVG}, {GLOBAL}
SELECT g.system, g.model, g.metric, CASE WHEN g.system = 'view' THEN 1.0 WHEN b.value <> 0 THEN {hu('g.value / b.value', 2)} END AS ratio
FROM overall g LEFT JOIN overall b ON b.system = 'view' AND b.model = g.model AND b.metric = g.metric""")
def ratio_to_baseline(t):
    return R.ratio_to_baseline(R.avg_global(R.avg_category_filled(t.v_scores)), baseline="view")


_GRID = " UNION ALL ".join(f"SELECT '{s}' AS system" for s in SYSTEMS)
_METRIC_ROWS = " UNION ALL ".join(f"SELECT '{m}' AS metric" for m in METRICS)


@register("heatmap_matrix", ("v_scores",), f"""WITH {FILLED}, {CAT_AVG}
SELECT g.category, g.system, g.metric, g.metric AS shown,
 CASE WHEN m.value <> 0 THEN {hu('m.value / 100', 6)} END AS cell, coalesce(m.value = 0, true) AS masked
FROM (SELECT category, system, metric FROM (SELECT DISTINCT category FROM cat_avg), ({_GRID}), ({_METRIC_ROWS})) g
LEFT JOIN (SELECT category, system, metric, avg(value) AS value FROM cat_avg GROUP BY ALL) m
ON g.category = m.category AND g.system = m.system AND g.metric = m.metric""")
def heatmap_matrix(t):
    return R.heatmap_matrix(R.avg_category_filled(t.v_scores), SYSTEMS, METRICS)


_LONG_DENSITY = " UNION ALL ".join(
    f"SELECT category, '{c}' AS feature, avg({c}) AS value FROM v_density GROUP BY category" for c in DENSITIES
)


@register("feature_minmax", ("v_density",), f"""WITH f AS ({_LONG_DENSITY}),
e AS (SELECT feature, min(value) AS low, max(value) AS high FROM f GROUP BY feature)
SELECT f.category, f.feature, {hu('f.value', 6)} AS value,
 CASE WHEN high <> low THEN {hu('(f.value - low) / (high - low)', 6)} END AS scaled FROM f JOIN e ON f.feature = e.feature""")
def feature_minmax(t):
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in DENSITIES]
    means = t.v_density.groupBy("category").agg(*[F.avg(c).alias(c) for c in DENSITIES])
    long = means.select("category", F.inline(F.array(*cells)))
    return R.feature_minmax(long).withColumn("value", R.half_up(F.col("value"), 6))


_NAMES = {"view": "Human", "click": "System C"}
_CONTENT_AVG = ", ".join(f"'{c}'" for c in CONTENT_CRITERIA)


@register("radar_series", ("v_scores",), f"""WITH {FILLED},
m AS (SELECT system, metric, avg(value) AS value FROM filled GROUP BY system, metric)
SELECT system, CASE system WHEN 'view' THEN 'Human' WHEN 'click' THEN 'System C' ELSE system END AS display, metric, {hu('greatest(value, 50)', 6)} AS value FROM (
 SELECT system, metric, value FROM m WHERE metric IN ('Outline', {_RATIO})
 UNION ALL SELECT system, 'Content' AS metric, avg(value) AS value FROM m WHERE metric IN ({_CONTENT_AVG}) GROUP BY system)""")
def radar_series(t):
    return R.radar_series(R.zero_fill(t.v_scores), ["Outline", "Content", *RATIO_METRICS], names=_NAMES, floor=50)


@register("informativeness", ("v_density",), f"""
SELECT category, system, model, CASE WHEN m > 1 THEN 5.0 ELSE {hu('m * 5', 6)} END AS informativeness
FROM (SELECT *, ({' + '.join(DENSITIES)}) / 5 AS m FROM v_density) x""")
def informativeness(t):
    return R.informativeness(t.v_density)


_DOMAIN = ["Outline", "Coverage", "Structure", "Relevance", "Language", "Criticalness", "Reference"]


@register("domain_composite", ("v_scores",), f"""WITH {FILLED}, {CAT_AVG},
m AS (SELECT system, category, metric, avg(value) AS value FROM cat_avg GROUP BY ALL)
SELECT system, category, {hu(f"(avg(value) FILTER (WHERE metric NOT IN ({_RATIO})) + avg(value) FILTER (WHERE metric IN ({_RATIO}))) / 20", 6)} AS composite
FROM m GROUP BY system, category""")
def domain_composite(t):
    return R.domain_composite(R.avg_category_filled(t.v_scores), _DOMAIN, RATIO_METRICS)


_FACET_CASE = "CASE " + " ".join(f"WHEN metric = '{m}' THEN '{facet_of(m)}'" for m in METRICS) + " END"
_ALL = f"""
allm AS (SELECT DISTINCT category, topic, system, model, m.metric, {_FACET_CASE.replace('metric =', 'm.metric =')} AS facet
 FROM v_scores, ({_METRIC_ROWS}) m),
adj AS (
 SELECT a.category, a.topic, a.system, a.model, a.metric, coalesce(s.value, 0) AS plain, coalesce(v.mean_score, 0) AS w, coalesce(b.value, 0) AS base,
  CASE WHEN a.metric IN ({_RATIO}) THEN 100.0 ELSE 5.0 END AS best
 FROM allm a LEFT JOIN v_scores s USING (category, topic, system, model, metric)
 LEFT JOIN v_scores b ON b.system = 'view' AND b.category = a.category AND b.topic = a.topic AND b.model = a.model AND b.metric = a.metric
 LEFT JOIN v_similarity v ON v.category = a.category AND v.topic = a.topic AND v.system = a.system AND v.facet = a.facet),
blend AS (SELECT category, topic, system, model, metric, plain, (1 - w) * plain + w * base AS balanced, (1 - w) * plain + w * best AS perfect FROM adj)
"""
_KEYS5 = "category, topic, system, model, metric"


@register("sim_adjust_balanced", ("v_scores", "v_similarity"), f"WITH {_ALL} SELECT {_KEYS5}, {hu('balanced', 6)} AS value FROM blend")
def sim_adjust_balanced(t):
    out = M.sim_adjust(t.v_scores, t.v_similarity, baseline="view", unbased=True)
    return out.select("category", "topic", "system", "model", "metric", R.half_up(F.col("balanced"), 6).alias("value"))


@register("sim_adjust_perfect", ("v_scores", "v_similarity"), f"WITH {_ALL} SELECT {_KEYS5}, {hu('perfect', 6)} AS value FROM blend")
def sim_adjust_perfect(t):
    out = M.sim_adjust(t.v_scores, t.v_similarity, baseline="view", unbased=True)
    return out.select("category", "topic", "system", "model", "metric", R.half_up(F.col("perfect"), 6).alias("value"))


_BOARD_CELLS = ", ".join(
    f"{hu(f'''coalesce(max(CASE WHEN metric = '{m}' THEN value END), 0)''', 2)} AS {m}" for m in METRICS
)


BOARD = f"""d AS (SELECT system, model, count(DISTINCT (category, topic)) AS docs FROM blend GROUP BY ALL),
l AS (
 SELECT b.system, b.model, k.type, b.metric,
  sum(CASE WHEN b.system = 'view' OR k.type = 'plain' THEN plain WHEN k.type = 'balanced' THEN balanced ELSE perfect END) / max(docs)
   / (CASE WHEN b.metric IN ({_RATIO}) THEN 20 ELSE 1 END) AS value
 FROM blend b JOIN d ON d.system = b.system AND d.model = b.model, (VALUES ('plain'), ('balanced'), ('perfect')) k(type)
 GROUP BY b.system, b.model, k.type, b.metric)
SELECT system, model, type, {hu(f"sum(CASE WHEN metric IN ({_RATIO}) THEN value ELSE 0 END) / 3", 2)} AS normalized_average, {_BOARD_CELLS}
FROM l GROUP BY system, model, type"""
BLEND = _ALL


@register("leaderboard", ("v_scores", "v_similarity"), f"WITH {_ALL}, {BOARD}")
def leaderboard(t):
    return R.leaderboard(M.sim_adjust(t.v_scores, t.v_similarity, baseline="view"), baseline="view")
