"""Registered metric queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgauge.functions.numbers import half_up
from corpusgauge.operators import metrics as M
from corpusgauge.plans.registry import half_up_sql as hu
from corpusgauge.plans.registry import register
from corpusgauge.schema import DENSITIES


@register("structure_score", ("v_verdicts",), f"""WITH p AS (
 SELECT doc, parent_pos, depth, max(max_depth) AS m, count(child) AS n, count(*) FILTER (WHERE child IS NOT NULL AND lower(is_included) = 'yes') AS yes
 FROM v_verdicts GROUP BY ALL),
s AS (SELECT doc, CASE WHEN n = 0 THEN 1.0e0 ELSE yes / n END AS score, 1.0e0 - (depth - 1) / max(m) OVER (PARTITION BY doc) AS weight FROM p)
SELECT doc, {hu('sum(score * weight) / sum(weight) * 100', 4)} AS value FROM s GROUP BY doc""")
def structure_score(t):
    return M.structure_score(t.v_verdicts)


@register("faithfulness", ("v_responses",), f"""WITH s AS (SELECT DISTINCT category, system, sentence, total, supported FROM (
  SELECT category, system, sentence, max(total) AS total, supported FROM v_responses v
  WHERE supported = (SELECT max(w.supported) FROM v_responses w WHERE w.category = v.category AND w.system = v.system AND w.sentence IS NOT DISTINCT FROM v.sentence) GROUP BY ALL))
SELECT category, system, {hu(hu('sum(supported) / sum(total)', 4) + ' * 100', 2)} AS value FROM s GROUP BY category, system""")
def faithfulness(t):
    return M.faithfulness(t.v_responses, ["category", "system"])


@register("reference_quality", ("v_responses",), f"""
SELECT category, system, {hu('sum(supported) / sum(total) * 100', 2)} AS value FROM v_responses GROUP BY category, system""")
def reference_quality(t):
    return M.reference_quality(t.v_responses, ["category", "system"])


_UNSWAPPED = "un AS (SELECT category, topic, system, model, metric, CASE WHEN swapped THEN NOT is_better ELSE is_better END AS is_better FROM v_comparisons)"
_RATES = f"""
c AS (SELECT category, system, model, metric, sum(CASE WHEN is_better THEN 1 ELSE 0 END) AS wins, count(*) AS total FROM un GROUP BY category, system, model, metric
 UNION ALL SELECT NULL, system, model, metric, sum(CASE WHEN is_better THEN 1 ELSE 0 END), count(*) FROM un GROUP BY system, model, metric),
rates AS (SELECT category, system, model, metric, cast(wins AS bigint) AS wins, cast(total - wins AS bigint) AS losses, total,
 concat(printf('%.2f', {hu('wins / total * 100', 2)}), '%') AS win_rate FROM c)
"""


@register("pairwise_assign", ("v_comparisons",), """
SELECT category, topic, system, model, metric, swapped, position_1, is_better FROM (
 SELECT * REPLACE (strpos('13579bdf', substring(md5(concat_ws('|', category, topic, system, model, metric, '7')), 1, 1)) > 0 AS swapped),
  CASE WHEN strpos('13579bdf', substring(md5(concat_ws('|', category, topic, system, model, metric, '7')), 1, 1)) > 0 THEN 'baseline' ELSE system END AS position_1 FROM v_comparisons) x""")
def pairwise_assign(t):
    pairs = t.v_comparisons.drop("swapped").withColumn("other", F.lit("baseline"))
    out = M.pairwise_assign(pairs, "system", "other", ["category", "topic", "system", "model", "metric"], seed=7)
    return out.select("category", "topic", "system", "model", "metric", "swapped", "position_1", "is_better")


@register("pairwise_unswap", ("v_comparisons",), f"WITH {_UNSWAPPED} SELECT * FROM un")
def pairwise_unswap(t):
    return M.pairwise_unswap(t.v_comparisons).drop("swapped")


@register("win_rates", ("v_comparisons",), f"WITH {_UNSWAPPED}, {_RATES} SELECT * FROM rates")
def win_rates(t):
    return M.win_rates(M.pairwise_unswap(t.v_comparisons))


@register("win_rate_spread", ("v_comparisons",), f"""WITH {_UNSWAPPED}, {_RATES}
SELECT system, metric, count(*) AS runs, {hu('avg(r)', 6)} AS mean_rate, {hu('stddev_samp(r)', 6)} AS std_rate
FROM (SELECT system, metric, cast(rtrim(win_rate, '%') AS double) / 100 AS r FROM rates WHERE category IS NULL) x GROUP BY system, metric""")
def win_rate_spread(t):
    rates = M.win_rates(M.pairwise_unswap(t.v_comparisons))
    return M.win_rate_spread(rates.filter(F.col("category").isNull()))


_SQ = " + ".join(f"pow({c} - 1, 2)" for c in DENSITIES)


@register("density_similarity", ("v_density",), f"""
SELECT category, system, model, CASE WHEN system = 's0' THEN 1.0 ELSE {hu(f'1 / (1 + sqrt({_SQ}))', 6)} END AS similarity_score
FROM v_density""")
def density_similarity(t):
    return M.density_similarity(t.v_density, baseline="s0")


_START = "[1.0, 0.9, 0.8, 0.7, 0.6]::DOUBLE[]"


def _power(name: str, matrix: str) -> str:
    """Leading eigenvector of ``matrix`` by repeated multiplication."""
    return f"""
{name}_steps(n, v) AS (SELECT 0, {_START} UNION ALL SELECT n + 1, list_transform(w, lambda e: e / sqrt(list_dot_product(w, w)))
 FROM (SELECT n, list_transform(m, lambda r: list_dot_product(r, v)) AS w FROM {name}_steps, {matrix} WHERE n < 4000) x),
{name} AS (SELECT arg_max(v, n) AS v FROM {name}_steps)"""


_X = ", ".join(f"coalesce(cast({c} AS double), 0)" for c in DENSITIES)
_MU = ", ".join(f"avg(x[{n}])" for n in range(1, 6))


@register("density_pca", ("v_density",), f"""WITH RECURSIVE
d AS (SELECT category, system, model, [{_X}] AS x FROM v_density),
mu AS (SELECT [{_MU}] AS mu FROM d),
c AS (SELECT category, system, model, list_transform(list_zip(x, mu), lambda z: z[1] - z[2]) AS x FROM d, mu),
cov AS (SELECT i, j, sum(x[i] * x[j]) AS s FROM c, range(1, 6) a(i), range(1, 6) b(j) GROUP BY i, j),
mat AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS r FROM cov GROUP BY i) y),
{_power('one', 'mat')},
lam AS (SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM one, mat),
rest AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(s - l * v[i] * v[j] ORDER BY j) AS r FROM cov, lam GROUP BY i) y),
{_power('two', 'rest')}
SELECT category, system, model, {hu('abs(list_dot_product(x, one.v))', 6)} AS pc1, {hu('abs(list_dot_product(x, two.v))', 6)} AS pc2 FROM c, one, two""")
def density_pca(t):
    out = M.density_pca(t.v_density)
    return out.withColumns({c: half_up(F.abs(c), 6) for c in ("pc1", "pc2")})
