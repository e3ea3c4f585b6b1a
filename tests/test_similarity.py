import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgauge.operators import similarity as S

SCHEMA = "topic string, system string, facet string, item_no bigint, embedding array<float>"


def items(spark, sizes, seed=0, dim=6):
    """``sizes``: (topic, system, facet) to number of items; some are copies."""
    rng = np.random.default_rng(seed)
    rows = []
    for (topic, system, facet), n in sizes.items():
        vectors = rng.normal(size=(n, dim)).astype(np.float32)
        if n > 4:
            vectors[1] = vectors[0]
        rows += [(topic, system, facet, i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def brute(rows, baseline):
    best = {}
    for t, s, f, i, v in rows:
        truth = [np.array(w, dtype=np.float32) for a, b, c, _, w in rows if (a, b, c) == (t, baseline, f)]
        if truth:
            d = min(float(((np.array(v, dtype=np.float32).astype(float) - w.astype(float)) ** 2).sum()) for w in truth)
            best[(t, s, f, i)] = 1 - d
    return best


@pytest.mark.parametrize("block, few", [(3, True), (3, False), (2048, True)])
def test_nearest_matches_brute_force(spark, monkeypatch, block, few):
    if not few:
        monkeypatch.setattr(S, "broadcast_if_small", lambda df: df)
    # one topic holds most items, one facet has no baseline
    sizes = {
        ("hot", "base", "content"): 40, ("hot", "a", "content"): 70, ("hot", "b", "content"): 25,
        ("cold", "base", "outline"): 2, ("cold", "a", "outline"): 3, ("cold", "a", "reference"): 4,
    }
    rows, df = items(spark, sizes)
    got = {(r.topic, r.system, r.facet, r.item_no): r.score for r in S.nn_similarity(df, "base", block=block).collect()}
    want = brute(rows, "base")
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def clustered(spark, n, centres, seed=3, dim=8):
    """Two systems of ``n`` items in one topic, in clusters far apart."""
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, dim)) * 50
    rows = [
        ("t", system, "f", i, [float(x) for x in np.float32(at[i % centres] + rng.normal(size=dim))])
        for system in ("base", "a") for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, SCHEMA)


def exact(rows, k, metric):
    """(item, rank) to (near item, score) by all distances."""
    truth = np.array([r[4] for r in rows if r[1] == "base"])
    found = {}
    for _, system, _, i, v in rows:
        if system == "a":
            v = np.array(v)
            if metric == "cosine":
                scale = np.linalg.norm(truth, axis=1) * np.linalg.norm(v)
                d = 1 - np.divide(truth @ v, scale, out=np.zeros(len(truth)), where=scale > 0)
            else:
                d = ((truth - v) ** 2).sum(axis=1)
            for rank, j in enumerate(np.lexsort((np.arange(len(truth)), np.round(d, 12)))[:k], 1):
                found[i, rank] = (int(j), 1 - d[j])
    return found


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
@pytest.mark.parametrize("centres", [10, 400])
def test_pivots_leave_the_result_exact(spark, metric, centres):
    rows, _ = clustered(spark, 400, centres)
    rows[3] = (*rows[3][:4], [0.0] * 8)
    rows[405] = (*rows[405][:4], [0.0] * 8)
    rows[7] = (*rows[7][:4], rows[17][4])
    df = spark.createDataFrame(rows, SCHEMA)
    near = S.knn_query(df.filter("system = 'a'"), df.filter("system = 'base'"), 3, metric=metric, block=20).collect()
    got = {(r.item_no, r["rank"]): (r.near_id, r.score) for r in near}
    want = exact(rows, 3, metric)
    assert got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-9 for x in want)


def sent(spark, df, block):
    queries, stored = df.filter("system = 'a'"), df.filter("system = 'base'")
    left = queries.select("topic", "facet", "item_no", "embedding")
    right = stored.select("topic", "facet", F.col("item_no").alias("near_id"), F.col("embedding").alias("s_embedding"))
    dealt = S._dealt(left, right, ["topic", "facet"], ["item_no"], 3, "l2sq", block)
    return sum(side.count() for side in dealt)


def test_far_blocks_get_no_vectors(spark):
    # 20 blocks on either side: by id alone each of 800 vectors would travel 20 times
    assert sent(spark, clustered(spark, 400, 10)[1], 20) < 800 * 20 / 3
    # nothing is far from anything: no more than by id
    assert sent(spark, items(spark, {("t", "base", "f"): 400, ("t", "a", "f"): 400}, dim=30)[1], 20) <= 800 * 20


def test_blocks_grow_with_their_group(spark):
    # blocks of 3 would send each of 600 vectors 100 times
    assert sent(spark, items(spark, {("t", "base", "f"): 300, ("t", "a", "f"): 300}, dim=30)[1], 3) <= 600 * S.FEW_BLOCKS


def test_one_stored_block_needs_no_pivots(spark, monkeypatch):
    monkeypatch.setattr(S, "_pivots", None)
    rows, df = items(spark, {("t", "base", "f"): 4, ("t", "a", "f"): 90, ("u", "a", "f"): 90, ("v", "base", "f"): 2, ("v", "a", "f"): 3})
    got = {(r.topic, r.system, r.facet, r.item_no): r.score for r in S.nn_similarity(df, "base", block=10).collect()}
    want = brute(rows, "base")
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_large_topic_without_baseline(spark):
    _, df = items(spark, {("t", "a", "f"): 60, ("u", "base", "f"): 60, ("v", "a", "f"): 2, ("v", "base", "f"): 1})
    got = S.nn_similarity(df, "base", block=10).collect()
    assert {r.topic for r in got} == {"u", "v"} and len(got) == 63


def test_equal_vectors_rank_by_id(spark):
    rows = [("t", "s", "f", n, [1.0, 0.0]) for n in range(5)] + [("t", "s", "f", 9, [0.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    near = S.knn_query(df, df, k=3, block=2).filter("item_no = 4").orderBy("rank").collect()
    assert [(r.near_id, r.score) for r in near] == [(0, 1.0), (1, 1.0), (2, 1.0)]


def test_cosine_ignores_length(spark):
    rows = [("t", "base", "f", 0, [2.0, 0.0]), ("t", "a", "f", 0, [5.0, 0.0]), ("t", "a", "f", 1, [0.0, 1.0])]
    got = S.nn_similarity(spark.createDataFrame(rows, SCHEMA), "base", "cosine").filter("system = 'a'").orderBy("item_no")
    assert [round(r.score, 9) for r in got.collect()] == [1.0, 0.0]
    with pytest.raises(ValueError):
        S.knn_query(got, got, metric="dot")


def test_top_scores(spark):
    rows = [("t", "s", "outline", n, float(n)) for n in range(8)] + [("t", "s", "reference", n, 1.0) for n in range(25)]
    scored = spark.createDataFrame(rows, "topic string, system string, facet string, item_no bigint, score double")
    docs = spark.createDataFrame([("t", "s"), ("t", "empty")], "topic string, system string")
    got = {(r.system, r.facet): r for r in S.topn_mean_similarity(scored, docs=docs).collect()}
    assert got["s", "outline"].scores == [7.0, 6.0, 5.0, 4.0, 3.0] and got["s", "outline"].mean_score == 5.0
    assert len(got["s", "reference"].scores) == 20
    assert got["empty", "content"].mean_score == 0.0 and got["empty", "content"].scores == []
    assert {(r.system, r.facet) for r in S.sim_stale_facets(S.topn_mean_similarity(scored, docs=docs)).collect()} == {
        ("s", "content"), ("empty", "outline"), ("empty", "content"), ("empty", "reference"),
    }


def test_zero_vectors_have_cosine_zero(spark):
    rows = [("t", "base", "f", n, v) for n, v in enumerate([[0.0, 0.0], [1.0, 0.0], [0.0, 2.0]])] + [("t", "a", "f", 7, [0.0, 0.0]), ("t", "a", "f", 8, [3.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = S.knn_query(df.filter("system = 'a'"), df.filter("system = 'base'"), k=3, metric="cosine").collect()
    found = {(r.item_no, r.near_id): round(r.score, 9) for r in got}
    assert found == {(7, 0): 0.0, (7, 1): 0.0, (7, 2): 0.0, (8, 0): 0.0, (8, 1): 1.0, (8, 2): 0.0}
