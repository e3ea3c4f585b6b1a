import datetime as dt
import json
import random

from pyspark.sql import functions as F

from corpusgauge.operators import curation as Q
from corpusgauge.operators import words as W

NOW = dt.datetime(2024, 6, 1)
PAPERS = "arxiv_id string, title string, summary string, published timestamp, citation_count long, fine_category string"


def test_titles(spark):
    rows = [
        ("1", "A Survey of X", "", NOW, 1, "cs.AI"), ("2", "Peer Review and a survey of X", "", NOW, 1, "cs.AI"),
        ("3", "Notes", "In THIS SURVEY we", NOW, 1, "cs.AI"), ("4", "Notes", "we study", NOW, 1, "cs.AI"),
    ]
    got = Q.survey_title_filter(spark.createDataFrame(rows, PAPERS))
    assert sorted(r.arxiv_id for r in got.collect()) == ["1", "3"]


def test_categories_and_ids(spark):
    fine = ["cs.AI", "astro-ph.GA", "hep-th", "q-bio.QM", "quant-ph", "eess.SP", "unknown.X"]
    df = spark.createDataFrame([(f,) for f in fine], "fine_category string")
    got = [r.category for r in Q.category_rollup(df).collect()]
    assert got == ["cs", "physics", "physics", "q-bio", "physics", "eess", None]
    urls = spark.createDataFrame([("http://arxiv.org/abs/2401.00001v12",), ("2401.2",)], "url string")
    assert [r.arxiv_id for r in Q.paper_ids(urls).collect()] == ["2401.00001", "2401.2"]


def loop_top_cited(papers, held, num, cross=False):
    """The search one category and one window at a time."""
    start, end = Q.time_bounds(NOW)
    seen, out = set(), {}
    for coarse, parts in Q.CATEGORY_PARTS.items():
        mine = {i for c, i in held if c == coarse}
        seen |= mine
        need = max(num - len(mine), 0)
        found, lo, hi, tries = {}, start, end, 0
        while len(found) < need and tries < Q.MAX_WINDOWS:
            inside = [
                p for p in papers
                if p[5].split(".")[0] in parts and lo <= p[3] <= hi and (cross or p[0] not in seen) and p[0] not in found
                and not (cross and p[0] in seen and any(i == p[0] for _, i in held))
            ]
            for p in sorted(inside, key=lambda p: p[3], reverse=True):
                found.setdefault(p[0], p)
            lo, hi, tries = lo - dt.timedelta(days=365), lo, tries + 1
        if not cross:
            seen |= set(found)
        best = sorted(found.values(), key=lambda p: (-p[4], p[0]))[:need]
        out[coarse] = [p[0] for p in best]
    return {c: ids for c, ids in out.items() if ids}


def test_top_cited_matches_a_loop(spark):
    rng = random.Random(8)
    papers, held = [], []
    for n in range(260):
        cited = rng.randint(0, 40)
        day = NOW - dt.timedelta(days=rng.randint(10, 3600), hours=rng.randint(0, 23))
        for fine in rng.sample(["cs.AI", "cs.DB", "stat.ML", "math.CO", "hep-th", "econ.EM"], rng.choice([1, 1, 2, 3])):
            papers.append((str(n), f"a survey of {n}", "", day, cited, fine))
        if n % 23 == 0:
            held.append((rng.choice(["cs", "math"]), str(n)))
    held_df = spark.createDataFrame(held, "category string, arxiv_id string")
    df = spark.createDataFrame(papers, PAPERS)
    for num in (4, 30, 500):
        got = {}
        for r in Q.top_cited(df, NOW, num, held_df).orderBy("category", "rank").collect():
            got.setdefault(r.category, []).append(r.arxiv_id)
        assert got == loop_top_cited(papers, held, num), num


def test_existing_papers_lower_the_need(spark):
    cand = spark.createDataFrame([("cs", str(n), n) for n in range(6)], "category string, arxiv_id string, citation_count int")
    held = spark.createDataFrame([("cs", "5"), ("cs", "x")], "category string, arxiv_id string")
    got = Q.existing_exclude(cand, held, num=4).orderBy("rank").collect()
    assert [r.arxiv_id for r in got] == ["4", "3"]


def test_clusters_keep_the_old_order(spark):
    schema = "topic string, pos int, arxiv_id string, title string"
    old = spark.createDataFrame([("a", 0, "1", "one"), ("a", 1, "2", "two")], schema)
    new = spark.createDataFrame([("a", 0, "2", "again"), ("a", 1, "3", "three"), ("b", 0, "2", "two")], schema)
    rows = Q.merge_clusters(old, new).orderBy("topic", "source", "pos").collect()
    assert [(r.topic, r.arxiv_id, r.title) for r in rows] == [("a", "1", "one"), ("a", "2", "two"), ("a", "3", "three"), ("b", "2", "two")]


def test_batches_of_titles(spark):
    papers = spark.createDataFrame([("cs", f"{n:03d}", f"t{n}") for n in range(25)], "category string, arxiv_id string, title string")
    batches = Q.title_batches(papers, size=10).orderBy("batch_no").collect()
    assert [b.n for b in batches] == [10, 10, 5]
    assert [p["arxiv_id"] for p in json.loads(batches[1].papers)] == [f"{n:03d}" for n in range(10, 20)]
    cut = Q.title_batches(papers, size=10, buckets=3)
    more = papers.unionByName(papers.selectExpr("category", "concat('x', arxiv_id) AS arxiv_id", "title"))
    assert cut.groupBy("bucket").count().count() == 3  # and the bucket of a paper does not follow the number of papers
    bucket = {p["arxiv_id"]: r.bucket for r in Q.title_batches(more, size=1, buckets=3).collect() for p in json.loads(r.papers)}
    assert all(bucket[p["arxiv_id"]] == r.bucket for r in cut.collect() for p in json.loads(r.papers))
    labels = Q.assign_topics(papers, lambda prompt: "oops")
    assert labels.count() == 0


def test_words(spark):
    text = "```gpu code``` Graph graphs `tree` https://x.org/a_b me@x.org the GRAPH 3d rhythm, tensor_x été xml bcd"
    df = spark.createDataFrame([("c", text), ("c", "graph")], "category string, text string")
    got = {r.word: r["count"] for r in W.word_frequency(df).collect()}
    assert got == {"graph": 3, "graphs": 1, "rhythm": 1}
    known = spark.createDataFrame([("graphs",)], "word string")
    ranked = W.word_frequency(df, known, top=2).orderBy("rank").collect()
    assert [(r.word, r["count"], r["rank"]) for r in ranked] == [("graph", 3, 1), ("graphs", 1, 2)]
    assert df.select(F.col("text")).count() == 2
