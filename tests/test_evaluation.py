import json
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusgauge.operators import judging as J
from corpusgauge.operators import outline as O
from corpusgauge.plans import evaluation as E
from corpusgauge.schema import METRICS

# the scorers below travel with the task
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOCS = "category string, topic string, system string, md string"
GOOD = "# T\n## A\nText [1]. Text [1]. More [2].\n### B\nx\n## References\n[1] one\n[2] two"


def docs(spark):
    return spark.createDataFrame([("c", "t", "s", GOOD), ("c", "t", "pdfs", GOOD), ("c", "t", "bare", "no headings at all")], DOCS)


def fixed(prompt):
    """Grades by what is asked; every prompt in the right place gets its own mark."""
    if "levels" in prompt:
        return "none"
    if "children" in prompt:
        return json.dumps({"children": [{"child_index": 1, "is_included": "yes"}, {"child_index": 2, "is_included": "No"}]})
    if "Sentence:" in prompt:
        return json.dumps({"total": 2, "supported": 1 if "More" in prompt else 2})
    if "strongly" in prompt:
        return "Sure " + json.dumps({"total": 3, "supported": 1})
    return json.dumps({"Outline": 4, "Coverage": 3, "Structure": 2, "Relevance": "bad", "Reference": 5, "Language": 1})


def test_scores_of_every_metric(spark):
    rows = E.evaluate_documents(docs(spark), fixed, "m").collect()
    assert len(rows) == 3 * len(METRICS)
    got = {r.metric: r.value for r in rows if r.system == "s"}
    assert got == {
        "Outline": 4.0, "Outline_structure": 50.0, "Coverage": 3.0, "Structure": 2.0, "Relevance": 0.0, "Language": 1.0,
        "Criticalness": 0.0, "Faithfulness": 75.0, "Reference": 5.0, "Reference_quality": 33.33,
    }
    bare = {r.metric: r.value for r in rows if r.system == "bare"}
    assert bare["Outline_structure"] == 100.0 and bare["Faithfulness"] == 0.0 and bare["Reference_quality"] == 0.0


def test_only_open_facets_are_asked_again(spark):
    done = E.evaluate_documents(docs(spark), fixed, "m")
    kept = done.filter("NOT (system = 's' AND metric = 'Coverage')")

    def other(prompt):
        assert "Grade each criterion" in prompt or "Sentence:" in prompt
        return json.dumps({"Coverage": 5, "total": 1, "supported": 1})

    rows = E.evaluate_documents(docs(spark), other, "m", done=kept).collect()
    got = {(r.system, r.metric): r.value for r in rows}
    assert len(got) == 3 * len(METRICS)
    assert got["s", "Coverage"] == 5.0 and got["s", "Faithfulness"] == 100.0 and got["s", "Outline"] == 4.0
    assert got["pdfs", "Coverage"] == 3.0 and got["pdfs", "Faithfulness"] == 75.0


def test_a_finished_corpus_sends_no_prompt(spark):
    flat = docs(spark).unionByName(spark.createDataFrame([("c", "u", "s", "# A\nx\n# B\ny")], DOCS))
    done = E.evaluate_documents(flat, fixed, "m")

    def never(prompt):
        raise AssertionError(prompt)

    again = E.evaluate_documents(flat, never, "m", done=done)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, done.collect()))


def test_a_second_run_repairs_what_a_judge_failed(spark):
    def failing(prompt):
        if "children" in prompt or "strongly" in prompt or "Grade each criterion" in prompt:
            raise RuntimeError("no answer")
        return fixed(prompt)

    first = E.evaluate_documents(docs(spark), failing, "m", attempts=1)
    want = E.evaluate_documents(docs(spark), fixed, "m")

    def repairing(prompt):
        assert "Sentence:" not in prompt and "levels" not in prompt
        return fixed(prompt)

    got = {(r.topic, r.system, r.metric): r.value for r in E.supplement_scores(docs(spark), first, repairing, "m").collect()}
    whole = {(r.topic, r.system, r.metric): r.value for r in want.collect()}
    broken = {(r.topic, r.system, r.metric): r.value for r in first.collect()}
    assert broken != whole and got == {k: v if broken[k] == 0 else broken[k] for k, v in whole.items()}


def test_scores_are_computed_once_to_be_supplemented(spark):
    kinds, seen = "category string, topic string, system string, model string, metric string, value double", spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = [(d.category, d.topic, d.system, "m", "Reference", 3.0) for d in docs(spark).collect()]
    scores = spark.createDataFrame(rows, kinds).mapInPandas(counted, kinds)
    E.supplement_scores(docs(spark), scores, fixed, "m").collect()
    assert seen.value == len(rows)


def test_prompts_and_items_read_the_corpus_once(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "corpus"))
    corpus = spark.read.parquet(str(tmp_path / "corpus"))
    plan = E.parsed_documents(corpus)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_compared_pairs_are_not_compared_again(spark):
    def wins(prompt):
        return json.dumps({"is_better": True})

    first = E.comparison_verdicts(docs(spark), wins, model="m")
    kept = first.filter("metric <> 'content'").withColumn("is_better", F.lit(None).cast("boolean") | F.lit(True))
    rows = E.comparison_verdicts(docs(spark), wins, model="m", done=kept).collect()
    assert len(rows) == len({(r.system, r.metric) for r in rows}) == first.count() == 6

    def never(prompt):
        raise AssertionError(prompt)

    again = E.comparison_verdicts(docs(spark), never, model="m", done=first).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, first.collect()))
    total = [r.total for r in E.compare_documents(docs(spark), never, model="m", done=first).collect() if r.category is None]
    assert total == [1] * 6


def test_refinement_needs_a_list_of_pairs(spark):
    outline = spark.createDataFrame(
        [("c", t, "s", p, 1, f"h{p}") for t in "abc" for p in range(3)],
        "category string, topic string, system string, pos int, level int, title string",
    )
    answers = spark.createDataFrame(
        [("c", "a", "s", 'ok [[1, "h0"], [2, "h, 2"]]'), ("c", "b", "s", '[["x", "h0"]]'), ("c", "c", "s", "[]")],
        "category string, topic string, system string, raw string",
    )
    got = {}
    for r in O.apply_refinement(outline, answers).orderBy("topic", "pos").collect():
        got.setdefault(r.topic, []).append((r.level, r.title))
    flat = [(1, "h0"), (1, "h1"), (1, "h2")]
    assert got == {"a": [(1, "h0"), (2, "h, 2")], "b": flat, "c": flat}


def test_own_baseline_scores_one(spark):
    rows = E.document_similarity(docs(spark)).collect()
    got = {(r.system, r.facet): r for r in rows}
    assert len(got) == 9
    assert abs(got["s", "content"].mean_score - 1) < 1e-9 and abs(got["pdfs", "reference"].mean_score - 1) < 1e-9
    assert got["bare", "reference"].mean_score == 0.0 and got["bare", "reference"].scores == []
    items = E.similarity_items(docs(spark)).filter("system = 's'").orderBy("facet", "item_no").collect()
    assert [(r.facet, r.text) for r in items if r.facet == "outline"] == [("outline", "T > A > B")]


def test_embedder_gets_small_batches(spark):
    sizes = []

    def embedder(texts):
        sizes.append(len(texts))
        return [[float(len(texts))] for _ in texts]

    items = spark.range(23, numPartitions=1).select("id", F.lit("x").alias("text"))
    got = sorted(r.embedding[0] for r in E.embed_apply(items, embedder, batch=10).collect())
    assert got == [3.0] * 3 + [10.0] * 20


def test_answers_are_computed_once(spark, tmp_path):
    log = tmp_path / "asked"

    def counting(prompt):
        with open(log, "a") as f:
            f.write("x\n")
        return J.answer_by_digest(prompt)

    scores = E.evaluate_documents(docs(spark), counting, "m")
    asked = log.read_text().count("x")
    scores.collect()
    scores.count()
    assert log.read_text().count("x") == asked > 0


def test_only_stale_facets_reach_the_embedder(spark, tmp_path):
    import os

    from corpusgauge.plans.evaluation import adjusted_leaderboard, letter_shares, refreshed_similarity

    def text(words):
        return f"# T\n\n## 1 One\n{words} here.\n\n## 2 Two\nMore {words}.\n\n## References\n[1] {words} one\n[2] two"

    keys = "category string, topic string, system string"
    rows = [("c", "t", "pdfs", text("alpha")), ("c", "t", "a", text("beta")), ("c", "t", "b", text("gamma")), ("c", "u", "pdfs", text("delta")), ("c", "u", "a", text("omega"))]
    docs = spark.createDataFrame(rows, f"{keys}, md string")
    stored = [("c", "t", s, f, 0.5) for s in ("pdfs", "a", "b") for f in ("outline", "content", "reference")]
    stored += [("c", "u", s, f, 0.5) for s in ("pdfs", "a") for f in ("outline", "content", "reference")]
    stored = [r if r[:4] != ("c", "t", "b", "reference") else (*r[:4], 0.0) for r in stored] + [("x", "y", "z", "outline", 0.1)]
    top = str(tmp_path)

    def noting(texts):
        with open(os.path.join(top, str(os.getpid())), "a") as f:
            f.write("\n".join(texts) + "\n")
        return letter_shares(texts)

    old = spark.createDataFrame(stored, f"{keys}, facet string, mean_score double")
    got = {(r.topic, r.system, r.facet): r.mean_score for r in refreshed_similarity(docs, old, noting).collect()}
    assert len(got) == 15 and [k for k, v in got.items() if v != 0.5] == [("t", "b", "reference")]
    seen = "".join(open(os.path.join(top, f)).read() for f in os.listdir(top))
    assert "gamma one" in seen and "alpha one" in seen  # the document's references, and its baseline's
    assert "here" not in seen and "beta" not in seen and "delta" not in seen
    scores = spark.createDataFrame([(*r[:3], "m", "Outline", 4.0) for r in rows if r[:3] != ("c", "u", "pdfs")], f"{keys}, model string, metric string, value double")
    board = {(r.system, r.type): r.Outline for r in adjusted_leaderboard(docs, scores, old).collect()}
    assert board[("b", "perfect")] == 4.5 and board[("b", "balanced")] == 4.0 and ("a", "plain") in board
    assert refreshed_similarity(docs.limit(0), old).collect() == []


def test_texts_are_cut_for_stale_facets_alone(spark, monkeypatch):
    from corpusgauge.plans import evaluation as E

    keys = "category string, topic string, system string"
    rows = [("c", "t", s, f"# T\n\n## 1 One\nText of {s}.\n\n### 1.1 Part {s}\nMore.\n\n## 2 Two\n\n## References\n[1] one {s}\n[2] two") for s in ("pdfs", "a", "b", "d")]
    rows += [("c", "u", s, rows[0][3]) for s in ("pdfs", "a")]
    docs = spark.createDataFrame(rows, f"{keys}, md string")
    stale = {("t", "a", "reference"), ("t", "pdfs", "content"), ("t", "b", "content"), ("u", "pdfs", "outline")}
    stored = [(*r[:3], f, 0.0 if (*r[1:3], f) in stale else 0.5) for r in rows for f in ("outline", "content", "reference")]
    cut = {}

    def noted(module, name):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, *a: cut.setdefault(name, sorted((r.topic, r.system) for r in df.select("topic", "system").collect())) and False or real(df, *a))

    noted(E.O, "outline_rows")
    noted(E.D, "sections_by_hash")
    noted(E.P, "reference_entries")
    old = spark.createDataFrame(stored, f"{keys}, facet string, mean_score double")
    got = {(r.topic, r.system, r.facet): r.mean_score for r in E.refreshed_similarity(docs, old).collect()}
    assert len(got) == 18 and {k for k, v in got.items() if v != 0.5} == stale
    assert cut == {
        "outline_rows": [("u", "pdfs")], "sections_by_hash": [("t", "b"), ("t", "pdfs")], "reference_entries": [("t", "a"), ("t", "pdfs")],
    }
    whole = {(r.topic, r.system, r.facet): r.mean_score for r in E.document_similarity(docs).collect()}
    assert all(got[k] == whole[k] for k in stale) and whole["u", "pdfs", "outline"] == 1.0
    monkeypatch.undo()
    given = E.O.outline_rows(E.parsed_documents(docs))
    again = {(r.topic, r.system, r.facet): r.mean_score for r in E.refreshed_similarity(docs, old, outline=given).collect()}
    assert again == got


def test_letter_shares_count_letters_alone():
    from corpusgauge.plans.evaluation import letter_shares

    texts = ["", "a", "zzaäß☃a", "ABC", "the quick brown fox " * 30, "\x00a\ud800"]
    letters = "abcdefghijklmnopqrstuvwxyz"
    assert letter_shares(texts) == [[t.count(c) / max(len(t), 1) for c in letters] for t in texts]
