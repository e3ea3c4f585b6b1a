import json

import pytest
from pyspark.sql import functions as F

from corpusgauge.operators import claims as L
from corpusgauge.operators import judging as J
from corpusgauge.plans.judging_queries import repeats_by_text

SCORES = "category string, topic string, system string, model string, metric string, value double"


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"a": 1, "b": "x"}', {"a": "1", "b": "x"}),
        ('Sure: {"a": 2} done', {"a": "2"}),
        ('```json\n{"a": 3}\n```', {"a": "3"}),
        ('{"a": 1} and {"b": 2}', {}),
        ("{'a': 1}", {}),
        ('[{"a": 1}]', {}),
        ("nothing", {}),
        ("", {}),
        (None, {}),
        ('{"a": {"b": [1, 2]}}', {"a": '{"b":[1,2]}'}),
    ],
)
def test_objects(spark, raw, want):
    row = J.judge_parse(spark.createDataFrame([(raw,)], "raw string")).first()
    assert row.fields == want and row.parsed == bool(want)


@pytest.mark.parametrize(
    "raw, want",
    [
        ('["a", "b"]', ["a", "b"]),
        ("Result: ['a', 'b'] ok", ["a", "b"]),
        ('[[1, "A"], [2, "B"]]', ['[1,"A"]', '[2,"B"]']),
        ("[1, 2", []),
        ("none", []),
        ("[True, None]", ["true", None]),
        ("[1, 2,]", ["1", "2"]),
        ("So: ['it is True, None,]', \"don't\", 'a\\'b', False , ] ok", ["it is True, None,]", "don't", "a'b", "false"]),
        ("[['a', True,], [1,]]", ['["a",true]', "[1]"]),
        ('["True", "x,]", true, null]', ["True", "x,]", "true", None]),
        ("[xTrue]", []),
        ("['open]", []),
    ],
)
def test_lists(spark, raw, want):
    df = J.judge_parse_list(spark.createDataFrame([(1, raw)], "id int, raw string"))
    assert [r.item for r in df.orderBy("item_no").collect()] == want


def test_malformed_grades_are_zero(spark):
    parsed = J.judge_parse(spark.createDataFrame([(1, '{"A": 4, "B": "high"}')], "id int, raw string"))
    got = {r.metric: r.value for r in J.judge_scores(parsed, ["A", "B", "C"]).collect()}
    assert got == {"A": 4.0, "B": 0.0, "C": 0.0}


def test_scorer_is_retried_and_may_fail(spark):
    def flaky():
        seen = {}

        def score(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if prompt == "bad" or seen[prompt] < 3:
                raise ValueError("busy")
            return json.dumps({"score": 1})

        return score

    requests = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, prompt string").coalesce(1)
    got = {r.id: r.raw for r in J.judge_apply(requests, flaky(), attempts=3).collect()}
    assert got == {1: '{"score": 1}', 2: None}


def test_values_are_not_rescanned_for_fields(spark):
    df = spark.createDataFrame([("{text} {topic}", "T")], "text string, topic string")
    out = df.select(J.fill("<{topic}> {{x}} {text}").alias("p")).first().p
    assert out == "<T> {x} {text} {topic}"


def test_requests_per_criterion(spark):
    texts = spark.createDataFrame([("c", "t", "s", "content", "body")], "category string, topic string, system string, facet string, text string")
    rows = J.criterion_requests(texts).collect()
    assert sorted(r.criterion for r in rows) == ["Coverage", "Criticalness", "Language", "Relevance", "Structure"]
    assert all("body" in r.prompt for r in rows)


def test_pending_and_missing(spark):
    full = [("c", "1", "s", "m", m, 1.0) for ms in J.FACET_METRICS.values() for m in ms]
    part = [("c", "2", "s", "m", "Outline", 0.0), ("c", "2", "s", "m", "Coverage", 2.0)]
    df = spark.createDataFrame(full + part, SCORES)
    expected = spark.createDataFrame([("c", n, "s", "m") for n in "123"], "category string, topic string, system string, model string")
    got = {(r.topic, r.facet) for r in J.pending_work(expected, df).collect()}
    assert got == {(t, f) for t in "23" for f in ("outline", "content", "reference")}
    assert {(r.topic, r.work) for r in J.missing_scores(df).collect()} == {("2", "Content"), ("2", "Outline")}


def test_merge_clear_drop(spark):
    old = spark.createDataFrame([("c", "1", "s", "m", "a", 0.0), ("c", "1", "s", "m", "b", 2.0)], SCORES)
    new = spark.createDataFrame([("c", "1", "s", "m", "a", 4.0), ("c", "1", "s", "m", "b", 0.0), ("c", "1", "s", "m", "z", 5.0)], SCORES)
    assert {r.metric: r.value for r in J.merge_scores(old, new).collect()} == {"a": 4.0, "b": 0.0, "z": 5.0}
    assert {r.metric: r.value for r in J.merge_scores(old, new, zeros_only=True).collect()} == {"a": 4.0, "b": 2.0, "z": 5.0}
    assert J.clear_scores(new).count() == 0  # no target means everything
    assert J.clear_scores(new, metrics="a").count() == 2
    assert J.clear_scores(new, system="other").count() == 3
    assert J.drop_systems(new, ["s"]).count() == 0


def test_claims_from_a_response(spark):
    df = spark.createDataFrame([(1, "Here:\n1. Claim 1: One\n2.Two.\n3. Three"), (2, "none")], "doc int, raw string")
    rows = L.claims_parse(df, ["doc"]).orderBy("claim_no").collect()
    assert [(r.doc, r.claim) for r in rows] == [(1, "One"), (1, "Two."), (1, "Three.")]


CLAIMS = "doc int, claim_no int, claim string"


def test_duplicates_and_density(spark):
    df = spark.createDataFrame(
        [(1, 0, "The cat, sat!"), (1, 1, "a cat sat"), (1, 2, "A dog  sat."), (2, 0, "cat sat"), (3, 0, "x")], CLAIMS
    )
    kept = {(r.doc, r.claim_no, r.copies) for r in L.claims_dedup(df, ["doc"]).collect()}
    assert kept == {(1, 0, 2), (1, 2, 1), (2, 0, 1), (3, 0, 1)}
    sents = spark.createDataFrame([(1, 4), (2, 0), (4, 2)], "doc int, sentences int")
    got = {r.doc: tuple(r)[1:] for r in L.claim_density(df, sents, ["doc"]).collect()}
    assert got == {
        1: (4, 3, 0.75, 2, 0.5, 0.6667), 2: (0, 1, 0.0, 1, 0.0, 1.0), 3: (0, 1, 0.0, 1, 0.0, 1.0), 4: (2, 0, 0.0, 0, 0.0, 0.0),
    }


def test_removals_by_group(spark):
    df = spark.createDataFrame([(1, n, f"c{n}") for n in range(7)], CLAIMS)
    removals = spark.createDataFrame([(1, 0, "2, x, 9"), (1, 1, "1,1"), (1, 2, "")], "doc int, group_no int, raw string")
    left = sorted(r.claim for r in L.apply_removals(df, removals, ["doc"], size=3).collect())
    assert left == ["c0", "c2", "c4", "c5", "c6"]


def test_repeats_in_different_groups_are_removed(spark):
    # sparse numbers, a repeat in the next group, in a far one, and inside one; None is a document too
    texts = ["a", "b", "c", "a", "d", "e", "f", "g", "h", "b", "b"]
    rows = [(doc, 1000 * n, text) for doc in (1, None) for n, text in enumerate(texts)] + [(2, 5, "a"), (3, 1, "x"), (3, 1, "x")]
    df = spark.createDataFrame(rows, CLAIMS)
    left = kept_claims(J.claims_removed_by_judge(df, ["doc"], repeats_by_text, size=3))
    once = [0, 1000, 2000, 4000, 5000, 6000, 7000, 8000]
    assert left == sorted([(1, n) for n in once] + [(None, n) for n in once] + [(2, 5), (3, 1)], key=repr)
    assert J.claims_removed_by_judge(df, ["doc"], lambda p: None, size=3).count() == len(rows)
    assert J.claims_removed_by_judge(df, ["doc"], lambda p: "0, 99, x", size=3).count() == len(rows)
    assert J.claims_removed_by_judge(df.limit(0), ["doc"], repeats_by_text).collect() == []


def kept_claims(df):
    return sorted(((r.doc, r.claim_no) for r in df.collect()), key=repr)


def test_numbers_must_be_in_the_sentence(spark):
    rows = [
        (1, 0, "It is 1999 and 5.", 0, "In 19 it was"), (1, 0, "It is 1999 and 5.", 1, "5 things"), (1, 0, "It is 1999 and 5.", 2, "5 things"),
        (1, 0, "It is 1999 and 5.", 3, "70 things"), (2, 0, "Only 8.", 4, "nine"), (2, 0, "Only 8.", 5, "7 x"),
    ]
    df = spark.createDataFrame(rows, "doc int, sent_no int, sentence string, claim_no int, claim string")
    got = {(r.doc, r.claim_no, r.claim, r.grounded) for r in L.numeric_grounding(df).collect()}
    assert got == {(1, 0, "In 1999 it was", True), (1, 1, "5 things", True), (2, 4, "nine", False), (2, 5, "7 x", False)}
    assert df.select(F.count("*")).first()[0] == 6


def test_a_hanging_scorer_ends_in_a_null(spark):
    import time

    def slow(prompt):
        if prompt.startswith("hang"):
            time.sleep(600)
        return prompt.upper()

    requests = spark.createDataFrame([(n, "hang" if n % 10 == 3 else f"p{n}") for n in range(40)], "id int, prompt string").coalesce(1)
    start = time.time()
    rows = J.judge_apply(requests, slow, attempts=2, timeout=1.0, calls=8).collect()
    assert time.time() - start < 25
    assert [(r.id, r.raw) for r in rows] == [(n, None if n % 10 == 3 else f"P{n}") for n in range(40)]


def test_calls_at_once_keep_the_order_and_their_limit(spark, tmp_path):
    import os
    import threading
    import time

    top = str(tmp_path)

    def counting():
        def score(prompt):
            with lock_of():
                open_now[0] += 1
                with open(os.path.join(top, f"{open_now[0]}"), "w"):
                    pass
            time.sleep(0.05 * (int(prompt) % 3))
            with lock_of():
                open_now[0] -= 1
            return prompt

        open_now, made = [0], []

        def lock_of():
            if not made:
                made.append(threading.Lock())
            return made[0]

        return score

    requests = spark.createDataFrame([(n, str(n)) for n in range(60)], "id int, prompt string").coalesce(1)
    rows = J.judge_apply(requests, counting(), calls=5).collect()
    assert [(r.id, r.raw) for r in rows] == [(n, str(n)) for n in range(60)]
    most = max(int(f) for f in os.listdir(top))
    assert 2 <= most <= 5


def test_prompts_leave_their_batch_one_by_one(spark):
    rows = [(n, f"p{n}", None if n % 3 == 0 else [n, None]) for n in range(20)] + [(20, None, None)]
    df = spark.createDataFrame(rows, "id int, prompt string, more array<int>")
    asked = J.judge_apply(df, str.upper, calls=3)
    assert "MapInArrow" in asked._jdf.queryExecution().executedPlan().toString()  # a pandas frame would copy them all
    assert asked.columns == ["id", "more", "raw"]
    assert [tuple(r) for r in asked.orderBy("id").collect()] == [(n, m, p and p.upper()) for n, p, m in rows]


def test_tasks_of_a_ledger_run_are_bounded(spark, tmp_path, monkeypatch):
    from corpusgauge.operators import ledger as G

    assert (G._tasks(41, 20), G._tasks(21_500_000, G.PROMPTS_PER_TASK)) == (3, G.MOST_TASKS)
    dealt, plain = [], G.judge_apply
    monkeypatch.setattr(G, "MOST_TASKS", 3)
    monkeypatch.setattr(G, "judge_apply", lambda rows, *rest, **calls: dealt.append(rows.rdd.getNumPartitions()) or plain(rows, *rest, **calls))
    asked = spark.createDataFrame([(n, f"p{n}") for n in range(40)], "id int, prompt string")
    got = {r.id: r.raw for r in G.judge_once(asked, str.upper, str(tmp_path / "l"), prompts_per_task=2).collect()}
    assert got == {n: f"P{n}" for n in range(40)} and dealt == [3]


def test_answers_of_hot_prompts_are_joined_apart(spark):
    from corpusgauge.functions.joins import left_join_hot_keys_apart

    rows = spark.createDataFrame([(n, "hot" if n < 30 else "lost" if n < 50 else None if n < 55 else f"k{n}") for n in range(60)], "n int, k string")
    per_key = spark.createDataFrame([("hot", "a"), *[(f"k{n}", f"v{n}") for n in range(55, 58)]], "k string, v string")
    want = {n: "a" if n < 30 else f"v{n}" if 55 <= n < 58 else None for n in range(60)}
    for hot_rows in (5, 1000):
        found = left_join_hot_keys_apart(rows, per_key, "k", hot_rows).collect()
        assert len(found) == 60 and {r.n: r.v for r in found} == want
    text = left_join_hot_keys_apart(rows, per_key, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text  # no copies of the answers


def test_a_run_that_dies_leaves_its_answers(spark, tmp_path):
    import os

    from corpusgauge.operators.ledger import judge_once, ledger_answers

    calls, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    top = str(calls)

    def scorer(dies):
        def score(prompt):
            name = os.path.join(top, f"{'first' if dies else 'second'}-{prompt}")
            with open(name, "a") as f:
                f.write("x")
            if dies and prompt == "p57":
                raise KeyboardInterrupt  # not a failure of one prompt: the whole run goes
            return None if prompt == "p9" else prompt.upper()

        return score

    rows = [(n, f"p{n % 60}") for n in range(90)] + [(100, None)]
    requests = spark.createDataFrame(rows, "id int, prompt string").repartition(4)
    with pytest.raises(Exception):  # noqa: B017, PT011
        judge_once(requests, scorer(True), ledger, "m", prompts_per_task=5)
    saved = ledger_answers(spark, ledger, "m").count()
    assert 0 < saved < 60
    got = {r.id: r.raw for r in judge_once(requests, scorer(False), ledger, "m", prompts_per_task=5).collect()}
    assert got == {n: None if p in (None, "p9") else p.upper() for n, p in rows}
    asked = [f for f in os.listdir(top) if f.startswith("second-")]
    assert len(asked) == 60 - saved  # only prompts without an answer, equal ones once
    again = judge_once(requests, scorer(False), ledger, "m", prompts_per_task=5)
    assert {r.id: r.raw for r in again.collect()} == got
    assert [f for f in os.listdir(top) if f.startswith("second-") and len(open(os.path.join(top, f)).read()) > 1] == ["second-p9"]
    assert {r.raw for r in judge_once(requests, str.lower, ledger, "other").collect()} == {f"p{n}" for n in range(60)} | {None}


def near_by_loop(rows, percent=80):
    """Kept (doc, claim_no) of (doc, claim_no, words) rows that are unlike as texts."""
    kept = []
    for d, n, w in rows:
        sets = [set(v) for e, m, v in rows if e == d and (m, " ".join(v)) < (n, " ".join(w))]
        if not any(100 * len(set(w) & v) >= percent * len(set(w) | v) for v in sets):
            kept.append((d, n))
    return sorted(kept, key=repr)


def test_near_copies_of_claims(spark):
    import random

    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(14)] for _ in range(30)]
    rows = []
    for doc in (1, 2, None):
        for n in range(150):  # chains of near copies, each a word or two from its base or from the one before
            words = list(base[rng.randrange(30)] if n % 3 or not rows else rows[-1][2])
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
            if (doc, words) not in [(d, w) for d, _, w in rows]:
                rows.append((doc, n, words))
    df = spark.createDataFrame([(d, n, " ".join(w)) for d, n, w in rows], CLAIMS).repartition(3)
    got = kept_claims(L.claims_near_dedup(df, ["doc"]))
    want = near_by_loop(rows)
    assert got == want and 60 < len(want) < len(rows) - 100


def test_near_copies_of_odd_claims(spark):
    rows = [(1, 0, "The cat!"), (1, 1, "cat"), (1, 2, ""), (1, 3, "..."), (2, 0, "cat"), (2, 0, "dog"), (3, 5, "a b c d e f"), (3, 4, "b c d e f g")]
    got = {(r.doc, r.claim_no, r.copies) for r in L.claims_near_dedup(spark.createDataFrame(rows, CLAIMS), ["doc"]).collect()}
    assert got == {(1, 0, 2), (1, 2, 2), (2, 0, 1), (3, 4, 1)}
    assert L.claims_near_dedup(spark.createDataFrame([], CLAIMS), ["doc"]).collect() == []


def test_one_band_of_many_copies_makes_few_pairs(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, n, " ".join(words[:-1] + [f"x{n}"])) for n in range(600)]  # all near to each other
    pairs = []
    plain = L._near
    monkeypatch.setattr(L, "_near", lambda p, *rest: pairs.append(p.count()) or plain(p, *rest))
    df = spark.createDataFrame(rows, CLAIMS)
    assert kept_claims(L.claims_near_dedup(df, ["doc"])) == [(1, 0)]
    assert sum(pairs) < 40 * len(rows)


def test_no_text_travels_with_a_band(spark, monkeypatch):
    seen, plain = [], L.written_once
    monkeypatch.setattr(L, "written_once", lambda df: seen.append(df.columns) or plain(df))
    rows = [(1, 7, "b c d e f"), (1, 7, "a2 b c d e f"), (2, 0, "b c d e f")]
    got = kept_claims(L.claims_near_dedup(spark.createDataFrame(rows, CLAIMS), ["doc"]))
    assert got == [(1, 7), (2, 0)]  # of two with one number the larger text goes
    assert all("_norm" not in c and ("_band" not in c or "doc" not in c) for c in seen)


def test_only_open_documents_take_part_in_a_round(spark, monkeypatch):
    asked = []

    def answers(rows):
        asked.append(sorted({r.doc for r in rows.select("doc").collect()}))
        return J.judge_apply(rows, repeats_by_text)

    rows = [(1, n, f"c{n % 50}") for n in range(350)] + [(2, n, f"c{n % 3}") for n in range(10)] + [(3, n, f"d{n}") for n in range(700)]
    df = spark.createDataFrame(rows, CLAIMS).withColumn("_no", F.lit("mine"))
    left = J.claims_removed_by_judge(df, ["doc"], repeats_by_text, size=300, answers=answers)
    assert left.columns == df.columns and left.where("_no <> 'mine'").count() == 0
    assert sorted((r.doc, n) for r, n in ((r, r["count"]) for r in left.groupBy("doc").count().collect())) == [(1, 50), (2, 3), (3, 700)]
    assert asked == [[1, 2, 3], [1, 3], [3]]


def test_finished_documents_are_written_once(spark, monkeypatch):
    texts, plain = [], J.written_once
    monkeypatch.setattr(J, "written_once", lambda df: texts.append("claim" in df.columns and plain(df).count()) or plain(df))
    rows = [(1, n, f"c{n % 50}") for n in range(350)] + [(2, n, f"c{n % 3}") for n in range(10)]
    left = J.claims_removed_by_judge(spark.createDataFrame(rows, CLAIMS), ["doc"], repeats_by_text)
    assert left.count() == 53
    # all, then those of the open document alone, then none
    assert [n for n in texts if n is not False] == [360, 100, 0]


def test_density_of_claims_that_a_judge_left(spark):
    claims = spark.createDataFrame([(1, n, f"c{n}") for n in range(6)] + [(None, 0, "x")], CLAIMS)
    kept = claims.where("claim_no < 3 AND doc = 1")
    sents = spark.createDataFrame([(1, 2), (1, 1), (None, 4)], "doc int, sentences int")
    got = {r.doc: tuple(r)[1:] for r in L.claim_density(claims, sents, ["doc"], kept).collect()}
    assert got == {1: (3, 6, 2.0, 3, 1.0, 0.5), None: (4, 1, 0.25, 0, 0.0, 0.0)}


def test_density_of_documents(spark, tmp_path):
    from corpusgauge.plans.evaluation import document_claim_density
    from corpusgauge.plans.evaluation_queries import statements_by_period

    long = "# One\n" + " ".join(f"Claim {n % 400} is here." for n in range(900))  # three groups of 300
    rows = [("c", "1", "s", long), ("c", "2", "s", "no heading at all."), ("c", "3", "s", "# A\nX is y. X is y.\n# B\nX is y. Z")]
    docs = spark.createDataFrame(rows, "category string, topic string, system string, md string")
    got = {r.topic: tuple(r)[3:] for r in document_claim_density(docs, statements_by_period, ledger=str(tmp_path / "l")).collect()}
    assert got["2"] == (0, 0, 0.0, 0, 0.0, 0.0)
    assert got["1"][1] == 900 and got["1"][3] == 402  # the first has its heading before it, the last a period
    assert (got["3"][1], got["3"][3]) == (4, 4)


def test_sets_of_columns_are_named_apart():
    assert J.unused("_no", ["_no", "__NO"]) == "___no"


def test_prompts_of_a_long_run_are_asked_where_they_stand(spark, tmp_path, monkeypatch):
    """Long prompts about one text are written once and not exchanged; equal ones are still asked once."""
    import os

    from corpusgauge.operators import ledger as G

    top, plans, plain = str(tmp_path / "calls"), [], G.judge_apply
    os.mkdir(top)

    def score(prompt):
        with open(os.path.join(top, str(prompt)), "a") as f:
            f.write("x")
        return prompt.upper()

    monkeypatch.setattr(G, "MOST_TASKS", 3)
    monkeypatch.setattr(G, "PROMPTS_PER_FILE", 7)
    monkeypatch.setattr(G, "judge_apply", lambda rows, *rest, **calls: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or plain(rows, *rest, **calls))
    rows = [(n, f"p{n % 150}") for n in range(200)] + [(n, None) for n in range(200, 210)] + [(5, "p5")]
    asked = spark.createDataFrame(rows, "id int, prompt string").repartition(4)
    ledger = str(tmp_path / "l")
    G.judge_once(asked.where("id < 40"), score, ledger, prompts_per_task=2)
    found = G.judge_once(asked, score, ledger, prompts_per_task=2)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((n, p and p.upper()) for n, p in rows), key=str)
    assert sorted(os.listdir(top)) == sorted({p for _, p in rows if p})
    assert all(os.path.getsize(os.path.join(top, f)) == 1 for f in os.listdir(top))
    assert len(plans) == 2 and not any("RepartitionByExpression" in p or "Aggregate [digest" in p for p in plans), plans
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None
