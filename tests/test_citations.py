import random
import re

import pytest

from corpusgauge.operators import citations as C
from corpusgauge.operators import references as P

CONTENT = "category string, topic string, system string, main_content string, ref_block string"


def contents(spark, *pairs):
    return spark.createDataFrame([("c", str(n), "s", m, r) for n, (m, r) in enumerate(pairs)], CONTENT)


def entries(spark, block):
    rows = P.reference_entries(contents(spark, ("", block))).orderBy("ref_pos").collect()
    return [(r.ref_id, r.ref_text) for r in rows]


def test_numbered_entries_become_bracketed(spark):
    assert entries(spark, "1. Alpha\n\n2) Beta\n   more\n3 Gamma") == [
        ("1", "Alpha"), ("2", "Beta\n   more"), ("3", "Gamma"),
    ]


def test_author_year_entries(spark):
    block = (
        "Smith, Ann, Roy, Bo and Lee, Kim. 2018a. Deep.\nJo Kim and Al Ray. 2019. Gamma.\n"
        "Dana Lee. 2020. Solo.\nNo year at all\n2001 opens"
    )
    assert [e[0] for e in entries(spark, block)] == [
        "Smith et al., 2018a", "Kim and Ray, 2019", "Lee, 2020", "all, ????", "Unknown, 2001",
    ]
    assert entries(spark, "") == []


def test_citing_forms(spark):
    block = "[1] A\n[2] B\n[3] C\n[5] E\n[Smith et al., 2018a] S\n[Lee, 2020] L\n[2] B again"
    text = (
        "Lists [5, 1-2] here. Ranges [2]–[3] and [3]. None (at all). "
        "Lee (2020) and (Smith et al., 2018a; Lee, 2020) agree. Odd [9] [x]."
    )
    rows = C.cite_resolve(contents(spark, (text, block))).orderBy("sent_no").collect()
    assert [r.references for r in rows] == [
        ["[1] A", "[2] B again", "[5] E"],
        ["[2] B again", "[3] C"],
        ["[Lee, 2020] L", "[Smith et al., 2018a] S"],
    ]
    assert rows[2].sentence == "Lee (2020) and [Smith et al., 2018a; Lee, 2020] agree"
    strict = C.cite_resolve(contents(spark, (text, block)), strict=True).collect()
    assert len(strict) == 2


@pytest.mark.parametrize(
    "sentence, strict, want",
    [
        ("a [3] b [1]-[2]", True, [1, 2, 3]),
        ("a [1,3,5-7] b", False, [1, 3, 5, 6, 7]),
        ("a [1,3,5-7] b", True, []),
        ("back [5]-[3] and [7-6]", False, []),
        ("twice [1]-[4] [2]-[6] [3]", False, [1, 2, 3, 4, 5, 6]),
        ("year [Smith, 2018]", False, []),
        ("huge [1]-[2500]", False, list(range(1, 2501))),
        ("too long [99999999999999999999999]", False, []),
    ],
)
def test_numbers(spark, sentence, strict, want):
    df = spark.createDataFrame([("c", "t", "s", 0, sentence)], "category string, topic string, system string, sent_no int, sentence string")
    got = sorted(r.ref_no for r in C.numeric_citations(df, strict=strict).collect())
    assert got == want


def test_spans(spark):
    df = spark.createDataFrame(
        [("c", "t", "s", 0, "[1, 2-3] [AL18] [Chen et al., 2023c; Xie, 2023] [see 4] [" + "1" * 60 + "x]")],
        "category string, topic string, system string, sent_no int, sentence string",
    )
    kinds = [r.kind for r in C.citation_spans(df).orderBy("span_no").collect()]
    assert kinds == ["numeric", "author_year", "author_year", "other", "other"]


def count_up(sentences, numbered):
    """The bare-number rule, one token at a time."""
    token = re.compile(r"(?<!\d)(\d{1,3})(?:\s*[–-]\s*(\d{1,3})\b|\b)")
    top, out = 0, []
    for no, sentence in enumerate(sentences):
        pairs = []
        for m in token.finditer(sentence):
            low, high = int(m[1]), int(m[2] or m[1])
            pairs += [(low, high)] if low <= high else [(low, low), (high, high)]
        ranges = [p for p in pairs if p[0] < p[1]]
        hits = []
        for low, high in pairs:
            if low == high and any(a <= low <= b for a, b in ranges):
                continue
            if high <= top + 1:
                top = max(top, high)
                hits += [f"[{n}] {numbered[n]}" for n in range(low, high + 1) if n in numbered]
        if hits:
            out.append((no, list(dict.fromkeys(hits))))
    return out


def test_bare_numbers_match_a_loop(spark):
    rng = random.Random(3)
    pairs, want = [], {}
    for n in range(60):
        sentences = []
        for s in range(rng.randint(1, 6)):
            words = [rng.choice(["x", str(rng.randint(1, 9)), f"{rng.randint(1, 6)}-{rng.randint(1, 9)}", "4a", "1234"]) for _ in range(6)]
            sentences.append("W" + str(s) + "z " + " ".join(words))
        numbered = {k: f"R{k}" for k in rng.sample(range(1, 10), 6)}
        pairs.append((". ".join(sentences), "\n".join(f"[{k}] {v}" for k, v in sorted(numbered.items()))))
        if found := count_up(sentences, numbered):
            want[str(n)] = found
    got = {}
    for r in C.cite_fallback_numbers(contents(spark, *pairs)).orderBy("topic", "sent_no").collect():
        got.setdefault(r.topic, []).append((r.sent_no, r.references))
    assert got == want


def test_stages(spark):
    block = "[1] A\n[2] B\n[Smith, 2018] S"
    df = contents(
        spark,
        ("Direct [1] and 2. Smith too.", block),
        ("Intro text 1 and 2. Smith too.", block),
        ("Only Smith here. Or 7.", block),
        ("Nothing at all.", block),
        ("Before 1.\n# Introduction\nAfter 2 then 1", block),
    )
    rows = C.citations(df).orderBy("topic", "sent_no").collect()
    assert [(r.topic, r.stage, r.references) for r in rows] == [
        ("0", 1, ["[1] A"]),
        ("1", 2, ["[1] A", "[2] B"]),
        ("2", 3, ["Smith, 2018 S"]),
        ("4", 2, ["[1] A"]),
    ]


def test_written_list_has_each_sentence_once(spark):
    df = contents(spark, ("Same [1]. Same [1]. Other [1,2]", "[1] A\n[2] B"))
    rows = C.write_citations(C.cite_resolve(df)).orderBy("sentence").collect()
    assert [(r.sentence, r.references) for r in rows] == [("Other [1,2]", "[1] A;[2] B"), ("Same [1]", "[1] A")]


def test_a_repeated_sentence_keeps_its_last_references(spark):
    rows = [("k", 0, "Same.", ["a"]), ("k", 5, "Same.", ["b", "c"])]
    df = spark.createDataFrame(rows, "topic string, sent_no int, sentence string, references array<string>")
    assert C.write_citations(df, ["topic"]).first()["references"] == "b;c"


def test_long_reference_numbers_make_runs(spark):
    df = spark.createDataFrame([("k", str(n)) for n in (10**17, 10**17 + 1, 12345678901, "9" * 30, "A1")], "topic string, ref_id string")
    rows = P.ref_number_runs(df, ["topic"]).orderBy("first").collect()
    long = 10**30 - 1  # a number as well
    assert [(r.first, r.last) for r in rows] == [(12345678901, 12345678901), (10**17, 10**17 + 1), (long, long)]


def test_batches_and_runs(spark):
    block = "\n".join(f"[{n}] r{n}" for n in [1, 2, 3, 7, 8, 8, 20])
    df = contents(spark, ("", block), ("", ""))
    batches = P.ref_batches(df, size=3).orderBy("batch_no").collect()
    assert [b.entries for b in batches] == [3, 3, 1]
    assert batches[0].batch == "[1] r1\n[2] r2\n[3] r3"
    runs = P.ref_number_runs(P.reference_entries(df)).orderBy("first").collect()
    assert [(r.first, r.last, r.from_one) for r in runs] == [(1, 3, True), (7, 8, False), (20, 20, False)]


def test_sentences_that_cannot_match_are_not_searched(spark):
    """A range needs a dash, a year after a name a round bracket, a page its closing tag."""
    from pyspark.sql import functions as F

    from corpusgauge.operators.citations import _cited
    from corpusgauge.operators.documents import prose

    found = _cited(F.lit(0), F.col("s"), False)
    plan = spark.range(1).select(F.lit("x").alias("s"), "id").select(found, prose(F.col("s")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("CASE WHEN (Contains(s") + plan.count("CASE WHEN Contains(s") >= 3, plan
    rows = ["Lee (2020) and [1]-[3]", "in [1]–[3]", "Lee 2020 [4, 6-7]", "none"]
    got = spark.createDataFrame([(s,) for s in rows], "s string").select(found.alias("c")).collect()
    assert [[(i.low, i.high) for i in r.c.numbers] for r in got] == [[(1, 3)], [(1, 3)], [(4, 4), (6, 7)], []]
    assert [[k.key for k in r.c["keys"]] for r in got] == [["Lee, 2020"], [], [], []]
    texts = spark.createDataFrame([("a<html>b\nc</html>d",), ("a<html>b",)], "s string")
    assert [r[0] for r in texts.select(prose(F.col("s"))).collect()] == ["ad", "a<html>b"]
