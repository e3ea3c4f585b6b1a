"""What the plans must look like, and what a hot key must not do."""

import os
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from corpusgauge.functions.joins import broadcast_if_small, spread_join
from corpusgauge.functions.ranking import top_per_group
from corpusgauge.functions.text import settled
from corpusgauge.operators import citations as C
from corpusgauge.operators import documents as D
from corpusgauge.operators import outline as O
from corpusgauge.operators import references as P
from corpusgauge.operators import words as W

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark):
    return spark.createDataFrame(
        [("c", "t", "s", "# A\nText [1].\n# References\n[1] x")],
        "category string, topic string, system string, md string",
    )


def test_parsers_exchange_nothing(spark):
    contents = D.split_content_refs(docs(spark))
    for df in (
        contents, D.sections_by_hash(contents), D.sentences(contents), D.md_features(docs(spark)),
        O.outline_extract(docs(spark)), P.reference_entries(contents), P.ref_batches(contents),
        C.numeric_citations(D.sentences(contents)), C.cite_resolve(contents), C.citations(contents),
    ):
        assert "Exchange" not in plan(df)


def test_tree_exchanges_once(spark):
    tree = O.outline_tree(O.outline_extract(docs(spark)))
    assert plan(tree).count("Exchange hashpartitioning") == 1
    assert plan(O.outline_edges(tree)).count("Exchange hashpartitioning") == 1


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")
def test_scans_read_only_what_they_need(spark):
    text = plan(contract.queries()["category_rollup"](spark, SF_DIR))
    schema = text[text.index("ReadSchema"):].split("\n")[0]
    assert "o_orderdate" not in schema and "o_totalprice" not in schema


def test_hot_key_is_spread(spark):
    rows = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id"))
    per_key = spark.createDataFrame([("hot", 7)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = spread_join(rows, per_key, ["k"])
        sizes = [r.n for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert joined.count() == 4000 and joined.filter("v = 7").count() == 4000
        assert len(sizes) >= 3 and max(sizes) < 2500
        assert spread_join(rows, per_key, ["k"], "left_anti").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_broadcast_depends_on_a_count(spark):
    small, large = broadcast_if_small(spark.range(5), 10), broadcast_if_small(spark.range(50), 10)
    assert "broadcast" in small._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in large._jdf.queryExecution().logical().toString().lower()


def test_settled_values_are_not_inlined(spark):
    df = spark.range(3).withColumn("t", F.concat_ws(",", F.lit("a"), "id"))
    out = settled(df, ["id"], parts=F.split("t", ",")).select(F.transform(F.array(F.lit("a")), lambda a: F.array_contains("parts", a)))
    text = plan(out)
    assert text.index("array_contains") < text.index("Generate") and text.count("split(") == 1


def test_ranking_in_parts_is_the_same(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("g"), (F.col("id") * 7919 % 997).alias("v"), "id"
    )
    order = [F.col("v").desc(), F.col("id")]
    whole = top_per_group(rows, ["g"], order, 40).collect()
    parts = top_per_group(rows, ["g"], order, 40, splits=5, direct=10).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and len(whole) == 80
    assert "WindowGroupLimit" in plan(top_per_group(rows, ["g"], order, 40))


HOSTILE = {
    "dots": "." * 200_000 + "x", "newlines": "a" + "\n" * 200_000 + "b", "letters": "a" * 200_000, "hashes": "#" * 200_000,
    "open brackets": "[" * 200_000, "capitals": "A" * 50_000, "spaces": "a" + " " * 200_000 + "b", "dollars": "$" * 200_001,
    "pipes": "|" * 200_000, "digits": "[" + "1" * 100_000 + "x]", "rounds": "(A, 2000;" * 20_000, "one line": "x y. " * 40_000,
    "begins": "\\begin{a}" * 20_000, "begin braces": "\\begin{" * 25_000, "images": "<img " * 40_000, "tables": "<table" * 33_000,
    "pages": "<html>" * 33_000, "links": "![" * 100_000, "math": "\\[" * 100_000, "bracket of letters": "[" + "a b " * 50_000 + "]",
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_texts_take_linear_time(spark, name):
    md = "# Introduction\n" + HOSTILE[name] + "\n# References\n" + HOSTILE[name]
    df = spark.createDataFrame([(name, "t", "pdfs", md)], "category string, topic string, system string, md string")
    start = time.time()
    contents = D.split_content_refs(df)
    for out in (
        contents, C.citations(contents), D.sentence_counts(contents), D.md_features(df), D.sections_by_heading(df),
        O.outline_paths(O.outline_extract(df)), P.reference_entries(contents), C.citation_spans(D.sentences(contents)),
        W.word_frequency(W.vocabulary_texts(df)),
    ):
        out.write.format("noop").mode("overwrite").save()
    assert time.time() - start < 60


def test_repeats_of_a_bounded_join_are_never_broadcast(spark):
    """A size in a plan leaves the repeats out, so sixteen times as much as the session allows would pass the driver."""
    from corpusgauge.llm import graph

    edges = spark.range(4000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))  # 64,000 bytes
    want = None
    for limit, kind in (("100000", "BroadcastHashJoin"), ("1000", "SortMergeJoin")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            found = graph._hooked(edges, "a", "b", larger_only=True)
            rows = sorted(map(tuple, found.collect()))
            text = plan(found)
            assert kind in text and ("Generate explode" in text) == (kind == "SortMergeJoin"), text
            assert len(rows) == 4000 and want in (None, rows)
            want = rows
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
