import pytest
from pyspark.sql import functions as F

from corpusgauge.operators import documents as D


def split(spark, *texts):
    rows = [("c", str(n), "s", t) for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "category string, topic string, system string, md string")
    out = D.split_content_refs(docs).orderBy(F.col("topic").cast("int")).collect()
    return [(r.tier, r.main_content, r.ref_block) for r in out]


def test_reference_list_tiers(spark):
    got = split(
        spark,
        "# A\ntext\n## references\n[1] x\n[2] y\n# Appendix B\ntail",
        "# A\ntext\n## Cited references here\n[1] x",
        "# A\nText [1] in line\n[1] x\n[2] y",
        "[1] x\n[2] y",
        "# A\nOne reference here.\nSelected Bibliography\nSmith 2018.",
        "# A\n preferences only\n",
        "",
    )
    assert got[0] == (1, "# A\ntext\nB\ntail", "[1] x\n[2] y")
    assert got[1] == (2, "# A\ntext\n", "s here\n[1] x")
    assert got[2] == (3, "# A\nText [1] in line", "[1] x\n[2] y")
    assert got[3] == (3, "", "[1] x\n[2] y")
    assert got[4] == (4, "# A\nOne reference here.\nSelected\n", "Smith 2018.")
    assert got[5] == (5, "# A\n preferences only", "")
    assert got[6] == (5, "", "")


def test_heading_at_the_very_start(spark):
    assert split(spark, "# References\n[1] x") == [(1, "\n", "[1] x")]


def sentences(spark, text):
    df = spark.createDataFrame([("c", "t", "s", text)], "category string, topic string, system string, main_content string")
    return [r.sentence for r in D.sentences(df).orderBy("sent_no").collect()]


def test_sentences(spark):
    text = "# Head. Line\nOne is 3.5 wide. Two ![i](a.b)here.\n\n\nthree e.g. four.Five<html>x. Y</html> "
    assert sentences(spark, text) == ["One is 3.5 wide", "Two here", "three e.g. four", "Five"]
    assert sentences(spark, "") == []


def test_sections(spark):
    df = spark.createDataFrame(
        [("c", "t", "s", "pre\n#tag\n# A\na\n## B\nb")],
        "category string, topic string, system string, md string",
    )
    by_hash = [r.section for r in D.sections_by_hash(df, "md").orderBy("section_no").collect()]
    assert by_hash == ["pre", "#tag", "# A\na", "## B\nb"]
    by_heading = [r.section for r in D.sections_by_heading(df).orderBy("section_no").collect()]
    assert by_heading == ["# A\na\n", "## B\nb"]


@pytest.mark.parametrize(
    "text, images, equations, tables",
    [
        ("![a](b) ![a](b) ![c](d) <img src='x'> <IMG alt=1>", 4, 0, 0),
        ("$a$ and $$b\nc$$ and \\[d\\] \\begin{eq}e\\end{eq} cost $5", 0, 4, 0),
        ("| a |\n|---|\n| 1 |\n\n| no | sep |\n| x | y |\n<table>\n</table>", 0, 0, 2),
        ("", 0, 0, 0),
    ],
)
def test_features(spark, text, images, equations, tables):
    df = spark.createDataFrame([("c", "t", "s", text)], "category string, topic string, system string, md string")
    row = D.md_features(df).first()
    assert (row.images, row.equations, row.tables) == (images, equations, tables)
    assert (row.Images_density is None) == (row.sentences == 0)


def test_long_table_does_not_overflow_the_stack(spark):
    text = "| a |\n|---|\n" + "| x |\n" * 50_000
    df = spark.createDataFrame([("c", "t", "s", text)], "category string, topic string, system string, md string")
    assert D.md_features(df).first().tables == 1


def test_patterns_are_found_up_to_their_last_end(spark):
    md = (
        "![a](b) ![c](d\n<img x><img src='q'> <img \\begin{e}x\\end{e} \\begin{f} \\end{f \\[y\\] \\[z "
        "<TABLE><tr></Table> <table> <html>gone</html>kept <html>open"
    )
    df = spark.createDataFrame([("c", "t", "s", md)], "category string, topic string, system string, md string")
    row = D.md_features(df).first()
    assert (row.images, row.equations, row.tables) == (4, 2, 1)
    text = df.select(D.prose(F.col("md")).alias("p")).first().p
    assert "gone" not in text and "kept" in text and "<html>open" in text and "![a]" not in text and "![c](d" in text
