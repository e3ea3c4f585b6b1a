r"""Outlines: headings, tree, root-to-leaf paths.

An outline row is ``keys, pos, level, title``.  Headings are found inside the
document's row; the tree needs the headings of one document in order, so only
those few short rows are exchanged, by document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgauge.functions.folds import scan
from corpusgauge.functions.json import list_items
from corpusgauge.functions.text import WS_INLINE, find_all, settled, strip
from corpusgauge.schema import DOC_KEYS

HEADING_LINE = rf"(?dm)^#{{1,6}}{WS_INLINE}+.+$"


def headings(docs: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Keys and ``heads``: (level, title) of every heading line in order."""
    heads = F.transform(
        find_all(F.col(text), HEADING_LINE),
        lambda h: F.struct(
            F.length(F.regexp_extract(h, r"\A(#{1,6})", 1)).alias("level"),
            strip(F.regexp_extract(h, rf"(?s)\A#{{1,6}}{WS_INLINE}+(.+)\z", 1)).alias("title"),
        ),
    )
    found = settled(docs, list(keys), found=heads)
    levels = F.col("found.level")
    single = F.array_min(levels) == F.array_max(levels)
    leveled = F.transform(
        "found", lambda h: F.struct(F.when(single, 1).otherwise(h["level"]).alias("level"), h["title"].alias("title"))
    )
    return settled(found, list(keys), heads=leveled)


def outline_extract(docs: DataFrame, text: str = "md", keys: Sequence[str] = DOC_KEYS) -> DataFrame:
    """Heading lines in order; where all share one level, the level is 1."""
    return outline_rows(headings(docs, text, keys), keys)


def outline_rows(heads: DataFrame, keys: Sequence[str] = DOC_KEYS) -> DataFrame:
    """The headings of :func:`headings` as rows."""
    return heads.select(*keys, F.posexplode("heads").alias("pos", "head")).select(
        *keys, "pos", "head.level", "head.title"
    )


def outline_text(docs: DataFrame, text: str = "md", keys: Sequence[str] = DOC_KEYS) -> DataFrame:
    """The outline of each document as text, one ``[level, "title"]`` per line.

    ``flat`` tells whether every heading has level 1.
    """
    return outline_lines(headings(docs, text, keys), keys)


def outline_lines(found: DataFrame, keys: Sequence[str] = DOC_KEYS) -> DataFrame:
    """The headings of :func:`headings` as one text per document."""
    def line(h):
        quoted = F.to_json(F.array(h["title"]))
        return F.concat(
            F.lit("["), h["level"].cast("string"), F.lit(", "),
            F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit("]"),
        )

    heads = F.col("heads")
    flat = (F.size(heads) > 0) & (F.array_max("heads.level") == 1)
    return found.select(
        *keys, flat.alias("flat"), F.array_join(F.transform(heads, line), "\n").alias("text")
    )


def apply_refinement(
    outline: DataFrame, answers: DataFrame, keys: Sequence[str] = DOC_KEYS
) -> DataFrame:
    """Outlines with the judge's new levels where its answer is a list of pairs.

    ``answers`` has keys and ``raw``; an answer with any entry that is not
    ``[level, title]`` changes nothing.
    """
    keys = list(keys)
    pairs = F.transform(
        list_items(F.col("raw")),
        lambda p: F.from_json(p, "array<string>"),
    )
    read = settled(answers, keys, pairs=pairs)
    nodes = F.transform(
        "pairs",
        lambda p: F.struct(
            F.get(p, F.lit(0)).try_cast("int").alias("level"), F.get(p, F.lit(1)).alias("title")
        ),
    )
    valid = settled(read, keys, nodes=nodes).filter(
        (F.size("nodes") > 0) & F.forall("nodes", lambda n: n["level"].isNotNull() & n["title"].isNotNull())
    )
    kept = outline.join(valid.select(*keys), keys, "left_anti")
    new = valid.select(*keys, F.posexplode("nodes").alias("pos", "node")).select(
        *keys, "pos", "node.level", "node.title"
    )
    return kept.select(*keys, "pos", "level", "title").unionByName(new)


def outline_needs_refine(outline: DataFrame, keys: Sequence[str] = DOC_KEYS) -> DataFrame:
    """Documents whose outline is flat: every heading has level 1."""
    return (
        outline.groupBy(*keys)
        .agg(F.min("level").alias("low"), F.max("level").alias("high"), F.count("*").alias("headings"))
        .filter((F.col("low") == 1) & (F.col("high") == 1))
        .select(*keys, "headings")
    )


def _with_ancestors(outline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per document ``found``: each node with its ancestors, the root first.

    The nodes of a document, a few short rows, are scanned in order with the
    stack of open nodes, whose levels always grow; levels have no limit.
    """
    node = F.struct(F.col("pos").cast("int").alias("pos"), F.col("level").cast("int").alias("level"), "title")
    listed = outline.groupBy(*keys).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    none = F.array().cast("array<struct<pos:int,level:int,title:string>>")

    def step(opened: Column, x: Column) -> Column:
        return F.concat(F.filter(opened, lambda s: s["level"] < x["level"]), F.array(x))

    stacks = settled(listed, list(keys), stacks=scan(F.col("nodes"), none, step))
    # the last open node is the node itself
    found = F.transform("stacks", lambda s: F.struct(
        *[F.try_element_at(s, F.lit(-1))[c].alias(c) for c in ("pos", "level", "title")],
        F.slice(s, F.lit(1), F.size(s) - 1).alias("above"),
    ))
    return settled(stacks, list(keys), found=found)


def outline_tree(outline: DataFrame, keys: Sequence[str] = DOC_KEYS) -> DataFrame:
    """Parent of every node: the nearest earlier node of a smaller level."""
    keys = list(keys)
    parent = F.try_element_at("above", F.lit(-1))
    # settled, or the maximum would be taken anew for every node
    found = settled(_with_ancestors(outline, keys), [*keys, "found"], max_depth=F.array_max("found.level"))
    return (
        found.select(*keys, "max_depth", F.inline("found"))
        .withColumn("parent", parent)
        .select(
            *keys, "pos", "level", "title",
            F.col("parent.pos").alias("parent_pos"),
            F.col("parent.title").alias("parent_title"),
            F.col("parent.level").alias("parent_level"),
            "max_depth",
        )
    )


def outline_edges(tree: DataFrame, keys: Sequence[str] = DOC_KEYS) -> DataFrame:
    """One row per node with children, the children listed in order."""
    child = F.struct("pos", F.concat(F.lit("  - Index: "), F.col("pos").cast("string"), F.lit(", Title: "), F.col("title")).alias("line"))
    listed = F.array_sort(F.collect_list(child))
    return (
        tree.filter(F.col("parent_pos").isNotNull())
        .groupBy(*keys, "parent_pos", "parent_title", "parent_level", "max_depth")
        .agg(F.count("*").alias("children"), F.array_join(F.transform(listed, lambda c: c["line"]), "\n").alias("children_list"))
    )


def outline_paths(
    outline: DataFrame, keys: Sequence[str] = DOC_KEYS, topic: str = "topic"
) -> DataFrame:
    """Root-to-leaf title paths, leaves under the same titles merged into one.

    An outline without exactly one level-1 node gets the topic as its root.
    Paths of one or two titles are dropped.
    """
    keys = list(keys)
    found = F.col("found")
    rooted = F.size(F.filter(found, lambda n: n["level"] == 1)) != 1
    root = F.when(rooted, F.array(F.col(topic))).otherwise(F.array().cast("array<string>"))
    # a node is a leaf when the next one is not deeper
    leaf = F.transform(
        found, lambda n, i: F.struct(
            n["pos"].alias("pos"), n["title"].alias("title"), F.transform(n["above"], lambda a: a["title"]).alias("above"),
            F.coalesce(F.get(found, i + 1)["level"] <= n["level"], F.lit(True)).alias("leaf"),
        )
    )
    leaves = (
        settled(_with_ancestors(outline, keys), keys, root=root, nodes=leaf)
        .select(*keys, "root", F.inline(F.filter("nodes", lambda n: n["leaf"])))
        .select(*keys, "pos", "title", F.concat("root", "above").alias("parents"))
        .filter(F.size("parents") >= 2)
    )
    merged = leaves.groupBy(*keys, "parents").agg(
        F.min("pos").alias("first_pos"),
        F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("leaves"),
    )
    order = Window.partitionBy(*keys).orderBy("first_pos")
    path = F.concat(F.col("parents"), F.col("leaves.title"))
    return merged.select(
        *keys,
        (F.row_number().over(order) - 1).alias("path_no"),
        F.array_join(path, " > ").alias("path"),
    )
