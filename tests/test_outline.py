import random

from pyspark.sql import functions as F

from corpusgauge.operators import outline as O
from corpusgauge.sources.corpus import scan_outline_json

SCHEMA = "category string, topic string, system string, pos int, level int, title string"


def random_outlines(count, seed=5):
    rng = random.Random(seed)
    out = {}
    for n in range(count):
        size = rng.randint(1, 14)
        top = rng.choice([2, 3, 6])
        out[str(n)] = [(rng.randint(1, top), rng.choice("ABCD") + str(rng.randint(0, 3))) for _ in range(size)]
    return out


def frame(spark, outlines):
    rows = [("c", t, "s", p, lvl, title) for t, o in outlines.items() for p, (lvl, title) in enumerate(o)]
    return spark.createDataFrame(rows, SCHEMA)


def stack_parents(outline):
    parents, stack = [], []
    for pos, (level, _) in enumerate(outline):
        while stack and outline[stack[-1]][0] >= level:
            stack.pop()
        parents.append(stack[-1] if stack else None)
        stack.append(pos)
    return parents


def test_tree_matches_a_stack(spark):
    outlines = random_outlines(150)
    tree = O.outline_tree(frame(spark, outlines)).collect()
    got = {(r.topic, r.pos): r.parent_pos for r in tree}
    want = {(t, p): q for t, o in outlines.items() for p, q in enumerate(stack_parents(o))}
    assert got == want


def model_paths(topic, outline):
    if sum(lvl == 1 for lvl, _ in outline) != 1:
        outline = [(1, topic)] + [(lvl + 1, title) for lvl, title in outline]
    parents = stack_parents(outline)
    groups = {}
    for pos in range(len(outline)):
        if pos in parents:
            continue
        path, at = [], pos
        while at is not None:
            path.insert(0, outline[at][1])
            at = parents[at]
        if len(path) > 2:
            groups.setdefault(tuple(path[:-1]), []).append(path[-1])
    return [" > ".join([*head, *tails]) for head, tails in groups.items()]


def test_paths_match_a_stack(spark):
    outlines = random_outlines(150, seed=9)
    got = {}
    for r in O.outline_paths(frame(spark, outlines)).orderBy("topic", "path_no").collect():
        got.setdefault(r.topic, []).append(r.path)
    want = {t: p for t, o in outlines.items() if (p := model_paths(t, o))}
    assert got == want


def test_one_level_becomes_level_one(spark):
    docs = spark.createDataFrame(
        [("c", "a", "s", "### X \ntext\n### Y"), ("c", "b", "s", "# X\n####### no\n#no\n## Y"), ("c", "d", "s", "none")],
        "category string, topic string, system string, md string",
    )
    rows = O.outline_extract(docs).orderBy("topic", "pos").collect()
    assert [(r.topic, r.pos, r.level, r.title) for r in rows] == [
        ("a", 0, 1, "X"), ("a", 1, 1, "Y"), ("b", 0, 1, "X"), ("b", 1, 2, "Y"),
    ]
    flat = O.outline_needs_refine(O.outline_extract(docs)).collect()
    assert [(r.topic, r.headings) for r in flat] == [("a", 2)]


def test_edges_list_children_in_order(spark):
    tree = O.outline_tree(frame(spark, {"t": [(1, "R"), (2, "b"), (3, "x"), (2, "a")]}))
    rows = O.outline_edges(tree).orderBy("parent_pos").collect()
    assert rows[0].children_list == "  - Index: 1, Title: b\n  - Index: 3, Title: a"
    assert [(r.parent_title, r.children, r.max_depth) for r in rows] == [("R", 2, 3), ("b", 1, 3)]


def test_outline_json(spark):
    docs = spark.createDataFrame(
        [("c", "t", "s", '[[1, "A"], ["2", "B, C"]]'), ("c", "u", "s", "not json")],
        "category string, topic string, system string, raw string",
    )
    rows = scan_outline_json(docs).orderBy("pos").select("pos", "level", "title").collect()
    assert [tuple(r) for r in rows] == [(0, 1, "A"), (1, 2, "B, C")]
    assert docs.select(F.col("topic")).count() == 2


def test_many_headings_in_one_document(spark):
    rng = random.Random(9)
    outline = [(rng.randint(1, 6), "t") for _ in range(50_000)]
    got = {r.pos: r.parent_pos for r in O.outline_tree(frame(spark, {"0": outline})).collect()}
    assert got == dict(enumerate(stack_parents(outline)))
