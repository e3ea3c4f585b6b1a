import json

import pytest

from corpusgauge.operators import rollup as R
from corpusgauge.session import checkpoint_root, scratch_path, written_once
from corpusgauge.sources import corpus as S
from corpusgauge.sources import sinks


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("surveys")

    def put(path, text):
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text.encode("utf-8"))

    put("cs/Topic A+B 100%/s1/z.md", "# late")
    put("cs/Topic A+B 100%/s1/a b.MD", "# first\r\nline\rend é")
    put("cs/Topic A+B 100%/s1/notes.txt", "no")
    put("cs/Topic A+B 100%/pdfs/2401.00001.md", "# human")
    put("econ/T2/s1/x.md", "# other")
    put("cs/Topic A+B 100%/s1/results_m-1.json", json.dumps({"Outline": 4, "Faithfulness": 50.5, "note": None, "why": "n/a"}))
    put("econ/T2/s1/results_m.json", "{broken")
    return str(root)


def test_corpus(spark, tree):
    rows = S.scan_corpus(spark, tree).orderBy("category", "system").collect()
    assert [(r.category, r.topic, r.system, r.md) for r in rows] == [
        ("cs", "Topic A+B 100%", "pdfs", "# human"),
        ("cs", "Topic A+B 100%", "s1", "# first\nline\nend é"),
        ("econ", "T2", "s1", "# other"),
    ]
    assert rows[1].path.endswith("/Topic A+B 100%/s1/a b.MD")


def test_results(spark, tree):
    rows = S.scan_results(spark, tree).orderBy("metric").collect()
    assert [(r.topic, r.system, r.model, r.metric, r.value) for r in rows] == [
        ("Topic A+B 100%", "s1", "m-1", "Faithfulness", 50.5), ("Topic A+B 100%", "s1", "m-1", "Outline", 4.0),
    ]


def test_tasks(spark):
    topics = spark.createDataFrame([("cs", "T1"), ("cs", "T2")], "category string, topic string")
    tasks = S.build_tasks(topics, ["a", "b"])
    assert {r.path for r in tasks.collect()} == {"cs/T1/a", "cs/T1/b", "cs/T2/a", "cs/T2/b"}
    raw = json.dumps({"a": [{"T1": "p1"}, {"T2": "p2"}], "b": [{"T1": "p3"}], "z": []})
    maps = spark.createDataFrame([(raw,), ("broken",)], "raw string")
    got = {(r.system, r.topic, r.path) for r in S.scan_tasks(maps, ["a"]).collect()}
    assert got == {("a", "T1", "p1"), ("a", "T2", "p2")}
    assert S.scan_tasks(maps).count() == 3


def test_references_json(spark):
    docs = spark.createDataFrame([(1, '[" [1] a ", "", "b"]'), (2, "{}"), (3, "[1, 2")], "doc int, raw string")
    rows = S.scan_refs_json(docs, keys=["doc"]).collect()
    assert [(r.doc, r.ref_pos, r.entry) for r in rows] == [(1, 0, "[1] a"), (1, 1, "b")]


def test_gaps(spark):
    tasks = S.build_tasks(spark.createDataFrame([("cs", "T1"), ("cs", "T2")], "category string, topic string"), ["a", "b"])
    docs = spark.createDataFrame([("cs", "T1", "a"), ("cs", "T1", "pdfs")], "category string, topic string, system string")
    gaps = S.corpus_gaps(tasks, docs)
    got = {(r.topic, r.system): (r.has_document, r.has_baseline) for r in gaps.collect()}
    assert got == {("T1", "a"): (True, True), ("T1", "b"): (False, True), ("T2", "a"): (False, False), ("T2", "b"): (False, False)}
    totals = {r.system: (r.tasks, r.present, r.missing, r.no_baseline) for r in S.gap_totals(gaps).collect()}
    assert totals == {"a": (2, 1, 1, 1), "b": (2, 0, 2, 1)}
    assert {r.system: r.docs for r in S.corpus_counts(docs).collect()} == {"a": 1, "pdfs": 1}


def test_csv_keeps_awkward_text(spark):
    rows = [("c", 'say "hi", ok', 1.5), ("d", "semi;colon", None)]
    df = spark.createDataFrame(rows, "category string, sentence string, value double")
    path = scratch_path(spark, "csv")
    sinks.write_csv(df, path)
    back = S.scan_csv(spark, path, "category string, sentence string, value double").orderBy("category")
    assert [tuple(r) for r in back.collect()] == rows


def test_nested_averages_and_text_sink(spark):
    averages = spark.createDataFrame(
        [("c", "s", "m", "B", 2.0), ("c", "s", "m", "A", 1.5), ("c", "t", "n", "A", 3.0)],
        "category string, system string, model string, metric string, value double",
    )
    out = sinks.nested_averages(averages)
    assert json.loads(out.first().value) == {"s": {"m": {"A": 1.5, "B": 2.0}}, "t": {"n": {"A": 3.0}}}
    path = scratch_path(spark, "text")
    sinks.write_text(out, path, partition_by=["category"])
    assert [r.value for r in spark.read.text(path).select("value").collect()] == [out.first().value]
    assert R.avg_macro_system(averages).count() == 3


class Named:
    """A session with ``spark.checkpoint.dir`` set, or a cluster without it."""

    def __init__(self, folder=None, master="local[2]"):
        self.conf = self.sparkContext = self
        self.folder, self.master = folder, master

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return None


def test_shared_folder_is_read_from_the_session(spark):
    assert checkpoint_root(Named("hdfs:///shared")) == "hdfs:///shared"
    assert scratch_path(Named("hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    with pytest.raises(ValueError):
        checkpoint_root(Named(master="yarn"))
    assert checkpoint_root(spark) == checkpoint_root(spark)
    assert written_once(spark.range(5)).count() == 5
