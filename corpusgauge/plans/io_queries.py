"""Registered source and sink queries with their oracles.

Parsers read rows of (path, raw) that Spark builds from the tables; the
readers over real files are tested on folders in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgauge.operators import rollup as R
from corpusgauge.plans.registry import half_up_sql as hu
from corpusgauge.plans.registry import register
from corpusgauge.plans.text_queries import trim_sql
from corpusgauge.schema import METRICS
from corpusgauge.session import scratch_path
from corpusgauge.sources import corpus as S
from corpusgauge.sources import sinks

_TREE_SQL = "source, cast(doc_id AS varchar) AS topic, lang"


def _corpus_files(t):
    """Two markdown files per document and a stray text file."""
    where = F.concat_ws("/", F.lit("/data/surveys"), "source", F.col("doc_id").cast("string"), "lang")
    names = F.array(*[F.lit(n) for n in ("b.md", "a draft.MD", "notes.txt")])
    rows = t.documents.select(where.alias("dir"), "text", F.explode(names).alias("name"))
    raw = F.concat(F.lit("# "), "name", F.lit("\r\n"), "text")
    return rows.select(F.concat_ws("/", "dir", "name").alias("path"), raw.alias("raw"))


@register("scan_corpus", (), """SELECT source AS category, cast(doc_id AS varchar) AS topic, lang AS system,
 concat('/data/surveys/', source, '/', doc_id, '/', lang, '/a draft.MD') AS path, concat('# a draft.MD', chr(10), text) AS md FROM documents""")
def scan_corpus(t):
    return S.documents_from_files(_corpus_files(t))


@register("scan_results", ("v_scores",), "SELECT category, topic, system, model, metric, value FROM v_scores")
def scan_results(t):
    cells = F.array_sort(F.collect_list(F.struct("metric", "value")))
    files = t.v_scores.groupBy("category", "topic", "system", "model").agg(
        F.to_json(F.map_from_entries(cells)).alias("raw")
    )
    name = F.concat(F.lit("results_"), "model", F.lit(".json"))
    path = F.concat_ws("/", F.lit("/data/surveys"), "category", "topic", "system", name)
    return S.results_from_files(files.select(path.alias("path"), "raw"))


@register("scan_tasks", (), """SELECT doc_id, lang AS system, cast(doc_id AS varchar) AS topic, concat(source, '/', doc_id, '/', lang) AS path FROM documents WHERE lang IN ('en', 'fr', 'de')
UNION ALL SELECT doc_id, lang, concat('x', doc_id), 'other' FROM documents WHERE lang IN ('en', 'fr', 'de')""")
def scan_tasks(t):
    raw = F.concat(
        F.lit('{"'), "lang", F.lit('": [{"'), F.col("doc_id").cast("string"), F.lit('": "'),
        F.concat_ws("/", "source", F.col("doc_id").cast("string"), "lang"), F.lit('"}, {"x'),
        F.col("doc_id").cast("string"), F.lit('": "other"}], "unknown": [{"a": "b"}]}'),
    )
    return S.scan_tasks(t.documents.select("doc_id", raw.alias("raw")), ["en", "fr", "de"])


_TASKS = """
tasks AS (SELECT d.source AS category, cast(d.doc_id AS varchar) AS topic, s.system, concat(d.source, '/', d.doc_id, '/', s.system) AS path FROM documents d, (VALUES ('en'), ('fr'), ('pdfs')) s(system))
"""


def _topics(t):
    return t.documents.select(F.col("source").alias("category"), F.col("doc_id").cast("string").alias("topic"))


@register("build_tasks", (), f"WITH {_TASKS} SELECT * FROM tasks")
def build_tasks(t):
    return S.build_tasks(_topics(t), ["en", "fr", "pdfs"])


@register("task_maps", (), f"WITH {_TASKS} SELECT system, category, topic, concat('{{\"', topic, '\":\"', path, '\"}}') AS value FROM tasks")
def task_maps(t):
    return S.task_maps(S.build_tasks(_topics(t), ["en", "fr", "pdfs"]))


@register("scan_outline_json", (), """SELECT doc_id, 0 AS pos, 1 AS level, concat(source, ' "x"') AS title FROM documents
UNION ALL SELECT doc_id, 1, 2, lang FROM documents UNION ALL SELECT doc_id, 2, cast(1 + doc_id % 3 AS integer), text FROM documents""")
def scan_outline_json(t):
    text = F.to_json(F.struct("text"))
    body = F.regexp_extract(text, r'(?s)\A\{"text":(.*)\}\z', 1)
    raw = F.concat(
        F.lit('[[1, "'), "source", F.lit(' \\"x\\""], [2, "'), "lang", F.lit('"], ['),
        (1 + F.col("doc_id") % 3).cast("string"), F.lit(", "), body, F.lit("]]"),
    )
    return S.scan_outline_json(t.documents.select("doc_id", raw.alias("raw")), keys=["doc_id"])


@register("scan_refs_json", (), f"""WITH l AS (SELECT doc_id, list_filter(list_transform(['[1] ' || source || '  ', '   ', text], lambda x: {trim_sql('x')}), lambda x: x <> '') AS e FROM documents WHERE doc_id % 10 <> 9)
SELECT doc_id, generate_subscripts(e, 1) - 1 AS ref_pos, unnest(e) AS entry FROM l""")
def scan_refs_json(t):
    listed = F.to_json(F.array(F.concat(F.lit("[1] "), "source", F.lit("  ")), F.lit("   "), F.col("text")))
    # every tenth file is broken
    raw = F.when(F.col("doc_id") % 10 == 9, F.concat(F.lit("[not json, "), "source")).otherwise(listed)
    return S.scan_refs_json(t.documents.select("doc_id", raw.alias("raw")), keys=["doc_id"])


@register("scan_csv", ("v_scores",), "SELECT category, topic, system, model, metric, value FROM v_scores")
def scan_csv(t):
    path = scratch_path(t.spark, "scores-csv")
    sinks.write_csv(t.v_scores, path)
    return S.scan_csv(t.spark, path, "category string, topic string, system string, model string, metric string, value double")


_AS_TEXT = ", ".join(f"cast(max(CASE WHEN metric = '{m}' THEN value END) AS varchar) AS {m}" for m in METRICS)


@register("write_csv", ("v_scores",), f"SELECT topic, system, model, category, {_AS_TEXT} FROM v_scores GROUP BY topic, system, model, category")
def write_csv(t):
    """The result tables, a folder per category, read back as written."""
    path = scratch_path(t.spark, "results-csv")
    sinks.write_csv(R.results_table(t.v_scores), path, partition_by=["category"])
    columns = ", ".join(f"{c} string" for c in ["topic", "system", "model", *METRICS, "category"])
    return S.scan_csv(t.spark, path, columns)


@register("write_nested_averages", ("v_scores",), f"""WITH a AS (SELECT category, system, model, metric, {hu('avg(value)', 4)} AS value FROM v_scores GROUP BY category, system, model, metric),
m AS (SELECT category, system, model, '{{' || string_agg('"' || metric || '":' || value, ',' ORDER BY metric) || '}}' AS j FROM a GROUP BY category, system, model),
s AS (SELECT category, system, '{{' || string_agg('"' || model || '":' || j, ',' ORDER BY model) || '}}' AS j FROM m GROUP BY category, system)
SELECT category, '{{' || string_agg('"' || system || '":' || j, ',' ORDER BY system) || '}}' AS value FROM s GROUP BY category""")
def write_nested_averages(t):
    return sinks.nested_averages(R.avg_category(t.v_scores))


@register("corpus_counts", ("v_docs",), "SELECT system, count(*) AS docs FROM v_docs GROUP BY system")
def corpus_counts(t):
    return S.corpus_counts(t.v_docs)


# every fifth English document plays the baseline of its topic
_GAPS = """
docs AS (SELECT source AS category, cast(doc_id AS varchar) AS topic, lang AS system FROM documents
 UNION ALL SELECT d.source, cast(d.doc_id AS varchar), 'pdfs' FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1),
gaps AS (SELECT t.category, t.topic, t.system, EXISTS (SELECT 1 FROM docs d WHERE d.category = t.category AND d.topic = t.topic AND d.system = t.system) AS has_document,
 EXISTS (SELECT 1 FROM docs d WHERE d.category = t.category AND d.topic = t.topic AND d.system = 'pdfs') AS has_baseline FROM tasks t)
"""


def _gaps(t):
    docs = t.v_docs.select("category", "topic", "system")
    good = t.labels.filter("quality = 1").select(F.col("doc_id").cast("string").alias("topic"))
    baseline = _topics(t).join(good, "topic").select("category", "topic", F.lit("pdfs").alias("system"))
    return S.corpus_gaps(S.build_tasks(_topics(t), ["en", "fr", "pdfs"]), docs.unionByName(baseline))


@register("corpus_gaps", (), f"WITH {_TASKS}, {_GAPS} SELECT * FROM gaps")
def corpus_gaps(t):
    return _gaps(t)


@register("gap_totals", (), f"""WITH {_TASKS}, {_GAPS} SELECT system, count(*) AS tasks, count(*) FILTER (WHERE has_document) AS present,
 count(*) FILTER (WHERE NOT has_document) AS missing, count(*) FILTER (WHERE NOT has_baseline) AS no_baseline FROM gaps GROUP BY system""")
def gap_totals(t):
    return S.gap_totals(_gaps(t))
