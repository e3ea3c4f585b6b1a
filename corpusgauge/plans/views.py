"""Operator inputs derived from the driver's tables.

Every view is one portable SELECT that Spark and DuckDB read alike, so a
query and its oracle start from the same rows.  Documents, responses and
claims carry the whole text of the table they come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusgauge.session import widened

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_HEADING_2 = "CASE WHEN doc_id % 5 = 0 THEN '# ' ELSE '## ' END"
_HEADING_3 = "CASE WHEN doc_id % 5 = 0 THEN '# ' ELSE '### ' END"

VIEWS: dict[str, str] = {}

VIEWS["v_scores"] = """
SELECT category, topic, system, model, metric, min(v) AS value FROM (
 SELECT concat('c', cast(user_id % 4 AS string)) AS category, concat('t', cast(user_id % 20 AS string)) AS topic,
  event_type AS system, CASE WHEN event_id % 16 < 8 THEN 'm0' ELSE 'm1' END AS model, metric,
  CASE WHEN event_id % 29 = 0 THEN 0.0
       WHEN metric IN ('Outline_structure','Faithfulness','Reference_quality') THEN least(value, 100.0)
       ELSE 1.0 + least(value, 100.0) / 25.0 END AS v
 FROM (SELECT *, CASE (event_id * 7 + user_id) % 10 WHEN 0 THEN 'Outline' WHEN 1 THEN 'Outline_structure' WHEN 2 THEN 'Coverage'
   WHEN 3 THEN 'Structure' WHEN 4 THEN 'Relevance' WHEN 5 THEN 'Language' WHEN 6 THEN 'Criticalness' WHEN 7 THEN 'Faithfulness'
   WHEN 8 THEN 'Reference' ELSE 'Reference_quality' END AS metric FROM events) e) x
GROUP BY category, topic, system, model, metric
"""

# The whole text is section 3.  Reference lists come in the five shapes the
# splitter knows; a few documents cite by bare number or by surname only.
VIEWS["v_docs"] = f"""
SELECT source AS category, cast(doc_id AS string) AS topic, lang AS system, doc_id,
 concat('# ', s1, chr(10), chr(10),
  {_HEADING_2}, '1 Introduction', chr(10),
  CASE WHEN doc_id % 19 = 0 THEN concat(s2, ' as in 1 and 2-3. ', 'Then 9, then 4 and ', s3, ' by Lee.')
   ELSE concat(s2, ' [', cast(1 + doc_id % 5 AS string), ']. ', 'The next ', s3, ' [1]-[3].') END, chr(10),
  {_HEADING_3}, '1.1 Scope', chr(10),
  CASE WHEN doc_id % 19 = 0 THEN concat('A grouped ', s2, ' by Alpha. ')
   ELSE concat('A grouped ', s2, ' [2,4-6]. ') END, 'None here.', chr(10),
  {_HEADING_3}, '1.2 Terms', chr(10), '![fig](a.png) and $x+y$.', chr(10),
  CASE WHEN doc_id % 4 = 0 THEN concat('| a | b |', chr(10), '|---|---|', chr(10), '| 1 | 2 |', chr(10), '<img src="b.png">', chr(10)) ELSE '' END,
  {_HEADING_2}, '2 Methods', chr(10),
  CASE WHEN doc_id % 19 = 0 THEN concat('Work by Smith and ', s3, '.')
   ELSE concat('Work [Smith et al., 2018a; Lee, 2020] and (Kim and Ray, 2019; Lee, 2020) and ', s3, ' by Lee (2020) here.') END, chr(10),
  {_HEADING_2}, '3 Discussion', chr(10), text, chr(10),
  CASE WHEN doc_id % 17 = 0 THEN ''
   WHEN doc_id % 13 = 0 THEN concat('Selected Bibliography', chr(10),
    'Smith, Ann, Roy, Bo and Lee, Kim. 2018a. On ', lang, '.', chr(10), 'Dana Lee. 2020. On ', source, '.', chr(10),
    'Jo Kim and Al Ray. 2019. Gamma.', chr(10), 'No year here at all', chr(10))
   WHEN doc_id % 11 = 0 THEN concat('## Cited references', chr(10), '1. Alpha ', lang, chr(10), '2) Beta ', source, chr(10),
    '3 Gamma', chr(10), chr(10), '4. Delta', chr(10), '[Lee, 2020] Lee paper', chr(10))
   ELSE concat(CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 5 = 0 THEN concat('# References', chr(10)) ELSE concat('## References', chr(10)) END,
    '[1] Alpha ', lang, chr(10), '[2] Beta ', source, chr(10), '[3] Gamma', chr(10), '[4] Delta', chr(10), '[5] Epsilon', chr(10),
    '[Smith et al., 2018a] Smith paper', chr(10),
    CASE WHEN doc_id % 3 = 0 THEN concat('# Appendix A', chr(10), 'Tail ', s1, ' [4].', chr(10)) ELSE '' END) END) AS md
FROM (SELECT *, trim(replace(split_part(text, '.', 1), chr(10), ' ')) AS s1, trim(replace(split_part(text, '.', 2), chr(10), ' ')) AS s2,
  trim(replace(split_part(text, '.', 3), chr(10), ' ')) AS s3 FROM documents) d
"""

VIEWS["v_items"] = """
SELECT concat('t', cast(label AS string)) AS topic, concat('s', cast(vec_id % 5 AS string)) AS system,
 CASE vec_id % 3 WHEN 0 THEN 'outline' WHEN 1 THEN 'content' ELSE 'reference' END AS facet, vec_id AS item_no, embedding FROM embeddings
"""

VIEWS["v_responses"] = """
SELECT d.doc_id, source AS category, lang AS system, 1 + doc_id % 9 AS total, least(1 + doc_id % 9, doc_id % 7) AS supported, text AS sentence,
 concat(CASE doc_id % 4 WHEN 1 THEN 'Sure: ' WHEN 2 THEN concat('```json', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 4 = 3 AND doc_id % 8 = 7 THEN concat('no json here: ', replace(text, '}', ')')) ELSE concat('{"total": ', cast(1 + doc_id % 9 AS string), ', "reason": "', replace(replace(replace(replace(replace(text, chr(92), '/'), '"', '`'), chr(10), ' '), chr(13), ' '), chr(9), ' '), '", "supported": ', cast(least(1 + doc_id % 9, doc_id % 7) AS string), '}') END,
  CASE doc_id % 4 WHEN 1 THEN ' done' WHEN 2 THEN concat(chr(10), '```') ELSE '' END) AS raw FROM documents d
"""

# parents at depth 1 to 3 of outlines one to three levels deeper; some children are not judged, some parents have none
VIEWS["v_verdicts"] = """
SELECT doc_id % 40 AS doc, doc_id % 6 AS parent_pos, 1 + doc_id % 3 AS depth, 4 + doc_id % 40 % 3 AS max_depth,
 CASE WHEN doc_id % 6 = 5 AND doc_id % 40 % 4 = 1 THEN NULL ELSE doc_id END AS child,
 CASE WHEN doc_id % 7 = 3 THEN NULL WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS is_included FROM labels
"""

# outlines of many levels and jumps between them, one per order
VIEWS["v_outlines"] = """
SELECT cast(l_orderkey % 5 AS string) AS category, cast(l_orderkey AS string) AS topic, 's' AS system,
 cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS int) - 1 AS pos,
 CASE WHEN l_linenumber = 1 THEN 1 + cast(l_orderkey % 3 AS int) ELSE 1 + cast((l_partkey * 7 + l_suppkey) % 12 AS int) END AS level,
 concat('n', cast(l_partkey % 50 AS string)) AS title FROM lineitem
"""

VIEWS["v_comparisons"] = """
SELECT d.source AS category, cast(d.doc_id AS string) AS topic, d.lang AS system, CASE WHEN d.doc_id % 8 < 4 THEN 'm0' ELSE 'm1' END AS model,
 CASE d.doc_id % 3 WHEN 0 THEN 'outline' WHEN 1 THEN 'content' ELSE 'reference' END AS metric,
 d.doc_id % 2 = 1 AS swapped, l.quality = 1 AS is_better FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

VIEWS["v_papers"] = """
SELECT cast(o_custkey AS string) AS arxiv_id, o_orderkey AS listing_no,
 concat(CASE o_orderkey % 4 WHEN 0 THEN 'A Survey of topic ' WHEN 1 THEN 'Peer Review and a survey of ' WHEN 2 THEN 'Systematic Review on ' ELSE 'Notes on ' END, cast(o_orderkey % 97 AS string)) AS title,
 CASE WHEN o_orderkey % 5 = 0 THEN 'this survey covers' ELSE 'we study' END AS summary, o_orderdate AS published,
 cast(floor(o_totalprice / 1000) AS bigint) AS citation_count,
 CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'cs.AI' WHEN '2' THEN 'cs.DB' WHEN '3' THEN 'math.CO' WHEN '4' THEN 'econ.EM' ELSE 'stat.ML' END AS fine_category FROM orders
"""

VIEWS["v_density"] = """
SELECT concat('c', cast(l_partkey % 4 AS string)) AS category, concat('s', cast(l_suppkey % 4 AS string)) AS system, concat('m', cast(l_linenumber % 2 AS string)) AS model,
 avg(l_quantity) / 25 AS Images_density, avg(l_discount) * 20 AS Equations_density, avg(l_tax) * 25 AS Tables_density,
 avg(l_extendedprice) / 30000 AS Citations_density, count(*) / 2000.0e0 AS Claim_density FROM lineitem
GROUP BY concat('c', cast(l_partkey % 4 AS string)), concat('s', cast(l_suppkey % 4 AS string)), concat('m', cast(l_linenumber % 2 AS string))
"""

# One sentence per turn (its whole text and a number), one claim per piece.
VIEWS["v_turns"] = """
SELECT conv_id AS doc, turn AS sent_no, concat(text, ' ', cast(conv_id % 2 AS string), ' and ', cast(10 + conv_id % 3 AS string)) AS sentence, text FROM conversations
"""

VIEWS["v_claim_texts"] = """
SELECT doc_id AS doc, concat('Here you go:', chr(10), '1. Claim 1: ', replace(text, chr(10), concat(chr(10), '2. ')),
 CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), 'bye') ELSE '' END) AS raw FROM documents
"""

# Ids are in the order of the documents; each source owns a topic.
VIEWS["v_similarity"] = """
SELECT category, topic, system, facet,
 CASE WHEN n % 7 = 0 THEN 0.0 ELSE least(avg_value / 100.0, 1.0) END AS mean_score FROM (
 SELECT concat('c', cast(user_id % 4 AS string)) AS category, concat('t', cast(user_id % 20 AS string)) AS topic, event_type AS system,
  CASE event_id % 3 WHEN 0 THEN 'outline' WHEN 1 THEN 'content' ELSE 'reference' END AS facet, avg(value) AS avg_value, count(*) AS n FROM events
 GROUP BY concat('c', cast(user_id % 4 AS string)), concat('t', cast(user_id % 20 AS string)), event_type,
  CASE event_id % 3 WHEN 0 THEN 'outline' WHEN 1 THEN 'content' ELSE 'reference' END) s
"""


# long texts that are parsed row by row
TEXT_TABLES = ("documents", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return widened(df) if name in TEXT_TABLES else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of one view over the tables in ``sf_dir``."""
    for used in TABLES:
        if f" {used}" in VIEWS[name]:
            table(spark, sf_dir, used).createOrReplaceTempView(used)
    return spark.sql(VIEWS[name])


def with_views(sql: str, *names: str) -> str:
    """``sql`` for DuckDB, with the named views in front as CTEs."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    for head in ("WITH RECURSIVE", "WITH"):
        if body.startswith(head):
            return f"{head} {ctes}, {body[len(head):]}"
    return f"WITH {ctes} {body}"
