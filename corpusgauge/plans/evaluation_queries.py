"""Registered whole computations and answer readers with their oracles."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from corpusgauge.functions.numbers import half_up
from corpusgauge.operators import documents as D
from corpusgauge.operators import judging as J
from corpusgauge.operators import outline as O
from corpusgauge.operators.ledger import judge_once
from corpusgauge.plans import evaluation as E
from corpusgauge.plans import judging_queries as Q
from corpusgauge.plans import rollup_queries as U
from corpusgauge.plans import text_queries as X
from corpusgauge.plans.judging_queries import KEYS, K, filled
from corpusgauge.plans.registry import half_up_sql as hu
from corpusgauge.plans.registry import register
from corpusgauge.schema import CONTENT_CRITERIA, METRICS, RATIO_METRICS, TOP_ITEMS
from corpusgauge.session import scratch_path


@register("outline_text", ("v_docs",), f"WITH {X.PARTS}, {Q._TEXTS} SELECT {K}, flat, text FROM outlines")
def outline_text(t):
    return O.outline_text(t.v_docs)


def _digit(prompt: str) -> str:
    return f"(strpos('0123456789abcdef', substring(md5({prompt}), 1, 1)) - 1)"


def _one_root(prompt: str) -> str:
    """Offline answer to a flat outline: all but the first heading go down a level."""
    pairs = json.loads(prompt[prompt.index("[\n"): prompt.index("\n]\n") + 2])
    return "Here: " + json.dumps([[2 if n else 1, title] for n, (_, title) in enumerate(pairs)])


@register("outline_refine", ("v_docs",), f"""WITH {X.HEADS},
f AS (SELECT {K}, max(level) = 1 AS flat FROM heads GROUP BY {K})
SELECT {K}, cast(pos AS integer) AS pos, cast(CASE WHEN flat AND pos > 0 THEN 2 ELSE level END AS integer) AS level, title FROM heads JOIN f USING ({K})""")
def outline_refine(t):
    return E.refined_outline(t.v_docs, _one_root)


@register("claim_extraction_requests", ("v_docs",), f"""WITH
s AS (SELECT {K}, list_filter(string_split(regexp_replace(md, '(?m)^(#+{X.WS})', chr(1) || '\\1', 'g'), chr(1)), lambda x: regexp_matches(x, '\\A#+{X.WS}')) AS s FROM v_docs),
u AS (SELECT {K}, generate_subscripts(s, 1) - 1 AS section_no, unnest(s) AS section FROM s)
SELECT {K}, section_no, {Q._digest_sql(filled(J.TEMPLATES['claim_extraction']))} FROM u""")
def claim_extraction_requests(t):
    asked = J.template_requests(D.sections_by_heading(t.v_docs), "claim_extraction", [*KEYS, "section_no"])
    return Q._digest(asked, *KEYS, "section_no")


@register("claim_removal_requests", ("v_turns",), f"""WITH {Q.PIECES},
g AS (SELECT doc, claim_no // 300 AS group_no, string_agg(claim_no % 300 + 1 || '. ' || claim, chr(10) ORDER BY claim_no % 300) AS numbered FROM claims GROUP BY ALL)
SELECT doc, group_no, {filled(J.TEMPLATES['claim_removal'])} AS prompt FROM g""")
def claim_removal_requests(t):
    return J.claim_removal_requests(Q._claims(t).select("doc", "claim_no", "claim"), ["doc"])


def statements_by_period(prompt: str) -> str:
    """Offline answers: pieces between periods are the claims of a section; of equal claims all but the first repeat."""
    if not prompt.startswith("Text:\n"):
        return Q.repeats_by_text(prompt)
    pieces = [" ".join(p.split()) for p in prompt[6 : prompt.rindex("\nList its")].split(".")]
    return "Found:\n" + "\n".join(f"{n}. {p}" for n, p in enumerate([p for p in pieces if p], 1))


@register("document_claim_density", ("v_docs",), f"""WITH
s AS (SELECT {K}, list_filter(string_split(regexp_replace(md, '(?m)^(#+{X.WS})', chr(1) || '\\1', 'g'), chr(1)), lambda x: regexp_matches(x, '\\A#+{X.WS}')) AS s FROM v_docs),
u AS (SELECT {K}, generate_subscripts(s, 1) - 1 AS section_no, unnest(s) AS section FROM s),
n AS (SELECT {K}, section_no, len(list_filter(regexp_split_to_array({X.trim_sql('section')}, '[.!?\n]+(?:{X.WS}|\\z)'), lambda x: x <> '')) AS sentences,
 list_filter(list_transform(string_split(section, '.'), lambda x: {X.trim_sql(f"regexp_replace(x, '{X.WS}+', ' ', 'g')")}), lambda x: x <> '') AS c FROM u),
c AS (SELECT {K}, unnest(list_append(c[:-2], c[-1] || '.')) AS claim FROM n WHERE len(c) > 0),
counts AS (SELECT {K}, count(*) AS before, count(DISTINCT claim) AS after FROM c GROUP BY {K}),
sums AS (SELECT {K}, cast(sum(sentences) AS bigint) AS sentences FROM n GROUP BY {K})
SELECT {K}, coalesce(sentences, 0) AS sentences, coalesce(before, 0) AS claims_before, CASE WHEN sentences > 0 THEN {hu('coalesce(before, 0) / sentences', 4)} ELSE 0 END AS density_before,
 coalesce(after, 0) AS claims_after, CASE WHEN sentences > 0 THEN {hu('coalesce(after, 0) / sentences', 4)} ELSE 0 END AS density_after,
 CASE WHEN before > 0 THEN {hu('after / before', 4)} ELSE 0 END AS compression_ratio
FROM v_docs d LEFT JOIN sums USING ({K}) LEFT JOIN counts USING ({K})""")
def document_claim_density(t):
    return E.document_claim_density(t.v_docs, statements_by_period)


# a run that asked for some facets only, and one for all that finds their answers
@register("judge_apply_resumed", ("v_docs",), f"""WITH {X.PARTS}, {Q._TEXTS},
p AS (SELECT {K}, criterion, {_digit(filled(J.TEMPLATES['criterion']))} AS digit FROM texts JOIN rubric USING (facet))
SELECT {K}, criterion, 'score' AS metric, 1.0e0 + digit % 5 AS value FROM p""")
def judge_apply_resumed(t):
    asked, ledger = J.criterion_requests(Q._texts(t)), scratch_path(t.spark, "ledger")
    judge_once(asked.where("criterion IN ('Outline', 'Reference')"), J.answer_by_digest, ledger)
    return J.judge_scores(J.judge_parse(judge_once(asked, J.answer_by_digest, ledger, calls=4)), ["score"])


@register("children_verdicts", (), """SELECT d.doc_id, n.i AS child_index, CASE WHEN (doc_id + cast(n.i AS integer)) % 2 = 0 THEN 'Yes' ELSE 'No' END AS is_included
FROM documents d, (VALUES ('1'), ('2')) n(i) WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE doc_id % 3 = 0""")
def children_verdicts(t):
    def child(n: int):
        verdict = F.when((F.col("doc_id") + n) % 2 == 0, "Yes").otherwise("No")
        return F.concat(F.lit(f'{{"child_index": "{n}", "child_title": '), F.to_json(F.array("text")), F.lit(', "is_included": "'), verdict, F.lit('"}'))

    judged = F.concat(F.lit('Answer: {"children": ['), child(1), F.lit(", "), child(2), F.lit("]} "))
    raw = F.when(F.col("doc_id") % 3 == 0, F.lit("no answer")).otherwise(judged)
    return J.children_verdicts(J.judge_parse(t.documents.select("doc_id", raw.alias("raw"))), ["doc_id"]).drop("child")


@register("comparison_verdicts", ("v_comparisons",), f"""
SELECT {K}, model, metric, CASE WHEN swapped THEN NOT is_better ELSE is_better END AS is_better, 'as ' || metric || ': ' || text AS reason FROM v_comparisons JOIN documents ON topic = cast(doc_id AS varchar) WHERE metric <> 'outline' OR swapped""")
def comparison_verdicts(t):
    texts = t.documents.select(F.col("doc_id").cast("string").alias("topic"), "text")
    pairs = t.v_comparisons.join(texts, "topic")
    reason = F.to_json(F.struct(F.concat(F.lit("as "), "metric", F.lit(": "), "text").alias("reason")))
    verdict = F.concat(F.lit('{"is_better": '), F.col("is_better").cast("string"), F.lit(", "), F.substr(reason, F.lit(2)))
    # some answers hold no verdict
    raw = F.when((F.col("metric") != "outline") | F.col("swapped"), verdict).otherwise(F.lit("{}"))
    key = [*KEYS, "model", "metric"]
    return J.comparison_verdicts(J.judge_parse(pairs.select(*key, "swapped", raw.alias("raw"))), key)


_CRITERION = filled(J.TEMPLATES["criterion"])
_DEFAULTS = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {100.0 if m == 'Outline_structure' else 0.0} AS fallback" for m in METRICS
)
_CONTENT_ROWS = ", ".join(f"('{c}')" for c in CONTENT_CRITERIA)


_EVALUATED = f"""WITH {X._ALL_PARTS}, {Q._TEXTS}, {X.TREE},
graded AS (SELECT {K}, criterion AS metric, 1.0e0 + {_digit(_CRITERION)} % 5 AS value FROM texts JOIN rubric USING (facet) WHERE facet <> 'content'),
together AS (SELECT {K}, 1.0e0 + {_digit(filled(J.TEMPLATES['all_criteria'], text='main_content', rubric=Q.literal(Q._LISTED)))} % 5 AS value FROM parts),
lists AS (SELECT {K}, parent_pos, parent_title, parent_level, max_depth, string_agg('  - Index: ' || pos || ', Title: ' || title, chr(10) ORDER BY pos) AS children_list, list(pos) AS kids
 FROM tree WHERE parent_pos IS NOT NULL GROUP BY {K}, parent_pos, parent_title, parent_level, max_depth),
digits AS (SELECT *, {_digit(filled(J.TEMPLATES['children']))} AS digit FROM lists),
nodes AS (SELECT {K}, parent_level, max_depth, len(list_filter(kids, lambda k: (k + digit) % 3 <> 0)) / len(kids) AS score, (max_depth - parent_level + 1) / max_depth AS weight FROM digits),
structure AS (SELECT {K}, sum(score * weight) / sum(weight) * 100 AS value FROM nodes GROUP BY {K}),
found AS (SELECT {K}, sent_no, sentence, refs FROM cited UNION ALL SELECT {K}, sent_no, sentence, refs FROM by_bare
 UNION ALL SELECT l.category, l.topic, l.system, l.sent_no, l.sentence, string_agg(r.ref_id || ' ' || r.ref_text, ';' ORDER BY r.ref_at)
 FROM loose l JOIN lookup r ON r.category = l.category AND r.topic = l.topic AND r.system = l.system
 WHERE {X._SURNAME_HIT} AND {X._NOT_IN('cited')} AND {X._NOT_IN('by_bare')} GROUP BY ALL),
once AS (SELECT {K}, sentence, replace(arg_max(refs, sent_no), ';', chr(10)) AS listed FROM found GROUP BY {K}, sentence),
faith AS (SELECT {K}, {_digit(filled(J.TEMPLATES['faithfulness'], references='listed'))} AS digit FROM once),
batched AS (SELECT {K}, ref_pos // 20 AS batch_no, string_agg(entry, chr(10) ORDER BY ref_pos) AS batch FROM refs GROUP BY {K}, ref_pos // 20),
quality AS (SELECT {K}, {_digit(filled(J.TEMPLATES['reference_batch']))} AS digit FROM batched),
scored AS (SELECT * FROM graded UNION ALL SELECT {K}, c.metric, value FROM together, (VALUES {_CONTENT_ROWS}) c(metric)
 UNION ALL SELECT {K}, 'Outline_structure', {hu('value', 4)} FROM structure
 UNION ALL SELECT {K}, 'Faithfulness', {hu(hu('sum(digit) / sum(1 + digit)', 4) + ' * 100', 2)} FROM faith GROUP BY {K}
 UNION ALL SELECT {K}, 'Reference_quality', {hu('sum(digit) / sum(1 + digit) * 100', 2)} FROM quality GROUP BY {K})
SELECT p.category, p.topic, p.system, 'default' AS model, d.metric, coalesce(s.value, d.fallback) AS value FROM parts p CROSS JOIN ({_DEFAULTS}) d
LEFT JOIN scored s ON s.category = p.category AND s.topic = p.topic AND s.system = p.system AND s.metric = d.metric"""


@register("evaluate_documents", ("v_docs",), _EVALUATED)
def evaluate_documents(t):
    return E.evaluate_documents(t.v_docs)


# what a failing judge has left: zeros and gaps, of which all but the faithfulness are asked for again
@register("supplement_scores", ("v_docs",), f"""SELECT category, topic, system, model, metric,
 CASE WHEN metric = 'Faithfulness' AND cast(topic AS bigint) % 5 = 3 THEN 0.0 ELSE value END AS value FROM ({_EVALUATED}) e""")
def supplement_scores(t):
    case, metric = F.col("topic").cast("bigint") % 5, F.col("metric")
    failed = ((case == 0) & (metric == "Coverage")) | ((case == 1) & (metric == "Outline")) | ((case == 3) & (metric == "Faithfulness"))
    left = E.evaluate_documents(t.v_docs).filter(~((case == 2) & (metric == "Coverage")))
    return E.supplement_scores(t.v_docs, left.withColumn("value", F.when(failed, 0.0).otherwise(F.col("value"))))


_ITEMS = f"""
secs AS (SELECT {K}, string_split(replace(main_content, chr(10) || '#', chr(1) || '#'), chr(1)) AS s FROM parts),
items AS (SELECT {K}, 'outline' AS facet, path_no AS item_no, path AS text FROM paths
 UNION ALL SELECT {K}, 'content', generate_subscripts(s, 1) - 1, unnest(s) FROM secs
 UNION ALL SELECT {K}, 'reference', ref_pos, entry FROM refs)
"""
_PATHS = X.PATHS


@register("similarity_items", ("v_docs",), f"""WITH RECURSIVE {X.PARTS}, {X.ENTRIES}, {X.HEADS}, {_PATHS}, {_ITEMS}
SELECT {K}, facet, cast(item_no AS bigint) AS item_no, text FROM items""")
def similarity_items(t):
    return E.similarity_items(t.v_docs)


def _one_topic_per_source(t):
    """Documents of a source share its topic; its first English one is the baseline."""
    first = t.v_docs.filter("system = 'en'").groupBy("category").agg(F.min("doc_id").alias("first"))
    system = F.when(F.col("doc_id") == F.col("first"), F.lit("pdfs")).otherwise(F.concat_ws("/", "topic", "system"))
    return t.v_docs.join(first, "category", "left").select(
        "category", F.col("category").alias("topic"), system.alias("system"), "md"
    )


_SHARES = "[" + ", ".join(
    f"cast(length(text) - length(replace(text, '{c}', '')) AS double) / greatest(length(text), 1)" for c in "abcdefghijklmnopqrstuvwxyz"
) + "]"
_TOP = "CASE facet " + " ".join(f"WHEN '{f}' THEN {n}" for f, n in TOP_ITEMS.items()) + " END"


_MEANS = f"""
first AS (SELECT category, min(doc_id) AS first FROM v_docs WHERE system = 'en' GROUP BY category),
renamed AS (SELECT category, category AS topic, CASE WHEN doc_id = first THEN 'pdfs' ELSE topic || '/' || system END AS system, md FROM v_docs LEFT JOIN first USING (category)),
{X.PARTS.replace('FROM v_docs', 'FROM renamed')}, {X.ENTRIES}, {X.HEADS.replace('FROM v_docs', 'FROM renamed')}, {_PATHS}, {_ITEMS},
vec AS (SELECT {K}, facet, item_no, {_SHARES} AS e FROM items),
near AS (SELECT a.category, a.topic, a.system, a.facet, a.item_no, 1 - min(list_sum(list_transform(list_zip(a.e, b.e), lambda z: pow(z[1] - z[2], 2)))) AS score
 FROM vec a JOIN vec b ON b.system = 'pdfs' AND b.category = a.category AND b.topic = a.topic AND b.facet = a.facet GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {K}, facet ORDER BY score DESC) AS rn FROM near),
means AS (SELECT {K}, facet, avg(score) AS mean_score, count(*) AS n FROM ranked WHERE rn <= {_TOP} GROUP BY {K}, facet)
"""


@register("document_similarity", ("v_docs",), f"""WITH RECURSIVE {_MEANS}
SELECT r.category, r.topic, r.system, f.facet, {hu('coalesce(mean_score, 0)', 6)} AS mean_score, coalesce(n, 0) AS n
FROM renamed r CROSS JOIN (VALUES ('outline'), ('content'), ('reference')) f(facet) LEFT JOIN means m
ON m.category = r.category AND m.topic = r.topic AND m.system = r.system AND m.facet = f.facet""")
def document_similarity(t):
    out = E.document_similarity(_one_topic_per_source(t))
    return out.select(
        *KEYS, "facet", half_up(F.col("mean_score"), 6).alias("mean_score"), F.size("scores").cast("bigint").alias("n")
    )


def _prefers_by_digest(prompt: str) -> str:
    """Offline answer: the first place is better when the prompt's MD5 starts with an even digit."""
    return json.dumps({"is_better": int(hashlib.md5(prompt.encode()).hexdigest()[0], 16) % 2 == 0, "reason": "digest"})


# every document of a source competes with that source's first English one
@register("compare_documents", ("v_docs",), f"""WITH {X.PARTS}, {Q._TEXTS},
firsts AS (SELECT category, min(cast(topic AS bigint)) AS first FROM v_docs WHERE system = 'en' GROUP BY category),
named AS (SELECT t.category, t.category AS topic, CASE WHEN cast(topic AS bigint) = first THEN 'base' ELSE topic || '/' || system END AS system, facet, text
 FROM texts t JOIN firsts f ON f.category = t.category),
pairs AS (SELECT t.*, b.text AS base FROM named t JOIN named b ON b.category = t.category AND b.facet = t.facet AND b.system = 'base' WHERE t.system <> 'base'),
p AS (SELECT *, {Q._SWAP} AS swapped FROM pairs),
q AS (SELECT *, {filled(J.TEMPLATES['comparison'], position_1='CASE WHEN swapped THEN base ELSE text END', position_2='CASE WHEN swapped THEN text ELSE base END')} AS prompt FROM p),
won AS (SELECT category, system, facet AS metric, (({_digit('prompt')}) % 2 = 0) <> swapped AS is_better FROM q),
c AS (SELECT category, system, metric, cast(sum(CASE WHEN is_better THEN 1 ELSE 0 END) AS bigint) AS wins, count(*) AS total FROM won GROUP BY ALL
 UNION ALL SELECT NULL, system, metric, cast(sum(CASE WHEN is_better THEN 1 ELSE 0 END) AS bigint), count(*) FROM won GROUP BY system, metric)
SELECT category, system, 'default' AS model, metric, wins, total - wins AS losses, total, printf('%.2f%%', wins * 100.0e0 / total) AS win_rate FROM c""")
def compare_documents(t):
    firsts = t.v_docs.filter("system = 'en'").groupBy("category").agg(F.min(F.col("topic").cast("bigint")).alias("first"))
    own = F.col("topic").cast("bigint") == F.col("first")
    docs = t.v_docs.join(firsts, "category").select(
        "category", F.col("category").alias("topic"),
        F.when(own, F.lit("base")).otherwise(F.concat_ws("/", "topic", "system")).alias("system"), "md",
    )
    return E.compare_documents(docs, _prefers_by_digest, baseline="base")


# outlines are stored, contents are stored as zeros, references are not stored
_STORED = """
old AS (SELECT category, topic, system, 'outline' AS facet, 0.25 AS mean_score FROM renamed UNION ALL SELECT category, topic, system, 'content', 0.0 FROM renamed),
v_similarity AS (SELECT r.category, r.topic, r.system, f.facet, coalesce(nullif(cast(o.mean_score AS double), 0), m.mean_score, 0) AS mean_score
 FROM renamed r CROSS JOIN (VALUES ('outline'), ('content'), ('reference')) f(facet) LEFT JOIN old o USING (category, topic, system, facet)
 LEFT JOIN means m ON m.category = r.category AND m.topic = r.topic AND m.system = r.system AND m.facet = f.facet)
"""


def _stored(docs):
    old = F.array(*[F.struct(F.lit(f).alias("facet"), F.lit(v).alias("mean_score")) for f, v in (("outline", 0.25), ("content", 0.0))])
    return docs.select(*KEYS, F.inline(old))


@register("refreshed_similarity", ("v_docs",), f"""WITH RECURSIVE {_MEANS}, {_STORED}
SELECT {K}, facet, {hu('mean_score', 6)} AS mean_score FROM v_similarity""")
def refreshed_similarity(t):
    docs = _one_topic_per_source(t)
    found = E.refreshed_similarity(docs, _stored(docs))
    return found.select(*KEYS, "facet", half_up(F.col("mean_score"), 6).alias("mean_score"))


_GRADED = ", ".join(f"('{m}', {n}, {101 if m in RATIO_METRICS else 5})" for n, m in enumerate(METRICS))
_BASED = "SELECT DISTINCT category, topic, model FROM v_scores WHERE system = 'pdfs'"


# grades follow from the length of a document
@register("adjusted_leaderboard", ("v_docs",), f"""WITH RECURSIVE {_MEANS}, {_STORED},
v_scores AS (SELECT {K}, 'm' AS model, metric, cast((length(md) + n) % top AS double) AS value FROM renamed, (VALUES {_GRADED}) g(metric, n, top)),
{U.BLEND.replace("'view'", "'pdfs'").replace('blend AS (', 'blended AS (')},
blend AS (SELECT b.* FROM blended b JOIN ({_BASED}) h USING (category, topic, model)),
{U.BOARD.replace("'view'", "'pdfs'")}""")
def adjusted_leaderboard(t):
    docs = _one_topic_per_source(t)
    grades = F.array(*[
        F.struct(F.lit(m).alias("metric"), ((F.length("md") + n) % (101 if m in RATIO_METRICS else 5)).cast("double").alias("value"))
        for n, m in enumerate(METRICS)
    ])
    scores = docs.select(*KEYS, F.lit("m").alias("model"), F.inline(grades))
    return E.adjusted_leaderboard(docs, scores, _stored(docs))
