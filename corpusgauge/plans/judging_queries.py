"""Registered judging and claim queries with their oracles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corpusgauge.operators import citations as C
from corpusgauge.operators import claims as L
from corpusgauge.operators import documents as D
from corpusgauge.operators import judging as J
from corpusgauge.operators import outline as O
from corpusgauge.operators import references as P
from corpusgauge.plans import text_queries as X
from corpusgauge.plans.registry import half_up_sql as hu
from corpusgauge.plans.registry import register
from corpusgauge.functions.text import WS
from corpusgauge.schema import CONTENT_CRITERIA, FACET_METRICS

K = X.K
KEYS = ["category", "topic", "system"]


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled(template: str, **columns: str) -> str:
    """The template as a DuckDB concatenation."""
    import string

    pieces = []
    for text, field, _, _ in string.Formatter().parse(template):
        if text:
            pieces.append(literal(text))
        if field:
            pieces.append(f"cast({columns.get(field, field)} AS varchar)")
    return "(" + " || ".join(pieces) + ")"


def _digest(df, *keys):
    """Prompts carry whole texts; their digest and length stand for them."""
    return df.select(*keys, F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_chars"))


def _digest_sql(prompt: str) -> str:
    return f"md5({prompt}) AS prompt_md5, length({prompt}) AS prompt_chars"


def _texts(t):
    """Outline, main content and reference list of every document, by facet."""
    contents = D.split_content_refs(t.v_docs)
    facets = F.array(
        F.struct(F.lit("content").alias("facet"), F.col("main_content").alias("text")),
        F.struct(F.lit("reference").alias("facet"), F.col("ref_block").alias("text")),
    )
    outlines = O.outline_text(t.v_docs).select(*KEYS, F.lit("outline").alias("facet"), "text")
    return contents.select(*KEYS, F.inline(facets)).unionByName(outlines)


_RUBRIC = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in J.DEFAULT_RUBRIC)
_TEXTS = f"""
{X.HEADS},
outlines AS (SELECT {K}, max(level) = 1 AS flat, string_agg('[' || level || ', ' || to_json(title) || ']', chr(10) ORDER BY pos) AS text FROM heads GROUP BY {K}),
texts AS (SELECT {K}, 'content' AS facet, main_content AS text FROM parts UNION ALL SELECT {K}, 'reference', ref_block FROM parts
 UNION ALL SELECT {K}, 'outline', text FROM outlines),
rubric(criterion, facet, question, s1, s2, s3, s4, s5) AS (VALUES {_RUBRIC})
"""


@register("judge_requests", ("v_docs",), f"""WITH {X.PARTS}, {_TEXTS},
p AS (SELECT {K}, criterion, {filled(J.TEMPLATES['criterion'])} AS prompt FROM texts JOIN rubric USING (facet))
SELECT {K}, criterion, {_digest_sql('prompt')} FROM p""")
def judge_requests(t):
    return _digest(J.criterion_requests(_texts(t)), *KEYS, "criterion")


_LISTED = "\n".join(
    f"{r[0]}: {r[2]} " + "; ".join(f"{n} = {g}" for n, g in enumerate(r[3:], 1))
    for r in J.DEFAULT_RUBRIC if r[0] in CONTENT_CRITERIA
)


@register("judge_requests_all", ("v_docs",), f"""WITH {X.PARTS},
p AS (SELECT {K}, {filled(J.TEMPLATES['all_criteria'], text='main_content', rubric=literal(_LISTED))} AS prompt FROM parts)
SELECT {K}, {_digest_sql('prompt')} FROM p""")
def judge_requests_all(t):
    texts = D.split_content_refs(t.v_docs).withColumnRenamed("main_content", "text")
    return _digest(J.all_criteria_requests(texts), *KEYS)


@register("judge_requests_children", ("v_docs",), f"""WITH {X.HEADS}, {X.TREE},
e AS (SELECT {K}, parent_pos, parent_title, string_agg('  - Index: ' || pos || ', Title: ' || title, chr(10) ORDER BY pos) AS children_list
 FROM tree WHERE parent_pos IS NOT NULL GROUP BY ALL)
SELECT {K}, parent_pos, {filled(J.TEMPLATES['children'])} AS prompt FROM e""")
def judge_requests_children(t):
    edges = O.outline_edges(O.outline_tree(O.outline_extract(t.v_docs)))
    return J.template_requests(edges, "children", [*KEYS, "parent_pos"])


@register("judge_requests_faithfulness", ("v_docs",), f"""WITH {X.PARTS}, {X.SENTENCES}, {X.ENTRIES}, {X.LOOKUP}, {X.RESOLVED}
SELECT {K}, sent_no, {filled(J.TEMPLATES['faithfulness'], references="replace(refs, ';', chr(10))")} AS prompt FROM cited""")
def judge_requests_faithfulness(t):
    cited = C.cite_resolve(D.split_content_refs(t.v_docs))
    listed = F.replace(F.array_join("references", ";"), F.lit(";"), F.lit("\n"))
    return J.template_requests(cited, "faithfulness", [*KEYS, "sent_no"], references=listed)


@register("judge_requests_references", ("v_docs",), f"""WITH {X.PARTS}, {X.ENTRIES},
b AS (SELECT {K}, ref_pos // 20 AS batch_no, string_agg(entry, chr(10) ORDER BY ref_pos) AS batch FROM refs GROUP BY {K}, ref_pos // 20)
SELECT {K}, batch_no, {filled(J.TEMPLATES['reference_batch'])} AS prompt FROM b""")
def judge_requests_references(t):
    return J.template_requests(P.ref_batches(D.split_content_refs(t.v_docs)), "reference_batch", [*KEYS, "batch_no"])


_SWAP = "strpos('13579bdf', substring(md5(concat_ws('|', category, topic, system, facet, '0')), 1, 1)) > 0"


@register("judge_requests_comparison", ("v_docs",), f"""WITH {X.PARTS}, {_TEXTS},
base AS (SELECT category, facet, arg_min(text, cast(topic AS bigint)) AS base FROM texts WHERE system = 'en' GROUP BY ALL),
pairs AS (SELECT t.category, t.category AS topic, t.topic || '/' || t.system AS system, t.facet, t.text, b.base FROM texts t JOIN base b ON b.category = t.category AND b.facet = t.facet),
p AS (SELECT *, {_SWAP} AS swapped FROM pairs),
q AS (SELECT *, {filled(J.TEMPLATES['comparison'], position_1='CASE WHEN swapped THEN base ELSE text END', position_2='CASE WHEN swapped THEN text ELSE base END')} AS prompt FROM p)
SELECT {K}, facet, swapped, {_digest_sql('prompt')} FROM q""")
def judge_requests_comparison(t):
    texts = _texts(t)
    base = texts.filter(F.col("system") == "en").groupBy("category", "facet").agg(
        F.min_by("text", F.col("topic").cast("bigint")).alias("text")
    )
    # every document of a source competes with that source's first English one
    others = texts.select(
        "category", F.col("category").alias("topic"), F.concat_ws("/", "topic", "system").alias("system"), "facet", "text"
    )
    out = J.comparison_requests(others, base.withColumn("topic", F.col("category")))
    return _digest(out, *KEYS, "facet", "swapped")


@register("judge_apply", ("v_docs",), f"""WITH {X.PARTS}, {_TEXTS},
p AS (SELECT {K}, criterion, strpos('0123456789abcdef', substring(md5({filled(J.TEMPLATES['criterion'])}), 1, 1)) - 1 AS digit FROM texts JOIN rubric USING (facet))
SELECT {K}, criterion, 'score' AS metric, 1.0e0 + digit % 5 AS value FROM p""")
def judge_apply(t):
    answers = J.judge_apply(J.criterion_requests(_texts(t)))
    return J.judge_scores(J.judge_parse(answers), ["score"])


_PARSED = """
r AS (SELECT *, CASE WHEN json_valid(raw) THEN raw ELSE regexp_extract(raw, '(?s)(\\{.*\\})', 1) END AS j FROM v_responses),
f AS (SELECT *, json_valid(j) AND j <> '' AS ok FROM r)
"""


@register("judge_parse", ("v_responses",), f"""WITH {_PARSED}
SELECT doc_id, category, system, ok AS parsed, CASE WHEN ok THEN json_extract_string(j, '$.total') END AS total, CASE WHEN ok THEN json_extract_string(j, '$.supported') END AS supported FROM f""")
def judge_parse(t):
    parsed = J.judge_parse(t.v_responses.select("doc_id", "category", "system", "raw"))
    field = lambda name: F.try_element_at("fields", F.lit(name)).alias(name)
    return parsed.select("doc_id", "category", "system", "parsed", field("total"), field("supported"))


# JSON, a Python literal, nested JSON, a literal with constants and closing commas; the whole text is an item of each
@register("judge_parse_list", (), """
WITH e AS (SELECT doc_id, doc_id % 4 AS kind, lang, source, text, to_json(text) AS j FROM documents),
i AS (SELECT doc_id, CASE kind WHEN 0 THEN [lang, source, text] WHEN 1 THEN [lang, source, text]
 WHEN 2 THEN ['[1,"' || lang || '"]', '[2,"' || source || '"]', '[3,' || j || ']'] ELSE ['true', NULL, lang || ' True, None,]', text, '[1,false]'] END AS items FROM e)
SELECT doc_id, generate_subscripts(items, 1) - 1 AS item_no, unnest(items) AS item FROM i""")
def judge_parse_list(t):
    docs, kind, text = t.documents, F.col("doc_id") % 4, F.to_json(F.array("text"))
    body = F.substring(text, F.lit(2), F.length(text) - 2)  # the text as a JSON string
    raw = (
        F.when(kind == 0, F.concat(F.lit('["'), "lang", F.lit('", "'), "source", F.lit('", '), body, F.lit("]")))
        .when(kind == 1, F.concat(F.lit("Here: ['"), "lang", F.lit("', '"), "source", F.lit("', "), body, F.lit("] ok")))
        .when(kind == 2, F.concat(F.lit('[[1, "'), "lang", F.lit('"], [2, "'), "source", F.lit('"], [3, '), body, F.lit("]]")))
        .otherwise(F.concat(F.lit("[True, None, '"), "lang", F.lit(" True, None,]', "), body, F.lit(", [1, False,],]")))
    )
    return J.judge_parse_list(docs.select("doc_id", raw.alias("raw")))


@register("judge_scores", ("v_responses",), f"""WITH {_PARSED}
SELECT doc_id, category, system, m.metric, coalesce(CASE WHEN ok THEN try_cast(json_extract_string(j, '$.' || m.metric) AS double) END, 0) AS value
FROM f, (VALUES ('total'), ('supported'), ('absent')) m(metric)""")
def judge_scores(t):
    parsed = J.judge_parse(t.v_responses.select("doc_id", "category", "system", "raw"))
    return J.judge_scores(parsed, ["total", "supported", "absent"])


_D = "category, topic, system, model"
_FACETS = " UNION ALL ".join(f"SELECT '{f}' AS facet, '{m}' AS metric" for f, ms in FACET_METRICS.items() for m in ms)


@register("pending_work", ("v_scores",), f"""WITH fm AS ({_FACETS}),
expected AS (SELECT DISTINCT {_D} FROM v_scores)
SELECT DISTINCT e.category, e.topic, e.system, e.model, fm.facet FROM expected e, fm
WHERE NOT EXISTS (SELECT 1 FROM v_scores s WHERE s.category = e.category AND s.topic = e.topic AND s.system = e.system AND s.model = e.model AND s.metric = fm.metric AND s.value <> 0)""")
def pending_work(t):
    # zeros count as not done yet, which leaves work of every kind
    return J.pending_work(t.v_scores.select(*KEYS, "model").distinct(), t.v_scores.filter(F.col("value") != 0))


_CONTENT = ", ".join(f"'{c}'" for c in CONTENT_CRITERIA)


@register("missing_scores", ("v_scores",), f"""
SELECT {_D}, 'Content' AS work FROM v_scores GROUP BY {_D} HAVING count(*) FILTER (WHERE metric IN ({_CONTENT}) AND value <> 0) < 5
UNION ALL SELECT {_D}, metric FROM v_scores WHERE metric IN ('Outline', 'Reference', 'Outline_structure', 'Reference_quality') AND value = 0""")
def missing_scores(t):
    return J.missing_scores(t.v_scores)


_NEW = f"""
new AS (SELECT {_D}, metric, 3.0 AS value FROM v_scores WHERE value = 0
 UNION ALL SELECT {_D}, 'Extra', max(value) FROM v_scores GROUP BY {_D}
 UNION ALL SELECT {_D}, metric, value / 2 FROM v_scores WHERE metric = 'Outline' AND value <> 0)
"""


def _merge_sql(value: str) -> str:
    return f"WITH {_NEW} SELECT {_D}, metric, {hu(value, 6)} AS value FROM v_scores o FULL JOIN new n USING ({_D}, metric)"


def _new_scores(t):
    scores = t.v_scores
    key = [*KEYS, "model"]
    zero = scores.filter(F.col("value") == 0).withColumn("value", F.lit(3.0))
    extra = scores.groupBy(*key).agg(F.max("value").alias("value")).withColumn("metric", F.lit("Extra"))
    half = scores.filter((F.col("metric") == "Outline") & (F.col("value") != 0)).withColumn("value", F.col("value") / 2)
    return zero.unionByName(extra).unionByName(half)


@register("merge_scores", ("v_scores",), _merge_sql("coalesce(n.value, o.value)"))
def merge_scores(t):
    return J.merge_scores(t.v_scores, _new_scores(t)).withColumn("value", F.round("value", 6))


@register("merge_scores_zeros", ("v_scores",), _merge_sql("CASE WHEN o.value <> 0 THEN o.value ELSE coalesce(n.value, o.value) END"))
def merge_scores_zeros(t):
    return J.merge_scores(t.v_scores, _new_scores(t), zeros_only=True).withColumn("value", F.round("value", 6))


@register("clear_scores", ("v_scores",), "SELECT * FROM v_scores WHERE NOT (system = 'click' AND model = 'm0' AND metric IN ('Outline', 'Coverage'))")
def clear_scores(t):
    return J.clear_scores(t.v_scores, system="click", model="m0", metrics=["Outline", "Coverage"])


@register("drop_systems", ("v_scores",), "SELECT * FROM v_scores WHERE system NOT IN ('click', 'error')")
def drop_systems(t):
    return J.drop_systems(t.v_scores, ["click", "error"])


# claims: every piece of a turn between periods, with a number of its own
PIECES = f"""
pieces AS (SELECT doc, sent_no, sentence, generate_subscripts(s, 1) - 1 AS n, unnest(s) AS piece FROM (SELECT *, string_split(text, '.') AS s FROM v_turns) x),
claims AS (SELECT doc, sent_no, n + sent_no * 100000 AS claim_no, sentence,
 'Claim ' || n || ': ' || {X.trim_sql('piece')} || ' ' || ((doc + n) % 4) || CASE WHEN n % 5 = 0 THEN ' 77' ELSE '' END AS claim FROM pieces WHERE {X.trim_sql('piece')} <> '')
"""


def _claims(t):
    turns = t.v_turns.select("doc", "sent_no", "sentence", F.posexplode(F.split("text", r"\.", -1)).alias("n", "piece"))
    piece = L.strip(F.col("piece"))
    foreign = F.when(F.col("n") % 5 == 0, F.lit(" 77")).otherwise(F.lit(""))
    claim = F.concat(
        F.lit("Claim "), F.col("n").cast("string"), F.lit(": "), piece, F.lit(" "),
        ((F.col("doc") + F.col("n")) % 4).cast("string"), foreign,
    )
    return turns.filter(piece != "").select(
        "doc", "sent_no", (F.col("n") + F.col("sent_no") * 100000).alias("claim_no"), "sentence", claim.alias("claim")
    )


_LABEL = "'^Claim \\d+: '"


@register("claims_parse", ("v_claim_texts",), f"""WITH
f AS (SELECT doc, regexp_extract_all(raw, '\\d+\\.{WS}*([^\\n]+)', 1) AS c FROM v_claim_texts),
u AS (SELECT doc, len(c) AS n, generate_subscripts(c, 1) - 1 AS claim_no, unnest(c) AS claim FROM f)
SELECT doc, claim_no, regexp_replace(CASE WHEN claim_no = n - 1 AND right(claim, 1) <> '.' THEN claim || '.' ELSE claim END, {_LABEL}, '') AS claim FROM u""")
def claims_parse(t):
    return L.claims_parse(t.v_claim_texts, ["doc"])


def _norm_sql(claim: str) -> str:
    punct = r"""[!-/:-@\[-`{-~]"""
    bare = f"regexp_replace(lower({claim}), '{punct}', '', 'g')"
    article = rf"(^|{X.NW})(a|an|the)($|{X.NW})"
    twice = f"regexp_replace(regexp_replace({bare}, '{article}', '\\1 \\3', 'g'), '{article}', '\\1 \\3', 'g')"
    return f"{X.trim_sql(f'''regexp_replace({twice}, '{WS}+', ' ', 'g')''')}"


@register("claims_dedup", ("v_turns",), f"""WITH {PIECES},
n AS (SELECT *, {_norm_sql("regexp_replace(claim, '^Claim \\d+: ', '')")} AS norm, regexp_replace(claim, {_LABEL}, '') AS bare FROM claims)
SELECT doc, min(claim_no) AS claim_no, arg_min(bare, claim_no) AS claim, count(*) AS copies FROM n GROUP BY doc, norm""")
def claims_dedup(t):
    bare = _claims(t).withColumn("claim", F.regexp_replace("claim", L.CLAIM_LABEL, ""))
    return L.claims_dedup(bare, ["doc"])


# every claim comes again with a word more, which makes long ones near copies
@register("claims_near_dedup", ("v_turns",), f"""WITH {PIECES},
b AS (SELECT doc, claim_no, regexp_replace(claim, {_LABEL}, '') AS bare FROM claims),
n AS (SELECT *, {_norm_sql("bare")} AS norm FROM (SELECT * FROM b UNION ALL SELECT doc, claim_no + 50000, bare || ' indeed' FROM b) x),
f AS (SELECT doc, norm, min(claim_no) AS claim_no, arg_min(bare, claim_no) AS claim, count(*) AS copies, list_filter(list_distinct(string_split(norm, ' ')), lambda x: x <> '') AS w FROM n GROUP BY doc, norm),
p AS (SELECT b.doc, b.norm, len(a.w) AS na, len(b.w) AS nb, len(list_intersect(a.w, b.w)) AS shared FROM f a JOIN f b ON a.doc = b.doc AND (a.claim_no, a.norm) < (b.claim_no, b.norm))
SELECT doc, claim_no, claim, copies FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc = f.doc AND p.norm = f.norm AND shared > 0 AND 100 * shared >= 80 * (na + nb - shared))""")
def claims_near_dedup(t):
    bare = _claims(t).select("doc", "claim_no", F.regexp_replace("claim", L.CLAIM_LABEL, "").alias("claim"))
    longer = bare.select("doc", (F.col("claim_no") + 50000).alias("claim_no"), F.concat("claim", F.lit(" indeed")).alias("claim"))
    return L.claims_near_dedup(bare.unionByName(longer), ["doc"])


@register("apply_removals", ("v_turns",), f"""WITH {PIECES},
g AS (SELECT doc, claim_no, claim, claim_no // 300 AS group_no, claim_no % 300 + 1 AS place FROM claims)
SELECT doc, claim_no, claim FROM g WHERE NOT (place = 2 OR place = 1 + doc % 5)""")
def apply_removals(t):
    claims = _claims(t).select("doc", "claim_no", "claim")
    groups = L.removal_groups(claims).select("doc", "group_no").distinct()
    listed = F.concat(F.lit("2, x, "), (1 + F.col("doc") % 5).cast("string"))
    return L.apply_removals(claims, groups.withColumn("raw", listed), ["doc"])


def repeats_by_text(prompt: str) -> str:
    """Offline judge: the numbers of claims whose text an earlier one of the prompt has."""
    body = prompt[prompt.index("\n") : prompt.rindex("\nList the numbers")]
    parts = re.split(r"\n(\d+)\. ", body)[1:]
    seen, out = set(), []
    for number, text in zip(parts[::2], parts[1::2], strict=True):
        if text in seen:
            out.append(number)
        seen.add(text)
    return ", ".join(out)


@register("claims_removed_by_judge", ("v_turns",), f"""WITH {PIECES}
SELECT doc, min(claim_no) AS claim_no, claim FROM claims GROUP BY doc, claim""")
def claims_removed_by_judge(t):
    # small groups, so that they meet in several rounds
    return J.claims_removed_by_judge(_claims(t).select("doc", "claim_no", "claim"), ["doc"], repeats_by_text, size=4)


@register("claim_density", ("v_turns",), f"""WITH {PIECES},
c AS (SELECT doc, count(*) AS before, count(DISTINCT norm) AS after FROM (SELECT doc, {_norm_sql("regexp_replace(claim, '^Claim \\d+: ', '')")} AS norm FROM claims) x GROUP BY doc),
s AS (SELECT doc, sum(len(list_filter(regexp_split_to_array({X.trim_sql('text')}, '[.!?\n]+(?:{WS}|\\z)'), lambda x: x <> ''))) AS sentences FROM v_turns GROUP BY doc)
SELECT coalesce(s.doc, c.doc) AS doc, cast(coalesce(sentences, 0) AS bigint) AS sentences, coalesce(before, 0) AS claims_before,
 CASE WHEN sentences > 0 THEN {hu('coalesce(before, 0) / sentences', 4)} ELSE 0 END AS density_before, coalesce(after, 0) AS claims_after,
 CASE WHEN sentences > 0 THEN {hu('coalesce(after, 0) / sentences', 4)} ELSE 0 END AS density_after,
 CASE WHEN before > 0 THEN {hu('after / before', 4)} ELSE 0 END AS compression_ratio FROM s FULL JOIN c ON s.doc = c.doc""")
def claim_density(t):
    bare = _claims(t).withColumn("claim", F.regexp_replace("claim", L.CLAIM_LABEL, ""))
    counts = t.v_turns.select("doc", D.sentence_count(F.col("text")).alias("sentences"))
    return L.claim_density(bare, counts, ["doc"])


_NUM = f"(?:^|{X.NW})(\\d+)(?:$|{X.NW})"
# digits are kept apart from words first, so that neighbours can share a space
_NUMS = "list_sort(list_distinct(list_filter(regexp_split_to_array({}, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '\\d+'))))".format


@register("numeric_grounding", ("v_turns",), f"""WITH {PIECES},
n AS (SELECT doc, sent_no, claim_no, regexp_replace(claim, {_LABEL}, '') AS claim, {_NUMS('sentence')} AS have, {_NUMS(f"regexp_replace(claim, {_LABEL}, '')")} AS said FROM claims),
w AS (SELECT *, list_filter(said, lambda x: NOT list_contains(have, x)) AS foreign_numbers FROM n),
u AS (SELECT *, list_transform(foreign_numbers, lambda f: list_filter(have, lambda h: starts_with(h, f))[1]) AS targets FROM w),
g AS (SELECT *, len(list_filter(targets, lambda x: x IS NULL)) = 0 AS grounded,
 list_reduce(list_concat([claim], list_transform(list_zip(foreign_numbers, targets), lambda z: z[1] || chr(1) || z[2])), lambda a, b: replace(a, split_part(b, chr(1), 1), split_part(b, chr(1), 2))) AS fixed,
 list_concat(list_filter(said, lambda x: list_contains(have, x)), list_filter(targets, lambda x: x IS NOT NULL)) AS covered FROM u),
k AS (SELECT doc, sent_no, max(len(have)) = len(list_distinct(flatten(list(covered)))) AS complete FROM g GROUP BY doc, sent_no)
SELECT doc, sent_no, min(claim_no) AS claim_no, fixed AS claim, true AS grounded FROM g JOIN k USING (doc, sent_no) WHERE complete AND grounded GROUP BY doc, sent_no, fixed
UNION ALL SELECT doc, sent_no, claim_no, claim, false FROM g JOIN k USING (doc, sent_no) WHERE NOT complete""")
def numeric_grounding(t):
    bare = _claims(t).withColumn("claim", F.regexp_replace("claim", L.CLAIM_LABEL, ""))
    return L.numeric_grounding(bare)
