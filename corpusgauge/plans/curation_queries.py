"""Registered curation, word and similarity queries with their oracles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from corpusgauge.functions.numbers import half_up
from corpusgauge.functions.text import WS, WS_RANGES
from corpusgauge.operators import curation as Q
from corpusgauge.operators import judging as J
from corpusgauge.operators import outline as O
from corpusgauge.operators import similarity as S
from corpusgauge.operators import words as W
from corpusgauge.plans.registry import half_up_sql as hu
from corpusgauge.plans.registry import register
from corpusgauge.plans.text_queries import HEADS, K
from corpusgauge.schema import TOP_ITEMS

_GOOD = " OR ".join(f"contains({{0}}, '{p}')" for p in Q.GOOD_PHRASES)
_BAD = " OR ".join(f"contains(lower(title), '{p}')" for p in Q.BAD_PHRASES)
SURVEYS = f"surveys AS (SELECT * FROM v_papers WHERE NOT ({_BAD}) AND ({_GOOD.format('lower(title)')} OR {_GOOD.format('lower(summary)')}))"
COARSE = "CASE WHEN fine_category LIKE 'cs.%' THEN 'cs' WHEN fine_category LIKE 'math.%' THEN 'math' WHEN fine_category LIKE 'econ.%' THEN 'econ' WHEN fine_category LIKE 'stat.%' THEN 'stat' END"
NOW = dt.datetime(2001, 12, 1)
START, END = Q.time_bounds(NOW)


@register("survey_title_filter", ("v_papers",), f"WITH {SURVEYS} SELECT arxiv_id, listing_no, title FROM surveys")
def survey_title_filter(t):
    return Q.survey_title_filter(t.v_papers).select("arxiv_id", "listing_no", "title")


@register("category_rollup", ("v_papers",), f"SELECT category, count(*) AS papers, count(DISTINCT arxiv_id) AS ids FROM (SELECT {COARSE} AS category, arxiv_id FROM v_papers) p GROUP BY category")
def category_rollup(t):
    return Q.category_rollup(t.v_papers).groupBy("category").agg(
        F.count("*").alias("papers"), F.count_distinct("arxiv_id").alias("ids")
    )


@register("paper_ids", ("v_papers",), "SELECT listing_no, concat('http://arxiv.org/abs/', arxiv_id, 'v', listing_no % 3 + 1) AS url, arxiv_id FROM v_papers")
def paper_ids(t):
    url = F.concat(F.lit("http://arxiv.org/abs/"), "arxiv_id", F.lit("v"), (F.col("listing_no") % 3 + 1).cast("string"))
    return Q.paper_ids(t.v_papers.select("listing_no", url.alias("url")))


@register("papers_in_window", ("v_papers",), f"""WITH {SURVEYS},
r AS (SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY published DESC, title, listing_no) AS rn FROM surveys
 WHERE published BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}')
SELECT arxiv_id, strftime(published, '%Y-%m-%d') AS published, title FROM r WHERE rn = 1""")
def papers_in_window(t):
    out = Q.papers_in_window(t.v_papers, START, END)
    return out.select("arxiv_id", F.date_format("published", "yyyy-MM-dd").alias("published"), "title")


def _top_cited_oracle(order, num):
    """One CTE per category: free ids, how far back, the ids fetched."""
    parts = [
        SURVEYS,
        f"""win AS (SELECT {COARSE} AS category, *, CASE WHEN published > TIMESTAMP '{END}' THEN NULL WHEN published >= TIMESTAMP '{START}' THEN 0
 ELSE cast(ceil(epoch(TIMESTAMP '{START}' - published) / (365 * 86400.0)) AS integer) END AS w FROM surveys)""",
        "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, arxiv_id ORDER BY w, published DESC, title, listing_no) AS rn FROM win WHERE w < 10) x WHERE rn = 1)",
        "held AS (SELECT DISTINCT category, arxiv_id FROM (SELECT *, " + COARSE + " AS category FROM v_papers) p WHERE citation_count > 495)",
    ]
    blocked = []
    for c in order:
        n = c.replace("-", "_")
        taken = "".join(f" AND arxiv_id NOT IN (SELECT arxiv_id FROM got_{b})" for b in blocked)
        own = ", ".join(f"'{b}'" for b in [*(order[: order.index(c) + 1])])
        parts.append(f"need_{n} AS (SELECT greatest({num} - count(*), 0) AS need FROM held WHERE category = '{c}')")
        parts.append(f"free_{n} AS (SELECT * FROM one WHERE category = '{c}' AND arxiv_id NOT IN (SELECT arxiv_id FROM held WHERE category IN ({own})){taken})")
        parts.append(
            f"reach_{n} AS (SELECT CASE WHEN (SELECT need FROM need_{n}) = 0 THEN -1 ELSE coalesce(min(w) FILTER (WHERE c >= (SELECT need FROM need_{n})), 9) END AS k"
            f" FROM (SELECT g AS w, (SELECT count(*) FROM free_{n} WHERE w <= g) AS c FROM range(10) r(g)) x)"
        )
        parts.append(f"got_{n} AS (SELECT * FROM free_{n} WHERE w <= (SELECT k FROM reach_{n}))")
        blocked.append(n)
    picks = " UNION ALL ".join(
        f"SELECT * FROM (SELECT category, arxiv_id, title, citation_count, row_number() OVER (ORDER BY citation_count DESC, arxiv_id) AS rank FROM got_{b}) x WHERE rank <= (SELECT need FROM need_{b})"
        for b in blocked
    )
    return f"WITH {', '.join(parts)} {picks}"


def _held(t, above: int = 495):
    papers = Q.category_rollup(t.v_papers).filter(F.col("citation_count") > above)
    return papers.select("category", "arxiv_id").distinct()


@register("top_cited", ("v_papers",), _top_cited_oracle([c for c in Q.CATEGORY_PARTS if c in ("cs", "stat", "math", "econ")], 400))
def top_cited(t):
    out = Q.top_cited(t.v_papers, NOW, num=400, held=_held(t))
    return out.select("category", "arxiv_id", "title", "citation_count", "rank")


@register("existing_exclude", ("v_papers",), f"""WITH p AS (SELECT {COARSE} AS category, * FROM v_papers),
one AS (SELECT category, arxiv_id, max(citation_count) AS citation_count FROM p GROUP BY category, arxiv_id),
held AS (SELECT DISTINCT category, arxiv_id FROM p WHERE citation_count > 495),
have AS (SELECT category, count(*) AS n FROM held GROUP BY category),
new AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY citation_count DESC, arxiv_id) AS rank FROM one o
 WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.category = o.category AND h.arxiv_id = o.arxiv_id))
SELECT n.category, arxiv_id, citation_count, rank FROM new n LEFT JOIN have h ON n.category = h.category WHERE rank <= 400 - coalesce(h.n, 0)""")
def existing_exclude(t):
    candidates = Q.category_rollup(t.v_papers).groupBy("category", "arxiv_id").agg(
        F.max("citation_count").alias("citation_count")
    )
    return Q.existing_exclude(candidates, _held(t), num=400)


_CLUSTERS = """
c AS (SELECT concat('topic ', listing_no % 97) AS topic, listing_no AS pos, arxiv_id, title, CASE WHEN published < TIMESTAMP '1998-01-01' THEN 0 ELSE 1 END AS source FROM v_papers)
"""


@register("merge_clusters", ("v_papers",), f"""WITH {_CLUSTERS},
r AS (SELECT *, row_number() OVER (PARTITION BY topic, arxiv_id ORDER BY source, pos) AS rn FROM c)
SELECT topic, arxiv_id, source, pos, title FROM r WHERE rn = 1""")
def merge_clusters(t):
    papers = t.v_papers.select(
        F.concat(F.lit("topic "), (F.col("listing_no") % 97).cast("string")).alias("topic"),
        F.col("listing_no").alias("pos"), "arxiv_id", "title", "published",
    )
    old = F.col("published") < F.lit("1998-01-01 00:00:00").cast("timestamp")
    return Q.merge_clusters(papers.filter(old).drop("published"), papers.filter(~old).drop("published"))


def _label_by_title(prompt: str) -> str:
    """Offline labels: every paper of the batch under its own title."""
    import json

    listed = json.loads(prompt[prompt.index("["): prompt.rindex("]") + 1])
    return "Sure: " + json.dumps({f"{p['title']} ({p['arxiv_id']})": [p] for p in listed})


@register("assign_topics", ("v_papers",), f"""WITH {SURVEYS}, one AS (SELECT {COARSE} AS category, arxiv_id, min(title) AS title FROM surveys GROUP BY ALL)
SELECT category, concat(title, ' (', arxiv_id, ')') AS topic, arxiv_id, title FROM one""")
def assign_topics(t):
    papers = Q.category_rollup(Q.survey_title_filter(t.v_papers)).groupBy("category", "arxiv_id").agg(F.min("title").alias("title"))
    return Q.assign_topics(papers, _label_by_title, buckets=16)


_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in W.stop_words())
_TERMS = ", ".join(f"'{w}'" for w in W.TECHNICAL_TERMS)


def _plain_sql(text: str) -> str:
    code = f"regexp_replace(regexp_replace({text}, '(?s)```.*?```', '', 'g'), '`[^`\\n]*`', '', 'g')"
    url = f"regexp_replace({code}, 'https?://[!$-_a-z]+', '', 'g')"
    mail = f"regexp_replace({url}, '[\\p{{L}}\\p{{N}}_.\\-]+@[\\p{{L}}\\p{{N}}_.\\-]+', '', 'g')"
    return f"regexp_split_to_array(lower(regexp_replace({mail}, '[^\\p{{L}}\\p{{N}}_{WS_RANGES}]', ' ', 'g')), '{WS}+')"


_WORDS = f"""
tok AS (SELECT source AS category, unnest({_plain_sql('text')}) AS word FROM documents),
cnt AS (SELECT category, word, count(*) AS count FROM tok WHERE length(word) >= 3 AND regexp_full_match(word, '[\\p{{L}}\\p{{N}}]+') AND NOT regexp_matches(word, '\\p{{Nd}}')
 AND regexp_matches(word, '[aeiouy]') AND word NOT IN ({_STOPS}) GROUP BY category, word)
"""


@register("word_frequency", (), f"""WITH {_WORDS}, dict AS (SELECT DISTINCT unnest({_plain_sql('text')}) AS word FROM benchmark),
k AS (SELECT * FROM cnt WHERE word IN ({_TERMS}) OR word IN (SELECT word FROM dict))
SELECT category, word, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY count DESC, word) AS rank FROM k) x WHERE rank <= 50""")
def word_frequency(t):
    dictionary = t.benchmark.select(F.explode(W.plain_words(F.col("text"))).alias("word"))
    texts = t.documents.select(F.col("source").alias("category"), "text")
    return W.word_frequency(texts, dictionary, top=50)


@register("word_frequency_open", (), f"""WITH {_WORDS}
SELECT category, word, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY count DESC, word) AS rank FROM cnt) x WHERE rank <= 100""")
def word_frequency_open(t):
    return W.word_frequency(t.documents.select(F.col("source").alias("category"), "text"))


@register("category_vocabulary", ("v_docs",), f"""WITH {HEADS},
h AS (SELECT {K}, string_agg(title, chr(10) ORDER BY pos) AS titles FROM heads WHERE system = 'en' GROUP BY {K}),
x AS (SELECT category, concat_ws(chr(10), md, titles) AS text FROM v_docs LEFT JOIN h USING ({K}) WHERE system = 'en'),
tok AS (SELECT category, unnest({_plain_sql('text')}) AS word FROM x),
cnt AS (SELECT category, word, count(*) AS count FROM tok WHERE length(word) >= 3 AND regexp_full_match(word, '[\\p{{L}}\\p{{N}}]+') AND NOT regexp_matches(word, '\\p{{Nd}}')
 AND regexp_matches(word, '[aeiouy]') AND word NOT IN ({_STOPS}) GROUP BY category, word)
SELECT category, word, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY count DESC, word) AS rank FROM cnt) x WHERE rank <= 100""")
def category_vocabulary(t):
    return W.word_frequency(W.vocabulary_texts(t.v_docs, baseline="en"))


_DIST = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(cast(z[1] AS double) - cast(z[2] AS double), 2)))"
_COS = "1 - list_dot_product(cast(a.embedding AS double[]), cast(b.embedding AS double[])) / sqrt(list_dot_product(cast(a.embedding AS double[]), cast(a.embedding AS double[]))) / sqrt(list_dot_product(cast(b.embedding AS double[]), cast(b.embedding AS double[])))"


def _nn(dist: str) -> str:
    return f"""
nn AS (SELECT a.topic, a.system, a.facet, a.item_no, 1 - min({dist}) AS score FROM v_items a JOIN v_items b
 ON b.system = 's0' AND b.topic = a.topic AND b.facet = a.facet GROUP BY a.topic, a.system, a.facet, a.item_no)
"""


@register("nn_similarity", ("v_items",), f"WITH {_nn(_DIST)} SELECT topic, system, facet, item_no, {hu('score', 6)} AS score FROM nn")
def nn_similarity(t):
    out = S.nn_similarity(t.v_items, baseline="s0", block=64)
    return out.withColumn("score", half_up(F.col("score"), 6))


@register("nn_similarity_cosine", ("v_items",), f"WITH {_nn(_COS)} SELECT topic, system, facet, item_no, {hu('score', 6)} AS score FROM nn")
def nn_similarity_cosine(t):
    out = S.nn_similarity(t.v_items, baseline="s0", metric="cosine")
    return out.withColumn("score", half_up(F.col("score"), 6))


_TOP = "CASE facet " + " ".join(f"WHEN '{f}' THEN {n}" for f, n in TOP_ITEMS.items()) + " END"


@register("topn_mean_similarity", ("v_items",), f"""WITH {_nn(_DIST)},
r AS (SELECT *, row_number() OVER (PARTITION BY topic, system, facet ORDER BY score DESC) AS rn FROM nn)
SELECT topic, system, facet, {hu('avg(score)', 6)} AS mean_score, count(*) AS n FROM r WHERE rn <= {_TOP} GROUP BY topic, system, facet
UNION ALL SELECT d.topic, d.system, f.facet, 0, 0 FROM (SELECT DISTINCT topic, system FROM v_items) d, (VALUES ('outline'), ('content'), ('reference')) f(facet)
WHERE NOT EXISTS (SELECT 1 FROM nn WHERE nn.topic = d.topic AND nn.system = d.system AND nn.facet = f.facet)""")
def topn_mean_similarity(t):
    items = t.v_items
    out = S.topn_mean_similarity(S.nn_similarity(items, baseline="s0"), docs=items)
    return out.select(
        "topic", "system", "facet", half_up(F.col("mean_score"), 6).alias("mean_score"), F.size("scores").cast("bigint").alias("n")
    )


@register("knn_query", ("v_items",), f"""WITH d AS (SELECT a.topic, a.facet, a.item_no, b.item_no AS near_id, {_DIST} AS dist FROM v_items a JOIN v_items b ON b.topic = a.topic AND b.facet = a.facet)
SELECT topic, facet, item_no, rank, near_id, {hu('1 - dist', 6)} AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY topic, facet, item_no ORDER BY round(dist, 12), near_id) AS rank FROM d) x WHERE rank <= 5""")
def knn_query(t):
    items = t.v_items
    return S.knn_query(items, items, k=5, block=64).withColumn("score", half_up(F.col("score"), 6))


@register("sim_stale_facets", ("v_similarity",), "SELECT category, topic, system, facet FROM v_similarity WHERE mean_score = 0")
def sim_stale_facets(t):
    return S.sim_stale_facets(t.v_similarity)
