"""Registered document, outline and citation queries with their oracles.

RE2 has no look-ahead, so oracles put a marker character where the Spark side
splits, and use captured neighbours where it looks around.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgauge.functions.text import NOT_WS, WS, WS_CHARS, WS_RANGES
from corpusgauge.operators import citations as C
from corpusgauge.operators import documents as D
from corpusgauge.operators import outline as O
from corpusgauge.operators import references as P
from corpusgauge.plans.registry import half_up_sql as hu
from corpusgauge.plans.registry import register

NW = r"[^\p{L}\p{N}_]"
K = "category, topic, system"


def trim_sql(expr: str) -> str:
    return f"trim({expr}, '{WS_CHARS}')"


_EXACT = rf"^#{{1,6}}{WS}*References{WS}*$"
_LOOSE = r"^#{1,6}[^\n]*reference"
_NEXT = rf"^#{{1,6}}{WS}+{NOT_WS}+"
_WORD = r"(?:bibliography|references?)"

PARTS = rf"""
tiers AS (SELECT {K}, md, CASE WHEN regexp_matches(md, '(?im){_EXACT}') THEN 1 WHEN regexp_matches(md, '(?im){_LOOSE}') THEN 2
  WHEN regexp_matches(md, '(?m)^\[\d+\]') THEN 3 WHEN regexp_matches(md, '(?i)(?:^|{NW}){_WORD}(?:$|{NW})') THEN 4 ELSE 5 END AS tier FROM v_docs),
cuts AS (SELECT *, CASE tier
  WHEN 1 THEN regexp_extract(md, '(?ims)\A(.*?){_EXACT}(.*)\z', 1) WHEN 2 THEN regexp_extract(md, '(?ims)\A(.*?){_LOOSE}(.*)\z', 1)
  WHEN 3 THEN regexp_extract(md, '(?ms)\A(.*?)^\[\d+\](.*)\z', 1) WHEN 4 THEN regexp_extract(md, '(?is)\A((?:.*{NW})?){_WORD}((?:{NW}.*)?)\z', 1) ELSE md END AS before,
 CASE tier
  WHEN 1 THEN regexp_extract(md, '(?ims)\A(.*?){_EXACT}(.*)\z', 2) WHEN 2 THEN regexp_extract(md, '(?ims)\A(.*?){_LOOSE}(.*)\z', 2)
  WHEN 3 THEN regexp_extract(md, '(?ms)\A(.*?)(^\[\d+\].*)\z', 2) WHEN 4 THEN regexp_extract(md, '(?is)\A((?:.*{NW})?){_WORD}((?:{NW}.*)?)\z', 2) ELSE '' END AS after FROM tiers),
parts AS (SELECT {K}, md, tier,
  CASE WHEN tier IN (3, 5) THEN {trim_sql('before')} ELSE {trim_sql('before')} || chr(10) || {trim_sql(rf"regexp_extract(after, '(?ms){_NEXT}(.*)', 1)")} END AS main_content,
  {trim_sql(rf"CASE WHEN tier IN (3, 5) OR NOT regexp_matches(after, '(?m){_NEXT}') THEN after ELSE regexp_extract(after, '(?ms)\A(.*?){_NEXT}', 1) END")} AS ref_block FROM cuts)
"""

HEADS = rf"""
raw_heads AS (SELECT {K}, unnest(list_filter(string_split(md, chr(10)), lambda l: regexp_matches(l, '^#{{1,6}}{WS}+.'))) AS line,
  generate_subscripts(list_filter(string_split(md, chr(10)), lambda l: regexp_matches(l, '^#{{1,6}}{WS}+.')), 1) - 1 AS pos FROM v_docs),
lv AS (SELECT {K}, pos, length(regexp_extract(line, '^(#{{1,6}})', 1)) AS level, {trim_sql(f"regexp_extract(line, '^#{{1,6}}{WS}+(.+)', 1)")} AS title FROM raw_heads),
heads AS (SELECT {K}, pos, CASE WHEN min(level) OVER w = max(level) OVER w THEN 1 ELSE level END AS level, title FROM lv WINDOW w AS (PARTITION BY {K}))
"""
TREE = f"""
tree AS (SELECT c.{K.replace(', ', ', c.')}, c.pos, c.level, c.title, p.pos AS parent_pos, p.title AS parent_title, p.level AS parent_level,
  max(c.level) OVER (PARTITION BY c.category, c.topic, c.system) AS max_depth
 FROM (SELECT h.*, (SELECT max(e.pos) FROM heads e WHERE e.category = h.category AND e.topic = h.topic AND e.system = h.system
   AND e.pos < h.pos AND e.level < h.level) AS parent_pos FROM heads h) c
 LEFT JOIN heads p ON p.category = c.category AND p.topic = c.topic AND p.system = c.system AND p.pos = c.parent_pos)
"""


def _contents(t):
    return D.split_content_refs(t.v_docs)


@register("split_content_refs", ("v_docs",), f"WITH {PARTS} SELECT {K}, tier, main_content, ref_block FROM parts")
def split_content_refs(t):
    return _contents(t)


@register("outline_extract", ("v_docs",), f"WITH {HEADS} SELECT {K}, cast(pos AS integer) AS pos, cast(level AS integer) AS level, title FROM heads")
def outline_extract(t):
    return O.outline_extract(t.v_docs)


@register("outline_needs_refine", ("v_docs",), f"WITH {HEADS} SELECT {K}, count(*) AS headings FROM heads GROUP BY {K} HAVING max(level) = 1")
def outline_needs_refine(t):
    return O.outline_needs_refine(O.outline_extract(t.v_docs))


@register("outline_tree", ("v_docs",), f"WITH {HEADS}, {TREE} SELECT * FROM tree")
def outline_tree(t):
    return O.outline_tree(O.outline_extract(t.v_docs))


@register("outline_edges", ("v_docs",), f"""WITH {HEADS}, {TREE}
SELECT {K}, parent_pos, parent_title, parent_level, max_depth, count(*) AS children,
 string_agg('  - Index: ' || pos || ', Title: ' || title, chr(10) ORDER BY pos) AS children_list
FROM tree WHERE parent_pos IS NOT NULL GROUP BY ALL""")
def outline_edges(t):
    return O.outline_edges(O.outline_tree(O.outline_extract(t.v_docs)))


# the recursion walks down from each root and carries the titles
PATHS = f"""
tops AS (SELECT {K}, count(*) FILTER (WHERE level = 1) AS tops FROM heads GROUP BY {K}),
rooted AS (SELECT h.{K.replace(', ', ', h.')}, pos, CASE WHEN tops = 1 THEN level ELSE level + 1 END AS level, title FROM heads h JOIN tops USING (category, topic, system)
 UNION ALL SELECT {K}, -1, 1, topic FROM tops WHERE tops <> 1),
par AS (SELECT r.*, (SELECT max(e.pos) FROM rooted e WHERE e.category = r.category AND e.topic = r.topic AND e.system = r.system
  AND e.pos < r.pos AND e.level < r.level) AS parent_pos FROM rooted r),
walk AS (SELECT {K}, pos, [title] AS titles FROM par WHERE parent_pos IS NULL
 UNION ALL SELECT c.category, c.topic, c.system, c.pos, list_append(w.titles, c.title) FROM walk w JOIN par c
 ON c.category = w.category AND c.topic = w.topic AND c.system = w.system AND c.parent_pos = w.pos),
leaves AS (SELECT w.* FROM walk w WHERE len(titles) > 2 AND NOT EXISTS (SELECT 1 FROM par c WHERE c.category = w.category AND c.topic = w.topic AND c.system = w.system AND c.parent_pos = w.pos)),
merged AS (SELECT {K}, titles[:-2] AS parents, min(pos) AS first_pos, array_to_string(titles[:-2], ' > ') || ' > ' || string_agg(titles[-1], ' > ' ORDER BY pos) AS path FROM leaves GROUP BY {K}, titles[:-2]),
paths AS (SELECT {K}, row_number() OVER (PARTITION BY {K} ORDER BY first_pos) - 1 AS path_no, path FROM merged)
"""


@register("outline_paths", ("v_docs",), f"WITH RECURSIVE {HEADS}, {PATHS} SELECT * FROM paths")
def outline_paths(t):
    return O.outline_paths(O.outline_extract(t.v_docs))


_DEEP = "heads AS (SELECT * FROM v_outlines)"


@register("outline_tree_deep", ("v_outlines",), f"WITH {_DEEP}, {TREE} SELECT * FROM tree")
def outline_tree_deep(t):
    return O.outline_tree(t.v_outlines)


@register("outline_paths_deep", ("v_outlines",), f"WITH RECURSIVE {_DEEP}, {PATHS} SELECT * FROM paths")
def outline_paths_deep(t):
    return O.outline_paths(t.v_outlines)


@register("sections_by_hash", ("v_docs",), f"""WITH {PARTS},
s AS (SELECT {K}, string_split(replace(main_content, chr(10) || '#', chr(1) || '#'), chr(1)) AS s FROM parts)
SELECT {K}, generate_subscripts(s, 1) - 1 AS section_no, unnest(s) AS section FROM s""")
def sections_by_hash(t):
    return D.sections_by_hash(_contents(t))


@register("sections_by_heading", ("v_docs",), f"""WITH
s AS (SELECT {K}, list_filter(string_split(regexp_replace(md, '(?m)^(#+{WS})', chr(1) || '\\1', 'g'), chr(1)), lambda x: regexp_matches(x, '\\A#+{WS}')) AS s FROM v_docs)
SELECT {K}, generate_subscripts(s, 1) - 1 AS section_no, unnest(s) AS section FROM s""")
def sections_by_heading(t):
    return D.sections_by_heading(t.v_docs)


_PROSE = r"regexp_replace(regexp_replace(main_content, '!\[[^\n]*?\]\([^\n]*?\)', '', 'g'), '(?s)<html>.*?</html>', '', 'g')"
SENTENCES = rf"""
prose AS (SELECT *, {_PROSE} AS p FROM parts),
packed AS (SELECT {K}, ref_block, regexp_replace(regexp_replace(p, '(?m)^#+{WS}+[^\n]*$', '', 'g'), '\n{{2,}}', chr(10), 'g') AS p FROM prose),
marked AS (SELECT {K}, ref_block, list_filter(list_transform(string_split(regexp_replace(p, '\.({WS}+[A-Z]|\n|[A-Z])', '.' || chr(1) || '\1', 'g'), '.' || chr(1)), lambda x: {trim_sql('x')}), lambda x: x <> '') AS s FROM packed),
sents AS (SELECT {K}, generate_subscripts(s, 1) - 1 AS sent_no, unnest(s) AS sentence FROM marked)
"""


@register("sentences", ("v_docs",), f"WITH {PARTS}, {SENTENCES} SELECT * FROM sents")
def sentences(t):
    return D.sentences(_contents(t))


_COUNTED = rf"len(list_filter(regexp_split_to_array({trim_sql('main_content')}, '[.!?\n]+(?:{WS}|\z)'), lambda x: x <> ''))"


@register("sentence_counts", ("v_docs",), f"""WITH {PARTS}
SELECT category, system, count(*) AS docs, {hu(f'avg({_COUNTED})', 6)} AS mean_sentences FROM parts GROUP BY category, system""")
def sentence_counts(t):
    return D.sentence_counts(_contents(t))


_N = "len(regexp_extract_all({}, '{}'))".format
FEATURES = rf"""
feats AS (SELECT {K}, md,
 len(list_distinct(list_concat(regexp_extract_all(md, '!\[[^\n]*?\]\([^\n]*?\)'), list_concat(regexp_extract_all(md, '(?i)<img [^>]*src=[''"][^\n]*?[''"][^>]*>'), regexp_extract_all(md, '(?i)<img [^>]*>'))))) AS images,
 {_N('md', r'(?s)\$\$.*?\$\$')} + {_N('md', r'(?s)\\\[.*?\\\]')} + {_N('md', r'(?s)\\begin\{.*?\}.*?\\end\{.*?\}')}
  + {_N(r"regexp_replace(md, '\$\$+', chr(2), 'g')", r'\$[^\n$]+\$')} AS equations,
 {_N('md', rf'(?:\|[^\n]*\n)+\|[{WS_RANGES}\-:|]+\|(?:\n\|[^\n]*)*')} + {_N('md', r'(?is)<table.*?</table>')} AS tables,
 {_COUNTED} AS sentences FROM parts),
full_feats AS (SELECT {K}, images, equations, tables, sentences,
 CASE WHEN sentences > 0 THEN {hu('images / sentences', 6)} END AS Images_density, CASE WHEN sentences > 0 THEN {hu('equations / sentences', 6)} END AS Equations_density,
 CASE WHEN sentences > 0 THEN {hu('tables / sentences', 6)} END AS Tables_density FROM feats)
"""


@register("md_features", ("v_docs",), f"WITH {PARTS}, {FEATURES} SELECT * FROM full_feats")
def md_features(t):
    return D.md_features(t.v_docs)


_FEATURE_NAMES = ["images", "equations", "tables", "sentences", "Images_density", "Equations_density", "Tables_density"]


@register("md_feature_means", ("v_docs",), f"WITH {PARTS}, {FEATURES} " + " UNION ALL ".join(
    f"SELECT category, system, '{n}' AS feature, {hu(f'avg({n})', 6)} AS value FROM full_feats GROUP BY category, system" for n in _FEATURE_NAMES))
def md_feature_means(t):
    return D.md_feature_means(D.md_features(t.v_docs))


_YEAR = r"(?:20\d{2}[a-z]?|19\d{2}[a-z]?)"
_YEAR_AT = rf"(?s)\A((?:.*?{NW})??)({_YEAR})(?:{NW}.*)?\z"
ENTRIES = rf"""
std AS (SELECT {K}, regexp_replace(regexp_replace(ref_block, '(?m)^{WS}*(\d+)[.)]{WS}+', '[\1] ', 'g'), '(?m)^{WS}*(\d+){WS}+([A-Z])', '[\1] \2', 'g') AS b FROM parts),
lined AS (SELECT *, list_filter(list_transform(regexp_split_to_array(b, '[\n\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {trim_sql('x')}), lambda x: x <> '') AS l FROM std),
ents AS (SELECT {K}, CASE WHEN b <> '' AND len(list_filter(l, lambda x: x[1] = '[')) >= len(l) // 2
  THEN list_filter(list_transform(string_split(regexp_replace(b, '(?m)^(\[[^\n]*?\])', chr(1) || '\1', 'g'), chr(1)), lambda x: {trim_sql('x')}), lambda x: x <> '') ELSE l END AS e FROM lined),
entry AS (SELECT {K}, generate_subscripts(e, 1) - 1 AS ref_pos, unnest(e) AS entry FROM ents),
dated AS (SELECT *, regexp_matches(entry, '(?s)\A\[(.+?)\]') AS br, regexp_matches(entry, '(?:^|{NW}){_YEAR}(?:$|{NW})') AS has_year FROM entry),
named AS (SELECT *, CASE WHEN has_year THEN regexp_extract(entry, '{_YEAR_AT}', 2) ELSE '????' END AS year,
 list_filter(list_transform(string_split(replace({trim_sql(f"CASE WHEN has_year THEN regexp_extract(entry, '{_YEAR_AT}', 1) ELSE split_part(entry, '.', 1) END")}, ' and ', ', '), ','), lambda x: {trim_sql('x')}), lambda x: x <> '') AS names FROM dated),
sur AS (SELECT *, list_transform(names, lambda x: trim(regexp_split_to_array(x, '{WS}+')[-1], '.')) AS s FROM named),
refs AS (SELECT {K}, ref_pos,
 CASE WHEN br THEN {trim_sql(r"regexp_extract(entry, '(?s)\A\[(.+?)\]', 1)")}
  ELSE {trim_sql("trim(CASE WHEN len(s) >= 3 THEN s[1] || ' et al.' WHEN len(s) = 2 THEN s[1] || ' and ' || s[2] WHEN len(s) = 1 THEN s[1] ELSE 'Unknown' END || ', ' || year, '[]')")} END AS ref_id,
 CASE WHEN br THEN {trim_sql(r"regexp_extract(entry, '(?s)\A\[(.+?)\](.*)\z', 2)")} ELSE entry END AS ref_text, entry FROM sur)
"""


@register("reference_entries", ("v_docs",), f"WITH {PARTS}, {ENTRIES} SELECT * FROM refs")
def reference_entries(t):
    return P.reference_entries(_contents(t))


@register("ref_batches", ("v_docs",), f"""WITH {PARTS}, {ENTRIES}
SELECT {K}, ref_pos // 4 AS batch_no, count(*) AS entries, string_agg(entry, chr(10) ORDER BY ref_pos) AS batch FROM refs GROUP BY {K}, ref_pos // 4""")
def ref_batches(t):
    return P.ref_batches(_contents(t), size=4)


@register("ref_number_runs", ("v_docs",), f"""WITH {PARTS}, {ENTRIES},
n AS (SELECT DISTINCT {K}, cast(ref_id AS decimal(38,0)) AS n FROM refs WHERE regexp_full_match(ref_id, '0*[0-9]{{1,37}}')),
g AS (SELECT {K}, n, n - row_number() OVER (PARTITION BY {K} ORDER BY n) AS island FROM n)
SELECT {K}, min(n) AS first, max(n) AS last, min(n) = 1 AS from_one FROM g GROUP BY {K}, island""")
def ref_number_runs(t):
    return P.ref_number_runs(P.reference_entries(_contents(t)))


_NUMERIC = rf"\A\[\d+(?:[{WS_RANGES},\-–，]*\d+)*\]\z"
_AUTHOR = rf"[A-Za-z][^\n]*?\d{{4}}|\[{WS}*[A-Za-z]{{2,}}[0-9]{{2,}}[a-z]?{WS}*\]"
SPANS = rf"spans AS (SELECT {K}, sent_no, generate_subscripts(regexp_extract_all(sentence, '\[[^\]]+\]'), 1) - 1 AS span_no, unnest(regexp_extract_all(sentence, '\[[^\]]+\]')) AS span FROM sents)"


@register("citation_spans", ("v_docs",), f"""WITH {PARTS}, {SENTENCES}, {SPANS}
SELECT *, CASE WHEN regexp_matches(span, '{_NUMERIC}') THEN 'numeric' WHEN regexp_matches(span, '{_AUTHOR}') THEN 'author_year' ELSE 'other' END AS kind FROM spans""")
def citation_spans(t):
    return C.citation_spans(D.sentences(_contents(t)))


_RANGE = rf"\[(\d+)\]{WS}*[\-–]{WS}*\[(\d+)\]"


def _intervals(source: str, cols: str, strict: bool = False) -> str:
    rest = f"regexp_replace(sentence, '{_RANGE}', '', 'g')"
    lists = "" if strict else rf"""
 UNION ALL SELECT {cols}, cast(regexp_extract(p, '^(\d+)', 1) AS bigint) AS low, cast(CASE WHEN regexp_full_match(p, '\d+') THEN p ELSE regexp_extract(p, '^\d+[\-–](\d+)', 1) END AS bigint) AS high
  FROM (SELECT {cols}, {trim_sql("unnest(regexp_split_to_array(trim(span, '[]'), '[,，]'))")} AS p
   FROM (SELECT {cols}, unnest(list_filter(regexp_extract_all({rest}, '\[[^\]]+\]'), lambda x: regexp_matches(x, '{_NUMERIC}') AND NOT regexp_full_match(x, '\[\d+\]'))) AS span FROM {source}) a) b
  WHERE regexp_full_match(p, '\d+') OR regexp_matches(p, '^\d+[\-–]\d+')"""
    return rf"""
 SELECT {cols}, cast(regexp_extract(r, '{_RANGE}', 1) AS bigint) AS low, cast(regexp_extract(r, '{_RANGE}', 2) AS bigint) AS high
  FROM (SELECT {cols}, unnest(regexp_extract_all(sentence, '{_RANGE}')) AS r FROM {source}) a
 UNION ALL SELECT {cols}, cast(n AS bigint) AS low, cast(n AS bigint) AS high FROM (SELECT {cols}, unnest(regexp_extract_all({rest}, '\[(\d+)\]', 1)) AS n FROM {source}) a
 {lists}"""


def _numeric_oracle(strict: bool) -> str:
    return f"""WITH {PARTS}, {SENTENCES}, iv AS ({_intervals('sents', f'{K}, sent_no', strict)})
SELECT DISTINCT {K}, sent_no, unnest(generate_series(low, high)) AS ref_no FROM iv WHERE low <= high"""


@register("numeric_citations", ("v_docs",), _numeric_oracle(False))
def numeric_citations(t):
    return C.numeric_citations(D.sentences(_contents(t)))


@register("numeric_citations_strict", ("v_docs",), _numeric_oracle(True))
def numeric_citations_strict(t):
    return C.numeric_citations(D.sentences(_contents(t)), strict=True)


LOOKUP = f"""
lookup AS (SELECT {K}, ref_id, arg_max(ref_text, ref_pos) AS ref_text, min(ref_pos) AS ref_at FROM refs GROUP BY {K}, ref_id)
"""
RESOLVED = rf"""
sq AS (SELECT {K}, sent_no, regexp_replace(sentence, '\(([A-Z][^()]+, \d{{4}}[a-z]?)\)', '[\1]', 'g') AS sentence FROM sents),
iv AS ({_intervals('sq', f'{K}, sent_no')}),
by_no AS (SELECT DISTINCT iv.category, iv.topic, iv.system, iv.sent_no, 0 AS kind, cast(l.ref_id AS bigint) AS ord, '[' || l.ref_id || '] ' || l.ref_text AS hit
 FROM iv JOIN lookup l ON l.category = iv.category AND l.topic = iv.topic AND l.system = iv.system AND regexp_full_match(l.ref_id, '0|[1-9]\d{{0,17}}') AND try_cast(l.ref_id AS bigint) BETWEEN low AND high WHERE l.ref_text <> ''),
nm AS (SELECT {K}, sent_no, generate_subscripts(x, 1) AS ord, unnest(x) AS x FROM (SELECT *, regexp_extract_all(sentence, '[A-Z][A-Za-z\-]+(?: et al\.)?{WS}*\((?:20\d{{2}}[a-z]?|19\d{{2}}[a-z]?)\)') AS x FROM sq) a),
nk AS (SELECT {K}, sent_no, ord, regexp_extract(x, '^([A-Z][A-Za-z\-]+(?: et al\.)?)', 1) || ', ' || regexp_extract(x, '\((.*)\)', 1) AS k FROM nm),
nk2 AS (SELECT {K}, sent_no, ord * 2 AS ord, k FROM nk UNION ALL SELECT {K}, sent_no, ord * 2 + 1, replace(k, 'et al.', 'et al') FROM nk WHERE k LIKE '%et al.%'),
by_name AS (SELECT n.category, n.topic, n.system, n.sent_no, 1 AS kind, n.ord, '[' || l.ref_id || '] ' || l.ref_text AS hit FROM nk2 n JOIN lookup l
 ON l.category = n.category AND l.topic = n.topic AND l.system = n.system AND l.ref_id = n.k WHERE l.ref_text <> ''),
ay AS (SELECT {K}, sent_no, generate_subscripts(x, 1) AS ord, unnest(x) AS k FROM (SELECT {K}, sent_no,
  list_filter(list_transform(flatten(list_transform(list_filter(regexp_extract_all(sentence, '\[[^\]]+\]'), lambda s: regexp_matches(s, '{_AUTHOR}')), lambda s: string_split(trim(s, '[]'), ';'))), lambda s: {trim_sql('s')}), lambda s: s <> '') AS x FROM sq) a),
by_key AS (SELECT a.category, a.topic, a.system, a.sent_no, 2 AS kind, a.ord, '[' || l.ref_id || '] ' || l.ref_text AS hit FROM ay a JOIN lookup l
 ON l.category = a.category AND l.topic = a.topic AND l.system = a.system AND l.ref_id = a.k WHERE l.ref_text <> ''),
allhits AS (SELECT {K}, sent_no, hit, min(kind * 10000000000 + ord) AS o FROM (SELECT * FROM by_no UNION ALL SELECT * FROM by_name UNION ALL SELECT * FROM by_key) u GROUP BY {K}, sent_no, hit),
cited AS (SELECT h.category, h.topic, h.system, h.sent_no, q.sentence, string_agg(hit, ';' ORDER BY o) AS refs FROM allhits h JOIN sq q USING (category, topic, system, sent_no)
 GROUP BY h.category, h.topic, h.system, h.sent_no, q.sentence)
"""


@register("cite_resolve", ("v_docs",), f"""WITH {PARTS}, {SENTENCES}, {ENTRIES}, {LOOKUP}, {RESOLVED}
SELECT {K}, sent_no, sentence, refs AS references_text FROM cited""")
def cite_resolve(t):
    return C.cite_resolve(_contents(t)).select(
        "category", "topic", "system", "sent_no", "sentence", F.array_join("references", ";").alias("references_text")
    )


@register("write_citations", ("v_docs",), f"""WITH {PARTS}, {SENTENCES}, {ENTRIES}, {LOOKUP}, {RESOLVED}
SELECT {K}, sentence, arg_max(refs, sent_no) AS references FROM cited GROUP BY {K}, sentence""")
def write_citations(t):
    return C.write_citations(C.cite_resolve(_contents(t)))


LOOSE = rf"""
loose_text AS (SELECT {K}, {trim_sql(r"CASE WHEN regexp_matches(p, '(?im)^[^\n]*#[^\n]*introduction') THEN regexp_extract(p, '(?ims)^([^\n]*#[^\n]*introduction.*)\z', 1) ELSE p END")} AS p FROM prose),
loose_split AS (SELECT {K}, list_filter(list_transform(string_split(regexp_replace(p, '\.({WS}+[A-Z]|\n|[A-Z])', '.' || chr(1) || '\1', 'g'), '.' || chr(1)), lambda x: {trim_sql('x')}), lambda x: x <> '') AS s FROM loose_text),
loose AS (SELECT {K}, generate_subscripts(s, 1) - 1 AS sent_no, unnest(s) AS sentence FROM loose_split)
"""


# a letter after a number marks it as standing alone; twice, as neighbours share a character
_MARK = "ꙮ"
_ALONE = r"(^|[^0-9])([0-9]{1,3})($|[^\p{L}\p{N}_])"
_BARE = rf"[0-9]{{1,3}}{_MARK}(?:{WS}*[–-]{WS}*[0-9]{{1,3}}{_MARK})?"
BARE = rf"""
nohit AS (SELECT l.* FROM loose l WHERE NOT EXISTS (SELECT 1 FROM cited c WHERE c.category = l.category AND c.topic = l.topic AND c.system = l.system)),
tok AS (SELECT {K}, sent_no, generate_subscripts(ts, 1) AS i, unnest(ts) AS t FROM (SELECT {K}, sent_no,
  regexp_extract_all(regexp_replace(regexp_replace(sentence, '{_ALONE}', '\1\2{_MARK}\3', 'g'), '{_ALONE}', '\1\2{_MARK}\3', 'g'), '{_BARE}') AS ts FROM nohit) x),
ends AS (SELECT {K}, sent_no, i, cast(regexp_extract(t, '^([0-9]+)', 1) AS bigint) AS low, cast(regexp_extract(t, '([0-9]+){_MARK}$', 1) AS bigint) AS high FROM tok),
bare_iv AS (SELECT {K}, sent_no, i, 0 AS j, low, high FROM ends WHERE low <= high
 UNION ALL SELECT {K}, sent_no, i, 0, low, low FROM ends WHERE low > high UNION ALL SELECT {K}, sent_no, i, 1, high, high FROM ends WHERE low > high),
kept AS (SELECT * FROM bare_iv t WHERE low < high OR NOT EXISTS (SELECT 1 FROM bare_iv r WHERE r.category = t.category AND r.topic = t.topic AND r.system = t.system
  AND r.sent_no = t.sent_no AND r.low < r.high AND t.low BETWEEN r.low AND r.high)),
folded AS (SELECT {K}, list_reduce(list_concat([[cast(0 AS bigint)]], list([low, high, cast(sent_no AS bigint)] ORDER BY sent_no, i, j)),
  lambda a, x: CASE WHEN x[2] <= a[1] + 1 THEN list_concat([greatest(a[1], x[2])], list_concat(a[2:], x)) ELSE a END) AS f FROM kept GROUP BY {K}),
accepted AS (SELECT {K}, n, f[3 * n + 2] AS low, f[3 * n + 3] AS high, f[3 * n + 4] AS sent_no FROM (SELECT {K}, f, unnest(range((len(f) - 1) // 3)) AS n FROM folded) x),
bare_hits AS (SELECT a.category, a.topic, a.system, a.sent_no, l.ref_id, l.ref_text, min(a.n * 10000 + cast(l.ref_id AS bigint)) AS o FROM accepted a
 JOIN lookup l ON l.category = a.category AND l.topic = a.topic AND l.system = a.system AND regexp_full_match(l.ref_id, '0|[1-9]\d{{0,17}}') AND try_cast(l.ref_id AS bigint) BETWEEN a.low AND a.high
 WHERE l.ref_text <> '' GROUP BY ALL),
by_bare AS (SELECT h.category, h.topic, h.system, l.sent_no, l.sentence, string_agg('[' || ref_id || '] ' || ref_text, ';' ORDER BY o) AS refs FROM bare_hits h JOIN loose l USING (category, topic, system, sent_no) GROUP BY ALL)
"""
_ALL_PARTS = f"{PARTS}, {SENTENCES}, {ENTRIES}, {LOOKUP}, {RESOLVED}, {LOOSE}, {BARE}"


@register("cite_fallback_numbers", ("v_docs",), f"WITH {_ALL_PARTS} SELECT {K}, sent_no, sentence, refs AS references FROM by_bare")
def cite_fallback_numbers(t):
    out = C.cite_fallback_numbers(_contents(t))
    return out.withColumn("references", F.array_join("references", ";"))


_SURNAME_HIT = r"regexp_matches(r.ref_id, '^\[?[A-Z]') AND r.ref_text <> '' AND contains(l.sentence, regexp_extract(r.ref_id, '^\[?([A-Z][A-Za-z\-]*)', 1))"


@register("cite_fallback_surnames", ("v_docs",), f"""WITH {PARTS}, {SENTENCES}, {ENTRIES}, {LOOKUP}, {LOOSE}
SELECT l.category, l.topic, l.system, l.sent_no, l.sentence, string_agg(r.ref_id || ' ' || r.ref_text, ';' ORDER BY r.ref_at) AS references_text
FROM loose l JOIN lookup r ON r.category = l.category AND r.topic = l.topic AND r.system = l.system
WHERE {_SURNAME_HIT}
GROUP BY l.category, l.topic, l.system, l.sent_no, l.sentence""")
def cite_fallback_surnames(t):
    out = C.cite_fallback_surnames(_contents(t))
    return out.select("category", "topic", "system", "sent_no", "sentence", F.array_join("references", ";").alias("references_text"))


_NOT_IN = "NOT EXISTS (SELECT 1 FROM {0} c WHERE c.category = l.category AND c.topic = l.topic AND c.system = l.system)".format


@register("citations", ("v_docs",), f"""WITH {_ALL_PARTS}
SELECT {K}, 1 AS stage, sent_no, sentence, refs AS references FROM cited
UNION ALL SELECT {K}, 2, sent_no, sentence, refs FROM by_bare
UNION ALL SELECT l.category, l.topic, l.system, 3, l.sent_no, l.sentence, string_agg(r.ref_id || ' ' || r.ref_text, ';' ORDER BY r.ref_at)
FROM loose l JOIN lookup r ON r.category = l.category AND r.topic = l.topic AND r.system = l.system
WHERE {_SURNAME_HIT} AND {_NOT_IN('cited')} AND {_NOT_IN('by_bare')} GROUP BY ALL""")
def citations(t):
    return C.citations(_contents(t)).withColumn("references", F.array_join("references", ";"))
