"""SQL for the queries of the registry: the same results, written for DuckDB."""

from __future__ import annotations

from pagewright.functions.text import WS
from pagewright.operators import detectors as d
from pagewright.operators import structure as st
from pagewright.operators.benchmarks import BANDS, LOWEST_BAND
from pagewright.operators.detectors import PATTERNS
from pagewright.operators.gaps import GAPS, LIBRARY, SEVERITIES
from pagewright.operators.scoring import GRADES, WEIGHTS
from pagewright.operators.validate import URL
from pagewright.sources.tables import AS_OF, ENGINES

NL = "chr(10)"


def q(text: object) -> str:
    """A SQL string."""
    return "'" + str(text).replace("'", "''") + "'"


def rx(pattern: str) -> str:
    """A pattern for RE2, which has no flag for UNIX lines."""
    return q(pattern.replace("(?dm", "(?m").replace("(?diuU)", "(?i)").replace("(?iu)", "(?i)"))


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {rx('(?i)' + pattern)}))"


def counts(text: str, patterns: list[str]) -> str:
    return "(" + " + ".join(count(text, p) for p in patterns) + ")"


def r1(x: str) -> str:
    return f"floor(({x}) * 10 + 0.5) / 10"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {rx(WS)}), lambda w: w <> '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _text(t: str) -> str:
    for pattern, to in ((r"(?m)^```[^\n]*$", "''"), (rf"(?m)^{st.RULE}$", "''"), (r"!\[[^\]\n]*\]\([^)\n]*\)", NL), (r"\[([^\]\n]*)\]\([^)\n]*\)", f"{NL} || '\\1' || {NL}"), (r"(?m)^#{1,6}[ \t]*", "''"), (r"(?m)^ {0,3}(?:[-*+]|[0-9]+\.)[ \t]+", "''"), (r"[*`|]+", NL)):
        t = f"regexp_replace({t}, {rx(pattern)}, {to}, 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({t}, {NL}), lambda x: {strip('x')}), lambda x: x <> ''), ' ')"


def _every(k: int, text: str) -> str:
    return f"CASE WHEN doc_id % {k} = 0 THEN {text} END"


def _lines(*parts: str) -> str:
    return f" || {NL} || ".join(q(p) if p else "''" for p in parts)


ARTICLES = f"""
npages AS (SELECT greatest(count(*), 1) AS n FROM pages),
articles AS (
  SELECT doc_id, url, concat_ws({NL} || {NL}, '# ' || source || ' report',
    {_every(2, "'Updated ' || (doc_id % 25 + 2000) || ', version ' || (doc_id % 9)")},
    {_every(3, _lines('| Item | Value |', '|---|---|', '| A | 1 |', '| B | 2 |', '', 'Item A vs Item B'))},
    {_every(4, q('What is it? How does it work? However it helps.'))},
    {_every(5, _lines('- alpha', '- beta', '- gamma'))},
    {_every(6, _lines('Step 1 begins here', '', '1. one', '2. two', '3. three', '4. four'))},
    {_every(7, _lines('## Frequently Asked Questions', '', '### Why?'))},
    {_every(8, q('According to research from the lab [source](https://example.com/lab)'))},
    {_every(9, q('This is important because it means more'))},
    translate(text, '#|*_[]`', '       ')) AS content, 'markdown' AS format, lang, source
  FROM documents CROSS JOIN npages LEFT JOIN pages ON page_id = doc_id % n)"""


def parsed_of(source: str, name: str = "parsed") -> str:
    """CTEs that parse Markdown rows of `source`."""
    lists = f"list_filter(blocks, lambda b: regexp_matches(b, {rx(st.LIST)}))"
    ordered = f"list_filter(blocks, lambda b: regexp_matches(b, {rx(st.LIST)}) AND regexp_matches(b, {rx(st.ORDERED)}))"
    items = f"len(regexp_extract_all(b, {rx(st.ITEM)}))"
    blank = r"^\n+|\n+$"
    return f"""
{name}_a AS (SELECT *, regexp_replace(content, {rx(st.FENCED)}, {NL} || {NL}, 'g') AS body FROM {source}),
{name}_b AS (SELECT *, list_transform(regexp_split_to_array(body, {rx(st.BLANK)}), lambda b: regexp_replace(b, {rx(blank)}, '', 'g')) AS blocks,
  regexp_extract_all(body, {rx(st.HEADER)}) AS heads, {_text('content')} AS text, len({words('content')}) AS wc FROM {name}_a),
{name} AS (SELECT *, len(heads) AS n_headers, len(list_filter(blocks, lambda b: regexp_matches(b, {rx(st.TABLE)}))) AS n_tables, len({lists}) AS n_lists, len({ordered}) AS n_ordered,
  coalesce(list_sum(list_transform({ordered}, lambda b: {items})), 0) AS ordered_items, len(list_filter(heads, lambda h: contains(h, '?'))) AS asking, lower(text) AS text_lc FROM {name}_b)"""


# HTML as the given pages have it: the references in them, double quotes, lists without lists in them.
A = r'(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"[^>]*>(.*?)</a\s*>'
L = r"(?is)<ul\b.*?</ul\s*>|<ol\b.*?</ol\s*>"
_H = r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>"


def decoded(x: str) -> str:
    for name, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        x = f"replace({x}, {q(name)}, {q(char)})"
    return f"regexp_replace({x}, '&amp($|[^a-zA-Z0-9;])', '&\\1', 'g')"


def html_text(x: str) -> str:
    ends = f"^{WS}|{WS}$"
    return f"array_to_string(list_filter(list_transform(string_split_regex({x}, '(?s)<[^>]*>'), lambda x: regexp_replace({decoded('x')}, {rx(ends)}, '', 'g')), lambda x: x <> ''), ' ')"


_HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>|<!--.*?-->"
_BODY = html_text("regexp_replace(c, '(?is)<head\\b.*?</head\\s*>', '', 'g')")
PAGES = f"""
page_c AS (SELECT page_id AS doc_id, regexp_replace(html, {q(_HIDDEN)}, '', 'g') AS c FROM pages),
page_l AS (SELECT *, regexp_extract_all(c, {q(_H)}) AS heads, list_filter(regexp_extract_all(c, {q(L)}), lambda x: regexp_matches(x, '(?i)<li\\b')) AS lists, {html_text('c')} AS text, len({words(_BODY)}) AS wc FROM page_c),
page_parsed AS (SELECT *, len(heads) AS n_headers, 0 AS n_tables, len(lists) AS n_lists, len(regexp_extract_all(c, {q(A)})) AS n_links, len(list_filter(lists, lambda x: lower(x[2:3]) = 'ol')) AS n_ordered,
  coalesce(list_sum(list_transform(list_filter(lists, lambda x: lower(x[2:3]) = 'ol'), lambda x: len(regexp_extract_all(x, '(?i)<li\\b')))), 0) AS ordered_items, len(list_filter(heads, lambda h: contains(h, '?'))) AS asking, lower(text) AS text_lc FROM page_l)"""


def _rate(n: str, by: int) -> str:
    return f"(CASE WHEN wc > 0 THEN ({n}) / wc::DOUBLE * {by} ELSE 0.0::DOUBLE END)"


def detectors_of(parsed: str, name: str = "found") -> str:
    """A CTE with <pattern>_s and <pattern>_d, score and detected, for each pattern."""
    e, c = _rate("n_tables + n_lists + n_headers", 500), counts("text_lc", d.CITATION_HOOKS)
    asked = "floor((length(text) - length(replace(text, '?', ''))) / 2)::INT"
    nested = f"len(list_filter(string_split(text, {NL}), lambda x: regexp_matches(x, {rx('(?i)' + d.NESTED)})))"
    compare = " OR ".join(f"contains(text_lc, {q(k)})" for k in d.COMPARISON)
    t, f, s, m = counts("text", d.TEMPORAL), counts("text", d.DEFINITIONS), counts("text", d.STEPS), counts("text", d.META)
    section = f"regexp_matches(text, {rx('(?i)' + d.FAQ)})"
    rows = {
        "structured_data": (r1(f"least(20.0::DOUBLE, {e} / 2 * 20)"), f"{e} >= 1"),
        "entity_density": ("0.0::DOUBLE", "false"),
        "citation_hooks": (r1(f"least(10.0::DOUBLE, {_rate(c, 1000)} / 2 * 10)"), f"{c} > 0"),
        "recursive_depth": (f"(least(7.5, {asked} * 1.5) + least(7.5, {nested} * 2.5))::DOUBLE", f"{asked} > 0 OR {nested} > 0"),
        "temporal_anchoring": (f"least(10, {t} * 2)::DOUBLE", f"{t} > 0"),
        "comparison_tables": (f"(least(10, n_tables * 5) + CASE WHEN {compare} THEN 5 ELSE 0 END)::DOUBLE", f"n_tables > 0 OR {compare}"),
        "definitional_precision": (f"least(10, {f} * 2)::DOUBLE", f"{f} > 0"),
        "procedural_clarity": (r1(f"least(3.0::DOUBLE, {s} * 0.5::DOUBLE) + least(2.0::DOUBLE, ordered_items / 5.0::DOUBLE)"), f"{s} > 0 OR n_ordered > 0"),
        "faq_injection": (f"(CASE WHEN {section} THEN 10 ELSE 0 END + least(5, asking))::DOUBLE", f"{section} OR asking > 0"),
        "meta_context": (f"least(10, {m} * 2)::DOUBLE", f"{m} > 0"),
    }
    return f"{name} AS (SELECT *, " + ", ".join(f"{x} AS {p}_s, ({y}) AS {p}_d" for p, (x, y) in rows.items()) + f" FROM {parsed})"


GRADE = "CASE " + " ".join(f"WHEN score >= {a} THEN {q(b)}" for a, b in GRADES) + " ELSE 'F' END"
BAND = "CASE " + " ".join(f"WHEN score >= {a} THEN {b}" for a, b in BANDS) + f" ELSE {LOWEST_BAND} END"


def audits_of(found: str, name: str = "audits") -> str:
    total = r1(" + ".join(f"{p}_s" for p in PATTERNS))
    return f"""
{name}_w AS (SELECT doc_id, w, count(*) AS c, any_value(n) AS n FROM (SELECT doc_id, unnest(ws) AS w, len(ws) AS n FROM (SELECT doc_id, {words('text_lc')} AS ws FROM {found})) WHERE length(w) > 4 GROUP BY 1, 2),
{name}_s AS (SELECT doc_id FROM {name}_w WHERE c > n * 0.05::DOUBLE GROUP BY 1),
{name}_p AS (SELECT *, {total} AS total, CASE WHEN wc > 0 AND (n_tables + n_lists + n_headers) / greatest(wc, 1)::DOUBLE * 1000 > 10 THEN 20 ELSE 0 END AS penalty_density,
  CASE WHEN {found}.doc_id IN (SELECT doc_id FROM {name}_s) THEN 15 ELSE 0 END AS penalty_stuffing, CASE WHEN wc > 1000 AND n_tables = 0 AND n_lists = 0 THEN 15 ELSE 0 END AS penalty_structure FROM {found}),
{name}_f AS (SELECT *, greatest(0.0::DOUBLE, total - penalty_density - penalty_stuffing - penalty_structure) AS score FROM {name}_p),
{name} AS (SELECT *, {GRADE} AS grade, {BAND} AS percentile FROM {name}_f)"""


PARSED = f"WITH {ARTICLES}, {parsed_of('articles')}"
FOUND = f"{PARSED}, {detectors_of('parsed')}"
AUDITS = f"{FOUND}, {audits_of('found')}"
LONG = "scores AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS ord, {q(p)} AS pattern, {p}_s AS score, {WEIGHTS[p]} AS max, {p}_d AS detected FROM audits" for i, p in enumerate(PATTERNS)) + ")"
DIM = "gapdim(pattern, category, severity, sev_rank, description) AS (VALUES " + ", ".join(f"({q(p)}, {q(c)}, {q(s)}, {SEVERITIES[s]}, {q(t)})" for p, (c, s, t) in GAPS.items()) + ")"
GAPROWS = f"{AUDITS}, {LONG}, {DIM}, gaps AS (SELECT doc_id, 'gap_' || pattern AS gap_id, pattern, category, severity, description, 'Add ' || replace(pattern, '_', ' ') || ' to improve score' AS example_fix, row_number() OVER (PARTITION BY doc_id ORDER BY sev_rank, ord) AS rank FROM scores JOIN gapdim USING (pattern) WHERE NOT detected)"
LIB = "library(id, score_key, name, category, description, boost_min, boost_max) AS (VALUES " + ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in LIBRARY) + ")"
DOMAIN = "CASE WHEN regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) <> '' THEN regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) ELSE {0} END"
ENGINE = "CASE event_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in ENGINES.items()) + " END"
AT = f"TIMESTAMP {q(AS_OF)}"
CITATIONS = f"""
npages AS (SELECT greatest(count(*), 1) AS n FROM pages),
citations AS (SELECT event_id::VARCHAR AS id, url, {DOMAIN.format('url')} AS domain, {ENGINE} AS engine, 'q' || user_id AS prompt, 'cat' || (user_id % 3) AS prompt_category, 'cited' AS citation_text,
  (event_id % 5 + 1)::INT AS position, value / 500 AS confidence, ts::TIMESTAMP AS detected_at, event_id % 4 = 0 AS verified FROM events CROSS JOIN npages LEFT JOIN pages ON page_id = event_id % n),
recent AS (SELECT * FROM citations WHERE detected_at >= {AT} - INTERVAL 30 DAY)"""
REQUESTS = "requests AS (SELECT event_id AS request_id, make_timestamp(1704067200000000 + ((epoch_us(ts::TIMESTAMP) - 1704067200000000) // 1440)) AS ts, 'key' || event_type AS api_key, '/p' || (user_id % 7) AS path, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value / 100 AS duration_s FROM events)"
ANSWERS = """
npages AS (SELECT greatest(count(*), 1) AS n FROM pages),
answers AS (SELECT conv_id * 1000 + turn AS answer_id, CASE conv_id % 3 WHEN 0 THEN 'grok' WHEN 1 THEN 'claude' ELSE 'gpt' END AS engine, CASE WHEN conv_id % 2 = 0 THEN text || ' Source: ' || url ELSE text END AS text
  FROM conversations CROSS JOIN npages LEFT JOIN pages ON page_id = conv_id % n WHERE role = 'assistant')"""
VALID_URL = rx(URL)
