"""DuckDB SQL over the same tables for the queries that SQL can express."""

from __future__ import annotations

from .functions.labels import ASSEMBLY, HEADED_ROLES, OTHER_ASSEMBLY, ROLE_LABELS
from .functions.text import PRINTED_HEADS
from .plans.prompts import GUIDANCE, MARKER, OTHER_GUIDANCE, POLICIES, TASK
from .projections import KEYWORD_LINES, TYPES


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _lines(x: str) -> str:
    return rf"list_filter(list_transform(string_split(coalesce({x}, ''), chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')"


def _has(text: str, words: str) -> str:
    return rf"regexp_matches({text}, '\b({words})\b')"


_MARKER = r"'^(page\s*)?[ivxlcdm\d]+$'"
_KEYED = f"""k AS (
  SELECT doc_id, CAST(doc_id % 7 AS INT) AS page_index, lang, source,
    ({_list(TYPES)})[CAST(doc_id // {len(KEYWORD_LINES)} % {len(TYPES)} AS INT) + 1] AS document_type,
    ({_list(KEYWORD_LINES)})[CAST(doc_id % {len(KEYWORD_LINES)} AS INT) + 1] || chr(10) || coalesce(text, '') AS text
  FROM documents
)"""
_LINED = f"l AS (SELECT *, {_lines('text')} AS ls FROM k)"
_NUMBER = r"'\b\d+(\.\d+)?%?\b'"


def _collapse(x: str) -> str:
    return rf"regexp_replace({_strip(x)}, '\s+', ' ', 'g')"


def _body_line(x: str) -> str:
    words = rf"len(regexp_extract_all({x}, '[A-Za-z]+'))"
    return rf"""({words} >= 4 AND ((length({x}) > 95 AND NOT regexp_matches({x}, '\.{{2,}}|\s{{2,}}|[|:]-?\s*')) OR regexp_matches({x}, '[.!?]\s+[A-Z]')
      OR ({words} >= 8 AND regexp_matches({x}, '\b(and|or|but|the|this|that|with|from|into|upon|which)\b', 'i'))))"""


def _contents_head(x: str) -> str:
    return f"(starts_with(lower({x}), 'contents') OR starts_with(lower({x}), 'table of contents'))"


_CELLS = rf"""list_filter(list_transform(CASE WHEN contains(x, '|') THEN string_split(x, '|') WHEN regexp_matches(x, '\s{{2,}}') THEN string_split_regex(x, '\s{{2,}}') ELSE [] END,
      lambda y: {_strip('y')}), lambda y: y <> '')"""
# A line that could be a table's row.
_ROW = rf"""(length({_collapse('x')}) BETWEEN 3 AND 220 AND NOT {_contents_head(_collapse('x'))} AND len({_CELLS}) >= 2
      AND (len({_CELLS}) >= 3 OR len(list_filter({_CELLS}, lambda y: regexp_matches(y, '\d'))) > 0) AND NOT {_body_line(_collapse('x'))})"""
_OBSERVE = rf"""o AS (
  SELECT *, len(ls) AS n, lower(array_to_string(ls[1:40], chr(10))) AS low, lower(ls[1]) AS first_low, ls[1] AS first,
    lower(array_to_string(ls[1:120], chr(10))) AS low120, lower(array_to_string(ls[1:8], chr(10))) AS low8, lower(array_to_string(ls[1:6], chr(10))) AS low6,
    array_to_string(ls[1:8], chr(10)) AS head8, lower(document_type) AS kind,
    len(list_filter(ls[1:120], lambda x: regexp_matches(x, {_NUMBER}))) >= 4 AS numbers,
    len(ls) >= 2 AND len(list_filter(ls[1:120], lambda x: {_ROW})) > 0 AS tabular,
    len(list_filter(ls[1:80], lambda x: regexp_matches(x, '\S\s{{4,}}\S'))) >= 2 AS spaced,
    len(list_filter(ls, lambda x: contains(lower(x), '[image:'))) > 0 AS pictured
  FROM l
), s AS (
  SELECT *, {_has('low120', 'chart|graph|plot|diagram|figure|axis|legend|trend|bar|line chart|pie chart')}
      OR numbers OR {_has('low120', 'legend|key|scale|rate|percentage|axis|graph|chart|plot')}
      OR regexp_matches(low120, '\b[xy]\s*[- ]?axis\b') AS charted FROM o
), r0 AS (
  SELECT *, CASE
    WHEN contains(low, 'contents') THEN 'contents'
    WHEN charted AND n <= 60 AND {_has('low', 'chart|graph|plot|diagram|axis|legend')} THEN 'chart'
    WHEN tabular AND n <= 80 THEN 'table'
    WHEN regexp_matches(low, 'preface|foreword') THEN 'preface'
    WHEN contains(first_low, 'abstract') OR first_low = 'summary' THEN 'abstract'
    WHEN {_has('low', 'references|bibliography|works cited')} THEN CASE WHEN kind = 'journal article' THEN 'references' ELSE 'bibliography' END
    WHEN kind = 'book' AND contains(low, 'index') THEN 'index'
    WHEN {_has('low', 'appendix')} THEN 'appendix'
    WHEN kind = 'book' AND {_has('low', 'chapter')} THEN 'chapter'
    WHEN kind IN ('book', 'journal article', 'general') AND {_has('low', 'section|part')} THEN 'section'
    WHEN kind = 'magazine' AND {_has('low', r'masthead|editor|publisher|volume|vol\.|issue|no\.')} THEN 'masthead'
    WHEN kind = 'magazine' AND {_has('low', 'editorial|from the editor')} THEN 'editorial'
    WHEN kind = 'magazine' AND {_has('low', 'feature|special report|cover story')} THEN 'feature'
    WHEN kind = 'magazine' AND {_has('low', 'advertisement|advertiser|classified')} THEN 'advertisement'
    WHEN kind = 'magazine' AND {_has('low', 'sidebar|box item')} THEN 'sidebar'
    WHEN kind = 'magazine' AND {_has('low', 'caption|photo|illustration|plate')} THEN 'caption'
    WHEN kind = 'magazine' AND spaced THEN 'multi-column'
    WHEN kind = 'magazine' AND length(first) <= 80 AND first = upper(first) AND n <= 25 THEN 'article'
    WHEN kind = 'newspaper' AND {_has('low', 'classifieds?|wanted|for sale|tenders?')} THEN 'classifieds'
    WHEN kind = 'newspaper' AND {_has('low', 'advertisement|advertiser')} THEN 'advertisement'
    WHEN kind = 'newspaper' AND {_has('low', 'continued from|continued on')} THEN 'continuation'
    WHEN kind = 'newspaper' AND regexp_matches(first, '^[A-Z][A-Z .,''-]{{6,}}$') THEN 'headline'
    WHEN kind = 'newspaper' AND {_has('low8', 'by|from our correspondent|staff reporter')} THEN 'byline'
    WHEN kind = 'newspaper' AND regexp_matches(head8, '\b[A-Z][a-z]+,\s+[A-Z][a-z]+\.?\s+\d{{1,2}}\b') THEN 'dateline'
    WHEN kind = 'newspaper' AND spaced THEN 'multi-column'
    WHEN kind = 'manuscript' AND ({_has('low', r'folio|fol\.|recto|verso')} OR regexp_matches(first, '^(f\.?\s*)?\d+[rv]$', 'i')) THEN 'folio'
    WHEN kind = 'manuscript' AND {_has('low', 'marginalia|margin note|in margin')} THEN 'marginalia'
    WHEN kind = 'manuscript' AND {_has('low', 'correction|inserted|deleted|interlineation')} THEN 'correction'
    WHEN kind = 'manuscript' AND {_has('low', 'colophon|scribe|copied by|completed by')} THEN 'colophon'
    WHEN kind = 'manuscript' AND (len(string_split(low, '[unclear]')) > 3 OR contains(low, '[missing text]')) THEN 'damaged'
    WHEN kind = 'manuscript' AND n >= 8 AND len(list_filter(ls[1:12], lambda x: length(x) > 90)) = 0 THEN 'lineated-text'
    WHEN kind = 'letter' AND {_has('low6', 'dear|respected|sir|madam|my dear')} THEN 'salutation'
    WHEN kind = 'letter' AND {_has('low', 'yours faithfully|yours sincerely|sincerely|obediently|signed')} THEN 'signature'
    WHEN kind = 'letter' AND {_has('low', r'p\.?s\.?|postscript')} THEN 'postscript'
    WHEN kind = 'letter' AND regexp_matches(low, '\b(to|from)\b[^\n]+\b(street|road|district|post|address)\b') THEN 'address'
    WHEN kind = 'letter' AND regexp_matches(first_low, '\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b|\b(january|february|march|april|may|june|july|august|september|october|november|december)\b') THEN 'date-place'
    WHEN kind = 'archive bundle' AND regexp_matches(low, '\b(file|folder|bundle|box)\s*(no\.?|number|id)?\b') THEN 'folder-label'
    WHEN kind = 'archive bundle' AND {_has('low', r'id|identifier|reference|ref\.|case no\.|serial no\.')} THEN 'identifier'
    WHEN kind = 'archive bundle' AND {_has('low', 'form|application|register|ledger')} THEN 'form'
    WHEN kind = 'archive bundle' AND {_has('low', 'date|dated')} THEN 'date'
    WHEN kind = 'archive bundle' AND regexp_matches(low, '\b(item|document|record)\s+\d+\b') THEN 'item-boundary'
    WHEN kind = 'archive bundle' AND n <= 35 THEN 'record'
    WHEN kind = 'legal document' AND {_has('low', 'parties?|agreement|contract|deed|memorandum|terms and conditions')} THEN CASE WHEN n <= 10 THEN 'title' ELSE 'clauses' END
    WHEN kind = 'legal document' AND {_has('low', 'recitals?|whereas')} THEN 'recitals'
    WHEN kind = 'legal document' AND {_has('low', 'definitions?|defined terms')} THEN 'definitions'
    WHEN kind = 'legal document' AND {_has('low', 'schedule|annex|annexure|exhibit|appendix')} THEN 'schedule'
    WHEN kind = 'legal document' AND {_has('low', 'signatures?|signed by|executed by')} THEN 'signature'
    WHEN kind = 'finance document' AND {_has('low', 'statement|balance sheet|profit and loss|income statement|ledger')} THEN 'statement'
    WHEN kind = 'finance document' AND {_has('low', 'account|invoice|receipt|debit|credit|transaction')} THEN 'account'
    WHEN kind = 'finance document' AND {_has('low', 'total|summary|subtotal|grand total')} THEN 'summary'
    WHEN kind = 'healthcare document' AND {_has('low', 'patient|hospital|clinic|report|diagnosis|prescription')} THEN CASE WHEN n <= 10 THEN 'title' ELSE 'findings' END
    WHEN kind = 'healthcare document' AND {_has('low', 'medication|dose|dosage|treatment|instructions')} THEN 'medications'
    WHEN kind = 'insurance document' AND {_has('low', 'policy|coverage|claim|premium|exclusion|benefit')} THEN CASE WHEN n <= 10 THEN 'policy' ELSE 'coverage' END
    WHEN tabular THEN 'table'
    WHEN charted THEN 'chart'
    WHEN pictured THEN 'illustrated'
    ELSE 'body' END AS role0
  FROM s
), tl AS (
  SELECT *, list_filter(ls, lambda x: NOT regexp_matches(x, {_MARKER}, 'i')) AS ts FROM r0
), r AS (
  SELECT *, CASE
    WHEN role0 = 'body' AND page_index <= 2 AND n > 0 AND n <= 18 AND NOT charted AND NOT tabular
      AND len(list_filter(ts, lambda x: length(x) BETWEEN 4 AND 120 AND x = upper(x))) > 0
      AND (len(ts) <= 10 OR len(list_filter(ts, lambda x: regexp_matches(x, '\b(by|author|editor|translated by)\b', 'i'))) > 0)
    THEN 'title' ELSE role0 END AS role FROM tl
)"""
_OBSERVED = f"{_KEYED}, {_LINED}, {_OBSERVE}"
_LEADING = r"'^(.+?)\s*(?:\.{2,}|\s{2,}|[|:]\s*|-\s+)\s*([ivxlcdm\d]+)$'"
_TRAILING = r"'^([ivxlcdm\d]+)\s+(.+?)$'"
# What pages hold besides their role: entries, notes, features, layout and flow.
_FEATURE = rf"""e0 AS (
  SELECT *, list_filter(list_transform(ls[1:120], lambda x: {{'raw': x, 'one': {_collapse('x')}}}), lambda x: length(x.one) BETWEEN 3 AND 180
      AND NOT regexp_matches(x.one, {_MARKER}, 'i') AND NOT {_contents_head('x.one')} AND NOT {_body_line('x.one')}) AS lead FROM r
), e1 AS (
  SELECT *, list_filter(list_transform(lead, lambda x: {{
      'title': regexp_replace(CASE WHEN regexp_matches(x.one, {_LEADING}, 'i') THEN regexp_extract(x.one, {_LEADING}, 1, 'i') ELSE regexp_extract(x.one, {_TRAILING}, 2, 'i') END, '^[ .\-]+|[ .\-]+$', '', 'g'),
      'page': CASE WHEN regexp_matches(x.one, {_LEADING}, 'i') THEN regexp_extract(x.one, {_LEADING}, 2, 'i') ELSE regexp_extract(x.one, {_TRAILING}, 1, 'i') END, 'raw': x.raw}}),
      lambda e: length(e.title) BETWEEN 2 AND 140 AND e.page <> '' AND NOT regexp_matches(e.title, {_MARKER}, 'i'))[1:80] AS entries,
    list_filter(list_transform(list_filter(ls, lambda x: regexp_matches(x, '^\s*(\*+|\d+|[a-z])[).:\]]\s+(.+)$', 'i')), lambda x: {{
      'marker': regexp_extract(x, '^\s*(\*+|\d+|[a-z])[).:\]]\s+(.+)$', 1, 'i'), 'text': {_strip(r"regexp_extract(x, '^\s*(\*+|\d+|[a-z])[).:\]]\s+(.+)$', 2, 'i')")}}}),
      lambda x: length(x.text) > 8)[1:40] AS notes,
    lower(array_to_string(ls[1:100], chr(10))) AS low100,
    regexp_matches(array_to_string(ls[1:80], chr(10)), '\S\s{{6,}}\S') AS wide,
    round_even(coalesce(list_sum(list_transform(ls[1:80], lambda x: length(x))), 0) / greatest(len(ls[1:80]), 1)::DOUBLE, 1) AS mean FROM e0
), e2 AS (
  SELECT *, list_filter([
      CASE WHEN spaced THEN 'multi_column' END, CASE WHEN pictured THEN 'figure_marker' END, CASE WHEN len(entries) > 0 THEN 'contents_entries' END,
      CASE WHEN len(notes) > 0 THEN 'footnotes' END, CASE WHEN {_has('low100', 'by|from our correspondent|staff reporter')} THEN 'byline' END,
      CASE WHEN {_has('low100', 'advertisement|classifieds?|wanted|for sale')} THEN 'advertising' END,
      CASE WHEN {_has('low100', 'caption|photo|illustration|figure|plate|map')} THEN 'visual_reference' END, CASE WHEN wide THEN 'table_or_columns' END,
      CASE WHEN tabular THEN 'table_rows' END, CASE WHEN charted THEN 'chart_candidate' END,
      CASE WHEN role IN ('marginalia', 'annotation', 'correction', 'folio') OR kind = 'manuscript' THEN 'manuscript_layout' END], lambda x: x IS NOT NULL) AS features,
    CASE WHEN tabular OR role = 'table' THEN 'tabular' WHEN charted OR role = 'chart' THEN 'chart-led' WHEN spaced THEN 'multi-column'
      WHEN role IN ('contents', 'references', 'bibliography', 'index', 'classifieds') THEN 'list-like' WHEN role IN ('folio', 'marginalia', 'lineated-text') THEN 'lineated'
      WHEN wide THEN 'tabular-or-columnar' ELSE 'single-flow' END AS layout,
    coalesce(list_filter(list_concat(ls[1:12], ls[greatest(len(ls) - 5, 1):]), lambda x: regexp_matches(x, {_MARKER}, 'i'))[1], '') AS marker FROM e1
), e3 AS (
  SELECT *, spaced OR layout = 'multi-column' AS multi, role IN ('table', 'chart') OR tabular AS tabled FROM e2
), e4 AS (
  SELECT *, CASE WHEN multi THEN 'multi-column' WHEN tabled THEN CASE WHEN role = 'chart' THEN 'chart-led' ELSE 'tabular' END WHEN wide THEN 'tabular'
      WHEN role IN ('contents', 'references', 'bibliography', 'index') THEN 'structured-list' ELSE 'single-flow' END AS flow0,
    CASE WHEN multi THEN 2 WHEN tabled THEN CASE WHEN role = 'chart' THEN 1 ELSE 2 END WHEN wide THEN CASE WHEN mean < 70 THEN 2 ELSE 3 END ELSE 1 END AS column_count FROM e3
), f AS (
  SELECT *, CASE WHEN role IN ('title', 'cover', 'cover-sheet') THEN 'front-matter' WHEN n >= 65 AND mean < 62 AND flow0 = 'single-flow' THEN 'dense-prose' ELSE flow0 END AS dominant_flow FROM e4
)"""
_FEATURED = f"{_OBSERVED}, {_FEATURE}"


def _packed(items: str, keys: str, gap: int, name: str) -> str:
    """Greedy packing of items (keys, i, s) in chunks of at most 5000 characters: CTEs `name` and its groups."""
    same = " AND ".join(f"b.{k} = p.{k}" for k in keys.split(", "))
    fits = f"(size + {gap} + length(b.s) <= 5000 AND length(b.s) <= 5000 AND size <= 5000)"
    named = ", ".join(f"b.{k}" for k in keys.split(", "))
    glue = " || ".join(["chr(10)"] * gap)
    return f"""{name}({keys}, i, part, size) AS (
  SELECT {keys}, i, 1, CAST(length(s) AS BIGINT) FROM {items} WHERE i = 1
  UNION ALL SELECT {named}, b.i, CASE WHEN {fits} THEN part ELSE part + 1 END, CASE WHEN {fits} THEN size + {gap} + length(b.s) ELSE length(b.s) END
  FROM {name} p JOIN {items} b ON {same} AND b.i = p.i + 1
), {name}_g AS (SELECT {keys}, part, string_agg(s, {glue} ORDER BY i) AS s FROM {name} JOIN {items} USING ({keys}, i) GROUP BY ALL)"""


_CHUNKS = rf"""t AS (SELECT doc_id, {_strip("coalesce(text, '')")} AS t FROM documents),
blocks AS (SELECT doc_id, generate_subscripts(bs, 1) AS i, unnest(bs) AS s FROM (
  SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\n{{2,}}'), lambda x: {_strip('x')}), lambda x: x <> '') AS bs FROM t WHERE length(t) > 5000)),
{_packed('blocks', 'doc_id', 2, 'pack')},
long_lines AS (SELECT doc_id, part AS block, generate_subscripts(ls, 1) AS i, unnest(ls) AS s FROM (SELECT doc_id, part, {_lines('s')} AS ls FROM pack_g WHERE length(s) > 5000)),
{_packed('long_lines', 'doc_id, block', 1, 'repack')},
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) AS chunk_index, s AS chunk FROM (
  SELECT doc_id, 0 AS a, 0 AS b, t AS s FROM t WHERE t <> '' AND length(t) <= 5000
  UNION ALL SELECT doc_id, part, 0, s FROM pack_g WHERE length(s) <= 5000 UNION ALL SELECT doc_id, block, part, s FROM repack_g))"""
_META = r"'thinking\.\.\.|role:|task:|output requirements:|self-correction|wait,'"


def _offline(x: str) -> str:
    """The offline restoration of a text with plain line ends, without the line feed at its end."""
    return _strip(rf"regexp_replace(regexp_replace(regexp_replace({x}, '-\n([A-Za-z])', '\1', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


_RESTORED = rf"""{_CHUNKS}, restored AS (
  SELECT doc_id, chunk_index, chunk, CASE WHEN regexp_matches(lower(reply), {_META}) THEN {_strip('chunk')} ELSE reply END AS restored_text, regexp_matches(lower(reply), {_META}) AS meta
  FROM (SELECT *, {_offline('chunk')} AS reply FROM chunks)
)"""

_BOXES = """b0 AS (
  SELECT l_orderkey AS page, l_linenumber AS block, CAST(l_partkey % 900 AS INT) AS "left", CAST(l_suppkey * 37 % 1400 AS INT) AS top,
    CAST(l_quantity * 18 AS INT) + 20 AS w0, CAST(l_quantity * 9 AS INT) + 12 AS h0, l_discount * 5 AS dark, l_tax * 2 AS mid
  FROM lineitem
), b1 AS (
  SELECT *, least(1000 - "left", w0) AS w, least(1500 - top, h0) AS h FROM b0
), b2 AS (
  SELECT *, "left" + w AS "right", top + h AS bottom, w * h / 1500000.0::DOUBLE AS area, w / 1000.0::DOUBLE AS wr, h / 1500.0::DOUBLE AS hr FROM b1
), b3 AS (
  SELECT *, (wr >= 0.14 AND hr >= 0.09 AND area BETWEEN 0.025 AND 0.75 AND dark BETWEEN 0.06 AND 0.70) AS fig,
    (area BETWEEN 0.02 AND 0.75 AND ((w > 320 AND h > 270 AND dark BETWEEN 0.07 AND 0.60) OR (h > w * 0.72 AND dark BETWEEN 0.08 AND 0.55) OR mid >= 0.12)) AS charty,
    (wr >= 0.22 AND hr >= 0.07 AND area BETWEEN 0.03 AND 0.70 AND dark BETWEEN 0.04 AND 0.72 AND (mid >= 0.12 OR w / h >= 1.15)) AS tabular,
    round_even(area, 4) AS ar
  FROM b2
), b4 AS (
  SELECT *, CASE WHEN fig THEN CASE WHEN charty THEN 'chart-region' ELSE 'figure-region' END
    WHEN wr > 0.65 AND hr < 0.08 THEN 'running-header-or-footer'
    WHEN ar < 0.01 AND dark > 0.18 THEN 'small-mark-or-page-number'
    WHEN tabular THEN 'table-region'
    WHEN top > 120 AND top < 525 AND wr BETWEEN 0.22 AND 0.88 AND hr < 0.11 AND abs(("left" + "right") / 2 - 500) < 150 THEN 'title-region'
    ELSE 'text-region' END AS role,
    (round_even("left" / 1000, 4) + round_even("right" / 1000, 4)) / 2 AS centre
  FROM b3
), cols AS (
  SELECT page, count(*) AS block_count, min("left") AS content_left, min(top) AS content_top, max("right") AS content_right, max(bottom) AS content_bottom,
    count(*) FILTER (role = 'figure-region') AS figures, count(*) FILTER (role = 'text-region') AS texts,
    count(*) FILTER (t) AS tn, count(*) FILTER (t AND centre < 0.42) AS l, count(*) FILTER (t AND centre BETWEEN 0.42 AND 0.58) AS m, count(*) FILTER (t AND centre > 0.58) AS r,
    count(*) FILTER (t AND centre < 0.34) AS a, count(*) FILTER (t AND centre BETWEEN 0.34 AND 0.66) AS b, count(*) FILTER (t AND centre > 0.66) AS c
  FROM (SELECT *, role IN ('text-region', 'running-header-or-footer') AS t FROM b4) GROUP BY page
), counted AS (
  SELECT *, CASE WHEN tn < 4 THEN 1 WHEN l >= 2 AND r >= 2 AND m <= greatest(l, r) THEN 2 WHEN least(a, b, c) >= 2 THEN 3 ELSE 1 END AS columns FROM cols
), ordered AS (
  SELECT b4.*, columns, row_number() OVER (PARTITION BY page ORDER BY
    CASE WHEN columns > 1 THEN least(CAST(floor(("left" + "right") / 2 / (1000.0 / columns)) AS INT), columns - 1) ELSE 0 END,
    top, CASE WHEN columns > 1 THEN 0 ELSE "left" END, bottom) AS reading_order
  FROM b4 JOIN counted USING (page)
)"""

_SCORED = f"""{_BOXES}, s AS (
  SELECT *, 0.52::DOUBLE + CASE
    WHEN role IN ('text-region', 'title-region') THEN 0.18::DOUBLE + CASE WHEN ar BETWEEN 0.02 AND 0.45 THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN dark BETWEEN 0.03 AND 0.40 THEN 0.08::DOUBLE ELSE 0 END
    WHEN role = 'figure-region' THEN 0.12::DOUBLE + CASE WHEN ar BETWEEN 0.04 AND 0.55 THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN dark BETWEEN 0.08 AND 0.62 THEN 0.06::DOUBLE ELSE 0 END
    WHEN role IN ('chart-region', 'table-region') THEN 0.13::DOUBLE + CASE WHEN ar BETWEEN 0.03 AND 0.65 THEN 0.09::DOUBLE ELSE 0 END + CASE WHEN dark BETWEEN 0.06 AND 0.68 THEN 0.05::DOUBLE ELSE 0 END
    WHEN role = 'running-header-or-footer' THEN 0.08::DOUBLE + CASE WHEN wr > 0.55 AND hr < 0.10 THEN 0.10::DOUBLE ELSE 0 END
    ELSE -0.05::DOUBLE END AS v FROM b4
), z AS (
  SELECT *, round_even(greatest(0.05::DOUBLE, least(v - CASE WHEN ar < 0.003 OR dark < 0.015 THEN 0.18::DOUBLE ELSE 0 END - CASE WHEN ar > 0.82 OR dark > 0.78 THEN 0.14::DOUBLE ELSE 0 END, 0.98::DOUBLE)), 2) AS c,
    ("left" + "right") / 2 / 1000 AS x, (top + bottom) / 2 / 1500 AS y FROM s
), sc AS (
  SELECT *, concat_ws('-', CASE WHEN y < 0.33 THEN 'top' WHEN y > 0.67 THEN 'bottom' ELSE 'middle' END, CASE WHEN x < 0.33 THEN 'left' WHEN x > 0.67 THEN 'right' ELSE 'center' END) AS page_zone FROM z
)"""

_UNITS = """u AS (
  SELECT user_id AS run, event_id AS seq, CAST(floor(coalesce(value, 0)) AS BIGINT) AS n, event_type,
    CASE WHEN event_type IN ('error', 'signup') THEN 'failed in ' || event_type ELSE '' END AS failure_reason
  FROM events
)"""

_SOURCES = """src AS (
  SELECT doc_id AS source_no, 'S' || doc_id AS source_id, concat_ws('/', source, lang) AS label, coalesce(text, '') AS text, CAST(doc_id AS INT) AS page_number FROM documents
), hay AS (
  SELECT *, lower(label || chr(10) || text) AS hay FROM src
)"""


def _points(terms: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(contains(hay, '{t}') AS INT)" for t in terms)


def _times(terms: tuple[str, ...]) -> str:
    return " + ".join(f"(length(hay) - length(replace(hay, '{t}', ''))) // {len(t)}" for t in terms)


_STOP = "'the','and','for','with','that','this','what','which','from','into','about','have','does','where','when','how','why','was','are','you','can','will','please'"
_PAGES = "lines AS (SELECT l_orderkey AS page, string_agg('item | ' || l_linenumber || ' | ' || l_partkey || ' | ' || CAST(l_quantity AS INT), chr(10) ORDER BY l_linenumber, 'item | ' || l_linenumber || ' | ' || l_partkey || ' | ' || CAST(l_quantity AS INT)) AS text, count(*) AS n FROM lineitem GROUP BY 1)"

def _label(role: str, kind: str) -> str:
    cases = " ".join(f"WHEN '{k}/{r}' THEN '{label}'" for k, roles in ROLE_LABELS.items() for r, label in roles.items())
    return f"CASE {kind} || '/' || {role} {cases} ELSE replace({role}, '-', ' ') END"


def _escaped(x: str) -> str:
    for raw, made in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{raw}', '{made}')"
    return x


_HEADS = rf"""h AS (
  SELECT *, list_filter(ls[1:12], lambda x: length(x) BETWEEN 2 AND 90 AND (x = upper(x) OR regexp_matches(x, '^(chapter|section|part|book|preface|contents|index|appendix)\b', 'i')))[1:6] AS heads,
    CASE WHEN page_index <= 2 THEN ls[1:2] ELSE [] END AS titles, CASE WHEN role = 'contents' THEN entries ELSE [] END AS own_entries FROM f
), u AS (SELECT *, coalesce(list_concat(heads, titles)[1], '') AS heading FROM h)"""
_UNIT = rf"""list_filter([
      CASE WHEN len(own_entries) > 0 THEN '## Contents' || chr(10) || chr(10) || array_to_string(list_transform(own_entries, lambda e: rtrim('- ' || {_strip('e.title')} || ' ' || {_strip('e.page')})), chr(10)) END,
      CASE WHEN heading <> '' AND role IN ('title', 'title-page', {", ".join(f"'{r}'" for r in HEADED_ROLES)}) THEN '## ' || heading END,
      CASE WHEN len(notes) > 0 THEN '## Notes' || chr(10) || chr(10) || array_to_string(list_transform(notes, lambda e: '- ' || {_strip('e.marker')} || ': ' || {_strip('e.text')}), chr(10)) END], lambda x: x IS NOT NULL)"""
_PUBLISHED = f"""{_BOXES}, t AS (
  SELECT page, reading_order, role, CASE WHEN role = 'table-region' THEN 'csv' WHEN role NOT IN ('separator-region', 'figure-region') THEN 'prose' END AS sort
  FROM ordered WHERE reading_order <= 120
), k AS (SELECT *, row_number() OVER (PARTITION BY page, sort ORDER BY reading_order) AS rank, count(*) OVER (PARTITION BY page, sort) AS slots FROM t),
d AS (SELECT doc_id AS page, generate_subscripts(ls, 1) AS ix, unnest(ls) AS line FROM (SELECT doc_id, {_lines('text')} AS ls FROM documents)),
p AS (SELECT k.page, k.reading_order, list(line ORDER BY ix) AS said FROM k JOIN d ON k.page = d.page AND k.sort = 'prose' AND least(d.ix, k.slots) = k.rank GROUP BY ALL),
z AS (SELECT k.page, k.reading_order, role, said FROM k LEFT JOIN p USING (page, reading_order))"""
# All blocks of a page.
_PUBLISHED_WHOLE = _PUBLISHED.replace(" WHERE reading_order <= 120", "")
_FILES = """x AS (SELECT doc_id, text, '/runs/' || source || '/' || lang || '/' || doc_id || '/' || CASE WHEN doc_id % 4 = 3 THEN 'run_manifest.json'
  ELSE ['final__', 'translated__', ''][CAST(doc_id % 4 AS INT) + 1] || 'page_' || doc_id || ['.json', '.txt', '.md', '.png'][CAST(doc_id % 7 % 4 AS INT) + 1] END AS path FROM documents)"""


ORACLES: dict[str, str] = {
    "restore_text_offline": rf"""
SELECT doc_id, {_strip(r"regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, '. ', '.  ' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || '-' || chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '-\n([A-Za-z])', '\1', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} || chr(10) AS restored FROM documents""",
    "page_lines": f"""
SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM (SELECT doc_id, {_lines('text')} AS ls FROM documents)""",
    "page_markers_headings": rf"""
WITH {_KEYED}, {_LINED}, c AS (
  SELECT doc_id, ls, list_concat(ls[1:12], ls[greatest(len(ls) - 5, 1):]) AS ends,
    list_filter(list_transform(list_concat(ls[1:3], ls[greatest(len(ls) - 2, 1):]), lambda x: regexp_replace(x, '\s+', ' ', 'g')),
      lambda x: length(x) BETWEEN 4 AND 90 AND NOT regexp_matches(x, {_MARKER}, 'i')) AS heads FROM l
)
SELECT doc_id, coalesce(list_filter(ends, lambda x: regexp_matches(x, {_MARKER}, 'i'))[1], '') AS page_marker,
  array_to_string(list_filter(ls[1:12], lambda x: length(x) BETWEEN 2 AND 90 AND (x = upper(x)
    OR regexp_matches(x, '^(chapter|section|part|book|preface|contents|index|appendix)\b', 'i')))[1:6], '|') AS headings,
  coalesce(heads[1], '') AS running_header FROM c""",
    "content_role": f"""
WITH {_OBSERVED}
SELECT doc_id, document_type, role, CASE
  WHEN role IN ('title', 'cover', 'masthead', 'cover-sheet', 'folder-label') THEN 'front_matter'
  WHEN role = 'contents' THEN 'toc' WHEN role IN ('preface', 'abstract', 'editorial') THEN 'introductory'
  WHEN role IN ('chapter', 'section', 'article', 'feature', 'record', 'letter', 'body', 'lineated-text') THEN 'main_flow'
  WHEN role IN ('table', 'chart', 'figure-table') THEN 'tabular'
  WHEN role IN ('index', 'references', 'bibliography', 'footnotes') THEN 'back_matter'
  WHEN role IN ('advertisement', 'classifieds', 'sidebar', 'caption', 'illustrated') THEN 'supplementary'
  WHEN kind = 'archive bundle' THEN 'archive_item' ELSE 'main_flow' END AS assembly_hint FROM r""",
    "role_counts_by_type": f"WITH {_OBSERVED} SELECT document_type, role, count(*) AS pages FROM r GROUP BY ALL",
    "role_labels": f"WITH {_OBSERVED} SELECT doc_id, role, {_label('role', 'kind')} AS label FROM r",
    "layout_confidence": rf"""
WITH {_OBSERVED}, c AS (
  SELECT doc_id, 0.48::DOUBLE + CASE WHEN role IN ('title', 'contents', 'chapter', 'section', 'preface', 'abstract') THEN 0.18::DOUBLE ELSE 0 END
    - CASE WHEN role IN ('marginalia', 'damaged') THEN 0.08::DOUBLE ELSE 0 END + least(length(text) / 1800.0::DOUBLE, 0.2::DOUBLE)
    - CASE WHEN regexp_matches(lower(text), '\[unclear\]|\[missing text\]') THEN 0.12::DOUBLE ELSE 0 END
    + CASE WHEN len(list_filter(ls, lambda x: contains(lower(x), '[image:'))) > 0 THEN 0.06::DOUBLE ELSE 0 END
    + CASE WHEN len(list_filter(list_concat(ls[1:12], ls[greatest(len(ls) - 5, 1):]), lambda x: regexp_matches(x, {_MARKER}, 'i'))) > 0 THEN 0.03::DOUBLE ELSE 0 END AS v
  FROM r
)
SELECT doc_id, round_even(greatest(0.05::DOUBLE, least(v, 0.99::DOUBLE)), 2) AS confidence FROM c""",
    "contents_entries": rf"""
WITH p AS (SELECT p_brand AS page, p_partkey, p_name || ' ..... ' || p_size AS line FROM part),
e AS (SELECT page, line, row_number() OVER (PARTITION BY page ORDER BY p_partkey) AS ix FROM p), f AS (SELECT * FROM e WHERE ix <= 120),
g AS (SELECT page, ix, regexp_extract(line, '^(.+?)\s*\.{{2,}}\s*(\d+)$', 1) AS t, regexp_extract(line, '^(.+?)\s*\.{{2,}}\s*(\d+)$', 2) AS number FROM f),
h AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY ix) AS pos, regexp_replace(t, '^[ .\-]+|[ .\-]+$', '', 'g') AS title, number FROM g)
SELECT * FROM h WHERE pos <= 80""",
    "table_rows_mode": f"WITH {_PAGES} SELECT page, CASE WHEN n < 2 THEN 0 ELSE least(n, 24) END AS n_rows, CASE WHEN n < 2 THEN 0 ELSE 4 END AS cells FROM lines",
    "chart_signals": f"WITH {_PAGES} SELECT page, CASE WHEN n >= 4 THEN 'numeric_labels' ELSE '' END AS signals FROM lines",
    "footnotes": rf"""
WITH x AS (SELECT doc_id, generate_subscripts(ls, 1) AS ix, unnest(ls) AS line FROM (SELECT doc_id, {_lines('text')} AS ls FROM documents)),
m AS (SELECT doc_id, ix, regexp_extract(line, '^\s*(\*+|\d+|[a-zA-Z])[).:\]]\s+(.+)$', 1) AS marker, {_strip(r"regexp_extract(line, '^\s*(\*+|\d+|[a-zA-Z])[).:\]]\s+(.+)$', 2)")} AS note FROM x),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ix) AS pos, marker, note FROM m WHERE marker <> '' AND length(note) > 8)
SELECT * FROM k WHERE pos <= 40""",
    "contributors": rf"""
WITH x AS (SELECT doc_id, list_transform({_lines('text')}, lambda x: regexp_replace(x, '\s+', ' ', 'g')) AS ls FROM documents),
y AS (SELECT doc_id, list_filter(ls[1:30], lambda x: length(x) <= 140 AND regexp_matches(x, '\b(by|author|edited by|editor|translated by|translator|compiled by)\b', 'i')) AS c,
  list_filter(ls[1:50], lambda x: length(x) <= 160 AND regexp_matches(x, '\b(published by|publisher|press|publication|publications|printing|printer)\b', 'i')) AS p FROM x)
SELECT doc_id, array_to_string(list_filter(c, lambda v, i: list_position(list_transform(c, lambda z: lower(z)), lower(v)) = i)[1:8], '|') AS contributors,
  array_to_string(list_filter(p, lambda v, i: list_position(list_transform(p, lambda z: lower(z)), lower(v)) = i)[1:6], '|') AS publishers FROM y""",
    "detected_title": rf"""
WITH x AS (SELECT doc_id, ({_lines('text')})[1:2] AS ls FROM documents)
SELECT doc_id, coalesce(list_filter(ls, lambda x: length(x) BETWEEN 3 AND 120 AND NOT regexp_matches(x, {_MARKER}, 'i') AND NOT contains(lower(x), 'default')
  AND NOT (length(x) < 40 AND regexp_matches(lower(x), '\b(run|output|restoration|export|workflow)\b')))[1], '') AS title FROM x""",
    "running_headers_frequent": rf"""
WITH x AS (SELECT doc_id, lang, {_lines('text')} AS ls FROM documents),
h AS (SELECT doc_id, lang, list_filter(list_transform(list_concat(ls[1:3], ls[greatest(len(ls) - 2, 1):]), lambda x: regexp_replace(x, '\s+', ' ', 'g')),
  lambda x: length(x) BETWEEN 4 AND 90 AND NOT regexp_matches(x, {_MARKER}, 'i'))[1] AS header FROM x),
c AS (SELECT lang, lower(header) AS low, arg_min(header, doc_id) AS header, count(*) AS n FROM h WHERE header IS NOT NULL GROUP BY lang, lower(header)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, low) AS place FROM c WHERE n > 1)
SELECT lang, place, header, n FROM o WHERE place <= 12""",
    "flow_mode": f"""
WITH {_UNITS}, c AS (SELECT run, event_type, count(*) AS k FROM u GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY k DESC, event_type DESC) AS ix FROM c) SELECT run, event_type AS most FROM o WHERE ix = 1""",
    "usage_totals": f"WITH {_UNITS} SELECT run, sum(n)::BIGINT AS prompt_tokens, sum(n * 2)::BIGINT AS completion_tokens, sum(n * 3)::BIGINT AS total_tokens, bool_or(n > 90) AS truncated FROM u GROUP BY run",
    "first_failure": f"""
WITH {_UNITS} SELECT run, coalesce(arg_min(failure_reason, seq) FILTER (failure_reason <> ''), '') AS failure_reason,
  CASE WHEN count(*) FILTER (failure_reason <> '') = 0 THEN 'restored' ELSE 'partial' END AS status FROM u GROUP BY run""",
    "retry_merge": f"""
WITH {_UNITS} SELECT run, seq, CASE WHEN event_type = 'error' THEN '' ELSE failure_reason END AS failure_reason,
  n * 3 + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS total_tokens, event_type, event_type = 'error' AS retried FROM u""",
    "failed_inputs": f"WITH {_UNITS} SELECT 'partial' AS status, failure_reason, count(*) AS units FROM u WHERE failure_reason <> '' GROUP BY ALL",
    "resume_remaining": f"WITH {_UNITS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT seq FROM u WHERE failure_reason = '')",
    "block_markers": rf"""
WITH p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
SELECT doc_id, 1 AS block, md5({_strip("coalesce(s[1], '')")}) AS digest FROM p
UNION ALL SELECT doc_id, 3, md5({_strip("coalesce(s[3], '')")}) FROM p UNION ALL SELECT doc_id, 2, md5({_strip("array_to_string(s[4:], chr(10))")}) FROM p""",
    "parse_model_reply": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_strip("coalesce(text, '')")} AS clean, doc_id % 6 AS n FROM documents),
m AS (SELECT *, CASE WHEN n = 5 AND regexp_matches(lower(clean), 'thinking\.\.\.|role:|task:|output requirements:|self-correction|wait,') THEN 4 ELSE n END AS k FROM t)
SELECT doc_id, md5(CASE WHEN n = 3 THEN '.' ELSE clean END) AS digest,
  CASE WHEN k = 4 THEN 'fallback' WHEN n < 3 AND clean = '' THEN 'blank' ELSE 'restored' END AS status,
  CASE WHEN k = 4 THEN 'model returned commentary instead of output' WHEN n < 3 AND clean = '' THEN 'blank page or no readable text' ELSE '' END AS failure_reason,
  CASE WHEN n < 3 THEN 'checked' WHEN k = 4 THEN 'fallback to source chunk because model returned commentary' ELSE '' END AS notes FROM m""",
    "block_roles_confidence": f"WITH {_SCORED} SELECT role, page_zone, c AS confidence, tabular AS table_signals, count(*) AS blocks FROM sc GROUP BY ALL",
    "reading_order": f"WITH {_BOXES} SELECT page, max(reading_order) AS blocks, arg_min(top, reading_order) AS first_top, arg_max(top, reading_order) AS last_top FROM ordered GROUP BY page",
    "column_estimate": f"WITH {_BOXES} SELECT columns, count(*) AS pages FROM counted GROUP BY ALL",
    "page_flow": f"""
WITH {_BOXES} SELECT page, CASE WHEN columns > 1 THEN 'multi-column' WHEN figures > 0 AND figures >= texts THEN 'figure-led' WHEN texts >= 12 THEN 'dense-prose' ELSE 'single-flow' END AS flow,
  block_count, content_left, content_top, content_right, content_bottom FROM counted""",
    "asset_placement": f"""
WITH {_BOXES}, z AS (SELECT *, (top / 1500 + bottom / 1500) / 2.0 AS y FROM b2)
SELECT CASE WHEN area >= 0.38 OR wr >= 0.78 THEN 'full-width' WHEN area >= 0.14 OR wr >= 0.48 THEN 'large' WHEN area >= 0.055 THEN 'medium' ELSE 'small' END AS size_class,
  CASE WHEN w > h * 1.4 THEN 'full-width' WHEN h > w * 1.4 THEN 'half-width' ELSE 'medium' END AS width_hint,
  CASE WHEN y <= 0.24 THEN 0 WHEN y >= 0.76 THEN 12 ELSE greatest(1, least(CAST(round_even(y * 12, 0) AS INT), 11)) END AS before_paragraph, count(*) AS assets FROM z GROUP BY ALL""",
    "allocate_text_to_blocks": f"""
WITH {_BOXES}, t AS (
  SELECT page, reading_order, CASE WHEN role = 'table-region' THEN 'csv' WHEN role NOT IN ('separator-region', 'figure-region') THEN 'prose' END AS sort
  FROM ordered WHERE reading_order <= 120
), k AS (SELECT *, row_number() OVER (PARTITION BY page, sort ORDER BY reading_order) AS rank, count(*) OVER (PARTITION BY page, sort) AS slots FROM t),
d AS (SELECT doc_id AS page, generate_subscripts(ls, 1) AS ix, unnest(ls) AS line FROM (SELECT doc_id, {_lines('text')} AS ls FROM documents)),
p AS (SELECT k.page, k.reading_order, string_agg(line, chr(10) || chr(10) ORDER BY ix) AS said FROM k JOIN d ON k.page = d.page AND k.sort = 'prose' AND least(d.ix, k.slots) = k.rank GROUP BY ALL)
SELECT k.page, k.reading_order, md5(coalesce(said, CASE WHEN sort = 'prose' THEN '' ELSE '-' END)) AS digest FROM k LEFT JOIN p USING (page, reading_order)""",
    "folder_rollup": """
WITH c AS (SELECT r_name, n_name, c_mktsegment, c_name, concat_ws('/', r_name, n_name, c_mktsegment, c_name) AS path
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT r_name AS folder, path, c_name FROM c UNION ALL SELECT r_name || '/' || n_name, path, c_name FROM c UNION ALL SELECT concat_ws('/', r_name, n_name, c_mktsegment), path, c_name FROM c)
SELECT folder, count(*) AS parts, md5(string_agg(c_name, chr(10) || chr(10) || chr(12) || chr(10) || chr(10) ORDER BY path, c_name)) AS digest FROM f GROUP BY folder""",
    "archive_folder_combine": f"""
WITH c AS (SELECT source || '/' || lang AS folder, concat_ws('/', source, lang, doc_id) AS path, {_strip("coalesce(text, '')")} AS t FROM documents)
SELECT folder, count(*) AS parts, md5(string_agg(t, chr(10) || chr(10) || chr(12) || chr(10) || chr(10) ORDER BY path)) AS digest FROM c WHERE t <> '' GROUP BY folder""",
    "stage_priority_union": "SELECT lang, 2 AS priority, count(*) AS rows FROM documents GROUP BY lang",
    "stage_priority_by_source": """
WITH p AS (SELECT source, lang, CASE lang WHEN 'es' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END AS priority FROM documents),
f AS (SELECT source, min(priority) AS priority FROM p GROUP BY source) SELECT source, lang, priority, count(*) AS rows FROM p JOIN f USING (source, priority) GROUP BY ALL""",
    "document_concat": f"""
WITH c AS (SELECT source, doc_id, {_strip("coalesce(text, '')")} AS t FROM documents),
j AS (SELECT source, string_agg(t, chr(10) || chr(10) || chr(12) || chr(10) || chr(10) ORDER BY doc_id) AS t FROM c WHERE t <> '' GROUP BY source)
SELECT source, length(t) AS chars, md5(t) AS digest FROM j""",
    "item_outputs": f"""
WITH c AS (SELECT source, doc_id, {_strip("coalesce(text, '')")} AS t FROM documents),
j AS (SELECT source, string_agg(t, chr(10) || chr(10) || chr(12) || chr(10) || chr(10) ORDER BY doc_id) AS t FROM c WHERE t <> '' GROUP BY source),
n AS (SELECT t, source, regexp_replace(source, '\\D', '', 'g')::INT AS i FROM j),
f AS (SELECT 'items/box-one/' || lpad(i::VARCHAR, 4, '0') || '-' || source || '-txt/translated__old-english-to-fr.txt' AS path, t, i, source FROM n),
x AS (SELECT path, t FROM f UNION ALL SELECT path || '.json', '{{"kind":"item","stage":"translated","source_index":' || i || ',"source_name":"Box One/' || source
  || '.TXT","language":"Old English","output_language":"fr","text":' || CAST(to_json(t) AS VARCHAR) || '}}' || chr(10) FROM f)
SELECT path, strlen(t)::INT AS bytes, md5(t) AS digest FROM x""",
    "archive_member_files": """
SELECT lpad((doc_id // 100)::VARCHAR, 6, '0') || '.zip' AS path, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY lang || '/' || doc_id || '.txt')::INT AS pos,
  lang || '/' || doc_id || '.txt' AS member, 'text' AS kind, md5(coalesce(text, '')) AS digest FROM documents""",
    "source_copies": """
SELECT 'sources/box-a/' || source || '/' || lpad(doc_id::VARCHAR, greatest(4, length(doc_id::VARCHAR))::INT, '0') || '-' || doc_id || '.txt' AS path, md5(coalesce(text, '')) AS digest FROM documents""",
    "matched_sources": """
WITH n AS (SELECT *, lpad(doc_id::VARCHAR, greatest(4, length(doc_id::VARCHAR))::INT, '0') AS k FROM documents),
c AS (SELECT CASE WHEN lang IN ('en', 'fr') THEN lang || '/' ELSE '' END || k || '-' || lang || '.txt' AS path FROM n WHERE doc_id % 3 <> 0),
p AS (SELECT path, regexp_extract(path, '^(?:(.*)/)?[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name FROM c)
SELECT n.lang || '/' || k || '-' || source AS folder, min(path) AS source_path
FROM n LEFT JOIN p ON p.dir = (CASE WHEN n.lang IN (SELECT dir FROM p) THEN n.lang ELSE '' END) AND starts_with(p.name, n.k) GROUP BY n.doc_id, n.lang, n.k, n.source""",
    "figure_decisions": """
SELECT doc_id, doc_id % 6 IN (0, 5) AS keep, CASE doc_id % 6 WHEN 0 THEN 'Map' ELSE '' END AS label,
  CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'text' WHEN 3 THEN 'provider rejected crop' WHEN 5 THEN 'a plate' ELSE 'verification inconclusive' END AS reason FROM documents""",
    "layout_page_profiles": f"""
WITH {_FEATURED}, pp AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM f)
SELECT source, pos::INT AS pos, dominant_flow, column_count AS column_count_estimate, n AS line_count, mean AS average_line_length, marker <> '' AS has_page_marker, len(entries) > 0 AS has_contents_entries FROM pp WHERE pos < 120""",
    "assets_manifest": """
SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS index, 'a/-' || doc_id || '-' || i AS path, lang AS label
FROM (SELECT source, doc_id, lang, unnest(range(doc_id % 4)) AS i FROM documents)""",
    "structure_records": f"""
WITH {_FEATURED}, {_HEADS}, k1 AS (SELECT source, role, count(*) AS n FROM f GROUP BY ALL), k2 AS (SELECT source, dominant_flow AS flow, count(*) AS n FROM f GROUP BY ALL),
a AS (SELECT source, '{{' || string_agg('"' || role || '":' || n, ',' ORDER BY role) || '}}' AS content_kinds FROM k1 GROUP BY source),
b AS (SELECT source, arg_max(flow, (n, flow)) AS dominant_flow, '{{' || string_agg('"' || flow || '":' || n, ',' ORDER BY flow) || '}}' AS flows FROM k2 GROUP BY source),
c AS (SELECT source, min(document_type) AS document_type, count(*) AS page_count_observed, sum(doc_id % 4)::BIGINT AS asset_count, least(count(*), 120)::INT AS profiles FROM f GROUP BY source),
v AS (SELECT source, lower(h) AS low, min((doc_id, pos, h)) AS spot FROM (SELECT source, doc_id, generate_subscripts(heads, 1) AS pos, unnest(heads) AS h FROM u) WHERE h <> '' GROUP BY ALL),
w AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY spot) AS place, spot FROM v),
h2 AS (SELECT source, CAST(to_json(list(spot[3] ORDER BY place)) AS VARCHAR) AS section_headings FROM w WHERE place <= 24 GROUP BY source)
SELECT c.*, content_kinds, coalesce(section_headings, '[]') AS section_headings, dominant_flow, flows FROM c JOIN a USING (source) JOIN b USING (source) LEFT JOIN h2 USING (source)""",
    "printed_lines": rf"""
WITH {_KEYED}, {_LINED}, x AS (SELECT doc_id, unnest(ls) AS x FROM l)
SELECT doc_id, count(*) FILTER (x <> '' AND length(x) <= 90 AND ((x = upper(x) AND length(x) >= 4) OR regexp_matches(lower(x), '^({"|".join(PRINTED_HEADS)})\b'))) AS headings,
  count(*) FILTER (regexp_matches(x, '^(page\s*)?[ivxlcdm\d]+$', 'i')) AS markers FROM x GROUP BY doc_id""",
    "block_marker_texts": f"""
WITH {_PUBLISHED} SELECT page, reading_order, CASE WHEN doc_id IS NULL THEN '' WHEN reading_order = 1 THEN 'again ' || lang WHEN reading_order = 2 THEN 'two' ELSE '' END AS extracted_text
FROM z LEFT JOIN documents ON doc_id = page""",
    "special_blocks": f"""
WITH {_PUBLISHED} SELECT page, CASE role WHEN 'table-region' THEN 'table' ELSE 'chart' END AS kind, count(*) AS blocks FROM z WHERE role IN ('table-region', 'chart-region') GROUP BY ALL""",
    "compare_material": "SELECT doc_id FROM documents WHERE (doc_id % 3 = 0 AND trim(coalesce(text, '')) <> '') OR doc_id % 2 = 1 OR doc_id % 5 = 0",
    "backfilled_structures": """
SELECT doc_id, doc_id % 4 <> 0 AND doc_id % 3 <> 0 AS backfilled, CASE WHEN doc_id % 4 = 0 THEN '{"semantic_units": [1], "layout_tree": [{"a": 1}], "layout_profile": {"b": 2}}'
  WHEN doc_id % 3 <> 0 THEN '{"made": ' || doc_id || '}' WHEN doc_id % 4 = 1 THEN '{"semantic_units": [], "layout_tree": [1], "layout_profile": {"b": 2}}' WHEN doc_id % 4 = 2 THEN '{}' END AS structure FROM documents""",
    "document_reviews": """
WITH b AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE doc_id % 10 BETWEEN 1 AND 5),
u AS (SELECT source, count(*) AS n, string_agg('| ' || doc_id || ' | ' || CASE WHEN doc_id % 4 = 0 THEN 'table-region' ELSE 'text-region' END || ' | top-left | 0.' || (doc_id % 10) || '0 |', chr(10) ORDER BY doc_id) FILTER (n <= 60) AS rows FROM b GROUP BY source),
p AS (SELECT source, count(*) AS n, string_agg('| figure |  | 3x? | `a/' || doc_id || '.png` |', chr(10) ORDER BY doc_id) AS rows FROM documents WHERE doc_id % 7 = 0 GROUP BY source),
d AS (SELECT source, count(*) AS n, count(*) FILTER (doc_id % 4 = 0) AS t FROM documents GROUP BY source)
SELECT d.source, md5('# Layout review' || chr(10) || chr(10) || '- Title: Untitled' || chr(10) || '- Document type: Book' || chr(10) || '- Dominant flow: single-flow' || chr(10) || '- Column estimate: 1' || chr(10)
  || '- Layout nodes: ' || d.n || chr(10) || '- Table blocks: ' || d.t || chr(10) || '- Chart blocks: 0' || chr(10) || '- Assets: ' || coalesce(p.n, 0) || chr(10) || '- Low-confidence blocks: ' || coalesce(u.n, 0) || chr(10)
  || chr(10) || '## Notes' || chr(10) || chr(10) || '- one note' || chr(10)
  || CASE WHEN u.n > 0 THEN chr(10) || '## Low-confidence blocks' || chr(10) || chr(10) || '| Source | Role | Zone | Confidence |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || u.rows || chr(10) ELSE '' END
  || CASE WHEN p.n > 0 THEN chr(10) || '## Assets' || chr(10) || chr(10) || '| Label | Zone | Size | Path |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || p.rows || chr(10) ELSE '' END) AS digest
FROM d LEFT JOIN u USING (source) LEFT JOIN p USING (source)""",
    "document_parts": f"""
WITH c AS (SELECT source, doc_id, {_strip("coalesce(text, '')")} AS t FROM documents),
s AS (SELECT source, doc_id, t, strlen(t) AS n, coalesce(sum(strlen(t) + 5) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM c WHERE t <> ''),
p AS (SELECT *, o // 1048576 AS part, CASE WHEN o = 0 THEN t ELSE chr(10) || chr(10) || chr(12) || chr(10) || chr(10) || t END AS piece FROM s)
SELECT source, part, min(CASE WHEN o = 0 THEN 0 ELSE o - 5 END) AS "offset", sum(strlen(piece))::BIGINT AS length, count(*) AS rows, md5(string_agg(piece, '' ORDER BY o)) AS digest FROM p GROUP BY source, part""",
    "run_manifest_lines": f"""
WITH r AS (SELECT lang AS run, doc_id, source, CASE WHEN {_strip("coalesce(text, '')")} <> '' THEN 'restored' ELSE 'failed' END AS status FROM documents)
SELECT run, 0 AS line, '{{"sources":' || count(*) || ',"failed":' || count(*) FILTER (status = 'failed') || '}}' AS json FROM r GROUP BY run
UNION ALL SELECT run, row_number() OVER (PARTITION BY run ORDER BY doc_id, source), '{{"source_index":' || doc_id || ',"label":"' || source || '","status":"' || status || '","failure_reason":""}}' FROM r""",
    "missing_asset_markers": """
WITH a AS (SELECT DISTINCT source, lang FROM documents)
SELECT source, 'a\\' || lang || '.png' AS path, '[image: ' || lang || ' map | a\\' || lang || '.png]' AS marker FROM a WHERE lang = 'de'""",
    "search_sources": f"WITH {_SOURCES}, z AS (SELECT source_id, CAST({_times(('inandti', 'ereat', 'tion'))} AS INT) AS score FROM hay) SELECT * FROM z WHERE score > 0 ORDER BY score DESC, source_id LIMIT 8",
    "select_sources": f"WITH {_SOURCES} SELECT source_id, {_points(('inandti', 'or', 'ereat', 'tion', 'is', 'there'))} + 5 + 22 AS score FROM hay ORDER BY score DESC, source_id LIMIT 10",
    "page_band_sources": f"""
WITH {_SOURCES} SELECT source_id, {_points(('statement', 'on', 'pages', '66-67', 'say', 'inandti', 'ereat'))} + 5 + 22 + CASE WHEN page_number IN (66, 67) THEN 40 ELSE 16 END AS score
FROM hay WHERE page_number BETWEEN 65 AND 68 ORDER BY score DESC, source_id LIMIT 10""",
    "pinned_sources": f"WITH {_SOURCES} SELECT source_id, source_no FROM src WHERE upper(source_id) IN ('S7', 'S12', 'S99999999') ORDER BY source_no LIMIT 10",
    "focus_sources": f"WITH {_SOURCES} SELECT source_id, label FROM src WHERE contains(lower(label), 'src7/') OR contains(lower(label), 's12') OR lower(source_id) IN ('src7/', 's12')",
    "query_terms": f"""
SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9-]+'), lambda t: t NOT IN ({_STOP}))[1:20], ' ') AS terms FROM conversations""",
    "visual_questions": "SELECT role, count(*) FILTER (regexp_matches(lower(coalesce(text, '')), 'see|look|visual|image|figure|diagram|photo|poster|signboard|chart|what does it show|what is shown|describe')) AS visual, count(*) AS turns FROM conversations GROUP BY role",
    "chat_titles": r"""
WITH w AS (SELECT conv_id, list_filter(string_split_regex(lower(regexp_replace(text, '[^A-Za-z\s]', '', 'g')), '\s+'), lambda x: x <> '') AS w FROM conversations WHERE turn = 0)
SELECT conv_id, array_to_string(list_transform(w[1:5], lambda x: upper(x[1]) || x[2:]), ' ') || CASE WHEN len(w) > 5 THEN '...' ELSE '' END AS title FROM w""",
    "chat_history_tail": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 4",
    "script_detection": "SELECT lang, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'Latin' ELSE '' END AS scripts, count(*) AS docs FROM documents GROUP BY ALL",
    "html_strip": "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest, length(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS chars FROM pages",
    "export_jsonl": rf"""
WITH p AS (SELECT doc_id, list_filter(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: {_strip('x')} <> '') AS ps,
  list_filter(string_split(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '["\\]', '', 'g'), chr(10) || chr(10)), lambda x: {_strip('x')} <> '') AS qs FROM documents)
SELECT doc_id, len(ps) + 1 AS rows, CAST(list_sum(list_transform(qs, lambda x, i: length(x) + length('{{"index":' || i || ',"text":""}}') + 1)) AS INT) AS chars FROM p""",
    "export_markdown": rf"""
WITH p AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: {_strip('x')}), lambda x: x <> ''), chr(10) || chr(10)) AS b FROM documents)
SELECT doc_id, md5({_strip("'<!-- Page 1 of 3 -->' || chr(10) || chr(10) || CASE WHEN b = '' THEN '[blank page]' ELSE b END || chr(10) || chr(10) || chr(12) || chr(10) || chr(10) || '<!-- Page 2 of 3 -->' || chr(10) || chr(10) || '[blank page]' || chr(10) || chr(10) || chr(12) || chr(10) || chr(10) || '<!-- Page 3 of 3 -->' || chr(10) || chr(10) || 'last page'")} || chr(10)) AS digest FROM p""",
    "chart_points": """
SELECT 'views' AS label, sum(CAST(l_quantity AS INT))::DOUBLE AS total, count(*) AS points FROM lineitem
UNION ALL SELECT 'clicks', sum(l_linenumber)::DOUBLE, count(*) FROM lineitem""",
    "translation_modes": """
WITH c AS (SELECT c_custkey, ['translate', 'off', 'same-language-cleanup', 'transliterate', 'metadata-only', 'auto', 'bilingual', 'auto', 'auto'][CAST(c_custkey % 9 AS INT) + 1] AS mode,
  lower(c_mktsegment) AS a, CASE WHEN c_nationkey % 3 = 0 THEN 'same' ELSE lower(c_mktsegment) END AS b FROM customer)
SELECT c_custkey, mode, CASE WHEN mode IN ('off', 'same-language-cleanup', 'metadata-only') THEN false WHEN mode IN ('translate', 'bilingual', 'transliterate') THEN true
  WHEN b = 'same' THEN false ELSE b <> 'de' END AS required,
  CASE WHEN mode <> 'auto' THEN mode ELSE 'off' END AS effective, mode AS profile FROM c""",
    "normalized_names": r"""
SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '^[a-z0-9-]+$') THEN lower(p_name) ELSE 'native' END AS backend,
  CASE WHEN p_size % 2 = 0 THEN 'strict-source' ELSE 'preserve-detected' END AS policy, CASE WHEN p_size % 3 = 0 THEN 'fast' ELSE 'balanced' END AS mode,
  regexp_matches(lower(p_type), 'vision|vl|llava|moondream|minicpm-v|gemma3|pixtral|gpt-4o|gpt-4\.1|gpt-5|claude|gemini|ocr') AS vision,
  ['figure-region', 'table-region', 'delete', 'separator-region', NULL][p_size % 5 + 1] AS role FROM part""",
    "failure_reasons": """
WITH e AS (SELECT *, CASE event_type WHEN 'error' THEN 'read timeout' WHEN 'signup' THEN 'connection lost' WHEN 'view' THEN 'no vision support' END AS err FROM events)
SELECT CASE WHEN value > 90 THEN 'model context or output limit reached' WHEN err = 'read timeout' THEN 'provider timeout' WHEN err = 'no vision support' THEN 'model does not support the selected script or language'
  WHEN err = 'connection lost' THEN 'network or API error' WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 4 = 0 THEN 'source unreadable or too blurry' ELSE 'model returned malformed output' END
  ELSE 'model returned malformed output' END AS reason, err IS NULL OR err <> 'no vision support' AS retryable, count(*) AS units FROM e GROUP BY ALL""",
    "slugs": r"""
WITH c AS (SELECT c_custkey, lower(c_mktsegment) AS seg, c_mktsegment AS s, c_name, regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') AS nm, regexp_replace(c_name, '[^A-Za-z0-9_.-]+', '-', 'g') AS pn FROM customer)
SELECT c_custkey, seg || '-' || nm AS slug, seg || '-' || nm AS ascii, s || '-..-' || pn AS profile,
  seg || '/' || CASE WHEN c_custkey < 10000 THEN lpad(CAST(c_custkey AS VARCHAR), 4, '0') ELSE CAST(c_custkey AS VARCHAR) END || '-' || nm AS folder, s AS parent FROM c""",
    "durations": """
WITH s AS (SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS t FROM orders)
SELECT o_orderkey, CASE WHEN t >= 3600 THEN (t // 3600) || 'h ' || (t % 3600 // 60) || 'm ' || (t % 60) || 's' WHEN t >= 60 THEN (t // 60) || 'm ' || (t % 60) || 's' ELSE t || 's' END AS elapsed FROM s""",
    "review_budget": rf"""
WITH d AS (
  SELECT source, doc_id, {_strip("coalesce(text, '')")} AS t FROM documents
), m AS (
  SELECT source, doc_id, t <> '' AND (regexp_matches(t, '(?s)\{{.*\}}') OR contains(t, '�') OR regexp_matches(t, '{"|".join(f"{c}{{6,}}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")}')
    OR (length(t) > 180 AND length(regexp_replace(t, '[\p{{L}}\p{{N}}\s]', '', 'g')) / length(t) > 0.52)) AS damaged FROM d
)
SELECT source, doc_id, damaged, damaged AND sum(damaged::INT) OVER (PARTITION BY source ORDER BY doc_id) <= 3 AS reviewed FROM m""",
    "usage_sentences": f"""
WITH {_UNITS}, t AS (SELECT run, sum(n) AS s, bool_or(n > 90) AS cut FROM u GROUP BY run)
SELECT seq, 'tokens this page: ' || n * 3 || ' (input ' || n || ', output ' || n * 2 || '); run total: ' || s * 3 || ' (input ' || s || ', output ' || s * 2 || ')'
  || CASE WHEN cut THEN ' truncated' ELSE '' END AS said FROM u JOIN t USING (run)""",
    "overlay_boxes": f"""
WITH {_BOXES} SELECT page, round(sum(round_even(w * 100.0::DOUBLE / 1000, 3)), 3) AS widths, max(round_even("left" * 100.0::DOUBLE / 1000, 3)) AS last_left,
  min(round_even(top * 100.0::DOUBLE / 1500, 3)) AS first_top FROM b2 GROUP BY page""",
    "figure_candidates": f"""
WITH {_BOXES}, p AS (
  SELECT page, round_even(least(1.0::DOUBLE, CASE WHEN area BETWEEN 0.04 AND 0.42 THEN 0.30::DOUBLE WHEN area BETWEEN 0.025 AND 0.55 THEN 0.18::DOUBLE ELSE 0 END
    + CASE WHEN dark BETWEEN 0.10 AND 0.55 THEN 0.25::DOUBLE WHEN dark BETWEEN 0.06 AND 0.70 THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN mid >= 0.12 THEN 0.08::DOUBLE ELSE 0 END
    + CASE WHEN w / h BETWEEN 0.45 AND 2.8 THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN wr >= 0.18 AND hr >= 0.12 THEN 0.15::DOUBLE ELSE 0 END), 4) AS score FROM b3 WHERE fig
)
SELECT page, least(count(*), 4) AS figures, max(score) AS best FROM p WHERE score >= 0.34 GROUP BY page""",
    "best_outputs": """
WITH f AS (SELECT source, doc_id, ['final', 'translated', 'restored', 'draft'][CAST(doc_id % 4 AS INT) + 1] || '__' || lang || ['.json', '.txt', '.md'][CAST(doc_id % 3 AS INT) + 1] AS name,
  doc_id % 4 * 10 + [3, 2, 1][CAST(doc_id % 3 AS INT) + 1] AS rank FROM documents)
SELECT source, arg_min(name, (rank, name)) AS name FROM f GROUP BY source""",
    "page_records": """
WITH r AS (SELECT doc_id % 50 AS page, source, doc_id AS record, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY source, doc_id) AS ix FROM documents)
SELECT p.page, source, record FROM range(60) AS p(page) LEFT JOIN r ON p.page = r.page AND ix = 1""",
    "compare_outputs": r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS a,
  CASE WHEN doc_id % 10 <> 0 THEN list_filter(string_split_regex(replace(text, 'the ', 'THE '), '\s+'), lambda x: x <> '') END AS b FROM documents)
SELECT doc_id, len(a) AS source_words, len(b) AS output_words, len(list_distinct(list_filter(a, lambda x: NOT list_contains(coalesce(b, []), x)))) AS words_gone,
  len(list_distinct(list_filter(coalesce(b, []), lambda x: NOT list_contains(a, x)))) AS words_new FROM w""",
    "best_stage_pieces": """
WITH p AS (SELECT doc_id % 40 AS source_index, doc_id % 3 AS r FROM documents WHERE doc_id % 3 > 0 AND regexp_matches(text, '\\S')),
b AS (SELECT source_index, min(r) AS r FROM p GROUP BY 1)
SELECT source_index, CASE r WHEN 1 THEN 'translated' ELSE 'restored' END AS stage, count(*) AS pieces FROM p JOIN b USING (source_index, r) GROUP BY ALL""",
    "run_state": f"WITH {_UNITS} SELECT run, event_type AS key, arg_max(n * 3, seq) AS value FROM u GROUP BY ALL",
    "run_manifests": "SELECT lang AS run, count(*) AS sources FROM documents GROUP BY lang",
    "fallback_titles": "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title FROM part",
    "content_features": f"WITH {_FEATURED} SELECT doc_id, array_to_string(features, ',') AS features FROM f",
    "layout_class": f"WITH {_FEATURED} SELECT layout, count(*) AS pages FROM f GROUP BY ALL",
    "page_profile": f"WITH {_FEATURED} SELECT doc_id, dominant_flow, column_count, n AS line_count, mean AS avg_line_length FROM f",
    "low_confidence_pages": rf"""
WITH {_FEATURED}, c AS (
  SELECT doc_id, role, 0.48::DOUBLE + CASE WHEN role IN ('title', 'contents', 'chapter', 'section', 'preface', 'abstract') THEN 0.18::DOUBLE ELSE 0 END
    - CASE WHEN role IN ('marginalia', 'damaged') THEN 0.08::DOUBLE ELSE 0 END + least(length(text) / 1800.0::DOUBLE, 0.2::DOUBLE)
    - CASE WHEN regexp_matches(lower(text), '\[unclear\]|\[missing text\]') THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN marker <> '' THEN 0.03::DOUBLE ELSE 0 END AS v FROM f
), z AS (SELECT doc_id, role, round_even(greatest(0.05::DOUBLE, least(v, 0.99::DOUBLE)), 2) AS confidence FROM c)
SELECT * FROM z WHERE confidence < 0.55""",
    "layout_profile": f"""
WITH {_FEATURED}, c AS (SELECT document_type, dominant_flow AS flow, count(*) AS n, max(column_count) AS most FROM f GROUP BY ALL),
g AS (SELECT document_type, arg_max(flow, (n, flow)) AS dominant_flow, greatest(1, max(most)) AS column_count_estimate,
  '{{' || string_agg('"' || flow || '":' || n, ',' ORDER BY flow) || '}}' AS flows, list(flow) AS held FROM c GROUP BY 1)
SELECT document_type, dominant_flow, column_count_estimate, flows, concat_ws(' ',
  CASE WHEN column_count_estimate > 1 THEN 'Likely ' || column_count_estimate || '-column page structure on some pages.' END,
  CASE WHEN list_contains(held, 'front-matter') THEN 'Front matter detected on at least one page.' END,
  CASE WHEN list_contains(held, 'structured-list') THEN 'List-like pages such as contents or references detected.' END,
  CASE WHEN list_contains(held, 'tabular') THEN 'Tabular pages detected and should keep row/cell order.' END,
  CASE WHEN list_contains(held, 'chart-led') THEN 'Chart-like pages detected and should keep labels and numeric signals.' END,
  CASE WHEN dominant_flow = 'dense-prose' THEN 'Pages are text-dense and should stay paragraph-oriented.' END) AS notes FROM g""",
    "layout_tree": f"""
WITH {_FEATURED}, z AS (SELECT doc_id, role, coalesce(nullif(list_position(['title', 'cover', 'cover-sheet', 'masthead', 'contents', 'preface', 'foreword', 'introduction', 'chapter', 'section',
  'article', 'body', 'appendix', 'index', 'references', 'bibliography', 'footnotes'], role), 0), 12) AS rank FROM f)
SELECT rank, role, count(*) AS nodes, max(doc_id) AS last FROM z GROUP BY ALL""",
    "split_chunks": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, chunk_index, length(chunk) AS chars, md5(chunk) AS digest FROM chunks",
    "chunk_stats_by_lang": f"""
WITH RECURSIVE {_CHUNKS} SELECT lang, count(*) AS chunks, sum(length(chunk))::BIGINT AS chars, max(length(chunk)) AS longest FROM chunks JOIN documents USING (doc_id) GROUP BY lang""",
    "run_documents": f"""
WITH RECURSIVE {_RESTORED}, j AS (SELECT doc_id, string_agg(restored_text, chr(10) || chr(10) || chr(12) || chr(10) || chr(10) ORDER BY chunk_index) AS t FROM restored WHERE restored_text <> '' GROUP BY doc_id)
SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM j""",
    "run_structure": f"""
WITH RECURSIVE {_RESTORED}, k AS (SELECT doc_id, chunk_index AS page_index, 'Book' AS document_type, restored_text AS text, lang FROM restored JOIN documents USING (doc_id)),
{_LINED}, {_OBSERVE}, {_FEATURE}
SELECT lang, role, dominant_flow, count(*) AS pages, sum(n)::BIGINT AS lines, count(*) FILTER (len(notes) > 0) AS with_footnotes FROM f GROUP BY ALL""",
    "dedupe_boxes": f"""
WITH RECURSIVE {_BOXES}, a AS (SELECT page, "left", top, "right", bottom, CAST(w AS BIGINT) * h AS size, row_number() OVER (PARTITION BY page ORDER BY CAST(w AS BIGINT) * h DESC, top, "left", "right", bottom) AS i FROM b2),
s(page, i, kept) AS (
  SELECT page, i, [{{'l': "left", 't': top, 'r': "right", 'b': bottom, 'z': size}}] FROM a WHERE i = 1
  UNION ALL SELECT a.page, a.i, CASE WHEN len(list_filter(kept, lambda k: least(k.r, "right") > greatest(k.l, "left") AND least(k.b, bottom) > greatest(k.t, top)
      AND CAST(least(k.r, "right") - greatest(k.l, "left") AS BIGINT) * (least(k.b, bottom) - greatest(k.t, top)) / greatest(least(k.z, size), 1)::DOUBLE > 0.40)) > 0
    THEN kept ELSE list_append(kept, {{'l': "left", 't': top, 'r': "right", 'b': bottom, 'z': size}}) END
  FROM s JOIN a ON a.page = s.page AND a.i = s.i + 1)
SELECT page, CAST(max(len(kept)) AS BIGINT) AS kept FROM s GROUP BY page""",
    "merge_blocks": f"""
WITH {_BOXES}, d AS (SELECT *, row_number() OVER (PARTITION BY page, block ORDER BY "left", top, "right", bottom, dark, mid) AS ix FROM b4),
i AS (SELECT *, block - 2 * row_number() OVER (PARTITION BY page, block % 2 ORDER BY block) AS island FROM d WHERE ix = 1),
g AS (SELECT page, min("left") AS l, min(top) AS t, max("right") AS r, max(bottom) AS b FROM i GROUP BY page, block % 2, island)
SELECT page, count(*) AS blocks, max(r - l) AS widest, max(b - t) AS highest FROM g GROUP BY page""",
    "relabelled_blocks": f"""
WITH {_BOXES}, d AS (SELECT *, row_number() OVER (PARTITION BY page, block ORDER BY "left", top, "right", bottom, dark, mid) AS ix FROM b4)
SELECT block, count(*) AS blocks, count(*) FILTER (block % 3 = 0 OR role = 'figure-region') AS figures FROM d WHERE ix = 1 AND block % 3 <> 1 GROUP BY block""",
    "review_counters": f"""
WITH {_SCORED} SELECT page_zone, count(*) AS nodes, count(*) FILTER (role = 'table-region') AS tables, count(*) FILTER (role = 'chart-region') AS charts,
  count(*) FILTER (role = 'figure-region') AS assets, count(*) FILTER (c < 0.55) AS low_confidence FROM sc GROUP BY 1""",
    "layout_review": f"""
WITH {_SCORED}, g AS (
  SELECT page, '# Layout review' || chr(10) || chr(10) || 'nodes ' || count(*) || ', tables ' || count(*) FILTER (role = 'table-region') || ', charts ' || count(*) FILTER (role = 'chart-region')
    || ', assets ' || count(*) FILTER (role = 'figure-region') || ', low confidence ' || count(*) FILTER (c < 0.55) || chr(10) AS head,
    string_agg('- block ' || block || ': ' || role || ', ' || format('{{:.2f}}', c), chr(10) ORDER BY c, block, role) FILTER (c < 0.55) AS rows FROM sc GROUP BY page)
SELECT page, md5(head || coalesce(chr(10) || rows || chr(10), '')) AS digest FROM g""",
    "block_maps": f"""
WITH {_BOXES}, m AS (
  SELECT page, reading_order, CASE role WHEN 'text-region' THEN 't' WHEN 'title-region' THEN 'T' WHEN 'table-region' THEN '#' WHEN 'figure-region' THEN 'F' WHEN 'chart-region' THEN 'C'
      WHEN 'running-header-or-footer' THEN '-' ELSE '.' END AS mark, CAST(floor("left" * 38 / 1000.0) AS BIGINT) AS x0, CAST(ceil("right" * 38 / 1000.0) AS BIGINT) AS x9,
    CAST(floor(top * 14 / 1500.0) AS BIGINT) AS y0, CAST(ceil(bottom * 14 / 1500.0) AS BIGINT) AS y9 FROM ordered WHERE reading_order <= 120
), c AS (
  SELECT page, x, y, arg_max(mark, reading_order) AS mark
  FROM (SELECT *, unnest(range(greatest(y0, 0), least(greatest(y0 + 1, y9), 14))) AS y FROM (SELECT *, unnest(range(greatest(x0, 0), least(greatest(x0 + 1, x9), 38))) AS x FROM m)) GROUP BY page, x, y
), r AS (
  SELECT p.page, ys.y, rtrim(string_agg(coalesce(mark, ' '), '' ORDER BY xs.x)) AS row
  FROM (SELECT DISTINCT page FROM m) p CROSS JOIN range(14) ys(y) CROSS JOIN range(38) xs(x) LEFT JOIN c ON c.page = p.page AND c.x = xs.x AND c.y = ys.y GROUP BY p.page, ys.y
)
SELECT page, md5(string_agg(row, chr(10) ORDER BY y)) AS digest FROM r GROUP BY page""",
    "suspicious_chunks": rf"""
WITH RECURSIVE {_RESTORED}, m AS (
  SELECT *, restored_text <> '' AND (regexp_matches(restored_text, '(?s)\{{.*\}}') OR contains(restored_text, '�') OR regexp_matches(restored_text, '{"|".join(f"{c}{{6,}}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")}')
    OR (length(restored_text) > 180 AND length(regexp_replace(restored_text, '[\p{{L}}\p{{N}}\s]', '', 'g')) / length(restored_text) > 0.52)) AS damaged FROM restored
), w AS (SELECT *, damaged AND sum(damaged::INT) OVER (PARTITION BY doc_id ORDER BY chunk_index) <= 1 AS reviewed FROM m)
SELECT damaged, reviewed, CASE WHEN meta THEN 'fallback' ELSE 'restored' END AS status, count(*) AS chunks FROM w GROUP BY ALL""",
    "archive_numbering": f"""
WITH RECURSIVE {_CHUNKS} SELECT source AS path, doc_id AS pos, row_number() OVER (PARTITION BY source ORDER BY doc_id, chunk_index) AS chunk_index, length(chunk) AS chars
FROM documents LEFT JOIN chunks USING (doc_id)""",
    "run_sources": f"""
WITH c AS (SELECT source AS label, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS part, doc_id AS page_number, {_strip("coalesce(text, '')")} AS t FROM documents),
a AS (SELECT label, 0 AS part, 'page-record' AS kind, arg_min(page_number, part) AS page_number, string_agg(t, chr(10) || chr(10) ORDER BY part) AS t FROM c WHERE t <> '' GROUP BY label
  UNION ALL SELECT label, part, 'chunk', page_number, t FROM c WHERE t <> ''),
n AS (SELECT *, row_number() OVER (ORDER BY label, part) AS source_no FROM a)
SELECT source_no, 'S' || source_no AS source_id, label, kind, part, page_number, md5(t) AS digest FROM n""",
    "structured_blocks": rf"""
WITH p AS (SELECT unnest({_lines('text')}) AS p FROM documents),
q AS (SELECT p, regexp_replace(p, '\s+', ' ', 'g') AS one, replace(lower(p), 'page ', '') AS low FROM p),
k AS (SELECT p, CASE WHEN regexp_matches(p, '^\[image:\s*(.+?)\s*\|\s*([^\]]+)\]$', 'i') THEN 'figure-marker' WHEN regexp_matches(low, '^(\d+|[ivxlcdm]+)$') THEN 'page-marker'
  WHEN regexp_matches(lower(p), 'chart|graph|axis|legend|plot') THEN 'chart'
  WHEN len(string_split(one, ' ')) <= 12 AND length(regexp_replace(one, '[^\p{{L}}]', '', 'g')) > 0
    AND length(regexp_replace(one, '[^\p{{Lu}}]', '', 'g')) >= 0.72 * length(regexp_replace(one, '[^\p{{L}}]', '', 'g')) THEN 'heading' ELSE 'paragraph' END AS kind FROM q)
SELECT kind, count(*) AS blocks, sum(length(p))::BIGINT AS chars FROM k GROUP BY kind""",
    "retry_decisions": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 6 AS n FROM documents)
SELECT doc_id, CASE WHEN n = 5 AND {_strip('text')} = '' THEN false WHEN regexp_matches(text, '\[BLOCK[ \n]') AND n <> 3 THEN false
    WHEN n IN (1, 4) THEN true WHEN n = 3 THEN false ELSE regexp_matches(lower(text), {_META}) END AS retry,
  array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), 'column|multi-column|two-column') THEN 'column order and reading flow' END,
    CASE WHEN regexp_matches(lower(text), 'table|rows|cells') THEN 'table rows and cell boundaries' END,
    CASE WHEN regexp_matches(lower(text), 'figure|image|plate|illustration') THEN 'figure captions and image references' END,
    CASE WHEN regexp_matches(lower(text), 'contents|index|toc') THEN 'contents entries and page numbers' END,
    CASE WHEN regexp_matches(lower(text), 'footnote|note|citation') THEN 'footnotes and citations' END,
    CASE WHEN regexp_matches(lower(text), 'heading|chapter|section|title') THEN 'headings and section boundaries' END,
    CASE WHEN regexp_matches(lower(text), 'page marker|folio|page number') THEN 'page markers and folios' END], lambda x: x IS NOT NULL)[1:4], '|') AS hints FROM t""",
    "consistency_scan": rf"""
WITH k AS (SELECT doc_id, source, 'Book' AS document_type, 9 AS page_index, text FROM documents), {_LINED}, {_OBSERVE}, {_FEATURE},
v AS (
  SELECT source, doc_id, {_strip("coalesce(text, '')")} AS t, ls[1:80] AS head, ls, tabular, charted, spaced, entries FROM f
), w AS (
  SELECT source, doc_id, t <> '' AS live, CASE WHEN contains(t, chr(10) || chr(10)) THEN 'blank line between paragraphs' ELSE 'single line breaks preserved' END AS para,
    list_filter(list_transform(ls[1:8], lambda x: CASE WHEN len(string_split({_collapse('x')}, ' ')) BETWEEN 1 AND 10 AND x = upper(x) AND regexp_matches(x, '\p{{L}}') THEN 'short uppercase headings preserved'
      WHEN regexp_matches(x, '^(chapter|section|part|book|canto|mandala)\b', 'i') THEN 'explicit chapter/section headings preserved' END), lambda x: x IS NOT NULL)[1] AS heading,
    list_filter(list_transform(list_concat(ls[1:4], ls[greatest(len(ls) - 3, 1):]), lambda x: CASE WHEN regexp_matches(x, {_MARKER}, 'i') THEN 'standalone page markers preserved'
      WHEN regexp_matches(x, '\bpage\s+\d+\b', 'i') THEN 'page labels preserved' END), lambda x: x IS NOT NULL)[1] AS marker,
    list_filter([CASE WHEN regexp_matches(array_to_string(head, chr(10)), '\s{{3,}}') THEN 'preserve visible table or column spacing when clear' END,
      CASE WHEN len(list_filter(head, lambda x: starts_with(x, '*') OR starts_with(x, '-'))) > 0 THEN 'preserve list item breaks' END,
      CASE WHEN regexp_matches(array_to_string(head, chr(10)), '\[\d+\]|\(\d+\)|\b\d+\.') THEN 'preserve numbered references and footnote markers' END], lambda x: x IS NOT NULL) AS notes,
    CASE WHEN regexp_matches(t, '[A-Za-z]') THEN ['Latin'] ELSE [] END AS scripts,
    list_filter([CASE WHEN tabular THEN 'table-like' END, CASE WHEN charted THEN 'chart-like' END, CASE WHEN spaced THEN 'multi-column' END, CASE WHEN len(entries) > 0 THEN 'contents-like' END], lambda x: x IS NOT NULL) AS structs,
    array_to_string((list_filter(string_split_regex(t, '\s+'), lambda x: x <> ''))[-100:], ' ') AS recent FROM v
), seen AS (
  SELECT source, kind, value, min((doc_id, pos)) AS spot FROM (
    SELECT source, doc_id, 'notes' AS kind, generate_subscripts(notes, 1) AS pos, unnest(notes) AS value FROM w WHERE live
    UNION ALL SELECT source, doc_id, 'scripts', generate_subscripts(scripts, 1), unnest(scripts) FROM w WHERE live
    UNION ALL SELECT source, doc_id, 'structs', generate_subscripts(structs, 1), unnest(structs) FROM w WHERE live) GROUP BY ALL
), lists AS (
  SELECT w.source, w.doc_id, string_agg(value, '|' ORDER BY spot) FILTER (kind = 'notes') AS notes, string_agg(value, '|' ORDER BY spot) FILTER (kind = 'scripts') AS scripts,
    string_agg(value, '|' ORDER BY spot) FILTER (kind = 'structs') AS structs FROM w JOIN seen ON seen.source = w.source AND spot[1] < w.doc_id GROUP BY ALL
), state AS (
  SELECT source, doc_id, coalesce(sum(live::INT) OVER b, 0)::BIGINT AS observed_pages, coalesce(first(CASE WHEN live THEN para END IGNORE NULLS) OVER b, '') AS paragraph_style,
    coalesce(first(CASE WHEN live THEN heading END IGNORE NULLS) OVER b, '') AS heading_style, coalesce(first(CASE WHEN live THEN marker END IGNORE NULLS) OVER b, '') AS page_marker_style,
    md5(coalesce(last(CASE WHEN live THEN recent END IGNORE NULLS) OVER b, '')) AS recent
  FROM w WINDOW b AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT state.*, coalesce(notes, '') AS notes, coalesce(scripts, '') AS scripts, coalesce(structs, '') AS structures FROM state LEFT JOIN lists USING (source, doc_id)""",
    "question_pages": """
SELECT conv_id, turn, array_to_string(list_sort(list_distinct([turn, conv_id % 90, 99])), ',') AS pages FROM conversations""",
    "parse_translation_reply": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_strip("coalesce(text, '')")} AS clean, doc_id % 6 AS n FROM documents),
m AS (SELECT *, CASE WHEN n = 5 AND regexp_matches(lower(clean), {_META}) THEN 4 ELSE n END AS k FROM t)
SELECT doc_id, md5(CASE WHEN n = 3 THEN '.' ELSE clean END) AS digest,
  CASE WHEN k = 4 THEN 'fallback' WHEN n = 3 THEN 'restored' WHEN n < 3 AND clean = '' THEN 'blank' ELSE 'translated' END AS status,
  CASE WHEN k = 4 THEN 'model returned malformed output' WHEN n < 3 AND clean = '' THEN 'blank page or no readable text' ELSE '' END AS failure_reason FROM m""",
    "lenient_model_reply": rf"""
WITH t AS (SELECT doc_id, {_strip("coalesce(text, '')")} AS clean, doc_id % 6 AS n FROM documents),
m AS (SELECT *, CASE WHEN n = 5 AND regexp_matches(lower(clean), {_META}) THEN 4 ELSE n END AS k FROM t)
SELECT doc_id, md5(CASE WHEN n = 3 THEN '.' WHEN k = 5 THEN regexp_replace(clean, '\}}$', '') || ',"x":}}' ELSE clean END) AS digest,
  CASE WHEN k = 4 THEN 'fallback' WHEN n < 3 AND clean = '' THEN 'blank' ELSE 'restored' END AS status FROM m""",
    "picture_reply_text": f"SELECT doc_id, md5({_strip("coalesce(text, '')")}) AS digest FROM documents",
    "excerpts": rf"""
WITH x AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_collapse("coalesce(text, '')")} AS one FROM documents),
y AS (SELECT *, list_filter(string_split(one, ' '), lambda w: w <> '') AS w, instr(lower(text), 'the') AS spot FROM x)
SELECT doc_id, CASE WHEN length(one) <= 120 THEN one ELSE rtrim(one[1:119]) || '…' END AS excerpt, md5(array_to_string(w[greatest(len(w) - 99, 1):], ' ')) AS recent, md5(lower(one)) AS matched,
  md5(regexp_replace(substring(text, CASE WHEN spot > 0 THEN greatest(spot - 50, 1) ELSE 1 END, 160), '\s+', ' ', 'g')) AS hit, concat_ws('; ', nullif(lang, ''), nullif(source, '')) AS notes FROM y""",
    "table_markup": """
WITH r AS (SELECT l_orderkey AS page, ['item', CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(CAST(l_quantity AS INT) AS VARCHAR)] AS c, l_linenumber AS o FROM lineitem),
n AS (SELECT page, c, row_number() OVER (PARTITION BY page ORDER BY o, array_to_string(c, ' | ')) AS i FROM r)
SELECT page, md5(string_agg('| ' || array_to_string(c, ' | ') || ' |' || CASE WHEN i = 1 THEN chr(10) || '| --- | --- | --- | --- |' ELSE '' END, chr(10) ORDER BY i)) AS markdown,
  md5('<table class="data-table">' || string_agg('<tr>' || array_to_string(list_transform(c, lambda x: CASE WHEN i = 1 THEN '<th>' || x || '</th>' ELSE '<td>' || x || '</td>' END), '') || '</tr>', '' ORDER BY i) || '</table>') AS html
FROM n GROUP BY page""",
    "document_structure": rf"""
WITH {_FEATURED}, h AS (
  SELECT *, CASE WHEN page_index <= 2 THEN ls[1:2] ELSE [] END AS titles,
    list_filter(ls[1:12], lambda x: length(x) BETWEEN 2 AND 90 AND (x = upper(x) OR regexp_matches(x, '^(chapter|section|part|book|preface|contents|index|appendix)\b', 'i')))[1:6] AS heads,
    list_transform(ls, lambda x: {_collapse('x')}) AS ones FROM f
), c AS (
  SELECT *, list_filter(ones[1:30], lambda x: length(x) <= 140 AND regexp_matches(x, '\b(by|author|edited by|editor|translated by|translator|compiled by)\b', 'i')) AS by0,
    list_filter(ones[1:50], lambda x: length(x) <= 160 AND regexp_matches(x, '\b(published by|publisher|press|publication|publications|printing|printer)\b', 'i')) AS press0 FROM h
), d AS (
  SELECT *, list_filter(by0, lambda v, i: list_position(list_transform(by0, lambda z: lower(z)), lower(v)) = i)[1:8] AS people,
    list_filter(press0, lambda v, i: list_position(list_transform(press0, lambda z: lower(z)), lower(v)) = i)[1:6] AS press FROM c
), v AS (
  SELECT source, doc_id, 'title_candidates' AS kind, generate_subscripts(titles, 1) AS pos, unnest(titles) AS v FROM d
  UNION ALL SELECT source, doc_id, 'section_headings', generate_subscripts(heads, 1), unnest(heads) FROM d
  UNION ALL SELECT source, doc_id, 'page_markers', 1, marker FROM d WHERE marker <> ''
  UNION ALL SELECT source, doc_id, 'contributors', generate_subscripts(people, 1), unnest(people) FROM d
  UNION ALL SELECT source, doc_id, 'publishers', generate_subscripts(press, 1), unnest(press) FROM d
), g AS (
  SELECT source, kind, min((doc_id, pos)) AS spot, arg_min({_strip('v')}, (doc_id, pos)) AS v FROM v WHERE {_strip('v')} <> '' GROUP BY source, kind, lower({_strip('v')})
), w AS (
  SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY spot) AS place FROM g
), lists AS (
  SELECT source, kind, list(v ORDER BY place) AS vs FROM w WHERE place <= CASE kind WHEN 'title_candidates' THEN 8 WHEN 'contributors' THEN 12 WHEN 'publishers' THEN 8 ELSE 24 END GROUP BY source, kind
), en AS (
  SELECT source, list(e ORDER BY doc_id, pos)[1:120] AS es FROM (SELECT source, doc_id, generate_subscripts(entries, 1) AS pos, unnest(entries) AS e FROM d WHERE role = 'contents') GROUP BY source
), nt AS (
  SELECT source, list(e ORDER BY doc_id, pos)[1:120] AS es FROM (SELECT source, doc_id, generate_subscripts(notes, 1) AS pos, unnest(notes) AS e FROM d) GROUP BY source
), base AS (
  SELECT source, count(*) AS page_count_observed, count(*) FILTER (tabular) AS table_block_count, count(*) FILTER (charted) AS chart_block_count FROM d GROUP BY source
)
SELECT base.*, {", ".join(f"coalesce(CAST(to_json((SELECT vs FROM lists WHERE lists.source = base.source AND kind = '{k}')) AS VARCHAR), '[]') AS {k}" for k in ("title_candidates", "section_headings", "page_markers", "contributors", "publishers"))},
  coalesce(CAST(to_json(en.es) AS VARCHAR), '[]') AS contents_entries, coalesce(CAST(to_json(nt.es) AS VARCHAR), '[]') AS footnotes
FROM base LEFT JOIN en ON en.source = base.source LEFT JOIN nt ON nt.source = base.source""",
    "export_layout_markdown": f"""
WITH {_PUBLISHED_WHOLE}, b AS (SELECT *, array_to_string(said, chr(10) || chr(10)) AS t FROM z),
m AS (SELECT page, reading_order, CASE WHEN role = 'figure-region' THEN CASE WHEN page % 2 = 0 THEN '![](a/' || page || '-' || reading_order || '.png)' END
  WHEN role = 'table-region' THEN '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' WHEN t IS NULL THEN NULL WHEN role = 'title-region' THEN '## ' || t
  WHEN role = 'running-header-or-footer' THEN '<!-- ' || t || ' -->' ELSE t END AS part FROM b)
SELECT page, md5(coalesce(string_agg(part, chr(10) || chr(10) ORDER BY reading_order), '')) AS digest FROM m GROUP BY page""",
    "export_layout_html": f"""
WITH {_PUBLISHED}, b AS (SELECT *, array_to_string(said, chr(10) || chr(10)) AS t FROM z),
m AS (SELECT page, reading_order, CASE WHEN role = 'figure-region' THEN CASE WHEN page % 2 = 0 THEN '<figure class="figure-marker"><img src="a/' || page || '-' || reading_order || '.png" alt="" /></figure>' END
  WHEN role = 'table-region' THEN '<table class="data-table"><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>' WHEN t IS NULL THEN NULL
  WHEN role = 'title-region' THEN '<h2>' || {_escaped('t')} || '</h2>' WHEN role = 'running-header-or-footer' THEN '<p class="page-marker">' || {_escaped('t')} || '</p>'
  ELSE array_to_string(list_transform(said, lambda x: '<p>' || {_escaped('x')} || '</p>'), chr(10)) END AS part FROM b)
SELECT page, md5(coalesce(string_agg(part, chr(10) ORDER BY reading_order), '')) AS digest FROM m GROUP BY page""",
    "unit_blocks": rf"""
WITH {_FEATURED}, {_HEADS}, m AS (
  SELECT doc_id, heading, {_UNIT} AS md,
    list_filter([
      CASE WHEN len(own_entries) > 0 THEN '<section class="contents semantic semantic-contents"><h2>Contents</h2><table>' || array_to_string(list_transform(own_entries,
        lambda e: '<tr><td>' || {_escaped('e.title')} || '</td><td>' || {_escaped('e.page')} || '</td></tr>'), '') || '</table></section>' END,
      CASE WHEN heading <> '' AND role = 'title' THEN '<section class="title-page semantic semantic-title"><h2>' || {_escaped('heading')} || '</h2></section>'
        WHEN heading <> '' AND role IN ({", ".join(f"'{r}'" for r in HEADED_ROLES)}) THEN '<section class="semantic semantic-' || role || '"><h2>' || {_escaped('heading')} || '</h2></section>' END,
      CASE WHEN len(notes) > 0 THEN '<section class="notes semantic semantic-footnotes"><h2>Notes</h2><ol>' || array_to_string(list_transform(notes,
        lambda e: '<li><span>' || {_escaped('e.marker')} || '</span> ' || {_escaped('e.text')} || '</li>'), '') || '</ol></section>' END], lambda x: x IS NOT NULL) AS ht FROM u)
SELECT doc_id, heading, md5(array_to_string(md, chr(10) || chr(10))) AS markdown, md5(array_to_string(ht, chr(10))) AS html FROM m""",
    "asset_markers_inserted": rf"""
WITH p AS (SELECT doc_id, text, list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS ps FROM documents),
q AS (SELECT *, [lower({_collapse('x')}) for x in ps] AS ms, '[image: plate 1 | a\1-' || doc_id || '.png]' AS m1, '[image: plate 2 | a\2-' || doc_id || '.png]' AS m2, '[image: plate 3 | a\3-' || doc_id || '.png]' AS m3 FROM p),
r AS (SELECT *, CASE WHEN length(ms[2]) >= 40 THEN list_position([contains(m, ms[2][1:120]) for m in ms], true) END AS hit FROM q)
SELECT doc_id, md5(array_to_string(CASE WHEN len(ps) = 0 THEN [m1, m2, m3] WHEN hit > 0 THEN list_concat([m1], ps[1:hit], [m3], ps[hit + 1:], [m2]) ELSE list_concat([m1], ps, [m2, m3]) END, chr(10) || chr(10))) AS digest FROM r""",
    "publication_credits": rf"""
WITH x AS (SELECT doc_id, list_transform({_lines('text')}, lambda x: regexp_replace(x, '\s+', ' ', 'g')) AS ls FROM documents),
y AS (SELECT doc_id, list_filter(ls[1:30], lambda x: length(x) <= 140 AND regexp_matches(x, '\b(by|author|edited by|editor|translated by|translator|compiled by)\b', 'i')) AS c,
  list_filter(ls[1:50], lambda x: length(x) <= 160 AND regexp_matches(x, '\b(published by|publisher|press|publication|publications|printing|printer)\b', 'i')) AS p FROM x),
z AS (SELECT doc_id, list_concat(list_filter(c, lambda v, i: list_position(list_transform(c, lambda z: lower(z)), lower(v)) = i)[1:8],
  list_filter(p, lambda v, i: list_position(list_transform(p, lambda z: lower(z)), lower(v)) = i)[1:6]) AS b FROM y)
SELECT doc_id, array_to_string(list_filter(b, lambda v, i: list_position(list_transform(b, lambda z: lower(z)), lower(v)) = i)[1:6], '|') AS credits FROM z""",
    "page_assets": """
WITH a AS (SELECT l_orderkey AS page, 0 AS part, (l_linenumber, l_partkey, l_suppkey) AS pos, 'a/' || l_partkey % 50 AS path FROM lineitem WHERE l_linenumber % 2 = 1
  UNION ALL SELECT l_orderkey, 1, (l_linenumber, l_partkey, l_suppkey), 'a/' || l_partkey % 70 FROM lineitem),
f AS (SELECT page, path, min((part, pos)) AS pos FROM a GROUP BY page, path)
SELECT page, count(*) AS assets, string_agg(path, ',' ORDER BY pos) AS paths FROM f GROUP BY page""",
    "asset_texts": """
SELECT source, 'a/' || lang || doc_id % 5 || '.png' AS path, md5(arg_min(coalesce(text, ''), doc_id)) AS digest FROM documents GROUP BY ALL""",
    "asset_counts": "SELECT source, sum(doc_id % 4)::BIGINT AS asset_count FROM documents GROUP BY source",
    "semantic_units": f"""
WITH {_FEATURED}
SELECT source, doc_id, role, {_label('role', 'kind')} AS role_label, layout, CASE
  WHEN role IN ('title', 'cover', 'masthead', 'cover-sheet', 'folder-label') THEN 'front_matter'
  WHEN role = 'contents' THEN 'toc' WHEN role IN ('preface', 'abstract', 'editorial') THEN 'introductory'
  WHEN role IN ('chapter', 'section', 'article', 'feature', 'record', 'letter', 'body', 'lineated-text') THEN 'main_flow'
  WHEN role IN ('table', 'chart', 'figure-table') THEN 'tabular' WHEN role IN ('index', 'references', 'bibliography', 'footnotes') THEN 'back_matter'
  WHEN role IN ('advertisement', 'classifieds', 'sidebar', 'caption', 'illustrated') THEN 'supplementary' WHEN kind = 'archive bundle' THEN 'archive_item' ELSE 'main_flow' END AS assembly_hint,
  array_to_string(features, ',') AS features, marker AS page_marker, false AS has_figures, 0 AS asset_count FROM f""",
    "unit_summaries": f"""
WITH {_FEATURED}, {_HEADS}, g AS (SELECT source, arg_min(role, doc_id) AS role, arg_min(layout, doc_id) AS layout, flatten(list(heads ORDER BY doc_id))[1:120] AS a,
  flatten(list(titles ORDER BY doc_id))[1:120] AS b, flatten(list(notes ORDER BY doc_id))[1:120] AS c FROM u GROUP BY source)
SELECT source, role, layout, CAST(to_json(a) AS VARCHAR) AS section_headings, CAST(to_json(b) AS VARCHAR) AS title_candidates, CAST(to_json(c) AS VARCHAR) AS footnotes FROM g""",
    "structure_counts": f"""
WITH {_FEATURED}, v AS (SELECT document_type, 'r' AS k, role AS v FROM f UNION ALL SELECT document_type, 'l', layout FROM f UNION ALL SELECT document_type, 'f', unnest(features) FROM f),
c AS (SELECT document_type, k, v, count(*) AS n FROM v GROUP BY ALL),
j AS (SELECT document_type, k, '{{' || string_agg('"' || v || '":' || n, ',' ORDER BY v) || '}}' AS m FROM c GROUP BY ALL)
SELECT document_type, CASE lower(document_type) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ASSEMBLY.items())} ELSE '{OTHER_ASSEMBLY}' END AS assembly,
  coalesce(max(m) FILTER (k = 'r'), '{{}}') AS content_kinds, coalesce(max(m) FILTER (k = 'l'), '{{}}') AS layouts, coalesce(max(m) FILTER (k = 'f'), '{{}}') AS content_features FROM j GROUP BY document_type""",
    "where_sources": f"WITH {_SOURCES} SELECT source_id, source_no FROM src WHERE source_id IN ('S7', 'S12') ORDER BY source_no LIMIT 6",
    "where_terms": f"WITH {_SOURCES}, z AS (SELECT source_id, source_no, {_times(('inandti', 'ereat', 'tion'))} AS score FROM hay) SELECT source_id, source_no FROM z WHERE score > 0 ORDER BY score DESC, source_id LIMIT 6",
    "folder_sources": rf"""
WITH {_FILES}, k AS (SELECT *, CASE WHEN doc_id % 4 < 2 THEN 0 ELSE 3 END AS priority FROM x WHERE doc_id % 4 < 3 AND doc_id % 7 % 4 < 3 AND regexp_matches(coalesce(text, ''), '\S')),
n AS (SELECT *, row_number() OVER (ORDER BY priority, path) AS source_no FROM k)
SELECT source_no, 'S' || source_no AS source_id, path[7:] AS label, length(trim(text, ' ')) AS chars FROM n WHERE source_no <= 240""",
    "file_focus": f"""
WITH {_FILES}, s AS (SELECT path, 3 * (CAST(contains(w, 'page') AS INT) + CAST(contains(w, 'is') AS INT) + CAST(contains(w, 'in') AS INT) + CAST(contains(w, 'es') AS INT) + CAST(contains(w, 'final') AS INT)) AS score
  FROM (SELECT path, translate(lower(path), '_-', '  ') AS w FROM x))
SELECT path, score FROM s WHERE score > 0 ORDER BY score DESC, path LIMIT 12""",
    "latest_runs": "SELECT o_custkey AS source, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run FROM orders GROUP BY 1",
    "compare_views": f"""
WITH d AS (SELECT doc_id, concat_ws('/', source, lang) AS label, coalesce(text, '') AS text, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'final__a.md' ELSE 'translated__b.txt' END AS output_name FROM documents),
b AS (SELECT l_orderkey AS doc_id, l_linenumber AS block, min((CAST(l_partkey % 900 AS INT), CAST(l_suppkey * 37 % 1400 AS INT), least(1000, l_partkey % 900 + CAST(l_quantity * 18 AS INT) + 20), least(1500, l_suppkey * 37 % 1400 + CAST(l_quantity * 9 AS INT) + 12))) AS p FROM lineitem GROUP BY ALL),
o AS (SELECT doc_id, sum(length('<div class="box text-region" style="left:' || format('{{:.3f}}', round_even(p[1] * 100.0::DOUBLE / 1000, 3)) || '%;top:' || format('{{:.3f}}', round_even(p[2] * 100.0::DOUBLE / 1500, 3))
  || '%;width:' || format('{{:.3f}}', round_even((p[3] - p[1]) * 100.0::DOUBLE / 1000, 3)) || '%;height:' || format('{{:.3f}}', round_even((p[4] - p[2]) * 100.0::DOUBLE / 1500, 3)) || '%">' || block || '</div>')) AS n FROM b GROUP BY doc_id)
SELECT d.doc_id, label, output_name, md5({_escaped('text[1:1200]').replace("'", "'")}) AS source, md5(CASE WHEN output_name IS NULL THEN 'no output' ELSE {_escaped("('Output: ' || text)[1:1200]")} END) AS output,
  CAST(coalesce(n, 9) AS INT) AS overlay FROM d LEFT JOIN o USING (doc_id)""",
    "layout_sidecars": f"""
WITH {_BOXES}, o AS (
  SELECT *, page || '_' || reading_order AS id, ("left" + "right") / 2 / 1000 AS x, (top + bottom) / 2 / 1500 AS y FROM ordered
), t AS (
  SELECT *, role || ' ' || concat_ws('-', CASE WHEN y < 0.33 THEN 'top' WHEN y > 0.67 THEN 'bottom' ELSE 'middle' END, CASE WHEN x < 0.33 THEN 'left' WHEN x > 0.67 THEN 'right' ELSE 'center' END) AS said,
    '<Coords points="' || "left" || ',' || top || ' ' || "right" || ',' || top || ' ' || "right" || ',' || bottom || ' ' || "left" || ',' || bottom || '"/>' AS coords,
    ' HPOS="' || "left" || '" VPOS="' || top || '" WIDTH="' || ("right" - "left") || '"' AS place FROM o
), b AS (
  SELECT page, reading_order, CASE WHEN role = 'table-region' THEN '<TableRegion id="r_' || id || '">' || coords || '</TableRegion>' ELSE '<TextRegion id="r_' || id || '" type="'
      || CASE role WHEN 'title-region' THEN 'heading' WHEN 'running-header-or-footer' THEN 'header' ELSE 'paragraph' END || '">' || coords || '<TextEquiv><Unicode>' || said || '</Unicode></TextEquiv></TextRegion>' END AS pagexml,
    '<TextBlock ID="b_' || id || '"' || place || ' HEIGHT="' || (bottom - top) || '"><TextLine ID="b_' || id || '_l1"' || place || ' HEIGHT="20"><String CONTENT="' || said || '"/></TextLine></TextBlock>' AS alto,
    '<div class="ocr_carea" id="block_' || id || '" title="bbox ' || "left" || ' ' || top || ' ' || "right" || ' ' || bottom || '"><p class="ocr_par" id="par_' || id || '">' || said || '<br /></p></div>' AS hocr FROM t
), g AS (SELECT page, string_agg(pagexml, chr(10) ORDER BY reading_order) AS p, string_agg(alto, chr(10) ORDER BY reading_order) AS a, string_agg(hocr, chr(10) ORDER BY reading_order) AS h FROM b GROUP BY page),
x AS (SELECT *, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) AS xml FROM g)
SELECT page, 'pagexml' AS format, md5(xml || '<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15">' || chr(10) || '<Page imageFilename="page_' || page || '.png" imageWidth="1000" imageHeight="1500">' || chr(10) || p || chr(10) || '</Page>' || chr(10) || '</PcGts>' || chr(10)) AS digest FROM x
UNION ALL SELECT page, 'alto', md5(xml || '<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Description><MeasurementUnit>pixel</MeasurementUnit></Description><Layout>' || chr(10) || '<Page ID="p_' || page || '" WIDTH="1000" HEIGHT="1500"><PrintSpace>' || chr(10) || a || chr(10) || '</PrintSpace></Page>' || chr(10) || '</Layout></alto>' || chr(10)) FROM x
UNION ALL SELECT page, 'hocr', md5(xml || '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>OCR output</title></head><body>' || chr(10) || '<div class="ocr_page" id="page_' || page || '" title="bbox 0 0 1000 1500">' || chr(10) || h || chr(10) || '</div>' || chr(10) || '</body></html>' || chr(10)) FROM x""",
    "failure_hints": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_strip("coalesce(text, '')")} AS clean, doc_id % 6 AS n FROM documents),
j AS (SELECT *, '```json' || chr(10) || CAST(to_json({{'restored_text': text, 'notes': 'checked'}}) AS VARCHAR) || chr(10) || '```' AS fenced FROM t)
SELECT doc_id, md5(CASE WHEN n = 5 AND clean = '' THEN 'the reply was empty; return the text' WHEN n IN (1, 4) OR (n <> 3 AND regexp_matches(lower(text), {_META})) THEN 'the reply talked about the task; return only its result'
  WHEN n IN (0, 3) THEN 'the reply was wrapped in JSON; return plain text' ELSE 'the reply could not be used: ' || regexp_replace(CASE WHEN n = 2 THEN fenced ELSE clean END, '\s+', ' ', 'g')[1:180] END) AS digest FROM j""",
    "visible_text": r"SELECT doc_id, md5(regexp_replace(replace(coalesce(text, ''), chr(9), ' '), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) AS digest FROM documents",
    "figure_verdicts": "SELECT doc_id, doc_id % 4 IN (0, 2) AS kept FROM documents",
    "external_layout": f"""
WITH RECURSIVE {_BOXES}, a AS (SELECT page, block, "left", top, "right", bottom, CAST(w AS BIGINT) * h AS size, row_number() OVER (PARTITION BY page ORDER BY CAST(w AS BIGINT) * h DESC, top, "left", "right", bottom, block) AS i FROM b2),
s(page, i, kept) AS (
  SELECT page, i, [{{'l': "left", 't': top, 'r': "right", 'b': bottom, 'z': size, 'e': block % 2}}] FROM a WHERE i = 1
  UNION ALL SELECT a.page, a.i, CASE WHEN len(list_filter(kept, lambda k: least(k.r, "right") > greatest(k.l, "left") AND least(k.b, bottom) > greatest(k.t, top)
      AND CAST(least(k.r, "right") - greatest(k.l, "left") AS BIGINT) * (least(k.b, bottom) - greatest(k.t, top)) / greatest(least(k.z, size), 1)::DOUBLE > 0.40)) > 0
    THEN kept ELSE list_append(kept, {{'l': "left", 't': top, 'r': "right", 'b': bottom, 'z': size, 'e': block % 2}}) END
  FROM s JOIN a ON a.page = s.page AND a.i = s.i + 1), f AS (SELECT page, arg_max(kept, i) AS kept FROM s GROUP BY page)
SELECT page, len(kept) AS kept, CASE WHEN len(list_filter(kept, lambda k: k.e = 0)) > 0 THEN 0.99::DOUBLE ELSE 0.74::DOUBLE END AS surest FROM f""",
    "word_confidence": "SELECT l_orderkey AS page, round(coalesce(avg(CASE WHEN l_linenumber % 3 > 0 THEN l_discount::DOUBLE END), 0.74), 6) AS confidence FROM lineitem GROUP BY 1",
    "page_numbers": "SELECT p_partkey, unnest(range(1, p_size % 5 + 1)) AS page_number FROM part",
    "compiled_outputs": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN {_strip("regexp_replace('<p>' || text || '</p>', '<[^>]+>', '', 'g')")} WHEN 2 THEN
  array_to_string(list_filter(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: {_strip('x')} <> ''), chr(10) || chr(10)) ELSE text END) AS digest FROM t""",
    "event_windows": "SELECT CAST(epoch(time_bucket(INTERVAL 5 MINUTES, CAST(ts AS TIMESTAMP))) AS BIGINT) AS start, event_type, count(*) AS units, round(sum(value), 4) AS tokens FROM events GROUP BY ALL",
    "blank_shares": f"""
WITH RECURSIVE {_RESTORED} SELECT lang, count(*) FILTER (restored_text = '') AS blank, count(*) AS chunks FROM restored JOIN documents USING (doc_id) GROUP BY lang""",
    "folder_parts": f"""
WITH d AS (SELECT source, lang, {_strip("coalesce(text, '')")} AS t FROM documents), f AS (SELECT source AS folder, t FROM d WHERE t <> '' UNION ALL SELECT source || '/' || lang, t FROM d WHERE t <> '')
SELECT folder, count(*) AS parts, sum(length(t))::BIGINT AS chars FROM f GROUP BY folder""",
    "restoration_prompt_texts": f"""
WITH {_KEYED} SELECT doc_id, document_type, md5('{TASK}' || chr(10) || CASE lower(document_type) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GUIDANCE.items())} ELSE '{OTHER_GUIDANCE}' END
  || chr(10) || '{POLICIES["strict-source"]}' || '{MARKER}' || text) AS digest FROM k""",
    "word_wrap": r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, md5(coalesce(list_reduce(ws, lambda a, x: CASE WHEN length(regexp_extract(a, '[^\n]*$')) + 1 + length(x) <= 76 THEN a || ' ' || x ELSE a || chr(10) || x END), '')) AS digest FROM w""",
    "restoration_prompts": f"""
WITH {_KEYED} SELECT document_type, count(*) AS prompts, sum(CASE lower(document_type) {" ".join(f"WHEN '{k}' THEN {len(v)}" for k, v in GUIDANCE.items())} ELSE {len(OTHER_GUIDANCE)} END
  + {len(TASK) + 2 + len(POLICIES["strict-source"]) + len(MARKER)})::BIGINT AS added FROM k GROUP BY document_type""",
    "page_bodies": rf"""
WITH {_FEATURED}, {_HEADS}, c AS (
  SELECT *, {_strip('text')} AS p, list_filter(list_transform(ls, lambda x: list_filter(list_transform(CASE WHEN contains(x, '|') THEN string_split(regexp_replace(x, '^\|+|\|+$', '', 'g'), '|')
      WHEN contains(x, chr(9)) THEN string_split(x, chr(9)) ELSE string_split_regex(x, '\s{{2,}}') END, lambda y: {_strip('y')}), lambda y: y <> '')), lambda r: len(r) >= 2) AS rows FROM u
), t AS (
  SELECT *, list_max(list_transform(rows, lambda r: len(r))) AS most FROM c
), b AS (
  SELECT *, CASE WHEN regexp_matches(p, '^\[image:\s*(.+?)\s*\|\s*([^\]]+)\]$', 'i') THEN '![](' || {_strip(r"regexp_extract(p, '^\[image:\s*(.+?)\s*\|\s*([^\]]+)\]$', 2, 'i')")} || ')'
      WHEN starts_with(lower(p), '[image:') THEN '> ' || p
      WHEN len(rows) >= 2 THEN array_to_string(list_transform(rows, lambda r, i: '| ' || array_to_string(list_transform(range(most), lambda k: coalesce(r[k + 1], '')), ' | ') || ' |'
        || CASE WHEN i = 1 THEN chr(10) || '| ' || array_to_string(list_transform(range(most), lambda k: '---'), ' | ') || ' |' ELSE '' END), chr(10))
      ELSE p END AS plain, array_to_string({_UNIT}, chr(10) || chr(10)) AS unit FROM t
), z AS (
  SELECT *, (role = 'contents' AND regexp_matches(lower(plain), 'table|contents')) OR (role IN ('title', 'chapter', 'section') AND heading <> '' AND contains(lower(plain), lower(heading))) AS repeated FROM b
)
SELECT doc_id, role, md5(array_to_string(list_filter([CASE WHEN repeated THEN '' ELSE unit END, {_strip('plain')}], lambda x: x <> ''), chr(10) || chr(10))) AS digest FROM z""",
}

# A page's body in place of its digest, for whole books.
_LAID = ORACLES["export_layout_markdown"].replace(_PUBLISHED_WHOLE, _PUBLISHED).replace("md5(coalesce(", "(coalesce(").replace("AS digest", "AS body")
_PLAIN = ORACLES["page_bodies"].replace("md5(array_to_string(list_filter([CASE WHEN repeated", "(array_to_string(list_filter([CASE WHEN repeated").replace("AS digest", "AS body")
ORACLES["book_markdown"] = f"""
WITH laid AS ({_LAID}), plain AS ({_PLAIN}), p AS (
  SELECT d.source, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS i, count(*) OVER (PARTITION BY d.source) AS n,
    CASE WHEN {_strip("coalesce(laid.body, '')")} <> '' THEN laid.body ELSE plain.body END AS body
  FROM documents d JOIN plain USING (doc_id) LEFT JOIN laid ON laid.page = d.doc_id
), j AS (
  SELECT source, string_agg('<!-- Page ' || i || ' of ' || n || ' -->' || chr(10) || chr(10) || CASE WHEN {_strip('body')} = '' THEN '[blank page]' ELSE {_strip('body')} END,
    chr(10) || chr(10) || chr(12) || chr(10) || chr(10) ORDER BY i) || chr(10) AS t FROM p GROUP BY source
)
SELECT source, length(t) AS chars, md5(t) AS digest FROM j"""
ORACLES["book_packages"] = f"""
WITH {_PUBLISHED}, a AS (SELECT source, upper(md5('a/' || page || '-' || reading_order || '.png')) AS c FROM z JOIN documents ON page = doc_id WHERE role = 'figure-region' AND page % 2 = 0)
SELECT source, count(*) AS pictures, md5(string_agg(c, ',' ORDER BY c)) AS digest FROM a GROUP BY source"""

ORACLES["answer_prompt"] = f"""
WITH top AS ({ORACLES["page_band_sources"]}), t AS (
  SELECT '[' || source_id || '] ' || source || '/' || lang || chr(10) || substring(text, 1, 1200) AS part, score, source_id FROM top JOIN documents ON 'S' || doc_id = source_id
), p AS (
  SELECT 'Answer from the sources below and cite them by their ids. Say so if they do not hold the answer.' || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY score DESC, source_id)
    || chr(10) || 'Question: a' || chr(10) || 'Answer: b' || chr(10) || 'Note: n' || chr(10) || 'Question: What does the statement on pages 66-67 say about the inandti and ereat?' AS prompt FROM t
)
SELECT length(prompt) AS prompt_chars, length({_offline("prompt")}) + 1 AS reply_chars, 30 AS total_tokens FROM p"""
