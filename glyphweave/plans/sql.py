"""DuckDB SQL that the registered queries are compared with."""

from __future__ import annotations

from glyphweave.functions.fontmetrics import HELVETICA, TIMES

WORDS = """
WITH raw_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents WHERE text IS NOT NULL),
toks AS (SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) AS spot_no FROM raw_lines),
offs AS (
  SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY spot_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM toks),
words AS (
  SELECT doc_id, CAST(line_no // 54 AS INTEGER) AS page, line_no, text, 72 + 6 * CAST(off AS DOUBLE) AS x,
    720 - 12 * CAST(line_no % 54 AS DOUBLE) - CAST(0.22 AS DOUBLE) * 10 AS y, 6 * CAST(length(text) AS DOUBLE) AS w, CAST(10 AS DOUBLE) AS h,
    720 - 12 * CAST(line_no % 54 AS DOUBLE) AS baseline,
    row_number() OVER (PARTITION BY doc_id, line_no // 54 ORDER BY line_no, spot_no) - 1 AS word_ord
  FROM offs WHERE text <> '')
"""

BLOCKS = (
    WORDS
    + """, gapped AS (
  SELECT *, CASE WHEN x - (lag(x) OVER o + lag(w) OVER o) >= 15 THEN 1 ELSE 0 END AS wide,
    row_number() OVER o - 1 AS pos, CAST(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY line_no) - 1 AS INTEGER) AS line_ord
  FROM words WINDOW o AS (PARTITION BY doc_id, page, line_no ORDER BY x)),
lines AS (
  SELECT doc_id, page, line_ord, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, min(baseline) AS baseline,
    count(*) AS n_words, string_agg(text, ' ' ORDER BY pos) AS text, arg_min(w, pos) AS first_w, CAST(sum(wide) AS BIGINT) AS column_gaps
  FROM gapped GROUP BY ALL),
broken AS (
  SELECT *, CASE WHEN lag(y) OVER d - (y + h) > 0.9 * greatest(lag(h) OVER d, h)
      OR (abs(lag(x) OVER d - x) >= 2 * greatest(lag(h) OVER d, h)
        AND least(lag(x) OVER d + lag(w) OVER d, x + w) - greatest(lag(x) OVER d, x) <= 0) THEN 1 ELSE 0 END AS breaks
  FROM lines WINDOW d AS (PARTITION BY doc_id, page ORDER BY line_ord)),
blocked AS (
  SELECT *, CAST(sum(breaks) OVER (PARTITION BY doc_id, page ORDER BY line_ord ROWS UNBOUNDED PRECEDING) AS INTEGER) AS block_ord FROM broken),
loosened AS (
  SELECT *, CASE WHEN w + 2.5 + lead(first_w) OVER (PARTITION BY doc_id, page, block_ord ORDER BY line_ord)
      <= max(w) OVER (PARTITION BY doc_id, page, block_ord) + 2 THEN 1 ELSE 0 END AS loose FROM blocked),
blocks AS (
  SELECT doc_id, page, block_ord, CASE WHEN count(*) < 2 THEN 'lines' WHEN sum(CASE WHEN column_gaps > 0 THEN 1 ELSE 0 END) >= 2 THEN 'table'
      WHEN max(w) < 180 THEN 'lines' WHEN sum(loose) > 0 THEN 'lines' ELSE 'paragraph' END AS kind,
    min(line_ord) AS line_lo, max(line_ord) AS line_hi, count(*) AS n_lines, CAST(sum(n_words) AS BIGINT) AS n_words,
    min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h
  FROM loosened GROUP BY ALL)
"""
)

TABLE_LINES = """
WITH rows AS (
  SELECT l_orderkey AS doc_id, 0 AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) - 1 AS line_no, rpad('Item ' || l_linenumber, 12, ' ') || '   ' ||
    array_to_string([rpad(CAST(l_partkey AS VARCHAR), 12, ' '), rpad(CAST(l_suppkey AS VARCHAR), 12, ' '), rpad(l_returnflag, 12, ' '), rpad(l_linestatus, 12, ' ')], '   ') AS line
  FROM lineitem),
toks AS (SELECT doc_id, page, line_no, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) AS spot_no FROM rows),
offs AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY spot_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM toks),
words AS (SELECT doc_id, page, line_no, text, spot_no, 72 + 6 * CAST(off AS DOUBLE) AS x, 6 * CAST(length(text) AS DOUBLE) AS w FROM offs WHERE text <> ''),
gapped AS (SELECT *, CASE WHEN x - (lag(x) OVER o + lag(w) OVER o) >= 15 THEN 1 ELSE 0 END AS starts,
    CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INTEGER) AS line_ord
  FROM words WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY x)),
numbered AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY doc_id, line_no ORDER BY x ROWS UNBOUNDED PRECEDING) AS INTEGER) AS cell FROM gapped),
cells AS (SELECT doc_id, page, line_ord, cell, string_agg(text, ' ' ORDER BY x) AS text, count(*) AS n_words, min(x) AS x FROM numbered GROUP BY ALL)
"""


def search(needle: str, case_sensitive: bool, whole_word: bool) -> str:
    """Hits of a phrase: pieces between occurrences give the offsets; the words under a hit give its box."""
    hay = "text" if case_sensitive else "lower(text)"
    needle = needle if case_sensitive else needle.lower()
    size = len(needle)
    edge = f"""WHERE NOT coalesce(offs > 0 AND regexp_matches(substr(hay, CAST(offs AS BIGINT), 1), '[\\p{{L}}\\p{{N}}_]'), FALSE)
      AND NOT coalesce(regexp_matches(substr(hay, CAST(offs AS BIGINT) + {size + 1}, 1), '[\\p{{L}}\\p{{N}}_]'), FALSE)"""
    return (
        BLOCKS
        + f""", homes AS (SELECT l.doc_id, l.page, l.line_ord, l.block_ord, CASE WHEN b.kind = 'paragraph' THEN 0 ELSE l.line_ord END AS unit
    FROM blocked l JOIN blocks b USING (doc_id, page, block_ord)),
  homed AS (SELECT g.*, h.block_ord, h.unit, coalesce(sum(length(g.text) + 1) OVER (PARTITION BY g.doc_id, g.page, h.block_ord, h.unit
      ORDER BY g.line_ord, g.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM gapped g JOIN homes h USING (doc_id, page, line_ord)),
  units AS (SELECT doc_id, page, block_ord, unit, string_agg(text, ' ' ORDER BY line_ord, pos) AS text FROM homed GROUP BY ALL),
  pieces AS (SELECT doc_id, page, block_ord, unit, text, {hay} AS hay, unnest(string_split({hay}, '{needle}')) AS piece,
      generate_subscripts(string_split({hay}, '{needle}'), 1) AS k, len(string_split({hay}, '{needle}')) AS n FROM units WHERE contains({hay}, '{needle}')),
  starts AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, page, block_ord, unit ORDER BY k ROWS UNBOUNDED PRECEDING) + (k - 1) * {size} AS offs FROM pieces),
  hits AS (SELECT * FROM starts WHERE k < n),
  kept AS (SELECT * FROM hits {edge if whole_word else ''})
SELECT k.doc_id, k.page, k.block_ord, k.unit, CAST(k.offs AS BIGINT) AS "offset", any_value(substr(k.text, CAST(k.offs AS BIGINT) + 1, {size})) AS matched, count(*) AS n_words,
  round(min(x), 4) AS x, round(min(y), 4) AS y, round(max(x + w) - min(x), 4) AS w, round(max(y + h) - min(y), 4) AS h
FROM kept k JOIN homed d ON k.doc_id = d.doc_id AND k.page = d.page AND k.block_ord = d.block_ord AND k.unit = d.unit
  AND d.start < k.offs + {size} AND d.start + length(d.text) > k.offs
GROUP BY k.doc_id, k.page, k.block_ord, k.unit, k.offs
"""
    )


PIVOT = "CASE WHEN length(text) <= 1 THEN 0 WHEN length(text) <= 5 THEN 1 WHEN length(text) <= 9 THEN 2 WHEN length(text) <= 13 THEN 3 ELSE 4 END"

RSVP = f""", timed AS (SELECT *, 200 * (CAST(1 AS DOUBLE) + CASE WHEN length(text) > 8 THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(text, '[.,;:!?]$') THEN 0.6 ELSE 0 END) AS shown_for FROM words)
SELECT doc_id, row_number() OVER o - 1 AS feed_pos, page, text, {PIVOT} AS pivot,
  round(coalesce(sum(shown_for) OVER (PARTITION BY doc_id ORDER BY page, word_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS shown_at, round(shown_for, 3) AS shown_for
FROM timed WINDOW o AS (PARTITION BY doc_id ORDER BY page, word_ord)
"""

ORP = f""", split AS (SELECT DISTINCT text, {PIVOT} AS k FROM words)
SELECT text, CASE WHEN k >= 12 THEN substr(text, 1, k) ELSE lpad(substr(text, 1, k), 12, ' ') END AS pre, substr(text, k + 1, 1) AS pivot,
  CASE WHEN length(substr(text, k + 2)) >= 12 THEN substr(text, k + 2) ELSE rpad(substr(text, k + 2), 12, ' ') END AS post FROM split
"""

HIT_TEST = """, hit AS (SELECT doc_id AS point_id, block_ord, kind FROM blocks WHERE page = 0 AND 100 BETWEEN x AND x + w AND 720 BETWEEN y AND y + h
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY block_ord) = 1),
word AS (SELECT g.doc_id AS point_id, g.word_ord, g.text FROM gapped g JOIN blocked b USING (doc_id, page, line_ord) JOIN hit ON hit.point_id = g.doc_id AND hit.block_ord = b.block_ord
  WHERE g.page = 0 AND 100 BETWEEN g.x AND g.x + g.w AND 720 BETWEEN g.y AND g.y + g.h
  QUALIFY row_number() OVER (PARTITION BY g.doc_id ORDER BY g.line_ord, g.pos) = 1)
SELECT hit.point_id, block_ord, kind, coalesce(word_ord, -1) AS word_ord, coalesce(text, '') AS text, CASE kind WHEN 'table' THEN 'cell' WHEN 'paragraph' THEN 'block' ELSE 'line' END AS selects FROM hit LEFT JOIN word USING (point_id)
"""

_UNDER = "x < 270 AND x + w > 150 AND y < 715 AND y + h > 690"
BARS = f""", bars AS (SELECT doc_id AS region_id, page, line_ord, min(x) - 1 AS x, min(y) AS y, max(x + w) - min(x) + 2 AS w, max(y + h) - min(y) AS h
  FROM gapped WHERE page = 0 AND {_UNDER} GROUP BY ALL)
SELECT region_id, page, line_ord, round(x, 4) AS x, round(y, 4) AS y, round(w, 4) AS w, round(h, 4) AS h FROM bars
UNION ALL SELECT doc_id, 0, -1, 150, 690, 120, 25 FROM documents WHERE doc_id NOT IN (SELECT region_id FROM bars)
"""

GLYPHS = """
WITH raw_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents WHERE text IS NOT NULL),
glyphs AS (
  SELECT doc_id, CAST(line_no // 54 AS INTEGER) AS page, CAST(line_no AS INTEGER) AS op_index, CAST(unnest(range(0, length(line))) AS INTEGER) AS spot_no FROM raw_lines WHERE line <> '')
"""
REDACT = """SELECT doc_id AS region_id, page, op_index, min(spot_no) AS span_start, max(spot_no) + 1 AS span_end, count(*) AS n_glyphs FROM glyphs
WHERE page = 0 AND 72 + 6 * spot_no < 270 AND 72 + 6 * spot_no + 6 > 150 AND 720 - 12 * op_index < 715 AND 720 - 12 * op_index + 10 > 690 GROUP BY ALL
"""

SPLICES = """SELECT * FROM (SELECT l_orderkey, l_linenumber * 10 AS start, l_linenumber * 10 + l_quantity AS "end", lead(l_linenumber * 10) OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber * 10, l_linenumber * 10 + l_quantity) AS next_start FROM lineitem) WHERE next_start < "end"
"""

PAGES = """WITH pl AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page, role, text, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
"""

COMMENTS = """WITH base AS (SELECT doc_id, 'c0' AS id, lang AS contents FROM documents),
writes AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'c0' ELSE 'c' || quality END AS id, toxic = 1 AS gone, 'quality ' || quality AS contents FROM labels)
SELECT coalesce(b.doc_id, w.doc_id) AS doc_id, coalesce(b.id, w.id) AS id, coalesce(w.contents, b.contents) AS contents,
  CAST(10 AS DOUBLE) AS x, CAST(20 AS DOUBLE) AS y, CAST(18 AS DOUBLE) AS w, CAST(18 AS DOUBLE) AS h
FROM base b FULL JOIN writes w ON b.doc_id = w.doc_id AND b.id = w.id WHERE w.gone IS NULL OR NOT w.gone
"""

OTSU = """WITH bins AS (SELECT user_id AS img_id, CAST(greatest(0, least(255, floor(value))) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL),
sums AS (SELECT img_id, bin, CAST(sum(n) OVER u AS DOUBLE) AS lo, CAST(sum(bin * n) OVER u AS DOUBLE) AS lo_sum, CAST(sum(n) OVER (PARTITION BY img_id) AS DOUBLE) AS al,
    CAST(sum(bin * n) OVER (PARTITION BY img_id) AS DOUBLE) AS al_sum FROM bins WINDOW u AS (PARTITION BY img_id ORDER BY bin ROWS UNBOUNDED PRECEDING)),
apart AS (SELECT img_id, bin, CASE WHEN lo > 0 AND al - lo > 0 THEN lo * (al - lo) * (lo_sum / lo - (al_sum - lo_sum) / (al - lo)) * (lo_sum / lo - (al_sum - lo_sum) / (al - lo)) END AS between_ FROM sums)
SELECT img_id, CAST(CASE WHEN coalesce(between_, 0) > 0 THEN bin ELSE 160 END AS INTEGER) AS threshold FROM apart
QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY between_ DESC NULLS LAST, bin) = 1
"""

STROKES = """WITH s AS (SELECT user_id AS img_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS DOUBLE) AS x, value AS y FROM events WHERE value IS NOT NULL)
"""


def _pass(source: str) -> str:
    moved = ", ".join(f"coalesce({c} + ((lag({c}) OVER o + lead({c}) OVER o) / 2 - {c}) * 0.25, {c}) AS {c}" for c in "xy")
    return f"(SELECT img_id, ord, {moved} FROM {source} WINDOW o AS (PARTITION BY img_id ORDER BY ord))"


def _even(value: str) -> str:
    """Rounded half up on the scaled double, which is the same number in every engine."""
    return f"floor(({value}) * 10000 + 0.5) / 10000"


SMOOTH = STROKES + f"SELECT img_id, ord, {_even('x')} AS x, {_even('y')} AS y FROM {_pass(_pass(_pass('s')))}"


def _controls(c: str) -> str:
    before, after = f"coalesce(lag({c}) OVER o, {c})", f"lead({c}) OVER o"
    beyond = f"coalesce(lead({c}, 2) OVER o, {after})"
    return f"{c} + ({after} - {before}) / 6 AS {c}1, {after} - ({beyond} - {c}) / 6 AS {c}2, {after} AS {c}3"


BEZIER = STROKES + f"""SELECT img_id, ord, {', '.join(f'round({c}{k}, 4) AS {c}{k}' for k in (1, 2, 3) for c in 'xy')}
FROM (SELECT img_id, ord, {_controls('x')}, {_controls('y')} FROM s WINDOW o AS (PARTITION BY img_id ORDER BY ord)) WHERE x3 IS NOT NULL
"""

CUTS = STROKES + f""", seg AS (SELECT *, lead(x) OVER o AS x3, lead(y) OVER o AS y3 FROM s WINDOW o AS (PARTITION BY img_id ORDER BY ord)),
cut AS (SELECT img_id, CAST(-1.5 AS DOUBLE) AS ax, CAST(20.25 AS DOUBLE) AS ay, max(x) + 1.5 AS bx, CAST(60.75 AS DOUBLE) AS by_ FROM s GROUP BY img_id),
d AS (SELECT seg.*, x3 - x AS rx, y3 - y AS ry, bx - ax AS sx, by_ - ay AS sy, ax - x AS qx, ay - y AS qy FROM seg JOIN cut USING (img_id) WHERE x3 IS NOT NULL),
t AS (SELECT *, (qx * sy - qy * sx) / (rx * sy - ry * sx) AS t, (qx * ry - qy * rx) / (rx * sy - ry * sx) AS u FROM d WHERE abs(rx * sy - ry * sx) >= 1e-9)
SELECT img_id, ord, {_even("t")} AS t, {_even("x + t * rx")} AS cx, {_even("y + t * ry")} AS cy FROM t WHERE t > 1e-6 AND t < 1 - 1e-6 AND u > 1e-6 AND u < 1 - 1e-6
"""

NEAREST = """, ends AS (SELECT img_id, 0 AS which, arg_min(x, ord) AS x, arg_min(y, ord) AS y FROM s GROUP BY 1 UNION ALL SELECT img_id, 1, arg_max(x, ord), arg_max(y, ord) FROM s GROUP BY 1),
spot AS (SELECT img_id, max(x) / 2 AS px, CAST(50 AS DOUBLE) AS py FROM s GROUP BY 1)
SELECT img_id AS spot_id, 0 AS chain, which, round(d, 4) AS d FROM (SELECT img_id, which, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS d FROM ends JOIN spot USING (img_id))
QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY d, which DESC) = 1
"""

_M = ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS m{n}" for k, n in enumerate("abcdef"))
_CORNERS = [(10, 20), (10, 60), (40, 20), (40, 60)]
_XS = ", ".join(f"ma * {x} + mc * {y} + me" for x, y in _CORNERS)
_YS = ", ".join(f"mb * {x} + md * {y} + mf" for x, y in _CORNERS)
RECT_CSS = f"""SELECT vec_id, round(least({_XS}), 4) AS "left", round(least({_YS}), 4) AS top, round(greatest({_XS}) - least({_XS}), 4) AS width,
  round(greatest({_YS}) - least({_YS}), 4) AS height FROM (SELECT vec_id, {_M} FROM embeddings)
"""
INVERSE = f"""SELECT vec_id, CASE WHEN ma * md - mb * mc <> 0 THEN CAST(10 AS DOUBLE) END AS x, CASE WHEN ma * md - mb * mc <> 0 THEN CAST(20 AS DOUBLE) END AS y,
  round(sqrt(ma * ma + mb * mb), 4) AS sx, round(sqrt(mc * mc + md * md), 4) AS sy FROM (SELECT vec_id, {_M} FROM embeddings)
"""

VIEWPORT = """WITH p AS (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) + 600 AS w, CAST(c_nationkey AS DOUBLE) * 2 + 700 AS h, ((c_nationkey * 45 - 450) % 360 + 360) % 360 AS r, CAST(1.5 AS DOUBLE) AS s FROM customer)
SELECT c_custkey, CASE r WHEN 90 THEN 0 WHEN 180 THEN -s WHEN 270 THEN 0 ELSE s END AS m_a, CASE r WHEN 90 THEN s WHEN 270 THEN -s ELSE 0 END AS m_b,
  CASE r WHEN 90 THEN s WHEN 270 THEN -s ELSE 0 END AS m_c, CASE r WHEN 90 THEN 0 WHEN 180 THEN s WHEN 270 THEN 0 ELSE -s END AS m_d,
  CASE r WHEN 90 THEN 0 WHEN 180 THEN w * s WHEN 270 THEN h * s ELSE 0 END AS m_e, CASE r WHEN 90 THEN 0 WHEN 180 THEN 0 WHEN 270 THEN w * s ELSE h * s END AS m_f,
  CASE WHEN r IN (90, 270) THEN h * s ELSE w * s END AS css_width, CASE WHEN r IN (90, 270) THEN w * s ELSE h * s END AS css_height FROM p
"""

FONTS = ["Helvetica", "Times-Roman", "Courier-Bold", "DejaVu Sans Mono", "Noto Serif", "Arial"]


def widths() -> str:
    code = "ascii(c)"
    chosen = lambda table: f"CASE WHEN {code} BETWEEN 32 AND 126 THEN {table}[{code} - 31] ELSE 556 END"
    return f"""SELECT p_partkey, font, CAST(list_sum(list_transform(string_split(p_name, ''), lambda c:
  CASE WHEN font IN ('Courier-Bold', 'DejaVu Sans Mono') THEN 600 WHEN font IN ('Times-Roman', 'Noto Serif') THEN {chosen(TIMES)} ELSE {chosen(HELVETICA)} END)) AS INTEGER) AS width
FROM (SELECT p_partkey, p_name, {FONTS}[p_size % {len(FONTS)} + 1] AS font FROM part)
"""


FILENAMES = """WITH n AS (SELECT page_id, url_decode(list_extract(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), '/'), -1)) AS raw FROM pages)
SELECT page_id, CASE WHEN coalesce(raw, '') = '' THEN 'document.pdf' ELSE raw END AS name,
  regexp_replace(CASE WHEN coalesce(raw, '') = '' THEN 'document.pdf' ELSE raw END, '(?i)\\.pdf$', '') || '_edited.pdf' AS export_name FROM n
"""


_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
WRAP = f"""WITH flat AS (SELECT doc_id, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
wrapped AS (SELECT doc_id, CASE WHEN t = '' THEN [''] ELSE regexp_extract_all(t, '(.{{1,80}}|[^ ]+)(?: |$)', 1) END AS ls FROM flat)
SELECT doc_id, CAST(k - 1 AS INTEGER) AS line_no, length(line) AS n_chars, md5(line) AS line_md5 FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM wrapped)
"""


def wrap_measured(limit: int) -> str:
    """Greedy lines by recursion: the next line starts at the first word that ends beyond the limit, or after its only word."""
    wide = f"CASE WHEN ascii(c) BETWEEN 32 AND 126 THEN {HELVETICA}[ascii(c) - 31] ELSE 556 END"
    gap = HELVETICA[0]
    return f"""WITH RECURSIVE split AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(text, '{_SPACE}', ' ', 'g'), ' '), lambda w: w <> '') AS ws FROM conversations),
w AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM split),
wide AS (SELECT *, CAST(list_sum(list_transform(string_split(word, ''), lambda c: {wide})) AS BIGINT) AS width FROM w),
run AS (SELECT *, CAST(sum(width + {gap}) OVER (PARTITION BY conv_id, turn ORDER BY k) AS BIGINT) AS upto FROM wide),
lines AS (
  SELECT conv_id, turn, 0 AS line_no, CAST(1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS before FROM run WHERE k = 1
  UNION ALL
  SELECT l.conv_id, l.turn, l.line_no + 1, min(r.k), min(r.upto - r.width - {gap})
  FROM lines l JOIN run r ON r.conv_id = l.conv_id AND r.turn = l.turn AND r.k > l.k AND r.upto - {gap} - l.before > {limit}
  GROUP BY l.conv_id, l.turn, l.line_no),
spans AS (SELECT conv_id, turn, line_no, k, lead(k) OVER (PARTITION BY conv_id, turn ORDER BY k) AS after FROM lines),
filled AS (SELECT s.conv_id, s.turn, s.line_no, string_agg(r.word, ' ' ORDER BY r.k) AS line FROM spans s JOIN run r ON r.conv_id = s.conv_id AND r.turn = s.turn AND r.k >= s.k AND (s.after IS NULL OR r.k < s.after) GROUP BY ALL)
SELECT conv_id, turn, line_no, md5(line) AS line_md5 FROM filled
UNION ALL SELECT conv_id, turn, 0, md5('') FROM split WHERE coalesce(len(ws), 0) = 0
"""


CONTROLS = """, counted AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
placed AS (SELECT doc_id, n, CAST(greatest(0, least(n - 1, floor(CAST(1 AS DOUBLE) / 3 * (n - 1) + 0.5))) AS BIGINT) AS p FROM counted)
SELECT doc_id, p AS "at", greatest(0, least(n - 1, p - 10)) AS back, greatest(0, least(n - 1, p + 10)) AS "on",
  floor((CASE WHEN n > 1 THEN p / (n - 1) * 100 ELSE 0 END) * 10000 + 0.5) / 10000 AS percent, greatest(60, least(1200, n % 1400 + 75)) AS speed FROM placed
"""

SELECTED = HIT_TEST[: HIT_TEST.rindex("SELECT hit.point_id")] + """, cells AS (SELECT g.*, b.block_ord, sum(wide) OVER (PARTITION BY g.doc_id, g.page, g.line_ord ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cell
  FROM gapped g JOIN blocked b USING (doc_id, page, line_ord) WHERE page = 0),
chosen AS (SELECT hit.point_id, hit.block_ord, c.line_ord, c.cell, c.word_ord, CASE WHEN hit.point_id % 5 = 0 THEN 'word' WHEN kind = 'table' THEN 'cell' WHEN kind = 'paragraph' THEN 'block' ELSE 'line' END AS selects
  FROM hit JOIN word USING (point_id) JOIN cells c ON c.doc_id = hit.point_id AND c.word_ord = word.word_ord)
SELECT point_id, c.line_ord, c.pos, c.word_ord, c.text, round(c.x, 4) AS x, round(c.y, 4) AS y, round(c.w, 4) AS w, round(c.h, 4) AS h
FROM chosen h JOIN cells c ON c.doc_id = h.point_id AND c.block_ord = h.block_ord AND CASE selects WHEN 'word' THEN c.word_ord = h.word_ord
  WHEN 'cell' THEN c.line_ord = h.line_ord AND c.cell = h.cell WHEN 'line' THEN c.line_ord = h.line_ord ELSE TRUE END
"""

STREAMS = r"""
WITH raw_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents WHERE text IS NOT NULL),
shown AS (SELECT doc_id, CAST(line_no // 54 AS INTEGER) AS page, line_no, regexp_replace(raw, '[^\x{20}-\x{7e}\x{a1}-\x{ff}]', '?', 'g') AS line,
    3 + 2 * (row_number() OVER (PARTITION BY doc_id, line_no // 54 ORDER BY line_no) - 1) AS op_index FROM raw_lines WHERE raw <> ''),
glyphs AS (SELECT doc_id, page, line_no, op_index, unnest(string_split(line, '')) AS unicode, generate_subscripts(string_split(line, ''), 1) - 1 AS byte_offset,
    72 + 6 * CAST(generate_subscripts(string_split(line, ''), 1) - 1 AS DOUBLE) AS x, 720 - 12 * CAST(line_no % 54 AS DOUBLE) AS y FROM shown)
"""
#: Line items are drawn in any order, so `last` counts a page's operations: its last operator is the last item's.
DRAWN_OPERATIONS = """WITH items AS (SELECT l_orderkey // 2500 AS doc_id, l_orderkey FROM lineitem),
ops(op, place, n_operands) AS (VALUES ('q', 0, 0), ('cm', 1, 6), ('m', 2, 2), ('l', 3, 2), ('S', 4, 0), ('Q', 5, 0))
SELECT doc_id, op, count(*) AS n, CAST(6 * (count(*) - 1) + place AS INTEGER) AS "last", count(*) * n_operands AS n_operands,
  CASE WHEN op = 'cm' THEN CAST(sum(l_orderkey) AS BIGINT) ELSE 0 END AS risen FROM items, ops GROUP BY doc_id, op, place, n_operands
"""
#: Half size: a code of Courier is 0.6 of 8 units, scaled by half twice, and a unit of spacing comes before the scale.
LONG_GLYPHS = """WITH items AS (SELECT l_orderkey // 2500 AS doc_id, l_orderkey % 1000 AS dx, l_linenumber AS n, l_returnflag AS flag FROM lineitem),
step AS (SELECT *, CAST(4.8 AS DOUBLE) * 0.5 + 0.5 AS s FROM items),
shown AS (
  SELECT doc_id, chr(233) AS unicode, dx + 0.5 * n AS x, 7 + 0.5 * (3 + 2) AS y, 0 AS byte_offset, 0 AS item_index FROM step
  UNION ALL SELECT doc_id, CASE flag WHEN 'A' THEN chr(233) ELSE flag END, dx + 0.5 * (n + s), 7 + 0.5 * (3 + 2), 1, 0 FROM step
  UNION ALL SELECT doc_id, 'ff', dx + 0.5 * (n + 2 * s + 2), 7 + 0.5 * (3 + 2), 0, 2 FROM step
  UNION ALL SELECT doc_id, 'x', dx + 0.5 * n, 7 + 0.5 * (3 - 12 + 2), 0, -1 FROM step
  UNION ALL SELECT doc_id, ')', dx + 0.5 * (n + s), 7 + 0.5 * (3 - 12 + 2), 1, -1 FROM step)
SELECT doc_id, unicode, round(x, 4) AS x, round(y, 4) AS y, CAST(1.2 AS DOUBLE) AS width, byte_offset, item_index FROM shown
"""
_COVERED = "x < 270 AND x + 6 > 150 AND y < 715 AND y + 10 > 690"
_STREAM_WORDS = """, toks AS (SELECT doc_id, page, line_no, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) AS spot_no FROM shown WHERE page = 0),
laid AS (SELECT *, 72 + 6 * CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY spot_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS x FROM toks),
found AS (SELECT doc_id, page, line_no, text, x, 6 * CAST(length(text) AS DOUBLE) AS w, 720 - 12 * CAST(line_no AS DOUBLE) - CAST(0.22 AS DOUBLE) * 10 AS y,
    row_number() OVER (PARTITION BY doc_id ORDER BY line_no, spot_no) - 1 AS word_ord FROM laid WHERE text <> ''),
bars AS (SELECT doc_id, line_no, min(x) - 1 AS x, min(y) AS y, max(x + w) - min(x) + 2 AS w, CAST(10 AS DOUBLE) AS h FROM found WHERE x < 270 AND x + w > 150 AND y < 715 AND y + 10 > 690 GROUP BY ALL)
"""
STREAM_REDACT = _STREAM_WORDS + f""", removed AS (SELECT doc_id, count(*) AS n FROM glyphs WHERE page = 0 AND {_COVERED} GROUP BY doc_id)
SELECT doc_id, coalesce(any_value(r.n), 0) AS n_removed, greatest(1, (SELECT count(*) FROM bars b WHERE b.doc_id = g.doc_id)) AS n_bars, count(*) - coalesce(any_value(r.n), 0) AS n_left
FROM glyphs g LEFT JOIN removed r USING (doc_id) WHERE page = 0 GROUP BY doc_id
"""
STREAM_REPLACE = _STREAM_WORDS + """SELECT doc_id, page, CASE WHEN word_ord = 0 THEN 0 ELSE word_ord + 1 END AS word_ord, CASE WHEN word_ord = 0 THEN 'new' ELSE text END AS text FROM found
UNION ALL SELECT doc_id, page, 1, 'text' FROM found WHERE word_ord = 0
"""
#: 300 units hold 50 characters of Courier at 10 points. Words of the first line stand alone in their spans, so a greedy line is the longest run of words that fits.
STREAM_REFLOW = _STREAM_WORDS + r""", top AS (SELECT doc_id, min(line_no) AS line_no FROM shown WHERE page = 0 GROUP BY doc_id),
flat AS (SELECT doc_id, line_no, trim(regexp_replace(line || ' ' || line, '\s+', ' ', 'g')) AS t, op_index FROM shown JOIN top USING (doc_id, line_no)),
cut AS (SELECT doc_id, line_no, CASE WHEN t = '' THEN [''] ELSE regexp_extract_all(t, '(.{1,50}|[^ ]+)(?: |$)', 1) END AS ls FROM flat),
rows AS (SELECT doc_id, line_no, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS n FROM cut),
new_words AS (SELECT doc_id, line_no, n, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) AS k FROM rows WHERE line <> ''),
new_placed AS (SELECT doc_id, line_no, n, k, text, 72 + 6 * CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS x,
    720 - 12 * CAST(line_no AS DOUBLE) - 10 * n AS baseline FROM new_words),
every AS (SELECT doc_id, 0 AS part, n AS a, k AS b, text, x, baseline FROM new_placed
  UNION ALL SELECT f.doc_id, 1, f.line_no, f.word_ord, f.text, f.x, 720 - 12 * CAST(f.line_no AS DOUBLE) FROM found f JOIN flat t USING (doc_id) WHERE f.line_no > t.line_no AND t.t <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, a, b) - 1 AS word_ord, text, round(x, 4) AS x, round(baseline, 4) AS baseline FROM every
"""
STREAM_FALLBACK = _STREAM_WORDS + """SELECT doc_id, word_ord, CASE WHEN word_ord = 0 THEN 'Zebra' ELSE text END AS text,
  CASE WHEN word_ord > 0 THEN 'F1' WHEN doc_id % 3 = 0 THEN 'A2FB' WHEN doc_id % 3 = 1 THEN 'A2FB1' ELSE 'A2FB2' END AS font_res FROM found
"""
STREAM_HIGHLIGHT = _STREAM_WORDS + """SELECT doc_id, count(*) AS n_bars, 'q 1 0.906 0.31 rg ' || string_agg(printf('%.3f %.3f %.3f %.3f re', x, y, w, h), ' ' ORDER BY line_no) || ' f Q' AS drawn FROM bars GROUP BY doc_id
"""

INK = """WITH px AS (SELECT user_id AS img_id, event_id AS px, CAST(event_id * 7 % 256 AS DOUBLE) AS r, CAST(event_id * 13 % 256 AS DOUBLE) AS g, CAST(floor(value) % 256 AS DOUBLE) AS b,
    (255 - 60 * CAST(event_id % 3 AS DOUBLE)) / 255 AS o FROM events WHERE value IS NOT NULL),
lit AS (SELECT img_id, px, CAST(floor(((r * o + 255 * (1 - o)) + (g * o + 255 * (1 - o)) + (b * o + 255 * (1 - o))) / 3 + 0.5) AS INTEGER) AS luma FROM px),
bins AS (SELECT img_id, luma AS bin, count(*) AS n FROM lit GROUP BY ALL),
sums AS (SELECT img_id, bin, CAST(sum(n) OVER u AS DOUBLE) AS lo, CAST(sum(bin * n) OVER u AS DOUBLE) AS lo_sum, CAST(sum(n) OVER (PARTITION BY img_id) AS DOUBLE) AS al,
    CAST(sum(bin * n) OVER (PARTITION BY img_id) AS DOUBLE) AS al_sum FROM bins WINDOW u AS (PARTITION BY img_id ORDER BY bin ROWS UNBOUNDED PRECEDING)),
apart AS (SELECT img_id, bin, CASE WHEN lo > 0 AND al - lo > 0 THEN lo * (al - lo) * (lo_sum / lo - (al_sum - lo_sum) / (al - lo)) * (lo_sum / lo - (al_sum - lo_sum) / (al - lo)) END AS between_ FROM sums),
cut AS (SELECT img_id, CASE WHEN coalesce(between_, 0) > 0 THEN bin ELSE 160 END AS threshold FROM apart
  QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY between_ DESC NULLS LAST, bin) = 1)
SELECT img_id, px, luma, CAST(luma < threshold AS INTEGER) AS mask FROM lit JOIN cut USING (img_id)
"""

STAMPS = """WITH p AS (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) * 25 + 300 AS pw, CAST(c_nationkey AS DOUBLE) * 20 + 200 AS ph FROM customer),
b AS (SELECT *, least(180, pw * CAST(0.35 AS DOUBLE)) AS w FROM p)
SELECT c_custkey, round((pw - w) / 2, 4) AS x, round(greatest(40, ph * CAST(0.15 AS DOUBLE)), 4) AS y, round(w, 4) AS w, round(w / CAST(2.5 AS DOUBLE), 4) AS h,
  round(greatest(6, least(140, w / CAST(2.5 AS DOUBLE) * CAST(0.85 AS DOUBLE))), 4) AS size FROM b
"""

PLACED_TEXT = f"""WITH rows AS (SELECT p_partkey AS text_id, unnest([p_name, p_brand]) AS line, generate_subscripts([p_name, p_brand], 1) - 1 AS line_no FROM part),
chars AS (SELECT text_id, CAST(line_no AS INTEGER) AS line_no, unnest(string_split(line, '')) AS unicode, CAST(generate_subscripts(string_split(line, ''), 1) - 1 AS INTEGER) AS "at" FROM rows WHERE line <> ''),
wide AS (SELECT *, CAST((CASE WHEN ascii(unicode) BETWEEN 32 AND 126 THEN {HELVETICA}[ascii(unicode) - 31] ELSE 556 END) * 12 AS DOUBLE) / 1000 AS width FROM chars)
SELECT text_id, line_no, "at", unicode, {_even('50 + coalesce(sum(width) OVER (PARTITION BY text_id, line_no ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS x,
  {_even("100 + CAST(40 AS DOUBLE) - 12 - CAST(1.2 AS DOUBLE) * 12 * line_no")} AS y, {_even('width')} AS width FROM wide
"""

IMAGES_FREED = """WITH RECURSIVE items AS (SELECT l_orderkey AS doc_id, l_linenumber, l_returnflag, l_partkey % 3 = 0 AS goes, 'part' || l_partkey AS part, 'supp' || l_suppkey AS supp FROM lineitem),
held AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN lead(part) OVER (PARTITION BY doc_id ORDER BY l_linenumber, part, supp) END AS next FROM items),
new AS (SELECT DISTINCT doc_id, part FROM items WHERE goes),
edges AS (
  SELECT doc_id, 'page' || l_linenumber AS source, CASE WHEN l_linenumber % 2 = 1 AND (doc_id, part) IN (SELECT doc_id, part FROM new) THEN 'new' || part ELSE part END AS target FROM items
  UNION SELECT doc_id, part, supp FROM items
  UNION SELECT doc_id, part, next FROM held WHERE next IS NOT NULL
  UNION SELECT doc_id, 'new' || part, supp FROM items SEMI JOIN new USING (doc_id, part)),
alive AS (
  SELECT doc_id, 'page' || l_linenumber AS object FROM items WHERE l_linenumber % 2 = 1
  UNION SELECT a.doc_id, e.target FROM alive a JOIN edges e ON a.doc_id = e.doc_id AND a.object = e.source),
stored AS (SELECT doc_id, part AS object FROM items UNION SELECT doc_id, supp FROM items UNION SELECT doc_id, 'new' || part FROM new)
SELECT doc_id, count(*) FILTER (alive) AS n_kept, CAST(sum(CASE WHEN alive THEN size ELSE 0 END) AS BIGINT) AS kept_bytes, CAST(sum(CASE WHEN alive THEN 0 ELSE size END) AS BIGINT) AS freed_bytes
FROM (SELECT s.doc_id, length(object) * 1000 AS size, (doc_id, object) IN (SELECT doc_id, object FROM alive) AS alive FROM stored s) GROUP BY doc_id
"""

#: BLOCKS after an edit: a word before the first page, or the first page gone.
EDITED = """(SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'Changed ' || text
  WHEN doc_id % 3 = 2 AND len(string_split(text, chr(10))) > 54 THEN array_to_string(string_split(text, chr(10))[55:], chr(10)) ELSE text END AS text FROM documents) AS edited"""
EDITED_BLOCKS = BLOCKS.replace("FROM documents", "FROM " + EDITED)


def _hits(source: str) -> str:
    found = search("the", False, False).replace("FROM documents", "FROM " + source)
    return f"SELECT doc_id, count(*) AS n FROM ({found}) GROUP BY doc_id"


REFRESHED = f"""SELECT doc_id, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, CASE WHEN a.n > 0 AND b.n > 0 THEN least(b.n - 1, a.n - 1) END AS current
FROM ({_hits('documents')}) b FULL JOIN ({_hits(EDITED)}) a USING (doc_id)"""

FIELDS_BY_KIND = """WITH writes AS (SELECT user_id AS doc_id, event_type AS name, arg_max(CASE WHEN event_id % 5 = 0 THEN 'true' ELSE 'o' || event_id % 4 END, event_id) AS new FROM events WHERE event_id % 7 <> 0 GROUP BY ALL),
fields AS (SELECT user_id AS doc_id, event_id AS page, event_type AS name, ['text', 'checkbox', 'radio', 'dropdown'][event_id % 4 + 1] AS kind, 'o' || event_id % 3 AS mine FROM events),
met AS (SELECT f.*, new, new IS NOT NULL AND (kind <> 'dropdown' OR new IN ('o1', 'o2')) AS fits FROM fields f LEFT JOIN writes w ON f.doc_id = w.doc_id AND f.name = w.name)
SELECT doc_id, page, name, kind, CASE WHEN fits AND kind <> 'checkbox' THEN new ELSE 'old' END AS value,
  CASE WHEN fits AND kind = 'checkbox' THEN new = 'true' WHEN fits AND kind = 'radio' THEN new = mine ELSE FALSE END AS checked FROM met"""

STROKE_EDITS = STROKES + f""", halved AS (SELECT *, CASE WHEN ord > floor(max(ord) OVER (PARTITION BY img_id) / 2) THEN 1 ELSE 0 END AS chain, count(*) OVER (PARTITION BY img_id) AS n FROM s),
joined AS (SELECT img_id, 0 AS chain, ord, x, y FROM halved WHERE img_id % 2 = 0 AND n > 1),
rest AS (SELECT * FROM halved WHERE NOT (img_id % 2 = 0 AND n > 1)),
seg AS (SELECT *, lead(x) OVER o AS x3, lead(y) OVER o AS y3, max(x) OVER (PARTITION BY img_id) + 1.5 AS bx FROM rest WINDOW o AS (PARTITION BY img_id, chain ORDER BY ord)),
met AS (SELECT *, (x3 - x) * 40.5 - (y3 - y) * (bx + 1.5) AS across, ((-1.5 - x) * 40.5 - (20.25 - y) * (bx + 1.5)) AS tn, ((-1.5 - x) * (y3 - y) - (20.25 - y) * (x3 - x)) AS un FROM seg WHERE x3 IS NOT NULL),
cuts AS (SELECT *, tn / across AS t FROM met WHERE abs(across) >= 1e-9 AND tn / across > 1e-6 AND tn / across < 1 - 1e-6 AND un / across > 1e-6 AND un / across < 1 - 1e-6),
parts AS (
  SELECT img_id, chain, ord, 0 AS side, x, y FROM rest
  UNION ALL SELECT img_id, chain, ord, 1, x + t * (x3 - x), y + t * (y3 - y) FROM cuts
  UNION ALL SELECT img_id, chain, ord, 2, x + t * (x3 - x), y + t * (y3 - y) FROM cuts),
numbered AS (SELECT *, sum(CASE WHEN side = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY img_id, chain ORDER BY ord, side ROWS UNBOUNDED PRECEDING) AS part FROM parts),
cut AS (SELECT img_id, dense_rank() OVER (PARTITION BY img_id ORDER BY chain, part) - 1 AS chain, row_number() OVER (PARTITION BY img_id, chain, part ORDER BY ord, side) - 1 AS ord, x, y FROM numbered)
SELECT img_id, chain, ord, {_even('x')} AS x, {_even('y')} AS y FROM (SELECT * FROM joined UNION ALL SELECT * FROM cut)"""
