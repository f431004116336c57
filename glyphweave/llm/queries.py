"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphweave.llm import (
    ann_postings,
    collocations,
    decontaminate,
    fill_in_middle,
    hilbert_packing,
    jaccard_join,
    quality_gam,
    repeats,
    reshard,
    secret_scan,
    token_counts,
    toxicity,
    url_filter,
)
from glyphweave.llm.labelled import fold_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return secret_scan.findings(docs, secret_scan.train(secret_scan.sample_findings(spark)))


def op2_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return hilbert_packing.piece_digest(hilbert_packing.pack(docs))


#: Dated entries of made-up lists: (list, pattern, category, action, day of 2024, order within a day).
LIST_ENTRIES = [
    ("gambling", "casino-win.example.com", "gambling", "add", "2023-06-01", 1),
    ("gambling", "casino-win.example.net", "gambling", "add", "2024-02-10", 1),
    ("gambling", "casino-win.example.org", "gambling", "add", "2024-05-01", 1),
    ("gambling", "free-bets.example.com", "gambling", "add", "2024-01-15", 1),
    ("gambling", "free-bets.example.com", "gambling", "remove", "2024-07-01", 1),
    ("gambling", "free-bets.example.com", "gambling", "add", "2024-10-01", 1),
    ("gambling", "free-bets.example.net", "gambling", "add", "2024-03-01", 1),
    ("gambling", "free-bets.example.org", "gambling", "add", "2024-03-01", 1),
    ("adult", "adult-x.example.com", "adult", "add", "2022-01-01", 1),
    ("adult", "adult-x.example.net", "adult", "add", "2024-04-01", 1),
    ("adult", "adult-x.example.net", "adult", "remove", "2024-04-01", 2),
    ("adult", "adult-x.example.org", "adult", "add", "2024-08-20", 1),
    ("spam", "spam-farm.example.com", "spam", "add", "2024-01-02", 1),
    ("spam", "spam-farm.example.net", "spam", "add", "2024-06-15", 1),
    ("spam", "*.spam-farm.example.org", "spam", "add", "2023-11-11", 1),
    ("spam", "cheap-pills.example.com", "spam", "add", "2024-01-20", 1),
    ("spam", "cheap-pills.example.net", "spam", "add", "2023-01-20", 1),
    ("spam", "cheap-pills.example.net", "spam", "remove", "2024-09-09", 1),
    ("spam", "cheap-pills.example.org", "spam", "add", "2024-01-20", 1),
    ("ads", "ads-track.example.com", "ads", "add", "2024-02-01", 1),
    ("ads", "ads-track.example.net", "ads", "add", "2024-02-01", 1),
    ("ads", "ads-track.example.org", "ads", "add", "2024-12-01", 1),
    ("review", "example.org", "untrusted", "add", "2024-06-01", 1),
    ("review", "example.org", "untrusted", "remove", "2024-06-15", 1),
    ("review", "tionsh.example.com", "untrusted", "add", "2024-03-10", 1),
    ("review", "tionsh.example.com", "untrusted", "remove", "2024-04-10", 1),
    ("review", "blog.tionsh.example.com", "allow", "add", "2024-03-20", 1),
    ("review", "tionble.example.org/de", "untrusted", "add", "2024-05-05", 1),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` has no fetch times, so page_id stands for the day of 2024 on which a page was fetched."""
    day = F.make_dt_interval((F.col("page_id") % 366).cast("int"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", (F.lit("2024-01-01").cast("timestamp") + day).alias("fetched_at"))
    names = "list_name string, pattern string, category string, action string, day string, seq int"
    entries = spark.createDataFrame(LIST_ENTRIES, names).withColumn("dated", F.col("day").cast("timestamp"))
    return url_filter.judge(captures, entries).withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd"))


def _entry_values() -> str:
    return ", ".join(f"('{a}', '{b}', '{c}', '{d}', TIMESTAMP '{e}', {f})" for a, b, c, d, e, f in LIST_ENTRIES)


def op3_sql() -> str:
    return rf"""
WITH entries(list_name, raw, category, action, dated, seq) AS (VALUES {_entry_values()}),
named AS (SELECT list_name, regexp_replace(lower(trim(raw)), '^(\*\.|www\.)', '') AS pattern, category, action, dated, seq FROM entries),
last AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY list_name, pattern, dated ORDER BY seq DESC) = 1),
turns AS (SELECT *, lead(dated) OVER (PARTITION BY list_name, pattern ORDER BY dated) AS valid_to FROM last),
active AS (SELECT list_name, pattern, category, dated AS valid_from, valid_to FROM turns WHERE action = 'add'),
caps AS (
  SELECT page_id, TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 366 AS INTEGER)) AS fetched_at,
    lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')) AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS parts
  FROM pages),
keyed AS (
  SELECT DISTINCT page_id, fetched_at, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(parts) + 1), lambda i: regexp_replace(host, '^www\.', '') || '/' || array_to_string(parts[1:i], '/')))) AS pattern
  FROM caps WHERE host <> ''),
met AS (
  SELECT k.page_id, a.category, a.pattern, length(a.pattern) AS k FROM keyed k JOIN active a ON k.pattern = a.pattern
   AND k.fetched_at >= a.valid_from AND (a.valid_to IS NULL OR k.fetched_at < a.valid_to)),
hits AS (
  SELECT page_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT category)), ',') AS found,
    arg_min(pattern, lpad(CAST(1000000 - k AS VARCHAR), 8, '0') || pattern) AS longest,
    max(CASE WHEN category = 'allow' THEN k END) AS exempt_size, max(CASE WHEN category <> 'allow' THEN k END) AS blocked_size
  FROM met GROUP BY page_id)
SELECT c.page_id, c.host, strftime(c.fetched_at, '%Y-%m-%d') AS fetched_at, coalesce(h.n, 0) AS n_active, coalesce(h.found, '') AS categories,
  h.longest AS pattern, coalesce(h.blocked_size IS NOT NULL AND coalesce(h.exempt_size, -1) < h.blocked_size, FALSE) AS blocked
FROM caps c LEFT JOIN hits h USING (page_id)
"""


def held_out(folds: int, fold: int) -> Column:
    return F.coalesce(fold_of("doc_id", folds) == fold, F.lit(False))


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 5) != 0)
    scored = quality_gam.score(docs, model)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text")
    return token_counts.limit_report(token_counts.length_histogram(docs))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 4) != 2)
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


#: The shards that documents lie in before op8 moves them.
OLD_SHARDS = 12


def op8_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32")
    )
    old = F.coalesce(fold_of("doc_id", OLD_SHARDS), F.lit(0))
    moved = reshard.reshard(docs, old, OLD_SHARDS, 16, ["doc_id", "text_crc32"])
    return moved.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped, _ = jaccard_join.linked_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return grouped.select("doc_id", "n_shingles", "component_id")


def op10_ann_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_postings.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return found.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_hilbert_packing,
        op3_url_filter,
        op4_quality_gam,
        op5_token_counts,
        op6_toxicity,
        op7_decontaminate,
        op8_reshard,
        op9_jaccard_join,
        op10_ann_postings,
        op11_phrases,
        op12_repeats,
        op13_fill_in_middle,
    )
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(source: str, key: str, pattern: str) -> str:
    """(key, n, k, word): the words of each text in order, k from 1 of n."""
    return f"""SELECT {key}, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS k
  FROM (SELECT {key}, regexp_extract_all({_LOWER}, '{pattern}') AS ws FROM {source} WHERE text IS NOT NULL)"""


def op7_sql(window: int = 13) -> str:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lists = f"list(word) OVER (PARTITION BY {{key}} ORDER BY k ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)"
    return rf"""
WITH docs AS (SELECT *, row_number() OVER () AS row_no FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, text, row_number() OVER () AS item_no FROM benchmark WHERE item_id IS NOT NULL),
dw AS ({_words("docs", "row_no", pattern)}),
iw AS ({_words("items", "item_no, item", pattern)}),
runs AS (SELECT row_no, n, k, {lists.format(key="row_no")} AS ahead FROM dw),
windows AS (SELECT DISTINCT item, least(n, {window}) AS size, array_to_string(ahead, ' ') AS win
  FROM (SELECT item, n, k, {lists.format(key="item_no")} AS ahead FROM iw) WHERE k + least(n, {window}) - 1 <= n),
met AS (SELECT r.row_no, r.k, w.size, w.item
  FROM (SELECT r.*, s.size, array_to_string(ahead[1:s.size], ' ') AS win FROM runs r JOIN (SELECT DISTINCT size FROM windows) s ON k + s.size - 1 <= n) r
  JOIN windows w ON r.size = w.size AND r.win = w.win),
hit AS (SELECT row_no, count(DISTINCT spot) AS n_hit FROM (SELECT row_no, unnest(range(k, k + size)) AS spot FROM (SELECT DISTINCT row_no, k, size FROM met)) GROUP BY row_no),
found AS (SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_no, item FROM met) GROUP BY row_no),
counted AS (SELECT row_no, any_value(n) AS n_words FROM dw GROUP BY row_no)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(n_words, 0) AS contaminated
FROM docs LEFT JOIN counted USING (row_no) LEFT JOIN hit USING (row_no) LEFT JOIN found USING (row_no)
"""


def op9_sql(rule: jaccard_join.Rule = jaccard_join.RULE) -> str:
    ahead = " || ".join(["word", *(f"coalesce(' ' || lead(word, {k}) OVER o, '')" for k in range(1, rule.width))])
    return rf"""
WITH RECURSIVE docs AS (SELECT doc_id, text, row_number() OVER () AS row_no FROM documents),
w AS ({_words("docs", "row_no", r"[^\x20\x09-\x0D]+")}),
sets AS (SELECT DISTINCT row_no, run FROM (SELECT row_no, n, k, {ahead} AS run FROM w WINDOW o AS (PARTITION BY row_no ORDER BY k)) WHERE k <= greatest(n - {rule.width - 1}, 1)),
sizes AS (SELECT row_no, count(*) AS n FROM sets GROUP BY row_no),
shared AS (SELECT a.row_no AS a, b.row_no AS b, count(*) AS common FROM sets a JOIN sets b ON a.run = b.run AND a.row_no <> b.row_no GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.row_no JOIN sizes y ON b = y.row_no WHERE {rule.under} * common >= {rule.over} * (x.n + y.n - common)),
reach AS (SELECT row_no, row_no AS other FROM docs UNION SELECT r.row_no, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT r.row_no, min(d.doc_id) AS component_id FROM reach r JOIN docs d ON r.other = d.row_no GROUP BY r.row_no)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM docs LEFT JOIN sizes USING (row_no) JOIN least USING (row_no)
"""


def op11_sql(spec: collocations.PhraseSpec = collocations.PhraseSpec()) -> str:
    """For phrases of at most three words."""
    return rf"""
WITH pieces AS (SELECT lang, row_number() OVER () AS piece, part FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?
-]')) AS part FROM documents WHERE text IS NOT NULL)),
w AS (SELECT lang, piece, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM (SELECT lang, piece, regexp_extract_all(part, '[^ 	]+') AS ws FROM pieces)),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
ones AS (SELECT lang, word, count(*) AS f FROM w GROUP BY ALL),
ahead AS (SELECT lang, word AS a1, lead(word) OVER o AS a2, lead(word, 2) OVER o AS a3 FROM w WINDOW o AS (PARTITION BY piece ORDER BY k)),
twos AS (SELECT lang, a1, a2, count(*) AS f FROM ahead WHERE a2 IS NOT NULL GROUP BY ALL),
threes AS (SELECT lang, a1, a2, a3, count(*) AS f FROM ahead WHERE a3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {spec.least}),
cuts AS (
  SELECT b.lang, a1 || ' ' || a2 AS phrase, b.f AS a, 1 AS k, x.f AS l, y.f AS r FROM twos b JOIN ones x ON x.lang = b.lang AND x.word = a1 JOIN ones y ON y.lang = b.lang AND y.word = a2
   WHERE b.f >= {spec.least} AND NOT EXISTS (SELECT 1 FROM (SELECT lang, a1, a2, f FROM threes UNION ALL SELECT lang, a2, a3, f FROM threes) t
    WHERE t.lang = b.lang AND t.a1 = b.a1 AND t.a2 = b.a2 AND 100 * t.f >= {spec.inside} * b.f)
  UNION ALL SELECT t.lang, t.a1 || ' ' || t.a2 || ' ' || a3, t.f, 1, x.f, y.f FROM threes t JOIN ones x ON x.lang = t.lang AND x.word = t.a1 JOIN twos y ON y.lang = t.lang AND y.a1 = t.a2 AND y.a2 = a3
  UNION ALL SELECT t.lang, t.a1 || ' ' || t.a2 || ' ' || a3, t.f, 2, x.f, y.f FROM threes t JOIN twos x ON x.lang = t.lang AND x.a1 = t.a1 AND x.a2 = t.a2 JOIN ones y ON y.lang = t.lang AND y.word = a3),
scored AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {spec.top}
"""


def op13_sql(spec: fill_in_middle.FillSpec = fill_in_middle.FillSpec()) -> str:
    draw = [f"CAST('0x' || h[{8 * k + 1}:{8 * k + 8}] AS BIGINT)" for k in range(4)]
    return rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{spec.salt}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u FROM docs),
drawn AS (SELECT *, len(u) AS n, {draw[0]} % (len(u) + 1) AS d1, {draw[1]} % (len(u) + 1) AS d2,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {draw[2]} % 100 >= {100 - spec.plain} THEN 'plain'
    WHEN {draw[3]} % 100 < {spec.suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT *, array_to_string(u[1:least(d1, d2)], '') AS p, array_to_string(u[least(d1, d2) + 1:greatest(d1, d2)], '') AS m, array_to_string(u[greatest(d1, d2) + 1:], '') AS s FROM drawn),
made AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM made
"""


ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": op3_sql(),
    "op7_decontaminate": op7_sql(),
    "op9_jaccard_join": op9_sql(),
    "op11_phrases": op11_sql(),
    "op13_fill_in_middle": op13_sql(),
}
