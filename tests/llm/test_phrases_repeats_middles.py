"""Collocations, removal of repeated strings and fill-in-middle against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from glyphweave.llm import collocations, fill_in_middle, queries, repeats, texthash
from tests.llm.test_llm_queries import TRICKY


@pytest.fixture(scope="module")
def docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pandas()


def odd_rows(spark, *clashing):
    rows = [(k, t, "en" if k % 2 else None) for k, t in enumerate(TRICKY)] * 2 + [(None, "one two three four five <P>", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in clashing:
        df = df.withColumn(name, F.lit("x"))
    return df


def sql_rows(sf, sql):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    return con.sql(sql).fetchall()


# collocations


def phrases_by_hand(rows, spec):
    words, found, totals = defaultdict(Counter), defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            ws = re.findall("[^ \t]+", piece)
            totals[lang] += len(ws)
            words[lang].update(ws)
            for size in range(1, spec.longest + 1):
                found[lang].update(tuple(ws[k : k + size]) for k in range(len(ws) - size + 1))
    out = []
    for lang, f in found.items():
        candidates = {p for p, a in f.items() if len(p) > 1 and a >= spec.least}
        rows = []
        for p in candidates:
            a = f[p]
            longer = [q for q in candidates if len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))]
            if any(100 * f[q] >= spec.inside * a for q in longer):
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        rows.sort()
        out += [(lang, k + 1, p.decode(), -a, left, right, totals[lang], -s) for k, (s, a, p, left, right) in enumerate(rows[: spec.top])]
    return sorted(out)


def test_phrases_by_hand(spark):
    rng = random.Random(5)
    vocabulary = ["the", "The", "of", "été", "漢字", "a'b", "x-1", "\x1c", "zz"]
    rows = [(None, "en"), ("", "en"), ("x " * 3000, "de")]
    for k in range(300):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "!?"]) for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "en", "de", None, ""])))
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("n", F.lit("x")).withColumn("rank", F.lit(1)).repartition(5)
    for spec in (collocations.PhraseSpec(), collocations.PhraseSpec(longest=4, least=3, top=40, filter_bits=12), collocations.PhraseSpec(longest=2, least=50)):
        assert sorted(map(tuple, collocations.collocations(df, spec).collect())) == phrases_by_hand(rows, spec)


def test_phrases_on_the_table(spark, sf, docs):
    got = sorted(map(tuple, queries.op11_phrases(spark, sf).collect()))
    assert got == phrases_by_hand(zip(docs.text, docs.lang, strict=True), collocations.PhraseSpec())
    assert got == sorted(sql_rows(sf, queries.op11_sql()))


def test_phrases_of_odd_rows(spark):
    df = odd_rows(spark, "word", "w0", "words", "a")
    spec = collocations.PhraseSpec(least=2)
    assert sorted(map(tuple, collocations.collocations(df, spec).collect())) == phrases_by_hand([(r.text, r.lang) for r in df.collect()], spec)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_scores_past_64_bits(spark):
    for a, left, right in ((10**12, 10**12, 3 * 10**12), (2**40, 2**41, 2**40 + 1)):
        df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
        assert df.select(collocations.exact_score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 1000000 * a * a // (left * right)


def test_small_buffers_change_nothing(spark, sf, monkeypatch):
    whole = sorted(map(tuple, queries.op11_phrases(spark, sf).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, queries.op11_phrases(spark, sf).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# repeated strings


def kept_by_hand(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in bodies for k in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        out.append((bytes(np.frombuffer(b, np.uint8)[~gone]), list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))))
    return out


def compare_repeats(df, spec):
    rows = repeats.without_repeats(df, spec).collect()
    wanted = {}
    texts = [(r.doc_id, r.text) for r in df.collect()]
    for (doc_id, text), (kept, spans) in zip(texts, kept_by_hand([t for _, t in texts], spec.length), strict=True):
        wanted.setdefault((doc_id, text), []).append((kept, spans))
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.text), []).append((bytes(r.kept), [(s.lo, s.hi) for s in r.spans]))
    assert got == wanted


def mosaic(seed, n=250):
    """Texts of random parts of shared passages, periodic runs and noise."""
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choice("abcdefghé ") for _ in range(k))
    shared = [noise(rng.randint(20, 300)) for _ in range(12)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            if kind < 0.5:
                s = rng.choice(shared)
                a = rng.randint(0, len(s) // 3)
                parts.append(s[a : len(s) - rng.randint(0, len(s) // 3)])
            elif kind < 0.6:
                parts.append(rng.choice(["ab", "x", "-- ", "é"]) * rng.randint(1, 60))
            else:
                parts.append(noise(rng.randint(0, 50)))
        texts.append("".join(parts))
    texts += rng.choices(texts, k=40)
    return texts


@pytest.mark.parametrize("shard", [50_000, 3])
def test_repeats_by_hand(spark, shard):
    texts = mosaic(shard)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    compare_repeats(df, repeats.RepeatSpec(length=40, anchor=12, shard=shard))


def test_repeats_without_broadcasts(spark, monkeypatch):
    from glyphweave.llm import workspace

    monkeypatch.setattr(workspace, "fits", lambda small, most: False)
    df = spark.createDataFrame(list(enumerate(mosaic(9, 120))), "doc_id long, text string").repartition(3)
    compare_repeats(df, repeats.RepeatSpec(length=30, anchor=8))


def test_repeats_of_odd_rows(spark):
    df = odd_rows(spark, "digest", "spans", "kept", "body", "h", "row")
    spec = repeats.RepeatSpec(length=20, anchor=6)
    compare_repeats(df, spec)
    got = repeats.without_repeats(df, spec)
    assert got.columns == ["doc_id", "text", "lang", "digest", "body", "h", "row", "spans", "kept"]
    assert repeats.without_repeats(df.limit(0)).count() == 0


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STEP", 64)
    spec = repeats.RepeatSpec(length=40, anchor=12)
    buf = np.frombuffer("".join(mosaic(4, 20)).encode(), np.uint8)
    parts = [np.concatenate(c) for c in zip(*repeats.tuples(buf, spec), strict=True)]
    hashes = texthash.window_hashes(buf, spec.anchor)
    for h, place, first, n in zip(*parts, strict=True):
        for a in range(first, first + n):
            window = hashes[a : a + spec.reach]
            assert place == a + int(np.argmin(window >> np.uint64(32))) and h == hashes[place]
    assert parts[3].sum() == len(buf) - spec.length + 1


def test_repeats_on_the_table(spark, sf, docs):
    spec = repeats.RepeatSpec()
    got = sorted(map(tuple, queries.op12_repeats(spark, sf).collect()))
    wanted = []
    for doc_id, text, (kept, spans) in zip(docs.doc_id, docs.text, kept_by_hand(docs.text, spec.length), strict=True):
        size = len((text or "").encode())
        wanted.append((doc_id, size, size - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(wanted)
    assert sum(r[2] for r in got)


# fill-in-middle


def middle_by_hand(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_middles_on_the_table(spark, sf, docs):
    got = sorted(map(tuple, queries.op13_fill_in_middle(spark, sf).collect()))
    made = [(d, t, *middle_by_hand(d, t)) for d, t in zip(docs.doc_id, docs.text, strict=True)]
    assert got == sorted((d, *rest, sha(out), sha(t or "")) for d, t, *rest, out in made)
    assert got == sorted(sql_rows(sf, queries.op13_sql()))
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_middles_of_odd_texts(spark):
    rng = random.Random(2)
    parts = ["a", "Z", "word", " ", "\n", "<", "<P", "S>", "<M", "é", "漢", "\U0001f600", "\x00", "1", ">", "K"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = fill_in_middle.transform(df).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    for r in made:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == middle_by_hand(r.doc_id, r.text)
        assert r.back == r.text


def test_middles_of_odd_rows(spark):
    df = odd_rows(spark, "n", "form", "draws", "output")
    made = fill_in_middle.transform(df)
    assert made.columns == ["doc_id", "text", "lang", "draws", "n", "form", "prefix_chars", "middle_chars", "output"]
    for r in made.collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == middle_by_hand(r.doc_id, r.text)
    assert fill_in_middle.transform(df.limit(0)).count() == 0
