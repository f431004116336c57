"""The ten operators against brute force, exact round trips, SQL or held-out labels."""

import hashlib
import re
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from glyphweave.llm import (
    ann_postings,
    components,
    decontaminate,
    hilbert_packing,
    jaccard_join,
    quality_gam,
    queries,
    reshard,
    secret_scan,
    token_counts,
    toxicity,
    url_filter,
)
from glyphweave.llm.encoding import encoder, vocabulary

TRICKY = [
    None,
    "",
    "   \n\t ",
    "one",
    "One two",
    "a b c d e f g h i j k l m n o p q r s t u v w x y z",
    "A B C D E F G H I J K L M N O P Q R S T U V W X Y Z",
    "word " * 5000,
    "x" * 20000,
    "Ünïcode ß ñ — “quotes” 漢字 שלום \U0001f600 a\x1cb\xa0c <|endoftext|>",
]


def tricky(spark, extra=True):
    rows = [(k, t, "en") for k, t in enumerate(TRICKY)] + [(3, "one", "en"), (None, "one two three four five", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    if extra:  # names that operators use themselves
        for name in ("n_words", "spans", "score", "predicted", "row_no", "size", "shard", "label"):
            df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pandas()


# packing


def check_pieces(pieces, texts, length=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    expected = defaultdict(list)
    for doc_id, text in texts:
        expected[doc_id].append(tok.encode(text or "", add_special_tokens=False).ids + [1])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for doc_id, wanted in expected.items():
        mine = sorted(by_doc[doc_id], key=lambda p: p.start)
        assert sum(p.length for p in mine) == sum(map(len, wanted))
        if len(wanted) == 1:
            at = 0
            for p in mine:
                assert (p.start, p.doc_tokens) == (at, len(wanted[0]))
                assert p.ids_crc32 == zlib.crc32(np.array(wanted[0][at : at + p.length], "<u4").tobytes())
                at += p.length
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    total = sum(p.length for p in pieces)
    assert len(by_seq) == -(-total // length)


def test_packing_is_a_round_trip(spark, sf, docs):
    check_pieces(queries.op2_hilbert_packing(spark, sf).collect(), list(zip(docs.doc_id, docs.text, strict=True)))


def test_packing_of_odd_rows(spark):
    df = tricky(spark)
    pieces = hilbert_packing.piece_digest(hilbert_packing.pack(df)).collect()
    check_pieces(pieces, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert hilbert_packing.pack(empty(spark)).count() == 0


def test_sequences_follow_the_curve(spark, sf, docs):
    spec = hilbert_packing.PackingSpec()
    ids, ends = encoder(vocabulary()).encode(pa.array(docs.text, pa.string()))
    keys = dict(zip(docs.doc_id, hilbert_packing.curve_keys(ids, ends, spec).tolist(), strict=True))
    pieces = queries.op2_hilbert_packing(spark, sf).where("start = 0").orderBy("sequence_id", "offset").collect()
    along = [keys[p.doc_id] for p in pieces]
    assert along == sorted(along) and len(set(along)) > len(along) / 2


def test_sequences_are_whole(spark):
    spec = hilbert_packing.PackingSpec(length=64)
    found = hilbert_packing.sequences(hilbert_packing.pack(tricky(spark), spec), spec).collect()
    assert all(len(r.tokens) == 64 for r in found)
    assert sorted(r.sequence_id for r in found) == list(range(len(found)))


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = hilbert_packing.hilbert_key(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_encoder_on_random_texts():
    from tokenizers import Tokenizer

    tok, enc, rng = Tokenizer.from_file(vocabulary()), encoder(vocabulary()), np.random.default_rng(3)
    odd = ["é", "É", "ß", "Ñ", "İ", "ı", "Ȁ", "ɐ", "Ω", "ς", "漢", "\u0301", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "ª", "²", "½", "\x00", "\x7f", "\xad", "Ⱥ", "🙂"]
    parts = [*"aAbBzZ019 '.,!?-_\t\n\r\x0b|/\"\\sStTdDmMvVeErRlL", *odd, "<|endoftext|>", "<|startoftext|>", "<|", "'s", "'LL", "can't", "a" * 20, "7" * 18]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 50)))) for _ in range(6000)]
    ids, ends = enc.encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert tok.encode(text, add_special_tokens=False).ids == ids[ends[k] : ends[k + 1]].tolist(), text
    assert enc.lengths(pa.array(texts)).tolist() == np.diff(ends).tolist()


def test_encoder_equals_tokenizer(docs):
    enc = encoder(vocabulary())
    for text in [*docs.text[:60], *TRICKY[1:]]:
        assert enc.ids(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


# quality and toxicity


def test_quality_on_held_out_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    found = queries.op4_quality_gam(spark, sf).toPandas()
    merged = found.merge(pq.read_table(f"{sf}/labels.parquet").to_pandas(), on="doc_id")
    held = merged[merged.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert found.score.between(0, 1).all()
    crc = found.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)
    assert (crc == found.held_out).all()


def test_gam_learns_a_pair():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_quality_of_odd_rows(spark):
    model = quality_gam.train(tricky(spark), spark.createDataFrame([(3, 1), (5, 0), (None, 1), (7, None)], "doc_id long, quality int"), F.lit(True))
    got = quality_gam.score(tricky(spark), model).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert quality_gam.score(empty(spark), model).count() == 0
    none = quality_gam.train(empty(spark), spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert quality_gam.score(tricky(spark), none).where("score = 0.5").count() == 12


def test_toxicity_on_held_out_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    found = queries.op6_toxicity(spark, sf).toPandas()
    merged = found.merge(pq.read_table(f"{sf}/labels.parquet").to_pandas(), on="doc_id")
    held = merged[merged.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95


def test_toxicity_folding_and_exceptions(spark):
    lex = toxicity.Lexicon({"idiot": 5.0, "trash*": 4.0}, ("trash can",), (-4.0, 1.0, 2.0))
    rows = [(1, "you 1d10t"), (2, "уоu іdіоt"), (3, "a trash can"), (4, "trashy talk"), (5, "nice"), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(df, lex).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0, 7: 0}
    assert toxicity.score(tricky(spark), lex).count() == 12
    none = toxicity.train(empty(spark), spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.score(tricky(spark), none).where("predicted = 0").count() == 12


# decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_toxicity_weighs_rare_entries(spark):
    rng = np.random.default_rng(9)
    vocabulary = ["".join(w) for w in rng.choice(list("abcdefghkmnopqrstuvwxyz"), (4000, 12))]
    rows = []
    for k in range(56):  # every word and beginning stands in about 8 neighbourhoods of toxic texts and 48 of clean ones
        words = rng.permutation(vocabulary).tolist()
        if k < 6:
            words.insert(2000, "grobian")
        rows.append((k, " ".join(words), int(k < 8)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    lexicon = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    assert "grobian" in lexicon.weights


def test_toxicity_learns_exception_phrases(spark):
    rng = np.random.default_rng(4)
    filler = ["".join(w) for w in rng.choice(list("abcdefghkmnopqrstuvwxyz"), (400, 9))]
    rows = []
    for k in range(240):
        words = rng.choice(filler, 40).tolist()
        if k < 60:
            words[20:20] = ["grobian"]
        elif k < 100:
            words[20:20] = ["meister", "grobian"]
        rows.append((k, " ".join(words), int(k < 60)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    assert "grobian" not in lexicon.weights or "meister grobian" in lexicon.exceptions
    asked = spark.createDataFrame([(1, " ".join(filler[:20]) + " grobian"), (2, " ".join(filler[:20]) + " meister grobian")], "doc_id long, text string")
    plain, excused = (r.score for r in toxicity.score(asked, lexicon).orderBy("doc_id").collect())
    assert excused <= plain


def brute_total(text, lexicon):
    """Weights of leftmost longest matches, tried position by position."""
    words = toxicity.folded_words(text)
    laid = " " + "  ".join(words) + " " if words else ""
    known = {}
    for e, w in lexicon.weights.items():
        known[toxicity._pattern(e)] = max(w, known.get(toxicity._pattern(e), -1.0))
    known |= {"".join(f" {w} " for w in toxicity.folded_words(p)): 0.0 for p in lexicon.exceptions}
    at, total = 0, 0.0
    while at < len(laid):
        best = max((k for k in known if laid.startswith(k, at)), key=len, default="")
        total += known.get(best, 0.0)
        at += len(best) or 1
    return total


def test_toxicity_matches_by_brute_force():
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abc"), int(rng.integers(3, 7)))) for _ in range(60)]
    lexicon = toxicity.Lexicon({w: float(k + 1) for k, w in enumerate(words[:20])} | {f"{w[:3]}*": 0.5 for w in words[10:30]}, (f"{words[0]} {words[1]}", words[2]))
    automaton = toxicity._automaton(tuple(lexicon.weights.items()), lexicon.exceptions)
    for _ in range(300):
        text = " ".join(rng.choice(words, int(rng.integers(0, 30))))
        assert abs(toxicity.matches(toxicity.folded_words(text), automaton) - brute_total(text, lexicon)) < 1e-9


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_contamination(docs, items, window=13):
    index = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w and item is not None else ():
            index[tuple(w[k : k + n])].add(str(item))
    sizes = {len(k) for k in index}
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (ids := index.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= ids
        yield doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination_is_exact(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = [tuple(r) for r in queries.op7_decontaminate(spark, sf).collect()]
    docs = pq.read_table(f"{sf}/documents.parquet").to_pandas()
    items = pq.read_table(f"{sf}/benchmark.parquet").to_pandas()
    want = list(brute_contamination(zip(docs.doc_id, docs.text, strict=True), list(zip(items.item_id, items.text, strict=True))))
    assert sorted(got) == sorted(want)
    assert sum(r[5] for r in got)


def test_decontamination_in_blocks_and_odd_rows(spark, monkeypatch):
    items = [(1, "a b c d e f g h i j k l m n o"), (2, "one two"), (3, None), (4, "!!"), (2, "one two"), (None, "q r s"), (5, "漢字 שלום"), (6, "word word word")]
    df = tricky(spark)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute_contamination([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], items), key=str)
    for size in (400_000, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", size)
        found = decontaminate.contamination(df, bench)
        sha = F.sha2(F.concat_ws(",", "items"), 256)
        got = [tuple(r) for r in found.select("doc_id", "n_words", "n_hit", F.size("items"), sha, "contaminated").collect()]
        assert sorted(got, key=str) == want
    none = decontaminate.contamination(df, bench.limit(0))
    assert none.where("contaminated or n_hit > 0").count() == 0 and none.count() == 12
    assert decontaminate.contamination(empty(spark), bench).count() == 0


def test_decontamination_of_repeated_windows(spark):
    docs = spark.createDataFrame([(1, "word " * 5000), (2, "other " + "word " * 20), (3, "word " * 12)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, "word " * 5000) for k in range(1, 4)], "item_id long, text string")
    began = time.perf_counter()
    got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench).collect())
    assert got == [(1, 5000, 5000, ["1", "2", "3"]), (2, 21, 20, ["1", "2", "3"]), (3, 12, 0, [])]
    assert time.perf_counter() - began < 60


# resharding


def test_flow_is_cheapest():
    from itertools import product

    supply, demand = [3, 2, 1], [2, 2, 2]
    price = lambda i, j: 0 if i == j else 1 + (i * 2 + j) % 3
    flow = reshard.min_cost_flow(supply, demand, price)
    best = min(
        sum(price(i, j) * x for (i, j), x in zip(product(range(3), range(3)), cells, strict=True))
        for cells in product(range(4), repeat=9)
        if all(sum(cells[3 * i : 3 * i + 3]) == supply[i] for i in range(3)) and all(sum(cells[j::3]) == demand[j] for j in range(3))
    )
    assert sum(price(*k) * v for k, v in flow.items()) == best


def test_reshard_balances_and_moves_little(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = queries.op8_reshard(spark, sf).toPandas()
    docs = pq.read_table(f"{sf}/documents.parquet").to_pandas()
    size = {d: len((t or "").encode()) + 1 for d, t in zip(docs.doc_id, docs.text, strict=True)}
    crc = {d: zlib.crc32((t or "").encode()) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    assert dict(zip(got.doc_id, got["size"], strict=True)) == size
    assert dict(zip(got.doc_id, got.text_crc32, strict=True)) == crc
    per = got.groupby("shard")["size"].sum()
    assert len(per) == 16 and (per.max() - per.min()) / per.mean() < 0.02
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    old = got.groupby("old_shard")["size"].sum()
    least = sum(max(0, b - got["size"].sum() // 16) for b in old)
    assert got[got.old_shard != got.shard]["size"].sum() <= least * 1.02 + 16 * 200


def test_reshard_of_odd_rows(spark, tmp_path):
    df = tricky(spark).select("doc_id", "text", (F.length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"))
    moved = reshard.reshard(df, F.coalesce(F.pmod("doc_id", F.lit(3)), F.lit(0)), 3, 4, ["doc_id", "text"])
    assert moved.count() == 12
    assert {(r.doc_id, r.text) for r in moved.collect()} == {(r.doc_id, r.text) for r in df.collect()}
    bare = df.withColumn("size", F.when(F.col("doc_id") > 5, F.lit(0)).when(F.col("doc_id") < 3, F.col("size")).cast("long"))
    placed = reshard.reshard(bare, F.when(F.col("doc_id") != 2, F.pmod("doc_id", F.lit(3))), 3, 4, ["doc_id"]).collect()
    assert len(placed) == 12
    for shard in range(4):
        assert sorted(r.slot for r in placed if r.shard == shard) == list(range(sum(r.shard == shard for r in placed)))
    touched = {r.shard for r in reshard.rewrite(moved, str(tmp_path / "shards")).collect()}
    again = spark.read.parquet(str(tmp_path / "shards"))
    assert again.count() == moved.where(F.col("shard").isin(*touched)).count()
    assert reshard.reshard(df.limit(0), F.lit(0), 3, 4, ["doc_id"]).count() == 0


def test_odd_shards_are_errors(spark):
    df = spark.createDataFrame([(k, 5, "x", k % 3) for k in range(12)], "doc_id long, size long, weight string, old int")
    for shift in (-1, 1):
        with pytest.raises(ValueError, match="old shards outside"):
            reshard.reshard(df, F.col("old") + shift, 3, 4, ["doc_id"])
    with pytest.raises(ValueError, match="can't be carried"):
        reshard.reshard(df, F.col("old"), 3, 4, ["doc_id", "size"])
    moved = reshard.reshard(df.withColumnRenamed("old", "one"), F.col("one"), 3, 4, ["doc_id", "weight", "one"]).collect()
    assert sorted(r.doc_id for r in moved) == list(range(12)) and {r.weight for r in moved} == {"x"}


def test_staying_is_the_cheapest_flow():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, m = rng.integers(1, 7, 2)
        supply, demand = rng.integers(0, 30, n), rng.integers(0, 30, m)
        demand[0] += max(supply.sum() - demand.sum(), 0)
        supply[0] += max(demand.sum() - supply.sum(), 0)
        quick, slow = reshard.stay_or_move(supply.tolist(), demand.tolist()), reshard.min_cost_flow(supply.tolist(), demand.tolist(), lambda i, j: int(i != j))
        for flow in (quick, slow):
            assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(n)] == supply.tolist()
            assert [sum(v for (_, j), v in flow.items() if j == k) for k in range(m)] == demand.tolist()
        assert sum(v for (i, j), v in quick.items() if i != j) == sum(v for (i, j), v in slow.items() if i != j)
    began = time.perf_counter()
    supply = rng.integers(1, 10**9, 1000).tolist()
    flow = reshard.stay_or_move(supply, reshard.even_capacities(sum(supply), 1300))
    assert sum(flow.values()) == sum(supply) and time.perf_counter() - began < 5


def test_entries_of_one_moment_are_in_order(spark):
    rows = [("l", "a.com", c, a, "2024-01-01", s) for c, a, s in (("x", "add", 1), ("y", "add", 1), ("z", "remove", 1))] + [("l", "b.com", "x", "add", "2024-01-01", None), ("l", "b.com", "x", "remove", "2024-01-01", 1)]
    names = "list_name string, pattern string, category string, action string, day string, seq int"
    for order in (rows, rows[::-1]):
        entries = spark.createDataFrame(order, names).withColumn("dated", F.col("day").cast("timestamp")).coalesce(1)
        assert [r.pattern for r in url_filter.intervals(entries).collect()] == []
        added = url_filter.intervals(entries.where("action = 'add'")).orderBy("pattern").collect()
        assert [(r.pattern, r.category) for r in added] == [("a.com", "y"), ("b.com", "x")]


# Jaccard join


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()


def brute_components(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and min(len(a), len(b)) * 100 >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(sets):
        r = find(k)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s), least.get(find(k))) for k, (d, s) in enumerate(sets)), key=str)


def test_jaccard_components_are_exact(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = sorted((tuple(r) for r in queries.op9_jaccard_join(spark, sf).collect()), key=str)
    docs = pq.read_table(f"{sf}/documents.parquet").to_pandas()
    assert got == brute_components(list(zip(docs.doc_id, docs.text, strict=True)))


def test_jaccard_of_near_copies(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = [[f"w{rng.integers(1e6)}" for _ in range(60)] for _ in range(6)]
    rows = []
    for k in range(240):
        words = list(base[k % 6])
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(len(words)))] = f"e{rng.integers(1e6)}"
        if rng.random() < 0.3:
            words = words[: int(rng.integers(40, 60))]
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    for tile, first in ((2048, 4), (8, 1)):
        monkeypatch.setattr(jaccard_join, "TILE", tile)
        monkeypatch.setattr(jaccard_join, "FIRST", first)
        grouped, _ = jaccard_join.linked_groups(df)
        assert sorted((tuple(r) for r in grouped.select("doc_id", "n_shingles", "component_id").collect()), key=str) == want
    kept = jaccard_join.one_of_each(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted({w[2] for w in want})


def test_jaccard_by_other_rules(spark):
    rng = np.random.default_rng(7)
    base = [[f"w{rng.integers(1e6)}" for _ in range(80)] for _ in range(8)]
    rows = []
    for k in range(160):
        words = list(base[k % 8])
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(len(words)))] = f"e{rng.integers(1e6)}"
        rows.append((k, " ".join(words[: int(rng.integers(66, 81))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = {}
    for rule in (jaccard_join.RULE, jaccard_join.Rule(5, 80, 100), jaccard_join.Rule(3, 1, 2)):
        sets = [{tuple(w[k : k + rule.width]) for k in range(len(w) - rule.width + 1)} for w in (t.split() for _, t in rows)]
        root = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if rule.under * len(sets[i] & sets[j]) >= rule.over * len(sets[i] | sets[j]) and root[i] != root[j]:
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
        got = {r.doc_id: r.component_id for r in jaccard_join.linked_groups(df, rule)[0].collect()}
        assert [got[k] for k in range(len(rows))] == root
        links[rule] = tuple(root)
    assert len(set(links.values())) == 3


def test_box_tree_loses_no_pair():
    rng = np.random.default_rng(4)
    points = rng.poisson(0.2, (400, jaccard_join.FINE)).astype(np.uint32)
    points[200:] = points[:200]
    points[200:, 0] += 1
    n, roots = points.sum(1).astype(np.int64), np.arange(400)
    x, y = jaccard_join.BoxTree(points, n, roots).pairs()
    got = {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist(), strict=True)}
    want = set()
    for i in range(400):
        for j in range(i):
            if min(n[i], n[j]) * 100 >= max(n[i], n[j]) * 85 and np.minimum(points[i], points[j]).sum() >= jaccard_join.least_overlap(n[i], n[j]):
                want.add((j, i))
    assert got == want and len(x) == len(got)


def test_packed_counts_are_upper_bounds():
    few, many = np.arange(1000, dtype=np.uint64), np.arange(300, dtype=np.uint64) * np.uint64(jaccard_join.FINE)
    got = jaccard_join.unpacked_counts([jaccard_join.packed_counts(few), jaccard_join.packed_counts(many)], np.array([1000, 300]))
    assert got[0].sum() == 1000 and got[1].tolist() == [300] + [0] * (jaccard_join.FINE - 1)


def test_jaccard_of_odd_rows(spark):
    df = tricky(spark)
    grouped, _ = jaccard_join.linked_groups(df)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in grouped.select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute_components(rows)
    assert jaccard_join.linked_groups(empty(spark))[0].count() == 0


def test_jaccard_keeps_the_largest_id(spark):
    rows = [(2**63 - 1, "a b c d e f"), (None, "a b c d e f"), (7, "g h i j k")]
    grouped, _ = jaccard_join.linked_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.component_id) for r in grouped.collect()), key=str)
    assert got == [(7, 7), (2**63 - 1, 2**63 - 1), (None, 2**63 - 1)]


def test_jaccard_by_shuffled_sides(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "sized", lambda small, rows=0: small)
    monkeypatch.setattr(jaccard_join, "HEAVY", 2)
    rows = [(k, " ".join(f"w{(k // 4) * 40 + j + (k % 4 == j)}" for j in range(30))) for k in range(24)] + [(100 + k, "same text in many rows") for k in range(40)]
    grouped, _ = jaccard_join.linked_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in grouped.select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute_components(rows)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 90), (90, 95)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == dict.fromkeys(range(31), 0) | {90: 90, 95: 90, 100: 90}


# nearest neighbours


def brute_nearest(ids, x, queries_, k=5):
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in np.flatnonzero(queries_):
        s = n @ n[q]
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[q]), key=lambda j: (-round(s[j], 12), ids[j]))[:k]
        yield ids[q], [ids[j] for j in order], s[order]


def test_nearest_recall(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    got = queries.op10_ann_postings(spark, sf).toPandas()
    table = pq.read_table(f"{sf}/embeddings.parquet").to_pandas()
    x = np.stack(table.embedding.to_numpy()).astype(float)
    hits = total = 0
    for q, want, scores in brute_nearest(table.vec_id.to_numpy(), x, table.vec_id.to_numpy() % 50 == 0):
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5]
        hits += len(set(mine.vec_id) & set(want))
        total += len(want)
    assert hits / total >= 0.95


def test_nearest_recall_on_many_random_vectors(spark, tmp_path):
    n = 100_000  # 521 lists
    x = np.random.default_rng(3).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(x)}), tmp_path / "x.parquet")
    got = ann_postings.nearest(spark.read.parquet(str(tmp_path / "x.parquet")), F.col("vec_id") % 1000 == 0).toPandas()
    hits = 0
    for q in range(0, n, 1000):
        scores = x @ x[q]
        scores[q] = -2
        hits += len(set(got[got.query_id == q].vec_id) & set(np.argsort(-scores)[:5]))
    assert len(got) == 500 and hits / 500 >= 0.9, hits


@pytest.mark.parametrize("noise", [0.3, 0.6])
def test_nearest_recall_on_clusters(spark, tmp_path, noise):
    rng, n = np.random.default_rng(5), 30_000  # 157 lists
    x = (rng.normal(size=(90, 64))[rng.integers(0, 90, n)] + noise * rng.normal(size=(n, 64))).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(x)}), tmp_path / "x.parquet")
    got = ann_postings.nearest(spark.read.parquet(str(tmp_path / "x.parquet")), F.col("vec_id") % 300 == 0).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, n, 300):
        scores = unit @ unit[q]
        scores[q] = -2
        hits += len(set(got[got.query_id == q].vec_id) & set(np.argsort(-scores)[:5]))
    assert len(got) == 500 and hits / 500 >= 0.95, hits


def test_queries_left_short_read_all_lists(spark):
    spec = ann_postings.AnnSpec(list_points=2, probe_lists=1, probe_ratio=1.0, copies=1, sample=400)
    x = np.random.default_rng(1).normal(size=(200, 4))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann_postings.nearest(df, F.col("vec_id") % 50 == 0, spec).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {0: 5, 50: 5, 100: 5, 150: 5}


def test_nearest_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [0.0, 1.0]), (8, [0.0, 1.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = {q: [] for q in (0, 50)}
    for r in ann_postings.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    assert got == {0: [(3, 1.0), (50, 1.0), (8, 0.0)], 50: [(0, 1.0), (3, 1.0), (8, 0.0)]}
    assert ann_postings.nearest(df.limit(0), F.lit(True)).count() == 0
    assert ann_postings.nearest(df.where("vec_id in (4, 5)"), F.lit(True)).count() == 0


def test_nearest_of_tiny_and_huge_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8)) * np.array([1e-200, 1.0, 1e200])[np.arange(60) % 3][:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann_postings.nearest(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    unit = x / np.abs(x).max(1, keepdims=True)
    want = {q: [(i, round(float(s), 9)) for i, s in zip(near, scores, strict=True)] for q, near, scores in brute_nearest(np.arange(60), unit, np.arange(60) % 10 == 0)}
    assert got == want


def test_nearest_beside_longer_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0, 1.0]), (4, [1.0, None, 1.0, 1.0]), *((k, [0.0] * 5) for k in range(5, 9)), *((k, [float("nan")] * 6) for k in range(9, 13))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann_postings.nearest(df, F.col("vec_id").isin(0, 3)).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 2)]


# secrets, URLs, token counts


def test_secrets_found(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = queries.op1_secret_scan(spark, sf).where("is_secret").collect()
    docs = pq.read_table(f"{sf}/documents.parquet").to_pandas()
    want = {(d, m.start(1)) for d, t in zip(docs.doc_id, docs.text, strict=True) for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "")}
    assert {(r.doc_id, r.start) for r in got} == want and want


ASSIGNMENTS = [
    ("password = correcthorsebatterystaple and more", "correcthorsebatterystaple"),
    ('pwd: "hunter2!Summer#24$x", user', "hunter2!Summer#24$x"),
    ("token=" + "0123456789abcdef" * 2 + "deadbeef/v=1 end", "0123456789abcdef" * 2 + "deadbeef/v"),
    ("key = Tr0ub4dor&3-xyz%Q! done", "Tr0ub4dor&3-xyz%Q!"),
    ("secret='two words here'", "two words here"),
]


@pytest.mark.parametrize("text, value", ASSIGNMENTS)
def test_assigned_values_are_candidates(text, value):
    assert value in {text[a:b] for a, b in secret_scan.candidates(text)}


def test_forest_by_hand(spark):
    """Scores are the mean of the leaves that a row falls to, one node after the other."""
    forest = secret_scan.train(secret_scan.sample_findings(spark, 600))
    texts = [t for t, _ in ASSIGNMENTS] + ['x = "' + "ab12" * 9 + '"', "Note: nothing of interest here", "see https://a.example.com/page"]
    scanned = secret_scan.scan_texts(texts, [None] * len(texts), forest, 0.5)
    assert sum(map(len, scanned)) > 6
    for text, spans in zip(texts, scanned, strict=True):
        assert [(a, b) for a, b, _ in spans] == list(secret_scan.candidates(text))
        for a, b, score in spans:
            row = secret_scan.features(text[a:b], text[max(0, a - secret_scan.BESIDE) : a], text[b : b + secret_scan.BESIDE], "")
            leaves = []
            for feature, cut, below, share in zip(forest.feature, forest.cut, forest.below, forest.share, strict=True):
                at = 0
                while below[at][0] != at:
                    at = below[at][1 if row[feature[at]] > cut[at] else 0]
                leaves.append(share[at])
            assert abs(sum(leaves) / len(leaves) - score) < 1e-9


def test_findings_of_odd_rows(spark):
    forest = secret_scan.train(secret_scan.sample_findings(spark, 600))
    key = 'token = "' + "1f" * 20 + '"'
    rows = [(1, None), (2, ""), (3, key), (3, key), (None, key), (4, "x" * 200_000 + " " + key), (5, "\u6f22\u5b57 \U0001f600 " + key)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("start", "length", "score", "is_secret", "path"):
        df = df.withColumn(name, F.lit("x"))
    got = [r for r in secret_scan.findings(df, forest).collect() if r.is_secret and r.length == 40]
    assert sorted((r.doc_id or 0, r.start) for r in got) == [(0, 9), (3, 9), (3, 9), (4, 200_010), (5, 14)]
    assert len({r.secret_sha256 for r in got}) == 1


def test_secrets_masked(spark):
    forest = secret_scan.train(secret_scan.sample_findings(spark))
    key = "9f14a7029c8514dfe98aba92898d323168e199da"
    rows = [(1, f'set api_key = "{key}" now'), (2, f"see commit {key} for this"), (3, None), (4, ""), (5, "plain words here")]
    got = {r.doc_id: r.text for r in secret_scan.masked(spark.createDataFrame(rows, "doc_id long, text string"), forest).collect()}
    assert got == dict(rows) | {1: 'set api_key = "[SECRET]" now'}
    assert secret_scan.masked(tricky(spark), forest).columns == tricky(spark).columns
    assert secret_scan.findings(empty(spark), forest).count() == 0


def test_url_filter_equals_sql(spark, sf):
    got = queries.op3_url_filter(spark, sf).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.sql(queries.ORACLE_SQL["op3_url_filter"]).df()
    key = list(want.columns)
    assert sorted(map(str, got[key].itertuples(index=False))) == sorted(map(str, want.itertuples(index=False)))


def test_url_filter_in_time(spark):
    captures = spark.createDataFrame(
        [(1, "http://a.bad.com/x", "2024-01-01"), (2, "http://a.bad.com/x", "2024-02-01"), (3, "https://u:p@BAD.com:80/?q", "2024-03-01"), (4, None, "2024-02-01"), (5, "nonsense", "2024-02-01"), (6, "http://ok.bad.com/p/q/r", "2024-02-15"), (7, "http://bad.com", None)],
        "page_id long, url string, day string",
    ).selectExpr("page_id", "url", "cast(day as timestamp) as fetched_at", "1 as host", "2 as pattern")
    entries = spark.createDataFrame(
        [("l", "*.Bad.com", "spam", "add", "2024-01-15", 1), ("l", "bad.com", "spam", "remove", "2024-02-20", 1), ("l", "ok.bad.com/p", "allow", "add", "2024-02-10", 1), ("l", None, "spam", "add", "2024-01-01", 1)],
        "list_name string, pattern string, category string, action string, day string, seq int",
    ).selectExpr("list_name", "pattern", "category", "action", "cast(day as timestamp) as dated", "seq")
    got = {r.page_id: (r.blocked, r.n_active) for r in url_filter.judge(captures, entries).collect()}
    assert got == {1: (False, 0), 2: (True, 1), 3: (False, 0), 4: (False, 0), 5: (False, 0), 6: (False, 2), 7: (False, 0)}
    assert url_filter.judge(captures, entries.limit(0)).where("blocked").count() == 0
    assert url_filter.judge(captures.limit(0), entries).count() == 0


def test_token_counts_are_exact(spark, sf, docs):
    report = queries.op5_token_counts(spark, sf)
    enc = encoder(vocabulary())
    sizes = np.array([len(enc.ids(t)) for t in docs.text])
    rows = report.collect()
    assert sorted(r.context_limit for r in rows) == sorted(set(sizes.tolist()))
    for r in rows:
        assert r.documents == (sizes == r.context_limit).sum()
        assert r.documents_longer == (sizes > r.context_limit).sum()
        assert r.tokens_longer == sizes[sizes > r.context_limit].sum()
        assert r.tokens_kept == np.minimum(sizes, r.context_limit).sum()
        assert r.tokens_total == sizes.sum()
    limits = [0, 1, 100, 2048, 10**6]
    kept = {r.context_limit: r.tokens_kept for r in token_counts.kept_at(report, limits).collect()}
    assert kept == {x: int(np.minimum(sizes, x).sum()) for x in limits}
    q = token_counts.quantiles(report, [0.5, 0.9, 1.0]).first()
    ordered = np.sort(sizes)
    assert q.q0500 == ordered[int(np.ceil(0.5 * len(sizes))) - 1] and q.q1000 == ordered[-1]
    assert token_counts.limit_report(token_counts.length_histogram(empty(spark))).count() == 0
    assert token_counts.length_histogram(tricky(spark)).where("n_tokens = 0").first().documents == 3
