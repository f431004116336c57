"""Streams give the rows that tables give, in any order of arrival and after a restart."""

import random

from pyspark.sql import functions as F

from glyphweave.operators import search
from glyphweave.operators.lines import place_words
from glyphweave.plans.bridge import bridge_words, table
from glyphweave.streaming import feeds


def drop_files(df, folder, parts):
    """Write `df` as files that a stream reads one by one."""
    df.repartition(parts).write.mode("append").parquet(folder)


def test_feed_goes_on_page_by_page(spark, tmp_path):
    rng = random.Random(1)
    texts = [(k, "\n".join(" ".join(rng.choice(["a", "bb,", "", "ccc.", "éé"]) for _ in range(rng.randint(0, 3))) for _ in range(rng.choice([0, 1, 60, 200])))) for k in range(10)]
    docs = spark.createDataFrame([*texts, (90, None)], "doc_id long, text string")
    folder, pages, out = (str(tmp_path / n) for n in ("in", "pages", "out"))
    docs.repartition(2).write.parquet(folder)
    feeds.append_pages(spark, folder, pages, str(tmp_path / "c1")).awaitTermination()
    laid = spark.read.schema(feeds.PAGES).option("recursiveFileLookup", True).parquet(pages)
    rows = laid.collect()
    rng.shuffle(rows)
    assert max(r.page for r in rows) > 2
    shuffled, third = str(tmp_path / "shuffled"), len(rows) // 3
    for part in (rows[:third], rows[third:] + rows[:9]):  # some pages come twice
        drop_files(spark.createDataFrame(part, feeds.PAGES), shuffled, 2)
        stream = feeds.feed_stream(feeds.page_stream(spark, shuffled, 1))
        feeds.append_changes(stream, out, str(tmp_path / "c2")).awaitTermination()  # from its checkpoint, the second time
        got = spark.read.schema(feeds.FEED).option("recursiveFileLookup", True).parquet(out)
    want = search.reading_feed(place_words(bridge_words(docs)))
    shown = lambda df: sorted((r.doc_id, r.feed_pos, r.page, r.word_ord, r.text, r.pivot, round(r.shown_at, 3), round(r.shown_for, 3)) for r in df.collect())
    assert shown(got) == shown(want)


def test_counts_follow_revisions(spark, tmp_path):
    rng = random.Random(2)
    rows = [(doc, page, rev, rng.choice([None, "", " ", "a b  c\n", "one", "w " * rng.randint(1, 40)])) for doc in range(6) for page in range(4) for rev in rng.sample(range(20), 5)]
    rng.shuffle(rows)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:50], rows[50:] + rows[:10]):
        drop_files(spark.createDataFrame(part, feeds.REVISIONS), folder, 2)
        changes = feeds.count_changes(feeds.revision_stream(spark, folder, 1))
        feeds.append_changes(changes, out, str(tmp_path / "c")).awaitTermination()
    log = spark.read.schema(feeds.CHANGES).option("recursiveFileLookup", True).parquet(out)
    newest = {}
    for doc, page, rev, text in rows:
        if (doc, page) not in newest or rev > newest[doc, page][0]:
            newest[doc, page] = rev, len((text or "").split())
    got = {r.doc_id: (r.n_pages, r.n_words) for r in feeds.counted_words(log).collect()}
    assert got == {d: (sum(n > 0 for (doc, _), (_, n) in newest.items() if doc == d), sum(n for (doc, _), (_, n) in newest.items() if doc == d)) for d in range(6)}
    latest = log.groupBy("doc_id", "page").agg(F.max_by("n_words", "revision").alias("n_words"), F.sum("change").alias("total"))
    assert latest.where("n_words <> total").count() == 0


def test_page_counts_of_tables(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    assert feeds.page_word_counts(docs).agg(F.sum("n_words")).first()[0] == place_words(bridge_words(docs)).count()
