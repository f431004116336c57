"""Results kept up to date after edits."""

from pyspark.sql import functions as F

from glyphweave.operators import search, upkeep
from glyphweave.plans import catalog
from glyphweave.plans.bridge import layout, words_of_pages

PAGES = "doc_id int, page int, text string"


def rows(df):
    return sorted(map(str, df.collect()))


def test_only_pages_with_new_contents_are_laid_out(spark):
    before = spark.createDataFrame([(1, 0, "a b\nc"), (1, 1, "d"), (1, 2, None), (1, 3, "gone"), (2, 0, "a b\nc"), (3, 0, "dropped")], PAGES)
    after = spark.createDataFrame([(1, 0, "d"), (1, 1, "a b\nc"), (1, 2, "a b\nc"), (1, 3, "d e"), (2, 0, "d"), (4, 0, "a b\nc"), (4, 1, None), (4, 2, "")], PAGES)
    given = []

    def make(pages):
        given.append(pages)
        return layout(words_of_pages(pages))[1].select("doc_id", "page", "line_ord", "text", "x", "y")

    view = make(before)
    done = upkeep.refreshed(view, upkeep.page_digests(before, ["text"]), after, ["text"], make)
    assert rows(done.drop("made_again")) == rows(make(after))
    assert sorted((r.doc_id, r.page) for r in given[1].collect()) == [(1, 3), (2, 0), (4, 0), (4, 1), (4, 2)]
    assert {(r.doc_id, r.page) for r in done.where("made_again").collect()} == {(1, 3), (2, 0), (4, 0)}


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], PAGES), spark.createDataFrame([(1, 0, "a")], PAGES)
    make = lambda pages: pages.select("doc_id", "page", F.length("text").alias("n"))
    for before, after in ((none, some), (some, none), (none, none)):
        assert upkeep.refreshed(make(before), upkeep.page_digests(before, ["text"]), after, ["text"], make).count() == after.count()


def test_current_hit_is_clamped(spark):
    df = spark.createDataFrame([(5, 3), (1, 3), (0, 0), (None, 3), (2, 3)], "current int, hits int")
    assert [r[0] for r in df.select(search.refreshed_hit(F.col("current"), F.col("hits"))).collect()] == [2, 1, None, None, 2]


def test_kept_rows_are_dealt_by_the_texts(spark, sf, monkeypatch):
    monkeypatch.setattr(catalog, "tasks_for", lambda texts, chars=0: 23)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = catalog.relayout_lines(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(doc_id" in line and ", page#" in line]
    assert len(moved) >= 5 and all(", 23), " in line for line in moved)
