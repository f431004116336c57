"""Layout inside the rows of pages, against the same rules as windows over rows of lines and words."""

from pyspark.sql import functions as F

from glyphweave.operators import blocks, lines, search
from glyphweave.plans import catalog
from glyphweave.plans.bridge import typeset, words_of

WORDS = "doc_id long, page int, word_ord int, text string, x double, y double, w double, h double, baseline double, font_size double"


def odd_words(spark):
    """Crossing baselines, columns, a far line, sizes and a page whose words come in the wrong order."""
    rows, k = [], 0
    for page, base, size, x in [(0, b, s, x) for b in (700.0, 699.2, 688.0, 687.1, 600.0, 588.5, 577.0) for s in (4.0, 10.0) for x in (72.0, 90.5, 300.0)] + [(1, 500.0 - 12 * n, 10.0, 72.0 + 60 * m) for n in range(4) for m in range(5)] + [(2, 400.0, 10.0, 72.0)]:
        rows.append((page % 2 + 5, page, k, f"w{k}é", x + k % 3, base - 0.22 * size, 30.0 + 25.0 * page, size, base, size))
        k += 1
    return spark.createDataFrame(rows[::-1], WORDS)


def told(df, *names):
    return sorted(map(str, df.select(*names).collect()))


def test_lines_blocks_and_units_of_page_rows_follow_the_windows(spark):
    found = odd_words(spark)
    rows = blocks.with_kinds(blocks.detect_blocks(lines.detect_lines(lines.place_words(found))))
    laid = lines.page_lines(lines.gathered(found))
    assert told(laid, *rows.columns) == told(rows, *rows.columns)
    units = search.search_units(rows)
    assert {r.kind for r in units.select("kind").collect()} == {"lines", "paragraph", "table"}
    assert told(lines.page_units(lines.gathered(found)), *sorted(units.columns)) == told(units.select("*"), *sorted(units.columns))


def test_places_follow_the_fold(spark):
    found, names = odd_words(spark), ("doc_id", "page", "word_ord", "line_ord", "line_baseline", "pos")
    assert told(lines.place_words(found), *names) == told(lines.fold_lines(found), *names)


def test_pages_without_words_have_no_lines(spark):
    empty = spark.createDataFrame([(1, 0, 0, "  "), (1, 0, 1, ""), (2, 0, 0, " a  b ")], "doc_id long, page int, line_no int, line string")
    pages = typeset(empty)
    assert [(r.doc_id, r.text, r.x) for r in words_of(pages).collect()] == [(2, "a", 78.0), (2, "b", 96.0)]
    assert [r.text for r in lines.page_lines(pages).collect()] == ["a b"] and [r.text for r in lines.page_units(pages).collect()] == ["a b"]
    nothing = pages.where("doc_id = 1")
    assert not lines.page_lines(nothing).collect() and not lines.page_units(nothing).collect() and not lines.place_pages(nothing).collect()


def test_words_are_sorted_and_shuffled_nowhere_for_a_search(spark, sf):
    plan = catalog.search_whole_word(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Sort [" not in plan and "Window [" not in plan


def test_anchors_of_page_rows_follow_the_feed(spark):
    found = odd_words(spark)
    feed = search.reading_feed(lines.place_words(found)).select("doc_id", "page", "word_ord", "feed_pos")
    for word_ord in (0, 3, 44, 45):
        near = search.page_anchors(lines.gathered(found), F.lit(word_ord))
        assert near.count() == 3
        assert told(near.where("feed_pos is not null"), "doc_id", "page", "feed_pos") == told(feed.where(F.col("word_ord") == word_ord), "doc_id", "page", "feed_pos")


def test_anchors_shuffle_pages_not_words(spark, sf):
    plan = catalog.anchor_positions(spark, sf)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange " in line]
    assert len(moved) == 2 and "Join" not in plan and "Generate inline" not in plan and "Generate explode" not in plan
