"""Replaced images and what stays reachable."""

import pytest

from glyphweave.operators import objects

REFS = "doc_id int, source string, slot string, target string"
NAMES = "doc_id int, object string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_replaced_image_keeps_its_mask_and_other_holders_keep_the_old_one(spark):
    refs = spark.createDataFrame([(1, "p0", "Im0", "a"), (1, "p1", "Im0", "a"), (1, "p1", "Fm0", "f"), (1, "f", "Im0", "a"), (1, "a", "SMask", "m"), (2, "p0", "Im0", "a"), (1, "p0", "Im1", None)], REFS)
    pages = spark.createDataFrame([(1, "p0"), (1, "p1"), (1, "p1"), (2, "p0")], NAMES)
    replaced = spark.createDataFrame([(1, "a", "n")], "doc_id int, old_ref string, new_ref string")
    after = objects.replace_images(refs, pages, replaced)
    want = [(1, "p0", "Im0", "n"), (1, "p1", "Im0", "n"), (1, "p1", "Fm0", "f"), (1, "f", "Im0", "a"), (1, "a", "SMask", "m"), (1, "n", "SMask", "m"), (2, "p0", "Im0", "a"), (1, "p0", "Im1", None)]
    assert sorted(map(str, rows_any(after))) == sorted(map(str, want))
    sizes = spark.createDataFrame([(1, "a", 10), (1, "n", 4), (1, "m", 3), (1, "lost", 7), (2, "a", None)], NAMES + ", n_bytes int")
    assert rows(objects.kept_and_freed(sizes, after, pages)) == [(1, 3, 17, 7), (2, 1, 0, 0)]
    without_form = after.where("source <> 'f'")
    assert rows(objects.kept_and_freed(sizes, without_form, pages)) == [(1, 2, 7, 17), (2, 1, 0, 0)]


def rows_any(df):
    return [tuple(r) for r in df.collect()]


def test_cycles_swaps_and_long_chains_end(spark):
    chain = [(1, f"o{k}", "Next", f"o{k + 1}") for k in range(6)] + [(1, "o6", "Next", "o2"), (1, "x", "Next", "o1")]
    met = objects.reached(spark.createDataFrame(chain, REFS), spark.createDataFrame([(1, "o0")], NAMES))
    assert rows(met) == [(1, f"o{k}", k) for k in range(7)]
    refs = spark.createDataFrame([(1, "p", "A", "a"), (1, "p", "B", "b")], REFS)
    swap = spark.createDataFrame([(1, "a", "b"), (1, "b", "a")], "doc_id int, old_ref string, new_ref string")
    assert rows(objects.replace_images(refs, spark.createDataFrame([(1, "p")], NAMES), swap)) == [(1, "p", "A", "b"), (1, "p", "B", "a")]


@pytest.mark.parametrize("pages", [[], [(1, "p")]])
def test_no_references(spark, pages):
    refs, pages = spark.createDataFrame([], REFS), spark.createDataFrame(pages, NAMES)
    assert objects.reached(refs, pages).count() == pages.count()


@pytest.mark.parametrize("most", [0, 7, 500_000])
def test_documents_of_any_size_are_followed_alike(spark, most):
    """By joins, in their tasks, or some in each way; null names hold nothing."""
    chain = [(1, f"o{k}", "Next", f"o{k + 1}") for k in range(6)] + [(1, "o6", "Next", "o2"), (2, "o0", "Next", "o5"), (2, "lost", "Next", "o0"), (3, None, "Next", "a"), (None, "p", "Next", "a"), (3, "p", "Next", None)]
    pages = [(1, "o0"), (2, "o0"), (2, "o0"), (3, "p"), (3, None), (None, "p")]
    sizes = [(d, o, 10) for d in (1, 2) for o in ("o0", "o5", "lost")] + [(2, "o5", None), (3, "a", 1), (3, None, 2), (None, "p", 4), (4, "p", 8)]
    refs, pages, sizes = spark.createDataFrame(chain, REFS), spark.createDataFrame(pages, NAMES), spark.createDataFrame(sizes, NAMES + ", n_bytes int")
    met = {tuple(r) for r in objects.reached(refs, pages, most).collect()}
    assert met == {(1, f"o{k}", k) for k in range(7)} | {(2, "o0", 0), (2, "o5", 1), (3, "p", 0), (3, None, 0), (None, "p", 0)}
    kept = {tuple(r) for r in objects.kept_and_freed(sizes, refs, pages, most).collect()}
    assert kept == {(1, 2, 20, 10), (2, 3, 20, 10), (3, 0, 0, 3), (None, 0, 0, 4), (4, 0, 0, 8)}


def test_small_documents_need_no_checkpoints(spark, monkeypatch):
    monkeypatch.setattr(objects, "_checkpoints", lambda spark: pytest.fail("followed by joins"))
    refs = spark.createDataFrame([(d, "p", "Im0", "a") for d in range(50)], REFS)
    pages = spark.createDataFrame([(d, "p") for d in range(50)], NAMES)
    assert objects.reached(refs, pages).count() == 100
