"""Ink masks to strokes."""

import numpy as np
import pytest

from glyphweave.operators import ink, vector


def rows(spark, *masks):
    data = [(k, m.shape[1], m.shape[0], bytearray(m.astype(np.uint8).tobytes())) for k, m in enumerate(masks)]
    return spark.createDataFrame(data, "img_id long, width int, height int, mask binary")


def bar():
    m = np.zeros((40, 80), bool)
    m[18:23, 10:70] = True
    return m


def test_bar_is_one_stroke():
    found, width = ink.strokes_of(bar())
    assert len(found) == 1 and 3 < width < 7


def test_dot_stays_a_dot():
    m = np.zeros((30, 60), bool)
    m[14:17, 5:40] = True
    m[5, 50] = True
    found, _ = ink.strokes_of(m)
    assert len(found) == 2 and sorted(map(len, found))[0] == 2


def test_no_ink():
    assert ink.strokes_of(np.zeros((10, 10), bool)) == ([], 0.0)


def test_spur_is_pruned():
    m = np.zeros((20, 60), bool)
    m[10, 5:55] = True
    m[7:10, 30] = True
    pixels = ink.Skeleton(m)
    pixels.prune(4)
    assert len(list(pixels.chains())) <= 2 and not any(y < 9 for _, y in pixels.live)


def test_thinning_keeps_one_pixel_lines():
    m = np.zeros((12, 12), bool)
    m[5, 2:10] = True
    assert (ink.thin(m) == m).all()


@pytest.mark.parametrize("epsilon, kept", [(0.5, [True, True, True, False, True]), (1.0, [True, False, True, False, True]), (5.0, [True, False, False, False, True])])
def test_reduction(epsilon, kept):
    xy = np.array([[0, 0], [1, 0], [2, 2], [3, 1], [4, 0]], float)
    assert ink.reduce_points(xy, epsilon).tolist() == kept


def test_trace_and_budget(spark):
    t = np.linspace(0, 10 * np.pi, 6000)
    spiral = np.zeros((200, 200), bool)
    spiral[(100 + 3 * t * np.sin(t)).astype(int), (100 + 3 * t * np.cos(t)).astype(int)] = True
    points = ink.trace(rows(spark, bar(), spiral, np.zeros((10, 10), bool)))
    assert {r.img_id for r in points.select("img_id").distinct().collect()} == {0, 1}
    got = {r.img_id: r for r in ink.svg_within(points, budget=700).collect()}
    assert set(got) == {0, 1} and all(r.n_bytes <= 700 for r in got.values())
    assert got[0].paths.startswith("M")
    whole = {r.img_id: r.paths for r in ink.svg_within(points, smooth=0.5, epsilon=0.0, budget=10**9).collect()}
    drawn = vector.svg_paths(vector.smooth(ink.decimate(points, 0.0), 0.5)).where("img_id = 0").first()
    assert whole[0] == drawn.d
    assert vector.path_length(ink.decimate(points, 0.6)).count() >= 2
