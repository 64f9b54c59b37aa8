"""Properties that hold for any input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from crownlake.operators import raster, surfaces
from crownlake.sources import codecs

SMALL = hnp.arrays(np.uint16, hnp.array_shapes(min_dims=2, max_dims=2, min_side=1, max_side=12))


@given(SMALL)
def test_png(a):
    assert (codecs.png_decode(codecs.png_encode(a)) == a).all()


@given(SMALL)
def test_npy(a):
    assert (codecs.npy_decode(codecs.npy_encode(a)) == a).all()


@given(st.integers(1, 5000), st.integers(64, 1024), st.integers(0, 63))
def test_cores_cover_the_axis(size, tile, overlap):
    cores = raster.window_cores(size, tile, overlap)
    assert cores[0][1] == 0 and cores[-1][2] == size
    assert all(b[1] <= a[2] for a, b in zip(cores, cores[1:], strict=False))


@given(st.integers(2, 300), st.integers(2, 300), st.integers(1, 6), st.floats(0, 0.5))
def test_tiles_cover_the_image(w, h, n, overlap):
    boxes = raster.tile_boxes(w, h, n, overlap)
    seen = np.zeros((h, w), bool)
    for x0, y0, x1, y1 in boxes:
        assert 0 <= x0 <= x1 <= w and 0 <= y0 <= y1 <= h
        seen[y0:y1, x0:x1] = True
    assert seen.all()


@given(hnp.arrays(np.float64, st.tuples(st.integers(2, 9), st.integers(2, 9)), elements=st.integers(0, 6).map(float)), st.floats(0, 3))
@settings(max_examples=60)
def test_watershed_labels_what_markers_reach(a, prominence):
    markers = surfaces.prominent_peaks(a, prominence)
    labels = surfaces.watershed(a, markers, a > 0)
    top = np.unravel_index(np.argmax(a), a.shape)
    assert markers[top] > 0 and set(np.unique(labels)) <= {0, *np.unique(markers)} and not labels[a <= 0].any()
    reached = surfaces.labelled(a > 0)
    for part in np.unique(reached[reached > 0]):
        own = reached == part
        assert (labels[own] > 0).all() == bool((markers[own] > 0).any())


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=3, max_size=30))
def test_hull_holds_its_points(points):
    h = surfaces.hull(np.array(points))
    if surfaces.area_of(h) > 0:
        nxt = np.roll(h, -1, axis=0)
        for p in points:
            assert ((nxt[:, 0] - h[:, 0]) * (p[1] - h[:, 1]) - (nxt[:, 1] - h[:, 1]) * (p[0] - h[:, 0]) >= -1e-9).all()


@given(st.integers(0, 6), st.integers(0, 6), st.integers(1, 8), st.integers(1, 8))
def test_filled_rectangles(x, y, w, h):
    runs = surfaces.polygon_runs([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], 12, 12)
    assert sum(e - s for _, s, e in runs) == (min(12, x + w) - x) * (min(12, y + h) - y)
