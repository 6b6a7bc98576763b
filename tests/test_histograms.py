import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grovekit.operators.histograms import FeatureHistogram, Interval, TargetHistogram, summarize


def fill(limit, values):
    h = FeatureHistogram.empty(limit)
    for v in values:
        h.insert(v)
    return h


def test_feature_histogram_inserts_and_merges():
    h = fill(5, [23, 19, 10, 16, 36])
    assert h.points == [(10, 1), (16, 1), (19, 1), (23, 1), (36, 1)]
    h.insert(2)
    assert h.points == [(2, 1), (10, 1), (17.5, 2), (23, 1), (36, 1)]
    h.insert(9)
    assert h.points == [(2, 1), (9.5, 2), (17.5, 2), (23, 1), (36, 1)]
    h.merge(fill(5, [32, 30, 45]))
    expected = [(2, 1), (9.5, 2), (19 + 1 / 3, 3), (32 + 2 / 3, 3), (45, 1)]
    for got, want in zip(h.points, expected, strict=True):
        assert got == pytest.approx(want, abs=1e-5)
    assert h.sum(15) == pytest.approx(3.275, abs=1e-3)


def test_feature_histogram_sum_is_bounded_and_weighted():
    h = fill(4, [1.0])
    assert (h.sum(0.5), h.sum(1), h.sum(9)) == (0, 1, 1)
    h.insert(5.0, 3)
    assert h.count() == 4 and h.sum(100) == 4
    h.insert(math.nan)
    assert h.count() == 4
    with pytest.raises(ValueError):
        FeatureHistogram.empty(0)


def test_candidate_splits():
    assert FeatureHistogram.empty(3).candidate_splits() == []
    assert fill(3, [7]).candidate_splits() == [7]
    points = fill(8, range(8)).uniform(4)
    assert len(points) == 3 and points == sorted(points) and 0 <= points[0] and points[-1] <= 7


def test_target_histogram_inserts_and_merges():
    h = TargetHistogram(3)
    for y in (1, 1, 2, 3.5, 2.1, 3.6):
        h.insert(y)
    assert h.bins == [Interval(1, 1, 2, 2.0), Interval(2, 2.1, 2, pytest.approx(4.1)), Interval(3.5, 3.6, 2, pytest.approx(7.1))]
    a, b = TargetHistogram(3, parity=True), TargetHistogram(3, parity=True)
    for y in (1, 1.5, 3, 4, 4.5, 6):
        a.insert(y)
    for y in (1, 7, 5):
        b.insert(y)
    a.merge(b)
    assert [(x.left, x.right, x.count, x.sum) for x in a.bins] == [(1, 3, 4, 6.5), (4, 5, 3, 13.5), (6, 7, 2, 13.0)]


def test_median_and_partial_sum():
    h = TargetHistogram(10)
    assert h.median() is None
    for y, want in ((1, 1), (2, 2), (3, 2), (4, 3)):
        h.insert(y)
        assert h.median() == want
    assert Interval(1, 3, 3, 6.0).partial_sum(0) == 0 and Interval(1, 3, 3, 6.0).partial_sum(3) == 6
    assert Interval(1, 3, 3, 6.0).partial_sum(2) == pytest.approx(3.0)
    assert Interval(1, 3, 2, 4.0).partial_sum(1) == 1
    assert [Interval(1, 3, 2, 4.0).compare(v) for v in (0, 1, 3, 4)] == [1, 0, 0, -1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3), max_size=60), st.lists(st.floats(-1e3, 1e3), max_size=60))
def test_mass_is_kept(a, b):
    assert summarize([]) is None
    x = summarize([fill(7, a), fill(7, b)])
    assert x.count() == pytest.approx(len(a) + len(b)) and len(x.points) <= 7
    s, t = TargetHistogram(7), TargetHistogram(7)
    for v in a:
        s.insert(v)
    for v in b:
        t.insert(v)
    y = summarize([s, t])
    assert y.count() == len(a) + len(b) and sum(v.sum for v in y.bins) == pytest.approx(sum(a) + sum(b), abs=1e-6)
