"""The analysis of curves and nested geometry against closed forms."""

import math
from collections import defaultdict

import numpy as np
import pytest

from curvespark.operators import analysis, geometry

CURVE = "sid long, k long, p0 double, p1 double, p2 double"


def test_a_wave_has_its_period(spark):
    """A sine of period 60: its curvature has period 30; a short curve is left out."""
    wave = [(1, k, float(k), 6 * math.sin(2 * math.pi * k / 60), 0.0) for k in range(600)]
    line = [(2, k, float(k), 0.0, 0.0) for k in range(200)]
    short = [(3, k, float(k), 0.0, 0.0) for k in range(10)]
    found = analysis.analyse(spark.createDataFrame(wave + line + short, CURVE), window=20.0)
    periods = defaultdict(list)
    for r in found["periods"].orderBy("place").collect():
        periods[r.sid].append(r)
    assert 3 not in periods and len(periods[1]) == 5
    step = periods[1][0].length / periods[1][0].lag
    around = found["samples"].where("sid = 1").count() * step / 600  # a period is longer along the wave than across
    assert all(abs(r.length / around - 30 * round(r.length / around / 30)) < 2 * step and r.height > 0.3 for r in periods[1])
    assert {r.sid for r in found["samples"].select("sid").distinct().collect()} == {1, 2} and {r.sid for r in found["writhe_lags"].select("sid").distinct().collect()} == {1, 2}
    straight = found["lags"].where("sid = 2").collect()
    assert all(abs(r.r) <= 1 + 1e-9 for r in straight)


def test_correlations_of_all_lags(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=37)
    rows = [(0, k, float(v)) for k, v in enumerate(x)] + [(1, k, 2.0) for k in range(9)] + [(2, 0, None), (2, 1, 1.0), (2, 2, 3.0)]
    got = defaultdict(dict)
    for r in analysis.correlations(spark.createDataFrame(rows, "sid int, k long, kappa double")).collect():
        got[r.sid][r.lag] = r.r
    y = x - x.mean()
    assert np.allclose([got[0][j] for j in range(37)], [(y[: 37 - j] * y[j:]).sum() / (y * y).sum() for j in range(37)])
    assert set(got[1].values()) == {0.0} and got[2] == {0: 1.0, 1: -0.5}


def test_fibres_twist_about_plies_which_twist_about_the_curve(spark):
    """About a straight line plies are helices; each fibre keeps its distance from its own ply, across it."""
    line = spark.createDataFrame([(1, k, 0.5 * k, 0.0, 0.0) for k in range(120)], CURVE)
    strands, found = geometry.hierarchy(line, 2, 40.0, 3.0, 4, 10.0, 0.5)
    plies = {(r.ply, r.k): np.array([r.p0, r.p1, r.p2]) for r in strands.collect()}
    assert len(plies) == 240
    for (ply, k), p in plies.items():
        assert p[0] == pytest.approx(0.5 * k) and math.hypot(p[1], p[2]) == pytest.approx(3.0)
        assert np.allclose(p[1:], -plies[1 - ply, k][1:])
    turn = math.atan2(*plies[0, 20][:0:-1]) - math.atan2(*plies[0, 0][:0:-1])
    assert abs((abs(turn) - 2 * math.pi * 10 / 40 + math.pi) % (2 * math.pi) - math.pi) < 1e-6
    rows = found.collect()
    assert len(rows) == 2 * 4 * 120
    for r in rows:
        away = np.array([r.p0, r.p1, r.p2]) - plies[r.ply, r.k]
        assert np.linalg.norm(away) == pytest.approx(0.5 * math.sqrt((r.fibre + 0.5) / 4), abs=1e-9)
        if 0 < r.k < 119:
            along = plies[r.ply, r.k + 1] - plies[r.ply, r.k - 1]
            assert abs(away @ along) < 1e-6
    shaken, _ = geometry.hierarchy(line, 2, 40.0, 3.0, 2, 10.0, 0.5, shake=0.2, grain=0.1)
    moved = [np.linalg.norm(np.array([r.p0, r.p1, r.p2]) - plies[r.ply, r.k]) for r in shaken.collect()]
    assert len(moved) == 240 and 0 < max(moved) < 0.8


def test_upsampling_reproduces_cubics(spark):
    cubic = lambda t: (0.01 * t**3 - t, t**2 - 3.0, 2.0 - t)
    rows = [(1, k, *cubic(k)) for k in range(9)] + [(2, k, *(float(x) for x in cubic(k)[1:]), 0.0) for k in range(3)] + [(3, 0, 0.0, 0.0, 0.0), (3, 1, 1.0, 2.0, 3.0), (4, 0, 5.0, 5.0, 5.0)]
    got = defaultdict(dict)
    for r in geometry.upsampled(spark.createDataFrame(rows, CURVE), 4).collect():
        got[r.sid][r.k] = (r.p0, r.p1, r.p2)
    assert all(np.allclose(got[1][k], cubic(k / 4)) for k in range(33)) and len(got[1]) == 33
    assert all(np.allclose(got[2][k], (*cubic(k / 4)[1:], 0.0)) for k in range(9))
    assert all(np.allclose(got[3][k], np.array([1, 2, 3]) * k / 4) for k in range(5)) and got[4] == {0: (5.0, 5.0, 5.0)}
