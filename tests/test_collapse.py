"""Combinations of ways to join curve ends against walking every combination by hand."""

import itertools
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from curvespark.operators import collapse

WAYS = "sample long, region int, way int, a long, a_end int, b long, b_end int"


def ways_of(rng, sample, sids, regions):
    """Each region takes four free ends, two a side, and joins them in two ways; ends are used once."""
    ends = [(s, e) for s in sids for e in (0, 1)]
    rng.shuffle(ends)
    rows = []
    for region in range(regions):
        a, b, c, d = (ends.pop() for _ in range(4))
        rows += [(sample, region, 0, *a, *c), (sample, region, 0, *b, *d), (sample, region, 1, *a, *d), (sample, region, 1, *b, *c)]
        if region == 1:
            rows.append((sample, region, 2, *a, *b))
    return rows


def walk(sids, joins):
    """{sid: (chain, place, flipped)} or None for curves of a loop."""
    link = {}
    for a, ae, b, be in joins:
        link[a, ae], link[b, be] = (b, be), (a, ae)
    out = dict.fromkeys(sids)
    for start in sorted((s, e) for s in sids for e in (0, 1)):
        if start in link or out[start[0]] is not None:
            continue
        at, place = start, 0
        while at is not None:
            out[at[0]] = (start, place, at[1] == 1)
            at, place = link.get((at[0], 1 - at[1])), place + 1
    return out


def test_chains_of_all_combinations(spark):
    rng = random.Random(3)
    curves, rows = [], []
    for sample, (n, regions) in enumerate([(4, 2), (9, 3), (6, 2), (8, 4)]):
        sids = [100 * sample + k for k in range(n)]
        curves += [(sample, s) for s in sids]
        rows += ways_of(rng, sample, sids, regions)
    ways = spark.createDataFrame(rows, WAYS)
    chosen = collapse.combinations(ways).cache()
    found = collapse.chains(spark.createDataFrame(curves, "sample long, sid long"), ways, chosen)
    got = {(r.sample, r.choice, r.sid): None if r.chain is None else ((r.chain.sid, r.chain.end), r.place, r.flipped) for r in found.collect()}
    by = defaultdict(dict)
    for r in chosen.collect():
        by[r.sample, r.choice][r.region] = r.way
    free, seen = {}, 0
    for sample in range(4):
        sids = [s for t, s in curves if t == sample]
        options = [sorted({r[2] for r in rows if r[0] == sample and r[1] == region}) for region in sorted({r[1] for r in rows if r[0] == sample})]
        for choice, combo in enumerate(itertools.product(*options)):
            assert by[sample, choice] == dict(enumerate(combo))
            want = walk(sids, [r[3:] for r in rows if r[0] == sample and r[2] == combo[r[1]]])
            assert all(got[sample, choice, s] == want[s] for s in sids)
            seen += len(sids)
            if None not in want.values():
                free[sample, choice] = len({x[0] for x in want.values()})
    assert seen == len(got) and {(r.sample, r.choice): r.strands for r in collapse.without_loops(found).collect()} == free and 0 < len(free) < len(by)


def test_samples_with_too_many_combinations_are_left_out(spark):
    rows = [(s, r, w, 0, 0, 1, 1) for s, n in ((1, 2), (2, 5)) for r in range(3) for w in range(n)]
    assert {r.sample for r in collapse.combinations(spark.createDataFrame(rows, WAYS), most=100).select("sample").distinct().collect()} == {1}
    assert collapse.combinations(spark.createDataFrame([], WAYS)).count() == 0


def test_the_least_knotted_strand_is_best(spark):
    """A trefoil cut in four: one way of a region joins the pieces in order, the other closes a loop or leaves another knot."""
    point = lambda t: (math.sin(t) + 2 * math.sin(2 * t), math.cos(t) - 2 * math.cos(2 * t), -math.sin(3 * t))
    curves, n = [], 40
    for piece in range(4):
        t0 = 2 * math.pi * piece / 4
        curves += [(7, piece, k, *point(t0 + 2 * math.pi / 4 * (k / n) * 0.98)) for k in range(n)]
    ways = [(7, 0, 0, 0, 1, 1, 0), (7, 0, 0, 2, 1, 3, 0), (7, 0, 1, 0, 1, 3, 0), (7, 0, 1, 2, 1, 1, 0), (7, 1, 0, 1, 1, 2, 0), (7, 1, 1, 1, 1, 0, 0)]
    table = spark.createDataFrame(curves, "sample long, sid long, k long, p0 double, p1 double, p2 double")
    solutions, chosen = collapse.solve(table, spark.createDataFrame(ways, WAYS))
    got = {r.choice: r for r in solutions.collect()}
    assert got[0].strands == 1 and got[0].det == pytest.approx(3)
    assert 1 not in got  # 0 to 1 and back to 0
    best = [r for r in got.values() if r.is_best]
    assert len(best) == 1 and best[0].log10_det == min(r.log10_det for r in got.values() if r.log10_det is not None)
    different = {r.choice: list(r.regions) for r in collapse.differences(solutions, chosen).collect()}
    assert different[best[0].choice] == [] and set(different) == set(got)
    whole = collapse.assembled(table, collapse.distinct_chains(collapse.chains(table, spark.createDataFrame(ways, WAYS), chosen.where("choice = 0")))[0])
    assert whole.count() == 4 * n + 3 * 14 and whole.agg(F.max("k")).first()[0] == 4 * n + 3 * 14 - 1
