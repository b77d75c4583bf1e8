"""Segments, template searches, orderings and walks against plain Python over everything."""

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from curvespark.operators import graph, knots, shapes, signals, walks


def plain_warp(x, template, weights):
    """The whole table, cell by cell; x and template are lists of channels."""
    n, m = len(x[0]), len(template[0])
    c = lambda i, j: sum(w * abs(t[i] - v[j]) for w, t, v in zip(weights, template, x, strict=True))
    row = [(c(0, j), j) for j in range(n)]
    for i in range(1, m):
        new = []
        for j in range(n):
            ways = [row[j][0]] + ([row[j - 1][0], new[j - 1][0]] if j else [])
            new.append((c(i, j) + min(ways), None))
        row = new
    return [r[0] for r in row]


def test_warping_costs_of_several_channels(spark):
    rng = random.Random(1)
    rows = [(s, k, rng.gauss(0, 1), rng.gauss(0, 1)) for s in range(3) for k in range((1, 9, 40)[s])]
    template = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(2)]
    got = {(r.sid, r.k): r for r in signals.warping_costs(spark.createDataFrame(rows, "sid int, k long, x double, y double"), template, ["x", "y"], [0.7, 0.3]).collect()}
    for s in range(3):
        mine = [r for r in rows if r[0] == s]
        want = plain_warp([[r[2] for r in mine], [r[3] for r in mine]], template, [0.7, 0.3])
        for k, w in enumerate(want):
            assert got[s, k].cost == pytest.approx(w)
            # the stretch it names really costs that much
            part = mine[got[s, k].start : k + 1]
            assert plain_warp([[r[2] for r in part], [r[3] for r in part]], template, [0.7, 0.3])[-1] == pytest.approx(w)


def test_segments_are_the_cheapest(spark):
    rng = random.Random(2)
    lengths, candidates = [], []
    for s in range(6):
        n = rng.randrange(1, 11)
        lengths.append((s, n))
        candidates += [(s, a, b, round(rng.uniform(0.2, 3), 2)) for a, b in itertools.combinations(range(n + 2), 2) if rng.random() < 0.4]
    got = defaultdict(list)
    rows = signals.cheapest_segments(spark.createDataFrame(lengths, "sid int, n long"), spark.createDataFrame(candidates, "sid int, start long, stop long, cost double"), 0.8).collect()
    for r in rows:
        got[r.sid].append(r)
    for s, n in lengths:
        mine = [c[1:] for c in candidates if c[0] == s and c[2] < n]

        def best(j, mine=mine):
            return 0.0 if j == 0 else min([best(j - 1) + 0.8, *(best(a) + c for a, b, c in mine if b == j - 1)])

        if s in got:
            segments = sorted(got[s], key=lambda r: r.segment)
            assert all(a.stop < b.start for a, b in itertools.pairwise(segments))
            assert segments[0].total == pytest.approx(best(n)) == pytest.approx(sum(r.cost for r in segments) + 0.8 * segments[0].gaps)
            assert segments[0].gaps == n - sum(r.stop - r.start + 1 for r in segments)
        else:
            assert best(n) == pytest.approx(0.8 * n)


def test_hidden_segments_find_planted_templates(spark):
    rng = random.Random(4)
    template = [0.0, 2.0, 4.0, 2.0, 0.0, -3.0]
    x, planted = [], []
    for part in range(5):
        x += [rng.uniform(8, 9) for _ in range(rng.randrange(3, 8))]
        planted.append((len(x), len(x) + 5))
        x += [v + rng.uniform(-0.05, 0.05) for v in template]
    got = signals.hidden_segments(spark.createDataFrame([(0, k, v) for k, v in enumerate(x)], "sid int, k long, x double"), template, gap=0.8).orderBy("segment").collect()
    assert [(r.start, r.stop) for r in got] == planted


def rms(a, b):
    a, b = a - a.mean(0), b - b.mean(0)
    u, s, vt = np.linalg.svd(a.T @ b)
    s[2] *= np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1
    return math.sqrt(max(((a**2).sum() + (b**2).sum() - 2 * s.sum()) / len(a), 0))


def even(p, n):
    s = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(p, axis=0), axis=1))])
    return np.column_stack([np.interp(np.linspace(0, s[-1], n), s, p[:, i]) for i in range(3)])


def test_forward_matches_miss_nothing(spark):
    rng = np.random.default_rng(5)
    curve = np.cumsum(rng.normal(size=(60, 3)) * 0.3 + [0.8, 0.2, 0.1], axis=0)
    library = {"a": curve[10:26] @ np.linalg.qr(rng.normal(size=(3, 3)))[0], "b": np.cumsum(rng.normal(size=(12, 3)), axis=0), "c": np.array([[0.9 * k, 0, 0] for k in range(20)])}
    if np.linalg.det(np.linalg.lstsq(curve[10:26] - curve[10:26].mean(0), library["a"] - library["a"].mean(0), rcond=None)[0]) < 0:
        library["a"] = library["a"] * [1, 1, -1]
    rows = [(0, k, *map(float, p)) for k, p in enumerate(curve)]
    table = spark.createDataFrame(rows, "sid int, k long, p0 double, p1 double, p2 double")
    shapes_table = spark.createDataFrame([(n, k, *map(float, p)) for n, q in library.items() for k, p in enumerate(q)], "template string, k long, p0 double, p1 double, p2 double")
    starts = [(0, s, n) for s in (0, 10, 30, 45, 58) for n in library]
    got = {(r.start, r.template): r for r in shapes.forward_matches(table, spark.createDataFrame(starts, "sid int, start long, template string"), shapes_table, samples=16).collect()}
    tried = 0
    for _, s, n in starts:
        q = library[n]
        long = max(3.0, float(np.linalg.norm(np.diff(q, axis=0), axis=1).sum()))
        ends = range(s + max(3, round(0.7 * long)), min(59, s + round(1.3 * long)) + 1)
        want = min(((rms(even(q, 16), even(curve[s : e + 1], 16)), e) for e in ends), default=None)
        assert ((s, n) in got) == (want is not None)
        if want:
            assert got[s, n].rms == pytest.approx(want[0], abs=1e-6) and got[s, n].stop == want[1]
            tried += len(ends) - got[s, n].fits
    assert tried > 0 and got[10, "a"].rms < 1e-6 and got[10, "a"].stop == 25
    assert sum(r.rate for k, r in got.items() if k[0] == 0) == pytest.approx(1)


def test_points_are_put_in_order(spark):
    """A dense curve, one with a gap that more neighbours bridge, one in two parts, a pair, a lone point."""
    rng = random.Random(6)
    points, want = [], {}
    a = [(0, k, k * 0.5, math.sin(k / 5), 0.0) for k in range(50)]
    clumps = [(1, 100 + 10 * c + k, 3.2 * c + 0.02 * k, 0.0, 0.01 * (k % 3)) for c in range(3) for k in range(10)]
    two = [(2, 200 + k, k * 1.0, 0.0, 0.0) for k in range(20)] + [(2, 250 + k, 100.0 + k, 0.0, 0.0) for k in range(5)]
    points = a + clumps + two + [(3, 300, 0.0, 0.0, 0.0), (3, 301, 50.0, 0.0, 0.0), (4, 400, 0.0, 0.0, 0.0)]
    rng.shuffle(points)
    table = spark.createDataFrame(points, "sid int, id long, p0 double, p1 double, p2 double")
    got = defaultdict(dict)
    for r in walks.ordered_points(table).collect():
        got[r.sid][r.k] = r.id
    want = {0: list(range(50)), 2: list(range(200, 220)), 3: [300, 301], 4: [400]}
    for s, ids in want.items():
        mine = [got[s][k] for k in range(len(got[s]))]
        assert mine in (ids, ids[::-1])
    mine = [got[1][k] for k in range(len(got[1]))]
    clump = [(i - 100) // 10 for i in mine]
    assert clump in (sorted(clump), sorted(clump, reverse=True)) and set(clump) == {0, 1, 2}
    k = {r.sid: r.k for r in walks.grown_graph(table).select("sid", "k").distinct().collect()}
    assert k[0] == 8 and k[1] == 12 and k[2] is None


def test_walks_follow_their_direction(spark):
    rng = random.Random(7)
    points = {0: (0.0, 0.0, 0.0)}
    edges = []
    for i in range(1, 120):
        a = i - 1 if rng.random() < 0.85 else rng.randrange(i)
        points[i] = tuple(x + rng.uniform(-0.4, 1.0) for x in points[a])
        edges.append((a, i))
    adj = defaultdict(set)
    for u, v in edges:
        adj[u].add(v)
        adj[v].add(u)
    cloud = spark.createDataFrame([(i, *p) for i, p in points.items()], "id long, p0 double, p1 double, p2 double")
    tree = spark.createDataFrame([(u, v, 1.0) for u, v in edges], "u long, v long, w double")

    def chain(frm, to):
        n = 1
        while n < 30 and len(adj[to] - {frm}) == 1:
            frm, to = to, next(iter(adj[to] - {frm}))
            n += 1
        return n

    assert {(r.a, r.b): r.length for r in walks.chain_lengths(tree).collect()} == {(a, b): chain(a, b) for a in adj for b in adj[a]}

    def walk(start, avoid, steps):
        trail, before, way = [start], None, None
        for step in range(steps):
            here = trail[-1]
            options = sorted(adj[here] - {before} - ({avoid} if step == 0 else set()))
            if not options:
                break
            if step == 0:
                nxt = max(options, key=lambda b: (chain(here, b), -b))
            else:
                unit = {b: (np.array(points[b]) - points[here]) / math.dist(points[b], points[here]) for b in options}
                nxt = max(options, key=lambda b: (round(float(unit[b] @ way), 12), -b))
            way = (np.array(points[nxt]) - points[here]) / math.dist(points[nxt], points[here])
            before = here
            trail.append(nxt)
        return trail

    starts = [(k, s, v) for k, (s, v) in enumerate([(0, None), (30, 31), (60, None), (119, None), (80, 79), (5, None)])]
    got = defaultdict(dict)
    for r in walks.greedy_walks(tree, cloud, spark.createDataFrame(starts, "walker int, start long, avoid long"), steps=8).collect():
        got[r.walker][r.k] = r.id
    assert {w: [got[w][k] for k in range(len(got[w]))] for w in got} == {w: walk(s, v, 8) for w, s, v in starts}
    assert graph.degrees(cloud, tree).count() == 120


def test_segments_on_both_sides_of_a_start(spark):
    """Bends of 20 points, one like the other: from the middle on and back, each is found, compared in the curve's own direction."""
    bend = np.array([[0.5 * k, math.sin(k / 20 * math.pi) * (1 + 0.02 * k), 0.05 * k] for k in range(21)])
    parts, at = [bend], bend[-1]
    for _ in range(4):
        parts.append(bend[1:] + at)
        at = parts[-1][-1]
    p = np.concatenate(parts)
    table = spark.createDataFrame([(1, k, *map(float, x)) for k, x in enumerate(p)], "sid int, k long, p0 double, p1 double, p2 double")
    rows = {r.seg: (r.a, r.b, r.cost) for r in signals.segment_by_template(table, [tuple(x) for x in bend], first=40, variation=0.2, most=0.5, backward=True).collect()}
    assert {s: x[:2] for s, x in rows.items()} == {0: (40, 60), 1: (60, 80), 2: (80, 100), -1: (20, 40), -2: (0, 20)} and all(x[2] < 1e-6 for x in rows.values())
    forward = signals.segment_by_template(table, [tuple(x) for x in bend], first=40, variation=0.2, most=0.5).collect()
    assert {r.seg for r in forward} == {0, 1, 2}


def test_sparse_determinants_equal_dense_ones():
    """Crossings of random closed polygons, and of one."""
    rng = np.random.default_rng(11)

    def dense(under, over):
        n, m = len(under), np.zeros((len(under) - 1, len(under) - 1))
        for r, row in enumerate(knots._colouring(under, over)):
            for c, x in row.items():
                m[r, c] = x
        return np.linalg.slogdet(m)[1] if n > 1 else 0.0

    for n in (3, 8, 30, 60):
        for _ in range(5):
            p = rng.normal(size=(n, 3))
            q = (p - p.mean(0)) @ np.linalg.svd(p - p.mean(0), full_matrices=False)[2].T
            under, over = [], []
            for i, j in itertools.combinations(range(n), 2):
                a, b, c, d = q[i], q[(i + 1) % n], q[j], q[(j + 1) % n]
                if (j + 1) % n == i or j == (i + 1) % n:
                    continue
                m = np.array([b[:2] - a[:2], c[:2] - d[:2]]).T
                t, u = np.linalg.solve(m, c[:2] - a[:2])
                if 0 < t < 1 and 0 < u < 1:
                    low = a[2] + t * (b[2] - a[2]) < c[2] + u * (d[2] - c[2])
                    under.append(i + t if low else j + u)
                    over.append(j + u if low else i + t)
            if under:
                got, want = knots._log_determinant(np.array(under), np.array(over)), dense(np.array(under), np.array(over))
                assert got == pytest.approx(want, abs=1e-6)
                assert abs(math.exp(min(got, 20)) % 2 - 1) < 1e-3 or got > 20  # a knot's determinant is odd
    assert knots._log_determinant(np.array([0.5]), np.array([2.5])) == 0.0
