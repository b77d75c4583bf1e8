"""Operators against brute force and known shapes."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvespark.operators import cloud as C
from curvespark.operators import curves as V
from curvespark.operators import edits, filters, fitting, geometry, graph, joining, knots, meanshift, noise, rod, signals, trees, volume
from curvespark.operators.components import connected_components
from curvespark.plans import queries
from curvespark.sources import arrays
from curvespark.streaming import repairs

CLOUD = "id long, p0 double, p1 double, p2 double, d0 double, d1 double, d2 double, energy double, linearity double"
CURVE = "sid long, k long, p0 double, p1 double, p2 double"


def cloud_of(spark, points, directions=None):
    d = directions if directions is not None else [(1.0, 0.0, 0.0)] * len(points)
    return spark.createDataFrame([(k, *map(float, p), *map(float, x), 1.0, 1.0) for k, (p, x) in enumerate(zip(points, d, strict=True))], CLOUD)


def curve_of(spark, points, sid=0):
    return spark.createDataFrame([(sid, k, *map(float, p)) for k, p in enumerate(points)], CURVE)


def test_neighbours_are_all_pairs(spark):
    p = np.random.default_rng(0).uniform(-3, 3, (150, 3))
    p[3] = p[4]
    got = {(r.a_id, r.b_id) for r in C.neighbours(cloud_of(spark, p), 1.0, half=True).collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(150), 2) if ((p[i] - p[j]) ** 2).sum() <= 1.0}
    assert C.neighbours(cloud_of(spark, p).limit(0), 1.0).count() == 0 == C.united_degree(cloud_of(spark, p).limit(0), 1.0).count()


def test_united_degree_of_random_directions(spark):
    rng = np.random.default_rng(1)
    d = rng.standard_normal((400, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    found = C.united_degree(cloud_of(spark, rng.uniform(0, 2, (400, 3)), d), 2.0).agg(F.avg("degree")).first()[0]
    assert abs(found - 0.15) < 0.04


def test_components_do_not_depend_on_ids(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1200)]
    low = {}

    def root(x):
        low.setdefault(x, x)
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        low[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    looped = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in low if x not in looped}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_spanning_forest_weighs_the_least(spark):
    rng = np.random.default_rng(3)
    edges = {(int(min(a, b)), int(max(a, b))): float(rng.random()) for a, b in rng.integers(0, 60, (200, 2)) if a != b}
    low = {k: k for k in range(60)}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    total = 0.0
    for (a, b), w in sorted(edges.items(), key=lambda x: x[1]):
        if root(a) != root(b):
            low[root(a)] = root(b)
            total += w
    tree = graph.spanning_forest(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "u long, v long, w double")).collect()
    assert math.isclose(sum(r.w for r in tree), total) and len(tree) == 60 - len({root(k) for k in range(60)})


def walk_far(near, start):
    far, before, queue = {start: 0.0}, {start: None}, [start]
    for node in queue:
        for other, w in sorted(near[node].items()):
            if other not in far:
                far[other], before[other] = far[node] + w, node
                queue.append(other)
    return far, before


def longest(edges):
    near = {}
    for u, v, w in edges:
        near.setdefault(u, {})[v] = w
        near.setdefault(v, {})[u] = w
    seen, out = set(), []
    for root in sorted(near):
        if root in seen:
            continue
        far, _ = walk_far(near, root)
        seen |= set(far)
        a = min(far, key=lambda n: (-round(far[n], 9), n))
        far, before = walk_far(near, a)
        b = min(far, key=lambda n: (-round(far[n], 9), n))
        path = [b]
        while path[-1] != a:
            path.append(before[path[-1]])
        out.append((root, path[::-1], far[b], set(far)))
    return out


def peel(edges, least):
    out, pieces = {}, [(root, [e for e in edges if e[0] in own]) for root, _, _, own in longest(edges)]
    while pieces:
        whole, left = pieces.pop()
        for _, path, length, own in longest(left):
            if length >= least:
                out.setdefault(whole, []).append(path)
                pieces.append((whole, [e for e in left if e[0] in own and not {e[0], e[1]} & set(path)]))
    return {k: sorted(v, key=lambda p: (-len(p), p[0])) for k, v in out.items()}


@pytest.mark.parametrize("seed", [1])
def test_longest_paths_of_forests(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(rng.integers(max(0, k - 6), k)), k, float(rng.integers(1, 4)) / 4) for k in range(1, 45)]
    edges += [(a + 200, b + 200, w) for a, b, w in edges[:25]] + [(300 + k, 301 + k, 1.0) for k in range(20)] + [(500, 501, 0.0)]
    frame = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in edges], "u long, v long, w double")
    pieces = connected_components(frame).withColumnRenamed("node", "id")
    got = {}
    for r in trees.longest_paths(frame, pieces).orderBy("component", "k").collect():
        got.setdefault(r.component, []).append(r.id)
    assert got == {root: path for root, path, _, _ in longest(edges)}
    peeled = {}
    for r in trees.peeled_paths(frame, pieces, 2.0).orderBy("component", "path", "k").collect():
        peeled.setdefault(r.component, {}).setdefault(r.path, []).append(r.id)
    assert {c: list(p.values()) for c, p in peeled.items()} == peel(edges, 2.0)
    assert trees.longest_paths(frame.limit(0), pieces).count() == 0 == trees.peeled_paths(frame.limit(0), pieces, 0.5).count()


def test_straight_connection(spark):
    points, chain = graph.straight_connection((0, 0, 0, 0), (1, 10, 0, 0), 2.0, 100, spark)
    assert [r.p0 for r in points.orderBy("id").collect()] == [2.0, 4.0, 6.0, 8.0]
    assert sorted((r.u, r.v) for r in chain.collect()) == [(0, 100), (100, 101), (101, 102), (102, 103), (103, 1)]


def test_mean_shift_thins_a_tube(spark):
    rng = np.random.default_rng(4)
    p = np.column_stack([np.linspace(0, 40, 160), rng.normal(0, 0.8, 160), rng.normal(0, 0.8, 160)])
    cloud = cloud_of(spark, p)
    out = meanshift.mean_shift(cloud, meanshift.ShiftParameters(steps=3, first=4.0, last=3.0, lock_at=1, reach=3.0, weight=0.0)).orderBy("id").toPandas()
    assert np.hypot(out.p1, out.p2).mean() < 0.5 * np.hypot(p[:, 1], p[:, 2]).mean()
    one = meanshift.shift_step(cloud, 4.0, meanshift.ShiftParameters(turn=False)).orderBy("id").toPandas()
    assert np.abs(one.p0 - p[:, 0]).max() < 1e-9
    assert meanshift.mean_shift(cloud.limit(0), meanshift.ShiftParameters(steps=1)).count() == 0
    assert meanshift.ablated(meanshift.ShiftParameters(), "without_lock").weight == 0.0


def test_springs_keep_the_centre(spark):
    cloud = cloud_of(spark, [(0, 0, 0), (3, 0, 0)])
    out = meanshift.spring_step(cloud, spark.createDataFrame([(0, 1, 1.0)], "a long, b long, rest double"), 0.5).orderBy("id").collect()
    assert [r.p0 for r in out] == [1.0, 2.0]


def test_line_and_circle(spark):
    line = curve_of(spark, [(k, 0, 0) for k in range(101)])
    assert V.total_length(line).first().length == 100.0 and V.curvature(line).agg(F.max("kappa")).first()[0] == 0.0
    even = V.resample(line, points=5).orderBy("k").collect()
    assert [r.p0 for r in even] == [0, 25, 50, 75, 100]
    t = np.linspace(0, 2 * np.pi, 401)
    circle = curve_of(spark, np.column_stack([10 * np.cos(t), 10 * np.sin(t), 0 * t]))
    length = V.total_length(circle).first().length
    assert abs(length - 20 * np.pi) < 0.01
    smooth = V.resample_hermite(circle, 0.5)
    inner = V.curvature(smooth, length / round(length / 0.5)).where("k between 5 and 110").agg(F.min("kappa"), F.max("kappa")).first()
    assert abs(inner[0] - 0.1) < 0.005 and abs(inner[1] - 0.1) < 0.005
    still = curve_of(spark, [(1, 1, 1)] * 4)
    assert V.resample(still, points=3).count() == 0 and V.total_length(still).first().length == 0.0 and V.turn_angles(still).agg(F.max("angle")).first()[0] == 0.0


def test_split_at_a_corner(spark):
    corner = curve_of(spark, [(k, 0, 0) for k in range(20)] + [(19, k, 0) for k in range(1, 20)])
    got = V.split_at_turns(corner, 80.0).groupBy("piece").agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("piece").collect()
    assert [(r.a, r.b) for r in got] == [(0, 19), (19, 38)]


def test_rigid_copy(spark):
    rng = np.random.default_rng(5)
    a = rng.standard_normal((50, 3))
    q, _ = np.linalg.qr(rng.standard_normal((3, 3)))
    q *= np.sign(np.linalg.det(q))
    pairs = spark.createDataFrame([(0, *map(float, x), *map(float, y)) for x, y in zip(a, a @ q.T + 5, strict=True)], "g long, a0 double, a1 double, a2 double, b0 double, b1 double, b2 double")
    fit = signals.rigid_fit(pairs, "g").first()
    r = np.array([[fit[f"r{i}{j}"] for j in range(3)] for i in range(3)])
    assert fit.rms < 1e-6 and np.allclose(r, q) and math.isclose(np.linalg.det(r), 1.0)


def test_knots():
    t = np.linspace(0, 2 * np.pi, 600, endpoint=False) + 0.01
    trefoil = np.column_stack([np.sin(t) + 2 * np.sin(2 * t), np.cos(t) - 2 * np.cos(2 * t), -np.sin(3 * t)])
    eight = np.column_stack([(2 + np.cos(2 * t)) * np.cos(3 * t), (2 + np.cos(2 * t)) * np.sin(3 * t), np.sin(4 * t)])
    circle = np.column_stack([np.cos(t), np.sin(t), 0 * t])
    assert [knots.determinant(x) for x in (circle, trefoil, eight)] == [1.0, 3.0, 5.0]
    assert len(knots.matchings(2, 2)) == 2 and len(knots.matchings(3, 3, 4)) == 4 and knots.matchings(1, 2) == [((0, 0),), ((0, 1),)]


def test_determinants_take_all_vertices(spark, monkeypatch):
    t = np.linspace(-2.1, 2.1, 21)
    long_trefoil = np.column_stack([t**3 - 3 * t, t**4 - 4 * t**2, t**5 / 5 - 2 * t])
    closed = lambda p: np.vstack([p[:1] + [0, 6, 0], p, p[-1:] + [0, 6, 0]])
    chain, one = closed(np.vstack([long_trefoil + [7 * k, 0, 0] for k in range(40)])), closed(long_trefoil)
    rng = np.random.default_rng(3)
    walks = [rng.uniform(-1, 1, (8 + s, 3)) for s in range(12)]
    curves = curve_of(spark, chain, 100).union(curve_of(spark, [(0, 0, 0), (1, 0, 0)], 101)).union(curve_of(spark, np.repeat(one, 2, 0)[[*range(46), 0]], 102))
    for s, p in enumerate(walks):
        curves = curves.union(curve_of(spark, p, s))
    found = {r.sid: r for r in knots.knot_determinants(curves).collect()}
    assert len(found) == 15 and math.isclose(found[100].log10_det, 40 * math.log10(3), rel_tol=1e-9) and (found[101].det, found[101].log10_det, found[102].det) == (1.0, 0.0, 3.0)
    for s, p in enumerate(walks):
        want = knots.determinant(p)
        assert math.isclose(found[s].det, want, rel_tol=1e-6) and (want >= math.exp(25) or want % 2 == 1)
    trefoil = curve_of(spark, np.vstack([one[:1] + [[-k / 30, k / 30, 0]] for k in range(60, 0, -1)] + [one]), 7)
    monkeypatch.setattr(queries.P, "curves_from_events", lambda *_: trefoil)
    assert [(r.sid, r.det) for r in queries.knot_determinant(spark, "").collect()] == [(7, 3.0)]


def test_choices(spark):
    got = sorted(tuple(r.choice) for r in knots.choices(spark, [2, 3]).collect())
    assert got == sorted(itertools.product(range(2), range(3)))
    with pytest.raises(ValueError):
        knots.choices(spark, [200, 200])


def test_frames_and_tubes(spark):
    t = np.linspace(0, 6, 60)
    helix = curve_of(spark, np.column_stack([5 * np.cos(t), 5 * np.sin(t), 3 * t]))
    found = geometry.frames(helix).toPandas()
    n, b, tangent = (found[[f"{s}{i}" for i in range(3)]].to_numpy() for s in "nbt")
    assert np.allclose((n * tangent).sum(1), 0, atol=0.02) and np.allclose(np.linalg.norm(n, axis=1), 1, atol=1e-6) and np.allclose(np.cross(tangent, n), b)
    framed = geometry.framed(helix)
    assert geometry.tube_vertices(framed, 6, 1.0).count() == 360 and geometry.tube_faces(helix, 6).count() == 59 * 12
    assert geometry.obj_lines(helix).where("line like 'v %'").count() == 60


def test_rod_at_rest(spark):
    p = rod.RodParameters(gravity=0.0)
    still = rod.simulate(curve_of(spark, [(24 * k, 3 * k * k, 100) for k in range(8)]), 2, ground=-1e6, p=p).toPandas()
    first, last = still[still.frame == 0], still[still.frame == 2]
    assert np.abs(first[["p0", "p1", "p2"]].to_numpy() - last[["p0", "p1", "p2"]].to_numpy()).max() < 1e-6
    falls = rod.simulate(curve_of(spark, [(24 * k, 0, 100) for k in range(6)]), 3, ground=-1e6).toPandas()
    assert falls[falls.frame == 3].p2.max() < 100 and falls.penetration.max() == 0.0


def test_thresholds(spark):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(20, 3, 3000), rng.normal(80, 4, 2000)])
    frame = spark.createDataFrame([("s", float(x)) for x in v], "sample string, v double")
    assert 30 < volume.otsu(frame).first().threshold < 70 and 30 < volume.valley(frame).first().threshold < 70
    flat = spark.createDataFrame([("s", 2.0)] * 5, "sample string, v double")
    assert volume.otsu(flat).first().threshold == 2.0 and volume.valley(flat).first().threshold == 2.0 and volume.otsu(flat.limit(0)).count() == 0
    assert volume.slice_positions(100, 3) == [10, 50, 90]


def test_eigen(spark):
    got = signals.symmetric_eigen(spark.createDataFrame([(0, 3.0, 0.0, 0.0, 2.0, 0.0, 1.0)], "g long, xx double, xy double, xz double, yy double, yz double, zz double"), "g").first()
    assert np.allclose([got.l0, got.l1, got.l2], [1, 2, 3], atol=1e-6) and np.allclose([got.t0, got.t1, got.t2], [0, 0, 1])


def test_template_segments(spark):
    t = np.linspace(0, 2 * np.pi, 31)
    wave = np.column_stack([t, np.sin(t), 0 * t])
    line = np.vstack([wave[:-1] + [2 * np.pi * k, 0, 0] for k in range(4)] + [wave[-1:] + [6 * np.pi, 0, 0]])
    got = signals.segment_by_template(curve_of(spark, line), [tuple(x) for x in wave], variation=0.1).orderBy("seg").collect()
    assert [(r.a, r.b) for r in got] == [(0, 30), (30, 60), (60, 90), (90, 120)] and max(r.cost for r in got) < 1e-6


def test_array_sources(spark, tmp_path):
    arrays.register(spark)
    np.savez(tmp_path / "c.npz", points=np.arange(6).reshape(2, 3), dirs=np.array([[0, 0, 2.0], [0, 0, 0]]), energy=np.array([1.0, 2.0]))
    got = spark.read.format("npz").load(str(tmp_path)).orderBy("id").collect()
    assert [(r.sample, r.p0, r.d2, r.energy, r.linearity) for r in got] == [("c", 0.0, 1.0, 1.0, None), ("c", 3.0, 0.0, 2.0, None)]
    v = np.zeros((2, 3, 4), "<u2")
    v[1, 2, 3] = 7
    (tmp_path / "v.nrrd").write_bytes(b"NRRD0004\ntype: uint16\ndimension: 3\nsizes: 4 3 2\nencoding: raw\nendian: little\n\n" + v.tobytes())
    assert [tuple(r) for r in spark.read.format("nrrd").load(str(tmp_path)).collect()] == [("v", 1, 2, 3, 7.0)]
    with pytest.raises(ValueError):
        arrays.parse_nrrd(b"P5")


def test_sessions_stream_as_they_do_in_a_table(spark, tmp_path):
    rows = [{"ts": f"2024-01-01 {h:02d}:{m:02d}:00", "sample": "s", "sid": 1, "kind": "B" if m else "A", "g1": h * 60 + m, "g2": 0, "n_synth": 2} for h in (1, 2, 9) for m in (0, 10, 20)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    late = repairs.live_sessions(repairs.read_log(spark, str(tmp_path / "log")))
    query = late.writeStream.format("memory").queryName("sessions").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    table = repairs.live_sessions(spark.read.schema(repairs.SCHEMA).json(str(tmp_path / "log")))
    assert sorted(map(tuple, spark.table("sessions").collect())) == sorted(map(tuple, table.collect())) and table.count() == 3


def test_edit_log(spark):
    log = spark.createDataFrame([(1, 1, "add", 5), (1, 2, "move", 6), (2, 1, "add", 7), (2, 3, "delete", 0)], "id long, version long, kind string, x long")
    assert [tuple(r) for r in edits.replay(log).collect()] == [(1, 2, "move", 6)]


def test_filters_see_a_tube_and_do_not_depend_on_blocks(spark):
    z, x = np.meshgrid(range(12, 15), range(12, 15), indexing="ij")
    rows = [("s", int(a), y, int(b), 10.0) for a, b in zip(z.ravel(), x.ravel(), strict=True) for y in range(26)]
    tube = spark.createDataFrame(rows, "sample string, z int, y int, x int, v double")
    one, many = (filters.structure_tensors(tube, 24, 2.0, 0.15, 5, edge).orderBy("z", "y", "x").toPandas() for edge in (32, 8))
    assert np.allclose(one[["xx", "yy", "zz", "energy"]], many[["xx", "yy", "zz", "energy"]])
    middle = spark.createDataFrame(one[(one.y == 13) & (one.z == 13) & (one.x == 13)].drop(columns="energy"))
    found = signals.symmetric_eigen(middle, "y").first()
    assert abs(found.t1) > 0.95


def test_spline_meets_its_sum_and_curves_repeat(spark):
    rng = np.random.default_rng(7)
    t = np.linspace(0, 6, 300)
    p = np.column_stack([20 * t, 20 * np.sin(t), 0 * t])
    noisy = p + rng.normal(0, 0.5, p.shape)
    fit = fitting.smoothing_spline(noisy, 0.75)
    far = np.sqrt(((fit[:, None] - p[None]) ** 2).sum(2)).min(1)
    assert far.mean() < 0.5 and fitting.fit_curves(curve_of(spark, noisy)).count() > 100
    parts = [curve_of(spark, p, 1), curve_of(spark, p[20:200] + 0.5, 2), curve_of(spark, p[:100] + [0, 0, 50], 3), curve_of(spark, p[:50] + [0, 0, 51], 4)]
    every = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    assert sorted(r.sid for r in fitting.without_repeats(every).select("sid").distinct().collect()) == [1, 3]
    assert fitting.without_repeats(every.limit(0)).count() == 0


def test_splines_of_long_curves_meet_their_sum():
    t = np.linspace(0, 1, 1500)
    p = np.column_stack([1500 * t, 30 * np.sin(400 * np.pi * t), 30 * np.cos(400 * np.pi * t)])
    fit = fitting.smoothing_spline(p, 0.5, 0.5)
    far = np.array([((fit - x) ** 2).sum(1).min() for x in p])
    assert far.mean() <= 0.5 + 0.25**2  # half a step beside the fit's own place at most
    few = np.random.default_rng(5).uniform(0, 100, (9, 3))
    assert len(fitting.smoothing_spline(few, 0.01)) > 100


def test_noise(spark):
    p = np.random.default_rng(8).uniform(-5, 5, (2000, 3))
    v = noise.lattice_noise(p, 0)
    assert np.abs(v).max() <= 1.1 and v.std() > 0.1 and np.abs(noise.lattice_noise(np.floor(p), 0)).max() == 0.0
    line = curve_of(spark, [(k, 0, 0) for k in range(50)])
    assert noise.warped(line, 10.0, 2.0).where("abs(p0 - k) <= 2.2").count() == 50
    assert noise.hairs(line, 10.0, 5.0).count() == 4 * 8 and noise.hairs(line, 100.0, 5.0).count() == 0


def test_joined_and_closed_curves(spark):
    a, b, c = curve_of(spark, [(k, 0, 0) for k in range(10)], 1), curve_of(spark, [(30 - k, 0, 0) for k in range(10)], 2), curve_of(spark, [(0, k, 9) for k in range(5)], 3)
    joins = spark.createDataFrame([(1, 1, 2, 1, 7)], "a long, a_end int, b long, b_end int, new_sid long")
    out = joining.join_ends(a.union(b).union(c), joins, points=6)
    made = out.where("sid = 7").orderBy("k").collect()
    assert [r.k for r in made] == list(range(24)) and [r.p0 for r in made] == sorted(r.p0 for r in made) and all(r.p1 == r.p2 == 0 for r in made)
    assert sorted(r.sid for r in out.select("sid").distinct().collect()) == [3, 7] and made[0].p0 == 0 and made[-1].p0 == 30
    t = np.linspace(0, 5, 60)
    arc = curve_of(spark, np.column_stack([np.cos(t), np.sin(t), 0 * t]))
    closed = joining.close_loops(arc, spark.createDataFrame([(0,)], "sid long"), 12).orderBy("k").collect()
    assert len(closed) == 71 and math.dist((closed[-1].p0, closed[-1].p1), (1, 0)) < 1e-9


def test_radii_of_a_disc(spark):
    y, x = np.mgrid[0:41, 0:41]
    rows = [("s", 0, int(a), int(b), 1.0) for a, b in zip(*np.nonzero((y - 20) ** 2 + (x - 20) ** 2 <= 100), strict=True)]
    found = volume.slice_radii(spark.createDataFrame([*rows, ("s", 1, 0, 0, 1.0)], "sample string, z int, y int, x int, v double"))
    assert abs(found.agg(F.max("radius")).first()[0] - 10.5) < 1 and found.select("at").distinct().count() == 1
