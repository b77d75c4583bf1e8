"""Joins in space and fix-points whose cost must not outgrow their tables: no broadcast copies, nothing computed twice, few rounds; results by brute force."""

import numpy as np
import pytest

from curvespark.operators import cloud, collapse, curves, decisions, fitting, graph, junctions, knots, meanshift, paths, signals, trees, walks
from curvespark.plans import queries

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def joins(df):
    return plan(df).split("== Initial Plan ==")[0].count("Join ")


def points_of(spark, p, names="id long, p0 double, p1 double, p2 double"):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], names)


def cloud_points(seed=0, n=400):
    """Random points, and some on cells' borders just a radius apart, on both sides of zero."""
    p = np.random.default_rng(seed).uniform(-20, 20, (n, 3))
    p[:60] = np.random.default_rng(seed + 1).integers(-4, 5, (60, 3)) * 3.0
    return p


def test_writhe_and_smoothing_need_no_join(spark):  # F1
    rows = [(s, k, float(np.cos(k * 0.7 + s)), float(np.sin(k * 0.7)), 0.1 * k) for s, n in ((0, 40), (1, 3), (2, 1)) for k in range(n)]
    lines = spark.createDataFrame(rows, "sid long, k long, p0 double, p1 double, p2 double")
    found = signals.local_writhe(lines, 5)
    assert "Join" not in plan(found) and "Generate" not in plan(found)
    smooth = {(r.sid, r.k): r.p0 for r in curves.gaussian_smooth(lines, ["p0"], 3.0).collect()}
    w = np.exp(-0.5 * (np.arange(-12, 13) / 3.0) ** 2)
    for s, n in ((0, 40), (1, 3), (2, 1)):
        x = np.array([r[2] for r in rows if r[0] == s])
        for k in range(n):
            at = (k + np.arange(-12, 13)) % (2 * n)
            assert smooth[s, k] == pytest.approx((w / w.sum()) @ x[np.where(at < n, at, 2 * n - 1 - at)], abs=1e-12)


def test_nearest_ends_copies_ends_and_broadcasts_nothing(spark):  # F2
    p = cloud_points(2, 300)
    lines = spark.createDataFrame([(s, k, *map(float, p[s * 5 + k])) for s in range(20) for k in range(5)], "sid long, k long, p0 double, p1 double, p2 double")
    found = junctions.nearest_ends(points_of(spark, p), lines, 6.0)
    assert "Broadcast" not in plan(found)
    want = {}
    for i, x in enumerate(p):
        near = [(float(((x - p[s * 5 + e * 4]) ** 2).sum()), s, e) for s in range(20) for e in (0, 1)]
        if (best := min(near))[0] <= 36:
            want[i] = best
    got = {r.id: r for r in found.collect()}
    assert set(got) == set(want) and all((got[i].sid, got[i].end) == want[i][1:] and got[i].distance == pytest.approx(want[i][0] ** 0.5) for i in want)


def test_repeats_are_decided_without_waiting_for_all_longer_ones(spark, monkeypatch):  # F3
    """Curves beside each other: each lies on all that are longer, so one after the other was decided before."""
    n, rows = 10, []
    for s in range(n):
        rows += [(s, k, float(k), 0.01 * s, 0.0) for k in range(40 - s)]
    rounds, real = [], fitting.stored
    monkeypatch.setattr(fitting, "stored", lambda df, name="table": rounds.append(name) or real(df, name))
    lines = spark.createDataFrame(rows, "sid long, k long, p0 double, p1 double, p2 double")
    assert {r.sid for r in fitting.without_repeats(lines, 0.5, 0.6).select("sid").distinct().collect()} == {0}
    assert rounds.count("left") <= 4


@pytest.mark.parametrize("half", [True, False])
@pytest.mark.parametrize("inclusive", [True, False])
def test_grid_join_is_exact_and_broadcasts_nothing(spark, half, inclusive):  # F14 to F20
    p = cloud_points()
    found = cloud.neighbours(points_of(spark, p), 3.0, inclusive=inclusive, half=half)
    assert "Broadcast" not in plan(found)
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    near = (d2 <= 9.0) if inclusive else (d2 < 9.0)
    want = sorted((int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True) if (a < b if half else a != b))
    rows = found.collect()
    assert sorted((r.a_id, r.b_id) for r in rows) == want
    assert all((r.a_p0, r.b_p1) == (p[r.a_id][0], p[r.b_id][1]) and r.d2 == pytest.approx(d2[r.a_id, r.b_id]) for r in rows)


def test_a_point_has_few_copies(spark):  # F14 to F20
    p = np.random.default_rng(3).uniform(-50, 50, (2000, 3))
    copied = points_of(spark, p)
    for k in range(3):
        copied = copied.withColumn(f"n{k}", cloud.F.explode(cloud.cells_within(f"p{k}", 2.0)))
    assert copied.count() < 6 * len(p)


def counted(monkeypatch):
    calls, real = [], cloud.neighbours
    monkeypatch.setattr(cloud, "neighbours", lambda *a, **k: calls.append(a) or real(*a, **k))
    return calls


def test_all_variants_of_a_step_share_their_neighbours(spark, monkeypatch):  # F5
    calls = counted(monkeypatch)
    queries.QUERIES["shift_variants"](spark, DATA)
    assert len(calls) == 1


def test_edges_of_the_graph_are_made_once(spark):  # F6 to F10
    assert hasattr(queries._graph(spark, DATA)[1], "_stored_at")


def test_both_radii_of_the_junctions_share_their_pairs(spark, monkeypatch):  # F12
    calls, real = counted(monkeypatch), queries.graph.neighbours
    monkeypatch.setattr(queries.graph, "neighbours", lambda *a, **k: calls.append(a) or real(*a, **k))
    queries.QUERIES["junction_diff"](spark, DATA)
    assert len(calls) == 1


def calls_of(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: calls.append((a, k)) or real(*a, **k))
    return calls


def test_loops_need_one_pass_over_the_branches(spark, monkeypatch):  # F4
    """Loops need the arms and where they touch: no next junctions, no turning points, no tips of other trees, each loop once."""
    reaches, loops, tips = calls_of(monkeypatch, decisions.paths, "reaches"), calls_of(monkeypatch, decisions, "loop_nodes"), calls_of(monkeypatch, decisions, "component_tips")
    queries.QUERIES["loop_paths"](spark, DATA)
    assert (len(reaches), len(loops), len(tips)) == (1, 1, 0)


def test_decisions_search_only_if_a_stem_leads_nowhere(spark, monkeypatch):  # F11
    tips = calls_of(monkeypatch, decisions, "component_tips")
    queries.QUERIES["junction_decisions"](spark, DATA)
    assert not tips


def test_walk_around_trees_carries_numbers_only(spark, monkeypatch):  # F4, F11, F13
    rng, rows = np.random.default_rng(5), []
    for tree, n in ((0, 60), (100, 2), (200, 30)):
        rows += [(tree + i, tree + int(rng.integers(max(0, i - 4), i)), float(rng.uniform(1, 2))) for i in range(1, n)]
    above = {a: (b, w) for a, b, w in rows}
    frame = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in rows], "u long, v long, w double")
    names = spark.createDataFrame([(i, i // 100 * 100) for i in {x for a, b, _ in rows for x in (a, b)}], "id long, component long")
    kinds, real = [], trees.stored
    monkeypatch.setattr(trees, "stored", lambda df, name="table": kinds.append((name, df.dtypes)) or real(df, name))
    got = {r.id: r for r in trees.rooted(frame, names).collect()}
    walks_of = [dict(d) for n, d in kinds if n == "pointers" and "next" in dict(d)]
    assert walks_of and all(set(d.values()) == {"bigint"} and len(d) == 3 for d in walks_of)
    for i, r in got.items():
        if i % 100 == 0:
            assert (r.parent, r.hops, r.far) == (None, 0, 0.0)
        else:
            p, w = above[i]
            assert r.parent == p and r.hops == got[p].hops + 1 and r.far == pytest.approx(got[p].far + w)
            assert got[p].down > r.down > r.up > got[p].up


def test_extremes_of_branches_by_brute_force(spark):  # F11
    rng, edges = np.random.default_rng(8), []
    for i in range(1, 45):
        edges.append((int(rng.integers(max(0, i - 3), i)), i, 1.0))
    frame = spark.createDataFrame(edges, "u long, v long, w double")
    nodes = trees.rooted(frame, spark.createDataFrame([(i, 0) for i in range(45)], "id long, component long"))
    d = np.full((45, 45), 99)
    np.fill_diagonal(d, 0)
    for a, b, _ in edges:
        d[a, b] = d[b, a] = 1
    for k in range(45):
        d = np.minimum(d, d[:, k, None] + d[None, k])
    under = {i: {i} for i in range(45)}
    for a, b, _ in reversed(edges):
        under[a] |= under[b]
    marked = [3, 17, 31, 44]
    table = spark.createDataFrame([(i,) for i in marked], "id long")
    for only, nearest in ((None, False), (table, True)):
        sign = 1 if nearest else -1
        for r in paths.reaches(nodes, paths.jumps(nodes), only, nearest).collect():
            for inside, got in ((True, (r.below, r.below_node)), (False, (r.above, r.above_node))):
                of = [j for j in (range(45) if only is None else marked) if (j in under[r.id]) == inside]
                want = min(((sign * d[r.id, j], j) for j in of), default=None)
                assert got == ((None, None) if want is None else (sign * want[0], want[1]))


def test_ball_of_equal_names(spark):  # F11
    p = cloud_points(6, 200)
    table = points_of(spark, p).withColumn("component", cloud.F.col("id") % 3)
    found = junctions.ball(table.where("id < 50"), table, 5.0, ("component",))
    want = sorted((i, j) for i in range(50) for j in range(200) if i % 3 == j % 3 and ((p[i] - p[j]) ** 2).sum() <= 25)
    assert sorted((r.centre, r.id) for r in found.collect()) == want


def test_groups_that_stay_apart_take_no_rounds(spark, monkeypatch):  # F13
    """Every group has a point far off, so no number of neighbours joins it: the rounds have nothing to ask."""
    rng = np.random.default_rng(4)
    rows = [(s, 100 * s + i, *map(float, rng.uniform(0, 3, 3) + (500 if i == 0 else 0))) for s in range(4) for i in range(20)]
    table = spark.createDataFrame(rows, "sid long, id long, p0 double, p1 double, p2 double")
    asked = calls_of(monkeypatch, walks, "connected_components")
    got = walks.ordered_points(table)
    assert not asked and {r.sid for r in got.select("sid").distinct().collect()} == {0, 1, 2, 3}


def test_parallel_edges_between_components_go(spark, monkeypatch):  # F13
    """Two clumps of points with all edges: after the first rounds at most an edge for each pair of components is left."""
    p = np.concatenate([np.random.default_rng(1).uniform(0, 1, (30, 3)), np.random.default_rng(2).uniform(0, 1, (30, 3)) + 5])
    d = ((p[:, None] - p[None]) ** 2).sum(2) ** 0.5
    rows = [(a, b, float(d[a, b])) for a in range(60) for b in range(a + 1, 60)]
    left, real = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name="table": (x := real(df, name), left.append(x.count()) if name == "edges" else None)[0])
    tree = graph.spanning_forest(spark.createDataFrame(rows, "u long, v long, w double")).collect()
    joined, want = list(range(60)), 0.0
    for a, b, w in sorted(rows, key=lambda r: r[2]):
        if joined[a] != joined[b]:
            want, joined = want + w, [joined[a] if x == joined[b] else x for x in joined]
    assert len(tree) == 59 and sum(r.w for r in tree) == pytest.approx(want)
    assert left[0] == len(rows) and left[1] <= 30 * 29 // 2


def test_pointers_are_followed_only_beside_the_pairs(spark, monkeypatch):  # F23, F24
    """Pairs far apart have their roots at once; a chain that grows heavier, a star and random edges give the forest of least weight."""
    rng = np.random.default_rng(11)
    rows = [(2 * i, 2 * i + 1, 1.0 + i / 100) for i in range(50)] + [(200 + i, 201 + i, 1.0 + i) for i in range(40)] + [(300, 301 + i, 2.0 + i) for i in range(20)]
    rows += [(a, b, float(rng.uniform(1, 9))) for a in range(400, 440) for b in range(a + 1, 440) if rng.random() < 0.2]
    kept, real = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name="table": (x := real(df, name), kept.append({r.c for r in x.collect()}) if name == "beside" else None)[0])
    got = {(r.u, r.v) for r in graph.spanning_forest(spark.createDataFrame(rows, "u long, v long, w double")).collect()}
    joined, want = {x: x for a, b, _ in rows for x in (a, b)}, set()
    for a, b, w in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if (one := joined[a]) != (other := joined[b]):
            want.add((a, b))
            joined = {k: one if x == other else x for k, x in joined.items()}
    assert got == want
    assert kept and min(kept[0]) >= 200 and len(kept) <= 4


def test_branches_are_placed_once(spark):  # F24
    """Stems and short arms from the branches' places are those from the whole cloud; the query keeps no other points for them."""
    rng = np.random.default_rng(12)
    rows = [(i, int(rng.integers(max(0, i - 4), i))) for i in range(1, 80)]
    tree = spark.createDataFrame([(min(x), max(x), 1.0) for x in rows], "u long, v long, w double")
    table = points_of(spark, rng.uniform(0, 9, (300, 3)))
    found = junctions.branches(tree, junctions.hubs(tree), 2)
    at = junctions.places(found, table)
    assert {r.id for r in at.collect()} == {x for r in found.collect() for x in (r.junction, r.node)} and at.columns == ["id", "p0", "p1", "p2"]
    arms = []
    for few in (table, at):
        vectors = junctions.probe_vectors(found, few, 4.0)
        counts = junctions.sector_counts(vectors, table, 4.0, few)
        arms.append((sorted(counts.collect()), sorted(junctions.short_arms(found, junctions.stems(vectors, counts), few, 3.0).collect())))
    assert arms[0] == arms[1] and arms[0][1]
    assert hasattr(queries.more_queries._stems(spark, DATA)[0], "_stored_at")


def test_fresh_links_bring_their_offsets(spark):  # F15
    """Springs of links just made look no point up, and move points as looked-up ends do; points in one place are no links and divide by nothing."""
    p = cloud_points(13, 300)
    p[200:220] = p[:20]
    rows = [(i, *map(float, x), float(np.cos(i)), float(np.sin(i)), 0.0) for i, x in enumerate(p)]
    table = spark.createDataFrame(rows, "id long, p0 double, p1 double, p2 double, d0 double, d1 double, d2 double")
    bare, full = cloud.cone_links(table, 6.0), cloud.cone_links(table, 6.0, offsets=True)
    assert sorted(full.select("a", "b", "rest").collect()) == sorted(bare.collect())
    slow, fast = (sorted(meanshift.spring_step(table, x.withColumn("rest", cloud.F.lit(3.0)), 1.0, 1.0).collect()) for x in (bare, full))
    assert len(fast) == 300 and any(tuple(r)[1:4] != tuple(p[r.id]) for r in fast)
    assert all(a.id == b.id and tuple(a)[1:4] == pytest.approx(tuple(b)[1:4], abs=1e-12) for a, b in zip(slow, fast, strict=True))
    assert joins(queries.QUERIES["spring_step"](spark, DATA)) == 2


def test_flagship_looks_no_point_up_again(spark):  # F17
    assert joins(queries.QUERIES["flagship"](spark, DATA)) == 2


@pytest.mark.parametrize("name", ["meanshift_step", "meanshift_dirs", "united_filter", "united_degree", "cone_links"])  # F14, F16, F18 to F20
def test_copies_of_points_are_not_broadcast(spark, name):
    copied = [line for line in plan(queries.QUERIES[name](spark, DATA)).splitlines() if "n0" in line and "m0" in line and "Join" in line]
    assert copied and all("SortMergeJoin" in line for line in copied)


def test_edges_of_components_are_made_by_sorted_joins(spark):  # F21, F22
    edges = graph.proximity_edges(points_of(spark, cloud_points(14, 100)), 2.0)
    assert "SortMergeJoin" in plan(edges) and "Broadcast" not in plan(edges)


def test_crossings_are_one_shuffle_of_about_two_copies(spark):  # round 4, F3
    """Random closed polygons, one with segments that are long beside its mean, one flat: crossings by brute force, and one exchange for both sides of the join."""
    rng, rows = np.random.default_rng(5), []
    for s, n in enumerate((40, 80, 5, 3)):
        p = rng.normal(size=(n, 3)) * (5, 3, 1)
        if s == 1:
            p[20:60] *= 0.05
        if s == 2:
            p[:, 1:] = 0
        rows += [(s, k, *map(float, x)) for k, x in enumerate(p)]
    segments = knots._closed_segments(spark.createDataFrame(rows, "sid long, k long, p0 double, p1 double, p2 double"))
    found = knots._curve_crossings(segments)
    got = {}
    for r in found.collect():
        got.setdefault(r.sid, []).append((r.under, r.over))
    found._jdf.queryExecution().toRdd().count()
    ran = plan(found).split("== Initial Plan ==")[0]
    assert ran.count("ReusedExchange [b_sid") == 1, ran
    lines = {}
    for r in segments.orderBy("sid", "k").collect():
        lines.setdefault(r.sid, []).append((r.x0, r.y0, r.z0, r.x1, r.y1, r.z1))
    for s, own in lines.items():
        want = []
        for i, (ax, ay, az, bx, by, bz) in enumerate(own):
            for j in range(i + 2, len(own) - (i == 0)):
                cx, cy, cz, dx, dy, dz = own[j]
                if den := (bx - ax) * (dy - cy) - (by - ay) * (dx - cx):
                    t, u = (((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den)
                    if 0 < t < 1 and 0 < u < 1:
                        want.append((i + t, j + u) if az + t * (bz - az) < cz + u * (dz - cz) else (j + u, i + t))
        assert sorted(got.get(s, [])) == pytest.approx(np.array(sorted(want)).reshape(-1, 2), abs=1e-9) if want else s not in got
    assert len(got[0]) > 100 and len(got[1]) > 100


def test_chains_of_combinations_broadcast_no_runs(spark, monkeypatch):  # round 4, F3
    plans, real = [], collapse.stored
    monkeypatch.setattr(collapse, "stored", lambda df, name="table": plans.append((name, plan(df))) or real(df, name))
    names = spark.createDataFrame([(0, s) for s in range(5)], "sample long, sid long")
    ways = spark.createDataFrame([(0, 0, w, s, 1, s + 1, 0) for w in (0, 1) for s in range(3 + w)], "sample long, region int, way int, a long, a_end int, b long, b_end int")
    found = collapse.chains(names, ways, collapse.combinations(ways))
    assert [(r.choice, r.sid, r.place) for r in found.where("choice = 1").orderBy("sid").collect()] == [(1, s, s) for s in range(5)]
    doubled = [x for name, x in plans if name == "runs"][1:]
    assert len(doubled) == 3 and not any("Broadcast" in x for x in doubled)
