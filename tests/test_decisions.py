"""Paths, branches and junction decisions of forests against plain walks, node by node."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from curvespark.operators import decisions, graph, paths
from curvespark.operators.components import connected_components

CLOUD = "id long, p0 double, p1 double, p2 double"


def forest_of(spark, points, edges):
    cloud = spark.createDataFrame([(i, *map(float, p)) for i, p in points.items()], CLOUD)
    tree = spark.createDataFrame([(u, v, float(math.dist(points[u], points[v]))) for u, v in edges], "u long, v long, w double")
    components = connected_components(tree).withColumnRenamed("node", "id")
    return cloud, decisions.Forest(tree, components)


def random_forest(seed, n=160, parts=3):
    """Trees of random growth: mostly chains with twigs, points a little apart."""
    rng = random.Random(seed)
    points, edges = {}, []
    for part in range(parts):
        first = part * n
        points[first] = (part * 12.0, 0.0, 0.0)
        for k in range(1, n):
            i = first + k
            a = i - 1 if rng.random() < 0.8 else rng.randrange(first, i)
            points[i] = tuple(x + rng.uniform(-1.5, 1.8) for x in points[a])
            edges.append((min(a, i), max(a, i)))
    return points, edges


class Plain:
    def __init__(self, points, edges):
        self.p = {i: np.array(x, float) for i, x in points.items()}
        self.adj = defaultdict(set)
        for u, v in edges:
            self.adj[u].add(v)
            self.adj[v].add(u)

    def walk(self, start, *blocked):
        """{node: (hops, before)} from start, which is one hop away."""
        seen, front = {start: (1, None)}, [start]
        while front:
            nxt = []
            for x in front:
                for y in self.adj[x]:
                    if y not in seen and y not in blocked:
                        seen[y] = (seen[x][0] + 1, x)
                        nxt.append(y)
            front = nxt
        return seen

    def path(self, a, b):
        seen = self.walk(b)
        out = [a]
        while out[-1] != b:
            out.append(seen[out[-1]][1])
        return out

    def component(self, a):
        return set(self.walk(a))

    def far(self, a, b):
        return float(np.linalg.norm(self.p[a] - self.p[b]))


@pytest.fixture(scope="module")
def grown(spark):
    points, edges = random_forest(4)
    cloud, forest = forest_of(spark, points, edges)
    return Plain(points, edges), cloud, forest


def test_paths_and_common_ancestors(spark, grown):
    plain, _, forest = grown
    rng = random.Random(1)
    pairs = [(a, a) for a in (0, 5)] + [tuple(rng.choices(range(160), k=2)) for _ in range(60)] + [tuple(rng.choices(range(160, 320), k=2)) for _ in range(20)]
    pairs = sorted(set(pairs))
    got = defaultdict(dict)
    for r in paths.tree_paths(forest.nodes, forest.steps, spark.createDataFrame(pairs, "a long, b long")).collect():
        assert r.k not in got[r.a, r.b]
        got[r.a, r.b][r.k] = r.id
    assert set(got) == set(pairs)
    assert all([got[a, b][k] for k in range(len(got[a, b]))] == plain.path(a, b) for a, b in pairs)


@pytest.mark.parametrize("nearest", [False, True])
def test_branches_their_sizes_and_what_is_far_or_near(spark, grown, nearest):
    plain, _, forest = grown
    marked = [i for i in plain.p if i % 7 == 0] if nearest else list(plain.p)
    reach = paths.reaches(forest.nodes, forest.steps, spark.createDataFrame([(i,) for i in marked], "id long") if nearest else None, nearest)
    rows = paths.branch_ends(forest.sizes, reach).collect()
    assert len(rows) == 2 * sum(len(x) for x in plain.adj.values()) // 2
    for r in rows:
        seen = plain.walk(r.branch, r.junction)
        assert r.size == len(seen)
        found = [((h if nearest else -h), i) for i, (h, _) in seen.items() if i in set(marked)]
        assert (r.far, r.end) == ((abs(min(found)[0]), min(found)[1]) if found else (None, None))


def decide_plain(plain, junctions, reach, probe, long_arm, stem_hops, tip_reach):
    out, tips = {}, {}
    for i in plain.adj:
        c = min(plain.component(i))
        if c not in tips:
            nodes = plain.component(i)
            best = max(((len(plain.path(a, b)), a, b) for a in (c,) for b in nodes), key=lambda x: (x[0], -x[2]))
            one = best[2]
            two = max(((len(plain.path(one, b)), b) for b in nodes), key=lambda x: (x[0], -x[1]))[1]
            tips[c] = (one, two)
    for j in junctions:
        ne = sorted(plain.adj[j])
        walks = {b: plain.walk(b, j) for b in ne}
        v = {b: min((round(abs(plain.far(i, j) - probe), 9), i) for i in walks[b])[1] for b in ne}
        if len(ne) != 3 or min(plain.far(v[b], j) for b in ne) <= 1e-9:
            out[j] = ("skip", None, None)
            continue
        unit = {b: (plain.p[v[b]] - plain.p[j]) / plain.far(v[b], j) for b in ne}
        left = {b: 180 - math.degrees(math.acos(max(-1, min(1, float(np.prod([1]) * np.dot(*[unit[x] for x in ne if x != b])))))) for b in ne}
        count = dict.fromkeys(ne, 0)
        for i in plain.p:
            r = plain.p[i] - plain.p[j]
            if 1e-12 < r @ r <= probe * probe:
                count[max(ne, key=lambda b: (float(r @ unit[b]), -b))] += 1
        share = lambda x: {b: x[b] / sum(x.values()) if sum(x.values()) > 1e-9 else 1 / 3 for b in ne}  # noqa: B023, E731
        a, d = share(left), share(count)
        stem = max(ne, key=lambda b: (round(0.4 * a[b] + 0.6 * d[b], 9), -b))
        short, long = sorted((b for b in ne if b != stem), key=lambda b: (len(walks[b]), b))
        deep, tip = min((-h, i) for i, (h, _) in walks[short].items())
        if -deep > long_arm:
            ahead = sorted((h, i) for i, (h, _) in walks[stem].items() if i in junctions and h <= stem_hops)
            if ahead:
                out[j] = ("separate", None, ahead[0][1])
                continue
            own = min(plain.component(j))
            loose = [t for c, ts in tips.items() if c != own for t in ts]
            t = min(loose, key=lambda t: (round(plain.far(t, j) ** 2, 9), t))
            near = [(plain.far(t, i), i) for i, (h, _) in walks[stem].items() if h <= stem_hops + 1]
            out[j] = ("search", None, t) if min(near)[0] <= tip_reach else ("skip", None, None)
            continue
        touch = [(round(plain.far(i, tip) ** 2, 9), i) for i in walks[long] if i != tip and plain.far(i, tip) <= reach]
        if not touch:
            out[j] = ("cut", tip, None)
            continue
        y = min(touch)[1]
        loop = set(plain.path(j, tip)) | set(plain.path(y, j))
        off = [(-min(10_000, len(plain.walk(x, u))), u, x) for u in loop - {j} for x in plain.adj[u] if x not in loop and len(plain.walk(x, u)) >= 3]
        out[j] = ("loop", tip, min(off)[1]) if off else ("skip", tip, None)
    return out


@pytest.mark.parametrize(("long_arm", "stem_hops", "tip_reach"), [(1000, 1000, 50.0), (8, 4, 60.0)])
def test_decisions(spark, grown, long_arm, stem_hops, tip_reach):
    plain, cloud, forest = grown
    junctions = forest.real_junctions(2)
    want = [i for i in plain.adj if len(plain.adj[i]) > 2 and min(len(plain.walk(b, i)) for b in plain.adj[i]) > 2]
    assert sorted(r.id for r in junctions.collect()) == sorted(want)
    got = {r.junction: (r.action, r.next) for r in decisions.decide(forest, junctions, cloud, 2.0, 5.0, long_arm, stem_hops, tip_reach).collect()}
    expected = decide_plain(plain, want, 2.0, 5.0, long_arm, stem_hops, tip_reach)
    assert got == {j: (a, n) for j, (a, _, n) in expected.items()}
    kinds = {a for a, _ in got.values()}
    assert {"cut", "loop"} <= kinds if long_arm == 1000 else "separate" in kinds or "search" in kinds


def test_a_loop_becomes_its_centreline(spark):
    """A stem, a long and a short arm that come together again, and a tail where they do."""
    points, edges = {}, []
    chain = lambda ids: edges.extend(zip(ids, ids[1:], strict=False))
    for k in range(30):
        points[k] = (-30.0 + k, 0, 0)
    points[30] = (0, 0, 0)
    for k in range(1, 13):
        points[30 + k] = (k, 3 * math.sin(math.pi * k / 13), 0)  # the smaller arm
        points[60 + k] = (k, -3 * math.sin(math.pi * k / 13), 0)
    for k in range(25):
        points[80 + k] = (13.0 + k, 0, 0)
    chain([*range(31), *range(31, 43)])
    edges.append((30, 61))
    chain([*range(61, 73), *range(80, 105)])
    cloud, forest = forest_of(spark, points, edges)
    junctions = spark.createDataFrame([(30,)], "id long")
    table = decisions.decide(forest, junctions, cloud, 4.0, 5.0)
    assert [(r.action, r.short, r.tip) for r in table.collect()] == [("loop", 31, 42)]
    loops = decisions.loop_nodes(forest, table)
    order = [r.id for r in loops.orderBy("k").collect()]
    assert order[0] == order[-1] == 30 and order[1:13] == list(range(31, 43)) and set(order) <= set(points)
    turns = decisions.turning_points(forest, loops)
    (turn,) = turns.collect()
    assert turn.other == order[13] and turn.size == 104 - turn.first + 1
    tree, new = decisions.apply_loops(forest, loops, turns, cloud, 1000)
    added = {r.id: r for r in new.collect()}
    assert added and min(added) == 1000 and max(abs(r.p1) for r in added.values()) < 0.5
    edges_now = {tuple(sorted((r.u, r.v))) for r in tree.collect()}
    touched = {x for e in edges_now for x in e}
    assert not touched & (set(order) - {30, turn.other}) and (29, 30) in edges_now and (turn.other, turn.first) in edges_now
    walked = Plain(dict.fromkeys(touched, (0, 0, 0)), edges_now).path(0, 104)
    assert walked[:31] == list(range(31)) and set(added) <= set(walked)


def crossing(spark):
    """``>-----<``: two arms, a trunk, two arms; the trunk's points lie alternately a little up and down."""
    points, edges = {}, []
    for k in range(41):
        points[k] = (float(k), 0.4 if k % 2 else -0.4, 0.0)
    for a, (x, sx, sy) in enumerate([(0, -1, 1), (0, -1, -1), (40, 1, 1), (40, 1, -1)]):
        for k in range(1, 61):
            points[100 * (a + 1) + k] = (x + sx * k * 0.9, sy * k * 0.5, 0.0)
    edges += [(k, k + 1) for k in range(40)]
    for a, j in enumerate((0, 0, 40, 40)):
        ids = [j, *(100 * (a + 1) + k for k in range(1, 61))]
        edges += [(min(e), max(e)) for e in zip(ids, ids[1:], strict=False)]
    return points, edges, *forest_of(spark, points, edges)


def test_crossings_come_apart(spark):
    points, _, cloud, forest = crossing(spark)
    junctions = forest.real_junctions(20)
    assert sorted(r.id for r in junctions.collect()) == [0, 40]
    table = decisions.decide(forest, junctions, cloud, long_arm=50)
    assert {r.junction: (r.action, r.next) for r in table.collect()} == {0: ("separate", 40), 40: ("separate", 0)}
    found = decisions.crossings_to_separate(forest, table)
    rows = found.collect()
    assert [r.id for r in sorted((r for r in rows if r.part == 0), key=lambda r: r.place)] == list(range(41))
    assert {r.arm: sorted(x.id for x in rows if x.arm == r.arm) for r in rows if r.part} == {a: list(range(100 * (a + 1) + 1, 100 * (a + 1) + 61)) for a in range(4)}
    ways = decisions.candidates(forest, found, cloud)
    got = {(r.candidate, r.id): r for r in ways.collect()}
    assert len(got) == 4 * len(points)
    for (c, i), r in got.items():
        if i <= 40:
            assert (r.strand == 0) == (points[i][1] > 0) and r.p1 == pytest.approx(points[i][1] + (15 if r.strand == 0 else -15))
        else:
            arm, j = i // 100 - 1, 0 if i < 300 else 40
            up = (arm % 2 == 0) != ((c >= 2) if arm < 2 else (c % 2 == 1))
            u = min(1, math.dist(points[i], points[j]) / 75)
            assert (r.strand == 0) == up and r.p1 == pytest.approx(points[i][1] + (15 if up else -15) * (1 - 3 * u**2 + 2 * u**3))
    tree, moved = decisions.accept(forest, ways.where("candidate = 0"), 4.0)
    left = Plain(points, [(r.u, r.v) for r in tree.collect()])
    assert left.component(101) == {i for (c, i), r in got.items() if c == 0 and r.strand == 0} and not left.component(101) & left.component(201)
    assert moved.count() == len(points)


def test_crossings_are_deleted_and_paired(spark):
    points, edges, cloud, forest = crossing(spark)
    table = spark.createDataFrame([(0, "separate", 40)], "junction long, action string, next long")
    found = decisions.crossings_to_separate(forest, table)
    tree, breaks = decisions.delete_crossings(forest, found, cloud, hops=50)
    rows = {(r.side, r.arm): (r.id, r.p0) for r in breaks.collect()}
    assert rows == {(a // 2, a): (100 * (a + 1) + 51, points[100 * (a + 1) + 51][0]) for a in range(4)}
    assert {(r.u, r.v) for r in tree.collect()} == {e for e in edges if min(e) >= 100 and min(x % 100 for x in e) > 50}
    assert sorted((r.way, r.a, r.b) for r in decisions.pairings(breaks).collect()) == [(0, 151, 351), (0, 251, 451), (1, 151, 451), (1, 251, 351)]


def test_midpoint_cuts(spark, grown):
    plain, cloud, forest = grown
    junctions = sorted(i for i in plain.adj if len(plain.adj[i]) > 2)
    before = [i for k, i in enumerate(junctions) if k % 3]
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r.junction: (r.target, r.u, r.v) for r in decisions.midpoint_cuts(forest, frame(before), frame(junctions), cloud, 6.0).collect()}
    near = {}
    for g in sorted(set(junctions) - set(before)):
        d, t = min((round(plain.far(g, t) ** 2, 9), t) for t in before)
        if d <= 36:
            near.setdefault(t, []).append((d, g))
    want = {}
    for t, each in near.items():
        g = min(each)[1]
        if t in plain.component(g):
            way = plain.path(g, t)
            steps = np.cumsum([plain.far(a, b) for a, b in zip(way, way[1:], strict=False)])
            e = int(np.argmax(steps >= steps[-1] / 2))
            want[g] = (t, way[e], way[e + 1])
    assert got == want and len(got) > 3
    crossing_one = spark.createDataFrame([(next(iter(got)), "separate")], "junction long, action string")
    assert decisions.midpoint_cuts(forest, frame(before), frame(junctions), cloud, 6.0, crossing_one).count() == 0


def test_deletions_at_a_node(spark, grown):
    plain, cloud, forest = grown
    picks = [0, 40, 77, 159, 200, 319]
    frame = spark.createDataFrame([(i,) for i in picks], "id long")
    got, want = defaultdict(set), {}
    for r in decisions.walked_to(forest, frame, cloud, 5.0).collect():
        got[r.pick].add(r.id)
    for i in picks:
        length, front = {i: 0.0}, [i]
        for a in front:
            for b in plain.adj[a]:
                if b not in length and length[a] + plain.far(a, b) <= 5.0:
                    length[b] = length[a] + plain.far(a, b)
                    front.append(b)
        want[i] = set(length)
    assert got == want and max(map(len, want.values())) > 2
    got = defaultdict(set)
    for r in decisions.smaller_sides(forest, frame).collect():
        got[r.pick].add(r.id)
    for i in picks:
        _, first = min((len(plain.walk(b, i)), b) for b in plain.adj[i])
        assert got[i] == set(plain.walk(first, i))


def test_search_links_attach_short_of_the_nearest_node(spark):
    """A long-armed junction whose stem ends near the tip of another tree."""
    points, edges = {}, []
    for k in range(41):
        points[k] = (float(k), 0.0, 0.0)
    for a, s in enumerate((1, -1)):
        for k in range(1, 31):
            points[100 * (a + 1) + k] = (-0.8 * k, s * 0.6 * k, 0.0)
        ids = [0, *(100 * (a + 1) + k for k in range(1, 31))]
        edges += list(zip(ids, ids[1:], strict=False))
    edges += [(k, k + 1) for k in range(40)]
    for k in range(20):
        points[500 + k] = (60.0 + k, 1.0, 0.0)
    edges += [(500 + k, 501 + k) for k in range(19)]
    cloud, forest = forest_of(spark, points, edges)
    junctions = forest.real_junctions(20)
    for reach, action in ((50.0, "search"), (10.0, "skip")):
        (row,) = decisions.decide(forest, junctions, cloud, long_arm=20, tip_reach=reach).collect()
        assert row.action == action
    table = decisions.decide(forest, junctions, cloud, long_arm=20)
    links = decisions.search_links(forest, table, cloud)
    (link,) = links.collect()
    assert (link.junction, link.tip, link.near, link.attach, link.hops) == (0, 500, 40, 26, 40) and link.distance == pytest.approx(math.dist((60, 1), (26, 0)))
    bridge = decisions.bridges(forest, links, cloud).orderBy("k").collect()
    assert len(bridge) == round(link.distance / 0.1) - 1
    line = [(60, 1, 0), *((r.p0, r.p1, r.p2) for r in bridge), (26, 0, 0)]
    assert max(math.dist(a, b) for a, b in zip(line, line[1:], strict=False)) < 0.3


def test_forest_and_components_together(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60), float(rng.randrange(5))) for _ in range(70)] + [(3, 3, 0.0), (100, 101, 1.0)]
    tree, components = graph.spanning_forest_of_components(spark.createDataFrame(edges, "u long, v long, w double"))
    plain = Plain({}, [(u, v) for u, v, _ in edges if u != v])
    named = {r.id: r.component for r in components.collect()}
    assert set(named) == set(plain.adj) and all((named[a] == named[b]) == (b in plain.component(a)) for a in named for b in named)
    assert all(named[c] == c for c in named.values())
    left = Plain({}, [(r.u, r.v) for r in tree.collect()])
    assert all(left.component(a) == plain.component(a) for a in named) and sum(len(x) for x in left.adj.values()) == 2 * (len(named) - len(set(named.values())))
    assert graph.spanning_forest_of_components(spark.createDataFrame([], "u long, v long, w double"))[1].count() == 0
