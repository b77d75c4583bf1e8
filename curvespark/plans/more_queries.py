"""Queries of junctions, shapes, records and chains of operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvespark.operators import cloud as C
from curvespark.operators import curves as V
from curvespark.operators import analysis, assembly, collapse, decisions, geometry, graph, junctions, records, shapes, states, walks
from curvespark.operators import paths
from curvespark.plans import projections as P
from curvespark.plans.lineage import stored
from curvespark.plans.queries import CLOUD_EV, CURVE, _query, _rounded, pairs_sql

# --- junctions of the spanning forest ---------------------------------------------

FAR, HOPS = 5.0, 6
FOREST = f"""WITH RECURSIVE {CLOUD_EV}, {pairs_sql('cloud', FAR)}, e AS (SELECT row_number() OVER (ORDER BY d2, a_id, b_id) AS n, a_id AS u, b_id AS v, sqrt(d2) AS w FROM pairs WHERE a_id < b_id), both_ AS (SELECT n, u, v FROM e UNION ALL SELECT n, v, u FROM e),
reach AS (SELECT n, v AS goal, u AS at_ FROM e UNION SELECT r.n, r.goal, b.v FROM reach r JOIN both_ b ON b.u = r.at_ AND b.n < r.n WHERE r.at_ <> r.goal), tree AS (SELECT u, v, w FROM e WHERE n NOT IN (SELECT n FROM reach WHERE at_ = goal)),
arcs AS (SELECT u AS a, v AS b FROM tree UNION ALL SELECT v, u FROM tree), hub AS (SELECT a AS id FROM arcs GROUP BY a HAVING count(*) >= 3),
br AS (SELECT id AS junction, b AS branch, b AS node, 1 AS hops, id AS prev FROM hub JOIN arcs ON a = id UNION ALL SELECT junction, branch, arcs.b, hops + 1, node FROM br JOIN arcs ON arcs.a = node AND arcs.b <> prev WHERE hops < {HOPS}),
size AS (SELECT junction, branch, count(*) AS size, max(hops) AS depth FROM br GROUP BY 1, 2)"""


def _forest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cloud = P.cloud_from_events(spark, d)
    return cloud, graph.spanning_forest(graph.proximity_edges(cloud, FAR))


def _branches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cloud, tree = _forest(spark, d)
    return cloud, tree, junctions.branches(tree, junctions.hubs(tree), HOPS)


@_query(f"{FOREST} SELECT junction, branch, node, CAST(hops AS INTEGER) AS hops FROM br")
def branch_members(spark: SparkSession, d: str) -> DataFrame:
    return _branches(spark, d)[2]


@_query(f"{FOREST} SELECT junction AS id FROM (SELECT junction, branch, count(*) AS size FROM br WHERE hops <= 2 GROUP BY 1, 2) GROUP BY junction HAVING min(size) > 1")
def real_junctions(spark: SparkSession, d: str) -> DataFrame:
    return junctions.real_junctions(_forest(spark, d)[1], 1)


@_query(f"{FOREST} SELECT junction, CAST(row_number() OVER (PARTITION BY junction ORDER BY size DESC, branch) AS INTEGER) AS place, branch, size FROM size QUALIFY place <= 5")
def largest_branches(spark: SparkSession, d: str) -> DataFrame:
    return junctions.largest_branches(_branches(spark, d)[2], 5)


@_query(f"{FOREST} SELECT junction, branch, node AS next, CAST(hops AS INTEGER) AS hops FROM br SEMI JOIN hub ON id = node QUALIFY row_number() OVER (PARTITION BY junction, branch ORDER BY br.hops, node) = 1")
def next_junctions(spark: SparkSession, d: str) -> DataFrame:
    _, tree, found = _branches(spark, d)
    return junctions.next_junctions(found, junctions.hubs(tree))


PROBE = 8.0
STEMS = f"""{FOREST}, pv AS (SELECT junction, branch, node, hops, {', '.join(f'q.p{k} - j.p{k} AS v{k}' for k in range(3))}, sqrt({' + '.join(f'(q.p{k} - j.p{k}) ^ 2' for k in range(3))}) AS far FROM br JOIN cloud q ON q.id = node JOIN cloud j ON j.id = junction),
vec AS (SELECT * FROM pv QUALIFY row_number() OVER (PARTITION BY junction, branch ORDER BY abs(far - {PROBE}), hops, node) = 1),
bl AS (SELECT j.id AS junction, q.id AS id, {', '.join(f'q.p{k} - j.p{k} AS r{k}' for k in range(3))} FROM (SELECT * FROM cloud SEMI JOIN vec ON id = junction) j JOIN cloud q ON q.p0 BETWEEN j.p0 - {PROBE} AND j.p0 + {PROBE} AND {' + '.join(f'(q.p{k} - j.p{k}) ^ 2' for k in range(3))} BETWEEN 1e-12 AND {PROBE * PROBE}),
asg AS (SELECT junction, id, branch FROM bl JOIN vec USING (junction) WHERE far > 1e-9 QUALIFY row_number() OVER (PARTITION BY junction, id ORDER BY (r0 * v0 + r1 * v1 + r2 * v2) / far DESC, branch) = 1),
cnt AS (SELECT junction, branch, count(id) AS points FROM vec LEFT JOIN asg USING (junction, branch) GROUP BY 1, 2),
un AS (SELECT junction, branch, points, v0 / far AS u0, v1 / far AS u1, v2 / far AS u2 FROM vec JOIN cnt USING (junction, branch) QUALIFY count(*) OVER (PARTITION BY junction) = 3 AND min(far) OVER (PARTITION BY junction) > 1e-9),
pr AS (SELECT a.junction, a.branch AS ba, b.branch AS bb, 180 - degrees(acos(greatest(-1, least(1, a.u0 * b.u0 + a.u1 * b.u1 + a.u2 * b.u2)))) AS left_over FROM un a JOIN un b ON a.junction = b.junction AND a.branch < b.branch),
sc AS (SELECT un.junction, branch, CASE WHEN sum(left_over) OVER j > 1e-9 THEN left_over / sum(left_over) OVER j ELSE 1.0 / 3 END AS angle, CASE WHEN sum(points) OVER j > 0 THEN points / sum(points) OVER j ELSE 1.0 / 3 END AS density FROM un JOIN pr ON un.junction = pr.junction AND branch <> ba AND branch <> bb WINDOW j AS (PARTITION BY un.junction)),
stem AS (SELECT *, 0.4 * angle + 0.6 * density AS score, row_number() OVER (PARTITION BY junction ORDER BY round(0.4 * angle + 0.6 * density, 9) DESC, branch) = 1 AS is_stem FROM sc)"""


def _stems(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The places of all branches, the branches, and the stems."""
    cloud, _, found = _branches(spark, d)
    at = junctions.places(found, cloud)
    vectors = stored(junctions.probe_vectors(found, at, PROBE), "vectors")
    return at, found, junctions.stems(vectors, junctions.sector_counts(vectors, cloud, PROBE, at))


@_query(f"{STEMS} SELECT junction, branch, node, round(far, 6) AS far, {', '.join(f'round(v{k}, 6) + 0.0 AS v{k}' for k in range(3))} FROM vec")
def probe_vectors(spark: SparkSession, d: str) -> DataFrame:
    cloud, _, found = _branches(spark, d)
    return _rounded(junctions.probe_vectors(found, cloud, PROBE))


@_query(f"{STEMS} SELECT junction, branch, points FROM cnt")
def sector_counts(spark: SparkSession, d: str) -> DataFrame:
    cloud, _, found = _branches(spark, d)
    at = junctions.places(found, cloud)
    return junctions.sector_counts(junctions.probe_vectors(found, at, PROBE), cloud, PROBE, at)


@_query(f"{STEMS} SELECT junction, branch, round(angle, 6) AS angle, round(density, 6) AS density, round(score, 6) AS score, is_stem FROM stem")
def stem_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_stems(spark, d)[2])


@_query(f"""{STEMS}, arm AS (SELECT junction, branch, count(*) AS size, arg_min(node, (-hops, node)) AS tip FROM br JOIN stem USING (junction, branch) WHERE NOT is_stem GROUP BY 1, 2),
sm AS (SELECT * FROM arm QUALIFY row_number() OVER (PARTITION BY junction ORDER BY size, branch) = 1),
oth AS (SELECT br.junction, br.branch, node FROM br JOIN stem USING (junction, branch) WHERE NOT is_stem),
hit AS (SELECT DISTINCT sm.junction FROM sm JOIN oth ON sm.junction = oth.junction AND oth.branch <> sm.branch JOIN cloud t ON t.id = sm.tip JOIN cloud q ON q.id = oth.node WHERE {' + '.join(f'(t.p{k} - q.p{k}) ^ 2' for k in range(3))} <= 16)
SELECT junction, branch, tip FROM sm WHERE junction NOT IN (SELECT junction FROM hit)""")
def short_arms(spark: SparkSession, d: str) -> DataFrame:
    at, found, stem = _stems(spark, d)
    return junctions.short_arms(found, stem, at, 4.0)


@_query(f"""{FOREST}, gone AS (SELECT node AS id FROM br WHERE hops <= 2 UNION SELECT id FROM hub) SELECT u, v, round(w, 6) + 0.0 AS w FROM tree WHERE u NOT IN (SELECT id FROM gone) AND v NOT IN (SELECT id FROM gone)""")
def cut_tangles(spark: SparkSession, d: str) -> DataFrame:
    _, tree = _forest(spark, d)
    return _rounded(junctions.cut_tangles(tree, junctions.hubs(tree), 2)[0])


@_query(f"""{FOREST}, gone AS (SELECT node AS id FROM br WHERE hops <= 2 UNION SELECT id FROM hub) SELECT junction, branch, node FROM br WHERE hops = 3 AND node NOT IN (SELECT id FROM gone)""")
def tangle_breaks(spark: SparkSession, d: str) -> DataFrame:
    _, tree = _forest(spark, d)
    return junctions.cut_tangles(tree, junctions.hubs(tree), 2)[1]


_MOVED = f"moved AS (SELECT id, p0 + CASE WHEN id % 7 = 0 THEN 0.5 ELSE 0 END AS p0, p1, p2, d0, d1, d2, energy, linearity FROM cloud WHERE id % 11 <> 3)"


def _moved(spark: SparkSession, d: str) -> DataFrame:
    cloud = P.cloud_from_events(spark, d)
    overrides = cloud.where("id % 7 = 0").select("id", (F.col("p0") + 0.5).alias("p0"), "p1", "p2")
    return junctions.overridden(cloud, overrides, cloud.where("id % 11 = 3"))


@_query(f"WITH {CLOUD_EV}, {_MOVED} SELECT id, round(p0, 6) AS p0, p1, p2 FROM moved")
def overridden_cloud(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_moved(spark, d).select("id", "p0", "p1", "p2"))


@_query(f"""WITH RECURSIVE {CLOUD_EV}, {_MOVED}, {pairs_sql('moved', 3.0)}, e AS (SELECT row_number() OVER (ORDER BY d2, a_id, b_id) AS n, a_id AS u, b_id AS v, sqrt(d2) AS w FROM pairs WHERE a_id < b_id), both_ AS (SELECT n, u, v FROM e UNION ALL SELECT n, v, u FROM e),
reach AS (SELECT n, v AS goal, u AS at_ FROM e UNION SELECT r.n, r.goal, b.v FROM reach r JOIN both_ b ON b.u = r.at_ AND b.n < r.n WHERE r.at_ <> r.goal) SELECT u, v, round(w, 6) + 0.0 AS w FROM e WHERE n NOT IN (SELECT n FROM reach WHERE at_ = goal)""")
def forest_of_moved(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.spanning_forest(graph.proximity_edges(_moved(spark, d), 3.0)))


@_query(f"WITH {CLOUD_EV}, c AS (SELECT * FROM cloud WHERE id % 50 = 0) SELECT c.id AS centre, count(*) AS points, round(max(sqrt({' + '.join(f'(c.p{k} - q.p{k}) ^ 2' for k in range(3))})), 6) AS far FROM c JOIN cloud q ON q.p0 BETWEEN c.p0 - 10 AND c.p0 + 10 AND {' + '.join(f'(c.p{k} - q.p{k}) ^ 2' for k in range(3))} <= 100 GROUP BY 1")
def ball_members(spark: SparkSession, d: str) -> DataFrame:
    cloud = P.cloud_from_events(spark, d)
    near = junctions.ball(C.stride(cloud, 50), cloud, 10.0)
    return _rounded(near.groupBy("centre").agg(F.count("*").alias("points"), F.sqrt(F.max("d2")).alias("far")))


@_query(f"""WITH {CURVE}, {CLOUD_EV}, en AS (SELECT sid, 0 AS end_, {', '.join(f'arg_min(p{k}, k) AS p{k}' for k in range(3))} FROM curve GROUP BY sid HAVING count(*) > 1 UNION ALL SELECT sid, 1, {', '.join(f'arg_max(p{k}, k)' for k in range(3))} FROM curve GROUP BY sid HAVING count(*) > 1),
d AS (SELECT id, sid, end_, {' + '.join(f'(c.p{k} - en.p{k}) ^ 2' for k in range(3))} AS d2 FROM cloud c JOIN en ON c.p0 BETWEEN en.p0 - 40 AND en.p0 + 40)
SELECT id, sid, CAST(end_ AS INTEGER) AS "end", round(sqrt(d2), 6) AS distance FROM d WHERE d2 <= 1600 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, sid, end_) = 1""")
def nearest_ends(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(junctions.nearest_ends(P.cloud_from_events(spark, d), P.curves_from_events(spark, d), 40.0))


@_query(f"WITH {CLOUD_EV} SELECT id, CASE WHEN CAST(p2 AS BIGINT) = 3 THEN -1 ELSE CAST(p2 AS BIGINT) END AS label FROM cloud")
def without_curve_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = P.cloud_from_events(spark, d).select("id", F.col("p2").cast("long").alias("label"))
    return junctions.without_curve(P.curves_from_events(spark, d), labels, 3)[1]


# --- shapes -----------------------------------------------------------------------


@_query(f"WITH {CURVE}, n AS (SELECT *, count(*) OVER (PARTITION BY sid) AS n FROM curve), b AS (SELECT *, unnest(range(0, 4)) AS band FROM n) SELECT sid, CAST(band AS INTEGER) AS band, count(*) AS n, min(k) AS first_k, max(k) AS last_k FROM b WHERE k >= round_even(band * n / 4, 0) AND k < round_even((band + 1) * n / 4, 0) + 1 GROUP BY 1, 2")
def curve_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = shapes.bands(P.curves_from_events(spark, d), 4)
    return rows.groupBy("sid", "band").agg(F.count("*").alias("n"), F.min("k").alias("first_k"), F.max("k").alias("last_k"))


@_query(f"WITH {CURVE}, m AS (SELECT sid, quantile_cont(p1, 0.5) AS m FROM curve GROUP BY sid) SELECT sid, k, CAST(k % 2 AS INTEGER) AS strand, p1 > m AS upper FROM curve JOIN m USING (sid)")
def trunk_strands(spark: SparkSession, d: str) -> DataFrame:
    return shapes.strands(P.curves_from_events(spark, d), "p1")


@_query(f"""WITH {CURVE}, pt AS (SELECT CAST(p2 * 4 AS BIGINT) AS g, p0, p1, p2 FROM (SELECT p0, p1, p2 FROM curve)), st AS (SELECT g, count(*) AS n, {', '.join(f'covar_pop(p{i}, p{j}) AS {c}' for i, j, c in ((0, 0, 'xx'), (0, 1, 'xy'), (0, 2, 'xz'), (1, 1, 'yy'), (1, 2, 'yz'), (2, 2, 'zz')))} FROM pt GROUP BY g),
q AS (SELECT *, (xx + yy + zz) / 3 AS m FROM st), p AS (SELECT *, sqrt(((xx - m) ^ 2 + (yy - m) ^ 2 + (zz - m) ^ 2 + 2 * (xy ^ 2 + xz ^ 2 + yz ^ 2)) / 6) AS p FROM q),
r AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1, least(1, ((xx - m) * ((yy - m) * (zz - m) - yz ^ 2) - xy * (xy * (zz - m) - yz * xz) + xz * (xy * yz - (yy - m) * xz)) / (2 * p ^ 3)))) / 3 ELSE 0 END AS f FROM p)
SELECT g, n, round(m + 2 * p * cos(f + 4 * pi() / 3), 2) + 0.0 AS l1, round(m + 2 * p * cos(f), 2) + 0.0 AS l2 FROM r""")
def principal_axes(spark: SparkSession, d: str) -> DataFrame:
    points = P.curves_from_events(spark, d).select(F.bround(F.col("p2") * 4).cast("long").alias("g"), "p0", "p1", "p2")
    return _rounded(shapes.principal_axes(points, "g").select("g", "n", "l1", "l2"), 2)


_CHORD = f"""{CURVE}, ch AS (SELECT sid AS id, {', '.join(f'arg_min(p{i}, k) AS a{i}, arg_max(p{i}, k) AS b{i}' for i in range(2))}, cos(sid) AS s0, sin(sid) AS s1, cos(2 * sid) AS t0, sin(2 * sid) AS t1 FROM curve GROUP BY sid),
ab AS (SELECT *, b0 - a0 AS dx, b1 - a1 AS dy, sqrt((b0 - a0) ^ 2 + (b1 - a1) ^ 2) AS chord, -s0 * t1 + t0 * s1 AS det FROM ch), al AS (SELECT *, (-dx * t1 + t0 * dy) / nullif(det, 0) AS al, (s0 * dy - s1 * dx) / nullif(det, 0) AS bk FROM ab),
hint AS (SELECT *, {', '.join(f'CASE WHEN abs(det) > 1e-6 AND abs(al) < 4 * chord AND abs(bk) < 4 * chord THEN a{i} + al * s{i} ELSE (a{i} + greatest(0.4 * chord, 30) * s{i} + b{i} + greatest(0.4 * chord, 30) * t{i}) / 2 END AS c{i}' for i in range(2))} FROM al)"""


@_query(f"WITH {_CHORD} SELECT id, CAST(k AS INTEGER) AS k, round((1 - u) ^ 2 * a0 + 2 * (1 - u) * u * c0 + u ^ 2 * b0, 4) + 0.0 AS x, round((1 - u) ^ 2 * a1 + 2 * (1 - u) * u * c1 + u ^ 2 * b1, 4) + 0.0 AS y FROM (SELECT *, k / 9.0 AS u FROM hint, (SELECT unnest(range(0, 10)) AS k))")
def hinted_bezier(spark: SparkSession, d: str) -> DataFrame:
    ends = P.curves_from_events(spark, d).groupBy(F.col("sid").alias("id")).agg(*(f(f"p{i}", "k").alias(f"{n}{i}") for i in range(2) for f, n in ((F.min_by, "a"), (F.max_by, "b"))))
    chords = ends.withColumns({"s0": F.cos("id"), "s1": F.sin("id"), "t0": F.cos(2 * F.col("id")), "t1": F.sin(2 * F.col("id"))})
    return _rounded(shapes.quadratic_bezier(shapes.control_hints(chords), 10), 4)


_DOT = lambda a, b: " + ".join(f"{a.format(k)} * {b.format(k)}" for k in range(3))
_CL = lambda x: f"least(greatest({x}, 0), 1)"


@_query(f"""WITH {CURVE}, sg AS (SELECT *, {', '.join(f'lead(p{i}) OVER o AS q{i}' for i in range(3))} FROM curve WINDOW o AS (PARTITION BY sid ORDER BY k)), pr AS (SELECT a.sid, a.k, {', '.join(f'a.p{i}, a.q{i} - a.p{i} AS x{i}, b.q{i} - b.p{i} AS y{i}, a.p{i} - b.p{i} AS r{i}' for i in range(3))} FROM sg a JOIN sg b ON b.sid = a.sid + 1 AND a.k = b.k WHERE a.q0 IS NOT NULL AND b.q0 IS NOT NULL),
dt AS (SELECT *, {_DOT('x{}', 'x{}')} AS a, {_DOT('y{}', 'y{}')} AS e, {_DOT('y{}', 'r{}')} AS f, {_DOT('x{}', 'r{}')} AS c, {_DOT('x{}', 'y{}')} AS b FROM pr), fr AS (SELECT *, CASE WHEN a * e - b * b > 1e-12 THEN {_CL('(b * f - c * e) / (a * e - b * b)')} ELSE 0 END AS fr FROM dt), ov AS (SELECT *, (b * fr + f) / nullif(e, 0) AS ov FROM fr),
st AS (SELECT *, CASE WHEN a < 1e-12 THEN 0 WHEN e < 1e-12 OR ov < 0 THEN {_CL('-c / a')} WHEN ov > 1 THEN {_CL('(b - c) / a')} ELSE fr END AS s, CASE WHEN a < 1e-12 AND e < 1e-12 THEN 0 WHEN a < 1e-12 THEN {_CL('f / e')} WHEN e < 1e-12 THEN 0 ELSE {_CL('ov')} END AS t FROM ov)
SELECT sid, k, round(s, 5) + 0.0 AS s, round(t, 5) + 0.0 AS t, round(sqrt({' + '.join(f'(r{i} + s * x{i} - t * y{i}) ^ 2' for i in range(3))}), 5) AS distance FROM st""")
def segment_distances(spark: SparkSession, d: str) -> DataFrame:
    segments = V._segments(P.curves_from_events(spark, d)).select("sid", "k", *(f"{c}{i}" for c in "pq" for i in range(3)))
    other = segments.select((F.col("sid") - 1).alias("sid"), "k", *(F.col(f"{c}{i}").alias(f"{n}{i}") for c, n in (("p", "r"), ("q", "w")) for i in range(3)))
    return _rounded(shapes.nearest_on_segments(segments.join(other, ["sid", "k"])).select("sid", "k", "s", "t", "distance"), 5)


@_query("""WITH z AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS r, CAST(p_partkey % 7 AS DOUBLE) AS z FROM part), v AS (SELECT id, r, z, i, j, acos(greatest(-1, least(1, (z - (z - r / 4)) / r))) * i / 3 AS up, 2 * pi() * j / 6 AS ab FROM z, (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 6)) AS j))
SELECT id, CAST(i * 6 + j AS INTEGER) AS vertex, round(r * sin(up) * cos(ab), 5) + 0.0 AS x, round(r * sin(up) * sin(ab), 5) + 0.0 AS y, round(z - r * cos(up), 5) + 0.0 AS z FROM v""")
def bowl_meshes(spark: SparkSession, d: str) -> DataFrame:
    part = P.read(spark, d, "part")
    r, z = F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double")
    sizes = part.select(F.col("p_partkey").alias("id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), z.alias("z"), r.alias("radius"), (z - r / 4).alias("rim"))
    return _rounded(shapes.bowls(sizes, 4, 6), 5)


@_query(f"""WITH RECURSIVE {CURVE}, t AS (SELECT sid, e AS end_, CASE WHEN e = 0 THEN k ELSE -k END AS o, p0, p1, p2 FROM curve, (VALUES (0), (1)) v(e)),
c AS (SELECT *, row_number() OVER w AS i, coalesce(sqrt({' + '.join(f'(p{i} - lag(p{i}) OVER w) * (p{i} - lag(p{i}) OVER w)' for i in range(3))}), 0) AS chord FROM t WINDOW w AS (PARTITION BY sid, end_ ORDER BY o)),
d AS (SELECT *, sum(chord) OVER (PARTITION BY sid, end_ ORDER BY o) AS deep, count(*) OVER (PARTITION BY sid, end_) AS n FROM c), i AS (SELECT * FROM d WHERE n > 1 AND (deep <= 30 OR i <= 2)),
m AS (SELECT sid, end_, max(i) AS m FROM i GROUP BY 1, 2), tb AS (SELECT m.sid, m.end_, m.m, {', '.join(f'a.p{i} AS a{i}, a.p{i} - b.p{i} AS v{i}' for i in range(3))} FROM m JOIN i a ON a.sid = m.sid AND a.end_ = m.end_ AND a.i = 1 JOIN i b ON b.sid = m.sid AND b.end_ = m.end_ AND b.i = least(5, m.m)),
nm AS (SELECT *, sqrt(v0 * v0 + v1 * v1 + v2 * v2) + 1e-12 AS norm FROM tb),
x AS (SELECT i.sid, i.end_, CAST(m.m - i.i AS BIGINT) AS k, p0, p1, p2 FROM i JOIN m ON m.sid = i.sid AND m.end_ = i.end_ UNION ALL SELECT sid, end_, m + j - 1, {', '.join(f'a{i} + (3.0::DOUBLE * j) * (v{i} / norm)' for i in range(3))} FROM nm, (SELECT unnest(range(1, 16)) AS j)),
g AS (SELECT *, coalesce(sqrt({' + '.join(f'(p{i} - lag(p{i}) OVER w) * (p{i} - lag(p{i}) OVER w)' for i in range(3))}), 0) AS gap, max(k) OVER (PARTITION BY sid, end_) AS last FROM x WINDOW w AS (PARTITION BY sid, end_ ORDER BY k)),
f AS (SELECT *, sum(gap) OVER (PARTITION BY sid, end_ ORDER BY k) AS far FROM g),
r AS (SELECT sid, end_, k, far, CAST(0 AS BIGINT) AS place, last FROM f WHERE k = 0 UNION ALL SELECT r.sid, r.end_, min(f.k), arg_min(f.far, f.k), r.place + 1, r.last FROM r JOIN f ON f.sid = r.sid AND f.end_ = r.end_ AND f.k > r.k AND (f.far - r.far >= 3 OR f.k = r.last) GROUP BY r.sid, r.end_, r.place, r.last),
u AS (SELECT r.sid, r.end_, r.place, p0, p1, p2, coalesce(sqrt({' + '.join(f'(p{i} - lag(p{i}) OVER w) * (p{i} - lag(p{i}) OVER w)' for i in range(3))}), 0) AS gap FROM r JOIN f ON f.sid = r.sid AND f.end_ = r.end_ AND f.k = r.k WINDOW w AS (PARTITION BY r.sid, r.end_ ORDER BY r.place)),
z AS (SELECT *, sum(gap) OVER (PARTITION BY sid, end_ ORDER BY place) AS far, sum(gap) OVER (PARTITION BY sid, end_) AS whole FROM u)
SELECT sid, end_ AS "end", place AS k, {', '.join(f'round(p{i}, 4) + 0.0 AS p{i}' for i in range(3))}, round(3 + 25 * far / (whole + 1e-12), 4) AS radius FROM z""")
def end_caps(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(shapes.end_caps(P.curves_from_events(spark, d)), 4)


@_query()
def match_rates(spark: SparkSession, d: str) -> DataFrame:
    curves = P.curves_from_events(spark, d)
    return _rounded(shapes.match_rates(curves, curves.where("sid <= 3")), 4)


@_query(f"""WITH {CURVE}, b AS (SELECT *, unnest(range(0, 4)) AS band FROM (SELECT *, count(*) OVER (PARTITION BY sid) AS n FROM curve)), pc AS (SELECT sid, band, row_number() OVER (PARTITION BY sid, band ORDER BY k) AS k, p0, p1, p2 FROM b WHERE k >= round_even(band * n / 4, 0) AND k < round_even((band + 1) * n / 4, 0) + 1),
st AS (SELECT *, coalesce(sqrt({' + '.join(f'(p{i} - lag(p{i}) OVER o) ^ 2' for i in range(3))}), 0) AS step FROM pc WINDOW o AS (PARTITION BY sid, band ORDER BY k)), al AS (SELECT *, sum(step) OVER (PARTITION BY sid, band ORDER BY k) AS s FROM st),
sg AS (SELECT *, lead(s) OVER o AS s1, {', '.join(f'lead(p{i}) OVER o AS q{i}' for i in range(3))}, max(s) OVER (PARTITION BY sid, band) AS total FROM al WINDOW o AS (PARTITION BY sid, band ORDER BY k)),
tg AS (SELECT sid, band, j, CASE WHEN j = 9 THEN total ELSE total * j / 9 END AS t FROM (SELECT DISTINCT sid, band, total FROM sg WHERE total > 0), (SELECT unnest(range(0, 10)) AS j)),
sm AS (SELECT g.sid, g.band, j, {', '.join(f'p{i} + least(greatest((t - s) / (s1 - s), 0), 1) * (q{i} - p{i}) AS p{i}' for i in range(3))} FROM tg g JOIN sg ON g.sid = sg.sid AND g.band = sg.band AND s1 > s AND ((t >= s AND t < s1 AND j < 9) OR (j = 9 AND s1 >= total)))
SELECT a.sid, CAST(a.band AS INTEGER) AS piece, a.j AS i, round(sqrt({' + '.join(f'(a.p{i} - b.p{i}) ^ 2' for i in range(3))}), 3) AS distance FROM sm a JOIN sm b ON a.sid = b.sid AND a.band + 1 = b.band AND a.j = b.j""")
def piece_correspondences(spark: SparkSession, d: str) -> DataFrame:
    pieces = shapes.bands(P.curves_from_events(spark, d), 4).withColumnRenamed("band", "piece")
    return _rounded(shapes.correspondences(pieces), 3)


@_query()
def component_curves(spark: SparkSession, d: str) -> DataFrame:
    """Curves along the spanning forest of the cloud."""
    cloud, tree = _forest(spark, d)
    curves, names = assembly.component_curves(cloud, tree, 5, 1.5, 2.0, 180.0, 2.0, 1.0, 0.9)
    return _rounded(curves.join(names, "sid").select("component", "sid", "k", "p0", "p1", "p2"), 3)


# --- records ----------------------------------------------------------------------


@_query("""SELECT o_orderkey AS id, CASE WHEN b < 1024 THEN CAST(floor(b) AS BIGINT) || ' B' WHEN b < 1024 ** 2 THEN printf('%.1f KB', b / 1024) WHEN b < 1024 ** 3 THEN printf('%.1f MB', b / 1024 ** 2) WHEN b < 1024 ** 4 THEN printf('%.1f GB', b / 1024 ** 3) ELSE printf('%.1f TB', b / 1024 ** 4) END AS size
FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) * CAST(pow(10, o_orderkey % 9) AS DOUBLE) / 1000 AS b FROM orders)""")
def readable_sizes(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("o_totalprice").cast("double") * F.pow(F.lit(10.0), (F.col("o_orderkey") % 9).cast("double")) / 1000
    return P.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), records.readable_bytes(b).alias("size"))


@_query("SELECT p_partkey AS id, p_name || '_pointcloud_full_energy_32000_linearity_0.03.npz' AS cloud, p_name || '_pointcloud_full_energy_32000_linearity_0.03_ds4.npz' AS binned FROM part")
def output_names(spark: SparkSession, d: str) -> DataFrame:
    cloud = records.cloud_name(F.col("p_name"), 32000.0, 0.03)
    return P.read(spark, d, "part").select(F.col("p_partkey").alias("id"), cloud.alias("cloud"), records.binned_name(cloud, 4.0).alias("binned"))


_ESTIMATES = "est AS (SELECT p_brand AS sample, 2 * quantile_cont(CAST(p_size AS DOUBLE) / 4, 0.5) AS diameter FROM part GROUP BY 1)"


def _estimates(spark: SparkSession, d: str) -> DataFrame:
    radius = F.col("p_size").cast("double") / 4
    return P.read(spark, d, "part").groupBy(F.col("p_brand").alias("sample")).agg((2 * F.percentile(radius, F.lit(0.5))).alias("diameter"))


@_query(f"""WITH {_ESTIMATES}, m AS (SELECT count(*) AS n, quantile_cont(diameter, 0.5) AS diameter, min(diameter) AS least, max(diameter) AS most FROM est WHERE diameter > 0)
SELECT n, diameter, least, most, greatest(1, CAST(round_even(diameter / 2, 0) AS INTEGER)) AS sigma, round_even(1 / (1.4 * diameter), 4) AS freq, 2 * CAST(round_even(3.0 * greatest(1, round_even(diameter / 2, 0)), 0) AS INTEGER) + 1 AS kernel FROM m""")
def batch_parameters(spark: SparkSession, d: str) -> DataFrame:
    return records.batch_parameters(_estimates(spark, d))


@_query(f"""WITH {_ESTIMATES}, s AS (SELECT sample, diameter / 2 AS sigma, CASE WHEN diameter > 12 THEN 1 / diameter END AS freq FROM est)
SELECT p_partkey AS id, p_brand AS sample, CASE WHEN freq IS NOT NULL THEN round(sigma, 6) ELSE 7.0 END AS sigma, CASE WHEN freq IS NOT NULL THEN round(freq, 6) ELSE 0.05 END AS freq, CASE WHEN freq IS NOT NULL THEN 'saved' ELSE 'default' END AS origin FROM part LEFT JOIN s ON s.sample = p_brand""")
def resolved_parameters(spark: SparkSession, d: str) -> DataFrame:
    inputs = P.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("sample"))
    saved = _estimates(spark, d).select("sample", (F.col("diameter") / 2).alias("sigma"), F.when(F.col("diameter") > 12, 1 / F.col("diameter")).alias("freq"))
    return _rounded(records.resolved_parameters(inputs, saved, {"sigma": 7.0, "freq": 0.05}))


@_query(f"WITH {CURVE}, n AS (SELECT sid, count(*) AS n FROM curve GROUP BY sid), o AS (SELECT sid, sum(n) OVER (ORDER BY sid) - n AS start FROM n) SELECT sid, k, round(p0, 6) AS p0, p1 FROM curve")
def packed_curves(spark: SparkSession, d: str) -> DataFrame:
    """Curves packed into one run of places and taken apart again by their offsets."""
    curves = P.curves_from_events(spark, d)
    offsets = records.packed_offsets(curves)
    points = curves.join(offsets, "sid").select((F.col("start") + F.col("k")).alias("at"), "p0", "p1")
    return _rounded(records.unpacked(points, offsets, 256).select("sid", "k", "p0", "p1"))


@_query(f"WITH {CURVE}, n AS (SELECT sid % 10 AS sample, sid, count(*) AS n FROM curve GROUP BY sid), w AS (SELECT *, sid % 30 = 7 AS wanted FROM n) SELECT sample, sid, n FROM w QUALIFY row_number() OVER (PARTITION BY sample ORDER BY wanted DESC, n DESC, sid) = 1")
def longest_curves(spark: SparkSession, d: str) -> DataFrame:
    curves = P.curves_from_events(spark, d).withColumn("sample", F.col("sid") % 10)
    return records.longest_curve(curves, "sample", curves.where("sid % 30 = 7").select("sample", "sid"))


@_query(f"WITH {CURVE}, n AS (SELECT *, count(*) OVER (PARTITION BY sid) AS n FROM curve) SELECT sid, k AS place, printf('%.4f %.4f %.4f 0.2500', p0, p1, p2) AS line FROM n WHERE n > 1 UNION ALL SELECT DISTINCT sid, n, '' FROM n WHERE n > 1")
def strand_lines(spark: SparkSession, d: str) -> DataFrame:
    return records.strand_lines(P.curves_from_events(spark, d), 0.25)


@_query(f"""WITH {CURVE}, n AS (SELECT sid, count(*) AS n FROM curve GROUP BY sid), o AS (SELECT sid, CAST(sum(n) OVER (ORDER BY sid) - n AS BIGINT) AS start, n FROM n)
SELECT 0 AS part, start + k AS at_, printf('v %.6f %.6f %.6f', p0, p1, p2) AS line FROM curve JOIN o USING (sid) UNION ALL SELECT 1, start, 'l ' || array_to_string(range(start + 1, start + n + 1), ' ') FROM o WHERE n > 1""".replace("at_", "place"))
def obj_file(spark: SparkSession, d: str) -> DataFrame:
    return records.obj_numbered(P.curves_from_events(spark, d)).withColumnRenamed("at", "place")


@_query(f"WITH {CURVE}, n AS (SELECT *, count(*) OVER (PARTITION BY sid) AS n FROM curve) SELECT sid, k FROM n WHERE k <= n // 2")
def first_halves(spark: SparkSession, d: str) -> DataFrame:
    return shapes.first_half(P.curves_from_events(spark, d)).select("sid", "k")



# --- decisions at junctions, with the published numbers -----------------------------

WIDE = 8.0
#: Whole branches, walked hop by hop; the library has them from intervals.
WHOLE = FOREST.replace(pairs_sql("cloud", FAR), pairs_sql("cloud", WIDE)).replace(f" WHERE hops < {HOPS}", "")
REAL_SQL = f"{WHOLE}, reals AS (SELECT junction AS id FROM size GROUP BY junction HAVING min(size) > 20)"


def _wide(spark: SparkSession, d: str) -> tuple[DataFrame, decisions.Forest]:
    cloud = P.cloud_from_events(spark, d)
    return cloud, decisions.Forest(*graph.spanning_forest_of_components(graph.proximity_edges(cloud, WIDE)))


@_query(f"{WHOLE} SELECT junction, branch, size, CAST(depth AS BIGINT) AS depth, end_ AS tip FROM (SELECT junction, branch, count(*) AS size, max(hops) AS depth, arg_min(node, (-hops, node)) AS end_ FROM br GROUP BY 1, 2)")
def whole_branches(spark: SparkSession, d: str) -> DataFrame:
    """Every junction's branches to their ends: sizes and deepest nodes."""
    _, forest = _wide(spark, d)
    far = paths.branch_ends(forest.sizes, paths.reaches(forest.nodes, forest.steps))
    hubs = junctions.hubs(forest.tree).withColumnRenamed("id", "junction")
    return far.join(hubs, "junction", "left_semi").select("junction", "branch", "size", F.col("far").alias("depth"), F.col("end").alias("tip"))


@_query(f"{REAL_SQL} SELECT junction, branch, node AS next, CAST(hops AS BIGINT) AS hops FROM br SEMI JOIN reals r ON r.id = node WHERE junction IN (SELECT id FROM reals) AND hops <= 1000 QUALIFY row_number() OVER (PARTITION BY junction, branch ORDER BY hops, node) = 1")
def stems_to_junctions(spark: SparkSession, d: str) -> DataFrame:
    """The next junction with branches of over 20 nodes along each branch of each of them, within 1,000 edges."""
    _, forest = _wide(spark, d)
    real = stored(forest.real_junctions(), "real")
    near = paths.branch_ends(forest.sizes, paths.reaches(forest.nodes, forest.steps, real, nearest=True)).where("far <= 1000")
    return near.join(real.withColumnRenamed("id", "junction"), "junction", "left_semi").select("junction", "branch", F.col("end").alias("next"), F.col("far").alias("hops"))


DECIDED = f"""{WHOLE}, pv AS (SELECT junction, branch, node, {', '.join(f'q.p{k} - j.p{k} AS v{k}' for k in range(3))}, sqrt({' + '.join(f'(q.p{k} - j.p{k}) ^ 2' for k in range(3))}) AS far FROM br JOIN cloud q ON q.id = node JOIN cloud j ON j.id = junction),
vec AS (SELECT * FROM pv QUALIFY row_number() OVER (PARTITION BY junction, branch ORDER BY round(abs(far - 10), 9), node) = 1),
bl AS (SELECT j.id AS junction, q.id AS id, {', '.join(f'q.p{k} - j.p{k} AS r{k}' for k in range(3))} FROM (SELECT * FROM cloud SEMI JOIN vec ON id = junction) j JOIN cloud q ON q.p0 BETWEEN j.p0 - 10 AND j.p0 + 10 AND {' + '.join(f'(q.p{k} - j.p{k}) ^ 2' for k in range(3))} BETWEEN 1e-12 AND 100),
asg AS (SELECT junction, id, branch FROM bl JOIN vec USING (junction) WHERE far > 1e-9 QUALIFY row_number() OVER (PARTITION BY junction, id ORDER BY (r0 * v0 + r1 * v1 + r2 * v2) / far DESC, branch) = 1),
cnt AS (SELECT junction, branch, count(id) AS points FROM vec LEFT JOIN asg USING (junction, branch) GROUP BY 1, 2),
un AS (SELECT junction, branch, points, v0 / far AS u0, v1 / far AS u1, v2 / far AS u2 FROM vec JOIN cnt USING (junction, branch) QUALIFY count(*) OVER (PARTITION BY junction) = 3 AND min(far) OVER (PARTITION BY junction) > 1e-9),
pr AS (SELECT a.junction, a.branch AS ba, b.branch AS bb, 180 - degrees(acos(greatest(-1, least(1, a.u0 * b.u0 + a.u1 * b.u1 + a.u2 * b.u2)))) AS left_over FROM un a JOIN un b ON a.junction = b.junction AND a.branch < b.branch),
sc AS (SELECT un.junction, branch, CASE WHEN sum(left_over) OVER j > 1e-9 THEN left_over / sum(left_over) OVER j ELSE 1.0 / 3 END AS angle, CASE WHEN sum(points) OVER j > 0 THEN points / sum(points) OVER j ELSE 1.0 / 3 END AS density FROM un JOIN pr ON un.junction = pr.junction AND branch <> ba AND branch <> bb WINDOW j AS (PARTITION BY un.junction)),
stem AS (SELECT *, row_number() OVER (PARTITION BY junction ORDER BY round(0.4 * angle + 0.6 * density, 9) DESC, branch) = 1 AS is_stem FROM sc),
arm AS (SELECT junction, branch, is_stem, count(*) AS size, arg_min(node, (-hops, node)) AS tip, row_number() OVER (PARTITION BY junction ORDER BY is_stem, count(*), branch) AS place FROM br JOIN stem USING (junction, branch) GROUP BY 1, 2, 3),
row_ AS (SELECT junction, max(branch) FILTER (place = 3) AS stem, max(branch) FILTER (place = 1) AS short, max(branch) FILTER (place = 2) AS long, max(tip) FILTER (place = 1) AS tip FROM arm GROUP BY 1),
tch AS (SELECT r.junction, br.node AS touch FROM row_ r JOIN br ON br.junction = r.junction AND br.branch = r.long JOIN cloud t ON t.id = r.tip JOIN cloud q ON q.id = br.node WHERE {' + '.join(f'(t.p{k} - q.p{k}) ^ 2' for k in range(3))} <= {{reach2}} QUALIFY row_number() OVER (PARTITION BY r.junction ORDER BY round({' + '.join(f'(t.p{k} - q.p{k}) ^ 2' for k in range(3))}, 9), br.node) = 1),
goal AS (SELECT junction, tip AS at_, 0 AS side FROM row_ JOIN tch USING (junction) UNION ALL SELECT junction, touch, 1 FROM row_ JOIN tch USING (junction)),
up AS (SELECT g.junction, g.side, b.node, b.hops, b.prev FROM goal g JOIN br b ON b.junction = g.junction AND b.node = g.at_ UNION ALL SELECT u.junction, u.side, b.node, b.hops, b.prev FROM up u JOIN br b ON b.junction = u.junction AND b.node = u.prev WHERE u.prev <> u.junction),
lp AS (SELECT junction, side, node, hops FROM up UNION ALL SELECT junction, side, junction, 0 FROM goal),
off_ AS (SELECT l.junction, l.node AS other, s.branch AS first, least(s.size, 10000) AS size FROM (SELECT DISTINCT junction, node FROM lp WHERE node <> junction) l JOIN (SELECT a AS junction, b AS branch FROM arcs) e ON e.junction = l.node JOIN every s ON s.junction = e.junction AND s.branch = e.branch WHERE s.size >= 3 AND NOT EXISTS (SELECT 1 FROM lp x WHERE x.junction = l.junction AND x.node = s.branch)),
trn AS (SELECT * FROM off_ QUALIFY row_number() OVER (PARTITION BY junction ORDER BY size DESC, other, first) = 1)"""
#: Sizes of the branches of every node, not of junctions only.
EVERY = "every AS (SELECT id AS junction, branch, count(*) AS size FROM ev GROUP BY 1, 2), "
EV = "ev AS (SELECT a AS id, b AS branch, b AS node, a AS prev FROM arcs UNION ALL SELECT id, branch, arcs.b, node FROM ev JOIN arcs ON arcs.a = node AND arcs.b <> prev), "
REACH = 12.0
DECIDED = DECIDED.replace("tch AS", EV + EVERY + "tch AS").replace("{reach2}", str(REACH * REACH))


def _decided(spark: SparkSession, d: str) -> tuple[DataFrame, decisions.Forest, DataFrame]:
    cloud, forest = _wide(spark, d)
    return cloud, forest, decisions.decide(forest, junctions.hubs(forest.tree), cloud, REACH)


@_query(f"""{DECIDED} SELECT h.id AS junction, CASE WHEN r.junction IS NULL THEN 'skip' WHEN touch IS NULL THEN 'cut' WHEN trn.other IS NOT NULL THEN 'loop' ELSE 'skip' END AS action, r.stem, r.short, r.long, r.tip, touch, trn.other AS next
FROM hub h LEFT JOIN row_ r ON r.junction = h.id LEFT JOIN tch ON tch.junction = h.id LEFT JOIN trn ON trn.junction = h.id""")
def junction_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Every junction's action; no arm of these trees is over 1,000 edges deep."""
    return _decided(spark, d)[2]


@_query(f"{DECIDED}, n AS (SELECT junction, max(hops) FILTER (side = 0) AS a, max(hops) FILTER (side = 1) AS b FROM lp GROUP BY 1) SELECT junction, CAST(if(side = 0, hops, a + 1 + b - hops) AS BIGINT) AS k, node AS id FROM lp JOIN n USING (junction)")
def loop_paths(spark: SparkSession, d: str) -> DataFrame:
    """The loops of all junctions whose smaller arm comes back to the larger one."""
    cloud, forest = _wide(spark, d)
    table = decisions.arms(forest, junctions.hubs(forest.tree), cloud, REACH)
    return decisions.loop_nodes(forest, table.where("touch is not null"))


# --- collapsed regions ---------------------------------------------------------------

#: Five curves a sample, two regions of two ways: ends of the first two go on in the next two, whose ends go on in the fifth and the first.
REGIONS = ((0, 0, 0, 1, 2, 0), (0, 0, 1, 1, 3, 0), (0, 1, 0, 1, 3, 0), (0, 1, 1, 1, 2, 0), (1, 0, 2, 1, 4, 0), (1, 0, 3, 1, 0, 0), (1, 1, 2, 1, 0, 0), (1, 1, 3, 1, 4, 0))
CHAINS = f"""WITH RECURSIVE {CURVE}, names AS (SELECT DISTINCT sid // 5 AS sample, sid FROM curve), whole AS (SELECT sample FROM names GROUP BY sample HAVING count(*) = 5),
w(region, way, ia, a_end, ib, b_end) AS (VALUES {', '.join(map(str, REGIONS))}), ch AS (SELECT sample, c AS choice FROM whole, range(4) t(c)),
joins AS (SELECT sample, choice, 5 * sample + ia AS a, a_end, 5 * sample + ib AS b, b_end FROM ch, w WHERE way = CASE WHEN region = 0 THEN choice // 2 ELSE choice % 2 END),
both_ AS (SELECT * FROM joins UNION ALL SELECT sample, choice, b, b_end, a, a_end FROM joins),
ends AS (SELECT ch.sample, choice, sid, e FROM ch JOIN names USING (sample), (VALUES (0), (1)) v(e)), free AS (SELECT * FROM ends f WHERE NOT EXISTS (SELECT 1 FROM both_ b WHERE b.sample = f.sample AND b.choice = f.choice AND b.a = f.sid AND b.a_end = f.e)),
walk AS (SELECT sample, choice, sid AS chain, e AS chain_end, CAST(0 AS BIGINT) AS place, sid, e AS enter FROM free UNION ALL SELECT k.sample, k.choice, chain, chain_end, place + 1, b.b, b.b_end FROM walk k JOIN both_ b ON b.sample = k.sample AND b.choice = k.choice AND b.a = k.sid AND b.a_end = 1 - k.enter),
own AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY sample, choice, sid ORDER BY chain, chain_end) = 1)"""


def _regions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    curves = P.curves_from_events(spark, d).withColumn("sample", F.expr("sid div 5"))
    whole = curves.groupBy("sample").agg(F.countDistinct("sid").alias("n")).where("n = 5").select("sample")
    rows = F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(row, ("region", "way", "ia", "a_end", "ib", "b_end"), strict=True))) for row in REGIONS))
    ways = whole.withColumn("w", F.explode(rows)).select("sample", "w.region", "w.way", (5 * F.col("sample") + F.col("w.ia")).alias("a"), "w.a_end", (5 * F.col("sample") + F.col("w.ib")).alias("b"), "w.b_end")
    return curves.join(whole, "sample"), ways


@_query(f"{CHAINS} SELECT e.sample, e.choice, e.sid, o.chain, o.chain_end, o.place, o.enter = 1 AS flipped FROM (SELECT DISTINCT sample, choice, sid FROM ends) e LEFT JOIN own o USING (sample, choice, sid)")
def collapse_chains(spark: SparkSession, d: str) -> DataFrame:
    """Which curves follow each other in every combination of every sample; curves of loops have no chain."""
    curves, ways = _regions(spark, d)
    found = collapse.chains(curves, ways, collapse.combinations(ways))
    return found.select("sample", "choice", "sid", F.col("chain.sid").alias("chain"), F.col("chain.end").alias("chain_end"), "place", "flipped")


@_query()
def collapse_solutions(spark: SparkSession, d: str) -> DataFrame:
    """Combinations without loops, scored by their knots, and the regions in which they differ from their sample's best."""
    curves, ways = _regions(spark, d)
    solutions, chosen = collapse.solve(curves, ways)
    return _rounded(solutions.join(collapse.differences(solutions, chosen), ["sample", "choice"]).select("sample", "choice", "strands", "log10_det", "is_best", F.concat_ws(",", F.transform("regions", lambda x: x.cast("string"))).alias("regions")), 4)


# --- walks, orderings, template searches -----------------------------------------------


@_query(f"""{WHOLE}, deg AS (SELECT a, count(*) AS n FROM arcs GROUP BY a), ln AS (SELECT a, b, a AS x, b AS y, 1 AS n FROM arcs UNION ALL SELECT l.a, l.b, l.y, r.b, l.n + 1 FROM ln l JOIN deg ON deg.a = l.y AND deg.n = 2 JOIN arcs r ON r.a = l.y AND r.b <> l.x WHERE l.n < 30),
len_ AS (SELECT a, b, max(n) AS length FROM ln GROUP BY 1, 2), dir AS (SELECT arcs.a, arcs.b, {', '.join(f'(q.p{k} - p.p{k}) / nullif(sqrt({" + ".join(f"(q.p{i} - p.p{i}) ^ 2" for i in range(3))}), 0) AS d{k}' for k in range(3))} FROM arcs JOIN cloud p ON p.id = arcs.a JOIN cloud q ON q.id = arcs.b),
one AS (SELECT h.id AS walker, l.b AS at_, h.id AS before FROM hub h JOIN len_ l ON l.a = h.id QUALIFY row_number() OVER (PARTITION BY h.id ORDER BY l.length DESC, l.b) = 1),
nxt AS (SELECT u.a AS before, u.b AS at_, v.b AS to_ FROM dir u JOIN dir v ON v.a = u.b AND v.b <> u.a QUALIFY row_number() OVER (PARTITION BY u.a, u.b ORDER BY round(u.d0 * v.d0 + u.d1 * v.d1 + u.d2 * v.d2, 12) DESC, v.b) = 1),
wk AS (SELECT walker, CAST(1 AS BIGINT) AS k, at_, before FROM one UNION ALL SELECT w.walker, w.k + 1, n.to_, w.at_ FROM wk w JOIN nxt n ON n.before = w.before AND n.at_ = w.at_ WHERE w.k < 25)
SELECT id AS walker, CAST(0 AS BIGINT) AS k, id FROM hub UNION ALL SELECT walker, k, at_ FROM wk""")
def greedy_walks(spark: SparkSession, d: str) -> DataFrame:
    """25 steps from every junction."""
    cloud = P.cloud_from_events(spark, d)
    tree = stored(graph.spanning_forest(graph.proximity_edges(cloud, WIDE)), "tree")
    starts = junctions.hubs(tree).select(F.col("id").alias("walker"), F.col("id").alias("start"), F.lit(None).cast("long").alias("avoid"))
    return walks.greedy_walks(tree, cloud, starts)


@_query()
def ordered_points(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events along the longest path of the tree of their nearest neighbours."""
    points = P.cloud_from_events(spark, d).select(F.col("p2").cast("long").alias("sid"), "id", "p0", "p1", (F.col("d0") * 10).alias("p2"))
    return walks.ordered_points(points, reach=80.0)


@_query()
def forward_matches(spark: SparkSession, d: str) -> DataFrame:
    """Three curves as templates, tried from every tenth point of all curves on."""
    curves = P.curves_from_events(spark, d)
    library = curves.where("sid in (1, 2, 3) and k between 5 and 14").select(F.col("sid").alias("template"), (F.col("k") - 5).alias("k"), "p0", "p1", "p2")
    starts = curves.where("k % 10 = 0").select("sid", F.col("k").alias("start"), F.explode(F.array(*(F.lit(x).cast("long") for x in (1, 2, 3)))).alias("template"))
    return _rounded(shapes.forward_matches(curves, starts, library, spacing=180.0, samples=12, temperature=100.0).drop("fits"), 4)


@_query(f"""WITH {CLOUD_EV}, {pairs_sql('cloud', FAR)}, arcs AS (SELECT DISTINCT a_id AS a, b_id AS b FROM pairs WHERE a_id <> b_id), n AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS at_ FROM arcs),
k AS (SELECT a, min(at_) AS start, max(at_) + 1 AS stop, string_agg(b, ' ' ORDER BY b) AS nodes FROM n GROUP BY a) SELECT row_number() OVER (ORDER BY a) - 1 AS place, a AS key, start, stop, nodes FROM k""")
def packed_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """The graph of near points packed row by row, with its offsets, and each row's neighbours read back by them."""
    edges = graph.proximity_edges(P.cloud_from_events(spark, d), FAR)
    keys, neighbours = states.packed_adjacency(edges)
    seats = keys.select("place", "key", "start", "stop", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("position"))
    rows = seats.join(neighbours, "position").groupBy("place", "key", "start", "stop").agg(F.sort_array(F.collect_list(F.struct("position", "node"))).alias("n"))
    return rows.select("place", "key", "start", "stop", F.concat_ws(" ", F.transform("n", lambda x: x["node"].cast("string"))).alias("nodes"))


# --- analysis and nested geometry --------------------------------------------------------


@_query()
def curve_periods(spark: SparkSession, d: str) -> DataFrame:
    """The periods of every curve's curvature, with the published smoothing and numbers, samples 20 apart."""
    found = analysis.analyse(P.curves_from_events(spark, d), spacing=20.0, least_period=200.0)
    return _rounded(found["periods"], 5)


@_query()
def nested_fibres(spark: SparkSession, d: str) -> DataFrame:
    """Fibres about the plies about all curves."""
    _, found = geometry.hierarchy(P.curves_from_events(spark, d), 2, 80.0, 6.0, 3, 30.0, 2.0, 0.3)
    return _rounded(found, 3)


@_query(f"WITH {CURVE} SELECT sid, k, {', '.join(f'round(p{i}, 4) + 0.0 AS p{i}' for i in range(3))} FROM curve")
def knots_of_upsampled(spark: SparkSession, d: str) -> DataFrame:
    """Every third point of the curves with two points more between any two: the curves themselves."""
    found = geometry.upsampled(P.curves_from_events(spark, d), 3)
    return _rounded(found.where("k % 3 = 0").withColumn("k", F.expr("k div 3")), 4)
