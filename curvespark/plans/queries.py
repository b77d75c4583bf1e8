"""Queries of the engine's own operators over the given tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvespark.operators import cloud as C
from curvespark.operators import curves as V
from curvespark.operators import edits, files, filters, fitting, geometry, graph, joining, knots, meanshift, noise, rod, signals, trees, volume
from curvespark.plans import projections as P
from curvespark.plans.lineage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        name = f.__name__
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


CLOUD_EV = """cloud AS (SELECT event_id AS id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 3.6e9 AS p0, value AS p1, CAST(user_id AS DOUBLE) AS p2,
 cos(2 * pi() * kk / 100) AS d0, sin(2 * pi() * kk / 100) AS d1, CAST(0 AS DOUBLE) AS d2, value AS energy, kk / 100 AS linearity
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS kk FROM events))"""
CLOUD_EMB = (
    "cloud AS (SELECT vec_id AS id, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {'pd'[i // 3]}{i % 3}" for i in range(6))
    + ", sqrt(CAST(embedding[7] AS DOUBLE) ^ 2 + CAST(embedding[8] AS DOUBLE) ^ 2 + CAST(embedding[9] AS DOUBLE) ^ 2) AS energy, abs(CAST(embedding[10] AS DOUBLE)) AS linearity FROM embeddings)"
)
UNIT = "unit AS (SELECT id, p0, p1, p2, energy, linearity, CASE WHEN n > 1e-8 THEN d0 / n ELSE d0 END AS d0, CASE WHEN n > 1e-8 THEN d1 / n ELSE d1 END AS d1, CASE WHEN n > 1e-8 THEN d2 / n ELSE d2 END AS d2 FROM (SELECT *, sqrt(d0 * d0 + d1 * d1 + d2 * d2) AS n FROM cloud))"
VOLUME = "vol AS (SELECT l_returnflag AS sample, CAST(l_linenumber AS INTEGER) AS z, CAST(round(l_quantity) AS INTEGER) AS y, CAST(round(l_discount * 100) AS INTEGER) AS x, round(avg(l_extendedprice), 4) AS v FROM lineitem GROUP BY ALL)"
CURVE = """curve AS (SELECT user_id AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 3.6e9 AS p0, value AS p1,
 CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS p2 FROM events)"""
SIGNAL = "sig AS (SELECT l_suppkey AS sid, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS k, l_extendedprice AS x FROM lineitem)"
LOG = "log AS (SELECT ts, user_id AS sid, CASE WHEN event_type = 'click' THEN 'B' ELSE 'A' END AS kind, event_id AS g1, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n_synth FROM events)"
RADIUS, NEAR = 5.0, 0.15


def pairs_sql(table: str, radius: float, extra: str = "", strict: bool = False) -> str:
    """Pairs of a table's points by cells of a grid, as any SQL engine can join them."""
    op = "<" if strict else "<="
    return f"""g AS (SELECT *, CAST(floor(p0 / {radius}) AS BIGINT) AS c0, CAST(floor(p1 / {radius}) AS BIGINT) AS c1, CAST(floor(p2 / {radius}) AS BIGINT) AS c2 FROM {table}),
o AS (SELECT a.*, c0 + i AS n0, c1 + j AS n1, c2 + l AS n2 FROM g a, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS l)),
pairs AS (SELECT a.id AS a_id, b.id AS b_id, (a.p0 - b.p0) * (a.p0 - b.p0) + (a.p1 - b.p1) * (a.p1 - b.p1) + (a.p2 - b.p2) * (a.p2 - b.p2) AS d2, {", ".join(f"{s}.{c}{k} AS {s}_{c}{k}" for s in "ab" for c in "pd" for k in range(3))}
 FROM o a JOIN g b ON a.n0 = b.c0 AND a.n1 = b.c1 AND a.n2 = b.c2 AND a.id <> b.id AND (a.p0 - b.p0) * (a.p0 - b.p0) + (a.p1 - b.p1) * (a.p1 - b.p1) + (a.p2 - b.p2) * (a.p2 - b.p2) {op} {radius * radius} {extra})"""


# --- volumes -----------------------------------------------------------------


@_query(f"WITH {VOLUME}, n AS (SELECT sample, v / max(v) OVER (PARTITION BY sample) AS v FROM vol) SELECT sample, count(*) AS voxels, count(*) FILTER (v >= 0.5) AS kept, round(100.0 * count(*) FILTER (v >= 0.5) / count(*), 6) AS keep_pct FROM n GROUP BY sample")
def volume_normalise_keep_pct(spark: SparkSession, d: str) -> DataFrame:
    return volume.keep_share(volume.normalised(P.volume_from_lines(spark, d)), 0.5)


HIST = f"WITH {VOLUME}, e AS (SELECT *, min(v) OVER (PARTITION BY sample) AS lo, max(v) OVER (PARTITION BY sample) AS hi FROM vol), h AS (SELECT sample, CAST(least(floor((v - lo) / (hi - lo) * 256), 255) AS INTEGER) AS bin, count(*) AS n, first(lo) AS lo, first(hi) AS hi FROM e GROUP BY 1, 2)"


@_query(f"{HIST} SELECT sample, bin, n FROM h")
def histogram256(spark: SparkSession, d: str) -> DataFrame:
    return volume.histogram(P.volume_from_lines(spark, d)).select("sample", "bin", "n")


@_query(f"""{HIST}, c AS (SELECT *, lo + (bin + 0.5) * (hi - lo) / 256 AS centre FROM h),
w AS (SELECT *, sum(n) OVER u AS w1, sum(n * centre) OVER u AS s1, sum(n) OVER (PARTITION BY sample) AS w, sum(n * centre) OVER (PARTITION BY sample) AS s FROM c WINDOW u AS (PARTITION BY sample ORDER BY bin)),
b AS (SELECT *, CASE WHEN w > w1 THEN round(w1 * (w - w1) * (s1 / w1 - (s - s1) / (w - w1)) ^ 2, 3) ELSE 0 END AS between_ FROM w)
SELECT sample, bin, round(centre, 6) AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY sample ORDER BY between_ DESC, bin) = 1""")
def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    return volume.otsu(P.volume_from_lines(spark, d))


@_query(f"""{HIST}, bins AS (SELECT sample, bin, coalesce(n, 0) AS n, lo, hi FROM (SELECT sample, any_value(lo) AS lo, any_value(hi) AS hi, unnest(range(0, 256)) AS bin FROM h GROUP BY sample) LEFT JOIN (SELECT sample, bin, n FROM h) USING (sample, bin)),
ww AS (SELECT unnest(range(-12, 13)) AS i), tot AS (SELECT sum(exp(-0.5 * (i / 3.0) ^ 2)) AS t FROM ww), ask AS (SELECT sample, bin, lo, hi, exp(-0.5 * (i / 3.0) ^ 2) / t AS w, CASE WHEN bin + i < 0 THEN -1 - bin - i WHEN bin + i > 255 THEN 511 - bin - i ELSE bin + i END AS at_ FROM bins, ww, tot),
sm AS (SELECT a.sample, a.bin, any_value(a.lo) AS lo, any_value(a.hi) AS hi, sum(a.w * b.n) AS y FROM ask a JOIN bins b ON a.sample = b.sample AND a.at_ = b.bin GROUP BY 1, 2),
pk AS (SELECT sample, bin, y FROM (SELECT *, lag(y) OVER o AS l, lead(y) OVER o AS r, max(y) OVER (PARTITION BY sample) AS top FROM sm WINDOW o AS (PARTITION BY sample ORDER BY bin)) WHERE y > l AND y >= r AND y >= 0.01 * top),
one AS (SELECT sample, arg_min(bin, (-y, bin)) AS a FROM pk GROUP BY sample), two AS (SELECT pk.sample, any_value(a) AS a, arg_min(bin, (-y, bin)) AS b FROM pk JOIN one USING (sample) WHERE abs(bin - a) >= 10 GROUP BY pk.sample),
va AS (SELECT sm.sample, arg_min(bin, (y, bin)) AS k, any_value(lo) AS lo, any_value(hi) AS hi FROM sm JOIN two USING (sample) WHERE bin BETWEEN least(a, b) AND greatest(a, b) GROUP BY sm.sample)
SELECT v.sample, round(coalesce(any_value(va.lo + (k + 0.5) * (va.hi - va.lo) / 256), quantile_cont(v, 0.95)), 6) AS threshold FROM vol v LEFT JOIN va USING (sample) GROUP BY v.sample""")
def valley_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(volume.valley(P.volume_from_lines(spark, d)))


@_query(f"WITH {VOLUME} SELECT sample, count(*) AS n, min(v) AS v_min, max(v) AS v_max, round(avg(v), 6) AS v_mean, round(stddev_pop(v), 6) AS v_std, round(quantile_cont(v, 0.25), 6) AS v_p25, round(quantile_cont(v, 0.5), 6) AS v_p50, round(quantile_cont(v, 0.75), 6) AS v_p75 FROM vol GROUP BY sample")
def percentile_summary(spark: SparkSession, d: str) -> DataFrame:
    return volume.summary(P.volume_from_lines(spark, d), "sample", ["v"])


@_query("""WITH r AS (SELECT p_brand AS sample, CAST(p_size AS DOUBLE) / 4 AS radius FROM part), m AS (SELECT sample, quantile_cont(radius, 0.5) AS r50 FROM r WHERE radius > 0 GROUP BY sample)
SELECT sample, r50, 2 * r50 AS diameter, greatest(1, CAST(round_even(r50, 0) AS INTEGER)) AS sigma, round(1 / (1.4 * 2 * r50), 6) AS freq, 2 * CAST(round_even(3.0 * greatest(1, round_even(r50, 0)), 0) AS INTEGER) + 1 AS kernel FROM m""")
def diameter_parameters(spark: SparkSession, d: str) -> DataFrame:
    radii = P.read(spark, d, "part").select(F.col("p_brand").alias("sample"), (F.col("p_size").cast("double") / 4).alias("radius"))
    return volume.diameter_parameters(radii).withColumn("freq", F.round("freq", 6))


@_query(f"WITH {VOLUME}, t AS (SELECT sample, x AS xa, v FROM vol) SELECT sample, xa, round(sum(v), 4) AS total, count(*) AS n FROM t WHERE xa IN (1, 3, 5, 7, 9) GROUP BY ALL")
def slice_positions(spark: SparkSession, d: str) -> DataFrame:
    places = spark.range(5).select(F.floor((0.1 + F.col("id") * 0.2) * 11 + 1e-9).cast("int").alias("xa"))
    rows = P.volume_from_lines(spark, d).withColumnRenamed("x", "xa")
    return rows.join(F.broadcast(places), "xa").groupBy("sample", "xa").agg(F.round(F.sum("v"), 4).alias("total"), F.count("*").alias("n"))


# --- clouds ------------------------------------------------------------------


@_query(f"WITH {CLOUD_EMB}, {UNIT} SELECT id, {', '.join(f'round(d{k}, 6) + 0.0 AS d{k}' for k in range(3))} FROM unit")
def dir_normalise(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.normalise_directions(P.cloud_from_embeddings(spark, d)).select("id", "d0", "d1", "d2"))


@_query(f"WITH {CLOUD_EV} SELECT id, energy, linearity FROM cloud WHERE energy > 50 AND linearity > 0.3")
def mask_energy_linearity(spark: SparkSession, d: str) -> DataFrame:
    return C.strong(P.cloud_from_events(spark, d), 50.0, 0.3).select("id", "energy", "linearity")


@_query(f"WITH {CLOUD_EV} SELECT id, round(p0, 6) AS p0, p1, p2 FROM cloud WHERE id % 4 = 0")
def stride_subsample(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.stride(P.cloud_from_events(spark, d), 4).select("id", "p0", "p1", "p2"))


@_query(f"WITH {CLOUD_EV}, b AS (SELECT {', '.join(f'min(p{k}) AS lo{k}, max(p{k}) AS hi{k}' for k in range(3))} FROM cloud) SELECT id FROM cloud, b WHERE {' AND '.join(f'abs(p{k} - (lo{k} + hi{k}) / 2) <= 0.995 * (hi{k} - lo{k}) / 2' for k in range(3))}")
def edge_trim(spark: SparkSession, d: str) -> DataFrame:
    return C.edge_trim(P.cloud_from_events(spark, d)).select("id")


@_query(f"""WITH {CLOUD_EV}, b AS (SELECT count(*) AS n, {', '.join(f'min(p{k}) AS lo{k}, greatest(max(p{k}) - min(p{k}), 1e-9) AS s{k}' for k in range(3))} FROM cloud),
c AS (SELECT id, {', '.join(f'CAST(floor((p{k} - lo{k}) / (4.0 * (s0 * s1 * s2 / n) ** (1.0 / 3))) AS BIGINT) AS c{k}' for k in range(3))} FROM cloud, b)
SELECT min(id) AS id, count(*) AS members FROM c GROUP BY c0, c1, c2""")
def voxel_bin_first(spark: SparkSession, d: str) -> DataFrame:
    return C.voxel_bins(P.cloud_from_events(spark, d)).select("id", "members")


@_query(f"WITH {CLOUD_EV}, {pairs_sql('cloud', RADIUS)} SELECT a_id, b_id, round(d2, 6) AS d2 FROM pairs WHERE a_id < b_id")
def radius_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.neighbours(P.cloud_from_events(spark, d), RADIUS, half=True).select("a_id", "b_id", "d2"))


@_query(f"WITH {CLOUD_EV}, {pairs_sql('cloud', RADIUS)} SELECT * FROM (SELECT a_id, b_id, row_number() OVER (PARTITION BY a_id ORDER BY d2, b_id) AS rank FROM pairs) WHERE rank <= 3")
def knn_join(spark: SparkSession, d: str) -> DataFrame:
    return C.nearest(P.cloud_from_events(spark, d), 3, RADIUS).select("a_id", "b_id", F.col("rank").cast("long").alias("rank"))


_LEAN = lambda s: f"abs((b_p0 - a_p0) * {s}_d0 + (b_p1 - a_p1) * {s}_d1 + (b_p2 - a_p2) * {s}_d2) / sqrt(d2) >= cos(radians(30))"


@_query(f"WITH {CLOUD_EV}, {pairs_sql('cloud', RADIUS)} SELECT a_id AS a, b_id AS b, round(sqrt(d2), 6) AS rest FROM pairs WHERE a_id < b_id AND d2 > 0 AND ({_LEAN('a')} OR {_LEAN('b')})")
def cone_links(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.cone_links(P.cloud_from_events(spark, d), RADIUS))


DEGREE = f"WITH {CLOUD_EV}, {pairs_sql('cloud', RADIUS, strict=True)}, deg AS (SELECT id, coalesce(n, 0) AS n, coalesce(s, 0) AS degree FROM cloud LEFT JOIN (SELECT a_id AS id, count(*) AS n, avg(CASE WHEN abs(a_d0 * b_d0 + a_d1 * b_d1 + a_d2 * b_d2) >= 0.85 THEN 1.0 ELSE 0.0 END) AS s FROM pairs GROUP BY a_id) USING (id))"


@_query(f"{DEGREE} SELECT id, n, round(degree, 6) AS degree FROM deg")
def united_degree(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.united_degree(P.cloud_from_events(spark, d), RADIUS).select("id", "n", "degree"))


@_query(f"{DEGREE} SELECT id FROM deg WHERE degree > 0.85")
def united_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.united_filter(P.cloud_from_events(spark, d), RADIUS).select("id")


@_query(f"WITH {CLOUD_EV}, {pairs_sql('cloud', RADIUS)} SELECT id, round(sqrt(min(m)), 6) AS distance FROM (SELECT id, CASE WHEN id % 10 = 0 THEN 0.0 END AS m FROM cloud UNION ALL SELECT a_id, d2 FROM pairs WHERE b_id % 10 = 0) GROUP BY id")
def nearest_accepted(spark: SparkSession, d: str) -> DataFrame:
    cloud = P.cloud_from_events(spark, d)
    return _rounded(C.nearest_accepted(cloud, C.stride(cloud, 10), RADIUS))


# --- mean shift ---------------------------------------------------------------

BW = 2.5
_ALONG = "((b_p0 - a_p0) * a_d0 + (b_p1 - a_p1) * a_d1 + (b_p2 - a_p2) * a_d2)"
SHIFT = f"""WITH {CLOUD_EV}, {pairs_sql('cloud', 2 * BW)}, near AS (SELECT *, {_ALONG} AS t FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d2, b_id) AS rk FROM pairs) WHERE rk <= 128),
w AS (SELECT *, CASE WHEN t * t / {4 * BW * BW} + greatest(d2 - t * t, 0) / {BW * BW} <= 1 THEN exp(-(t * t / (2 * {4 * BW * BW}) + 2 * greatest(d2 - t * t, 0) / (2 * {BW * BW}))) * abs(a_d0 * b_d0 + a_d1 * b_d1 + a_d2 * b_d2) ^ 2 ELSE 0 END AS w,
 CASE WHEN a_d0 * b_d0 + a_d1 * b_d1 + a_d2 * b_d2 < 0 THEN -1.0 ELSE 1.0 END AS side FROM near),
s AS (SELECT a_id AS id, sum(w) AS w, sum(w * sign(t)) AS wt, {', '.join(f'sum(w * b_p{k}) AS m{k}, sum(w * side * b_d{k}) AS n{k}' for k in range(3))} FROM w GROUP BY a_id),
j AS (SELECT id, p0, p1, p2, d0, d1, d2, coalesce(w, 0) AS w, coalesce(wt, 0) AS wt, {', '.join(f'CASE WHEN w > 1e-12 THEN m{k} / w - p{k} ELSE 0 END AS e{k}, coalesce(n{k}, 0) AS n{k}' for k in range(3))} FROM cloud LEFT JOIN s USING (id)),
q AS (SELECT *, e0 * d0 + e1 * d1 + e2 * d2 AS al, sqrt(n0 * n0 + n1 * n1 + n2 * n2) AS sz, 1 - (abs(wt) / (w + 1e-12)) ^ 0.1 AS damp FROM j),
r AS (SELECT *, {', '.join(f'damp * CASE WHEN sz > 1e-8 THEN n{k} / sz ELSE d{k} END + (1 - damp) * d{k} AS x{k}' for k in range(3))} FROM q),
z AS (SELECT *, CASE WHEN sqrt(x0 * x0 + x1 * x1 + x2 * x2) > 1e-8 THEN sqrt(x0 * x0 + x1 * x1 + x2 * x2) ELSE 1 END AS len FROM r)"""


@_query(f"{SHIFT} SELECT id, {', '.join(f'round(p{k} + e{k} - al * d{k}, 6) + 0.0 AS p{k}' for k in range(3))} FROM z")
def meanshift_step(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(meanshift.shift_step(P.cloud_from_events(spark, d), BW).select("id", "p0", "p1", "p2"))


@_query(f"{SHIFT} SELECT id, {', '.join(f'round(x{k} / len, 5) + 0.0 AS d{k}' for k in range(3))} FROM z")
def meanshift_dirs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(meanshift.shift_step(P.cloud_from_events(spark, d), BW).select("id", "d0", "d1", "d2"), 5)


@_query(f"WITH {CLOUD_EV} SELECT id, CAST(id % 25 AS BIGINT) AS step, round(30.0 * (10.0 / 30.0) ** ((id % 25) / 24.0), 9) AS bw FROM cloud")
def bandwidth_schedule(spark: SparkSession, d: str) -> DataFrame:
    """The bandwidth at the step that each point is at."""
    rows = P.cloud_from_events(spark, d).select("id", (F.col("id") % 25).cast("long").alias("step"))
    return rows.withColumn("bw", F.round(meanshift.bandwidth_at(F.col("step"), meanshift.ShiftParameters(steps=25)), 9))


@_query(f"""WITH {CLOUD_EV}, {pairs_sql('cloud', RADIUS)}, e AS (SELECT a_id AS a, b_id AS b, sqrt(d2) AS len, {', '.join(f'b_p{k} - a_p{k} AS e{k}' for k in range(3))} FROM pairs WHERE a_id < b_id AND d2 > 0 AND ({_LEAN('a')} OR {_LEAN('b')})),
f AS (SELECT a AS id, {', '.join(f'(len - 3.0) * e{k} / len AS f{k}' for k in range(3))} FROM e WHERE len > 1e-9 UNION ALL SELECT b, {', '.join(f'-(len - 3.0) * e{k} / len' for k in range(3))} FROM e WHERE len > 1e-9),
m AS (SELECT id, {', '.join(f'avg(f{k}) AS f{k}' for k in range(3))} FROM f GROUP BY id), n AS (SELECT *, sqrt(f0 * f0 + f1 * f1 + f2 * f2) AS s FROM m)
SELECT id, {', '.join(f'round(p{k} + coalesce(f{k} * CASE WHEN s > 1.0 THEN 1.0 / s ELSE 1 END, 0), 6) + 0.0 AS p{k}' for k in range(3))} FROM cloud LEFT JOIN n USING (id)""")
def spring_step(spark: SparkSession, d: str) -> DataFrame:
    cloud = P.cloud_from_events(spark, d)
    links = C.cone_links(cloud, RADIUS, offsets=True).withColumn("rest", F.lit(3.0))
    return _rounded(meanshift.spring_step(cloud, links, 1.0, 1.0).select("id", "p0", "p1", "p2"))


def _step_sql(ratio: float, across: float, alpha: float, gamma: float, turn: bool, bw: float = BW, cloud: str = "cloud", pairs: str = "pairs") -> str:
    """``(id, p*, d*, energy, linearity)`` after a step, from the pairs within its longest reach or more."""
    wide, narrow = (ratio * bw) ** 2, bw**2
    moved = ", ".join(f"damp * CASE WHEN sz > 1e-8 THEN n{k} / sz ELSE d{k} END + (1 - damp) * d{k} AS x{k}" for k in range(3)) if turn else "d0 AS x0, d1 AS x1, d2 AS x2"
    return f"""SELECT id, {', '.join(f'p{k} + e{k} - al * d{k} AS p{k}' for k in range(3))}, {', '.join(f'x{k} / CASE WHEN sqrt(x0 * x0 + x1 * x1 + x2 * x2) > 1e-8 THEN sqrt(x0 * x0 + x1 * x1 + x2 * x2) ELSE 1 END AS d{k}' for k in range(3))}, energy, linearity FROM
(SELECT *, {moved} FROM (SELECT *, e0 * d0 + e1 * d1 + e2 * d2 AS al, sqrt(n0 * n0 + n1 * n1 + n2 * n2) AS sz, 1 - (abs(wt) / (w + 1e-12)) ^ {gamma} AS damp FROM
(SELECT id, p0, p1, p2, d0, d1, d2, energy, linearity, coalesce(w, 0) AS w, coalesce(wt, 0) AS wt, {', '.join(f'CASE WHEN w > 1e-12 THEN m{k} / w - p{k} ELSE 0 END AS e{k}, coalesce(n{k}, 0) AS n{k}' for k in range(3))} FROM {cloud} LEFT JOIN
(SELECT a_id AS id, sum(w) AS w, sum(w * sign(t)) AS wt, {', '.join(f'sum(w * b_p{k}) AS m{k}, sum(w * side * b_d{k}) AS n{k}' for k in range(3))} FROM
(SELECT *, CASE WHEN a_d0 * b_d0 + a_d1 * b_d1 + a_d2 * b_d2 < 0 THEN -1.0 ELSE 1.0 END AS side, CASE WHEN t * t / {wide} + greatest(d2 - t * t, 0) / {narrow} <= 1 THEN exp(-(t * t / (2 * {wide}) + {across} * greatest(d2 - t * t, 0) / (2 * {narrow}))) * abs(a_d0 * b_d0 + a_d1 * b_d1 + a_d2 * b_d2) ^ {alpha} ELSE 0 END AS w FROM
(SELECT *, {_ALONG} AS t FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d2, b_id) AS rk FROM {pairs} WHERE d2 <= {(max(ratio, 1.0) * bw) ** 2}) WHERE rk <= 128)) GROUP BY a_id) USING (id))))"""


def _numbered_pairs(table: str, radius: float, n: int) -> str:
    """``pairs_sql`` under names of its own."""
    out = pairs_sql(table, radius)
    for old, new in (("g AS (SELECT *", f"g{n} AS (SELECT *"), ("FROM g a,", f"FROM g{n} a,"), ("o AS (SELECT a.*", f"o{n} AS (SELECT a.*"), ("FROM o a JOIN g b", f"FROM o{n} a JOIN g{n} b"), ("pairs AS (SELECT", f"pairs{n} AS (SELECT")):
        out = out.replace(old, new)
    return out


_VARIANTS = {"full": (2.0, 2.0, 2.0, 0.1, True), "without_anisotropy": (1.0, 1.0, 0.0, 0.1, True), "without_turning": (2.0, 2.0, 2.0, 0.1, False), "without_damping": (2.0, 2.0, 2.0, 0.0, True)}


@_query(f"WITH {CLOUD_EV}, {pairs_sql('cloud', 2 * BW)} " + " UNION ALL ".join(f"SELECT '{n}' AS variant, id, {', '.join(f'round({c}{k}, 5) + 0.0 AS {c}{k}' for c in 'pd' for k in range(3))} FROM ({_step_sql(*v)})" for n, v in _VARIANTS.items()))
def shift_variants(spark: SparkSession, d: str) -> DataFrame:
    """A step of each variant that changes the step; the others change the schedule or the links. All take their neighbours from one join."""
    cloud, out = P.cloud_from_events(spark, d), None
    variants = {name: meanshift.ablated(meanshift.ShiftParameters(), name) for name in _VARIANTS}
    near = stored(meanshift.step_neighbours(cloud, BW, *variants.values()), "near")
    for name, p in variants.items():
        step = _rounded(meanshift.shift_step(cloud, BW, p, near).select(F.lit(name).alias("variant"), "id", *(f"{c}{k}" for c in "pd" for k in range(3))), 5)
        out = step if out is None else out.unionByName(step)
    return out


_FULL = _VARIANTS["full"]
_LOOP_BW = [2.5, 2.5 * 0.6**0.5, 1.5]


def _spring_sql(n: int) -> str:
    """Cloud ``m{n}`` after its links have pulled, as ``t{n}``."""
    return f"""e{n} AS (SELECT links.a, links.b, rest, {', '.join(f'y.p{k} - x.p{k} AS e{k}' for k in range(3))} FROM links JOIN m{n} x ON x.id = links.a JOIN m{n} y ON y.id = links.b), l{n} AS (SELECT *, sqrt(e0 * e0 + e1 * e1 + e2 * e2) AS len FROM e{n}),
f{n} AS (SELECT a AS id, {', '.join(f'(len - rest) * e{k} / len AS f{k}' for k in range(3))} FROM l{n} WHERE len > 1e-9 UNION ALL SELECT b, {', '.join(f'-(len - rest) * e{k} / len' for k in range(3))} FROM l{n} WHERE len > 1e-9),
v{n} AS (SELECT *, sqrt(f0 * f0 + f1 * f1 + f2 * f2) AS s FROM (SELECT id, {', '.join(f'avg(f{k}) AS f{k}' for k in range(3))} FROM f{n} GROUP BY id)),
t{n} AS (SELECT m.id, {', '.join(f'm.p{k} + coalesce(f{k} * CASE WHEN s > 5.0 THEN 5.0 / s ELSE 1 END, 0) AS p{k}' for k in range(3))}, d0, d1, d2, energy, linearity FROM m{n} m LEFT JOIN v{n} ON v{n}.id = m.id)"""


@_query(f"""WITH {CLOUD_EV}, {_numbered_pairs('cloud', 2 * _LOOP_BW[0], 0)}, t1 AS ({_step_sql(*_FULL, _LOOP_BW[0], 'cloud', 'pairs0')}), {_numbered_pairs('t1', RADIUS, 1)},
links AS (SELECT a_id AS a, b_id AS b, sqrt(d2) AS rest FROM pairs1 WHERE a_id < b_id AND d2 > 0 AND ({_LEAN('a')} OR {_LEAN('b')})),
m2 AS ({_step_sql(*_FULL, _LOOP_BW[1], 't1', 'pairs1')}), {_spring_sql(2)}, {_numbered_pairs('t2', 2 * _LOOP_BW[2], 2)}, m3 AS ({_step_sql(*_FULL, _LOOP_BW[2], 't2', 'pairs2')}), {_spring_sql(3)}
SELECT id, {', '.join(f'round({c}{k}, 4) + 0.0 AS {c}{k}' for c in 'pd' for k in range(3))}, round(energy, 4) + 0.0 AS energy, round(linearity, 4) + 0.0 AS linearity FROM t3""")
def mean_shift_loop(spark: SparkSession, d: str) -> DataFrame:
    p = meanshift.ShiftParameters(steps=3, first=2.5, last=1.5, lock_at=1, reach=5.0)
    return _rounded(meanshift.mean_shift(P.cloud_from_events(spark, d), p), 4)


# --- graphs -------------------------------------------------------------------

LINK = 2.0
COMPONENTS = f"""WITH RECURSIVE {CLOUD_EV}, {pairs_sql('cloud', LINK)}, r AS (SELECT id, id AS w FROM cloud UNION SELECT r.id, p.b_id FROM r JOIN pairs p ON r.w = p.a_id), c AS (SELECT id, min(w) AS component FROM r GROUP BY id),
s AS (SELECT component, count(*) AS size FROM c GROUP BY component), l AS (SELECT component, size, row_number() OVER (ORDER BY size DESC, component) - 1 AS label FROM s)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The cloud, and its edges stored, as components, forests and what is kept of them all ask for these."""
    cloud = P.cloud_from_events(spark, d)
    return cloud, stored(graph.proximity_edges(cloud, LINK), "edges")


@_query(f"{COMPONENTS} SELECT id, component, size, label FROM c JOIN l USING (component)")
def proximity_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.labelled_components(*_graph(spark, d)).withColumn("label", F.col("label").cast("long"))


@_query(f"{COMPONENTS} SELECT component, size, label FROM l WHERE size >= 2")
def component_relabel(spark: SparkSession, d: str) -> DataFrame:
    return graph.labelled_components(*_graph(spark, d), least=2).select("component", "size", F.col("label").cast("long").alias("label")).distinct()


@_query(f"{COMPONENTS} SELECT a_id AS u, b_id AS v, round(sqrt(d2), 6) AS w FROM pairs JOIN c ON a_id = id JOIN l USING (component) WHERE a_id < b_id AND label = 0")
def keep_largest_component(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.keep_largest(*_graph(spark, d)))


@_query(f"{COMPONENTS} SELECT a_id AS u, b_id AS v FROM pairs JOIN c ON a_id = id WHERE a_id < b_id AND component <> (SELECT component FROM c WHERE id = 7)")
def click_delete_component(spark: SparkSession, d: str) -> DataFrame:
    return graph.delete_component(*_graph(spark, d), 7).select("u", "v")


@_query(f"{COMPONENTS} SELECT a_id AS u, b_id AS v FROM pairs JOIN c ON a_id = id JOIN l USING (component) WHERE a_id < b_id AND size >= 3")
def prune_small_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.prune_small(*_graph(spark, d), 3).select("u", "v")


@_query(f"WITH {CLOUD_EV}, {pairs_sql('cloud', LINK)} SELECT id, coalesce(n, 0) AS degree, coalesce(n, 0) = 1 AS is_leaf FROM cloud LEFT JOIN (SELECT a_id AS id, count(*) AS n FROM pairs GROUP BY 1) USING (id)")
def degree_leaves(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(*_graph(spark, d))


@_query(f"{COMPONENTS} SELECT component, size - 1 AS tree_edges FROM l WHERE size > 1")
def mst_edges_per_component(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    tree = graph.spanning_forest(edges)
    named = graph.labelled_components(nodes, edges).select(F.col("id").alias("u"), "component")
    return tree.join(named, "u").groupBy("component").agg(F.count("*").alias("tree_edges"))


@_query(f"""{COMPONENTS}, e AS (SELECT row_number() OVER (ORDER BY d2, a_id, b_id) AS n, a_id AS u, b_id AS v, sqrt(d2) AS w FROM pairs WHERE a_id < b_id), both_ AS (SELECT n, u, v FROM e UNION ALL SELECT n, v, u FROM e),
reach AS (SELECT n, v AS goal, u AS at_ FROM e UNION SELECT r.n, r.goal, b.v FROM reach r JOIN both_ b ON b.u = r.at_ AND b.n < r.n WHERE r.at_ <> r.goal)
SELECT u, v, round(w, 6) + 0.0 AS w FROM e WHERE n NOT IN (SELECT n FROM reach WHERE at_ = goal)""")
def mst_edges(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.spanning_forest(_graph(spark, d)[1]))


@_query(f"""{COMPONENTS}, e AS (SELECT row_number() OVER (ORDER BY d2, a_id, b_id) AS n, a_id AS u, b_id AS v, sqrt(d2) AS w FROM pairs WHERE a_id < b_id), both_ AS (SELECT n, u, v FROM e UNION ALL SELECT n, v, u FROM e),
reach AS (SELECT n, v AS goal, u AS at_ FROM e UNION SELECT r.n, r.goal, b.v FROM reach r JOIN both_ b ON b.u = r.at_ AND b.n < r.n WHERE r.at_ <> r.goal), tree AS (SELECT u, v, w FROM e WHERE n NOT IN (SELECT n FROM reach WHERE at_ = goal)),
arcs AS (SELECT u AS a, v AS b, w FROM tree UNION ALL SELECT v, u, w FROM tree), d1 AS (SELECT component, component AS node, CAST(0 AS DOUBLE) AS d, CAST(-1 AS BIGINT) AS prev FROM l WHERE size > 1 UNION ALL SELECT component, b, d + w, node FROM d1 JOIN arcs ON a = node AND b <> prev),
a1 AS (SELECT component, node FROM d1 QUALIFY row_number() OVER (PARTITION BY component ORDER BY round(d, 9) DESC, node) = 1),
d2_ AS (SELECT component, node, CAST(0 AS DOUBLE) AS d, CAST(-1 AS BIGINT) AS prev, [node] AS path FROM a1 UNION ALL SELECT component, b, d + w, node, list_append(path, b) FROM d2_ JOIN arcs ON a = node AND b <> prev),
b1 AS (SELECT component, path FROM d2_ QUALIFY row_number() OVER (PARTITION BY component ORDER BY round(d, 9) DESC, node) = 1)
SELECT component, unnest(range(0, len(path))) AS k, unnest(path) AS id FROM b1""")
def tree_diameter(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return trees.longest_paths(graph.spanning_forest(edges), graph.labelled_components(nodes, edges, 2)).select("component", "k", "id")


@_query()
def peel_paths(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return trees.peeled_paths(graph.spanning_forest(edges), graph.labelled_components(nodes, edges, 2), 1.0)


@_query(f"""WITH {CLOUD_EV}, {pairs_sql('cloud', 3.0)}, h AS (SELECT a_id AS id, count(*) AS n3, count(*) FILTER (d2 <= 4) AS n2 FROM pairs GROUP BY a_id) SELECT id FROM h WHERE n3 >= 3 AND n2 < 3""")
def junction_diff(spark: SparkSession, d: str) -> DataFrame:
    cloud = P.cloud_from_events(spark, d)
    pairs = stored(C.neighbours(cloud.select("id", "p0", "p1", "p2"), 3.0, half=True).select(F.col("a_id").alias("u"), F.col("b_id").alias("v"), "d2"), "pairs")
    return edits.new_junctions(pairs.where("d2 <= 4"), pairs)


# --- curves -------------------------------------------------------------------

STEP = "st AS (SELECT *, coalesce(sqrt((p0 - lag(p0) OVER o) ^ 2 + (p1 - lag(p1) OVER o) ^ 2 + (p2 - lag(p2) OVER o) ^ 2), 0) AS step FROM curve WINDOW o AS (PARTITION BY sid ORDER BY k)), al AS (SELECT *, sum(step) OVER (PARTITION BY sid ORDER BY k) AS s FROM st)"


@_query(f"WITH {CURVE}, {STEP} SELECT sid, k, round(s, 4) AS s FROM al")
def arc_length(spark: SparkSession, d: str) -> DataFrame:
    return V.arc_length(P.curves_from_events(spark, d)).select("sid", "k", F.round("s", 4).alias("s"))


@_query(f"WITH {CURVE}, {STEP} SELECT sid, count(*) AS n, round(sum(step), 4) AS length FROM al GROUP BY sid")
def polyline_length(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.total_length(P.curves_from_events(spark, d)), 4)


SEGS = f"WITH {CURVE}, {STEP}, sg AS (SELECT *, lead(s) OVER o AS s1, lead(p0) OVER o AS q0, lead(p1) OVER o AS q1, lead(p2) OVER o AS q2, max(s) OVER (PARTITION BY sid) AS total FROM al WINDOW o AS (PARTITION BY sid ORDER BY k))"


def _resampled(n: str) -> str:
    return f"""{SEGS}, tg AS (SELECT sid, total, n, j, CASE WHEN j = n - 1 THEN total ELSE total * j / (n - 1) END AS t FROM (SELECT sid, total, n, unnest(range(0, n)) AS j FROM (SELECT DISTINCT sid, total, CAST({n} AS BIGINT) AS n FROM sg WHERE total > 0))),
hit AS (SELECT g.sid, j, least(greatest((t - s) / (s1 - s), 0), 1) AS u, p0, p1, p2, q0, q1, q2 FROM tg g JOIN sg ON g.sid = sg.sid AND s1 > s AND ((t >= s AND t < s1 AND j < n - 1) OR (j = n - 1 AND s1 >= sg.total)))
SELECT sid, j AS k, {', '.join(f'round(p{i} + u * (q{i} - p{i}), 3) + 0.0 AS p{i}' for i in range(3))} FROM hit"""


@_query(_resampled("20"))
def resample_linear(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.resample(P.curves_from_events(spark, d), points=20), 3)


@_query(_resampled("greatest(round_even(total / 100.0, 0), 2)"))
def resample_density(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.resample(P.curves_from_events(spark, d), spacing=100.0), 3)


@_query(f"""{SEGS}, tn AS (SELECT *, {', '.join(f'(coalesce(lead(p{i}) OVER o, p{i}) - coalesce(lag(p{i}) OVER o, p{i})) / nullif(coalesce(lead(s) OVER o, s) - coalesce(lag(s) OVER o, s), 0) AS t{i}' for i in range(3))} FROM sg WINDOW o AS (PARTITION BY sid ORDER BY k)),
tv AS (SELECT *, {', '.join(f'lead(t{i}) OVER o AS v{i}' for i in range(3))} FROM tn WINDOW o AS (PARTITION BY sid ORDER BY k)),
tg AS (SELECT sid, total, n, j, CASE WHEN j = n - 1 THEN total ELSE total * j / (n - 1) END AS t FROM (SELECT sid, total, n, unnest(range(0, n)) AS j FROM (SELECT DISTINCT sid, total, CAST(greatest(round_even(total / 100.0, 0) + 1, 4) AS BIGINT) AS n FROM sg WHERE total > 0))),
hit AS (SELECT g.sid, j, s1 - s AS h, least(greatest((t - s) / (s1 - s), 0), 1) AS u, {', '.join(f'p{i}, q{i}, t{i}, v{i}' for i in range(3))} FROM tg g JOIN tv ON g.sid = tv.sid AND s1 > s AND ((t >= s AND t < s1 AND j < n - 1) OR (j = n - 1 AND s1 >= tv.total)))
SELECT sid, j AS k, {', '.join(f'round((2 * u ^ 3 - 3 * u ^ 2 + 1) * p{i} + (u ^ 3 - 2 * u ^ 2 + u) * h * t{i} + (3 * u ^ 2 - 2 * u ^ 3) * q{i} + (u ^ 3 - u ^ 2) * h * v{i}, 3) + 0.0 AS p{i}' for i in range(3))} FROM hit""")
def resample_hermite(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.resample_hermite(P.curves_from_events(spark, d), 100.0), 3)


@_query(f"WITH {CURVE} SELECT sid, k, round(coalesce(sqrt({' + '.join(f'(lead(p{i}) OVER o - 2 * p{i} + lag(p{i}) OVER o) ^ 2' for i in range(3))}), 0), 4) AS kappa FROM curve WINDOW o AS (PARTITION BY sid ORDER BY k)")
def curvature(spark: SparkSession, d: str) -> DataFrame:
    return V.curvature(P.curves_from_events(spark, d)).select("sid", "k", F.round("kappa", 4).alias("kappa"))


TURN = f"""WITH {CURVE}, ch AS (SELECT *, count(*) OVER (PARTITION BY sid) AS n, {', '.join(f'p{i} - lag(p{i}, 3) OVER o AS x{i}, lead(p{i}, 3) OVER o - p{i} AS y{i}' for i in range(3))} FROM curve WINDOW o AS (PARTITION BY sid ORDER BY k)),
nn AS (SELECT *, sqrt(x0 ^ 2 + x1 ^ 2 + x2 ^ 2) AS nx, sqrt(y0 ^ 2 + y1 ^ 2 + y2 ^ 2) AS ny FROM ch),
an AS (SELECT *, coalesce(CASE WHEN nx >= 1e-8 AND ny >= 1e-8 THEN degrees(acos(greatest(-1, least(1, (x0 * y0 + x1 * y1 + x2 * y2) / (nx * ny))))) END, 0) AS angle FROM nn)"""


@_query(f"{TURN} SELECT sid, k, round(angle, 3) AS angle FROM an")
def turn_angles(spark: SparkSession, d: str) -> DataFrame:
    return V.turn_angles(P.curves_from_events(spark, d)).select("sid", "k", F.round("angle", 3).alias("angle"))


@_query(f"""{TURN}, ct AS (SELECT *, k >= 3 AND k < n - 3 AS inner_, max(CASE WHEN k >= 3 AND k < n - 3 THEN angle END) OVER (PARTITION BY sid ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS most FROM an),
pc AS (SELECT sid, k, cut, sum(cut) OVER (PARTITION BY sid ORDER BY k) AS piece FROM (SELECT sid, k, CASE WHEN inner_ AND angle > 90 AND angle >= most - 1e-9 THEN 1 ELSE 0 END AS cut FROM ct)),
al AS (SELECT sid, k, CAST(piece AS BIGINT) AS piece FROM pc UNION ALL SELECT sid, k, CAST(piece - 1 AS BIGINT) FROM pc WHERE cut = 1)
SELECT sid, piece, count(*) AS n, min(k) AS first_k, max(k) AS last_k FROM al GROUP BY sid, piece HAVING count(*) >= 3""")
def turn_angle_split(spark: SparkSession, d: str) -> DataFrame:
    pieces = V.split_at_turns(P.curves_from_events(spark, d), 90.0)
    return pieces.groupBy("sid", "piece").agg(F.count("*").alias("n"), F.min("k").alias("first_k"), F.max("k").alias("last_k"))


@_query(f"""WITH {CURVE}, {STEP}, tt AS (SELECT *, max(s) OVER (PARTITION BY sid) AS total FROM al), ii AS (SELECT *, s >= least(500.0, 0.45 * total) AND total - s >= least(500.0, 0.45 * total) AS ins FROM tt),
kk AS (SELECT *, count(*) FILTER (ins) OVER (PARTITION BY sid) AS kept FROM ii) SELECT sid, k FROM kk WHERE kept < 4 OR ins""")
def trim_ends(spark: SparkSession, d: str) -> DataFrame:
    return V.trim_ends(P.curves_from_events(spark, d), 500.0).select("sid", "k")


@_query(f"""WITH {CURVE}, tn AS (SELECT sid, k, {', '.join(f'coalesce(lead(p{i}) OVER o, p{i}) - coalesce(lag(p{i}) OVER o, p{i}) AS t{i}' for i in range(3))} FROM curve WINDOW o AS (PARTITION BY sid ORDER BY k)), ts AS (SELECT *, sqrt(t0 ^ 2 + t1 ^ 2 + t2 ^ 2) AS z FROM tn)
SELECT sid, k, {', '.join(f'round(CASE WHEN z > 1e-12 THEN t{i} / z ELSE 0 END, 6) + 0.0 AS t{i}' for i in range(3))} FROM ts""")
def central_tangent(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.central_tangents(P.curves_from_events(spark, d)).select("sid", "k", "t0", "t1", "t2"))


@_query(f"""WITH {CURVE}, nn AS (SELECT sid, k, p1, count(*) OVER (PARTITION BY sid) AS n FROM curve), ww AS (SELECT unnest(range(-8, 9)) AS i), tot AS (SELECT sum(exp(-0.5 * (i / 2.0) ^ 2)) AS w FROM ww),
ask AS (SELECT sid, k, exp(-0.5 * (i / 2.0) ^ 2) / tot.w AS w, ((k + i) % (2 * n) + 2 * n) % (2 * n) AS at_, n FROM nn, ww, tot)
SELECT a.sid, a.k, round(sum(a.w * c.p1), 4) AS p1 FROM ask a JOIN nn c ON a.sid = c.sid AND c.k = CASE WHEN at_ < a.n THEN at_ ELSE 2 * a.n - 1 - at_ END GROUP BY a.sid, a.k""")
def gauss_smooth(spark: SparkSession, d: str) -> DataFrame:
    return V.gaussian_smooth(P.curves_from_events(spark, d), ["p1"], 2.0).select("sid", "k", F.round("p1", 4).alias("p1"))


@_query(f"""WITH {SIGNAL}, y AS (SELECT sid, k, x - avg(x) OVER (PARTITION BY sid) AS y FROM sig), l AS (SELECT unnest(range(0, 9)) AS lag), s AS (SELECT a.sid, lag, sum(a.y * b.y) AS s FROM y a, l, y b WHERE a.sid = b.sid AND b.k = a.k + lag GROUP BY 1, 2),
z AS (SELECT y.sid, lag, sum(y * y) AS s0 FROM y, l GROUP BY 1, 2) SELECT z.sid, CAST(z.lag AS INTEGER) AS lag, round(coalesce(s, 0) / s0, 6) + 0.0 AS r FROM z LEFT JOIN s ON z.sid = s.sid AND z.lag = s.lag""")
def autocorr_bounded(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.autocorrelation(P.signal_from_lines(spark, d), 8))


@_query(f"WITH {SIGNAL} SELECT sid, k, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 5) + 0.0 AS z FROM sig WINDOW w AS (PARTITION BY sid)")
def zscore(spark: SparkSession, d: str) -> DataFrame:
    return V.z_scores(P.signal_from_lines(spark, d)).select("sid", "k", (F.round("z", 5) + 0.0).alias("z"))


@_query(f"WITH {SIGNAL}, t AS (SELECT k AS o, x AS y FROM sig WHERE sid = 1 AND k < 8) SELECT sid, k - o AS start, round(corr(x, y), 5) + 0.0 AS r FROM sig, t WHERE k >= o GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM t)")
def sliding_pearson(spark: SparkSession, d: str) -> DataFrame:
    signal = P.signal_from_lines(spark, d)
    return _rounded(V.sliding_correlation(signal, signal.where("sid = 1 and k < 8").select("k", "x")), 5)


@_query("WITH e AS (SELECT o_orderpriority AS g, o_orderkey AS id, exp(-(o_totalprice - min(o_totalprice) OVER (PARTITION BY o_orderpriority)) / 50000.0) AS e FROM orders) SELECT g, id, round(e / sum(e) OVER (PARTITION BY g), 9) AS rate FROM e")
def softmax_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = P.read(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("rms"))
    return V.softmax_rates(rows, "g", temperature=50000.0).select("g", "id", F.round("rate", 9).alias("rate"))


@_query(f"""WITH {CURVE}, e AS (SELECT sid, {', '.join(f'arg_min(p{i}, k) AS a{i}, arg_max(p{i}, k) AS b{i}' for i in range(3))} FROM curve GROUP BY sid), c AS (SELECT *, sqrt({' + '.join(f'(b{i} - a{i}) ^ 2' for i in range(3))}) AS h FROM e), u AS (SELECT *, unnest(range(0, 8)) AS k FROM c), w AS (SELECT *, k / 7.0 AS u FROM u)
SELECT sid, CAST(k AS INTEGER) AS k, {', '.join(f'round((1 - u) ^ 3 * a{i} + 3 * (1 - u) ^ 2 * u * (a{i} + 0.4 * h * {int(i == 0)}) + 3 * (1 - u) * u ^ 2 * (b{i} + 0.4 * h * {int(i == 1)}) + u ^ 3 * b{i}, 4) + 0.0 AS p{i}' for i in range(3))} FROM w""")
def bezier_bridge(spark: SparkSession, d: str) -> DataFrame:
    curves = P.curves_from_events(spark, d)
    ends = curves.groupBy("sid").agg(*(f(f"p{i}", "k").alias(f"{n}{i}") for i in range(3) for f, n in ((F.min_by, "a"), (F.max_by, "b"))))
    ends = ends.withColumns({f"s{i}": F.lit(float(i == 0)) for i in range(3)} | {f"t{i}": F.lit(float(i == 1)) for i in range(3)})
    return _rounded(V.bezier_bridge(ends, 8), 4)


@_query(f"""WITH {CURVE}, sg AS (SELECT sid, k, p1 AS x0, 500 * p2 AS y0, lead(p1) OVER o AS x1, 500 * lead(p2) OVER o AS y1 FROM curve WINDOW o AS (PARTITION BY sid ORDER BY k)), s AS (SELECT * FROM sg WHERE x1 IS NOT NULL),
c AS (SELECT a.sid, a.k, b.k AS j, (a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0) AS den, b.x0 - a.x0 AS ox, b.y0 - a.y0 AS oy, a.x1 - a.x0 AS ax, a.y1 - a.y0 AS ay, b.x1 - b.x0 AS bx, b.y1 - b.y0 AS by_ FROM s a JOIN s b ON a.sid = b.sid AND a.k + 1 < b.k),
t AS (SELECT sid, k, j, (ox * by_ - oy * bx) / den AS t, (ox * ay - oy * ax) / den AS u FROM c WHERE den <> 0) SELECT sid, k, j, round(t, 5) AS t, round(u, 5) AS u FROM t WHERE t > 0 AND t < 1 AND u > 0 AND u < 1""")
def segment_crossings(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("sid").orderBy("k")
    rows = P.curves_from_events(spark, d).select("sid", "k", F.col("p1").alias("x0"), (500 * F.col("p2")).alias("y0"), F.lead("p1").over(by).alias("x1"), (500 * F.lead("p2").over(by)).alias("y1"))
    return _rounded(knots.crossings(rows.where("x1 is not null")), 5)


@_query()
def knot_determinant(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(knots.knot_determinants(P.curves_from_events(spark, d)), 6)


@_query("SELECT s.s_suppkey AS sid, place, behind FROM (SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS place, round(s_acctbal - min(s_acctbal) OVER (PARTITION BY s_nationkey), 4) AS behind FROM supplier) s")
def rank_min_score(spark: SparkSession, d: str) -> DataFrame:
    rows = knots.ranked(P.read(spark, d, "supplier"), "s_nationkey", "s_acctbal")
    return rows.select(F.col("s_suppkey").alias("sid"), F.col("place").cast("long").alias("place"), F.round("behind", 4).alias("behind"))


# --- shapes, geometry, rods -----------------------------------------------------


@_query(f"""WITH {CURVE}, pr AS (SELECT a.sid, {', '.join(f'a.p{i} AS a{i}, b.p{i} AS b{i}' for i in range(3))} FROM curve a JOIN curve b ON b.sid = a.sid + 1 AND b.k = a.k),
st AS (SELECT sid, count(*) AS n, {', '.join(f'regr_sxy(a{i}, b{j}) AS c{i}{j}' for i in range(3) for j in range(3))}, {' + '.join(f'coalesce(var_pop({c}{i}), 0)' for c in 'ab' for i in range(3))} AS spread FROM pr GROUP BY sid),
g AS (SELECT *, c00 * (c11 * c22 - c12 * c21) - c01 * (c10 * c22 - c12 * c20) + c02 * (c10 * c21 - c11 * c20) AS det, {', '.join(f'{" + ".join(f"c{r}{i} * c{r}{j}" for r in range(3))} AS {n}' for i, j, n in ((0, 0, 'xx'), (0, 1, 'xy'), (0, 2, 'xz'), (1, 1, 'yy'), (1, 2, 'yz'), (2, 2, 'zz')))} FROM st),
q AS (SELECT *, (xx + yy + zz) / 3 AS m FROM g), p AS (SELECT *, sqrt(((xx - m) ^ 2 + (yy - m) ^ 2 + (zz - m) ^ 2 + 2 * (xy ^ 2 + xz ^ 2 + yz ^ 2)) / 6) AS p FROM q),
r AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1, least(1, ((xx - m) * ((yy - m) * (zz - m) - yz ^ 2) - xy * (xy * (zz - m) - yz * xz) + xz * (xy * yz - (yy - m) * xz)) / (2 * p ^ 3)))) / 3 ELSE 0 END AS f FROM p),
l AS (SELECT *, sqrt(greatest(m + 2 * p * cos(f), 0)) AS s0, sqrt(greatest(m + 2 * p * cos(f + 4 * pi() / 3), 0)) AS s1 FROM r)
SELECT sid, n, round(sqrt(greatest(n * spread - 2 * (s0 + s1 + CASE WHEN s0 * s1 > 0 THEN det / (s0 * s1) ELSE 0 END), 0) / n), 2) AS rms FROM l""")
def rigid_fit(spark: SparkSession, d: str) -> DataFrame:
    curves = P.curves_from_events(spark, d)
    other = curves.select((F.col("sid") - 1).alias("sid"), "k", *(F.col(f"p{i}").alias(f"b{i}") for i in range(3)))
    pairs = curves.select("sid", "k", *(F.col(f"p{i}").alias(f"a{i}") for i in range(3))).join(other, ["sid", "k"])
    return signals.rigid_fit(pairs, "sid").select("sid", "n", F.round("rms", 2).alias("rms"))


@_query()
def template_segments(spark: SparkSession, d: str) -> DataFrame:
    shape = [tuple(r) for r in P.curves_from_events(spark, d).where("sid = 1 and k < 10").orderBy("k").select("p0", "p1", "p2").collect()]
    return _rounded(signals.segment_by_template(P.curves_from_events(spark, d), shape, most=1e6), 3)


def warp_sql(source: str, template: tuple[float, ...]) -> str:
    """Recursive CTE ``warp (sid, k, cost, start)``: a column of the warping table a step, its cells one after the other."""
    m = len(template)
    first = ", ".join([f"{' + '.join(f'abs({t} - x)' for t in template[: i + 1])} AS d{i}, CAST(0 AS BIGINT) AS s{i}" for i in range(m)])
    rows = f"(SELECT c.*, z.x AS nx, z.k AS nk FROM cells c JOIN {source} z ON z.sid = c.sid AND z.k = c.k + 1)"
    rows = f"(SELECT *, abs({template[0]} - nx) AS e0, nk AS f0 FROM {rows})"
    for i in range(1, m):
        rows = f"(SELECT *, abs({template[i]} - nx) + least(d{i - 1}, e{i - 1}, d{i}) AS e{i}, CASE WHEN least(d{i - 1}, e{i - 1}) <= d{i} THEN CASE WHEN d{i - 1} <= e{i - 1} THEN s{i - 1} ELSE f{i - 1} END ELSE s{i} END AS f{i} FROM {rows})"
    return f"cells AS (SELECT sid, k, {first} FROM {source} WHERE k = 0 UNION ALL SELECT sid, nk, {', '.join(f'e{i}, f{i}' for i in range(m))} FROM {rows}), warp AS (SELECT sid, k, d{m - 1} AS cost, s{m - 1} AS start FROM cells)"


@_query(f"WITH RECURSIVE {SIGNAL}, {warp_sql('sig', (10000.0, 30000.0, 50000.0, 20000.0))} SELECT sid, start, k AS stop, round(cost, 2) + 0.0 AS cost FROM warp QUALIFY row_number() OVER (PARTITION BY sid ORDER BY cost, k) = 1")
def warped_stretch(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signals.subsequence_warping(P.signal_from_lines(spark, d), [10_000.0, 30_000.0, 50_000.0, 20_000.0]), 2)


@_query(f"""WITH RECURSIVE {SIGNAL}, z AS (SELECT sid, k, coalesce((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 0) AS x FROM sig WINDOW w AS (PARTITION BY sid)), {warp_sql('z', (-1.0, 0.0, 1.0, -0.5))},
dp AS (SELECT sid, CAST(0 AS BIGINT) AS j, [0.0::DOUBLE] AS f, CAST([] AS BIGINT[]) AS b FROM z WHERE k = 0 UNION ALL
       SELECT sid, j + 1, list_append(f, CASE WHEN take THEN c ELSE g END), list_append(b, CASE WHEN take THEN start ELSE -1 END) FROM (SELECT *, fits AND c < g AS take FROM (SELECT dp.sid, j, f, b, start, f[j + 1] + 0.8 AS g, f[start + 1] + cost AS c, k - start + 1 BETWEEN 3 AND 6 AS fits FROM dp JOIN warp w ON w.sid = dp.sid AND w.k = dp.j))),
e AS (SELECT sid, max(j) AS n, arg_max(f, j) AS f, arg_max(b, j) AS b FROM dp GROUP BY sid),
bt AS (SELECT sid, n AS at_, b, CAST(NULL AS BIGINT) AS start, CAST(NULL AS BIGINT) AS stop FROM e UNION ALL SELECT sid, CASE WHEN b[at_] = -1 THEN at_ - 1 ELSE b[at_] END, b, CASE WHEN b[at_] <> -1 THEN b[at_] END, CASE WHEN b[at_] <> -1 THEN at_ - 1 END FROM bt WHERE at_ > 0),
gp AS (SELECT sid, count(*) - 1 - count(start) AS gaps FROM bt GROUP BY sid)
SELECT bt.sid, row_number() OVER (PARTITION BY bt.sid ORDER BY bt.start) - 1 AS segment, bt.start, bt.stop, round(w.cost, 6) + 0.0 AS cost, round(e.f[e.n + 1], 6) + 0.0 AS total, gaps FROM bt JOIN warp w ON w.sid = bt.sid AND w.k = bt.stop JOIN e ON e.sid = bt.sid JOIN gp ON gp.sid = bt.sid WHERE bt.start IS NOT NULL""")
def hidden_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every signal's stretches that a template warps onto, and gaps between them, at the least cost."""
    z = V.z_scores(P.signal_from_lines(spark, d))
    return _rounded(signals.hidden_segments(z.select("sid", "k", F.col("z").alias("x")), [-1.0, 0.0, 1.0, -0.5]))


@_query(f"""WITH RECURSIVE {SIGNAL}, nb AS (SELECT *, lag(x) OVER o AS l, lead(x) OVER o AS r FROM sig WINDOW o AS (PARTITION BY sid ORDER BY k)), pk AS (SELECT sid, k, x FROM nb WHERE x > l AND x >= r AND x >= 50000.0),
rk AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY x DESC, k) AS r FROM pk),
g AS (SELECT DISTINCT sid, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS ks FROM pk UNION ALL SELECT g.sid, rk.r, CASE WHEN len(ks) < 10 AND len(list_filter(ks, lambda a: abs(a - k) < 5)) = 0 THEN list_append(ks, k) ELSE ks END FROM g JOIN rk ON rk.sid = g.sid AND rk.r = g.r + 1),
l AS (SELECT sid, unnest(arg_max(ks, r)) AS k FROM g GROUP BY sid)
SELECT l.sid, l.k, x AS value FROM l JOIN sig USING (sid, k)""")
def signal_peaks(spark: SparkSession, d: str) -> DataFrame:
    return signals.peaks(P.signal_from_lines(spark, d), "x", 50_000.0, 5, 10)


@_query(f"""WITH {CURVE}, nn AS (SELECT *, count(*) OVER (PARTITION BY sid) AS n FROM curve), ww AS (SELECT unnest(range(-12, 13)) AS i), tot AS (SELECT sum(exp(-0.5 * (i / 3.0) ^ 2)) AS w FROM ww),
ask AS (SELECT sid, k, n, exp(-0.5 * (i / 3.0) ^ 2) / tot.w AS w, ((k + i) % (2 * n) + 2 * n) % (2 * n) AS at_ FROM nn, ww, tot),
sm AS (SELECT a.sid, a.k, any_value(a.n) AS n, {', '.join(f'sum(a.w * c.p{i}) AS p{i}' for i in range(3))} FROM ask a JOIN nn c ON a.sid = c.sid AND c.k = CASE WHEN at_ < a.n THEN at_ ELSE 2 * a.n - 1 - at_ END GROUP BY a.sid, a.k),
ti AS (SELECT *, {', '.join(f'(lead(p{i}) OVER o - lag(p{i}) OVER o) / 2 AS u{i}' for i in range(3))} FROM sm WINDOW o AS (PARTITION BY sid ORDER BY k)),
t AS (SELECT *, {', '.join(f'coalesce(u{i}, lead(u{i}) OVER o, lag(u{i}) OVER o, 0) AS t{i}' for i in range(3))} FROM ti WINDOW o AS (PARTITION BY sid ORDER BY k)),
pr AS (SELECT a.sid, a.k AS i, b.k AS j, any_value(a.n) AS n, sum(((a.t1 * b.t2 - a.t2 * b.t1) * (a.p0 - b.p0) + (a.t2 * b.t0 - a.t0 * b.t2) * (a.p1 - b.p1) + (a.t0 * b.t1 - a.t1 * b.t0) * (a.p2 - b.p2)) / ((a.p0 - b.p0) ^ 2 + (a.p1 - b.p1) ^ 2 + (a.p2 - b.p2) ^ 2) ^ 1.5) AS v FROM t a JOIN t b ON a.sid = b.sid AND a.k <> b.k AND abs(a.k - b.k) <= 10 GROUP BY 1, 2, 3),
o AS (SELECT sid, k, n FROM t WHERE k >= 5 AND k < n - 5 AND n > 11), w AS (SELECT o.sid, o.k, sum(v) / (4 * pi()) AS writhe FROM o JOIN pr ON o.sid = pr.sid AND abs(i - o.k) <= 5 AND abs(j - o.k) <= 5 GROUP BY 1, 2)
SELECT t.sid, t.k, round(writhe, 6) + 0.0 AS writhe FROM t LEFT JOIN w USING (sid, k)""")
def local_writhe(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signals.local_writhe(P.curves_from_events(spark, d), 5))


@_query(f"""WITH {CLOUD_EV}, {UNIT}, t AS (SELECT CAST(p2 AS BIGINT) AS g, {', '.join(f'sum(d{i} * d{j} * energy) AS {n}' for i, j, n in ((0, 0, 'xx'), (0, 1, 'xy'), (0, 2, 'xz'), (1, 1, 'yy'), (1, 2, 'yz'), (2, 2, 'zz')))} FROM unit GROUP BY 1),
q AS (SELECT *, (xx + yy + zz) / 3 AS m FROM t), p AS (SELECT *, sqrt(((xx - m) ^ 2 + (yy - m) ^ 2 + (zz - m) ^ 2 + 2 * (xy ^ 2 + xz ^ 2 + yz ^ 2)) / 6) AS p FROM q),
r AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1, least(1, ((xx - m) * ((yy - m) * (zz - m) - yz ^ 2) - xy * (xy * (zz - m) - yz * xz) + xz * (xy * yz - (yy - m) * xz)) / (2 * p ^ 3)))) / 3 ELSE 0 END AS f FROM p),
l AS (SELECT g, m + 2 * p * cos(f + 2 * pi() / 3) + 1e-8 AS l0, m + 2 * p * cos(f + 4 * pi() / 3) + 1e-8 AS l1, m + 2 * p * cos(f) + 1e-8 AS l2 FROM r)
SELECT g, round(l0, 3) + 0.0 AS l0, round(l1, 3) + 0.0 AS l1, round(l2, 3) + 0.0 AS l2, round((l1 - l0) / (l1 + l0 + 1e-6), 5) + 0.0 AS linearity FROM l""")
def eigen_linearity(spark: SparkSession, d: str) -> DataFrame:
    cloud = C.normalise_directions(P.cloud_from_events(spark, d))
    outer = [F.sum(F.col(f"d{i}") * F.col(f"d{j}") * F.col("energy")).alias(n) for i, j, n in ((0, 0, "xx"), (0, 1, "xy"), (0, 2, "xz"), (1, 1, "yy"), (1, 2, "yz"), (2, 2, "zz"))]
    return signals.symmetric_eigen(cloud.withColumn("g", F.col("p2").cast("long")).groupBy("g").agg(*outer), "g").select("g", *((F.round(f"l{i}", 3) + 0.0).alias(f"l{i}") for i in range(3)), (F.round("linearity", 5) + 0.0).alias("linearity"))


_RMF = ", ".join
FRAME = f"""WITH RECURSIVE {CURVE}, {STEP}, gr AS (SELECT *, {_RMF(f'coalesce(lead(p{i}) OVER o, p{i}) - coalesce(lag(p{i}) OVER o, p{i}) AS g{i}' for i in range(3))}, count(*) OVER (PARTITION BY sid) AS n FROM al WINDOW o AS (PARTITION BY sid ORDER BY k)),
gn AS (SELECT *, CASE WHEN k = 0 OR k = n - 1 THEN 1.0 ELSE 0.5 END AS h FROM gr), gs AS (SELECT *, greatest(h * sqrt(g0 ^ 2 + g1 ^ 2 + g2 ^ 2), 1e-12) AS len FROM gn), tg AS (SELECT sid, k, s, p0, p1, p2, {_RMF(f'CASE WHEN n = 1 THEN {float(i == 0)} ELSE h * g{i} / len END AS t{i}' for i in range(3))} FROM gs),
sx AS (SELECT sid, k, CASE WHEN abs(t0) <= abs(t1) AND abs(t0) <= abs(t2) THEN 0 WHEN abs(t1) <= abs(t2) THEN -t2 ELSE t1 END AS c0, CASE WHEN abs(t0) <= abs(t1) AND abs(t0) <= abs(t2) THEN t2 WHEN abs(t1) <= abs(t2) THEN 0 ELSE -t0 END AS c1, CASE WHEN abs(t0) <= abs(t1) AND abs(t0) <= abs(t2) THEN -t1 WHEN abs(t1) <= abs(t2) THEN t0 ELSE 0 END AS c2 FROM tg WHERE k = 0),
fm AS (SELECT sid, k, {_RMF(f'CAST(c{i} / greatest(sqrt(c0 ^ 2 + c1 ^ 2 + c2 ^ 2), 1e-12) AS DOUBLE) AS n{i}' for i in range(3))} FROM sx UNION ALL
 SELECT sid, k + 1, {_RMF(f'CASE WHEN c < 1e-24 THEN n{i} WHEN c2 < 1e-24 THEN l{i} ELSE l{i} - 2 * (w0 * l0 + w1 * l1 + w2 * l2) / c2 * w{i} END' for i in range(3))} FROM (SELECT *, w0 * w0 + w1 * w1 + w2 * w2 AS c2 FROM (SELECT *, {_RMF(f'u{i} - (t{i} - 2 * vt / nullif(c, 0) * v{i}) AS w{i}, n{i} - 2 * vn / nullif(c, 0) * v{i} AS l{i}' for i in range(3))} FROM
 (SELECT *, v0 * v0 + v1 * v1 + v2 * v2 AS c, v0 * n0 + v1 * n1 + v2 * n2 AS vn, v0 * t0 + v1 * t1 + v2 * t2 AS vt FROM (SELECT f.sid, f.k, {_RMF(f'f.n{i} AS n{i}, a.t{i} AS t{i}, b.t{i} AS u{i}, b.p{i} - a.p{i} AS v{i}' for i in range(3))} FROM fm f JOIN tg a ON a.sid = f.sid AND a.k = f.k JOIN tg b ON b.sid = f.sid AND b.k = f.k + 1))))),
fr AS (SELECT tg.sid, tg.k, s, p0, p1, p2, t0, t1, t2, n0, n1, n2, t1 * n2 - t2 * n1 AS b0, t2 * n0 - t0 * n2 AS b1, t0 * n1 - t1 * n0 AS b2 FROM tg JOIN fm ON tg.sid = fm.sid AND tg.k = fm.k)"""


@_query(f"{FRAME} SELECT sid, k, {', '.join(f'round({c}{i}, 5) + 0.0 AS {c}{i}' for c in 'tnb' for i in range(3))} FROM fr")
def frames_along_curves(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(geometry.frames(P.curves_from_events(spark, d)), 5)


@_query(f"{FRAME}, h AS (SELECT *, 2 * pi() * s / 300 + 2 * pi() * ply / 4 AS th FROM fr, (SELECT unnest(range(0, 4)) AS ply)) SELECT sid, CAST(ply AS INTEGER) AS ply, k, {', '.join(f'round(p{i} + 16 * (cos(th) * n{i} + sin(th) * b{i}), 3) + 0.0 AS p{i}' for i in range(3))} FROM h")
def ply_helix(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(geometry.plies(geometry.framed(P.curves_from_events(spark, d)), 4, 300.0, 16.0), 3)


@_query(f"""{FRAME}, h AS (SELECT *, fibre * pi() * (3 - sqrt(5)) AS ps FROM fr, (SELECT unnest(range(0, 3)) AS fibre)), t AS (SELECT *, 2 * pi() * s / 80 + ps AS th FROM h), r AS (SELECT *, 6 * sqrt((fibre + 0.5) / 3) * (0.7 + 0.15 * (cos(th + ps) + 1)) AS rr FROM t)
SELECT sid, CAST(fibre AS INTEGER) AS fibre, k, {', '.join(f'round(p{i} + rr * (cos(th) * n{i} + sin(th) * b{i}), 3) + 0.0 AS p{i}' for i in range(3))} FROM r""")
def fibre_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(geometry.fibres(geometry.framed(P.curves_from_events(spark, d)), 3, 80.0, 6.0, 0.3), 3)


@_query(f"""WITH {CURVE}, n AS (SELECT sid, count(*) AS n FROM curve GROUP BY sid HAVING count(*) > 1), q AS (SELECT sid, i, j FROM (SELECT sid, unnest(range(0, n - 1)) AS i FROM n), (SELECT unnest(range(0, 6)) AS j)), v AS (SELECT sid, i * 6 + j AS a, i * 6 + (j + 1) % 6 AS b FROM q)
SELECT sid, 2 * a AS face, a, b, a + 6 AS c FROM v UNION ALL SELECT sid, 2 * a + 1, b, b + 6, a + 6 FROM v""")
def tube_faces(spark: SparkSession, d: str) -> DataFrame:
    return geometry.tube_faces(P.curves_from_events(spark, d), 6)


@_query(f"""WITH {CLOUD_EV}, dirs AS (SELECT i AS direction, sqrt(1 - ((i + 0.5) / 25) ^ 2) * cos(2 * pi() * i / ((1 + sqrt(5)) / 2)) AS x, sqrt(1 - ((i + 0.5) / 25) ^ 2) * sin(2 * pi() * i / ((1 + sqrt(5)) / 2)) AS y, (i + 0.5) / 25 AS z FROM (SELECT unnest(range(0, 25)) AS i))
SELECT id, CAST(direction AS BIGINT) AS direction, round(lean, 6) AS lean FROM (SELECT id, direction, round(abs(d0 * x + d1 * y + d2 * z), 9) AS lean FROM cloud, dirs) QUALIFY row_number() OVER (PARTITION BY id ORDER BY lean DESC, direction) = 1""")
def fibonacci_dirs(spark: SparkSession, d: str) -> DataFrame:
    """The direction of the bank that each point leans to."""
    return _rounded(geometry.nearest_direction(P.cloud_from_events(spark, d), 25))


KB = f"""WITH {CURVE}, e AS (SELECT sid, k, {', '.join(f'p{i} - lag(p{i}) OVER o AS e{i}, lead(p{i}) OVER o - p{i} AS g{i}' for i in range(3))} FROM curve WINDOW o AS (PARTITION BY sid ORDER BY k)),
l AS (SELECT *, sqrt(e0 ^ 2 + e1 ^ 2 + e2 ^ 2) AS le, sqrt(g0 ^ 2 + g1 ^ 2 + g2 ^ 2) AS lg FROM e WHERE e0 IS NOT NULL AND g0 IS NOT NULL), kb AS (SELECT sid, k, (le + lg) / 2 AS vor, 2 / (le * lg + e0 * g0 + e1 * g1 + e2 * g2 + 1e-12) AS sc, e1 * g2 - e2 * g1 AS x0, e2 * g0 - e0 * g2 AS x1, e0 * g1 - e1 * g0 AS x2 FROM l)"""


@_query(f"{KB} SELECT sid, k, round(vor, 4) AS vor FROM kb")
def rest_curvature(spark: SparkSession, d: str) -> DataFrame:
    return rod.rest_curvature(P.curves_from_events(spark, d)).select("sid", "k", F.round("vor", 4).alias("vor"))


@_query(f"{KB} SELECT sid, round(log10(1 + sum(0.5 * 300 * (sc * sc * (x0 ^ 2 + x1 ^ 2 + x2 ^ 2)) / greatest(vor, 1e-9))), 4) AS energy FROM kb GROUP BY sid")
def bend_energy(spark: SparkSession, d: str) -> DataFrame:
    curves = P.curves_from_events(spark, d)
    flat = rod.rest_curvature(curves).withColumns({f"kb{i}": F.lit(0.0) for i in range(3)})
    return rod.bending_energy(curves, flat, 300.0).select("sid", F.round(F.log10(1 + F.col("energy")), 4).alias("energy"))


@_query(f"""WITH {CURVE}, e AS (SELECT *, {', '.join(f'lead(p{i}) OVER o - p{i} AS e{i}' for i in range(3))} FROM curve WINDOW o AS (PARTITION BY sid ORDER BY k)), l AS (SELECT *, sqrt(e0 ^ 2 + e1 ^ 2 + e2 ^ 2) + 1e-12 AS len FROM e),
a AS (SELECT *, {', '.join(f'coalesce(10.0 * (len - 50) / 50 * e{i} / len, 0) AS a{i}' for i in range(3))} FROM l)
SELECT sid, k, {', '.join(f'round(a{i} - coalesce(lag(a{i}) OVER o, 0)' + (' - 9.81 + 100.0 * greatest(0.75 - p2, 0)' if i == 2 else '') + f', 5) + 0.0 AS f{i}' for i in range(3))} FROM a WINDOW o AS (PARTITION BY sid ORDER BY k)""")
def ground_forces(spark: SparkSession, d: str) -> DataFrame:
    p = rod.RodParameters(stretch=10.0, contact=100.0, gravity=-9.81, radius=0.25)
    return _rounded(rod.stretch_and_ground_forces(P.curves_from_events(spark, d), 50.0, 0.5, 1.0, p), 5)


@_query(f"""WITH {VOLUME}, r AS (SELECT unnest(range(-3, 4)) AS i), o AS (SELECT a.i AS dz, b.i AS dy, c.i AS dx, exp(-(a.i ^ 2 + b.i ^ 2 + c.i ^ 2) / 2.0) AS w FROM r a, r b, r c), q AS (SELECT dz, dy, dx, w / sum(w) OVER () AS w FROM o),
h AS (SELECT k, (k + 0.5) / 8 AS hz, 2 * pi() * k / ((1 + sqrt(5)) / 2) AS angle FROM (SELECT unnest(range(0, 8)) AS k)), d AS (SELECT k, sqrt(1 - hz * hz) * cos(angle) AS x, sqrt(1 - hz * hz) * sin(angle) AS y, hz AS z FROM h),
kn AS (SELECT k, dz, dy, dx, w * cos(2 * pi() * 0.2 * (d.x * dx + d.y * dy + d.z * dz)) AS re, w * sin(2 * pi() * 0.2 * (d.x * dx + d.y * dy + d.z * dz)) AS im FROM q, d), n AS (SELECT sample, max(z) AS nz, max(y) AS ny, max(x) AS nx FROM vol GROUP BY sample),
a AS (SELECT sample, z + dz AS z, y + dy AS y, x + dx AS x, k, sum(v * re) AS re, sum(v * im) AS im FROM vol, kn GROUP BY ALL), p AS (SELECT a.sample, a.z, a.y, a.x, d.x AS ux, d.y AS uy, d.z AS uz, re * re + im * im AS p FROM a JOIN d USING (k) JOIN n USING (sample) WHERE a.z BETWEEN 0 AND nz AND a.y BETWEEN 0 AND ny AND a.x BETWEEN 0 AND nx)
SELECT sample, z, y, x, {', '.join(f'round(sum(p * u{i} * u{j}), -4) + 0.0 AS {i}{j}' for i, j in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))}, round(sum(sqrt(p)), 2) AS energy FROM p GROUP BY 1, 2, 3, 4""")
def gabor_tensor(spark: SparkSession, d: str) -> DataFrame:
    """Responses at all voxels, of a small bank of filters with a reach of three."""
    found = filters.structure_tensors(P.volume_from_lines(spark, d), directions=8, sigma=1.0, frequency=0.2, reach=3, edge=16)
    return _rounded(_rounded(found.withColumns({c: F.round(c, -4) for c in filters.TENSOR}), 2), 2)


@_query(f"""WITH {VOLUME}, w AS (SELECT unnest(range(-2, 3)) AS i), n AS (SELECT i, exp(-0.5 * i ^ 2) / (SELECT sum(exp(-0.5 * i ^ 2)) FROM w) AS g FROM w),
a AS (SELECT sample, z + i AS z, y, x, sum(v * g) AS v FROM vol, n GROUP BY 1, 2, 3, 4), b AS (SELECT sample, z, y + i AS y, x, sum(v * g) AS v FROM a, n GROUP BY 1, 2, 3, 4), c AS (SELECT sample, z, y, x + i AS x, sum(v * g) AS v FROM b, n GROUP BY 1, 2, 3, 4)
SELECT sample, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(c.v, 2) AS v FROM c SEMI JOIN vol USING (sample, z, y, x)""")
def gaussian_volume(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(filters.gaussian_volume(P.volume_from_lines(spark, d), 1.0), 2)


@_query()
def volume_cloud(spark: SparkSession, d: str) -> DataFrame:
    """From the volume to the oriented cloud, by a small bank of filters."""
    found = filters.oriented_cloud(P.volume_from_lines(spark, d), energy=1000.0, linearity=0.01, sigma=1.0, directions=8, frequency=0.2, reach=3, edge=16)
    return _rounded(found, 3)


@_query()
def slice_radii(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(volume.slice_radii(P.volume_from_lines(spark, d)))


@_query(f"""WITH {CURVE}, ks AS (SELECT *, max(k) OVER (PARTITION BY sid) AS last FROM curve), ev AS (SELECT DISTINCT sid AS a, sid + 1 AS b, sid + 1000000 AS new FROM curve WHERE sid % 2 = 0),
ea AS (SELECT new, {', '.join(f'max(p{i}) FILTER (k = last) AS a{i}, coalesce(max(p{i}) FILTER (k = last) - max(p{i}) FILTER (k = last - 1), 0) AS x{i}' for i in range(3))} FROM ks JOIN ev ON sid = a GROUP BY new),
eb AS (SELECT new, {', '.join(f'max(p{i}) FILTER (k = 0) AS b{i}, coalesce(max(p{i}) FILTER (k = 0) - max(p{i}) FILTER (k = 1), 0) AS y{i}' for i in range(3))} FROM ks JOIN ev ON sid = b GROUP BY new),
en AS (SELECT *, sqrt({' + '.join(f'(b{i} - a{i}) ^ 2' for i in range(3))}) AS h, sqrt(x0 ^ 2 + x1 ^ 2 + x2 ^ 2) AS nx, sqrt(y0 ^ 2 + y1 ^ 2 + y2 ^ 2) AS ny FROM ea JOIN eb USING (new)),
br AS (SELECT *, j / 15.0 AS u FROM en, (SELECT unnest(range(1, 15)) AS j)),
parts AS (SELECT new AS sid, 0 AS part, k AS at_, p0, p1, p2 FROM curve JOIN ev ON sid = a
 UNION ALL SELECT new, 1, j, {', '.join(f'(1 - u) ^ 3 * a{i} + 3 * (1 - u) ^ 2 * u * (a{i} + 0.4 * h * CASE WHEN nx > 1e-12 THEN x{i} / nx ELSE 0 END) + 3 * (1 - u) * u ^ 2 * (b{i} + 0.4 * h * CASE WHEN ny > 1e-12 THEN y{i} / ny ELSE 0 END) + u ^ 3 * b{i}' for i in range(3))} FROM br
 UNION ALL SELECT new, 2, k, p0, p1, p2 FROM curve JOIN ev ON sid = b),
made AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY part, at_) - 1 AS k, p0, p1, p2 FROM parts)
SELECT sid, k, {', '.join(f'round(p{i}, 4) + 0.0 AS p{i}' for i in range(3))} FROM (SELECT sid, k, p0, p1, p2 FROM curve WHERE sid NOT IN (SELECT a FROM ev UNION ALL SELECT b FROM ev) UNION ALL SELECT * FROM made)""")
def joined_curves(spark: SparkSession, d: str) -> DataFrame:
    curves = P.curves_from_events(spark, d)
    sids = curves.select("sid").distinct().where("sid % 2 = 0")
    joins = sids.select(F.col("sid").alias("a"), F.lit(1).alias("a_end"), (F.col("sid") + 1).alias("b"), F.lit(0).alias("b_end"), (F.col("sid") + 1_000_000).alias("new_sid"))
    return _rounded(joining.join_ends(curves, joins), 4)


@_query()
def spline_fit(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fitting.fit_curves(P.curves_from_events(spark, d), 500.0, 50.0), 3)


@_query()
def curves_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    even = V.resample(P.curves_from_events(spark, d), points=60)
    return _rounded(fitting.without_repeats(even, 0.4, 0.01), 3)


def _noise_sql(scale: float) -> str:
    """The noise field, corner by corner; the permutation is what its seed makes."""
    table = noise.lattice_table(0).tolist()
    slopes = [f"CASE h {' '.join(f'WHEN {k} THEN {g[i]}' for k, g in enumerate(noise.GRADIENTS))} END" for i in range(3)]
    weight = " * ".join(f"CASE WHEN c{i} = 1 THEN e{i} ELSE 1 - e{i} END" for i in range(3))
    return f"""WITH {CURVE}, t AS (SELECT {table} AS perm), ch AS (SELECT sid, k, p0, p1, p2, ch, {', '.join(f'p{i} * {scale} + at_ AS x{i}' for i in range(3))} FROM curve, (SELECT unnest(range(0, 3)) AS ch, unnest({list(noise.CHANNELS)}) AS at_)),
f AS (SELECT *, {', '.join(f'CAST(floor(x{i}) AS BIGINT) AS i{i}, x{i} - floor(x{i}) AS f{i}' for i in range(3))} FROM ch), g AS (SELECT *, {', '.join(f'f{i} ^ 3 * (f{i} * (f{i} * 6 - 15) + 10) AS e{i}' for i in range(3))} FROM f),
co AS (SELECT *, perm[1 + ((perm[1 + ((perm[1 + ((i0 + c0) & 255)] + i1 + c1) & 255)] + i2 + c2) & 255)] % 12 AS h FROM g, t, (SELECT unnest([0, 1]) AS c0), (SELECT unnest([0, 1]) AS c1), (SELECT unnest([0, 1]) AS c2)),
n AS (SELECT sid, k, any_value(p0) AS p0, any_value(p1) AS p1, any_value(p2) AS p2, {', '.join(f'sum(CASE WHEN ch = {c} THEN s ELSE 0 END) AS n{c}' for c in range(3))} FROM (SELECT *, ({' + '.join(f'({slopes[i]}) * (f{i} - c{i})' for i in range(3))}) * {weight} AS s FROM co) GROUP BY sid, k)"""


@_query(f"{_noise_sql(0.02)} SELECT sid, k, {', '.join(f'round(p{i} + 3.0 * n{i}, 5) + 0.0 AS p{i}' for i in range(3))} FROM n")
def perlin_warp(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(noise.warped(P.curves_from_events(spark, d), 0.02, 3.0), 5)


@_query()
def flyaways(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(noise.hairs(P.curves_from_events(spark, d), 1000.0, 20.0), 4)


# --- inputs, logs and edits -------------------------------------------------------


@_query("""WITH f AS (SELECT p_partkey AS id, p_name || '_pointcloud_' || CASE WHEN p_size % 2 = 0 THEN 'full' ELSE 'sub' END AS name FROM part), b AS (SELECT *, CASE WHEN contains(lower(name), 'full') THEN 0 WHEN contains(lower(name), 'a') THEN 1 ELSE 2 END AS bucket FROM f)
SELECT id, name, bucket, row_number() OVER (ORDER BY bucket, name, id) AS place FROM b""")
def priority_order(spark: SparkSession, d: str) -> DataFrame:
    return files.priority_order(P.manifest(spark, d), ["full", "a"]).select("id", "name", "bucket", F.col("place").cast("long").alias("place"))


@_query("""WITH f AS (SELECT p_partkey AS id, p_name AS stem, CASE WHEN p_size % 2 = 0 THEN 'full' ELSE 'sub' END AS kind FROM part)
SELECT stem, stem || '_pointcloud_' || kind AS name, id FROM f QUALIFY row_number() OVER (PARTITION BY stem ORDER BY CASE kind WHEN 'full' THEN 0 ELSE 1 END, id) = 1""")
def prefer_full(spark: SparkSession, d: str) -> DataFrame:
    return files.prefer(P.manifest(spark, d), "full", "sub")


@_query("SELECT c_custkey AS sample, n IS NOT NULL AS found, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) USING (c_custkey)")
def sample_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    return files.wanted_and_missing(P.run_log(spark, d), P.read(spark, d, "customer").select(F.col("c_custkey").alias("sample")))


@_query("SELECT c_custkey AS sample, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def pending_outputs(spark: SparkSession, d: str) -> DataFrame:
    return files.pending(P.read(spark, d, "customer").select(F.col("c_custkey").alias("sample"), "c_name"), P.run_log(spark, d).where("stage = '1-URGENT'"))


@_query("WITH e AS (SELECT o_orderpriority AS stage, o_orderstatus AS status, count(*) AS runs, round(sum(o_totalprice), 2) AS bytes FROM orders GROUP BY 1, 2) SELECT stage, status, runs, bytes, round(runs / sum(runs) OVER (PARTITION BY stage), 6) AS share FROM e")
def run_log_totals(spark: SparkSession, d: str) -> DataFrame:
    return files.run_totals(P.run_log(spark, d)).select("stage", "status", "runs", F.round("bytes", 2).alias("bytes"), F.round("share", 6).alias("share"))


@_query(f"WITH {LOG} SELECT sid, g1, kind, row_number() OVER (PARTITION BY sid ORDER BY ts DESC, g1 DESC) AS depth FROM log QUALIFY depth <= 10")
def undo_stack(spark: SparkSession, d: str) -> DataFrame:
    return edits.undo_stack(P.repair_log(spark, d)).select("sid", "g1", "kind", F.col("depth").cast("long").alias("depth"))


@_query(f"WITH {LOG} SELECT sid, max(g1) AS version, arg_max(n_synth, g1) AS n_synth FROM (SELECT *, CASE WHEN n_synth < 20 THEN 'delete' ELSE kind END AS k2 FROM log) GROUP BY sid HAVING arg_max(k2, g1) <> 'delete'")
def undo_replay(spark: SparkSession, d: str) -> DataFrame:
    log = P.repair_log(spark, d).select(F.col("sid").alias("id"), F.col("g1").alias("version"), F.when(F.col("n_synth") < 20, "delete").otherwise(F.col("kind")).alias("kind"), "n_synth")
    return edits.replay(log).select(F.col("id").alias("sid"), "version", "n_synth")


@_query(f"""WITH {LOG}, g AS (SELECT *, date_diff('microsecond', lag(ts) OVER o, ts) / 1e6 AS gap FROM log WINDOW o AS (PARTITION BY sid ORDER BY ts, g1)), s AS (SELECT *, CASE WHEN gap IS NULL OR gap > 36000 THEN 1 ELSE 0 END AS st FROM g),
n AS (SELECT *, sum(st) OVER (PARTITION BY sid ORDER BY ts, g1) AS session FROM s)
SELECT sid, CAST(session AS BIGINT) AS session, count(*) AS edits, CAST(count(*) FILTER (kind = 'B') AS BIGINT) AS connects, CAST(sum(n_synth) AS BIGINT) AS synthetic, round(sum(CASE WHEN st = 0 THEN gap ELSE 0 END), 3) AS active_s FROM n GROUP BY 1, 2""")
def repair_sessions(spark: SparkSession, d: str) -> DataFrame:
    return edits.sessions(P.repair_log(spark, d), 600).select("sid", "session", "edits", "connects", "synthetic", F.round("active_s", 3).alias("active_s"))


@_query(f"WITH {CURVE} SELECT sid AS region, {', '.join(f'round(min(p{i}) - 12, 6) AS lo{i}, round(max(p{i}) + 12, 6) AS hi{i}' for i in range(3))} FROM curve GROUP BY sid")
def break_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(edits.break_boxes(P.curves_from_events(spark, d).withColumnRenamed("sid", "region")))


@_query(f"WITH {LOG} SELECT sid, kind, ts AS last, g1, n_synth FROM log QUALIFY row_number() OVER (PARTITION BY sid ORDER BY ts DESC, kind DESC, g1 DESC) = 1".replace("ts AS last", "CAST(ts AS VARCHAR) AS last"))
def newest_version(spark: SparkSession, d: str) -> DataFrame:
    found = files.newest(P.repair_log(spark, d).select("sid", "ts", "kind", "g1", "n_synth"), "sid", "ts")
    return found.select("sid", "kind", F.col("ts").cast("string").alias("last"), "g1", "n_synth")


@_query(f"""WITH {CLOUD_EV}, {pairs_sql('cloud', RADIUS, strict=True)}, near AS (SELECT a_id, count(*) AS n, avg(CASE WHEN abs(a_d0 * b_d0 + a_d1 * b_d1 + a_d2 * b_d2) >= 0.85 THEN 1.0 ELSE 0.0 END) AS degree FROM pairs GROUP BY a_id)
SELECT CAST(p2 AS BIGINT) AS user_id, count(*) AS points, coalesce(sum(n), 0)::BIGINT AS links, round(avg(coalesce(degree, 0)), 6) AS degree FROM cloud LEFT JOIN near ON id = a_id WHERE energy > 20 GROUP BY 1""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Coherence of each user's points: the neighbour join, the united degree and a summary."""
    cloud = P.cloud_from_events(spark, d)
    degree = C.united_degree(cloud, RADIUS, keep=("p2", "energy"))
    return degree.where("energy > 20").groupBy(F.col("p2").cast("long").alias("user_id")).agg(F.count("*").alias("points"), F.sum("n").alias("links"), F.round(F.avg("degree"), 6).alias("degree"))


from curvespark.plans import more_queries  # noqa: E402, F401  adds its own to both tables
