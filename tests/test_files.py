"""Array files, saved sessions and packed adjacency: round trips and what other programs write."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvespark.operators import states
from curvespark.plans.lineage import ordered
from curvespark.sources import arrays, files

CURVES = "sample string, sid long, k long, p0 double, p1 double, p2 double"


def test_curves_round_trip(spark, tmp_path):
    rows = [("a", s, k, s + 0.5, float(k), -1.0) for s in (3, 7, 11) for k in range(4)] + [("b", 5, k, 0.0, float(k), 2.0) for k in range(3)]
    written = files.write_curves(spark.createDataFrame(rows, CURVES), str(tmp_path / "c"))
    assert {(r.sample, r.curves) for r in written.collect()} == {("a", 3), ("b", 1)}
    with np.load(tmp_path / "c" / "b.npz") as found:
        assert "yarn" in found.files and int(found["n_curves"]) == 1 and str(found["fmt"]) == "yarn_state_v1"
    got = sorted(map(tuple, files.read_curves(spark, str(tmp_path / "c")).collect()))
    number = {("a", 3): 0, ("a", 7): 1, ("a", 11): 2, ("b", 5): 0}
    assert got == sorted((s, number[s, i], *rest) for s, i, *rest in rows)


def test_any_array_of_three_columns_is_a_curve(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    np.savez(tmp_path / "deep" / "x.npz", line=np.arange(12).reshape(4, 3), other=np.zeros(5), one=np.zeros((1, 3)))
    assert [r.p1 for r in files.read_curves(spark, str(tmp_path)).orderBy("k").collect()] == [1.0, 4.0, 7.0, 10.0]
    np.savez(tmp_path / "deep" / "y.npz", other=np.zeros(5))
    with pytest.raises(Exception, match="y: no curve"):
        files.read_curves(spark, str(tmp_path)).collect()


def test_possibilities(spark, tmp_path):
    np.savez(tmp_path / "p.npz", n_poss=2, fmt="yarn_possibilities_v1", p0_n=1, p0_c0=np.zeros((2, 3)), p0_combo=[0, 1], p1_n=2, p1_c0=np.ones((2, 3)), p1_c1=np.full((3, 3), 2.0), p1_combo=[1, 1])
    np.savez(tmp_path / "q.npz", curve_0=np.zeros((2, 3)))
    got = files.read_possibilities(spark, str(tmp_path)).groupBy("sample", "choice", "ways", "sid").agg(F.count("*").alias("n"), F.max("p0").alias("p")).collect()
    assert {tuple(r) for r in got} == {("p", 0, "0,1", 0, 2, 0.0), ("p", 1, "1,1", 0, 2, 1.0), ("p", 1, "1,1", 1, 3, 2.0)}


def test_templates(spark, tmp_path):
    np.save(tmp_path / "one.npy", np.array([[0, 0, 0], [3, 4, 0], [3, 4, 12]]))
    (tmp_path / "library.json").write_text(json.dumps([{"name": "first", "npy": "one.npy", "color": [1, 0, 0]}, {"name": "gone", "npy": "two.npy", "color": [0, 0, 0]}]))
    named, points = files.read_templates(spark, str(tmp_path / "library.json"))
    assert [(r.template, list(r.color), r.length) for r in named.collect()] == [("first", [1.0, 0.0, 0.0], 17.0)] and points.count() == 3


def test_clouds_and_volumes_round_trip(spark, tmp_path):
    rows = [(s, k, float(k), 1.0, 2.0, 0.0, 0.0, 2.0, 10.0 * k, 0.5) for s in "xy" for k in range(5)]
    cloud = spark.createDataFrame(rows, "sample string, id long, p0 double, p1 double, p2 double, d0 double, d1 double, d2 double, energy double, linearity double")
    assert files.write_clouds(cloud.where("id <> 2"), str(tmp_path / "c")).agg(F.sum("points")).first()[0] == 8
    arrays.register(spark)
    got = spark.read.format("npz").load(str(tmp_path / "c")).where("sample = 'x'").orderBy("id").collect()
    assert [(r.p0, r.d2, r.energy) for r in got] == [(0.0, 1.0, 0.0), (1.0, 1.0, 10.0), (3.0, 1.0, 30.0), (4.0, 1.0, 40.0)]
    volume = spark.createDataFrame([("v", 0, 1, 2, 7.4), ("v", 2, 3, 1, 70_000.0)], "sample string, z int, y int, x int, v double")
    files.write_volumes(volume, str(tmp_path / "v"))
    assert arrays.parse_nrrd((tmp_path / "v" / "v.nrrd").read_bytes()).shape == (3, 4, 3)
    assert sorted(tuple(r) for r in spark.read.format("nrrd").load(str(tmp_path / "v")).collect()) == [("v", 0, 1, 2, 7.0), ("v", 2, 3, 1, 65_535.0)]


def test_extractions(spark, tmp_path):
    segments = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 11, 31), (2, 0, 5, 45)], "sid int, segment int, start int, stop int")
    files.save_extraction(segments, str(tmp_path / "e"), 99.0)
    again, expected = files.load_extraction(spark, str(tmp_path / "e"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, segments.collect())) and expected == 20.0
    files.save_extraction(segments.limit(0), str(tmp_path / "n"), 99.0)
    assert files.load_extraction(spark, str(tmp_path / "n"))[1] == 99.0
    curves = spark.createDataFrame([(1, k, float(k), 0.0, 0.0) for k in range(40)], "sid int, k long, p0 double, p1 double, p2 double")
    got = files.span(curves, segments.where("sid = 1 and segment = 1").withColumn("template", F.lit("t"))).orderBy("k").collect()
    assert [r.p0 for r in got] == [float(x) for x in range(11, 32)] and got[0].k == 0


def test_packed_adjacency(spark):
    rng = random.Random(1)
    edges = {tuple(sorted(rng.sample(range(0, 900, 3), 2))) for _ in range(300)}
    keys, neighbours = states.packed_adjacency(spark.createDataFrame([(*e, 1.0) for e in edges], "u long, v long, w double"))
    k, n = [tuple(r) for r in keys.orderBy("place").collect()], [r.node for r in neighbours.orderBy("position").collect()]
    want = {}
    for u, v in edges:
        want.setdefault(u, set()).add(v)
        want.setdefault(v, set()).add(u)
    assert [x[1] for x in k] == sorted(want) and [x[0] for x in k] == list(range(len(k)))
    assert all(n[start:stop] == sorted(want[key]) for _, key, start, stop in k) and k[0][2] == 0 and k[-1][3] == len(n)
    assert {tuple(r) for r in states.unpacked_adjacency(keys, neighbours).collect()} == edges


def test_sessions_are_resumed(spark, tmp_path):
    cloud = spark.createDataFrame([(k, float(k), 0.0, 0.0) for k in range(6)], "id long, p0 double, p1 double, p2 double")
    tree = spark.createDataFrame([(k, k + 1, 1.0) for k in range(6)], "u long, v long, w double")
    point = "id long, p0 double, p1 double, p2 double"
    parts = {"extras": spark.createDataFrame([(6, 5.0, 3.0, 0.0)], point), "overrides": spark.createDataFrame([(2, 2.0, 9.0, 0.0)], point), "deleted": spark.createDataFrame([(4,)], "id long")}
    assert states.load_state(spark, str(tmp_path / "s"), ["a"]) is None
    states.save_state(str(tmp_path / "s"), "a", "2024", tree)
    states.save_state(str(tmp_path / "s"), "a", "2025", tree, **parts)
    points, left = states.resumed(cloud, states.load_state(spark, str(tmp_path / "s"), ["none", "a"]))
    assert {(r.id, r.p1) for r in points.collect()} == {(0, 0.0), (1, 0.0), (2, 9.0), (3, 0.0), (5, 0.0), (6, 3.0)}
    assert {(r.u, r.v, round(r.w, 6)) for r in left.collect()} == {(0, 1, 1.0), (1, 2, round(82**0.5, 6)), (2, 3, round(82**0.5, 6)), (5, 6, 3.0)}
    full = cloud.withColumn("energy", F.lit(1.0))
    assert "energy" in states.saved_points(full, cloud).columns and "energy" not in states.saved_points(full, points).columns


def test_rows_are_numbered_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")).repartition(5)
    got = ordered(rows, ["x"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1000)) and [r.x for r in got] == sorted(r.x for r in got)
    assert ordered(rows.limit(0), ["x"], "n").count() == 0
