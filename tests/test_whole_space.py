"""Distance joins at any latitude and across the date line, the configuration that keeps static heat, and scan files."""

import math
import random

import pytest
from pyspark.sql import functions as F

from emberglass.constants import sweep_configs
from emberglass.operators import egress, spatial
from emberglass.plans import base, catalogue
from emberglass.plans import spatial as plans
from emberglass.sources import files
from emberglass.storage import Scratch


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("lat, lon", [(0, 0), (60, 10), (75, -30), (-80, 179.9), (20, 180), (89.5, 0)])
def test_threats_and_reach_by_brute_force(spark, lat, lon):
    rng = random.Random(lat)

    def near():
        a = max(-90.0, min(90.0, lat + rng.uniform(-0.6, 0.6)))
        return a, (lon + rng.uniform(-0.6, 0.6) / max(0.02, math.cos(math.radians(a))) + 180) % 360 - 180

    assets, fires = [(k, *near()) for k in range(120)], [(k, *near(), rng.choice([0.0, 1.0, 40.0])) for k in range(40)]
    got = spatial.threats(spark.createDataFrame(assets, "asset_id int, lat double, lon double"), spark.createDataFrame(fires, "fire_id int, flat double, flon double, radius_km double"))
    want = {(f, a) for a, x, y in assets for f, u, v, r in fires if km(x, y, u, v) - r <= 20}
    assert {(r["fire_id"], r["asset_id"]) for r in got.collect()} == want and want
    cells = spark.createDataFrame([(f, u, v, 1000.0 * (r + 3)) for f, u, v, r in fires], "cell_id int, clat double, clon double, range_m double")
    places = spark.createDataFrame([(a, x, y, 1) for a, x, y in assets], "sid int, lat double, lon double, population long")
    reach = {r["cell_id"]: r["covered"] for r in spatial.reach(cells, places, places.filter("sid < 0")).collect()}
    assert reach == {f: sum(km(x, y, u, v) <= r + 3 for _, x, y in assets) for f, u, v, r in fires}


def test_static_heat_counts_in_one_configuration_only(spark):
    det = spark.createDataFrame([(1, 10, "MTG_I1", 0.9, True), (2, 50, "MTG_I1", 0.9, False)], "id int, at_s int, source string, confidence double, static_heat boolean")
    pairs = spark.createDataFrame([(7, 1, 100.0), (7, 2, 100.0), (8, 1, 5.0)], "seg_id int, id int, distance_m double")
    got = {(r["config"], r["seg_id"]): (r["cut_s"], r["evidence"]) for r in spatial.cut_field(pairs, det, sweep_configs(spark)).collect()}
    assert got["all-1x-withstatic", 7] == (10, [1]) and got["all-1x-withstatic", 8] == (10, [1])
    assert got["all-1x", 7] == (50, [2]) and {c for c, s in got if s == 8} == {"all-1x-withstatic"}


def test_far_nodes_are_found(spark):
    points = spark.createDataFrame([(1, 10.0, 10.0), (2, -60.0, 170.0)], "point_id int, plat double, plon double")
    nodes = spark.createDataFrame([(5, 10.001, 10.0), (6, 40.0, 40.0)], "node_id int, lat double, lon double")
    got = {r["point_id"]: r["node_id"] for r in spatial.nearest_node(points, nodes, Scratch(spark, "t")).collect()}
    far = min((5, 6), key=lambda k: (({5: 10.001, 6: 40.0}[k] + 60) ** 2 + math.cos(math.radians(-60)) ** 2 * ({5: 10.0, 6: 40.0}[k] - 170) ** 2, k))
    assert got == {1: 5, 2: far}


@pytest.mark.parametrize("acquired, row, name, good", [("20240101000000", 5, "b", True), ("20240101001059", 5, "b", True), ("20240101001100", 5, "b", False), ("20231231235959", 5, "b", False), ("20240101000000", 11136, "b", False), ("20240101000000", 5, "a", False)])
def test_scans_are_half_open_and_on_the_grid(spark, tmp_path, acquired, row, name, good):
    head = "ACQTIME,ABS_LINE,ABS_SAMP,LONGITUDE,LATITUDE,FRP,FRP_UNCERTAINTY,FIRE_CONFIDENCE,PIXEL_SIZE\n"
    for folder, pixel in (("a", f"{acquired},{row},7,0,0,-1,,0.5,1\n"), (name, f"{acquired},{row},8,0,0,3,,0.5,1\n{acquired},{row},9,99,0,3,,0.5,1\n")):
        (tmp_path / folder).mkdir(exist_ok=True)
        file = tmp_path / folder / ("scan-20240101000000.csv" if folder == "a" or name == "a" else "scan-20240101000000-2.csv")
        file.write_text((file.read_text() if file.exists() else head) + pixel + (pixel if name == "a" else ""))
    read = lambda: sorted((r["col"], r["frp"]) for r in files.scans(spark, str(tmp_path), (-10, -10, 10, 10)).collect())
    if good:
        assert read() == [(7, None), (8, 3.0)]
    else:
        with pytest.raises(Exception, match="acquisition|grid|twice"):
            read()


def test_a_sweep_by_places_and_shapes_is_the_sweep_of_all_pairs(spark):
    rng = random.Random(4)
    places = [(37 + rng.uniform(0, 0.03), -2 + rng.uniform(0, 0.03)) for _ in range(6)]
    det = [(k, rng.randrange(9), rng.choice(["MTG_I1", "MODIS_NRT"]), rng.choice([None, 0.65, 0.9]), *places[rng.randrange(6)]) for k in range(600)]
    det = spark.createDataFrame(det, "id long, at_s long, source string, confidence double, lat double, lon double")
    ends = [(37.0, -2.0, 37.01, -1.99), (37.02, -1.98, 37.02, -1.98)]
    segments = spark.createDataFrame([(k, *ends[k % 2]) for k in range(40)], "seg_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    point = lambda a, b: F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon"))
    a, b = places[0]
    rings = spark.range(1).select(F.array(*[point(a + i, b + j) for i, j in ((-1e-4, -1e-4), (-1e-4, 1e-4), (1e-4, 1e-4), (1e-4, -1e-4))]).alias("ring"))
    flagged = spatial.flag_heat(det, rings)
    pairs = spatial.near_segments(segments, flagged, 2000.0, one_piece=True, carry=spatial.CARRIED)
    columns = ["config", "seg_id", "cut_s", "evidence"]
    want = sorted(map(tuple, spatial.cut_field(pairs, flagged, sweep_configs(spark)).select(*columns).collect()))
    cuts, members = spatial.sweep(segments, det, sweep_configs(spark), Scratch(spark, "t"), rings)
    assert sorted(map(tuple, cuts.join(members, "shape").select(*columns).collect())) == want and want
    assert {r["shape"] for r in cuts.collect()} == {0, 1}  # two shapes are met, not forty segments
    by_shape = spatial.family_rows(det, cuts, members=members).collect()
    assert sorted(map(tuple, by_shape)) == sorted(map(tuple, spatial.family_rows(det, cuts.join(members, "shape")).collect()))


def test_many_nodes_at_one_place_are_met_once(spark):
    nodes = spark.range(20_000).select((F.col("id") + 7).alias("node_id"), F.lit(10.0).alias("lat"), F.lit(10.0).alias("lon"))
    points = spark.range(20_000).select(F.col("id").alias("point_id"), (F.lit(10.0) + F.col("id") % 3 / F.lit(1000.0)).alias("plat"), F.lit(10.001).alias("plon"))
    got = spatial.nearest_node(points, nodes, Scratch(spark, "t"))  # 400 million pairs otherwise
    assert {tuple(r) for r in got.groupBy("node_id").count().collect()} == {(7, 20_000)}


def test_reach_adds_up_settlements_at_one_place_once(spark):
    cells = spark.range(20_000).select(F.col("id").alias("cell_id"), F.lit(10.0).alias("clat"), F.lit(10.0).alias("clon"), (F.lit(1000.0) + 500 * (F.col("id") % 2)).alias("range_m"))
    people = F.when(F.col("id") % 4 > 0, F.col("id") % 5 - 1).alias("population")
    places = spark.range(20_000).select(F.col("id").alias("sid"), F.lit(10.0).alias("lat"), F.lit(10.001).alias("lon"), people)
    got = spatial.reach(cells, places, places.filter("sid % 7 = 0"))  # 400 million pairs otherwise
    safe = [(k % 5 - 1 if k % 4 else None) for k in range(20_000) if k % 7]
    known = [p for p in safe if p is not None and p >= 0]
    assert {tuple(r) for r in got.groupBy("measured", "covered", "over_alerted", "unknown").count().collect()} == {(m, 20_000, sum(known), len(safe) - len(known), 10_000) for m in (True, False)}


def test_classes_are_cut_into_rows_and_expanded_whole(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 2).alias("k"))
    chunks = spatial.in_chunks(rows, ["k"], "id", chunk=100)
    assert chunks.agg(F.max(F.size("ids"))).first()[0] < 200  # no class of 1500 in one row
    got = spatial.expanded(rows.select("k").distinct().withColumn("v", F.col("k") * 10), chunks, "k", "id", "v")
    assert sorted(map(tuple, got.collect())) == [(k, k % 2 * 10) for k in range(3000)]


def test_points_at_one_place_are_one_spot(spark):
    points = spark.range(20_000).select("id", F.when(F.col("id") == 9, F.lit(None).cast("double")).otherwise(F.col("id") % 2 * 3.0).alias("x"), F.lit(0.0).alias("y"))
    got = egress.dbscan(points, 1.0, 4, Scratch(spark, "t"))  # 100 million links otherwise
    assert {tuple(r) for r in got.groupBy("kind", "label").count().collect()} == {("core", 0, 10_000), ("core", 1, 9_999), ("noise", -1, 1)}
    few = points.filter("id < 8")
    assert sorted(map(tuple, egress.epsilon_links(few, 3.0).collect())) == [(a, b) for a in range(8) for b in range(a + 1, 8)]
    assert sorted(map(tuple, egress.epsilon_links(few, 1.0).collect())) == [(a, b) for a in range(8) for b in range(a + 2, 8, 2)]


def _crowd(spark, lines, seen):
    """Segments of two shapes and detections at three places, most of them at the first, with repeated ids and no places."""
    s, d = spark.range(lines), spark.range(seen)
    lat = F.lit(37.0) + F.col("id") % 2 * 0.01
    segments = s.select(F.col("id").alias("seg_id"), lat.alias("lat1"), F.lit(-2.0).alias("lon1"), (lat + 0.004).alias("lat2"), F.lit(-1.997).alias("lon2"))
    place = F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 2 + 1)
    det = d.select("id", F.when(F.col("id") != 5, F.lit(37.001) + place * 0.012).alias("lat"), F.when(F.col("id") != 6, F.lit(-2.001)).alias("lon"))
    return segments.union(segments.filter("seg_id < 3")), det.union(det.filter("id between 3 and 8"))


def test_pairs_by_place_are_all_pairs(spark, monkeypatch):
    segments, det = _crowd(spark, 40, 200)
    want = spatial.near_segments(segments, det.filter("lat is not null and lon is not null"), 2000.0, one_piece=True)
    want = sorted(map(tuple, want.withColumn("distance_m", F.round("distance_m", 4)).select("seg_id", "id", "distance_m").collect()))
    assert len(want) > 3000 and len({d for _, _, d in want}) > 3
    monkeypatch.setattr(spatial, "NEAR_IDS", 7)  # a place's segments are several lists
    for most in (1 << 25, 300):  # the first place's pairs are one task's, or several tasks'
        got = spatial.pairs_by_place(segments, det, 2000.0, Scratch(spark, "t"), 4, task_pairs=most)
        assert got.columns == ["seg_id", "id", "distance_m"] and sorted(map(tuple, got.collect())) == want
        assert got.rdd.getNumPartitions() == (4 if most > 300 else -(-len(want) // 300))
    few, none = det.filter("id between 10 and 15"), det.filter("id < 0")
    alone = segments.filter("seg_id < 2").distinct()
    assert spatial.pairs_by_place(alone, few, 2000.0, Scratch(spark, "t"), 4).count() == len([1 for s, i, _ in want if s < 2 and 10 <= i <= 15]) // 2
    assert spatial.pairs_by_place(segments, none, 2000.0, Scratch(spark, "t"), 4).count() == 0


def test_spatial_pairs_take_little_room(spark, tmp_path):
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("id")).cast("timestamp_ntz")
    spark.range(4000).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    events = spark.range(10_000).select(F.col("id").alias("event_id"), ts.alias("ts"), (F.col("id") % 5 * 10).alias("user_id"), F.lit("view").alias("event_type"), F.lit(9.0).alias("value"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    catalogue.queries()["spatial_pairs"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    table = base.Tables(spark, str(tmp_path))
    rows = spatial.near_segments(plans.segments(table), base.detections(table), 2000.0, one_piece=True).count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows > 2_000_000
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < rows  # 1.9 bytes a row in the order of a join


def _shuffled(spark):
    """Rows shuffled by this application so far."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


@pytest.mark.parametrize("name, most", [("threat_rings", 0.5), ("recommendation_order", 1.5)])
def test_threats_are_shuffled_once_at_most(spark, tmp_path, name, most):
    category = F.lit("x").alias("c_mktsegment")
    spark.range(3000).select(F.col("id").alias("c_custkey"), category).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(500).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    before, kept = _shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where tables are large
    try:
        catalogue.queries()[name](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    rows = spark.read.parquet(str(tmp_path / "out")).count()
    assert rows > 100_000 and _shuffled(spark) - before < most * rows
