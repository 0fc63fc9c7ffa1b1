"""Navigation, levelling, sinks, streams and the map's versions on small made-up inputs."""

import base64
import io
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfield.config import GridConfig, NavConfig
from cairnfield.operators import fusion, graph, grid, motion, navigate, orient, timed
from cairnfield.sources import export, maps, points
from cairnfield.streaming import navigation


def cells_of(spark, cost, name=0):
    rows = [(name, int(r), int(c), float(cost[r, c])) for r, c in np.argwhere(np.isfinite(cost))]
    return spark.createDataFrame(rows, "grid_id long, row int, col int, cost double")


def test_components_across_tiles_equal_one_tile(spark):
    rng = np.random.default_rng(4)
    mask = rng.random((40, 50)) < 0.55
    snake = np.zeros((40, 50), bool)  # one group that winds through all tiles
    snake[::4] = True
    snake[1::4, 0] = snake[2::4, 0] = snake[3::4, -1] = True
    for m in (mask, snake):
        cells = spark.createDataFrame([(7, int(r), int(c)) for r, c in np.argwhere(m)], "grid_id long, row int, col int")
        for ways in (grid.BOX, graph.CROSS):
            one = {(r.row, r.col): tuple(r.component) for r in graph.components(cells, ways, 1000).collect()}
            tiles = {(r.row, r.col): tuple(r.component) for r in graph.components(cells, ways, 8).collect()}
            assert one == tiles and len(one) == m.sum()


def test_replanning_statuses(spark):
    """A goal behind a closed wall is replaced by the nearest cell this side; an enclosed robot can't move; none is free far away."""
    cost = np.ones((60, 60))
    cost[30] = np.inf
    cost[2:9, 2] = cost[2:9, 8] = cost[2, 2:9] = cost[8, 2:9] = np.inf
    cost[3:8, 3:8] = np.inf
    cost[5, 5] = 1.0
    cells = cells_of(spark, cost)
    rows = [(1, 0, 1.05, 2.05, 5.0, 2.5), (2, 0, 1.05, 2.05, 1.05, 5.5), (3, 0, 0.55, 0.55, 3.0, 3.0), (4, 0, 1.0, 1.0, None, 1.0), (5, 0, 20.0, 20.0, 1.0, 1.0), (6, 0, 1.05, 2.05, 90.0, 2.05)]
    asked = spark.createDataFrame(rows, "query_id long, grid_id long, x double, y double, goal_x double, goal_y double")
    got = {r.query_id: r for r in navigate.replanned(cells, asked).collect()}
    assert [got[i].status for i in range(1, 7)] == ["following path", "following path", "no progress possible from here", "waiting for goal", "no free space near robot", "following path"]
    assert (got[1].goal_row, got[1].goal_col) == (24, 47) and tuple(got[2].path[-1]) == (29, 10) and got[3].path == [(5, 5)] and got[4].path is None
    assert got[6].goal_col == 47 and tuple(got[6].path[0]) == (20, 10)  # pulled to the window's edge, 3.7 m away


def test_a_cloud_is_levelled(spark):
    """A tilted floor under a sensor at 0.4 m, with a box ahead: the floor comes to z = 0 and the box to +x."""
    rng = np.random.default_rng(6)
    floor = np.c_[rng.uniform(-3, 3, 4000), rng.uniform(-3, 3, 4000), rng.normal(-0.4, 0.005, 4000)]
    box = np.c_[rng.uniform(-0.2, 0.2, 400), rng.uniform(1.4, 1.6, 400), rng.uniform(-0.3, 0.4, 400)]
    a, b = math.radians(20), math.radians(-10)
    tilt = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]]) @ np.array([[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]])
    xyz = np.concatenate([floor, box]) @ tilt.T
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "pid long, x double, y double, z double")
    out, found = orient.levelled(df)
    rows = np.array([(r.x, r.y, r.z) for r in out.orderBy("pid").collect()])
    assert abs(found["height"] - 0.4) < 0.02 and found["inliers"] > 3500
    assert abs(rows[:4000, 2]).max() < 0.05 and abs(found["tilt_deg"] - math.degrees(math.acos(tilt[2, 2]))) < 1
    ahead = rows[4000:].mean(0)
    assert ahead[0] > 1.2 and abs(ahead[1]) < 0.2
    assert np.allclose(found["rotation"] @ found["rotation"].T, np.eye(3), atol=1e-9)
    with pytest.raises(ValueError):
        orient.levelled(df.limit(2))
    flipped = orient.reoriented(df.select("pid", F.col("z").alias("x"), F.col("y"), F.col("x").alias("z")).limit(0))
    assert flipped.count() == 0


def test_sinks(spark):
    c = spark.createDataFrame([(1, float(t), t, vx, None, wz) for t, (vx, wz) in enumerate([(0.0, 0.0), (0.0, 0.0), (9.0, -9.0), (0.2, 0.0), (0.0, 0.0), (0.0, 1e-4), (0.1, 0.0)])], "robot_id long, t double, tie long, vx double, vy double, wz double")
    got = export.motor_requests(c).orderBy("t").collect()
    assert [(r.t, r.api) for r in got] == [(0, 1003), (2, 1008), (3, 1008), (4, 1003), (6, 1008)]
    assert json.loads(got[1].parameter) == {"x": 0.6, "y": 0.0, "z": -1.5} and got[0].parameter == "{}"
    cells = spark.createDataFrame([(0, 0, 0, 0.123, 0, 1.23456), (0, 0, 1, None, 2, None), (0, 1, 0, -0.05, 1, None), (0, 1, 1, 400.0, 0, 2.0)], "grid_id long, row int, col int, elevation double, class int, cost double")
    g = spark.createDataFrame([(0, 2, 2, 9, 0.12345, -1.0)], "grid_id long, rows int, cols int, seq long, origin_x double, origin_y double")
    frame = json.loads(export.grid_frames(cells, g, 0.1).first().frame)
    assert np.frombuffer(base64.b64decode(frame["elev"]), "<i2").tolist() == [12, -32768, -5, 32000] and list(base64.b64decode(frame["cls"])) == [0, 2, 1, 0]
    assert frame["cost"] == [1.235, -1.0, -1.0, 2.0] and frame["origin"] == [0.123, -1.0] and (frame["seq"], frame["h"], frame["w"]) == (9, 2, 2)
    pts = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (0, 4.0, 5.0, 6.0)], "pid long, x double, y double, z double")
    assert np.load(io.BytesIO(export.point_file(pts))).tolist() == [[4, 5, 6], [1, 2, 3]]
    with pytest.raises(ValueError):
        export.point_file(pts, most=1)


def test_videos_and_messages(spark, tmp_path):
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(9, 3)).astype("float32")
    np.savez(tmp_path / "v.npz", pts=pts, offsets=np.array([0, 4, 4, 9]), stamps=np.array([1.0, 2.0, 3.5]), poses=np.arange(21.0).reshape(3, 7))
    rows = points.read_video(spark, str(tmp_path / "v.npz")).orderBy("pid").collect()
    assert [r.frame for r in rows] == [0] * 4 + [2] * 5 and rows[8].stamp == 3.5 and rows[8].pose == list(map(float, range(14, 21)))
    assert np.allclose([[r.x, r.y, r.z] for r in rows], pts)
    fields = [(n, 4 * i, 7) for i, n in enumerate("xyz")]
    data = np.array([[1, 2, 3], [np.nan, 0, 0], [4, 5, 6]], "<f4").tobytes()
    df = spark.createDataFrame([(5, bytearray(data), fields, 12, 36, 3, 1, False), (6, None, fields, 12, 0, 0, 0, False)], "scan_id long, data binary, fields array<struct<name: string, offset: int, datatype: int>>, point_step int, row_step int, width int, height int, big_endian boolean")
    assert [tuple(r) for r in points.decode_messages(df).orderBy("pid").collect()] == [(5, 0, 1.0, 2.0, 3.0), (5, 1, 4.0, 5.0, 6.0)]
    assert points.scene(spark, 2000).filter("x BETWEEN 9.2 AND 9.5 AND y BETWEEN 6.2 AND 7.8 AND z > 0.45").count() > 0


def test_map_versions_and_resume(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    assert maps.load_map(spark, path).count() == 0 and maps.versions(spark, path) == []
    schema = "seq int, row int, col int, ix int, iy int, elevation double, class int, n int, distance double"
    rows = [(s, r, c, c, r, 0.1 * s + r, s % 2, 1 + s % 3, 0.0) for s in range(40) for r in range(3) for c in range(2)]
    local = spark.createDataFrame(rows, schema)
    whole = sorted(fusion.folded_map(local).collect())
    parts = sorted(fusion.folded_in_parts(local, most=7).collect())
    assert [(a.ix, a.iy, a["class"], a.weight) for a in whole] == [(a.ix, a.iy, a["class"], a.weight) for a in parts]
    assert np.allclose([a.elevation for a in whole], [a.elevation for a in parts], atol=1e-12)
    sink = maps.map_sink(path)
    for k in range(4):
        sink(local.filter(F.col("seq").between(10 * k, 10 * k + 9)), k)
    sink(local.filter("seq < 10"), 3)  # a batch that runs again changes nothing
    assert maps.versions(spark, path) == [3, 4]
    got = sorted(maps.load_map(spark, path).collect())
    assert [(a.ix, a.iy, a["class"], a.weight) for a in got] == [(a.ix, a.iy, a["class"], a.weight) for a in whole]
    (tmp_path / "map" / "v9").mkdir()  # a version whose writing was cut off
    assert maps.versions(spark, path) == [3, 4] and maps.load_map(spark, path).count() == len(whole)
    for bad in ((0.1, 0.2, None, None), (0.1, 0.1, -1.0, (0, 0)), (0.1, 0.1, 1.0, None)):
        with pytest.raises(ValueError):
            fusion.checked(*bad)


def replayed(spark, tmp_path, name, frame, make, files=6):
    """A stream's output when its input comes in several files, one a batch."""
    folder = tmp_path / name
    for i, part in enumerate(np.array_split(np.arange(len(frame)), files)):
        spark.createDataFrame(frame.iloc[part], make[1]).coalesce(1).write.mode("append").parquet(str(folder))
    del i
    stream = spark.readStream.schema(make[1]).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = make[0](stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-state").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_rolling_grid_replay_equals_batch(spark, tmp_path):
    import pandas as pd

    rng = np.random.default_rng(3)
    nav = NavConfig(map_size=4.0, buffer_s=1.0)
    scans = []
    for k in range(12):
        stamp, px, py = 0.25 * k if k < 10 else 40.0 + k, 0.1 * k, 0.0
        xyz = np.c_[rng.uniform(-3, 3, 200) + px, rng.uniform(-3, 3, 200), rng.normal(0, 0.3, 200)]
        scans.append((1 + k % 2, stamp, px, py, *(xyz[:, i].tolist() for i in range(3))))
    frame = pd.DataFrame(scans, columns=["robot_id", "stamp", "px", "py", "xs", "ys", "zs"])
    schema = "robot_id long, stamp double, px double, py double, xs array<double>, ys array<double>, zs array<double>"
    got = replayed(spark, tmp_path, "rolling", frame, (lambda s: navigation.rolling_cells(s, nav=nav), schema))
    have = {(r.robot_id, r.stamp, r.row, r.col): (r.n, round(r.sz, 9)) for r in got.collect()}
    want = {}
    for robot, stamp, px, py, *_ in scans:
        xyz = [np.array(p) for r, t, x, y, *p in scans if r == robot and stamp - 1.0 <= t <= stamp]
        own = [(x, y) for r, t, x, y, *p in scans if r == robot and stamp - 1.0 <= t <= stamp]
        kept = np.concatenate([p.T[(p[0] - x) ** 2 + (p[1] - y) ** 2 > nav.min_range**2] for p, (x, y) in zip(xyz, own)])
        for x, y, z in kept:
            c, r = math.floor((x - (px - 2)) / 0.1), math.floor((y - (py - 2)) / 0.1)
            if 0 <= r < 40 and 0 <= c < 40 and -1 <= z <= 1.5:
                n, s = want.get((robot, stamp, r, c), (0, 0.0))
                want[robot, stamp, r, c] = (n + 1, s + z)
    assert have.keys() == want.keys() and all(have[k][0] == n and math.isclose(have[k][1], s, abs_tol=1e-6) for k, (n, s) in want.items())
    grids = navigation.rolling_grids(got, nav=nav)
    one = grids.filter("robot_id = 1 AND stamp = 2.0").count()
    assert one == sum(k[0] == 1 and k[1] == 2.0 for k in want) and grids.select("grid_id").distinct().count() == 12
    made = []
    navigation.grid_sink(lambda df, k: made.append((k, df.count())), nav=nav)(got, 5)
    assert made == [(5, len(want))]


def test_watchdogs(spark, tmp_path):
    import pandas as pd

    at = lambda s: pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)
    base = at(0).timestamp()
    times = [0.0, 0.2, 0.4, 2.0, 2.3, 9.0, 30.0]
    frame = pd.DataFrame({"robot_id": [1] * 7, "at": [at(t) for t in times]})
    got = replayed(spark, tmp_path, "stale", frame, (lambda s: navigation.stale_scans(s, "robot_id", "at", 1.0), "robot_id long, at timestamp"), 7)
    assert sorted(round(r.stale_at - base, 6) for r in got.collect()) == [1.4, 3.3, 10.0]
    speeds = [(0.0, 0.3), (0.2, 0.0), (0.3, 0.0), (1.0, 0.5), (1.2, 0.5), (5.0, 0.4), (50.0, 0.0)]
    frame = pd.DataFrame({"robot_id": [1] * 7, "at": [at(t) for t, _ in speeds], "vx": [v for _, v in speeds], "vy": 0.0, "wz": 0.0})
    made = lambda s: navigation.motor_requests(s, "robot_id", "at", 0.5)
    got = replayed(spark, tmp_path, "motor", frame, (made, "robot_id long, at timestamp, vx double, vy double, wz double"), 7)
    assert sorted((round(r.stamp - base, 6), r.api) for r in got.collect()) == [(0.0, 1008), (0.2, 1003), (1.0, 1008), (1.2, 1008), (1.7, 1003), (5.0, 1008), (5.5, 1003)]


def test_buckets_change_nothing(spark):
    rng = np.random.default_rng(2)
    left = spark.createDataFrame([(int(u), float(t), i) for i, (u, t) in enumerate(zip(rng.integers(0, 3, 80), rng.uniform(-50, 400, 80)))], "k long, t double, i long")
    right = spark.createDataFrame([(int(u), float(t), i, float(i)) for i, (u, t) in enumerate(zip(rng.integers(0, 3, 40), rng.uniform(-50, 400, 40)))], "k long, t double, i long, v double")
    wide = sorted(map(tuple, timed.latest_before(left, right, "k", "t", "i", ["v"], bucket=1e9).collect()))
    assert wide == sorted(map(tuple, timed.latest_before(left, right, "k", "t", "i", ["v"], bucket=7.0).collect())) and any(r[3] is not None for r in wide)
    for budget in (0, 5, 40, 10**6):
        one = timed.within_budget(left.withColumn("n", F.col("i") % 7), "k", "i", "n", budget, 10**9)
        assert sorted(one.collect()) == sorted(timed.within_budget(left.withColumn("n", F.col("i") % 7), "k", "i", "n", budget, 3).collect())
    frame = left.toPandas()
    got = {r.i: r.c for r in timed.buffered(left, "k", "t", 33.0, [("c", F.count(F.lit(1)))]).collect()}
    assert got == {r.i: int(((frame.k == r.k) & (frame.t <= r.t) & (frame.t >= r.t - 33.0)).sum()) for r in frame.itertuples()}


def test_queries_leave_settings_alone(spark):
    from cairnfield.plans import queries as plans

    before = dict(spark.conf.getAll)
    for name in ("class_summary", "rate_limit", "apf_rollouts", "reachable"):
        plans.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert dict(spark.conf.getAll) == before


def test_unknown_space_and_windows(spark):
    cells = spark.createDataFrame([(0, 0, 0, 0, 1.5), (0, 1, 1, 1, None)], "grid_id long, row int, col int, class int, cost double")
    g = spark.createDataFrame([(0, 2, 2)], "grid_id long, rows int, cols int")
    rows = lambda **kw: sorted((r.row, r.col, r["class"], r.cost) for r in navigate.with_unknown(cells, g, **kw).collect())
    assert rows(cost=20.0) == [(0, 0, 0, 1.5), (0, 1, 2, 20.0), (1, 0, 2, 20.0), (1, 1, 1, None)]
    assert [r[3] for r in rows(lethal=True)] == [1.5, None, None, None] and [r[3] for r in rows(as_free=True)] == [1.5, 1.0, 1.0, None]
    assert motion.follow_paths(cells, spark.createDataFrame([(1, 0, None)], "query_id long, grid_id long, points array<struct<x: double, y: double>>"), 0.1).count() == 0
    assert GridConfig().unknown_cost == 50.0


def test_plan_path_in_sql(spark):
    from cairnfield.functions.table import register

    register(spark)
    cost = np.ones((6, 6))
    cost[3, :5] = np.inf
    cells = cells_of(spark, cost).withColumn("query_id", F.lit(1))
    cells.groupBy().agg(F.collect_list(F.struct("row", "col", "cost")).alias("cells")).createOrReplaceTempView("grids")
    rows = spark.sql("SELECT p.* FROM grids, LATERAL plan_path(cells, 0, 0, 5, 0) p ORDER BY seq").collect()
    total, path = graph.least_cost({(r, c): 1.0 for r, c in np.argwhere(np.isfinite(cost)).tolist()}, (0, 0), (5, 0))
    assert [(r.row, r.col) for r in rows] == path and math.isclose(rows[-1].total, total)
    assert spark.sql("SELECT p.* FROM grids, LATERAL plan_path(cells, 3, 0, 5, 0) p").count() == 0


def test_command_line(spark, tmp_path):
    from cairnfield.__main__ import main

    rng = np.random.default_rng(2)
    np.save(tmp_path / "p.npy", np.c_[rng.uniform(0, 3, 9000), rng.uniform(0, 3, 9000), rng.normal(0, 0.003, 9000)])
    made = main(["grid", str(tmp_path / "p.npy"), str(tmp_path / "grid"), "--resolution", "0.2"], spark)
    assert made["cells"] == 225 and spark.read.parquet(str(tmp_path / "grid")).filter("class = 0").count() == 225
    got = main(["plan", str(tmp_path / "p.npy"), "--start", "0.3,0.3", "--goal", "2.7,2.7", "--resolution", "0.2"], spark)
    assert got["status"] == "found" and math.dist(got["path"][0], (0.3, 0.3)) < 0.2 and math.dist(got["path"][-1], (2.7, 2.7)) < 0.2
    with pytest.raises(SystemExit):
        main(["plan", "x.npy"], spark)


def test_cost_fields_across_tiles_equal_one_search(spark):
    rng = np.random.default_rng(9)
    cost = np.where(rng.random((30, 37)) < 0.25, np.inf, 1 + 4 * rng.random((30, 37)))
    cost[0, 0] = cost[29, 36] = 1.0
    cells = cells_of(spark, cost, 3)
    starts = spark.createDataFrame([(3, 0, 0), (3, 29, 36), (3, 99, 99)], "grid_id long, start_row int, start_col int")
    plain = {(r, c): cost[r, c] for r, c in np.argwhere(np.isfinite(cost)).tolist()}
    a, b = (graph.least_cost(plain, s, None, 0.0) for s in ((0, 0), (29, 36)))
    want = {k: min(a.get(k, math.inf), b.get(k, math.inf)) for k in a.keys() | b.keys()}
    for tile in (7, 500):
        got = {(r.row, r.col): r.total for r in graph.cost_field(cells, starts, tile=tile).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    assert graph.cost_field(cells, starts.filter("start_row = 99")).count() == 0


def test_filters_in_parts_equal_one_fold(spark):
    rng = np.random.default_rng(5)
    rows = [(int(s), 0, int(r), 0, float(rng.normal()), float(rng.uniform(0.01, 0.1)), 1) for s in range(1, 41) for r in range(4) if rng.random() < 0.6]
    m = spark.createDataFrame(rows, "scan_id long, grid_id long, row int, col int, z double, var double, hits long")
    one = sorted(map(tuple, fusion.fused_with_process(m, 1e-3, 40).collect()))
    parts = sorted(map(tuple, fusion.fused_in_parts(m, 1e-3, 40, 7).collect()))
    assert np.allclose(one, parts, rtol=1e-12) and len(one) == 4


def test_a_closed_loop_goes_round_a_wall(spark):
    """The robot sees 5 m, replans on the way, keeps to free cells and reaches a goal beyond its window; an enclosed goal is approached."""
    cost = np.ones((100, 100))
    cost[20:70, 30:36] = cost[0:35, 60:66] = np.inf
    cost[80:90, 80] = cost[80:90, 89] = cost[80, 80:90] = cost[89, 80:90] = np.inf
    agents = spark.createDataFrame([(1, 0, 0.6, 0.6, 0.0, 9.0, 0.8), (2, 0, 5.0, 9.0, 0.0, 8.45, 8.45), (3, 0, 5.0, 9.0, 0.0, None, 1.0)], "agent_id long, grid_id long, x double, y double, yaw double, goal_x double, goal_y double")
    from cairnfield.operators import simulate

    rows = simulate.closed_loops(cells_of(spark, cost), agents, steps=1200).toPandas()
    one, two, three = (rows[rows.agent_id == i].sort_values("seq") for i in (1, 2, 3))
    assert one.status.iloc[-1] == "goal reached" and math.dist((one.x.iloc[-1], one.y.iloc[-1]), (9.0, 0.8)) <= NavConfig().goal_tol
    core = np.zeros((100, 100), bool)  # what blocks is inflated; a carrot may cut its corners, but not into what it is made of
    core[22:68, 32:34] = core[0:33, 62:64] = True
    assert not core[(one.y / 0.1).astype(int), (one.x / 0.1).astype(int)].any()
    assert np.hypot(one.x.diff(), one.y.diff()).max() <= NavConfig().max_speed * 0.1 + 1e-9
    assert two.status.iloc[-1] != "goal reached" and math.dist((two.x.iloc[-1], two.y.iloc[-1]), (8.45, 8.45)) < 1.2
    assert three.status.tolist() == ["waiting for goal"]


def test_the_navigator_decides_as_the_queries_do(spark):
    from cairnfield.operators import simulate

    rng = np.random.default_rng(8)
    cost = np.where(rng.random((60, 60)) < 0.25, np.inf, 1 + rng.random((60, 60)))
    plain = {(r, c): cost[r, c] for r, c in np.argwhere(np.isfinite(cost)).tolist()}
    asked = [(i, 0, *rng.uniform(0.2, 5.8, 2).tolist(), *rng.uniform(-6, 12, 2).tolist()) for i in range(25)]
    frame = spark.createDataFrame(asked, "query_id long, grid_id long, x double, y double, goal_x double, goal_y double")
    got = {r.query_id: r for r in navigate.replanned(cells_of(spark, cost), frame).collect()}
    for i, _, x, y, gx, gy in asked:
        robot = simulate.Navigator(NavConfig(), (gx, gy))
        robot.replan(plain, x, y, 0.0)
        assert robot.status == got[i].status
        want = [] if got[i].path is None else [((p.col + 0.5) * 0.1, (p.row + 0.5) * 0.1) for p in got[i].path]
        assert robot.path[-1:] == want[-1:] and len(robot.path) == len(want)
    poses = [(i, *rng.uniform(0, 6, 2).tolist(), float(rng.uniform(-3, 3)), float(rng.choice([0.2, 5.0]))) for i in range(40)]
    robots = [simulate.Navigator(NavConfig(), (3.0, 3.0), [(1.0, 1.0), (2.0, 2.0), (5.0, 2.0)], 0.0, "following path") for _ in poses]
    carrots = [r.carrot(x, y) for r, (_, x, y, _, _) in zip(robots, poses)]
    frame = spark.createDataFrame([(*p, 3.0, 3.0, *c) for p, c in zip(poses, carrots)], "i long, x double, y double, yaw double, scan_age double, goal_x double, goal_y double, carrot_x double, carrot_y double")
    for r in frame.select("i", *motion.command()).collect():
        _, x, y, yaw, age = poses[r.i]
        vx, wz, status = robots[r.i].command(x, y, yaw, age)
        assert status == r.status and math.isclose(vx, r.vx, abs_tol=1e-9) and math.isclose(wz, r.wz, abs_tol=1e-9)
