"""Properties of the engine on small made-up inputs."""

import math
import struct

import numpy as np
import pytest

from cairnfield.config import ApfConfig, GridConfig
from cairnfield.operators import fusion, graph, grid, motion
from cairnfield.sources import maps, points


def ground(rng, n=8000, side=5.0, noise=0.005):
    return np.stack([rng.uniform(0, side, n), rng.uniform(0, side, n), rng.normal(0, noise, n)], 1)


def frame(spark, xyz):
    return spark.createDataFrame([(0, *map(float, p)) for p in xyz], "grid_id long, x double, y double, z double")


def test_flat_ground_is_free_and_a_wall_is_lethal(spark):
    rng = np.random.default_rng(1)
    flat = ground(rng)
    wall = np.stack([rng.uniform(2.4, 2.6, 3000), rng.uniform(0, 5, 3000), rng.uniform(0, 1, 3000)], 1)
    cfg = GridConfig(bounds=(0, 0, 5, 5), resolution=0.2)
    assert grid.discretize(frame(spark, flat), cfg=cfg).filter("class = 1 OR cost >= 2.2").count() == 0
    cells = grid.discretize(frame(spark, np.concatenate([flat, wall])), cfg=cfg).toPandas()
    cost = {(r, c): v for r, c, v in zip(cells["row"], cells["col"], cells["cost"]) if not math.isnan(v)}
    assert (cells["class"] == 1).sum() > 20 and graph.least_cost(cost, (12, 2), (12, 22)) is None


def test_searches_agree_and_report_blocked_ends():
    rng = np.random.default_rng(5)
    cost = {(r, c): 1 + 3 * rng.random() for r in range(25) for c in range(25) if rng.random() > 0.25}
    start, goal = min(cost), max(cost)
    field = graph.least_cost(cost, start, None, 0.0)
    got = graph.least_cost(cost, start, goal)
    assert (got is None) == (goal not in field)
    if got:
        total, path = got
        assert math.isclose(total, field[goal], abs_tol=1e-6) and path[0] == start and path[-1] == goal
        assert math.isclose(total, sum(math.dist(a, b) * (cost[a] + cost[b]) / 2 for a, b in zip(path, path[1:])), abs_tol=1e-6)
    assert graph.least_cost(cost, start, start) == (0.0, [start])
    with pytest.raises(ValueError):
        graph.least_cost(cost, (99, 99), goal)


def test_specks_equal_flood_fill(spark):
    rng = np.random.default_rng(8)
    mask = rng.random((18, 18)) < 0.2
    rows = [(0, r, c, bool(mask[r, c])) for r in range(18) for c in range(18)]
    df = spark.createDataFrame(rows, "grid_id long, row int, col int, lethal boolean")
    comp = {(r.row, r.col): (r.component.row, r.component.col) for r in graph.components(df.filter("lethal")).collect()}
    for least in (1, 2, 3, 4):
        want = {c for c, root in comp.items() if sum(x == root for x in comp.values()) >= least}
        assert {(r.row, r.col) for r in grid.without_specks(df, least).filter("lethal").collect()} == want


def test_fusing_two_measures_and_the_map(spark):
    m = spark.createDataFrame([(1, 0, 0, 0, 1.0, 0.04, 1), (2, 0, 0, 0, 2.0, 0.04, 1)], "scan_id long, grid_id long, row int, col int, z double, var double, hits long")
    r = fusion.fused(m).first()
    assert math.isclose(r.height, 1.5) and math.isclose(r.variance, 0.02)
    assert math.isclose(fusion.fused_with_process(m, 0.01, 3).first().variance, 1 / (1 / 0.05 + 1 / 0.04) + 0.01)
    schema = "seq int, row int, col int, ix int, iy int, elevation double, class int, n int, distance double"
    local = spark.createDataFrame([(1, 0, 0, 0, 0, 0.0, 1, 2, 0.0), (2, 0, 0, 0, 0, 0.2, 0, 2, 0.0), (3, 0, 0, 0, 0, None, 2, 5, 0.0), (3, 0, 40, 40, 0, 0.0, 1, 1, 4.0), (4, 0, 40, 40, 0, 0.0, 0, 1, 4.0)], schema)
    got = {r.ix: r for r in fusion.folded_map(local, refresh_radius=1.0).collect()}
    assert math.isclose(got[0].elevation, 0.1) and got[0]["class"] == 0 and got[0].weight == 4 and got[40]["class"] == 1
    again = fusion.folded_map(local.filter("seq = 4"), fusion.folded_map(local.filter("seq < 4")), 1.0)
    assert {r.ix: r["class"] for r in again.collect()} == {0: 0, 40: 1}
    raw = maps.map_bytes(again, 0.1, 3, 0.0)
    assert sorted(maps.map_from_bytes(spark, raw).collect()) == sorted(fusion.snapshot(again).collect())


def test_bands_and_rollouts_stay_free():
    cost = np.ones((40, 40))
    cost[18:22, 10:30] = np.inf
    got = graph.least_cost({(r, c): 1.0 for r, c in np.argwhere(np.isfinite(cost)).tolist()}, (5, 20), (35, 20))
    xy = motion.elastic_band(np.array(got[1]), cost, 0.1)
    assert np.allclose(xy[0], (2.05, 0.55)) and np.isfinite(cost[tuple(np.floor(xy[:, ::-1] / 0.1).astype(int).T)]).all()
    end = motion.rollout(motion.Field(np.ones((40, 40)), 0.1), (0.5, 0.5), [(3.0, 3.0)])[-1]
    assert math.dist(end, (3.0, 3.0)) <= ApfConfig().goal_tol
    flat = motion.distance_array(np.ones((5, 7)), 0.1)
    assert np.allclose(flat, 2.4)
    small = np.ones((5, 5))
    small[2, 2] = np.inf
    d = motion.distance_array(small, 1.0)
    assert d[2, 2] == 0 and d[2, 0] == 2 and math.isclose(d[0, 0], 2 * math.sqrt(2))


def test_distances_equal_all_obstacles():
    rng = np.random.default_rng(3)
    for share in (0.02, 0.3):
        cost = np.where(rng.random((30, 41)) < share, np.inf, 1.0)
        at = np.argwhere(np.isinf(cost))
        r, c = np.indices(cost.shape)
        a, b = abs(r[..., None] - at[:, 0]), abs(c[..., None] - at[:, 1])
        assert np.array_equal(motion.distance_array(cost, 0.1), (np.maximum(a, b) + (math.sqrt(2) - 1) * np.minimum(a, b)).min(2) * 0.1)


def test_fields_keep_away_and_follow():
    """A wall with a gap: a path through it is followed to its end without touching the wall; a still goal behind it traps."""
    cost = np.ones((60, 60))
    cost[28:32, :40] = np.inf
    field = motion.Field(cost, 0.1)
    path = [(2.0, 1.0), (3.0, 1.5), (4.0, 2.0), (5.0, 2.5), (5.0, 3.5), (4.0, 4.0), (3.0, 4.5), (2.0, 5.0)]
    xy = motion.followed(field, path)
    assert math.dist(xy[-1], path[-1]) <= ApfConfig().goal_tol
    assert np.isfinite(cost[(xy[:, 1] / 0.1).astype(int), (xy[:, 0] / 0.1).astype(int)]).all()
    stuck = motion.rollout(field, (2.0, 1.0), [(2.0, 5.0)], 300, kicks=False)
    assert len(stuck) == 301 and math.dist(stuck[-1], (2.0, 5.0)) > 1
    moving = [(min(1 + 0.4 * k * 0.1, 5.0), 1.0) for k in range(400)]
    assert math.dist(motion.rollout(field, (0.8, 1.0), moving)[-1], (5.0, 1.0)) <= ApfConfig().goal_tol
    assert motion.followed(field, [(1.0, 1.0)]).tolist() == [[1.0, 1.0]] and motion.followed(field, []).shape == (0, 2)
    speeds = np.hypot(*np.diff(xy, axis=0).T) / ApfConfig().dt
    assert speeds.max() <= ApfConfig().max_speed + 1e-9


def test_a_kick_is_added_sideways_and_goes_on():
    """Between two equal pulls nothing moves; from the fourth slow step on each step goes sideways by 0.3 of the top speed."""
    cost = np.ones((61, 61))
    field = motion.Field(cost, 0.1)
    field.velocity = lambda x, y, gx, gy: (0.0, 0.0, 0.0)
    xy = motion.rollout(field, (1.0, 1.0), [(3.0, 1.0)], 6)
    step = 0.3 * ApfConfig().max_speed * ApfConfig().dt
    assert np.allclose(xy[:4], (1.0, 1.0)) and np.allclose(np.hypot(*np.diff(xy, axis=0).T)[3:], step) and np.allclose(xy[4], (1.0, 1.0 + step))


def test_point_files(spark, tmp_path):
    want = np.array([[0.1, 0.2, 0.3], [1, 2, 3], [-1.5, 0, 4.25]])
    head = "ply\nformat {} 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    (tmp_path / "a.ply").write_text(head.format("ascii") + "\n".join(" ".join(map(str, p)) for p in want) + "\n")
    (tmp_path / "b.ply").write_bytes(head.format("binary_little_endian").encode() + want.astype("<f4").tobytes())
    (tmp_path / "c.ply").write_bytes(head.format("binary_big_endian").encode() + want.astype(">f4").tobytes())
    (tmp_path / "d.pcd").write_text("VERSION .7\nDATA ascii\n" + "\n".join(" ".join(map(str, p)) for p in want) + "\n")
    (tmp_path / "e.csv").write_text("\n".join(",".join(map(str, p)) for p in want))
    (tmp_path / "f.xyz").write_text("\n".join(" ".join(map(str, p)) for p in want))
    np.save(tmp_path / "g.npy", want)
    (tmp_path / "h.bin").write_bytes(np.c_[want, [7, 8, 9]].astype("<f4").tobytes())
    for f in sorted(tmp_path.iterdir()):
        rows = sorted(points.read_points(spark, str(f)).collect(), key=lambda r: r.pid)
        assert np.allclose([[r.x, r.y, r.z] for r in rows], want, atol=1e-6), f
    assert points.read_points(spark, str(tmp_path / "h.bin"), every=2).count() == 2
    with pytest.raises(ValueError):
        points.read_points(spark, "x.las")
    with pytest.raises(ValueError):
        points.from_pcd(b"DATA binary\n")
    with pytest.raises(ValueError):
        points.from_kitti(b"abc")
    fields = [{"name": n, "offset": 4 * i, "datatype": 7} for i, n in enumerate("xyz")]
    data = b"".join(struct.pack("<3f", *p) + b"\0" * 4 for p in [*want, (math.nan, 0, 0)]) + b"\0" * 8
    assert np.allclose(points.from_message(data, fields, 16, 72, 4, 1), want)


def test_stream_equals_batch(spark, tmp_path):
    from cairnfield.operators import timed
    from cairnfield.streaming import navigation

    rows = [(i % 3, float(i * i % 17 + i), i) for i in range(60)]
    df = spark.createDataFrame(sorted(rows, key=lambda r: r[1]), "user_id long, t double, event_id long")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for name, made in (("limited", navigation.rate_limited(stream, "user_id", "t", "event_id", 5.0)), ("buffers", navigation.rolling_buffers(stream.selectExpr("user_id", "t", "event_id AS points"), "user_id", "t", 9.0))):
        q = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert sorted(spark.table("limited").collect()) == sorted(timed.rate_limited(df, "user_id", "t", "event_id", 5.0).collect())
    assert spark.table("buffers").count() == 60
