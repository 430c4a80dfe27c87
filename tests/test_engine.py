"""Operators on small fixtures with known answers."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF

from firnspark.functions import physics, projection
from firnspark.operators import filtering, joins, radar, series, spatial
from firnspark.plans import changepoint, detectors, features, flotation, flow, results
from firnspark.queries import QUERIES
from firnspark.sources import profiles


def profile(spark, thickness, h_surf=300.0, geoid=0.0, amp=-100.0, **more):
    n = len(thickness)
    surf = h_surf if hasattr(h_surf, "__len__") else [h_surf] * n
    bed = [None if t is None else s - t for s, t in zip(surf, thickness)]
    return profiles.from_arrays(spark, 1, x_km=[0.5 * k for k in range(n)], amp=amp, h_surf=surf, h_bed=bed, geoid_m=geoid, **more)


def crossings(spark, thickness, least=1.0):
    found = flotation.termini(physics.with_physics(profile(spark, thickness)), least)
    return sorted(r.x_km for r in found.collect())


def test_masks(spark):
    rows = physics.with_physics(profile(spark, [600, 600, 10, -5, 2, 600, None, 0])).orderBy("i").collect()
    assert [r.ice for r in rows] == [True, True, False, False, False, True, False, False]
    assert [r.water for r in rows] == [False, False, True, True, True, False, False, False]  # neither a gap nor a pick on the surface
    assert [r.degenerate for r in rows][-1]


@pytest.mark.parametrize(
    "thickness,least,want",
    [
        ([600] * 10 + [2] * 10, 1.0, [4.5]),
        ([600] * 10 + [None] * 10 + [600] * 10, 1.0, []),
        ([600] * 10 + [2] * 10 + [600] * 10, 1.0, [4.5, 10.0]),
        ([600] * 10 + [2] + [600] * 10, 1.0, []),
        ([600] * 10 + [2] * 3 + [600] * 10, 1.5, []),
        ([600] * 10 + [2] * 3 + [600] * 10, 1.0, [4.5, 6.5]),
    ],
)
def test_termini(spark, thickness, least, want):
    assert crossings(spark, thickness, least) == want


def test_window_is_cut_at_the_terminus(spark):
    thick = [*np.linspace(900, 400, 30), *np.linspace(400, 330, 10), *[1] * 15]
    surf = [*np.linspace(400, 120, 30), *np.linspace(120, 60, 10), *[55] * 15]
    p = profile(spark, [float(t) for t in thick], [float(s) for s in surf], 49.0)
    own = flotation.analysed(p)
    w = flotation.windows(own).first()
    assert w.reason == "" and w.sign == -1
    assert w.hi <= max(r.x_km for r in flotation.termini(own).collect()) and w.hi < 27.0


def test_open_water_reads_near_flotation(spark):
    rows = physics.with_physics(profile(spark, [600] * 10 + [1] * 10, [300.0] * 10 + [55.0] * 10, 49.0)).orderBy("i").collect()
    assert abs(rows[-1].residual) < 15 and rows[0].residual > 100 and rows[0].ice and not rows[-1].ice
    assert rows[-1].residual == pytest.approx(5.892, abs=1e-3) and rows[0].residual == pytest.approx(186.214, abs=1e-3)


def test_buoyancy_of_layers_moves_with_the_geoid(spark):
    one = lambda g: spark.range(1).select(physics.buoyancy_of_layers(F.lit(100.0), F.lit(-500.0), F.lit(g)).alias("h")).first().h
    assert one(24.0) - one(14.0) == pytest.approx(-10 * 1028 / 917)
    with pytest.raises(TypeError):
        physics.buoyancy_of_layers(F.lit(1.0), F.lit(1.0))


def masked(spark, mask):
    return spark.createDataFrame([(1, k, k * 0.5, bool(m)) for k, m in enumerate(mask)], "segment_id long, i long, x_km double, m boolean")


@pytest.mark.parametrize("mask,want", [([0, 1, 1, 0, 0, 1, 1, 1, 0], [(1, 2), (5, 7)]), ([1, 1, 1], [(0, 2)]), ([0, 0, 0], [])])
def test_runs(spark, mask, want):
    assert sorted((r.start, r.stop) for r in series.runs(masked(spark, mask), "m").collect()) == want


def test_projection_golden_pair_and_back(spark):
    x, y = projection.forward(F.col("lat"), F.col("lon"))
    df = spark.createDataFrame([(80.6, -60.5)], "lat double, lon double").select(x.alias("x"), y.alias("y"))
    lat, lon = projection.inverse(F.col("x"), F.col("y"))
    r = df.select("x", "y", lat.alias("lat"), lon.alias("lon")).first()
    assert r.x == pytest.approx(-272709.98, abs=0.02) and r.y == pytest.approx(-983360.43, abs=0.02)
    assert r.lat == pytest.approx(80.6, abs=1e-9) and r.lon == pytest.approx(-60.5, abs=1e-9)


def line(spark, xy, v=(0.0, -300.0), **more):
    df = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "segment_id long, i long, x double, y double")
    lat, lon = projection.inverse(F.col("x"), F.col("y"))
    return df.withColumns({"lat": lat, "lon": lon, "vx": F.lit(v[0]), "vy": F.lit(v[1])})


def test_straight_and_out_and_back_tracks(spark):
    out = [(-272710, -983360 - 500 * k) for k in range(100)]
    straight = flow.angled(flow.headed(line(spark, out)))
    assert all(abs(math.hypot(r.ex, r.ey) - 1) < 1e-9 and abs(r.ey + 1) < 1e-3 for r in straight.collect())
    a = flow.alignment(straight.withColumn("ice", F.lit(True))).first()
    assert a.sinuosity == pytest.approx(1, abs=1e-6) and a.monotonic == 1 and a.along_flow and a.median_angle < 1
    back = flow.angled(flow.headed(line(spark, out + out[::-1][1:95])))
    b = flow.alignment(back).first()
    assert b.sinuosity > 10 and b.monotonic == pytest.approx(0.5, abs=0.05) and not b.along_flow
    slow = flow.alignment(flow.angled(flow.headed(line(spark, out, (0.0, -10.0))))).first()
    assert slow.median_angle is None and slow.monotonic is None and slow.valid == 0


def test_filter_gain_and_phase():
    x = np.arange(600) * 0.5
    keep = lambda lam: filtering.zero_phase(np.sin(2 * np.pi * x / lam), 5, physics.cutoff(20.0, 0.5))[150:450]
    gain = lambda lam: float(keep(lam) @ np.sin(2 * np.pi * x / lam)[150:450] / (np.sin(2 * np.pi * x / lam)[150:450] ** 2).sum())
    assert np.allclose(filtering.zero_phase(np.full(100, 7.0), 5, 0.05), 7.0)
    assert gain(200) == pytest.approx(1, abs=1e-3) and gain(20) == pytest.approx(0.5, abs=0.01) and abs(gain(4)) < 1e-4
    with pytest.raises(ValueError):
        filtering.zero_phase(np.zeros(18), 5, 0.1)
    with pytest.raises(ValueError):
        physics.cutoff(0.5, 0.5)


def test_regrid_keeps_gaps(spark):
    src = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 10.0), (1, 4.0, 40.0), (2, 0.0, 5.0), (3, 0.0, None)], "segment_id long, x_km double, v double")
    grid = spark.createDataFrame([(s, k, k * 0.5) for s in (1, 2, 3) for k in range(10)], "segment_id long, i long, x_km double")
    got = {(r.segment_id, r.x_km): r.v for r in joins.regridded(src, grid, "v", ["segment_id"], F.lit(1.0)).collect()}
    assert got[1, 0.5] == 5 and got[1, 2.0] == 20 and got[1, 2.5] is None and got[1, 3.0] == 30 and got[1, 4.5] == 40
    assert all(v is None for (s, _), v in got.items() if s > 1)


def test_nearest_join(spark):
    left = spark.createDataFrame([(1, t) for t in (0.0, 10.0, 20.0, 30.0)], "k long, t double")
    right = spark.createDataFrame([(1, 0.2, "a"), (1, 10.9, "b"), (1, 21.1, "c"), (1, 29.0, "d"), (1, 31.0, "e")], "k long, t double, v string")
    got = {r.t: r.v for r in joins.nearest(left, right, "t", ["v"], ["k"], F.lit(1.0)).collect()}
    assert got == {0.0: "a", 10.0: "b", 20.0: None, 30.0: "d"}
    assert joins.nearest(left, right.where("k = 2"), "t", ["v"], ["k"]).where("v IS NOT NULL").count() == 0


def test_raster_round_trip(spark, tmp_path):
    cells = spark.range(9).selectExpr("'vx' AS var", "id % 3 AS col", "id div 3 AS row", "CAST(id % 3 + 2 * (id div 3) AS DOUBLE) AS value")
    profiles.write_raster(cells, f"{tmp_path}/r")
    points = spark.createDataFrame([(0.4, 0.2), (1.6, -1.9), (7.0, 0.0)], "x double, y double")
    got = joins.sampled(joins.raster_cells(points, "x", "y", 0.0, 0.0, 1.0, 1.0), profiles.raster(spark, f"{tmp_path}/r", ["vx"]), ["vx"])
    assert {r.x: r.vx for r in got.collect()} == {0.4: 0.0, 1.6: 6.0, 7.0: None}
    with pytest.raises(KeyError):
        profiles.raster(spark, f"{tmp_path}/r", ["vz"])


def test_polylines(spark):
    struct = "array<struct<lon:double,lat:double>>"
    t = spark.createDataFrame([("a", [(0.0, 0.0), (2.0, 2.0)]), ("b", [(5.0, 5.0), (6.0, 5.0)])], f"t string, points {struct}")
    f = spark.createDataFrame([("cross", [(0.0, 2.0), (2.0, 0.0)]), ("box", [(1.5, 0.0), (2.0, 0.4)]), ("touch", [(6.0, 5.0), (7.0, 9.0)]), ("far", [(50.0, 50.0), (51.0, 50.0)]), ("one", [(1.0, 1.0)])], f"f string, points {struct}")
    assert {(r.t, r.f) for r in spatial.intersecting(t, f, "t", "f").collect()} == {("a", "cross"), ("b", "touch")}


def test_cells_of_pieces_lose_no_crossing(spark):
    """Whatever the grid, the same lines meet: one cell for all compares all pairs."""
    rng = np.random.default_rng(5)
    line = lambda: [tuple(float(v) for v in np.round(p, 1)) for p in rng.uniform(-3, 3, size=(3, 2))]
    struct = "array<struct<lon:double,lat:double>>"
    t, f = (spark.createDataFrame([(k, line()) for k in range(60)], f"{n} long, points {struct}") for n in ("t", "f"))
    want = {tuple(r) for r in spatial.intersecting(t, f, "t", "f", 1e6).collect()}
    assert len(want) > 100
    for size in (0.1, 0.37, 2.0):
        assert {tuple(r) for r in spatial.intersecting(t, f, "t", "f", size).collect()} == want
    long = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0)], "k long, ax double, ay double, bx double, by double")
    assert spatial.cells(long, 1.0, "a", "b").count() < 500


def _copied_lines(spark):
    """Six lines under 200 keys each, and one under a key of its own; one key has two lines, one a single point."""
    line = lambda k: [(0.3 * k, -1.0), (0.3 * k, 1.0)]
    rows = [(10 * j + k, line(k)) for j in range(200) for k in range(6)] + [(9, [(5.0, 5.0), (6.0, 6.0)]), (9, line(0)), (19, [(0.0, 0.0)]), (29, None)]
    return spark.createDataFrame(rows, "t long, points array<struct<lon:double,lat:double>>")


def _pairs_compared(df):
    """Rows that the joins on cells gave, by the plan that ran."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), 0
    stack = [plan]
    while stack:
        node = stack.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            stack.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            stack.append(node.plan())
        if "Join" in node.nodeName() and "cx#" in node.simpleString(10000).split("Inner")[0]:
            found += node.metrics().apply("numOutputRows").value()
        stack += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_search_compares_equal_lines_once(spark):
    frames = _copied_lines(spark).withColumns({"collection": F.lit("a"), "segment": F.lit("s"), "year": F.lit(2010)})
    zones = spark.createDataFrame([(k, [(-1.0, 0.5), (0.7, 0.5)]) for k in range(100)] + [(500, [(1.1, 1.0), (1.3, 0.5)])], "id long, points array<struct<lon:double,lat:double>>")
    found = spatial.search(frames, geometry=zones, key="t", cell=0.5)
    assert Counter(r.t for r in found.collect()) == Counter([10 * j + k for j in range(200) for k in (0, 1, 2, 4)] + [9, 9])
    assert 0 < _pairs_compared(found) < 200


def test_intersecting_compares_equal_lines_once(spark):
    zones = spark.createDataFrame([(k, [(-1.0, 0.5), (0.7, 0.5)]) for k in range(100)] + [(500, [(1.1, 1.0), (1.3, 0.5)])], "id long, points array<struct<lon:double,lat:double>>")
    found = spatial.intersecting(_copied_lines(spark), zones, "t", "id")
    want = [(10 * j + k, z) for j in range(200) for k in range(3) for z in range(100)] + [(10 * j + 4, 500) for j in range(200)] + [(9, z) for z in range(100)]
    assert found.columns == ["t", "id"] and Counter(map(tuple, found.collect())) == Counter(want)
    assert 0 < _pairs_compared(found) < 200


def test_clipped_compares_equal_lines_once(spark):
    zones = spark.createDataFrame([(k, [(-1.0, 0.5), (0.7, 0.5), (-1.0, 0.75)]) for k in range(100)], "id long, points array<struct<lon:double,lat:double>>")
    found = spatial.clipped(_copied_lines(spark), zones, "t", "id")
    got = {(r.t, r.id): (*r.first, *r.last) for r in found.collect()}
    second = lambda x: 0.5 + 0.25 * (0.7 - x) / 1.7
    want = {(t, z): (0.3 * k, 0.5, 0.3 * k, second(0.3 * k)) for k in range(3) for t in [10 * j + k for j in range(200)] + [9] * (k == 0) for z in range(100)}
    assert got.keys() == want.keys() and found.count() == len(want) and all(v == pytest.approx(want[k]) for k, v in got.items())
    assert 0 < _pairs_compared(found) < 200


def test_track_bounds_look_equal_tracks_up_once(spark):
    """Against bounds of all pairs; tracks of equal points are told apart by their samples."""
    tracks = _copied_lines(spark)
    zones = spark.createDataFrame([(k, [(-1.0, 0.5), (0.7, 0.5), (-1.0, 0.75)]) for k in range(100)], "id long, points array<struct<lon:double,lat:double>>")
    rows = [(10 * j + k, 0.25 * i - 1, 0.3 * k, float(i + 100 * (j == 7))) for j in range(200) for k in range(6) if (j, k) != (8, 1) for i in range(9)]
    samples = spark.createDataFrame(rows, "t long, lat double, lon double, x_km double")
    found = spatial.track_bounds(tracks, zones, samples, "t", "id")
    plain = spatial.along_track_bounds(spatial.clipped(tracks, zones, "t", "id"), samples, "t", "id")
    got = Counter(map(tuple, found.collect()))
    assert got == Counter(map(tuple, plain.select(*found.columns).collect())) and got.total() == 60100
    assert {r[2:] for r in got if r[0] == 71} == {(106.0, 106.0, 100.0, 100.0)} and {r[2:] for r in got if r[0] == 81} == {(None,) * 4}
    assert 0 < _pairs_compared(found) < 200


def _most_joined(df):
    """Rows of the join that gave most, by the plan that ran."""
    df.collect()
    most, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            stack.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            stack.append(node.plan())
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
        stack += [node.children().apply(k) for k in range(node.children().size())]
    return most


def test_track_bounds_of_equal_lines_are_finished_once_and_keys_join_as_lists(spark, monkeypatch):
    """Whatever the lists' length, and with keys that are NULL, the rows are the same; no join makes a row for each pair of keys."""
    tracks = _copied_lines(spark).unionByName(spark.createDataFrame([(None, [(0.0, -1.0), (0.0, 1.0)])], "t long, points array<struct<lon:double,lat:double>>"))
    zones = spark.createDataFrame([(k, [(-1.0, 0.5), (0.7, 0.5), (-1.0, 0.75)]) for k in [*range(100), None]], "id long, points array<struct<lon:double,lat:double>>")
    samples = spark.createDataFrame([(10 * j + k, 0.25 * i - 1, 0.3 * k, float(i)) for j in range(200) for k in range(6) for i in range(9)], "t long, lat double, lon double, x_km double")
    half = lambda found: found.withColumn("lat_first", F.col("lat_first") / 2)
    plain = half(spatial.along_track_bounds(spatial.clipped(tracks, zones, "t", "id"), samples, "t", "id"))
    want = Counter(map(tuple, plain.collect()))
    assert want.total() == 602 * 101 and any(r[0] is None and r[1] is None for r in want)
    for n in (spatial.LISTED, 7):
        monkeypatch.setattr(spatial, "LISTED", n)
        found = spatial.track_bounds(tracks, zones, samples, "t", "id", finish=half)
        assert Counter(map(tuple, found.select(*plain.columns).collect())) == want
    monkeypatch.undo()
    assert _most_joined(spatial.track_bounds(tracks, zones, samples, "t", "id")) < 5000


def test_clipped_of_equal_lines_is_finished_once(spark):
    zones = spark.createDataFrame([(k, [(-1.0, 0.5), (0.7, 0.5), (-1.0, 0.75)]) for k in [*range(100), None]], "id long, points array<struct<lon:double,lat:double>>")
    lat = lambda found: found.withColumn("lat", F.col("last.lat")).drop("first", "last")
    found, plain = spatial.clipped(_copied_lines(spark), zones, "t", "id", finish=lat), lat(spatial.clipped(_copied_lines(spark), zones, "t", "id"))
    assert found.columns == ["t", "id", "lat"]
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, plain.collect())) and found.count() == 601 * 101
    assert _most_joined(found) < 5000


@pytest.mark.parametrize("name", ["track_bounds", "zone_bounds"])
def test_bounds_are_rounded_before_keys_become_rows(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    rows, _, rest = plan.partition("Generate explode(_other_keys")
    assert "round(" not in rows and "round(" in rest


def test_changepoint_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    for n in (3, 5, 7):
        log_p, g = np.log(rng.uniform(0.1, 1, (n, n))), 1 / (n + 1)
        total, at = 0.0, np.zeros(n - 1)
        for bits in range(2 ** (n - 1)):
            cuts = [k for k in range(n - 1) if bits >> k & 1]
            starts, ends = [0, *(c + 1 for c in cuts)], [*cuts, n - 1]
            w = math.exp(sum(log_p[a, b] for a, b in zip(starts, ends))) * g ** len(cuts) * (1 - g * (ends[-1] - starts[-1]))
            total += w
            at[cuts] += w
        assert np.allclose(changepoint.marginals(log_p, g), at / total)


@pytest.mark.parametrize("model", ["gauss", "ifm", "fullcov"])
def test_changepoint_finds_a_planted_step(model):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)) * 0.3
    x[37:] += 3
    assert abs(int(np.argmax(changepoint.posterior(x, model, trim=3))) - 36) <= 2
    with pytest.raises(ValueError):
        changepoint.posterior(x, "other")


@pytest.mark.parametrize("model", ["gauss", "ifm", "fullcov"])
@pytest.mark.parametrize("scale", [0.01, 1.0, 100.0, 1000.0])
def test_changepoint_does_not_depend_on_the_unit(model, scale):
    rng = np.random.default_rng(2)
    for n in (20, 60, 120):
        x = rng.normal(size=(n, 4)) * 0.3
        x[n * 3 // 5 :] += 3
        p = changepoint.posterior(x * scale, model, trim=3)
        assert abs(int(np.argmax(p)) - (n * 3 // 5 - 1)) <= 2
        assert np.allclose(p, changepoint.posterior(x, model, trim=3), atol=1e-6)


def test_changepoint_of_series_without_spread():
    for x in (np.zeros((15, 4)), np.full((15, 4), 7.0), np.repeat([[0.0, 1, 2, 3]], 15, axis=0)):
        for model in changepoint.MODELS:
            p = changepoint.posterior(x, model)
            assert np.isfinite(p).all() and p.sum() == pytest.approx(1)


def brute_likelihood(x, model):
    """ln of a segment's likelihood from the samples alone, by determinants and gamma functions."""
    n, d = len(x), x.shape[1]
    v = np.var(x)
    if model == "ifm":
        each = [-(n / 2) * math.log(math.pi) + d / 2 * math.log(v) - math.lgamma(d / 2) + math.lgamma((d + n) / 2) - (d + n) / 2 * math.log(v + (c * c).sum()) for c in x.T]
        return sum(each)
    multi = lambda a: d * (d - 1) / 4 * math.log(math.pi) + sum(math.lgamma(a - j / 2) for j in range(d))
    det = lambda m: np.linalg.slogdet(m)[1]
    return -(d * n / 2) * math.log(math.pi) + d / 2 * det(v * np.eye(d)) - multi(d / 2) + multi((d + n) / 2) - (d + n) / 2 * det(v * np.eye(d) + x.T @ x)


@pytest.mark.parametrize("model", ["ifm", "fullcov"])
def test_changepoint_likelihoods_match_brute_force(model):
    x = np.random.default_rng(5).normal(size=(9, 4)) * [1, 5, 0.2, 30] + [0, 40, 1, -60]
    found = changepoint.MODELS[model](x)
    for t in range(9):
        for s in range(t, 9):
            assert found[t, s] == pytest.approx(brute_likelihood(x[t : s + 1], model), abs=1e-6)


def test_bayesian_gives_every_segment_an_answer(spark):
    rng = np.random.default_rng(4)
    rows = []
    for segment, n in ((1, 40), (2, 2), (3, 40), (4, 40)):
        for i in range(n):
            x = [float(v) + (5.0 if i >= 22 else 0.0) for v in rng.normal(size=4)]
            rows.append((segment, i, float(i), *(None if segment == 3 and i == 9 else v for v in x), None if segment == 4 else 0.0, None if segment == 4 else 39.0, "never grounded" if segment == 4 else ""))
    df = spark.createDataFrame(rows, "segment_id long, i long, x_km double, amp_f double, dA double, dfree double, dsurf double, wlo double, whi double, wreason string")
    p = detectors.bayesian(df, runs=("raw", "normalised"))
    found = {(r.segment_id, r.run, r.model): r for r in detectors.most_likely(p).collect()}
    assert len(found) == 2 * (3 + 1 + 1 + 1)
    for run in ("raw", "normalised"):
        assert all(found[1, run, m].map_km is not None and found[1, run, m].reason == "" for m in ("ifm", "fullcov", "mean"))
        assert found[2, run, "mean"].reason.startswith("fewer") and found[3, run, "mean"].reason.startswith("features") and found[4, run, "mean"].reason == "never grounded"
    # Channels are taken as of mean zero, so a step shows in raw features and not in ones centred between its levels.
    assert all(abs(found[1, "raw", m].map_km - 21) <= 3 for m in ("ifm", "fullcov", "mean"))
    with pytest.raises(ValueError):
        detectors.bayesian(df, models=("other",))
    with pytest.raises(ValueError):
        detectors.bayesian(df, primary="other")


def onset_profile(spark, way):
    n = 120
    k = np.arange(n) if way > 0 else np.arange(n)[::-1]
    smooth = np.where(k < 60, 0.0, 100.0)
    amp = -60 - np.clip((k - 60) / 10, 0, 1) * 25 + np.where(k % 2 == 0, 0.1, -0.1)
    amp[k == 52] = -80.0  # a blip
    rows = [(1, i, i * 0.5, float(amp[i]), -60.0 if k[i] < 60 else float(amp[i]), float(smooth[i]), 0.5) for i in range(n)]
    rows = [(*r[:4], float(amp[i]) if k[i] == 52 else r[4], *r[5:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "segment_id long, i long, x_km double, amp double, amp_f double, smooth double, dx double")
    edge = 25.0 if way > 0 else (n - 1) * 0.5 - 25.0
    lo, hi = (edge, edge + 20) if way > 0 else (edge - 20, edge)
    return df, spark.createDataFrame([(1, way, lo, hi)], "segment_id long, sign int, lo double, hi double")


@pytest.mark.parametrize("way", [1, -1])
def test_onset_is_the_first_sample_of_the_lasting_drop(spark, way):
    df, w = onset_profile(spark, way)
    df = detectors.windowed(df, w)
    r = detectors.onset(df).first()
    first = 61 if way > 0 else 120 - 1 - 61
    assert r.reason == "" and abs(r.map_km - first * 0.5) <= 1.0
    high = df.withColumn("amp_f", F.lit(-60.0))
    assert detectors.onset(high).first().reason == "power never drops"
    assert detectors.onset(df, least_km=50.0).first().reason == "floating reference is too short"


def test_gradient_detector_ignores_the_edges(spark):
    df = spark.createDataFrame([(1, k, float(k), 9.0 if k in (10, 30) else 5.0 if k == 20 else 0.1) for k in range(41)], "segment_id long, i long, x_km double, dA double")
    w = spark.createDataFrame([(1, 1, 10.0, 30.0)], "segment_id long, sign int, lo double, hi double")
    own = detectors.windowed(df, w)
    assert detectors.gradient(own).first().map_km == 20
    assert detectors.gradient_clipped(own).first().map_km == 20 and detectors.gradient_clipped(own, steepest=10.0).first().map_km == 10
    none = detectors.gradient(detectors.windowed(df, w.where("lo < 0"))).first()
    assert none.map_km is None and none.reason == "no search window"


def test_rise_takes_the_first_of_equal_signed_steps(spark):
    amp = [0.0, 0.0, 4.0, 4.0, -9.0, -9.0, -5.0, -5.0]
    df = spark.createDataFrame([(1, k, k * 0.5, v, 60.0 if k > 3 else 10.0) for k, v in enumerate(amp)], "segment_id long, i long, x_km double, amp double, thickness double")
    own = detectors.between_thick_ice(df)
    assert detectors.rise(own).first().map_km == 0.5 and detectors.rise(own, where=F.col("on_ice")).first().map_km == 2.5


def test_erf_fit_and_derivatives(spark):
    x = np.linspace(0, 20, 80)
    y = [12 * math.erf(0.25 * (v - 8)) - 3 + 0.01 * math.sin(9 * v) for v in x]
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "segment_id long, x double, y double")
    r = results.fitted_erf(df, "x", "y").first()
    assert (r.a, r.b, r.x0, r.c) == pytest.approx((12, 0.25, 8, -3), rel=0.01)
    d = spark.createDataFrame([(7.0,)], "x double").select(*physics.erf_model_derivatives(F.col("x"), 12.0, 0.25, 8.0)).first()
    f = lambda v: 12 * math.erf(0.25 * (v - 8))
    h = 1e-3
    assert tuple(d) == pytest.approx(((f(7 + h) - f(7 - h)) / 2 / h, (f(7 + h) - 2 * f(7) + f(7 - h)) / h**2, (f(7 + 2 * h) - 2 * f(7 + h) + 2 * f(7 - h) - f(7 - 2 * h)) / 2 / h**3), rel=1e-3)


def test_boxcar_edges(spark):
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate([1, 2, 4, 8, 16])], "segment_id long, i long, v double")
    got = lambda mode, n: [r.m for r in series.boxcar(df, "v", F.lit(n), "m", mode=mode).orderBy("i").collect()]
    assert got("reflect", 3) == pytest.approx([4 / 3, 7 / 3, 14 / 3, 28 / 3, 40 / 3])
    assert got("reflect", 4) == pytest.approx([(2 + 1 + 1 + 2) / 4, (1 + 1 + 2 + 4) / 4, 15 / 4, 30 / 4, 44 / 4])
    assert got("nearest", 5)[0] == pytest.approx((1 + 1 + 1 + 2 + 4) / 5)


def test_features_of_a_smooth_profile(spark):
    p = profile(spark, [400.0 + k for k in range(80)], [100.0 + 0.2 * k for k in range(80)], amp=[-60.0 - 0.5 * k if k % 9 else None for k in range(80)])
    out = features.computed(p).orderBy("i").toPandas()
    assert out[["amp_f", "dA", "dfree", "dsurf"]].notna().all().all()
    assert np.allclose(out["dA"][30:50], -1.0, atol=0.05) and abs(out["dsurf"]).max() < 0.6


def test_faults_and_bad_arrays(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (2, 0, 0.0), (2, 1, 0.0), (3, 0, 0.0), (3, 1, 1.0)], "segment_id long, i long, x_km double")
    assert {r.segment_id: r.reason for r in profiles.faults(df).collect()} == {1: "fewer than two samples", 2: "x does not increase"}
    with pytest.raises(ValueError):
        profiles.from_arrays(spark, 1, x_km=[0.0, 0.0], amp=1.0, h_surf=1.0, h_bed=0.0)


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("along_track,bed_power_dB\n0,-60\n500,NaN\n")
    (tmp_path / "b.csv").write_text("along_track,wgs84\n0,-500\n500,\n")
    p, b, s = profiles.csv_triple(spark, *(f"{tmp_path}/{x}.csv" for x in "pbb"))
    assert [r.bed_power_dB for r in p.orderBy("x_km").collect()] == [-60.0, None] and b.count() == s.count() == 1
    (tmp_path / "z.json").write_text('{"features": [{"properties": {"id": 4}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}}]}')
    z = profiles.geojson(spark, f"{tmp_path}/z.json")
    profiles.write_geojson(z, f"{tmp_path}/out")
    back = spark.read.json(f"{tmp_path}/out").first()
    assert back.geometry.coordinates == [[1.0, 2.0], [3.0, 4.0]] and back.properties.id == 4
    assert profiles.parse_slice("7:11") == (7, 11) and profiles.parse_slice(":3") == (None, 3)


def test_geoid_specification():
    assert physics.geoid_column("path") is None and physics.geoid_column(None) is not None and physics.geoid_column(14) is not None
    with pytest.raises(TypeError):
        physics.geoid_column(True)


def test_stream_equals_batch(spark, tmp_path):
    from firnspark.streaming.resample import streaming_mean

    rows = [(k, f"2024-01-01 00:{k // 6:02d}:{k % 6 * 10:02d}", float(k % 7)) for k in range(120)]
    df = spark.createDataFrame(rows, "k long, t string, v double").selectExpr("'a' AS g", "CAST(t AS TIMESTAMP) AS ts", "v")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streaming_mean(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "ts", "1 minute", ["v"], ["g"])
    q = stream.writeStream.outputMode("append").format("memory").queryName("means").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    batch = {(r.ts, r.v) for r in radar.tumbling_mean(df, "ts", "1 minute", ["v"], ["g"]).collect()}
    got = {(r.ts, r.v) for r in spark.sql("SELECT * FROM means").collect()}
    assert got and got <= batch and len(got) >= len(batch) - 1


def test_plot_layers_hold_the_front(spark):
    bed = [-571.0, -571.0, -469.0, -60.0, -40.0]
    df = spark.createDataFrame([(1, k, float(k), b, k >= 3, 1) for k, b in enumerate(bed[::-1])], "segment_id long, i long, x_km double, b double, c boolean, sign int")
    df = df.withColumn("c", F.col("b") > -100)
    got = results.held_front(df, "b", "c", "bed").orderBy("i").collect()
    assert [r.bed for r in got] == [-571.0] * 5 and [r.bed_held for r in got] == [True, True, True, False, False]


def test_boxcar_of_segments_shorter_than_the_window(spark):
    rows = [(1, k, float(k * k)) for k in range(3)] + [(2, 0, 5.0)] + [(3, k, None) for k in range(4)]
    df = spark.createDataFrame(rows, "segment_id long, i long, v double")
    for size in (4, 7, 11):
        got = {(r.segment_id, r.i): r.m for r in series.boxcar(df, "v", F.lit(size), "m").collect()}
        lo = -(size // 2)
        mirrored = lambda v, j: v[j % (2 * len(v))] if j % (2 * len(v)) < len(v) else v[2 * len(v) - 1 - j % (2 * len(v))]
        for segment, v in ((1, [0.0, 1.0, 4.0]), (2, [5.0])):
            for k in range(len(v)):
                assert got[segment, k] == pytest.approx(sum(mirrored(v, k + lo + j) for j in range(size)) / size)
        assert got[3, 1] is None and len(got) == len(rows)


def test_reader_says_what_it_leaves_out(spark):
    from firnspark.plans import reader

    frames, layers, track = profiles.radar_from_events(spark, SF)
    ids = [r[0] for r in track.select("segment_id").distinct().orderBy("segment_id").limit(3).collect()]
    some = [t.where(F.col("segment_id").isin(ids)) for t in (frames, layers, track)]
    some[1] = some[1].where((F.col("segment_id") != ids[1]) | (F.col("layer") == "standard:surface"))
    some[0] = some[0].where((F.col("segment_id") != ids[2]) | (F.col("slow_time") < "1970-01-01 00:00:01"))
    out = reader.profiles_from_radar(*some, "4 seconds")
    assert {r.segment_id for r in out.select("segment_id").distinct().collect()} == {ids[0]}
    assert {r.segment_id: r.reason for r in reader.faults(*some, "4 seconds").collect()} == {ids[1]: "no surface and bottom picks", ids[2]: "series do not overlap"}


def test_rasters_that_are_missing_or_elsewhere(spark, tmp_path):
    from firnspark.plans import reader

    with pytest.raises(FileNotFoundError):
        profiles.raster(spark, str(tmp_path / "none"), ["geoid"])
    own = spark.createDataFrame([(1, 0, 80.6, -60.5), (1, 1, None, None)], "segment_id long, i long, lat double, lon double")
    profiles.write_raster(spark.createDataFrame([("geoid", 0, 0, 7.5)], "var string, col long, row long, value double"), str(tmp_path / "r"))
    got = reader.with_geoid(own, str(tmp_path / "r"), (-272709.98, -983360.43)).orderBy("i").collect()
    assert [r.geoid_m for r in got] == [7.5, None]
    assert [r.geoid_m for r in reader.with_geoid(own, 3).collect()] == [3.0, 3.0] and [r.geoid_m for r in reader.with_geoid(own, None).collect()] == [0.0, 0.0]
    with pytest.raises(ValueError):
        reader.with_geoid(own, str(tmp_path / "r"))


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from firnspark.sources import catalog

    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda k: None), getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        catalog.shared(SimpleNamespace(sparkContext=context))
