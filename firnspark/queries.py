"""The registered queries: every operator on a profile made of the events table, or on the tables themselves."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnspark.functions import physics, projection
from firnspark.operators import joins, radar, series, spatial
from firnspark.plans import detectors, features, flotation, flow, reader, results, screening
from firnspark.sources import catalog, profiles

KEY = "segment_id"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and no negative zero, so that two engines give equal values."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _profile(spark, sf_dir):
    return profiles.from_events(spark, sf_dir)


def _masked(spark, sf_dir):
    return physics.with_physics(_profile(spark, sf_dir))


def _analysed(spark, sf_dir):
    return flotation.analysed(_profile(spark, sf_dir))


def _track(spark, sf_dir):
    return flow.angled(flow.headed(_masked(spark, sf_dir)))


#: Samples of the detectors' profile are this far apart, so that its floating stretch is as long as they ask for.
WIDE_KM = 1.0


def _windowed(spark, sf_dir):
    """Samples, twice as far apart, with physics, smoothed residual and their segment's search window."""
    return flotation.with_window(flotation.analysed(profiles.from_events(spark, sf_dir, WIDE_KM)))


def _featured(spark, sf_dir):
    """The detectors' input: every feature, low-passed as the detectors have it."""
    return features.computed(_windowed(spark, sf_dir))


@query
def profile_physics(spark, sf_dir):
    return rounded(_masked(spark, sf_dir).select(KEY, "i", "x_km", "thickness", "h_surf_msl", "h_bed_msl", "residual", "hab"))


@query
def layer_physics(spark, sf_dir):
    """Height above buoyancy of two layers, freeboard, draft, and the filter's cutoff as a share of Nyquist."""
    own = series.spacing(_profile(spark, sf_dir))
    hab = physics.buoyancy_of_layers(F.col("h_surf"), F.col("h_bed"), F.col("geoid_m"))
    cut = physics.cutoff_column(features.POWER_KM)
    return rounded(own.select(KEY, "i", hab.alias("hab"), (F.col("h_surf") - F.col("geoid_m")).alias("freeboard"), physics.draft(F.col("h_surf"), F.col("geoid_m")).alias("draft"), cut.alias("wn")))


@query
def segment_summary(spark, sf_dir):
    return rounded(flotation.summary(_profile(spark, sf_dir)))


@query
def sample_masks(spark, sf_dir):
    out = _masked(spark, sf_dir)
    return out.select(KEY, "i", "nan", "degenerate", "ice", "water", physics.flotation_class(F.col("residual")).alias("class"))


@query
def crop_window(spark, sf_dir):
    own = _profile(spark, sf_dir)
    bounds = own.groupBy(KEY).agg(F.lit(5.0).alias("lo"), (F.max("x_km") / 2).alias("hi"))
    return rounded(flotation.cropped(own, bounds).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.min("x_km").alias("x0"), F.max("x_km").alias("x1"), F.avg("geoid_m").alias("geoid")))


@query
def spacing_and_extent(spark, sf_dir):
    return rounded(series.spacing(_profile(spark, sf_dir)).groupBy(KEY).agg(F.first("dx").alias("dx"), F.first("n").alias("n"), F.min("x_km").alias("x0"), F.max("x_km").alias("x1")))


@query
def gradients(spark, sf_dir):
    own = _profile(spark, sf_dir).withColumn("u", F.col("x_km") + F.col("i") * F.col("i") * 0.01)
    return rounded(own.select(KEY, "i", series.difference("h_surf").alias("step"), series.gradient_unit("h_surf").alias("unit"), series.gradient("h_surf", "u").alias("uneven")))


@query
def gap_fill(spark, sf_dir):
    own = series.filled(_profile(spark, sf_dir), "amp", "both_ways")
    own = series.filled(own, "amp", "limited", most=2)
    return rounded(own.select(KEY, "i", "both_ways", "limited"))


@query
def bridged_layers(spark, sf_dir):
    own = results.bridged(_profile(spark, sf_dir), "h_bed", "bed")
    return rounded(own.withColumn("joined", series.dilated("bed_gap")).select(KEY, "i", "bed", "bed_gap", "joined"))


@query
def mask_runs(spark, sf_dir):
    return series.runs(_masked(spark, sf_dir), "water").select(KEY, "start", "stop").union(series.runs(_masked(spark, sf_dir), "nan").select(KEY, "start", "stop"))


@query
def nan_blocks(spark, sf_dir):
    return rounded(series.gaps(_profile(spark, sf_dir)))


@query
def terminus_crossings(spark, sf_dir):
    return rounded(flotation.termini(_masked(spark, sf_dir)))


@query
def smoothed_residual(spark, sf_dir):
    own = _analysed(spark, sf_dir)
    return rounded(own.select(KEY, "i", "smooth", (F.col("smooth") < 10).alias("floating"), (F.col("smooth") > 30).alias("grounded")))


@query
def landward_sign(spark, sf_dir):
    return flotation.orientation(_analysed(spark, sf_dir)).withColumn("sign", F.col("sign").cast("long"))


@query
def flotation_window(spark, sf_dir):
    return rounded(flotation.windows(_analysed(spark, sf_dir)).withColumn("sign", F.col("sign").cast("long")))


def _two_series(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    kind = lambda k: e.where(F.col("event_type") == k)
    return kind("click").select("user_id", "event_id", "us"), e.where("event_type <> 'click'").groupBy("user_id", "us").agg(F.min("value").alias("value"))


@query
def nearest_join(spark, sf_dir):
    left, right = _two_series(spark, sf_dir)
    free = joins.nearest(left, right, "us", ["value"], ["user_id"]).withColumnRenamed("value", "nearest")
    tight = joins.nearest(left, right, "us", ["value"], ["user_id"], F.lit(3_600_000_000 * 12)).select("event_id", F.col("value").alias("within"))
    return rounded(free.join(tight, "event_id"))


@query
def nearest_lookup(spark, sf_dir):
    return rounded(joins.nearest_row(_profile(spark, sf_dir), "x_km", F.lit(7.3), [KEY], ["i", "h_surf"]))


def _raster(spark):
    """vx and vy on a plane of 2 km cells around the tracks, in tiles of 512 cells."""
    cells = spark.range(400).select(F.col("id").alias("col")).crossJoin(F.broadcast(spark.range(200).select(F.col("id").alias("row"))))
    cells = cells.withColumns({"tile_col": F.floor(F.col("col") / 512).cast("long"), "tile_row": F.floor(F.col("row") / 512).cast("long")})
    return cells.withColumns({"vx": F.col("col") + 2.0 * F.col("row"), "vy": F.col("col") - 3.0 * F.col("row")})


@query
def raster_sample(spark, sf_dir):
    x, y = projection.forward(F.col("lat"), F.col("lon"))
    points = _profile(spark, sf_dir).drop("vx", "vy").withColumns({"px": x, "py": y})
    cells = joins.raster_cells(points, "px", "py", -320000.0, -950000.0, 2000.0, 2000.0)
    return rounded(joins.sampled(cells, _raster(spark), ["vx", "vy"]).select(KEY, "i", "col", "row", "vx", "vy"))


def _regrid(own: DataFrame) -> DataFrame:
    ext = series.spacing(own).groupBy(KEY).agg(F.min("x_km").alias("a"), F.max("x_km").alias("b"))
    return joins.uniform_grid(ext.select(KEY, (F.col("a") + 0.2).alias("lo"), (F.col("b") - 0.1).alias("hi"), F.lit(0.7).alias("dx")), [KEY])


@query
def regrid(spark, sf_dir):
    own = _profile(spark, sf_dir)
    grid = _regrid(own).select(KEY, "i", "x_km")
    return rounded(joins.regridded_all(grid, [(own, ["amp"], F.lit(0.6)), (own, ["lat"], None)], [KEY]))


@query
def outer_align(spark, sf_dir):
    own = _profile(spark, sf_dir)
    a, b = own.where("amp IS NOT NULL").select(KEY, "i", "amp"), own.where("h_bed IS NOT NULL").select(KEY, "i", "h_bed")
    return rounded(joins.outer_aligned([a, b], [KEY, "i"]))


@query
def terminus_names(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey, "inner").select("n_nationkey", "n_name", "r_name")


@query
def tumbling_mean(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = radar.tumbling_mean(e, "ts", "6 hours", ["value"], ["event_type"], keep_empty=True)
    return rounded(out.select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value"))


def _radar_frames(spark, sf_dir):
    """Twelve two-way times for each sample of a profile; amplitudes peak near the layers' picks."""
    own = _profile(spark, sf_dir)
    time = F.timestamp_micros(F.col("i") * 2_000_000)
    twtt = lambda k: F.lit(5e-6) + F.lit(2e-7) * k
    k = F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")
    frames = own.select(KEY, time.alias("slow_time"), "i", k).withColumn("twtt", twtt(F.col("k")))
    frames = frames.withColumn("data", (1.0 + ((F.col("i") * 7 + F.col("k") * 5) % 13)).cast("double"))
    pick = lambda name, j: own.where(F.col("i") % 5 != j).select(KEY, F.lit(f"standard:{name}").alias("layer"), F.timestamp_micros(F.col("i") * 2_000_000 + 400_000).alias("slow_time"), twtt(F.lit(3 + 4 * j)).alias("twtt"), F.lit(3000.0).alias("elev"))
    return frames.select(KEY, "slow_time", "twtt", "data"), pick("surface", 0).union(pick("bottom", 1))


@query
def reflection_power(spark, sf_dir):
    frames, layers = _radar_frames(spark, sf_dir)
    out = radar.reflection_power(frames, layers, "4 seconds")
    return rounded(out.select(KEY, F.unix_micros("slow_time").alias("us"), "surface_twtt", "surface_power_db", "bed_twtt", "bed_power_db"), 9)


@query
def layer_elevations(spark, sf_dir):
    _, layers = _radar_frames(spark, sf_dir)
    return rounded(radar.layer_elevations(layers).select(KEY, F.unix_micros("slow_time").alias("us"), "surface", "bed"), 4)


@query
def projected_track(spark, sf_dir):
    x, y = projection.forward(F.col("lat"), F.col("lon"))
    out = _profile(spark, sf_dir).select(KEY, "i", x.alias("px"), y.alias("py"))
    lat, lon = projection.inverse(F.col("px"), F.col("py"))
    out = series.with_distance(out, "px", "py", "along_m").withColumns({"lat": lat, "lon": lon})
    return rounded(out.select(KEY, "i", "px", "py", "along_m", "lat", "lon"), 3)


@query
def flow_angles(spark, sf_dir):
    return rounded(_track(spark, sf_dir).select(KEY, "i", "ex", "ey", "speed", "cos", "angle"), 4)


@query
def flow_alignment(spark, sf_dir):
    return rounded(flow.alignment(_track(spark, sf_dir)), 4)


@query
def along_flow_legs(spark, sf_dir):
    found = flow.legs(_track(spark, sf_dir))
    longest = flow.longest_leg(found).select(KEY, "lo", "hi", F.lit(True).alias("longest"))
    return rounded(found.select(KEY, "lo", "hi").join(longest, [KEY, "lo", "hi"], "left").withColumn("longest", F.coalesce("longest", F.lit(False))))


@query
def flotation_leg(spark, sf_dir):
    return rounded(flow.flotation_leg(_track(spark, sf_dir)))


@query
def segment_screening(spark, sf_dir):
    return rounded(screening.screened(_profile(spark, sf_dir), terminus_km=5.0), 4)


@query
def feature_table(spark, sf_dir):
    out = features.computed(_analysed(spark, sf_dir))
    return rounded(out.select(KEY, "i", "x_km", "amp_f", "dA", "dfree", "dfree_msl", "dsurf"), 3)


@query
def power_gradient(spark, sf_dir):
    return rounded(_featured(spark, sf_dir).select(KEY, "i", "amp_f", "dA"))


@query
def early_features(spark, sf_dir):
    """The features as the CSV tables' script has them: filtered power, its gradient with a hidden stretch, residual and slope."""
    out = features.early(series.spacing(_profile(spark, sf_dir)), hidden=(10.0, 12.0))
    return rounded(out.select(KEY, "i", "amp_e", "amp_shown", "dA_e", "dfree_e", "dsurf_e"), 3)


@query
def standardised_features(spark, sf_dir):
    own = _featured(spark, sf_dir).select(KEY, "i", "x_km", "amp_f", "dA")
    out = features.standardised(own, ["amp_f"])
    return rounded(features.standardised(out, ["dA"], F.col("x_km") < 10).select(KEY, "i", "amp_f", "dA"))


@query
def gradient_detector(spark, sf_dir):
    return rounded(detectors.gradient(_featured(spark, sf_dir)))


@query
def clipped_gradient(spark, sf_dir):
    return rounded(detectors.gradient_clipped(_featured(spark, sf_dir), steepest=2.0))


@query
def power_rise(spark, sf_dir):
    """The notebooks' gradient: over the whole track, and between the first and last thick ice."""
    own = detectors.between_thick_ice(_masked(spark, sf_dir))
    anywhere = detectors.rise(own).withColumn("scope", F.lit("track"))
    return rounded(anywhere.unionByName(detectors.rise(own, where=F.col("on_ice")).withColumn("scope", F.lit("thick ice"))))


@query
def onset_detector(spark, sf_dir):
    return rounded(detectors.onset(_featured(spark, sf_dir)))


def _posterior(spark, sf_dir):
    """A posterior in closed form: a bell over each segment's window."""
    own = flotation.with_window(_analysed(spark, sf_dir)).where("x_km BETWEEN wlo AND whi")
    return own.select(KEY, F.lit("raw").alias("run"), F.lit("mean").alias("model"), "x_km", F.exp(-F.pow(F.col("x_km") - F.col("x_cross"), F.lit(2)) / 8).alias("p"), F.lit("").alias("reason"))


@query
def credible_intervals(spark, sf_dir):
    p = _posterior(spark, sf_dir)
    return rounded(detectors.intervals(p).join(detectors.most_likely(p).drop("reason"), [KEY, "run", "model"]))


@query
def changepoint_posterior(spark, sf_dir):
    """Every model's posterior and their mean, as the script has them: three models, untrimmed."""
    p = detectors.bayesian(_featured(spark, sf_dir), models=("gauss", "ifm", "fullcov"), trim=0)
    return rounded(p, 5)


@query
def bayesian_changepoint(spark, sf_dir):
    p = catalog.kept(detectors.bayesian(_featured(spark, sf_dir)), "posterior")
    return rounded(detectors.most_likely(p).join(detectors.intervals(p, (0.68,)).drop("mass"), [KEY, "run", "model"], "left"))


@query
def changepoint_discordance(spark, sf_dir):
    """Raw and normalised features, the latter by the seaward stretch, with all models and no trimming."""
    own = _featured(spark, sf_dir)
    p = detectors.bayesian(own, models=("gauss", "ifm", "fullcov"), runs=("raw", "normalised"), trim=0, reference=F.col("smooth") < 10)
    return rounded(detectors.discordant(detectors.most_likely(p).where("model = 'mean'")))


def _results(own: DataFrame) -> DataFrame:
    """The answers of onset, changepoint and gradient for each segment, with its window and extent."""
    own = catalog.kept(own, "features")
    return results.report(own, [detectors.onset(own), detectors.changepoint_result(detectors.bayesian(own), results.windows_of(own)), detectors.gradient(own)])


@query
def transition_width(spark, sf_dir):
    return rounded(detectors.transition_width(_results(_featured(spark, sf_dir))))


@query
def zone_offsets(spark, sf_dir):
    """Each detector's answer against a zone that begins 2 km seaward of where the residual says the ice grounds."""
    own = catalog.kept(_featured(spark, sf_dir), "features")
    zone = own.groupBy(KEY).agg((F.first("x_cross") - 2.0 * F.first("sign")).alias("zone"))
    found = detectors.gradient(own).unionByName(detectors.onset(own)).select(KEY, "detector", "map_km").join(zone, KEY)
    return rounded(detectors.zone_offset(found, "zone"))


@query
def detection_report(spark, sf_dir):
    return rounded(_results(_featured(spark, sf_dir)).withColumn("sign", F.col("sign").cast("long")))


def _radar_tables(spark, sf_dir):
    """Frames, layers and tracks as the tables they are read from elsewhere."""
    return [catalog.kept(t, name) for t, name in zip(profiles.radar_from_events(spark, sf_dir), ("frames", "layers", "track"), strict=True)]


def _from_radar(spark, sf_dir, dx_km=None):
    frames, layers, track = _radar_tables(spark, sf_dir)
    return reader.profiles_from_radar(frames, layers, track, "4 seconds", dx_km, geoid=15.0, keep=catalog.kept)


@query
def radar_elevations(spark, sf_dir):
    _, layers, track = _radar_tables(spark, sf_dir)
    out = reader.elevations(layers, track, [KEY])
    return rounded(out.select(KEY, F.unix_micros("slow_time").alias("us"), "x_km", "lat", "lon", "h_surf", "h_bed"), 4)


@query
def radar_bed_power(spark, sf_dir):
    frames, layers, _ = _radar_tables(spark, sf_dir)
    out = reader.bed_power(frames, layers, "4 seconds", [KEY])
    return rounded(out.select(KEY, F.unix_micros("slow_time").alias("us"), "x_km", "amp"), 4)


@query
def radar_profile(spark, sf_dir):
    """Frames, picks and tracks read into profiles."""
    return rounded(_from_radar(spark, sf_dir), 3)


@query
def grounding_report(spark, sf_dir):
    """From radar frames to the report: read, crop, keep the leg that crosses flotation, find the window, detect, measure."""
    own = flotation.cropped_to(_from_radar(spark, sf_dir, F.lit(1.0)), F.lit(1.0), None)
    vx = F.when(F.col(KEY) % 5 == 4, 289.7777).otherwise(-77.6457)
    vy = F.when(F.col(KEY) % 5 == 4, -77.6457).otherwise(-289.7777)
    track = catalog.kept(flow.angled(flow.headed(physics.with_physics(own.withColumns({"vx": vx, "vy": vy})))), "tracks")
    leg = flow.on_best_leg(track, margin_km=8.0)
    own = catalog.kept(features.computed(flotation.with_window(flotation.smoothed(leg), 8.0)), "features")
    out = catalog.kept(results.report(own, [detectors.onset(own, least_km=4.0), detectors.changepoint_result(detectors.bayesian(own), results.windows_of(own)), detectors.gradient(own)]), "report")
    width = detectors.transition_width(out)
    return rounded(detectors.zone_offset(out.join(width, KEY), "wlo").withColumn("sign", F.col("sign").cast("long")), 3)


#: Degrees of a grid cell for these lines: a few times a track's piece, far less than a zone's.
CELL = 0.02


def _lines(spark, sf_dir):
    """Users' tracks and customers' zones as polylines in degrees."""
    own = _profile(spark, sf_dir)
    point = F.struct("lon", "lat")
    tracks = own.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("i", point.alias("p")))).alias("s")).select(KEY, F.transform("s", lambda s: s["p"]).alias("points"))
    c = table(spark, sf_dir, "customer")
    lon, lat = (-61.0 + (F.col("c_custkey") % 53) * 0.1), (80.0 + (F.col("c_custkey") % 31) * 0.01)
    at = lambda dx, dy: F.struct((lon + dx).alias("lon"), (lat + dy).alias("lat"))
    return tracks, c.select("c_custkey", F.array(at(0.0, 0.0), at(0.33, 0.031), at(0.71, -0.013)).alias("points"))


@query
def line_search(spark, sf_dir):
    tracks, zones = _lines(spark, sf_dir)
    return spatial.intersecting(tracks, zones, KEY, "c_custkey", CELL)


@query
def zone_bounds(spark, sf_dir):
    tracks, zones = _lines(spark, sf_dir)
    ends = {"first_lat": F.col("first.lat"), "last_lat": F.col("last.lat"), "last_lon": F.col("last.lon")}
    return spatial.clipped(tracks, zones, KEY, "c_custkey", CELL, lambda found: rounded(found.withColumns(ends).drop("first", "last")))


@query
def track_bounds(spark, sf_dir):
    """Where zones begin and end along each track: at the samples nearest in latitude and in longitude to the crossings."""
    tracks, zones = _lines(spark, sf_dir)
    return spatial.track_bounds(tracks, zones, _profile(spark, sf_dir), KEY, "c_custkey", CELL, rounded)


@query
def catalog_search(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("collection"), F.col("o_orderstatus").alias("segment"), F.year("o_orderdate").alias("year"), "o_orderkey")
    return spatial.search(o, ["1-URGENT", "2-HIGH"], ["O", "F"], (1993, 1996)).select("o_orderkey")


@query
def catalog_geometry(spark, sf_dir):
    """Tracks of a range of years that meet any of the zones asked for."""
    tracks, zones = _lines(spark, sf_dir)
    frames = tracks.withColumn("year", (F.lit(2000) + F.col(KEY) % 20).cast("int"))
    return spatial.search(frames, dates="2006/2015", geometry=zones.where("c_custkey % 53 < 5"), key=KEY, geometry_key="c_custkey", cell=CELL).select(KEY, "year")


@query
def termini_ingest(spark, sf_dir):
    """Termini from their converted tables: names and shapes by row, in degrees."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = n.select(F.col("n_nationkey").alias("row"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), (F.lit(2010) + F.col("n_nationkey") % 15).alias("year"))
    at = lambda dx: F.struct((F.col("n_nationkey") * 9000.0 - 300000.0 + dx).alias("x"), (F.lit(-1000000.0) - F.col("n_nationkey") * 500.0).alias("y"))
    shapes = n.where("n_nationkey <> 7").select(F.col("n_nationkey").alias("row"), F.array(at(0.0), at(4000.0)).alias("points"))
    out = catalog.termini(names, shapes, end_year=2021)
    named = catalog.region(r.select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name")), "EUROPE")
    out = out.join(named.select("region", F.lit(True).alias("in_region")), "region", "left")
    return rounded(out.select("row", "name", F.coalesce("in_region", F.lit(False)).alias("in_region"), F.col("points")[0]["lon"].alias("lon"), F.col("points")[1]["lat"].alias("lat")))


@query
def label_lookup(spark, sf_dir):
    """Rows by label, and a layer by its name."""
    p = table(spark, sf_dir, "part")
    return catalog.labelled(p, "p_partkey", [3, 17, 150]).select("p_partkey", F.lit("label").alias("by")).unionByName(catalog.labelled(p, "p_size", [7]).select("p_partkey", F.lit("layer").alias("by")))


@query
def geoid_sample(spark, sf_dir):
    """The geoid and the seabed along the tracks from a raster table, the seabed on the ellipsoid."""
    path = f"{catalog.shared(spark)}/firnspark-raster-{uuid.uuid4().hex}"
    cells = spark.range(400).select(F.col("id").alias("col")).crossJoin(F.broadcast(spark.range(200).select(F.col("id").alias("row"))))
    var = lambda name, value: cells.select(F.lit(name).alias("var"), "col", "row", value.cast("double").alias("value"))
    profiles.write_raster(var("geoid", 10 + F.col("col") * 0.01).unionByName(var("bed", -200 - F.col("row") * 1.5)), path)
    own = reader.with_geoid(_profile(spark, sf_dir).drop("geoid_m"), path, (-320000.0, -950000.0), 2000.0)
    return rounded(reader.bathymetry(own, path, (-320000.0, -950000.0), 2000.0).select(KEY, "i", "geoid_m", "seabed_m"))


@query
def erf_values(spark, sf_dir):
    return rounded(_profile(spark, sf_dir).select(KEY, "i", physics.erf_model(F.col("x_km"), 12.0, 0.25, 8.0, -3.0).alias("y")))


@query
def erf_derivatives(spark, sf_dir):
    d1, d2, d3 = physics.erf_model_derivatives(F.col("x_km"), 12.0, 0.25, 8.0)
    return rounded(_profile(spark, sf_dir).select(KEY, "i", d1.alias("d1"), d2.alias("d2"), d3.alias("d3")))


@query
def erf_fit(spark, sf_dir):
    own = _profile(spark, sf_dir).select(KEY, "x_km").withColumn("y", physics.erf_model(F.col("x_km"), 12.0, 0.25, 8.0, -3.0))
    return rounded(results.fitted_erf(own, "x_km", "y"), 3)


@query
def plot_layers(spark, sf_dir):
    own = flotation.with_window(_analysed(spark, sf_dir)).withColumn("map_km", F.col("x_cross"))
    out = results.plot_layers(own)
    return rounded(out.select(KEY, "i", "surface", "surface_gap", "bed", "bed_held", "thick_ice", "grounded", "collapsed", "joined_gap", "seabed"))


@query
def ahead_of_terminus(spark, sf_dir):
    own = flotation.with_window(_analysed(spark, sf_dir)).withColumn("map_km", F.col("x_cross"))
    return results.ahead_of_terminus(own).select(KEY, "i", "ahead")


@query
def plot_extent(spark, sf_dir):
    own = _analysed(spark, sf_dir)
    ext = results.data_extent(own, flotation.windows(own), 5.0)
    return rounded(ext.join(results.sea_level(own), KEY))


@query
def plateau_means(spark, sf_dir):
    p = results.plateaus(_profile(spark, sf_dir))
    q = _profile(spark, sf_dir).groupBy(KEY).agg(F.percentile("amp", F.array(F.lit(0.3), F.lit(0.97))).alias("q"))
    return rounded(p.join(q, KEY).select(KEY, "bright", "dark", F.col("q")[0].alias("p30"), F.col("q")[1].alias("p97")))


@query
def name_strings(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr("left(p_name, length(p_name) - 4)").alias("stem"), F.concat(F.lit("Data_"), "p_name").alias("product"), F.format_string("%s (%d)", "p_brand", "p_size").alias("label"))


@query
def frame_slice(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity")
    return profiles.sliced(own, "l_orderkey", "l_linenumber", profiles.parse_slice("1:3")).select("l_orderkey", "l_linenumber", "l_quantity").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query
def distinct_times(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"))
    both = e.union(e.where("event_id % 2 = 0"))
    return radar.first_of_each(both, ["user_id", "h"], ["event_id"]).select("user_id", F.unix_micros("h").alias("us"), "event_id", "event_type")


@query
def last_terminus(spark, sf_dir):
    t = flotation.termini(_masked(spark, sf_dir))
    first = t.withColumn("k", F.row_number().over(Window.partitionBy(KEY).orderBy("x_km"))).where("k <= 4")
    return rounded(first.groupBy(KEY).agg(F.max("x_km").alias("last"), F.count(F.lit(1)).alias("n")))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the screening verdict of every segment."""
    return segment_screening(spark, sf_dir)
