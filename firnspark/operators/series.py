"""Ordered-series operators: samples ordered by i within segment_id, all on one exchange by segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, ORDER = "segment_id", "i"
#: Parts of a moving window's width, in which its places are counted.
PARTS = 1 << 20


def along(*keys: str):
    return Window.partitionBy(*(keys or (KEY,))).orderBy(ORDER)


def whole(*keys: str):
    return Window.partitionBy(*(keys or (KEY,)))


def difference(c: str, *keys: str) -> Column:
    return F.col(c) - F.lag(c).over(along(*keys))


def gradient_unit(c: str, *keys: str) -> Column:
    """Central differences at unit spacing, one-sided at the ends."""
    w = along(*keys)
    before, after, own = F.lag(c).over(w), F.lead(c).over(w), F.col(c)
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    return F.when(first, after - own).when(last, own - before).otherwise((after - before) / 2)


def gradient(c: str, x: str = "x_km", *keys: str) -> Column:
    """Second-order differences for uneven spacing, one-sided at the ends."""
    w = along(*keys)
    fb, fa, f = F.lag(c).over(w), F.lead(c).over(w), F.col(c)
    s, d = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    inner = (s * s * fa + (d * d - s * s) * f - d * d * fb) / (s * d * (d + s))
    return F.when(s.isNull(), (fa - f) / d).when(d.isNull(), (f - fb) / s).otherwise(inner)


def spacing(profile: DataFrame, *keys: str) -> DataFrame:
    """profile with dx (median step of its segment) and n (samples)."""
    keys = keys or (KEY,)
    stepped = profile.withColumn("_step", difference("x_km", *keys))
    return stepped.withColumns({"dx": F.median("_step").over(whole(*keys)), "n": F.count(F.lit(1)).over(whole(*keys))}).drop("_step")


def filled(df: DataFrame, c: str, out: str, *keys: str, at: str = ORDER, ends: bool = True, most: int | None = None) -> DataFrame:
    """c with gaps filled linearly over `at`; ends held, or left NULL.

    most: only the first so many samples of a gap are interpolated, the last of them is carried on
    through the rest of it.
    """
    w, p = along(*keys), Window.unboundedPreceding
    before, after = w.rowsBetween(p, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(c).isNotNull(), F.col(at).cast("double"))
    df = df.withColumns({
        "_v0": F.last(c, ignorenulls=True).over(before), "_a0": F.last(known, ignorenulls=True).over(before),
        "_v1": F.first(c, ignorenulls=True).over(after), "_a1": F.first(known, ignorenulls=True).over(after),
    })
    into = F.col(at) - F.col("_a0")
    into = into if most is None else F.least(into, F.lit(float(most)))
    inner = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * into / (F.col("_a1") - F.col("_a0"))
    value = F.when(F.col(c).isNotNull(), F.col(c)).when(F.col("_v0").isNotNull() & F.col("_v1").isNotNull(), inner)
    if ends:
        value = value.otherwise(F.coalesce("_v0", "_v1"))
    return df.withColumn(out, value).drop("_v0", "_v1", "_a0", "_a1")


def boxcar(df: DataFrame, c: str, size: Column, out: str, *keys: str, mode: str = "reflect") -> DataFrame:
    """Moving mean of `size` samples, size // 2 of them before the sample, as wide as that at the ends too.

    size may differ by segment. Beyond the ends the series is mirrored (d c b a | a b c d | d c b a), again
    and again if it is short, or its end sample repeated ("nearest"). Samples near an end are repeated at
    the places beyond it, then one window takes the sums: places are counted in parts of a size, so that
    every window is as wide (sizes up to 2^19). No segment is gathered in a row.
    """
    keys = keys or (KEY,)
    df = df.withColumns({"_s": size.cast("long"), "_k": F.row_number().over(along(*keys)) - 1, "_n": F.count(F.lit(1)).over(whole(*keys))})
    k, n, s = F.col("_k").cast("long"), F.col("_n"), F.col("_s")
    lo = -F.floor(s / 2)
    hi = n - 1 + s - 1 + lo
    if mode == "nearest":
        before = F.when((k == 0) & (lo < 0), F.sequence(lo, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        after = F.when((k == n - 1) & (hi >= n), F.sequence(n, hi)).otherwise(F.array().cast("array<bigint>"))
        places = F.concat(F.array(k), before, after)
    else:
        turns = F.ceil(s / (2 * n)).cast("long")
        both = F.flatten(F.transform(F.sequence(-turns, turns), lambda r: F.array(k + 2 * n * r, 2 * n * r - 1 - k)))
        places = F.when((k >= s) & (k < n - s), F.array(k)).otherwise(F.filter(both, lambda p: p.between(lo, hi)))
    df = df.withColumn("_at", F.explode(places)).withColumn("_p", F.col("_at") * F.lit(float(PARTS)) / s)
    span = Window.partitionBy(*keys).orderBy("_p").rangeBetween(-PARTS // 2 - 1, PARTS // 2 - 1)
    mean = F.sum(c).over(span) / s
    return df.withColumn("_m", mean).where("_at = _k").withColumn(out, F.col("_m")).drop("_s", "_k", "_n", "_at", "_p", "_m")


def half_even(c: Column) -> Column:
    """Rounded to a whole number, halves to the even one."""
    return F.bround(c, 0)


def runs(df: DataFrame, mask: str, *keys: str) -> DataFrame:
    """(keys, start, stop): first and last i of each maximal run where mask is true."""
    keys = keys or (KEY,)
    marked = df.where(F.col(mask)).withColumn("_run", F.col(ORDER) - F.row_number().over(along(*keys)))
    return marked.groupBy(*keys, "_run").agg(F.min(ORDER).alias("start"), F.max(ORDER).alias("stop"), F.min("x_km").alias("x_start"), F.max("x_km").alias("x_stop")).drop("_run")


def gaps(profile: DataFrame, least_km: float = 0.3) -> DataFrame:
    """(segment_id, x_start, x_end) of runs without amp wider than least_km; the end is the first sample after the run, or the last."""
    w = along()
    marked = profile.withColumns({"_nan": F.col("amp").isNull(), "_next": F.coalesce(F.lead("x_km").over(w), F.col("x_km"))})
    marked = marked.where("_nan").withColumn("_run", F.col(ORDER) - F.row_number().over(w))
    found = marked.groupBy(KEY, "_run").agg(F.min("x_km").alias("x_start"), F.max("_next").alias("x_end"))
    return found.where(F.col("x_end") - F.col("x_start") > least_km).drop("_run")


def dilated(mask: str, *keys: str) -> Column:
    w = along(*keys)
    near = lambda f: F.coalesce(f(mask).over(w), F.lit(False))
    return F.col(mask) | near(F.lag) | near(F.lead)


def trimmed(c: str, k: int, *keys: str) -> Column:
    """c without its first and last k samples, unless there are no more than 2k."""
    w, n = along(*keys), F.count(F.lit(1)).over(whole(*keys))
    at = F.row_number().over(w)
    return F.when((n <= 2 * k) | ((at > k) & (at <= n - k)), F.col(c))


def with_distance(df: DataFrame, x: str, y: str, out: str, *keys: str) -> DataFrame:
    """df with the distance along the track from its first sample."""
    step = F.coalesce(F.hypot(difference(x, *keys), difference(y, *keys)), F.lit(0.0))
    total = F.sum("_step").over(along(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_step", step).withColumn(out, total).drop("_step")


def strictly_increasing(df: DataFrame, x: str = "x_km", *keys: str) -> DataFrame:
    """Rows with a finite x, the first of each run of equal x by i, numbered anew."""
    keys = keys or (KEY,)
    kept = df.where(F.col(x).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy(*keys, x).orderBy(ORDER))).where("_k = 1").drop("_k")
    return kept.withColumn(ORDER, (F.row_number().over(Window.partitionBy(*keys).orderBy(x)) - 1).cast("long"))
