"""The registered queries as DuckDB SQL, written from the definitions and not from the Spark plans."""

from __future__ import annotations

import math

from firnspark.constants import EARTH, LIGHT, MARGIN_PERMITTIVITY
from firnspark.functions.projection import SCALE, SQL_X, SQL_Y, E
from firnspark.operators.filtering import butterworth, steady_state
from firnspark.plans.features import GEOMETRY_KM, POWER_KM
from firnspark.sources.profiles import EVENTS_SQL, FRAMES_SQL, LAYERS_SQL, TRACK_SQL, TWTT_STEP

FF, DR = EARTH.flotation_factor, EARTH.density_ratio
SEG = "segment_id"


def with_(steps: dict[str, str], final: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in steps.items()) + "\n" + final


def r(c: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({c}, {digits}) + 0.0 AS {name or c}"


def rs(*cols: str, digits: int = 6) -> str:
    return ", ".join(r(c, digits=digits) for c in cols)


def fill(src: str, col: str, out: str, keys: str = SEG, at: str = "i", ends: bool = True, order: str = "i") -> str:
    """Linear fill over `at`, ends held or left NULL."""
    w = f"PARTITION BY {keys} ORDER BY {order}"
    end = "coalesce(_v0, _v1)" if ends else "NULL"
    return f"""SELECT * EXCLUDE (_v0, _v1, _a0, _a1), CASE WHEN {col} IS NOT NULL THEN {col}
      WHEN _v0 IS NOT NULL AND _v1 IS NOT NULL THEN _v0 + (_v1 - _v0) * ({at} - _a0) / (_a1 - _a0) ELSE {end} END AS {out}
      FROM (SELECT *, last_value({col} IGNORE NULLS) OVER b AS _v0, first_value({col} IGNORE NULLS) OVER a AS _v1,
        last_value(CASE WHEN {col} IS NOT NULL THEN CAST({at} AS DOUBLE) END IGNORE NULLS) OVER b AS _a0,
        first_value(CASE WHEN {col} IS NOT NULL THEN CAST({at} AS DOUBLE) END IGNORE NULLS) OVER a AS _a1 FROM {src}
        WINDOW b AS ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def boxcar(src: str, col: str, size: str, out: str, keys: tuple[str, ...] = (SEG,), mode: str = "reflect") -> str:
    """Mean over `size` places from size // 2 before, mirrored (or held) beyond the ends; src has k (from 0) and n."""
    on = " AND ".join(f"o.{k} = s.{k}" for k in keys)
    place = "least(greatest(j, 0), n - 1)" if mode == "nearest" else "CASE WHEN j < 0 THEN -1 - j WHEN j >= n THEN 2 * n - 1 - j ELSE j END"
    cols = ", ".join(keys)
    return f"""SELECT x.*, m.{out} FROM {src} x JOIN (
      SELECT {", ".join("o." + k for k in keys)}, o.k, avg(s.{col}) AS {out}
      FROM (SELECT {cols}, k, {place} AS p FROM (SELECT {cols}, k, n, unnest(range(k - ({size}) // 2, k - ({size}) // 2 + ({size}))) AS j FROM {src})) o
      JOIN {src} s ON {on} AND s.k = o.p GROUP BY ALL) m ON {" AND ".join(f"x.{k} = m.{k}" for k in keys)} AND x.k = m.k"""


def num(v: float) -> str:
    """A double; without the exponent it would be read as a decimal."""
    return f"{v:.17e}"


def lowpass(src: str, col: str, out: str, w: float, tag: str, order: int = 5) -> dict[str, str]:
    """{tag}: src with the zero-phase low-pass of col as out; the difference equation row by row, there and back.

    Segments not longer than the mirrored ends (three filter lengths) or without any value get NULL.
    """
    b, a = butterworth(order, w)
    start, pad = steady_state(b, a), 3 * (order + 1)
    z = [f"p{j + 1} + {num(b[j + 1])} * x - {num(a[j + 1])} * y AS z{j}" for j in range(order - 1)] + [f"{num(b[order])} * x - {num(a[order])} * y AS z{order - 1}"]
    step = lambda rows: f"SELECT segment_id, n, j, y, {', '.join(z)} FROM ({rows})"
    first = lambda d: step(f"SELECT segment_id, n, j, x, {', '.join(f'{num(s)} * x AS p{j}' for j, s in enumerate(start))}, {num(b[0])} * x + {num(start[0])} * x AS y FROM {d} WHERE j = 0")
    next_ = lambda d, f: step(f"SELECT d.segment_id, d.n, d.j, d.x, {', '.join(f'f.z{j} AS p{j}' for j in range(order))}, {num(b[0])} * d.x + f.z0 AS y FROM {f} f JOIN {d} d ON d.segment_id = f.segment_id AND d.j = f.j + 1")
    t = tag
    return {
        f"{t}a": f"SELECT segment_id, row_number() OVER (PARTITION BY segment_id ORDER BY i) - 1 AS k, i, count(*) OVER (PARTITION BY segment_id) AS n, {col} AS v FROM {src}",
        f"{t}b": fill(f"{t}a", "v", "f", at="k"),
        f"{t}c": f"SELECT segment_id, any_value(n) AS n, list(f ORDER BY k) AS l FROM {t}b GROUP BY segment_id HAVING any_value(n) > {pad} AND count(f) = any_value(n)",
        f"{t}d": f"SELECT segment_id, n, g + {pad} AS j, CASE WHEN g < 0 THEN 2 * l[1] - l[1 - g] WHEN g >= n THEN 2 * l[n] - l[2 * n - 1 - g] ELSE l[g + 1] END AS x FROM (SELECT *, unnest(range(-{pad}, n + {pad})) AS g FROM {t}c)",
        f"{t}e": f"{first(t + 'd')} UNION ALL {next_(t + 'd', t + 'e')}",
        f"{t}g": f"SELECT segment_id, n, n + {2 * pad - 1} - j AS j, y AS x FROM {t}e",
        f"{t}h": f"{first(t + 'g')} UNION ALL {next_(t + 'g', t + 'h')}",
        t: f"SELECT s.*, h.y AS {out} FROM {src} s JOIN {t}a a ON s.segment_id = a.segment_id AND s.i = a.i LEFT JOIN {t}h h ON h.segment_id = a.segment_id AND h.j = a.n + {pad - 1} - a.k",
    }


def profile(step: float = 0.5) -> dict[str, str]:
    return {"p": EVENTS_SQL.replace("{events}", "events").replace("{step}", repr(step))}


PROFILE = profile()
PHYSICS = PROFILE | {
    "ph": f"""SELECT *, h_surf - h_bed AS thickness, h_surf - geoid_m AS h_surf_msl, h_bed - geoid_m AS h_bed_msl,
      (h_surf - geoid_m) - (h_surf - h_bed) * {FF!r} AS residual, (h_surf - h_bed) - {DR!r} * (geoid_m - h_bed) AS hab,
      amp IS NULL AS nan, coalesce(h_surf = h_bed, false) AS degenerate, coalesce(h_surf - h_bed >= 25, false) AS ice FROM p""",
    "pm": "SELECT *, thickness IS NOT NULL AND NOT ice AND NOT degenerate AS water FROM ph",
}


def smooth_steps(src: str, keys: tuple[str, ...] = (SEG,), tag: str = "") -> dict[str, str]:
    k = ", ".join(keys)
    return {
        f"sa{tag}": f"SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY {k}) AS n, x_km - lag(x_km) OVER (PARTITION BY {k} ORDER BY i) AS step FROM {src}",
        f"sb{tag}": f"SELECT *, median(step) OVER (PARTITION BY {k}) AS dx FROM sa{tag}",
        f"sc{tag}": fill(f"sb{tag}", "residual", "filled", k, at="k"),
        f"sm{tag}": boxcar(f"sc{tag}", "filled", "CAST(greatest(3, round_even(5.0 / dx, 0)) AS BIGINT)", "smooth", keys),
    }


def terminus_steps(src: str, keys: tuple[str, ...] = (SEG,), tag: str = "") -> dict[str, str]:
    k = ", ".join(keys)
    return {
        f"ta{tag}": f"SELECT *, i - row_number() OVER (PARTITION BY {k}, water ORDER BY i) AS run, lag(ice) OVER w AS li, lag(x_km) OVER w AS lx, lead(ice) OVER w AS ri, lead(x_km) OVER w AS rx FROM {src} WINDOW w AS (PARTITION BY {k} ORDER BY i)",
        f"tb{tag}": f"SELECT {k}, run, max(x_km) - min(x_km) AS wide, arg_min(struct_pack(f := coalesce(li, false), x := lx), i) AS l, arg_max(struct_pack(f := coalesce(ri, false), x := rx), i) AS r FROM ta{tag} WHERE water GROUP BY ALL",
        f"t{tag}": f"SELECT {k}, l.x AS t FROM tb{tag} WHERE wide >= 1.0 AND l.f UNION ALL SELECT {k}, r.x FROM tb{tag} WHERE wide >= 1.0 AND r.f",
    }


def window_steps(margin: float, keys: tuple[str, ...] = (SEG,), tag: str = "") -> dict[str, str]:
    """w: the search window of each group of sm."""
    k, using = ", ".join(keys), f"USING ({', '.join(keys)})"
    return {
        f"wa{tag}": f"SELECT {k}, CASE WHEN regr_slope(smooth, x_km) >= 0 THEN 1 ELSE -1 END AS sign FROM sm{tag} GROUP BY {k}",
        f"wb{tag}": f"SELECT {k}, any_value(sign) AS sign, min(x_km) AS x0, max(x_km) AS x1, min(CASE WHEN smooth > 30 THEN x_km * sign END) AS c, min(x_km * sign) AS s FROM sm{tag} JOIN wa{tag} {using} GROUP BY {k}",
        f"wc{tag}": f"SELECT *, c * sign AS x_cross FROM wb{tag}",
        f"wt{tag}": f"SELECT {k}, max(t) AS t FROM t{tag} JOIN wc{tag} {using} WHERE abs(t - x_cross) <= {2 * margin} AND t * sign <= c GROUP BY {k}",
        f"wd{tag}": f"SELECT wc{tag}.*, CASE WHEN sign > 0 AND t IS NOT NULL THEN t ELSE greatest(x0, x_cross - {margin}) END AS l, CASE WHEN sign < 0 AND t IS NOT NULL THEN t ELSE least(x1, x_cross + {margin}) END AS h FROM wc{tag} LEFT JOIN wt{tag} {using}",
        f"w{tag}": f"SELECT *, CASE WHEN reason = '' THEN l END AS lo, CASE WHEN reason = '' THEN h END AS hi FROM (SELECT *, CASE WHEN x_cross IS NULL THEN 'never grounded' WHEN c = s THEN 'starts grounded' WHEN NOT coalesce(h > l, false) THEN 'window collapses at the terminus' ELSE '' END AS reason FROM wd{tag})",
    }


SMOOTH = PHYSICS | smooth_steps("pm")
WINDOW = SMOOTH | terminus_steps("pm") | window_steps(12.0)

_TRACK = {
    "fa": f"SELECT *, {SQL_X.format(lat='lat', lon='lon')} AS px, {SQL_Y.format(lat='lat', lon='lon')} AS py, row_number() OVER (PARTITION BY segment_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY segment_id) AS n FROM pm",
    "fb": boxcar("fa", "px", "5", "qx", mode="nearest"),
    "fc": boxcar("fb", "py", "5", "qy", mode="nearest"),
    "fd": "SELECT *, " + ", ".join(f"CASE WHEN lag({c}) OVER w IS NULL THEN lead({c}) OVER w - {c} WHEN lead({c}) OVER w IS NULL THEN {c} - lag({c}) OVER w ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2 END AS g{c}" for c in ("qx", "qy")) + " FROM fc WINDOW w AS (PARTITION BY segment_id ORDER BY i)",
    "fe": "SELECT *, gqx / sqrt(gqx * gqx + gqy * gqy) AS ex, gqy / sqrt(gqx * gqx + gqy * gqy) AS ey, sqrt(vx * vx + vy * vy) AS speed FROM fd",
    "ff": "SELECT *, CASE WHEN speed >= 50 THEN greatest(-1.0, least(1.0, (ex * vx + ey * vy) / speed)) END AS cos FROM fe",
    "tr": "SELECT * EXCLUDE (k, n), degrees(acos(abs(cos))) AS angle FROM ff",
}
TRACK = PHYSICS | _TRACK
_ALIGN = {
    "al_s": "SELECT *, sqrt((px - lag(px) OVER w) * (px - lag(px) OVER w) + (py - lag(py) OVER w) * (py - lag(py) OVER w)) AS step FROM tr WINDOW w AS (PARTITION BY segment_id ORDER BY i)",
    "al": """SELECT segment_id, quantile_cont(angle, 0.5) AS median_angle, quantile_cont(angle, 0.9) AS p90_angle,
      sum(step) / sqrt((arg_max(px, i) - arg_min(px, i)) * (arg_max(px, i) - arg_min(px, i)) + (arg_max(py, i) - arg_min(py, i)) * (arg_max(py, i) - arg_min(py, i))) AS sinuosity,
      greatest(avg(CASE WHEN cos > 0 THEN 1.0 WHEN cos < 0 THEN 0.0 END), avg(CASE WHEN cos < 0 THEN 1.0 WHEN cos > 0 THEN 0.0 END)) AS monotonic,
      median(speed) AS median_speed, avg(CASE WHEN cos IS NULL THEN 0.0 ELSE 1.0 END) AS valid, avg(CASE WHEN ice THEN 1.0 ELSE 0.0 END) AS ice_fraction FROM al_s GROUP BY segment_id""",
}
_LEGS = {
    "la": "SELECT *, CASE WHEN cos > 0 THEN 1 ELSE -1 END AS direction FROM tr WHERE coalesce(angle <= 30, false) AND cos <> 0",
    "lb": "SELECT *, i - row_number() OVER (PARTITION BY segment_id, direction ORDER BY i) AS leg FROM la",
    "lc": "SELECT *, min(x_km) OVER l AS leg_lo, max(x_km) OVER l AS leg_hi FROM lb WINDOW l AS (PARTITION BY segment_id, direction, leg)",
    "lg": "SELECT * FROM lc WHERE leg_hi - leg_lo >= 10",
}
LEGKEY = (SEG, "direction", "leg")
_SCORED = _LEGS | smooth_steps("lg", LEGKEY, "_l") | terminus_steps("lg", LEGKEY, "_l") | window_steps(3.5, LEGKEY, "_l") | {
    "sa_": "SELECT segment_id, direction, leg, any_value(leg_lo) AS leg_lo, any_value(leg_hi) AS leg_hi, any_value(lo) AS lo, any_value(hi) AS hi, count(CASE WHEN x_km BETWEEN lo AND hi THEN amp END) AS score, min(abs(CASE WHEN ice THEN hab END)) AS min_hab, coalesce(min(CASE WHEN ice THEN hab END) < 0 AND max(CASE WHEN ice THEN hab END) > 0, false) AS crosses FROM lg JOIN w_l USING (segment_id, direction, leg) WHERE reason = '' GROUP BY segment_id, direction, leg",
    "best": "SELECT * FROM sa_ WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY score DESC, leg_lo, leg_hi) = 1",
}

_GAPS = {
    "pr": "SELECT segment_id, i, nx, x_km, i - row_number() OVER (PARTITION BY segment_id ORDER BY i) AS run FROM (SELECT *, coalesce(lead(x_km) OVER (PARTITION BY segment_id ORDER BY i), x_km) AS nx FROM {src}) WHERE amp IS NULL",
    "pg": "SELECT segment_id, min(x_km) AS a, max(nx) AS b FROM pr GROUP BY segment_id, run HAVING max(nx) - min(x_km) > 0.3",
}


def gap_steps(src: str) -> dict[str, str]:
    return {k: v.replace("{src}", src) for k, v in _GAPS.items()}


def slope(src: str, col: str, out: str) -> str:
    """Second-order differences over x_km."""
    return f"""SELECT * EXCLUDE (fb, fn, hs_, hd_), CASE WHEN hs_ IS NULL THEN (fn - {col}) / hd_ WHEN hd_ IS NULL THEN ({col} - fb) / hs_ ELSE (hs_ * hs_ * fn + (hd_ * hd_ - hs_ * hs_) * {col} - hd_ * hd_ * fb) / (hs_ * hd_ * (hd_ + hs_)) END AS {out}
      FROM (SELECT *, lag({col}) OVER w AS fb, lead({col}) OVER w AS fn, x_km - lag(x_km) OVER w AS hs_, lead(x_km) OVER w - x_km AS hd_ FROM {src} WINDOW w AS (PARTITION BY segment_id ORDER BY i))"""


def feature_steps(src: str, dx: float) -> dict[str, str]:
    """ft: src with every feature of the detectors."""
    return lowpass(src, "amp", "amp_f", 2 * dx / POWER_KM, "lp") | lowpass("lp", "h_surf", "hs", 2 * dx / GEOMETRY_KM, "ls_") | lowpass("ls_", "h_bed", "hb", 2 * dx / GEOMETRY_KM, "lb_") | gap_steps(src) | {
        "pc": slope("lb_", "amp_f", "g"),
        "pd": "SELECT pc.*, CASE WHEN abs(g) <= 5 AND NOT EXISTS (SELECT 1 FROM pg WHERE pg.segment_id = pc.segment_id AND pc.x_km BETWEEN pg.a AND pg.b) THEN g END AS gm FROM pc",
        "pe": fill("pd", "gm", "dA"),
        "pf": slope("pe", "hs", "dsurf"),
        "ft": f"SELECT *, hs - (hs - hb) * {FF!r} AS dfree, hs - (hs - hb) * {FF!r} - geoid_m AS dfree_msl FROM pf",
    }


def _wide(step: float) -> dict[str, str]:
    return PHYSICS | profile(step) | smooth_steps("pm") | terminus_steps("pm") | window_steps(12.0)


#: The detectors' samples, 1 km apart: f has the features and the window.
_FEATURED = _wide(1.0) | feature_steps("sm", 1.0) | {"f": "SELECT ft.*, w.sign, w.x_cross, w.lo AS wlo, w.hi AS whi, w.reason AS wreason FROM ft JOIN w USING (segment_id)"}


def gradient_steps(src: str, col: str, trim: int, name: str, tag: str) -> dict[str, str]:
    return {
        f"{tag}a": f"SELECT segment_id, i, x_km, {col} AS d, row_number() OVER (PARTITION BY segment_id ORDER BY i) AS a, count(*) OVER (PARTITION BY segment_id) AS m FROM {src} WHERE x_km BETWEEN wlo AND whi",
        f"{tag}b": f"SELECT * FROM {tag}a WHERE d IS NOT NULL AND (m <= {2 * trim} OR (a > {trim} AND a <= m - {trim})) QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY abs(d) DESC, i) = 1",
        tag: f"SELECT w.segment_id, '{name}' AS detector, b.x_km AS map_km, w.lo, w.hi, b.d AS value, CASE WHEN w.reason <> '' THEN w.reason WHEN b.d IS NULL THEN 'gradient is missing in the search window' ELSE '' END AS reason FROM w LEFT JOIN {tag}b b USING (segment_id)",
    }


def onset_steps(src: str, least: float) -> dict[str, str]:
    return {
        "oa": f"SELECT *, coalesce(smooth < 10 AND amp_f IS NOT NULL AND CASE WHEN sign > 0 THEN x_km < wlo AND x_km >= wlo - 20 ELSE x_km > whi AND x_km <= whi + 20 END, false) AS ref FROM {src}",
        "ob": "SELECT segment_id, any_value(sign) AS sign, any_value(wlo) AS lo, any_value(whi) AS hi, any_value(wreason) AS wreason, any_value(greatest(3, round_even(2.0 / dx, 0))) AS persist, coalesce(max(CASE WHEN ref THEN x_km END) - min(CASE WHEN ref THEN x_km END), 0) AS span, median(CASE WHEN ref THEN amp_f END) AS baseline, stddev_pop(CASE WHEN ref THEN amp - amp_f END) AS sigma FROM oa GROUP BY segment_id",
        "oc": "SELECT oa.segment_id, i, x_km, i - row_number() OVER (PARTITION BY oa.segment_id ORDER BY i) AS run FROM oa JOIN ob USING (segment_id) WHERE x_km BETWEEN ob.lo AND ob.hi AND amp_f < baseline - 3 * sigma",
        "od": "SELECT segment_id, CASE WHEN any_value(sign) > 0 THEN min(x_km) ELSE max(x_km) END AS a, any_value(sign) AS sign FROM oc JOIN ob USING (segment_id) GROUP BY segment_id, run HAVING count(*) >= any_value(persist)",
        "oe": "SELECT segment_id, arg_min(a, a * sign) AS map_km FROM od GROUP BY segment_id",
        "og": f"SELECT segment_id, 'onset' AS detector, CASE WHEN reason = '' THEN map_km END AS map_km, lo, hi, CASE WHEN reason = '' THEN baseline - 3 * sigma END AS value, reason FROM (SELECT ob.*, map_km, CASE WHEN wreason <> '' THEN wreason WHEN span < {least} THEN 'floating reference is too short' WHEN map_km IS NULL THEN 'power never drops' ELSE '' END AS reason FROM ob LEFT JOIN oe USING (segment_id))",
    }


_GRADIENT = _FEATURED | gradient_steps("f", "dA", 3, "gradient", "gr")
_ONSET = _FEATURED | onset_steps("f", 8.0)
def log_add(a: str, b: str) -> str:
    return f"(greatest({a}, {b}) + ln(1 + exp(-abs(({a}) - ({b})))))"


#: ln P of a segment by model, from the sums of its samples: m of them, d channels, g{{j}}{{k}} the Gram matrix.
def _likelihood(model: str, d: int) -> str:
    lg = lambda k: f"lgamma(({k}) / 2.0)"
    if model == "gauss":
        return f"SELECT *, -m / 2.0 * ln(pi()) + {lg('m + 1')} - {lg('1')} - 0.5 * ln(1 + m) - (m + 1) / 2.0 * ln(1 + greatest(ys - yt * yt / m + (m / (m + 1.0)) * (yt / m) * (yt / m), 0)) AS lp FROM cp_p"
    if model == "ifm":
        logs = " + ".join(f"ln(v + g{j}{j})" for j in range(d))
        return f"SELECT *, {d} * (-(m / 2.0) * ln(pi()) + {d} / 2.0 * ln(v) - {lg(d)} + {lg(f'{d} + m')}) - (({d} + m) / 2.0) * ({logs}) AS lp FROM cp_p"
    cells, inner = [], "SELECT *, greatest(v, 1e-13 * trace) AS ridge FROM cp_p"
    for j in range(d):  # a Cholesky factor, column by column
        pivot = f"sqrt(g{j}{j} + ridge" + "".join(f" - l{j}{k} * l{j}{k}" for k in range(j)) + f") AS l{j}{j}"
        inner = f"SELECT *, {pivot} FROM ({inner})"
        below = [f"(g{j}{i}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + f") / l{j}{j} AS l{i}{j}" for i in range(j + 1, d)]
        inner = f"SELECT *, {', '.join(below)} FROM ({inner})" if below else inner
        cells.append(f"ln(l{j}{j})")
    multi = lambda k: " + ".join([f"{d * (d - 1) / 4!r} * ln(pi())", *(lg(f"{k} - {j}") for j in range(d))])
    return f"SELECT *, -({d} * m / 2.0) * ln(pi()) + {d * d / 2!r} * ln(ridge) + ({multi(f'{d} + m')}) - ({multi(d)}) - (({d} + m) / 2.0) * 2 * ({' + '.join(cells)}) AS lp FROM ({inner})"


def changepoint_steps(src: str, models: tuple[str, ...], trim: int, runs: dict[str, tuple[str, ...]], truncate: float = -50.0) -> dict[str, str]:
    """cp: the posterior by run and model and, as model mean, of all, and a row with the reason where there is none.

    src has segment_id, i, x_km, the window, and the columns of each run, the primary first.
    """
    d = len(next(iter(runs.values())))
    ks = range(d)
    each = " UNION ALL ".join(f"SELECT segment_id, '{run}' AS run, i, x_km, wlo, whi, wreason, {', '.join(f'{c} AS c{j}' for j, c in enumerate(cols))} FROM {src}" for run, cols in runs.items())
    key = "segment_id, run"
    cum = lambda e, name: f"sum({e}) OVER o AS {name}"
    sums = [cum(f"c{j} * c{k}", f"s{j}{k}") for j in ks for k in range(j, d)] + [cum("e1", "t1"), cum("e2", "t2"), cum("y", "y1"), cum("y * y", "y2")]
    names = [f"s{j}{k}" for j in ks for k in range(j, d)] + ["t1", "t2", "y1", "y2"]
    to = {f"s{j}{k}": f"g{j}{k}" for j in ks for k in range(j, d)} | {"t1": "et", "t2": "es", "y1": "yt", "y2": "ys"}
    entries = " + ".join(f"(c{j} - middle)" for j in ks), " + ".join(f"(c{j} - middle) * (c{j} - middle)" for j in ks)
    n_models = len(models)
    state = f"{key}, model"
    return {
        "cp_a": f"SELECT * FROM ({each}) WHERE x_km BETWEEN wlo AND whi",
        "cp_n": f"SELECT {key}, any_value(wreason) AS wreason, count(CASE WHEN x_km BETWEEN wlo AND whi THEN 1 END) AS n, coalesce(bool_and({' AND '.join(f'c{j} IS NOT NULL' for j in ks)}) FILTER (WHERE x_km BETWEEN wlo AND whi), true) AS all_there FROM ({each}) GROUP BY {key}",
        "cp_r": f"SELECT *, CASE WHEN wreason <> '' THEN wreason WHEN n < 3 THEN 'fewer than three samples in the search window' WHEN NOT all_there THEN 'features are missing in the search window' ELSE '' END AS reason FROM cp_n",
        "cp_b": f"SELECT a.*, row_number() OVER w - 1 AS t, r.n, ({' + '.join(f'avg(c{j}) OVER g' for j in ks)}) / {d}.0 AS middle, avg(c0) OVER g AS ym, stddev_pop(c0) OVER g AS yd FROM cp_a a JOIN cp_r r USING (segment_id, run) WHERE reason = '' WINDOW w AS (PARTITION BY segment_id, run ORDER BY i), g AS (PARTITION BY segment_id, run)",
        "cp_c": f"SELECT *, {entries[0]} AS e1, {entries[1]} AS e2, (c0 - ym) / CASE WHEN yd > 0 THEN yd ELSE 1 END AS y FROM cp_b",
        "cp_d": f"SELECT *, {', '.join(sums)}, sum(e2) OVER g / (n * {d}) AS whole, sum({' + '.join(f'c{j} * c{j}' for j in ks)}) OVER g AS trace FROM cp_c WINDOW o AS (PARTITION BY segment_id, run ORDER BY t ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY segment_id, run)",
        "cp_e": f"SELECT a.segment_id, a.run, a.t, b.t AS s, a.n, a.whole, a.trace, b.t - a.t + 1 AS m, {', '.join(f'b.{x} - coalesce(z.{x}, 0) AS {to[x]}' for x in names)} FROM cp_d a JOIN cp_d b ON a.segment_id = b.segment_id AND a.run = b.run AND b.t >= a.t LEFT JOIN cp_d z ON z.segment_id = a.segment_id AND z.run = a.run AND z.t = a.t - 1",
        "cp_p": f"SELECT *, greatest(es / (m * {d}) - (et / (m * {d})) * (et / (m * {d})), 1e-9 * CASE WHEN whole > 0 THEN whole ELSE 1 END) AS v FROM cp_e",
        "cp_l": " UNION ALL ".join(f"SELECT {key}, '{x}' AS model, t, s, n, lp FROM ({_likelihood(x, d)})" for x in models),
        "cp_row": f"SELECT {state}, t, any_value(n) AS n, list(lp ORDER BY s) AS l FROM cp_l GROUP BY {state}, t",
        "cp_col": f"SELECT {state}, s AS t, any_value(n) AS n, list(lp ORDER BY t) AS l FROM cp_l GROUP BY {state}, s",
        # Backward: l holds ln P(t, t..), q what may follow from t + 1 on; a term far below the sum so far ends it.
        "cp_q": f"""SELECT {state}, t, n, [l[1]] AS q FROM cp_row WHERE t = n - 1 UNION ALL
          SELECT {state}, t, n, list_prepend({log_add("acc", "l[len(q) + 1] + ln(greatest(1e-300, 1 - (n - 1 - t) / (n + 1.0)))")}, q) FROM (
            SELECT *, list_reduce(list_transform(range(1, len(q) + 1), lambda k: {{'a': l[k] + q[k] - ln(n + 1), 'e': false}}),
              lambda x, y: CASE WHEN x.e OR y.a - {log_add("x.a", "y.a")} < {truncate!r} THEN {{'a': x.a, 'e': true}} ELSE {{'a': {log_add("x.a", "y.a")}, 'e': false}} END).a AS acc
            FROM (SELECT {", ".join("r." + x for x in ("segment_id", "run", "model", "t", "n", "l"))}, cp_q.q FROM cp_q JOIN cp_row r ON r.segment_id = cp_q.segment_id AND r.run = cp_q.run AND r.model = cp_q.model AND r.t = cp_q.t - 1))""",
        # Forward: l holds ln P(0.., t), f the ways to end a segment at 0 .. t - 1.
        "cp_f": f"""SELECT {state}, t, n, [l[1] - ln(n + 1)] AS f FROM cp_col WHERE t = 0 UNION ALL
          SELECT {state}, t, n, list_append(f, {log_add("l[1] - ln(n + 1)", "top + ln(list_sum(list_transform(terms, lambda x: exp(x - top))))")}) FROM (
            SELECT *, list_max(terms) AS top FROM (SELECT *, list_transform(range(1, len(f) + 1), lambda k: f[k] + l[k + 1] - ln(n + 1)) AS terms
            FROM (SELECT {", ".join("c." + x for x in ("segment_id", "run", "model", "t", "n", "l"))}, cp_f.f FROM cp_f JOIN cp_col c ON c.segment_id = cp_f.segment_id AND c.run = cp_f.run AND c.model = cp_f.model AND c.t = cp_f.t + 1)))""",
        "cp_m": f"SELECT {state}, n, unnest(range(n - 1)) AS t, q, f FROM (SELECT * EXCLUDE (t) FROM cp_q WHERE t = 0) JOIN (SELECT {state}, f FROM cp_f WHERE t = n - 1) USING ({state})",
        "cp_o": f"SELECT {state}, t, n, CASE WHEN n - 1 > {2 * trim} AND (t < {trim} OR t >= n - 1 - {trim}) THEN 0 ELSE exp(f[t + 1] + q[t + 2] - q[1]) END AS p FROM cp_m",
        "cp_s": f"SELECT {state}, t, n, p / sum(p) OVER (PARTITION BY {state}) AS p FROM cp_o",
        "cp_g": f"SELECT {key}, t, any_value(n) AS n, exp(sum(ln(p + 1e-15)) / {n_models}) AS p FROM cp_s GROUP BY {key}, t",
        "cp_h": f"SELECT *, p / sum(p) OVER (PARTITION BY {key}) AS g FROM cp_g",
        "cp_i": f"SELECT *, (g + coalesce(lag(g) OVER w, g) + coalesce(lead(g) OVER w, g)) / 3 AS b FROM cp_h WINDOW w AS (PARTITION BY {key} ORDER BY t)",
        "cp_u": f"SELECT {state}, t, p FROM cp_s UNION ALL SELECT {key}, 'mean', t, b / sum(b) OVER (PARTITION BY {key}) FROM cp_i",
        "cp": f"SELECT {state}, x_km, p, '' AS reason FROM cp_u JOIN (SELECT {key}, t, x_km FROM cp_b) USING ({key}, t) UNION ALL SELECT {key}, 'mean', NULL, NULL, reason FROM cp_r WHERE reason <> ''",
        "cp_best": f"SELECT {state}, max(reason) AS reason, max(p) AS p FROM cp GROUP BY {state}",
        "cp_map": f"SELECT {state}, any_value(cp_best.reason) AS reason, any_value(cp_best.p) AS p, min(CASE WHEN cp.p = cp_best.p THEN x_km END) AS map_km FROM cp JOIN cp_best USING ({state}) GROUP BY {state}",
    }


_CHANNELS = ("dfree", "amp_f", "dA", "dsurf")
_ALL_MODELS = ("gauss", "ifm", "fullcov")
_BOCPD = changepoint_steps("f", ("ifm", "fullcov"), 6, {"raw": _CHANNELS})
_REPORT = _FEATURED | gradient_steps("f", "dA", 3, "gradient", "gr") | onset_steps("f", 8.0) | _BOCPD


def report_steps(src: str) -> dict[str, str]:
    """rp: a row for each segment and detector, from og, cp_map and gr."""
    return {
        "ru": "SELECT segment_id, detector, map_km, reason FROM gr UNION ALL SELECT segment_id, detector, map_km, reason FROM og UNION ALL SELECT segment_id, 'bocpd', map_km, reason FROM cp_map WHERE model = 'mean'",
        "re": f"SELECT segment_id, count(*) AS n, min(x_km) AS x0, max(x_km) AS x1, any_value(dx) AS dx, avg(geoid_m) AS geoid FROM {src} GROUP BY segment_id",
        "rg": "SELECT segment_id, count(*) AS n_gaps FROM pg GROUP BY segment_id",
        "rp": "SELECT segment_id, re.n, re.x0, re.x1, dx, geoid, coalesce(n_gaps, 0) AS n_gaps, CAST(w.sign AS BIGINT) AS sign, w.lo AS wlo, w.hi AS whi, detector, map_km, ru.reason, CASE WHEN map_km IS NULL THEN detector || ': ' || ru.reason ELSE detector || ': ' || printf('%.2f', map_km) || ' km' END AS summary FROM ru JOIN re USING (segment_id) LEFT JOIN rg USING (segment_id) JOIN w USING (segment_id)",
        "rw": "SELECT segment_id, any_value(sign) * (max(CASE WHEN detector = 'bocpd' THEN map_km END) - max(CASE WHEN detector = 'onset' THEN map_km END)) AS width_km FROM rp GROUP BY segment_id",
    }


_C = f"{LIGHT / 2!r}"
_ICE = f"{LIGHT / math.sqrt(EARTH.permittivity) / 2!r}"
_PICK = 50.0 / (LIGHT / math.sqrt(MARGIN_PERMITTIVITY))


def distance_steps(src: str, tag: str) -> dict[str, str]:
    """{tag}: src (segment_id, us, lat, lon) with x_km along its own track."""
    return {
        f"{tag}x": f"SELECT *, {SQL_X.format(lat='lat', lon='lon')} AS px, {SQL_Y.format(lat='lat', lon='lon')} AS py FROM {src}",
        f"{tag}y": f"SELECT *, coalesce(sqrt((px - lag(px) OVER w) * (px - lag(px) OVER w) + (py - lag(py) OVER w) * (py - lag(py) OVER w)), 0) AS d FROM {tag}x WINDOW w AS (PARTITION BY segment_id ORDER BY us)",
        tag: f"SELECT * EXCLUDE (px, py, d), sum(d) OVER (PARTITION BY segment_id ORDER BY us ROWS UNBOUNDED PRECEDING) / 1000 AS x_km FROM {tag}y",
    }


def between(src: str, v: str, tag: str, tolerance: str) -> dict[str, str]:
    """{tag}: (segment_id, i, v) of the grid gd, from src's samples on either side of each point."""
    near = "least(coalesce(x - xb, 1e300), coalesce(xa - x, 1e300))"
    value = "CASE WHEN xb IS NULL THEN va WHEN xa IS NULL OR xa = xb THEN vb ELSE vb + (va - vb) * (x - xb) / (xa - xb) END"
    return {
        f"{tag}k": f"SELECT segment_id, x_km, {v} AS v FROM {src} WHERE {v} IS NOT NULL",
        f"{tag}n": f"SELECT segment_id, count(*) AS n FROM {tag}k GROUP BY segment_id",
        f"{tag}b": f"SELECT g.segment_id, g.i, any_value(g.x_km) AS x, any_value(g.dx) AS dx, max(CASE WHEN k.x_km <= g.x_km THEN k.x_km END) AS xb, arg_max(k.v, k.x_km) FILTER (WHERE k.x_km <= g.x_km) AS vb, min(CASE WHEN k.x_km >= g.x_km THEN k.x_km END) AS xa, arg_min(k.v, k.x_km) FILTER (WHERE k.x_km >= g.x_km) AS va FROM gd g LEFT JOIN {tag}k k USING (segment_id) GROUP BY g.segment_id, g.i",
        tag: f"SELECT segment_id, i, CASE WHEN n >= 2 AND {near} <= {tolerance} THEN {value} END AS {v} FROM {tag}b LEFT JOIN {tag}n USING (segment_id)",
    }


def peak_steps(layer: str, out: str) -> dict[str, str]:
    return {
        f"{out}1": f"SELECT m.*, (SELECT l.twtt FROM ly l WHERE l.layer = 'standard:{layer}' AND l.segment_id = m.segment_id AND abs(l.us - m.us) <= 1000000 ORDER BY abs(l.us - m.us), l.us LIMIT 1) AS pick FROM mn m",
        out: f"SELECT segment_id, frame, us, CASE WHEN abs(data) > 0 THEN 10 * log10(abs(data)) END AS db FROM {out}1 WHERE twtt BETWEEN pick - {_PICK!r} AND pick + {_PICK!r} AND abs(data) > 0 QUALIFY row_number() OVER (PARTITION BY segment_id, frame, us ORDER BY db DESC, twtt) = 1",
    }


def radar_steps(dx: str) -> dict[str, str]:
    """rd: profiles read from the frames, layers and tracks of ev; el and bp: their elevations and bed power."""
    return {
        "ev": profile()["p"],
        "fr": FRAMES_SQL.format(p="ev"),
        "ly": LAYERS_SQL.format(p="ev"),
        "tk": TRACK_SQL.format(p="ev"),
    } | distance_steps("tk", "tx") | {
        "hp": "SELECT segment_id, us, max(CASE WHEN layer = 'standard:surface' THEN twtt END) AS ts, max(CASE WHEN layer = 'standard:bottom' THEN twtt END) AS tb, max(CASE WHEN layer = 'standard:surface' THEN elev END) AS elev FROM ly GROUP BY ALL",
        "hs1": f"SELECT segment_id, us, elev - ts * {_C} AS h_surf, elev - ts * {_C} - (tb - ts) * {_ICE} AS h_bed FROM hp WHERE ts IS NOT NULL",
        "hs2": "SELECT h.*, t.x_km, t.lat, t.lon FROM hs1 h JOIN tx t USING (segment_id) QUALIFY row_number() OVER (PARTITION BY segment_id, h.us ORDER BY abs(h.us - t.us), t.us) = 1",
        "el": "SELECT * FROM hs2 QUALIFY row_number() OVER (PARTITION BY segment_id, x_km ORDER BY us) = 1",
        "mn": f"SELECT segment_id, frame, us // 4000000 * 4000000 AS us, bin * {num(TWTT_STEP)} AS twtt, avg(data) AS data FROM fr GROUP BY ALL",
        "mp": "SELECT segment_id, frame, us // 4000000 * 4000000 AS us, avg(lat) AS lat, avg(lon) AS lon FROM (SELECT segment_id, frame, us, avg(lat) AS lat, avg(lon) AS lon FROM fr GROUP BY ALL) GROUP BY ALL",
    } | peak_steps("surface", "ps") | peak_steps("bottom", "pb") | {
        "tr1": "SELECT mp.*, pb.db AS amp FROM mp LEFT JOIN pb USING (segment_id, frame, us) LEFT JOIN ps USING (segment_id, frame, us) WHERE pb.us IS NOT NULL OR ps.us IS NOT NULL QUALIFY row_number() OVER (PARTITION BY segment_id, us ORDER BY frame) = 1",
    } | distance_steps("tr1", "ax") | {
        "bp": "SELECT * FROM ax QUALIFY row_number() OVER (PARTITION BY segment_id, x_km ORDER BY us) = 1",
        "pk": "SELECT * FROM el WHERE h_surf IS NOT NULL AND h_bed IS NOT NULL",
        "st": "SELECT segment_id, median(d) AS dx FROM (SELECT segment_id, x_km - lag(x_km) OVER (PARTITION BY segment_id ORDER BY x_km) AS d FROM bp) GROUP BY segment_id",
        "ex": f"SELECT segment_id, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi, {dx} AS dx FROM (SELECT segment_id, min(x_km) AS lo, max(x_km) AS hi FROM pk GROUP BY segment_id) a JOIN (SELECT segment_id, min(x_km) AS lo, max(x_km) AS hi FROM bp GROUP BY segment_id) b USING (segment_id) JOIN st USING (segment_id)",
        "gd": "SELECT segment_id, i, lo + i * dx AS x_km, dx FROM (SELECT *, unnest(range(CAST(floor((hi - lo) / dx + 1e-9) AS BIGINT) + 1)) AS i FROM ex WHERE hi > lo AND dx > 0)",
    } | between("bp", "amp", "ia", "2 * dx") | between("pk", "h_surf", "ih", "2 * dx") | between("pk", "h_bed", "ib", "2 * dx") | between("el", "lat", "it", "1e300") | between("el", "lon", "io", "1e300") | {
        "rd": "SELECT segment_id, i, x_km, amp, h_surf, h_bed, 15.0e0 AS geoid_m, lat, lon FROM gd JOIN ia USING (segment_id, i) JOIN ih USING (segment_id, i) JOIN ib USING (segment_id, i) JOIN it USING (segment_id, i) JOIN io USING (segment_id, i)",
    }


#: From frames to the report: cropped, cut to the leg, searched, measured.
_FLAGSHIP = radar_steps("1.0e0") | {
    "p": "SELECT * EXCLUDE (i), row_number() OVER (PARTITION BY segment_id ORDER BY i) - 1 AS i, CASE WHEN segment_id % 5 = 4 THEN 289.7777e0 ELSE -77.6457e0 END AS vx, CASE WHEN segment_id % 5 = 4 THEN -77.6457e0 ELSE -289.7777e0 END AS vy FROM rd WHERE x_km >= 1.0 QUALIFY count(*) OVER (PARTITION BY segment_id) >= 2",
} | {k: v for k, v in PHYSICS.items() if k != "p"} | _TRACK | _LEGS | smooth_steps("lg", LEGKEY, "_l") | terminus_steps("lg", LEGKEY, "_l") | window_steps(8.0, LEGKEY, "_l") | {
    k: _SCORED[k] for k in ("sa_", "best")
} | {
    "q": "SELECT tr.* EXCLUDE (i), row_number() OVER (PARTITION BY segment_id ORDER BY i) - 1 AS i FROM tr JOIN best USING (segment_id) WHERE x_km BETWEEN best.leg_lo AND best.leg_hi",
} | smooth_steps("q") | terminus_steps("q") | window_steps(8.0) | feature_steps("sm", 1.0) | {"f": _FEATURED["f"]} | gradient_steps("f", "dA", 3, "gradient", "gr") | onset_steps("f", 4.0) | _BOCPD | report_steps("f")


_POSTERIOR = WINDOW | {
    "q": "SELECT sm.segment_id, 'raw' AS run, 'mean' AS model, x_km, exp(-pow(x_km - x_cross, 2) / 8) AS p FROM sm JOIN w ON sm.segment_id = w.segment_id WHERE x_km BETWEEN lo AND hi",
    "qc": "SELECT *, sum(p) OVER (PARTITION BY segment_id ORDER BY x_km ROWS UNBOUNDED PRECEDING) / sum(p) OVER (PARTITION BY segment_id) AS c FROM q",
    "qm": "SELECT segment_id, arg_max(x_km, p) AS map_km FROM (SELECT * FROM q ORDER BY segment_id, x_km) GROUP BY segment_id",
}
_MARGIN = 50.0 / (LIGHT / math.sqrt(MARGIN_PERMITTIVITY))


def _frames() -> dict[str, str]:
    twtt = "CAST(5e-6 AS DOUBLE) + CAST(2e-7 AS DOUBLE) * {}"
    peak = lambda name, k, j: {
        f"{k}_pick": f"SELECT segment_id, i * 2000000 + 400000 AS us, {twtt.format(3 + 4 * j)} AS pick FROM p WHERE i % 5 <> {j}",
        f"{k}_near": f"SELECT m.segment_id, m.us, m.twtt, m.data, (SELECT q.pick FROM {k}_pick q WHERE q.segment_id = m.segment_id AND abs(q.us - m.us) <= 1000000 ORDER BY abs(q.us - m.us), q.us LIMIT 1) AS pick FROM mean m",
        f"{k}_db": f"SELECT *, CASE WHEN abs(data) > 0 THEN 10 * log10(abs(data)) END AS db FROM {k}_near WHERE twtt BETWEEN pick - {_MARGIN!r} AND pick + {_MARGIN!r}",
        k: f"SELECT segment_id, us, twtt AS {k}_twtt, db AS {k}_power_db FROM {k}_db WHERE db IS NOT NULL QUALIFY row_number() OVER (PARTITION BY segment_id, us ORDER BY db DESC, twtt) = 1",
    }
    return PROFILE | {
        "raw": f"SELECT segment_id, i * 2000000 AS us, {twtt.format('k')} AS twtt, CAST(1.0 + ((i * 7 + k * 5) % 13) AS DOUBLE) AS data FROM p, (SELECT unnest(range(12)) AS k)",
        "mean": "SELECT segment_id, (us // 4000000) * 4000000 AS us, twtt, avg(data) AS data FROM raw GROUP BY ALL",
    } | peak("surface", "surface", 0) | peak("bottom", "bed", 1)


_LINES = PROFILE | {
    "ln": "SELECT segment_id, i, lon AS ax, lat AS ay, lead(lon) OVER w AS bx, lead(lat) OVER w AS by_ FROM p WINDOW w AS (PARTITION BY segment_id ORDER BY i)",
    "ls": "SELECT * FROM ln WHERE bx IS NOT NULL",
    "zc": "SELECT c_custkey, -61.0::DOUBLE + (c_custkey % 53) * 0.1::DOUBLE AS lon, 80.0::DOUBLE + (c_custkey % 31) * 0.01::DOUBLE AS lat FROM customer",
    "zs": "SELECT c_custkey, lon + 0.0::DOUBLE AS cx, lat + 0.0::DOUBLE AS cy, lon + 0.33::DOUBLE AS dx, lat + 0.031::DOUBLE AS dy FROM zc UNION ALL SELECT c_custkey, lon + 0.33::DOUBLE, lat + 0.031::DOUBLE, lon + 0.71::DOUBLE, lat + -0.013::DOUBLE FROM zc",
    "zz": """SELECT segment_id, c_custkey, ls.*, zs.*,
      sign((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) AS d1, sign((dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx)) AS d2,
      sign((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) AS d3, sign((bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax)) AS d4 FROM ls, zs""",
}


_SHARED = """(d1 <> d2 AND d3 <> d4 AND d1 * d2 <= 0 AND d3 * d4 <= 0 AND NOT (d1 = 0 AND d2 = 0))
          OR (d1 = 0 AND ax BETWEEN least(cx, dx) AND greatest(cx, dx) AND ay BETWEEN least(cy, dy) AND greatest(cy, dy)) OR (d2 = 0 AND bx BETWEEN least(cx, dx) AND greatest(cx, dx) AND by_ BETWEEN least(cy, dy) AND greatest(cy, dy))
          OR (d3 = 0 AND cx BETWEEN least(ax, bx) AND greatest(ax, bx) AND cy BETWEEN least(ay, by_) AND greatest(ay, by_)) OR (d4 = 0 AND dx BETWEEN least(ax, bx) AND greatest(ax, bx) AND dy BETWEEN least(ay, by_) AND greatest(ay, by_))"""


def oracle_sql() -> dict[str, str]:
    """Query name -> SQL, for those that SQL can express."""
    out = {
        "profile_physics": with_(PHYSICS, f"SELECT segment_id, i, {rs('x_km', 'thickness', 'h_surf_msl', 'h_bed_msl', 'residual', 'hab')} FROM pm"),
        "segment_summary": with_(PHYSICS, f"SELECT segment_id, count(*) AS n, {r('avg(CASE WHEN ice THEN 1.0 ELSE 0.0 END)', 'ice_fraction')}, {r('min(abs(CASE WHEN ice THEN hab END))', 'min_hab')}, coalesce(min(CASE WHEN ice THEN hab END) < 0 AND max(CASE WHEN ice THEN hab END) > 0, false) AS hab_crosses_zero FROM pm GROUP BY segment_id"),
        "sample_masks": with_(PHYSICS, "SELECT segment_id, i, nan, degenerate, ice, water, CASE WHEN residual > 30 THEN 'grounded' WHEN residual >= 0 THEN 'near' WHEN residual < 0 THEN 'floating' END AS class FROM pm"),
        "crop_window": with_(PROFILE, f"SELECT segment_id, count(*) AS n, {r('min(x_km)', 'x0')}, {r('max(x_km)', 'x1')}, {r('avg(geoid_m)', 'geoid')} FROM p JOIN (SELECT segment_id, max(x_km) / 2 AS hi FROM p GROUP BY segment_id) b USING (segment_id) WHERE x_km BETWEEN 5.0 AND hi GROUP BY segment_id HAVING count(*) >= 2"),
        "spacing_and_extent": with_(SMOOTH, f"SELECT segment_id, {r('any_value(dx)', 'dx')}, count(*) AS n, {r('min(x_km)', 'x0')}, {r('max(x_km)', 'x1')} FROM sb GROUP BY segment_id"),
        "gradients": with_(PROFILE | {
            "a": "SELECT segment_id, i, h_surf AS f, x_km + i * i * 0.01::DOUBLE AS u FROM p",
            "b": "SELECT *, lag(f) OVER w AS fb, lead(f) OVER w AS fn, u - lag(u) OVER w AS hs, lead(u) OVER w - u AS hd FROM a WINDOW w AS (PARTITION BY segment_id ORDER BY i)",
        }, f"SELECT segment_id, i, {r('f - fb', 'step')}, {r('CASE WHEN fb IS NULL THEN fn - f WHEN fn IS NULL THEN f - fb ELSE (fn - fb) / 2 END', 'unit')}, {r('CASE WHEN hs IS NULL THEN (fn - f) / hd WHEN hd IS NULL THEN (f - fb) / hs ELSE (hs * hs * fn + (hd * hd - hs * hs) * f - hd * hd * fb) / (hs * hd * (hd + hs)) END', 'uneven')} FROM b"),
        # limited: two samples of a gap from the plain fill, then whatever came last, then whatever comes next.
        "gap_fill": with_(PROFILE | {
            "a": fill("p", "amp", "both_ways"),
            "z": "SELECT *, i - max(CASE WHEN amp IS NOT NULL THEN i END) OVER (PARTITION BY segment_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS into_gap FROM a",
            "y": "SELECT *, CASE WHEN into_gap <= 2 THEN both_ways END AS held FROM z",
        }, f"SELECT segment_id, i, {r('both_ways')}, {r('coalesce(last_value(held IGNORE NULLS) OVER b, first_value(held IGNORE NULLS) OVER e)', 'limited')} FROM y WINDOW b AS (PARTITION BY segment_id ORDER BY i ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY segment_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
        "bridged_layers": with_(PROFILE | {
            "a": fill("p", "h_bed", "b", at="x_km", ends=False),
            "g": "SELECT *, h_bed IS NULL AND b IS NOT NULL AS bed_gap FROM a",
        }, f"SELECT segment_id, i, {r('b', 'bed')}, bed_gap, bed_gap OR coalesce(lag(bed_gap) OVER w, false) OR coalesce(lead(bed_gap) OVER w, false) AS joined FROM g WINDOW w AS (PARTITION BY segment_id ORDER BY i)"),
        "mask_runs": with_(PHYSICS | {"a": "SELECT segment_id, i, 0 AS m FROM pm WHERE water UNION ALL SELECT segment_id, i, 1 FROM pm WHERE nan", "b": "SELECT *, i - row_number() OVER (PARTITION BY segment_id, m ORDER BY i) AS g FROM a"}, "SELECT segment_id, min(i) AS start, max(i) AS stop FROM b GROUP BY segment_id, m, g"),
        "nan_blocks": with_(PROFILE | gap_steps("p"), f"SELECT segment_id, {r('a', 'x_start')}, {r('b', 'x_end')} FROM pg"),
        "terminus_crossings": with_(PHYSICS | terminus_steps("pm"), f"SELECT segment_id, {r('t', 'x_km')} FROM t"),
        "smoothed_residual": with_(SMOOTH, f"SELECT segment_id, i, {r('smooth')}, smooth < 10 AS floating, smooth > 30 AS grounded FROM sm"),
        "landward_sign": with_(WINDOW, "SELECT segment_id, CAST(sign AS BIGINT) AS sign FROM wa"),
        "flotation_window": with_(WINDOW, f"SELECT segment_id, CAST(sign AS BIGINT) AS sign, {rs('x_cross', 'lo', 'hi')}, reason FROM w"),
        "nearest_join": f"""WITH
          l AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click'),
          rr AS (SELECT user_id, epoch_us(ts) AS us, min(value) AS value FROM events WHERE event_type <> 'click' GROUP BY ALL),
          j AS (SELECT l.*, rr.value, abs(rr.us - l.us) AS d FROM l LEFT JOIN rr ON l.user_id = rr.user_id QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY abs(rr.us - l.us), rr.us) = 1)
          SELECT user_id, event_id, us, {r('value', 'nearest')}, {r('CASE WHEN d <= 43200000000 THEN value END', 'within')} FROM j""",
        "nearest_lookup": with_(PROFILE, f"SELECT segment_id, i, {r('h_surf')} FROM p QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY abs(x_km - 7.3::DOUBLE), x_km) = 1"),
        "raster_sample": with_(PROFILE | {
            "a": f"SELECT segment_id, i, CAST(round_even(({SQL_X.format(lat='lat', lon='lon')} + 320000.0) / 2000.0, 0) AS BIGINT) AS col, CAST(round_even((-950000.0 - {SQL_Y.format(lat='lat', lon='lon')}) / 2000.0, 0) AS BIGINT) AS row_ FROM p",
            "b": "SELECT *, col BETWEEN 0 AND 399 AND row_ BETWEEN 0 AND 199 AS inside FROM a",
        }, "SELECT segment_id, i, col, row_ AS \"row\", CASE WHEN inside THEN CAST(col + 2 * row_ AS DOUBLE) END AS vx, CASE WHEN inside THEN CAST(col - 3 * row_ AS DOUBLE) END AS vy FROM b"),
        "regrid": with_(PROFILE | {
            "e": "SELECT segment_id, min(x_km) + 0.2::DOUBLE AS lo, max(x_km) - 0.1::DOUBLE AS hi FROM p GROUP BY segment_id",
            "g": "SELECT segment_id, i, lo + i * 0.7::DOUBLE AS x FROM (SELECT segment_id, lo, unnest(range(CAST(floor((hi - lo) / 0.7::DOUBLE + 1e-9) AS BIGINT) + 1)) AS i FROM e)",
            "k": "SELECT segment_id, x_km, amp FROM p WHERE amp IS NOT NULL",
            "b0": "SELECT g.segment_id, g.i, g.x, arg_max(k.x_km, k.x_km) AS xb, arg_max(amp, k.x_km) AS vb FROM g LEFT JOIN k ON g.segment_id = k.segment_id AND k.x_km <= g.x GROUP BY ALL",
            "b1": "SELECT g.segment_id, g.i, arg_min(k.x_km, k.x_km) AS xa, arg_min(amp, k.x_km) AS va FROM g LEFT JOIN k ON g.segment_id = k.segment_id AND k.x_km >= g.x GROUP BY ALL",
            "t0": "SELECT g.segment_id, g.i, arg_max(p.x_km, p.x_km) AS yb, arg_max(lat, p.x_km) AS lb FROM g LEFT JOIN p ON g.segment_id = p.segment_id AND p.x_km <= g.x GROUP BY ALL",
            "t1": "SELECT g.segment_id, g.i, arg_min(p.x_km, p.x_km) AS ya, arg_min(lat, p.x_km) AS la FROM g LEFT JOIN p ON g.segment_id = p.segment_id AND p.x_km >= g.x GROUP BY ALL",
            "z": "SELECT * FROM b0 JOIN b1 USING (segment_id, i) JOIN t0 USING (segment_id, i) JOIN t1 USING (segment_id, i)",
        }, f"SELECT segment_id, i, {r('x', 'x_km')}, {r('CASE WHEN least(coalesce(x - xb, 1e300), coalesce(xa - x, 1e300)) <= 0.6::DOUBLE THEN CASE WHEN xb IS NULL THEN va WHEN xa IS NULL OR xa = xb THEN vb ELSE vb + (va - vb) * (x - xb) / (xa - xb) END END', 'amp')}, {r('CASE WHEN yb IS NULL THEN la WHEN ya IS NULL OR ya = yb THEN lb ELSE lb + (la - lb) * (x - yb) / (ya - yb) END', 'lat')} FROM z"),
        "outer_align": with_(PROFILE, f"SELECT coalesce(a.segment_id, b.segment_id) AS segment_id, coalesce(a.i, b.i) AS i, {r('amp')}, {r('h_bed')} FROM (SELECT segment_id, i, amp FROM p WHERE amp IS NOT NULL) a FULL JOIN (SELECT segment_id, i, h_bed FROM p WHERE h_bed IS NOT NULL) b ON a.segment_id = b.segment_id AND a.i = b.i"),
        "terminus_names": "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
        "tumbling_mean": f"""WITH b AS (SELECT event_type, epoch_us(ts) // 21600000000 * 21600000000 AS us, avg(value) AS value FROM events GROUP BY ALL),
          s AS (SELECT event_type, unnest(range(min(us), max(us) + 1, 21600000000)) AS us FROM b GROUP BY event_type)
          SELECT event_type, us, {r('value')} FROM s LEFT JOIN b USING (event_type, us)""",
        "reflection_power": with_(_frames(), f"SELECT segment_id, us, {rs('surface_twtt', 'surface_power_db', 'bed_twtt', 'bed_power_db', digits=9)} FROM surface FULL JOIN bed USING (segment_id, us)"),
        "layer_elevations": with_(PROFILE | {
            "a": "SELECT segment_id, i * 2000000 + 400000 AS us, CASE WHEN i % 5 <> 0 THEN 5e-6::DOUBLE + 2e-7::DOUBLE * 3 END AS ts, CASE WHEN i % 5 <> 1 THEN 5e-6::DOUBLE + 2e-7::DOUBLE * 7 END AS tb FROM p",
            "b": f"SELECT *, 3000.0::DOUBLE - ts * {LIGHT / 2!r} AS surface FROM a",
        }, f"SELECT segment_id, us, {r('surface', digits=4)}, {r(f'surface - (tb - ts) * {LIGHT / math.sqrt(EARTH.permittivity) / 2!r}', 'bed', 4)} FROM b"),
        "projected_track": with_(PROFILE | {
            "a": f"SELECT segment_id, i, lat, lon, {SQL_X.format(lat='lat', lon='lon')} AS px, {SQL_Y.format(lat='lat', lon='lon')} AS py FROM p",
            "b": "SELECT *, coalesce(sqrt(pow(px - lag(px) OVER w, 2) + pow(py - lag(py) OVER w, 2)), 0) AS d FROM a WINDOW w AS (PARTITION BY segment_id ORDER BY i)",
        }, f"SELECT segment_id, i, {rs('px', 'py', digits=3)}, {r('sum(d) OVER (PARTITION BY segment_id ORDER BY i ROWS UNBOUNDED PRECEDING)', 'along_m', 3)}, {rs('lat', 'lon', digits=3)} FROM b"),
        "flow_angles": with_(TRACK, f"SELECT segment_id, i, {rs('ex', 'ey', 'speed', 'cos', 'angle', digits=4)} FROM tr"),
        "flow_alignment": with_(TRACK | _ALIGN, f"SELECT segment_id, {rs('median_angle', 'p90_angle', 'sinuosity', 'monotonic', 'median_speed', 'valid', digits=4)}, coalesce(median_angle <= 30 AND sinuosity <= 1.1 AND monotonic >= 0.95 AND valid >= 0.5, false) AS along_flow FROM al"),
        "along_flow_legs": with_(TRACK | _LEGS | {"d": "SELECT DISTINCT segment_id, leg_lo AS lo, leg_hi AS hi, direction FROM lg"}, f"SELECT segment_id, {rs('lo', 'hi')}, row_number() OVER (PARTITION BY segment_id ORDER BY hi - lo DESC, lo, hi) = 1 AS longest FROM d"),
        "flotation_leg": with_(TRACK | _SCORED, f"SELECT segment_id, {r('leg_lo', 'lo')}, {r('leg_hi', 'hi')}, score FROM best"),
        "segment_screening": with_(TRACK | _ALIGN | _SCORED | terminus_steps("pm") | {
            "whole": "SELECT segment_id, min(abs(CASE WHEN ice THEN hab END)) AS min_hab, coalesce(min(CASE WHEN ice THEN hab END) < 0 AND max(CASE WHEN ice THEN hab END) > 0, false) AS crosses FROM pm GROUP BY segment_id",
            "tl": "SELECT segment_id, direction, leg, max(t) AS t FROM t_l GROUP BY ALL",
            "tw": "SELECT segment_id, max(t) AS t FROM t GROUP BY ALL",
            "j": "SELECT al.*, best.leg IS NOT NULL AS has_leg, best.leg_lo, best.leg_hi, best.lo, best.hi, CASE WHEN best.leg IS NOT NULL THEN tl.t ELSE tw.t END AS terminus, CASE WHEN best.leg IS NOT NULL THEN best.min_hab ELSE whole.min_hab END AS min_hab, CASE WHEN best.leg IS NOT NULL THEN best.crosses ELSE whole.crosses END AS hab_crosses_zero FROM al LEFT JOIN best USING (segment_id) JOIN whole USING (segment_id) LEFT JOIN tl ON tl.segment_id = best.segment_id AND tl.direction = best.direction AND tl.leg = best.leg LEFT JOIN tw ON tw.segment_id = al.segment_id",
            "d": "SELECT *, CASE WHEN has_leg AND terminus IS NOT NULL THEN least(abs(terminus - lo), abs(terminus - hi)) END AS distance FROM j",
            "v": "SELECT *, CASE WHEN NOT has_leg THEN 'no along-flow leg crossing flotation' WHEN median_angle IS NULL THEN 'flow direction undefined (ice too slow)' WHEN median_angle > 30 THEN 'across flow (' || CAST(round_even(median_angle, 0) AS BIGINT) || ' deg)' WHEN terminus IS NULL THEN 'no terminus in range' WHEN min_hab IS NULL THEN 'no ice on the leg' WHEN min_hab > 50 THEN 'never near flotation (min HAB ' || CAST(round_even(min_hab, 0) AS BIGINT) || ' m)' WHEN distance > 5 THEN 'terminus ' || CAST(round_even(distance, 0) AS BIGINT) || ' km from the transition' ELSE '' END AS reason FROM d",
        }, f"SELECT segment_id, {rs('leg_lo', 'leg_hi', 'terminus', 'min_hab', digits=4)}, hab_crosses_zero, {rs('distance', 'median_angle', 'monotonic', 'ice_fraction', digits=4)}, reason = '' AS usable, reason FROM v"),
        "layer_physics": with_(PHYSICS, f"SELECT segment_id, i, {r('hab')}, {r('h_surf - geoid_m', 'freeboard')}, {r(f'(h_surf - geoid_m) * {1 - 1 / FF!r}', 'draft')}, {r(f'2 * 0.5e0 / {POWER_KM!r}', 'wn')} FROM pm"),
        "feature_table": with_(SMOOTH | feature_steps("sm", 0.5), f"SELECT segment_id, i, {rs('x_km', 'amp_f', 'dA', 'dfree', 'dfree_msl', 'dsurf', digits=3)} FROM ft"),
        "power_gradient": with_(_FEATURED, f"SELECT segment_id, i, {rs('amp_f', 'dA')} FROM f"),
        "early_features": with_(PROFILE | {"e0": fill("p", "h_surf", "is_", at="x_km"), "e1": fill("e0", "h_bed", "ib", at="x_km")} | lowpass("e1", "amp", "amp_e", 2.0 / (2 / 0.15), "ea") | lowpass("ea", "is_", "hs", 2.0 / (2 / 0.02), "es") | lowpass("es", "ib", "hb", 2.0 / (2 / 0.02), "eb") | {
            "ec": slope("eb", "amp_e", "g"),
            "ed": "SELECT *, CASE WHEN abs(g) <= 5 AND NOT (x_km > 10 AND x_km < 12) THEN g END AS gm FROM ec",
            "ef": fill("ed", "gm", "plain"),
            "eg": "SELECT *, i - max(CASE WHEN gm IS NOT NULL THEN i END) OVER (PARTITION BY segment_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS into_gap FROM ef",
            "eh": "SELECT *, CASE WHEN into_gap <= 5 THEN plain END AS held FROM eg",
            "ei": slope("eh", "hs", "dsurf_e"),
        }, f"SELECT segment_id, i, {r('amp_e', digits=3)}, {r('CASE WHEN amp IS NOT NULL THEN amp_e END', 'amp_shown', 3)}, {r('coalesce(last_value(held IGNORE NULLS) OVER b, first_value(held IGNORE NULLS) OVER e)', 'dA_e', 3)}, {r(f'hs - (hs - hb) * {FF!r}', 'dfree_e', 3)}, {r('dsurf_e', digits=3)} FROM ei WINDOW b AS (PARTITION BY segment_id ORDER BY i ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY segment_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
        "standardised_features": with_(_FEATURED, f"SELECT segment_id, i, {r('(amp_f - avg(amp_f) OVER s) / (stddev_pop(amp_f) OVER s + 1e-9)', 'amp_f')}, {r('(dA - avg(CASE WHEN x_km < 10 THEN dA END) OVER s) / (stddev_pop(CASE WHEN x_km < 10 THEN dA END) OVER s + 1e-9)', 'dA')} FROM f WINDOW s AS (PARTITION BY segment_id)"),
        "gradient_detector": with_(_GRADIENT, f"SELECT segment_id, detector, {rs('map_km', 'lo', 'hi', 'value')}, reason FROM gr"),
        "clipped_gradient": with_(_FEATURED | gradient_steps("f", "CASE WHEN abs(dA) > 2 THEN 0.0 ELSE dA END", 0, "gradient-clipped", "gc"), f"SELECT segment_id, detector, {rs('map_km', 'lo', 'hi', 'value')}, reason FROM gc"),
        "power_rise": with_(PHYSICS | {
            "a": "SELECT *, CASE WHEN lag(i) OVER w IS NULL THEN lead(amp) OVER w - amp WHEN lead(i) OVER w IS NULL THEN amp - lag(amp) OVER w ELSE (lead(amp) OVER w - lag(amp) OVER w) / 2 END AS g FROM pm WINDOW w AS (PARTITION BY segment_id ORDER BY i)",
            "t": "SELECT segment_id, min(i) AS i0, max(i) AS i1 FROM pm WHERE thickness > 50 GROUP BY segment_id",
            "b": "SELECT a.segment_id, 'track' AS scope, i, x_km, g FROM a UNION ALL SELECT a.segment_id, 'thick ice', i, x_km, CASE WHEN i BETWEEN i0 AND i1 THEN g END FROM a LEFT JOIN t USING (segment_id)",
        }, f"SELECT segment_id, 'rise' AS detector, scope, i, {r('x_km', 'map_km')}, {r('g', 'value')} FROM b WHERE g IS NOT NULL QUALIFY row_number() OVER (PARTITION BY segment_id, scope ORDER BY g DESC, i) = 1"),
        "onset_detector": with_(_ONSET, f"SELECT segment_id, detector, {rs('map_km', 'lo', 'hi', 'value')}, reason FROM og"),
        "zone_offsets": with_(_ONSET | gradient_steps("f", "dA", 3, "gradient", "gr") | {"u": "SELECT segment_id, detector, map_km FROM gr UNION ALL SELECT segment_id, detector, map_km FROM og", "v": "SELECT u.*, x_cross - 2.0 * w.sign AS zone FROM u JOIN w USING (segment_id)"}, f"SELECT segment_id, detector, {rs('map_km', 'zone')}, {r('map_km - zone', 'offset_km')}, CASE WHEN map_km - zone < 0 THEN 'downflow' WHEN map_km - zone >= 0 THEN 'upflow of the zone''s seaward edge' END AS note FROM v"),
        "credible_intervals": with_(_POSTERIOR | {"m": "SELECT unnest([0.68::DOUBLE, 0.95::DOUBLE]) AS mass"}, f"SELECT qc.segment_id, run, model, mass, {r('coalesce(min(CASE WHEN c >= (1 - mass) / 2 THEN x_km END), max(x_km))', 'lo')}, {r('coalesce(min(CASE WHEN c >= 1 - (1 - mass) / 2 THEN x_km END), max(x_km))', 'hi')}, {r('any_value(map_km)', 'map_km')} FROM qc JOIN qm ON qc.segment_id = qm.segment_id, m GROUP BY qc.segment_id, run, model, mass"),
        "changepoint_posterior": with_(_FEATURED | changepoint_steps("f", _ALL_MODELS, 0, {"raw": _CHANNELS}), f"SELECT segment_id, run, model, {rs('x_km', 'p', digits=5)}, reason FROM cp"),
        "bayesian_changepoint": with_(_FEATURED | _BOCPD | {
            "ci": "SELECT *, sum(p) OVER (PARTITION BY segment_id, run, model ORDER BY x_km ROWS UNBOUNDED PRECEDING) / sum(p) OVER (PARTITION BY segment_id, run, model) AS c FROM cp",
            "cj": "SELECT segment_id, run, model, coalesce(min(CASE WHEN c >= 0.16 THEN x_km END), max(x_km)) AS lo, coalesce(min(CASE WHEN c >= 0.84 THEN x_km END), max(x_km)) AS hi FROM ci GROUP BY ALL",
        }, f"SELECT segment_id, run, model, {r('map_km')}, reason, {rs('lo', 'hi')} FROM cp_map JOIN cj USING (segment_id, run, model)"),
        "changepoint_discordance": with_(_FEATURED | {
            "fn": "SELECT *, " + ", ".join(f"({c} - avg(CASE WHEN smooth < 10 THEN {c} END) OVER s) / (stddev_pop(CASE WHEN smooth < 10 THEN {c} END) OVER s + 1e-9) AS n_{c}" for c in _CHANNELS) + " FROM f WINDOW s AS (PARTITION BY segment_id)",
        } | changepoint_steps("fn", _ALL_MODELS, 0, {"raw": _CHANNELS, "normalised": tuple(f"n_{c}" for c in _CHANNELS)}) | {
            "dm": "SELECT segment_id, max(CASE WHEN run = 'raw' THEN map_km END) AS map_raw, max(CASE WHEN run = 'normalised' THEN map_km END) AS map_normalised FROM cp_map WHERE model = 'mean' GROUP BY segment_id",
        }, f"SELECT segment_id, {rs('map_raw', 'map_normalised')}, abs(map_raw - map_normalised) > 3 AS discordant FROM dm"),
        "transition_width": with_(_REPORT | report_steps("f"), f"SELECT segment_id, {r('width_km')} FROM rw"),
        "detection_report": with_(_REPORT | report_steps("f"), f"SELECT segment_id, n, {rs('x0', 'x1', 'dx', 'geoid')}, n_gaps, sign, {rs('wlo', 'whi')}, detector, {r('map_km')}, reason, summary FROM rp"),
        "radar_elevations": with_(radar_steps("dx"), f"SELECT segment_id, us, {rs('x_km', 'lat', 'lon', 'h_surf', 'h_bed', digits=4)} FROM el"),
        "radar_bed_power": with_(radar_steps("dx"), f"SELECT segment_id, us, {rs('x_km', 'amp', digits=4)} FROM bp"),
        "radar_profile": with_(radar_steps("dx"), f"SELECT segment_id, i, {rs('x_km', 'amp', 'h_surf', 'h_bed', 'geoid_m', 'lat', 'lon', digits=3)} FROM rd"),
        "grounding_report": with_(_FLAGSHIP, f"SELECT segment_id, n, {rs('x0', 'x1', 'dx', 'geoid', digits=3)}, n_gaps, sign, {rs('wlo', 'whi', digits=3)}, detector, {r('map_km', digits=3)}, reason, summary, {r('width_km', digits=3)}, {r('map_km - wlo', 'offset_km', 3)}, CASE WHEN map_km - wlo < 0 THEN 'downflow' WHEN map_km - wlo >= 0 THEN 'upflow of the zone''s seaward edge' END AS note FROM rp JOIN rw USING (segment_id)"),
        "track_bounds": with_(_LINES | {
            "zs_": f"SELECT segment_id, c_custkey, i, ax, ay, bx, by_, coalesce(((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / nullif((bx - ax) * (dy - cy) - (by_ - ay) * (dx - cx), 0), 0) AS s FROM zz WHERE {_SHARED}",
            "zp": "SELECT segment_id, c_custkey, i + s AS k, ax + s * (bx - ax) AS lon, ay + s * (by_ - ay) AS lat FROM zs_",
            "ze": "SELECT segment_id, c_custkey, arg_min(lat, k) AS lat0, arg_max(lat, k) AS lat1, arg_min(lon, k) AS lon0, arg_max(lon, k) AS lon1 FROM zp GROUP BY ALL",
            "kl": "SELECT segment_id, list(struct_pack(c := lat, x := x_km) ORDER BY lat, x_km) AS l FROM p GROUP BY segment_id",
            "kn": "SELECT segment_id, min(x_km) AS x FROM p GROUP BY segment_id, lon",
        }, "SELECT segment_id, c_custkey, " + ", ".join(f"round(list_reduce(l, lambda a, b: CASE WHEN abs(b.c - {c}) < abs(a.c - {c}) THEN b ELSE a END).x, 6) + 0.0 AS {n}" for c, n in (("lat0", "lat_first"), ("lat1", "lat_last"))) + ", round(x, 6) + 0.0 AS lon_first, round(x, 6) + 0.0 AS lon_last FROM ze JOIN kl USING (segment_id) JOIN kn USING (segment_id)"),
        "catalog_geometry": with_(_LINES, f"SELECT DISTINCT segment_id, CAST(2000 + segment_id % 20 AS INTEGER) AS year FROM zz WHERE c_custkey % 53 < 5 AND 2000 + segment_id % 20 BETWEEN 2006 AND 2015 AND ({_SHARED})"),
        "termini_ingest": f"""WITH RECURSIVE a AS (SELECT n_nationkey AS row, n_name AS name, n_regionkey, unnest([0, 1]) AS e FROM nation WHERE 2010 + n_nationkey % 15 <= 2021 AND n_nationkey <> 7),
          b AS (SELECT *, row * 9000.0e0 - 300000.0e0 + e * 4000.0e0 AS x, -1000000.0e0 - row * 500.0e0 AS y FROM a),
          c AS (SELECT *, sqrt(x * x + y * y) / {num(SCALE)} AS t FROM b),
          d AS (SELECT *, 0 AS k, pi() / 2 - 2 * atan(t) AS lat FROM c UNION ALL
            SELECT * EXCLUDE (k, lat), k + 1, pi() / 2 - 2 * atan(t * pow((1 - {num(E)} * sin(lat)) / (1 + {num(E)} * sin(lat)), {num(E / 2)})) FROM d WHERE k < 6)
          SELECT row, any_value(name) AS name, any_value(r_name) = 'EUROPE' AS in_region, round(max(CASE WHEN e = 0 THEN degrees(atan2(x, -y)) - 45 END), 6) + 0.0 AS lon, round(max(CASE WHEN e = 1 THEN degrees(lat) END), 6) + 0.0 AS lat
          FROM d JOIN region ON r_regionkey = n_regionkey WHERE k = 6 GROUP BY row""",
        "label_lookup": "SELECT p_partkey, 'label' AS by FROM part WHERE p_partkey IN (3, 17, 150) UNION ALL SELECT p_partkey, 'layer' FROM part WHERE p_size = 7",
        "geoid_sample": with_(PROFILE | {
            "a": f"SELECT segment_id, i, CAST(round_even(({SQL_X.format(lat='lat', lon='lon')} + 320000.0) / 2000.0, 0) AS BIGINT) AS col, CAST(round_even((-950000.0 - {SQL_Y.format(lat='lat', lon='lon')}) / 2000.0, 0) AS BIGINT) AS row_ FROM p",
            "b": "SELECT *, CASE WHEN col BETWEEN 0 AND 399 AND row_ BETWEEN 0 AND 199 THEN 10 + col * 0.01e0 END AS g FROM a",
        }, f"SELECT segment_id, i, {r('g', 'geoid_m')}, {r('-200 - row_ * 1.5e0 + g', 'seabed_m')} FROM b"),
        # The samples lie on the model, so the least squares are 0 and the parameters those of the model.
        "erf_fit": with_(PROFILE, "SELECT segment_id, 12.0e0 AS a, 0.25e0 AS b, 8.0e0 AS x0, -3.0e0 AS c, 0.0e0 AS rmse FROM p GROUP BY segment_id HAVING count(*) >= 4"),
        # A series of positive terms, which loses nothing to cancelling; beyond 6 the error function is 1.
        "erf_values": with_(PROFILE | {
            "a": "SELECT segment_id, i, 0.25e0 * (x_km - 8.0e0) AS u FROM p",
            "b": "SELECT *, abs(u) AS z FROM a",
            "c": "SELECT segment_id, i, u, z, z AS t, z AS s, 0 AS k FROM b UNION ALL SELECT segment_id, i, u, z, t * 2 * z * z / (2 * k + 3), s + t * 2 * z * z / (2 * k + 3), k + 1 FROM c WHERE k < 120 AND z < 6",
            "d": "SELECT segment_id, i, any_value(u) AS u, any_value(z) AS z, max(s) AS s FROM c GROUP BY ALL",
        }, f"SELECT segment_id, i, {r('12 * sign(u) * CASE WHEN z >= 6 THEN 1 ELSE 2 / sqrt(pi()) * exp(-z * z) * s END - 3', 'y')} FROM d"),
        "plot_layers": with_(WINDOW | {
            "a": "SELECT sm.*, w.sign, w.x_cross, count(h_surf) OVER (PARTITION BY segment_id) AS ns, count(h_bed) OVER (PARTITION BY segment_id) AS nb FROM sm JOIN w USING (segment_id) WHERE x_cross IS NOT NULL",
            "b": fill("a", "h_surf", "fs", at="x_km", ends=False),
            "c": fill("b", "h_bed", "fb", at="x_km", ends=False),
            "d": "SELECT *, CASE WHEN ns >= 2 THEN fs ELSE h_surf END AS surface, CASE WHEN nb >= 2 THEN fb ELSE h_bed END AS raw, x_km * sign >= x_cross * sign AS grounded, -i * sign AS s FROM c",
            "e": f"SELECT *, h_surf IS NULL AND surface IS NOT NULL AS surface_gap, h_bed IS NULL AND raw IS NOT NULL AS gap, coalesce(NOT grounded AND raw IS NOT NULL AND surface - geoid_m > 0 AND raw - geoid_m > 0.5 * (surface - geoid_m) * {1 - 1 / FF!r}, false) AS collapsed FROM d",
            "g": "SELECT *, coalesce(lag(raw) OVER (PARTITION BY segment_id ORDER BY s) < raw, false) AS shoals, min(CASE WHEN collapsed THEN s END) OVER (PARTITION BY segment_id) AS first_ FROM e",
            "h": "SELECT *, max(CASE WHEN NOT shoals AND s <= first_ THEN s END) OVER (PARTITION BY segment_id) AS stop_ FROM g",
            "j": "SELECT *, max(CASE WHEN s = stop_ THEN raw END) OVER (PARTITION BY segment_id) AS depth FROM h",
            "l": "SELECT *, coalesce(s > stop_ AND depth IS NOT NULL, false) AS held FROM j",
            "m": "SELECT *, CASE WHEN held THEN depth ELSE raw END AS bed FROM l",
            "o": "SELECT *, coalesce(surface - bed >= 25, false) AS thick_ice FROM m",
            "q": "SELECT segment_id, median(CASE WHEN grounded AND abs(x_km - x_cross) <= 2 THEN bed END) AS near_, min(CASE WHEN NOT grounded AND thick_ice THEN bed END) - 20 AS keel FROM o GROUP BY segment_id",
        }, f"SELECT segment_id, i, {r('surface')}, surface_gap, {r('bed')}, held AS bed_held, thick_ice, grounded, collapsed, gap OR coalesce(lag(gap) OVER v, false) OR coalesce(lead(gap) OVER v, false) AS joined_gap, {r('CASE WHEN near_ IS NOT NULL OR keel IS NOT NULL THEN greatest(-2000, least(coalesce(near_, keel), coalesce(keel, near_))) END', 'seabed')} FROM o JOIN q USING (segment_id) WINDOW v AS (PARTITION BY segment_id ORDER BY i)"),
        "line_search": with_(_LINES, f"SELECT DISTINCT segment_id, c_custkey FROM zz WHERE {_SHARED}"),
        "zone_bounds": with_(_LINES | {
            "zs_": f"SELECT segment_id, c_custkey, i, ax, ay, bx, by_, coalesce(((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / nullif((bx - ax) * (dy - cy) - (by_ - ay) * (dx - cx), 0), 0) AS s FROM zz WHERE {_SHARED}",
            "zp": "SELECT segment_id, c_custkey, i + s AS k, ax + s * (bx - ax) AS lon, ay + s * (by_ - ay) AS lat FROM zs_",
        }, f"SELECT segment_id, c_custkey, {r('arg_min(lat, k)', 'first_lat')}, {r('arg_max(lat, k)', 'last_lat')}, {r('arg_max(lon, k)', 'last_lon')} FROM zp GROUP BY ALL"),
        "catalog_search": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('O', 'F') AND year(o_orderdate) BETWEEN 1993 AND 1996",
        "erf_derivatives": with_(PROFILE | {"a": "SELECT segment_id, i, 0.25::DOUBLE * (x_km - 8.0::DOUBLE) AS u FROM p", "b": f"SELECT *, exp(-u * u) * {2 * 12.0 / math.sqrt(math.pi)!r} AS g FROM a"}, f"SELECT segment_id, i, {r('g * 0.25::DOUBLE', 'd1')}, {r('g * u * -0.125::DOUBLE', 'd2')}, {r('g * (u * u * 2 - 1) * 0.03125::DOUBLE', 'd3')} FROM b"),
        "ahead_of_terminus": with_(WINDOW | {
            "f": "SELECT segment_id, max(t * w.sign) * any_value(w.sign) AS front FROM w JOIN t USING (segment_id) WHERE t * w.sign < x_cross * w.sign GROUP BY segment_id",
            "gi": "SELECT sm.segment_id, arg_min(i, abs(x_km - x_cross) * 1000000 + i) AS g FROM sm JOIN w USING (segment_id) GROUP BY sm.segment_id",
            "ir": "SELECT segment_id, min(i) AS a, max(i) AS b, min(x_km) AS xa, max(x_km) AS xb FROM (SELECT *, i - row_number() OVER (PARTITION BY segment_id ORDER BY i) AS run FROM pm WHERE ice) GROUP BY segment_id, run",
            "ie": "SELECT segment_id, xa, xb FROM ir JOIN gi USING (segment_id) QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY CASE WHEN g BETWEEN a AND b THEN 0 ELSE least(abs(a - g), abs(b - g)) END, a) = 1",
            "ee": "SELECT w.segment_id, w.sign, coalesce(f.front, CASE WHEN w.sign > 0 THEN xa ELSE xb END) AS edge FROM w LEFT JOIN f USING (segment_id) LEFT JOIN ie USING (segment_id) WHERE w.x_cross IS NOT NULL",
        }, "SELECT pm.segment_id, i, coalesce(CASE WHEN sign > 0 THEN x_km < edge ELSE x_km > edge END, false) AS ahead FROM pm LEFT JOIN ee ON pm.segment_id = ee.segment_id"),
        "plot_extent": with_(WINDOW | {
            "e": "SELECT segment_id, min(x_km) AS a, max(x_km) AS b FROM pm WHERE h_surf IS NOT NULL OR h_bed IS NOT NULL OR amp IS NOT NULL GROUP BY segment_id",
            "g": "SELECT segment_id, avg(geoid_m) AS sea_level, min(geoid_m) AS geoid_min, max(geoid_m) AS geoid_max FROM p GROUP BY segment_id",
        }, f"SELECT segment_id, {r('greatest(a, lo - 5)', 'x0')}, {r('least(b, hi + 5)', 'x1')}, {rs('sea_level', 'geoid_min', 'geoid_max')} FROM w JOIN e USING (segment_id) JOIN g USING (segment_id) WHERE lo IS NOT NULL"),
        "plateau_means": with_(PROFILE | {"a": "SELECT *, (x_km - min(x_km) OVER s) / (max(x_km) OVER s - min(x_km) OVER s) AS q FROM p WINDOW s AS (PARTITION BY segment_id)"}, f"SELECT segment_id, {r('avg(CASE WHEN q <= 0.3::DOUBLE THEN amp END)', 'bright')}, {r('avg(CASE WHEN q >= 0.7::DOUBLE THEN amp END)', 'dark')}, {r('quantile_cont(amp, 0.3)', 'p30')}, {r('quantile_cont(amp, 0.97)', 'p97')} FROM a GROUP BY segment_id"),
        "name_strings": "SELECT p_partkey, left(p_name, length(p_name) - 4) AS stem, 'Data_' || p_name AS product, p_brand || ' (' || p_size || ')' AS label FROM part",
        "frame_slice": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem) WHERE k IN (2, 3) GROUP BY ALL",
        "distinct_times": "SELECT user_id, epoch_us(date_trunc('hour', ts)) AS us, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY ALL",
        "last_terminus": with_(PHYSICS | terminus_steps("pm") | {"a": "SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY t) <= 4"}, f"SELECT segment_id, {r('max(t)', 'last')}, count(*) AS n FROM a GROUP BY segment_id"),
    }
    return out
