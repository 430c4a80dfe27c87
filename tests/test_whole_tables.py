"""Queries on small tables against brute force, where the SQL reads only a part of a table."""

import datetime
import math

import pytest

from firnspark.constants import EARTH, LIGHT
from firnspark.functions.physics import pick_margin
from firnspark.queries import QUERIES


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Tables with segments on both sides of id 40."""
    to, start = str(tmp_path_factory.mktemp("tables")), datetime.datetime(2024, 1, 1)
    sizes = {3: 45, 39: 46, 40: 47, 1234: 53}
    users = [u for u, n in sizes.items() for _ in range(n)]
    rows = [(k, u, "click", start + datetime.timedelta(minutes=k), float(k)) for k, u in enumerate(users)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, value double").write.parquet(f"{to}/events.parquet")
    spark.range(1, 601).withColumnRenamed("id", "c_custkey").write.parquet(f"{to}/customer.parquet")
    return to, sizes


def test_reflection_power_of_all_segments(spark, events):
    to, sizes = events
    want = {}
    for segment, n in sizes.items():
        for at in range(0, n, 2):
            found = []
            for j in (0, 1):
                own = [k for k in range(12) if abs(k - 3 - 4 * j) * 2e-7 <= pick_margin()] if at % 5 != j else []
                mean = {k: sum(1 + (i * 7 + k * 5) % 13 for i in range(at, min(at + 2, n))) / min(2, n - at) for k in own}
                best = max(own, key=lambda k: (mean[k], -k), default=None)
                found += [None, None] if best is None else [5e-6 + 2e-7 * best, 10 * math.log10(mean[best])]
            if any(v is not None for v in found):
                want[segment, at * 2_000_000] = found
    got = {(r.segment_id, r.us): list(r)[2:] for r in QUERIES["reflection_power"](spark, to).collect()}
    assert set(got) == set(want) and {s for s, _ in got} == set(sizes)
    assert all(v == pytest.approx(want[k], abs=1e-8) if None not in v else [x is None for x in v] == [x is None for x in want[k]] for k, v in got.items())


def test_layer_elevations_of_all_segments(spark, events):
    to, sizes = events
    got = {(r.segment_id, r.us): (r.surface, r.bed) for r in QUERIES["layer_elevations"](spark, to).collect()}
    assert set(got) == {(s, i * 2_000_000 + 400_000) for s, n in sizes.items() for i in range(n)}
    surface = 3000 - 5.6e-6 * LIGHT / 2
    for (_, us), (top, bed) in got.items():
        i = us // 2_000_000
        assert top is None if i % 5 == 0 else top == pytest.approx(surface, abs=1e-3)
        assert bed is None if i % 5 < 2 else bed == pytest.approx(surface - 8e-7 * LIGHT / math.sqrt(EARTH.permittivity) / 2, abs=1e-3)


def test_lines_of_all_samples_and_customers(spark, events):
    """A track runs along a meridian and a zone from west to east, so they share one point at most."""
    to, sizes = events
    clear, edge = {}, set()
    for segment, n in sizes.items():
        x, top = -60.0 + 0.5 * (segment % 10), 80.0 + 0.00448 * (n - 1)
        for c in range(1, 601):
            lon, lat = -61.0 + c % 53 * 0.1, 80.0 + c % 31 * 0.01
            points = [(lon, lat), (lon + 0.33, lat + 0.031), (lon + 0.71, lat - 0.013)]
            if min(abs(x - points[0][0]), abs(x - points[2][0])) < 1e-9:
                edge.add((segment, c))
            for (ax, ay), (bx, by) in zip(points, points[1:]):
                if ax <= x <= bx:
                    y = ay + (by - ay) * (x - ax) / (bx - ax)
                    if min(abs(y - 80.0), abs(y - top)) < 1e-9:
                        edge.add((segment, c))
                    elif 80.0 < y < top:
                        clear[segment, c] = y
    clear = {k: y for k, y in clear.items() if k not in edge}
    tail = {(s, c) for (s, c), y in clear.items() if y > 80.0 + 0.00448 * ((sizes[s] - 1) // 10 * 10) and s % 2 == 0}
    assert tail and any(c > 400 for _, c in clear)
    found = [(r.segment_id, r.c_custkey) for r in QUERIES["line_search"](spark, to).collect()]
    assert len(found) == len(set(found)) and set(found) - edge == set(clear)
    bounds = {(r.segment_id, r.c_custkey): r for r in QUERIES["zone_bounds"](spark, to).collect()}
    assert set(bounds) == set(found)
    for k, y in clear.items():
        r = bounds[k]
        assert (r.first_lat, r.last_lat, r.last_lon) == pytest.approx((y, y, -60.0 + 0.5 * (k[0] % 10)), abs=2e-6)
