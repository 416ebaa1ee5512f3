"""Zones from polygons, tiles of an incomplete set, clamped ranges."""

from __future__ import annotations

import random

import pytest

from stratus.operators import tiles as TL
from stratus.operators.filters import clamp_ranges
from stratus.sources.airports import with_timezone
from stratus.sources.zones import RING_COLUMNS, with_polygon_zone, zone_by_polygon
from tests.helpers import airports_frame, obs_frame

RING = "zone string, part int, ring int, seq int, lon double, lat double"


def rings(spark, *lines):
    """(zone, part, ring, [(lon, lat), ...])."""
    return spark.createDataFrame([(z, p, r, i, float(x), float(y)) for z, p, r, v in lines for i, (x, y) in enumerate(v)], RING)


def box(w, s, e, n):
    return [(w, s), (e, s), (e, n), (w, n)]


def zones(spark, points, ring_table, **options):
    air = airports_frame(spark, [(k, float(y), float(x), None) for k, (x, y) in points.items()])
    return {r.ICAO: r.zone for r in zone_by_polygon(air, ring_table, **options).collect()}


def inside(x, y, lines):
    """Even-odd rule over all rings, edge by edge."""
    odd = False
    for v in lines:
        for (ax, ay), (bx, by) in zip(v, v[1:] + v[:1]):
            if ay > by:
                (ax, ay), (bx, by) = (bx, by), (ax, ay)
            if ay <= y < by and ax + (y - ay) * (bx - ax) / (by - ay) > x:
                odd = not odd
    return odd


def test_holes_and_parts(spark):
    table = rings(spark, ("A", 0, 0, box(0, 0, 10, 10)), ("A", 0, 1, box(4, 4, 6, 6)), ("A", 1, 0, box(20, 0, 21, 1)), ("B", 0, 0, box(4.5, 4.5, 5.5, 5.5)))
    assert RING_COLUMNS == table.columns
    points = {"in": (1, 1), "hole": (4.2, 5), "island": (5, 5), "second": (20.5, .5), "out": (15, 5), "far": (-170, 80)}
    assert zones(spark, points, table) == {"in": "A", "island": "B", "second": "A"}


def test_shared_borders_belong_to_one_zone(spark):
    """Four quadrants, one given the other way round: every border point has exactly one zone."""
    table = rings(spark, ("NE", 0, 0, box(0, 0, 5, 5)), ("NW", 0, 0, box(-5, 0, 0, 5)[::-1]), ("SE", 0, 0, box(0, -5, 5, 0)), ("SW", 0, 0, box(-5, -5, 0, 0)))
    points = {"centre": (0, 0), "north": (0, 2), "south": (0, -2), "east": (2, 0), "west": (-2, 0)}
    assert zones(spark, points, table) == {"centre": "NE", "north": "NE", "south": "SE", "east": "NE", "west": "NW"}
    slanted = rings(spark, ("L", 0, 0, [(0, 0), (3, 7), (0, 7)]), ("R", 0, 0, [(3, 7), (0, 0), (3, 0)]))
    on_line = {f"p{k}": (3 * k / 7, k) for k in range(1, 7)}
    assert set(zones(spark, on_line, slanted)) == set(on_line)


@pytest.mark.parametrize("cell", [0.5, 1.0, 7.0])
def test_against_every_edge(spark, cell):
    rng = random.Random(5)
    lines = []
    for z in range(6):
        cx, cy = rng.uniform(-20, 20), rng.uniform(-20, 20)
        lines.append((f"Z{z}", 0, 0, [(cx + rng.uniform(-9, 9), cy + rng.uniform(-9, 9)) for _ in range(rng.randint(3, 9))]))
    points = {f"p{i}": (rng.uniform(-30, 30), rng.uniform(-30, 30)) for i in range(300)}
    want = {k: min(z for z, _, _, v in lines if inside(x, y, [v])) for k, (x, y) in points.items() if any(inside(x, y, [v]) for *_, v in lines)}
    assert len(want) > 20 and zones(spark, points, rings(spark, *lines), cell=cell) == want


def test_the_zone_column_stays_the_default(spark):
    air = airports_frame(spark, [("A", 1.0, 1.0, "Australia/Perth"), ("B", 1.0, 1.0, None), ("C", 50.0, 50.0, None), ("D", None, 1.0, None)])
    table = rings(spark, ("Asia/Kolkata", 0, 0, box(0, 0, 2, 2)))
    filled = with_polygon_zone(air, table)
    assert {r.ICAO: r.tz for r in filled.collect()} == {"A": "Australia/Perth", "B": "Asia/Kolkata", "C": None, "D": None}
    obs = obs_frame(spark, [{"TARGET_ICAO": s} for s in "ABCDE"])
    assert {r.TARGET_ICAO: r.tz for r in with_timezone(obs, filled).collect()} == {
        "A": "Australia/Perth", "B": "Asia/Kolkata", "C": "UTC", "D": "UTC", "E": "UTC"}


def test_no_rings(spark):
    assert zones(spark, {"a": (1, 1)}, rings(spark, ("A", 0, 0, [(1, 1), (2, 1)]))) == {}


def test_nearest_tile(spark):
    rng = random.Random(6)
    air = airports_frame(spark, [(f"S{i}", rng.uniform(-60, 60), rng.uniform(-180, 179), None) for i in range(80)])
    tiles = {(rng.randrange(0, 512, 7), rng.randrange(512)) for _ in range(150)}
    got = {r.ICAO: r for r in TL.nearest_tile(air, spark.createDataFrame(list(tiles) * 2, "x int, y int")).collect()}
    assert len(got) == 80
    for r in got.values():
        x = min({t[0] for t in tiles}, key=lambda t: (abs(t - r.x_tile), t))
        y = min({t[1] for t in tiles if t[0] == x}, key=lambda t: (abs(t - r.y_tile), t))
        assert (r.tile_x, r.tile_y) == (x, y)


def test_ties_and_an_empty_tile_set(spark):
    rows = spark.createDataFrame([(5,), (6,), (100,)], "k int")
    have = spark.createDataFrame([(4,), (6,), (8,)], "k int")
    assert {r.k: r.nearest for r in TL.nearest_key(rows, have, "k").collect()} == {5: 4, 6: 6, 100: 8}
    air = airports_frame(spark, [("A", 1.0, 1.0, None)])
    none = spark.createDataFrame([], "x int, y int")
    assert [(r.tile_x, r.tile_y) for r in TL.nearest_tile(air, none).collect()] == [(None, None)]
    assert TL.tile_neighbourhood(air, tiles=none).count() == 0


def test_neighbourhood_of_available_tiles(spark):
    air = airports_frame(spark, [("A", 0.0, 0.0, None)])
    out = TL.tile_neighbourhood(air, tiles=spark.createDataFrame([(250, 250), (251, 250), (249, 249)], "x int, y int")).collect()
    assert len(out) == 9 and {(r.tile_x, r.tile_y) for r in out if r.available} == {(251, 250), (250, 250)}


@pytest.mark.parametrize("changed, want", [
    ("year-start", {"years": (2010, 2010), "months": (2, 2), "hours": (5, 9)}), ("year-end", {"years": (2005, 2005), "months": (2, 2), "hours": (5, 9)}),
    ("month-start", {"years": (2005, 2005), "months": (11, 11), "hours": (5, 9)}), ("hour-end", {"years": (2005, 2005), "months": (2, 2), "hours": (5, 9)})])
def test_clamped_ranges(changed, want):
    assert clamp_ranges(changed, (2010, 2005), ("Nov", "Feb"), (5, 9)) == want
