"""Spatial joins against brute force."""

import math
import random

import pytest

from landweave.operators.dual_tree import EARTH_M, near_join, region_join
from landweave.operators.incidents import around_incidents, located_incidents
from tests.test_rolls import S3, tables


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize(("seed", "lat", "radius"), [(1, 25.0, 100.0), (2, 49.9, 100.0), (3, 40.0, 1500.0), (4, -0.001, 100.0)])
def test_near_join(spark, seed, lat, radius):
    rng = random.Random(seed)
    side = radius / 111000 * 4
    a = [(i, lat + rng.uniform(-side, side), -76 + rng.uniform(-side, side)) for i in range(150)] + [(900 + i, lat, -76.0) for i in range(30)]
    b = [(i, lat + rng.uniform(-side, side), -76 + rng.uniform(-side, side)) for i in range(150)] + [(900 + i, lat, -76.0) for i in range(5)]
    want = sorted((i, j) for i, y, x in a for j, v, u in b if metres(y, x, v, u) <= radius)
    got = near_join(spark.createDataFrame(a, "id bigint, lat double, lon double"), spark.createDataFrame(b, "id bigint, lat double, lon double"), radius)
    assert sorted((r.a, r.b) for r in got.collect()) == want


def inside(ring, y, x):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def test_region_join(spark):
    rng = random.Random(5)
    rings = []
    for k in range(6):
        cx, cy = -76 + rng.uniform(-0.05, 0.05), 25 + rng.uniform(-0.05, 0.05)
        ring = [(cx + math.cos(t / 7 * 6.283) * rng.uniform(0.004, 0.03), cy + math.sin(t / 7 * 6.283) * rng.uniform(0.004, 0.03)) for t in range(7)]
        rings.append(ring[::-1] if k % 2 else ring)
    zones = [(k, [{"lon": x, "lat": y} for x, y in (r + r[:1] if k < 3 else r)]) for k, r in enumerate(rings)] + [(97, None), (98, []), (99, [{"lon": -76.0, "lat": 25.0}, {"lon": None, "lat": 25.0}, {"lon": -75.0, "lat": 25.0}]), (None, [{"lon": -76.0, "lat": 25.0}])]
    pts = [(i, 25 + rng.uniform(-0.08, 0.08), -76 + rng.uniform(-0.08, 0.08)) for i in range(600)]
    got = region_join(spark.createDataFrame(pts, "id bigint, lat double, lon double"), spark.createDataFrame(zones, "region bigint, ring array<struct<lon: double, lat: double>>"))
    assert sorted((r.a, r.region) for r in got.collect()) == sorted((i, k) for i, y, x in pts for k, r in enumerate(rings) if inside(r, y, x))


def test_empty_sides(spark):
    none = spark.createDataFrame([], "id bigint, lat double, lon double")
    one = spark.createDataFrame([(1, 25.0, -76.0)], "id bigint, lat double, lon double")
    assert near_join(none, one, 100.0).count() == near_join(one, none, 100.0).count() == 0
    assert region_join(one, spark.createDataFrame([], "region bigint, ring array<struct<lon: double, lat: double>>")).count() == 0


def test_incident_places(spark):
    parcels = spark.createDataFrame([("m", "P1", "1 Main St", 25.0, -76.0), ("m", "P2", "2 Main St", None, None), ("m", "P3", "3 MAIN ST", 25.1, -76.1), ("m", "P4", "3  main st", None, None), ("n", "P5", "1 Main St", 26.0, -76.0)], "market string, parcel_key string, address string, lat double, lon double")
    rows = [(1, "m", "x", 25.5, -76.5), (2, "m", " 1 MAIN  ST", None, None), (3, "m", "2 Main St", None, -76.0), (4, "m", "3 Main St", 76.0, 25.0), (5, "m", None, None, None), (6, "n", "1 main st", float("nan"), 0.0), (None, "m", "1 Main St", None, None)]
    got = located_incidents(spark.createDataFrame(rows, "id bigint, market_id string, incident_address string, latitude double, longitude double"), parcels)
    assert sorted((r.id, r.lat, r.lon) for r in got.collect()) == [(1, 25.5, -76.5), (2, 25.0, -76.0), (6, 26.0, -76.0)]


def test_around_incidents_with_empty_tables(spark):
    records, snapshots = tables(spark, [], S3)
    reports = spark.createDataFrame([], "id bigint, market_id string, incident_address string, latitude double, longitude double")
    zones = spark.createDataFrame([], "zone_id bigint, ring array<struct<lon: double, lat: double>>")
    assert around_incidents(reports, records, snapshots, zones).count() == 0
