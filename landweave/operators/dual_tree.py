"""Points near points and points in regions, by a dual-tree join.

Both point sets are put into trees of three levels of square cells; a node knows the tight box around its points. A
pair of nodes is discarded if its boxes are certainly further apart than the radius, accepted wholesale if they are
certainly within it, and refined to the children's pairs otherwise; uncertain leaves are refined to points. The upper
nodes are matched by an equi-join on cells, one row per node whatever its number of points, and a node carries its at
most 16 x 16 descendants with it, so the recursion is a chain of explodes and filters. Points join only at the end, on
the leaf. A leaf that holds a large share of all points is one row until then, and the final join's hot partitions are
split by adaptive execution.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
FAN = 4


def usable(lat: Column, lon: Column) -> Column:
    """Both given, latitude 24 to 50, longitude -125 to -66."""
    return F.coalesce(lat.between(24.0, 50.0) & lon.between(-125.0, -66.0), F.lit(False))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance, in the unit of ``radius``."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * 2 * radius


def _gap(a: Column, b: Column, axis: str) -> tuple[Column, Column]:
    """Least and greatest difference of two boxes along an axis."""
    lo, hi = f"{axis}0", f"{axis}1"
    return F.greatest(a[lo] - b[hi], b[lo] - a[hi], F.lit(0.0)), F.greatest(a[hi] - b[lo], b[hi] - a[lo])


def box_bounds_m(a: Column, b: Column) -> tuple[Column, Column]:
    """Bounds of the great-circle distance of any point in one box to any in the other, a millimetre to the safe side."""
    dlat, dlon = _gap(a, b, "lat"), _gap(a, b, "lon")
    far_lat = F.greatest(F.abs(a["lat0"]), F.abs(a["lat1"]), F.abs(b["lat0"]), F.abs(b["lat1"]))
    near_lat = F.when((F.least(a["lat0"], b["lat0"]) <= 0) & (F.greatest(a["lat1"], b["lat1"]) >= 0), 0.0).otherwise(F.least(F.abs(a["lat0"]), F.abs(a["lat1"]), F.abs(b["lat0"]), F.abs(b["lat1"])))

    def dist(y: Column, x: Column, lat: Column) -> Column:
        h = F.pow(F.sin(F.radians(y) / 2), 2) + F.pow(F.cos(F.radians(lat)) * F.sin(F.radians(x) / 2), 2)
        return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * 2 * EARTH_M

    return dist(dlat[0], dlon[0], far_lat) - 0.001, dist(dlat[1], dlon[1], near_lat) + 0.001


def cell_degrees(radius_m: float, max_abs_lat: float) -> float:
    """Side of a top cell: the radius reaches no further than the adjacent cell."""
    return 2.0 * radius_m / (EARTH_M * math.pi / 180 * math.cos(math.radians(max_abs_lat)))


def with_leaf(points: DataFrame, side: float) -> DataFrame:
    """Adds lx, ly: the leaf's integer cell."""
    leaf = side / FAN**2
    return points.withColumns({"lx": F.floor(F.col("lon") / leaf), "ly": F.floor(F.col("lat") / leaf)})


def _box(prefix: str = "") -> list[Column]:
    return [F.min(f"{prefix}lat0").alias("lat0"), F.max(f"{prefix}lat1").alias("lat1"), F.min(f"{prefix}lon0").alias("lon0"), F.max(f"{prefix}lon1").alias("lon1")]


def tree(points: DataFrame) -> DataFrame:
    """Top nodes (x, y, lat0, lat1, lon0, lon1, children) of points with lx, ly; at most 16 children of 16 leaves."""
    leaves = points.groupBy("lx", "ly").agg(F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1"))
    box = ("lat0", "lat1", "lon0", "lon1")
    top = leaves.repartition(F.floor(F.col("lx") / FAN**2).alias("x"), F.floor(F.col("ly") / FAN**2).alias("y"))
    middle = (
        top.withColumns({"x": F.floor(F.col("lx") / FAN**2), "y": F.floor(F.col("ly") / FAN**2)})
        .groupBy("x", "y", F.floor(F.col("lx") / FAN).alias("mx"), F.floor(F.col("ly") / FAN).alias("my"))
        .agg(*_box(), F.collect_list(F.struct("lx", "ly", *box)).alias("leaves"))
    )
    return middle.groupBy("x", "y").agg(*_box(), F.collect_list(F.struct(*box, "leaves")).alias("children"))


def near_leaves(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of leaves (alx, aly, blx, bly, sure) of two trees that may hold, or if sure do hold, only near pairs."""
    around = F.explode(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = left.select(around.alias("c"), F.struct("lat0", "lat1", "lon0", "lon1", "children").alias("a")).select("c.x", "c.y", "a")
    b = right.select("x", "y", F.struct("lat0", "lat1", "lon0", "lon1", "children").alias("b"))

    def refine(df: DataFrame) -> DataFrame:
        low, high = box_bounds_m(F.col("a"), F.col("b"))
        return df.where(F.col("sure") | (low <= radius_m)).withColumn("sure", F.col("sure") | (high <= radius_m))

    pairs = refine(a.join(b, ["x", "y"]).withColumn("sure", F.lit(False)))
    # The nearer tree's children are filtered against the other's whole box before both are paired.
    half = refine(pairs.select("sure", F.explode("a.children").alias("a"), "b"))
    middle = refine(half.select("sure", "a", F.explode("b.children").alias("b")))
    half = refine(middle.select("sure", F.explode("a.leaves").alias("a"), "b"))
    leaf = refine(half.select("sure", "a", F.explode("b.leaves").alias("b")))
    return leaf.select(F.col("a.lx").alias("alx"), F.col("a.ly").alias("aly"), F.col("b.lx").alias("blx"), F.col("b.ly").alias("bly"), "sure")


def near_join(left: DataFrame, right: DataFrame, radius_m: float, max_abs_lat: float = 50.0) -> DataFrame:
    """Pairs (a, b) of points (id, lat, lon) of two sets at most ``radius_m`` apart.

    Points outside the latitudes +-max_abs_lat, with a null or NaN coordinate or a null id must be left out before.
    Points of equal coordinates are all paired; an empty side gives no pairs."""
    side = cell_degrees(radius_m, max_abs_lat)
    pa, pb = with_leaf(left.select(F.col("id").alias("a"), "lat", "lon"), side), with_leaf(right.select(F.col("id").alias("b"), "lat", "lon"), side)
    pairs = near_leaves(tree(pa), tree(pb), radius_m)
    b = pb.select("b", F.col("lat").alias("blat"), F.col("lon").alias("blon"), F.col("lx").alias("blx"), F.col("ly").alias("bly"))
    a = pa.select("a", F.col("lat").alias("alat"), F.col("lon").alias("alon"), F.col("lx").alias("alx"), F.col("ly").alias("aly"))
    met = pairs.join(b, ["blx", "bly"]).select("alx", "aly", "b", "blat", "blon", "sure").join(a, ["alx", "aly"])
    return met.where(F.col("sure") | (haversine_m(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")) <= radius_m)).select("a", "b")


def polygon_edges(ring: Column) -> Column:
    """Edges (x1, y1, x2, y2) of a ring of (lon, lat), closed or not, in either direction."""
    ok = F.filter(ring, lambda v: v["lon"].isNotNull() & v["lat"].isNotNull() & ~F.isnan(v["lon"]) & ~F.isnan(v["lat"]))
    turned = F.concat(F.slice(ok, 2, F.greatest(F.size(ok) - 1, F.lit(0))), F.slice(ok, 1, 1))
    return F.when(F.size(ok) >= 3, F.zip_with(ok, turned, lambda p, q: F.struct(p["lon"].alias("x1"), p["lat"].alias("y1"), q["lon"].alias("x2"), q["lat"].alias("y2"))))


def in_polygon(edges: Column, lat: Column, lon: Column) -> Column:
    """Whether an upward or downward edge is crossed an odd number of times to the east of the point."""
    crossed = F.filter(edges, lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    return F.size(crossed) % 2 == 1


def region_join(points: DataFrame, regions: DataFrame, side: float = 0.004) -> DataFrame:
    """Pairs (a, region) of points (id, lat, lon) and the regions (region, ring) that contain them.

    Nodes of the points' tree that no edge of the region touches are accepted or discarded wholesale by their centre;
    uncertain nodes are refined to leaves and uncertain leaves to points. Rings of fewer than three points contain
    nothing; a null region id or ring gives no pairs."""
    pts = with_leaf(points.select(F.col("id").alias("a"), "lat", "lon"), side)
    coarse = 8
    nodes = tree(pts).withColumns({"cx": F.floor(F.col("x") / coarse), "cy": F.floor(F.col("y") / coarse)})
    step = side * coarse
    shapes = (
        regions.where("region is not null and ring is not null")
        .select("region", polygon_edges(F.col("ring")).alias("edges"))
        .where("edges is not null")
        .select("region", "edges", F.array_min("edges.y1").alias("lat0"), F.array_max("edges.y1").alias("lat1"), F.array_min("edges.x1").alias("lon0"), F.array_max("edges.x1").alias("lon1"))
    )
    spread = shapes.withColumn("cx", F.explode(F.sequence(F.floor(F.col("lon0") / step), F.floor(F.col("lon1") / step)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("lat0") / step), F.floor(F.col("lat1") / step))))
    spread = spread.select("cx", "cy", "region", "edges", F.struct("lat0", "lat1", "lon0", "lon1").alias("r"))

    def apart(n: Column, r: Column) -> Column:
        return (n["lat0"] > r["lat1"]) | (n["lat1"] < r["lat0"]) | (n["lon0"] > r["lon1"]) | (n["lon1"] < r["lon0"])

    def refine(df: DataFrame) -> DataFrame:
        n = F.col("n")
        df = df.where(F.col("sure") | ~apart(n, F.col("r")))
        touched = F.exists("edges", lambda e: (F.least(e["x1"], e["x2"]) <= n["lon1"]) & (F.greatest(e["x1"], e["x2"]) >= n["lon0"]) & (F.least(e["y1"], e["y2"]) <= n["lat1"]) & (F.greatest(e["y1"], e["y2"]) >= n["lat0"]))
        inside = in_polygon(F.col("edges"), (n["lat0"] + n["lat1"]) / 2, (n["lon0"] + n["lon1"]) / 2)
        state = df.withColumn("_s", F.when(F.col("sure"), 1).when(touched, 0).when(inside, 1).otherwise(-1))
        return state.where("_s >= 0").withColumn("sure", F.col("_s") == 1).drop("_s")

    met = nodes.select("cx", "cy", F.struct("lat0", "lat1", "lon0", "lon1", "children").alias("n")).join(spread, ["cx", "cy"]).withColumn("sure", F.lit(False))
    top = refine(met).select("region", "edges", "r", "sure", F.explode("n.children").alias("m"))
    leaf = refine(top.select("region", "edges", "r", "sure", F.explode("m.leaves").alias("n")))
    leaf = leaf.select("region", F.when(~F.col("sure"), F.col("edges")).alias("edges"), F.col("n.lx").alias("lx"), F.col("n.ly").alias("ly"))
    hit = leaf.join(pts, ["lx", "ly"])
    return hit.where(F.col("edges").isNull() | in_polygon(F.col("edges"), F.col("lat"), F.col("lon"))).select("a", "region")
