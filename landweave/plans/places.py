"""Plans over coordinates: clusters, assemblages, neighbourhoods, hot spots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from pyspark.sql import functions as F

from landweave.functions.geo import adaptive_cell, grid_cell, haversine_m, haversine_miles, in_box
from landweave.operators.dual_tree import near_join, usable
from landweave.operators.rollups import mean, n, top_per_group, total


def _ok(parcels: DataFrame) -> DataFrame:
    return parcels.where(usable(F.col("latitude"), F.col("longitude")))


def clusters(parcels: DataFrame, metres: float = 500, least: int = 3, top: int = 20) -> DataFrame:
    """Grid cells with at least ``least`` parcels: dominant type and its share, value, class; the fullest cells first."""
    cells = _ok(parcels).withColumns({"cx": grid_cell(F.col("longitude"), metres), "cy": grid_cell(F.col("latitude"), metres)})
    by_type = cells.groupBy("cx", "cy", "property_type").agg(n("_k"), F.sum(F.col("market_value").cast("decimal(18,2)")).alias("_v"))
    cell = by_type.groupBy("cx", "cy").agg(
        F.sum("_k").alias("parcels"), F.sum("_v").alias("value"),
        F.min_by(F.struct("property_type", "_k"), F.struct((-F.when(F.col("property_type").isNotNull(), F.col("_k")).otherwise(0)).alias("k"), F.coalesce("property_type", F.lit("~")).alias("t"))).alias("_d"),
    ).where(F.col("parcels") >= least)
    share = F.col("_d._k") / F.col("parcels")
    kind = F.col("_d.property_type")
    label = F.when(kind.contains("FAMILY") & (share > 0.7), "residential").when((kind == "COMMERCIAL") & (share > 0.6), "commercial").when((kind == "VACANT") & (share > 0.5), "vacant").when(share < 0.4, "mixed").otherwise("other")
    return cell.select("cx", "cy", "parcels", "value", kind.alias("dominant"), F.round(share, 6).alias("purity"), label.alias("label")).orderBy(F.desc("parcels"), "cx", "cy").limit(top)


def diameters(parcels: DataFrame, owner: str, key: str, most_degrees: float) -> DataFrame:
    """(owner, parcels, diameter_m) of owners whose parcels lie in a box of at most ``most_degrees``.

    The box is tested first, so pairs are made only within small clusters. The longest line is chosen in degrees and
    measured on the sphere. Only points on the box's tight cell are needed more than once, equal points count once."""
    p = _ok(parcels).where(F.col(owner).isNotNull()).select(F.col(owner).alias("owner"), F.col(key).alias("k"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    box = p.groupBy("owner").agg(n("parcels"), (F.max("lat") - F.min("lat")).alias("dy"), (F.max("lon") - F.min("lon")).alias("dx")).where((F.col("parcels") >= 2) & (F.greatest("dx", "dy") <= most_degrees))
    pts = p.join(box.select("owner"), "owner", "left_semi").select("owner", "lat", "lon").distinct()
    # of each row of points with one latitude only the westernmost and easternmost can end the longest line
    ends = pts.groupBy("owner", "lat").agg(F.min("lon").alias("w"), F.max("lon").alias("e")).select("owner", "lat", F.explode(F.array_distinct(F.array("w", "e"))).alias("lon"))
    a, b = ends.toDF("owner", "alat", "alon"), ends.toDF("owner", "blat", "blon")
    d2 = F.pow(F.col("alat") - F.col("blat"), 2) + F.pow(F.col("alon") - F.col("blon"), 2)
    best = a.join(b, "owner").where("alat < blat or (alat = blat and alon <= blon)").withColumn("_d", d2)
    longest = best.groupBy("owner").agg(F.max_by(F.struct("alat", "alon", "blat", "blon"), F.struct("_d", "alat", "alon", "blat", "blon")).alias("x"))
    metres = haversine_m(F.col("x.alat"), F.col("x.alon"), F.col("x.blat"), F.col("x.blon"))
    return longest.select("owner", metres.alias("diameter_m")).join(box.select("owner", "parcels"), "owner")


def assemblages(parcels: DataFrame, owner: str = "owner_name", key: str = "parcel_key", most_m: float = 500, least: int = 2, top: int = 20) -> DataFrame:
    """Owners whose parcels lie close together, scored by number and diameter (95, 80, 65, 50, 30)."""
    d = diameters(parcels, owner, key, most_m / 111000.0 * 1.3).where((F.col("parcels") >= least) & (F.col("diameter_m") <= most_m))

    def at(count: int, metres: float) -> Column:
        return (F.col("parcels") >= count) & (F.col("diameter_m") < metres)

    score = F.when(at(5, 100), 95).when(at(4, 200), 80).when(at(3, 300), 65).when(at(2, 500), 50).otherwise(30)
    return d.select("owner", "parcels", F.round("diameter_m", 3).alias("diameter_m"), score.alias("score")).orderBy(F.desc("score"), F.desc("parcels"), "owner").limit(top)


def around(parcels: DataFrame, lat: float, lon: float, miles: float, limit: int | None = 100) -> DataFrame:
    """Parcels within so many miles of a place, nearest first. The box lets a scan skip; the limit comes last."""
    p = parcels.where(in_box(F.col("latitude"), F.col("longitude"), lat, lon, miles)).withColumn("miles", haversine_miles(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude")))
    near = p.where(F.col("miles") <= miles).withColumn("miles", F.round("miles", 6))
    return near.orderBy("miles", "parcel_key").limit(limit) if limit else near


def hotspots(parcels: DataFrame, activity: DataFrame, as_of: Column, days: int = 180, miles: float = 0.5, least: int = 3) -> DataFrame:
    """Cells with at least ``least`` parcels: recent activity and sales per parcel, weighted 0.6 and 0.4."""
    lat, lon = adaptive_cell(F.col("latitude"), F.col("longitude"), miles)
    seen = activity.where("latitude between 24 and 50 and longitude between -125 and -66").groupBy(*[c.alias(k) for c, k in zip((lat, lon), ("clat", "clon"), strict=True)]).agg(F.count_if(F.to_date("incident_date") >= F.date_sub(as_of, days)).alias("recent"))
    cells = _ok(parcels).groupBy(lat.alias("clat"), lon.alias("clon")).agg(n("parcels"), F.count_if(F.col("last_sale_date") >= F.date_sub(as_of, days * 4)).alias("sales")).where(F.col("parcels") >= least)
    score = F.least(F.coalesce("recent", F.lit(0)) / F.col("parcels"), F.lit(1.0)) * 0.6 + F.least(F.col("sales") / F.greatest(F.col("parcels") * 0.5, F.lit(1.0)), F.lit(1.0)) * 0.4
    return cells.join(seen, ["clat", "clon"], "left").select("clat", "clon", "parcels", F.coalesce("recent", F.lit(0)).alias("recent"), "sales", F.round(score, 6).alias("score"))


def neighbourhood(parcels: DataFrame, lat: float, lon: float, miles: float) -> DataFrame:
    """Types within a radius: number, mean value, share built after 2000."""
    near = around(parcels, lat, lon, miles, None)
    return near.groupBy("property_type").agg(n(), mean("market_value", "mean_value"), F.count_if(F.col("year_built") >= 2000).alias("recent"), total("market_value", "value"))


def gap_parcels(parcels: DataFrame, owners: DataFrame, metres: float, per_owner: int = 5) -> DataFrame:
    """Parcels of others near the middle of each owner's parcels (owner), nearest first, some per owner."""
    ok = _ok(parcels)
    mine = ok.join(owners.select(F.col("owner").alias("owner_name")), "owner_name", "left_semi")
    centre = mine.groupBy(F.col("owner_name").alias("id")).agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))
    p = ok.select(F.col("parcel_key").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    met = near_join(centre, p, metres).toDF("owner", "parcel_key")
    other = met.join(ok.select("parcel_key", "owner_name", "latitude", "longitude"), "parcel_key").where(F.col("owner_name").isNull() | (F.col("owner_name") != F.col("owner")))
    d = other.join(centre.toDF("owner", "clat", "clon"), "owner").withColumn("metres", F.round(haversine_m(F.col("clat"), F.col("clon"), F.col("latitude"), F.col("longitude")), 3))
    return top_per_group(d.select("owner", "parcel_key", "metres"), ["owner"], [F.asc("metres"), F.asc("parcel_key")], per_owner)


__all__ = ["around", "assemblages", "clusters", "diameters", "gap_parcels", "hotspots", "neighbourhood"]
