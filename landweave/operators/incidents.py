"""Where incidents happened, and what lies around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.operators.dual_tree import near_join, region_join, usable
from landweave.operators.rolls import same_text, valid_rows


def latest_parcels(records: DataFrame, snapshots: DataFrame, **values: str) -> DataFrame:
    """Valid rows of each market's last delivery: market, parcel_key and the columns named as name=column."""
    return valid_rows(records, snapshots, {n: F.col(c) for n, c in values.items()}, latest=True).select("market", "parcel_key", *values)


def located_incidents(reports: DataFrame, parcels: DataFrame) -> DataFrame:
    """id, lat, lon of each incident that lies somewhere.

    At its own coordinates if usable, else at those, if usable, of the parcel (market, parcel_key, address, lat, lon) of
    its market with the same address text, if there is exactly one. A repeated incident id is located row by row."""
    rows = reports.where("id is not null").select("id", F.col("market_id").alias("market"), same_text(F.col("incident_address")).alias("address"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    own = usable(F.col("lat"), F.col("lon"))
    by_address = parcels.select("market", same_text(F.col("address")).alias("address"), "lat", "lon").groupBy("market", "address").agg(F.count(F.lit(1)).alias("n"), F.first("lat").alias("lat"), F.first("lon").alias("lon")).where((F.col("n") == 1) & usable(F.col("lat"), F.col("lon"))).drop("n")
    looked_up = rows.where(~own).drop("lat", "lon").join(by_address, ["market", "address"])
    return rows.where(own).select("id", "lat", "lon").unionByName(looked_up.select("id", "lat", "lon"))


def around_incidents(reports: DataFrame, records: DataFrame, snapshots: DataFrame, zones: DataFrame, radius_m: float = 100.0) -> DataFrame:
    """incident_id, match_key: ``p:<parcel key>`` of the latest parcels near it, ``z:<zone_id>`` of its zone."""
    parcels = latest_parcels(records, snapshots, address="property_address", lat="latitude", lon="longitude")
    at = located_incidents(reports, parcels)
    spots = parcels.where(usable(F.col("lat"), F.col("lon"))).select(F.col("parcel_key").alias("id"), "lat", "lon")
    near = near_join(at, spots, radius_m).select(F.col("a").alias("incident_id"), F.concat(F.lit("p:"), F.col("b")).alias("match_key"))
    within = region_join(at, zones.select(F.col("zone_id").alias("region"), "ring")).select(F.col("a").alias("incident_id"), F.concat(F.lit("z:"), F.col("region").cast("string")).alias("match_key"))
    return near.unionByName(within).distinct()
