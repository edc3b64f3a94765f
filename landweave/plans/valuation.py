"""Comparable properties, value estimates, risk and opportunity scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from pyspark.sql import functions as F

from landweave.functions.geo import haversine_miles
from landweave.operators.rollups import n


def comparables(parcels: DataFrame, target: float, as_of: Column, bedrooms: int | None = None, pool: bool | None = None, zoning: str | None = None, least: int = 3, limit: int = 10) -> DataFrame:
    """Sales scored by price, features and time in the first tier that has enough: twelve months, twenty-four months,
    else by market value. Price within 30 %, qualified or unknown sales; 5 points less per bedroom of difference.

    All tiers are computed in one pass over the rows of the widest; which one counts is one aggregated row."""
    price = F.lit(float(target))
    sold = F.col("last_sale_price").between(target * 0.7, target * 1.3) & (F.col("sale_qualified").isNull() | (F.col("sale_qualified") == "Q"))
    months12, months24 = F.col("last_sale_date") >= F.add_months(as_of, -12), F.col("last_sale_date") >= F.add_months(as_of, -24)
    worth = F.col("market_value").between(target * 0.7, target * 1.3)
    rows = parcels.where((sold & months24) | worth)
    features = F.lit(0.0)
    if pool is not None:
        features = features + F.when(F.col("has_pool") == pool, 10.0).otherwise(0.0)
    if zoning is not None:
        features = features + F.when(F.col("land_zoning_code") == zoning, 20.0).otherwise(0.0)
    beds = F.coalesce(F.abs(F.col("bedrooms") - bedrooms), F.lit(0)) if bedrooms is not None else F.lit(0)
    time = F.when(F.col("last_sale_date") >= F.add_months(as_of, -6), 100.0).otherwise(90.0)
    by_sale = (F.lit(100.0) - F.abs(F.col("last_sale_price") - price) / price * 50) * 0.4 + features * 0.4 + time * 0.2 - beds * 5
    by_value = (F.lit(100.0) - F.abs(F.col("market_value") - price) / price * 50) * 0.6 + features * 0.4 - beds * 5
    tier = F.when(sold & months12, 1).when(sold & months24, 2).otherwise(3)
    known = rows.withColumn("tier", tier)
    # a row of a narrower tier also belongs to the wider ones
    counts = known.agg(F.count_if(F.col("tier") == 1).alias("_n1"), F.count_if(F.col("tier") <= 2).alias("_n2"))
    use = counts.select(F.when(F.col("_n1") >= least, 1).when(F.col("_n2") >= least, 2).otherwise(3).alias("_use"))
    met = known.crossJoin(F.broadcast(use)).where(F.when(F.col("_use") == 3, worth).otherwise(F.col("tier") <= F.col("_use")))
    score = F.when(F.col("_use") == 3, by_value).otherwise(by_sale)
    return met.select("parcel_key", F.col("_use").alias("tier"), F.round(score, 6).alias("score")).orderBy(F.desc_nulls_last("score"), "parcel_key").limit(limit)


def value_estimate(comps: DataFrame) -> DataFrame:
    """One row from comps (price, acres, days, miles) and the subject's acres (subject_acres): mean price, estimate,
    confidence = min(n/10, .4) + .3 (1 - cv) + .15 (1 - days/365) + .15 (1 - miles/5), each at least 0; .15 for one."""
    per_acre = F.avg(F.col("price") / F.nullif(F.col("acres"), F.lit(0.0)))
    cv = F.coalesce(F.stddev_samp("price") / F.avg("price"), F.lit(0.0))
    zero = F.lit(0.0)
    confidence = (
        F.least(F.count(F.lit(1)) / 10.0, F.lit(0.4))
        + F.when(F.count(F.lit(1)) == 1, 0.15).otherwise(F.greatest(zero, (F.lit(1.0) - cv) * 0.3))
        + F.greatest(zero, (F.lit(1.0) - F.avg("days") / 365.0) * 0.15)
        + F.greatest(zero, (F.lit(1.0) - F.avg("miles") / 5.0) * 0.15)
    )
    return comps.agg(n("comps"), F.round(F.avg("price"), 4).alias("mean_price"), F.round(F.coalesce(per_acre * F.max("subject_acres"), F.avg("price")), 4).alias("estimate"), F.round(confidence, 6).alias("confidence"))


def fair_price(asking: Column, estimate: Column, tolerance: float = 0.05) -> Column:
    ratio = asking / F.nullif(estimate, F.lit(0.0))
    return F.when(ratio.isNull(), "unknown").when(ratio < 1 - tolerance, "below").when(ratio > 1 + tolerance, "above").otherwise("fair")


def crime_risk(recent: Column, prior: Column) -> tuple[Column, Column]:
    """Level by number (0, below 5, below 15, below 30) and trend at 10 percent."""
    level = F.when(recent == 0, "none").when(recent < 5, "low").when(recent < 15, "moderate").when(recent < 30, "high").otherwise("severe")
    trend = F.when(prior == 0, F.when(recent > 0, "rising").otherwise("stable")).when(recent > prior * 1.1, "rising").when(recent < prior * 0.9, "falling").otherwise("stable")
    return level, trend


def opportunity(value: Column, asked: Column, holdings: Column, momentum: Column, red_flags: Column) -> Column:
    """0 to 100: valuation by ratio (.85, .95, 1.05, 1.15: 30, 20, 15, 10, 0), owner by holdings (20, 10, 5, 3: 20, 15,
    10, 7), momentum up to 30, 5 less per red flag down to -20."""
    ratio = asked / F.nullif(value, F.lit(0.0))
    worth = F.when(ratio <= 0.85, 30).when(ratio <= 0.95, 20).when(ratio <= 1.05, 15).when(ratio <= 1.15, 10).otherwise(0)
    owner = F.when(holdings >= 20, 20).when(holdings >= 10, 15).when(holdings >= 5, 10).when(holdings >= 3, 7).otherwise(0)
    raw = worth + owner + F.least(F.greatest(momentum, F.lit(0)), F.lit(30)) + F.greatest(red_flags * -5, F.lit(-20))
    return F.greatest(F.least(raw, F.lit(100)), F.lit(0))


def recommendation(score: Column, red_flags: Column) -> Column:
    return F.when((score >= 60) & (red_flags == 0), "BUY").when(score >= 30, "INVESTIGATE").otherwise("PASS")


def comps_near(parcels: DataFrame, subject_key: str, as_of: Column, miles: float = 1.0, days: int = 720, most: int = 10) -> DataFrame:
    """Comparable sales of a subject: same type, near and recent, nearest and newest first (0.6 miles, 0.4 years)."""
    s = parcels.where(F.col("parcel_key") == subject_key).select(F.col("latitude").alias("slat"), F.col("longitude").alias("slon"), F.col("property_type").alias("stype"), F.col("lot_size_acres").alias("subject_acres")).limit(1)
    met = parcels.where((F.col("parcel_key") != subject_key) & (F.col("last_sale_price") > 0) & (F.col("last_sale_date") >= F.date_sub(as_of, days))).join(F.broadcast(s), F.col("property_type") == F.col("stype"))  # one row
    d = met.withColumn("miles", haversine_miles(F.col("slat"), F.col("slon"), F.col("latitude"), F.col("longitude"))).where(F.col("miles") <= miles)
    d = d.withColumn("days", F.datediff(as_of, "last_sale_date"))
    return d.select("parcel_key", F.col("last_sale_price").alias("price"), F.col("lot_size_acres").alias("acres"), "days", "miles", "subject_acres", F.round(F.col("miles") * 0.6 + F.col("days") / 365.0 * 0.4, 6).alias("rank_score")).orderBy("rank_score", "parcel_key").limit(most)


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Standard deviation of a sample over its mean, in percent."""
    return df.groupBy(*keys).agg(F.round(F.stddev_samp(value) / F.avg(value) * 100, 4).alias("fsd"))


def ladder(c: Column, steps: list[tuple[float, str, int]], otherwise: tuple[str, int]) -> tuple[Column, Column]:
    """Label and points of the first step a value reaches."""
    label, points = None, None
    for least, name, score in steps:
        hit = c >= least
        label = F.when(hit, name) if label is None else label.when(hit, name)
        points = F.when(hit, score) if points is None else points.when(hit, score)
    return label.otherwise(otherwise[0]), points.otherwise(otherwise[1])


__all__ = ["comparables", "comps_near", "crime_risk", "fair_price", "ladder", "opportunity", "recommendation", "spread", "value_estimate"]
