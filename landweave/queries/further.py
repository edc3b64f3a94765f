"""Variants of operators that have a line of their own in the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from landweave.functions import text as X
from landweave.operators import rollups as R
from landweave.operators import upsert as K
from landweave.operators.chunking import boundaries, sentences
from landweave.operators.dual_tree import usable
from landweave.operators.fuzzy import best_similar
from landweave.operators.search import Criteria, search
from landweave.queries.base import Registry
from landweave.queries.scalars import OK

reg = Registry()
query = reg.query
D = F.col


@query("a41_neighbourhood_stats", f"SELECT land_zoning_code, count(*) AS n, CAST(sum(CAST(market_value AS DECIMAL(18,2))) AS DOUBLE) / nullif(count(market_value), 0) AS mean_value, round(median(market_value), 4) AS median, count(CASE WHEN last_sale_date >= DATE '2022-12-01' THEN 1 END) AS recent FROM parcels WHERE {OK} AND latitude BETWEEN 25.27 AND 25.31 AND longitude BETWEEN -76.22 AND -76.18 GROUP BY 1")
def a41(t):
    box = t.parcels.where(usable(D("latitude"), D("longitude")) & D("latitude").between(25.27, 25.31) & D("longitude").between(-76.22, -76.18))
    return box.groupBy("land_zoning_code").agg(R.n(), R.mean("market_value", "mean_value"), F.round(F.percentile("market_value", F.lit(0.5)), 4).alias("median"), F.count_if(D("last_sale_date") >= F.lit("2022-12-01").cast("date")).alias("recent"))


@query("t02_over_fetch", "SELECT parcel_key FROM parcels WHERE property_type = 'CONDO' ORDER BY market_value DESC NULLS LAST, last_sale_date DESC NULLS LAST, parcel_key LIMIT 30")
def t02(t):
    return search(t.parcels, Criteria(equal_ci={"property_type": "condo"}), limit=10).select("parcel_key")


#: The order that suits a type; others are ordered by value, then recency.
ORDER_BY_TYPE = {"VACANT": "lot_size", "COMMERCIAL": "square_feet"}


@query("t04_order_by_type", "(SELECT 'VACANT' AS kind, parcel_key FROM parcels WHERE upper(property_type) = 'VACANT' ORDER BY lot_size_acres DESC NULLS LAST, parcel_key LIMIT 15) UNION ALL (SELECT 'COMMERCIAL', parcel_key FROM parcels WHERE upper(property_type) = 'COMMERCIAL' ORDER BY square_feet DESC NULLS LAST, parcel_key LIMIT 15)")
def t04(t):
    a, b = (search(t.parcels, Criteria(equal_ci={"property_type": k}), order=o, limit=5).select(F.lit(k).alias("kind"), "parcel_key") for k, o in ORDER_BY_TYPE.items())
    return a.unionByName(b)


@query("t06_nulls_first", "SELECT parcel_key, last_sale_price FROM parcels ORDER BY last_sale_price DESC NULLS FIRST, parcel_key LIMIT 40")
def t06(t):
    return t.parcels.orderBy(F.desc_nulls_first("last_sale_price"), "parcel_key").limit(40).select("parcel_key", "last_sale_price")


@query("t07_limit_with_key", "SELECT id FROM entities WHERE phone IS NOT NULL ORDER BY id LIMIT 25")
def t07(t):
    return t("entities").where("phone is not null").orderBy("id").limit(25).select("id")


TYPES = [("STREET", "ST"), ("AVENUE", "AVE"), ("BOULEVARD", "BLVD"), ("DRIVE", "DR"), ("ROAD", "RD"), ("LANE", "LN"), ("NORTH", "N"), ("SOUTH", "S"), ("EAST", "E"), ("WEST", "W")]


def _replaced(c: str) -> str:
    for a, b in TYPES:
        c = f"regexp_replace({c}, '\\b{a}\\b', '{b}', 'g')"
    return c


@query("x07_short_address", r"SELECT id, trim(regexp_replace(" + _replaced("regexp_replace(upper(primary_address), '[^A-Z0-9# ]', ' ', 'g')") + r", '\s+', ' ', 'g')) AS v FROM entities")
def x07(t):
    return t("entities").select("id", X.short_address(D("primary_address"), TYPES).alias("v"))


@query("k04_rebuild", "SELECT owner_name, market_id, count(*) AS properties, sum(CAST(market_value AS DECIMAL(18,2))) AS value FROM parcels WHERE owner_name IS NOT NULL GROUP BY 1, 2")
def k04(t):
    return t.parcels.where("owner_name is not null").groupBy("owner_name", "market_id").agg(R.n("properties"), R.total("market_value", "value"))


@query("k06_update_from_join", "SELECT c.id, coalesce(c.latitude, p.latitude) AS latitude FROM crime_reports c LEFT JOIN (SELECT upper(trim(property_address)) AS a, market_id, max(latitude) AS latitude FROM parcels GROUP BY 1, 2) p ON p.a = upper(trim(c.incident_address)) AND p.market_id = c.market_id")
def k06(t):
    c = t("crime_reports").select("id", "market_id", F.upper(F.trim("incident_address")).alias("a"), "latitude")
    p = t.parcels.select("market_id", F.upper(F.trim("property_address")).alias("a"), "latitude")
    return K.fill(c, p, ["market_id", "a"], ["latitude"], overwrite=False).select("id", "latitude")


@query("q02_find_entities", "SELECT owner_name, city, count(*) AS n, sum(CAST(market_value AS DECIMAL(18,2))) AS value FROM parcels WHERE upper(property_type) = 'VACANT' AND owner_name IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, value DESC NULLS LAST, owner_name, city LIMIT 20")
def q02(t):
    p = t.parcels.where((F.upper("property_type") == "VACANT") & D("owner_name").isNotNull())
    return p.groupBy("owner_name", "city").agg(R.n(), R.total("market_value", "value")).where("n >= 2").orderBy(F.desc("n"), F.desc_nulls_last("value"), "owner_name", "city").limit(20)


@query("q21_owner_street_gaps")
def q21(t):
    mine = t.parcels.where("owner_name is not null").groupBy("owner_name").agg(R.n("_n")).where("_n >= 4").select("owner_name")
    held = t.parcels.join(mine, "owner_name", "left_semi")
    return R.street_gaps(held, "owner_name", "property_address")


@query("q34_place_of_reports")
def q34(t):
    def side(df, key: str, address: str):
        return df.select(D(key).cast("string").alias("k"), D(address).alias("a"), "market_id")

    best = best_similar(side(t("crime_reports"), "id", "incident_address"), side(t.parcels, "parcel_key", "property_address"), "k", "a", 0.75, same="market_id")
    return best.select(D("l").cast("long").alias("id"), D("r").alias("parcel_key"), F.round("similarity", 6).alias("similarity"))


@query("w10_running_words")
def w10(t):
    d = t("documents").where("text is not null")
    return d.select("doc_id", F.size(boundaries(sentences(D("text")), 120, 160)).alias("chunks"))
