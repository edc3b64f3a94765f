"""Projections, filters and predicates (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from landweave.functions import text as X
from landweave.operators import rollups as R
from landweave.operators.search import Criteria, conjunction, contains_ci, diversity_cap, find_text, null_or, owner_cap, owner_class, populated, search
from landweave.queries.base import Registry

reg = Registry()
query = reg.query
D = F.col


def day(s: str):
    return F.lit(s).cast("date")


WIDE = Criteria(equal_ci={"property_type": "single family"}, least={"market_value": 100000, "year_built": 1950}, most={"market_value": 400000, "lot_size_acres": 2.0}, flags={"has_pool": True}, known=("owner_name",))


@query("fp01_dynamic_filter", """SELECT parcel_key, market_value FROM parcels WHERE upper(property_type) = upper('single family') AND market_value >= 100000 AND year_built >= 1950 AND market_value <= 400000 AND lot_size_acres <= 2.0 AND has_pool = TRUE AND owner_name IS NOT NULL AND trim(owner_name) <> ''""")
def p01(t):
    return t.parcels.where(conjunction(WIDE.conditions())).select("parcel_key", "market_value")


@query("fp02_equal_ignoring_case", "SELECT parcel_key FROM parcels WHERE upper(city) LIKE 'LAKE%' AND upper(property_type) = 'CONDO'")
def p02(t):
    return t.parcels.where(F.upper("city").like("LAKE%") & (F.upper("property_type") == F.upper(F.lit("condo")))).select("parcel_key")


@query("fp03_contains_ignoring_case", "SELECT parcel_key, owner_name FROM parcels WHERE owner_name ILIKE '%hold%ings%'")
def p03(t):
    return t.parcels.where(contains_ci(D("owner_name"), "hold%ings")).select("parcel_key", "owner_name")


@query("fp04_owner_class", """SELECT CASE WHEN contains(upper(owner_name), 'LLC') THEN 'llc' WHEN contains(upper(owner_name), 'INC') OR contains(upper(owner_name), 'CORP') OR contains(upper(owner_name), 'TRUST') THEN 'company' ELSE 'individual' END AS kind, count(*) AS n
FROM parcels WHERE NOT (owner_name ILIKE '%state%' OR owner_name ILIKE '%county%') GROUP BY 1""")
def p04(t):
    keep = conjunction(Criteria(lacks={"owner_name": ["state", "county"]}).conditions())
    return t.parcels.where(keep).groupBy(owner_class(D("owner_name"), ["INC", "CORP", "TRUST"]).alias("kind")).agg(R.n())


@query("fp05_ranges", "SELECT parcel_key FROM parcels WHERE market_value BETWEEN 150000 AND 250000 AND year_built BETWEEN 1970 AND 1999")
def p05(t):
    return t.parcels.where(D("market_value").between(150000, 250000) & D("year_built").between(1970, 1999)).select("parcel_key")


@query("fp06_null_safe_membership", "SELECT parcel_key, land_zoning_code FROM parcels WHERE land_zoning_code NOT LIKE 'R%' OR land_zoning_code IS NULL")
def p06(t):
    return t.parcels.where(null_or(D("land_zoning_code"), ~D("land_zoning_code").like("R%"))).select("parcel_key", "land_zoning_code")


@query("fp07_negated_drops_nulls", "SELECT parcel_key, sale_qualified FROM parcels WHERE sale_qualified <> 'Q'")
def p07(t):
    return t.parcels.where(D("sale_qualified") != "Q").select("parcel_key", "sale_qualified")


@query("fp08_not_empty", "SELECT id, registered_agent FROM entities WHERE registered_agent IS NOT NULL AND trim(registered_agent) <> ''")
def p08(t):
    return t("entities").where(conjunction(Criteria(known=("registered_agent",)).conditions())).select("id", "registered_agent")


@query("fp09_any_of_patterns", "SELECT parcel_key FROM parcels WHERE land_zoning_code ILIKE '%RSF%' OR land_zoning_code ILIKE '%MU%'")
def p09(t):
    return t.parcels.where(conjunction(Criteria(one_of={"land_zoning_code": ["RSF", "MU"]}).conditions())).select("parcel_key")


@query("fp10_not_in_list", "SELECT parcel_key, property_type FROM parcels WHERE property_type NOT IN ('SINGLE FAMILY', 'CONDO')")
def p10(t):
    return t.parcels.where(conjunction(Criteria(none_of={"property_type": ["SINGLE FAMILY", "CONDO"]}).conditions())).select("parcel_key", "property_type")


@query("fp11_relative_window", "SELECT id FROM crime_reports WHERE incident_date >= TIMESTAMP '2024-10-03'")
def p11(t):
    return t("crime_reports").where(D("incident_date") >= F.date_sub(day("2025-01-01"), 90)).select("id")


@query("fp12_array_membership", "SELECT id FROM entities WHERE list_contains(active_markets, 'mk0000') AND list_contains(active_markets, 'mk0001')")
def p12(t):
    return t("entities").where(F.array_contains("active_markets", "mk0000") & F.array_contains("active_markets", "mk0001")).select("id")


@query("fp13_case_buckets", """SELECT CASE WHEN market_value >= 500000 THEN 'high' WHEN market_value >= 200000 THEN 'middle' WHEN market_value IS NULL THEN 'unknown' ELSE 'low' END AS bucket, count(*) AS n FROM parcels GROUP BY 1""")
def p13(t):
    v = D("market_value")
    return t.parcels.groupBy(F.when(v >= 500000, "high").when(v >= 200000, "middle").when(v.isNull(), "unknown").otherwise("low").alias("bucket")).agg(R.n())


@query("fp14_price_per_acre", "SELECT parcel_key, round(market_value / nullif(lot_size_acres, 0), 6) AS per_acre FROM parcels")
def p14(t):
    return t.parcels.select("parcel_key", F.round(F.try_divide("market_value", "lot_size_acres"), 6).alias("per_acre"))


@query("fp15_record_lookup", "SELECT parcel_key AS key, owner_name AS owner, property_address AS site, market_value AS value FROM parcels WHERE parcel_key = (SELECT min(parcel_key) FROM parcels) LIMIT 1")
def p15(t):
    return t.parcels.orderBy("parcel_key").limit(1).select(D("parcel_key").alias("key"), D("owner_name").alias("owner"), D("property_address").alias("site"), D("market_value").alias("value"))


@query("fp16_first_present", "SELECT id, coalesce(CASE WHEN upper(trim(sunbiz_document_number)) NOT IN ('', 'N/A', 'NA', 'NONE', 'NULL') THEN sunbiz_document_number END, CASE WHEN upper(trim(phone)) NOT IN ('', 'N/A', 'NA', 'NONE', 'NULL') THEN phone END, CASE WHEN upper(trim(email)) NOT IN ('', 'N/A', 'NA', 'NONE', 'NULL') THEN email END) AS contact FROM entities")
def p16(t):
    return t("entities").select("id", X.first_present(D("sunbiz_document_number"), D("phone"), D("email")).alias("contact"))


FIELDS = ["owner_name", "mailing_address", "property_address", "latitude", "square_feet", "year_built", "bedrooms", "market_value", "last_sale_date"]


@query("fp17_populated_fields", "SELECT parcel_key, " + " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in FIELDS) + " AS populated FROM parcels")
def p17(t):
    return t.parcels.select("parcel_key", populated(FIELDS).alias("populated"))


@query("fp18_needs_enrichment", "SELECT parcel_key FROM parcels WHERE square_feet IS NULL OR square_feet = 0 OR year_built IS NULL OR bedrooms IS NULL ORDER BY parcel_key LIMIT 100")
def p18(t):
    return t.parcels.where("square_feet is null or square_feet = 0 or year_built is null or bedrooms is null").select("parcel_key").orderBy("parcel_key").limit(100)


@query("fp19_outliers", "SELECT parcel_key FROM parcels WHERE (last_sale_price IS NULL OR last_sale_price BETWEEN 1000 AND 10000000) AND (land_zoning_code = 'RSF-1' OR land_zoning_code IS NULL)")
def p19(t):
    return t.parcels.where(null_or(D("last_sale_price"), D("last_sale_price").between(1e3, 1e7)) & null_or(D("land_zoning_code"), D("land_zoning_code") == "RSF-1")).select("parcel_key")


@query("fp20_text_search", "SELECT doc_id FROM documents WHERE published_date >= DATE '2020-01-01' AND (text ILIKE '%zoning%' OR text ILIKE '%permit%' OR source ILIKE '%zoning%' OR source ILIKE '%permit%') ORDER BY published_date DESC, doc_id LIMIT 5")
def p20(t):
    return find_text(t("documents"), ["zoning", "permit"], ["text", "source"], day("2020-01-01"), "published_date", 5, "doc_id").select("doc_id")


@query("fp21_array_mentions", "SELECT id, name FROM entities WHERE list_bool_or(list_transform(active_markets, lambda m: contains(m, '0001'))) ORDER BY updated_at DESC, id LIMIT 10")
def p21(t):
    return t("entities").where(F.exists("active_markets", lambda m: m.contains("0001"))).orderBy(F.desc("updated_at"), "id").limit(10).select("id", "name")


@query("fp22_box_incidents", "SELECT id FROM crime_reports WHERE latitude BETWEEN 25.27 AND 25.30 AND longitude BETWEEN -76.23 AND -76.19 AND incident_date >= TIMESTAMP '2024-01-01' ORDER BY incident_date DESC, id LIMIT 50")
def p22(t):
    i = t("crime_reports").where(D("latitude").between(25.27, 25.30) & D("longitude").between(-76.23, -76.19) & (D("incident_date") >= day("2024-01-01")))
    return i.orderBy(F.desc("incident_date"), "id").limit(50).select("id")


@query("fp24_record_class", "SELECT filing_type, count(*) AS n, count(CASE WHEN upper(status) IN ('D', 'DISSOLVED') THEN 1 END) AS dissolved FROM bulk_llc_records WHERE filing_type LIKE 'FL%' GROUP BY 1")
def p24(t):
    return t("bulk_llc_records").where(D("filing_type").like("FL%")).groupBy("filing_type").agg(R.n(), F.count_if(F.upper("status").isin("D", "DISSOLVED")).alias("dissolved"))


@query("fp25_nan_to_null", "SELECT chunk_id, CASE WHEN NOT isnan(v) THEN round(v, 6) END AS v FROM (SELECT chunk_id, CASE WHEN chunk_words = 0 OR chunk_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE chunk_chars * 1.0 / chunk_words END AS v FROM ordinance_embeddings)")
def p25(t):
    v = F.when((D("chunk_words") == 0) | (D("chunk_id") % 7 == 0), F.lit(float("nan"))).otherwise(D("chunk_chars") / D("chunk_words"))
    return t("ordinance_embeddings").select("chunk_id", F.when(~F.isnan(v), F.round(v, 6)).alias("v"))


@query("q01_search", """SELECT parcel_key, market_value FROM parcels WHERE upper(property_type) = upper('single family') AND market_value >= 100000 AND year_built >= 1950 AND market_value <= 400000 AND lot_size_acres <= 2.0 AND has_pool = TRUE AND owner_name IS NOT NULL AND trim(owner_name) <> ''
ORDER BY market_value DESC NULLS LAST, last_sale_date DESC NULLS LAST, parcel_key LIMIT 60""")
def q01(t):
    return search(t.parcels, WIDE).select("parcel_key", "market_value")


@query("w06_diversity_cap")
def w06(t):
    found = search(t.parcels, Criteria(least={"market_value": 100000}), limit=100)
    return diversity_cap(found.select("parcel_key", "owner_name", "latitude", "longitude", "market_value", "last_sale_date"), limit=100).select("place", "parcel_key", "owner_name")


@query("w06_owner_cap", "SELECT parcel_key, owner_name FROM parcels WHERE owner_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY owner_name ORDER BY market_value DESC NULLS LAST, last_sale_date DESC NULLS LAST, parcel_key) <= 2")
def w06b(t):
    return owner_cap(t.parcels.where("owner_name is not null"), "owner_name", 2, "market_value_recent").select("parcel_key", "owner_name")


@query("q09_property_details", "SELECT parcel_key, property_address, " + " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in FIELDS) + " AS populated FROM parcels WHERE upper(property_address) = (SELECT min(upper(property_address)) FROM parcels)")
def q09(t):
    first = t.parcels.agg(F.min(F.upper("property_address")).alias("_a"))
    return t.parcels.join(F.broadcast(first), F.upper("property_address") == D("_a")).select("parcel_key", "property_address", populated(FIELDS).alias("populated"))


@query("q18_criteria_search", """SELECT parcel_key, round(market_value / nullif(lot_size_acres, 0), 6) AS per_acre FROM parcels WHERE lot_size_acres >= 0.5 AND (land_zoning_code ILIKE '%AGR%' OR land_zoning_code ILIKE '%CON%') AND NOT owner_name ILIKE '%LLC%' ORDER BY per_acre ASC NULLS LAST, parcel_key LIMIT 20""")
def q18(t):
    c = Criteria(least={"lot_size_acres": 0.5}, one_of={"land_zoning_code": ["AGR", "CON"]}, lacks={"owner_name": ["LLC"]})
    p = t.parcels.where(conjunction(c.conditions())).select("parcel_key", F.round(F.try_divide("market_value", "lot_size_acres"), 6).alias("per_acre"))
    return p.orderBy(F.asc_nulls_last("per_acre"), "parcel_key").limit(20)


@query("q18_entity_properties", "SELECT owner_name, parcel_key, market_value FROM parcels WHERE owner_name ILIKE '%STATE TRANSPORTATION%' ORDER BY market_value DESC NULLS LAST, parcel_key LIMIT 100")
def q18b(t):
    return t.parcels.where(contains_ci(D("owner_name"), "STATE TRANSPORTATION")).orderBy(F.desc_nulls_last("market_value"), "parcel_key").limit(100).select("owner_name", "parcel_key", "market_value")
