"""Joins (J)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landweave.operators import rollups as R
from landweave.operators.dual_tree import near_join, region_join, usable
from landweave.operators.fuzzy import best_similar, first_key_hit, similarity_join, text_contains_name
from landweave.queries.base import Registry
from landweave.queries.general import HAVERSINE
from landweave.queries.scalars import OK, jaccard, word_grams

reg = Registry()
query = reg.query
D = F.col


def day(s: str):
    return F.lit(s).cast("date")


@query("j01_equi", "SELECT p.parcel_key, e.id AS entity_id FROM parcels p JOIN entities e ON p.owner_name = e.name AND p.market_id = e.first_seen_market_id")
def j01(t):
    e = t("entities").select(D("id").alias("entity_id"), D("name").alias("owner_name"), D("first_seen_market_id").alias("market_id"))
    return t.parcels.join(e, ["owner_name", "market_id"]).select("parcel_key", "entity_id")


@query("j02_equal_ignoring_case", "SELECT upper(trim(p.owner_name)) AS k, count(*) AS pairs FROM (SELECT DISTINCT owner_name FROM parcels) p JOIN entities e ON upper(trim(p.owner_name)) = upper(trim(e.name)) GROUP BY 1")
def j02(t):
    a = t.parcels.select("owner_name").distinct().select(F.upper(F.trim("owner_name")).alias("k"))
    return a.join(t("entities").select(F.upper(F.trim("name")).alias("k")), "k").groupBy("k").agg(R.n("pairs"))


@query("j03_left_aggregate", "SELECT h.parcel_id, coalesce(n, 0) AS permits, value FROM holdings h LEFT JOIN (SELECT parcel_id, count(*) AS n, sum(project_value) AS value FROM permits GROUP BY 1) p USING (parcel_id)")
def j03(t):
    p = t.permits.groupBy("parcel_id").agg(R.n(), F.sum("project_value").alias("value"))
    return t.holdings.join(p, "parcel_id", "left").select("parcel_id", F.coalesce("n", F.lit(0)).alias("permits"), "value")


@query("j04_left_extra_condition", "SELECT c.id, e.id AS entity_id FROM bulk_llc_records c LEFT JOIN (SELECT min(id) AS id, sunbiz_document_number AS d FROM entities WHERE status IS NOT NULL GROUP BY 2) e ON e.d = c.document_number AND c.filing_type = 'FLAL'")
def j04(t):
    e = t("entities").where("status is not null").groupBy(D("sunbiz_document_number").alias("d")).agg(F.min("id").alias("entity_id"))
    return t("bulk_llc_records").join(e, (D("d") == D("document_number")) & (D("filing_type") == "FLAL"), "left").select("id", "entity_id")


@query("j05_three_roles", """SELECT p.parcel_id, p.line, s.s_name AS contractor, a.c_name AS applicant, o.c_name AS owner FROM permits p LEFT JOIN supplier s ON s.s_suppkey = p.contractor_id LEFT JOIN customer a ON a.c_custkey = p.applicant_id
LEFT JOIN holdings h ON h.parcel_id = p.parcel_id LEFT JOIN customer o ON o.c_custkey = h.owner_id WHERE p.applied >= DATE '2001-07-01'""")
def j05(t):
    p = t.permits.where(D("applied") >= day("2001-07-01"))
    s = t("supplier").select(D("s_suppkey").alias("contractor_id"), D("s_name").alias("contractor"))
    a = t("customer").select(D("c_custkey").alias("applicant_id"), D("c_name").alias("applicant"))
    o = t("customer").select(D("c_custkey").alias("owner_id"), D("c_name").alias("owner"))
    h = t.holdings.select("parcel_id", "owner_id")
    return p.join(s, "contractor_id", "left").join(a, "applicant_id", "left").join(h, "parcel_id", "left").join(o, "owner_id", "left").select("parcel_id", "line", "contractor", "applicant", "owner")


@query("j06_one_row_per_key", "SELECT p.parcel_key, e.n AS entities, e.least AS entity_id FROM parcels p LEFT JOIN (SELECT upper(trim(canonical_name)) AS k, count(*) AS n, min(id) AS least FROM entities GROUP BY 1) e ON e.k = upper(trim(p.owner_name))")
def j06(t):
    e = t("entities").groupBy(F.upper(F.trim("canonical_name")).alias("k")).agg(R.n("entities"), F.min("id").alias("entity_id"))
    return t.parcels.join(e, F.upper(F.trim("owner_name")) == D("k"), "left").select("parcel_key", "entities", "entity_id")


@query("j07_two_keys_and_box", "SELECT DISTINCT c.id, p.parcel_key FROM crime_reports c JOIN parcels p ON upper(trim(p.property_address)) = upper(trim(c.incident_address)) AND p.market_id = c.market_id WHERE p.latitude BETWEEN 25 AND 26")
def j07(t):
    p = t.parcels.where(D("latitude").between(25, 26)).select("parcel_key", "market_id", F.upper(F.trim("property_address")).alias("a"))
    c = t("crime_reports").select("id", "market_id", F.upper(F.trim("incident_address")).alias("a"))
    return c.join(p, ["market_id", "a"]).select("id", "parcel_key").distinct()


@query("j08_one_hop", "SELECT e.name AS source, x.name AS target, r.relationship_type, r.confidence_score FROM entity_relationships r JOIN entities e ON e.id = r.source_entity_id JOIN entities x ON x.id = r.target_entity_id WHERE r.is_active ORDER BY r.confidence_score DESC NULLS LAST, r.id LIMIT 20")
def j08(t):
    a = t("entities").select(D("id").alias("source_entity_id"), D("name").alias("source"))
    b = t("entities").select(D("id").alias("target_entity_id"), D("name").alias("target"))
    best = t("entity_relationships").where("is_active").join(a, "source_entity_id").join(b, "target_entity_id")
    return best.orderBy(F.desc_nulls_last("confidence_score"), "id").limit(20).select("source", "target", "relationship_type", "confidence_score")


@query("j09_semi", "SELECT id FROM entities WHERE id IN (SELECT target_entity_id FROM entity_relationships WHERE relationship_type = 'OWNS')")
def j09(t):
    r = t("entity_relationships").where("relationship_type = 'OWNS'").select(D("target_entity_id").alias("id"))
    return t("entities").join(r, "id", "left_semi").select("id")


@query("j10_periods", "SELECT count(CASE WHEN applied >= DATE '2000-08-01' THEN 1 END) AS this_year, count(CASE WHEN applied >= DATE '1999-08-01' AND applied < DATE '2000-08-01' THEN 1 END) AS last_year, sum(CASE WHEN applied >= DATE '2000-08-01' THEN project_value END) AS this_value, sum(CASE WHEN applied >= DATE '1999-08-01' AND applied < DATE '2000-08-01' THEN project_value END) AS last_value FROM permits")
def j10(t):
    now = D("applied") >= day("2000-08-01")
    before = (D("applied") >= day("1999-08-01")) & ~now
    return t.permits.agg(F.count_if(now).alias("this_year"), F.count_if(before).alias("last_year"), F.sum(F.when(now, D("project_value"))).alias("this_value"), F.sum(F.when(before, D("project_value"))).alias("last_value"))


@query("j11_near_centroid", f"""WITH ok AS (SELECT * FROM parcels WHERE {OK}), c AS (SELECT owner_name, avg(latitude) AS la, avg(longitude) AS lo FROM ok WHERE owner_name IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)
SELECT c.owner_name, p.parcel_key FROM c JOIN ok p ON p.latitude BETWEEN c.la - 0.002 AND c.la + 0.002 AND {HAVERSINE.format(a='c.la', b='c.lo', c='p.latitude', e='p.longitude')} <= 200""")
def j11(t):
    ok = t.parcels.where(usable(D("latitude"), D("longitude")))
    c = ok.where("owner_name is not null").groupBy("owner_name").agg(R.n("_n"), F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon")).where("_n >= 3").select(D("owner_name").alias("id"), "lat", "lon")
    p = ok.select(D("parcel_key").alias("id"), D("latitude").alias("lat"), D("longitude").alias("lon"))
    return near_join(c, p, 200.0).select(D("a").alias("owner_name"), D("b").alias("parcel_key"))


@query("j12_radius", f"""SELECT a.parcel_key AS a, count(*) AS n FROM (SELECT * FROM parcels WHERE {OK}) a JOIN (SELECT * FROM parcels WHERE {OK}) b ON b.latitude BETWEEN a.latitude - 0.003 AND a.latitude + 0.003 AND {HAVERSINE.format(a='a.latitude', b='a.longitude', c='b.latitude', e='b.longitude')} <= 250 GROUP BY 1""")
def j12(t):
    p = t.parcels.where(usable(D("latitude"), D("longitude"))).select(D("parcel_key").alias("id"), D("latitude").alias("lat"), D("longitude").alias("lon"))
    return near_join(p, p, 250.0).groupBy("a").agg(R.n())


ZONES = """edges AS (SELECT zone_id, ring[i].lon AS x1, ring[i].lat AS y1, ring[i % len(ring) + 1].lon AS x2, ring[i % len(ring) + 1].lat AS y2 FROM (SELECT zone_id, ring, unnest(range(1, len(ring) + 1)) AS i FROM bulk_gis_zoning)),
box AS (SELECT zone_id, min(x1) AS x0, max(x1) AS x9, min(y1) AS y0, max(y1) AS y9 FROM edges GROUP BY 1),
hit AS (SELECT i.parcel_key, e.zone_id FROM parcels i JOIN box b ON i.latitude BETWEEN b.y0 AND b.y9 AND i.longitude BETWEEN b.x0 AND b.x9
JOIN edges e ON e.zone_id = b.zone_id AND (e.y1 > i.latitude) <> (e.y2 > i.latitude) AND i.longitude < (e.x2 - e.x1) * (i.latitude - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""


def parcel_zones(t):
    p = t.parcels.where(usable(D("latitude"), D("longitude"))).select(D("parcel_key").alias("id"), D("latitude").alias("lat"), D("longitude").alias("lon"))
    return region_join(p, t("bulk_gis_zoning").select(D("zone_id").alias("region"), "ring")).select(D("a").alias("parcel_key"), D("region").alias("zone_id"))


@query("j13_point_in_polygon", f"WITH {ZONES} SELECT parcel_key, zone_id FROM hit")
def j13(t):
    return parcel_zones(t)


@query("q35_zoning_enrichment", f"WITH {ZONES}, z AS (SELECT h.parcel_key, min(g.zoning_code) AS code FROM hit h JOIN bulk_gis_zoning g USING (zone_id) GROUP BY 1) SELECT p.parcel_key, coalesce(p.land_zoning_code, z.code) AS land_zoning_code, p.land_zoning_code IS NULL AND z.code IS NOT NULL AS filled FROM parcels p LEFT JOIN z USING (parcel_key)")
def q35(t):
    z = parcel_zones(t).join(t("bulk_gis_zoning").select("zone_id", "zoning_code"), "zone_id").groupBy("parcel_key").agg(F.min("zoning_code").alias("code"))
    return t.parcels.join(z, "parcel_key", "left").select("parcel_key", F.coalesce("land_zoning_code", "code").alias("land_zoning_code"), (D("land_zoning_code").isNull() & D("code").isNotNull()).alias("filled"))


SIMILAR = f"""WITH e AS (SELECT id, {word_grams('name')} AS g FROM entities WHERE name IS NOT NULL), r AS (SELECT id, {word_grams('name')} AS h FROM bulk_llc_records WHERE name IS NOT NULL),
s AS (SELECT e.id AS l, r.id AS r, {jaccard('g', 'h')} AS s FROM e JOIN r ON list_has_any(g, h))"""


@query("j14_fuzzy_top1", f"{SIMILAR} SELECT l, r, round(s, 6) AS similarity FROM s WHERE s >= 0.7 QUALIFY row_number() OVER (PARTITION BY l ORDER BY s DESC, r) = 1")
def j14(t):
    return best_similar(t("entities"), t("bulk_llc_records"), "id", "name", 0.7).select("l", "r", F.round("similarity", 6).alias("similarity"))


@query("j14_fuzzy_all", f"{SIMILAR} SELECT l, r, round(s, 6) AS similarity FROM s WHERE s >= 0.3")
def j14b(t):
    return similarity_join(t("entities"), t("bulk_llc_records"), "id", "name", 0.3).select("l", "r", F.round("similarity", 6).alias("similarity"))


@query("j15_later_wins_merge", """SELECT h.parcel_id, coalesce(b.v, a.v, 0) AS v, coalesce(b.s, a.s) AS s FROM holdings h LEFT JOIN (SELECT parcel_id, max(line) AS v, min(status) AS s FROM permits WHERE work_type = 'F' GROUP BY 1) a USING (parcel_id) LEFT JOIN (SELECT parcel_id, max(line) AS v, min(status) AS s FROM permits WHERE work_type = 'O' GROUP BY 1) b USING (parcel_id)""")
def j15(t):
    def side(w: str, k: str):
        return t.permits.where(D("work_type") == w).groupBy("parcel_id").agg(F.max("line").alias(f"v_{k}"), F.min("status").alias(f"s_{k}"))

    return t.holdings.join(side("F", "a"), "parcel_id", "left").join(side("O", "b"), "parcel_id", "left").select("parcel_id", F.coalesce("v_b", "v_a", F.lit(0)).alias("v"), F.coalesce("s_b", "s_a").alias("s"))


@query("j16_address_to_parcel", "SELECT e.id, p.parcel_key FROM entities e JOIN (SELECT upper(property_address) AS a, min(parcel_key) AS parcel_key FROM parcels GROUP BY 1) p ON p.a = upper(e.primary_address)")
def j16(t):
    one = t.parcels.groupBy(F.upper("property_address").alias("a")).agg(F.min("parcel_key").alias("parcel_key"))
    return t("entities").select("id", F.upper("primary_address").alias("a")).join(one, "a").select("id", "parcel_key")


@query("j17_text_contains_name")
def j17(t):
    names = t("entities").where("name is not null").select("name").distinct()
    return text_contains_name(t("documents"), names.withColumn("key", D("name")), "doc_id", "text", "key", "name").select("doc_id", D("key").alias("name"))


@query("j18_one_join_for_many_lookups", "SELECT p.parcel_key, s.price AS best_sale FROM parcels p JOIN (SELECT city, property_type, max(last_sale_price) AS price FROM parcels GROUP BY 1, 2) s ON s.city = p.city AND s.property_type = p.property_type")
def j18(t):
    w = W.partitionBy("city", "property_type")
    return t.parcels.where("city is not null and property_type is not null").select("parcel_key", F.max("last_sale_price").over(w).alias("best_sale"))


@query("j19_anti_hash", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'code-library' AND text IS NOT NULL)")
def j19(t):
    d = t("documents").where("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return d.join(d.where("source = 'code-library'").select("h"), "h", "left_anti").select("doc_id")


@query("j20_latest_restriction", "SELECT market_id, count(*) AS n FROM parcels GROUP BY 1")
def j20(t):
    return t.parcels.groupBy("market_id").agg(R.n())


@query("j21_get_or_create", "SELECT document_number, min(id) AS id, false AS created FROM bulk_llc_records WHERE document_number IS NOT NULL GROUP BY 1 UNION ALL SELECT sunbiz_document_number, min(id), true FROM entities WHERE regexp_matches(sunbiz_document_number, '[0-9]') AND sunbiz_document_number NOT IN (SELECT document_number FROM bulk_llc_records WHERE document_number IS NOT NULL) GROUP BY 1")
def j21(t):
    from landweave.operators.upsert import get_or_create

    have = t("bulk_llc_records").where("document_number is not null").groupBy("document_number").agg(F.min("id").alias("id"))
    want = t("entities").where(D("sunbiz_document_number").rlike("[0-9]")).groupBy(D("sunbiz_document_number").alias("document_number")).agg(F.min("id").alias("id"))
    return get_or_create(have, want, ["document_number"])


@query("j22_definitive_keys", """SELECT e.id, coalesce(a.id, b.id) AS registry_id, CASE WHEN a.id IS NOT NULL THEN 'document_number' WHEN b.id IS NOT NULL THEN 'name' END AS matched_on FROM entities e
LEFT JOIN (SELECT document_number AS k, min(id) AS id FROM bulk_llc_records GROUP BY 1) a ON a.k = e.sunbiz_document_number LEFT JOIN (SELECT upper(name) AS k, min(id) AS id FROM bulk_llc_records GROUP BY 1) b ON b.k = upper(e.name)""")
def j22(t):
    left = t("entities").select("id", D("sunbiz_document_number").alias("document_number"), F.upper("name").alias("name"))
    right = t("bulk_llc_records").select(D("id").alias("registry_id"), "document_number", F.upper("name").alias("name"))
    return first_key_hit(left, right, ["document_number", "name"], "registry_id").select("id", "registry_id", "matched_on")


@query("j23_suppressed_signal", """WITH a AS (SELECT id, upper(trim(registered_agent)) AS agent FROM entities WHERE trim(registered_agent) <> ''), s AS (SELECT agent FROM a GROUP BY 1 HAVING count(*) >= 4)
SELECT x.id AS a, y.id AS b FROM a x JOIN a y ON x.agent = y.agent AND x.id < y.id WHERE x.agent NOT IN (SELECT agent FROM s)""")
def j23(t):
    a = t("entities").where("trim(registered_agent) != ''").select("id", F.upper(F.trim("registered_agent")).alias("agent"))
    # agents of many are services and say nothing, so what is left to pair are groups of at most three
    few = a.join(a.groupBy("agent").agg(R.n("_n")).where("_n < 4").select("agent"), "agent", "left_semi").select("id", "agent")
    x, y = few.toDF("a", "agent"), few.toDF("b", "agent")
    return x.join(y, "agent").where("a < b").select("a", "b")
