"""Composite analytics (Q), sources (S) and sinks (K)."""

from __future__ import annotations


from pyspark.sql import functions as F

from landweave.functions import text as X
from landweave.functions import vector as V
from landweave.operators import rollups as R
from landweave.operators import upsert as K
from landweave.operators.chunking import chunk, hash_embedding, new_texts
from landweave.operators.dual_tree import usable
from landweave.operators.fuzzy import best_match, best_similar, decision, similar_pairs, weighted_score
from landweave.operators.search import owner_cap
from landweave.plans import places as P
from landweave.plans import valuation as VAL
from landweave.queries.base import Registry
from landweave.queries.general import HAVERSINE
from landweave.queries.scalars import OK, jaccard, miles, word_grams
from landweave.session import spread
from landweave.sources import records as S
from landweave.streaming.ingest import Parsers, fresh_facts

reg = Registry()
query = reg.query
D = F.col


def day(s: str):
    return F.lit(s).cast("date")


@query("q03_market_trends", """WITH a AS (SELECT market_id, count(*) AS inventory, count(CASE WHEN last_sale_date >= DATE '2023-12-02' THEN 1 END) AS sales, round(quantile_cont(market_value, 0.5), 4) AS median FROM parcels GROUP BY 1)
SELECT *, CASE WHEN sales * 100.0 / inventory > 5 THEN 'active' WHEN sales > 0 THEN 'quiet' ELSE 'still' END AS insight FROM a""")
def q03(t):
    a = t.parcels.groupBy("market_id").agg(R.n("inventory"), F.count_if(D("last_sale_date") >= F.date_sub(day("2024-12-01"), 365)).alias("sales"), F.round(F.percentile("market_value", F.lit(0.5)), 4).alias("median"))
    return a.withColumn("insight", F.when(D("sales") * 100.0 / D("inventory") > 5, "active").when(D("sales") > 0, "quiet").otherwise("still"))


@query("q04_clusters", f"""WITH c AS (SELECT CAST(round_even(longitude / (500 / CAST(111000 AS DOUBLE)), 0) AS BIGINT) AS cx, CAST(round_even(latitude / (500 / CAST(111000 AS DOUBLE)), 0) AS BIGINT) AS cy, property_type, CAST(market_value AS DECIMAL(18,2)) AS v FROM parcels WHERE {OK}),
b AS (SELECT cx, cy, property_type, count(*) AS k, sum(v) AS v FROM c GROUP BY 1, 2, 3), g AS (SELECT cx, cy, sum(k) AS parcels, sum(v) AS value FROM b GROUP BY 1, 2 HAVING sum(k) >= 3),
d AS (SELECT cx, cy, property_type, k FROM b QUALIFY row_number() OVER (PARTITION BY cx, cy ORDER BY CASE WHEN property_type IS NULL THEN 0 ELSE k END DESC, coalesce(property_type, '~')) = 1)
SELECT cx, cy, CAST(parcels AS BIGINT) AS parcels, value, property_type AS dominant, round(k * 1.0 / parcels, 6) AS purity, CASE WHEN contains(property_type, 'FAMILY') AND k * 1.0 / parcels > 0.7 THEN 'residential' WHEN property_type = 'COMMERCIAL' AND k * 1.0 / parcels > 0.6 THEN 'commercial' WHEN property_type = 'VACANT' AND k * 1.0 / parcels > 0.5 THEN 'vacant' WHEN k * 1.0 / parcels < 0.4 THEN 'mixed' ELSE 'other' END AS label
FROM g JOIN d USING (cx, cy) ORDER BY parcels DESC, cx, cy LIMIT 20""")
def q04(t):
    return P.clusters(t.parcels)


ASSEMBLED = f"""ok AS (SELECT owner_name AS owner, parcel_key, latitude AS la, longitude AS lo FROM parcels WHERE {OK} AND owner_name IS NOT NULL),
bx AS (SELECT owner, count(*) AS parcels FROM ok GROUP BY 1 HAVING count(*) >= 2 AND greatest(max(la) - min(la), max(lo) - min(lo)) <= 500 / CAST(111000 AS DOUBLE) * 1.3),
pr AS (SELECT a.owner, a.la AS y1, a.lo AS x1, b.la AS y2, b.lo AS x2 FROM ok a JOIN ok b ON a.owner = b.owner AND (a.la < b.la OR (a.la = b.la AND a.lo <= b.lo)) WHERE a.owner IN (SELECT owner FROM bx)),
lg AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY pow(y1 - y2, 2) + pow(x1 - x2, 2) DESC, y1 DESC, x1 DESC, y2 DESC, x2 DESC) AS rn FROM pr),
dm AS (SELECT owner, {HAVERSINE.format(a='y1', b='x1', c='y2', e='x2')} AS d FROM lg WHERE rn = 1)"""
SCORE = "CASE WHEN parcels >= 5 AND d < 100 THEN 95 WHEN parcels >= 4 AND d < 200 THEN 80 WHEN parcels >= 3 AND d < 300 THEN 65 WHEN parcels >= 2 AND d < 500 THEN 50 ELSE 30 END"


@query("x29_diameter", f"WITH {ASSEMBLED} SELECT owner, bx.parcels, round(d, 3) AS diameter_m FROM dm JOIN bx USING (owner)")
def x29(t):
    return P.diameters(t.parcels, "owner_name", "parcel_key", 500 / 111000.0 * 1.3).select("owner", "parcels", F.round("diameter_m", 3).alias("diameter_m"))


@query("q05_assemblages", f"WITH {ASSEMBLED} SELECT owner, parcels, round(d, 3) AS diameter_m, {SCORE} AS score FROM dm JOIN bx USING (owner) WHERE d <= 500 ORDER BY score DESC, parcels DESC, owner LIMIT 20")
def q05(t):
    return P.assemblages(t.parcels)


@query("q05_gap_parcels")
def q05b(t):
    return P.gap_parcels(t.parcels, P.assemblages(t.parcels, top=5).select("owner"), 300.0)


@query("q06_location", f"SELECT property_type, count(*) AS n, round(min({miles('6371008.8', '25.29', '-76.2', 'latitude', 'longitude')}), 3) AS nearest FROM parcels WHERE {OK} AND {miles('6371008.8', '25.29', '-76.2', 'latitude', 'longitude')} <= 1000 GROUP BY 1")
def q06(t):
    from landweave.functions.geo import haversine_m, in_box

    m = haversine_m(F.lit(25.29), F.lit(-76.2), D("latitude"), D("longitude"))
    near = t.parcels.where(usable(D("latitude"), D("longitude")) & in_box(D("latitude"), D("longitude"), 25.29, -76.2, 0.63)).withColumn("m", m).where("m <= 1000")
    return near.groupBy("property_type").agg(R.n(), F.round(F.min("m"), 3).alias("nearest"))


@query("q07_permit_history", """SELECT parcel_id, count(*) AS permits, sum(project_value) AS value, min(applied) AS first_applied, max(applied) AS last_applied, count(DISTINCT contractor_id) AS contractors, count(CASE WHEN finished IS NOT NULL THEN 1 END) AS finished FROM permits GROUP BY 1""", dates="first_applied last_applied")
def q07(t):
    return t.permits.groupBy("parcel_id").agg(R.n("permits"), F.sum("project_value").alias("value"), F.min("applied").alias("first_applied"), F.max("applied").alias("last_applied"), F.count_distinct("contractor_id").alias("contractors"), F.count("finished").alias("finished"))


@query("q08_comparables", """WITH k AS (SELECT *, last_sale_price BETWEEN 140000 AND 260000 AND (sale_qualified IS NULL OR sale_qualified = 'Q') AS sold, coalesce(market_value BETWEEN 140000 AND 260000, false) AS worth FROM parcels),
c AS (SELECT *, CASE WHEN coalesce(sold AND last_sale_date >= DATE '2023-12-01', false) THEN 1 WHEN coalesce(sold AND last_sale_date >= DATE '2022-12-01', false) THEN 2 ELSE 3 END AS t FROM k),
u AS (SELECT CASE WHEN count(CASE WHEN t = 1 THEN 1 END) >= 3 THEN 1 WHEN count(CASE WHEN t <= 2 THEN 1 END) >= 3 THEN 2 ELSE 3 END AS use_ FROM c)
SELECT parcel_key, use_ AS tier, round(CASE WHEN use_ = 3 THEN (100.0 - abs(market_value - 200000.0) / 200000.0 * 50) * 0.6 + f * 0.4 - b * 5 ELSE (100.0 - abs(last_sale_price - 200000.0) / 200000.0 * 50) * 0.4 + f * 0.4 + w * 0.2 - b * 5 END, 6) AS score
FROM (SELECT *, CASE WHEN has_pool THEN CAST(10 AS DOUBLE) ELSE 0 END AS f, coalesce(abs(bedrooms - 3), 0) AS b, CASE WHEN last_sale_date >= DATE '2024-06-01' THEN CAST(100 AS DOUBLE) ELSE 90 END AS w FROM c, u) WHERE (use_ = 3 AND worth) OR (use_ < 3 AND t <= use_)
ORDER BY score DESC NULLS LAST, parcel_key LIMIT 10""")
def q08(t):
    return VAL.comparables(t.parcels, 200000, day("2024-12-01"), bedrooms=3, pool=True)


@query("q10_search_ordinances", """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM chunks ORDER BY chunk_id DESC LIMIT 1) SELECT chunk_id, city, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS relevance FROM chunks, q WHERE state = 'FL' AND round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) >= 0.3 ORDER BY relevance DESC, chunk_id LIMIT 5""")
def q10(t):
    q = t.chunks.orderBy(F.desc("chunk_id")).limit(1).select(D("embedding").alias("_q"))
    r = F.round(V.cosine(D("embedding"), D("_q")), 6)
    return t.chunks.where("state = 'FL'").crossJoin(F.broadcast(q)).select("chunk_id", "city", r.alias("relevance")).where("relevance >= 0.3").orderBy(F.desc("relevance"), "chunk_id").limit(5)


@query("q11_property_360", """WITH s AS (SELECT city, count(*) AS neighbours, round(quantile_cont(market_value, 0.5), 4) AS median FROM parcels GROUP BY 1), o AS (SELECT owner_name, count(*) AS held FROM parcels GROUP BY 1)
SELECT p.parcel_key, s.neighbours, s.median, o.held AS owner_holdings, round(p.market_value / nullif(s.median, 0), 6) AS to_median FROM parcels p LEFT JOIN s ON s.city = p.city LEFT JOIN o ON o.owner_name = p.owner_name""")
def q11(t):
    s = t.parcels.groupBy("city").agg(R.n("neighbours"), F.round(F.percentile("market_value", F.lit(0.5)), 4).alias("median"))
    o = t.parcels.groupBy("owner_name").agg(R.n("owner_holdings"))
    return t.parcels.join(s, "city", "left").join(o, "owner_name", "left").select("parcel_key", "neighbours", "median", "owner_holdings", F.round(F.try_divide("market_value", "median"), 6).alias("to_median"))


@query("q12_entity_360", """WITH a AS (SELECT applicant_id AS id, count(*) AS permits, sum(project_value) AS permit_value, max(applied) AS last_permit FROM permits GROUP BY 1), h AS (SELECT owner_id AS id, count(*) AS holdings, sum(market_value) AS value FROM holdings GROUP BY 1)
SELECT h.id, holdings, value, coalesce(permits, 0) AS permits, permit_value, last_permit FROM h LEFT JOIN a USING (id)""", dates="last_permit")
def q12(t):
    a = t.permits.groupBy(D("applicant_id").alias("id")).agg(R.n("permits"), F.sum("project_value").alias("permit_value"), F.max("applied").alias("last_permit"))
    h = t.holdings.groupBy(D("owner_id").alias("id")).agg(R.n("holdings"), F.sum("market_value").alias("value"))
    return h.join(a, "id", "left").select("id", "holdings", "value", F.coalesce("permits", F.lit(0)).alias("permits"), "permit_value", "last_permit")


@query("q13_market_360", """WITH p AS (SELECT market_id, count(*) AS parcels, count(DISTINCT owner_name) AS owners, sum(CAST(market_value AS DECIMAL(18,2))) AS value FROM parcels GROUP BY 1), c AS (SELECT market_id, count(*) AS incidents FROM crime_reports GROUP BY 1), d AS (SELECT market_id, count(*) AS documents FROM documents GROUP BY 1), e AS (SELECT first_seen_market_id AS market_id, count(*) AS entities FROM entities GROUP BY 1)
SELECT p.*, coalesce(incidents, 0) AS incidents, coalesce(documents, 0) AS documents, coalesce(entities, 0) AS entities FROM p LEFT JOIN c USING (market_id) LEFT JOIN d USING (market_id) LEFT JOIN e USING (market_id)""")
def q13(t):
    p = t.parcels.groupBy("market_id").agg(R.n("parcels"), F.count_distinct("owner_name").alias("owners"), R.total("market_value", "value"))
    c = t("crime_reports").groupBy("market_id").agg(R.n("incidents"))
    d = t("documents").groupBy("market_id").agg(R.n("documents"))
    e = t("entities").groupBy(D("first_seen_market_id").alias("market_id")).agg(R.n("entities"))
    met = p.join(c, "market_id", "left").join(d, "market_id", "left").join(e, "market_id", "left")
    return met.select("market_id", "parcels", "owners", "value", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("incidents", "documents", "entities")])


NEAR = miles("3959", "25.29", "-76.2", "latitude", "longitude")


@query("q14_nearby", f"SELECT parcel_key, round({NEAR}, 6) AS miles FROM parcels WHERE latitude BETWEEN 20 AND 50 AND longitude < 0 AND {NEAR} <= 1.0 ORDER BY miles, parcel_key LIMIT 100")
def q14(t):
    return P.around(t.parcels, 25.29, -76.2, 1.0).select("parcel_key", "miles")


CELL = "round(floor(latitude / (0.5 / CAST(69 AS DOUBLE))) * (0.5 / CAST(69 AS DOUBLE)), 4) AS clat, round(floor(longitude / (0.5 / CAST(69 AS DOUBLE) / cos(radians(latitude)))) * (0.5 / CAST(69 AS DOUBLE) / cos(radians(latitude))), 4) AS clon"


@query("q15_hotspots", f"""WITH a AS (SELECT {CELL}, count(CASE WHEN CAST(incident_date AS DATE) >= DATE '2024-07-05' THEN 1 END) AS recent FROM crime_reports WHERE {OK} GROUP BY 1, 2), c AS (SELECT {CELL}, count(*) AS parcels, count(CASE WHEN last_sale_date >= DATE '2023-01-12' THEN 1 END) AS sales FROM parcels WHERE {OK} GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT c.clat, c.clon, parcels, coalesce(recent, 0) AS recent, sales, round(least(coalesce(recent, 0) * 1.0 / parcels, 1.0) * 0.6 + least(sales / greatest(parcels * 0.5, 1.0), 1.0) * 0.4, 6) AS score FROM c LEFT JOIN a ON a.clat = c.clat AND a.clon = c.clon""")
def q15(t):
    return P.hotspots(t.parcels, t("crime_reports"), day("2025-01-01"))


@query("q16_neighbourhood", f"SELECT property_type, count(*) AS n, CAST(sum(CAST(market_value AS DECIMAL(18,2))) AS DOUBLE) / nullif(count(market_value), 0) AS mean_value, count(CASE WHEN year_built >= 2000 THEN 1 END) AS recent, sum(CAST(market_value AS DECIMAL(18,2))) AS value FROM parcels WHERE {OK} AND {NEAR} <= 0.5 GROUP BY 1")
def q16(t):
    return P.neighbourhood(t.parcels, 25.29, -76.2, 0.5)


def _comps(t):
    subject = t.parcels.where(usable(D("latitude"), D("longitude")) & (D("property_type") == "SINGLE FAMILY"))
    s = subject.agg(F.min("parcel_key").alias("k"))
    near = t.parcels.join(F.broadcast(s), D("parcel_key") == D("k"), "inner").select(D("latitude").alias("slat"), D("longitude").alias("slon"), D("property_type").alias("stype"), D("lot_size_acres").alias("subject_acres"), D("k"))
    met = t.parcels.where((D("last_sale_price") > 0) & (D("last_sale_date") >= day("2014-12-01")) & usable(D("latitude"), D("longitude"))).join(F.broadcast(near), (D("property_type") == D("stype")) & (D("parcel_key") != D("k")))  # one row
    from landweave.functions.geo import haversine_miles

    d = met.withColumn("miles", haversine_miles(D("slat"), D("slon"), D("latitude"), D("longitude"))).where("miles <= 1.0").withColumn("days", F.datediff(day("2024-12-01"), "last_sale_date"))
    return d.select("parcel_key", D("last_sale_price").alias("price"), D("lot_size_acres").alias("acres"), "days", "miles", "subject_acres", F.round(D("miles") * 0.6 + D("days") / 365.0 * 0.4, 6).alias("rank_score")).orderBy("rank_score", "parcel_key").limit(10)


COMPS = f"""s AS (SELECT parcel_key AS k, latitude AS sla, longitude AS slo, property_type AS st, lot_size_acres AS sa FROM parcels WHERE parcel_key = (SELECT min(parcel_key) FROM parcels WHERE {OK} AND property_type = 'SINGLE FAMILY')),
m AS (SELECT p.parcel_key, last_sale_price AS price, lot_size_acres AS acres, date_diff('day', last_sale_date, DATE '2024-12-01') AS days, {miles('3959', 's.sla', 's.slo', 'p.latitude', 'p.longitude')} AS miles, sa FROM parcels p, s WHERE {OK} AND last_sale_price > 0 AND last_sale_date >= DATE '2014-12-01' AND property_type = st AND parcel_key <> k),
c AS (SELECT *, round(miles * 0.6 + days / 365.0 * 0.4, 6) AS rank_score FROM m WHERE miles <= 1.0 ORDER BY rank_score, parcel_key LIMIT 10)"""


@query("q17_comparable_sales", f"WITH {COMPS} SELECT parcel_key, price, days, rank_score FROM c")
def q17(t):
    return _comps(t).select("parcel_key", "price", "days", "rank_score")


@query("q17_value_estimate", f"""WITH {COMPS} SELECT count(*) AS comps, round(avg(price), 4) AS mean_price, round(coalesce(avg(price / nullif(acres, 0)) * max(sa), avg(price)), 4) AS estimate,
round(least(count(*) / 10.0, 0.4) + CASE WHEN count(*) = 1 THEN 0.15 ELSE greatest(0, (1 - coalesce(stddev_samp(price) / avg(price), 0)) * 0.3) END + greatest(0, (1 - avg(days) / 365.0) * 0.15) + greatest(0, (1 - avg(miles) / 5.0) * 0.15), 6) AS confidence FROM c""")
def q17b(t):
    return VAL.value_estimate(_comps(t))


@query("q17_price_validation", "SELECT parcel_key, CASE WHEN market_value IS NULL OR market_value = 0 OR last_sale_price IS NULL THEN 'unknown' WHEN last_sale_price / market_value < 0.95 THEN 'below' WHEN last_sale_price / market_value > 1.05 THEN 'above' ELSE 'fair' END AS verdict FROM parcels")
def q17c(t):
    return t.parcels.select("parcel_key", VAL.fair_price(D("last_sale_price"), D("market_value")).alias("verdict"))


@query("q19_crime_risk", """WITH c AS (SELECT market_id, count(CASE WHEN CAST(incident_date AS DATE) >= DATE '2024-07-05' THEN 1 END) AS recent, count(CASE WHEN CAST(incident_date AS DATE) >= DATE '2024-01-02' AND CAST(incident_date AS DATE) < DATE '2024-07-05' THEN 1 END) AS prior FROM crime_reports GROUP BY 1)
SELECT *, CASE WHEN recent = 0 THEN 'none' WHEN recent < 5 THEN 'low' WHEN recent < 15 THEN 'moderate' WHEN recent < 30 THEN 'high' ELSE 'severe' END AS level, CASE WHEN prior = 0 THEN CASE WHEN recent > 0 THEN 'rising' ELSE 'stable' END WHEN recent > prior * 1.1 THEN 'rising' WHEN recent < prior * 0.9 THEN 'falling' ELSE 'stable' END AS trend FROM c""")
def q19(t):
    at = F.to_date("incident_date")
    c = t("crime_reports").groupBy("market_id").agg(F.count_if(at >= day("2024-07-05")).alias("recent"), F.count_if((at >= day("2024-01-02")) & (at < day("2024-07-05"))).alias("prior"))
    level, trend = VAL.crime_risk(D("recent"), D("prior"))
    return c.select("market_id", "recent", "prior", level.alias("level"), trend.alias("trend"))


@query("q20_tax_ladder", "SELECT parcel_key, CASE WHEN r >= 1.5 THEN 'critical' WHEN r >= 1.2 THEN 'high' WHEN r >= 1.0 THEN 'moderate' ELSE 'low' END AS risk, CASE WHEN r >= 1.5 THEN -25 WHEN r >= 1.2 THEN -20 WHEN r >= 1.0 THEN -10 ELSE -5 END AS points FROM (SELECT parcel_key, assessed_value / nullif(market_value, 0) AS r FROM parcels)")
def q20(t):
    label, points = VAL.ladder(F.try_divide("assessed_value", "market_value"), [(1.5, "critical", -25), (1.2, "high", -20), (1.0, "moderate", -10)], ("low", -5))
    return t.parcels.select("parcel_key", label.alias("risk"), points.alias("points"))


@query("q22_context", """WITH o AS (SELECT owner_name, count(*) AS held, count(CASE WHEN last_sale_date >= DATE '2022-12-01' THEN 1 END) AS recent FROM parcels GROUP BY 1), c AS (SELECT market_id, count(*) AS incidents FROM crime_reports WHERE incident_date >= TIMESTAMP '2024-01-01' GROUP BY 1), d AS (SELECT market_id, count(*) FILTER (WHERE doc_type = 'news_article') AS news, count(*) FILTER (WHERE doc_type = 'council_minutes') AS council FROM documents GROUP BY 1)
SELECT p.parcel_key, o.held, coalesce(o.recent >= 4, false) AS assembling, c.incidents, d.news, d.council FROM parcels p LEFT JOIN o ON o.owner_name = p.owner_name LEFT JOIN c ON c.market_id = p.market_id LEFT JOIN d ON d.market_id = p.market_id""")
def q22(t):
    o = t.parcels.groupBy("owner_name").agg(R.n("held"), F.count_if(D("last_sale_date") >= day("2022-12-01")).alias("_recent"))
    c = t("crime_reports").where("incident_date >= timestamp_ntz'2024-01-01'").groupBy("market_id").agg(R.n("incidents"))
    d = t("documents").groupBy("market_id").agg(F.count_if(D("doc_type") == "news_article").alias("news"), F.count_if(D("doc_type") == "council_minutes").alias("council"))
    met = t.parcels.join(o, "owner_name", "left").join(c, "market_id", "left").join(d, "market_id", "left")
    return met.select("parcel_key", "held", F.coalesce(D("_recent") >= 4, F.lit(False)).alias("assembling"), "incidents", "news", "council")


RESOLVE = f"""g AS (SELECT id, {word_grams('name')} AS g, phone, upper(trim(primary_address)) AS a, lower(trim(email)) AS em FROM entities),
s AS (SELECT x.id AS l, y.id AS r, {jaccard('x.g', 'y.g')} AS name, CASE WHEN x.phone IS NOT NULL AND y.phone IS NOT NULL THEN CASE WHEN x.phone = y.phone THEN 1.0 ELSE 0.0 END END AS ph, CASE WHEN x.a IS NOT NULL AND y.a IS NOT NULL THEN CASE WHEN x.a = y.a THEN 1.0 ELSE 0.0 END END AS ad,
coalesce(x.phone = y.phone AND trim(x.phone) <> '' OR x.em = y.em AND x.em <> '' OR x.a = y.a AND x.a <> '', false) AS shared FROM g x JOIN g y ON x.id < y.id),
w AS (SELECT *, coalesce((coalesce(name * 0.35, 0) + coalesce(ph * 0.30, 0) + coalesce(ad * 0.35, 0)) / nullif(CASE WHEN name IS NOT NULL THEN 0.35 ELSE 0 END + CASE WHEN ph IS NOT NULL THEN 0.30 ELSE 0 END + CASE WHEN ad IS NOT NULL THEN 0.35 ELSE 0 END, 0), 0) AS raw, CASE WHEN name > 0 THEN 1 ELSE 0 END + CASE WHEN ph > 0 THEN 1 ELSE 0 END + CASE WHEN ad > 0 THEN 1 ELSE 0 END AS pos FROM s WHERE name > 0.3 OR shared)
SELECT l, r, round(CASE WHEN pos = 1 THEN least(raw, 0.84) ELSE raw END, 6) AS score FROM w"""


@query("q23_entity_resolution", f"WITH {RESOLVE}")
def q23(t):
    """All pairs of entities, of whatever markets, whose names have a similarity above 0.3 or that share phone, e-mail or
    address; blank values are not shared."""
    e = t("entities").select("id", "name", "phone", F.lower(F.trim("email")).alias("email"), F.upper(F.trim("primary_address")).alias("a"))
    shared = None
    for c in ("phone", "email", "a"):
        k = e.where(F.trim(c) != "").select("id", c)
        met = k.withColumnRenamed("id", "l").join(k.withColumnRenamed("id", "r").hint("merge"), c).where("l < r").select("l", "r")
        shared = met if shared is None else shared.unionByName(met)
    x, y = (e.select(D("id").alias(k), D("name").alias(f"{k}_name")) for k in "lr")
    named = shared.distinct().join(x.hint("merge"), "l").join(y.hint("merge"), "r").select("l", "r", X.word_similarity(D("l_name"), D("r_name")).alias("similarity"))
    found = similar_pairs(e, "id", "name", 0.3).where("similarity > 0.3")
    pairs = found.unionByName(named).groupBy("l", "r").agg(F.max("similarity").alias("similarity"))
    # hashes of 64 bits tell whether two values are equal
    x, y = (e.select(D("id").alias(k), *[F.when(D(c).isNotNull(), F.xxhash64(c)).alias(f"{k}_{c}") for c in ("phone", "a")]) for k in "lr")
    met = pairs.join(x.hint("merge"), "l").join(y.hint("merge"), "r")

    def same(c: str):
        return F.when(D(f"l_{c}").isNotNull() & D(f"r_{c}").isNotNull(), (D(f"l_{c}") == D(f"r_{c}")).cast("double"))

    score = weighted_score({"name": (D("similarity"), F.lit(0.35)), "phone": (same("phone"), F.lit(0.30)), "address": (same("a"), F.lit(0.35))})
    return met.select("l", "r", F.round(score, 6).alias("score"))


@query("q23_decisions", f"WITH z AS (WITH {RESOLVE}) SELECT CASE WHEN score >= 0.85 THEN 'accept' WHEN score >= 0.6 THEN 'review' ELSE 'create' END AS decision, count(*) AS n FROM z GROUP BY 1")
def q23b(t):
    return q23(t).groupBy(decision(D("score")).alias("decision")).agg(R.n())


@query("q24_opportunity", """WITH o AS (SELECT owner_name, count(*) AS held FROM parcels GROUP BY 1), m AS (SELECT market_id, count(CASE WHEN last_sale_date >= DATE '2023-12-01' THEN 1 END) AS momentum FROM parcels GROUP BY 1),
x AS (SELECT p.parcel_key, p.last_sale_price / nullif(p.market_value, 0) AS r, coalesce(o.held, 0) AS held, least(m.momentum, 30) AS mo, CASE WHEN p.year_built < 1950 THEN 1 ELSE 0 END + CASE WHEN p.sale_qualified = 'U' THEN 1 ELSE 0 END AS red FROM parcels p LEFT JOIN o ON o.owner_name = p.owner_name JOIN m USING (market_id)),
s AS (SELECT parcel_key, red, greatest(least(CASE WHEN r <= 0.85 THEN 30 WHEN r <= 0.95 THEN 20 WHEN r <= 1.05 THEN 15 WHEN r <= 1.15 THEN 10 ELSE 0 END + CASE WHEN held >= 20 THEN 20 WHEN held >= 10 THEN 15 WHEN held >= 5 THEN 10 WHEN held >= 3 THEN 7 ELSE 0 END + mo + greatest(red * -5, -20), 100), 0) AS score FROM x)
SELECT parcel_key, score, CASE WHEN score >= 60 AND red = 0 THEN 'BUY' WHEN score >= 30 THEN 'INVESTIGATE' ELSE 'PASS' END AS advice FROM s""")
def q24(t):
    o = t.parcels.groupBy("owner_name").agg(R.n("held"))
    m = t.parcels.groupBy("market_id").agg(F.count_if(D("last_sale_date") >= day("2023-12-01")).alias("momentum"))
    red = F.when(D("year_built") < 1950, 1).otherwise(0) + F.when(D("sale_qualified") == "U", 1).otherwise(0)
    met = t.parcels.join(o, "owner_name", "left").join(m, "market_id").withColumn("red", red)
    score = VAL.opportunity(D("market_value"), D("last_sale_price"), F.coalesce("held", F.lit(0)), D("momentum"), D("red")).cast("int")
    return met.select("parcel_key", score.alias("score"), VAL.recommendation(score, D("red")).alias("advice"))


@query("q25_assembly", """WITH a AS (SELECT parcel_id, sum(quantity) AS area, count(*) AS n FROM permits GROUP BY 1), y AS (SELECT parcel_id, max(year(applied)) AS yr FROM permits GROUP BY 1), e AS (SELECT p.parcel_id, sum(project_value) AS exempt FROM permits p JOIN y ON y.parcel_id = p.parcel_id AND y.yr = year(p.applied) GROUP BY 1)
SELECT h.parcel_id, h.owner_name, a.area, coalesce(a.n, 0) AS permits, e.exempt FROM holdings h LEFT JOIN a USING (parcel_id) LEFT JOIN e USING (parcel_id)""")
def q25(t):
    a = t.permits.groupBy("parcel_id").agg(F.sum("quantity").alias("area"), R.n("_n"))
    e = R.latest_year_totals(t.permits, "parcel_id", F.year("applied"), "project_value", "permit_type").select("parcel_id", D("amount").alias("exempt"))
    return t.holdings.join(a, "parcel_id", "left").join(e, "parcel_id", "left").select("parcel_id", "owner_name", "area", F.coalesce("_n", F.lit(0)).alias("permits"), "exempt")


@query("k07_unchanged_deliveries", """WITH s AS (SELECT id, lag(content_md5) OVER (PARTITION BY market_id ORDER BY snapshot_date, id) AS before, content_md5 FROM bulk_data_snapshots WHERE status = 'completed') SELECT id AS snapshot_id, before IS NOT NULL AND before = content_md5 AS unchanged FROM s""")
def k07(t):
    from pyspark.sql import Window as W

    w = W.partitionBy("market_id").orderBy("snapshot_date", "id")
    s = t("bulk_data_snapshots").where("status = 'completed'").withColumn("_b", F.lag("content_md5").over(w))
    return s.select(D("id").alias("snapshot_id"), F.coalesce(D("_b") == D("content_md5"), F.lit(False)).alias("unchanged"))


@query("q26_snapshot_sync", "SELECT DISTINCT market_id AS changed_market FROM parcels")
def q26(t):
    records = t("bulk_property_records")
    volatile = ["id", "snapshot_id", "loaded_at"]
    ids = R.top_per_group(t("bulk_data_snapshots").where("status = 'completed'").select("market_id", "id", "snapshot_date"), ["market_id"], [F.asc("snapshot_date"), F.asc("id")], 1).select(D("id").alias("snapshot_id"))
    first = records.join(ids, "snapshot_id", "left_semi")
    now = K.content_digest(t.parcels.drop("parcel_key"), ["market_id"], volatile)
    return K.changed_groups(K.content_digest(first, ["market_id"], volatile), now, ["market_id"]).select(D("market_id").alias("changed_market"))


@query("k01_upsert", "WITH u AS (SELECT c_custkey AS k, c_name AS v, 0 AS g FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier) SELECT k, v FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY g DESC, v) = 1")
def k01(t):
    return K.latest_wins(t("customer").select(D("c_custkey").alias("k"), D("c_name").alias("v")), t("supplier").select(D("s_suppkey").alias("k"), D("s_name").alias("v")), ["k"])


@query("k02_insert_or_ignore", "SELECT s_suppkey AS k, s_name AS v FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def k02(t):
    return K.insert_or_ignore(t("supplier").select(D("s_suppkey").alias("k"), D("s_name").alias("v")), t("customer").select(D("c_custkey").alias("k"), D("c_name").alias("v")), ["k"])


@query("k03_touch", "SELECT s_suppkey AS k, s_name AS v, coalesce(c_acctbal, s_acctbal) AS at_ FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def k03(t):
    return K.touch(t("supplier").select(D("s_suppkey").alias("k"), D("s_name").alias("v"), D("s_acctbal").alias("at_")), t("customer").select(D("c_custkey").alias("k"), D("c_name").alias("v"), D("c_acctbal").alias("at_")), ["k"], "at_")


@query("k05_partial_update", "SELECT e.id, coalesce(r.registered_agent, e.registered_agent) AS registered_agent FROM entities e LEFT JOIN (SELECT document_number, max(registered_agent) AS registered_agent FROM bulk_llc_records GROUP BY 1) r ON r.document_number = e.sunbiz_document_number")
def k05(t):
    e = t("entities").select("id", D("sunbiz_document_number").alias("document_number"), "registered_agent")
    return K.fill(e, t("bulk_llc_records").where("document_number is not null"), ["document_number"], ["registered_agent"]).select("id", "registered_agent")


@query("q27_fact_ingestion", "SELECT min(doc_id) AS id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL AND doc_type = 'notice' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL AND doc_type = 'faq') GROUP BY 2")
def q27(t):
    facts = t("documents").select(D("doc_id").alias("id"), D("text").alias("content"), D("doc_type").alias("fact_type"))
    stored = facts.where("fact_type = 'faq' and content is not null").select(F.sha2("content", 256).alias("content_hash"))
    parsers = Parsers()
    parsers.register("notice", lambda f: fresh_facts(f, stored).select("id", "content_hash"))
    return parsers.parse(facts, "notice")


@query("q28_relationships", """WITH o AS (SELECT e.id, upper(json_extract_string(x, '$.name')) AS person FROM entities e, (SELECT id, unnest(CAST(json_extract(officers, '$[*]') AS JSON[])) AS x FROM entities WHERE officers IS NOT NULL) u WHERE u.id = e.id),
m AS (SELECT p.id AS source, o.id AS target, 'MEMBER_OF' AS kind, 0.95 AS confidence FROM o JOIN entities p ON upper(p.name) = o.person AND p.id <> o.id), a AS (SELECT x.id AS source, y.id AS target, 'REGISTERED_WITH' AS kind, 0.90 AS confidence FROM entities x JOIN entities y ON upper(trim(x.registered_agent)) = upper(trim(y.name)) AND x.id <> y.id)
SELECT source, target, kind, CAST(max(confidence) AS DOUBLE) AS confidence FROM (SELECT * FROM m UNION ALL SELECT * FROM a) GROUP BY 1, 2, 3""")
def q28(t):
    e = t("entities")
    officers = F.from_json("officers", "array<struct<name: string, title: string>>")
    o = e.select(D("id").alias("target"), F.explode(officers).alias("o")).select("target", F.upper("o.name").alias("k"))
    named = e.select(D("id").alias("source"), F.upper("name").alias("k"))
    members = o.join(named, "k").where("source != target").select("source", "target", F.lit("MEMBER_OF").alias("kind"), F.lit(0.95).alias("confidence"))
    x = e.select(D("id").alias("source"), F.upper(F.trim("registered_agent")).alias("k"))
    y = e.select(D("id").alias("target"), F.upper(F.trim("name")).alias("k"))
    agents = x.join(y, "k").where("source != target").select("source", "target", F.lit("REGISTERED_WITH").alias("kind"), F.lit(0.90).alias("confidence"))
    return K.merge_max(members, agents, ["source", "target", "kind"], "confidence")


@query("q29_chunks")
def q29(t):
    return chunk(t("documents"), target=120, most=160)


@query("q30_cached_embeddings")
def q30(t):
    chunks = chunk(t("documents"))
    cached = t("ordinance_embeddings").select("content_hash")
    return new_texts(chunks, cached).select("content_hash", hash_embedding(D("chunk_text")).alias("embedding"))


@query("q31_validated_output", """SELECT parcel_key FROM (SELECT *, row_number() OVER (PARTITION BY round(latitude, 6), round(longitude, 6) ORDER BY market_value DESC NULLS LAST, parcel_key) AS k FROM parcels WHERE market_value > 0 AND latitude IS NOT NULL AND longitude IS NOT NULL) WHERE k = 1 ORDER BY market_value DESC NULLS LAST, parcel_key LIMIT 15""")
def q31(t):
    p = t.parcels.where("market_value > 0 and latitude is not null and longitude is not null").withColumns({"la": F.round("latitude", 6), "lo": F.round("longitude", 6)})
    one = R.top_per_group(p, ["la", "lo"], [F.desc_nulls_last("market_value"), F.asc("parcel_key")], 1)
    return one.orderBy(F.desc_nulls_last("market_value"), "parcel_key").limit(15).select("parcel_key")


@query("q32_dashboard", "SELECT id, CASE WHEN confidence_score > 0.66 THEN 'high' WHEN confidence_score > 0.33 THEN 'medium' WHEN confidence_score IS NULL THEN 'unknown' ELSE 'low' END AS tier FROM entities")
def q32(t):
    c = D("confidence_score")
    return t("entities").select("id", F.when(c > 0.66, "high").when(c > 0.33, "medium").when(c.isNull(), "unknown").otherwise("low").alias("tier"))


@query("q33_forecast_spread", "SELECT property_type, round(stddev_samp(last_sale_price) / avg(last_sale_price) * 100, 4) AS fsd FROM parcels WHERE last_sale_price > 0 GROUP BY 1")
def q33(t):
    return VAL.spread(t.parcels.where("last_sale_price > 0"), ["property_type"], "last_sale_price")


@query("q36_address_resolution")
def q36(t):
    e = t("entities").select(D("id").cast("string").alias("k"), D("primary_address").alias("a"))
    p = t.parcels.select(D("parcel_key").alias("k"), D("property_address").alias("a"))
    best = best_similar(e, p, "k", "a", 0.7)
    return best.select(D("l").cast("long").alias("id"), D("r").alias("parcel_key"), F.round("similarity", 6).alias("similarity"))


@query("q37_registry_match")
def q37(t):
    """The registry name of the best ratio, 0.1 more if active, of at least 0.8; of equally good ones that of the least id.

    Pairs are left out only by what the ratio implies: the matching letters are at most those both names have, and what
    they leave over is at least the edit distance."""
    letters = [chr(i) for i in range(65, 91)]

    def sized(df, x: str):
        counts = [(F.length(x) - F.length(F.replace(D(x), F.lit(c), F.lit("")))).alias(f"{x}_{c}") for c in letters]
        out = df.select("*", F.length(x).alias(f"{x}_size"), *counts)
        return out.withColumn(f"{x}_rest", D(f"{x}_size") - sum(D(f"{x}_{c}") for c in letters))

    e = t("entities").where("name is not null").select(D("id").alias("l"), F.upper("name").alias("ln"))
    r = t("bulk_llc_records").where("name is not null").select(F.upper("name").alias("rn"), F.coalesce(F.upper("status").isin("A", "ACTIVE"), F.lit(False)).alias("active"), "id")
    left, right = sized(e.select("ln").distinct(), "ln"), sized(r.groupBy("rn", "active").agg(F.min("id").alias("r")), "rn")
    total, boost = D("ln_size") + D("rn_size"), F.when(D("active"), 0.1).otherwise(0.0)
    # a margin of 1e-6, as similarities are rounded to six places
    least = 0.8 - boost - 1e-6
    shared = sum(F.least(f"ln_{c}", f"rn_{c}") for c in [*letters, "rest"])
    possible = F.when(F.least("ln_size", "rn_size") * 2 < least * total, False).when(shared * 2 < least * total, False).otherwise(F.levenshtein("ln", "rn") <= (1 - least) * total)
    met = spread(left).crossJoin(right).where(possible).select("ln", "rn", "active", "r")
    ratio = F.least(X.matching_ratio(D("ln"), D("rn")) + boost, F.lit(1.0))
    best = best_match(met.withColumn("similarity", F.round(ratio, 6)).where("similarity >= 0.8").select("ln", "r", "similarity"), "ln")
    return e.join(best, "ln").select("l", "r", "similarity")


@query("u05_capped_output", "SELECT parcel_key FROM parcels WHERE owner_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY owner_name ORDER BY market_value DESC NULLS LAST, last_sale_date DESC NULLS LAST, parcel_key) <= 1")
def u05(t):
    return owner_cap(t.parcels.where("owner_name is not null"), "owner_name", 1, "market_value_recent").select("parcel_key")


@query("s04_typed_mapping", "SELECT id, CAST(market_value AS DOUBLE) AS value, has_pool AS pool FROM bulk_property_records")
def s04(t):
    raw = t("bulk_property_records").select(D("id").cast("string").alias("ID"), F.concat(F.lit("$"), D("market_value").cast("string")).alias("Value"), D("has_pool").cast("string").alias("Pool"))
    return S.typed(raw, {"id": ("ID", "bigint"), "value": ("Value", "double"), "pool": ("Pool", "boolean")})


@query("s05_corporate_records", "SELECT nullif(trim(substr(document_number, 1, 12)), '') AS document_number, nullif(trim(substr(name, 1, 146)), '') AS name, filing_date FROM bulk_llc_records", dates="filing_date")
def s05(t):
    r = t("bulk_llc_records")
    line = F.concat(F.rpad(F.coalesce("document_number", F.lit("")), 12, " "), F.rpad(F.coalesce("name", F.lit("")), 146, " "), F.lit(" " * 302), F.lit("  "), F.coalesce(F.date_format("filing_date", "MMddyyyy"), F.lit("")))
    return S.parse_corporate(r.select(line.alias("value"))).select("document_number", "name", "filing_date")


@query("s06_event_records", "SELECT CAST(entity_id AS VARCHAR) AS document_number, lpad(CAST(event_id % 1000000 AS VARCHAR), 6, '0') AS sequence, nullif(trim(event_code), '') AS code, effective_date AS event_date FROM entity_status_events", dates="event_date")
def s06(t):
    e = t("entity_status_events")
    line = F.concat(F.rpad(D("entity_id").cast("string"), 12, " "), F.lpad((D("event_id") % 1000000).cast("string"), 6, "0"), F.rpad(F.coalesce("event_code", F.lit("")), 14, " "), F.lit(" " * 41), F.lit(" "), F.coalesce(F.date_format("effective_date", "MMddyyyy"), F.lit("")))
    return S.parse_events(e.select(line.alias("value"))).select("document_number", "sequence", "code", "event_date")


@query("s08_incident_json", "SELECT id, incident_type, incident_address AS address, latitude, longitude FROM crime_reports")
def s08(t):
    c = t("crime_reports")
    flat = F.struct("id", D("incident_type").alias("narrative"), D("incident_address").alias("address"), "latitude", "longitude")
    nested = F.struct("id", D("incident_type").alias("narrative"), D("incident_address").alias("address"), F.struct("latitude", "longitude").alias("location_1"))
    point = F.struct("id", D("incident_type").alias("narrative"), D("incident_address").alias("address"), F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("location"))
    raw = c.select(F.when(D("id") % 3 == 0, F.to_json(flat)).when(D("id") % 3 == 1, F.to_json(nested)).otherwise(F.to_json(point)).alias("value"))
    return S.parse_incidents(raw)


@query("s11_features", "SELECT zoning_code AS code, len(ring) AS points FROM bulk_gis_zoning")
def s11(t):
    z = t("bulk_gis_zoning").select(F.struct(F.struct(D("zoning_code").alias("ZONE")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("ring", lambda v: F.array(v["lon"], v["lat"]))).alias("coordinates")).alias("geometry")).alias("f"))
    raw = z.select(F.to_json(F.struct(F.array("f").alias("features"))).alias("value"))
    return S.parse_features(raw).select("code", F.size("ring").cast("long").alias("points"))


@query("s13_matrix", "SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def s13(t):
    row = F.array("n_name", D("n_regionkey").cast("string"))
    raw = t("nation").groupBy("n_regionkey").agg(F.collect_list(row).alias("r")).select(F.to_json(F.concat(F.array(F.array(F.lit("name"), F.lit("region"))), "r")).alias("value"))
    return S.parse_matrix(raw).select(D("record")["name"].alias("name"), D("record")["region"].alias("region"))


@query("s10_feed", "SELECT CAST(event_id AS VARCHAR) AS title, event_type AS summary FROM events")
def s10(t):
    e = t("events")
    item = F.concat(F.lit("<rss><channel><item><title>"), D("event_id").cast("string"), F.lit("</title><link>x</link><pubDate>d</pubDate><description>"), "event_type", F.lit("</description></item></channel></rss>"))
    return S.parse_feed(e.select(item.alias("value"))).select("title", "summary")


@query("s16_bound_parameters", "SELECT parcel_key FROM parcels WHERE city = 'Lake Hartarham' AND market_value > 200000")
def s16(t):
    return S.bound(t.spark, "SELECT parcel_key FROM {p} WHERE city = :city AND market_value > :least", {"city": "Lake Hartarham", "least": 200000}, p=t.parcels)


@query("ext_cube", "SELECT market_id, property_type, count(*) AS n FROM parcels GROUP BY CUBE (market_id, property_type)")
def ext_cube(t):
    return t.parcels.cube("market_id", "property_type").agg(R.n())


@query("ext_set_operations", "(SELECT city FROM parcels INTERSECT SELECT city FROM ordinance_embeddings) UNION (SELECT city FROM parcels EXCEPT SELECT city FROM ordinance_embeddings)")
def ext_sets(t):
    p, o = t.parcels.select("city"), t("ordinance_embeddings").select("city")
    return p.intersect(o).union(p.exceptAll(o).distinct()).distinct()


