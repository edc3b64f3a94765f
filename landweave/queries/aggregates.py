"""Aggregations (A), window-like operators (W), sorts (T) and set operations (U)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landweave.functions import text as X
from landweave.operators import rollups as R
from landweave.queries.base import PERMIT_DATE, REPORT_DATE, ROLL_DATE, Registry

reg = Registry()
query = reg.query
D = F.col


def day(s: str) -> Column:
    return F.lit(s).cast("date")


@query("a01_totals_by_type", "SELECT property_type, count(*) AS n, sum(CAST(market_value AS DECIMAL(18,2))) AS total, min(market_value) AS low, max(market_value) AS high FROM parcels GROUP BY 1")
def a01(t):
    return t.parcels.groupBy("property_type").agg(R.n(), R.total("market_value", "total"), F.min("market_value").alias("low"), F.max("market_value").alias("high"))


@query("a02_distinct_owners", "SELECT city, count(DISTINCT owner_name) AS owners, count(DISTINCT property_type) AS types FROM parcels GROUP BY 1")
def a02(t):
    return t.parcels.groupBy("city").agg(F.count_distinct("owner_name").alias("owners"), F.count_distinct("property_type").alias("types"))


@query("a03_conditional_counts", "SELECT city, count(CASE WHEN has_pool THEN 1 END) AS pools, count(CASE WHEN property_type = 'VACANT' THEN 1 END) AS vacant, sum(CASE WHEN sale_qualified = 'Q' THEN CAST(last_sale_price AS DECIMAL(18,2)) END) AS qualified_sales FROM parcels GROUP BY 1")
def a03(t):
    return t.parcels.groupBy("city").agg(F.count_if("has_pool").alias("pools"), F.count_if(D("property_type") == "VACANT").alias("vacant"), F.sum(F.when(D("sale_qualified") == "Q", R.money("last_sale_price"))).alias("qualified_sales"))


@query("a04_filtered_counts", "SELECT status, count(*) FILTER (WHERE work_type = 'F') AS done, count(*) FILTER (WHERE project_value > 30000) AS large, sum(project_value) FILTER (WHERE work_type = 'O') AS open_value FROM permits GROUP BY 1")
def a04(t):
    p = t.permits.withColumn("_f", D("work_type") == "F")
    return p.groupBy("status").agg(F.count_if("_f").alias("done"), F.count_if(D("project_value") > 30000).alias("large"), F.sum(F.when(D("work_type") == "O", D("project_value"))).alias("open_value"))


@query("a05_percentiles", "SELECT property_type, round(quantile_cont(market_value, 0.25), 4) AS p25, round(quantile_cont(market_value, 0.5), 4) AS p50, round(quantile_cont(market_value, 0.75), 4) AS p75, round(quantile_cont(market_value, 0.9), 4) AS p90 FROM parcels GROUP BY 1")
def a05(t):
    return R.percentiles(t.parcels, ["property_type"], "market_value", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})


@query("a06_mode", "SELECT contractor_id, permit_type AS usual_type FROM (SELECT contractor_id, permit_type, count(*) AS n FROM permits GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY contractor_id ORDER BY n DESC, permit_type) = 1")
def a06(t):
    return R.most_frequent(t.permits, ["contractor_id"], "permit_type", "usual_type")


@query("a07_any_active", "SELECT source_entity_id, bool_or(is_active) AS active, bool_and(is_active) AS all_active FROM entity_relationships GROUP BY 1")
def a07(t):
    return t("entity_relationships").groupBy("source_entity_id").agg(F.bool_or("is_active").alias("active"), F.bool_and("is_active").alias("all_active"))


@query("a08_arrays", "SELECT source_entity_id, list_sort(list(DISTINCT relationship_type)) AS kinds, list_sort(list(id)) AS ids, list_sort(coalesce(list(id) FILTER (WHERE is_active), [])) AS active_ids FROM entity_relationships GROUP BY 1")
def a08(t):
    r = t("entity_relationships").groupBy("source_entity_id")
    return r.agg(F.array_sort(F.collect_set("relationship_type")).alias("kinds"), F.array_sort(F.collect_list("id")).alias("ids"), F.array_sort(F.collect_list(F.when(D("is_active"), D("id")))).alias("active_ids"))


@query("a09_joined_text", "SELECT owner_name, string_agg(DISTINCT property_type, '|' ORDER BY property_type) AS types FROM parcels WHERE owner_name IS NOT NULL GROUP BY 1")
def a09(t):
    return t.parcels.where("owner_name is not null").groupBy("owner_name").agg(F.array_join(F.array_sort(F.collect_set("property_type")), "|").alias("types")).withColumn("types", F.nullif("types", F.lit("")))


@query("a10_objects", """SELECT contractor_id, list(permit_type || ':' || n ORDER BY n DESC, permit_type) AS types FROM (SELECT contractor_id, permit_type, count(*) AS n FROM permits GROUP BY 1, 2) GROUP BY 1""")
def a10(t):
    by = t.permits.groupBy("contractor_id", "permit_type").agg(R.n())
    ordered = F.array_sort(F.collect_list(F.struct((-D("n")).alias("k"), "permit_type", "n")))
    return by.groupBy("contractor_id").agg(F.transform(ordered, lambda x: F.concat_ws(":", x["permit_type"], x["n"])).alias("types"))


@query("a11_having", "SELECT owner_name, count(*) AS n FROM parcels WHERE owner_name IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
def a11(t):
    return t.parcels.where("owner_name is not null").groupBy("owner_name").agg(R.n()).where("n >= 2")


@query("a12_time_buckets", "SELECT CAST(date_trunc('month', incident_date) AS DATE) AS month, CAST(date_trunc('week', incident_date) AS DATE) AS week, year(incident_date) AS yr, count(*) AS n FROM crime_reports WHERE incident_date IS NOT NULL GROUP BY 1, 2, 3", dates="month week")
def a12(t):
    i = t("crime_reports").where("incident_date is not null")
    return i.groupBy(F.date_trunc("month", "incident_date").cast("date").alias("month"), F.date_trunc("week", "incident_date").cast("date").alias("week"), F.year("incident_date").alias("yr")).agg(R.n())


@query("a13_discovery", """SELECT o.owner_name, e.entities, count(*) AS properties, sum(CAST(o.market_value AS DECIMAL(18,2))) AS total_value FROM parcels o
JOIN (SELECT upper(trim(name)) AS k, count(*) AS entities FROM entities GROUP BY 1) e ON e.k = upper(trim(o.owner_name)) GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY properties DESC, total_value DESC NULLS LAST, owner_name LIMIT 20""")
def a13(t):
    return R.discovery(t.parcels, t("entities"), least=2, limit=20)


@query("a14_deep_dive", """WITH f AS (SELECT * FROM parcels WHERE owner_name = 'STATE TRANSPORTATION LAND RESERVE')
SELECT 'type' AS facet, property_type AS bucket, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'city', city, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'zoning', land_zoning_code, count(*) FROM f GROUP BY 2
UNION ALL SELECT 'year', CAST(year(last_sale_date) AS VARCHAR), count(*) FROM f GROUP BY 2 UNION ALL SELECT 'month', strftime(last_sale_date, '%Y-%m'), count(*) FROM f WHERE last_sale_date >= DATE '2023-12-01' GROUP BY 2""")
def a14(t):
    return R.facets(t.parcels.where(D("owner_name") == "STATE TRANSPORTATION LAND RESERVE"), day(ROLL_DATE))


@query("a15_portfolio_rollup", """SELECT owner_id, city_id, count(*) AS properties, sum(market_value) AS total_value, list_sort(list(parcel_id)) AS ids, min(sale_date) AS first_activity, max(sale_date) AS last_activity FROM holdings GROUP BY 1, 2""", dates="first_activity last_activity")
def a15(t):
    return R.portfolio(t.holdings, ["owner_id", "city_id"])


@query("a16_market_overview", "SELECT market_id, count(*) AS parcels, count(DISTINCT owner_name) AS owners, sum(CAST(market_value AS DECIMAL(18,2))) AS value, CAST(sum(CAST(market_value AS DECIMAL(18,2))) AS DOUBLE) / count(market_value) AS mean_value, count(CASE WHEN last_sale_date >= DATE '2023-12-01' THEN 1 END) AS recent_sales FROM parcels GROUP BY 1")
def a16(t):
    return R.market_overview(t.parcels, day(ROLL_DATE), 366)


@query("a17_supply", """SELECT a.*, p.p50 FROM (SELECT market_id, property_type, count(*) AS n, CAST(sum(CAST(market_value AS DECIMAL(18,2))) AS DOUBLE) / count(market_value) AS mean_value FROM parcels GROUP BY 1, 2) a
JOIN (SELECT market_id, round(quantile_cont(market_value, 0.5), 4) AS p50 FROM parcels GROUP BY 1) p USING (market_id)""")
def a17(t):
    by = t.parcels.groupBy("market_id", "property_type").agg(R.n(), R.mean("market_value", "mean_value"))
    return by.join(R.percentiles(t.parcels, ["market_id"], "market_value", {"p50": 0.5}), "market_id")


@query("a18_demand", """SELECT market_id, count(*) AS sales, CAST(sum(CAST(market_value AS DECIMAL(18,2))) AS DOUBLE) / count(market_value) AS now_mean, CAST(sum(CAST(last_sale_price AS DECIMAL(18,2))) AS DOUBLE) / count(last_sale_price) AS sale_mean,
round((CAST(sum(CAST(market_value AS DECIMAL(18,2))) AS DOUBLE) / count(market_value) - CAST(sum(CAST(last_sale_price AS DECIMAL(18,2))) AS DOUBLE) / count(last_sale_price)) / nullif(CAST(sum(CAST(last_sale_price AS DECIMAL(18,2))) AS DOUBLE) / count(last_sale_price), 0) * 100, 6) AS appreciation
FROM parcels WHERE last_sale_date >= DATE '2014-12-01' AND last_sale_price > 0 GROUP BY 1""")
def a18(t):
    return R.demand(t.parcels.where((D("last_sale_date") >= day("2014-12-01")) & (D("last_sale_price") > 0)), ["market_id"])


@query("a19_competition", """WITH b AS (SELECT market_id, owner_name, count(*) AS bought FROM parcels WHERE owner_name IS NOT NULL AND last_sale_date >= DATE '2019-12-01' GROUP BY 1, 2),
m AS (SELECT market_id, count(*) AS total FROM parcels WHERE last_sale_date >= DATE '2019-12-01' GROUP BY 1)
SELECT b.market_id, owner_name, bought, round(100.0 * bought / total, 6) AS share FROM b JOIN m USING (market_id) QUALIFY row_number() OVER (PARTITION BY b.market_id ORDER BY bought DESC, owner_name) <= 10""")
def a19(t):
    return R.active_buyers(t.parcels.where(D("last_sale_date") >= day("2019-12-01")), top=10)


@query("a20_geographic_focus", """WITH g AS (SELECT owner_id, CASE WHEN city_id < 8 THEN 'NORTH' WHEN city_id < 16 THEN 'SOUTH' ELSE 'OTHER' END AS area, count(*) AS n FROM holdings GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY n DESC, area) AS k, sum(n) OVER (PARTITION BY owner_id) AS total FROM g)
SELECT owner_id, area, n, round(n * 1.0 / total, 6) AS concentration FROM r WHERE k <= 3""")
def a20(t):
    area = F.when(D("city_id") < 8, "NORTH").when(D("city_id") < 16, "SOUTH").otherwise("OTHER")
    return R.focus(t.holdings.withColumn("area", area), "owner_id", "area", top=3)


@query("a21_monthly_velocity", """SELECT market_id, CAST(date_trunc('month', last_sale_date) AS DATE) AS month, count(*) AS sales, sum(CAST(last_sale_price AS DECIMAL(18,2))) AS volume FROM parcels WHERE last_sale_date IS NOT NULL GROUP BY 1, 2""", dates="month")
def a21(t):
    return t.parcels.where("last_sale_date is not null").groupBy("market_id", F.date_trunc("month", "last_sale_date").cast("date").alias("month")).agg(R.n("sales"), R.total("last_sale_price", "volume"))


@query("a21_city_hotspots", """SELECT city, count(*) AS n, count(CASE WHEN last_sale_date >= DATE '2022-12-01' THEN 1 END) AS recent FROM parcels GROUP BY 1 HAVING count(CASE WHEN last_sale_date >= DATE '2022-12-01' THEN 1 END) >= 3 ORDER BY recent DESC, city LIMIT 10""")
def a21b(t):
    return t.parcels.groupBy("city").agg(R.n(), F.count_if(D("last_sale_date") >= day("2022-12-01")).alias("recent")).where("recent >= 3").orderBy(F.desc("recent"), "city").limit(10)


@query("a22_pipeline", """SELECT permit_type, count(*) AS permits, sum(project_value) AS value, count(CASE WHEN status = 'A' THEN 1 END) AS active, count(CASE WHEN status = 'N' THEN 1 END) AS issued, count(CASE WHEN work_type = 'F' THEN 1 END) AS completed FROM permits WHERE applied >= DATE '2000-08-01' GROUP BY 1""")
def a22(t):
    return t.permits.where(D("applied") >= day("2000-08-01")).groupBy("permit_type").agg(R.n("permits"), F.sum("project_value").alias("value"), F.count_if(D("status") == "A").alias("active"), F.count_if(D("status") == "N").alias("issued"), F.count_if(D("work_type") == "F").alias("completed"))


@query("a23_incident_trend", """WITH c AS (SELECT market_id, count(CASE WHEN incident_date >= TIMESTAMP '2024-07-05' THEN 1 END) AS recent, count(CASE WHEN incident_date < TIMESTAMP '2024-07-05' THEN 1 END) AS prior,
count(CASE WHEN incident_date >= TIMESTAMP '2024-07-05' AND incident_type IN ('ASSAULT', 'ROBBERY') THEN 1 END) AS violent FROM crime_reports WHERE incident_date >= TIMESTAMP '2024-01-07' AND incident_date < TIMESTAMP '2025-01-01' GROUP BY 1)
SELECT market_id, recent, prior, violent, round(100.0 * (recent - prior) / nullif(prior, 0), 6) AS change, round(1.0 * violent / nullif(recent, 0), 6) AS violent_share FROM c""")
def a23(t):
    return R.incident_trend(t("crime_reports"), day(REPORT_DATE), 180, ["ASSAULT", "ROBBERY"])


@query("a23_top_types", """SELECT market_id, incident_type, n FROM (SELECT market_id, incident_type, count(*) AS n FROM crime_reports WHERE incident_type IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY n DESC, incident_type) <= 5""")
def a23b(t):
    return R.top_per_group(t("crime_reports").where("incident_type is not null").groupBy("market_id", "incident_type").agg(R.n()), ["market_id"], [F.desc("n"), F.asc("incident_type")], 5)


WORDS = {"zoning": ["zoning", "rezon"], "permits": ["permit"], "housing": ["housing", "home"], "traffic": ["traffic", "parking", "road"], "water": ["flood", "water", "sewer"]}


@query("a24_topic_sentiment", "WITH x AS (SELECT market_id, lower(text) AS l, length(text) AS n FROM documents WHERE doc_type IN ('news_article', 'council_minutes')) SELECT market_id, " + ", ".join(f"count(CASE WHEN n >= 20 AND ({' OR '.join(f'contains(l, {w!r})' for w in ws)}) THEN 1 END) AS {k}" for k, ws in WORDS.items()) + " FROM x GROUP BY 1")
def a24(t):
    d = t("documents").where(D("doc_type").isin("news_article", "council_minutes")).select("market_id", X.topics(D("text"), WORDS).alias("topics"))
    return d.groupBy("market_id").agg(*[F.count_if(F.array_contains("topics", k)).alias(k) for k in WORDS])


@query("a25_permit_velocity", """WITH m AS (SELECT CAST(date_trunc('month', applied) AS DATE) AS month, permit_type, count(*) AS n FROM permits GROUP BY 1, 2), u AS (SELECT month, permit_type AS usual_type FROM m QUALIFY row_number() OVER (PARTITION BY month ORDER BY n DESC, permit_type) = 1)
SELECT p.month, permits, contractors, usual_type FROM (SELECT CAST(date_trunc('month', applied) AS DATE) AS month, count(*) AS permits, count(DISTINCT contractor_id) AS contractors FROM permits GROUP BY 1) p JOIN u USING (month)""", dates="month")
def a25(t):
    p = t.permits.withColumn("month", F.date_trunc("month", "applied").cast("date"))
    return p.groupBy("month").agg(R.n("permits"), F.count_distinct("contractor_id").alias("contractors")).join(R.most_frequent(p, ["month"], "permit_type", "usual_type"), "month")


@query("a26_developers", """WITH c AS (SELECT applicant_id, count(*) AS permits, sum(project_value) AS value FROM permits GROUP BY 1 ORDER BY permits DESC, applicant_id LIMIT 10),
k AS (SELECT p.*, row_number() OVER (PARTITION BY applicant_id ORDER BY applied DESC, parcel_id, line, part_id, contractor_id, project_value) AS r FROM permits p JOIN c USING (applicant_id))
SELECT c.applicant_id, permits, value, list(k.parcel_id || ':' || k.permit_type ORDER BY r) AS latest FROM c JOIN k USING (applicant_id) WHERE r <= 3 GROUP BY 1, 2, 3""")
def a26(t):
    return R.top_developers(t.permits, top=10, latest=3)


@query("a27_contractors", """WITH c AS (SELECT contractor_id, count(*) AS permits, count(CASE WHEN work_type = 'F' THEN 1 END) AS completed, sum(date_diff('day', applied, finished)) AS days, count(finished) AS timed FROM permits GROUP BY 1)
SELECT contractor_id, permits, round(1.0 * completed / permits, 6) AS completion_rate, days * 1.0 / nullif(timed, 0) AS mean_days, CASE WHEN permits >= 50 THEN 'expert' WHEN permits >= 20 THEN 'experienced' WHEN permits >= 5 THEN 'established' ELSE 'new' END AS experience FROM c""")
def a27(t):
    return R.contractor_performance(t.permits)


@query("a28_applicants", "SELECT applicant_id, count(*) AS permits, count(CASE WHEN status = 'A' THEN 1 END) AS active, sum(project_value) AS value, max(applied) AS last_applied FROM permits GROUP BY 1", dates="last_applied")
def a28(t):
    return t.permits.groupBy("applicant_id").agg(R.n("permits"), F.count_if(D("status") == "A").alias("active"), F.sum("project_value").alias("value"), F.max("applied").alias("last_applied"))


@query("a29_cross_market", "SELECT owner_name, count(DISTINCT market_id) AS markets, count(DISTINCT market_id) > 1 AS multi_market, year(max(last_sale_date)) - year(min(last_sale_date)) AS span_years, bool_or(property_type = 'COMMERCIAL') AS commercial FROM parcels WHERE owner_name IS NOT NULL GROUP BY 1")
def a29(t):
    p = t.parcels.where("owner_name is not null").groupBy("owner_name")
    m = F.count_distinct("market_id")
    return p.agg(m.alias("markets"), (m > 1).alias("multi_market"), (F.year(F.max("last_sale_date")) - F.year(F.min("last_sale_date"))).alias("span_years"), F.bool_or(D("property_type") == "COMMERCIAL").alias("commercial"))


@query("a30_absorption", """WITH c AS (SELECT market_id, property_type, count(*) AS inventory, count(CASE WHEN last_sale_date >= DATE '2022-12-02' THEN 1 END) AS full_, count(CASE WHEN last_sale_date >= DATE '2023-12-02' THEN 1 END) AS half_ FROM parcels GROUP BY 1, 2),
f AS (SELECT *, full_ * 1.0 / inventory * 100 * (CAST(365 AS DOUBLE) / 730) AS fr, half_ * 1.0 / inventory * 100 * (CAST(365 AS DOUBLE) / 730) * 2 AS hr, inventory / nullif(half_ / (CAST(365 AS DOUBLE) / 30), 0) AS mo FROM c)
SELECT market_id, property_type, inventory, full_ AS full_sales, half_ AS half_sales, round(fr, 1) AS full_rate, round(hr, 1) AS half_rate, round(mo, 1) AS months, CASE WHEN mo < 15 THEN 'fast' WHEN mo <= 20 THEN 'balanced' WHEN mo > 20 THEN 'slow' END AS market_class,
CASE WHEN abs(hr - fr) < 2 THEN 'stable' WHEN hr > fr THEN 'rising' ELSE 'falling' END AS trend FROM f""")
def a30(t):
    return R.absorption(t.parcels, ["market_id", "property_type"], day(ROLL_DATE), 730)


@query("a31_hourly_metrics", """WITH x AS (SELECT *, ((event_id * 37) % 1000) / CAST(1000 AS DOUBLE) AS confidence FROM events)
SELECT date_trunc('hour', ts) AS hour_start, event_type, count(*) AS n, count(*) FILTER (WHERE confidence >= 0.85) AS high, count(*) FILTER (WHERE confidence >= 0.6 AND confidence < 0.85) AS medium, count(*) FILTER (WHERE confidence < 0.6) AS low FROM x GROUP BY 1, 2""")
def a31(t):
    e = t("events").withColumn("confidence", ((D("event_id") * 37) % 1000) / F.lit(1000.0))
    return R.hourly_metrics(e, "ts", "event_type", "confidence")


@query("a32_weekly_summary", """WITH x AS (SELECT *, ((event_id * 37) % 1000) / CAST(1000 AS DOUBLE) AS confidence FROM events WHERE ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31')
SELECT count(*) AS decisions, round(100.0 * count(*) FILTER (WHERE confidence >= 0.85) / count(*), 6) AS high_pct, round(100.0 * count(*) FILTER (WHERE confidence >= 0.6 AND confidence < 0.85) / count(*), 6) AS medium_pct, round(100.0 * count(*) FILTER (WHERE confidence < 0.6) / count(*), 6) AS low_pct FROM x""")
def a32(t):
    e = t("events").where("ts >= timestamp_ntz'2024-01-24' and ts < timestamp_ntz'2024-01-31'").withColumn("c", ((D("event_id") * 37) % 1000) / F.lit(1000.0))
    return e.agg(R.n("decisions"), *[F.round(F.lit(100.0) * F.count_if(b) / F.count(F.lit(1)), 6).alias(k) for k, b in R.bands("c", "_pct").items()])


@query("a33_improvements", """SELECT parcel_id, sum(quantity) AS square_feet, count(*) AS n, count(DISTINCT permit_type) AS kinds, min(CASE WHEN year(applied) > 0 THEN year(applied) END) AS first_year, max(year(applied)) AS last_year, bool_or(contains(permit_type, 'STEEL')) AS steel, bool_or(contains(permit_type, 'BRASS')) AS brass FROM permits GROUP BY 1""")
def a33(t):
    return R.improvements(t.permits, {"steel": "STEEL", "brass": "BRASS"})


@query("a34_latest_year", """WITH y AS (SELECT *, year(applied) AS yr, max(year(applied)) OVER (PARTITION BY parcel_id) AS last_year FROM permits)
SELECT parcel_id, last_year, sum(CASE WHEN yr = last_year THEN project_value END) AS amount, list_sort(list(DISTINCT permit_type) FILTER (WHERE yr = last_year)) AS types, count(*) AS n FROM y GROUP BY 1, 2""")
def a34(t):
    return R.latest_year_totals(t.permits, "parcel_id", F.year("applied"), "project_value", "permit_type")


@query("a35_permits_per_parcel", "SELECT parcel_id, count(*) AS total_permits FROM permits GROUP BY 1")
def a35(t):
    return t.permits.groupBy("parcel_id").agg(R.n("total_permits"))


@query("a36_summary", "SELECT count(*) AS parcels, count(DISTINCT owner_name) AS owners, round(100.0 * count(CASE WHEN contains(upper(owner_name), 'LLC') THEN 1 END) / count(*), 6) AS llc_share, sum(CAST(market_value AS DECIMAL(18,2))) AS value FROM parcels")
def a36(t):
    return t.parcels.agg(R.n("parcels"), F.count_distinct("owner_name").alias("owners"), F.round(F.lit(100.0) * F.count_if(F.upper("owner_name").contains("LLC")) / F.count(F.lit(1)), 6).alias("llc_share"), R.total("market_value", "value"))


@query("a37_agent_services", "SELECT upper(trim(registered_agent)) AS agent, count(DISTINCT id) AS entities FROM entities WHERE registered_agent IS NOT NULL AND trim(registered_agent) <> '' GROUP BY 1 HAVING count(DISTINCT id) >= 3")
def a37(t):
    return R.agent_services(t("entities"), least=3)


@query("a38_completeness", """SELECT source, count(*) AS n, round(100.0 * count(text) / count(*), 6) AS text_pct, round(100.0 * count(market_id) / count(*), 6) AS market_pct, round(100.0 * count(published_date) / count(*), 6) AS date_pct, count(text) - count(DISTINCT text) AS duplicates FROM documents GROUP BY 1""")
def a38(t):
    return R.completeness(t("documents"), "source", {"text_pct": "text", "market_pct": "market_id", "date_pct": "published_date"}, "text")


@query("a39_processing_status", "SELECT relationship_type, count(*) AS n, round(100.0 * count(*) FILTER (WHERE is_active) / count(*), 6) AS pct FROM entity_relationships GROUP BY 1")
def a39(t):
    return t("entity_relationships").groupBy("relationship_type").agg(R.n(), F.round(F.lit(100.0) * F.count_if("is_active") / F.count(F.lit(1)), 6).alias("pct"))


@query("a40_cache_stats", "SELECT count(*) AS entries, count(DISTINCT content_hash) AS distinct_hashes, count(*) - count(DISTINCT content_hash) AS hits, count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-06-01') AS fresh FROM ordinance_embeddings")
def a40(t):
    e = t("ordinance_embeddings")
    return e.agg(R.n("entries"), F.count_distinct("content_hash").alias("distinct_hashes"), (F.count(F.lit(1)) - F.count_distinct("content_hash")).alias("hits"), F.count_if(D("created_at") >= F.expr("timestamp_ntz'2024-06-01'")).alias("fresh"))


@query("a42_chunks_by_city", "SELECT city, state, count(*) AS chunks, sum(chunk_words) AS words FROM ordinance_embeddings GROUP BY 1, 2")
def a42(t):
    return t("ordinance_embeddings").groupBy("city", "state").agg(R.n("chunks"), F.sum("chunk_words").alias("words"))


@query("a43_spread", "SELECT property_type, round(stddev_samp(market_value), 4) AS sd, round(stddev_samp(market_value) / avg(market_value) * 100, 4) AS cv, round(median(market_value), 4) AS median FROM parcels GROUP BY 1")
def a43(t):
    return t.parcels.groupBy("property_type").agg(F.round(F.stddev_samp("market_value"), 4).alias("sd"), F.round(F.stddev_samp("market_value") / F.avg("market_value") * 100, 4).alias("cv"), F.round(F.percentile("market_value", F.lit(0.5)), 4).alias("median"))


@query("a44_reputation", """WITH m AS (SELECT market_id AS subject, doc_id, published_date FROM documents WHERE market_id IS NOT NULL AND doc_type IN ('news_article', 'council_minutes') AND published_date >= DATE '2020-01-01' AND contains(lower(text), 'permit')),
r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY published_date DESC, doc_id) AS k FROM m) SELECT subject, count(*) AS mentions, list(doc_id ORDER BY k) FILTER (WHERE k <= 5) AS newest, count(*) > 10 AS frequent FROM r GROUP BY 1""")
def a44(t):
    d = t("documents").where(D("doc_type").isin("news_article", "council_minutes") & (D("published_date") >= day("2020-01-01")))
    return R.mentions(d, "market_id", "permit", newest=5, many=10)


@query("a45_value_change", """SELECT property_type, round(100.0 * count(*) / (SELECT count(*) FROM parcels), 6) AS share, CAST(sum(CAST(market_value - assessed_value AS DECIMAL(18,2))) AS DOUBLE) / count(market_value - assessed_value) AS mean_change, count(CASE WHEN upper(owner_name) LIKE 'STAN%' THEN 1 END) AS prefixed FROM parcels GROUP BY 1""")
def a45(t):
    n = t.parcels.agg(F.count(F.lit(1)).alias("_all"))  # one row
    by = t.parcels.groupBy("property_type").agg(R.n("_n"), R.mean(D("market_value") - D("assessed_value"), "mean_change"), F.count_if(F.upper("owner_name").like("STAN%")).alias("prefixed"))
    return by.crossJoin(F.broadcast(n)).select("property_type", F.round(F.lit(100.0) * D("_n") / D("_all"), 6).alias("share"), "mean_change", "prefixed")


@query("a46_row_counts", " UNION ALL ".join(f"SELECT '{x}' AS name, count(*) AS n FROM {x}" for x in ("entities", "crime_reports", "documents", "bulk_llc_records")))
def a46(t):
    return R.row_counts({x: t(x) for x in ("entities", "crime_reports", "documents", "bulk_llc_records")})


@query("a47_unique_owners", """SELECT owner_name, count(*) AS n, max(mailing_address) AS address, max(city) AS city, list_slice(list_sort(list(DISTINCT parcel_key)), 1, 3) AS sample FROM parcels WHERE owner_name IS NOT NULL AND trim(owner_name) <> '' GROUP BY 1""")
def a47(t):
    return R.unique_owners(t.parcels)


@query("w01_dominant_type", """SELECT cx, cy, property_type, n FROM (SELECT round_even(longitude / (500 / CAST(111000 AS DOUBLE)), 0)::BIGINT AS cx, round_even(latitude / (500 / CAST(111000 AS DOUBLE)), 0)::BIGINT AS cy, property_type, count(*) AS n FROM parcels WHERE latitude BETWEEN 24 AND 50 AND longitude BETWEEN -125 AND -66 AND property_type IS NOT NULL GROUP BY 1, 2, 3)
QUALIFY row_number() OVER (PARTITION BY cx, cy ORDER BY n DESC, property_type) = 1""")
def w01(t):
    from landweave.functions.geo import grid_cell
    from landweave.operators.dual_tree import usable

    p = t.parcels.where(usable(D("latitude"), D("longitude")) & D("property_type").isNotNull())
    by = p.groupBy(grid_cell(D("longitude"), 500).alias("cx"), grid_cell(D("latitude"), 500).alias("cy"), "property_type").agg(R.n())
    return R.top_per_group(by, ["cx", "cy"], [F.desc("n"), F.asc("property_type")], 1)


@query("w02_latest_snapshot", "SELECT market_id, source_name, id, snapshot_date FROM bulk_data_snapshots WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY snapshot_date DESC, id DESC) = 1", dates="snapshot_date")
def w02(t):
    s = t("bulk_data_snapshots").where("status = 'completed'").select("market_id", "source_name", "id", "snapshot_date")
    return R.top_per_group(s, ["source_name"], [F.desc("snapshot_date"), F.desc("id")], 1)


@query("w03_top3_per_owner", """SELECT owner_id, list(parcel_id ORDER BY market_value DESC, parcel_id) AS top FROM (SELECT * FROM holdings QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY market_value DESC, parcel_id) <= 3) GROUP BY 1""")
def w03(t):
    best = R.top_per_group(t.holdings, ["owner_id"], [F.desc("market_value"), F.asc("parcel_id")], 3)
    ordered = F.array_sort(F.collect_list(F.struct((-D("market_value")).alias("k"), "parcel_id")))
    return best.groupBy("owner_id").agg(F.transform(ordered, lambda x: x["parcel_id"]).alias("top"))


@query("w04_keep_latest", "SELECT document_number, id, name FROM bulk_llc_records WHERE document_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_number ORDER BY last_event_date DESC NULLS LAST, id) = 1")
def w04(t):
    r = t("bulk_llc_records").where("document_number is not null").select("document_number", "id", "name", "last_event_date")
    return R.top_per_group(r, ["document_number"], [F.desc_nulls_last("last_event_date"), F.asc("id")], 1).drop("last_event_date")


@query("w05_lifecycle", """SELECT parcel_id, line, status FROM permits QUALIFY row_number() OVER (PARTITION BY parcel_id, line ORDER BY CASE status WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, status, applied DESC, part_id) = 1""")
def w05(t):
    return R.lifecycle_dedupe(t.permits, ["parcel_id", "line"], "status", ["R", "N"], [F.desc("applied"), F.asc("part_id")]).select("parcel_id", "line", "status")


@query("w07_street_gaps", r"""WITH s AS (SELECT DISTINCT market_id, regexp_replace(upper(property_address), '^[0-9]+ ', '') AS street, CAST(regexp_extract(property_address, '^([0-9]+) ', 1) AS INT) AS no FROM parcels WHERE regexp_matches(property_address, '^[0-9]{1,9} ')),
l AS (SELECT *, lead(no) OVER (PARTITION BY market_id, street ORDER BY no) AS nxt FROM s) SELECT market_id, street, no AS from_no, nxt AS to_no, range(no + 2, nxt, 2) AS missing FROM l WHERE nxt - no > 4""")
def w07(t):
    return R.street_gaps(t.parcels, "market_id", "property_address")


@query("w08_date_gaps", """WITH d AS (SELECT DISTINCT market_id, CAST(incident_date AS DATE) AS day FROM crime_reports WHERE incident_date IS NOT NULL), l AS (SELECT *, lag(day) OVER (PARTITION BY market_id ORDER BY day) AS before FROM d)
SELECT market_id, before AS gap_from, day AS gap_to, date_diff('day', before, day) AS days FROM l WHERE date_diff('day', before, day) > 7""", dates="gap_from gap_to")
def w08(t):
    return R.date_gaps(t("crime_reports"), "market_id", "incident_date", 7)


@query("w09_neighbour_similarity", """SELECT chunk_id, round(list_cosine_similarity(e, p), 6) AS with_previous, round(list_cosine_similarity(e, n), 6) AS with_next FROM (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS e, CAST(lag(embedding) OVER w AS DOUBLE[]) AS p, CAST(lead(embedding) OVER w AS DOUBLE[]) AS n FROM chunks WINDOW w AS (PARTITION BY ordinance_file ORDER BY chunk_number, chunk_id))""")
def w09(t):
    from landweave.functions.vector import cosine

    w = W.partitionBy("ordinance_file").orderBy("chunk_number", "chunk_id")
    x = t.chunks.select("chunk_id", "embedding", F.lag("embedding").over(w).alias("p"), F.lead("embedding").over(w).alias("n"))
    return x.select("chunk_id", F.round(cosine(D("embedding"), D("p")), 6).alias("with_previous"), F.round(cosine(D("embedding"), D("n")), 6).alias("with_next"))


ORDERS = {
    "market_value": "market_value DESC NULLS LAST",
    "recency": "last_sale_date DESC NULLS LAST",
    "lot_size": "lot_size_acres DESC NULLS LAST",
    "sale_price": "last_sale_price DESC NULLS LAST",
    "year_built": "year_built DESC NULLS LAST",
    "value_then_recency": "market_value DESC NULLS LAST, last_sale_date DESC NULLS LAST",
    "asc_nulls_last": "last_sale_price ASC NULLS LAST",
    "desc_nulls_first": "last_sale_price DESC NULLS FIRST",
}


@query("t01_named_orders", " UNION ALL ".join(f"(SELECT '{k}' AS named, parcel_key, row_number() OVER (ORDER BY {sql}, parcel_key) AS place FROM parcels ORDER BY {sql}, parcel_key LIMIT 20)" for k, sql in ORDERS.items()))
def t01(t):
    from functools import reduce

    tops = [R.top_k(t.parcels.select("parcel_key", "market_value", "last_sale_date", "lot_size_acres", "last_sale_price", "year_built"), [*R.ordering(o), F.asc("parcel_key")], 20).select(F.lit(k).alias("named"), "parcel_key", "place") for k, o in ORDERS.items()]
    return reduce(lambda a, b: a.unionByName(b), tops)


@query("t03_score_order", """SELECT parcel_key, round(0.6 * abs(market_value - 200000) / 200000 + 0.4 * date_diff('day', last_sale_date, DATE '2024-12-01') / CAST(365 AS DOUBLE), 6) AS score FROM parcels WHERE market_value IS NOT NULL AND last_sale_date IS NOT NULL ORDER BY score, parcel_key LIMIT 25""")
def t03(t):
    p = t.parcels.where("market_value is not null and last_sale_date is not null")
    score = F.round(F.lit(0.6) * F.abs(D("market_value") - 200000.0) / 200000.0 + F.lit(0.4) * F.datediff(day(ROLL_DATE), "last_sale_date") / F.lit(365.0), 6)
    return p.select("parcel_key", score.alias("score")).orderBy("score", "parcel_key").limit(25)


@query("t05_price_per_acre", "SELECT parcel_key, round(market_value / nullif(lot_size_acres, 0), 6) AS per_acre FROM parcels ORDER BY per_acre ASC NULLS LAST, parcel_key LIMIT 25")
def t05(t):
    return t.parcels.select("parcel_key", F.round(F.try_divide("market_value", "lot_size_acres"), 6).alias("per_acre")).orderBy(F.asc_nulls_last("per_acre"), "parcel_key").limit(25)


@query("t08_latest_year", "SELECT market_id, source_name, record_count FROM bulk_data_snapshots ORDER BY snapshot_date DESC NULLS LAST, id LIMIT 1")
def t08(t):
    return t("bulk_data_snapshots").orderBy(F.desc_nulls_last("snapshot_date"), "id").select("market_id", "source_name", "record_count").limit(1)


@query("u01_union_dedupe", """WITH u AS (SELECT parcel_id, line, 0 AS k, applied AS at_ FROM permits WHERE status = 'R' UNION ALL SELECT parcel_id, line, 1, applied FROM permits WHERE status = 'N' UNION ALL SELECT parcel_id, line, 2, applied FROM permits WHERE status = 'A')
SELECT parcel_id, line, min(k) AS stage, count(*) AS reports FROM u GROUP BY 1, 2""")
def u01(t):
    parts = [t.permits.where(D("status") == s).select("parcel_id", "line", F.lit(k).alias("k")) for k, s in enumerate("RNA")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("parcel_id", "line").agg(F.min("k").alias("stage"), R.n("reports"))


@query("u02_candidate_union", "SELECT id FROM entities WHERE phone IS NOT NULL UNION SELECT id FROM entities WHERE email IS NOT NULL UNION SELECT id FROM entities WHERE regexp_matches(sunbiz_document_number, '[0-9]')")
def u02(t):
    e = t("entities")
    sets = [e.where(c).select("id") for c in (D("phone").isNotNull(), D("email").isNotNull(), D("sunbiz_document_number").rlike("[0-9]"))]
    return sets[0].union(sets[1]).union(sets[2]).dropDuplicates(["id"])


@query("u03_set_overlap", """WITH o AS (SELECT market_id, list(DISTINCT property_type) FILTER (WHERE property_type IS NOT NULL) AS a, list(DISTINCT land_zoning_code) FILTER (WHERE land_zoning_code IS NOT NULL) AS z FROM parcels GROUP BY 1)
SELECT x.market_id AS m1, y.market_id AS m2, round(len(list_intersect(x.z, y.z)) * 1.0 / len(list_distinct(x.z || y.z)), 6) AS jaccard, round(len(list_intersect(x.a, y.a)) * 1.0 / least(len(x.a), len(y.a)), 6) AS overlap FROM o x JOIN o y ON x.market_id < y.market_id""")
def u03(t):
    o = t.parcels.groupBy("market_id").agg(F.collect_set("property_type").alias("a"), F.collect_set("land_zoning_code").alias("z"))
    x, y = o.toDF("m1", "a1", "z1"), o.toDF("m2", "a2", "z2")
    # one row per market
    return x.join(y, D("m1") < D("m2")).select("m1", "m2", F.round(F.size(F.array_intersect("z1", "z2")) / F.size(F.array_union("z1", "z2")), 6).alias("jaccard"), F.round(X.overlap(D("a1"), D("a2")), 6).alias("overlap"))


@query("u04_partition_fan_out", """SELECT bucket, count(*) AS n FROM (SELECT property_type AS bucket FROM parcels WHERE property_type IN ('VACANT', 'COMMERCIAL', 'CONDO', 'SINGLE FAMILY', 'MULTI FAMILY') UNION ALL SELECT 'all' FROM parcels) GROUP BY 1""")
def u04(t):
    kinds = ["VACANT", "COMMERCIAL", "CONDO", "SINGLE FAMILY", "MULTI FAMILY"]
    hit = F.when(D("property_type").isin(kinds), F.array(D("property_type"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    return t.parcels.select(F.explode(hit).alias("bucket")).groupBy("bucket").agg(R.n())
