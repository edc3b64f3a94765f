"""Scalar functions (X), each over a whole column."""

from __future__ import annotations

from pyspark.sql import functions as F

from landweave.functions import geo as G
from landweave.functions import text as X
from landweave.functions import vector as V
from landweave.operators.dual_tree import usable
from landweave.operators.rollups import n
from landweave.queries.base import Registry

reg = Registry()
query = reg.query
D = F.col


@query("x01_signature", r"SELECT parcel_key, regexp_replace(upper(owner_name), '[^\p{L}\p{N}]', '', 'g') AS v FROM parcels")
def x01(t):
    return t.parcels.select("parcel_key", X.signature(D("owner_name")).alias("v"))


@query("x02_company_name", r"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(upper(name), '[^A-Z0-9 ]', ' ', 'g'), '(^| )(THE|AN|A)( |$)', ' ', 'g'), '\s+', ' ', 'g')) AS v FROM entities")
def x02(t):
    return t("entities").select("id", X.company_name(D("name")).alias("v"))


@query("x03_legal_form", r"""SELECT id, CASE WHEN regexp_matches(u, '(^|\s)(LLC|L L C)(\s|$)') THEN 'LLC' WHEN regexp_matches(u, '(^|\s)(INC|INCORPORATED)(\s|$)') THEN 'INC' WHEN regexp_matches(u, '(^|\s)(CORP|CORPORATION)(\s|$)') THEN 'CORP' WHEN regexp_matches(u, '(^|\s)(LTD|LIMITED)(\s|$)') THEN 'LTD' END AS v FROM (SELECT id, regexp_replace(upper(name), '[.,]', '', 'g') AS u FROM entities)""")
def x03(t):
    return t("entities").select("id", X.legal_form(D("name")).alias("v"))


KINDS = [("llc", ["LLC", "L L C", "L.L.C"]), ("corporation", ["INC", "CORP"]), ("partnership", [" LP", "PARTNERSHIP"]), ("government", ["COUNTY", "CITY OF", "STATE ", "COMMISSION"])]


@query("x04_entity_type", "SELECT id, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(upper(name), {w!r})' for w in ws)} THEN '{k}'" for k, ws in KINDS) + " ELSE 'person' END AS v FROM entities")
def x04(t):
    return t("entities").select("id", X.first_match(D("name"), KINDS, "person").alias("v"))


@query("x05_person_name", r"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(upper(name), '[.,]', ' ', 'g'), '(^| )(MR|MRS|MS|DR|PROF)( |$)', ' ', 'g'), '\s+', ' ', 'g')) AS v FROM entities")
def x05(t):
    return t("entities").select("id", X.person_name(D("name")).alias("v"))


@query("x06_phone", "SELECT id, CASE WHEN length(d) = 10 THEN '+1' || d WHEN length(d) = 11 AND d LIKE '1%' THEN '+' || d ELSE d END AS v FROM (SELECT id, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM entities)")
def x06(t):
    return t("entities").select("id", X.phone(D("phone")).alias("v"))


_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in X.ADDRESS_WORDS.items()) + "}"
_WORDS = rf"list_transform(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(@), '[.,]', '', 'g'), '([0-9]+)(st|nd|rd|th)( |$)', '\1\3', 'g'), '\s+', ' ', 'g')), ' '), lambda w: coalesce({_MAP}[w], w))"


@query("x08_address_text", f"SELECT id, array_to_string({_WORDS.replace('@', 'primary_address')}, ' ') AS v FROM entities")
def x08(t):
    return t("entities").select("id", X.address_text(D("primary_address")).alias("v"))


@query("x09_house_number", "SELECT id, nullif(regexp_extract(trim(primary_address), '^([0-9]+)', 1), '') AS v FROM entities")
def x09(t):
    return t("entities").select("id", X.house_number(D("primary_address")).alias("v"))


@query("x10_address_keys", f"SELECT id, k AS v FROM (SELECT id, unnest(list_distinct([array_to_string(w, ' '), array_to_string(list_filter(w, lambda x: x NOT IN ('n', 's', 'e', 'w', 'ne', 'nw', 'se', 'sw')), ' ')])) AS k FROM (SELECT id, {_WORDS.replace('@', 'primary_address')} AS w FROM entities WHERE primary_address IS NOT NULL))")
def x10(t):
    return t("entities").where("primary_address is not null").select("id", F.explode(X.address_keys(D("primary_address"))).alias("v"))


def grams(text: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({text}) - 2, 1) + 1), lambda i: substr({text}, i, 3)))"


def word_grams(text: str) -> str:
    words = rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def jaccard(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) * 1.0 / nullif(len(list_distinct({a} || {b})), 0)"


@query("x11_text_similarity", f"SELECT id, round({jaccard('a', 'b')}, 6) AS v FROM (SELECT id, {grams(chr(39) + '  ' + chr(39) + ' || lower(principal_address) || ' + chr(39) + ' ' + chr(39))} AS a, {grams(chr(39) + '  ' + chr(39) + ' || lower(mailing_address) || ' + chr(39) + ' ' + chr(39))} AS b FROM bulk_llc_records WHERE principal_address IS NOT NULL AND mailing_address IS NOT NULL)")
def x11(t):
    r = t("bulk_llc_records").where("principal_address is not null and mailing_address is not null")
    return r.select("id", F.round(X.text_similarity(D("principal_address"), D("mailing_address")), 6).alias("v"))


@query("x12_word_similarity", f"SELECT id, round({jaccard('a', 'b')}, 6) AS v FROM (SELECT id, {word_grams('principal_address')} AS a, {word_grams('mailing_address')} AS b FROM bulk_llc_records WHERE principal_address IS NOT NULL AND mailing_address IS NOT NULL)")
def x12(t):
    r = t("bulk_llc_records").where("principal_address is not null and mailing_address is not null")
    return r.select("id", F.round(X.word_similarity(D("principal_address"), D("mailing_address")), 6).alias("v"))


@query("x13_matching_ratio")
def x13(t):
    return t("entities").select("id", F.round(X.matching_ratio(F.lower("name"), F.lower("canonical_name")), 6).alias("v"))


@query("x14_positions", "SELECT id, substr(document_number, 1, 1) AS kind, substr(document_number, 2, 2) AS yr, lpad(substr(document_number, 4), 12, '0') AS serial FROM bulk_llc_records")
def x14(t):
    return t("bulk_llc_records").select("id", F.substring("document_number", 1, 1).alias("kind"), F.substring("document_number", 2, 2).alias("yr"), F.lpad(F.expr("substring(document_number, 4)"), 12, "0").alias("serial"))


@query("x15_scan_date", "SELECT id, filing_date AS v FROM bulk_llc_records WHERE filing_date IS NOT NULL AND year(filing_date) BETWEEN 1990 AND 2030", dates="v")
def x15(t):
    raw = F.concat(F.lit("zz"), F.date_format("filing_date", "MMddyyyy"), F.lit("~~"))
    r = t("bulk_llc_records").where("filing_date is not null and year(filing_date) between 1990 and 2030")
    return r.select("id", X.scan_date(raw, 1990, 2030).alias("v"))


@query("x16_any_date", "SELECT id, filing_date AS v FROM bulk_llc_records", dates="v")
def x16(t):
    f = F.when(D("id") % 3 == 0, F.date_format("filing_date", "MM/dd/yyyy")).when(D("id") % 3 == 1, F.date_format("filing_date", "yyyy-MM-dd")).otherwise(F.concat(F.lit("/Date("), (F.unix_date("filing_date").cast("long") * 86400000).cast("string"), F.lit(")/")))
    return t("bulk_llc_records").select("id", X.any_date(f).alias("v"))


@query("x17_numbers", "SELECT parcel_key, CASE WHEN abs(market_value * 400) < 100000000 THEN round(market_value * 400, 2) END AS v FROM parcels")
def x17(t):
    raw = F.concat(F.lit("$"), F.format_number(D("market_value") * 400, 2))
    return t.parcels.select("parcel_key", F.round(X.number(raw), 2).alias("v"))


@query("x18_booleans", "SELECT parcel_key, has_pool AS v FROM parcels")
def x18(t):
    raw = F.when(D("has_pool"), F.element_at(F.array(F.lit("Yes"), F.lit("TRUE"), F.lit(" 1 ")), (D("bedrooms") % 3 + 1).cast("int"))).when(~D("has_pool"), "no")
    return t.parcels.select("parcel_key", X.boolean(F.coalesce(raw, D("has_pool").cast("string"))).alias("v"))


@query("x19_weighted_text", "SELECT doc_id, 1.0 * (CASE WHEN contains(lower(source), 'county') THEN 1 ELSE 0 END) + 0.4 * (CASE WHEN contains(lower(text), 'county') THEN 1 ELSE 0 END) AS weight FROM documents WHERE contains(lower(source), 'county') OR contains(lower(text), 'county')")
def x19(t):
    a, b = F.lower("source").contains("county"), F.lower("text").contains("county")
    return t("documents").where(a | b).select("doc_id", (F.lit(1.0) * F.coalesce(a.cast("int"), F.lit(0)) + F.lit(0.4) * F.coalesce(b.cast("int"), F.lit(0))).alias("weight"))


@query("x20_date_parts", "SELECT id, strftime(incident_date, '%Y_%m') AS ym, date_diff('day', CAST(incident_date AS DATE), CAST(reported_date AS DATE)) AS days, year(reported_date) - year(incident_date) AS years, CAST(floor(epoch(reported_date)) AS BIGINT) - CAST(floor(epoch(date_trunc('day', reported_date))) AS BIGINT) AS s FROM crime_reports")
def x20(t):
    i, r = D("incident_date"), D("reported_date")
    return t("crime_reports").select("id", F.date_format(i, "yyyy_MM").alias("ym"), F.datediff(r, i).alias("days"), (F.year(r) - F.year(i)).alias("years"), (F.hour(r) * 3600 + F.minute(r) * 60 + F.floor(F.second(r))).cast("long").alias("s"))


@query("x21_clamp", "SELECT parcel_key, round(least(greatest(market_value / 1000, 50), 500), 3) AS v, abs(assessed_value - market_value) AS d, coalesce(nullif(square_feet, 0), -1) AS sf FROM parcels")
def x21(t):
    return t.parcels.select("parcel_key", F.round(F.least(F.greatest(D("market_value") / 1000, F.lit(50.0)), F.lit(500.0)), 3).alias("v"), F.abs(D("assessed_value") - D("market_value")).alias("d"), F.coalesce(F.nullif("square_feet", F.lit(0)), F.lit(-1)).alias("sf"))


@query("x22_record_hash", """SELECT id, sha256('{"case":' || to_json(case_number) || ',"market":' || to_json(market_id) || '}') AS v FROM crime_reports WHERE case_number IS NOT NULL""")
def x22(t):
    return t("crime_reports").where("case_number is not null").select("id", X.record_hash({"market": D("market_id"), "case": D("case_number")}).alias("v"))


@query("x23_surrogate_key", "SELECT id, 'ADDR-' || substr(md5(upper(trim(primary_address))), 1, 12) AS v FROM entities")
def x23(t):
    return t("entities").select("id", X.surrogate_key("ADDR-", D("primary_address")).alias("v"))


@query("x24_json_path", "SELECT id, json_array_length(officers) AS n, json_extract_string(officers, '$[0].name') AS first_name, json_extract_string(officers, '$[0].title') AS title FROM entities WHERE officers IS NOT NULL")
def x24(t):
    e = t("entities").where("officers is not null")
    return e.select("id", F.json_array_length("officers").cast("long").alias("n"), F.get_json_object("officers", "$[0].name").alias("first_name"), F.get_json_object("officers", "$[0].title").alias("title"))


def miles(r: str, a: str, b: str, c: str, d: str) -> str:
    return f"2 * CAST({r} AS DOUBLE) * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


OK = "latitude BETWEEN 24 AND 50 AND longitude BETWEEN -125 AND -66"
LAT0, LON0 = 25.29, -76.2


@query("x25_miles", f"SELECT parcel_key, round({miles('3959', '25.29', '-76.2', 'latitude', 'longitude')}, 6) AS v FROM parcels WHERE {OK}")
def x25(t):
    return t.parcels.where(usable(D("latitude"), D("longitude"))).select("parcel_key", F.round(G.haversine_miles(F.lit(LAT0), F.lit(LON0), D("latitude"), D("longitude")), 6).alias("v"))


@query("x26_metres", f"SELECT parcel_key, round({miles('6371008.8', '25.29', '-76.2', 'latitude', 'longitude')}, 3) AS v FROM parcels WHERE {OK}")
def x26(t):
    return t.parcels.where(usable(D("latitude"), D("longitude"))).select("parcel_key", F.round(G.haversine_m(F.lit(LAT0), F.lit(LON0), D("latitude"), D("longitude")), 3).alias("v"))


@query("x27_grid_cell", f"SELECT parcel_key, CAST(round_even(longitude / (500 / CAST(111000 AS DOUBLE)), 0) AS BIGINT) AS cx, CAST(round_even(latitude / (500 / CAST(111000 AS DOUBLE)), 0) AS BIGINT) AS cy FROM parcels WHERE {OK}")
def x27(t):
    return t.parcels.where(usable(D("latitude"), D("longitude"))).select("parcel_key", G.grid_cell(D("longitude"), 500).alias("cx"), G.grid_cell(D("latitude"), 500).alias("cy"))


@query("x28_adaptive_cell", f"SELECT parcel_key, round(floor(latitude / s) * s, 4) AS clat, round(floor(longitude / (s / cos(radians(latitude)))) * (s / cos(radians(latitude))), 4) AS clon FROM (SELECT *, 0.5 / CAST(69 AS DOUBLE) AS s FROM parcels WHERE {OK})")
def x28(t):
    lat, lon = G.adaptive_cell(D("latitude"), D("longitude"), 0.5)
    return t.parcels.where(usable(D("latitude"), D("longitude"))).select("parcel_key", lat.alias("clat"), lon.alias("clon"))


@query("x30_centroid", f"SELECT city, round(avg(latitude), 6) AS lat, round(avg(longitude), 6) AS lon FROM parcels WHERE {OK} GROUP BY 1")
def x30(t):
    return t.parcels.where(usable(D("latitude"), D("longitude"))).groupBy("city").agg(F.round(F.avg("latitude"), 6).alias("lat"), F.round(F.avg("longitude"), 6).alias("lon"))


@query("x31_box", f"SELECT parcel_key FROM parcels WHERE {OK} AND latitude BETWEEN 25.29 - 1.2 * 0.5 / CAST(69 AS DOUBLE) AND 25.29 + 1.2 * 0.5 / CAST(69 AS DOUBLE) AND longitude BETWEEN -76.2 - 0.5 * 1.2 / (69 * cos(radians(25.29))) AND -76.2 + 0.5 * 1.2 / (69 * cos(radians(25.29)))")
def x31(t):
    return t.parcels.where(usable(D("latitude"), D("longitude")) & G.in_box(D("latitude"), D("longitude"), LAT0, LON0, 0.5)).select("parcel_key")


@query("x32_points", "SELECT parcel_key, longitude AS x, latitude AS y, latitude IS NOT NULL AND longitude IS NOT NULL AS placed FROM parcels")
def x32(t):
    x, y = G.wkt_xy(G.wkt_point(D("latitude"), D("longitude")))
    return t.parcels.select("parcel_key", F.when(D("latitude").isNull(), D("longitude")).otherwise(x).alias("x"), F.when(D("longitude").isNull(), D("latitude")).otherwise(y).alias("y"), G.wkt_point(D("latitude"), D("longitude")).isNotNull().alias("placed"))


@query("x33_cosine_top", """SELECT chunk_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM chunks ORDER BY chunk_id LIMIT 1)), 6) AS v FROM chunks ORDER BY v DESC, chunk_id LIMIT 10""")
def x33(t):
    q = t.chunks.orderBy("chunk_id").limit(1).select(D("embedding").alias("_q"))
    return t.chunks.crossJoin(F.broadcast(q)).select("chunk_id", F.round(V.cosine(D("embedding"), D("_q")), 6).alias("v")).orderBy(F.desc("v"), "chunk_id").limit(10)


@query("x34_dot_top", """SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS v FROM embeddings WHERE vec_id <> 0 ORDER BY v DESC, vec_id LIMIT 10""")
def x34(t):
    q = t("embeddings").where("vec_id = 0").select(D("embedding").alias("_q"))
    return t("embeddings").where("vec_id != 0").crossJoin(F.broadcast(q)).select("vec_id", F.round(V.dot(D("embedding"), D("_q")), 6).alias("v")).orderBy(F.desc("v"), "vec_id").limit(10)


@query("x35_relevance", "SELECT doc_id, CASE WHEN contains(upper(text), 'CEMETERY') THEN 'none' WHEN contains(upper(text), 'REZONING') OR contains(upper(text), 'SITE PLAN') THEN 'high' WHEN contains(upper(text), 'PERMIT') THEN 'medium' ELSE 'low' END AS v FROM documents")
def x35(t):
    return t("documents").select("doc_id", X.relevance(D("text"), ["CEMETERY"], ["REZONING", "SITE PLAN"], ["PERMIT"]).alias("v"))


CODES = [("annual_report", ["ANN"]), ("dissolution", ["DIS"]), ("reinstatement", ["REIN"]), ("amendment", ["AMEND"])]


@query("x36_event_type", "SELECT event_id, CASE " + " ".join(f"WHEN contains(upper(event_code), '{w[0]}') THEN '{k}'" for k, w in CODES) + " ELSE 'other' END AS v FROM entity_status_events")
def x36(t):
    return t("entity_status_events").select("event_id", X.first_match(D("event_code"), CODES, "other").alias("v"))


TOPICS = {"traffic": ["traffic", "parking"], "water": ["flood", "sewer"], "money": ["tax", "budget"]}


@query("x37_topics", "SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(text), {w!r})' for w in ws)} THEN '{k}' END" for k, ws in TOPICS.items()) + "], lambda x: x IS NOT NULL) AS v FROM documents WHERE length(text) >= 20 UNION ALL SELECT doc_id, [] FROM documents WHERE text IS NULL OR length(text) < 20")
def x37(t):
    return t("documents").select("doc_id", X.topics(D("text"), TOPICS).alias("v"))


@query("x38_agenda_items", r"SELECT doc_id, regexp_extract_all(text, '(?:ORDINANCE|RESOLUTION) NO\. [0-9]+-[0-9]+') AS v FROM documents WHERE contains(text, ' NO. ')")
def x38(t):
    return t("documents").where(D("text").contains(" NO. ")).select("doc_id", F.regexp_extract_all("text", F.lit(r"(?:ORDINANCE|RESOLUTION) NO\. [0-9]+-[0-9]+"), F.lit(0)).alias("v"))


@query("x39_type_confidence", "SELECT permit_type, CASE WHEN contains(permit_type, 'STANDARD') THEN 0.95 WHEN contains(permit_type, 'SMALL') THEN 0.85 WHEN contains(permit_type, 'MEDIUM') THEN 0.7 ELSE 0.6 END AS confidence, count(*) AS n FROM permits GROUP BY 1, 2")
def x39(t):
    c = D("permit_type")
    level = F.when(c.contains("STANDARD"), 0.95).when(c.contains("SMALL"), 0.85).when(c.contains("MEDIUM"), 0.7).otherwise(0.6)
    return t.permits.groupBy("permit_type", level.alias("confidence")).agg(n())


@query("x40_strip", r"SELECT doc_id, length(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), '<[^>]*>', '', 'g')) AS v FROM documents")
def x40(t):
    return t("documents").select("doc_id", F.length(X.without_tags(X.ascii_only(D("text")))).cast("long").alias("v"))


SPANISH = ["el", "la", "de", "que", "y", "los", "en", "se", "para"]


@query("x41_language_share", "SELECT doc_id, round(coalesce(len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{w}'" for w in SPANISH) + r"))) * 1.0 / nullif(len(w), 0), 0), 6) AS v FROM (SELECT doc_id, list_slice(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\x0b]+'), lambda x: x <> ''), 1, 100) AS w FROM documents WHERE text IS NOT NULL)")
def x41(t):
    return t("documents").where("text is not null").select("doc_id", F.round(X.share_of_words(D("text"), SPANISH), 6).alias("v"))


@query("x42_quality", r"""SELECT doc_id, greatest(0, 100 - CASE WHEN length(text) < 100 THEN 40 ELSE 0 END - CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 15 ELSE 0 END - CASE WHEN contains(text, '<') THEN 10 ELSE 0 END - CASE WHEN text IS NULL THEN 100 ELSE 0 END) AS v FROM documents""")
def x42(t):
    c = D("text")
    pen = F.when(F.length(c) < 100, 40).otherwise(0) + F.when(c.rlike(r"[^\x00-\x7F]"), 15).otherwise(0) + F.when(c.contains("<"), 10).otherwise(0) + F.when(c.isNull(), 100).otherwise(0)
    return t("documents").select("doc_id", F.greatest(F.lit(0), F.lit(100) - pen).alias("v"))


@query("x43_mailing_line", "SELECT id, concat_ws(', ', nullif(trim(principal_address), ''), nullif(trim(mailing_address), ''), nullif(trim(status), '')) AS v FROM bulk_llc_records")
def x43(t):
    return t("bulk_llc_records").select("id", X.mailing_line(D("principal_address"), D("mailing_address"), D("status")).alias("v"))


@query("x44_acres", "SELECT parcel_key, round(square_feet / CAST(43560 AS DOUBLE), 2) AS v FROM parcels")
def x44(t):
    return t.parcels.select("parcel_key", G.acres(D("square_feet")).alias("v"))
