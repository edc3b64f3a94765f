"""Queries of the general problems (1, 3, 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.catalog import table
from landweave.operators.history import all_histories
from landweave.operators.incidents import around_incidents
from landweave.operators.rolls import ROLL_FIELDS
from landweave.operators.snapshot_diff import roll_changes


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return roll_changes(table(spark, d, "bulk_property_records"), table(spark, d, "bulk_data_snapshots")).select("snapshot_id", "parcel_key", "change")


def p1_field_changes(spark: SparkSession, d: str) -> DataFrame:
    """How many parcels changed each field at each delivery."""
    changes = roll_changes(table(spark, d, "bulk_property_records"), table(spark, d, "bulk_data_snapshots"))
    return changes.select("snapshot_id", F.explode("changed_fields").alias("field")).groupBy("snapshot_id", "field").agg(F.count(F.lit(1)).alias("n"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return around_incidents(table(spark, d, "crime_reports"), table(spark, d, "bulk_property_records"), table(spark, d, "bulk_data_snapshots"), table(spark, d, "bulk_gis_zoning"))


def _histories(spark: SparkSession, d: str) -> DataFrame:
    return all_histories(table(spark, d, "bulk_property_records"), table(spark, d, "bulk_data_snapshots"), table(spark, d, "entity_status_events"), table(spark, d, "entity_relationships"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _histories(spark, d).select("subject_key", "valid_from", "valid_to")


def p6_versions(spark: SparkSession, d: str) -> DataFrame:
    """The versions with their values."""
    return _histories(spark, d)


SAME = r"upper(trim(regexp_replace({0}, '\s+', ' ', 'g')))"
STRINGS = {"owner_name", "mailing_address", "property_address", "city", "property_type", "land_zoning_code", "sale_qualified"}

VALID = rf"""
seq AS (SELECT id AS snapshot_id, market_id AS market, snapshot_date AS at_,
               row_number() OVER w AS ord, lead(id) OVER w AS next_id, lead(snapshot_date) OVER w AS next_at
        FROM bulk_data_snapshots WHERE status = 'completed'
        WINDOW w AS (PARTITION BY market_id ORDER BY snapshot_date, id)),
valid AS (SELECT * FROM (
    SELECT s.*, upper(regexp_replace(r.parcel_id, '[^A-Za-z0-9]', '', 'g')) AS parcel_key,
           {", ".join((SAME.format("r." + f) if f in STRINGS else "r." + f) + " AS " + f for f in ROLL_FIELDS)},
           row_number() OVER (PARTITION BY r.snapshot_id, upper(regexp_replace(r.parcel_id, '[^A-Za-z0-9]', '', 'g')) ORDER BY r.loaded_at DESC, r.id DESC) AS rn
    FROM bulk_property_records r JOIN seq s USING (snapshot_id)) WHERE rn = 1)"""

_DIFFERS = " OR ".join(f"a.{f} IS DISTINCT FROM b.{f}" for f in ROLL_FIELDS)
_FIELDS = " UNION ALL ".join(f"SELECT b.snapshot_id, '{f}' AS field FROM both_ b WHERE b.{f} IS DISTINCT FROM b.{f}_a" for f in ROLL_FIELDS)

HAVERSINE = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({e} - {b}) / 2), 2))))"

ORACLES = {
    "p1_found": f"""
WITH {VALID},
pair AS (SELECT s.next_id AS snapshot_id, coalesce(a.parcel_key, b.parcel_key) AS parcel_key,
                CASE WHEN a.parcel_key IS NULL THEN 'added' WHEN b.parcel_key IS NULL THEN 'removed' WHEN {_DIFFERS} THEN 'changed' END AS change
         FROM (SELECT v.*, v.next_id AS to_id FROM valid v WHERE v.next_id IS NOT NULL) a
         FULL JOIN (SELECT * FROM valid WHERE ord > 1) b ON a.to_id = b.snapshot_id AND a.parcel_key = b.parcel_key
         JOIN seq s ON s.next_id = coalesce(a.to_id, b.snapshot_id))
SELECT * FROM pair WHERE change IS NOT NULL""",
    "p1_field_changes": f"""
WITH {VALID},
both_ AS (SELECT b.*, {", ".join(f"a.{f} AS {f}_a" for f in ROLL_FIELDS)} FROM valid a JOIN valid b ON a.next_id = b.snapshot_id AND a.parcel_key = b.parcel_key)
SELECT snapshot_id, field, count(*) AS n FROM ({_FIELDS}) GROUP BY 1, 2""",
    "p3_found": rf"""
WITH {VALID},
latest AS (SELECT market, parcel_key, property_address AS address, latitude AS lat, longitude AS lon FROM valid WHERE next_id IS NULL),
ok AS (SELECT * FROM latest WHERE lat BETWEEN 24 AND 50 AND lon BETWEEN -125 AND -66),
one AS (SELECT market, address, any_value(lat) AS lat, any_value(lon) AS lon FROM latest GROUP BY 1, 2 HAVING count(*) = 1),
inc AS (SELECT c.id, CASE WHEN c.latitude BETWEEN 24 AND 50 AND c.longitude BETWEEN -125 AND -66 THEN c.latitude ELSE o.lat END AS lat,
               CASE WHEN c.latitude BETWEEN 24 AND 50 AND c.longitude BETWEEN -125 AND -66 THEN c.longitude ELSE o.lon END AS lon
        FROM crime_reports c LEFT JOIN one o ON o.market = c.market_id AND o.address = {SAME.format("c.incident_address")}
             AND o.lat BETWEEN 24 AND 50 AND o.lon BETWEEN -125 AND -66),
edges AS (SELECT zone_id, ring[i].lon AS x1, ring[i].lat AS y1, ring[i % len(ring) + 1].lon AS x2, ring[i % len(ring) + 1].lat AS y2
          FROM (SELECT zone_id, ring, unnest(range(1, len(ring) + 1)) AS i FROM bulk_gis_zoning)),
box AS (SELECT zone_id, min(x1) AS x0, max(x1) AS x9, min(y1) AS y0, max(y1) AS y9 FROM edges GROUP BY 1)
SELECT i.id AS incident_id, 'p:' || p.parcel_key AS match_key FROM inc i JOIN ok p
  ON p.lat BETWEEN i.lat - 0.001 AND i.lat + 0.001 AND {HAVERSINE.format(a="i.lat", b="i.lon", c="p.lat", e="p.lon")} <= 100
UNION
SELECT i.id, 'z:' || e.zone_id FROM inc i JOIN box b ON i.lat BETWEEN b.y0 AND b.y9 AND i.lon BETWEEN b.x0 AND b.x9
  JOIN edges e ON e.zone_id = b.zone_id AND (e.y1 > i.lat) <> (e.y2 > i.lat) AND i.lon < (e.x2 - e.x1) * (i.lat - e.y1) / (e.y2 - e.y1) + e.x1
GROUP BY i.id, e.zone_id HAVING count(*) % 2 = 1""",
}

_P6 = rf"""
WITH {VALID},
own AS (SELECT *, ord - row_number() OVER (PARTITION BY market, parcel_key, owner_name ORDER BY ord) AS island FROM valid WHERE owner_name IS NOT NULL),
owners AS (SELECT 'p:' || parcel_key AS subject_key, min(at_) AS f, arg_max_null(next_at, ord) AS t, owner_name AS value FROM own GROUP BY market, parcel_key, owner_name, island),
st AS (SELECT entity_id, effective_date, {SAME.format("status")} AS s FROM entity_status_events WHERE status IS NOT NULL AND effective_date IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY entity_id, effective_date ORDER BY received_at DESC, event_id DESC) = 1),
turn AS (SELECT * FROM (SELECT *, lag(s) OVER (PARTITION BY entity_id ORDER BY effective_date) AS b FROM st) WHERE b IS DISTINCT FROM s),
statuses AS (SELECT 'e:' || entity_id AS subject_key, effective_date AS f, lead(effective_date) OVER (PARTITION BY entity_id ORDER BY effective_date) AS t, s AS value FROM turn),
rel AS (SELECT id, 'r:' || source_entity_id || '|' || target_entity_id || '|' || relationship_type AS k, relationship_start_date AS a, coalesce(relationship_end_date, DATE '9999-12-31') AS b
        FROM entity_relationships WHERE relationship_start_date IS NOT NULL AND (relationship_end_date IS NULL OR relationship_end_date > relationship_start_date)),
mark AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY k ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM rel WHERE k IS NOT NULL),
grp AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY a, b, id ROWS UNBOUNDED PRECEDING) AS g FROM mark),
ties AS (SELECT k AS subject_key, min(a) AS f, max(b) AS t, 'active' AS value FROM grp GROUP BY k, g),
every AS (SELECT * FROM owners UNION ALL SELECT * FROM statuses UNION ALL SELECT * FROM ties)
SELECT subject_key, strftime(f, '%Y-%m-%d') AS valid_from, coalesce(strftime(t, '%Y-%m-%d'), '9999-12-31') AS valid_to{{value}} FROM every"""
ORACLES["p6_found"] = _P6.format(value="")
ORACLES["p6_versions"] = _P6.format(value=", value")

QUERIES = {f.__name__: f for f in (p1_found, p1_field_changes, p3_found, p6_found, p6_versions)}
