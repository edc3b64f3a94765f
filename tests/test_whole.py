"""Queries that do the whole job where their SQL has only a part of it."""

from landweave.queries import QUERIES
from tests.compare import database


def tables(spark, folder, **frames):
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_resolution_of_all_markets_and_fields(spark, tmp_path):
    schema = "id bigint, name string, phone string, email string, primary_address string, first_seen_market_id string"
    rows = [(1, "Oakfield Holdings", "1", None, None, "m1"), (2, "Oakfield Holdings", "1", None, None, "m2"), (3, "Zzyx", "1", "a@b", None, "m1"), (4, None, None, "A@b ", None, None), (5, "Quux", " ", None, "1 Oak St", "m1"), (6, "Vern", " ", None, "1 OAK ST ", "m1"), (7, "Oakfield Hollow", None, None, None, "m3")]
    got = {(r.l, r.r): r.score for r in QUERIES["q23_entity_resolution"](spark, tables(spark, tmp_path, entities=(rows, schema))).collect()}
    assert set(got) == {(1, 2), (1, 3), (2, 3), (3, 4), (5, 6), (1, 7), (2, 7)}
    assert got[1, 2] == 1.0 and got[1, 3] == round(0.3 / 0.65, 6) and got[3, 4] == 0.0


def test_centroid_of_every_owner(spark, tmp_path):
    state = "STATE TRANSPORTATION LAND RESERVE"
    rows = [(i, 1, f"p{i}", "2024-01-01", o, 29.0, -82.0) for i, o in enumerate([state, state, state, "A", None, None, None])]
    records = (rows, "id bigint, snapshot_id bigint, parcel_id string, loaded_at string, owner_name string, latitude double, longitude double")
    snapshots = ([(1, "m", "2024-01-01", "completed")], "id bigint, market_id string, snapshot_date string, status string")
    got = QUERIES["j11_near_centroid"](spark, tables(spark, tmp_path, bulk_property_records=records, bulk_data_snapshots=snapshots)).collect()
    assert {(r.owner_name, r.parcel_key) for r in got} == {(state, f"P{i}") for i in range(7)}


def test_feed_of_every_event(spark, tmp_path):
    folder = tables(spark, tmp_path, events=([(i, f"kind {i}") for i in range(20)], "event_id bigint, event_type string"))
    assert {(r.title, r.summary) for r in QUERIES["s10_feed"](spark, folder).collect()} == {(str(i), f"kind {i}") for i in range(20)}


def test_addresses_that_do_not_begin_with_the_number(spark, tmp_path):
    records = ([(1, 1, "p1", "2024-01-01", "7333 24th Pkwy, Fort Presorner Springs, FL 20004", "m"), (2, 1, "p2", "2024-01-01", "8 Oak St, Lake Foo 20001", "m")], "id bigint, snapshot_id bigint, parcel_id string, loaded_at string, property_address string, market_id string")
    snapshots = ([(1, "m", "2024-01-01", "completed")], "id bigint, market_id string, snapshot_date string, status string")
    entities = ([(1, "Fort Presorner Springs, FL 20004 - 7333 24th Pkwy"), (2, None)], "id bigint, primary_address string")
    reports = ([(1, "No. 7333 24th Pkwy, Fort Presorner Springs, FL 20004", "m"), (2, "No. 7333 24th Pkwy, Fort Presorner Springs, FL 20004", "n")], "id bigint, incident_address string, market_id string")
    folder = tables(spark, tmp_path, bulk_property_records=records, bulk_data_snapshots=snapshots, entities=entities, crime_reports=reports)
    for name in ("q36_address_resolution", "q34_place_of_reports"):
        assert [(r.id, r.parcel_key) for r in QUERIES[name](spark, folder).collect()] == [(1, "P1")], name


def test_registry_match_equals_brute_force(spark, sf_dir, tmp_path):
    from difflib import SequenceMatcher

    entities = [(1, "RUDAVLOK-ASHOTMAN LAND COMPANY CORP"), (2, "The Stanithamzelunsher Prop L L C"), (3, None), (4, "")]
    registry = [(1, "RUDAVLOCK-ASSHOTMAN LAND CO. INCORPORATED", "A"), (2, "STANITHAM ZELUNSHER PROPERTIES LLC", "active"), (3, None, "A"), (4, "", None)]
    folder = tables(spark, tmp_path, entities=(entities, "id bigint, name string"), bulk_llc_records=(registry, "id bigint, name string, status string"))
    assert {(r.l, r.r) for r in QUERIES["q37_registry_match"](spark, folder).collect()} == {(1, 1), (2, 2), (4, 4)}
    db, want = database(sf_dir), {}
    registry = db.execute("SELECT id, upper(name), coalesce(upper(status) IN ('A', 'ACTIVE'), false) FROM bulk_llc_records WHERE name IS NOT NULL").fetchall()
    for i, name in db.execute("SELECT id, upper(name) FROM entities WHERE name IS NOT NULL").fetchall():
        found = [(-min(round(SequenceMatcher(None, name, n).ratio() + 0.1 * active, 6), 1.0), k) for k, n, active in registry]
        if found and min(found)[0] <= -0.8:
            want[i] = min(found)[1]
    assert want and {r.l: r.r for r in QUERIES["q37_registry_match"](spark, sf_dir).collect()} == want


def test_entity_names_in_texts(spark, tmp_path):
    folder = tables(spark, tmp_path, documents=([(1, "Granted to OAKFIELD  Holdings, LLC."), (2, "nobody"), (3, None)], "doc_id bigint, text string"), entities=([(1, "Oakfield Holdings LLC"), (2, None)], "id bigint, name string"), supplier=([("Supplier#000000001",)], "s_name string"))
    assert [(r.doc_id, r.name) for r in QUERIES["j17_text_contains_name"](spark, folder).collect()] == [(1, "Oakfield Holdings LLC")]
