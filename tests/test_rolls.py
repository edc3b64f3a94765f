"""Snapshot differences and histories on small fixtures, against plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from landweave.operators.history import HistoryLog, change_log, fold_history, found_form, period_observations, roll_observations, status_observations, versions
from landweave.operators.rolls import ROLL_FIELDS, deliveries
from landweave.operators.snapshot_diff import roll_changes

TYPES = dict.fromkeys(ROLL_FIELDS, "string") | {"latitude": "double", "longitude": "double", "lot_size_acres": "double", "square_feet": "int", "year_built": "int", "bedrooms": "int", "has_pool": "boolean", "market_value": "double", "assessed_value": "double", "last_sale_date": "date", "last_sale_price": "double"}
RECORDS = "id bigint, market_id string, snapshot_id bigint, parcel_id string, loaded_at timestamp, " + ", ".join(f"{k} {v}" for k, v in TYPES.items()) + ", ord string, sign string, market string, digest string"
SNAPSHOTS = "id bigint, market_id string, status string, snapshot_date date, next_id string"
T0 = dt.datetime(2024, 1, 1)


def tables(spark, rows, snapshots):
    full = []
    for i, (snapshot, parcel, minute, values) in enumerate(rows):
        r = {"id": i, "market_id": "m", "snapshot_id": snapshot, "parcel_id": parcel, "loaded_at": None if minute is None else T0 + dt.timedelta(minutes=minute), "ord": "x", "sign": "y", "market": "z", "digest": None} | dict.fromkeys(ROLL_FIELDS) | values
        full.append(tuple(r[c.split()[0]] for c in RECORDS.split(", ")))
    return spark.createDataFrame(full, RECORDS), spark.createDataFrame([(*s, "clash") for s in snapshots], SNAPSHOTS)


S3 = [(1, "m", "completed", dt.date(2024, 1, 1)), (2, "m", "failed", dt.date(2024, 2, 1)), (3, "m", "completed", dt.date(2024, 3, 1)), (4, "m", "completed", dt.date(2024, 4, 1))]


def changes(spark, rows, snapshots=S3):
    return {(r[0], r[1]): (r[2], r[3]) for r in roll_changes(*tables(spark, rows, snapshots)).collect()}


def test_added_removed_changed_and_same_text(spark):
    rows = [
        (1, "a-1", 0, {"owner_name": "Ann  Lee "}), (3, "A1", 0, {"owner_name": "ANN LEE"}), (4, "A 1", 0, {"owner_name": "Ann Leigh", "bedrooms": 2}),
        (1, "b", 0, {"city": None}), (3, "b", 0, {"city": ""}),
        (2, "c", 0, {}), (3, "c", 0, {}), (4, "c", 0, {}),
        (1, None, 0, {}), (1, "--", 0, {}),
    ]
    assert changes(spark, rows) == {
        (4, "A1"): ("changed", ["bedrooms", "owner_name"]), (3, "B"): ("changed", ["city"]), (4, "B"): ("removed", []), (3, "C"): ("added", []),
    }


def test_late_and_repeated_rows(spark):
    rows = [(1, "a", 0, {"city": "X"}), (1, "a", 5, {"city": "Y"}), (1, "a", None, {"city": "Z"}), (3, "a", 0, {"city": "y"}), (3, "a", 0, {"city": "Y"})]
    assert changes(spark, rows) == {(4, "A"): ("removed", [])}


def test_null_moves_between_columns(spark):
    rows = [(1, "a", 0, {"city": "X", "property_type": None}), (3, "a", 0, {"city": None, "property_type": "X"}), (4, "a", 0, {"city": None, "property_type": "X"})]
    assert changes(spark, rows) == {(3, "A"): ("changed", ["city", "property_type"])}


def test_empty_tables(spark):
    assert changes(spark, []) == {}
    assert changes(spark, [(1, "a", 0, {})], []) == {}


def test_hot_parcel(spark):
    rows = [(1, "hot", i, {"city": str(i)}) for i in range(300)] + [(3, "hot", 0, {"city": "299"}), (1, "cold", 0, {}), (3, "cold", 0, {}), (4, "cold", 0, {}), (4, "hot", 1, {"city": "299"})]
    assert changes(spark, rows) == {}


def test_random_rolls_against_python(spark):
    rng = random.Random(3)
    rows = [(s, f"p{rng.randrange(12)}", rng.randrange(99), {"city": rng.choice(["A", "a ", None, "B"]), "bedrooms": rng.choice([None, 1])}) for s in (1, 2, 3, 4) for _ in range(25)]
    best = {}
    for i, (s, p, m, v) in enumerate(rows):
        if s != 2 and (best.get((s, p), (-1, -1))[:2] < (m, i)):
            best[s, p] = (m, i, (None if v["city"] is None else v["city"].strip().upper(), v["bedrooms"]))
    want = {}
    for before, now in ((1, 3), (3, 4)):
        for p in {k[1] for k in best}:
            a, b = best.get((before, p)), best.get((now, p))
            if (a is None) != (b is None):
                want[now, p.upper()] = "added" if a is None else "removed"
            elif a and a[2] != b[2]:
                want[now, p.upper()] = "changed"
    assert {k: v[0] for k, v in changes(spark, rows).items()} == want


def test_deliveries(spark):
    got = deliveries(spark.createDataFrame([*S3, (5, "m", "completed", None), (None, "m", "completed", dt.date(2024, 9, 1))], "id bigint, market_id string, status string, snapshot_date date")).orderBy("ord").collect()
    assert [(r.snapshot_id, r.next_id, r.is_last) for r in got] == [(1, 3, False), (3, 4, False), (4, None, True)]


def owners(spark, rows):
    h = found_form(versions(roll_observations(*tables(spark, rows, S3), "owner_name"), every=2), F.col("subject.parcel_key"))
    return sorted((r[0], r[1], r[2], r[3]) for r in h.collect())


def test_owner_history(spark):
    rows = [(1, "a", 0, {"owner_name": "Ann"}), (3, "a", 0, {"owner_name": " ann"}), (4, "a", 0, {"owner_name": "Bob"}), (1, "b", 0, {"owner_name": "C"}), (4, "b", 0, {"owner_name": "C"}), (1, "d", 0, {"owner_name": None}), (3, "d", 0, {"owner_name": "D"}), (4, "d", 0, {"owner_name": None})]
    assert owners(spark, rows) == [
        ("A", "2024-01-01", "2024-04-01", "ANN"), ("A", "2024-04-01", "9999-12-31", "BOB"), ("B", "2024-01-01", "2024-03-01", "C"), ("B", "2024-04-01", "9999-12-31", "C"), ("D", "2024-03-01", "2024-04-01", "D"),
    ]


def test_status_history(spark):
    d = lambda m: dt.date(2024, m, 1)
    t = lambda h: T0 + dt.timedelta(hours=h)
    rows = [(1, 7, "Active", d(1), t(1)), (2, 7, "ACTIVE ", d(2), t(1)), (3, 7, "Closed", d(3), t(1)), (4, 7, "Open", d(3), t(9)), (5, 7, "Shut", d(3), t(9)), (6, 7, None, d(4), t(1)), (7, 7, "X", None, t(1)), (8, None, "X", d(1), t(1)), (9, 7, "late", d(3), None)]
    df = spark.createDataFrame(rows, "event_id bigint, entity_id bigint, status string, effective_date date, received_at timestamp")
    got = sorted(tuple(r) for r in found_form(versions(status_observations(df)), F.col("subject").cast("string")).collect())
    assert got == [("7", "2024-01-01", "2024-03-01", "ACTIVE"), ("7", "2024-03-01", "9999-12-31", "SHUT")]


def test_periods(spark):
    d = lambda m: dt.date(2024, m, 1)
    rows = [(1, d(1), d(3)), (1, d(3), d(5)), (1, d(2), d(4)), (1, d(7), None), (1, d(8), d(9)), (1, d(6), d(6)), (1, None, d(2)), (2, d(5), d(4)), (None, d(1), d(2)), (3, d(1), d(2)), (3, d(1), d(2))]
    df = spark.createDataFrame(rows, "k int, a date, b date")
    got = sorted(tuple(r)[:3] for r in found_form(versions(period_observations(df, ["k"], "a", "b"), every=2), F.col("subject.k").cast("string")).collect())
    assert got == [("1", "2024-01-01", "2024-05-01"), ("1", "2024-07-01", "9999-12-31"), ("3", "2024-01-01", "2024-02-01")]


def test_log_of_two_attributes(spark):
    rows = [(1, i, dt.date(2024, 1, 1 + i), *v) for i, v in enumerate([("a", 1), ("a", 1), ("a", 2), ("b", 2), (None, None), ("b", 2), ("b", None)])]
    df = spark.createDataFrame(rows, "subject int, seq bigint, at date, x string, y int")
    for every in (1, 2, 3, 100):
        log = change_log(df, ["x", "y"], every)
        got = [(r.valid_from.day, r.valid_to and r.valid_to.day, r.x, r.y) for r in fold_history(log, ["x", "y"]).orderBy("valid_from").collect()]
        assert got == [(1, 3, "a", 1), (3, 4, "a", 2), (4, 5, "b", 2), (6, 7, "b", 2), (7, None, "b", None)]
    assert change_log(df, ["x", "y"], 100).count() == 6


def test_appending_equals_rebuilding(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, i, dt.date(2024, 1, 1) + dt.timedelta(days=i), rng.choice(["a", "b", None]), rng.choice([1, 2, None])) for k in range(12) for i in range(20) if rng.random() < 0.8]
    schema = "subject int, seq bigint, at date, x string, y int"
    df = spark.createDataFrame(rows, schema)
    grown = HistoryLog(spark, str(tmp_path / "grown"), ["x", "y"], every=3)
    for low, high in ((0, 5), (5, 6), (6, 14), (14, 20)):
        grown.append(df.where(f"seq >= {low} and seq < {high}"))
    built = HistoryLog(spark, str(tmp_path / "built"), ["x", "y"], every=3).append(df)
    key = lambda r: (r.subject, r.seq)
    assert sorted(grown.rows().drop("part").collect(), key=key) == sorted(built.rows().drop("part").collect(), key=key)
    assert grown.rows().where("is_checkpoint").count() > 12
    assert sorted(grown.history().collect(), key=str) == sorted(fold_history(change_log(df, ["x", "y"], 100), ["x", "y"]).collect(), key=str)
    for day in (-1, 0, 4, 5, 9, 19, 40):
        want = {}
        for k, i, _, x, y in rows:
            if i <= day:
                want[k] = (x, y)
        got = {r.subject: (r.x, r.y) for r in grown.as_of(dt.date(2024, 1, 1) + dt.timedelta(days=day)).collect()}
        assert got == {k: v for k, v in want.items() if v != (None, None)}
