"""Operators that SQL does not cover, and values computed by hand from the formulas."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from landweave.functions import geo as G
from landweave.functions import text as X
from landweave.operators import rollups as R
from landweave.operators import upsert as K
from landweave.operators.chunking import chunk, hash_embedding, sentences
from landweave.operators.fuzzy import decision, similarity_join, text_contains_name, weighted_score
from landweave.operators.search import Criteria, classify_question, diversity_cap, search
from landweave.plans import valuation as V
from landweave.sources import records as S
from landweave.streaming.ingest import Parsers, dedupe_stream, fresh_facts, hourly_stream, read_facts, sessions


def one(spark, **columns):
    r = spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()
    return r[0] if len(columns) == 1 else tuple(r)


def test_text_functions(spark):
    s = F.lit
    assert one(spark, v=X.company_name(s("The Oak & Elm Holdings, LLC."))) == "OAK ELM HOLDINGS LLC"
    assert one(spark, a=X.phone(s("(352) 555-0100")), b=X.phone(s("1-352-555-0100")), c=X.phone(s("555-0100"))) == ("+13525550100", "+13525550100", "5550100")
    assert one(spark, v=X.address_text(s("456 SW 39th Avenue"))) == "456 sw 39 ave"
    assert one(spark, v=F.round(X.text_similarity(s("word"), s("two words")), 6)) == 0.25
    assert one(spark, v=F.round(X.word_similarity(s("word"), s("two words")), 6)) == round(4 / 11, 6)
    assert one(spark, v=F.round(X.matching_ratio(s("123 n main st"), s("123 main st")), 6)) == 0.916667
    assert one(spark, v=X.scan_date(s("xx13452024 03152024"))) == dt.date(2024, 3, 15)
    assert one(spark, a=X.number(s("$1,234.50")), b=X.number(s("abc")), c=X.number(s("200000000"))) == (1234.5, None, None)
    assert one(spark, a=X.boolean(s(" YES ")), b=X.boolean(s("0")), c=X.boolean(s(None).cast("string"))) == (True, False, None)
    assert one(spark, a=X.any_date(s("/Date(86400000)/")), b=X.any_date(s("02/30/2024")), c=X.any_date(s("2024-02-29"))) == (dt.date(1970, 1, 2), None, dt.date(2024, 2, 29))
    assert one(spark, v=X.first_present(s(" "), s("n/a"), s("x"), s("y"))) == "x"
    assert one(spark, a=X.record_hash({"b": s(1), "a": s("x")}) == X.record_hash({"a": s("x"), "b": s(1)}), b=X.record_hash({"a": s("x")}) == X.record_hash({"a": s("y")})) == (True, False)


def test_geo_functions(spark):
    p = [F.lit(v) for v in (29.6516, -82.3248, 29.6519, -82.3251)]
    assert one(spark, a=F.round(G.haversine_miles(*p), 7), b=F.round(G.haversine_m(*p), 4)) == (0.0274633, 44.1953)
    assert one(spark, x=G.grid_cell(F.lit(-82.3248), 500), y=G.grid_cell(F.lit(29.6516), 500)) == (-18276, 6583)


def test_absorption(spark):
    as_of = dt.date(2024, 12, 1)
    rows = [(1, as_of - dt.timedelta(days=10))] * 20 + [(1, as_of - dt.timedelta(days=300))] * 10 + [(1, None)] * 170
    r = R.absorption(spark.createDataFrame(rows, "k int, last_sale_date date"), ["k"], F.lit(as_of), 365).first()
    assert (r.inventory, r.full_sales, r.half_sales, r.full_rate, r.half_rate, r.months, r.trend) == (200, 30, 20, 15.0, 20.0, 60.7, "rising")


def test_value_estimate(spark):
    rows = [(100e3, None, 30, 0.2, 1.0), (110e3, None, 60, 0.4, 1.0), (120e3, None, 90, 0.6, 1.0), (130e3, None, 120, 0.8, 1.0)]
    df = spark.createDataFrame(rows, "price double, acres double, days int, miles double, subject_acres double")
    assert round(V.value_estimate(df).first().confidence, 2) == 0.92
    assert V.value_estimate(df.limit(0)).first().comps == 0
    spreads = spark.createDataFrame([("a", float(x)) for x in (120, 125, 130, 115, 128)] + [("b", float(x)) for x in (100, 150, 110, 160, 105)], "k string, v double")
    assert {r.k: round(r.fsd, 2) for r in V.spread(spreads, ["k"], "v").collect()} == {"a": 4.94, "b": 22.27}


def test_match_score(spark):
    lit = lambda v: F.lit(v).cast("double")
    w = F.lit
    full = weighted_score({"name": (lit(1.0), w(0.5)), "address": (lit(1.0), w(0.35))})
    single = weighted_score({"name": (lit(1.0), w(0.5)), "address": (lit(None), w(0.35))})
    mixed = weighted_score({"name": (lit(0.6), w(0.35)), "phone": (lit(1.0), w(0.30))})
    assert one(spark, a=full, b=single, c=F.round(mixed, 6), d=decision(full), e=decision(single), f=weighted_score({"name": (lit(None), w(0.5))})) == (1.0, 0.84, 0.784615, "accept", "review", 0.0)


def test_similarity_join_equals_brute_force(spark):
    import itertools

    words = ["oak elm", "oak elms", "elm oak", "oak", "holding oak elm", "", None, "élan vital", "elan vital", "a", "oak elm"]
    df = spark.createDataFrame(list(enumerate(words)), "id int, name string")

    def grams(t):
        import re

        return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", t.lower()) for i in range(len(w) + 1)}

    for t in (0.2, 0.5, 0.9, 1.0):
        want = set()
        for (i, a), (j, b) in itertools.product(enumerate(words), repeat=2):
            if a and b and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= t - 1e-12:
                want.add((i, j))
        assert {(r.l, r.r) for r in similarity_join(df, df, "id", "name", t).collect()} == want


def test_text_contains_name(spark):
    texts = spark.createDataFrame([(1, "The PLANNING  commission met."), (2, "Planning commissioners met"), (3, None), (4, "")], "id int, text string")
    names = spark.createDataFrame([(1, "planning commission"), (2, "short"), (3, None)], "nid int, name string")
    assert [(r.id, r.nid) for r in text_contains_name(texts, names, "id", "text", "nid", "name").collect()] == [(1, 1)]


CAP = "parcel_key string, owner_name string, latitude double, longitude double, market_value double, last_sale_date date"


def test_diversity_cap(spark):
    rows = [("p1", "A", 1.0, 1.0, 9.0, None), ("p2", "a.", 2.0, 2.0, 8.0, None), ("p2", "B", 1.0, 1.0, 7.0, None), ("p3", "C", 3.0, 3.0, 6.0, None), ("p4", None, None, None, 5.0, None), ("p5", None, None, None, 4.0, None)]
    df = spark.createDataFrame(rows, CAP)
    got = [r.parcel_key for r in diversity_cap(df, per_owner=1, limit=10).orderBy("place").collect()]
    assert got == ["p1", "p3", "p4", "p5"]
    assert [r.parcel_key for r in diversity_cap(df, per_owner=0, limit=1).collect()] == ["p1"]


def test_search_without_criteria_is_bounded(spark):
    df = spark.createDataFrame([(f"p{i}", None, None, None, float(i), None) for i in range(30)], CAP)
    assert search(df, Criteria(), order="no such order", limit=5).count() == 15
    assert search(df, Criteria(most={"market_value": 3}), limit=1000).count() == 4


def test_question_class():
    assert classify_question("What is at 123 N Main St?", ["market"]) == "specific"
    assert classify_question("How is the market at 1 Oak Ave?", ["market"]) == "strategic"


def test_lifecycle_and_gaps(spark):
    df = spark.createDataFrame([("P", "applied", 1), ("P", "closed", 2), ("P", "issued", 3)], "k string, s string, n int")
    assert R.lifecycle_dedupe(df, ["k"], "s", ["closed", "issued", "applied"], [F.asc("n")]).first().s == "closed"
    streets = spark.createDataFrame([("m", f"{n} Oak St") for n in (100, 102, 110)] + [("m", None), ("m", "PO Box 3")], "market string, a string")
    assert [(r.from_no, r.to_no, r.missing) for r in R.street_gaps(streets, "market", "a").collect()] == [(102, 110, [104, 106, 108])]


def test_upserts(spark):
    a = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (None, "n", None)], "k int, v string, w string")
    b = spark.createDataFrame([(2, "B", None), (3, "c", "z"), (3, "d", "y")], "k int, v string, w string")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(K.latest_wins(a, b, ["k"], F.col("v"))) == sorted([(1, "a", None), (2, "B", None), (3, "d", "y"), (None, "n", None)], key=str)
    assert rows(K.insert_or_ignore(a, b, ["k"])) == sorted([(1, "a", None), (2, "b", "x"), (None, "n", None), (3, "c", "z")], key=str)
    assert rows(K.fill(a, b, ["k"], ["w"])) == sorted([(1, "a", None), (2, "b", "x"), (None, "n", None)], key=str)
    assert rows(K.touch(a, b, ["k"], "v"))[1][1] == "B"
    d1 = K.content_digest(spark.createDataFrame([(1, "x", 10), (1, None, 11)], "m int, c string, t int"), ["m"], ["t"])
    d2 = K.content_digest(spark.createDataFrame([(1, None, 99), (1, "x", 98), (2, "y", 0)], "m int, c string, t int"), ["m"], ["t"])
    assert [r.m for r in K.changed_groups(d1, d2, ["m"]).collect()] == [2]


def test_sources(spark, tmp_path):
    (tmp_path / "cama.txt").write_bytes("Parcel\tValue\tPool\n 1 \t$1,000\tyes\n2\tbad\xff\t\n".encode("latin-1"))
    df = S.read_delimited(spark, str(tmp_path / "cama.txt"), key="Parcel")
    got = S.typed(df, {"parcel": ("Parcel", "string"), "value": ("Value", "double"), "pool": ("Pool", "boolean")}).orderBy("parcel").collect()
    assert [tuple(r) for r in got] == [("1", 1000.0, True), ("2", None, None)]
    with zipfile.ZipFile(tmp_path / "roll.zip", "w") as z:
        z.writestr("A/OWNERS.TXT", "x\ny\n")
        z.writestr("other.doc", "no")
    assert sorted(r.line for r in S.read_archive(spark, str(tmp_path / "roll.zip"), ["owners.txt"]).collect()) == ["x", "y"]
    line = "L001".ljust(12) + "NAME".ljust(146)
    (tmp_path / "corp.txt").write_bytes((line + "é".ljust(302) + "  01022020\n\n").encode("latin-1"))
    r = S.parse_corporate(S.read_fixed_width(spark, str(tmp_path / "corp.txt"))).where("document_number is not null").first()
    assert (r.document_number, r["name"], r.filing_date) == ("L001", "NAME", dt.date(2020, 1, 2))
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/a.md").write_text("x" * 100)
    (tmp_path / "texts/b.md").write_text("x" * 99)
    assert S.read_corpus(spark, str(tmp_path / "texts")).count() == 1
    (tmp_path / "e.json").write_text(json.dumps({"metadata": {}, "embeddings": [{"city": "X", "embedding": [1.0]}]}))
    assert S.read_embeddings(spark, str(tmp_path / "e.json")).first().city == "X"
    feed = "<rss><channel><item><title>t</title><link>l</link><pubDate>d</pubDate><description>" + "x" * 501 + "</description></item></channel></rss>"
    assert len(S.parse_feed(spark.createDataFrame([(feed,)], "value string")).first().summary) == 503


def test_chunks(spark):
    text = "Sec. 1 Rules. " + " ".join(f"Word{i} one two three." for i in range(20)) + "\n\nLast part"
    df = spark.createDataFrame([(1, text), (2, None), (3, "  "), (4, "one"), (5, "w " * 700 + ". Next one.")], "doc_id int, text string")
    rows = chunk(df, target=10, most=14).orderBy("doc_id", "chunk_number").collect()
    mine = [r for r in rows if r.doc_id == 1]
    assert " ".join(r.chunk_text for r in mine) == " ".join(text.split())
    assert all(r.words <= 14 for r in mine) and mine[0].overlap_text is None and mine[1].overlap_text
    assert {r.doc_id for r in rows} == {1, 4, 5}
    assert spark.createDataFrame([("No. 5 is it. Yes! Go",)], "t string").select(sentences(F.col("t"))).first()[0] == ["No. 5 is it.", "Yes!", "Go"]
    v = spark.createDataFrame([("a b a",), ("",)], "t string").select(hash_embedding(F.col("t"), 8)).collect()
    assert abs(sum(x * x for x in v[0][0]) - 1) < 1e-9 and set(v[1][0]) == {0.0}


def test_facts_and_streams(spark, tmp_path):
    facts = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, None, "x")], "id int, content string, fact_type string")
    stored = facts.where("id = 3").select(F.sha2("content", 256).alias("content_hash"))
    assert [r.id for r in fresh_facts(facts, stored).collect()] == [1]
    with pytest.raises(KeyError):
        Parsers().parse(facts, "x")
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, "a", "m", 0.9), (1, t + dt.timedelta(minutes=10), "a", "m", 0.5), (1, t + dt.timedelta(hours=2), "b", "m", 0.7)]
    schema = "user int, at timestamp, content string, method string, confidence double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))

    def run(df, mode):
        q = df.writeStream.format("memory").queryName(f"q{abs(hash(mode + str(df.columns)))}").outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(q.name).collect()

    source = read_facts(spark, str(tmp_path / "in"), schema)
    assert sorted(r.content for r in run(dedupe_stream(source, "at", "content", "3 hours"), "append")) == ["a", "b"]
    assert sorted((r.n, r.high, r.medium, r.low) for r in run(hourly_stream(source, "at", "method", "confidence"), "complete")) == [(1, 0, 1, 0), (2, 1, 0, 1)]
    assert sorted(r.n for r in sessions(spark.createDataFrame(rows, schema), "user", "at").collect()) == [1, 2]


def test_points_of_wkt(spark):
    from pyspark.sql import functions as F

    from landweave.functions.geo import wkt_xy

    texts = ["POINT(-82.5 29)", " point Z ( -82.5  29.25 7 ) ", "POINT EMPTY", "LINESTRING(0 0, 1 1)", "POINT(a b)", "", None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, w string").select("i", *[c.alias(n) for n, c in zip("xy", wkt_xy(F.col("w")), strict=True)]).orderBy("i").collect()
    assert [(r.x, r.y) for r in got] == [(-82.5, 29.0), (-82.5, 29.25), *[(None, None)] * 5]
