"""Addresses, names and registry links on hand-made cases."""

import pytest

from landweave.llm.addresses import alignment_cost, same_locations, same_place
from landweave.llm.attribution import near_cores, same_names
from landweave.llm.linkage import expectation_maximisation, registry_links
from landweave.llm.names import given_name, parse_name
from landweave.llm.postal import parse
from landweave.llm.strings import osa


@pytest.mark.parametrize(("a", "b", "d"), [("abc", "abc", 0), ("abc", "acb", 1), ("abc", "abd", 1), ("abc", "", 3), ("abcdef", "fedcba", 4), ("ca", "abc", 3)])
def test_osa(a, b, d):
    assert osa(a, b, 3) == d == osa(b, a, 3)


def test_parse_address():
    assert parse("C/O TAX DEPT Lake Foo, FL - NO. 4346 NORTHWEST 39th Street #5") == ("4346", "NW", "39", "ST", "5", "", "")  # a place in a care-of line is dropped with it
    assert parse("4346 39 St N.W., Apartment 05, Lake Foo 20003-1234 USA") == ("4346", "NW", "39", "ST", "5", "LAKE FOO", "20003")
    assert parse("STE 58, 4597 MILIMAN DRIVE, 20002")[4] == "58"
    assert parse("P.O. Box # 123, Lake Foo") == parse("post office box 123 Lake Foo")
    assert parse("123 First Road, X")[2] == "1"
    for odd in (None, "", "  ", "no number", "12", "#", "PO Box", "C/O", "1 - 2 - 3", "x" * 100000):
        parse(odd)
    assert parse("no number") is None


def test_alignment():
    a = [("number", "1"), ("street", "OAK"), ("city", "LAKE"), ("city", "FOO"), ("zip", "20000")]
    assert alignment_cost(a, a) == 0
    assert alignment_cost(a, a[:2]) == pytest.approx(0.3 + 0.05 + 0.05)
    assert alignment_cost(a, [("number", "2"), *a[1:]]) >= 9
    p = parse("10 Willowdale Rd, Lake Foo, FL 20000")
    assert same_place(p, parse("10 Wilowdale Rd 20000"), None, None)
    assert same_place(p, parse("10 Willowdale, 20000"), ["RD|"], ["RD"])
    assert not same_place(p, parse("10 Willowdale, 20000"), ["CIR|", "RD|"], ["CIR", "RD"])
    for other in ("12 Willowdale Rd 20000", "10 Willowdale Cir 20000", "10 Willowdale Rd 20001", "10 Willowdale Rd Apt 3, 20000", "10 N Willowdale Rd 20000", "10 53rd Rd 20000"):
        assert not same_place(p, parse(other), ["RD|"], ["RD"]), other


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_same_locations(spark):
    rows = [("e:1", "m", "10 Willowdale Rd, Lake Foo, FL 20000"), ("p:A", "m", "10 WILLOWDALE ROAD LAKE FOO 20000"), ("m:A", "m", "10 wilowdale rd., 20000"), ("p:B", "m", "10 Willowdale Rd Apt 2, Lake Foo, FL 20000"), ("p:C", "n", "10 Willowdale Rd, Lake Foo, FL 20000"), ("m:D", "m", "PO Box 7, 20000"), ("e:2", "m", "P O BOX 7 LAKE FOO FL"), ("e:3", "m", None), ("e:4", "m", ""), ("e:5", None, "PO Box 7, 20000"), ("e:1", "m", "10 Willowdale Rd, Lake Foo, FL 20000"), ("e:6", "m", "y" * 5000)]
    df = spark.createDataFrame([(*r, "c", "k") for r in rows], "record string, market string, address string, cls string, city string")
    assert pairs(same_locations(df)) == {("e:1", "p:A"), ("e:1", "m:A"), ("m:A", "p:A"), ("e:2", "m:D")}
    assert same_locations(df.limit(0)).count() == 0


def test_parse_name():
    for text in ("Lee, Robert Q. Jr", "ROBERT Q LEE JUNIOR", "Lee Bob Q JR ET UX", "Mr. Bob Q. Lee, Jr."):
        assert tuple(parse_name(text)) == ("P", "LEE", "ROBERT", "Q", "JR"), text
    for text in ("Oakfield & Elmham Holdings No. 3, L.L.C.", "THE OAKFIELD-ELMHAM HLDGS III LIMITED LIABILITY COMPANY", "Holdings, OakfieldElmham Three LLC (FL)"):
        assert tuple(parse_name(text)) == ("O", "OAKFIELDELMHAM", "HOLDINGS", "3", "LLC"), text
    assert parse_name("r. c lee")[:4] == ("P", "LEE", "R", "C")
    for odd in (None, "", "  ", "123", ",", "&", "A", "ET AL", "x" * 100000, "Jr."):
        parse_name(odd)
    assert given_name("JACQEULINE") == "JACQUELINE" and given_name("ZZZZZZ") == ""


def test_same_names(spark):
    rows = [("e:1", "m", "Robert Willowdale"), ("e:2", "m", "WILLOWDALE BOB"), ("o:A", "m", "Willowdale, Robert Q"), ("o:B", "m", "WILOWDALE ROBERT"), ("o:C", "m", "R WILLOWDALE"), ("o:D", "m", "Rita Willowdale"), ("e:3", "n", "Robert Willowdale"), ("e:4", "m", "Oakfield Holdings 2 LLC"), ("o:E", "m", "OAKFIELD HLDGS II"), ("o:F", "m", "OAKFIELD HLDGS III LLC"), ("e:5", "m", "Ann Elmham Sr"), ("o:G", "m", "ELMHAM ANN JR"), ("e:6", "m", None), ("e:7", "m", ""), ("e:8", None, "Ann Elmham Sr"), ("e:1", "m", "Robert Willowdale")]
    df = spark.createDataFrame([(*r, "f", "k") for r in rows], "record string, market string, name string, form string, kind string")
    got = pairs(same_names(df))
    assert {("e:1", "e:2"), ("e:1", "o:A"), ("e:2", "o:A"), ("e:1", "o:B"), ("e:4", "o:E")} <= got
    assert not any("o:D" in p or "o:F" in p or "o:G" in p or "e:3" in p or (p[0][0] == p[1][0] == "o") for p in got)
    assert same_names(df.limit(0)).count() == 0


def test_names_with_errors_in_the_middle(spark):
    names = ["OSEMNER RICHARD", "OSENER RICHARD", "ZELACBY JOSEPH", "ZELCABY JOSEPH", "ULORTHAM JOSEPH S", "ULOTRHAM JOSEPH S", "OAKFEILDELHMAM HOLDINGS 2 LLC", "OAKFIELDELMHAM HOLDINGS 2 LLC"]
    df = spark.createDataFrame([(f"e:{i}", "m", n) for i, n in enumerate(names)], "record string, market string, name string")
    assert {("e:0", "e:1"), ("e:2", "e:3"), ("e:4", "e:5")} <= pairs(same_names(df))


def test_near_cores_equal_brute_force(spark):
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(7)
    cores = set()
    for size in range(1, 20):
        for _ in range(4):
            base = "".join(rng.choices("ABCD", k=size))
            cores.add(base)
            for _ in range(6):
                w = list(base)
                for _ in range(rng.randint(1, 2)):
                    i = rng.randrange(len(w) + 1)
                    w[i : i + rng.randint(0, 1)] = rng.choices("ABCD", k=rng.randint(0, 1))
                cores.add("".join(w))
    cores = sorted(cores - {""})
    df = spark.createDataFrame([(i, "m", "P", c) for i, c in enumerate(cores)], "core_id bigint, market string, kind string, core string")
    want = {(i, j, d) for i, a in enumerate(cores) for j, b in enumerate(cores) if abs(len(a) - len(b)) < 3 and ((d := distance(a, b)) == 0 or d == 1 and len(b) > 4 or d == 2 and len(b) > 6)}
    assert len(want) > 1000 and pairs(near_cores(df)) == want


ENTITIES = "id bigint, name string, registered_agent string, primary_address string, sunbiz_document_number string, l_core string, block string"
REGISTRY = "document_number string, name string, registered_agent string, principal_address string, mailing_address string, confidence string"


def test_registry_links(spark):
    company = [(f"L{i:03}", f"{n} ELMHAM HOLDINGS LLC", f"{a} PELDON", f"{100 + i} OAKFIELD RD, X FL 2000{i % 3}", None, "x") for i, (n, a) in enumerate([("OAKFIELD", "JOHN"), ("BIRCHMERE", "RUTH"), ("CEDARVALE", "OMAR"), ("DAWNHURST", "OLGA"), ("EASTWICK", "IVAN"), ("FENLOCK", "WEI")])]
    registry = spark.createDataFrame([*company, ("L900", "OAKFIELD ELMHAM HOLDINGS LLC", "ANN OTHER", "9 FAR ST, Y FL 20009", None, "x"), ("L901", "OAKFIELD ELMHAM HOLDINGS II LLC", "JOHN PELDON", "100 OAKFIELD RD, X FL 20000", None, "x"), (None, "OAKFIELD ELMHAM HOLDINGS LLC", None, None, None, "x"), ("L902", None, None, None, None, "x"), company[1]], REGISTRY)
    rows = [(i, n.title().replace("Llc", "L.L.C."), a, p, None, "c", "b") for i, (_, n, a, p, _, _) in enumerate(company)]
    rows += [(50, "OAKFIELD-ELMHAM HLDGS", "Peldon, J", None, "N/A", "c", "b"), (51, "Nowhere Holdings LLC", None, None, "", "c", "b"), (52, "OAKFIELD ELMHAM HOLDINGS LLC", "JOHN PELDON", None, "L777", "c", "b"), (53, None, None, None, None, "c", "b"), (54, "John Peldon", "x", "y", None, "c", "b"), (None, "OAKFIELD ELMHAM HOLDINGS LLC", None, None, None, "c", "b")]
    got = {r.entity_id: (r.document_number, r.confidence) for r in registry_links(spark.createDataFrame(rows, ENTITIES), registry).collect()}
    assert {k: v[0] for k, v in got.items()} == {**{i: f"L{i:03}" for i in range(6)}, 50: "L000"}
    assert all(0.5 <= c <= 1 for _, c in got.values())
    empty = spark.createDataFrame([], REGISTRY)
    assert registry_links(spark.createDataFrame(rows, ENTITIES), empty).count() == 0


def test_em_without_pairs():
    assert expectation_maximisation([])[0] == 0.1


def test_streets_without_a_type():
    assert parse("12 Rolling Green Hills, Ocala FL 34470")[2] == "ROLLING GREEN HILLS"
    assert parse("12 Mill Ridge Ocala FL 34470")[2:] == ("MILL RIDGE OCALA", "", "", "?", "34470")
    assert parse("10 Martin Luther King Junior Memorial Dr, Ocala")[2:4] == ("MARTIN LUTHER KING JUNIOR MEMORIAL", "DR")
    assert parse("12 Park Place Dr, Ocala, FL")[2:4] == ("PARK PLACE", "DR")
    assert parse("12 Peachtree St, Atlanta GA 30301")[5] == "ATLANTA"
    assert parse("123 1/2 Main St, Ocala")[:3] == ("123H12", "", "MAIN") and parse("123A Main St, Ocala")[0] == "123A"
    assert parse("12 Oak Dr St Petersburg FL 33701")[2:6] == ("OAK", "DR", "", "ST PETERSBURG")


def test_locations_outside_the_usual(spark):
    rows = [
        ("e:1", "m", "12 Mill Ridge Ocala FL 34470"), ("e:2", "m", "12 Mill Creek Ocala FL 34470"), ("e:3", "m", "12 MILL RIDGE, OCALA, FL 34470"), ("e:4", "m", "12 mill creek, ocala"),
        ("e:5", "m", "12 Rolling Green Hills, Ocala FL 34470"), ("e:6", "m", "12 Rolling Meadow View, Ocala FL 34470"), ("e:7", "m", "12 Rolling Grene Hills Ocala FL"),
        ("e:8", "m", "10 Martin Luther King Junior Memorial Dr, Ocala"), ("e:9", "m", "10 Martin Luther King Jr Memorial Drive, Ocala"), ("p:A", "m", "10 Martin Luther Way, Ocala"),
        ("p:B", "m", "123 1/2 Main St, Ocala"), ("p:C", "m", "123 Main St, Ocala"), ("p:D", "m", "123-1/2 MAIN STREET OCALA"),
        ("p:E", "m", "14 Birch NE Ocala FL 34470"), ("p:F", "m", "14 NE Birch, Ocala"), ("p:G", "m", "14 SE Birch, Ocala"),
    ]
    df = spark.createDataFrame(rows, "record string, market string, address string")
    assert pairs(same_locations(df)) == {("e:1", "e:3"), ("e:2", "e:4"), ("e:5", "e:7"), ("e:8", "e:9"), ("p:B", "p:D"), ("p:E", "p:F")}


def test_names_outside_the_dictionary(spark):
    """Word order is learnt from other records, or read alike where none tells."""
    rows = [
        ("e:1", "m", "Zainab Okafor"), ("e:2", "m", "OKAFOR ZAINAB"), ("e:3", "m", "Okafor, Zainab"), ("e:4", "m", "Adeyemi Tunde"), ("e:5", "m", "Tunde Adeyemi"),
        ("e:6", "m", "Siobhan Q Kelly"), ("e:7", "m", "KELLY SIOBHAN"), ("e:8", "m", "TANAKA, HIROSHI"), ("o:A", "m", "Hiroshi Tanaka"), ("e:9", "m", "Okafor Hiroshi"), ("e:10", "m", "Tunde Okafor"),
    ]
    df = spark.createDataFrame(rows, "record string, market string, name string")
    assert pairs(same_names(df)) == {("e:1", "e:2"), ("e:1", "e:3"), ("e:2", "e:3"), ("e:4", "e:5"), ("e:6", "e:7"), ("e:8", "o:A")}


def test_a_chain_of_twenty(spark):
    forms = spark.createDataFrame([(i,) for i in range(21)], "form bigint")
    import landweave.llm.attribution as module

    whole = module.attachments
    module.attachments = lambda _: spark.createDataFrame([(i, i + 1) for i in range(20)], "form bigint, to bigint")
    try:
        assert {tuple(r) for r in module.canonical(forms).collect()} == {(i, 20) for i in range(21)}
    finally:
        module.attachments = whole
