"""Which address records denote the same location.

Records are parsed to typed tokens in canonical spelling and equal ones put into a class. Classes meet in MinHash bands:
the tokens that never vary, house number and unit (another number is another location, so no candidate is lost), together
with a minimum of hashes of the street name's words and two-letter shingles. Candidates are verified by an alignment of
their tokens with affine gaps. Substitutions cost by edit distance, and next to nothing where a dictionary of abbreviations
says that both are one word (that of directions and street types is applied by the parser); gaps by the kind of token. A direction or street
type may be missing only where the corpus says so: if the street hardly ever occurs without it, and in one form only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landweave.llm.postal import DIRECTIONS, OPEN, PLACE_WORDS, parse
from landweave.llm.strings import osa
from landweave.session import cut_lineage, ship

PARTS = ("number", "way", "street", "kind", "unit", "city", "zip")
NEVER = 9.0
#: Opening and extending a gap, by kind of token.
GAPS = {"number": (NEVER, NEVER), "unit": (NEVER, NEVER), "street": (NEVER, NEVER), "city": (0.3, 0.05), "zip": (0.3, 0.05), "way": (NEVER, NEVER), "kind": (NEVER, NEVER), "way?": (1.0, 1.0), "kind?": (1.0, 1.0)}
ACCEPT = 3.4


def parsed(records: DataFrame) -> DataFrame:
    """(record, market, *parts) of records (record, market, address); those that hold no number are left out."""

    def run(batches):
        for pdf in batches:
            rows = [(r, m, *p) for r, m, a in zip(pdf["record"], pdf["market"], pdf["address"], strict=True) if (p := parse(a)) is not None]
            yield pd.DataFrame(rows, columns=["record", "market", *PARTS])

    return ship(records).select("record", "market", "address").where("record is not null and market is not null and address is not null").mapInPandas(run, "record string, market string, " + ", ".join(f"{p} string" for p in PARTS))


def with_place(rows: DataFrame) -> DataFrame:
    """Divides street and place where the text did not: the longest end of the street's words that is a place of the
    market in other records, or, if long, within two typing errors of one. What is no known place stays with the street."""
    words = F.split("street", " ")
    known = rows.where((F.col("city") != "") & (F.col("city") != OPEN)).select("market", "city").distinct()
    streets = rows.where(F.col("city") == OPEN).select("market", "street").distinct()
    ends = streets.withColumn("_k", F.explode(F.sequence(F.lit(1), F.size(words) - 1))).withColumn("city", F.array_join(F.slice(words, F.size(words) - F.col("_k") + 1, F.col("_k")), " "))

    def keys(name: str) -> Column:
        """A typing error in a long name leaves its head or its tail."""
        c = F.col(name)
        return F.explode(F.array(F.concat(F.lit("<"), F.substring(c, 1, 4)), F.concat(F.lit(">"), F.right(c, F.lit(4)))))

    words_in = F.size(F.split("city", " "))
    near = ends.withColumn("_key", keys("city")).join(known.select("market", F.col("city").alias("_known"), keys("city").alias("_key"), words_in.alias("_k")), ["market", "_key", "_k"])
    near = near.where((F.length("_known") > 7) & (F.levenshtein("city", "_known", 2) >= 0)).select("market", "street", "_k")
    best = ends.join(known, ["market", "city"]).select("market", "street", "_k").unionByName(near).groupBy("market", "street").agg(F.max("_k").alias("_k"))
    need = rows.where(F.col("city") == OPEN).join(best, ["market", "street"], "left")
    k = F.coalesce("_k", F.lit(0))
    place, rest = F.array_join(F.slice(words, F.size(words) - k + 1, k), " "), F.slice(words, 1, F.size(words) - k)
    # a direction may follow the street's name
    directions = F.create_map(*[F.lit(x) for pair in DIRECTIONS.items() for x in pair])
    behind = F.when((F.col("way") == "") & (F.size("_rest") > 1), directions[F.element_at("_rest", -1)])
    need = need.withColumns({"city": place, "_rest": rest}).withColumn("_way", behind)
    street = F.array_join(F.when(F.col("_way").isNull(), F.col("_rest")).otherwise(F.slice("_rest", 1, F.size("_rest") - 1)), " ")
    return rows.where(F.col("city") != OPEN).unionByName(need.withColumns({"way": F.coalesce("_way", "way"), "street": street}).select(*rows.columns))


def with_zip(rows: DataFrame) -> DataFrame:
    """Fills a missing zip by the one that goes with the city in the market."""
    seen = rows.where("zip != '' and city != ''").groupBy("market", "city", "zip").agg(F.count(F.lit(1)).alias("n"))
    best = seen.groupBy("market", "city").agg(F.max_by("zip", F.struct("n", "zip")).alias("_zip"))
    need = rows.where("zip = ''").join(best, ["market", "city"], "left").withColumn("zip", F.coalesce("_zip", "zip")).drop("_zip")
    return rows.where("zip != ''").unionByName(need)


def classes(rows: DataFrame) -> DataFrame:
    """Distinct addresses (cls, market, *parts, n); the city counts only where the zip is unknown."""
    city = F.when(F.col("zip") == "", F.col("city")).otherwise("")
    keyed = rows.withColumn("_city", city).withColumn("cls", F.xxhash64("market", *[F.concat_ws("|", p) for p in ("number", "way", "street", "kind", "unit", "zip", "_city")]))
    return keyed


def street_forms(cls: DataFrame, least: float = 0.25) -> DataFrame:
    """Of each street (market, zip, street): its forms way|kind that make up at least ``least`` of what can be told.

    ``ways``: per kind; ``kinds``: of the street; a form that is rarer is taken for one with a part left out."""
    by = cls.where("street != ''").groupBy("market", "zip", "street", "way", "kind").agg(F.sum("n").alias("n"))
    of_kind = W.partitionBy("market", "zip", "street", "kind")
    shares = by.withColumn("_all", F.sum("n").over(of_kind)).withColumn("_street", F.sum("n").over(W.partitionBy("market", "zip", "street")))
    real = shares.withColumn("_real", F.col("n") >= F.col("_all") * least)
    forms = real.groupBy("market", "zip", "street").agg(
        F.max("_street").alias("known"),
        F.array_sort(F.collect_set(F.when(F.col("_real") & (F.col("kind") != ""), F.concat_ws("|", "kind", "way")))).alias("ways"),
    )
    kinds = real.where("kind != ''").groupBy("market", "zip", "street", "kind").agg(F.sum("n").alias("n"), F.max("_street").alias("_s")).where(F.col("n") >= F.col("_s") * least)
    return forms.join(kinds.groupBy("market", "zip", "street").agg(F.array_sort(F.collect_set("kind")).alias("kinds")), ["market", "zip", "street"], "left")


def band_keys(text: Column, bands: int) -> Column:
    """Minima of hashes of the two-letter shingles of a name, then two of its words; a number or an empty name is one
    shingle."""
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    shingles = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substr(padded, i, F.lit(2)))
    grams = F.when(text.rlike("[0-9]") | (text == ""), F.array(text)).otherwise(shingles)

    def least(of: Column, seed: int) -> Column:
        return F.array_min(F.transform(of, lambda g: F.xxhash64(F.lit(seed), g)))

    return F.array(*[least(grams, i) for i in range(bands)], *[least(F.split(text, " "), -1 - i) for i in range(2)])


def candidates(cls: DataFrame, bands: int = 8) -> DataFrame:
    """(a, b): pairs of classes that share a band."""
    rows = cls.select("cls", F.posexplode(band_keys(F.col("street"), bands)).alias("band", "_h"), "market", "number", "unit").select("cls", F.xxhash64("market", "number", "unit", "band", "_h").alias("key"))
    a, b = rows.toDF("a", "key"), rows.toDF("b", "key")
    return a.join(b, "key").where("a < b").select("a", "b").distinct()


def _tokens(parts: tuple, loose_way: bool, loose_kind: bool) -> list[tuple[str, str]]:
    number, way, street, kind, unit, city, zip_ = parts
    out = [("number", number)]
    if way:
        out.append(("way?" if loose_way else "way", way))
    out += [("street", w) for w in street.split()]
    if kind:
        out.append(("kind?" if loose_kind else "kind", kind))
    if unit:
        out.append(("unit", unit))
    out += [("city", w) for w in city.split()]
    if zip_:
        out.append(("zip", zip_))
    return out


def substitution(a: tuple[str, str], b: tuple[str, str]) -> float:
    """Cost of one token for another."""
    kind, x = a[0].rstrip("?"), a[1]
    if kind != b[0].rstrip("?"):
        return NEVER
    y = b[1]
    if x == y:
        return 0.0
    if kind in ("street", "city") and PLACE_WORDS.get(x, x) == PLACE_WORDS.get(y, y):
        return 0.1
    if kind == "street" and not (x.isdigit() or y.isdigit()):
        d = osa(x, y, 2)
        return 1.0 if d == 1 and min(len(x), len(y)) > 3 else 1.6 if d == 2 and min(len(x), len(y)) > 5 else NEVER
    if kind == "city":
        d = osa(x, y, 2)
        return 0.3 * d if d <= 2 and min(len(x), len(y)) > 3 else NEVER
    return NEVER


def alignment_cost(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> float:
    """Least cost of aligning two token lists with affine gaps."""
    far = 1e9
    n = len(b)
    met, left, up = [0.0] + [far] * n, [far] * (n + 1), [far] * (n + 1)  # ends in a match, a gap in a, a gap in b
    for j in range(1, n + 1):
        o, e = GAPS[b[j - 1][0]]
        left[j] = min(left[j - 1] + e, met[j - 1] + o)
    for x in a:
        o, e = GAPS[x[0]]
        met1, left1, up1 = [far], [far], [min(up[0] + e, met[0] + o)]
        for j in range(1, n + 1):
            y = b[j - 1]
            met1.append(min(met[j - 1], left[j - 1], up[j - 1]) + substitution(x, y))
            up1.append(min(up[j] + e, min(met[j], left[j]) + o))
            oy, ey = GAPS[y[0]]
            left1.append(min(left1[j - 1] + ey, min(met1[j - 1], up1[j - 1]) + oy))
        met, left, up = met1, left1, up1
    return min(met[n], left[n], up[n])


def same_place(a: tuple, b: tuple, ways: list[str] | None, kinds: list[str] | None) -> bool:
    """Whether two parsed addresses denote one location; ways and kinds are the forms of the better known street."""
    if any(x and y and x != y for x, y in ((a[1], b[1]), (a[3], b[3]), (a[6], b[6]))):
        return False
    if not (a[6] and b[6]) and a[5] and b[5] and osa(a[5], b[5], 2) > 2:
        return False
    kinds = kinds or []
    kind = a[3] or b[3]
    loose_kind = len(kinds) == 1 and kind == kinds[0]
    forms = [w.partition("|")[2] for w in ways or [] if w.partition("|")[0] == (kind or (kinds[0] if kinds else ""))]
    loose_way = len(forms) == 1 and forms[0] != "" and forms[0] == (a[1] or b[1])
    whole = a[6] == "" or b[6] == ""
    x, y = (t if whole else (*t[:5], "", t[6]) for t in (a, b))
    return alignment_cost(_tokens(x, loose_way, loose_kind), _tokens(y, loose_way, loose_kind)) <= ACCEPT


def same_locations(records: DataFrame) -> DataFrame:
    """(record_a, record_b): pairs of records (record, market, address) of one market that denote one location, down to
    the unit, smaller key first.

    Null addresses, and addresses without any number, are in no pair. A repeated record counts once. Equally written
    addresses are paired by their class; between classes only verified candidates are."""
    rows = cut_lineage(classes(with_zip(with_place(cut_lineage(parsed(records))))).select("record", "cls", "market", *PARTS))
    members = rows.select("record", "cls").distinct()
    distinct = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("market", *PARTS)])
    forms = street_forms(distinct)
    full = distinct.join(forms, ["market", "zip", "street"], "left").select("cls", F.struct(*PARTS).alias("p"), F.coalesce("known", F.lit(0)).alias("known"), "ways", "kinds")
    pairs = candidates(distinct)
    met = pairs.join(full.toDF("a", "pa", "ka", "wa", "ta"), "a").join(full.toDF("b", "pb", "kb", "wb", "tb"), "b")
    better = F.col("ka") >= F.col("kb")
    met = met.select("a", "b", *[F.col(f"p{s}.{p}").alias(f"{s}_{p}") for s in "ab" for p in PARTS], F.when(better, F.col("wa")).otherwise(F.col("wb")).alias("ways"), F.when(better, F.col("ta")).otherwise(F.col("tb")).alias("kinds"))

    def verify(batches):
        for pdf in batches:
            left = zip(*[pdf[f"a_{p}"] for p in PARTS], strict=True)
            right = zip(*[pdf[f"b_{p}"] for p in PARTS], strict=True)
            ok = [same_place(x, y, w if w is None else list(w), t if t is None else list(t)) for x, y, w, t in zip(left, right, pdf["ways"], pdf["kinds"], strict=True)]
            yield pdf.loc[ok, ["a", "b"]]

    links = met.mapInPandas(verify, "a bigint, b bigint")
    within = members.toDF("ra", "cls").join(members.toDF("rb", "cls"), "cls").where("ra < rb").select("ra", "rb")
    across = links.join(members.toDF("ra", "a"), "a").join(members.toDF("rb", "b"), "b").select("ra", "rb")
    return within.unionByName(across).select(F.least("ra", "rb").alias("record_a"), F.greatest("ra", "rb").alias("record_b")).distinct()
