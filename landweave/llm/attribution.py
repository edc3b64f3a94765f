"""Variant spellings of names, attributed to canonical forms by a noisy channel.

Names are parsed to parts and equal ones counted as one form. Which word of a name is the given one is learnt from the
corpus where the name itself does not tell: names with a comma, an initial or a usual given name show how often a word
stands in either place. A form may be a variant of any form of its market that is at least as complete in every part and,
if equally complete, more frequent. Its posterior is the frequency of that form times the likelihood that the channel
turns it into the variant: typing errors in the core, a given name cut to its initial, parts left out. The alternative is
that the form is a name of its own. Each form is attached to its maximum, and attachments are followed to their ends.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.llm.names import read_name
from landweave.session import cut_lineage, ship

FIELDS = ("kind", "core", "first", "middle", "extra")
#: Logarithms of likelihoods.
ONE_ERROR, TWO_ERRORS, INITIAL, NO_MIDDLE, NO_EXTRA, OWN_NAME = -4.0, -5.5, -2.5, -0.7, -0.7, -7.0


def named(records: DataFrame) -> DataFrame:
    """(record, market, *FIELDS, other) of records (record, market, name) whose name has a letter; ``other`` (core, first)
    is given where a name may be read in the other order as well."""

    def run(batches):
        for pdf in batches:
            read = [(r, m, x) for r, m, n in zip(pdf["record"], pdf["market"], pdf["name"], strict=True) if (x := read_name(n)) is not None]
            rows = [(r, m, *p, q and q.core, q and q.first) for r, m, (p, q) in read]
            yield pd.DataFrame(rows, columns=["record", "market", *FIELDS, "other_core", "other_first"])

    return ship(records).select("record", "market", "name").where("record is not null and market is not null and name is not null").mapInPandas(run, "record string, market string, " + ", ".join(f"{f} string" for f in (*FIELDS, "other_core", "other_first")))


def oriented(rows: DataFrame) -> DataFrame:
    """(record, market, *FIELDS, form): names that may be read in two orders are read as their words usually stand.

    A reading counts by how often its surname is one in other records, times how often its given name is one; of equal
    readings that with the surname first in alphabetical order is taken, whichever way the name was written."""
    told = rows.where("kind = 'P' and other_core is null and length(first) > 1")
    places = told.select(F.explode(F.array(F.struct(F.col("core").alias("word"), F.lit(1).alias("last")), F.struct(F.col("first").alias("word"), F.lit(0).alias("last")))).alias("x"))
    counts = places.groupBy("x.word").agg(F.sum("x.last").alias("last"), F.sum(1 - F.col("x.last")).alias("given"))
    names = ["core", "first", "other_core", "other_first"]
    both = rows.where("other_core is not null").select(*names).distinct()
    # one join for the four words of a pair
    asked = both.select(*names, F.posexplode(F.array(*names)).alias("_i", "word")).join(counts.hint("merge"), "word", "left")
    n = F.coalesce(F.when(F.col("_i") % 2 == 0, F.col("last")).otherwise(F.col("given")), F.lit(0)) + 0.5
    weighed = asked.groupBy(*names).agg(*[F.max(F.when(F.col("_i") == i, n)).alias(f"_{i}") for i in range(4)])
    turned = weighed.where(F.col("_2") * F.col("_3") > F.col("_0") * F.col("_1")).select(*names, F.lit(True).alias("_turn"))
    open_ = rows.where("other_core is not null").join(turned.hint("merge"), names, "left")
    other = F.col("_turn").isNotNull()
    open_ = open_.withColumns({"core": F.when(other, F.col("other_core")).otherwise(F.col("core")), "first": F.when(other, F.col("other_first")).otherwise(F.col("first"))})
    parts = rows.where("other_core is null").select("record", "market", *FIELDS).unionByName(open_.select("record", "market", *FIELDS))
    return parts.withColumn("form", F.xxhash64("market", *[F.concat_ws("", f) for f in FIELDS], F.concat_ws("|", *FIELDS)))


def near_cores(forms: DataFrame, short: int = 11) -> DataFrame:
    """(a, b, errors): ids of all cores of one market and kind that the channel may take for each other, each also with
    itself. Complete for up to one error in a core of 5 or 6 letters and up to two in a longer one.

    Cores of up to ``short`` letters meet if they are the same after at most one deletion each (two from 7 letters on).
    Longer ones meet by thirds: two errors leave one third of the shorter core whole, at a place in the longer one that
    is shifted by no more than the errors before and behind it allow."""
    cores = forms.select("core_id", "market", "kind", "core").distinct()
    n = "length(core)"
    one = f"transform(sequence(1, {n}), i -> concat(left(core, i - 1), substring(core, i + 1)))"
    two = f"flatten(transform(sequence(1, {n} - 1), i -> transform(sequence(i + 1, {n}), j -> concat(left(core, i - 1), substring(core, i + 1, j - i - 1), substring(core, j + 1)))))"
    deletions = F.expr(f"array_distinct(CASE WHEN {n} < 4 OR {n} > {short} THEN array() WHEN {n} < 7 THEN concat(array(core), {one}) ELSE concat(array(core), {one}, {two}) END)")

    def third(length: str, i: int, shift: int) -> str:
        """Key of the i-th third of a core of that length; null where the shift leads out of the core."""
        start = f"CAST(floor({i} * ({length}) / 3) AS INT)"
        size = f"CAST(floor({i + 1} * ({length}) / 3) AS INT) - {start}"
        inside = f"{start} + {shift} >= 0 AND {start} + {shift} + {size} <= {n} AND {length} >= {short - 1}"
        return f"CASE WHEN {inside} THEN concat_ws('|', {length}, {i}, substring(core, {start} + {shift} + 1, {size})) END"

    held = F.expr("array(" + ", ".join(third(n, i, 0) for i in range(3)) + ")")
    sought = F.expr("array(" + ", ".join(third(f"({n} - {d})", i, s) for d in range(3) for i in range(3) for s in range(-2, 3) if abs(s) + abs(d - s) <= 2) + ")")

    def keyed(keys, x: str) -> DataFrame:
        k = cores.select(F.explode(keys).alias("key"), "market", "kind", F.col("core_id").alias(x), F.col("core").alias(f"{x}_core")).where("key is not null")
        return k.select(F.xxhash64("market", "kind", "key").alias("key"), x, f"{x}_core")

    met = [keyed(deletions, "a").join(keyed(deletions, "b").hint("merge"), "key").where("a < b"), keyed(sought, "a").join(keyed(held, "b").hint("merge"), "key").where("a != b")]
    errors = F.levenshtein("a_core", "b_core", 2)
    pairs = met[0].unionByName(met[1]).select("a", "b", errors.alias("errors"), F.length("a_core").alias("a_n"), F.length("b_core").alias("b_n")).where("errors > 0").distinct()
    both = pairs.unionByName(pairs.select(F.col("a").alias("b"), F.col("b").alias("a"), "errors", F.col("a_n").alias("b_n"), F.col("b_n").alias("a_n")))
    # what the channel takes for a variant depends on the length of the canonical core, b
    possible = both.where("errors = 1 and b_n > 4 or errors = 2 and b_n > 6").select("a", "b", "errors").distinct()
    return possible.unionByName(cores.select(F.col("core_id").alias("a"), F.col("core_id").alias("b"), F.lit(0).alias("errors")))


def attachments(forms: DataFrame) -> DataFrame:
    """(form, to): the canonical form of every form that is not its own.

    Forms meet if they agree in the initial (of organisations in business and number) and their cores are the same or
    as near as the channel allows; so a surname that a large share of a market bears is cut by initials."""
    person = F.col("kind") == "P"
    rest = F.when(person, F.substring("first", 1, 1)).otherwise(F.concat_ws("|", "first", "middle"))
    forms = forms.withColumn("core_id", F.xxhash64("market", "kind", "core"))
    keyed = forms.select("core_id", rest.alias("rest"), "form", *FIELDS, "n")
    v = keyed.select(F.col("core_id").alias("a"), "rest", F.col("form").alias("v"), *[F.col(f).alias(f"v_{f}") for f in FIELDS], F.col("n").alias("vn"))
    c = keyed.select(F.col("core_id").alias("b"), "rest", F.col("form").alias("c"), *[F.col(f).alias(f"c_{f}") for f in FIELDS], F.col("n").alias("cn"))

    def col(s: str):
        return F.col(s)

    p = col("v_kind") == "P"
    errors = F.col("errors")
    typed = F.when(errors == 0, 0.0).when((errors == 1) & (F.length("c_core") > 4), ONE_ERROR).when((errors == 2) & (F.length("c_core") > 6), TWO_ERRORS)
    cut = (F.length("v_first") <= 1) & (F.length("c_first") > 1) & col("c_first").startswith(col("v_first"))
    first = F.when(col("v_first") == col("c_first"), 0.0).when(p & cut, INITIAL).when(p & (F.length("v_first") > 3) & (F.length("c_first") > 3) & F.levenshtein("v_first", "c_first", 1).between(1, 1) & (errors == 0), ONE_ERROR)
    middle = F.when(col("v_middle") == col("c_middle"), 0.0).when(p & (col("v_middle") == ""), NO_MIDDLE)
    extra = F.when(col("v_extra") == col("c_extra"), 0.0).when(col("v_extra") == "", NO_EXTRA)
    fuller = (F.length("v_first") < F.length("c_first")) & cut | (col("v_middle") != col("c_middle")) | (col("v_extra") != col("c_extra"))
    above = fuller | (col("cn") > col("vn")) | ((col("cn") == col("vn")) & (col("c") < col("v")))
    # every record of the variant would have had the same typing error, while a part left out is a habit
    score = F.log("cn") + typed * col("vn") + first + middle + extra
    met = v.join(near_cores(forms).hint("merge"), "a").join(c.hint("merge"), ["b", "rest"]).where(col("v") != col("c")).where(F.when(p, F.lit(True)).otherwise((col("v_first") == col("c_first")) & (col("v_middle") == col("c_middle"))))
    scored = met.withColumn("score", score).where(above & (col("score") > OWN_NAME + F.log("vn")))
    return scored.groupBy("v").agg(F.max_by("c", F.struct("score", "cn", "c")).alias("to")).withColumnRenamed("v", "form")


def canonical(forms: DataFrame) -> DataFrame:
    """(form, root) of all forms; attachments are followed to their ends by doubling, however long the chains are.

    Each attachment leads to a fuller or, if as full, more frequent form, so there are no circles. The lineage is cut in
    every round."""
    up = cut_lineage(forms.select("form").join(attachments(forms).hint("merge"), "form", "left").select("form", F.coalesce("to", "form").alias("root")))
    while True:
        # ends lead to themselves and need no step
        steps = up.where("form != root").toDF("root", "_next")
        nxt = cut_lineage(up.join(steps.hint("merge"), "root", "left").select("form", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        up = nxt.drop("_moved")
        if nxt.where("_moved").isEmpty():
            return up


def same_names(records: DataFrame) -> DataFrame:
    """(record_a, record_b): pairs of one market that mean the same person or organisation; records whose key starts
    with ``o:`` are not paired with each other. Smaller key first; null names and names without a letter are in no pair.

    Both sides of all joins grow with the data, so none is broadcast. A repeated record counts once. One name that a large share of all records bear is one form until the final join."""
    rows = cut_lineage(oriented(cut_lineage(named(records))))
    members = rows.select("record", "form").distinct()
    forms = rows.groupBy("form").agg(*[F.min(f).alias(f) for f in ("market", *FIELDS)], F.count(F.lit(1)).alias("n"))
    rooted = members.join(canonical(forms).hint("merge"), "form").select("record", "root")
    entities = rooted.where(~F.col("record").startswith("o:")).toDF("ra", "root")
    return entities.join(rooted.toDF("rb", "root").hint("merge"), "root").where((F.col("ra") < F.col("rb")) | F.col("rb").startswith("o:")).where("ra != rb").select(F.least("ra", "rb").alias("record_a"), F.greatest("ra", "rb").alias("record_b")).distinct()
