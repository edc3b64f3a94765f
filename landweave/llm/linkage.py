"""Probabilistic record linkage of companies to a registry that shares no key with them.

Candidate pairs come from several blocking passes, each on a part of the name alone or with the address or the agent.
A pair is compared attribute by attribute at agreement levels; expectation-maximisation over the counted patterns of
levels estimates how often matches and non-matches show each level, and the posterior is the confidence of a match.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landweave.llm.names import BUSINESS, parse_name, squeezed
from landweave.llm.postal import OPEN, parse
from landweave.session import cut_lineage, ship

#: Attributes and their levels. 0 is disagreement; MISSING says nothing.
ATTRIBUTES = ("core", "kind_of_business", "number", "form", "agent", "address")
MISSING = -1
#: Where EM starts: the chance of each level among matches and among non-matches.
START = {
    "core": ({0: 0.02, 1: 0.18, 2: 0.80}, {0: 0.90, 1: 0.05, 2: 0.05}),
    "kind_of_business": ({0: 0.02, 1: 0.98}, {0: 0.85, 1: 0.15}),
    "number": ({0: 0.01, 1: 0.99}, {0: 0.30, 1: 0.70}),
    "form": ({0: 0.02, 1: 0.98}, {0: 0.30, 1: 0.70}),
    "agent": ({0: 0.15, 1: 0.10, 2: 0.75}, {0: 0.95, 1: 0.01, 2: 0.04}),
    "address": ({0: 0.25, 1: 0.75}, {0: 0.98, 1: 0.02}),
}


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50, share: float = 0.1):
    """(share of matches, per attribute (levels among matches, among non-matches)) from counted patterns.

    Smoothed by 20 pairs per attribute in the starting proportions, so a level that doesn't occur keeps a chance and the
    two classes stay apart on few data."""
    tables = [tuple(dict(side) for side in START[a]) for a in ATTRIBUTES]
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        weights = []
        for levels, n in patterns:
            m = share * math.prod(t[0][x] for t, x in zip(tables, levels, strict=True) if x != MISSING)
            u = (1 - share) * math.prod(t[1][x] for t, x in zip(tables, levels, strict=True) if x != MISSING)
            weights.append((levels, n * m / (m + u), n * u / (m + u)))
        share = min(0.9, max(1e-4, sum(m for _, m, _ in weights) / total))
        for k, a in enumerate(ATTRIBUTES):
            for side in (0, 1):
                sums = {x: 20.0 * p for x, p in START[a][side].items()}
                for levels, *w in weights:
                    if levels[k] != MISSING:
                        sums[levels[k]] += w[side]
                all_ = sum(sums.values())
                tables[k][side].update({x: v / all_ for x, v in sums.items()})
    return share, tables


def _company(prefix: str) -> list[str]:
    return [f"{prefix}{c}" for c in ("core", "business", "number", "form", "agent_kind", "agent_core", "agent_first")]


def _name_parts(name: str | None, agent: str | None) -> tuple | None:
    n = parse_name(name)
    if n is None or n.kind != "O":
        return None
    a = parse_name(agent)
    if a is None:
        about = ("", "", "")
    elif a.kind == "P":
        about = ("P", a.core, a.first)
    else:  # all letters but those of the legal form: a typing error may hide which word is which
        words = (BUSINESS.get(w, w) for w in squeezed(agent).split())
        about = ("O", "".join(words), "")
    return (n.core, n.first, n.middle, n.extra, *about)


def _place(text: str | None) -> tuple:
    p = parse(text)
    # without a corpus of places, an undivided street and place count by their first word
    return (p[0], p[1], p[2].split(" ")[0] if p[5] == OPEN else p[2], p[4], p[6]) if p else ("", "", "", "", "")


_PLACE = ("no", "way", "street", "unit", "zip")


def companies(df: DataFrame, key: str, name: str, agent: str, addresses: list[str], prefix: str) -> DataFrame:
    """Parsed companies (key, parts of name and agent, places array<struct>), one row per row with a company's name."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, n, a, *places in zip(pdf["k"], pdf["n"], pdf["a"], *[pdf[f"p{i}"] for i in range(len(addresses))], strict=True):
                if (parts := _name_parts(n, a)) is not None:
                    seen = [q for p in places if (q := _place(p))[0]]
                    rows.append((k, *parts, [dict(zip(_PLACE, q, strict=True)) for q in seen]))
            yield pd.DataFrame(rows, columns=["k", *_company(prefix), f"{prefix}places"])

    kind = dict(df.dtypes)[key]
    source = ship(df).select(F.col(key).alias("k"), F.col(name).alias("n"), F.col(agent).alias("a"), *[F.col(p).alias(f"p{i}") for i, p in enumerate(addresses)]).where("k is not null and n is not null")
    schema = f"k {kind}, " + ", ".join(f"{c} string" for c in _company(prefix)) + f", {prefix}places array<struct<{', '.join(f'{f}: string' for f in _PLACE)}>>"
    return source.mapInPandas(run, schema).withColumnRenamed("k", f"{prefix}key")


def _blocks(prefix: str) -> Column:
    """The passes: head and tail of the name with the business; head with each house number; head with the agent."""
    core, business = F.col(f"{prefix}core"), F.col(f"{prefix}business")
    by_place = F.transform(f"{prefix}places", lambda p: F.xxhash64(F.lit(3), F.substring(core, 1, 3), p["no"], p["unit"]))
    by_agent = F.when(F.col(f"{prefix}agent_core") != "", F.array(F.xxhash64(F.lit(4), F.substring(core, 1, 3), f"{prefix}agent_core"))).otherwise(F.array().cast("array<bigint>"))
    fixed = F.array(F.xxhash64(F.lit(0), core), F.xxhash64(F.lit(1), F.substring(core, 1, 5), business), F.xxhash64(F.lit(2), F.expr(f"right({prefix}core, 5)"), business))
    return F.array_distinct(F.concat(fixed, by_place, by_agent))


def levels() -> dict[str, Column]:
    """The agreement level of each attribute of a pair of companies with prefixes l_ and r_."""

    def c(n: str) -> Column:
        return F.col(n)

    typos = F.levenshtein("l_core", "r_core", 2)
    core = F.when(typos == 0, 2).when((typos > 0) & (F.length("l_core") > 6), 1).otherwise(0)
    business = (c("l_business") == c("r_business")).cast("int")
    number = (c("l_number") == c("r_number")).cast("int")
    form = F.when((c("l_form") == "") | (c("r_form") == ""), MISSING).otherwise((c("l_form") == c("r_form")).cast("int"))
    la, ra = c("l_agent_first"), c("r_agent_first")
    close = F.levenshtein("l_agent_core", "r_agent_core", 2) >= 0
    initial = (F.length(la) == 1) & ra.startswith(la) | (F.length(ra) == 1) & la.startswith(ra)
    agent = (
        F.when((c("l_agent_core") == "") | (c("r_agent_core") == ""), MISSING)
        .when(close & (la == ra) & (c("l_agent_kind") == c("r_agent_kind")), 2)
        .when(close & initial, 1)
        .otherwise(0)
    )

    def same(p: Column, q: Column) -> Column:
        street = (p["street"] == q["street"]) | (~p["street"].rlike("[0-9]") & (F.length(p["street"]) > 4) & (F.levenshtein(p["street"], q["street"], 2) >= 0))
        return (p["no"] == q["no"]) & (p["unit"] == q["unit"]) & street & ((p["zip"] == q["zip"]) | (p["zip"] == "") | (q["zip"] == "")) & ((p["way"] == q["way"]) | (p["way"] == "") | (q["way"] == ""))

    agree = F.exists("l_places", lambda p: F.exists("r_places", lambda q: same(p, q)))
    address = F.when((F.size("l_places") == 0) | (F.size("r_places") == 0), MISSING).otherwise(agree.cast("int"))
    return dict(zip(ATTRIBUTES, (core, business, number, form, agent, address), strict=True))


def link(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """(l_key, r_key, confidence): for each left company the right key of greatest confidence, if at least ``least``.

    left and right come from ``companies``. A right key that occurs repeatedly counts by its best row; of equally
    confident keys the smaller is taken. Rows without a company's name have no links; empty tables give none."""
    a = left.select("*", F.explode(_blocks("l_")).alias("block"))
    b = right.select("*", F.explode(_blocks("r_")).alias("block"))
    pairs = a.join(b, "block").where(F.levenshtein("l_core", "r_core", 2) >= 0)
    compared = cut_lineage(pairs.select("l_key", "r_key", *[v.cast("int").alias(n) for n, v in levels().items()]).distinct())
    counted = compared.groupBy(*ATTRIBUTES).count().collect()  # at most the number of patterns of levels
    share, tables = expectation_maximisation([(tuple(r[a] for a in ATTRIBUTES), r["count"]) for r in counted])
    log_odds = F.lit(math.log(share / (1 - share)))
    for a_, (m, u) in zip(ATTRIBUTES, tables, strict=True):
        weight = F.lit(0.0)
        for x in m:
            weight = F.when(F.col(a_) == x, math.log(m[x] / u[x])).otherwise(weight)
        log_odds = log_odds + weight
    # what the attributes together rule out: another name, number, business or legal form; a namesake elsewhere
    other = (F.col("core") == 0) | (F.col("kind_of_business") == 0) | (F.col("number") == 0) | (F.col("form") == 0) | ((F.col("agent") == 0) & (F.col("address") == 0))
    scored = compared.where(~other).withColumn("confidence", 1 / (1 + F.exp(-log_odds)))
    best = scored.groupBy("l_key", "r_key").agg(F.max("confidence").alias("confidence"))
    w = W.partitionBy("l_key").orderBy(F.desc("confidence"), "r_key")
    return best.withColumn("_r", F.row_number().over(w)).where((F.col("_r") == 1) & (F.col("confidence") >= least)).drop("_r")


def registry_links(entities: DataFrame, registry: DataFrame, least: float = 0.5) -> DataFrame:
    """(entity_id, document_number, confidence) of entities whose own number has no digit."""
    open_ = entities.where(~F.coalesce(F.col("sunbiz_document_number").rlike("[0-9]"), F.lit(False)))
    left = companies(open_, "id", "name", "registered_agent", ["primary_address"], "l_")
    right = companies(registry, "document_number", "name", "registered_agent", ["principal_address", "mailing_address"], "r_")
    return link(left, right, least).select(F.col("l_key").alias("entity_id"), F.col("r_key").alias("document_number"), "confidence")
