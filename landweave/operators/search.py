"""Searches by optional criteria, and the caps that keep results diverse."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landweave.operators.rollups import ordering, top_per_group
from landweave.session import ship

#: Orders by name; an unknown name means the last.
ORDERS = {
    "market_value": "market_value DESC NULLS LAST", "recency": "last_sale_date DESC NULLS LAST", "lot_size": "lot_size_acres DESC NULLS LAST", "square_feet": "square_feet DESC NULLS LAST", "sale_price": "last_sale_price DESC NULLS LAST",
    "assessed": "assessed_value DESC NULLS LAST", "year_built": "year_built DESC NULLS LAST", "market_value_recent": "market_value DESC NULLS LAST, last_sale_date DESC NULLS LAST",
}


def conjunction(conditions: list[Column]) -> Column:
    """All conditions; none lets every row pass."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def contains_ci(c: Column, value: str) -> Column:
    """Case-insensitive containment; ``%`` and ``_`` in the value are wildcards."""
    return c.ilike(f"%{value}%")


def null_or(c: Column, condition: Column) -> Column:
    return c.isNull() | condition


@dataclass(frozen=True)
class Criteria:
    """Optional criteria of a parcel search; what is None does not restrict."""

    equal_ci: dict[str, str] = field(default_factory=dict)
    contains: dict[str, str] = field(default_factory=dict)
    lacks: dict[str, list[str]] = field(default_factory=dict)
    least: dict[str, float] = field(default_factory=dict)
    most: dict[str, float] = field(default_factory=dict)
    flags: dict[str, bool] = field(default_factory=dict)
    one_of: dict[str, list[str]] = field(default_factory=dict)
    none_of: dict[str, list[str]] = field(default_factory=dict)
    known: tuple[str, ...] = ()

    def conditions(self) -> list[Column]:
        c = F.col
        out = [F.upper(c(k)) == F.upper(F.lit(v)) for k, v in self.equal_ci.items()]
        out += [contains_ci(c(k), v) for k, v in self.contains.items()]
        out += [~contains_ci(c(k), v) for k, vs in self.lacks.items() for v in vs]
        out += [c(k) >= v for k, v in self.least.items()] + [c(k) <= v for k, v in self.most.items()]
        out += [c(k) == v for k, v in self.flags.items()]
        out += [reduce(lambda a, b: a | b, [contains_ci(c(k), v) for v in vs]) for k, vs in self.one_of.items()]
        out += [~c(k).isin(vs) for k, vs in self.none_of.items()]
        out += [c(k).isNotNull() & (F.trim(c(k).cast("string")) != "") for k in self.known]
        return out


def search(df: DataFrame, criteria: Criteria, order: str = "market_value_recent", limit: int = 20, key: str = "parcel_key") -> DataFrame:
    """The first rows that meet the criteria; three times the limit, at most 500, for later caps to choose from."""
    fetch = min(max(limit, 1) * 3, 500)
    by = ordering(ORDERS.get(order, ORDERS["market_value_recent"]))
    return df.where(conjunction(criteria.conditions())).orderBy(*by, key).limit(fetch)


def _cap(rows: Iterator[pd.DataFrame], key: str, owner: str, per_owner: int, limit: int, order: list[tuple[str, bool]]) -> Iterator[pd.DataFrame]:
    pdf = pd.concat(list(rows), ignore_index=True)
    pdf = pdf.sort_values("_rank", kind="stable")
    seen_keys, seen_spots, owners, kept = set(), set(), {}, []
    for i, row in zip(pdf.index, pdf.to_dict("records"), strict=True):
        spot = None
        if pd.notna(row["latitude"]) and pd.notna(row["longitude"]):
            spot = (round(row["latitude"], 6), round(row["longitude"], 6))
        who = "".join(ch for ch in str(row[owner] or "").upper() if ch.isalnum())
        if row[key] in seen_keys or (spot is not None and spot in seen_spots) or (who and owners.get(who, 0) >= per_owner):
            continue  # a row that is turned away reserves nothing
        seen_keys.add(row[key])
        if spot is not None:
            seen_spots.add(spot)
        owners[who] = owners.get(who, 0) + 1
        kept.append(i)
        if len(kept) == limit:
            break
    yield pdf.loc[kept]


def diversity_cap(found: DataFrame, key: str = "parcel_key", owner: str = "owner_name", per_owner: int = 2, limit: int = 20, order: str = "market_value_recent") -> DataFrame:
    """Of at most 500 found rows, in order, those whose parcel and place are new and whose owner has fewer than
    ``per_owner`` so far, up to ``limit``. A null or empty owner is not capped; both numbers are at least 1."""
    by = [*ordering(ORDERS.get(order, ORDERS["market_value_recent"])), F.asc(key)]
    ranked = ship(found).withColumn("_rank", F.row_number().over(W.orderBy(*by))).coalesce(1)
    per_owner, limit = max(1, per_owner), max(1, limit)
    return ranked.mapInPandas(lambda rows: _cap(rows, key, owner, per_owner, limit, []), ranked.schema).withColumnRenamed("_rank", "place")


def owner_cap(df: DataFrame, owner: str, per_owner: int, order: str, key: str = "parcel_key") -> DataFrame:
    """At most ``per_owner`` rows of each owner, by a window alone."""
    return top_per_group(df, [owner], [*ordering(ORDERS.get(order, ORDERS["market_value_recent"])), F.asc(key)], per_owner)


def populated(columns: list[str]) -> Column:
    """How many of the columns have a value."""
    return reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in columns])


def owner_class(name: Column, company_words: list[str]) -> Column:
    """``llc``, ``company`` if any of the words occurs, else ``individual``."""
    u = F.upper(name)
    return F.when(u.contains("LLC"), "llc").when(reduce(lambda a, b: a | b, [u.contains(w) for w in company_words]), "company").otherwise("individual")


def find_text(documents: DataFrame, words: list[str], columns: list[str], since: Column, at: str, newest: int, key: str) -> DataFrame:
    """The newest documents since a day of which a column contains one of the words, whatever the case."""
    hit = reduce(lambda a, b: a | b, [contains_ci(F.col(c), w) for c in columns for w in words])
    return documents.where((F.col(at) >= since) & hit).orderBy(F.desc(at), key).limit(newest)


def classify_question(text: str, strategic: list[str]) -> str:
    """``strategic`` if a phrase of the list occurs, ``specific`` if an address does, else ``strategic``."""
    import re

    low = text.lower()
    if any(p in low for p in strategic):
        return "strategic"
    return "specific" if re.search(r"\b\d+\s+(?:[nsew]{1,2}\s+)?\w+\s+(?:st|ave|rd|dr|ln|ct|blvd|ter|way|pl|cir|trl)\b", low) else "strategic"
