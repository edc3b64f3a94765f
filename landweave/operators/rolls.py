"""Full-roll deliveries: which deliveries count, and which row of a parcel is valid in each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What is compared between two deliveries of a roll, in the order of the table.
ROLL_FIELDS = (
    "owner_name", "mailing_address", "property_address", "city", "property_type", "land_zoning_code", "latitude", "longitude", "lot_size_acres", "square_feet", "year_built", "bedrooms", "has_pool", "market_value", "assessed_value", "last_sale_date", "last_sale_price", "sale_qualified",
)


def parcel_key(c: Column) -> Column:
    """Letters and digits only, in upper case; null for a text without any."""
    return F.nullif(F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")), F.lit(""))


def same_text(c: Column) -> Column:
    """A form in which texts that differ only in case and in blanks at the ends or repeated are equal.

    The regular expression runs only on rows that have something to squeeze."""
    u = F.upper(F.trim(c))
    odd = u.contains("  ") | u.contains("\t") | u.contains("\n")
    return F.when(odd, F.trim(F.regexp_replace(u, r"\s+", " "))).otherwise(u)


def deliveries(snapshots: DataFrame) -> DataFrame:
    """Completed deliveries by market in order of snapshot_date (then id), with their neighbours.

    Columns: snapshot_id, market, ord (from 1), at, next_id, next_at, is_last. Rows without id, market or
    date, and deliveries that are not ``completed``, do not count. A repeated id counts once."""
    done = (
        snapshots.where(F.col("status") == "completed")
        .select(F.col("id").alias("snapshot_id"), F.col("market_id").alias("market"), F.col("snapshot_date").alias("at"))
        .dropna()
        .groupBy("snapshot_id")
        .agg(F.min("market").alias("market"), F.max("at").alias("at"))
    )
    w = W.partitionBy("market").orderBy("at", "snapshot_id")
    return done.select(
        "snapshot_id",
        "market",
        "at",
        F.row_number().over(w).cast("int").alias("ord"),
        F.lead("snapshot_id").over(w).alias("next_id"),
        F.lead("at").over(w).alias("next_at"),
    ).withColumn("is_last", F.col("next_id").isNull())


def valid_rows(records: DataFrame, snapshots: DataFrame, values: dict[str, Column], latest: bool = False) -> DataFrame:
    """One row per delivery and parcel key: the row loaded last (of equal times the one with the largest id).

    ``values`` names what is kept of the row, computed before anything is moved. ``latest``: only each market's
    last delivery. Repeated rows of one parcel are combined before the shuffle, so a parcel that holds a large
    share of all rows does not end in one task. Rows whose parcel key is empty are left out."""
    seq = deliveries(snapshots)
    if latest:
        seq = seq.where("is_last")
    rows = records.select(
        "snapshot_id",
        parcel_key(F.col("parcel_id")).alias("parcel_key"),
        F.struct("loaded_at", "id").alias("_at"),
        F.struct(*[v.alias(n) for n, v in values.items()]).alias("_v"),
    ).where(F.col("parcel_key").isNotNull())
    kept = rows.join(seq, "snapshot_id")
    # the delivery's columns follow from snapshot_id, so they only ride along
    best = kept.groupBy("snapshot_id", "parcel_key", *[c for c in seq.columns if c != "snapshot_id"]).agg(F.max_by("_v", "_at").alias("_v"))
    return best.select(*seq.columns, "parcel_key", "_v.*")
