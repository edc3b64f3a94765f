"""Upserts without a table format: the new state of a table as a frame, to be written to a new place and swapped in.

Each is one join or window on the key. Rows with a null in the key never match and are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_wins(existing: DataFrame, incoming: DataFrame, keys: list[str], version: Column | None = None) -> DataFrame:
    """Union of both; of equal keys the incoming row, of several incoming ones the highest ``version``."""
    tag = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    order = [F.desc("_new"), *([version.desc_nulls_last()] if version is not None else []), *[F.asc_nulls_last(c) for c in existing.columns if c not in keys]]
    return tag.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") == 1).drop("_r", "_new")


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and the incoming ones whose key is new, one per key."""
    fresh = incoming.join(existing.select(*keys).distinct(), keys, "left_anti").select(*existing.columns)
    one = fresh.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*[F.asc_nulls_last(c) for c in existing.columns]))).where("_r = 1").drop("_r")
    return existing.unionByName(one)


def touch(existing: DataFrame, incoming: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Existing rows stay but for ``column``, which is taken from the incoming row of their key; new keys are added."""
    seen = incoming.groupBy(*keys).agg(F.max(column).alias("_t"))
    kept = existing.join(seen, keys, "left").withColumn(column, F.coalesce("_t", column)).select(*existing.columns)
    fresh = insert_or_ignore(existing.limit(0), incoming.join(existing.select(*keys).distinct(), keys, "left_anti").select(*existing.columns), keys)
    return kept.unionByName(fresh)


def fill(existing: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str], overwrite: bool = True) -> DataFrame:
    """Existing rows with the incoming non-null values of ``columns``; without ``overwrite`` only where they are null."""
    new = incoming.groupBy(*keys).agg(*[F.max(c).alias(f"_{c}") for c in columns])
    out = existing.join(new, keys, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_{c}", c) if overwrite else F.coalesce(c, f"_{c}"))
    return out.select(*existing.columns)


def get_or_create(existing: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and wanted rows of new keys, with ``created``."""
    fresh = wanted.join(existing.select(*keys), keys, "left_anti").select(*existing.columns)
    return existing.withColumn("created", F.lit(False)).unionByName(fresh.withColumn("created", F.lit(True)))


def merge_max(existing: DataFrame, incoming: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row per key with the greatest value of ``column`` in either."""
    both = existing.select(*keys, column).unionByName(incoming.select(*keys, column))
    return both.groupBy(*keys).agg(F.max(column).alias(column))


def content_digest(rows: DataFrame, keys: list[str], volatile: list[str]) -> DataFrame:
    """One digest of each group's rows, whatever their order; volatile columns are left out.

    The digest is the sum of 64-bit hashes of rows and their number, so it is combined before the shuffle."""
    kept = [c for c in sorted(rows.columns) if c not in volatile and c not in keys]
    mask = sum((F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(kept)), F.lit(0))
    return rows.groupBy(*keys).agg(F.sum(F.xxhash64(mask, *kept).cast("decimal(38,0)")).alias("digest"), F.count(F.lit(1)).alias("n"))


def changed_groups(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``now`` whose digest is new or differs."""
    old = before.select(*keys, F.col("digest").alias("_d"), F.col("n").alias("_n"))
    return now.join(old, keys, "left").where(F.col("_d").isNull() | (F.col("_d") != F.col("digest")) | (F.col("_n") != F.col("n"))).select(*keys)
