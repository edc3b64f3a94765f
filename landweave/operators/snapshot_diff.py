"""What changed between consecutive full snapshots, by signed cells.

Every snapshot row is unpivoted into cells (target, key, field, value): +1 for the snapshot that has it, -1 for the
one that follows. In a group of equal cells the signs of an unchanged value cancel; what is left says which fields
changed. A marker cell per key tells whether the key itself came (+1), went (-1) or stayed (0).

The sums are taken in two steps. First whole rows are cells (by a 64-bit digest), which cancels all rows that did not
change; only the rest is unpivoted to fields. Values travel as hashes of fixed width. Both steps run on one
partitioning by (market, key), since all later grouping keys contain it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.operators.rolls import ROLL_FIELDS, same_text, valid_rows


def _normal(df: DataFrame, field: str) -> Column:
    return same_text(F.col(field)) if dict(df.dtypes)[field] == "string" else F.col(field)


def signed_row_cells(rows: DataFrame) -> DataFrame:
    """Rows (market, parcel_key, ord, next_id, snapshot_id, digest, fields) that do not cancel, with their sign."""
    plus = F.struct(F.col("snapshot_id").alias("target"), F.lit(1).alias("sign"))
    minus = F.struct(F.col("next_id").alias("target"), F.lit(-1).alias("sign"))
    cells = rows.select("market", "parcel_key", "digest", "fields", F.explode(F.when(F.col("ord") == 1, F.array(minus)).otherwise(F.array(plus, minus))).alias("c")).where("c.target is not null")
    return (
        cells.groupBy("market", "parcel_key", F.col("c.target").alias("target"), "digest")
        .agg(F.sum("c.sign").alias("sign"), F.first("fields").alias("fields"))
        .where("sign != 0")
    )


def roll_changes(records: DataFrame, snapshots: DataFrame, fields: tuple[str, ...] = ROLL_FIELDS) -> DataFrame:
    """snapshot_id, parcel_key, change (added, removed, changed), changed_fields: one row per parcel that differs
    between a delivery and the market's delivery before.

    Strings are compared by *same text*; null equals null only; an empty string is not null. A market's first
    delivery gives no rows; empty tables give none. Extra columns of the input are ignored."""
    normal = [_normal(records, f) for f in fields]
    nulls = sum((F.when(c.isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(normal)), F.lit(0))
    rows = valid_rows(
        records,
        snapshots,
        {"digest": F.xxhash64(nulls, *normal), "fields": F.array(*[F.when(c.isNotNull(), F.hash(c)) for c in normal])},
    ).repartition("market", "parcel_key")
    changed_rows = signed_row_cells(rows)
    marker = F.struct(F.lit("").alias("field"), F.lit(None).cast("int").alias("value"))
    unpivoted = F.concat(F.array(marker), *[F.array(F.struct(F.lit(f).alias("field"), F.col("fields")[i].alias("value"))) for i, f in enumerate(fields)])
    cells = (
        changed_rows.select("market", "parcel_key", "target", "sign", F.explode(unpivoted).alias("c"))
        .groupBy("market", "parcel_key", "target", F.col("c.field").alias("field"), F.col("c.value").alias("value"))
        .agg(F.sum("sign").alias("sign"))
    )
    per_parcel = cells.groupBy("market", "parcel_key", "target").agg(
        F.sum(F.when(F.col("field") == "", F.col("sign")).otherwise(0)).alias("presence"),
        F.array_sort(F.collect_set(F.when((F.col("field") != "") & (F.col("sign") != 0), F.col("field")))).alias("changed_fields"),
    )
    change = F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").otherwise("changed")
    return per_parcel.select(F.col("target").alias("snapshot_id"), "parcel_key", change.alias("change"), F.when(F.col("presence") == 0, F.col("changed_fields")).otherwise(F.array().cast("array<string>")).alias("changed_fields"))
