"""Full history of changing attributes by checkpoint-delta storage.

A change log keeps one row per change of a subject: a patch with the attributes that changed, and at every ``every``-th
change a full version, a checkpoint. ``HistoryLog`` stores it as Parquet and is appended to as new observations come:
the state they change is read back from each subject's last checkpoint and the patches behind it, so a log that grew by
appending equals one built at once. The version of a date and the whole history are rebuilt by folding patches forward
from the nearest checkpoint. An observation whose attributes are all null means that the subject is not there.
"""

from __future__ import annotations

import datetime
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landweave.operators.rolls import deliveries, same_text, valid_rows
from landweave.session import shared_folder

OPEN_END = "9999-12-31"


def change_log(observations: DataFrame, attributes: list[str], every: int = 16, before: DataFrame | None = None) -> DataFrame:
    """The log of observations (subject, seq, at, *attributes), of which each (subject, seq) occurs once.

    Columns: subject, seq, at, change (counted from 1 per subject), segment, is_checkpoint, and per attribute
    ``patch_<a>``: null where the attribute did not change, else a struct that holds the value. Observations that change
    nothing are not stored. ``before`` (subject, change, state) is where the subjects of a longer log stand."""
    w = W.partitionBy("subject").orderBy("seq")
    state = F.struct(*attributes)
    rows = observations.select("subject", "seq", "at", state.alias("state"))
    if before is None:
        first, number = F.lit(None), F.lit(0)
    else:
        rows = rows.join(before.select("subject", F.col("change").alias("_number"), F.col("state").alias("_first")), "subject", "left")
        first, number = F.col("_first"), F.coalesce("_number", F.lit(0))
    seen = rows.withColumn("_before", F.when(F.row_number().over(w) == 1, first).otherwise(F.lag("state").over(w)))
    turns = seen.where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col("state"))).withColumn("change", number + F.row_number().over(w))
    is_checkpoint = (F.col("change") - 1) % every == 0
    return turns.select(
        "subject", "seq", "at", F.col("change").cast("int").alias("change"), F.floor((F.col("change") - 1) / every).alias("segment"), is_checkpoint.alias("is_checkpoint"),
        *[F.when(is_checkpoint | F.col("_before").isNull() | ~F.col(f"_before.{a}").eqNullSafe(F.col(f"state.{a}")), F.struct(F.col(f"state.{a}").alias("value"))).alias(f"patch_{a}") for a in attributes],
    )


def _there(state: str, attributes: list[str]) -> Column:
    return reduce(or_, [F.col(f"{state}.{a}").isNotNull() for a in attributes])


def fold_history(log: DataFrame, attributes: list[str]) -> DataFrame:
    """Versions (subject, valid_from, valid_to, *attributes) from a log; valid_to is exclusive, null when open."""
    segment = W.partitionBy("subject", "segment").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    # one exchange by subject serves the segments too
    folded = log.repartition("subject").select("subject", "seq", "at", *[F.last(f"patch_{a}", ignorenulls=True).over(segment).alias(a) for a in attributes])
    states = folded.select("subject", "at", F.lead("at").over(W.partitionBy("subject").orderBy("seq")).alias("valid_to"), F.struct(*[F.col(f"{a}.value").alias(a) for a in attributes]).alias("state"))
    return states.where(_there("state", attributes)).select("subject", F.col("at").alias("valid_from"), "valid_to", "state.*")


def fold_state(log: DataFrame, attributes: list[str]) -> DataFrame:
    """(subject, seq, at, change, state) after the last row of each subject: its latest checkpoint and the patches
    behind it, folded. Patches of one segment are combined before the shuffle."""
    last = [F.max_by(f"patch_{a}", F.when(F.col(f"patch_{a}").isNotNull(), F.col("seq"))).alias(f"_{a}") for a in attributes]
    per_segment = log.groupBy("subject", "segment").agg(F.max(F.struct("seq", "at", "change")).alias("_end"), *last)
    best = per_segment.groupBy("subject").agg(F.max_by(F.struct("_end", *[f"_{a}" for a in attributes]), "segment").alias("_s"))
    return best.select("subject", "_s._end.*", F.struct(*[F.col(f"_s._{a}.value").alias(a) for a in attributes]).alias("state"))


class HistoryLog:
    """A change log stored as Parquet in ``folder``, which must be shared by the cluster. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, attributes: list[str], every: int = 16):
        self.spark, self.folder, self.attributes, self.every = spark, folder.rstrip("/"), attributes, every
        self.parts = 0

    def append(self, observations: DataFrame) -> HistoryLog:
        """Adds observations that come after all stored ones of their subjects (greater seq)."""
        before = None
        if self.parts:
            now = fold_state(self.rows(), self.attributes)
            before = now.join(observations.select("subject").distinct(), "subject", "left_semi")
        # the new part is written aside, so the log is not read and written at once
        change_log(observations, self.attributes, self.every, before).write.parquet(f"{self.folder}/part={self.parts:06d}")
        self.parts += 1
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/part={i:06d}" for i in range(self.parts)])

    def history(self) -> DataFrame:
        """All versions (subject, valid_from, valid_to, *attributes)."""
        return fold_history(self.rows(), self.attributes)

    def as_of(self, day: datetime.date) -> DataFrame:
        """(subject, *attributes) as they were on a date, from each subject's nearest checkpoint before it."""
        return fold_state(self.rows().where(F.col("at") <= F.lit(day)), self.attributes).where(_there("state", self.attributes)).select("subject", "state.*")


def roll_observations(records: DataFrame, snapshots: DataFrame, field: str) -> DataFrame:
    """Observations of one roll field by parcel; a delivery without the parcel is an observation of nothing.

    Only the first delivery after a row in which the parcel is missing is told, so a parcel has at most two
    observations per row and never more than its market has deliveries."""
    rows = valid_rows(records, snapshots, {"value": same_text(F.col(field))}).select("market", "parcel_key", "ord", "at", "next_at", "value")
    w = W.partitionBy("market", "parcel_key").orderBy("ord")
    gaps = rows.repartition("market", "parcel_key").withColumn("_next", F.lead("ord").over(w))
    here = F.struct(F.col("ord").cast("long").alias("seq"), F.col("at"), F.col("value"))
    gone = F.struct((F.col("ord") + 1).cast("long").alias("seq"), F.col("next_at").alias("at"), F.lit(None).cast("string").alias("value"))
    ends = F.col("next_at").isNotNull() & (F.col("_next").isNull() | (F.col("_next") != F.col("ord") + 1))
    return gaps.select(F.struct("market", "parcel_key").alias("subject"), F.explode(F.when(ends, F.array(here, gone)).otherwise(F.array(here))).alias("o")).select("subject", "o.*")


def status_observations(events: DataFrame) -> DataFrame:
    """Observations of a status by entity: per effective date the message received last, then the largest id.

    Messages without status or date do not count. Messages of one day are combined before the shuffle, so an entity has
    at most as many observations as there are days."""
    rows = events.where("entity_id is not null and status is not null and effective_date is not null")
    best = rows.groupBy("entity_id", "effective_date").agg(F.max_by(same_text(F.col("status")), F.struct("received_at", "event_id")).alias("value"))
    return best.select(F.col("entity_id").alias("subject"), F.datediff("effective_date", F.lit("0001-01-01").cast("date")).cast("long").alias("seq"), F.col("effective_date").alias("at"), "value")


def period_observations(periods: DataFrame, subject: list[str], start: str, end: str) -> DataFrame:
    """Observations ``active`` or nothing from periods [start, end), end null when open; touching periods join.

    Starts and ends of one day are summed with their signs before the shuffle. Periods without start or that end on or
    before it do not count, nor do rows without a subject column."""
    ok = periods.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
    for c in subject:
        ok = ok.where(F.col(c).isNotNull())
    edge = ok.select(F.struct(*subject).alias("subject"), F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e")).where("e.at is not null")
    sums = edge.groupBy("subject", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    run = F.sum("d").over(W.partitionBy("subject").orderBy("at"))
    return sums.withColumn("_run", run).select("subject", F.datediff("at", F.lit("0001-01-01").cast("date")).cast("long").alias("seq"), "at", F.when(F.col("_run") > 0, "active").alias("value"))


def versions(observations: DataFrame, every: int = 16) -> DataFrame:
    """History of the attribute ``value`` through a log stored in the shared folder, beside Spark's own checkpoints."""
    spark = observations.sparkSession
    return HistoryLog(spark, f"{shared_folder(spark)}/history-{uuid.uuid4().hex}", ["value"], every).append(observations).history()


def found_form(history: DataFrame, key) -> DataFrame:
    """subject_key, valid_from, valid_to as text."""
    return history.select(key.alias("subject_key"), F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), F.coalesce(F.date_format("valid_to", "yyyy-MM-dd"), F.lit(OPEN_END)).alias("valid_to"), "value")


def all_histories(records: DataFrame, snapshots: DataFrame, events: DataFrame, relationships: DataFrame) -> DataFrame:
    """subject_key, valid_from, valid_to, value: owners of parcels, statuses of entities, periods of relationships."""
    owners = found_form(versions(roll_observations(records, snapshots, "owner_name")), F.concat(F.lit("p:"), F.col("subject.parcel_key")))
    statuses = found_form(versions(status_observations(events)), F.concat(F.lit("e:"), F.col("subject").cast("string")))
    keys = ["source_entity_id", "target_entity_id", "relationship_type"]
    ties = found_form(
        versions(period_observations(relationships, keys, "relationship_start_date", "relationship_end_date")),
        F.concat(F.lit("r:"), F.concat_ws("|", *[F.col(f"subject.{k}").cast("string") for k in keys])),
    )
    return owners.unionByName(statuses).unionByName(ties)
