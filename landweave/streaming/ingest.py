"""Structured Streaming: facts are taken in once, and decisions counted by hour. An extension of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.operators.rollups import bands

Parser = Callable[[DataFrame], DataFrame]


class Parsers:
    """Parsers of raw facts by type."""

    def __init__(self):
        self._by_type: dict[str, Parser] = {}

    def register(self, fact_type: str, parser: Parser) -> None:
        self._by_type[fact_type] = parser

    def parse(self, facts: DataFrame, fact_type: str) -> DataFrame:
        """The rows a type's parser makes of its facts; an unknown type is an error."""
        if fact_type not in self._by_type:
            raise KeyError(f"no parser for {fact_type!r}")
        return self._by_type[fact_type](facts.where(F.col("fact_type") == fact_type))


def fresh_facts(facts: DataFrame, stored: DataFrame, content: str = "content") -> DataFrame:
    """Facts whose content hash is not stored yet, one per hash: the least by id."""
    hashed = facts.where(F.col(content).isNotNull()).withColumn("content_hash", F.sha2(F.col(content), 256))
    one = hashed.groupBy("content_hash").agg(F.min_by(F.struct(*facts.columns), "id").alias("_f")).select("_f.*", "content_hash")
    return one.join(stored.select("content_hash").distinct(), "content_hash", "left_anti")


def read_facts(spark: SparkSession, path: str, schema: str, files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def dedupe_stream(facts: DataFrame, at: str, content: str, delay: str = "1 hour") -> DataFrame:
    """Facts once per content hash, among those at most ``delay`` apart; state older than that is dropped."""
    return facts.withColumn("content_hash", F.sha2(F.col(content), 256)).withWatermark(at, delay).dropDuplicatesWithinWatermark(["content_hash"])


def hourly_stream(decisions: DataFrame, at: str, method: str, confidence: str, delay: str = "1 hour") -> DataFrame:
    """Decisions by hour and method with confidence bands; rows later than ``delay`` are dropped."""
    return decisions.withWatermark(at, delay).groupBy(F.window(at, "1 hour"), method).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(b).alias(k) for k, b in bands(confidence).items()])


def sessions(events: DataFrame, user: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user: events less than ``gap`` apart."""
    return events.groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("began"), "n")
