"""Queries of the problems on texts, names, addresses and vectors, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.catalog import table
from landweave.llm.additive import nearest, neighbour_pairs
from landweave.llm.addresses import same_locations
from landweave.llm.attribution import same_names
from landweave.llm.linkage import registry_links
from landweave.llm.packing import pack
from landweave.llm.readability import reading_levels
from landweave.llm.tokenizer import count_tokens, decode_ids, encode_texts
from landweave.operators.incidents import latest_parcels


def _links(spark: SparkSession, d: str) -> DataFrame:
    return registry_links(table(spark, d, "entities"), table(spark, d, "bulk_llc_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select("entity_id", "document_number")


def p5_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The links with their confidence."""
    return _links(spark, d)


def name_records(spark: SparkSession, d: str) -> DataFrame:
    """record, market, name of entities and of the owners of the latest parcels."""
    parcels = latest_parcels(table(spark, d, "bulk_property_records"), table(spark, d, "bulk_data_snapshots"), name="owner_name")
    owners = parcels.where("name is not null").select(F.concat(F.lit("o:"), "parcel_key").alias("record"), "market", "name")
    return table(spark, d, "entities").select(F.concat(F.lit("e:"), F.col("id").cast("string")).alias("record"), F.col("first_seen_market_id").alias("market"), F.coalesce("name", "canonical_name").alias("name")).unionByName(owners)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return same_names(name_records(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and text of all documents after encoding and decoding."""
    return decode_ids(encode_texts(table(spark, d, "documents")))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container and position of each document or piece."""
    return pack(count_tokens(table(spark, d, "documents")))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are: n containers by used tokens in steps of an eighth of the capacity."""
    used = pack(count_tokens(table(spark, d, "documents"))).groupBy("container").agg(F.sum("size").alias("used"))
    return used.groupBy(F.floor(F.col("used") / 256).alias("eighth")).agg(F.count(F.lit(1)).alias("n"))


def address_records(spark: SparkSession, d: str) -> DataFrame:
    """record, market, address of entities and of the latest parcels (property and mailing address)."""
    parcels = latest_parcels(table(spark, d, "bulk_property_records"), table(spark, d, "bulk_data_snapshots"), site="property_address", mail="mailing_address")
    both = F.explode(F.array(F.struct(F.lit("p:").alias("s"), F.col("site").alias("address")), F.struct(F.lit("m:").alias("s"), F.col("mail").alias("address"))))
    of_parcels = parcels.select("market", "parcel_key", both.alias("x")).select(F.concat("x.s", "parcel_key").alias("record"), "market", "x.address")
    of_entities = table(spark, d, "entities").select(F.concat(F.lit("e:"), F.col("id").cast("string")).alias("record"), F.col("first_seen_market_id").alias("market"), F.col("primary_address").alias("address"))
    return of_entities.unionByName(of_parcels).where("address is not null")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return same_locations(address_records(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbour_pairs(nearest(table(spark, d, "ordinance_embeddings")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(table(spark, d, "documents"), table(spark, d, "reading_samples")).where("band is not null").select("doc_id", "band")


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """How many documents of each source are in each band."""
    docs = table(spark, d, "documents")
    levels = reading_levels(docs, table(spark, d, "reading_samples"))
    return levels.join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "band").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p2_found, p4_found, p5_found, p5_confidence, p7_found, p8_ids, p8_round_trip, p9_containers, p9_fill, p10_found, p10_profile)}
ORACLES = {"p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
