"""Readers and parsers of the raw formats: delimited, fixed width, archives, JSON, GeoJSON, feeds, workbooks.

Parsers work on a column of text, so they serve files, streams and tables alike; readers only add the file access.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.functions.text import boolean, number, scan_date


def sniff_delimiter(head: str) -> str:
    """Tab if one occurs in the first kilobyte, else a comma."""
    return "\t" if "\t" in head[:1024] else ","


def read_delimited(spark: SparkSession, path: str, key: str | None = None, delimiter: str | None = None) -> DataFrame:
    """A file with a header as strings; bytes that are no UTF-8 are dropped, the key is trimmed.

    Only the first line of the first file is looked at to find the delimiter."""
    if delimiter is None:
        first = spark.read.text(path).limit(1).collect()
        delimiter = sniff_delimiter(first[0][0] if first else "")
    df = spark.read.option("sep", delimiter).option("header", True).option("encoding", "UTF-8").csv(path)
    clean = df.select(*[F.regexp_replace(F.col(f"`{c}`"), "�", "").alias(c) for c in df.columns])
    return clean.withColumn(key, F.trim(key)) if key else clean


def typed(df: DataFrame, mapping: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns by name: (source column, type). Numbers may have currency signs; what can't be read is null."""
    out = []
    for name, (source, kind) in mapping.items():
        c = F.col(f"`{source}`")
        out.append((boolean(c) if kind == "boolean" else number(c, 1e15).try_cast(kind) if kind in ("double", "bigint", "int") else c.try_cast(kind)).alias(name))
    return df.select(*out)


def read_archive(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(name, line) of the members of ZIP files whose lower-case name ends with one of ``names``; each archive is
    unpacked by the task that reads it."""
    wanted = tuple(x.lower() for x in names)

    def unpack(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.namelist():
                        if m.lower().endswith(wanted):
                            lines = z.read(m).decode("utf-8", "ignore").splitlines()
                            yield pd.DataFrame({"name": [m.lower()] * len(lines), "line_number": range(len(lines)), "line": lines})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "name string, line_number bigint, line string")


#: Positions (from 1) and lengths in the registry's 1,440-character records.
CORPORATE = {"document_number": (1, 12), "name": (13, 146), "street": (221, 90), "city": (311, 30), "zip": (331, 15), "officers": (521, 280)}
#: The same for its 662-character event records.
EVENT = {"document_number": (1, 12), "sequence": (13, 6), "code": (19, 14), "description": (33, 41)}


def slices(value: Column, layout: dict[str, tuple[int, int]], width: int) -> list[Column]:
    """Trimmed slices of a record padded to its width; empty ones are null."""
    padded = F.rpad(value, width, " ")
    return [F.nullif(F.trim(F.substring(padded, at, size)), F.lit("")).alias(name) for name, (at, size) in layout.items()]


def parse_corporate(lines: DataFrame, value: str = "value", years: tuple[int, int] = (1900, 2030)) -> DataFrame:
    """Registry records; the filing date is the first date found at 461 to 490."""
    c = F.rpad(F.col(value), 1440, " ")
    return lines.select(*slices(F.col(value), CORPORATE, 1440), scan_date(F.substring(c, 461, 30), *years).alias("filing_date"))


def parse_events(lines: DataFrame, value: str = "value", years: tuple[int, int] = (1900, 2030)) -> DataFrame:
    """Registry events; the date is the first found at 74 to 110."""
    c = F.rpad(F.col(value), 662, " ")
    return lines.select(*slices(F.col(value), EVENT, 662), scan_date(F.substring(c, 74, 37), *years).alias("event_date"))


def read_fixed_width(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Lines of a file in another encoding, as ``value``."""
    return spark.read.option("encoding", encoding).option("header", False).option("sep", "\u0001").option("quote", "").schema("value string").csv(path)


def parse_incidents(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON rows whose place is a GeoJSON point, a pair of fields or a nested location."""
    j = F.col(value)

    def g(path: str) -> Column:
        return F.get_json_object(j, path)

    lat = F.coalesce(g("$.location.coordinates[1]"), g("$.latitude"), g("$.location_1.latitude")).try_cast("double")
    lon = F.coalesce(g("$.location.coordinates[0]"), g("$.longitude"), g("$.location_1.longitude")).try_cast("double")
    return raw.select(g("$.id").try_cast("bigint").alias("id"), g("$.narrative").alias("incident_type"), g("$.address").alias("address"), lat.alias("latitude"), lon.alias("longitude"))


def parse_features(raw: DataFrame, value: str = "value", code_names: tuple[str, ...] = ("ZONING", "ZONECODE", "ZONE_CODE", "ZONE", "DISTRICT")) -> DataFrame:
    """(code, ring) of each feature of GeoJSON collections: the first code name present, the outer ring."""
    schema = "struct<features: array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>>"
    f = raw.select(F.explode(F.from_json(value, schema)["features"]).alias("f"))
    code = F.coalesce(*[F.try_element_at(F.col("f.properties"), F.lit(n)) for n in code_names])
    ring = F.transform(F.try_element_at(F.col("f.geometry.coordinates"), F.lit(1)), lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return f.select(code.alias("code"), F.col("f.geometry.type").alias("kind"), ring.alias("ring"))


def parse_matrix(raw: DataFrame, value: str = "value") -> DataFrame:
    """(record map<string, string>) of JSON matrices whose first row names the columns."""
    m = raw.select(F.from_json(value, "array<array<string>>").alias("m"))
    rows = m.select(F.col("m")[0].alias("names"), F.explode(F.slice("m", 2, 1 << 30)).alias("row"))
    return rows.select(F.map_from_arrays("names", "row").alias("record"))


def parse_feed(raw: DataFrame, value: str = "value", most: int = 500) -> DataFrame:
    """(title, link, published, summary) of RSS items; a longer summary is cut and marked by three dots."""
    schema = "channel struct<item: array<struct<title: string, link: string, pubDate: string, description: string>>>"
    item = raw.select(F.explode(F.from_xml(value, schema)["channel"]["item"]).alias("i"))
    text = F.col("i.description")
    short = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
    return item.select("i.title", "i.link", F.col("i.pubDate").alias("published"), short.alias("summary"))


def read_corpus(spark: SparkSession, path: str, least: int = 100) -> DataFrame:
    """(path, text) of whole text files of at least so many characters."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(F.length("text") >= least)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON files of the form {metadata, embeddings: [...]}."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("embeddings").alias("e")).select("e.*")


def read_workbook(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """Rows of a workbook by column aliases; needs an Excel engine for pandas, which is not part of this project."""
    import pandas as pd

    try:
        pdf = pd.read_excel(path, dtype=str)
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl") from e
    out = {name: pdf[next((a for a in names if a in pdf.columns), names[0])] if any(a in pdf.columns for a in names) else None for name, names in aliases.items()}
    return spark.createDataFrame(pd.DataFrame(out).astype(object).where(lambda d: d.notna(), None), ", ".join(f"`{n}` string" for n in aliases))


def bound(spark: SparkSession, sql: str, args: dict | None = None, **views: DataFrame) -> DataFrame:
    """A query with named parameters over the given frames."""
    return spark.sql(sql, args=args or {}, **views)
