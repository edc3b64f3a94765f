"""Registration of queries over named views, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.catalog import table
from landweave.operators.rolls import valid_rows

#: Dates that stand for "now", so that results do not change from day to day.
ROLL_DATE, PERMIT_DATE, REPORT_DATE = "2024-12-01", "2001-08-01", "2025-01-01"

VIEWS = {
    "parcels": r"""SELECT * EXCLUDE (rn) FROM (
        SELECT r.*, upper(regexp_replace(r.parcel_id, '[^A-Za-z0-9]', '', 'g')) AS parcel_key,
               row_number() OVER (PARTITION BY r.snapshot_id, upper(regexp_replace(r.parcel_id, '[^A-Za-z0-9]', '', 'g')) ORDER BY r.loaded_at DESC, r.id DESC) AS rn
        FROM bulk_property_records r JOIN (SELECT arg_max(id, (snapshot_date, id)) AS snapshot_id FROM bulk_data_snapshots WHERE status = 'completed' GROUP BY market_id) s USING (snapshot_id)) WHERE rn = 1""",
    "holdings": """SELECT o_orderkey AS parcel_id, o_custkey AS owner_id, c_name AS owner_name, c_nationkey AS city_id, o_orderpriority AS property_type, o_orderstatus AS sale_qualified,
        CAST(o_totalprice AS DECIMAL(18,2)) AS market_value, CAST(o_orderdate AS DATE) AS sale_date FROM orders JOIN customer ON o_custkey = c_custkey""",
    "permits": """SELECT l_orderkey AS parcel_id, l_suppkey AS contractor_id, o_custkey AS applicant_id, l_linenumber AS line, p_type AS permit_type, l_returnflag AS status, l_linestatus AS work_type,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS project_value, CAST(l_shipdate AS DATE) AS applied, CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INTEGER) AS issued,
        CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) END AS finished, l_partkey AS part_id, l_quantity AS quantity
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "chunks": "SELECT * FROM ordinance_embeddings WHERE len(embedding) = 128 AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0",
}


class Tables:
    """The tables of a folder and the views over them, built when first used."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    @cached_property
    def parcels(self) -> DataFrame:
        records = self("bulk_property_records")
        kept = {c: F.col(c) for c in records.columns if c != "snapshot_id"}
        return valid_rows(records, self("bulk_data_snapshots"), kept, latest=True).select("snapshot_id", "parcel_key", *kept)

    @cached_property
    def holdings(self) -> DataFrame:
        o, c = self("orders"), self("customer")
        return o.join(c, o.o_custkey == c.c_custkey).select(
            F.col("o_orderkey").alias("parcel_id"), F.col("o_custkey").alias("owner_id"), F.col("c_name").alias("owner_name"), F.col("c_nationkey").alias("city_id"), F.col("o_orderpriority").alias("property_type"),
            F.col("o_orderstatus").alias("sale_qualified"), F.col("o_totalprice").cast("decimal(18,2)").alias("market_value"), F.col("o_orderdate").cast("date").alias("sale_date"),
        )

    @cached_property
    def permits(self) -> DataFrame:
        applied = F.col("l_shipdate").cast("date")
        return (
            self("lineitem")
            .join(self("part"), F.col("l_partkey") == F.col("p_partkey"))
            .join(self("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("l_orderkey").alias("parcel_id"), F.col("l_suppkey").alias("contractor_id"), F.col("o_custkey").alias("applicant_id"), F.col("l_linenumber").alias("line"), F.col("p_type").alias("permit_type"),
                F.col("l_returnflag").alias("status"), F.col("l_linestatus").alias("work_type"), F.col("l_extendedprice").cast("decimal(18,2)").alias("project_value"), applied.alias("applied"),
                F.date_add(applied, F.col("l_linenumber").cast("int")).alias("issued"), F.when(F.col("l_linestatus") == "F", F.date_add(applied, F.col("l_quantity").cast("int"))).alias("finished"),
                F.col("l_partkey").alias("part_id"), F.col("l_quantity").alias("quantity"),
            )
        )

    @cached_property
    def chunks(self) -> DataFrame:
        n2 = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        return self("ordinance_embeddings").where(F.size("embedding") == 128).where(n2 > 0)


def dates_as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if kind == "date" else F.col(f"`{c}`") for c, kind in df.dtypes])


class Registry:
    """Queries by name and their SQL."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None, dates: str = ""):
        """Registers a function of the tables; ``sql`` may use the views by name.

        Dates are given out as text, ``dates`` names those of the SQL."""

        def register(f: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, root: dates_as_text(f(Tables(spark, root)))
            if sql is not None:
                used = ", ".join(f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in sql)
                body = sql.strip()
                if used:
                    body = f"WITH {used}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {used} {body}"
                if dates:
                    body = f"SELECT * REPLACE ({', '.join(f'CAST({d} AS VARCHAR) AS {d}' for d in dates.split())}) FROM ({body})"
                self.sql[name] = body
            return f

        return register
