"""The bound freight tables as typed DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brokerlake.plans.bindings import with_clause
from brokerlake.scale import at_hand, small_splits, tune

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def cents(name: str):
    return (F.col(name).cast("decimal(14,0)") / F.lit(100).cast("decimal(3,0)")).cast(
        "decimal(12,2)"
    )


def as_cents(column):
    return (column * 100).cast("long")


class Tables:
    """Roles bound to one data folder; each property is a lazy plan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = small_splits(tune(spark))
        self.folder = folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def role(self, name: str) -> DataFrame:
        sql = with_clause(name) + f"\nSELECT * FROM {name}"
        for table in BASE:
            if table in sql:
                self.base(table).createOrReplaceTempView(table)
        return self.spark.sql(sql)

    @cached_property
    def loads(self) -> DataFrame:
        return self.role("loads").withColumn("offered_rate_usd", cents("offered_cents"))

    @cached_property
    def market_rates(self) -> DataFrame:
        """The rows of the role. A line is cut to its week and its rate before it meets its order,
        which has met its customer by then: each line is shuffled once."""
        lines = self.base("lineitem").selectExpr(
            "l_orderkey", "l_suppkey", "l_returnflag",
            "cast(date_trunc('week', l_shipdate) AS date) AS week_start",
            "cast(floor(round(l_extendedprice * 100) / l_quantity) AS bigint) AS line_cents",
        )
        origins = self.base("orders").select("o_orderkey", "o_custkey").join(
            self.role("customer_lane"), F.expr("o_custkey = c_custkey")
        )
        drops = at_hand(self.role("supplier_lane"))
        code = ("CASE l_returnflag WHEN 'A' THEN 'box_truck' WHEN 'N' THEN 'flatbed'"
                " ELSE 'refrigerated' END")
        weeks = (
            lines.join(origins.select("o_orderkey", "origin_state"), F.expr("l_orderkey = o_orderkey"))
            .join(drops, F.expr("l_suppkey = s_suppkey"))
            .groupBy("week_start", "origin_state", "destination_state",
                     F.expr(code).alias("equipment_code"))
            .agg(
                F.min("line_cents").alias("min_cents"),
                F.expr("cast(floor(sum(line_cents) / count(*)) AS bigint)").alias("avg_cents"),
                F.max("line_cents").alias("max_cents"), F.count("*").alias("load_volume"),
            )
        )
        return weeks.select(
            F.lit("snap-1").alias("snapshot_id"), "week_start", "origin_state",
            "destination_state", "equipment_code",
            cents("min_cents").alias("minimum_rate_per_mile"),
            cents("avg_cents").alias("average_rate_per_mile"),
            cents("max_cents").alias("maximum_rate_per_mile"),
            "load_volume",
        )

    @cached_property
    def carriers(self) -> DataFrame:
        tenths = F.col("reliability_tenths").cast("decimal(4,0)") / F.lit(10).cast("decimal(2,0)")
        return (
            self.role("carriers")
            .withColumn("reliability_score", tenths.cast("decimal(3,1)"))
            .withColumn("avg_response_time_hours", cents("response_hundredths"))
        )

    @cached_property
    def quotes(self) -> DataFrame:
        return self.role("quotes").withColumn("amount", cents("amount_cents"))

    @cached_property
    def segments(self) -> DataFrame:
        part = F.col("confidence_bp").cast("decimal(8,0)") / F.lit(10000).cast("decimal(5,0)")
        return (
            self.role("segments")
            .withColumn("start_seconds", cents("start_cs").cast("decimal(8,2)"))
            .withColumn("end_seconds", cents("end_cs").cast("decimal(8,2)"))
            .withColumn("confidence", part.cast("decimal(5,4)"))
        )

    @cached_property
    def operations(self) -> DataFrame:
        return self.role("ai_operations").withColumn("audio_seconds", cents("audio_cs"))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.role(name)
