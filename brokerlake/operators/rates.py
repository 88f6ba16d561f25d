"""Rate intelligence: market band, comparable quotes, best rates, quote chronology."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brokerlake import vocab
from brokerlake.functions import money
from brokerlake.scale import at_hand

LANE = ["snapshot_id", "origin_state", "destination_state", "equipment_code"]


def with_offered_per_mile(loads: DataFrame) -> DataFrame:
    return loads.withColumn(
        "offered_per_mile",
        money.offered_per_mile(F.col("offered_rate_usd"), F.col("distance_miles")),
    )


def latest_week_by_day(loads: DataFrame, rates: DataFrame) -> DataFrame:
    """For every (lane, equipment, pickup day) in use: the newest rate week not after it.

    Loads are first reduced to distinct days map-side, so the window below holds calendar days
    and weeks only, however many loads share a lane.
    """
    keys = [F.col(k) for k in LANE]
    complete = F.lit(True)
    for key in keys + [F.col("pickup_date")]:
        complete = complete & key.isNotNull()
    days = loads.where(complete).select(*LANE, F.col("pickup_date").alias("day")).distinct()
    rate = F.struct(
        "week_start", "minimum_rate_per_mile", "average_rate_per_mile", "maximum_rate_per_mile",
        "load_volume",
    )
    weeks = rates.select(*LANE, F.col("week_start").alias("day"), rate.alias("rate"))
    marks = weeks.unionByName(days, allowMissingColumns=True)
    so_far = (
        Window.partitionBy(*LANE)
        .orderBy("day", F.col("rate").isNull().asc())  # a week starting that day counts
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        marks.withColumn("market", F.last("rate", ignorenulls=True).over(so_far))
        .where("rate IS NULL AND market IS NOT NULL")
        .select(*LANE, F.col("day").alias("pickup_date"), "market.*")
    )


def market_context(loads: DataFrame, rates: DataFrame) -> DataFrame:
    """Every load with its market week, per-mile offer and band position (NULL when none)."""
    market = at_hand(latest_week_by_day(loads, rates))
    joined = with_offered_per_mile(loads).join(market, [*LANE, "pickup_date"], "left")
    return joined.withColumn(
        "band_position",
        money.band_position(
            F.col("offered_per_mile"),
            F.col("minimum_rate_per_mile"),
            F.col("maximum_rate_per_mile"),
        ),
    )


def comparable(quotes_on_candidates: DataFrame) -> DataFrame:
    """Add ``all_in`` and ``per_mile`` where the current quote can be compared, else NULL.

    Expects amount, rate_basis, quote_type, evidence_status, currency, distance_miles.
    """
    usable = (
        F.col("quote_type").isin(*vocab.CARRIER_ROLES)
        & (F.col("evidence_status") == "explicit")
        & (F.col("currency") == "USD")
    )
    amount, basis, miles = F.col("amount"), F.col("rate_basis"), F.col("distance_miles")
    return quotes_on_candidates.withColumn(
        "all_in", F.when(usable, money.quote_as_all_in(amount, basis, miles))
    ).withColumn("per_mile", F.when(usable, money.quote_as_per_mile(amount, basis, miles)))


def best_rates(candidates: DataFrame) -> DataFrame:
    """Lowest comparable all-in per load, overall and among eligible; ties by candidate id."""
    priced = candidates.where(F.col("all_in").isNotNull())
    answer = F.struct("all_in", "candidate_id", "quote_id", "per_mile", "final_status")
    eligible = F.when(F.col("final_status") == "eligible", answer)
    return priced.groupBy("load_id").agg(
        F.min(answer).alias("lowest_overall"), F.min(eligible).alias("lowest_eligible")
    )


def quote_vs_market(quotes: DataFrame, inquiries: DataFrame, context: DataFrame) -> DataFrame:
    """Each quote's per-mile value beside the market week of its load."""
    on_load = quotes.join(inquiries.select("inquiry_id", "load_id"), "inquiry_id").join(
        context.select(
            "load_id", "distance_miles", "week_start", "minimum_rate_per_mile",
            "maximum_rate_per_mile",
        ),
        "load_id",
    )
    per_mile = money.quote_as_per_mile(
        F.col("amount"), F.col("rate_basis"), F.col("distance_miles")
    )
    return on_load.withColumn("quote_per_mile", per_mile).withColumn(
        "quote_band",
        money.band_position(
            F.col("quote_per_mile"), F.col("minimum_rate_per_mile"), F.col("maximum_rate_per_mile")
        ),
    )
