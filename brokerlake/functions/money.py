"""Money and unit arithmetic. Rates round half up to cents; costs round half even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CENTS = "decimal(12,2)"


def known_distance(distance: Column) -> Column:
    return F.when(distance > 0, distance.cast("decimal(10,0)"))


def offered_per_mile(rate: Column, distance: Column) -> Column:
    return F.round(F.try_divide(rate, known_distance(distance)), 2).cast(CENTS)


def quote_as_all_in(amount: Column, basis: Column, distance: Column) -> Column:
    by_mile = F.round(amount * known_distance(distance), 2).cast("decimal(18,2)")
    return F.when(basis == "all_in", amount.cast("decimal(18,2)")).when(
        basis == "per_mile", by_mile
    )


def quote_as_per_mile(amount: Column, basis: Column, distance: Column) -> Column:
    spread = F.round(F.try_divide(amount, known_distance(distance)), 2).cast(CENTS)
    return F.when(basis == "per_mile", amount.cast(CENTS)).when(basis == "all_in", spread)


def band_position(per_mile: Column, low: Column, high: Column) -> Column:
    """Compare the already rounded per-mile rate; both ends belong to the band."""
    return (
        F.when(per_mile < low, "below_minimum")
        .when(per_mile > high, "above_maximum")
        .when(per_mile.isNotNull() & low.isNotNull() & high.isNotNull(), "within_band")
    )


def token_cost(prompt: Column, completion: Column, per_in: Column, per_out: Column) -> Column:
    """Price per million tokens; unknown counts cost nothing, an unpriced model is NULL."""
    million = F.lit(1_000_000).cast("decimal(7,0)")
    spent = (
        F.coalesce(prompt, F.lit(0)).cast("decimal(12,0)") * per_in.cast("decimal(8,4)")
        + F.coalesce(completion, F.lit(0)).cast("decimal(12,0)") * per_out.cast("decimal(8,4)")
    )
    return F.bround(spent.cast("decimal(22,4)") / million, 6).cast("decimal(12,6)")


def audio_cost(seconds: Column, per_minute: Column) -> Column:
    minutes = seconds.cast("decimal(10,2)") * per_minute.cast("decimal(8,4)")
    return F.bround(minutes.cast("decimal(19,6)") / F.lit(60).cast("decimal(2,0)"), 6).cast(
        "decimal(12,6)"
    )
