"""Row generators: dense calendars and activity windows, by exploding sequences (no cross join)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_days(df: DataFrame, start: Column, end: Column, day: str = "ds", step_days: int = 1) -> DataFrame:
    """One row per day (or per step) of the closed interval; rows with an empty interval vanish.

    Spark sizes the result as its input, before the days, and would broadcast it: the hint keeps the next join a shuffled one.
    """
    days = F.sequence(start, end, F.expr(f"interval {step_days} day"))
    return df.withColumn("_days", F.when(start <= end, days)).withColumn(day, F.explode("_days")).drop("_days").hint("merge")


def dense_days(keys: DataFrame, span: DataFrame, facts: DataFrame, on: Sequence[str], fill: dict,
               day: str = "ds", step_days: int = 1) -> DataFrame:
    """Every key on every day of `span` (one row: lo, hi); facts joined, missing measures filled.

    The two bounds are read once and become literals of the plan.
    """
    bounds = span.select(F.col("lo").cast("date"), F.col("hi").cast("date")).first()
    grid = explode_days(keys, F.lit(bounds[0]).cast("date"), F.lit(bounds[1]).cast("date"), day, step_days)
    return (grid.join(facts, [*on, day], "left")
            .select(*on, day, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in fill.items()]))


def active_bounds(daily: DataFrame, products: DataFrame, key: str, day: str, validity: str) -> DataFrame:
    """Per product its first day of the active grid (debut), its first sale and the last day of data (_b.hi)."""
    firsts = daily.groupBy(key).agg(F.min(day).alias("premiere_vente"), F.max(day).alias("_last"))
    span = daily.agg(F.struct(F.min(day).alias("lo"), F.max(day).alias("hi"))).scalar()
    return (firsts.join(products.select(key, F.col(validity).alias("_valid")), key, "left")
            .withColumn("_b", span)
            .withColumn("debut", F.least("premiere_vente", F.coalesce(
                F.when(F.col("_valid").isNotNull(), F.greatest(F.col("_valid"), F.col("_b.lo"))),
                F.col("premiere_vente")))))


def active_grid(daily: DataFrame, products: DataFrame, key: str = "produit_key", day: str = "ds",
                validity: str = "valid_from") -> DataFrame:
    """Product x day from max(validity, first day of data), capped by the first sale, to the last day of data.

    A product without a validity date starts at its first sale; a product never sold has no rows.
    """
    bounds = active_bounds(daily, products, key, day, validity)
    return explode_days(bounds, F.col("debut"), F.col("_b.hi"), day).select(key, day)


def filled_grid(daily: DataFrame, products: DataFrame, fill: dict, key: str = "produit_key", day: str = "ds",
                validity: str = "valid_from") -> DataFrame:
    """The active grid with the measures of `daily` (one row per product and day), missing ones filled.

    Each sold day lays out itself and the days up to the next sold one, the first one also the days before it, so that the days
    are made in the task that holds the product and are neither shuffled nor sorted.
    """
    bounds = active_bounds(daily, products, key, day, validity)
    following = F.lead(day).over(Window.partitionBy(key).orderBy(day))
    sold = daily.filter(F.col(day).isNotNull()).select(key, F.col(day).alias("_sold"), F.date_sub(following, 1).alias("_until"), *fill)
    runs = bounds.join(sold, key, "left")
    begin = F.when(F.col("_sold") > F.col("premiere_vente"), F.col("_sold")).otherwise(F.col("debut"))
    days = explode_days(runs, begin, F.coalesce("_until", F.col("_b.hi")), day)
    return days.select(key, day, *[F.coalesce(F.when(F.col(day) == F.col("_sold"), F.col(c)), F.lit(v)).alias(c) for c, v in fill.items()])


def repeat_per(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Every row once per value of a fixed list (grids of weights, levels, horizons, draws)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
