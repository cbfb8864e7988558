"""Weighted weekly cost per route, and its reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import close, failures, order_free_sums
from ..schemas import KEY, WEEKLY_COLUMNS, require_columns
from .quality import check_table

TOTALS = {
    "total_freight_cost_inr": "freight_cost_inr",
    "total_quantity_tonnes": "quantity_tonnes",
    "total_tonne_km": "tonne_km",
}


def weekly_route_metrics(shipments: DataFrame) -> DataFrame:
    """Count and totals per (route, route_type, week); rate = sum / sum.

    The totals can be combined in any order without changing the result, and a hot
    route-week leaves each map task as a partial row.
    """
    require_columns(shipments, (*KEY, "freight_cost_inr", "quantity_tonnes", "tonne_km"))
    totals = order_free_sums(shipments, list(KEY), TOTALS, shipment_count=F.count(F.lit(1)))
    return totals.withColumn(
        "cost_per_tonne_km", F.col("total_freight_cost_inr") / F.col("total_tonne_km")).select(*WEEKLY_COLUMNS)


def independent_recompute(spark, shipments: DataFrame) -> DataFrame:
    """The same table a second way, as SQL text over double sums, for comparison."""
    return spark.sql(
        """
        SELECT route, route_type, week_of, count(*) AS shipment_count,
               sum(CAST(freight_cost_inr AS DOUBLE)) AS total_freight_cost_inr,
               sum(CAST(quantity_tonnes AS DOUBLE)) AS total_quantity_tonnes,
               sum(CAST(tonne_km AS DOUBLE)) AS total_tonne_km,
               sum(CAST(freight_cost_inr AS DOUBLE)) / sum(CAST(tonne_km AS DOUBLE))
                   AS cost_per_tonne_km
        FROM {s} GROUP BY route, route_type, week_of
        """, s=shipments)


def weekly_reconciliation(shipments: DataFrame, weekly: DataFrame) -> DataFrame:
    """Group totals equal input totals, keys are unique, the rate formula holds."""
    left = order_free_sums(shipments, [], {f"{dst}_in": src for dst, src in TOTALS.items()}, n_in=F.count(F.lit(1)))
    right = order_free_sums(
        weekly, [], {f"{dst}_out": dst for dst in TOTALS}, n_out=F.sum("shipment_count"),
        rate_formula=failures(close(
            F.col("cost_per_tonne_km"), F.col("total_freight_cost_inr") / F.col("total_tonne_km"), 1e-12, 1e-12)))
    keys = weekly.groupBy(*KEY).count().agg(
        F.count_if(F.col("count") > 1).alias("unique_key"))
    both = left.join(right).join(keys)
    equal = lambda c: (~close(F.col(f"{c}_out"), F.col(f"{c}_in"), 1e-12, 1e-12)).cast("long")
    return check_table(both.select(
        (F.col("n_in") != F.col("n_out")).cast("long").alias("shipment_count"),
        *[equal(c).alias(c) for c in TOTALS],
        "unique_key", "rate_formula",
    ))


def weekly_summary(weekly: DataFrame) -> DataFrame:
    return weekly.agg(
        F.sum("shipment_count").alias("shipments"),
        F.count(F.lit(1)).alias("route_weeks"),
        F.countDistinct("route").alias("routes"),
        F.countDistinct("route_type").alias("route_types"),
        F.countDistinct("week_of").alias("weeks"),
        F.min("week_of").alias("first_week"),
        F.max("week_of").alias("last_week"),
    )


def canonical_sort(df: DataFrame) -> DataFrame:
    """Total order for a sink; stages in between need none."""
    return df.orderBy(*KEY)
