"""Percent deviations, the candidate rule and its display form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import fixed_text, flag, iso, signed_text
from ..schemas import CANDIDATE_COLUMNS, OUTPUT_COLUMNS, require_columns
from .quality import validated_threshold

# Fixed values of the output contract.
PEER_UNAVAILABLE_TEXT = "Not available: no other same-type routes this week"
PRELIMINARY_REASON = "Context review pending. Cost rise is currently flagged for review."
OWN_SUFFIX = "% vs this route's past average"
PEER_SUFFIX = "% vs similar-length routes this week"


def percent_deviation(baselines: DataFrame) -> DataFrame:
    """(rate / baseline - 1) * 100 for both baselines; missing stays missing."""
    rate = F.col("cost_per_tonne_km")
    return baselines.withColumns({
        "vs_own_history_pct": (rate / F.col("own_history_avg_cost_per_tonne_km") - 1) * 100,
        "vs_similar_routes_pct": (rate / F.col("similar_routes_avg_cost_per_tonne_km") - 1) * 100,
    })


def candidate_rule(comparisons: DataFrame, threshold_percent: float = 20.0) -> DataFrame:
    """Rising and at or above the threshold on either side; a missing side never breaches."""
    threshold = validated_threshold(threshold_percent)
    own, peer = F.col("vs_own_history_pct"), F.col("vs_similar_routes_pct")
    return (
        comparisons.withColumns({
            "is_rising": flag(own > 0),
            "own_threshold_breached": flag(own >= threshold),
            "peer_threshold_breached": flag(peer >= threshold),
        })
        .withColumn("candidate_anomaly", F.col("is_rising") & (
            F.col("own_threshold_breached") | F.col("peer_threshold_breached")))
        .select(*CANDIDATE_COLUMNS)
    )


def candidates_only(metrics: DataFrame) -> DataFrame:
    return metrics.where("candidate_anomaly")


def candidate_trigger(own_label: str = "own_history") -> Column:
    """both / own_history / peer; the query text uses the short label ``own``."""
    own, peer = F.col("own_threshold_breached"), F.col("peer_threshold_breached")
    return F.when(own & peer, "both").when(own, own_label).otherwise("peer")


def candidate_key(route: Column, week_of: Column) -> Column:
    return F.concat_ws("|", route, iso(week_of))


def candidate_id(route: Column, route_type: Column, week_of: Column) -> Column:
    """The whole key as text: what documents and hits of a candidate are joined by."""
    return F.concat_ws("|", route, route_type, iso(week_of))


def trigger_counts(candidates: DataFrame) -> DataFrame:
    own, peer = F.col("own_threshold_breached"), F.col("peer_threshold_breached")
    return candidates.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(own).alias("by_own"), F.count_if(peer).alias("by_peer"),
        F.count_if(own & peer).alias("by_both"))


def own_display(c: str = "vs_own_history_pct") -> Column:
    return F.concat(signed_text(F.col(c), 1), F.lit(OWN_SUFFIX))


def peer_display(c: str = "vs_similar_routes_pct") -> Column:
    """NULL when there is no peer."""
    return F.when(F.col(c).isNotNull(), F.concat(signed_text(F.col(c), 1), F.lit(PEER_SUFFIX)))


def contract_display(metrics: DataFrame) -> DataFrame:
    """Candidates in the eight-column text contract, context review still open."""
    return typed_display(metrics).select(*OUTPUT_COLUMNS)


def typed_display(metrics: DataFrame) -> DataFrame:
    """The contract's columns with the route type, which is part of a candidate's key."""
    require_columns(metrics, CANDIDATE_COLUMNS)
    return candidates_only(metrics).select(
        "route_type",
        "route", iso(F.col("week_of")).alias("week_of"),
        fixed_text(F.col("cost_per_tonne_km"), 2).alias("cost_per_tonne_km"),
        own_display().alias("vs_own_history"),
        F.coalesce(peer_display(), F.lit(PEER_UNAVAILABLE_TEXT)).alias("vs_similar_routes"),
        F.lit("Yes").alias("flagged"), F.lit("").alias("matched_note_id"),
        F.lit(PRELIMINARY_REASON).alias("reason"),
    )
