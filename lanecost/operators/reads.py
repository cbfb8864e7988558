"""Views and filtered reads over the result of a run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import flag
from ..schemas import KEY
from .candidates import candidate_key, candidate_trigger
from .evidence import gate_results

SORT_FIELDS = (
    "week_of", "route", "route_type", "cost_per_tonne_km", "vs_own_history_pct",
    "vs_similar_routes_pct", "verdict",
)


def anomaly_view(metrics: DataFrame, decisions: DataFrame, records: DataFrame) -> DataFrame:
    """One flat row per candidate: figures, trigger, verdict, reason and source."""
    return (
        metrics.where("candidate_anomaly")
        .join(decisions, list(KEY)).join(records.select(*KEY, "reason", "explanation_source"), list(KEY))
        .select(
            candidate_key(F.col("route"), F.col("week_of")).alias("candidate_key"), *KEY,
            "cost_per_tonne_km",
            F.col("own_history_avg_cost_per_tonne_km").alias("own_history_baseline"),
            F.col("similar_routes_avg_cost_per_tonne_km").alias("peer_baseline"),
            "vs_own_history_pct", "vs_similar_routes_pct", "history_weeks_used", "peer_routes_used",
            "own_threshold_breached", "peer_threshold_breached", candidate_trigger().alias("trigger"),
            "verdict", F.when(F.col("verdict") == "justified", "No (justified)").otherwise("Yes").alias("flagged"),
            F.col("selected_note_id").alias("matched_note_id"), "first_supporting_note_id",
            "supporting_note_count", F.col("reason_template_key").alias("decision_code"), "reason",
            "explanation_source", (F.col("explanation_source") == "fallback").alias("fallback_used"),
            (F.col("verdict") == "unexplained").alias("operational_root_cause_available")))


def evidence_rows(assessed: DataFrame, decisions: DataFrame, notes: DataFrame) -> DataFrame:
    """One row per assessed pair with its role and the note's facts."""
    role = (
        F.when(flag(F.col("note_id") == F.col("selected_note_id")), "primary")
        .when(F.col("evidence_level") == "partial", "supporting").otherwise("rejected"))
    facts = notes.select("note_id", "original_text", "scope_type", "applies_to_routes", "effective_from",
                         "effective_to", "event_type", "impact_direction", "affects_transport_cost",
                         "magnitude_text")
    return (
        assessed.join(decisions.select(*KEY, "verdict", "selected_note_id"), list(KEY)).join(facts, "note_id")
        .select(*KEY, "verdict", "note_id", "evidence_level", role.alias("role"), "rejection_codes",
                "overlap_days", *[c for c in facts.columns if c != "note_id"],
                gate_results().alias("gate_results")))


def anomaly_view_join(view: DataFrame, rows: DataFrame) -> DataFrame:
    """Each anomaly with its evidence, one row per assessed note; an anomaly without any keeps
    one row with an empty note. The grain is the same for any number of notes."""
    return view.join(rows.drop("verdict"), list(KEY), "left")


def route_timeline(metrics: DataFrame, decisions: DataFrame, route: str | None = None,
                   week_from: dt.date | None = None, week_to: dt.date | None = None) -> DataFrame:
    """All weeks of a route in order with baselines, flag and verdict."""
    chosen = metrics
    if route is not None:
        chosen = chosen.where(F.col("route") == route)
    if week_from is not None:
        chosen = chosen.where(F.col("week_of") >= F.lit(week_from))
    if week_to is not None:
        chosen = chosen.where(F.col("week_of") <= F.lit(week_to))
    return chosen.join(decisions.select(*KEY, "verdict"), list(KEY), "left").select(
        *KEY, "cost_per_tonne_km",
        F.col("own_history_avg_cost_per_tonne_km").alias("own_history_baseline"),
        F.col("similar_routes_avg_cost_per_tonne_km").alias("peer_baseline"),
        "vs_own_history_pct", "vs_similar_routes_pct", "history_weeks_used", "peer_routes_used",
        F.col("candidate_anomaly").alias("candidate"), "verdict").orderBy("route", "week_of", "route_type")


def timeline_reconcile(timeline: DataFrame, view: DataFrame) -> DataFrame:
    """Candidate points of the timelines and anomalies that lack a counterpart."""
    from .report import key_set_difference

    return key_set_difference(timeline.where("candidate"), view, KEY)


def _filtered(view: DataFrame, route=None, route_type=None, verdict=None, trigger=None, week_from=None,
              week_to=None, min_own_deviation_pct=None, min_peer_deviation_pct=None) -> DataFrame:
    if week_from and week_to and week_from > week_to:
        raise ValueError("the first week lies after the last week")
    for column, value in (("route", route), ("route_type", route_type), ("verdict", verdict), ("trigger", trigger)):
        if value is not None:
            view = view.where(F.col(column) == value)
    if week_from is not None:
        view = view.where(F.col("week_of") >= F.lit(week_from))
    if week_to is not None:
        view = view.where(F.col("week_of") <= F.lit(week_to))
    if min_own_deviation_pct is not None:
        view = view.where(F.col("vs_own_history_pct") >= min_own_deviation_pct)
    if min_peer_deviation_pct is not None:
        view = view.where(F.col("vs_similar_routes_pct") >= min_peer_deviation_pct)
    return view


def list_anomalies(view: DataFrame, *, sort_by: str = "week_of", sort_order: str = "asc",
                   limit: int = 20, offset: int = 0, **filters) -> DataFrame:
    """One page. Ties stay in ascending key order and missing values last, either way."""
    if sort_by not in SORT_FIELDS or sort_order not in ("asc", "desc"):
        raise ValueError(f"sort_by takes one of {SORT_FIELDS}, sort_order asc or desc")
    first = F.col(sort_by).asc_nulls_last() if sort_order == "asc" else F.col(sort_by).desc_nulls_last()
    return _filtered(view, **filters).orderBy(first, "route", "week_of", "route_type").offset(offset).limit(limit)


def count_anomalies(view: DataFrame, **filters) -> DataFrame:
    """Total that belongs to a page."""
    return _filtered(view, **filters).agg(F.count(F.lit(1)).alias("total"))


def _at(rows: DataFrame, route: str, week_of: dt.date, route_type: str | None) -> DataFrame:
    chosen = rows.where((F.col("route") == route) & (F.col("week_of") == F.lit(week_of)))
    return chosen if route_type is None else chosen.where(F.col("route_type") == route_type)


def get_anomaly(view: DataFrame, route: str, week_of: dt.date, route_type: str | None = None) -> DataFrame:
    """The anomaly of a route and week; without a type, one row per type that has one."""
    return _at(view, route, week_of, route_type)


def get_root_cause(analyses: DataFrame, view: DataFrame, route: str, week_of: dt.date,
                   route_type: str | None = None) -> DataFrame:
    """The decomposition of one anomaly, only when its verdict is unexplained."""
    allowed = get_anomaly(view, route, week_of, route_type).where("verdict = 'unexplained'")
    return _at(analyses, route, week_of, route_type).join(allowed, list(KEY), "left_semi")


def list_rejected_evidence(rows: DataFrame, *, route=None, week_of=None, week_from=None, week_to=None,
                           note_id=None, rejection_code=None, limit: int | None = None) -> DataFrame:
    """Rejected pairs, filtered, by week, route and note."""
    chosen = rows.where("role = 'rejected'")
    if route is not None:
        chosen = chosen.where(F.col("route") == route)
    if week_of is not None:
        chosen = chosen.where(F.col("week_of") == F.lit(week_of))
    if week_from is not None:
        chosen = chosen.where(F.col("week_of") >= F.lit(week_from))
    if week_to is not None:
        chosen = chosen.where(F.col("week_of") <= F.lit(week_to))
    if note_id is not None:
        chosen = chosen.where(F.col("note_id") == note_id)
    if rejection_code is not None:
        chosen = chosen.where(F.array_contains("rejection_codes", rejection_code))
    ordered = chosen.orderBy("week_of", "route", "note_id")
    return ordered if limit is None else ordered.limit(limit)


def top_anomalies(view: DataFrame, by: str = "vs_own_history_pct", n: int = 5) -> DataFrame:
    return list_anomalies(view, sort_by=by, sort_order="desc", limit=n)


def attention_spotlight(view: DataFrame) -> DataFrame:
    """Largest own deviation among the unexplained, else among the partly explained."""
    priority = F.when(F.col("verdict") == "unexplained", 0).otherwise(1)
    return view.where(F.col("verdict").isin("unexplained", "partially_explained")).orderBy(
        priority, F.col("vs_own_history_pct").desc_nulls_last(), "route", "week_of", "route_type").limit(1)


def analysis_summary(metrics: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row of counts and range; ``verdicts_add_up`` tells whether they reconcile."""
    totals = metrics.agg(
        F.sum("shipment_count").alias("shipment_count"), F.countDistinct("route").alias("route_count"),
        F.countDistinct("route_type").alias("route_type_count"),
        F.count(F.lit(1)).alias("weekly_record_count"),
        F.count_if("candidate_anomaly").alias("candidate_count"),
        F.min("week_of").alias("analysis_from"), F.max("week_of").alias("analysis_to"))
    verdict = lambda v: F.count_if(F.col("verdict") == v)
    counts = decisions.agg(
        verdict("justified").alias("justified_count"),
        verdict("partially_explained").alias("partially_explained_count"),
        verdict("unexplained").alias("unexplained_count"))
    return totals.join(counts).withColumn(
        "verdicts_add_up",
        F.col("justified_count") + F.col("partially_explained_count") + F.col("unexplained_count")
        == F.col("candidate_count"))


def run_metrics(metrics: DataFrame, notes: DataFrame, decisions: DataFrame, records: DataFrame) -> DataFrame:
    """Row counts per stage and explanation usage. The cost is NULL if any is NULL."""
    u = lambda c: F.sum(F.col("usage")[c])
    stages = metrics.agg(
        F.sum("shipment_count").alias("shipments"), F.count(F.lit(1)).alias("weekly"),
        F.count_if("candidate_anomaly").alias("candidates"))
    compiled = notes.where("compile_error IS NULL").agg(F.count(F.lit(1)).alias("compiled_notes"))
    eligible = decisions.agg(F.count_if(F.col("verdict") == "unexplained").alias("root_cause_eligible"))
    usage = records.agg(
        F.count_if(F.col("verdict") != "unexplained").alias("explanation_request_count"),
        F.sum("provider_attempts").alias("hosted_model_call_count"),
        u("input_tokens").alias("input_tokens"), u("output_tokens").alias("output_tokens"),
        F.when(F.count_if(F.col("estimated_cost_usd").isNull()) == 0,
               F.sum("estimated_cost_usd")).alias("estimated_cost_usd"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.count_if(~F.col("cache_hit") & (F.col("provider_attempts") > 0)).alias("cache_misses"),
        F.count_if(F.col("explanation_source") == "fallback").alias("fallback_count"))
    return stages.join(compiled).join(eligible).join(usage)
