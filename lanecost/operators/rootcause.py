"""Decomposition of unexplained cost gaps into mix, rate, entry and exit effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expressions import flag, order_free_sums, signed_text
from ..schemas import Decomposition, HISTORY_WEEKS, KEY
from .baselines import history_window
from .candidates import candidate_key

LENSES = ("transporter", "material")

# Units, statements and caveats of the result contract.
METRICS = (
    ("shipment_count", "shipments",
     "Shipment-count change is descriptive and may indicate consolidation or fragmentation."),
    ("average_load_tonnes", "tonnes/shipment",
     "Average-load change may warrant a load-utilization investigation."),
    ("weighted_average_distance_km", "km",
     "Distance change may be associated with nonlinear fixed-charge or routing effects."),
    ("total_quantity_tonnes", "tonnes", "Tonnage change is descriptive operating context."),
    ("total_tonne_km", "tonne-km", "Tonne-km change is descriptive operating context."),
    ("freight_cost_per_shipment", "INR/shipment",
     "Per-shipment freight change is descriptive and is not a causal finding."),
    ("shipments_per_100_tonnes", "shipments/100 tonnes",
     "This is a descriptive fragmentation indicator, not a proven efficiency measure."),
)
CAVEATS = (
    "Operational leads are descriptive shipment patterns, not validated context evidence.",
    "Transporter and material lenses independently partition the same gap and must not be added together.",
)


def unexplained_candidates(metrics: DataFrame, decisions: DataFrame) -> DataFrame:
    """Semi join: candidates whose decision is unexplained."""
    open_cases = decisions.where("verdict = 'unexplained'")
    return metrics.where("candidate_anomaly").join(open_cases, list(KEY), "left_semi")


def unmatched_decisions(metrics: DataFrame, decisions: DataFrame) -> DataFrame:
    """Unexplained decisions that do not meet exactly one candidate row; must be empty."""
    seen = metrics.where("candidate_anomaly").groupBy(*KEY).count()
    return decisions.where("verdict = 'unexplained'").join(seen, list(KEY), "left").where(
        ~flag(F.col("count") == 1)).select(*KEY)


def reference_week_join(candidates: DataFrame, weekly: DataFrame) -> DataFrame:
    """Each candidate with its previous up to eight observed weeks.

    Weeks are numbered per route; a past week n serves the candidates n+1..n+8, so
    this is an equi-join with at most eight rows per week.
    """
    numbered = weekly.select(*KEY, F.row_number().over(history_window()).alias("n"))
    current = candidates.select(*KEY).join(numbered, list(KEY))
    past = numbered.select(
        "route", "route_type", F.col("week_of").alias("ref_week"),
        F.explode(F.sequence(F.col("n") + 1, F.col("n") + HISTORY_WEEKS)).alias("n"))
    return current.join(past, ["route", "route_type", "n"]).select(*KEY, "ref_week")


def root_cause_base(candidates: DataFrame, weekly: DataFrame, references: DataFrame,
                    settings: Decomposition = Decomposition()) -> DataFrame:
    """Current rate, baseline, gap, and whether they agree with the weekly rows."""
    past = weekly.select("route", "route_type", F.col("week_of").alias("ref_week"),
                         F.col("cost_per_tonne_km").alias("ref_rate"))
    window = references.join(past, ["route", "route_type", "ref_week"], "left").groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("reference_week_count"), F.avg("ref_rate").alias("_mean"),
        F.array_sort(F.collect_list("ref_week")).alias("reference_weeks"))
    current = weekly.select(*KEY, F.col("cost_per_tonne_km").alias("current_cost_per_tonne_km"))
    tol = settings.gap_tolerance
    return (
        candidates.join(current, list(KEY), "left").join(window, list(KEY), "left")
        .select(
            *KEY, candidate_key(F.col("route"), F.col("week_of")).alias("candidate_key"),
            "reference_weeks", F.coalesce("reference_week_count", F.lit(0)).alias("reference_week_count"),
            "current_cost_per_tonne_km",
            F.col("own_history_avg_cost_per_tonne_km").alias("own_history_baseline"),
            (F.col("current_cost_per_tonne_km") - F.col("own_history_avg_cost_per_tonne_km")).alias("target_gap"),
            flag((F.abs(F.col("current_cost_per_tonne_km") - F.col("cost_per_tonne_km")) <= tol)
                 & (F.abs(F.col("_mean") - F.col("own_history_avg_cost_per_tonne_km")) <= tol)
                 & (F.col("reference_week_count") == F.col("history_weeks_used"))).alias("reconciles"))
        .withColumn("support_level", result_support(F.col("reference_week_count"))))


def result_support(weeks):
    return (F.when(weeks >= 6, "strong").when(weeks >= 3, "moderate")
            .when(weeks >= 1, "limited").otherwise("unavailable"))


def category_shares(shipments: DataFrame) -> DataFrame:
    """Per route-week, lens and category: shipments, totals, share and rate.

    One pass over the shipments for both lenses. Ids are unique by contract, so a
    plain count replaces a distinct count and every aggregate combines map-side.
    """
    lenses = F.array(*[F.struct(F.lit(l).alias("lens"), F.col(l).alias("category")) for l in LENSES])
    totals = order_free_sums(
        shipments.select(*KEY, "tonne_km", "freight_cost_inr", F.inline(lenses)), [*KEY, "lens", "category"],
        {"_tk": "tonne_km", "_fr": "freight_cost_inr"}, shipments=F.count(F.lit(1)))
    whole = order_free_sums(totals, [*KEY, "lens"], {"_all": "_tk"})
    return totals.join(whole, [*KEY, "lens"]).select(
        *KEY, "lens", "category", "shipments", F.col("_tk").alias("tonne_km"), F.col("_fr").alias("freight_cost_inr"),
        (F.col("_tk") / F.col("_all")).alias("share"), (F.col("_fr") / F.col("_tk")).alias("rate"))


def category_full_outer(references: DataFrame, shares: DataFrame) -> DataFrame:
    """Current against each reference week by category; a missing side stays NULL."""
    values = F.struct("shipments", "share", "rate")
    now = references.join(
        shares.select(*KEY, "lens", "category", values.alias("now")), list(KEY))
    past = references.join(
        shares.select("route", "route_type", F.col("week_of").alias("ref_week"), "lens", "category",
                      values.alias("past")), ["route", "route_type", "ref_week"])
    return now.join(past, [*KEY, "ref_week", "lens", "category"], "full_outer")


def mix_rate_decomposition(references: DataFrame, shares: DataFrame,
                           settings: Decomposition = Decomposition()) -> DataFrame:
    """Effects per candidate, lens and category, averaged over the reference weeks."""
    now, past = F.col("now"), F.col("past")
    both, entered, left = (now.isNotNull() & past.isNotNull(), past.isNull(), now.isNull())
    n = references.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    total = lambda cond, value: F.sum(F.when(cond, value).otherwise(0.0))
    sums = category_full_outer(references, shares).groupBy(*KEY, "lens", "category").agg(
        F.coalesce(F.max(now.shipments), F.lit(0)).alias("current_shipment_count"),
        F.coalesce(F.sum(past.shipments), F.lit(0)).alias("reference_shipment_count"),
        F.count(past).alias("reference_weeks_present"),
        F.max(now.share).alias("current_tonne_km_share"), F.sum(past.share).alias("_share"),
        F.max(now.rate).alias("current_cost_per_tonne_km"),
        F.avg(past.rate).alias("reference_mean_cost_per_tonne_km"),
        total(both, 0.5 * (now.share - past.share) * (now.rate + past.rate)).alias("_mix"),
        total(both, 0.5 * (now.rate - past.rate) * (now.share + past.share)).alias("_rate"),
        total(entered, now.share * now.rate).alias("_entry"),
        total(left, -past.share * past.rate).alias("_exit"))
    effects = sums.join(n, list(KEY)).withColumns({
        f"{e}_effect": F.col(f"_{e}") / F.col("_n") for e in ("mix", "rate", "entry", "exit")
    } | {"reference_mean_tonne_km_share": F.coalesce("_share", F.lit(0.0)) / F.col("_n")})
    effects = effects.withColumn(
        "net_contribution",
        F.col("mix_effect") + F.col("rate_effect") + F.col("entry_effect") + F.col("exit_effect"))
    return absolute_effect_share(effects).withColumns({
        "direction": effect_direction(F.col("net_contribution"), settings),
        "support_level": category_support(settings),
    }).select(
        *KEY, "lens", "category", "current_shipment_count", "reference_shipment_count",
        "reference_weeks_present", "current_tonne_km_share", "reference_mean_tonne_km_share",
        "current_cost_per_tonne_km", "reference_mean_cost_per_tonne_km", "mix_effect", "rate_effect",
        "entry_effect", "exit_effect", "net_contribution", "absolute_effect_share_pct",
        "direction", "support_level")


def absolute_effect_share(effects: DataFrame) -> DataFrame:
    """abs(effect) as percent of the lens total; missing when the total is zero. A partition
    holds the categories of one candidate and lens, which the effects are grouped by already."""
    whole = F.sum(F.abs("net_contribution")).over(Window.partitionBy(*KEY, "lens"))
    return effects.withColumn(
        "absolute_effect_share_pct", F.abs("net_contribution") / F.nullif(whole, F.lit(0.0)) * 100)


def effect_direction(net, settings: Decomposition = Decomposition()):
    tol = settings.gap_tolerance
    return (F.when(net > tol, "increases_gap").when(net < -tol, "offsets_gap").otherwise("neutral"))


def category_support(settings: Decomposition = Decomposition()):
    """Transition first, then strong, else limited."""
    now, past, weeks = (F.col(c) for c in ("current_shipment_count", "reference_shipment_count",
                                          "reference_weeks_present"))
    moved = (F.col("entry_effect") != 0) | (F.col("exit_effect") != 0)
    return (
        F.when(moved & ((now == 0) | (weeks == 0)), "transition_only")
        .when((now >= settings.shipments_now)
              & (past >= settings.shipments_before) & (weeks >= settings.weeks_before), "strong")
        .otherwise("limited"))


def decomposition_reconcile(contributions: DataFrame, base: DataFrame,
                            settings: Decomposition = Decomposition()) -> DataFrame:
    """Per candidate and lens: do the effects add up to the gap?"""
    sums = contributions.groupBy(*KEY, "lens").agg(F.sum("net_contribution").alias("reconstructed_gap"))
    error = F.col("reconstructed_gap") - F.col("target_gap")
    return sums.join(base.select(*KEY, "target_gap"), list(KEY)).select(
        *KEY, "lens", "target_gap", "reconstructed_gap", error.alias("reconstruction_error"),
        (F.abs(error) <= settings.gap_tolerance).alias("reconciles"))


def lead_rank(contributions: DataFrame, settings: Decomposition = Decomposition()) -> DataFrame:
    """Top leads (positive) and offsets (negative) per candidate and lens.

    A lens partition holds at most as many rows as pass the share threshold, that is
    100 / least_share_pct, so the window is small by construction.
    """
    net = F.col("net_contribution")
    eligible = contributions.where(
        (net != 0) & (F.abs(net) >= settings.least_effect)
        & (F.coalesce("absolute_effect_share_pct", F.lit(0.0)) >= settings.least_share_pct)
    ).withColumn("kind", F.when(net > 0, "lead").otherwise("offset"))
    order = Window.partitionBy(*KEY, "lens", "kind").orderBy(F.abs(net).desc(), "category")
    limit = F.when(F.col("kind") == "lead", settings.leads_shown).otherwise(settings.offsets_shown)
    return eligible.withColumn("lead_rank", F.row_number().over(order)).where(F.col("lead_rank") <= limit)


def operational_leads(contributions: DataFrame, settings: Decomposition = Decomposition()) -> DataFrame:
    narrative = F.concat(
        F.col("category"), F.lit(" showed "),
        F.when(F.col("kind") == "lead", "a positive").otherwise("an offsetting"),
        F.lit(" "), F.col("lens"), F.lit(" decomposition effect of "),
        signed_text(F.col("net_contribution"), 4),
        F.lit(" INR/t-km. This is an operational lead, not accepted contextual evidence."),
        F.when(F.col("support_level") != "strong", " It has limited support.").otherwise(""))
    return lead_rank(contributions, settings).select(
        *KEY, "lens", "kind", "lead_rank", "category", F.col("net_contribution").alias("effect"),
        "support_level", narrative.alias("narrative"))


def operational_metrics(weekly: DataFrame) -> DataFrame:
    """Seven ratios per route-week, all from the weekly totals: no second scan."""
    n, t, tk, fr = (F.col(c).cast("double") for c in (
        "shipment_count", "total_quantity_tonnes", "total_tonne_km", "total_freight_cost_inr"))
    values = (n, t / n, tk / t, t, tk, fr / n, n / t * 100)
    rows = F.array(*[F.struct(F.lit(m[0]).alias("metric"), v.alias("value"))
                     for m, v in zip(METRICS, values)])
    return weekly.select(*KEY, F.inline(rows))


def metric_comparison(references: DataFrame, weekly: DataFrame,
                      settings: Decomposition = Decomposition()) -> DataFrame:
    """Current value against the mean of the reference weeks, with highlight flag."""
    metrics = operational_metrics(weekly)
    past = references.join(
        metrics.withColumnRenamed("week_of", "ref_week"), ["route", "route_type", "ref_week"]
    ).groupBy(*KEY, "metric").agg(F.avg("value").alias("reference_mean"))
    change = F.col("value") - F.col("reference_mean")
    percent = change / F.nullif(F.col("reference_mean"), F.lit(0.0)) * 100
    unit = F.create_map(*[F.lit(x) for m in METRICS for x in (m[0], m[1])])
    meaning = F.create_map(*[F.lit(x) for m in METRICS for x in (m[0], m[2])])
    return past.join(metrics, [*KEY, "metric"]).select(
        *KEY, "metric", unit[F.col("metric")].alias("unit"), F.col("value").alias("current_value"),
        "reference_mean", change.alias("absolute_change"), percent.alias("percentage_change"),
        flag(F.abs(percent) >= settings.highlight_pct).alias("highlighted"),
        meaning[F.col("metric")].alias("interpretation"))


def root_cause_analysis(base: DataFrame, contributions: DataFrame, leads: DataFrame,
                        comparisons: DataFrame) -> DataFrame:
    """Nested result per candidate, for the JSON sink. A candidate's arrays are bounded
    by its categories, seven metrics and the lead limits."""
    nested = lambda df, name, cols, order: df.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct(*order, *[c for c in cols if c not in order]))).alias(name))
    lenses = nested(
        contributions.withColumn("_order", -F.col("net_contribution")), "contributions",
        [c for c in contributions.columns if c not in KEY], ["lens", "_order", "category"])
    lead_rows = nested(leads, "leads", [c for c in leads.columns if c not in KEY],
                       ["lens", "kind", "lead_rank"])
    metric_rows = nested(comparisons, "operational_metrics",
                         [c for c in comparisons.columns if c not in KEY], ["metric"])
    keys = list(KEY)
    return (
        base.join(lenses, keys, "left").join(lead_rows, keys, "left").join(metric_rows, keys, "left")
        .withColumns({
            "contributions": F.transform("contributions", lambda c: c.dropFields("_order")),
            "canonical_verdict": F.lit("unexplained"),
            "caveats": F.array(*[F.lit(c) for c in CAVEATS])}))


def root_cause_checks(base: DataFrame, reconcile: DataFrame, decisions: DataFrame) -> DataFrame:
    """Coverage, reconstruction, no look-ahead and verdict boundary as failure counts."""
    from .quality import check_table

    eligible = decisions.where("verdict = 'unexplained'")
    keys = list(KEY)
    missing = eligible.join(base, keys, "left_anti").agg(F.count(F.lit(1)).alias("eligible_coverage"))
    outside = base.join(eligible, keys, "left_anti").agg(F.count(F.lit(1)).alias("verdict_boundary"))
    ahead = base.agg(
        F.count_if(F.exists("reference_weeks", lambda w: w >= F.col("week_of"))).alias("no_lookahead"),
        F.count_if(~F.col("reconciles")).alias("base_agrees"))
    rebuilt = reconcile.agg(F.count_if(~F.col("reconciles")).alias("reconstruction"))
    return check_table(missing.join(outside).join(ahead).join(rebuilt))
