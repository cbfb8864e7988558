"""Data-quality rules as one narrow pass plus one duplicate count.

Every rule yields issue rows (severity, code, dataset, column, row_number); all
issues of a row are kept. ``row_number`` is the physical line of the source and
is supplied as a column, since a distributed scan has no global line counter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import as_rows, close, failures, finite, parsed_number, strip
from ..schemas import (
    BASELINE_COLUMNS, COMPARISON_COLUMNS, HISTORY_WEEKS, ISSUE_COLUMNS, KEY,
    NOTE_TEXT_COLUMNS, ROUTE_TYPES, SHIPMENT_NUMERIC_COLUMNS,
    SHIPMENT_TEXT_COLUMNS, require_columns,
)

ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


@dataclass(frozen=True)
class Rule:
    """An issue code (NULL when the value is fine) for one column of a dataset."""

    dataset: str
    column: str
    code: Column


def text_rules(columns, dataset: str) -> list[Rule]:
    return [
        Rule(dataset, c, F.when(F.col(c).isNull(), "missing_value").when(strip(F.col(c)) == "", "blank_value"))
        for c in columns]


def numeric_rules(columns, dataset: str) -> list[Rule]:
    """Reads the parsed value from the column :func:`row_issues` adds for it."""
    rules = []
    for c in columns:
        value, number = F.col(c), F.col(f"_number_{c}")
        rules.append(Rule(dataset, c, (
            F.when(value.isNull(), "missing_value")
            .when(strip(value) == "", "blank_value")
            .when(number.isNull(), "invalid_type")
            .when(~finite(number), "non_finite_value")
            .when(number <= 0, "non_positive_value"))))
    return rules


def date_rules(column: str, dataset: str) -> list[Rule]:
    value = F.col(column)
    real = value.rlike(ISO_DATE) & F.try_to_date(value, "yyyy-MM-dd").isNotNull()
    return [Rule(dataset, column, (
        F.when(value.isNull(), "missing_value")
        .when(strip(value) == "", "blank_value")
        .when(~F.coalesce(real, F.lit(False)), "invalid_date")))]


def domain_rules(column: str, allowed, code: str, dataset: str) -> list[Rule]:
    stripped = strip(F.col(column))
    return [Rule(dataset, column, F.when((stripped != "") & ~stripped.isin(*allowed), code))]


def derived_finite_rules(dataset: str = "shipments") -> list[Rule]:
    quantity, distance = F.col("_number_quantity_tonnes"), F.col("_number_distance_km")
    above = lambda v: (v > 0) & ~F.isnan(v)  # not-a-number sorts above every number
    bad = above(quantity) & above(distance) & ~finite(quantity * distance)
    return [Rule(dataset, "tonne_km", F.when(bad, "non_finite_value"))]


def row_issues(raw: DataFrame, rules: list[Rule], numbers=()) -> DataFrame:
    """Evaluate the rules in one pass; healthy rows produce nothing.

    Each number is parsed once and each code computed once, as a column of its own;
    the issue rows are then built from those columns. The outer form of the generator
    with a filter after it is deliberate here and below: for the inner form Spark infers
    a "not empty" filter and repeats the whole expression underneath to evaluate it.
    """
    parsed = raw.withColumns({f"_number_{c}": parsed_number(F.col(c)) for c in numbers})
    coded = parsed.select("row_number", *[rule.code.alias(f"_{i}") for i, rule in enumerate(rules)])
    issues = [
        F.when(F.col(f"_{i}").isNotNull(), F.struct(
            F.lit("error").alias("severity"), F.col(f"_{i}").alias("code"),
            F.lit(rule.dataset).alias("dataset"), F.lit(rule.column).alias("column")))
        for i, rule in enumerate(rules)]
    return (
        coded.select("row_number", F.array_compact(F.array(*issues)).alias("found"))
        .select("row_number", F.inline_outer("found")).where("code IS NOT NULL").select(*ISSUE_COLUMNS))


def dq_text(raw: DataFrame, columns, dataset: str) -> DataFrame:
    return row_issues(raw, text_rules(columns, dataset))


def dq_numeric(raw: DataFrame, columns, dataset: str) -> DataFrame:
    return row_issues(raw, numeric_rules(columns, dataset), columns)


def dq_date(raw: DataFrame, column: str, dataset: str) -> DataFrame:
    return row_issues(raw, date_rules(column, dataset))


def dq_domain(raw: DataFrame, column: str = "route_type", allowed=ROUTE_TYPES,
              code: str = "invalid_route_type", dataset: str = "shipments") -> DataFrame:
    return row_issues(raw, domain_rules(column, allowed, code, dataset))


def dq_derived_finite(raw: DataFrame) -> DataFrame:
    return row_issues(raw, derived_finite_rules(), ("quantity_tonnes", "distance_km"))


def dq_identifier(raw: DataFrame, column: str, dataset: str) -> DataFrame:
    """Every copy of a repeated id. The ids are counted with map-side combine, so
    one id holding a third of the rows is a single counter, not a single task."""
    ids = raw.select("row_number", strip(F.col(column)).alias("id")).where("id <> ''")
    repeated = ids.groupBy("id").count().where("count > 1").select("id")
    return ids.join(repeated, "id", "left_semi").select(
        F.lit("error").alias("severity"), F.lit("duplicate_identifier").alias("code"),
        F.lit(dataset).alias("dataset"), F.lit(column).alias("column"), "row_number",
    )


def dq_empty(raw: DataFrame, dataset: str) -> DataFrame:
    """One issue when a table has a header but no row. Only one row is looked for."""
    seen = raw.limit(1).agg(F.count(F.lit(1)).alias("n"))
    return seen.where("n = 0").select(
        F.lit("error").alias("severity"), F.lit("empty_dataset").alias("code"),
        F.lit(dataset).alias("dataset"), F.lit(None).cast("string").alias("column"),
        F.lit(None).cast("long").alias("row_number"),
    )


def shipment_issues(raw: DataFrame) -> DataFrame:
    rules = (
        text_rules(SHIPMENT_TEXT_COLUMNS, "shipments")
        + numeric_rules(SHIPMENT_NUMERIC_COLUMNS, "shipments")
        + date_rules("shipment_date", "shipments")
        + domain_rules("route_type", ROUTE_TYPES, "invalid_route_type", "shipments")
        + derived_finite_rules())
    return issue_union(row_issues(raw, rules, SHIPMENT_NUMERIC_COLUMNS),
                       dq_identifier(raw, "shipment_id", "shipments"))


def note_issues(raw: DataFrame) -> DataFrame:
    rules = text_rules(NOTE_TEXT_COLUMNS, "context_notes") + date_rules("date", "context_notes")
    return issue_union(row_issues(raw, rules), dq_identifier(raw, "note_id", "context_notes"))


def issue_union(*issues: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), issues)


def sorted_issues(issues: DataFrame) -> DataFrame:
    """Report order; only for a sink."""
    return issues.orderBy(
        "dataset", F.coalesce("row_number", F.lit(0)), F.coalesce("column", F.lit("")), "code",
    )


def dq_report(issues: DataFrame, row_counts: DataFrame) -> DataFrame:
    """Errors, warnings and validity per dataset; ``row_counts`` is (dataset, row_count)."""
    per = issues.groupBy("dataset").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    return row_counts.join(per, "dataset", "left").select(
        "dataset", "row_count",
        F.coalesce("errors", F.lit(0)).alias("errors"),
        F.coalesce("warnings", F.lit(0)).alias("warnings"),
        (F.coalesce("errors", F.lit(0)) == 0).alias("is_valid"),
    )


def header_issues(actual, expected, dataset: str, require_order: bool = False) -> list[tuple]:
    """Header check on the driver: (code, dataset, column) tuples, no job."""
    names = list(actual)
    found = [("duplicate_column", dataset, c) for c in sorted({c for c in names if names.count(c) > 1})]
    found += [("missing_column", dataset, c) for c in expected if c not in names]
    found += [("unexpected_column", dataset, c) for c in sorted(set(names) - set(expected))]
    if require_order and tuple(names) != tuple(expected):
        found.append(("invalid_output_header", dataset, None))
    return sorted(found, key=lambda i: (i[1], i[2] or "", i[0]))


# --- stage input checks: one pass of counters each --------------------------------

def check_table(one_row: DataFrame) -> DataFrame:
    """One row per check with its failure count."""
    return as_rows(one_row, "check_id", "failures").withColumn(
        "status", F.when(F.col("failures") == 0, "pass").otherwise("fail"))


def _repeated_keys(df: DataFrame, keys) -> DataFrame:
    """One-row count of rows whose key was seen before."""
    return df.groupBy(*keys).count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("unique_key"))


def analytics_input_check(shipments: DataFrame) -> DataFrame:
    """Keys, Monday weeks, positive finite numbers, tonne_km consistency, unique ids."""
    numbers = (*SHIPMENT_NUMERIC_COLUMNS, "tonne_km")
    positive = reduce(
        lambda a, b: a & b,
        [finite(F.col(c)) & (F.col(c) > 0) for c in numbers])
    q, d, t = (F.col(c).cast("double") for c in ("quantity_tonnes", "distance_km", "tonne_km"))
    counts = shipments.agg(
        failures(strip(F.col("shipment_id")) != "").alias("id_present"),
        failures((strip(F.col("route")) != "") & (strip(F.col("route_type")) != "")).alias("key_present"),
        failures(F.weekday("week_of") == 0).alias("monday_week"),
        failures(positive).alias("positive_finite"),
        failures(close(t, q * d, 1e-12, 1e-12)).alias("tonne_km_consistent"),
    )
    ids = _repeated_keys(shipments.select(strip(F.col("shipment_id")).alias("id")), ["id"])
    return check_table(counts.join(ids.withColumnRenamed("unique_key", "id_unique")))


def baseline_input_check(weekly: DataFrame) -> DataFrame:
    rate = F.col("total_freight_cost_inr") / F.col("total_tonne_km")
    totals = ("total_freight_cost_inr", "total_quantity_tonnes", "total_tonne_km", "cost_per_tonne_km")
    positive = reduce(lambda a, b: a & b, [finite(F.col(c)) & (F.col(c) > 0) for c in totals])
    counts = weekly.agg(
        failures((strip(F.col("route")) != "") & (strip(F.col("route_type")) != "")).alias("key_present"),
        failures(F.weekday("week_of") == 0).alias("monday_week"),
        failures(F.col("shipment_count") > 0).alias("shipments_present"),
        failures(positive).alias("positive_finite"),
        failures(close(F.col("cost_per_tonne_km"), rate, 1e-12, 1e-12)).alias("rate_formula"),
    )
    return check_table(counts.join(_repeated_keys(weekly, KEY)))


def comparison_input_check(baselines: DataFrame) -> DataFrame:
    require_columns(baselines, BASELINE_COLUMNS)
    own, peer = (F.col(c) for c in ("own_history_avg_cost_per_tonne_km",
                                    "similar_routes_avg_cost_per_tonne_km"))
    n, p = F.col("history_weeks_used"), F.col("peer_routes_used")
    counts = baselines.agg(
        failures(finite(F.col("cost_per_tonne_km")) & (F.col("cost_per_tonne_km") > 0)).alias("rate_positive"),
        failures(own.isNull() | (finite(own) & (own > 0))).alias("own_baseline_positive"),
        failures(peer.isNull() | (finite(peer) & (peer > 0))).alias("peer_baseline_positive"),
        failures(n.between(0, HISTORY_WEEKS)).alias("history_count_range"),
        failures(p >= 0).alias("peer_count_range"),
        failures(own.isNull() == (n == 0)).alias("own_availability"),
        failures(peer.isNull() == (p == 0)).alias("peer_availability"),
    )
    return check_table(counts.join(_repeated_keys(baselines, KEY)))


def candidate_input_check(comparisons: DataFrame, threshold_percent: float = 20.0) -> DataFrame:
    validated_threshold(threshold_percent)
    require_columns(comparisons, COMPARISON_COLUMNS)
    own, peer = F.col("vs_own_history_pct"), F.col("vs_similar_routes_pct")
    counts = comparisons.agg(
        failures(own.isNull() == F.col("own_history_avg_cost_per_tonne_km").isNull()).alias("own_availability"),
        failures(peer.isNull() == F.col("similar_routes_avg_cost_per_tonne_km").isNull()).alias("peer_availability"),
        failures(own.isNull() | finite(own)).alias("own_finite"),
        failures(peer.isNull() | finite(peer)).alias("peer_finite"),
    )
    return check_table(counts.join(_repeated_keys(comparisons, KEY)))


def validated_threshold(value: float) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value < float("inf"):
        raise ValueError("the threshold must be a finite number of at least zero")
    return float(value)


def notes_input_check(notes: DataFrame, known_routes: DataFrame) -> DataFrame:
    """Notes are non-blank, trimmed, unique; the route universe is usable too."""
    present = reduce(lambda a, b: a & b, [strip(F.col(c)) != "" for c in NOTE_TEXT_COLUMNS])
    trimmed = (F.col("note_id") == strip(F.col("note_id"))) & (
        F.col("applies_to") == strip(F.col("applies_to")))
    counts = notes.agg(
        failures(present).alias("text_present"), failures(trimmed).alias("trimmed"),
        failures(F.col("date").isNotNull()).alias("date_present"),
        F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long").alias("notes_present"),
    )
    routes = known_routes.agg(
        failures((strip(F.col("route")) != "") & (F.col("route") == strip(F.col("route")))).alias("routes_usable"),
        F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long").alias("routes_present"),
    )
    ids = _repeated_keys(notes, ["note_id"]).withColumnRenamed("unique_key", "id_unique")
    return check_table(counts.join(routes).join(ids))
