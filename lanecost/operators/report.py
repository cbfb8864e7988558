"""The eight-column output: review, final reasons and its contract checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import flag, iso
from ..schemas import KEY, OUTPUT_COLUMNS, require_columns
from .candidates import candidates_only, typed_display
from .reconcile import surplus

# Fixed values of the output contract.
REVIEW_UNEXPLAINED = (
    "No context note passed all route, date, direction, cost-impact, and scope checks.")
COST_SHAPE = r"^-?\d+\.\d{2}$"
PERCENT_SHAPE = r"^[+-]\d+\.\d% vs "
NOTE_ID = r"(?i)\bN\d+\b"


def key_set_difference(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Keys on one side only, with the side they are on."""
    keys = list(keys)
    only = lambda a, b, side: a.select(*keys).join(b.select(*keys), keys, "left_anti").withColumn(
        "only_in", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def row_multiset_equality(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows that one side holds more often than the other. Buckets of rows whose hashes
    agree are not shuffled at all (see ``reconcile``)."""
    return surplus(left, right).agg(
        F.coalesce(F.sum(F.when(F.col("_n") > 0, F.col("_n"))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.when(F.col("_n") < 0, -F.col("_n"))), F.lit(0)).alias("only_right"))


def reviewed_reason() -> Column:
    return (
        F.when(F.col("verdict") == "justified", F.concat(
            F.lit("Valid context evidence "), F.col("selected_note_id"),
            F.lit(" applies to this route and week and explicitly supports a transport-cost increase.")))
        .when(F.col("verdict") == "partially_explained", F.concat(
            F.lit("Context note "), F.col("first_supporting_note_id"),
            F.lit(" may explain the own-history rise, but its all-routes scope does not explain"
                  " the route-specific peer premium.")))
        .otherwise(REVIEW_UNEXPLAINED))


def review_output(metrics: DataFrame, decisions: DataFrame) -> DataFrame:
    """Display rows with the verdict applied, and the route type. A candidate without a decision fails."""
    shown = typed_display(metrics).drop("flagged", "matched_note_id", "reason")
    verdicts = decisions.withColumn("week_of", iso(F.col("week_of")))
    missing = F.raise_error(F.concat(F.lit("candidate without a decision: "), F.col("route"))).cast("string")
    justified = F.col("verdict") == "justified"
    return shown.join(verdicts, list(KEY), "left").select(
        "route_type", "route", "week_of", "cost_per_tonne_km", "vs_own_history", "vs_similar_routes",
        F.when(F.col("verdict").isNull(), missing).when(justified, "No (justified)")
         .otherwise("Yes").alias("flagged"),
        F.when(justified, F.col("selected_note_id")).otherwise("").alias("matched_note_id"),
        reviewed_reason().alias("reason")).select("route_type", *OUTPUT_COLUMNS)


def review_key_check(metrics: DataFrame, decisions: DataFrame) -> DataFrame:
    """Keys that candidates and decisions do not share; must be empty."""
    return key_set_difference(candidates_only(metrics), decisions, KEY)


def final_output(reviewed: DataFrame, records: DataFrame) -> DataFrame:
    """Reviewed rows with the final reason; any disagreement of flag, note or cited ids
    with the record fails the job."""
    require_columns(reviewed, ("route_type", *OUTPUT_COLUMNS), exact=True)
    final = records.select(
        "route", "route_type", iso(F.col("week_of")).alias("week_of"), "verdict", "selected_note_id",
        F.col("reason").alias("_reason"), "cited_note_ids")
    joined = reviewed.join(final, list(KEY), "full_outer")
    flag_ok = F.col("flagged") == F.when(F.col("verdict") == "justified", "No (justified)").otherwise("Yes")
    note_ok = F.col("matched_note_id") == F.coalesce("selected_note_id", F.lit(""))
    named = F.transform(F.regexp_extract_all("_reason", F.lit(NOTE_ID), F.lit(0)), F.upper)
    ids_ok = F.size(F.array_except(named, "cited_note_ids")) == 0
    agreed = flag(flag_ok & note_ok & ids_ok)
    conflict = F.raise_error(F.concat_ws(" ", F.lit("final record conflicts with the review:"),
                                         "route", "week_of")).cast("string")
    return joined.withColumn("reason", F.when(agreed, F.col("_reason")).otherwise(conflict)).select(*OUTPUT_COLUMNS)


# --- contract checks ----------------------------------------------------------------
#
# The checks read output rows together with where they came from: ``variant`` (which
# output is checked), ``part`` and ``position`` (file and place in it) and ``malformed``
# (the record did not have eight fields). All checks of all variants run in one pass of
# counters plus one comparison with the expected rows.

CHECKS = (
    "readable", "header", "header_once", "row_count", "field_count", "unique_keys", "sorted",
    "dates", "cost_format", "percentage_format", "flags", "note_mapping", "reasons",
    "authoritative_reconciliation", "reason_note_authority",
)


def _order_breaks(rows: DataFrame) -> DataFrame:
    """Neighbouring rows out of key order, per variant. Order is checked inside each
    part, then between the first and last keys of neighbouring parts, so no task ever
    holds more than one part or the list of parts."""
    key = F.struct("route", "week_of")
    inside = Window.partitionBy("variant", "part").orderBy("position")
    pairs = rows.select("variant", "part", "position", key.alias("k")).withColumn(
        "_before", F.lag("k").over(inside))
    parts = pairs.groupBy("variant", "part").agg(
        F.count_if(flag(F.col("k") < F.col("_before"))).alias("breaks"),
        F.min_by("k", "position").alias("first"), F.max_by("k", "position").alias("last"))
    across = Window.partitionBy("variant").orderBy("part")
    return parts.withColumn("_prev", F.lag("last").over(across)).groupBy("variant").agg(
        (F.sum("breaks") + F.count_if(flag(F.col("first") < F.col("_prev")))).alias("sorted"))


def output_contract_checks(rows: DataFrame, expected: DataFrame, headers: DataFrame) -> DataFrame:
    """(variant, check_id, failures, status): the fifteen checks of the contract.

    ``headers`` is (variant, header, copies): the header text of the output and how
    often it occurs per part. ``expected`` holds the authoritative rows.
    """
    ok = lambda name, cond: F.count_if(~F.col("malformed") & ~flag(cond)).alias(name)
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    justified = filled("flagged") == "No (justified)"
    date_ok = F.coalesce("week_of", F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(
        "week_of", "yyyy-MM-dd").isNotNull()
    counters = rows.groupBy("variant").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if("malformed").alias("field_count"),
        ok("dates", date_ok),
        ok("cost_format", F.col("cost_per_tonne_km").rlike(COST_SHAPE)),
        ok("percentage_format", F.col("vs_own_history").rlike(PERCENT_SHAPE) & (
            F.col("vs_similar_routes").rlike(PERCENT_SHAPE)
            | F.col("vs_similar_routes").startswith("Not available"))),
        ok("flags", filled("flagged").isin("Yes", "No (justified)")),
        ok("note_mapping", (filled("matched_note_id") != "") == justified),
        ok("reasons", F.trim(filled("reason")) != ""),
        ok("reason_note_authority", ~filled("reason").rlike(NOTE_ID)
           | (filled("matched_note_id") != "") | (filled("flagged") == "Yes")))
    # a route may have two types in a week: a key is repeated if it comes more often than it is expected to
    keys = ("route", "week_of")
    due = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("_due"))
    repeated = rows.where("NOT malformed").groupBy("variant", *keys).count().join(due, list(keys), "left").groupBy("variant").agg(
        F.sum(F.greatest(F.lit(0), F.col("count") - F.coalesce("_due", F.lit(1)))).alias("unique_keys"))
    total = expected.agg(F.count(F.lit(1)).alias("_expected"))
    variants = headers.select("variant")
    columns = [filled(c).alias(c) for c in OUTPUT_COLUMNS]
    sides = rows.where("NOT malformed").select("variant", *columns, F.lit(1).alias("_side")).unionByName(
        expected.join(variants).select("variant", *columns, F.lit(-1).alias("_side")))
    unequal = sides.groupBy("variant", *OUTPUT_COLUMNS).agg(F.sum("_side").alias("_n")).groupBy("variant").agg(
        F.sum(F.abs("_n")).alias("authoritative_reconciliation"))
    joined = reduce(lambda a, b: a.join(b, "variant", "left"),
                    [counters, repeated, _order_breaks(rows.where("NOT malformed")), unequal], headers).join(total)
    wanted = ",".join(OUTPUT_COLUMNS)
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    values = {
        "readable": F.col("_rows").isNull().cast("bigint"),
        "header": (~flag(F.col("header") == wanted)).cast("bigint"),
        "header_once": (~flag(F.col("copies") == 1)).cast("bigint"),
        "row_count": F.abs(n("_rows") - n("_expected")),
    }
    results = F.array(*[F.struct(F.lit(f"output.{c}").alias("check_id"), values.get(c, n(c)).alias("failures"))
                        for c in CHECKS])
    return joined.select("variant", F.inline(results)).withColumn(
        "status", F.when(F.col("failures") == 0, "pass").otherwise("fail"))


def tamper_variants(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One corruption per check of the contract, named after the check: (rows, headers).

    A record is written as a line, the line is damaged, and the damaged line is parsed
    again. Field values are damaged in the record of the least key.
    """
    first = rows.agg(F.min(F.struct("route", "week_of")).alias("_first"))
    base = rows.join(first).withColumn("_hit", F.struct("route", "week_of") == F.col("_first"))
    cost = F.col("cost_per_tonne_km")
    fields: dict[str, dict[str, Column]] = {
        "dates": {"week_of": F.concat(F.substring("week_of", 1, 5), F.lit("13-01"))},
        "cost_format": {"cost_per_tonne_km": F.concat(cost, F.lit("5"))},
        "percentage_format": {"vs_own_history": F.regexp_replace("vs_own_history", "^[+-]", "")},
        "flags": {"flagged": F.lit("Perhaps")},
        "note_mapping": {"flagged": F.lit("Yes"), "matched_note_id": F.lit("N7")},
        "reasons": {"reason": F.lit("  ")},
        "authoritative_reconciliation": {"cost_per_tonne_km": F.concat(F.lit("1"), cost)},
        "reason_note_authority": {"flagged": F.lit("No (justified)"), "matched_note_id": F.lit(""), "reason": F.lit("As N7 says.")},
    }
    whole = {
        "readable": base.where(F.lit(False)), "header": base, "header_once": base,
        "row_count": base.where(~F.col("_hit")), "field_count": base,
        "unique_keys": base.unionByName(base.where("_hit")), "sorted": base.withColumn("position", -F.col("position")),
    }
    damaged = [df.withColumn("variant", F.lit(name)) for name, df in whole.items()]
    for name, values in fields.items():
        changed = {c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in values.items()}
        damaged.append(base.withColumns(changed).withColumn("variant", F.lit(name)))
    lines = reduce(lambda a, b: a.unionByName(b), damaged).withColumn(
        "_line", F.to_csv(F.struct(*OUTPUT_COLUMNS), {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}))
    lines = lines.withColumn("_line", F.concat("_line", F.when(
        F.col("_hit") & (F.col("variant") == "field_count"), ",surplus").otherwise("")))
    schema = ", ".join(f"{c} string" for c in (*OUTPUT_COLUMNS, "_corrupt"))
    parsed = lines.withColumn("_record", F.from_csv("_line", F.lit(schema), {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "escape": '"'}))
    back = parsed.withColumns({
        "malformed": F.col("malformed") | F.col("_record._corrupt").isNotNull(),
        **{c: F.col(f"_record.{c}") for c in OUTPUT_COLUMNS}}).select(*rows.columns)
    header = ",".join(OUTPUT_COLUMNS)
    swapped = ",".join((*OUTPUT_COLUMNS[1::-1], *OUTPUT_COLUMNS[2:]))
    headers = rows.sparkSession.createDataFrame(
        [(c, swapped if c == "header" else header, 2 if c == "header_once" else 1) for c in CHECKS],
        "variant string, header string, copies int")
    return back, headers


def tamper_detection(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Per corruption: how many checks it failed, and whether the one it aims at is among them."""
    bad_rows, headers = tamper_variants(rows)
    failed = F.col("status") == "fail"
    return output_contract_checks(bad_rows, expected, headers).groupBy("variant").agg(
        F.count_if(failed).alias("failed_checks"),
        F.bool_or(failed & (F.col("check_id") == F.concat(F.lit("output."), F.col("variant")))).alias("detected"))
