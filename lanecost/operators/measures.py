"""Quality measures over expected and actual results, and the status rollup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import flag
from ..schemas import KEY


def golden_compare(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Full outer join of expected and actual decisions, compared null-safely.

    Both: KEY, verdict, selected_note_id, first_supporting_note_id, supporting_note_count.
    """
    fields = ("verdict", "selected_note_id", "first_supporting_note_id", "supporting_note_count")
    side = lambda df, p: df.select(*KEY, *[F.col(c).alias(f"{p}_{c}") for c in fields],
                                   F.lit(True).alias(f"in_{p}"))
    both = side(expected, "expected").join(side(actual, "actual"), list(KEY), "full_outer")
    same = reduce(lambda a, b: a & b,
                  [F.col(f"expected_{c}").eqNullSafe(F.col(f"actual_{c}")) for c in fields])
    return both.withColumns({
        "in_expected": flag(F.col("in_expected")), "in_actual": flag(F.col("in_actual")),
        "matches": same & flag(F.col("in_expected")) & flag(F.col("in_actual"))})


def _ratio(numerator: Column, denominator: Column, empty: float = 0.0) -> Column:
    return F.coalesce(numerator / F.nullif(denominator, F.lit(0)), F.lit(empty))


def evidence_quality_metrics(compared: DataFrame, assessed: DataFrame, unsafe_notes: DataFrame) -> DataFrame:
    """(metric_id, numerator, denominator, value) of the verdict and gate quality.

    ``unsafe_notes`` are note ids that must never be accepted.
    """
    expected, actual = F.col("expected_verdict"), F.col("actual_verdict")
    count = lambda cond: F.count_if(flag(cond))
    c = compared.agg(
        count(F.col("in_expected")).alias("labelled"), count(F.col("matches")).alias("correct"),
        count(expected != "justified").alias("not_justified"),
        count((expected != "justified") & (actual == "justified")).alias("false_clear"),
        count(actual == "justified").alias("predicted_full"), count(expected == "justified").alias("expected_full"),
        count((expected == "justified") & (actual == "justified")).alias("correct_full"),
        count(actual != "unexplained").alias("predicted_accepted"),
        count(expected != "unexplained").alias("expected_accepted"),
        count((expected != "unexplained") & (actual != "unexplained")).alias("correct_accepted"))
    u = assessed.join(unsafe_notes.select("note_id"), "note_id", "left_semi").agg(
        F.count(F.lit(1)).alias("unsafe"), count(F.col("evidence_level") != "rejected").alias("unsafe_accepted"))
    n = F.col
    rows = (
        ("evidence.verdict_accuracy", n("correct"), n("labelled"), 0.0),
        ("evidence.false_clearance_rate", n("false_clear"), n("not_justified"), 0.0),
        ("evidence.unsafe_evidence_acceptance_rate", n("unsafe_accepted"), n("unsafe"), 0.0),
        ("evidence.selected_note_accuracy", n("correct"), n("labelled"), 0.0),
        ("evidence.full_evidence_precision", n("correct_full"), n("predicted_full"), 0.0),
        ("evidence.full_evidence_recall", n("correct_full"), n("expected_full"), 0.0),
        ("evidence.accepted_evidence_precision", n("correct_accepted"), n("predicted_accepted"), 0.0),
        ("evidence.accepted_evidence_recall", n("correct_accepted"), n("expected_accepted"), 0.0),
        ("evidence.rejected_evidence_accuracy", n("unsafe") - n("unsafe_accepted"), n("unsafe"), 1.0))
    return c.join(u).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric_id"), a.alias("numerator"), b.alias("denominator"),
                 _ratio(a, b, empty).alias("value")) for name, a, b, empty in rows])))


def explanation_quality_metrics(records: DataFrame, decisions: DataFrame, packets: DataFrame,
                                validated: DataFrame) -> DataFrame:
    """(metric_id, numerator, denominator, value) over final records.

    Citations are checked by an anti join to those packet notes that are cited at all, so that
    the packets, which grow with the notes, are only read. ``validated`` is the
    grounding result of the record texts (text_id, failure_codes).
    """
    keyed = records.join(
        decisions.select(*KEY, F.col("verdict").alias("_v"), F.col("selected_note_id").alias("_s")),
        list(KEY), "left")
    cited = records.select(*KEY, F.explode(F.array_distinct("cited_note_ids")).alias("note_id"))
    known = packets.select(*KEY, "note_id").join(cited.distinct(), [*KEY, "note_id"], "left_semi").distinct()
    unknown = cited.join(known, [*KEY, "note_id"], "left_anti").select(*KEY).distinct()
    unauthorised = unknown.agg(F.count(F.lit(1)).alias("bad_ids"))
    numbers = validated.agg(
        F.count_if(F.array_contains("failure_codes", "unsupported_numeric_claim")).alias("bad_numbers"),
        F.count_if(~F.array_contains("failure_codes", "verdict_language_conflict")).alias("language"),
        F.count(F.lit(1)).alias("validated"))
    c = keyed.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(flag(F.col("verdict") == F.col("_v"))).alias("identity"),
        F.count_if(F.col("selected_note_id").eqNullSafe(F.col("_s"))).alias("invariant"),
        F.count_if(F.trim("reason") != "").alias("covered"))
    n = F.col
    rows = (
        ("explanation.identity_binding_accuracy", n("identity"), n("total")),
        ("explanation.authorized_citation_rate", n("total") - n("bad_ids"), n("total")),
        ("explanation.unsupported_note_id_rate", n("bad_ids"), n("total")),
        ("explanation.unsupported_numeric_claim_rate", n("bad_numbers"), n("validated")),
        ("explanation.fallback_coverage_rate", n("covered"), n("total")),
        ("explanation.decision_invariance_rate", n("invariant"), n("total")),
        ("explanation.verdict_language_consistency_rate", n("language"), n("validated")))
    return c.join(unauthorised).join(numbers).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric_id"), a.alias("numerator"), b.alias("denominator"),
                 _ratio(a, b).alias("value")) for name, a, b in rows])))


def check_rollup(checks: DataFrame, metrics: DataFrame) -> DataFrame:
    """Status per domain: fail when a blocking check fails or a blocking metric misses
    its target.

    ``checks``: domain, check_id, blocking, status. ``metrics``: domain, metric_id,
    blocking, value, target, target_relation (eq, ge, le, informational).
    """
    relation, value, target = F.col("target_relation"), F.col("value"), F.col("target")
    met = (
        F.when((relation == "informational") | target.isNull(), True)
        .when(relation == "eq", value == target).when(relation == "ge", value >= target)
        .when(relation == "le", value <= target).otherwise(False))
    facts = checks.select("domain", (~F.col("blocking") | (F.col("status") == "pass")).alias("ok"),
                          F.lit("check").alias("kind")).unionByName(
        metrics.select("domain", (~F.col("blocking") | flag(met)).alias("ok"), F.lit("metric").alias("kind")))
    return facts.groupBy("domain").agg(
        F.count_if(F.col("kind") == "check").alias("checks"),
        F.count_if(F.col("kind") == "metric").alias("metrics"),
        F.count_if(~F.col("ok")).alias("failing"),
        F.when(F.bool_and("ok"), "pass").otherwise("fail").alias("status"))
