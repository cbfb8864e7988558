"""Evidence without pairs: class rows and memberships instead of (candidate, note) rows.

A note lies in a few classes (scope, aligned block of weeks), a candidate in one per block size
and scope, and a pair is recalled exactly if both lie in one class, which then is the only one.
The two membership tables thus are the whole recall result in a size linear in notes and
candidates; pairs are spelled out only for candidates that are asked for by name.

What the gate says of a pair depends on the note alone, apart from the coverage of accepted
global notes. Notes of a class that agree in what the gate sees are counted together. Where
only totals over all candidates are wanted, even classes are not joined: a sweep over the
weeks of a scope counts the candidates ahead of each beginning and end of an interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import flag
from ..schemas import KEY, EvidencePolicy
from .evidence import (
    BLOCK_KEY, EVERYWHERE, candidate_blocks, coverage, evidence_gate, note_blocks, note_checks, salted_block_join,
    structured_recall, week_number,
)
from .notes import magnitude_upper_bound

FACTS = ("vs_own_history_pct", "peer_threshold_breached")
#: What the gate sees of a recalled pair's note.
SEEN = ("consistent", "scope_status", "cost_ok", "direction_ok", "negation_ok", "upper", "everywhere")
#: Where and when a note applies.
PLACE = ("scope_type", "applies_to_routes", "effective_from", "effective_to")


def seen(notes: DataFrame) -> DataFrame:
    """Compiled notes with the columns ``SEEN``."""
    checks = note_checks()
    return notes.where("compile_error IS NULL").withColumns({
        "consistent": checks["consistent"], "cost_ok": checks["cost_ok"], "direction_ok": checks["direction_ok"],
        "negation_ok": checks["negation_ok"], "upper": magnitude_upper_bound(F.col("magnitude_text")),
        "everywhere": F.col("scope_type") == "global"})


def memberships(candidates: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(of notes, of candidates): class key with note_id and overlap_days, class key with the candidate."""
    return note_blocks(notes, "note_id"), candidate_blocks(candidates)


def class_rows(candidates: DataFrame, notes: DataFrame) -> DataFrame:
    """One row per class that both sides reach: notes, candidates, links between them."""
    of_notes, of_candidates = memberships(candidates, notes)
    left = of_notes.groupBy(*BLOCK_KEY).agg(F.count(F.lit(1)).alias("notes"), F.min("note_id").alias("first_note_id"))
    right = of_candidates.groupBy(*BLOCK_KEY).agg(F.count(F.lit(1)).alias("candidates"))
    return left.join(right, BLOCK_KEY).withColumn("links", F.col("notes") * F.col("candidates"))


def links_of_candidates(candidates: DataFrame, notes: DataFrame) -> DataFrame:
    """Per candidate with a recalled note: notes, least id, days of overlap."""
    classes = note_blocks(notes, "note_id").groupBy(*BLOCK_KEY).agg(
        F.count(F.lit(1)).alias("notes"), F.min("note_id").alias("note_id"), F.sum("overlap_days").alias("overlap_days"))
    return salted_block_join(candidate_blocks(candidates), classes, "note_id").groupBy(*KEY).agg(
        F.sum("notes").alias("notes"), F.min("note_id").alias("first_note_id"), F.sum("overlap_days").alias("overlap_days"))


def links_of_notes(candidates: DataFrame, notes: DataFrame) -> DataFrame:
    """Per note with a recalled candidate: candidates and days of overlap."""
    classes = candidate_blocks(candidates).groupBy(*BLOCK_KEY).agg(F.count(F.lit(1)).alias("candidates"))
    return note_blocks(notes, "note_id").join(classes, BLOCK_KEY).groupBy("note_id").agg(
        F.sum("candidates").alias("candidates"), F.sum(F.col("overlap_days") * F.col("candidates")).alias("overlap_days"))


def audit_of(named: DataFrame, notes: DataFrame, policy: EvidencePolicy = EvidencePolicy()) -> DataFrame:
    """The full gate result of the given candidates only, one row per note that reaches them."""
    return evidence_gate(named, structured_recall(named, notes).drop("overlap_days"), notes, policy)


def _judged(rows: DataFrame, reached: Column) -> DataFrame:
    """Rows with the columns ``SEEN`` as the gate's result columns; ``reached`` is the coverage of a pair
    that passed every hard check."""
    scope_ok = F.col("scope_status").isin("in_dataset", "partially_in_dataset")
    hard = F.col("consistent") & scope_ok & F.col("cost_ok") & F.col("direction_ok") & F.col("negation_ok")
    reached = F.when(hard, reached)
    codes = F.array(
        F.when(~F.col("consistent"), "compiled_claim_inconsistent"),
        F.when(~scope_ok, F.when(F.col("scope_status") == "outside_dataset", "scope_outside_dataset").otherwise("scope_unresolved")),
        F.when(~F.col("cost_ok"), "cost_impact_not_positive"),
        F.when(~F.col("direction_ok"), "impact_direction_not_increase"),
        F.when(~F.col("negation_ok"), "cost_increase_negated"),
        F.when(reached != "full", reached))
    passed = lambda c: F.when(c, "pass").otherwise("fail")
    return rows.withColumns({
        "route_check": F.lit("pass"), "date_check": F.lit("pass"), "scope_check": passed(scope_ok),
        "direction_check": passed(F.col("direction_ok")), "cost_impact_check": passed(F.col("cost_ok")),
        "negation_check": passed(F.col("negation_ok")),
        "evidence_level": F.coalesce(F.when(reached == "full", "full").when(reached.isNotNull(), "partial"), F.lit("rejected")),
        "rejection_codes": F.array_sort(F.array_compact(codes))})


JUDGED = ("route_check", "date_check", "scope_check", "direction_check", "cost_impact_check", "negation_check",
          "evidence_level", "rejection_codes")


def assessed_of_candidates(candidates: DataFrame, notes: DataFrame, policy: EvidencePolicy = EvidencePolicy()) -> DataFrame:
    """The gate per candidate and kind of result: level and codes with the number of notes, the least id
    and the days of overlap. As long as candidates x kinds, for any number of notes."""
    classes = note_blocks(seen(notes), "note_id", *SEEN).groupBy(*BLOCK_KEY, *SEEN).agg(
        F.count(F.lit(1)).alias("notes"), F.min("note_id").alias("note_id"), F.sum("overlap_days").alias("overlap_days"))
    met = salted_block_join(candidate_blocks(candidates, *FACTS), classes, "note_id")
    judged = _judged(met, coverage(~F.col("everywhere"), F.col("upper"), policy))
    return judged.groupBy(*KEY, *JUDGED).agg(
        F.sum("notes").alias("notes"), F.min("note_id").alias("first_note_id"), F.sum("overlap_days").alias("overlap_days"))


def sweep(candidates: DataFrame, notes: DataFrame, *by: str) -> DataFrame:
    """(by, pairs): recalled pairs per value of the note columns ``by``, without a join of the two sides.

    Candidates and interval borders of a scope are put in order of the week; a note meets the
    candidates ahead of its end less those ahead of its beginning. Both sides are added up by
    week first, so a scope has at most as many rows as weeks times values.
    """
    at = F.explode(F.array("route", F.lit(EVERYWHERE))).alias("scope")
    points = candidates.select(at, week_number(F.col("week_of")).alias("week")).groupBy("scope", "week").agg(
        F.count(F.lit(1)).alias("held"))
    scope = F.when(F.col("scope_type") == "global", F.array(F.lit(EVERYWHERE))).otherwise(F.col("applies_to_routes"))
    borders = F.array(
        F.struct(week_number(F.col("effective_from")).alias("week"), F.lit(-1).alias("sign")),
        F.struct(F.coalesce(week_number(F.col("effective_to")) + 1, F.lit(2 ** 40)).alias("week"), F.lit(1).alias("sign")))
    events = notes.where("compile_error IS NULL AND effective_from IS NOT NULL").select(
        *by, F.explode(scope).alias("scope"), borders.cast("array<struct<week:bigint,sign:int>>").alias("borders")).select(*by, "scope", F.explode("borders").alias("border")).select(
        *by, "scope", "border.week", "border.sign")
    events = events.where("scope IS NOT NULL").groupBy(*by, "scope", "week").agg(F.sum("sign").alias("sign"))
    both = events.withColumn("held", F.lit(0).cast("long")).unionByName(points.withColumn("sign", F.lit(None).cast("long")), allowMissingColumns=True)
    ahead = Window.partitionBy("scope").orderBy("week").rangeBetween(Window.unboundedPreceding, -1)
    counted = both.withColumn("ahead", F.coalesce(F.sum("held").over(ahead), F.lit(0))).where("sign IS NOT NULL")
    return counted.groupBy(*by).agg(F.sum(F.col("sign") * F.col("ahead")).alias("pairs")).where("pairs > 0")


def assessed_counts(candidates: DataFrame, notes: DataFrame, policy: EvidencePolicy = EvidencePolicy()) -> DataFrame:
    """The gate's result columns with the number of pairs of each result over all candidates.

    All notes are swept; only the accepted global ones depend on the candidate, and are counted
    by class instead.
    """
    known = seen(notes)
    open_ = F.col("everywhere") & F.col("consistent") & F.col("scope_status").isin("in_dataset", "partially_in_dataset") & F.col(
        "cost_ok") & F.col("direction_ok") & F.col("negation_ok")
    settled = _judged(sweep(candidates, known.where(~flag(open_)), *SEEN), F.lit("full"))
    classes = note_blocks(known.where(flag(open_)), "note_id", *SEEN).groupBy(*BLOCK_KEY, *SEEN).agg(
        F.count(F.lit(1)).alias("pairs"), F.min("note_id").alias("note_id"))
    met = salted_block_join(candidate_blocks(candidates, *FACTS).where(F.col("scope_route") == EVERYWHERE), classes, "note_id")
    judged = _judged(met, coverage(F.lit(False), F.col("upper"), policy))
    return settled.select(*JUDGED, "pairs").unionByName(judged.select(*JUDGED, "pairs")).groupBy(*JUDGED).agg(F.sum("pairs").alias("pairs"))


def rejection_histogram(counts: DataFrame) -> DataFrame:
    """(rejection_code, pairs) of :func:`assessed_counts`."""
    return counts.select(F.explode("rejection_codes").alias("rejection_code"), "pairs").groupBy("rejection_code").agg(
        F.sum("pairs").alias("pairs"))


def supporting_of_candidates(candidates: DataFrame, notes: DataFrame, decisions: DataFrame, *by: str,
                             policy: EvidencePolicy = EvidencePolicy()) -> DataFrame:
    """What a decision may cite, counted: per candidate, role and note columns ``by`` the number of
    notes and the least id. The selected note is one row, the supporting ones are one per value."""
    known = seen(notes)
    accepted = known.where(flag(F.col("everywhere") & F.col("consistent") & F.col("scope_status").isin("in_dataset", "partially_in_dataset")
                                & F.col("cost_ok") & F.col("direction_ok") & F.col("negation_ok")))
    classes = note_blocks(accepted, "note_id", "upper", *by).groupBy(*BLOCK_KEY, "upper", *by).agg(
        F.count(F.lit(1)).alias("notes"), F.min("note_id").alias("note_id"))
    met = salted_block_join(candidate_blocks(candidates, *FACTS).where(F.col("scope_route") == EVERYWHERE), classes, "note_id")
    support = met.where(coverage(F.lit(False), F.col("upper"), policy) != "full").groupBy(*KEY, *by).agg(
        F.sum("notes").alias("notes"), F.min("note_id").alias("first_note_id")).withColumn("role", F.lit("supporting"))
    picked = decisions.where("selected_note_id IS NOT NULL").select(*KEY, F.col("selected_note_id").alias("note_id")).join(
        notes.select("note_id", *by), "note_id").select(
        *KEY, *by, F.lit(1).cast("long").alias("notes"), F.col("note_id").alias("first_note_id"), F.lit("selected").alias("role"))
    return support.unionByName(picked)


def audit_notes(notes: DataFrame) -> DataFrame:
    """One row per note that can be recalled: its scope and interval, and what the gate saw. The blocks it
    lies in follow from these (:func:`audit_memberships`), so they are not stored."""
    return seen(notes).where("effective_from IS NOT NULL").select("note_id", *PLACE, *SEEN)


def audit_memberships(stored: DataFrame) -> DataFrame:
    """Class key, note_id, overlap_days and ``SEEN`` of the stored notes, one row per block."""
    return note_blocks(stored.withColumn("compile_error", F.lit(None).cast("string")), "note_id", *SEEN)


def audit_tables(candidates: DataFrame, notes: DataFrame, decisions: DataFrame,
                 policy: EvidencePolicy = EvidencePolicy()) -> dict[str, tuple[DataFrame, list[str]]]:
    """The whole evidence audit as three tables with the order they are written in: ``candidates`` (results per
    candidate and kind), ``notes`` (:func:`audit_notes`) and ``members`` (classes of the candidates).
    Linear in candidates and notes; :func:`audit_pairs` spells out pairs again."""
    assessed = assessed_of_candidates(candidates, notes, policy).join(decisions.select(*KEY, "verdict", "selected_note_id"), list(KEY))
    return {"candidates": (assessed, list(KEY)),
            "notes": (audit_notes(notes), ["note_id"]),
            "members": (candidate_blocks(candidates, *FACTS), [*KEY, *BLOCK_KEY])}


def write_audit(path: str, tables: dict[str, tuple[DataFrame, list[str]]]) -> str:
    """:func:`audit_tables` as JSON lines, each table in its folder below ``path``."""
    for name, (table, order) in tables.items():
        table.orderBy(*order).write.option("ignoreNullFields", False).json(f"{path}/{name}")
    return path


def audit_pairs(notes: DataFrame, members: DataFrame, policy: EvidencePolicy = EvidencePolicy()) -> DataFrame:
    """Pairs of the members (a read and filtered ``members`` table) with level and codes; ``notes`` are memberships."""
    met = salted_block_join(members, notes, "note_id")
    judged = _judged(met, coverage(~F.col("everywhere"), F.col("upper"), policy))
    return judged.select(*KEY, "note_id", "overlap_days", *JUDGED)


def relevant_pairs_reached(relevance: DataFrame, notes: DataFrame) -> DataFrame:
    """The (candidate, note) rows of ``relevance`` that the recall holds, tested one by one."""
    facts = notes.where("compile_error IS NULL").select("note_id", "scope_type", "applies_to_routes", "effective_from", "effective_to")
    scope = (F.col("scope_type") == "global") | F.array_contains("applies_to_routes", F.col("route"))
    meets = (F.col("effective_from") <= F.date_add("week_of", 6)) & F.coalesce(F.col("effective_to") >= F.col("week_of"), F.lit(True))
    return relevance.join(facts, "note_id").where(scope & meets).select(*KEY, "note_id")

