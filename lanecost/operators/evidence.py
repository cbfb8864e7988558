"""Which notes meet which candidate, the gate over a pair, and the verdict.

The interval join is an equi-join. A week is a number; a note's interval is cut
into aligned blocks of 1, 8, 64, ... weeks plus its partly covered first and last
week, and a candidate week lies in exactly one block per block size. A note thus
meets a week exactly once, and even an open-ended note needs only a few rows.

Verdicts do not need the pairs at all: notes that the gate cannot tell apart are
first merged into classes (same scope, block, overlap, magnitude), so a week with
any number of similar notes contributes a handful of class rows per candidate.
The pair table exists for the audit outputs, whose result it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import flag, iso, joined
from ..schemas import KEY, EvidencePolicy
from ..session import cut_lineage
from .notes import gate_claim_consistent, magnitude_upper_bound

BLOCK = 8
LEVELS = 7
HORIZON = BLOCK ** LEVELS  # weeks; reaches past the year 9999
EVERYWHERE = "*"
HOT_ROWS = 200_000
FIRST_MONDAY = "DATE '1970-01-05'"
MISSING_RANK = 2 ** 31


def week_number(date: Column) -> Column:
    """Whole weeks since a fixed Monday, shifted so that it is never negative."""
    return F.floor(F.datediff(date, F.expr(FIRST_MONDAY)) / 7) + 110_000


def overlap_days(week_of: Column, first: Column, last: Column) -> Column:
    """Inclusive days shared by the week and the interval; an open end is the week's end."""
    week_end = F.date_add(week_of, 6)
    start = F.greatest(week_of, first)
    end = F.least(week_end, F.coalesce(last, week_end))
    return F.greatest(F.lit(0), F.datediff(end, start) + 1)


def _span(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def note_blocks(notes: DataFrame, *carry: str) -> DataFrame:
    """(scope_route, level, block, overlap_days) rows that cover each note's weeks once."""
    first, last = F.col("effective_from"), F.col("effective_to")
    w1, w2 = week_number(first), week_number(last)
    late, early = F.weekday(first), F.weekday(last)
    lo = w1 + (late > 0).cast("bigint")
    hi = F.coalesce(w2 + (early == 6).cast("bigint"), F.lit(HORIZON).cast("bigint"))
    up = lambda v, k: F.ceil(v / F.lit(BLOCK ** k)).cast("bigint")
    down = lambda v, k: F.floor(v / F.lit(BLOCK ** k)).cast("bigint")

    def tagged(blocks: Column, level: int, days: Column) -> Column:
        return F.transform(blocks, lambda b: F.struct(
            F.lit(level).alias("level"), b.alias("block"), days.cast("int").alias("overlap_days")))

    parts = []
    for k in range(LEVELS):
        a, b = up(F.col("_lo"), k), down(F.col("_hi"), k)
        if k + 1 < LEVELS:
            a2, b2 = up(F.col("_lo"), k + 1) * BLOCK, down(F.col("_hi"), k + 1) * BLOCK
            blocks = F.when(a2 < b2, F.concat(_span(a, a2 - 1), _span(b2, b - 1))).otherwise(_span(a, b - 1))
        else:
            blocks = _span(a, b - 1)
        parts.append(tagged(blocks, k, F.lit(7)))
    head_days = F.least(7 - late, F.coalesce(F.datediff(last, first) + 1, F.lit(7)))
    head = F.when(late > 0, F.array(w1)).otherwise(F.array().cast("array<bigint>"))
    tail = F.when((early < 6) & ((w2 > w1) | (late == 0)), F.array(w2)).otherwise(
        F.array().cast("array<bigint>"))
    parts += [tagged(head, 0, head_days), tagged(tail, 0, early + 1)]
    scope = F.when(F.col("scope_type") == "global", F.array(F.lit(EVERYWHERE))).otherwise(
        F.col("applies_to_routes"))
    return (
        notes.where("compile_error IS NULL AND effective_from IS NOT NULL")
        .withColumns({"_lo": lo, "_hi": hi, "scope_route": F.explode_outer(scope)})
        .select(*carry, "scope_route", F.inline_outer(F.concat(*parts)))
        .where("block IS NOT NULL AND scope_route IS NOT NULL"))


def candidate_blocks(candidates: DataFrame, *carry: str) -> DataFrame:
    """The one block per level a candidate week lies in, for its route and everywhere."""
    week = week_number(F.col("week_of"))
    levels = F.array(*[
        F.struct(F.lit(k).alias("level"), F.floor(week / F.lit(BLOCK ** k)).cast("bigint").alias("block"))
        for k in range(LEVELS)])
    return (
        candidates.withColumn("scope_route", F.explode(F.array("route", F.lit(EVERYWHERE))))
        .select(*KEY, *carry, "scope_route", F.inline(levels)))


BLOCK_KEY = ["scope_route", "level", "block"]


def salted_block_join(left: DataFrame, right: DataFrame, right_id: str,
                      hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join on the block key that splits hot keys of either side exactly.

    A key with more than ``hot_rows`` rows on a side is dealt over salts of that side, and
    the other side's rows are repeated per salt, so a task meets about ``hot_rows`` rows of
    each. There are at most rows / hot_rows such keys; their table is joined by measured size.

    An open-ended note lies in blocks of all later times. Rows of the right side in blocks that
    the left side does not reach go first, and what is left is written, so blocks are made once.
    """
    right = cut_lineage(right.join(left.select(*BLOCK_KEY).distinct(), BLOCK_KEY, "left_semi"))

    def salts(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*BLOCK_KEY).count().where(F.col("count") > hot_rows).select(
            *BLOCK_KEY, F.ceil(F.col("count") / hot_rows).cast("int").alias(name))

    hot = cut_lineage(salts(left, "_l").join(salts(right, "_r"), BLOCK_KEY, "full_outer"))
    lefts, rights = F.coalesce("_l", F.lit(1)), F.coalesce("_r", F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), n).cast("int")
    spread = right.join(hot, BLOCK_KEY, "left").withColumn("_b", dealt(rights, right_id)).withColumn("_a", every(lefts))
    spread_left = left.join(hot, BLOCK_KEY, "left").withColumn("_a", dealt(lefts, *KEY)).withColumn("_b", every(rights))
    drop = ("_l", "_r")
    return spread_left.drop(*drop).join(spread.drop(*drop), [*BLOCK_KEY, "_a", "_b"]).drop("level", "block", "_a", "_b")


def structured_recall(candidates: DataFrame, notes: DataFrame) -> DataFrame:
    """Every (candidate, note) whose scope applies and whose interval meets the week."""
    pairs = salted_block_join(
        candidate_blocks(candidates), note_blocks(notes, "note_id"), "note_id")
    return pairs.select(*KEY, "note_id", "overlap_days")


def recall_union_hits(hits: DataFrame, recalled: DataFrame) -> DataFrame:
    """Full outer join of retrieved hits and recalled notes; recall is flagged."""
    marked = recalled.select(*KEY, "note_id", F.lit(True).alias("_recalled"))
    return (
        hits.join(marked, [*KEY, "note_id"], "full_outer")
        .withColumn("included_by_structured_recall", flag(F.col("_recalled"))).drop("_recalled"))


def structured_additions(union_hits: DataFrame) -> DataFrame:
    """Notes that only the route/time join found."""
    return union_hits.agg(
        F.count(F.lit(1)).alias("assessed_pairs"),
        F.count_if(F.col("included_by_structured_recall") & F.col("fused_rank").isNull())
         .alias("structured_additions"))


# --- gate ---------------------------------------------------------------------------

NOTE_GATE_COLUMNS = (
    "note_id", "scope_type", "applies_to_routes", "scope_status", "effective_from",
    "effective_to", "impact_direction", "cost_impact_status", "affects_transport_cost",
    "negates_cost_increase", "magnitude_text",
)


def note_checks() -> dict[str, Column]:
    """The part of the gate that depends on the note alone."""
    return {
        "consistent": gate_claim_consistent(),
        "scope_ok": F.col("scope_status").isin("in_dataset", "partially_in_dataset"),
        "cost_ok": flag((F.col("cost_impact_status") == "explicit_increase")
                        & F.col("affects_transport_cost")),
        "direction_ok": flag(F.col("impact_direction") == "increase"),
        "negation_ok": ~F.col("negates_cost_increase"),
    }


def coverage(exact_route: Column, upper: Column, policy: EvidencePolicy) -> Column:
    """Coverage of a pair that passed every hard check: full, or why only partial."""
    too_small = upper.isNotNull() & (
        F.col("vs_own_history_pct") > upper + policy.global_magnitude_tolerance_percent)
    return (
        F.when(exact_route, "full")
        .when(F.col("peer_threshold_breached"), "global_scope_cannot_explain_peer_premium")
        .when(flag(too_small), "global_magnitude_insufficient")
        .otherwise("full"))


def evidence_gate(candidates: DataFrame, hits: DataFrame, notes: DataFrame,
                  policy: EvidencePolicy = EvidencePolicy()) -> DataFrame:
    """Six checks, coverage, level and sorted rejection codes for every given pair."""
    ranks = [c for c in ("sparse_rank", "sparse_score", "dense_rank", "dense_score", "fused_rank",
                         "fused_score", "included_by_structured_recall") if c in hits.columns]
    facts = candidates.select(*KEY, "vs_own_history_pct", "peer_threshold_breached")
    claims = notes.select(*NOTE_GATE_COLUMNS).withColumns(
        {f"_{k}": v for k, v in note_checks().items()}).withColumn(
        "_upper", magnitude_upper_bound(F.col("magnitude_text")))
    pairs = (
        # claims are as many as notes and far larger in memory than their files, so they are never broadcast
        hits.select(*KEY, "note_id", *ranks).join(claims.hint("merge"), "note_id").join(facts, list(KEY))
        .withColumns({
            "exact_route_scope": (F.col("scope_type") == "route")
                & F.array_contains("applies_to_routes", F.col("route")),
            "overlap_days": overlap_days(F.col("week_of"), F.col("effective_from"), F.col("effective_to")),
        }))
    route_ok = (F.col("scope_type") == "global") | F.col("exact_route_scope")
    date_ok = F.col("overlap_days") > 0
    hard = (F.col("_consistent") & F.col("_scope_ok") & route_ok & date_ok
            & F.col("_cost_ok") & F.col("_direction_ok") & F.col("_negation_ok"))
    pairs = pairs.withColumn(
        "_coverage", F.when(hard, coverage(F.col("exact_route_scope"), F.col("_upper"), policy)))
    reached = F.col("_coverage")
    codes = F.array(
        F.when(~F.col("_consistent"), "compiled_claim_inconsistent"),
        F.when(~F.col("_scope_ok"), F.when(F.col("scope_status") == "outside_dataset",
               "scope_outside_dataset").otherwise("scope_unresolved")),
        F.when(~route_ok, "route_mismatch"),
        F.when(~date_ok, "date_no_overlap"),
        F.when(~F.col("_cost_ok"), "cost_impact_not_positive"),
        F.when(~F.col("_direction_ok"), "impact_direction_not_increase"),
        F.when(~F.col("_negation_ok"), "cost_increase_negated"),
        F.when(reached != "full", reached))
    passed = lambda c: F.when(c, "pass").otherwise("fail")
    level = F.when(reached == "full", "full").when(reached.isNotNull(), "partial")
    return pairs.select(
        *KEY, "note_id",
        passed(route_ok).alias("route_check"), passed(date_ok).alias("date_check"),
        passed(F.col("_scope_ok")).alias("scope_check"),
        passed(F.col("_direction_ok")).alias("direction_check"),
        passed(F.col("_cost_ok")).alias("cost_impact_check"),
        passed(F.col("_negation_ok")).alias("negation_check"),
        F.coalesce(level, F.lit("none")).alias("explanatory_scope"), "overlap_days",
        F.coalesce(level, F.lit("rejected")).alias("evidence_level"),
        F.array_sort(F.array_compact(codes)).alias("rejection_codes"),
        "exact_route_scope", F.col("_upper").isNotNull().alias("has_numeric_magnitude"), *ranks)


# Which codes explain which gate, first match wins.
GATES = (
    ("route", "route_check", ("route_mismatch",)),
    ("date", "date_check", ("date_no_overlap",)),
    ("direction", "direction_check", ("impact_direction_not_increase",)),
    ("cost_impact", "cost_impact_check", ("cost_impact_not_positive", "cost_increase_negated")),
    ("scope", "scope_check", ("scope_outside_dataset", "scope_unresolved",
                              "global_scope_cannot_explain_peer_premium",
                              "global_magnitude_insufficient")),
)
GATE_TEXT = {
    "pass": "The deterministic Evidence Gate passed this check.",
    "fail": "The deterministic Evidence Gate rejected this check.",
    "not_applicable": "This check was not applicable.",
}


def gate_results() -> Column:
    """Five {gate, status, reason_code, reason} entries for one assessed pair."""
    def entry(gate, check, codes):
        text = reduce(lambda acc, kv: F.when(F.col(check) == kv[0], kv[1]).otherwise(acc),
                      GATE_TEXT.items(), F.lit(None).cast("string"))
        hit = F.array_intersect(F.array(*[F.lit(c) for c in codes]), F.col("rejection_codes"))
        return F.struct(F.lit(gate).alias("gate"), F.col(check).alias("status"),
                        F.try_element_at(hit, F.lit(1)).alias("reason_code"), text.alias("reason"))
    return F.array(*[entry(*g) for g in GATES])


def gate_results_view(assessed: DataFrame) -> DataFrame:
    return assessed.select(*KEY, "note_id", F.inline(gate_results()))


def rejection_histogram(assessed: DataFrame) -> DataFrame:
    return assessed.select(F.explode_outer("rejection_codes").alias("rejection_code")).where(
        "rejection_code IS NOT NULL").groupBy(
        "rejection_code").agg(F.count(F.lit(1)).alias("pairs"))


# --- verdict ------------------------------------------------------------------------

def accepted_claims(notes: DataFrame) -> DataFrame:
    """Notes that can support any candidate at all; the rest never reach the join."""
    ok = reduce(lambda a, b: a & b, note_checks().values())
    return notes.where("compile_error IS NULL").where(ok)


def evidence_classes(notes: DataFrame) -> DataFrame:
    """Interchangeable accepted notes merged per block: their number and least id."""
    upper = accepted_claims(notes).withColumn("upper", magnitude_upper_bound(F.col("magnitude_text")))
    return (
        note_blocks(upper, "note_id", "upper")
        .groupBy(*BLOCK_KEY, "overlap_days", "upper")
        .agg(F.min("note_id").alias("note_id"), F.count(F.lit(1)).alias("notes")))


def _selection_order(fused=None, dense=None, sparse=None) -> Column:
    """Least is best: exact route, longer overlap, numeric magnitude, ranks, id."""
    rank = lambda c: F.coalesce(c.cast("bigint"), F.lit(MISSING_RANK).cast("bigint")) \
        if c is not None else F.lit(MISSING_RANK).cast("bigint")
    return F.struct(
        (~F.col("exact_route_scope")).alias("a"), (-F.col("overlap_days")).alias("b"),
        (~F.col("has_numeric_magnitude")).alias("c"), rank(fused).alias("d"),
        rank(dense).alias("e"), rank(sparse).alias("f"), F.col("note_id").alias("g"))


def select_evidence(assessed: DataFrame) -> DataFrame:
    """Best full note per candidate of an assessed pair table."""
    order = _selection_order(F.col("fused_rank"), F.col("dense_rank"), F.col("sparse_rank"))
    return assessed.where("evidence_level = 'full'").groupBy(*KEY).agg(
        F.min(order)["g"].alias("selected_note_id"))


def decide_verdict(candidates: DataFrame, notes: DataFrame, hits: DataFrame | None = None,
                   policy: EvidencePolicy = EvidencePolicy()) -> DataFrame:
    """One decision per candidate, also for those no note reaches.

    ``hits`` are the at most 2k retrieved notes per candidate. They only break
    ties: a hit is also a member of its class, with its ranks it sorts no later
    than the class does without, so the least of both is the exact choice.
    """
    facts = ("vs_own_history_pct", "peer_threshold_breached")
    joined_classes = salted_block_join(candidate_blocks(candidates, *facts), evidence_classes(notes), "note_id")
    exact = F.col("scope_route") != EVERYWHERE
    by_class = joined_classes.select(
        *KEY, "note_id", "notes", "overlap_days", exact.alias("exact_route_scope"),
        F.col("upper").isNotNull().alias("has_numeric_magnitude"),
        (coverage(exact, F.col("upper"), policy) == "full").alias("full"),
    ).withColumn("pick", _selection_order())
    if hits is not None:
        ranked = evidence_gate(candidates, hits, notes, policy).where("evidence_level = 'full'")
        ranked = ranked.withColumns({"notes": F.lit(0).cast("bigint"), "full": F.lit(True)}).withColumn(
            "pick", _selection_order(F.col("fused_rank"), F.col("dense_rank"), F.col("sparse_rank")))
        by_class = by_class.unionByName(ranked.select(*by_class.columns))
    per = by_class.groupBy(*KEY).agg(
        F.min(F.when(F.col("full"), F.col("pick")))["g"].alias("selected_note_id"),
        F.sum(F.when(F.col("full"), F.col("notes")).otherwise(0)).alias("full_note_count"),
        F.min(F.when(~F.col("full"), F.col("note_id"))).alias("first_supporting_note_id"),
        F.sum(F.when(~F.col("full"), F.col("notes")).otherwise(0)).alias("supporting_note_count"))
    verdict = (
        F.when(F.col("selected_note_id").isNotNull(), "justified")
        .when(F.col("first_supporting_note_id").isNotNull(), "partially_explained")
        .otherwise("unexplained"))
    return candidates.select(*KEY).join(per, list(KEY), "left").select(
        *KEY, verdict.alias("verdict"), "selected_note_id", "first_supporting_note_id",
        F.coalesce("full_note_count", F.lit(0)).alias("full_note_count"),
        F.coalesce("supporting_note_count", F.lit(0)).alias("supporting_note_count"),
        verdict.alias("reason_template_key"))


def verdict_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("verdict").agg(F.count(F.lit(1)).alias("candidates"))


def packet_notes(candidates: DataFrame, notes: DataFrame, decisions: DataFrame,
                 policy: EvidencePolicy = EvidencePolicy()) -> DataFrame:
    """The notes a decision may cite, one row each: the selected one and every
    supporting one. A selected id without a compiled note fails the job."""
    facts = ("vs_own_history_pct", "peer_threshold_breached")
    upper = accepted_claims(notes).withColumn("upper", magnitude_upper_bound(F.col("magnitude_text")))
    # Only global notes can be partial, so only they are joined for the supporting role.
    support = salted_block_join(
        candidate_blocks(candidates, *facts).where(F.col("scope_route") == EVERYWHERE),
        note_blocks(upper.where("scope_type = 'global'"), "note_id", "upper"), "note_id",
    ).where(coverage(F.lit(False), F.col("upper"), policy) != "full")
    roles = support.select(*KEY, "note_id", F.lit("supporting").alias("role")).unionByName(
        decisions.where("selected_note_id IS NOT NULL").select(
            *KEY, F.col("selected_note_id").alias("note_id"), F.lit("selected").alias("role")))
    known = notes.withColumn("_found", F.lit(True))
    missing = F.raise_error(F.concat(F.lit("decision names an unknown note "), F.col("note_id")))
    return (
        roles.join(known, "note_id", "left")
        .withColumn("role", F.when(F.col("_found").isNull(), missing.cast("string")).otherwise(F.col("role")))
        .drop("_found"))


def packet_authority_check(decisions: DataFrame, packets: DataFrame) -> DataFrame:
    """Verdict agrees with the cited notes; counters in one row."""
    per = packets.groupBy(*KEY).agg(
        F.count_if(F.col("role") == "selected").alias("selected"),
        F.max(F.when(F.col("role") == "selected", F.col("note_id"))).alias("selected_id"),
        F.count_if(F.col("role") == "supporting").alias("supporting"),
        F.min(F.when(F.col("role") == "supporting", F.col("note_id"))).alias("first_id"))
    both = decisions.join(per, list(KEY), "full_outer")
    n_sel, n_sup = F.coalesce("selected", F.lit(0)), F.coalesce("supporting", F.lit(0))
    verdict = F.col("verdict")
    bad = lambda c: F.count_if(~flag(c))
    return both.agg(
        bad(verdict.isNotNull()).alias("packet_without_decision"),
        bad((verdict != "justified") | ((n_sel == 1) & F.col("selected_id").eqNullSafe(F.col("selected_note_id")))).alias("justified_shape"),
        bad((verdict != "partially_explained") | ((n_sel == 0) & F.col("selected_note_id").isNull() & (n_sup > 0))).alias("partial_shape"),
        bad((verdict != "unexplained") | ((n_sel == 0) & (n_sup == 0) & F.col("selected_note_id").isNull())).alias("unexplained_shape"),
        bad((n_sup == F.col("supporting_note_count")) & F.col("first_id").eqNullSafe(F.col("first_supporting_note_id"))).alias("supporting_matches"))


# --- retrieval texts ----------------------------------------------------------------

def candidate_query_text(candidates: DataFrame) -> DataFrame:
    """Six-line search text per candidate; missing peers read 'unavailable'."""
    from .candidates import candidate_trigger

    number = lambda c: F.col(c).cast("string")
    week = F.concat(iso(F.col("week_of")), F.lit(" to "), iso(F.date_add("week_of", 6)))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Investigate an increase in freight transport cost for route "), F.col("route"),
                 F.lit(" ("), F.col("route_type"), F.lit(") during "), week, F.lit(".")),
        F.concat(F.lit("Cost per tonne-km: "), number("cost_per_tonne_km"), F.lit(".")),
        F.concat(F.lit("Change versus own history: "), number("vs_own_history_pct"), F.lit(" percent.")),
        F.concat(F.lit("Change versus similar routes: "),
                 F.coalesce(number("vs_similar_routes_pct"), F.lit("unavailable")), F.lit(" percent.")),
        F.concat(F.lit("Trigger: "), candidate_trigger("own"), F.lit(".")),
        F.lit("Find operational events that explicitly increased freight transport costs or rates."))
    return candidates.select(*KEY, lines.alias("query_text"))


def note_document_text(notes: DataFrame) -> DataFrame:
    """Seven-line search text per compiled note."""
    scope = F.when(F.col("scope_type") == "global", "global").otherwise(
        F.coalesce(F.nullif(joined(F.col("applies_to_routes"), ", "), F.lit("")), F.lit("unknown")))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Note "), F.col("note_id"), F.lit(".")),
        F.concat(F.lit("Scope: "), scope, F.lit(".")),
        F.concat(F.lit("Effective: "), iso(F.col("effective_from")), F.lit(" to "),
                 F.coalesce(iso(F.col("effective_to")), F.lit("open ended")), F.lit(".")),
        F.concat(F.lit("Event: "), F.col("event_type"), F.lit(".")),
        F.concat(F.lit("Transport cost impact: "), F.col("cost_impact_status"), F.lit(".")),
        F.concat(F.lit("Direction: "), F.col("impact_direction"), F.lit(".")),
        F.concat(F.lit("Text: "), F.col("original_text")))
    return notes.where("compile_error IS NULL").select("note_id", lines.alias("document_text"))
