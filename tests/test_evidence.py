"""Interval join, gate, verdicts and tie-breaks against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lanecost.operators import evidence as ev
from lanecost.schemas import COMPILED_NOTE_SCHEMA, KEY

MONDAY = dt.date(2024, 1, 1)


def note(i, first, last, route=None, status="explicit_increase", magnitude=None, scope="in_dataset"):
    direction = {"explicit_increase": "increase", "not_stated": "unknown"}.get(status, "no_change")
    return (f"N{i:04d}", first, route or "All Routes", "t", "route" if route else "global", [route] if route else [],
            scope, first, last, "explicit_range", "other", direction, status,
            {"explicit_increase": True, "not_stated": None}.get(status, False),
            status not in ("explicit_increase", "not_stated"), magnitude, [], None)


def notes_of(spark, rows):
    return spark.createDataFrame(rows, COMPILED_NOTE_SCHEMA)


def candidates_of(spark, rows):
    return spark.createDataFrame(rows, "route string, route_type string, week_of date, vs_own_history_pct double,"
                                       " peer_threshold_breached boolean")


def world(spark, seed, n=160):
    rng = random.Random(seed)
    notes = []
    for i in range(n):
        first = MONDAY + dt.timedelta(days=rng.randint(-40, 900))
        last = None if rng.random() < .2 else first + dt.timedelta(days=rng.choice([0, 2, 6, 7, 13, 60, 400]))
        notes.append(note(i, first, last, rng.choice([None, "A-B", "B-A", "C-D"]),
                          rng.choice(["explicit_increase"] * 3 + ["not_stated", "explicit_no_rate_change"]),
                          rng.choice([None, "5%", "10-30 percent", "INR 3 per km"])))
    cands = [(r, "Short", MONDAY + dt.timedelta(days=7 * k), rng.choice([10.0, 21.0, 33.0]), rng.random() < .5)
             for r in ("A-B", "B-A", "C-D", "E-F") for k in range(0, 130, 3)]
    return candidates_of(spark, cands), notes_of(spark, notes)


def brute_pairs(candidates, notes):
    pairs = {}
    for c in candidates.collect():
        for x in notes.collect():
            end = c.week_of + dt.timedelta(days=6)
            days = (min(end, x.effective_to or end) - max(c.week_of, x.effective_from)).days + 1
            if days > 0 and (x.scope_type == "global" or c.route in x.applies_to_routes):
                pairs[(c.route, c.route_type, c.week_of, x.note_id)] = days
    return pairs


@pytest.mark.parametrize("seed", [1, 2])
def test_block_join_equals_nested_loop(spark, seed):
    candidates, notes = world(spark, seed)
    got = ev.structured_recall(candidates, notes).collect()
    assert len(got) == len({r[:4] for r in got})
    assert {tuple(r[:4]): r.overlap_days for r in got} == brute_pairs(candidates, notes)


def test_salting_hot_keys_changes_nothing(spark):
    candidates, notes = world(spark, 3)
    plain = ev.structured_recall(candidates, notes)
    left, right = ev.candidate_blocks(candidates), ev.note_blocks(notes, "note_id")
    salted = ev.salted_block_join(left, right, "note_id", hot_rows=2).select(*KEY, "note_id", "overlap_days")
    assert sorted(plain.collect()) == sorted(salted.collect())


def test_overlap_days_expression_agrees_with_blocks(spark):
    candidates, notes = world(spark, 4)
    facts = notes.select("note_id", "effective_from", "effective_to")
    joined = ev.structured_recall(candidates, notes).join(facts, "note_id")
    days = ev.overlap_days(F.col("week_of"), F.col("effective_from"), F.col("effective_to"))
    assert joined.where(days != F.col("overlap_days")).count() == 0


def brute_decisions(candidates, notes, ranks):
    """Verdicts from every pair, in plain Python."""
    info = {x.note_id: x for x in notes.collect()}
    pairs = brute_pairs(candidates, notes)
    out = {}
    for c in candidates.collect():
        full, partial = [], []
        for (r, t, w, nid), days in pairs.items():
            if (r, t, w) != (c.route, c.route_type, c.week_of) or info[nid].cost_impact_status != "explicit_increase":
                continue
            x = info[nid]
            upper = {None: None, "5%": 5.0, "10-30 percent": 30.0, "INR 3 per km": None}[x.magnitude_text]
            exact = x.scope_type == "route"
            small = upper is not None and c.vs_own_history_pct > upper + 2
            if exact or not (c.peer_threshold_breached or small):
                rank = ranks.get((c.route, c.week_of, nid), (2 ** 31,) * 3)
                full.append((not exact, -days, upper is None, *rank, nid))
            else:
                partial.append(nid)
        verdict = "justified" if full else "partially_explained" if partial else "unexplained"
        out[(c.route, c.week_of)] = (verdict, min(full)[-1] if full else None, min(partial, default=None),
                                     len(full), len(partial))
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_class_verdicts_equal_pair_verdicts_with_rank_tie_breaks(spark, seed):
    candidates, notes = world(spark, seed)
    rng = random.Random(seed)
    ids = [r.note_id for r in notes.collect()]
    hits, ranks = [], {}
    for c in candidates.collect():
        for place, nid in enumerate(rng.sample(ids, 5), start=1):
            hits.append((c.route, c.route_type, c.week_of, nid, place, None, place + 1))
            ranks[(c.route, c.week_of, nid)] = (place, 2 ** 31, place + 1)
    hit_df = spark.createDataFrame(hits, "route string, route_type string, week_of date, note_id string,"
                                         " fused_rank int, dense_rank int, sparse_rank int")
    got = {(r.route, r.week_of): (r.verdict, r.selected_note_id, r.first_supporting_note_id, r.full_note_count,
                                  r.supporting_note_count) for r in ev.decide_verdict(candidates, notes, hit_df).collect()}
    assert got == brute_decisions(candidates, notes, ranks)
    plain = {(r.route, r.week_of): r.selected_note_id for r in ev.decide_verdict(candidates, notes).collect()}
    assert plain == {k: v[1] for k, v in brute_decisions(candidates, notes, {}).items()}


WEEK = MONDAY + dt.timedelta(days=70)
IN, END = WEEK, WEEK + dt.timedelta(days=6)
CASES = {
    "exact route and week": (note(1, IN, END, "A-B"), "full", []),
    "wrong route": (note(1, IN, END, "C-D"), "rejected", ["route_mismatch"]),
    "reverse direction": (note(1, IN, END, "B-A"), "rejected", ["route_mismatch"]),
    "too late": (note(1, END + dt.timedelta(days=1), None, "A-B"), "rejected", ["date_no_overlap"]),
    "too early": (note(1, MONDAY, IN - dt.timedelta(days=1), "A-B"), "rejected", ["date_no_overlap"]),
    "one day": (note(1, MONDAY, IN, "A-B"), "full", []),
    "outside": (note(1, IN, END, "A-B", scope="outside_dataset"), "rejected", ["scope_outside_dataset"]),
    "unresolved": (note(1, IN, END, "A-B", scope="unresolved"), "rejected", ["scope_unresolved"]),
    "no rate change": (note(1, IN, END, "A-B", "explicit_no_rate_change"), "rejected",
                       ["cost_impact_not_positive", "cost_increase_negated", "impact_direction_not_increase"]),
    "not stated": (note(1, IN, END, "A-B", "not_stated"), "rejected",
                   ["cost_impact_not_positive", "impact_direction_not_increase"]),
    "route magnitude is ignored": (note(1, IN, END, "A-B", magnitude="1%"), "full", []),
    "global with peers": (note(1, IN, END), "partial", ["global_scope_cannot_explain_peer_premium"]),
}


@pytest.mark.parametrize("name", CASES)
def test_gate_cases(spark, name):
    row, level, codes = CASES[name]
    candidates = candidates_of(spark, [("A-B", "Short", WEEK, 30.0, True)])
    hits = candidates.select(*KEY, F.lit("N0001").alias("note_id"))
    got = ev.evidence_gate(candidates, hits, notes_of(spark, [row])).first()
    assert (got.evidence_level, got.rejection_codes) == (level, codes)


@pytest.mark.parametrize("own,magnitude,level", [(7.0, "5%", "full"), (7.01, "5%", "partial"), (99.0, None, "full"),
                                                (99.0, "INR 3 per km", "full"), (31.9, "10-30 percent", "full")])
def test_global_without_peer_premium_depends_on_magnitude(spark, own, magnitude, level):
    candidates = candidates_of(spark, [("A-B", "Short", WEEK, own, False)])
    hits = candidates.select(*KEY, F.lit("N0001").alias("note_id"))
    got = ev.evidence_gate(candidates, hits, notes_of(spark, [note(1, IN, END, magnitude=magnitude)])).first()
    assert got.evidence_level == level


def test_packets_hold_selected_and_every_supporting_note(spark):
    candidates, notes = world(spark, 7)
    decisions = ev.decide_verdict(candidates, notes)
    packets = ev.packet_notes(candidates, notes, decisions)
    row = ev.packet_authority_check(decisions, packets).first()
    assert all(v == 0 for v in row), row
    with pytest.raises(Exception, match="unknown note"):
        ev.packet_notes(candidates, notes, decisions.withColumn(
            "selected_note_id", F.lit("N9999"))).agg(F.max("role")).collect()
