"""Factorised evidence against the table of pairs it stands for."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lanecost.operators import evidence as ev, factorised as fa
from lanecost.schemas import COMPILED_NOTE_SCHEMA, KEY

MONDAY = dt.date(2024, 1, 1)


def notes(spark, seed, n):
    rng, rows = random.Random(seed), []
    for k in range(n):
        first = MONDAY + dt.timedelta(days=rng.randrange(-20, 90))
        last = None if rng.random() < 0.3 else first + dt.timedelta(days=rng.randrange(0, 60))
        everywhere = rng.random() < 0.5
        increase = rng.random() < 0.6
        rows.append((f"N{k:03d}", first, "x", "text", "global" if everywhere else "route", [] if everywhere else rng.sample(["A-B", "A-C", "B-C"], 2),
                     rng.choice(["in_dataset", "in_dataset", "outside_dataset"]), first, last, "explicit", "toll",
                     "increase" if increase else "decrease", "explicit_increase" if increase else "not_stated", increase, rng.random() < 0.1,
                     rng.choice([None, "5 percent", "up to 30%"]), [], None if rng.random() < 0.9 else "unsupported_scope"))
    return spark.createDataFrame(rows, COMPILED_NOTE_SCHEMA)


def candidates(spark, seed, n):
    rng = random.Random(seed)
    keys = {(rng.choice(["A-B", "A-C", "C-D"]), rng.choice(["Short", "Long"]), MONDAY + dt.timedelta(weeks=rng.randrange(-2, 16))) for _ in range(n)}
    rows = [(*k, rng.choice([12.0, 25.0, 60.0]), rng.random() < 0.4) for k in sorted(keys)]
    return spark.createDataFrame(rows, "route string, route_type string, week_of date, vs_own_history_pct double, peer_threshold_breached boolean")


@pytest.fixture(scope="module", params=[1, 2])
def case(spark, request):
    c, n = candidates(spark, request.param, 40), notes(spark, request.param, 60)
    pairs = ev.structured_recall(c, n)
    return c, n, pairs, ev.evidence_gate(c, pairs.drop("overlap_days"), n)


def rows(df, *columns):
    return Counter(tuple(map(str, r)) for r in df.select(*columns).collect())


def test_counts_of_both_sides_and_of_classes(case):
    c, n, pairs, _ = case
    want = pairs.groupBy(*KEY).agg(F.count("note_id").alias("notes"), F.min("note_id").alias("first_note_id"), F.sum("overlap_days").alias("overlap_days"))
    assert rows(fa.links_of_candidates(c, n), *want.columns) == rows(want, *want.columns)
    want = pairs.groupBy("note_id").agg(F.count("route").alias("candidates"), F.sum("overlap_days").alias("overlap_days"))
    assert rows(fa.links_of_notes(c, n), *want.columns) == rows(want, *want.columns)
    assert fa.class_rows(c, n).agg(F.sum("links")).first()[0] == pairs.count() > 100


def test_gate_per_candidate_and_in_total(case):
    c, n, _, gated = case
    kinds = (*KEY, "evidence_level", "rejection_codes")
    want = gated.groupBy(*kinds).agg(F.count("note_id").alias("notes"), F.min("note_id").alias("first_note_id"))
    assert rows(fa.assessed_of_candidates(c, n), *want.columns) == rows(want, *want.columns)
    want = gated.groupBy(*fa.JUDGED).agg(F.count("note_id").alias("pairs"))
    assert rows(fa.assessed_counts(c, n), *want.columns) == rows(want, *want.columns)
    assert {r.evidence_level for r in want.collect()} == {"full", "partial", "rejected"}
    assert rows(fa.rejection_histogram(fa.assessed_counts(c, n)), "rejection_code", "pairs") == rows(ev.rejection_histogram(gated), "rejection_code", "pairs")


def test_sweep_equals_the_join(case):
    c, n, pairs, _ = case
    want = pairs.join(n.select("note_id", "event_type", "scope_type"), "note_id").groupBy("scope_type").agg(F.count("note_id").alias("pairs"))
    assert rows(fa.sweep(c, n, "scope_type"), "scope_type", "pairs") == rows(want, "scope_type", "pairs")
    assert fa.sweep(c.limit(0), n, "scope_type").count() == 0 == fa.sweep(c, n.limit(0), "scope_type").count()


def test_pairs_of_a_named_candidate(case, spark):
    c, n, _, gated = case
    for key in c.orderBy(*KEY).limit(3).select(*KEY).collect():
        named = c.where((F.col("route") == key.route) & (F.col("route_type") == key.route_type) & (F.col("week_of") == F.lit(key.week_of)))
        own = gated.join(named.select(*KEY), list(KEY), "left_semi")
        columns = ("note_id", "evidence_level", "overlap_days", "rejection_codes")
        assert rows(fa.audit_of(named, n), *columns) == rows(own, *columns)
        members, held = ev.candidate_blocks(named, *fa.FACTS), ev.note_blocks(fa.seen(n), "note_id", *fa.SEEN)
        assert rows(fa.audit_pairs(held, members), *columns) == rows(own, *columns)


def test_packets_are_counted_as_they_would_be_listed(case):
    c, n, _, _ = case
    decisions = ev.decide_verdict(c, n)
    want = ev.packet_notes(c, n, decisions).groupBy(*KEY, "role", "magnitude_text").agg(
        F.count("note_id").alias("notes"), F.min("note_id").alias("first_note_id"))
    assert rows(fa.supporting_of_candidates(c, n, decisions, "magnitude_text"), *want.columns) == rows(want, *want.columns)


def test_relevant_pairs_are_tested_one_by_one(case):
    c, n, pairs, _ = case
    every = c.select(*KEY).crossJoin(n.select("note_id"))
    assert rows(fa.relevant_pairs_reached(every, n), *KEY, "note_id") == rows(pairs, *KEY, "note_id")
