"""Grounding codes, cost, cache, decomposition identity and the whole run."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lanecost.operators import explain as ex, measures as ms, reads as rd, report as rp, rootcause as rc
from lanecost.plans import workload as w
from lanecost.plans.pipeline import Analysis
from lanecost.schemas import KEY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return Analysis(spark, w.shipments(spark, SF), w.context_notes(spark, SF))


def test_effects_add_up_to_the_gap_and_nothing_looks_ahead(run):
    reconcile = rc.decomposition_reconcile(run.contributions, run.root_base)
    assert reconcile.count() == 2 * run.unexplained.where("history_weeks_used > 0").count()
    checks = {r.check_id: r.failures for r in rc.root_cause_checks(run.root_base, reconcile, run.decisions).collect()}
    assert set(checks.values()) == {0}, checks
    assert rc.unmatched_decisions(run.metrics, run.decisions).count() == 0


def test_entry_exit_mix_and_rate_by_hand(spark):
    week, past = dt.date(2024, 1, 15), [dt.date(2024, 1, 1), dt.date(2024, 1, 8)]
    refs = spark.createDataFrame([("A", "S", week, p) for p in past], "route string, route_type string, week_of date, ref_week date")
    share = lambda d, c, n, s, r: ("A", "S", d, "material", c, n, s, r)
    shares = spark.createDataFrame(
        [share(week, "new", 1, .25, 8.0), share(week, "kept", 3, .75, 4.0), share(past[0], "kept", 2, .5, 2.0),
         share(past[0], "gone", 2, .5, 6.0), share(past[1], "kept", 2, 1.0, 3.0)],
        "route string, route_type string, week_of date, lens string, category string, shipments bigint, share double, rate double")
    got = {r.category: r for r in rc.mix_rate_decomposition(refs, shares).collect()}
    assert got["new"].entry_effect == pytest.approx(2.0) and got["gone"].exit_effect == pytest.approx(-1.5)
    assert got["kept"].mix_effect == pytest.approx((.5 * .25 * 6 + .5 * -.25 * 7) / 2)
    assert got["kept"].rate_effect == pytest.approx((.5 * 2 * 1.25 + .5 * 1 * 1.75) / 2)
    assert got["new"].support_level == "transition_only" and got["kept"].support_level == "limited"
    assert got["gone"].reference_mean_tonne_km_share == pytest.approx(.25)
    assert got["gone"].reference_mean_cost_per_tonne_km == pytest.approx(6.0)
    gap = (.25 * 8 + .75 * 4) - ((.5 * 2 + .5 * 6) + 3) / 2
    assert sum(r.net_contribution for r in got.values()) == pytest.approx(gap)


def test_template_texts_are_grounded_except_where_the_wording_forbids(run):
    texts = ex.template_reason(run.decisions).select(
        F.concat_ws("|", *KEY).alias("text_id"), F.col("route").alias("request_route"),
        F.col("route_type").alias("request_route_type"), F.col("week_of").alias("request_week"),
        "route", "week_of", "verdict", "cited_note_ids", "reason")
    out = ex.grounding_validation(texts, run.requests, run.packets)
    assert out.where("NOT accepted").count() == 0 and out.count() == run.candidates.count()


def test_each_broken_text_gets_its_code(run):
    out = ex.grounding_validation(w.explanation_texts(ex.template_reason(run.decisions)), run.requests, run.packets)
    seen = {c for r in out.collect() for c in r.failure_codes}
    assert seen >= {"identity_mismatch", "verdict_mismatch", "unauthorized_note_id", "invalid_citation_set",
                    "unsupported_numeric_claim", "reason_length_violation", "reason_format_violation",
                    "internal_language_leakage"}


@pytest.mark.parametrize("text,numbers", [
    ("N12 rose 5 percent on 2024-01-01", ["5%"]), ("+3.50% then 3.50 %", ["3.50%"]), ("INR 12 per km", ["inr12"]),
    ("-4.0% vs x7", ["-4.0%"]), ("12 km", ["12km"]), ("roughly 5-7%", ["5", "-7%"]), ("none", []),
])
def test_numeric_claims(spark, text, numbers):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(ex.numeric_claims(F.col("t"))).first()[0] == numbers


@pytest.mark.parametrize("row,rates,cost", [
    ((1000, 200, 50), ("2.5", "0.25", "10"), "0.00255"), ((1000, 200, 50), ("2.5", None, "10"), "0.003"),
    ((1000, 200, 50), ("2.5", 0, "10"), "0.003"), ((1, 0, 0), (None, None, "10"), None), ((0, 0, 0), (None, None, None), "0"),
])
def test_token_cost_is_exact(spark, row, rates, cost):
    df = spark.createDataFrame([row], "input_tokens bigint, cached_input_tokens bigint, output_tokens bigint")
    got = ex.token_cost(df, *rates).first().estimated_cost_usd
    assert got == (None if cost is None else Decimal(cost))


def test_final_output_matches_records_and_rejects_a_conflict(run):
    assert run.final.count() == run.candidates.count()
    with pytest.raises(Exception, match="conflicts"):
        rp.final_output(run.reviewed, run.reasons.withColumn("selected_note_id", F.lit("N1"))).agg(F.max("reason")).collect()


def test_evidence_has_one_row_per_note(run):
    rows = run.evidence_rows
    nested = rd.anomaly_view_join(run.view, rows)
    assert nested.where("note_id is not null").count() == rows.count()
    assert nested.select("route", "route_type", "week_of").distinct().count() == run.view.count()


def test_two_types_of_a_route_in_one_week_are_two_rows(spark):
    def shipment(i, kind, week, freight):
        return (f"S{i}{kind}{week}", "A-B", kind, dt.date(2024, 1, 1) + dt.timedelta(days=7 * week), "steel", freight, 1.0, 10.0)

    rows = [shipment(i, kind, week, 100.0 if week < 9 else 300.0) for i in range(2) for kind in ("Short", "Long") for week in range(10)]
    shipments = spark.createDataFrame(rows, "shipment_id string, route string, route_type string, week_of date, material string, "
                                            "freight_cost_inr double, quantity_tonnes double, tonne_km double").withColumn(
        "shipment_date", F.col("week_of")).withColumn("transporter", F.lit("t"))
    notes = spark.createDataFrame([], "note_id string, date date, applies_to string, note string")
    run = Analysis(spark, shipments, notes)
    assert run.candidates.count() == 2 and run.reviewed.count() == 2 and run.final.count() == 2
    assert {r.route_type for r in run.reviewed.collect()} == {"Short", "Long"}
    week = dt.date(2024, 1, 1) + dt.timedelta(days=63)
    assert rd.get_anomaly(run.view, "A-B", week, "Long").count() == 1


def test_reads(run):
    view = run.view
    page = rd.list_anomalies(view, sort_by="vs_similar_routes_pct", sort_order="desc", limit=1000).collect()
    peers = [r.vs_similar_routes_pct for r in page]
    known = [p for p in peers if p is not None]
    assert known == sorted(known, reverse=True) and all(p is None for p in peers[len(known):])
    assert rd.count_anomalies(view).first().total == view.count()
    assert rd.timeline_reconcile(rd.route_timeline(run.metrics, run.decisions), view).count() == 0
    with pytest.raises(ValueError):
        rd.list_anomalies(view, sort_by="reason")
    with pytest.raises(ValueError):
        rd.list_anomalies(view, week_from=dt.date(2024, 2, 1), week_to=dt.date(2024, 1, 1))


def test_rollup_fails_on_a_missed_target(spark):
    checks = spark.createDataFrame([("a", "c1", True, "pass"), ("b", "c2", False, "fail")],
                                   "domain string, check_id string, blocking boolean, status string")
    metrics = spark.createDataFrame([("a", "m1", True, .9, 1.0, "eq"), ("b", "m2", True, .2, None, "informational")],
                                    "domain string, metric_id string, blocking boolean, value double, target double, target_relation string")
    assert {r.domain: r.status for r in ms.check_rollup(checks, metrics).collect()} == {"a": "fail", "b": "pass"}


def test_offsets_shown_have_a_limit_of_their_own(spark):
    from lanecost.operators.rootcause import lead_rank
    from lanecost.schemas import Decomposition

    rows = [("A-B", "Short", None, "material", f"c{k}", (-1) ** k * (1.0 + k), 50.0, "strong") for k in range(8)]
    df = spark.createDataFrame(rows, "route string, route_type string, week_of date, lens string, category string, net_contribution double, "
                                     "absolute_effect_share_pct double, support_level string")
    ranked = lead_rank(df, Decomposition(leads_shown=1, offsets_shown=2)).collect()
    assert sorted((r.kind, r.category) for r in ranked) == [("lead", "c6"), ("offset", "c5"), ("offset", "c7")]
