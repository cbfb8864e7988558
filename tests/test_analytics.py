"""Weekly rates, baselines, candidate rule and display."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lanecost.operators import baselines as b, candidates as c, quality as q, weekly as w
from lanecost.schemas import WEEKLY_COLUMNS

MONDAY = dt.date(2024, 1, 1)


def weeks(spark, rows):
    """rows: (route, route_type, week index, rate)"""
    data = [(r, t, MONDAY + dt.timedelta(days=7 * k), 1, float(v), 1.0, 1.0, float(v)) for r, t, k, v in rows]
    return spark.createDataFrame(data, (
        "route string, route_type string, week_of date, shipment_count bigint, total_freight_cost_inr double, "
        "total_quantity_tonnes double, total_tonne_km double, cost_per_tonne_km double")).select(*WEEKLY_COLUMNS)


def by_key(df, value):
    return {(r.route, (r.week_of - MONDAY).days // 7): r[value] for r in df.collect()}


def test_weekly_rate_is_weighted_and_independent_of_order(spark):
    rows = [("A-B", "Short", MONDAY, 10.0, 2.0, 20.0), ("A-B", "Short", MONDAY, 1.1, 1.0, 3.3),
            ("A-B", "Short", MONDAY + dt.timedelta(days=7), 0.1, 1.0, 0.7)] * 50
    df = spark.createDataFrame(rows, "route string, route_type string, week_of date, freight_cost_inr double,"
                                     " quantity_tonnes double, tonne_km double")
    first = w.weekly_route_metrics(df)
    again = w.weekly_route_metrics(df.repartition(7).orderBy(F.rand(3)))
    assert sorted(first.collect()) == sorted(again.collect())
    assert by_key(first, "cost_per_tonne_km")[("A-B", 0)] == pytest.approx(11.1 / 23.3, rel=1e-12)
    assert by_key(first, "shipment_count") == {("A-B", 0): 100, ("A-B", 1): 50}


def test_history_counts_observed_weeks_and_never_looks_ahead(spark):
    observed = [0, 1, 5, 6, 7, 9, 10, 20, 21, 22, 30]
    df = b.add_baselines(weeks(spark, [("A-B", "Short", k, i + 1) for i, k in enumerate(observed)]))
    own, used = by_key(df, "own_history_avg_cost_per_tonne_km"), by_key(df, "history_weeks_used")
    assert own[("A-B", 0)] is None and used[("A-B", 0)] == 0
    for i, k in enumerate(observed[1:], start=1):
        past = [j + 1 for j in range(i)][-8:]
        assert own[("A-B", k)] == pytest.approx(sum(past) / len(past))
        assert used[("A-B", k)] == min(i, 8)


def test_peers_exclude_the_route_itself_and_other_types(spark):
    df = b.add_baselines(weeks(spark, [("A", "Short", 0, 1), ("B", "Short", 0, 3), ("C", "Short", 0, 8),
                                       ("D", "Long", 0, 100), ("A", "Short", 1, 2)]))
    peer, n = by_key(df, "similar_routes_avg_cost_per_tonne_km"), by_key(df, "peer_routes_used")
    assert peer[("A", 0)] == pytest.approx(5.5) and peer[("C", 0)] == pytest.approx(2.0)
    assert peer[("D", 0)] is None and n[("D", 0)] == 0 and peer[("A", 1)] is None


@pytest.mark.parametrize("own,peer,expected", [
    (20.0, None, (True, True, False, True)), (19.999, None, (True, False, False, False)),
    (5.0, 20.0, (True, False, True, True)), (0.0, 50.0, (False, False, True, False)),
    (-1.0, 50.0, (False, False, True, False)), (None, 50.0, (False, False, True, False)),
    (25.0, 30.0, (True, True, True, True)), (None, None, (False, False, False, False)),
])
def test_candidate_rule_matrix(spark, own, peer, expected):
    base = b.add_baselines(weeks(spark, [("A", "Short", 0, 1)]))
    row = c.candidate_rule(base.withColumns({
        "vs_own_history_pct": F.lit(own).cast("double"), "vs_similar_routes_pct": F.lit(peer).cast("double")})).first()
    assert (row.is_rising, row.own_threshold_breached, row.peer_threshold_breached, row.candidate_anomaly) == expected


@pytest.mark.parametrize("bad", [-1, float("nan"), float("inf"), True, "20"])
def test_threshold_must_be_finite_and_not_negative(bad):
    with pytest.raises(ValueError):
        q.validated_threshold(bad)


def test_display_text(spark):
    base = b.add_baselines(weeks(spark, [("A", "Short", 0, 1)]))
    shown = lambda own, peer: c.contract_display(c.candidate_rule(base.withColumns({
        "cost_per_tonne_km": F.lit(3.456), "vs_own_history_pct": F.lit(own).cast("double"),
        "vs_similar_routes_pct": F.lit(peer).cast("double")}), 0.0)).first()
    row = shown(29.46, -0.04)
    assert row.cost_per_tonne_km == "3.46" and row.vs_own_history == "+29.5% vs this route's past average"
    assert row.vs_similar_routes == "-0.0% vs similar-length routes this week"
    assert shown(12.25, None).vs_own_history.startswith("+12.2%")
    assert shown(12.25, None).vs_similar_routes == c.PEER_UNAVAILABLE_TEXT


def test_reconciliations_find_a_changed_value(spark):
    weekly = weeks(spark, [("A", "Short", k, k + 1) for k in range(12)] + [("B", "Short", k, 2) for k in range(12)])
    good = b.add_baselines(weekly)
    assert {r.status for r in b.baseline_reconciliation(weekly, good).collect()} == {"pass"}
    late = F.col("week_of") == F.lit(MONDAY + dt.timedelta(days=63))
    bad = good.withColumn("own_history_avg_cost_per_tonne_km", F.when(late, 99.0).otherwise(
        F.col("own_history_avg_cost_per_tonne_km")))
    failed = {r.check_id: r.failures for r in b.baseline_reconciliation(weekly, bad).collect() if r.failures}
    assert failed == {"own_value": 2}


def test_sums_lose_no_digits_at_any_magnitude(spark):
    values = [1.0, 1 / 3, 1e-9, 1e21, 123456.789, 5e-300, 1e280, 0.0, -1 / 3, 7e11]
    for freight, tkm in zip(values, reversed([v or 1.0 for v in values])):
        df = spark.createDataFrame([("A", "S", MONDAY, freight, 1.0, tkm)] * 3, (
            "route string, route_type string, week_of date, freight_cost_inr double, quantity_tonnes double, tonne_km double"))
        row = w.weekly_route_metrics(df).first()
        assert row.total_freight_cost_inr == pytest.approx(3 * freight, rel=1e-15)
        assert row.cost_per_tonne_km == pytest.approx(freight / tkm, rel=1e-15)
    mixed = spark.createDataFrame([("A", "S", MONDAY, v, 1.0, 1.0) for v in (1e21, 1.0, -1e21, 1 / 3)] * 20, (
        "route string, route_type string, week_of date, freight_cost_inr double, quantity_tonnes double, tonne_km double"))
    totals = {w.weekly_route_metrics(mixed.repartition(n)).first().total_freight_cost_inr for n in (1, 3, 7)}
    assert len(totals) == 1


def test_peers_of_very_large_and_very_small_rates(spark):
    rates = {"A": 1e12, "B": 3e-20, "C": 1e-20}
    df = b.peer_baseline(weeks(spark, [(k, "Short", 0, v) for k, v in rates.items()]))
    peer = by_key(df, "similar_routes_avg_cost_per_tonne_km")
    assert peer[("A", 0)] == pytest.approx(2e-20, rel=1e-12) and peer[("B", 0)] == pytest.approx(5e11, rel=1e-12)
