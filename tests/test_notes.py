"""Rule tables of the note compiler."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lanecost.operators import notes as n

DAY = dt.date(2024, 11, 20)  # a Wednesday


def compiled(spark, rows, routes=("A-B", "C-D")):
    df = spark.createDataFrame([(f"N{i:03d}", d, a, t) for i, (d, a, t) in enumerate(rows)],
                               "note_id string, date date, applies_to string, note string")
    known = spark.createDataFrame([(r,) for r in routes], "route string")
    return sorted(n.compile_notes(df, known).collect())


INTERVALS = [
    ("Closed from Nov 25 to Dec 3.", "explicit_range", dt.date(2024, 11, 25), dt.date(2024, 12, 3)),
    ("Closed from December 28 through Jan 4.", "explicit_range", dt.date(2024, 12, 28), dt.date(2025, 1, 4)),
    ("Closed from sept. 1, 2023 to Sep 2 2023 for a week.", "explicit_range", dt.date(2023, 9, 1), dt.date(2023, 9, 2)),
    ("Slow for about a week.", "approximate_week", DAY, DAY + dt.timedelta(days=6)),
    ("Slow for one week this quarter.", "approximate_week", DAY, DAY + dt.timedelta(days=6)),
    ("Calm this quarter, starting this week.", "calendar_quarter", dt.date(2024, 10, 1), dt.date(2024, 12, 31)),
    ("Prices up starting this week.", "open_ended_start", DAY, None),
    ("A plaza was introduced.", "open_ended_start", DAY, None),
    ("Busy this week.", "calendar_week", dt.date(2024, 11, 18), dt.date(2024, 11, 24)),
    ("A festival week.", "calendar_week", dt.date(2024, 11, 18), dt.date(2024, 11, 24)),
    ("Back: returned to normal.", "state_after_completion", DAY, None),
    ("Better after the works were completed.", "state_after_completion", DAY, None),
    ("Nothing to say.", "source_date_fallback", DAY, DAY),
    ("Nothing until a month from now.", "source_date_fallback", DAY, DAY),
]


def test_intervals(spark):
    rows = compiled(spark, [(DAY, "A-B", t[0]) for t in INTERVALS])
    for row, (text, basis, first, last) in zip(rows, INTERVALS):
        assert (row.temporal_basis, row.effective_from, row.effective_to) == (basis, first, last), text
    assert "temporal_phrase_ambiguous" in rows[-1].compilation_warnings
    assert "temporal_phrase_ambiguous" not in rows[-2].compilation_warnings


@pytest.mark.parametrize("text,error", [
    ("from Feb 30 to Mar 2", "impossible_date"), ("from May 9 to May 3", "range_ends_before_start"),
    ("from Sep 20 to Jan 5", "range_ends_before_start"), ("from Nov 9 2024 to Nov 3 2024", "range_ends_before_start"),
    ("from Oct 9 to Apr 3", "range_ends_before_start"),
])
def test_bad_ranges_carry_an_error_and_the_strict_form_fails(spark, text, error):
    df = spark.createDataFrame([("N1", DAY, "A-B", text)], "note_id string, date date, applies_to string, note string")
    out = n.compile_notes(df, spark.createDataFrame([("A-B",)], "route string"))
    assert out.first().compile_error == error
    with pytest.raises(Exception, match="did not compile"):
        n.fail_on_compile_errors(out).collect()


IMPACTS = [
    ("This meant higher trip costs.", "explicit_increase", "increase", True, False),
    ("A temporary surcharge applied by transporters.", "explicit_increase", "increase", True, False),
    ("Freight rates fell.", "explicit_decrease", "decrease", True, False),
    ("Lower freight rates while transport costs rose.", "unknown", "unknown", None, False),
    ("Freight rates rose without a rate change.", "unknown", "unknown", None, False),
    ("Absorbed by transporters and remained stable.", "explicit_no_rate_change", "no_change", False, True),
    ("Costs were not significantly affected.", "explicit_no_material_impact", "no_change", False, True),
    ("Traffic remained normal although freight rates rose.", "normal_or_stable_operations", "no_change", False, True),
    ("A bridge opened.", "not_stated", "unknown", None, False),
]


def test_impacts(spark):
    for row, (text, *want) in zip(compiled(spark, [(DAY, "A-B", t[0]) for t in IMPACTS]), IMPACTS):
        got = [row.cost_impact_status, row.impact_direction, row.affects_transport_cost, row.negates_cost_increase]
        assert got == want, text


EVENTS = [
    ("returned to normal after the flood", "recovery_or_normalization"), ("festival demand", "festival_demand"),
    ("Fuel price", "fuel_price_change"), ("a compliance rule", "regulatory_compliance"),
    ("road resurfacing", "road_improvement"), ("highway  maintenance", "road_maintenance"),
    ("Heavy rain and a toll", "weather_disruption"), ("toll plaza demand", "toll_or_infrastructure"),
    ("normal operations", "normal_operations"), ("truck availability", "capacity_or_demand_condition"),
    ("a closure", "other"), ("nothing", "unknown"), ("floods", "unknown"),
]


def test_events_in_list_order(spark):
    rows = compiled(spark, [(DAY, "A-B", t) for t, _ in EVENTS])
    assert [r.event_type for r in rows] == [e for _, e in EVENTS]


MAGNITUDES = [
    ("Freight rates rose by roughly 5-7%.", "roughly 5-7%", 7.0), ("Freight rates rose 4 percent", "4 percent", 4.0),
    ("Surcharge of INR 12.5 per km.", "INR 12.5 per km", None), ("Freight costs up 5% and 9%.", None, None),
    ("Freight costs up 5% then 5%.", "5%", 5.0), ("Sales grew 5%.", None, None), ("Freight costs moved.", None, None),
]


def test_magnitudes(spark):
    rows = compiled(spark, [(DAY, "A-B", t[0]) for t in MAGNITUDES])
    assert [r.magnitude_text for r in rows] == [m[1] for m in MAGNITUDES]
    assert "conflicting_cost_magnitudes" in rows[3].compilation_warnings
    df = spark.createDataFrame([(m[1],) for m in MAGNITUDES], "m string")
    assert [r[0] for r in df.select(n.magnitude_upper_bound(F.col("m"))).collect()] == [m[2] for m in MAGNITUDES]


def test_scope(spark):
    rows = compiled(spark, [
        (DAY, "All Routes", "x"), (DAY, "ALL routes", "x"), (DAY, "A-B", "x"), (DAY, "a-b", "x"),
        (DAY, "B-A", "x"), (DAY, "A-B", "This lies outside this dataset."), (DAY, "A-B-C", "x"), (DAY, "A1-B", "x")])
    assert [r.scope_type for r in rows[:5]] == ["global", "global", "route", "route", "route"]
    assert [r.scope_status for r in rows[:6]] == ["in_dataset"] * 3 + ["outside_dataset"] * 3
    assert [r.applies_to_routes for r in rows[:3]] == [[], [], ["A-B"]]
    assert [r.compile_error for r in rows[6:]] == ["unsupported_scope"] * 2
    assert "explicit_route_not_in_dataset" in rows[4].compilation_warnings
