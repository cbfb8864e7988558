"""Queries that list every row of their job, and runs in which a step has nothing to do."""

import datetime as dt
from types import SimpleNamespace

from pyspark.sql import functions as F

from lanecost.plans import catalog, workload
from lanecost.plans.pipeline import Analysis
from lanecost.schemas import KEY

MONDAY = dt.date(2024, 1, 1)
KEYS = "route string, route_type string, week_of date"


def test_recall_gate_and_packets_list_every_note(spark, monkeypatch):
    pairs = spark.createDataFrame([("A-B", "Short", MONDAY, n, 7) for n in ("N1", "N2", "N3")], f"{KEYS}, note_id string, overlap_days int")
    gated = pairs.withColumns({"evidence_level": F.lit("full"), "rejection_codes": F.array(F.lit("x"))})
    packets = pairs.withColumns({c: F.lit("x") for c in ("role", "event_type", "magnitude_text")})
    monkeypatch.setattr(catalog, "run", lambda *_: SimpleNamespace(recalled=pairs, assessed=gated, packets=packets))
    for name in ("structured_recall", "evidence_gate", "packet_notes"):
        assert sorted(r.note_id for r in catalog.QUERIES[name](spark, "").collect()) == ["N1", "N2", "N3"]
        assert "GROUP BY" not in catalog.ORACLES[name].rsplit("\n", 1)[-1]


def test_a_run_without_open_cases_has_no_root_cause(spark, monkeypatch):
    none = spark.createDataFrame([], f"{KEYS}, candidate_key string, target_gap double")
    monkeypatch.setattr(catalog, "run", lambda *_: SimpleNamespace(unexplained=none, root_base=none, view=none))
    found = catalog.QUERIES["get_root_cause"](spark, "")
    assert found.columns == ["candidate_key", "target_gap"] and not found.collect()


def test_categories_and_weeks_of_one_written_copy(spark):
    rows = [(r, "Short", MONDAY + dt.timedelta(weeks=k % 5), f"T{k % 3}", f"M{k % 2}", k + 1, 100 * k + 7, 3 * k + 1.5)
            for k in range(30) for r in ("A-B", "A-C")]
    shipments = spark.createDataFrame(rows, f"{KEYS}, transporter string, material string, quantity_tonnes int, tonne_km int, freight_cost_inr double")
    plain, kept = (Analysis(spark, shipments, None, categories=c) for c in (False, True))
    listed = lambda df: sorted(map(str, df.collect()))
    assert listed(plain.shares) == listed(kept.shares) and listed(plain.weekly) == listed(kept.weekly)
    assert kept.shipments is kept.shipments and len(kept.shipments.inputFiles()) > 0 == len(plain.shipments.inputFiles())


def test_line_items_are_shuffled_for_orders_and_parts_only(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    put("region", [(0, "X"), (1, "Y")], "r_regionkey int, r_name string")
    put("nation", [(0, "NX", 0), (1, "NY", 1)], "n_nationkey int, n_name string, n_regionkey int")
    put("supplier", [(1, 0), (2, 1)], "s_suppkey long, s_nationkey int")
    put("customer", [(1, 1), (2, 0)], "c_custkey long, c_nationkey int")
    put("part", [(1, "STEEL")], "p_partkey long, p_type string")
    put("orders", [(1, 1), (2, 2), (3, 9), (None, 1)], "o_orderkey long, o_custkey long")
    put("lineitem", [(o, n, p, s, 2.0, 10.0, MONDAY) for n, (o, p, s) in enumerate([(1, 1, 1), (2, 1, 2), (2, 1, 2), (3, 1, 1), (1, 7, 1), (None, 1, 1)])],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate date")
    raw = workload.raw_shipments(spark, str(tmp_path))
    got = sorted((r.shipment_id, r.origin, r.destination, r.transporter, r.material) for r in raw.collect())
    assert got == [("1-0-1-1-10.00", "X", "Y", "NX", "STEEL"), ("2-1-1-2-10.00", "Y", "X", "NY", "STEEL"), ("2-2-1-2-10.00", "Y", "X", "NY", "STEEL")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "400")  # the tables of names are broadcast, the others are not
    try:
        plan = workload.shipments(spark, str(tmp_path)).groupBy(*KEY).agg(F.sum("tonne_km"))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.split("\n") if "Join Inner" in line]
    depth = lambda key: next(len(x) - len(x.lstrip(" :+-")) for x in joins if key in x)
    assert depth("c_custkey") > depth("o_orderkey") > depth("l_partkey") > depth("l_suppkey")
