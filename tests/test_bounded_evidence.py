"""Evidence jobs whose steps must not grow faster than notes and candidates."""

import datetime as dt

from pyspark.sql import functions as F

from lanecost.operators import evidence as ev, explain as ex, factorised as fa, measures as ms
from lanecost.schemas import COMPILED_NOTE_SCHEMA, KEY

MONDAY = dt.date(2024, 1, 1)
KEYS = "route string, route_type string, week_of date"


def packets(spark, n):
    rows = [("A-B", "Short", MONDAY, f"N{k}", "supporting", MONDAY, None, f"{k} percent") for k in range(n)]
    return spark.createDataFrame(rows, f"{KEYS}, note_id string, role string, effective_from date, effective_to date, magnitude_text string")


def test_only_facts_that_are_claimed_reach_the_checks(spark):
    held = packets(spark, 50)
    asked = spark.createDataFrame([("A-B", "Short", MONDAY, "note", v) for v in ("N7", "N99", "N7")], f"{KEYS}, kind string, value string")
    assert [(r.kind, r.value) for r in ex.approved_claims(held, asked).collect()] == [("note", "N7")]
    assert ex.approved_claims(held).where("kind = 'note'").count() == 50


def test_metrics_meet_only_cited_packet_notes(spark):
    decisions = spark.createDataFrame([("A-B", "Short", MONDAY, "partially_explained", None), ("A-C", "Short", MONDAY, "unexplained", None)],
                                      f"{KEYS}, verdict string, selected_note_id string")
    records = decisions.withColumns({"reason": F.lit("x"), "cited_note_ids": F.when(
        F.col("route") == "A-B", F.array(F.lit("N7"))).otherwise(F.array(F.lit("N1")))})
    validated = spark.createDataFrame([("t", [])], "text_id string, failure_codes array<string>")
    out = ms.explanation_quality_metrics(records, decisions, packets(spark, 50), validated)
    assert {r.metric_id: r.numerator for r in out.collect()}["explanation.unsupported_note_id_rate"] == 1
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


def notes(spark, n, last=None):
    rows = [(f"N{k}", MONDAY, "x", "text", "global" if k % 2 else "route", [] if k % 2 else ["A-B", "A-D"], "in_dataset", MONDAY, last,
             "explicit", "toll", "increase", "explicit_increase", True, False, None, [], None) for k in range(n)]
    return spark.createDataFrame(rows, COMPILED_NOTE_SCHEMA)


def candidates(spark):
    return spark.createDataFrame([("A-B", "Short", MONDAY + dt.timedelta(weeks=k), 25.0, True) for k in range(3)],
                                 f"{KEYS}, vs_own_history_pct double, peer_threshold_breached boolean")


def written_rows(spark, monkeypatch):
    """Rows of the tables that the block join writes."""
    rows, cut = [], ev.cut_lineage

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(ev, "cut_lineage", counted)
    return rows


def test_blocks_without_a_candidate_do_not_reach_the_join(spark, monkeypatch):
    held = written_rows(spark, monkeypatch)
    c, n = candidates(spark), notes(spark, 20)
    pairs = ev.structured_recall(c, n)
    assert pairs.count() == 60
    assert ev.note_blocks(n, "note_id").count() > 500 and held[0] <= 60


def test_the_audit_stores_a_note_once(spark, tmp_path):
    c, n = candidates(spark), notes(spark, 20)
    gated = ev.evidence_gate(c, ev.structured_recall(c, n).drop("overlap_days"), n)
    tables = fa.audit_tables(c, n, ev.decide_verdict(c, n))
    path = fa.write_audit(f"{tmp_path}/audit", tables)
    assert spark.read.text(f"{path}/notes").count() == 20
    read = {k: spark.read.schema(table.schema).json(f"{path}/{k}") for k, (table, _) in tables.items()}
    columns = (*KEY, "note_id", "evidence_level", "overlap_days", "rejection_codes")
    listed = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert listed(fa.audit_pairs(fa.audit_memberships(read["notes"]), read["members"])) == listed(gated)
    assert read["candidates"].agg(F.sum("notes")).first()[0] == 60


def test_claims_of_the_gate_are_not_broadcast(spark):
    c, n = candidates(spark), notes(spark, 4)
    hits = spark.createDataFrame([("A-B", "Short", MONDAY, "N0")], f"{KEYS}, note_id string")
    gated = ev.evidence_gate(c, hits, n)
    plan = gated._jdf.queryExecution().sparkPlan().toString()
    joined = [line for line in plan.split("\n") if "Join [note_id" in line]
    assert len(joined) == 1 and "SortMergeJoin" in joined[0] and gated.count() == 1
