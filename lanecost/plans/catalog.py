"""Registered queries: each operator over the whole test tables, with its oracle SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import expressions as fx
from ..operators import (
    baselines as b, candidates as c, evidence as ev, explain as ex, factorised as fa, invariants as inv, measures as ms,
    normalize as nm, notes as nt, quality as dq, reads as rd, report as rp, retrieval as rt,
    rootcause as rc, weekly as wk,
)
from ..schemas import KEY, OUTPUT_COLUMNS, RetrievalPolicy, SHIPMENT_NUMERIC_COLUMNS, SHIPMENT_TEXT_COLUMNS
from ..session import cut_lineage, scratch_path
from ..sources import files
from . import workload as w
from .oracle import build, r
from .pipeline import Analysis, analyse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = "route, route_type, week_of"
SCORES = RetrievalPolicy()


def query(name: str, sql: str | None = None):
    """Register a query under its operator name, with the SELECT its oracle ends in."""
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: shown(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = build(sql)
        return fn
    return wrap


def shown(df: DataFrame) -> DataFrame:
    """Engine-neutral result: doubles to 6 digits, counts as bigint, arrays as text.

    The small shift keeps averages of short decimals, which often end exactly on half a
    unit, away from the rounding edge, where the last bit of a sum would decide.
    """
    columns = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            col = F.rint(col * F.lit(1e6) + F.lit(0.1234567)) / F.lit(1e6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            col = col.cast("bigint")
        elif isinstance(f.dataType, T.DecimalType):
            col = col.cast("string")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.StringType, T.DateType)):
            col = F.array_join(col.cast("array<string>"), ",")
        columns.append(col.alias(f.name))
    return df.select(*columns)


def run(spark: SparkSession, sf: str) -> Analysis:
    return Analysis(spark, w.shipments(spark, sf), w.context_notes(spark, sf))


def run_categories(spark: SparkSession, sf: str) -> Analysis:
    """A run whose weekly and category tables start from one written copy of the shipments."""
    return Analysis(spark, w.shipments(spark, sf), w.context_notes(spark, sf), categories=True)


def weekly_of(spark, sf):
    return wk.weekly_route_metrics(w.shipments(spark, sf))


def baselines_of(spark, sf):
    return b.add_baselines(weekly_of(spark, sf))


def metrics_of(spark, sf):
    return analyse(w.shipments(spark, sf))


def compiled_of(spark, sf):
    return nt.compile_notes(w.context_notes(spark, sf), w.shipments(spark, sf).select("route").distinct())


def passing(*ids: str, column: str = "check_id", extra: str = ", 0::BIGINT AS failures, 'pass' AS status") -> str:
    return " UNION ALL ".join(f"SELECT '{i}' AS {column}{extra}" for i in ids)


# --- sources and sinks --------------------------------------------------------------

_RAW = ("shipment_id", "origin", "destination", "route_type", "material", "quantity_tonnes", "distance_km",
        "freight_cost_inr", "shipment_date", "transporter")
def _write_csv(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _write_lines(lines: DataFrame, header: str, name: str) -> str:
    """A text table (column value) of which each part begins with the header."""
    opens = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    path = scratch_path(lines.sparkSession, name)
    marked = lines.select("value", opens.alias("opens"))
    marked.select(F.explode(F.when(F.col("opens"), F.array(F.lit(header), "value")).otherwise(F.array("value"))).alias("value")).write.text(path)
    return path


_ISSUES = f"""
SELECT 'error' AS severity, code, 'shipments' AS dataset, col AS "column", row_number FROM (
  SELECT row_number, unnest([{', '.join(repr(x) for x in SHIPMENT_TEXT_COLUMNS)}]) AS col,
    unnest([{', '.join(f"CASE WHEN {x} IS NULL THEN 'missing_value' WHEN trim({x}) = '' THEN 'blank_value' END" for x in SHIPMENT_TEXT_COLUMNS)}]) AS code FROM raw_rows
  UNION ALL
  SELECT row_number, unnest([{', '.join(repr(x) for x in SHIPMENT_NUMERIC_COLUMNS)}]),
    unnest([{', '.join(f"CASE WHEN {x} IS NULL THEN 'missing_value' WHEN trim({x}) = '' THEN 'blank_value' WHEN trim({x}) = 'abc' THEN 'invalid_type' WHEN trim({x}) IN ('nan', 'inf') THEN 'non_finite_value' WHEN try_cast(replace(trim({x}), '_', '') AS DOUBLE) <= 0 THEN 'non_positive_value' END" for x in SHIPMENT_NUMERIC_COLUMNS)}]) FROM raw_rows
  UNION ALL
  SELECT row_number, 'shipment_date', CASE WHEN shipment_date IS NULL THEN 'missing_value' WHEN trim(shipment_date) = '' THEN 'blank_value'
    WHEN NOT regexp_full_match(shipment_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR try_cast(shipment_date AS DATE) IS NULL THEN 'invalid_date' END FROM raw_rows
  UNION ALL
  SELECT row_number, 'route_type', 'invalid_route_type' FROM raw_rows WHERE trim(route_type) NOT IN ('Short', 'Medium', 'Long') AND trim(route_type) <> ''
  UNION ALL
  SELECT row_number, 'tonne_km', 'non_finite_value' FROM raw_rows WHERE (quantity_tonnes = '1e308' AND distance_km = '1e10')
    OR (distance_km = 'inf' AND quantity_tonnes <> 'nan' AND try_cast(replace(trim(quantity_tonnes), '_', '') AS DOUBLE) > 0)
  UNION ALL
  SELECT row_number, 'shipment_id', 'duplicate_identifier' FROM (SELECT row_number, trim(shipment_id) AS id, count(*) OVER (PARTITION BY trim(shipment_id)) AS n FROM raw_rows) d
  WHERE id <> '' AND n > 1) i WHERE code IS NOT NULL"""


def _finite_only(df: DataFrame) -> DataFrame:
    """Not-a-number and infinite values as NULL, which both engines show alike."""
    return df.withColumns({c: F.when(fx.finite(F.col(c)), F.col(c)) for c in (*SHIPMENT_NUMERIC_COLUMNS, "tonne_km")})


def _ship_sql(missing: str) -> str:
    """The whole raw table, typed; ``missing`` is what a missing text value becomes."""
    text = {c: f"coalesce(trim({c}), {missing})" for c in SHIPMENT_TEXT_COLUMNS}
    number = lambda c: f"try_cast(replace(trim({c}), '_', '') AS DOUBLE)"
    shown_ = lambda c: r(f"CASE WHEN isfinite({c}) THEN {c} END", c)
    return f"""
SELECT {', '.join(f'{v} AS {c}' for c, v in text.items())}, {', '.join(shown_(c) for c in (*SHIPMENT_NUMERIC_COLUMNS, 'tonne_km'))},
  shipment_date, {text['origin']} || '-' || {text['destination']} AS route, date_trunc('week', shipment_date)::DATE AS week_of
FROM (SELECT * REPLACE ({', '.join(f'{number(c)} AS {c}' for c in SHIPMENT_NUMERIC_COLUMNS)},
    CASE WHEN regexp_full_match(trim(shipment_date), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(trim(shipment_date) AS DATE) END AS shipment_date),
  {number('quantity_tonnes')} * {number('distance_km')} AS tonne_km FROM raw_rows) t"""


@query("scan_shipments", _ship_sql("''"))
def _(spark, sf):
    return _finite_only(files.scan_shipments(spark, _write_csv(w.raw_text_rows(spark, sf).select(*_RAW), "shipments"))[0])


# every issue of a written file leads back to the row it was found in
@query("issue_rows", f"""
SELECT CASE a.code WHEN 'missing_value' THEN 'blank_value' ELSE a.code END AS code, a."column", coalesce(shipment_id, '') AS shipment_id, freight_cost_inr,
  count(*) AS issues FROM ({_ISSUES}) a JOIN raw_rows USING (row_number) GROUP BY ALL""")
def _(spark, sf):
    path = _write_csv(w.raw_text_rows(spark, sf).select(*_RAW), "shipments")
    raw = cut_lineage(files.read_text_table(spark, path, _RAW))
    return dq.shipment_issues(raw.drop("malformed")).join(raw, "row_number").groupBy(
        "code", "column", "shipment_id", "freight_cost_inr").agg(F.count(F.lit(1)).alias("issues"))


@query("scan_context_notes", "SELECT note_id, date, applies_to, note FROM notes_raw")
def _(spark, sf):
    notes = w.context_notes(spark, sf).withColumn("date", F.col("date").cast("string"))
    return files.scan_context_notes(spark, _write_csv(notes, "notes"))[0]


@query("scan_malformed_rows", """
SELECT count(*) AS rows, count(*) FILTER ((row_number - 2) % 17 = 0 OR (row_number - 2) % 19 = 0) AS malformed_rows FROM raw_rows""")
def _(spark, sf):
    fields = F.transform(F.array(*_RAW), lambda v: F.concat(F.lit('"'), F.coalesce(v, F.lit("")), F.lit('"')))
    k = F.col("row_number") - 2
    line = (F.when(k % 17 == 0, F.array_join(F.slice(fields, 1, 7), ","))
            .when(k % 19 == 0, F.concat(F.array_join(fields, ","), F.lit(",more")))
            .otherwise(F.array_join(fields, ",")))
    path = _write_lines(w.raw_text_rows(spark, sf).select(line.alias("value")), ",".join(_RAW), "ragged")
    return files.scan_malformed_rows(files.read_text_table(spark, path, _RAW))


@query("contract_body_arity", """
SELECT 'warning' AS severity, 'malformed_sample_row' AS code, 'output_contract' AS dataset, NULL::VARCHAR AS "column",
  concat('R', event_id::VARCHAR, ',2024-01-01,1.00,+1.0% vs a,+1.0% vs b,Yes,,one, two') AS value FROM events WHERE event_type = 'error'""")
def _(spark, sf):
    return files.contract_body_arity(spark, _contract_file(spark, sf))


def _contract_file(spark, sf) -> str:
    events = w.table(spark, sf, "events")
    good = "R%s,2024-01-01,1.00,+1.0%% vs a,+1.0%% vs b,Yes,,one"
    text = F.concat(F.format_string(good, F.col("event_id").cast("string")),
                    F.when(F.col("event_type") == "error", ", two").otherwise(""))
    return _write_lines(events.select(text.alias("value")), ",".join(OUTPUT_COLUMNS), "contract")


def _issues(where: str) -> str:
    return f"SELECT * FROM ({_ISSUES}) a WHERE {where}"


# In a CSV file a missing value is an empty one, so it is reported as blank.
@query("load_bundle", f"""
SELECT dataset, severity, CASE code WHEN 'missing_value' THEN 'blank_value' ELSE code END AS code, count(*) AS issues
FROM ({_ISSUES}) a GROUP BY ALL
UNION ALL SELECT 'output_contract', 'warning', 'malformed_sample_row', count(*) FROM events WHERE event_type = 'error'""")
def _(spark, sf):
    ships = _write_csv(w.raw_text_rows(spark, sf).select(*_RAW), "shipments")
    notes = _write_csv(w.context_notes(spark, sf).withColumn("date", F.col("date").cast("string")), "notes")
    issues = files.load_bundle(spark, ships, notes, _contract_file(spark, sf))[2]
    return issues.groupBy("dataset", "severity", "code").agg(F.count(F.lit(1)).alias("issues"))


_FINAL = """
SELECT route, week_of, cost_per_tonne_km, vs_own_history, vs_similar_routes, flagged, matched_note_id, reason FROM reviewed"""


@query("sink_contract_csv", _FINAL)
def _(spark, sf):
    path = files.sink_contract_csv(run(spark, sf).final, scratch_path(spark, "final"))
    return files.contract_lines(spark, path).where(F.col("route") != "route").select(*OUTPUT_COLUMNS)


_COMPILED = """
SELECT note_id, source_date, source_applies_to, original_text, scope_type, applies_to_routes, scope_status, effective_from,
  effective_to, temporal_basis, event_type, impact_direction, cost_impact_status, affects_transport_cost,
  negates_cost_increase, magnitude_text, compilation_warnings, compile_error FROM compiled"""


@query("sink_notes_jsonl", "SELECT count(*) AS lines, count(*) FILTER (effective_to IS NULL) AS open_ended_kept_null FROM compiled")
def _(spark, sf):
    path = files.sink_notes_jsonl(compiled_of(spark, sf), scratch_path(spark, "notes-jsonl"))
    return spark.read.text(path).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("value").contains('"effective_to":null')).alias("open_ended_kept_null"))


@query("scan_notes_jsonl", _COMPILED)
def _(spark, sf):
    path = files.sink_notes_jsonl(compiled_of(spark, sf), scratch_path(spark, "notes-jsonl"))
    return files.scan_notes_jsonl(spark, path)


def _audit_json(spark, sf):
    """The factorised audit, written and read back strictly: results per candidate, notes, memberships of the candidates."""
    a = run(spark, sf)
    tables = fa.audit_tables(a.candidates, a.notes, a.decisions, a.evidence_policy)
    path = fa.write_audit(scratch_path(spark, "evidence-jsonl"), tables)
    return {k: files.scan_audit_jsonl(spark, f"{path}/{k}", table) for k, (table, _) in tables.items()}


@query("sink_evidence_jsonl", f"SELECT {K}, count(*) AS assessed, min(note_id) AS first_note FROM gated GROUP BY ALL")
def _(spark, sf):
    return _audit_json(spark, sf)["candidates"].groupBy(*KEY).agg(
        F.sum("notes").alias("assessed"), F.min("first_note_id").alias("first_note"))


@query("scan_audit_jsonl", """
SELECT evidence_level, CASE WHEN evidence_level = 'partial' THEN 'supporting' WHEN s.note_id IS NOT NULL THEN 'primary'
  ELSE 'rejected' END AS role, count(*) AS pairs FROM gated g
LEFT JOIN (SELECT route, week_of, selected_note_id AS note_id FROM picked) s USING (route, week_of, note_id) GROUP BY ALL""")
def _(spark, sf):
    rows = _audit_json(spark, sf)["candidates"]
    primary = F.when((F.col("evidence_level") == "full") & F.col("selected_note_id").isNotNull(), 1).otherwise(0)
    per = rows.select("evidence_level", "notes", primary.alias("primary"), *KEY)
    # of the full notes of a justified candidate one is selected
    first = per.where("evidence_level = 'full'").groupBy(*KEY).agg(F.max("primary").alias("primary"), F.sum("notes").alias("notes"))
    full = first.select(F.lit("full").alias("evidence_level"), F.inline(F.array(
        F.struct(F.lit("primary").alias("role"), F.col("primary").cast("long").alias("notes")),
        F.struct(F.lit("rejected").alias("role"), (F.col("notes") - F.col("primary")).alias("notes")))))
    rest = per.where("evidence_level <> 'full'").select(
        "evidence_level", F.when(F.col("evidence_level") == "partial", "supporting").otherwise("rejected").alias("role"), "notes")
    return rest.unionByName(full.select("evidence_level", "role", "notes")).groupBy("evidence_level", "role").agg(
        F.sum("notes").alias("pairs")).where("pairs > 0")


@query("audit_of_candidate", f"""
SELECT {K}, note_id, evidence_level, overlap_days, rejection_codes FROM gated
WHERE (route, route_type, week_of) IN (SELECT (route, route_type, week_of) FROM (SELECT {K} FROM gated ORDER BY {K} LIMIT 1) t)""")
def _(spark, sf):
    # the pairs of one named candidate, spelled out from the notes and memberships that were written
    audit = _audit_json(spark, sf)
    named = audit["members"].join(audit["candidates"].select(*KEY).orderBy(*KEY).limit(1), list(KEY), "left_semi")
    return fa.audit_pairs(fa.audit_memberships(audit["notes"]), named).select(*KEY, "note_id", "evidence_level", "overlap_days", "rejection_codes")


@query("sink_explanation_jsonl", """
SELECT count(*) AS lines, count(*) FILTER (selected_note_id IS NULL) AS selected_null,
  count(*) AS cost_as_text FROM decisions""")
def _(spark, sf):
    path = files.sink_explanation_jsonl(ex.explanation_audit(run(spark, sf).records), scratch_path(spark, "audit"))
    has = lambda t: F.count_if(F.col("value").contains(t))
    return spark.read.text(path).agg(
        F.count(F.lit(1)).alias("lines"), has('"selected_note_id":null').alias("selected_null"),
        has('"estimated_cost_usd":"0').alias("cost_as_text"))


@query("sink_root_cause_json", """
SELECT '1.0' AS schema_version, c.route || '|' || c.week_of::VARCHAR AS candidate_key, count(DISTINCT ref_week) AS references_n
FROM refs c GROUP BY ALL""")
def _(spark, sf):
    analyses = run_categories(spark, sf).analyses
    path = files.sink_root_cause_json(analyses, scratch_path(spark, "root-cause"))
    back = spark.read.text(path).select(F.from_json("value", T.StructType([
        T.StructField("schema_version", T.StringType()), T.StructField("analysis", analyses.schema)])).alias("d"))
    return back.select("d.schema_version", "d.analysis.candidate_key",
                       F.size("d.analysis.reference_weeks").alias("references_n"))


# Each side lacks the rows of some days; all others must come back from the files as they were.
@query("roundtrip_check", """
SELECT count(*) FILTER (day(week_of::DATE) % 5 = 0 AND day(week_of::DATE) % 7 <> 0) AS only_left,
  count(*) FILTER (day(week_of::DATE) % 7 = 0 AND day(week_of::DATE) % 5 <> 0) AS only_right FROM reviewed""")
def _(spark, sf):
    final = cut_lineage(run(spark, sf).final)
    path = files.sink_contract_csv(final, scratch_path(spark, "final"))
    back = files.contract_lines(spark, path).where(F.col("route") != "route").select(*OUTPUT_COLUMNS)
    day = F.dayofmonth(F.to_date("week_of"))
    return files.roundtrip_check(final.where(day % 7 != 0), back.where(day % 5 != 0))


@query("dataset_fingerprint", """
SELECT count(*) AS rows, bit_xor(d) AS xor_digest, sum(d::DECIMAL(38,0))::VARCHAR AS sum_digest FROM (
  SELECT ('0x' || substr(sha256(concat_ws(chr(31), o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_totalprice::VARCHAR, o_orderdate::VARCHAR, o_orderpriority)), 1, 15))::BIGINT AS d
  FROM orders) t""")
def _(spark, sf):
    return files.dataset_fingerprint(w.table(spark, sf, "orders"))


# --- projection ---------------------------------------------------------------------

@query("normalize_shipments", _ship_sql("NULL"))
def _(spark, sf):
    return _finite_only(nm.normalize_shipments(w.raw_text_rows(spark, sf)))


@query("normalize_notes", "SELECT note_id, date, applies_to, note FROM notes_raw")
def _(spark, sf):
    notes = w.context_notes(spark, sf)
    padded = notes.withColumns({c_: F.concat(F.lit(" "), c_, F.lit("\t")) for c_ in ("note_id", "applies_to")})
    return nm.normalize_notes(padded.withColumn("date", F.col("date").cast("string")))


@query("percent_deviation", f"""
SELECT {K}, {r('own_pct', 'vs_own_history_pct')}, {r('peer_pct', 'vs_similar_routes_pct')} FROM metrics""")
def _(spark, sf):
    return c.percent_deviation(baselines_of(spark, sf)).select(*KEY, "vs_own_history_pct", "vs_similar_routes_pct")


@query("candidate_trigger", f"""
SELECT {K}, CASE WHEN own_hit AND peer_hit THEN 'both' WHEN own_hit THEN 'own_history' ELSE 'peer' END AS trigger FROM cand""")
def _(spark, sf):
    return c.candidates_only(metrics_of(spark, sf)).select(*KEY, c.candidate_trigger().alias("trigger"))


@query("contract_display", """
SELECT route, week_of::VARCHAR AS week_of, cost_text AS cost_per_tonne_km, own_text AS vs_own_history,
  coalesce(peer_text, 'Not available: no other same-type routes this week') AS vs_similar_routes, 'Yes' AS flagged,
  '' AS matched_note_id, 'Context review pending. Cost rise is currently flagged for review.' AS reason FROM displayed""")
def _(spark, sf):
    return c.contract_display(metrics_of(spark, sf))


@query("gate_results_view", f"""
SELECT gate, status, reason_code, count(*) AS pairs FROM (
  SELECT unnest(['route', 'date', 'direction', 'cost_impact', 'scope']) AS gate,
    unnest(['pass', 'pass', CASE WHEN impact_direction = 'increase' THEN 'pass' ELSE 'fail' END,
      CASE WHEN cost_ok THEN 'pass' ELSE 'fail' END, CASE WHEN scope_status = 'in_dataset' THEN 'pass' ELSE 'fail' END]) AS status,
    unnest([NULL, NULL, CASE WHEN impact_direction <> 'increase' THEN 'impact_direction_not_increase' END,
      CASE WHEN NOT cost_ok THEN 'cost_impact_not_positive' WHEN negates_cost_increase THEN 'cost_increase_negated' END,
      CASE WHEN scope_status <> 'in_dataset' THEN 'scope_outside_dataset' WHEN hard AND cover = 'premium' THEN 'global_scope_cannot_explain_peer_premium'
           WHEN hard AND cover = 'small' THEN 'global_magnitude_insufficient' END]) AS reason_code FROM gated) t GROUP BY ALL""")
def _(spark, sf):
    a = run(spark, sf)
    counts = fa.assessed_counts(a.candidates, a.notes, a.evidence_policy)
    return counts.select("pairs", F.inline(ev.gate_results())).groupBy("gate", "status", "reason_code").agg(F.sum("pairs").alias("pairs"))


@query("candidate_key", "SELECT route || '|' || week_of::VARCHAR AS candidate_key FROM cand")
def _(spark, sf):
    return c.candidates_only(metrics_of(spark, sf)).select(
        c.candidate_key(F.col("route"), F.col("week_of")).alias("candidate_key"))


# --- data quality -------------------------------------------------------------------

@query("dq_text", _issues("code IN ('missing_value', 'blank_value') AND \"column\" IN ('shipment_id', 'origin', 'destination', 'route_type', 'material', 'transporter')"))
def _(spark, sf):
    return dq.dq_text(w.raw_text_rows(spark, sf), SHIPMENT_TEXT_COLUMNS, "shipments")


@query("dq_identifier", _issues("code = 'duplicate_identifier'"))
def _(spark, sf):
    return dq.dq_identifier(w.raw_text_rows(spark, sf), "shipment_id", "shipments")


@query("dq_numeric", _issues("\"column\" IN ('quantity_tonnes', 'distance_km', 'freight_cost_inr')"))
def _(spark, sf):
    return dq.dq_numeric(w.raw_text_rows(spark, sf), SHIPMENT_NUMERIC_COLUMNS, "shipments")


@query("dq_date", _issues("\"column\" = 'shipment_date'"))
def _(spark, sf):
    return dq.dq_date(w.raw_text_rows(spark, sf), "shipment_date", "shipments")


@query("dq_domain", _issues("code = 'invalid_route_type'"))
def _(spark, sf):
    return dq.dq_domain(w.raw_text_rows(spark, sf))


@query("dq_derived_finite", _issues("\"column\" = 'tonne_km'"))
def _(spark, sf):
    return dq.dq_derived_finite(w.raw_text_rows(spark, sf))


@query("dq_empty", """
SELECT 'error' AS severity, 'empty_dataset' AS code, 'never' AS dataset, NULL::VARCHAR AS "column", NULL::BIGINT AS row_number
FROM orders WHERE o_orderpriority = 'none' UNION ALL
SELECT 'error', 'empty_dataset', 'filtered', NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = 'none')""")
def _(spark, sf):
    rows = w.raw_text_rows(spark, sf)
    return dq.dq_empty(rows, "shipments").unionByName(dq.dq_empty(rows.where("material = 'none'"), "filtered"))


@query("dq_report", f"""
SELECT 'shipments' AS dataset, (SELECT count(*) FROM raw_rows) AS row_count, count(*) AS errors, 0::BIGINT AS warnings, count(*) = 0 AS is_valid
FROM ({_ISSUES}) a UNION ALL SELECT 'context_notes', (SELECT count(*) FROM events), 0, 0, true""")
def _(spark, sf):
    raw, notes = w.raw_text_rows(spark, sf), w.context_notes(spark, sf)
    rows = lambda df, name: df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("dataset"), "row_count")
    return dq.dq_report(dq.shipment_issues(raw), rows(raw, "shipments").unionByName(rows(notes, "context_notes")))


def _verdicts(counts: dict[str, str], table: str) -> str:
    """Check rows from (check_id: failure count), all over one table."""
    rows = " UNION ALL ".join(f"SELECT '{i}' AS check_id, ({n})::BIGINT AS failures FROM {table}" for i, n in counts.items())
    return f"SELECT check_id, failures, CASE WHEN failures = 0 THEN 'pass' ELSE 'fail' END AS status FROM ({rows}) c"


def _when(every: int, value, column: str):
    """``value`` on the days of the month that ``every`` divides, else the column."""
    return F.when(F.col("_day") % every == 0, value).otherwise(F.col(column))


# Shipments of which some days have no id or route, a shifted week, no cost or another tonne-kilometre.
_BROKEN_SHIPMENTS = """(SELECT CASE WHEN d % 17 = 0 THEN ' ' ELSE shipment_id END AS shipment_id, CASE WHEN d % 5 = 0 THEN ' ' ELSE route END AS route,
  CASE WHEN d % 7 = 0 THEN week_of + 1 ELSE week_of END AS week_of, CASE WHEN d % 11 = 0 THEN 0 ELSE freight_cost_inr END AS freight_cost_inr,
  quantity_tonnes * distance_km AS product, CASE WHEN d % 13 = 0 THEN 2 * tonne_km ELSE tonne_km END AS tonne_km
  FROM (SELECT *, day(shipment_date) AS d FROM shipments) s) b"""


@query("analytics_input_check", _verdicts({
    "id_present": "count(*) FILTER (trim(shipment_id) = '')", "key_present": "count(*) FILTER (trim(route) = '')",
    "monday_week": "count(*) FILTER (isodow(week_of) <> 1)", "positive_finite": "count(*) FILTER (freight_cost_inr <= 0)",
    "tonne_km_consistent": "count(*) FILTER (tonne_km <> product)", "id_unique": "count(*) - count(DISTINCT trim(shipment_id))"}, _BROKEN_SHIPMENTS))
def _(spark, sf):
    broken = w.shipments(spark, sf).withColumn("_day", F.dayofmonth("shipment_date")).withColumns({
        "shipment_id": _when(17, " ", "shipment_id"), "route": _when(5, " ", "route"), "week_of": _when(7, F.date_add("week_of", 1), "week_of"),
        "freight_cost_inr": _when(11, 0, "freight_cost_inr"), "tonne_km": _when(13, 2 * F.col("tonne_km"), "tonne_km")})
    return dq.analytics_input_check(broken.drop("_day"))


# Weekly rows of which some days have a blank route, a shifted week, no shipment or another rate.
_BROKEN_WEEKLY = """(SELECT CASE WHEN day(week_of) % 5 = 0 THEN ' ' ELSE route END AS route, route_type,
  CASE WHEN day(week_of) % 7 = 0 THEN week_of + 1 ELSE week_of END AS week_of, CASE WHEN day(week_of) % 11 = 0 THEN 0 ELSE shipment_count END AS shipment_count,
  total_freight_cost_inr, total_tonne_km, CASE WHEN day(week_of) % 13 = 0 THEN -cost_per_tonne_km ELSE cost_per_tonne_km END AS cost_per_tonne_km FROM weekly) b"""


@query("baseline_input_check", _verdicts({
    "key_present": "count(*) FILTER (trim(route) = '')", "monday_week": "count(*) FILTER (isodow(week_of) <> 1)",
    "shipments_present": "count(*) FILTER (shipment_count = 0)", "positive_finite": "count(*) FILTER (cost_per_tonne_km <= 0)",
    "rate_formula": "count(*) FILTER (abs(cost_per_tonne_km * total_tonne_km - total_freight_cost_inr) > 1e-9 * total_freight_cost_inr)",
    "unique_key": "count(*) - count(DISTINCT (route, route_type, week_of))"}, _BROKEN_WEEKLY))
def _(spark, sf):
    day, col = F.dayofmonth("week_of"), F.col
    broken = weekly_of(spark, sf).select("*", day.alias("day")).withColumns({
        "route": F.when(col("day") % 5 == 0, " ").otherwise(col("route")),
        "week_of": F.when(col("day") % 7 == 0, F.date_add("week_of", 1)).otherwise(col("week_of")),
        "shipment_count": F.when(col("day") % 11 == 0, 0).otherwise(col("shipment_count")),
        "cost_per_tonne_km": F.when(col("day") % 13 == 0, -col("cost_per_tonne_km")).otherwise(col("cost_per_tonne_km"))}).drop("day")
    return dq.baseline_input_check(broken)


# Baselines with wrong signs, counts out of range, a missing peer and repeated keys on some days.
_BROKEN_BASELINES = """(SELECT route, route_type, week_of, CASE WHEN d % 13 = 0 THEN -cost_per_tonne_km ELSE cost_per_tonne_km END AS rate,
  CASE WHEN d % 5 = 0 THEN -own ELSE own END AS own, CASE WHEN d % 7 = 0 THEN NULL WHEN d % 3 = 0 THEN -peer ELSE peer END AS peer,
  CASE WHEN d % 11 = 0 THEN 9 ELSE history_weeks_used END AS n, CASE WHEN d % 17 = 0 THEN -1 ELSE peer_routes_used END AS p
  FROM (SELECT *, day(week_of) AS d FROM baselines UNION ALL SELECT *, day(week_of) FROM baselines WHERE day(week_of) % 19 = 0) s) b"""


@query("comparison_input_check", _verdicts({
    "rate_positive": "count(*) FILTER (rate <= 0)", "own_baseline_positive": "count(*) FILTER (own <= 0)",
    "peer_baseline_positive": "count(*) FILTER (peer <= 0)", "history_count_range": "count(*) FILTER (n NOT BETWEEN 0 AND 8)",
    "peer_count_range": "count(*) FILTER (p < 0)", "own_availability": "count(*) FILTER ((own IS NULL) <> (n = 0))",
    "peer_availability": "count(*) FILTER ((peer IS NULL) <> (p = 0))",
    "unique_key": "count(*) - count(DISTINCT (route, route_type, week_of))"}, _BROKEN_BASELINES))
def _(spark, sf):
    own, peer = "own_history_avg_cost_per_tonne_km", "similar_routes_avg_cost_per_tonne_km"
    sound = cut_lineage(baselines_of(spark, sf))
    twice = sound.unionByName(sound.where(F.dayofmonth("week_of") % 19 == 0)).withColumn("_day", F.dayofmonth("week_of"))
    broken = twice.withColumns({
        "cost_per_tonne_km": _when(13, -F.col("cost_per_tonne_km"), "cost_per_tonne_km"), own: _when(5, -F.col(own), own),
        peer: F.when(F.col("_day") % 7 == 0, None).when(F.col("_day") % 3 == 0, -F.col(peer)).otherwise(F.col(peer)),
        "history_weeks_used": _when(11, 9, "history_weeks_used"), "peer_routes_used": _when(17, -1, "peer_routes_used")})
    return dq.comparison_input_check(broken.drop("_day"))


@query("candidate_rule", f"""
SELECT {K}, {r('cost_per_tonne_km', 'cost_per_tonne_km')}, is_rising, own_hit AS own_threshold_breached,
  peer_hit AS peer_threshold_breached, candidate AS candidate_anomaly FROM metrics""")
def _(spark, sf):
    return metrics_of(spark, sf).select(*KEY, "cost_per_tonne_km", "is_rising", "own_threshold_breached",
                                        "peer_threshold_breached", "candidate_anomaly")


_BROKEN_COMPARISONS = """(SELECT route, route_type, week_of, own, peer, CASE WHEN d % 5 = 0 THEN NULL WHEN d % 3 = 0 THEN 'inf'::DOUBLE ELSE own_pct END AS own_pct,
  CASE WHEN d % 7 = 0 THEN 'nan'::DOUBLE WHEN d % 11 = 0 THEN 1.0 ELSE peer_pct END AS peer_pct
  FROM (SELECT *, day(week_of) AS d FROM metrics UNION ALL SELECT *, day(week_of) FROM metrics WHERE day(week_of) % 19 = 0) s) b"""


@query("candidate_input_check", _verdicts({
    "own_availability": "count(*) FILTER ((own_pct IS NULL) <> (own IS NULL))", "peer_availability": "count(*) FILTER ((peer_pct IS NULL) <> (peer IS NULL))",
    "own_finite": "count(*) FILTER (NOT isfinite(own_pct))", "peer_finite": "count(*) FILTER (NOT isfinite(peer_pct))",
    "unique_key": "count(*) - count(DISTINCT (route, route_type, week_of))"}, _BROKEN_COMPARISONS))
def _(spark, sf):
    sound = cut_lineage(c.percent_deviation(baselines_of(spark, sf)))
    twice = sound.unionByName(sound.where(F.dayofmonth("week_of") % 19 == 0)).withColumn("_day", F.dayofmonth("week_of"))
    day = F.col("_day")
    broken = twice.withColumns({
        "vs_own_history_pct": F.when(day % 5 == 0, None).when(day % 3 == 0, float("inf")).otherwise(F.col("vs_own_history_pct")),
        "vs_similar_routes_pct": F.when(day % 7 == 0, float("nan")).when(day % 11 == 0, 1.0).otherwise(F.col("vs_similar_routes_pct"))})
    return dq.candidate_input_check(broken.drop("_day"))


_BROKEN_NOTES = """(SELECT CASE WHEN d % 5 = 0 THEN ' ' || note_id WHEN d % 3 = 0 THEN 'N-COPY' ELSE note_id END AS note_id,
  CASE WHEN d % 7 = 0 THEN '' ELSE applies_to END AS applies_to, CASE WHEN d % 11 = 0 THEN NULL ELSE date END AS date,
  CASE WHEN d % 13 = 0 THEN ' ' ELSE note END AS note FROM (SELECT *, day(date::DATE) AS d FROM notes_raw) s) b"""


@query("notes_input_check", _verdicts({
    "text_present": "count(*) FILTER (trim(note_id) = '' OR trim(applies_to) = '' OR trim(note) = '')",
    "trimmed": "count(*) FILTER (note_id <> trim(note_id) OR applies_to <> trim(applies_to))", "date_present": "count(*) FILTER (date IS NULL)",
    "notes_present": "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END", "routes_usable": "0 * count(*) + (SELECT count(DISTINCT route) FROM weekly WHERE route LIKE 'A%')",
    "routes_present": "0 * count(*)", "id_unique": "count(*) - count(DISTINCT note_id)"}, _BROKEN_NOTES))
def _(spark, sf):
    notes = w.context_notes(spark, sf).withColumn("_day", F.dayofmonth(F.col("date").cast("date")))
    broken = notes.withColumns({
        "note_id": F.when(F.col("_day") % 5 == 0, F.concat(F.lit(" "), "note_id")).when(F.col("_day") % 3 == 0, "N-COPY").otherwise(F.col("note_id")),
        "applies_to": _when(7, "", "applies_to"), "date": _when(11, None, "date"), "note": _when(13, " ", "note")}).drop("_day")
    routes = w.shipments(spark, sf).select("route").distinct()
    spaced = routes.select(F.when(F.col("route").startswith("A"), F.concat("route", F.lit(" "))).otherwise(F.col("route")).alias("route"))
    return dq.notes_input_check(broken, spaced)


# claims of some days end before they begin
@query("compiled_claim_check", """
SELECT count(*) AS notes, count(*) FILTER (compile_error IS NOT NULL) AS not_compiled,
  count(*) FILTER (compile_error IS NULL AND day(effective_from) % 5 = 0) AS inconsistent,
  count(*) FILTER (compile_error IS NULL AND day(effective_from) % 5 = 0) AS gate_inconsistent FROM compiled""")
def _(spark, sf):
    compiled = compiled_of(spark, sf)
    late = F.when(F.dayofmonth("effective_from") % 5 == 0, F.date_sub("effective_from", 1)).otherwise(F.col("effective_to"))
    return nt.compiled_claim_check(compiled.withColumn("effective_to", late))


# some justified decisions are given out as unexplained, some selected notes and counts are changed
@query("packet_authority_check", """
SELECT 0::BIGINT AS packet_without_decision, count(*) FILTER (verdict = 'justified' AND d % 5 <> 0 AND d % 7 = 0) AS justified_shape, 0::BIGINT AS partial_shape,
  count(*) FILTER (verdict = 'justified' AND d % 5 = 0) AS unexplained_shape, count(*) FILTER (d % 3 = 0) AS supporting_matches
FROM (SELECT *, day(week_of) AS d FROM decisions) x""")
def _(spark, sf):
    a = run(spark, sf)
    broken = a.decisions.withColumn("_day", F.dayofmonth("week_of")).withColumns({
        "verdict": F.when((F.col("_day") % 5 == 0) & (F.col("verdict") == "justified"), "unexplained").otherwise(F.col("verdict")),
        "selected_note_id": F.when((F.col("_day") % 7 == 0) & (F.col("verdict") == "justified"), "N-OTHER").otherwise(F.col("selected_note_id")),
        "supporting_note_count": F.when(F.col("_day") % 3 == 0, F.col("supporting_note_count") + 1).otherwise(F.col("supporting_note_count"))})
    return ev.packet_authority_check(broken.drop("_day"), a.packets)


@query("output_contract_checks", passing(*[f"output.{x}" for x in rp.CHECKS],
                                         extra=", 'output' AS variant, 0::BIGINT AS failures, 'pass' AS status"))
def _(spark, sf):
    final = cut_lineage(run(spark, sf).final)
    lines = files.contract_lines(spark, files.sink_contract_csv(final, scratch_path(spark, "final")))
    rows, headers = files.output_rows(lines)
    return rp.output_contract_checks(rows, final, headers)


# --- joins --------------------------------------------------------------------------

@query("structured_recall", f"SELECT {K}, note_id, overlap_days FROM pairs")
def _(spark, sf):
    return run(spark, sf).recalled


@query("structured_recall_of_notes", """
SELECT note_id, count(*) AS candidates, sum(overlap_days)::BIGINT AS overlap_days FROM pairs GROUP BY ALL""")
def _(spark, sf):
    a = run(spark, sf)
    return fa.links_of_notes(a.candidates, a.notes)


@query("recall_classes", "SELECT count(*) AS links FROM pairs")
def _(spark, sf):
    a = run(spark, sf)
    return fa.class_rows(a.candidates, a.notes).agg(F.coalesce(F.sum("links"), F.lit(0)).alias("links"))


def _item_hits(spark, sf):
    """Top documents per benchmark item by text and by vector (ids shared by both tables)."""
    items, docs = w.table(spark, sf, "benchmark"), w.table(spark, sf, "documents")
    vectors = w.table(spark, sf, "embeddings")
    sparse = rt.tfidf_sparse(items, docs, ("item_id", "text"), ("doc_id", "text"), SCORES)
    dense = rt.dense_cosine(
        vectors.join(items, F.col("vec_id") == F.col("item_id"), "left_semi"),
        vectors.join(docs, F.col("vec_id") == F.col("doc_id"), "left_semi"),
        ("vec_id", "embedding"), ("vec_id", "embedding"), SCORES)
    return sparse, dense


@query("recall_union_hits", """
SELECT included_by_structured_recall, retrieved, count(*) AS hits FROM (
  SELECT r.id IS NOT NULL AS included_by_structured_recall, f.query_id IS NOT NULL AS retrieved
  FROM fused f FULL JOIN (SELECT item_id AS id, doc_id AS did FROM benchmark JOIN labels ON quality = 1 AND doc_id % 40 = item_id % 40) r
    ON f.query_id = r.id AND f.doc_id = r.did) u GROUP BY ALL""")
def _(spark, sf):
    hits = rt.rank_fusion(*_item_hits(spark, sf), SCORES)
    items, labels = w.table(spark, sf, "benchmark"), w.table(spark, sf, "labels")
    recalled = items.withColumn("bucket", F.col("item_id") % 40).join(
        labels.where("quality = 1").withColumn("bucket", F.col("doc_id") % 40), "bucket")
    # the operator's key is (route, route_type, week_of, note_id): items take the route's place
    as_key = lambda df, q_: df.withColumns({
        "route": F.col(q_).cast("string"), "route_type": F.lit("item"), "week_of": F.lit(dt.date(2024, 1, 1)),
        "note_id": F.col("doc_id").cast("string")})
    union = ev.recall_union_hits(as_key(hits, "query_id").select(*KEY, "note_id", "fused_rank"),
                                 as_key(recalled, "item_id").select(*KEY, "note_id"))
    return union.groupBy("included_by_structured_recall", F.col("fused_rank").isNotNull().alias("retrieved")).agg(
        F.count(F.lit(1)).alias("hits"))


@query("rank_fusion", "SELECT query_id, doc_id, sparse_rank, dense_rank, " + r('fused_score', 'fused_score') + ", fused_rank FROM fused")
def _(spark, sf):
    return rt.rank_fusion(*_item_hits(spark, sf), SCORES).select(
        "query_id", "doc_id", "sparse_rank", "dense_rank", "fused_score", "fused_rank")


@query("fused_rank", "SELECT query_id, doc_id, fused_rank FROM fused")
def _(spark, sf):
    return rt.rank_fusion(*_item_hits(spark, sf), SCORES).select("query_id", "doc_id", "fused_rank")


@query("query_note_cross", f"""
SELECT query_id, count(*) AS scored, count(*) FILTER (score = 0) AS zero_scores, {r('max(score)', 'best_score')}
FROM sparse_scores GROUP BY query_id""")
def _(spark, sf):
    return rt.query_note_cross(w.table(spark, sf, "benchmark"), w.table(spark, sf, "documents"),
                               ("item_id", "text"), ("doc_id", "text"), SCORES)


@query("note_in_dataset", "SELECT note_id, applies_to, applies_to IN (SELECT route FROM weekly) AS route_known FROM notes_raw")
def _(spark, sf):
    return nt.note_in_dataset(w.context_notes(spark, sf), w.shipments(spark, sf).select("route").distinct()).select(
        "note_id", "applies_to", "route_known")


@query("packet_notes", f"SELECT {K}, note_id, role, event_type, magnitude_text FROM packet_facts")
def _(spark, sf):
    return run(spark, sf).packets.select(*KEY, "note_id", "role", "event_type", "magnitude_text")


@query("review_output", _FINAL.replace("reason FROM", "review_reason AS reason FROM"))
def _(spark, sf):
    return run(spark, sf).reviewed.select(*OUTPUT_COLUMNS)


@query("final_output", _FINAL)
def _(spark, sf):
    return run(spark, sf).final


@query("unexplained_candidates", f"SELECT {K}, {r('own_pct', 'vs_own_history_pct')} FROM open_cases")
def _(spark, sf):
    return run(spark, sf).unexplained.select(*KEY, "vs_own_history_pct")


@query("reference_week_join", f"SELECT {K}, ref_week FROM refs")
def _(spark, sf):
    return run(spark, sf).references


@query("category_full_outer", f"""
SELECT lens, CASE WHEN now_n IS NULL THEN 'exit' WHEN past_n IS NULL THEN 'entry' ELSE 'both' END AS side, count(*) AS rows,
  {r('sum(now_share)', 'now_share')}, {r('sum(past_share)', 'past_share')} FROM sides GROUP BY ALL""")
def _(spark, sf):
    a = run_categories(spark, sf)
    side = F.when(F.col("now").isNull(), "exit").when(F.col("past").isNull(), "entry").otherwise("both")
    return rc.category_full_outer(a.references, a.shares).groupBy("lens", side.alias("side")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("now.share").alias("now_share"), F.sum("past.share").alias("past_share"))


@query("anomaly_view_join", f"""
SELECT v.candidate_key, v.trigger, v.verdict, v.reason, coalesce(n, 0) AS evidence_n, coalesce(n_primary, 0) AS primary_n
FROM viewed v LEFT JOIN (SELECT {K}, count(*) AS n FROM gated GROUP BY ALL) g USING (route, route_type, week_of)
LEFT JOIN (SELECT {K}, 1 AS n_primary FROM picked) s USING (route, route_type, week_of)""")
def _(spark, sf):
    a = run(spark, sf)
    return rd.anomaly_view_join(a.view, a.evidence_rows).groupBy(
        *KEY, "candidate_key", "trigger", "verdict", "reason").agg(
        F.count("note_id").alias("evidence_n"), F.count_if(F.col("role") == "primary").alias("primary_n")).drop(*KEY)


# Each side lacks the candidates of some days, so that both have rows without a counterpart.
@query("timeline_reconcile", f"""
SELECT {K}, CASE WHEN day(week_of) % 5 = 0 THEN 'left' ELSE 'right' END AS only_in FROM metrics
WHERE candidate AND (day(week_of) % 5 = 0) <> (day(week_of) % 7 = 0)""")
def _(spark, sf):
    a = run(spark, sf)
    day = F.dayofmonth("week_of")
    return rd.timeline_reconcile(
        rd.route_timeline(a.metrics, a.decisions).where(day % 7 != 0), a.view.where(day % 5 != 0))


# Expected labels for the quality measures: the decisions, with those of one week in
# seven relabelled as unexplained, so that the measures have something to find.
_LABELLED = f"""
SELECT {K}, CASE WHEN x THEN 'unexplained' ELSE verdict END AS verdict, CASE WHEN x THEN NULL ELSE selected_note_id END AS selected_note_id,
  CASE WHEN x THEN NULL ELSE first_supporting_note_id END AS first_supporting_note_id, CASE WHEN x THEN 0 ELSE supporting_note_count END AS supporting_note_count
FROM (SELECT *, day(week_of) % 7 = 0 AS x FROM decisions) l"""


def _labelled(decisions: DataFrame) -> DataFrame:
    x = F.dayofmonth("week_of") % 7 == 0
    blank = lambda n: F.when(~x, F.col(n)).alias(n)
    return decisions.select(
        *KEY, F.when(x, "unexplained").otherwise(F.col("verdict")).alias("verdict"), blank("selected_note_id"),
        blank("first_supporting_note_id"), F.when(x, 0).otherwise(F.col("supporting_note_count")).alias("supporting_note_count"))


_MATCH = ("e.verdict IS NOT DISTINCT FROM d.verdict AND e.selected_note_id IS NOT DISTINCT FROM d.selected_note_id AND "
          "e.first_supporting_note_id IS NOT DISTINCT FROM d.first_supporting_note_id AND e.supporting_note_count = d.supporting_note_count")


@query("golden_compare", f"""
SELECT e.verdict AS expected_verdict, d.verdict AS actual_verdict, {_MATCH} AS matches, count(*) AS candidates
FROM ({_LABELLED}) e JOIN decisions d USING (route, route_type, week_of) GROUP BY ALL""")
def _(spark, sf):
    d = run(spark, sf).decisions
    return ms.golden_compare(_labelled(d), d).groupBy("expected_verdict", "actual_verdict", "matches").agg(
        F.count(F.lit(1)).alias("candidates"))


def _stored_entries(keys: DataFrame, decisions: DataFrame) -> DataFrame:
    """A store that holds the justified requests, one kind twice and one kind damaged."""
    rows = keys.join(ex.template_reason(decisions), list(KEY)).where("verdict = 'justified'").select(
        "request_key", F.lit(ex.PROMPT_VERSION).alias("prompt_version"), "reason", "route")
    digest = F.sha2(F.concat_ws("|", "request_key", "prompt_version", "reason"), 256)
    stored = rows.withColumn("entry_sha256", F.when(F.col("route") == "ASIA-ASIA", "damaged").otherwise(digest))
    return stored.unionByName(stored.where("route = 'EUROPE-EUROPE'")).drop("route")


@query("cache_lookup", """
SELECT CASE WHEN verdict <> 'justified' THEN 'miss' WHEN route IN ('ASIA-ASIA', 'EUROPE-EUROPE') THEN 'invalid' ELSE 'hit' END AS cache_state,
  verdict = 'justified' AND route = 'EUROPE-EUROPE' AS duplicate_key, count(*) AS requests FROM decisions GROUP BY ALL""")
def _(spark, sf):
    a = run(spark, sf)
    keys = cut_lineage(a.request_keys)
    return ex.cache_lookup(keys, _stored_entries(keys, a.decisions)).groupBy("cache_state", "duplicate_key").agg(
        F.count(F.lit(1)).alias("requests"))


# --- aggregations -------------------------------------------------------------------

_WEEKLY = f"""
SELECT {K}, shipment_count, {r('total_freight_cost_inr', 'total_freight_cost_inr')}, {r('total_quantity_tonnes', 'total_quantity_tonnes')},
  {r('total_tonne_km', 'total_tonne_km')}, {r('cost_per_tonne_km', 'cost_per_tonne_km')} FROM weekly"""


@query("weekly_route_metrics", _WEEKLY)
def _(spark, sf):
    return weekly_of(spark, sf)


@query("independent_recompute", _WEEKLY)
def _(spark, sf):
    return wk.independent_recompute(spark, w.shipments(spark, sf))


# Against a weekly table in which some weeks are there twice and some rates are doubled.
@query("weekly_reconciliation", _verdicts({
    "shipment_count": "1", "total_freight_cost_inr": "1", "total_quantity_tonnes": "1", "total_tonne_km": "1",
    "unique_key": "n_twice", "rate_formula": "n_rate"}, """(SELECT count(*) FILTER (day(week_of) % 5 = 0) AS n_twice,
      count(*) FILTER (day(week_of) % 7 = 0) + count(*) FILTER (day(week_of) % 35 = 0) AS n_rate FROM weekly) b"""))
def _(spark, sf):
    shipments = w.shipments(spark, sf)
    day = F.dayofmonth("week_of")
    weekly = wk.weekly_route_metrics(shipments).withColumn(
        "cost_per_tonne_km", F.when(day % 7 == 0, 2 * F.col("cost_per_tonne_km")).otherwise(F.col("cost_per_tonne_km")))
    return wk.weekly_reconciliation(shipments, weekly.unionByName(weekly.where(day % 5 == 0)))


@query("weekly_summary", """
SELECT sum(shipment_count)::BIGINT AS shipments, count(*) AS route_weeks, count(DISTINCT route) AS routes,
  count(DISTINCT route_type) AS route_types, count(DISTINCT week_of) AS weeks, min(week_of) AS first_week, max(week_of) AS last_week FROM weekly""")
def _(spark, sf):
    return wk.weekly_summary(weekly_of(spark, sf))


@query("baseline_reconciliation", passing("history_count", "own_value", "own_availability", "peer_count", "peer_value",
                                          "peer_availability", "row_count"))
def _(spark, sf):
    weekly = cut_lineage(weekly_of(spark, sf))
    return b.baseline_reconciliation(weekly, b.add_baselines(weekly))


@query("baseline_summary", """
SELECT count(*) AS route_weeks, count(own) AS history_available, count(*) - count(own) AS history_unavailable,
  count(*) FILTER (history_weeks_used = 8) AS full_history, count(peer) AS peer_available, count(*) - count(peer) AS peer_unavailable,
  min(peer_routes_used) AS min_peers, max(peer_routes_used) AS max_peers FROM baselines""")
def _(spark, sf):
    return b.baseline_summary(baselines_of(spark, sf))


@query("history_count_histogram", """
SELECT 'history' AS kind, history_weeks_used AS used, count(*) AS route_weeks FROM baselines GROUP BY ALL
UNION ALL SELECT 'peer', peer_routes_used, count(*) FROM baselines GROUP BY ALL""")
def _(spark, sf):
    return b.history_count_histogram(baselines_of(spark, sf))


@query("trigger_counts", """
SELECT count(*) AS candidates, count(*) FILTER (own_hit) AS by_own, count(*) FILTER (peer_hit) AS by_peer,
  count(*) FILTER (own_hit AND peer_hit) AS by_both FROM cand""")
def _(spark, sf):
    return c.trigger_counts(c.candidates_only(metrics_of(spark, sf)))


@query("verdict_counts", "SELECT verdict, count(*) AS candidates FROM decisions GROUP BY verdict")
def _(spark, sf):
    return ev.verdict_counts(run(spark, sf).decisions)


@query("rejection_histogram", """
SELECT code AS rejection_code, count(*) AS pairs FROM (SELECT unnest(string_split(rejection_codes, ',')) AS code FROM gated) t
WHERE code <> '' GROUP BY code""")
def _(spark, sf):
    a = run(spark, sf)
    return fa.rejection_histogram(fa.assessed_counts(a.candidates, a.notes, a.evidence_policy))


@query("structured_additions")
def _(spark, sf):
    a = run(spark, sf)
    hits = cut_lineage(a.fused_hits())
    return ev.structured_additions(ev.recall_union_hits(hits, a.recalled))


@query("note_compile_counts", """
WITH_FACTS""".replace("WITH_FACTS", """
SELECT kind, value, count(*) AS notes FROM (
  SELECT 'scope_type' AS kind, scope_type AS value FROM compiled WHERE compile_error IS NULL
  UNION ALL SELECT 'cost_impact_status', cost_impact_status FROM compiled WHERE compile_error IS NULL
  UNION ALL SELECT 'interval', CASE WHEN effective_to IS NULL THEN 'open' ELSE 'bounded' END FROM compiled WHERE compile_error IS NULL
  UNION ALL SELECT 'warning', unnest(string_split(compilation_warnings, ',')) FROM compiled WHERE compile_error IS NULL AND compilation_warnings <> '') f
GROUP BY ALL"""))
def _(spark, sf):
    return nt.note_compile_counts(compiled_of(spark, sf))


_SUMMARY = """
SELECT (SELECT sum(shipment_count)::BIGINT FROM weekly) AS shipment_count, (SELECT count(DISTINCT route) FROM weekly) AS route_count,
  (SELECT count(DISTINCT route_type) FROM weekly) AS route_type_count, (SELECT count(*) FROM weekly) AS weekly_record_count,
  count(*) AS candidate_count, (SELECT min(week_of) FROM weekly) AS analysis_from, (SELECT max(week_of) FROM weekly) AS analysis_to,
  count(*) FILTER (verdict = 'justified') AS justified_count, count(*) FILTER (verdict = 'partially_explained') AS partially_explained_count,
  count(*) FILTER (verdict = 'unexplained') AS unexplained_count, true AS verdicts_add_up FROM decisions"""


@query("analysis_summary", _SUMMARY)
def _(spark, sf):
    a = run(spark, sf)
    return rd.analysis_summary(a.metrics, a.decisions)


@query("run_metrics", """
SELECT (SELECT sum(shipment_count)::BIGINT FROM weekly) AS shipments, (SELECT count(*) FROM weekly) AS weekly, count(*) AS candidates,
  (SELECT count(*) FROM compiled WHERE compile_error IS NULL) AS compiled_notes,
  count(*) FILTER (verdict = 'unexplained') AS root_cause_eligible, count(*) FILTER (verdict <> 'unexplained') AS explanation_request_count,
  0::BIGINT AS hosted_model_call_count, 0::BIGINT AS input_tokens, 0::BIGINT AS output_tokens, '0.000000000000' AS estimated_cost_usd,
  0::BIGINT AS cache_hits, 0::BIGINT AS cache_misses, 0::BIGINT AS fallback_count FROM decisions""")
def _(spark, sf):
    a = run(spark, sf)
    return rd.run_metrics(a.metrics, a.notes, a.decisions, a.records)


def _model_audits(spark, sf):
    """Conversation turns as the audit of a hosted run: one record per turn."""
    usage = ex.token_cost(w.token_usage(spark, sf), "2.50", "0.25", "10.00")
    failed = (F.col("turn") == 2) & (F.col("role") == "user")
    return usage.select(
        F.when(F.col("role") == "system", "unexplained").otherwise("justified").alias("verdict"),
        F.when(failed, "fallback").when(F.col("role") == "system", "cache").otherwise("model").alias("explanation_source"),
        F.lit("hosted").alias("provider"), F.concat(F.lit("model-"), "role").alias("model"),
        F.when(F.col("role") == "assistant", 1).otherwise(F.when(failed, 2).otherwise(0)).cast("bigint").alias("provider_attempts"),
        F.when(failed, F.array(F.lit("provider_timeout"))).otherwise(F.array().cast("array<string>")).alias("failure_codes"),
        (F.col("role") == "system").alias("cache_hit"), F.struct(*ex.USAGE).alias("usage"), "estimated_cost_usd",
        F.lit(dt.date(2026, 1, 1)).alias("pricing_snapshot_date"))


_COST = ("((input_tokens - cached_input_tokens)::DECIMAL(18,0) * 2.50::DECIMAL(9,2) + cached_input_tokens::DECIMAL(18,0) * 0.25::DECIMAL(9,2)"
         " + output_tokens::DECIMAL(18,0) * 10.00::DECIMAL(9,2))")


@query("usage_report", f"""
SELECT count(*) AS record_count, 'mixed' AS run_mode, 'hosted' AS model_provider_identity,
  (SELECT string_agg(m, ', ' ORDER BY m) FROM (SELECT DISTINCT 'model-' || role AS m FROM usage) t) AS model_identity,
  '2026-01-01' AS pricing_snapshot_date, count(*) FILTER (role <> 'system') AS eligible_requests,
  sum(CASE WHEN role = 'assistant' THEN 1 WHEN turn = 2 AND role = 'user' THEN 2 ELSE 0 END)::BIGINT AS provider_calls,
  sum(input_tokens)::BIGINT AS input_tokens, sum(cached_input_tokens)::BIGINT AS cached_input_tokens,
  sum(output_tokens)::BIGINT AS output_tokens, sum(reasoning_tokens)::BIGINT AS reasoning_tokens,
  count(*) FILTER (turn = 2 AND role = 'user') AS failed_or_refused_calls, count(*) FILTER (role = 'system') AS cache_hits,
  count(*) FILTER (role = 'assistant' OR (turn = 2 AND role = 'user')) AS cache_misses,
  count(*) FILTER (turn = 2 AND role = 'user') AS fallback_count,
  printf('%.6f', round(sum({_COST})::DECIMAL(36,2)::DOUBLE / 1000000, 6)) AS estimated_total_cost_usd, 'USD' AS currency,
  'Configured model rates and pricing snapshot date.' AS cost_basis FROM usage""")
def _(spark, sf):
    return ex.usage_report(_model_audits(spark, sf))


@query("token_cost", f"""
SELECT conv_id, turn, role, {r(f'({_COST})::DOUBLE / 1000000', 'estimated_cost_usd')} FROM usage""")
def _(spark, sf):
    return ex.token_cost(w.token_usage(spark, sf), "2.50", "0.25", "10.00").select(
        "conv_id", "turn", "role", F.col("estimated_cost_usd").cast("double").alias("estimated_cost_usd"))


@query("category_shares", f"""
SELECT {K}, lens, category, shipments, {r('tk', 'tonne_km')}, {r('fr', 'freight_cost_inr')}, {r('share', 'share')}, {r('rate', 'rate')} FROM shares""")
def _(spark, sf):
    return rc.category_shares(w.shipments(spark, sf))


@query("operational_metrics", f"SELECT {K}, metric, {r('value', 'value')} FROM opmetrics")
def _(spark, sf):
    return rc.operational_metrics(weekly_of(spark, sf))


@query("metric_comparison", f"""
SELECT {K}, metric, {r('value', 'current_value')}, {r('past', 'reference_mean')}, {r('change', 'absolute_change')},
  {r('pct', 'percentage_change')}, coalesce(abs(pct) >= 10, false) AS highlighted FROM compared""")
def _(spark, sf):
    a = run(spark, sf)
    return rc.metric_comparison(a.references, a.weekly).drop("unit", "interpretation")


@query("retrieval_metrics", f"""
SELECT count(*) AS labelled_queries, {r('avg(a / n)', 'recall_at_1')}, {r('avg(b / n)', 'recall_at_3')}, {r('avg(c / n)', 'recall_at_5')},
  {r('avg(coalesce(1.0::DOUBLE / f, 0))', 'mean_reciprocal_rank')} FROM (
  SELECT u.vec_id, n, count(t.rank) FILTER (t.rank <= 1) AS a, count(t.rank) FILTER (t.rank <= 3) AS b, count(t.rank) FILTER (t.rank <= 5) AS c, min(t.rank) AS f
  FROM embeddings u JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) s USING (label)
  LEFT JOIN dense_top t ON t.query_id = u.vec_id AND t.relevant GROUP BY ALL) q""")
def _(spark, sf):
    vectors = w.table(spark, sf, "embeddings")
    hits = rt.dense_cosine(vectors, vectors, ("vec_id", "embedding"), ("vec_id", "embedding"), SCORES)
    side = lambda p_: vectors.select(F.col("vec_id").alias(f"{p_}_id"), F.col("label").alias(f"{p_}_label"))
    # a document is relevant when it has the query's label: counted, never paired
    found = hits.join(side("query"), "query_id").join(side("doc"), "doc_id").where("query_label = doc_label")
    sizes = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("relevant"))
    totals = vectors.join(sizes, "label").select(F.col("vec_id").alias("query_id"), "relevant")
    return rt.metrics_from_found(found, totals)


@query("structured_union_recall", f"""
SELECT count(*) AS labelled, count(*) FILTER (hit) AS covered, {r('coalesce(count(*) FILTER (hit)::DOUBLE / nullif(count(*), 0), 0)', 'recall')}
FROM (SELECT {K}, bool_or(reached) AS hit FROM (
  SELECT c.route, c.route_type, c.week_of, p.note_id IS NOT NULL AS reached
  FROM cand c JOIN notes_raw n ON n.applies_to = c.route AND n.date::DATE BETWEEN c.week_of - 28 AND c.week_of + 6
  LEFT JOIN pairs p ON p.route = c.route AND p.route_type = c.route_type AND p.week_of = c.week_of AND p.note_id = n.note_id) l GROUP BY ALL) t""")
def _(spark, sf):
    # labelled are notes about the route of the four weeks before and the week itself, whatever they compile to
    a = run(spark, sf)
    raw = a.raw_notes.select("note_id", F.col("applies_to").alias("route"), F.col("date").cast("date").alias("written_on"))
    near = F.col("written_on").between(F.date_sub("week_of", 28), F.date_add("week_of", 6))
    relevance = cut_lineage(a.candidates.select(*KEY).join(raw, "route").where(near).select(*KEY, "note_id"))
    return rt.structured_union_recall(relevance, fa.relevant_pairs_reached(relevance, a.notes), KEY)


_QUALITY = f"""
SELECT metric_id, numerator, denominator, {r('coalesce(numerator / nullif(denominator, 0), empty)', 'value')} FROM (
  SELECT unnest(['evidence.verdict_accuracy', 'evidence.false_clearance_rate', 'evidence.unsafe_evidence_acceptance_rate',
    'evidence.selected_note_accuracy', 'evidence.full_evidence_precision', 'evidence.full_evidence_recall',
    'evidence.accepted_evidence_precision', 'evidence.accepted_evidence_recall', 'evidence.rejected_evidence_accuracy']) AS metric_id,
  unnest([ok, fc, 0, ok, cf, cf, ca, ca, unsafe]) AS numerator, unnest([n, nj, unsafe, n, pf, ef, pa, ea, unsafe]) AS denominator,
  unnest([0, 0, 0, 0, 0, 0, 0, 0, 1]) AS empty FROM (
  SELECT count(*) AS n, count(*) FILTER (m) AS ok, count(*) FILTER (e <> 'justified') AS nj, count(*) FILTER (e <> 'justified' AND a = 'justified') AS fc,
    count(*) FILTER (a = 'justified') AS pf, count(*) FILTER (e = 'justified') AS ef, count(*) FILTER (e = 'justified' AND a = 'justified') AS cf,
    count(*) FILTER (a <> 'unexplained') AS pa, count(*) FILTER (e <> 'unexplained') AS ea, count(*) FILTER (e <> 'unexplained' AND a <> 'unexplained') AS ca,
    (SELECT count(*) FROM gated WHERE cost_impact_status <> 'explicit_increase') AS unsafe
  FROM (SELECT e.verdict AS e, d.verdict AS a, {_MATCH} AS m FROM ({_LABELLED}) e JOIN decisions d USING (route, route_type, week_of)) c) q) z"""


@query("evidence_quality_metrics", _QUALITY)
def _(spark, sf):
    a = run(spark, sf)
    unsafe = a.notes.where("cost_impact_status <> 'explicit_increase'")
    return ms.evidence_quality_metrics(ms.golden_compare(_labelled(a.decisions), a.decisions), a.assessed, unsafe)


def _texts(a: Analysis) -> DataFrame:
    return w.explanation_texts(ex.template_reason(a.decisions))


@query("explanation_quality_metrics", """
SELECT metric_id, numerator, denominator, """ + r('numerator / denominator', 'value') + """ FROM (
  SELECT unnest(['explanation.identity_binding_accuracy', 'explanation.authorized_citation_rate', 'explanation.unsupported_note_id_rate',
    'explanation.unsupported_numeric_claim_rate', 'explanation.fallback_coverage_rate', 'explanation.decision_invariance_rate',
    'explanation.verdict_language_consistency_rate']) AS metric_id,
    unnest([n, n, 0, bad, n, n, v - lang]) AS numerator, unnest([n, n, n, v, n, n, v]) AS denominator
  FROM (SELECT (SELECT count(*) FROM decisions) AS n, count(*) AS v, count(*) FILTER (contains(failure_codes, 'unsupported_numeric_claim')) AS bad,
    count(*) FILTER (contains(failure_codes, 'verdict_language_conflict')) AS lang FROM text_codes) c) m""")
def _(spark, sf):
    a = run(spark, sf)
    packets = cut_lineage(a.packets)
    validated = ex.grounding_validation(_texts(a), a.requests, packets)
    records = a.records
    return ms.explanation_quality_metrics(records, a.decisions, packets, validated)


@query("check_rollup", f"""
SELECT 'weekly' AS domain, 6::BIGINT AS checks, 0::BIGINT AS metrics, 0::BIGINT AS failing, 'pass' AS status
UNION ALL SELECT 'evidence', 0, 9, count(*) FILTER (value <> CASE WHEN metric_id LIKE '%rate' THEN 0 ELSE 1 END),
  CASE WHEN bool_and(value = CASE WHEN metric_id LIKE '%rate' THEN 0 ELSE 1 END) THEN 'pass' ELSE 'fail' END FROM ({_QUALITY}) q""")
def _(spark, sf):
    a = run(spark, sf)
    checks = wk.weekly_reconciliation(a.shipments, a.weekly).select(
        F.lit("weekly").alias("domain"), "check_id", F.lit(True).alias("blocking"), "status")
    unsafe = a.notes.where("cost_impact_status <> 'explicit_increase'")
    quality = ms.evidence_quality_metrics(ms.golden_compare(_labelled(a.decisions), a.decisions), a.assessed, unsafe)
    metrics = quality.select(
        F.lit("evidence").alias("domain"), "metric_id", F.lit(True).alias("blocking"), "value",
        F.when(F.col("metric_id").endswith("rate"), 0.0).otherwise(1.0).alias("target"), F.lit("eq").alias("target_relation"))
    return ms.check_rollup(checks, metrics)


# --- windows ------------------------------------------------------------------------

@query("own_history_baseline", f"SELECT {K}, {r('own', 'own_history_avg_cost_per_tonne_km')} FROM baselines")
def _(spark, sf):
    return b.own_history_baseline(weekly_of(spark, sf)).select(*KEY, "own_history_avg_cost_per_tonne_km")


@query("history_weeks_used", f"SELECT {K}, history_weeks_used FROM baselines")
def _(spark, sf):
    return b.history_weeks_used(weekly_of(spark, sf)).select(*KEY, "history_weeks_used")


@query("peer_baseline", f"SELECT {K}, {r('peer', 'similar_routes_avg_cost_per_tonne_km')}, peer_routes_used FROM baselines")
def _(spark, sf):
    return b.peer_baseline(weekly_of(spark, sf)).select(*KEY, "similar_routes_avg_cost_per_tonne_km", "peer_routes_used")


@query("select_evidence", f"SELECT {K}, selected_note_id FROM picked")
def _(spark, sf):
    return ev.select_evidence(run(spark, sf).assessed)


@query("lead_rank", f"SELECT {K}, lens, kind, lead_rank, category, {r('net', 'net_contribution')} FROM leads")
def _(spark, sf):
    return rc.lead_rank(run_categories(spark, sf).contributions).select(*KEY, "lens", "kind", "lead_rank", "category", "net_contribution")


@query("absolute_effect_share", f"SELECT {K}, lens, category, {r('pct', 'absolute_effect_share_pct')} FROM contributions")
def _(spark, sf):
    return run_categories(spark, sf).contributions.select(*KEY, "lens", "category", "absolute_effect_share_pct")


@query("route_timeline", f"""
SELECT m.route, m.route_type, m.week_of, {r('cost_per_tonne_km', 'cost_per_tonne_km')}, {r('own', 'own_history_baseline')}, {r('peer', 'peer_baseline')},
  {r('own_pct', 'vs_own_history_pct')}, {r('peer_pct', 'vs_similar_routes_pct')}, history_weeks_used, peer_routes_used, candidate, d.verdict
FROM metrics m LEFT JOIN decisions d USING (route, route_type, week_of)""")
def _(spark, sf):
    a = run(spark, sf)
    return rd.route_timeline(a.metrics, a.decisions)


_SPARSE_RANK = f"SELECT query_id, doc_id, rank, {r('score', 'score')} FROM sparse_top"
_DENSE_RANK = f"SELECT query_id, doc_id, rank, {r('score', 'score')} FROM dense_top"


def _sparse(spark, sf):
    return rt.tfidf_sparse(w.table(spark, sf, "benchmark"), w.table(spark, sf, "documents"),
                           ("item_id", "text"), ("doc_id", "text"), SCORES)


def _dense(spark, sf):
    v = w.table(spark, sf, "embeddings")
    return rt.dense_cosine(v, v, ("vec_id", "embedding"), ("vec_id", "embedding"), SCORES)


@query("sparse_rank", "SELECT query_id, doc_id, rank FROM sparse_top")
def _(spark, sf):
    return _sparse(spark, sf).select("query_id", "doc_id", "rank")


@query("dense_rank_notes", "SELECT query_id, doc_id, rank FROM dense_top")
def _(spark, sf):
    return _dense(spark, sf).select("query_id", "doc_id", "rank")


# --- sort, limit, top-k -------------------------------------------------------------

@query("canonical_sort", f"SELECT row_number() OVER (ORDER BY {K}) AS place, {K} FROM weekly")
def _(spark, sf):
    # the place is read off the sorted output per range partition, not by one global window
    ordered = wk.canonical_sort(weekly_of(spark, sf).select(*KEY))
    numbered = ordered.withColumn("_at", F.monotonically_increasing_id())
    return placed(numbered, "_at").select("place", *KEY)


def placed(df: DataFrame, at: str) -> DataFrame:
    """Position in a sorted table: rank inside a partition plus the rows before it."""
    from pyspark.sql import Window

    part = F.shiftright(F.col(at), 33)
    marked = df.withColumns({"_part": part, "_in": F.col(at) - F.shiftleft(part, 33)})
    sizes = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return marked.join(before, "_part").withColumn("place", F.col("_before") + F.col("_in") + 1)


_VIEW = f"""candidate_key, {K}, trigger, verdict, {r('cost_per_tonne_km', 'cost_per_tonne_km')}, {r('own_pct', 'vs_own_history_pct')},
  {r('peer_pct', 'vs_similar_routes_pct')}"""
_VIEW_COLS = ("candidate_key", *KEY, "trigger", "verdict", "cost_per_tonne_km", "vs_own_history_pct", "vs_similar_routes_pct")


@query("list_anomalies", f"""
SELECT {_VIEW} FROM (SELECT * FROM viewed WHERE route_type = 'Medium' AND verdict = 'unexplained' AND own_pct >= 25
  ORDER BY peer_pct DESC NULLS LAST, route, week_of, route_type LIMIT 50 OFFSET 10) p""")
def _(spark, sf):
    return rd.list_anomalies(run(spark, sf).view, route_type="Medium", verdict="unexplained", min_own_deviation_pct=25.0,
                             sort_by="vs_similar_routes_pct", sort_order="desc", limit=50, offset=10).select(*_VIEW_COLS)


@query("count_anomalies", "SELECT count(*) AS total FROM viewed WHERE route_type = 'Medium' AND peer_pct >= 10 AND trigger = 'both'")
def _(spark, sf):
    return rd.count_anomalies(run(spark, sf).view, route_type="Medium", min_peer_deviation_pct=10.0, trigger="both")


@query("get_anomaly", f"SELECT {_VIEW} FROM viewed ORDER BY {K} LIMIT 1")
def _(spark, sf):
    view = run(spark, sf).view
    key = view.orderBy(*KEY).select(*KEY).first()
    return rd.get_anomaly(view, key.route, key.week_of, key.route_type).select(*_VIEW_COLS)


@query("get_root_cause", f"""
SELECT v.candidate_key, {r('v.cost_per_tonne_km - own', 'target_gap')} FROM viewed v
WHERE verdict = 'unexplained' ORDER BY {K} LIMIT 1""")
def _(spark, sf):
    a = run(spark, sf)
    key = a.unexplained.orderBy(*KEY).select(*KEY).first()
    if key is None:  # every candidate is explained
        return a.root_base.limit(0).select("candidate_key", "target_gap")
    return rd.get_root_cause(a.root_base, a.view, key.route, key.week_of, key.route_type).select("candidate_key", "target_gap")


@query("list_rejected_evidence", """
SELECT route, week_of, note_id, rejection_codes FROM gated WHERE evidence_level = 'rejected'
  AND contains(rejection_codes, 'scope_outside_dataset') AND week_of BETWEEN DATE '2001-01-01' AND DATE '2001-06-30'""")
def _(spark, sf):
    a = run(spark, sf)
    return rd.list_rejected_evidence(
        a.evidence_rows_of(week_from=dt.date(2001, 1, 1), week_to=dt.date(2001, 6, 30)), rejection_code="scope_outside_dataset", week_from=dt.date(2001, 1, 1),
        week_to=dt.date(2001, 6, 30)).select("route", "week_of", "note_id", "rejection_codes")


@query("top_k_notes", _DENSE_RANK)
def _(spark, sf):
    return _dense(spark, sf)


@query("top_anomalies", f"SELECT {_VIEW} FROM (SELECT * FROM viewed ORDER BY own_pct DESC NULLS LAST, route, week_of LIMIT 25) t")
def _(spark, sf):
    return rd.top_anomalies(run(spark, sf).view, "vs_own_history_pct", 25).select(*_VIEW_COLS)


@query("attention_spotlight", f"""
SELECT {_VIEW} FROM (SELECT * FROM viewed WHERE verdict <> 'justified' ORDER BY verdict <> 'unexplained', own_pct DESC, route, week_of LIMIT 1) t""")
def _(spark, sf):
    return rd.attention_spotlight(run(spark, sf).view).select(*_VIEW_COLS)


# --- set operations -----------------------------------------------------------------

@query("issue_union", f"SELECT code, count(*) AS issues FROM ({_ISSUES}) a WHERE \"column\" IN ('shipment_id', 'shipment_date') GROUP BY code")
def _(spark, sf):
    raw = w.raw_text_rows(spark, sf)
    return dq.issue_union(
        dq.dq_text(raw, ["shipment_id"], "shipments"), dq.dq_date(raw, "shipment_date", "shipments"),
        dq.dq_identifier(raw, "shipment_id", "shipments")).groupBy("code").agg(F.count(F.lit(1)).alias("issues"))


@query("category_union", f"SELECT DISTINCT {K}, lens, category FROM sides")
def _(spark, sf):
    return run_categories(spark, sf).contributions.select(*KEY, "lens", "category")


@query("code_union", "SELECT note_id, compilation_warnings FROM compiled WHERE compilation_warnings <> ''")
def _(spark, sf):
    return compiled_of(spark, sf).where(F.size("compilation_warnings") > 0).select("note_id", "compilation_warnings")


@query("relevant_intersection", "SELECT query_id, doc_id, rank FROM dense_top WHERE relevant AND rank <= 3")
def _(spark, sf):
    v = w.table(spark, sf, "embeddings")
    hits = _dense(spark, sf)
    side = lambda p_: v.select(F.col("vec_id").alias(f"{p_}_id"), F.col("label").alias(f"{p_}_label"))
    relevance = hits.join(side("query"), "query_id").join(side("doc"), "doc_id").where(
        "query_label = doc_label").select("query_id", "doc_id")
    return rt.relevant_intersection(hits, relevance, 3)


@query("key_set_difference", f"""
SELECT {K}, 'left' AS only_in FROM weekly WHERE (route, route_type, week_of) NOT IN (SELECT (route, route_type, week_of) FROM cand)
UNION ALL SELECT 'NOWHERE-NOWHERE', 'Short', DATE '2024-01-01', 'right'""")
def _(spark, sf):
    m = metrics_of(spark, sf)
    extra = spark.createDataFrame([("NOWHERE-NOWHERE", "Short", dt.date(2024, 1, 1))], "route string, route_type string, week_of date")
    return rp.key_set_difference(m, c.candidates_only(m).select(*KEY).unionByName(extra), KEY)


@query("row_multiset_equality", """
SELECT (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A') AS only_left, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'N') AS only_right""")
def _(spark, sf):
    li = w.table(spark, sf, "lineitem")
    return rp.row_multiset_equality(li.where("l_returnflag <> 'N'"), li.where("l_returnflag <> 'A'"))


# --- note compilation ---------------------------------------------------------------

def _notes_and_routes(spark, sf):
    return w.context_notes(spark, sf), w.shipments(spark, sf).select("route").distinct()


@query("compile_scope", "SELECT note_id, scope_type, applies_to_routes, scope_status FROM compiled")
def _(spark, sf):
    return nt.compile_scope(*_notes_and_routes(spark, sf)).select("note_id", "scope_type", "applies_to_routes", "scope_status")


@query("compile_interval", "SELECT note_id, effective_from, effective_to, temporal_basis FROM compiled")
def _(spark, sf):
    return nt.compile_interval(w.context_notes(spark, sf)).select("note_id", "effective_from", "effective_to", "temporal_basis")


@query("parse_explicit_range", "SELECT note_id, effective_from AS first, effective_to AS last, range_error AS error FROM dated WHERE has_range")
def _(spark, sf):
    return nt.parse_explicit_range(w.context_notes(spark, sf)).where("range IS NOT NULL").select("note_id", "range.*")


@query("classify_event", "SELECT note_id, event_type FROM compiled")
def _(spark, sf):
    return w.context_notes(spark, sf).select("note_id", nt.classify_event(F.col("note")).alias("event_type"))


@query("compile_impact", "SELECT note_id, impact_direction, cost_impact_status, affects_transport_cost, negates_cost_increase FROM compiled")
def _(spark, sf):
    return nt.compile_impact(w.context_notes(spark, sf)).select(
        "note_id", "impact_direction", "cost_impact_status", "affects_transport_cost", "negates_cost_increase")


@query("extract_magnitude", "SELECT note_id, magnitude_text, clashing AS conflicting FROM judged")
def _(spark, sf):
    m = nt.extract_magnitude(F.col("note"))
    return w.context_notes(spark, sf).select("note_id", m["text"].alias("magnitude_text"), m["conflicting"].alias("conflicting"))


@query("magnitude_upper_bound", f"SELECT note_id, {r('upper_bound', 'upper_bound')} FROM compiled")
def _(spark, sf):
    m = nt.extract_magnitude(F.col("note"))
    return w.context_notes(spark, sf).select("note_id", nt.magnitude_upper_bound(m["text"]).alias("upper_bound"))


@query("compile_notes", _COMPILED)
def _(spark, sf):
    return compiled_of(spark, sf)


# --- retrieval, gate, decision, explanation -----------------------------------------

_QUERY_TEXT = f"""
SELECT {K}, concat('Investigate an increase in freight transport cost for route ', route, ' (', route_type, ') during ', week_of::VARCHAR, ' to ',
  (week_of + 6)::VARCHAR, '.', chr(10), 'Trigger: ', CASE WHEN own_hit AND peer_hit THEN 'both' WHEN own_hit THEN 'own' ELSE 'peer' END, '.', chr(10),
  'Find operational events that explicitly increased freight transport costs or rates.') AS query_text, {r('cost_per_tonne_km', 'shown_cost')}, {r('own_pct', 'shown_own')}, {r('peer_pct', 'shown_peer')} FROM cand"""


@query("candidate_query_text", _QUERY_TEXT)
def _(spark, sf):
    # the engines print doubles differently: the three figures are read back from their lines
    lines = F.split("query_text", "\n")
    figure = lambda k: F.regexp_extract(lines[k], r": (.+?)( percent)?\.$", 1).try_cast("double")
    text = ev.candidate_query_text(c.candidates_only(metrics_of(spark, sf)))
    return text.select(*KEY, F.concat_ws("\n", lines[0], lines[4], lines[5]).alias("query_text"),
                       figure(1).alias("shown_cost"), figure(2).alias("shown_own"), figure(3).alias("shown_peer"))


@query("note_document_text", """
SELECT note_id, concat('Note ', note_id, '.', chr(10), 'Scope: ', CASE WHEN scope_type = 'global' THEN 'global' ELSE applies_to_routes END, '.', chr(10),
  'Effective: ', effective_from::VARCHAR, ' to ', coalesce(effective_to::VARCHAR, 'open ended'), '.', chr(10), 'Event: ', event_type, '.', chr(10),
  'Transport cost impact: ', cost_impact_status, '.', chr(10), 'Direction: ', impact_direction, '.', chr(10), 'Text: ', original_text) AS document_text
FROM compiled WHERE compile_error IS NULL""")
def _(spark, sf):
    return ev.note_document_text(compiled_of(spark, sf))


@query("tfidf_sparse", _SPARSE_RANK)
def _(spark, sf):
    return _sparse(spark, sf)


@query("dense_cosine", _DENSE_RANK)
def _(spark, sf):
    return _dense(spark, sf)


@query("rrf_score", f"SELECT query_id, doc_id, {r('fused_score', 'fused_score')} FROM fused")
def _(spark, sf):
    return rt.rank_fusion(*_item_hits(spark, sf), SCORES).select("query_id", "doc_id", "fused_score")


@query("overlap_days", "SELECT overlap_days, count(*) AS pairs FROM pairs GROUP BY overlap_days")
def _(spark, sf):
    a = run(spark, sf)
    facts = a.notes.select("note_id", "effective_from", "effective_to")
    days = ev.overlap_days(F.col("week_of"), F.col("effective_from"), F.col("effective_to"))
    return a.recalled.drop("overlap_days").join(facts, "note_id").groupBy(days.alias("overlap_days")).agg(
        F.count(F.lit(1)).alias("pairs"))


@query("evidence_gate", f"""
SELECT {K}, note_id, evidence_level, overlap_days, rejection_codes FROM gated""")
def _(spark, sf):
    return run(spark, sf).assessed.select(*KEY, "note_id", "evidence_level", "overlap_days", "rejection_codes")


_DECISION = f"SELECT {K}, verdict, selected_note_id, first_supporting_note_id, full_note_count, supporting_note_count FROM decisions"


@query("decide_verdict", _DECISION)
def _(spark, sf):
    return run(spark, sf).decisions.drop("reason_template_key")


def _vectors(a: Analysis, sf: str):
    """A vector per candidate and per note, dealt from the embeddings table by hash."""
    v = w.table(a.spark, sf, "embeddings")
    size = v.agg(F.count(F.lit(1)).alias("n"))
    deal = lambda df: fx.with_scalars(df, size).withColumn("vec_id", F.pmod(F.crc32("id").cast("bigint"), "n")).join(
        v, "vec_id").select("id", F.col("embedding").alias("vector"))
    queries = a.candidates.select(c.candidate_id(F.col("route"), F.col("route_type"), F.col("week_of")).alias("id"))
    return deal(queries), deal(a.notes.where("compile_error IS NULL").select(F.col("note_id").alias("id")))


@query("review_evidence", f"SELECT {K}, verdict, first_supporting_note_id, full_note_count, supporting_note_count FROM decisions")
def _(spark, sf):
    # the whole chain with both retrieval channels; the ranks break ties of the selected note
    a = run(spark, sf)
    hits = cut_lineage(a.fused_hits(*_vectors(a, sf)))
    return a.review(hits).select(*KEY, "verdict", "first_supporting_note_id", "full_note_count", "supporting_note_count")


@query("review_evidence_selected")
def _(spark, sf):
    a = run(spark, sf)
    hits = cut_lineage(a.fused_hits(*_vectors(a, sf)))
    return a.review(hits).where("verdict = 'justified'").select(*KEY, "selected_note_id")


@query("reviewed_reason", "SELECT route, week_of, flagged, matched_note_id, review_reason AS reason FROM reviewed")
def _(spark, sf):
    return run(spark, sf).reviewed.select("route", "week_of", "flagged", "matched_note_id", "reason")


@query("grounded_request", f"""
SELECT {K}, week_of + 6 AS week_end, cost_text AS cost_per_tonne_km_display, own_text AS vs_own_history_display,
  peer_text AS vs_similar_routes_display, verdict, CASE WHEN verdict = 'justified' THEN 'No (justified)' ELSE 'Yes' END AS flagged,
  selected_note_id, supporting_note_count FROM displayed JOIN decisions USING (route, route_type, week_of)""")
def _(spark, sf):
    return run(spark, sf).requests.drop("prompt_version", "first_supporting_note_id")


@query("request_evidence", f"""
SELECT {K}, role, note_id, scope_type, effective_from, effective_to, event_type, magnitude_text, original_text FROM packet_facts""")
def _(spark, sf):
    return ex.request_evidence(run(spark, sf).packets).drop("role_order", "impact_direction", "cost_impact_status")


@query("template_reason", f"SELECT {K}, verdict, reason, cited AS cited_note_ids FROM reasoned")
def _(spark, sf):
    return ex.template_reason(run(spark, sf).decisions).select(*KEY, "verdict", "reason", "cited_note_ids")


@query("grounding_validation", "SELECT text_id, failure_codes = '' AS accepted, failure_codes FROM text_codes")
def _(spark, sf):
    a = run(spark, sf)
    return ex.grounding_validation(_texts(a), a.requests, a.packets)


@query("numeric_claim_check", """
SELECT text_id, len(bad_numbers) AS unsupported_numbers, len(bad_dates) AS unsupported_dates, len(bad_numbers) + len(bad_dates) = 0 AS supported
FROM text_claims""")
def _(spark, sf):
    a = run(spark, sf)
    return ex.numeric_claim_check(_texts(a), a.requests, a.packets)


@query("explanation_audit", f"""
SELECT {K}, verdict, selected_note_id, cited AS cited_note_ids, 'template' AS explanation_source, 0::BIGINT AS provider_attempts,
  sha256(reason) AS reason_sha256 FROM reasoned""")
def _(spark, sf):
    return ex.explanation_audit(run(spark, sf).records).select(
        *KEY, "verdict", "selected_note_id", "cited_note_ids", "explanation_source", "provider_attempts", "reason_sha256")


@query("request_key", "SELECT count(*) AS requests, count(*) AS distinct_keys, 64::BIGINT AS key_length FROM decisions")
def _(spark, sf):
    return run(spark, sf).request_keys.agg(
        F.count(F.lit(1)).alias("requests"), F.countDistinct("request_key").alias("distinct_keys"),
        F.max(F.length("request_key")).alias("key_length"))


# --- decomposition ------------------------------------------------------------------

@query("root_cause_base", f"""
SELECT o.route, o.route_type, o.week_of, n AS reference_week_count, {r('o.cost_per_tonne_km - own', 'target_gap')},
  CASE WHEN n >= 6 THEN 'strong' WHEN n >= 3 THEN 'moderate' ELSE 'limited' END AS support_level, weeks AS reference_weeks, true AS reconciles
FROM open_cases o JOIN (SELECT {K}, count(*) AS n, string_agg(ref_week::VARCHAR, ',' ORDER BY ref_week) AS weeks FROM refs GROUP BY ALL) f
USING (route, route_type, week_of)""")
def _(spark, sf):
    return run(spark, sf).root_base.select(*KEY, "reference_week_count", "target_gap", "support_level", "reference_weeks", "reconciles")


_EFFECTS = f"""
SELECT {K}, lens, category, now_n AS current_shipment_count, past_n AS reference_shipment_count, weeks AS reference_weeks_present,
  {r('now_share', 'current_tonne_km_share')}, {r('past_share', 'reference_mean_tonne_km_share')}, {r('now_rate', 'current_cost_per_tonne_km')},
  {r('past_rate', 'reference_mean_cost_per_tonne_km')}, {r('mix', 'mix_effect')}, {r('rate', 'rate_effect')}, {r('entry', 'entry_effect')},
  {r('exit', 'exit_effect')}, {r('net', 'net_contribution')}, {r('pct', 'absolute_effect_share_pct')}, direction, support_level FROM contributions"""


@query("mix_rate_decomposition", _EFFECTS)
def _(spark, sf):
    return run_categories(spark, sf).contributions


@query("decomposition_reconcile", f"""
SELECT e.route, e.route_type, e.week_of, lens, {r('any_value(o.cost_per_tonne_km - own)', 'target_gap')}, {r('sum(net)', 'reconstructed_gap')}, true AS reconciles
FROM effects e JOIN open_cases o USING (route, route_type, week_of) GROUP BY ALL""")
def _(spark, sf):
    a = run_categories(spark, sf)
    return rc.decomposition_reconcile(a.contributions, a.root_base).drop("reconstruction_error")


@query("category_support", f"SELECT lens, support_level, count(*) AS categories FROM contributions GROUP BY ALL")
def _(spark, sf):
    return run_categories(spark, sf).contributions.groupBy("lens", "support_level").agg(F.count(F.lit(1)).alias("categories"))


@query("result_support", f"""
SELECT CASE WHEN n >= 6 THEN 'strong' WHEN n >= 3 THEN 'moderate' ELSE 'limited' END AS support_level, count(*) AS candidates
FROM (SELECT {K}, count(*) AS n FROM refs GROUP BY ALL) f GROUP BY ALL""")
def _(spark, sf):
    return run(spark, sf).root_base.groupBy("support_level").agg(F.count(F.lit(1)).alias("candidates"))


@query("effect_direction", "SELECT lens, direction, count(*) AS categories FROM contributions GROUP BY ALL")
def _(spark, sf):
    return run_categories(spark, sf).contributions.groupBy("lens", "direction").agg(F.count(F.lit(1)).alias("categories"))


@query("operational_leads", f"""
SELECT {K}, lens, kind, lead_rank, category, {r('net', 'effect')}, support_level, concat(category, ' showed ', CASE WHEN kind = 'lead' THEN 'a positive' ELSE 'an offsetting' END,
  ' ', lens, ' decomposition effect of ', printf('%+.4f', net), ' INR/t-km. This is an operational lead, not accepted contextual evidence.',
  CASE WHEN support_level <> 'strong' THEN ' It has limited support.' ELSE '' END) AS narrative FROM leads""")
def _(spark, sf):
    return rc.operational_leads(run_categories(spark, sf).contributions)


@query("root_cause_analysis", f"""
SELECT f.route || '|' || f.week_of::VARCHAR AS candidate_key, n AS reference_week_count, c AS contributions_n, coalesce(l, 0) AS leads_n, 7::BIGINT AS metrics_n
FROM (SELECT {K}, count(*) AS n FROM refs GROUP BY ALL) f
JOIN (SELECT {K}, count(*) AS c FROM effects GROUP BY ALL) e USING (route, route_type, week_of)
LEFT JOIN (SELECT {K}, count(*) AS l FROM leads GROUP BY ALL) g USING (route, route_type, week_of)""")
def _(spark, sf):
    return run_categories(spark, sf).analyses.select(
        "candidate_key", "reference_week_count", F.size("contributions").alias("contributions_n"),
        F.when(F.col("leads").isNull(), 0).otherwise(F.size("leads")).alias("leads_n"),
        F.size("operational_metrics").alias("metrics_n"))


@query("root_cause_checks", passing("eligible_coverage", "verdict_boundary", "no_lookahead", "base_agrees", "reconstruction"))
def _(spark, sf):
    a = run_categories(spark, sf)
    return rc.root_cause_checks(a.root_base, rc.decomposition_reconcile(a.contributions, a.root_base), a.decisions)


# --- invariance ---------------------------------------------------------------------

@query("permutation_invariance", passing(*[f"metamorphic.{x}" for x in (
    "shipment_permutation_weekly", "shipment_permutation_candidates", "note_permutation")], extra=", 0::BIGINT AS differences"))
def _(spark, sf):
    return inv.permutation_invariance(w.shipments(spark, sf), w.context_notes(spark, sf))


@query("note_injection_invariance", passing(*[f"metamorphic.{x}" for x in (
    "note_permutation_decisions", "irrelevant_note_injection", "no_impact_note_injection")], extra=", 0::BIGINT AS differences"))
def _(spark, sf):
    a = run(spark, sf)
    return inv.note_injection_invariance(a.candidates, a.notes)


@query("tamper_detection", passing(*rp.CHECKS, column="variant", extra=", true AS detected"))
def _(spark, sf):
    final = cut_lineage(run(spark, sf).final)
    lines = files.contract_lines(spark, files.sink_contract_csv(final, scratch_path(spark, "final")))
    rows, _headers = files.output_rows(lines)
    return rp.tamper_detection(cut_lineage(rows), final).select("variant", "detected")
