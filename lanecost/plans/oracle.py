"""Independent SQL for the registered queries, runnable on the plain test tables.

Every query is a final SELECT over named common table expressions, which restate the
rules in plain SQL: range joins instead of blocks, pairs instead of classes, windows
instead of joined aggregates. Only the workload mapping and the fixed phrase patterns
are shared with the Spark side.
"""

from __future__ import annotations

import re

from ..operators import explain as x, notes as p, report as rep
from ..operators.candidates import OWN_SUFFIX, PEER_SUFFIX, PEER_UNAVAILABLE_TEXT, PRELIMINARY_REASON
from . import workload


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def says(pattern: str, column: str = "note") -> str:
    return f"regexp_matches({column}, {q('(?i)' + pattern)})"


def r(expr: str, name: str | None = None) -> str:
    return f"(round_even(({expr})::DOUBLE * 1e6 + 0.1234567, 0) / 1e6 + 0.0)" + (f" AS {name}" if name else "")


K = "route, route_type, week_of"
CTE: dict[str, str] = {}

CTE["shipments"] = """
SELECT concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR,
                 (l_extendedprice::DECIMAL(18,2))::VARCHAR) AS shipment_id,
       o.r_name AS origin, d.r_name AS destination,
       CASE WHEN o.r_regionkey = d.r_regionkey THEN 'Short'
            WHEN abs(o.r_regionkey - d.r_regionkey) <= 2 THEN 'Medium' ELSE 'Long' END AS route_type,
       p_type AS material, l_quantity::DECIMAL(18,2) AS quantity_tonnes,
       (100 + 150 * abs(o.r_regionkey - d.r_regionkey) + 10 * o.r_regionkey)::DECIMAL(10,0) AS distance_km,
       l_extendedprice::DECIMAL(18,2) AS freight_cost_inr, l_shipdate::DATE AS shipment_date,
       sn.n_name AS transporter, o.r_name || '-' || d.r_name AS route,
       date_trunc('week', l_shipdate)::DATE AS week_of,
       l_quantity::DECIMAL(18,2) * (100 + 150 * abs(o.r_regionkey - d.r_regionkey) + 10 * o.r_regionkey)::DECIMAL(10,0) AS tonne_km
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region d ON cn.n_regionkey = d.r_regionkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
  JOIN region o ON sn.n_regionkey = o.r_regionkey JOIN part ON l_partkey = p_partkey"""
CTE["weekly"] = f"""
SELECT {K}, count(*) AS shipment_count, sum(freight_cost_inr)::DOUBLE AS total_freight_cost_inr,
       sum(quantity_tonnes)::DOUBLE AS total_quantity_tonnes, sum(tonne_km)::DOUBLE AS total_tonne_km,
       sum(freight_cost_inr)::DOUBLE / sum(tonne_km)::DOUBLE AS cost_per_tonne_km
FROM shipments GROUP BY ALL"""
CTE["baselines"] = """
SELECT *, avg(cost_per_tonne_km) OVER h AS own, least(row_number() OVER o - 1, 8) AS history_weeks_used,
       CASE WHEN count(*) OVER pw > 1 THEN (sum(cost_per_tonne_km) OVER pw - cost_per_tonne_km)
            / (count(*) OVER pw - 1) END AS peer, count(*) OVER pw - 1 AS peer_routes_used
FROM weekly
WINDOW h AS (PARTITION BY route, route_type ORDER BY week_of ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING),
       o AS (PARTITION BY route, route_type ORDER BY week_of), pw AS (PARTITION BY route_type, week_of)"""
CTE["metrics"] = """
SELECT *, coalesce(own_pct > 0, false) AS is_rising, coalesce(own_pct >= 20, false) AS own_hit,
       coalesce(peer_pct >= 20, false) AS peer_hit,
       coalesce(own_pct > 0 AND (own_pct >= 20 OR coalesce(peer_pct >= 20, false)), false) AS candidate
FROM (SELECT *, (cost_per_tonne_km / own - 1) * 100 AS own_pct, (cost_per_tonne_km / peer - 1) * 100 AS peer_pct
      FROM baselines) m"""
CTE["cand"] = "SELECT * FROM metrics WHERE candidate"
CTE["notes_raw"] = workload.NOTES_SQL.format(events="events")
CTE["raw_rows"] = workload.RAW_TEXT_SQL.format(orders="orders")
CTE["usage"] = workload.USAGE_SQL.format(conversations="conversations")

_E = p.EXPLICIT_RANGE
_G = lambda i: f"regexp_extract(note, {q('(?i)' + _E)}, {i})"
_M = lambda i: ("list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], "
                f"lower(substr({_G(i)}, 1, 3)))")
CTE["scoped"] = f"""
SELECT *, lower(trim(applies_to)) = 'all routes' AS everywhere, {says(p.EXCLUSION)} AS excluded,
       applies_to IN (SELECT route FROM weekly) AS known,
       regexp_matches(applies_to, {q(p.ROUTE_SHAPE)}) AS shaped FROM notes_raw"""
CTE["ranged"] = f"""
SELECT *, try_cast(printf('%04d-%02d-%02d', y1::INT, m1::INT, d1::INT) AS DATE) AS r1,
       try_cast(printf('%04d-%02d-%02d', CASE WHEN y2 IS NOT NULL THEN y2 WHEN back AND m1 >= 10 AND m2 <= 3 THEN y1 + 1
                ELSE y1 END::INT, m2::INT, d2::INT) AS DATE) AS r2
FROM (SELECT *, y2 IS NULL AND (m2 < m1 OR (m2 = m1 AND d2 < d1)) AS back FROM (
  SELECT *, {says(_E)} AS has_range, {_M(1)} AS m1, try_cast({_G(2)} AS INT) AS d1,
         coalesce(try_cast(nullif({_G(3)}, '') AS INT), year(date)) AS y1, {_M(4)} AS m2,
         try_cast({_G(5)} AS INT) AS d2, try_cast(nullif({_G(6)}, '') AS INT) AS y2 FROM scoped) a) b"""
CTE["timed"] = f"""
SELECT *, CASE WHEN NOT has_range THEN NULL
    WHEN back AND NOT (m1 >= 10 AND m2 <= 3) THEN 'range_ends_before_start'
    WHEN r1 IS NULL OR r2 IS NULL THEN 'impossible_date' WHEN r2 < r1 THEN 'range_ends_before_start' END AS range_error,
  CASE WHEN has_range THEN 'explicit_range' WHEN {says(p.ABOUT_A_WEEK)} THEN 'approximate_week'
    WHEN {says(p.THIS_QUARTER)} THEN 'calendar_quarter' WHEN {says(p.CONTINUING)} THEN 'open_ended_start'
    WHEN {says(p.THIS_WEEK)} THEN 'calendar_week' WHEN {says(p.AFTER_COMPLETION)} THEN 'state_after_completion'
    ELSE 'source_date_fallback' END AS temporal_basis FROM ranged"""
CTE["dated"] = f"""
SELECT *, CASE temporal_basis WHEN 'explicit_range' THEN CASE WHEN range_error IS NULL THEN r1 END
    WHEN 'calendar_quarter' THEN date_trunc('quarter', date)::DATE
    WHEN 'calendar_week' THEN date_trunc('week', date)::DATE ELSE date END AS effective_from,
  CASE temporal_basis WHEN 'explicit_range' THEN CASE WHEN range_error IS NULL THEN r2 END
    WHEN 'approximate_week' THEN date + 6
    WHEN 'calendar_quarter' THEN (date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE
    WHEN 'calendar_week' THEN date_trunc('week', date)::DATE + 6
    WHEN 'source_date_fallback' THEN date END AS effective_to,
  temporal_basis = 'source_date_fallback' AND {says(p.TIME_HINT)} AS hinted FROM timed"""
CTE["cued"] = f"""
SELECT *, CASE {' '.join(f'WHEN {says(pt)} THEN {q(n)}' for n, pt in p.EVENTS)} ELSE 'unknown' END AS event_type,
  {says(p.NO_RATE_CHANGE)} AS c_rate, {says(p.NO_MATERIAL_IMPACT)} AS c_material, {says(p.STABLE)} AS c_stable,
  {says(p.DECREASE)} AS c_down, {says(p.INCREASE)} AS c_up,
  CASE WHEN {says(p.COST_CONTEXT)} THEN list_concat(regexp_extract_all(note, {q('(?i)' + p.PERCENT)}),
       regexp_extract_all(note, {q('(?i)' + p.CURRENCY)})) ELSE [] END AS phrases FROM dated"""
CTE["judged"] = """
SELECT *, CASE WHEN (c_rate OR c_material) AND (c_up OR c_down) THEN 'unknown'
    WHEN c_rate THEN 'explicit_no_rate_change' WHEN c_material THEN 'explicit_no_material_impact'
    WHEN c_stable THEN 'normal_or_stable_operations' WHEN c_up AND c_down THEN 'unknown'
    WHEN c_down THEN 'explicit_decrease' WHEN c_up THEN 'explicit_increase' ELSE 'not_stated' END AS cost_impact_status,
  CASE WHEN len(list_distinct(phrases)) = 1 THEN trim(phrases[1]) END AS magnitude_text,
  len(list_distinct(phrases)) > 1 AS clashing FROM cued"""
CTE["compiled"] = f"""
SELECT note_id, date AS source_date, applies_to AS source_applies_to, note AS original_text,
  CASE WHEN everywhere THEN 'global' ELSE 'route' END AS scope_type,
  CASE WHEN everywhere THEN '' ELSE applies_to END AS applies_to_routes,
  CASE WHEN excluded OR (NOT everywhere AND NOT known) THEN 'outside_dataset' ELSE 'in_dataset' END AS scope_status,
  effective_from, effective_to, temporal_basis, event_type,
  CASE cost_impact_status WHEN 'explicit_increase' THEN 'increase' WHEN 'explicit_decrease' THEN 'decrease'
    WHEN 'not_stated' THEN 'unknown' WHEN 'unknown' THEN 'unknown' ELSE 'no_change' END AS impact_direction,
  cost_impact_status,
  CASE WHEN cost_impact_status IN ('explicit_increase', 'explicit_decrease') THEN true
    WHEN cost_impact_status IN ('not_stated', 'unknown') THEN NULL ELSE false END AS affects_transport_cost,
  cost_impact_status IN ('explicit_no_rate_change', 'explicit_no_material_impact', 'normal_or_stable_operations')
    AS negates_cost_increase,
  magnitude_text,
  concat_ws(',', CASE WHEN cost_impact_status = 'unknown' THEN 'conflicting_cost_claims' END,
    CASE WHEN clashing THEN 'conflicting_cost_magnitudes' END,
    CASE WHEN event_type = 'unknown' THEN 'event_type_unknown' END,
    CASE WHEN NOT everywhere AND NOT known THEN 'explicit_route_not_in_dataset' END,
    CASE WHEN hinted THEN 'temporal_phrase_ambiguous' END,
    CASE WHEN temporal_basis = 'source_date_fallback' THEN 'temporal_scope_defaulted_to_source_date' END,
    CASE WHEN excluded THEN 'text_excludes_dataset_scope' END,
    CASE WHEN cost_impact_status = 'not_stated' THEN 'transport_cost_impact_not_stated' END) AS compilation_warnings,
  CASE WHEN NOT everywhere AND NOT shaped THEN 'unsupported_scope' ELSE range_error END AS compile_error,
  CASE WHEN regexp_matches(magnitude_text, {q('(?i)' + p.PERCENT_UPPER)}) THEN coalesce(
    try_cast(nullif(regexp_extract(magnitude_text, {q('(?i)' + p.PERCENT_UPPER)}, 1), '') AS DOUBLE),
    try_cast(regexp_extract(magnitude_text, '[0-9]+([.][0-9]+)?') AS DOUBLE)) END AS upper_bound
FROM judged"""
CTE["pairs"] = f"""
SELECT c.route, c.route_type, c.week_of, n.note_id, c.own_pct, c.peer_hit, n.* EXCLUDE (note_id),
  n.scope_type = 'route' AS exact_route,
  greatest(0, date_diff('day', greatest(c.week_of, effective_from),
           least(c.week_of + 6, coalesce(effective_to, c.week_of + 6))) + 1) AS overlap_days
FROM cand c JOIN compiled n ON (n.scope_type = 'global' OR n.applies_to_routes = c.route)
  AND n.effective_from <= c.week_of + 6 AND coalesce(n.effective_to, DATE '9999-12-31') >= c.week_of
WHERE compile_error IS NULL"""
CTE["gated"] = """
SELECT *, CASE WHEN NOT hard THEN 'rejected' WHEN cover = 'full' THEN 'full' ELSE 'partial' END AS evidence_level,
  concat_ws(',',
    CASE WHEN NOT cost_ok THEN 'cost_impact_not_positive' END,
    CASE WHEN negates_cost_increase THEN 'cost_increase_negated' END,
    CASE WHEN hard AND cover = 'small' THEN 'global_magnitude_insufficient' END,
    CASE WHEN hard AND cover = 'premium' THEN 'global_scope_cannot_explain_peer_premium' END,
    CASE WHEN impact_direction <> 'increase' THEN 'impact_direction_not_increase' END,
    CASE WHEN scope_status = 'outside_dataset' THEN 'scope_outside_dataset' END) AS rejection_codes
FROM (SELECT *, cost_impact_status = 'explicit_increase' AS cost_ok,
        cost_impact_status = 'explicit_increase' AND scope_status = 'in_dataset' AS hard,
        CASE WHEN exact_route THEN 'full' WHEN peer_hit THEN 'premium'
             WHEN upper_bound IS NOT NULL AND own_pct > upper_bound + 2 THEN 'small' ELSE 'full' END AS cover
      FROM pairs) g"""
CTE["picked"] = f"""
SELECT {K}, note_id AS selected_note_id FROM (
  SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY exact_route DESC, overlap_days DESC,
         (upper_bound IS NOT NULL) DESC, note_id) AS place FROM gated WHERE evidence_level = 'full') s WHERE place = 1"""
CTE["decisions"] = f"""
SELECT c.route, c.route_type, c.week_of,
  CASE WHEN selected_note_id IS NOT NULL THEN 'justified' WHEN n_partial > 0 THEN 'partially_explained'
       ELSE 'unexplained' END AS verdict,
  selected_note_id, first_partial AS first_supporting_note_id, coalesce(n_full, 0) AS full_note_count,
  coalesce(n_partial, 0) AS supporting_note_count
FROM cand c LEFT JOIN picked USING (route, route_type, week_of)
LEFT JOIN (SELECT {K}, count(*) FILTER (evidence_level = 'full') AS n_full,
             count(*) FILTER (evidence_level = 'partial') AS n_partial,
             min(note_id) FILTER (evidence_level = 'partial') AS first_partial FROM gated GROUP BY ALL) g
  USING (route, route_type, week_of)"""
CTE["reasoned"] = f"""
SELECT *, CASE verdict WHEN 'justified' THEN selected_note_id || {q(x.JUSTIFIED_TEXT)}
    WHEN 'partially_explained' THEN first_supporting_note_id || {q(x.PARTIAL_TEXT)}
    ELSE {q(x.UNEXPLAINED_TEXT)} END AS reason,
  CASE verdict WHEN 'justified' THEN selected_note_id WHEN 'partially_explained' THEN first_supporting_note_id
    ELSE '' END AS cited FROM decisions"""
CTE["packets"] = f"""
SELECT {K}, note_id, 'supporting' AS role FROM gated WHERE evidence_level = 'partial'
UNION ALL SELECT {K}, selected_note_id, 'selected' FROM decisions WHERE selected_note_id IS NOT NULL"""
CTE["packet_facts"] = "SELECT p.*, c.* EXCLUDE (note_id) FROM packets p JOIN compiled c USING (note_id)"
CTE["displayed"] = f"""
SELECT {K}, printf('%.2f', cost_per_tonne_km) AS cost_text, printf('%+.1f', own_pct) || {q(OWN_SUFFIX)} AS own_text,
  printf('%+.1f', peer_pct) || {q(PEER_SUFFIX)} AS peer_text FROM cand"""
CTE["reviewed"] = f"""
SELECT route, week_of::VARCHAR AS week_of, cost_text AS cost_per_tonne_km, own_text AS vs_own_history,
  coalesce(peer_text, {q(PEER_UNAVAILABLE_TEXT)}) AS vs_similar_routes,
  CASE WHEN verdict = 'justified' THEN 'No (justified)' ELSE 'Yes' END AS flagged,
  CASE WHEN verdict = 'justified' THEN selected_note_id ELSE '' END AS matched_note_id,
  CASE verdict WHEN 'justified' THEN 'Valid context evidence ' || selected_note_id ||
      ' applies to this route and week and explicitly supports a transport-cost increase.'
    WHEN 'partially_explained' THEN 'Context note ' || first_supporting_note_id || ' may explain the own-history rise, '
      || 'but its all-routes scope does not explain the route-specific peer premium.'
    ELSE {q(rep.REVIEW_UNEXPLAINED)} END AS review_reason, reason
FROM displayed JOIN reasoned USING (route, route_type, week_of)"""
CTE["viewed"] = """
SELECT m.*, d.verdict, d.selected_note_id, d.first_supporting_note_id, d.supporting_note_count, d.reason,
  m.route || '|' || m.week_of::VARCHAR AS candidate_key,
  CASE WHEN own_hit AND peer_hit THEN 'both' WHEN own_hit THEN 'own_history' ELSE 'peer' END AS trigger
FROM cand m JOIN reasoned d USING (route, route_type, week_of)"""

# --- decomposition ---
CTE["numbered"] = f"SELECT {K}, cost_per_tonne_km, row_number() OVER (PARTITION BY route, route_type ORDER BY week_of) AS n FROM weekly"
CTE["open_cases"] = f"SELECT c.* FROM cand c JOIN decisions d USING (route, route_type, week_of) WHERE verdict = 'unexplained'"
CTE["refs"] = f"""
SELECT c.route, c.route_type, c.week_of, w.week_of AS ref_week, w.cost_per_tonne_km AS ref_rate
FROM open_cases c JOIN numbered me USING (route, route_type, week_of)
  JOIN numbered w ON w.route = c.route AND w.route_type = c.route_type AND w.n BETWEEN me.n - 8 AND me.n - 1"""
CTE["shares"] = f"""
SELECT *, tk / sum(tk) OVER (PARTITION BY {K}, lens) AS share, fr / tk AS rate FROM (
  SELECT {K}, 'transporter' AS lens, transporter AS category, count(DISTINCT shipment_id) AS shipments,
         sum(tonne_km)::DOUBLE AS tk, sum(freight_cost_inr)::DOUBLE AS fr FROM shipments GROUP BY ALL
  UNION ALL
  SELECT {K}, 'material', material, count(DISTINCT shipment_id), sum(tonne_km)::DOUBLE, sum(freight_cost_inr)::DOUBLE
  FROM shipments GROUP BY ALL) s"""
CTE["sides"] = f"""
SELECT coalesce(a.route, b.route) AS route, coalesce(a.route_type, b.route_type) AS route_type,
  coalesce(a.week_of, b.week_of) AS week_of, coalesce(a.ref_week, b.ref_week) AS ref_week,
  coalesce(a.lens, b.lens) AS lens, coalesce(a.category, b.category) AS category,
  a.shipments AS now_n, a.share AS now_share, a.rate AS now_rate,
  b.shipments AS past_n, b.share AS past_share, b.rate AS past_rate
FROM (SELECT f.*, s.lens, s.category, s.shipments, s.share, s.rate FROM refs f JOIN shares s USING (route, route_type, week_of)) a
FULL JOIN (SELECT f.*, s.lens, s.category, s.shipments, s.share, s.rate FROM refs f JOIN shares s
           ON s.route = f.route AND s.route_type = f.route_type AND s.week_of = f.ref_week) b
  ON a.route = b.route AND a.route_type = b.route_type AND a.week_of = b.week_of AND a.ref_week = b.ref_week
     AND a.lens = b.lens AND a.category = b.category"""
CTE["effects"] = f"""
SELECT e.*, mix + rate + entry + exit AS net FROM (
  SELECT {K}, lens, category, coalesce(max(now_n), 0) AS now_n, coalesce(sum(past_n), 0)::BIGINT AS past_n,
    count(past_n) AS weeks, max(now_share) AS now_share, max(now_rate) AS now_rate,
    coalesce(sum(past_share), 0) / any_value(n) AS past_share, avg(past_rate) AS past_rate,
    sum(CASE WHEN now_n IS NOT NULL AND past_n IS NOT NULL THEN 0.5::DOUBLE * (now_share - past_share) * (now_rate + past_rate) ELSE 0 END) / any_value(n) AS mix,
    sum(CASE WHEN now_n IS NOT NULL AND past_n IS NOT NULL THEN 0.5::DOUBLE * (now_rate - past_rate) * (now_share + past_share) ELSE 0 END) / any_value(n) AS rate,
    sum(CASE WHEN past_n IS NULL THEN now_share * now_rate ELSE 0 END) / any_value(n) AS entry,
    sum(CASE WHEN now_n IS NULL THEN -past_share * past_rate ELSE 0 END) / any_value(n) AS exit
  FROM sides JOIN (SELECT {K}, count(*) AS n FROM refs GROUP BY ALL) c USING (route, route_type, week_of)
  GROUP BY ALL) e"""
CTE["contributions"] = f"""
SELECT *, abs(net) / nullif(sum(abs(net)) OVER (PARTITION BY {K}, lens), 0) * 100 AS pct,
  CASE WHEN net > 1e-9 THEN 'increases_gap' WHEN net < -1e-9 THEN 'offsets_gap' ELSE 'neutral' END AS direction,
  CASE WHEN (entry <> 0 OR exit <> 0) AND (now_n = 0 OR weeks = 0) THEN 'transition_only'
       WHEN now_n >= 2 AND past_n >= 3 AND weeks >= 3 THEN 'strong' ELSE 'limited' END AS support_level FROM effects"""
CTE["leads"] = f"""
SELECT * FROM (SELECT *, CASE WHEN net > 0 THEN 'lead' ELSE 'offset' END AS kind,
    row_number() OVER (PARTITION BY {K}, lens, net > 0 ORDER BY abs(net) DESC, category) AS lead_rank
  FROM contributions WHERE abs(net) >= 0.01 AND coalesce(pct, 0) >= 10) l
WHERE lead_rank <= CASE WHEN kind = 'lead' THEN 3 ELSE 2 END"""
CTE["opmetrics"] = f"""
SELECT {K}, unnest(['shipment_count', 'average_load_tonnes', 'weighted_average_distance_km', 'total_quantity_tonnes',
    'total_tonne_km', 'freight_cost_per_shipment', 'shipments_per_100_tonnes']) AS metric,
  unnest([shipment_count::DOUBLE, total_quantity_tonnes / shipment_count, total_tonne_km / total_quantity_tonnes,
    total_quantity_tonnes, total_tonne_km, total_freight_cost_inr / shipment_count,
    shipment_count / total_quantity_tonnes * 100]) AS value FROM weekly"""
CTE["compared"] = f"""
SELECT {K}, metric, m.value, past, m.value - past AS change, (m.value - past) / nullif(past, 0) * 100 AS pct
FROM opmetrics m JOIN (SELECT f.route, f.route_type, f.week_of, o.metric, avg(o.value) AS past
  FROM refs f JOIN opmetrics o ON o.route = f.route AND o.route_type = f.route_type AND o.week_of = f.ref_week
  GROUP BY ALL) b USING (route, route_type, week_of, metric)"""

# --- retrieval over benchmark items and documents ---
for _side, _table, _id in (("q", "benchmark", "item_id"), ("d", "documents", "doc_id")):
    CTE[f"{_side}_words"] = f"SELECT {_id} AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM {_table}"
    CTE[f"{_side}_terms"] = f"""
SELECT id, term, count(*) AS tf FROM (
  SELECT id, unnest(w) AS term FROM {_side}_words UNION ALL
  SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {_side}_words) t
GROUP BY ALL"""
    CTE[f"{_side}_weights"] = f"""
SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM (
  SELECT id, term, (1 + ln(tf)) * idf AS w FROM {_side}_terms JOIN idf USING (term)) t"""
CTE["idf"] = """
SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM d_terms GROUP BY term"""
CTE["sparse_scores"] = """
SELECT item_id AS query_id, d.doc_id, round(coalesce(s, 0), 12) AS score FROM benchmark CROSS JOIN (SELECT doc_id FROM documents) d
LEFT JOIN (SELECT a.id AS qid, b.id AS did, sum(a.weight * b.weight) AS s FROM q_weights a JOIN d_weights b USING (term)
           GROUP BY ALL) p ON qid = item_id AND did = d.doc_id"""
CTE["sparse_top"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sparse_scores) t
WHERE rank <= 5"""
CTE["unit"] = """
SELECT vec_id, label, list_transform(v, lambda e: e / n) AS u FROM (
  SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda e: e * e))) AS n
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) a) b"""
CTE["dense_scores"] = """
SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.u, b.u), 12) AS score, a.label = b.label AS relevant
FROM unit a CROSS JOIN unit b"""
CTE["dense_top"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense_scores) t
WHERE rank <= 5"""
CTE["item_dense_top"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT s.query_id, s.doc_id, s.score FROM dense_scores s JOIN benchmark ON item_id = query_id
  JOIN documents d ON d.doc_id = s.doc_id) t) u WHERE rank <= 5"""
CTE["fused"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC,
    least(coalesce(sparse_rank, 2147483648), coalesce(dense_rank, 2147483648)), doc_id) AS fused_rank FROM (
  SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS sparse_rank,
    b.rank AS dense_rank, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 12) AS fused_score
  FROM sparse_top a FULL JOIN item_dense_top b ON a.query_id = b.query_id AND a.doc_id = b.doc_id) f) g
WHERE fused_rank <= 5"""

# --- explanation texts ---
CTE["texts"] = workload.TEXTS_SQL.format(decided="reasoned")
_ID, _NUM = q("(?i)" + x.NOTE_ID), q("(?i)" + x.NUMBER.replace("(?<![A-Za-z])", ""))
_numbers = lambda t: (f"list_distinct(list_transform(regexp_extract_all(regexp_replace(regexp_replace({t}, {_ID}, '', 'g'), "
                      f"{q(x.DATE_TEXT)}, '', 'g'), {_NUM}), lambda v: ltrim(replace(lower(regexp_replace(v, '\\s+', '', 'g')), "
                      "'percent', '%'), '+')))")
CTE["evidence_facts"] = f"""
SELECT {K}, list_distinct(list(note_id)) AS allowed, list(note_id) FILTER (role = 'supporting') AS support,
  list_concat(list(effective_from::VARCHAR), list(effective_to::VARCHAR)) AS dates,
  flatten(list({_numbers("coalesce(magnitude_text, '')")})) AS numbers
FROM packet_facts GROUP BY {K}"""
CTE["text_facts"] = f"""
SELECT t.*, d.verdict AS want, d.selected_note_id AS chosen, trim(t.reason) AS body,
  list_filter(string_split(cited_text, ','), lambda v: v <> '') AS cited_ids,
  list_distinct(list_transform(regexp_extract_all(t.reason, {_ID}), lambda v: upper(v))) AS prose,
  coalesce(e.allowed, []) AS allowed, coalesce(e.support, []) AS support,
  list_concat([request_week::VARCHAR, (request_week + 6)::VARCHAR], coalesce(e.dates, [])) AS ok_dates,
  list_concat({_numbers("concat_ws(' ', cost_text, own_text, peer_text)")}, coalesce(e.numbers, [])) AS ok_numbers
FROM texts t JOIN decisions d ON d.route = request_route AND d.route_type = request_route_type AND d.week_of = request_week
JOIN displayed s ON s.route = request_route AND s.route_type = request_route_type AND s.week_of = request_week
LEFT JOIN evidence_facts e ON e.route = request_route AND e.route_type = request_route_type AND e.week_of = request_week"""
CTE["text_claims"] = f"""
SELECT *, list_filter({_numbers("body")}, lambda v: NOT list_contains(ok_numbers, v)) AS bad_numbers,
  list_filter(list_distinct(regexp_extract_all(body, {q(x.DATE_TEXT)})), lambda v: NOT list_contains(ok_dates, v)) AS bad_dates
FROM text_facts"""
_any = lambda terms: "(" + " OR ".join(f"contains(lower(body), {q(t)})" for t in terms) + ")"
CTE["text_codes"] = f"""
SELECT text_id, concat_ws(',',
  CASE WHEN route <> request_route OR week_of <> request_week THEN 'identity_mismatch' END,
  CASE WHEN {_any(x.INTERNAL_TERMS)} THEN 'internal_language_leakage' END,
  CASE WHEN len(list_distinct(cited_ids)) <> len(cited_ids)
    OR (want = 'partially_explained' AND (len(cited_ids) = 0 OR NOT list_has_all(support, cited_ids) OR NOT list_has_any(prose, cited_ids)))
    OR (want = 'unexplained' AND (len(cited_ids) > 0 OR len(prose) > 0)) THEN 'invalid_citation_set' END,
  CASE WHEN body = '' THEN 'reason_empty' END,
  CASE WHEN body <> reason OR regexp_matches(body, '[\\n\\r]') OR regexp_matches(body, {q(x.MARKDOWN)})
    OR starts_with(body, '{{') OR starts_with(body, '[') THEN 'reason_format_violation' END,
  CASE WHEN length(body) < 40 OR length(body) > 400 THEN 'reason_length_violation' END,
  CASE WHEN want = 'justified' AND NOT (cited_ids = [chosen] AND list_contains(prose, chosen)) THEN 'required_note_id_missing' END,
  CASE WHEN NOT list_has_all(allowed, list_concat(cited_ids, prose)) THEN 'unauthorized_note_id' END,
  CASE WHEN len(bad_numbers) + len(bad_dates) > 0 THEN 'unsupported_numeric_claim' END,
  CASE WHEN (want = 'partially_explained' AND {_any(x.PARTIAL_CONFLICTS)}) OR (want = 'justified' AND {_any(x.JUSTIFIED_CONFLICTS)})
    OR contains(lower(body), 'proved caus') THEN 'verdict_language_conflict' END,
  CASE WHEN verdict <> want THEN 'verdict_mismatch' END) AS failure_codes FROM text_claims"""


def build(select: str) -> str:
    """Prefix a SELECT with the CTEs it needs, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if name not in order and re.search(rf"\b{name}\b", text) and CTE[name] is not text:
                visit(CTE[name])
                if name not in order:
                    order.append(name)

    visit(select)
    body = ",\n".join(f"{n} AS MATERIALIZED ({CTE[n].strip()})" for n in order)
    return f"WITH {body}\n{select}" if order else select
