"""Template reasons, explanation records and audits, grounding checks, token cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import fixed_text, flag, iso, strip
from ..schemas import KEY
from .candidates import own_display, peer_display

# Fixed values of the text contract.
PROMPT_VERSION = "grounded-reason-v1"
UNEXPLAINED_TEXT = (
    "No validated context note explains the increase for this route and week, "
    "so the candidate remains flagged for review.")
JUSTIFIED_TEXT = (
    " provides route-specific evidence of a transport-cost increase during this week, "
    "so the candidate is marked No (justified).")
PARTIAL_TEXT = (
    " may explain part of the own-history rise, but its all-routes scope does not explain "
    "this route's premium over same-week peers; the candidate remains flagged.")
NOTE_ID = r"\bN\d+\b"
DATE_TEXT = r"\b\d{4}-\d{2}-\d{2}\b"
NUMBER = (
    r"(?<![A-Za-z])(?:INR\s*)?[+-]?\d+(?:\.\d+)?"
    r"(?:\s*(?:%|percent|km|kilomet(?:er|re)s?))?")
MARKDOWN = r"(^|\s)(?:#{1,6}\s|[-*+]\s|```|\|[^\n]*\|)"
PARTIAL_CONFLICTS = (
    "fully explained", "fully justified", "candidate cleared", "no longer flagged", "normal cost")
JUSTIFIED_CONFLICTS = ("no evidence", "remains unexplained", "remains flagged")
INTERNAL_TERMS = (
    "llm", "embedding score", "rrf", "prompt", "system message", "evidence gate failed",
    "retrieval top-k")
MINIMUM_LENGTH = 40
MAXIMUM_LENGTH = 400


# --- requests -----------------------------------------------------------------------

def grounded_request(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Display fields and authority of one request per candidate. The accepted notes
    are the rows of :func:`request_evidence` with the same key."""
    return candidates.join(decisions, list(KEY)).select(
        *KEY, F.date_add("week_of", 6).alias("week_end"),
        F.lit(PROMPT_VERSION).alias("prompt_version"),
        fixed_text(F.col("cost_per_tonne_km"), 2).alias("cost_per_tonne_km_display"),
        own_display().alias("vs_own_history_display"),
        peer_display().alias("vs_similar_routes_display"),
        "verdict", F.when(F.col("verdict") == "justified", "No (justified)").otherwise("Yes").alias("flagged"),
        "selected_note_id", "first_supporting_note_id", "supporting_note_count")


def request_evidence(packets: DataFrame) -> DataFrame:
    """Accepted evidence items; the selected one sorts first (role_order)."""
    return packets.select(
        *KEY, (F.col("role") != "selected").cast("int").alias("role_order"), "role", "note_id",
        "scope_type", "effective_from", "effective_to", "event_type", "impact_direction",
        "cost_impact_status", "magnitude_text", "original_text")


def evidence_digest(evidence: DataFrame) -> DataFrame:
    """Order-free digest of a request's evidence, of fixed size however many notes."""
    content = [c for c in evidence.columns if c not in (*KEY, "role_order")]
    text = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    piece = lambda at: F.conv(F.substring(text, at, 15), 16, 10).cast("bigint")
    return evidence.groupBy(*KEY).agg(
        F.concat_ws("-", F.count(F.lit(1)), F.bit_xor(piece(1)), F.bit_xor(piece(16))).alias("evidence_digest"))


def request_key(requests: DataFrame, digests: DataFrame, provider: str, model: str) -> DataFrame:
    """Content hash of request, evidence and provider identity."""
    keyed = requests.join(digests, list(KEY), "left")
    payload = F.to_json(F.struct(
        F.lit(provider).alias("provider"), F.lit(model).alias("model"),
        *[F.col(c).cast("string").alias(c) for c in (
            *KEY, "week_end", "prompt_version", "cost_per_tonne_km_display", "vs_own_history_display",
            "vs_similar_routes_display", "verdict", "flagged", "selected_note_id")],
        F.coalesce("evidence_digest", F.lit("0")).alias("evidence")), {"ignoreNullFields": "false"})
    return keyed.select(*KEY, F.sha2(payload, 256).alias("request_key"))


def cache_lookup(keys: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored explanations by content key, with integrity and duplicate flags.

    ``stored`` is (request_key, prompt_version, reason, entry_sha256). Duplicates are
    counted before the join, so a repeated key never multiplies a request.
    """
    whole = F.sha2(F.concat_ws("|", "request_key", "prompt_version", "reason"), 256)
    per_key = stored.groupBy("request_key").agg(
        F.count(F.lit(1)).alias("entries"),
        F.min("reason").alias("reason"),
        F.count_if(~flag(whole == F.col("entry_sha256"))).alias("broken"),
        F.count_if(~flag(F.col("prompt_version") == PROMPT_VERSION)).alias("other_version"))
    found = keys.join(per_key, "request_key", "left")
    bad = (F.col("entries") > 1) | (F.col("broken") > 0) | (F.col("other_version") > 0)
    return found.select(
        *KEY, "request_key",
        F.when(F.col("entries").isNull(), "miss").when(bad, "invalid").otherwise("hit").alias("cache_state"),
        F.coalesce(F.col("entries") > 1, F.lit(False)).alias("duplicate_key"),
        F.when(F.col("entries").isNotNull() & ~bad, F.col("reason")).alias("reason"))


# --- template records ---------------------------------------------------------------

def template_reason(decisions: DataFrame) -> DataFrame:
    """Verdict-based reason and cited ids. The wording follows the verdict only: a
    global note that explains fully is still called route-specific."""
    none = F.array().cast("array<string>")
    verdict = F.col("verdict")
    return decisions.withColumns({
        "reason": F.when(verdict == "justified", F.concat("selected_note_id", F.lit(JUSTIFIED_TEXT)))
            .when(verdict == "partially_explained", F.concat("first_supporting_note_id", F.lit(PARTIAL_TEXT)))
            .otherwise(UNEXPLAINED_TEXT),
        "cited_note_ids": F.when(verdict == "justified", F.array("selected_note_id"))
            .when(verdict == "partially_explained", F.array("first_supporting_note_id")).otherwise(none)})


USAGE = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens")


def explanation_records(decisions: DataFrame, keys: DataFrame) -> DataFrame:
    """Final record per candidate in template mode; the other modes supply their own."""
    zero = F.lit(0).cast("bigint")
    text = lambda v: F.lit(v).cast("string")
    return template_reason(decisions).join(keys, list(KEY), "left").select(
        *KEY, "verdict", "selected_note_id", "first_supporting_note_id", "supporting_note_count",
        "reason", "cited_note_ids", F.lit("template").alias("explanation_source"),
        text(None).alias("provider"), text(None).alias("model"),
        F.lit(PROMPT_VERSION).alias("prompt_version"), F.col("request_key").alias("cache_key"),
        F.lit(False).alias("cache_hit"), zero.alias("provider_attempts"),
        F.lit("not_applicable").alias("validation_status"),
        F.array().cast("array<string>").alias("failure_codes"),
        F.struct(*[zero.alias(u) for u in USAGE]).alias("usage"),
        F.lit(0).cast("decimal(38,12)").alias("estimated_cost_usd"),
        F.lit(None).cast("date").alias("pricing_snapshot_date"), zero.alias("latency_ms"))


def explanation_audit(records: DataFrame) -> DataFrame:
    """The record without its text, which is replaced by its hash."""
    return records.withColumn("reason_sha256", F.sha2("reason", 256)).drop("reason")


def token_cost(usage: DataFrame, input_rate, cached_rate, output_rate) -> DataFrame:
    """Exact decimal cost per row. Rates are per million tokens; NULL without rates.
    A missing or zero cached rate means the input rate."""
    d = lambda v: F.lit(None if v is None else str(v)).cast("decimal(12,6)")
    n = lambda c: c.cast("decimal(14,0)")
    total_in, cached, out = (F.col(c) for c in ("input_tokens", "cached_input_tokens", "output_tokens"))
    cached_price = d(cached_rate) if cached_rate else d(input_rate)
    millions = (n(total_in - cached) * d(input_rate) + n(cached) * cached_price + n(out) * d(output_rate))
    cost = (millions * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(38,12)")
    if input_rate is None or output_rate is None:
        cost = F.lit(None).cast("decimal(38,12)")
    return usage.withColumn(
        "estimated_cost_usd",
        F.when(total_in + out == 0, F.lit(0).cast("decimal(38,12)")).otherwise(cost))


def usage_report(audits: DataFrame) -> DataFrame:
    """Explanation audit rolled up to one row. The sets hold the few configured
    providers, models and price dates."""
    u = lambda c: F.sum(F.coalesce(F.col("usage")[c], F.lit(0)))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    rolled = audits.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(F.col("verdict") != "unexplained").alias("eligible_requests"),
        F.sum("provider_attempts").alias("provider_calls"),
        *[u(c).alias(c) for c in USAGE],
        F.count_if((F.size("failure_codes") > 0) & (F.col("provider_attempts") > 0)).alias("failed_or_refused_calls"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.count_if(~F.col("cache_hit") & (F.col("provider_attempts") > 0)).alias("cache_misses"),
        F.count_if(F.col("explanation_source") == "fallback").alias("fallback_count"),
        # with one unknown cost among the calls the total is unknown too
        F.when(F.count_if(F.col("estimated_cost_usd").isNull() & (F.col("provider_attempts") > 0)) == 0, F.sum(
            F.coalesce("estimated_cost_usd", F.lit(0).cast("decimal(38,12)")))).alias("_cost"),
        F.bool_and(F.col("explanation_source") == "template").alias("_template"),
        names("provider").alias("_providers"), names("model").alias("_models"),
        names(iso(F.col("pricing_snapshot_date"))).alias("_dates"))
    calls = F.col("provider_calls")
    return rolled.select(
        "record_count", F.when(F.col("_template"), "template").otherwise("mixed").alias("run_mode"),
        F.when((F.col("_providers") == "") & (calls == 0), "template (no hosted provider)")
         .otherwise(F.col("_providers")).alias("model_provider_identity"),
        F.nullif("_models", F.lit("")).alias("model_identity"),
        F.nullif("_dates", F.lit("")).alias("pricing_snapshot_date"),
        "eligible_requests", "provider_calls", *USAGE, "failed_or_refused_calls", "cache_hits",
        "cache_misses", "fallback_count",
        F.when(calls == 0, "not_applicable").when((F.col("_dates") != "") & F.col("_cost").isNotNull(), F.format_string(
            "%s", F.bround("_cost", 6).cast("decimal(38,6)").cast("string")))
         .otherwise("not_available").alias("estimated_total_cost_usd"),
        F.lit("USD").alias("currency"),
        F.when(calls == 0, "No hosted calls occurred; model pricing was not required or configured.")
         .otherwise("Configured model rates and pricing snapshot date.").alias("cost_basis"))


# --- grounding ----------------------------------------------------------------------

def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit("(?iU)" + pattern), F.lit(0))


def numeric_claims(text: Column) -> Column:
    """Distinct normalised numbers of a text, note ids and dates taken out first."""
    bare = F.regexp_replace(F.regexp_replace(text, "(?iU)" + NOTE_ID, ""), DATE_TEXT, "")
    normal = lambda x: F.regexp_replace(
        F.regexp_replace(F.lower(F.regexp_replace(x, r"(?U)\s+", "")), "percent", "%"), r"^\++", "")
    return F.array_distinct(F.transform(_all(bare, NUMBER), normal))


def approved_claims(packets: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(key, kind, value) facts a request's evidence allows, each once; only those among ``asked``
    (same columns) if it is given. Facts are as many as cited notes, ``asked`` as many as claims."""
    date_text = lambda c: F.struct(F.lit("date").alias("kind"), iso(F.col(c)).alias("value"))
    facts = F.concat(
        F.array(
            F.struct(F.lit("note").alias("kind"), F.col("note_id").alias("value")),
            F.struct(F.concat(F.col("role"), F.lit("_note")).alias("kind"), F.col("note_id").alias("value")),
            date_text("effective_from"), date_text("effective_to")),
        F.transform(F.coalesce(numeric_claims(F.col("magnitude_text")), F.array().cast("array<string>")),
                    lambda v: F.struct(F.lit("number").alias("kind"), v.alias("value"))))
    allowed = packets.select(*KEY, F.inline_outer(facts)).where("value IS NOT NULL")
    if asked is not None:
        allowed = allowed.join(asked.select(*KEY, "kind", "value").distinct(), [*KEY, "kind", "value"], "left_semi")
    return allowed.distinct()


def _with_requests(texts: DataFrame, requests: DataFrame) -> DataFrame:
    """``texts`` answer the request (request_route, request_route_type, request_week)."""
    wanted = requests.select(
        F.col("route").alias("request_route"), F.col("route_type").alias("request_route_type"),
        F.col("week_of").alias("request_week"), F.col("verdict").alias("request_verdict"),
        "selected_note_id", "cost_per_tonne_km_display", "vs_own_history_display",
        "vs_similar_routes_display")
    displays = F.array_compact(F.array(
        "cost_per_tonne_km_display", "vs_own_history_display", "vs_similar_routes_display"))
    return (
        texts.join(wanted, ["request_route", "request_route_type", "request_week"])
        .withColumns({
            "_body": strip(F.col("reason")),
            "_prose": F.array_distinct(F.transform(_all(F.col("reason"), NOTE_ID), F.upper)),
            "_own_numbers": F.array_distinct(F.flatten(F.transform(displays, numeric_claims))),
            "_own_dates": F.array(iso(F.col("request_week")), iso(F.date_add("request_week", 6))),
        }))


def unapproved_claims(joined: DataFrame, packets: DataFrame) -> DataFrame:
    """Claims of the texts that neither the request displays nor the evidence support.

    Claims and approved facts meet in an anti join on (key, kind, value), so no
    candidate's evidence is ever collected into one row. Facts that nothing claims go before it.
    """
    tag = lambda values, kind: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    claims = F.concat(
        tag(F.array_distinct(F.concat("cited_note_ids", "_prose")), "note"),
        tag(F.when(F.col("request_verdict") == "partially_explained", F.array_distinct("cited_note_ids"))
            .otherwise(F.array().cast("array<string>")), "supporting_note"),
        tag(F.array_except(F.array_distinct(F.regexp_extract_all("_body", F.lit(DATE_TEXT), F.lit(0))),
                           F.col("_own_dates")), "date"),
        tag(F.array_except(numeric_claims(F.col("_body")), F.col("_own_numbers")), "number"))
    request = [F.col("request_route").alias("route"), F.col("request_route_type").alias("route_type"), F.col("request_week").alias("week_of")]
    made = joined.select("text_id", "request_route", "request_route_type", "request_week", F.inline_outer(claims)).where("value IS NOT NULL")
    facts = approved_claims(packets, made.select(*request, "kind", "value")).select(
        F.col("route").alias("request_route"), F.col("route_type").alias("request_route_type"),
        F.col("week_of").alias("request_week"), "kind", "value")
    return made.join(facts, ["request_route", "request_route_type", "request_week", "kind", "value"], "left_anti")


def numeric_claim_check(texts: DataFrame, requests: DataFrame, packets: DataFrame) -> DataFrame:
    """Per text: how many of its numbers and dates nothing supports."""
    joined = _with_requests(texts, requests)
    bad = unapproved_claims(joined, packets).groupBy("text_id").agg(
        F.count_if(F.col("kind") == "number").alias("n"), F.count_if(F.col("kind") == "date").alias("d"))
    n, d = F.coalesce("n", F.lit(0)), F.coalesce("d", F.lit(0))
    return joined.select("text_id").join(bad, "text_id", "left").select(
        "text_id", n.alias("unsupported_numbers"), d.alias("unsupported_dates"),
        (n + d == 0).alias("supported"))


def grounding_validation(texts: DataFrame, requests: DataFrame, packets: DataFrame,
                         minimum_length: int = MINIMUM_LENGTH,
                         maximum_length: int = MAXIMUM_LENGTH) -> DataFrame:
    """Sorted failure codes per text; a text without a code is accepted.

    ``texts``: text_id, request_route, request_route_type, request_week, route,
    week_of, verdict, cited_note_ids, reason.
    """
    joined = _with_requests(texts, requests)
    bad = unapproved_claims(joined, packets).groupBy("text_id").agg(*[
        F.count_if(F.col("kind") == k).alias(f"_{k}") for k in ("note", "supporting_note", "date", "number")])
    rows = joined.join(bad, "text_id", "left")
    some = lambda k: F.coalesce(F.col(f"_{k}"), F.lit(0)) > 0
    verdict, cited, prose = F.col("request_verdict"), F.col("cited_note_ids"), F.col("_prose")
    body, low = F.col("_body"), F.lower("_body")
    contains = lambda terms: reduce(lambda a, b: a | b, [low.contains(t) for t in terms])
    partial, justified = verdict == "partially_explained", verdict == "justified"
    chosen = F.col("selected_note_id")
    one_cited = flag((F.size(cited) == 1) & (F.try_element_at(cited, F.lit(1)) == chosen))
    codes = F.array(
        F.when((F.col("route") != F.col("request_route")) | (F.col("week_of") != F.col("request_week")),
               "identity_mismatch"),
        F.when(F.col("verdict") != verdict, "verdict_mismatch"),
        F.when((F.size(F.array_distinct(cited)) != F.size(cited))
               | (partial & ((F.size(cited) == 0) | some("supporting_note") | ~F.arrays_overlap(prose, cited)))
               | (~partial & ~justified & ((F.size(cited) > 0) | (F.size(prose) > 0))),
               "invalid_citation_set"),
        F.when(some("note"), "unauthorized_note_id"),
        F.when(justified & ~(one_cited & flag(F.array_contains(prose, chosen))), "required_note_id_missing"),
        F.when(body == "", "reason_empty"),
        F.when((F.length(body) < minimum_length) | (F.length(body) > maximum_length), "reason_length_violation"),
        F.when((body != F.col("reason")) | body.rlike(r"[\n\r]") | body.rlike(MARKDOWN)
               | body.rlike(r"\p{Cc}") | body.startswith("{") | body.startswith("["),
               "reason_format_violation"),
        F.when((partial & contains(PARTIAL_CONFLICTS)) | (justified & contains(JUSTIFIED_CONFLICTS))
               | low.contains("proved caus"), "verdict_language_conflict"),
        F.when(contains(INTERNAL_TERMS), "internal_language_leakage"),
        F.when(some("number") | some("date"), "unsupported_numeric_claim"))
    found = F.array_sort(F.array_compact(codes))
    return rows.select(
        "text_id", (F.size(found) == 0).alias("accepted"), found.alias("failure_codes"))
