"""Free-text notes compiled to typed claims, as column expressions in one stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import computed_once, failures, flag, strip
from ..schemas import COMPILED_NOTE_SCHEMA, NOTE_COLUMNS, require_columns

# The phrase patterns and their order are the meaning of the rules.
ROUTE_SHAPE = r"^[A-Za-z][A-Za-z ]*-[A-Za-z][A-Za-z ]*$"
EXCLUSION = (
    r"\b(?:affected routes? (?:are|is) not part of this dataset|"
    r"outside this dataset|does not apply to routes? in this dataset)\b")
MONTH = (
    r"september|february|november|december|january|october|august|march|april|"
    r"june|july|sept|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec")
EXPLICIT_RANGE = (
    rf"\bfrom\s+({MONTH})\.?\s+(\d{{1,2}})(?:,?\s+(\d{{4}}))?"
    rf"\s+(?:to|through)\s+({MONTH})\.?\s+(\d{{1,2}})(?:,?\s+(\d{{4}}))?\b")
ABOUT_A_WEEK = r"\bfor\s+(?:(?:about|approximately|roughly)\s+)?(?:a|one)\s+week\b"
THIS_QUARTER = r"\bthis\s+quarter\b"
THIS_WEEK = r"\b(?:festival\s+week|this\s+week)\b"
CONTINUING = r"\b(?:starting\s+this\s+week|was\s+(?:introduced|commissioned))\b"
AFTER_COMPLETION = r"\b(?:returned\s+to\s+normal|after\b.{0,100}\b(?:was\s+)?completed)\b"
TIME_HINT = r"\b(?:week|weeks|month|months|quarter|until|since|from|through)\b"

EVENTS = (
    ("recovery_or_normalization", r"\breturned\s+to\s+normal\b"),
    ("festival_demand", r"\bfestival\b"),
    ("fuel_price_change", r"\b(?:diesel|petrol|fuel)\s+prices?\b"),
    ("regulatory_compliance", r"\b(?:mandate|compliance)\b"),
    ("road_improvement", r"\b(?:improved\s+road\s+conditions|resurfacing)\b"),
    ("road_maintenance", r"\b(?:road|highway)\s+maintenance\b"),
    ("weather_disruption", r"\b(?:flood(?:ing|-related)?|cyclone|storm|heavy\s+rain)\b"),
    ("toll_or_infrastructure", r"\b(?:toll\s+plaza|toll|infrastructure)\b"),
    ("normal_operations",
     r"\b(?:no\s+significant\s+disruptions|movement\s+remained\s+normal|normal\s+operations)\b"),
    ("capacity_or_demand_condition", r"\b(?:freight\s+capacity|truck\s+availability|demand)\b"),
    ("other", r"\b(?:delay|disruption|closure|construction)\b"),
)
NO_RATE_CHANGE = (
    r"\b(?:without\s+a\s+rate\s+change|no\s+change\s+in\s+freight\s+rates|"
    r"absorbed\s+by\s+transporters)\b")
NO_MATERIAL_IMPACT = (
    r"\b(?:costs?\s+(?:were\s+)?not\s+significantly\s+affected|"
    r"no\s+material\s+impact\s+on\s+(?:transport|freight)\s+costs?)\b")
STABLE = (
    r"\b(?:remained\s+stable|no\s+major\s+disruptions|no\s+significant\s+disruptions|"
    r"remained\s+normal|returned\s+to\s+normal|normal\s+operations)\b")
DECREASE = (
    r"\b(?:(?:transport(?:ation)?|freight|trip)\s+(?:costs?|rates?)\s+"
    r"(?:fell|decreased|declined)|(?:reduced|lower)\s+(?:transport(?:ation)?|freight|trip)"
    r"\s+(?:costs?|rates?))\b")
INCREASE = (
    r"\b(?:higher\s+trip\s+costs?|pushing\s+up\s+transportation\s+costs?|"
    r"(?:temporary\s+)?surcharge\s+applied\s+by\s+transporters|"
    r"freight\s+rates?\s+(?:increased|rose)|"
    r"transport(?:ation)?\s+costs?\s+(?:increased|rose))\b")
COST_CONTEXT = (
    r"\b(?:transport(?:ation)?|freight|trip)\s+(?:costs?|rates?)\b|"
    r"\bsurcharge\b|\b(?:diesel|petrol|fuel)\s+prices?\b")
PERCENT = (
    r"(?:(?:roughly|about|approximately)\s+)?\d+(?:\.\d+)?\s*"
    r"(?:-\s*\d+(?:\.\d+)?)?\s*(?:%|percent\b)")
CURRENCY = r"(?:INR|₹)\s*\d+(?:\.\d+)?\s+per\s+(?:kilometre|kilometer|km)\b"
PERCENT_UPPER = r"\d+(?:\.\d+)?\s*(?:-\s*(\d+(?:\.\d+)?))?\s*(?:%|percent\b)"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Case-insensitive, word classes over all of Unicode.
_FLAGS = "(?iU)"


def _says(text: Column, pattern: str) -> Column:
    return flag(text.rlike(_FLAGS + pattern))


def _codes(*pairs: tuple[Column, str]) -> Column:
    """Sorted, distinct codes whose condition holds."""
    return F.array_sort(F.array_compact(F.array(*[F.when(cond, code) for cond, code in pairs])))


# --- scope --------------------------------------------------------------------------

def is_global(applies_to: Column) -> Column:
    return F.lower(strip(applies_to)) == "all routes"


def note_in_dataset(notes: DataFrame, known_routes: DataFrame) -> DataFrame:
    """Left join of the note scope to the distinct routes; ``route_known`` is never null."""
    routes = known_routes.select(F.col("route").alias("applies_to"), F.lit(True).alias("_known"))
    return notes.join(routes, "applies_to", "left").withColumn(
        "route_known", flag(F.col("_known"))).drop("_known")


def compile_scope(notes: DataFrame, known_routes: DataFrame) -> DataFrame:
    """Global or one directional route; exact-case membership; exclusion text wins."""
    everywhere = is_global(F.col("applies_to"))
    excluded = _says(F.col("note"), EXCLUSION)
    shaped = flag(F.col("applies_to").rlike(ROUTE_SHAPE))
    unknown = ~everywhere & ~F.col("route_known")
    return note_in_dataset(notes, known_routes).withColumns({
        "scope_type": F.when(everywhere, "global").otherwise("route"),
        "applies_to_routes": F.when(everywhere, F.array().cast("array<string>"))
                              .otherwise(F.array("applies_to")),
        "scope_status": F.when(excluded | unknown, "outside_dataset").otherwise("in_dataset"),
        "scope_warnings": _codes((unknown, "explicit_route_not_in_dataset"),
                                 (excluded, "text_excludes_dataset_scope")),
        "scope_error": F.when(~everywhere & ~shaped, "unsupported_scope"),
    }).drop("route_known")


# --- interval -----------------------------------------------------------------------

def parse_explicit_range(notes: DataFrame) -> DataFrame:
    """Add ``range``: struct (first, last, error) of the first month-name range in the
    note, NULL when there is none.

    A missing start year is the note's year, a missing end year the start year; a range
    that runs backwards rolls over the year end only from October on into March at the
    latest. The groups are extracted into one column first: later steps then read it
    instead of repeating the pattern.
    """
    text = F.col("note")
    groups = F.array(*[F.regexp_extract(text, _FLAGS + EXPLICIT_RANGE, i) for i in range(1, 7)])
    part = lambda i: F.get("_groups", F.lit(i))
    names = F.array(*map(F.lit, MONTHS))
    month = lambda i: F.array_position(names, F.lower(F.substring(part(i), 1, 3))).cast("int")
    number = lambda i: F.nullif(part(i), F.lit("")).try_cast("int")
    m1, d1, m2, d2, y1, end_year = (F.col(c) for c in ("_m1", "_d1", "_m2", "_d2", "_y1", "_end_year"))
    backwards = end_year.isNull() & (m2 * 100 + d2 < m1 * 100 + d1)
    rolls = (m1 >= 10) & (m2 <= 3)
    y2 = F.coalesce(end_year, y1 + F.when(backwards & rolls, 1).otherwise(0))
    day = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    first, last = F.col("_first"), F.col("_last")
    error = (
        F.when(F.col("_groups").isNull(), None)
        .when(backwards & ~rolls, "range_ends_before_start")
        .when(first.isNull() | last.isNull(), "impossible_date")
        .when(last < first, "range_ends_before_start"))
    sound = F.col("_error").isNull()
    matched = computed_once(notes, {"_groups": F.when(_says(text, EXPLICIT_RANGE), groups)})
    dated = (
        matched.withColumns({"_m1": month(0), "_d1": number(1), "_m2": month(3), "_d2": number(4),
                      "_y1": F.coalesce(number(2), F.year("date")), "_end_year": number(5)})
        .withColumns({"_first": F.when(m1.isNotNull(), day(y1, m1, d1)),
                      "_last": F.when(m2.isNotNull(), day(y2, m2, d2))})
        .withColumn("_error", error))
    return computed_once(dated, {"range": F.when(F.col("_groups").isNotNull(), F.struct(
        F.when(sound, first).alias("first"), F.when(sound, last).alias("last"),
        F.col("_error").alias("error")))}).drop(
        "_groups", "_m1", "_d1", "_m2", "_d2", "_y1", "_end_year", "_first", "_last", "_error")


def compile_interval(notes: DataFrame) -> DataFrame:
    """Seven rules, the most specific first; the note date is the last resort."""
    text, day = F.col("note"), F.col("date")
    monday = F.date_trunc("week", day).cast("date")
    quarter = F.trunc(day, "quarter")
    no_date, none = F.lit(None).cast("date"), F.array().cast("array<string>")

    def made(first, last, basis, warnings=none, error=F.lit(None).cast("string")):
        return F.struct(
            first.alias("effective_from"), last.alias("effective_to"),
            F.lit(basis).alias("temporal_basis"), warnings.alias("interval_warnings"),
            error.alias("interval_error"))

    r = F.col("range")
    default_warnings = _codes(
        (F.lit(True), "temporal_scope_defaulted_to_source_date"),
        (_says(text, TIME_HINT), "temporal_phrase_ambiguous"))
    interval = (
        F.when(r.isNotNull(), made(r.first, r.last, "explicit_range", error=r.error))
        .when(_says(text, ABOUT_A_WEEK), made(day, F.date_add(day, 6), "approximate_week"))
        .when(_says(text, THIS_QUARTER),
              made(quarter, F.date_add(F.add_months(quarter, 3), -1), "calendar_quarter"))
        .when(_says(text, CONTINUING), made(day, no_date, "open_ended_start"))
        .when(_says(text, THIS_WEEK), made(monday, F.date_add(monday, 6), "calendar_week"))
        .when(_says(text, AFTER_COMPLETION), made(day, no_date, "state_after_completion"))
        .otherwise(made(day, day, "source_date_fallback", default_warnings)))
    ranged = parse_explicit_range(notes)
    return computed_once(ranged, {"_interval": interval}).select("*", "_interval.*").drop("range", "_interval")


# --- impact -------------------------------------------------------------------------

def classify_event(text: Column) -> Column:
    event = F.lit("unknown")
    for name, pattern in reversed(EVENTS):
        event = F.when(_says(text, pattern), name).otherwise(event)
    return event


def extract_magnitude(text: Column) -> Column:
    """Distinct percent and currency phrases in cost context: (text, conflicting)."""
    found = lambda p: F.regexp_extract_all(text, F.lit(_FLAGS + p), F.lit(0))
    phrases = F.when(
        _says(text, COST_CONTEXT),
        F.array_distinct(F.transform(F.concat(found(PERCENT), found(CURRENCY)), strip)))
    return F.struct(
        F.when(F.size(phrases) == 1, F.try_element_at(phrases, F.lit(1))).alias("text"),
        flag(F.size(phrases) > 1).alias("conflicting"))


def magnitude_upper_bound(magnitude: Column) -> Column:
    """Upper end of a percent phrase as a number; NULL for currency or none."""
    pattern = _FLAGS + PERCENT_UPPER
    upper = F.regexp_extract(magnitude, pattern, 1)
    single = F.regexp_extract(magnitude, r"(\d+(?:\.\d+)?)", 1)
    return F.when(
        magnitude.rlike(pattern),
        F.when(upper != "", upper).otherwise(single).try_cast("double"))


def compile_impact(notes: DataFrame) -> DataFrame:
    """Five cues, fixed precedence; contradictions stay unknown with a warning."""
    text = F.col("note")
    flags = computed_once(notes, {
        "_rate": _says(text, NO_RATE_CHANGE), "_material": _says(text, NO_MATERIAL_IMPACT),
        "_stable": _says(text, STABLE), "_down": _says(text, DECREASE),
        "_up": _says(text, INCREASE), "_magnitude": extract_magnitude(text),
        "event_type": classify_event(text),
    })
    rate, material, stable, down, up = (F.col(c) for c in ("_rate", "_material", "_stable", "_down", "_up"))
    denied = rate | material
    clash = (denied & (up | down)) | (~denied & ~stable & down & up)
    status = (
        F.when(clash, "unknown")
        .when(rate, "explicit_no_rate_change").when(material, "explicit_no_material_impact")
        .when(stable, "normal_or_stable_operations")
        .when(down, "explicit_decrease").when(up, "explicit_increase").otherwise("not_stated"))
    typed = flags.withColumns({"cost_impact_status": status, "_clash": clash})
    status = F.col("cost_impact_status")
    neutral = status.isin("explicit_no_rate_change", "explicit_no_material_impact",
                          "normal_or_stable_operations")
    stated = status.isin("explicit_increase", "explicit_decrease")
    return typed.withColumns({
        "impact_direction": F.when(neutral, "no_change")
            .when(status == "explicit_increase", "increase")
            .when(status == "explicit_decrease", "decrease").otherwise("unknown"),
        "affects_transport_cost": F.when(neutral, False).when(stated, True),
        "negates_cost_increase": neutral,
        "magnitude_text": F.col("_magnitude.text"),
        "impact_warnings": _codes(
            (F.col("_clash"), "conflicting_cost_claims"),
            (status == "not_stated", "transport_cost_impact_not_stated"),
            (F.col("_magnitude.conflicting"), "conflicting_cost_magnitudes"),
            (F.col("event_type") == "unknown", "event_type_unknown")),
    }).drop("_rate", "_material", "_stable", "_down", "_up", "_magnitude", "_clash")


# --- whole note ---------------------------------------------------------------------

def code_union(*arrays: Column) -> Column:
    """Distinct sorted codes over several code arrays."""
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def compile_notes(notes: DataFrame, known_routes: DataFrame) -> DataFrame:
    """One typed claim per note. A note whose scope or range cannot be compiled
    carries ``compile_error`` (see :func:`fail_on_compile_errors`)."""
    require_columns(notes, NOTE_COLUMNS)
    staged = compile_impact(compile_interval(compile_scope(notes, known_routes)))
    return staged.select(
        "note_id", F.col("date").alias("source_date"),
        F.col("applies_to").alias("source_applies_to"), F.col("note").alias("original_text"),
        "scope_type", "applies_to_routes", "scope_status", "effective_from", "effective_to",
        "temporal_basis", "event_type", "impact_direction", "cost_impact_status",
        "affects_transport_cost", "negates_cost_increase", "magnitude_text",
        code_union(F.col("scope_warnings"), F.col("interval_warnings"),
                   F.col("impact_warnings")).alias("compilation_warnings"),
        F.coalesce("scope_error", "interval_error").alias("compile_error"),
    ).select(*COMPILED_NOTE_SCHEMA.names)


def fail_on_compile_errors(compiled: DataFrame) -> DataFrame:
    """Strict form: evaluating the result fails on the first note that did not compile."""
    problem = F.concat_ws(" ", F.lit("note"), "note_id", F.lit("did not compile:"), "compile_error")
    checked = F.when(F.col("compile_error").isNotNull(), F.raise_error(problem).cast("string"))
    return compiled.withColumn("compile_error", checked)


def claim_consistent() -> Column:
    """Cross-field contract of a compiled claim, as one boolean."""
    status, direction = F.col("cost_impact_status"), F.col("impact_direction")
    affects, negates = F.col("affects_transport_cost"), F.col("negates_cost_increase")
    routes = F.size("applies_to_routes")
    fields = (
        F.when(status == "explicit_increase", (direction == "increase") & flag(affects) & ~negates)
        .when(status == "explicit_decrease", (direction == "decrease") & flag(affects) & ~negates)
        .when(status.isin("not_stated", "unknown"),
              (direction == "unknown") & affects.isNull() & ~negates)
        .otherwise((direction == "no_change") & flag(~affects) & negates))
    return flag(
        (F.col("effective_to").isNull() | (F.col("effective_to") >= F.col("effective_from")))
        & F.when(F.col("scope_type") == "global", routes == 0)
           .when(F.col("scope_type") == "route", routes > 0).otherwise(True)
        & fields)


def gate_claim_consistent() -> Column:
    """The narrower form the gate re-checks: only an increase binds its other fields."""
    routes = F.size("applies_to_routes")
    return flag(
        (F.col("effective_to").isNull() | (F.col("effective_to") >= F.col("effective_from")))
        & ~((F.col("scope_type") == "global") & (routes > 0))
        & ~((F.col("scope_type") == "route") & (routes == 0))
        & ((F.col("cost_impact_status") != "explicit_increase")
           | ((F.col("impact_direction") == "increase")
              & flag(F.col("affects_transport_cost")) & ~F.col("negates_cost_increase"))))


def compiled_claim_check(compiled: DataFrame) -> DataFrame:
    """Counters of broken claims, one row."""
    usable = F.col("compile_error").isNull()
    return compiled.agg(
        F.count(F.lit(1)).alias("notes"),
        F.count_if(~usable).alias("not_compiled"),
        failures(~usable | claim_consistent()).alias("inconsistent"),
        failures(~usable | gate_claim_consistent()).alias("gate_inconsistent"))


def note_compile_counts(compiled: DataFrame) -> DataFrame:
    """Counts by scope, impact status, open intervals and warnings in one pass."""
    facts = F.concat(
        F.array(
            F.struct(F.lit("scope_type").alias("kind"), F.col("scope_type").alias("value")),
            F.struct(F.lit("cost_impact_status").alias("kind"), F.col("cost_impact_status").alias("value")),
            F.struct(F.lit("interval").alias("kind"),
                     F.when(F.col("effective_to").isNull(), "open").otherwise("bounded").alias("value"))),
        F.transform("compilation_warnings", lambda w: F.struct(
            F.lit("warning").alias("kind"), w.alias("value"))))
    return (
        compiled.where("compile_error IS NULL").select(F.inline_outer(facts)).where("kind IS NOT NULL")
        .groupBy("kind", "value").agg(F.count(F.lit(1)).alias("notes")))
