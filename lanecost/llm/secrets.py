"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings.

Everything is Spark SQL expressions on one row, so the scan is a map without a shuffle.
Positions come from the pieces between the matches: the k-th match starts after k + 1
pieces and k matches.

Candidates of a character class are maximal runs of its characters. A run is read in
overlapping sections, and in each a window slides over it, its entropy kept by incremental
counts: with n of W characters equal, the sum of n * log2(n) changes only by the counts of
the character that enters and of the one that leaves. A run is flagged if one window reaches the
entropy of its class, unless the run matches the allow-list of harmless strings.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# The patterns of the contract. The least lengths of the two runs are part of
# the pattern, because a run that is too short holds no longer one.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class CharacterClass:
    """Candidates ``[characters]{least,}`` are flagged if a window of ``window`` characters
    (at most ``least``) has ``bits`` of entropy or more."""

    kind: str
    characters: str
    least: int
    window: int
    bits: float


#: Digits with lower-case hex letters, with upper-case ones, and the base64 alphabets.
CLASSES = (
    CharacterClass("entropy_hex", "0-9a-f", 20, 20, 3.0),
    CharacterClass("entropy_upper", "0-9A-Z", 20, 20, 3.5),
    CharacterClass("entropy_base64", "A-Za-z0-9+/_=-", 24, 24, 3.9),
)
#: Harmless parts, cut out of a candidate before the rest is judged: alphabets in order, examples.
HARMLESS_PARTS = r"(?i)0123456789abcdef|abcdefghijklmnopqrst|qwertyuiop|example|placeholder|changeme|dummy|x{6}"
#: Harmless as a whole, a candidate or what is left of it: paths and compound words.
HARMLESS = (
    r"^[/_-]*[A-Za-z]+([/_-]+[A-Za-z]+)+[/_-]*$",
    r"^[A-Z]?[a-z]+$|^[A-Z]+$",
)
#: Characters of a section of a candidate.
SECTION = 512


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that don't overlap, as structs start, end (code points, end exclusive), found."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(F.split(text, pattern, -1), F.length)
    begin = F.struct(F.array().cast("array<struct<start:int,end:int,found:string>>").alias("spans"), F.lit(0).alias("at"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["found"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), pair["found"].alias("found")))
        return F.struct(F.concat(state["spans"], span).alias("spans"), end.alias("at"))

    pairs = F.transform(found, lambda m, i: F.struct(F.element_at(sizes, i + 1).alias("gap"), m.alias("found")))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.when(text.rlike(pattern), F.aggregate(pairs, begin, step, lambda s: s["spans"])).otherwise(none)


def assignments(text: Column) -> Column:
    """Spans of assignments whose value is long enough; shorter ones take their characters all the same."""
    spans = matches(text, ASSIGN)
    return F.filter(spans, lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 1)) >= ASSIGN_LEAST)


def peak_entropy(found: Column, window: int) -> Column:
    """Largest entropy, in bits, of a window of ``window`` characters in a run of ASCII characters."""
    cost = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    step = SECTION - window + 1
    sections = F.regexp_extract_all(found, F.lit(rf"(?s)(?=(.{{1,{SECTION}}})).{{1,{step}}}"), F.lit(1))

    def rises(n: Column) -> Column:  # n * log2(n), from n to n + 1
        return F.element_at(cost, n + 2) - F.element_at(cost, n + 1)

    def in_section(section: Column) -> Column:
        size = F.length(section)
        begin = F.struct(F.lit(0.0).alias("cost"), F.lit(-1.0).alias("best"))

        def slide(state: Column, i: Column) -> Column:
            enters = F.substring(section, i, F.lit(1))
            held = F.substring(section, F.greatest(F.lit(1), i - window), F.least(F.lit(window), i - 1))
            count_in = F.length(held) - F.length(F.replace(held, enters, F.lit("")))
            leaves = F.substring(section, i - window, F.lit(1))
            count_out = F.length(held) - F.length(F.replace(held, leaves, F.lit("")))
            # the leaving character is counted before it leaves, with the entering one already in
            count_out = count_out + F.when(leaves == enters, 1).otherwise(0)
            now = state["cost"] + rises(count_in) - F.when(i > window, rises(count_out - 1)).otherwise(0.0)
            bits = F.when(i >= window, F.lit(math.log2(window)) - now / window).otherwise(-1.0)
            return F.struct(now.alias("cost"), F.greatest(state["best"], bits).alias("best"))

        return F.aggregate(F.sequence(F.lit(1), size), begin, slide, lambda s: s["best"])

    return F.coalesce(F.array_max(F.transform(sections, in_section)), F.lit(-1.0))


def entropy_spans(text: Column, classes: Sequence[CharacterClass], parts: str, allowed: Sequence[str]) -> list[Column]:
    """Spans of each class: start, end, found. A window counts only if it is free of harmless parts."""
    def harmless(found: Column) -> Column:
        return _any([found.rlike(p) for p in allowed])

    def flagged(c: CharacterClass):
        def judged(s: Column) -> Column:
            left = F.filter(F.split(s["found"], parts, -1), lambda x: (F.length(x) >= c.window) & ~harmless(x))
            return ~harmless(s["found"]) & F.exists(left, lambda x: peak_entropy(x, c.window) >= c.bits)
        return judged

    return [F.filter(matches(text, f"[{c.characters}]{{{c.least},}}"), flagged(c)) for c in classes]


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def scan(docs: DataFrame, text: str = "text", into: str = "secrets", classes: Sequence[CharacterClass] = CLASSES,
         parts: str = HARMLESS_PARTS, allowed: Sequence[str] = HARMLESS) -> DataFrame:
    """``docs`` with an array of spans: start, end, place (of the kind in the list of kinds), kind,
    found; sorted by start, then kind. A null or empty text has none. Repeated rows are
    scanned each; a column named ``into`` is replaced.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    kinds = [*BASE_KINDS, *(c.kind for c in classes)]
    spans = [assignments(source), matches(source, ACCESS), matches(source, HEX), *entropy_spans(source, classes, parts, allowed)]
    def named(place: int):
        return lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.lit(place).alias("place"),
            F.lit(kinds[place]).alias("kind"), x["found"].alias("found"))

    all_spans = F.concat(*[F.transform(s, named(k)) for k, s in enumerate(spans)])
    return docs.withColumn(into, F.array_sort(all_spans))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans of each document, and all its spans."""
    found = scan(docs.select("doc_id", "text")).select("doc_id", F.explode_outer(F.array("secrets")).alias("secrets"))

    def of(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("secrets", lambda s: s["place"] < len(BASE_KINDS))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE_KINDS],
                        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
