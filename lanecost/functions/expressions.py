"""Column helpers: tolerant comparison, display numbers, weeks, vectors, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


# Fixed value. Text that counts as a number: digits with single underscores between
# them, optional fraction and exponent, or a spelled infinity / not-a-number.
NUMBER_TEXT = (
    r"(?i)^[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?"
    r"|inf|infinity|nan)$"
)


# Fixed value: every character that counts as white space.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def parsed_number(text: Column) -> Column:
    """Double value of accepted number text, else NULL."""
    body = strip(text)
    return F.when(body.rlike(NUMBER_TEXT), F.regexp_replace(body, "_", "").try_cast("double"))


def week_start(date: Column) -> Column:
    return F.date_trunc("week", date).cast("date")


#: Powers of two in a band of magnitudes, and the bands of doubles.
_BAND_BITS, _BANDS = 30, 34


def banded(value: Column) -> Column:
    """A double as (band, part): value = part * 2 ** (30 * band), the part a decimal that keeps
    all digits, because it lies between 1 and 2 ** 30. Sums of parts do not depend on order."""
    size = F.abs(value)
    band = F.when(size > 0, F.greatest(F.lit(-_BANDS), F.least(F.lit(_BANDS), F.floor(F.log2(size) / _BAND_BITS)))).otherwise(0)
    return F.struct(band.cast("int").alias("band"), (value * F.pow(F.lit(2.0), -_BAND_BITS * band)).cast("decimal(28,17)").alias("part"))


def band_total(bands: Column) -> Column:
    """Double value of an array of (band, part) sums, smallest magnitudes first."""
    ordered = F.array_sort(bands)
    return F.aggregate(ordered, F.lit(0.0), lambda total, x: total + x["part"].cast("double") * F.pow(
        F.lit(2.0), (_BAND_BITS * x["band"]).cast("double")))


def order_free_sums(df: DataFrame, keys: list[str], sums: dict[str, str], **more: Column) -> DataFrame:
    """Per key: the sums named by ``sums`` (result: column) as doubles, and ``more`` aggregates
    that add up (counts). Nothing depends on partitioning or retried tasks, and no digit is cut:
    decimals are summed as they are, doubles by bands of magnitude. A key has one partial row per
    map task and combination of bands.
    """
    plain = {out: c for out, c in sums.items() if isinstance(df.schema[c].dataType, T.DecimalType)}
    wide = {out: c for out, c in sums.items() if out not in plain}
    for k, c in enumerate(wide.values()):
        df = df.withColumn(f"_b{k}", banded(F.col(c).cast("double")))
    bands = [f"_b{k}.band" for k in range(len(wide))]
    first = df.groupBy(*keys, *[F.col(b).alias(f"_band{k}") for k, b in enumerate(bands)]).agg(
        *[F.sum(c).alias(out) for out, c in plain.items()],
        *[F.sum(f"_b{k}.part").alias(f"_part{k}") for k in range(len(wide))], *[c.alias(n) for n, c in more.items()])
    if not wide:
        return first.select(*keys, *more, *[F.col(out).cast("double").alias(out) for out in sums])
    parts = lambda k: F.collect_list(F.struct(F.col(f"_band{k}").alias("band"), F.col(f"_part{k}").alias("part")))
    out = first.groupBy(*keys).agg(
        *[F.sum(out).cast("double").alias(out) for out in plain],
        *[parts(k).alias(f"_all{k}") for k in range(len(wide))], *[F.sum(n).alias(n) for n in more])
    totals = {out: band_total(F.col(f"_all{k}")) for k, out in enumerate(wide)}
    return out.select(*keys, *more, *[totals.get(out, F.col(out)).alias(out) for out in sums])


def close(left: Column, right: Column, rel: float, absolute: float) -> Column:
    """|left - right| <= absolute + rel * |right|; a missing side is never close."""
    return F.coalesce(F.abs(left - right) <= absolute + rel * F.abs(right), F.lit(False))


def finite(value: Column) -> Column:
    v = value.cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))


def fixed_text(value: Column, digits: int) -> Column:
    """Fixed-point text. ``bround`` first, because the formatter rounds ties away
    from zero where the display contract wants them to even."""
    return F.format_string(f"%.{digits}f", F.bround(value, digits))


def signed_text(value: Column, digits: int) -> Column:
    """Like :func:`fixed_text` with a sign; a small negative value shows as minus zero."""
    rounded = F.bround(value, digits)
    shown = F.format_string(f"%+.{digits}f", rounded)
    return F.when((value < 0) & (rounded == 0), f"-{0:.{digits}f}").otherwise(shown)


def iso(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def flag(condition: Column) -> Column:
    """Boolean that is never null."""
    return F.coalesce(condition, F.lit(False))


def joined(values: Column, sep: str = ",") -> Column:
    return F.array_join(values, sep)


def failures(condition_ok: Column) -> Column:
    """Number of rows that do not meet a condition; an unknown result counts."""
    return F.count_if(~F.coalesce(condition_ok, F.lit(False)))


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row global aggregate to every row."""
    return df.join(one_row)


def as_rows(one_row: DataFrame, name: str, value: str) -> DataFrame:
    """Turn the columns of a one-row result into (name, value) rows."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in one_row.columns
    ])
    return one_row.select(F.inline(pairs))


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns that later steps read but never repeat.

    A filter on a derived column is pushed down by substituting its expression, so a
    chain of derived columns can be evaluated, and planned, many times over. The
    one-element generator is a barrier: what is above it only reads its output.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    bound = df.select("*", F.explode_outer(F.array(row)).alias("_once"))
    return bound.select("*", "_once.*").drop("_once")
