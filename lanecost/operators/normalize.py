"""Typed, trimmed shipments and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import parsed_number, strip, week_start
from ..schemas import (
    NOTE_COLUMNS, SHIPMENT_COLUMNS, SHIPMENT_DERIVED_COLUMNS,
    SHIPMENT_NUMERIC_COLUMNS, SHIPMENT_TEXT_COLUMNS, require_columns,
)


def normalize_shipments(raw: DataFrame) -> DataFrame:
    """Trim text, cast numbers and the date, derive route, Monday week, tonne_km.

    Decimal inputs stay decimal, so later sums are exact; text becomes double.
    """
    require_columns(raw, SHIPMENT_COLUMNS)
    kinds = dict(raw.dtypes)
    changes = {c: strip(F.col(c)) for c in SHIPMENT_TEXT_COLUMNS}
    changes |= {
        c: parsed_number(F.col(c))
        for c in SHIPMENT_NUMERIC_COLUMNS if kinds[c] == "string"
    }
    changes["shipment_date"] = F.col("shipment_date").try_cast("date")  # issues report what is no date
    typed = raw.select(*SHIPMENT_COLUMNS).withColumns(changes)
    return typed.withColumns({
        "route": F.concat_ws("-", "origin", "destination"),
        "week_of": week_start(F.col("shipment_date")),
        "tonne_km": F.col("quantity_tonnes") * F.col("distance_km"),
    }).select(*SHIPMENT_COLUMNS, *SHIPMENT_DERIVED_COLUMNS)


def normalize_notes(raw: DataFrame) -> DataFrame:
    """Trim id and scope, type the date; the note text is kept as it is."""
    require_columns(raw, NOTE_COLUMNS)
    return raw.select(
        strip(F.col("note_id")).alias("note_id"),
        F.col("date").try_cast("date").alias("date"),
        strip(F.col("applies_to")).alias("applies_to"),
        "note",
    )
