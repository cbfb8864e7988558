"""CSV records of any number of files, split in parallel where quotes allow it.

A line of a file is the begin of a record only if an even number of quotes lies before it. Each
split of the scan is read twice. The first pass gives, per split, its number of quotes and how many
lines would begin a record for either parity in front; prefix sums over the splits then give every split
its parity and the ordinal of its first record. The second pass cuts the records. A record that
reaches over the border of a split is put together from its fragments, at most two per split.

The table of splits has as many rows as the scan has splits, which the driver plans anyhow.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

WHOLE, OPEN, REST = 0, 1, 2
_FACTS = "file string, start long, quotes long, even long, odd long, first string"
_RECORD = "file string, start long, seq long, row_number long, kind int, value string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines with their file and the begin of their split, in the order of each split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Runs of lines of one split; a split comes in one or more runs, in order."""
    for batch in batches:
        keys = list(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True))
        values, at = batch.column("value").to_pylist(), 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[at]:
                yield keys[at], values[at:k]
                at = k


def _split_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(key, quotes, counts, first):
        return pa.RecordBatch.from_pylist([{
            "file": key[0], "start": key[1], "quotes": quotes, "even": counts[0], "odd": counts[1], "first": first if key[1] == 0 else None}],
            pa.schema([("file", pa.string()), ("start", pa.int64()), ("quotes", pa.int64()), ("even", pa.int64()), ("odd", pa.int64()), ("first", pa.string())]))

    now, quotes, counts, first = None, 0, [0, 0], None
    for key, values in _by_split(batches):
        if key != now:
            if now is not None:
                yield row(now, quotes, counts, first)
            now, quotes, counts, first = key, 0, [0, 0], values[0]
        for value in values:
            counts[quotes & 1] += 1
            quotes += value.count('"')
    if now is not None:
        yield row(now, quotes, counts, first)


def _cut(places: dict[tuple[str, int], tuple[int, int]]):
    """Records of each split; ``places`` is its parity and the number of its first record."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), ("row_number", pa.int64()),
                        ("kind", pa.int32()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, held, kind, number, seq = None, 0, [], WHOLE, 0, 0
        out: list[tuple] = []

        def close(end: bool) -> None:
            nonlocal held, kind, seq
            if held:
                begun = kind == WHOLE
                out.append((*now, seq, number if begun else None, OPEN if begun and end and inside else kind, "\n".join(held)))
                seq += 1
            held, kind = [], WHOLE

        def flushed() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out.clear()

        for key, values in _by_split(batches):
            if key != now:
                if now is not None:
                    close(True)
                now, seq = key, 0
                inside, number = places[key]
                number -= 1
                kind = REST if inside else WHOLE
            for value in values:
                if not inside and held:
                    close(False)
                if not inside and kind == WHOLE:
                    number += 1
                held.append(value)
                inside ^= value.count('"') & 1
                if not inside:
                    close(False)
            yield from flushed()
        if now is not None:
            close(True)
            yield from flushed()
    return run


def records(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], bool]:
    """(records, headers, closed): data records (row_number, value), the different header lines of the files,
    and whether the quotes of every file are balanced.

    ``row_number`` is 2 for the first record below a header and goes on over the files in order of their
    names; blank lines have a number, and value "". A line break inside quotes belongs to the
    record, a carriage return at the end of one does not. Quotes count wherever they stand. A file
    whose last quote stays open ends in one record of the rest.
    """
    lines = _lines(spark, path)
    facts = sorted(lines.mapInArrow(_split_facts, _FACTS).collect(), key=lambda r: (r.file, r.start))
    places, headers, closed = {}, [], True
    parity, number, file = 0, 2, None
    for r in facts:
        if r.file != file:
            closed &= not parity
            parity, file = 0, r.file
            number -= 1  # the header is not counted
            if r.first is not None and (head := r.first.removeprefix("﻿").rstrip("\r")) not in headers:
                headers.append(head)
        places[r.file, r.start] = (parity, number)
        number += r.odd if parity else r.even
        parity = (parity + r.quotes) & 1
    closed &= not parity
    cut = lines.mapInArrow(_cut(places), _RECORD)
    header = (F.col("start") == 0) & (F.col("seq") == 0)
    whole = cut.where((F.col("kind") == WHOLE) & ~header).select("row_number", "value")
    order = Window.partitionBy("file").orderBy("start", "seq")
    parts = cut.where(F.col("kind") != WHOLE).withColumn("record", F.max("row_number").over(order))
    joined = parts.where("record is not null").groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("start", "seq", "value"))).alias("parts"))
    crossing = joined.select(F.col("record").alias("row_number"), F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))
    return whole.unionByName(crossing).withColumn("value", F.regexp_replace("value", r"\r\z", "")), headers, closed
