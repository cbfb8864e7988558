"""Strict CSV and JSON-lines sources and sinks, and table fingerprints."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.normalize import normalize_notes, normalize_shipments
from ..operators.quality import dq_empty, header_issues, issue_union, note_issues, shipment_issues
from ..schemas import (
    ISSUE_COLUMNS, NOTE_COLUMNS, OUTPUT_COLUMNS, SHIPMENT_COLUMNS, require_columns, text_schema,
)
from .records import records

CORRUPT = "_corrupt_record"
INPUT_NAMES = ("shipment_records.csv", "context_notes.csv", "sample_output_format_v2.csv")
ISSUE_SCHEMA = "severity string, code string, dataset string, column string, row_number bigint"


class InputRejected(ValueError):
    """A blocking issue was found; ``issues`` holds the table of them."""

    def __init__(self, message: str, issues=None):
        super().__init__(message)
        self.issues = issues


# --- CSV ----------------------------------------------------------------------------

def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first line as they are written, repeated ones included; reads one
    line, not the file."""
    line = spark.read.text(path).first()
    return next(csv.reader([line.value])) if line else []


def read_text_table(spark: SparkSession, path: str, columns) -> DataFrame:
    """All columns as text, in the given order of the contract, ``malformed`` and ``row_number``.

    Records are split where no quote is open, in parallel (see ``records``), so a field may hold
    line breaks. Nothing is trimmed and no text stands for NULL. Blank lines are left out, but
    counted by ``row_number``, which is 2 for the first record of the first file. A record that a file
    ends in the middle of is malformed.
    """
    rows, headers, _ = records(spark, path)
    header = next(csv.reader(headers[:1])) if headers else []
    found = header_issues(header, columns, path)
    if found or len(headers) > 1:
        raise InputRejected(f"header of {path}: {found or headers}")
    parsed = F.from_csv("value", ", ".join(f"`{c}` string" for c in (*header, CORRUPT)), {
        "columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE", "escape": '"', "maxCharsPerColumn": "-1"})
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    # an empty field is empty text: no text of a CSV file stands for NULL
    return rows.where(F.trim("value") != "").select("row_number", odd.alias("_odd"), parsed.alias("r")).select(
        *[F.coalesce(f"r.{c}", F.lit("")).alias(c) for c in header],
        (F.col(f"r.{CORRUPT}").isNotNull() | F.col("_odd")).alias("malformed"), "row_number")


def malformed_issues(raw: DataFrame, dataset: str) -> DataFrame:
    """One blocking issue per table with ragged records, however many there are."""
    return raw.agg(F.count_if("malformed").alias("n")).where("n > 0").select(
        F.lit("error").alias("severity"), F.lit("malformed_csv").alias("code"),
        F.lit(dataset).alias("dataset"), F.lit(None).cast("string").alias("column"),
        F.lit(None).cast("bigint").alias("row_number"))


def scan_malformed_rows(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count(F.lit(1)).alias("rows"),
                   F.count_if("malformed").alias("malformed_rows"))


def scan_shipments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(normalised shipments, issues). The rows are usable only when no issue is an error."""
    raw = read_text_table(spark, path, SHIPMENT_COLUMNS)
    sound = raw.where("NOT malformed").drop("malformed")
    issues = issue_union(dq_empty(raw, "shipments"), malformed_issues(raw, "shipments"), shipment_issues(sound))
    return normalize_shipments(sound.drop("row_number")), issues


def scan_context_notes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(normalised notes, issues). Quoted text may hold commas and line breaks."""
    raw = read_text_table(spark, path, NOTE_COLUMNS)
    sound = raw.where("NOT malformed").drop("malformed")
    issues = issue_union(dq_empty(raw, "context_notes"), malformed_issues(raw, "context_notes"), note_issues(sound))
    return normalize_notes(sound.drop("row_number")), issues


def contract_lines(spark: SparkSession, path: str) -> DataFrame:
    """Output records with their place: part, position, the eight fields, malformed."""
    lines = spark.read.text(path).select(
        "value", F.struct(F.col("_metadata.file_name").alias("file"),
                          F.col("_metadata.file_block_start").alias("start")).alias("part"),
        F.monotonically_increasing_id().alias("position"))
    parsed = F.from_csv("value", ", ".join(f"{c} string" for c in (*OUTPUT_COLUMNS, CORRUPT)),
                        {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE", "escape": '"'})
    return lines.withColumn("r", parsed).select(
        "part", "position", "value",
        *[F.coalesce(f"r.{c}", F.lit("")).alias(c) for c in OUTPUT_COLUMNS],
        F.col(f"r.{CORRUPT}").isNotNull().alias("malformed"))


def output_rows(lines: DataFrame, variant: str = "output") -> tuple[DataFrame, DataFrame]:
    """(rows, headers) for the contract checks; every part file repeats the header."""
    header = F.col("value") == ",".join(OUTPUT_COLUMNS)
    rows = lines.where(~header).drop("value").withColumn("variant", F.lit(variant))
    headers = lines.agg(
        F.max(F.when(header, F.col("value"))).alias("header"),
        (F.count_if(header) / F.countDistinct("part.file")).alias("copies"),
    ).withColumn("variant", F.lit(variant))
    return rows, headers


def contract_body_arity(spark: SparkSession, path: str) -> DataFrame:
    """Warnings for body records that do not have eight fields; the header rules."""
    header = read_header(spark, path)
    if header_issues(header, OUTPUT_COLUMNS, "output_contract", require_order=True):
        raise InputRejected(f"the header of {path} is not the output contract")
    lines = contract_lines(spark, path).where(F.col("value") != ",".join(OUTPUT_COLUMNS))
    return lines.where("malformed").select(
        F.lit("warning").alias("severity"), F.lit("malformed_sample_row").alias("code"),
        F.lit("output_contract").alias("dataset"), F.lit(None).cast("string").alias("column"), "value")


def load_bundle(spark: SparkSession, shipments_path: str, notes_path: str, contract_path: str):
    """(shipments, notes, issues of all inputs). See :func:`fail_on_errors`."""
    shipments, a = scan_shipments(spark, shipments_path)
    notes, b = scan_context_notes(spark, notes_path)
    c = contract_body_arity(spark, contract_path).select(
        *[c for c in ISSUE_COLUMNS if c != "row_number"], F.lit(None).cast("bigint").alias("row_number"))
    return shipments, notes, issue_union(a, b, c.select(*ISSUE_COLUMNS))


def fail_on_errors(issues: DataFrame) -> None:
    """Stop when an input has a blocking issue. Looks for one row only."""
    errors = issues.where("severity = 'error'")
    if not errors.isEmpty():
        raise InputRejected("the input has blocking issues", errors)


def sink_contract_csv(output: DataFrame, path: str, single_file: bool = False) -> str:
    """Eight columns, sorted, minimal quoting, a header in every part. One file only
    as an export of a small result, because it makes one task write everything."""
    require_columns(output, OUTPUT_COLUMNS, exact=True)
    if path.rstrip("/").rsplit("/", 1)[-1] in INPUT_NAMES:
        raise ValueError("refusing to overwrite an input name")
    ordered = output.orderBy("route", "week_of")
    ordered = ordered.coalesce(1) if single_file else ordered
    ordered.write.option("header", True).option("emptyValue", "").option("escape", '"').csv(path)
    return path


# --- JSON lines ---------------------------------------------------------------------

def sink_jsonl(df: DataFrame, path: str, order) -> str:
    """One JSON object per line in key order, NULL fields kept."""
    df.orderBy(*order).write.option("ignoreNullFields", False).json(path)
    return path


def sink_notes_jsonl(compiled: DataFrame, path: str) -> str:
    return sink_jsonl(compiled, path, ["note_id"])


def sink_evidence_jsonl(rows: DataFrame, path: str) -> str:
    """One line per assessed pair, so that no line grows with the number of notes."""
    return sink_jsonl(rows, path, ["route", "route_type", "week_of", "note_id"])


def sink_explanation_jsonl(audits: DataFrame, path: str) -> str:
    """Decimal cost as text, so that no reader turns it into a binary fraction."""
    return sink_jsonl(audits.withColumn("estimated_cost_usd", F.col("estimated_cost_usd").cast("string")),
                      path, ["route", "week_of"])


def sink_root_cause_json(analyses: DataFrame, path: str) -> str:
    """One document per analysis, each with the schema version, sorted by week and key."""
    document = F.struct(F.lit("1.0").alias("schema_version"),
                        F.struct(*analyses.columns).alias("analysis"))
    analyses.orderBy("week_of", "route", "route_type", "candidate_key").select(
        F.to_json(document, {"ignoreNullFields": "false"})).write.text(path)
    return path


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict typed read: a blank line or a record that does not fit fails the job."""
    lines = spark.read.text(path)
    record = F.from_json("value", schema, {"mode": "FAILFAST"})
    blank = F.raise_error(F.lit("blank line in a JSON-lines file"))
    return lines.select(F.when(F.trim("value") == "", blank.cast(schema)).otherwise(record).alias("r")).select("r.*")


def scan_notes_jsonl(spark: SparkSession, path: str) -> DataFrame:
    from ..schemas import COMPILED_NOTE_SCHEMA

    return scan_jsonl(spark, path, COMPILED_NOTE_SCHEMA)


def scan_audit_jsonl(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Strict read with the schema of the table that was written."""
    return scan_jsonl(spark, path, like.schema)


def roundtrip_check(written: DataFrame, read_back: DataFrame) -> DataFrame:
    """Rows that differ between memory and file; both counts must be zero."""
    from ..operators.report import row_multiset_equality

    return row_multiset_equality(written, read_back)


# --- fingerprints -------------------------------------------------------------------

def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size per file, one file per task; for small artifact files."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"))


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-free content digest of a table, in one map-side-combined pass.

    Each row's SHA-256 gives 60 bits that are combined by xor and by sum; the sum keeps
    equal rows from cancelling out.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in df.columns]
    digest = F.conv(F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 15), 16, 10).cast("bigint")
    return df.select(digest.alias("d")).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor("d"), F.lit(0)).alias("xor_digest"),
        F.coalesce(F.sum(F.col("d").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum_digest"))


def same_fingerprint(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = dataset_fingerprint(before), dataset_fingerprint(after)
    renamed = b.toDF(*[f"{c}_after" for c in b.columns])
    return a.join(renamed).select(
        (F.col("rows") == F.col("rows_after")).alias("same_rows"),
        ((F.col("xor_digest") == F.col("xor_digest_after"))
         & (F.col("sum_digest") == F.col("sum_digest_after"))).alias("same_content"))
