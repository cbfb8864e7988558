"""Data-quality matrix, strict files and the output contract."""

import pytest
from pyspark.sql import functions as F

from lanecost.operators import quality as dq, report as rp
from lanecost.schemas import OUTPUT_COLUMNS, SHIPMENT_COLUMNS
from lanecost.session import scratch_path
from lanecost.sources import files
from lanecost.sources.records import records

GOOD = dict(shipment_id="S1", origin="A", destination="B", route_type="Short", material="m", quantity_tonnes="1.5",
            distance_km="10", freight_cost_inr="100", shipment_date="2024-02-29", transporter="t")
MATRIX = [
    ("origin", None, "missing_value"), ("origin", " \t", "blank_value"), ("quantity_tonnes", "abc", "invalid_type"),
    ("quantity_tonnes", "1.0d", "invalid_type"), ("quantity_tonnes", "1_0", None), ("quantity_tonnes", "1__0", "invalid_type"),
    ("quantity_tonnes", " 1e3 ", None), ("quantity_tonnes", ".5", None), ("quantity_tonnes", "-inf", "non_finite_value"),
    ("quantity_tonnes", "NaN", "non_finite_value"), ("distance_km", "0", "non_positive_value"),
    ("distance_km", "-1", "non_positive_value"), ("distance_km", "", "blank_value"), ("freight_cost_inr", None, "missing_value"),
    ("shipment_date", "2023-02-29", "invalid_date"), ("shipment_date", " 2024-01-01", "invalid_date"),
    ("shipment_date", "2024-1-1", "invalid_date"), ("shipment_date", "", "blank_value"), ("route_type", "short", "invalid_route_type"),
    ("route_type", " Long ", None),
]


def raw(spark, rows):
    return spark.createDataFrame(
        [(*[{**GOOD, **r}[c] for c in SHIPMENT_COLUMNS], i + 2) for i, r in enumerate(rows)],
        ", ".join(f"{c} string" for c in SHIPMENT_COLUMNS) + ", row_number bigint")


def test_issue_matrix(spark):
    rows = [{"shipment_id": f"S{i}", c: v} for i, (c, v, _) in enumerate(MATRIX)]
    found = {(r.row_number - 2, r.column): r.code for r in dq.shipment_issues(raw(spark, rows)).collect()}
    assert found == {(i, c): code for i, (c, _, code) in enumerate(MATRIX) if code}


def test_duplicates_after_trim_and_overflowing_product(spark):
    rows = [{"shipment_id": "X"}, {"shipment_id": " X "}, {"shipment_id": ""}, {"shipment_id": ""},
            {"shipment_id": "Y", "quantity_tonnes": "1e308", "distance_km": "1e10"}]
    issues = dq.shipment_issues(raw(spark, rows)).collect()
    assert sorted(r.row_number for r in issues if r.code == "duplicate_identifier") == [2, 3]
    assert [(r.row_number, r.column) for r in issues if r.code == "non_finite_value"] == [(6, "tonne_km")]


def test_header_rules():
    assert dq.header_issues(["a", "a", "x"], ["a", "b"], "d") == [
        ("duplicate_column", "d", "a"), ("missing_column", "d", "b"), ("unexpected_column", "d", "x")]
    assert dq.header_issues(["b", "a"], ["a", "b"], "d") == []
    assert dq.header_issues(["b", "a"], ["a", "b"], "d", True) == [("invalid_output_header", "d", None)]


def write_lines(spark, lines, name="file.csv"):
    from pathlib import Path
    from urllib.parse import urlparse

    folder = Path(urlparse(scratch_path(spark, "in")).path)
    folder.mkdir(parents=True)
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(folder / name)


def test_bundle_reports_every_input(spark):
    head = ",".join(SHIPMENT_COLUMNS)
    ships = write_lines(spark, [head, "S1,A,B,Short,m,1,10,5,2024-01-03,t", "S2,A,B,Short,m,x,10,5,2024-01-03,t", "S3,A"])
    notes = write_lines(spark, ["note_id,date,applies_to,note", '"N1",2024-01-03,All Routes,"Costs, ""high"",\nvery"'])
    contract = write_lines(spark, [",".join(OUTPUT_COLUMNS), "a,2024-01-01,1.00,x,y,Yes,,z", "a,b,c"])
    shipments, found, issues = files.load_bundle(spark, ships, notes, contract)
    codes = sorted((r.dataset, r.severity, r.code) for r in issues.collect())
    assert codes == [("output_contract", "warning", "malformed_sample_row"), ("shipments", "error", "invalid_type"),
                     ("shipments", "error", "malformed_csv")]
    assert found.first().note == 'Costs, "high",\nvery'
    row = shipments.where("shipment_id = 'S1'").first()
    assert (row.route, str(row.week_of), row.tonne_km) == ("A-B", "2024-01-01", 10.0)
    with pytest.raises(files.InputRejected):
        files.fail_on_errors(issues)
    with pytest.raises(files.InputRejected, match="header"):
        files.scan_context_notes(spark, ships)


def test_json_lines_are_strict(spark):
    schema = spark.createDataFrame([(1, "a")], "n int, t string").schema
    good = write_lines(spark, ['{"n":1,"t":null}'], "a.jsonl")
    assert files.scan_jsonl(spark, good, schema).collect() == [(1, None)]
    for lines in (['{"n":1}', "", '{"n":2}'], ['{"n":"x"}'], ["{"]):
        with pytest.raises(Exception):
            files.scan_jsonl(spark, write_lines(spark, lines, "b.jsonl"), schema).collect()


def output(spark, n=40):
    rows = [(f"R{i % 4}-X", f"2024-01-{1 + i // 4:02d}", "1.00", "+1.0% vs a", "Not available: b",
             "No (justified)" if i % 3 == 0 else "Yes", "N001" if i % 3 == 0 else "", "because, really") for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in OUTPUT_COLUMNS))


def test_written_output_passes_and_every_corruption_is_caught(spark):
    final = output(spark)
    path = files.sink_contract_csv(final, scratch_path(spark, "final"))
    rows, headers = files.output_rows(files.contract_lines(spark, path))
    checks = rp.output_contract_checks(rows, final, headers).collect()
    assert len(checks) == 15 and {r.status for r in checks} == {"pass"}, [r for r in checks if r.failures]
    caught = {r.variant: r.detected for r in rp.tamper_detection(rows, final).collect()}
    assert set(caught) == set(rp.CHECKS) and all(caught.values()), caught


def test_order_check_sees_breaks_inside_and_between_parts(spark):
    rows = [("v", p, i, k, "w") for p, i, k in ((0, 0, "a"), (0, 1, "c"), (1, 2, "b"), (1, 3, "d"), (1, 4, "c"))]
    df = spark.createDataFrame(rows, "variant string, part int, position int, route string, week_of string")
    assert rp._order_breaks(df).first().sorted == 2


def test_sink_refuses_an_input_name(spark):
    with pytest.raises(ValueError):
        files.sink_contract_csv(output(spark, 1), "/tmp/none/context_notes.csv")


def test_fingerprint_ignores_order_but_not_copies(spark):
    df = output(spark)
    same = files.same_fingerprint(df, df.orderBy(F.rand(1)).repartition(5)).first()
    assert same.same_rows and same.same_content
    more = files.same_fingerprint(df, df.unionByName(df.limit(1)).unionByName(df.limit(1))).first()
    assert not more.same_rows and not more.same_content


def test_a_file_without_rows_and_a_repeated_column_are_reported(spark):
    empty = write_lines(spark, [",".join(SHIPMENT_COLUMNS)], "empty.csv")
    rows, issues = files.scan_shipments(spark, empty)
    assert rows.count() == 0 and [r.code for r in issues.collect()] == ["empty_dataset"]
    twice = write_lines(spark, [",".join((*SHIPMENT_COLUMNS, "origin"))], "twice.csv")
    with pytest.raises(files.InputRejected, match="duplicate_column"):
        files.scan_shipments(spark, twice)


def test_a_date_that_is_none_is_an_issue_and_no_crash(spark):
    values = {"shipment_id": "S1", "origin": "A", "destination": "B", "route_type": "Short", "material": "x", "quantity_tonnes": "1",
              "distance_km": "2", "freight_cost_inr": "3", "shipment_date": "2024-02-30", "transporter": "t"}
    path = write_lines(spark, [",".join(SHIPMENT_COLUMNS), ",".join(values[c] for c in SHIPMENT_COLUMNS)], "date.csv")
    rows, issues = files.scan_shipments(spark, path)
    assert rows.first().shipment_date is None and [r.code for r in issues.collect()] == ["invalid_date"]


def messy_rows(n):
    """Fields with commas, doubled quotes and line breaks of both kinds, also empty and blank ones."""
    import random
    rng = random.Random(n)
    odd = ["", " ", "a,b", 'say "no"', "two\nlines", "\n", 'x"\n"y', "last\n\n", "über,\n日本", "plain"]
    return [(f"N{i}", "2024-01-03", rng.choice(odd), "".join(rng.choice(odd) for _ in range(rng.randrange(1, 5)))) for i in range(n)]


@pytest.mark.parametrize(("size", "end"), [(40, "\n"), (97, "\r\n"), (1 << 20, "\n")])
def test_quoted_breaks_across_split_borders(spark, size, end):
    """Splits of a few bytes, so that records reach over one or several borders."""
    import csv
    import io

    want = messy_rows(60)
    text = io.StringIO()
    writer = csv.writer(text, lineterminator=end)
    writer.writerow(["note_id", "date", "applies_to", "note"])
    writer.writerows(want)
    path = write_lines(spark, [], "messy.csv")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("﻿" + text.getvalue())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        table = files.read_text_table(spark, path, ("note_id", "date", "applies_to", "note"))
        got = {r.row_number: (r.note_id, r.date, r.applies_to, r.note, r.malformed) for r in table.collect()}
        rows, _, closed = records(spark, path)
        assert closed and rows.count() == 60
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {k: (*w, False) for k, w in enumerate(want, 2)}


def test_issues_carry_the_row_number_of_the_file(spark):
    head = ",".join(SHIPMENT_COLUMNS)
    path = write_lines(spark, [head, "S1,A,B,Short,m,1,10,5,2024-01-03,t", "", '"S2\nx",A,B,Short,"steel\nrod",x,10,5,2024-01-03,t',
                               "S3,A", "S4,A,B,Short,m,1,10,0,2024-01-03,t", "S4,A,B,Short,m,1,10,1,2024-01-03,t"])
    rows, issues = files.scan_shipments(spark, path)
    got = sorted((r.code, r.column, r.row_number) for r in issues.collect() if r.code != "malformed_csv")
    assert got == [("duplicate_identifier", "shipment_id", 6), ("duplicate_identifier", "shipment_id", 7),
                   ("invalid_type", "quantity_tonnes", 4), ("non_positive_value", "freight_cost_inr", 6)]
    assert rows.where("shipment_id like 'S2%'").first().material == "steel\nrod"


def test_several_files_are_numbered_one_after_another_and_an_open_quote_is_malformed(spark):
    from pathlib import Path

    head = "note_id,date,applies_to,note"
    first = write_lines(spark, [head, "N1,2024-01-01,a,b", 'N2,2024-01-01,a,"b\nc"'], "part-1.csv")
    (Path(first).parent / "part-2.csv").write_text(head + "\nN3,2024-01-01,a,b\nN4,2024-01-01,a,\"open\nrest\n", encoding="utf-8")
    (Path(first).parent / "part-3.csv").write_text(head + "\nN5,2024-01-01,a,b\n", encoding="utf-8")
    table = files.read_text_table(spark, str(Path(first).parent), head.split(","))
    assert sorted((r.row_number, r.note_id, r.malformed) for r in table.collect()) == [
        (2, "N1", False), (3, "N2", False), (4, "N3", False), (5, "N4", True), (6, "N5", False)]
    (Path(first).parent / "part-4.csv").write_text("a,b\n1,2\n", encoding="utf-8")
    with pytest.raises(files.InputRejected, match="header"):
        files.read_text_table(spark, str(Path(first).parent), head.split(","))


def test_two_types_of_a_route_in_one_week_are_no_repeated_key(spark):
    final = output(spark, 8)
    final = final.unionByName(final.limit(1).withColumn("cost_per_tonne_km", F.lit("2.00")))
    rows, headers = files.output_rows(files.contract_lines(spark, files.sink_contract_csv(final, scratch_path(spark, "final"))))
    failures = {r.check_id: r.failures for r in rp.output_contract_checks(rows, final, headers).collect()}
    assert failures["output.unique_keys"] == 0
    failures = {r.check_id: r.failures for r in rp.output_contract_checks(rows.unionByName(rows.limit(1)), final, headers).collect()}
    assert failures["output.unique_keys"] == 1
