import csv
import io

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from fieldlead.operators import rejects
from fieldlead.plans.problems import LAYOUTS, RULES

GOOD = "1\t2\tC\tC07\tC07D\tC07D1/00"


def parsed(spark, lines):
    df = spark.createDataFrame([(i, "cpc_rows", x) for i, x in enumerate(lines)], "row_id int, target_table string, raw_line string")
    return df, {r["row_id"]: r["reason"] for r in rejects.rejected_lines(df, LAYOUTS, RULES).collect()}


def by_hand(line):
    """A character by character reading of a line: fields, or None if its quotes are unsound."""
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            i, text = i + 1, ""
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        text, i = text + '"', i + 2
                        continue
                    i += 1
                    break
                text, i = text + line[i], i + 1
            if i < len(line) and line[i] != "\t":
                return None
        else:
            j = line.find("\t", i)
            j = len(line) if j < 0 else j
            text = line[i:j]
            if '"' in text:
                return None
            i = j
        out.append(text)
        if i >= len(line):
            return out
        i += 1


CASES = [
    (GOOD, None), ('1\t"2"\tC\tC07\tC07D\t"C""07"', None), ('1\t"a\tb\nc"\tC\tC\tC\tC', "bad_value"), ('1\t"2\tC\tC07\tC07D\tx', "quoting"), ('1\t"2"x\tC\tC\tC\tC', "quoting"),
    ('1\tx"2"\tC\tC\tC\tC', "quoting"), ("1\t2", "column_count"), ("", "column_count"), (None, "column_count"), (GOOD + "\t", "column_count"), ("1\t\tC\tC\tC\tC", None),
    ("1\t  \tC\tC\tC\tC", None), ("1\t 007 \tC\tC\tC\tC", None), ("1\t0000999\tC\tC\tC\tC", None), ("1\t1000\tC\tC\tC\tC", "bad_value"), ("1\t-1\tC\tC\tC\tC", "bad_value"),
    ("1\t３\tC\tC\tC\tC", "bad_value"), ('1\t"2', "quoting"), ('""\t""\t""\t""\t""\t""', None), ('"\t2\tC', "quoting"), ("\t\t\t\t\t", None), ('""""\t1\t\t\t\t\\t', None),
]


def test_reasons(spark):
    _, got = parsed(spark, [x for x, _ in CASES])
    assert [got.get(i) for i in range(len(CASES))] == [r for _, r in CASES]


def test_fields_come_back_unquoted(spark):
    lines = ['a\t"x\ty"\t"q""q"\t\\t\\b\t"l\nm"\t']
    df = spark.createDataFrame([(0, "cpc_rows", lines[0])], "row_id int, target_table string, raw_line string")
    assert rejects.parse_lines(df, LAYOUTS).first()["fields"] == ["a", "x\ty", 'q"q', "\\t\\b", "l\nm", ""]


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='a"\t\\b\n', max_size=14), min_size=1, max_size=30))
def test_grammar_against_a_reader_by_hand(spark, lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, raw_line string")
    sound, fields = rejects.split_line(F.col("pieces"))
    for r in df.withColumn("pieces", rejects.pieces_of(F.col("raw_line"))).select("raw_line", sound.alias("sound"), fields.alias("fields")).collect():
        want = by_hand(r["raw_line"])
        assert r["sound"] == (want is not None)
        if want is not None:
            assert r["fields"] == want


def test_round_trip_with_a_csv_writer(spark):
    want = [["a\tb", 'c"d', "e\nf", "", " g ", "\\"], ["1", "2", "3", "4", "5", '""']]
    buffer = io.StringIO()
    lines = []
    for r in want:
        buffer.seek(0), buffer.truncate()
        csv.writer(buffer, delimiter="\t", lineterminator="").writerow(r)
        lines.append(buffer.getvalue())
    df = spark.createDataFrame([(i, "cpc_rows", x) for i, x in enumerate(lines)], "row_id int, target_table string, raw_line string")
    assert [r["fields"] for r in rejects.parse_lines(df, LAYOUTS).orderBy("row_id").collect()] == want


def test_very_long_quoted_field(spark):
    long = '1\t2\tC\tC\tC\t"' + 'x""' * 200_000 + '"'
    _, got = parsed(spark, [long, long[:-1]])
    assert got == {1: "quoting"}


@pytest.mark.parametrize(
    ("text", "day"),
    [("2020-02-29", True), (" 2020-02-29 ", True), ("2019-02-29", False), ("1899-12-31", False), ("1900-01-01", True), ("2026-12-31", True), ("2027-01-01", False), ("2020-2-9", False),
     ("2020-02-09T00:00", False), ("0000-00-00", False), ("n/a", False), ("", None), ("  ", None), (None, None), ("201l-06-22", False)],
)
def test_dates(spark, text, day):
    df = spark.createDataFrame([(1, text)], "row_id int, filing_date string")
    assert (rejects.rejected_values(df, "patents_01", RULES).count() == 1) == (day is False)
    assert (df.select(rejects.as_iso_date(F.col("filing_date"))).first()[0] is not None) == (day is True)


def test_typed_rows_are_the_rest(spark, rows):
    df, got = parsed(spark, [GOOD, "1\tx\tC\tC\tC\tC", '"9"\t" 3 "\tC\tC\tC\tC', GOOD])
    bad = rejects.rejected_lines(df, LAYOUTS, RULES)
    kept = rejects.typed_lines(df, bad, "cpc_rows", LAYOUTS["cpc_rows"], RULES)
    assert rows(kept.select("row_id", "patent_id", "cpc_sequence_text")) == [(0, "1", 2), (2, "9", 3), (3, "1", 2)]
    assert got == {1: "bad_value"}


def test_repeated_null_and_empty(spark, rows):
    df = spark.createDataFrame([(None, "cpc_rows", "x"), (None, "cpc_rows", "x"), (5, "cpc_rows", 'x"'), (5, "cpc_rows", "x")], "row_id int, target_table string, raw_line string")
    bad = rejects.rejected_lines(df, LAYOUTS, RULES)
    assert rows(bad) == [(5, "quoting"), (None, "column_count")]
    assert rejects.without_rejects(df, bad).count() == 0
    assert rejects.rejected_lines(df.where("false"), LAYOUTS, RULES).count() == 0
    extra = df.withColumns({"fields": F.lit(1), "structure": F.lit(2), "reason": F.lit("z"), "cell_value": F.lit("y")})
    assert rejects.rejected_lines(extra, LAYOUTS, RULES).count() == 2
