import pytest
from pyspark.sql import functions as F

from fieldlead.functions.columns import repaired_id, trimmed
from fieldlead.operators import fields, link

REPAIRS = {"H0000019": "H1", "H0000027": "H2", "H0000035": "H3", "H0000043": "H4", "H001835&": "H1835", "H0018384": "H1838", "H0020079": "H2007"}
UNTOUCHED = ["3930273", "10000000", "D242584", "PP3987", "RE28671", "T100201", "H002008", "H002294", "H1", "H1838", "", None]


def test_identifier_repair(spark):
    df = spark.createDataFrame([*REPAIRS.items(), *[(x, x) for x in UNTOUCHED], ("Habcdef1", None)], "raw string, want string")
    assert df.where(~repaired_id(F.col("raw")).eqNullSafe(F.col("want"))).collect() == []


def test_unrepairable_identifiers_stop(spark):
    good = spark.createDataFrame([("H1",), ("3930273",)], "id string")
    link.require_repaired(good, "id", "anchors")
    with pytest.raises(ValueError, match="anchors: 1 identifiers could not be repaired"):
        link.require_repaired(spark.createDataFrame([("H1",), (None,)], "id string"), "id", "anchors")


def test_blanks(spark):
    df = spark.createDataFrame([(" a ",), (" \t",), ("",), (None,), ("  b c\n",)], "v string")
    assert [r[0] for r in df.select(trimmed(F.col("v"))).collect()] == ["a", None, None, None, "b c"]


def codes(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, code_sequence string, code_section string, code_class string, code_subclass string, code_group string")


A, H = ("A", "A61", "A61K", "A61K31/05"), ("H", "H01", "H01L", "H01L21/02")


def test_primary_and_all(spark, rows):
    df = codes(spark, [("p1", "0", *A), ("p1", "1", *H), ("p2", "0", *H)])
    assert rows(fields.assign_fields(df, "subclass")) == [("p1", "A61K"), ("p2", "H01L")]
    assert rows(fields.assign_fields(df, "main_group", None)) == [("p1", "A61K31/00"), ("p1", "H01L21/00"), ("p2", "H01L21/00")]
    assert rows(fields.assign_fields(df, "class", None, section="H")) == [("p1", "H01"), ("p2", "H01")]
    twice = codes(spark, [("p1", "0", *A), ("p1", "1", *A), ("p1", "2", None, None, None, "")])
    assert rows(fields.assign_fields(twice, "class", None)) == [("p1", "A61"), ("p1", "A61")]
    assert ("p1", "/00") in rows(fields.assign_fields(twice, "main_group", None))


def test_primary_rule_that_matches_nothing(spark):
    df = codes(spark, [("p1", "1", *A), ("p1", "2", *H)])
    with pytest.raises(ValueError, match="matches no rows; the lowest sequence is 1"):
        fields.require_primary_rows(df, 0)
    with pytest.raises(ValueError, match="No code rows at all"):
        fields.require_primary_rows(df.where("false"), 0)
    fields.require_primary_rows(df, 1)


def test_unreadable_sequence_stops(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        fields.assign_fields(codes(spark, [("p1", "x", *A)]), "class").collect()


def test_registry():
    with pytest.raises(KeyError, match="unknown width"):
        fields.assign_fields(None, "nowhere")
    with pytest.raises(ValueError, match="registered already"):
        fields.register_width("class", lambda: F.lit(1))
