import datetime as dt

import pandas as pd
import pytest

from fieldlead import config, guard
from fieldlead.ledger import Ledger


def dates(spark, values):
    return spark.createDataFrame([(str(i), dt.datetime.fromisoformat(v) if v else None) for i, v in enumerate(values)], "doc_id string, filing_date timestamp")


AS_OF = dt.date(1998, 6, 30)


def test_dates_up_to_the_cutoff(spark):
    (r,) = guard.check_dates(dates(spark, ["1994-01-01", "1996-07-15", "1998-06-30T23:00:00"]), AS_OF, ["filing_date"], "panel")
    assert (r.rows, r.late, r.nulls) == (3, 0, 0)
    with pytest.raises(guard.LookAheadError, match="panel: 1 of 2 rows have filing_date after 1998-06-30; the latest is 1998-07-01"):
        guard.check_dates(dates(spark, ["1994-01-01", "1998-07-01"]), AS_OF, ["filing_date"], "panel")


def test_nulls_types_and_missing_columns(spark):
    df = dates(spark, ["1994-01-01", None])
    assert guard.check_dates(df, AS_OF, ["filing_date"], "p")[0].nulls == 1
    with pytest.raises(guard.LookAheadError, match="have no filing_date"):
        guard.check_dates(df, AS_OF, ["filing_date"], "p", require_no_nulls=True)
    with pytest.raises(TypeError, match="not a date"):
        guard.check_dates(spark.createDataFrame([("1998-07-01",)], "d string"), AS_OF, ["d"], "p")
    with pytest.raises(KeyError, match="filing_date"):
        guard.check_dates(df, AS_OF, ["other"], "p")
    assert guard.check_dates(df.where("false"), AS_OF, ["filing_date"], "p")[0].rows == 0


def test_years(spark):
    df = spark.createDataFrame([("a", 1994), ("b", 1999), ("c", None)], "id string, year int")
    with pytest.raises(guard.LookAheadError, match="after 1998"):
        guard.check_years(df, 1998, ["year"], "p")
    assert guard.check_years(df, 1999, ["year"], "p")[0].latest == 1999
    assert guard.check_years(pd.DataFrame({"year": [1990, 1991]}), 1991, ["year"], "p")[0].rows == 2
    with pytest.raises(TypeError, match="not a whole year"):
        guard.check_years(spark.createDataFrame([(True,)], "year boolean"), 1998, ["year"], "p")
    with pytest.raises(TypeError, match="must be a year"):
        guard.check_years(df, True, ["year"], "p")


def test_years_row_by_row(spark):
    df = spark.createDataFrame([(1990, 1990), (1990, 1994), (None, 1990)], "filed int, year int")
    assert guard.check_years_by_row(df, "filed", "year", "p").latest == 0
    with pytest.raises(guard.LookAheadError, match="the worst by 2 years"):
        guard.check_years_by_row(spark.createDataFrame([(1990, 1994), (1996, 1994)], "filed int, year int"), "filed", "year", "p")


PEOPLE = [("P1", "I1", "utility"), ("P1", "I2", "utility"), ("P2", "I1", "utility"), ("P3", "I3", "design"), ("P4", "I3", "plant")]
WHY = "Only utility documents have classification codes"


def test_ledger(spark, tmp_path):
    book = Ledger(log=tmp_path / "log" / "session.log")
    df = spark.createDataFrame(PEOPLE, "doc_id string, contributor_id string, doc_type string")
    kept = book.filter(df, "utility", "doc_type = 'utility'", WHY)
    again = book.filter(kept, "first", "doc_id = 'P1'", WHY)
    book.checkpoint(again, again.select("doc_id").distinct(), "documents", "One row per document from here on")
    book.note("remark", "nothing")
    e = book.entries[0]
    assert (e.rows_before, e.rows_after, e.documents_before, e.documents_after, e.contributors_before, e.contributors_after, e.share_dropped) == (5, 3, 4, 2, 3, 2, 0.4)
    assert book.entries[2].contributors_after is None and book.entries[2].rows_after == 1
    table, diary = book.finish(tmp_path)
    assert len(pd.read_csv(table)) == 4 and "remark" in diary.read_text()
    assert len((tmp_path / "log" / "session.log").read_text().splitlines()) == 4
    with pytest.raises(ValueError, match="shorter than"):
        book.filter(df, "x", "true", "because")
    assert Ledger(count=False).filter(pd.DataFrame({"a": [1, 2]}), "one", "a = 1", WHY).count() == 1


def test_config_reports_every_fault():
    with pytest.raises(config.ConfigError) as caught:
        config.build({"windows": {"spam": 3}, "counting": {"method": "half"}, "birth": {"tolerance": -1}, "universe": {"drop_withdrawn": 1}})
    assert len(caught.value.faults) == 4 and "did you mean windows.span" in str(caught.value)
    with pytest.raises(config.ConfigError, match="first full window"):
        config.build({"measure": {"first_year": 1976}})
    with pytest.raises(config.ConfigError, match="floor.percentile"):
        config.build({"floor": {"mode": "pooled"}})
    with pytest.raises(config.ConfigError, match="unknown width 'x'"):
        config.build({"fields": {"widths": ["x"]}}, lambda: {"class"})


def test_config_hash_and_files(tmp_path):
    base = config.build()
    assert base.hash == config.build({"name": "other", "paths": {"data": "x"}, "runtime": {"shuffle_partitions": 3}}).hash
    assert base.hash != config.build({"counting": {"method": "full"}}).hash
    (tmp_path / "c.json").write_text('{"windows": {"span": 4}}')
    assert config.load(tmp_path / "c.json")["windows.span"] == 4
