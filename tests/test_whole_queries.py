"""Queries that take the whole of their tables, on rows that the samples leave out."""

import pytest

from fieldlead.plans import core_queries


@pytest.mark.parametrize(("width", "want"), [("class", ["A61", "C07", "C08", "H01"]), ("subclass", ["A61K", "C07D", "C08F", "H01L"]), ("main_group", ["A61K31/00", "C07D1/00", "C08F2/00", "H01L21/00"])])
def test_primary_codes_of_all_sections(spark, tmp_path, rows, width, want):
    codes = {"a": ("A", "A61", "A61K", "A61K31/05"), "b": ("C", "C07", "C07D", "C07D1/02"), "c": ("C", "C08", "C08F", "C08F2/01"), "d": ("H", "H01", "H01L", "H01L21/02")}
    sequences = [("a", "0"), ("b", "0"), ("c", " 0"), ("d", "000 "), ("a", "1"), *[("d", x) for x in ("#0", "0.0", "+0", "", " ", None, "0000 1")]]
    df = spark.createDataFrame([(p, s, *codes[p]) for p, s in sequences], "patent_id string, cpc_sequence_text string, cpc_section string, cpc_class string, cpc_subclass string, cpc_group string")
    df.write.parquet(str(tmp_path / "cpc_rows.parquet"))
    assert rows(core_queries.QUERIES[f"primary_code_{width}_whole"](spark, str(tmp_path))) == list(zip("abcd", want))


@pytest.mark.parametrize(("name", "want"), [
    ("edges_received_whole", 4), ("edges_raw_schema_whole", 4),
    ("edges_dedup_any_whole", [(1, 7, None, True, True, 2), (1, 8, None, True, True, 2)]), ("edges_dedup_all_whole", [(1, 7, None, True, False, 2), (1, 8, None, True, False, 2)]),
    ("edges_dedup_drop_whole", [(1, 7, None, True, None, 2), (1, 8, None, True, None, 2)]),
])
def test_edges_to_every_product(spark, tmp_path, rows, name, want):
    lines = [(1, 7, "R"), (1, 7, "A"), (1, 8, "R"), (1, 8, "A")]
    spark.createDataFrame([(*x, "2000-01-01") for x in lines], "l_suppkey long, l_partkey long, l_returnflag string, l_shipdate string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(7, 25), (8, 26)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, 5.0, 4)], "s_suppkey long, s_acctbal double, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    got = core_queries.QUERIES[name](spark, str(tmp_path))
    citer = ("citing_grant_date", "citing_grant_year", "citing_application_year")
    assert {tuple(map(str, r)) for r in got.select(*citer).collect()} == {("2000-01-01", "2000", "1974")}
    got = got.drop(*citer)
    assert got.count() == want if isinstance(want, int) else rows(got) == want


def test_owner_with_one_vote(spark, tmp_path, rows):
    """Customer 5 has one vote for each of two suppliers; customer 6 has no lines, so that neither route speaks."""
    spark.createDataFrame([(1, 5), (2, 6)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, 1, 31), (1, 2, 30)], "l_orderkey long, l_linenumber long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = core_queries.QUERIES["owner_precedence_whole"](spark, str(tmp_path))
    assert rows(got) == [("1-1", 30, 31, 30, False), ("2-2", None, None, None, None)]
