import pytest

from fieldlead.llm import queries


@pytest.mark.parametrize("name", queries.SQL)
def test_matches_sql(compare, name):
    left, right = compare(queries.QUERIES[name], queries.SQL[name])
    assert left == right


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_quality_on_held_out_labels(spark):
    """Accuracy on labelled documents that were not inspected; the names of a few dozen components cannot memorise them."""
    for size, least in (("0.01", 0.85), ("0.1", 0.97)):
        held_out(spark, f"/root/testdata/sf{size}", least)


def held_out(spark, folder, least):
    labels = spark.read.parquet(f"{folder}/doc_labels.parquet")
    held = labels.where("doc_id % 2 = 1")
    from fieldlead.llm import quality

    kinds = quality.document_kinds(spark.read.parquet(f"{folder}/documents.parquet"), labels.where("doc_id % 2 = 0"), spark.read.parquet(f"{folder}/common_words.parquet"))
    rows = held.join(kinds, "doc_id").selectExpr("(label <> 'prose') = (prose_share < 0.5) as right").collect()
    assert sum(r[0] for r in rows) >= least * len(rows)
