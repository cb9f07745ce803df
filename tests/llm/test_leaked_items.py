from fieldlead.llm import queries


def test_items_in_short_pieces_are_reported(spark, tmp_path, rows):
    """An item whose pieces of eight words stand in another order leaks by coverage alone."""
    item = [f"word{i}" for i in range(30)]
    other = [f"term{i}" for i in range(30)]
    pieces = [*item[16:24], "filler", *item[:8], "padding", *item[8:16]]
    docs = [(1, " ".join(pieces)), (2, " ".join(["start", *other[:12], "end"])), (3, " ".join(["start", *other[:6], "gap", *other[12:20]])), (4, " ".join(other[20:28]))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, " ".join(item)), (8, " ".join(other))], "item_id long, item_text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    got = queries.p7_leaked_items(spark, str(tmp_path)).select("item_id", "documents", "longest_tile", "coverage")
    assert rows(got) == [(7, 1, 8, 24 / 30), (8, 1, 12, 12 / 30)]
