from fieldlead import config, pipeline, store
from tests.test_sources_store_pipeline import synthetic


def test_run_writes_pairs_and_loose_exposure(spark, tmp_path):
    cfg = config.build({"floor": {"mode": "per_year", "percentile": 50}, "fields": {"widths": ["class"]}})
    index = pipeline.run(spark, cfg, synthetic(spark), tmp_path)
    pairs = store.read_table(spark, tmp_path / "pairs_class").collect()
    assert {(r["rule"], r["with_floor"]) for r in pairs} == {("cutoff_0500", True)} and "pairs_class" in index.read_text()
    cell = next(r for _, r in store.read_csv(tmp_path / "cells_class.csv").iterrows() if r["rule"] == "cutoff_0500" and str(r["with_floor"]) == "True")
    loose = next(r for _, r in store.read_csv(tmp_path / "loose_exposure_class.csv").iterrows() if r["rule"] == "cutoff_0500" and str(r["with_floor"]) == "True")
    assert len(pairs) == int(cell["pairs"]) and sum(r["years"] for r in pairs) == int(cell["exposure"]) <= int(loose["loose_exposure"])
