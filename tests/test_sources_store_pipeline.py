import random
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldlead import cli, config, pipeline, refusals, report, store
from fieldlead.sources import delimited
from fieldlead.streaming.hopping import hopping_totals

TSV = 'id\tname\tday\n1\t"a\tb"\t0000-00-00\n2\t"say ""x"""\n3\t"two\nlines"\t2001-01-01\n4\t\t007\n'


def archive(folder, members):
    path = folder / "raw.tsv.zip"
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return path


def test_archives_become_parquet(spark, tmp_path, rows):
    path, n = delimited.convert_archive(spark, archive(tmp_path, {"raw.tsv": TSV, "readme.txt": "x"}), tmp_path)
    assert n == 4 and path.name == "raw.tsv.parquet"
    assert rows(spark.read.parquet(str(path))) == [("1", "a\tb", "0000-00-00"), ("2", 'say "x"', None), ("3", "two\nlines", "2001-01-01"), ("4", None, "007")]
    assert delimited.convert_archive(spark, tmp_path / "raw.tsv.zip", tmp_path) == (path, None)
    assert delimited.convert_archive(spark, tmp_path / "raw.tsv.zip", tmp_path, force=True)[1] == 4
    with pytest.raises(ValueError, match="expected one data file"):
        delimited.extract_single(archive(tmp_path, {"a.tsv": "x", "b.csv": "y"}), tmp_path)


def test_typed_reader(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2.5\nx,\n")
    assert [tuple(r) for r in delimited.read_typed(spark, tmp_path / "x.csv", {"a": "int", "b": "double"}).collect()] == [(1, 2.5), (None, None)]
    with pytest.raises(KeyError, match="no column"):
        delimited.read_typed(spark, tmp_path / "x.csv", {"z": "int"})


def test_data_root(monkeypatch):
    monkeypatch.delenv("DATA_DIR", raising=False)
    assert delimited.data_root("here") == "here"
    monkeypatch.setenv("DATA_DIR", "/there")
    assert delimited.data_root("here") == "/there"


def test_tables_and_notes(spark, tmp_path):
    cfg, other = config.build(), config.build({"counting": {"method": "full"}})
    path = tmp_path / "t"
    assert store.write_table(spark.range(5), path, cfg, "step", ["in"]) == 5
    assert store.read_note(path)["rows"] == 5 and store.is_fresh(path, cfg) and not store.is_fresh(path, other)
    store.require_same_config([path], cfg)
    with pytest.raises(store.StaleInput, match="built under"):
        store.require_same_config([path], other)
    (tmp_path / "t.meta.json").unlink()
    with pytest.raises(store.StaleInput, match="no note"):
        store.require_same_config([path], cfg)
    store.write_table(spark.range(2), path, cfg, "step")
    assert store.read_table(spark, path).count() == 2 and not (tmp_path / "unfinished_t").exists()
    with pytest.raises(FileNotFoundError, match="build it first"):
        store.read_table(spark, tmp_path / "none", "build it first")


def test_versions_of_reports(spark, tmp_path):
    cfg = config.build()
    a = store.write_text(tmp_path, "r.md", "# generated: 1\none\n", cfg)
    assert store.write_text(tmp_path, "r.md", "# generated: 2\none\n", cfg) == a
    b = store.write_text(tmp_path, "r.md", "two\n", cfg)
    assert b.name == f"r_{cfg.hash}_v2.md" and a.read_text().endswith("one\n") and (tmp_path / "r.md").read_text() == "two\n"
    assert store.edited_by_hand(tmp_path, ["r.md"]) == []
    (tmp_path / "r.md").write_text("mine\n")
    assert store.edited_by_hand(tmp_path, ["r.md", "none.md"]) == ["r.md"]
    store.write_csv(tmp_path, "c.csv", spark.range(3), cfg, {"rows": 3})
    assert len(store.read_csv(tmp_path / "c.csv")) == 3 and "# rows: 3" in (tmp_path / "c.csv").read_text()
    store.write_table(spark.range(1), tmp_path / "t", cfg, "s")
    store.write_index(tmp_path, [tmp_path / "t", tmp_path / "gone"], cfg)
    text = store.write_index(tmp_path, [tmp_path / "t"], config.build({"birth": {"tolerance": 3}})).read_text()
    assert "STALE" in text and "birth.tolerance: 2 -> 3" in text


def synthetic(spark):
    random.seed(6)
    docs, listings, codes = [], [], []
    groups = [("A", "A61", "A61K", "A61K31/05"), ("A", "A61", "A61P", "A61P3/00"), ("H", "H01", "H01L", "H01L21/02")]
    for i in range(600):
        year = random.randrange(1974, 2024)
        docs.append((f"d{i}", random.choice(["utility"] * 5 + ["design"]), random.choice([None, 0, 0, 1]), f"{year}-05-01", f"{year + 2}-05-01"))
        for s in range(random.choice([0, 1, 1, 2, 3])):
            listings.append((f"d{i}", f"i{int(random.paretovariate(0.7)) % 15}", s))
        for s, g in enumerate(random.sample(groups, random.choice([1, 2]))):
            codes.append((f"d{i}", str(s), *g))
    return {
        "documents": spark.createDataFrame(docs, "doc_id string, doc_type string, withdrawn int, f string, g string").select("doc_id", "doc_type", "withdrawn", F.to_date("f").alias("filing_date"), F.to_date("g").alias("grant_date")),
        "listings": spark.createDataFrame(listings, "doc_id string, contributor_id string, sequence int"),
        "codes": spark.createDataFrame(codes, "doc_id string, code_sequence string, code_section string, code_class string, code_subclass string, code_group string"),
    }


def test_the_whole_run(spark, tmp_path):
    tables = synthetic(spark)
    cfg = config.build({"floor": {"mode": "per_year", "percentile": 50}, "fields": {"widths": ["class"]}})
    index = pipeline.run(spark, cfg, tables, tmp_path)
    text = (tmp_path / "report_class.md").read_text()
    assert "FAILED" not in text and text.count("passed") == 21 and "STALE" not in index.read_text()
    assert "orphan documents" in (tmp_path / "diary.md").read_text()
    sections = {r["section"]: r["lines"] for r in report.sections_frame(spark, text).collect()}
    assert set(sections) == {"Panel checks", "Selection checks", "Floors", "summary", "Persistence in words", "The floor in words", "cells", "loose_exposure", "decomposition", "field_size", "exclusions", "curve", "fields_per_contributor", "fields_with_several", "filing_years"} and sections["cells"] == 14


def identities(spark, tables):
    """Old identities of the listings' slots, a release table and candidate records for them."""
    slots = tables["listings"].collect()
    release = [(r["doc_id"], r["sequence"], f"{r['doc_id']}-{r['sequence'] + 1}" if i % 3 else f"o-{r['contributor_id']}", r["contributor_id"]) for i, r in enumerate(slots)]
    old = [(o, d) for d, _, o, _ in release]
    names = sorted({o for o, _ in old})
    records = [(o, "s", 3 + i % 4, 1980 + i % 40, f"{1980 + i % 40}-01-01", 1920 + i % 30) for i, o in enumerate(names)] + [(names[0], "t", 9, 2020, "2020-01-01", 1900), ("nobody", "s", 9, 2000, "2000-01-01", 1950), (names[1], "s", 5, 0, "x", None)]
    years = [(o, 1921 + i % 30 if i % 7 else None, i % 5, 1, 1) for i, o in enumerate(names)]
    return {
        "release": spark.createDataFrame(release, "doc_id string, sequence int, release_old string, release_current string"),
        "identity_documents": spark.createDataFrame(old, "identity_id string, doc_id string"),
        "records": spark.createDataFrame(records, "identity_id string, source string, score int, event_year int, event_date string, birth_year int"),
        "years": spark.createDataFrame(years, "identity_id string, preferred_year int, best_score int, sources_with_a_year int, sources_backing int"),
        "names": spark.createDataFrame([(o, f"NAME {i % 5}, jr.") for i, o in enumerate(names)], "identity_id string, name string"),
        "contributor_names": spark.createDataFrame(sorted({(c, f"Name {i}") for _, _, _, c in release for i in range(5)}), "contributor_id string, name string"),
        "edges": spark.createDataFrame([(f"d{i % 25}", f"d{i % 45}", ("A", "R", " ")[i % 3]) for i in range(400)], "citing_id string, cited_id string, category string"),
    }


def test_edges_links_and_events_of_a_run(spark, tmp_path):
    tables = synthetic(spark)
    tables |= identities(spark, tables)
    tree = {"floor": {"mode": "per_year", "percentile": 50}, "fields": {"widths": ["class", "subclass"]}, "edges": {"examiner": "R"}}
    text = pipeline.run(spark, config.build(tree), tables, tmp_path / "a").read_text()
    assert all(f"| {n} |" in text for n in ("edges", "links", "birth_years", "events")) and "MISSING" not in text
    links, events = (store.read_table(spark, tmp_path / "a" / n) for n in ("links", "events"))
    assert links.count() == tables["identity_documents"].select("identity_id").distinct().count() and {"agreement", "routes_agree", "documents"} <= set(links.columns)
    assert events.count() > 0 and events.where("event_year not between 1986 and 2016 or identity_id = 'nobody'").count() == 0 and events.groupBy("person").count().where("count > 1").count() == 0
    raw = config.build(tree | {"edges": {"deduplicate": False, "examiner": "R"}, "events": {"tie_rule": "drop"}, "link": {"require_identical": True}, "birth": {"treated_rule": "strict"}})
    pipeline.run(spark, raw, {k: v for k, v in tables.items() if "names" not in k}, tmp_path / "b")
    same = [store.read_table(spark, tmp_path / x / "edges") for x in "ab"]
    assert same[0].columns == same[1].columns and same[0].agg(F.sum("records")).first()[0] == same[1].count() > same[0].count()
    assert store.read_table(spark, tmp_path / "b" / "links").where("agreement <> 'identical'").count() == 0 and store.read_table(spark, tmp_path / "b" / "links").count() < links.count()
    assert "both agree" in (tmp_path / "a" / "links.md").read_text() and "In words" in (tmp_path / "a" / "report_widths.md").read_text()
    assert "Contributors that widths share" in (tmp_path / "a" / "report_widths.md").read_text() and "top-coded" in (tmp_path / "a" / "birth_years.md").read_text()
    with pytest.raises(ValueError, match="below the floor"):
        pipeline.run(spark, config.build(tree), tables | {"contributor_names": tables["contributor_names"].where("false")}, tmp_path / "c")


def test_refused_settings(spark, tmp_path):
    for tree, match in (
        ({"counting": {"field_size": "fractional"}}, "whole documents only"), ({"select": {"metric": "citation_share"}}, "document_share"), ({"select": {"max_rank": 2}}, "rank 1 only"),
        ({"select": {"cutoffs": [0.01, 0.02, 0.03, 0.05, 0.06, 0.07, 0.08]}}, "7 values and the figure 6 lines"),
    ):
        with pytest.raises(refusals.Refused, match=match):
            pipeline.run(spark, config.build(tree), {}, tmp_path)
    with pytest.raises(refusals.Refused, match="codes.assignment"):
        refusals.filing_years_need_primary_codes(config.build({"codes": {"assignment": "all"}}))
    assert refusals.floors_to_report(config.build())[0] == [True, False]
    assert refusals.floors_to_report(config.build({"report": {"both_floors": False, "with_floor": False}}))[0] == [False]


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    archive(tmp_path, {"raw.tsv": TSV})
    assert cli.main(["convert", str(tmp_path / "raw.tsv.zip"), "--out", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out" / "raw.tsv.parquet")).count() == 4


def test_hopping_windows(spark, tmp_path):
    rows = [("2024-01-01 12:00:00", "a", 1.0), ("2024-01-03 12:00:00", "a", 2.0), ("2024-01-03 12:00:00", "b", 5.0), ("2024-02-20 00:00:00", "a", 9.0)]
    df = spark.createDataFrame(rows, "t string, k string, v double").withColumn("t", F.to_timestamp("t"))
    batch = hopping_totals(df, "t", "k", "v", "5 days", "1 day").where("k = 'a' and total = 3.0")
    assert batch.count() == 3
    df.write.parquet(str(tmp_path / "in"))
    stream = hopping_totals(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "t", "k", "v", "5 days", "1 day")
    query = stream.writeStream.format("memory").queryName("hops").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(60)
    assert spark.table("hops").where("k = 'a' and total = 3.0").count() == 3


def test_places_on_any_file_system(spark, tmp_path):
    from fieldlead.files import Place

    for root in (Place(tmp_path), Place(f"file://{tmp_path}")):
        at = root / "a" / "b.txt"
        assert at.name == "b.txt" and at.sibling("c.txt") == root / "a" / "c.txt" and not at.exists()
        at.write_text("Zeile ü\n")
        assert at.exists() and at.read_text() == "Zeile ü\n" and [p.name for p in (root / "a").inside()] == ["b.txt"]
        at.rename(at.sibling("c.txt"))
        assert not at.exists() and at.sibling("c.txt").read_text() == "Zeile ü\n" and at.sibling("c.txt").modified() > 0
        with pytest.raises(OSError, match="could not be renamed"):
            (root / "none").rename(root / "other")
        (root / "a").delete()
        (root / "a").delete()
        assert (root / "a").inside() == []
    cfg = config.build()
    store.write_table(spark.range(4), f"file://{tmp_path}/t", cfg, "s")
    assert store.read_note(tmp_path / "t")["rows"] == 4 and store.read_table(spark, f"file://{tmp_path}/t").count() == 4


def test_versions_are_read_by_number(spark, tmp_path):
    cfg = config.build()
    for i in range(12):
        store.write_text(tmp_path, "r.md", f"{i}\n", cfg)
    assert store.edited_by_hand(tmp_path, ["r.md"]) == []
    (tmp_path / "r.md").write_text("9\n")
    assert store.edited_by_hand(tmp_path, ["r.md"]) == ["r.md"]


def test_figure_and_sentences():
    points = pd.DataFrame([("a", True, 1, 1.0), ("a", True, 2, 0.5), ("b", True, 1, 1.0), ("a", False, 1, 1.0)], columns=["rule", "with_floor", "k", "share"])
    text = report.persistence_figure(points, ["a", "b", "c"], ["black", "blue", "red"], 3, True)
    assert text.count("<polyline") == 2 and text.count("stroke-dasharray") == 2 and text == report.persistence_figure(points.sample(frac=1, random_state=1), ["a", "b", "c"], ["black", "blue", "red"], 3, True)
    cell = {"pairs": 4, "median_years": 2.5, "contiguous": 3, "edge_touching": 1, "median_years_interior": 3.0}
    said = report.describe_persistence(cell, {"pairs": 4, "one_filing_year": 1, "span_or_more": 2}, 3)
    assert "2.5 window-years" in said and "3 of 4 (75.0%)" in said and "no longer than that" in said and "1 of 4 (25.0%) have a single filing year" in said
    assert "nothing to say" in report.describe_persistence(cell | {"pairs": 0}, None, 3)
    said = report.describe_floor([{"rule": "r", "pairs": 10, "lost_field_never": 3, "lost_other_year": 1}, {"rule": "s", "pairs": 2, "lost_field_never": 0, "lost_other_year": 0}, {"rule": "t", "pairs": 5, "lost_field_never": 0, "lost_other_year": 2}])
    assert "4 of 10 (40.0%) pairs, most of them for fields that never reach it" in said and "takes nothing from 2 pairs" in said and "too small" in said.splitlines()[2]
    assert report.describe_widths([], {}) == "No two widths share a contributor." and "2 of 4 (50.0%)" in report.describe_widths([{"left": "a", "right": "b", "shared": 2}], {"a": 4, "b": 9})


def test_split_reading_gives_the_same_table(spark, tmp_path, rows):
    """Blocks of 40 bytes: nearly every record is cut somewhere, some span several blocks."""
    random.seed(12)

    def field(i):
        plain = random.choice(["", "x", "007", "0000-00-00", "ü é", "long " * random.randrange(1, 12)])
        return '"' + (plain + random.choice(["", "\t", "\n", '""', "\n\n", 'a ""b""\tc'])) + '"' if random.random() < 0.4 else plain

    for end in ("\n", "\r\n"):
        lines = ["id\tname\tday"] + [f"{i}\t{field(i)}\t{field(i)}" if i % 9 else f"{i}\tshort" for i in range(300)]
        path = tmp_path / f"t{len(end)}.tsv"
        path.write_bytes((end.join(lines) + (end if end == "\n" else "")).encode())
        want = rows(delimited.read_delimited(spark, path))
        for size in ("40", "1000", "134217728"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            try:
                got = delimited.read_split(spark, path)
                assert got.columns == ["id", "name", "day"] and rows(got) == want, (end, size)
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "open.tsv").write_text('id\tname\n1\t"never closed\n2\tx\n')
    with pytest.raises(Exception, match="not closed"):
        delimited.read_split(spark, tmp_path / "open.tsv").collect()
