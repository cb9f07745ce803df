import pytest
from pyspark.sql import functions as F

from fieldlead.operators import edges, evidence, link


def pairs(spark, rows):
    return spark.createDataFrame(rows, "identity_id string, contributor_id string")


def test_release_link(spark, rows):
    df = pairs(spark, [("100-1", "smith-1")] * 3 + [("100-1", "smith-9"), ("200-1", "z-9"), ("200-1", "a-1"), ("300-1", ""), ("", "x"), (None, "x"), ("400-1", None)])
    out = {r["identity_id"]: r for r in link.release_link(df).collect()}
    assert set(out) == {"100-1", "200-1"}
    assert tuple(out["100-1"])[1:] == ("smith-1", 2, 3, 0.75) and tuple(out["200-1"])[1:] == ("a-1", 2, 1, 0.5)
    assert link.coverage(df.where("identity_id <> ''"), link.release_link(df)).first()["coverage"] == 0.5
    with pytest.raises(ValueError, match="below the floor"):
        link.require_coverage(df.where("identity_id <> ''"), link.release_link(df), 0.99, "release")
    assert link.coverage(df.where("false"), df.where("false")).first()["coverage"] is None


def test_release_column(spark):
    table = spark.createDataFrame([(1, 2)], "release_2018 int, release_2025 int")
    link.require_release(table, "release_2025", "release_")
    with pytest.raises(KeyError, match="release_2018"):
        link.require_release(table, "release_1999", "release_")


def test_coordinates(spark, rows):
    slots = spark.createDataFrame([("H1838", 0, "a"), ("39", 1, "b"), ("39", 1, "c")], "doc_key string, place int, contributor_id string")
    ids = spark.createDataFrame([("H0018384-1",), ("39-2",), ("39-1",), ("39-x",), (None,)], "identity_id string")
    assert rows(link.coordinate_link(ids, slots)) == [("39-2", "b"), ("H0018384-1", "a")]


def test_places_on_a_document(spark, rows):
    df = spark.createDataFrame([("d", "b", 7), ("d", "a", 7), ("d", "c", 2), ("e", "a", None)], "doc_id string, contributor_id string, sequence int")
    assert rows(link.same_slot(df).select("doc_id", "contributor_id", "place")) == [("d", "a", 1), ("d", "b", 2), ("d", "c", 0), ("e", "a", 0)]


def test_owner_rule(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), (None, "b"), ("a", None), (None, None)], "release_contributor string, coordinate_contributor string")
    owner, agree = link.owner()
    assert [tuple(r) for r in df.select(owner, agree).collect()] == [("a", False), ("a", True), ("b", None), ("a", None), (None, None)]
    assert df.select(link.owner("coordinate")[0]).first()[0] == "b"
    with pytest.raises(ValueError, match="unknown route"):
        link.owner("other")


def test_agreement_of_sets(spark):
    left = spark.createDataFrame([("1", "d1"), ("1", "d2"), ("2", "d1"), ("3", "d1"), ("3", "d9"), ("4", "d8")], "identity_id string, doc_id string")
    right = spark.createDataFrame([("a", "d1"), ("a", "d2"), ("b", "d1"), ("b", "d7"), ("c", "d1"), ("d", "d0"), ("e", "d1"), ("e", "d1")], "contributor_id string, doc_id string")
    linked = pairs(spark, [("1", "a"), ("2", "b"), ("3", "c"), ("4", "d")])
    out = {r["identity_id"]: r["agreement"] for r in link.set_agreement(linked, left, right).collect()}
    assert out == {"1": "identical", "2": "right_has_more", "3": "split_differently", "4": "no_overlap"}
    doubled = pairs(spark, [("2", "e")])
    assert link.set_agreement(doubled, left, right).first()["agreement"] == "split_differently"
    assert link.set_agreement(doubled, left, right, distinct=True).first()["agreement"] == "identical"


def test_names_without_case_and_accents(spark):
    left = spark.createDataFrame([("1", "Müller"), ("2", "Harlow, Jr."), ("3", "Smith")], "identity_id string, name string")
    right = spark.createDataFrame([("a", "MULLER"), ("b", "harlow"), ("c", "Jones"), ("c", None)], "contributor_id string, name string")
    row = link.name_agreement(pairs(spark, [("1", "a"), ("2", "b"), ("3", "c")]), left, right).first()
    assert (row["compared"], row["agreeing"]) == (3, 2)
    linked = pairs(spark, [("1", "a"), ("2", "b"), ("3", "c")])
    assert link.require_name_agreement(linked, left, right, 0.6, "names") == pytest.approx(2 / 3)
    with pytest.raises(ValueError, match="names: 2 of 3 compared links"):
        link.require_name_agreement(linked, left, right, 0.99, "names")
    with pytest.raises(ValueError, match="0 of 0"):
        link.require_name_agreement(linked.where("false"), left, right, 0.5, "names")


TRUTH = [
    (("R", "R"), "R", False, True, True, True), (("R", "A"), None, True, True, False, None), (("R", None), "R", False, True, True, True),
    (("A", None), "A", False, False, False, False), ((None, None), None, False, None, None, None),
]


@pytest.mark.parametrize("rule", edges.RULES)
def test_edge_rules(spark, rule):
    df = spark.createDataFrame([(i, 0, c) for i, case in enumerate(TRUTH) for c in case[0]], "citing_id int, cited_id int, category string").withColumns({c: F.lit(1990) for c in edges.CITING})
    out = {r["citing_id"]: r for r in edges.collapse_edges(df, rule, "R").collect()}
    for i, case in enumerate(TRUTH):
        assert (out[i]["category"], out[i]["conflicted"], out[i]["by_examiner"]) == (case[1], case[2], case[3 + edges.RULES.index(rule)])
    assert set(edges.raw_edges(df, "R").columns) == set(edges.collapse_edges(df, rule, "R").columns)


def test_edge_dates_and_blanks(spark):
    grants = spark.createDataFrame([(1, "2000-01-01")], "doc_id int, g string").select("doc_id", F.to_date("g").alias("grant_date"))
    known = spark.createDataFrame([(2, 1999)], "doc_id int, year int")
    df = spark.createDataFrame([(1, 7, " "), (2, 7, "R"), (1, 8, "R"), (3, 7, None)], "citing_id int, cited_id int, category string")
    received = edges.edges_received(df, grants, known, spark.createDataFrame([(7,)], "doc_id int"))
    out = {(r["citing_id"], r["cited_id"]): (r["category"], str(r["citing_grant_date"]), r["citing_grant_year"], r["citing_application_year"]) for r in received.collect()}
    assert out == {(1, 7): (None, "2000-01-01", 2000, None), (2, 7): ("R", "None", None, 1999), (3, 7): (None, "None", None, None)}
    kept = edges.collapse_edges(received.unionByName(received), "any_examiner", "R").where("citing_id = 1").first()
    assert (kept["records"], kept["citing_grant_year"], kept["citing_application_year"]) == (2, 2000, None)
    with pytest.raises(ValueError, match="unknown rule"):
        edges.examiner_flag("other", "R")


RECORDS = [
    ("modal", 9, 2001, "b", 1950), ("modal", 9, 2001, "a", None), ("modal", 9, 1999, "c", 1940), ("modal", 5, 1980, "z", 1900), ("even", 3, 2005, "d", None), ("even", 3, 2003, "e", 1930),
    ("one", 1, 1990, "f", 0), ("zero", 4, 0, "g", 1), ("low", -1, 1990, "h", 1),
]


@pytest.mark.parametrize(("rule", "want"), [("modal_then_earliest", {"modal": 2001, "even": 2003, "one": 1990}), ("earliest", {"modal": 1999, "even": 2003, "one": 1990}), ("latest", {"modal": 2001, "even": 2005, "one": 1990}), ("drop", {"one": 1990})])
def test_consensus(spark, rule, want):
    df = evidence.usable_records(spark.createDataFrame(RECORDS, "identity_id string, score int, event_year int, event_date string, birth_year int"), 0)
    out = {r["identity_id"]: r for r in evidence.consensus(df, rule).collect()}
    assert {k: r["event_year"] for k, r in out.items()} == want
    if rule == "modal_then_earliest":
        assert (out["modal"]["event_date"], out["modal"]["record_birth_year"], out["modal"]["candidate_years"], out["modal"]["ambiguous"]) == ("a", 1950, 2, True)
    with pytest.raises(ValueError, match="unknown tie rule"):
        evidence.consensus(df, "other")


def test_years_from_sources(spark):
    raw = spark.createDataFrame([("a", 1950, 3, 1950, 0, None), ("a", None, 5, 1951, None, 1950), ("b", None, None, None, None, None)], "identity_id string, p int, s1 int, y1 int, s2 int, y2 int")
    out = {r["identity_id"]: r for r in evidence.best_of_sources(raw, {"one": ("s1", "y1"), "two": ("s2", "y2")}, "p").collect()}
    assert tuple(out["a"])[1:] == (1950, 5, 2, 1) and tuple(out["b"])[1:] == (None, None, 0, 0)
    years = spark.createDataFrame([("a", 1950, 0), ("b", 1950, 1), ("c", None, 9)], "identity_id string, preferred_year int, best_score int")
    assert [r[0] for r in evidence.eligible(years, 0).collect()] == ["b"] and evidence.eligible(years, 0, inclusive=True).count() == 2


def test_strict_and_loose_years(spark):
    years = spark.createDataFrame([("a", 1950, 1, 1, 1), ("b", 1960, 1, 1, 1), ("c", 1970, 1, 1, 1)], "identity_id string, preferred_year int, best_score int, sources_with_a_year int, sources_backing int")
    records = spark.createDataFrame([("a", 7, 2000, "x", 1951), ("a", 7, 1999, "x", 1949), ("a", 9, 2001, "x", 1980), ("b", 5, 2000, "x", 1990)], "identity_id string, score int, event_year int, event_date string, birth_year int")
    table = evidence.year_table(years, evidence.consensus(records), evidence.within_tolerance(records, years, 2), evidence.gaps(records, years))
    out = {r["identity_id"]: r for r in table.collect()}
    assert (out["a"]["strict_birth_year"], out["a"]["passes"], out["a"]["min_gap"], out["a"]["loose_year"]) == (1949, True, 1, 1980)
    assert (out["b"]["passes"], out["b"]["strict_birth_year"]) == (False, None)
    assert (out["c"]["passes"], out["c"]["loose_year"], out["c"]["loose_source"]) == (None, 1970, "sources")


def test_whole_rows_collapse(spark):
    df = spark.createDataFrame([("p", "1", False, None, 1950), ("p", "2", True, 4, 1950), ("p", "3", True, 9, 1960), ("q", "4", False, None, None)], "person string, identity_id string, has_event boolean, score int, y int")
    order = [F.col("has_event").desc(), F.col("score").desc_nulls_last(), F.col("identity_id").asc()]
    out = {r["person"]: r for r in evidence.collapse_identities(df, "person", order, "y").collect()}
    assert (out["p"]["identity_id"], out["p"]["identities"], out["p"]["conflict"]) == ("3", 3, True) and (out["q"]["identities"], out["q"]["conflict"]) == (1, False)


def test_the_window_comes_before_the_pick(spark, rows):
    """p's best event lies outside the window and must not hide the lesser one inside; q has two equal ones inside; r has none."""
    cols = "identity_id string, best_score int, event_year int, event_date string, record_birth_year int, candidate_years bigint, ambiguous boolean"
    events = spark.createDataFrame([("1", 9, 2020, "x", 1950, 1, False), ("2", 5, 2001, "x", None, 1, False), ("3", 7, 2003, "x", 1940, 2, True), ("4", 7, 2002, "x", 1930, 1, False), ("5", 9, 1970, "x", 1900, 1, False), ("6", 8, 2004, "x", None, 1, False)], cols)
    links = spark.createDataFrame([("1", "p"), ("2", "p"), ("3", "q"), ("4", "q"), ("5", "r"), ("6", "s")], "identity_id string, person string")
    picked = evidence.person_events(events, links, 1986, 2016)
    assert rows(picked.select("person", "identity_id", "event_year", "identities", "event_year_conflict")) == [("p", "2", 2001, 1, False), ("q", "4", 2002, 2, True), ("s", "6", 2004, 1, False)]
    people = spark.createDataFrame([("p", 1960, 1950, 1961, True, 1), ("q", 1931, 1940, 1990, False, 9), ("x", 1, 1, 1, True, 0)], "person string, preferred_year int, loose_year int, strict_birth_year int, passes boolean, min_gap int")
    loose = {r["person"]: r for r in evidence.event_table(picked, people).collect()}
    assert (loose["p"]["loose_year"], loose["p"]["loose_source"], loose["p"]["age"], loose["p"]["general_year_agrees"]) == (1960, "sources", 41, False)
    assert (loose["q"]["loose_year"], loose["q"]["loose_source"], loose["q"]["age_loose"], loose["q"]["age_strict"]) == (1930, "event_record", 72, 12)
    assert (loose["s"]["loose_year"], loose["s"]["loose_source"], loose["s"]["age"], loose["s"]["general_year_agrees"]) == (None, None, None, True)
    strict = evidence.event_table(picked, people.withColumn("strict_birth_year", F.lit(2010)), "strict")
    assert strict.where("age_impossible").count() == 2
    notes = evidence.event_notes(strict, 2).first()
    assert (notes["events"], notes["with_age"], notes["impossible"], notes["within_tolerance"], notes["merged"], notes["conflicting"], notes["general_year_differs"]) == (3, 2, 2, 1, 1, 1, 2)
    with pytest.raises(ValueError, match="unknown rule"):
        evidence.event_table(picked, people, "other")


def test_person_order_uses_documents(spark):
    df = spark.createDataFrame([("p", "2", False, None, None, 7, 1), ("p", "1", False, None, None, 3, 1), ("q", "3", True, 2, 1999, 1, 1), ("q", "4", False, None, None, 99, 1)], "person string, identity_id string, has_event boolean, event_score int, event_year int, documents bigint, y int")
    out = {r["person"]: r["identity_id"] for r in evidence.collapse_identities(df, "person", evidence.person_order(), "y").collect()}
    assert out == {"p": "2", "q": "3"}


def test_anchor_of_the_current_release(spark):
    release = spark.createDataFrame([("d1", 0, "o1", "a"), ("d1", 1, "o2", "b"), ("d2", 0, "o3", ""), ("d3", 0, "o4", "c"), ("d9", 0, "o5", "x")], "doc_id string, sequence int, release_1 string, release_2 string")
    listed = spark.createDataFrame([("d1", 0, "a"), ("d1", 1, "b"), ("d2", 0, "z"), ("d3", 0, "c")], "doc_id string, sequence int, contributor_id string")
    assert link.require_anchor(release, listed, "release_2", "release_") == 1.0
    with pytest.raises(ValueError, match="another release; releases here: .'release_1', 'release_2'"):
        link.require_anchor(release, listed, "release_1", "release_")
    with pytest.raises(KeyError, match="release_2"):
        link.require_anchor(release, listed, "release_3", "release_")
    with pytest.raises(ValueError, match="shares no slot"):
        link.require_anchor(release, listed.where("false"), "release_2", "release_")


def test_both_routes_are_tested_by_names(spark):
    owners = spark.createDataFrame([("1", "a", "b"), ("2", "c", None), ("3", None, "d")], "identity_id string, release_contributor string, coordinate_contributor string")
    left = spark.createDataFrame([("1", "Ash"), ("2", "Birch"), ("3", "Cedar")], "identity_id string, name string")
    right = spark.createDataFrame([("a", "ash"), ("b", "Oak"), ("c", "Birch"), ("d", "Cedar")], "contributor_id string, name string")
    assert link.both_name_agreements(owners, left, right, "release", 0.9, "n") == {"release": 1.0, "coordinate": 0.5, "owner": 1.0}
    with pytest.raises(ValueError, match="below the floor"):
        link.both_name_agreements(owners, left, right, "coordinate", 0.9, "n")


def test_vintages(spark, rows):
    links = spark.createDataFrame([("1", "a"), ("2", "b")], "identity_id string, contributor_id string")
    verdicts = spark.createDataFrame([("1", "a", "identical"), ("2", "b", "no_overlap")], "identity_id string, contributor_id string, agreement string")
    assert rows(link.same_vintage(links, verdicts, True)) == [("1", "a", "identical")] and link.same_vintage(links, verdicts, False).count() == 2
