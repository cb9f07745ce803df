"""The stages: spine, edges, links, events -> panel -> selection, each written, read again and checked."""

from __future__ import annotations

import functools
from collections.abc import Mapping
from os import PathLike

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldlead import checks, guard, refusals, report, store
from fieldlead.config import Config
from fieldlead.files import Place
from fieldlead.ledger import Ledger
from fieldlead.operators import edges, evidence, fields, link, panel, selection, spine


def build(spark: SparkSession, cfg: Config, tables: Mapping[str, DataFrame], out: str | PathLike, ledger: Ledger | None = None) -> dict[str, Place]:
    """Universe, document fields and spine from documents, listings and codes (see the operators for their columns)."""
    folder, ledger = Place(out), ledger or Ledger()
    primary = cfg["codes.primary_sequence"] if cfg["codes.assignment"] == "primary" else None
    section = cfg["sample.section"] if cfg["sample.enabled"] else None
    if primary is not None:
        fields.require_primary_rows(tables["codes"], primary)
    universe = spine.universe(tables["documents"], cfg["universe.first_year"], cfg["universe.complete_through"], cfg["universe.types"], cfg["universe.drop_withdrawn"], cfg["universe.date_by"])
    ledger.checkpoint(tables["documents"], universe, "universe", "Documents of the chosen types, dated, not withdrawn, within the complete years")
    paths = {"documents": folder / "documents"}
    store.write_table(universe, paths["documents"], cfg, "build")
    known = store.read_table(spark, paths["documents"])
    base = cfg["fields.widths"][0]
    for width in cfg["fields.widths"]:
        own = spine.restricted(fields.assign_fields(tables["codes"], width, primary, section), known)
        paths[f"fields_{width}"] = folder / f"fields_{width}"
        store.write_table(own, paths[f"fields_{width}"], cfg, "build", [paths["documents"]])
        dated = tables["listings"].select("doc_id", "contributor_id", "sequence").join(known.select("doc_id", "year"), "doc_id")
        rows = spine.spine(dated, store.read_table(spark, paths[f"fields_{width}"]), cfg["counting.method"], primary is None and cfg["codes.multi_code_weighting"] == "fractional")
        paths[f"spine_{width}"] = folder / f"spine_{width}"
        store.write_table(rows, paths[f"spine_{width}"], cfg, "build", [paths["documents"], paths[f"fields_{width}"]])
    if cfg["counting.method"] == "fractional" and primary is not None:
        faults = spine.weight_faults(store.read_table(spark, paths[f"spine_{base}"]))
        examples = faults.limit(5).collect()
        if examples:
            raise ValueError(f"credit does not add up to one for {faults.count()} documents, such as {examples}")
    orphans = spine.orphan_documents(known, tables["listings"]).count()
    ledger.note("orphan documents", f"{orphans} documents of the universe have no listing; they stay in the field sizes")
    return paths


def build_edges(spark: SparkSession, cfg: Config, tables: Mapping[str, DataFrame], built: Mapping[str, Place], out: str | PathLike, ledger: Ledger) -> dict[str, Place]:
    """Edges to the universe, collapsed under the conflict rule or as they came; both have the same columns."""
    target, known = Place(out) / "edges", store.read_table(spark, built["documents"])
    received = edges.edges_received(tables["edges"], tables["documents"].where("grant_date is not null").select("doc_id", "grant_date"), known.select("doc_id", "year"), known)
    if cfg["edges.deduplicate"]:
        rows = edges.collapse_edges(received, cfg["edges.conflict_rule"], cfg["edges.examiner"])
        ledger.checkpoint(received, rows, "edges", f"Repeated edges are one edge each; contradicting categories follow the rule {cfg['edges.conflict_rule']}")
    else:
        rows = edges.raw_edges(received, cfg["edges.examiner"])
        ledger.note("edges", "Edges are kept as they came; repeated ones count repeatedly and no conflict of categories is looked for")
    store.write_table(rows, target, cfg, "edges", [built["documents"]])
    return {"edges": target}


def build_links(spark: SparkSession, cfg: Config, tables: Mapping[str, DataFrame], out: str | PathLike, ledger: Ledger) -> dict[str, Place]:
    """Old identities and the contributors they are now, by both routes, with what is known about each link.

    ``identity_documents`` (identity_id, doc_id) names the documents of every old identity, ``release``
    (doc_id, sequence and a column per release) who held each slot, ``names`` (identity_id, name) and
    ``contributor_names`` (contributor_id, name), if there, test the links.
    """
    target = Place(out) / "links"
    listed = tables["listings"].select("doc_id", "sequence", "contributor_id")
    old, now = cfg["link.old_release"], cfg["link.current_release"]
    link.require_release(tables["release"], old, cfg["link.prefix"])
    share = link.require_anchor(tables["release"], listed, now, cfg["link.prefix"], cfg["link.anchor_floor"])
    ledger.note("anchor", f"{now} holds the listed contributor on {share:.2%} of the slots that both tables have")
    identities = tables["identity_documents"].select("identity_id").distinct()
    slots = listed.select(F.col("doc_id").cast("string").alias("doc_key"), F.col("sequence").cast("int").alias("place"), "contributor_id")
    coordinate = link.coordinate_link(identities, slots).withColumnRenamed("contributor_id", "coordinate_contributor")
    release = link.release_link(tables["release"].select(F.col(f"`{old}`").alias("identity_id"), F.col(f"`{now}`").alias("contributor_id")))
    covered = link.require_coverage(identities, release, cfg["link.coverage_floor"], "release link")
    ledger.note("coverage", f"{covered:.2%} of the old identities have a contributor in the release table")
    chosen, agree = link.owner(cfg["link.preferred_route"])
    routes = identities.join(release.withColumnRenamed("contributor_id", "release_contributor"), "identity_id", "left").join(coordinate, "identity_id", "left")
    owners = routes.withColumns({"contributor_id": chosen, "routes_agree": agree}).where("contributor_id is not null")
    verdicts = link.set_agreement(owners, tables["identity_documents"], listed.select("contributor_id", "doc_id"))
    sized = verdicts.select("identity_id", F.col("left_documents").alias("documents"), F.col("right_documents").alias("contributor_documents"))
    kept = link.same_vintage(owners, verdicts, cfg["link.require_identical"]).join(sized, "identity_id", "left")
    if cfg["link.require_identical"]:
        ledger.checkpoint(owners, kept, "links", "Only identities whose documents are the same in both releases are kept")
    else:
        ledger.note("links", "How far the documents of both releases agree is kept in a column and acted on nowhere")
    store.write_table(kept, target, cfg, "links")
    sections = {"Routes": link.method_table(store.read_table(spark, target)), "Agreement of documents": store.read_table(spark, target).groupBy("agreement").agg(F.count("*").alias("identities")).orderBy("agreement")}
    store.write_text(out, "links.md", report.document("Links between old and current identities", {n: report.table(f.toPandas()) for n, f in sections.items()}), cfg)
    if "names" in tables and "contributor_names" in tables:
        shares = link.both_name_agreements(store.read_table(spark, target), tables["names"], tables["contributor_names"], cfg["link.preferred_route"], cfg["link.name_floor"], "names of linked identities")
        ledger.note("names", "Agreeing names: " + ", ".join(f"{k} {v:.2%}" for k, v in shares.items() if v is not None))
    return {"links": target}


def build_events(spark: SparkSession, cfg: Config, tables: Mapping[str, DataFrame], links: Place, out: str | PathLike, ledger: Ledger) -> dict[str, Place]:
    """Birth years and events, one row per person each.

    ``records`` are the candidate records of events (see ``evidence``), ``years`` (identity_id,
    preferred_year, best_score and the source counts) the reconciled birth years.
    """
    folder = Place(out)
    owned = store.read_table(spark, links)
    people = owned.select("identity_id", F.col("contributor_id").alias("person"))
    usable = evidence.usable_records(tables["records"], cfg["events.min_score"])
    ledger.checkpoint(tables["records"], usable, "records", "Records without a year or below the score floor say nothing about when it happened")
    linked = evidence.linkable(usable, people)
    ledger.checkpoint(usable, linked, "linkable records", "Records of identities without a current contributor cannot become events")
    eligible = evidence.eligible(tables["years"], cfg["birth.min_score"], cfg["birth.score_inclusive"])
    ledger.checkpoint(tables["years"], eligible, "eligible years", "Identities without a preferred year or with too low a score have no usable birth year")
    eligible = evidence.linkable(eligible, people)
    events = evidence.consensus(linked, cfg["events.tie_rule"])
    gap = evidence.gaps(linked, eligible)
    table = evidence.year_table(eligible, events, evidence.within_tolerance(linked, eligible, cfg["birth.tolerance"]), gap)
    mine = table.join(owned.select("identity_id", F.col("contributor_id").alias("person"), "documents"), "identity_id")
    paths = {"birth_years": folder / "birth_years", "events": folder / "events"}
    store.write_table(evidence.collapse_identities(mine, "person", evidence.person_order(), "loose_year"), paths["birth_years"], cfg, "events", [links])
    dated = evidence.person_events(events, people, cfg["events.first_year"], cfg["events.last_year"])
    known = store.read_table(spark, paths["birth_years"])
    store.write_table(evidence.event_table(dated, known, cfg["birth.treated_rule"]), paths["events"], cfg, "events", [links, paths["birth_years"]])
    figures = evidence.event_notes(store.read_table(spark, paths["events"]), cfg["birth.tolerance"]).first().asDict()
    ledger.note("events", ", ".join(f"{k} {v}" for k, v in figures.items()))
    histogram = selection.top_coded(gap, "min_gap", cfg["birth.top_code"]).orderBy("value").toPandas()
    store.write_csv(folder, "birth_year_gaps.csv", histogram, cfg)
    store.write_text(folder, "birth_years.md", report.document("Birth years and events", {"Figures": report.table(pd.DataFrame([figures])), "Smallest distance of a record to the preferred year, top-coded": report.table(histogram)}), cfg)
    return paths


def measure(spark: SparkSession, cfg: Config, built: Mapping[str, Place], out: str | PathLike, width: str) -> tuple[dict[str, Place], list[checks.Check]]:
    """Panel and field-years of a width; the checks run on what was written and stop the run after it."""
    folder = Place(out)
    refusals.before_measuring(cfg)
    store.require_same_config([built["documents"], built[f"spine_{width}"]], cfg)
    first, last, span = cfg["measure.first_year"], cfg["measure.last_year"], cfg["windows.span"]
    rows, known = store.read_table(spark, built[f"spine_{width}"]), store.read_table(spark, built["documents"])
    active = panel.activity(rows)
    guard.check_years_by_row(panel.expand(active, span, first, last).select("year", "window_year"), "year", "window_year", f"windows at {width}")
    cap = float(cfg["measure.margin_cap"]) if cfg["measure.no_runner_up"] == "cap" else None
    paths = {"panel": folder / f"panel_{width}", "field_years": folder / f"field_years_{width}"}
    store.write_table(panel.panel(panel.windows(active, span, first, last), cfg["measure.rank_ties"], cap), paths["panel"], cfg, "measure", [built[f"spine_{width}"]])
    written = store.read_table(spark, paths["panel"])
    dated = store.read_table(spark, built[f"fields_{width}"]).join(known.select("doc_id", "year"), "doc_id")
    heads = panel.head_counts(dated, span, first, last)
    years = panel.field_years(written, heads)
    value = cfg["floor.documents"] if cfg["floor.mode"] == "absolute" else cfg["floor.percentile"]
    floor = panel.floors(years, cfg["floor.mode"], value, cfg["events.first_year"], cfg["events.last_year"])
    store.write_table(panel.with_floor(years, floor, cfg["floor.inclusive"]), paths["field_years"], cfg, "measure", [paths["panel"]])
    stored = store.read_table(spark, paths["field_years"])
    found = checks.check_panel(written, stored, active, rows, heads, margins_capped=cap is not None, inclusive=cfg["floor.inclusive"])
    again = panel.floors(stored, cfg["floor.mode"], value, cfg["events.first_year"], cfg["events.last_year"])
    return paths, [*found, checks.check_floor(stored, again)]


def select(spark: SparkSession, cfg: Config, built: Mapping[str, Place], measured: Mapping[str, Place], out: str | PathLike, width: str, force: bool = False) -> tuple[dict[str, DataFrame], list[checks.Check]]:
    """Candidate pool (reused while fresh, unless ``force``) and the tables of all rules."""
    refusals.before_selecting(cfg)
    store.require_same_config(list(measured.values()), cfg)
    first, last, span = cfg["events.first_year"], cfg["events.last_year"], cfg["windows.span"]
    rules = selection.rule_list(cfg["select.cutoffs"], cfg["select.max_rank"], cfg["select.min_margin"], cfg["select.min_share"])
    working = next(r.name for r in rules if r.max_rank is None and r.min_share == cfg["select.working_cutoff"])
    rows, years = store.read_table(spark, measured["panel"]), store.read_table(spark, measured["field_years"])
    target = Place(out) / f"candidates_{width}"
    if force or not store.is_fresh(target, cfg, list(measured.values())):
        pool = selection.pool(rows, years, rules, max(first - span + 1, cfg["measure.first_year"]), last)
        faults = selection.pool_faults(pool).first().asDict()
        if any(faults.values()):
            raise ValueError(f"candidates do not match their field-years: {faults}")
        store.write_table(pool, target, cfg, "select", list(measured.values()))
    pool = store.read_table(spark, target)
    hits = selection.qualifying(pool.where(F.col("year").between(first, last)), rules)
    career = selection.careers(rows, hits)
    results = {
        "cells": selection.cells(hits, career, rules, first, last),
        "loose_exposure": selection.loose_exposure(hits, span, first, last),
        "decomposition": selection.floor_decomposition(hits, selection.field_ever_clears(years, first, last)),
        "field_size": selection.size_summary(years, first, last, span, cfg["select.working_cutoff"]),
        "summary": panel.summary(years),
        "exclusions": selection.exclusions(pool.where(F.col("year").between(first, last)), next(r for r in rules if r.max_rank is not None)),
        "curve": report.persistence_steps(selection.at_least_curve(selection.pair_spells(hits), last - first + 1)),
        "fields_per_contributor": selection.fields_per_contributor(hits.where(F.col("rule") == working)),
        "fields_with_several": selection.fields_with_several(hits.where(F.col("rule") == working)),
        "pairs": selection.pair_spells(hits.where(F.col("rule") == working)).where("with_floor").join(career, selection.PAIR, "left"),
    }
    small = {k: [r.asDict() for r in results[k].collect()] for k in ("cells", "loose_exposure", "decomposition")}
    selectable = selection.outside_pool(rows, rules, first, last).first()["selectable"]
    if selectable:
        raise ValueError(f"{selectable:,} panel rows satisfy a rule and are not in the pool; its lowest share binds")
    names = [r.name for r in rules if r.max_rank is None]
    return results, checks.check_cells(small["cells"], small["loose_exposure"], small["decomposition"], names, span)


def run(spark: SparkSession, cfg: Config, tables: Mapping[str, DataFrame], out: str | PathLike, force: bool = False) -> Place:
    """All stages at all widths, with reports; failed checks stop the run after the files are written.

    ``tables`` has documents, listings and codes; with ``edges`` the edges are built too, with
    ``identity_documents`` and ``release`` the links, and with ``records`` and ``years`` besides, the events.
    """
    refusals.before_measuring(cfg)
    refusals.before_selecting(cfg)
    folder, ledger = Place(out), Ledger(log=Place(out) / "session.log")
    built = build(spark, cfg, tables, folder, ledger)
    if "edges" in tables:
        built |= build_edges(spark, cfg, tables, built, folder, ledger)
    if {"identity_documents", "release"} <= tables.keys():
        built |= build_links(spark, cfg, tables, folder, ledger)
        if {"records", "years"} <= tables.keys():
            built |= build_events(spark, cfg, tables, built["links"], folder, ledger)
    written, failed, chosen, contributors = list(built.values()), [], [], {}
    floors, sentence = refusals.floors_to_report(cfg)
    decimals = cfg["report.share_decimals"]
    for width in cfg["fields.widths"]:
        measured, panel_checks = measure(spark, cfg, built, folder, width)
        results, cell_checks = select(spark, cfg, built, measured, folder, width, force)
        written += measured.values()
        sections = {"Panel checks": report.checks(panel_checks), "Selection checks": report.checks(cell_checks), "Floors": sentence}
        frames = {}
        for name in ("summary", "cells", "loose_exposure", "decomposition", "field_size", "exclusions", "curve", "fields_per_contributor", "fields_with_several"):
            frame = results[name].toPandas()
            store.write_csv(folder, f"{name}_{width}.csv", frame.round(decimals), cfg)
            if "with_floor" in frame:
                frame = frame[frame["with_floor"].isin(floors)].sort_values([c for c in ("rule", "with_floor", "k") if c in frame])
            sections[name] = report.table(frame, decimals)
            frames[name] = frame
        pairs = folder / f"pairs_{width}"
        store.write_table(results["pairs"], pairs, cfg, "select", [folder / f"candidates_{width}", measured["panel"]])
        written.append(pairs)
        chosen.append(store.read_table(spark, pairs).select(F.lit(width).alias("width"), "contributor_id"))
        try:
            refusals.filing_years_need_primary_codes(cfg)
        except refusals.Refused as why:
            sections["filing_years"], filing = str(why), None
        else:
            hits = store.read_table(spark, pairs).select(*selection.PAIR, F.explode("qualifying").alias("year"))
            behind = selection.filing_years_behind(hits, panel.activity(store.read_table(spark, built[f"spine_{width}"])), cfg["windows.span"])
            filing = selection.filing_year_summary(behind, cfg["windows.span"]).toPandas()
            sections["filing_years"] = report.table(filing, decimals)
        plain = [r.name for r in selection.rule_list(cfg["select.cutoffs"], cfg["select.max_rank"], cfg["select.min_margin"], cfg["select.min_share"]) if r.max_rank is None]
        working = f"cutoff_{round(cfg['select.working_cutoff'] * 10_000):04d}"
        cell = next(c for c in frames["cells"].to_dict("records") if c["rule"] == working and c["with_floor"] == floors[0])
        sections["Persistence in words"] = report.describe_persistence(cell, None if filing is None else filing.to_dict("records")[0], cfg["windows.span"])
        sections["The floor in words"] = report.describe_floor(frames["decomposition"].to_dict("records"))
        for floor in floors:
            name = f"persistence_{width}_{'with' if floor else 'without'}_floor.svg"
            store.write_text(folder, name, report.persistence_figure(frames["curve"], plain, refusals.LINE_COLOURS, cfg["windows.span"], floor), cfg)
        contributors[width] = int(cell["contributors"])
        store.write_text(folder, f"report_{width}.md", report.document(f"Dominance at width {width}", sections), cfg)
        failed += [c for c in (*panel_checks, *cell_checks) if not c.passed]
    if len(chosen) > 1:
        shared = selection.overlap(functools.reduce(DataFrame.unionByName, chosen)).toPandas()
        store.write_text(folder, "report_widths.md", report.document("Contributors that widths share", {"Overlap": report.table(shared), "In words": report.describe_widths(shared.to_dict("records"), contributors)}), cfg)
    ledger.finish(folder)
    index = store.write_index(folder, written, cfg)
    if failed:
        raise checks.ChecksFailed(failed)
    return index
