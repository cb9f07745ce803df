"""Markdown reports from small results."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldlead.checks import Check


def table(rows: pd.DataFrame, decimals: int = 6) -> str:
    """A frame as a markdown table; missing values are shown as a dash."""

    def cell(v: Any) -> str:
        if v is None or (isinstance(v, float) and pd.isna(v)) or v is pd.NaT:
            return "-"
        return f"{v:.{decimals}f}".rstrip("0").rstrip(".") if isinstance(v, float) else f"{v}"

    head = "| " + " | ".join(map(str, rows.columns)) + " |"
    return "\n".join([head, "|" + "---|" * len(rows.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows.itertuples(index=False))])


def checks(results: Sequence[Check]) -> str:
    return table(pd.DataFrame([{"check": c.name, "": "passed" if c.passed else "FAILED", "detail": c.detail} for c in results]))


def document(title: str, sections: Mapping[str, str]) -> str:
    return f"# {title}\n\n" + "\n\n".join(f"## {name}\n\n{text}" for name, text in sections.items()) + "\n"


def sections_frame(spark: SparkSession, text: str) -> DataFrame:
    """(section, lines) of a markdown document."""
    found: list[list] = []
    for line in text.splitlines():
        if line.startswith("## "):
            found.append([line[3:], 0])
        elif found and line.strip():
            found[-1][1] += 1
    return spark.createDataFrame(found, "section string, lines int")


def persistence_steps(curve: DataFrame) -> DataFrame:
    """Points of the step lines of the persistence figure: (rule, with_floor, k, share)."""
    return curve.orderBy("rule", "with_floor", "k").withColumn("share", F.round("share", 6))


def persistence_figure(points: pd.DataFrame, rules: Sequence[str], colours: Sequence[str], span: int, with_floor: bool) -> str:
    """The persistence figure as SVG: one step line per rule over the logarithm of k, with marks at one window and at the longest run of one filing year.

    ``points`` as ``persistence_steps`` gives them. Plain text, so equal results give equal files.
    """
    own = points[points["with_floor"] == with_floor]
    most = max([2, 2 * span, *own["k"].tolist()])
    left, top, width, height = 60, 20, 560, 320

    def at(k: float, share: float) -> str:
        return f"{left + width * math.log(k) / math.log(most):.1f},{top + height * (1 - share):.1f}"

    out = ['<svg xmlns="http://www.w3.org/2000/svg" width="760" height="400" font-family="sans-serif" font-size="12">', f'<path d="M{at(1, 1)} L{at(1, 0)} L{at(most, 0)}" fill="none" stroke="gray"/>']
    for k in (span, 2 * span - 1):
        x = at(k, 0).split(",")[0]
        out.append(f'<path d="M{at(k, 1)} L{at(k, 0)}" stroke="silver" stroke-dasharray="4"/><text x="{x}" y="{top + height + 16}" text-anchor="middle">{k}</text>')
    for i, (rule, colour) in enumerate(zip(rules, colours)):
        line = own[own["rule"] == rule].sort_values("k")
        steps, before = [], None
        for k, share in zip(line["k"], line["share"]):
            steps += [at(k, before), at(k, share)] if before is not None else [at(k, share)]
            before = share
        if steps:
            out.append(f'<polyline points="{" ".join(steps)}" fill="none" stroke="{colour}"/>')
        out.append(f'<text x="{left + width + 12}" y="{top + 16 * (i + 1)}" fill="{colour}">{rule}</text>')
    return "\n".join([*out, f'<text x="{left + width / 2}" y="{top + height + 40}" text-anchor="middle">at least k qualifying years</text>', "</svg>", ""])


def _share(part: float, whole: float) -> str:
    return f"{part:,.0f} of {whole:,.0f} ({part / whole:.1%})" if whole else "none of 0"


def describe_persistence(cell: Mapping[str, Any], filing: Mapping[str, Any] | None, span: int) -> str:
    """What the working cell says about runs of qualifying years."""
    if not cell["pairs"]:
        return "No pair qualifies, so there is nothing to say about persistence."
    out = [f"The median pair qualifies in {cell['median_years']:g} window-years; {_share(cell['contiguous'], cell['pairs'])} qualify without a gap."]
    if cell["edge_touching"]:
        out.append(f"{_share(cell['edge_touching'], cell['pairs'])} touch the first or last year, where a run may be cut off" + (f"; the others have a median of {cell['median_years_interior']:g}." if cell["median_years_interior"] is not None and cell["median_years_interior"] == cell["median_years_interior"] else "."))
    out.append(f"One filing year can carry a run of up to {span} window-years" + ("" if cell["median_years"] > span else ", and the median run is no longer than that") + ".")
    if filing and filing["pairs"]:
        out.append(f"Behind the runs, {_share(filing['one_filing_year'], filing['pairs'])} have a single filing year and {_share(filing['span_or_more'], filing['pairs'])} have {span} or more.")
    return " ".join(out)


def describe_floor(decomposition: Sequence[Mapping[str, Any]]) -> str:
    """What the floor of field size takes away, and why."""
    lines = []
    for d in decomposition:
        lost = d["lost_field_never"] + d["lost_other_year"]
        if not lost:
            lines.append(f"- {d['rule']}: the floor takes nothing from {d['pairs']:,} pairs.")
            continue
        cause = "fields that never reach it" if d["lost_field_never"] >= d["lost_other_year"] else "years in which the field was too small, in fields that reach it in others"
        lines.append(f"- {d['rule']}: the floor takes {_share(lost, d['pairs'])} pairs, most of them for {cause} ({d['lost_field_never']:,} and {d['lost_other_year']:,}).")
    return "\n".join(lines)


def describe_widths(overlap: Sequence[Mapping[str, Any]], contributors: Mapping[str, int]) -> str:
    """How far the widths choose the same contributors."""
    if not overlap:
        return "No two widths share a contributor."
    return " ".join(f"{_share(o['shared'], min(contributors.get(o['left'], 0), contributors.get(o['right'], 0)))} contributors of the smaller set are in both {o['left']} and {o['right']}." for o in overlap)
