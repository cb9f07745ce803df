"""Strict configuration: a schema, every error at once, a content hash."""

from __future__ import annotations

import difflib
import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any

#: Keys that say where or how to run, not what to compute; they don't enter the hash.
UNHASHED = ("name", "paths", "runtime")


@dataclass(frozen=True)
class Key:
    """Type, default and permitted values of a key. ``choices`` lists them, ``low`` and ``high`` bound numbers."""

    kind: type | tuple[type, ...]
    default: Any
    choices: tuple = ()
    low: float | None = None
    high: float | None = None

    def fault(self, value: Any) -> str | None:
        kinds = self.kind if isinstance(self.kind, tuple) else (self.kind,)
        if isinstance(value, bool) and bool not in kinds or not isinstance(value, kinds):
            return f"must be {' or '.join(k.__name__ for k in kinds)}, is {value!r}"
        if self.choices and value not in self.choices:
            return f"must be one of {', '.join(map(str, self.choices))}, is {value!r}"
        if (self.low is not None and value < self.low) or (self.high is not None and value > self.high):
            return f"must lie between {self.low} and {self.high}, is {value!r}"
        return None


_NUMBER = (int, float)
_NONE = type(None)
SCHEMA: dict[str, Key] = {
    "name": Key(str, "default"),
    "paths.data": Key(str, "data"),
    "paths.output": Key(str, "output"),
    "runtime.shuffle_partitions": Key(int, 200, low=1),
    "sample.enabled": Key(bool, False),
    "sample.section": Key(str, "A"),
    "universe.date_by": Key(str, "filing", ("filing", "grant")),
    "universe.types": Key(list, ["utility"]),
    "universe.first_year": Key(int, 1976, low=1900, high=2100),
    "universe.complete_through": Key(int, 2022, low=1900, high=2100),
    "universe.drop_withdrawn": Key(bool, True),
    "edges.deduplicate": Key(bool, True),
    "edges.conflict_rule": Key(str, "drop_conflicts", ("any_examiner", "all_examiner", "drop_conflicts")),
    "edges.examiner": Key(str, "cited by examiner"),  # a fixed value of the source data
    "counting.method": Key(str, "fractional", ("fractional", "full")),
    "counting.field_size": Key(str, "full", ("fractional", "full")),
    "codes.assignment": Key(str, "primary", ("primary", "all")),
    "codes.primary_sequence": Key(int, 0, low=0),
    "codes.multi_code_weighting": Key(str, "duplicate", ("duplicate", "fractional")),
    "fields.widths": Key(list, ["class", "subclass", "main_group"]),
    "windows.span": Key(int, 5, low=1, high=100),
    "measure.first_year": Key(int, 1980, low=1900, high=2100),
    "measure.last_year": Key(int, 2022, low=1900, high=2100),
    "measure.rank_ties": Key(str, "competition", ("competition", "dense", "unique_by_id")),
    "measure.no_runner_up": Key(str, "missing", ("missing", "cap")),
    "measure.margin_cap": Key(_NUMBER, 10, low=1),
    "floor.mode": Key(str, "absolute", ("absolute", "pooled", "per_year")),
    "floor.documents": Key(_NUMBER, 100, low=0),
    "floor.percentile": Key((*_NUMBER, _NONE), None),
    "floor.inclusive": Key(bool, True),
    "link.preferred_route": Key(str, "release", ("release", "coordinate")),
    "link.old_release": Key(str, "release_old"),
    "link.current_release": Key(str, "release_current"),
    "link.prefix": Key(str, "release_"),
    "link.anchor_floor": Key(_NUMBER, 0.99, low=0, high=1),
    "link.coverage_floor": Key(_NUMBER, 0.99, low=0, high=1),
    "link.name_floor": Key(_NUMBER, 0.99, low=0, high=1),
    "link.require_identical": Key(bool, False),
    "events.first_year": Key(int, 1986, low=1900, high=2100),
    "events.last_year": Key(int, 2016, low=1900, high=2100),
    "events.min_score": Key(_NUMBER, 0),
    "events.tie_rule": Key(str, "modal_then_earliest", ("modal_then_earliest", "earliest", "latest", "drop")),
    "birth.tolerance": Key(int, 2, low=0),
    "birth.top_code": Key(int, 6, low=1),
    "birth.min_score": Key(_NUMBER, 0),
    "birth.score_inclusive": Key(bool, False),
    "birth.treated_rule": Key(str, "loose", ("loose", "strict")),
    "select.metric": Key(str, "document_share", ("document_share", "citation_share")),
    "select.max_rank": Key(int, 1, low=1),
    "select.cutoffs": Key(list, [0.01, 0.025, 0.05, 0.1]),
    "select.working_cutoff": Key(_NUMBER, 0.05, low=0, high=1),
    "select.min_margin": Key(_NUMBER, 2.0, low=1),
    "select.min_share": Key(_NUMBER, 0.02, low=0, high=1),
    "report.share_decimals": Key(int, 6, low=0, high=12),
    "report.both_floors": Key(bool, True),
    "report.with_floor": Key(bool, True),
}


class ConfigError(ValueError):
    """All faults of a configuration, one a line."""

    def __init__(self, faults: list[str]):
        self.faults = faults
        super().__init__("\n".join(faults))


def _cross_rules(v: Mapping[str, Any]) -> list[str]:
    rules: list[tuple[bool, str]] = [
        (v["universe.first_year"] <= v["universe.complete_through"], "universe.first_year must not be after universe.complete_through"),
        (v["measure.first_year"] <= v["measure.last_year"], "measure.first_year must not be after measure.last_year"),
        (v["measure.first_year"] >= v["universe.first_year"] + v["windows.span"] - 1, "measure.first_year comes before the first full window"),
        (v["measure.last_year"] <= v["universe.complete_through"], "measure.last_year is after universe.complete_through"),
        (v["events.first_year"] <= v["events.last_year"], "events.first_year must not be after events.last_year"),
        (v["events.first_year"] >= v["universe.first_year"] + 2 * v["windows.span"], "events.first_year leaves no full window before it"),
        (v["events.last_year"] <= v["universe.complete_through"] - v["windows.span"], "events.last_year leaves no full window after it"),
        (v["birth.top_code"] > v["birth.tolerance"], "birth.top_code must be above birth.tolerance"),
        (v["select.working_cutoff"] in v["select.cutoffs"], "select.working_cutoff must be one of select.cutoffs"),
        (bool(v["fields.widths"]), "fields.widths must name a width"),
        (len(set(v["fields.widths"])) == len(v["fields.widths"]), "fields.widths names a width twice"),
        (bool(v["universe.types"]) and all(isinstance(x, str) for x in v["universe.types"]), "universe.types must name document types"),
        (v["measure.last_year"] - v["measure.first_year"] >= 0 and v["events.first_year"] >= v["measure.first_year"], "events.first_year comes before the measured years"),
        (v["events.last_year"] <= v["measure.last_year"], "events.last_year is after the measured years"),
        (bool(v["select.cutoffs"]) and all(isinstance(c, _NUMBER) and not isinstance(c, bool) and 0 < c <= 1 for c in v["select.cutoffs"]), "select.cutoffs must be shares above 0 and at most 1"),
        (len(set(v["select.cutoffs"])) == len(v["select.cutoffs"]), "select.cutoffs names a cutoff twice"),
        (v["link.old_release"] != v["link.current_release"], "link.old_release and link.current_release must differ"),
        (v["link.old_release"].startswith(v["link.prefix"]) and v["link.current_release"].startswith(v["link.prefix"]), "link.prefix must start the names of both releases"),
        (v["measure.no_runner_up"] != "cap" or v["measure.margin_cap"] > v["select.min_margin"], "measure.margin_cap must be above select.min_margin, else no lone leader can pass"),
        (not v["sample.enabled"] or bool(v["sample.section"]), "sample.section must name a section while sampling"),
        (v["report.both_floors"] or v["floor.mode"] != "absolute" or v["floor.documents"] > 0 or not v["report.with_floor"], "report.with_floor asks for a floor, and floor.documents is 0"),
    ]
    percentile = v["floor.percentile"]
    if v["floor.mode"] == "absolute":
        rules.append((percentile is None, "floor.percentile must be null under an absolute floor"))
    else:
        rules.append((percentile is not None and 0 < percentile < 100, "floor.percentile must lie between 0 and 100, both excluded, under a percentile floor"))
    return [text for good, text in rules if not good]


@dataclass(frozen=True)
class Config:
    """Validated values by dotted key; ``cfg["windows.span"]``."""

    values: Mapping[str, Any]

    def __getitem__(self, key: str) -> Any:
        return self.values[key]

    @property
    def hash(self) -> str:
        """Eight hex digits of what is computed; renaming, moving or resizing a run doesn't change it."""
        kept = {k: v for k, v in sorted(self.values.items()) if k.split(".")[0] not in UNHASHED}
        return hashlib.sha256(json.dumps(kept, sort_keys=True).encode()).hexdigest()[:8]


def flatten(tree: Mapping[str, Any], prefix: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in tree.items():
        if isinstance(v, Mapping):
            out |= flatten(v, f"{prefix}{k}.")
        else:
            out[f"{prefix}{k}"] = v
    return out


def build(tree: Mapping[str, Any] | None = None, known_widths: Callable[[], set[str]] | None = None) -> Config:
    """Defaults overlaid with ``tree``; unknown keys, bad values and broken cross rules are reported together."""
    given = flatten(tree or {})
    faults = []
    for key in given.keys() - SCHEMA.keys():
        near = difflib.get_close_matches(key, SCHEMA, n=1)
        faults.append(f"{key}: unknown key" + (f"; did you mean {near[0]}?" if near else ""))
    values = {k: given.get(k, spec.default) for k, spec in SCHEMA.items()}
    faults += [f"{k}: {text}" for k, spec in SCHEMA.items() if (text := spec.fault(values[k]))]
    if not faults:
        faults += _cross_rules(values)
        if known_widths is not None:
            faults += [f"fields.widths: unknown width {w!r}" for w in values["fields.widths"] if w not in known_widths()]
    if faults:
        raise ConfigError(sorted(faults))
    return Config(values)


def load(path: str | Path) -> Config:
    """A configuration from JSON, or from YAML where a parser is installed."""
    text = Path(path).read_text()
    if str(path).endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as missing:
            raise ConfigError([f"{path}: no YAML parser is installed; use JSON"]) from missing
        return build(yaml.safe_load(text))
    return build(json.loads(text))
