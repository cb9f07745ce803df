"""Durable tables and reports: atomic Parquet with a provenance note, versioned text and CSV."""

from __future__ import annotations

import io
import json
import os
import re
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from os import PathLike
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from fieldlead.config import Config
from fieldlead.files import Place

NOTE = ".meta.json"


class StaleInput(ValueError):
    """A table was built under another configuration or has no note."""


def _note_path(path: str | PathLike) -> Place:
    place = Place(path)
    return place.sibling(place.name + NOTE)


def read_note(path: str | PathLike) -> dict[str, Any] | None:
    note = _note_path(path)
    return json.loads(note.read_text()) if note.exists() else None


def write_table(df: DataFrame, path: str | PathLike, cfg: Config, step: str, inputs: Sequence[str | PathLike] = (), partition_by: Sequence[str] = ()) -> int:
    """Write a table and its note; returns the rows.

    The table goes to ``unfinished_<name>`` first and is counted there; then the old note goes, the
    folders are exchanged, and the new note comes last. A crash leaves a table without a note, which
    nothing reads, never a new table under an old note. Works on any file system that Spark writes to.
    """
    target = Place(path)
    scratch = target.sibling(f"unfinished_{target.name}")
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(scratch)
    rows = df.sparkSession.read.parquet(scratch).count()
    _note_path(target).delete()
    target.delete()
    scratch.rename(target)
    note = {"created": datetime.now(timezone.utc).isoformat(timespec="seconds"), "step": step, "config_name": cfg["name"], "config_hash": cfg.hash, "rows": rows, "inputs": [str(p) for p in inputs]}
    _note_path(target).write_text(json.dumps(note, indent=2) + "\n")
    return rows


def read_table(spark: SparkSession, path: str | PathLike, hint: str = "") -> DataFrame:
    """A written table; a missing one is reported before anything is planned."""
    if not Place(path).exists():
        raise FileNotFoundError(f"{path} does not exist." + (f" {hint}" if hint else ""))
    return spark.read.parquet(str(path))


def require_same_config(paths: Sequence[str | PathLike], cfg: Config) -> None:
    """Stop unless every table was built under this configuration."""
    faults = []
    for p in paths:
        note = read_note(p)
        if note is None:
            faults.append(f"{p}: no note; the table is missing or unfinished")
        elif note["config_hash"] != cfg.hash:
            faults.append(f"{p}: built under {note['config_hash']} ({note['config_name']}), this is {cfg.hash} ({cfg['name']})")
    if faults:
        raise StaleInput("\n".join(faults))


def is_fresh(path: str | PathLike, cfg: Config, inputs: Sequence[str | PathLike] = ()) -> bool:
    """Whether a table can be used again: it exists, has this configuration, and no input is newer."""
    note = read_note(path)
    if note is None or note["config_hash"] != cfg.hash or not Place(path).exists():
        return False
    made = _note_path(path).modified()
    return all(Place(p).exists() and Place(p).modified() <= made for p in inputs)


def _comparable(text: str) -> str:
    return "\n".join(x for x in text.splitlines() if not x.startswith("# generated:"))


def write_text(folder: str | PathLike, name: str, text: str, cfg: Config) -> Place:
    """Write ``name`` plainly and as a copy stamped with the configuration's hash.

    A stamped copy is never overwritten with another content: the next one is ``_v2``, ``_v3`` and so
    on. Equal content (the line ``# generated:`` aside) makes no new version.
    """
    out = Place(folder).make()
    stem, suffix = os.path.splitext(name)
    version = 1
    while True:
        stamped = out / f"{stem}_{cfg.hash}{'' if version == 1 else f'_v{version}'}{suffix}"
        if not stamped.exists():
            stamped.write_text(text)
            break
        if _comparable(stamped.read_text()) == _comparable(text):
            break
        version += 1
    (out / name).write_text(text)
    return stamped


def write_csv(folder: str | PathLike, name: str, rows: DataFrame | pd.DataFrame, cfg: Config, header: Mapping[str, Any] | None = None) -> Place:
    """A small result as CSV with ``# key: value`` lines above it."""
    table = rows if isinstance(rows, pd.DataFrame) else rows.toPandas()
    head = {"config": f"{cfg['name']} {cfg.hash}", "generated": datetime.now(timezone.utc).isoformat(timespec="seconds"), **(header or {})}
    return write_text(folder, name, "".join(f"# {k}: {v}\n" for k, v in head.items()) + table.to_csv(index=False), cfg)


def read_csv(path: str | PathLike) -> pd.DataFrame:
    return pd.read_csv(io.StringIO(Place(path).read_text()), comment="#")


def _versions(folder: Place, name: str) -> list[Place]:
    """Stamped copies in the order of their versions, the newest last."""
    stem, suffix = os.path.splitext(name)
    found = []
    for p in folder.inside():
        m = re.fullmatch(rf"{re.escape(stem)}_[0-9a-f]{{8}}(?:_v([0-9]+))?{re.escape(suffix)}", p.name)
        if m:
            found.append((p.modified(), int(m.group(1) or 1), p))
    return [p for *_, p in sorted(found)]


def edited_by_hand(folder: str | PathLike, names: Sequence[str]) -> list[str]:
    """Plain reports that differ from their newest stamped copy."""
    out = Place(folder)
    found = []
    for name in names:
        plain, copies = out / name, _versions(out, name)
        if plain.exists() and copies and _comparable(plain.read_text()) != _comparable(copies[-1].read_text()):
            found.append(name)
    return found


def write_index(folder: str | PathLike, tables: Sequence[str | PathLike], cfg: Config) -> Place:
    """``LATEST.md``: every table with its step, rows and hash, stale ones marked, and what changed in the configuration since the last index."""
    out = Place(folder).make()
    last = out / "last_config.json"
    before = json.loads(last.read_text()) if last.exists() else {}
    lines = [f"# Latest run: {cfg['name']} {cfg.hash}", "", "| table | step | rows | config | |", "|---|---|---|---|---|"]
    for p in tables:
        note = read_note(p)
        if note is None:
            lines.append(f"| {Place(p).name} | - | - | - | MISSING |")
        else:
            lines.append(f"| {Place(p).name} | {note['step']} | {note['rows']} | {note['config_hash']} | {'' if note['config_hash'] == cfg.hash else 'STALE'} |")
    changed = [f"- {k}: {before[k]!r} -> {v!r}" for k, v in cfg.values.items() if k in before and before[k] != v]
    lines += ["", "## Changed since the last index", "", *(changed or ["nothing"])]
    last.write_text(json.dumps(dict(cfg.values)))
    path = out / "LATEST.md"
    path.write_text("\n".join(lines) + "\n")
    return path
