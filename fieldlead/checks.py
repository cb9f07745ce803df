"""Structural checks of a panel and of a selection, as data: (name, passed, detail)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Check:
    name: str
    passed: bool
    detail: str


class ChecksFailed(RuntimeError):
    def __init__(self, failed: Sequence[Check]):
        self.failed = list(failed)
        super().__init__("\n".join(f"{c.name}: {c.detail}" for c in failed))


def require(checks: Sequence[Check]) -> Sequence[Check]:
    """Stop if any check failed."""
    failed = [c for c in checks if not c.passed]
    if failed:
        raise ChecksFailed(failed)
    return checks


def check_panel(panel: DataFrame, fields: DataFrame, active: DataFrame, spine: DataFrame, heads: DataFrame, tolerance: float = 1e-9, margins_capped: bool = False, inclusive: bool = True) -> list[Check]:
    """The panel's invariants; five aggregations, whatever its size."""
    per = panel.groupBy("field_id", "year").agg(
        F.sum("share").alias("s"), F.count_if("is_top").alias("tops"), F.count_if((F.col("rank") == 1) & (F.col("n_tied_at_rank") > 1)).alias("tied"),
        F.min("share").alias("lo"), F.max("share").alias("hi"),
    )
    a = per.agg(
        F.count("*").alias("n"), F.max(F.abs(F.col("s") - 1)).alias("off"), F.count_if(F.col("tops") == 0).alias("headless"), F.count_if(F.col("tied") > 0).alias("tied"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    ).first()
    top = F.col("is_top")
    low, dense = F.col("margin"), F.col("margin_dense")
    b = panel.agg(
        F.count("*").alias("rows"),
        F.count_if((low < 1) | (dense < 1)).alias("below_one"),
        F.count_if(top & (dense < low - 1e-12)).alias("dense_below"),
        F.count_if(top & (F.col("n_tied_at_rank") == 1) & (F.abs(dense - low) > 1e-12)).alias("unequal_untied"),
        F.count_if(top & F.col("has_dense_runner_up") & (dense <= 1)).alias("dense_not_above"),
        F.count_if(F.col("year") - F.col("window_first_year") < 0).alias("windows"),
    ).first()
    doubled = panel.groupBy("contributor_id", "field_id", "year").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*")).first()[0]
    weights = [x.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0] for x in (active, spine)]
    size = F.col("field_documents")
    clears = size >= F.col("floor") if inclusive else size > F.col("floor")
    f = fields.agg(
        F.count("*").alias("n"), F.count_if(F.col("field_documents").isNull()).alias("no_size"), F.count_if(F.col("clears_floor").isNull() | (F.col("clears_floor") != clears)).alias("flag")
    ).first()
    key = ["field_id", "year"]
    lost = panel.select(*key).distinct().join(fields.select(*key), key, "left_anti").count()
    idle = heads.select(*key).join(fields.select(*key), key, "left_anti").count()
    return [
        Check("shares sum to one", bool(a["n"]) and a["off"] < tolerance, f"{a['n']} field-years, worst deviation {a['off']}" if a["n"] else "NO field-years"),
        Check("shares lie in [0, 1]", bool(a["n"]) and a["lo"] >= 0 and a["hi"] <= 1 + tolerance, f"from {a['lo']} to {a['hi']}"),
        Check("every field-year has a first", a["headless"] == 0, f"{a['headless']} without, {a['tied']} tied"),
        Check("margins are at least one", b["below_one"] == 0, f"{b['below_one']} below"),
        Check("dense margin is not below the row margin", b["dense_below"] == 0, f"{b['dense_below']} below"),
        Check("margins agree where the first is alone", b["unequal_untied"] == 0, f"{b['unequal_untied']} differ"),
        Check("dense margin exceeds one with a runner-up", margins_capped or b["dense_not_above"] == 0, f"{b['dense_not_above']} don't"),
        Check("windows end in their year", b["windows"] == 0, f"{b['windows']} don't"),
        Check("keys are unique", doubled == 0, f"{doubled} keys repeated"),
        Check("activity keeps the spine's weight", abs(weights[0] - weights[1]) < 1e-3, f"{weights[0]} against {weights[1]}"),
        Check("floor flags follow the sizes", f["flag"] == 0 and f["no_size"] == 0, f"{f['flag']} flags, {f['no_size']} sizes missing"),
        Check("the panel's field-years have sizes", lost == 0, f"{lost} are missing; {idle} field-years have documents and no contributor"),
    ]


def check_floor(fields: DataFrame, recomputed: DataFrame) -> Check:
    """The stored floor of every year against one computed anew from the stored sizes."""
    again = recomputed.withColumnRenamed("floor", "_again")
    off = fields.join(F.broadcast(again), "year", "left").where(~F.col("floor").cast("double").eqNullSafe(F.col("_again").cast("double"))).count()  # one row a year
    return Check("floors follow from the sizes", off == 0, f"{off} field-years carry another floor")


def check_cells(cells: Sequence[dict], loose: Sequence[dict], decomposition: Sequence[dict], cutoffs: Sequence[str], span: int) -> list[Check]:
    """Arithmetic of the selection: nesting, monotonicity, bounds. ``cutoffs`` are rule names in ascending order."""
    cell = {(c["rule"], c["with_floor"]): c for c in cells}
    reach = {(c["rule"], c["with_floor"]): c["loose_exposure"] for c in loose}
    nested = [r for r, w in cell if w and (cell[r, True]["pairs"] > cell[r, False]["pairs"] or cell[r, True]["exposure"] > cell[r, False]["exposure"])]
    steps = [(a, b, w) for a, b in zip(cutoffs, cutoffs[1:]) for w in (False, True) if cell[b, w]["pairs"] > cell[a, w]["pairs"] or cell[b, w]["exposure"] > cell[a, w]["exposure"]]
    bounds = [k for k, n in reach.items() if not cell[k]["exposure"] <= n <= span * cell[k]["exposure"]]
    counts = [k for k, c in cell.items() if c["year_counts"] and sum(int(y) * int(n) for y, n in (x.split(":") for x in c["year_counts"].split(","))) != c["exposure"]]
    order = [d["rule"] for d in decomposition if not d["clears_same_year"] <= d["field_ever_clears"] <= d["pairs"]]
    same = [d["rule"] for d in decomposition if (d["pairs"], d["clears_same_year"]) != (cell[d["rule"], False]["pairs"], cell[d["rule"], True]["pairs"])]
    people = [k for k, c in cell.items() if c["contributors"] > c["pairs"]]
    runs = [k for k, c in cell.items() if c["contiguous"] > c["pairs"] or c["edge_touching"] > c["pairs"]]
    return [
        Check("the floor only removes", not nested, str(nested)),
        Check("a higher cutoff never adds", not steps, str(steps)),
        Check("loose exposure lies between strict and span times strict", not bounds, str(bounds)),
        Check("year counts add up to the exposure", not counts, str(counts)),
        Check("decomposition is nested", not order, str(order)),
        Check("decomposition agrees with the cells", not same, str(same)),
        Check("contributors do not exceed pairs", not people, str(people)),
        Check("persistence counts do not exceed pairs", not runs, str(runs)),
    ]
