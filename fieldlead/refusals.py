"""Settings that look as if they governed something and would not: refused before anything runs."""

from __future__ import annotations

from fieldlead.config import Config

#: Lines of the persistence figure, one per cutoff, in the order of the cutoffs.
LINE_COLOURS = ("black", "blue", "orange", "green", "red", "purple")


class Refused(NotImplementedError):
    """A setting asks for something that no stage does."""


def field_size_is_a_head_count(cfg: Config) -> None:
    """Field sizes are head counts of documents; another method would be ignored, and the floor would not mean what it says."""
    if cfg["counting.field_size"] != "full":
        raise Refused(f"counting.field_size is {cfg['counting.field_size']!r}, but field sizes are counted in whole documents only; set it to 'full'")


def metric_is_document_share(cfg: Config) -> None:
    """Cutoffs are applied to shares of documents, the only share that a panel holds."""
    if cfg["select.metric"] != "document_share":
        raise Refused(f"select.metric is {cfg['select.metric']!r}, but panels hold shares of documents only; set it to 'document_share'")


def margin_rule_stays_at_rank_one(cfg: Config) -> None:
    """Margins exist at rank 1 only: a rule for lower ranks would admit nobody while seeming to."""
    if cfg["select.max_rank"] != 1:
        raise Refused(f"select.max_rank is {cfg['select.max_rank']}, but margins are measured at rank 1 only, so lower ranks could never pass; set it to 1")


def figure_has_a_line_per_cutoff(cfg: Config) -> None:
    """A figure that silently leaves out a cutoff is worse than none."""
    n = len(set(cfg["select.cutoffs"]))
    if n > len(LINE_COLOURS):
        raise Refused(f"select.cutoffs has {n} values and the figure {len(LINE_COLOURS)} lines; the last ones would be missing from it")


def filing_years_need_primary_codes(cfg: Config) -> None:
    """Filing years behind a run are read from one code per document; with all codes a document would count twice in a wider field."""
    if cfg["codes.assignment"] != "primary":
        raise Refused(f"codes.assignment is {cfg['codes.assignment']!r}: documents with several codes would count repeatedly in the filing years behind a run; set it to 'primary'")


def before_measuring(cfg: Config) -> None:
    field_size_is_a_head_count(cfg)


def before_selecting(cfg: Config) -> None:
    metric_is_document_share(cfg)
    margin_rule_stays_at_rank_one(cfg)
    figure_has_a_line_per_cutoff(cfg)


def floors_to_report(cfg: Config) -> tuple[list[bool], str]:
    """The floor settings that reports show, with the sentence that says so. The tables themselves always hold both."""
    if cfg["report.both_floors"]:
        return [True, False], "Both tables: with the floor of field size and without it."
    only = cfg["report.with_floor"]
    return [only], f"One table only, {'with' if only else 'without'} the floor of field size; the decomposition still tells both."
