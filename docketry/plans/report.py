"""Every analysis of the study over one set of tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame

from docketry.plans import analyses as a
from docketry.plans import figures
from docketry.plans.tables import ChargeTables

ANALYSES: dict[str, Callable[[ChargeTables], DataFrame]] = {
    "charge_count": a.charge_count,
    "share_by_level": a.share_of_level,
    "share_low_level": a.share_low_level,
    "share_svf": a.share_serious,
    "missing_rates": a.missing_rates,
    "figure1_types": figures.charge_types,
    "low_level_mix": a.low_level_mix,
    "top10_low_level": a.top_low_level,
    "share_dismissed": a.share_dismissed,
    "share_diverted": a.share_diverted,
    "results_within_level": a.results_within_level,
    "dismissed_within_level": a.dismissed_within_level,
    "all_dismissed_persons": a.all_dismissed_persons,
    "half_dismissed_persons": a.half_dismissed_persons,
    "top10_dismissed_of_top50": a.top_dismissed_codes,
    "case_severity": figures.case_severity,
    "misd_cases": a.misdemeanor_cases,
    "misd_defendants": a.misdemeanor_defendants,
    "top3_misd": a.top_misdemeanors,
    "top3_misd_pct_total": a.top_misdemeanors_total,
    "target_share_distribution": a.target_share_distribution,
    "result_freq": a.result_freq,
    "results_top6": a.top_results,
    "rank_22_23": a.offences_by_rank,
    "text_match_count": a.text_match_count,
    "pattern_level_mix": a.pattern_level_mix,
    "exact_level_mix": a.exact_level_mix,
    "wobbler_level_mix": a.wobbler_level_mix,
    "declinable_total": a.declinable_total,
    "declinable_results": a.declinable_results,
    "only_declinable_persons": a.only_declinable_persons,
    "low_level_freq": a.low_level_freq,
    "low_level_results": a.low_level_results,
    "folded_results": figures.outcomes,
    "person_counts": a.person_counts,
    "any_diverted_persons": a.any_diverted_persons,
    "any_diverted_persons_pre_dedup": a.any_diverted_persons_of_all,
    "one_diverted_persons": a.one_diverted_persons,
    "top5_diverted_rate": figures.diverted_offences,
    "external_ratio": a.external_ratio,
    "low_level_code_string": a.low_level_code_string,
    "figure_labels": figures.bar_labels,
}


class Report(Mapping[str, DataFrame]):
    """All analyses by name, with the parameters of the study or one's own.

    Nothing runs until an analysis is looked up; then the roll-ups it needs are written, once
    for all analyses.
    """

    def __init__(self, tables: ChargeTables, parameters: Mapping[str, Mapping[str, object] | Sequence[object]]):
        if unknown := sorted(set(parameters) - set(ANALYSES)):
            raise ValueError(f"no such analyses: {unknown}")
        self.tables = tables
        self.parameters = parameters

    def __getitem__(self, name: str) -> DataFrame:
        own = self.parameters.get(name, {})
        if isinstance(own, Mapping):
            return ANALYSES[name](self.tables, **own)
        return ANALYSES[name](self.tables, *own)

    def __iter__(self) -> Iterator[str]:
        return iter(ANALYSES)

    def __len__(self) -> int:
        return len(ANALYSES)


def report(tables: ChargeTables, **parameters: Mapping[str, object] | Sequence[object]) -> Report:
    """The report over one set of tables.

    Codes, patterns, list lengths and the like of single analyses are given by the analysis'
    name, as keywords or in order: `report(tables, top3_misd={"k": 5}, text_match_count=["tres"])`.
    """
    return Report(tables, parameters)
