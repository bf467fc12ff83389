"""Pilot gate and power summary: rules over counts that a study has reached."""

from __future__ import annotations

from dataclasses import dataclass

from tallywright.functions import inference


@dataclass(frozen=True)
class PilotCounts:
    incidents_labelled: int
    controls: int
    events_dated: int
    label_missing_pct: float = 0.0
    timestamp_missing_pct: float = 0.0


def gate(counts: PilotCounts, least_incidents: int, least_controls: int, least_events: int, most_missing_pct: float = 50.0) -> tuple[str, list[str]]:
    """GO, GO_WITH_REDUCED_SCOPE or NO_GO, with reasons; too few dated events are a reason only."""
    narrower = [
        (counts.incidents_labelled < least_incidents, f"labelled incidents {counts.incidents_labelled} below {least_incidents}"),
        (counts.controls < least_controls, f"controls {counts.controls} below {least_controls}"),
        (max(counts.label_missing_pct, counts.timestamp_missing_pct) > most_missing_pct, f"missing labels {counts.label_missing_pct:.1f} %, timestamps {counts.timestamp_missing_pct:.1f} %"),
    ]
    reasons = [why for hit, why in narrower if hit]
    decision = "GO_WITH_REDUCED_SCOPE" if reasons else "GO"
    if counts.events_dated < least_events:
        reasons.append(f"dated events {counts.events_dated} below {least_events}: time analysis is exploratory")
    if counts.incidents_labelled == 0:
        decision = "NO_GO"
        reasons.append("no labelled incident: the hypothesis cannot be tested on this source")
    return decision, reasons or ["all thresholds met"]


def power_table(table: tuple[int, int, int, int], ratios=(0.5, 0.67, 1.5, 2.0, 3.0)) -> dict:
    """Sample size for 80 % power and power reached, by odds ratio, from a table's own rates."""
    a, b, c, d = table
    n = a + b + c + d
    p, prevalence = (c / (c + d) if c + d else 0.0), ((a + b) / n if n else 0.0)
    usable = 0 < p < 1 and 0 < prevalence < 1
    rows = {r: {"n_required": inference.logistic_size(p, r, prevalence)["n"], "power": inference.achieved_power(n, p, prevalence, r)} if usable else {"n_required": float("inf"), "power": float("nan")} for r in ratios}
    return {"n": n, "p_control": p, "prevalence": prevalence, "by_ratio": rows}


def power_summary(flagged: int, control: int, rate_flagged: float, rate_control: float, dated_events: int) -> str:
    """A paragraph of what the pilot's rates would need."""
    if rate_control <= 0:
        return "The control rate is zero: no odds ratio can be powered from this pilot."
    ratio = rate_flagged / (1 - rate_flagged) / (rate_control / (1 - rate_control)) if 0 < rate_flagged < 1 and rate_control < 1 else float("nan")
    target = ratio if ratio == ratio and ratio not in (0, 1) else 2.0
    size = inference.logistic_size(rate_control, target, flagged / (flagged + control) if flagged + control else 0.5)
    events = inference.survival_events(target)
    return f"Pilot: {flagged} flagged, {control} controls, rates {rate_flagged:.3f} and {rate_control:.3f} (odds ratio {ratio:.2f}). Detecting {target:.2f} at 80 % takes n = {size['n']} ({size['events']} events); a hazard ratio that large takes {events} dated events, of which there are {dated_events}."
