"""Raw tables to curated tables. Every stage is one lazy plan; the checks are the only actions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from panelcast import config
from panelcast.operators import clean, quality as dq


def clean_observations(raw: DataFrame, exclusions: Sequence[tuple[int, int]] = tuple(config.SOURCE_EXCLUSIONS),
                       check: bool = True) -> DataFrame:
    """Weekly panel from raw readings: rename, parse, exclude, grid, flag and back-fill."""
    named = clean.standard_columns(raw, config.WATER_COLUMNS)
    dq.conform(named, "observations", id="anything", date="anything", storage="anything")
    if check:
        violations = clean.reading_violations(named).first().asDict()
        if violations["unreadable_dates"]:
            clean.require_dates(named)  # reads again only to name examples
        if any(violations.values()):
            raise ValueError(f"observations: {violations}")
    return clean.weekly_panel(clean.exclude_periods(clean.parse_readings(named), exclusions))


def clean_entities(raw: DataFrame, panel: DataFrame, check: bool = True) -> DataFrame:
    entities = clean.clean_entities(raw, panel)
    if check:
        dq.enforce(dq.entity_violations(entities), "entities")
    return entities


def check_curated(panel: DataFrame, entities: DataFrame) -> None:
    """Raise when the curated tables cannot be combined."""
    dq.enforce(dq.panel_violations(panel), "panel")
    dq.enforce(dq.entity_violations(entities), "entities")
    dq.enforce_empty(dq.reference_violations(panel, entities), "panel against entities")
