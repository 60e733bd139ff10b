"""Everything a study may choose, in one immutable value."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Params:
    """Choices of one study.

    Value lists that no source table documents (books, settings, exclusions)
    start empty where nothing is known; a check that needs an empty one is
    reported as UNVERIFIABLE by :mod:`carryover.operators.verdict`.
    """

    # --- window -----------------------------------------------------------
    y1: int = 2023
    y2: int = 2024
    first_year: int = 2019
    last_year: int = 2025

    # --- population -------------------------------------------------------
    state: str = "FL"
    # claim business line code -> name of the book it is reported under
    books: Mapping[str, str] = field(default_factory=dict)
    network_areas_out: tuple[str, ...] = ()
    submarkets: tuple[str, ...] = ()

    # --- conditions -------------------------------------------------------
    # Fixed value: the ICD-10 diabetes block.
    families: Mapping[str, str] = field(
        default_factory=lambda: {"diabetes": "^E(08|09|10|11|12|13)"}
    )
    main_family: str = "diabetes"
    control_family: str | None = None

    # --- settings and sources ---------------------------------------------
    # place of service code -> setting
    settings: Mapping[str, str] = field(
        default_factory=lambda: {"F": "office", "OP": "outpatient", "IP": "inpatient"}
    )
    excluded_sources: tuple[str, ...] = ()
    # specialty -> settings its lines are expected in; others are not judged
    specialty_settings: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    # sources the curated extract leaves out
    curated_sources_out: tuple[str, ...] = ("DENTAL",)

    # --- rules ------------------------------------------------------------
    mentions: int = 2
    mention_unit: str = "date"  # or "visit": distinct (date, provider)
    min_panel: int = 30
    panel_basis: str = "confirmed"  # or "judged"
    sensitivity_panels: tuple[int, ...] = (20, 30, 50)
    sensitivity_mentions: tuple[int, ...] = (1, 2)
    shrink_weight: int = 30
    bottom_share: float = 0.25
    case_members: int = 50
    extreme_members: int = 10
    extreme_doctors: int = 3
    probe_lines: int = 10_000
    provider_key: str = "provider_id"

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)

    @property
    def years(self) -> tuple[int, int]:
        return (self.y1, self.y2)
