"""Column roles of a panel."""

from __future__ import annotations

from dataclasses import dataclass, replace


class ConvergenceError(RuntimeError):
    """An iterative fit ended without meeting its tolerance."""


@dataclass(frozen=True)
class PanelSpec:
    """Roles of the columns in a long panel with one row per (unit, time).

    ``treatment`` is a 0/1 group flag that stays fixed over time; treatment starts
    after ``time_pre``. ``time_init`` is the first period and sets the ridge strength
    of the unit weights. ``covariates`` are fixed over time. ``modifiers`` are further fixed
    columns for interactions, which the weights do not use. Repeated names are dropped.
    """

    outcome: str
    treatment: str = "treated"
    unit: str = "unit"
    time: str = "time"
    cluster: str | None = None
    time_pre: int = 0
    time_init: int | None = None
    covariates: tuple[str, ...] = ()
    name: str = "model"
    modifiers: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "covariates", tuple(dict.fromkeys(self.covariates)))
        object.__setattr__(self, "modifiers", tuple(dict.fromkeys(self.modifiers)))

    def with_(self, **changes: object) -> PanelSpec:
        return replace(self, **changes)
