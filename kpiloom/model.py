"""KPI definitions: the small metadata objects that drive generic expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field

ADDITIVE = ("sum", "count")
RATIO = ("avg", "rate")

# Below this many periods a KPI is flagged low-data and detectors stay silent.
MIN_PERIODS = 8


@dataclass(frozen=True)
class Kpi:
    """``aggregation(measure) by slices``. ``scale`` is the number of decimals kept when a double measure is summed."""

    measure: str
    aggregation: str = "sum"
    slice_columns: tuple[str, ...] = ()
    dataset_id: str = ""
    scale: int = 6
    name: str = field(default="")

    def __post_init__(self) -> None:
        if self.aggregation not in ADDITIVE + RATIO:
            raise ValueError(f"unknown aggregation {self.aggregation!r}")
        object.__setattr__(self, "slice_columns", tuple(self.slice_columns))
        if not self.name:
            object.__setattr__(self, "name", kpi_name(self.measure, self.aggregation, self.slice_columns))

    @property
    def kpi_id(self) -> str:
        """Stable key: the same dataset and name always give the same id."""
        return hashlib.sha256(f"kpi:{self.dataset_id}:{self.name}".encode()).hexdigest()

    @property
    def additive(self) -> bool:
        return self.aggregation in ADDITIVE


def kpi_name(measure: str, aggregation: str, slices: Iterable[str] = ()) -> str:
    slices = list(slices)
    return f"{aggregation}({measure})" + (" by " + " & ".join(slices) if slices else "")
