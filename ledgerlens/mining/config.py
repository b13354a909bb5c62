"""Driver-side description of one mined view."""

from __future__ import annotations

from dataclasses import dataclass

CATEGORICAL_TYPES = (
    "OUTSTANDING_1", "OUTSTANDING_LAST", "TOP_TWO", "LAST_TWO", "EVENNESS", "ATTRIBUTION",
)
TEMPORAL_TYPES = ("TREND", "OUTLIER", "SEASONALITY", "CHANGE_POINT", "UNIMODALITY")


@dataclass(frozen=True)
class Measure:
    """A named aggregate (`sum` or `avg`) of one numeric column."""

    name: str
    agg: str = "sum"
    column: str | None = None

    @property
    def source(self) -> str:
        return self.column or self.name


@dataclass(frozen=True)
class ViewConfig:
    """What is sliced, what is measured, and the thresholds that decide."""

    name: str
    dimensions: tuple[str, ...]
    temporal_dimensions: tuple[str, ...]
    measures: tuple[Measure, ...]
    impact_measures: tuple[str, ...]
    max_subspace_depth: int = 2
    tau: float = 0.5
    min_impact: float = 0.01
    min_hdp_size: int = 3
    excluded_pairs: tuple[tuple[str, str], ...] = ()
    min_temporal_nonzero: int = 4
    min_temporal_nonzero_frac: float = 1 / 3
    extremum_ratio: float = 0.67
    # a dimension's domain is broadcast only up to this many values
    broadcast_domain_limit: int = 200_000

    @property
    def all_dims(self) -> tuple[str, ...]:
        return self.dimensions + tuple(t for t in self.temporal_dimensions if t not in self.dimensions)

    @property
    def value_columns(self) -> tuple[str, ...]:
        wanted = [m.source for m in self.measures] + list(self.impact_measures)
        return tuple(dict.fromkeys(wanted))

    def is_temporal(self, dim: str) -> bool:
        return dim in self.temporal_dimensions

    def measures_for(self, breakdown: str) -> tuple[int, ...]:
        """Ids of the measures that may be broken down by `breakdown`."""
        return tuple(
            i for i, m in enumerate(self.measures) if (m.name, breakdown) not in self.excluded_pairs
        )
