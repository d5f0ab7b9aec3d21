"""Default parameters. Values are fixed: results depend on them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RebinConfig:
    cadence_threshold_days: float = 0.5
    min_err: float = 1e-8


@dataclass(frozen=True)
class BaselineConfig:
    clip_sigma: float = 3.0
    n_iter: int = 5
    mad_scale: float = 1.4826
    min_points: int = 5
    rolling_min_points: int = 15


@dataclass(frozen=True)
class DetectorConfig:
    nsigma_enter: float = 5.0
    nsigma_exit: float = 2.5
    min_ratio: float = 1.5
    min_points: int = 4
    min_duration_days: float = 1.0
    cadence_duration_factor: float = 3.0
    min_separation_days: float = 2.0
    min_seed_points: int = 2
    max_gap_factor: float = 5.0
    rolling_baseline_days: float | None = None
    n_bootstrap: int = 30
    bootstrap_seed: int = 42
    bootstrap_min_quiescent: int = 10
    skip_fap: bool = False

    @property
    def min_series_points(self) -> int:
        return max(10, 2 * self.min_points)

    @property
    def block_length(self) -> int:
        return max(3, self.min_points)


@dataclass(frozen=True)
class PeriodConfig:
    min_events: int = 5
    cv_threshold: float = 0.30
    fap_threshold: float = 0.05
    edge_guard_frac: float = 0.02
    min_period_days: float = 2.0
    cadence_factor: float = 5.0
    samples_per_peak: int = 5
    gap_match: float = 0.25


@dataclass(frozen=True)
class FitConfig:
    min_points: int = 10
    min_catalog_points: int = 25
    min_duration_days: float = 0.5
    shape_grid: int = 5000
    sigma_thresh: float = 3.0
    max_iter: int = 120


@dataclass(frozen=True)
class SlopeConfig:
    tol_days: float = 1.0
    min_snr: float = 3.0
    baseline_percentile: float = 0.10
    min_pairs_per_source: int = 2
    min_pairs: int = 5
    clip_sigma: float = 3.0
    max_abs_beta: float = 3.0
    fallback_beta: float = 0.5
    sigma_floor_dex: float = 1e-3
    flux_floor: float = 1e-30
    snr_floor: float = 3.0
    taper_width: float = 1.5


@dataclass(frozen=True)
class SkyConfig:
    match_radius_arcsec: float = 10.0
    sanity_radius_arcsec: float = 600.0
    name_index_min_radius_arcsec: float = 15.0
    dedup_radius_arcsec: float = 5.0


# Groups above this many rows are never handed to one task (see operators.skew).
HOT_GROUP_ROWS = 5_000_000
# Largest table, in rows, that is broadcast; it is counted first.
BROADCAST_ROWS = 200_000
# Largest such table in bytes.
BROADCAST_BYTES = 64 << 20
