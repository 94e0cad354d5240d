"""Analysis settings: plain literals, one frozen object, no config files."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Everything an analysis depends on.  Times are in seconds unless named otherwise."""

    # fixed values: published analysis constants
    step_s: float = 60.0
    window_steps: int = 5
    growth_steps: int = 30
    min_objects: int = 100
    size_classes: int = 30
    trim_percentile: float = 0.99
    prior_count: float = 20.0
    bootstrap_reps: int = 200
    interval: float = 0.90
    sigma_um: float = 0.65
    size_noise_um: float = 0.0
    spec_d10_um: float = 12.0
    target_mean_um: float = 16.0
    p_spec_min: float = 0.95
    cv_target: float = 0.30
    undecided_limit: float = 0.20
    eta_steps: int = 30
    smooth_steps: int = 3
    ewma_lambda: float = 0.02
    t2_confidence: float = 0.99
    exceed_limits: tuple[float, float] = (0.05, 0.20)
    undecided_limits: tuple[float, float] = (0.10, 0.20)
    reflector_limits: tuple[float, float] = (1.5, 3.0)
    min_baseline: int = 50
    min_cell_count: int = 15
    max_error_um: float = 2.0
    max_error_share: float = 0.01
    size_edges: tuple[float, float, int] = (500.0, 1010.0, 200)


DEFAULTS = Settings()
