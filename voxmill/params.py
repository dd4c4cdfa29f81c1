"""Parameters of the programs, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@dataclass(frozen=True)
class DimensionsParams:
    max_dim: int = 10_000
    fourier_n: int = 100_000

    def __post_init__(self):
        require(self.max_dim > 0 and self.fourier_n > 1, "max_dim and fourier_n must be positive")


@dataclass(frozen=True)
class SamplerParams:
    width: int
    height: int
    scale: float = 4.0

    def __post_init__(self):
        require(self.width > 0 and self.height > 0 and self.scale > 0, "sizes and scale must be positive")


@dataclass(frozen=True)
class StraightenParams:
    """Sample sizes, contour weights and stop rule, and the output's shape (-1: automatic)."""

    mst_points: int = 120
    contour_points: int = 3000
    replaced_per_iteration: int = 100
    move_threshold: float = 1.55
    max_iterations: int = 1000
    stable_iterations: int = 150
    alpha: float = 0.15
    beta: float = 1.1
    gamma: float = 0.6
    delta: float = 2.2
    spread: bool = False
    weighted: bool = False
    interpolate: bool = True
    out_width: int = -1
    out_height: int = -1
    out_extra: int = -1
    out_slice: int = -1
    seed: int = 42

    def __post_init__(self):
        require(self.mst_points >= 2 and self.contour_points >= 1, "at least two points are needed")
        require(self.alpha + 2 * self.beta + 2 * self.gamma + self.delta > 0, "the weights must not cancel out")


@dataclass(frozen=True)
class SvdParams:
    width: int
    height: int
    dim: int = 100
    colors: int = 20
    masks: int = 100
    scale: float = 60.0
    threshold: float = 0.6
    max_retries: int = 50
    seed: int = 42

    def __post_init__(self):
        require(self.width > 0 and self.height > 0, "width and height must be positive")
        require(1 < self.colors <= self.dim, "colors must lie between 2 and dim")
