"""Constants that define the semantics, as frozen settings."""

from __future__ import annotations

from dataclasses import dataclass, field

# Body parts in file order, and the sets used for curvature, swimming and lengths.
PARTS = ("Head1", "Head2", "MFC1", "MFC2", "MFC3", "MFC4", "MFC5", "Tail1", "Tail2", "Tail3", "Tail4")
MFC_PARTS = ("MFC1", "MFC2", "MFC3", "MFC4", "MFC5")
CURVATURE_SETS = {"curvature_1": MFC_PARTS, "curvature_2": ("Head2", *MFC_PARTS, "Tail1"), "curvature_3": PARTS}
CURVATURE_MIN_POINTS = {"curvature_1": 4, "curvature_2": 6, "curvature_3": 9}
SWIM_PARTS = ("Tail1", "Tail2", "Tail3", "Tail4", "MFC5")
ONE_SIDED = {"Tail1": 3.0, "Tail2": 5.0, "Tail3": 9.0, "Tail4": 15.0, "MFC5": 2.0}
STATES = ("Active", "Swimming", "Resting")


# Thresholds and rates of FrameConfig, WindowConfig, DielConfig and ActivityConfig.
@dataclass(frozen=True)
class FrameConfig:
    likelihood: float = 0.6
    fps: float = 20.0
    mm_per_px: float = 2.0
    jitter_px: float = 1.0
    jump_px: float = 200.0
    jump_of_body: float = 0.25
    jump_parts: int = 2
    body_mm: tuple[float, float] = (270.0, 670.0)
    invalid: float = 0.02
    extreme: float = 0.01
    normal: float = 0.0033
    fit: str = "hyper"
    #: Parts of each curvature set, and how many of them a fit needs.
    sets: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(CURVATURE_SETS))
    min_points: dict[str, int] = field(default_factory=lambda: dict(CURVATURE_MIN_POINTS))
    #: Bounds of a set's arc length in mm, for all sets or by name; None is open.
    length_mm: tuple[float | None, float | None] | dict[str, tuple[float | None, float | None]] = (None, None)
    #: Cumulative travel restarts at 0 on an accepted frame that follows a rejected one.
    compat_quirks: bool = True

    def bounds(self, name: str) -> tuple[float | None, float | None]:
        """Bounds of a set's arc length."""
        return self.length_mm.get(name, (None, None)) if isinstance(self.length_mm, dict) else self.length_mm

    def least_points(self, name: str) -> int:
        """Points that a fit of a set needs: four fifths of its parts where nothing is set."""
        return self.min_points.get(name, -(-4 * len(self.sets[name]) // 5))


@dataclass(frozen=True)
class WindowConfig:
    fps: float = 20.0
    frames: int = 200
    body_length_mm: float = 490.0
    high_skip: float = 0.70

    @property
    def seconds(self) -> float:
        return self.frames / self.fps


@dataclass(frozen=True)
class DielConfig:
    sunrise: int = 6
    sunset: int = 20
    rolling_days: int = 5
    n_boot: int = 400
    seed: int = 0


@dataclass(frozen=True)
class ActivityConfig:
    counts_per_hour: float = 7200.0
    distance_per_hour: float = 1_200_000.0
    chunk_minutes: float = 1.0
    corrupted_ratio: float = 0.1


def cpu_share(cores: int, share: float) -> int:
    """Tasks to run at once for a share of the cores, one at least."""
    return max(1, int(cores * share))
