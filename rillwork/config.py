"""Parameters in metres, square metres and probabilities; converted to cells where they are used."""

from __future__ import annotations

import math
import os
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class Terrain:
    """Windows of the feature bands."""

    relief_windows_m: tuple[float, ...] = (5.0, 11.0, 21.0)
    tophat_windows_m: tuple[float, ...] = (11.0, 21.0, 41.0)
    curvature_sigmas_m: tuple[float, ...] = (2.0, 4.0)
    sky_radius_m: float = 20.0
    sky_rays: int = 8


@dataclass(frozen=True)
class ValleyShape:
    """A cell is in a valley of this shape if it is curved and lies deep enough below two closings."""

    sigma_m: float
    curvature: float
    depths: tuple[tuple[float, float], ...]  # window of a closing in metres, least depth below it


@dataclass(frozen=True)
class Valleys:
    """Which cells are channels, and which parts of the map stay."""

    shapes: tuple[ValleyShape, ...] = (ValleyShape(2.0, 0.03, ((11.0, 0.15),)), ValleyShape(4.0, 0.015, ((21.0, 0.3), (11.0, 0.1))))
    least_part_m2: float = 30.0
    least_line_m: float = 25.0
    spur_m: float = 10.0
    steepest: float = 0.10
    steep_from_m2: float = 1000.0


@dataclass(frozen=True)
class Water:
    """Digging, filling and ponds."""

    dig_reach_m: float = 100.0
    dig_budget: float = math.inf
    noted_cut_m: float = 0.1
    level_step_cost: float = 1e-3
    pond_depth_m: float = 0.02


@dataclass(frozen=True)
class Links:
    """Acceptance of links between channel pieces."""

    max_m: float = 30.0
    gap_scale_m: float = 10.0
    rise_sigma_m: float = 0.3
    road_prior: float = 0.05
    tier_p: tuple[tuple[str, float], ...] = (("high", 0.8), ("medium", 0.5), ("low", 0.2))
    keep_p: float = 0.5
    minor_width_m: float = 1.5
    minor_depth_m: float = 0.3
    keep_kinds: tuple[str, ...] = ("river", "stream", "canal")
    fragment_min_m: float = 100.0


@dataclass(frozen=True)
class Candidates:
    min_height_m: float = 0.3
    merge_m: float = 10.0
    road_near_m: float = 15.0
    deck_m: float = 2.0
    open_below_m: float = 0.15
    vegetation_share: float = 0.5


@dataclass(frozen=True)
class Config:
    terrain: Terrain = field(default_factory=Terrain)
    valleys: Valleys = field(default_factory=Valleys)
    water: Water = field(default_factory=Water)
    links: Links = field(default_factory=Links)
    candidates: Candidates = field(default_factory=Candidates)

    def with_options(self, **options) -> Config:
        """Blocks by name, each a mapping of its changed fields; an unknown name is an error."""
        out = self
        for block, changes in options.items():
            if block not in asdict(self):
                raise ValueError(f"unknown option block {block!r}")
            unknown = set(changes) - set(asdict(getattr(out, block)))
            if unknown:
                raise ValueError(f"unknown options in {block}: {', '.join(sorted(unknown))}")
            out = replace(out, **{block: replace(getattr(out, block), **changes)})
        return out


@dataclass(frozen=True)
class Settings:
    """Product request settings, from RILLWORK_* environment variables."""

    backend: str = "raster"
    resolution: int = 8
    land_source: str = "coverage"
    buffer_m: float = 10.0
    spatial_reuse: bool = False
    land_file: str | None = None

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        found = {}
        for name, default in asdict(cls()).items():
            text = env.get(f"RILLWORK_{name.upper()}")
            if text in (None, ""):
                continue
            if isinstance(default, bool):
                word = text.strip().lower()
                if word not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
                    raise ValueError(f"{name}: not a truth value: {text!r}")
                found[name] = word in ("1", "true", "yes", "on")
            else:
                found[name] = type(default)(text) if default is not None else text
        return cls(**found).checked()

    def checked(self) -> Settings:
        if self.backend not in ("raster", "points"):
            raise ValueError(f"backend: {self.backend!r}")
        if self.resolution not in (1, 2, 4, 8):
            raise ValueError(f"resolution: {self.resolution!r}")
        if self.land_source == "file" and not self.land_file:
            raise ValueError("land_source=file needs land_file")
        return self
