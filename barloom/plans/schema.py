"""Feature schema: ordered names by family, which decide the columns that are read."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field


@dataclass(frozen=True)
class FeatureSchema:
    families: dict[str, list[str]] = field(default_factory=dict)
    version: str = "2.0.0"

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys(n for own in self.families.values() for n in own))

    def names_for(self, families) -> list[str]:
        wanted = set(families)
        return [n for n in self.names if self.family_of(n) in wanted]

    def without(self, family: str) -> list[str]:
        return [n for n in self.names if self.family_of(n) != family]

    def family_of(self, name: str) -> str:
        return next(f for f, own in self.families.items() if name in own)

    def digest(self) -> str:
        return hashlib.sha256(repr((self.version, sorted(self.families.items()))).encode()).hexdigest()[:16]


def build_schema(return_lags=(1, 2, 4, 8, 16), vol_windows=(10, 50, 200), slope_lags=(1, 4), raw_levels: bool = False, volume: bool = True,
    fractional: bool = True) -> FeatureSchema:
    """The default model inputs: 9 of PRICE, 7 of VOLATILITY, 2 of VOLUME, 21 of FRACTIONAL."""
    orders = ("adaptive", "025", "050", "075")
    out = {"PRICE": [f"return_{k}" for k in return_lags] + ["range_z", "close_location", "time_sin", "time_cos"],
           "VOLATILITY": [f"vol_{n}" for n in vol_windows] + ["vol_ratio_short", "vol_ratio_long", "trend_state", "volatility_state"]}
    if volume:
        out["VOLUME"] = ["volume_z", "volume_change"]
    if fractional:
        out["FRACTIONAL"] = ([f"fd_{o}" for o in orders] if raw_levels else []) + [f"fd_{o}_z" for o in orders] + [f"fd_slope_{k}_{o}" for o in orders for k in slope_lags] + [
            f"fd_curvature_{o}" for o in orders] + ["fd_cross_sm", "fd_cross_mf", "fd_cross_sf", "fractional_volatility",
                "fractional_state"]
    return FeatureSchema(out)


def cross_asset_names(symbols) -> list[str]:
    per = ("rel_return_1", "rel_return_4", "divergence", "rel_volume", "vol_divergence", "corr_short", "corr_breakdown", "age_s")
    return [f"xa_{s}_{c}" for s in symbols for c in per] + ["xa_breadth", "xa_dispersion"]
