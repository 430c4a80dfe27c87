"""Physical constants of the flotation problem."""

from __future__ import annotations

from dataclasses import dataclass

#: Speed of light in vacuum, m/s, and the permittivity used for the margin around a radar pick.
LIGHT = 299_792_458.0
MARGIN_PERMITTIVITY = 3.17


@dataclass(frozen=True)
class PhysicalConstants:
    """Densities in kg/m^3 and the relative permittivity of ice."""

    ice: float = 917.0
    sea_water: float = 1028.0
    permittivity: float = 3.15

    @property
    def flotation_factor(self) -> float:
        return 1.0 - self.ice / self.sea_water

    @property
    def density_ratio(self) -> float:
        return self.sea_water / self.ice


EARTH = PhysicalConstants()
