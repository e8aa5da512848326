"""Distances in a Lambda-CDM universe, as expressions.

The integral over redshift is a composite Simpson sum with fixed nodes. Photons and neutrinos count as radiation in
`hubble_parameter` and `comoving_distance`; luminosity and angular-diameter distances give one neutrino its mass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Planck 2018 parameters.
H0 = 67.66
OMEGA_M = 0.30966
T_CMB, N_EFF, NEUTRINO_EV = 2.7255, 3.046, 0.06
LIGHT_KM_S = 299792.458

#: Photon density over the critical density.
OMEGA_PHOTON = 2.4728e-5 * (T_CMB / 2.7255) ** 4 / (H0 / 100) ** 2
#: One neutrino kind's density over the photons' while it is relativistic, its mass over temperature today, and the mass's fitted factor today.
_EACH = 7 / 8 * (4 / 11) ** (4 / 3) * N_EFF / 3
_MASS, _POWER = 0.3173 * NEUTRINO_EV / (8.617333262e-5 * T_CMB * (4 / 11) ** (1 / 3)), 1.83
_HEAVY_NOW = (1 + _MASS**_POWER) ** (1 / _POWER)
OMEGA_R = OMEGA_PHOTON * (1 + _EACH * (2 + _HEAVY_NOW))
OMEGA_K = 0.0
OMEGA_L = 1 - OMEGA_M - OMEGA_R - OMEGA_K
#: Simpson intervals between redshift 0 and z.
STEPS = 200


def hubble_distance() -> float:
    return LIGHT_KM_S / H0


def normalized_hubble_parameter(z: Column) -> Column:
    a = F.lit(1.0) + z
    return F.sqrt(F.lit(OMEGA_M) * a * a * a + F.lit(OMEGA_R) * a * a * a * a + F.lit(OMEGA_L) + F.lit(OMEGA_K) * a * a)


def hubble_parameter(z: Column) -> Column:
    return F.lit(H0) * normalized_hubble_parameter(z)


def _simpson(z: Column, f, steps: int = STEPS) -> Column:
    def term(i: Column) -> Column:
        weight = F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return weight * f(z * i / float(steps))

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda acc, i: acc + term(i)) * z / float(3 * steps)


def comoving_distance(z: Column, steps: int = STEPS) -> Column:
    """Megaparsecs."""
    return F.lit(hubble_distance()) * _simpson(z, lambda x: 1.0 / normalized_hubble_parameter(x), steps)


def transverse_comoving_distance(z: Column, omega_k: float = OMEGA_K) -> Column:
    d, dh = comoving_distance(z), hubble_distance()
    if omega_k > 0:
        root = math.sqrt(omega_k)
        return F.lit(dh / root) * F.sinh(F.lit(root) * d / F.lit(dh))
    if omega_k < 0:
        root = math.sqrt(-omega_k)
        return F.lit(dh / root) * F.sin(F.lit(root) * d / F.lit(dh))
    return d


def _massive_inverse(z: Column) -> Column:
    """1 / E(z) with two massless neutrinos and one whose density follows its mass over temperature."""
    a = F.lit(1.0) + z
    heavy = F.pow(F.lit(1.0) + F.pow(F.lit(_MASS) / a, F.lit(_POWER)), F.lit(1 / _POWER))
    radiation = F.lit(OMEGA_PHOTON) * (F.lit(1.0) + F.lit(_EACH) * (F.lit(2.0) + heavy))
    return 1.0 / F.sqrt(F.lit(OMEGA_M) * a * a * a + radiation * a * a * a * a + F.lit(OMEGA_L))


def _proper(z: Column) -> Column:
    return F.lit(hubble_distance()) * _simpson(z, _massive_inverse)


def luminosity_distance(z: Column) -> Column:
    return _proper(z) * (1.0 + z)


def angular_diameter_distance(z: Column) -> Column:
    return _proper(z) / (1.0 + z)


def flux_scaling(z_old: Column, z_new: Column) -> Column:
    ratio = luminosity_distance(z_old) / luminosity_distance(z_new)
    return ratio * ratio


def angular_scaling(z_old: Column, z_new: Column) -> Column:
    return angular_diameter_distance(z_old) / angular_diameter_distance(z_new)
