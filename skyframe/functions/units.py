"""Units of radio maps and photometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a megaparsec, and watts per hertz and square metre in a jansky.
MPC, JANSKY = 3.086e22, 1e-26


def beam_factor(bmaj: Column, bmin: Column, cdelt1: Column, cdelt2: Column) -> Column:
    """Pixel area over beam area, from degrees."""
    beam = F.pi() * F.radians(bmaj) * F.radians(bmin) / (F.lit(4.0) * F.ln(F.lit(2.0)))
    return F.abs(F.radians(cdelt1) * F.radians(cdelt2)) / beam


def _key(header: Column, key: str) -> Column:
    missing = F.raise_error(F.lit(f"header lacks {key}")).cast("string")
    return F.coalesce(F.try_element_at(header, F.lit(key)), missing).cast("double")


def header_factor(header: Column) -> Column:
    return beam_factor(*(_key(header, k) for k in ("BMAJ", "BMIN", "CDELT1", "CDELT2")))


def with_unit(header: Column, unit: str) -> Column:
    return F.map_concat(F.map_filter(header, lambda k, _: k != "BUNIT"), F.create_map(F.lit("BUNIT"), F.lit(unit)))


def beam_to_pixel(v: Column, factor: Column) -> Column:
    return v * factor


def pixel_to_beam(v: Column, factor: Column) -> Column:
    return v / factor


def luminosity(flux: Column, distance_mpc: Column) -> Column:
    """Watts per hertz of a flux in jansky; no K correction."""
    return flux * F.lit(JANSKY) * F.lit(4.0) * F.pi() * F.pow(distance_mpc * F.lit(MPC), F.lit(2.0))


def flux_sigma(rms: Column, aperture_area: Column, beam_area: Column) -> Column:
    return rms * F.sqrt(aperture_area / beam_area)
