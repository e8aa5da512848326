"""File names of samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import zero_filled


def sample_name(prefix: str, image_id: Column, ra: Column, dec: Column, angle: Column | None = None) -> Column:
    """<prefix>_<id, ten digits>[_rotated_angle<angle>]_RA<ra>_DEC<dec>.png; the angle is named where it isn't null."""
    turned = F.when(angle.isNotNull(), F.concat(F.lit("_rotated_angle"), angle.cast("int").cast("string"))).otherwise("") if angle is not None else F.lit("")
    return F.concat(F.lit(f"{prefix}_"), zero_filled(image_id.cast("string"), 10), turned, F.lit("_RA"), ra.cast("string"), F.lit("_DEC"), dec.cast("string"), F.lit(".png"))


def proposal_name(file_name: Column) -> Column:
    return F.replace(file_name, F.lit(".png"), F.lit(".npz"))
