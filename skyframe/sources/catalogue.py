"""Catalogues and run settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GIANTS = "Ref string, RAJ2000 double, DEJ2000 double"


def read_giants(spark: SparkSession, path: str, reference: str | None = None) -> DataFrame:
    """(ra, dec) of a CSV catalogue with a header, of one reference if it is named."""
    names = spark.read.option("header", True).csv(path).columns
    rows = spark.read.option("header", True).schema(", ".join(f"`{n}` {'double' if n in ('RAJ2000', 'DEJ2000') else 'string'}" for n in names)).csv(path)
    if reference is not None:
        rows = rows.where(F.col("Ref") == reference)
    return rows.select(F.col("RAJ2000").alias("ra"), F.col("DEJ2000").alias("dec"))


@dataclass(frozen=True)
class Settings:
    """What a run needs; `from_yaml` takes nested groups of the same names in any case."""

    cutout_size: int = 425
    crop_size: int = 300
    rms: float = 1e-4
    nr_sigmas: float = 3.0
    stride: float = 0.5
    max_islands: int = 10
    angles: list[float] = field(default_factory=lambda: [0.0, 45.0, 90.0, 135.0, 180.0, 225.0, 270.0, 315.0])
    asinh: bool = False
    segmentation: str = "rle"

    @classmethod
    def from_yaml(cls, path: str) -> Settings:
        import yaml

        flat: dict = {}

        def walk(node: dict) -> None:
            for k, v in node.items():
                if isinstance(v, dict):
                    walk(v)
                else:
                    flat[str(k).lower()] = v

        with open(path) as f:
            walk(yaml.safe_load(f) or {})
        return cls(**{k: v for k, v in flat.items() if k in cls.__dataclass_fields__})
