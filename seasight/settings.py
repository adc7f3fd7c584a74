"""Settings of the engine, from the Spark session's configuration or the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Settings:
    tile_size: int = 960
    tile_overlap: int = 96
    score_threshold: float = 0.10
    nms_iou: float = 0.50
    fdi_threshold: float = 0.006
    ndwi_threshold: float = 0.0
    min_candidates: int = 4
    max_cloud: float = 20.0
    surf_zone: float = 500.0

    def __post_init__(self) -> None:
        for name, lo, hi in (("tile_size", 64, 4096), ("tile_overlap", 0, 4095), ("score_threshold", 0, 1), ("nms_iou", 0, 1), ("min_candidates", 1, 2**31), ("max_cloud", 0, 100)):
            if not lo <= getattr(self, name) <= hi:
                raise ValueError(f"{name} must be between {lo} and {hi}, got {getattr(self, name)}")
        if self.tile_overlap >= self.tile_size:
            raise ValueError(f"tile_overlap {self.tile_overlap} must be below tile_size {self.tile_size}")
        if self.surf_zone <= 0:
            raise ValueError(f"surf_zone must be above 0, got {self.surf_zone}")

    @classmethod
    def load(cls, spark: SparkSession | None = None, env: Mapping[str, str] = os.environ) -> Settings:
        """``spark.seasight.NAME`` of the session, else ``SEASIGHT_NAME`` of the environment, else the default."""
        found = {}
        for f in fields(cls):
            value = (spark.conf.get(f"spark.seasight.{f.name}", None) if spark else None) or env.get(f"SEASIGHT_{f.name.upper()}")
            if value is not None:
                found[f.name] = type(f.default)(value)
        return cls(**found)

    def table(self, spark: SparkSession) -> DataFrame:
        """name, value: one row per setting."""
        return spark.createDataFrame([(k, str(v)) for k, v in asdict(self).items()], "name string, value string")
