"""Band selection and derived bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..schema import BANDS, LIDAR_BANDS, RGB


def band_list(bands: str | Sequence[str] = "all", without: str | Sequence[str] = ()) -> list[str]:
    """Resolve ``all``, ``rgb``, one name or an ordered list; ``without`` drops a band or ``lidar``."""
    named = {"all": BANDS, "rgb": RGB, "lidar": LIDAR_BANDS}
    expand = lambda spec: list(named.get(spec, [spec])) if isinstance(spec, str) else list(spec)
    chosen, dropped = expand(bands), set(expand(without))
    unknown = [b for b in [*chosen, *dropped] if b not in BANDS]
    if unknown:
        raise ValueError(f"unknown bands: {unknown}")
    return [b for b in chosen if b not in dropped]


def has_rgb(bands: Sequence[str]) -> bool:
    """Colour bands need red, green, blue in front."""
    return list(bands[:3]) == RGB


def select_bands(df: DataFrame, bands: str | Sequence[str] = "all", without=(), keys: Sequence[str] = ()) -> DataFrame:
    """Ordered band subset; the other columns are pruned from the scan."""
    return df.select(*keys, *band_list(bands, without))


def _append(df: DataFrame, names: Sequence[str], values: Sequence[Column]) -> DataFrame:
    return df.withColumns(dict(zip(names, values)))


def _rgb(channels: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in channels]


def append_tgi(df: DataFrame, channels: Sequence[str] = RGB) -> DataFrame:
    return _append(df, ["tgi"], [color.tgi(*_rgb(channels))])


def append_hsv(df: DataFrame, channels: Sequence[str] = RGB) -> DataFrame:
    return _append(df, ["hue", "saturation", "value"], color.hsv(*_rgb(channels)))


def append_lab(df: DataFrame, channels: Sequence[str] = RGB) -> DataFrame:
    return _append(df, ["lab_l", "lab_a", "lab_b"], color.lab(*_rgb(channels)))


def vector_to_bands(df: DataFrame, vector: str, bands: Sequence[str] = BANDS) -> DataFrame:
    """Spread the first elements of a vector over band columns."""
    return df.withColumns({b: F.col(vector)[i].cast("double") for i, b in enumerate(bands)})


def bands_to_vector(df: DataFrame, bands: Sequence[str], vector: str = "bands") -> DataFrame:
    """Pack band columns into one float array, in order."""
    return df.withColumn(vector, F.array(*[F.col(b).cast("float") for b in bands]))
