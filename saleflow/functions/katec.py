"""Old Korean grid coordinates (transverse Mercator on the Bessel ellipsoid) to WGS84."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Projection, Bessel and WGS84 ellipsoids, shift in metres.
LAT0, LON0, SCALE, X0, Y0 = np.radians(38.0), np.radians(128.0), 0.9999, 400_000.0, 600_000.0
BESSEL, WGS84 = (6_377_397.155, 1 / 299.1528128), (6_378_137.0, 1 / 298.257223563)
SHIFT = (-146.43, 507.89, 681.46)


def _meridian(lat: np.ndarray, a: float, e2: float) -> np.ndarray:
    e4, e6 = e2 * e2, e2**3
    return a * (
        (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * lat - (3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * np.sin(2 * lat)
        + (15 * e4 / 256 + 45 * e6 / 1024) * np.sin(4 * lat) - 35 * e6 / 3072 * np.sin(6 * lat)
    )


def unproject(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(longitude, latitude) on the Bessel ellipsoid in radians."""
    a, f = BESSEL
    e2 = 2 * f - f * f
    ep = e2 / (1 - e2)
    m = _meridian(LAT0, a, e2) + (y - Y0) / SCALE
    lat = m / a
    for _ in range(6):  # the foot-point latitude, by Newton's rule on the meridian arc
        lat = lat + (m - _meridian(lat, a, e2)) / (a * (1 - e2) / (1 - e2 * np.sin(lat) ** 2) ** 1.5)
    s, c, t = np.sin(lat), np.cos(lat), np.tan(lat) ** 2
    g = ep * c * c
    n = a / np.sqrt(1 - e2 * s * s)
    r = a * (1 - e2) / (1 - e2 * s * s) ** 1.5
    d = (x - X0) / (n * SCALE)
    north = d**2 / 2 - (5 + 3 * t + 10 * g - 4 * g * g - 9 * ep) * d**4 / 24 + (61 + 90 * t + 298 * g + 45 * t * t - 252 * ep - 3 * g * g) * d**6 / 720
    east = d - (1 + 2 * t + g) * d**3 / 6 + (5 - 2 * g + 28 * t - 3 * g * g + 8 * ep + 24 * t * t) * d**5 / 120
    return LON0 + east / c, lat - n * np.tan(lat) / r * north


def shifted(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bessel to WGS84 by the three-parameter shift of geocentric coordinates."""
    a, f = BESSEL
    e2 = 2 * f - f * f
    n = a / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    x, y, z = n * np.cos(lat) * np.cos(lon) + SHIFT[0], n * np.cos(lat) * np.sin(lon) + SHIFT[1], n * (1 - e2) * np.sin(lat) + SHIFT[2]
    a, f = WGS84
    e2 = 2 * f - f * f
    p = np.hypot(x, y)
    lat = np.arctan2(z, p * (1 - e2))
    for _ in range(5):
        n = a / np.sqrt(1 - e2 * np.sin(lat) ** 2)
        lat = np.arctan2(z + e2 * n * np.sin(lat), p)
    return np.arctan2(y, x), lat


def to_wgs84(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(longitude, latitude) in degrees; nan where the input is missing, under 100,000, or falls outside the country."""
    with np.errstate(all="ignore"):
        lon, lat = (np.degrees(v) for v in shifted(*unproject(x, y)))
        good = (x >= 100_000) & (y >= 100_000) & (lon >= 124) & (lon <= 132.5) & (lat >= 33) & (lat <= 39)
    return np.where(good, lon, np.nan), np.where(good, lat, np.nan)


@F.pandas_udf(T.StructType([T.StructField("lng", T.DoubleType()), T.StructField("lat", T.DoubleType())]))
def katec_to_wgs84(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    lon, lat = to_wgs84(x.to_numpy(float), y.to_numpy(float))
    return pd.DataFrame({"lng": lon, "lat": lat})


def lnglat(x: Column, y: Column, wgs_x: Column, wgs_y: Column) -> Column:
    """Struct lng, lat: the grid first, else the truncated degrees where they are inside the country, else null."""
    p = katec_to_wgs84(x, y)
    inside = wgs_x.between(124, 132) & wgs_y.between(33, 39)
    lng, lat = F.coalesce(p["lng"], F.when(inside, wgs_x)), F.coalesce(p["lat"], F.when(inside, wgs_y))
    return F.when(lng.isNotNull(), F.struct(lng.alias("lng"), lat.alias("lat")))
