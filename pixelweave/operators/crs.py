"""Coordinates from one reference system to another: degrees (EPSG 4326) and the UTM zones (EPSG 326xx and 327xx).

The transverse Mercator projection by the series in the third flattening to its fourth power, good to some micrometres, which holds well beyond a zone's border, so
that points near it can be brought to the neighbouring zone. Latitudes come back by iteration-free series too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84 and UTM, fixed values
AXIS, FLATTENING, SCALE, EAST, NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
THIRD = FLATTENING / (2 - FLATTENING)
RADIUS = AXIS / (1 + THIRD) * (1 + THIRD**2 / 4 + THIRD**4 / 64)
# coefficients of the series to the fourth power, fixed values
FORWARD = (
    THIRD / 2 - 2 * THIRD**2 / 3 + 5 * THIRD**3 / 16 + 41 * THIRD**4 / 180, 13 * THIRD**2 / 48 - 3 * THIRD**3 / 5 + 557 * THIRD**4 / 1440,
    61 * THIRD**3 / 240 - 103 * THIRD**4 / 140, 49561 * THIRD**4 / 161280,
)
INVERSE = (
    THIRD / 2 - 2 * THIRD**2 / 3 + 37 * THIRD**3 / 96 - THIRD**4 / 360, THIRD**2 / 48 + THIRD**3 / 15 - 437 * THIRD**4 / 1440,
    17 * THIRD**3 / 480 - 37 * THIRD**4 / 840, 4397 * THIRD**4 / 161280,
)
LATITUDE = (
    2 * THIRD - 2 * THIRD**2 / 3 - 2 * THIRD**3 + 116 * THIRD**4 / 45, 7 * THIRD**2 / 3 - 8 * THIRD**3 / 5 - 227 * THIRD**4 / 45,
    56 * THIRD**3 / 15 - 136 * THIRD**4 / 35, 4279 * THIRD**4 / 630,
)


def central(epsg: Column) -> Column:
    """Longitude of a zone's central meridian, in degrees."""
    return (epsg % 100) * 6.0 - 183


def is_south(epsg: Column) -> Column:
    return F.floor(epsg / 100) == 327


def reproject(df: DataFrame, x: str, y: str, source: Column, target: Column, out: tuple[str, str]) -> DataFrame:
    """df with columns `out`: the position (x, y) of EPSG `source` in EPSG `target`, each 4326 (longitude, latitude) or a UTM zone.

    Positions need not lie in their zone. The same system gives the position back as it is. Each step is a column of
    its own, so that no expression is worked out twice.
    """
    name = lambda n: "_".join([n, *df.columns, *out])
    src, dst, xi, eta, a, b, chi, lon, lat, t, away = (name(n) for n in ("src", "dst", "xi", "eta", "a", "b", "chi", "lon", "lat", "t", "away"))
    c = F.col
    south = lambda epsg: F.when(is_south(c(epsg)), NORTH).otherwise(0.0)
    series = lambda first, terms, f: sum((k * f(2 * j) for j, k in enumerate(terms, 1)), first)
    # to degrees
    d = df.withColumns({src: source, dst: target}).withColumns({xi: (c(y) - south(src)) / (SCALE * RADIUS), eta: (c(x) - EAST) / (SCALE * RADIUS)})
    d = d.withColumns({
        a: series(c(xi), [-k for k in INVERSE], lambda j: F.sin(j * c(xi)) * F.cosh(j * c(eta))),
        b: series(c(eta), [-k for k in INVERSE], lambda j: F.cos(j * c(xi)) * F.sinh(j * c(eta))),
    })
    d = d.withColumn(chi, F.asin(F.sin(c(a)) / F.cosh(c(b))))
    plain = c(src) == 4326
    d = d.withColumns({
        lon: F.when(plain, c(x)).otherwise(central(c(src)) + F.degrees(F.atan2(F.sinh(c(b)), F.cos(c(a))))),
        lat: F.when(plain, c(y)).otherwise(F.degrees(series(c(chi), LATITUDE, lambda j: F.sin(j * c(chi))))),
    }).drop(xi, eta, a, b, chi)
    # and from there
    k = 2 * math.sqrt(THIRD) / (1 + THIRD)
    d = d.withColumn(t, F.sin(F.radians(c(lat)))).withColumn(t, F.sinh(F.atanh(c(t)) - k * F.atanh(k * c(t)))).withColumn(away, F.radians(c(lon) - central(c(dst))))
    d = d.withColumns({xi: F.atan2(c(t), F.cos(c(away))), eta: F.atanh(F.sin(c(away)) / F.sqrt(1 + c(t) * c(t)))})
    east = EAST + SCALE * RADIUS * series(c(eta), FORWARD, lambda j: F.cos(j * c(xi)) * F.sinh(j * c(eta)))
    north = south(dst) + SCALE * RADIUS * series(c(xi), FORWARD, lambda j: F.sin(j * c(xi)) * F.cosh(j * c(eta)))
    same, degrees = c(src) == c(dst), c(dst) == 4326
    told = {name("east"): F.when(same, c(x)).when(degrees, c(lon)).otherwise(east), name("north"): F.when(same, c(y)).when(degrees, c(lat)).otherwise(north)}
    return d.withColumns(told).select(*[f for f in df.columns if f not in out], *[c(n).alias(o) for n, o in zip(told, out, strict=True)])


def utm_sql(lon: str, lat: str, zone: str, south: str) -> tuple[str, str]:
    """Easting and northing of degrees in a zone, as SQL of the same series."""
    n = THIRD
    k = 2 * math.sqrt(n) / (1 + n)
    s, away = f"sin(radians({lat}))", f"radians({lon} - ({zone} * 6.0 - 183))"
    t = f"sinh(atanh({s}) - {k!r}::DOUBLE * atanh({k!r}::DOUBLE * {s}))"
    xi, eta = f"atan2({t}, cos({away}))", f"atanh(sin({away}) / sqrt(1 + ({t}) * ({t})))"
    size = SCALE * RADIUS
    east = "(" + eta + "".join(f" + {a!r}::DOUBLE * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(FORWARD, 1)) + ")"
    north = "(" + xi + "".join(f" + {a!r}::DOUBLE * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(FORWARD, 1)) + ")"
    return f"{EAST} + {size!r}::DOUBLE * {east}", f"CASE WHEN {south} THEN {NORTH} ELSE 0 END + {size!r}::DOUBLE * {north}"
