"""SQL fragments shared by the checking queries."""

from __future__ import annotations

from terraflow.functions import geodesy as G


def r(expr: str, digits: int = 6) -> str:
    """Rounded double without a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0::DOUBLE)"


_DMS = r"([+-]?\d+(?:\.\d+)?)\s*°\s*(\d+(?:\.\d+)?)?\s*[''′]?\s*(\d+(?:\.\d+)?)?\s*[\"″]?\s*([NSEW])?"


def dms(col: str) -> str:
    def part(i: int) -> str:
        return f"regexp_extract({col}, '{_DMS}', {i}, 'i')"

    value = (
        f"(TRY_CAST({part(1)} AS DOUBLE) + coalesce(TRY_CAST({part(2)} AS DOUBLE), 0) / 60"
        f" + coalesce(TRY_CAST({part(3)} AS DOUBLE), 0) / 3600)"
    )
    return f"(CASE WHEN upper({part(4)}) IN ('S', 'W') THEN -{value} ELSE {value} END)"


DAMS_AT = f"SELECT pos, {dms('longitude')} AS lon, {dms('latitude')} AS lat FROM dams_raw"


def utm_zone(lon: str) -> str:
    return f"CASE WHEN {lon} IS NOT NULL THEN greatest(1, least(60, CAST(floor(({lon} + 180.0) / 6.0) AS INT) + 1)) END"


def utm_epsg(lon: str, lat: str) -> str:
    return f"({utm_zone(lon)} + CASE WHEN {lat} >= 0 THEN 32600 WHEN {lat} < 0 THEN 32700 END)"


def _sum(terms: list[str]) -> str:
    return " + ".join(terms)


def utm_forward_ctes(src: str, lon: str = "lon", lat: str = "lat") -> str:
    """CTEs ``{src}_fwd``: adds easting, northing to ``src`` (needs epsg)."""
    e = repr(G.ECCENTRICITY)
    k = repr(G.SCALE_ON_MERIDIAN * G.RECTIFYING_RADIUS)
    east = _sum([f"{a!r}::DOUBLE * cos({2*j} * xi) * sinh({2*j} * eta)" for j, a in enumerate(G.ALPHA, 1)])
    north = _sum([f"{a!r}::DOUBLE * sin({2*j} * xi) * cosh({2*j} * eta)" for j, a in enumerate(G.ALPHA, 1)])
    return f"""
{src}_f1 AS (SELECT *, radians({lon}) - radians(((epsg % 100) * 6 - 183)::DOUBLE) AS lam,
   sinh(atanh(sin(radians({lat}))) - {e}::DOUBLE * atanh({e}::DOUBLE * sin(radians({lat})))) AS tt FROM {src}),
{src}_f2 AS (SELECT *, atan2(tt, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + tt * tt)) AS eta FROM {src}_f1),
{src}_fwd AS (SELECT *, (eta + {east}) * {k}::DOUBLE + 500000 AS easting,
   (xi + {north}) * {k}::DOUBLE + CASE WHEN epsg >= 32700 THEN 10000000 ELSE 0 END AS northing FROM {src}_f2)"""


def utm_inverse_ctes(src: str, easting: str = "easting", northing: str = "northing") -> str:
    """CTEs ``{src}_inv``: adds lon, lat to ``src`` (needs epsg)."""
    k = repr(G.SCALE_ON_MERIDIAN * G.RECTIFYING_RADIUS)
    xi1 = _sum([f"{b!r}::DOUBLE * sin({2*j} * xi) * cosh({2*j} * eta)" for j, b in enumerate(G.BETA, 1)])
    eta1 = _sum([f"{b!r}::DOUBLE * cos({2*j} * xi) * sinh({2*j} * eta)" for j, b in enumerate(G.BETA, 1)])
    phi = _sum([f"{d!r}::DOUBLE * sin({2*j} * chi)" for j, d in enumerate(G.DELTA, 1)])
    return f"""
{src}_i1 AS (SELECT *, ({northing} - CASE WHEN epsg >= 32700 THEN 10000000 ELSE 0 END) / {k}::DOUBLE AS xi,
   ({easting} - 500000) / {k}::DOUBLE AS eta FROM {src}),
{src}_i2 AS (SELECT *, xi - ({xi1}) AS xi1, eta - ({eta1}) AS eta1 FROM {src}_i1),
{src}_i3 AS (SELECT *, asin(sin(xi1) / cosh(eta1)) AS chi FROM {src}_i2),
{src}_inv AS (SELECT *, degrees(atan2(sinh(eta1), cos(xi1)) + radians(((epsg % 100) * 6 - 183)::DOUBLE)) AS lon,
   degrees(chi + {phi}) AS lat FROM {src}_i3)"""


def slug(col: str) -> str:
    step = f"regexp_replace(lower(trim({col})), '[^a-z0-9_-]+', '_', 'g')"
    step = f"trim(regexp_replace({step}, '[_-]{{2,}}', '_', 'g'), '_')"
    return f"nullif({step}, '')"
