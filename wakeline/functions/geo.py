"""Column functions on positions and times."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: Fixed values of the WGS84 ellipsoid: half of the greater axis and the flattening.
WGS84_A_KM, WGS84_F = 6378.137, 1 / 298.257223563


def geo_distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null where a coordinate is null."""
    a = F.sin(F.radians(lat2 - lat1) / 2)
    b = F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    # least() would take 1 for null
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)`, with `value` computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def meridian_km(latitude: Column) -> Column:
    """Length of the meridian from the equator to a latitude, by the series in the third flattening."""
    n = WGS84_F / (2 - WGS84_F)
    x = F.radians(latitude)
    terms = ((0, 1 + n**2 / 4 + n**4 / 64), (2, -3 / 2 * (n - n**3 / 8)), (4, 15 / 16 * (n**2 - n**4 / 4)), (6, -35 / 48 * n**3), (8, 315 / 512 * n**4))
    total = sum((F.sin(k * x) * c for k, c in terms[1:]), x * terms[0][1])
    return total * (WGS84_A_KM / (1 + n))


def geodesic_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rounds: int = 40) -> Column:
    """Distance on the WGS84 ellipsoid by the inverse iteration on the longitude of the auxiliary sphere; null where a coordinate is null.

    Good to less than a millimetre where the iteration settles. It does not for
    points that are nearly antipodal: these get the shorter way along their
    meridians over a pole, which is the exact one for opposite meridians and
    never less than the true distance.
    """
    f, b = WGS84_F, WGS84_A_KM * (1 - WGS84_F)
    step = F.pmod(lon2 - lon1 + 540, F.lit(360.0)) - 180
    u = [F.atan((1 - f) * F.tan(F.radians(x))) for x in (lat1, lat2)]
    over_pole = lambda sign: meridian_km(F.lit(90.0)) * 2 - sign * (meridian_km(lat1) + meridian_km(lat2))
    far = F.least(over_pole(1), over_pole(-1))
    ends = F.struct(F.sin(u[0]).alias("s1"), F.cos(u[0]).alias("c1"), F.sin(u[1]).alias("s2"), F.cos(u[1]).alias("c2"), F.radians(step).alias("l"))

    def arcs(e: Column, turn: Column, body: Callable[[Column], Column]) -> Column:
        """What a longitude on the auxiliary sphere means: sigma, the azimuth at the equator and the middle of the arc."""
        first = F.struct((e["c2"] * F.sin(turn)).alias("x"), (e["c1"] * e["s2"] - e["s1"] * e["c2"] * F.cos(turn)).alias("y"), (e["s1"] * e["s2"] + e["c1"] * e["c2"] * F.cos(turn)).alias("cos"))
        second = lambda a: F.struct(F.sqrt(a["x"] * a["x"] + a["y"] * a["y"]).alias("sin"), a["cos"].alias("cos"), a["x"].alias("x"))
        third = lambda a: F.struct(a["sin"].alias("sin"), a["cos"].alias("cos"), F.atan2(a["sin"], a["cos"]).alias("sigma"), F.when(a["sin"] > 0, e["c1"] * a["x"] / a["sin"]).otherwise(0.0).alias("azimuth"))
        middle = lambda a: F.when(1 - a["azimuth"] * a["azimuth"] > 1e-14, a["cos"] - 2 * e["s1"] * e["s2"] / (1 - a["azimuth"] * a["azimuth"])).otherwise(0.0)
        fourth = lambda a: F.struct(a["sin"].alias("sin"), a["cos"].alias("cos"), a["sigma"].alias("sigma"), a["azimuth"].alias("azimuth"), (1 - a["azimuth"] * a["azimuth"]).alias("up"), middle(a).alias("mid"))
        return let(first, lambda a: let(second(a), lambda a: let(third(a), lambda a: let(fourth(a), body))))

    def turned(e: Column, state: Column) -> Column:
        """The next longitude, and how far it lies from the last one."""

        def body(a: Column) -> Column:
            c = f / 16 * a["up"] * (4 + f * (4 - 3 * a["up"]))
            return e["l"] + (1 - c) * f * a["azimuth"] * (a["sigma"] + c * a["sin"] * (a["mid"] + c * a["cos"] * (2 * a["mid"] * a["mid"] - 1)))

        after = arcs(e, state["turn"], body)
        moved = let(after, lambda t: F.struct(t.alias("turn"), F.abs(t - state["turn"]).alias("moved")))
        return F.when(state["moved"] > 1e-12, moved).otherwise(state)

    def length(a: Column) -> Column:
        def series(v: Column) -> Column:
            big = 1 + v / 16384 * (4096 + v * (v * (320 - 175 * v) - 768))
            small = v / 1024 * (256 + v * (v * (74 - 47 * v) - 128))
            m, sin = a["mid"], a["sin"]
            return let(small, lambda q: b * big * (a["sigma"] - q * sin * (m + q / 4 * (a["cos"] * (2 * m * m - 1) - q / 6 * m * (4 * sin * sin - 3) * (4 * m * m - 3)))))

        return let(a["up"] * (1 / (1 - f) ** 2 - 1), series)

    def solved(e: Column) -> Column:
        start = F.struct(e["l"].alias("turn"), F.lit(1.0).alias("moved"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda state, _: turned(e, state))
        settled = lambda s: (s["moved"] <= 1e-12) & (F.abs(s["turn"]) <= math.pi)
        return let(end, lambda s: F.when(settled(s), arcs(e, s["turn"], length)))

    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return F.when(known, F.coalesce(let(ends, solved), far))


def wkt_point(longitude: Column, latitude: Column) -> Column:
    """`POINT(lon lat)`; null if a coordinate is null."""
    return F.concat(F.lit("POINT("), longitude.cast("string"), F.lit(" "), latitude.cast("string"), F.lit(")"))


def ocean_side(lon1: Column, lon2: Column) -> Column:
    """`pacific` where the shorter way crosses the 180th meridian (or both are as long), else `atlantic`."""
    d = F.abs(lon1 - lon2)
    return F.when(d < 360 - d, "atlantic").when(d.isNotNull(), "pacific")


def band_height(radius_km: float) -> float:
    """Height in degrees of a latitude band no lower than the radius."""
    return radius_km / (EARTH_KM * math.pi / 180) * 1.001


def band_of(latitude: Column, height: float) -> Column:
    return F.floor((latitude + 90) / height).cast("int")


def cells_in(band: Column, height: float) -> Column:
    """Number of longitude cells in a band: about as wide as high where the band is widest."""
    low, high = band * height - 90, (band + 1) * height - 90
    nearest = F.when((low <= 0) & (high >= 0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(high)))
    return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(F.least(nearest, F.lit(90.0)))) / height)).cast("int")


def cell_of(longitude: Column, n_cells: Column) -> Column:
    return F.pmod(F.floor(F.pmod(longitude + 180, F.lit(360.0)) / 360 * n_cells).cast("int"), n_cells)


def snapshot_id(ts: Column, prefix: str = "lvi_prm_") -> Column:
    """Name of the half-hourly snapshot that a time falls into."""
    return F.concat(F.lit(prefix), F.date_format(ts, "yyyyMMddHH"), F.when(F.minute(ts) < 30, "10").otherwise("40"), F.lit("00"))


def months_between(date_from: Column, date_to: Column) -> Column:
    """Array of `yyyyMM` from one date's month to the other's, both included; empty if they are out of order."""
    first, last = F.trunc(date_from, "MM"), F.trunc(date_to, "MM")
    months = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month"))).when(first > last, F.array().cast("array<date>"))
    return F.transform(months, lambda d: F.date_format(d, "yyyyMM"))
