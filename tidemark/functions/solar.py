"""Solar position as column expressions of a UTC timestamp (NOAA's low-accuracy series)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.binding import let

#: The site.
LATITUDE, LONGITUDE = 51.5, 10.0
#: Coefficients of the equation of time (minutes) and of the declination (radians) at 1, cos g, sin g,
#: cos 2g, sin 2g, cos 3g, sin 3g.
EQUATION = (0.000075, 0.001868, -0.032077, -0.014615, -0.040849)
DECLINATION = (0.006918, -0.399912, 0.070257, -0.006758, 0.000907, -0.002697, 0.00148)
#: The last coefficient of the equation of time that sunrise and sunset use.
EQUATION_RISE = (*EQUATION[:4], -0.04089)
ZENITH_RISE = 90.833


def series(angle: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for i, c in enumerate(coefficients[1:]):
        wave = angle * (i // 2 + 1)
        out = out + F.lit(c) * (F.cos(wave) if i % 2 == 0 else F.sin(wave))
    return out


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def _position(utc: Column, latitude: float, longitude: float, body) -> Column:
    """body(hour angle, declination, zenith), each of them computed once."""
    hour = F.hour(utc) + F.minute(utc) / 60 + F.floor(F.second(utc)) / 3600
    lat = math.radians(latitude)

    def of_angles(x: Column) -> Column:
        angle, decl = x["angle"], x["decl"]
        cosine = F.lit(math.sin(lat)) * F.sin(decl) + F.lit(math.cos(lat)) * F.cos(decl) * F.cos(angle)
        return let(F.acos(_clamp(cosine)), lambda zenith: body(angle, decl, zenith))

    def of_hour(x: Column) -> Column:
        angle = F.radians((x["hour"] * 60 + F.lit(229.18) * series(x["g"], EQUATION) + 4 * longitude) / 4 - 180)
        return let(F.struct(angle.alias("angle"), series(x["g"], DECLINATION).alias("decl")), of_angles)

    g = lambda h: F.lit(2 * math.pi / 365) * (F.dayofyear(utc) - 1 + (h - 12) / 24)
    return let(hour, lambda h: let(F.struct(h.alias("hour"), g(h).alias("g")), of_hour))


def elevation(utc: Column, latitude: float = LATITUDE, longitude: float = LONGITUDE) -> Column:
    return _position(utc, latitude, longitude, lambda angle, decl, zenith: 90 - F.degrees(zenith))


def azimuth(utc: Column, latitude: float = LATITUDE, longitude: float = LONGITUDE) -> Column:
    """Degrees from north; 180 where the sun stands in the zenith or the nadir."""
    lat = math.radians(latitude)

    def of_zenith(angle: Column, decl: Column, zenith: Column) -> Column:
        bearing = F.degrees(F.acos(_clamp(-(F.lit(math.sin(lat)) * F.cos(zenith) - F.sin(decl)) / (F.lit(math.cos(lat)) * F.sin(zenith)))))
        return F.when(F.abs(F.sin(zenith)) < 1e-6, 180.0).when(angle > 0, 360 - bearing).otherwise(bearing)

    return _position(utc, latitude, longitude, of_zenith)


def sun_minutes(day_of_year: Column, sunset: bool, latitude: float = LATITUDE, longitude: float = LONGITUDE) -> Column:
    """Minutes after midnight UTC, truncated; polar night -1, polar day 0 for the rise and 1440 for the set."""
    b = F.lit(2 * math.pi) * (day_of_year - 1) / 365
    decl = series(b, DECLINATION)
    lat = math.radians(latitude)
    cosine = (F.lit(math.cos(math.radians(ZENITH_RISE))) - F.lit(math.sin(lat)) * F.sin(decl)) / (F.lit(math.cos(lat)) * F.cos(decl))
    half = 4 * F.degrees(F.acos(_clamp(cosine)))
    noon = 720 - 4 * longitude - F.lit(229.18) * series(b, EQUATION_RISE)
    return F.when(cosine > 1, -1).when(cosine < -1, 1440 if sunset else 0).otherwise((noon + half if sunset else noon - half).cast("int"))


def next_wake(now: Column, cycle_minutes: int, after_sunset: int = 30) -> Column:
    """The epoch second of the next wake: now and a cycle, if that is from sunrise until `after_sunset` minutes after
    sunset; else the coming sunrise. `now` is in epoch seconds."""
    due = now + cycle_minutes * 60
    midnight = F.floor(due / 86400) * 86400
    minute = F.floor((due - midnight) / 60)
    day = lambda s: F.dayofyear(F.timestamp_seconds(s))
    rise = lambda s: F.greatest(sun_minutes(day(s), False), F.lit(0))
    end = F.least(sun_minutes(day(due), True), F.lit(1440)) + after_sunset
    return F.when((minute >= rise(due)) & (minute < end), due).when(minute >= end, midnight + 86400 + rise(midnight + 86400) * 60).otherwise(midnight + rise(due) * 60)


def schedule(days: DataFrame, day: str, cycle_minutes: int, after_sunset: int = 30) -> DataFrame:
    """`days` (with an epoch second of each day's midnight in UTC) with wake: all wakes of a device that runs by `next_wake`
    without a break, from each sunrise a cycle apart until `after_sunset` minutes after sunset. A day's wakes follow from
    the day alone, so a schedule of any length is one expression a day; a day without sun has one wake, at midnight."""
    of = lambda s: F.dayofyear(F.timestamp_seconds(s))
    rise = F.greatest(sun_minutes(of(F.col(day)), False), F.lit(0)) * 60
    last = F.least(sun_minutes(of(F.col(day)), True), F.lit(1440)) * 60 + after_sunset * 60
    start, end = (F.col(day) + rise).cast("long"), (F.col(day) + F.least(last, F.lit(86400))).cast("long")
    wakes = F.when(end > start, F.sequence(start, end - 1, F.lit(cycle_minutes * 60).cast("long"))).otherwise(F.array(start))
    return days.select("*", F.explode(wakes).alias("wake"))
