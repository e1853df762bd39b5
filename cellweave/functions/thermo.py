"""Moist air and wind as Column expressions; null in, null out. Temperatures in K, pressures in hPa unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gas constants, their ratio, specific heats, Bolton's coefficients.
R_DRY, R_VAPOUR, CP, POISSON, GRAVITY, ZERO = 287.04, 461.5, 1005.0, 2 / 7, 9.81, 273.15
EPS = R_DRY / R_VAPOUR
A, B, C = 6.112, 17.67, 243.5


def saturation_pressure(t: Column) -> Column:
    """Bolton (1980), hPa."""
    c = t - ZERO
    return A * F.exp(B * c / (c + C))


def saturation_mixing_ratio(t: Column, p: Column) -> Column:
    es = saturation_pressure(t)
    return 0.622 * es / (p - es)


def pressure_from_mixing_ratio(w: Column, p: Column) -> Column:
    return w * p / (EPS + w)


def pressure_from_specific_humidity(q: Column, p: Column | float = 101325.0) -> Column:
    return q * p / (q * (1 - EPS) + EPS)


def dew_point_celsius(e: Column) -> Column:
    """From vapour pressure in Pa."""
    x = F.log(e / (100 * A))
    return C * x / (B - x)


def specific_from_relative(rh: Column, t: Column, p: Column | float = 1013.25) -> Column:
    """rh as a fraction."""
    e = rh * saturation_pressure(t)
    return EPS * e / (p - e * (1 - EPS))


def relative_from_specific(q: Column, t: Column, p: Column | float = 1013.25) -> Column:
    """A fraction, kept within 0 and 1."""
    share = pressure_from_specific_humidity(q, p) / saturation_pressure(t)
    return F.when(share.isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def specific_from_dew_point(td: Column, p: Column) -> Column:
    e = saturation_pressure(td)
    return EPS * e / (p - 0.378 * e)


def dew_point_from_specific(q: Column, p: Column) -> Column:
    """p in Pa; K."""
    return dew_point_celsius(pressure_from_specific_humidity(q, p)) + ZERO


def vapour_deficit(rh: Column, t: Column) -> Column:
    """rh in percent."""
    return (100 - rh) / 100 * saturation_pressure(t)


def condensation_temperature(t: Column, td: Column) -> Column:
    return 56 + 1 / (1 / (td - 56) + F.log(t / td) / 800)


def _at_condensation(t: Column, p: Column, q: Column) -> Column:
    return t * F.pow(1000 / p, 0.2854 * (1 - 0.28 * q))


def equivalent_potential(t: Column, td: Column, p: Column, q: Column) -> Column:
    """After Bolton (1980), with the mixing ratio of saturated air at the air's temperature; K. q: specific humidity."""
    w, tl = saturation_mixing_ratio(t, p), condensation_temperature(t, td)
    return _at_condensation(t, p, q) * F.pow(t / tl, 0.28 * w) * F.exp(w * (1 + 0.448 * w) * (3036 / tl - 1.78))


def pseudo_equivalent_potential(t: Column, td: Column, p: Column, q: Column) -> Column:
    """After Bolton (1980), with the specific humidity q in place of the mixing ratio; K."""
    return _at_condensation(t, p, q) * F.exp(q * (1 + 0.81 * q) * (3376 / condensation_temperature(t, td) - 2.54))


def virtual_potential(t: Column, q: Column, p: Column | float) -> Column:
    return (1 + 0.61 * q) * t * F.pow(F.lit(1000.0) / p, 287 / CP)


def wind_parts(speed: Column, direction: Column, degrees: bool = True) -> tuple[Column, Column]:
    """Eastward and northward wind from where it blows from."""
    a = F.radians(direction) if degrees else direction
    return -speed * F.sin(a), -speed * F.cos(a)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column) -> Column:
    """Degrees, not brought into 0 to 360."""
    return 270 - F.atan2(v, u) * (180 / math.pi)


def brunt_vaisala_squared(lower_theta_v: Column, upper_theta_v: Column, lower_geopotential: Column, upper_geopotential: Column) -> Column:
    """g times the growth of log virtual potential temperature with height between two levels."""
    dz = (upper_geopotential - lower_geopotential) / GRAVITY
    return GRAVITY * (F.log(upper_theta_v) - F.log(lower_theta_v)) / F.nullif(dz, F.lit(0.0))
