"""Great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Earth radius in metres, metres to nautical miles.
EARTH_RADIUS_M = 6378137
METRE_TO_NMI = 0.000539956803


def distance_nm(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance in nautical miles; null if any coordinate is null."""
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    half_dphi = F.radians(lat2 - lat1) / 2
    half_dlam = F.radians(lon2 - lon1) / 2
    sin_phi, sin_lam = F.sin(half_dphi), F.sin(half_dlam)
    chord = sin_phi * sin_phi + F.cos(phi1) * F.cos(phi2) * sin_lam * sin_lam
    # least() skips nulls, so clamp with when() to keep a null coordinate null
    chord = F.when(chord > 1, F.lit(1.0)).otherwise(chord)
    return F.asin(F.sqrt(chord)) * (2 * EARTH_RADIUS_M) * METRE_TO_NMI
