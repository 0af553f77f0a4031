"""Distances and projections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6371000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return 2 * RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def to_metres(lat: Column, lon: Column, ref_lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * RADIUS_M * F.cos(F.radians(ref_lat)), F.radians(lat) * RADIUS_M


def to_degrees(x: Column, y: Column, ref_lat: Column) -> tuple[Column, Column]:
    return F.degrees(y / RADIUS_M), F.degrees(x / (RADIUS_M * F.cos(F.radians(ref_lat))))


def seconds(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")) / 1e6
