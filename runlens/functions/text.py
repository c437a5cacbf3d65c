"""Names, paths and routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def sanitize_segment(value: Column) -> Column:
    """One directory name of the archive."""
    safe = F.translate(
        F.trim(F.coalesce(_filled(value), F.lit("standard")), F.lit(" \t\n\r\f\v")), "\\/", "__"
    )
    return F.coalesce(_filled(safe), F.lit("standard"))


def resolve_route(route_type: Column, config_route: Column | None = None) -> Column:
    options = [_filled(route_type)]
    if config_route is not None:
        options.append(_filled(config_route))
    return F.coalesce(*options, F.lit("standard"))
