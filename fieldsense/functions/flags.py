"""Per-destination sync flags kept in a ``map<string,boolean>`` column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SYNC_MAP


def empty_flags() -> Column:
    """A typed empty flag map (a bare ``map()`` does not resolve its types)."""
    return F.create_map().cast(SYNC_MAP)


def set_flag(flags: Column, dest: str, value) -> Column:
    """Set ``flags[dest] = value``. ``map_concat`` refuses a duplicate key, so
    the key is filtered out first. A NULL map is treated as empty."""
    base = F.map_filter(F.coalesce(flags, empty_flags()), lambda k, v: k != F.lit(dest))
    val = value if isinstance(value, Column) else F.lit(value)
    return F.map_concat(base, F.create_map(F.lit(dest), val.cast("boolean")))


def drop_flag(flags: Column, dest: str) -> Column:
    """Remove ``dest`` from the map (``jsonb - 'cloud'``); NULL stays NULL."""
    return F.map_filter(flags, lambda k, v: k != F.lit(dest))


def is_pending(flags: Column, dest: str) -> Column:
    """Row still to be sent to ``dest``: flag absent, NULL or false."""
    return ~F.coalesce(flags.getItem(dest), F.lit(False))
