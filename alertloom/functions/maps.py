"""Maps made from entries that may repeat a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_entries(entries: Column, key: str) -> Column:
    """The entries without those whose ``key`` comes again later. ``entries`` must be a plain column: it
    is named twice for each element, so that an expression would be worked out that often."""
    return F.filter(entries, lambda e, i: ~F.coalesce(F.exists(
        F.slice(entries, i + 2, F.size(entries)), lambda later: later[key].eqNullSafe(e[key])), F.lit(False)))


def map_of_last(entries: Column, key: str, value: str) -> Column:
    """A map from ``key`` to ``value`` in which later entries replace earlier ones. As one pass: the entries so far
    without the key, then the entry."""
    kind = F.slice(entries, 1, 0)
    kept = F.aggregate(entries, kind, lambda seen, e: F.concat(
        F.filter(seen, lambda old: ~old[key].eqNullSafe(e[key])), F.array(e)))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e[key], e[value])))
