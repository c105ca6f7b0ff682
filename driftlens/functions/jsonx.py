"""JSON helpers for semi-structured ingest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_key(json_col, key: str) -> Column:
    """True when the object has ``key``, also when its value is JSON null
    (``get_json_object`` cannot tell a null value from an absent key)."""
    return F.coalesce(F.array_contains(F.json_object_keys(_col(json_col)), F.lit(key)),
                      F.lit(False))


def project(json_col, ddl: str) -> Column:
    """Fixed-field projection; absent fields become NULL."""
    return F.from_json(_col(json_col), ddl)
