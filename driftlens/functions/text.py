"""String helpers: Python-compatible strip and title/body composition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import WHITESPACE


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Strip the Python whitespace set from both ends (bare ``trim`` only
    removes spaces)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def compose(first, second, sep: str = " ") -> Column:
    """``(first or "") + sep + (second or "")`` stripped."""
    return strip_ws(F.concat(F.coalesce(_col(first), F.lit("")), F.lit(sep),
                             F.coalesce(_col(second), F.lit(""))))


def fill_text(c) -> Column:
    """Missing text becomes the empty string (inference keeps every row)."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def na_to_null(c, tokens) -> Column:
    """CSV-style NA recognition: exact NA tokens become NULL."""
    col = _col(c)
    return F.when(col.isin(list(tokens)), F.lit(None).cast("string")).otherwise(col)
