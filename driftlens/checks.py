"""Column contracts and size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ColumnContractError(ValueError):
    pass


def require_columns(df: DataFrame, cols, where: str = "input") -> DataFrame:
    """Raise naming the available columns when a required one is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ColumnContractError(
            f"{where}: missing column(s) {missing}; available columns: {df.columns}")
    return df


def broadcast_if_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only after proving the side has at most ``max_rows`` rows.

    The probe reads at most ``max_rows + 1`` rows (a limit, not a count), so it
    stays cheap however large the side turns out to be. Above the bound the
    join is left to the planner (sort-merge, or AQE's runtime broadcast)."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def one_of(col: str, names) -> Column:
    """``col`` itself, failing the job on a value that is not among ``names``: a report
    over a fixed list must not lose the rows of another name."""
    c = F.col(col)
    return F.when(c.isin(list(names)), c).otherwise(F.raise_error(F.concat(
        F.lit(f"{col} outside {list(names)}: "), F.coalesce(c.cast("string"), F.lit("NULL")))))
