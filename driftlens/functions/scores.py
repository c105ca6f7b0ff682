"""Softmax, max-probability and argmax over a logits array column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(logits) -> Column:
    """Numerically stable softmax: exp(x - max) / sum(exp(x - max))."""
    z = _col(logits)
    m = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def argmax(values) -> Column:
    """0-based index of the first maximum (ties go to the lowest index)."""
    z = _col(values)
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def max_prob(logits) -> Column:
    """Largest softmax probability: ``1 / sum(exp(x - max))``, without the probabilities."""
    z = _col(logits)
    m = F.array_max(z)
    return F.lit(1.0) / F.aggregate(z, F.lit(0.0).cast("double"), lambda acc, x: acc + F.exp(x - m))


def with_prediction(df, logits: str = "logits", label_col: str = "pred_label",
                    conf_col: str = "pred_confidence"):
    """Append ``pred_label`` and ``pred_confidence``; keeps every input column."""
    return df.withColumns({label_col: argmax(logits), conf_col: max_prob(logits)})
