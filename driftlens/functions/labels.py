"""First-label extraction from a multi-label cell, as Catalyst expressions.

Contract: a list gives its first element, a scalar gives itself, truncated to a 32-bit
int; empty, missing and unparseable cells give the default label. A cell is cut into a
shape and an atom by whole-string patterns, and the atom's kind decides how it is read:
integers (underscores, hex, octal, binary), decimals and exponents, booleans and quoted
integers. A list counts only if every element is a literal. A trailing comment is not
part of the cell. Digits are ASCII; a string literal with a backslash is not an integer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..constants import (ATOM_PATTERN, COMMENT_PATTERN, DECIMAL_PATTERN, EMPTY_LIST_PATTERN,
                         LIST_LABEL_PATTERN, QUOTED_INTEGER_PATTERN, RADIX_PATTERN,
                         SCALAR_LABEL_PATTERN)
from .text import strip_ws

INT32_MIN, INT32_MAX = -(2 ** 31), 2 ** 31 - 1

# Parse outcomes reported by ``label_parse_report``.
OUTCOMES = ("missing", "blank", "empty_list", "list", "scalar", "fallback")


def _int32(x: Column) -> Column:
    return F.when(x.between(INT32_MIN, INT32_MAX), x).try_cast("int")


def _signed(digits: Column, sign: Column) -> Column:
    return F.when(sign == "-", -digits).otherwise(digits)


def cell_text(raw: Column) -> Column:
    """A cell without surrounding white space and without a trailing comment."""
    return strip_ws(F.regexp_replace(strip_ws(raw), COMMENT_PATTERN, ""))


def cell_atom(s: Column) -> Column:
    """The literal that decides a cell: a list's first element, or the scalar itself;
    NULL if the cell is neither. A scalar may have leading zeros."""
    return (F.when(s.rlike(LIST_LABEL_PATTERN), F.regexp_extract(s, LIST_LABEL_PATTERN, 1))
            .when(s.rlike(SCALAR_LABEL_PATTERN) | s.rlike(ATOM_PATTERN), s))


def atom_value(atom: Column) -> Column:
    """The 32-bit integer of one literal, NULL if it has none."""
    plain = F.replace(atom, F.lit("_"), F.lit(""))
    # towards zero; not-a-number and infinite values fail the range test
    real = plain.try_cast("double")
    cut = F.when(real < 0, F.ceil(real)).otherwise(F.floor(real))
    sign = F.regexp_extract(plain, RADIX_PATTERN, 1)
    base = F.lower(F.regexp_extract(plain, RADIX_PATTERN, 2))
    rest = F.regexp_extract(plain, RADIX_PATTERN, 3)
    radix = F.conv(rest, 16, 10)
    for b, n in (("o", 8), ("b", 2)):
        radix = F.when(base == b, F.conv(rest, n, 10)).otherwise(radix)
    inner = strip_ws(F.substring(plain, F.lit(2), F.length(plain) - 2))
    return (F.when(atom.rlike(SCALAR_LABEL_PATTERN), _int32(plain.try_cast("decimal(38,0)")))
            .when(atom.rlike(DECIMAL_PATTERN), _int32(F.when(real.between(INT32_MIN - 1.0, INT32_MAX + 1.0), cut)))
            .when(atom.rlike(RADIX_PATTERN) & (F.length(rest) <= 15), _int32(_signed(radix.try_cast("decimal(20,0)"), sign)))
            .when(atom == "True", F.lit(1)).when(atom == "False", F.lit(0))
            .when(atom.rlike(QUOTED_INTEGER_PATTERN), _int32(inner.try_cast("decimal(38,0)"))))


def outcome_of(raw: Column, s: Column, value: Column) -> Column:
    """Which branch of the contract a cell takes; ``fallback`` is a cell without a label,
    which gets the default."""
    return (F.when(raw.isNull(), "missing")
             .when(s == "", "blank")
             .when(s.rlike(EMPTY_LIST_PATTERN), "empty_list")
             .when(value.isNull(), "fallback")
             .when(s.startswith("["), "list")
             .otherwise("scalar"))


def _or_default(value: Column, default: int | None) -> Column:
    return F.coalesce(value, F.lit(default).cast("int"))


def first_label(col, dtype=None, default: int | None = 0) -> Column:
    """Expression for the first label of ``col``; ``default=None`` gives NULL instead.

    ``dtype`` is the column's Spark type; pass ``df.schema[name].dataType``.
    """
    raw = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, ArrayType):
        return _or_default(F.get(raw, 0).try_cast("int"), default)
    if isinstance(dtype, IntegerType):
        return _or_default(raw, default)
    return _or_default(atom_value(cell_atom(cell_text(raw.cast("string")))), default)


def parse_outcome(col) -> Column:
    """``outcome_of`` a string cell."""
    raw = (F.col(col) if isinstance(col, str) else col).cast("string")
    s = cell_text(raw)
    return outcome_of(raw, s, atom_value(cell_atom(s)))


def with_parse_steps(df: DataFrame, col: str) -> DataFrame:
    """``df`` with ``_cell``, ``_atom`` and ``_value`` of a string column, one step per
    projection: each step refers to the last one many times, and an expression of all
    three would be too long to compile."""
    out = df.withColumn("_cell", cell_text(F.col(col).cast("string")))
    return out.withColumn("_atom", cell_atom(F.col("_cell"))).withColumn("_value", atom_value(F.col("_atom")))
