"""Exact stratified train/validation split.

Validation size is ``ceil(frac * n)``; each class gets its proportional
share, floored, and the rows left over go to the classes with the largest
remainders (ties by label). Within a class, rows are ordered by a seeded
md5 hash of the row id, and the first ``quota`` rows are validation.

Skew: a class may hold a large share of all rows, so rows are never ranked
per class. Instead a per-class histogram over the top hash bits (partially
aggregated) locates the bucket holding each class's cut point, and only the
rows of that one boundary bucket per class are ranked to find the exact cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SEED, VAL_FRACTION
from ..session import cut_lineage, write_scratch

HASH_BITS = 60
BUCKET_BITS = 16
MAX_CLASSES = 100_000


def split_hash(id_col: str, seed: int = SEED) -> Column:
    """60-bit hash: the first 15 hex digits of md5("seed:id")."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def class_quotas(counts: DataFrame, label: str, frac: float = VAL_FRACTION,
                 allow_singletons: bool = False) -> DataFrame:
    """Per class: ``n_c`` and validation quota ``q`` (largest remainder).

    ``counts`` has one row per class; the windows below run on it alone. Fewer
    validation rows than classes fail the job, as does a class of one row (unless
    ``allow_singletons``): such a split could not hold every class."""
    n = F.sum("n_c").over(Window.partitionBy())
    base_df = (counts.withColumn("_n", n)
                     .withColumn("_nval", F.ceil(F.lit(float(frac)) * F.col("_n")).cast("long")))
    # Exact integer arithmetic: the product can pass 2**63 at very large n.
    prod = F.col("_nval").cast("decimal(38,0)") * F.col("n_c").cast("decimal(38,0)")
    base_df = (base_df.withColumn("_prod", prod)
                      .withColumn("_base", F.expr("_prod div _n").cast("long"))
                      .withColumn("_rem", F.expr("_prod - (_prod div _n) * _n")))
    leftover = F.col("_nval") - F.sum("_base").over(Window.partitionBy())
    order = Window.orderBy(F.desc("_rem"), F.asc(label))
    q = F.col("_base") + (F.row_number().over(order) <= leftover).cast("long")
    classes = F.count(F.lit(1)).over(Window.partitionBy())
    out = base_df.withColumn("q", q)
    if not allow_singletons:
        out = out.withColumn("q", F.when(F.col("_nval") < classes, F.raise_error(F.concat(
            F.lit("fewer validation rows than classes: "), F.col("_nval").cast("string"), F.lit(" < "),
            classes.cast("string")))).otherwise(F.col("q")))
    if allow_singletons:
        out = out.withColumn("q", F.when(F.col("n_c") < 2, F.lit(0).cast("long")).otherwise(F.col("q")))
    else:
        out = out.withColumn("q", F.when(
            F.col("n_c") < 2,
            F.raise_error(F.concat(F.lit("class has fewer than 2 rows: "),
                                   F.col(label).cast("string")))).otherwise(F.col("q")))
    return out.select(label, "n_c", "q")


@dataclass
class SplitPlan:
    """Where each class is cut, and its quota; both tables have a row per class."""
    cuts: DataFrame      # label, _ch, _cid: hash and id of the last validation row
    quotas: DataFrame    # label, n_c, q
    label: str
    id_col: str
    seed: int

    def assign(self, df: DataFrame, out: str = "split") -> DataFrame:
        """``df`` plus ``out`` in {'train', 'val'}: a map-side comparison of each row with
        its class's cut. A class with a zero quota has no cut and is all training."""
        h = split_hash(self.id_col, self.seed)
        is_val = F.coalesce((h < F.col("_ch")) | ((h == F.col("_ch")) & (F.col(self.id_col) <= F.col("_cid"))),
                            F.lit(False))
        return (df.join(self.cuts, self.label, "left")
                  .withColumn(out, F.when(is_val, F.lit("val")).otherwise(F.lit("train")))
                  .select(*df.columns, out))

    def train_docs(self, max_classes: int) -> dict:
        """Training rows per class, from the quotas: no pass over the rows. Raises above
        ``max_classes``, which bounds what reaches the driver."""
        rows = self.quotas.select(self.label, (F.col("n_c") - F.col("q")).alias("n")).limit(max_classes + 1).collect()
        if len(rows) > max_classes:
            raise ValueError(f"more than {max_classes} classes in {self.label!r}")
        return {r[0]: r[1] for r in rows if r[1]}


def plan_split(df: DataFrame, label: str = "gold", id_col: str = "row_id", frac: float = VAL_FRACTION,
               seed: int = SEED, allow_singletons: bool = False) -> SplitPlan:
    """Find each class's cut.

    One pass over the rows writes the key table (label, id, hash); what follows reads
    that table. (1) A histogram of (class, hash bucket), written once, gives the class
    sizes, the quotas and each class's boundary bucket; (2) the rows of the boundary
    buckets (about ``n_c / 65536`` of a class) are ranked to give the exact cut
    ``(hash, id)``. Boundary and cut tables have at most one row per class; they are
    broadcast only after their row count is checked."""
    shift = HASH_BITS - BUCKET_BITS
    keys = write_scratch(df.select(label, id_col).withColumn("_h", split_hash(id_col, seed)))
    keys = keys.withColumn("_b", F.shiftright(F.col("_h"), shift))
    hist = write_scratch(keys.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("cnt")))
    counts = hist.groupBy(label).agg(F.sum("cnt").alias("n_c"))
    quotas = cut_lineage(class_quotas(counts, label, frac, allow_singletons))
    cum = F.sum("cnt").over(Window.partitionBy(label).orderBy("_b")
                            .rowsBetween(Window.unboundedPreceding, 0))
    before = F.col("cum") - F.col("cnt")
    boundary = (hist.withColumn("cum", cum).join(quotas, label)
                    .filter((before < F.col("q")) & (F.col("cum") >= F.col("q")))
                    .select(label, "_b", (F.col("q") - before).alias("_need")))
    boundary = cut_lineage(boundary)
    # One probe decides both broadcasts (above the bound: sort-merge joins).
    small = boundary.limit(MAX_CLASSES + 1).count() <= MAX_CLASSES

    def bcast(t: DataFrame) -> DataFrame:
        return F.broadcast(t) if small else t

    # Rank only the boundary bucket of each class; its need-th row is the cut.
    w = Window.partitionBy(label).orderBy("_h", id_col)
    cuts = (keys.join(bcast(boundary), [label, "_b"])
                .withColumn("_rk", F.row_number().over(w))
                .filter(F.col("_rk") == F.col("_need"))
                .select(label, F.col("_h").alias("_ch"), F.col(id_col).alias("_cid")))
    return SplitPlan(bcast(cut_lineage(cuts)), quotas, label, id_col, seed)


def stratified_split(df: DataFrame, label: str = "gold", id_col: str = "row_id",
                     frac: float = VAL_FRACTION, seed: int = SEED, out: str = "split",
                     allow_singletons: bool = False) -> DataFrame:
    """All input columns plus ``split`` in {'train', 'val'} (see ``plan_split``)."""
    return plan_split(df, label, id_col, frac, seed, allow_singletons).assign(df, out)


def split_sizes(split: DataFrame, label: str = "gold", col: str = "split") -> DataFrame:
    return split.groupBy(col, label).agg(F.count(F.lit(1)).alias("n"))
