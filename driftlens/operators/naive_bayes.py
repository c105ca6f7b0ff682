"""Multinomial Naive Bayes as relational jobs.

Fit: token counts per class, laid out as one row per vocabulary token with
one count column per class (conditional sums with partial aggregation; hot
tokens cost one partial row per task). Laplace smoothing gives
``log P(token | class) = ln((n + alpha) / (total_class + alpha * |V|))``.

Score: each document's tokens are joined to the model on ``token``
(out-of-vocabulary tokens add nothing) and summed per document, one sum per
class column, so a (document, token) row meets the model once instead of
once per class. Class priors and totals are one-row aggregates. The counts are
written as Parquet to the checkpoint folder, so the row count is checked
cheaply (a limit probe): under ``MAX_BROADCAST_BYTES`` the token join is a
map-side broadcast and no token row is shuffled. Above it the model is split
at a training-count threshold: hot tokens stay a map-side broadcast, and
only the long tail of rare tokens goes through a sort-merge join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import NB_ALPHA
from ..functions.scores import argmax, max_prob
from ..session import write_scratch

from .prefilter import key_bits, may_match
from .tokens import tokenize

MAX_BROADCAST_BYTES = 256 * 1024 * 1024
# The model has one column per class (count and log-probability), so the
# class count sets the width of every generated aggregate. Wider label
# spaces belong to the MLlib classifier (``operators/mllib``).
MAX_CLASSES = 1_024


@dataclass
class NBModel:
    classes: list            # label values, in column order
    table: DataFrame         # token, lp_0 .. lp_{C-1}, n_total
    log_prior: list          # one log prior per class, in column order
    token_bytes: float = 16.0   # mean length of a token

    def lp_cols(self):
        return [f"lp_{i}" for i in range(len(self.classes))]

    def long_table(self, label_name: str = "label") -> DataFrame:
        """``token, label, log_prob`` (dense: every token for every class)."""
        rows = F.array(*[F.struct(F.lit(c).alias(label_name), F.col(f"lp_{i}").alias("log_prob"))
                         for i, c in enumerate(self.classes)])
        return self.table.select("token", F.inline(rows))


def class_doc_counts(train: DataFrame, label: str = "gold",
                     max_classes: int = MAX_CLASSES) -> dict:
    """Documents per class. Only this label-level table reaches the driver,
    after checking it has at most ``max_classes`` rows."""
    rows = (train.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
                 .limit(max_classes + 1).collect())
    if len(rows) > max_classes:
        raise ValueError(f"more than {max_classes} classes in {label!r}: the Naive Bayes "
                         "model keeps one column per class; use the MLlib classifier")
    return {r[0]: r[1] for r in rows}


def fit_nb(train: DataFrame, classes: list | None = None, label: str = "gold", text: str = "text",
           alpha: float = NB_ALPHA, class_docs: dict | None = None) -> NBModel:
    """Fit on the rows of ``train`` whose label is one of ``classes`` (default: its sorted
    labels, which also fix the class order); other rows, and rows without a label,
    count nowhere. A class without training documents gets probability 0 (log prior
    -inf). ``class_docs``: documents per class where the caller has them already.

    One pass over the training tokens writes the count table; its one-row statistics
    (vocabulary size, token total per class, mean token length) are read from it, and
    the log-probabilities are a projection over it."""
    docs_per_class = class_doc_counts(train, label) if class_docs is None else class_docs
    classes = sorted(docs_per_class) if classes is None else list(classes)
    n_docs = sum(docs_per_class.get(c, 0) for c in classes)
    log_prior = [math.log(docs_per_class[c] / n_docs) if docs_per_class.get(c) else float("-inf")
                 for c in classes]
    toks = (train.filter(F.col(label).isin(classes))
                 .select(F.col(label).alias("_y"), F.explode(tokenize(text)).alias("token")))
    # One row per token, one count column per class: conditional sums in a
    # single partially-aggregated groupBy (one shuffle on token).
    counts = write_scratch(toks.groupBy("token").agg(
        *[F.sum((F.col("_y") == F.lit(c)).cast("long")).alias(f"n_{i}") for i, c in enumerate(classes)],
        F.count(F.lit(1)).alias("n_total")))
    cnt_cols = [F.col(f"n_{i}") for i in range(len(classes))]
    st = counts.agg(F.count(F.lit(1)).alias("v"), F.array(*[F.sum(c) for c in cnt_cols]).alias("tot"),
                    F.avg(F.octet_length("token")).alias("len")).first()
    totals = [int(t or 0) for t in (st["tot"] or [0] * len(classes))]
    lps = [F.ln((c.cast("double") + F.lit(alpha)) / F.lit(tot + alpha * int(st["v"]))).alias(f"lp_{i}")
           for i, (c, tot) in enumerate(zip(cnt_cols, totals))]
    # ``n_total``: the token's count over all classes, used by scoring to
    # split hot tokens (broadcast) from the long tail (sort-merge).
    return NBModel(list(classes), counts.select("token", *lps, "n_total"), log_prior, float(st["len"] or 0.0))


def hot_threshold(table: DataFrame, max_rows: int, col: str = "n_total") -> int | None:
    """Smallest power of two ``t`` such that at most ``max_rows`` tokens have
    ``col >= t`` (None when even the most frequent bucket is too large).

    Computed from a histogram over log2 buckets of the training count: at
    most 64 rows reach the driver, whatever the vocabulary size."""
    b = F.floor(F.log2(F.col(col).cast("double"))).cast("int")
    # A zero count (a token seen only under labels outside ``classes``) has
    # no bucket; such tokens stay below any threshold, in the tail.
    hist = (table.filter(F.col(col) > 0).groupBy(b.alias("b"))
                 .agg(F.count(F.lit(1)).alias("k")).collect())
    kept, thr = 0, None
    for r in sorted(hist, key=lambda r: -r["b"]):
        if kept + r["k"] > max_rows:
            break
        kept += r["k"]
        thr = 2 ** int(r["b"])
    return thr


def score_nb(model: NBModel, docs: DataFrame, text: str = "text", id_col: str = "row_id",
             keep=(), label_col: str = "pred_label", conf_col: str = "pred_confidence") -> DataFrame:
    """One row per input document (also empty ones) with the predicted
    class, its probability, and the per-class log scores. Ids must be unique: two
    documents of one id fail the job, as their words would be summed.

    The model is on disk, so checking its row count is cheap. Under the
    bound the whole model is broadcast: the token join is map-side and no
    token row is shuffled. Above it the model is split by training count:
    the hot tokens (a threshold chosen so that they fit the bound) are
    still joined map-side, and only the rows of the long tail of rare
    tokens are shuffled to a sort-merge join. Token frequencies are heavily
    skewed, so this keeps most token rows out of the shuffle (at the price
    of tokenising the text twice, once per branch), and it also takes the
    hottest tokens out of the sort-merge join."""
    keys = [id_col, *keep]
    lp = model.lp_cols()
    table = model.table
    # a row: the token, a double per class and the table's own overhead
    bound = max(1, int(MAX_BROADCAST_BYTES // (8 * len(model.classes) + model.token_bytes + 48)))
    # ``_first`` is 1 on one row per input document, so a repeated id shows
    if table.limit(bound + 1).count() <= bound:
        toks = docs.select(*keys, F.posexplode_outer(tokenize(text)).alias("_i", "token"))
        joined = (toks.join(F.broadcast(table.select("token", *lp)), "token", "left")
                      .select(*keys, *lp, (F.coalesce("_i", F.lit(0)) == 0).cast("int").alias("_first")))
    else:
        toks = docs.select(*keys, F.explode(tokenize(text)).alias("token"))
        # One zero row per document keeps empty and out-of-vocabulary texts.
        base = docs.select(*keys, *[F.lit(0.0).alias(c) for c in lp], F.lit(1).alias("_first"))
        thr = hot_threshold(table, bound)
        none = F.lit(0).alias("_first")
        if thr is None:
            cold_toks, cold = toks, table
            parts = [base]
        else:
            hot = F.broadcast(table.filter(F.col("n_total") >= thr).select("token", *lp))
            parts = [base, toks.join(hot, "token").select(*keys, *lp, none)]
            cold_toks = toks.join(hot.select("token"), "token", "left_anti")
            cold = table.filter(F.col("n_total") < thr)
        # words that the model does not know leave before the shuffle
        bits = key_bits(cold, "token", cold.count())
        if bits:
            cold_toks = may_match(cold_toks, "token", bits)
        parts.append(cold_toks.join(cold.select("token", *lp), "token").select(*keys, *lp, none))
        joined = parts[0]
        for p in parts[1:]:
            joined = joined.unionByName(p)
    sums = joined.groupBy(*keys).agg(F.sum("_first").alias("_docs"),
                                     *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in lp])
    once = F.when(F.col("_docs") == 1, F.lit(0.0)).otherwise(F.raise_error(F.concat(
        F.lit("documents share the id "), F.coalesce(F.col(id_col).cast("string"), F.lit("NULL")))))
    logits = F.array(*[F.lit(float(p)) + F.col(c) + once for p, c in zip(model.log_prior, lp)])
    classes = F.array(*[F.lit(c) for c in model.classes])
    out = sums.select(*keys, logits.alias("logits"))
    return out.select(*keys, "logits",
                      F.element_at(classes, argmax("logits") + 1).alias(label_col),
                      max_prob("logits").alias(conf_col))


def save_nb(model: NBModel, path: str) -> None:
    """Model directory: ``table`` (parquet, one row per token) and ``meta``
    (one row: classes as strings with their type, log priors)."""
    spark = model.table.sparkSession
    model.table.write.mode("overwrite").parquet(f"{path}/table")
    kind = "int" if all(isinstance(c, int) for c in model.classes) else "string"
    meta = spark.createDataFrame([([str(c) for c in model.classes], kind, model.log_prior, model.token_bytes)],
                                 "classes array<string>, kind string, log_prior array<double>, token_bytes double")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_nb(spark, path: str) -> NBModel:
    m = spark.read.parquet(f"{path}/meta").first()
    classes = [int(c) for c in m.classes] if m.kind == "int" else list(m.classes)
    return NBModel(classes, spark.read.parquet(f"{path}/table"), list(m.log_prior), m.token_bytes)
