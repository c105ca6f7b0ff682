"""Softmax regression trained in epochs of seeded mini-batches.

Rows are dealt to a fixed number of shards by a hash of their id. In each epoch a shard
reads its rows in a new order, given by a hash of seed, epoch and id, and takes one
gradient step per batch, starting from the weights that all shards share; at the epoch's
end the shards' weights are averaged, each counted with its rows, and written. So the
result depends on the parameters alone, not on how many machines there are; with one shard it is
plain mini-batch descent. A task holds one batch and one copy of the weights; averages
are sums over (feature, class) that Spark aggregates before it shuffles them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import require_columns
from ..constants import SEED
from ..session import write_scratch
from .label_index import label_index
from .tokens import tokenize

EPOCHS, BATCH, SHARDS, RATE = 3, 16, 8, 0.5
DIMS = 1 << 14
MAX_WEIGHTS = 1 << 24        # classes x features that every task holds, 8 bytes each
_METRIC = -1                 # number of the feature under which a shard reports its counts
_FEATURES = "struct<indices:array<int>,values:array<double>>"


@dataclass
class SoftmaxModel:
    labels: list             # class values, ascending
    weights: np.ndarray      # (features + 1) x classes, the last row is the bias
    history: list = field(default_factory=list)   # one dict per epoch
    paths: list = field(default_factory=list)     # the weights written after each epoch


def hash60(*parts) -> Column:
    """60-bit number of the parts joined by colons, from their md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def hashed_features(df: DataFrame, text: str = "text", dims: int = DIMS, name: str = "features") -> DataFrame:
    """``df`` with the hashed bag of words of a text: a word counts once per occurrence,
    and the vector has length 1. A text without words has no feature."""
    words = F.transform(tokenize(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
    values = F.transform(words, lambda _: F.lit(1.0))
    return df.withColumn(name, F.struct(words.alias("indices"), values.alias("values")).cast(_FEATURES))


def dense_features(df: DataFrame, vector: str, name: str = "features") -> DataFrame:
    """``df`` with a dense vector as features, as it is. A null vector has no feature."""
    n = F.coalesce(F.size(vector), F.lit(0))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    values = F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>"))
    return df.withColumn(name, F.struct(places.alias("indices"), values.alias("values")).cast(_FEATURES))


def training_plan(df: DataFrame, id_col: str = "row_id", epochs: int = EPOCHS, batch: int = BATCH,
                  shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(epoch, shard, batch, place, id): which row is read when. A report for checking an
    order; training sorts each shard within its task and never ranks rows this way."""
    from pyspark.sql import Window

    rows = df.select(F.col(id_col).alias("id"), F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
    rows = rows.withColumns({"shard": _shard("id", shards, seed), "_o": _order("id", seed, F.col("epoch"))})
    place = F.row_number().over(Window.partitionBy("epoch", "shard").orderBy("_o", "id")) - 1
    return rows.withColumn("place", place).select(
        "epoch", "shard", F.floor(F.col("place") / batch).cast("int").alias("batch"), "place", "id")


def _shard(id_col: str, shards: int, seed: int) -> Column:
    return (hash60(F.lit(str(seed)), F.lit("shard"), F.col(id_col).cast("string")) % shards).cast("int")


def _order(id_col: str, seed: int, epoch: Column) -> Column:
    return hash60(F.lit(str(seed)), epoch.cast("string"), F.col(id_col).cast("string"))


def _rows(b: pa.RecordBatch, normal: bool):
    """(class, offsets, indices, values) of a record batch; vectors of length 1 if ``normal``."""
    f = b.column("features")
    idx, val = f.field("indices"), f.field("values")
    size = idx.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.append(0, np.cumsum(size))
    i, v = idx.flatten().to_numpy(zero_copy_only=False).astype(np.int64), val.flatten().to_numpy(zero_copy_only=False)
    if normal:
        own = np.repeat(np.arange(len(size)), size)
        # a repeated feature is one component: the squares of the sums
        key, inverse = np.unique(own * (1 << 32) + i, return_inverse=True)
        total = np.bincount(inverse, v, len(key))
        norm = np.sqrt(np.bincount(key >> 32, total * total, len(size)))
        v = v / np.where(norm > 0, norm, 1)[own]
    return b.column("y").to_numpy(zero_copy_only=False), at, i, v


def _probabilities(w: np.ndarray, at: np.ndarray, i: np.ndarray, v: np.ndarray):
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    z = np.tile(w[-1], (len(at) - 1, 1))
    np.add.at(z, own, w[i] * v[:, None])
    e = np.exp(z - z.max(1, keepdims=True))
    return own, z, e / e.sum(1, keepdims=True)


def descend(w: np.ndarray, y: np.ndarray, at: np.ndarray, i: np.ndarray, v: np.ndarray, rate: float):
    """One step of ``w`` in place along the mean gradient of a batch; returns the summed
    loss and the right predictions before it."""
    own, z, p = _probabilities(w, at, i, v)
    loss = float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())
    right = int((z.argmax(1) == y).sum())
    p[np.arange(len(y)), y] -= 1
    p *= rate / len(y)
    np.subtract.at(w, i, p[own] * v[:, None])
    w[-1] -= p.sum(0)
    return loss, right


def _epoch(weights, batch: int, rate: float, normal: bool):
    """(feature, class, value) sums of the shards of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, w, seen, held = None, None, None, []

        def train(last: bool):
            """Steps over the full batches held; the rest too if ``last``."""
            nonlocal held
            y, i, v = (np.concatenate([h[k] for h in held]) for k in (0, 2, 3))
            at = np.append(0, np.cumsum(np.concatenate([np.diff(h[1]) for h in held])))
            end = len(y) if last else len(y) // batch * batch
            for a in range(0, end, batch):
                b = min(a + batch, end)
                loss, right = descend(w, y[a:b], at[a:b + 1] - at[a], i[at[a]:at[b]], v[at[a]:at[b]], rate)
                seen[:] += (b - a, 1, loss, right)
            held = [(y[end:], at[end:] - at[end], i[at[end]:], v[at[end]:])] if end < len(y) else []

        def close():
            if held:
                train(True)
            f, c = np.nonzero(w)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(f, [_METRIC] * 4).astype(np.int32)), pa.array(np.append(c, range(4)).astype(np.int32)),
                 pa.array(np.append(w[f, c] * seen[0], seen))], names=["feature", "class", "value"])

        for whole in batches:
            own = whole.column("shard").to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for a, z in zip(edge[:-1], edge[1:]):
                if a == z:
                    continue
                if own[a] != shard:
                    if shard is not None:
                        yield from close()
                    shard, w, seen, held = own[a], weights.value.copy(), np.zeros(4), []
                for lo in range(a, z, 1024):
                    held.append(_rows(whole.slice(lo, min(1024, z - lo)), normal))
                    train(False)
        if shard is not None:
            yield from close()
    return run


def _measure(weights, normal: bool):
    """(rows, loss, right) of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                y, at, i, v = _rows(whole.slice(lo, 1024), normal)
                _, z, p = _probabilities(weights.value, at, i, v)
                known = y >= 0    # a class that training never saw is wrong, at the price of probability 1e-300
                own = np.where(known, p[np.arange(len(y)), np.maximum(y, 0)], 0)
                total += len(y), -np.log(np.maximum(own, 1e-300)).sum(), (known & (z.argmax(1) == y)).sum()
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=["rows", "loss", "correct"])
    return run


def fit_epochs(train: DataFrame, dims: int, label: str = "gold", id_col: str = "row_id", epochs: int = EPOCHS,
               batch: int = BATCH, rate: float = RATE, seed: int = SEED, shards: int = SHARDS, normal: bool = True,
               validation: DataFrame | None = None) -> SoftmaxModel:
    """Train on the rows of ``train`` with a label: columns ``label``, ``id_col`` and
    ``features`` (indices below ``dims``). Ids should be unique: rows of one id are read
    in any order. ``normal`` scales every vector to length 1.

    ``history`` has one entry per epoch: rows and batches read, mean loss and accuracy
    of the rows just before their own step and, with ``validation``, the loss and
    accuracy of its rows with the epoch's average weights. The weights of each epoch are
    written under the checkpoint folder (``paths``)."""
    require_columns(train, [label, id_col, "features"], "fit_epochs")
    spark, sc = train.sparkSession, train.sparkSession.sparkContext
    rows = train.filter(F.col(label).isNotNull())
    labels = [r.label for r in label_index(rows, label).orderBy("label_idx").limit(MAX_WEIGHTS + 1).collect()]
    if not labels:
        raise ValueError("no row has a label")
    if len(labels) * (dims + 1) > MAX_WEIGHTS:
        raise ValueError(f"{len(labels)} classes x {dims} features: more than {MAX_WEIGHTS} weights")
    index = F.broadcast(spark.createDataFrame(list(enumerate(labels)), f"y int, _label {rows.schema[label].dataType.simpleString()}"))
    held = write_scratch(rows.join(index, F.col(label) == F.col("_label")).select(
        F.col(id_col).alias("id"), "y", "features", _shard(id_col, shards, seed).alias("shard")))
    check = None
    if validation is not None:
        check = validation.join(index, F.col(label) == F.col("_label"), "left").select(
            F.coalesce("y", F.lit(-1)).alias("y"), "features")
    model = SoftmaxModel(labels, np.zeros((dims + 1, len(labels))))
    for e in range(1, epochs + 1):
        weights = sc.broadcast(model.weights)
        # shard is the only key, so that one task reads a shard from its first row to its last
        ordered = (held.withColumn("_o", _order("id", seed, F.lit(e))).repartition(shards, "shard")
                   .sortWithinPartitions("shard", "_o", "id"))
        sums = write_scratch(ordered.select("shard", "y", "features").mapInArrow(
            _epoch(weights, batch, rate, normal), "feature int, class int, value double")
            .groupBy("feature", "class").agg(F.sum("value").alias("value")))
        n, steps, loss, right = (r.value for r in sums.filter(F.col("feature") == _METRIC).orderBy("class").collect())
        mean = write_scratch(sums.filter(F.col("feature") != _METRIC).select(
            "feature", "class", (F.col("value") / F.lit(n)).alias("weight")))
        got = mean.toPandas()   # at most MAX_WEIGHTS rows
        new = np.zeros_like(model.weights)
        new[got["feature"], got["class"]] = got["weight"]
        model.weights = new
        model.paths.append(mean.inputFiles())
        entry = {"epoch": e, "n_rows": int(n), "n_batches": int(steps), "loss": loss / n, "accuracy": right / n}
        if check is not None:
            v = check.mapInArrow(_measure(sc.broadcast(new), normal), "rows double, loss double, correct double").agg(
                F.sum("rows").alias("n"), F.sum("loss").alias("loss"), F.sum("correct").alias("correct")).first()
            entry |= {"val_rows": int(v.n or 0), "val_loss": v.loss / v.n if v.n else None,
                      "val_accuracy": v.correct / v.n if v.n else None}
        model.history.append(entry)
    return model


def score_epochs(model: SoftmaxModel, df: DataFrame, normal: bool = True, label_col: str = "pred_label",
                 conf_col: str = "pred_confidence") -> DataFrame:
    """``df`` (with ``features``) and the best class and its probability for each row."""
    require_columns(df, ["features"], "score_epochs")
    weights = df.sparkSession.sparkContext.broadcast(model.weights)
    names = [c for c in df.columns if c not in ("features", "y", label_col, conf_col)]
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                _, at, i, v = _rows(b, normal)
                _, z, p = _probabilities(weights.value, at, i, v)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(z.argmax(1).astype(np.int32)),
                                                  pa.array(p.max(1))], names=[*names, "_class", "_conf"])

    found = df.select(*names, "features", F.lit(0).alias("y")).mapInArrow(
        run, (kept + ", " if kept else "") + "_class int, _conf double")
    named = F.array(*[F.lit(x) for x in model.labels])
    return found.select(*names, F.get(named, "_class").alias(label_col), F.col("_conf").alias(conf_col))
