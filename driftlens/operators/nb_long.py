"""Naive Bayes over label spaces of any width: a sparse long model.

With Laplace smoothing a class prices a token it has not seen at
``ln(alpha / (T + alpha V))``, whatever the token; one it saw n times gains
``ln(1 + n / alpha)`` over that price. So the model is one row per token with the gains
of the classes that saw it, and one row per class with its prior and its unseen price.
Its size is the number of (token, class) pairs seen, not tokens times classes.

A document of N known tokens has the score ``prior + N * unseen + sum of gains``. The
gains come from an equi-join on the token and partial sums per (document, class); the
classes without a gain enter only through the best and the total of
``prior + N * unseen``, which depend on N alone. The best class is the larger of the two
maxima, ties to the smaller label, and the confidence is its softmax over all classes.

Where a few different texts hold tokens that most classes saw, that join has nearly a row
for every (text, class). Then the classes are dealt into blocks, the texts into chunks, and
each pair of them is one group that prices its classes as vectors; a text's best class and
its total come from one row per block."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checks import broadcast_if_bounded
from ..constants import NB_ALPHA
from ..session import write_scratch
from .label_index import label_index
from .naive_bayes import MAX_BROADCAST_BYTES
from .prefilter import key_bits, may_match
from .tokens import tokenize

# One class costs 16 bytes in every scoring worker.
MAX_CLASSES = 5_000_000
MAX_BROADCAST_LABELS = 1_000_000
MAX_TEXTS = 1_000_000       # scores of distinct texts are broadcast up to so many
BLOCK_CLASSES, BLOCK_PAIRS = 16_384, 1_000_000  # classes, and (token, class) pairs, of one block on average
CHUNK_WORDS = 500_000       # words of the texts that meet a block at once, on average
BLOCK_COST = 1_000          # gains that cost as much as one text in one block
_KNOWN, _DOCUMENT = -1, -2  # numbers that stand for "known tokens" and "documents" beside the classes


@dataclass
class LongNB:
    classes: DataFrame      # class, label, n_docs, log_prior, unseen
    table: DataFrame        # token, n_total, n_classes, gains array<struct<class, gain>>

    def long_table(self) -> DataFrame:
        """(token, label, gain), one row per pair seen in training."""
        pairs = self.table.select("token", F.inline("gains"))
        return pairs.join(broadcast_if_bounded(self.classes.select("class", "label"), MAX_BROADCAST_LABELS),
                          "class").select("token", "label", "gain")


def fit_nb_long(train: DataFrame, label: str = "gold", text: str = "text", alpha: float = NB_ALPHA) -> LongNB:
    """Fit on the rows of ``train`` with a label. One pass over the tokens writes the
    count table (class, token, n); totals, vocabulary and gains are read from it."""
    rows = train.filter(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"))
    index = write_scratch(label_index(rows, "label").select("label", F.col("label_idx").alias("class"),
                                                            F.col("n").alias("n_docs")))
    seen = rows.select("label", F.explode(tokenize("text")).alias("token")).groupBy("label", "token").agg(
        F.count(F.lit(1)).alias("n"))
    counts = write_scratch(seen.join(broadcast_if_bounded(index.select("label", "class"), MAX_BROADCAST_LABELS), "label")
                           .select("class", "token", "n"))
    gain = F.struct("class", F.ln(1.0 + F.col("n") / F.lit(float(alpha))).alias("gain"))
    table = write_scratch(counts.groupBy("token").agg(
        F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("n_classes"), F.collect_list(gain).alias("gains")))
    words = table.count()
    docs = index.agg(F.sum("n_docs")).first()[0] or 0
    totals = counts.groupBy("class").agg(F.sum("n").alias("n_tokens"))
    # an empty vocabulary has no unseen price; no document then has a known token
    unseen = F.ln(F.lit(float(alpha)) / (F.coalesce("n_tokens", F.lit(0)) + F.lit(float(alpha) * max(words, 1))))
    classes = write_scratch(index.join(totals, "class", "left").select(
        "class", "label", "n_docs", F.ln(F.col("n_docs") / F.lit(float(max(docs, 1)))).alias("log_prior"),
        unseen.alias("unseen")))
    return LongNB(classes, table)


def _prices(model: LongNB) -> np.ndarray:
    """(log prior, unseen price) of every class, by its number."""
    n = model.classes.count()
    if n > MAX_CLASSES:
        raise ValueError(f"{n} classes: each scoring worker keeps 16 bytes a class, at most {MAX_CLASSES} classes")
    rows = model.classes.select("class", "log_prior", "unseen").toPandas().sort_values("class")
    return rows[["log_prior", "unseen"]].to_numpy(np.float64).T


def _hot_tokens(model: LongNB, max_bytes: int) -> int | None:
    """Smallest power of two t such that the tokens with ``n_total >= t`` fit in
    ``max_bytes`` (0: all of them, None: not even the most frequent ones); from a
    histogram of at most 64 rows."""
    size = 16 * F.col("n_classes") + F.octet_length("token") + 64
    hist = (model.table.groupBy(F.floor(F.log2(F.col("n_total").cast("double"))).cast("int").alias("b"))
            .agg(F.sum(size).alias("bytes")).collect())
    held, at = 0, None
    for r in sorted(hist, key=lambda r: -r.b):
        held += r.bytes
        if held > max_bytes:
            return at
        at = 2 ** r.b
    return 0


def _best(prices):
    """Rows (id, known, documents, touched) to (id, class, confidence); ``prices`` is the
    broadcast of ``_prices``. The untouched classes are summed once per value of known."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, unseen = prices.value
        base: dict[int, tuple[float, int, float]] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                known = b.column("known").to_numpy(zero_copy_only=False)
                if (b.column("documents").to_numpy(zero_copy_only=False) != 1).any():
                    raise ValueError("documents share an id")
                lists = b.column("touched")
                size = lists.value_lengths().to_numpy(zero_copy_only=False)
                parts = lists.flatten()
                own = np.repeat(np.arange(len(size)), size)
                c = parts.field("class").to_numpy(zero_copy_only=False)
                without = prior[c] + known[own] * unseen[c]
                score = without + parts.field("gain").to_numpy(zero_copy_only=False)
                for n in set(known.tolist()) - base.keys():
                    s = prior + n * unseen
                    m = s.max()
                    base[n] = (m, int(s.argmax()), float(np.exp(s - m).sum()))
                top, first, total = (np.array(x) for x in zip(*[base[n] for n in known.tolist()]))
                best = top.astype(np.float64)
                np.maximum.at(best, own, score)
                pick = np.where(top == best, first, len(prior))
                hit = score == best[own]
                np.minimum.at(pick, own[hit], c[hit])
                rest = total * np.exp(top - best)
                mine = np.exp(score - best[own])
                np.add.at(rest, own, -np.exp(without - best[own]))
                # what cancels to less than nothing is rounding; the best class itself counts 1 at least
                mass = np.maximum(rest, 0) + np.bincount(own, mine, len(size))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(pick.astype(np.int32)), pa.array(1.0 / np.maximum(mass, 1.0))],
                    names=["id", "class", "confidence"])
    return run


def _known_words(model: LongNB, src: DataFrame) -> DataFrame:
    """(number, id, known, touched, words) of every row of ``src`` (id, text), ids unique: its
    known tokens, the classes that saw them (a class once for each different token), and
    the different ones with their counts, by their first places in the text."""
    vocabulary = broadcast_if_bounded(model.table.select("token", "n_classes"), MAX_BROADCAST_LABELS)
    tokens = src.select("id", F.posexplode(tokenize("text")).alias("at", "token")).groupBy("id", "token").agg(
        F.min("at").alias("at"), F.count(F.lit(1)).alias("times"))
    found = tokens.join(vocabulary, "token").select("id", "at", "token", "times", "n_classes")
    none = F.lit(0).cast("long")
    rows = found.unionAll(src.select("id", F.lit(0), F.lit(None).cast("string"), none, none))
    words = F.collect_list(F.when(F.col("token").isNotNull(), F.struct("at", "token", "times")))  # nulls are left out
    texts = rows.groupBy("id").agg(F.sum("times").alias("known"), F.sum("n_classes").alias("touched"),
                                   F.sort_array(words).alias("words"))
    return write_scratch(texts.withColumn("number", F.monotonically_increasing_id()))


def _score_block(model: pa.Table, texts: pa.Table) -> pa.Table:
    """(number, top, class, mass) of each text over one block of classes: the best score,
    the smallest class that has it, and the sum of exp(score - top). ``model`` has a row
    (class, null, prior, unseen) per class and a row (class, token, gain, null) per pair."""
    found = [], [], [], []
    if model.num_rows and texts.num_rows:
        token = model.column("token").combine_chunks()
        one = token.is_null().to_numpy(zero_copy_only=False)
        number, value = model.column("class").to_numpy(), model.column("value").to_numpy()
        order = np.argsort(number[one])
        classes, prior = number[one][order], value[one][order]
        unseen = model.column("unseen").to_numpy()[one][order]
        pairs = pc.dictionary_encode(token.drop_null())
        code = pairs.indices.to_numpy()
        by = np.argsort(code, kind="stable")
        places, gain = np.searchsorted(classes, number[~one])[by], value[~one][by]
        ends = np.searchsorted(code[by], np.arange(len(pairs.dictionary) + 1))
        at = {w: slice(ends[i], ends[i + 1]) for i, w in enumerate(pairs.dictionary.to_pylist())}
        base, known = prior, None
        for text in texts.select(["number", "known", "words"]).sort_by("known").to_pylist():
            if text["known"] != known:
                known = text["known"]
                base = prior + known * unseen
            gains = np.zeros(len(classes))  # summed first, as the join sums them: equal scores stay equal
            for w in text["words"]:
                if w["token"] in at:
                    own = at[w["token"]]
                    gains[places[own]] += w["times"] * gain[own]
            score = base + gains
            top = score.max()
            for column, x in zip(found, (text["number"], top, classes[score.argmax()],
                                         np.exp(score - top).sum())):
                column.append(x)
    return pa.table([pa.array(x, kind) for x, kind in zip(found, (pa.int64(), pa.float64(), pa.int32(), pa.float64()))],
                    names=["number", "top", "class", "mass"])


def _score_blocks(model: LongNB, texts: DataFrame, blocks: int, chunks: int) -> DataFrame:
    """(id, class, confidence) of ``_known_words``: every chunk of texts meets every block
    of classes in a group of its own, both of bounded size."""
    spark = texts.sparkSession
    block = (F.col("class") % blocks).cast("int").alias("block")
    pairs = model.table.select("token", F.inline("gains")).select(
        block, "class", "token", F.col("gain").alias("value"), F.lit(None).cast("double").alias("unseen"))
    rows = pairs.unionAll(model.classes.select(
        block, "class", F.lit(None).cast("string"), F.col("log_prior"), F.col("unseen")))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    met = texts.select("number", "known", "words", F.pmod("number", F.lit(chunks)).cast("int").alias("chunk"),
                       F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    sides = [x.repartition(blocks * chunks, "block", "chunk").groupBy("block", "chunk") for x in (rows, met)]
    parts = sides[0].cogroup(sides[1]).applyInArrow(_score_block, "number long, top double, class int, mass double")
    best = parts.groupBy("number").agg(F.max("top").alias("most"), F.collect_list(F.struct("top", "class", "mass")).alias("parts"))
    mass = F.aggregate("parts", F.lit(0.0), lambda sum_, p: sum_ + p["mass"] * F.exp(p["top"] - F.col("most")))
    first = F.array_min(F.transform(F.filter("parts", lambda p: p["top"] == F.col("most")), lambda p: p["class"]))
    best = best.select("number", first.alias("class"), (1.0 / F.greatest(mass, F.lit(1.0))).alias("confidence"))
    return texts.select("number", "id").join(best, "number").select("id", "class", "confidence")


def _score_distinct(model: LongNB, texts: DataFrame, label_col: str, conf_col: str, max_bytes: int) -> DataFrame:
    """(_text, label, confidence) of different texts: by blocks of classes where the join
    of their tokens would have more rows than the blocks cost."""
    src = _known_words(model, texts.select(F.col("_text").alias("id"), F.col("_text").alias("text")))
    size = src.agg(F.count(F.lit(1)).alias("texts"), F.sum("touched").alias("touched"),
                   F.sum(F.size("words")).alias("words")).first()
    n, pairs = model.classes.count(), model.table.agg(F.sum("n_classes")).first()[0] or 0
    blocks = max(math.ceil(n / BLOCK_CLASSES), math.ceil(pairs / BLOCK_PAIRS), 1)
    if (size.touched or 0) <= BLOCK_COST * blocks * size.texts:
        return score_nb_long(model, texts, "_text", "_text", (), label_col, conf_col, False, max_bytes)
    found = _score_blocks(model, src, blocks, max(math.ceil(size.words / CHUNK_WORDS), 1))
    named = found.join(broadcast_if_bounded(model.classes.select("class", "label"), MAX_BROADCAST_LABELS), "class")
    return named.select(F.col("id").alias("_text"), F.col("label").alias(label_col), F.col("confidence").alias(conf_col))


def score_nb_long(model: LongNB, docs: DataFrame, text: str = "text", id_col: str = "row_id", keep=(),
                  label_col: str = "pred_label", conf_col: str = "pred_confidence", distinct_texts: bool = False,
                  max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row per document, also empty ones, with its best class and its probability,
    as ``naive_bayes.score_nb``; ids must be unique.

    The whole model is broadcast if its stored size fits ``max_bytes``. Otherwise the
    tokens frequent in training are, and only the rows of the others go through a
    sort-merge join. ``distinct_texts`` scores each different text once, for short
    texts of which many are equal, by blocks of classes if most classes saw their tokens. A model without classes predicts null."""
    keys = [id_col, *keep]
    if distinct_texts:
        held = docs.select(*keys, F.coalesce(text, F.lit("")).alias("_text"))
        scored = _score_distinct(model, held.select("_text").distinct(), label_col, conf_col, max_bytes)
        return held.join(broadcast_if_bounded(write_scratch(scored), MAX_TEXTS), "_text").drop("_text")
    prices = _prices(model)
    if not prices.shape[1]:
        kind = model.classes.schema["label"].dataType
        return docs.select(*keys, F.lit(None).cast(kind).alias(label_col), F.lit(None).cast("double").alias(conf_col))
    src = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    one = src.select("id", F.lit(_DOCUMENT).alias("class"), F.lit(1.0).alias("gain"))
    tokens = src.select("id", F.explode(tokenize("text")).alias("token"))
    known = F.array(F.struct(F.lit(_KNOWN).alias("class"), F.lit(1.0).alias("gain")))
    table = model.table.select("token", "n_total", F.concat(known, "gains").alias("gains"))

    def gains(rows: DataFrame, side: DataFrame) -> DataFrame:
        return rows.join(side.select("token", "gains"), "token").select("id", F.inline("gains"))

    def known_only(rows: DataFrame, side: DataFrame) -> DataFrame:
        bits = key_bits(side, "token", side.count())  # unknown words leave before the shuffle
        return may_match(rows, "token", bits) if bits else rows

    at = _hot_tokens(model, max_bytes)
    if at is None:
        parts = [gains(known_only(tokens, table), table)]
    elif at == 0:
        parts = [gains(tokens, F.broadcast(table))]
    else:
        hot = F.broadcast(table.filter(F.col("n_total") >= at))
        cold = tokens.join(hot.select("token"), "token", "left_anti")
        rest = table.filter(F.col("n_total") < at)
        parts = [gains(tokens, hot), gains(known_only(cold, rest), rest)]
    rows = one
    for p in parts:
        rows = rows.unionAll(p)
    sums = rows.groupBy("id", "class").agg(F.sum("gain").alias("gain"))
    of = {c: F.coalesce(F.sum(F.when(F.col("class") == c, F.col("gain"))), F.lit(0.0)).cast("long") for c in (_KNOWN, _DOCUMENT)}
    touched = F.collect_list(F.when(F.col("class") >= 0, F.struct("class", "gain")))  # nulls are left out
    groups = sums.groupBy("id").agg(of[_KNOWN].alias("known"), of[_DOCUMENT].alias("documents"), touched.alias("touched"))
    found = groups.mapInArrow(_best(docs.sparkSession.sparkContext.broadcast(prices)),
                              f"id {src.schema['id'].dataType.simpleString()}, class int, confidence double")
    named = found.join(broadcast_if_bounded(model.classes.select("class", "label"), MAX_BROADCAST_LABELS), "class")
    named = named.select(F.col("id").alias("_id"), F.col("label").alias(label_col), F.col("confidence").alias(conf_col))
    if not keep:
        return named.withColumnRenamed("_id", id_col)
    return docs.select(*keys).join(named, F.col(id_col).eqNullSafe(F.col("_id"))).drop("_id")


def save_nb_long(model: LongNB, path: str) -> None:
    """Two Parquet tables: ``table`` (a row per token) and ``classes``."""
    model.table.write.mode("overwrite").parquet(f"{path}/table")
    model.classes.write.mode("overwrite").parquet(f"{path}/classes")


def load_nb_long(spark, path: str) -> LongNB:
    return LongNB(spark.read.parquet(f"{path}/classes"), spark.read.parquet(f"{path}/table"))
