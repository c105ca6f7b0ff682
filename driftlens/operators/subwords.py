"""Subword windows: texts cut into vocabulary pieces by greedy longest match.

A text is lower-cased and split into runs of letters or digits and single other marks;
from the left of each word the longest piece of the vocabulary is taken, pieces after the
first being continuations. A word that cannot be cut this way, or is longer than
``MAX_WORD`` characters, is one unknown piece. A window holds a start and an end mark, the
first pieces up to its length and padding.

The vocabulary is a table (piece, first, id) that a path or another table provides; it is
broadcast behind a check of its size. Each worker cuts every different word of its rows
once, in Arrow batches, and no row is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checks import require_columns
from ..constants import MAX_TOKENS

WORDS = r"[\p{L}\p{N}]+|[^\p{Z}\p{Cc}\p{L}\p{N}]"   # separators and control characters only part words
MAX_WORD = 100
MAX_PIECES = 2_000_000        # rows of a vocabulary that every worker holds
KEPT_WORDS = 200_000          # cut words that a worker keeps; beyond, it starts anew
PAD, UNKNOWN, START, END = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
SPECIAL = (PAD, UNKNOWN, START, END)
CONTINUES = "##"


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary file, one piece a line: the id is the line's number from 0, pieces
    with ``##`` in front continue a word. Special marks must be among the lines."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.posexplode(F.split("value", "\r?\n")).alias("id", "line")).filter("line <> ''")
    first = ~F.col("line").startswith(CONTINUES)
    return rows.select(F.when(first, F.col("line")).otherwise(F.substring("line", 3, MAX_WORD + 1)).alias("piece"),
                       first.alias("first"), "id")


def vocabulary_of(words: DataFrame, word: str = "word") -> DataFrame:
    """A vocabulary in which every distinct word of a table, and every character of them,
    is a piece that may begin or continue a word. Ids follow the special marks, in the
    order of the pieces (a window over the vocabulary alone)."""
    chars = words.select(F.explode(F.filter(F.split(F.col(word), ""), lambda c: c != "")).alias("piece"))
    pieces = words.select(F.col(word).alias("piece")).unionAll(chars).filter("piece <> ''").distinct()
    rows = pieces.select("piece", F.explode(F.array(F.lit(True), F.lit(False))).alias("first"))
    order = Window.orderBy(F.col("first").desc(), "piece")
    rows = rows.withColumn("id", (F.row_number().over(order) - 1 + len(SPECIAL)).cast("int"))
    marks = words.sparkSession.createDataFrame([(p, True, i) for i, p in enumerate(SPECIAL)], "piece string, first boolean, id int")
    return marks.unionByName(rows)


def load_vocabulary(table: DataFrame, max_pieces: int = MAX_PIECES) -> tuple[dict, dict]:
    """({first piece: id}, {continuation: id}) of a vocabulary table of bounded size."""
    rows = table.select("piece", "first", "id").limit(max_pieces + 1).collect()
    if len(rows) > max_pieces:
        raise ValueError(f"more than {max_pieces} pieces")
    first, rest = {}, {}
    for r in rows:
        into = first if r.first else rest
        if into.setdefault(r.piece, r.id) != r.id:
            raise ValueError(f"piece {r.piece!r} has two ids")
    missing = [m for m in SPECIAL if m not in first]
    if missing:
        raise ValueError(f"the vocabulary lacks {missing}")
    return first, rest


def cut_word(word: str, first: dict, rest: dict, longest: int) -> list[int] | None:
    """Ids of the pieces of a word, None if it cannot be cut."""
    if len(word) > MAX_WORD:
        return None
    out, at, pieces = [], 0, first
    while at < len(word):
        for end in range(min(len(word), at + longest), at, -1):
            found = pieces.get(word[at:end])
            if found is not None:
                break
        else:
            return None
        out.append(found)
        at, pieces = end, rest
    return out


def subword_windows(df: DataFrame, vocabulary: DataFrame, text: str = "text", length: int = MAX_TOKENS,
                    keep=None) -> DataFrame:
    """``df`` (columns ``keep``, all by default) with ids and mask (``length`` long), n_subwords (of
    the whole text), n_unknown (words), n_kept (places of the window that are not padding) and truncated.

    Null and empty texts give a window of the two marks. Added columns replace those of
    the same name; rows are independent. ``length`` must leave room for the marks."""
    require_columns(df, [text], "subword_windows")
    if length < 2:
        raise ValueError("a window holds two marks at least")
    first, rest = load_vocabulary(vocabulary)
    pad, unknown, start, end = (first[m] for m in SPECIAL)
    plain = {p: i for p, i in first.items() if p not in SPECIAL}
    longest = max(map(len, [*plain, *rest]), default=1)
    held = df.sparkSession.sparkContext.broadcast((plain, rest))
    added = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.IntegerType())),
                          T.StructField("n_subwords", T.LongType()), T.StructField("n_unknown", T.LongType()),
                          T.StructField("n_kept", T.IntegerType()), T.StructField("truncated", T.BooleanType())])
    names = [c for c in (keep or df.columns) if c not in added.names]
    own = "__words"
    while own in names:
        own += "_"
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(WORDS), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, more = held.value
        known: dict[str, tuple] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                lists = b.column(own)
                size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                coded = lists.flatten().dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                if len(known) > KEPT_WORDS:
                    known.clear()
                for w in distinct:
                    if w not in known:
                        got = cut_word(w, pieces, more, longest)
                        known[w] = ([unknown], 1) if got is None else (got, 0)
                cuts = [known[w] for w in distinct]
                n = np.array([len(c[0]) for c in cuts] or [0], np.int64)
                lost = np.array([c[1] for c in cuts] or [0], np.int64)
                each = coded.indices.to_numpy(zero_copy_only=False)
                at = np.append(0, np.cumsum(size))
                total, gone = (np.append(0, np.cumsum(x[each]))[at] for x in (n, lost))
                windows = np.full((b.num_rows, length), pad, np.int32)
                kept = np.minimum(np.diff(total), length - 2).astype(np.int32)
                for i in range(b.num_rows):
                    row = [start]
                    for w in each[at[i]:at[i + 1]]:
                        if len(row) > kept[i]:
                            break
                        row += cuts[w][0]
                    windows[i, :kept[i] + 1] = row[:kept[i] + 1]
                windows[np.arange(len(kept)), kept + 1] = end
                mask = (np.arange(length) < (kept + 2)[:, None]).astype(np.int32)
                off = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * length)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in names], pa.ListArray.from_arrays(off, pa.array(windows.ravel())),
                     pa.ListArray.from_arrays(off, pa.array(mask.ravel())), pa.array(np.diff(total)), pa.array(np.diff(gone)),
                     pa.array(kept + 2), pa.array(np.diff(total) > length - 2)], names=[*names, *added.names])

    schema = T.StructType([df.schema[c] for c in names] + list(added))
    return df.select(*names, words.alias(own)).mapInArrow(run, schema)


def spelled(windows: DataFrame, vocabulary: DataFrame, ids: str = "ids", name: str = "pieces") -> DataFrame:
    """``windows`` with the pieces of a list of ids as text, continuations with ``##`` in
    front; the vocabulary's ids must run from 0 without a gap."""
    first, rest = load_vocabulary(vocabulary)
    by_id = {i: p for p, i in first.items()} | {i: CONTINUES + p for p, i in rest.items()}
    if sorted(by_id) != list(range(len(by_id))):
        raise ValueError("ids do not run from 0 without a gap")
    table = windows.sparkSession.createDataFrame([([by_id[i] for i in range(len(by_id))],)], "_all array<string>")
    joined = windows.withColumn("_one", F.lit(1)).join(F.broadcast(table.withColumn("_one", F.lit(1))), "_one")
    return joined.withColumn(name, F.transform(ids, lambda i: F.get("_all", i))).drop("_one", "_all")


def subword_report(windows: DataFrame, by: str = "dataset") -> DataFrame:
    """What the windows of each dataset cut off."""
    return windows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("truncated").cast("long")).alias("n_truncated"),
        F.sum("n_subwords").alias("subwords_total"), F.sum((F.col("n_kept") - 2).cast("long")).alias("subwords_kept"),
        F.sum("n_unknown").alias("n_unknown"), F.avg(F.col("truncated").cast("double")).alias("share_truncated"))
