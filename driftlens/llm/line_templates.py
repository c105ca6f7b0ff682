"""Line deduplication by a log-template tree, in DataFrame operations only.

A line is parsed along a tree of fixed depth: its token count, then its first
``DEPTH`` tokens, where a token that holds a digit counts as a variable field. The
lines of one leaf are generalised position by position: a token seen by enough
witnesses at its place is fixed, any other is a variable field. Lines of one
resulting template that recur among witnesses are dropped everywhere.

Whole copies of documents are not boilerplate, so copies are one witness (a
near-duplicate stage decides on them; they lose the templates that others prove). A
document is known by the set of its leaves: copies have sets of Jaccard similarity
``COPY_SIMILARITY`` or more. Each document is held against one other, the one that is the
first holder of most of its leaves, and links are closed to groups; no group of documents
is ever paired. Of a witness with several lines in a leaf, the most seen one counts for
what the leaf has in common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checks import broadcast_if_bounded, require_columns
from . import words as W
from .graph import connected_components
from .scratch import materialise

DEPTH, MIN_DOCS, MIN_TOKENS = 4, 3, 3
SIMILARITY = 0.7      # share of fixed positions that a template needs
COPY_SIMILARITY = 0.75
BROADCAST_ROWS = 1_000_000
VARIABLE = "<*>"


def _mask(line: F.Column) -> F.Column:
    """White space folded and tokens with a digit replaced; most lines need neither."""
    folded = F.trim(F.regexp_replace(line, r"\s+", " "))
    return F.when(line.rlike(r"[0-9\t\r\f\x0B]|  "), F.regexp_replace(folded, r"[^ 0-9]*[0-9][^ ]*", VARIABLE)).otherwise(
        F.trim(line))


def _spaces() -> F.Column:
    return F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit("")))


def _lines(src: DataFrame) -> DataFrame:
    """(doc_id, pos, masked): every line of at least MIN_TOKENS tokens. Lines are masked
    before they are exploded, so that no later step masks them again."""
    masked = F.transform(F.split("text", "\n", -1), _mask)
    rows = src.select("doc_id", F.posexplode(masked).alias("pos", "masked"))
    return rows.where(_spaces() >= MIN_TOKENS - 1)


def _leaf() -> F.Column:
    lead = F.substring_index("masked", " ", DEPTH)
    return F.xxhash64(_spaces(), lead)


def copy_groups(held: DataFrame) -> DataFrame:
    """(doc_id, witness) of the documents that have copies: the smallest id of their group.
    ``held`` has the distinct (doc_id, leaf) of all documents."""
    often = materialise(held.groupBy("leaf").agg(F.count("*").alias("docs"), F.min("doc_id").alias("hub")).where("docs > 1"))
    size = held.groupBy("doc_id").agg(F.count("*").alias("size"))
    shared = materialise(held.join(broadcast_if_bounded(often, BROADCAST_ROWS), "leaf").select("doc_id", "leaf", "hub"))
    # k leaves in common are at least COPY_SIMILARITY of either set
    able = shared.groupBy("doc_id").agg(F.count("*").alias("n")).join(size, "doc_id").where(
        F.col("n") >= COPY_SIMILARITY * F.col("size")).select("doc_id", "size")
    able = materialise(able)
    rows = shared.join(able, "doc_id")
    best = (rows.where("hub <> doc_id").groupBy("doc_id", "size", "hub").agg(F.count("*").alias("n"))
            .groupBy("doc_id", "size").agg(F.max(F.struct("n", (-F.col("hub")).alias("hub"))).alias("m"))
            .select("doc_id", "size", (-F.col("m.hub")).alias("hub")))
    best = materialise(best.join(able.select(F.col("doc_id").alias("hub"), F.col("size").alias("hub_size")), "hub"))
    common = (rows.select("doc_id", "leaf").join(best, "doc_id")
              .join(shared.select(F.col("doc_id").alias("hub"), "leaf"), ["hub", "leaf"])
              .groupBy("doc_id", "hub", "size", "hub_size").agg(F.count("*").alias("k")))
    links = common.where(F.col("k") >= COPY_SIMILARITY * (F.col("size") + F.col("hub_size") - F.col("k")))
    groups = connected_components(links.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
    return groups.select(F.col("node").alias("doc_id"), F.col("component").alias("witness"))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, positions): the sorted line numbers, from 0, that each document loses."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(
        "doc_id is not null and text is not null")
    lines = materialise(_lines(src).select("doc_id", "pos", _leaf().alias("leaf"), F.xxhash64("masked").alias("line")))
    # the first step spreads a hot leaf over its documents
    held = materialise(lines.select("doc_id", "leaf").distinct())
    often = materialise(held.groupBy("leaf").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("leaf"))
    copies = materialise(copy_groups(held))
    shared = lines.join(broadcast_if_bounded(often, BROADCAST_ROWS), "leaf")
    shared = shared.join(broadcast_if_bounded(copies, BROADCAST_ROWS), "doc_id", "left").withColumn(
        "witness", F.coalesce("witness", "doc_id"))
    known = materialise(shared.groupBy("leaf", "line", "witness").agg(F.min(F.struct("doc_id", "pos")).alias("at")))
    leaves = materialise(known.select("leaf", "witness").distinct().groupBy("leaf").agg(F.count("*").alias("docs"))
                         .where(F.col("docs") >= min_docs).select("leaf"))
    known = known.join(broadcast_if_bounded(leaves, BROADCAST_ROWS), "leaf")
    seen = materialise(known.groupBy("leaf", "line").agg(F.count("*").alias("docs"), F.min("at").alias("at")))
    share = (known.select("leaf", "line", "witness").join(seen.select("leaf", "line", "docs"), ["leaf", "line"])
             .groupBy("leaf", "witness").agg(F.max(F.struct("docs", "line")).alias("m"))
             .groupBy("leaf", F.col("m.line").alias("line")).agg(F.count("*").alias("share")))
    counts = materialise(seen.join(share, ["leaf", "line"], "left").select(
        "leaf", "line", "docs", F.coalesce("share", F.lit(0)).alias("share"), F.col("at.doc_id").alias("doc_id"),
        F.col("at.pos").alias("pos")))

    # the text of each distinct line of those leaves, read at its first place
    holders = src.join(broadcast_if_bounded(counts.select("doc_id").distinct(), BROADCAST_ROWS), "doc_id", "left_semi")
    texts = _lines(holders).select("doc_id", "pos", "masked")
    words = materialise(texts.join(counts, ["doc_id", "pos"])
                        .select("leaf", "line", "docs", "share", F.posexplode(F.split("masked", " ")).alias("at", "token")))
    enough = F.greatest(F.sum("share"), F.max("docs")) >= min_docs
    fixed = (words.where(F.col("token") != VARIABLE).groupBy("leaf", "at", "token").agg(enough.alias("enough"))
             .where("enough").drop("enough"))
    parsed = words.join(fixed.withColumn("fixed", F.lit(1)), ["leaf", "at", "token"], "left")
    parsed = (parsed.groupBy("leaf", "line", "docs", "share")
              .agg(F.count("*").alias("n"), F.count("fixed").alias("n_fixed"),
                   F.sum(F.when(F.col("fixed") == 1, F.xxhash64("at", "token").cast("decimal(38,0)"))).alias("shape")))
    parsed = materialise(parsed.where((F.col("docs") >= min_docs) | (F.col("n_fixed") >= SIMILARITY * F.col("n"))))
    template = ["leaf", "n_fixed", "shape"]
    proven = parsed.groupBy(*template).agg(enough.alias("enough")).where("enough").drop("enough")
    dropped = materialise(parsed.join(proven, template).select("leaf", "line"))
    hit = lines.join(broadcast_if_bounded(dropped, BROADCAST_ROWS), ["leaf", "line"], "left_semi")
    return hit.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with recurring lines cut out of the text, and n_lines, n_dropped added
    (they replace columns of the same name).

    Every row stays. A document that would lose all its text stays whole (a copy
    stage decides on it). Lines are split at \\n only; empty lines and lines of fewer
    than ``MIN_TOKENS`` tokens are never dropped. A null text stays null, with no lines; an empty
    text has one empty line. Rows with a null id stay as they are. Ids must be unique."""
    require_columns(docs, [id_col, text_col], "drop_recurring_lines")
    own = {c: W.free_name(docs.columns, f"__{c}") for c in ("id", "cut", "lines", "left")}
    ID, CUT, LINES, LEFT = own["id"], own["cut"], own["lines"], own["left"]
    cuts = recurring_lines(docs, id_col, text_col, min_docs).select(
        F.col("doc_id").alias(ID), F.col("positions").alias(CUT))
    none = F.array().cast("array<int>")
    lines, cut = F.split(F.col(text_col).cast("string"), "\n", -1), F.coalesce(CUT, none)
    # the runs of lines between two cuts: linear however many cuts there are
    runs = F.transform(F.sequence(F.lit(0), F.size(CUT)), lambda i: F.slice(
        LINES, F.when(i == 0, F.lit(1)).otherwise(F.get(CUT, i - 1) + 2),
        F.coalesce(F.get(CUT, i), F.size(LINES)) - F.when(i == 0, F.lit(0)).otherwise(F.get(CUT, i - 1) + 1)))
    out = docs.join(cuts, docs[id_col] == F.col(ID), "left").drop(ID)
    out = out.withColumn(LINES, lines).withColumn(CUT, cut)
    left = F.when(F.size(CUT) == 0, F.col(text_col)).otherwise(F.array_join(F.flatten(runs), "\n"))
    whole = F.trim(F.regexp_replace(LEFT, r"\s+", " ")) == ""
    out = out.withColumn(LEFT, left).withColumn(CUT, F.when((F.size(CUT) > 0) & whole, none).otherwise(F.col(CUT)))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*[F.when(F.size(CUT) > 0, F.col(LEFT)).otherwise(F.col(c)).alias(c)
                        if c == text_col else F.col(c) for c in names],
                      F.when(F.col(text_col).isNull(), 0).otherwise(F.size(LINES)).cast("long").alias("n_lines"),
                      F.size(CUT).cast("long").alias("n_dropped"))
