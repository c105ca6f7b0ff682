"""Inputs derived from the driver tables for the registered queries.

The driver tables carry no label strings, issue objects or NA tokens, so
the cleaning and ingest queries run on columns derived row by row from
``documents``, ``labels`` and ``conversations``. Every row of the source
table is used; the derivation only chooses which *shape* a row takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table


def _m(c: str, k: int):
    return F.pmod(F.col(c), F.lit(k))


def conversation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per conversation turn: the turn's text is the title and the
    next turn's text (if any) the body. The pairing is an equi-join on
    ``(conv_id, turn)``, so rows are hash-partitioned on both columns and a
    very long conversation is spread over many tasks (a window per
    conversation would put it in one)."""
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    title = conv.select("conv_id", "turn", F.col("text").alias("title"))
    body = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("body"))
    return title.join(body, ["conv_id", "turn"], "left")


def label_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ``labels`` string per document, in one of nine shapes by ``doc_id % 9``:
    list, two-element list, whitespace-padded scalar, blank, NULL, empty list,
    spaced list with trailing comma, unclosed list, decimal scalar."""
    d = read_table(spark, sf_dir, "documents", ["doc_id"])
    k = _m("doc_id", 28).cast("string")
    k2 = F.pmod(F.col("doc_id") + 3, F.lit(28)).cast("string")
    j = _m("doc_id", 5).cast("string")
    shape = _m("doc_id", 9)
    s = (F.when(shape == 0, F.concat(F.lit("["), k, F.lit("]")))
          .when(shape == 1, F.concat(F.lit("["), k, F.lit(", "), k2, F.lit("]")))
          .when(shape == 2, F.concat(F.lit("\t"), k, F.lit("\n")))
          .when(shape == 3, F.lit(""))
          .when(shape == 4, F.lit(None).cast("string"))
          .when(shape == 5, F.lit("[]"))
          .when(shape == 6, F.concat(F.lit("[ "), k, F.lit(" ,"), j, F.lit(",]")))
          .when(shape == 7, F.concat(F.lit("["), k, F.lit(",")))
          .otherwise(F.concat(k, F.lit(".5"))))
    return d.select("doc_id", s.alias("labels"))


# Values a CSV round trip may leave in a cell, by ``doc_id % 11`` (9 and 10 keep the
# document's source).
NA_SHAPES = (None, "NA", "null", "None", "none", " ", "", "nan", "n/a")


def na_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of every document beside a ``cell`` of some NA shape."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    shape = _m("doc_id", 11)
    cell = F.col("source")
    for i in reversed(range(len(NA_SHAPES))):
        cell = F.when(shape == i, F.lit(NA_SHAPES[i]).cast("string")).otherwise(cell)
    return d.select("doc_id", "text", F.col("lang").alias("label"), cell.alias("cell"))


def issue_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An issue object per document: the source as title and the whole text as body.
    ``user`` is null when ``doc_id % 11 == 0``, absent when ``% 13 == 0``;
    ``pull_request`` is a JSON null when ``% 7 == 0`` and an object when ``% 5 == 0``."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source", "n_chars"])
    state = F.when(_m("n_chars", 2) == 0, F.lit("open")).otherwise(F.lit("closed"))
    core = F.to_json(F.struct(
        F.col("doc_id").alias("id"), (F.col("doc_id") + 1).alias("number"), F.col("source").alias("title"),
        F.col("text").alias("body"), state.alias("state"), _m("n_chars", 50).alias("comments")))
    user = (F.when(_m("doc_id", 11) == 0, F.lit(',"user":null'))
             .when(_m("doc_id", 13) == 0, F.lit(""))
             .otherwise(F.concat(F.lit(',"user":'), F.to_json(F.struct(F.col("source").alias("login"))))))
    pull = (F.when(_m("doc_id", 7) == 0, F.lit(',"pull_request":null'))
             .when(_m("doc_id", 5) == 0, F.concat(F.lit(',"pull_request":'), F.to_json(F.struct(
                 F.concat(F.lit("pr/"), F.col("doc_id").cast("string")).alias("url")))))
             .otherwise(F.lit("")))
    js = F.concat(F.substring(core, F.lit(1), F.length(core) - 1), user, pull, F.lit("}"))
    return d.select(F.col("doc_id").alias("pos"), js.alias("json"))


def document_pages(spark: SparkSession, sf_dir: str, page_size: int) -> DataFrame:
    """Documents as landed pages: ``doc_id`` is the row's offset in the
    source, so it sits on page ``doc_id div page_size`` at position
    ``doc_id mod page_size`` (no window, no shuffle)."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    return d.select("*", F.floor(F.col("doc_id") / F.lit(page_size)).cast("long").alias("page"),
                    F.pmod(F.col("doc_id"), F.lit(page_size)).cast("long").alias("pos"))


def ranked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranked id list: every labelled document by id (list 0), the toxic
    ones listed again (list 1, duplicates) and one id with no item (list 2)."""
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])

    def entry(list_no: int):
        return F.struct(F.lit(list_no).alias("list_no"), F.col("doc_id").alias("pos"),
                        F.col("doc_id").alias("id"))
    # One scan: each row is listed once, and a toxic row a second time.
    entries = F.array(entry(0), F.when(F.col("toxic") == 1, entry(1)))
    listed = lab.select(F.inline(F.filter(entries, lambda e: e.isNotNull())))
    missing = spark.range(1).select(F.lit(2).alias("list_no"), F.lit(0).cast("long").alias("pos"),
                                    F.lit(-1).cast("long").alias("id"))
    return listed.unionByName(missing)


def document_envelopes(spark: SparkSession, sf_dir: str, page_size: int) -> DataFrame:
    """Documents landed as paged JSON envelopes ``{"rows": [{"row": {...}}]}``,
    one per page of ``page_size`` consecutive ids (a group bounded by the
    page size), rows in id order."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    page = F.floor(F.col("doc_id") / F.lit(page_size)).cast("long")
    rows = F.array_sort(F.collect_list(F.struct(
        F.col("doc_id").alias("k"), F.struct(F.col("doc_id").alias("id"), "text", "lang").alias("row"))))
    env = d.groupBy(page.alias("page")).agg(rows.alias("r"))
    return env.select("page", F.to_json(F.struct(
        F.transform("r", lambda x: F.struct(x.getField("row").alias("row"))).alias("rows"))).alias("value"))


def issue_arrays(spark: SparkSession, sf_dir: str, per_page: int) -> DataFrame:
    """The issue objects of ``issue_json`` landed as JSON arrays of
    ``per_page`` objects (groups bounded by ``per_page``)."""
    js = issue_json(spark, sf_dir)
    page = F.floor(F.col("pos") / F.lit(per_page)).cast("long")
    arr = F.array_sort(F.collect_list(F.struct("pos", "json")))
    return (js.groupBy(page.alias("page")).agg(arr.alias("a"))
              .select("page", F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x.getField("json")), ", "),
                                       F.lit("]")).alias("value")))
