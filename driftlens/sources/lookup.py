"""Ranked id list -> item lookup, and issue-list scans.

The reference fetched one item per id over HTTP; here the item store is a
table, and the N lookups become one join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonx import has_key
from ..functions.text import compose


def ranked_lookup(ids: DataFrame, items: DataFrame, id_col: str = "id",
                  order_cols=("pos",), limit: int | None = None,
                  title: str | None = "title", text: str = "text",
                  sep: str = " ") -> DataFrame:
    """Items for the first ``limit`` entries of a ranked id list.

    Duplicated ids yield the item once per listing; ids without an item
    (a null lookup) and items whose composed text is empty are skipped. The
    list's order columns are carried so the result can be ordered the same
    way. The last of them is the 0-based place in the list, so the cut at
    ``limit`` is a filter on it."""
    order = list(order_cols)
    if limit is not None:
        ids = ids.filter(F.col(order[-1]) < limit)
    ttl = F.col(title) if title and title in items.columns else F.lit(None).cast("string")
    found = items.withColumn("_text", compose(ttl, F.col(text), sep))
    joined = ids.select(*order, id_col).join(found, id_col, "inner")
    return (joined.filter(F.col("_text") != "")
                  .drop(text).withColumnRenamed("_text", text))


_STRICT = {"mode": "FAILFAST"}


def read_json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON array files, one row (``file``, ``value``) per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def issue_lists(lists: DataFrame, list_col: str = "value", keep=(), state: str | None = "open",
                per_page: int | None = 50) -> DataFrame:
    """The objects of each JSON array as raw text (``json``, so that a key with a null
    value stays observable) with their place ``pos``.

    As the source does it per response: the state filter, then the cap of ``per_page``
    objects of each list. An array that does not parse fails the job."""
    objs = F.transform(F.from_json(list_col, "array<string>", _STRICT),
                       lambda x, i: F.struct(i.alias("pos"), x.alias("json")))
    if state is not None:
        objs = F.filter(objs, lambda x: F.from_json(x["json"], "state string", _STRICT)["state"] == state)
    if per_page is not None:
        objs = F.slice(objs, 1, per_page)
    return lists.select(*keep, F.inline(objs))


ISSUE_DDL = ("id long, number long, title string, body string, state string, "
             "comments long, user struct<login: string>, html_url string")


def issue_scan(objs: DataFrame, json_col: str = "json", order_cols=("pos",)) -> DataFrame:
    """Issue objects -> issue rows: objects with a ``pull_request`` key are dropped,
    title and body are composed, and empty texts dropped. ``user.login`` is NULL when
    ``user`` is null or absent; an object that does not parse fails the job."""
    kept = (objs.filter(~has_key(json_col, "pull_request"))
                .withColumn("_j", F.from_json(F.col(json_col), ISSUE_DDL, _STRICT)))
    out = kept.select(
        *order_cols,
        F.col("_j.id").alias("id"), F.col("_j.number").alias("number"),
        compose(F.col("_j.title"), F.col("_j.body"), "\n\n").alias("text"),
        F.col("_j.state").alias("state"), F.col("_j.comments").alias("comments"),
        F.col("_j.user.login").alias("user"), F.col("_j.html_url").alias("html_url"))
    return out.filter(F.col("text") != "")
