"""URL filtering by given prefix rules and mined association rules, in DataFrame
operations only.

Given rules (host, path) come first: the longest one that fits decides. For the other
urls Spark's FP-growth mines the token combinations of the blocked labelled urls; how sure
they foretell a block is counted over all labelled urls, by their rarest token. Rules
pruned by support and confidence, and by any more general rule that is as sure, are
indexed by their rarest token too. Distinct token sets, not pages, are matched. Support is
a number of rows: the same labels give the same rule in a table of any size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checks import broadcast_if_bounded, require_columns
from .scratch import materialise

MIN_ROWS, MIN_CONFIDENCE = 20, 0.5   # blocked urls behind a rule, and their share of the urls that it fits
MAX_RULES = 1_000_000    # broadcast up to this many
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str   # allow or block


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path and tail (query and fragment); all empty for a null url
    or one without ``://``."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOW),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        "tail": F.regexp_extract(rest, r"^[^?#]*(.*)$", 1)})


def given_rule(rules: list[Rule]) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest rule that fits columns host and path, else nulls.
    Rules are a short list that a user writes down."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r.host, r.path)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name = F.when(fits, F.lit(r.host + r.path)) if name is None else name.when(fits, F.lit(r.host + r.path))
        verdict = F.when(fits, F.lit(r.verdict)) if verdict is None else verdict.when(fits, F.lit(r.verdict))
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def tokens() -> F.Column:
    """Sorted distinct tokens of a url: the host and its parents, path words with
    numbers folded, the file ending, query keys and whether there is a fragment."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)),
                        lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.filter(F.split(F.translate("path", _UPPER, _LOW), "[/]"), lambda x: x != "")
    words = F.transform(words, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.regexp_extract("tail", r"^\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""),
                       lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    mark = F.when(F.contains("tail", F.lit("#")), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>"))
    some = F.when(F.size(labels) > 0, hosts).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(some, words, keys, mark)))


def _with_anchor(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """``sets`` (antecedent) with the rarest of their tokens by ``counts`` (token, count)."""
    rarest = (sets.select("antecedent", F.explode("antecedent").alias("token")).join(counts, "token")
              .groupBy("antecedent").agg(F.min(F.struct("count", "token")).alias("m")))
    return sets.join(rarest.select("antecedent", F.col("m.token").alias("anchor")), "antecedent")


def mine(labelled: DataFrame, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(antecedent, confidence, support, anchor) of the block rules of ``labelled``
    (tokens array<string>, block boolean): token sets that ``min_rows`` blocked urls or
    more hold (support), and that foretell a block with ``min_confidence``. A null label
    or an empty token set teaches nothing."""
    schema = "antecedent array<string>, confidence double, support long, anchor string"
    items = materialise(labelled.where("block is not null and size(tokens) > 0").groupBy("tokens").agg(
        F.count("*").alias("n"), F.count_if("block").alias("n_block")))
    n = items.agg(F.sum("n_block")).first()[0] or 0
    if n < min_rows:
        return labelled.sparkSession.createDataFrame([], schema)
    blocked = items.select("tokens", F.explode(F.array_repeat(F.lit(1), F.col("n_block").cast("int")))).select("tokens")
    # half a row less, so that rounding does not ask for one row more
    fitted = FPGrowth(itemsCol="tokens", minSupport=(min_rows - 0.5) / n, minConfidence=1.0).fit(blocked)
    often = materialise(fitted.freqItemsets.select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("support")))
    counts = items.select(F.explode("tokens").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("count"))
    often = materialise(_with_anchor(often, counts))
    fits = (items.withColumn("anchor", F.explode("tokens")).join(broadcast_if_bounded(often, MAX_RULES), "anchor")
            .where(F.size(F.array_except("antecedent", "tokens")) == 0)
            .groupBy("antecedent", "support", "anchor").agg(F.sum("n").alias("n")))
    rules = materialise(fits.withColumn("confidence", F.col("support") / F.col("n")).where(
        F.col("confidence") >= min_confidence).select("antecedent", "confidence", "support", "anchor"))
    # a rule falls to a more general one that is as sure; both hold the general one's anchor
    general = rules.select(F.col("antecedent").alias("g"), F.col("confidence").alias("gc"), F.col("anchor").alias("token"))
    spread = rules.withColumn("token", F.explode("antecedent"))
    weaker = (spread.join(broadcast_if_bounded(general, MAX_RULES), "token")
              .where((F.size("g") < F.size("antecedent")) & (F.col("gc") >= F.col("confidence"))
                     & (F.size(F.array_except("g", "antecedent")) == 0))
              .select("antecedent").distinct())
    return rules.join(weaker, "antecedent", "left_anti").select("antecedent", "confidence", "support", "anchor")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``sets`` (distinct tokens) that some rule fits, with the surest one: tokens,
    antecedent, confidence. The index leads from a rule's rarest token to the rule."""
    found = (sets.withColumn("anchor", F.explode("tokens"))
             .join(broadcast_if_bounded(rules, MAX_RULES), "anchor")
             .where(F.size(F.array_except("antecedent", "tokens")) == 0))
    best = found.groupBy("tokens").agg(F.max(F.struct("confidence", "support", "antecedent")).alias("best"))
    return best.select("tokens", "best.antecedent", "best.confidence")


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url",
          label_id: str = "doc_id", min_rows: int = MIN_ROWS,
          min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per page: page_id, host, path, rule (given rule that decided, else null),
    verdict (allow or block), mined (antecedent of the mined rule that fits, else null)
    and confidence. Urls that no rule fits are allowed.

    ``labels`` has ``label_id`` and the boolean ``block``; several labels of a page count
    as block if one does. Null, empty and odd urls have no tokens and are allowed."""
    require_columns(pages, [id_col, url_col], "url pages")
    require_columns(labels, [label_id, "block"], "url labels")
    src = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    src = materialise(src.select("page_id", "host", "path", tokens().alias("tokens")))
    known = labels.select(F.col(label_id).alias("page_id"), "block").where("block is not null and page_id is not null").groupBy(
        "page_id").agg(F.max("block").alias("block"))
    mined = mine(src.join(known, "page_id").select("tokens", "block"), min_rows, min_confidence)
    sets = src.select("tokens").where(F.size("tokens") > 0).distinct()
    blocked = materialise(match(sets, materialise(mined)))
    out = src.join(broadcast_if_bounded(blocked, MAX_RULES), "tokens", "left")
    name, verdict = given_rule(rules)
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(
        verdict, F.when(F.col("antecedent").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.array_join("antecedent", " ").alias("mined"), "confidence")
