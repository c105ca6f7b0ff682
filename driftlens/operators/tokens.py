"""Fixed-length token windows over whole texts, and a truncation report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_TOKENS, PAD_TOKEN, TOKEN_PATTERN


def tokenize(text) -> Column:
    """Lower-cased runs of letters or digits over the whole text; missing
    text gives no tokens."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(TOKEN_PATTERN), 0)


def token_windows(df: DataFrame, text: str = "text", max_tokens: int = MAX_TOKENS,
                  pad: str = PAD_TOKEN) -> DataFrame:
    """Adds ``tokens`` (the window: first ``max_tokens`` tokens, padded),
    ``mask`` (1 for real tokens), ``n_tokens`` (all tokens of the text),
    ``n_kept`` and ``truncated``."""
    toks = tokenize(text)
    out = df.withColumn("_all", toks)
    kept = F.slice("_all", 1, max_tokens)
    out = out.withColumns({"n_tokens": F.size("_all"), "_kept": kept})
    n_kept = F.size("_kept")
    n_pad = F.lit(max_tokens) - n_kept
    return (out.withColumns({
                "n_kept": n_kept,
                "truncated": F.col("n_tokens") > F.lit(max_tokens),
                "tokens": F.concat(F.col("_kept"), F.array_repeat(F.lit(pad), n_pad)),
                "mask": F.concat(F.array_repeat(F.lit(1), n_kept), F.array_repeat(F.lit(0), n_pad)),
            }).drop("_all", "_kept"))


def truncation_report(windows: DataFrame, by: str = "dataset") -> DataFrame:
    return windows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("truncated").cast("long")).alias("n_truncated"),
        F.sum(F.col("n_tokens").cast("long")).alias("tokens_total"),
        F.sum(F.col("n_kept").cast("long")).alias("tokens_kept"),
        F.avg(F.col("truncated").cast("double")).alias("share_truncated"))
