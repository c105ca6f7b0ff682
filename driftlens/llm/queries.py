"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .scratch import scratch_path
from . import (language, lattice, licenses, line_templates, main_text, pieces, positional_index, runs, superminhash,
               token_files, toxicity, url_rules, vector_codes)


def held_out() -> F.Column:
    """Rows that no fit may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    found = positional_index.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    model = toxicity.fit(docs, labels.where(~held_out()))
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted", "evidence_ids", "evidence_cosines")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    model = language.fit(docs.where(~held_out()))
    return language.predict(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    left = line_templates.drop_recurring_lines(docs)
    return left.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    both = pieces.decode(pieces.encode(docs))
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(chr(pieces.MARK)), F.lit(" "))
    return both.select("doc_id", "n_pieces", F.xxhash64("piece_ids").alias("ids_xxh64"),
                       F.length("decoded").cast("long").alias("n_chars"),
                       (F.col("decoded") == plain).alias("round_trip"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(read_table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return superminhash.near_duplicates(docs)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents", ["doc_id", "text"])).select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), "licenses", "scores", "span_starts", "span_ends")


URL_RULES = [
    url_rules.Rule("org", "/", "allow"), url_rules.Rule("example.org", "/es/", "block"),
    url_rules.Rule("example.org", "/en/1", "block"), url_rules.Rule("com", "/fr/", "allow"),
    url_rules.Rule("com", "/de/", "block")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    bad = labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    return url_rules.judge(read_table(spark, sf_dir, "pages", ["page_id", "url"]), bad, URL_RULES)


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in which every tenth document, by the crc32 of its decimal id,
    goes on from word ``a`` in copies of its next ``p`` words, as the query's contract says."""
    h, n = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.size("w").cast("long")
    chosen = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
    g = F.floor(F.col("h") / 10)
    rest = F.col("n") - F.col("a")
    unit = F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    tail = F.flatten(F.array_repeat(unit, F.ceil(rest / F.col("p")).cast("int")))
    new = F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), F.slice(tail, F.lit(1), rest.cast("int")))
    return (docs.select("doc_id", "text", h.alias("h")).withColumn("w", chosen)
            .withColumn("n", F.when(F.col("w").isNotNull(), n))
            .withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
            .withColumn("p", 1 + F.floor(rest / (3 + g % 8)))
            .select("doc_id", F.when(F.col("n") > 0, F.array_join(new, " ")).otherwise(F.col("text")).alias("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_repeats(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"),
                                                             (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return (runs.collapse(docs, keep=["doc_id"]).withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
                    F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
                    F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]))
    return vector_codes.with_label_error(codes).select(
        "vec_id", "code", "error", "label_error",
        F.sha2(F.lit(vector_codes.codebook_text(books)).cast("binary"), 256).alias("codebooks_sha256"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    files = token_files.write(docs, scratch_path(spark, "tokens"))
    return token_files.documents(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_line_dedup": op5_line_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_html_extraction": op7_html_extraction,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_url_filter": op10_url_filter,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_files": op13_token_files,
}
