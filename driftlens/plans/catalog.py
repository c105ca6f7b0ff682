"""Query catalog: one entry per operator key, each ``(spark, sf_dir) -> DataFrame``.

Each query binds an operator to the driver tables through the standard
views. Doubles are rounded to 6 places at this edge only, so that the
result can be compared with the SQL oracle; the operators themselves keep
full precision."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..constants import DATASETS, PREVIEW_ROWS, TOP_K, TOP_STATS
from ..operators import metrics as M
from ..operators import shift as S
from ..sources.tables import read_table
from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The registered confusion reports use k=5: the scored view has 10 labels,
# so the reference's default of 10 would make the top-k filter a no-op.
CONFUSION_K = 5
# Label domain of the scored view and the two labels kept apart by the
# grouped-share report (the reference keeps 27 and 0 of a 28-label space).
SCORED_LABELS = 10
GROUP_LABELS = (9, 0)


def r6(df: DataFrame) -> DataFrame:
    """Round every floating column to 6 places (comparison edge only)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), 6).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(key: str):
    def deco(fn: Query) -> Query:
        QUERIES[key] = fn
        return fn
    return deco


# The evaluation reports run over every scored row, one report per dataset
# (the in-domain report is the rows with dataset = 'indomain').
BY = ["dataset"]


def _scored(spark, sf_dir):
    return views.scored(spark, sf_dir)


# ---- evaluation over the predictions, per dataset --------------------------------------

@register("label_stats")
def q_label_stats(spark, sf_dir):
    return r6(M.label_stats(_scored(spark, sf_dir), by=BY))


@register("label_stats_top10")
def q_label_stats_top10(spark, sf_dir):
    stats = M.label_stats(views.sources(spark, sf_dir), by=BY, sort=False)
    return r6(M.top_n(stats, PREVIEW_ROWS, group=BY))


@register("top_label_stats")
def q_top_label_stats(spark, sf_dir):
    stats = M.label_stats(_scored(spark, sf_dir), label_name="gold_label", by=BY, sort=False)
    return r6(M.top_n(stats, TOP_STATS, label_name="gold_label", group=BY))


@register("topk_labels")
def q_topk_labels(spark, sf_dir):
    return M.topk_labels(views.sources(spark, sf_dir), TOP_K, col="gold", by=BY)


@register("overall_accuracy")
def q_overall_accuracy(spark, sf_dir):
    return r6(M.overall_accuracy(_scored(spark, sf_dir), by=BY))


@register("correct_flag")
def q_correct_flag(spark, sf_dir):
    return M.correct_flag(_scored(spark, sf_dir)).select("row_id", "dataset", "gold", "pred_label",
                                                          "correct")


@register("num_labels")
def q_num_labels(spark, sf_dir):
    return M.num_labels(_scored(spark, sf_dir), "gold", by=BY)


@register("macro_f1")
def q_macro_f1(spark, sf_dir):
    return r6(M.macro_f1(_scored(spark, sf_dir), by=BY))


@register("argmax")
def q_argmax(spark, sf_dir):
    return views.scored(spark, sf_dir).select("row_id", "pred_label")


@register("score_softmax")
def q_score_softmax(spark, sf_dir):
    return r6(views.scored(spark, sf_dir)
              .select("row_id", "gold", "dataset", "pred_label", "pred_confidence"))


@register("value_counts")
def q_value_counts(spark, sf_dir):
    return M.value_counts(views.scored(spark, sf_dir), "pred_label", by=["dataset"])


@register("gold_pred_join")
def q_gold_pred_join(spark, sf_dir):
    gold = read_table(spark, sf_dir, "embeddings", ["vec_id", "label"]).select(
        F.col("vec_id").alias("row_id"), F.col("label").cast("int").alias("gold"))
    pred = views.scored(spark, sf_dir).select("row_id", "dataset", "pred_label", "pred_confidence")
    return r6(M.gold_pred_join(gold, pred, "row_id"))


@register("gold_pred_positional")
def q_gold_pred_positional(spark, sf_dir):
    """Gold labels in Parquet files and predictions in CSV files, cut at other rows, side
    by side by the place of each row."""
    from ..session import cut_lineage, ensure_checkpoint_dir, remove_path
    from ..sources import positions as PO
    out = f"{ensure_checkpoint_dir(spark)}/positional-{uuid.uuid4().hex}"
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "label"])
    PO.write_in_order(emb.select("vec_id", F.col("label").cast("int").alias("gold")), f"{out}/gold", "vec_id", 3)
    PO.write_in_order(views.scored(spark, sf_dir).select("row_id", "dataset", "pred_label", "pred_confidence"),
                      f"{out}/pred", "row_id", 5, "csv")
    try:
        gold = PO.number_parquet(spark, f"{out}/gold", ["gold"])
        pred = PO.number_csv(spark, f"{out}/pred", "row_id long, dataset string, pred_label int, pred_confidence double",
                             required=["row_id", "pred_label"])
        return cut_lineage(r6(M.gold_pred_positional(gold, pred)))
    finally:
        remove_path(spark, out)


# ---- domain-shift reports -------------------------------------------------------------

@register("label_distribution")
def q_label_distribution(spark, sf_dir):
    return r6(S.label_distribution(views.scored(spark, sf_dir)))


@register("dist_outer_join")
def q_dist_outer_join(spark, sf_dir):
    return r6(S.wide_distribution(S.label_distribution(views.scored(spark, sf_dir), sort=False), DATASETS))


@register("label_groups")
def q_label_groups(spark, sf_dir):
    dist = S.label_distribution(views.scored(spark, sf_dir), sort=False)
    return r6(S.label_groups(dist, DATASETS, keep=GROUP_LABELS))


@register("dense_domain")
def q_dense_domain(spark, sf_dir):
    return S.dense_counts(views.scored(spark, sf_dir), SCORED_LABELS, DATASETS)


@register("dense_dist")
def q_dense_dist(spark, sf_dir):
    return r6(S.dense_distribution(views.scored(spark, sf_dir), SCORED_LABELS, DATASETS))


@register("dist_corr")
def q_dist_corr(spark, sf_dir):
    dense = S.dense_distribution(views.scored(spark, sf_dir), SCORED_LABELS, DATASETS)
    return r6(S.distribution_corr(dense, DATASETS))


@register("confusion_topk")
def q_confusion_topk(spark, sf_dir):
    return S.confusion_topk(_scored(spark, sf_dir), CONFUSION_K, by=BY).select(
        "dataset", "gold", "pred", "n")


@register("confusion_norm")
def q_confusion_norm(spark, sf_dir):
    conf = S.confusion_topk(_scored(spark, sf_dir), CONFUSION_K, by=BY)
    return r6(S.confusion_normalise(conf, by=BY).select("dataset", "gold", "pred", "n", "p"))


@register("confidence_hist")
def q_confidence_hist(spark, sf_dir):
    return r6(S.confidence_histogram(views.scored(spark, sf_dir), DATASETS))


@register("confidence_hist_shared")
def q_confidence_hist_shared(spark, sf_dir):
    """The same histogram with one set of edges for all datasets."""
    return r6(S.confidence_histogram(views.scored(spark, sf_dir), DATASETS, shared_edges=True))


# The sources of ``documents``, as a caller names its datasets.
SOURCES = tuple(f"src{i}" for i in range(20))


@register("shift_by_dataset")
def q_shift_by_dataset(spark, sf_dir):
    """Rows that each shift report counts when the datasets are the 20 sources: the
    distribution, the dense vectors and the histogram each hold every document."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "source", "n_chars"]).select(
        F.col("source").alias("dataset"), F.pmod("n_chars", F.lit(SCORED_LABELS)).cast("int").alias("pred_label"),
        (F.pmod("n_chars", F.lit(997)) / F.lit(997.0)).alias("pred_confidence"))
    dist = S.label_distribution(docs, sort=False).groupBy("dataset").agg(F.sum("n").alias("n_distribution"))
    dense = S.dense_counts(docs, SCORED_LABELS, SOURCES).groupBy("dataset").agg(F.sum("n").alias("n_dense"))
    hist = S.confidence_histogram(docs, SOURCES).groupBy("dataset").agg(F.sum("n").alias("n_histogram"))
    return dist.join(dense, "dataset", "full").join(hist, "dataset", "full")


# ---- cleaning ---------------------------------------------------------------------------

from ..constants import PAGE_SIZE  # noqa: E402
from ..operators import clean as C  # noqa: E402
from ..sources import lookup as L  # noqa: E402
from ..sources.paging import assemble_pages  # noqa: E402
from ..sources.union import union_datasets  # noqa: E402
from . import derived as D  # noqa: E402


@register("compose_title_text")
def q_compose_title_text(spark, sf_dir):
    items = D.conversation_items(spark, sf_dir)
    return C.compose_text(items, "title", "body", " ").select("conv_id", "turn", "text")


@register("compose_title_body")
def q_compose_title_body(spark, sf_dir):
    items = D.conversation_items(spark, sf_dir)
    return C.compose_text(items, "title", "body", "\n\n").select("conv_id", "turn", "text")


@register("drop_empty_text")
def q_drop_empty_text(spark, sf_dir):
    items = C.compose_text(D.conversation_items(spark, sf_dir), "title", "body", "\n\n")
    return C.drop_empty_text(items).select("conv_id", "turn", "text")


@register("json_key_absent")
def q_json_key_absent(spark, sf_dir):
    out = L.issue_scan(D.issue_json(spark, sf_dir))
    return out.select("id", "number", "text", "state", "comments", "user")


@register("json_nested")
def q_json_nested(spark, sf_dir):
    js = D.issue_json(spark, sf_dir)
    p = C.project_json(js, "json", L.ISSUE_DDL)
    return p.select("id", F.col("user.login").alias("user"))


@register("json_project")
def q_json_project(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_id", "props"])
    return C.project_json(ev, "props", "k long, q string", keep=("event_id",))


@register("first_label")
def q_first_label(spark, sf_dir):
    return C.with_first_label(D.label_strings(spark, sf_dir), "labels", "label")


@register("label_parse_report")
def q_label_parse_report(spark, sf_dir):
    return C.label_parse_report(D.label_strings(spark, sf_dir), "labels")


@register("label_precedence")
def q_label_precedence(spark, sf_dir):
    derived = C.prepare_label(D.label_strings(spark, sf_dir)).select(
        F.lit("labels").alias("src"), "doc_id", "label")
    given = read_table(spark, sf_dir, "labels", ["doc_id", "quality"]).withColumnRenamed("quality", "label")
    given = C.prepare_label(given).select(F.lit("label").alias("src"), "doc_id", "label")
    return derived.unionByName(given)


@register("na_tokens")
def q_na_tokens(spark, sf_dir):
    return C.recognise_na(D.na_texts(spark, sf_dir), ["text", "cell"]).select("doc_id", "text", "cell")


@register("fill_text")
def q_fill_text(spark, sf_dir):
    df = C.recognise_na(D.na_texts(spark, sf_dir), ["text", "cell"])
    return C.fill_missing_text(C.fill_missing_text(df), "cell").select("doc_id", "text", "cell")


@register("drop_missing")
def q_drop_missing(spark, sf_dir):
    df = C.recognise_na(D.na_texts(spark, sf_dir), ["text", "cell"])
    return C.drop_missing(df, ["text", "cell", "label"]).select("doc_id", "text", "cell", "label")


# ---- ingest -----------------------------------------------------------------------------

@register("page_assembly")
def q_page_assembly(spark, sf_dir):
    rows = D.document_pages(spark, sf_dir, PAGE_SIZE)
    return assemble_pages(rows, PAGE_SIZE).select("row_index", "doc_id", "page", "pos",
                                                  "lang", "source", "text")


@register("page_assembly_feeds")
def q_page_assembly_feeds(spark, sf_dir):
    """Every conversation as a feed of two-turn pages, of which a pager that starts at
    the second turn fetches at most three turns."""
    turns = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    rows = turns.select("*", F.floor(F.col("turn") / F.lit(2)).cast("long").alias("page"),
                        F.pmod("turn", F.lit(2)).cast("long").alias("pos"))
    return assemble_pages(rows, 2, limit=3, offset=1, feed_cols=["conv_id"]).select(
        "conv_id", "row_index", "turn", "role", "text")


@register("ranked_lookup_limit")
def q_ranked_lookup_limit(spark, sf_dir):
    """The first 300 places of each ranked list."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"]) \
        .withColumnRenamed("doc_id", "id")
    out = L.ranked_lookup(D.ranked_ids(spark, sf_dir), docs, "id", ("list_no", "pos"), limit=300, title=None)
    return out.select("list_no", "pos", "id", "source", "text")


@register("ranked_lookup")
def q_ranked_lookup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"]) \
        .withColumnRenamed("doc_id", "id")
    out = L.ranked_lookup(D.ranked_ids(spark, sf_dir), docs, "id", ("list_no", "pos"),
                          title=None)
    return out.select("list_no", "pos", "id", "source", "text")


@register("json_envelope")
def q_json_envelope(spark, sf_dir):
    """Envelope pages -> rows -> in-order assembly, over every document."""
    from ..sources.paging import unwrap_envelope
    env = D.document_envelopes(spark, sf_dir, PAGE_SIZE)
    rows = unwrap_envelope(env, "value", "id long, text string, lang string", keep=("page",))
    return assemble_pages(rows, PAGE_SIZE).select("row_index", "page", "pos", "id", "lang", "text")


@register("issue_scan")
def q_issue_scan(spark, sf_dir):
    """Issue arrays of 50 -> the first 20 open ones of each -> those without a
    pull_request key."""
    objs = L.issue_lists(D.issue_arrays(spark, sf_dir, 50), keep=("page",), per_page=20)
    out = L.issue_scan(objs, order_cols=("page", "pos"))
    return out.select("page", "pos", "id", "number", "text", "comments", "user")


@register("csv_roundtrip")
def q_csv_roundtrip(spark, sf_dir):
    """Every document, text and all, and an NA-shaped cell, exported as CSV into the
    shared checkpoint folder, then scanned back with an explicit schema, the column
    contract and NA-token recognition. Real texts carry quotes, commas, blank lines and
    carriage returns, so this checks that the round trip is lossless apart from the NA
    tokens. The rows read back are checkpointed and the CSV folder is removed."""
    from ..session import cut_lineage, ensure_checkpoint_dir, remove_path
    from ..sources import files as FS
    path = f"{ensure_checkpoint_dir(spark)}/csv_roundtrip-{uuid.uuid4().hex}"
    try:
        FS.write_csv(D.na_texts(spark, sf_dir), path)
        back = FS.read_csv(spark, path, "doc_id long, text string, label string, cell string",
                           required=["doc_id", "text", "label", "cell"])
        return cut_lineage(back.select("doc_id", "text", "label", "cell"))
    finally:
        remove_path(spark, path)


@register("page_source")
def q_page_source(spark, sf_dir):
    """The documents landed as a file per page of 100, read back through the page source."""
    from ..session import cut_lineage, ensure_checkpoint_dir, remove_path
    from ..sources.page_source import read_pages
    path = f"{ensure_checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
    D.document_envelopes(spark, sf_dir, PAGE_SIZE).write.partitionBy("page").text(path)
    try:
        rows = read_pages(spark, path, "id long, text string, lang string", PAGE_SIZE)
        return cut_lineage(rows.select("row_index", "page", "pos", "id", "lang", "text"))
    finally:
        remove_path(spark, path)


@register("csv_quarantine")
def q_csv_quarantine(spark, sf_dir):
    """Documents exported as CSV, some with a length that is no number and some without a
    language, split into rows and rejects with their reasons."""
    from ..session import cut_lineage, ensure_checkpoint_dir, remove_path
    from ..sources import files as FS
    path = f"{ensure_checkpoint_dir(spark)}/quarantine-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "n_chars"])
    bad = F.col("n_chars").cast("string")
    cells = docs.select("doc_id", "text", F.when(F.pmod("doc_id", F.lit(5)) == 0, "NA").otherwise(F.col("lang")).alias("lang"),
                        F.when(F.pmod("doc_id", F.lit(7)) == 0, F.concat(bad, F.lit(" characters"))).otherwise(bad).alias("n_chars"))
    FS.write_csv(cells, f"{path}/in")
    try:
        q = FS.quarantine_csv(spark, f"{path}/in", "doc_id long, text string, lang string, n_chars long", f"{path}/out",
                              required=["doc_id", "lang"])
        both = q.rows.withColumn("reason", F.lit(None).cast("string")).unionByName(q.rejects.drop(FS.RECORD))
        return cut_lineage(both.select("doc_id", "lang", "n_chars", "reason", F.lit(q.counts["kept"]).cast("long").alias("n_kept"),
                                       F.lit(q.counts["rejected"]).cast("long").alias("n_rejected")))
    finally:
        remove_path(spark, path)


@register("sketch_report")
def q_sketch_report(spark, sf_dir):
    """Users and values of every event type from stored daily sketches, merged without the
    events, and whether they are within the stated errors of the exact figures."""
    from ..operators import sketches as SK
    from ..session import write_scratch
    ev = read_table(spark, sf_dir, "events", ["ts", "user_id", "event_type", "value"]).select(
        F.col("event_type").alias("dataset"), F.to_date("ts").alias("day"), F.col("user_id").alias("label"), "value")
    stored = write_scratch(SK.daily_sketches(ev, "label", "value"))
    got = SK.read_sketches(SK.merge_sketches(stored))
    exact = ev.groupBy("dataset").agg(F.countDistinct("label").alias("users"), F.count("value").alias("n_values"))
    # the rank of an estimated quantile among the exact values
    ranks = ev.join(F.broadcast(got.select("dataset", "q25", "q50", "q75")), "dataset").groupBy("dataset").agg(
        *[F.struct(F.avg((F.col("value") < F.col(q)).cast("double")).alias("below"),
                   F.avg((F.col("value") <= F.col(q)).cast("double")).alias("upto")).alias(q) for q in ("q25", "q50", "q75")])
    near = [(F.col(f"r.{q}.below") <= p + SK.RANK_ERROR) & (F.col(f"r.{q}.upto") >= p - SK.RANK_ERROR)
            for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
    out = got.join(exact, "dataset").join(ranks.select("dataset", F.struct("q25", "q50", "q75").alias("r")), "dataset")
    return r6(out.select("dataset", "n", "least", "most",
                         (F.abs(F.col("n_distinct") - F.col("users")) <= F.greatest(SK.DISTINCT_ERROR * F.col("users"), F.lit(1)))
                         .alias("distinct_ok"), (near[0] & near[1] & near[2]).alias("quantiles_ok")))


@register("load_report")
def q_load_report(spark, sf_dir):
    """What the load of the texts counts while it writes them."""
    from ..operators.observed import write_observed
    from ..session import ensure_checkpoint_dir, remove_path
    path = f"{ensure_checkpoint_dir(spark)}/load-{uuid.uuid4().hex}"
    try:
        return write_observed(views.texts(spark, sf_dir), path, DATASETS)
    finally:
        remove_path(spark, path)


@register("alignment_report")
def q_alignment_report(spark, sf_dir):
    """How the labels of some documents fit predictions (the text's parity of length) of all."""
    from ..operators.observed import write_aligned
    from ..session import ensure_checkpoint_dir, remove_path
    path = f"{ensure_checkpoint_dir(spark)}/aligned-{uuid.uuid4().hex}"
    gold = read_table(spark, sf_dir, "labels", ["doc_id", "quality"]).withColumnRenamed("quality", "gold")
    pred = read_table(spark, sf_dir, "documents", ["doc_id", "n_chars"]).select(
        "doc_id", F.pmod("n_chars", F.lit(2)).cast("int").alias("pred_label"))
    try:
        return write_aligned(gold, pred, path, key="doc_id")
    finally:
        remove_path(spark, path)


@register("dataset_union")
def q_dataset_union(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]) \
        .withColumnRenamed("doc_id", "id")
    conv = (read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
            .select(F.col("conv_id").alias("id"), "turn", "role", "text"))
    bench = read_table(spark, sf_dir, "benchmark", ["item_id", "text"]) \
        .withColumnRenamed("item_id", "id")
    u = union_datasets({"indomain": docs, "ood_a": conv, "ood_b": bench})
    return u.select("dataset", "id", "turn", "lang", "role",
                    F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_chars"))


# ---- classification ----------------------------------------------------------------------

from ..operators import epochs as EP  # noqa: E402
from ..operators import label_index as LI  # noqa: E402
from ..operators import mllib as ML  # noqa: E402
from ..operators import naive_bayes as NB  # noqa: E402
from ..operators import nb_long as NL  # noqa: E402
from ..operators import split as SP  # noqa: E402
from ..operators import subwords as SW  # noqa: E402
from ..operators import tokens as TK  # noqa: E402


def _training_rows(spark, sf_dir):
    t = views.texts(spark, sf_dir).filter(F.col("dataset") == "indomain")
    return C.drop_missing(t, ["text", "gold"])


def _plan(spark, sf_dir):
    return SP.plan_split(_training_rows(spark, sf_dir), "gold", "row_id")


def _split(spark, sf_dir):
    return _plan(spark, sf_dir).assign(_training_rows(spark, sf_dir))


def _nb_model(spark, sf_dir, plan=None):
    """The classifier of the training split; the plan's quotas give the documents of
    each class, so the texts are read once."""
    plan = plan or _plan(spark, sf_dir)
    train = plan.assign(_training_rows(spark, sf_dir)).filter(F.col("split") == "train")
    return NB.fit_nb(train, None, "gold", "text", class_docs=plan.train_docs(NB.MAX_CLASSES))


@register("stratified_split")
def q_stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("row_id", "gold", "split")


@register("split_sizes")
def q_split_sizes(spark, sf_dir):
    return SP.split_sizes(_split(spark, sf_dir), "gold")


@register("label_index")
def q_label_index(spark, sf_dir):
    return LI.label_index(_training_rows(spark, sf_dir), "gold").select("label", "label_idx", "n")


@register("token_window")
def q_token_window(spark, sf_dir):
    w = TK.token_windows(views.texts(spark, sf_dir))
    return w.select("row_id", "dataset", "n_tokens", "n_kept", "truncated",
                    F.array_join("tokens", " ").alias("window"))


@register("truncation_report")
def q_truncation_report(spark, sf_dir):
    return r6(TK.truncation_report(TK.token_windows(views.texts(spark, sf_dir))))


def _vocabulary(spark, sf_dir):
    """The words of the benchmark as pieces, and their characters."""
    bench = read_table(spark, sf_dir, "benchmark", ["text"])
    return SW.vocabulary_of(bench.select(F.explode(TK.tokenize("text")).alias("word")).distinct())


@register("subword_window")
def q_subword_window(spark, sf_dir):
    """Every text as a window of 128 subwords, two of them marks."""
    voc = _vocabulary(spark, sf_dir)
    w = SW.spelled(SW.subword_windows(views.texts(spark, sf_dir), voc, keep=("row_id", "dataset")), voc)
    return w.select("row_id", "dataset", "n_subwords", "n_unknown", "n_kept", "truncated",
                    F.array_join("pieces", " ").alias("window"))


@register("subword_report")
def q_subword_report(spark, sf_dir):
    return r6(SW.subword_report(SW.subword_windows(views.texts(spark, sf_dir), _vocabulary(spark, sf_dir), keep=("dataset",))))


@register("nb_model")
def q_nb_model(spark, sf_dir):
    return r6(_nb_model(spark, sf_dir).long_table("label"))


def _nb_scored(spark, sf_dir, docs=None, plan=None):
    model = _nb_model(spark, sf_dir, plan)
    docs = docs if docs is not None else views.texts(spark, sf_dir)
    return NB.score_nb(model, docs, keep=("dataset", "gold"))


@register("nb_predict")
def q_nb_predict(spark, sf_dir):
    return r6(_nb_scored(spark, sf_dir)
              .select("row_id", "dataset", "gold", "pred_label", "pred_confidence"))


@register("nb_long_model")
def q_nb_long_model(spark, sf_dir):
    """The sparse model of the training split: the gains of the pairs seen."""
    train = _split(spark, sf_dir).filter(F.col("split") == "train")
    return r6(NL.fit_nb_long(train, "gold", "text").long_table())


@register("nb_long_texts")
def q_nb_long_texts(spark, sf_dir):
    """The sparse model over the texts: the predictions of ``nb_predict``."""
    train = _split(spark, sf_dir).filter(F.col("split") == "train")
    return r6(NL.score_nb_long(NL.fit_nb_long(train, "gold", "text"), views.texts(spark, sf_dir),
                               keep=("dataset", "gold")))


@register("nb_long_predict")
def q_nb_long_predict(spark, sf_dir):
    """Every event attributed to one of thousands of (user, slot) classes."""
    rows = views.slots(spark, sf_dir)
    return r6(NL.score_nb_long(NL.fit_nb_long(rows), rows, keep=("gold",), distinct_texts=True))


@register("eval_metrics")
def q_eval_metrics(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    val = plan.assign(_training_rows(spark, sf_dir)).filter(F.col("split") == "val")
    return r6(M.evaluate(_nb_scored(spark, sf_dir, val, plan)))


@register("domain_shift")
def q_domain_shift(spark, sf_dir):
    s = _nb_scored(spark, sf_dir)
    c = F.col("gold").eqNullSafe(F.col("pred_label")).cast("long")
    return r6(s.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.sum(c).alias("n_correct"),
        F.avg(c.cast("double")).alias("accuracy"),
        F.avg("pred_confidence").alias("mean_confidence")))


@register("lr_fit")
def q_lr_fit(spark, sf_dir):
    """The MLlib classifier, scored over every text: rows per dataset, and whether the
    confidences are probabilities, the labels known ones and most of them right."""
    train = _split(spark, sf_dir).filter(F.col("split") == "train")
    model = ML.fit_lr(train, "gold", "text")
    known = model.stages[0].labels
    scored = ML.score_lr(model, views.texts(spark, sf_dir), keep=("row_id", "dataset", "gold"))
    right = F.col("gold").eqNullSafe(F.col("pred_label")).cast("double")
    return scored.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"),
        ((F.min("pred_confidence") > 0) & (F.max("pred_confidence") <= 1)).alias("confidence_ok"),
        F.min(F.col("pred_label").isin(list(known))).alias("labels_known"),
        (F.avg(right) >= 0.8).alias("accurate"))


# Classes of the scored view, its vectors' dimension, and the parameters of ``epoch_fit``.
EPOCH_PARAMS = {"epochs": 3, "batch": 16, "shards": 4, "rate": 2.0}
VECTOR_DIMS = 64


@register("epoch_batches")
def q_epoch_batches(spark, sf_dir):
    """The batches that training in epochs reads over all documents."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id"])
    return EP.training_plan(docs, "doc_id").groupBy("epoch", "shard", "batch").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("min_id"), F.sum(F.col("id") * F.col("place")).alias("order_sum"))


@register("epoch_fit")
def q_epoch_fit(spark, sf_dir):
    """Softmax regression trained on the in-domain vectors and measured on the others:
    losses and accuracies of every epoch."""
    rows = EP.dense_features(views.scored_vectors(spark, sf_dir), "embedding")
    model = EP.fit_epochs(rows.filter(F.col("dataset") == DATASETS[0]), VECTOR_DIMS, normal=False,
                          validation=rows.filter(F.col("dataset") != DATASETS[0]), **EPOCH_PARAMS)
    return r6(spark.createDataFrame([tuple(h.values()) for h in model.history],
                                    "epoch int, n_rows long, n_batches long, train_loss double, train_accuracy double, "
                                    "val_rows long, val_loss double, val_accuracy double"))


@register("epoch_texts")
def q_epoch_texts(spark, sf_dir):
    """Softmax regression over hashed words, trained in epochs on the training split:
    every text's label and confidence."""
    texts = EP.hashed_features(views.texts(spark, sf_dir))
    train = EP.hashed_features(_split(spark, sf_dir).filter(F.col("split") == "train"))
    model = EP.fit_epochs(train, EP.DIMS, rate=8.0)  # vectors of length 1 have small gradients
    return r6(EP.score_epochs(model, texts.drop("text")))


@register("pipeline_predictions")
def q_pipeline_predictions(spark, sf_dir):
    """Ingest, train and predict of the staged job: predictions keep their inputs."""
    from ..session import ensure_checkpoint_dir
    from . import pipeline as P
    out = P.fresh_dir(ensure_checkpoint_dir(spark))
    P.run(spark, sf_dir, out, stages=("ingest", "train", "predict"))
    pred = spark.read.parquet(f"{out}/predictions")
    return r6(pred.select("row_id", "dataset", "gold", "split", F.length("text").cast("long").alias("n_chars"),
                          "pred_label", "pred_confidence"))


# ---- external model scored in batches ----------------------------------------------------

from ..operators import external as EX  # noqa: E402


@register("batch_score")
def q_batch_score(spark, sf_dir):
    """The scored view's predictions recomputed through the batched
    external-model path; must equal ``score_softmax``."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    src = emb.select(F.col("vec_id").alias("row_id"), F.col("label").cast("int").alias("gold"),
                     views.dataset_of_row(F.col("vec_id")).alias("dataset"),
                     F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    out = EX.score_external(src, "x", EX.leading_logits_model(views.N_LOGITS, views.LOGIT_SCALE),
                            [64])
    return r6(out.select("row_id", "gold", "dataset", "pred_label", "pred_confidence"))
