"""Independent DuckDB SQL for every query key that SQL can express.

Conventions shared with the Spark side: doubles rounded to 6 places,
counts BIGINT, labels INTEGER, ties broken by label ascending."""

from __future__ import annotations

# The ``scored`` standard view (see plans/views.py) as CTEs.
SCORED_CTE = """
s_0 AS (
  SELECT vec_id AS row_id, CAST(label AS INTEGER) AS gold,
         list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE) * 10.0) AS logits,
         CASE vec_id % 3 WHEN 0 THEN 'indomain' WHEN 1 THEN 'ood_a' ELSE 'ood_b' END AS dataset
  FROM embeddings),
s_1 AS (SELECT *, list_max(logits) AS m FROM s_0),
s_2 AS (SELECT *, list_transform(logits, lambda x: exp(x - m)) AS e FROM s_1),
scored AS (
  SELECT row_id, gold, dataset,
         CAST(list_position(logits, m) - 1 AS INTEGER) AS pred_label,
         list_max(list_transform(e, lambda x: x / list_sum(e))) AS pred_confidence
  FROM s_2)
"""

# The ``sources`` view.
SOURCES_CTE = """
scored AS (
  SELECT lang AS dataset, TRY_CAST(regexp_extract(source, '^src([0-9]+)$', 1) AS INTEGER) AS gold,
         CASE WHEN n_chars % 3 = 0 THEN gold ELSE CAST(n_chars % 20 AS INTEGER) END AS pred_label
  FROM documents)
"""

LABEL_STATS_SQL = """
SELECT dataset, gold AS label_id, CAST(count(*) AS BIGINT) AS support,
       round(avg(CAST(gold IS NOT DISTINCT FROM pred_label AS INTEGER)), 6) AS accuracy
FROM scored GROUP BY dataset, gold
"""

PER_LABEL_CTE = """
sides AS (
  SELECT dataset, gold AS label, 1 AS s,
         CAST(gold IS NOT DISTINCT FROM pred_label AS INTEGER) AS tp, 0 AS q FROM {src}
  UNION ALL
  SELECT dataset, pred_label AS label, 0 AS s, 0 AS tp, 1 AS q FROM {src}),
per_label AS (
  SELECT dataset, label, sum(s) AS support, sum(tp) AS tp, sum(q) AS predicted
  FROM sides WHERE label IS NOT NULL GROUP BY dataset, label)
"""

DIST_CTE = """
dist_n AS (
  SELECT dataset, pred_label AS label, count(*) AS n FROM scored
  WHERE pred_label IS NOT NULL GROUP BY dataset, pred_label),
dist AS (SELECT dataset, label, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY dataset) AS p FROM dist_n)
"""

DENSE_CTE = """
grid AS (
  SELECT d.dataset, CAST(l.label AS INTEGER) AS label
  FROM (VALUES ('indomain'), ('ood_a'), ('ood_b')) d(dataset),
       (SELECT range AS label FROM range(10)) l),
dn AS (
  SELECT dataset, pred_label AS label, count(*) AS n FROM scored
  WHERE pred_label BETWEEN 0 AND 9 GROUP BY dataset, pred_label),
dense AS (
  SELECT g.dataset, g.label, CAST(coalesce(dn.n, 0) AS BIGINT) AS n
  FROM grid g LEFT JOIN dn ON g.dataset = dn.dataset AND g.label = dn.label),
dense_p AS (
  SELECT dataset, label, n,
         coalesce(CAST(n AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY dataset), 0), 0.0) AS p
  FROM dense)
"""

CONF_CTE = """
gc AS (SELECT dataset, gold AS label, count(*) AS n FROM scored WHERE gold IS NOT NULL
       GROUP BY dataset, gold),
ranked AS (SELECT dataset, label,
                  row_number() OVER (PARTITION BY dataset ORDER BY n DESC, label) - 1 AS rnk FROM gc),
top AS (SELECT dataset, label FROM ranked WHERE rnk < {k}),
kept AS (SELECT s.dataset, s.gold, s.pred_label AS pred FROM scored s
         JOIN top tg ON tg.dataset = s.dataset AND tg.label = s.gold
         JOIN top tp ON tp.dataset = s.dataset AND tp.label = s.pred_label),
cnt AS (SELECT dataset, gold, pred, count(*) AS n FROM kept GROUP BY dataset, gold, pred),
conf AS (
  SELECT a.dataset, a.label AS gold, b.label AS pred, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
  FROM top a JOIN top b ON a.dataset = b.dataset
  LEFT JOIN cnt ON cnt.dataset = a.dataset AND cnt.gold = a.label AND cnt.pred = b.label)
"""

HIST_SQL = """
WITH {scored},
vals AS (SELECT dataset, CAST(pred_confidence AS DOUBLE) AS v FROM scored
         WHERE pred_confidence IS NOT NULL AND dataset IN ('indomain', 'ood_a', 'ood_b')),
st0 AS (SELECT dataset, min(v) AS vmin, max(v) AS vmax FROM vals GROUP BY dataset),
st AS (SELECT dataset,
              CASE WHEN vmin = vmax THEN vmin - 0.5 ELSE vmin END AS lo,
              CASE WHEN vmin = vmax THEN vmax + 0.5 ELSE vmax END AS hi FROM st0),
b0 AS (SELECT v.dataset, v.v, st.lo, st.hi,
              CAST(least(floor((v.v - st.lo) * (20.0 / (st.hi - st.lo))), 19) AS INTEGER) AS b0
       FROM vals v JOIN st USING (dataset)),
b1 AS (SELECT *, CASE WHEN v < (CASE WHEN b0 >= 20 THEN hi ELSE lo + b0 * ((hi - lo) / 20.0) END)
                      THEN b0 - 1 ELSE b0 END AS b1 FROM b0),
b2 AS (SELECT dataset,
              CASE WHEN v >= (CASE WHEN b1 + 1 >= 20 THEN hi ELSE lo + (b1 + 1) * ((hi - lo) / 20.0) END)
                        AND b1 <> 19 THEN b1 + 1 ELSE b1 END AS bin FROM b1),
cnt AS (SELECT dataset, bin, count(*) AS n FROM b2 GROUP BY dataset, bin),
grid AS (SELECT st.dataset, CAST(r.range AS INTEGER) AS bin,
                CASE WHEN r.range >= 20 THEN hi ELSE lo + r.range * ((hi - lo) / 20.0) END AS bin_lo,
                CASE WHEN r.range + 1 >= 20 THEN hi ELSE lo + (r.range + 1) * ((hi - lo) / 20.0) END AS bin_hi
         FROM st, range(20) r)
SELECT g.dataset, g.bin, round(g.bin_lo, 6) AS bin_lo, round(g.bin_hi, 6) AS bin_hi,
       CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN cnt ON cnt.dataset = g.dataset AND cnt.bin = g.bin
"""


def _w(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


ORACLE: dict[str, str] = {
    "label_stats": _w(SCORED_CTE) + LABEL_STATS_SQL,
    "label_stats_top10": _w(SOURCES_CTE, f"st AS ({LABEL_STATS_SQL})") + """
SELECT dataset, label_id, support, accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY support DESC, label_id) AS rn FROM st) t
WHERE rn <= 10
""",
    "top_label_stats": _w(SCORED_CTE, f"st AS ({LABEL_STATS_SQL})") + """
SELECT dataset, label_id AS gold_label, support, accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY support DESC, label_id) AS rn FROM st) t
WHERE rn <= 6
""",
    "topk_labels": _w(SOURCES_CTE) + """
SELECT dataset, label, n, CAST(rnk AS INTEGER) AS rank FROM (
  SELECT dataset, label, n, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, label) - 1 AS rnk
  FROM (SELECT dataset, gold AS label, CAST(count(*) AS BIGINT) AS n FROM scored
        WHERE gold IS NOT NULL GROUP BY dataset, gold) c) t
WHERE rnk < 10
""",
    "overall_accuracy": _w(SCORED_CTE) + """
SELECT dataset, CAST(count(*) AS BIGINT) AS n_total,
       CAST(coalesce(sum(CAST(gold IS NOT DISTINCT FROM pred_label AS INTEGER)), 0) AS BIGINT) AS n_correct,
       round(avg(CAST(gold IS NOT DISTINCT FROM pred_label AS INTEGER)), 6) AS accuracy
FROM scored GROUP BY dataset
""",
    "correct_flag": _w(SCORED_CTE) + """
SELECT row_id, dataset, gold, pred_label,
       CAST(gold IS NOT DISTINCT FROM pred_label AS INTEGER) AS correct
FROM scored
""",
    "num_labels": _w(SCORED_CTE)
        + "SELECT dataset, CAST(count(DISTINCT gold) AS BIGINT) AS num_labels FROM scored GROUP BY dataset",
    "macro_f1": _w(SCORED_CTE, PER_LABEL_CTE.format(src="scored")) + """
SELECT dataset,
       round(avg(coalesce(2.0 * tp / nullif(CAST(support + predicted AS DOUBLE), 0), 0.0)), 6) AS f1_macro,
       CAST(count(*) AS BIGINT) AS n_labels
FROM per_label GROUP BY dataset
""",
    "argmax": _w(SCORED_CTE) + "SELECT row_id, pred_label FROM scored",
    "score_softmax": _w(SCORED_CTE)
        + "SELECT row_id, gold, dataset, pred_label, round(pred_confidence, 6) AS pred_confidence FROM scored",
    "value_counts": _w(SCORED_CTE) + """
SELECT dataset, pred_label AS label, CAST(count(*) AS BIGINT) AS n
FROM scored WHERE pred_label IS NOT NULL GROUP BY dataset, pred_label
""",
    "gold_pred_join": _w(SCORED_CTE) + """
SELECT e.vec_id AS row_id, CAST(e.label AS INTEGER) AS gold, s.dataset, s.pred_label,
       round(s.pred_confidence, 6) AS pred_confidence
FROM embeddings e JOIN scored s ON s.row_id = e.vec_id
""",
    "label_distribution": _w(SCORED_CTE, DIST_CTE)
        + "SELECT dataset, label, CAST(n AS BIGINT) AS n, round(p, 6) AS p FROM dist",
    "dist_outer_join": _w(SCORED_CTE, DIST_CTE) + """
SELECT label,
       round(coalesce(max(CASE WHEN dataset = 'indomain' THEN p END), 0.0), 6) AS indomain,
       round(coalesce(max(CASE WHEN dataset = 'ood_a' THEN p END), 0.0), 6) AS ood_a,
       round(coalesce(max(CASE WHEN dataset = 'ood_b' THEN p END), 0.0), 6) AS ood_b
FROM dist GROUP BY label
""",
    "label_groups": _w(SCORED_CTE, DIST_CTE) + """
SELECT g.label_group,
       round(coalesce(sum(CASE WHEN d.dataset = 'indomain' THEN d.p END), 0.0), 6) AS indomain,
       round(coalesce(sum(CASE WHEN d.dataset = 'ood_a' THEN d.p END), 0.0), 6) AS ood_a,
       round(coalesce(sum(CASE WHEN d.dataset = 'ood_b' THEN d.p END), 0.0), 6) AS ood_b
FROM (VALUES ('9'), ('0'), ('others')) g(label_group)
LEFT JOIN (SELECT *, CASE WHEN label = 9 THEN '9' WHEN label = 0 THEN '0' ELSE 'others' END AS grp
           FROM dist) d ON d.grp = g.label_group
GROUP BY g.label_group
""",
    "dense_domain": _w(SCORED_CTE, DENSE_CTE) + "SELECT dataset, label, n FROM dense",
    "dense_dist": _w(SCORED_CTE, DENSE_CTE)
        + "SELECT dataset, label, n, round(p, 6) AS p FROM dense_p",
    "dist_corr": _w(SCORED_CTE, DENSE_CTE) + """
, rng AS (SELECT dataset, max(p) > min(p) AS varying FROM dense_p GROUP BY dataset),
gp AS (SELECT d.dataset, d.label, CASE WHEN r.varying THEN d.p END AS pv
       FROM dense_p d JOIN rng r USING (dataset))
SELECT a.dataset AS ds_a, b.dataset AS ds_b, round(corr(a.pv, b.pv), 6) AS corr
FROM gp a JOIN gp b ON a.label = b.label
GROUP BY a.dataset, b.dataset
""",
    "confusion_topk": _w(SCORED_CTE, CONF_CTE.format(k=5)) + "SELECT dataset, gold, pred, n FROM conf",
    "confusion_norm": _w(SCORED_CTE, CONF_CTE.format(k=5)) + """
SELECT dataset, gold, pred, n,
       round(coalesce(CAST(n AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY dataset, gold), 0), 0.0), 6) AS p
FROM conf
""",
    "confidence_hist": HIST_SQL.format(scored=SCORED_CTE.strip()),
}


# ---- cleaning and ingest ----------------------------------------------------------------

# Python's white space, written out here: the oracle takes nothing from the package.
WS = "(" + " || ".join(f"chr({c})" for c in (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000)) + ")"


def _strip(x: str) -> str:
    return f"trim({x}, {WS})"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CONV_ITEMS_CTE = """
items AS (
  SELECT t.conv_id, t.turn, t.text AS title, b.text AS body
  FROM conversations t
  LEFT JOIN conversations b ON b.conv_id = t.conv_id AND b.turn = t.turn + 1)
"""

LABEL_STRINGS_CTE = """
ls AS (
  SELECT doc_id,
    CASE doc_id % 9
      WHEN 0 THEN '[' || CAST(doc_id % 28 AS VARCHAR) || ']'
      WHEN 1 THEN '[' || CAST(doc_id % 28 AS VARCHAR) || ', ' || CAST((doc_id + 3) % 28 AS VARCHAR) || ']'
      WHEN 2 THEN chr(9) || CAST(doc_id % 28 AS VARCHAR) || chr(10)
      WHEN 3 THEN ''
      WHEN 4 THEN NULL
      WHEN 5 THEN '[]'
      WHEN 6 THEN '[ ' || CAST(doc_id % 28 AS VARCHAR) || ' ,' || CAST(doc_id % 5 AS VARCHAR) || ',]'
      WHEN 7 THEN '[' || CAST(doc_id % 28 AS VARCHAR) || ','
      ELSE CAST(doc_id % 28 AS VARCHAR) || '.5'
    END AS labels
  FROM documents),
lab AS (
  SELECT doc_id, labels,
    CASE doc_id % 9 WHEN 2 THEN 'scalar' WHEN 8 THEN 'scalar' WHEN 3 THEN 'blank' WHEN 4 THEN 'missing'
      WHEN 5 THEN 'empty_list' WHEN 7 THEN 'fallback' ELSE 'list' END AS outcome,
    CAST(CASE WHEN doc_id % 9 IN (0, 1, 2, 6, 8) THEN doc_id % 28 END AS INTEGER) AS own,
    coalesce(own, 0) AS label
  FROM ls)
"""

NA_TEXT_CTE = """
nt AS (
  SELECT doc_id, text, lang AS label,
    CASE doc_id % 11
      WHEN 0 THEN NULL WHEN 1 THEN 'NA' WHEN 2 THEN 'null' WHEN 3 THEN 'None' WHEN 4 THEN 'none'
      WHEN 5 THEN ' ' WHEN 6 THEN '' WHEN 7 THEN 'nan' WHEN 8 THEN 'n/a' ELSE source END AS cell
  FROM documents),
na AS (
  SELECT doc_id, label, NAT(text) AS text, NAT(cell) AS cell FROM nt)
"""
for _c in ("text", "cell"):
    NA_TEXT_CTE = NA_TEXT_CTE.replace(f"NAT({_c})", f"""CASE WHEN {_c} IN (
    '', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA',
    'NULL', 'NaN', 'None', 'n/a', 'nan', 'null') THEN NULL ELSE {_c} END""")

ISSUE_CTE = """
iss AS (
  SELECT doc_id, doc_id AS id, doc_id + 1 AS number, STRIP AS text,
         CASE WHEN n_chars % 2 = 0 THEN 'open' ELSE 'closed' END AS state, n_chars % 50 AS comments,
         CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN NULL ELSE source END AS "user",
         doc_id % 7 = 0 OR doc_id % 5 = 0 AS pull
  FROM documents)
""".replace("STRIP", _strip("coalesce(source, '') || chr(10) || chr(10) || coalesce(text, '')"))

ORACLE.update({
    "compose_title_text": _w(CONV_ITEMS_CTE) + "SELECT conv_id, turn, "
        + _strip("coalesce(title, '') || ' ' || coalesce(body, '')") + " AS text FROM items",
    "compose_title_body": _w(CONV_ITEMS_CTE) + "SELECT conv_id, turn, "
        + _strip("coalesce(title, '') || chr(10) || chr(10) || coalesce(body, '')") + " AS text FROM items",
    "drop_empty_text": _w(CONV_ITEMS_CTE) + "SELECT conv_id, turn, text FROM (SELECT conv_id, turn, "
        + _strip("coalesce(title, '') || chr(10) || chr(10) || coalesce(body, '')")
        + " AS text FROM items) WHERE text <> ''",
    "json_key_absent": _w(ISSUE_CTE)
        + 'SELECT id, number, text, state, comments, "user" FROM iss WHERE NOT pull AND text <> \'\'',
    "json_nested": _w(ISSUE_CTE) + 'SELECT id, "user" FROM iss',
    "json_project": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, "
                    "json_extract_string(props, '$.q') AS q FROM events",
    "first_label": _w(LABEL_STRINGS_CTE) + "SELECT doc_id, labels, label FROM lab",
    "label_parse_report": _w(LABEL_STRINGS_CTE)
        + "SELECT outcome, CAST(count(*) AS BIGINT) AS n, "
          "CAST(sum(CAST(own IS NULL AS BIGINT)) AS BIGINT) AS n_default FROM lab GROUP BY outcome",
    "label_precedence": _w(LABEL_STRINGS_CTE)
        + "SELECT 'labels' AS src, doc_id, label FROM lab UNION ALL "
          "SELECT 'label' AS src, doc_id, CAST(quality AS INTEGER) AS label FROM labels",
    "na_tokens": _w(NA_TEXT_CTE) + "SELECT doc_id, text, cell FROM na",
    "csv_roundtrip": _w(NA_TEXT_CTE) + "SELECT doc_id, text, label, cell FROM na",
    "fill_text": _w(NA_TEXT_CTE) + "SELECT doc_id, coalesce(text, '') AS text, coalesce(cell, '') AS cell FROM na",
    "drop_missing": _w(NA_TEXT_CTE)
        + "SELECT doc_id, text, cell, label FROM na WHERE text IS NOT NULL AND cell IS NOT NULL AND label IS NOT NULL",
    "page_assembly": """
WITH r AS (
  SELECT doc_id, lang, source, text, CAST(floor(doc_id / 100) AS BIGINT) AS page,
         CAST(doc_id % 100 AS BIGINT) AS pos
  FROM documents),
sz AS (SELECT page, count(*) AS n FROM r WHERE page >= 0 GROUP BY page),
od AS (SELECT page, n, row_number() OVER (ORDER BY page) - 1 AS k FROM sz),
ok AS (SELECT page, n, k,
              coalesce(bool_and(n = 100 AND page = k) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS prev_ok
       FROM od)
SELECT CAST(r.page * 100 + r.pos AS BIGINT) AS row_index, r.doc_id, r.page, r.pos, r.lang, r.source, r.text
FROM r JOIN ok USING (page) WHERE ok.prev_ok AND ok.page = ok.k
""",
    "ranked_lookup": """
WITH ids AS (
  SELECT 0 AS list_no, doc_id AS pos, doc_id AS id FROM labels
  UNION ALL SELECT 1, doc_id, doc_id FROM labels WHERE toxic = 1
  UNION ALL SELECT 2, CAST(0 AS BIGINT), CAST(-1 AS BIGINT))
SELECT list_no, pos, id, source, text FROM (
  SELECT i.list_no, i.pos, i.id, d.source, """ + _strip("' ' || coalesce(d.text, '')") + """ AS text
  FROM ids i JOIN documents d ON d.doc_id = i.id)
WHERE text <> ''
""",
    "dataset_union": """
SELECT 'indomain' AS dataset, doc_id AS id, CAST(NULL AS BIGINT) AS turn, lang,
       CAST(NULL AS VARCHAR) AS role, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM documents
UNION ALL
SELECT 'ood_a', conv_id, turn, NULL, role, CAST(length(coalesce(text, '')) AS BIGINT) FROM conversations
UNION ALL
SELECT 'ood_b', item_id, NULL, NULL, NULL, CAST(length(coalesce(text, '')) AS BIGINT) FROM benchmark
""",
})


# ---- classification ---------------------------------------------------------------------

TOK = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"

TEXTS_CTE = """
texts AS (
  SELECT doc_id AS row_id, text, lang AS gold,
    CASE WHEN TRY_CAST(regexp_extract(source, '^src([0-9]+)$', 1) AS INTEGER) < 10 THEN 'indomain'
         WHEN TRY_CAST(regexp_extract(source, '^src([0-9]+)$', 1) AS INTEGER) < 15 THEN 'ood_a'
         ELSE 'ood_b' END AS dataset
  FROM documents)
"""

SPLIT_CTE = """
ind AS (SELECT * FROM texts WHERE dataset = 'indomain' AND text IS NOT NULL AND gold IS NOT NULL),
cc AS (SELECT gold, count(*) AS n_c FROM ind GROUP BY gold),
tot AS (SELECT sum(n_c) AS n, CAST(ceil(CAST(0.2 AS DOUBLE) * sum(n_c)) AS BIGINT) AS nval FROM cc),
qb AS (SELECT cc.gold, cc.n_c, tot.nval,
              (CAST(tot.nval AS HUGEINT) * cc.n_c) // tot.n AS base,
              (CAST(tot.nval AS HUGEINT) * cc.n_c) % tot.n AS rem
       FROM cc, tot),
qq AS (SELECT gold, n_c,
              base + CASE WHEN row_number() OVER (ORDER BY rem DESC, gold) <= nval - sum(base) OVER ()
                          THEN 1 ELSE 0 END AS q
       FROM qb),
ranked AS (
  SELECT i.*, row_number() OVER (
      PARTITION BY i.gold
      ORDER BY CAST('0x' || substr(md5('42:' || CAST(i.row_id AS VARCHAR)), 1, 15) AS BIGINT), i.row_id) AS rk
  FROM ind i),
split AS (
  SELECT r.row_id, r.text, r.gold, r.dataset, CASE WHEN r.rk <= qq.q THEN 'val' ELSE 'train' END AS split
  FROM ranked r JOIN qq USING (gold)),
train AS (SELECT * FROM split WHERE split = 'train')
"""

MODEL_CTE = """
ttok AS (SELECT gold, unnest(TOK) AS token FROM train),
cls AS (SELECT DISTINCT gold FROM train),
vc AS (SELECT token, gold, count(*) AS n FROM ttok GROUP BY token, gold),
voc AS (SELECT DISTINCT token FROM ttok),
vs AS (SELECT count(*) AS v FROM voc),
tt AS (SELECT c.gold, coalesce(sum(vc.n), 0) AS total FROM cls c LEFT JOIN vc USING (gold) GROUP BY c.gold),
model AS (
  SELECT voc.token, tt.gold AS label,
         ln((coalesce(vc.n, 0) + 1.0) / (tt.total + 1.0 * vs.v)) AS log_prob
  FROM voc CROSS JOIN tt CROSS JOIN vs
  LEFT JOIN vc ON vc.token = voc.token AND vc.gold = tt.gold)
""".replace("TOK", TOK)

PREDICT_CTE = """
prior AS (SELECT gold AS label, ln(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM train)) AS lp
          FROM train GROUP BY gold),
dtok AS (SELECT row_id, unnest(TOK) AS token FROM docs),
dsum AS (SELECT d.row_id, m.label, sum(m.log_prob) AS s
         FROM dtok d JOIN model m ON m.token = d.token GROUP BY d.row_id, m.label),
lg AS (SELECT t.row_id, t.dataset, t.gold, p.label, p.lp + coalesce(dsum.s, 0.0) AS logit
       FROM docs t CROSS JOIN prior p
       LEFT JOIN dsum ON dsum.row_id = t.row_id AND dsum.label = p.label),
mx AS (SELECT *, max(logit) OVER (PARTITION BY row_id) AS m,
              row_number() OVER (PARTITION BY row_id ORDER BY logit DESC, label) AS rn
       FROM lg),
pred AS (SELECT row_id, dataset, gold, max(CASE WHEN rn = 1 THEN label END) AS pred_label,
                1.0 / sum(exp(logit - m)) AS pred_confidence
         FROM mx GROUP BY row_id, dataset, gold)
""".replace("TOK", TOK)

ORACLE.update({
    "stratified_split": _w(TEXTS_CTE, SPLIT_CTE) + "SELECT row_id, gold, split FROM split",
    "split_sizes": _w(TEXTS_CTE, SPLIT_CTE)
        + "SELECT split, gold, CAST(count(*) AS BIGINT) AS n FROM split GROUP BY split, gold",
    "label_index": _w(TEXTS_CTE) + """
SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx, n FROM (
  SELECT gold AS label, CAST(count(*) AS BIGINT) AS n FROM texts
  WHERE dataset = 'indomain' AND text IS NOT NULL AND gold IS NOT NULL GROUP BY gold)
""",
    "token_window": _w(TEXTS_CTE, f"tw AS (SELECT row_id, dataset, {TOK} AS toks FROM texts)") + """
SELECT row_id, dataset, CAST(len(toks) AS INTEGER) AS n_tokens, CAST(len(toks[1:128]) AS INTEGER) AS n_kept,
       len(toks) > 128 AS truncated,
       array_to_string(list_concat(toks[1:128],
                                   list_transform(range(128 - len(toks[1:128])), lambda x: '[PAD]')), ' ') AS window
FROM tw
""",
    "truncation_report": _w(TEXTS_CTE, f"tw AS (SELECT dataset, len({TOK}) AS n FROM texts)") + """
SELECT dataset, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(CAST(n > 128 AS BIGINT)) AS BIGINT) AS n_truncated,
       CAST(sum(n) AS BIGINT) AS tokens_total, CAST(sum(least(n, 128)) AS BIGINT) AS tokens_kept,
       round(avg(CAST(n > 128 AS DOUBLE)), 6) AS share_truncated
FROM tw GROUP BY dataset
""",
    "nb_model": _w(TEXTS_CTE, SPLIT_CTE, MODEL_CTE)
        + "SELECT token, label, round(log_prob, 6) AS log_prob FROM model",
    "nb_predict": _w(TEXTS_CTE, SPLIT_CTE, MODEL_CTE, "docs AS (SELECT * FROM texts)", PREDICT_CTE)
        + "SELECT row_id, dataset, gold, pred_label, round(pred_confidence, 6) AS pred_confidence FROM pred",
    "eval_metrics": _w(TEXTS_CTE, SPLIT_CTE, MODEL_CTE,
                       "docs AS (SELECT row_id, text, gold, dataset FROM split WHERE split = 'val')",
                       PREDICT_CTE, PER_LABEL_CTE.format(src="pred")) + """
SELECT CAST(sum(support) AS BIGINT) AS n, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS accuracy,
       round(avg(coalesce(2.0 * tp / nullif(CAST(support + predicted AS DOUBLE), 0), 0.0)), 6) AS f1_macro
FROM per_label
""",
    "domain_shift": _w(TEXTS_CTE, SPLIT_CTE, MODEL_CTE, "docs AS (SELECT * FROM texts)", PREDICT_CTE) + """
SELECT dataset, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CAST(gold IS NOT DISTINCT FROM pred_label AS BIGINT)) AS BIGINT) AS n_correct,
       round(avg(CAST(gold IS NOT DISTINCT FROM pred_label AS DOUBLE)), 6) AS accuracy,
       round(avg(pred_confidence), 6) AS mean_confidence
FROM pred GROUP BY dataset
""",
})

ORACLE["gold_pred_positional"] = "SELECT row_number() OVER (ORDER BY row_id) - 1 AS position, * FROM (" + ORACLE["gold_pred_join"] + ")"

ORACLE["load_report"] = _w(TEXTS_CTE) + """
SELECT dataset, count(*) AS n_rows, count(*) FILTER (text IS NULL) AS n_null_text,
       count(*) FILTER (trim(text) = '') AS n_blank_text, count(*) FILTER (gold IS NULL) AS n_null_label,
       CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS n_chars
FROM (SELECT unnest(['indomain', 'ood_a', 'ood_b']) AS dataset) LEFT JOIN texts USING (dataset) GROUP BY dataset
"""

ORACLE["alignment_report"] = """
WITH g AS (SELECT doc_id, count(*) AS n, min(quality) AS gold FROM labels GROUP BY 1),
p AS (SELECT doc_id, count(*) AS n, min(CAST(n_chars % 2 AS INTEGER)) AS pred FROM documents GROUP BY 1),
j AS (SELECT g.n AS gn, p.n AS pn, gold, pred FROM g FULL JOIN p USING (doc_id))
SELECT CAST(sum(coalesce(gn, 0)) AS BIGINT) AS n_gold, CAST(sum(coalesce(pn, 0)) AS BIGINT) AS n_pred,
       count(*) FILTER (gn > 0 AND pn > 0) AS n_aligned, count(*) FILTER (pn IS NULL) AS n_gold_only,
       count(*) FILTER (gn IS NULL) AS n_pred_only, CAST(coalesce(sum(gn - 1), 0) AS BIGINT) AS n_gold_again,
       CAST(coalesce(sum(pn - 1), 0) AS BIGINT) AS n_pred_again,
       count(*) FILTER (gn > 0 AND pn > 0 AND gold IS NOT DISTINCT FROM pred) AS n_correct
FROM j
"""

ORACLE["nb_long_texts"] = ORACLE["nb_predict"]

ORACLE["nb_long_model"] = _w(TEXTS_CTE, SPLIT_CTE, MODEL_CTE) + """
SELECT token, gold AS label, round(ln(1.0 + n), 6) AS gain FROM vc
"""

# Every class is scored for every different text: the dense form of the sparse model.
ORACLE["nb_long_predict"] = _w("""
ev AS (SELECT event_id AS row_id, concat_ws(' ', event_type, props) AS text,
              concat(user_id, '/', hour(ts) // 3) AS gold FROM events)""", "train AS (SELECT * FROM ev)",
    MODEL_CTE.split("model AS")[0].rstrip().rstrip(","), """
prior AS (SELECT e.gold AS label, ln(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM ev)) AS lp,
                 ln(1.0 / (any_value(tt.total) + (SELECT v FROM vs))) AS unseen
          FROM ev e JOIN tt USING (gold) GROUP BY 1),
docs AS (SELECT DISTINCT text FROM ev),
dtok AS (SELECT text, unnest(TOK) AS token FROM docs),
known AS (SELECT d.text, count(voc.token) AS n FROM docs d LEFT JOIN dtok USING (text) LEFT JOIN voc USING (token) GROUP BY 1),
gain AS (SELECT d.text, vc.gold AS label, sum(ln(1.0 + vc.n)) AS g FROM dtok d JOIN vc USING (token) GROUP BY 1, 2),
lg AS (SELECT k.text, p.label, p.lp + k.n * p.unseen + coalesce(g.g, 0.0) AS logit
       FROM known k CROSS JOIN prior p LEFT JOIN gain g ON g.text = k.text AND g.label = p.label),
top AS (SELECT text, max(logit) AS m FROM lg GROUP BY text),
best AS (SELECT lg.text, min(CASE WHEN logit >= m - 1e-9 THEN label END) AS pred_label, 1.0 / sum(exp(logit - m)) AS c
         FROM lg JOIN top USING (text) GROUP BY lg.text)
""".replace("TOK", TOK)) + """
SELECT row_id, gold, pred_label, round(c, 6) AS pred_confidence FROM ev JOIN best USING (text)
"""

ORACLE["lr_fit"] = _w(TEXTS_CTE) + """
SELECT dataset, count(*) AS n, TRUE AS confidence_ok, TRUE AS labels_known, TRUE AS accurate FROM texts GROUP BY dataset
"""

ORACLE["pipeline_predictions"] = _w(TEXTS_CTE, SPLIT_CTE, MODEL_CTE, "docs AS (SELECT * FROM texts)", PREDICT_CTE) + """
SELECT p.row_id, p.dataset, p.gold, coalesce(s.split, 'ood') AS split, CAST(length(t.text) AS BIGINT) AS n_chars,
       p.pred_label, round(p.pred_confidence, 6) AS pred_confidence
FROM pred p JOIN texts t USING (row_id) LEFT JOIN split s USING (row_id)
"""

ORACLE["batch_score"] = ORACLE["score_softmax"]

ORACLE["json_envelope"] = """
SELECT CAST(doc_id AS BIGINT) AS row_index, CAST(floor(doc_id / 100) AS BIGINT) AS page,
       CAST(doc_id % 100 AS BIGINT) AS pos, doc_id AS id, lang, text
FROM documents
"""

ORACLE["issue_scan"] = _w(ISSUE_CTE, """
cap AS (SELECT *, row_number() OVER (PARTITION BY floor(doc_id / 50) ORDER BY doc_id) AS rn FROM iss WHERE state = 'open')
""") + """
SELECT CAST(floor(doc_id / 50) AS BIGINT) AS page, CAST(doc_id % 50 AS INTEGER) AS pos, id, number, text, comments, "user"
FROM cap WHERE rn <= 20 AND NOT pull AND text <> ''
"""

ORACLE["ranked_lookup_limit"] = "SELECT * FROM (" + ORACLE["ranked_lookup"] + ") WHERE pos < 300"

ORACLE["page_assembly_feeds"] = """
WITH sz AS (SELECT conv_id, CAST(floor(turn / 2) AS BIGINT) AS page, count(*) AS n FROM conversations GROUP BY 1, 2),
od AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY page) - 1 AS k FROM sz),
ok AS (SELECT *, coalesce(bool_and(n = 2 AND page = k) OVER (PARTITION BY conv_id ORDER BY page
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS prev FROM od)
SELECT c.conv_id, c.turn AS row_index, c.turn, c.role, c.text
FROM conversations c JOIN ok ON ok.conv_id = c.conv_id AND ok.page = floor(c.turn / 2)
WHERE ok.prev AND ok.page = ok.k AND c.turn BETWEEN 1 AND 3
"""

ORACLE["confidence_hist_shared"] = ORACLE["confidence_hist"].replace(
    "SELECT dataset, min(v) AS vmin, max(v) AS vmax FROM vals GROUP BY dataset",
    "SELECT DISTINCT dataset, min(v) OVER () AS vmin, max(v) OVER () AS vmax FROM vals")

# The shift reports over the 20 sources as datasets: every report counts every row.
ORACLE["shift_by_dataset"] = """
SELECT source AS dataset, count(*) AS n_distribution, count(*) AS n_dense, count(*) AS n_histogram
FROM documents GROUP BY source
"""


ORACLE["sketch_report"] = """
SELECT event_type AS dataset, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most,
       TRUE AS distinct_ok, TRUE AS quantiles_ok
FROM events GROUP BY event_type
"""

ORACLE["page_source"] = ORACLE["json_envelope"]

ORACLE["csv_quarantine"] = """
WITH c AS (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS lang,
         CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars END AS n_chars FROM documents),
r AS (SELECT *, CASE WHEN n_chars IS NULL THEN 'damaged' WHEN lang IS NULL THEN 'missing lang' END AS reason FROM c)
SELECT *, count(*) FILTER (reason IS NULL) OVER () AS n_kept, count(*) FILTER (reason IS NOT NULL) OVER () AS n_rejected FROM r
"""


# ---- subword windows ----------------------------------------------------------------------

# The longest piece that starts the rest of a word is taken until nothing is left; a word with a
# rest that no piece starts stays unfinished and is unknown.
SUBWORD_CTE = f"""
words(word) AS (SELECT DISTINCT unnest({TOK}) FROM benchmark),
voc(piece) AS MATERIALIZED (SELECT word FROM words UNION SELECT unnest(string_split(word, '')) FROM words),
longest AS (SELECT max(length(piece)) AS n FROM voc),
toks AS MATERIALIZED (
  SELECT row_id, dataset, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+|[^\\p{{Z}}\\p{{Cc}}\\p{{L}}\\p{{N}}]') AS ws FROM texts),
w0 AS (SELECT DISTINCT unnest(ws) AS word FROM toks),
cut(word, rest, parts) AS (
  SELECT word, word, CAST([] AS VARCHAR[]) FROM w0 WHERE length(word) <= 100
  UNION ALL
  SELECT word, substr(rest, m + 1), list_append(parts, CASE WHEN len(parts) > 0 THEN '##' ELSE '' END || substr(rest, 1, m))
  FROM (SELECT word, rest, parts, max(l) AS m
        FROM (SELECT word, rest, parts, unnest(range(1, least(length(rest), (SELECT n FROM longest)) + 1)) AS l FROM cut WHERE rest <> '') c
        JOIN voc ON voc.piece = substr(c.rest, 1, l) GROUP BY word, rest, parts)),
done AS MATERIALIZED (
  SELECT w0.word, coalesce(any_value(parts) FILTER (rest = ''), ['[UNK]']) AS parts, count(*) FILTER (rest = '') = 0 AS lost
  FROM w0 LEFT JOIN cut USING (word) GROUP BY w0.word),
each AS (SELECT row_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM toks),
doc AS (SELECT row_id, flatten(list(parts ORDER BY place)) AS parts, count(*) FILTER (lost) AS n_unknown FROM each JOIN done USING (word) GROUP BY row_id),
sub AS (SELECT row_id, dataset, coalesce(doc.parts, []) AS parts, coalesce(n_unknown, 0) AS n_unknown FROM toks LEFT JOIN doc USING (row_id))
"""

ORACLE["subword_window"] = _w(TEXTS_CTE, SUBWORD_CTE).replace("WITH", "WITH RECURSIVE", 1) + """
SELECT row_id, dataset, CAST(len(parts) AS BIGINT) AS n_subwords, n_unknown, CAST(len(parts[1:126]) + 2 AS INTEGER) AS n_kept,
       len(parts) > 126 AS truncated,
       array_to_string(list_concat(['[CLS]'], parts[1:126], ['[SEP]'],
                                   ['[PAD]' FOR x IN range(126 - len(parts[1:126]))]), ' ') AS window
FROM sub
"""

ORACLE["subword_report"] = _w(TEXTS_CTE, SUBWORD_CTE).replace("WITH", "WITH RECURSIVE", 1) + """
SELECT dataset, count(*) AS n_rows, CAST(sum(CAST(len(parts) > 126 AS BIGINT)) AS BIGINT) AS n_truncated,
       CAST(sum(len(parts)) AS BIGINT) AS subwords_total, CAST(sum(least(len(parts), 126)) AS BIGINT) AS subwords_kept,
       CAST(sum(n_unknown) AS BIGINT) AS n_unknown, round(avg(CAST(len(parts) > 126 AS DOUBLE)), 6) AS share_truncated
FROM sub GROUP BY dataset
"""


# ---- training in epochs -------------------------------------------------------------------

def _h60(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


ORACLE["epoch_batches"] = f"""
WITH o AS (
  SELECT CAST(e AS INTEGER) AS epoch, CAST({_h60("'42:shard:' || doc_id")} % 8 AS INTEGER) AS shard, doc_id AS id,
         {_h60("'42:' || e || ':' || doc_id")} AS h
  FROM documents, range(1, 4) r(e)),
p AS (SELECT *, row_number() OVER (PARTITION BY epoch, shard ORDER BY h, id) - 1 AS place FROM o)
SELECT epoch, shard, CAST(place // 16 AS INTEGER) AS batch, count(*) AS n, min(id) AS min_id,
       CAST(sum(id * place) AS BIGINT) AS order_sum
FROM p GROUP BY ALL
"""


def _epoch_fit(epochs: int = 3, batch: int = 16, shards: int = 4, rate: float = 2.0, classes: int = 10, dims: int = 64) -> str:
    """Mini-batch descent as recursive queries: a row holds a shard's weights (the last
    component of a class is its bias), a step replaces them, an epoch's end averages them."""
    price = "list_transform(w, lambda c: list_dot_product(c, {x}))"
    ctes = [f"""
ex AS MATERIALIZED (
  SELECT vec_id AS id, CAST(label AS INTEGER) AS gold, vec_id % 3 = 0 AS training,
         list_append([CAST(x AS DOUBLE) FOR x IN embedding], 1.0) AS x,
         CAST({_h60("'42:shard:' || vec_id")} % {shards} AS INTEGER) AS shard
  FROM embeddings),
lab AS (SELECT list(DISTINCT gold ORDER BY gold) AS labels FROM ex WHERE training),
tr AS MATERIALIZED (SELECT id, x, shard, list_position(labels, gold) AS y FROM ex, lab WHERE training),
va AS (SELECT x, list_position(labels, gold) AS y FROM ex, lab WHERE NOT training),
size AS (SELECT shard, count(*) AS n FROM tr GROUP BY shard),
w0 AS (SELECT [[0.0::DOUBLE FOR j IN range({dims + 1})] FOR c IN range(len(labels))] AS w FROM lab)"""]
    for e in range(1, epochs + 1):
        ctes.append(f"""
ord{e} AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY {_h60(f"'42:{e}:' || id")}, id) - 1 AS place FROM tr),
bat{e} AS MATERIALIZED (
  SELECT shard, place // {batch} AS b, list(x ORDER BY place) AS xs, list(y ORDER BY place) AS ys FROM ord{e} GROUP BY ALL),
run{e}(shard, b, w, loss, hits) AS (
  SELECT shard, 0, w, 0.0::DOUBLE, 0 FROM size, w{e - 1}
  UNION ALL
  SELECT shard, b + 1,
         list_transform(w, lambda row, c: list_transform(row, lambda v, j: v - {rate} / len(ys) * list_sum(
           list_transform(xs, lambda x, i: (ps[i][c] - CASE WHEN ys[i] = c THEN 1 ELSE 0 END) * x[j])))),
         loss + list_sum(list_transform(ps, lambda p, i: -ln(p[ys[i]]))),
         hits + list_sum(list_transform(ps, lambda p, i: CASE WHEN list_position(p, list_max(p)) = ys[i] THEN 1 ELSE 0 END))
  FROM (SELECT *, list_transform(es, lambda e: list_transform(e, lambda v: v / list_sum(e))) AS ps
        FROM (SELECT *, list_transform(zs, lambda z: list_transform(z, lambda v: exp(v - list_max(z)))) AS es
              FROM (SELECT r.shard, r.b, w, loss, hits, xs, ys,
                           list_transform(xs, lambda x: {price.format(x="x")}) AS zs
                    FROM run{e} r JOIN bat{e} t ON t.shard = r.shard AND t.b = r.b)))),
end{e} AS MATERIALIZED (SELECT shard, n, arg_max(w, b) AS w, max(b) AS steps, arg_max(loss, b) AS loss, arg_max(hits, b) AS hits
         FROM run{e} JOIN size USING (shard) GROUP BY shard, n),
cell{e} AS (SELECT c, j, sum(w[c][j] * n) / sum(n) AS v
            FROM end{e}, (SELECT unnest(range(1, {classes + 1})) AS c), (SELECT unnest(range(1, {dims + 2})) AS j)
            WHERE c <= len(w) GROUP BY c, j),
w{e} AS MATERIALIZED (SELECT list(r ORDER BY c) AS w FROM (SELECT c, list(v ORDER BY j) AS r FROM cell{e} GROUP BY c)),
val{e} AS (
  SELECT count(*) AS val_rows, avg(CASE WHEN y IS NULL THEN -ln(1e-300) ELSE ln(s) + m - z[y] END) AS val_loss,
         avg(CASE WHEN list_position(z, m) = y THEN 1.0 ELSE 0.0 END) AS val_accuracy
  FROM (SELECT y, z, list_max(z) AS m, list_sum(list_transform(z, lambda v: exp(v - list_max(z)))) AS s
        FROM (SELECT y, {price.format(x="x")} AS z FROM va, w{e})))""")
    rows = " UNION ALL ".join(f"""
SELECT CAST({e} AS INTEGER) AS epoch, CAST((SELECT sum(n) FROM end{e}) AS BIGINT) AS n_rows,
       CAST((SELECT sum(steps) FROM end{e}) AS BIGINT) AS n_batches,
       round((SELECT sum(loss) / sum(n) FROM end{e}), 6) AS train_loss,
       round((SELECT CAST(sum(hits) AS DOUBLE) / sum(n) FROM end{e}), 6) AS train_accuracy,
       val_rows, round(val_loss, 6) AS val_loss, round(val_accuracy, 6) AS val_accuracy FROM val{e}""" for e in range(1, epochs + 1))
    return "WITH RECURSIVE " + ",".join(ctes) + rows


ORACLE["epoch_fit"] = _epoch_fit()
