"""DuckDB SQL for the operators that SQL can express, written from their contracts."""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

# Components by transitive closure: fine for the small groups of the oracle's tables.
_REACH = """
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM both_ways UNION
                SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
low AS (SELECT a AS node, least(a, min(b)) AS component_id FROM reach GROUP BY a)"""

OP8 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
      FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
         WHERE 100 * k >= 75 * (na.n + nb.n - k)),
{_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(low.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.node = d.doc_id"""

OP1 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, [x::DOUBLE for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
        AND len([x for x in embedding if x <> 0]) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e)
         WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
{_REACH},
n AS (SELECT a AS node, count(*) AS n FROM both_ways GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(low.component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(low.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.node = e.vec_id LEFT JOIN low ON low.node = e.vec_id"""

OP2 = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m,
         unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ')
                 for i in range(1, len(w) - least(10, len(w)) + 2)]) AS g
  FROM b WHERE len(w) > 0),
gram AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT DISTINCT m FROM win))),
hit AS (SELECT doc_id, i, win.m AS m, item_id FROM gram JOIN win ON gram.m = win.m AND gram.g = win.g),
place AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY 1),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
         FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN place USING (doc_id) LEFT JOIN item USING (doc_id)"""



def _op12(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """One assignment and one update a round, each a common table expression."""
    ctes = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
            f"""pt AS MATERIALIZED (
  SELECT r, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) AS t(p))""",
            f"""seed AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries})""",
            "book0 AS MATERIALIZED (SELECT p, e, x AS c FROM seed JOIN pt USING (r))"]
    for k in range(rounds + 1):
        ctes.append(f"""near{k} AS MATERIALIZED (
  SELECT r, p, any_value(x) AS x, min(struct_pack(
    d := CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x, c)]) AS BIGINT), e := e)) AS best
  FROM pt JOIN book{k} USING (p) GROUP BY r, p)""")
        if k < rounds:
            ctes.append(f"""mean{k} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT p, best.e AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n
        FROM near{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM pt) + 1)) AS i) GROUP BY 1, 2, 3)
  GROUP BY p, e),
book{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(mean{k}.c, book{k}.c) AS c FROM book{k} LEFT JOIN mean{k} USING (p, e))""")
    ctes.append(f"""coded AS (
  SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY r)""")
    ctes.append(f"""text AS (
  SELECT sha256(coalesce(string_agg(array_to_string(c, ','), ',' ORDER BY p, e), '')) AS h FROM book{rounds})""")
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (r), text"""


ORACLE = {
    "op1_embedding_near_dedup": OP1,
    "op2_benchmark_decontamination": OP2,
    "op8_minhash_near_dedup": OP8,
    "op12_vector_codes": _op12(),
}
