"""One registered query per training-data operator, over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagesignal.llm import chat, exact, html, knn, langid, lexical, mixing, negatives, pieces, repeats, sharding, simhash, toxicity
from stagesignal.llm.common import table

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.format_pairs(chat.neighbour_pairs(table(spark, sf_dir, "conversations")))
    return pairs.withColumns({c: chat.mask_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out("doc_id", 5, 0)
    model = langid.fit(docs.where(~held))
    rows = docs.select("doc_id", held.alias("held_out"), langid.identify(docs, model).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.accepted").alias("accepted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = langid.held_out("doc_id", 3, 1)
    model = toxicity.fit(docs.where(~held), labels=labels.where(~held))
    rows = docs.select("doc_id", held.alias("held_out"), toxicity.scorer(model, docs)(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), MODEL_FILE)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_preference_format, op3_exact_dedup, op4_html_text, op5_language, op6_toxicity, op7_shards, op8_simhash, op9_top_k, op10_sentencepiece, op11_lexical_search, op12_suffix_dedup, op13_hard_negatives)}

ORACLE = {
    "op2_preference_format": r"""
WITH t AS (SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn, role, text) AS ts FROM conversations GROUP BY conv_id),
g AS (SELECT xor(conv_id, 1) AS to_id, arg_max_null(text, struct_pack(turn := turn, text := coalesce('1' || text, '0'))) AS last_text, true AS given FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
p AS (SELECT t.conv_id, list_transform(ts, lambda x: struct_pack(role := x.role, text := x.text)) AS a, last_text, coalesce(given, false) AS given,
      coalesce(list_max(list_filter(range(1, len(ts) + 1), lambda i: ts[i].role = 'assistant')), 0) AS spot
      FROM t LEFT JOIN g ON g.to_id = t.conv_id),
q AS (SELECT conv_id, a, list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i = spot AND given THEN struct_pack(role := a[i].role, text := last_text) ELSE a[i] END) AS b FROM p),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, len(a) + 1), lambda i: a[i] IS DISTINCT FROM b[i])), len(a) + 1) - 1 AS k FROM q),
r AS (SELECT *, list_transform(a, lambda x: struct_pack(h := '<|' || coalesce(x.role, 'unknown') || '|>' || chr(10), b := replace(coalesce(x.text, ''), '<|', '< |'), y := coalesce(x.role, '') = 'assistant')) AS ra,
             list_transform(b, lambda x: struct_pack(h := '<|' || coalesce(x.role, 'unknown') || '|>' || chr(10), b := replace(coalesce(x.text, ''), '<|', '< |'), y := coalesce(x.role, '') = 'assistant')) AS rb FROM n)
SELECT conv_id AS pair_id, CAST(k AS INTEGER) AS prompt_turns,
  coalesce(array_to_string(list_transform(ra[1:k], lambda x: x.h || x.b || '<|end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(ra[k + 1:], lambda x: x.h || x.b || '<|end|>' || chr(10)), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(rb[k + 1:], lambda x: x.h || x.b || '<|end|>' || chr(10)), ''), '') AS rejected,
  coalesce(array_to_string(list_transform(ra[k + 1:], lambda x: '0x' || length(x.h) || ',' || CASE WHEN x.y THEN '1x' ELSE '0x' END || (length(x.b) + 8)), ','), '') AS chosen_mask,
  coalesce(array_to_string(list_transform(rb[k + 1:], lambda x: '0x' || length(x.h) || ',' || CASE WHEN x.y THEN '1x' ELSE '0x' END || (length(x.b) + 8)), ','), '') AS rejected_mask,
  k = len(a) AND k = len(b) AS tie
FROM r""",
    "op3_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)""",
    # The table's pages have one flat article each and two kinds of character references; other pages are in the tests.
    "op4_html_text": r"""
WITH b AS (SELECT page_id, url, regexp_split_to_array(replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<br>', ' '), '</?(?:p|h1)>') AS parts FROM pages),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, coalesce(text, '') AS text, coalesce(length(text), 0) AS n_chars, '/html/body/article' AS host_path FROM t""",
    "op9_top_k": """
WITH v AS (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.n, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_lexical_search": r"""
WITH dt AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
it AS (SELECT DISTINCT i, item_id, term FROM (SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark))),
c AS (SELECT r, doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
len AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM c GROUP BY r),
g AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM len),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM c, g WHERE term IN (SELECT term FROM it) GROUP BY term, nn),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l)))) AS BIGINT) AS score
  FROM it JOIN c USING (term) JOIN w USING (term) JOIN len USING (r), g GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10""",
    "op12_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT *, octet_length(b) AS n_bytes FROM d),
w AS (SELECT r, doc_id, i, b[i + 1 : i + 50] AS s FROM (SELECT *, unnest(range(n_bytes - 49)) AS i FROM n WHERE n_bytes >= 50)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1),
c AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50, true) AS opens FROM w JOIN m USING (s) WHERE least < coalesce(doc_id, 9223372036854775807)),
g AS (SELECT r, i, sum(opens::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM c),
p AS (SELECT r, k, min(i) AS a, max(i) + 50 AS e FROM g GROUP BY r, k),
q AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS prior FROM p),
x AS (SELECT r, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(hex(b[prior + 1 : a]), '' ORDER BY a) AS kept FROM q JOIN n USING (r) GROUP BY r)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN last IS NULL THEN b ELSE unhex(kept || hex(b[last + 1 : n_bytes])) END) AS kept_sha256 FROM n LEFT JOIN x USING (r)""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
