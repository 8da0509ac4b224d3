"""The numbered queries and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from .ann import nearest
from .bpe import encode_decode
from .conversations import repaired_conversations
from .exact_topk import exact_topk
from .lexical_search import search
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .ngram_join import ngram_components
from .packing import pack
from .quality import score_quality
from .shared import table
from .simhash import near_duplicates
from .token_counts import count_tokens
from .toxicity import score_toxicity


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.drop("text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.drop("text")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(table(spark, sf_dir, "conversations"))


OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT n, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, o.owner IS NOT NULL AND o.owner < k.doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY n
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(max(list_inner_product(q.e, c.e)) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id GROUP BY q.vec_id, c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP11_SQL = r"""
WITH
d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
a AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
t AS (SELECT n, term, count(*) AS tf FROM (SELECT n, unnest(w) AS term FROM d) GROUP BY n, term),
v AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM t, a GROUP BY term, docs),
m AS (SELECT n, doc_id, 75 + (25 * len(w) * docs) // terms AS m FROM d, a),
s AS (SELECT item_id, n, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN v USING (term) JOIN t USING (term) JOIN m USING (n) GROUP BY item_id, n, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""

OP12_SQL = r"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT n, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM d),
t AS (SELECT n, len(g) AS size, unnest(g) AS g FROM s),
i AS (SELECT a.n AS a, b.n AS b, count(*) AS common, any_value(a.size + b.size) AS sizes FROM t a JOIN t b ON a.g = b.g AND a.n <> b.n GROUP BY a.n, b.n),
r AS (SELECT n AS a, n AS b FROM d UNION SELECT r.a, i.b FROM r JOIN i ON i.a = r.b WHERE 100 * common >= 85 * (sizes - common)),
c AS (SELECT r.a AS n, min(d.doc_id) AS component_id FROM r JOIN d ON d.n = r.b GROUP BY r.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN c USING (n)
"""

#: The CRC-32 by bytes, the faults, and a search row by row over the roles that the repaired turns end with.
OP13_SQL = """
WITH RECURSIVE
t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS tab FROM range(256) r(i)),
h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) % 20 AS hit
  FROM conversations, t),
d AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy
  FROM h WHERE hit <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core, left(role, 1) AS initial FROM d),
f AS (
  SELECT *, CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS clash FROM o),
m(st, nx, gap, ins) AS (VALUES ('', 's', '', ''), ('', 'u', '', ''), ('', 'a', 'I', 'user:'), ('s', 'u', '', ''), ('s', 'a', 'I', 'user:'), ('u', 'u', 'I', 'assistant:'), ('u', 'a', '', ''), ('a', 'u', '', ''), ('a', 'a', 'I', 'user:')),
w AS (
  SELECT conv_id, i, NULL AS nx, 3 AS price, 'D' AS edit, '' AS line FROM f
  UNION ALL SELECT conv_id, i, initial, (fault IS NOT NULL)::INT, 'K', role || ':' || text FROM f WHERE coalesce(fault, 'truncated') = 'truncated'
  UNION ALL SELECT conv_id, i, n, 2 + (fault IS NOT NULL)::INT, 'R', r || ':' || text FROM f, (VALUES ('u', 'user'), ('a', 'assistant')) v(n, r) WHERE coalesce(fault, 'truncated') = 'truncated'),
p AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS st, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM d
  UNION ALL
  SELECT p.conv_id, w.i, coalesce(w.nx, p.st), min({'cost': best.cost + w.price + 2 * length(coalesce(m.gap, '')), 'audit': best.audit || coalesce(m.gap, '') || w.edit,
    'lines': CASE WHEN w.nx IS NULL THEN best.lines WHEN m.ins = '' THEN list_append(best.lines, w.line) ELSE list_append(list_append(best.lines, m.ins), w.line) END})
  FROM p JOIN w ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND w.i = p.i + 1 LEFT JOIN m ON m.st = p.st AND m.nx = w.nx
  WHERE w.nx IS NULL OR m.st IS NOT NULL GROUP BY p.conv_id, w.i, coalesce(w.nx, p.st)),
c AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE clash) AS illegal FROM f GROUP BY conv_id),
e AS (
  SELECT p.conv_id, min({'cost': best.cost + 2 * length(g.gap), 'audit': best.audit || g.gap, 'lines': list_concat(best.lines, g.ins)}) AS best
  FROM p JOIN c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i JOIN (VALUES ('', '', []::VARCHAR[]), ('s', 'II', ['user:', 'assistant:']), ('u', 'I', ['assistant:']), ('a', '', [])) g(st, gap, ins) ON g.st = p.st GROUP BY p.conv_id)
SELECT a.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_ann": op5_ann,
    "op6_exact_topk": op6_exact_topk,
    "op7_bpe": op7_bpe,
    "op8_license_scan": op8_license_scan,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_lexical_search": op11_lexical_search,
    "op12_ngram_join": op12_ngram_join,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": OP3_SQL,
    "op6_exact_topk": OP6_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_ngram_join": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
