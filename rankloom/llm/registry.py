"""The queries of the corpus operators over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import chat, divergence, embedding_dedup, exact_dedup, langid, line_dedup, lm_score, packing, prefix_trie, quality, sentencepiece_codec, simhash, urls
from rankloom.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.format_pairs(chat.mismatched_pairs(chat.gather(table(spark, sf_dir, "conversations"))))
    return pairs.withColumns({side: chat.spans_text(F.col(side)) for side in ("chosen_spans", "rejected_spans")})


ORACLES["op1_chat_preference"] = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), ch AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t
), last AS (
  SELECT conv_id, max(k) AS k, max_by(text, k) AS reply FROM ch WHERE role = 'assistant' GROUP BY conv_id
), rj AS (
  SELECT ch.conv_id, ch.role, CASE WHEN l.k = ch.k THEN n.reply ELSE ch.text END AS text,
         row_number() OVER (PARTITION BY ch.conv_id ORDER BY ch.k) AS k
  FROM ch LEFT JOIN last l ON l.conv_id = ch.conv_id LEFT JOIN last n ON n.conv_id = ch.conv_id + 1
  WHERE l.k IS NULL OR l.k <> ch.k OR n.reply IS NOT NULL
), n AS (
  SELECT coalesce(ch.conv_id, rj.conv_id) AS conv_id,
         coalesce(min(coalesce(ch.k, rj.k)) FILTER (ch.role IS DISTINCT FROM rj.role OR ch.text IS DISTINCT FROM rj.text) - 1, count(*)) AS n
  FROM ch FULL JOIN rj ON ch.conv_id = rj.conv_id AND ch.k = rj.k GROUP BY 1
), parts AS (
  SELECT conv_id, k, role, text, 'c' AS side FROM ch UNION ALL SELECT conv_id, k, role, text, 'r' FROM rj
), made AS (
  SELECT conv_id, k, side, role, n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s,
         sum(CASE WHEN k > n THEN length(role) + length(text) + 24 ELSE 0 END) OVER (PARTITION BY conv_id, side ORDER BY k) AS upto,
         length(text) AS len
  FROM parts JOIN n USING (conv_id)
)
SELECT conv_id, CAST(max(n) AS INTEGER) AS prompt_turns,
       coalesce(string_agg(s, '' ORDER BY k) FILTER (side = 'c' AND k <= n), '') AS prompt,
       coalesce(string_agg(s, '' ORDER BY k) FILTER (side = 'c' AND k > n), '') AS chosen,
       coalesce(string_agg(s, '' ORDER BY k) FILTER (side = 'r' AND k > n), '') AS rejected,
       coalesce(string_agg((upto - 11 - len) || '-' || (upto - 1), ',' ORDER BY k) FILTER (side = 'c' AND k > n AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg((upto - 11 - len) || '-' || (upto - 1), ',' ORDER BY k) FILTER (side = 'r' AND k > n AND role = 'assistant'), '') AS rejected_spans
FROM made GROUP BY conv_id
"""


@query
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.deduplicate(table(spark, sf_dir, "embeddings"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), packing.load_tokenizer(tokenizer_file("byte_bpe_50k.json")))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


@query
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.score_against(docs, lm_score.good_ids(table(spark, sf_dir, "labels")))


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.fresh_index(spark)
    found = exact_dedup.deduplicate(table(spark, sf_dir, "documents"), index)
    index.drop()  # the result is read from tables of its own
    return found


@query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_codec.load_model(tokenizer_file("piece_bpe_32k.model"))
    coded = sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), model)
    return coded.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "checked", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), "round_trip")


@query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.deduplicate_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op9_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""

UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES["op11_divergence"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), w AS (
  SELECT id, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), v AS (
  SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
  SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + v.v)::HUGEINT AS BIGINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (kept.n + 1)) // (v.n + v.v)::HUGEINT AS BIGINT) AS q
  FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) FROM terms
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""

ORACLES["op12_line_dedup"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT id, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {UPPER_LOWER}) AS key FROM l
), gone AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT k.id, k.doc_id, k.line, k.pos, gone.key IS NOT NULL AND k.doc_id <> gone.top AS dropped FROM k LEFT JOIN gone ON gone.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM j GROUP BY id, doc_id
"""

#: CRC-32 of a decimal number, bit by bit.
CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))))"

ORACLES["op13_prefix_trie"] = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), i AS (
  SELECT conv_id, turn, sha256(strlen(role) || ':' || role || ':' || text) AS id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t
), o AS (
  SELECT conv_id, id, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS k FROM i
), c AS (
  SELECT conv_id, {CRC32} % 4 AS h, conv_id - conv_id % 20 AS lead FROM (SELECT DISTINCT conv_id FROM t)
), b AS (
  SELECT c.conv_id, 0 AS part, o.k, o.id, o.words FROM c JOIN o ON o.conv_id = c.lead AND o.k <= c.h
  UNION ALL
  SELECT c.conv_id, 1, o.k, o.id, o.words FROM c JOIN o ON o.conv_id = c.conv_id AND o.k > c.h
), s AS (
  SELECT conv_id, row_number() OVER w AS d, words, string_agg(id, ',') OVER w AS path FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY part, k ROWS UNBOUNDED PRECEDING)
), m AS (
  SELECT conv_id, 0 AS d, 0 AS words, '' AS path FROM c UNION ALL SELECT conv_id, d, words, path FROM s
), node AS (
  SELECT d, path, min(conv_id) AS conv, count(*) AS n, (count(*) - 1) * max(words) AS own FROM m GROUP BY d, path
), mm AS (
  SELECT m.conv_id, m.d, node.conv, node.own, m.d = max(m.d) OVER (PARTITION BY m.conv_id) AS last FROM m JOIN node ON node.d = m.d AND node.path = m.path
), up AS (
  SELECT node.conv, node.d, node.n, node.own, mm.conv AS parent FROM node LEFT JOIN mm ON mm.conv_id = node.conv AND mm.d = node.d - 1
), kids AS (
  SELECT parent AS conv, d - 1 AS d, count(*) AS n FROM up WHERE d > 0 GROUP BY 1, 2
), full_node AS (
  SELECT up.*, coalesce(kids.n, 0) AS n_children FROM up LEFT JOIN kids ON kids.conv = up.conv AND kids.d = up.d
), below AS (
  SELECT mm.conv, mm.d, sum(f.own) AS saved, count(*) FILTER (f.n_children = 0) AS leaves FROM full_node f JOIN mm ON mm.conv_id = f.conv AND mm.d <= f.d GROUP BY 1, 2
), ends AS (
  SELECT conv, d, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM mm WHERE last GROUP BY 1, 2
)
SELECT f.conv AS conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n AS n_convs, f.n_children, CAST(below.leaves AS BIGINT) AS n_leaves,
       CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM full_node f JOIN below ON below.conv = f.conv AND below.d = f.d LEFT JOIN ends ON ends.conv = f.conv AND ends.d = f.d
"""
