"""The registered queries of this subpackage, one an operator (opN_<name>), and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from quarry.llm import (
    chat, dedup_exact, jaccard, lexical, mixing, pii, prefix_trie, quality, suffix_dedup, token_counts, tokens, toxicity, url_rules)
from quarry.llm.common import ORACLES, QUERIES, register, table  # noqa: F401

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048

SQL_WORDS = r"[^\x20\x09-\x0D]+"
SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register("op1_bpe_round_trip")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.encode(docs, path, decoded_col="decoded").select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2(F.col("ids"), 256).alias("ids_sha256"),
                          F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@register("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = token_counts.count_tokens(docs, public_tokenizers.path(WORD_VOCABULARY))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


OP3_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
                       THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, {SQL_LOWER.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(name, host, path, verdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fits AS (
  SELECT p.page_id, r.name, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.name) DESC) AS place
  FROM parts p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
own AS (
  SELECT page_id, regexp_matches(path, '(?i)/(login|signin)([/.]|$)|/wp-admin(/|$)|\\.(exe|zip)$') AS bad FROM parts)
SELECT p.page_id, p.host, p.path, f.name AS rule,
       CASE WHEN f.name IS NOT NULL THEN f.verdict WHEN o.bad THEN 'block' ELSE 'allow' END AS verdict
FROM parts p JOIN own o USING (page_id) LEFT JOIN fits f ON f.page_id = p.page_id AND f.place = 1
"""


@register("op3_url_rules", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = f"""
WITH norm AS (SELECT doc_id, {SQL_LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM norm
"""


@register("op4_exact_dedup", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         substr(md5('mix-1:' || doc_id), 1, 16) AS key FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
            WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         (3 * source_size)::DOUBLE AS cap FROM totals),
leveled AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
targets AS (
  SELECT source, source_size,
         least(cap, weight * max(CASE WHEN level <= cap / weight THEN level END) OVER ()) AS target FROM leveled),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         greatest(t.source_size, 1) AS epoch,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((budget // epoch) * size + greatest(0, least(size, budget % epoch - start)))::BIGINT AS taken
FROM placed
"""


@register("op7_source_mix", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text_hash")


@register("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).drop("text")


OP6_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(t, r)),
sized AS (
  SELECT *, replace(replace(replace(text, '\', '\e'), '<', '\l'), '[', '\b') AS safe,
         replace(replace(replace(role, '\', '\e'), '<', '\l'), '[', '\b') AS safe_role FROM given)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(length(safe) + length(safe_role) + 10))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


@register("op6_chat_format", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], rows.schema)
    back = chat.read_back(chat.format_conversations(rows.unionByName(planted)))
    turns = F.concat_ws("", F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))))
    loss = F.concat_ws("", "losses")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return back.select("conv_id", F.size("messages").cast("long").alias("n_turns"), digest(turns).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), digest(loss).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@register("op9_personal_data")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = pii.KINDS[:4]
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
                        F.sha2(F.encode(pii.listed(base), "UTF-8"), 256).alias("base_sha256"),
                        pii.listed(pii.KINDS).alias("spans"))


OP8_WIDTH, OP8_THRESHOLD = 4, 85


@register("op8_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.jaccard_join(docs, width=OP8_WIDTH, threshold=OP8_THRESHOLD)


@register("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


#: CRC-32 as a fold over the bits of an id's digits; then the trie with texts as keys.
OP11_SQL = r"""
WITH given AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
             sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten([[ord(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(conv_id::VARCHAR, '')])),
             lambda a, x: xor(xor(a, x) >> 1, 3988292384::UBIGINT * (xor(a, x) & 1))), 4294967295::UBIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM given)),
rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, role, text FROM (
    SELECT c.conv_id, g.place, g.role, g.text FROM convs c JOIN given g ON g.conv_id = c.base AND g.place <= c.h
    UNION ALL SELECT c.conv_id, g.place, g.role, g.text FROM convs c JOIN given g ON g.conv_id = c.conv_id AND g.place > c.h)),
paths AS (
  SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         list(length(role) || ':' || role || length(text) || ':' || text) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, []::VARCHAR[] FROM convs),
sizes AS (SELECT conv_id, max(depth) AS size FROM paths GROUP BY conv_id),
nodes AS (SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM paths GROUP BY path),
ends AS (
  SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM paths JOIN sizes USING (conv_id) WHERE depth = size GROUP BY path),
children AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT a.path, count(*) FILTER (NOT EXISTS (FROM children c WHERE c.path = b.path)) AS n_leaves, sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens
  FROM nodes a JOIN nodes b ON b.path[:a.depth] = a.path AND b.depth >= a.depth GROUP BY a.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
       b.n_leaves, b.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN below b ON b.path = n.path LEFT JOIN children c ON c.path = n.path LEFT JOIN ends e ON e.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[:n.depth - 1]
"""


@register("op11_prefix_trie", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("a", "b")


TOXIC_LIMIT = 0.3


@register("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held))
    scored = toxicity.score(docs, model).withColumn("n_passages", F.size("passages").cast("long"))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC_LIMIT).cast("int").alias("predicted"), "n_passages")


OP13_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS row_no, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
lengths AS (SELECT row_no, any_value(doc_id) AS doc_id, count(*) AS n FROM words GROUP BY row_no),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
tfs AS (SELECT row_no, term, count(*) AS tf FROM words GROUP BY row_no, term),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, corpus GROUP BY term, n_docs),
scored AS (
  SELECT q.item_id, t.row_no, l.doc_id,
         sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (10 + (90 * l.n * c.n_docs) // c.n_terms))))::BIGINT AS score
  FROM wanted q JOIN tfs t ON t.term = q.term JOIN weights w ON w.term = q.term JOIN lengths l ON l.row_no = t.row_no, corpus c
  GROUP BY q.item_id, t.row_no, l.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@register("op13_lexical_search", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
