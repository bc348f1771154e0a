"""The queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from densigrid.llm import bagminhash, bpe, dac, decontaminate, jpeg, langid, pii, quality, quotes, rules, runs, toxicity, trie
from densigrid.llm.learn import remainder
from densigrid.llm.ship import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"], with_ids=False)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs), ["doc_id"]).withColumn("held_out", remainder("doc_id", 5) == 0)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.withColumns({"held_out": remainder("doc_id", 4) == 2, "predicted": (F.col("score") >= 0.7).cast("int")})


def op7_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.features(jpeg.store(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id", "n_bytes"])


def op8_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.with_chats(table(spark, sf_dir, "conversations"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.withColumns({"held_out": remainder("doc_id", 5) == 0, "predicted": (F.col("score") >= 0.5).cast("int")})


def op6_addressable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.tree(table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return runs.periodic(docs, ["doc_id"], runs.planted(docs))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"), ["doc_id"])


def queries() -> dict:
    first = (op1_byte_bpe, op2_language, op3_near_duplicates, op4_personal_data, op5_quality, op6_addressable_tokens, op7_jpeg_media, op8_quotations, op9_decontamination, op10_toxicity)
    return {f.__name__: f for f in (*first, op11_conversation_trie, op12_periodic_runs, op13_quality_rules)}


OP9 = r"""
WITH words AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
doc_shingles AS (SELECT DISTINCT r, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM words),
item_words AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
item_shingles AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM item_words),
sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id),
found AS (SELECT r, item_id, count(*) AS k FROM doc_shingles JOIN item_shingles USING (s) GROUP BY r, item_id),
hits AS (SELECT r, item_id, k / n AS c FROM found JOIN sizes USING (item_id) WHERE k >= CAST(0.8 AS DOUBLE) * n),
by_row AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids, max(c) AS containment FROM hits GROUP BY r)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids,
       coalesce(containment, CAST(0 AS DOUBLE)) AS containment
FROM words LEFT JOIN by_row USING (r)
"""


OP8 = r"""
WITH lines AS (
  SELECT r, conv_id, turn, role, i, l, len(regexp_replace(regexp_extract(l, '^(([ \t]{0,3}>)+)', 1), '[^>]', '', 'g')) AS level,
         regexp_replace(regexp_replace(l, '^(([ \t]{0,3}>)+)', ''), '^ ', '') AS line
  FROM (SELECT r, conv_id, turn, role, unnest(ls) AS l, generate_subscripts(ls, 1) AS i
        FROM (SELECT row_number() OVER () AS r, conv_id, turn, role, string_split_regex(coalesce(text, ''), '\r?\n') AS ls FROM conversations))),
runs AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS passage
         FROM (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY r ORDER BY i) = level THEN 0 ELSE 1 END AS new,
                      coalesce(lead(level) OVER (PARTITION BY r ORDER BY i), 0) AS following FROM lines)),
norm AS (SELECT *, trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM runs),
blocks AS (SELECT r, conv_id, turn, level, passage, trim(regexp_replace(lower(string_agg(line, chr(10) ORDER BY i)), '[^\p{L}\p{N}]+', ' ', 'g')) AS key
           FROM norm GROUP BY r, conv_id, turn, level, passage),
own AS (SELECT r, conv_id, turn, role, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (
          level = 0 AND NOT (following > 0 AND regexp_matches(line, '(?i)^.{0,200}\b(wrote|schrieb|a écrit|escribió)\s*:\s*$'))), ''), '^\s+|\s+$', '', 'g') AS own_text
        FROM norm GROUP BY r, conv_id, turn, role),
held AS (SELECT conv_id, key, min(turn) AS origin FROM (
           SELECT conv_id, turn, trim(regexp_replace(lower(own_text), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM own
           UNION ALL SELECT conv_id, turn, key FROM blocks WHERE level = 0 UNION ALL SELECT conv_id, turn, key FROM norm WHERE level = 0)
         WHERE key <> '' GROUP BY conv_id, key),
asked AS (SELECT r, conv_id, turn, level, passage, key, 1 AS is_whole FROM blocks WHERE level > 0
          UNION ALL SELECT DISTINCT r, conv_id, turn, level, passage, key, 0 FROM norm WHERE level > 0),
votes AS (SELECT a.r, a.level, a.passage, h.origin, max(is_whole) AS is_whole, count(*) AS n
          FROM asked a LEFT JOIN held h ON h.conv_id = a.conv_id AND h.key = a.key AND h.origin < a.turn GROUP BY ALL),
best AS (SELECT r, level, passage, origin FROM votes QUALIFY row_number() OVER (
           PARTITION BY r, passage ORDER BY origin IS NULL, is_whole DESC, n DESC, origin DESC) = 1),
links AS (SELECT r, count(*) AS n_quotes, count(origin) AS n_linked, max(level) AS max_level FROM best GROUP BY r),
nearest AS (SELECT r, origin FROM best WHERE origin IS NOT NULL QUALIFY row_number() OVER (PARTITION BY r ORDER BY level, origin DESC) = 1),
told AS (
  SELECT conv_id, turn, role, own_text, coalesce(n.origin, b.turn_before) AS parent_turn, coalesce(n_quotes, 0) AS n_quotes,
         coalesce(n_linked, 0) AS n_linked, CAST(coalesce(max_level, 0) AS INTEGER) AS max_level, CAST(floor(turn / 64.0) AS BIGINT) AS span
  FROM own LEFT JOIN links USING (r) LEFT JOIN nearest n USING (r)
  LEFT JOIN (SELECT DISTINCT conv_id AS c, turn AS turn_before FROM conversations) b ON b.c = conv_id AND b.turn_before + 1 = turn),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, span ORDER BY turn NULLS FIRST, role NULLS FIRST, own_text, parent_turn NULLS FIRST, n_quotes, n_linked, max_level) - 1 AS place FROM told),
parts AS (SELECT * EXCLUDE (place), place // 64 AS piece, CAST(place % 64 + 1 AS INTEGER) AS position FROM placed),
chats AS (SELECT conv_id, span, piece, sha256(string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || own_text || chr(10) || '<|end|>' || chr(10), '' ORDER BY position)) AS chat_sha256
          FROM parts GROUP BY conv_id, span, piece)
SELECT p.*, chat_sha256 FROM parts p JOIN chats c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.span IS NOT DISTINCT FROM c.span AND p.piece = c.piece
"""


#: CRC-32 of a number's decimal digits: each digit's code, then eight steps of the register.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""

OP11 = f"""
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS place,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1),
shape AS (SELECT o.conv_id, o.conv_id - o.conv_id % 5 AS root, o.h, least(o.h, coalesce(r.n, 0)) AS n_head FROM (SELECT *, {_CRC} % 9 AS h FROM own) o LEFT JOIN own r ON r.conv_id = o.conv_id - o.conv_id % 5),
built AS (
  SELECT s.conv_id, place + 1 AS depth, role, text FROM shape s JOIN turns t ON t.conv_id = s.root AND place < h
  UNION ALL SELECT s.conv_id, place - h + n_head + 1, role, text FROM shape s JOIN turns t ON t.conv_id = s.conv_id AND place >= h),
prefixes AS (
  SELECT conv_id, depth, strlen(text) AS bytes, max(depth) OVER (PARTITION BY conv_id) AS total,
         md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS key FROM built
  UNION ALL SELECT conv_id, 0, 0, coalesce((SELECT max(depth) FROM built b WHERE b.conv_id = shape.conv_id), 0), '' FROM shape),
nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, max(total) > depth AS inner_,
         sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (total = depth), '')) AS ends_sha256 FROM prefixes GROUP BY key, depth),
paths AS (SELECT n.key, n.depth, p.key AS top, p.depth AS top_depth FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth),
below AS (
  SELECT top AS key, count(*) FILTER (NOT inner_) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens, count(*) FILTER (n.depth = top_depth + 1) AS n_children
  FROM paths JOIN nodes n USING (key) GROUP BY top),
parents AS (SELECT p.key, n.conv_id AS parent_conv_id FROM paths p JOIN nodes n ON n.key = p.top AND p.top_depth = p.depth - 1)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM nodes JOIN below USING (key) LEFT JOIN parents USING (key)
"""


_STOP = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
_FAILED = ", ".join(f"CASE WHEN {r.sql()} THEN '{r.name}' END" for r in rules.RULES)
_BASE = " OR ".join(r.sql() for r in rules.RULES if r.base)

OP13 = rf"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
parts AS (SELECT *, regexp_extract_all(t, '{rules.WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{rules.WORD}')) AS l FROM texts),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM parts)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
covered AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM twice) GROUP BY r),
measured AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{rules.SPACE}', '', 'g')) AS word_chars, length(regexp_replace(t, '{rules.SYMBOLS}', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_lettered_words,
         len(list_filter(w, lambda x: lower(regexp_replace(x, '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g')) IN ({_STOP}))) AS n_stop_words,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '[\p{{Ll}}\p{{Lo}}]') AND length(x) > 1)) AS n_shouted_words,
         len(list_filter(l, lambda x: regexp_matches(x, '^[ 	-]*[-*•·][ 	-]'))) AS n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '([.][.][.]|…)[ 	-]*$'))) AS n_ellipsis_lines
  FROM parts LEFT JOIN covered USING (r))
SELECT *, array_to_string(list_filter([{_FAILED}], lambda x: x IS NOT NULL), ',') AS failed, {_BASE} AS base_failed, len(list_filter([{_FAILED}], lambda x: x IS NOT NULL)) = 0 AS kept FROM measured
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_quotations": OP8, "op9_decontamination": OP9, "op11_conversation_trie": OP11, "op13_quality_rules": OP13}
