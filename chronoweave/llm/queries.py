"""Queries that apply the operators of this subpackage to whole tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import alignment, ann, bpe, conversation_repair, exact_dedup, language_id, line_dedup, near_dedup, odd_sketch, packing, quality, sharding, toxicity


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.languages(table(spark, folder, "documents"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.toxicity(table(spark, folder, "documents"), labels)


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, folder, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    decided = exact_dedup.decide(table(spark, folder, "documents"))
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(table(spark, folder, "documents"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_ann(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    # In a plain scan, the file and the row within it tell rows apart; no copy is needed.
    place = F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")
    done = line_dedup.dedup_lines(table(spark, folder, "documents"), place=place)
    return done.select("doc_id", "lines", "dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.quality_scores(table(spark, folder, "documents"), labels)


def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_dedup.near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, folder, "conversations")))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    files = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    return alignment.alignment_counts(table(spark, folder, "documents"), *files, public_tokenizers.PATTERN)


def op13_odd_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_sharding": op5_sharding,
    "op6_packing": op6_packing,
    "op7_ann": op7_ann,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality": op9_quality,
    "op10_near_dedup": op10_near_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_alignment": op12_alignment,
    "op13_odd_sketch": op13_odd_sketch,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op4_exact_dedup": r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
  FROM documents
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256
FROM (
  SELECT doc_id, plain,
         first_value(doc_id) OVER (PARTITION BY plain ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY plain) AS group_size
  FROM rows
)
""",
    "op11_conversation_repair": r"""
WITH RECURSIVE
told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
),
parts AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(
           list_concat([4294967295::BIGINT], flatten(list_transform(string_split(name, ''), lambda c: list_concat([ord(c)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
           lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384::BIGINT) ELSE crc // 2 END
         ), 4294967295::BIGINT) % 20 AS part
  FROM told
),
hurt AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, CASE WHEN part = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN part = 1 THEN '' WHEN part = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, part
  FROM parts
),
rows AS (
  SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS place
  FROM (SELECT *, unnest(range(CASE part WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM hurt)
),
coded AS (
  SELECT c, turn, role, text, place, left(role, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY place) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM rows
),
inserted(state, after, letters, lines) AS (
  VALUES (0, 0, '', NULL), (1, 1, '', NULL), (2, 2, '', NULL), (3, 3, '', NULL), (0, 2, 'I', 'user:'), (1, 2, 'I', 'user:'), (2, 3, 'I', 'assistant:'),
         (3, 2, 'I', 'user:'), (0, 3, 'II', 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 'user:' || chr(10) || 'assistant:')
),
edits(edit, state, initial, role, after, cost) AS (
  VALUES ('D', 0, NULL, NULL, 0, 3), ('D', 1, NULL, NULL, 1, 3), ('D', 2, NULL, NULL, 2, 3), ('D', 3, NULL, NULL, 3, 3),
         ('K', 0, 's', NULL, 1, 0), ('K', 0, 'u', NULL, 2, 0), ('K', 1, 'u', NULL, 2, 0), ('K', 3, 'u', NULL, 2, 0), ('K', 2, 'a', NULL, 3, 0),
         ('R', 0, NULL, 'user', 2, 2), ('R', 1, NULL, 'user', 2, 2), ('R', 2, NULL, 'assistant', 3, 2), ('R', 3, NULL, 'user', 2, 2)
),
walk AS (
  SELECT DISTINCT c, 0::BIGINT AS place, 0 AS state, {'cost': 0, 'audit': '', 'lines': NULL::VARCHAR} AS best FROM hurt
  UNION ALL
  SELECT c, place, state, min(best) FROM (
    SELECT w.c, r.place, e.after AS state, {
      'cost': w.best.cost + 2 * length(i.letters) + e.cost + CASE WHEN r.fault = 'truncated' AND e.edit <> 'D' THEN 1 ELSE 0 END,
      'audit': w.best.audit || i.letters || e.edit,
      'lines': nullif(concat_ws(chr(10), w.best.lines, i.lines, CASE WHEN e.edit <> 'D' THEN coalesce(e.role, r.role) || ':' || r.text END), '')
    } AS best
    FROM walk w JOIN coded r ON r.c = w.c AND r.place = w.place + 1 JOIN inserted i ON i.state = w.state JOIN edits e ON e.state = i.after
    WHERE (e.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate')) AND (e.initial IS NULL OR e.initial = r.initial)
  ) GROUP BY c, place, state
),
ends AS (
  SELECT w.c, min({'cost': w.best.cost + 2 * length(i.letters), 'audit': w.best.audit || i.letters, 'lines': concat_ws(chr(10), w.best.lines, i.lines)}) AS best
  FROM walk w JOIN (SELECT h.c, count(r.place) AS n FROM (SELECT DISTINCT c FROM hurt) h LEFT JOIN coded r ON r.c = h.c GROUP BY h.c) s ON s.c = w.c AND s.n = w.place
  JOIN inserted i ON i.state = w.state WHERE i.after IN (0, 3) GROUP BY w.c
),
counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY c ORDER BY place) AS before FROM coded) GROUP BY c
)
SELECT h.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, e.best.cost::BIGINT AS cost, e.best.audit AS audit,
       sha256(e.best.lines) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM hurt) h JOIN ends e USING (c) LEFT JOIN counts USING (c)
""",
}
