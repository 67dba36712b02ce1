"""Thin queries over the operators of this subpackage: each reads its whole table and derives digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.llm import (bpe, chunk_dedup, conversation_repair, decontaminate, language_id, lexical_search, mixing, pii, quality_rules, sharding,
                          simhash, suffix_dedup, token_counts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return sharding.shard_documents(table(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What content-defined chunking removes from every document."""
    return chunk_dedup.substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_chunks", "n_removed", "n_spans",
        F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def held_out() -> Column:
    """One third of the documents, by the check sum of the id; NULL ids belong to the others."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the two thirds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.language_id(docs, docs.where(~held_out()).select("text", "lang"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def token_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, one row per input row."""
    return bpe.bpe_round(docs).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_bpe_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; digests of both."""
    return token_digests(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte of every document that lies in a 200-byte string with another place, removed."""
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def edits_of(docs: DataFrame) -> DataFrame:
    """A stand-in edit table: three edits a document, at places that follow from its id and length."""
    size = F.char_length("text")
    spot = F.pmod(F.xxhash64("doc_id"), size + 1)
    rows = F.array(
        F.struct(F.lit(1).alias("edit"), spot.alias("at"), F.lit(12).alias("deleted"), F.substring("text", 3, 30).alias("inserted")),
        F.struct(F.lit(2).alias("edit"), F.pmod(spot * 7 + 3, size + 1).alias("at"), F.lit(0).alias("deleted"),
                 F.lit(" an inserted remark,\n").alias("inserted")),
        F.struct(F.lit(3).alias("edit"), F.lit(0).cast("long").alias("at"), F.lit(5).alias("deleted"), F.lit("").alias("inserted")))
    return docs.where("text is not null").select("doc_id", F.explode(rows).alias("e")).select("doc_id", "e.*")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, before and after a table of edits."""
    docs = table(spark, sf_dir, "documents")
    found = token_counts.apply_edits(token_counts.count_tokens(docs), edits_of(docs))
    return found.select("doc_id", "n_before", "n_tokens", "n_edits", "n_encoded",
                        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, and the terms that give entities away."""
    found = pii.sanitised_spans(table(spark, sf_dir, "documents"))

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long").alias(f"n_{pii.KINDS[i]}")

    return found.select("doc_id", *map(count, range(4)), F.sha2(pii.told("base").cast("binary"), 256).alias("base_sha256"),
                        pii.told("spans").alias("spans"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression-band quality rules over all documents."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs, draws = mixing.mix(table(spark, sf_dir, "documents"))
    times = draws.groupBy("row").agg(F.count("*").alias("n"))
    return docs.join(times, "row", "left").select("doc_id", "size", "source_size", "target",
                                                  (F.col("size") * F.coalesce("n", F.lit(0))).alias("taken"))


def damaged(rows: DataFrame) -> DataFrame:
    """Damaged conversations: conv_id, turn, role, text and the number of copies, by the check sum of conversation and turn."""
    at = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.pmod(F.crc32(at.cast("binary")), F.lit(20))
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    return rows.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    rows = table(spark, sf_dir, "conversations")
    found = conversation_repair.report(*conversation_repair.repair(damaged(rows), copies=F.col("copies"))).withColumnRenamed("conv_id", "c")
    out = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_sharding": op2_sharding,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_language_id": op5_language_id,
    "op6_bpe_round": op6_bpe_round,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_pii": op9_pii,
    "op10_quality_rules": op10_quality_rules,
    "op11_ranked_search": op11_ranked_search,
    "op12_mixing": op12_mixing,
    "op13_conversation_repair": op13_conversation_repair,
}
TERMS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
         r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
SQL: dict[str, str] = {
    "op11_ranked_search": f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS words FROM documents),
     item AS (SELECT DISTINCT item_id, text, list_distinct({TERMS}) AS words FROM benchmark),
     query AS (SELECT item_id, text, unnest(words) AS word FROM item),
     total AS (SELECT count(*) AS n, CAST(sum(len(words)) AS BIGINT) AS l FROM doc WHERE len(words) > 0),
     tf AS (SELECT r, word, count(*) AS tf FROM (SELECT r, unnest(words) AS word FROM doc) GROUP BY r, word),
     df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
     weight AS (SELECT word, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
     impact AS (SELECT q.item_id, q.text, t.r, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.words) * n) // l))) AS x
                FROM query q JOIN tf t USING (word) JOIN weight USING (word) JOIN doc d ON d.r = t.r, total),
     score AS (SELECT item_id, text, r, CAST(sum(x) AS BIGINT) AS score FROM impact GROUP BY item_id, text, r HAVING sum(x) > 0),
     ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
                       doc_id, score FROM score JOIN doc USING (r))
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
""",
    "op12_mixing": r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws(':', 'mix', coalesce(CAST(doc_id AS VARCHAR), '-'), coalesce(md5(text), '-'))) AS digest FROM documents),
src AS (SELECT source, source_size, 3 * source_size AS cap, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
        FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM doc GROUP BY source)),
rounds AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS share
  UNION ALL
  SELECT i + 1, coalesce((sum(source_size) - coalesce(sum(CASE WHEN cap <= weight * share THEN cap END), 0))
                         / sum(CASE WHEN cap > weight * share THEN weight END), max(share))
  FROM rounds, src WHERE i <= (SELECT count(*) FROM src) GROUP BY i),
goal AS (SELECT source, source_size, CASE WHEN cap <= weight * share THEN CAST(cap AS DOUBLE) ELSE weight * share END AS target
         FROM src, (SELECT arg_max(share, i) AS share FROM rounds)),
tape AS (SELECT doc_id, size, source_size, target, floor(target / source_size) AS whole,
                coalesce(sum(size) OVER (PARTITION BY doc.source ORDER BY digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
         FROM doc JOIN goal ON doc.source IS NOT DISTINCT FROM goal.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE CAST(size * least(3, whole + CASE WHEN 2 * upto + size <= 2 * (target - whole * source_size)
                                                                                THEN 1 ELSE 0 END) AS BIGINT) END AS taken
FROM tape
""",
}
