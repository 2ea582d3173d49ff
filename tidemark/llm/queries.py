"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, language, media, packing, quality, resampling, sharding, speculative, syncmers, token_files, toxicity, whitening
from .common import table
from .folds import held_out


def _classified(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by Jaccard similarity of 3-word shingles of 0.9 or more; see jaccard.join_documents for nulls and ties."""
    return jaccard.join_documents(table(spark, sf_dir, "documents"), 3, jaccard.Threshold(90, 100))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned outside the held-out fold; a null or empty text scores the bias, a null id is not held out."""
    return _classified(toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 0.5)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of all documents, each a sequence of its own; a null text is its end id alone."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts; see syncmers.compare_edited for null and repeated ids."""
    return syncmers.compare_edited(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all texts and the bytes decoded from them, as digests; a null text is empty."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned outside the held-out fold; null and empty texts are scored, a null id is not held out."""
    return _classified(quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 0.3)


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of near-equal row counts along a Hilbert curve (law rows).

    Groups of equal texts lie side by side where source and language agree, as size and
    text_crc32 then do; the law cuts between rows, so a group may cross from one shard to
    the next.  Null ids and texts are rows like any other.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit("")).cast("binary")
    named = {f"_c{i}": c for i, c in enumerate(sharding.document_cells(docs))}
    rows = docs.select(F.col("doc_id").cast("long"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *[c.alias(k) for k, c in named.items()])
    out = sharding.shard(rows, [F.col(k) for k in named], ["text_crc32", "doc_id"])
    return out.drop(*named).withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op8_wav_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as WAV clips, read back: digests and peak-pair arrays; a null text is empty."""
    return media.digests(media.text_media(table(spark, sf_dir, "documents")))


def op9_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents in ascending id order, and what is read back from them; a null text is its end id alone."""
    return token_files.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned outside the held-out fold; `und` for a text without a letter, a null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op11_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE ids of all texts by speculation and the text decoded from them, as digests; a null text is empty."""
    return speculative.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark's words, and the ranks of those drawn; a null text has no features."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 8 whitened components of all embeddings; a deviation that no long holds is null (whiten gives it as a decimal)."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_toxicity, op3_packing, op4_syncmers, op5_byte_bpe, op6_quality, op7_hilbert_sharding, op8_wav_peaks, op9_elias_fano, op10_language, op11_speculative_bpe, op12_resampling, op13_whitening)}

#: SQL has no crc32: a word's is folded from its bytes by the polynomial's table, itself made by the rule.
OP12_SQL = """
WITH RECURSIVE
step(byte, round, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT byte, round + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE round < 8
),
crc AS (SELECT list(c ORDER BY byte) AS t FROM step WHERE round = 8),
found AS (
  SELECT 0 AS target, rowid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM (SELECT row_number() OVER () AS rowid, text FROM documents)
  UNION ALL
  SELECT 1, NULL, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
),
occurrences AS (SELECT target, rowid, unnest(words) AS word FROM found),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(word))), lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS INT), 2) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) AS INT) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM occurrences), crc
),
counts AS (SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t FROM occurrences JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT count(*) FILTER (target = 0) AS all_s, count(*) FILTER (target = 1) AS all_t FROM occurrences),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts, totals),
weights AS (SELECT rowid, count(*) AS n, sum(gain) AS weight FROM occurrences JOIN hashed USING (word) JOIN gains USING (bucket) WHERE target = 0 GROUP BY rowid),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM (SELECT row_number() OVER () AS rowid, doc_id FROM documents) LEFT JOIN weights USING (rowid)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""

ORACLE_SQL: dict[str, str] = {"op12_resampling": OP12_SQL}
