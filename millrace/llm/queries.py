"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontam, fingerprints, idstore, langid, linededup, lm, simhash, substring, toxicity
from millrace.llm.sampling import fold
from millrace.llm.shared import lean, scratch, written

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: End id and vocabulary size of the store that op8 writes.
END_ID, VOCABULARY = 2, 50_257
#: Radius of op7's search.
NEAR_BITS = 6


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.roundtrip(documents(spark, sf_dir).select("doc_id", "text"), MULTI_RANKS, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.where(~held), labels.where(~held))
    scored = docs.select("doc_id", held.alias("held_out"), toxicity.score(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup(documents(spark, sf_dir))
    return kept.select("doc_id", F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"), F.sha2("text", 256).alias("text_sha256"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False))
    made = lm.fit_and_score(docs, held)
    return made.select("doc_id", F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decontam.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return made.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.removed(documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.edited_pairs(documents(spark, sf_dir))
    rows = written(made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"), "fingerprints")
    # the search: documents within the radius of those whose id is divisible by 100
    asks = F.col("doc_id") % 100 == 0
    found = fingerprints.near_counts(rows, rows.where(asks), NEAR_BITS).withColumnRenamed("fp", "fingerprint")
    return rows.join(found, "fingerprint", "left").select(*rows.columns, F.when(asks, F.col("n_near")).alias("n_near"))


def op8_idstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "idstore")
    idstore.write_store(documents(spark, sf_dir), path, TOKENIZER, END_ID, VOCABULARY)
    return idstore.read_store(spark, path).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held))
    named = docs.select("doc_id", held.alias("held_out"), langid.predict(spark, model, F.col("text")).alias("p"))
    return named.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(documents(spark, sf_dir), words=3, radius=2, segments=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_toxicity, op3_lines, op4_lm, op5_decontaminate, op6_substring, op7_fingerprints, op8_idstore, op9_langid, op10_simhash)}
#: Words of a text for op6, in DuckDB.
_OP6 = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
n AS (SELECT doc_id, r, words, unnest(range(1, len(words) - 48)) AS pos FROM w WHERE len(words) >= 50),
h AS (SELECT doc_id, r, pos, md5(array_to_string(list_slice(words, pos, pos + 49), ' ')) AS body FROM n),
low AS (SELECT body, min(doc_id) AS m FROM h GROUP BY body),
hit AS (SELECT DISTINCT h.r, unnest(range(h.pos, h.pos + 50)) AS place FROM h JOIN low USING (body) WHERE low.m < h.doc_id),
gone AS (SELECT r, list(place) AS places FROM hit GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
 sha256(array_to_string(list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(coalesce(places, []), x[2])), lambda x: x[1]), ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (r)
"""

#: Words of a text for op5, in DuckDB.
_OP5_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP5 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_OP5_WORDS} AS words FROM documents),
i AS (SELECT item_id, {_OP5_WORDS} AS words FROM benchmark WHERE item_id IS NOT NULL),
c AS (SELECT item_id, words, unnest(range(1, greatest(2, len(words) - 8))) AS pos, least(10, len(words)) AS n FROM i WHERE len(words) > 0),
w AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(words, pos, pos + n - 1), ' ') AS body FROM c),
p AS (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM w) WHERE len(words) >= n),
h AS (SELECT p.r, p.pos, p.n, w.item_id FROM p JOIN w ON w.n = p.n AND w.body = array_to_string(list_slice(p.words, p.pos, p.pos + p.n - 1), ' ')),
k AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS place FROM h) GROUP BY r),
g AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (r) LEFT JOIN g USING (r)
"""

ORACLES: dict[str, str] = {"op5_decontaminate": _OP5, "op6_substring": _OP6}
