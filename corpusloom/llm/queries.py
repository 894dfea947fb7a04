"""Queries of the operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, counts, embeddings, lines, mixing, negatives, ngrams, pieces, runs, shards, simhash, toxicity, urls


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), decoded_col="decoded")
    return coded.select("doc_id", F.size("piece_ids").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_hash"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


def op3_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of every document, made from its columns: a replacement, an insertion and a deletion."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    size = F.coalesce(F.length("text"), F.lit(0)) + 1

    def edit(k: int, length: int, insert) -> object:
        return F.struct(F.pmod(F.xxhash64("doc_id", F.lit(k)), size).cast("int").alias("start"), F.lit(length).alias("length"), insert.alias("insert"))

    edits = F.array(edit(1, 12, F.concat_ws(" ", "source", "doc_id", "lang")), edit(2, 0, F.concat(F.lit("\n"), "lang", F.lit("'s  "))), edit(3, 30, F.lit("")))
    out = counts.count_with_edits(docs.withColumn("edits", edits))
    return out.select("doc_id", "n_before", "n_after", "n_edits", "encoded_again")


def op4_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn sounded as a recording; those of conversations with an id divisible by 50 against all."""
    turns = _read(spark, sf_dir, "conversations")
    prints = audio.fingerprints(audio.recordings(turns, ["conv_id", "turn"]), ["conv_id", "turn"])
    out = audio.align(prints, ["conv_id", "turn"], F.coalesce(F.col("conv_id") % 50 == 0, F.lit(False)))
    return out.select("conv_id", "turn", F.col("matched.conv_id").alias("match_conv_id"), F.col("matched.turn").alias("match_turn"), "copies", "shift", "votes", "errors", F.col("recording.conv_id").alias("recording_conv_id"), F.col("recording.turn").alias("recording_turn"), "own_copies")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_read(spark, sf_dir, "documents"), similarity=0.8)
    return out.select("doc_id", "lines_dropped", F.length("text").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_read(spark, sf_dir, "documents"), max_repeats=2.0)
    return out.select("doc_id", "source", "mix_epoch", "mix_block", "mix_order")


def op6_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(held_out(7).eqNullSafe(False)))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out(7).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def held_out(op: int):
    """Whether a document is held out from learning, by its id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % {7: 3, 10: 5}[op] == 1, F.lit(False))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), width=3, distance=2)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"), block=["net/", "example.com/de/"], allow=["example.net/en/", "org/fr/"])


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(_read(spark, sf_dir, "documents"), held_out(10))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return runs.periodic_runs(docs, least=24, times=3, change=runs.folded, digests=True)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shard(_read(spark, sf_dir, "documents"), 8, grown=9)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("slot").alias("virtual_slot"), F.col("version").alias("map_version"), F.col("shard_grown").alias("shard_by_version_2"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    shifted = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(shifted, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256)


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_line_dedup, op3_edit_counts, op4_audio_fingerprints, op5_mixing, op6_embedding_near_dups, op7_toxicity, op8_simhash, op9_url_filters, op10_lm_scoring, op11_periodic_runs, op12_sharding, op13_hard_negatives)}

_OP9 = r"""
WITH p AS (
  SELECT page_id,
    lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')) AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT page_id, host, path, rh || rp AS rule, v,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""

_OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS other, b.label AS label, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE own = label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
  SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s USING (anchor_id) WHERE own <> label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

ORACLE_SQL = {"op9_url_filters": _OP9, "op13_hard_negatives": _OP13}
