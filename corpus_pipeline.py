"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import lines, mixing, pieces, simhash, toxicity
from corpusloom.llm.queries import held_out
from corpusloom.llm.shared import fresh, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored 0.7 or more by a model of the labelled ones that are not held out; null and empty texts
    stay, repeated rows share their fate, other columns pass as they are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(held_out(7).eqNullSafe(False))
    score = fresh(docs, "toxic_score")
    return toxicity.score(docs, toxicity.fit(docs, labels), keep=tuple(docs.columns), out_col=score).where(F.col(score) < 0.7).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one occurrence of each group of near-equal lines; drops documents of which nothing is left.  ``n_chars``
    follows the text where lines go; null and empty texts stay; other columns pass as they are."""
    own = fresh(docs, "own_dropped")
    before = docs.withColumnRenamed("lines_dropped", own)
    out = lines.dedup_lines(before, similarity=0.8)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("lines_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("lines_dropped").withColumnRenamed(own, "lines_dropped").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that a Jaccard similarity of 5-word shingles of 0.8 connects: of the smallest
    id, then hash of the text, then the other columns written as JSON.  Rows that share an id but not a group each stay, and
    so do rows without an id."""
    low = simhash.near_copies(docs, width=5, similarity=0.8).where("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "tk")).alias("low"))
    key, n = fresh(docs, "text_key"), fresh(docs, "nth")
    kept = docs.where("doc_id is not null").withColumn(key, F.xxhash64("text")).join(low.select("low.doc_id", F.col("low.tk").alias(key)).distinct(), ["doc_id", key], "left_semi")
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(1).alias("x")]))
    same = Window.partitionBy("doc_id", key).orderBy("text", rest)
    once = kept.withColumn(n, F.row_number().over(same)).where(F.col(n) == 1).select(docs.columns)
    return once.union(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, none more than twice, so that weights are as flat as that allows; every row
    stays at least once, a null source is one of its own, other columns pass as they are."""
    keep = {c: f"__own_{c}" for c in ("mix_epoch", "mix_block", "mix_order") if c in docs.columns}
    out = mixing.mix(docs.withColumnsRenamed(keep), max_repeats=2.0).drop("mix_epoch", "mix_block", "mix_order")
    return out.withColumnsRenamed({b: a for a, b in keep.items()}).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the SentencePiece ids of each text; none for null and empty texts."""
    return pieces.encode(docs.drop("piece_ids"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("simhash", drop_near_duplicates), ("mixing", mix_sources), ("sentencepiece", encode)]
#: SQL can't express the label model, SimHash components or the lattice; tests hold the operators, and of the stages only SimHash, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
