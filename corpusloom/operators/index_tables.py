"""The index as tables: documents, chunks and links of artifact files, kept in step with the files by their fingerprints.

Tables are partitioned by a hash of the path.  A sync parses only files that are new or changed, and writes only the partitions in which
something changed.  Documents are written last: they tell what is indexed, so a sync that broke off is done again by the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.saved import forget, saved
from . import artifacts, markdown

SCHEMAS = {
    "documents": "path string, artifact_id string, artifact_type string, title string, fingerprint string, bucket int",
    "chunks": "path string, ord int, heading string, anchor string, content string, start_line int, end_line int, tokens bigint, bucket int",
    "links": "path string, source_id string, target_id string, relation string, ord int, source_section string, source_line int, target_anchor string, bucket int",
}


def _id(e: Column) -> Column:
    number = e["number"].cast("string")
    return F.when(e.isNotNull(), F.concat(e["prefix"], F.lit("-"), F.lpad(number, F.greatest(e["width"], F.length(number)), "0")))


def parsed(files: DataFrame, everything: DataFrame) -> dict[str, DataFrame]:
    """The rows of the tables for ``files`` (``path, content, bucket``); ``everything`` has the paths among which links are resolved.

    ``errors`` has the files that can't be parsed, with what is wrong; they have no rows.  A title is the heading of the first section; lines are
    counted in the file.  Links are formal references in order, then wikilinks to ids that stand in exactly one place.
    """
    meta = saved(artifacts.metadata(files.select("path", "content")), "metadata")
    good = meta.where("error is null")
    bodies = good.select("path", F.col("body").alias("content"))
    secs = saved(markdown.sections(bodies), "sections")
    offset = good.select("path", (F.col("body_line") - 1).alias("offset"))
    at = files.select("path", "bucket")
    titles = secs.groupBy("path").agg(F.min_by("heading", "ord").alias("title"))
    base = files.select("path", "bucket", S.fingerprint(F.col("content")).alias("fingerprint"))
    docs = good.join(base, "path").join(titles, "path", "left").select("path", _id(F.col("id")).alias("artifact_id"), S.classify_path(F.col("path")).alias("artifact_type"), F.coalesce("title", F.lit("")).alias("title"), "fingerprint", "bucket")
    chunks = markdown.chunks(secs).join(offset, "path").join(at, "path").select("path", "ord", "heading", "anchor", F.col("body").alias("content"), (F.col("start_line") + F.col("offset")).alias("start_line"), (F.col("end_line") + F.col("offset")).alias("end_line"), "tokens", "bucket")
    source = good.select("path", _id(F.col("id")).alias("source_id")).where("source_id is not null")
    none = lambda kind: F.lit(None).cast(kind)
    formal = artifacts.formal_edges(good).select("path", _id(F.col("target")).alias("target_id"), "relation", F.col("ord").cast("int").alias("ord"), none("string").alias("source_section"), none("int").alias("source_line"), none("string").alias("target_anchor"))
    places = artifacts.entities(everything).groupBy("kind", "number").agg(F.count("*").alias("n")).where("n = 1")
    found = markdown.wikilinks(bodies).withColumn("e", S.parse_id(F.col("target"))).where("e is not null")
    found = found.join(places, (F.col("e.type") == F.col("kind")) & (F.col("e.number") == F.col("number")))
    where = markdown.occurrences(found.select("path", "line", "ord", "target"), secs).select("path", "line", "ord", "section")
    links = found.join(where, ["path", "line", "ord"]).join(offset, "path").select(
        "path", _id(F.col("e")).alias("target_id"), F.lit("wikilink").alias("relation"), (F.col("line") * 1000 + F.col("ord")).cast("int").alias("ord"),
        F.nullif("section", F.lit("")).alias("source_section"), (F.col("line") + F.col("offset")).cast("int").alias("source_line"), F.nullif("anchor", F.lit("")).alias("target_anchor"),
    )
    links = formal.unionByName(links).join(source, "path").join(at, "path").select("path", "source_id", "target_id", "relation", "ord", "source_section", "source_line", "target_anchor", "bucket")
    return {"documents": docs, "chunks": chunks, "links": links, "errors": meta.where("error is not null").select("path", "error")}


def table(spark: SparkSession, at: str, name: str) -> DataFrame:
    """A table of the index at ``at``; empty if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).parquet(f"{at}/{name}")


def _overwrite(rows: DataFrame, at: str, name: str, buckets: list[int]) -> None:
    """Replaces the partitions ``buckets`` of a table by ``rows``; those without rows go."""
    spark = rows.sparkSession
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{at}/{name}")
    left = {r[0] for r in rows.select("bucket").distinct().collect()}
    for b in set(buckets) - left:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{name}/bucket={b}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sync(files: DataFrame, at: str, buckets: int = 64) -> DataFrame:
    """Brings the index at ``at`` up to the files ``path, content``; ``path, action, error`` of every file.

    ``action`` is indexed, updated, skipped (same fingerprint), removed (no such file any more) or failed (can't be parsed: what was indexed of it
    is gone).  The same files again are all skipped, but for those that failed, and write nothing.  ``buckets`` must stay what it was.
    """
    spark = files.sparkSession
    now = files.where("path is not null").select("path", F.coalesce("content", F.lit("")).alias("content"), F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket"))
    old = table(spark, at, "documents").select("path", F.col("fingerprint").alias("was"), F.col("bucket").alias("b"))
    both = now.select("path", "bucket", S.fingerprint(F.col("content")).alias("is")).join(old, "path", "full")
    action = F.when(F.col("is").isNull(), "removed").when(F.col("was").isNull(), "indexed").when(F.col("is") == F.col("was"), "skipped").otherwise("updated")
    plan = saved(both.select("path", F.coalesce("bucket", "b").alias("bucket"), action.alias("action")), "plan")
    todo = saved(now.join(plan.where("action in ('indexed', 'updated')").select("path"), "path", "left_semi"), "todo")
    rows = parsed(todo, now.select("path"))
    errors = saved(rows.pop("errors"), "errors")
    good = plan.where("action <> 'skipped'").join(errors.select("path"), "path", "left_anti").select("bucket")
    lost = plan.where("action = 'updated'").join(errors.select("path"), "path", "left_semi").select("bucket")
    touched = sorted(r[0] for r in good.union(lost).distinct().collect())
    if touched:
        keep = plan.where("action = 'skipped'").select("path")
        for name in ("chunks", "links", "documents"):
            before = table(spark, at, name).where(F.col("bucket").isin(touched)).join(keep, "path", "left_semi")
            after = saved(before.unionByName(rows[name].where(F.col("bucket").isin(touched))), name)
            _overwrite(after, at, name, touched)
            forget(after)
    return plan.join(errors, "path", "left").select("path", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("action")).alias("action"), "error")


def rebuild(files: DataFrame, at: str, buckets: int = 64) -> DataFrame:
    """Drops the tables and syncs."""
    spark = files.sparkSession
    for name in ("documents", "chunks", "links"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return sync(files, at, buckets)


def report(actions: DataFrame) -> DataFrame:
    """``action, n``."""
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def provenance(hits: DataFrame, spark: SparkSession, at: str) -> DataFrame:
    """Search hits ``path, start_line, rank`` with the heading, text, lines and artifact of their chunk."""
    chunks, docs = table(spark, at, "chunks"), table(spark, at, "documents").select("path", "artifact_id", "title")
    return hits.join(chunks, ["path", "start_line"]).join(docs, "path").select("path", "artifact_id", "title", "heading", "content", "start_line", "end_line", "rank")
