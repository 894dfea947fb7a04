"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local one only where that is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that no later plan reads."""
    spark, path = df.sparkSession, getattr(df, "_written_at", None)
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def hand_out(spark: SparkSession, kind: str, parts: Iterable[bytes]) -> str:
    """Write a file of bounded size to the shared folder and have Spark copy it to every executor; tasks open
    ``SparkFiles.get`` of the name returned."""
    name = f"{kind}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    for part in parts:
        for i in range(0, len(part), 1 << 22):
            out.write(bytearray(part[i : i + (1 << 22)]))
    out.close()
    spark.sparkContext.addFile(at.toString())
    return name


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``edges`` has two columns of one orderable type, ``a`` and ``b``; loops and nulls are ignored.
    Returns ``node, root`` for every node that has an edge; ``root`` is the smallest node reachable.
    Each round is two aggregations with map-side combine and two equi-joins; its edges are written to
    the shared folder.  It ends when a round changes nothing.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = written(edges.where("a <> b").select(u, v).distinct(), "cc")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        after = written(small, "cc")
        before, mark = mark, _mark(after)
        forget(now)
        now = after
        if mark == before:
            break
    else:
        raise RuntimeError("connected_components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def links_of_meetings(meets: DataFrame, similarity: float, alike, rounds: int = 2) -> DataFrame:
    """``a, b``: links for which ``alike`` holds, that join what all such pairs of a meeting place would join.

    ``meets`` has ``variant, gid`` and, if known, ``size``; sizes further apart than ``similarity`` can't be alike.  ``alike`` keeps
    of distinct pairs ``a, b`` those that are.  In the first ``rounds``, a place's rows are held against one of
    them, another each time; then all its pairs that aren't joined yet are.  So a large group of copies costs
    a pair for each of its rows and not for each two of them.
    """
    links = tried = None
    sized = [c for c in ("size",) if c in meets.columns]
    fits = F.least("size", "size_b") >= F.lit(similarity) * F.greatest("size", "size_b") - 1e-9 if sized else F.lit(True)
    pair = (F.greatest("gid", "gid_b").alias("a"), F.least("gid", "gid_b").alias("b"))
    for turn in range(rounds + 1):
        if links is None:
            placed = meets.withColumn("root", F.col("gid"))
        else:
            roots = connected_components(links).withColumnRenamed("node", "gid")
            placed = meets.join(roots, "gid", "left").withColumn("root", F.coalesce("root", "gid"))
            mixed = placed.groupBy("variant").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("variant")
            placed = written(placed.join(mixed, "variant"), "mixed")
        if turn < rounds:
            lead = F.min(F.struct(F.xxhash64("gid", F.lit(turn)).alias("h"), "gid", *sized, "root")).alias("lead")
            other = placed.groupBy("variant").agg(lead).select("variant", *[F.col(f"lead.{c}").alias(f"{c}_b") for c in ("gid", *sized, "root")])
        else:
            other = placed.select("variant", *[F.col(c).alias(f"{c}_b") for c in ("gid", *sized, "root")])
        pairs = placed.join(other, "variant").where("root <> root_b").where(fits).select(*pair).distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        good = written(alike(pairs), "links")
        tried = pairs if tried is None else tried.union(pairs)
        links = good if links is None else links.union(good)
    return links


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it a name that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def groups_of(texts: list, size: int = 300_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``size`` characters each; a longer text is by itself."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n > size or i == len(texts) - 1:
            yield at, i + 1
            at, n = i + 1, 0


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


class Forest:
    """Union-find over positions 0..n-1 of one task's rows."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True
