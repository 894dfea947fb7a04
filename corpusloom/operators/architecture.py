"""Architecture rules: which files may refer to which."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


@dataclass(frozen=True)
class Rule:
    """Files that ``source`` matches must not refer to what ``target`` matches; other kinds are not evaluated."""

    kind: str
    source: str
    target: str


def check(references: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rule, status, violations, first_path`` for each rule over ``path, target``.

    Rules come from a configuration, so they are conditions of one pass over the references rather than a
    join; only violations are grouped.  A rule without violations passes; one of another kind than
    ``forbidden_dependency`` is not evaluated.
    """
    spark = references.sparkSession
    hits = [F.when(F.col("path").rlike(S.glob_regex(r.source)) & F.col("target").rlike(S.glob_regex(r.target)), F.lit(i)) for i, r in enumerate(rules) if r.kind == "forbidden_dependency"]
    broken = references.select("path", F.explode(F.array_compact(F.array(*hits))).alias("rule")) if hits else references.select("path", F.lit(0).alias("rule")).where("false")
    counts = broken.groupBy("rule").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))
    all_rules = spark.createDataFrame([(i, r.kind) for i, r in enumerate(rules)], "rule int, kind string")
    status = F.when(F.col("kind") != "forbidden_dependency", "not_evaluated").when(F.col("n").isNull(), "pass").otherwise("fail")
    return all_rules.join(counts, "rule", "left").select("rule", status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("violations"), "first_path")
