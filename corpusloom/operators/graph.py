"""The reference graph: resolution, backlinks, second hops, reachability and impact."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.saved import saved


def resolve(ids: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """``key, state, paths``: found, not_found, or ambiguous with all paths in order."""
    found = entities.groupBy(key).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    n = F.coalesce(F.size("paths"), F.lit(0))
    state = F.when(n == 1, "found").when(n > 1, "ambiguous").otherwise("not_found")
    return ids.join(found, key, "left").select(key, state.alias("state"), F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))


def backlinks(edges: DataFrame) -> DataFrame:
    """``dst, n_sources, first_source``."""
    return edges.groupBy("dst").agg(F.count_distinct("src").alias("n_sources"), F.min("src").alias("first_source"))


def second_hop(edges: DataFrame) -> DataFrame:
    """Pairs two outgoing edges apart that are neither one edge apart nor the same."""
    e1, e2 = edges.select("src", F.col("dst").alias("mid")), edges.select(F.col("src").alias("mid"), "dst")
    return e1.join(e2, "mid").select("src", "dst").where("src <> dst").distinct().join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def affected(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """``id, hops``: what reaches a changed id against the direction of references, with the fewest hops.

    A breadth-first walk: each round joins the frontier with the edges and leaves out what was seen; the
    changed ids themselves are not reported.  It ends when the frontier is empty.  Edges and rounds are written tables.
    """
    back = saved(edges.select(F.col("dst").alias("id"), F.col("src").alias("next")), "back")
    seen = front = saved(changed.select("id").distinct().withColumn("hops", F.lit(0)), "front")
    for hop in count(1):
        front = front.select("id").join(back, "id").select(F.col("next").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop))
        front = saved(front, "front")
        if front.isEmpty():
            break
        seen = saved(seen.union(front), "seen") if hop % 10 == 0 else seen.union(front)
    return seen.where("hops > 0")


def unresolved(refs: DataFrame, entities: DataFrame, on: str) -> DataFrame:
    return refs.join(entities.select(on).distinct(), on, "left_anti")
