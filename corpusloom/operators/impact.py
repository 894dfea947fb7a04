"""Impact of changes: what refers to changed files, over how many paths, how surely and how badly.

References are walked backwards, level by level.  Each file is expanded once, by the first path that reaches it, and
every reference met on the way is kept as a path, so several paths to one file all show.  "First" is the order of a queue: paths
of fewer hops come first, and of those the one whose files were met earlier.  That order is carried as a key that grows by a hop's own order,
so no level is sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.saved import saved

#: The class of a relation, and the severity of a class and relation; others are suggestions of low severity.
CLASSES = {"depends_on": "deterministic_invalidation", "parent": "deterministic_invalidation", "supersedes": "deterministic_invalidation", "coverage": "deterministic_invalidation", "evidence": "deterministic_invalidation", "wikilink": "suggested_review"}
SEVERITIES = {"evidence": "high", "depends_on": "high", "parent": "high", "supersedes": "high", "coverage": "medium", "wikilink": "low"}
RANKS = {"high": 0, "medium": 1, "low": 2}
FORMAL = ["depends_on", "parent", "supersedes"]

HOP = "struct<relation:string,from_id:string,to_id:string,source_path:string,source_section:string,source_line:int,requirement:int,evidence:string>"


def _looked_up(table: dict, key: Column, other) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(other))


def classification(relation: Column) -> Column:
    return _looked_up(CLASSES, relation, "suggested_review")


def severity(relation: Column) -> Column:
    return _looked_up(SEVERITIES, relation, "low")


def _hop(**fields: Column | None) -> Column:
    kinds = dict(x.split(":") for x in HOP[7:-1].split(","))
    return F.struct(*[(fields[n] if n in fields else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def backward_hops(references: DataFrame) -> DataFrame:
    """``from_id, to_id, ord, hop``: each reference seen from its target.

    ``references``: ``source_id, target_id, relation, source_path`` and, for links, ``source_section, source_line, ord``; ``source_rank`` orders
    sources.  Of the references to one target formal ones come before links, then sources in order, then those of one source.
    """
    optional = {"source_section": "string", "source_line": "int", "ord": "int"}
    rows = references.select("*", *[F.lit(None).cast(k).alias(n) for n, k in optional.items() if n not in references.columns])
    key = F.struct((~F.col("relation").isin(FORMAL)).cast("int").alias("semantic"), F.col("source_rank").alias("rank"), F.col("source_path").alias("path"), F.coalesce("ord", F.lit(0)).alias("ord"))
    hop = _hop(relation=F.col("relation"), from_id=F.col("target_id"), to_id=F.col("source_id"), source_path=F.col("source_path"), source_section=F.col("source_section"), source_line=F.col("source_line"))
    return rows.select(F.col("target_id").alias("from_id"), F.col("source_id").alias("to_id"), key.alias("ord"), hop.alias("hop"))


def propagate(changed: DataFrame, hops: DataFrame) -> DataFrame:
    """``item, seq, hops``: every path by which a whole changed file reaches another one.

    ``changed``: ``id, ord``, files that changed as wholes, in their order; ``hops``: as :func:`backward_hops` gives them.  Changed files are
    never items.  The number of hops and then ``seq`` orders the paths of an item.  A cycle ends where it meets what is expanded already; it still gives a path.  The walk ends with
    an empty level; each level is written.  A row carries its path, which is as long as its level.
    """
    kind = hops.schema["ord"].dataType.simpleString()
    hops = saved(hops, "hops")
    start = changed.where("id is not null").groupBy("id").agg(F.min("ord").alias("first"))
    front = saved(start.select("id", F.array(F.struct(F.col("first").cast("long").alias("n"), F.lit(None).cast(kind).alias("o"))).alias("key"), F.array().cast(f"array<{HOP}>").alias("path")), "front")
    seen, ids, levels = front.select("id"), saved(start.select("id"), "changed"), []
    while not levels or not front.isEmpty():
        met = front.withColumnRenamed("id", "from_id").join(hops, "from_id").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
        met = met.select(F.col("to_id").alias("item"), F.concat("key", F.array(F.struct(F.lit(None).cast("long").alias("n"), F.col("ord").alias("o")))).alias("seq"), F.concat("path", F.array("hop")).alias("hops"))
        levels.append(saved(met, "level"))
        nxt = levels[-1].groupBy("item").agg(F.min(F.struct("seq", "hops")).alias("x")).select(F.col("item").alias("id"), F.col("x.seq").alias("key"), F.col("x.hops").alias("path"))
        front = saved(nxt.join(seen, "id", "left_anti"), "front")
        seen = saved(seen.union(front.select("id")), "seen") if len(levels) % 8 == 0 else seen.union(front.select("id"))
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def served_files(changed: DataFrame, files: DataFrame) -> DataFrame:
    """Task files of ``path, content`` in the folder of a changed requirement: no other can serve one, so no other need be parsed."""
    folders = changed.where("requirement is not null").select("spec_dir").distinct()
    return files.withColumn("spec_dir", F.regexp_replace("path", r"/tasks\.md\z", "")).join(folders, "spec_dir", "left_semi").drop("spec_dir")


def coverage(changed: DataFrame, tasks: DataFrame) -> DataFrame:
    """``item, seq, hops``: tasks of a spec that serve a changed requirement of it; each is a path of one hop.

    ``changed``: ``id, ord, requirement, spec_dir``; ``tasks``: as :func:`tasks.rows` gives them.  A task whose evidence failed or is stale is reached by
    ``evidence``, any other by ``coverage``.  Only references to the task's own spec count, one that comes twice twice.
    """
    refs = tasks.select("path", "number", "ord", "state", F.posexplode("serves").alias("at", "ref")).select(
        F.regexp_replace("path", r"/tasks\.md\z", "").alias("spec_dir"), F.col("path").alias("source_path"), "number", F.col("ord").alias("task_ord"), "at", "state",
        F.substring_index("ref", ":", 1).alias("id"), F.regexp_extract("ref", r":R([0-9]+)\z", 1).cast("int").alias("requirement"),
    )
    met = changed.where("requirement is not null").join(refs, ["id", "requirement", "spec_dir"])
    relation = F.when(F.col("state").isin("failed", "stale"), "evidence").otherwise("coverage")
    item = F.concat("id", F.lit(":"), F.format_string("TASK-%03d", "number"))
    hop = _hop(relation=relation, from_id=F.col("id"), to_id=item, source_path=F.col("source_path"), requirement=F.col("requirement"), evidence=F.col("state"))
    return met.select(item.alias("item"), F.struct("ord", "task_ord", "at").alias("seq"), F.array(hop).alias("hops"))


def reason(item: Column, hop: Column, before: str, after: str) -> Column:
    """Why an item is affected, by the last hop of its first path."""
    span = F.lit(f"changed between {before} and {after}")
    serves = F.concat(F.substring_index(item, ":", -1), F.lit(" serves "), hop["from_id"], F.lit(":R"), F.coalesce(hop["requirement"], F.lit(0)).cast("string"), F.lit(", whose content "), span)
    broken = F.concat(serves, F.lit("; its own recorded evidence is already "), hop["evidence"], F.lit(" against its current content"))
    formal = F.concat(item, F.lit(" "), hop["relation"], F.lit(" "), hop["from_id"], F.lit(", which "), span)
    link = F.concat(item, F.lit(" references "), hop["from_id"], F.lit(" (from "), hop["source_path"], F.lit("), which "), span)
    other = F.concat(item, F.lit(" is related to "), hop["from_id"], F.lit(" ("), hop["relation"], F.lit("), which "), span)
    r = hop["relation"]
    return F.when(r == "evidence", broken).when(r == "coverage", serves).when(r.isin(FORMAL), formal).when(r == "wikilink", link).otherwise(other)


def items(paths: DataFrame, before: str, after: str) -> DataFrame:
    """One row for each affected item of ``item, seq, hops``: what the first of its paths says, and all of them.

    ``id, path, classification, severity, severity_rank, reason, reverify, n_paths, paths``.  ``path`` is the file that refers, with ``#`` and the
    task for a task; ``reverify`` is the task to verify anew, if it is one and surely invalid.  The order of a report is
    ``severity_rank, path, id``.
    """
    each = paths.groupBy("item").agg(F.array_sort(F.collect_list(F.struct(F.size("hops").alias("n"), "seq", "hops"))).alias("xs"))
    hop = F.element_at(F.element_at("xs", 1)["hops"], -1)
    out = each.select(F.col("item").alias("id"), hop.alias("hop"), F.transform("xs", lambda x: x["hops"]).alias("paths"))
    relation, task = F.col("hop.relation"), F.contains(F.col("id"), F.lit(":"))
    sure = classification(relation) == "deterministic_invalidation"
    return out.select(
        "id", F.when(task, F.concat("hop.source_path", F.lit("#"), F.substring_index("id", ":", -1))).otherwise(F.col("hop.source_path")).alias("path"),
        classification(relation).alias("classification"), severity(relation).alias("severity"), _looked_up(RANKS, severity(relation), 2).alias("severity_rank"),
        reason(F.col("id"), F.col("hop"), before, after).alias("reason"), F.when(sure & F.contains(F.col("id"), F.lit(":TASK-")), F.col("id")).alias("reverify"), F.size("paths").alias("n_paths"), "paths",
    )


def without_relation(changed: DataFrame, hops: DataFrame, covered: DataFrame) -> DataFrame:
    """``id`` of changed elements that nothing refers to and no task serves; references from other changed files count."""
    near = hops.select(F.col("from_id").alias("id")).join(changed.where("requirement is null").select("id"), "id", "left_semi")
    served = covered.select(F.element_at("hops", 1)["from_id"].alias("id"))
    return changed.select("id").distinct().join(near.union(served).distinct(), "id", "left_anti")


def analyze(changed: DataFrame, references: DataFrame, tasks: DataFrame, before: str, after: str) -> DataFrame:
    """The whole report: ``id`` and the columns of :func:`items` for affected items, and elements without any relation with ``classification`` "no_known_relation".

    ``changed``: ``id, requirement`` (null for a whole file), ``spec_dir, ord``.
    """
    hops = backward_hops(references)
    covered = saved(coverage(changed, tasks), "covered")
    walked = propagate(changed.where("requirement is null").select("id", "ord"), hops)
    # a task is reached by coverage alone and a file by references alone, so their orders never meet
    found = items(covered, before, after).unionByName(items(walked, before, after))
    none = without_relation(changed, hops, covered)
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields if f.name not in ("id", "classification")]
    return found.unionByName(none.select("id", F.lit("no_known_relation").alias("classification"), *nulls))
