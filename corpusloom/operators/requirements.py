"""Requirements of specs, the tasks that serve them, and what is wrong between the two."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.saved import saved
from . import markdown


def requirements(bodies: DataFrame) -> DataFrame:
    """``path, number, ord, heading, text, times`` of ``path, content``: sections of any level whose heading starts with R and digits.

    A number that comes more than once has one row, of its first section; ``times`` tells how often it comes.
    """
    found = markdown.sections(bodies).withColumn("number", F.regexp_extract("heading", r"\AR([0-9]+)(?![0-9A-Za-z_])", 1).try_cast("int")).where("number is not null")
    first = found.groupBy("path", "number").agg(F.min(F.struct("ord", "heading", "body")).alias("s"), F.count("*").alias("times"))
    return first.select("path", "number", "s.ord", "s.heading", F.col("s.body").alias("text"), "times")


def _folder(path: str) -> Column:
    return F.regexp_replace(path, r"/[^/]*\z", "")


def _quoted(raw: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(raw, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def served(specs: DataFrame, tasks: DataFrame, width: int = 3) -> DataFrame:
    """``folder, spec, path, task, ref_spec, number, raw``: every reference of a task to a requirement, of tasks whose spec is there.

    ``specs``: ``folder, spec``.  Malformed references have only ``raw``; a task without any reference has one row of nulls.
    """
    ref = lambda good: lambda x: F.struct(F.when(F.lit(good), F.substring_index(x, ":R", 1)).alias("ref_spec"), F.when(F.lit(good), F.regexp_extract(x, r"([0-9]+)\z", 1)).try_cast("int").alias("number"), F.when(~F.lit(good), x).alias("raw"))
    each = tasks.where("number >= 1").select(_folder("path").alias("folder"), "path", F.format_string(f"TASK-%0{width}d", "number").alias("task"), F.explode_outer(F.concat(F.transform("serves", ref(True)), F.transform("bad_serves", ref(False)))).alias("x"))
    return each.join(specs.select("folder", "spec"), "folder").select("folder", "spec", "path", "task", "x.ref_spec", "x.number", "x.raw")


def _finding(rows: DataFrame, code: str, path: Column, *message: Column | str) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit("error").alias("severity"), path.alias("path"), F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message]).alias("message"))


def findings(specs: DataFrame, bodies: DataFrame, tasks: DataFrame, width: int = 3) -> DataFrame:
    """``code, severity, path, message``: requirements declared twice or served by no task; tasks that serve none, unknown ones or another spec's;
    and specs past draft of which any requirement or task is left so.

    ``specs``: ``folder, spec`` (its id), ``status``; ``bodies``: ``path, content`` of spec files without front matter; ``tasks``: as
    :func:`tasks.rows` gives them.  A spec without tasks has all its requirements unserved; a spec that can't be read has no row of ``bodies`` and no finding.
    Both sides meet in equi-joins on folder and number; requirements and references are written once.
    """
    known = saved(requirements(bodies).withColumn("folder", _folder("path")).join(specs.select("folder", "spec", "status"), "folder"), "requirements")
    readable = specs.join(bodies.select(_folder("path").alias("folder")).distinct(), "folder", "left_semi")
    refs = saved(served(readable, tasks, width), "served")
    at, ref = F.concat("path", F.lit("#"), F.col("task")), F.concat("ref_spec", F.lit(":R"), F.col("number").cast("string"))
    bare = refs.where("ref_spec is null and raw is null")
    own = refs.where("ref_spec = spec").join(known.select("folder", "number", F.lit(True).alias("known")), ["folder", "number"], "left")
    covered = own.where("known").select("folder", "number").distinct()
    open_ = known.join(covered, ["folder", "number"], "left_anti")
    name = F.concat(F.col("spec"), F.lit(": requirement R"), F.col("number").cast("string"))
    blocked = readable.where("status <> 'draft'").join(open_.select("folder").union(bare.select("folder")).distinct(), "folder", "left_semi")
    every = [
        _finding(known.where("times > 1"), "duplicate_requirement_id", F.col("path"), name, " is declared more than once"),
        _finding(bare, "task_without_requirement", at, F.col("task"), " has no Serves: reference"),
        _finding(refs.where("ref_spec <> spec"), "cross_spec_requirement_reference", at, F.col("task"), " (owned by ", F.col("spec"), ") references ", ref, " — coverage must reference the task's own Spec"),
        _finding(own.where("known is null"), "unknown_requirement_reference", at, F.col("task"), " references ", ref, ", which does not exist"),
        _finding(refs.where("raw is not null"), "unknown_requirement_reference", at, F.col("task"), " has a malformed Serves: reference ", _quoted(F.col("raw"))),
        _finding(open_, "uncovered_requirement", F.col("path"), name, " has no Task serving it"),
        _finding(blocked, "phase_gate_blocked", F.concat("folder", F.lit("/spec.md")), F.col("spec"), ' has status "', F.col("status"), '" but incomplete requirement coverage — not ready for implementation'),
    ]
    return reduce(DataFrame.unionByName, every)


#: What is said of a checked task by the state of its evidence.
EVIDENCE = {
    "unverified": ("unverified_task", " is checked complete but has no Evidence-Result: at all"),
    "failed": ("failed_task_evidence", ' is checked complete but its most recent Evidence-Result: is "fail"'),
    "stale": ("stale_task_evidence", " is checked complete but its recorded Evidence-Fingerprint no longer matches its own current content"),
}


def evidence_findings(tasks: DataFrame, width: int = 3) -> DataFrame:
    """``code, severity, path, message`` of checked tasks whose evidence isn't verified."""
    said = [F.when(F.col("state") == state, F.struct(F.lit(code).alias("code"), F.lit(text).alias("text"))) for state, (code, text) in EVIDENCE.items()]
    rows = tasks.where("checked and number >= 1").withColumn("x", F.coalesce(*said)).where("x is not null").withColumn("task", F.format_string(f"TASK-%0{width}d", "number"))
    return rows.select("x.code", F.lit("error").alias("severity"), F.concat("path", F.lit("#"), F.col("task")).alias("path"), F.concat("task", "x.text").alias("message"))


def requirement_texts(tasks: DataFrame, bodies: DataFrame) -> DataFrame:
    """``path, number, ref, text``: what each reference of a task says, by number alone; a number that comes twice says what its last section does."""
    found = markdown.sections(bodies).withColumn("n", F.regexp_extract("heading", r"\AR([0-9]+)(?![0-9A-Za-z_])", 1).try_cast("int")).where("n is not null")
    last = found.groupBy(_folder("path").alias("folder"), "n").agg(F.max_by("body", "ord").alias("text"))
    refs = tasks.select(_folder("path").alias("folder"), "path", "number", F.explode("serves").alias("ref")).withColumn("n", F.regexp_extract("ref", r"([0-9]+)\z", 1).cast("int"))
    return refs.join(last, ["folder", "n"]).select("path", "number", "ref", "text")
