"""Tasks in Markdown files: rows, their fields, and checks of what they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.saved import saved
from . import cycles, markdown


#: White space within a line, and a character that is neither that nor a line end, or nor a comma; patterns find whole lines and entries, so no line is looked at by itself.
_SPACE, _INK, _PART = r"[ \t\x0B\f\r]", r"[^ \t\x0B\f\r\n]", r"[^ \t\x0B\f\r\n,]"


def _values(body: Column, label: str) -> Column:
    """What follows ``label:`` on each line that starts with it."""
    return S.after_label(body, label, rf"{_SPACE}*({_INK}(?:[^\n]*{_INK})?)")


def _entries(body: Column, label: str) -> Column:
    """The parts of the comma lists of all ``label:`` lines, in order, without empty ones, as one text with commas between."""
    parts = F.regexp_extract_all(F.array_join(_values(body, label), ","), F.lit(rf"{_PART}(?:[^,]*{_PART})?"), F.lit(0))
    # the lambda keeps the projection out of whole-stage code, which would be one method too long to be compiled
    return F.array_join(F.transform(parts, lambda x: x), ",")


def _number(width: int) -> str:
    """Digits of an id as it is written: padded to ``width``, or longer and unpadded; what doesn't fit an int is no id."""
    longer = rf"|[1-9][0-9]{{{width},8}}" if width < 9 else ""
    return rf"(?:(?=0*[1-9])[0-9]{{{width}}}{longer})"


def rows(files: DataFrame, width: int = 3) -> DataFrame:
    """A row for each task section of ``path, content``.

    ``path, number, ord, checked, state, status, serves, bad_serves, depends_on, bad_depends_on, verify, scope``:
    a section is a task if its heading starts with ``TASK-`` and digits; the first checkbox counts; a task is
    complete if it is checked and its evidence is verified.  ``serves`` and ``depends_on`` have the
    well-formed references of all their lines (numbers padded to ``width`` digits, longer ones whole), the others are kept apart; "none" as a dependency is none.
    The last ``Verify:`` and ``Scope:`` lines count, absent ones are empty.  A file without tasks has no rows.
    """
    found = markdown.sections(files).withColumn("number", F.regexp_extract("heading", r"\ATASK-([0-9]+)\b", 1).try_cast("int")).where("number is not null")
    body = F.col("body")
    box = F.regexp_extract(body, r"(?m)^[\t ]*[-*] \[([ xX])\]", 1)
    last = lambda label: F.coalesce(F.try_element_at(_values(body, label), F.lit(-1)), F.lit(""))
    out = found.select("path", "number", "ord", F.lower(box).eqNullSafe("x").alias("checked"), S.evidence_state(body).alias("state"), _entries(body, "Serves").alias("s"), _entries(body, "Depends on").alias("d"), *[last(x).alias(x.lower()) for x in ("Verify", "Scope")])
    spec, task = rf"SPEC-{_number(width)}:R0*[1-9][0-9]*(?![^,])", rf"TASK-({_number(width)})(?![^,])"
    some = lambda c, pattern, group=0: F.regexp_extract_all(c, F.lit(rf"(?<![^,]){pattern}"), F.lit(group))
    return out.select(
        "path", "number", "ord", "checked", "state", F.when(F.col("checked") & (F.col("state") == "verified"), "complete").otherwise("pending").alias("status"),
        some("s", spec).alias("serves"), some("s", rf"(?!{spec})[^,]+").alias("bad_serves"),
        F.transform(some("d", task, 1), lambda x: x.cast("int")).alias("depends_on"), some("d", rf"(?!{task}|(?i:none)(?![^,]))[^,]+").alias("bad_depends_on"), "verify", "scope",
    )


def dangling(tasks: DataFrame) -> DataFrame:
    """``path, number, missing``: dependencies on tasks that the same file doesn't have."""
    wanted = tasks.select("path", "number", F.explode(F.array_distinct("depends_on")).alias("missing"))
    return wanted.join(tasks.select("path", F.col("number").alias("missing")).distinct(), ["path", "missing"], "left_anti").select("path", "number", "missing").distinct()


def readiness(tasks: DataFrame) -> DataFrame:
    """``path, number, blockers``: open tasks with the number of dependencies that aren't complete.

    An unknown dependency blocks; of tasks with the same number one that is complete is enough.  No blockers: ready.
    Tasks are written once, so that files are parsed once.
    """
    tasks = saved(tasks.select("path", "number", "status", "depends_on"), "tasks")
    open_ = tasks.where("status <> 'complete'").groupBy("path", "number").agg(F.array_distinct(F.flatten(F.collect_list("depends_on"))).alias("deps"))
    done = tasks.where("status = 'complete'").select("path", F.col("number").alias("dep")).distinct().withColumn("done", F.lit(True))
    each = open_.select("path", "number", F.explode_outer("deps").alias("dep")).join(done, ["path", "dep"], "left")
    return each.groupBy("path", "number").agg(F.count(F.when(F.col("dep").isNotNull() & F.col("done").isNull(), 1)).alias("blockers"))


def findings(tasks: DataFrame) -> DataFrame:
    """``code, path, message`` for duplicate numbers, malformed references and dependencies that are missing; tasks are written once."""
    tasks = saved(tasks.select("path", "number", "serves", "bad_serves", "depends_on", "bad_depends_on"), "tasks")
    one = F.format_string("TASK-%03d", F.col("number"))
    twice = tasks.groupBy("path", "number").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("code"), "path", F.concat(one, F.lit(" is declared "), F.col("n").cast("string"), F.lit(" times")).alias("message"))
    bad = tasks.select("path", "number", F.explode(F.concat("bad_serves", "bad_depends_on")).alias("ref")).select(F.lit("malformed_reference").alias("code"), "path", F.concat(one, F.lit(" refers to "), F.col("ref")).alias("message"))
    lost = dangling(tasks).select(F.lit("invalid_task_dependency").alias("code"), "path", F.concat(one, F.lit(" depends on TASK-"), F.format_string("%03d", F.col("missing"))).alias("message"))
    bare = tasks.where("size(serves) = 0 and size(bad_serves) = 0").select(F.lit("task_without_requirement").alias("code"), "path", F.concat(one, F.lit(" serves no requirement")).alias("message"))
    return twice.unionByName(bad).unionByName(lost).unionByName(bare)


def dependency_findings(tasks: DataFrame, width: int = 3) -> DataFrame:
    """``code, severity, path, message``: cycles of a file's tasks, and dependencies on tasks that it doesn't have.

    Each entry of a list counts by itself.  The file's folder names the spec; a finding stands at the task's own place in the file.
    Tasks are written once.
    """
    tasks = saved(tasks.select("path", "number", "depends_on"), "tasks")
    spec, one = F.element_at(F.split("path", "/"), -2), lambda c: F.format_string(f"TASK-%0{width}d", F.col(c))
    wanted = tasks.select("path", "number", F.explode("depends_on").alias("missing"))
    lost = wanted.join(tasks.select("path", F.col("number").alias("missing")).distinct(), ["path", "missing"], "left_anti")
    message = F.concat(spec, F.lit(":"), one("number"), F.lit(" depends on "), spec, F.lit(":"), one("missing"), F.lit(", which does not exist"))
    lost = lost.select(F.lit("invalid_task_dependency").alias("code"), F.lit("error").alias("severity"), F.concat("path", F.lit("#"), one("number")).alias("path"), message.alias("message"))
    return cycles.task_cycles(tasks, width).unionByName(lost)
