"""Findings on artifact files: front matter, place, status, parents, dependencies, wikilinks and anchors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import artifacts, markdown

#: Statuses a type may have, and the type its parent must have.
STATUSES = {
    "program": ["draft", "active", "done", "cancelled"],
    "feature": ["draft", "active", "done", "cancelled"],
    "spec": ["draft", "ready", "in_progress", "validated", "blocked", "superseded", "cancelled"],
    "learning": ["candidate", "promoted", "dismissed"],
    "knowledge": ["active"],
}
PARENTS = {"feature": "program", "spec": "feature"}


def _text(entity: Column) -> Column:
    """An id as it was written."""
    return F.concat(entity["prefix"], F.lit("-"), F.lpad(entity["number"].cast("string"), F.greatest(entity["width"], F.length(entity["number"].cast("string"))), "0"))


def _finding(when: Column, code: str, *message: Column | str) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message]).alias("message")))


def _reported(rows: DataFrame, each: list[Column]) -> DataFrame:
    return rows.select("path", F.explode(F.array_compact(F.array(*each))).alias("x")).select("x.code", F.lit("error").alias("severity"), "path", "x.message")


def findings(files: DataFrame, width: int = 3) -> DataFrame:
    """``code, severity, path, message`` over all entity files of ``path, content``.

    A file whose front matter can't be read has that one finding.  Whether a target exists goes by the places of
    files, not by what they declare.  Parents, dependencies and links are looked up by equi-joins on type and
    number; a task as a link's target isn't judged, nor are files that are no entity's.
    """
    known = artifacts.entities(files)
    meta = artifacts.metadata(files).join(known, "path")
    numbers = known.groupBy(F.col("kind").alias("t_kind"), F.col("number").alias("t_number")).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    good = meta.where("error is null")
    table = lambda d: F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in d.items() for x in kv])
    at = lambda e: (F.col(f"{e}.type") == F.col("t_kind")) & (F.col(f"{e}.number") == F.col("t_number"))
    parent, want = F.col("parent"), F.try_element_at(table(PARENTS), F.col("kind"))

    # what a file shows by itself
    sound, allowed = F.col("error").isNull(), F.try_element_at(table(STATUSES), F.col("kind"))
    place = F.concat(F.try_element_at(table({v: k for k, v in S.PREFIXES.items()}), F.col("kind")), F.lit("-"), F.lpad(F.col("number").cast("string"), F.greatest(F.lit(width), F.length(F.col("number").cast("string"))), "0"))
    fits = F.coalesce(_text(F.col("id")) == place, F.lit(False))
    own = [
        _finding(F.col("error") == "required_field_missing", "required_field_missing", 'field "id" is required for type "', F.col("type"), '"'),
        _finding(F.col("error") == "frontmatter_malformed", "frontmatter_malformed", "front matter can't be read"),
        _finding(sound & ~fits, "id_location_mismatch", "declared id ", F.coalesce(_text(F.col("id")), F.lit("<nil>")), " does not match canonical location ", place),
        _finding(sound & ~F.array_contains(allowed, F.col("status")), "invalid_status", 'status "', F.col("status"), '" is not one of the allowed states for ', F.col("kind"), ": [", F.array_join(allowed, " "), "]"),
        _finding(sound & want.isNotNull() & parent.isNull(), "missing_parent", "no parent declared; a ", want, " parent is required"),
        _finding(sound & (parent["type"] != want), "invalid_parent_type", "parent ", _text(parent), " is a ", parent["type"], ", want a ", want),
    ]
    # what it refers to
    edges = artifacts.formal_edges(good.withColumn("want", want)).join(known.select("path", "kind"), "path")
    wanted = F.when(F.col("relation") == "parent", want).when(F.col("kind") == "spec", "spec")
    lost = edges.where(wanted.isNotNull()).join(numbers, at("target"), "left").withColumn("wanted", wanted)
    wrong, none, up = F.col("target.type") != F.col("wanted"), F.col("paths").isNull(), F.col("relation") == "parent"
    refers = [
        _finding(up & ~wrong & none, "missing_parent", "declared parent ", _text(F.col("target")), " does not exist"),
        _finding(~up & (wrong | none), "unresolved_dependency", F.col("relation"), " entry ", _text(F.col("target")), " does not resolve to an existing Spec"),
    ]
    bodies = good.select("path", F.col("body").alias("content"))
    links = markdown.wikilinks(bodies).withColumn("e", S.parse_id(F.col("target"))).where("e is null or e.type <> 'task'")
    anchors = markdown.sections(bodies).where("anchor <> ''").groupBy("path", "anchor").count()
    declared = anchors.select(F.col("path").alias("to"), "anchor", F.lit(True).alias("declared"))
    met = links.join(numbers, at("e"), "left").withColumn("to", F.when(F.size("paths") == 1, F.get("paths", F.lit(0)))).join(declared, ["to", "anchor"], "left")
    known_id, e = F.col("e").isNotNull(), _text(F.col("e"))
    linked = [
        _finding(~known_id, "invalid_wikilink", 'wikilink target "', F.col("target"), '" is not a well-formed entity ID'),
        _finding(known_id & F.col("paths").isNull(), "broken_wikilink", "wikilink target ", e, " does not exist"),
        _finding(F.size("paths") > 1, "ambiguous_wikilink", "wikilink target ", e, " resolves to ", F.size("paths").cast("string"), " artifacts: [", F.array_join("paths", " "), "]"),
        _finding((F.size("paths") == 1) & (F.col("anchor") != "") & F.col("declared").isNull(), "unknown_anchor", "wikilink target ", e, ' exists but declares no anchor "', F.col("anchor"), '"'),
    ]
    twice = [_finding(F.col("count") > 1, "duplicate_anchor", 'anchor "', F.col("anchor"), '" is declared by more than one Section')]
    return reduce(DataFrame.unionByName, [_reported(meta, own), _reported(lost, refers), _reported(met, linked), _reported(anchors, twice)])
