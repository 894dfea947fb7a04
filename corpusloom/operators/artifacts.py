"""Front matter of artifact files: typed fields, the body and where it starts, formal references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Types whose front matter must have an id, and the id fields that hold lists.
WITH_ID = ["program", "feature", "spec", "knowledge", "learning"]
LISTS = ["depends_on", "supersedes"]


def _plain(value: Column) -> Column:
    """A scalar without comment, white space and quotes."""
    bare = S.stripped(F.regexp_replace(value, r"(\A|\s)#.*\z", ""))
    return F.regexp_replace(bare, r"""\A(["'])(.*)\1\z""", "$2")


def _field(block: Column, name: str) -> Column:
    rows = F.filter(block, lambda x: x.rlike(rf"\A{name}:(\s|\z)"))
    return F.coalesce(_plain(F.regexp_extract(F.try_element_at(rows, F.lit(1)), rf"\A{name}:(.*)\z", 1)), F.lit(""))


def _list(block: Column, name: str) -> Column:
    """``[a, b]`` on the field's own line, or ``- a`` on the lines below it."""
    own = _field(block, name)
    below = F.regexp_extract(F.array_join(block, "\n"), rf"(?:\A|\n){name}:[ \t]*(?:#[^\n]*)?((?:\n[ \t]*-[ \t][^\n]*)+)", 1)
    flow = F.split(F.regexp_replace(own, r"\A\[|\]\z", ""), ",", -1)
    rows = F.transform(F.split(below, "\n", -1), lambda x: F.regexp_replace(x, r"\A[ \t]*-[ \t]+", ""))
    return F.filter(F.transform(F.when(own.startswith("["), flow).otherwise(rows), _plain), lambda x: x != "")


def metadata(files: DataFrame) -> DataFrame:
    """``path, error, id, type, status, parent, for, depends_on, supersedes, body, body_line`` for ``path, content``.

    ``error`` is null, ``frontmatter_malformed`` or ``required_field_missing``; the ids are structs as
    :func:`scalars.parse_id` gives them, null where a field is absent.  Front matter is what stands between a first
    line ``---`` and the next one: fields of one line, quoted or not, and lists of either form.  Anything else
    between them, a field given twice and an id that isn't one are malformed.  Without front matter ``body`` is null.
    """
    ls = F.transform(F.split("content", "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", ""))
    parts = files.select("path", ls.alias("ls"), F.split("content", "\n", -1).alias("raw"))
    end = F.array_position(F.slice("ls", 2, F.greatest(F.size("ls"), F.lit(1))), "---").cast("int")
    parts = parts.withColumn("end", F.when((F.get("ls", F.lit(0)) == "---") & (end > 0), end))
    block = F.filter(F.slice("ls", 2, F.col("end") - 1), lambda x: ~x.rlike(r"\A\s*(#.*)?\z"))
    body = F.array_join(F.slice("raw", F.col("end") + 2, F.size("raw")), "\n")
    parts = parts.select("path", "end", block.alias("block"), body.alias("body"))
    names = F.filter(F.transform("block", lambda x: F.regexp_extract(x, r"\A([A-Za-z_][\w-]*):(?:\s|\z)", 1)), lambda x: x != "")
    odd = F.exists("block", lambda x: ~x.rlike(r"\A([A-Za-z_][\w-]*:(\s.*)?|\s*-\s.*)\z")) | (F.size(F.array_distinct(names)) < F.size(names))
    fields = {n: _field(F.col("block"), n) for n in ("id", "type", "status", "parent", "for")} | {n: _list(F.col("block"), n) for n in LISTS}
    out = parts.select("path", "end", "body", odd.alias("odd"), *[c.alias(n) for n, c in fields.items()])
    bad = F.lit(False)
    for n in ("id", "parent", "for"):
        bad = bad | ((F.col(n) != "") & S.parse_id(F.col(n)).isNull())
    for n in LISTS:
        bad = bad | F.exists(n, lambda x: S.parse_id(x).isNull())
    error = F.when(F.col("end").isNull() | F.col("odd") | bad, "frontmatter_malformed").when((F.col("id") == "") & F.col("type").isin(WITH_ID), "required_field_missing")
    typed = [S.parse_id(F.col(n)).alias(n) for n in ("id", "parent", "for")] + [F.transform(n, S.parse_id).alias(n) for n in LISTS]
    return out.select("path", error.alias("error"), "type", "status", *typed, "body", (F.col("end") + 2).alias("body_line")).select("path", "error", "id", "type", "status", "parent", "for", *LISTS, "body", "body_line")


def entities(files: DataFrame) -> DataFrame:
    """``path, kind, number``: the entity whose own file a path is, by its place alone; other files have no row."""
    folder, single = r"(?:\A|/)(PRG|FEAT|SPEC)-([0-9]+)/(program|feature|spec)\.md\z", r"(?:\A|/)(KNOW|LRN)-([0-9]+)[^/]*\.md\z"
    prefix, number = (F.coalesce(F.nullif(F.regexp_extract("path", folder, i), F.lit("")), F.regexp_extract("path", single, i)) for i in (1, 2))
    kinds = F.create_map(*[F.lit(x) for kv in S.PREFIXES.items() for x in kv])
    name, kind = F.regexp_extract("path", folder, 3), F.try_element_at(kinds, prefix)
    return files.select("path", kind.alias("kind"), number.try_cast("int").alias("number"), name.alias("n")).where("kind is not null and number >= 1 and (n = '' or n = kind)").drop("n")


def formal_edges(meta: DataFrame) -> DataFrame:
    """``path, ord, relation, target``: the parent, then ``depends_on``, then ``supersedes``, in the order given."""
    edge = lambda relation: lambda x: F.struct(F.lit(relation).alias("relation"), x.alias("target"))
    parent = F.when(F.col("parent").isNotNull(), F.array(edge("parent")(F.col("parent")))).otherwise(F.array())
    every = F.concat(parent, *[F.transform(n, edge(n)) for n in LISTS])
    return meta.where("error is null").select("path", F.posexplode(every).alias("ord", "x")).select("path", "ord", "x.relation", "x.target")
