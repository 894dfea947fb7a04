"""Markdown relations: fenced lines, sections, chunks, wikilinks and where they occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def fence_mask(lines: Column) -> Column:
    """For each line whether it is in a fence, its marks included: only the same mark closes one, and an
    unclosed one runs to the end.  A fold over the lines."""
    def step(s: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, r"\A[ \t]+", "")
        mark = F.when(bare.startswith("```"), "`").when(bare.startswith("~~~"), "~").otherwise("")
        shut = (s["open"] != "") & (mark == s["open"])
        after = F.when(shut, "").when(s["open"] != "", s["open"]).otherwise(mark)
        return F.struct(after.alias("open"), F.concat(s["mask"], F.array((s["open"] != "") | (mark != ""))).alias("mask"))

    start = F.struct(F.lit("").alias("open"), F.array().cast("array<boolean>").alias("mask"))
    return F.aggregate(lines, start, step, lambda s: s["mask"])


def lines(files: DataFrame) -> DataFrame:
    """``path, n (from 1), line, fenced`` for ``path, content``."""
    parts = files.select("path", F.split("content", "\n", -1).alias("ls"))
    rows = parts.select("path", F.posexplode(F.arrays_zip("ls", fence_mask(F.col("ls")).alias("fenced"))).alias("i", "x"))
    return rows.select("path", (F.col("i") + 1).alias("n"), F.col("x.ls").alias("line"), F.col("x.fenced").alias("fenced"))


#: A line end before a heading; of a text without fences every such line starts a section.
_BREAK = r"\n(?=#{1,6}(?:[\t\f ]|\r(?!\n|\z)))"


def _folded(content: Column) -> Column:
    """A text with fences cut before its headings, by a fold over its lines; what comes before the first is the first piece, without a line end of its own."""
    ls = F.split(content, "\n", -1)
    bare = lambda x: F.regexp_replace(x, r"\r\z", "")
    # lines and heads are bound to names: named inside a lambda, the mask would be folded again for each line
    each = F.arrays_zip(F.sequence(F.lit(1), F.size(ls)).alias("i"), ls.alias("line"), fence_mask(ls).alias("fenced"))
    heads = F.transform(F.filter(each, lambda x: ~x["fenced"] & bare(x["line"]).rlike(r"(?d)\A#{1,6}[\t\f\r ]+")), lambda x: x["i"])

    def cut(x: Column) -> Column:
        size, n = F.size(x["ls"]), F.size(x["heads"])
        end = lambda k: F.when(k < n, F.try_element_at(x["heads"], k + 1) - 1).otherwise(size)
        first = F.when(end(F.lit(0)) > 0, F.concat(F.lit("\n"), F.array_join(F.slice(x["ls"], 1, end(F.lit(0))), "\n"))).otherwise("")
        return F.concat(F.array(first), F.transform(x["heads"], lambda at, k: F.array_join(F.slice(x["ls"], at, end(k + 1) - at + 1), "\n")))

    return F.element_at(F.transform(F.array(F.struct(ls.alias("ls"), heads.alias("heads"))), cut), 1)


def sections(files: DataFrame) -> DataFrame:
    """``path, ord, level, heading, anchor, start_line, end_line, body``: a section for each heading outside
    fences, and one of level 0 for what comes first.  A file's sections are made in one row, so
    there is no shuffle.

    A text without a fence is cut by one pattern; only a text with one takes a fold over its lines.
    """
    n = lambda piece: F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit("")))
    fenced = F.col("content").rlike(r"(?:\A|\n)[ \t]*(?:```|~~~)")
    parts = files.select("path", F.when(fenced, _folded(F.col("content"))).otherwise(F.split(F.concat(F.lit("\n"), "content"), _BREAK, -1)).alias("pieces"))
    # lines before each piece, of use to line numbers alone: the first piece has a line end for each of its lines, any other one less
    before = F.transform(F.col("pieces"), lambda x, i: n(x) + F.when(i > 0, 1).otherwise(0))
    sums = F.aggregate(before, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    # outer: else pieces would be made once more by a filter that Spark puts before; a null text has one row without a number, which goes below
    rows = parts.select("path", sums.alias("sums"), F.posexplode_outer("pieces").alias("ord", "piece"))
    # patterns are kept to texts that need them: each is worth more than all else that is done for a section
    rows = rows.select("path", "sums", "ord", "piece", F.when(F.col("ord") > 0, F.substring_index("piece", "\n", 1)).otherwise("").alias("line"))
    # one line end that closes a body is not part of it
    body = F.expr("substring(piece, length(line) + 2, length(piece) - length(line) - if(endswith(piece, '\n'), 2, 1))")
    rows = rows.select("path", "sums", "ord", F.when(F.endswith("line", F.lit("\r")), F.regexp_replace("line", r"\r\z", "")).otherwise(F.col("line")).alias("raw"), body.alias("body")).where("ord > 0 or body <> ''")
    text = F.when(F.col("ord") > 0, F.regexp_extract("raw", r"(?d)\A(#{1,6})[\t\f\r ]+(.*)\z", 2)).otherwise("")
    rows = rows.select("path", "sums", "ord", "raw", text.alias("text"), "body")
    anchored = F.contains("text", F.lit("{#"))
    at = lambda k: F.get("sums", k)
    return rows.select(
        "path", "ord", F.when(F.col("ord") > 0, F.length(F.regexp_extract("raw", r"\A(#{1,6})", 1))).otherwise(0).alias("level"),
        F.when(anchored, F.regexp_replace("text", r"[\t ]*\{#[^}]*\}[\t ]*\z", "")).otherwise(F.col("text")).alias("heading"), F.when(anchored, F.nullif(F.regexp_extract("text", r"\{#([^}]*)\}[\t ]*\z", 1), F.lit(""))).alias("anchor"),
        F.when(F.col("ord") > 0, at(F.col("ord")) + 1).otherwise(1).alias("start_line"), at(F.col("ord") + 1).alias("end_line"), "body",
    )


def chunks(secs: DataFrame) -> DataFrame:
    return secs.where("body <> ''").withColumn("tokens", F.floor((F.length("body") + 3) / 4).cast("long"))


def wikilinks(files: DataFrame) -> DataFrame:
    """``path, line, ord, target, anchor, alias`` of ``[[target#anchor|alias]]`` outside fences and code spans."""
    rows = lines(files).where("not fenced and contains(line, '[[')")
    clear = F.regexp_replace("line", r"`[^`]*`", " ")
    rows = rows.select("path", F.col("n").alias("line"), F.posexplode(F.regexp_extract_all(clear, F.lit(r"\[\[(.*?)\]\]"), F.lit(1))).alias("ord", "raw"))
    whole = F.substring_index("raw", "|", 1)
    alias = F.when(F.contains(F.col("raw"), F.lit("|")), F.expr("substring(raw, instr(raw, '|') + 1)"))
    anchor = F.when(F.contains(whole, F.lit("#")), F.expr("substring(substring_index(raw, '|', 1), instr(substring_index(raw, '|', 1), '#') + 1)"))
    return rows.select("path", "line", "ord", F.trim(F.substring_index(whole, "#", 1)).alias("target"), F.trim(anchor).alias("anchor"), F.trim(alias).alias("alias"))


def occurrences(links: DataFrame, secs: DataFrame) -> DataFrame:
    """Each link with the section whose lines hold it: a range join within the file."""
    s = secs.select(F.col("path").alias("p"), "heading", "start_line", "end_line")
    on = (F.col("path") == F.col("p")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    return links.join(s, on, "left").select("path", "line", "ord", "target", F.coalesce("heading", F.lit("")).alias("section"))


def units(text: Column) -> Column:
    """A text cut after blank lines outside fences; those stay with the unit before, leading ones with the first.

    Joined, the units are the text; an empty or null text has none.  A fold over the lines finds the cuts, and units are joined from lines.
    """
    def step(s: Column, x: Column) -> Column:
        blank = ~x["fenced"] & (F.btrim(x["line"], F.lit(S.WHITE)) == "")
        cut = blank & s["filled"]
        return F.struct(F.when(cut, False).otherwise(s["filled"] | ~blank).alias("filled"), F.when(cut, F.concat(s["cuts"], F.array(x["i"]))).otherwise(s["cuts"]).alias("cuts"))

    ls = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    each = F.arrays_zip(F.sequence(F.lit(1), F.size(ls)).alias("i"), ls.alias("line"), fence_mask(ls).alias("fenced"))
    cuts = F.aggregate(each, F.struct(F.lit(False).alias("filled"), F.array().cast("array<int>").alias("cuts")), step, lambda s: s["cuts"])
    ends = F.array_distinct(F.concat(cuts, F.array(F.size(ls))))
    # lines and ends are bound to names here, so that they are worked out once
    def joined(x: Column) -> Column:
        first = lambda k: F.when(k == 0, F.lit(1)).otherwise(F.element_at(x["ends"], F.greatest(k, F.lit(1))) + 1)
        return F.transform(x["ends"], lambda end, k: F.concat(F.array_join(F.slice(x["ls"], first(k), end - first(k) + 1), "\n"), F.when(end < F.size(x["ls"]), "\n").otherwise("")))

    return F.filter(F.element_at(F.transform(F.array(F.struct(ls.alias("ls"), ends.alias("ends"))), joined), 1), lambda x: x != "")
