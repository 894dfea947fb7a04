"""Cycles of directed graphs: of files that depend on one another, and of tasks within a file.

The order in which a depth-first walk meets nodes decides which path is reported for a cycle.  So each weakly connected
part of a graph, which no edge leaves, is walked as a whole in one task, many small parts together; parts beyond a bound are
taken apart into strongly connected ones by joins, and each gives one cycle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.saved import forget, saved

#: Edges of a part of a graph that is walked as a whole.
PART = 1_000_000


def _mark(table: DataFrame, *cols: str) -> tuple:
    row = table.agg(F.count("*"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))).first()
    return row[0], row[1]


def weak_parts(edges: DataFrame) -> DataFrame:
    """``node, part`` for ``src, dst``: the least node that edges connect with it, in either direction.

    Each round takes the least part of a node's neighbours and then the part's own part, so that long chains close by doubling.
    """
    edges = saved(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    both = edges.union(edges.select("dst", "src"))
    now = saved(both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("part")), "parts")
    mark = _mark(now, "node", "part")
    while True:
        near = both.join(now.select(F.col("node").alias("dst"), "part"), "dst").groupBy("src").agg(F.min("part").alias("near"))
        step = now.join(near.withColumnRenamed("src", "node"), "node").select("node", F.least("part", "near").alias("part"))
        jump = step.join(step.select(F.col("node").alias("part"), F.col("part").alias("next")), "part", "left")
        after = saved(jump.select("node", F.coalesce("next", "part").alias("part")), "parts")
        forget(now)
        now, before, mark = after, mark, _mark(after, "node", "part")
        if mark == before:
            forget(edges)
            return now


def strong_parts(edges: DataFrame) -> DataFrame:
    """``node, root`` for ``src, dst``: every node that lies on a cycle, with the least node of its strongly connected part.

    Nodes without an edge in or out are trimmed while that takes away a tenth of the edges.  Then every node gets the least node that reaches it, and what
    reaches that one within the same colour is its part; edges between colours and those of parts found drop out.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    left, found = saved(edges.where("src <> dst").select("src", "dst").distinct(), "edges"), None
    while True:
        n = left.count()
        while n:
            trimmed = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            trimmed = saved(trimmed.select("src", "dst"), "edges")
            forget(left)
            left, before, n = trimmed, n, trimmed.count()
            if n > 0.9 * before:
                break
        if not n:
            break
        colour = saved(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().select("node", F.col("node").alias("c")), "colours")
        mark = None
        while mark != (mark := _mark(colour, "node", "c")):
            met = left.join(colour.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "c")
            after = saved(colour.union(met).groupBy("node").agg(F.min("c").alias("c")), "colours")
            forget(colour)
            colour = after
        inner = left.join(colour.select(F.col("node").alias("src"), "c"), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("d")), "dst").where("c = d")
        inner = saved(inner.select("src", "dst", "c"), "inner")
        reach = front = saved(colour.where("node = c"), "reach")
        while not front.isEmpty():
            front = saved(front.join(inner.select(F.col("dst").alias("node"), "src", "c"), ["node", "c"]).select(F.col("src").alias("node"), "c").distinct().join(reach.select("node"), "node", "left_anti").select("node", "c"), "front")
            reach = reach.union(front)
        reach = saved(reach, "reach")
        many = reach.groupBy("c").count().where("count > 1").select("c")
        part = saved(reach.join(many, "c").select("node", F.col("c").alias("root")), "strong")
        found = part if found is None else found.union(part)
        rest = inner.join(reach.select(F.col("node").alias("src")), "src", "left_anti").join(reach.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
        rest = saved(rest, "edges")
        forget(left, colour, inner)
        left = rest
    alone = loops if found is None else loops.join(found.select("node"), "node", "left_anti")
    alone = alone.select("node", F.col("node").alias("root"))
    return alone if found is None else found.union(alone)


def walk(nodes: list, targets: dict) -> Iterator[tuple]:
    """``root, path`` of each edge that closes a cycle in a depth-first walk over nodes and targets in order.

    A path starts and ends with the node that is met again; an edge that comes twice counts twice.
    """
    done, on, stack = set(), {}, []
    for root in sorted(set(nodes)):
        if root in done:
            continue
        stack.append((root, iter(sorted(targets.get(root, ())))))
        on[root] = 0
        while stack:
            node, rest = stack[-1]
            for x in rest:
                if x in on:
                    yield root, [n for n, _ in stack[on[x] :]] + [x]
                elif x not in done:
                    on[x] = len(stack)
                    stack.append((x, iter(sorted(targets.get(x, ())))))
                    break
            else:
                stack.pop()
                del on[node]
                done.add(node)


def cycles_in_groups(edges: DataFrame, group: str) -> DataFrame:
    """``group, root, n, path`` for ``group, src, dst``: the cycles of each group by itself, as :func:`walk` meets them.

    ``root`` is the node from which the walk came, ``n`` numbers its cycles from 0.  A group's edges are one row of a task.
    """
    kind, node = edges.schema[group].dataType.simpleString(), edges.schema["src"].dataType.simpleString()
    lists = edges.groupBy(F.col(group).alias("key")).agg(F.collect_list("src").alias("src"), F.collect_list("dst").alias("dst"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(key, *x) for key, src, dst in zip(b["key"], b["src"], b["dst"], strict=True) for x in _found(src.tolist(), dst.tolist())]
            yield pd.DataFrame(rows, columns=["key", "root", "n", "path"])

    return lists.mapInPandas(run, f"key {kind}, root {node}, n int, path array<{node}>").withColumnRenamed("key", group)


def _found(src: list, dst: list) -> list[tuple]:
    targets: dict = {}
    for a, b in zip(src, dst, strict=True):
        targets.setdefault(a, []).append(b)
    out, last, n = [], None, 0
    for root, path in walk(list(targets), targets):
        n, last = (n + 1 if root == last else 0), root
        out.append((root, n, path))
    return out


def one_cycle_each(edges: DataFrame, strong: DataFrame) -> DataFrame:
    """``root, n, path``: for each strongly connected part the shortest cycle through its least node, of several the least path.

    All parts are walked at once, a level a round; a node keeps the least path by which it is first met.
    """
    inner = edges.select("src", "dst").distinct().join(strong.select(F.col("node").alias("src"), "root"), "src").join(strong.select(F.col("node").alias("dst"), F.col("root").alias("r")), "dst").where("root = r")
    inner = saved(inner.select("src", "dst", "root"), "inner")
    seen = front = saved(strong.where("node = root").select("node", "root", F.array("root").alias("path")), "front")
    out = None
    while not front.isEmpty():
        met = front.join(inner.withColumnRenamed("src", "node"), ["node", "root"]).select(F.col("dst").alias("node"), "root", F.concat("path", F.array("dst")).alias("path"))
        met = saved(met.groupBy("node", "root").agg(F.min("path").alias("path")), "met")
        closed = met.where("node = root").select("root", F.lit(0).alias("n"), "path")
        out = closed if out is None else out.union(closed)
        front = saved(met.join(out.select("root"), "root", "left_anti").join(seen.select("node"), "node", "left_anti").select("node", "root", "path"), "front")
        seen = seen.union(front)
    return out if out is not None else strong.select("root", F.lit(0).alias("n"), F.array("root").alias("path")).limit(0)


def cycles(edges: DataFrame, part: int = PART) -> DataFrame:
    """``root, n, path`` of all cycles that a depth-first walk of ``src, dst`` closes, nodes and targets in order.

    ``path`` starts and ends with the same node (a node that depends on itself: twice that node); ``root`` is where the walk started and ``n``
    numbers its cycles, so ``root, n`` is the order of the walk.  Repeated edges are repeated cycles; null ends are no edge; nodes of any orderable type.
    Parts of the graph with more than ``part`` edges give one cycle for each strongly connected part instead: the shortest through its
    least node.
    """
    edges = saved(edges.where("src is not null and dst is not null").select("src", "dst"), "edges")
    own = edges.join(weak_parts(edges).withColumnRenamed("node", "src"), "src", "left").select("src", "dst", F.coalesce("part", "src").alias("part"))
    own = saved(own, "edges")
    sizes = own.groupBy("part").count()
    large = saved(sizes.where(F.col("count") > part).select("part"), "large")
    small = cycles_in_groups(own.join(large, "part", "left_anti"), "part").select("root", "n", "path")
    if large.isEmpty():
        return small
    rest = saved(own.join(large, "part", "left_semi").select("src", "dst"), "edges")
    return small.union(one_cycle_each(rest, saved(strong_parts(rest), "strong")).select("root", "n", "path"))


def _ids(path: Column, prefix: str, before: Column | str = "", width: int = 3) -> Column:
    """Numbers as ids, joined by arrows."""
    lead = F.lit(before) if isinstance(before, str) else before
    return F.array_join(F.transform(path, lambda n: F.concat(lead, F.format_string(f"{prefix}-%0{width}d", n.cast("long")))), " -> ")


def spec_cycles(meta: DataFrame, known: DataFrame, width: int = 3, part: int = PART) -> DataFrame:
    """``code, severity, path, message``: dependency_cycle findings over front matter as :func:`artifacts.metadata` gives it.

    ``known`` is as :func:`artifacts.entities` gives it.  Of a spec that lies in several places the first counts; a file that can't be
    read has no dependencies; those that aren't specs don't count.  A finding stands at the first spec of its path.
    """
    specs = known.where("kind = 'spec'").groupBy("number").agg(F.min("path").alias("path"))
    specs = saved(specs.select(F.col("number").cast("long").alias("number"), "path"), "specs")
    deps = meta.where("error is null").select("path", F.explode("depends_on").alias("d")).where("d.type = 'spec'")
    edges = specs.join(deps, "path").select(F.col("number").alias("src"), F.col("d.number").cast("long").alias("dst"))
    found = cycles(edges, part).withColumn("number", F.element_at("path", 1)).withColumnRenamed("path", "nodes")
    return found.join(specs, "number").select(F.lit("dependency_cycle").alias("code"), F.lit("error").alias("severity"), "path", F.concat(F.lit("dependency cycle: "), _ids(F.col("nodes"), "SPEC", width=width)).alias("message"))


def task_cycles(tasks: DataFrame, width: int = 3) -> DataFrame:
    """``code, severity, path, message``: task_dependency_cycle findings over tasks as :func:`tasks.rows` gives them.

    The file's folder names the spec.  Dependencies on tasks that the file doesn't have can't close a cycle.
    """
    edges = tasks.select("path", F.col("number").cast("long").alias("src"), F.explode("depends_on").alias("d")).select("path", "src", F.col("d").cast("long").alias("dst"))
    found = cycles_in_groups(edges.withColumnRenamed("path", "file"), "file").withColumnRenamed("path", "nodes")
    spec = F.element_at(F.split("file", "/"), -2)
    at = F.concat("file", F.lit("#"), F.format_string(f"TASK-%0{width}d", F.element_at("nodes", 1)))
    return found.select(F.lit("task_dependency_cycle").alias("code"), F.lit("error").alias("severity"), at.alias("path"), F.concat(F.lit("task dependency cycle: "), _ids(F.col("nodes"), "TASK", F.concat(spec, F.lit(":")), width)).alias("message"))

