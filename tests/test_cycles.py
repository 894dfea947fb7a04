"""Cycles against a plain depth-first walk with three colours."""

import random

import pytest

from corpusloom.operators import artifacts, cycles


def by_hand(nodes, edges):
    targets, colour, stack, out = {}, {}, [], []
    for a, b in edges:
        targets.setdefault(a, []).append(b)

    def visit(n):
        colour[n] = 1
        stack.append(n)
        for x in sorted(targets.get(n, [])):
            if x not in colour:
                visit(x)
            elif colour[x] == 1:
                out.append((root, [*stack[stack.index(x) :], x]))
        stack.pop()
        colour[n] = 2

    for root in sorted(nodes):
        if root not in colour:
            visit(root)
    return out


def graphs():
    rng = random.Random(5)
    for k in range(60):
        n = rng.randint(1, 9)
        yield k, [(100 * k + rng.randrange(n), 100 * k + rng.randrange(n)) for _ in range(rng.randint(0, 16))]


def strong(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    for _ in nodes:
        for n in nodes:
            reach[n] = reach[n].union(*[reach[x] for x in reach[n]])
    return {n: min(x for x in nodes if x == n or x in reach[n] and n in reach[x]) for n in nodes if n in reach[n]}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(k, a, b) for k, es in graphs() for a, b in es] + [(99, None, 5), (99, 5, None)], "g long, src long, dst long")


def test_whole_parts_are_walked_in_order(edges):
    want = sorted((root, path) for _, es in graphs() for root, path in by_hand({a for a, _ in es}, es))
    got = cycles.cycles(edges.select("src", "dst")).collect()
    assert sorted((r["root"], r["path"]) for r in got) == want and len(want) > 50
    order = {}
    for _, es in graphs():
        for root, path in by_hand({a for a, _ in es}, es):
            order.setdefault(root, []).append(path)
    assert {root: [r["path"] for r in sorted(got, key=lambda r: r["n"]) if r["root"] == root] for root in order} == order
    per_group = cycles.cycles_in_groups(edges.where("src is not null and dst is not null"), "g").collect()
    assert sorted((r["root"], r["path"]) for r in per_group) == want
    assert cycles.cycles(edges.where("false").select("src", "dst")).count() == 0


def test_strong_parts_and_one_cycle_of_each(edges):
    every = [e for _, es in graphs() for e in es]
    want = strong(every)
    got = {r["node"]: r["root"] for r in cycles.strong_parts(edges.where("src is not null and dst is not null").select("src", "dst")).collect()}
    assert got == want
    paths = {r["root"]: r["path"] for r in cycles.cycles(edges.select("src", "dst"), part=0).collect()}
    assert set(paths) == set(want.values())
    for root, path in paths.items():
        best, level = None, [[root]]
        while best is None:
            level = [[*p, b] for p in level for a, b in set(every) if a == p[-1] and want.get(b) == root and (b == root or b not in p)]
            best = min((p for p in level if p[-1] == root), default=None)
        assert path == best


def test_long_chain_and_ring(spark):
    """A part of 3,000 nodes in a chain, closed at its end, is one part after few rounds."""
    ring = spark.range(3000).selectExpr("id as src", "(id + 1) % 3000 as dst")
    assert cycles.weak_parts(ring).select("part").distinct().count() == 1
    (row,) = cycles.cycles(ring).collect()
    assert row["path"] == [*range(3000), 0]


def test_spec_findings(spark):
    front = "---\nid: {0}\ntype: spec\nstatus: draft\ndepends_on: [{1}]\n{2}\n# S\n"
    specs = {"a/SPEC-002": ("SPEC-002", "SPEC-003"), "a/SPEC-003": ("SPEC-003", "SPEC-002, FEAT-003"), "b/SPEC-003": ("SPEC-003", "SPEC-003"), "a/SPEC-001": ("SPEC-001", "SPEC-003"), "a/SPEC-004": ("SPEC-004", "SPEC-004"), "a/SPEC-005": ("SPEC-005", "SPEC-999")}
    rows = [(f"{p}/spec.md", front.format(i, d, "---")) for p, (i, d) in specs.items()] + [("a/SPEC-006/spec.md", front.format("SPEC-006", "SPEC-006", ""))]
    files = spark.createDataFrame(rows, "path string, content string")
    got = cycles.spec_cycles(artifacts.metadata(files), artifacts.entities(files)).collect()
    # the walk comes from 1, so the cycle starts at 3
    assert sorted((r["path"], r["message"]) for r in got) == [("a/SPEC-003/spec.md", "dependency cycle: SPEC-003 -> SPEC-002 -> SPEC-003"), ("a/SPEC-004/spec.md", "dependency cycle: SPEC-004 -> SPEC-004")]
