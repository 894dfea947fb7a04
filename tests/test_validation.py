"""Front matter and findings of hand-written files, one for each code."""

from corpusloom.operators import artifacts, validation

HEAD = "---\nid: {id}\ntype: {type}\nstatus: {status}\n{more}---\n"


def _file(path, id, type, status="draft", more="", body="# T\n"):
    return path, HEAD.format(id=id, type=type, status=status, more=more) + body


def test_metadata(spark):
    text = "---\r\n# note\nid: \"SPEC-001\"  # own\ntype: spec\nstatus: 'draft'\nparent: FEAT-002\ndepends_on: [SPEC-003, SPEC-004]\nsupersedes:\n  - SPEC-005\n- SPEC-006\n---\nbody\nmore"
    rows = [("a", text), ("b", "no front matter"), ("c", "---\nid: SPEC-001"), ("d", "---\ntype: spec\n---"), ("e", "---\nid: x\n---"), ("f", "---\nid: SPEC-001\nid: SPEC-001\n---"), ("g", None), ("h", ""), ("i", "---\n---\n"), ("j", "---\nodd\n---")]
    got = {r["path"]: r for r in artifacts.metadata(spark.createDataFrame(rows, "path string, content string")).collect()}
    a = got["a"]
    assert a["error"] is None and a["id"]["number"] == 1 and a["status"] == "draft" and a["parent"]["type"] == "feature"
    assert [x["number"] for x in a["depends_on"]] == [3, 4] and [x["number"] for x in a["supersedes"]] == [5, 6]
    assert a["body"] == "body\nmore" and a["body_line"] == 12
    bad = "frontmatter_malformed"
    assert {p: r["error"] for p, r in got.items()} == {"a": None, "b": bad, "c": bad, "d": "required_field_missing", "e": bad, "f": bad, "g": bad, "h": bad, "i": None, "j": bad}
    edges = artifacts.formal_edges(artifacts.metadata(spark.createDataFrame(rows[:1], "path string, content string"))).collect()
    assert [(r["ord"], r["relation"], r["target"]["number"]) for r in edges] == [(0, "parent", 2), (1, "depends_on", 3), (2, "depends_on", 4), (3, "supersedes", 5), (4, "supersedes", 6)]


def test_findings(spark):
    files = [
        _file("p/PRG-001/program.md", "PRG-001", "program", "active"),
        _file("f/FEAT-001/feature.md", "FEAT-001", "feature", more="parent: PRG-001\n", body="# A {#a}\n## B {#a}\n"),
        _file("f/FEAT-002/feature.md", "FEAT-003", "feature", "open", "parent: PRG-009\n"),
        _file("g/FEAT-002/feature.md", "FEAT-002", "feature"),
        _file("s/SPEC-001/spec.md", "SPEC-001", "spec", more="parent: PRG-001\ndepends_on: [SPEC-002, SPEC-009, FEAT-001]\n", body="[[FEAT-001#a]] [[FEAT-001#b]] [[FEAT-002]] [[SPEC-008]] [[what]] [[TASK-001]] `[[no]]`"),
        ("s/SPEC-002/spec.md", "nothing"), ("s/SPEC-003/spec.md", "---\ntype: spec\n---\n"), ("notes.md", "[[what]]"),
    ]
    got = sorted((r["code"], r["path"][2:10]) for r in validation.findings(spark.createDataFrame(files, "path string, content string")).collect())
    assert got == sorted([
        ("duplicate_anchor", "FEAT-001"), ("id_location_mismatch", "FEAT-002"), ("invalid_status", "FEAT-002"), ("missing_parent", "FEAT-002"), ("missing_parent", "FEAT-002"),
        ("invalid_parent_type", "SPEC-001"), ("unresolved_dependency", "SPEC-001"), ("unresolved_dependency", "SPEC-001"), ("unknown_anchor", "SPEC-001"), ("ambiguous_wikilink", "SPEC-001"),
        ("broken_wikilink", "SPEC-001"), ("invalid_wikilink", "SPEC-001"), ("frontmatter_malformed", "SPEC-002"), ("required_field_missing", "SPEC-003"),
    ])
