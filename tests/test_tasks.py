"""Task rows of hand-written files: references of every shape, empty and null contents."""

from corpusloom.operators import tasks

BODY = """# Tasks
## TASK-001 first
- [x] done
Serves: SPEC-001:R2, , R3, SPEC-0001:R1
Serves: SPEC-002:R10
Depends on: None
Verify: once
Verify: twice
## TASK-002 second
* [ ] open
Depends on: TASK-001, TASK-7, SPEC-001:TASK-001, TASK-009
```
## TASK-003 in a fence
```
## Notes
"""


def test_rows(spark):
    files = spark.createDataFrame([("a", BODY), ("b", ""), ("c", None)], "path string, content string")
    found = tasks.rows(files)
    got = {r["number"]: r for r in found.collect()}
    assert sorted(got) == [1, 2]
    assert got[1]["serves"] == ["SPEC-001:R2", "SPEC-002:R10"] and got[1]["bad_serves"] == ["R3", "SPEC-0001:R1"]
    assert got[1]["depends_on"] == [] and got[1]["verify"] == "twice" and got[1]["checked"] and got[1]["status"] == "pending"
    assert got[2]["depends_on"] == [1, 9] and got[2]["bad_depends_on"] == ["TASK-7", "SPEC-001:TASK-001"] and not got[2]["checked"]
    assert [tuple(r) for r in tasks.dangling(found).collect()] == [("a", 2, 9)]
    assert {r["number"]: r["blockers"] for r in tasks.readiness(found).collect()} == {1: 0, 2: 2}


def test_affected_walks_long_chains(spark):
    from corpusloom.operators import graph

    edges = spark.createDataFrame([(i + 1, i) for i in range(53)], "src int, dst int").coalesce(1)
    got = graph.affected(edges, spark.createDataFrame([(0,)], "id int")).collect()
    assert sorted((r["id"], r["hops"]) for r in got) == [(i, i) for i in range(1, 54)]


def test_files_are_parsed_once(spark, capsys):
    files = spark.createDataFrame([("s/SPEC-001/tasks.md", "## TASK-001 a\nServes: SPEC-001:R1\nDepends on: TASK-002\n")], "path string, content string")
    for f in (tasks.findings, tasks.readiness, tasks.dependency_findings):
        capsys.readouterr()
        f(tasks.rows(files)).explain()
        plan = capsys.readouterr().out
        assert "content" not in plan and "FileScan parquet" in plan


def test_fields_at_line_ends_and_with_odd_white_space(spark):
    text = "## TASK-001 a\r\n\x0bServes: SPEC-001:R1 ,, \x0b\r\nVerify: \nVerify:go\x0b\n  Depends on: NONE, TASK-002\r\nEvidence-Result: fail\nEvidence-Result:\tpass \nEvidence-Fingerprint: sha256:0"
    (got,) = tasks.rows(spark.createDataFrame([("p", text), ("q", None)], "path string, content string")).collect()
    assert (got.serves, got.bad_serves, got.verify, got.depends_on, got.bad_depends_on, got.state) == (["SPEC-001:R1"], [], "go", [2], [], "stale")
