"""Requirements and coverage on small files, finding by finding."""

import pytest

from corpusloom.operators import requirements, tasks


@pytest.fixture(scope="module")
def made(spark):
    spec = "# S\n## R1 one\ntext\n### R2: two\nmore\n## R2 again\nlast\n## R10\n## Rx\n## R3y\n"
    body = '## TASK-001 a\n- [x] x\nServes: SPEC-001:R01, SPEC-002:R1\nServes:\tSPEC-001:R7, R"1\n## TASK-002 b\n- [X] y\nEvidence-Result: fail\n## TASK-000 none\n## TASK-003 c\n- [ ] z\nServes: SPEC-001:R2\nEvidence-Result: fail\n'
    bodies = spark.createDataFrame([("s/SPEC-001/spec.md", spec), ("s/SPEC-002/spec.md", "# S\n## R1\n"), ("s/SPEC-003/spec.md", "no requirement")], "path string, content string")
    rows = tasks.rows(spark.createDataFrame([("s/SPEC-001/tasks.md", body), ("s/SPEC-003/tasks.md", "# Tasks\n"), ("s/SPEC-009/tasks.md", body)], "path string, content string"))
    specs = spark.createDataFrame([("s/SPEC-001", "SPEC-001", "ready"), ("s/SPEC-002", "SPEC-002", "draft"), ("s/SPEC-003", "SPEC-003", "ready"), ("s/SPEC-004", "SPEC-004", "ready")], "folder string, spec string, status string")
    return specs, bodies, rows


def test_requirements(made):
    got = {(r["path"][2:10], r["number"]): (r["heading"], r["text"], r["times"]) for r in requirements.requirements(made[1]).collect()}
    assert got == {("SPEC-001", 1): ("R1 one", "text", 1), ("SPEC-001", 2): ("R2: two", "more", 2), ("SPEC-001", 10): ("R10", "", 1), ("SPEC-002", 1): ("R1", "", 1)}
    texts = {(r["number"], r["ref"]): r["text"] for r in requirements.requirement_texts(made[2], made[1]).collect()}
    assert texts == {(1, "SPEC-001:R01"): "text", (1, "SPEC-002:R1"): "text", (3, "SPEC-001:R2"): "last"}


def test_findings(made):
    specs, bodies, rows = made
    got = sorted((r["code"], r["path"], r["message"]) for r in requirements.findings(specs, bodies, rows).collect())
    at = "s/SPEC-001/tasks.md#TASK-00"
    assert got == sorted([
        ("duplicate_requirement_id", "s/SPEC-001/spec.md", "SPEC-001: requirement R2 is declared more than once"),
        ("cross_spec_requirement_reference", at + "1", "TASK-001 (owned by SPEC-001) references SPEC-002:R1 — coverage must reference the task's own Spec"),
        ("unknown_requirement_reference", at + "1", "TASK-001 references SPEC-001:R7, which does not exist"),
        ("unknown_requirement_reference", at + "1", 'TASK-001 has a malformed Serves: reference "R\\"1"'),
        ("task_without_requirement", at + "2", "TASK-002 has no Serves: reference"),
        ("uncovered_requirement", "s/SPEC-001/spec.md", "SPEC-001: requirement R10 has no Task serving it"),
        ("uncovered_requirement", "s/SPEC-002/spec.md", "SPEC-002: requirement R1 has no Task serving it"),
        ("phase_gate_blocked", "s/SPEC-001/spec.md", 'SPEC-001 has status "ready" but incomplete requirement coverage — not ready for implementation'),
    ])
    assert requirements.findings(specs.where("false"), bodies, rows).count() == 0


def test_evidence(made):
    got = sorted((r["code"], r["path"][:11], r["message"]) for r in requirements.evidence_findings(made[2]).where("path like '%001/%'").collect())
    assert got == [("failed_task_evidence", "s/SPEC-001/", 'TASK-002 is checked complete but its most recent Evidence-Result: is "fail"'), ("unverified_task", "s/SPEC-001/", "TASK-001 is checked complete but has no Evidence-Result: at all")]


def test_numbers_longer_than_the_width(spark):
    body = "## TASK-1000 a\n- [ ] x\nServes: SPEC-1000:R1, SPEC-0100:R1, SPEC-99999999999:R1\nDepends on: TASK-1001, TASK-0100, TASK-99999999999\n"
    rows = tasks.rows(spark.createDataFrame([("s/SPEC-1000/tasks.md", body)], "path string, content string"))
    (got,) = rows.collect()
    assert got.serves == ["SPEC-1000:R1"] and got.bad_serves == ["SPEC-0100:R1", "SPEC-99999999999:R1"]
    assert got.depends_on == [1001] and got.bad_depends_on == ["TASK-0100", "TASK-99999999999"]
    specs = spark.createDataFrame([("s/SPEC-1000", "SPEC-1000", "ready")], "folder string, spec string, status string")
    bodies = spark.createDataFrame([("s/SPEC-1000/spec.md", "## R1\nmust\n")], "path string, content string")
    codes = {r.code for r in requirements.findings(specs, bodies, rows).collect()}
    assert codes == {"unknown_requirement_reference"}
