"""Impact against a plain queue over references, on small random graphs."""

import random

from corpusloom.operators import impact, tasks


def queue_walk(changed, refs):
    """refs: (source, target, relation, path, ord), in the order of sources; formal ones of a target come first."""
    back = {}
    for semantic in (False, True):
        for s, t, rel, path, ord_ in sorted(refs, key=lambda r: (r[0], r[3], r[4])):
            if (rel == "wikilink") == semantic:
                back.setdefault(t, []).append((rel, t, s, path))
    queue, done, out = [(c, []) for c in changed], set(), {}
    while queue:
        at, path = queue.pop(0)
        if at in done:
            continue
        done.add(at)
        for hop in back.get(at, []):
            if hop[2] not in changed:
                out.setdefault(hop[2], []).append([*path, hop])
                queue.append((hop[2], [*path, hop]))
    return out


def test_every_path_in_the_order_of_a_queue(spark):
    rng = random.Random(8)
    refs, changed = [], []
    for g in range(25):
        n, base = rng.randint(2, 8), 10 * g
        for _ in range(rng.randint(1, 18)):
            a, b = base + rng.randrange(n), base + rng.randrange(n)
            refs.append((a, b, rng.choice(["parent", "depends_on", "wikilink", "wikilink"]), f"f{a}.md", len(refs)))
        changed += rng.sample(range(base, base + n), rng.randint(1, 2))
    rng.shuffle(changed)
    want = queue_walk(changed, refs)
    name = "S{:03d}".format
    rows = [(name(s), name(t), rel, path, s, o, "sec", o) for s, t, rel, path, o in refs]
    df = spark.createDataFrame(rows, "source_id string, target_id string, relation string, source_path string, source_rank int, ord int, source_section string, source_line int")
    elements = spark.createDataFrame([(name(c), i) for i, c in enumerate(changed)] + [(name(changed[0]), 999), (None, 1)], "id string, ord int")
    out = impact.items(impact.propagate(elements, impact.backward_hops(df)), "a", "b").collect()
    got = {r["id"]: [[(h["relation"], h["from_id"], h["to_id"], h["source_path"]) for h in p] for p in r["paths"]] for r in out}
    assert got == {name(i): [[(rel, name(f), name(t), path) for rel, f, t, path in p] for p in paths] for i, paths in want.items()}
    for r in out:
        last = r["paths"][0][-1]
        sure = last["relation"] != "wikilink"
        assert (r["classification"], r["severity"], r["severity_rank"], r["n_paths"]) == (("deterministic_invalidation", "high", 0) if sure else ("suggested_review", "low", 2)) + (len(r["paths"]),)
        assert r["path"] == last["source_path"] and r["reverify"] is None and r["reason"].endswith("changed between a and b")


def test_requirements_tasks_and_what_has_no_relation(spark):
    body = "## TASK-001 a\n- [x] x\nServes: SPEC-001:R2, SPEC-001:R3\nEvidence-Result: fail\n## TASK-002 b\n- [ ] y\n\tServes:\tSPEC-001:R2, SPEC-001:R2\r\n## TASK-003 c\nServes: SPEC-002:R2\n"
    rows = tasks.rows(spark.createDataFrame([("s/SPEC-001/tasks.md", body)], "path string, content string"))
    changed = spark.createDataFrame([("SPEC-001", 2, "s/SPEC-001", 0), ("SPEC-001", 9, "s/SPEC-001", 1), ("SPEC-002", 2, "s/SPEC-002", 2), ("KNOW-001", None, "", 3), ("KNOW-002", None, "", 4)], "id string, requirement int, spec_dir string, ord int")
    refs = spark.createDataFrame([("KNOW-002", "KNOW-001", "wikilink", "k/2.md", 1)], "source_id string, target_id string, relation string, source_path string, source_rank int")
    out = {r["id"]: r for r in impact.analyze(changed, refs, rows, "v1", "v2").collect()}
    assert set(out) == {"SPEC-001:TASK-001", "SPEC-001:TASK-002", "SPEC-002", "KNOW-002"}
    first, second = out["SPEC-001:TASK-001"], out["SPEC-001:TASK-002"]
    assert (first["severity"], first["path"], first["reverify"]) == ("high", "s/SPEC-001/tasks.md#TASK-001", "SPEC-001:TASK-001")
    assert first["reason"] == "TASK-001 serves SPEC-001:R2, whose content changed between v1 and v2; its own recorded evidence is already failed against its current content"
    assert (second["severity"], second["n_paths"], second["reason"]) == ("medium", 2, "TASK-002 serves SPEC-001:R2, whose content changed between v1 and v2")
    # KNOW-002 changed too, so it is no item; that it refers to KNOW-001 is a relation of KNOW-001
    assert out["SPEC-002"]["classification"] == out["KNOW-002"]["classification"] == "no_known_relation"
    assert impact.analyze(changed.where("false"), refs, rows, "a", "b").count() == 0


def test_files_that_serve_no_change_are_not_parsed(spark):
    changed = spark.createDataFrame([("SPEC-001", 1, "s/SPEC-001", 1), ("SPEC-002", None, "s/SPEC-002", 2), ("SPEC-003", 2, None, 3)], "id string, requirement int, spec_dir string, ord bigint")
    files = spark.createDataFrame([(f"s/SPEC-00{k}/tasks.md", f"## TASK-001 a\nServes: SPEC-00{k}:R1\n") for k in (1, 2, 3)] + [(None, "x")], "path string, content string")
    some = impact.served_files(changed, files)
    assert [r.path for r in some.collect()] == ["s/SPEC-001/tasks.md"] and some.columns == files.columns
    of = lambda fs: [r.item for r in impact.coverage(changed, tasks.rows(fs)).collect()]
    assert of(some) == of(files) == ["SPEC-001:TASK-001"]
