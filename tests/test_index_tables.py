"""The index tables stay in step with the files and write only what changed."""

import os

from corpusloom.operators import index_tables as I


def text(n, more=""):
    return f"---\nid: SPEC-{n:03d}\ntype: spec\nstatus: draft\nparent: FEAT-001\ndepends_on: [SPEC-001]\n---\n# Spec {n}\nsee [[SPEC-001#top]] and [[SPEC-777]]{more}\n## Empty\n## Part {{#p}}\nbody\n"


def path(n):
    return f"programs/PRG-001/features/FEAT-001/specs/SPEC-{n:03d}/spec.md"


def files_of(at):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(at) for f in fs if f.endswith(".parquet")}


def test_sync(spark, tmp_path):
    at = str(tmp_path / "index")
    df = lambda rows: spark.createDataFrame(rows, "path string, content string")
    actions = lambda out: {r["path"]: r["action"] for r in out.collect()}
    first = [(path(n), text(n)) for n in range(1, 9)] + [(path(9), "---\nid: ?\n---\n"), (path(10), "no front matter")]
    assert actions(I.sync(df(first), at, 4)) == {path(n): "indexed" if n < 9 else "failed" for n in range(1, 11)}
    docs = {r["path"]: r for r in I.table(spark, at, "documents").collect()}
    assert set(docs) == {path(n) for n in range(1, 9)} and docs[path(2)]["title"] == "Spec 2" and docs[path(2)]["artifact_id"] == "SPEC-002" and docs[path(2)]["artifact_type"] == "spec"
    chunks = sorted((r["heading"], r["start_line"], r["end_line"], r["anchor"]) for r in I.table(spark, at, "chunks").where(f"path = '{path(3)}'").collect())
    assert chunks == [("Part", 11, 13, "p"), ("Spec 3", 8, 9, None)]
    links = sorted((r["relation"], r["target_id"], r["source_section"], r["source_line"], r["target_anchor"]) for r in I.table(spark, at, "links").where("source_id = 'SPEC-003'").collect())
    assert links == [("depends_on", "SPEC-001", None, None, None), ("parent", "FEAT-001", None, None, None), ("wikilink", "SPEC-001", "Spec 3", 9, "top")]

    before = files_of(at)
    again = I.sync(df(first), at, 4)
    assert {r["action"]: r["n"] for r in I.report(again).collect()} == {"skipped": 8, "failed": 2} and files_of(at) == before

    second = [(path(n), text(n, " changed" if n == 2 else "")) for n in range(1, 8)] + [(path(3), "---\nbroken")][:0] + [(path(11), text(11))]
    second[3] = (path(4), "broken now")
    assert actions(I.sync(df(second), at, 4)) == {**{path(n): "skipped" for n in (1, 3, 5, 6, 7)}, path(2): "updated", path(4): "failed", path(8): "removed", path(11): "indexed"}
    live = {path(n) for n in (1, 2, 3, 5, 6, 7, 11)}
    for name in ("documents", "chunks", "links"):
        assert {r["path"] for r in I.table(spark, at, name).select("path").distinct().collect()} == live
    assert I.table(spark, at, "chunks").where("content like '%changed%'").count() == 1
    fresh = str(tmp_path / "fresh")
    I.rebuild(df(second), fresh, 4)
    for name in ("documents", "chunks", "links"):
        assert sorted(map(str, I.table(spark, fresh, name).collect())) == sorted(map(str, I.table(spark, at, name).collect()))
    hits = spark.createDataFrame([(path(1), 8, -1.0)], "path string, start_line int, rank double")
    (hit,) = I.provenance(hits, spark, at).collect()
    assert (hit["artifact_id"], hit["title"], hit["heading"]) == ("SPEC-001", "Spec 1", "Spec 1")
    assert actions(I.sync(df(second).where("false"), at, 4)) == dict.fromkeys(live, "removed")
    assert all(I.table(spark, at, name).count() == 0 for name in ("documents", "chunks", "links"))
