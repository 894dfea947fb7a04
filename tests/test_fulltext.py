"""Full-text search against the embedded engine whose grammar it speaks, where Python has it."""

import random
import sqlite3

import pytest

from corpusloom.operators import fulltext

ROWS = [
    (1, "Intent", "Refresh token rotation keeps sessions alive; the refresh-token is rotated once."),
    (2, "Summary of café", "Résumé: a well-known plan, well known by the team. Naïve retry policy at most once"),
    (3, "Summary", "retry retry retry policy (idempotent) one two three four five six seven eight nine ten eleven twelve policy"),
    (4, None, "token refresh; Straße ÉCOLE école"), (5, "one two", None), (6, "", ""), (7, "two one three", "one x y two one"),
    (8, "SPEC-014:TASK-003", "AND or NOT near_by foo bar baz_qux foo"), (9, "heading with token", "nothing else here"),
]
FREE = ["rotation", "café", "cafe", "well-known", 'retry-policy: "at most once" (idempotent)', "SPEC-014:TASK-003", "foo* OR bar NOT baz", "NEAR(a, b)", '"refresh token"', "---():", "   ", '""', "école", "one two"]
ADVANCED = [
    '"refresh token"', "refresh AND token", "refresh OR policy", "retry NOT idempotent", "ref*", "one + two", "NEAR(one two)", "NEAR(one two, 1)", "NEAR(one two, 0)", 'NEAR("one two" three, 2)', "NEAR(retry policy nine, 12)", "heading : token", "content: token", "{heading content} : two",
    "- heading : one", "^one", "heading : ^two", "^ two one", "one two NOT three", "one two OR team AND plan", "(one OR retry) AND two", "(one OR retry) NOT two NOT seven", "heading : (one OR summary)", '"well known"', "wel* AND pl*", '"one tw" *', "one OR two AND three NOT five", "cafe", "ecole", '"" one', '"!!" AND one', "token OR \"!!\"",
]
BROKEN = ['"unbalanced', "AND", "one AND", "one OR OR two", "(one", "one)", "nocol : x", "one - two", "NEAR(one two, x)", "one (two)", "*", "a.b", "- one", "one NOT"]


def engine():
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(heading, content)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text engine to compare with")
    db.executemany("INSERT INTO t(rowid, heading, content) VALUES (?, ?, ?)", ROWS)
    return db


@pytest.fixture(scope="module")
def idx(spark):
    return fulltext.index(spark.createDataFrame(ROWS, "id long, heading string, content string"), "id")


def quoted(text):
    return " ".join('"' + w.replace('"', '""') + '"' for w in text.split())


@pytest.mark.parametrize("text", FREE)
def test_free_texts(idx, text):
    want = sorted(engine().execute("SELECT rowid, round(bm25(t), 6) FROM t WHERE t MATCH ?", (quoted(text),)).fetchall()) if text.strip() else []
    got = sorted((r["id"], round(r["rank"], 6)) for r in fulltext.search(idx, fulltext.free(text)).collect())
    assert got == want


@pytest.mark.parametrize("text", ADVANCED)
def test_expressions(idx, text):
    want = sorted(r[0] for r in engine().execute("SELECT rowid FROM t WHERE t MATCH ?", (text,)).fetchall())
    got = fulltext.search(idx, fulltext.advanced(text)).collect()
    assert sorted(r["id"] for r in got) == want
    assert [(r["rank"], r["id"]) for r in got] == sorted((r["rank"], r["id"]) for r in got)


@pytest.mark.parametrize("text", ['"refresh token"', "ref*", "refresh AND token", "one + two", "heading : token", "NEAR(one two, 1)", "retry OR policy"])
def test_ranks_of_expressions(idx, text):
    want = dict(engine().execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (text,)).fetchall())
    got = {r["id"]: r["rank"] for r in fulltext.search(idx, fulltext.advanced(text)).collect()}
    assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("text", BROKEN)
def test_broken_expressions(text):
    with pytest.raises(sqlite3.OperationalError):
        engine().execute("SELECT rowid FROM t WHERE t MATCH ?", (text,)).fetchall()
    with pytest.raises(fulltext.QuerySyntaxError):
        fulltext.advanced(text)


def test_random_phrases_and_nearness(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 3))), " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 14)))) for i in range(60)]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(heading, content)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text engine to compare with")
    db.executemany("INSERT INTO t(rowid, heading, content) VALUES (?, ?, ?)", rows)
    idx = fulltext.index(spark.createDataFrame(rows, "id long, heading string, content string"), "id")
    for text in ('NEAR("a b" c d, 2)', "NEAR(a b c, 1) OR e + e", '("a b" OR "b c") NOT (d AND heading : a)', "^a NOT content : e"):
        want = sorted(r[0] for r in db.execute("SELECT rowid FROM t WHERE t MATCH ?", (text,)).fetchall())
        assert sorted(r["id"] for r in fulltext.search(idx, fulltext.advanced(text), limit=None).collect()) == want


def test_limit_terms_and_empty_tables(spark, idx):
    assert [r["id"] for r in fulltext.search(idx, fulltext.free("summary"), limit=1).collect()] == [2]
    assert fulltext.query_terms("To the É Café", "unused") == ["the", "café"] and fulltext.query_terms("", "a task") == ["task"]
    none = fulltext.index(spark.createDataFrame([], "id long, heading string, content string"), "id")
    assert fulltext.search(none, fulltext.free("a")).count() == 0
