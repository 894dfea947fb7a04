import re
import subprocess
import sys

from pyspark.sql import functions as F

from corpusloom.functions import scalars as S
from corpusloom.operators import context, markdown


def test_globs():
    assert re.match(S.glob_regex("a/**").replace(r"\z", r"\Z"), "a/b/c.go") and not re.match(S.glob_regex("a/*").replace(r"\z", r"\Z"), "a/b/c.go")


def test_ids(spark):
    got = spark.sql("select explode(array('SPEC-002','SPEC-0','X-1','FEAT-12345',null)) id").select(S.parse_id(F.col("id")).alias("x")).collect()
    assert [(r.x.number, r.x.width) if r.x else None for r in got] == [(2, 3), None, None, (12345, 5), None]


def test_units_join_to_the_text(spark):
    text = "a\nb\n\n\nc\n \nd"
    got = spark.createDataFrame([(text,)], "t string").select(markdown.units(F.col("t")).alias("u")).first()["u"]
    assert "".join(got) == text and len(got) == 3


def test_budget_goes_on_after_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, 1, 8, True), (1, 2, 5, False), (1, 3, 2, False)], "g int, o int, t int, m boolean")
    got = context.budget(rows, 10, ["g"], F.col("o"), F.col("t"), F.col("m")).orderBy("position").collect()
    assert [r["kept"] for r in got] == [True, False, True]


def test_works_without_the_training_data_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) == 61"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])


def test_evidence_with_tabs_and_line_ends(spark):
    from pyspark.sql import functions as F

    from corpusloom.functions import scalars

    rows = spark.createDataFrame([("a\n\tEvidence-Result: pass\r\nb",), ("Evidence-Result:\tpass ",), ("none",)], "body string")
    assert [r[0] for r in rows.select(scalars.evidence_field(F.col("body"), "Result")).collect()] == ["pass", "pass", None]


def test_pack_diff_with_null_marks(spark):
    from corpusloom.operators import context

    base = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "y")], "id int, fingerprint string")
    new = spark.createDataFrame([(1, None), (2, "z"), (3, "x"), (5, None)], "id int, fingerprint string")
    got = {r["id"]: r["change"] for r in context.pack_diff(base, new, ["id"]).collect()}
    assert got == {1: "reused", 2: "modified", 3: "reused", 4: "removed", 5: "added"}
