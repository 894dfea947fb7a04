"""Reads the given tables, and relations that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def artifact_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, content`` of every Markdown file below ``root``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    return raw.select(F.regexp_replace(F.regexp_extract("path", r"(?s)\A[^:/]+:/*(/.*)\z", 1), f"\\A{base}/", "").alias("path"), F.decode("content", "UTF-8").alias("content"))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """``path, extension, size`` of every file below ``root``; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select("path", F.regexp_extract("path", r"(\.[^./]*)\z", 1).alias("extension"), F.col("length").alias("size")).orderBy("path")


def turn_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown file for each turn of ``conversations``: headings, a link, a fence with a link that doesn't count."""
    t = table(spark, sf_dir, "conversations")
    line = lambda *c: F.concat(*c, F.lit("\n"))
    n = F.col("conv_id").cast("string")
    content = F.concat(
        line(F.lit("# Conv "), n, F.lit(" {#c"), n, F.lit("}")), line(F.lit("see [[C-"), ((F.col("conv_id") * 7 + 3) % 50).cast("string"), F.lit("#top|next]]")),
        line(F.lit("## "), F.col("role")), line(F.coalesce("text", F.lit(""))), line(F.lit("```")), line(F.lit("# not [[a-link]]")), line(F.lit("```")), F.lit("## End\nback to [[C-"), F.col("turn").cast("string"), F.lit("]]"),
    )
    return t.select(F.concat(F.lit("c/"), n, F.lit("/"), F.col("turn").cast("string"), F.lit(".md")).alias("path"), content.alias("content"))


def task_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task file for each order, with a task for each of its lines: finished lines are checked, each but the
    first depends on the one before, and the evidence of lines that were not returned is up to date."""
    n = F.col("l_linenumber")
    text = F.concat(
        F.when(F.col("l_linestatus") == "F", "- [x] ship").otherwise("- [ ] ship"), F.lit("\nServes: "), F.format_string("SPEC-%03d:R%d", F.col("l_partkey") % 999 + 1, n), F.when(F.col("l_suppkey") % 4 == 0, ", R9").otherwise(""),
        F.lit("\nDepends on: "), F.when(n > 1, F.format_string("TASK-%03d", n - 1)).otherwise("none"), F.lit("\nScope: line "), n.cast("string"),
    )
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", text.alias("text"))
    mark = F.concat(F.lit("sha256:"), F.sha2("text", 256))
    task = F.concat(F.format_string("## TASK-%03d line\n", n), F.col("text"), F.when(F.col("l_returnflag") == "R", "\nEvidence-Result: fail").otherwise("\nEvidence-Result: pass"), F.lit("\nEvidence-Fingerprint: "), F.when(F.col("l_returnflag") == "N", mark).otherwise("sha256:0"))
    files = t.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", task.alias("task")))).alias("xs"))
    path = F.concat(F.lit("specs/SPEC-"), F.col("l_orderkey").cast("string"), F.lit("/tasks.md"))
    return files.select(path.alias("path"), F.concat(F.lit("# Tasks\n"), F.array_join("xs.task", "\n")).alias("content"))


def part_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, target``: the edges between parts as files that refer to packages."""
    e = part_edges(spark, sf_dir)
    return e.select(F.concat(F.lit("src/m"), (F.col("src") % 9).cast("string"), F.lit("/p"), F.col("src").cast("string"), F.lit(".go")).alias("path"), F.concat(F.lit("lib/k"), (F.col("dst") % 7).cast("string"), F.lit("/p"), F.col("dst").cast("string")).alias("target"))


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst``: each part refers to two others by arithmetic on its key."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    return p.select("src", F.explode(F.array((F.col("src") * 3 + 1) % 1999 + 1, F.expr("src div 2 + 1"))).alias("dst")).where("src <> dst").distinct()


def spec_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spec file for each customer and a feature file for each supplier, every fourth in two places, with faults
    by arithmetic on the key: wrong ids, no front matter's end, no id, unknown statuses, parents and links."""
    k, name = F.col("c_custkey") + 1, lambda p, n: F.format_string(f"{p}-%03d", n.cast("long"))
    parent = F.when(k % 13 == 0, "parent: PRG-001\n").when(k % 5 == 0, "").otherwise(F.concat(F.lit("parent: "), name("FEAT", k % 12 + 1), F.lit("\n")))
    head = F.concat(
        F.lit("---\n"), F.when(k % 19 == 0, "").otherwise(F.concat(F.lit("id: "), name("SPEC", F.when(k % 11 == 0, k + 1).otherwise(k)), F.lit("\n"))), F.lit("type: spec\nstatus: "), F.when(k % 7 == 0, "open").otherwise("draft"), F.lit("\n"), parent,
        F.lit("depends_on: ["), name("SPEC", k + 1), F.lit("]\nsupersedes:\n  - "), name("SPEC", k * 2), F.lit("\n"), F.when(k % 17 == 0, "").otherwise("---\n"),
    )
    body = F.concat(F.lit("# Spec {#top}\n[[SPEC-001#top]] [["), name("SPEC", k * 3), F.lit("]] [["), name("FEAT", k % 12 + 1), F.lit("#top]]\n"), F.when(k % 6 == 0, "[[bad]]\n## Again {#top}\n").otherwise(""))
    specs = table(spark, sf_dir, "customer").select(F.concat(F.lit("specs/"), name("SPEC", k), F.lit("/spec.md")).alias("path"), F.concat(head, body).alias("content"))
    s = F.col("s_suppkey") + 1
    text = F.concat(F.lit("---\nid: "), name("FEAT", F.col("s")), F.lit("\ntype: feature\nstatus: active\nparent: PRG-001\n---\n# Feature\n"))
    places = F.explode(F.when(s % 4 == 0, F.array(F.lit("a/"), F.lit("b/"))).otherwise(F.array(F.lit("a/"))))
    return specs.union(table(spark, sf_dir, "supplier").select(s.alias("s"), places.alias("at")).select(F.concat("at", name("FEAT", F.col("s")), F.lit("/feature.md")), text))


def linked_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spec file for each customer that depends on two others of its eighty, by its nation and its balance; those of
    every tenth are itself and one twice, and every ninth has no front matter that ends."""
    k, name = F.col("c_custkey"), lambda n: F.format_string("SPEC-%03d", n.cast("long"))
    at = lambda x: F.expr("c_custkey div 80") * 80 + F.pmod(x, F.lit(80))
    one, two = at(k + 1 + F.col("c_nationkey") % 3), at(F.floor(F.abs("c_acctbal")).cast("long"))
    deps = F.when(k % 10 == 0, F.concat(name(k), F.lit(", "), name(one), F.lit(", "), name(one))).otherwise(F.concat(name(one), F.lit(", "), name(two), F.lit(", KNOW-001")))
    content = F.concat(F.lit("---\nid: "), name(k), F.lit("\ntype: spec\nstatus: draft\ndepends_on: ["), deps, F.lit("]\n"), F.when(k % 9 == 0, "").otherwise("---\n"), F.lit("# Spec\n"))
    return table(spark, sf_dir, "customer").where(k > 0).select(F.concat(F.lit("specs/"), name(k), F.lit("/spec.md")).alias("path"), content.alias("content"))


def linked_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task file for each order: a task for each of its lines that depends on two others by the line's part and supplier,
    some of which aren't there; lines of odd parts are written with tabs and carriage returns."""
    n, name = F.col("l_linenumber"), lambda x: F.format_string("TASK-%03d", x.cast("long"))
    deps = F.concat(name(F.col("l_partkey") % 8 + 1), F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit(", "), name(F.col("l_suppkey") % 7 + 1))))
    line = F.when(F.col("l_partkey") % 2 == 1, F.concat(F.lit("\tDepends on:\t"), deps, F.lit("\r"))).otherwise(F.concat(F.lit("Depends on: "), deps))
    text = F.concat(F.lit("## "), name(n), F.lit(" line\n- [ ] ship\n"), line, F.when(F.col("l_suppkey") % 5 == 0, "\n\tServes:\tSPEC-001:R1\r").otherwise(""))
    files = table(spark, sf_dir, "lineitem").select("l_orderkey", n, text.alias("text")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "text"))).alias("xs"))
    path = F.concat(F.lit("specs/SPEC-"), F.col("l_orderkey").cast("string"), F.lit("/tasks.md"))
    return files.select(path.alias("path"), F.concat(F.lit("# Tasks\n"), F.array_join("xs.text", "\n")).alias("content"))


def headed_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spec file of four sections for each customer; one of them is empty, one lies two levels deep."""
    k, seg = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    content = F.concat(
        F.lit("# Spec "), k, F.lit("\nabout "), seg, F.lit("\n## Requirements {#req}\nR1 "), F.col("c_name"), F.lit("\n\nR2 nation "), F.col("c_nationkey").cast("string"), F.lit(" "), seg,
        F.lit("\n## Empty {#none}\n### Deep {#deep}\ndeep "), F.floor(F.abs("c_acctbal")).cast("string"),
    )
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("specs/"), k, F.lit(".md")).alias("path"), content.alias("content"))


def customer_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parent, a dependency and a link of each customer among the first hundred, by arithmetic on its key."""
    k = F.col("c_custkey")
    anchor = F.when(k % 4 == 0, "").when(k % 4 == 1, "deep").when(k % 4 == 2, "none").otherwise("missing")
    ref = lambda rel, to, n: F.struct(F.lit(rel).alias("relation"), to.cast("string").alias("target_id"), F.lit(n).alias("ord"))
    rows = table(spark, sf_dir, "customer").select(k, F.explode(F.array(ref("parent", (k * 3 + 1) % 100, 0), ref("depends_on", (k * 7 + 2) % 100, 1), ref("wikilink", (k * 11 + 3) % 100, 2))).alias("x"), anchor.alias("a"))
    link = F.col("x.relation") == "wikilink"
    return rows.select(
        k.cast("string").alias("source_id"), "x.target_id", "x.relation", F.concat(F.lit("specs/"), k.cast("string"), F.lit(".md")).alias("source_path"), k.alias("source_rank"), "x.ord",
        F.when(link, F.when(k % 2 == 0, "Requirements").otherwise("Notes")).alias("source_section"), F.when(link, 6).alias("source_line"), F.when(link, F.col("a")).alias("target_anchor"),
    )


def requirement_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A spec file with one to four requirements for each order, and a task file with a task for each of its lines.

    Every sixth spec declares R1 twice; a line serves its own order's requirement, another order's, none or a malformed one by its part and supplier."""
    k, spec = F.col("o_orderkey"), lambda n: F.format_string("SPEC-%06d", n.cast("long"))
    status = F.when(F.col("o_orderstatus") == "F", "draft").when(F.col("o_orderstatus") == "O", "ready").otherwise("in_progress")
    heads = F.array_join(F.transform(F.sequence(F.lit(1), (k % 4 + 1).cast("int")), lambda i: F.concat(F.repeat(F.lit("#"), i + 1), F.lit(" R"), i.cast("string"), F.lit(": goal\nmust hold\n"))), "")
    content = F.concat(F.lit("---\nid: "), spec(k), F.lit("\ntype: spec\nstatus: "), status, F.lit("\n---\n# Spec\n"), heads, F.when(k % 6 == 0, "## R1 again\nmust not\n").otherwise(""), F.lit("## R7x no requirement\n"))
    specs = table(spark, sf_dir, "orders").where(k > 0).select(F.concat(F.lit("specs/"), spec(k), F.lit("/spec.md")).alias("path"), content.alias("content"))
    n, own, sup = F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_suppkey")
    ref = F.concat(spec(F.when(sup % 6 == 0, own + 1).otherwise(own)), F.lit(":R"), (F.col("l_partkey") % 5 + 1).cast("string"))
    text = F.concat(F.when(F.col("l_linestatus") == "F", "- [x] ship").otherwise("- [ ] ship"), F.when(sup % 5 == 0, "").otherwise(F.concat(F.lit("\n\tServes: "), ref, F.when(sup % 4 == 0, ', R"9').otherwise(""), F.lit("\r"))))
    mark = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise("sha256:0")
    proof = F.when(F.col("l_returnflag") == "A", "").otherwise(F.concat(F.lit("\nEvidence-Result: "), F.when(F.col("l_returnflag") == "R", "fail").otherwise("pass"), F.lit("\nEvidence-Fingerprint: "), mark))
    lines = table(spark, sf_dir, "lineitem").where(own > 0).select(own, n, F.concat(F.format_string("## TASK-%06d line\n", n.cast("long")), text, proof).alias("task"))
    files = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "task"))).alias("xs"))
    return specs, files.select(F.concat(F.lit("specs/"), spec(F.col("l_orderkey")), F.lit("/tasks.md")).alias("path"), F.concat(F.lit("# Tasks\n"), F.array_join("xs.task", "\n")).alias("content"))


def spec_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Spec files of the customers at two points in time: a fifth is only in one, another fifth only in the other, a third
    changes, and some have front matter without an end."""
    k, name = F.col("c_custkey"), lambda n: F.format_string("SPEC-%03d", n.cast("long"))
    head = F.concat(F.lit("---\nid: "), name(k), F.lit("\ntype: spec\nstatus: draft\ndepends_on: [SPEC-001]\n"), F.when(k % 35 == 3, "").otherwise("---\n"), F.lit("# Spec "), k.cast("string"), F.lit("\n"), F.col("c_mktsegment"))
    tail = F.concat(F.lit("\nsee [[SPEC-002#req]] [["), name(k * 7 % 97 + 1), F.lit("]]\n## Requirements {#req}\nR1 "), F.col("c_name"), F.lit("\n"))
    rows = table(spark, sf_dir, "customer").where(k > 0)
    path = F.concat(F.lit("programs/PRG-001/features/FEAT-001/specs/"), name(k), F.lit("/spec.md")).alias("path")
    later = F.concat(head, F.when(k % 5 == 2, " changed").otherwise(""), tail)
    return rows.where(k % 5 != 0).select(path, F.concat(head, tail).alias("content")), rows.where(k % 5 != 1).select(path, later.alias("content"))


def planned_tasks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For each customer with orders a task file with a task for each order, a spec of four requirements and a plan that names some of them."""
    o, k = table(spark, sf_dir, "orders").where("o_custkey > 0"), F.col("o_orderkey")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    spec, task = F.format_string("SPEC-%06d", "o_custkey"), lambda x: F.format_string("TASK-%06d", x)
    rows = o.select("o_custkey", k, "o_orderstatus", n.alias("n"))
    deps = F.array_compact(F.array(F.when((k % 3 == 0) & (F.col("n") > 1), task(F.col("n") - 1)), F.when(k % 7 == 0, task(F.col("n") + 1))))
    text = F.concat(F.when(F.col("o_orderstatus") == "F", "- [x] do").otherwise("- [ ] do"), F.lit("\nServes: "), spec, F.lit(":R"), (k % 5 + 1).cast("string"), F.lit(", "), spec, F.lit(":R"), (F.col("n") % 5 + 1).cast("string"), F.when(F.size(deps) > 0, F.concat(F.lit("\nDepends on: "), F.array_join(deps, ", "))).otherwise(""))
    mark = F.when(k % 2 == 0, F.concat(F.lit("\nEvidence-Result: pass\nEvidence-Fingerprint: sha256:"), F.sha2(text, 256))).otherwise("")
    each = rows.select(spec.alias("spec"), F.struct("n", F.concat(F.lit("## "), task(F.col("n")), F.lit(" order\n"), text, mark).alias("t")).alias("x"))
    files = each.groupBy("spec").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    at = lambda name: F.concat(F.lit("specs/"), F.col("spec"), F.lit(f"/{name}.md")).alias("path")
    specs = files.select(at("spec"), F.concat(F.lit("# "), "spec", F.lit("\n## R1\none\n## R2\ntwo\n### R3\nthree\n## R4\nfour")).alias("content"))
    plans = files.select(at("plan"), F.concat(F.lit("# Plan\n## First\ndo R1, then R2.\n## Second\nfor "), "spec", F.lit(":R3\n## Rest\nR44 later")).alias("content"))
    return files.select(at("tasks"), F.concat(F.lit("# Tasks\n"), F.array_join("xs.t", "\n")).alias("content")), specs, plans
