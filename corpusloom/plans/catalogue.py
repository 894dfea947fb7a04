"""Named queries over the given tables, each beside the SQL it is held against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import architecture, artifacts, candidates, context, cycles, evaluation, fulltext, graph, impact, index_tables, markdown, packs, preparation, requirements, search, tasks, validation
from ..sources.saved import saved, shared_dir
from ..sources.tables import customer_references, headed_specs, linked_specs, linked_tasks, part_edges, part_references, planned_tasks, requirement_files, spec_files, spec_versions, table, task_files, turn_files

QUERIES: dict = {}
ORACLE_SQL: dict = {}

_FILES = """files AS (SELECT 'c/' || conv_id || '/' || turn || '.md' AS path, conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"""
_EDGES = """edges AS (SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, (p_partkey * 3 + 1) % 1999 + 1 AS dst FROM part UNION ALL SELECT p_partkey, p_partkey // 2 + 1 FROM part) WHERE src <> dst)"""
_BM25 = r"""
 t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ts, text FROM documents),
 r AS (SELECT doc_id, text, len(ts) AS dl, len(list_filter(ts, lambda x: x = 'esat')) AS f0, len(list_filter(ts, lambda x: x = 'ndat')) AS f1 FROM t),
 s AS (SELECT count(*) AS n, avg(dl) AS mean, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM r),
 hits AS (SELECT doc_id, text, -(greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / mean))
   + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / mean))) AS rank FROM r, s WHERE f0 > 0 AND f1 > 0),
 top AS (SELECT doc_id, text, rank, row_number() OVER (ORDER BY rank, doc_id) AS position FROM hits QUALIFY position <= 100)"""


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


@query(f"WITH {_BM25} SELECT doc_id, position, round(rank, 6) AS rank FROM top")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.bm25(table(spark, sf_dir, "documents"), ["esat", "ndat"], "doc_id")
    return context.ranked(hits, F.col("rank"), F.col("doc_id")).select("doc_id", "position", F.round("rank", 6).alias("rank"))


@query(f"""WITH RECURSIVE {_BM25},
 c AS (SELECT doc_id, position, (length(text) + 3) // 4 AS tokens, rank FROM top),
 walk AS (SELECT 0 AS position, CAST(0 AS BIGINT) AS used, false AS kept UNION ALL
  SELECT c.position, CASE WHEN used + tokens <= 6000 THEN used + tokens ELSE used END, used + tokens <= 6000 FROM walk JOIN c ON c.position = walk.position + 1)
SELECT doc_id, position, tokens, round(rank, 6) AS rank, kept FROM c JOIN walk USING (position)""")
def bm25_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: search, rank and fill a budget of 6000 tokens."""
    docs = table(spark, sf_dir, "documents")
    hits = context.ranked(search.bm25(docs, ["esat", "ndat"], "doc_id"), F.col("rank"), F.col("doc_id"))
    items = docs.join(F.broadcast(hits), "doc_id").select("doc_id", "position", S.token_estimate(F.col("text")).alias("tokens"), "rank")
    kept = context.budget(items.withColumn("g", F.lit(1)), 6000, ["g"], F.col("position"), F.col("tokens"), F.lit(False))
    return items.join(kept, "position").select("doc_id", "position", "tokens", F.round("rank", 6).alias("rank"), "kept")


@query("SELECT source, count(*) AS n, sum((length(coalesce(text, '')) + 3) // 4)::BIGINT AS tokens FROM documents GROUP BY source")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(S.token_estimate(F.col("text"))).alias("tokens"))


@query("SELECT 'sha256:' || sha256(text) AS fingerprint, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def fingerprint_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", S.fingerprint(F.col("text")).alias("fingerprint"))
    return docs.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n_filled FROM documents")
def lines_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = F.split("text", "\n", -1)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(ls).cast("long").alias("n_lines"), F.size(F.filter(ls, lambda x: F.trim(x) != "")).cast("long").alias("n_filled"))


@query("SELECT c_custkey, id, CASE WHEN c_custkey > 0 THEN 'spec' END AS kind, CASE WHEN c_custkey > 0 THEN c_custkey END AS number, CASE WHEN c_custkey > 0 THEN length(id) - 5 END AS width FROM (SELECT c_custkey, printf('SPEC-%03d', c_custkey) AS id FROM customer)")
def id_parse_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", S.format_id("SPEC", F.col("c_custkey")).alias("id")).withColumn("x", S.parse_id(F.col("id")))
    return rows.select("c_custkey", "id", F.col("x.type").alias("kind"), F.col("x.number").cast("long").alias("number"), F.col("x.width").cast("long").alias("width"))


@query("""SELECT n_nationkey, path, CASE WHEN n_nationkey % 5 = 0 THEN 'program' WHEN n_nationkey % 5 = 1 THEN 'feature' WHEN n_nationkey % 5 = 2 THEN 'tasks' WHEN n_nationkey % 5 = 3 THEN 'knowledge' END AS kind
FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'ai/programs/PRG-' || n_nationkey || '/program.md' WHEN n_nationkey % 5 = 1 THEN 'ai/programs/PRG-1/features/FEAT-' || n_nationkey || '/feature.md'
 WHEN n_nationkey % 5 = 2 THEN 'ai/programs/PRG-1/features/FEAT-1/specs/SPEC-' || n_nationkey || '/tasks.md' WHEN n_nationkey % 5 = 3 THEN 'ai/knowledge/KNOW-' || n_nationkey || '-' || lower(n_name) || '.md' ELSE 'ai/notes/' || n_nationkey || '.md' END AS path FROM nation)""")
def classify_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    s = k.cast("string")
    path = (F.when(k % 5 == 0, F.concat(F.lit("ai/programs/PRG-"), s, F.lit("/program.md"))).when(k % 5 == 1, F.concat(F.lit("ai/programs/PRG-1/features/FEAT-"), s, F.lit("/feature.md")))
            .when(k % 5 == 2, F.concat(F.lit("ai/programs/PRG-1/features/FEAT-1/specs/SPEC-"), s, F.lit("/tasks.md"))).when(k % 5 == 3, F.concat(F.lit("ai/knowledge/KNOW-"), s, F.lit("-"), F.lower("n_name"), F.lit(".md")))
            .otherwise(F.concat(F.lit("ai/notes/"), s, F.lit(".md"))))
    return table(spark, sf_dir, "nation").select("n_nationkey", path.alias("path")).withColumn("kind", S.classify_path(F.col("path")))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slugify_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.slug(F.concat("p_name", F.lit(" / "), "p_type", F.lit("!"))).alias("slug"))


@query(r"""SELECT page_id, rule FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages) p,
 (VALUES ('http*://*.example.com/**', '^http[^/]*://[^/]*\.example\.com/(?s:.*)$'), ('**/en/*', '^(?s:.*)/en/[^/]*$'), ('https://m.??????.*.net/**', '^https://m\.(?s:.)(?s:.)(?s:.)(?s:.)(?s:.)(?s:.)\.[^/]*\.net/(?s:.*)$')) r(rule, rx)
 WHERE regexp_matches(u, rx)""")
def glob_rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with every glob rule that its url matches; the rules are a fixed list, so no join is needed."""
    rules = ["http*://*.example.com/**", "**/en/*", "https://m.??????.*.net/**"]
    u = F.regexp_replace("url", r"(?s)[?#].*\z", "")
    hit = F.array_compact(F.array(*[F.when(u.rlike(S.glob_regex(g)), F.lit(g)) for g in rules]))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(hit).alias("rule"))


@query(f"""WITH {_FILES}, n AS (SELECT *, len(string_split(text, chr(10))) AS k FROM files)
SELECT path, 1 AS ord, 1 AS level, 'Conv ' || conv_id AS heading, 'c' || conv_id AS anchor, 1 AS start_line, 2 AS end_line, 'see [[C-' || ((conv_id * 7 + 3) % 50) || '#top|next]]' AS body FROM n
UNION ALL SELECT path, 2, 2, role, NULL, 3, 6 + k, text || chr(10) || '```' || chr(10) || '# not [[a-link]]' || chr(10) || '```' FROM n
UNION ALL SELECT path, 3, 2, 'End', NULL, 7 + k, 8 + k, 'back to [[C-' || turn || ']]' FROM n""")
def md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = markdown.sections(turn_files(spark, sf_dir))
    return out.select("path", "ord", "level", "heading", "anchor", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "body")


@query(f"""WITH {_FILES}, n AS (SELECT *, len(string_split(text, chr(10))) AS k FROM files), b AS (
 SELECT path, 2 AS o, 'see [[C-' || ((conv_id * 7 + 3) % 50) || '#top|next]]' AS body FROM n UNION ALL SELECT path, 3, text || chr(10) || '```' || chr(10) || '# not [[a-link]]' || chr(10) || '```' FROM n UNION ALL SELECT path, 4, 'back to [[C-' || turn || ']]' FROM n)
SELECT path, count(*) AS n, sum((length(body) + 3) // 4)::BIGINT AS tokens FROM b GROUP BY path""")
def md_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.chunks(markdown.sections(turn_files(spark, sf_dir))).groupBy("path").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query(f"""WITH {_FILES}, n AS (SELECT *, len(string_split(text, chr(10))) AS k FROM files)
SELECT path, 2 AS line, 'C-' || ((conv_id * 7 + 3) % 50) AS target, 'top' AS anchor, 'next' AS alias FROM n UNION ALL SELECT path, 8 + k, 'C-' || turn, NULL, NULL FROM n""")
def md_wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.wikilinks(turn_files(spark, sf_dir)).select("path", F.col("line").cast("long").alias("line"), "target", "anchor", "alias")


@query(f"""WITH {_FILES}, n AS (SELECT *, len(string_split(text, chr(10))) AS k FROM files)
SELECT path, 2 AS line, 'Conv ' || conv_id AS section FROM n UNION ALL SELECT path, 8 + k, 'End' FROM n""")
def link_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = turn_files(spark, sf_dir)
    return markdown.occurrences(markdown.wikilinks(files), markdown.sections(files)).select("path", F.col("line").cast("long").alias("line"), "section")


@query(f"""WITH {_FILES} SELECT path, 3 AS fenced_lines, len(string_split(text, chr(10))) + 8 AS n_lines FROM files""")
def fence_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = F.split("content", "\n", -1)
    return turn_files(spark, sf_dir).select("path", F.size(F.filter(markdown.fence_mask(ls), lambda x: x)).alias("fenced_lines"), F.size(ls).cast("long").alias("n_lines"))


@query("""SELECT c_custkey, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS state, coalesce(n, 0) AS n_paths, coalesce(p, '') AS first_path
FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderkey) AS n, min('o/' || o_orderkey) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def resolve_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    ents = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("path"))
    out = graph.resolve(table(spark, sf_dir, "customer").select("c_custkey"), ents, "c_custkey")
    return out.select("c_custkey", "state", F.size("paths").cast("long").alias("n_paths"), F.coalesce(F.try_element_at("paths", F.lit(1)), F.lit("")).alias("first_path"))


@query("""SELECT l_suppkey AS spec, l_partkey AS task, count(*) AS n, count(DISTINCT l_orderkey) AS n_places FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicates_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("spec"), F.col("l_partkey").alias("task"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_places")).where("n > 1")


@query("SELECT r_name AS parent, n_name AS child FROM region JOIN nation ON n_regionkey = r_regionkey")
def children_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))


@query("SELECT c_custkey, n_name AS parent, n_name IS NOT NULL AS has_parent FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_custkey % 7 <> 0")
def parent_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh customer declares no parent."""
    c = table(spark, sf_dir, "customer").withColumn("k", F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")))
    out = c.join(table(spark, sf_dir, "nation"), F.col("k") == F.col("n_nationkey"), "left")
    return out.select("c_custkey", F.col("n_name").alias("parent"), F.col("n_name").isNotNull().alias("has_parent"))


@query(f"WITH {_EDGES} SELECT dst, count(DISTINCT src) AS n_sources, min(src) AS first_source FROM edges GROUP BY dst")
def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.backlinks(part_edges(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT DISTINCT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = a.src AND e.dst = b.dst)")
def second_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.second_hop(part_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {_EDGES}, w USING KEY (id) AS (SELECT 7::BIGINT AS id, 0 AS hops UNION
SELECT e.src, min(w.hops) + 1 FROM w JOIN edges e ON e.dst = w.id WHERE e.src NOT IN (SELECT id FROM recurring.w) GROUP BY e.src) SELECT id, hops FROM w WHERE hops > 0""")
def impact_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = spark.range(7, 8).select("id")
    return graph.affected(part_edges(spark, sf_dir), changed)


@query("""SELECT doc_id, relation, w + t AS score FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'depends_on' WHEN 1 THEN 'wikilink' WHEN 2 THEN 'backlink' ELSE 'mention' END AS relation,
 CASE doc_id % 4 WHEN 0 THEN 90 WHEN 1 THEN 80 WHEN 2 THEN 65 ELSE 45 END AS w, least(40, floor(length(text) / 100.0 * 10))::INTEGER AS t FROM documents WHERE text IS NOT NULL)""")
def rank_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    rel = F.when(k == 0, "depends_on").when(k == 1, "wikilink").when(k == 2, "backlink").otherwise("mention")
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", rel.alias("relation"), (-F.length("text") / 100.0).alias("rank"))
    return docs.select("doc_id", "relation", (context.relation_weight(F.col("relation")) + context.text_bonus(F.col("rank"))).alias("score"))


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) AS position, (length(coalesce(text, '')) + 3) // 4 AS tokens, turn = 0 AS must FROM conversations),
 w AS (SELECT conv_id, position, turn, tokens AS used, must OR tokens <= 200 AS kept, CASE WHEN must OR tokens <= 200 THEN tokens ELSE 0 END AS total FROM c WHERE position = 1
 UNION ALL SELECT c.conv_id, c.position, c.turn, c.tokens, c.must OR w.total + c.tokens <= 200, CASE WHEN c.must OR w.total + c.tokens <= 200 THEN w.total + c.tokens ELSE w.total END FROM w JOIN c ON c.conv_id = w.conv_id AND c.position = w.position + 1)
SELECT conv_id, position, kept FROM w""")
def budget_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation within 200 tokens; the first is mandatory."""
    t = table(spark, sf_dir, "conversations")
    t = t.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", F.coalesce("text", F.lit("")))).cast("long"))
    return context.budget(t, 200, ["conv_id"], F.col("position"), S.token_estimate(F.col("text")), F.col("turn") == 0)


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 5 = 1 THEN 'removed' WHEN doc_id % 5 = 2 THEN 'modified' ELSE 'reused' END AS change FROM documents WHERE text IS NOT NULL""")
def pack_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of the documents: some only in one, some changed."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", S.fingerprint(F.col("text")).alias("fingerprint"), "text")
    base = docs.where("doc_id % 5 <> 0").select("doc_id", "fingerprint")
    new = docs.where("doc_id % 5 <> 1").select("doc_id", F.when(F.col("doc_id") % 5 == 2, S.fingerprint(F.concat("text", F.lit("!")))).otherwise(F.col("fingerprint")).alias("fingerprint"))
    return context.pack_diff(base, new, ["doc_id"])


@query("""SELECT l_orderkey, 'sha256:' || sha256(string_agg(l_linenumber || '=' || sha256(l_partkey || ':' || l_suppkey), chr(31) ORDER BY l_linenumber, sha256(l_partkey || ':' || l_suppkey))) AS pack_id, count(*) AS n FROM lineitem GROUP BY l_orderkey""")
def pack_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack of each order's lines, named by what it holds; an order has a few lines, so a pack is small."""
    mark = F.sha2(F.concat(F.col("l_partkey").cast("string"), F.lit(":"), F.col("l_suppkey").cast("string")), 256)
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", mark.alias("mark")).alias("item"))
    packs = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("item")).alias("items"), F.count("*").alias("n"))
    parts = F.transform("items", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit("="), x["mark"]))
    return packs.select("l_orderkey", S.fingerprint(F.array_join(parts, "\x1f")).alias("pack_id"), "n")


@query("""SELECT CASE WHEN doc_id % 5 = 0 THEN 'indexed' WHEN doc_id % 5 = 1 THEN 'removed' WHEN doc_id % 5 = 2 THEN 'updated' ELSE 'skipped' END AS action, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def sync_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"added": "indexed", "removed": "removed", "modified": "updated", "reused": "skipped"}
    action = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("change"))
    return pack_diff(spark, sf_dir).groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def coverage_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements (customers) that no finished task (order) serves."""
    served = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return graph.unresolved(table(spark, sf_dir, "customer").select("c_custkey"), served, "c_custkey")


@query("SELECT o_orderkey, o_custkey * 2 AS ref FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)")
def coverage_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("ref"))
    return graph.unresolved(refs, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ref")), "ref").select("o_orderkey", "ref")


@query("""SELECT c_custkey, count(*) FILTER (o_orderstatus <> 'F') AS open_tasks, count(*) AS tasks FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) FILTER (o_orderstatus <> 'F') > 0""")
def phase_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.when(F.col("o_orderstatus") != "F", 1)).alias("open_tasks"), F.count("*").alias("tasks"))
    return o.where("open_tasks > 0").join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "left_semi")


@query("SELECT o_orderkey, o_orderpriority AS status FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'P'")
def invalid_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame([("P", "1-URGENT"), ("P", "2-HIGH")], "kind string, status string")
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("status"))
    return rows.join(F.broadcast(allowed), ["kind", "status"], "left_anti").select("o_orderkey", "status")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'unverified' WHEN 2 THEN 'stale' ELSE 'verified' END AS state FROM events""")
def evidence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task body for each event, with evidence lines; verified only where the fingerprint is the body's."""
    k, text = F.col("event_id") % 4, F.concat(F.lit("- [x] "), F.col("event_type"), F.lit(" "), F.col("event_id").cast("string"))
    result = F.when(k == 0, "fail").when(k == 1, "none").otherwise("pass")
    mark = F.when(k == 2, F.lit("sha256:0")).otherwise(S.fingerprint(text))
    body = F.concat(text, F.lit("\nEvidence-Result: "), result, F.lit("\nEvidence-Fingerprint: "), mark)
    return table(spark, sf_dir, "events").select("event_id", S.evidence_state(body).alias("state"))


_READY = """d AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dep FROM orders), r AS (SELECT o_custkey, o_orderkey FROM d WHERE o_orderstatus <> 'F' AND coalesce(dep, 'F') = 'F')"""


def _ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    dep = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", dep.alias("dep"))
    return rows.where("o_orderstatus <> 'F' and coalesce(dep, 'F') = 'F'").select("o_custkey", "o_orderkey")


@query(f"WITH {_READY} SELECT o_custkey, o_orderkey FROM r")
def ready_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open tasks whose dependency, the task before them, is complete."""
    return _ready(spark, sf_dir)


@query(f"WITH {_READY} SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM r GROUP BY o_custkey")
def next_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ready(spark, sf_dir).groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM (SELECT doc_id, trim(text) AS t FROM documents WHERE doc_id % 6 <> 0) a FULL JOIN (SELECT doc_id, trim(CASE WHEN doc_id % 6 = 2 THEN text || ' x' ELSE text || '  ' END) AS t FROM documents WHERE doc_id % 6 <> 1) b ON a.doc_id = b.doc_id
WHERE a.t IS DISTINCT FROM b.t""")
def changed_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    a = docs.where("doc_id % 6 <> 0").select("doc_id", F.trim("text").alias("fingerprint"))
    b = docs.where("doc_id % 6 <> 1").select("doc_id", F.trim(F.when(F.col("doc_id") % 6 == 2, F.concat("text", F.lit(" x"))).otherwise(F.concat("text", F.lit("  ")))).alias("fingerprint"))
    return context.pack_diff(a, b, ["doc_id"]).where("change <> 'reused'")


_TASKS = """t AS (SELECT 'specs/SPEC-' || l_orderkey || '/tasks.md' AS path, l_linenumber AS number, l_linestatus = 'F' AS checked,
 CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'N' THEN 'verified' ELSE 'stale' END AS state,
 CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN 'complete' ELSE 'pending' END AS status, printf('SPEC-%03d:R%d', l_partkey % 999 + 1, l_linenumber) AS serves, l_suppkey % 4 = 0 AS bad FROM lineitem)"""


@query(f"WITH {_TASKS} SELECT path, number, checked, state, status, serves, CASE WHEN bad THEN 'R9' ELSE '' END AS bad_serves, CASE WHEN number > 1 THEN number - 1 END AS depends_on, 'line ' || number AS scope FROM t")
def task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tasks.rows(task_files(spark, sf_dir))
    return out.select("path", "number", "checked", "state", "status", F.array_join("serves", ",").alias("serves"), F.array_join("bad_serves", ",").alias("bad_serves"), F.try_element_at("depends_on", F.lit(1)).alias("depends_on"), "scope")


@query(f"""WITH {_TASKS}, o AS (SELECT DISTINCT path, number FROM t WHERE status <> 'complete')
SELECT path, number, CAST(number > 1 AND NOT EXISTS (SELECT 1 FROM t WHERE t.path = o.path AND t.number = o.number - 1 AND t.status = 'complete') AS BIGINT) AS blockers FROM o""")
def task_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.readiness(tasks.rows(task_files(spark, sf_dir)))


@query(f"""WITH {_TASKS}
SELECT 'duplicate_id' AS code, path, printf('TASK-%03d is declared %d times', number, count(*)) AS message FROM t GROUP BY path, number HAVING count(*) > 1
UNION ALL SELECT 'malformed_reference', path, printf('TASK-%03d refers to R9', number) FROM t WHERE bad
UNION ALL SELECT DISTINCT 'invalid_task_dependency', path, printf('TASK-%03d depends on TASK-%03d', number, number - 1) FROM t WHERE number > 1 AND NOT EXISTS (SELECT 1 FROM t u WHERE u.path = t.path AND u.number = t.number - 1)""")
def task_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.findings(tasks.rows(task_files(spark, sf_dir)))


@query(f"""WITH {_EDGES}, r AS (SELECT 'src/m' || src % 9 || '/p' || src || '.go' AS path, src % 9 AS m, dst % 7 AS k FROM edges),
 v AS (SELECT 0 AS rule, path FROM r WHERE m = 3 AND k = 2 UNION ALL SELECT 2, path FROM r WHERE k = 5)
SELECT rule, CASE WHEN rule = 3 THEN 'not_evaluated' WHEN n > 0 THEN 'fail' ELSE 'pass' END AS status, n AS violations, first_path
FROM (SELECT q.rule, count(path) AS n, min(path) AS first_path FROM (VALUES (0), (1), (2), (3)) q(rule) LEFT JOIN v ON v.rule = q.rule GROUP BY q.rule)""")
def architecture_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rules: one that some references break, one that none can, one for all files, one of another kind."""
    rule = architecture.Rule
    rules = [rule("forbidden_dependency", "src/m3/*.go", "lib/k2/**"), rule("forbidden_dependency", "src/m??/**", "lib/**"), rule("forbidden_dependency", "**", "lib/k5/*"), rule("required_contract", "src/**", "lib/**")]
    return architecture.check(part_references(spark, sf_dir), rules)


@query("""SELECT a.doc_id, CASE WHEN a.toxic > b.toxic THEN 'regressed' ELSE 'improved' END AS direction FROM labels a JOIN (SELECT doc_id, (toxic + doc_id % 2) % 2 AS toxic FROM labels) b USING (doc_id) WHERE a.toxic <> b.toxic""")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the same cases in two runs; the second flips every odd one."""
    a = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("was"))
    b = table(spark, sf_dir, "labels").select("doc_id", ((F.col("toxic") + F.col("doc_id") % 2) % 2).alias("now"))
    return a.join(b, "doc_id").where("was <> now").select("doc_id", F.when(F.col("was") > F.col("now"), "regressed").otherwise("improved").alias("direction"))


@query("SELECT user_id, count(DISTINCT event_type) AS outcomes FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def run_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("outcomes")).where("outcomes > 1")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS kind, max(o_orderkey) + 1 AS next_id FROM orders GROUP BY 1")
def next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("kind")).agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next_id"))


_SPECS = """c AS (SELECT c_custkey + 1 AS k FROM customer), s AS (SELECT k, printf('specs/SPEC-%03d/spec.md', k) AS path, CASE WHEN k % 17 = 0 THEN 'frontmatter_malformed' WHEN k % 19 = 0 THEN 'required_field_missing' END AS error FROM c),
 g AS (SELECT * FROM s WHERE error IS NULL), p AS (SELECT s_suppkey + 1 AS k FROM supplier), f AS (SELECT k, printf('%s/FEAT-%03d/feature.md', place, k) AS path FROM p, (VALUES ('a'), ('b')) x(place) WHERE place = 'a' OR k % 4 = 0)"""


@query(f"""WITH {_SPECS} SELECT path, error, CASE WHEN k % 17 <> 0 AND k % 19 <> 0 THEN CASE WHEN k % 11 = 0 THEN k + 1 ELSE k END END AS number, CASE WHEN k % 17 <> 0 THEN CASE WHEN k % 7 = 0 THEN 'open' ELSE 'draft' END ELSE '' END AS status,
 CASE WHEN k % 17 <> 0 THEN 9 - CAST(k % 19 = 0 AS INT) - CAST(k % 5 = 0 AND k % 13 <> 0 AS INT) + 1 END AS body_line FROM s UNION ALL SELECT path, NULL, k, 'active', 7 FROM f""")
def artifact_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = artifacts.metadata(spec_files(spark, sf_dir))
    return meta.select("path", "error", F.col("id.number").cast("long").alias("number"), F.coalesce("status", F.lit("")).alias("status"), F.col("body_line").cast("long").alias("body_line"))


@query(f"""WITH {_SPECS}, q AS (SELECT *, k % 13 = 0 OR k % 5 <> 0 AS has FROM g)
SELECT path, 0 AS ord, 'parent' AS relation, CASE WHEN k % 13 = 0 THEN 'program' ELSE 'feature' END AS kind, CASE WHEN k % 13 = 0 THEN 1 ELSE k % 12 + 1 END AS number FROM q WHERE has
UNION ALL SELECT path, CAST(has AS INT), 'depends_on', 'spec', k + 1 FROM q UNION ALL SELECT path, CAST(has AS INT) + 1, 'supersedes', 'spec', k * 2 FROM q UNION ALL SELECT path, 0, 'parent', 'program', 1 FROM f""")
def formal_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = artifacts.formal_edges(artifacts.metadata(spec_files(spark, sf_dir)))
    return edges.select("path", F.col("ord").cast("long").alias("ord"), "relation", F.col("target.type").alias("kind"), F.col("target.number").cast("long").alias("number"))


@query(f"""WITH {_SPECS}, e AS (SELECT k, count(*) AS n, string_agg(path, ' ' ORDER BY path) AS paths FROM f GROUP BY k), a AS (SELECT k FROM s WHERE k % 17 <> 0), x AS (
 SELECT error AS code, path, CASE WHEN error = 'required_field_missing' THEN 'field "id" is required for type "spec"' ELSE 'front matter can''t be read' END AS message FROM s WHERE error IS NOT NULL
 UNION ALL SELECT 'id_location_mismatch', path, printf('declared id SPEC-%03d does not match canonical location SPEC-%03d', k + 1, k) FROM g WHERE k % 11 = 0
 UNION ALL SELECT 'invalid_status', path, 'status "open" is not one of the allowed states for spec: [draft ready in_progress validated blocked superseded cancelled]' FROM g WHERE k % 7 = 0
 UNION ALL SELECT 'invalid_parent_type', path, 'parent PRG-001 is a program, want a feature' FROM g WHERE k % 13 = 0
 UNION ALL SELECT 'missing_parent', path, 'no parent declared; a feature parent is required' FROM g WHERE k % 13 <> 0 AND k % 5 = 0
 UNION ALL SELECT 'missing_parent', path, printf('declared parent FEAT-%03d does not exist', k % 12 + 1) FROM g WHERE k % 13 <> 0 AND k % 5 <> 0 AND k % 12 + 1 NOT IN (SELECT k FROM e)
 UNION ALL SELECT 'missing_parent', path, 'declared parent PRG-001 does not exist' FROM f
 UNION ALL SELECT 'unresolved_dependency', path, printf('depends_on entry SPEC-%03d does not resolve to an existing Spec', k + 1) FROM g WHERE k + 1 NOT IN (SELECT k FROM s)
 UNION ALL SELECT 'unresolved_dependency', path, printf('supersedes entry SPEC-%03d does not resolve to an existing Spec', k * 2) FROM g WHERE k * 2 NOT IN (SELECT k FROM s)
 UNION ALL SELECT 'invalid_wikilink', path, 'wikilink target "bad" is not a well-formed entity ID' FROM g WHERE k % 6 = 0
 UNION ALL SELECT 'broken_wikilink', path, printf('wikilink target SPEC-%03d does not exist', k * 3) FROM g WHERE k * 3 NOT IN (SELECT k FROM s)
 UNION ALL SELECT 'broken_wikilink', path, printf('wikilink target FEAT-%03d does not exist', k % 12 + 1) FROM g WHERE k % 12 + 1 NOT IN (SELECT k FROM e)
 UNION ALL SELECT 'ambiguous_wikilink', g.path, printf('wikilink target FEAT-%03d resolves to %d artifacts: [%s]', e.k, n, paths) FROM g JOIN e ON e.k = g.k % 12 + 1 WHERE n > 1
 UNION ALL SELECT 'unknown_anchor', g.path, printf('wikilink target FEAT-%03d exists but declares no anchor "top"', e.k) FROM g JOIN e ON e.k = g.k % 12 + 1 WHERE n = 1
 UNION ALL SELECT 'duplicate_anchor', path, 'anchor "top" is declared by more than one Section' FROM g WHERE k % 6 = 0)
SELECT code, 'error' AS severity, path, message FROM x""")
def artifact_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.findings(spec_files(spark, sf_dir))


#: A depth-first walk in SQL, a move of each group's walk a round.  ``graph(g, nodes, adj)`` has for each group its nodes in order and, for each
#: node, the places of its targets in order, repeats included (0: a target that is no node).  A node is unseen (0), on the stack (1) or done (2).
_WALK = """graph2 AS (SELECT g, nodes, adj, len(nodes) AS n FROM graph),
 walk AS (
  SELECT g, 0 AS i, list_transform(nodes, lambda x: 0) AS colour, []::INT[] AS stack, list_transform(nodes, lambda x: 1) AS pos, NULL::INT[] AS cycle, 0 AS root FROM graph2
  UNION ALL
  SELECT g, i + 1,
   CASE WHEN move = 'pop' THEN list_transform(colour, lambda x, j: CASE WHEN j = top THEN 2 ELSE x END) WHEN go > 0 THEN list_transform(colour, lambda x, j: CASE WHEN j = go THEN 1 ELSE x END) ELSE colour END,
   CASE WHEN move = 'pop' THEN stack[:len(stack) - 1] WHEN go > 0 THEN list_append(stack, go) ELSE stack END,
   CASE WHEN move = 'step' THEN list_transform(pos, lambda x, j: CASE WHEN j = top THEN x + 1 ELSE x END) ELSE pos END,
   CASE WHEN move = 'step' AND nxt > 0 AND colour[nxt] = 1 THEN list_append(stack[list_position(stack, nxt):], nxt) END,
   CASE WHEN move = 'start' THEN go ELSE root END
  FROM (SELECT *, CASE WHEN move = 'start' THEN list_position(colour, 0) WHEN move = 'step' AND nxt > 0 AND colour[nxt] = 0 THEN nxt ELSE 0 END::INT AS go FROM (
   SELECT *, CASE WHEN len(stack) = 0 THEN 'start' WHEN pos[top] > len(adj[top]) THEN 'pop' ELSE 'step' END AS move, CASE WHEN len(stack) > 0 THEN adj[top][pos[top]] END AS nxt FROM (
    SELECT w.*, x.adj, CASE WHEN len(w.stack) > 0 THEN w.stack[-1] END AS top FROM walk w JOIN graph2 x ON x.g = w.g WHERE len(w.stack) > 0 OR list_contains(w.colour, 0))))),
 found AS (SELECT w.g, x.nodes[w.root] AS root, i, list_transform(w.cycle, lambda j: x.nodes[j]) AS path FROM walk w JOIN graph2 x ON x.g = w.g WHERE w.cycle IS NOT NULL)"""


@query(f"""WITH RECURSIVE s AS (SELECT c_custkey AS k, c_custkey // 80 AS g, (c_custkey // 80) * 80 + (c_custkey + 1 + c_nationkey % 3) % 80 AS one, (c_custkey // 80) * 80 + floor(abs(c_acctbal))::BIGINT % 80 AS two FROM customer WHERE c_custkey > 0),
 e AS (SELECT g, k AS src, unnest(CASE WHEN k % 10 = 0 THEN [k, one, one] ELSE [one, two] END) AS dst FROM s WHERE k % 9 <> 0),
 ns AS (SELECT g, list(k ORDER BY k) AS nodes FROM s GROUP BY g),
 adj1 AS (SELECT s.g, s.k, list_sort(list(list_position(nodes, e.dst)) FILTER (e.dst IS NOT NULL AND list_contains(nodes, e.dst))) AS a FROM s JOIN ns ON ns.g = s.g LEFT JOIN e ON e.src = s.k GROUP BY s.g, s.k),
 graph AS (SELECT ns.g, nodes, list(coalesce(a, []) ORDER BY k) AS adj FROM ns JOIN adj1 ON adj1.g = ns.g GROUP BY ns.g, nodes), {_WALK}
SELECT 'dependency_cycle' AS code, 'error' AS severity, printf('specs/SPEC-%03d/spec.md', path[1]) AS path, 'dependency cycle: ' || array_to_string(list_transform(path, lambda x: printf('SPEC-%03d', x)), ' -> ') AS message FROM found""")
def dependency_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = linked_specs(spark, sf_dir)
    return cycles.spec_cycles(artifacts.metadata(files), artifacts.entities(files))


@query(f"""WITH RECURSIVE t AS (SELECT l_orderkey AS g, l_linenumber AS k, l_partkey % 8 + 1 AS one, CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey % 7 + 1 END AS two FROM lineitem),
 e AS (SELECT g, k AS src, one AS dst FROM t UNION ALL SELECT g, k, two FROM t WHERE two IS NOT NULL),
 ns AS (SELECT g, list(DISTINCT k ORDER BY k) AS nodes FROM t GROUP BY g),
 adj1 AS (SELECT ns.g, e.src AS k, list_sort(list(list_position(nodes, e.dst)) FILTER (list_contains(nodes, e.dst))) AS a FROM ns JOIN e ON e.g = ns.g GROUP BY ns.g, e.src),
 graph AS (SELECT ns.g, nodes, list(coalesce(a, []) ORDER BY k) AS adj FROM ns JOIN adj1 ON adj1.g = ns.g GROUP BY ns.g, nodes), {_WALK}
SELECT 'task_dependency_cycle' AS code, 'error' AS severity, printf('specs/SPEC-%d/tasks.md#TASK-%03d', g, path[1]) AS path,
 'task dependency cycle: ' || array_to_string(list_transform(path, lambda x: printf('SPEC-%d:TASK-%03d', g, x)), ' -> ') AS message FROM found
UNION ALL SELECT 'invalid_task_dependency', 'error', printf('specs/SPEC-%d/tasks.md#TASK-%03d', g, src), printf('SPEC-%d:TASK-%03d depends on SPEC-%d:TASK-%03d, which does not exist', g, src, g, dst) FROM e WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.g = e.g AND t.k = e.dst)""")
def task_dependency_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.dependency_findings(tasks.rows(linked_tasks(spark, sf_dir)))


_IMPACT = f"""{_EDGES}, b AS (SELECT dst AS f, src AS t, rel, CASE WHEN rel = 'wikilink' THEN 1000000000000 ELSE 0 END + src AS o FROM (SELECT src, dst, CASE (src + dst) % 4 WHEN 0 THEN 'parent' WHEN 1 THEN 'depends_on' WHEN 2 THEN 'supersedes' ELSE 'wikilink' END AS rel FROM edges)),
 ch AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 97 = 0), rq AS (SELECT p_partkey AS id, p_size % 4 + 1 AS r FROM part WHERE p_partkey <= 999),
 w USING KEY (id) AS (SELECT id, [id] AS key, '' AS route FROM ch UNION
  SELECT b.t, min(list_append(w.key, b.o)), arg_min(w.route || '>' || rel || ':' || b.t, list_append(w.key, b.o)) FROM w JOIN b ON b.f = w.id WHERE b.t NOT IN (SELECT id FROM recurring.w) GROUP BY b.t),
 p AS (SELECT b.t AS id, [len(w.key)] || list_append(w.key, b.o) AS seq, w.route || '>' || rel || ':' || b.t AS route, rel, b.f FROM w JOIN b ON b.f = w.id WHERE b.t NOT IN (SELECT id FROM ch)),
 i AS (SELECT id, count(*) AS n_paths, arg_min(route, seq) AS route, arg_min(rel, seq) AS rel, arg_min(f, seq) AS f, sum(len(string_split(route, '>')) - 1)::BIGINT AS hops FROM p GROUP BY id),
 tk AS (SELECT l_orderkey AS id, l_linenumber AS r, count(*) AS n_paths, min(CASE l_returnflag WHEN 'R' THEN '0failed' WHEN 'N' THEN '2verified' ELSE '1stale' END) AS s FROM lineitem JOIN rq ON rq.id = l_orderkey AND rq.r = l_linenumber WHERE l_partkey % 999 + 1 = l_orderkey GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {_IMPACT}
SELECT printf('SPEC-%03d', id) AS id, 'parts/' || id || '.md' AS path, CASE WHEN rel = 'wikilink' THEN 'suggested_review' ELSE 'deterministic_invalidation' END AS classification, CASE WHEN rel = 'wikilink' THEN 'low' ELSE 'high' END AS severity,
 CASE WHEN rel = 'wikilink' THEN printf('SPEC-%03d references SPEC-%03d (from parts/%d.md), which changed between v1 and v2', id, f, id) ELSE printf('SPEC-%03d %s SPEC-%03d, which changed between v1 and v2', id, rel, f) END AS reason, NULL AS reverify, n_paths, route, hops FROM i
UNION ALL SELECT printf('SPEC-%03d:TASK-%03d', id, r), printf('specs/SPEC-%d/tasks.md#TASK-%03d', id, r), 'deterministic_invalidation', CASE WHEN s = '2verified' THEN 'medium' ELSE 'high' END,
 printf('TASK-%03d serves SPEC-%03d:R%d, whose content changed between v1 and v2', r, id, r) || CASE WHEN s = '2verified' THEN '' ELSE '; its own recorded evidence is already ' || s[2:] || ' against its current content' END, printf('SPEC-%03d:TASK-%03d', id, r), n_paths, '>' || CASE WHEN s = '2verified' THEN 'coverage:' ELSE 'evidence:' END || printf('%d:TASK-%03d', id, r), n_paths FROM tk
UNION ALL SELECT printf('SPEC-%03d', id), NULL, 'no_known_relation', NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT id FROM ch UNION SELECT id FROM rq) x WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.id = x.id) AND NOT (x.id IN (SELECT id FROM ch) AND EXISTS (SELECT 1 FROM b WHERE b.f = x.id))""")
def impact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 97th part changed as a whole and one requirement of each of the first 999: what that reaches over references and tasks."""
    name = lambda c: F.format_string("SPEC-%03d", F.col(c).cast("long"))
    e, kind = part_edges(spark, sf_dir), (F.col("src") + F.col("dst")) % 4
    relation = F.when(kind == 0, "parent").when(kind == 1, "depends_on").when(kind == 2, "supersedes").otherwise("wikilink")
    refs = e.select(name("src").alias("source_id"), name("dst").alias("target_id"), relation.alias("relation"), F.concat(F.lit("parts/"), F.col("src").cast("string"), F.lit(".md")).alias("source_path"), F.col("src").alias("source_rank"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size")
    whole = parts.where("k % 97 = 0").select(name("k").alias("id"), F.lit(None).cast("int").alias("requirement"), F.lit("").alias("spec_dir"), F.col("k").alias("ord"))
    some = parts.where("k <= 999").select(name("k"), (F.col("p_size") % 4 + 1).cast("int"), F.concat(F.lit("specs/SPEC-"), F.col("k").cast("string")), F.col("k"))
    changed = whole.union(some)
    out = impact.analyze(changed, refs, tasks.rows(impact.served_files(changed, task_files(spark, sf_dir))), "v1", "v2")
    number = lambda x: F.regexp_replace(x, r"\ASPEC-0*", "")
    route = F.aggregate(F.element_at("paths", 1), F.lit(""), lambda s, h: F.concat(s, F.lit(">"), h["relation"], F.lit(":"), number(h["to_id"])))
    return out.select("id", "path", "classification", "severity", "reason", "reverify", F.col("n_paths").cast("long").alias("n_paths"), route.alias("route"), F.aggregate("paths", F.lit(0).cast("long"), lambda s, p: s + F.size(p)).alias("hops"))


_TERMS = r"""tk AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(source, '') || ' ' || coalesce(lang, ''))), '[\p{L}\p{N}]+') AS hs, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+') AS ts FROM documents),
 z AS (SELECT doc_id, len(hs) AS nh, len(hs) + len(ts) AS dl, hs || [chr(1)] || ts AS z FROM tk),"""


def _bm25_sql(rows: str, phrases: int, holds: str) -> str:
    """Rank from ``f0..`` and ``h0..`` of ``rows``, the places of each phrase and whether a row has it."""
    part = lambda k: f"greatest(ln((n - d{k} + 0.5) / (d{k} + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / mean))"
    counts = ", ".join(f"count(*) FILTER (h{k}) AS d{k}" for k in range(phrases))
    return f""" s AS (SELECT count(*) AS n, avg(dl) AS mean, {counts} FROM {rows})
SELECT doc_id, row_number() OVER (ORDER BY rank, doc_id) AS position, round(rank, 6) AS rank FROM (SELECT doc_id, -({" + ".join(map(part, range(phrases)))}) AS rank FROM {rows}, s WHERE {holds}) QUALIFY position <= 100"""


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit(" "), F.coalesce("lang", F.lit(""))).alias("heading"), F.col("text").alias("content"))


def _searched(spark: SparkSession, sf_dir: str, node) -> DataFrame:
    hits = fulltext.search(fulltext.index(_headed(spark, sf_dir), "doc_id"), node)
    return context.ranked(hits, F.col("rank"), F.col("id")).select(F.col("id").alias("doc_id"), "position", F.round("rank", 6).alias("rank"))


@query(f"""WITH {_TERMS} r AS (SELECT doc_id, dl, len(list_filter(range(1, len(z) + 1), lambda i: z[i] = 'de' AND z[i + 1] = 'la')) AS f0, len(list_filter(z, lambda x: x = 'que')) AS f1, len(list_filter(z, lambda x: x = 'ere')) AS f2, f0 > 0 AS h0, f1 > 0 AS h1, f2 > 0 AS h2 FROM z), {_bm25_sql("r", 3, "h0 AND h1 AND h2")}""")
def fts_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A free text with a hyphen, an accent, operators' characters and a word without terms."""
    return _searched(spark, sf_dir, fulltext.free('DE-la ("que ÉRE* --- '))


@query(f"""WITH {_TERMS} i AS (SELECT doc_id, dl, z, nh, list_filter(range(1, len(z) + 1), lambda i: z[i] = 'the' AND z[i + 1] = 'of' AND z[i + 2] = 'and') AS p0,
  list_filter(range(1, len(z) + 1), lambda i: z[i] = 'de' AND z[i + 1] = 'la') AS p1, list_filter(range(1, len(z) + 1), lambda i: z[i] = 'que') AS p2, list_filter(range(nh + 2, len(z) + 1), lambda i: starts_with(z[i], 'enre')) AS p3, list_filter([1, nh + 2], lambda i: z[i] = 'src7') AS p4,
  list_contains(z[:nh], 'de') OR len(list_filter(range(1, len(z) + 1), lambda i: z[i] = 'und' AND z[i + 1] = 'der')) > 0 AS no FROM z),
 e AS (SELECT *, list_filter(list_distinct(p1 || p2), lambda m: len(list_filter(p1, lambda y: y <= m AND m <= y + 8)) > 0 AND len(list_filter(p2, lambda y: y <= m AND m <= y + 7)) > 0) AS ends FROM i),
 r AS (SELECT doc_id, dl, no, len(p0) AS f0, len(list_filter(p1, lambda y: len(list_filter(ends, lambda m: y <= m AND m <= y + 8)) > 0)) AS f1, len(list_filter(p2, lambda y: len(list_filter(ends, lambda m: y <= m AND m <= y + 7)) > 0)) AS f2, len(p3) AS f3, len(p4) AS f4,
  len(p0) > 0 AS h0, len(p1) > 0 AS h1, len(p2) > 0 AS h2, len(p3) > 0 AS h3, len(p4) > 0 AS h4 FROM e), {_bm25_sql("r", 5, "NOT no AND (f0 > 0 OR (f1 > 0 AND f2 > 0) OR f3 > 0 OR f4 > 0)")}""")
def fts_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, a prefix in one column, a first word, nearness and exclusion in one expression."""
    return _searched(spark, sf_dir, fulltext.advanced('("the of" + and OR NEAR("de la" que, 6) OR content : enré* OR ^src7) NOT (heading : de OR "und der")'))


_CONTEXT = """c AS (SELECT c_custkey AS k, c_name, c_nationkey, c_mktsegment AS seg, floor(abs(c_acctbal))::BIGINT AS bal FROM customer), q AS (SELECT k FROM c WHERE k % 50 = 0),
 sec AS (SELECT k, 1 AS o, 1 AS s, 2 AS e, 'Spec ' || k AS heading, '' AS anchor, 'about ' || seg AS body, NULL::VARCHAR AS u1, '' AS up FROM c
  UNION ALL SELECT k, 2, 3, 6, 'Requirements', 'req', 'R1 ' || c_name || chr(10) || chr(10) || 'R2 nation ' || c_nationkey || ' ' || seg, 'R1 ' || c_name || chr(10) || chr(10), 'Spec ' || k FROM c
  UNION ALL SELECT k, 3, 7, 7, 'Empty', 'none', '', NULL, 'Spec ' || k FROM c UNION ALL SELECT k, 4, 8, 9, 'Deep', 'deep', 'deep ' || bal, NULL, 'Spec ' || k || '/Empty' FROM c),
 ref AS (SELECT k AS src, (k * 3 + 1) % 100 AS dst, 'parent' AS rel, 0 AS link, 0 AS o, '' AS ss, 0 AS sl, '' AS ta FROM c UNION ALL SELECT k, (k * 7 + 2) % 100, 'depends_on', 0, 1, '', 0, '' FROM c
  UNION ALL SELECT k, (k * 11 + 3) % 100, 'wikilink', 1, 2, CASE WHEN k % 2 = 0 THEN 'Requirements' ELSE 'Notes' END, 6, ['', 'deep', 'none', 'missing'][k % 4 + 1] FROM c),
 one AS (SELECT q.k AS request, dst AS id, [2 + link, src, o] AS seq, 1 + link AS tier, rel, src AS sp, ss, sl, ta FROM q JOIN ref ON src = q.k UNION ALL SELECT q.k, src, [4 + link, src, o], 2, 'backlink', src, ss, sl, ta FROM q JOIN ref ON dst = q.k),
 named AS (SELECT * FROM one UNION ALL SELECT f.request, r.dst, [6] || f.seq || [r.link, r.src, r.o], 4, r.rel, r.src, r.ss, r.sl, r.ta FROM one f JOIN ref r ON r.src = f.id),
 base AS (SELECT * FROM named WHERE NOT (rel = 'wikilink' AND ta <> '') UNION ALL SELECT k, k, [1], 0, 'target', NULL, '', 0, '' FROM q UNION ALL SELECT k, 99, [0], 0, 'constitution', NULL, '', 0, '' FROM q),
 cand AS (SELECT request, id AS k, x.o, x.s, x.e, seq || [x.o] AS seq, tier, rel, sp, ss, sl, ta, 0.0 AS rank, NULL AS up FROM base JOIN sec x ON x.k = id AND body <> ''
  UNION ALL SELECT request, id, x.o, x.s, x.e, seq || [0], tier, rel, sp, ss, sl, ta, 0.0, up FROM named JOIN sec x ON x.k = id AND x.anchor = ta WHERE rel = 'wikilink' AND ta <> ''
  UNION ALL SELECT q.k, (q.k + 17) % 100, 4, 8, 9, [7], 3, 'text_match', NULL, '', 0, '', -(q.k % 7) / 2.0, NULL FROM q),
 rs AS (SELECT request, k, o, s, e, tier, rel, sp, ss, sl, ta, seq, bool_or(tier <> 4) OVER (PARTITION BY request, k, s, e) AS direct FROM (SELECT request, k, o, s, e, tier, rel, sp, ss, sl, ta, min(seq) AS seq FROM cand GROUP BY ALL)),
 m AS (SELECT request, k, o, s, e, min(tier) AS tier, string_agg(tier || ':' || rel || ':' || coalesce(sp::VARCHAR, '') || ':' || ss || ':' || sl || ':' || ta, ';' ORDER BY seq) AS reasons, max(CASE rel WHEN 'constitution' THEN 100 WHEN 'target' THEN 100 WHEN 'wikilink' THEN 80 WHEN 'backlink' THEN 65 WHEN 'text_match' THEN 0 ELSE 90 END) AS w,
   bool_or(rel IN ('backlink', 'text_match')) AS liked, bool_or(rel = 'text_match') AS found, bool_or(ss = 'Requirements') AS req FROM rs WHERE tier <> 4 OR NOT direct GROUP BY request, k, o, s, e),
 ex AS (SELECT request, k, s, e, max_by(rank, seq) FILTER (rel = 'text_match') AS rank, min_by(up, seq) FILTER (up IS NOT NULL) AS up FROM cand GROUP BY ALL),
 sc AS (SELECT m.*, ex.up, x.body, x.u1, w + CASE WHEN liked THEN 5 ELSE 0 END + CASE WHEN found THEN CASE WHEN rank >= 0 THEN 0 ELSE least(40, floor(-rank * 10))::INT END ELSE least(4, (length(t) - length(replace(t, 'furniture', ''))) // 9) * 10 END + CASE WHEN req THEN 15 ELSE 0 END AS score
   FROM m JOIN ex USING (request, k, s, e) JOIN (SELECT *, lower(heading || chr(10) || body) AS t FROM sec) x ON x.k = m.k AND x.o = m.o),
 rk AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY tier, score DESC, 'specs/' || k || '.md', s, e) AS position, (length(body) + 3) // 4 AS tokens, (length(u1) + 3) // 4 AS t1 FROM sc),
 walk AS (SELECT k AS request, 0::BIGINT AS position, 0::BIGINT AS total, 0::BIGINT AS used, 0 AS how FROM q UNION ALL
  SELECT r.request, r.position, w.total + CASE WHEN r.tier = 0 OR w.total + tokens <= 150 THEN tokens WHEN t1 <= 150 - w.total THEN t1 ELSE 0 END, CASE WHEN r.tier = 0 OR w.total + tokens <= 150 THEN tokens WHEN t1 <= 150 - w.total THEN t1 ELSE 0 END,
   CASE WHEN r.tier = 0 OR w.total + tokens <= 150 THEN 2 WHEN t1 <= 150 - w.total THEN 1 ELSE 0 END FROM walk w JOIN rk r ON r.request = w.request AND r.position = w.position + 1)"""


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth customer's spec as a target: candidates of all sources, ranked, within 150 tokens."""
    secs = saved(markdown.sections(headed_specs(spark, sf_dir)), "sections")
    k = table(spark, sf_dir, "customer").select("c_custkey")
    asked = k.where("c_custkey % 50 = 0").select(F.col("c_custkey").cast("string").alias("request"))
    hit = asked.select("request", F.concat(F.lit("specs/"), ((F.col("request").cast("long") + 17) % 100).cast("string"), F.lit(".md")).alias("path"), (-(F.col("request").cast("long") % 7) / 2.0).alias("rank"))
    hits = hit.join(secs.where("anchor = 'deep'"), "path").select("request", "path", "heading", F.col("body").alias("content"), "start_line", "end_line", "rank")
    files = k.select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("specs/"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"))
    found = candidates.collect(asked.withColumn("target", F.col("request")), customer_references(spark, sf_dir), files, secs, hits, "specs/99.md")
    rows = candidates.scored(saved(candidates.merge(found), "merged"), "validation", ["furniture"], prefer_section=True)
    return candidates.filled(candidates.ranked(rows), 150, 100)


@query(f"""WITH RECURSIVE {_CONTEXT}
SELECT r.request::VARCHAR AS request, r.position, 'specs/' || k || '.md' AS path, s AS start_line, tier, score, reasons, up AS heading_path, used, CASE how WHEN 2 THEN sha256(body) WHEN 1 THEN sha256(u1) END AS content_sha256,
 CASE WHEN how = 0 THEN CASE WHEN u1 IS NOT NULL THEN 'no_coherent_unit_fit' ELSE 'did_not_fit_remaining_budget' END END AS exclusion FROM rk r JOIN walk w ON w.request = r.request AND w.position = r.position""")
def context_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _context(spark, sf_dir)
    text = F.transform("reasons", lambda r: F.concat_ws(":", r["tier"].cast("string"), r["relation"], F.regexp_extract(r["source_path"], r"([0-9]+)\.md", 1), r["source_section"], r["source_line"].cast("string"), r["target_anchor"]))
    return out.select("request", F.col("position").cast("long").alias("position"), "path", "start_line", "tier", "score", F.array_join(text, ";").alias("reasons"), F.array_join("heading_path", "/").alias("heading_path"), "used", F.sha2("content_kept", 256).alias("content_sha256"), "exclusion")


@query(f"""WITH RECURSIVE {_CONTEXT}
SELECT r.request::VARCHAR AS request, count(*) AS candidates_considered, count(*) FILTER (how > 0) AS items_selected, sum(tokens)::BIGINT AS tokens_available, sum(used)::BIGINT AS tokens_selected, count(*) FILTER (how = 0) AS exclusions,
 round((sum(tokens) - sum(used)) / sum(tokens) * 100, 6) AS reduction_percent, greatest(sum(tokens) FILTER (tier = 0) - 100, 0)::BIGINT AS overage FROM rk r JOIN walk w ON w.request = r.request AND w.position = r.position GROUP BY 1""")
def context_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = candidates.diagnostics(_context(spark, sf_dir), 100)
    return out.select("request", "candidates_considered", "items_selected", "tokens_available", "tokens_selected", "exclusions", F.round("reduction_percent", 6).alias("reduction_percent"), "overage")


_SERVES = """sp AS (SELECT o_orderkey AS k, printf('SPEC-%06d', o_orderkey) AS spec, CASE o_orderstatus WHEN 'F' THEN 'draft' WHEN 'O' THEN 'ready' ELSE 'in_progress' END AS status FROM orders WHERE o_orderkey > 0),
 rq AS (SELECT k, spec, unnest(range(1, k % 4 + 2)) AS n FROM sp),
 t AS (SELECT l_orderkey AS k, printf('specs/SPEC-%06d/tasks.md#TASK-%06d', l_orderkey, l_linenumber) AS path, printf('TASK-%06d', l_linenumber) AS task, l_suppkey % 5 = 0 AS bare, CASE WHEN l_suppkey % 6 = 0 THEN l_orderkey + 1 ELSE l_orderkey END AS rk, l_partkey % 5 + 1 AS n, l_suppkey % 4 = 0 AS bad,
  l_linestatus = 'F' AS checked, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'unverified' ELSE CASE WHEN l_partkey % 2 = 0 THEN 'verified' ELSE 'stale' END END AS state FROM lineitem WHERE l_orderkey IN (SELECT k FROM sp)),
 gap AS (SELECT * FROM rq WHERE NOT EXISTS (SELECT 1 FROM t WHERE NOT bare AND t.rk = t.k AND t.k = rq.k AND t.n = rq.n))"""


@query(f"""WITH {_SERVES}
SELECT 'duplicate_requirement_id' AS code, 'error' AS severity, 'specs/' || spec || '/spec.md' AS path, spec || ': requirement R1 is declared more than once' AS message FROM sp WHERE k % 6 = 0
UNION ALL SELECT 'task_without_requirement', 'error', path, task || ' has no Serves: reference' FROM t WHERE bare
UNION ALL SELECT 'cross_spec_requirement_reference', 'error', path, printf('%s (owned by SPEC-%06d) references SPEC-%06d:R%d — coverage must reference the task''s own Spec', task, k, rk, n) FROM t WHERE NOT bare AND rk <> k
UNION ALL SELECT 'unknown_requirement_reference', 'error', path, printf('%s references SPEC-%06d:R%d, which does not exist', task, rk, n) FROM t WHERE NOT bare AND rk = k AND n > k % 4 + 1
UNION ALL SELECT 'unknown_requirement_reference', 'error', path, task || ' has a malformed Serves: reference "R\\"9"' FROM t WHERE NOT bare AND bad
UNION ALL SELECT 'uncovered_requirement', 'error', 'specs/' || spec || '/spec.md', printf('%s: requirement R%d has no Task serving it', spec, n) FROM gap
UNION ALL SELECT 'phase_gate_blocked', 'error', 'specs/' || spec || '/spec.md', printf('%s has status "%s" but incomplete requirement coverage — not ready for implementation', spec, status) FROM sp WHERE status <> 'draft' AND (k IN (SELECT k FROM gap) OR k IN (SELECT k FROM t WHERE bare))
UNION ALL SELECT CASE state WHEN 'failed' THEN 'failed_task_evidence' WHEN 'stale' THEN 'stale_task_evidence' ELSE 'unverified_task' END, 'error', path, task || CASE state WHEN 'failed' THEN ' is checked complete but its most recent Evidence-Result: is "fail"' WHEN 'stale' THEN ' is checked complete but its recorded Evidence-Fingerprint no longer matches its own current content' ELSE ' is checked complete but has no Evidence-Result: at all' END FROM t WHERE checked AND state <> 'verified'""".replace('R\\\\"9', 'R\\"9'))
def requirement_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of requirements by tasks from both sides, the phase gate, and the evidence of checked tasks."""
    specs, task_texts = requirement_files(spark, sf_dir)
    meta, known = saved(artifacts.metadata(specs).select("path", "error", "status", "body"), "metadata"), artifacts.entities(specs)
    folder = F.regexp_replace("path", r"/[^/]*\z", "")
    own = meta.where("error is null").join(known, "path").select(folder.alias("folder"), S.format_id("SPEC", F.col("number"), 6).alias("spec"), "status")
    rows = saved(tasks.rows(task_texts, width=6), "tasks")
    return requirements.findings(own, meta.where("body is not null").select("path", F.col("body").alias("content")), rows, width=6).unionByName(requirements.evidence_findings(rows, width=6))


@query("""WITH c AS (SELECT c_custkey AS k, c_name, c_mktsegment || CASE WHEN c_custkey % 5 = 2 THEN ' changed' ELSE '' END AS seg, c_custkey * 7 % 97 + 1 AS t FROM customer WHERE c_custkey > 0),
 a AS (SELECT *, CASE WHEN k % 35 = 3 THEN 'failed' ELSE ['indexed', 'removed', 'updated', 'skipped', 'skipped'][k % 5 + 1] END AS action, length(seg || chr(10) || printf('see [[SPEC-002#req]] [[SPEC-%03d]]', t)) AS one, length('R1 ' || c_name) AS two, CASE WHEN k % 5 IN (0, 2) THEN t % 5 <> 1 ELSE t % 5 <> 0 END AS linked FROM c)
SELECT printf('programs/PRG-001/features/FEAT-001/specs/SPEC-%03d/spec.md', k) AS path, action, CASE WHEN action NOT IN ('failed', 'removed') THEN 'Spec ' || k END AS title, CASE WHEN action NOT IN ('failed', 'removed') THEN 2 ELSE 0 END::BIGINT AS chunks,
 CASE WHEN action NOT IN ('failed', 'removed') THEN (one + 3) // 4 + (two + 3) // 4 END::BIGINT AS tokens, CASE WHEN action NOT IN ('failed', 'removed') THEN 2 + CAST(linked AS INT) ELSE 0 END::BIGINT AS links, CASE WHEN action NOT IN ('failed', 'removed') THEN 9 END AS line FROM a""")
def index_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of the spec files synced one after another: what the second sync did, and what the tables hold then."""
    first, second = spec_versions(spark, sf_dir)
    at = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index_tables.sync(first, at, 8)
    done = index_tables.sync(second, at, 8)
    docs, chunks, links = (index_tables.table(spark, at, n) for n in ("documents", "chunks", "links"))
    per = chunks.groupBy("path").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))
    out = done.join(docs.select("path", "title"), "path", "left").join(per, "path", "left").join(links.groupBy("path").agg(F.count("*").alias("links"), F.max("source_line").alias("line")), "path", "left")
    return out.select("path", "action", "title", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), "tokens", F.coalesce("links", F.lit(0)).cast("long").alias("links"), "line")


_RUNS = """l AS (SELECT doc_id AS id, doc_id // 100 AS pair, doc_id // 100 % 5 = 0 AS task, quality, toxic FROM labels WHERE doc_id IS NOT NULL),
 r AS (SELECT id, pair, task, CASE WHEN id % 11 = 0 THEN CASE WHEN task THEN 'inconclusive' ELSE 'fail' END WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS b, CASE WHEN id % 13 = 0 THEN CASE WHEN task THEN 'inconclusive' ELSE 'fail' END WHEN toxic = 1 THEN 'fail' ELSE 'pass' END AS c,
  CASE WHEN id % 3 <> 0 THEN id % 50 END AS i, CASE WHEN id % 4 = 0 THEN id % 20 END AS o FROM l),
 ch AS (SELECT *, id % 17 = 0 AS odd FROM r WHERE b <> c AND pair % 35 <> 0)"""


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A baseline, a candidate and two repetitions for each hundred labelled documents; of every 35th pair the kinds differ."""
    rows = table(spark, sf_dir, "labels").where("doc_id is not null").select(F.col("doc_id").alias("id"), F.expr("doc_id div 100").alias("pair"), "quality", "toxic")
    none = lambda n: F.when(F.col("id") % n == 0, F.when(F.col("pair") % 5 == 0, "inconclusive").otherwise("fail"))
    base, cand = none(11).otherwise(F.when(F.col("quality") == 1, "pass").otherwise("fail")), none(13).otherwise(F.when(F.col("toxic") == 1, "fail").otherwise("pass"))
    again = F.when(F.col("id") % 17 == 0, F.when(cand == "pass", "fail").otherwise("pass")).otherwise(cand)
    name = lambda side: F.concat(F.lit(side), F.col("pair").cast("string"))
    each = F.explode(F.array(*[F.struct(name(side).alias("run_id"), outcome.alias("outcome")) for side, outcome in (("b", base), ("c", cand), ("r", cand), ("s", again))]))
    results = rows.select("id", F.lit(0).alias("ord"), F.when(F.col("id") % 3 != 0, F.col("id") % 50).alias("input_tokens"), F.when(F.col("id") % 4 == 0, F.col("id") % 20).alias("output_tokens"), each.alias("x")).select("x.*", "id", "ord", "input_tokens", "output_tokens")
    pairs = rows.select("pair").distinct()
    p = F.col("pair")
    kind, text = F.when(p % 5 == 0, "task_execution").otherwise("retrieval"), lambda x: x.cast("string")
    config = lambda model, ranking, rep, *more: F.create_map(F.lit("model"), model, F.lit("ranking_version"), ranking, F.lit("repetition_index"), F.lit(rep), *more)
    runs = pairs.select(name("b").alias("run_id"), kind.alias("kind"), config(text(p % 3), F.lit("1"), "0").alias("config"))
    runs = runs.union(pairs.select(name("c"), F.when(p % 35 == 0, "retrieval").otherwise(kind), config(text(p % 2), F.when(p % 4 == 0, "2").otherwise("1"), "1", F.lit("note"), F.when(p % 2 == 0, "").otherwise("x"))))
    return pairs.select(p, name("b").alias("baseline"), name("c").alias("candidate")), runs, results, pairs.select(p, F.explode(F.array(name("r"), name("s"))).alias("run_id"))


@query(f"""WITH {_RUNS}, t AS (SELECT pair, any_value(task) AS task, count(*) FILTER (c <> 'inconclusive') AS n, count(*) FILTER (c = 'pass') AS ok, sum(coalesce(i + o, i, o)) FILTER (c <> 'inconclusive') AS tokens FROM r GROUP BY pair),
 d AS (SELECT pair, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (odd) AS ids FROM ch GROUP BY pair)
SELECT t.pair, t.pair % 35 <> 0 AS comparable, CASE WHEN t.pair % 35 <> 0 THEN array_to_string(list_filter([CASE WHEN t.pair % 3 <> t.pair % 2 THEN 'model' END, CASE WHEN t.pair % 2 <> 0 THEN 'note' END, CASE WHEN t.pair % 4 = 0 THEN 'ranking_version' END], lambda x: x IS NOT NULL), ',') END AS dimension_diff,
 CASE WHEN t.pair % 35 <> 0 THEN t.pair % 4 = 0 END AS stale, CASE WHEN t.pair % 35 <> 0 THEN round(CASE WHEN t.n > 0 THEN ok / t.n ELSE 0 END, 9) END AS success_rate, CASE WHEN t.pair % 35 <> 0 AND task AND ok > 0 THEN round(tokens / ok, 9) END AS tokens_per_pass,
 CASE WHEN t.pair % 35 <> 0 THEN coalesce(d.n, 0) END AS n_changed, CASE WHEN t.pair % 35 <> 0 THEN coalesce(ids, '') END AS inconsistent FROM t LEFT JOIN d ON d.pair = t.pair""")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, _ = evaluation.compare(*_runs(spark, sf_dir))
    return report.select("pair", "comparable", F.array_join("dimension_diff", ",").alias("dimension_diff"), "stale", F.round("success_rate", 9).alias("success_rate"), F.round("tokens_per_pass", 9).alias("tokens_per_pass"), "n_changed", F.array_join(F.col("inconsistent").cast("array<string>"), ",").alias("inconsistent"))


@query(f"""WITH {_RUNS} SELECT pair, id, b AS baseline_outcome, c AS candidate_outcome, CASE WHEN odd THEN 'neutral' WHEN c = 'pass' THEN 'improved' WHEN b = 'pass' THEN 'regressed' ELSE 'neutral' END AS direction FROM ch""")
def run_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.compare(*_runs(spark, sf_dir))[1].select("pair", "id", "baseline_outcome", "candidate_outcome", "direction")


@query(f"""WITH RECURSIVE {_CONTEXT}, it AS (SELECT r.request, k, row_number() OVER (PARTITION BY r.request ORDER BY r.position) AS place FROM rk r JOIN walk w ON w.request = r.request AND w.position = r.position WHERE how > 0),
 fp AS (SELECT request, k, min(place) AS place FROM it GROUP BY 1, 2), q2 AS (SELECT k AS request, [(k * 3 + 1) % 100, (k + 1) % 100, k] AS must, [(k * 11 + 3) % 100, (k + 51) % 100] AS never FROM q),
 res AS (SELECT request, list_filter(must, lambda x: NOT list_contains(ks, x)) AS missing, list_filter(never, lambda x: list_contains(ks, x)) AS unexpected, list_filter(must, lambda x: list_contains(ks, x)) AS had, ks, ps FROM q2 JOIN (SELECT request, list(k ORDER BY k) AS ks, list(place ORDER BY k) AS ps FROM fp GROUP BY 1) USING (request))
SELECT request::VARCHAR AS request, len(missing) = 0 AND len(unexpected) = 0 AS passed, array_to_string(missing, ',') AS missing, array_to_string(unexpected, ',') AS unexpected, array_to_string(list_transform(had, lambda x: x || '@' || ps[list_position(ks, x)]), ',') AS positions FROM res""")
def retrieval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each target three specs that its package must hold and two that it must not."""
    filled = _context(spark, sf_dir)
    k = table(spark, sf_dir, "customer").select("c_custkey")
    ids = lambda *xs: F.array(*[(x % 100 if i else x).cast("string") for x, i in xs])
    c = F.col("c_custkey")
    cases = k.where("c_custkey % 50 = 0").select(c.cast("string").alias("request"), ids((c * 3 + 1, 1), (c + 1, 1), (c, 0)).alias("required"), ids((c * 11 + 3, 1), (c + 51, 1)).alias("forbidden"))
    files = k.select(c.cast("string").alias("id"), F.concat(F.lit("specs/"), c.cast("string"), F.lit(".md")).alias("path"))
    out = evaluation.run_cases(cases, filled, files).join(cases, "request")
    found = F.transform(F.filter("required", lambda x: F.map_contains_key("positions", x)), lambda x: F.concat(x, F.lit("@"), F.try_element_at("positions", x).cast("string")))
    return out.select("request", "passed", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"), F.array_join(found, ",").alias("positions"))


@query("""WITH e AS (SELECT event_id AS ord, user_id AS cache, event_type || '-' || floor(value)::BIGINT % 5 AS pack_id, floor(epoch(ts))::BIGINT AS created_at, props FROM events WHERE user_id IS NOT NULL),
 old AS (SELECT * FROM (SELECT cache, pack_id, arg_max(created_at, ord) AS created_at, arg_max(props, ord) AS props, min(ord) AS seq FROM e WHERE ord % 2 = 0 AND pack_id IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY cache ORDER BY created_at DESC, seq DESC) <= 6),
 new AS (SELECT cache, pack_id, arg_max(created_at, ord) AS created_at, arg_max(props, ord) AS props, min(ord) + 1000000000000 AS seq FROM e WHERE ord % 2 = 1 AND pack_id IS NOT NULL GROUP BY 1, 2)
SELECT coalesce(o.cache, n.cache) AS cache, coalesce(o.pack_id, n.pack_id) AS pack_id, coalesce(n.created_at, o.created_at) AS created_at, coalesce(n.props, o.props) AS items, coalesce(o.seq, n.seq) AS seq
FROM old o FULL JOIN new n ON n.cache = o.cache AND n.pack_id = o.pack_id QUALIFY row_number() OVER (PARTITION BY coalesce(o.cache, n.cache) ORDER BY coalesce(n.created_at, o.created_at) DESC, coalesce(o.seq, n.seq) DESC) <= 6""")
def pack_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs of each user saved in two goes into a cache of six: some replaced, the oldest evicted."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    name = F.concat("event_type", F.lit("-"), (F.floor("value").cast("long") % 5).cast("string"))
    rows = e.select(F.col("event_id").alias("ord"), F.col("user_id").alias("cache"), name.alias("pack_id"), F.lit("h").alias("config_hash"), F.lit("t").alias("target"), F.unix_timestamp("ts").alias("created_at"), F.col("props").alias("items"))
    none = rows.withColumnRenamed("ord", "seq").limit(0)
    first = packs.upsert(none, rows.where("ord % 2 = 0"), 6)
    return packs.upsert(first, rows.where("ord % 2 = 1").withColumn("ord", F.col("ord") + 1_000_000_000_000), 6).select("cache", "pack_id", "created_at", "items", "seq")


@query(f"""WITH RECURSIVE {_CONTEXT}, it AS (SELECT r.request, k, s, e, CASE how WHEN 2 THEN body ELSE u1 END AS text FROM rk r JOIN walk w ON w.request = r.request AND w.position = r.position WHERE how > 0),
 b AS (SELECT request, k, s, e, CASE WHEN k % 3 = 0 THEN text || '!' ELSE text END AS text FROM it WHERE k % 4 <> 1)
SELECT it.request::VARCHAR AS request, count(*) FILTER (b.text = it.text) AS items_reused, count(*) FILTER (b.text IS DISTINCT FROM it.text) AS items_sent, coalesce(sum((length(b.text) + 3) // 4) FILTER (b.text = it.text), 0)::BIGINT AS tokens_saved_estimate
FROM it LEFT JOIN b ON b.request = it.request AND b.k = it.k AND b.s = it.s AND b.e = it.e GROUP BY 1""")
def pack_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages against base packages of which some items are missing and some say something else."""
    items = candidates.package_items(_context(spark, sf_dir))
    k = F.regexp_extract("path", r"([0-9]+)\.md", 1).cast("long")
    text = F.when(k % 3 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    base = items.where(k % 4 != 1).select("request", "path", "start_line", "end_line", S.fingerprint(text).alias("fingerprint"), F.col("position").alias("base_index"), text.alias("content"))
    return packs.reuse_stats(packs.reuse(items, base))


@query("""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS done, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_custkey > 0),
 e AS (SELECT c, n, n - 1 AS d FROM o WHERE k % 3 = 0 AND n > 1 UNION ALL SELECT c, n, n + 1 FROM o WHERE k % 7 = 0),
 cyc AS (SELECT DISTINCT a.c, a.n FROM e a JOIN e b ON b.c = a.c AND b.n = a.d AND b.d = a.n),
 held AS (SELECT DISTINCT e.c, e.n FROM e WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.c = e.c AND o.n = e.d AND o.done) UNION SELECT * FROM cyc),
 nx AS (SELECT c, min(n) AS n FROM o WHERE NOT done AND NOT EXISTS (SELECT 1 FROM held h WHERE h.c = o.c AND h.n = o.n) GROUP BY c),
 s AS (SELECT nx.c, nx.n, k % 5 + 1 AS a, nx.n % 5 + 1 AS b FROM nx JOIN o ON o.c = nx.c AND o.n = nx.n),
 x AS (SELECT *, list_filter([a, b], lambda r: r <= 4) AS rs, list_filter([a, b], lambda r: r <= 2) AS p1, list_filter([a, b], lambda r: r = 3) AS p2 FROM s)
SELECT printf('specs/SPEC-%06d/tasks.md', c) AS path, n AS number, array_to_string(list_transform(rs, lambda r: printf('SPEC-%06d:R%d=', c, r) || ['one', 'two', 'three', 'four'][r]), ';') AS requirements,
 array_to_string(list_filter([CASE WHEN len(p1) > 0 THEN 'First:' || array_to_string(p1, ',') END, CASE WHEN len(p2) > 0 THEN 'Second:' || array_to_string(p2, ',') END], lambda y: y IS NOT NULL), ';') AS plan FROM x""")
def task_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next task of each customer's file, the texts of what it serves and the plan's sections on that."""
    files, specs, plans = planned_tasks(spark, sf_dir)
    out = preparation.prepare(saved(tasks.rows(files, width=6), "tasks"), specs, plans)
    reqs = F.array_join(F.transform("requirements", lambda x: F.concat(x["ref"], F.lit("="), x["content"])), ";")
    plan = F.array_join(F.transform("plan_sections", lambda x: F.concat(x["heading"], F.lit(":"), F.array_join(F.transform(x["matched"], lambda r: F.substring_index(r, ":R", -1)), ","))), ";")
    return out.select("path", F.col("number").cast("long").alias("number"), reqs.alias("requirements"), plan.alias("plan"))


@query(f"""WITH RECURSIVE {_CONTEXT}, it AS (SELECT r.*, w.used, CASE how WHEN 2 THEN body ELSE u1 END AS content, lag(tier) OVER (PARTITION BY r.request ORDER BY r.position) AS was FROM rk r JOIN walk w ON w.request = r.request AND w.position = r.position WHERE how > 0)
SELECT request::VARCHAR AS request, sha256('# Context for ' || request || ' (validation)' || chr(10) || chr(10) || string_agg(CASE WHEN was IS DISTINCT FROM tier THEN '## ' || ['mandatory', 'structural', 'semantic', 'text', 'second_hop'][tier + 1] || chr(10) || chr(10) ELSE '' END
 || '### specs/' || it.k || '.md — ' || heading || chr(10) || chr(10) || content || chr(10) || chr(10) || '_Reasons: ' || array_to_string(list_transform(string_split(reasons, ';'), lambda x: string_split(x, ':')[2]), ', ') || ' — Tokens: ' || used || '_' || chr(10) || chr(10), '' ORDER BY position)) AS text_sha256
FROM it JOIN (SELECT k, o, heading FROM sec) h ON h.k = it.k AND h.o = it.o GROUP BY request""")
def context_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packages as Markdown texts."""
    items = candidates.package_items(_context(spark, sf_dir))
    out = preparation.render(items, items.select("request", F.col("request").alias("target")).distinct(), "validation")
    return out.select("request", F.sha2("text", 256).alias("text_sha256"))
