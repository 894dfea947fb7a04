"""Sharding by virtual slots: its law, its numbers and its maps."""

from zlib import crc32

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import queries, shards

SF = "/root/testdata/sf0.01"


def test_query_keeps_its_law(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op12_sharding(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    load, places = dict.fromkeys(range(8), 0), {}
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, crc32(raw), "bytes", None)
        load[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert set(load) == set(range(8)) == set(places)
    assert max(load.values()) - min(load.values()) <= 0.001 * sum(load.values())
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    assert all(r["shard_by_version_2"] in (r["shard"], 8) for r in rows)
    grown = [sum(r["size"] for r in rows if r["shard_by_version_2"] == s) for s in range(9)]
    assert max(grown) - min(grown) <= 0.02 * sum(grown)
    slots = {r["virtual_slot"]: r["shard"] for r in rows}
    assert all(slots[r["virtual_slot"]] == r["shard"] for r in rows) and len(slots) > 500


def test_hot_group_is_split(spark):
    """A third of all rows is one row repeated, and its bytes more than a shard's share."""
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("hot "), 50)).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    out = shards.shard(docs, 8)
    load = [r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert out.count() == 3000 and len(load) == 8 and max(load) - min(load) <= 0.03 * sum(load)
    each = out.groupBy("shard").agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.count_distinct("place").alias("u"), F.count("*").alias("n")).collect()
    assert all(r["lo"] == 0 and r["hi"] == r["n"] - 1 == r["u"] - 1 for r in each)


def test_map_edits():
    sizes = [(s, None, 100 + s * 37 % 91) for s in range(500)]
    now = shards.first_map(sizes, 6, 500)
    load = lambda m, n: [sum(b for (s, p, b) in sizes if dict(((x, y), z) for x, y, z in m)[s, p] == k) for k in range(n)]
    assert max(load(now, 6)) - min(load(now, 6)) <= 100
    same = shards.edited_map(now, sizes, 6)
    assert same == now
    more = shards.edited_map(now, sizes, 7)
    moved = [(a, b) for a, b in zip(now, more, strict=True) if a != b]
    assert all(b[2] == 6 for _, b in moved) and len(moved) <= 500 / 7 + 10 and max(load(more, 7)) - min(load(more, 7)) <= 0.03 * sum(load(more, 7))
    fewer = shards.edited_map(now, sizes, 5)
    assert {b[2] for b in fewer} == set(range(5)) and all(a == b for a, b in zip(now, fewer, strict=True) if a[2] < 5)
    grown = [(s, p, b * (4 if dict(((x, y), z) for x, y, z in now)[s, p] == 0 else 1)) for s, p, b in sizes]
    even = shards.edited_map(now, grown, 6)
    of = dict(((x, y), z) for x, y, z in even)
    loads = [sum(b for s, p, b in grown if of[s, p] == k) for k in range(6)]
    assert max(loads) <= 1.05 * sum(loads) / 6


@pytest.mark.parametrize("grown", [None, 9])
def test_edges(spark, grown):
    rows = [(1, None, "x"), (None, "no id", "x"), (2, "", "x"), (3, "é\U0001f600", "x"), (3, "é\U0001f600", "x"), (4, "long " * 100_000, "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, slot string").withColumns({c: F.lit(c) for c in ("part", "size", "shard", "task", "own", "__id", "version")})
    out = shards.shard(docs, 8, grown=grown).collect()
    assert len(out) == len(rows) and sorted(r["size"] for r in out) == [1, 1, 1, 6, 7, 7, 500_001]
    assert all(0 <= r["shard"] < 8 and r["version"] == 1 for r in out)
    assert shards.shard(docs.where("false"), 8, grown=grown).count() == 0
    assert {r["text_crc32"] for r in out if r["size"] == 1} == {0}
