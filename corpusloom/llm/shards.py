"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed to a fixed number of slots once and for all.  Which shard a slot lies in is told by a small map, a
table of versions: a version says for each slot its shard, and a later one moves as few slots as it can.  So
rebalancing edits the map by the bytes of the slots and never hashes a record anew.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

SLOTS = 4096
MAP_SCHEMA = "version int, slot int, part int, shard int"


def slot_of(id_col: Column, text: Column, n_slots: int = SLOTS) -> Column:
    """The virtual slot of a record, by its id and text; nulls are values of their own."""
    return F.pmod(F.xxhash64(F.struct(id_col.alias("i"), text.alias("t"))), F.lit(n_slots)).cast("int")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = SLOTS) -> DataFrame:
    """``id_col, size, text_crc32, slot, part``: a record is as large as its text in UTF-8 and one byte more.

    ``part`` deals the records of one slot over 64 parts in turn, by where they are read.  The map only asks for it where a slot
    is too heavy for one shard, as when very many rows are equal.  The table is written, so parts stay as they are.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text.cast("binary"), F.lit(b""))).alias("text_crc32"),
        slot_of(F.col(id_col), text, n_slots).alias("slot"), F.pmod(F.monotonically_increasing_id(), F.lit(64)).cast("int").alias("part"),
    )
    return written(rows, "shard-records")


def slot_bytes(records: DataFrame, n_shards: int) -> list[tuple[int, int, int]]:
    """``slot, part, bytes`` of every slot that holds something, in order; ``part`` is null but for heavy slots.

    Summed by slot and part before the shuffle: at most 64 rows a slot, of which each task sends one.  A slot is heavy if it holds
    over a quarter of a shard's share; its parts are placed one by one.  Bounded by slots and parts.
    """
    by_part = records.groupBy("slot", "part").agg(F.sum("size").alias("bytes"))
    whole, total = F.sum("bytes").over(Window.partitionBy("slot")), records.agg(F.sum("size")).first()[0] or 0
    heavy = F.col("whole") > F.lit(total) / (4 * n_shards)
    rows = by_part.withColumn("whole", whole).select("slot", F.when(heavy, F.col("part")).alias("part"), "bytes").groupBy("slot", "part").agg(F.sum("bytes")).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], -1 if r[1] is None else r[1]))


def first_map(sizes: list[tuple[int, int, int]], n_shards: int, n_slots: int = SLOTS) -> list[tuple[int, int | None, int]]:
    """``slot, part, shard``: the heaviest slot first, each to the shard that is lightest so far.  Slots that hold nothing are
    dealt in turn, so that every record to come has a place."""
    loads = [(0, s) for s in range(n_shards)]
    out = []
    for slot, part, size in sorted(sizes, key=lambda r: (-r[2], r[0], -1 if r[1] is None else r[1])):
        load, shard = heapq.heappop(loads)
        out.append((slot, part, shard))
        heapq.heappush(loads, (load + size, shard))
    used = {s for s, p, _ in out if p is None}
    return out + [(s, None, s % n_shards) for s in range(n_slots) if s not in used]


def edited_map(now: list[tuple[int, int | None, int]], sizes: list[tuple[int, int, int]], n_shards: int, slack: float = 0.01) -> list[tuple[int, int | None, int]]:
    """The next version of a map for ``n_shards`` shards: slots move from shards over their share to shards under it.

    Shards that are there no more lose all; a new one takes slots only into itself, as no other is under its share by then.  A
    slot moves if it doesn't lift the lightest shard over the share by more than ``slack``; so few move.
    """
    bytes_of = {(s, p): b for s, p, b in sizes}
    load = dict.fromkeys(range(n_shards), 0)
    held: dict[int, list] = {}
    for slot, part, shard in now:
        b = bytes_of.get((slot, part), 0)
        held.setdefault(shard, []).append((b, slot, part))
        if shard in load:
            load[shard] += b
    share = sum(b for each in held.values() for b, _, _ in each) / n_shards
    moved: dict[tuple, int] = {}
    lightest = [(b, s) for s, b in load.items()]
    heapq.heapify(lightest)
    for shard in sorted(held):
        for b, slot, part in sorted(held[shard], key=lambda r: (-r[0], r[1], -1 if r[2] is None else r[2])):
            gone = shard not in load
            if not gone and (b == 0 or load[shard] - b < share):
                continue
            while lightest[0][0] != load[lightest[0][1]]:
                heapq.heapreplace(lightest, (load[lightest[0][1]], lightest[0][1]))
            to = lightest[0][1]
            if gone or to != shard and load[to] + b <= share * (1 + slack):
                moved[slot, part] = to
                load[to] += b
                if not gone:
                    load[shard] -= b
                heapq.heapreplace(lightest, (load[to], to))
    return [(s, p, moved.get((s, p), shard)) for s, p, shard in now]


def map_table(spark: SparkSession, *versions: list[tuple[int, int | None, int]]) -> DataFrame:
    """Versions of a map, from 1 on, as a table in the shared folder: ``version, slot, part, shard``."""
    rows = [(v, *r) for v, each in enumerate(versions, 1) for r in each]
    return written(spark.createDataFrame(rows, MAP_SCHEMA), "shard-map")


def placed(records: DataFrame, shard_map: DataFrame, version: int = 1) -> DataFrame:
    """``records`` with ``shard`` by one version of a map, which has at most a row for each slot and part."""
    now = shard_map.where(F.col("version") == version)
    parts = now.where("part is not null").select("slot", "part", F.col("shard").alias("__by_part"))
    whole = now.where("part is null").select("slot", F.col("shard").alias("__by_slot"))
    out = records.join(F.broadcast(whole), "slot", "left").join(F.broadcast(parts), ["slot", "part"], "left")
    return out.withColumn("shard", F.coalesce("__by_part", "__by_slot")).drop("__by_part", "__by_slot")


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", n_slots: int = SLOTS, grown: int | None = None) -> DataFrame:
    """Every row of ``docs``, placed: ``id_col, size, text_crc32, shard, place, slot, version`` and, with ``grown``, ``shard_grown``.

    Shards hold nearly equal bytes: slots are hashed by id and text, their bytes summed, and placed from the heaviest on.  Slots that are too heavy for that
    (very many equal rows) are placed in 64 parts; a single row larger than a shard's share is the only thing that leaves shards apart.
    ``place`` numbers the rows of a shard from 0 without a gap.  ``shard_grown`` is the shard by the map's next version, for
    ``grown`` shards.  Null ids and texts take part (a null text has one byte, like an empty one); repeated rows are placed each by itself;
    other columns aren't read; an empty table gives none.

    No row is shuffled: the two passes join maps of bounded size, and numbers are counted by task and offset by the counts of the tasks before.
    """
    spark = docs.sparkSession
    records = measured(docs, id_col, text_col, n_slots)
    sizes = slot_bytes(records, n_shards)
    versions = [first_map(sizes, n_shards, n_slots)]
    if grown:
        versions.append(edited_map(versions[0], sizes, grown))
    table = map_table(spark, *versions)
    rows = placed(records, table)
    if grown:
        rows = placed(rows.withColumnRenamed("shard", "__now"), table, 2).withColumnsRenamed({"shard": "shard_grown", "__now": "shard"})
    kind = docs.schema[id_col].dataType.simpleString()
    names = [("__id", kind), ("size", "bigint"), ("text_crc32", "bigint"), ("slot", "int"), ("shard", "int")] + [("shard_grown", "int")] * bool(grown)

    def number(batches: Iterator) -> Iterator:
        task, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            each = b.column(4).to_pandas()
            own = each.groupby(each).cumcount() + each.map(lambda s: seen.get(s, 0)).astype("int64") if len(each) else each.astype("int64")
            for s, n in each.value_counts().items():
                seen[s] = seen.get(s, 0) + int(n)
            yield _with(b, task, own)

    numbered = written(rows.select(F.col(id_col).alias("__id"), *[n for n, _ in names[1:]]).mapInArrow(number, ", ".join(f"{n} {k}" for n, k in names) + ", task int, own bigint"), "shard-rows")
    counts = numbered.groupBy("shard", "task").agg((F.max("own") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "task", before.alias("offset"))
    out = numbered.join(offsets, ["shard", "task"])
    return out.select(F.col("__id").alias(id_col), "size", "text_crc32", "shard", (F.col("offset") + F.col("own")).alias("place"), "slot", F.lit(1).alias("version"), *["shard_grown"] * bool(grown))


def _with(batch, task: int, own: pd.Series):
    import pyarrow as pa

    more = [pa.array([task] * batch.num_rows, pa.int32()), pa.array(own.to_numpy(), pa.int64())]
    return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "task", "own"])
