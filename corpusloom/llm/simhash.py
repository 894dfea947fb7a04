"""SimHash near-duplicates by ball hashing.

Every distinct fingerprint emits all values within half the radius; two fingerprints within the radius
meet at one of them.  Exact copies are folded into one fingerprint first, so a meeting place holds at
most one fingerprint for each value within half the radius of it, however large a group of copies is.

Near copies by a Jaccard similarity are found in the same way: a set of shingles has several independent
short fingerprints of min-hashes, and what differs in one of them meets with that one left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import connected_components, links_of_meetings, written

#: A-Z to a-z, other bytes as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = 1 << 15


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a whole text, as a signed integer.

    Words are runs of bytes other than space and 0x09-0x0D, after lower-casing A-Z; fewer than ``width``
    words form one shingle; none (or a null text) gives zero.  A bit is set if it is set in more than
    half the shingles' XXH64 (seed 42), repeats included.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _STEP):
        h = np.fromiter((digest(join(words[i : i + width]), 42) for i in range(at, min(n, at + _STEP))), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id_col, fp``: one row for every input row; other columns are not read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "fp": np.array([fingerprint(t, width) for t in b["__text"]], dtype=np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInPandas(run, f"`{id_col}` {kind}, fp bigint")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def ball(fp: Column, radius: int) -> Column:
    """All 64-bit values at most ``radius`` bits from ``fp``, itself included."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return F.array(*[fp.bitwiseXOR(F.lit(m - (1 << 64) if m >= 1 << 63 else m)) for m in masks])


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """``a, b``: links between distinct values of ``fp`` that join exactly what is within ``distance`` bits.

    Values that meet at a variant are within ``distance`` of one another when that is even; each is linked
    to the smallest of them, which keeps every connection without writing all pairs.  For an odd distance,
    the larger half-ball is emitted and each pair of a meeting place (at most one for each value of the
    ball) is checked.
    """
    half = (distance + 1) // 2
    at = fps.select("fp").distinct().select("fp", F.explode(ball(F.col("fp"), half)).alias("variant"))
    if distance % 2 == 0:
        low = at.withColumn("low", F.min("fp").over(Window.partitionBy("variant"))).where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    else:
        low = at.alias("x").join(at.alias("y"), "variant").where("x.fp > y.fp").select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    return low.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """Every row of ``docs`` with its fingerprint and the smallest id of its group.

    Returns ``id_col, fingerprint`` (16 hex digits) and ``component_id``.  Null and empty texts have
    fingerprint zero and link like any other; rows with a null id take part and never name a group unless
    no row of it has an id; repeated rows are returned as often as they come; an empty table gives none.
    """
    fps = written(fingerprints(docs, id_col, text_col, width), "fp")
    each = fps.groupBy("fp").agg(F.min(id_col).alias("low_id"))
    roots = connected_components(links(fps, distance))
    each = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = each.groupBy("root").agg(F.min("low_id").alias("component_id"))
    each = each.join(named, "root").select("fp", "component_id")
    return fps.join(each, "fp").select(id_col, hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct XXH64 (seed 42) of the word shingles of a text, sorted; words as in :func:`fingerprint`."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(words) - width + 1)
    return np.unique(np.fromiter((digest(join(words[i : i + width]), 42) for i in range(n)), dtype=np.uint64, count=n))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Seven fingerprints of six min-hashes.  Two sets of Jaccard J agree in five of six with J^6 + 6 J^5 (1 - J):
#: 0.655 at J = 0.8, so one of the seven does with 0.9994.
PRINTS, SYMBOLS = 7, 6
_SEEDS = _mix(np.arange(1, 2 * PRINTS * SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1, 1)


def variants(marks: np.ndarray) -> np.ndarray:
    """The half-radius balls of a set's fingerprints: each with each one of its min-hashes left out."""
    if not len(marks):
        return np.zeros(0, dtype=np.int64)
    low = np.full(PRINTS * SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(marks), 4096):
        low = np.minimum(low, ((marks[at : at + 4096] ^ _SEEDS[0]) * (_SEEDS[1] | np.uint64(1))).min(axis=1))
    each = _mix(low + _SEEDS[1].ravel()).reshape(PRINTS, SYMBOLS)
    return _mix(each.sum(axis=1, keepdims=True) - each + _SEEDS[0].reshape(PRINTS, SYMBOLS)).view(np.int64).ravel()


def _set_key(marks: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(marks.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id_col, tk, root``: every row of ``docs`` with the XXH64 of its text and the group it belongs to.

    Two rows are linked if the Jaccard similarity of their distinct word shingles is at least ``similarity``; a
    group is what links connect.  Equal sets are folded first.  Sets that meet at a variant are candidates
    (found with 0.9994 at 0.8, nearer ones more surely); links are candidates whose exact similarity holds.
    Null and empty texts are one set.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("__text"))

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.iloc[i : i + 1000]
                out = []
                for t in part["__text"]:
                    marks = shingles(t, width)
                    out.append((*_set_key(marks), len(marks), variants(marks)))
                one, two, n, at = zip(*out, strict=True)
                yield pd.DataFrame({id_col: part[id_col], "tk": part["tk"], "h1": one, "h2": two, "n": n, "variants": at})

    rows = written(texts.mapInPandas(sketch, f"`{id_col}` {kind}, tk bigint, h1 bigint, h2 bigint, n int, variants array<bigint>"), "sketches")
    sets = rows.groupBy("h1", "h2").agg(F.min("tk").alias("tk"), F.first("n").alias("n"), F.first("variants").alias("variants"))
    sets = written(sets.withColumn("gid", F.monotonically_increasing_id()), "shingle-sets")
    at = sets.select(F.explode("variants").alias("variant"), "gid", F.col("n").alias("size"))
    meets = written(at.withColumn("k", F.count("*").over(Window.partitionBy("variant"))).where("k > 1").drop("k"), "meetings")
    need = meets.select("gid").distinct().join(sets.select("gid", "tk", "h1", "h2"), "gid")

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 200):
                part = b.iloc[i : i + 200]
                marks = [shingles(t, width) for t in part["__text"]]
                keep = [_set_key(m) == (p, q) for m, p, q in zip(marks, part["h1"], part["h2"], strict=True)]
                yield pd.DataFrame({"gid": part["gid"][keep], "marks": [m.view(np.int64) for m, k in zip(marks, keep, strict=True) if k]})

    marks = written(texts.select("tk", "__text").join(need, "tk").dropDuplicates(["gid", "h1", "h2"]).select("gid", "h1", "h2", "__text").mapInPandas(expand, "gid bigint, marks array<bigint>"), "marks")

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.join(marks.select(F.col("gid").alias("a"), F.col("marks").alias("x")), "a").join(marks.select(F.col("gid").alias("b"), F.col("marks").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return both.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")

    roots = connected_components(links_of_meetings(meets, similarity, alike)).withColumnRenamed("node", "gid")
    groups = sets.select("gid", "h1", "h2").join(roots, "gid", "left").select("h1", "h2", F.coalesce("root", "gid").alias("root"))
    return rows.select(id_col, "tk", "h1", "h2").join(groups, ["h1", "h2"]).select(id_col, "tk", "root")
