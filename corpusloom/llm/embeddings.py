"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors at cosine >= t are within squared distance 2 - 2t.  After a rotation to principal axes the
dimensions are dealt to blocks, and each block gets a share of that distance in proportion to its variance:
if every block were beyond its share, the whole would be beyond the total.  So each block alone is joined by
range (a grid on its two leading axes, then the block's distance), and what any block finds is verified by
the cosine of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Forest, connected_components, written

_SLACK = 1e-9
_TILE = 256
#: Cells along an axis at most; so the table of cells has a bound: blocks x _CELLS^2 rows.
_CELLS = 48


def usable(vec: Column) -> Column:
    """False for null, empty and zero vectors and for any null or non-finite component."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _unit(raw: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as they were packed, in double precision, and at length one; their size tells their width."""
    full = np.frombuffer(b"".join(raw), dtype="<f4" if len(raw[0]) == 4 * dim else "<f8").reshape(len(raw), dim).astype("<f8")
    scaled = full / np.abs(full).max(axis=1, keepdims=True)
    return full, scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _spread(reps: DataFrame, dim: int) -> np.ndarray:
    """The covariance of all unit vectors; each task sums its rows, Spark sums the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            if len(b):
                x = np.hstack([_unit(list(b["vec"]), dim)[1], np.ones((len(b), 1))])
                total += x.T @ x
        yield pd.DataFrame({"at": np.arange((dim + 1) ** 2), "x": total.ravel()})

    rows = reps.select("vec").mapInPandas(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    total = np.zeros((dim + 1) ** 2)
    total[rows["at"]] = rows["x"]
    total = total.reshape(dim + 1, dim + 1)
    n = max(total[-1, -1], 1)
    return total[:-1, :-1] / n - np.outer(total[-1, :-1], total[-1, :-1]) / n / n


class Blocks:
    """A rotation, and for each block its dimensions, its share of the squared distance and its cell side."""

    def __init__(self, spread: np.ndarray, limit: float, n_blocks: int):
        values, axes = np.linalg.eigh(spread)
        self.axes, dim = np.ascontiguousarray(axes[:, ::-1]), len(values)
        self.cuts = [round(i * dim / min(n_blocks, dim)) for i in range(min(n_blocks, dim) + 1)]
        var = np.array([max(values[::-1][a:b].sum(), 0.0) for a, b in self.spans()]) + 1e-6
        self.share = limit * var / var.sum() + _SLACK
        self.side = np.maximum(np.sqrt(self.share), 2.0 / (_CELLS - 2))

    def spans(self) -> list[tuple[int, int]]:
        return list(zip(self.cuts, self.cuts[1:], strict=False))

    def rotate(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.axes

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The grid cell of each row in each block, as one number."""
        out = []
        for (a, b), side in zip(self.spans(), self.side, strict=True):
            at = np.floor((x[:, a : min(a + 2, b)] + 1.0) / side).astype(np.int64) + 1
            out.append(at[:, 0] * 1000 + (at[:, 1] if at.shape[1] > 1 else 0))
        return np.stack(out, axis=1)

    def around(self, cell: int) -> list[int]:
        return [cell + dx * 1000 + dy for dx in (-1, 0, 1) for dy in (-1, 0, 1)]

    def distances(self, d: np.ndarray) -> np.ndarray:
        """Squared distance by block of rows of differences."""
        d = d * d
        return np.stack([d[:, a:b].sum(axis=1) for a, b in self.spans()], axis=1)


def _pairs(x: np.ndarray, y: np.ndarray | None, block: int, how: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the block's share of which no earlier block is; those are found there."""
    a, b = how.spans()[block]
    y_all = x if y is None else y
    q, rows, cols = y_all[:, a:b], [], []
    size = (q * q).sum(1)[None, :]
    for at in range(0, len(x), _TILE):
        p = x[at : at + _TILE, a:b]
        i, j = np.nonzero((p * p).sum(1)[:, None] + size - 2 * p @ q.T <= how.share[block] + 1e-6)
        i += at
        if y is None:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 1 << 14):
            s = slice(part, part + (1 << 14))
            within = how.distances(x[i[s]] - y_all[j[s]]) <= how.share
            keep = within[:, block] & ~within[:, :block].any(axis=1)
            rows.append(i[s][keep])
            cols.append(j[s][keep])
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, int), np.zeros(0, int))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, n_blocks: int = 4, chunk: int | None = None) -> DataFrame:
    """Every row of ``vectors`` with its direct links and the smallest id of its group.

    Returns ``id_col, n_links`` (other rows linked directly, copies included), ``component_id`` (smallest
    id reachable, itself included) and ``kept`` (it is that one).  Null, empty and zero vectors and those
    with a null or non-finite component link with nothing; vectors of unlike length don't link; repeated
    rows count as often as they come; an empty table gives none.

    Equal vectors are folded before the join.  A cell of a block is dealt into chunks of about ``chunk``
    vectors (if none is given, those that take 4 MB as doubles), and each pair of neighbouring chunks is a task of its own, so no task holds a whole cell; a
    task gives a count for each vector and the links that join its vectors, not all pairs.
    """
    vec = F.col(vec_col)
    rows = vectors.select(F.col(id_col), F.when(usable(vec), F.transform(vec, lambda x: x.cast("double"))).alias("v"))
    reps = written(
        rows.where("v is not null").groupBy("v").agg(F.min(id_col).alias("low_id"), F.count("*").alias("copies")).select(F.xxhash64("v").alias("key"), F.size("v").alias("dim"), "v", "low_id", "copies"),
        "vectors",
    )
    found, narrow = None, vectors.schema[vec_col].dataType.elementType.typeName() == "float"
    for dim in sorted(r[0] for r in reps.select("dim").distinct().collect()):
        part = _links(_packed(reps.where(F.col("dim") == dim), narrow), dim, threshold, n_blocks, chunk or max(64, (4 << 20) // (8 * dim)))
        found = part if found is None else found.union(part)
    if found is None:
        found = reps.sparkSession.createDataFrame([], "a bigint, b bigint, n bigint")
    found = written(found, "links")
    roots = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "key")
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    each = reps.select("key", "low_id", "copies").join(counts, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = each.groupBy("root").agg(F.min("low_id").alias("component_id"))
    each = each.join(named, "root").select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"), "component_id")
    out = rows.select(F.col(id_col), F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("key")).join(each, "key", "left")
    comp = F.coalesce("component_id", F.col(id_col))
    return out.select(id_col, F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.col(id_col) == comp).alias("kept"))


def _packed(reps: DataFrame, narrow: bool) -> DataFrame:
    """Vectors as bytes: as floats if they came so, which loses nothing, else as doubles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "copies": b["copies"], "vec": [np.asarray(v, dtype="<f4" if narrow else "<f8").tobytes() for v in b["v"]]})

    return reps.select("key", "copies", "v").mapInPandas(run, "key bigint, copies bigint, vec binary")


def _links(reps: DataFrame, dim: int, threshold: float, n_blocks: int, chunk: int) -> DataFrame:
    """``a, b, n``: with a null ``b`` a number of links of ``a``, else a link that joins two vectors."""
    how = Blocks(_spread(reps, dim), 2 - 2 * threshold, n_blocks)

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cells = how.cells(how.rotate(_unit(list(b["vec"]), dim)[1]))
                yield pd.DataFrame({"block": np.tile(np.arange(cells.shape[1]), len(b)), "cell": cells.ravel()})

    sizes = reps.select("vec").mapInPandas(homes, "block int, cell bigint").groupBy("block", "cell").count().collect()
    chunks = {(r[0], r[1]): -(-r[2] // chunk) for r in sizes}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 128):
                yield few(b.iloc[at : at + 128])

    def few(b: pd.DataFrame) -> pd.DataFrame:
        cells = how.cells(how.rotate(_unit(list(b["vec"]), dim)[1]))
        row, task, mine = [], [], []
        for i, key in enumerate(b["key"]):
            for block, cell in enumerate(cells[i].tolist()):
                own = (cell, key % chunks[block, cell])
                for c in how.around(cell):
                    for k in range(chunks.get((block, c), 0)):
                        low, high = sorted((own, (c, k)))
                        row.append(i)
                        task.append(f"{block}:{low[0]}.{low[1]}:{high[0]}.{high[1]}")
                        mine.append(2 if low == high else int(own == high))
        row = np.array(row)
        return pd.DataFrame({"task": task, "side": mine, "key": b["key"].to_numpy()[row], "copies": b["copies"].to_numpy()[row], "vec": b["vec"].to_numpy()[row]})

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        block, group = int(group["task"].iloc[0].split(":")[0]), group.sort_values(["side", "key"])
        keys, copies, sides = (group[c].to_numpy() for c in ("key", "copies", "side"))
        first = int((sides != 1).sum())
        if len(keys) < 2 or sides[0] != 2 and first in (0, len(keys)):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        unit = _unit(list(group["vec"]), dim)[1]
        x = how.rotate(unit)
        i, j = _pairs(x, None, block, how) if sides[0] == 2 else _pairs(x[:first], x[first:], block, how)
        j = j if sides[0] == 2 else j + first
        keep = [(unit[i[s]] * unit[j[s]]).sum(axis=1) >= threshold for s in (slice(at, at + (1 << 14)) for at in range(0, len(i), 1 << 14))]
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        i, j = i[keep], j[keep]
        n = np.bincount(i, copies[j], len(keys)) + np.bincount(j, copies[i], len(keys))
        forest = Forest(len(keys))
        ties = [(p, q) for p, q in zip(i.tolist(), j.tolist(), strict=True) if forest.join(p, q)]
        at = np.flatnonzero(n)
        return pd.DataFrame({
            "a": np.concatenate([keys[at], keys[[p for p, _ in ties]]]) if ties else keys[at],
            "b": pd.array([None] * len(at) + [int(keys[q]) for _, q in ties], dtype="Int64"),
            "n": np.concatenate([n[at], np.zeros(len(ties))]).astype(np.int64),
        })

    return reps.mapInPandas(deal, "task string, side int, key bigint, copies bigint, vec binary").groupBy("task").applyInPandas(meet, "a bigint, b bigint, n bigint")
