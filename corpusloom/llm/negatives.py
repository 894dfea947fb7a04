"""Hard-negative mining by the method of the Four Russians.

Components are whole numbers.  A candidate's eight components of a group give a byte for each binary digit of them, its bit planes;
an anchor has, for each group, a table of the sums of all 256 subsets of its eight components.  A score is then looked
up and added, a digit at a time: it is the exact inner product, without a multiplication.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Candidates and anchors that meet in a task, and anchors whose tables are there at a time.
CHUNK, BLOCK, _TABLES = 8192, 256, 32


def bit_planes(x: np.ndarray) -> np.ndarray:
    """Rows of whole numbers as bytes ``row, plane, group``: two's complement, the sign's plane first; bit k of a byte belongs
    to component k of its group of eight."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    n = max(low.bit_length() if low >= 0 else (-low - 1).bit_length(), max(high, 0).bit_length()) + 1
    wide = np.zeros((len(x), -(-x.shape[1] // 8) * 8), dtype=np.int64)
    wide[:, : x.shape[1]] = x
    bits = wide[:, None, :] >> np.arange(n - 1, -1, -1)[None, :, None] & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """The sums of all subsets of each eight components: ``group, subset, anchor``."""
    dim = -(-anchors.shape[1] // 8) * 8
    wide = np.zeros((len(anchors), dim), dtype=np.int64)
    wide[:, : anchors.shape[1]] = anchors
    each = wide.reshape(len(anchors), -1, 8).transpose(1, 2, 0)
    out = np.zeros((each.shape[0], 256, len(anchors)), dtype=np.int64)
    for k in range(8):
        out[:, 1 << k : 2 << k] = out[:, : 1 << k] + each[:, k : k + 1]
    return out


def scores(planes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Inner products ``candidate, anchor``: the planes from the sign on, each shifted in under those before it."""
    most = (int(np.abs(sums).max()) if sums.size else 0) * max(1, len(sums)) << planes.shape[1]
    sums = sums.astype(np.int32) if most < 1 << 30 else sums
    out = np.zeros((len(planes), sums.shape[2]), dtype=sums.dtype)
    for plane in range(planes.shape[1]):
        if plane == 1:
            np.negative(out, out)  # the sign's digit counts against the others
        out += out
        for group, table in enumerate(sums):
            out += table[planes[:, plane, group]]
    return -out if planes.shape[1] == 1 else out


def _numbers(vec: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component; null if any is null, not finite or beyond 31 bits."""
    scaled = F.transform(vec, lambda x: x.cast("double") * scale)
    fits = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(1 << 31)))
    return F.when(F.coalesce(fits, F.lit(False)), F.transform(scaled, lambda x: F.floor(x)))


def _packed(rows: DataFrame) -> DataFrame:
    """Rows with their numbers as bit planes, and an anchor's numbers as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby("dim"):
                x = np.array(part["v"].tolist(), dtype=np.int64).reshape(len(part), dim)
                planes = bit_planes(x)
                yield pd.DataFrame({
                    "rk": part["rk"], "id": part["id"], "label": part["label"], "dim": part["dim"], "digits": planes.shape[1],
                    "planes": [p.tobytes() for p in planes], "numbers": [r.tobytes() if a else None for r, a in zip(x, part["anchor"], strict=True)],
                })

    return rows.mapInPandas(run, "rk bigint, id bigint, label bigint, dim int, digits int, planes binary, numbers binary")


def _planes_of(rows: pd.DataFrame, groups: int) -> np.ndarray:
    """Planes of rows that may have unlike numbers of digits: the sign's plane is repeated."""
    digits = rows["digits"].to_numpy().astype(np.int64)
    out = np.zeros((len(rows), int(digits.max()), groups), dtype=np.uint8)
    for d in np.unique(digits):
        at = np.flatnonzero(digits == d)
        own = np.frombuffer(b"".join(rows["planes"].iloc[at]), dtype=np.uint8).reshape(len(at), d, groups)
        out[at, out.shape[1] - d :] = own
        out[at, : out.shape[1] - d] = own[:, :1]
    return out


def _scored(rows: pd.DataFrame) -> Iterator[tuple[int, pd.Series, np.ndarray]]:
    """Each anchor of a task: its place among the anchors, and its scores with the candidates, which are in order of id."""
    cands, anchors = rows[~rows["is_anchor"]], rows[rows["is_anchor"]]
    groups, dim = -(-int(rows["dim"].iloc[0]) // 8), int(rows["dim"].iloc[0])
    planes = _planes_of(cands, groups)
    own = np.frombuffer(b"".join(anchors["numbers"]), dtype="<i8").reshape(len(anchors), dim)
    for at in range(0, len(anchors), _TABLES):
        out = scores(planes, subset_sums(own[at : at + _TABLES]))
        for i in range(out.shape[1]):
            yield at + i, out[:, i].astype(np.int64)


def _meet(cands: DataFrame, anchors: DataFrame, blocks: dict[int, tuple[int, int]], run, schema: str) -> DataFrame:
    """``run`` over every block of anchors with every chunk of candidates of the same length of vectors."""
    table = F.create_map(*[F.lit(x) for d, (b, c) in blocks.items() for x in (d, F.struct(F.lit(b).alias("b"), F.lit(c).alias("c")))])
    sized = lambda df: df.withColumn("z", table[F.col("dim")]).where("z is not null")
    home = lambda n: F.pmod(F.xxhash64("rk"), F.col(f"z.{n}")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(f"z.{n}") - 1))
    a = sized(anchors).select("*", F.lit(True).alias("is_anchor"), home("b").alias("block")).select("*", every("c").alias("chunk")).drop("z")
    c = sized(cands).select("*", F.lit(False).alias("is_anchor"), home("c").alias("chunk")).select("*", every("b").alias("block")).drop("z")
    return a.unionByName(c, allowMissingColumns=True).groupBy("dim", "block", "chunk").applyInPandas(run, schema)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, chunk: int = CHUNK, block: int = BLOCK
) -> DataFrame:
    """The hardest rows of other labels for each anchor and each of its positives.

    Components are ``floor(scale * x)``; a score is the exact inner product of two rows.  An anchor's positives are its first
    ``positives`` other rows of its label by score, ties by smaller id; for each of them, its negatives are the first
    ``negatives`` rows of other labels with ``low`` to ``high`` percent of the positive's score.  Returns ``anchor_id, positive_id, rank``
    (from 1), ``negative_id, positive_score, negative_score``.  Ids and labels are whole numbers.  Rows with a null id, label or vector or a
    null or non-finite component take no part, nor does a component beyond 31 bits; vectors of unlike length have no score; zero and empty vectors do.
    A repeated row is a row of its own and another one than its copies.  An anchor without positives, and a positive
    without negatives, give no row; an empty table gives none; other columns aren't read.

    Anchors meet candidates in blocks of about ``block`` and ``chunk`` rows, each pair of blocks a task of its own; a task returns at most
    ``positives`` rows an anchor in the first pass, ``negatives`` a positive in the second, so nothing like all pairs is ever written.
    """
    vec = _numbers(F.col(vec_col), scale)
    taken = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), vec.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    taken = taken.where("id is not null and label is not null and v is not null").select(F.monotonically_increasing_id().alias("rk"), "*", F.size("v").alias("dim"))
    packed = written(_packed(taken), "planes")
    cands, anchors = packed.drop("numbers"), packed.where("numbers is not null").select("rk", "id", "label", "dim", "numbers")
    sizes = packed.groupBy("dim").agg(F.count("*").alias("n"), F.count("numbers").alias("a")).where("a > 0").collect()
    blocks = {r["dim"]: (-(-r["a"] // block), -(-r["n"] // chunk)) for r in sizes}
    if not blocks:
        return rows.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")

    def near(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "rk"])
        cands, anchors, out = group[~group["is_anchor"]], group[group["is_anchor"]], []
        if len(cands) and len(anchors):
            ids, rks, labels = (cands[c].to_numpy() for c in ("id", "rk", "label"))
            own, own_label = anchors["rk"].to_numpy(), anchors["label"].to_numpy()
            for i, score in _scored(group):
                at = np.flatnonzero((labels == own_label[i]) & (rks != own[i]))
                at = at[np.argsort(-score[at], kind="stable")[:positives]]
                out.append((np.full(len(at), own[i]), ids[at], rks[at], score[at]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] or [[]] * 4
        return pd.DataFrame(dict(zip(("rk", "positive_id", "positive_rk", "score"), cols, strict=True)))

    best = Window.partitionBy("rk").orderBy(F.desc("score"), "positive_id", "positive_rk")
    found = _meet(cands, anchors, blocks, near, "rk bigint, positive_id bigint, positive_rk bigint, score bigint")
    found = written(found.withColumn("k", F.row_number().over(best)).where(F.col("k") <= positives), "positives")
    lists = found.groupBy("rk").agg(F.sort_array(F.collect_list(F.struct("k", "score"))).alias("p")).select("rk", F.col("p.k").alias("ks"), F.col("p.score").alias("ps"))

    def hard(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "rk"])
        cands, anchors, out = group[~group["is_anchor"]], group[group["is_anchor"]], []
        if len(cands) and len(anchors):
            ids, labels = cands["id"].to_numpy(), cands["label"].to_numpy()
            own, own_label = anchors["rk"].to_numpy(), anchors["label"].to_numpy()
            ks, ps = anchors["ks"].tolist(), anchors["ps"].tolist()
            for i, score in _scored(group):
                at = np.flatnonzero(labels != own_label[i])
                at = at[np.argsort(-score[at], kind="stable")]
                down = -100 * score[at]  # ascending
                for k, p in zip(ks[i], ps[i], strict=True):
                    first, end = np.searchsorted(down, -high * int(p), "left"), np.searchsorted(down, -low * int(p), "right")
                    few = at[first : min(end, first + negatives)]
                    out.append((np.full(len(few), own[i]), np.full(len(few), k), ids[few], score[few]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] or [[]] * 4
        return pd.DataFrame(dict(zip(("rk", "k", "negative_id", "negative_score"), cols, strict=True)))

    hardest = Window.partitionBy("rk", "k").orderBy(F.desc("negative_score"), "negative_id")
    mined = _meet(cands, anchors.join(lists, "rk"), blocks, hard, "rk bigint, k int, negative_id bigint, negative_score bigint")
    mined = mined.withColumn("rank", F.row_number().over(hardest)).where(F.col("rank") <= negatives)
    who = found.join(anchors.select("rk", F.col("id").alias("anchor_id")), "rk").select("rk", "k", "anchor_id", "positive_id", F.col("score").alias("positive_score"))
    return mined.join(who, ["rk", "k"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
