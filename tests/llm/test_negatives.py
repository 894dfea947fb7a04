"""Hard negatives against all scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import negatives, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("dim", [1, 7, 8, 13, 64])
@pytest.mark.parametrize("span", [(0, 1), (-1, 0), (-1, 1), (-128, 127), (-5, 1000), (-(1 << 30), 1 << 30)])
def test_scores_are_inner_products(dim, span):
    rng = np.random.default_rng(dim)
    x, a = rng.integers(*span, (50, dim), endpoint=True), rng.integers(-300, 300, (9, dim))
    assert (negatives.scores(negatives.bit_planes(x), negatives.subset_sums(a)) == x @ a.T).all()


def plain(rows, positives, how_many, low, high, scale, anchor):
    ok = [(i, y, [int(np.floor(float(x) * scale)) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) and abs(x * scale) < 2**31 for x in v)]
    dot = lambda u, w: sum(p * q for p, q in zip(u, w, strict=True))
    out = []
    for n, (i, y, v) in enumerate(ok):
        if not anchor(i):
            continue
        others = sorted((-dot(v, w), j, z) for m, (j, z, w) in enumerate(ok) if m != n and len(w) == len(v))
        for s, j, _ in [x for x in others if x[2] == y][:positives]:
            hard = [x for x in others if x[2] != y and low * -s <= 100 * -x[0] <= high * -s][:how_many]
            out += [(i, j, k, x[1], -s, -x[0]) for k, x in enumerate(hard, 1)]
    return sorted(out)


def test_query_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    shifted = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows]
    want = plain(shifted, 5, 10, 30, 90, 256, lambda i: i % 100 == 0)
    got = sorted(tuple(r) for r in queries.op13_hard_negatives(spark, SF).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == want and len(got) > 20


def test_edges_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in rng.integers(-3, 9, 5) / 8], int(rng.integers(3))) for i in range(120)]
    rows += rows[:6] + rows[:6]  # repeats and ties
    rows += [(500, None, 1), (501, [1.0, None, 0.0, 0.0, 0.0], 1), (502, [float("nan")] * 5, 2), (503, [float("inf")] * 5, 0), (504, [0.0] * 5, 0), (505, [], 1), (510, [], 1), (506, [1.0] * 9, 2), (520, [0.5] * 9, 2), (507, [0.5] * 9, 0), (508, [3e7] * 5, 1), (None, [1.0] * 5, 1), (509, [1.0] * 5, None)]
    df = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], "vec_id bigint, embedding array<double>, label int, rk string, k int")
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, positives=4, negatives=3, low=20, high=95, scale=64, chunk=17, block=3)
    want = plain(rows, 4, 3, 20, 95, 64, lambda i: i % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100
    assert negatives.hard_negatives(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(df, F.lit(False)).columns == got.columns
