"""Mixing sources to target weights by temperature, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_tokens(text: Column) -> Column:
    """Pieces of a text between spaces and line ends; none in a null or empty text."""
    gaps = F.length(text) * 2 - F.length(F.replace(text, F.lit(" "), F.lit(""))) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, gaps + 1).otherwise(0).cast("long")


def temperature_weights(tokens: dict, entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> tuple[dict, float, float]:
    """Weights proportional to share^alpha, the exponent alpha in 0..1 and the budget.

    ``entropy`` (nats): the alpha whose weights have it, or the nearest that any alpha gives.
    ``max_repeats``: the smallest alpha (the flattest weights) for which no source is passed through more
    often.  Without a ``budget`` the smallest is taken that passes through every source once.  Sources
    without tokens get no weight.
    """
    total = sum(tokens.values())
    share = {s: n / total for s, n in tokens.items() if n > 0}
    if not share:
        return {}, 1.0, 0.0

    def at(alpha: float) -> dict:
        raw = {s: p**alpha for s, p in share.items()}
        whole = math.fsum(raw.values())
        return {s: x / whole for s, x in raw.items()}

    def need(w: dict) -> float:
        return budget if budget is not None else max(tokens[s] / w[s] for s in w)

    def flat_enough(alpha: float) -> bool:
        w = at(alpha)
        if entropy is not None:
            return -math.fsum(x * math.log(x) for x in w.values()) <= entropy
        return all(need(w) * w[s] <= max_repeats * tokens[s] * (1 + 1e-12) for s in w)

    if entropy is None and max_repeats is None:
        raise ValueError("give a target entropy or a limit of repetitions")
    low, high = 0.0, 1.0
    if flat_enough(0.0):
        high = 0.0
    for _ in range(60 if high else 0):
        mid = (low + high) / 2
        low, high = (low, mid) if flat_enough(mid) else (mid, high)
    w = at(high)
    return w, high, need(w)


def mix(docs: DataFrame, entropy: float | None = None, max_repeats: float | None = 2.0, budget: float | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_rows: int = 4096, seed: int = 7, max_sources: int = 100_000) -> DataFrame:
    """The rows of ``docs`` as often as their source's weight and budget ask for, with ``mix_epoch``,
    ``mix_block`` and ``mix_order``; sorted by these three a source's rows are one permutation after another.

    Each pass through a source permutes its blocks (hash classes of about ``block_rows`` ids) and the rows in
    each block anew; the last pass ends at the row with which the source's budget is met.  Rows with equal ids
    go together.  A null source is a source of its own; rows without tokens come once for each full pass (at least
    once); an empty table gives none; of rows that tie at the cut by equal ids, all go; columns of the input named
    like the three are replaced.  Raises if there are more than ``max_sources`` sources: their token
    counts, one row each, are all that the driver sees; the per-source plan, of the same bound, is broadcast.
    """
    docs = docs.drop("mix_epoch", "mix_block", "mix_order")
    n_blocks = max(1, 1 << max(0, math.ceil(math.log2(max(1, docs.count()) / block_rows))))
    block = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(n_blocks))
    base = docs.select(F.col(source_col).alias("s"), F.col(id_col).alias("i"), block.alias("k"), word_tokens(F.col(text_col)).alias("t"))
    blocks = base.groupBy("s", "k").agg(F.sum("t").alias("t"))
    sums = blocks.groupBy("s").agg(F.sum("t").alias("t")).limit(max_sources + 1).collect()
    if len(sums) > max_sources:
        raise ValueError(f"more than max_sources = {max_sources} sources")
    tokens = {r["s"]: r["t"] for r in sums}
    weights, _, budget = temperature_weights(tokens, entropy, max_repeats, budget)
    plan = []
    for s, t in tokens.items():
        asked = budget * weights.get(s, 0.0)
        full = int(asked / t * (1 + 1e-12)) if t else 1
        plan.append((s, full, max(0, math.ceil(asked - full * t - 1e-6)) if t else 0, weights.get(s, 0.0)))
    spark = docs.sparkSession
    kind = docs.schema[source_col].dataType.simpleString()
    plan = spark.createDataFrame(plan, f"s {kind}, full int, rest bigint, weight double")

    def order(*cols: Column) -> Column:
        return F.xxhash64(*cols, F.lit(seed + 1))

    # where the last pass ends: the block, then the row in it
    ranked = blocks.alias("b").join(F.broadcast(plan.alias("p")), F.col("b.s").eqNullSafe(F.col("p.s"))).where("rest > 0").select("b.s", "k", "t", "full", "rest")
    ranked = ranked.withColumn("o", order(F.col("s"), F.col("k"), F.col("full")))
    run = F.sum("t").over(Window.partitionBy("s").orderBy("o", "k").rowsBetween(Window.unboundedPreceding, 0))
    last = ranked.withColumn("run", run).where((F.col("run") >= F.col("rest")) & (F.col("run") - F.col("t") < F.col("rest"))).select("s", "k", F.col("o").alias("block_cut"), (F.col("rest") - F.col("run") + F.col("t")).alias("left"), "full")
    inside = base.alias("d").join(F.broadcast(last.alias("l")), F.col("d.s").eqNullSafe(F.col("l.s")) & (F.col("d.k") == F.col("l.k"))).select("d.s", "d.t", "left", "block_cut", order(F.col("i"), F.col("full")).alias("o"))
    run = F.sum("t").over(Window.partitionBy("s").orderBy("o").rangeBetween(Window.unboundedPreceding, 0))
    cuts = inside.withColumn("run", run).where("run >= left").groupBy("s").agg(F.min("o").alias("row_cut"), F.min("block_cut").alias("block_cut"))
    cuts = plan.alias("p").join(cuts.alias("c"), F.col("p.s").eqNullSafe(F.col("c.s")), "left").select(*[F.col(c).alias(f"__mix_{c.split('.')[-1]}") for c in ("p.s", "full", "block_cut", "row_cut")])

    tagged = docs.alias("d").join(F.broadcast(cuts.alias("c")), F.col(f"d.`{source_col}`").eqNullSafe(F.col("c.__mix_s")))
    own = order(F.col(f"d.`{source_col}`"), block, F.col("__mix_full"))
    more = F.coalesce((own < F.col("__mix_block_cut")) | ((own == F.col("__mix_block_cut")) & (order(F.col(f"d.`{id_col}`"), F.col("__mix_full")) <= F.col("__mix_row_cut"))), F.lit(False))
    times = F.col("__mix_full") + more.cast("int")
    out = tagged.where(times > 0).select("d.*", F.explode(F.sequence(F.lit(0), times - 1)).alias("mix_epoch"))
    return out.withColumns({"mix_block": order(F.col(source_col), block, F.col("mix_epoch")), "mix_order": order(F.col(id_col), F.col("mix_epoch"))})
