"""Full-text search: BM25 over rows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _is(term: str):
    return lambda x: x == term


def bm25(docs: DataFrame, query: list[str], id_col: str, text_col: str = "text", k1: float = 1.2, b: float = 0.75, limit: int | None = 100) -> DataFrame:
    """Rows that hold every term of ``query``, with ``rank`` (negative, the best lowest).

    Term counts are made where the row is, so text is never shuffled; the corpus statistics are one row.
    The idf is floored at 1e-6.
    """
    terms = list(dict.fromkeys(t.lower() for t in query))
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("rank")).limit(0)
    ts = docs.select(id_col, tokens(F.col(text_col)).alias("ts"))
    rows = ts.select(id_col, F.size("ts").alias("dl"), *[F.size(F.filter("ts", _is(t))).alias(f"f{i}") for i, t in enumerate(terms)])
    stats = rows.agg(F.count("*").alias("n"), F.sum("dl").alias("total"), *[F.sum(F.expr(f"if(f{i} > 0, 1, 0)")).alias(f"d{i}") for i in range(len(terms))]).first()
    n, mean = stats["n"], (stats["total"] or 0) / max(1, stats["n"])
    score = F.lit(0.0)
    for i in range(len(terms)):
        d = stats[f"d{i}"] or 0
        idf = F.greatest(F.log((F.lit(float(n)) - d + 0.5) / F.lit(d + 0.5)), F.lit(1e-6))
        score = score + idf * F.col(f"f{i}") * (k1 + 1) / (F.col(f"f{i}") + k1 * (1 - b + b * F.col("dl") / F.lit(max(mean, 1e-9))))
    hits = rows.where(" and ".join(f"f{i} > 0" for i in range(len(terms)))).select(id_col, (-score).alias("rank"))
    return hits.orderBy("rank", id_col).limit(limit) if limit else hits
