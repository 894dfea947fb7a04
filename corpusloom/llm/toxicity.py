"""Toxicity by weak supervision.

Many voters, one for each term and pattern that goes with toxicity in labelled rows, vote on a bounded sample.
The labels choose the voters and give a first guess of their accuracies; they don't vote.  A generative label model
estimates each voter's accuracy and how voters depend on one another from the votes; a linear classifier is then
trained on its posterior labels and scores every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .simhash import shingles

_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"(\w)\1{3,}")
#: Common English insults, a voter that needs no labels.
INSULTS = frozenset("bastard clown creep cretin disgusting dumb fool garbage idiot imbecile jerk loser moron pathetic pig scum shit stupid trash ugly vermin worthless".split())
PATTERNS = ("insult", "shouting", "exclaiming", "stretched", "repeating")


#: Lengths of stems.
STEMS = (4, 5, 6, 7, 8, 9, 10)


def terms(text: str | None, sizes: tuple[int, ...] = STEMS) -> set[str]:
    """The distinct lower-case words of a text, and ``stem*`` for the first characters of longer words."""
    words = set(_WORD.findall((text or "").lower()))
    out = set(words)
    for k in sizes:
        out |= {w[:k] + "*" for w in words if len(w) > k}
    return out


def pattern_votes(text: str | None, found: set[str]) -> list[int]:
    """For each of PATTERNS whether it is seen."""
    text = text or ""
    letters = sum(map(str.isalpha, text[:4000])) if len(text) < 4000 else sum(c.isalpha() for c in text)
    words = max(1, text.count(" ") + 1)
    return [
        int(bool(INSULTS & found)),
        int(letters > 20 and sum(map(str.isupper, text)) > 0.6 * letters),
        int(text.count("!") > 0.1 * words),
        int(_RUN.search(text) is not None),
        int(words > 20 and len(found) < 0.4 * words),
    ]


def label_model(votes: np.ndarray, times: np.ndarray, share: float, guess: np.ndarray, trust: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row, each voter's outcome rates, and the correlations of voters.

    ``votes`` has -1 for abstain, else 0 or 1, and row i stands for ``times[i]`` rows.  Expectation-maximisation of a generative model: given the
    class, a voter gives each of its three outcomes at its own rate (``rate[class, voter, vote + 1]``).  It starts
    from the rates ``guess``, which go on to count as ``trust[class]`` rows besides those seen: without that, voters
    that are never found together can't all be of one class.  Voters that agree beyond what the class explains
    share their evidence: the weight of a vote in a row is one over one plus the voter's positive correlations, within
    the likelier classes, with the others that vote there; correlations are estimated again in every round.  What an
    abstention tells is shared between all that a voter is correlated with.  The share of class 1 stays at ``share``.
    """
    m, times = votes.shape[1], times.astype(np.float64)
    yes, no, still = ((votes == v).astype(np.float32) for v in (1, 0, -1))
    rate, tie, post = guess, np.eye(m), None
    balance = np.log(np.clip([1 - share, share], 1e-6, 1))
    for _ in range(rounds):
        weight = 1 / np.maximum(1, (yes + no) @ tie.astype(np.float32))
        part, logs = 1 / np.maximum(1, tie.sum(1)), np.log(rate)
        log = (yes * weight) @ logs[:, :, 2].T + (no * weight) @ logs[:, :, 1].T + still @ (part * logs[:, :, 0]).T + balance
        after = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))
        moved, post = np.inf if post is None else np.abs(after - post).max(), after
        if moved < 1e-4:
            break
        mass = np.stack([1 - post, post]) * times
        rate = (np.stack([mass @ v for v in (still, no, yes)], axis=2) + trust[:, None, None] * guess + 0.5) / (mass.sum(1) + trust + 1.5)[:, None, None]
        side = post >= 0.5
        rest = yes - no
        for c in (False, True):
            if (side == c).any():
                rest[side == c] -= np.average(rest[side == c], axis=0, weights=times[side == c])
        rest *= np.sqrt(times)[:, None]
        both = (rest.T @ rest).astype(np.float64)
        size = np.sqrt(np.diag(both)) + 1e-9
        tie = np.clip(both / np.outer(size, size), 0, 1)
        tie[tie < 0.1] = 0
        np.fill_diagonal(tie, 1)
    return post, rate, tie


def logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Coefficients, the intercept last, of a logistic regression on labels in 0..1, by Newton's method; row i
    stands for ``times[i]`` rows."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (times * (p - y)) + keep * w
        step = np.linalg.solve((x * (times * p * (1 - p)).astype(x.dtype)[:, None]).T @ x + np.diag(keep), slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Terms and coefficients; small enough to go with every task (its terms come from a bounded sample)."""

    def __init__(self, vocabulary: list[str], patterns: list[int], weights: np.ndarray | None, base: float):
        self.at, self.patterns, self.weights, self.base = {t: i for i, t in enumerate(vocabulary)}, patterns, weights, base
        self.sizes = tuple(sorted({len(t) - 1 for t in vocabulary if t.endswith("*")}))
        self.names = frozenset(vocabulary)

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.base
        found = terms(text, self.sizes)
        w, k, seen = self.weights, len(self.at), pattern_votes(text, found)
        z = w[-1] + sum(w[self.at[t]] for t in found & self.names) + sum(w[k + i] for i, p in enumerate(self.patterns) if seen[p])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def evidence(a, b, n1: float, n0: float):
    """Twice the log likelihood ratio that what ``a`` of ``n1`` rows of label 1 and ``b`` of ``n0`` others hold goes with
    the label, negative if it goes with the other; of numbers or columns."""
    column = isinstance(a, Column)

    def part(seen, rows: float, total: float):
        mean = (a + b) * (rows / total)
        return F.when(seen > 0, seen * F.log(seen / mean)).otherwise(0.0) if column else (seen * np.log(seen / mean) if seen > 0 else 0.0)

    def rest(seen, rows: float, total: float):
        left, mean = rows - seen, (total - a - b) * (rows / total)
        return F.when(left > 0, left * F.log(left / mean)).otherwise(0.0) if column else (left * np.log(left / mean) if left > 0 else 0.0)

    n = n1 + n0
    g = 2 * (part(a, n1, n) + part(b, n0, n) + rest(a, n1, n) + rest(b, n0, n))
    more = a * n0 > b * n1
    return F.when(more, g).otherwise(-g) if column else (g if more else -g)


def low_share(a, b):
    """The lower end of the 95 % range (Wilson) of the share of label 1 among what holds a term; numbers or columns."""
    root, z, n = F.sqrt if isinstance(a, Column) else np.sqrt, 1.96, a + b
    return ((a + z * z / 2) - z * root(a * b / n + z * z / 4)) / (n + z * z)


def _group(text: str | None) -> int:
    """The least XXH64 of the 5-word shingles of a text: near copies mostly have the same."""
    marks = shingles(text, 5)
    return int(marks[0].view(np.int64)) if len(marks) else 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 12_000, least: int = 3, least_share: float = 0.6) -> Model:
    """Fit on at most ``max_labelled`` labelled rows, those with the smallest hash of their id.

    Rows with a null label or id aren't used; a doc with both labels counts with each; of several texts of an id
    the least is taken.  Of rows that share a label and the least hash of their 5-word shingles, as near copies do, one
    stays: copies are no evidence of their own.  Terms are counted by Spark over the sample's whole texts.  A term is
    a voter if it is in at least ``least`` toxic rows and its :func:`evidence` is more than chance would give the best
    of so many terms, twice the log of their number, and at least ``least_share`` of what holds it surely toxic (:func:`low_share`); so is
    a pattern.  The driver sees these terms and, for each row
    of the sample, which of them it holds.  With no labels or only one class the model scores every text with the share of label 1 (0 without
    labels); an empty table of documents gives a model without terms.
    """
    key = F.xxhash64(id_col)
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("y")).distinct()
    chosen = chosen.orderBy(key, id_col, "y").limit(max_labelled)
    sample = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col).groupBy(id_col, "y").agg(F.min("text").alias("text"))
    place = F.pandas_udf(lambda texts: texts.map(_group).astype("int64"), "bigint")
    sample = written(sample.groupBy("y", place("text").alias("g")).agg(F.min("text").alias("text")).select("y", "text"), "labelled")
    counts = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return Model([], [], None, 1.0 if counts.get(1) else 0.0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pd.DataFrame:
            names = list(seen[0] | seen[1])
            return pd.DataFrame({"term": names, "with_it": [seen[1][t] for t in names], "without": [seen[0][t] for t in names]})

        for b in batches:
            for y, t in zip(b["y"], b["text"], strict=True):
                seen[y].update(terms(t))
                if len(seen[0]) + len(seen[1]) > 200_000:
                    yield out()
                    seen[0].clear()
                    seen[1].clear()
        if seen[0] or seen[1]:
            yield out()

    found = sample.mapInPandas(count, "term string, with_it bigint, without bigint").groupBy("term").agg(F.sum("with_it").alias("a"), F.sum("without").alias("b"))
    found = written(found.where(F.col("a") >= least), "terms")
    chance = 2 * float(np.log(max(2, found.count())))
    odds = evidence(F.col("a"), F.col("b"), counts[1], counts[0])
    passed = found.where((odds > chance) & (low_share(F.col("a"), F.col("b")) >= least_share)).select("term", odds.alias("odds")).collect()
    vocabulary = [r["term"] for r in sorted(passed, key=lambda r: (-r["odds"], r["term"]))]
    at, sizes, names = {t: i for i, t in enumerate(vocabulary)}, tuple(sorted({len(t) - 1 for t in vocabulary if t.endswith("*")})), frozenset(vocabulary)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                found = terms(t, sizes)
                rows.append((sorted(at[x] for x in found & names), pattern_votes(t, found)))
            yield pd.DataFrame({"y": b["y"], "terms": [r[0] for r in rows], "patterns": [r[1] for r in rows]})

    marked = sample.mapInPandas(mark, "y int, terms array<int>, patterns array<int>").toPandas()
    marked = marked.loc[sorted(range(len(marked)), key=lambda i: (marked["y"][i], list(marked["terms"][i]), list(marked["patterns"][i])))]
    y, held = marked["y"].to_numpy(), [np.asarray(t, dtype=int) for t in marked["terms"]]
    where: list[list[int]] = [[] for _ in vocabulary]
    for i, ts in enumerate(held):
        for t in ts:
            where[t].append(i)

    def enough(rows: np.ndarray) -> bool:
        return evidence(int((rows & (y == 1)).sum()), int((rows & (y == 0)).sum()), counts[1], counts[0]) > chance

    taken, columns = [], []
    for t, name in enumerate(vocabulary):
        # a stem has to earn its place by rows that its accepted words and stems don't have
        rows = np.zeros(len(y), dtype=bool)
        rows[where[t]] = True
        rest = rows.copy()
        for u, have in zip(taken, columns, strict=True):
            if vocabulary[u].rstrip("*").startswith(name.rstrip("*")) or name.rstrip("*").startswith(vocabulary[u].rstrip("*")):
                rest &= ~have
        if enough(rest):
            taken.append(t)
            columns.append(rows)
    seen = np.array(list(marked["patterns"])).reshape(len(y), len(PATTERNS)) > 0
    sure = lambda rows: low_share((rows & (y == 1)).sum(), (rows & (y == 0)).sum()) >= least_share
    patterns = [i for i in range(len(PATTERNS)) if enough(seen[:, i]) and sure(seen[:, i])]
    x = np.stack([*columns, *[seen[:, i] for i in patterns]], axis=1).astype(np.float32) if taken or patterns else np.zeros((len(y), 0), dtype=np.float32)
    x, spot, times = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    toxic = np.bincount(spot.ravel(), y, len(x))
    votes = np.hstack([np.where(x > 0, 1, -1), np.where(x.any(axis=1), -1, 0)[:, None]]).astype(np.int8)
    guess = np.stack([np.stack([(n @ (votes == v) + 0.5) / (n.sum() + 1.5) for v in (-1, 0, 1)], axis=1) for n in (times - toxic, toxic)])
    post, _, _ = label_model(votes, times, float(y.mean()), guess, 4.0 * np.array([counts[0], counts[1]]))
    return Model([vocabulary[t] for t in taken], patterns, logistic(x, post, times), 0.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out_col: str = "score") -> DataFrame:
    """``id_col``, the columns ``keep`` and ``out_col``, a score in 0..1, for every row; null and empty texts are scored
    as texts without terms, long ones whole, repeated rows each; an empty table gives none.  A kept column of the
    name ``out_col`` is replaced."""
    names = [c for c in dict.fromkeys([id_col, *keep]) if c != out_col]

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for each in texts:
            yield pd.Series([model.score(t) for t in each], dtype="float64")

    # only texts go to the workers and only scores come back; what is kept stays where it is
    return docs.select(*[F.col(f"`{c}`") for c in names], run(F.col(f"`{text_col}`")).alias(out_col))
