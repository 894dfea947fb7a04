"""Periodic runs of words: Lyndon groups, Lyndon arrays under both orders, and longest common extensions.

The first phase of a group-wise suffix sorter takes groups of suffixes from the greatest to the least and appends each
group's context to the contexts of the suffixes just before its members.  What a suffix has gathered when its turn
comes is its longest Lyndon prefix, so the lengths are the Lyndon array.  Each run has a root that is the longest
Lyndon word at its start under the order of words or under the reversed one; roots are extended both ways.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import groups_of
from .simhash import _mix


def lyndon_array(letters: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each position; letters are whole numbers."""
    n = len(letters)
    length, near = [1] * n, list(range(-1, n - 1))  # near: the next position to the left, over what is done
    alive = bytearray(b"\1") * n
    members: list[list[int]] = []
    number = {x: i for i, x in enumerate(sorted(set(letters)))}
    members = [[] for _ in number]
    group = [number[x] for x in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    above[-1:] = [-1] * bool(members)
    now = len(members) - 1
    while now >= 0:
        mine = [i for i in members[now] if group[i] == now]
        members[now] = []
        for i in mine:
            alive[i] = 0
        times: dict[int, int] = {}
        for i in mine:
            j = near[i]
            if j >= 0 and not alive[j]:
                k = j
                while k >= 0 and not alive[k]:
                    k = near[k]
                while j != k:
                    near[j], j = k, near[j]
            near[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            add = length[mine[0]]
            if len(times) == 1:
                (j, k), = times.items()
                parts = {group[j]: {k: [j]}}
            else:
                parts = {}
                for j, k in times.items():
                    parts.setdefault(group[j], {}).setdefault(k, []).append(j)
            for g, by in parts.items():
                top, low = above[g], g
                for k in sorted(by):
                    new = len(members)
                    members.append(by[k])
                    for j in by[k]:
                        group[j] = new
                        length[j] += k * add
                    below.append(low)
                    above.append(top)
                    above[low] = new
                    low = new
                if top >= 0:
                    below[top] = low
        now = below[now]
    return length


class Extensions:
    """Longest common extensions to both sides, from the names of all stretches of 2^k letters."""

    def __init__(self, letters: np.ndarray):
        self.n, self.names = len(letters), [np.unique(letters, return_inverse=True)[1].astype(np.int64)]
        step = 1
        while 2 * step <= self.n:
            low = self.names[-1]
            pairs = low[: self.n - 2 * step + 1] * self.n + low[step : self.n - step + 1]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
            if self.names[-1].max() == len(pairs) - 1:  # none repeats, so no longer one does
                break
            step *= 2

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many letters from ``i`` and from ``j`` on are equal; ``j`` is the greater."""
        out = np.zeros(len(i), dtype=np.int64)
        for k in self._levels():
            ids, most = self.names[k], self.n - (1 << k)
            at = np.flatnonzero(j + out <= most)
            at = at[ids[i[at] + out[at]] == ids[j[at] + out[at]]]
            out[at] += 1 << k
        return out

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many letters before ``i`` and before ``j`` are equal; ``j`` is the greater."""
        out = np.zeros(len(i), dtype=np.int64)
        for k in self._levels():
            ids, size = self.names[k], 1 << k
            at = np.flatnonzero(i - out >= size)
            at = at[ids[i[at] - out[at] - size] == ids[j[at] - out[at] - size]]
            out[at] += size
        return out

    def _levels(self) -> range:
        return range(len(self.names) - 1, -1, -1)


def runs_of(letters: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows ``start, length, period`` of all runs of at least ``least`` letters and ``times`` periods, in order;
    ``times`` is 2 or more."""
    n = len(letters)
    if n < max(least, times):
        return np.zeros((0, 3), dtype=np.int64)
    ranks = np.unique(letters, return_inverse=True)[1]
    reach, found = Extensions(ranks), []
    for order in (ranks, ranks.max() - ranks):
        period = np.array(lyndon_array(order.tolist()), dtype=np.int64)
        at = np.flatnonzero(period * times <= n)
        at = at[at + period[at] < n]
        p = period[at]
        right, left = reach.right(at, at + p), reach.left(at, at + p)
        size = left + right + p
        keep = size >= np.maximum(least, times * p)
        found.append(np.stack([at - left, size, p], axis=1)[keep])
    out = np.unique(np.concatenate(found), axis=0)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _stretches(ids: np.ndarray, doc: np.ndarray, width: int = 16) -> np.ndarray:
    """Marks words inside any stretch of ``width`` words that its document holds again.

    Words of a run of 24 words and three periods are all marked: those a period on are equal to them over at
    least ``width`` words.  So runs lie whole in marked stretches.
    """
    marked = np.zeros(len(ids) + 1, dtype=np.int64)
    if len(ids) < width:
        return marked[:-1] > 0
    h = _mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    size = 1
    while size < width:
        h = _mix(h[:-size] * np.uint64(0xD1B54A32D192ED03) + h[size:])
        size *= 2
    inside = np.flatnonzero(doc[: len(h)] == doc[width - 1 :])
    if not len(inside):
        return marked[:-1] > 0
    h = h[inside] ^ _mix(doc[inside].astype(np.uint64) + np.uint64(7))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = inside[order[np.append(False, same) | np.append(same, False)]]
    np.add.at(marked, again, 1)
    np.add.at(marked, again + width, -1)
    return np.cumsum(marked)[:-1] > 0


def _in_batch(docs: list[list[bytes]], least: int, times: int) -> list[np.ndarray]:
    """The runs of each document.  All marked stretches are one text, with a letter of its own after each."""
    sizes = np.array([len(x) for x in docs])
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for x in docs for w in x], dtype=np.int64)
    doc = np.repeat(np.arange(len(docs)), sizes)
    keep = _stretches(ids, doc) if least >= 24 and times >= 3 else np.ones(len(ids), dtype=bool)
    at = np.flatnonzero(keep)
    if not len(at):
        return [np.zeros((0, 3), dtype=np.int64)] * len(docs)
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(doc[at]) != 0)) + 1
    place = np.insert(at, cut, -1)
    letters = np.where(place < 0, 0, ids[place])
    letters[place < 0] = len(seen) + np.arange(len(cut))
    runs = runs_of(letters, least, times)
    first = place[runs[:, 0]]
    starts = np.append(0, np.cumsum(sizes))
    owner = doc[first]
    runs[:, 0] = first - starts[owner]
    cuts = np.searchsorted(owner, np.arange(len(docs) + 1))
    return [runs[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text: runs of bytes other than space and 0x09-0x0D."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """True for words that stay when every run is cut to its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:-1] == 0


_NUMBERS = ["n_runs", "start", "length", "period", "exponent_milli"]
_EACH = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3, change=None, digests: bool = False) -> DataFrame:
    """One row for each row of ``docs``: its id and the periodic runs of its words.

    A run is a stretch of words with smallest period q, words q apart being identical, of at least ``least`` words
    and ``times`` (2 or more) periods, that no word beside it extends.  Columns: ``n_runs``; of the run of greatest
    length/period (ties: smallest start, then period) ``start, length, period, exponent_milli``; ``runs``, in order of
    start and period; ``collapsed``, the words that no run holds after its first period, joined by one space.
    With ``digests``, the last two are ``runs_sha256`` and ``collapsed_sha256``.  ``change(id, words)``, if given, makes the words
    that are looked at.  Null and empty texts have no words and no run; a null id is allowed; repeated rows are returned as
    often as they come; texts are taken whole, however long; other columns aren't read; an empty table gives none.

    A row needs no other row, so nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rest = [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())] if digests else [("runs", _EACH), ("collapsed", pa.string())]
    columns = [(c, pa.int64()) for c in _NUMBERS] + rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in groups_of(texts):
                ids, words = b.column(0).slice(i, j - i), [words_of(t) for t in texts[i:j]]
                if change:
                    words = [change(d, w) for d, w in zip(ids.to_pylist(), words, strict=True)]
                rows = [_row(w, r, digests) for w, r in zip(words, _in_batch(words, least, times), strict=True)]
                made = [pa.array(x, type=t) for x, (_, t) in zip(zip(*rows, strict=True), columns, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *made], names=["__id", *[c for c, _ in columns]])

    schema = ", ".join(f"{c} {'string' if t == pa.string() else 'bigint' if t == pa.int64() else 'array<struct<start:bigint,length:bigint,period:bigint>>'}" for c, t in columns)
    out = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, f"__id {kind}, {schema}")
    return out.withColumnRenamed("__id", id_col)


def _row(words: list[bytes], runs: np.ndarray, digests: bool) -> tuple:
    each = runs.tolist()
    best = (None,) * 4
    if each:
        low = each[0]
        for r in each[1:]:  # length/period compared exactly
            a, b = r[1] * low[2], low[1] * r[2]
            if a > b or a == b and (r[0], r[2]) < (low[0], low[2]):
                low = r
        best = (*low, 1000 * low[1] // low[2])
        stay = kept_words(len(words), runs)
        words = [w for w, k in zip(words, stay.tolist(), strict=True) if k]
    left = b" ".join(words)
    if digests:
        return len(each), *best, hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in each).encode()).hexdigest(), hashlib.sha256(left).hexdigest()
    return len(each), *best, [{"start": s, "length": n, "period": p} for s, n, p in each], left.decode("utf-8", "surrogatepass")


def folded(doc_id, words: list[bytes]) -> list[bytes]:
    """One document in ten made periodic, by the CRC-32 of its id in decimal: from word ``a`` on, its words repeat with a
    period of about a third to a tenth of what is left.  A null id and no words change nothing."""
    if doc_id is None or not words:
        return words
    h = crc32(str(int(doc_id)).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]
