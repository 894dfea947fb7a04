"""URL filters: rules in a sorted array of 64-bit digests, memory-mapped and probed by binary search."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hand_out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class DigestArray:
    """A set of strings in one file: their number, sorted 64-bit xxhash keys, offsets, and the strings in
    that order.

    The file is mapped into memory.  ``find`` probes many keys at once with a vectorised binary search and
    compares the stored string, so a digest collision can't give a wrong answer.
    """

    def __init__(self, path: str):
        words = np.memmap(path, dtype=np.uint8, mode="r")
        n = int(words[:8].view("<u8")[0])
        self.keys = words[8 : 8 + 8 * n].view("<u8")
        self.at = words[8 + 8 * n : 16 + 16 * n].view("<u8")
        self.text = words[16 + 16 * n :]

    @staticmethod
    def packed(strings: Iterable[str]) -> bytes:
        raw = sorted({s.encode() for s in strings}, key=lambda s: (xxhash.xxh64_intdigest(s), s))
        ends = np.cumsum([0, *map(len, raw)], dtype="<u8")
        return b"".join([np.array([len(raw)], dtype="<u8").tobytes(), np.array([xxhash.xxh64_intdigest(s) for s in raw], dtype="<u8").tobytes(), ends.tobytes(), *raw])

    def find(self, probes: list[bytes]) -> np.ndarray:
        """For each probe whether the set holds it."""
        digests = np.fromiter(map(xxhash.xxh64_intdigest, probes), dtype=np.uint64, count=len(probes))
        low, high = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        found = np.zeros(len(probes), dtype=bool)
        for i in np.flatnonzero(high > low):
            found[i] = any(self.text[self.at[k] : self.at[k + 1]].tobytes() == probes[i] for k in range(low[i], high[i]))
        return found


def rule_candidates(host: str, path: str, longest: int) -> list[str]:
    """Every rule of at most ``longest`` characters that could fit, the longest first: each domain suffix of
    the host with each prefix of the path that ends in ``/``."""
    starts = [i for i in range(max(0, len(host) - longest), len(host) + 1) if i == 0 or host[i - 1] == "."] if host else []
    ends = [i + 1 for i, c in enumerate(path[:longest]) if c == "/"] if path.startswith("/") else []
    return sorted((host[i:] + path[:e] for i in starts for e in ends if len(host) - i + e <= longest), key=len, reverse=True)


def judge(pages: DataFrame, block: list[str], allow: list[str], id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_rules: int = 2_000_000) -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row of ``pages``.

    A rule is a host and a path that ends with ``/`` (``example.net/en/``); it fits that host and its
    subdomains where the url's path starts with the rule's.  The longest rule that fits decides, ``default``
    the rest; a rule in both lists blocks.  Null urls and urls without ``://`` have an empty host and path.
    The two sorted digest arrays are files of at most ``max_rules`` strings that Spark hands to every
    executor, which map them into memory.  The order of candidates, longest first, needs no data.
    """
    if len(block) + len(allow) > max_rules:
        raise ValueError(f"more than max_rules = {max_rules} rules")
    if bad := [r for r in [*block, *allow] if not r.endswith("/")]:
        raise ValueError(f"rules must end with '/': {bad[:3]}")
    files = {k: hand_out(pages.sparkSession, f"urls-{k}", [DigestArray.packed(rules)]) for k, rules in (("block", block), ("allow", allow))}
    kind, longest = pages.schema[id_col].dataType.simpleString(), max(map(len, [*block, *allow]), default=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays = {k: DigestArray(SparkFiles.get(name)) for k, name in files.items()}
        for b in batches:
            tried = [rule_candidates(h, p, longest) for h, p in zip(b["host"], b["path"], strict=True)]
            flat = [c.encode("utf-8", "surrogatepass") for c in (x for cs in tried for x in cs)]
            hits = {k: a.find(flat) for k, a in arrays.items()}
            rule, verdict, i = [], [], 0
            for cs in tried:
                got = next(((c, "block" if hits["block"][i + j] else "allow") for j, c in enumerate(cs) if hits["block"][i + j] or hits["allow"][i + j]), (None, default))
                rule.append(got[0])
                verdict.append(got[1])
                i += len(cs)
            yield pd.DataFrame({id_col: b[id_col], "host": b["host"], "path": b["path"], "rule": pd.Series(rule, dtype=object), "verdict": verdict})

    parts = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return parts.mapInPandas(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
