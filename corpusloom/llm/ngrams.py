"""LM scoring with a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, hand_out, written
from .simhash import LOWER

END = b"\n"
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_HALF = np.uint64(32)


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and 0x09-0x0D after lower-casing A-Z, then the end."""
    out = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    out.append(END)
    return out


class _Digests(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < 500_000:
            self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit key for each pair; a word by itself is the pair with zero before it."""
    return _mix(before * _A + word)


def pairs_of(texts: list, digests: _Digests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of all tokens, of the token before each (the end, for the first), and the number in each text."""
    each = [words(t) for t in texts]
    sizes = np.array([len(x) for x in each])
    h = np.fromiter((digests[w] for x in each for w in x), dtype=np.uint64, count=int(sizes.sum()))
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = digests[END]
    return h, before, sizes


def _pieces(texts: pd.Series, size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``size`` characters each."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "") + 20
        if n > size:
            yield at, i + 1
            at, n = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


class Filter:
    """Counts as levels 1, 2, ... (a level for each power of two); a key of level q is held as the q pairs
    (key, 1) to (key, q), each as ``probes`` bits of the key's segment.  A count is read by probing level
    after level until one is missing; it is never too small, and too large by chance at a known rate.

    ``segment_bits`` is the size of all segments, which follow each other, or with ``starts`` that of each."""

    #: Bits for each pair held: with five probes, one in 4,000 that isn't held passes.
    WIDTH = 24

    def __init__(self, n_segments: int, segment_bits: int | np.ndarray, probes: int = 5, bits: np.ndarray | None = None, starts: np.ndarray | None = None):
        self.n, self.size, self.probes, self.bits, self.starts = n_segments, segment_bits, probes, bits, starts

    @staticmethod
    def level(count: np.ndarray) -> np.ndarray:
        return np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1

    @staticmethod
    def middle(level: np.ndarray) -> np.ndarray:
        """The count that stands for a level: 0, 1, then the geometric middle of its range."""
        return np.where(level <= 1, level.astype(np.float64), 2.0 ** (level - 0.5))

    def segment(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> _HALF) * np.uint64(self.n) >> _HALF).astype(np.int64)

    def spots(self, keys: np.ndarray, level: int, size: np.ndarray | np.uint64) -> Iterator[np.ndarray]:
        x = _mix(keys + np.uint64(level * int(_A) & 0xFFFFFFFFFFFFFFFF))
        step = (x >> _HALF) | np.uint64(1)
        for i in range(self.probes):
            yield (((x + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)) * size >> _HALF).astype(np.int64)

    def build(self, keys: np.ndarray, counts: np.ndarray) -> bytes:
        """The bits of one segment, ``WIDTH`` for each pair that it holds."""
        levels, level = self.level(counts), 1
        bits = np.zeros(max(1, -(-int(levels.sum()) * self.WIDTH // 64)) * 64, dtype=np.uint8)
        while len(keys):
            for at in self.spots(keys, level, np.uint64(len(bits))):
                bits[at] = 1
            level += 1
            keys, levels = keys[levels >= level], levels[levels >= level]
        return np.packbits(bits, bitorder="little").tobytes()

    def levels(self, keys: np.ndarray, top: int = 64, first: int = 0) -> np.ndarray:
        """Levels of keys, ``top`` at most; ``bits`` starts with segment ``first``."""
        out, left, level = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys)), 1
        seg = self.segment(keys)
        base, size = ((seg - first) * self.size, np.full(len(keys), self.size, dtype=np.uint64)) if self.starts is None else (self.starts[seg], self.size[seg])
        while len(left) and level <= top:
            near, start = keys[left], base[left]
            keep = np.arange(len(left))
            for at in self.spots(near, level, size[left]):
                spot = start[keep] + at[keep]
                keep = keep[((self.bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1).astype(bool)]
            left = left[keep]
            out[left] = level
            level += 1
        return out


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()

    def out() -> pd.DataFrame:
        h = np.fromiter((xxhash.xxh64_intdigest(w) for w in seen), dtype=np.uint64, count=len(seen))
        return pd.DataFrame({"h": h.view(np.int64), "n": np.fromiter(seen.values(), dtype=np.int64, count=len(seen))})

    for b in batches:
        for t in b["text"]:
            seen.update(words(t))
            if len(seen) > 400_000:
                yield out()
                seen.clear()
    yield out()


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys as the steps between them, all lowest bytes first: what Spark's compression makes small."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unsteps(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _shape(tokens: int) -> Filter:
    """As many segments as there are millions of training tokens; a segment is as large as what it holds asks for."""
    return Filter(1 << max(0, int(np.ceil(np.log2(max(1, tokens / 1_000_000))))), 0)


def _segments(train: DataFrame, shape: Filter) -> DataFrame:
    """``seg, bits``: the filter of all single tokens and pairs of ``train``.  Tasks count their keys and send them,
    packed, to the segments they belong to; a segment's task sums the counts and sets the bits."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digests, held, size = _Digests(), [], 0

        def out() -> pd.DataFrame:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            seg = shape.segment(keys)
            cuts = np.flatnonzero(np.diff(seg, prepend=-1))
            ends = [*cuts[1:], len(keys)]
            return pd.DataFrame({"seg": seg[cuts].astype(np.int32), "keys": [_steps(keys[a:b]) for a, b in zip(cuts, ends, strict=True)], "counts": [zlib.compress(counts[a:b].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for a, b in zip(cuts, ends, strict=True)]})

        for b in batches:
            for i, j in _pieces(b["text"]):
                h, before, _ = pairs_of(b["text"].tolist()[i:j], digests)
                held += [pair_keys(before, h), pair_keys(np.zeros(1, np.uint64), h)]
                size += 2 * len(h)
                if size > 6_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = np.concatenate([_unsteps(k) for k in rows["keys"]]), np.concatenate([np.frombuffer(zlib.decompress(c), dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() for c in rows["counts"]])
        keys, at = np.unique(keys, return_inverse=True)
        return pd.DataFrame({"seg": [key[0]], "bits": [shape.build(keys, np.bincount(at, counts, len(keys)))]})

    return train.mapInPandas(send, "seg int, keys binary, counts binary").groupBy("seg").applyInPandas(gather, "seg int, bits binary")


def _laid_out(segments: DataFrame, n: int) -> tuple[str, np.ndarray, np.ndarray]:
    """The segments one after another in a file that Spark hands out, with each one's size and start in bits.
    Those that hold nothing share 64 empty bits."""
    sizes, starts, end = np.full(n, 64, dtype=np.uint64), np.zeros(n, dtype=np.int64), 64

    def parts() -> Iterator[bytes]:
        nonlocal end
        yield bytes(8)
        for r in segments.toLocalIterator():
            sizes[r["seg"]], starts[r["seg"]] = len(r["bits"]) * 8, end
            end += len(r["bits"]) * 8
            yield r["bits"]

    return hand_out(segments.sparkSession, "ngrams", parts()), sizes, starts


class _Answers:
    """Levels of keys that were asked for, in place of the filter they were read from."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.read = keys[order], levels[order]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        return self.read[np.searchsorted(self.keys, keys)] if len(keys) else np.zeros(0, dtype=np.int64)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", pull: float = 2.0, share: float = 1.0, max_bits: int = 1 << 31, max_frequent: int = 1 << 17) -> DataFrame:
    """Every row's ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The base is the exact unigram score.  ``score`` is the log10 probability under a smoothed bigram model:
    (c(before, word) + m * base probability) / (c(before) + m) with m = pull + share * c(before), the counts
    read from the filter, of 24 bits for each level of each distinct key.  Up to ``max_bits`` it goes to every executor as one
    file that Spark hands out and workers map into memory; a larger one stays in its segments, to which the distinct
    keys of each chunk of documents are sent, and the levels read there come back: the scores are the same.  Counts of the ``max_frequent`` most frequent tokens are broadcast
    too; those of all others reach the documents by a join on the token's digest.

    Null texts are empty: one token, the end.  Rows with a null id are not held out.  Repeated rows are scored
    each; an empty table gives none; without training rows every token has probability one.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), held_out.alias("held"), F.col(text_col).alias("text"))
    train = base.where(~F.col("held")).select("text")
    counts = written(train.mapInPandas(_count_words, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), "token-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, rest = total["n"], total["n"] + 0.5 * (total["v"] + 1)
    top = sorted((r["h"], r["n"]) for r in counts.orderBy(F.desc("n"), "h").limit(max_frequent).collect())
    shape, most = _shape(n), int(Filter.level(np.array([n]))[0])
    segments = written(_segments(train, shape), "segments")
    held_bits = segments.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0)) * 8).first()[0]
    sent = spark.sparkContext.broadcast((np.array([h for h, _ in top], dtype=np.int64), np.array([c for _, c in top], dtype=np.float64)))
    del top

    def frequent() -> tuple[np.ndarray, np.ndarray]:
        return sent.value if len(sent.value[0]) else (np.zeros(1, np.int64), np.zeros(1))

    def scored(b: pd.DataFrame, levels, digests: _Digests) -> Iterator[pd.DataFrame]:
        hot, hot_n = frequent()
        texts = b["text"].tolist()
        for i, j in _pieces(b["text"]):
            h, before, sizes = pairs_of(texts[i:j], digests)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            known, at = np.unique(h, return_inverse=True)
            spot = np.clip(np.searchsorted(hot, known.view(np.int64)), 0, len(hot) - 1)
            exact = (hot[spot] == known.view(np.int64)) & (hot_n[spot] > 0)
            count = np.where(exact, hot_n[spot], 0.0)
            count[~exact] = Filter.middle(levels(pair_keys(np.zeros(1, np.uint64), known[~exact])))
            history, back = np.unique(before, return_inverse=True)
            seen = _lookup(history, known, count, hot, hot_n, levels)[back]
            both = np.minimum(Filter.middle(levels(pair_keys(before, h))), seen)
            one = (count + 0.5)[at] / rest
            mass = pull + share * seen
            logs = np.log10((both + mass * one) / (seen + mass))
            plain = np.where(exact, np.log10((count + 0.5) / rest), 0.0)[at]
            rare = ~exact[at]
            rows = np.repeat(np.arange(len(sizes)), sizes)[rare]
            tf = Counter(zip(rows.tolist(), h.view(np.int64)[rare].tolist(), strict=True))
            lists: list[tuple[list, list]] = [([], []) for _ in sizes]
            for (r, key), times in tf.items():
                lists[r][0].append(key)
                lists[r][1].append(times)
            yield pd.DataFrame({
                "uid": b["uid"].iloc[i:j], "id": b["id"].iloc[i:j], "held": b["held"].iloc[i:j], "tokens": sizes,
                "known": np.add.reduceat((~rare).astype(np.int64), starts), "plain": np.add.reduceat(plain, starts), "score": np.add.reduceat(logs, starts),
                "rare": [x[0] for x in lists], "times": [x[1] for x in lists],
            })

    schema = f"uid bigint, id {kind}, held boolean, tokens bigint, known bigint, plain double, score double, rare array<bigint>, times array<int>"
    numbered = base.withColumn("uid", F.monotonically_increasing_id())
    if held_bits <= max_bits:
        name, sizes, starts = _laid_out(segments, shape.n)
        forget(segments)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            grams, digests = Filter(shape.n, sizes, bits=np.memmap(SparkFiles.get(name), dtype=np.uint8, mode="r"), starts=starts), _Digests()
            for b in batches:
                yield from scored(b, lambda keys: grams.levels(keys, most), digests)

        each = numbered.mapInPandas(run, schema)
    else:
        held = written(numbered, "numbered").withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(max(1, n // 200_000))))

        def ask(rows: pd.DataFrame) -> pd.DataFrame:
            h, before, _ = pairs_of(rows["text"].tolist(), _Digests())
            alone = np.unique(np.concatenate([h, before]))
            hot, hot_n = frequent()
            spot = np.clip(np.searchsorted(hot, alone.view(np.int64)), 0, len(hot) - 1)
            alone = alone[(hot[spot] != alone.view(np.int64)) | (hot_n[spot] <= 0)]
            keys = np.unique(np.concatenate([pair_keys(before, h), pair_keys(np.zeros(1, np.uint64), alone)]))
            seg = shape.segment(keys)
            cuts = np.flatnonzero(np.diff(seg, prepend=-1))
            return pd.DataFrame({"chunk": rows["chunk"].iloc[0], "seg": seg[cuts].astype(np.int32), "keys": [keys[p:q].tobytes() for p, q in zip(cuts, [*cuts[1:], len(keys)], strict=True)]})

        def answer(asked: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
            if not len(asked):
                return pd.DataFrame({"chunk": [], "keys": [], "levels": []})
            own = np.frombuffer(bits["bits"].iloc[0] if len(bits) else bytes(8), dtype=np.uint8)
            part = Filter(shape.n, 8 * len(own), bits=own)
            keys = [np.frombuffer(k, dtype=np.uint64) for k in asked["keys"]]
            return pd.DataFrame({"chunk": asked["chunk"], "keys": asked["keys"], "levels": [part.levels(k, most, int(asked["seg"].iloc[0])).astype(np.uint8).tobytes() for k in keys]})

        def use(rows: pd.DataFrame, read: pd.DataFrame) -> pd.DataFrame:
            known = _Answers(np.frombuffer(b"".join(read["keys"]), dtype=np.uint64), np.frombuffer(b"".join(read["levels"]), dtype=np.uint8).astype(np.int64))
            return pd.concat(list(scored(rows, known.levels, _Digests())))

        asks = held.groupBy("chunk").applyInPandas(ask, "chunk bigint, seg int, keys binary")
        answers = asks.groupBy("seg").cogroup(segments.groupBy("seg")).applyInPandas(answer, "chunk bigint, keys binary, levels binary")
        each = held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(use, schema)
    each = written(each, "scores", "zstd")
    rare = each.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    found = rare.join(counts, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    found = found.groupBy("uid").agg(F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / F.lit(float(rest)))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    out = each.join(found, "uid", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), F.col("tokens").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("plain") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


def _lookup(tokens: np.ndarray, known: np.ndarray, count: np.ndarray, hot: np.ndarray, hot_n: np.ndarray, levels) -> np.ndarray:
    """Counts of ``tokens``: from those of ``known`` where it has them, else as they were found for these."""
    at = np.clip(np.searchsorted(known, tokens), 0, max(0, len(known) - 1))
    out = np.where(known[at] == tokens, count[at], -1.0)
    if (left := out < 0).any():
        spot = np.clip(np.searchsorted(hot, tokens[left].view(np.int64)), 0, len(hot) - 1)
        exact = (hot[spot] == tokens[left].view(np.int64)) & (hot_n[spot] > 0)
        found = np.where(exact, hot_n[spot], 0.0)
        found[~exact] = Filter.middle(levels(pair_keys(np.zeros(1, np.uint64), tokens[left][~exact])))
        out[left] = found
    return out
