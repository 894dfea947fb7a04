"""SentencePiece encoding and decoding as a relational lattice.

A word's bounded-length substrings are exploded and joined to the piece table; what they match are the edges
of the word's lattice, gathered by word and folded by a higher-order aggregate.  A unigram model's fold is
Viterbi.  A BPE model's scores are merge ranks, of which the best sum isn't what the model encodes to, so its
fold merges edges in the order of their scores; it runs on the same lattice.

A word here is a stretch of text that no piece goes across, neither at a mark nor between any two characters
that stand side by side in no piece: the shorter the words, the fewer there are to encode.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .shared import forget, groups_of, hand_out, let, written
from .simhash import _mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: A word's boundaries are kept as bits of one long.
_LONG = 60
_UNKNOWN_PENALTY = 10.0


@dataclass
class Model:
    """What the operator needs of a SentencePiece model; of fixed size."""

    pieces: list[tuple[str, int, float]]
    bytes: list[int] | None
    unknown: int
    unigram: bool
    longest: int
    least_score: float
    pairs: frozenset[str]
    one_pass: bool

    @staticmethod
    def load(path: str = MODEL) -> Model:
        p = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            p.ParseFromString(f.read())
        n = p.normalizer_spec
        if n.name != "identity" or n.remove_extra_whitespaces or not n.add_dummy_prefix or p.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity rule, a dummy prefix and whitespace as it is are read")
        if p.trainer_spec.model_type not in (1, 2) or any(x.type == 4 for x in p.pieces):
            raise ValueError("only unigram and BPE models without user-defined pieces are read")
        pieces = [(x.piece, i, x.score) for i, x in enumerate(p.pieces) if x.type == 1]
        if any(SPACE in x.lstrip(SPACE) for x, _, _ in pieces):
            raise ValueError("a piece goes across words")
        at = {x.piece: i for i, x in enumerate(p.pieces) if x.type == 6}
        ranks = {x: s for x, _, s in pieces}
        return Model(
            pieces, [at[f"<0x{b:02X}>"] for b in range(256)] if len(at) == 256 else None, next(i for i, x in enumerate(p.pieces) if x.type == 2), p.trainer_spec.model_type == 1,
            max(len(x) for x, _, _ in pieces), min(s for _, _, s in pieces),
            frozenset(x[i : i + 2] for x, _, _ in pieces for i in range(len(x) - 1)), all(in_order(x, ranks) for x in ranks),
        )


def marked(text: str | None) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


class Words:
    """The words of many texts at once: a text is cut where two characters stand side by side in no piece.

    ``digests`` has 64 bits for each word, in order, ``ends`` where it ends in ``text``, the marked texts joined,
    and ``each`` how many words each text has.
    """

    def __init__(self, pairs: frozenset[str]):
        chars = sorted({c for p in pairs for c in p})
        self.kind = np.zeros(0x110000, dtype=np.uint16)
        self.kind[list(map(ord, chars))] = np.arange(1, len(chars) + 1)
        self.joins = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        first, second = (self.kind[[ord(p[i]) for p in pairs]] for i in (0, 1))
        self.joins[first, second] = True

    def read(self, texts: list) -> Words:
        each = [marked(t) for t in texts]
        self.text = "".join(each)
        chars = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kind, size = self.kind[chars], np.array([len(t) for t in each])
        cut = np.ones(len(chars), dtype=bool)
        cut[1:] = ~self.joins[kind[:-1], kind[1:]]
        first = np.cumsum(size) - size
        cut[first[size > 0]] = True
        starts = np.flatnonzero(cut)
        self.ends = np.append(starts[1:], len(chars)) if len(starts) else starts
        self.digests = self._digests(chars, starts, self.ends - starts)
        self.each = np.diff(np.searchsorted(starts, np.append(first, len(chars))))
        self.each[size == 0] = 0
        return self

    def read_words(self, words: list[str]) -> np.ndarray:
        """The digests of words that are words already."""
        self.text, size = "".join(words), np.array([len(w) for w in words])
        chars = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        return self._digests(chars, np.cumsum(size) - size, size)

    @staticmethod
    def _digests(chars: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = np.arange(len(chars)) - np.repeat(starts, size)
        h = _mix(chars * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        return _mix(np.add.reduceat(h, starts) + size.astype(np.uint64)) if len(starts) else np.zeros(0, dtype=np.uint64)

    def word(self, i: int) -> str:
        return self.text[self.ends[i - 1] if i else 0 : self.ends[i]]


def count_words(docs: DataFrame, text_col: str, model: Model, most: int = 400_000) -> DataFrame:
    """``word, n`` for the distinct words of all texts; tasks count before the shuffle."""
    pairs = model.pairs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, seen, names = Words(pairs), np.zeros((2, 0), dtype=np.uint64), {}

        def out() -> pd.DataFrame:
            return pd.DataFrame({"word": [names[d] for d in seen[0].tolist()], "n": seen[1].astype(np.int64)})

        for b in batches:
            texts = b["text"].tolist()
            for i, j in groups_of(texts):
                words.read(texts[i:j])
                new, first, n = np.unique(words.digests, return_index=True, return_counts=True)
                for d, k in zip(new.tolist(), first.tolist(), strict=True):
                    if d not in names:
                        names[d] = words.word(k)
                both, at = np.unique(np.concatenate([seen[0], new]), return_inverse=True)
                total = np.zeros(len(both), dtype=np.uint64)
                np.add.at(total, at, np.concatenate([seen[1], n.astype(np.uint64)]))
                seen = np.stack([both, total])
                if len(names) > most:
                    yield out()
                    seen, names = np.zeros((2, 0), dtype=np.uint64), {}
        if names:
            yield out()

    return docs.select(F.col(text_col).alias("text")).mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


#: Single characters below this code point are looked up in an array of that size, not joined.
_PLAIN = 592


def lattice(words: DataFrame, table: DataFrame, longest: int, plain: int = _PLAIN) -> DataFrame:
    """``word, n, edges``: for each distinct word the pieces in it.

    An edge is a struct of ``rank`` (that of its score, the best first, times 64, plus its start), ``ends`` (the bits
    of its two boundaries), ``inner`` (the bits between), ``place`` (its start times 2^32, plus the id), ``s, e``
    (start and exclusive end) and ``score``.  Pieces of one character below
    code point ``plain`` aren't among them.

    ``words`` is partitioned by word; the rows made of a word stay where it is, so gathering its edges needs no
    further shuffle.
    """
    size, one = F.length("word"), F.lit(1).cast("long")
    parts = words.select("word", "n", F.explode(F.sequence(F.lit(0), size - 1)).alias("s"))
    least = F.when(F.ascii(F.substring("word", F.col("s") + 1, F.lit(1))) < plain, 2).otherwise(1)
    most = F.least(F.lit(longest), size - F.col("s"))
    parts = parts.select("word", "n", "s", F.explode_outer(F.when(most >= least, F.sequence(least, most))).alias("k"))
    parts = parts.select("word", "n", "s", "k", F.expr("substring(word, s + 1, k)").alias("piece"))
    # the piece table is the model's vocabulary: of fixed size, so it can go to every executor
    hits = parts.join(F.broadcast(table), "piece", "left").where("id is not null or s = 0 and coalesce(k, 2) <= 2")
    long = lambda c: F.col(c).cast("long")
    bit = lambda n: F.call_function("shiftleft", one, n)
    edge = F.struct(
        (long("rank") * 64 + F.col("s")).alias("rank"), (bit(F.col("s")) + bit(F.col("s") + F.col("k"))).alias("ends"), (bit(F.col("s") + F.col("k")) - bit(F.col("s") + 1)).alias("inner"),
        (F.call_function("shiftleft", long("s"), F.lit(32)) + F.col("id")).alias("place"), "s", (F.col("s") + F.col("k")).alias("e"), "score",
    )
    return hits.groupBy("word").agg(F.first("n").alias("n"), F.collect_list(F.when(F.col("id").isNotNull(), edge)).alias("edges"))


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def boundaries(edges: Column, length: Column, one_pass: bool) -> Column:
    """The boundaries left by a BPE model's merges, as bits of a long, for words of at most ``_LONG`` characters.

    An edge can be merged when both its ends are boundaries and just one lies between.  The best score comes
    first, the leftmost of equals.  If each piece of the model by itself is merged in the order of the scores
    (:func:`in_order`), so is every word: then no merge makes room for a better one, and the fold goes over
    the edges once.  Else it looks for the best edge again after each merge.
    """
    ready, start = F.sort_array(F.transform(edges, lambda x: F.struct(x["rank"].alias("rank"), x["ends"].alias("ends"), x["inner"].alias("inner")))), _bit(length + 1) - F.lit(1).cast("long")

    def fits(at: Column, x: Column) -> Column:
        return (at.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(at.bitwiseAND(x["inner"])) == 1)

    if one_pass:
        return F.aggregate(ready, start, lambda at, x: F.when(fits(at, x), at.bitwiseAND(F.bitwise_not(x["inner"]))).otherwise(at))

    def step(state: Column, _: Column) -> Column:
        best = F.try_element_at(F.filter(state["edges"], lambda x: fits(state["at"], x)), F.lit(1))
        inner = F.coalesce(best["inner"], F.lit(0).cast("long"))
        return F.struct(state["at"].bitwiseAND(F.bitwise_not(inner)).alias("at"), state["edges"].alias("edges"))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(length - 1, F.lit(1))), F.struct(start.alias("at"), ready.alias("edges")), step, lambda s: s["at"])


def viterbi_cuts(edges: Column, length: Column, longest: int, unknown: float) -> Column:
    """The boundaries of a word's pieces on the path of the highest total score, as :func:`boundaries` gives them.

    Folds over positions; the state has, for each position so far, the best total and where its last edge
    starts.  A character without a piece can be passed at the score ``unknown``.  Among equals the longer
    last edge wins.
    """
    by_end = F.transform(F.sequence(F.lit(1), length), lambda e: F.filter(edges, lambda x: x["e"] == e))
    first = F.array(F.struct(F.lit(0.0).alias("total"), F.lit(-1).alias("s")))

    def step(state: Column, at: Column) -> Column:
        n = F.size(state)
        ways = F.transform(at, lambda x: F.struct((F.element_at(state, x["s"] + 1)["total"] + x["score"]).alias("total"), x["s"].alias("s")))
        alone = F.struct((F.element_at(state, n)["total"] + F.lit(unknown)).alias("total"), (n - 1).alias("s"))
        ways = F.when(F.exists(at, lambda x: x["s"] == n - 1), ways).otherwise(F.concat(ways, F.array(alone)))
        best = F.aggregate(ways, F.element_at(ways, 1), lambda a, b: F.when((b["total"] > a["total"]) | ((b["total"] == a["total"]) & (b["s"] < a["s"])), b).otherwise(a))
        return F.concat(state, F.array(best))

    path = F.aggregate(by_end, first, step, lambda state: F.transform(state, lambda x: x["s"]))

    def back(starts: Column) -> Column:
        def more(out: Column, _: Column) -> Column:
            return let(F.element_at(starts, F.element_at(out, 1) + 1), lambda s: F.when(s > 0, F.concat(F.array(s), out)).otherwise(out))

        return F.aggregate(F.sequence(F.lit(1), length), F.array(length), more)

    return let(path, lambda p: F.aggregate(back(p), F.lit(0).cast("long"), lambda bits, e: bits.bitwiseOR(_bit(e))).bitwiseOR(F.lit(1).cast("long")))


def merged(word: str, score: dict[str, float], made: list | None = None) -> list[int]:
    """The ends of a word's pieces under a BPE model, for words of any length, by a heap of the pairs that can be
    merged.  ``made`` gets the scores of the merges."""
    n = len(word)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (piece := word[i : after[j]]) in score:
            heapq.heappush(heap, (-score[piece], i, j, after[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if not alive[i] or j >= n or not alive[j] or after[i] != j or after[j] != end:
            continue
        alive[j], after[i] = False, end
        if made is not None:
            made.append(score[word[i:end]])
        if end < n:
            before[end] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [after[i] for i in range(n) if alive[i]]


def in_order(piece: str, score: dict[str, float]) -> bool:
    """Whether a piece by itself is merged whole, better scores before worse ones."""
    made: list = []
    return merged(piece, score, made) == [len(piece)] and made == sorted(made, reverse=True)


def dictionary(words: DataFrame, model: Model, words_each: int = 20_000) -> DataFrame:
    """``word, n, ids`` for each of the distinct words ``word, n``, a table: the lattice of about ``words_each`` words is a task."""
    spark = words.sparkSession
    pieces = pd.DataFrame(model.pieces, columns=["piece", "id", "score"])
    pieces["rank"] = (-pieces["score"]).rank(method="dense").astype(int)
    plain = [-1] * _PLAIN
    if not model.unigram:  # a single character is of no use to merges
        for p, i, _ in model.pieces:
            if len(p) == 1 and ord(p) < _PLAIN:
                plain[ord(p)] = i
    table = spark.createDataFrame(pieces, "piece string, id int, score double, rank int")
    words, size = words.repartition(max(1, -(-words.count() // words_each)), "word"), F.length("word")
    net = lattice(words.where(size <= _LONG), table, model.longest, 0 if model.unigram else _PLAIN)
    cuts = viterbi_cuts(F.col("edges"), size, model.longest, model.least_score - _UNKNOWN_PENALTY) if model.unigram else boundaries(F.col("edges"), size, model.one_pass)
    spot, low = lambda i: F.call_function("shiftleft", i.cast("long"), F.lit(32)), F.lit((1 << 32) - 1)
    known = F.lit(bytearray(b"".join(i.to_bytes(4, "big", signed=True) for i in plain)))

    def singles(at: Column, used: Column) -> Column:
        held = F.aggregate(used, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(_bit(F.call_function("shiftright", x, F.lit(32)))))
        alone = let(at.bitwiseAND(F.bitwise_not(held)), lambda bits: F.filter(F.sequence(F.lit(0), size - 1), lambda i: bits.bitwiseAND(_bit(i)) != 0))
        codes = F.transform(alone, lambda i: F.struct(i.alias("i"), F.ascii(F.substring("word", i + 1, F.lit(1))).alias("c")))
        return F.transform(codes, lambda x: spot(x["i"]) + F.when(x["c"] < _PLAIN, F.conv(F.hex(F.substring(known, 4 * x["c"] + 1, F.lit(4))), 16, 10).cast("long")).otherwise(low))

    def ids(at: Column) -> Column:
        used = F.transform(F.filter("edges", lambda x: (at.bitwiseAND(x["ends"]) == x["ends"]) & (at.bitwiseAND(x["inner"]) == 0)), lambda x: x["place"])
        return let(let(used, lambda used: F.sort_array(F.concat(used, singles(at, used)))), named)

    def named(each: Column) -> Column:
        one = lambda x: x.bitwiseAND(low)
        fast = F.transform(each, lambda x: one(x).cast("int"))
        slow = F.flatten(F.transform(each, lambda x: F.when(one(x) != low, F.array(one(x).cast("int"))).otherwise(_fallback(F.substring("word", F.call_function("shiftright", x, F.lit(32)).cast("int") + 1, F.lit(1)), model))))
        return F.when(F.exists(each, lambda x: one(x) == low), slow).otherwise(fast)

    out = net.select("word", "n", let(cuts, ids).alias("ids"))
    score, at = {p: s for p, _, s in model.pieces}, {p: i for p, i, _ in model.pieces}

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for w in b["word"]:
                ends = best_path(w, score, model.longest, model.least_score - _UNKNOWN_PENALTY) if model.unigram else merged(w, score)
                parts = [w[s:e] for s, e in zip([0, *ends], ends, strict=False)]
                rows.append([i for t in parts for i in ([at[t]] if t in at else [model.bytes[c] for c in t.encode()] if model.bytes else [model.unknown])])
            yield pd.DataFrame({"word": b["word"], "n": b["n"], "ids": rows})

    # a set of boundaries of longer words doesn't fit one long
    return out.union(words.where(size > _LONG).mapInPandas(rest, "word string, n bigint, ids array<int>"))


def best_path(word: str, score: dict[str, float], longest: int, unknown: float) -> list[int]:
    """The ends of a word's pieces on the path of the highest total score, as :func:`viterbi_cuts`, for any length."""
    total, back = [0.0], [-1]
    for e in range(1, len(word) + 1):
        ways = [(total[s] + score[word[s:e]], -s) for s in range(max(0, e - longest), e) if word[s:e] in score]
        if word[e - 1 : e] not in score:
            ways.append((total[e - 1] + unknown, 1 - e))
        best = max(ways)
        total.append(best[0])
        back.append(-best[1])
    ends, e = [], len(word)
    while e > 0:
        ends.append(e)
        e = back[e]
    return ends[::-1]


def _fallback(char: Column, model: Model) -> Column:
    """The ids of the bytes of a character that is no piece, or the unknown piece."""
    if model.bytes is None:
        return F.array(F.lit(model.unknown))
    base = model.bytes[0]
    if model.bytes != list(range(base, base + 256)):
        raise ValueError("byte pieces must be in order")
    digits = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: (F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int") + base))


class Packed:
    """Words' ids in one file: sorted 64-bit digests, where each word's ids end, and the ids.

    The file is mapped into memory, so the workers of a machine share it; a lookup takes many words at once.
    """

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n = int(raw[:8].view("<u8")[0])
        self.digests, self.ends, self.ids = raw[8 : 8 + 8 * n].view("<u8"), raw[8 + 8 * n : 8 + 16 * n].view("<u8"), raw[8 + 16 * n :].view("<i4")

    @staticmethod
    def parts(known: DataFrame, pairs: frozenset[str]) -> Iterator[bytes]:
        """The file's bytes; the driver gets the packed words a partition at a time."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cut = Words(pairs)
            for b in batches:
                if len(b):
                    yield pd.DataFrame({
                        "d": [cut.read_words(b["word"].tolist()).tobytes()],
                        "k": [np.array([len(x) for x in b["ids"]], dtype="<u4").tobytes()],
                        "i": [np.concatenate([np.asarray(x, dtype="<i4") for x in b["ids"]]).tobytes()],
                    })

        parts = [(p["d"], p["k"], p["i"]) for p in known.select("word", "ids").mapInPandas(run, "d binary, k binary, i binary").toLocalIterator()]
        d, k, i = (np.frombuffer(b"".join(p[c] for p in parts), dtype=t) for c, t in ((0, "<u8"), (1, "<u4"), (2, "<i4")))
        del parts
        order, starts = np.argsort(d), np.cumsum(k, dtype=np.int64) - k
        sizes = k[order].astype(np.int64)
        ends = np.cumsum(sizes)
        yield np.array([len(d)], dtype="<u8").tobytes()
        yield d[order].tobytes()
        yield ends.astype("<u8").tobytes()
        for at in range(0, len(d), 1 << 16):
            size = sizes[at : at + (1 << 16)]
            yield i[np.repeat(starts[order[at : at + (1 << 16)]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].tobytes()

    def find(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word begin and end; from 0 to -1 for words that aren't there."""
        if not len(self.digests):
            return np.zeros(len(digests), dtype=np.int64), np.full(len(digests), -1)
        at = np.minimum(np.searchsorted(self.digests, digests), len(self.digests) - 1)
        ok = self.digests[at] == digests
        begin = np.where(ok & (at > 0), self.ends[at - 1], 0).astype(np.int64)
        return begin, np.where(ok, self.ends[at], np.uint64(0)).astype(np.int64) - ~ok


def encode(docs: DataFrame, text_col: str = "text", model: Model | None = None, max_sent: int = 4_000_000, decoded_col: str | None = None) -> DataFrame:
    """``docs`` with ``piece_ids``, an array of ints, the ids that the model gives the whole text.

    Null and empty texts have no ids; repeated rows are encoded each; very long texts are encoded whole, in one
    row; an empty table gives none; a column ``piece_ids`` of the input is replaced; ids are the same for a word
    wherever it stands.  Words are counted over all documents and each distinct word is encoded once.  The ids of
    the most frequent words, at most ``max_sent`` of them (about 30 bytes each), go to every executor as one
    file of sorted arrays that Spark hands out and workers map into memory; the words beyond that bound reach the
    texts that hold them by joins on the word and on the text's digest.  With a ``decoded_col`` the same tasks
    decode the ids into that column, as :func:`decode` would in tasks of its own.
    """
    model = model or Model.load()
    spark, pairs = docs.sparkSession, model.pairs
    counted = written(count_words(docs, text_col, model), "words")
    known = written(dictionary(counted, model), "dictionary")
    forget(counted)
    rates = known.groupBy("n").agg(F.count("*").alias("words"))
    rates = rates.withColumn("band", F.floor(F.log2("n") * 64)).groupBy("band").agg(F.sum("words").alias("words"), F.min("n").alias("least"))
    left, least = max_sent, None
    bands = sorted(rates.collect(), key=lambda r: -r["band"])  # at most 64 for each power of two
    for r in bands:
        left -= r["words"]
        if left < 0:
            break
        least = r["least"]
    all_sent = left >= 0
    name = hand_out(spark, "pieces", Packed.parts(known if all_sent else known.where(F.col("n") >= (least or 1 << 62)), pairs))
    back = spark.sparkContext.broadcast(Texts(model) if decoded_col else None)
    fields = [f for f in docs.schema.fields if f.name not in ("piece_ids", decoded_col)]
    names = [f.name for f in fields]
    more = "array<struct<word:string,ids:array<int>>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed, words = Packed(SparkFiles.get(name)), Words(pairs)
        for b in batches:
            texts = b["__text"].tolist()
            for i, j in groups_of(texts):
                part = b.iloc[i:j]
                words.read(texts[i:j])
                own = {x["word"]: x["ids"] for extra in part["__more"] if extra is not None for x in extra}
                new, first, which = np.unique(words.digests, return_index=True, return_inverse=True)
                begin, end = packed.find(new)
                ids, lacks = packed.ids, np.flatnonzero(end < 0)
                end[lacks] = begin[lacks]
                missing, pool, top = {}, [], len(ids)
                for k in lacks.tolist():
                    word = words.word(int(first[k]))
                    if word in own:
                        pool.append(np.asarray(own[word], dtype="<i4"))
                        begin[k], end[k] = top, top + len(pool[-1])
                        top += len(pool[-1])
                    else:
                        missing[k] = word
                if pool:
                    used, size = np.concatenate([np.asarray(ids[p:q]) for p, q in zip(begin.tolist(), end.tolist(), strict=True) if q <= len(ids)] + pool), end - begin
                    stays = end <= len(ids)
                    spot = np.where(stays, np.cumsum(np.where(stays, size, 0)) - np.where(stays, size, 0), begin - len(ids) + int(size[stays].sum()))
                    ids, begin = used, spot
                    end = begin + size
                size = (end - begin)[which]
                ends = np.cumsum(size)
                flat = np.asarray(ids[np.repeat(begin[which] - (ends - size), size) + np.arange(int(size.sum()))])
                cuts, spans = np.append(0, ends)[np.append(0, np.cumsum(words.each))], np.append(0, np.cumsum(words.each))
                out = part[[f"__{k}" for k in range(len(names))]].copy()
                out["piece_ids"] = [flat[p:q] for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                if back.value:
                    out["__decoded"] = [back.value.of(x) for x in out["piece_ids"]]
                out["__missing"] = [sorted({missing[k] for k in which[p:q].tolist() if k in missing}) or None for p, q in zip(spans[:-1].tolist(), spans[1:].tolist(), strict=True)] if missing else None
                yield out

    def apply(rows: DataFrame) -> DataFrame:
        schema = ", ".join(f"__{k} {f.dataType.simpleString()}" for k, f in enumerate(fields)) + ", piece_ids array<int>" + (", __decoded string" if decoded_col else "") + ", __missing array<string>"
        return rows.select(*[F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(names)], F.col(f"`{text_col}`").alias("__text"), "__more").mapInPandas(run, schema)

    def named(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"__{k}").alias(c) for k, c in enumerate(names)], "piece_ids", *([F.col("__decoded").alias(decoded_col)] if decoded_col else []))

    first = apply(docs.select(*[f"`{c}`" for c in names], F.lit(None).cast(more).alias("__more")))
    if all_sent:
        return named(first)
    digest = [F.xxhash64("__text").alias("__t1"), F.xxhash64("__text", F.lit(1)).alias("__t2")]
    keep = names.index(text_col)
    lacking = first.where("__missing is not null").select(F.col(f"__{keep}").alias("__text"), "__missing").select(*digest, F.explode("__missing").alias("word")).distinct()
    found = lacking.join(known.select("word", "ids"), "word").groupBy("__t1", "__t2").agg(F.collect_list(F.struct("word", "ids")).alias("__more"))
    again = docs.withColumn("__text", F.col(f"`{text_col}`")).select(*[f"`{c}`" for c in names], *digest).join(found, ["__t1", "__t2"], "left")
    return named(apply(again))


class Texts:
    """Texts of ids: pieces joined, byte pieces as their bytes, the marks as spaces and the first dropped."""

    def __init__(self, model: Model):
        text = {i: p.encode() for p, i, _ in model.pieces} | ({i: bytes([b]) for b, i in enumerate(model.bytes)} if model.bytes else {}) | {model.unknown: " ⁇ ".encode()}
        self.none = 1 + max(text)
        each = [text.get(i, b"") for i in range(self.none + 1)]
        self.size = np.array([len(t) for t in each])
        self.first, self.chars = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(each), dtype=np.uint8)

    def of(self, ids: np.ndarray | None) -> str | None:
        if ids is None:
            return None
        x = np.asarray(ids, dtype=np.int64)
        x = np.where((x < 0) | (x > self.none), self.none, x)
        n = self.size[x]
        t = self.chars[np.repeat(self.first[x] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes().decode("utf-8", "replace").replace(SPACE, " ")
        return t[1:] if t.startswith(" ") else t


def decode(rows: DataFrame, ids_col: str = "piece_ids", out_col: str = "decoded", model: Model | None = None) -> DataFrame:
    """``rows`` with the text of their ids.  Null ids give null, none an empty text, unknown pieces U+2047 between
    spaces, ids that are no piece nothing; a column ``out_col`` of the input is replaced."""
    texts = Texts(model or Model.load())
    sent = rows.sparkSession.sparkContext.broadcast(texts)

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return ids.map(sent.value.of)

    return rows.withColumn(out_col, run(F.col(ids_col)))
