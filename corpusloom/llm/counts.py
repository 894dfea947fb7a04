"""Token counts that follow edits: a segment tree of pre-token blocks for each document."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How far beyond its end a pre-token's match can look.
_LOOK = 3


class Counter(dict):
    """Tokens of a pre-token; remembers up to ``most`` of them."""

    def __init__(self, path: str, most: int = 300_000):
        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder, self.most = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), most

    def __missing__(self, piece: str) -> int:
        n = len(self.coder.encode_ordinary(piece)) if piece else 0
        if len(self) < self.most:
            self[piece] = n
        return n


_SPLIT = regex.compile(PATTERN)


class Tree:
    """Sums of characters and tokens over a document's leaves.

    A leaf is a run of whole pre-tokens; node 1 is the root, and node i has children 2i and 2i + 1.
    """

    def __init__(self, leaves: list[tuple[int, int]]):
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.chars = np.zeros(2 * self.width, dtype=np.int64)
        self.tokens = np.zeros(2 * self.width, dtype=np.int64)
        for i, (c, t) in enumerate(leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = c, t
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.width
        self.chars[i], self.tokens[i] = chars, tokens
        while i > 1:
            i //= 2
            self._sum(i)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last leaf, at the end) and where that leaf starts."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if at >= start + self.chars[i] and (self.chars[i + 1] or at > start + self.chars[i]):
                start += int(self.chars[i])
                i += 1
        return i - self.width, start

    def leaves(self) -> list[tuple[int, int]]:
        return [(int(c), int(t)) for c, t in zip(self.chars[self.width :], self.tokens[self.width :], strict=True) if c]


def leaves_of(text: str, count: Counter, size: int) -> list[tuple[int, int]]:
    """(characters, tokens) of each leaf: whole pre-tokens up to ``size`` characters or more."""
    out, chars, tokens = [], 0, 0
    for piece in _SPLIT.findall(text):
        chars += len(piece)
        tokens += count[piece]
        if chars >= size:
            out.append((chars, tokens))
            chars = tokens = 0
    return [*out, (chars, tokens)] if chars or not out else out


def edit(text: str, tree: Tree, start: int, length: int, insert: str, count: Counter, size: int) -> tuple[str, Tree, int]:
    """The text and tree after replacing ``length`` characters at ``start`` (both clipped to the text), and
    how many characters were encoded again.

    Encoding starts at the leaf that holds the character ``_LOOK`` before the edit: a pre-token that ends
    earlier can't see it.  It goes on until a pre-token ends where an untouched leaf begins; from there the
    text is as it was, so its leaves stay.
    """
    start = max(0, min(start, len(text)))
    length = max(0, min(length, len(text) - start))
    new, shift = text[:start] + insert + text[start + length :], len(insert) - length
    first, begin = tree.find(max(0, start - _LOOK))
    last, end = first, begin + int(tree.chars[tree.width + first])
    at, tokens, stop = begin, 0, False
    for m in _SPLIT.finditer(new, begin):
        at = m.end()
        tokens += count[m.group()]
        while end < len(text) and (end < start + length or end + shift < at):
            last += 1
            end += int(tree.chars[tree.width + last])
        if end >= start + length and end + shift == at:
            stop = True
            break
    if not stop:
        last, at = tree.width - 1, len(new)
    for leaf in range(first + 1, last + 1):
        if tree.chars[tree.width + leaf]:
            tree.put(leaf, 0, 0)
    tree.put(first, at - begin, tokens)
    if at - begin > 8 * size:
        kept = [(int(c), int(t)) for c, t in zip(tree.chars[tree.width :], tree.tokens[tree.width :], strict=True)]
        tree = Tree([x for x in kept[:first] if x[0]] + leaves_of_region(new, begin, at, count, size) + [x for x in kept[first + 1 :] if x[0]])
    return new, tree, at - begin


def leaves_of_region(text: str, begin: int, end: int, count: Counter, size: int) -> list[tuple[int, int]]:
    """As :func:`leaves_of` for part of a text between two pre-token boundaries, seen in its context."""
    out, chars, tokens = [], 0, 0
    for m in _SPLIT.finditer(text, begin):
        if m.start() >= end:
            break
        chars += m.end() - m.start()
        tokens += count[m.group()]
        if chars >= size:
            out.append((chars, tokens))
            chars = tokens = 0
    return [*out, (chars, tokens)] if chars else out


def count_with_edits(docs: DataFrame, edits_col: str = "edits", id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = 400, ranks: str = RANKS) -> DataFrame:
    """Counts tokens of every row before and after its edits.

    ``edits_col`` is an array of structs (start, length, insert), applied in order; start and length count
    characters of the text as the edits before left it.  Returns ``id_col, text`` (edited), ``n_before,
    n_after, n_edits, encoded_again`` (characters), and the tree's two arrays of sums.  Null texts are
    empty, null edits none, null fields of an edit 0 or empty.  The vocabulary file is handed to the
    executors by Spark.  Rows don't meet one another; an empty table gives none.
    """
    docs.sparkSession.sparkContext.addFile(ranks)
    name, kind = os.path.basename(ranks), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = Counter(SparkFiles.get(name))
        for b in batches:
            rows = []
            for text, edits in zip(b["text"], b["edits"], strict=True):
                text = text or ""
                tree, again = Tree(leaves_of(text, count, leaf_chars)), 0
                before = int(tree.tokens[1])
                for e in edits if edits is not None else ():
                    text, tree, n = edit(text, tree, int(e["start"] or 0), int(e["length"] or 0), e["insert"] or "", count, leaf_chars)
                    again += n
                rows.append((text, before, int(tree.tokens[1]), len(edits) if edits is not None else 0, again, tree.chars, tree.tokens))
            out = pd.DataFrame(rows, columns=["text", "n_before", "n_after", "n_edits", "encoded_again", "tree_chars", "tree_tokens"])
            out.insert(0, id_col, b["id"].to_numpy())
            yield out

    schema = f"`{id_col}` {kind}, text string, n_before bigint, n_after bigint, n_edits int, encoded_again bigint, tree_chars array<bigint>, tree_tokens array<bigint>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(edits_col).alias("edits")).mapInPandas(run, schema)


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", order_col: str = "seq") -> DataFrame:
    """``docs`` with the rows of ``edits`` (``id_col, order_col, start, length, insert``) as an array for each
    document, in order; ready for :func:`count_with_edits`."""
    each = edits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(order_col, "start", "length", "insert"))).alias("edits"))
    each = each.withColumn("edits", F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["length"].alias("length"), e["insert"].alias("insert"))))
    return docs.join(each, id_col, "left")
