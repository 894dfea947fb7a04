"""Full-text search over two columns by an index of positions: phrases, prefixes, AND, OR, NOT, NEAR, columns.

A row's terms are folded: lower case, without diacritics.  The index has a row for each term of a row and column, with
its positions; a search reads the rows of its own terms alone, brings the positions of each text row together, and evaluates the
expression on them.  Texts are read once, when the index is made.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.saved import saved

K1, B = 1.2, 0.75
#: Positions of the second column start here, so that no phrase runs from one column into the next.
COLUMN = 1 << 40
#: Letters with diacritics by the letters that are left without them: what decomposes into an ASCII letter and marks.
FOLDED = {c: d[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if (d := unicodedata.normalize("NFD", c.lower()))[0].isascii() and d[0].isalpha() and len(d) > 1}


class QuerySyntaxError(ValueError):
    """A search expression that isn't well formed."""


def terms_of(text: Column) -> Column:
    """Runs of letters and digits, folded; none for a null text."""
    low = F.lower(F.translate(F.coalesce(text, F.lit("")), "".join(FOLDED), "".join(FOLDED.values())))
    return F.regexp_extract_all(F.regexp_replace(low, r"\p{Mn}+", ""), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def folded_terms(text: str) -> list[str]:
    low = "".join(FOLDED.get(c, c) for c in text).lower()
    return re.findall(r"[^\W_]+", "".join(c for c in low if unicodedata.category(c) != "Mn"))


@dataclass
class Index:
    """``postings(term, id, positions)``, ``sizes(id, n_terms)``, the number of rows and their mean number of terms."""

    postings: DataFrame
    sizes: DataFrame
    rows: int
    mean: float


def index(docs: DataFrame, id_col: str, columns: tuple[str, ...] = ("heading", "content")) -> Index:
    """The index of the text ``columns`` of ``docs``, written in order of terms, so that a search skips the files and row groups of others.

    Ids are taken to be unique; null texts have no terms.  A term's rows are spread over as many partitions as they fill.
    """
    placed = lambda first: lambda t, i: F.struct(t.alias("term"), (i + F.lit(first)).alias("at"))
    each = [F.transform(terms_of(F.col(c)), placed(k * COLUMN)) for k, c in enumerate(columns)]
    rows = docs.select(F.col(id_col).alias("id"), F.concat(*each).alias("ts"))
    sizes = saved(rows.select("id", F.size("ts").alias("n_terms")), "sizes")
    flat = rows.select("id", F.explode("ts").alias("t")).groupBy(F.col("t.term").alias("term"), "id").agg(F.sort_array(F.collect_list("t.at")).alias("positions"))
    total = sizes.agg(F.count("*").alias("n"), F.avg("n_terms").alias("mean")).first()
    return Index(saved(flat.repartitionByRange("term", "id").sortWithinPartitions("term", "id"), "postings"), sizes, total["n"], total["mean"] or 0.0)


@dataclass
class Phrase:
    terms: list[str]
    prefix: bool = False
    first: bool = False
    columns: tuple[int, ...] | None = None


@dataclass
class Near:
    phrases: list[Phrase]
    within: int


@dataclass
class Both:
    left: object
    right: object


@dataclass
class Either:
    left: object
    right: object


@dataclass
class Without:
    left: object
    right: object


_WORDS = re.compile(r'\s*(?:("(?:[^"]|"")*")|([A-Za-z0-9_\u0080-\U0010FFFF]+)|([(){}:+*^,-]))')


class _Reader:
    """Reads an expression: NOT binds before AND, AND before OR; phrases side by side are joined by AND before all of them."""

    def __init__(self, text: str, columns: tuple[str, ...]):
        self.columns, self.at, self.words, self.bracket = columns, 0, [], False
        end = len(text.rstrip())
        at = 0
        while at < end:
            m = _WORDS.match(text, at)
            if not m:
                raise QuerySyntaxError(f"syntax error near {text[at : at + 20]!r}")
            kind = "string" if m[1] else "word" if m[2] else m[3]
            self.words.append((kind, m[1][1:-1].replace('""', '"') if m[1] else m[2] or m[3]))
            at = m.end()

    def next(self, *kinds: str) -> str | None:
        if self.at < len(self.words) and self.words[self.at][0] in kinds:
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def operator(self, name: str) -> bool:
        return self.at < len(self.words) and self.words[self.at] == ("word", name)

    def need(self, *kinds: str) -> str:
        got = self.next(*kinds)
        if got is None:
            raise QuerySyntaxError(f"syntax error near {self.words[self.at][1]!r}" if self.at < len(self.words) else "the expression ends too early")
        return got

    def whole(self):
        out = self.either()
        if self.at < len(self.words):
            raise QuerySyntaxError(f"syntax error near {self.words[self.at][1]!r}")
        return out

    def either(self):
        out = self.both()
        while self.operator("OR"):
            self.at += 1
            out = Either(out, self.both())
        return out

    def both(self):
        out = self.without()
        while self.operator("AND"):
            self.at += 1
            out = Both(out, self.without())
        return out

    def without(self):
        out = self.side_by_side()
        while self.operator("NOT"):
            self.at += 1
            out = Without(out, self.side_by_side())
        return out

    def side_by_side(self):
        out = self.part()
        while not self.bracket and self.at < len(self.words) and self.words[self.at][0] in ("string", "word", "^", "{", "-") and not any(map(self.operator, ("AND", "OR", "NOT"))):
            more = self.part()
            if self.bracket:
                raise QuerySyntaxError("brackets need an operator before them")
            # a phrase without terms takes no part in this
            out = more if _empty(out) else out if _empty(more) else Both(out, more)
        return out

    def part(self, columns: tuple[int, ...] | None = None):
        chosen = self.filter()
        if chosen is not None:
            return self.part(chosen if columns is None else tuple(c for c in chosen if c in columns))
        self.bracket = bool(self.next("("))
        if self.bracket:
            out = self.either()
            self.need(")")
            self.bracket = True
            return _limited(out, columns)
        if self.operator("NEAR") and self.words[self.at + 1 : self.at + 2] == [("(", "(")]:
            self.at += 2
            phrases, within = [self.phrase(columns)], 10
            while (self.at < len(self.words)) and self.words[self.at][0] not in (")", ","):
                phrases.append(self.phrase(columns))
            if self.next(","):
                within = self.need("word")
                if not within.isdigit():
                    raise QuerySyntaxError(f"expected a number, got {within!r}")
            self.need(")")
            return Near([p for p in phrases if p.terms], int(within)) if any(p.terms for p in phrases) else Phrase([])
        return self.phrase(columns)

    def filter(self) -> tuple[int, ...] | None:
        at, other, names = self.at, bool(self.next("-")), []
        if self.next("{"):
            while not self.next("}"):
                names.append(self.need("word", "string"))
        elif (name := self.next("word", "string")) is not None:
            names = [name]
        if not self.next(":"):
            self.at = at
            if other:
                raise QuerySyntaxError("syntax error near '-'")
            return None
        low = [c.lower() for c in self.columns]
        for name in names:
            if name.lower() not in low:
                raise QuerySyntaxError(f"no such column: {name}")
        return tuple(k for k, c in enumerate(low) if (c in [n.lower() for n in names]) != other)

    def phrase(self, columns: tuple[int, ...] | None) -> Phrase:
        first, terms, prefix = bool(self.next("^")), [], False
        while True:
            if any(map(self.operator, ("AND", "OR", "NOT"))):
                raise QuerySyntaxError(f"syntax error near {self.words[self.at][1]!r}")
            terms += folded_terms(self.need("string", "word"))
            if not self.next("+"):
                break
        if self.next("*"):
            prefix = True
        return Phrase(terms, prefix, first, columns)


def _empty(node) -> bool:
    return isinstance(node, Phrase) and not node.terms


def _limited(node, columns: tuple[int, ...] | None):
    """A column filter before brackets holds for all phrases in them."""
    if columns is not None:
        for p in _phrases(node, False):
            p.columns = columns if p.columns is None else tuple(c for c in p.columns if c in columns)
    return node


def _phrases(node, positive: bool = True) -> list[Phrase]:
    if isinstance(node, Phrase):
        return [node]
    if isinstance(node, Near):
        return node.phrases
    return _phrases(node.left, positive) + ([] if positive and isinstance(node, Without) else _phrases(node.right, positive))


def advanced(text: str, columns: tuple[str, ...] = ("heading", "content")):
    """The expression that ``text`` says in the advanced grammar; raises :class:`QuerySyntaxError`."""
    return _Reader(text, columns).whole()


def free(text: str):
    """All words of a free text, each literally, as a phrase of its terms; words without terms say nothing.  None if nothing is left."""
    nodes = [Phrase(ts) for ts in map(folded_terms, text.split()) if ts]
    return reduce(Both, nodes) if nodes else None


def query_terms(query: str, task: str = "") -> list[str]:
    """Words of the query, or of the task if there is none, in lower case, that have at least three bytes."""
    return [w for w in (query or task).lower().split() if len(w.encode()) >= 3]


def _runs(phrase: Phrase, at: dict) -> Column:
    """Where a phrase starts: positions of its first term that all others follow."""
    here = at[phrase.terms[0], phrase.prefix and len(phrase.terms) == 1]
    before = lambda i: lambda x: x - i
    rest = [(i, at[t, phrase.prefix and i == len(phrase.terms) - 1]) for i, t in enumerate(phrase.terms)][1:]
    for i, more in rest:
        here = F.array_intersect(here, F.transform(more, before(i)))
    if phrase.columns is not None:
        here = F.filter(here, lambda x: F.floor(x / COLUMN).isin(list(phrase.columns)))
    return F.filter(here, lambda x: x % COLUMN == 0) if phrase.first else here


def search(idx: Index, node, limit: int | None = 100, weights: tuple[float, ...] = (1.0, 1.0)) -> DataFrame:
    """``id, rank`` of the rows that the expression ``node`` holds for, the best (lowest) first by BM25, ties by id.

    Each phrase of the expression counts, but those after NOT: by its weighted number of places in the row and by
    how many rows have it at all.  In NEAR only places count that lie near enough to the others.  The idf is floored at 1e-6; ``None``, an
    expression of a free text without terms, matches nothing.
    """
    spark = idx.postings.sparkSession
    if node is None or not any(p.terms for p in _phrases(node)):
        return spark.createDataFrame([], f"id {idx.postings.schema['id'].dataType.simpleString()}, rank double")
    leaves = [p for p in _phrases(node, False) if p.terms]
    wanted = list(dict.fromkeys((t, p.prefix and i == len(p.terms) - 1) for p in leaves for i, t in enumerate(p.terms)))
    hit = [F.col("term").startswith(t) if prefix else F.col("term") == t for t, prefix in wanted]
    some = idx.postings.where(reduce(lambda a, b: a | b, hit))
    places = some.groupBy("id").agg(*[F.sort_array(F.flatten(F.collect_list(F.when(h, F.col("positions"))))).alias(f"t{k}") for k, h in enumerate(hit)])
    at = {w: F.col(f"t{k}") for k, w in enumerate(wanted)}

    names: dict[int, str] = {}
    for p in leaves:
        names.setdefault(id(p), f"p{len(names)}")
    places = places.select("id", *[_runs(p, at).alias(names[id(p)]) for p in leaves])

    near: dict[str, Column] = {}

    def holds(n) -> Column:
        if isinstance(n, Phrase):
            return F.size(names[id(n)]) > 0 if n.terms else F.lit(False)
        if isinstance(n, Near):
            return reduce(lambda a, b: a & b, [F.size(near[names[id(p)]]) > 0 for p in n.phrases])
        left, right = holds(n.left), holds(n.right)
        return left & right if isinstance(n, Both) else left | right if isinstance(n, Either) else left & ~right

    def each_near(n) -> None:
        if isinstance(n, Near):
            spans = [(names[id(p)], len(p.terms) + n.within) for p in n.phrases]
            covers = lambda m, w: lambda y: (y <= m) & (m <= y + w)
            ends = F.filter(F.array_distinct(F.concat(*[F.col(c) for c, _ in spans])), lambda m: reduce(lambda a, b: a & b, [F.exists(c, covers(m, w)) for c, w in spans]))
            kept = lambda w: lambda y: F.exists(ends, lambda m: (y <= m) & (m <= y + w))
            for c, w in spans:
                near[c] = F.filter(c, kept(w))
        elif not isinstance(n, Phrase):
            each_near(n.left)
            each_near(n.right)

    each_near(node)
    table = F.array(*[F.lit(float(w)) for w in weights])
    counted = [p for p in _phrases(node) if p.terms]
    weight = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + F.element_at(table, (F.floor(x / COLUMN) + 1).cast("int")))
    freq = [weight(near.get(names[id(p)], F.col(names[id(p)]))).alias(f"f{k}") for k, p in enumerate(counted)]
    had = [(F.size(names[id(p)]) > 0).alias(f"h{k}") for k, p in enumerate(counted)]
    rows = saved(places.select("id", holds(node).alias("holds"), *freq, *had), "hits")
    df = rows.agg(*[F.count_if(f"h{k}").alias(f"d{k}") for k in range(len(counted))]).first()
    sized = rows.where("holds").join(idx.sizes, "id")
    score = F.lit(0.0)
    for k in range(len(counted)):
        d, f = df[f"d{k}"], F.col(f"f{k}")
        idf = F.greatest(F.log(F.lit((idx.rows - d + 0.5) / (d + 0.5))), F.lit(1e-6))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n_terms") / F.lit(max(idx.mean, 1e-9))))
    out = sized.select("id", (-score).alias("rank"))
    return out.orderBy("rank", "id").limit(limit) if limit else out
