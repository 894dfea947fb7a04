"""Periodic runs against all periods tried one by one."""

import hashlib
import random
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import queries, runs

SF = "/root/testdata/sf0.001"


def plain(a, least=24, times=3):
    n, out = len(a), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if a[i] != a[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and a[j] == a[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least, times * q) and not any(all(a[k] == a[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                out.add((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng, k):
    out = []
    while rng.random() < 0.8:
        unit = [b"%d" % rng.randrange(k) for _ in range(rng.randint(1, 20))]
        out += unit * rng.choice([1, 1, 2, 3, 5]) + unit[: rng.randint(0, len(unit))]
    return out


def test_lyndon_array():
    rng = random.Random(1)
    for _ in range(1500):
        a = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 25))]
        want = []
        for i in range(len(a)):
            j = i + 1
            while j < len(a) and a[j:] > a[i:]:
                j += 1
            want.append(j - i)
        assert runs.lyndon_array(a) == want


def test_runs_of_any_exponent():
    rng = random.Random(2)
    for _ in range(600):
        a = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 20))] * rng.choice([1, 1, 2, 3])
        for least, times in ((2, 2), (3, 3), (6, 2)):
            assert [tuple(r) for r in runs.runs_of(np.array(a, dtype=np.int64), least, times).tolist()] == plain(a, least, times)


def test_documents_of_a_batch():
    rng = random.Random(3)
    for _ in range(150):
        docs = [some_words(rng, rng.choice([2, 5, 50])) for _ in range(rng.randint(1, 4))]
        assert [[tuple(r) for r in x.tolist()] for x in runs._in_batch(docs, 24, 3)] == [plain(d) for d in docs]


def digest_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    each = plain(words)
    best = min(each, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    keep = [w for i, w in enumerate(words) if not any(s + q <= i < s + size for s, size, q in each)]
    return (doc_id, len(each), *best, 1000 * best[1] // best[2] if each else None, hashlib.sha256("".join("%d,%d,%d\n" % r for r in each).encode()).hexdigest(), hashlib.sha256(b" ".join(keep)).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_periodic_runs(spark, SF).collect()}
    short = [d for d in docs if len((d["text"] or "").split()) <= 700]
    assert len(got) == len(docs) and len(short) > 100
    want = {d["doc_id"]: digest_row(d["doc_id"], d["text"]) for d in short}
    assert {i: got[i] for i in want} == want
    assert sum(r[1] > 0 for r in want.values()) > 5


def test_edges(spark):
    texts = [None, "", " \t\r\n", "a", "la " * 40, "la " * 40, "a b \x1c " * 30, "x " * 23, "x " * 24, "ab cd ef " * 8 + "z " + "ab cd ef " * 9, "one two three four " * 25_000, "😀 " * 30]
    rows = [(i, t, "c", 1) for i, t in enumerate(texts)] + [(4, "la " * 40, "d", 2), (None, "q r " * 20, "e", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, __id int")
    got = runs.periodic_runs(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["n_runs"] for i in range(12)] == [0, 0, 0, 0, 1, 1, 1, 0, 1, 2, 1, 1]
    assert by[0]["collapsed"] == by[1]["collapsed"] == by[2]["collapsed"] == "" and by[0]["start"] is None
    assert by[4]["collapsed"] == "la" and by[9]["collapsed"] == "ab cd ef z ab cd ef" and by[10]["length"] == 100_000 and by[10]["period"] == 4
    assert by[None]["n_runs"] == 1 and by[None]["period"] == 2
    assert runs.periodic_runs(docs.where("false")).count() == 0
    assert [r["n_runs"] for r in runs.periodic_runs(docs.where("doc_id = 7"), least=2, times=2).collect()] == [1]
    folded = runs.periodic_runs(docs.withColumn("doc_id", F.lit(None).cast("bigint")), change=runs.folded, digests=True)
    assert folded.where("n_runs > 0").count() == 9
