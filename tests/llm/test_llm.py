"""The operators against plain versions, on small tables with nulls, empties, ties and repeats."""

import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import audio, counts, embeddings, lines, mixing, ngrams, pieces, simhash, toxicity, urls

TEXTS = ["a b c d e f", "A b C d e f", "", None, "x" * 500, "one two", "one two", "the cat\nsat on the mat today again\n\nthe end", "über 12 naïve 💩 \t  tabs  and   spaces "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 2}" if i % 4 else None, "clash") for i, t in enumerate(TEXTS)] + [(None, "a b c d e f", "s0", "x"), (5, "one two", "s1", "y")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, fp string")


def test_simhash_by_hand(docs):
    def plain(t):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    ids = [r["doc_id"] for r in docs.collect()]
    fps = [plain(r["text"]) for r in docs.collect()]
    up = {f: f for f in fps}
    for _ in fps:
        for a in up:
            for b in up:
                if (a ^ b).bit_count() <= 2:
                    up[a] = up[b] = min(up[a], up[b])
    want = sorted((str(i), f"{f:016x}", min(j for j, g in zip(ids, fps) if j is not None and up[g] == up[f])) for i, f in zip(ids, fps))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want


def test_simhash_links_all_within_distance(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 30).tolist()
    vals = sorted({b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (6, 2))} | set(base))
    got = {frozenset((r["a"], r["b"])) for r in simhash.links(spark.createDataFrame([(v,) for v in vals], "fp bigint")).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in map(tuple, got))

    def groups(pairs):
        up = {v: v for v in vals}
        for _ in range(20):
            for a, b in pairs:
                up[a] = up[b] = min(up[a], up[b])
        return up

    assert groups(map(tuple, got)).keys() == set(vals)
    want = [(a, b) for a in vals for b in vals if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert groups([tuple(x) for x in got]) == groups(want)


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    v = np.vstack([base, base[:20] + rng.normal(scale=0.2, size=(20, 8)), base[:5], 3 * base[:5]]).astype(np.float32)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, []), (904, [None] + [1.0] * 7)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), n_blocks=3, chunk=7).collect()}
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert {i: got[i]["n_links"] for i in range(len(v))} == dict(enumerate(near.sum(axis=1).tolist()))
    root = np.arange(len(v))
    for _ in v:
        root = np.minimum(root, np.where(near, root[None, :], 10**6).min(axis=1))
    assert [got[i]["component_id"] for i in range(len(v))] == root.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i in range(900, 905))


def test_urls(spark):
    u = ["http://A.Example.net/en/1", "http://x.net", "http://example.net/de/", None, "no", "https://a.org/fr/x?y#z", "http://example.com/de/a/b", "ftp://notnet/x/", "http://net/"]
    got = urls.judge(spark.createDataFrame([(i, x) for i, x in enumerate(u)], "page_id bigint, url string"), ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"])
    want = [("example.net/en/", "allow"), (None, "allow"), ("net/", "block"), (None, "allow"), (None, "allow"), ("org/fr/", "allow"), ("example.com/de/", "block"), (None, "allow"), ("net/", "block")]
    assert [(r["rule"], r["verdict"]) for r in got.orderBy("page_id").collect()] == want


def test_mixing(spark, docs):
    w, alpha, budget = mixing.temperature_weights({"a": 900, "b": 90, "c": 10, "d": 0}, max_repeats=3.0)
    assert 0 < alpha < 1 and max(budget * w[s] / n for s, n in (("a", 900), ("b", 90), ("c", 10))) == pytest.approx(3.0, rel=1e-6)
    assert min(budget * w[s] / n for s, n in (("a", 900), ("b", 90), ("c", 10))) == pytest.approx(1.0)
    w, _, _ = mixing.temperature_weights({"a": 900, "b": 90, "c": 10}, entropy=0.8)
    assert -sum(x * np.log(x) for x in w.values()) == pytest.approx(0.8)
    rows = [(i, "w " * (1 + i % 5), "big" if i % 10 else "small") for i in range(400)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), max_repeats=2.0, block_rows=16).toPandas()
    tokens = {i: len(t.split(" ")) for i, t, _ in rows}
    spent = out.assign(t=out.doc_id.map(tokens)).groupby("source").t.sum()
    have = {s: sum(tokens[i] for i, _, x in rows if x == s) for s in ("big", "small")}
    w, _, budget = mixing.temperature_weights(have, max_repeats=2.0)
    assert all(budget * w[s] - 1 <= spent[s] <= budget * w[s] + 6 for s in have)
    assert mixing.mix(docs).count() >= docs.count()


def test_edit_distance_and_lines(spark):
    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            d, o = [i + 1], d
            for j, y in enumerate(b):
                d.append(min(o[j] + (x != y), o[j + 1] + 1, d[j] + 1))
        return d[-1]

    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 12))) for _ in range(2))
        assert lines.edit_distance(a, b, 20) == plain(a, b)
        assert lines.edit_distance(a, b, 3) == min(plain(a, b), 4)
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    rows = [(1, f"first\n{long}"), (2, f"{long.upper()}\nkept here"), (3, long + " "), (4, None), (5, ""), (6, "too short\ntoo short")]
    out = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[1]["text"] == rows[0][1] and out[2]["text"] == "kept here" and 3 not in out
    assert out[4]["text"] is None and out[5]["text"] == "" and out[6]["lines_dropped"] == 1 and out[6]["text"] == "too short"
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_lm_base_score(docs):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    rows, seen = docs.collect(), Counter()
    out = [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in rows]
    for r, h in zip(rows, out):
        if not h:
            seen.update(ngrams.words(r["text"]))
    n, v = sum(seen.values()), len(seen)
    want = sorted((str(r["doc_id"]), round(sum(np.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ngrams.words(r["text"])), 6), sum(seen[w] > 0 for w in ngrams.words(r["text"]))) for r in rows)
    got = ngrams.score(docs, held, max_frequent=2).collect()
    assert sorted((str(r["doc_id"]), round(r["base_score"], 6), r["n_known"]) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}


def test_lm_score_by_exact_counts(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{min(int(x), 60)}" for x in rng.zipf(1.3, int(rng.integers(0, 60)))) for _ in range(120)] + [None, "", "only once here"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    one, two = Counter(), Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            w = ngrams.words(t)
            one.update(w)
            two.update(zip([ngrams.END, *w], w))
    n, v = sum(one.values()), len(one)

    def middle(c):  # what the filter keeps of a count
        return 0 if not c else 1 if c == 1 else 2 ** (int(np.log2(c)) + 0.5)

    def plain(t):
        w, out = ngrams.words(t), 0.0
        for a, b in zip([ngrams.END, *w], w):
            mass, base = 2.0 + one[a], (one[b] + 0.5) / (n + 0.5 * (v + 1))
            out += np.log10((min(middle(two[a, b]), one[a]) + mass * base) / (one[a] + mass))
        return out

    got = {r["doc_id"]: r["score"] for r in ngrams.score(d, held).collect()}
    assert got == pytest.approx({i: plain(t) for i, t in enumerate(texts)}, abs=0.3)
    apart = {r["doc_id"]: r["score"] for r in ngrams.score(d, held, max_bits=0).collect()}
    assert apart == pytest.approx(got, abs=1e-9)
    assert ngrams.score(d.where("false"), held).count() == 0
    full = ngrams.Filter(1, 64, bits=np.full(8, 255, dtype=np.uint8))
    assert full.levels(np.arange(3, dtype=np.uint64), 20).tolist() == [20, 20, 20]


def test_edits_keep_the_count():
    count, rng = counts.Counter(counts.RANKS), np.random.default_rng(5)
    for _ in range(150):
        text = "".join(rng.choice(list("ab 1\n'!  st"), rng.integers(0, 300)))
        tree = counts.Tree(counts.leaves_of(text, count, 20))
        for _ in range(6):
            at, k = int(rng.integers(0, len(text) + 2)), int(rng.integers(0, 30))
            text, tree, _ = counts.edit(text, tree, at, k, "".join(rng.choice(list("ab 's\n"), rng.integers(0, 40))), count, 20)
            assert tree.chars[1] == len(text) and tree.tokens[1] == len(count.coder.encode_ordinary(text))


def test_audio_aligns(spark):
    rng = np.random.default_rng(2)
    song = [f"w{int(i)}" for i in rng.integers(0, 9999, 120)]
    other = [f"v{int(i)}" for i in rng.integers(0, 9999, 120)]
    rows = [(0, " ".join(song)), (1, " ".join(other[:30] + song[20:100])), (2, " ".join(other)), (3, " ".join(song)), (50, None), (100, "")]
    prints = audio.fingerprints(audio.recordings(spark.createDataFrame(rows, "id bigint, text string"), ["id"]), ["id"])
    got = audio.align(prints, ["id"], F.col("id") % 50 == 0).collect()
    hit = [r for r in got if r["id"] == 0 and r["matched"]]
    assert [r["matched"]["id"] for r in hit] == [1] and hit[0]["shift"] == 10 and hit[0]["errors"] <= 0.25
    assert {r["id"] for r in got} == {0, 50, 100}


def test_pieces_as_the_library(spark, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    more = docs.withColumn("piece_ids", F.lit("clash")).union(spark.createDataFrame([(70, "Thedhe.### anblewh### " * 3000, "s", "x", "y"), (71, "ñ" * 70 + "é日本語" * 30 + "\x00\r\n\u2028\U0001f600", "s", "x", "y")], "doc_id bigint, text string, source string, fp string, piece_ids string"))
    model = pieces.Model.load()
    assert model.one_pass
    for most, one_pass in ((4_000_000, True), (5, True), (0, False)):
        model.one_pass = one_pass
        got = (pieces.encode(more, max_sent=most, model=model, decoded_col="decoded") if one_pass else pieces.decode(pieces.encode(more, max_sent=most, model=model))).collect()
        assert len(got) == docs.count() + 2
        assert all(r["piece_ids"] == lib.encode(r["text"] or "") and r["decoded"] == (r["text"] or "") for r in got)
    empty = pieces.decode(pieces.encode(docs.where("false")))
    assert empty.count() == 0 and empty.columns == [*docs.columns, "piece_ids", "decoded"]


def test_viterbi_as_the_library(spark, tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    rng, proto = np.random.default_rng(4), sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(pieces.MODEL, "rb").read())
    table = {"".join(rng.choice(list("abc"), int(rng.integers(1, 6)))): -float(rng.integers(2, 60)) / 4 for _ in range(60)} | {c: -9.5 - i / 8 for i, c in enumerate("abc▁")} | {"▁ab": -3.0, "▁a": -2.5}
    kept = [x for x in proto.pieces if x.type != 1]
    del proto.pieces[:]
    proto.pieces.extend(kept)
    for piece, at in sorted(table.items()):
        proto.pieces.add(piece=piece, score=at, type=1)
    proto.trainer_spec.model_type, proto.trainer_spec.vocab_size = 1, len(proto.pieces)
    path = str(tmp_path / "unigram.model")
    open(path, "wb").write(proto.SerializeToString())
    lib, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Model.load(path)
    texts = ["".join(rng.choice(list("abcd  é"), int(rng.integers(1, 40)))) for _ in range(150)] + ["abc" * 40, "", None]
    got = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model=model).collect()

    def total(ids):
        return sum(x.score if (x := proto.pieces[i]).type == 1 else 0 for i in ids), len(ids)

    for r in got:
        want = lib.encode(r["text"] or "")
        assert "".join(lib.id_to_piece(i) for i in r["piece_ids"]) == "".join(lib.id_to_piece(i) for i in want)
        assert total(r["piece_ids"])[0] == pytest.approx(total(want)[0], abs=1e-4)


def test_toxicity(spark):
    rows = [(i, f"some plain words here number {i % 7} " + ("what a blargle thing" if i % 5 == 0 else "all fine"), i % 5 == 0) for i in range(300)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id bigint, text string")
    model = toxicity.fit(d, spark.createDataFrame([(i, int(y)) for i, _, y in rows[:200]] + [(None, 1), (5000, None)], "doc_id bigint, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    assert all((got[i] >= 0.7) == y for i, _, y in rows) and got[900] < 0.5 and got[901] < 0.5
    assert toxicity.fit(d, spark.createDataFrame([], "doc_id bigint, toxic int")).score("x") == 0.0


def test_near_copies_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    texts = []
    for _ in range(40):
        base = [f"w{int(i)}" for i in rng.integers(0, 10**6, int(rng.integers(40, 400)))]
        for changes in (0, 1, len(base) // 60, len(base) // 40, len(base) // 20):
            t = list(base)
            for at in rng.choice(len(t), changes, replace=False):
                t[at] = f"x{int(rng.integers(0, 10**6))}"
            texts.append(" ".join(t))
    texts += ["", None, "one two", "One TWO"]
    got = {r["doc_id"]: r["root"] for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), width=5, similarity=0.8).collect()}

    def cut(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, up, apart = [cut(t) for t in texts], list(range(len(texts))), 0
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in pairs:
            up[i] = up[j] = min(up[i], up[j])
    fps = [simhash.fingerprint(t, 5) for t in texts]
    apart = sum(((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() > 2 for i, j in pairs)
    assert apart > 40  # out of reach of the 2-bit rule
    assert [[got[i] == got[j] for j in got] for i in got] == [[up[i] == up[j] for j in got] for i in got]


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(300)]
    near = [*base[:100], "changed", *base[101:200], "words", *base[201:]]
    rows = [(2, " ".join(near)), (1, " ".join(base)), (3, " ".join(base[:150])), (None, " ".join(base))]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [1, 3, None]


def test_lines_with_one_changed_word(spark):
    rng, rows = np.random.default_rng(11), []
    for n in range(10, 41):
        for _ in range(4):
            line = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(4, 8)))) for _ in range(n)]
            other = list(line)
            other[int(rng.integers(n))] = "".join(rng.choice(list("qrstuvwxyz"), 6))
            rows += [(2 * len(rows), " ".join(line)), (2 * len(rows) + 1, " ".join(other))]
    got = {r["doc_id"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), similarity=0.8).collect()}
    assert got == {a for a, _ in rows[::2]}


def test_audio_reports_own_copies(spark):
    song = " ".join(f"w{i}" for i in range(60))
    rows = [(0, song), (1, song), (7, song), (50, "so short"), (51, "so short"), (52, "not the same"), (100, "")]
    prints = audio.fingerprints(audio.recordings(spark.createDataFrame(rows, "id bigint, text string"), ["id"]), ["id"])
    got = {r["id"]: r for r in audio.align(prints, ["id"], F.col("id").isin(7, 50, 52, 100)).collect()}
    assert {i: (r["recording"] and r["recording"]["id"], r["own_copies"]) for i, r in got.items()} == {7: (0, 3), 50: (50, 2), 52: (52, 1), 100: (None, None)}


def test_pipeline_keeps_texts_that_share_an_id(spark):
    import corpus_pipeline

    one, two = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    rows = [(1, one, "y"), (1, two, "x"), (1, one, "x"), (2, two, "x"), (3, one, "a")]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "")
    assert sorted(tuple(r) for r in out.collect()) == [(1, one, "x"), (1, two, "x")]
