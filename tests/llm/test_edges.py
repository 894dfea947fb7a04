"""Edge cases of every operator and pipeline stage, and the pipeline's stages against plain versions."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import audio, counts, embeddings, lines, mixing, ngrams, pieces, simhash, toxicity, urls

#: Names that operators use themselves.
CLASHES = "score fp full block_cut row_cut weight mix_epoch mix_block mix_order lines_dropped piece_ids uid held chunk seg word edges root variant gid size s k host path rule verdict tk n __drops __rk __dropped __toxic h1 h2 gid rk id no toxic_score nth text_key own_dropped".split()
LONG = "alpha beta gamma " * 20_000


@pytest.fixture(scope="module")
def table(spark):
    texts = [None, "", "  \n\t ", "one", "same line of text here", "same line of text here", "é\U0001f600 ünï", LONG, "a b c d e f g h\n\nsame line of text here"]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id here at all", None, "s0", 1), (5, "another text of this id", "en", "s1", 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="module")
def clashing(table):
    return table.withColumns({c: F.lit(c) for c in CLASHES})


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(9)] + [(None, 1), (4, None), (5, 0)], "doc_id bigint, toxic int")


OPERATORS = {
    "pieces": lambda s, d: pieces.encode(d, decoded_col="decoded").where("coalesce(text, '') = decoded"),
    "lines": lambda s, d: lines.dedup_lines(d, drop_emptied=False),
    "counts": lambda s, d: counts.count_with_edits(d.withColumn("edits", F.lit(None).cast("array<struct<start:int,length:int,insert:string>>"))),
    "audio": lambda s, d: audio.fingerprints(audio.recordings(d.withColumn("text", F.substring("text", 1, 500)), ["doc_id"]), ["doc_id"]),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, labels(s)), keep=tuple(d.columns)),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "near_copies": lambda s, d: simhash.near_copies(d),
    "urls": lambda s, d: urls.judge(d, ["net/"], [], id_col="doc_id", url_col="text"),
    "ngrams": lambda s, d: ngrams.score(d, F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False))),
    "embeddings": lambda s, d: embeddings.near_duplicates(d.withColumn("embedding", F.array(F.col("doc_id").cast("float"), F.lit(1.0).cast("float"))), id_col="doc_id"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_comes_back(spark, table, clashing, name):
    plain, run = OPERATORS[name](spark, table), OPERATORS[name]
    assert plain.count() == table.count()
    assert run(spark, clashing).count() == table.count()
    assert run(spark, table.where("false")).count() == 0
    assert set(run(spark, table.where("false")).columns) == set(plain.columns)


def test_mixing_edges(spark, table, clashing):
    out = mixing.mix(clashing)
    assert out.count() == mixing.mix(table).count() >= table.count()
    assert {"full", "block_cut", "row_cut"} <= set(out.columns) and out.schema["mix_order"].dataType.simpleString() == "bigint"
    assert mixing.mix(table.where("false")).count() == 0
    assert mixing.mix(table.select("doc_id", "source", F.lit("").alias("text"))).count() == table.count()


def test_stages_keep_columns_and_clean_rows(spark, table, clashing, tmp_path):
    import corpus_pipeline

    labels(spark).withColumn("quality", F.lit(1)).write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (table, clashing, table.where("false")):
            out = stage(spark, docs, str(tmp_path))
            want = docs.columns if name != "sentencepiece" else [*[c for c in docs.columns if c != "piece_ids"], "piece_ids"]
            assert out.columns == want
            n = out.count()
            assert (n == 0) == docs.isEmpty()
            if name in ("mixing", "sentencepiece"):
                assert n >= docs.count()
            if docs is clashing:
                own = [c for c in CLASHES if c != "piece_ids"]
                assert [tuple(r) for r in out.select(*[F.col(f"`{c}`") for c in own]).distinct().collect()] == [tuple(own)]
    assert corpus_pipeline.dedup_lines(spark, table, "").where("text is null or text = ''").count() == 2


def test_simhash_stage_keeps_rows_of_any_type(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a b c d e f", {"k": 2}, b"x"), (1, "a b c d e f", {"k": 1}, b"y"), (2, "a b c d e f", {}, None), (3, "other text", None, None)], "doc_id long, text string, n map<string,int>, tk binary")
    got = sorted((r["doc_id"], r["n"], r["tk"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == [(1, {"k": 1}, bytearray(b"y")), (3, None, None)]


def test_alike_pairs_is_alike():
    rng = np.random.default_rng(11)
    xs = [" ".join("".join(rng.choice(list("abcd"), int(rng.integers(1, 7)))) for _ in range(int(rng.integers(1, 12)))) for _ in range(120)]
    ys = [x if k % 3 == 0 else " ".join(w for w in x.split(" ") if rng.random() > 0.15) or "a" if k % 3 == 1 else xs[k - 1] for k, x in enumerate(xs)]
    assert lines.alike_pairs(xs, ys, 0.8) == [lines.edit_distance(x, y, 10**6) <= int(0.2 * max(len(x), len(y)) + 1e-9) for x, y in zip(xs, ys, strict=True)]


def test_alike_pairs_of_long_lines():
    rng = np.random.default_rng(31)
    xs, ys = [], []
    for k, n in enumerate([1, 2, 20, 63, 64, 65, 127, 128, 129, 300, 700, 5000] * 8):
        x = "".join(rng.choice(list("abcdé中😀 " if k % 2 else "ab "), n))
        y = "".join(c for c in x if rng.random() > 0.03 * (k // 12)) + "z" * (k % 3)
        xs.append(x if k % 5 else y)
        ys.append(y if k % 5 else x)
    want = [lines.edit_distance(x, y, 10**6) <= int(0.2 * max(len(x), len(y)) + 1e-9) for x, y in zip(xs, ys, strict=True)]
    assert lines.alike_pairs(xs, ys, 0.8) == want and 10 < sum(want) < 90


def test_parts_bound_the_edit_distance():
    rng = np.random.default_rng(32)
    flat = [rng.integers(97, 101, int(rng.integers(1, 400))).astype("<u4") for _ in range(60)]
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(flat[::2], flat[1::2], strict=True)]
    pairs += [(x[: len(x) - 3], x) for x in flat if len(x) > 3]
    text = lambda x: x.tobytes().decode("utf-32-le")
    full = [lines.edit_distance(text(x), text(y), 10**6) for x, y in pairs]
    low = lines._parted([x for x, _ in pairs], [y for _, y in pairs], np.array(full))
    assert all(a <= b for a, b in zip(low.tolist(), full, strict=True)) and (low > 0).any()


def test_line_stage_against_all_pairs(spark):
    import corpus_pipeline

    rng = np.random.default_rng(21)
    base = [" ".join("".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 8)))) for _ in range(int(rng.integers(4, 30)))) for _ in range(25)]
    texts = []
    for _ in range(40):
        out = []
        for _ in range(int(rng.integers(1, 6))):
            words = base[int(rng.integers(len(base)))].split(" ")
            if rng.random() < 0.4:
                words[int(rng.integers(len(words)))] += "x"
            out.append(" ".join(words))
        texts.append("\n".join(out))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), "").collect()}
    flat = [(i, n, line) for i, t in enumerate(texts) for n, line in enumerate(t.split("\n"))]
    up = list(range(len(flat)))
    near = [(a, b) for a in range(len(flat)) for b in range(a) if lines.edit_distance(flat[a][2], flat[b][2], 10**6) <= 0.2 * max(len(flat[a][2]), len(flat[b][2])) + 1e-9]
    for _ in flat:
        for a, b in near:
            up[a] = up[b] = min(up[a], up[b])
    want = {}
    for k, (i, _, line) in enumerate(flat):
        if up[k] == k:
            want.setdefault(i, []).append(line)
    assert got == {i: "\n".join(x) for i, x in want.items()}


def test_alike_is_the_edit_distance():
    rng = np.random.default_rng(9)
    for _ in range(300):
        a = " ".join("".join(rng.choice(list("abc"), int(rng.integers(1, 6)))) for _ in range(int(rng.integers(1, 12))))
        b = "".join(c for c in a if rng.random() > 0.08) if rng.random() < 0.5 else " ".join(w for w in a.split(" ") if rng.random() > 0.2)
        b = " ".join(b.split()) or "a"
        most = int(0.2 * max(len(a), len(b)) + 1e-9)
        assert lines.alike(a, b, 0.8) == (lines.edit_distance(a, b, 10**6) <= most)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(5)
    y = rng.random(6000) < 0.3
    hit = np.array([[0.02, 0.5], [0.05, 0.6], [0.01, 0.3], [0.02, 0.4]])
    votes = np.stack([np.where(rng.random(6000) < hit[v, y.astype(int)], 1, -1) for v in range(4)], axis=1)
    votes = np.hstack([votes, votes[:, :1], np.where((votes == 1).any(axis=1), -1, 0)[:, None]])  # a copy of the first voter
    guess = np.full((2, 6, 3), 1e-3)
    for c in (0, 1):
        for v in range(5):
            p = (0.05, 0.4)[c]
            guess[c, v] = (1 - p, 1e-3, p)
        guess[c, 5] = ((0.1, 0.85)[c], (0.9, 0.15)[c], 1e-3)
    post, rate, tie = toxicity.label_model(votes, np.ones(6000), 0.3, guess, np.array([50.0, 50.0]))
    assert ((post > 0.5) == y).mean() > 0.9
    assert tie[0, 4] > 0.95 and tie[0, 1] < 0.2
    assert np.abs(rate[1, :4, 2] - hit[:, 1]).max() < 0.12 and np.abs(rate[0, :4, 2] - hit[:, 0]).max() < 0.06


def test_toxicity_held_out(spark):
    from corpusloom.llm import queries

    sf = "/root/testdata/sf0.1"
    out = queries.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["n"] for r in out.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    caught, false = n.get((1, 1), 0), n.get((0, 1), 0)
    assert caught >= 0.75 * (caught + n.get((1, 0), 0)) and caught >= 0.95 * (caught + false)


def test_cut_recordings():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(4000)
        w.writeframes(b"\x01\x00" * 5000)
    assert len(audio.samples(out.getvalue()[:-1])) == 4999
    assert len(audio.samples(b"RIFF no wave")) == len(audio.samples(None)) == 0


def test_edits_of_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "x" * 5000), (3, "again")], "doc_id bigint, text string")
    edits = spark.createDataFrame([(1, 2, 0, 1, "zz "), (1, 1, 2, 1, "Q"), (2, 1, 0, 5, "new text"), (3, 1, 4999, 100, None), (9, 1, 0, 0, "nobody")], "doc_id bigint, seq int, start int, length int, insert string")
    count = counts.Counter(counts.RANKS)
    got = counts.count_with_edits(counts.with_edits(docs, edits)).collect()
    want = {(1, _edited("a b c", [(2, 1, "Q"), (0, 1, "zz ")])), (2, "new text"), (3, "x" * 4999), (3, "again")}
    assert {(r["doc_id"], r["text"]) for r in got} == want
    assert all(r["n_after"] == len(count.coder.encode_ordinary(r["text"])) for r in got)


def _edited(text, edits):
    for at, n, new in edits:
        text = text[:at] + new + text[at + n :]
    return text
