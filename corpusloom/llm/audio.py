"""Media columns: chroma fingerprints of recordings, and their alignment."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

RATE, HOP, WINDOW, SPAN = 4000, 256, 1024, 16


def play(text: str | None) -> bytes:
    """A mono 16-bit WAV recording of a text: a note of 64 ms for each word, its pitch from the word."""
    notes = [xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) for w in (text or "").split()]
    pitch = 130.81 * 2.0 ** (np.array([n % 24 for n in notes], dtype=np.float64) / 12)
    phase = 2 * np.pi * np.cumsum(np.repeat(pitch, HOP)) / RATE
    sound = 0.6 * np.sin(phase) + 0.2 * np.sin(2 * phase)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((sound * 32000).astype("<i2").tobytes())
    return out.getvalue()


def samples(audio: bytes | None) -> np.ndarray:
    """Mono samples at RATE of a 16-bit WAV recording; none for null or what can't be read; a recording
    that was cut off within a sample ends before it."""
    try:
        with wave.open(io.BytesIO(audio or b""), "rb") as w:
            if w.getsampwidth() != 2:
                return np.zeros(0, dtype=np.float32)
            raw = w.readframes(w.getnframes())
            x = np.frombuffer(raw[: len(raw) // 2 * 2], dtype="<i2").astype(np.float32)
            x, rate = x[: len(x) // w.getnchannels() * w.getnchannels()].reshape(-1, w.getnchannels()).mean(axis=1), w.getframerate()
    except (wave.Error, EOFError):
        return np.zeros(0, dtype=np.float32)
    if rate != RATE and len(x):
        x = np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x).astype(np.float32)
    return x


def _pitch_classes() -> np.ndarray:
    """Which of the 12 classes each bin of the spectrum counts for, 100 Hz to 1200 Hz."""
    f = np.fft.rfftfreq(WINDOW, 1 / RATE)
    use = (f >= 100) & (f <= 1200)
    out = np.zeros((len(f), 12), dtype=np.float32)
    out[use, np.round(12 * np.log2(f[use] / 130.81)).astype(int) % 12] = 1
    return out


_CLASSES, _HANN = _pitch_classes(), np.hanning(WINDOW).astype(np.float32)
#: Sixteen filters by rule: the kind turns fastest, the width doubles from 2 to 16 frames, the band moves by thirds.
FILTERS = [(i % 4, 2 << i // 4, 3 * i % 10, (4, 6, 12, 3)[i % 4]) for i in range(16)]


def chroma(x: np.ndarray, block: int = 4096) -> np.ndarray:
    """Frames by pitch class, each frame of length one (or zero, where it is silent)."""
    n = max(0, 1 + (len(x) - WINDOW) // HOP)
    out = np.zeros((n, 12), dtype=np.float32)
    for at in range(0, n, block):
        end = min(n, at + block)
        frames = np.lib.stride_tricks.sliding_window_view(x[at * HOP : (end - 1) * HOP + WINDOW], WINDOW)[::HOP]
        out[at:end] = np.abs(np.fft.rfft(frames * _HANN, axis=1)).astype(np.float32) ** 2 @ _CLASSES
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-3)


def fingerprint(x: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each frame that has SPAN frames from it on: sixteen filters of two bits each.

    Each filter compares two areas of the frames-by-classes image, summed in four reads of its integral
    image: early and late, low and high, inner and outer, or the two diagonals.
    """
    c = chroma(x)
    n = len(c) - SPAN + 1
    if n < 1:
        return np.zeros(0, dtype=np.int32)
    total = np.zeros((len(c) + 1, 13))
    total[1:, 1:] = c.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)

    def area(t: int, w: int, y: int, h: int) -> np.ndarray:
        y, top = min(y, 12), min(y + h, 12)
        a, b = total[t : t + n], total[t + w : t + w + n]
        return b[:, top] - b[:, y] - a[:, top] + a[:, y]

    out = np.zeros(n, dtype=np.uint32)
    for kind, w, y, h in FILTERS:
        y = min(y, 12 - h)
        whole = area(0, w, y, h)
        if kind == 0:
            one = area(0, w // 2, y, h)
        elif kind == 1:
            one = area(0, w, y, h // 2)
        elif kind == 2:
            one = area(0, w, y + h // 4, h // 2)
        else:
            one = area(0, w // 2, y, (h + 1) // 2) + area(w // 2, w // 2, y + (h + 1) // 2, h // 2)
        v = np.log((1 + one) / (1 + whole - one))
        level = (v > -0.15).astype(np.uint32) + (v > 0) + (v > 0.15)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))
    return out.view(np.int32)


def fingerprints(media: DataFrame, keys: list[str], audio_col: str = "audio") -> DataFrame:
    """``keys`` and ``codes``, an array of integers, for every row; no codes for null, short or unreadable audio.
    ``sound`` is a digest of the samples of a recording with fewer than two codes, null for others and without samples."""
    kinds = ", ".join(f"`{k}` {media.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keys].copy()
            codes, sound = [], []
            for a in b["__audio"]:
                x = samples(a)
                codes.append(fingerprint(x))
                sound.append(xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) if len(x) and len(codes[-1]) < 2 else None)
            out["codes"], out["sound"] = codes, pd.array(sound, dtype="Int64")
            yield out

    return media.select(*keys, F.col(audio_col).alias("__audio")).mapInPandas(run, f"{kinds}, codes array<int>, sound bigint")


def recordings(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` and ``audio``: each row's text as :func:`play` sounds it."""
    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 100):
                part = b.iloc[at : at + 100]
                out = part[keys].copy()
                out["audio"] = [play(t) for t in part["__text"]]
                yield out

    return texts.select(*keys, F.col(text_col).alias("__text")).mapInPandas(run, f"{kinds}, audio binary")


def align(prints: DataFrame, keys: list[str], query: Column, least_votes: int = 3, max_errors: float = 0.25) -> DataFrame:
    """Finds, for every row where ``query`` holds, the distinct recordings that it shares a passage with.

    Equal code arrays (equal samples, of short ones) are one recording, named by its smallest key, with its number of ``copies``.  Two
    recordings meet on equal pairs of successive codes (of a run of equal pairs, the first); each meeting
    votes for an offset; the offset with most votes is checked by the share of bits that differ where the two
    overlap.  A pair with ``least_votes`` and at most ``max_errors`` is a match.

    Returns a row for each query row and match: ``keys``, ``recording`` (its own, a struct of keys), ``matched``, ``copies``,
    ``shift`` (frames from the query to the match), ``votes, errors``, and ``own_copies``, the rows of its own
    recording, itself included; a query without any match has one row with nulls for the match.  Recordings
    with fewer than two codes match only their copies; those without samples have no ``recording``.
    """
    rows = written(prints.select(*keys, "codes", "sound", query.alias("asked")).withColumn("rec", F.xxhash64("codes", "sound")), "prints")
    clips = rows.where((F.size("codes") > 1) | F.col("sound").isNotNull()).groupBy("rec").agg(F.min(F.struct(*keys)).alias("name"), F.count("*").alias("copies"), F.first("codes").alias("codes"), F.max("asked").alias("asked"))
    clips = written(clips, "clips")
    # positions are filtered before they are hashed: a filter that names the hashed array would hash all of it at each step
    code = lambda i: F.element_at("codes", i.cast("int"))
    places = F.filter(F.sequence(F.lit(1), F.size("codes") - 1), lambda i: (i == 1) | (code(F.greatest(i - 1, F.lit(1))) != code(i)) | (code(i) != code(i + 1)))
    pair = F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(code(i), code(i + 1)).alias("k")))
    pairs = clips.where(F.size("codes") > 1).select("rec", "asked", F.explode(pair).alias("p"))
    q = pairs.where("asked").select(F.col("rec").alias("q"), F.col("p.k").alias("k"), F.col("p.at").alias("tq"))
    r = pairs.select(F.col("rec").alias("r"), F.col("p.k").alias("k"), F.col("p.at").alias("tr"))
    votes = q.join(r, "k").where("q <> r").groupBy("q", "r", (F.col("tr") - F.col("tq")).alias("shift")).agg(F.count("*").alias("votes")).where(F.col("votes") >= least_votes)
    best = votes.withColumn("n", F.row_number().over(Window.partitionBy("q", "r").orderBy(F.desc("votes"), F.abs("shift"), "shift"))).where("n = 1").drop("n")
    both = best.join(clips.select(F.col("rec").alias("q"), F.col("codes").alias("cq")), "q").join(clips.select(F.col("rec").alias("r"), F.col("codes").alias("cr"), "name", "copies"), "r")
    x, y = F.greatest(F.lit(0), -F.col("shift")), F.greatest(F.lit(0), F.col("shift"))
    n = F.least(F.size("cq") - x, F.size("cr") - y)
    wrong = F.aggregate(F.zip_with(F.slice("cq", x + 1, n), F.slice("cr", y + 1, n), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
    found = both.withColumn("errors", wrong / (32.0 * n)).where(F.col("errors") <= max_errors).select(F.col("q").alias("rec"), F.col("name").alias("matched"), "copies", "shift", "votes", "errors")
    names = clips.select("rec", F.col("name").alias("recording"), F.col("copies").alias("own_copies"))
    return rows.where("asked").select(*keys, "rec").join(names, "rec", "left").join(found, "rec", "left").drop("rec")
