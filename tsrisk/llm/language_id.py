"""Language of texts and of the spans inside them.

Letter runs are words. Unicode script ranges leave each word the languages that are written in its script;
hashed character trigrams, counted over all labelled training texts, score those; Viterbi with a penalty for
each switch labels the words, and neighbours of one label form a span.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsrisk.llm.common import by_bytes, kept, ship

BINS = 1 << 15
PENALTY = 12.0
#: A language is a candidate in scripts that hold at least this share of its letters.
SCRIPT_SHARE = 0.01
NONE = "und"

# First and last code point of Unicode script ranges. Letters outside are script "other".
SCRIPT_RANGES = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("latin", 0x2C60, 0x2C7F), ("latin", 0xA720, 0xA7FF),
    ("latin", 0xFF21, 0xFF5A), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F),
    ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFF), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x3134F),
)
SCRIPTS = ("none", "other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES))

COUNTS = "lang string, bin int, n long"
RESULT = "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


@lru_cache(maxsize=1)
def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Script number (0: no letter) and lower case of every code point."""
    script, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            script[code] = 1
            small = letter.lower()
            if len(small) == 1:
                lower[code] = ord(small)
    for name, first, last in SCRIPT_RANGES:
        part = script[first : last + 1]
        part[part > 0] = SCRIPTS.index(name)
    return script, lower


class Words(NamedTuple):
    """Letter runs of several texts."""

    grams: np.ndarray  # bin of the trigram around each letter
    first: np.ndarray  # index of each word's first letter among the letters
    size: np.ndarray  # letters of each word
    start: np.ndarray  # code point offset of each word in its text
    script: np.ndarray  # script of each word's first letter
    words: np.ndarray  # number of words of each text


def split_words(texts: list[str | None]) -> Words:
    """Letter runs of `texts`, with the bins of their trigrams; both ends of a word count as a space."""
    script_of, lower = _code_tables()
    joined = " " + " ".join(t or "" for t in texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    script = script_of[codes]
    letter = script > 0
    low = np.where(letter, lower[codes], np.uint32(32))
    at = np.flatnonzero(letter)
    with np.errstate(over="ignore"):
        mixed = low[at - 1] * np.uint32(0x9E3779B1) + low[at] * np.uint32(0x85EBCA77) + low[at + 1] * np.uint32(0xC2B2AE3D)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
    grams = (mixed >> np.uint32(17)).astype(np.int64)
    edges = np.diff(letter.astype(np.int8))
    begin, end = np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1) + 1
    lengths = np.array([len(t or "") for t in texts], dtype=np.int64)
    text_at = 1 + np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    words = np.searchsorted(begin, text_at + lengths) - np.searchsorted(begin, text_at)
    size = end - begin
    first = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.zeros(0, np.int64)
    return Words(grams, first, size, begin - np.repeat(text_at, words), script[begin], words)


def count_grams(docs: DataFrame, training: Column) -> DataFrame:
    """`lang, bin, n` over all training rows; bins from BINS on count letters by script."""
    ship(docs)
    rows = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in by_bytes(batches, "text", 4 << 20):
            langs, texts = np.array(batch.column("lang").to_pylist(), dtype=object), batch.column("text").to_pylist()
            for lang in set(langs):
                w = split_words([t for t, own in zip(texts, langs) if own == lang])
                held = sums.setdefault(lang, np.zeros(BINS + len(SCRIPTS), np.int64))
                held[:BINS] += np.bincount(w.grams, minlength=BINS)
                held[BINS:] += np.bincount(w.script, weights=w.size, minlength=len(SCRIPTS)).astype(np.int64)
        for lang, held in sums.items():
            used = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(held[used])],
                names=["lang", "bin", "n"],
            )

    return rows.mapInArrow(count, COUNTS).groupBy("lang", "bin").agg(F.sum("n").alias("n"))


class Model(NamedTuple):
    langs: list[str]
    gram: np.ndarray  # (BINS, languages) log probability
    allowed: np.ndarray  # (scripts, languages) 0 where written so, else a large negative number


def fit(docs: DataFrame, training: Column) -> Model:
    """Counts over all training rows; BINS numbers for each language come to the driver, whatever the input's size."""
    counts: dict[str, np.ndarray] = {}
    for row in count_grams(docs, training).toLocalIterator():
        counts.setdefault(row.lang, np.zeros(BINS + len(SCRIPTS)))[row.bin] = row.n
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((BINS, 0), np.float32), np.zeros((len(SCRIPTS), 0), np.float32))
    stacked = np.stack([counts[x] for x in langs], axis=1)
    gram, script = stacked[:BINS] + 0.5, stacked[BINS:]
    share = script / np.maximum(script.sum(axis=0), 1)
    allowed = np.where(share >= SCRIPT_SHARE, 0.0, -1e4)
    allowed[allowed.max(axis=1) < 0] = 0.0  # a script that no language is written in narrows nothing
    return Model(langs, np.log(gram / gram.sum(axis=0)).astype(np.float32), allowed.astype(np.float32))


def _gains_over(best: np.ndarray, scores: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each text, the most that any run of words gains in any other label over the text's best one."""
    doc = np.repeat(np.arange(len(words)), words)
    gain = scores.astype(np.float64) - scores[np.arange(len(scores)), best[doc]][:, None]
    most = np.zeros(len(words))
    held = words > 0
    starts = (np.cumsum(words) - words)[held]
    for label in range(scores.shape[1]):
        total = np.cumsum(gain[:, label])
        before = total - gain[:, label]
        # Texts stand on steps that go down, so a running least value never reaches into the text before.
        step = doc * (np.abs(before).max() * 2 + 1.0)
        least = np.minimum.accumulate(before - step) + step
        most[held] = np.maximum(most[held], np.maximum.reduceat(total - least, starts))
    return most


def _viterbi(scores: np.ndarray, words: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of each text's words, all texts of the batch in step, the longest first."""
    order = np.argsort(-words, kind="stable")
    base, length = (np.cumsum(words) - words)[order], words[order]
    labels = scores.shape[1]
    stay = np.zeros((len(scores), labels), bool)
    best_before = np.zeros(len(scores), np.int32)
    state = scores[base[: np.count_nonzero(length > 0)]].astype(np.float64)
    final = np.zeros(len(order), np.int64)
    active = len(state)
    for t in range(1, int(length[0]) if len(length) else 0):
        now = int(np.searchsorted(-length, -t, side="left"))  # texts with more than t words
        final[now:active] = state[now:active].argmax(axis=1)
        state, active = state[:now], now
        top = state.argmax(axis=1)
        jump = state[np.arange(now), top] - penalty
        at = base[:now] + t
        keep = state >= jump[:, None]
        stay[at], best_before[at] = keep, top
        state = np.where(keep, state, jump[:, None]) + scores[at]
    final[:active] = state.argmax(axis=1)
    out = np.zeros(len(scores), np.int64)
    current = final.copy()
    for t in range(int(length[0]) - 1 if len(length) else -1, -1, -1):
        now = int(np.searchsorted(-length, -t, side="left"))
        at = base[:now] + t
        out[at] = current[:now]
        if t:
            current[:now] = np.where(stay[at, current[:now]], current[:now], best_before[at])
    return out


def label_words(scores: np.ndarray, words: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Labels of the best path for each text.

    Where no run of words gains more than half a penalty over the best single
    label, every path with switches loses, so only other texts take the full
    Viterbi pass.
    """
    doc = np.repeat(np.arange(len(words)), words)
    sums = np.zeros((len(words), scores.shape[1]))
    held = np.flatnonzero(words)
    if len(held):
        sums[held] = np.add.reduceat(scores.astype(np.float64), (np.cumsum(words) - words)[held], axis=0)
    best = sums.argmax(axis=1)
    labels = best[doc]
    mixed = _gains_over(best, scores, words) > penalty / 2 if len(scores) else np.zeros(len(words), bool)
    if mixed.any():
        labels[mixed[doc]] = _viterbi(scores[mixed[doc]], words[mixed], penalty)
    return labels


def predict(texts: list[str | None], model: Model) -> tuple[list[str], list[float], list[list[dict]]]:
    """Language, share of the letters that carry it, and spans, for each text."""
    w = split_words(texts)
    n, labels = len(w.first), len(model.langs)
    doc = np.repeat(np.arange(len(texts)), w.words)
    if not n or not labels:
        return [NONE] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    scores = np.add.reduceat(model.gram[w.grams], w.first, axis=0) + model.allowed[w.script]
    label = label_words(scores, w.words)
    letters = np.zeros((len(texts), labels))
    np.add.at(letters, (doc, label), w.size)
    total = letters.sum(axis=1)
    best = letters.argmax(axis=1)
    share = letters[np.arange(len(texts)), best] / np.maximum(total, 1)
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])]))
    last = np.concatenate([new[1:], [n]]) - 1
    spans: list[list[dict]] = [[] for _ in texts]
    for a, b in zip(new.tolist(), last.tolist()):
        spans[doc[a]].append({"start": int(w.start[a]), "end": int(w.start[b] + w.size[b]), "lang": model.langs[label[a]]})
    names = [model.langs[b] if t else NONE for b, t in zip(best, total)]
    return names, [float(s) if t else 0.0 for s, t in zip(share, total)], spans


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, then `lang_pred, score, spans`; only `text` is read for the prediction.

    A null text, or one without any letter, is `und` with score 0 and no
    spans, and so is every text if nothing was learned. Ties go to the first
    language in code point order. Repeated rows give repeated rows, an empty
    table an empty result, and other columns play no part.
    """
    ship(docs)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tuple(model))
    inward, carried, fields, outward = kept(docs, keep)
    rows = docs.select(*inward, "text")
    schema = T.StructType([*fields, *T.StructType.fromDDL(RESULT)])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in by_bytes(batches, "text", 4 << 20):
            names, score, spans = predict(batch.column("text").to_pylist(), own)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in carried],
                    pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(spans, spans_type),
                ],
                names=[*carried, "lang_pred", "score", "spans"],
            )

    found = rows.mapInArrow(run, schema)
    return found.select(*outward, "lang_pred", "score", "spans")
