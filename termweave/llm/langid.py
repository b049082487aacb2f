"""Operator 4, language identification: script ranges, scores of words, Viterbi over languages.

Learning counts hashed byte n-grams of words and letters of scripts for each language, over all training rows: each task adds up
its own rows, the sums of all tasks are a table of bounded size (languages x buckets). A word's script narrows its candidate
languages to those whose training letters are in that script often enough; each candidate scores the word by its n-grams. The best
path over a text's words, which pays a penalty for each change of language, labels the spans of mixed texts; the language
with the most labelled bytes is the text's. Texts whose best single language can't be beaten by any path, as bounded by
the largest gain of any run of words, skip the search.

Edge cases: null texts and texts without a letter are `und` with score 0 and no span, so are all texts where nothing could be learned;
null lang and null doc_id are never learned from; ties go to the language first in alphabetical order; repeated rows return as often;
an empty table gives an empty result. All lang values are learned: the model, which is broadcast, has 400 kB for each. A text is worked on
whole, so a task's memory is in proportion to its longest text (words times languages, 8 bytes each).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textbytes

ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
SCRIPTS = 16
PENALTY = 7.0
#: Languages that a task counts at once, and numbers (places times languages) that it scores at once.
HELD_LANGUAGES, SCORED_AT_ONCE = 32, 1 << 23
#: What a word costs a language that isn't among its script's candidates, and the share of letters that makes it one.
OUTSIDE, LEAST_SHARE = 30.0, 0.02

# scripts by the first byte of a character: 1 Latin, 2 Greek, 3 Cyrillic, 4 Hebrew, 5 Armenian, 6 Arabic, 7 other of two bytes,
# 8 Indic and Thai, 9 Georgian to Khmer, 10 kana, 11 Han, 12 Hangul, 13 four bytes; 0 no letter
_SCRIPT = np.zeros(256, np.uint8)
for _first, _last, _kind in ((0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC3, 0xCA, 1), (0xCD, 0xCF, 2), (0xD0, 0xD4, 3), (0xD5, 0xD5, 5), (0xD6, 0xD7, 4), (0xD8, 0xDB, 6), (0xDC, 0xDF, 7), (0xE0, 0xE0, 8), (0xE1, 0xE1, 9), (0xE3, 0xE3, 10), (0xE4, 0xE9, 11), (0xEA, 0xED, 12), (0xF0, 0xF0, 13)):
    _SCRIPT[_first : _last + 1] = _kind


def _grams(body: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(which order, places, buckets) of the n-grams that end at each place and don't begin before their word's space."""
    place = np.arange(len(body))
    owner_start = np.zeros(len(body), np.int64)
    owner_start[starts[1:] + 1] = np.diff(starts)
    owner_start = np.cumsum(owner_start)
    value = body.astype(np.uint64)
    for k in range(1, max(ORDERS)):
        value[k:] |= body[:-k].astype(np.uint64) << np.uint64(8 * k)
    for k, n in enumerate(ORDERS):
        at = np.flatnonzero(place - owner_start >= n - 1)
        own = value[at] & np.uint64((1 << 8 * n) - 1)
        yield k, at, ((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    tables: np.ndarray  # order, bucket, language: log probability
    allowed: np.ndarray  # script, language


def count(rows: DataFrame) -> DataFrame:
    """lang, slot, c: n-grams by order and bucket, then letters by script."""

    size = len(ORDERS) * BUCKETS

    def drained(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, total in sums.items():
            slot = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(slot.astype(np.int32)), pa.array(total[slot])], names=["lang", "slot", "c"])
        sums.clear()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(size + SCRIPTS, np.int64))
        for b in batches:
            for t in textbytes.chunks(b.column("text")):
                langs = b.column("lang").slice(t.first, len(t)).dictionary_encode()
                code = np.asarray(langs.indices)
                w = textbytes.words(t, hashed=False)
                if not len(w):
                    continue
                body, starts = textbytes.packed(t, w)
                by_word = code[w.doc]
                word_of = np.repeat(np.arange(len(w)), np.diff(np.append(starts, len(body) - 1)))
                word_of = np.concatenate([word_of[:1], word_of])  # a space ends the word before it
                by_place = by_word[word_of]
                names = langs.dictionary.to_pylist()
                grams, kind = list(_grams(body, starts)), _SCRIPT[body]
                # a few languages at a time, so memory doesn't grow with how many a chunk or a task has
                for low in range(0, len(names), HELD_LANGUAGES):
                    n = min(HELD_LANGUAGES, len(names) - low)
                    total = np.zeros((n, size + SCRIPTS), np.int64)
                    inside = (by_place >= low) & (by_place < low + n)
                    for k, at, bucket in grams:
                        own = inside[at]
                        total[:, k * BUCKETS : (k + 1) * BUCKETS] += np.bincount((by_place[at[own]] - low) * BUCKETS + bucket[own], minlength=n * BUCKETS).reshape(n, BUCKETS)
                    total[:, size:] += np.bincount((by_place[inside] - low) * SCRIPTS + kind[inside], minlength=n * SCRIPTS).reshape(n, SCRIPTS)
                    for k in range(n):
                        sums[names[low + k]] += total[k]
                    if len(sums) > HELD_LANGUAGES:
                        yield from drained(sums)
        yield from drained(sums)

    return rows.select("text", "lang").mapInArrow(lambda b: textbytes.released(counts(b)), "lang string, slot int, c long").groupBy("lang", "slot").agg(F.sum("c").alias("c"))


def train(docs: DataFrame) -> Model:
    common.require(docs, "doc_id", "text", "lang")
    rows = docs.where(common.trainable(F.col("doc_id"), 4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    # languages x buckets, whatever the number of rows
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    found = count(rows).toArrow()
    names, total = langs, np.zeros((len(langs), len(ORDERS) * BUCKETS + SCRIPTS))
    code = found.column("lang").combine_chunks().dictionary_encode()
    where = {lang: k for k, lang in enumerate(names)}
    place = np.array([where[x] for x in code.dictionary.to_pylist()], np.int64)
    total[place[np.asarray(code.indices)] if len(place) else np.zeros(0, np.int64), found.column("slot").to_numpy()] = found.column("c").to_numpy()
    grams = total[:, : len(ORDERS) * BUCKETS].reshape(len(names), len(ORDERS), BUCKETS) + 0.5
    scripts = total[:, len(ORDERS) * BUCKETS :]
    scripts[:, 0] = 0
    tables = np.log(grams / grams.sum(2, keepdims=True)).transpose(1, 2, 0) / len(ORDERS)
    return Model(names, np.ascontiguousarray(tables, np.float32), (scripts / np.maximum(scripts.sum(1, keepdims=True), 1) >= LEAST_SHARE).T)


def word_scores(m: Model, t: textbytes.Texts, w: textbytes.Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Scores by word and language, and the words' scripts. A word without a letter of a known script says nothing (zeros), unless its whole text has none."""
    body, starts = textbytes.packed(t, w)
    scores = np.zeros((len(w), len(m.langs)))
    word_of = np.repeat(np.arange(len(w)), np.diff(np.append(starts, len(body) - 1)))
    word_of = np.concatenate([word_of[:1], word_of])  # a space ends the word before it
    step = max(1, SCORED_AT_ONCE // max(len(m.langs), 1))
    for k, at, bucket in _grams(body, starts):
        # places in runs, so memory doesn't grow with bytes times languages
        for low in range(0, len(at), step):
            word = word_of[at[low : low + step]]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            scores[word[first]] += np.add.reduceat(m.tables[k][bucket[low : low + step]], first, axis=0)
    kind = _SCRIPT[body]
    letter = np.flatnonzero(kind)
    first = np.searchsorted(letter, starts)
    script = np.zeros(len(w), np.uint8)
    if len(letter):
        place = letter[np.minimum(first, len(letter) - 1)]
        has = (first < len(letter)) & (place < np.append(starts[1:], len(body)))
        script[has] = kind[place[has]]
    allowed = m.allowed[script]
    narrowed = allowed.any(1, keepdims=True)
    scores -= np.where(narrowed & ~allowed, OUTSIDE, 0.0)
    known = np.bincount(w.doc, weights=script > 0, minlength=len(t)) > 0
    scores[(script == 0) & known[w.doc]] = 0
    return scores, script


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best path of each text; scores of all texts' words one after another, sizes: words in each."""
    path = np.zeros(len(scores), np.int64)
    n_lang = scores.shape[1]
    ends = np.cumsum(sizes)
    begins = ends - sizes
    full = np.flatnonzero(sizes)
    if not len(full) or n_lang == 1:
        return path
    totals = np.add.reduceat(scores, begins[full])
    best = totals.argmax(1)
    path[:] = np.repeat(best, sizes[full])
    # the most that any run of words gains by leaving the best single language
    gain = scores - np.take_along_axis(scores, path[:, None], 1)
    np.put_along_axis(gain, path[:, None], -np.inf, 1)
    gain = gain.max(1)
    doc = np.repeat(np.arange(len(full)), sizes[full])
    c = np.cumsum(gain)
    far = (np.abs(c).max() + np.abs(gain).max() + 1) * 2
    run = c - far * doc - np.minimum.accumulate(c - gain - far * doc)
    search = np.flatnonzero(np.maximum.reduceat(run, begins[full]) > penalty)
    search = search[np.argsort(sizes[full][search], kind="stable")]
    at = 0
    while at < len(search):
        group = 1
        while at + group < len(search) and (group + 1) * sizes[full[search[at + group]]] * n_lang <= 2_000_000:
            group += 1
        own = full[search[at : at + group]]
        at += group
        steps = int(sizes[own].max())
        place = begins[own][:, None] + np.arange(steps)
        valid = np.arange(steps) < sizes[own][:, None]
        s = np.where(valid[..., None], scores[np.minimum(place, len(scores) - 1)], 0.0)
        back = np.zeros((steps, len(own), n_lang), np.int16)
        v = s[:, 0].copy()
        stay = np.arange(n_lang)
        for k in range(1, steps):
            top = v.argmax(1)
            move = v[np.arange(len(own)), top] - penalty
            moved = v < move[:, None]
            back[k] = np.where(moved, top[:, None], stay)
            v = np.where(moved, move[:, None], v) + s[:, k]
        now = v.argmax(1)
        for k in range(steps - 1, -1, -1):
            has = valid[:, k]
            path[place[has, k]] = now[has]
            now = back[k][np.arange(len(own)), now].astype(np.int64)
    return path


def _label(m: Model, t: textbytes.Texts, penalty: float) -> tuple[list[str], list[float], list[str]]:
    n = len(t)
    langs, shares, spans = ["und"] * n, [0.0] * n, [""] * n
    w = textbytes.words(t, hashed=False)
    if not m.langs or not len(w):
        return langs, shares, spans
    scores, script = word_scores(m, t, w)
    sizes = np.bincount(w.doc, minlength=n)
    path = viterbi(scores, sizes, penalty)
    # texts whose letters are all of scripts without a range of their own are weighed by all their bytes
    known = np.bincount(w.doc, weights=script > 0, minlength=n) > 0
    weight = np.where((script > 0) | ~known[w.doc], w.end - w.begin, 0)
    by_lang = np.bincount(w.doc * len(m.langs) + path, weights=weight, minlength=n * len(m.langs)).reshape(n, -1)
    best, whole = by_lang.argmax(1), by_lang.sum(1)
    ascii_letter = np.concatenate([[0], np.cumsum((t.data < 128) & (_SCRIPT[t.data] > 0))])
    sure = ascii_letter[t.at[1:]] > ascii_letter[t.at[:-1]]
    change = np.ones(len(w), bool)
    change[1:] = (path[1:] != path[:-1]) | (w.doc[1:] != w.doc[:-1])
    at = np.flatnonzero(change)
    first_word = np.cumsum(sizes) - sizes
    parts = defaultdict(list)
    for d, lang, a, b in zip(w.doc[at], path[at], at, np.append(at[1:], len(w)), strict=True):
        parts[d].append(f"{m.langs[lang]}:{a - first_word[d]}:{b - first_word[d]}")
    for d in np.flatnonzero(sizes):
        if whole[d] and (sure[d] or any(c.isalpha() for c in t.data[t.at[d] : t.at[d + 1]].tobytes().decode("utf-8", "replace"))):
            langs[d], shares[d], spans[d] = m.langs[best[d]], float(by_lang[d, best[d]] / whole[d]), ",".join(parts[d])
    return langs, shares, spans


def identify(docs: DataFrame, model: Model | None = None, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of the labelled bytes), spans (lang:first word:end word, ...)."""
    common.require(docs, "doc_id", "text")
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    rows = docs.select("doc_id", common.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "text")
    schema = rows.drop("text").schema.add("lang_pred", "string").add("score", "double").add("spans", "string")

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in textbytes.chunks(b.column("text")):
                own = b.slice(t.first, len(t))
                langs, shares, spans = _label(held.value, t, penalty)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, pa.string())], names=schema.names)

    return rows.mapInArrow(lambda b: textbytes.released(labelled(b)), schema)
