"""Operator 13, license scans by diagonal voting.

A task hashes all runs of GRAM words of whole texts. Spark joins them with the places of equal runs in the known texts (a fixed, small table, so it is
broadcast), and each meeting votes for a diagonal: the text's place less the template's. Votes are grouped by text, template and diagonal, which combines
in the tasks that join; diagonals that lie near each other, as words put in or left out shift them, are merged by a window into spans. A span with
a fair share of its template's runs is verified on the words themselves: words that match in order, over the longer of template and span.
Of verified spans that overlap the better one stays. Texts of the spans come from a second scan, joined by the text's digest; spans of up to
BROADCAST_ROWS texts are broadcast to it, of more they are joined by a shuffle, where Spark splits a digest of many copies.

Base: places where a phrase's words stand consecutively. They count as whole matches for labels and score.

Edge cases: a null text is empty (no words, no labels, score 0); texts of fewer words than a run have base phrases only; repeated rows are rows each; rows without
a doc_id stay; an empty table gives none; a label that several templates have stands once; of equal overlapping spans the earlier template's stays. Columns besides
doc_id and text are ignored. A text is worked on whole, so a task's memory is in proportion to the longest.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common, textbytes
from .license_texts import TEXTS

# The phrases of the base, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
GRAM = 3
#: Diagonals of one passage lie so many words apart at most, or a quarter of the template's words.
SHIFT = 8
#: Share of a template's runs that a span needs to be verified, and of its words to count.
VOTES, SIMILARITY = 0.25, 0.8
#: Texts with spans up to this many are broadcast.
BROADCAST_ROWS = 100_000

# words are of 0-9, a-z and all that isn't ASCII
_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[97:123] = _BREAK[128:] = False


def _words(t: textbytes.Texts) -> tuple[textbytes.Texts, textbytes.Pieces]:
    t = textbytes.lowered(t)
    return t, textbytes.words(t, space=_BREAK)


def _split(text: str) -> list[bytes]:
    t, w = _words(next(textbytes.chunks(pa.array([text]))))
    return [t.data[a:b].tobytes() for a, b in zip(w.begin, w.end, strict=True)]


def _runs(text: str, size: int) -> np.ndarray:
    return textbytes.windows(_words(next(textbytes.chunks(pa.array([text]))))[1], size)[1].view(np.int64)


@lru_cache(maxsize=1)
def templates() -> list[list[bytes]]:
    return [_split(text) for _, text in TEXTS]


def places(spark: SparkSession) -> DataFrame:
    """run, template, at: every run of the known texts."""
    rows = [(int(h), i, at) for i, (_, text) in enumerate(TEXTS) for at, h in enumerate(_runs(text, GRAM))]
    return spark.createDataFrame(rows, "run bigint, template int, at int")


def runs(docs: DataFrame) -> DataFrame:
    """digest, runs: hashes of all runs of GRAM words of each text that has any."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textbytes.released(batches):
            for t in textbytes.chunks(b.column(1)):
                doc, h = textbytes.windows(_words(t)[1], GRAM)
                ends = np.searchsorted(doc, np.arange(len(t) + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.first, len(t)), found], names=["digest", "runs"])

    return docs.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text").where("text <> ''").mapInArrow(hashed, "digest binary, runs array<bigint>")


def diagonals(docs: DataFrame) -> DataFrame:
    """digest, template, diagonal, first and last (the text's words from 0), votes (the template's places)."""
    found = runs(docs).select("digest", F.posexplode("runs").alias("word", "run")).join(F.broadcast(places(docs.sparkSession)), "run")
    votes = found.groupBy("digest", "template", (F.col("word") - F.col("at")).alias("diagonal"))
    return votes.agg(F.min("word").alias("first"), F.max("word").alias("last"), F.collect_set("at").alias("votes"))


def spans(docs: DataFrame) -> DataFrame:
    """digest, template, first, last: words that a template's place in the text may take, of merged diagonals with enough votes."""
    near = Window.partitionBy("digest", "template").orderBy("diagonal", "first")
    size = F.create_map(*[F.lit(x) for i, words in enumerate(templates()) for x in (i, len(words))])[F.col("template")]
    shift = F.least(F.lit(SHIFT), F.floor(size / 4).cast("int"))  # so that short texts that follow each other stay apart
    apart = (F.col("diagonal") - F.lag("diagonal").over(near) > shift) | (F.greatest("first", F.lag("first").over(near)) - F.least("last", F.lag("last").over(near)) > size + shift)
    rows = diagonals(docs).withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy("digest", "template", "island").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.size(F.array_distinct(F.flatten(F.collect_list("votes")))).alias("votes"))
    merged = merged.where(F.col("votes") >= F.greatest(F.lit(1.0), VOTES * (size - GRAM + 1)))
    return merged.select("digest", "template", F.greatest(F.lit(0), F.col("low") - shift).alias("first"), (F.col("high") + size + shift).alias("last"))


def verified(words: list[bytes], template: list[bytes]) -> tuple[float, int, int]:
    """The share of words that match in order, of the longer of template and span; the span's first and last word."""
    blocks = [m for m in SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if m.size]
    # words far from the rest aren't part of the passage: the run of blocks with the best share counts
    best = (0.0, 0, 0)
    for i in range(len(blocks)):
        matched = 0
        for m in blocks[i:]:
            matched += m.size
            first, last = blocks[i].b, m.b + m.size - 1
            best = max(best, (matched / max(len(template), last - first + 1), first, last), key=lambda x: x[0])
    return best


def _chosen(found: list[tuple[float, int, int, int]]) -> list[tuple[float, int, int, int]]:
    """Verified spans (share, template, first, last) without those that a better one overlaps."""
    out: list[tuple[float, int, int, int]] = []  # by first word
    for x in sorted(found, key=lambda x: (-x[0], x[2] - x[3], x[1], x[2])):
        at = bisect_right(out, x[2], key=lambda y: y[2])
        if (at == 0 or out[at - 1][3] < x[2]) and (at == len(out) or out[at][2] > x[3]):
            out.insert(at, x)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, first, last, share) of each row."""
    common.require(docs, "doc_id", "text")
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kept = common.stored(spark, spans(own), "license-spans")
    asked = kept.groupBy(F.col("digest").alias("_digest")).agg(F.sort_array(F.collect_set(F.struct("template", "first", "last"))).alias("spans"))
    if kept.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    rows = own.join(asked, F.unhex(F.sha2("text", 256)) == F.col("_digest"), "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType
    phrases = [(len(p.split()), int(_runs(p, len(p.split()))[0]), label) for p, label in PHRASES]
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])
    fields = [("doc_id", to_arrow_type(kind)), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textbytes.released(batches):
            asked = b.column(2)
            for t in textbytes.chunks(b.column(1)):
                low, w = _words(t)
                n = len(t)
                count = np.bincount(w.doc, minlength=n)
                start = np.cumsum(count) - count
                n_base, first, last, labels = np.zeros(n, np.int64), [None] * n, [None] * n, [set() for _ in range(n)]
                for size, wanted, label in phrases:
                    m = len(w) - size + 1
                    if m <= 0:
                        continue
                    h = np.zeros(m, np.uint64)
                    for k in range(size):
                        h += w.hash[k : k + m] * textbytes.powers(size + 1)[k + 1]
                    at = np.flatnonzero((textbytes.mix(h + np.uint64(size)).view(np.int64) == wanted) & (w.doc[:m] == w.doc[size - 1 :]))
                    for i, d in zip((at - start[w.doc[at]]).tolist(), w.doc[at].tolist(), strict=True):
                        n_base[d] += 1
                        first[d] = i if first[d] is None else min(first[d], i)
                        last[d] = i if last[d] is None else max(last[d], i)
                        labels[d].add(label)
                more, score, found = [set(x) for x in labels], [1.0 if x else 0.0 for x in labels], [[] for _ in range(n)]
                mine = asked.slice(t.first, n)
                for d in np.flatnonzero(np.asarray(mine.is_valid())).tolist():
                    told = []
                    for s in mine[d].as_py():
                        lo, hi = start[d] + min(s["first"], count[d]), start[d] + min(s["last"], count[d])
                        share, a, z = verified([low.data[x:y].tobytes() for x, y in zip(w.begin[lo:hi].tolist(), w.end[lo:hi].tolist(), strict=True)], templates()[s["template"]])
                        told.append((share, s["template"], int(lo - start[d]) + a, int(lo - start[d]) + z))
                    for share, template, a, z in _chosen([x for x in told if x[0] >= SIMILARITY]):
                        more[d].add(TEXTS[template][0])
                        found[d].append({"label": TEXTS[template][0], "first": a, "last": z, "share": share})
                    score[d] = max([score[d], *(x[0] for x in told)])
                joined = lambda sets: [",".join(sorted(x)) for x in sets]
                columns = [b.column(0).slice(t.first, n), count, n_base, first, last, joined(labels), joined(more), score, found]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])

    return rows.mapInArrow(judge, f"doc_id {kind.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,last:bigint,share:double>>")
