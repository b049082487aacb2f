"""Operator 5, language-model scoring: prediction by partial matching over a byte-context trie.

A text is scored as the bytes of its lower-cased words, each after a space, and an end byte. Training counts, over all training rows, every run of
ORDER + 1 bytes; shorter runs are their suffixes, so this table is the trie of contexts up to ORDER bytes. A byte is predicted in its
longest known context by its count less a half; the halves of the different bytes seen there are the escape's. After an escape the next
shorter context leaves out the bytes that the longer one knew (exclusion), at last all bytes left are equally likely. Shorter contexts
count a byte once for each longer context that it was new in (update exclusion).
Because a longer context's bytes are a subset of a shorter one's, what exclusion takes away is one number for each context, and the
probability of each byte in its full context is one number for each node: scoring is one hash lookup for a frequent run's byte, and
all other runs, each once, are joined with the stored trie at each order.

The base score is a smoothed unigram model of words. Counts of the TOP_TOKENS most frequent words are looked up from a broadcast, all
others by a join, so the vocabulary may grow without bound. The trie keeps all runs; the most frequent ones, MAX_NODES at most, are looked up
from a broadcast. Both bounds hold at any size of the input: equal counts go in or stay out together. Memory is in proportion to the longest text.

Edge cases: null texts are empty, with the end as their only token; null ids are scored but never learned from; rows that repeat are scored each;
with no training rows all bytes are equally likely and every word is unknown; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, textbytes

ORDER = 5
MAX_NODES, TOP_TOKENS = 1_500_000, 1 << 18
END = 0x0A
#: Stands for the end among the hashes of words.
END_TOKEN = -1
_KEEP = 1_500_000


def streams(t: textbytes.Texts, w: textbytes.Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each after ORDER end bytes, and where each text's own bytes begin."""
    n, size = len(t), w.end - w.begin
    starts = np.cumsum(size + 1) - (size + 1) + w.doc * (ORDER + 1) + ORDER
    per_doc = np.bincount(w.doc, weights=size + 1, minlength=n).astype(np.int64)
    begins = np.cumsum(per_doc) - per_doc + np.arange(n) * (ORDER + 1) + ORDER
    out = np.full(int(per_doc.sum()) + n * (ORDER + 1), END, np.uint8)
    out[starts] = 0x20
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(starts, size) + 1 + inside] = t.data[np.repeat(w.begin, size) + inside]
    return out, begins


def runs(body: np.ndarray) -> np.ndarray:
    """The run of ORDER + 1 bytes that ends at each place, as a number; its last byte is the lowest."""
    key = body.astype(np.int64)
    for k in range(1, ORDER + 1):
        key[k:] |= body[:-k].astype(np.int64) << (8 * k)
    return key


def _own(body: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """True at the texts' own bytes."""
    step = np.zeros(len(body) + 1, np.int64)
    step[begins] += 1
    ends = np.append(begins[1:] - ORDER, len(body))
    step[ends] -= 1
    return np.cumsum(step)[:-1] > 0


class _Sums:
    """Counts by key, compacted as they grow."""

    def __init__(self) -> None:
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.size += len(k)
        if self.size > _KEEP:
            self.compact()

    def compact(self) -> None:
        if len(self.keys) > 1:
            k, back = np.unique(np.concatenate(self.keys), return_inverse=True)
            self.counts = [np.bincount(back, np.concatenate(self.counts)).astype(np.int64)]
            self.keys = [k]
        self.size = sum(map(len, self.keys))

    def drain(self, kind: int) -> Iterator[pa.RecordBatch]:
        self.compact()
        for k, c in zip(self.keys, self.counts, strict=True):
            for at in range(0, len(k), 100_000):
                own = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[own]), kind, np.int32)), pa.array(k[own].astype(np.int64)), pa.array(c[own].astype(np.int64))], names=["kind", "key", "n"])
        self.keys, self.counts, self.size = [], [], 0


def count(rows: DataFrame) -> DataFrame:
    """kind (0 words by hash, 1 runs), key, n over all rows."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, grams = _Sums(), _Sums()
        for b in batches:
            for t in textbytes.chunks(b.column("text")):
                t = textbytes.lowered(t)
                w = textbytes.words(t)
                tokens.add(np.concatenate([w.hash.view(np.int64), np.full(len(t), END_TOKEN, np.int64)]))
                body, begins = streams(t, w)
                grams.add(runs(body)[_own(body, begins)])
                if tokens.size > _KEEP // 2:
                    yield from tokens.drain(0)
                if grams.size > _KEEP // 2:
                    yield from grams.drain(1)
        yield from tokens.drain(0)
        yield from grams.drain(1)

    return rows.select("text").mapInArrow(lambda b: textbytes.released(counts(b)), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def lookup(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The value of each key; positive where the run isn't in the table."""
    slots, values = table
    mask = len(slots) - 1
    at = _slot(keys, mask)
    found = slots[at]
    out = np.where(found == keys, values[at], np.float32(1))
    left = np.flatnonzero((found != keys) & (found >= 0))
    at = at[left]
    while len(left):
        at = (at + 1) & mask
        found = slots[at]
        hit = found == keys[left]
        out[left[hit]] = values[at[hit]]
        go = ~hit & (found >= 0)
        left, at = left[go], at[go]
    return out.astype(np.float64)


def _slot(keys: np.ndarray, mask: int) -> np.ndarray:
    return (((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) & np.uint64(mask)).astype(np.int64)


def _hashed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, int(len(keys) * 2.5).bit_length())
    slots, out = np.full(size, -1, np.int64), np.zeros(size, np.float32)
    left, at = np.arange(len(keys)), _slot(keys, size - 1)
    while len(left):
        free = np.flatnonzero(slots[at] < 0)
        place, first = np.unique(at[free], return_index=True)
        won = left[free[first]]
        slots[place], out[place] = keys[won], values[won]
        stay = np.ones(len(left), bool)
        stay[free[first]] = False
        left, at = left[stay], (at[stay] + 1) & (size - 1)
    return slots, out


def _masked(key: str, size: int) -> Column:
    """The last `size` bytes of a run."""
    return F.col(key).bitwiseAND(F.lit((1 << 8 * size) - 1))


def trie(spark: SparkSession, counts: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """All runs (key, c) of each length from 1, and all contexts (ctx, total, kinds, shorter) of each order: the sum of counts, the different bytes, and
    what these count in the next shorter context."""
    grams = [counts.where("kind = 1").select("key", F.col("n").alias("c"))]
    for m in range(ORDER, 0, -1):
        grams.insert(0, common.stored(spark, grams[0].groupBy(_masked("key", m).alias("key")).agg(F.count(F.lit(1)).alias("c")), f"ppm-runs-{m}"))
    contexts = []
    for k, own in enumerate(grams):
        if k:
            own = own.withColumn("short", _masked("key", k)).join(grams[k - 1].select(F.col("key").alias("short"), F.col("c").alias("s")), "short")
        else:
            own = own.withColumn("s", F.lit(0))
        own = own.groupBy(F.shiftright("key", 8).alias("ctx")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("s").alias("shorter"))
        contexts.append(common.stored(spark, own, f"ppm-contexts-{k}"))
    return grams, contexts


def resolved(keys: DataFrame, grams: list[DataFrame], contexts: list[DataFrame]) -> DataFrame:
    """key, value: log10 probability of the last byte of each distinct run in its context, its other bytes, by joins with the whole trie."""
    rows = keys.withColumns({"value": F.lit(0.0), "done": F.lit(False), "s_": F.lit(0).cast("long"), "d_": F.lit(0).cast("long")})
    for k in range(ORDER, -1, -1):
        ctx, own = contexts[k], grams[k].withColumnsRenamed({"key": "run"})
        if k <= 1:  # 256 contexts and 65,536 runs at most
            ctx, own = F.broadcast(ctx), F.broadcast(own)
        rows = rows.join(ctx, F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * k) - 1)) == F.col("ctx"), "left").join(own, _masked("key", k + 1) == F.col("run"), "left")
        total, kinds = F.col("total") - F.col("s_"), F.col("kinds") - F.col("d_")
        open_ = ~F.col("done") & F.col("ctx").isNotNull() & (kinds > 0)
        seen = open_ & F.col("c").isNotNull()
        more = F.when(seen, F.log10((F.col("c") - 0.5) / total)).when(open_, F.log10(0.5 * kinds / total)).otherwise(F.lit(0.0))
        rows = rows.select("key", (F.col("value") + more).alias("value"), (F.col("done") | seen).alias("done"), F.coalesce("shorter", F.lit(0)).cast("long").alias("s_"), F.coalesce("kinds", F.lit(0)).cast("long").alias("d_"))
    return rows.select("key", F.when(F.col("done"), F.col("value")).otherwise(F.col("value") - F.log10(256 - F.col("d_"))).alias("value"))


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each key is, whether it is there)."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _frequent(counts: DataFrame, kind: int, most: int) -> DataFrame:
    """Rows of a kind with the largest counts, `most` at most: those from a bin of counts on, bins being sixteenths of a doubling."""
    own, step = counts.where(F.col("kind") == kind), F.floor(F.log2("n") * 16)
    have = {r["bin"]: r["k"] for r in own.groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("k")).collect()}  # 16 * 63 rows at most
    total, least = 0, 16 * 64
    for c in sorted(have, reverse=True):
        total += have[c]
        if total > most:
            break
        least = c
    return own.where(step >= least)


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    found = df.select("key", "n").toArrow()
    return found.column("key").to_numpy(), found.column("n").to_numpy()


def score(docs: DataFrame, max_nodes: int = MAX_NODES, top_tokens: int = TOP_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    common.require(docs, "doc_id", "text")
    spark = docs.sparkSession
    counts = common.stored(spark, count(docs.where(common.trainable(F.col("doc_id"), 10, 0))), "ppm-counts")
    total = counts.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).head()
    train_tokens, distinct = int(total[0]), int(total[1])
    grams, contexts = trie(spark, counts)
    often = _frequent(counts, 1, max_nodes).select("key", F.col("n").alias("c"))
    best = often.join(contexts[ORDER].select("ctx", "total"), F.shiftright("key", 8) == F.col("ctx")).select("key", F.log10((F.col("c") - 0.5) / F.col("total")).alias("n"))
    model = _hashed(*_arrays(best))
    top, often = _arrays(_frequent(counts, 0, top_tokens))
    order = np.argsort(top)
    held = spark.sparkContext.broadcast((model, top[order], often[order]))
    below = train_tokens + 0.1 * (distinct + 1)
    rows = docs.select("doc_id", common.held_out(F.col("doc_id"), 10, 0).alias("held_out"), "text")
    schema = rows.drop("text").schema.add("row", "long").add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double").add("token", "long").add("tf", "long").add("run", "long")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, top, often = held.value
        next_row = TaskContext.get().partitionId() << 36
        logs = np.log10((often + 0.1) / below) if len(often) else np.zeros(0)
        for b in batches:
            for t in textbytes.chunks(b.column("text")):
                n, own = len(t), b.slice(t.first, len(t))
                t = textbytes.lowered(t)
                w = textbytes.words(t)
                body, begins = streams(t, w)
                mine = _own(body, begins)
                values = np.zeros(len(body))
                run = runs(body)[mine]
                value = lookup(model, run)
                missed = value > 0
                values[mine] = np.where(missed, 0, value)
                total = np.add.reduceat(values, begins)
                miss_doc, miss, miss_tf = textbytes.counted((np.searchsorted(begins, np.flatnonzero(mine)[missed], "right") - 1), run[missed].view(np.uint64))
                token = np.concatenate([w.hash.view(np.int64), np.full(n, END_TOKEN, np.int64)])
                doc = np.concatenate([w.doc, np.arange(n)])
                at, known = _find(top, token)
                base = np.bincount(doc[known], logs[at[known]], n)
                row = next_row + np.arange(n)
                next_row += n
                null = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(row), pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc[known], minlength=n)), pa.array(base), pa.array(total), null, null, null], names=schema.names)
                m = len(miss)
                if m:
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, own.schema.field(0).type), pa.nulls(m, pa.bool_()), pa.array(row[miss_doc]), *[pa.nulls(m, pa.int64())] * 2, *[pa.nulls(m, pa.float64())] * 2, pa.nulls(m, pa.int64()), pa.array(miss_tf.astype(np.int64)), pa.array(miss.view(np.int64))], names=schema.names)
                rare_doc, rare, tf = textbytes.counted(doc[~known], token[~known])
                m = len(rare)
                if m:
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, own.schema.field(0).type), pa.nulls(m, pa.bool_()), pa.array(row[rare_doc]), *[pa.nulls(m, pa.int64())] * 2, *[pa.nulls(m, pa.float64())] * 2, pa.array(rare), pa.array(tf.astype(np.int64)), pa.nulls(m, pa.int64())], names=schema.names)

    found = common.stored(spark, rows.mapInArrow(lambda b: textbytes.released(scored(b)), schema), "ppm-scores")
    rare = found.where("token is not null").select("row", "token", "tf").join(counts.where("kind = 0").select(F.col("key").alias("token"), "n"), "token", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    sums = rare.groupBy("row").agg(F.sum(F.col("tf") * F.log10((c + 0.1) / below)).alias("more"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("more_known"))
    missed = found.where("run is not null").select("row", "run", "tf")
    values = common.stored(spark, resolved(missed.select(F.col("run").alias("key")).distinct(), grams, contexts), "ppm-resolved")
    escaped = missed.join(values, F.col("run") == F.col("key")).groupBy("row").agg(F.sum(F.col("tf") * F.col("value")).alias("more_score"))
    return found.where("token is null and run is null").join(sums, "row", "left").join(escaped, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
