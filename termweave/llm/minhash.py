"""Operator 7, near-duplicates by ProbMinHash.

Each text is its five-word shingles with weights 1 + ln(count). For each shingle exponential arrivals, all made from its hash, fall on random
registers; a register keeps its earliest arrival, and arrivals stop once they are later than the latest register. The share of
registers on which two texts agree estimates their probability Jaccard similarity, which is Jaccard similarity where weights are equal. Runs of
ROWS registers are bands; texts with an equal band are candidates, and candidates are verified on their whole sets of shingles. As sets
are what is verified, a text in which shingles repeat has a second set of bands, from weights of 1.

Equal texts are one text from the start (copies move as one row), so only different texts are compared. In a band with at most SMALL texts
all are compared with each other, in a larger one each with two leaders: the text that has the most company in all its bands, and one
drawn by hash, another one for each band. Joined classes follow; the texts of large bands that still hold several classes are dealt anew
by their rarest shingles (an exact prefix filter), and there texts of the smaller classes are compared with those of others. So a class of
thousands of near copies costs two comparisons a text and band, texts that merely share a frequent passage aren't compared
each with each, and no link is lost that shares a band. Classes are connected components of verified links.

Edge cases: texts without words (null, empty, blank) are never alike another and are a class of their own row; texts of fewer than five
words have one shingle of all their words; words are cut at ASCII white space and A-Z count as a-z; ids that repeat keep their rows, and a class's id is the
least doc_id among its texts; null ids are classed like others (a class of null ids has a null id); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, textbytes
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
SMALL = 12
#: Texts to verify up to this many are looked up by broadcasting their ids; more by a shuffle of the documents.
BROADCAST_ROWS = 100_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """ProbMinHash: for each of n texts and each register the shingle that arrived first (0: no shingles).

    doc, shingle, weight: distinct shingles of each text. Arrivals of a shingle are a Poisson process with its weight as rate.
    They come in blocks, larger ones for texts of few shingles, until every live shingle is later than its text's latest register.
    """
    first = np.full(n * registers, np.inf)
    holder = np.zeros(n * registers, np.uint64)
    count = np.bincount(doc, minlength=n)
    live = np.arange(len(doc))
    seed = textbytes.mix(shingle ^ np.uint64(0x2545F4914F6CDD1D))
    time, used = np.zeros(len(doc)), np.zeros(len(doc), np.int64)
    block = np.clip(registers * 3 // np.maximum(count, 1), 1, 64)
    while len(live):
        size = block[doc[live]]
        at = np.repeat(np.arange(len(live)), size)
        starts = np.cumsum(size) - size
        k = np.arange(len(at)) - starts[at] + used[live][at]
        r = textbytes.mix(seed[live][at] + (k.astype(np.uint64) + np.uint64(1)) * _STEP)
        gap = -np.log(((r >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)) / weight[live][at]
        total = np.cumsum(gap)
        arrival = total - (total[starts] - gap[starts])[at] + time[live][at]
        slot = doc[live][at] * registers + (textbytes.mix(r ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(registers)).astype(np.int64)
        better = np.flatnonzero(arrival < first[slot])
        np.minimum.at(first, slot[better], arrival[better])
        won = better[arrival[better] == first[slot[better]]]
        holder[slot[won]] = shingle[live][at[won]]
        ends = starts + size - 1
        time[live], used[live] = arrival[ends], used[live] + size
        latest = first.reshape(n, registers).max(1)
        live = live[time[live] < latest[doc[live]]]
    return holder.reshape(n, registers)


def _bands(sig: np.ndarray) -> np.ndarray:
    """The hash of each run of ROWS registers, another one for each place."""
    bands = np.zeros((len(sig), BANDS), np.uint64)
    for j in range(ROWS):
        bands += sig[:, j::ROWS] * textbytes.powers(ROWS + 1)[j + 1]
    return textbytes.mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), k1, k2 (128-bit hash of the words; null without words), bands of every row."""
    common.require(docs, "doc_id", "text")
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    schema = rows.drop("text").schema.add("k1", "long").add("k2", "long").add("bands", T.ArrayType(T.LongType()))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in textbytes.chunks(b.column("text")):
                n = len(t)
                w = textbytes.words(textbytes.lowered(t))
                own = b.slice(t.first, n)
                has = np.bincount(w.doc, minlength=n) > 0
                keys = np.zeros((2, n), np.uint64)
                if len(w):
                    begins = np.flatnonzero(np.concatenate([[True], w.doc[1:] != w.doc[:-1]]))
                    place = np.arange(len(w)) - np.repeat(begins, np.diff(np.append(begins, len(w))))
                    power = textbytes.powers(int(place.max()) + 2)[place + 1]
                    for j, salted in enumerate((w.hash, textbytes.mix(w.hash ^ np.uint64(0xA0761D6478BD642F)))):
                        keys[j, w.doc[begins]] = textbytes.mix(np.add.reduceat(salted * power, begins))
                doc, shingle, often = textbytes.counted(*textbytes.shingles(w, n, SHINGLE))
                bands = _bands(signatures(doc, shingle, 1 + np.log(often), n, BANDS * ROWS))
                again = np.bincount(doc[often > 1], minlength=n) > 0
                own_again = again[doc]
                place = np.cumsum(again) - 1
                plain = np.zeros_like(bands)
                plain[again] = _bands(signatures(place[doc[own_again]], shingle[own_again], np.ones(int(own_again.sum())), int(again.sum()), BANDS * ROWS))
                use = np.column_stack([np.repeat(has[:, None], BANDS, 1), np.repeat(again[:, None], BANDS, 1)])
                offsets = np.concatenate([[0], np.cumsum(use.sum(1))]).astype(np.int32)
                longs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.column_stack([bands, plain])[use]))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *(pa.array(k.view(np.int64), mask=~has) for k in keys), longs], names=schema.names)

    return rows.mapInArrow(lambda b: textbytes.released(sketch(b)), schema)


def similarity(pairs: DataFrame) -> DataFrame:
    """Rows of x, y, text_x, text_y to x, y, jaccard: exact, over the texts' sets of shingles."""
    schema = pairs.select("x", "y").schema.add("jaccard", "double")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = pa.concat_arrays([b.column("text_x").cast(pa.large_string()), b.column("text_y").cast(pa.large_string())])
            out = np.zeros(b.num_rows)
            # the two texts of a pair side by side
            for t in textbytes.chunks(both.take(pa.array(np.arange(2 * b.num_rows).reshape(2, -1).T.ravel())), step=2):
                doc, h, _ = textbytes.counted(*textbytes.shingles(textbytes.words(textbytes.lowered(t)), len(t), SHINGLE))
                sizes = np.bincount(doc, minlength=len(t)).reshape(-1, 2).sum(1)
                pair, _, sides = textbytes.counted(doc // 2, h)
                shared = np.bincount(pair[sides == 2], minlength=len(sizes))
                out[t.first // 2 : t.first // 2 + len(sizes)] = shared / np.maximum(sizes - shared, 1)
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), pa.array(out)], names=schema.names)

    return pairs.mapInArrow(lambda b: textbytes.released(compare(b)), schema)


def _texts(ids: DataFrame, docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """text_id, text of the texts in ids. firsts: text_id, doc_id, h of a row with each text."""
    wanted = common.stored(ids.sparkSession, firsts.join(ids, "text_id", "left_semi"), "minhash-wanted").withColumnsRenamed({"doc_id": "first_doc", "h": "first_h"})
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    return rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("h") == F.col("first_h"))).select("text_id", "text").dropDuplicates(["text_id"])


def _verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, threshold: float) -> DataFrame:
    """The pairs x, y of text ids whose texts are alike, as edges a, b."""
    spark = pairs.sparkSession
    pairs = common.stored(spark, pairs.distinct(), "minhash-pairs")
    # stored, so that the joins are of plain tables and a leader's many pairs are dealt over many tasks
    own = common.stored(spark, _texts(pairs.select(F.col("x").alias("text_id")).union(pairs.select("y")).distinct(), docs, firsts), "minhash-pair-texts")
    joined = pairs.join(own.withColumnsRenamed({"text_id": "x", "text": "text_x"}), "x").join(own.withColumnsRenamed({"text_id": "y", "text": "text_y"}), "y")
    alike = similarity(joined.select("x", "y", "text_x", "text_y")).where(F.col("jaccard") >= threshold)
    return common.stored(spark, alike.select(F.col("x").alias("a"), F.col("y").alias("b"), "jaccard"), "minhash-links")


def _shared(members: DataFrame) -> DataFrame:
    """band, text_id, n (texts in the band), central (texts in all bands of this text) where n > 1."""
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = common.stored(members.sparkSession, members.join(sizes, "band"), "minhash-shared")
    return shared.join(shared.groupBy("text_id").agg(F.sum("n").alias("central")), "text_id")


def _star(shared: DataFrame) -> DataFrame:
    """Pairs of each large band's two leaders with its other texts, and all pairs in small bands."""
    large, small = shared.where(F.col("n") > SMALL), shared.where(F.col("n") <= SMALL)
    leaders = large.groupBy("band").agg(F.max_by("text_id", F.struct("central", "text_id")).alias("central"), F.min_by("text_id", F.xxhash64("band", "text_id")).alias("drawn"))
    led = large.select("band", "text_id").join(leaders, "band").select("text_id", F.explode(F.array("central", "drawn")).alias("leader")).where("text_id <> leader")
    groups = small.groupBy("band").agg(F.array_sort(F.collect_list("text_id")).alias("all"))
    pairs = F.flatten(F.transform("all", lambda x, i: F.transform(F.slice("all", i + 2, F.lit(SMALL)), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return led.select(F.least("leader", "text_id").alias("x"), F.greatest("leader", "text_id").alias("y")).union(groups.select(F.explode(pairs).alias("p")).select("p.x", "p.y"))


def _leftover(shared: DataFrame, labels: DataFrame, docs: DataFrame, firsts: DataFrame, threshold: float) -> DataFrame:
    """Pairs across classes among the texts of large bands that hold several classes.

    Two texts of that likeness share one of their rarest shingles (so many of each as the likeness lets differ, and one), so
    these texts are dealt by those, counted among themselves; texts that have a frequent passage in common only don't meet. In each deal, texts of
    all but the largest class are paired with those of other classes if what follows the shared shingle in both could still make them alike.
    """
    spark = shared.sparkSession
    classed = shared.where(F.col("n") > SMALL).select("band", "text_id").join(labels.withColumnRenamed("node", "text_id"), "text_id", "left").withColumn("label", F.coalesce("label", "text_id"))
    mixed = classed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
    inside = common.stored(spark, classed.join(mixed, "band").select("text_id", "label").distinct(), "minhash-mixed")
    each = common.stored(spark, _each_shingle(_texts(inside, docs, firsts)), "minhash-shingles")
    # stored, so that the joins by shingle are of two plain tables and a frequent one is dealt over many tasks
    often = common.stored(spark, each.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")), "minhash-often")
    rarest = Window.partitionBy("text_id").orderBy("often", "shingle")
    prefix = each.join(often, "shingle").withColumn("place", F.row_number().over(rarest)).where(F.col("place") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-6) + 1)
    dealt = common.stored(spark, prefix.where("often > 1").select("shingle", "text_id", "n", "place").join(inside, "text_id"), "minhash-dealt")
    top = dealt.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("shingle").agg(F.max_by("label", F.struct("c", "label")).alias("largest"), F.count(F.lit(1)).alias("classes")).where("classes > 1").select("shingle", "largest")
    live = common.stored(spark, dealt.join(common.stored(spark, top, "minhash-top"), "shingle"), "minhash-live")
    minor = live.where(F.col("label") != F.col("largest")).select("shingle", F.col("text_id").alias("m"), F.col("label").alias("of_m"), F.col("n").alias("n_m"), F.col("place").alias("place_m"))
    shared_least = F.ceil(threshold / (1 + threshold) * (F.col("n") + F.col("n_m")) - 1e-6)
    fits = (1 + F.least(F.col("n") - F.col("place"), F.col("n_m") - F.col("place_m")) >= shared_least) & (F.col("label") != F.col("of_m")) & ((F.col("label") == F.col("largest")) | (F.col("text_id") < F.col("m")))
    return live.join(minor, "shingle").where(fits).select(F.least("m", "text_id").alias("x"), F.greatest("m", "text_id").alias("y"))


def _each_shingle(texts: DataFrame) -> DataFrame:
    """text_id, shingle, n (distinct shingles of the text)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in textbytes.chunks(b.column("text")):
                doc, h, _ = textbytes.counted(*textbytes.shingles(textbytes.words(textbytes.lowered(t)), len(t), SHINGLE))
                n = np.bincount(doc, minlength=len(t))
                yield pa.RecordBatch.from_arrays([b.column("text_id").take(pa.array(doc + t.first)), pa.array(h.view(np.int64)), pa.array(n[doc])], names=["text_id", "shingle", "n"])

    return texts.select("text_id", "text").mapInArrow(lambda b: textbytes.released(emit(b)), "text_id string, shingle long, n long")


def _classed(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, h, text_id (null without words), class_id, kept (doc_id and h of the class's first row), copies, links and likeness of every row."""
    spark = docs.sparkSession
    rows = common.stored(spark, sketches(docs), "minhash-sketches")
    # one text for all rows with the same words; its id is its own 128-bit hash
    text_id = F.when(F.col("k1").isNotNull(), F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0")))
    rows = rows.withColumn("text_id", text_id)
    texts = rows.where("text_id is not null").groupBy("text_id").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("bands").alias("bands"))
    texts = common.stored(spark, texts, "minhash-texts")
    members = common.stored(spark, texts.select("text_id", F.explode(F.array_distinct("bands")).alias("band")), "minhash-bands")
    firsts = texts.select("text_id", "first.doc_id", "first.h")
    shared = common.stored(spark, _shared(members), "minhash-central")
    links = _verified(_star(shared), docs, firsts, threshold)
    labels = components(links)
    more = _verified(_leftover(shared, labels, docs, firsts, threshold), docs, firsts, threshold)
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links)
    ends = links.select(F.col("a").alias("text_id"), F.col("b").alias("other"), "jaccard").union(links.select("b", "a", "jaccard"))
    ends = ends.groupBy("text_id", "other").agg(F.max("jaccard").alias("jaccard")).groupBy("text_id").agg(F.count(F.lit(1)).alias("links"), F.max("jaccard").alias("likeness"))
    named = texts.select("text_id", "first", "copies").join(labels.withColumnRenamed("node", "text_id"), "text_id", "left").withColumn("label", F.coalesce("label", "text_id"))
    ids = named.groupBy("label").agg(F.min("first").alias("kept"))
    named = named.join(ids, "label").join(ends, "text_id", "left").select("text_id", "kept", "copies", "links", "likeness")
    return rows.select("doc_id", "h", "text_id").join(named, "text_id", "left").withColumn("class_id", F.when(F.col("text_id").isNull(), F.col("doc_id")).otherwise(F.col("kept.doc_id")))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the least doc_id in the class), copies (rows with the same words), links (different texts that verification found alike), likeness
    (the highest verified similarity to another row: 1 for copies; null for a class of one row) of every row."""
    copies = F.coalesce("copies", F.lit(1)).cast("long")
    return _classed(docs, threshold).select("doc_id", "class_id", copies.alias("copies"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.when(copies > 1, F.lit(1.0)).otherwise(F.col("likeness")).alias("likeness"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with all their columns; one row of each class stays, that with the least doc_id, and every row without words."""
    spark = docs.sparkSession
    found = common.stored(spark, _classed(docs, threshold).where("text_id is not null").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n"), F.min("kept").alias("kept")), "minhash-rows")
    kept = F.struct("doc_id", "h") == F.col("kept")
    own_id, own_h, of, of_h, twice = common.fresh(docs, "own_id", "own_h", "of", "of_h", "twice")
    marks = found.where(~kept | (F.col("n") > 1)).select(F.struct("doc_id").alias(of), F.col("h").alias(of_h), kept.alias(twice))
    marks = common.stored(spark, marks, "minhash-marks")
    repeated = not marks.where(F.col(twice)).isEmpty()
    if marks.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    rows = docs.withColumns({own_id: F.struct("doc_id"), own_h: F.xxhash64("text")})
    rows = rows.join(marks, F.col(own_id).eqNullSafe(F.col(of)) & (F.col(own_h) == F.col(of_h)), "left")
    out = rows.where(F.col(twice).isNull())
    if repeated:
        out = out.unionByName(rows.where(F.col(twice)).dropDuplicates([own_id, own_h]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
