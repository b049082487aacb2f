"""Operator 6, mixing sources to target weights by Poisson replication (DataFrame functions only).

A source's rate is what turns its characters into its target share of the output. Each document's uniform number comes from a
hash of its id and a seed; inverting the Poisson distribution of its source's rate at that number gives its count of copies, so the
draw is the same wherever and however often it is made. Distribution tables are made once per source. Documents are exploded by their
counts and dealt to partitions by a hash of id and copy, then sorted by it within each: a uniform order over all rows with one shuffle,
in which no source, however large, meets in one task.

Edge cases: null source is a source; null texts count no characters, and a source without characters (or with weight 0, or that `weights`
doesn't name) gives no copies; a row without an id is drawn by its text; repeated rows share their count, and are dealt by the partition they were read in too; rates above PART are the
sum of independent parts, so no rate underflows; an empty table gives an empty result; all columns of the input are carried, and columns of
its own named `copy`, `copies` and `shuffle_key` are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Rates are split into equal parts of at most this.
PART = 32.0
SEED = 17
#: Without given weights a source's share is its characters to this power: large sources are thinned, small ones repeated.
TEMPERATURE = 0.5
BROADCAST_SOURCES = 10_000


def _uniform(*parts: Column) -> Column:
    """In (0, 1), from the first 52 bits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws("/", *parts).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, ratio: float = 1.0, temperature: float = TEMPERATURE) -> DataFrame:
    """source, rate (mean copies of each of its documents), parts, cdf (of one part's distribution)."""
    common.require(docs, "source", "text")
    sizes = docs.groupBy("source").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("double").alias("chars")).where("chars > 0")
    sizes = common.stored(docs.sparkSession, sizes, "mixing-sizes")
    if weights is None:
        weight = F.pow(F.col("chars"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, share in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(share))).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    total, mass = sizes.agg(F.sum("chars"), F.sum("weight")).head()
    rate = F.lit(float(ratio * (total or 0))) * F.col("weight") / F.lit(float(mass or 1)) / F.col("chars")
    out = sizes.select("source", rate.alias("rate")).withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    part = F.col("rate") / F.col("parts")
    last = F.ceil(part + 12 * F.sqrt(part) + 20).cast("int")
    # p and the sum so far run along k = 1, 2, ...; the array ends where the rest is beyond any uniform number
    start = F.struct(F.exp(-part).alias("p"), F.exp(-part).alias("sum"), F.array(F.exp(-part)).alias("all"))

    def longer(s: Column, k: Column) -> Column:
        p = s["p"] * part / k
        return F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), F.concat(s["all"], F.array(s["sum"] + p)).alias("all"))

    return out.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), last), start, longer, lambda s: s["all"]))


def replicate(docs: DataFrame, weights: Mapping[str | None, float] | None = None, ratio: float = 1.0, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """All columns of docs, copies (of this document), copy (from 0) and shuffle_key, in shuffled order."""
    common.require(docs, "doc_id", "source", "text")
    table = common.stored(docs.sparkSession, rates(docs, weights, ratio, temperature), "mixing-rates")
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    own = [c for c in docs.columns if c.lower() not in ("copy", "copies", "shuffle_key")]
    of, own_of, parts, cdf, read_in = common.fresh(docs, "of", "own_of", "parts", "cdf", "read_in")
    table = table.select(F.struct("source").alias(of), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    rows = docs.select(*[F.col(f"`{c}`") for c in own], F.spark_partition_id().alias(read_in)).withColumn(own_of, F.struct("source")).join(table, F.col(own_of).eqNullSafe(F.col(of)))
    name, start = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))), F.lit(str(seed))

    def drawn(j: Column) -> Column:
        u = _uniform(start, name, j.cast("string"))
        return F.size(F.filter(F.col(cdf), lambda c: c < u))

    counted = rows.withColumn("copies", F.aggregate(F.sequence(F.lit(0), F.col(parts) - 1), F.lit(0), lambda n, j: n + drawn(j)))
    key = F.md5(F.concat_ws("/", F.lit("order"), start, name, F.col("copy").cast("string")).cast("binary"))
    out = counted.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("shuffle_key", key)
    dealt = out.repartition("shuffle_key", read_in).sortWithinPartitions("shuffle_key")
    return dealt.select(*[F.col(f"`{c}`") for c in own], "copies", "copy", "shuffle_key")


REPLICATE_SQL = """
WITH RECURSIVE sizes AS (SELECT source, CAST(sum(length(text)) AS DOUBLE) AS chars FROM documents GROUP BY source HAVING sum(length(text)) > 0),
totals AS (SELECT sum(chars) AS total, sum(pow(chars, 0.5)) AS mass FROM sizes),
rates AS (SELECT source, total * pow(chars, 0.5) / mass / chars AS rate FROM sizes, totals),
parts AS (SELECT source, rate, CAST(greatest(ceil(rate / 32.0), 1) AS INTEGER) AS parts FROM rates),
steps(source, parts, rate, k, p, cdf) AS (
  SELECT source, parts, rate / parts, 0, exp(-rate / parts), exp(-rate / parts) FROM parts
  UNION ALL SELECT source, parts, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 20)),
named AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS name FROM documents),
uniform AS (SELECT name, source, parts, j, (CAST(('0x' || substr(md5('17/' || name || '/' || CAST(j AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM (SELECT DISTINCT name, d.source, p.parts, unnest(range(0, p.parts)) AS j FROM named d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)),
counts AS (SELECT u.name, u.source, count(*) AS copies FROM uniform u JOIN steps s ON s.source IS NOT DISTINCT FROM u.source AND s.cdf < u.u GROUP BY u.name, u.source),
copies AS (SELECT d.name, d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(c.copies AS INTEGER) AS copies, CAST(unnest(range(0, c.copies)) AS INTEGER) AS copy
  FROM named d JOIN counts c ON c.name = d.name AND c.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, text, lang, source, n_chars, copies, copy, md5('order/17/' || name || '/' || CAST(copy AS VARCHAR)) AS shuffle_key FROM copies
"""
