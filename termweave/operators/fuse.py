"""Hits to ranked candidates (E-1 to E-3, F-1 to F-3, F-5, F-6, G-1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vocab


def channel_priority(c: Column) -> Column:
    return text.lookup(vocab.CHANNEL_PRIORITY, c, F.lit(vocab.OTHER_PRIORITY))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def fuse(hits: DataFrame) -> DataFrame:
    """unit_key, channel, candidate_id, score, hit_rank, status, source_vocabulary, hit_order to one row for each unit and candidate: evidence in hit order,
    channels and vocabularies without repeats, the first status that is known, best_score (0 without a score), best_rank."""
    evidence = F.struct("hit_order", "channel", "score", "hit_rank", "source_vocabulary")
    known = F.when(F.col("status") != "unknown", F.struct("hit_order", "status"))
    out = hits.groupBy("unit_key", "candidate_id").agg(
        F.array_sort(F.collect_list(evidence)).alias("evidence"), F.coalesce(F.min(known)["status"], F.lit("unknown")).alias("status"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("best_score"), F.min("hit_rank").alias("best_rank"), F.min(channel_priority(F.col("channel"))).alias("priority"),
    )
    return out.withColumn("channels", F.array_distinct("evidence.channel")).withColumn("vocabularies", F.array_distinct("evidence.source_vocabulary"))


def channel_agreement(channels: Column) -> Column:
    """Distinct channels, but for the historical one."""
    return F.size(F.array_except(channels, F.array(F.lit(vocab.HISTORICAL))))


def rank_candidates(fused: DataFrame, k: int) -> DataFrame:
    """The k best of each unit: channel, then active, then score, then id; rank from 1."""
    order = Window.partitionBy("unit_key").orderBy("priority", F.when(F.col("status") == "active", 0).otherwise(1), F.desc("best_score"), "candidate_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def score_margin(candidates: Column, selected: Column) -> Column:
    """The selected candidate's best score less the best among others that share a channel; null without others. candidates: array of structs."""
    own = F.get(F.filter(candidates, lambda c: c["candidate_id"] == selected), F.lit(0))
    others = F.filter(candidates, lambda c: (c["candidate_id"] != selected) & F.arrays_overlap(c["channels"], own["channels"]))
    return own["best_score"] - F.array_max(F.transform(others, lambda c: c["best_score"]))
