"""Predictions against gold (D-13, D-15, E-6 to E-9, E-14, G-2, L-1 to L-5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank


def case_id(explicit: Column, record: Column, sau: Column) -> Column:
    """The case id if given, else the record's, else the unit's; an explicit blank one is an error (null)."""
    blank = lambda c: F.when(~is_blank(c), c)
    return F.when(explicit.isNotNull(), blank(explicit)).otherwise(F.coalesce(blank(record), blank(sau)))


def gold_problems(gold: DataFrame) -> DataFrame:
    """case_id and codes of rows that can't be used. gold: case_id, source_value, expected_ids (array)."""
    codes = F.array_compact(F.array(
        F.when(is_blank(F.col("case_id")), F.lit("BLANK_CASE_ID")), F.when(F.trim("case_id") != F.col("case_id"), F.lit("UNTRIMMED_CASE_ID")), F.when(is_blank(F.col("source_value")), F.lit("BLANK_SOURCE_VALUE")),
        F.when(F.size(F.array_distinct("expected_ids")) < F.size("expected_ids"), F.lit("DUPLICATE_EXPECTED_ID")), F.when(F.exists("expected_ids", is_blank), F.lit("BLANK_EXPECTED_ID")),
    ))
    return gold.withColumn("codes", codes).where(F.size("codes") > 0)


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_none(violations: DataFrame, what: str) -> None:
    """Raise if there are violations: the caller's choice, one action."""
    some = violations.limit(5).collect()
    if some:
        raise ValueError(f"{what}: {some}")


def pair_cases(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row for each case id of either side: gold's and predictions' columns as structs g and p, and side (shared, missing, unexpected)."""
    g, p = gold.select("case_id", F.struct(*gold.columns).alias("g")), predictions.select("case_id", F.struct(*predictions.columns).alias("p"))
    side = F.when(F.col("p").isNull(), F.lit("missing")).when(F.col("g").isNull(), F.lit("unexpected")).otherwise(F.lit("shared"))
    return g.join(p, "case_id", "full").withColumn("side", side)


def value_mismatches(pairs: DataFrame) -> DataFrame:
    """Shared cases whose source values differ; a null predicted value passes."""
    return pairs.where((F.col("side") == "shared") & F.col("p.source_value").isNotNull() & (F.col("p.source_value") != F.col("g.source_value"))).select("case_id", F.col("g.source_value").alias("gold_value"), F.col("p.source_value").alias("predicted_value"))


def context_mismatches(pairs: DataFrame) -> DataFrame:
    """Shared cases whose gold context (map) isn't met: no context or mapping key on the prediction, or fields that differ (sorted)."""
    wanted = F.map_filter("g.context", lambda k, v: v.isNotNull())
    keys = F.sort_array(F.map_keys(F.map_filter(wanted, lambda k, v: ~F.coalesce(F.col("p.context")[k] == v, F.lit(False)))))
    lacking = F.col("p.context").isNull() | F.col("p.mapping_key").isNull()
    out = pairs.where((F.col("side") == "shared") & (F.size(F.map_keys(wanted)) > 0)).withColumn("evidence_missing", lacking).withColumn("fields", keys)
    return out.where(F.col("evidence_missing") | (F.size("fields") > 0)).select("case_id", "evidence_missing", "fields")


def evaluate(pairs: DataFrame, by: str = "category") -> DataFrame:
    """Counts and rates by category and overall (category `ALL`, level 1): a missing prediction is never correct, an empty selection is if nothing was expected."""
    rows = pairs.where("g is not null")
    there = F.col("p").isNotNull()
    right = there & (F.array_sort(F.array_distinct("g.expected_ids")) == F.array_sort(F.array_distinct("p.selected_ids")))
    accepted = there & (F.col("p.routing_status") == "AUTO_ACCEPT")
    name = F.col(f"g.{by}") if by in rows.select("g.*").columns else F.col(f"p.{by}")
    context = F.size(F.coalesce(F.map_keys("g.context"), F.array().cast("array<string>"))) > 0
    rows = rows.select(
        F.when(F.coalesce(name, F.lit("")) == "", F.lit("uncategorized")).otherwise(name).alias("category"), there.alias("there"), right.alias("right"), accepted.alias("accepted"),
        (there & (F.col("p.routing_status") == "HUMAN_REVIEW")).alias("reviewed"), (there & (F.col("p.routing_status") == "ABSTAIN")).alias("abstained"), (there & context).alias("context"),
    )
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(F.lit(0.0))
    out = rows.groupingSets([["category"], []], "category").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("gold_cases"), n(F.col("there")).alias("evaluated"), n(~F.col("there")).alias("missing"), n(F.col("accepted")).alias("accepted"), n(F.col("reviewed")).alias("reviewed"),
        n(F.col("abstained")).alias("abstained"), n(F.col("right")).alias("correct"), n(F.col("right") & F.col("accepted")).alias("accepted_correct"), n(F.col("context")).alias("context_verified"),
    )
    return out.withColumns({
        "category": F.when(F.col("level") == 1, F.lit("ALL")).otherwise(F.col("category")), "coverage": rate(F.col("accepted"), F.col("gold_cases")),
        "accuracy": rate(F.col("correct"), F.col("gold_cases")), "precision": rate(F.col("accepted_correct"), F.col("accepted")),
    })


def selective_accuracy(pairs: DataFrame) -> DataFrame:
    return evaluate(pairs).where("level = 1").select("gold_cases", "accepted", "accepted_correct", "coverage", "precision")


def recall_at_k(gold: DataFrame, packages: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """One row: share of positive cases with an expected concept among the first k candidates or what they relate to; share of
    negative cases without candidates. packages: case_id, candidates (array of candidate_id, edges)."""
    rows = gold.join(packages, "case_id", "left")
    hit = F.transform("candidates", lambda c: F.arrays_overlap(F.concat(F.array(c["candidate_id"]), F.transform(c["edges"], lambda e: e["object_id"])), F.col("expected_ids")))
    rows = rows.withColumn("place", F.array_position(hit, True)).withColumn("positive", F.size("expected_ids") > 0)
    share = lambda a, b: F.when(F.count_if(b) > 0, F.round(F.count_if(b & a) / F.count_if(b), 4)).otherwise(F.lit(0.0))
    found = [share(F.coalesce((F.col("place") > 0) & (F.col("place") <= k), F.lit(False)), F.col("positive")).alias(f"recall_at_{k}") for k in ks]
    none = F.coalesce(F.size("candidates"), F.lit(0)) <= 0
    return rows.agg(F.count_if("positive").alias("positives"), F.count_if(~F.col("positive")).alias("negatives"), *found, share(none, ~F.col("positive")).alias("rejection_specificity"))


def missed_values(gold: DataFrame, packages: DataFrame) -> DataFrame:
    """source_value of the positive cases without a hit."""
    every = F.flatten(F.transform("candidates", lambda c: F.concat(F.array(c["candidate_id"]), F.transform(c["edges"], lambda e: e["object_id"]))))
    rows = gold.join(packages, "case_id", "left").where(F.size("expected_ids") > 0)
    return rows.where(~F.coalesce(F.arrays_overlap(every, F.col("expected_ids")), F.lit(False))).select("case_id", "source_value")


def report(pairs: DataFrame) -> DataFrame:
    """One row: sorted missing and unexpected counts and whether the evaluation is complete."""
    n = lambda s: F.count_if(F.col("side") == s)
    return pairs.agg(n("shared").alias("shared"), n("missing").alias("missing"), n("unexpected").alias("unexpected")).withColumn("complete", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """case_id, old_ids, new_ids (sorted) of cases whose mapped sets differ between two runs. Both: case_id, selected_ids."""
    ids = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    a, b = old.select("case_id", ids(F.col("selected_ids")).alias("old_ids")), new.select("case_id", ids(F.col("selected_ids")).alias("new_ids"))
    return a.join(b, "case_id", "full").where(~F.col("old_ids").eqNullSafe(F.col("new_ids")))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: how many cases moved, whether the release changed, and drift or current. Both: case_id, selected_ids, release."""
    moved = compare_runs(old, new).agg(F.count(F.lit(1)).alias("moved"))
    releases = old.agg(F.max("release").alias("a")).join(new.agg(F.max("release").alias("b")))
    return moved.join(releases).select("moved", (~F.col("a").eqNullSafe(F.col("b"))).alias("release_changed"), F.when(F.col("moved") > 0, F.lit("drift")).otherwise(F.lit("current")).alias("overall"))
