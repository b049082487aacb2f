"""Relationships of candidates (C-1 to C-4, D-8, D-9, F-4), evidence (E-4, E-5) and packages (H-10)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..profile import Profile


def permit_edges(edges: DataFrame, p: Profile) -> DataFrame:
    out = edges.where(~F.col("predicate").isin(*p.prohibited_predicates)) if p.prohibited_predicates else edges
    return out.where(F.col("predicate").isin(*p.allowed_predicates)) if p.allowed_predicates else out


def blocked_predicates(edges: DataFrame, p: Profile) -> DataFrame:
    """subject_id, predicates: the prohibited predicates that were there."""
    return edges.where(F.col("predicate").isin(*p.prohibited_predicates)).groupBy("subject_id").agg(F.sort_array(F.collect_set("predicate")).alias("predicates"))


def supported_predicates(edges: DataFrame, p: Profile) -> DataFrame:
    """predicate, supported: the profile's allowed predicates and whether any edge has them."""
    wanted = edges.sparkSession.createDataFrame([(x,) for x in p.allowed_predicates], "predicate string")
    have = edges.where(F.col("predicate").isin(*p.allowed_predicates)).select("predicate").distinct().withColumn("supported", F.lit(True))
    return wanted.join(F.broadcast(have), "predicate", "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def permits_relation(c: Column, p: Profile) -> Column:
    return c.isin(*p.relation_types) if p.relation_types else F.lit(True)


def related_direct(candidates: DataFrame, edges: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """candidate_id with its edges of the given predicates."""
    own = edges.where(F.col("predicate").isin(*predicates)).withColumnRenamed("subject_id", "candidate_id")
    return candidates.select("candidate_id").distinct().join(own, "candidate_id").withColumn("direct", F.lit(True))


def related_closure(candidates: DataFrame, edges: DataFrame, classes: Sequence[str], max_hops: int, stored: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """candidate_id, predicate, object_id, object_label, object_class, hops: concepts of the given classes reached by forward edges, each by its
    shortest walk; the predicate is named after the reached class."""
    narrow = edges.select("subject_id", "object_id", "object_label", "object_class").distinct()
    reached = stored(candidates.select("candidate_id").distinct().select("candidate_id", F.col("candidate_id").alias("object_id"), F.lit(None).cast("string").alias("object_label"), F.lit(None).cast("string").alias("object_class"), F.lit(0).alias("hops")), "closure")
    front = reached
    for hop in range(1, max_hops + 1):
        step = front.select("candidate_id", F.col("object_id").alias("subject_id")).join(narrow, "subject_id").groupBy("candidate_id", "object_id").agg(F.min("object_label").alias("object_label"), F.min("object_class").alias("object_class"))
        front = stored(step.join(reached.select("candidate_id", "object_id"), ["candidate_id", "object_id"], "left_anti").withColumn("hops", F.lit(hop)).select(*reached.columns), "closure")
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    named = F.create_map(*[F.lit(x) for kv in vocab.REACHED.items() for x in kv])
    return reached.where((F.col("hops") > 0) & F.col("object_class").isin(*classes)).select("candidate_id", named[F.col("object_class")].alias("predicate"), "object_id", "object_label", "object_class", "hops")


def enrich(ranked: DataFrame, edges: DataFrame, p: Profile) -> DataFrame:
    """ranked (unit_key, candidate_id, rank, concept_class) with `batch`, `enriched` and `edges`. Candidates get edges in batches; the first batch by whose end some
    candidate is of the target class, or has the target's edge, is the last. Without a policy for the granularity all get edges."""
    permitted = permit_edges(edges, p)
    order = "edge_order" if "edge_order" in edges.columns else "object_id"
    grouped = permitted.groupBy(F.col("subject_id").alias("candidate_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "predicate", "object_id", "object_label", "object_class"))), lambda e: F.struct(e["predicate"].alias("predicate"), e["object_id"].alias("object_id"), e["object_label"].alias("object_label"), e["object_class"].alias("object_class"))).alias("all_edges"))
    rows = ranked.withColumn("batch", F.ceil(F.col("rank") / p.enrichment_batch).cast("int")).join(grouped, "candidate_id", "left")
    policy = vocab.GRANULARITY.get(p.granularity or "")
    if policy is None:
        rows = rows.withColumn("stop", F.lit(None).cast("int"))
    else:
        predicate, _, classes = policy
        hit = F.col("concept_class").isin(*classes) | F.coalesce(F.exists("all_edges", lambda e: e["predicate"] == predicate), F.lit(False))
        rows = rows.withColumn("stop", F.min(F.when(hit, F.col("batch"))).over(Window.partitionBy("unit_key")))
    reached = F.coalesce(F.col("batch") <= F.col("stop"), F.lit(True))
    empty = F.array().cast("array<struct<predicate:string,object_id:string,object_label:string,object_class:string>>")
    return rows.withColumn("enriched", reached).withColumn("edges", F.when(reached, F.coalesce("all_edges", empty)).otherwise(empty)).drop("all_edges", "stop")


def evidence_index(candidates: DataFrame) -> DataFrame:
    """unit_key, vocabulary_lc, concept_id, label, concept_class, status, direct, sources, predicates. candidates: unit_key, candidate_id, vocabulary, label, concept_class,
    status, edges. What was retrieved itself beats what a relationship says; a target is active only by an ingredient edge of an active candidate."""
    lower = F.lower("vocabulary").alias("vocabulary_lc")
    own = candidates.select("unit_key", lower, F.col("candidate_id").alias("concept_id"), F.lit(True).alias("direct"), "label", "concept_class", "status", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("predicate"))
    e = candidates.select("unit_key", lower, "candidate_id", F.col("status").alias("own_status"), F.explode("edges").alias("e"))
    given = F.create_map(F.lit("has_ingredient"), F.lit("IN"), F.lit("has_precise_ingredient"), F.lit("PIN"), F.lit("has_boss"), F.lit("IN"))
    inherited = F.when((F.col("own_status") == "active") & F.col("e.predicate").isin("has_ingredient", "has_precise_ingredient", "has_boss"), F.lit("active")).otherwise(F.lit("unknown"))
    told = e.select("unit_key", "vocabulary_lc", F.col("e.object_id").alias("concept_id"), F.lit(False).alias("direct"), F.col("e.object_label").alias("label"), F.coalesce(F.col("e.object_class"), given[F.col("e.predicate")]).alias("concept_class"), inherited.alias("status"), F.col("candidate_id").alias("source"), F.col("e.predicate").alias("predicate"))
    first = F.when(F.col("direct"), F.lit(0)).otherwise(F.lit(1))
    known = F.when((F.col("status") != "unknown"), F.struct(first.alias("o"), "status"))
    return own.unionByName(told).groupBy("unit_key", "vocabulary_lc", "concept_id").agg(
        F.min(F.when(F.col("label").isNotNull(), F.struct(first.alias("o"), "label")))["label"].alias("label"),
        F.min(F.when(F.col("concept_class").isNotNull(), F.struct(first.alias("o"), "concept_class")))["concept_class"].alias("concept_class"),
        F.when(F.bool_or("direct"), F.max(F.when(F.col("direct"), F.col("status")))).otherwise(F.coalesce(F.min(known)["status"], F.lit("unknown"))).alias("status"),
        F.bool_or("direct").alias("direct"), F.sort_array(F.collect_set("source")).alias("sources"), F.sort_array(F.collect_set("predicate")).alias("predicates"),
    )


def unambiguous(evidence: DataFrame) -> DataFrame:
    """The evidence of ids that only one vocabulary has in a unit."""
    one = evidence.groupBy("unit_key", "concept_id").agg(F.count_distinct("vocabulary_lc").alias("n")).where("n = 1").select("unit_key", "concept_id")
    return evidence.join(one, ["unit_key", "concept_id"])


def policies(p: Profile) -> Column:
    """The project's coding policies that the profile's flags stand for."""
    told = [
        ("require_active_concept", p.require_active), ("preserve_combination_ingredients", p.preserve_combination_ingredients), ("prohibit_unretrieved_identifiers", p.prohibit_unretrieved),
        ("flag_salt_active_moiety_conflation", p.flag_salt_conflation), ("combination_products_require_review", p.combinations_require_review),
    ]
    return F.array(*[F.lit(name) for name, on in told if on]).cast("array<string>")


def packages(enriched: DataFrame, p: Profile) -> DataFrame:
    """unit_key, candidates (array in rank order), policies."""
    fields = ["rank", "candidate_id", "label", "concept_class", "status", "vocabulary", "synonyms", "channels", "best_score", "best_rank", "edges"]
    return enriched.groupBy("unit_key").agg(F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: a["rank"] - b["rank"]).alias("candidates")).withColumn("policies", policies(p))
