"""Batch alignment from units to decisions (D-11, D-12): what depends on the value alone runs once for each mapping key."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adjudicate, enrich, fuse, retrieve, route, validate
from ..profile import Profile
from ..sources.keyed import remove

VERSION = "0.1.0"
Store = Callable[[DataFrame, str], DataFrame]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only where it names none and runs on this machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def store(spark: SparkSession) -> Store:
    """Tables in the shared folder: lineage is cut and lost executors cost a re-read."""
    return _under(spark, shared_dir(spark))


def _under(spark: SparkSession, folder: str) -> Store:
    def put(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return put


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Store]:
    """As store, but its tables are removed at the end, when all that reads them must be written."""
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield _under(spark, folder)
    finally:
        remove(spark, folder)


def candidates(hits: DataFrame, t: retrieve.Terminology, p: Profile) -> DataFrame:
    """Ranked candidates with label, class, status, synonyms from hits (unit_key, channel, concept_id, score, hit_rank, name)."""
    about = t.concepts.select("concept_id", "vocabulary", F.col("preferred_label").alias("label"), "concept_class", "status", "synonyms")
    rows = hits.join(about, "concept_id").select("unit_key", "channel", F.col("concept_id").alias("candidate_id"), "score", "hit_rank", "status", F.col("vocabulary").alias("source_vocabulary"), (fuse.channel_priority(F.col("channel")) * 1000 + F.col("hit_rank")).alias("hit_order"))
    ranked = fuse.rank_candidates(fuse.fuse(rows), p.maximum_candidates)
    return ranked.join(about.drop("status"), ranked["candidate_id"] == about["concept_id"]).drop("concept_id")


def align_keys(keys: DataFrame, hits: DataFrame, t: retrieve.Terminology, p: Profile, put: Store) -> DataFrame:
    """unit_key, candidates, evidence (map), verified (map), similarity for each key (unit_key, raw_value)."""
    full = put(enrich.enrich(candidates(hits, t, p), t.edges, p), "candidates")
    packed = enrich.packages(full, p)
    index = put(enrich.evidence_index(full), "evidence")
    own = F.struct("label", "concept_class", "status", "direct", F.lit(p.target_terminology).alias("vocabulary"), "sources", "predicates")
    target = index.where(F.col("vocabulary_lc") == p.target_terminology.lower())
    evidence = target.groupBy("unit_key").agg(F.map_from_entries(F.collect_list(F.struct(F.col("concept_id").alias("key"), own.alias("value")))).alias("evidence"))
    # concepts whose status no evidence tells are looked up
    asked = target.where("status = 'unknown'").select("unit_key", "concept_id")
    answers = retrieve.validate_concepts(asked, t.concepts).join(t.concepts.select("concept_id", "remapped_to"), "concept_id", "left")
    verdict = F.struct("exists", "status", F.coalesce("remapped_to", F.array().cast("array<string>")).alias("remapped_to"))
    verified = asked.join(answers, "concept_id").groupBy("unit_key").agg(F.map_from_entries(F.collect_list(F.struct(F.col("concept_id").alias("key"), verdict.alias("value")))).alias("verified"))
    rows = keys.join(packed, "unit_key", "left").join(evidence, "unit_key", "left").join(verified, "unit_key", "left")
    rows = rows.withColumn("verified", F.coalesce("verified", F.create_map().cast("map<string,struct<exists:boolean,status:string,remapped_to:array<string>>>")))
    none = packed.schema["candidates"].dataType
    rows = rows.withColumn("candidates", F.coalesce("candidates", F.array().cast(none))).withColumn("evidence", F.coalesce("evidence", F.create_map().cast(validate.EVIDENCE)))
    return adjudicate.top_similarity(rows).drop("raw_value", "policies")


#: What a decision depends on besides its package.
_CASE = ("unit_key", "raw_value", "normalized", "route", "readiness", "has_attributes")


def with_cases(units: DataFrame) -> DataFrame:
    """units with route, unit_key, has_attributes and case_key, 128 bits that stand for _CASE. Rows without a decision have other keys, so that they don't gather in one task of a join."""
    kinds = units.schema["attributes"].dataType.fields
    some = F.coalesce(*[F.when(F.col("attributes")[f.name].isNotNull(), F.lit(True)) for f in kinds], F.lit(False))
    rows = units.withColumns({"unit_key": F.col("normalized"), "route": F.coalesce("envelope.route", "attributes.route"), "has_attributes": some})
    told = lambda c: F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-"))
    ready = [F.col("readiness.status"), *[F.array_join(f"readiness.{c}", "\n") for c in ("missing_context", "warnings")]]
    own = F.concat(told(F.col("raw_value")), told(F.col("normalized")), told(F.col("route")), *[told(c) for c in ready], F.col("has_attributes").cast("string"))
    digest, other = F.substring(F.unhex(F.sha2(own, 256)), 1, 16), F.unhex(F.hex(F.xxhash64("record_id", "source_row_number", "raw_value")))
    return rows.withColumn("case_key", F.when(F.col("status") == "success", digest).otherwise(other))


def _first_texts(rows: DataFrame, cases: DataFrame, put: Store) -> DataFrame:
    """unit_key and raw_value: the text of the key's first row. Only keys of several texts need another look at the rows."""
    texts = cases.select("unit_key", "raw_value").distinct()
    several = put(texts.groupBy("unit_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("unit_key"), "several")
    if several.isEmpty():
        return texts
    own = rows.where("status = 'success'").join(several, "unit_key", "left_semi").groupBy("case_key", "unit_key", "raw_value").agg(F.min("source_row_number").alias("row"), F.min("record_id").alias("record"))
    first = own.groupBy("unit_key").agg(F.min_by("raw_value", F.struct("row", "record", "raw_value")).alias("raw_value"))
    return texts.join(several, "unit_key", "left_anti").unionByName(first)


def decide_cases(cases: DataFrame, known: DataFrame, p: Profile) -> DataFrame:
    """Proposals, findings, verdict, route and canonical concepts of distinct cases (case_key and _CASE), with their packages."""
    # cases are few bytes, read by few tasks, but the rules on each are long
    tasks = int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cases.repartition(tasks, "case_key").join(known, "unit_key").withColumn("sau_id", F.col("case_key")).withColumn("package_sau_id", F.col("case_key"))
    out = adjudicate.adjudicate(rows, p)
    # attributes are kept whole or not at all, so whether a unit has any is all that the rules ask
    flag = F.when(F.col("has_attributes"), F.lit(True))
    out = out.withColumn("attributes", F.struct(flag.alias("any"))).withColumn("kept_attributes", F.struct(F.when(F.col("attributes_kept"), flag).alias("any")))
    out = out.withColumn("expected_losses", validate.expected_losses())
    decided = route.decide(route.route(route.routing_features(validate.validate(out, p)), p))
    return decided.drop("sau_id", "package_sau_id", "attributes", "attributes_kept", "kept_attributes", "expected_losses", "verified", *_CASE)


def build_packages(keys: DataFrame, t: retrieve.Terminology, p: Profile, put: Store, hits: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Packages of keys (unit_key, raw_value) from scratch."""
    asked = keys.select("unit_key", F.col("raw_value").alias("value"))
    found = put(hits(asked) if hits else retrieve.retrieve(asked, t, p, put), "hits")
    return align_keys(keys, found, t, p, put)


def decisions(rows: DataFrame, t: retrieve.Terminology, p: Profile, put: Store, hits: Callable[[DataFrame], DataFrame] | None = None, packages: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Decisions, by case_key, of the cases of rows (with_cases): adjudicated, validated and routed once, whatever the number of their rows. hits, packages: see align."""
    cases = put(rows.where("status = 'success'").select("case_key", *_CASE).distinct(), "cases")
    keys = put(_first_texts(rows, cases, put), "keys")
    known = put(packages(keys).drop("origin") if packages else build_packages(keys, t, p, put, hits), "packages")
    return decide_cases(cases, known, p)


def stamps(p: Profile, release: str | None = None, run_id: str | None = None) -> dict[str, Column]:
    stamp = lambda value: F.when(F.col("status") == "success", F.lit(value)).cast("string")
    return {"release": stamp(release), "profile_version": stamp(p.version), "package_version": stamp(VERSION), "run_id": stamp(run_id)}


def align(units: DataFrame, t: retrieve.Terminology, p: Profile, hits: Callable[[DataFrame], DataFrame] | None = None, release: str | None = None, run_id: str | None = None, put: Store | None = None, packages: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Decisions for units (operators.units.build_units): every unit stays; rows that aren't successes have no decision.

    Equal normal forms are retrieved once, whatever their mapping keys, with the first row's text. Rows of one form with the same text, route and readiness
    are one case: adjudicated, validated and routed once, and joined back to their rows. hits: another way to find candidates, from (unit_key, value); packages: another
    way to come by packages, from (unit_key, raw_value), such as reuse.reuse_packages; put: where intermediate tables go.

    Units aren't stored but read again, once for their cases and once for the result, each time with the columns that are asked for; so they must be the same each time.
    """
    put = put or store(units.sparkSession)
    rows = with_cases(units)
    # written once: what reads the decisions (crosswalk, audits, summaries) takes the columns that it needs
    decided = put(decisions(rows, t, p, put, hits, packages), "decisions")
    return rows.join(decided, "case_key", "left").drop("case_key", "unit_key", "has_attributes").withColumns(stamps(p, release, run_id))


def attach_crosswalk(source: DataFrame, crosswalk: DataFrame, key: str) -> DataFrame:
    """Source rows with their crosswalk's columns (prefixed), every row kept."""
    return source.join(crosswalk.select(F.col(key), *[F.col(c).alias(f"mapped_{c}") for c in crosswalk.columns if c != key]), key, "left")
