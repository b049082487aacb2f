"""Packages kept across runs and releases (D-11): a key is built anew only where something that its package rests on has changed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich, retrieve
from ..operators.retrieve import Terminology
from ..profile import Profile
from .align import VERSION, Store, build_packages

Hits = Callable[[DataFrame, Terminology], DataFrame]
_KEY = ["unit_key", "raw_value"]


@dataclass(frozen=True)
class PackageStore:
    """Packages by release, profile and version of this library; a run adds a part of its own and replaces it if it is tried again."""

    root: str

    def release(self, p: Profile, release: str) -> str:
        return f"{self.root.rstrip('/')}/profile={p.digest()[:32]}-{VERSION}/release={release}"

    def read(self, spark: SparkSession, p: Profile, release: str, without: str | None = None) -> DataFrame | None:
        """Each key's package, from all runs but `without`; None if there are none."""
        try:
            rows = spark.read.parquet(self.release(p, release))
        except AnalysisException:
            return None
        return rows.where(~F.col("part").eqNullSafe(F.lit(without))).drop("part").dropDuplicates(_KEY)


def changed_concepts(old: Terminology, new: Terminology) -> DataFrame:
    """concept_id, what (concept, name or edge): the concepts of which a row, or a name's or forward edge's row, is in one release only."""

    def rows(t: Terminology, side: int) -> DataFrame:
        told = [(t.concepts, "concept_id", "concept"), (t.names, "concept_id", "name"), (t.edges, "subject_id", "edge")]
        parts = []
        for df, key, what in told:
            own = sorted(c for c in df.columns if c not in (key, "release"))
            parts.append(df.select(F.col(key).alias("concept_id"), F.lit(what).alias("what"), F.sha2(F.to_json(F.struct(*own)), 256).alias("body"), F.lit(side).alias("side")))
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    both = rows(old, 0).unionByName(rows(new, 1)).groupBy("concept_id", "what", "body").agg(F.min("side").alias("least"), F.max("side").alias("most"))
    return both.where("least = most").select("concept_id", "what").distinct()


def reaching(changed: DataFrame, edges: DataFrame, p: Profile, hops: int = 1) -> DataFrame:
    """concept_id: the changed concepts and those from which one of them is reached over at most so many permitted edges, walked backwards."""
    steps = enrich.permit_edges(edges, p).select("subject_id", F.col("object_id").alias("concept_id")).distinct()
    found = front = changed.select("concept_id").distinct()
    for _ in range(hops):
        front = front.join(steps, "concept_id").select(F.col("subject_id").alias("concept_id")).distinct()
        found = found.unionByName(front).distinct()
    return found


def touched_keys(packages: DataFrame, old: Terminology, new: Terminology, p: Profile, put: Store, hits: Hits | None = None) -> DataFrame:
    """unit_key of the packages (unit_key, raw_value, candidates) of the old release that may differ in the new one.

    A hit rests on one name at a time (equal, alike, or a near spelling). So a key whose hits can have changed has some hit when its channels are asked about nothing
    but the names, old and new, of concepts whose row or names have changed; a status that lifts a concept above others is found so too. Keys that an
    unchanged concept answers in an early channel never come to later ones. What packages say of their candidates comes from these and one edge further.
    """
    changed = put(changed_concepts(old, new), "changed")
    columns = new.names.columns
    other = put(changed.where("what <> 'edge'").select("concept_id").distinct(), "changed-names")
    names = put(old.names.select(*columns).unionByName(new.names.select(*columns)).join(other, "concept_id", "left_semi").select(*columns).distinct(), "changed-names")
    asked = packages.select("unit_key", F.col("raw_value").alias("value"))
    some = Terminology(new.concepts, names, new.edges)
    if hits:
        met = hits(asked, some).select("unit_key")
    else:
        own = packages.select("unit_key", F.explode("candidates").alias("c")).select("unit_key", F.col("c.candidate_id").alias("concept_id"), "c.channels", "c.best_score")
        own = put(own.join(other, "concept_id", "left_anti"), "unchanged")
        exact = F.array_contains("channels", "normalized_lookup")
        # a point above the bound, as the score was taken of normal forms
        like = F.array_contains("channels", "terminology_approximate_current") & ~F.array_contains("channels", "spelling_suggestion") & (F.col("best_score") >= 100 * retrieve.CORROBORATION + 1)
        met = retrieve.exact_hits(asked, names.where("is_current")).select("unit_key")
        unsure = put(asked.join(own.where(exact).select("unit_key"), "unit_key", "left_anti"), "unsure")
        if p.approximate_match:
            met = met.unionByName(retrieve.approx_hits(unsure, names, p, put=put).select("unit_key"))
        met = met.unionByName(retrieve.retrieve(unsure.join(own.where(like).select("unit_key"), "unit_key", "left_anti"), some, p, put).select("unit_key"))
    reach = put(reaching(changed, new.edges, p), "reaching")
    told = packages.select("unit_key", F.explode("candidates.candidate_id").alias("concept_id")).join(reach, "concept_id", "left_semi")
    return met.unionByName(told.select("unit_key")).distinct()


def reuse_packages(kept: PackageStore, release: str, run_id: str, t: Terminology, p: Profile, put: Store, previous: tuple[str, Terminology] | None = None, hits: Hits | None = None) -> Callable[[DataFrame], DataFrame]:
    """For align(packages=...): packages of keys (unit_key, raw_value) that the store has for the release, those of the previous release (its name and tables) that
    no change touches, and the rest built; both are added to the store. `release` must name t's content for good. Adds column `origin`: stored, carried or built.
    """

    def packages(keys: DataFrame) -> DataFrame:
        spark = keys.sparkSession
        keys = put(keys.select(*_KEY), "keys")
        own = kept.read(spark, p, release, without=run_id)
        stored = put(keys.join(own.drop("origin"), _KEY).withColumn("origin", F.lit("stored")), "stored") if own is not None else None
        rest = put(keys.join(stored, _KEY, "left_anti"), "rest") if stored is not None else keys
        earlier = kept.read(spark, p, previous[0]) if previous else None
        carried = None
        if earlier is not None:
            near = put(rest.join(earlier.drop("origin"), _KEY), "near")
            carried = put(near.join(touched_keys(near, previous[1], t, p, put, hits), "unit_key", "left_anti").withColumn("origin", F.lit("carried")), "carried")
            rest = put(rest.join(carried, _KEY, "left_anti"), "rest")
        built = build_packages(rest, t, p, put, (lambda asked: hits(asked, t)) if hits else None).join(rest, "unit_key").withColumn("origin", F.lit("built"))
        added = carried.unionByName(built) if carried is not None else built
        place = f"{kept.release(p, release)}/part={run_id}"
        added.write.mode("overwrite").parquet(place)
        out = spark.read.schema(added.schema).parquet(place)
        return (stored.unionByName(out) if stored is not None else out).drop("raw_value")

    return packages
