"""Alignment of an unbounded input (M-1 to M-4)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..jobs.align import Store, decisions, scratch, stamps, with_cases
from ..operators.retrieve import Terminology, retrieve
from ..operators.units import build_units
from ..profile import Profile
from ..sources.keyed import KeyedTable


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None  # nothing has been written there yet


def guard_profile(spark: SparkSession, checkpoint: str, p: Profile) -> None:
    """Refuse to resume under another profile than the one that the checkpoint was begun with."""
    path = f"{checkpoint.rstrip('/')}/profile"
    if (known := _read(spark, path)) is None:
        spark.createDataFrame([(p.digest(),)], "digest string").coalesce(1).write.parquet(path)
    elif known.head()["digest"] != p.digest():
        raise ValueError("the checkpoint belongs to another profile")


def known_hits(spark: SparkSession, path: str, t: Terminology) -> KeyedTable:
    """The hits of all keys that a stream has looked up, and the batch that did; a key without hits has one row without a concept."""
    kinds = [("unit_key", "string"), ("channel", "string"), ("query", "string"), ("concept_id", t.names.schema["concept_id"].dataType.simpleString()), ("name", "string"), ("score", "double"), ("hit_rank", "int"), ("batch", "bigint")]
    return KeyedTable(spark, path, "unit_key", spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in kinds)).schema)


def reuse_hits(asked: DataFrame, known: KeyedTable, number: int, hits: Callable[[DataFrame], DataFrame], put: Store) -> DataFrame:
    """Hits of asked keys (unit_key, value): those that earlier batches looked up are read, the others found by `hits` and kept under the batch's number."""
    asked = put(asked, "asked")
    earlier = put(known.look_up(asked, number), "earlier")
    new = put(asked.join(earlier.select("unit_key").distinct(), "unit_key", "left_anti"), "new")
    marked = new.select("unit_key").join(hits(new), "unit_key", "left").withColumn("batch", F.lit(number).cast("long"))
    fresh = known.write(marked, number, new.count())
    return earlier.unionByName(fresh).where("concept_id is not null").drop("batch")


#: What each row says of its case's decision; the rest is kept once for each case.
TOLD = ["decision", "relationship", "verdict", "routing_status"]


def align_stream(stream: DataFrame, t: Terminology, p: Profile, sink: str, checkpoint: str, value: str, ids: Sequence[str], context: Sequence[str], hits: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Units with their decisions to sink/decisions, candidates, evidence, findings and all else that rows of one case share to sink/cases (by batch and case_key;
    stream_decisions joins them), hits by mapping key to sink/known. A batch writes under its own number and overwrites what an earlier
    try of it wrote, so a restart repeats nothing; keys that earlier batches looked up aren't looked up again, and only their buckets are read.
    Intermediate tables go when their batch is done.

    A batch's rows are read twice, for their cases and for the result, and dealt out once, as they came: units are made of them after."""
    guard_profile(stream.sparkSession, checkpoint, p)

    def units(rows: DataFrame, *carried: str) -> DataFrame:
        return build_units(rows, value, ids, context, p, carried=carried, deal=False)

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = known_hits(spark, f"{sink}/known", t)
        with scratch(spark) as put:
            find = hits or (lambda new: retrieve(new, t, p, put))
            decided = decisions(with_cases(units(batch)), t, p, put, lambda asked: reuse_hits(asked, known, number, find, put))
            place = f"{sink}/cases/batch={number}"
            decided.write.mode("overwrite").option("compression", "zstd").parquet(place)
            told = spark.read.schema(decided.schema).parquet(place).select(F.col("case_key").alias("_case"), F.struct(*TOLD).alias("_told"))
            rows = with_cases(units(batch.withColumn("_row", F.struct(*[f"`{c}`" for c in batch.columns])), "_row")).select(F.col("case_key").alias("_case"), "_row")
            # merged whatever its size, so that rows are dealt out and the work on them is too
            out = units(rows.join(told.hint("merge"), "_case", "left").select("_row.*", "_case", "_told"), "_case", "_told")
            out = out.withColumns({"route": F.coalesce("envelope.route", "attributes.route"), "case_key": F.when(F.col("status") == "success", F.col("_case"))})
            out.select("*", "_told.*").drop("_case", "_told").withColumns(stamps(p)).write.mode("overwrite").option("compression", "zstd").parquet(f"{sink}/decisions/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint.rstrip('/')}/query").trigger(availableNow=True).start()


def stream_decisions(spark: SparkSession, sink: str) -> DataFrame:
    """What align_stream has written of all batches, with the columns that jobs.align.align gives, and batch."""
    rows, cases = spark.read.parquet(f"{sink}/decisions"), spark.read.parquet(f"{sink}/cases").drop(*TOLD)
    return rows.join(cases, ["batch", "case_key"], "left").drop("case_key")


def stream_summary(stream: DataFrame, by: Sequence[str]) -> DataFrame:
    """Running counts; write with output mode complete."""
    return stream.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
