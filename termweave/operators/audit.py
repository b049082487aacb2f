"""Summaries and consistency of stored results (E-10 to E-15, F-8, K-7 to K-9)."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..profile import Profile
from . import route, units


def spread(df: DataFrame, array: Column | str, name: str, *kept: str) -> DataFrame:
    """The columns kept, with each element that isn't null of the array as `name`.

    Below a plain explode Spark tests whether the array has elements, and moves that test below everything that makes the array: it is made twice, and in
    the test its parts are written out at each use. The outer one has no such test."""
    return df.select(*kept, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def batch_summary(df: DataFrame) -> DataFrame:
    """status, routing_status, n."""
    return df.groupBy("status", "routing_status").agg(F.count(F.lit(1)).alias("n"))


def loss_profile(df: DataFrame) -> DataFrame:
    """kind, n over all reported losses."""
    return spread(df, "losses", "x").groupBy(F.col("x.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def finding_profile(df: DataFrame) -> DataFrame:
    """code, severity, n."""
    return spread(df, "findings", "x").groupBy(F.col("x.code").alias("code"), F.col("x.severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def merge_usage(usage: DataFrame, identity: list[str]) -> DataFrame:
    """resource_name, cache_hits, network_calls (summed), accessed_at (latest), conflicts (identity columns with more than one value)."""
    many = [F.when(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))) > 1, F.lit(c)) for c in identity]
    return usage.groupBy("resource_name").agg(F.sum("cache_hits").alias("cache_hits"), F.sum("network_calls").alias("network_calls"), F.max("accessed_at").alias("accessed_at"), F.array_compact(F.array(*many)).alias("conflicts"))


def usage_summary(log: DataFrame) -> DataFrame:
    """provider, operation, n, releases (sorted, those given)."""
    return log.groupBy("provider", "operation").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("terminology_release")).alias("releases"))


#: Rows of a run log that are audited in one task, or so.
RANGE_ROWS = 100_000
#: What must stay as it is within a resource, and the code if it doesn't.
IDENTITY = {"provider_version": "PROVIDER_VERSION_CHANGED", "terminology_release": "RELEASE_CHANGED", "api_version": "API_CHANGED", "mode": "MODE_CHANGED"}


def audit_sequence(log: DataFrame, put: Callable[[DataFrame, str], DataFrame], then: Sequence[str] = ()) -> DataFrame:
    """Rows of a run log (run_id, row_number, resource_name, cache_hits, network_calls and what there is of provider_name and IDENTITY) with codes: numbers
    that aren't contiguous from 1 in their run; counters of a resource (of a provider) that fall, identities that change. then: columns that order rows of one number.

    A segmented scan: ranges of (run_id, row_number) are audited by themselves, each with its predecessors' last states, which are merged in order of
    ranges. So the rows of one run are spread over tasks. put: writes a table, as ranges must be cut once.
    """
    about = [c for c in ("cache_hits", "network_calls", *IDENTITY) if c in log.columns]
    owner = [c for c in ("resource_name", "provider_name") if c in log.columns]
    keys = [F.lower(F.trim(F.col(c))) for c in owner]
    rows = log.withColumns({"_number": F.col("row_number").cast("long"), "_owner": F.to_json(F.array(*keys)), "_now": F.struct(*about), "_then": F.struct("row_number", *then)})
    ranges = max(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    rows = put(rows.repartitionByRange(ranges, "run_id", "_then").withColumn("_range", F.spark_partition_id()), "sequence")
    order = lambda *by: Window.partitionBy(*by).orderBy("_then")

    def carried(by: list[str], value: str, name: str) -> DataFrame:
        """What the last of the ranges before ended with, for each range and key."""
        last = rows.groupBy(*by, "_range").agg(F.max_by(F.struct(value), "_then").alias("_last"))
        return last.withColumn(name, F.lag("_last").over(Window.partitionBy(*by).orderBy("_range"))).drop("_last")

    numbers, states = carried(["run_id"], "_number", "_number_before"), carried(["run_id", "_owner"], "_now", "_state_before")
    rows = rows.withColumn("_n", F.lag(F.struct("_number")).over(order("run_id", "_range"))).withColumn("_s", F.lag(F.struct("_now")).over(order("run_id", "_range", "_owner")))
    same = lambda other, *by: [F.col(f"rows.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in by]
    joined = rows.alias("rows").join(numbers.alias("numbers"), functools.reduce(Column.__and__, same("numbers", "run_id", "_range")), "left")
    joined = joined.join(states.alias("states"), functools.reduce(Column.__and__, same("states", "run_id", "_range", "_owner")), "left")
    before, state = F.coalesce("_n", "_number_before")["_number"], F.coalesce("_s", "_state_before")["_now"]
    changed = [F.when(F.coalesce("_s", "_state_before").isNotNull() & ~state[c].eqNullSafe(F.col("_now")[c]), F.lit(code)) for c, code in IDENTITY.items() if c in about]
    fell = [F.when(F.col("_now")[c] < state[c], F.lit(f"{c.upper()}_FELL")) for c in ("cache_hits", "network_calls")]
    gap = F.when(F.col("_number") != F.coalesce(before, F.lit(0)) + 1, F.lit("ROW_NUMBER_GAP"))
    codes = F.array_compact(F.array(gap, *fell, *changed))
    return joined.select(*[F.col(f"rows.{c}") for c in log.columns], codes.alias("codes")).where(F.size("codes") > 0)


def audit_artifacts(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """sau_id, codes (and columns to keep) of stored decisions that contradict themselves. df: the alignment's columns."""
    test = lambda t, code: F.when(F.coalesce(t, F.lit(False)), F.lit(code))
    ids = F.transform("selected", lambda c: c["concept_id"])
    severe = lambda s: F.exists("findings", lambda f: f["severity"] == s)
    rejected, empty = F.col("verdict") == "REJECTED", F.col("decision").isin("NO_VALID_MAPPING", "INSUFFICIENT_CONTEXT", "ABSTAINED")
    known = F.map_keys("evidence")
    accept = F.col("routing_status") == "AUTO_ACCEPT"
    codes = F.array_compact(F.array(
        test(~F.col("sau_id").rlike("^SAU-[0-9A-F]{32}$"), "BAD_SAU_ID"), test(~F.col("mapping_key").rlike("^MAP-[0-9A-F]{32}$"), "BAD_MAPPING_KEY"),
        test(rejected & ~severe("error"), "REJECTED_WITHOUT_ERROR"), test(~rejected & severe("error"), "ERROR_NOT_REJECTED"),
        test(rejected & (F.size("selected") > 0), "REJECTED_WITH_CONCEPTS"), test(rejected & (F.col("decision") != "ABSTAINED"), "REJECTED_NOT_ABSTAINED"), test(rejected & (F.col("routing_status") != "HUMAN_REVIEW"), "REJECTED_NOT_REVIEWED"),
        test(rejected & (F.size("losses") > 0), "REJECTED_WITH_LOSSES"), test(empty & (F.size("selected") > 0), "EMPTY_WITH_CONCEPTS"), test(empty & (F.col("source_level").isNotNull() | F.col("analysis_level").isNotNull()), "EMPTY_WITH_LEVELS"),
        test(F.size(F.array_except(ids, known)) > 0, "CONCEPT_WITHOUT_EVIDENCE"), test(F.size(F.array_distinct(ids)) < F.size(ids), "DUPLICATE_CONCEPT"),
        test((F.col("decision") == "MAPPED") & (F.size(ids) != 1), "MAPPED_CARDINALITY"), test((F.col("decision") == "MULTI_CONCEPT_MAPPED") & (F.size(ids) < 2), "MULTI_CARDINALITY"),
        test(F.col("analysis_level").isNotNull() & ~F.array_contains(ids, F.col("analysis_level.concept_id")), "ANALYSIS_NOT_SELECTED"),
        test(F.size("reasons") == 0, "NO_REASON"), test(accept & (severe("warning") | severe("error")), "ACCEPTED_WITH_FINDINGS"), test(accept & F.col("requested_review"), "ACCEPTED_AGAINST_REVIEW"), test(accept & empty, "ACCEPTED_EMPTY"),
        test((F.col("verdict") == "HUMAN_REVIEW_REQUIRED") & (F.col("routing_status") == "ABSTAIN"), "REVIEW_ROUTED_TO_ABSTAIN"), test((F.col("verdict") == "HUMAN_REVIEW_REQUIRED") & ~F.col("requested_review"), "REVIEW_NOT_REQUESTED"),
        test((F.col("verdict") == "VALID_WITH_SEMANTIC_LOSS") & (F.size("losses") == 0), "LOSS_VERDICT_WITHOUT_LOSS"),
        test(F.col("features.validator_error_count") != F.size(F.filter("findings", lambda f: f["severity"] == "error")), "FEATURE_ERRORS"), test(F.col("features.validator_warning_count") != F.size(F.filter("findings", lambda f: f["severity"] == "warning")), "FEATURE_WARNINGS"),
        test(F.exists("selected", lambda c: ~c["label"].eqNullSafe(F.coalesce(F.col("evidence")[c["concept_id"]]["label"], c["label"]))), "LABEL_NOT_CANONICAL"),
    ))
    return df.withColumn("codes", codes).where(F.size("codes") > 0).select("sau_id", "codes", *keep)


def content_digest(*columns: str) -> Column:
    """SHA-256 of the canonical text of nested columns: fields in order of the columns, nulls kept, maps by key."""
    kept = lambda c: F.to_json(F.struct(F.col(c)), {"ignoreNullFields": "false"})
    return F.sha2(F.concat_ws("\n", *[kept(c) for c in columns]), 256)


def rederived(df: DataFrame, p: Profile, content: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """sau_id, codes (and columns to keep) of stored units whose ids or digest aren't what their contents give, however right they look.

    df: the columns of units.build_units; content: columns whose digest was stored as content_sha256. Normal form, mapping key and unit id are derived anew, each
    from what was derived anew before it, so a changed cell is found in all that depends on it, and a changed id in itself alone."""
    def codes(normal: Column, key: Column) -> Column:
        tests = [(~normal.eqNullSafe(F.col("normalized")), "NORMAL_FORM_CHANGED"), (~key.eqNullSafe(F.col("mapping_key")), "MAPPING_KEY_MISMATCH"), (~units.sau_id(key).eqNullSafe(F.col("sau_id")), "SAU_ID_MISMATCH")]
        if content:
            tests.append((~content_digest(*content).eqNullSafe(F.col("content_sha256")), "CONTENT_CHANGED"))
        return _codes(*tests)

    # the filter is pushed below the columns that it tests, so what builds on another value binds it; written out, each id would derive its parts several times over
    key = lambda normal: units.mapping_key(normal, F.col("envelope"), F.col("attributes"), p)
    own = _once(text.normalize_text(F.col("raw_value")), lambda normal: _once(key(normal), lambda k: codes(normal, k)))
    return df.withColumn("codes", own).where(F.size("codes") > 0).select("sau_id", "codes", *keep)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of the value, which is evaluated once wherever the expression ends up."""
    return F.transform(F.array(value), use)[0]


def _codes(*tests: tuple[Column, str]) -> Column:
    """The codes of the tests that hold; a test that is null doesn't."""
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(code)) for t, code in tests]))


def audit_records(df: DataFrame) -> DataFrame:
    """df with `codes`, where a batch record contradicts itself or its unit.

    df: status, error_code, error_message, decision (null: none), raw_value, record_id, row_number, those of the unit (unit_value, unit_record_id, unit_row_number), and
    usage, unit_usage (arrays of resource_name, provider_name, terminology_release, provider_version, mode, cache_hits, network_calls): the run's and the
    decision's. A run's counters may not be less than those of a decision made in it; a run without usage takes the decision's.
    """
    good, has = F.col("status") == "success", F.col("decision").isNotNull()
    same = lambda a, b: (a["resource_name"] == b["resource_name"]) & a["provider_name"].eqNullSafe(b["provider_name"])
    agree = lambda a, b: a["terminology_release"].eqNullSafe(b["terminology_release"]) & a["provider_version"].eqNullSafe(b["provider_version"]) & a["mode"].eqNullSafe(b["mode"]) & (a["cache_hits"] >= b["cache_hits"]) & (a["network_calls"] >= b["network_calls"])
    names = F.transform("usage", lambda u: u["resource_name"])
    told = has & (F.size("usage") > 0)
    codes = _codes(
        (good & ~has, "SUCCESS_WITHOUT_DECISION"), (good & (F.col("error_code").isNotNull() | F.col("error_message").isNotNull()), "SUCCESS_WITH_ERROR"), (~good & has, "FAILURE_WITH_DECISION"),
        (F.col("status").isin("error", "skipped") & (F.coalesce("error_code", F.lit("")) == ""), "FAILURE_WITHOUT_CODE"), (F.size(F.array_distinct(names)) < F.size(names), "RESOURCE_TWICE"),
        (has & ~F.col("raw_value").eqNullSafe(F.col("unit_value")), "VALUE_DIFFERS"), (has & ~F.col("record_id").eqNullSafe(F.col("unit_record_id")), "RECORD_ID_DIFFERS"),
        (has & F.col("unit_row_number").isNull(), "UNIT_WITHOUT_ROW_NUMBER"), (has & (F.col("unit_row_number") != F.col("row_number")), "ROW_NUMBER_DIFFERS"),
        (told & F.exists("unit_usage", lambda b: ~F.exists("usage", lambda a: same(a, b))), "USAGE_OMITTED"),
        (told & F.exists("unit_usage", lambda b: F.exists("usage", lambda a: same(a, b) & ~agree(a, b))), "USAGE_CONTRADICTED"),
    )
    return df.withColumn("codes", codes).where(F.size("codes") > 0)


def audit_reviews(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """sau_id and codes of review items (route.review_queue) that differ from what their decision gives: its value, decision, candidates, messages, reasons, priority."""
    fields = {"raw_value": F.col("raw_value"), "decision": F.col("decision"), "relationship": F.col("relationship"), "considered": route.considered(), "messages": route.messages(), "reasons": F.col("reasons"), "priority": route.priority(), "routed": F.col("routing_status")}
    own = decisions.select("sau_id", F.struct(*[c.alias(name) for name, c in fields.items()]).alias("own"))
    differs = lambda *names: ~functools.reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"own.{n}")) for n in names])
    there = F.col("own").isNotNull()
    codes = _codes(
        (~there, "NO_DECISION"), (there & (F.col("own.routed") != "HUMAN_REVIEW"), "NOT_ROUTED_TO_REVIEW"), (there & differs("raw_value"), "VALUE_DIFFERS"), (there & differs("decision", "relationship"), "DECISION_DIFFERS"),
        (there & differs("considered"), "CANDIDATES_DIFFER"), (there & differs("messages"), "MESSAGES_DIFFER"), (there & differs("reasons"), "REASONS_DIFFER"), (there & differs("priority"), "PRIORITY_DIFFERS"),
    )
    return reviews.join(own, "sau_id", "left").withColumn("codes", codes).where(F.size("codes") > 0).select("sau_id", "codes")
