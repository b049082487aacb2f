"""Queries on scalars, identifiers, rows and units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import units
from ..profile import Profile
from ..sources import batch
from .fixtures import sql, view

P = Profile()
KEY = b"a key of the tests"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


NORMAL = "trim(regexp_replace(lower(reported), '[ \\t\\n\\r]+', ' ', 'g'))"


@query(sql(f"SELECT DISTINCT reported, {NORMAL} AS normalized FROM v_mentions", "v_mentions"))
def normalize_values(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_mentions").select("reported", text.normalize_text(F.col("reported")).alias("normalized")).distinct()


@query(sql("""
WITH t AS (SELECT DISTINCT reported, preferred_label FROM v_mentions JOIN v_concepts ON concept_id = concat('P', CAST(l_partkey AS VARCHAR))),
k AS (SELECT reported, preferred_label, list_distinct(list_filter(regexp_extract_all(lower(reported), '[a-z0-9]+'), lambda x: length(x) >= 2)) AS a,
  list_distinct(list_filter(regexp_extract_all(lower(preferred_label), '[a-z0-9]+'), lambda x: length(x) >= 2)) AS b FROM t)
SELECT reported, preferred_label, CASE WHEN len(a) > 0 THEN round(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(a), 6) ELSE 0.0 END AS overlap FROM k
""", "v_mentions", "v_concepts"))  # fmt: skip
def token_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    m, c = view(spark, d, "v_mentions"), view(spark, d, "v_concepts")
    pairs = m.select("reported", F.concat(F.lit("P"), F.col("l_partkey")).alias("concept_id")).join(c, "concept_id").select("reported", "preferred_label").distinct()
    return pairs.withColumn("overlap", F.round(text.token_overlap(F.col("reported"), F.col("preferred_label")), 6))


@query()
def lexical_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    m, c = view(spark, d, "v_mentions"), view(spark, d, "v_concepts")
    pairs = m.select("reported", F.concat(F.lit("P"), F.col("l_partkey")).alias("concept_id")).join(c, "concept_id").select("reported", "preferred_label").distinct()
    return pairs.withColumn("similarity", F.round(text.lexical_similarity(F.col("reported"), F.col("preferred_label")), 6))


@query(sql("SELECT DISTINCT reported, nullif(trim(regexp_extract(reported, '(?i)\\b[0-9]+(\\.[0-9]+)?\\s*(mg|mcg|ug|g|ml|l|unit|units|iu|%)\\b')), '') AS strength FROM v_mentions", "v_mentions"))
def strength_extract(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_mentions").select("reported", text.extract_strength(F.col("reported")).alias("strength")).distinct()


@query("SELECT p_partkey, replace(replace(p_name, '\\', '\\\\'), '|', '\\|') || '|' || replace(replace(p_brand || '|x\\', '\\', '\\\\'), '|', '\\|') AS record_id FROM part")
def record_ids(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", ids.record_id(F.col("p_name"), F.concat("p_brand", F.lit("|x\\"))).alias("record_id"))


@query(sql(f"""
SELECT DISTINCT reported, route, dose_amt, 'MAP-' || upper(substr(sha256('{{"context.dose":' || '"' || dose_amt || '"' || ',"context.formulation":null,"context.route":' || coalesce('"' || route || '"', 'null')
  || ',"context.unit":null,"profile":"drug_normalization@0.1.0","task":"drug_normalization","value":"' || replace(replace({NORMAL}, '\\', '\\\\'), '"', '\\"') || '"}}'), 1, 32)) AS mapping_key FROM v_mentions
""", "v_mentions"))  # fmt: skip
def mapping_keys(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "v_mentions").select("reported", "route", "dose_amt").distinct()
    cells = ["route", "dose_amt"]
    return m.select("reported", "route", "dose_amt", units.mapping_key(text.normalize_text(F.col("reported")), units.build_envelope(cells), units.build_attributes(cells), P).alias("mapping_key"))


_PAD = KEY.ljust(64, b"\0")
_INNER, _OUTER = (bytes(x ^ y for x in _PAD).hex() for y in (0x36, 0x5C))


@query(f"""SELECT c_custkey, 'KEY-' || upper(substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode('{{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}}')))), 1, 16)) AS keyed_id FROM customer""")
def hmac_ids(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", ids.stable_id("KEY", {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}, 16, KEY).alias("keyed_id"))


@query("SELECT event_id, CASE WHEN regexp_matches(cell, '^\\s*[=+@-]') THEN '''' || cell ELSE cell END AS cell FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '=' || event_type WHEN 1 THEN ' +' || event_type WHEN 2 THEN '-1' WHEN 3 THEN event_type || '=' ELSE '@x' END AS cell FROM events)")
def csv_safe(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    cell = F.when(k == 0, F.concat(F.lit("="), "event_type")).when(k == 1, F.concat(F.lit(" +"), "event_type")).when(k == 2, F.lit("-1")).when(k == 3, F.concat("event_type", F.lit("="))).otherwise(F.lit("@x"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", text.csv_safe(cell).alias("cell"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 10 END AS authority, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 97 AS DOUBLE) END AS number FROM events")
def coerced_values(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    name = F.when(F.col("event_type") == "click", F.lit("target_terminology")).when(F.col("event_type") == "view", F.lit("llm_internal_knowledge"))
    value = F.when(F.col("event_id") % 3 == 0, F.lit("n/a")).otherwise((F.col("event_id") % 97).cast("string"))
    return e.select("event_id", text.authority_rank(name).alias("authority"), text.to_number(value).alias("number"))


@query(sql("""
SELECT line_no, CASE WHEN NOT json_valid(line) THEN 'error' WHEN json_type(line) <> 'OBJECT' THEN 'error' ELSE 'success' END AS status,
  CASE WHEN NOT json_valid(line) THEN 'JSONDecodeError' WHEN json_type(line) <> 'OBJECT' THEN 'UnsupportedInput' END AS error_code
FROM v_batch_lines WHERE trim(line) <> ''
""", "v_batch_lines"))  # fmt: skip
def row_outcomes(spark: SparkSession, d: str) -> DataFrame:
    lines = view(spark, d, "v_batch_lines").withColumn("value", F.lit("x"))
    rows = batch.parse_lines(lines, "line", [])
    return units.classify_rows(rows, "value", ["line_no"]).select("line_no", "status", "error_code")


@query(sql("""
SELECT count(*) AS n, status, error_code FROM (SELECT CASE WHEN trim(reported) = '' THEN 'skipped' ELSE 'success' END AS status, CASE WHEN trim(reported) = '' THEN 'BLANK_VALUE' END AS error_code FROM v_mentions) GROUP BY status, error_code
""", "v_mentions"))  # fmt: skip
def mention_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return units.classify_rows(view(spark, d, "v_mentions"), "reported", ["l_orderkey", "l_linenumber"], ["route"]).groupBy("status", "error_code").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT l_orderkey, l_linenumber, l_suppkey, reported, route, role_cod AS drug_role, dose_amt AS dose, CASE WHEN route IS NOT NULL THEN l_suppkey END AS second_route FROM v_mentions", "v_mentions"))
def envelope(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "v_mentions").withColumn("route_cod", F.col("l_suppkey"))
    rows = m.withColumn("e", units.build_envelope(["route", "role_cod", "dose_amt", "route_cod"]))
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "reported", F.when(F.col("route").isNotNull(), F.col("e.route")).alias("route"), "e.drug_role", "e.dose", F.col("e.neighboring_fields")["route_cod"].cast("long").alias("second_route"))


@query(sql("SELECT l_orderkey, l_linenumber, l_suppkey, reported, route, dose_amt AS dose, role_cod = 'F' AS negation FROM v_mentions", "v_mentions"))
def attributes(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "v_mentions").withColumn("negation", (F.col("role_cod") == "F").cast("string"))
    return m.withColumn("a", units.build_attributes(["route", "dose_amt", "negation"])).select("l_orderkey", "l_linenumber", "l_suppkey", "reported", "a.route", "a.dose", "a.negation")


@query(sql("""
SELECT l_orderkey, l_linenumber, l_suppkey, reported, CASE WHEN trim(reported) = '' THEN 'UNSUPPORTED_INPUT' WHEN route IS NULL THEN 'INSUFFICIENT_CONTEXT' ELSE 'READY_WITH_LIMITED_CONTEXT' END AS status,
  CASE WHEN trim(reported) <> '' AND route IS NULL THEN 'route' ELSE '' END AS missing FROM v_mentions
""", "v_mentions"))  # fmt: skip
def readiness(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "v_mentions")
    cells = ["route", "role_cod", "dose_amt"]
    r = units.assess_readiness(F.col("reported"), units.build_envelope(cells), units.build_attributes(cells), Profile(required_context=("route",)))
    return m.withColumn("r", r).select("l_orderkey", "l_linenumber", "l_suppkey", "reported", "r.status", F.array_join("r.missing_context", "|").alias("missing"))


@query(sql("""
SELECT request_id, concat_ws('|', CASE WHEN mention_mode <> 'user_specified' THEN 'mention_mode' END, CASE WHEN mapping_intent <> 'ingredient_level_analysis' THEN 'mapping_intent' END,
  CASE WHEN lower(target_terminology) <> 'rxnorm' THEN 'target_terminology' END, CASE WHEN desired_granularity IS DISTINCT FROM 'ingredient' THEN 'desired_granularity' END) AS mismatched FROM v_requests
""", "v_requests"))  # fmt: skip
def request_mismatches(spark: SparkSession, d: str) -> DataFrame:
    return units.check_requests(view(spark, d, "v_requests"), P).select("request_id", F.array_join("mismatched", "|").alias("mismatched"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_number FROM orders")
def numbered_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    return units.number_rows(rows, ["o_orderkey"]).select("o_orderkey", F.col("row_number").cast("long").alias("row_number"))


@query("""
SELECT o_custkey, o_orderkey, batch_index, CAST(kind AS VARCHAR) AS raw_value FROM (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS batch_index, o_orderstatus AS kind FROM orders)
""")
def expanded_batches(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    row = F.create_map(F.lit("kind"), F.col("o_orderstatus"), F.lit("order"), F.col("o_orderkey").cast("string"))
    batches = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row"))), lambda a, b: F.signum(a["o_orderkey"] - b["o_orderkey"]).cast("int")), lambda x: x["row"]).alias("rows"))
    return units.expand_requests(batches, "kind", "rows").select("o_custkey", F.col("row")["order"].cast("long").alias("o_orderkey"), F.col("batch_index").cast("long").alias("batch_index"), "raw_value")
