"""Queries on retrieval, fusion, relationships, evidence, adjudication and the whole alignment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import adjudicate, audit, enrich, fuse, retrieve, units
from ..operators.retrieve import Terminology
from ..profile import Profile
from ..sources import batch
from . import align, reuse
from .fixtures import sql, view

P = Profile()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_ALLOWED = ", ".join(f"'{x}'" for x in P.allowed_predicates)
_PROHIBITED = ", ".join(f"'{x}'" for x in P.prohibited_predicates)


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def terminology(spark: SparkSession, d: str) -> Terminology:
    c = view(spark, d, "v_concepts").withColumns({"vocabulary": F.lit(P.target_terminology), "release": F.lit("2024"), "synonyms": F.array_compact(F.array("synonym")), "remapped_to": F.array().cast("array<string>")}).drop("synonym")
    names = c.select("vocabulary", "release", "concept_id", F.explode(F.concat(F.array("preferred_label"), "synonyms")).alias("name"), (F.col("status") == "active").alias("is_current"))
    edges = view(spark, d, "v_edges").withColumns({"vocabulary": F.lit(P.target_terminology), "release": F.lit("2024"), "edge_order": F.col("object_id")})
    return Terminology(c, names.distinct(), edges.distinct())


def values(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "v_mentions").select(F.col("reported").alias("value")).where("trim(reported) <> ''").distinct()
    return m.withColumn("unit_key", F.col("value"))


_NORMAL = "trim(regexp_replace(lower({}), '[ \\t\\n\\r]+', ' ', 'g'))"
_EXACT = f"""
names AS (SELECT concept_id, preferred_label AS name, status FROM v_concepts UNION SELECT concept_id, synonym, status FROM v_concepts WHERE synonym IS NOT NULL),
hits AS (SELECT v.reported AS unit_key, n.concept_id, min(n.name) AS name FROM (SELECT DISTINCT reported FROM v_mentions WHERE trim(reported) <> '') v
  JOIN names n ON {_NORMAL.format('v.reported')} = {_NORMAL.format('n.name')} {{where}} GROUP BY 1, 2)
"""


@query(sql("WITH " + _EXACT.format(where="WHERE n.status = 'active'") + "SELECT unit_key, concept_id, name, CAST(row_number() OVER (PARTITION BY unit_key ORDER BY concept_id) AS INTEGER) AS hit_rank FROM hits", "v_concepts", "v_mentions"))
def exact_hits(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.exact_hits(values(spark, d), terminology(spark, d).names.where("is_current")).select("unit_key", "concept_id", "name", "hit_rank")


@query()
def approx_hits(spark: SparkSession, d: str) -> DataFrame:
    t, put = terminology(spark, d), align.store(spark)
    return retrieve.approx_hits(retrieve.unmet(put(values(spark, d), "values"), t.names), t.names, P, put=put).select("unit_key", "concept_id", "name", F.round("score", 6).alias("score"), "hit_rank")


@query(sql(f"""
WITH n AS MATERIALIZED (SELECT DISTINCT concept_id, name, {_NORMAL.format("name")} AS own FROM (SELECT concept_id, preferred_label AS name FROM v_concepts WHERE status = 'active' UNION ALL SELECT concept_id, synonym FROM v_concepts WHERE status = 'active' AND synonym IS NOT NULL)),
v AS MATERIALIZED (SELECT DISTINCT reported AS unit_key, {_NORMAL.format("reported")} AS own FROM v_mentions WHERE trim(reported) <> ''),
d AS (SELECT v.own, n.own AS name, levenshtein(v.own, n.own) AS distance FROM (SELECT DISTINCT own FROM v) v JOIN (SELECT DISTINCT own FROM n WHERE own <> '') n ON abs(length(v.own) - length(n.own)) * 3 <= length(v.own)),
s AS (SELECT own, name, CAST(row_number() OVER (PARTITION BY own ORDER BY distance, name) AS INTEGER) AS place FROM d WHERE distance > 0 AND distance * 3 <= length(own) QUALIFY place <= 3),
h AS (SELECT own, concept_id, min(name) AS name FROM n GROUP BY 1, 2),
f AS (SELECT v.unit_key, h.concept_id, arg_min(s.name, (s.place, h.name)) AS query, arg_min(h.name, (s.place, h.name)) AS name, min(s.place) AS place FROM v JOIN s ON s.own = v.own JOIN h ON h.own = s.name GROUP BY 1, 2)
SELECT unit_key, 'spelling_suggestion' AS channel, query, concept_id, name, CAST(90.0 AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY unit_key ORDER BY place, concept_id) AS INTEGER) AS hit_rank FROM f
""", "v_concepts", "v_mentions"))  # fmt: skip
def spelling_hits(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.spelling_hits(values(spark, d), terminology(spark, d).names, align.store(spark))


@query(sql("WITH " + _EXACT.format(where="WHERE n.status = 'active'") + ", old AS (SELECT DISTINCT v.reported AS unit_key FROM v_mentions v WHERE trim(v.reported) <> '') SELECT unit_key FROM old WHERE unit_key NOT IN (SELECT unit_key FROM hits)", "v_concepts", "v_mentions"))
def unmet_values(spark: SparkSession, d: str) -> DataFrame:
    asked = align.store(spark)(values(spark, d), "values")
    return retrieve.unmet(asked, terminology(spark, d).names.where("is_current")).select("unit_key")


@query(sql("""
SELECT unit_key, candidate_id, coalesce(max(score), 0.0) AS best_score, min(hit_rank) AS best_rank, count(*) AS evidence, count(DISTINCT channel) AS channels,
  coalesce(arg_min(status, hit_order) FILTER (WHERE status <> 'unknown'), 'unknown') AS status, arg_min(channel, hit_order) AS first_channel, arg_min(source_vocabulary, hit_order) AS first_vocabulary
FROM v_hits GROUP BY unit_key, candidate_id
""", "v_hits"))  # fmt: skip
def fused_candidates(spark: SparkSession, d: str) -> DataFrame:
    f = fuse.fuse(view(spark, d, "v_hits"))
    return f.select("unit_key", "candidate_id", "best_score", "best_rank", F.size("evidence").cast("long").alias("evidence"), F.size("channels").cast("long").alias("channels"), "status", F.col("channels")[0].alias("first_channel"), F.col("vocabularies")[0].alias("first_vocabulary"))


_FUSED = """
f AS (SELECT unit_key, candidate_id, coalesce(max(score), 0.0) AS best_score, list_sort(list(DISTINCT channel)) AS channels, coalesce(arg_min(status, hit_order) FILTER (WHERE status <> 'unknown'), 'unknown') AS status,
  min(CASE channel WHEN 'exact_lookup' THEN 0 WHEN 'normalized_lookup' THEN 1 WHEN 'terminology_approximate_current' THEN 2 WHEN 'spelling_suggestion' THEN 3 WHEN 'terminology_approximate_historical' THEN 4 ELSE 99 END) AS priority
  FROM v_hits GROUP BY unit_key, candidate_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY unit_key ORDER BY priority, CASE WHEN status = 'active' THEN 0 ELSE 1 END, best_score DESC, candidate_id) AS INTEGER) AS rank FROM f)
"""


@query(sql("WITH " + _FUSED + "SELECT unit_key, candidate_id, rank, best_score, status FROM r WHERE rank <= 10", "v_hits"))
def ranked_topk(spark: SparkSession, d: str) -> DataFrame:
    return fuse.rank_candidates(fuse.fuse(view(spark, d, "v_hits")), P.maximum_candidates).select("unit_key", "candidate_id", "rank", "best_score", "status")


@query(sql("WITH " + _FUSED + "SELECT unit_key, candidate_id, CAST(len(list_filter(channels, lambda x: x <> 'terminology_approximate_historical')) AS INTEGER) AS agreement FROM r", "v_hits"))
def channel_agreement(spark: SparkSession, d: str) -> DataFrame:
    return fuse.fuse(view(spark, d, "v_hits")).select("unit_key", "candidate_id", fuse.channel_agreement(F.col("channels")).alias("agreement"))


@query(sql("WITH " + _FUSED + """, top AS (SELECT * FROM r WHERE rank = 1)
SELECT t.unit_key, t.candidate_id, t.best_score - (SELECT max(o.best_score) FROM r o WHERE o.unit_key = t.unit_key AND o.candidate_id <> t.candidate_id AND o.rank <= 10 AND list_has_any(o.channels, t.channels)) AS margin FROM top t""", "v_hits"))
def score_margin(spark: SparkSession, d: str) -> DataFrame:
    r = fuse.rank_candidates(fuse.fuse(view(spark, d, "v_hits")), P.maximum_candidates)
    packed = r.groupBy("unit_key").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate_id", "channels", "best_score"))).alias("candidates")).withColumn("candidate_id", F.col("candidates")[0]["candidate_id"])
    return packed.select("unit_key", "candidate_id", fuse.score_margin(F.col("candidates"), F.col("candidate_id")).alias("margin"))


@query(sql(f"SELECT subject_id, predicate, object_id FROM v_edges WHERE predicate IN ({_ALLOWED}) AND predicate NOT IN ({_PROHIBITED})", "v_edges"))
def permitted_edges(spark: SparkSession, d: str) -> DataFrame:
    return enrich.permit_edges(view(spark, d, "v_edges"), P).select("subject_id", "predicate", "object_id")


@query(sql(f"SELECT subject_id, string_agg(DISTINCT predicate, '|' ORDER BY predicate) AS predicates FROM v_edges WHERE predicate IN ({_PROHIBITED}) GROUP BY subject_id", "v_edges"))
def blocked_predicates(spark: SparkSession, d: str) -> DataFrame:
    return enrich.blocked_predicates(view(spark, d, "v_edges"), P).select("subject_id", F.array_join("predicates", "|").alias("predicates"))


@query(sql(f"SELECT p AS predicate, p IN (SELECT predicate FROM v_edges) AS supported FROM (SELECT unnest([{_ALLOWED}]) AS p)", "v_edges"))
def supported_predicates(spark: SparkSession, d: str) -> DataFrame:
    return enrich.supported_predicates(view(spark, d, "v_edges"), P)


@query(sql("""
WITH RECURSIVE walk(candidate_id, object_id, object_class, hops) AS (
  SELECT subject_id, object_id, object_class, 1 FROM v_edges UNION SELECT w.candidate_id, e.object_id, e.object_class, w.hops + 1 FROM walk w JOIN v_edges e ON e.subject_id = w.object_id WHERE w.hops < 3)
SELECT candidate_id, CASE object_class WHEN 'IN' THEN 'has_ingredient' ELSE 'has_tradename' END AS predicate, object_id, CAST(min(hops) AS INTEGER) AS hops FROM walk WHERE object_class IN ('IN', 'BN') GROUP BY 1, 2, 3
""", "v_edges"))  # fmt: skip
def closure(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "v_edges")
    return enrich.related_closure(e.select(F.col("subject_id").alias("candidate_id")), e, ["IN", "BN"], 3, align.store(spark)).select("candidate_id", "predicate", "object_id", "hops")


@query(sql("""
WITH r AS (SELECT candidate_id, unit_key, concept_class, CAST(row_number() OVER (PARTITION BY unit_key ORDER BY candidate_id) AS INTEGER) AS rank FROM (
    SELECT concept_id AS candidate_id, concept_class, preferred_label[1:2] AS unit_key FROM v_concepts WHERE concept_class NOT IN ('IN', 'PIN'))),
h AS (SELECT r.*, CAST(ceil(rank / 3.0) AS INTEGER) AS batch, EXISTS (SELECT 1 FROM v_edges e WHERE e.subject_id = r.candidate_id AND e.predicate = 'has_ingredient') AS hit FROM r),
s AS (SELECT *, min(CASE WHEN hit THEN batch END) OVER (PARTITION BY unit_key) AS stop FROM h)
SELECT unit_key, candidate_id, batch, coalesce(batch <= stop, true) AS enriched, CASE WHEN coalesce(batch <= stop, true) THEN (SELECT count(DISTINCT (predicate, object_id)) FROM v_edges e WHERE e.subject_id = s.candidate_id AND e.predicate <> 'may_treat') ELSE 0 END AS n_edges FROM s
""", "v_concepts", "v_edges"))  # fmt: skip
def progressive_enrichment(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    t = terminology(spark, d)
    c = t.concepts.where("concept_class not in ('IN', 'PIN')").select(F.col("concept_id").alias("candidate_id"), "concept_class", F.substring("preferred_label", 1, 2).alias("unit_key"))
    ranked = c.withColumn("rank", F.row_number().over(Window.partitionBy("unit_key").orderBy("candidate_id")))
    return enrich.enrich(ranked, t.edges, P).select("unit_key", "candidate_id", "batch", "enriched", F.size("edges").cast("long").alias("n_edges"))


def _selves(spark: SparkSession, d: str) -> DataFrame:
    """Each concept as the only candidate of a unit of its own, found by its label."""
    t = terminology(spark, d)
    c = t.concepts.select(F.col("concept_id").alias("unit_key"), F.col("concept_id").alias("candidate_id"), F.col("preferred_label").alias("label"), "concept_class", "status", "vocabulary", "synonyms", F.array(F.lit("normalized_lookup")).alias("channels"), F.lit(100.0).alias("best_score"), F.lit(1).alias("best_rank"), F.lit(1).alias("rank"))
    return enrich.enrich(c, t.edges, P)


@query(sql("""
WITH e AS (SELECT DISTINCT e.subject_id, e.predicate, e.object_id, e.object_label, e.object_class, c.status FROM v_edges e JOIN v_concepts c ON c.concept_id = e.subject_id WHERE e.predicate <> 'may_treat'),
x AS (SELECT concept_id AS unit_key, concept_id, preferred_label AS label, concept_class, status, true AS direct, NULL AS source, NULL AS predicate FROM v_concepts
  UNION ALL SELECT subject_id, object_id, object_label, object_class, CASE WHEN status = 'active' AND predicate IN ('has_ingredient', 'has_precise_ingredient') THEN 'active' ELSE 'unknown' END, false, subject_id, predicate FROM e)
SELECT unit_key, concept_id, min(label) AS label, min(concept_class) AS concept_class, CASE WHEN bool_or(direct) THEN max(status) WHEN bool_or(status = 'active') THEN 'active' ELSE 'unknown' END AS status, bool_or(direct) AS direct,
  coalesce(string_agg(DISTINCT source, '|' ORDER BY source), '') AS sources, coalesce(string_agg(DISTINCT predicate, '|' ORDER BY predicate), '') AS predicates FROM x GROUP BY unit_key, concept_id
""", "v_concepts", "v_edges"))  # fmt: skip
def evidence_index(spark: SparkSession, d: str) -> DataFrame:
    i = enrich.evidence_index(_selves(spark, d))
    return i.select("unit_key", "concept_id", "label", "concept_class", "status", "direct", F.array_join("sources", "|").alias("sources"), F.array_join("predicates", "|").alias("predicates"))


@query(sql("""
SELECT p_partkey AS unit_key, x.id AS concept_id FROM part, (SELECT unnest(['a', 'b']) AS v) u, LATERAL (SELECT CASE WHEN p_partkey % 3 = 0 OR v = 'a' THEN 'c1' ELSE 'c2' END AS id) x
GROUP BY 1, 2 HAVING count(DISTINCT v) = 1
""", "v_concepts"))  # fmt: skip
def unambiguous_evidence(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("unit_key"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("vocabulary_lc"))
    e = p.withColumn("concept_id", F.when((F.col("unit_key") % 3 == 0) | (F.col("vocabulary_lc") == "a"), F.lit("c1")).otherwise(F.lit("c2")))
    return enrich.unambiguous(e).select("unit_key", "concept_id")


@query(sql("SELECT DISTINCT concept_id, preferred_label, concept_class FROM v_concepts WHERE concept_class <> 'DF' AND concept_id IN (SELECT object_id FROM v_edges)", "v_concepts", "v_edges"))
def concept_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "v_concepts")
    found = view(spark, d, "v_edges").select(F.col("object_id").alias("concept_id"))
    return retrieve.lookup(found, c.where("concept_class = 'IN'"), c.where("concept_class <> 'DF'")).select("concept_id", "preferred_label", "concept_class")


@query(sql("""
SELECT object_id AS concept_id, c.concept_id IS NOT NULL AS "exists", coalesce(c.status, 'unknown') AS status FROM (SELECT DISTINCT object_id FROM v_edges) LEFT JOIN (SELECT * FROM v_concepts WHERE concept_class NOT IN ('BN', 'DF')) c ON c.concept_id = object_id
""", "v_concepts", "v_edges"))  # fmt: skip
def concept_exists(spark: SparkSession, d: str) -> DataFrame:
    history = view(spark, d, "v_concepts").withColumn("source", F.when(F.col("concept_class") == "BN", F.lit("NONE")).when(F.col("concept_class") != "DF", F.lit("main")))
    found = view(spark, d, "v_edges").select(F.col("object_id").alias("concept_id"))
    return retrieve.validate_concepts(found, history).select("concept_id", "exists", "status")


@query(sql("SELECT terminology_release AS release, count(*) AS n FROM v_response_log WHERE terminology_release IS DISTINCT FROM '2024-02' GROUP BY 1", "v_response_log"))
def release_pin(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.release_violations(view(spark, d, "v_response_log").withColumnRenamed("terminology_release", "release"), "2024-02")


def _adjudicated(spark: SparkSession, d: str) -> DataFrame:
    packed = enrich.packages(_selves(spark, d), P)
    label = F.col("candidates")[0]["label"]
    ready = F.struct(F.lit("READY_FOR_MAPPING").alias("status"), F.array().cast("array<string>").alias("missing_context"))
    from ..functions.text import normalize_text

    rows = packed.withColumns({"raw_value": label, "normalized": normalize_text(label), "route": F.lit("oral"), "readiness": ready, "similarity": F.lit(1.0)})
    return adjudicate.adjudicate(rows, P)


_CHOSEN = """
t AS (SELECT c.concept_id, c.concept_class, c.status, list_sort(list(DISTINCT e.object_id) FILTER (WHERE e.predicate = 'has_ingredient')) AS ids, count(DISTINCT e.object_id) FILTER (WHERE e.predicate = 'has_dose_form') AS forms, count(DISTINCT e.object_id) FILTER (WHERE e.predicate = 'has_precise_ingredient') AS precise
  FROM v_concepts c LEFT JOIN v_edges e ON e.subject_id = c.concept_id GROUP BY ALL),
a AS (SELECT *, CASE WHEN concept_class = 'IN' THEN [concept_id] ELSE coalesce(ids, []) END AS targets FROM t),
j AS (SELECT *, CASE WHEN len(targets) = 0 THEN 'ABSTAINED' WHEN len(targets) = 1 THEN 'MAPPED' ELSE 'MULTI_CONCEPT_MAPPED' END AS decision,
  CASE WHEN len(targets) = 0 THEN 'UNSUPPORTED_MAPPING' WHEN len(targets) > 1 THEN 'MULTIPLE_COMPONENTS_REQUIRED' WHEN targets[1] = concept_id THEN 'EXACT' ELSE 'TARGET_BROADER_THAN_SOURCE' END AS relationship FROM a),
l AS (SELECT *, CASE WHEN decision = 'ABSTAINED' OR relationship = 'EXACT' THEN [] ELSE list_filter([
  CASE WHEN concept_class IN ('SCD', 'SBD') THEN 'strength' END, CASE WHEN concept_class IN ('SCD', 'SBD') AND forms > 0 THEN 'dose_form' END, CASE WHEN concept_class = 'PIN' OR precise > 0 THEN 'salt_form' END,
  CASE WHEN concept_class IN ('SBD', 'BN') THEN 'brand_identity' END, 'route', CASE WHEN decision = 'MULTI_CONCEPT_MAPPED' THEN 'combination_component' END], lambda x: x IS NOT NULL) END AS losses FROM j)
"""


@query(sql("WITH " + _CHOSEN + "SELECT concept_id, decision, relationship, CASE WHEN decision = 'ABSTAINED' THEN '' ELSE array_to_string(targets, '|') END AS selected_ids, decision = 'ABSTAINED' OR status <> 'active' AS requested_review FROM l", "v_concepts", "v_edges"))
def adjudicated(spark: SparkSession, d: str) -> DataFrame:
    return _adjudicated(spark, d).select(F.col("unit_key").alias("concept_id"), "decision", "relationship", F.array_join("selected.concept_id", "|").alias("selected_ids"), "requested_review")


#: A number of each concept, from which its unit's state is made; the same SQL on both engines.
_UNIT_NUMBER = "(ascii(substr(concat({0}, '____'), 2, 1)) * 31 + ascii(substr(concat({0}, '____'), 3, 1)) * 7 + ascii(substr(concat({0}, '____'), 4, 1)) * 3 + length({0}))"
#: What a unit's state is: without context, without candidates, found by a lookup, named otherwise, alike so far.
_UNIT_STATE = {"unready": "k % 17 = 0", "bare": "k % 19 = 0", "backed": "k % 2 = 0", "renamed": "k % 3 <> 0", "similarity": "CAST((k * 13) % 101 AS DOUBLE) / 100"}
_GATE_PROFILES = {
    "base": P,
    "components_forbidden": Profile(relation_types=("EXACT", "TARGET_BROADER_THAN_SOURCE", "RELATED_NOT_EQUIVALENT", "UNSUPPORTED_MAPPING", "INSUFFICIENT_CONTEXT")),
    "only_broader": Profile(relation_types=("TARGET_BROADER_THAN_SOURCE",)),
    "no_granularity": Profile(granularity=None),
}
_GATES = "WITH " + _CHOSEN + """,
form AS (SELECT subject_id, max(object_label) FILTER (predicate = 'has_dose_form') AS form, max(object_label) FILTER (predicate = 'has_precise_ingredient') AS precise_label, max(object_label) FILTER (predicate = 'has_tradename') AS brand FROM v_edges GROUP BY 1),
n AS (SELECT a.*, c.preferred_label AS label, f.form, f.precise_label, f.brand, """ + _UNIT_NUMBER.format("a.concept_id") + """ AS k FROM a JOIN v_concepts c USING (concept_id) LEFT JOIN form f ON f.subject_id = a.concept_id),
s AS (SELECT n.*, """ + ", ".join(f"{x} AS {name}" for name, x in _UNIT_STATE.items()) + """ FROM n),
allowed AS (""" + " UNION ALL ".join(f"SELECT '{name}' AS profile, {list(p.relation_types)!r} AS relations, {str(p.granularity is not None).lower()} AS ruled" for name, p in _GATE_PROFILES.items()) + """),
g AS (SELECT *, CASE WHEN unready THEN 'context' WHEN bare THEN 'nothing' WHEN similarity < 0.3 AND NOT backed THEN 'unlike' WHEN NOT ruled THEN 'granularity' WHEN len(targets) = 0 THEN 'unresolved' WHEN len(targets) > 1 THEN 'several' ELSE 'single' END AS gate FROM s, allowed),
r AS (SELECT *, CASE gate WHEN 'unresolved' THEN 'RELATED_NOT_EQUIVALENT' WHEN 'several' THEN 'MULTIPLE_COMPONENTS_REQUIRED' WHEN 'single' THEN CASE WHEN targets[1] <> concept_id THEN 'TARGET_BROADER_THAN_SOURCE' WHEN NOT renamed OR backed OR similarity >= 0.85 THEN 'EXACT' ELSE 'RELATED_NOT_EQUIVALENT' END END AS relation FROM g),
o AS (SELECT *, CASE WHEN relation IS NOT NULL AND NOT list_contains(relations, relation) THEN 'forbidden' ELSE gate END AS final FROM r)
SELECT concept_id, profile,
  CASE final WHEN 'context' THEN 'INSUFFICIENT_CONTEXT' WHEN 'nothing' THEN 'NO_VALID_MAPPING' WHEN 'unlike' THEN 'NO_VALID_MAPPING' WHEN 'granularity' THEN 'ABSTAINED' WHEN 'forbidden' THEN 'ABSTAINED' WHEN 'several' THEN 'MULTI_CONCEPT_MAPPED' ELSE 'MAPPED' END AS decision,
  CASE WHEN final = 'context' THEN 'INSUFFICIENT_CONTEXT' WHEN final IN ('nothing', 'unlike', 'granularity', 'forbidden') THEN 'UNSUPPORTED_MAPPING' ELSE relation END AS relationship,
  CASE final WHEN 'several' THEN array_to_string(list_transform(targets, lambda x: x || ' COMPONENT_OF'), '|') WHEN 'single' THEN targets[1] || ' ' || relation WHEN 'unresolved' THEN concept_id || ' RELATED_NOT_EQUIVALENT' ELSE '' END AS selected,
  CASE WHEN final IN ('several', 'single', 'unresolved') THEN concept_id END AS source_level_id, CASE WHEN final = 'single' THEN targets[1] END AS analysis_level_id,
  CASE WHEN final IN ('several', 'single', 'unresolved') THEN final = 'unresolved' OR status <> 'active' ELSE final NOT IN ('nothing', 'unlike') END AS requested_review,
  CASE WHEN final = 'several' OR final = 'single' AND relation <> 'EXACT' THEN array_to_string(list_filter([
    CASE WHEN concept_class IN ('SCD', 'SBD') THEN 'strength=' || regexp_extract(label, '[0-9]+ MG') END, CASE WHEN concept_class IN ('SCD', 'SBD') AND form IS NOT NULL THEN 'dose_form=' || form END,
    CASE WHEN concept_class = 'PIN' THEN 'salt_form=' || label WHEN precise_label IS NOT NULL THEN 'salt_form=' || precise_label END, CASE WHEN concept_class = 'SBD' THEN 'brand_identity=' || coalesce(brand, label) END,
    'route=oral', CASE WHEN final = 'several' THEN 'combination_component=' || label END], lambda x: x IS NOT NULL), '|') ELSE '' END AS losses
FROM o
"""


@query(sql(_GATES, "v_concepts", "v_edges"))
def adjudication_gates(spark: SparkSession, d: str) -> DataFrame:
    """Every gate of the choice under four profiles: relations with their concepts, losses with their values."""
    from ..functions.text import normalize_text

    packed = enrich.packages(_selves(spark, d), P).withColumn("k", F.expr(_UNIT_NUMBER.format("unit_key")))
    packed = packed.select("*", *[F.expr(x).alias(name) for name, x in _UNIT_STATE.items()])
    label, none = F.col("candidates")[0]["label"], F.array().cast("array<string>")
    channels = F.when(F.col("backed"), F.array(F.lit("normalized_lookup"))).otherwise(F.array(F.lit("terminology_approximate_current")))
    rows = packed.withColumns({
        "raw_value": label, "normalized": F.when(F.col("renamed"), F.lit("another name")).otherwise(normalize_text(label)), "route": F.lit("oral"),
        "readiness": F.struct(F.when(F.col("unready"), F.lit("INSUFFICIENT_CONTEXT")).otherwise(F.lit("READY_FOR_MAPPING")).alias("status"), none.alias("missing_context")),
        "candidates": F.filter(F.transform("candidates", lambda c: c.withField("channels", channels)), lambda c: ~F.col("bare")),
    })
    kept = align.store(spark)(rows, "gates")
    out = None
    for name, p in _GATE_PROFILES.items():
        each = adjudicate.adjudicate(kept, p).select(
            F.col("unit_key").alias("concept_id"), F.lit(name).alias("profile"), "decision", "relationship", F.array_join(F.transform("selected", lambda c: F.concat_ws(" ", c["concept_id"], c["relation"])), "|").alias("selected"),
            F.col("source_level.concept_id").alias("source_level_id"), F.col("analysis_level.concept_id").alias("analysis_level_id"), "requested_review", F.array_join(F.transform("losses", lambda x: F.concat_ws("=", x["kind"], x["source_value"])), "|").alias("losses"),
        )
        out = each if out is None else out.unionByName(each)
    return out


@query(sql("WITH " + _CHOSEN + "SELECT concept_id, array_to_string(losses, '|') AS loss_kinds FROM l", "v_concepts", "v_edges"))
def information_loss(spark: SparkSession, d: str) -> DataFrame:
    return _adjudicated(spark, d).select(F.col("unit_key").alias("concept_id"), F.array_join("losses.kind", "|").alias("loss_kinds"))


@query(sql("WITH " + _CHOSEN + "SELECT kind, count(*) AS n FROM (SELECT unnest(losses) AS kind FROM l) GROUP BY kind", "v_concepts", "v_edges"))
def loss_profile(spark: SparkSession, d: str) -> DataFrame:
    return audit.loss_profile(_adjudicated(spark, d))


def mention_units(spark: SparkSession, d: str) -> DataFrame:
    return units.build_units(view(spark, d, "v_mentions"), "reported", ["l_orderkey", "l_linenumber"], ["route", "role_cod", "dose_amt"], P)


def exact_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The whole alignment on the exact channel over all names."""
    t = terminology(spark, d)
    return align.align(mention_units(spark, d), t, P, lambda asked: retrieve.exact_hits(asked, t.names), release="2024")


_CROSSWALK = "WITH " + _EXACT.format(where="") + """,
top AS (SELECT unit_key, concept_id AS source_id FROM (SELECT h.unit_key, h.concept_id, row_number() OVER (PARTITION BY h.unit_key ORDER BY CASE WHEN c.status = 'active' THEN 0 ELSE 1 END, h.concept_id) AS k FROM hits h JOIN v_concepts c USING (concept_id)) WHERE k = 1),
""" + _CHOSEN + """,
m AS (SELECT reported AS reported_value, route FROM v_mentions WHERE trim(reported) <> ''),
x AS (SELECT m.*, l.*, coalesce(l.decision, 'ABSTAINED') AS d0, coalesce(l.status, '') = 'active' AS live FROM m LEFT JOIN top ON top.unit_key = m.reported_value LEFT JOIN l ON l.concept_id = top.source_id)
"""
_CROSSWALK_ROWS = """
SELECT reported_value, route, d0 AS decision, coalesce(relationship, 'UNSUPPORTED_MAPPING') AS relationship_to_source, CASE WHEN d0 <> 'ABSTAINED' THEN concept_id END AS source_level_id,
  CASE WHEN d0 = 'MAPPED' THEN targets[1] END AS analysis_level_id, CASE WHEN d0 = 'ABSTAINED' THEN '' ELSE array_to_string(targets, '|') END AS selected_ids,
  CASE WHEN d0 = 'ABSTAINED' THEN '' ELSE array_to_string(list_sort(list_filter(losses, lambda k: k <> 'route' OR route IS NOT NULL)), '|') END AS semantic_loss_kinds,
  CASE WHEN d0 = 'ABSTAINED' OR NOT live THEN 'HUMAN_REVIEW' ELSE 'AUTO_ACCEPT' END AS routing_status, count(*) AS n FROM x GROUP BY ALL
"""


@query(sql(_CROSSWALK + _CROSSWALK_ROWS, "v_concepts", "v_edges", "v_mentions"))
def crosswalk(spark: SparkSession, d: str) -> DataFrame:
    rows = exact_decisions(spark, d)
    flat = batch.to_crosswalk(rows.withColumn("run_id", F.coalesce("envelope.route", F.lit(""))))
    keep = ["reported_value", "decision", "relationship_to_source", "source_level_id", "analysis_level_id", "selected_ids", "semantic_loss_kinds", "routing_status"]
    return flat.withColumn("route", F.nullif("run_id", F.lit(""))).groupBy("route", *keep).agg(F.count(F.lit(1)).alias("n"))


@query(sql(_CROSSWALK + ", c AS (" + _CROSSWALK_ROWS + ") SELECT CASE WHEN decision IS NULL THEN 'skipped' ELSE 'success' END AS status, routing_status, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2 UNION ALL SELECT 'skipped', NULL, count(*) FROM v_mentions WHERE trim(reported) = ''", "v_concepts", "v_edges", "v_mentions"))
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return audit.batch_summary(exact_decisions(spark, d))


@query(sql("""
SELECT o.o_orderkey, o.o_orderstatus, x.mapped_n FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS mapped_n FROM v_mentions WHERE trim(reported) <> '' GROUP BY 1) x ON x.l_orderkey = o.o_orderkey
""", "v_mentions"))  # fmt: skip
def crosswalk_join(spark: SparkSession, d: str) -> DataFrame:
    source = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus")
    own = view(spark, d, "v_mentions").where("trim(reported) <> ''").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return align.attach_crosswalk(source, own, "o_orderkey")


@query()
def full_alignment(spark: SparkSession, d: str) -> DataFrame:
    """All channels: how many rows end where."""
    put = align.store(spark)
    rows = align.align(mention_units(spark, d), terminology(spark, d).stored(put), P, release="2024", put=put)
    return batch.to_crosswalk(rows).groupBy("decision", "relationship_to_source", "validation_status", "routing_status").agg(F.count(F.lit(1)).alias("n"))


#: A later release: one product in a hundred has another label, and one brand has expired.
_LATER = "(concept_id RLIKE '^P[0-9]*07$')"
_BRAND = "concept_id = 'B_Brand#13'"


def later_terminology(t: Terminology) -> Terminology:
    c = t.concepts.withColumn("preferred_label", F.expr(f"CASE WHEN {_LATER} THEN concat(preferred_label, ' II') ELSE preferred_label END")).withColumn("status", F.expr(f"CASE WHEN {_BRAND} THEN 'obsolete' ELSE status END"))
    names = c.select("vocabulary", "release", "concept_id", F.explode(F.concat(F.array("preferred_label"), "synonyms")).alias("name"), (F.col("status") == "active").alias("is_current"))
    return Terminology(c, names.distinct(), t.edges)


def alignment_keys(spark: SparkSession, d: str) -> DataFrame:
    # stored, as Spark drops a distinct below a least value, and each row's form is made
    rows = align.store(spark)(mention_units(spark, d).where("status = 'success'").select("raw_value").distinct(), "told")
    return rows.groupBy(text.normalize_text(F.col("raw_value")).alias("unit_key")).agg(F.min("raw_value").alias("raw_value"))


@query(sql(f"""
WITH names AS (SELECT concept_id, preferred_label AS name, status FROM v_concepts UNION SELECT concept_id, synonym, status FROM v_concepts WHERE synonym IS NOT NULL),
v AS (SELECT DISTINCT {_NORMAL.format("reported")} AS unit_key FROM v_mentions WHERE trim(reported) <> ''),
h AS (SELECT DISTINCT v.unit_key, n.concept_id, n.status FROM v JOIN names n ON v.unit_key = {_NORMAL.format("n.name")}),
changed AS (SELECT concept_id, preferred_label, synonym FROM v_concepts WHERE regexp_matches(concept_id, '^P[0-9]*07$') OR {_BRAND}),
touched AS (SELECT {_NORMAL.format("preferred_label")} AS unit_key FROM changed UNION SELECT {_NORMAL.format("preferred_label || ' II'")} FROM changed WHERE NOT {_BRAND} UNION SELECT {_NORMAL.format("synonym")} FROM changed WHERE synonym IS NOT NULL),
reach AS (SELECT concept_id FROM changed UNION SELECT subject_id FROM v_edges WHERE predicate IN ({_ALLOWED}) AND object_id IN (SELECT concept_id FROM changed)),
kept AS (SELECT unit_key, concept_id FROM h QUALIFY row_number() OVER (PARTITION BY unit_key ORDER BY CASE WHEN status = 'active' THEN 0 ELSE 1 END, concept_id) <= {P.maximum_candidates}),
redo AS (SELECT unit_key FROM touched UNION SELECT unit_key FROM kept WHERE concept_id IN (SELECT concept_id FROM reach))
SELECT unit_key, CASE WHEN unit_key IN (SELECT unit_key FROM redo) THEN 'built' ELSE 'carried' END AS origin FROM v
""", "v_concepts", "v_edges", "v_mentions"))  # fmt: skip
def packages_carried(spark: SparkSession, d: str) -> DataFrame:
    """Which keys' packages a run under the next release takes over from the one before, on the exact channel."""
    import uuid

    kept, put = reuse.PackageStore(f"{align.shared_dir(spark)}/packages-{uuid.uuid4().hex}"), align.store(spark)
    old = terminology(spark, d).stored(put)
    new = later_terminology(old).stored(put)
    exact = lambda asked, t: retrieve.exact_hits(asked, t.names)
    keys = put(alignment_keys(spark, d), "keys")
    reuse.reuse_packages(kept, "2024", "first", old, P, put, hits=exact)(keys)
    return reuse.reuse_packages(kept, "2025", "second", new, P, put, ("2024", old), exact)(keys).select("unit_key", "origin")
