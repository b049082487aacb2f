"""Queries on validation, routing, evaluation, audits and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, enrich, evaluate, fuse, retrieve, route, validate
from ..operators.adjudicate import concept
from ..profile import Profile
from ..sources import adapters, batch
from ..sources.split_csv import read_csv
from . import align, queries_align
from .fixtures import sql, view

P = Profile()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _list(c: str) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, r"\|"))


def proposals(spark: SparkSession, d: str) -> DataFrame:
    """The corrupted proposals with their packages: the product itself as the only candidate."""
    from .queries_align import _selves

    p = view(spark, d, "v_proposals").withColumn("unit_key", F.regexp_replace("sau_id", "^SAU-", "P"))
    full = align.store(spark)(_selves(spark, d), "selves")
    own = F.struct("label", "concept_class", "status", "direct", F.lit(P.target_terminology).alias("vocabulary"), "sources", "predicates")
    evidence = enrich.evidence_index(full).groupBy("unit_key").agg(F.map_from_entries(F.collect_list(F.struct(F.col("concept_id").alias("key"), own.alias("value")))).alias("evidence"))
    relation = F.when(F.col("decision") == "MULTI_CONCEPT_MAPPED", F.lit("COMPONENT_OF")).otherwise(F.col("relationship"))
    target, vocabulary = lambda x: concept(x, F.when(x == F.get(F.split("selected_ids", r"\|"), F.lit(0)), F.col("claimed_label")).otherwise(F.regexp_replace(x, "^I_", "")), vocabulary, F.col("claimed_class"), F.col("claimed_status"), relation), F.lit(P.target_terminology)
    rows = p.join(enrich.packages(full, P), "unit_key").join(evidence, "unit_key")
    return rows.select(
        "sau_id", "package_sau_id", "decision", "relationship", "requested_human_review", "candidates", "evidence", F.col("candidates")[0]["label"].alias("raw_value"), F.lower(F.col("candidates")[0]["label"]).alias("normalized"),
        F.transform(_list("selected_ids"), target).alias("selected"), F.when(F.col("analysis_id").isNotNull(), target(F.col("analysis_id"))).alias("analysis_level"),
        F.when(F.col("source_id").isNotNull(), concept(F.col("source_id"), F.col("candidates")[0]["label"], vocabulary, F.col("candidates")[0]["concept_class"], F.col("candidates")[0]["status"], F.lit("EXACT"))).alias("source_level"),
        F.transform(_list("loss_kinds"), lambda k: F.struct(k.alias("kind"), F.lit("").alias("description"), F.lit(None).cast("string").alias("source_value"))).alias("losses"),
        F.struct(F.lit("READY_FOR_MAPPING").alias("status"), F.array().cast("array<string>").alias("missing_context")).alias("readiness"), F.lit(1.0).alias("similarity"), F.lit(None).cast("string").alias("rationale"), F.lit(None).cast("string").alias("route"),
    ).withColumnRenamed("requested_human_review", "requested_review")


def validated(spark: SparkSession, d: str) -> DataFrame:
    return validate.validate(proposals(spark, d), P)


_PROPOSALS = """
p AS (SELECT v.*, string_split(selected_ids, '|') AS ids, 'P' || substr(sau_id, 5) AS own, requested_human_review AS asked, source_id IS NULL AS no_source, analysis_id IS NULL AS no_analysis,
  decision IN ('NO_VALID_MAPPING', 'INSUFFICIENT_CONTEXT', 'ABSTAINED') AS hollow FROM v_proposals v),
q AS (SELECT *, asked AND no_analysis AND relationship = 'RELATED_NOT_EQUIVALENT' AS unresolved, CASE WHEN decision = 'MULTI_CONCEPT_MAPPED' THEN 'COMPONENT_OF' ELSE relationship END AS relation FROM p)
"""


def _family(rule: Callable[[], Column], names: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = validated(spark, d)
        found = F.filter("findings", lambda f: f["code"].isin(*names))
        return audit.spread(rows, found, "f", "sau_id").select("sau_id", "f.code", "f.severity", F.coalesce("f.concept_id", F.lit("")).alias("concept_id"))

    return run


def _case(code: str, test: str, cid: str = "''") -> str:
    return f"SELECT sau_id, '{code}' AS code, 'error' AS severity, {cid} AS concept_id FROM q WHERE {test}"


STRUCTURE = {
    "SAU_ID_MISMATCH": ("sau_id <> package_sau_id", "''"), "INVALID_MAPPED_CARDINALITY": ("decision = 'MAPPED' AND len(ids) <> 1", "''"), "INVALID_MULTI_CONCEPT_CARDINALITY": ("decision = 'MULTI_CONCEPT_MAPPED' AND len(ids) < 2", "''"),
    "UNEXPECTED_SELECTED_CONCEPTS": ("hollow", "''"), "MISSING_SOURCE_LEVEL_CONCEPT": ("NOT hollow AND no_source", "''"), "MISSING_ANALYSIS_LEVEL_CONCEPT": ("decision = 'MAPPED' AND no_analysis AND NOT unresolved", "''"),
    "UNEXPECTED_CONCEPT_FIELDS": ("hollow AND NOT (no_source AND no_analysis)", "''"), "DUPLICATE_SELECTED_CONCEPT": ("len(list_distinct(ids)) < len(ids)", "''"), "ANALYSIS_CONCEPT_NOT_SELECTED": ("NOT no_analysis AND NOT list_contains(ids, analysis_id)", "analysis_id"),
    "ANALYSIS_SELECTION_MISMATCH": ("decision = 'MAPPED' AND len(ids) = 1 AND NOT no_analysis AND ids[1] <> analysis_id", "analysis_id"),
    "EXACT_CONCEPT_ID_MISMATCH": ("relationship = 'EXACT' AND source_id <> analysis_id", "analysis_id"), "BROADER_CONCEPT_ID_MISMATCH": ("relationship = 'TARGET_BROADER_THAN_SOURCE' AND source_id = analysis_id", "analysis_id"),
}
QUERIES["findings_structure"] = _family(validate.structure, tuple(STRUCTURE))
ORACLES["findings_structure"] = sql("WITH " + _PROPOSALS + " UNION ALL ".join(_case(c, t, i) for c, (t, i) in STRUCTURE.items()), "v_proposals")

QUERIES["findings_policy"] = _family(validate.structure, ("RELATION_NOT_PERMITTED",))
_PERMITTED = ", ".join(f"'{x}'" for x in P.relation_types)
_POLICY = f"""SELECT sau_id, 'RELATION_NOT_PERMITTED' AS code, 'error' AS severity, '' AS concept_id FROM q WHERE relationship NOT IN ({_PERMITTED})
UNION ALL SELECT DISTINCT sau_id, 'RELATION_NOT_PERMITTED', 'error', id FROM (SELECT sau_id, unnest(ids) AS id FROM q WHERE relation NOT IN ({_PERMITTED}))
UNION ALL SELECT sau_id, 'RELATION_NOT_PERMITTED', 'error', analysis_id FROM q WHERE NOT no_analysis AND relation NOT IN ({_PERMITTED})"""
ORACLES["findings_policy"] = sql("WITH " + _PROPOSALS + _POLICY, "v_proposals")

COHERENCE = {
    "EMPTY_OUTCOME_RELATION_MISMATCH": ("decision IN ('NO_VALID_MAPPING', 'ABSTAINED') AND relationship <> 'UNSUPPORTED_MAPPING'", "''"), "INSUFFICIENT_CONTEXT_RELATION_MISMATCH": ("decision = 'INSUFFICIENT_CONTEXT' AND relationship <> 'INSUFFICIENT_CONTEXT'", "''"),
    "MULTI_CONCEPT_RELATION_MISMATCH": ("decision = 'MULTI_CONCEPT_MAPPED' AND relationship <> 'MULTIPLE_COMPONENTS_REQUIRED'", "''"), "UNEXPECTED_MULTI_ANALYSIS_CONCEPT": ("decision = 'MULTI_CONCEPT_MAPPED' AND NOT no_analysis", "analysis_id"),
    "MAPPED_RELATION_MISMATCH": ("decision = 'MAPPED' AND relationship IN ('UNSUPPORTED_MAPPING', 'INSUFFICIENT_CONTEXT', 'MULTIPLE_COMPONENTS_REQUIRED', 'COMPONENT_OF')", "''"),
    "SOURCE_RELATION_MISMATCH": ("decision = 'MAPPED' AND NOT no_source AND unresolved AND relationship <> 'EXACT'", "source_id"),
    "COMPONENT_RELATION_MISMATCH": ("false", "''"), "SELECTED_RELATION_MISMATCH": ("false", "''"), "ANALYSIS_RELATION_MISMATCH": ("false", "''"),
}
QUERIES["findings_coherence"] = _family(validate.relation_coherence, tuple(COHERENCE))
ORACLES["findings_coherence"] = sql("WITH " + _PROPOSALS + " UNION ALL ".join(_case(c, t, i) for c, (t, i) in COHERENCE.items()), "v_proposals")

#: Each place of a proposal that names a concept, with what the product's evidence says of it.
_OCCURRENCES = """
x AS (SELECT e.subject_id AS own, e.object_id AS id, min(e.object_label) AS label, min(e.object_class) AS class, CASE WHEN bool_or(c.status = 'active' AND e.predicate IN ('has_ingredient', 'has_precise_ingredient')) THEN 'active' ELSE 'unknown' END AS status, false AS direct
    FROM v_edges e JOIN v_concepts c ON c.concept_id = e.subject_id WHERE e.predicate <> 'may_treat' GROUP BY 1, 2
  UNION ALL SELECT concept_id, concept_id, preferred_label, concept_class, status, true FROM v_concepts),
o AS (SELECT sau_id, own, 'selected' AS field, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS place, ids[1] AS first_id, claimed_label, claimed_class, claimed_status FROM q WHERE selected_ids <> ''
  UNION ALL SELECT sau_id, own, 'analysis', analysis_id, NULL, ids[1], claimed_label, claimed_class, claimed_status FROM q WHERE NOT no_analysis
  UNION ALL SELECT q.sau_id, own, 'source', source_id, NULL, NULL, c.preferred_label, c.concept_class, c.status FROM q JOIN v_concepts c ON c.concept_id = own WHERE NOT no_source),
k AS (SELECT o.sau_id, o.field, o.id, o.place, o.claimed_class, o.claimed_status AS claim, CASE WHEN field = 'source' OR o.id = first_id THEN claimed_label ELSE regexp_replace(o.id, '^I_', '') END AS claimed_label, field <> 'source' AS final, x.id IS NOT NULL AS have, x.label, x.class, x.status, x.direct
  FROM o LEFT JOIN x ON x.own = o.own AND x.id = o.id)
"""
_ON_EVIDENCE = """SELECT sau_id, code, severity, id AS concept_id FROM (
  SELECT DISTINCT sau_id, 'UNRETRIEVED_IDENTIFIER' AS code, 'error' AS severity, id, field FROM k WHERE NOT have
  UNION ALL SELECT DISTINCT sau_id, 'STATUS_FROM_RELEASE_EVIDENCE', 'info', id, '' FROM k WHERE have AND final AND status = 'active' AND NOT direct
  UNION ALL SELECT DISTINCT sau_id, 'CONCEPT_LABEL_MISMATCH', 'error', id, field FROM k WHERE have AND lower(claimed_label) <> lower(label)
  UNION ALL SELECT DISTINCT sau_id, 'CONCEPT_CLASS_MISMATCH', 'error', id, field FROM k WHERE have AND lower(claimed_class) <> lower(class)
  UNION ALL SELECT DISTINCT sau_id, 'UNSUPPORTED_STATUS_CLAIM', 'error', id, field FROM k WHERE have AND claim <> 'unknown' AND status = 'unknown'
  UNION ALL SELECT DISTINCT sau_id, 'CONCEPT_STATUS_MISMATCH', 'error', id, field FROM k WHERE have AND claim <> 'unknown' AND status <> 'unknown' AND claim <> status
  UNION ALL SELECT DISTINCT sau_id, 'STATUS_NOT_VERIFIED', 'warning', id, '' FROM k WHERE have AND final AND status = 'unknown'
  UNION ALL SELECT DISTINCT sau_id, 'INACTIVE_CONCEPT', 'error', id, '' FROM k WHERE have AND final AND status NOT IN ('unknown', 'active'))"""
_EVIDENCE_CODES = ("UNRETRIEVED_IDENTIFIER", "STATUS_FROM_RELEASE_EVIDENCE", "CONCEPT_LABEL_MISMATCH", "WRONG_VOCABULARY", "CONCEPT_VOCABULARY_MISMATCH", "UNSUPPORTED_STATUS_CLAIM", "CONCEPT_STATUS_MISMATCH", "STATUS_NOT_VERIFIED", "INACTIVE_CONCEPT", "CONCEPT_CLASS_MISMATCH")
QUERIES["findings_evidence"] = _family(validate.structure, _EVIDENCE_CODES)
ORACLES["findings_evidence"] = sql("WITH " + _PROPOSALS + "," + _OCCURRENCES + _ON_EVIDENCE, "v_proposals", "v_edges", "v_concepts")
QUERIES["findings_roles"] = _family(validate.structure, ("SOURCE_CONCEPT_NOT_DIRECTLY_RETRIEVED", "MULTI_COMPONENT_SET_MISMATCH", "TARGET_NOT_REACHABLE_FROM_SOURCE", "INVALID_GRANULARITY_TARGET", "HISTORICAL_SOURCE_CONCEPT"))
_SOURCES = """
e AS (SELECT subject_id, list_sort(list(DISTINCT object_id)) AS targets FROM v_edges WHERE predicate = 'has_ingredient' GROUP BY 1),
r AS (SELECT q.*, CASE WHEN source_id = own THEN coalesce(e.targets, []) ELSE [] END AS targets, coalesce(e.targets, []) AS reach, coalesce(source_id, own) = own AS from_own, c.status AS own_status, c.preferred_label AS own_label FROM q LEFT JOIN e ON e.subject_id = own JOIN v_concepts c ON c.concept_id = own)
"""
_ON_ROLES = """SELECT sau_id, 'SOURCE_CONCEPT_NOT_DIRECTLY_RETRIEVED' AS code, 'error' AS severity, source_id AS concept_id FROM r WHERE source_id <> own
UNION ALL SELECT sau_id, 'MULTI_COMPONENT_SET_MISMATCH', 'error', coalesce(source_id, '') FROM r WHERE NOT unresolved AND decision = 'MULTI_CONCEPT_MAPPED' AND list_sort(list_distinct(ids)) <> targets
UNION ALL SELECT DISTINCT sau_id, 'TARGET_NOT_REACHABLE_FROM_SOURCE', 'error', id FROM (SELECT *, unnest(ids) AS id FROM r WHERE NOT unresolved AND relationship IN ('TARGET_BROADER_THAN_SOURCE', 'MULTIPLE_COMPONENTS_REQUIRED')) WHERE NOT list_contains(targets, id)
UNION ALL SELECT DISTINCT sau_id, 'INVALID_GRANULARITY_TARGET', 'error', id FROM (SELECT *, unnest(ids) AS id FROM r WHERE NOT unresolved) WHERE list_contains(reach, id) AND NOT from_own
UNION ALL SELECT sau_id, 'HISTORICAL_SOURCE_CONCEPT', 'warning', source_id FROM r WHERE source_id = own AND own_status <> 'active'"""
ORACLES["findings_roles"] = sql("WITH " + _PROPOSALS + "," + _SOURCES + _ON_ROLES, "v_proposals", "v_edges", "v_concepts")
_ON_DOMAIN = "SELECT sau_id, 'COMBINATION_INGREDIENT_DROPPED' AS code, 'error' AS severity, source_id AS concept_id FROM r WHERE NOT hollow AND NOT unresolved AND len(targets) > 1 AND len(list_filter(targets, lambda t: NOT list_contains(ids, t))) > 0"
QUERIES["findings_domain"] = _family(validate.structure, ("COMBINATION_INGREDIENT_DROPPED", "SALT_ACTIVE_MOIETY_CONFLATION", "PRESERVED_ATTRIBUTES_MISMATCH"))
ORACLES["findings_domain"] = sql("WITH " + _PROPOSALS + "," + _SOURCES + _ON_DOMAIN, "v_proposals", "v_edges", "v_concepts")

#: All findings, the verdict and the route of each proposal.
_VERDICTS = "WITH " + _PROPOSALS + "," + _OCCURRENCES + "," + _SOURCES + """,
f AS MATERIALIZED (""" + " UNION ALL ".join([*(_case(c, t, i) for c, (t, i) in (STRUCTURE | COHERENCE).items()), _POLICY, f"({_ON_EVIDENCE})", f"({_ON_ROLES})", _ON_DOMAIN]) + """),
n AS (SELECT sau_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) AS findings, string_agg(DISTINCT code, '|' ORDER BY code) AS codes,
  list('REJECTED: ' || code) FILTER (severity = 'error') AS refused, list('WARNING: ' || code) FILTER (severity = 'warning') AS warned FROM f GROUP BY sau_id),
s AS (SELECT sau_id, coalesce(bool_and(have AND status = 'active'), false) AS active, array_to_string(list(label ORDER BY place), '|') AS labels, array_to_string(list(status ORDER BY place), '|') AS statuses FROM k WHERE field = 'selected' GROUP BY sau_id),
v AS MATERIALIZED (SELECT r.*, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(findings, 0) AS findings, coalesce(codes, '') AS codes, refused, coalesce(warned, []) AS warned, coalesce(s.active, false) AS active, (source_id = own) IS TRUE AS named,
  CASE WHEN errors > 0 THEN 'REJECTED' WHEN asked THEN 'HUMAN_REVIEW_REQUIRED' WHEN warnings > 0 THEN 'VALID_WITH_WARNING' WHEN loss_kinds <> '' THEN 'VALID_WITH_SEMANTIC_LOSS' ELSE 'VALID' END AS verdict FROM r LEFT JOIN n USING (sau_id) LEFT JOIN s USING (sau_id)),
w AS MATERIALIZED (SELECT *, list_concat(list_filter([CASE WHEN asked THEN 'REVIEW_ASKED' END, CASE WHEN NOT active THEN 'NOT_CURRENT' END, CASE WHEN relationship NOT IN ('EXACT', 'TARGET_BROADER_THAN_SOURCE', 'MULTIPLE_COMPONENTS_REQUIRED') THEN 'RELATION' END], lambda x: x IS NOT NULL), warned) AS review,
  CASE WHEN named THEN 'NAME_EQUAL' WHEN relationship = 'TARGET_BROADER_THAN_SOURCE' AND loss_kinds <> '' THEN 'LOSS_TOLD' WHEN relationship = 'MULTIPLE_COMPONENTS_REQUIRED' THEN 'COMPONENTS' WHEN relationship = 'EXACT' THEN 'EXACT_CLEAN' END AS accepted FROM v),
t AS MATERIALIZED (SELECT *, CASE WHEN verdict = 'REJECTED' THEN refused WHEN decision IN ('NO_VALID_MAPPING', 'ABSTAINED') THEN ['NONE_CHOSEN'] WHEN decision = 'INSUFFICIENT_CONTEXT' THEN ['CONTEXT'] WHEN len(review) > 0 THEN review WHEN accepted IS NOT NULL THEN [accepted]
    WHEN relationship = 'TARGET_BROADER_THAN_SOURCE' THEN ['LOSS_UNTOLD'] ELSE ['NO_RULE'] END AS reasons,
  CASE WHEN verdict = 'REJECTED' THEN 'HUMAN_REVIEW' WHEN decision IN ('NO_VALID_MAPPING', 'ABSTAINED') THEN 'ABSTAIN' WHEN decision = 'INSUFFICIENT_CONTEXT' OR len(review) > 0 OR accepted IS NULL THEN 'HUMAN_REVIEW' ELSE 'AUTO_ACCEPT' END AS routing_status FROM w)
"""


def _verdict_sql(body: str) -> str:
    return sql(_VERDICTS + body, "v_proposals", "v_edges", "v_concepts")


@query(_verdict_sql("SELECT sau_id, verdict, codes FROM t"))
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return validated(spark, d).select("sau_id", "verdict", F.array_join(F.array_sort(F.array_distinct("findings.code")), "|").alias("codes"))


@query(_verdict_sql("SELECT code, severity, count(*) AS n FROM f GROUP BY 1, 2"))
def finding_profile(spark: SparkSession, d: str) -> DataFrame:
    return audit.finding_profile(validated(spark, d))


def _code(reason: Column) -> Column:
    """A reason without its remark: refusals and warnings are codes as a whole."""
    return F.when(reason.rlike("^(REJECTED|WARNING): "), reason).otherwise(F.split(reason, ": ")[0])


def routed(spark: SparkSession, d: str) -> DataFrame:
    return route.route(route.routing_features(validated(spark, d)), P)


@query(_verdict_sql("SELECT sau_id, verdict, routing_status, array_to_string(list_sort(reasons), '; ') AS reasons FROM t"))
def routing(spark: SparkSession, d: str) -> DataFrame:
    return routed(spark, d).select("sau_id", "verdict", "routing_status", F.array_join(F.array_sort(F.transform("reasons", _code)), "; ").alias("reasons"))


@query(sql("WITH " + _PROPOSALS + """
SELECT sau_id, CASE WHEN coalesce(source_id, '') <> own THEN 'selection_not_directly_retrieved' WHEN c.status <> 'active' THEN 'historical_or_non_primary_source_concept' END AS difficulty FROM q JOIN v_concepts c ON c.concept_id = own
""", "v_proposals", "v_concepts"))  # fmt: skip
def difficulty(spark: SparkSession, d: str) -> DataFrame:
    return routed(spark, d).select("sau_id", F.col("features.known_difficult_pattern").alias("difficulty"))


@query(_verdict_sql("SELECT sau_id, CAST(10 * errors + warnings AS INTEGER) AS priority, own || ' channels: normalized_lookup; best score 100.0' AS considered, CAST(findings AS INTEGER) AS messages FROM t WHERE routing_status = 'HUMAN_REVIEW'"))
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return route.review_queue(routed(spark, d), align.store(spark)).select("sau_id", "priority", F.array_join(F.transform("considered", lambda c: F.concat_ws(" ", c["concept_id"], c["note"])), "; ").alias("considered"), F.size("messages").alias("messages"))


@query(_verdict_sql("""SELECT t.sau_id, CASE WHEN verdict = 'REJECTED' THEN 'ABSTAINED' ELSE decision END AS decision, CASE WHEN verdict = 'REJECTED' THEN 'UNSUPPORTED_MAPPING' ELSE relationship END AS relationship,
  CASE WHEN verdict = 'REJECTED' THEN '' ELSE coalesce(s.labels, '') END AS labels, CASE WHEN verdict = 'REJECTED' THEN '' ELSE coalesce(s.statuses, '') END AS statuses FROM t LEFT JOIN s ON s.sau_id = t.sau_id"""))
def canonical_decisions(spark: SparkSession, d: str) -> DataFrame:
    return route.decide(routed(spark, d)).select("sau_id", "decision", "relationship", F.array_join("selected.label", "|").alias("labels"), F.array_join("selected.status", "|").alias("statuses"))


@query("SELECT '' AS code, 0 AS n WHERE false")
def artifact_audit(spark: SparkSession, d: str) -> DataFrame:
    """The alignment's own decisions contradict themselves nowhere."""
    from .queries_align import exact_decisions

    found = audit.audit_artifacts(exact_decisions(spark, d).where("status = 'success'")).select(F.explode("codes").alias("code"))
    return found.groupBy("code").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(_verdict_sql("""
, a AS (SELECT *, CAST(substr(sau_id, 5) AS BIGINT) AS k, verdict = 'REJECTED' AS rejected, array_to_string(list_sort(list_distinct(ids)), '|') AS chosen FROM t),
b AS (SELECT *, CASE WHEN rejected AND k % 7 = 0 THEN 'MAPPED' WHEN rejected THEN 'ABSTAINED' ELSE decision END AS d, CASE WHEN rejected AND k % 11 = 0 THEN 'AUTO_ACCEPT' ELSE routing_status END AS r, k % 3 = 0 AS cleared FROM a)
SELECT sau_id, unnest(list_filter([CASE WHEN k % 19 = 0 THEN 'BAD_SAU_ID' END, CASE WHEN k % 23 = 0 THEN 'BAD_MAPPING_KEY' END, CASE WHEN rejected AND cleared THEN 'REJECTED_WITHOUT_ERROR' END, CASE WHEN rejected AND d <> 'ABSTAINED' THEN 'REJECTED_NOT_ABSTAINED' END,
  CASE WHEN rejected AND r <> 'HUMAN_REVIEW' THEN 'REJECTED_NOT_REVIEWED' END, CASE WHEN rejected AND k % 13 = 0 THEN 'REJECTED_WITH_LOSSES' END, CASE WHEN rejected AND d = 'MAPPED' THEN 'MAPPED_CARDINALITY' END, CASE WHEN k % 5 = 0 THEN 'NO_REASON' END,
  CASE WHEN rejected AND r = 'AUTO_ACCEPT' AND NOT cleared THEN 'ACCEPTED_WITH_FINDINGS' END, CASE WHEN rejected AND r = 'AUTO_ACCEPT' AND asked THEN 'ACCEPTED_AGAINST_REVIEW' END, CASE WHEN rejected AND r = 'AUTO_ACCEPT' AND d = 'ABSTAINED' THEN 'ACCEPTED_EMPTY' END,
  CASE WHEN verdict = 'VALID_WITH_SEMANTIC_LOSS' AND k % 17 = 0 THEN 'LOSS_VERDICT_WITHOUT_LOSS' END, CASE WHEN cleared AND errors > 0 THEN 'FEATURE_ERRORS' END, CASE WHEN cleared AND warnings > 0 THEN 'FEATURE_WARNINGS' END,
  CASE WHEN NOT rejected AND k % 29 = 0 AND selected_ids <> '' THEN 'LABEL_NOT_CANONICAL' END], lambda x: x IS NOT NULL)) AS code FROM b
"""))
def decision_audit(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of the proposals, each field spoilt in another share of them."""
    put = align.store(spark)
    rows = put(route.decide(routed(spark, d)), "routed")
    k, bad = F.substring("sau_id", 5, 20).cast("long"), F.col("verdict") == "REJECTED"
    hit = lambda n: k % n == 0
    hexed = F.upper(F.md5(F.col("sau_id").cast("binary")))
    label = lambda c: c.withField("label", F.lit("wrong"))
    loss = F.array(F.struct(F.lit("route").alias("kind"), F.lit("").alias("description"), F.lit(None).cast("string").alias("source_value")))
    rows = rows.withColumns({
        "known_as": F.col("sau_id"), "sau_id": F.when(hit(19), F.lit("SAU-1")).otherwise(F.concat(F.lit("SAU-"), hexed)), "mapping_key": F.when(hit(23), F.lit("x")).otherwise(F.concat(F.lit("MAP-"), hexed)),
        "findings": F.when(hit(3), F.array().cast(rows.schema["findings"].dataType)).otherwise(F.col("findings")), "decision": F.when(bad & hit(7), F.lit("MAPPED")).otherwise(F.col("decision")),
        "routing_status": F.when(bad & hit(11), F.lit("AUTO_ACCEPT")).otherwise(F.col("routing_status")), "losses": F.when(bad & hit(13), loss).when((F.col("verdict") == "VALID_WITH_SEMANTIC_LOSS") & hit(17), F.array().cast(rows.schema["losses"].dataType)).otherwise(F.col("losses")),
        "reasons": F.when(hit(5), F.array().cast("array<string>")).otherwise(F.col("reasons")), "selected": F.when(~bad & hit(29), F.transform("selected", label)).otherwise(F.col("selected")),
    })
    found = audit.audit_artifacts(put(rows, "spoilt"), ["known_as"])
    return found.select(F.col("known_as").alias("sau_id"), F.explode("codes").alias("code"))


def gold(spark: SparkSession, d: str) -> DataFrame:
    g = view(spark, d, "v_gold")
    context = F.when(F.col("ctx_route").isNotNull(), F.create_map(F.lit("route"), F.col("ctx_route"))).otherwise(F.create_map().cast("map<string,string>"))
    return g.select("case_id", "source_value", "category", _list("expected_ids").alias("expected_ids"), context.alias("context"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "v_predictions")
    case = evaluate.case_id(F.col("explicit_case_id"), F.col("record_id"), F.col("sau_id"))
    return p.select(case.alias("case_id"), "source_value", _list("selected_ids").alias("selected_ids"), "routing_status", F.create_map(F.lit("route"), F.col("ctx_route")).alias("context"), "mapping_key")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.pair_cases(gold(spark, d), predictions(spark, d))


_PAIRS = """
g AS (SELECT *, list_sort(list_filter(string_split(expected_ids, '|'), lambda x: x <> '')) AS want FROM v_gold),
p AS (SELECT *, coalesce(explicit_case_id, nullif(trim(record_id), ''), sau_id) AS pid, list_sort(list_filter(string_split(selected_ids, '|'), lambda x: x <> '')) AS got FROM v_predictions)
"""


@query(sql("WITH " + _PAIRS + "SELECT coalesce(g.case_id, p.pid) AS case_id, CASE WHEN p.pid IS NULL THEN 'missing' WHEN g.case_id IS NULL THEN 'unexpected' ELSE 'shared' END AS side FROM g FULL JOIN p ON g.case_id = p.pid", "v_gold", "v_predictions"))
def eval_pairing(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("case_id", "side")


@query(sql("SELECT mapping_key, count(*) AS n FROM v_predictions GROUP BY 1 HAVING count(*) > 1", "v_predictions"))
def eval_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.duplicate_ids(view(spark, d, "v_predictions"), "mapping_key")


_EVALUATED = "WITH " + _PAIRS + """,
r AS (SELECT CASE WHEN coalesce(category, '') = '' THEN 'uncategorized' ELSE category END AS category, p.pid IS NOT NULL AS there, coalesce(want = got, false) AS ok, coalesce(routing_status, '') AS s, g.ctx_route IS NOT NULL AS ctx FROM g LEFT JOIN p ON g.case_id = p.pid),
m AS (SELECT CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, CAST(grouping(category) AS BIGINT) AS level, count(*) AS gold_cases, count(*) FILTER (there) AS evaluated, count(*) FILTER (NOT there) AS missing, count(*) FILTER (s = 'AUTO_ACCEPT') AS accepted,
  count(*) FILTER (s = 'HUMAN_REVIEW') AS reviewed, count(*) FILTER (s = 'ABSTAIN') AS abstained, count(*) FILTER (ok) AS correct, count(*) FILTER (ok AND s = 'AUTO_ACCEPT') AS accepted_correct, count(*) FILTER (there AND ctx) AS context_verified FROM r GROUP BY GROUPING SETS ((category), ())),
o AS (SELECT *, round(accepted / gold_cases, 4) AS coverage, round(correct / gold_cases, 4) AS accuracy, CASE WHEN accepted > 0 THEN round(accepted_correct / accepted, 4) ELSE 0.0 END AS "precision" FROM m)
"""


@query(sql(_EVALUATED + "SELECT * FROM o", "v_gold", "v_predictions"))
def eval_categories(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluate(pairs(spark, d)).withColumn("level", F.col("level").cast("long"))


@query(sql(_EVALUATED + 'SELECT gold_cases, accepted, accepted_correct, coverage, "precision" FROM o WHERE level = 1', "v_gold", "v_predictions"))
def selective_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.selective_accuracy(pairs(spark, d))


@query(sql("WITH " + _PAIRS + "SELECT case_id, p.mapping_key IS NULL AS evidence_missing, CASE WHEN p.ctx_route <> g.ctx_route THEN 'route' ELSE '' END AS fields FROM g JOIN p ON g.case_id = p.pid WHERE g.ctx_route IS NOT NULL AND (p.mapping_key IS NULL OR p.ctx_route <> g.ctx_route)", "v_gold", "v_predictions"))
def eval_context(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.context_mismatches(pairs(spark, d)).select("case_id", "evidence_missing", F.array_join("fields", "|").alias("fields"))


@query(sql("WITH " + _PAIRS + "SELECT case_id, g.source_value AS gold_value, p.source_value AS predicted_value FROM g JOIN p ON g.case_id = p.pid WHERE p.source_value <> g.source_value", "v_gold", "v_predictions"))
def eval_values(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.value_mismatches(pairs(spark, d))


@query(sql("WITH " + _PAIRS + "SELECT count(*) FILTER (g.case_id = p.pid) AS shared, count(*) FILTER (p.pid IS NULL) AS missing, count(*) FILTER (g.case_id IS NULL) AS unexpected, count(*) FILTER (p.pid IS NULL OR g.case_id IS NULL) = 0 AS complete FROM g FULL JOIN p ON g.case_id = p.pid", "v_gold", "v_predictions"))
def eval_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.report(pairs(spark, d))


_RANKED = """
WITH g AS (SELECT case_id, source_value, CAST(substr(case_id, 2) AS BIGINT) AS k, list_filter(string_split(expected_ids, '|'), lambda x: x <> '') AS want FROM v_gold),
e AS (SELECT subject_id, list(object_id) AS objects FROM v_edges WHERE predicate <> 'may_treat' GROUP BY 1),
c AS (SELECT g.case_id, j + 1 AS place, list_has_any(list_append(coalesce(e.objects, []), v.concept_id), want) AS hit FROM g, LATERAL (SELECT unnest(range(CASE WHEN k % 9 = 0 THEN 0 ELSE k % 8 END)) AS j) x
  JOIN v_concepts v ON v.concept_id = 'P' || CAST(k + j AS VARCHAR) LEFT JOIN e ON e.subject_id = v.concept_id),
r AS (SELECT g.*, len(want) > 0 AS positive, f.place, coalesce(f.n, 0) AS n FROM g LEFT JOIN (SELECT case_id, min(place) FILTER (hit) AS place, count(*) AS n FROM c GROUP BY 1) f USING (case_id))
"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Up to seven candidates for each case, the products from its own number on; every ninth case has none."""
    from .queries_align import _selves

    cases = gold(spark, d).select("case_id", F.substring("case_id", 2, 20).cast("long").alias("k")).where("k % 9 <> 0 and k % 8 > 0").withColumn("j", F.explode(F.expr("sequence(0, cast(k % 8 as int) - 1)")))
    packed = enrich.packages(_selves(spark, d), P).select("unit_key", F.col("candidates")[0].alias("one"))
    own = cases.join(packed, F.concat(F.lit("P"), (F.col("k") + F.col("j")).cast("string")) == F.col("unit_key"))
    return own.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("j", F.struct("one.candidate_id", "one.edges").alias("one")))).alias("all")).select("case_id", F.col("all.one").alias("candidates"))


@query(sql(_RANKED + "SELECT count(*) FILTER (positive) AS positives, count(*) FILTER (NOT positive) AS negatives, " + ", ".join(f"round(count(*) FILTER (positive AND place <= {k}) / count(*) FILTER (positive), 4) AS recall_at_{k}" for k in (1, 5, 10)) + ", round(count(*) FILTER (NOT positive AND n = 0) / count(*) FILTER (NOT positive), 4) AS rejection_specificity FROM r", "v_gold", "v_edges", "v_concepts"))
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.recall_at_k(gold(spark, d), _candidates(spark, d))


@query(sql(_RANKED + "SELECT case_id, source_value FROM r WHERE positive AND place IS NULL", "v_gold", "v_edges", "v_concepts"))
def missed_values(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.missed_values(gold(spark, d), _candidates(spark, d))


@query(sql("WITH r AS (SELECT *, row_number() OVER (PARTITION BY unit_key, candidate_id ORDER BY hit_rank, hit_order) AS k FROM v_hits) SELECT unit_key, candidate_id, channel, hit_rank, hit_order FROM r WHERE k = 1", "v_hits"))
def first_hits(spark: SparkSession, d: str) -> DataFrame:
    return fuse.first_by(view(spark, d, "v_hits"), ["unit_key", "candidate_id"], ["hit_rank", "hit_order"]).select("unit_key", "candidate_id", "channel", "hit_rank", "hit_order")


@query("SELECT doc_id, left(CASE WHEN coalesce(w, '') <> '' THEN replace(text, w, '<redacted>') ELSE text END, 500) AS message FROM (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN NULL ELSE split_part(text, ' ', 2) END AS w FROM documents)")
def redacted_messages(spark: SparkSession, d: str) -> DataFrame:
    """Texts as error messages that tell their second word."""
    rows = spark.read.parquet(f"{d}/documents.parquet").withColumn("w", F.when(F.col("doc_id") % 5 == 0, F.lit("")).when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.split_part("text", F.lit(" "), F.lit(2))))
    return rows.select("doc_id", text.redact(F.col("text"), F.col("w")).alias("message"))


@query(sql("""
SELECT explicit_case_id AS case_id, selected_ids AS old_ids, CASE WHEN hash_odd THEN '' ELSE selected_ids END AS new_ids FROM (SELECT explicit_case_id, array_to_string(list_sort(list_distinct(list_filter(string_split(selected_ids, '|'), lambda x: x <> ''))), '|') AS selected_ids, CAST(substr(sau_id, 5) AS BIGINT) % 12 = 0 AS hash_odd FROM v_predictions WHERE explicit_case_id IS NOT NULL) WHERE hash_odd AND selected_ids <> ''
""", "v_predictions"))  # fmt: skip
def release_drift(spark: SparkSession, d: str) -> DataFrame:
    old = view(spark, d, "v_predictions").where("explicit_case_id is not null").select(F.col("explicit_case_id").alias("case_id"), _list("selected_ids").alias("selected_ids"), "sau_id")
    new = old.withColumn("selected_ids", F.when(F.substring("sau_id", 5, 20).cast("long") % 12 == 0, F.array().cast("array<string>")).otherwise(F.col("selected_ids")))
    return evaluate.compare_runs(old, new).select("case_id", F.array_join("old_ids", "|").alias("old_ids"), F.array_join("new_ids", "|").alias("new_ids"))


_MERGED = ("provider_name", "provider_version", "terminology_release", "api_version", "mode")


@query(sql("SELECT resource_name, CAST(sum(cache_hits) AS BIGINT) AS cache_hits, CAST(sum(network_calls) AS BIGINT) AS network_calls, max(accessed_at) AS accessed_at, array_to_string(list_filter([" + ", ".join(f"CASE WHEN count(DISTINCT coalesce({c}, '-')) > 1 THEN '{c}' END" for c in _MERGED) + "], lambda x: x IS NOT NULL), '|') AS conflicts FROM v_usage GROUP BY 1", "v_usage"))
def usage_merge(spark: SparkSession, d: str) -> DataFrame:
    return audit.merge_usage(view(spark, d, "v_usage"), _MERGED).withColumn("conflicts", F.array_join("conflicts", "|"))


@query(sql("""
WITH m AS (SELECT concat(CAST(l_orderkey AS VARCHAR), '|', CAST(l_linenumber AS VARCHAR)) AS record_id, l_orderkey AS k FROM v_mentions),
c AS (SELECT record_id, array_to_string(list_filter([CASE WHEN k % 17 = 0 THEN 'NORMAL_FORM_CHANGED' END, CASE WHEN k % 17 = 0 OR k % 23 = 0 THEN 'MAPPING_KEY_MISMATCH' END, CASE WHEN k % 17 = 0 OR k % 19 = 0 OR k % 29 = 0 THEN 'SAU_ID_MISMATCH' END,
  CASE WHEN k % 17 = 0 OR k % 19 = 0 THEN 'CONTENT_CHANGED' END], lambda x: x IS NOT NULL), '|') AS codes FROM m)
SELECT record_id, codes FROM c WHERE codes <> ''
""", "v_mentions"))  # fmt: skip
def rederived_audit(spark: SparkSession, d: str) -> DataFrame:
    """Units of all mentions, of which some have another value, role or id of the right form than they were stored with."""
    from .queries_align import mention_units

    own, content = mention_units(spark, d), ("raw_value", "envelope", "attributes")
    rows = align.store(spark)(own.withColumn("content_sha256", audit.content_digest(*content)), "units")
    k = F.element_at(F.split("record_id", r"\\?\|"), 1).cast("long")
    hexed = F.upper(F.md5(F.col("record_id").cast("binary")))
    spoilt = rows.withColumn("k", k).withColumns({
        "raw_value": F.when(F.col("k") % 17 == 0, F.concat("raw_value", F.lit(" x"))).otherwise(F.col("raw_value")), "envelope": F.when(F.col("k") % 19 == 0, F.col("envelope").withField("drug_role", F.lit("Q"))).otherwise(F.col("envelope")),
        "mapping_key": F.when(F.col("k") % 23 == 0, F.concat(F.lit("MAP-"), hexed)).otherwise(F.col("mapping_key")), "sau_id": F.when(F.col("k") % 29 == 0, F.concat(F.lit("SAU-"), hexed)).otherwise(F.col("sau_id")),
    })
    return audit.rederived(spoilt, P, content, ["record_id"]).select("record_id", F.array_join("codes", "|").alias("codes"))


@query("""
SELECT c_custkey AS request, 'structured_record' AS source_type, CAST(c_custkey AS VARCHAR) AS id, c_name AS value, 'segment=' || c_mktsegment AS context FROM customer
UNION ALL SELECT c_custkey, 'structured_batch', CAST(i AS VARCHAR), CASE i WHEN 1 THEN c_name ELSE c_mktsegment END, NULL FROM customer, (VALUES (1), (2)) AS v(i)
UNION ALL SELECT c_custkey, 'structured_field', NULL, c_name, NULL FROM customer
""")
def adapted_requests(spark: SparkSession, d: str) -> DataFrame:
    """Customers as lines of three shapes, each read by its adapter."""
    rows = spark.read.parquet(f"{d}/customer.parquet").withColumn("request", F.col("c_custkey"))
    told = lambda df, *c: df.select("request", *[x.alias(n) for n, x in zip(("source_type", "id", "value", "context"), c, strict=True)])
    none = F.lit(None).cast("string")
    records = adapters.adapt(rows.withColumn("line", F.concat(F.lit("segment="), "c_mktsegment", F.lit(";value="), "c_name", F.lit(";id="), F.col("c_custkey").cast("string"))), "structured_record", "line", ["request"])
    lists = adapters.adapt(rows.withColumn("line", F.concat_ws("|", "c_name", "c_mktsegment")), "structured_batch", "line", ["request"])
    fields = adapters.adapt(rows, "structured_field", "c_name", ["request"])
    return told(records, F.lit("structured_record"), F.col("id"), F.col("value"), F.col("context")).unionByName(told(lists, F.lit("structured_batch"), F.col("batch_index"), F.col("value"), none)).unionByName(told(fields, F.lit("structured_field"), none, F.col("value"), none))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, length(text) AS n_chars, sha256(text) AS text_sha256 FROM (SELECT doc_id, lang, nullif(text, '') AS text FROM documents)")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts with quotes, separators and line breaks, written as CSV and read back in splits."""
    path = f"{align.shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text")
    docs.write.csv(path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = read_csv(spark, path, put=align.store(spark))
    return rows.select("doc_id", "lang", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


_REMAPS = """
WITH RECURSIVE edges AS (SELECT concept_id AS a, target AS b FROM v_remaps WHERE target IS NOT NULL UNION SELECT concept_id, other FROM v_remaps WHERE other IS NOT NULL),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
loops AS (SELECT DISTINCT r.a FROM reach r JOIN reach o ON o.a = r.b AND o.b = r.b),
ends AS (SELECT r.a, string_agg(r.b, '|' ORDER BY r.b) AS current FROM reach r WHERE r.b NOT IN (SELECT a FROM edges) GROUP BY 1),
resolved AS (SELECT e.a AS concept_id, coalesce(n.current, '') AS current, l.a IS NOT NULL AS cyclic FROM (SELECT DISTINCT a FROM edges) e LEFT JOIN ends n ON n.a = e.a LEFT JOIN loops l ON l.a = e.a)
"""


def _remaps(spark: SparkSession, d: str) -> DataFrame:
    own = view(spark, d, "v_remaps").withColumn("remapped_to", F.array_compact(F.array("target", "other")))
    return own.join(retrieve.resolve_remaps(own, align.store(spark)).hint("merge"), "concept_id", "left")


@query(sql(_REMAPS + "SELECT * FROM resolved", "v_remaps"))
def remap_chains(spark: SparkSession, d: str) -> DataFrame:
    return _remaps(spark, d).where("cyclic is not null").select("concept_id", F.array_join("current", "|").alias("current"), "cyclic")


_LOOKUPS = {
    "UNKNOWN_IDENTIFIER": ("NOT known", "error"), "CONCEPT_REMAPPED": ("known AND current <> ''", "warning"), "STATUS_VERIFIED_ACTIVE": ("known AND status = 'active'", "info"), "STATUS_NOT_VERIFIED": ("seen = 'unknown'", "warning"),
    "UNSUPPORTED_STATUS_CLAIM": ("claimed <> 'unknown' AND seen = 'unknown'", "error"), "CONCEPT_STATUS_MISMATCH": ("claimed <> 'unknown' AND seen <> 'unknown' AND claimed <> seen", "error"), "INACTIVE_CONCEPT": ("seen = 'obsolete'", "error"),
}


@query(sql(_REMAPS + ", m AS (SELECT v.*, coalesce(r.current, '') AS current, CASE WHEN known THEN status ELSE 'unknown' END AS seen FROM v_remaps v LEFT JOIN resolved r USING (concept_id)) " + " UNION ALL ".join(f"SELECT concept_id, '{c}' AS code, '{s}' AS severity FROM m WHERE {t}" for c, (t, s) in _LOOKUPS.items()), "v_remaps"))
def findings_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of unknown status, each the one selection of a proposal, after their lookup in the history."""
    rows = _remaps(spark, d)
    own = concept(F.col("concept_id"), F.col("concept_id"), F.lit(P.target_terminology), F.lit("IN"), F.col("claimed"), F.lit("EXACT"))
    evidence = F.struct(F.col("concept_id").alias("label"), F.lit("IN").alias("concept_class"), F.lit("unknown").alias("status"), F.lit(True).alias("direct"), F.lit(P.target_terminology).alias("vocabulary"), F.array("concept_id").alias("sources"), F.array().cast("array<string>").alias("predicates"))
    answer = F.struct(F.col("known").alias("exists"), F.when(F.col("known"), F.col("status")).otherwise(F.lit("unknown")).alias("status"), F.coalesce("current", F.array().cast("array<string>")).alias("remapped_to"))
    rows = rows.select(
        "concept_id", F.lit("MAPPED").alias("decision"), F.lit("EXACT").alias("relationship"), F.array(own).alias("selected"), own.alias("analysis_level"), own.alias("source_level"),
        F.create_map(F.col("concept_id"), evidence).alias("_evidence_of"), F.create_map(F.col("concept_id"), answer).alias("verified"), F.lit(False).alias("requested_review"),
    ).withColumnRenamed("_evidence_of", "evidence")
    found = audit.spread(validate.lookup_findings(rows, P), "findings", "f", "concept_id")
    return found.select("concept_id", "f.code", "f.severity").distinct()


_LOSSES = "WITH " + _PROPOSALS + """,
e AS (SELECT subject_id, max(object_label) FILTER (predicate = 'has_dose_form') AS form, max(object_label) FILTER (predicate = 'has_precise_ingredient') AS precise, max(object_label) FILTER (predicate = 'has_tradename') AS brand FROM v_edges GROUP BY 1),
g AS (SELECT q.*, CAST(substr(sau_id, 5) AS BIGINT) AS k, c.preferred_label AS label, c.concept_class AS class, form, precise, brand, regexp_extract(c.preferred_label, '[0-9]+ MG') AS strength FROM q JOIN v_concepts c ON c.concept_id = own LEFT JOIN e ON e.subject_id = own),
w AS (SELECT *, CASE WHEN source_id IS DISTINCT FROM own OR hollow OR unresolved OR relationship = 'EXACT' THEN [] ELSE list_filter([
    {'kind': 'strength', 'value': strength}, CASE WHEN form IS NOT NULL THEN {'kind': 'dose_form', 'value': form} END, CASE WHEN precise IS NOT NULL THEN {'kind': 'salt_form', 'value': precise} END,
    CASE WHEN class = 'SBD' THEN {'kind': 'brand_identity', 'value': coalesce(brand, label)} END, CASE WHEN k % 3 = 1 THEN {'kind': 'route', 'value': 'oral'} END,
    CASE WHEN decision = 'MULTI_CONCEPT_MAPPED' THEN {'kind': 'combination_component', 'value': label} END], lambda x: x IS NOT NULL) END AS want,
  list_transform(CASE WHEN loss_kinds = '' THEN [] ELSE string_split(loss_kinds, '|') END, lambda h: {'kind': h, 'value': CASE WHEN h = 'strength' AND k % 7 = 1 THEN strength WHEN h = 'strength' AND k % 7 = 0 OR h = 'dose_form' AND k % 7 = 2 THEN 'other' END}) AS have FROM g),
m AS (SELECT *, list_transform(have, lambda h: h.kind) AS told, list_transform(want, lambda h: h.kind) AS wanted FROM w),
y AS (SELECT *, array_to_string(list_sort(list_filter(wanted, lambda x: NOT list_contains(told, x))), ', ') AS lacking FROM m),
h AS (SELECT sau_id, want, wanted, unnest(have) AS own_loss FROM y)
SELECT DISTINCT sau_id, 'UNEXPECTED_SEMANTIC_LOSS' AS code, 'error' AS severity, 'loss ' || own_loss.kind || ' is not implied by the evidence' AS message FROM h WHERE NOT list_contains(wanted, own_loss.kind)
UNION ALL SELECT DISTINCT sau_id, 'SEMANTIC_LOSS_PAYLOAD_MISMATCH', 'error', 'loss ' || own_loss.kind || ' names another source value' FROM h WHERE own_loss.value IS NOT NULL AND list_contains(wanted, own_loss.kind) AND len(list_filter(want, lambda x: x.kind = own_loss.kind AND x.value = own_loss.value)) = 0
UNION ALL SELECT sau_id, 'DUPLICATE_SEMANTIC_LOSS', 'error', 'loss kinds must be reported once' FROM y WHERE len(list_distinct(told)) < len(told)
UNION ALL SELECT sau_id, 'UNREPORTED_SEMANTIC_LOSS', 'warning', 'no loss is reported; expected ' || lacking FROM y WHERE len(want) > 0 AND len(told) = 0
UNION ALL SELECT sau_id, 'INCOMPLETE_SEMANTIC_LOSS', 'warning', 'losses not reported: ' || lacking FROM y WHERE len(want) > 0 AND len(told) > 0 AND lacking <> ''
"""


@query(sql(_LOSSES, "v_proposals", "v_edges", "v_concepts"))
def findings_losses(spark: SparkSession, d: str) -> DataFrame:
    """Losses that proposals report, with source values, against those that the evidence implies."""
    k = F.substring("sau_id", 5, 20).cast("long")
    value = lambda x: F.when((x["kind"] == "strength") & (k % 7 == 1), text.extract_strength(F.col("raw_value"))).when(((x["kind"] == "strength") & (k % 7 == 0)) | ((x["kind"] == "dose_form") & (k % 7 == 2)), F.lit("other"))
    rows = proposals(spark, d).withColumn("route", F.when(k % 3 == 1, F.lit("oral"))).withColumn("losses", F.transform("losses", lambda x: x.withField("source_value", value(x))))
    rows = validate.validate(rows.withColumn("expected_losses", validate.expected_losses()), P)
    return audit.spread(rows, "findings", "f", "sau_id").where("f.code like '%SEMANTIC_LOSS%'").select("sau_id", "f.code", "f.severity", "f.message")


@query(sql("SELECT provider, operation, count(*) AS n, coalesce(string_agg(DISTINCT terminology_release, '|' ORDER BY terminology_release), '') AS releases FROM v_response_log GROUP BY 1, 2", "v_response_log"))
def usage_summary(spark: SparkSession, d: str) -> DataFrame:
    return audit.usage_summary(view(spark, d, "v_response_log")).withColumn("releases", F.array_join("releases", "|"))


@query(sql("""
WITH k AS (SELECT *, lower(trim(provider_name)) AS p FROM v_usage),
u AS (SELECT *, lag(row_number) OVER (PARTITION BY run_id ORDER BY row_number, accessed_at) AS n0, lag(cache_hits) OVER own AS h0, lag(network_calls) OVER own AS c0, lag(terminology_release) OVER own AS r0, lag(provider_version) OVER own AS v0,
  lag(api_version) OVER own AS a0, lag(mode) OVER own AS m0, lag(true) OVER own AS any0 FROM k WINDOW own AS (PARTITION BY run_id, resource_name, p ORDER BY row_number, accessed_at)),
c AS (SELECT run_id, unnest([CASE WHEN row_number <> coalesce(n0, 0) + 1 THEN 'ROW_NUMBER_GAP' END, CASE WHEN cache_hits < h0 THEN 'CACHE_HITS_FELL' END, CASE WHEN network_calls < c0 THEN 'NETWORK_CALLS_FELL' END,
  CASE WHEN any0 AND terminology_release IS DISTINCT FROM r0 THEN 'RELEASE_CHANGED' END, CASE WHEN any0 AND provider_version IS DISTINCT FROM v0 THEN 'PROVIDER_VERSION_CHANGED' END, CASE WHEN any0 AND api_version IS DISTINCT FROM a0 THEN 'API_CHANGED' END,
  CASE WHEN any0 AND mode IS DISTINCT FROM m0 THEN 'MODE_CHANGED' END]) AS code FROM u)
SELECT run_id, code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY 1, 2
""", "v_usage"))  # fmt: skip
def sequence_audit(spark: SparkSession, d: str) -> DataFrame:
    found = audit.audit_sequence(view(spark, d, "v_usage"), align.store(spark), ["accessed_at"])
    return found.select("run_id", F.explode("codes").alias("code")).groupBy("run_id", "code").agg(F.count(F.lit(1)).alias("n"))


_USAGE = "array<struct<resource_name:string,provider_name:string,terminology_release:string,provider_version:string,mode:string,cache_hits:bigint,network_calls:bigint>>"


@query("""
WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'error' WHEN o_orderkey % 11 = 0 THEN 'skipped' ELSE 'success' END AS status FROM orders),
p AS (SELECT *, (status = 'success') <> (k % 13 = 0) AS has, CASE WHEN status = 'success' THEN k % 17 = 0 ELSE k % 5 <> 0 END AS coded FROM o)
SELECT k AS o_orderkey, code FROM (SELECT k, unnest([CASE WHEN status = 'success' AND NOT has THEN 'SUCCESS_WITHOUT_DECISION' END, CASE WHEN status = 'success' AND coded THEN 'SUCCESS_WITH_ERROR' END, CASE WHEN status <> 'success' AND has THEN 'FAILURE_WITH_DECISION' END,
  CASE WHEN status <> 'success' AND NOT coded THEN 'FAILURE_WITHOUT_CODE' END, CASE WHEN k % 43 = 0 THEN 'RESOURCE_TWICE' END, CASE WHEN has AND k % 19 = 0 THEN 'VALUE_DIFFERS' END, CASE WHEN has AND k % 23 = 0 THEN 'RECORD_ID_DIFFERS' END, CASE WHEN has AND k % 29 = 0 THEN 'UNIT_WITHOUT_ROW_NUMBER' END,
  CASE WHEN has AND k % 31 = 0 AND k % 29 <> 0 THEN 'ROW_NUMBER_DIFFERS' END, CASE WHEN has AND k % 37 = 0 THEN 'USAGE_OMITTED' END, CASE WHEN has AND (k % 41 = 0 OR k % 47 = 0) THEN 'USAGE_CONTRADICTED' END]) AS code FROM p) WHERE code IS NOT NULL
""")
def record_audit(spark: SparkSession, d: str) -> DataFrame:
    """Batch records of orders, each kind of corruption in another share of them."""
    k = F.col("o_orderkey")
    hit = lambda n: k % n == 0
    status = F.when(hit(7), F.lit("error")).when(hit(11), F.lit("skipped")).otherwise(F.lit("success"))
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey").withColumn("status", status)
    good = F.col("status") == "success"
    use = lambda name, release, hits: F.struct(F.lit(name).alias("resource_name"), F.lit("main").alias("provider_name"), release.alias("terminology_release"), F.lit("1").alias("provider_version"), F.lit("live").alias("mode"), hits.cast("long").alias("cache_hits"), F.lit(2).cast("long").alias("network_calls"))
    plain = use("terms", F.lit("2024"), F.lit(9))
    own = F.array(plain, use("names", F.when(hit(41), F.lit("2025")).otherwise(F.lit("2024")), F.when(hit(47), F.lit(8)).otherwise(F.lit(7))))
    run = F.concat(F.array(plain, use("names", F.lit("2024"), F.lit(7))), F.when(hit(43), F.array(plain)).otherwise(F.array().cast(_USAGE)))
    rows = rows.withColumns({
        "decision": F.when(good != hit(13), F.lit("MAPPED")), "error_code": F.when(F.when(good, hit(17)).otherwise(k % 5 != 0), F.lit("X")), "error_message": F.lit(None).cast("string"),
        "raw_value": k.cast("string"), "unit_value": F.when(hit(19), F.lit("other")).otherwise(k.cast("string")), "record_id": k.cast("string"), "unit_record_id": F.when(~hit(23), k.cast("string")),
        "row_number": k, "unit_row_number": F.when(~hit(29), F.when(hit(31), k + 1).otherwise(k)), "usage": run,
        "unit_usage": F.when(hit(37), F.concat(own, F.array(use("more", F.lit("2024"), F.lit(1))))).otherwise(own),
    })
    return audit.audit_records(rows).select("o_orderkey", F.explode("codes").alias("code"))


@query(_verdict_sql("""
SELECT sau_id, unnest(list_filter([CASE WHEN routing_status <> 'HUMAN_REVIEW' THEN 'NOT_ROUTED_TO_REVIEW' END, CASE WHEN k % 3 = 0 THEN 'VALUE_DIFFERS' END, CASE WHEN k % 4 = 0 THEN 'DECISION_DIFFERS' END, CASE WHEN k % 5 = 0 THEN 'CANDIDATES_DIFFER' END, CASE WHEN k % 7 = 0 AND findings > 0 THEN 'MESSAGES_DIFFER' END,
  CASE WHEN k % 11 = 0 THEN 'REASONS_DIFFER' END, CASE WHEN k % 13 = 0 THEN 'PRIORITY_DIFFERS' END], lambda x: x IS NOT NULL)) AS code FROM (SELECT *, CAST(substr(sau_id, 5) AS BIGINT) AS k FROM t) WHERE k % 17 <> 0
UNION ALL SELECT sau_id, 'NO_DECISION' FROM t WHERE CAST(substr(sau_id, 5) AS BIGINT) % 17 = 0"""))
def review_audit(spark: SparkSession, d: str) -> DataFrame:
    """Review items of all proposals, each field wrong in another share of them, against the decisions but for some that are gone."""
    from ..operators.route import considered, messages, priority

    rows = align.store(spark)(routed(spark, d), "routed")
    k = F.substring("sau_id", 5, 20).cast("long")
    items = rows.select(
        "sau_id", F.when(k % 3 == 0, F.lit("x")).otherwise(F.col("raw_value")).alias("raw_value"), F.when(k % 4 == 0, F.lit("x")).otherwise(F.col("decision")).alias("decision"), "relationship",
        F.when(k % 5 == 0, F.slice(considered(), 2, 99)).otherwise(considered()).alias("considered"), F.when(k % 7 == 0, F.slice(messages(), 2, 99)).otherwise(messages()).alias("messages"),
        F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.col("reasons")).alias("reasons"), (priority() + F.when(k % 13 == 0, F.lit(1)).otherwise(F.lit(0))).alias("priority"),
    )
    return audit.audit_reviews(items, rows.where(k % 17 != 0)).select("sau_id", F.explode("codes").alias("code"))


@query("""
WITH d AS (SELECT o_orderstatus AS s, count(*) AS n, sum(CAST('0x' || substr(sha256(o_orderkey || chr(31) || o_orderstatus || chr(31) || o_orderpriority), 1, 15) AS BIGINT)) AS a, sum(CAST('0x' || substr(sha256(o_orderkey || chr(31) || o_orderstatus), 1, 15) AS BIGINT)) AS b FROM orders GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS input_rows, CAST(sum(a) AS VARCHAR) AS input_digest, CAST(sum(n) AS BIGINT) AS output_rows, CAST(sum(b) AS VARCHAR) AS output_digest, string_agg(s || '=' || n, ',' ORDER BY s) AS counts FROM d
""")
def run_manifest(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    found = batch.run_manifest(o.select("o_orderkey", "o_orderstatus", "o_orderpriority"), o.select("o_orderkey", F.col("o_orderstatus").alias("status")))
    return found.withColumn("counts", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query(sql("""
WITH p AS (SELECT *, CAST(substr(sau_id, 5) AS BIGINT) % 4 AS k FROM v_predictions)
SELECT sau_id, explicit_case_id AS case_id, source_value, routing_status, mapping_key, array_to_string(list_filter(string_split(selected_ids, '|'), lambda x: x <> ''), '|') AS selected_ids, CASE WHEN k < 2 THEN ctx_route END AS route FROM p WHERE k < 3
""", "v_predictions"))  # fmt: skip
def prediction_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Predictions written as lines of all shapes (batch records, artifacts, bare decisions, failed records) and read back."""
    import uuid

    p = view(spark, d, "v_predictions")
    k = F.substring("sau_id", 5, 20).cast("long") % 4
    ids = F.transform(_list("selected_ids"), lambda x: F.struct(x.alias("concept_id")))
    fields = [F.col("sau_id"), F.col("record_id"), F.col("explicit_case_id").alias("case_id"), F.col("source_value"), ids.alias("selected_concepts"), F.col("routing_status"), F.col("mapping_key")]
    decision, context = F.struct(*fields), F.create_map(F.lit("route"), F.col("ctx_route"))
    shapes = [
        [F.lit("success").alias("status"), F.struct(decision.alias("decision"), context.alias("context"), F.col("mapping_key")).alias("artifact")],
        [decision.alias("decision"), context.alias("context")], fields, [F.lit("error").alias("status"), F.lit(None).cast("string").alias("artifact")],
    ]
    root = f"{align.shared_dir(spark)}/predictions-{uuid.uuid4().hex}"
    for i, columns in enumerate(shapes):
        batch.write_records(p.where(k == i).select(*columns), f"{root}/{i}")
    out = batch.read_predictions(spark, f"{root}/*")
    return out.select("sau_id", "case_id", "source_value", "routing_status", "mapping_key", F.array_join("selected_ids", "|").alias("selected_ids"), F.col("context")["route"].alias("route"))


@query(sql("SELECT concept_id, 'MAPPED' AS decision, 'EXACT' AS relationship, concept_id AS selected_ids FROM v_concepts", "v_concepts"))
def first_candidate(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import adjudicate
    from .queries_align import _selves

    return adjudicate.first_candidate(enrich.packages(_selves(spark, d), P)).select(F.col("unit_key").alias("concept_id"), "decision", "relationship", F.array_join("selected.concept_id", "|").alias("selected_ids"))


@query(sql("SELECT DISTINCT subject_id AS candidate_id, predicate, object_id, true AS direct FROM v_edges WHERE subject_id LIKE 'P%' AND predicate IN ('has_ingredient', 'has_tradename')", "v_edges"))
def direct_edges(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "v_edges")
    return enrich.related_direct(e.where("subject_id like 'P%'").select(F.col("subject_id").alias("candidate_id")), e, ["has_ingredient", "has_tradename"]).select("candidate_id", "predicate", "object_id", "direct").distinct()


@query(sql("""
SELECT k AS gold_row, code FROM (SELECT k, unnest([CASE WHEN k % 5 = 0 THEN 'BLANK_CASE_ID' END, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN 'UNTRIMMED_CASE_ID' END, CASE WHEN k % 11 = 0 THEN 'BLANK_SOURCE_VALUE' END, CASE WHEN k % 3 = 0 THEN 'DUPLICATE_EXPECTED_ID' END, CASE WHEN k % 13 = 0 THEN 'BLANK_EXPECTED_ID' END]) AS code
  FROM (SELECT CAST(substr(case_id, 2) AS BIGINT) AS k FROM v_gold)) WHERE code IS NOT NULL
""", "v_gold"))  # fmt: skip
def gold_problems(spark: SparkSession, d: str) -> DataFrame:
    """Gold rows, each field spoilt in another share of them."""
    k = F.col("k")
    g = gold(spark, d).withColumn("k", F.substring("case_id", 2, 20).cast("long"))
    g = g.withColumn("case_id", F.when(k % 5 == 0, F.lit("  ")).when(k % 7 == 0, F.concat(F.lit(" "), "case_id")).otherwise(F.col("case_id"))).withColumn("source_value", F.when(k % 11 == 0, F.lit(" ")).otherwise(F.col("source_value")))
    g = g.withColumn("expected_ids", F.concat(F.array(F.lit("a")), F.when(k % 3 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")), F.when(k % 13 == 0, F.array(F.lit(" "))).otherwise(F.array().cast("array<string>"))))
    return evaluate.gold_problems(g).select(F.col("k").alias("gold_row"), F.explode("codes").alias("code"))


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream's summary holds when its input is used up, by way of the shared folder."""
    import uuid

    out = f"{align.shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows")

    q = stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query("SELECT event_type, user_id % 10 AS shard, count(*) AS n FROM events GROUP BY 1, 2")
def stream_summary(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming import align as streaming

    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if "." not in path.rsplit("/", 1)[-1] else f"{d}/events.parque[t]")
    return _drained(spark, streaming.stream_summary(stream.withColumn("shard", F.col("user_id") % 10), ["event_type", "shard"]))


@query(sql("SELECT CASE WHEN trim(reported) = '' THEN 'skipped' ELSE 'success' END AS status, count(*) AS n FROM v_mentions GROUP BY 1", "v_mentions"))
def stream_align(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    from ..operators import retrieve
    from ..streaming import align as streaming
    from .queries_align import terminology

    root = f"{align.shared_dir(spark)}/align-{uuid.uuid4().hex}"
    rows = view(spark, d, "v_mentions").select("l_orderkey", "l_linenumber", "reported", "route", "role_cod", "dose_amt")
    rows.write.parquet(f"{root}/input")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/input")
    t = terminology(spark, d)
    q = streaming.align_stream(stream, t, P, f"{root}/out", f"{root}/checkpoint", "reported", ["l_orderkey", "l_linenumber"], ["route", "role_cod", "dose_amt"], lambda asked: retrieve.exact_hits(asked, t.names))
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out/decisions").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


#: Batches of the stream below: more than one merge of its known keys.
_BATCHES = 6


@query(sql(f"""
WITH v AS (SELECT {queries_align._NORMAL.format("reported")} AS unit_key, min(l_orderkey % {_BATCHES}) AS batch FROM v_mentions WHERE trim(reported) <> '' GROUP BY 1),
names AS (SELECT concept_id, preferred_label AS name FROM v_concepts UNION SELECT concept_id, synonym FROM v_concepts WHERE synonym IS NOT NULL)
SELECT v.unit_key, v.batch, count(DISTINCT n.concept_id) AS hits FROM v LEFT JOIN names n ON v.unit_key = {queries_align._NORMAL.format("n.name")} GROUP BY 1, 2
""", "v_concepts", "v_mentions"))  # fmt: skip
def stream_lookups(spark: SparkSession, d: str) -> DataFrame:
    """The batch of a stream that looked each normal form up, and its hits. The stream is stopped and resumed after each batch."""
    from ..streaming import align as streaming

    root, t = f"{align.shared_dir(spark)}/lookups-{uuid.uuid4().hex}", queries_align.terminology(spark, d)
    put = align.store(spark)
    rows, names = put(view(spark, d, "v_mentions").select("l_orderkey", "reported"), "mentions"), put(retrieve.forms(t.names), "forms")

    def each(batch: DataFrame, number: int) -> None:
        with align.scratch(spark) as scratch:
            # stored, as Spark drops a distinct below a least value, and each row's form is made
            told = scratch(batch.where("trim(reported) <> ''").select("reported").distinct(), "told")
            asked = told.groupBy(text.normalize_text(F.col("reported")).alias("unit_key")).agg(F.min("reported").alias("value"))
            known = streaming.known_hits(batch.sparkSession, f"{root}/known", t)
            streaming.reuse_hits(asked, known, number, lambda new: retrieve.exact_hits(new, names), scratch)

    for k in range(_BATCHES):
        rows.where(F.col("l_orderkey") % _BATCHES == k).write.mode("append").parquet(f"{root}/input")
        q = spark.readStream.schema(rows.schema).parquet(f"{root}/input").writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    known = streaming.known_hits(spark, f"{root}/known", t)
    return known.all(_BATCHES).groupBy("unit_key", "batch").agg(F.count("concept_id").alias("hits"))
