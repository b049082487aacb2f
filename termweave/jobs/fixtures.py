"""Test inputs as views over the driver's tables; the same SQL runs on Spark and on the oracle's engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "part", "orders", "lineitem", "events")
VIEWS: dict[str, str] = {
    "v_concepts": """
SELECT concat('P', CAST(p_partkey AS STRING)) AS concept_id,
       concat(p_name, ' ', CAST(p_size AS STRING), ' MG ', lower(p_type), ' [', p_brand, ']') AS preferred_label,
       CASE WHEN p_partkey % 4 = 0 THEN 'SCD' ELSE 'SBD' END AS concept_class,
       CASE WHEN p_partkey % 10 = 0 THEN 'not_current' WHEN p_partkey % 37 = 0 THEN 'remapped' ELSE 'active' END AS status,
       p_name AS synonym FROM part
UNION ALL SELECT DISTINCT concat('I_', split_part(p_name,' ',1)), split_part(p_name,' ',1), 'IN', 'active', CAST(NULL AS STRING) FROM part
UNION ALL SELECT DISTINCT concat('I_', split_part(p_name,' ',2)), split_part(p_name,' ',2), 'IN', 'active', CAST(NULL AS STRING) FROM part
UNION ALL SELECT DISTINCT concat('N_', replace(p_name,' ','_')), p_name, 'PIN', 'active', CAST(NULL AS STRING) FROM part
UNION ALL SELECT DISTINCT concat('B_', p_brand), p_brand, 'BN', 'active', CAST(NULL AS STRING) FROM part
UNION ALL SELECT DISTINCT concat('D_', p_type), lower(p_type), 'DF', 'active', CAST(NULL AS STRING) FROM part
""",
    "v_edges": """
SELECT concat('P',CAST(p_partkey AS STRING)) AS subject_id,'has_ingredient' AS predicate, concat('I_',split_part(p_name,' ',2)) AS object_id, split_part(p_name,' ',2) AS object_label,'IN' AS object_class FROM part WHERE p_partkey % 10 <> 0
UNION ALL SELECT concat('P',CAST(p_partkey AS STRING)),'has_ingredient',concat('I_',split_part(p_name,' ',1)),split_part(p_name,' ',1),'IN' FROM part WHERE p_partkey % 10 <> 0 AND p_size % 3 = 0
UNION ALL SELECT concat('P',CAST(p_partkey AS STRING)),'has_precise_ingredient',concat('N_',replace(p_name,' ','_')),p_name,'PIN' FROM part WHERE p_partkey % 10 <> 0
UNION ALL SELECT concat('P',CAST(p_partkey AS STRING)),'has_tradename',concat('B_',p_brand),p_brand,'BN' FROM part WHERE p_partkey % 10 <> 0
UNION ALL SELECT concat('P',CAST(p_partkey AS STRING)),'has_dose_form',concat('D_',p_type),lower(p_type),'DF' FROM part WHERE p_partkey % 10 <> 0
UNION ALL SELECT concat('P',CAST(p_partkey AS STRING)),'may_treat',concat('S',CAST(p_partkey % 7 AS STRING)),'outcome','DX' FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT DISTINCT concat('N_',replace(p_name,' ','_')),'has_ingredient',concat('I_',split_part(p_name,' ',2)),split_part(p_name,' ',2),'IN' FROM part
""",
    "v_mentions": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
       CASE WHEN l_partkey % 11 = 0 THEN '   '
            WHEN l_partkey % 13 = 0 THEN concat('zzqq ', CAST(l_suppkey AS STRING))
            WHEN l_linenumber = 1 THEN p_name
            WHEN l_linenumber = 2 THEN upper(concat('  ', p_name, '  ', CAST(p_size AS STRING), ' mg '))
            WHEN l_linenumber = 3 THEN concat(substr(p_name,1,2), substr(p_name,4))
            WHEN l_linenumber = 4 THEN concat(split_part(p_name,' ',2))
            ELSE concat(p_name,' ',CAST(p_size AS STRING),' MG ',lower(p_type),' [',p_brand,']') END AS reported,
       CASE WHEN l_returnflag = 'N' THEN CAST(NULL AS STRING) ELSE l_returnflag END AS route,
       l_linestatus AS role_cod, CAST(CAST(l_quantity AS INT) AS STRING) AS dose_amt
FROM lineitem JOIN part ON l_partkey = p_partkey
""",
    "v_hits": """
SELECT concat('U', CAST(p_partkey % 197 AS STRING)) AS unit_key,
       CASE p_partkey % 5 WHEN 0 THEN 'normalized_lookup' WHEN 1 THEN 'terminology_approximate_current'
            WHEN 2 THEN 'spelling_suggestion' WHEN 3 THEN 'terminology_approximate_historical'
            ELSE 'lexical' END AS channel,
       concat('P', CAST(p_size % 12 AS STRING)) AS candidate_id,
       CASE WHEN p_partkey % 41 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST((p_partkey * 7) % 101 AS DOUBLE) END AS score,
       p_partkey % 10 + 1 AS hit_rank,
       CASE p_size % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'obsolete' ELSE 'active' END AS status,
       p_brand AS source_vocabulary, p_partkey AS hit_order
FROM part
""",
    "v_gold": """
SELECT concat('C', CAST(p_partkey AS STRING)) AS case_id, p_name AS source_value,
       CASE WHEN p_partkey % 17 = 0 THEN ''
            WHEN p_size % 3 = 0 THEN concat('I_', split_part(p_name,' ',1), '|I_', split_part(p_name,' ',2))
            ELSE concat('I_', split_part(p_name,' ',2)) END AS expected_ids,
       CASE WHEN p_partkey % 19 = 0 THEN CAST(NULL AS STRING) ELSE p_type END AS category,
       CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE CAST(NULL AS STRING) END AS ctx_route
FROM part
""",
    "v_predictions": """
SELECT CASE WHEN p_partkey % 6 = 0 THEN concat('C', CAST(p_partkey AS STRING)) ELSE CAST(NULL AS STRING) END AS explicit_case_id,
       CASE WHEN p_partkey % 6 <> 0 AND p_partkey % 25 <> 1 THEN concat(CASE WHEN p_partkey % 29 = 0 THEN 'X' ELSE 'C' END, CAST(p_partkey AS STRING)) ELSE '  ' END AS record_id,
       concat('SAU-', CAST(p_partkey AS STRING)) AS sau_id,
       CASE WHEN p_partkey % 31 = 0 THEN upper(p_name) WHEN p_partkey % 7 = 0 THEN CAST(NULL AS STRING) ELSE p_name END AS source_value,
       CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN 'I_wrong'
            WHEN p_size % 3 = 0 THEN concat('I_', split_part(p_name,' ',2), '|I_', split_part(p_name,' ',1))
            ELSE concat('I_', split_part(p_name,' ',2)) END AS selected_ids,
       CASE p_partkey % 3 WHEN 0 THEN 'AUTO_ACCEPT' WHEN 1 THEN 'HUMAN_REVIEW' ELSE 'ABSTAIN' END AS routing_status,
       CASE WHEN p_partkey % 8 = 0 THEN 'Brand#0' ELSE p_brand END AS ctx_route,
       CASE WHEN p_partkey % 12 = 0 THEN CAST(NULL AS STRING) ELSE concat('MAP-', CAST(p_partkey % 50 AS STRING)) END AS mapping_key
FROM part WHERE p_partkey % 23 <> 0
""",
    "v_proposals": """
SELECT concat('SAU-', CAST(p_partkey AS STRING)) AS sau_id,
       concat('SAU-', CAST(CASE WHEN p_partkey % 16 = 1 THEN p_partkey + 1 ELSE p_partkey END AS STRING)) AS package_sau_id,
       CASE WHEN p_partkey % 16 = 2 THEN 'MULTI_CONCEPT_MAPPED' WHEN p_partkey % 16 = 3 THEN 'NO_VALID_MAPPING'
            WHEN p_partkey % 16 = 4 THEN 'INSUFFICIENT_CONTEXT' WHEN p_partkey % 16 = 5 THEN 'ABSTAINED'
            WHEN p_size % 3 = 0 THEN 'MULTI_CONCEPT_MAPPED' ELSE 'MAPPED' END AS decision,
       CASE WHEN p_partkey % 16 = 6 THEN 'EXACT' WHEN p_partkey % 16 = 7 THEN 'RELATED_NOT_EQUIVALENT'
            WHEN p_size % 3 = 0 THEN 'MULTIPLE_COMPONENTS_REQUIRED' ELSE 'TARGET_BROADER_THAN_SOURCE' END AS relationship,
       CASE WHEN p_partkey % 16 = 8 THEN CAST(NULL AS STRING) WHEN p_partkey % 16 = 9 THEN 'P999999'
            ELSE concat('P', CAST(p_partkey AS STRING)) END AS source_id,
       CASE WHEN p_partkey % 16 = 10 THEN 'I_other' WHEN p_size % 3 = 0 THEN CAST(NULL AS STRING)
            ELSE concat('I_', split_part(p_name,' ',2)) END AS analysis_id,
       CASE WHEN p_partkey % 16 = 11 THEN concat('I_', split_part(p_name,' ',2), '|I_', split_part(p_name,' ',2))
            WHEN p_size % 3 = 0 AND p_partkey % 16 <> 12 THEN concat('I_', split_part(p_name,' ',2), '|I_', split_part(p_name,' ',1))
            ELSE concat('I_', split_part(p_name,' ',2)) END AS selected_ids,
       CASE WHEN p_partkey % 16 = 13 THEN 'wrong label' ELSE split_part(p_name,' ',2) END AS claimed_label,
       CASE WHEN p_partkey % 16 = 14 THEN 'PIN' ELSE 'IN' END AS claimed_class,
       CASE WHEN p_partkey % 16 = 15 THEN 'obsolete' ELSE 'active' END AS claimed_status,
       CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 9 = 1 THEN 'strength|strength' ELSE 'strength|dose_form|salt_form|brand_identity' END AS loss_kinds,
       p_partkey % 20 = 0 AS requested_human_review
FROM part
""",
    "v_remaps": """
SELECT p_partkey AS k, concat('R', CAST(p_partkey AS STRING)) AS concept_id,
       CASE WHEN p_partkey % 60 = 4 THEN concat('R', CAST(p_partkey - 3 AS STRING)) WHEN p_partkey % 6 = 0 THEN CAST(NULL AS STRING) ELSE concat('R', CAST(p_partkey + 1 AS STRING)) END AS target,
       CASE WHEN p_partkey % 11 = 0 AND p_partkey % 6 <> 0 THEN concat('X', CAST(p_partkey AS STRING)) ELSE CAST(NULL AS STRING) END AS other,
       p_partkey % 13 <> 0 AS known, CASE WHEN p_partkey % 7 = 0 THEN 'obsolete' WHEN p_partkey % 6 = 0 THEN 'active' ELSE 'unknown' END AS status,
       CASE p_partkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'obsolete' ELSE 'active' END AS claimed
FROM part
""",
    "v_requests": """
SELECT c_custkey AS request_id, 'structured_field' AS source_type,
       CASE WHEN c_custkey % 9 = 0 THEN 'automatic_detection' ELSE 'user_specified' END AS mention_mode,
       'drug_normalization' AS task, CASE WHEN c_custkey % 11 = 0 THEN 'product_level' ELSE 'ingredient_level_analysis' END AS mapping_intent,
       CASE WHEN c_custkey % 2 = 0 THEN 'RXNORM' WHEN c_custkey % 7 = 0 THEN 'OTHER' ELSE 'RxNorm' END AS target_terminology,
       CASE WHEN c_custkey % 5 = 0 THEN CAST(NULL AS STRING) ELSE 'ingredient' END AS desired_granularity
FROM customer
""",
    "v_batch_lines": """
SELECT event_id AS line_no, CASE WHEN event_id % 50 = 0 THEN '{bad' WHEN event_id % 77 = 0 THEN ' ' ELSE props END AS line FROM events
""",
    "v_usage": """
SELECT concat('R', CAST(user_id AS STRING)) AS run_id,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + CASE WHEN event_id % 211 = 0 THEN 1 ELSE 0 END AS row_number,
       event_type AS resource_name, CASE WHEN event_id % 173 = 0 THEN '2025' ELSE '2024' END AS terminology_release,
       CASE WHEN event_id % 97 = 0 THEN 0 ELSE event_id END AS cache_hits, event_id % 3 AS network_calls, ts AS accessed_at,
       CASE WHEN event_id % 163 = 0 THEN 'Mirror' WHEN event_id % 7 = 0 THEN 'web ' ELSE 'Web' END AS provider_name, CASE WHEN event_id % 181 = 0 THEN 'v2' ELSE 'v1' END AS provider_version,
       CASE WHEN event_id % 191 = 0 THEN CAST(NULL AS STRING) ELSE 'a1' END AS api_version, CASE WHEN event_id % 199 = 0 THEN 'replay' ELSE 'live' END AS mode
FROM events
""",
    "v_response_log": """
SELECT o_orderkey AS entry_id, CASE WHEN o_orderstatus = 'P' THEN 'alt' ELSE 'main' END AS provider,
       lower(substr(o_orderpriority, 3)) AS operation,
       CASE WHEN o_orderkey % 10 = 0 THEN CAST(NULL AS STRING) WHEN o_orderkey % 3 = 0 THEN '2024-01' ELSE '2024-02' END AS terminology_release,
       o_orderdate AS stored_at FROM orders
""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for table in TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(VIEWS[name])


def sql(body: str, *names: str) -> str:
    """An oracle query whose common table expressions are the named views (and any WITH RECURSIVE parts of its own)."""
    parts = ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n].strip()})" for n in names)
    own = body.strip()
    if own.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {parts}, {own[len('WITH RECURSIVE '):]}"
    if own.upper().startswith("WITH "):
        return f"WITH {parts}, {own[len('WITH '):]}"
    return f"WITH {parts} {own}"
