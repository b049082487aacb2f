"""Rules on proposals (J-1 to J-9): each gives findings of code, severity, message, concept_id, category; all are column expressions over one row.

A row has sau_id, package_sau_id, decision, relationship, selected (array), source_level, analysis_level, losses, requested_review, candidates, evidence (map of
concept_id to label, concept_class, status, direct, vocabulary, sources, predicates), verified (map of concept_id to exists, status, remapped_to; optional),
attributes and kept_attributes (maps; optional), expected_losses (optional).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab
from ..profile import Profile
from .adjudicate import LOSS, information_loss
from .enrich import permits_relation

FINDING = "struct<code:string,severity:string,message:string,concept_id:string,category:string>"
_RELATION = "RELATIONSHIP_CLASSIFICATION_ERROR"
EVIDENCE = "map<string,struct<label:string,concept_class:string,status:string,direct:boolean,vocabulary:string,sources:array<string>,predicates:array<string>>>"


def finding(test: Column, code: str, message: Column | str, concept_id: Column | None = None, category: str | None = "VALIDATION_ERROR", severity: str = "error") -> Column:
    told = F.lit(message) if isinstance(message, str) else message
    return F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), told.alias("message"), (F.lit(None).cast("string") if concept_id is None else concept_id).alias("concept_id"), F.lit(category).cast("string").alias("category")))


def _all(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def _each(concepts: Column, rule: Callable[[Column], Column]) -> Column:
    """One finding, or null, for each concept."""
    return F.array_compact(F.transform(concepts, rule))


def _mapped() -> Column:
    return F.col("decision") == "MAPPED"


def _empty() -> Column:
    return F.col("decision").isin(*vocab.EMPTY_DECISIONS)


def _unresolved() -> Column:
    return F.col("requested_review") & F.col("analysis_level").isNull() & (F.col("relationship") == "RELATED_NOT_EQUIVALENT")


def structure() -> Column:
    sel, src, ana, n = F.col("selected"), F.col("source_level"), F.col("analysis_level"), F.size("selected")
    ids = F.transform(sel, lambda c: c["concept_id"])
    both = src.isNotNull() & ana.isNotNull()
    same = src["concept_id"] == ana["concept_id"]
    return _all(
        finding(F.col("sau_id") != F.col("package_sau_id"), "SAU_ID_MISMATCH", F.concat(F.lit("proposal unit "), F.col("sau_id"), F.lit(" does not match package unit "), F.col("package_sau_id"))),
        finding(_mapped() & (n != 1), "INVALID_MAPPED_CARDINALITY", F.concat(F.lit("MAPPED requires exactly one selected concept; received "), n.cast("string"))),
        finding((F.col("decision") == "MULTI_CONCEPT_MAPPED") & (n < 2), "INVALID_MULTI_CONCEPT_CARDINALITY", "MULTI_CONCEPT_MAPPED requires at least two selected concepts"),
        finding(_empty() & (n > 0), "UNEXPECTED_SELECTED_CONCEPTS", F.concat(F.col("decision"), F.lit(" must not select concepts"))),
        finding(~_empty() & src.isNull(), "MISSING_SOURCE_LEVEL_CONCEPT", F.concat(F.col("decision"), F.lit(" requires a source-level concept"))),
        finding(_mapped() & ana.isNull() & ~_unresolved(), "MISSING_ANALYSIS_LEVEL_CONCEPT", "MAPPED requires an analysis-level concept unless it is an unresolved review case"),
        finding(_empty() & (src.isNotNull() | ana.isNotNull()), "UNEXPECTED_CONCEPT_FIELDS", F.concat(F.col("decision"), F.lit(" must not carry source- or analysis-level concepts"))),
        finding(F.size(F.array_distinct(ids)) < n, "DUPLICATE_SELECTED_CONCEPT", "selected concept ids must be unique"),
        finding(ana.isNotNull() & ~F.array_contains(ids, ana["concept_id"]), "ANALYSIS_CONCEPT_NOT_SELECTED", F.concat(F.lit("analysis-level concept "), ana["concept_id"], F.lit(" is not selected")), ana["concept_id"]),
        finding(_mapped() & (n == 1) & ana.isNotNull() & (F.get(ids, F.lit(0)) != ana["concept_id"]), "ANALYSIS_SELECTION_MISMATCH", "the sole selected concept must be the analysis-level concept", ana["concept_id"]),
        finding((F.col("relationship") == "EXACT") & both & ~same, "EXACT_CONCEPT_ID_MISMATCH", "EXACT requires source and analysis level to have the same id", ana["concept_id"], _RELATION),
        finding((F.col("relationship") == "TARGET_BROADER_THAN_SOURCE") & both & same, "BROADER_CONCEPT_ID_MISMATCH", "a broader target requires distinct source- and analysis-level ids", ana["concept_id"], _RELATION),
    )


def _occurrences() -> Column:
    """field and concept of every place that names one."""
    one = lambda field, c: F.when(c.isNotNull(), F.array(F.struct(F.lit(field).alias("field"), c.alias("c")))).otherwise(F.array())
    return F.concat(F.transform("selected", lambda c: F.struct(F.lit("selected_concepts").alias("field"), c.alias("c"))), one("source_level_concept", F.col("source_level")), one("analysis_level_concept", F.col("analysis_level")))


def relation_policy(p: Profile) -> Column:
    top = F.when(~permits_relation(F.col("relationship"), p), F.array(F.struct(F.lit("proposal").alias("field"), F.col("relationship").alias("relation"), F.lit(None).cast("string").alias("id")))).otherwise(F.array())
    rest = F.filter(F.transform("occurrences", lambda o: F.struct(o["field"].alias("field"), o["c"]["relation"].alias("relation"), o["c"]["concept_id"].alias("id"))), lambda o: ~permits_relation(o["relation"], p))
    return _each(F.concat(top, rest), lambda o: finding(F.lit(True), "RELATION_NOT_PERMITTED", F.concat(o["field"], F.lit(" emits "), o["relation"], F.lit(f", which profile {p.name} forbids")), o["id"], _RELATION))


def relation_coherence() -> Column:
    d, top, src, ana = F.col("decision"), F.col("relationship"), F.col("source_level"), F.col("analysis_level")
    multi, mapped = d == "MULTI_CONCEPT_MAPPED", _mapped()
    wanted = F.when(mapped & _unresolved(), top).otherwise(F.lit("EXACT"))
    single = _all(
        finding(d.isin("NO_VALID_MAPPING", "ABSTAINED") & (top != "UNSUPPORTED_MAPPING"), "EMPTY_OUTCOME_RELATION_MISMATCH", F.concat(d, F.lit(" requires UNSUPPORTED_MAPPING, not "), top), category=_RELATION),
        finding((d == "INSUFFICIENT_CONTEXT") & (top != "INSUFFICIENT_CONTEXT"), "INSUFFICIENT_CONTEXT_RELATION_MISMATCH", F.concat(F.lit("INSUFFICIENT_CONTEXT requires its own relationship, not "), top), category=_RELATION),
        finding(multi & (top != "MULTIPLE_COMPONENTS_REQUIRED"), "MULTI_CONCEPT_RELATION_MISMATCH", "MULTI_CONCEPT_MAPPED requires MULTIPLE_COMPONENTS_REQUIRED", category=_RELATION),
        finding(multi & ana.isNotNull(), "UNEXPECTED_MULTI_ANALYSIS_CONCEPT", "components must not be collapsed into one analysis-level concept", ana["concept_id"], _RELATION),
        finding(mapped & top.isin("UNSUPPORTED_MAPPING", "INSUFFICIENT_CONTEXT", "MULTIPLE_COMPONENTS_REQUIRED", "COMPONENT_OF"), "MAPPED_RELATION_MISMATCH", F.concat(F.lit("MAPPED cannot use structural relationship "), top), category=_RELATION),
        finding((multi | mapped) & src.isNotNull() & ~src["relation"].eqNullSafe(wanted), "SOURCE_RELATION_MISMATCH", F.concat(F.lit("source-level concept must use "), wanted), src["concept_id"], _RELATION),
        finding(mapped & ana.isNotNull() & ~ana["relation"].eqNullSafe(top), "ANALYSIS_RELATION_MISMATCH", F.concat(F.lit("analysis-level concept uses "), ana["relation"], F.lit("; proposal uses "), top), ana["concept_id"], _RELATION),
    )
    each = F.when(multi, _each(F.col("selected"), lambda c: finding(~c["relation"].eqNullSafe(F.lit("COMPONENT_OF")), "COMPONENT_RELATION_MISMATCH", F.concat(F.lit("selected component "), c["concept_id"], F.lit(" must use COMPONENT_OF")), c["concept_id"], _RELATION)))
    each = each.when(mapped, _each(F.col("selected"), lambda c: finding(~c["relation"].eqNullSafe(top), "SELECTED_RELATION_MISMATCH", F.concat(F.lit("selected concept "), c["concept_id"], F.lit(" uses "), c["relation"], F.lit("; proposal uses "), top), c["concept_id"], _RELATION)))
    return F.concat(single, F.coalesce(each, F.array().cast(f"array<{FINDING}>")))


def evidence_rules(p: Profile, verify: bool) -> Column:
    """J-4 and J-5 for each occurrence. verify: a map column `verified` answers for concepts of unknown status."""

    def rules(o: Column) -> Column:
        field, c, cid = o["field"], o["c"], o["c"]["concept_id"]
        e = F.col("evidence")[cid]
        have, final = e.isNotNull(), field != "source_level_concept"
        asked = ~F.array_contains("role_errors", cid) & ~_empty() & (e["status"] == "unknown")
        v = F.col("verified")[cid] if verify else None
        found = asked & v["exists"] if verify else F.lit(False)
        status = F.when(found, v["status"]).otherwise(e["status"]) if verify else e["status"]
        claim = c["status"]
        wrong = text.casefold(c["vocabulary"]) != F.lit(p.target_terminology.casefold())
        return _all(
            finding(~have & F.lit(p.prohibit_unretrieved), "UNRETRIEVED_IDENTIFIER", F.concat(field, F.lit(" contains "), cid, F.lit(", which is absent from the package's evidence")), cid, "ADJUDICATION_ERROR"),
            finding((have | F.lit(not p.prohibit_unretrieved)) & wrong, "WRONG_VOCABULARY", F.concat(field, F.lit(" concept "), cid, F.lit(" belongs to "), c["vocabulary"], F.lit(f", but the task targets {p.target_terminology}")), cid),
            finding(have & final & (e["status"] == "active") & ~e["direct"], "STATUS_FROM_RELEASE_EVIDENCE", F.concat(F.lit("relationships of the release establish "), cid, F.lit(" as active")), cid, None, "info"),
            finding(have & (text.casefold(c["vocabulary"]) != text.casefold(e["vocabulary"])), "CONCEPT_VOCABULARY_MISMATCH", F.concat(field, F.lit(" claims "), c["vocabulary"], F.lit(" for "), cid, F.lit("; evidence says "), e["vocabulary"]), cid),
            finding(have & (text.normalize_text(c["label"]) != text.normalize_text(e["label"])), "CONCEPT_LABEL_MISMATCH", F.concat(field, F.lit(" label "), c["label"], F.lit(" does not match package label "), e["label"], F.lit(" for "), cid), cid),
            finding(have & (text.casefold(c["concept_class"]) != text.casefold(e["concept_class"])), "CONCEPT_CLASS_MISMATCH", F.concat(field, F.lit(" class "), c["concept_class"], F.lit(" does not match package class "), e["concept_class"], F.lit(" for "), cid), cid),
            finding(asked & ~v["exists"] if verify else F.lit(False), "UNKNOWN_IDENTIFIER", F.concat(cid, F.lit(" is not known to "), c["vocabulary"]), cid),
            finding(found & (F.size(v["remapped_to"]) > 0) if verify else F.lit(False), "CONCEPT_REMAPPED", F.concat(cid, F.lit(" was remapped to "), F.array_join(v["remapped_to"], ", ")) if verify else "", cid, severity="warning"),
            finding(found & (v["status"] == "active") if verify else F.lit(False), "STATUS_VERIFIED_ACTIVE", F.concat(F.lit("verified "), cid, F.lit(" as active")), cid, None, "info"),
            finding(have & (claim != "unknown") & (status == "unknown"), "UNSUPPORTED_STATUS_CLAIM", F.concat(field, F.lit(" claims status "), claim, F.lit(" for "), cid, F.lit(", which no evidence establishes")), cid),
            finding(have & (claim != "unknown") & (status != "unknown") & (claim != status), "CONCEPT_STATUS_MISMATCH", F.concat(field, F.lit(" claims status "), claim, F.lit(" for "), cid, F.lit("; evidence says "), status), cid),
            finding(have & F.lit(p.require_active) & final & (status == "unknown"), "STATUS_NOT_VERIFIED", F.concat(F.lit("lifecycle status of final concept "), cid, F.lit(" is not verified")), cid, "RESOURCE_COVERAGE_GAP", "warning"),
            finding(have & F.lit(p.require_active) & final & ~status.isin("unknown", "active"), "INACTIVE_CONCEPT", F.concat(cid, F.lit(" has status "), status, F.lit("; the profile requires an active final concept")), cid),
        )

    return F.flatten(F.transform("occurrences", rules))


def lookup_findings(df: DataFrame, p: Profile) -> DataFrame:
    """df (selected, analysis_level, source_level, evidence, verified, decision, ...) with `findings` of J-4 and J-5 alone, after the lookup of concepts of unknown status."""
    rows = df.withColumn("occurrences", _occurrences()).withColumn("role_errors", F.array().cast("array<string>"))
    return rows.withColumn("findings", F.array_distinct(evidence_rules(p, True))).drop("occurrences", "role_errors")


def source_targets(p: Profile) -> Column:
    """Ids that the source-level candidate's own edges reach at the profile's granularity."""
    predicate = vocab.GRANULARITY[p.granularity or ""][0]
    source = F.get(F.filter("candidates", lambda c: c["candidate_id"] == F.col("source_level.concept_id")), F.lit(0))
    found = F.transform(F.filter(source["edges"], lambda e: e["predicate"] == predicate), lambda e: e["object_id"])
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>")) if p.permits(predicate) else F.array().cast("array<string>")


def roles(p: Profile) -> Column:
    src = F.col("source_level")
    retrieved = F.exists("candidates", lambda c: c["candidate_id"] == src["concept_id"])
    parts = [_all(finding(src.isNotNull() & ~F.coalesce(retrieved, F.lit(False)), "SOURCE_CONCEPT_NOT_DIRECTLY_RETRIEVED", F.concat(F.lit("source-level concept "), src["concept_id"], F.lit(" is not a directly retrieved candidate")), src["concept_id"]))]
    if p.granularity is not None:
        policy = vocab.GRANULARITY.get(p.granularity)
        if policy is None:
            parts.append(_all(finding(F.lit(True), "UNSUPPORTED_GRANULARITY", f"no policy exists for granularity {p.granularity!r}")))
        elif not p.permits(policy[0]):
            parts.append(_all(finding(F.lit(True), "GRANULARITY_RELATION_NOT_PERMITTED", f"profile does not permit {policy[0]}, required for {p.granularity}")))
        else:
            predicate, _, wanted = policy
            ids, targets = F.array_distinct(F.transform("selected", lambda c: c["concept_id"])), F.col("targets")
            missing, extra = F.sort_array(F.array_except(targets, ids)), F.sort_array(F.array_except(ids, targets))
            set_wrong = finding((F.col("decision") == "MULTI_CONCEPT_MAPPED") & ((F.size(missing) > 0) | (F.size(extra) > 0)), "MULTI_COMPONENT_SET_MISMATCH", F.concat(F.lit("selections must equal the source's targets: missing ["), F.array_join(missing, ", "), F.lit("], unexpected ["), F.array_join(extra, ", "), F.lit("]")), src["concept_id"], "ADJUDICATION_ERROR")

            def each(c: Column) -> Column:
                cid, e = c["concept_id"], F.col("evidence")[c["concept_id"]]
                needs = F.col("relationship").isin("TARGET_BROADER_THAN_SOURCE", "MULTIPLE_COMPONENTS_REQUIRED")
                itself = e["direct"] & F.coalesce(e["concept_class"].isin(*wanted), F.lit(False))
                walked = F.array_contains(e["predicates"], predicate) & (src.isNull() | F.array_contains(e["sources"], src["concept_id"])) & F.coalesce(e["concept_class"].isin(*wanted), F.lit(True))
                return _all(
                    finding(needs & ~F.array_contains(targets, cid), "TARGET_NOT_REACHABLE_FROM_SOURCE", F.concat(cid, F.lit(f" is not a {predicate} target of source "), F.coalesce(src["concept_id"], F.lit("[missing]"))), cid, "ADJUDICATION_ERROR"),
                    finding(e.isNotNull() & ~itself & ~walked, "INVALID_GRANULARITY_TARGET", F.concat(cid, F.lit(" is evidenced as class "), F.coalesce(e["concept_class"], F.lit("unknown")), F.lit(f", not as {p.granularity}")), cid, "UNSUPPORTED_SPECIFICITY"),
                )

            none = F.array().cast(f"array<{FINDING}>")
            parts.append(F.when(_unresolved(), none).otherwise(F.concat(_all(set_wrong), F.flatten(F.transform("selected", each)))))
    return F.concat(*parts)


def historical_source() -> Column:
    src = F.col("source_level")
    status = F.col("evidence")[src["concept_id"]]["status"]
    return _all(finding(src.isNotNull() & ~status.isin("active", "unknown"), "HISTORICAL_SOURCE_CONCEPT", F.concat(F.lit("mapping rests on "), src["concept_id"], F.lit(", whose status is "), status), src["concept_id"], "RESOURCE_COVERAGE_GAP", "warning"))


def domain(p: Profile, attributes: bool) -> Column:
    """J-7: dropped components, a salt taken for its base, attributes changed."""
    src, ids = F.col("source_level"), F.transform("selected", lambda c: c["concept_id"])
    source = F.get(F.filter("candidates", lambda c: c["candidate_id"] == src["concept_id"]), F.lit(0))
    components = F.coalesce(F.array_distinct(F.transform(F.filter(source["edges"], lambda e: e["predicate"] == "has_ingredient"), lambda e: e["object_id"])), F.array().cast("array<string>"))
    dropped = F.sort_array(F.array_except(components, ids))
    # a precise ingredient on one side of an exact claim, a base ingredient on the other
    ana = F.col("analysis_level")
    kinds = F.array_sort(F.array(src["concept_class"], ana["concept_class"]))
    salt = (F.col("relationship") == "EXACT") & (src["concept_id"] != ana["concept_id"]) & (kinds == F.array(F.lit("IN"), F.lit("PIN")))
    return _all(
        finding(F.lit(p.preserve_combination_ingredients) & ~_empty() & ~_unresolved() & F.lit(p.granularity == "ingredient") & (F.size(components) > 1) & (F.size(dropped) > 0), "COMBINATION_INGREDIENT_DROPPED", F.concat(F.lit("combination loses "), F.array_join(dropped, ", ")), src["concept_id"]),
        finding(F.lit(p.flag_salt_conflation) & F.coalesce(salt, F.lit(False)), "SALT_ACTIVE_MOIETY_CONFLATION", "a precise ingredient and its base ingredient are taken for one", F.col("analysis_level.concept_id"), _RELATION),
        finding(~F.col("kept_attributes").eqNullSafe(F.col("attributes")) if attributes else F.lit(False), "PRESERVED_ATTRIBUTES_MISMATCH", "preserved attributes differ from the unit's", None),
    )


def losses() -> Column:
    """J-8: reported losses against those that the evidence implies (expected_losses)."""
    have, want = F.col("losses"), F.col("expected_losses")
    kinds, wanted = F.transform(have, lambda x: x["kind"]), F.transform(want, lambda x: x["kind"])
    lacking = F.sort_array(F.array_except(wanted, kinds))
    broader = ~_empty() & (F.size(want) > 0)

    def each(x: Column) -> Column:
        same = F.filter(want, lambda y: y["kind"] == x["kind"])
        return _all(
            finding(~F.array_contains(wanted, x["kind"]), "UNEXPECTED_SEMANTIC_LOSS", F.concat(F.lit("loss "), x["kind"], F.lit(" is not implied by the evidence"))),
            finding((F.size(same) > 0) & x["source_value"].isNotNull() & ~F.exists(same, lambda y: y["source_value"].eqNullSafe(x["source_value"])), "SEMANTIC_LOSS_PAYLOAD_MISMATCH", F.concat(F.lit("loss "), x["kind"], F.lit(" names another source value"))),
        )

    return F.concat(
        F.flatten(F.transform(have, each)),
        _all(
            finding(F.size(F.array_distinct(kinds)) < F.size(kinds), "DUPLICATE_SEMANTIC_LOSS", "loss kinds must be reported once"),
            finding(broader & (F.size(have) == 0), "UNREPORTED_SEMANTIC_LOSS", F.concat(F.lit("no loss is reported; expected "), F.array_join(lacking, ", ")), severity="warning"),
            finding(broader & (F.size(have) > 0) & (F.size(lacking) > 0), "INCOMPLETE_SEMANTIC_LOSS", F.concat(F.lit("losses not reported: "), F.array_join(lacking, ", ")), severity="warning"),
        ),
    )


def expected_losses() -> Column:
    """The losses that a row's evidence implies for its source level and first selected concept (columns raw_value, route)."""
    source = F.get(F.filter("candidates", lambda c: c["candidate_id"] == F.col("source_level.concept_id")), F.lit(0))
    first = F.get("selected", F.lit(0))
    found = information_loss(source, first["concept_id"], first["label"], F.col("raw_value"), F.col("route"))
    multi = F.col("decision") == "MULTI_CONCEPT_MAPPED"
    whole = F.concat(found, F.array(F.struct(F.lit("combination_component").alias("kind"), F.lit("").alias("description"), source["label"].alias("source_value"))))
    none = F.array().cast(f"array<{LOSS}>")
    return F.when(source.isNull() | first.isNull() | _empty() | _unresolved() | (F.col("relationship") == "EXACT"), none).when(multi, whole).otherwise(found)


def verdict() -> Column:
    severe = lambda s: F.exists("findings", lambda f: f["severity"] == s)
    return F.when(severe("error"), F.lit("REJECTED")).when(F.col("requested_review"), F.lit("HUMAN_REVIEW_REQUIRED")).when(severe("warning"), F.lit("VALID_WITH_WARNING")).when(F.size("losses") > 0, F.lit("VALID_WITH_SEMANTIC_LOSS")).otherwise(F.lit("VALID"))


def validate(df: DataFrame, p: Profile) -> DataFrame:
    """df with findings (each code, concept and message once) and verdict. Three selects keep the generated code small."""
    rows = df.withColumn("occurrences", _occurrences()).withColumn("targets", source_targets(p) if p.granularity in vocab.GRANULARITY else F.array().cast("array<string>"))
    rows = rows.withColumn("_role", roles(p)).withColumn("role_errors", F.filter(F.transform(F.filter("_role", lambda f: f["severity"] == "error"), lambda f: f["concept_id"]), lambda x: x.isNotNull()))
    rows = rows.withColumn("_plain", F.concat(structure(), relation_policy(p), relation_coherence()))
    rows = rows.withColumn("_evidence", evidence_rules(p, "verified" in df.columns))
    rows = rows.withColumn("_domain", F.concat(historical_source(), domain(p, "kept_attributes" in df.columns and "attributes" in df.columns), losses() if "expected_losses" in df.columns else F.array().cast(f"array<{FINDING}>")))
    rows = rows.withColumn("findings", F.array_distinct(F.concat("_plain", "_role", "_evidence", "_domain")))
    return rows.withColumn("verdict", verdict()).drop("occurrences", "targets", "_role", "role_errors", "_plain", "_evidence", "_domain")
