"""Closed vocabularies. They must equal those of the records that this library reads and writes."""

from __future__ import annotations

# fixed values: authority of a statement, the lower the stronger
AUTHORITY_RANK = {
    "source_input": 1,
    "target_terminology": 2,
    "official_coding_relationship": 3,
    "official_crosswalk": 4,
    "ontology_definition": 5,
    "umls_lexical_semantic": 6,
    "existing_kg_relationship": 7,
    "project_coding_policy": 8,
    "prior_expert_example": 9,
    "llm_internal_knowledge": 10,
}
# fixed values: order of retrieval channels in a candidate's rank
CHANNEL_PRIORITY = {
    "exact_lookup": 0,
    "normalized_lookup": 1,
    "terminology_approximate_current": 2,
    "spelling_suggestion": 3,
    "terminology_approximate_historical": 4,
}
OTHER_PRIORITY = 99
HISTORICAL = "terminology_approximate_historical"
LEXICAL_CHANNELS = ("exact_lookup", "normalized_lookup", "spelling_suggestion")
STATUSES = ("active", "not_current", "remapped", "quantified", "obsolete", "never_active", "unknown")
# fixed values: term types by what a concept of that type carries itself
INGREDIENT = ("IN",)
PRECISE = ("PIN",)
BRANDED = ("SBD", "SBDC", "SBDF", "SBDG", "BN", "BPCK")
STRENGTH_BEARING = ("SCD", "SBD", "SCDC", "SBDC", "GPCK", "BPCK")
DOSE_FORM_BEARING = ("SCD", "SBD", "SCDF", "SBDF", "SCDG", "SBDG", "GPCK", "BPCK")
# fixed values: granularity to predicate, classes that are it already, classes that a target may have
GRANULARITY = {
    "ingredient": ("has_ingredient", ("IN",), ("IN",)),
    "precise_ingredient": ("has_precise_ingredient", ("PIN",), ("PIN",)),
    "active_moiety": ("has_boss", ("IN",), ("IN", "PIN")),
}
# fixed values: class reached by a walk to the predicate it is named by
REACHED = {"IN": "has_ingredient", "PIN": "has_precise_ingredient", "MIN": "has_ingredients", "BN": "has_tradename", "DF": "has_dose_form", "SCDC": "consists_of"}
EMPTY_DECISIONS = ("NO_VALID_MAPPING", "INSUFFICIENT_CONTEXT", "ABSTAINED")
# fixed values: names under which source systems give context fields
ENVELOPE_ALIASES = {
    "source_system": "source_system", "table_name": "table_name", "table": "table_name", "column_name": "column_name", "column": "column_name",
    "field_description": "field_description", "data_dictionary_definition": "data_dictionary_definition", "record_id": "record_id",
    "primaryid": "record_id", "dose": "dose", "dose_amt": "dose", "unit": "unit", "dose_unit": "unit", "route": "route", "route_cod": "route",
    "drug_role": "drug_role", "role_cod": "drug_role", "indication": "indication", "indi_pt": "indication", "date": "date", "species": "species",
    "sentence": "sentence", "paragraph": "paragraph", "section_heading": "section_heading", "document_type": "document_type",
    "table_caption": "table_caption", "footnote": "footnote", "study_design": "study_design", "evidence_block_id": "evidence_block_id",
}
ATTRIBUTE_ALIASES = {
    "negation": "negation", "certainty": "certainty", "assertion_status": "assertion_status", "temporality": "temporality", "severity": "severity",
    "species": "species", "anatomical_location": "anatomical_location", "dose": "dose", "dose_amt": "dose", "strength": "strength", "route": "route",
    "route_cod": "route", "formulation": "formulation", "dose_form": "formulation", "dosage_form": "formulation", "specimen": "specimen",
    "assay_method": "assay_method", "unit": "unit", "dose_unit": "unit", "experimental_system": "experimental_system",
}
# fixed values: the crosswalk's columns
CROSSWALK = (
    "sau_id", "reported_value", "record_id", "decision", "relationship_to_source", "source_level_id", "source_level_label", "source_level_class",
    "analysis_level_id", "analysis_level_label", "selected_ids", "selected_labels", "semantic_loss_kinds", "validation_status", "routing_status",
    "review_reasons", "vocabulary_release", "profile_version", "package_version", "run_id",
)
