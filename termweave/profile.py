"""A task's profile: what to map to, what context counts, what is permitted. Used on the driver to build expressions."""

from __future__ import annotations

from dataclasses import asdict, dataclass
import hashlib
import json


@dataclass(frozen=True)
class Profile:
    name: str = "drug_normalization"
    version: str = "0.1.0"
    task: str = "drug_normalization"
    mapping_intent: str = "ingredient_level_analysis"
    target_terminology: str = "RxNorm"
    granularity: str | None = "ingredient"
    source_type: str = "structured_field"
    mention_mode: str = "user_specified"
    required_context: tuple[str, ...] = ()
    optional_context: tuple[str, ...] = ("route", "drug_role", "indication", "dose", "formulation")
    mapping_key_context: tuple[str, ...] = ("route", "dose", "unit", "formulation")
    allowed_predicates: tuple[str, ...] = ("has_ingredient", "has_precise_ingredient", "has_ingredients", "has_tradename", "has_dose_form", "consists_of", "has_boss")
    prohibited_predicates: tuple[str, ...] = ("associated_with_PHPT", "causes_hypercalcemia", "treats_PHPT", "may_treat", "may_prevent", "has_adverse_effect")
    relation_types: tuple[str, ...] = ("EXACT", "TARGET_BROADER_THAN_SOURCE", "TARGET_NARROWER_THAN_SOURCE", "COMPONENT_OF", "MULTIPLE_COMPONENTS_REQUIRED", "UNSUPPORTED_MAPPING", "INSUFFICIENT_CONTEXT")
    maximum_candidates: int = 10
    enrichment_batch: int = 3
    exact_lookup: bool = True
    approximate_match: bool = True
    approximate_overlap: float = 0.6
    approximate_runs: float = 0.4
    historical: bool = True
    require_active: bool = True
    preserve_combination_ingredients: bool = True
    prohibit_unretrieved: bool = True
    flag_salt_conflation: bool = True
    exact_auto_accept: bool = True
    combinations_require_review: bool = False
    unresolved_salt_requires_review: bool = True
    historical_requires_review: bool = True
    minimum_similarity: float = 0.5
    rejection_similarity: float = 0.3
    exact_similarity: float = 0.85
    minimum_auto_accept_score: float | None = None

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()

    def permits(self, predicate: str) -> bool:
        return predicate not in self.prohibited_predicates and (not self.allowed_predicates or predicate in self.allowed_predicates)
