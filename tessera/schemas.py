"""Declared schemas and closed vocabularies. Null means absent in the sources; an empty list is a decision."""

from __future__ import annotations

RELATIONS = ("contrasts_with", "resonates_with", "complicates")
CARD = (
    "id string, tradition string, author string, work string, location string, fragment string, thought string, "
    "context string, commentary string, philosophical_questions array<string>, coordinates array<string>, "
    "tensions array<string>, perspective string, philosophical_operation string, question_structures array<string>, "
    "relations struct<" + ", ".join(f"{r}: array<string>" for r in RELATIONS) + ">, "
    "translation string, source string, copyright_status string, source_verified boolean, interpretation_verified boolean, "
    "technical struct<operational_status: string, retrieval_eligible: boolean, recovery_status: string, "
    "thought_placeholder: string, translation_placeholder: string, field_provenance: map<string,string>, curation: map<string,string>>"
)
FINAL_CARD = (
    "card_id", "status_in_corpus", "author", "work", "location", "philosophical_move", "quote", "translator",
    "edition_source", "verification_status", "verification_note", "evidence_layer_source",
)

# Statuses under which a card may be retrieved.
RETRIEVABLE = ("verified", "registry_curated", "final_active")
# The taxonomy's coordinates and tensions, the qualifier of a tension and the open structure.
COORDINATES = (
    "желание", "ожидание / представление", "выбор / свобода", "действие", "контроль", "долг / ответственность",
    "привязанность", "принятие / сопротивление", "отношение к другому", "отношение к себе", "признание",
    "страх / конечность", "смысл / цель", "принадлежность",
)
TENSIONS = (
    "желание ↔ долг", "свобода ↔ привязанность", "действие ↔ принятие", "собственное желание ↔ признание",
    "отношение к себе ↔ взгляд другого", "контроль ↔ конечность", "долг перед другим ↔ долг перед собой",
    "ожидание ↔ действительность", "достигнутая цель ↔ смысл", "принадлежность ↔ свобода",
)
TENSION_QUALIFIER = " (potential)"
OPEN_STRUCTURE = "open / context-dependent"
# Names that describe a run and must not be stored in a card.
FORBIDDEN_FIELDS = (
    "required_assumption", "required_assumption_status", "required_unsupported_assumptions", "status", "candidate_status",
    "strong", "possible", "reject", "relevance", "question_relevance", "situational_relevance", "situational_applicability",
    "narrative_applicability", "relevant_to_confirmed_question", "supported_by_narrative", "source_fidelity", "coverage",
    "coverage_contribution", "relation_to_selected", "relation_to_other_candidates", "similarity", "embedding_similarity",
    "selection_reason", "rejection_reason", "personal_link",
)
# Marks of unfinished editorial work.
PLACEHOLDERS = ("[FINAL TEXTUAL PASS", "зафиксировать по утверждённому реестру")
# The layers of a card's content; tensions alone may be an empty list.
CONTENT_FIELDS = {
    "TEXT": ("thought", "context", "commentary"),
    "MEANING": ("philosophical_questions", "coordinates", "tensions", "perspective"),
    "VERIFICATION": ("translation", "source", "copyright_status", "source_verified", "interpretation_verified"),
}
