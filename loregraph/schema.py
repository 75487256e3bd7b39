"""Schemas and constant tables of the knowledge-graph model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NODES = (
    "id string, kind string, source_file string, source_hash string, layer string, status string, aliases array<string>, domain string, "
    "fields_text map<string,string>, fields_list map<string,array<string>>, fields_table map<string,array<map<string,string>>>, indexed_at timestamp"
)
EDGES = "edge_seq bigint, from_node string, to_node string, edge_type string, source_file string, extraction_method string, metadata map<string,string>, layer_violation boolean, bidirectional boolean"
EMBEDDINGS = (
    "id string, document_id string, document_kind string, section_path string, chunk_index int, raw_text string, context_text string, "
    "vector array<double>, model string, dimensions int, text_hash string, generated_at timestamp"
)
MANIFEST = "version string, index_level string, embedding_model string, embedding_dimensions int, structure string, domains array<string>, nodes bigint, edges bigint, embeddings bigint, indexed_at string, git_commit string"

# Kinds in prefix order with their node prefix, the folder they are expected in,
# and the (lower-case) headings whose sections are embedded.
KINDS = [
    ("entity", "Entity", "01-domain/entities/", ["descripción", "description"]),
    ("event", "Event", "01-domain/events/", []),
    ("business-rule", "BR", "01-domain/rules/", ["declaración", "declaration", "cuándo aplica", "when applies"]),
    ("business-policy", "BP", "02-behavior/policies/", ["declaración", "declaration"]),
    ("cross-policy", "XP", "02-behavior/policies/", ["propósito", "purpose", "declaración", "declaration"]),
    ("command", "CMD", "02-behavior/commands/", ["purpose", "propósito"]),
    ("query", "QRY", "02-behavior/queries/", ["purpose", "propósito"]),
    ("process", "PROC", "02-behavior/processes/", ["participantes", "participants", "pasos", "steps"]),
    ("use-case", "UC", "02-behavior/use-cases/", ["descripción", "description", "flujo principal", "main flow"]),
    ("ui-view", "UIView", "03-experience/views/", ["descripción", "description", "comportamiento", "behavior"]),
    ("ui-component", "UIComp", "03-experience/views/", ["descripción", "description"]),
    ("requirement", "REQ", "04-verification/criteria/", ["descripción", "description"]),
    ("objective", "OBJ", "00-requirements/objectives/", ["objetivo", "objective"]),
    ("prd", "PRD", "00-requirements/", ["problema / oportunidad", "problem / opportunity"]),
    ("adr", "ADR", "00-requirements/decisions/", ["contexto", "context", "decisión", "decision"]),
    ("glossary", "GLOSS", "01-domain/glossary/", ["definición", "definition"]),
]
# Layers in order.
LAYERS = ["00-requirements", "01-domain", "02-behavior", "03-experience", "04-verification"]
# Start of a link's target -> prefix of the node it names; others are entities.
LINK_PREFIXES = [
    ("EVT-", "Event"), ("BR-", "BR"), ("BP-", "BP"), ("XP-", "XP"), ("CMD-", "CMD"), ("QRY-", "QRY"), ("UC-", "UC"),
    ("PROC-", "PROC"), ("REQ-", "REQ"), ("OBJ-", "OBJ"), ("ADR-", "ADR"), ("PRD-", "PRD"), ("UI-", "UIView"),
]
# The layer that a node's prefix suggests.
PREFIX_LAYERS = {
    "00-requirements": ["OBJ", "PRD", "ADR"],
    "01-domain": ["Entity", "Event", "BR", "GLOSS"],
    "02-behavior": ["BP", "XP", "CMD", "QRY", "PROC", "UC"],
    "03-experience": ["UIView", "UIComp"],
    "04-verification": ["REQ"],
}
# What governs a node of a kind, by edge type.
COVERAGE_RULES = [
    ("entity", "events", "EMITS"),
    ("entity", "business_rules", "ENTITY_RULE"),
    ("entity", "use_cases", "WIKI_LINK"),
    ("command", "events", "EMITS"),
    ("command", "use_cases", "UC_EXECUTES_CMD"),
    ("use-case", "commands", "UC_EXECUTES_CMD"),
    ("use-case", "rules", "UC_APPLIES_RULE"),
    ("use-case", "requirements", "REQ_TRACES_TO"),
    ("business-rule", "entity", "ENTITY_RULE"),
    ("business-rule", "use_cases", "UC_APPLIES_RULE"),
    ("requirement", "traces", "REQ_TRACES_TO"),
]
# What a coverage rule asks for.
COVERAGE_TEXTS = {
    ("entity", "events"): "Domain events emitted by this entity",
    ("entity", "business_rules"): "Business rules for this entity",
    ("entity", "use_cases"): "Use cases involving this entity",
    ("command", "events"): "Events emitted by this command",
    ("command", "use_cases"): "Use cases that execute this command",
    ("use-case", "commands"): "Commands executed by this use case",
    ("use-case", "rules"): "Business rules applied",
    ("use-case", "requirements"): "Requirements tracing to this UC",
    ("business-rule", "entity"): "Entity this rule validates",
    ("business-rule", "use_cases"): "Use cases that apply this rule",
    ("requirement", "traces"): "Artifacts this requirement traces to",
}
# Structural edge types; others, in lower case, are free.
EDGE_TYPES = [
    "WIKI_LINK", "DOMAIN_RELATION", "ENTITY_RULE", "ENTITY_POLICY", "EMITS", "CONSUMES", "UC_APPLIES_RULE", "UC_EXECUTES_CMD", "UC_STORY", "VIEW_TRIGGERS_UC", "VIEW_USES_COMPONENT",
    "COMPONENT_USES_ENTITY", "REQ_TRACES_TO", "VALIDATES", "DECIDES_FOR", "CROSS_DOMAIN_REF", "LAYER_DEPENDENCY", "GLOSSARY_DEFINES",
]
# What an incoming edge of a type means for a change.
IMPACT_TEXTS = {
    "ENTITY_RULE": "Business rule validates this entity",
    "UC_APPLIES_RULE": "Use case applies this rule",
    "UC_EXECUTES_CMD": "Use case executes this command",
    "EMITS": "Emits this event",
    "CONSUMES": "Consumes this event",
    "WIKI_LINK": "References this artifact",
    "DOMAIN_RELATION": "Has a domain relationship",
    "REQ_TRACES_TO": "Requirement traces to this artifact",
    "VALIDATES": "Validates this artifact via BDD scenarios",
}
# Weights of fused scores, the bonus of each further source, the divisor, the
# constant scores of lexical and graph matches, and the share of the threshold that chunks need.
SEMANTIC_WEIGHT, GRAPH_WEIGHT, LEXICAL_WEIGHT, BONUS, DIVISOR = 0.6, 0.3, 0.1, 0.1, 1.2
CONSTANT_SCORE, CHUNK_SHARE = 0.5, 0.8
# Context items by kind; constraints are those of priority 0 and 1.
CONTEXT_PRIORITY = {"business-rule": 0, "business-policy": 0, "cross-policy": 0, "entity": 1, "command": 2, "use-case": 2, "requirement": 2}
CONTENT_CUT = 300


class QueryError(ValueError):
    """A query that can't be answered; ``code`` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def kinds(spark: SparkSession) -> DataFrame:
    """(kind, prefix, prefix_rank, expected_path): 16 rows."""
    return spark.createDataFrame([(k, p, i, path) for i, (k, p, path, _) in enumerate(KINDS, 1)], "kind string, prefix string, prefix_rank int, expected_path string")


def embeddable(spark: SparkSession) -> DataFrame:
    """(kind, heading): sections that are embedded."""
    return spark.createDataFrame([(k, h) for k, _, _, headings in KINDS for h in headings], "kind string, heading string")
