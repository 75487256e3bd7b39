"""Edges that documents suggest, with a confidence: several rules each, the best of an edge counts.

A rule is data: where it looks (a front-matter field, the links, a pattern in the text), what node
and edge it makes, and how sure it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions import columns as C
from loregraph.operators import parse as P
from loregraph.schema import LINK_PREFIXES

# Fixed value: edges that are less sure are dropped.
LEAST = 0.5


@dataclass(frozen=True)
class Rule:
    """``field``: a front-matter field; ``pattern``: a regular expression whose group 1 is the name; neither: links.

    ``prefix``: the node is this and the name; without it the name is resolved as a link's target.
    """

    method: str
    confidence: float
    edge_type: str = "REFERENCES"
    field: str | None = None
    pattern: str | None = None
    prefix: str | None = None


# Front-matter fields and their edge types; the confidence of fields, links, ids and named things.
RULES = [
    Rule("front_matter", 1.0, "RELATED_TO", field="related"),
    Rule("front_matter", 1.0, "REFERENCES", field="references"),
    Rule("front_matter", 1.0, "IMPLEMENTS", field="implements"),
    Rule("front_matter", 1.0, "DEPENDS_ON", field="depends_on"),
    Rule("wiki_link", 0.9),
    Rule("named_use_case", 0.85, pattern=r"(?i)\b(?:caso de uso|use case|CU[-_]?\d+)[\s:]+(\w+)", prefix="UC"),
    Rule("named_rule", 0.85, pattern=r"(?i)\b(?:regla|rule|RN[-_]?\d+|BR[-_]?\d+)[\s:]+(\w+)", prefix="BR"),
    Rule("identifier", 0.8, pattern=rf"(?<![\w-])((?:{'|'.join(start for start, _ in LINK_PREFIXES)})\w+(?:-\w+)*)"),
    Rule("named_actor", 0.8, pattern=r"(?i)\b(?:actor|usuario|user)[\s:]+(\w+)", prefix="Actor"),
    Rule("named_system", 0.8, pattern=r"(?i)\b(?:sistema|system|servicio|service)[\s:]+(\w+)", prefix="System"),
    Rule("named_entity", 0.8, pattern=r"(?i)\b(?:entidad|entity|objeto|object)[\s:]+(\w+)", prefix="Entity"),
]


def _names(rule: Rule, text: Column) -> Column:
    if rule.field:
        # a field may hold links: their targets count
        plain = F.transform(P.listed(F.try_element_at("front_matter", F.lit(rule.field))), lambda x: F.regexp_replace(x, r"^\[\[|\]\]$", ""))
        return F.filter(F.transform(plain, C.trim_all), lambda x: x != "")
    return F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(1)) if rule.pattern else P.link_targets(text)


def suggested(documents: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(from_node, to_node, edge_type, rule, source_file) of all that the rules find in ``parse.parse_documents``' rows.

    ``rule`` is a place in the order of falling confidence, then of the list.  Names are looked
    for in sections, headings included; a document's own id and empty names are passed over.
    """
    order = sorted(rules, key=lambda r: -r.confidence)
    text = F.array_join(F.transform("sections", lambda s: F.concat_ws("\n", s["heading"], s["content"])), "\n\n")
    rows = documents.select(C.node_id(F.col("kind"), F.col("id")).alias("from_node"), F.col("path").alias("source_file"), "front_matter", text.alias("text"))

    def found(i: int, rule: Rule) -> Column:
        node = lambda name: F.concat(F.lit(f"{rule.prefix}:"), name) if rule.prefix else C.resolve_link(name)
        return F.transform(F.array_distinct(_names(rule, F.col("text"))), lambda n: F.struct(node(n).alias("to_node"), F.lit(rule.edge_type).alias("edge_type"), F.lit(i).alias("rule")))

    each = F.flatten(F.array(*[found(i, r) for i, r in enumerate(order)]))
    return rows.select("from_node", "source_file", F.inline(each)).where("from_node <> to_node")


def _said(rules: list[Rule]) -> tuple[Column, Column]:
    """(confidence, extraction_method) of the column ``rule``."""
    order = sorted(rules, key=lambda r: -r.confidence)
    return F.get(F.array(*[F.lit(float(r.confidence)) for r in order]), F.col("rule")), F.get(F.array(*[F.lit(r.method) for r in order]), F.col("rule"))


def scored_edges(documents: DataFrame, rules: list[Rule] = RULES, least: float = LEAST) -> DataFrame:
    """(from_node, to_node, edge_type, source_file, confidence, extraction_method): each edge of a file once, by its surest rule.

    Of equally sure rules the first of the list counts.  Edges under ``least`` are left out
    before anything is shuffled.  No rule, no document or nothing found: no rows.
    """
    able = [r for r in rules if r.confidence >= least]
    if not able:
        return scored_edges(documents, [Rule("none", 0.0)], 0.0).where("false")
    confidence, method = _said(able)
    best = suggested(documents, able).groupBy("from_node", "to_node", "edge_type", "source_file").agg(F.min("rule").alias("rule"))
    return best.select("from_node", "to_node", "edge_type", "source_file", confidence.alias("confidence"), method.alias("extraction_method"))


def mentions(documents: DataFrame, nodes: DataFrame | None = None, rules: list[Rule] = RULES, least: float = LEAST) -> DataFrame:
    """(id, confidence, documents): each node that documents name, how sure at best, and in how many; with ``nodes``, those not among them."""
    found = scored_edges(documents, rules, least)
    named = found.groupBy("to_node", "from_node").agg(F.max("confidence").alias("confidence"))
    each = named.groupBy(F.col("to_node").alias("id")).agg(F.max("confidence").alias("confidence"), F.count("*").alias("documents"))
    return each if nodes is None else each.join(nodes.select("id"), "id", "left_anti")
