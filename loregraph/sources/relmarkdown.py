"""The relational tables as a tree of Markdown specifications: a file for each part, customer, supplier, nation and region.

A file is told by expressions that Spark and other SQL engines read alike: its path, its front
matter, its sections (heading, level, text, anchors) and the links in them.  ``files`` puts them
together as text; ``SQL`` has the same parts as tables, so that what parsing gives can be checked
without parsing.  Regions are of a kind that no one knows, and parts above size 45 lie in a folder
where they aren't expected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.functions.storage import spread

#: Files that a task makes and parses: their rows are far smaller than they are.
FILES = 10_000


@dataclass(frozen=True)
class Spec:
    """Expressions over one table's rows."""

    kind: str
    table: str
    path: str
    layer: str
    node: str
    name: str  # what the id says after the prefix
    front: list[tuple[str, str]]
    sections: list[tuple[str, int, str, str]]  # heading, level, text, path of anchors
    links: list[tuple[str, str, str, str]]  # target, domain, alias, node that it names
    lead: str = "''"


PART_TOP = "replace(p_name, ' ', '-')"
CUSTOMER_TOP = "replace(lower(c_name), '#', '')"
SUPPLIER_TOP = "replace(lower(s_name), '#', '')"
SPECS = [
    Spec(
        "entity", "part",
        "CASE WHEN p_size <= 45 THEN 'specs/01-domain/entities/' ELSE 'specs/02-behavior/' END || 'Part-' || p_partkey || '.md'", "CASE WHEN p_size <= 45 THEN '01-domain' ELSE '02-behavior' END",
        "'Entity:Part-' || p_partkey", "'Part-' || p_partkey",
        [("kind", "'entity'"), ("id", "'Part-' || p_partkey"), ("aliases", "'[' || p_brand || ', ' || p_type || ']'"), ("status", "'active'")],
        [
            ("p_name", 1, "'Sold in [[UC-' || (p_partkey % 7) || ']] by [[Supplier-' || (p_partkey % 10) || '|its maker]].'", PART_TOP),
            ("'Description'", 2, "'A ' || p_type || ' part. See [[core::Part-' || (p_partkey + 1) || '|the next]].'", f"{PART_TOP} || '.description'"),
            ("'Attributes'", 2, "'| Name | Value |\n|---|---|\n| brand | ' || p_brand || ' |\n| size | ' || p_size || ' |'", f"{PART_TOP} || '.attributes'"),
            ("'Relations'", 2, "'| Relation | With | Cardinality |\n|---|---|---|\n| follows | [[Part-' || (p_partkey + 1) || ']] | N:1 |'", f"{PART_TOP} || '.relations'"),
            ("'Invariants'", 2, "'- size is ' || p_size || '\n* brand is ' || p_brand", f"{PART_TOP} || '.invariants'"),
            ("'Éxtra Notes'", 3, "'More.'", f"{PART_TOP} || '.invariants.extra-notes'"),
            ("'Lifecycle Events'", 2, "'[[EVT-Sold-' || (p_partkey % 5) || ']]'", f"{PART_TOP} || '.lifecycle-events'"),
        ],
        [
            ("'UC-' || (p_partkey % 7)", "NULL", "NULL", "'UC:UC-' || (p_partkey % 7)"), ("'Supplier-' || (p_partkey % 10)", "NULL", "'its maker'", "'Entity:Supplier-' || (p_partkey % 10)"),
            ("'Part-' || (p_partkey + 1)", "'core'", "'the next'", "'Entity:Part-' || (p_partkey + 1)"), ("'Part-' || (p_partkey + 1)", "NULL", "NULL", "'Entity:Part-' || (p_partkey + 1)"),
            ("'EVT-Sold-' || (p_partkey % 5)", "NULL", "NULL", "'Event:EVT-Sold-' || (p_partkey % 5)"),
        ],
        "'lost line\n'",
    ),
    Spec(
        "use-case", "customer", "'specs/02-behavior/use-cases/UC-' || c_custkey || '.md'", "'02-behavior'", "'UC:UC-' || c_custkey", "'UC-' || c_custkey",
        [("kind", "'use-case'"), ("id", "'UC-' || c_custkey")],
        [
            ("c_name", 1, "''", CUSTOMER_TOP),
            ("'Description'", 2, "c_name || ' buys [[Part-' || c_custkey || ']].'", f"{CUSTOMER_TOP} || '.description'"),
            ("'Main Flow'", 2, "'1. Pays ' || c_mktsegment || '.'", f"{CUSTOMER_TOP} || '.main-flow'"),
            ("'Applied Rules'", 2, "'[[BR-' || (c_custkey % 10) || ']] and [[Part-1]]'", f"{CUSTOMER_TOP} || '.applied-rules'"),
            ("'Rules Applied'", 2, "'[[BR-99999]]'", f"{CUSTOMER_TOP} || '.rules-applied'"),
            ("'Commands Executed'", 2, "'[[CMD-' || c_nationkey || ']]'", f"{CUSTOMER_TOP} || '.commands-executed'"),
            ("'Story'", 2, "'[[OBJ-1|goal]]'", f"{CUSTOMER_TOP} || '.story'"),
        ],
        [
            ("'Part-' || c_custkey", "NULL", "NULL", "'Entity:Part-' || c_custkey"), ("'BR-' || (c_custkey % 10)", "NULL", "NULL", "'BR:BR-' || (c_custkey % 10)"), ("'Part-1'", "NULL", "NULL", "'Entity:Part-1'"),
            ("'BR-99999'", "NULL", "NULL", "'BR:BR-99999'"), ("'CMD-' || c_nationkey", "NULL", "NULL", "'CMD:CMD-' || c_nationkey"), ("'OBJ-1'", "NULL", "'goal'", "'OBJ:OBJ-1'"),
        ],
    ),
    Spec(
        "business-rule", "supplier", "'specs/01-domain/rules/BR-' || s_suppkey || '.md'", "'01-domain'", "'BR:BR-' || s_suppkey", "'BR-' || s_suppkey",
        [("kind", "'business-rule'"), ("id", "'BR-' || s_suppkey"), ("status", "'active'"), ("related", "'[Part-' || s_suppkey || ', EVT-Sold-1]'"), ("depends_on", "'CMD-' || (s_suppkey % 25)"), ("references", "'EVT-Sold-1'")],
        [
            ("s_name", 1, "''", SUPPLIER_TOP),
            ("'Declaration'", 2, "'Holds for [[Part-' || s_suppkey || ']] and [[EVT-Sold-1]].'", f"{SUPPLIER_TOP} || '.declaration'"),
            ("'When Applies'", 2, "'Always in [[CMD-' || (s_suppkey % 25) || ']].'", f"{SUPPLIER_TOP} || '.when-applies'"),
        ],
        [("'Part-' || s_suppkey", "NULL", "NULL", "'Entity:Part-' || s_suppkey"), ("'EVT-Sold-1'", "NULL", "NULL", "'Event:EVT-Sold-1'"), ("'CMD-' || (s_suppkey % 25)", "NULL", "NULL", "'CMD:CMD-' || (s_suppkey % 25)")],
    ),
    Spec(
        "command", "nation", "'specs/02-behavior/commands/CMD-' || n_nationkey || '.md'", "'02-behavior'", "'CMD:CMD-' || n_nationkey", "'CMD-' || n_nationkey",
        [("kind", "'command'"), ("id", "'CMD-' || n_nationkey")],
        [
            ("n_name", 1, "''", "lower(n_name)"),
            ("'Purpose'", 2, "'Ships to ' || n_name || ' for user Buyer' || (n_nationkey % 3) || ' under BR-' || (n_nationkey % 10) || '.'", "lower(n_name) || '.purpose'"),
            ("'Input'", 2, "'| Name | Type |\n|---|---|\n| key | ' || n_nationkey || ' |'", "lower(n_name) || '.input'"),
            ("'Postconditions'", 2, "'Emits [[EVT-Sold-' || (n_nationkey % 5) || ']] and [[EVT-Sold-' || (n_nationkey % 5) || '|again]].'", "lower(n_name) || '.postconditions'"),
        ],
        [("'EVT-Sold-' || (n_nationkey % 5)", "NULL", a, "'Event:EVT-Sold-' || (n_nationkey % 5)") for a in ("NULL", "'again'")],
    ),
    Spec("memo", "region", "'specs/notes/' || r_regionkey || '.md'", "'01-domain'", "NULL", "NULL", [("kind", "'memo'")], [("r_name", 1, "''", "lower(r_name)")], []),
]


def content(spec: Spec) -> str:
    """The expression of a file's text."""
    front = " || ".join(["'---\n'", *[f"'{k}: ' || {v} || '\n'" for k, v in spec.front], "'---\n'"])
    return " || ".join([front, spec.lead, *[f"'{'#' * level} ' || {heading} || '\n\n' || {text} || '\n\n'" for heading, level, text, _ in spec.sections]])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of all files."""
    made = None
    for spec in SPECS:
        rows = spark.read.parquet(f"{sf_dir}/{spec.table}.parquet")
        rows = spread(rows, rows.columns[0], FILES).select(F.expr(spec.path).alias("path"), F.expr(content(spec)).alias("content"))
        made = rows if made is None else made.unionByName(rows)
    return made


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of a file for each order, of a process or a requirement: a section for each of its lines, with one below it."""
    folder = F.expr("CASE o_orderkey % 2 WHEN 0 THEN 'specs/02-behavior/processes/PROC-' ELSE 'specs/04-verification/criteria/REQ-' END")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", F.expr(f"{LINE_HEAD} || '\n\n' || {LINE_BODY} || '\n\n' || {LINE_BELOW}").alias("text")).alias("line"))
    grouped = lines.groupBy("o_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").join(grouped, "o_orderkey", "left")
    below = F.array_join(F.transform("lines", lambda x: x["text"]), "\n\n")
    front = F.expr("'---\nkind: ' || CASE o_orderkey % 2 WHEN 0 THEN 'process' ELSE 'requirement' END || '\n---\n'")
    return orders.select(F.concat(folder, "o_orderkey", F.lit(".md")).alias("path"), F.concat_ws("\n\n", F.concat(front, F.expr(ORDER_HEAD)), F.expr(ORDER_BODY), below).alias("content"))


#: What an order's file says, in expressions that Spark and other SQL engines read alike.
ORDER_HEAD, ORDER_BODY = "'# Order-' || o_orderkey", "'Placed by [[UC-' || o_custkey || ']].'"
LINE_HEAD, LINE_BODY = "'## Line ' || l_linenumber", "'Pick' || repeat(' ' || l_returnflag, 6 * CAST(l_quantity AS INT))"
LINE_BELOW = "'### Packing\n\nPack' || repeat(' ' || l_linestatus, 3 * CAST(l_quantity AS INT)) || '\n\nof supplier-' || l_suppkey"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of a feature file for each supplier, whose two scenarios validate its rule and a use case."""
    text = "'@BR-' || s_suppkey || '\nFeature: ' || s_name || '\n\n  Scenario: holds\n    Given a part\n\n  @UC-' || (s_suppkey % 7) || '\n  Scenario: breaks\n    Then [[CMD-' || (s_suppkey % 25) || ']] stops\n'"
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.expr("'specs/04-verification/S' || s_suppkey || '.feature'").alias("path"), F.expr(text).alias("content"))


def _union(select) -> str:
    return "\n  UNION ALL ".join(select(spec) for spec in SPECS)


def _edges_of(spec: Spec) -> list[tuple[str, str, str]]:
    """(target node, type, method) of a spec's typed edges."""
    named = {
        "entity": [(4, "EMITS", "wiki_link"), (3, "DOMAIN_RELATION", "section_content")], "use-case": [(1, "UC_APPLIES_RULE", "wiki_link"), (4, "UC_EXECUTES_CMD", "wiki_link"), (5, "UC_STORY", "wiki_link")],
        "business-rule": [(0, "ENTITY_RULE", "wiki_link")], "command": [(0, "EMITS", "wiki_link")],
    }
    return [(spec.links[i][3], kind, method) for i, kind, method in named.get(spec.kind, [])]


LATER = "CASE WHEN node LIKE 'UC:%' OR node LIKE 'CMD:%' THEN 2 WHEN node LIKE 'OBJ:%' THEN 0 ELSE 1 END"
#: What the files hold, as common table expressions: md_files, md_sections, md_links, md_nodes, md_edges.
SQL = f"""WITH md_files AS (
  {_union(lambda s: f"SELECT {s.path} AS path, '{s.kind}' AS kind, {s.layer} AS layer, {s.node} AS id, {s.name} AS doc, {content(s)} AS content FROM {s.table}")}),
md_sections AS (
  {_union(lambda s: f'''SELECT {s.path} AS path, unnest([{", ".join(f"{{'pos': {i}, 'heading': {h}, 'level': {n}, 'content': {t}, 'section_path': {p}}}" for i, (h, n, t, p) in enumerate(s.sections))}], recursive := true) FROM {s.table}''')}),
md_links AS (
  {"""
  UNION ALL """.join(f'''SELECT {s.path} AS path, {s.node} AS id, {s.layer} AS layer, unnest([{", ".join(f"{{'pos': {i}, 'target': {t}, 'domain': CAST({d} AS VARCHAR), 'alias': CAST({a} AS VARCHAR), 'node': {n}}}" for i, (t, d, a, n) in enumerate(s.links))}], recursive := true) FROM {s.table}''' for s in SPECS if s.links)}),
md_nodes AS (SELECT path, kind, layer, id, doc, content FROM md_files WHERE kind <> 'memo'),
md_edges AS (
  SELECT DISTINCT id AS from_node, node AS to_node, 'WIKI_LINK' AS edge_type, 'wiki_link' AS extraction_method, layer = '01-domain' AND {LATER} = 2 AS layer_violation, true AS bidirectional, path AS source_file FROM md_links
  UNION ALL {"""
  UNION ALL """.join(f"SELECT DISTINCT {s.node}, {t}, '{k}', '{m}', false, false, {s.path} FROM {s.table}" for s in SPECS for t, k, m in _edges_of(s))})
"""
