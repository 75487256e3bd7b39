"""Registered queries of the indexing side over Markdown made of the given tables, with SQL that knows what the files hold."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.functions import columns as C
from loregraph.functions.storage import persisted
from loregraph.operators import budget as B
from loregraph.operators import confidence as K
from loregraph.operators import extract as E
from loregraph.operators import features as T
from loregraph.operators import graph as G
from loregraph.operators import maintain as M
from loregraph.operators import parse as P
from loregraph.operators import vector as V
from loregraph.plans import queries as Q
from loregraph.sources import relmarkdown as R

ROOT = "Entity:Part-1"
HINTS = ["BR:BR-2", "docs/BR-3.md", "CMD-4", "part-5", "Supplier#000000006 x", "no such thing at all", "BR:BR-2", "MACHINERY", "ships CHINA", "specs/EVT-Sold-1.md", "Entity:none", "br-2 part-2"]


def documents(spark, d) -> DataFrame:
    return P.parse_documents(R.files(spark, d))[0]


def stored_documents(spark, d) -> DataFrame:
    """``documents`` written once, for queries that read them several times."""
    return P.parse_documents(R.files(spark, d), stored=True)[0]


def index(spark, d) -> G.Index:
    return E.index_documents(R.files(spark, d))[0]


def node_index(spark, d) -> G.Index:
    """``index`` whose nodes are written once, for queries that look into them several times."""
    return with_stored_nodes(index(spark, d))


def with_stored_nodes(loaded: G.Index) -> G.Index:
    return replace(loaded, nodes=persisted(loaded.nodes, "nodes"))


def md_front_matter(spark, d) -> DataFrame:
    fields, body = P.front_matter(F.col("content"))
    rows = R.files(spark, d).select("path", fields.alias("f"), F.sha2(body, 256).alias("body_hash"))
    field = lambda n: F.try_element_at("f", F.lit(n))
    return rows.select("path", field("kind").alias("kind"), field("id").alias("id"), field("status").alias("status"), F.array_join(P.listed(field("aliases")), "|").alias("aliases"))


def md_sections(spark, d) -> DataFrame:
    rows = documents(spark, d).select("path", F.posexplode("sections").alias("pos", "s"))
    return rows.select("path", "pos", "s.heading", "s.level", "s.content", F.col("s.path").alias("section_path"))


def md_wiki_links(spark, d) -> DataFrame:
    rows = documents(spark, d).select("path", F.posexplode(P.wiki_links(F.expr(E.WHOLE))).alias("pos", "l"))
    return rows.select("path", "pos", "l.target", "l.domain", "l.alias", C.resolve_link(F.col("l.target")).alias("node"))


def md_table_rows(spark, d) -> DataFrame:
    table = P.table_rows(P.find_section(F.col("sections"), "Atributos", "Attributes")["content"])
    rows = documents(spark, d).where("kind = 'entity'").select("path", F.posexplode(table).alias("pos", "row"))
    return rows.select("path", "pos", F.col("row")["Name"].alias("name"), F.col("row")["Value"].alias("value"))


def md_list_items(spark, d) -> DataFrame:
    items = P.list_items(P.find_section(F.col("sections"), "Invariants")["content"])
    return documents(spark, d).where("kind = 'entity'").select("path", F.posexplode(items).alias("pos", "item"))


def md_read_section(spark, d) -> DataFrame:
    """Every file's section with the anchor ``invariants``, its subsections included."""
    rows = R.files(spark, d).select("path", P.read_section(F.col("content"), "invariants").alias("section"))
    return rows.where("section IS NOT NULL")


def md_read_one(spark, d) -> DataFrame:
    """One file's section by path and anchor, the anchor with its accent."""
    return P.read_sections(R.files(spark, d), "specs/01-domain/entities/Part-3.md", "éxtra-notes")


def route_kind(spark, d) -> DataFrame:
    found, skipped = P.parse_documents(R.files(spark, d))
    rows = found.select("path", C.node_id(F.col("kind"), F.col("id")).alias("id"), "layer", "warning")
    return rows.unionByName(skipped, allowMissingColumns=True)


def index_nodes(spark, d) -> DataFrame:
    text = lambda n: F.try_element_at("fields_text", F.lit(n))
    rows = E.nodes_of(documents(spark, d))
    said = F.coalesce(text("description"), text("declaration"), text("purpose"))
    attributes = F.try_element_at("fields_table", F.lit("attributes"))
    return rows.select("id", "kind", "source_file", "source_hash", "layer", "status", F.array_join("aliases", "|").alias("aliases"), said.alias("said"), text("main_flow").alias("main_flow"), F.array_join(F.try_element_at("fields_list", F.lit("invariants")), "|").alias("invariants"), F.array_join(F.transform(attributes, lambda r: r["Value"]), "|").alias("attribute_values"))


def index_edges(spark, d) -> DataFrame:
    rows = E.edges_of(documents(spark, d))
    metadata = F.col("metadata")
    return rows.select("from_node", "to_node", "edge_type", "extraction_method", "layer_violation", "bidirectional", "source_file", metadata["relation"].alias("relation"), metadata["cardinality"].alias("cardinality"))


def index_further_edges(spark, d) -> DataFrame:
    """Edges that are made on request: references to other domains and dependencies between layers."""
    rows = E.edges_of(documents(spark, d), further=True).where("edge_type IN ('CROSS_DOMAIN_REF', 'LAYER_DEPENDENCY')")
    return rows.select("from_node", "to_node", "edge_type")


def index_load(spark, d) -> DataFrame:
    """Loaded edges and orphans of the index by type."""
    loaded = index(spark, d)
    rows = loaded.edges.select("edge_type", F.lit("loaded").alias("state")).unionByName(loaded.orphans.select("edge_type", F.col("reason").alias("state")))
    return rows.groupBy("edge_type", "state").agg(F.count("*").alias("n"))


def index_chunks(spark, d) -> DataFrame:
    rows = E.chunks_of(documents(spark, d))
    return rows.select("id", "document_id", "document_kind", "section_path", "chunk_index", "char_offset", "raw_text", "text_hash", F.sha2("context_text", 256).alias("context_hash"))


def index_paragraph_chunks(spark, d) -> DataFrame:
    return E.paragraph_chunks_of(documents(spark, d)).select("id", "section_path", "raw_text", "context_text")


def budget_chunks(spark, d) -> DataFrame:
    """Chunks within 512 tokens of the orders' files, whose sections are up to 460 words each."""
    rows = B.budget_chunks_of(P.parse_documents(R.order_files(spark, d))[0])
    return rows.select("id", "document_kind", "chunk_index", "section_path", "chunk_type", "tokens", "text_hash")


def scored_edges(spark, d) -> DataFrame:
    return K.scored_edges(documents(spark, d))


def unknown_mentions(spark, d) -> DataFrame:
    """Nodes that files name and that no file is of, with the confidence of their surest mention."""
    rows = stored_documents(spark, d)
    return K.mentions(rows, E.nodes_of(rows))


def index_log(spark, d) -> DataFrame:
    found, skipped = P.parse_documents(R.files(spark, d), stored=True)
    return E.index_log(found, skipped, E.chunks_of(found)).select("path", "success", "node_id", "edge_count", "embedding_count", "skipped_reason")


def index_counters(spark, d) -> DataFrame:
    found, skipped = P.parse_documents(R.files(spark, d), stored=True)
    domain = F.when(F.startswith("path", F.lit("specs/01")), "core").when(F.startswith("path", F.lit("specs/02")), "process")
    return E.index_counters(E.index_log(found, skipped, E.chunks_of(found)), domain).withColumn("domains", F.array_join("domains", ","))


def _snapshot(spark, d, old: bool) -> DataFrame:
    """Parts before (without each tenth) and after (without another tenth; each third is archived)."""
    key = F.regexp_extract("path", r"Part-(\d+)", 1)
    rows = R.files(spark, d).where(key != "").withColumn("key", key.cast("long"))
    if old:
        return rows.where("key % 10 <> 0").drop("key")
    return rows.where("key % 10 <> 1").select("path", F.when(F.col("key") % 3 == 0, F.replace("content", F.lit("status: active"), F.lit("status: archived"))).otherwise(F.col("content")).alias("content"))


def apply_diff(spark, d) -> DataFrame:
    """Nodes with their edges after an incremental run: only changed documents are parsed again."""
    before = E.index_documents(_snapshot(spark, d, True))[0]
    now = _snapshot(spark, d, False)
    hashes = P.parse_documents(now)[0].select(C.node_id(F.col("kind"), F.col("id")).alias("id"), "path", "source_hash")
    diff = persisted(M.snapshot_diff(before.nodes, hashes))
    changed = hashes.join(diff.where("status IN ('A', 'M')"), "id").select("path")
    after = M.apply_diff(before, E.index_documents(now.join(changed, "path", "left_semi"))[0], diff)
    own = after.edges.groupBy(F.col("from_node").alias("id")).agg(F.count("*").alias("edges"))
    return after.nodes.join(own, "id", "left").select("id", "status", F.coalesce("edges", F.lit(0)).alias("edges"))


def cascade_delete(spark, d) -> DataFrame:
    """What stays when each fourth part's document goes, by table."""
    found = stored_documents(spark, d)
    whole = replace(E.index_of(found), embeddings=E.chunks_of(found))
    gone = whole.nodes.where("kind = 'entity'").where(F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 4 == 0).select("id")
    left = M.cascade_delete(whole, gone)
    return Q.stats(left)


def layer_violations_both(spark, d) -> DataFrame:
    """Violations in either direction of links that are walked both ways."""
    loaded = index(spark, d)
    return E.both_directions(loaded.edges, loaded.nodes).where("layer_violation").select("from_node", "to_node", "edge_type")


def layer_violations_filtered(spark, d) -> DataFrame:
    """Violations at business rules that touch the behaviour layer; parts have others."""
    return Q.violations_query(index(spark, d), kinds=["business-rule"], layers=["02-behavior"]).rows


def with_scenarios(spark, d) -> G.Index:
    loaded = index(spark, d)
    found = T.scenarios(R.features(spark, d))
    columns = loaded.edges.columns
    nodes = loaded.nodes.unionByName(T.scenario_nodes(found).drop("text", "tags"), allowMissingColumns=True)
    edges = loaded.edges.select(*columns).unionByName(T.validates_edges(found).select(*columns))
    return with_stored_nodes(G.load_graph(nodes, edges))


def validates_edges(spark, d) -> DataFrame:
    return T.validates_edges(T.scenarios(R.features(spark, d))).select("from_node", "to_node")


def impact_scenarios(spark, d) -> DataFrame:
    return Q.impact_query(with_scenarios(spark, d), ROOT, depth=2).tables["scenarios"].select("node_id", "scenario_name", "reason")


def impact_truncated(spark, d) -> DataFrame:
    """What lies one step beyond the depth of an impact query."""
    return Q.impact_query(index(spark, d), "CMD:CMD-1", depth=1).tables["truncated"].select("node_id")


def resolve_hints(spark, d) -> DataFrame:
    rows = stored_documents(spark, d)
    found, _ = Q.resolve_hints(with_stored_nodes(G.load_graph(E.nodes_of(rows), E.edges_of(rows))), HINTS)  # no edge is read
    return found.select("node_id", "matched_from", "match_method")


def find_spec(spark, d) -> DataFrame:
    """By name (id, alias or title; a mention in a text is none), without vectors: matches that others lead to, and what is near."""
    return Q.find_spec(node_index(spark, d), "BR-2", fields=["title"]).rows.select("node_id", C.rounded(F.col("score")).alias("score"), "match_source")


def context_deep(spark, d) -> DataFrame:
    """A context two steps deep around a rule."""
    rows = Q.context_query(node_index(spark, d), ["BR:BR-2"], depth=2, max_tokens=100_000).rows
    return rows.groupBy("section", "kind", "distance").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def hashed_vectors(spark, d) -> DataFrame:
    """Chunks whose hashed vectors are nearest to a text's, with the node that each belongs to."""
    found = stored_documents(spark, d)
    chunks = V.encode(E.chunks_of(found), V.hashing_encoder())
    query = V.hashing_encoder()(["A STANDARD part. See [[core::Part-8|the next]]."])[0]
    best = persisted(V.cosine_search(chunks, query, 12).select("id", "document_id", "score"))  # a dozen rows, read twice
    return best.join(V.nodes_of_documents(best, E.nodes_of(found).select("id").distinct()), "document_id").select("id", "node_id", C.rounded(F.col("score")).alias("score"))


QUERIES = {f.__name__: f for f in (
    md_front_matter, md_sections, md_wiki_links, md_table_rows, md_list_items, md_read_section, md_read_one, route_kind, index_nodes, index_edges, index_further_edges, index_load, index_chunks,
    index_paragraph_chunks, budget_chunks, scored_edges, unknown_mentions, index_log, index_counters, apply_diff, cascade_delete, layer_violations_both, layer_violations_filtered, validates_edges, impact_scenarios, impact_truncated,
    resolve_hints, find_spec, context_deep, hashed_vectors,
)}

S = R.SQL
_LOADED = """, ids AS (SELECT id FROM md_nodes),
loaded AS (SELECT * FROM md_edges WHERE from_node IN (SELECT id FROM ids) AND to_node IN (SELECT id FROM ids))"""
_EMBEDDED = """, chunked AS (SELECT n.*, s.heading, s.content AS text, s.section_path, CAST(row_number() OVER (PARTITION BY n.id ORDER BY s.pos) - 1 AS INTEGER) AS chunk_index,
    'Document: ' || doc || chr(10) || 'Kind: ' || kind || chr(10) || chr(10) || s.content AS context
  FROM md_nodes n JOIN md_sections s USING (path)
  WHERE (kind = 'entity' AND heading = 'Description') OR (kind = 'business-rule' AND heading IN ('Declaration', 'When Applies')) OR (kind = 'command' AND heading = 'Purpose') OR (kind = 'use-case' AND heading IN ('Description', 'Main Flow')))"""
_LAYERS = "(CASE {0} WHEN '01-domain' THEN 1 ELSE 2 END)"
_LOG = _EMBEDDED + """, logged AS (
  SELECT path, kind <> 'memo' AS success, id AS node_id, (SELECT count(*) FROM md_edges e WHERE e.source_file = f.path) AS edge_count,
    (SELECT count(*) FROM chunked c WHERE c.path = f.path) AS embedding_count, CASE kind WHEN 'memo' THEN 'unknown kind: memo' END AS skipped_reason FROM md_files f)"""

# The surest suggestion of each edge of a file.
_SCORED = """, suggestions AS (
  SELECT id AS from_node, node AS to_node, 'REFERENCES' AS edge_type, path AS source_file, 0.9::DOUBLE AS confidence, 'wiki_link' AS extraction_method FROM md_links
  UNION ALL SELECT id, node, 'REFERENCES', path, 0.8, 'identifier' FROM md_links WHERE node NOT LIKE 'Entity:%'
  UNION ALL SELECT 'CMD:CMD-' || n_nationkey, 'BR:BR-' || (n_nationkey % 10), 'REFERENCES', 'specs/02-behavior/commands/CMD-' || n_nationkey || '.md', 0.8, 'identifier' FROM nation
  UNION ALL SELECT 'CMD:CMD-' || n_nationkey, 'Actor:Buyer' || (n_nationkey % 3), 'REFERENCES', 'specs/02-behavior/commands/CMD-' || n_nationkey || '.md', 0.8, 'named_actor' FROM nation
  UNION ALL SELECT 'BR:BR-' || s_suppkey, unnest(['Entity:Part-' || s_suppkey, 'Event:EVT-Sold-1', 'CMD:CMD-' || (s_suppkey % 25), 'Event:EVT-Sold-1']), unnest(['RELATED_TO', 'RELATED_TO', 'DEPENDS_ON', 'REFERENCES']),
    'specs/01-domain/rules/BR-' || s_suppkey || '.md', 1.0, 'front_matter' FROM supplier),
scored AS (SELECT from_node, to_node, edge_type, source_file, max(confidence) AS confidence, arg_max(extraction_method, confidence) AS extraction_method FROM suggestions WHERE from_node <> to_node GROUP BY ALL)
"""
# Units of the orders' files before small ones are joined: whole processes that fit, lines that fit, or a line and what is below it.
_BUDGET = f"""WITH RECURSIVE lines AS (
  SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {R.LINE_HEAD} || chr(10) || chr(10) || {R.LINE_BODY} || chr(10) || chr(10) || {R.LINE_BELOW}) AS n, l_linenumber, {R.LINE_HEAD} || chr(10) || chr(10) || {R.LINE_BODY} AS own, {R.LINE_BELOW} AS below,
    4 + 6 * CAST(l_quantity AS INT) AS own_words, 5 + 3 * CAST(l_quantity AS INT) AS below_words FROM lineitem),
heads AS (SELECT o_orderkey AS k, CASE o_orderkey % 2 WHEN 0 THEN 'process' ELSE 'requirement' END AS kind, {R.ORDER_HEAD} || chr(10) || chr(10) || {R.ORDER_BODY} AS own, 5 AS own_words FROM orders),
totals AS (SELECT k, sum(own_words + below_words) AS words, string_agg(own || chr(10) || chr(10) || below, chr(10) || chr(10) ORDER BY n) AS texts FROM lines GROUP BY k),
whole AS (SELECT h.k, h.kind, concat_ws(chr(10) || chr(10), own, texts) AS text, own_words + coalesce(words, 0) AS words FROM heads h LEFT JOIN totals t USING (k) WHERE kind = 'process' AND own_words + coalesce(words, 0) <= 393),
parts AS (
  SELECT k, 0 AS n, 0 AS half, own AS text, own_words AS words, EXISTS (SELECT 1 FROM totals t WHERE t.k = h.k) AS leads, 'order-' || k AS path FROM heads h
  UNION ALL SELECT k, n, 0, own || chr(10) || chr(10) || below, own_words + below_words, false, 'order-' || k || '.line-' || l_linenumber FROM lines WHERE own_words + below_words <= 393
  UNION ALL SELECT k, n, 0, own, own_words, true, 'order-' || k || '.line-' || l_linenumber FROM lines WHERE own_words + below_words > 393
  UNION ALL SELECT k, n, 1, below, below_words, false, 'order-' || k || '.line-' || l_linenumber || '.packing' FROM lines WHERE own_words + below_words > 393),
units AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, half) AS u FROM parts WHERE k NOT IN (SELECT k FROM whole)),
joined AS (
  SELECT k, u, 0 AS chunk, words AS total FROM units WHERE u = 1
  UNION ALL SELECT x.k, x.u, CASE WHEN j.total + x.words <= 393 AND (j.total < 39 OR x.words < 39 AND NOT x.leads) THEN chunk ELSE chunk + 1 END,
    CASE WHEN j.total + x.words <= 393 AND (j.total < 39 OR x.words < 39 AND NOT x.leads) THEN j.total + x.words ELSE x.words END FROM joined j JOIN units x ON x.k = j.k AND x.u = j.u + 1),
made AS (SELECT k, chunk, arg_min(path, u) AS section_path, 'full_section' AS chunk_type, sum(words) AS words, string_agg(text, chr(10) || chr(10) ORDER BY u) AS text FROM joined JOIN units USING (k, u) GROUP BY k, chunk
  UNION ALL SELECT k, 0, 'order-' || k, 'process_flow', words, text FROM whole)
SELECT CASE kind WHEN 'process' THEN 'PROC-' ELSE 'REQ-' END || k || ':part-' || chunk AS id, kind AS document_kind, CAST(chunk AS INTEGER) AS chunk_index, section_path, chunk_type, CAST(ceil(words * 13 / 10.0) AS INTEGER) AS tokens, sha256(text) AS text_hash FROM made JOIN heads USING (k)"""

SQL = {
    "budget_chunks": _BUDGET,
    "scored_edges": S + _SCORED + "SELECT * FROM scored",
    "unknown_mentions": S + _SCORED + "SELECT to_node AS id, max(confidence) AS confidence, count(DISTINCT from_node) AS documents FROM scored WHERE to_node NOT IN (SELECT id FROM md_nodes) GROUP BY 1",
    "md_front_matter": S + """SELECT path, kind, doc AS id, CASE WHEN kind IN ('entity', 'business-rule') THEN 'active' END AS status,
  CASE kind WHEN 'entity' THEN regexp_extract(content, 'aliases: \\[([^,]*), ([^\\]]*)\\]', 1) || '|' || regexp_extract(content, 'aliases: \\[([^,]*), ([^\\]]*)\\]', 2) ELSE '' END AS aliases FROM md_files""",
    "md_sections": S + "SELECT path, pos, heading, level, content, section_path FROM md_sections JOIN (SELECT path FROM md_nodes) USING (path)",
    "md_wiki_links": S + "SELECT path, pos, target, domain, alias, node FROM md_links",
    "md_table_rows": "SELECT " + R.SPECS[0].path + " AS path, unnest([{'pos': 0, 'name': 'brand', 'value': p_brand}, {'pos': 1, 'name': 'size', 'value': CAST(p_size AS VARCHAR)}], recursive := true) FROM part",
    "md_list_items": "SELECT " + R.SPECS[0].path + " AS path, unnest([{'pos': 0, 'item': 'size is ' || p_size}, {'pos': 1, 'item': 'brand is ' || p_brand}], recursive := true) FROM part",
    "md_read_section": "SELECT " + R.SPECS[0].path + " AS path, '## Invariants' || chr(10) || chr(10) || '- size is ' || p_size || chr(10) || '* brand is ' || p_brand || chr(10) || chr(10) || '### Éxtra Notes' || chr(10) || chr(10) || 'More.' AS section FROM part",
    "md_read_one": S + "SELECT path, '### Éxtra Notes' || chr(10) || chr(10) || 'More.' AS section FROM md_files WHERE path = 'specs/01-domain/entities/Part-3.md'",
    "route_kind": S + """SELECT path, id, CASE WHEN kind <> 'memo' THEN layer END AS layer, CASE WHEN kind = 'entity' AND layer = '02-behavior' THEN 'expected under 01-domain/entities/' END AS warning,
  CASE kind WHEN 'memo' THEN 'unknown kind: memo' END AS skipped_reason FROM md_files""",
    "index_nodes": S + """, part_of AS (SELECT """ + R.SPECS[0].path + """ AS path, p_brand || '|' || p_type AS aliases, 'size is ' || p_size || '|brand is ' || p_brand AS invariants, p_brand || '|' || p_size AS attribute_values FROM part)
SELECT n.id, n.kind, n.path AS source_file, sha256(n.content) AS source_hash, layer, CASE WHEN kind IN ('entity', 'business-rule') THEN 'active' ELSE 'draft' END AS status, coalesce(aliases, '') AS aliases,
  (SELECT s.content FROM md_sections s WHERE s.path = n.path AND heading IN ('Description', 'Declaration', 'Purpose')) AS said, (SELECT s.content FROM md_sections s WHERE s.path = n.path AND heading = 'Main Flow') AS main_flow, invariants, attribute_values
FROM md_nodes n LEFT JOIN part_of USING (path)""",
    "index_edges": S + "SELECT *, CASE edge_type WHEN 'DOMAIN_RELATION' THEN 'follows' END AS relation, CASE edge_type WHEN 'DOMAIN_RELATION' THEN 'N:1' END AS cardinality FROM md_edges",
    "index_further_edges": S + f"""SELECT DISTINCT id AS from_node, domain || ':' || node AS to_node, 'CROSS_DOMAIN_REF' AS edge_type FROM md_links WHERE domain IS NOT NULL
UNION ALL SELECT DISTINCT id, node, 'LAYER_DEPENDENCY' FROM md_links WHERE layer = '02-behavior' AND {R.LATER} = 1""",
    "index_load": S + """, marked AS (SELECT edge_type, CASE WHEN to_node IN (SELECT id FROM md_nodes) THEN 'loaded' ELSE 'missing_target' END AS state FROM md_edges)
SELECT edge_type, state, count(*) AS n FROM marked GROUP BY 1, 2""",
    "index_chunks": S + _EMBEDDED + """SELECT doc || ':chunk-' || chunk_index AS id, doc AS document_id, kind AS document_kind, section_path, chunk_index, CAST(0 AS INTEGER) AS char_offset, text AS raw_text, sha256(text) AS text_hash, sha256(context) AS context_hash FROM chunked""",
    "index_paragraph_chunks": S + _EMBEDDED + """, tops AS (SELECT path, heading AS top, content AS top_text FROM md_sections WHERE level = 1)
SELECT doc || ':chunk-' || chunk_index AS id, section_path, text AS raw_text, '[' || kind || ': ' || doc || ']' || chr(10) || CASE WHEN top_text <> '' THEN top_text ELSE top END || chr(10) || text AS context_text FROM chunked JOIN tops USING (path)""",
    "index_log": S + _LOG + "SELECT * FROM logged",
    "index_counters": S + _LOG + "SELECT count_if(success) AS nodes, CAST(sum(edge_count) AS BIGINT) AS edges, CAST(sum(embedding_count) AS BIGINT) AS embeddings, count_if(NOT success) AS skipped, 'core,process' AS domains FROM logged",
    "apply_diff": S + """, parts AS (SELECT id, CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) AS key FROM md_nodes WHERE kind = 'entity'), kept AS (SELECT * FROM parts WHERE key % 10 <> 1)
SELECT id, CASE key % 3 WHEN 0 THEN 'archived' ELSE 'active' END AS status, (SELECT count(*) FROM md_edges e WHERE e.from_node = kept.id AND e.to_node IN (SELECT id FROM kept)) AS edges FROM kept""",
    "cascade_delete": S + _LOADED.replace("FROM md_nodes)", "FROM md_nodes WHERE NOT (kind = 'entity' AND CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) % 4 = 0))") + _EMBEDDED + """, gone AS (SELECT id FROM md_nodes WHERE id NOT IN (SELECT id FROM ids))
SELECT 'nodes' AS what, count(*) AS n FROM ids UNION ALL SELECT 'edges', count(*) FROM loaded
UNION ALL SELECT 'orphans', count(*) FROM md_edges WHERE to_node NOT IN (SELECT id FROM md_nodes) AND from_node NOT IN (SELECT id FROM gone) UNION ALL SELECT 'embeddings', count(*) FROM chunked WHERE id NOT IN (SELECT id FROM gone)""",
    "layer_violations_both": S + _LOADED + f""", ends AS (SELECT l.*, {_LAYERS.format('a.layer')} AS x, {_LAYERS.format('b.layer')} AS y FROM loaded l JOIN md_nodes a ON a.id = from_node JOIN md_nodes b ON b.id = to_node)
SELECT from_node, to_node, edge_type FROM ends WHERE x < y UNION ALL SELECT to_node, from_node, edge_type FROM ends WHERE bidirectional AND y < x""",
    "layer_violations_filtered": S + _LOADED + "SELECT from_node, to_node, '01-domain' AS from_layer, '02-behavior' AS to_layer, edge_type FROM loaded WHERE layer_violation AND from_node LIKE 'BR:%'",
    "validates_edges": """SELECT 'Scenario:S' || s_suppkey || '#1' AS from_node, 'BR:BR-' || s_suppkey AS to_node FROM supplier UNION ALL SELECT 'Scenario:S' || s_suppkey || '#2', 'BR:BR-' || s_suppkey FROM supplier
UNION ALL SELECT 'Scenario:S' || s_suppkey || '#2', 'UC:UC-' || (s_suppkey % 7) FROM supplier UNION ALL SELECT 'Scenario:S' || s_suppkey || '#2', 'CMD:CMD-' || (s_suppkey % 25) FROM supplier""",
    "impact_scenarios": S + _LOADED + f""", validates AS (SELECT 'Scenario:S' || s_suppkey || '#' || i AS from_node, CASE k WHEN 0 THEN 'BR:BR-' || s_suppkey WHEN 1 THEN 'UC:UC-' || (s_suppkey % 7) ELSE 'CMD:CMD-' || (s_suppkey % 25) END AS to_node, i
  FROM supplier, (VALUES (1, 0), (2, 0), (2, 1), (2, 2)) v(i, k)),
whole AS (SELECT from_node, to_node FROM loaded UNION ALL SELECT from_node, to_node FROM validates WHERE to_node IN (SELECT id FROM ids)),
hit AS (SELECT '{ROOT}' AS id UNION SELECT from_node FROM whole WHERE to_node = '{ROOT}' UNION SELECT b.from_node FROM whole a JOIN whole b ON b.to_node = a.from_node WHERE a.to_node = '{ROOT}')
SELECT from_node AS node_id, CASE i WHEN 1 THEN 'holds' ELSE 'breaks' END AS scenario_name, 'Validates ' || to_node || ' which is affected' AS reason FROM validates WHERE to_node IN (SELECT id FROM hit) AND to_node IN (SELECT id FROM ids)""",
    "impact_truncated": S + _LOADED + """, hit AS (SELECT DISTINCT from_node AS id FROM loaded WHERE to_node = 'CMD:CMD-1')
SELECT DISTINCT from_node AS node_id FROM loaded WHERE to_node IN (SELECT id FROM hit) AND from_node NOT IN (SELECT id FROM hit) AND from_node <> 'CMD:CMD-1'""",
    "find_spec": S + _LOADED + """, steps AS (SELECT from_node AS id, to_node AS nxt FROM loaded WHERE NOT layer_violation UNION SELECT to_node, from_node FROM loaded WHERE NOT layer_violation),
seeds AS (SELECT id FROM ids WHERE contains(lower(id), 'br-2')),
pairs AS (SELECT s.id AS seed, t.nxt AS id FROM seeds s JOIN steps t ON t.id = s.id UNION SELECT s.id, u.nxt FROM seeds s JOIN steps t ON t.id = s.id JOIN steps u ON u.id = t.nxt),
scored AS (SELECT id, CASE WHEN id IN (SELECT id FROM seeds) THEN 0.25::DOUBLE ELSE 0.125::DOUBLE END AS score FROM (SELECT DISTINCT id FROM pairs WHERE id <> seed))
SELECT id AS node_id, score, 'graph' AS match_source FROM scored ORDER BY score DESC, id LIMIT 5""",
    "resolve_hints": S + f""", texts AS (
  SELECT id, lower(id) AS t FROM md_nodes UNION ALL SELECT 'Entity:Part-' || p_partkey, unnest([lower(p_brand), lower(p_type)]) FROM part
  UNION ALL SELECT n.id, lower(s.content) FROM md_nodes n JOIN md_sections s USING (path) WHERE heading IN ('Description', 'Invariants', 'Main Flow', 'Declaration', 'When Applies', 'Purpose') OR (kind = 'command' AND heading = 'Postconditions')),
hints AS (SELECT unnest({HINTS}) AS hint, generate_subscripts({HINTS}, 1) AS seq),
named AS (SELECT *, regexp_replace(regexp_extract(hint, '[^/]*$'), '(.)[.][^.]*$', '\\1') AS base, hint LIKE '%/%' OR hint LIKE '%.%' AS is_path, hint LIKE '%:%' AS is_id, string_split_regex(hint, ' +') AS words FROM hints),
variants AS (SELECT seq, p || ':' || n AS id FROM (SELECT seq, unnest([CASE WHEN is_path THEN base ELSE hint END, upper((CASE WHEN is_path THEN base ELSE hint END)[1]) || (CASE WHEN is_path THEN base ELSE hint END)[2:]]) AS n FROM named WHERE NOT is_id OR is_path), (SELECT unnest(['Entity', 'BR', 'UC', 'CMD']) AS p)),
found AS (
  SELECT seq, 0 AS try, 'exact' AS method, id FROM named JOIN md_nodes ON is_id AND id = hint
  UNION SELECT seq, 1, CASE WHEN is_path THEN 'basename' ELSE 'exact' END, id FROM named JOIN variants USING (seq) JOIN md_nodes USING (id)
  UNION SELECT seq, 2, 'text_search', id FROM named JOIN texts ON is_path AND contains(t, lower(base))
  UNION SELECT seq, 3, 'text_search', id FROM named JOIN texts ON len(words) = 1 AND contains(t, lower(hint))
  UNION SELECT seq, 3, 'text_search', id FROM named JOIN texts x ON len(words) > 1 AND contains(t, lower(words[1])) WHERE (SELECT bool_and(contains((SELECT string_agg(y.t, ' ') FROM texts y WHERE y.id = x.id), lower(w))) FROM (SELECT unnest(words[2:]) AS w))),
first_tries AS (SELECT seq, min(try) AS try FROM found GROUP BY seq)
SELECT id AS node_id, arg_min(hint, seq) AS matched_from, arg_min(method, seq) AS match_method FROM found JOIN first_tries USING (seq, try) JOIN named USING (seq) GROUP BY id""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
