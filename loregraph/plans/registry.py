"""Names of the engine's registered queries, each with its SQL twin where one exists."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.functions import columns as C
from loregraph.operators import graph as G
from loregraph.operators import maintain as M
from loregraph.operators import rank as P
from loregraph.operators import vector as V
from loregraph.operators.access import restricted
from loregraph.plans import queries as Q
from loregraph.plans import document_registry, spec_registry
from loregraph.sources import relgraph as R

FLAGSHIP = "hybrid_fused"

CUSTOMER_RULES = [("customer", "orders", "PLACED_BY"), ("customer", "places", "IN_NATION"), ("customer", "latest", "LATEST_ORDER"), ("customer", "returns", "RETURNS")]
PREFIXES = ["Region", "Nation", "Supplier", "Customer", "Part", "Orders"]
TEXT = "brand#12"


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return R.embeddings(spark, sf_dir).where("vec_id = 0").first()["vector"]


def orphan_edges(spark, d) -> DataFrame:
    return Q.orphans_query(R.index(spark, d)).rows.select("from_node", "to_node", "edge_type", "from_exists", "to_exists", "reason")


def orphan_edges_typed(spark, d) -> DataFrame:
    return Q.orphans_query(R.index(spark, d), ["PLACED_BY"]).tables["summary"]


def orphan_rate(spark, d) -> DataFrame:
    return Q.orphans_query(R.index(spark, d)).tables["summary"]


def load_graph(spark, d) -> DataFrame:
    return R.index(spark, d).edges.select("edge_seq", "from_node", "to_node", "edge_type", "layer_violation")


def stored_edges(spark, d) -> DataFrame:
    """The loaded edges as the session's walk store has them, from the side of their ends."""
    return R.stored(spark, d).adjacency.back.select("edge_seq", "from_node", "to_node", "edge_type", "layer_violation")


def layer_violations(spark, d) -> DataFrame:
    return Q.violations_query(R.index(spark, d)).rows


def violation_rate(spark, d) -> DataFrame:
    return Q.violations_query(R.index(spark, d)).tables["summary"]


def coverage_customer(spark, d) -> DataFrame:
    rows = Q.coverage_query(R.stored(spark, d), "Customer:1", CUSTOMER_RULES).rows
    return rows.select("name", "edge_type", "status", F.array_join("found", ",").alias("found"))


def coverage_percent(spark, d) -> DataFrame:
    return Q.coverage_query(R.stored(spark, d), "Customer:1", CUSTOMER_RULES).tables["summary"]


def coverage_all(spark, d) -> DataFrame:
    """The rate of met rules of every customer at once."""
    index = R.index(spark, d)
    own = index.nodes.where("kind = 'customer'").select("id")
    rules = spark.createDataFrame([(e,) for _, _, e in CUSTOMER_RULES], "edge_type string")
    ends = index.edges.select(F.col("from_node").alias("id"), "edge_type").unionByName(index.edges.select(F.col("to_node").alias("id"), "edge_type"))
    met = ends.join(F.broadcast(rules), "edge_type").join(own, "id").groupBy("id").agg(F.count_distinct("edge_type").alias("present"))
    counted = own.join(met, "id", "left").select("id", F.coalesce("present", F.lit(0)).cast("bigint").alias("present"))
    return counted.withColumn("coverage_percent", C.percent(F.col("present"), F.lit(len(CUSTOMER_RULES)), 1))


def incoming_edges(spark, d) -> DataFrame:
    return G.incoming(R.stored(spark, d).edges, "Nation:3").select("from_node", "edge_type")


def outgoing_edges(spark, d) -> DataFrame:
    return G.outgoing(R.stored(spark, d).edges, "Customer:1").select("to_node", "edge_type")


def _bfs(depth: int, **options):
    def run(spark, d) -> DataFrame:
        rows = Q.graph_query(R.stored(spark, d), "Supplier:1", depth, **options).rows
        return rows.select("node_id", C.rounded(F.col("score")).alias("score"), "snippet")

    return run


def _bfs_sql(depth: int, steps: str = "steps", where: str = "") -> str:
    return R.SQL + f""", walk AS (SELECT 'Supplier:1' AS id, 0 AS dist UNION SELECT s.nxt, w.dist + 1 FROM walk w JOIN {steps} s ON w.id = s.id WHERE w.dist < {depth})
SELECT n.id AS node_id, floor(1 / (1 + min(dist)) * 1e6 + 0.5) / 1e6 AS score, '[' || any_value(kind) || '] ' || n.id AS snippet
FROM walk w JOIN nodes n ON w.id = n.id {where} GROUP BY n.id HAVING min(dist) > 0"""


def labelled_nodes(nodes: DataFrame) -> DataFrame:
    """Customers of even keys are secret, and each third supplier is for operators."""
    key = F.substring_index("id", ":", -1).cast("bigint")
    none = F.array().cast("array<string>")
    return nodes.withColumn("access", F.when((F.col("kind") == "customer") & (key % 2 == 0), F.array(F.lit("secret"))).when((F.col("kind") == "supplier") & (key % 3 == 0), F.array(F.lit("ops"), F.lit("audit"))).otherwise(none))


def graph_bfs_labels(spark, d) -> DataFrame:
    """A walk of a reader who has the label ops only."""
    index = R.stored(spark, d)
    seen = restricted(replace(index, nodes=labelled_nodes(index.nodes)), ["ops"])
    return Q.graph_query(seen, "Supplier:1", 3, respect_layers=False).rows.select("node_id", C.rounded(F.col("score")).alias("score"))


LABELS_SQL = R.SQL + """, seen AS (SELECT id, kind FROM nodes WHERE NOT (kind = 'customer' AND CAST(split_part(id, ':', 2) AS BIGINT) % 2 = 0)),
seensteps AS (SELECT s.id, s.nxt FROM allsteps s WHERE s.id IN (SELECT id FROM seen) AND s.nxt IN (SELECT id FROM seen)),
walk AS (SELECT 'Supplier:1' AS id, 0 AS dist UNION SELECT s.nxt, w.dist + 1 FROM walk w JOIN seensteps s ON w.id = s.id WHERE w.dist < 3)
SELECT id AS node_id, floor(1 / (1 + min(dist)) * 1e6 + 0.5) / 1e6 AS score FROM walk GROUP BY id HAVING min(dist) > 0"""


def chunk_changes(spark, d) -> DataFrame:
    """Documents as chunks before and after: some are gone, some have a new text, some stand under another id."""
    docs = R.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("context_text"))
    now = docs.where("id % 10 <> 7").select(F.when(F.col("id") % 10 == 3, F.col("id") + 1_000_000_000).otherwise(F.col("id")).alias("id"), F.when(F.col("id") % 10 == 5, F.concat("context_text", F.lit(" edited"))).otherwise(F.col("context_text")).alias("context_text"))
    return M.chunk_changes(docs, now)


CHUNKS_SQL = """WITH before AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS h FROM documents),
after AS (SELECT CASE WHEN doc_id % 10 = 3 THEN doc_id + 1000000000 ELSE doc_id END AS id, sha256(CASE WHEN doc_id % 10 = 5 THEN coalesce(text || ' edited', '') ELSE coalesce(text, '') END) AS h FROM documents WHERE doc_id % 10 <> 7)
SELECT id, CASE WHEN a.h IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' WHEN a.h IN (SELECT h FROM before) THEN 'moved' ELSE 'new' END AS status FROM before b FULL JOIN after a USING (id)"""


def graph_bfs_edges(spark, d) -> DataFrame:
    return Q.graph_query(R.stored(spark, d), "Supplier:1", 2).tables["edges"].select("from_node", "to_node", "edge_type")


def impact_direct(spark, d) -> DataFrame:
    return Q.impact_query(R.stored(spark, d), "Supplier:1").rows


def impact_transitive(spark, d) -> DataFrame:
    rows = Q.impact_query(R.stored(spark, d), "Supplier:1", depth=3).tables["transitive"]
    return rows.select("node_id", "kind", F.array_join("path", ">").alias("path"), F.array_join("edge_types", ">").alias("edge_types"))


def _impact_level(level: int) -> str:
    seen = " ".join(f"AND e.from_node NOT IN (SELECT id FROM l{i})" for i in range(level))
    return f""", l{level} AS (SELECT id, list_append(path, id) AS path, list_append(types, edge_type) AS types, list_append(found, {{'seq': edge_seq, 'id': id}}) AS found
  FROM (SELECT e.from_node AS id, e.edge_type, e.edge_seq, p.path, p.types, p.found FROM l{level - 1} p JOIN edges e ON e.to_node = p.id WHERE true {seen})
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY found, edge_seq, edge_type) = 1)"""


IMPACT_SQL = (
    R.SQL + ", l0 AS (SELECT 'Supplier:1' AS id, ['Supplier:1'] AS path, CAST([] AS VARCHAR[]) AS types, CAST([] AS STRUCT(seq INTEGER, id VARCHAR)[]) AS found)" + "".join(map(_impact_level, (1, 2, 3)))
    + """ SELECT w.id AS node_id, n.kind, array_to_string(path[1:len(path) - 1], '>') AS path, array_to_string(types, '>') AS edge_types
FROM (SELECT id, path, types FROM l2 UNION ALL SELECT id, path, types FROM l3) w JOIN nodes n ON n.id = w.id"""
)


def cosine_topk(spark, d) -> DataFrame:
    rows = V.cosine_search(R.embeddings(spark, d), query_vector(spark, d), 20)
    return rows.select("id", C.rounded(F.col("score")).alias("score"))


def cosine_topk_cells(spark, d) -> DataFrame:
    """The same from the store's cells: only those that can have one of the best are read."""
    rows = R.stored(spark, d).near.search_exact(query_vector(spark, d), 20)
    return rows.select("id", C.rounded(F.col("score")).alias("score"))


def cosine_threshold(spark, d) -> DataFrame:
    vector = F.array(*[F.lit(x) for x in query_vector(spark, d)])
    scored = R.embeddings(spark, d).withColumn("score", C.cosine(F.col("vector"), vector))
    return scored.where("score >= 0.2").select("id", C.rounded(F.col("score")).alias("score"))


def _named(index: G.Index) -> G.Index:
    """The projected documents are customers: their chunks are named by node."""
    return replace(index, embeddings=index.embeddings.withColumn("id", F.concat(F.lit("Customer:"), "id")))


def semantic_best_chunk(spark, d) -> DataFrame:
    rows = Q.semantic_query(_named(R.stored(spark, d)), query_vector(spark, d), kinds=["customer"], min_score=0.0, limit=8).rows
    return rows.select("node_id", C.rounded(F.col("score")).alias("score"), "snippet")


def lexical_search(spark, d) -> DataFrame:
    return Q.text_search(R.nodes(spark, d), TEXT).select("id", "kind")


def lexical_fields(spark, d) -> DataFrame:
    return Q.text_search(R.nodes(spark, d), "er", ["brand"]).select("id", "kind")


def lexical_all_words(spark, d) -> DataFrame:
    return Q.all_words_search(R.nodes(spark, d), ["Brand#1", "part"]).select("id", "kind")


def lexical_search_indexed(spark, d) -> DataFrame:
    return R.stored(spark, d).texts.search(TEXT).select("id", "kind")


def lexical_words_indexed(spark, d) -> DataFrame:
    return R.stored(spark, d).texts.search_words(["Brand#1", "part"]).select("id", "kind")


RANK_SEEDS = [("Supplier:1", 1.0), ("Customer:1", 3.0), ("Region:0", 0.5)]
RANK_WEIGHTS = {"CONTAINS": 2.0, "IN_NATION": 0.5}
RANK_ROUNDS = 6


def personal_rank(spark, d) -> DataFrame:
    """Personalised ranks over the loaded edges after a fixed number of rounds."""
    seeds = spark.createDataFrame(RANK_SEEDS, "id string, weight double")
    rank, _ = P.personal_rank(R.stored(spark, d).edges, seeds, 0.85, -1.0, RANK_ROUNDS, RANK_WEIGHTS)
    return rank.select("id", C.rounded(F.col("rank")).alias("rank"))


def _rank_sql() -> str:
    weights = " ".join(f"WHEN '{t}' THEN {w}::DOUBLE" for t, w in RANK_WEIGHTS.items())
    seeds = ", ".join(f"('{i}', {w}::DOUBLE)" for i, w in RANK_SEEDS)
    rounds = "".join(
        f""", m{r} AS (SELECT nxt AS id, sum(rank * share) * 0.85::DOUBLE AS rank FROM r{r - 1} JOIN ways USING (id) GROUP BY nxt),
r{r} AS (SELECT id, sum(rank) AS rank FROM (SELECT * FROM m{r} UNION ALL SELECT id, rank * (1 - (SELECT coalesce(sum(rank), 0) FROM m{r})) FROM r0) GROUP BY id)"""
        for r in range(1, RANK_ROUNDS + 1)
    )
    return R.SQL + f""", weighed AS (SELECT from_node AS id, to_node AS nxt, sum(CASE edge_type {weights} ELSE 1::DOUBLE END) AS w FROM edges GROUP BY ALL),
ways AS (SELECT id, nxt, w / sum(w) OVER (PARTITION BY id) AS share FROM weighed),
r0 AS (SELECT id, w / sum(w) OVER () AS rank FROM (VALUES {seeds}) s(id, w)){rounds}
SELECT id, floor(rank * 1e6 + 0.5) / 1e6 AS rank FROM r{RANK_ROUNDS}"""


def _hybrid(spark, d, **options):
    return Q.hybrid_query(_named(R.stored(spark, d)), TEXT, query_vector(spark, d), depth=1, min_score=0.1, limit=30, **options)


def hybrid_fused(spark, d) -> DataFrame:
    rows = _hybrid(spark, d).rows
    return rows.select("node_id", C.rounded(F.col("score")).alias("score"), "snippet", "match_source")


def hybrid_budget(spark, d) -> DataFrame:
    return _hybrid(spark, d, max_tokens=40).rows.select("node_id", "tokens")


def hybrid_expansion(spark, d) -> DataFrame:
    return _hybrid(spark, d).tables["graph_expansion"].select("from_node", "to_node", "edge_type")


HYBRID_SQL = R.SQL + f""", chunks AS (SELECT * FROM sims WHERE score >= 0.1 * 0.8 ORDER BY score DESC, 'Customer:' || id LIMIT 90),
semantic AS (SELECT node_id AS id, max(score) AS s FROM chunks WHERE node_id IN (SELECT id FROM nodes) GROUP BY 1),
lexical AS (SELECT id FROM nodes WHERE contains(lower(id), '{TEXT}') OR contains(lower(name), '{TEXT}') OR contains(lower(f2), '{TEXT}') OR contains(lower(f3), '{TEXT}')),
seeds AS (SELECT id FROM semantic UNION SELECT id FROM lexical),
hits AS (SELECT DISTINCT s.nxt AS id FROM seeds JOIN steps s ON s.id = seeds.id WHERE s.nxt <> seeds.id),
scored AS (SELECT n.id, n.kind, coalesce(sem.s, 0) AS sem, CASE WHEN h.id IS NULL THEN 0 ELSE 0.5::DOUBLE END AS gra, CASE WHEN l.id IS NULL THEN 0 ELSE 0.5::DOUBLE END AS lex
  FROM nodes n LEFT JOIN semantic sem ON sem.id = n.id LEFT JOIN hits h ON h.id = n.id LEFT JOIN lexical l ON l.id = n.id
  WHERE sem.id IS NOT NULL OR h.id IS NOT NULL OR l.id IS NOT NULL),
fused AS (SELECT *, (sem > 0)::INT + (gra > 0)::INT + (lex > 0)::INT AS n FROM scored),
top AS (SELECT id AS node_id, least((sem * 0.6::DOUBLE + gra * 0.3::DOUBLE + lex * 0.1::DOUBLE + CASE WHEN n > 1 THEN (n - 1) * 0.1::DOUBLE ELSE 0 END) / 1.2::DOUBLE, 1) AS score,
  '[' || kind || '] ' || id AS snippet,
  CASE WHEN sem > 0 AND gra > 0 THEN 'fusion' WHEN sem > 0 THEN 'semantic' WHEN gra > 0 THEN 'graph' ELSE 'lexical' END AS match_source FROM fused),
ranked AS (SELECT * FROM top WHERE score >= 0.1 ORDER BY score DESC, node_id LIMIT 30),
counted AS (SELECT *, greatest(1, length(snippet) // 4) AS tokens, row_number() OVER (ORDER BY score DESC, node_id) AS rn,
  sum(greatest(1, length(snippet) // 4)) OVER (ORDER BY score DESC, node_id ROWS UNBOUNDED PRECEDING) AS cum FROM ranked)
"""


def context_items(spark, d) -> DataFrame:
    result = Q.context_query(
        R.stored(spark, d), ["Nation:3", "Supplier:1", "Customer:2"], depth=1, max_tokens=600, prefixes=PREFIXES,
        content=F.coalesce(F.try_element_at("fields_text", F.lit("name")), F.lit("")), priority={"region": 0, "nation": 1, "supplier": 2},
    )
    return result.rows.select("section", "node_id", "kind", "content", "reached_via", "distance", "tokens")


CONTEXT_SQL = R.SQL + """, hints AS (SELECT * FROM (VALUES ('Nation:3', 0), ('Supplier:1', 1), ('Customer:2', 2)) h(id, seq) WHERE id IN (SELECT id FROM nodes)),
found AS (
  SELECT id, id AS via, 0 AS distance, seq, 0 AS step, id AS root FROM hints
  UNION ALL SELECT e.to_node, e.from_node || ' -> ' || edge_type || ' -> ' || e.to_node, 1, seq, 1, e.from_node FROM edges e JOIN hints h ON e.from_node = h.id
  UNION ALL SELECT e.from_node, e.from_node || ' -> ' || edge_type || ' -> ' || e.to_node, 1, seq, 2, e.to_node FROM edges e JOIN hints h ON e.to_node = h.id),
firsts AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq, root, step, via, distance) = 1),
items AS (SELECT f.*, n.kind, coalesce(CASE WHEN n.kind = 'orders' THEN NULL ELSE n.name END, '') AS content, CASE n.kind WHEN 'region' THEN 0 WHEN 'nation' THEN 1 WHEN 'supplier' THEN 2 ELSE 3 END AS priority
  FROM firsts f JOIN nodes n ON n.id = f.id),
sized AS (SELECT *, CAST(ceil(length(id || ' ' || kind || ' ' || content || ' ' || 'specs/' || kind || '.md' || ' ' || via) / 4.0) AS BIGINT) AS tokens FROM items WHERE content <> ''),
summed AS (SELECT *, sum(tokens) OVER (ORDER BY priority, distance, seq, root, step, id ROWS UNBOUNDED PRECEDING) AS cum FROM sized)
SELECT CASE WHEN priority <= 1 THEN 'constraints' ELSE 'behavior' END AS section, id AS node_id, kind, content, via AS reached_via, distance, tokens FROM summed WHERE cum <= 600"""


def list_nodes(spark, d) -> DataFrame:
    return Q.list_nodes(R.index(spark, d), ["nation", "supplier"]).select("id", "kind", "title", "status")


def stats(spark, d) -> DataFrame:
    return Q.stats(R.index(spark, d))


def labels_precision(spark, d) -> DataFrame:
    """Share of good documents among those that a phrase finds, by language."""
    docs = R.table(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("license")))
    rated = docs.join(R.table(spark, d, "labels"), "doc_id")
    return rated.groupBy("lang").agg(F.count("*").alias("found"), C.rounded(F.avg(F.col("quality").cast("double"))).alias("precision"))


def queries() -> dict:
    return {
        "orphan_edges": orphan_edges,
        "orphan_edges_typed": orphan_edges_typed,
        "orphan_rate": orphan_rate,
        "load_graph_dedup": load_graph,
        "stored_edges": stored_edges,
        "layer_violations": layer_violations,
        "violation_rate": violation_rate,
        "coverage_customer": coverage_customer,
        "coverage_percent": coverage_percent,
        "coverage_all": coverage_all,
        "incoming_edges": incoming_edges,
        "outgoing_edges": outgoing_edges,
        "graph_bfs_d1": _bfs(1),
        "graph_bfs_d2": _bfs(2),
        "graph_bfs_d3": _bfs(3),
        "graph_bfs_typed": _bfs(2, edge_types=["SUPPLIED_BY", "IN_NATION"]),
        "graph_bfs_kinds": _bfs(2, kinds=["part", "nation"]),
        "graph_bfs_all_layers": _bfs(3, respect_layers=False),
        "graph_bfs_edges": graph_bfs_edges,
        "graph_bfs_labels": graph_bfs_labels,
        "chunk_changes": chunk_changes,
        "impact_direct": impact_direct,
        "impact_transitive": impact_transitive,
        "cosine_topk": cosine_topk,
        "cosine_topk_cells": cosine_topk_cells,
        "cosine_threshold": cosine_threshold,
        "lexical_search_indexed": lexical_search_indexed,
        "lexical_words_indexed": lexical_words_indexed,
        "personal_rank": personal_rank,
        "semantic_best_chunk": semantic_best_chunk,
        "lexical_search": lexical_search,
        "lexical_fields": lexical_fields,
        "lexical_all_words": lexical_all_words,
        "hybrid_fused": hybrid_fused,
        "hybrid_budget": hybrid_budget,
        "hybrid_expansion": hybrid_expansion,
        "context_items": context_items,
        "list_nodes": list_nodes,
        "stats": stats,
        "labels_precision": labels_precision,
    } | spec_registry.queries() | document_registry.queries()


def oracle_sql() -> dict[str, str]:
    s = R.SQL
    summary = "SELECT v AS total, a AS analyzed, CASE WHEN a > 0 THEN floor(v / a * 10000 + 0.5) / 100 ELSE 0 END AS rate FROM"
    loaded = "(SELECT count(*) FROM edges) + (SELECT count(*) FROM orphans)"
    kinds = "CASE WHEN {0} LIKE 'Orders%' THEN '03-experience' WHEN {0} LIKE 'Region%' OR {0} LIKE 'Nation%' THEN '01-domain' ELSE '02-behavior' END"
    broken = f"SELECT from_node, to_node, {kinds.format('from_node')} AS from_layer, {kinds.format('to_node')} AS to_layer, edge_type FROM edges WHERE layer_violation"
    rules = ", ".join(f"({i}, '{n}', '{e}')" for i, (_, n, e) in enumerate(CUSTOMER_RULES))
    cover = s + f""", rules AS (SELECT * FROM (VALUES {rules}) r(pos, name, edge_type)),
other AS (SELECT edge_type, from_node AS o FROM edges WHERE to_node = 'Customer:1' UNION SELECT edge_type, to_node FROM edges WHERE from_node = 'Customer:1'),
rows AS (SELECT name, r.edge_type, CASE WHEN count(o) > 0 THEN 'covered' ELSE 'missing' END AS status, coalesce(string_agg(o, ',' ORDER BY o), '') AS found
         FROM rules r LEFT JOIN other USING (edge_type) GROUP BY pos, name, r.edge_type)
"""
    lex = "SELECT id, kind FROM nodes WHERE "
    sql = {
        "orphan_edges": s + "SELECT from_node, to_node, edge_type, from_exists, to_exists, reason FROM orphans",
        "orphan_edges_typed": s + f"{summary} (SELECT (SELECT count(*) FROM orphans WHERE edge_type = 'PLACED_BY') AS v, {loaded} AS a)",
        "orphan_rate": s + f"{summary} (SELECT (SELECT count(*) FROM orphans) AS v, {loaded} AS a)",
        "load_graph_dedup": s + "SELECT CAST(edge_seq AS BIGINT) AS edge_seq, from_node, to_node, edge_type, layer_violation FROM edges",
        "stored_edges": s + "SELECT CAST(edge_seq AS BIGINT) AS edge_seq, from_node, to_node, edge_type, layer_violation FROM edges",
        "layer_violations": s + broken,
        "violation_rate": s + f"{summary} (SELECT count_if(layer_violation) AS v, count(*) AS a FROM edges)",
        "coverage_customer": cover + "SELECT * FROM rows",
        "coverage_percent": cover + "SELECT count_if(status = 'covered') AS present, count_if(status <> 'covered') AS missing, floor(count_if(status = 'covered') / count(*) * 1000 + 0.5) / 10 AS coverage_percent FROM rows",
        "coverage_all": s + f""", met AS (SELECT id, count(DISTINCT edge_type) AS present FROM (SELECT from_node AS id, edge_type FROM edges UNION ALL SELECT to_node, edge_type FROM edges)
WHERE edge_type IN ({", ".join(f"'{e}'" for _, _, e in CUSTOMER_RULES)}) GROUP BY id)
SELECT n.id, coalesce(present, 0) AS present, floor(coalesce(present, 0) / 4 * 1000 + 0.5) / 10 AS coverage_percent FROM nodes n LEFT JOIN met ON met.id = n.id WHERE kind = 'customer'""",
        "incoming_edges": s + "SELECT from_node, edge_type FROM edges WHERE to_node = 'Nation:3'",
        "outgoing_edges": s + "SELECT to_node, edge_type FROM edges WHERE from_node = 'Customer:1'",
        "graph_bfs_d1": _bfs_sql(1),
        "graph_bfs_d2": _bfs_sql(2),
        "graph_bfs_d3": _bfs_sql(3),
        "graph_bfs_typed": _bfs_sql(2, "(SELECT * FROM steps WHERE edge_type IN ('SUPPLIED_BY', 'IN_NATION'))"),
        "graph_bfs_kinds": _bfs_sql(2, where="WHERE kind IN ('part', 'nation')"),
        "graph_bfs_all_layers": _bfs_sql(3, "allsteps"),
        "graph_bfs_edges": s + """, walk AS (SELECT 'Supplier:1' AS id, 0 AS dist UNION SELECT s.nxt, w.dist + 1 FROM walk w JOIN steps s ON w.id = s.id WHERE w.dist < 1)
SELECT from_node, to_node, edge_type FROM edges WHERE NOT layer_violation AND (from_node IN (SELECT id FROM walk) OR to_node IN (SELECT id FROM walk))""",
        "impact_direct": s + "SELECT from_node AS node_id, kind, edge_type, 'Connected via ' || edge_type || ' — change type: modify_attribute' AS impact_description FROM edges JOIN nodes ON nodes.id = from_node WHERE to_node = 'Supplier:1'",
        "impact_transitive": IMPACT_SQL,
        "cosine_topk": s + "SELECT id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM (SELECT id, score FROM sims WHERE score >= 0 ORDER BY score DESC, id LIMIT 20)",
        "cosine_threshold": s + "SELECT id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM sims WHERE score >= 0.2",
        "semantic_best_chunk": s + """, best AS (SELECT * FROM sims WHERE score >= 0 ORDER BY score DESC, id LIMIT 24),
per AS (SELECT node_id, max(score) AS score FROM best GROUP BY node_id)
SELECT node_id, floor(score * 1e6 + 0.5) / 1e6 AS score, '[customer] ' || node_id AS snippet FROM (SELECT per.* FROM per JOIN nodes ON nodes.id = node_id ORDER BY score DESC, node_id LIMIT 8)""",
        "lexical_search": s + lex + f"contains(lower(id), '{TEXT}') OR contains(lower(name), '{TEXT}') OR contains(lower(f2), '{TEXT}') OR contains(lower(f3), '{TEXT}')",
        "lexical_fields": s + lex + "contains(lower(id), 'er') OR (kind <> 'xx' AND contains(lower(name), 'er') ) OR (kind = 'part' AND contains(lower(f2), 'er'))",
        "lexical_all_words": s + lex + "(contains(lower(id), 'brand#1') OR contains(lower(name), 'brand#1') OR contains(lower(f2), 'brand#1') OR contains(lower(f3), 'brand#1')) AND contains(lower(concat_ws(' ', id, name, name, f2, f3)), 'part')",
        "hybrid_fused": HYBRID_SQL + "SELECT node_id, floor(score * 1e6 + 0.5) / 1e6 AS score, snippet, match_source FROM counted WHERE rn = 1 OR cum <= 8000",
        "hybrid_budget": HYBRID_SQL + "SELECT node_id, tokens FROM counted WHERE rn = 1 OR cum <= 40",
        "hybrid_expansion": HYBRID_SQL + "SELECT from_node, to_node, edge_type FROM edges WHERE NOT layer_violation AND (from_node IN (SELECT id FROM seeds) OR to_node IN (SELECT id FROM seeds))",
        "context_items": CONTEXT_SQL,
        "list_nodes": s + "SELECT id, kind, id AS title, 'active' AS status FROM nodes WHERE kind IN ('nation', 'supplier')",
        "stats": s + "SELECT 'nodes' AS what, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'orphans', count(*) FROM orphans UNION ALL SELECT 'embeddings', count(*) FROM vectors",
        "labels_precision": "SELECT lang, count(*) AS found, floor(avg(CAST(quality AS DOUBLE)) * 1e6 + 0.5) / 1e6 AS precision FROM documents JOIN labels USING (doc_id) WHERE contains(lower(text), 'license') GROUP BY lang",
    }
    # stored forms give what the plain ones do
    sql |= {"cosine_topk_cells": sql["cosine_topk"], "lexical_search_indexed": sql["lexical_search"], "lexical_words_indexed": sql["lexical_all_words"], "personal_rank": _rank_sql(), "graph_bfs_labels": LABELS_SQL, "chunk_changes": CHUNKS_SQL}
    return sql | spec_registry.oracle_sql() | document_registry.oracle_sql()
