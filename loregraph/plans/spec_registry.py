"""Queries of the indexing side over the given tables: snapshots, merges, texts, pages, lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.functions import columns as C
from loregraph.operators import extract as E
from loregraph.operators import maintain as M
from loregraph.operators import parse as P
from loregraph.sources.relgraph import table
from loregraph.streaming import lifecycle as L

DAY = "1996-01-01"


def _latest(orders: DataFrame) -> DataFrame:
    """A customer's latest order stands for its state."""
    order = F.struct("o_orderdate", "o_orderkey")
    last = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.max(order).alias("last"))
    return last.select("id", F.sha2(F.col("last.o_orderkey").cast("string"), 256).alias("source_hash"))


def _statuses(spark, d) -> DataFrame:
    """Customers with an order by the day, against those with one of another status than F at any time."""
    orders = table(spark, d, "orders")
    return M.snapshot_diff(_latest(orders.where(F.col("o_orderdate") < DAY)), _latest(orders.where("o_orderstatus <> 'F'")))


STATUS_SQL = f"""WITH latest AS (SELECT 'old' AS side, o_custkey AS id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders WHERE o_orderdate < '{DAY}' GROUP BY 2
  UNION ALL SELECT 'new', o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_orderstatus <> 'F' GROUP BY 2),
diff AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'A' WHEN n.id IS NULL THEN 'D' WHEN o.k = n.k THEN 'unchanged' ELSE 'M' END AS status
  FROM (SELECT * FROM latest WHERE side = 'old') o FULL JOIN (SELECT * FROM latest WHERE side = 'new') n ON o.id = n.id)
"""


def snapshot_diff(spark, d) -> DataFrame:
    return _statuses(spark, d)


def snapshot_counts(spark, d) -> DataFrame:
    return _statuses(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def _sources(spark, d) -> DataFrame:
    """Each order priority as an index that knows its customers by their latest order."""
    last = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("id")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("last"))
    return last.select("source", "id", F.col("last.o_orderkey").cast("string").alias("source_hash"), F.col("last.o_orderdate").alias("indexed_at"))


MERGE_SQL = """WITH sources AS (SELECT o_orderpriority AS source, o_custkey AS id, CAST(arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS VARCHAR) AS source_hash, max(o_orderdate) AS indexed_at
  FROM orders GROUP BY 1, 2)
"""


def merge_lww(spark, d) -> DataFrame:
    return M.merge_nodes(_sources(spark, d)).select("id", "source", "source_hash")


def merge_conflicts(spark, d) -> DataFrame:
    return M.merge_nodes(_sources(spark, d)).agg(F.count("*").alias("total_nodes"), F.count_if("conflict").alias("conflicts"))


def merge_delete_wins(spark, d) -> DataFrame:
    """Customers with an order of status P are deleted."""
    tombs = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("node_id"))
    return M.merge_nodes(_sources(spark, d), tombs).select("id", "source")


def merge_edges(spark, d) -> DataFrame:
    """Parts' suppliers as the return flags' indices know them, each once, by the first flag."""
    rows = table(spark, d, "lineitem").select(
        F.ascii("l_returnflag").cast("bigint").alias("edge_seq"), F.concat(F.lit("Part:"), F.col("l_partkey").cast("string")).alias("from_node"),
        F.concat(F.lit("Supplier:"), F.col("l_suppkey").cast("string")).alias("to_node"), F.lit("SUPPLIED_BY").alias("edge_type"),
    )
    return M.merge_edges(rows)


def text_hash(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))


def sentence_split(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.size(P.sentences(F.col("text"))).cast("bigint").alias("sentences"))


def chunk_paragraphs(spark, d) -> DataFrame:
    """Chunks of whole texts, lines taken as paragraphs."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(E.packed(F.col("text"), delimiter="\n")).alias("chunk_index", "chunk"))
    return docs.select("doc_id", "chunk_index", "chunk.char_offset", F.length("chunk.raw_text").alias("n_chars"), F.sha2("chunk.raw_text", 256).alias("text_hash"))


def heading_sections(spark, d) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r"<h([1-6])[^>]*>[^<]*</h[1-6]>"), F.lit(0))
    rows = table(spark, d, "pages").select("page_id", F.explode(found).alias("tag"))
    return rows.select("page_id", F.substring("tag", 3, 1).cast("int").alias("level"), F.regexp_extract("tag", ">([^<]*)<", 1).alias("heading"))


def link_extract(spark, d) -> DataFrame:
    """Pages' links by target, and whether a page has that address."""
    pages = table(spark, d, "pages")
    links = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target")).groupBy("target").agg(F.count("*").alias("links"))
    known = pages.select(F.col("url").alias("target"), F.lit(True).alias("known")).distinct()
    return links.join(known, "target", "left").select("target", "links", F.coalesce("known", F.lit(False)).alias("known"))


def lifecycle_state(spark, d) -> DataFrame:
    return L.last_state(table(spark, d, "events"), "user_id", ("ts", "event_id"))


def lifecycle_windows(spark, d) -> DataFrame:
    rows = L.windowed_counts(table(spark, d, "events"))
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def event_props(spark, d) -> DataFrame:
    """Events by type with the number of props."""
    rows = table(spark, d, "events").select("event_type", F.size(F.json_object_keys("props")).alias("n"))
    return rows.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("n").alias("props"))


def detect_layer(spark, d) -> DataFrame:
    """Edges' layers as a rule table sees them: order kinds by path."""
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("specs/"), F.when(F.col("o_orderstatus") == "O", "02-behavior/").when(F.col("o_orderstatus") == "F", "03-experience/").otherwise(""), "o_orderpriority").alias("path"))
    return rows.groupBy(C.detect_layer(F.col("path")).alias("layer")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    snapshot_diff, snapshot_counts, merge_lww, merge_conflicts, merge_delete_wins, merge_edges, text_hash, sentence_split, chunk_paragraphs, heading_sections, link_extract,
    lifecycle_state, lifecycle_windows, event_props, detect_layer,
)}

SQL = {
    "snapshot_diff": STATUS_SQL + "SELECT id, status FROM diff",
    "snapshot_counts": STATUS_SQL + "SELECT status, count(*) AS n FROM diff GROUP BY 1",
    "merge_lww": MERGE_SQL + "SELECT id, arg_max(source, (indexed_at, source)) AS source, arg_max(source_hash, (indexed_at, source)) AS source_hash FROM sources GROUP BY 1",
    "merge_conflicts": MERGE_SQL + "SELECT count(*) AS total_nodes, count(*) FILTER (n > 1) AS conflicts FROM (SELECT id, count(DISTINCT source_hash) AS n FROM sources GROUP BY 1)",
    "merge_delete_wins": MERGE_SQL + "SELECT id, arg_max(source, (indexed_at, source)) AS source FROM sources WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1",
    "merge_edges": "SELECT min(ascii(l_returnflag))::BIGINT AS edge_seq, 'Part:' || l_partkey AS from_node, 'Supplier:' || l_suppkey AS to_node, 'SUPPLIED_BY' AS edge_type FROM lineitem GROUP BY 2, 3",
    "text_hash": "SELECT sha256(text) AS text_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "sentence_split": r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '\.\s+', '.' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13)) <> '')) AS sentences FROM documents WHERE text IS NOT NULL",
    "heading_sections": "SELECT page_id, CAST(tag[3] AS INTEGER) AS level, regexp_extract(tag, '>([^<]*)<', 1) AS heading FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h([1-6])[^>]*>[^<]*</h[1-6]>')) AS tag FROM pages)",
    "link_extract": """SELECT target, count(*) AS links, target IN (SELECT url FROM pages) AS known FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) GROUP BY 1""",
    "lifecycle_state": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS events FROM events GROUP BY 1",
    "lifecycle_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "event_props": "SELECT event_type, count(*) AS events, CAST(sum(len(json_keys(props))) AS BIGINT) AS props FROM events GROUP BY 1",
    "detect_layer": "SELECT CASE o_orderstatus WHEN 'O' THEN '02-behavior' WHEN 'F' THEN '03-experience' ELSE '01-domain' END AS layer, count(*) AS n FROM orders GROUP BY 1",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
