"""Every registered query of the engine against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from loregraph.plans import registry

DIR = "/root/testdata/sf0.001"
#: Cheap ones here; all of them run against their twins in the driver's check.
QUICK = [
    "load_graph_dedup", "orphan_rate", "layer_violations", "graph_bfs_d2", "cosine_topk", "lexical_search", "hybrid_fused", "context_items",
    "snapshot_diff", "merge_lww", "merge_delete_wins", "merge_edges", "sentence_split", "heading_sections", "link_extract", "lifecycle_state", "detect_layer",
    "impact_transitive", "md_sections", "md_wiki_links", "md_table_rows", "md_read_section", "route_kind", "index_nodes", "index_edges", "index_chunks", "index_paragraph_chunks", "index_counters",
    "apply_diff", "cascade_delete", "layer_violations_filtered", "impact_scenarios", "resolve_hints",
    "stored_edges", "cosine_topk_cells", "lexical_search_indexed", "lexical_words_indexed", "personal_rank", "graph_bfs_labels", "chunk_changes", "budget_chunks", "scored_edges", "unknown_mentions",
]


def rows_of(names, rows):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for file in os.listdir(DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{file}'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_same_rows_as_sql(spark, con, name):
    found = registry.queries()[name](spark, DIR)
    wanted = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in wanted.description]
    assert sorted(names) == sorted(found.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(names, wanted.fetchall())


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
