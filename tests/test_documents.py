"""Parsing and extraction on small documents: odd Markdown, YAML, all kinds, chunks, features."""

import json
import time

import pytest
from pyspark.sql import functions as F

from loregraph.functions import columns as C
from loregraph.operators import extract as E
from loregraph.operators import features as T
from loregraph.operators import graph as G
from loregraph.operators import parse as P
from loregraph.plans import queries as Q
from loregraph.schema import KINDS, QueryError


def one(spark, text, column, name="t"):
    return spark.createDataFrame([(text,)], f"{name} string").select(column.alias("v")).first()["v"]


def sections(spark, text, **options):
    return [(s["heading"], s["level"], s["content"], s["path"]) for s in one(spark, text, P.sections(F.col("t"), **options))]


def test_sections_of_odd_texts(spark):
    assert sections(spark, "a\n# A \n## B\n### C\nx\n## D\n") == [("A ", 1, "", "a"), ("B", 2, "", "a.b"), ("C", 3, "x", "a.b.c"), ("D", 2, "", "a.d")]
    assert sections(spark, "#tag\n```\n# in\n```\n") == [("tag", 1, "```", "tag"), ("in", 1, "```", "in")]
    assert sections(spark, "#tag\n```\n# in\n```\n", fence_aware=True) == [("tag", 1, "```\n# in\n```", "tag")]
    assert sections(spark, "# A\r\nx\r\n## B\r\n")[0][2] == "x"
    assert sections(spark, "") == [] and sections(spark, "none") == []
    assert sections(spark, "### deep\n# up\n## under") == [("deep", 3, "", "deep"), ("up", 1, "", "up"), ("under", 2, "", "up.under")]


def test_many_headings_take_no_longer_than_their_number(spark):
    text = "\n".join(f"{'#' * (1 + i % 4)} Heading {i}\nline {i}" for i in range(5000))
    start = time.perf_counter()
    found = sections(spark, text)
    assert len(found) == 5000 and found[4999][2] == "line 4999"
    assert time.perf_counter() - start < 60


@pytest.mark.parametrize(("heading", "anchor"), [("Descripción", "descripcion"), ("ﬁn ½ Ⅷ", "fin-12-viii"), ("Ａｂ c²", "ab-c2"), ("ǖ ạ̈x", "u-ax"), ("a b", "a-b"), ("-x- y_", "x--y_"), ("日本 z", "z")])
def test_anchor(spark, heading, anchor):
    import re
    import unicodedata

    form = unicodedata.normalize("NFKD", heading).lower()
    assert re.sub("^-+|-+$", "", re.sub(r"\s+", "-", re.sub(r"[^\w\s-]", "", form, flags=re.ASCII))) == anchor
    assert one(spark, heading, C.anchor(F.col("t"))) == anchor


def test_links(spark):
    found = [tuple(x) for x in one(spark, "[[a::b::c]] [[a|b|c]] [[ ]] [[core::X|y]] [[ z ]]", P.wiki_links(F.col("t")))]
    assert found == [("a::b::c", "b", "a", None), ("a|b|c", "a", None, "b"), ("core::X|y", "X", "core", "y"), ("z", "z", None, None)]


def test_tables_and_lists(spark):
    table = "| `A` | B | A |\n|--|--|--|\n| 1 | [[X|y]] | 3 |\n| 1 | 2 |\n\n| C |\n|--|\n| 4 | 5 | 6 |"
    assert one(spark, table, P.table_rows(F.col("t"))) == [{"A": "y]]", "B": "[[X"}, {"A": "6", "B": "5"}]
    assert one(spark, None, P.table_rows(F.col("t"))) is None
    assert one(spark, "- a\n* b\n+ c\n  - d ", P.list_items(F.col("t"))) == ["a", "b", "d"]


def test_front_matter(spark):
    yaml = "---\nkind: entity\nlist:\n  - \"B, C\"\n  - d\ntext: |\n  two\n  lines\nnested: {a: 1, b: [x, y]}\nquoted: 'a: b' # note\n---\nbody"
    plain = "---\nkind: entity\naliases: [a, \"b\"]\nitems:\n  - x\n  - y z\nempty:\n---\nbody"
    broken = "---\nkind: [\n---\nbody"
    rows = spark.createDataFrame([(i, t) for i, t in enumerate((yaml, plain, broken, "no fence", None))], "i int, t string")
    fields, body = P.front_matter(F.col("t"))
    found = {r.i: (r.f, r.b) for r in rows.select("i", fields.alias("f"), body.alias("b")).collect()}
    assert found[0][0]["text"] == "two\nlines\n" and json.loads(found[0][0]["nested"]) == {"a": "1", "b": ["x", "y"]} and found[0][0]["quoted"] == "a: b" and found[0][1] == "body"
    assert found[1][0]["kind"] == "entity" and found[1][1] == "body" and found[1][0]["empty"] == ""
    assert found[2] == ({}, broken) and found[3] == ({}, "no fence") and found[4] == ({}, None)
    lists = rows.where("i < 2").select("i", P.listed(F.try_element_at(fields, F.lit("list"))).alias("a"), P.listed(F.try_element_at(fields, F.lit("aliases"))).alias("b"), P.listed(F.try_element_at(fields, F.lit("items"))).alias("c")).orderBy("i").collect()
    assert lists[0]["a"] == ["B, C", "d"] and (lists[1]["b"], lists[1]["c"]) == (["a", "b"], ["x", "y z"])


def test_every_kind(spark):
    """Each kind's fields, under its English headings, by all forms."""
    rows, want = [], {}
    for kind, prefix, folder, _ in KINDS:
        body = ""
        for name, form, heads in E.FIELDS[kind]:
            text = {"text": f"about {name}", "list": f"- {name}", "table": f"| Col |\n|---|\n| {name} |", "children": f"all {name}\n### Part\n{name} part"}[form]
            body += f"## {heads[-1]}\n{text}\n"
            said = f"all {name}\n\n### Part\n\n{name} part" if form == "children" else text
            want[f"{prefix}:{kind}-1", name] = {"text": said, "children": said, "list": [name], "table": [{"Col": name}]}[form]
        rows.append((f"specs/{folder}{kind}-1.md", f"---\nkind: {kind}\n---\n{body}"))
    documents, skipped = P.parse_documents(spark.createDataFrame(rows, "path string, content string"))
    assert skipped.count() == 0
    found = {}
    for r in E.nodes_of(documents).collect():
        found |= {(r["id"], k): v for part in ("fields_text", "fields_list", "fields_table") for k, v in r[part].items()}
    assert found == want


def test_typed_edges(spark):
    """The first section of a heading counts, lifecycle events in all; only relations are read from content."""
    use_case = "---\nkind: use-case\nid: UC-1\n---\n## Reglas Aplicadas\n[[BR-1]] [[Other]]\n## Applied Rules\n[[BR-2]]\n## Commands Executed\n[[CMD-1]]\n## Notes\n[[OBJ-1]]\n"
    entity = "---\nkind: entity\nid: E\n---\n## Lifecycle Events\n[[EVT-A]]\n## Eventos del ciclo de vida\n[[EVT-B]] [[X]]\n## Relations\n| R | T |\n|--|--|\n| has | [[X]] |\n| none | x |\n"
    policy = "---\nkind: business-policy\nid: BP-1\n---\n## Declaration\n[[E]] [[UC-1]]\n"
    view = "---\nkind: ui-view\nid: UI-V\n---\n## Behavior\n[[UC-1]] [[UI-B]]\n"
    files = spark.createDataFrame([("specs/02-behavior/UC-1.md", use_case), ("specs/01-domain/E.md", entity), ("specs/02-behavior/BP-1.md", policy), ("specs/03-experience/V.md", view)], "path string, content string")
    documents, _ = P.parse_documents(files)
    found = {(r["from_node"], r["edge_type"], r["to_node"]): r for r in E.edges_of(documents).where("edge_type <> 'WIKI_LINK'").collect()}
    assert set(found) == {
        ("UC:UC-1", "UC_APPLIES_RULE", "BR:BR-1"), ("UC:UC-1", "UC_EXECUTES_CMD", "CMD:CMD-1"), ("UC:UC-1", "UC_STORY", "OBJ:OBJ-1"), ("Entity:E", "EMITS", "Event:EVT-A"),
        ("Entity:E", "EMITS", "Event:EVT-B"), ("Entity:E", "DOMAIN_RELATION", "Entity:X"), ("BP:BP-1", "ENTITY_RULE", "Entity:E"),
    }
    assert {r["extraction_method"] for k, r in found.items() if k[1] != "DOMAIN_RELATION"} == {"wiki_link"}
    assert found["Entity:E", "DOMAIN_RELATION", "Entity:X"]["metadata"] == {"relation": "has", "cardinality": ""}
    more = {(r["from_node"], r["edge_type"], r["to_node"]) for r in E.edges_of(documents, further=True).collect()}
    assert {("BP:BP-1", "ENTITY_POLICY", "Entity:E"), ("UIView:UI-V", "VIEW_TRIGGERS_UC", "UC:UC-1"), ("UIView:UI-V", "VIEW_USES_COMPONENT", "UIView:UI-B"), ("UC:UC-1", "LAYER_DEPENDENCY", "BR:BR-1")} <= more


def test_chunk_offsets():

    text = "aaaa\n\nbb\n\ncccc"
    assert E.pack(text, most=10, overlap=2) == [(0, "aaaa\n\nbb"), (6, "bb\n\ncccc")]
    assert all(text[at:].startswith(chunk[:2]) for at, chunk in E.pack(text, most=10, overlap=2))


def test_paragraph_chunks(spark):
    body = "# Top\nSays one. Says two.\n## Description\nshort one\n\nanother short\n\n| a |\n|--|\n| 1 |\n\n" + "word " * 25 + "\n\nlast bit\n"
    documents, _ = P.parse_documents(spark.createDataFrame([("specs/01-domain/entities/E.md", f"---\nkind: entity\n---\n{body}")], "path string, content string"))
    found = [(r["raw_text"], r["context_text"]) for r in E.paragraph_chunks_of(documents).orderBy("chunk_index").collect()]
    assert [t for t, _ in found] == ["short one\n\nanother short", "| a |\n|--|\n| 1 |", ("word " * 25).strip(), "last bit"]
    assert found[0][1] == "[entity: E]\nSays one.\nshort one\n\nanother short"


def test_features_and_yaml(spark):
    text = "# language: es\n@BR-1 @other\nCaracterística: Pagos\n\n  Escenario: uno\n    Dado [[UC-2]]\n\n  @CMD-3\n  Escenario: dos\n    Entonces nada\n"
    found = T.scenarios(spark.createDataFrame([("a/pay.feature", text), ("a/none.feature", None)], "path string, content string"))
    assert [(r["title"], r["feature"], r["tags"]) for r in found.orderBy("pos").collect()] == [("uno", "Pagos", ["@BR-1", "@other"]), ("dos", "Pagos", ["@BR-1", "@other", "@CMD-3"])]
    assert {(r["from_node"], r["to_node"]) for r in T.validates_edges(found).collect()} == {("Scenario:pay#1", "BR:BR-1"), ("Scenario:pay#1", "UC:UC-2"), ("Scenario:pay#2", "BR:BR-1"), ("Scenario:pay#2", "CMD:CMD-3")}
    files = T.yaml_as_markdown(spark.createDataFrame([("specs/01-domain/entities/X.yaml", "kind: entity\nid: X\naliases: [a]\n")], "path string, content string"))
    assert [r["id"] for r in E.nodes_of(P.parse_documents(files)[0]).collect()] == ["Entity:X"]


EDGE = "edge_seq bigint, from_node string, to_node string, edge_type string, layer_violation boolean"


def graph(spark, *rows):
    ids = sorted({x for a, b, _ in rows for x in (a, b)})
    nodes = spark.createDataFrame([(i, i.split(":")[0].lower(), "01-domain", "h", {}) for i in ids], "id string, kind string, layer string, source_hash string, fields_text map<string,string>")
    return G.load_graph(nodes, spark.createDataFrame([(i, a, b, t, False) for i, (a, b, t) in enumerate(rows, 1)], EDGE))


def test_first_path_of_impact(spark):
    root, rule = "Entity:Document", "BR:BR-DOC-001"
    index = graph(spark, (rule, root, "ENTITY_RULE"), ("UC:UC-001", rule, "UC_APPLIES_RULE"), ("UC:UC-001", "CMD:CMD-001", "UC_EXECUTES_CMD"), ("CMD:CMD-001", root, "WIKI_LINK"))
    result = Q.impact_query(index, root)
    assert {(r["node_id"], r["edge_type"]) for r in result.rows.collect()} == {(rule, "ENTITY_RULE"), ("CMD:CMD-001", "WIKI_LINK")}
    assert [(r["node_id"], r["path"], r["edge_types"]) for r in result.tables["transitive"].collect()] == [("UC:UC-001", [root, rule], ["ENTITY_RULE", "UC_APPLIES_RULE"])]
    assert Q.impact_query(index, "UC:UC-001").rows.count() == 0
    with pytest.raises(QueryError, match="NODE_NOT_FOUND"):
        Q.impact_query(index, "Entity:Absent")
    # by discovery and not by name: Z refers first
    index = graph(spark, ("E:Z", "E:root", "L"), ("E:A", "E:root", "L"), ("E:X", "E:Z", "L"), ("E:X", "E:A", "L"), ("E:Y", "E:X", "L"))
    paths = {r["node_id"]: r["path"] for r in Q.impact_query(index, "E:root").tables["transitive"].collect()}
    assert paths == {"E:X": ["E:root", "E:Z"], "E:Y": ["E:root", "E:Z", "E:X"]}


def test_last_indexed_node_stays(spark):
    import datetime

    rows = [("E:a", datetime.datetime(2024, 1, d), f"h{d}", "f") for d in (1, 3, 2)] + [("E:a", None, "h9", "g")]
    nodes = spark.createDataFrame(rows, "id string, indexed_at timestamp, source_hash string, source_file string")
    assert [(r["id"], r["source_hash"]) for r in G.latest_nodes(nodes).collect()] == [("E:a", "h3")]


@pytest.mark.parametrize(("case", "edges", "want", "rate"), [
    ("none", [("A", "B"), ("B", "C")], [], 0.0), ("target", [("A", "MISSING")], ["missing_target"], 100.0), ("source", [("MISSING", "B")], ["missing_source"], 100.0), ("both", [("GONE_A", "GONE_B")], ["both_missing"], 100.0),
    ("rate", [("A", "B"), ("A", "MISSING1"), ("A", "MISSING2"), ("B", "MISSING3")], ["missing_target"] * 3, 75.0), ("twice", [("A", "B"), ("A", "B"), ("A", "M"), ("A", "M")], ["missing_target"] * 2, 66.67),
])
def test_orphans(spark, case, edges, want, rate):
    nodes = spark.createDataFrame([(i, "entity", "01-domain", "h") for i in "ABC"], "id string, kind string, layer string, source_hash string")
    rows = spark.createDataFrame([(i, a, b, "WIKI_LINK", False, "f") for i, (a, b) in enumerate(edges)], EDGE + ", source_file string")
    result = Q.orphans_query(G.load_graph(nodes, rows))
    assert sorted(r["reason"] for r in result.rows.collect()) == want
    assert result.tables["summary"].first()["rate"] == rate


def test_long_front_matter(spark):
    """100,000 lines of a list, and 100,000 keys, some of them twice."""
    start = time.perf_counter()
    listed = "---\nkind: entity\nitems:\n" + "  - item\n" * 100_000 + "---\nbody"
    fields, body = (one(spark, listed, c) for c in P.front_matter(F.col("t")))
    assert body == "body" and fields["kind"] == "entity" and fields["items"].count("item") == 100_000
    keys = "---\n" + "".join(f"k{i % 90_000}: v{i}\n" for i in range(100_000)) + "---\n"
    fields = one(spark, keys, P.front_matter(F.col("t"))[0])
    assert len(fields) == 90_000 and fields["k5"] == "v90005" and fields["k50000"] == "v50000"
    assert one(spark, "---\nb: 1\na: 2\nb: 3\n---\n", F.map_keys(P.front_matter(F.col("t"))[0])) == ["a", "b"]
    assert time.perf_counter() - start < 30


def test_long_runs_of_blanks(spark):
    start = time.perf_counter()
    blanks = " \t " * 330_000
    assert one(spark, f"{blanks}a.{blanks}b{blanks}", P.sentences(F.col("t"))) == ["a.", "b"]
    assert one(spark, f"﻿{blanks}a{blanks}b　", C.trim_all(F.col("t"))) == f"a{blanks}b"
    assert one(spark, "-" * 500_000 + "a" + "-" * 500_000 + "b" + "-" * 9, C.anchor(F.col("t")))[0] == "a"
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("text,want", [("# A **bold** [link](x)  end", "A bold link end"), ("a" * 150 + ". " + "b" * 100, "a" * 150 + "."), ("word " * 60, ("word " * 40)[:199] + "..."), ("x" * 250, "x" * 200 + "..."), (" 　", "")])
def test_text_snippet(spark, text, want):
    assert one(spark, text, C.text_snippet(F.col("t"))) == want
