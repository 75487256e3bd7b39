"""Documents to nodes, edges and chunks; sections, links and tables."""

from pyspark.sql import functions as F

from loregraph.operators import extract as E
from loregraph.operators import parse as P

ORDER = """---
kind: entity
aliases: [Compra, Ticket]
status: active
---
# Pedido

## Descripción

Lo que pide un [[Usuario]].

## Atributos

| Campo | Tipo | Nota |
|---|---|---|
| id | uuid | clave |
| total | number | suma |

## Relaciones

| Relación | Tipo | Cardinalidad | Con |
|---|---|---|---|
| pertenece_a | ref | N:1 | [[Usuario]] |

## Invariantes

- total mayor que 0
* una línea al menos
"""
COMMAND = "---\nkind: command\n---\n# Pagar\n## Purpose\nPaga un [[Pedido]].\n## Postconditions\nEmite [[EVT-Pagado]] y [[core::Saldo|saldo]].\n"
FILES = [("specs/01-domain/entities/Pedido.md", ORDER), ("specs/02-behavior/commands/CMD-001.md", COMMAND), ("specs/notes.md", "# no front matter"), ("specs/02-behavior/x.md", None), ("specs/02-behavior/Mal.md", "---\nkind: entity\n---\n")]


def test_index_of_documents(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    documents, skipped = P.parse_documents(files)
    assert {r["path"] for r in skipped.collect()} == {"specs/notes.md", "specs/02-behavior/x.md"}
    assert {r["id"]: r["warning"] is not None for r in documents.collect()} == {"Pedido": False, "CMD-001": False, "Mal": True}
    nodes = {r["id"]: r for r in E.nodes_of(documents).collect()}
    assert set(nodes) == {"Entity:Pedido", "CMD:CMD-001", "Entity:Mal"}
    order = nodes["Entity:Pedido"]
    assert (order["status"], order["aliases"], order["layer"]) == ("active", ["Compra", "Ticket"], "01-domain")
    assert order["fields_list"]["invariants"] == ["total mayor que 0", "una línea al menos"]
    assert order["fields_table"]["attributes"][1] == {"Campo": "total", "Tipo": "number", "Nota": "suma"}
    assert nodes["Entity:Mal"]["status"] == "draft" and nodes["Entity:Mal"]["fields_text"] == {}
    edges = {(r["from_node"], r["edge_type"], r["to_node"]): r for r in E.edges_of(documents).collect()}
    assert set(edges) == {
        ("Entity:Pedido", "WIKI_LINK", "Entity:Usuario"), ("Entity:Pedido", "DOMAIN_RELATION", "Entity:Usuario"), ("CMD:CMD-001", "WIKI_LINK", "Entity:Pedido"),
        ("CMD:CMD-001", "WIKI_LINK", "Event:EVT-Pagado"), ("CMD:CMD-001", "WIKI_LINK", "Entity:Saldo"), ("CMD:CMD-001", "EMITS", "Event:EVT-Pagado"),
    }
    assert edges["Entity:Pedido", "DOMAIN_RELATION", "Entity:Usuario"]["metadata"] == {"relation": "pertenece_a", "cardinality": "N:1"}
    assert edges["CMD:CMD-001", "WIKI_LINK", "Entity:Saldo"]["metadata"] == {"domain": "core", "alias": "saldo"}
    chunks = E.chunks_of(documents).collect()
    assert {(r["id"], r["raw_text"]) for r in chunks} == {("Pedido:chunk-0", "Lo que pide un [[Usuario]]."), ("CMD-001:chunk-0", "Paga un [[Pedido]].")}
    index, _ = E.index_documents(files)
    assert index.edges.count() == 1 and index.orphans.count() == 5


def test_sections(spark):
    text = "lost\n# A\nx\n## B b\n### C\ny\n## D\n```\n# not\n```\n"
    row = spark.createDataFrame([(text,)], "t string").select(P.sections(F.col("t"), True).alias("s")).first()["s"]
    assert [(s["heading"], s["level"], s["path"]) for s in row] == [("A", 1, "a"), ("B b", 2, "a.b-b"), ("C", 3, "a.b-b.c"), ("D", 2, "a.d")]
    assert [s["content"] for s in row] == ["x", "", "y", "```\n# not\n```"]


def test_pack():
    texts = lambda *a, **k: [c for _, c in E.pack(*a, **k)]
    assert texts(None) == texts(" \n\n ") == []
    assert texts("a\n\nb") == ["a\n\nb"]
    assert texts("aaaa\n\nbb\n\ncccc", most=10, overlap=2) == ["aaaa\n\nbb", "bb\n\ncccc"]
    assert texts("one two. three four. five", most=12, overlap=0) == ["one two.", "three four.", "five"]
    assert texts("x" * 50, most=10) == ["x" * 50]
