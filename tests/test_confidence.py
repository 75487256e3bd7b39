"""Suggested edges by rules with a confidence."""

import re

from loregraph.operators import confidence as K
from loregraph.operators import extract as E
from loregraph.operators import parse as P

TEXT = """---
kind: use-case
id: UC-1
related: ["[[Pedido]]", 'UC-1']
implements: REQ-9
---
# Caso

Un actor Cliente usa el sistema: Pagos y la entidad Pedido con BR-2 y [[BR-2|regla]]; véase UC-1, XUC-7 y BR-3-b.

## Nota de user  Cliente

El caso de uso Cobrar sigue la regla Doble.
"""


def documents(spark, texts):
    return P.parse_documents(spark.createDataFrame([(f"d/D{i}.md", t) for i, t in enumerate(texts)], "path string, content string"))[0]


def test_best_rule_of_each_edge(spark):
    rows = K.scored_edges(documents(spark, [TEXT])).collect()
    assert {(r["to_node"], r["edge_type"]): (r["confidence"], r["extraction_method"]) for r in rows} == {
        ("Entity:Pedido", "RELATED_TO"): (1.0, "front_matter"), ("REQ:REQ-9", "IMPLEMENTS"): (1.0, "front_matter"), ("BR:BR-2", "REFERENCES"): (0.9, "wiki_link"),
        ("BR:BR-3-b", "REFERENCES"): (0.8, "identifier"), ("Actor:Cliente", "REFERENCES"): (0.8, "named_actor"), ("System:Pagos", "REFERENCES"): (0.8, "named_system"),
        ("Entity:Pedido", "REFERENCES"): (0.8, "named_entity"), ("UC:Cobrar", "REFERENCES"): (0.85, "named_use_case"), ("BR:Doble", "REFERENCES"): (0.85, "named_rule"),
        ("BR:y", "REFERENCES"): (0.85, "named_rule"),
    }
    assert len(rows) == 10


def test_threshold_and_own_rules(spark):
    found = documents(spark, [TEXT])
    assert {r["to_node"] for r in K.scored_edges(found, least=0.9).collect()} == {"Entity:Pedido", "REQ:REQ-9", "BR:BR-2"}
    assert K.scored_edges(found, least=1.1).collect() == [] and K.scored_edges(found, []).columns == K.scored_edges(found).columns
    rules = [K.Rule("weak", 0.6, pattern=r"(Cliente)", prefix="Actor"), K.Rule("strong", 0.7, pattern=r"(Cliente)", prefix="Actor"), K.Rule("late", 0.7, pattern=r"(Client)e", prefix="Actor"), K.Rule("tie", 0.7, pattern=r"(Cliente)", prefix="Actor")]
    assert {(r["to_node"], r["extraction_method"]) for r in K.scored_edges(found, rules).collect()} == {("Actor:Cliente", "strong"), ("Actor:Client", "late")}


def test_equal_to_brute_force_on_links_and_ids(spark):
    texts = [f"---\nkind: adr\n---\n# T\n{'[[A%d]] ' % (i % 4)}{'BR-%d ' % (i % 3) * (i % 5)}[[BR-{i % 3}]] CMD-{i}\n" for i in range(40)]
    wanted = set()
    for i, text in enumerate(texts):
        body = text.split("---\n", 2)[2]
        links = re.findall(r"\[\[([^\]]+)\]\]", body)
        node = lambda n: f"{n.split('-')[0]}:{n}" if n.startswith(("BR-", "CMD-")) else f"Entity:{n}"
        for n in {*links, *re.findall(r"(?:BR|CMD)-\w+", body)}:
            wanted.add((f"ADR:D{i}", node(n), 0.9 if n in links else 0.8))
        for n in re.findall(r"BR-\d+\s+(\w+)", body):
            wanted.add((f"ADR:D{i}", f"BR:{n}", 0.85))
    assert {(r["from_node"], r["to_node"], r["confidence"]) for r in K.scored_edges(documents(spark, texts)).collect()} == wanted


def test_mentions_without_a_document(spark):
    found = documents(spark, [TEXT, "---\nkind: adr\n---\n# x\nactor Cliente\n", "---\nkind: adr\n---\n", "---\nkind: entity\nid: Pedido\n---\n# p\n"])
    rows = {r["id"]: (r["confidence"], r["documents"]) for r in K.mentions(found, E.nodes_of(found)).collect()}
    assert rows["Actor:Cliente"] == (0.8, 2) and "Entity:Pedido" not in rows and rows["REQ:REQ-9"] == (1.0, 1)
