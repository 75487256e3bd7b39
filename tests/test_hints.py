"""Hints to nodes, against reading them one after the other."""

import random
from types import SimpleNamespace

from loregraph.operators.substring import open_texts, write_texts
from loregraph.plans import queries as Q
from loregraph.schema import NODES


def nodes_of(spark, rows):
    made = [{"id": i, "kind": "entity", "aliases": a, "fields_text": {"description": d}, "fields_list": {"invariants": inv}} for i, a, d, inv in rows]
    names = [c.split()[0] for c in NODES.split(", ")]
    return spark.createDataFrame([[m.get(n) for n in names] for m in made], NODES)


def brute(rows, hints):
    texts = {i: [i.lower(), *[x.lower() for x in a], d.lower(), ",".join(inv).lower()] for i, a, d, inv in rows}
    taken, warnings = {}, []
    search = lambda q: [i for i, t in texts.items() if any(q.lower() in v for v in t)]

    def take(ids, hint, method, seq):
        new = [i for i in ids if i not in taken]
        taken.update({i: (hint, method, seq) for i in new})
        return bool(new)

    for seq, hint in enumerate(hints):
        if ":" in hint and hint in texts:
            take([hint], hint, "exact", seq)
            continue
        if "/" in hint or "." in hint:
            base = Q.basename(hint)
            if take([v for v in Q.name_variants(base) if v in texts], hint, "basename", seq) or take(search(base), hint, "text_search", seq):
                continue
        if not set(hint) & set(":/.") and take([v for v in Q.name_variants(hint) if v in texts], hint, "exact", seq):
            continue
        words = hint.split()
        found = [i for i in search(words[0]) if all(w.lower() in " ".join(texts[i]) for w in words[1:])] if len(words) > 1 else search(hint)
        if not take(found, hint, "text_search", seq):
            warnings.append(f"No match found for hint: '{hint}'")
    return taken, warnings


def found(index, hints):
    rows, warnings = Q.resolve_hints(index, hints)
    return {r["node_id"]: (r["matched_from"], r["match_method"], r["seq"]) for r in rows.collect()}, warnings


def test_hints_that_take_from_each_other(spark, tmp_path):
    rows = [("Entity:Order", ["Sale"], "a sale of goods", []), ("UC:Order", [], "orders goods", []), ("BR:Goods", [], "goods are whole", ["x.y", "goods"]), ("CMD:pay", ["Sale pay"], "PAYS", [])]
    rng = random.Random(5)
    pool = ["Order", "order", "Goods", "docs/Order.md", "x.y", "sale", "Sale pay", "goods order", "pay", "PAY", "Entity:Order", "UC:none", "none", "a/none.md", "BR:Goods", "goods", "p", "", "CMD:pay"]
    cases = [[], ["order", "Order", "order"], ["Entity:Order", "UC:Order", "Order", "goods", "goods"], *[rng.choices(pool, k=rng.randint(2, 8)) for _ in range(6)]]
    nodes = nodes_of(spark, rows)
    plain = SimpleNamespace(nodes=nodes, texts=None)
    for case in cases:
        assert found(plain, case) == brute(rows, case), case
    root = f"file://{tmp_path}/texts"
    write_texts(nodes, root, 4)
    stored = SimpleNamespace(nodes=nodes, texts=open_texts(spark, root, nodes, 4))
    for case in cases[3:5]:
        assert found(stored, case) == brute(rows, case), case


def test_no_nodes(spark):
    assert found(SimpleNamespace(nodes=nodes_of(spark, []), texts=None), ["a", "b c"]) == ({}, ["No match found for hint: 'a'", "No match found for hint: 'b c'"])
