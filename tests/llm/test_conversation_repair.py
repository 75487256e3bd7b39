"""Conversation repair against a search over all edit strings and a plain pass over the rows."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loregraph.llm import conversation_repair as cr

VALID = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WORD = re.compile("[^\x20\x09-\x0d]")


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        if kind:
            yield from [(conv, turn, role, text)] * (2 if kind == 3 else 1)


def faults(rows):
    """The first fault of each (role, text)."""
    seen = set()
    for role, text in rows:
        signs = WORD.findall(text)
        yield "blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else ""
        seen.add((role, text))


def search(rows, found):
    """Uniform-cost search over (position, initials' state): the cheapest edits, of equal cost the least string."""
    queue = [(0, "", 0, "", ())]
    best = None
    seen = {}
    while queue:
        cost, audit, at, roles, lines = heapq.heappop(queue)
        if best is not None and cost > best[0]:
            break
        if at == len(rows) and VALID.fullmatch(roles):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, lines)
        state = "" if not roles else roles[-1]
        if seen.setdefault((at, state), cost) < cost:
            continue
        for letter, role in (("I", "user"), ("I", "assistant")):
            if allowed(roles, role[0]):
                heapq.heappush(queue, (cost + 2, audit + letter, at, roles + role[0], (*lines, f"{role}:")))
        if at == len(rows):
            continue
        (role, text), fault = rows[at], found[at]
        heapq.heappush(queue, (cost + 3, audit + "D", at + 1, roles, lines))
        if fault in ("blank", "duplicate"):
            continue
        more = fault == "truncated"
        if role and allowed(roles, role[0]):
            heapq.heappush(queue, (cost + more, audit + "K", at + 1, roles + role[0], (*lines, f"{role}:{text}")))
        for other in ("user", "assistant"):
            if allowed(roles, other[0]):
                heapq.heappush(queue, (cost + 2 + more, audit + "R", at + 1, roles + other[0], (*lines, f"{other}:{text}")))
    return best


def allowed(roles, initial):
    return any(VALID.fullmatch(roles + initial + tail) for tail in ("", "a", "ua"))


def brute(rows, damage=damage):
    convs = {}
    for row in rows:
        convs.setdefault(row[0], [])
    for row in damage(rows):
        convs[row[0]].append(row)
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        pairs = [(r[2], r[3]) for r in turns]
        found = list(faults(pairs))
        known = [r[1] for r in turns if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(pairs, pairs[1:]))
        cost, audit, lines = search(pairs, found)
        yield (conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def run(spark, rows):
    return sorted(map(tuple, cr.repair_damaged(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_search(seed):
    """All kinds of symbols in short and long runs, without Spark."""
    rng = random.Random(seed)
    for _ in range(60):
        rows, found = [], []
        for _ in range(rng.randint(0, 4)):
            role, fault = rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["", "", "truncated", "blank"])
            for _ in range(rng.choice([1, 1, 2, 3])):
                rows.append((role, f"t{len(rows)}."))
                found.append(fault)
        symbols = bytes(cr.symbol(r[:1], f == "truncated", f == "blank") for (r, _), f in zip(rows, found))
        assert cr.repair(cr.runs_of(symbols)) == search(rows, found)[:2], rows


def test_long_runs_equal_single_steps():
    """Binary powers and halves give what one turn after the other gives."""
    rng = random.Random(7)
    for _ in range(30):
        runs = [(rng.randrange(9), rng.choice([1, 2, 63, 64, 100, 257])) for _ in range(rng.randint(1, 5))]
        singles = [(of, 1) for of, n in runs for _ in range(n)]
        assert cr.repair(runs) == cr.repair(singles)


def test_a_run_of_a_million_turns():
    cost, audit = cr.repair([(cr.symbol("u", False, False), 10**6)])
    assert cost == 10**6 and len(audit) == 10**6 and set(audit[:-1]) == {"K", "R"}


def test_conversations_against_search(spark):
    rng = random.Random(11)
    texts = ["A calm answer.", "No end", "Why?", "", " \t", "Yes!", "tail. \n", None]
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, ""]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, 2 * turn + rng.randint(0, 1), role, rng.choice(texts) if rng.random() < 0.4 else f"Turn {turn} of {conv}."))
    assert run(spark, rows) == sorted(brute(rows), key=repr)


def test_odd_rows(spark):
    long = "word " * 60_000 + "."
    rows = [(None, None, None, None), (None, 1, "user", "a."), (1, None, "user", "a."), (1, None, "user", "a."), (1, 5, "user", "a."), (1, 9, "assistant", "b."), (2, 3, "user", long), (2, 3, "user", long), (2, 4, "assistant", "é  ")]
    rows += [(c, 0, "user", "hi.") for c in range(3, 80)]  # some of them are dropped
    assert run(spark, rows) == sorted(brute(rows), key=repr)
    clashing = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("v").alias(c) for c in ("kind", "h1", "there", "c", "none", "first", "col", "Later")])
    assert sorted(map(tuple, cr.repair_damaged(clashing).collect()), key=repr) == run(spark, rows)
    assert cr.repair_damaged(clashing.limit(0)).collect() == []


def test_without_damage(spark):
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "Hello?"), (1, 3, "assistant", "Yes."), (2, 1, "system", "Be kind."), (3, 1, "user", "Go."), (3, 2, "assistant", "Gone.")]
    found = {r["conv_id"]: r for r in cr.repair_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[3]["cost"] == 0 and found[3]["audit"] == "KK"
    assert found[2]["cost"] == 3 and found[2]["audit"] == "D"
    assert found[1]["cost"] == 2 and found[1]["audit"] == "KIKK"
    assert found[1]["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:\nuser:Hello?\nassistant:Yes.").hexdigest()


def test_hot_conversation(spark):
    """A conversation with most of the rows, many of them repeats."""
    rows = [(7, t, ("user", "assistant")[t % 2], f"Text {t % 500}.") for t in range(4000)] + [(c, 0, "user", "hi.") for c in range(100, 300)]
    found = {r["conv_id"]: r for r in cr.repair_damaged(spark.createDataFrame(rows, SCHEMA)).collect()}
    turns = [r for r in damage(rows) if r[0] == 7]
    kinds = list(faults([(r[2], r[3]) for r in turns]))
    assert (found[7]["duplicate"], found[7]["blank"], found[7]["truncated"]) == tuple(kinds.count(k) for k in ("duplicate", "blank", "truncated"))
    letters = [x for x in found[7]["audit"] if x != "I"]
    assert len(letters) == len(turns) and all(x == "D" for x, k in zip(letters, kinds) if k in ("blank", "duplicate"))


def test_whole_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = cr.op11_conversation_repair(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute(rows), key=repr)
