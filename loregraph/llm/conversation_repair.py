"""Cheapest repair of conversations' structure by a run-length min-plus program (operator 11).

A repaired conversation's role initials are ``(s?(ua)+)?``: nothing, or an optional system turn
and then user and assistant in turn.  Edits: Keep costs 0, Rerole to user or assistant 2, Delete
3, Insert an empty user or assistant turn 2; a truncated turn that stays adds 1, a blank or
duplicate one has to go.

1. *Symbols.* A turn is one of nine symbols: its role (system, user, assistant, other) with or
   without the truncated fault, or one that must go.  What follows depends on nothing else.
2. *Runs.* The automaton has four states (nothing yet, after system, after user, after
   assistant).  A symbol's step is a 4 x 4 min-plus matrix of costs; equal consecutive symbols
   are a run, and a run of n is crossed by the matrix's n-th power, made of powers of two that
   are kept.  Costs to the end are carried over the runs from the last to the first.
3. *Unrolling.* From the first run on, each edit is the ASCII-least that keeps the cheapest cost:
   the letter alone tells the next state, so the audit is the least of all cheapest ones.  A run
   is unrolled by halves, and halves with equal costs to go (up to a constant) are kept, so a
   long run costs its logarithm and the letters.

Spark: turns are dealt by conversation and sorted, each conversation first as symbols and then
as texts.  A task thus knows the audit when the texts come by, and holds a run-length list and
the audit, never the texts.  Duplicates are found by a grouping of 128-bit hashes that combines
before its shuffle; their few repeated keys are joined back.  A conversation's digest is one
stream by its definition, so its texts pass through one task, in Arrow batches.

Defined results: nulls of ``conv_id``, ``turn``, ``role`` or ``text`` count as one space in
names, roles and texts; a null ``conv_id`` is a conversation of its own; turns are in ascending
order, null first, equal ones by role and then by text hash, repeated rows beside each other; a
role's initial is its first character, case-sensitive, and an initial other than s, u, a has to
be reroled or deleted; a conversation of which damage leaves nothing has zeros; an empty table
gives no row; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import discard, materialise

FAR = 1 << 60
Vector = tuple[int, int, int, int]
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or reroled turn.
FOLLOWS = (USER, USER, ASSISTANT, USER)
#: What costs each edit. Fixed values.
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
#: Symbols: initials, then the same truncated, then a turn that has to go.
INITIALS = "sua?"
GONE = 2 * len(INITIALS)


def symbol(initial: str, truncated: bool, gone: bool) -> int:
    if gone:
        return GONE
    return (INITIALS.index(initial) if initial and initial in "sua" else 3) + len(INITIALS) * truncated


def edits(of: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a turn with symbol ``of``, least letter first; Insert is not among them."""
    yield "D", DELETE, state
    if of == GONE:
        return
    initial, more = INITIALS[of % len(INITIALS)], TRUNCATED * (of >= len(INITIALS))
    kept = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}.get((initial, state))
    if kept is not None:
        yield "K", more, kept
    yield "R", REROLE + more, FOLLOWS[state]


def with_inserts(costs: Vector) -> Vector:
    """Costs to go where turns may be inserted first; two insertions come back to the same state."""
    once = tuple(min(costs[s], INSERT + costs[FOLLOWS[s]]) for s in range(4))
    return tuple(min(costs[s], INSERT + once[FOLLOWS[s]]) for s in range(4))


#: Costs to go after the last turn: nothing, or an assistant's turn at the end.
END = with_inserts((0, FAR, FAR, 0))


def times(a: tuple[Vector, ...], b: tuple[Vector, ...]) -> tuple[Vector, ...]:
    """Min-plus product."""
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def applied(a: tuple[Vector, ...], costs: Vector) -> Vector:
    return tuple(min(a[i][k] + costs[k] for k in range(4)) for i in range(4))


@lru_cache(maxsize=None)
def power(of: int, k: int) -> tuple[Vector, ...]:
    """The transition of 2**k turns of a symbol; at most 9 x 64 of them."""
    if k:
        half = power(of, k - 1)
        return times(half, half)
    one = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, then in edits(of, state):
            one[state][then] = min(one[state][then], cost)
    # inserted turns before this one: the rows' least over what insertions reach
    columns = [with_inserts(tuple(one[s][t] for s in range(4))) for t in range(4)]
    return tuple(tuple(columns[t][s] for t in range(4)) for s in range(4))


def across(of: int, count: int, costs: Vector) -> Vector:
    """Costs to go before a run of ``count`` equal symbols, of those after it."""
    for k in range(count.bit_length()):
        if count >> k & 1:
            costs = applied(power(of, k), costs)
    return costs


@lru_cache(maxsize=1 << 16)
def unrolled(of: int, count: int, costs: Vector, state: int) -> tuple[str, int]:
    """(letters, state after) of the least cheapest edits of a run; ``costs``: to go after it, less their minimum."""
    if count > 1:
        half = count // 2
        first, state = unrolled(of, count - half, levelled(across(of, half, costs)), state)
        second, state = unrolled(of, half, costs, state)
        return first + second, state
    letters, best = "", applied(power(of, 0), costs)
    while True:
        letter, state, done = least_choice(of, state, costs, best)
        letters += letter
        if done:
            return letters, state


def least_choice(of: int, state: int, after: Vector, before: Vector) -> tuple[str, int, bool]:
    """The least letter on a cheapest way from ``state``: (letter, state after, whether the turn is settled)."""
    choices = [(letter, then, True) for letter, cost, then in edits(of, state) if cost + after[then] == before[state]]
    if INSERT + before[FOLLOWS[state]] == before[state]:
        choices.append(("I", FOLLOWS[state], False))
    return min(choices)


def levelled(costs: Vector) -> Vector:
    low = min(costs)
    return tuple(c - low for c in costs)


def runs_of(symbols: bytes) -> list[tuple[int, int]]:
    """(symbol, count) of equal consecutive symbols."""
    if not symbols:
        return []
    seen = np.frombuffer(symbols, np.uint8)
    cuts = np.flatnonzero(np.append(True, seen[1:] != seen[:-1]))
    return list(zip(seen[cuts].tolist(), np.diff(np.append(cuts, len(seen))).tolist(), strict=True))


@lru_cache(maxsize=1 << 14)
def short_repair(symbols: bytes) -> tuple[int, str]:
    """``repair`` of few turns; many conversations are alike."""
    return repair(runs_of(symbols))


def repair(runs: list[tuple[int, int]]) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of the turns in ``runs``; of equally cheap ones the ASCII-least audit."""
    costs = [END]
    for of, count in reversed(runs):
        costs.append(across(of, count, costs[-1]))
    state, parts = START, []
    for (of, count), after in zip(runs, costs[-2::-1], strict=True):
        letters, state = unrolled(of, count, levelled(after), state)
        parts.append(letters)
    while END[state]:  # turns inserted after the last
        parts.append("I")
        state = FOLLOWS[state]
    return costs[-1][START], "".join(parts)


BLANKS = " \t\n\x0b\x0c\r"
ORDER = ["turn", "role", "h1", "h2"]


def damaged(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` after damage by crc32 of ``conv_id:turn``; dropped ones have ``there`` false."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1])) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("there"), F.explode(copies)).drop("col")


def last_sign(text: Column) -> Column:
    """The last character that is no blank; empty where there is none."""
    return F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1)


def symbol_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, repeats): narrow rows of ``damaged`` ones, and the table of repeated role and text that says which are duplicates."""
    end = last_sign(F.col("text"))
    texts = [F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", F.lit(1), "role").alias("h2")]
    narrow = rows.select("conv_id", "turn", "role", *texts, "there", (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"))
    # null conversations and turns are values like others
    key = [F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("none"), "h1", "h2"]
    each = narrow.where("there AND NOT blank").select(*key, "turn").groupBy("c", "none", "h1", "h2")
    repeats = each.agg(F.count("*").alias("times"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("first_null")).where("times > 1").drop("times")
    repeats = materialise(repeats, "repeats")
    joined = narrow.select("*", *key[:2]).join(repeats, ["c", "none", "h1", "h2"], "left")
    later = ~F.col("blank") & F.coalesce(F.when(F.col("first_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first")), F.lit(False))
    return joined.select("conv_id", *ORDER, "there", "blank", "cut", later.alias("later")), repeats


RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class _Conversation:
    """What a task holds of the conversation that goes by: symbols and counts, then the audit and a digest."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.runs: list[list[int]] = []
        self.least = self.most = self.before = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial: str | None = None
        self.audit: str | None = None
        self.at, self.state, self.cost, self.digest, self.started = 0, START, 0, hashlib.sha256(), False

    def turn(self, turn: int | None, role: str, name: tuple, blank: bool, cut: bool, later: bool) -> None:
        """Take a turn's symbol; ``name`` tells rows apart, and equal ones follow each other."""
        duplicate = not blank and (later or name == self.before)
        truncated = not blank and not duplicate and cut
        self.before = name
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        of = symbol(initial, truncated, blank or duplicate)
        if self.runs and self.runs[-1][0] == of:
            self.runs[-1][1] += 1
        else:
            self.runs.append([of, 1])
        if turn is not None:
            self.turns += turn != self.last_turn
            self.last_turn = turn
            self.least = turn if self.least is None else self.least
            self.most = turn

    def settle(self) -> None:
        if self.audit is None:
            if sum(n for _, n in self.runs) <= 16:
                self.cost, self.audit = short_repair(b"".join(bytes([of]) * n for of, n in self.runs))
            else:
                self.cost, self.audit = repair(list(map(tuple, self.runs)))

    def _write(self, line: str) -> None:
        self.digest.update((("\n" if self.started else "") + line).encode())
        self.started = True

    def _inserted(self) -> None:
        self.state = FOLLOWS[self.state]
        self._write("user:" if self.state == USER else "assistant:")
        self.at += 1

    def text(self, role: str, text: str) -> None:
        """Take the next turn's text and follow the audit."""
        self.settle()
        while self.audit[self.at] == "I":
            self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return
        if letter == "R":
            self.state = FOLLOWS[self.state]
            role = "user" if self.state == USER else "assistant"
        else:
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
        self._write(f"{role}:{text}")

    def result(self) -> tuple:
        self.settle()
        while self.at < len(self.audit):
            self._inserted()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit, self.digest.hexdigest())


#: Conversations whose results are sent on together.
SENT = 4096


def repaired(rows: DataFrame) -> DataFrame:
    """A row of ``RESULT`` for each conversation of ``rows(conv_id, turn, role, text, there)``, as ``damaged`` gives them."""
    narrow, repeats = symbol_rows(rows)
    no = F.lit(False)
    symbols = narrow.select("conv_id", F.lit(0).alias("kind"), *ORDER, "there", "blank", "cut", "later", F.lit(None).cast("string").alias("text"))
    hashes = [F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", F.lit(1), "role").alias("h2")]
    texts = rows.where("there").select("conv_id", F.lit(1).alias("kind"), "turn", "role", *hashes, "there", no.alias("blank"), no.alias("cut"), no.alias("later"), "text")
    dealt = symbols.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    columns = [c.split(" ")[0] for c in RESULT.split(", ")]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], columns)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        found: list[tuple] = []
        for batch in batches:
            values = [batch.column(c).to_pylist() for c in ("conv_id", "kind", *ORDER, "there", "blank", "cut", "later", "text")]
            for conv_id, kind, turn, role, h1, h2, there, blank, cut, later, text in zip(*values, strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        found.append(now.result())
                    now = _Conversation(conv_id)
                if kind:
                    now.text(role, text)
                elif there:
                    now.turn(turn, role, (turn, role, h1, h2), blank, cut, later)
            if len(found) >= SENT:
                yield batch_of(found)
                found = []
        if now is not None:
            found.append(now.result())
        if found:
            yield batch_of(found)

    result = materialise(dealt.mapInArrow(walk, RESULT), "repaired")
    discard(repeats)
    return result


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """A row of ``RESULT`` for each conversation as it is, without damage."""
    spaced = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    return repaired(conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *spaced, F.lit(True).alias("there")))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """A row of ``RESULT`` for each conversation after the damage that its rows' names decide."""
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return repaired(damaged(rows))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Whole table ``conversations``, damaged and repaired."""
    return repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
