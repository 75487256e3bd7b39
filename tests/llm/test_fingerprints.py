"""Fingerprints: defined edge results, the edited texts, and likeness against edits."""

import hashlib
import random

import pytest

from loregraph.llm.fingerprints import SCALE_STARTS, edited_fingerprints, fingerprint, fingerprints, likeness, likenesses, near_pairs


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_likeness_follows_edits():
    rng = random.Random(3)
    for n in (20, 200, 2000):
        text = words(rng, n)
        other = words(rng, n)
        middle = len(text) // 2
        changed = text[:middle] + "qq" + text[middle:]
        a, b, c = fingerprints([text, changed, other])
        assert likeness(a, b) > likeness(a, c) + 0.3
        assert likeness(a, a) == 1.0
    assert fingerprints(["abc", "abc"])[0] == fingerprints(["abc"])[0]
    assert likeness(*fingerprints(["", ""])) == 1.0
    assert likeness(*fingerprints(["", "abc"])) == 0.0


MASK = (1 << 64) - 1


def mixed(x):
    """The splitmix64 finaliser on plain integers."""
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def walk(text):
    """The embedding of a text, step by step: the character at each step, one hex digit of its hash each."""
    out, at = [], 0
    while at < len(text):
        code = ord(text[at])
        out.append(f"{mixed(code) >> 60:x}")
        at += mixed(code % 251 * 4096 + (len(out) - 1) % 4096) >> 40 & 1
    return "".join(out)


def test_same_digits_as_a_plain_walk():
    """Of each scale [2^k, 2^(k+1)) steps, counted from one, at most 32 fixed places are sampled."""
    rng = random.Random(4)
    texts = ["a", "ab", "é\u4e2d🙂x", "a" * 300, *("".join(rng.choice("abc déß中🙂") for _ in range(rng.randint(1, 3000))) for _ in range(20))]
    for text, mark in zip(texts, fingerprints(texts)):
        steps, want = walk(text), []
        for k in range(31):
            low = 1 << k
            drawn = range(low) if low <= 32 else sorted({mixed(i + (k << 32)) % low for i in range(32)})
            if low > len(steps):
                break
            want += [steps[low + d - 1] if low + d <= len(steps) else "." for d in drawn]
        assert mark.rstrip(".") == "".join(want).rstrip(".") and len(mark) in SCALE_STARTS


def test_recall_at_few_edits(spark):
    """With 1 of 500 characters edited, nine of ten texts are joined up with their edited copy at a likeness of 0.8."""
    share, least, recall = 0.002, 0.8, 0.9
    rng = random.Random(11)
    base = [words(rng, 220) for _ in range(60)]
    rows = []
    for i, text in enumerate(base):
        edited = list(text)
        for _ in range(max(1, int(len(text) * share))):
            at = rng.randrange(len(edited))
            edited[at : at + 1] = rng.choice(([], ["q"], [edited[at], "z"]))
        rows += [(2 * i, text), (2 * i + 1, "".join(edited))]
    prints = fingerprint(spark.createDataFrame(rows, "doc_id bigint, text string"))
    links = [(r["a"], r["b"]) for r in near_pairs(prints, least=least).collect()]
    joined = components([i for i, _ in rows], links)
    found = sum(joined[2 * i] == joined[2 * i + 1] for i in range(len(base)))
    assert found >= recall * len(base)
    assert all(a // 2 == b // 2 for a, b in links)


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        a, b, c = fingerprints([text, edited, after])
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    return out


@pytest.mark.parametrize("parts", [1, 3])
def test_next_over_shards(spark, parts):
    rng = random.Random(4)
    rows = [(i * 3, words(rng, rng.randint(1, 40))) for i in range(60)] + [(1, None), (2, ""), (None, "no id é🙂"), (9, "same id"), (9, "same id too"), (200, "ü" * 50_000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, 1, "f") for d, t in rows], "doc_id bigint, text string, shard int, fingerprint string").repartition(5)
    found = sorted(map(tuple, edited_fingerprints(docs, parts=parts).collect()), key=str)
    assert found == sorted(brute(rows), key=str)


def test_one_row_and_none(spark):
    schema = "doc_id bigint, text string"
    (row,) = edited_fingerprints(spark.createDataFrame([(1, "abcdefgh")], schema)).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and row["near_next"] == 1.0
    assert edited_fingerprints(spark.createDataFrame([], schema)).collect() == []


def test_near_pairs(spark):
    rng = random.Random(6)
    base = [words(rng, 150) for _ in range(5)]
    rows = [(10 * i + k, t if k == 0 else t[: len(t) * 3 // 4] + "x" + t[len(t) * 3 // 4 :]) for i, t in enumerate(base) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    root = {r: r for r, _ in rows}
    for r in near_pairs(fingerprint(docs), least=0.6).collect():
        root[r["b"]] = min(root[r["b"]], r["a"])
    assert all(root[r] < 10 * (r // 10) + 2 for r, _ in rows)
    assert len({root[root[r]] for r, _ in rows}) == len(base)


def components(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_near_pairs_among_unrelated_texts_of_their_bands(spark):
    rng = random.Random(8)
    last = int(SCALE_STARTS[8] - SCALE_STARTS[7])
    rows = []
    for g in range(4):  # all of a group share every band, but its last scale tells them apart
        head = "".join(rng.choice("0123456789abcdef") for _ in range(int(SCALE_STARTS[7])))
        tails = ["".join(rng.choice("0123456789abcdef") for _ in range(last)) for _ in range(45)]
        for k, tail in enumerate(tails):
            rows.append((1000 * g + k, head + tail))
            if k > 30:  # near texts of larger ids only
                rows.append((1000 * g + 100 + k, head + tail[:-3] + "".join(rng.choice("0123456789abcdef") for _ in range(3))))
    rows += [(5000, rows[0][1]), (5001, rows[-1][1]), (None, rows[0][1]), (rows[7][0], rows[-1][1][:-1] + "0")]
    found = near_pairs(spark.createDataFrame(rows, "doc_id bigint, fingerprint string")).collect()
    named = [r for r in rows if r[0] is not None]
    near = {(min(a, b), max(a, b)) for i, (a, x) in enumerate(named) for b, y in named[:i] if a != b and likeness(x, y) >= 0.8}
    assert {(r["a"], r["b"]) for r in found} <= near and len(found) == len({(r["a"], r["b"]) for r in found})
    ids = {d for d, _ in named}
    assert components(ids, [(r["a"], r["b"]) for r in found]) == components(ids, near)


def test_likenesses_are_likeness():
    rng = random.Random(9)
    prints = fingerprints(["", "a", "ab"] + [words(rng, n) for n in (1, 3, 40, 41, 300)])
    pairs = [(a, b) for a in prints for b in prints]
    assert likenesses(*map(list, zip(*pairs))).tolist() == pytest.approx([likeness(a, b) for a, b in pairs])
