"""Interaction of filters: what each removes, alone, in every order and on average (operator 12).

1. *Masks.* A document has a bit for each filter that it fails.  Five filters are column
   expressions; the last, copies of a smaller id, is a grouping by 128-bit text hashes that
   combines before its shuffle, of which only the repeated ones are joined back.
2. *Cells.* Documents are counted by part, mask and label, at most 32 masks a part: what follows
   depends on these counts alone, whatever the number of documents.
3. *Gray-code walk.* The 32 sets of active filters are visited so that each differs from the one
   before by one filter.  A cell holds the number of active filters that it fails; toggling a
   filter moves the counters of the cells that fail it, and those that leave or reach zero leave
   or join the running survivors.  The survivors of the 32 states are stored.
4. *Steps.* A step of an order is the difference of two stored states, and a filter's Shapley sum
   weighs its 16 differences by the number of orders that have them.

Defined results: a null text is empty; a null ``lang`` is the part of the empty string; a
document without a label is neither good nor toxic, and one with several counts as what any
says; a null id is no smaller id and has none below it; rows with one id and one text are no
copies of each other; other columns are not looked at; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import discard, materialise

LETTERS = "ABCDE"
#: Words are maximal runs of characters that aren't these.
BLANKS = r"\x20\x09-\x0D"


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, f"[{BLANKS}]+"), lambda w: w != "")


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Whether a document fails each filter that its text alone decides."""
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, part, mask) of every row of ``docs(doc_id, text, lang)``, the table of repeated texts it reads)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select("doc_id", "part", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.length("text"), "text", F.lit(1)).alias("h2"))
    repeats = keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    repeats = materialise(repeats, "repeats")
    bits = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(text_filters(F.col("text"), F.col("words")).values())), F.lit(0))
    narrow = keyed.withColumn("words", word_list(F.col("text"))).select("doc_id", "part", "h1", "h2", bits.alias("bits"))
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    found = narrow.join(repeats, ["h1", "h2"], "left").select("doc_id", "part", (F.col("bits") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"))
    return found, repeats


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): counts of documents, of those with quality 1 and with toxic 1."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = masked.join(marks, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("docs"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


Counts = tuple[int, int, int]


def gray_states(found: dict[int, Counts], filters: int = len(LETTERS)) -> list[Counts]:
    """(docs, good, toxic) that survive each set of active filters, by the set's bits; one filter is toggled at a time."""
    failing = dict.fromkeys(found, 0)
    now = [sum(c[i] for c in found.values()) for i in range(3)]
    states: list[Counts] = [(0, 0, 0)] * (1 << filters)
    states[0] = tuple(now)
    active = 0
    for step in range(1, 1 << filters):
        bit = step & -step  # the one that the Gray code changes here
        active ^= bit
        on = 1 if active & bit else -1
        for mask, counts in found.items():
            if mask & bit:
                before = failing[mask]
                failing[mask] = before + on
                if before == 0 or before + on == 0:
                    for i in range(3):
                        now[i] -= on * counts[i]
        states[active] = tuple(now)
    return states


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)


def audit_rows(part: str, found: dict[int, Counts]) -> Iterator[tuple]:
    """A row of ``RESULT`` for each step of each order of the filters."""
    n = len(LETTERS)
    states = gray_states(found)
    fails = [sum(c[0] for mask, c in found.items() if mask >> f & 1) for f in range(n)]
    unique = [found.get(1 << f, (0, 0, 0))[0] for f in range(n)]
    shapley = [0] * n
    for f in range(n):
        for active in range(1 << n):
            if not active >> f & 1:
                ahead = active.bit_count()
                shapley[f] += factorial(ahead) * factorial(n - 1 - ahead) * (states[active][0] - states[active | 1 << f][0])
    for order in permutations(range(n)):
        active = 0
        for step, f in enumerate(order, 1):
            before, active = states[active], active | 1 << f
            after = states[active]
            removed, good, toxic = (b - a for b, a in zip(before, after, strict=True))
            yield (part, "".join(LETTERS[i] for i in order), step, after[0], removed, fails[f] - removed, unique[f], good, toxic, shapley[f])


def audit(counted: DataFrame) -> DataFrame:
    """Rows of ``RESULT`` from ``cells``: a part's cells, 32 at most, meet in one task."""
    names = [c.split(" ")[0] for c in RESULT.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * len(COUNTS)

    def rows(part: str, found: dict[int, Counts]) -> pa.RecordBatch:
        made = list(zip(*audit_rows(part, found), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds, strict=True)], names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != now and found:
                    yield rows(now, found)
                    found = {}
                now = r["part"]
                found[r["mask"]] = (r["docs"], r["good"], r["toxic"])
        if found:
            yield rows(now, found)

    return counted.repartition("part").sortWithinPartitions("part").mapInArrow(walk, RESULT)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``RESULT``: every part's filters, order and step."""
    masked, repeats = masks(docs)
    counted = materialise(cells(masked, labels), "cells")
    discard(repeats)
    return audit(counted)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Whole tables ``documents`` and ``labels``."""
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Counts each order and step from the documents, without the cells' states.
OP12_SQL = r"""
WITH docs AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), first AS (
    SELECT text, min(doc_id) AS least FROM docs GROUP BY text
), marked AS (
    SELECT part, doc_id, least, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words
    FROM docs JOIN first USING (text)
), marks AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), failed AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        concat(
            CASE WHEN len(words) < 100 THEN 'A' ELSE '' END,
            CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END,
            CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 'C' ELSE '' END,
            CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
            CASE WHEN doc_id > least THEN 'E' ELSE '' END
        ) AS fails
    FROM marked LEFT JOIN marks USING (doc_id)
), counted AS (
    SELECT part, fails, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT filter_order, step, filter_order[step] AS letter, filter_order[:step - 1] AS ahead
    FROM orders, (SELECT unnest(range(1, 6)) AS step)
), removed AS (
    SELECT part, filter_order, step, letter,
        CASE WHEN ahead = '' THEN false ELSE len(list_intersect(string_split(ahead, ''), string_split(fails, ''))) > 0 END AS gone,
        contains(fails, letter) AS failing, fails = letter AS only_this, docs, good, toxic
    FROM counted, steps
), summed AS (
    SELECT part, filter_order, step, letter,
        sum(CASE WHEN NOT gone AND NOT failing THEN docs ELSE 0 END) AS kept,
        sum(CASE WHEN NOT gone AND failing THEN docs ELSE 0 END) AS removed,
        sum(CASE WHEN gone AND failing THEN docs ELSE 0 END) AS redundant,
        sum(CASE WHEN only_this THEN docs ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END) AS toxic_lost
    FROM removed GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM summed
"""
