"""Substring search: a scan of all nodes, and trigram postings that leave few nodes to look at.

A node's texts are lower-cased; a posting names a node for each three characters that follow
each other in one of them.  A needle's nodes have all of its trigrams, so the rarest few of
these are intersected and what is left is verified by the scan's own condition: the result is
that of the scan.  Needles under three characters have no trigram and are scanned for.

Postings are bucketed by *slot*: the trigram, or, for one of more than ``MOST`` nodes, one of
several by the node, so that no bucket grows with one frequent trigram.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.functions.storage import bucketed_table, write_bucketed

#: Characters of a gram; fixed by the stored tables.
GRAM = 3
#: Of a needle's grams, so many of the rarest are intersected: further ones seldom take away a node.
RAREST = 4
#: Nodes of a gram beyond which its postings have several slots.
MOST = 4_000_000
#: Candidates up to which nodes are looked up by value.
PROBE = 1000
#: Parts a slot's name; a gram has three characters, so no other slot's name is longer.
MARK = "\x01"


#: Columns of nodes that are searched.
SEARCHED = ("id", "aliases", "fields_text", "fields_list")


def searchable(fields: list[str] | None = None) -> Column:
    """A node's searched texts, lower-cased: id, aliases, text fields, list fields joined by commas."""
    texts, lists = F.col("fields_text"), F.col("fields_list")
    if fields:
        wanted = F.array(*[F.lit(f) for f in fields])
        texts, lists = (F.map_filter(m, lambda k, _: F.array_contains(wanted, k)) for m in (texts, lists))
    none = F.array().cast("array<string>")
    values = F.concat(F.coalesce(F.map_values(texts), none), F.coalesce(F.transform(F.map_values(lists), lambda v: F.array_join(v, ",")), none))
    every = F.concat(F.array("id"), F.coalesce(F.col("aliases"), none), F.filter(values, lambda v: v.isNotNull()))
    return F.transform(every, F.lower)


def text_search(nodes: DataFrame, query: str, fields: list[str] | None = None) -> DataFrame:
    """Nodes any of whose texts contains the query."""
    return nodes.where(F.exists(searchable(fields), lambda v: F.contains(v, F.lit(query.lower()))))


def all_words_search(nodes: DataFrame, words: list[str]) -> DataFrame:
    """Nodes with the first word in a text and all others in all texts joined by blanks."""
    found = text_search(nodes, words[0])
    joined = F.array_join(searchable(), " ")
    for word in words[1:]:
        found = found.where(F.contains(joined, F.lit(word.lower())))
    return found


def grams_of(texts: Column) -> Column:
    """Distinct trigrams of lower-cased texts, each within one text; linear in their lengths."""

    def each(text: Column) -> Column:
        signs = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - GRAM), lambda i: F.concat(*[F.get(c, i + k) for k in range(GRAM)]))
        return F.when(F.length(text) >= GRAM, F.get(F.transform(F.array(F.split(text, "")), signs), F.lit(0))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(texts, each)))


def grams_in(needle: str) -> list[str]:
    low = needle.lower()
    return sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})


@dataclass
class TextIndex:
    """``postings(slot, id)``, ``grams(gram, nodes, slots)``, and the nodes themselves, bucketed by id."""

    nodes: DataFrame
    postings: DataFrame
    grams: DataFrame

    def candidates(self, needles: list[str]) -> DataFrame | None:
        """(id) of nodes that have the rarest trigrams of the needles; none if no needle has a trigram."""
        wanted = sorted({g for n in needles for g in grams_in(n)})
        if not wanted:
            return None
        known = self.grams.where(F.col("gram").isin(wanted)).collect()  # a row for each of the needles' grams
        if len(known) < len(wanted):
            return self.nodes.select("id").limit(0)
        rare = sorted(known, key=lambda r: (r["nodes"], r["gram"]))[:RAREST]
        found = self.postings.where(F.col("slot").isin([s for r in rare for s in slots_of(r["gram"], r["slots"])]))
        return found.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select("id")

    def rows(self, needles: list[str]) -> DataFrame:
        """Nodes to verify: those of the candidates, or all."""
        found = self.candidates(needles)
        if found is None:
            return self.nodes
        few = found.limit(PROBE + 1).collect()
        if len(few) <= PROBE:
            return self.nodes.where(F.col("id").isin([r["id"] for r in few]))
        return self.nodes.join(found, "id", "left_semi")

    def search(self, query: str, fields: list[str] | None = None) -> DataFrame:
        """What ``text_search`` finds among all nodes."""
        return text_search(self.rows([query]), query, fields)

    def search_words(self, words: list[str]) -> DataFrame:
        """What ``all_words_search`` finds among all nodes; words have no blanks, so each lies within one text."""
        return all_words_search(self.rows(words), words)


def slots_of(gram: str, count: int) -> list[str]:
    return [gram if k == 0 else f"{gram}{MARK}{k}" for k in range(count)]


def write_texts(nodes: DataFrame, root: str, buckets: int, most: int = MOST) -> None:
    """Write the postings of ``nodes`` to the new folder ``root``."""
    spark = nodes.sparkSession
    each = nodes.select("id", F.explode(grams_of(searchable())).alias("gram"))
    each.groupBy("gram").agg(F.count("*").alias("nodes")).withColumn("slots", F.ceil(F.col("nodes") / most).cast("int")).write.parquet(f"{root}/grams")
    split = spark.read.parquet(f"{root}/grams").where("slots > 1").select("gram", "slots")
    part = F.pmod(F.xxhash64("id"), F.coalesce("slots", F.lit(1)))
    slot = F.when(part > 0, F.concat("gram", F.lit(MARK), part.cast("string"))).otherwise(F.col("gram"))
    write_bucketed(each.join(split, "gram", "left").select(slot.alias("slot"), "id"), f"{root}/postings", "slot", buckets)


def open_texts(spark: SparkSession, root: str, nodes: DataFrame, buckets: int) -> TextIndex:
    return TextIndex(nodes, bucketed_table(spark, f"{root}/postings", "slot", buckets), spark.read.parquet(f"{root}/grams"))
