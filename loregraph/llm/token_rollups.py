"""Delta-maintained token counts (operator 10), in DataFrame operations but for the encoder.

A batch of changes holds inserts, deletes and revised counts.  Each change is signed rows: an
insert adds a document's tokens to its group, a delete takes them away, a revision takes the
old count away and adds the new one (in another group, if the source, language or tokenizer
version changed).  A batch is summed by group before it is written, so a rollup costs the
batch and not the corpus, and totals are sums of sums.

Commits are idempotent: a batch's file folder bears its name, appears by one rename of a
finished write, and a batch that is there is not written again.  A commit that dies half way
leaves no trace in the totals and can be repeated.  ``compact`` folds committed batches into a
base; the base names the batches it holds, so their folders no longer count.

Defined results: null source, language or version is a group of its own; a null count is 0; a
change of an unknown kind is an error; a batch without rows is committed all the same; groups
whose documents and tokens both come to 0 leave the totals.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.llm.bpe import count_tokens
from loregraph.llm.common import discard, materialise, new_folder

GROUP = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows of ``changes``: kind, source, lang, tokenizer, tokens and, for revisions, old_* of these.

    ``kind`` is insert, delete or revise.  Where there are no old_* columns a revision's old count is null's.
    """
    new = [F.col(c).alias(c) for c in (*GROUP, "tokens")]
    have = set(changes.columns)
    old = [(F.col(f"old_{c}") if f"old_{c}" in have else F.lit(None).cast("bigint" if c == "tokens" else "string")).alias(c) for c in (*GROUP, "tokens")]
    row = lambda sign, columns: F.struct(F.lit(sign).alias("sign"), *columns)
    known = F.when(F.col("kind") == "insert", F.array(row(1, new))).when(F.col("kind") == "delete", F.array(row(-1, new)))
    known = known.when(F.col("kind") == "revise", F.array(row(-1, old), row(1, new))).otherwise(F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(F.col("kind"), F.lit("null")))))
    return changes.select(F.explode(known).alias("c")).select("c.*")


def deltas(changes: DataFrame) -> DataFrame:
    """Additive totals of a batch by group."""
    tokens = F.coalesce(F.col("tokens"), F.lit(0)) * F.col("sign")
    return signed(changes).groupBy(*GROUP).agg(F.sum("sign").cast("bigint").alias("docs"), F.sum(tokens).cast("bigint").alias("tokens"))


@dataclass
class TokenRollups:
    """Totals kept in a folder of batches that all executors share."""

    spark: SparkSession
    folder: str

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Names of the batches and bases that are there."""
        if not self._files().exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._files().listStatus(self._path(self.folder))]
        return sorted(n for n in names if n.startswith(("batch=", "base=")))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Write a batch once; False where it was there already."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        names = self.committed()
        if f"batch={batch}" in names or batch in self._folded(names):
            return False
        return self._publish(f"batch={batch}", deltas(changes))

    def _publish(self, name: str, rows: DataFrame) -> bool:
        staged = new_folder(self.spark, "staged")
        rows.write.parquet(staged)
        return self._rename(staged, name)

    def _rename(self, staged: str, name: str) -> bool:
        files = self._files()
        files.mkdirs(self._path(self.folder))
        # a rename onto a folder that is there would move into it: the one that came first stays
        if files.exists(self._path(f"{self.folder}/{name}")):
            files.delete(self._path(staged), True)
            return False
        return files.rename(self._path(staged), self._path(f"{self.folder}/{name}"))

    def _folded(self, names: list[str]) -> set[str]:
        """Batches that the last base of ``names`` holds."""
        base = last_base(names)
        return {r[0] for r in self.spark.read.parquet(f"{self.folder}/{base}/batches").collect()} if base else set()

    def _sums(self, names: list[str]) -> DataFrame:
        """Totals by group of the last base of ``names`` and those of its batches that the base doesn't hold."""
        base, folded = last_base(names), self._folded(names)
        paths = [f"{self.folder}/{n}" for n in names if n.startswith("batch=") and n.split("=", 1)[1] not in folded]
        paths += [f"{self.folder}/{base}/totals"] if base else []
        rows = self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) now."""
        return self._sums(self.committed())

    def compact(self) -> bool:
        """Fold all committed batches into a new base; running it again or half of it changes no total.

        What counts is one listing: a batch that comes in meanwhile is neither in the base's totals
        nor in its list.  False where another compaction was quicker.
        """
        names = self.committed()
        base = last_base(names)
        folded = sorted(self._folded(names) | {n.split("=", 1)[1] for n in names if n.startswith("batch=")})
        staged = new_folder(self.spark, "staged")
        self._sums(names).write.parquet(f"{staged}/totals")
        self.spark.createDataFrame([(n,) for n in folded], "batch string").write.parquet(f"{staged}/batches")
        return self._rename(staged, f"base={int(base.split('=')[1]) + 1 if base else 1}")


def last_base(names: list[str]) -> str | None:
    return max((n for n in names if n.startswith("base=")), key=lambda n: int(n.split("=")[1]), default=None)


def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table through three batches: word counts, deletes of exact copies, counts by a tokenizer's tokens.

    Batch 1 inserts every document under ``words`` (words between ASCII blanks).  Batch 2 deletes
    those whose text another document of a smaller id has.  Batch 3 revises the rest to
    ``byte_bpe_50k``, the tokens that the encoder of operator 7 gives.  Each batch is sent twice,
    as after a lost answer; the second time changes nothing.
    """
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    rows = docs.select("doc_id", "source", "lang", words.alias("words"), F.sha2(F.col("text"), 256).alias("digest"), "text")
    counted = materialise(count_tokens(rows, public_tokenizers.path("byte_bpe_50k.json")), "counted")
    store = TokenRollups(spark, new_folder(spark, "rollups"))
    kept = counted.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("kept"))
    marked = counted.join(kept, "digest", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("kept"), F.lit(False))

    def change(kind: str, tokenizer: str, tokens: str) -> list:
        return [F.lit(kind).alias("kind"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(tokens).alias("tokens")]

    inserts = counted.select(*change("insert", "words", "words"))
    deletes = marked.where(copy).select(*change("delete", "words", "words"))
    old = [F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.lit("words").alias("old_tokenizer"), F.col("words").alias("old_tokens")]
    revised = marked.where(~copy).select(*change("revise", "byte_bpe_50k", "n_tokens"), *old)
    for name, changes in (("0001", inserts), ("0002", deletes), ("0003", revised)):
        store.commit(name, changes)
        store.commit(name, changes)
    store.compact()
    discard(counted)
    return store.totals()
