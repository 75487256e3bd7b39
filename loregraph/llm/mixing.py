"""Mixing sources to target weights (operator 4), in DataFrame operations alone.

Each row gets a hash-random key for the seed and the epoch.  The keys' range is cut into
equal parts; sums by (source, part) and their running totals give what lies before a part,
and a running sum within the part gives what lies before a row.  So no task ever holds a
whole source.  A source with a target of q sizes and a rest is taken q times whole, and
then in key order up to exactly the rest; the row at the cut gives only the words that fit.

Targets: all sources share the total of all sizes by weight; none goes above ``most`` times
its own size, and what it can't take is shared by the others by weight until none is above.

Defined results: a null text has size 0 and is never taken; null is a source of its own,
the last; equal rows (also in id) are told apart by their texts and else share one key and
are cut in any order, which changes no total; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loregraph.llm.common import quoted

#: A word, as a regular expression: a run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target): one row a source of ``sizes(source, size)``.

    Sources in ascending code-point order, null last, take ``weights`` in turn.  The share
    of a weight is found by going up the sources in the order in which they reach their
    limit: the limits reached so far leave a rest for the weights that remain.

    One task ranks the sources and makes their running sums, from one short row a source. So
    their number is assumed to fit a task, a million at most; the number of documents isn't.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    per = per.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int")))
    per = per.withColumn("limit", F.col("source_size") * most)
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("share", left.cast("double") / weights_left)
    # the first source below its limit sets the share of all that follow
    share = F.min(F.when(F.col("share") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), F.col("share")))).over(everything)
    target = F.least(F.col("limit").cast("double"), F.coalesce(share["share"] * F.col("weight"), F.col("limit").cast("double")))
    return per.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: str = "mix", parts: int = 1024, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken) of every row.

    ``epochs``: how often the whole row is taken; ``taken``: words in all, with those of
    the last, partial time.  ``parts``: ranges of the key, rounded up to a power of 16.
    """
    rows = planned(docs, seed, parts, weights, most, id_col, source, text)
    partial = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("at")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs") + partial).cast("bigint").alias("taken"))


def planned(docs: DataFrame, seed: str, parts: int, weights: tuple[float, ...], most: int, id_col: str, source: str, text: str) -> DataFrame:
    """(doc_id, source, content, size, source_size, target, epochs, rest, at) of every row.

    ``at``: words before the row in its source's order; ``rest``: words that the last,
    partial time takes of the source.
    """
    digits = max(1, (parts - 1).bit_length() + 3 >> 2)
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("content"))
    targets = source_targets(sizes, weights, most)
    budgets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
    budgets = budgets.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("bigint"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "content"))
    keyed = sizes.withColumn("key", key).withColumn("part", F.substring("key", 1, digits))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most `parts` rows a source
    sums = keyed.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    starts = sums.select("source", "part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("start"))
    plan = starts.alias("s").join(budgets.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source"))).select("s.source", "part", "start", "source_size", "target", "epochs", "rest")
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    running = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    on = (F.col("k.part") == F.col("p.part")) & F.col("k.source").eqNullSafe(F.col("p.source"))
    at = F.col("start") + F.col("inside")
    rows = running.alias("k").join(plan.alias("p"), on)
    return rows.select("doc_id", F.col("k.source").alias("source"), "content", "size", "source_size", "target", "epochs", "rest", at.alias("at"))


def mixed_rows(docs: DataFrame, seed: str = "mix", parts: int = 1024, text: str = "text", id_col: str = "doc_id", source: str = "source", n_chars: str = "n_chars", weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of the mix itself, with the columns of ``docs``: repeated by epoch, the last cut to its words.

    Rows are told apart by id, source and text, so ids may be null or repeat.  Rows equal in
    all three stand side by side in the mix; the cut falls among them in the order of their
    other columns (but maps, which have no order).
    """

    def row_key(doc, of, content):
        return F.md5(F.to_json(F.struct(doc.cast("string").alias("i"), of.cast("string").alias("s"), content.alias("c"))))

    plan = planned(docs, seed, parts, weights, most, id_col, source, text).where("size > 0 AND (epochs > 0 OR rest > at)")
    plan = plan.groupBy(row_key(F.col("doc_id"), F.col("source"), F.col("content")).alias("row")).agg(*[F.min(c).alias(c) for c in ("size", "epochs", "rest", "at")])
    # the columns of ``docs`` go as one, so that their names can't be those of the plan
    whole = docs.select(F.struct(*quoted(docs.columns)).alias("d"), row_key(F.col(id_col), F.col(source), F.md5(F.coalesce(F.col(text), F.lit("")))).alias("row"))
    joined = whole.join(plan, "row")
    others = [F.col("d").getField(f.name) for f in docs.schema if f.name not in (id_col, source, text) and "map<" not in f.dataType.simpleString()]
    before = F.row_number().over(Window.partitionBy("row").orderBy(*others, F.lit(0))) - 1  # equal rows ahead of this one
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("at") - F.col("before") * F.col("size")))
    times = F.concat(F.array_repeat("size", F.col("epochs").cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = joined.withColumn("before", before).select("d", "size", F.explode(times).alias("words"))
    own = F.col("d").getField(text)
    cut = F.when(F.col("words") >= F.col("size"), own).otherwise(F.array_join(F.slice(F.regexp_extract_all(own, F.lit(WORD), F.lit(0)), 1, F.col("words").cast("int")), " "))
    rows = rows.select("d", cut.alias("cut"))
    made = {text: F.col("cut")}
    if n_chars in docs.columns:
        made[n_chars] = F.length("cut").cast(docs.schema[n_chars].dataType)
    return rows.select(*[made.get(c, F.col("d").getField(c)).alias(c) for c in docs.columns])


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """Whole table: weights 1, 2, 3 in turn, targets of at most three times a source."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix' || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST(1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS DOUBLE) AS weight, source_size * 3 AS lim FROM per),
shares AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(lim) OVER b, 0) AS DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS share
  FROM weighed WINDOW b AS (ORDER BY lim / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT arg_min(share, lim / weight) AS share FROM shares WHERE share * weight <= lim),
targets AS (
  SELECT source, source_size, least(CAST(lim AS DOUBLE), coalesce((SELECT share FROM chosen) * weight, CAST(lim AS DOUBLE))) AS target FROM shares),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
keyed AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.epochs,
         CAST(floor(b.target - b.epochs * b.source_size + 0.5) AS BIGINT) AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(size * epochs + least(size, greatest(0, rest - ahead)) AS BIGINT) AS taken FROM keyed
"""
