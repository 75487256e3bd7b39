"""What the operators of this subpackage share: the shared folder, files in it, ordered shards."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.functions.storage import discard, new_folder, shared_folder
from loregraph.functions.storage import persisted as materialise

__all__ = ["committed_output", "discard", "filesystem", "hash_sample", "materialise", "new_folder", "ordered_shards", "quoted", "range_bounds", "returning_memory", "schema_of", "shard_of", "shared_folder", "shuffle_partitions", "unused_name", "without"]


def unused_name(name: str, *taken: str) -> str:
    """``name``, or the first of name_, name__ ... that none of ``taken`` is, in any case."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name += "_"
    return name


def without(columns: list[str], *names: str) -> list[str]:
    """``columns`` but those of these names, in any case."""
    gone = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in gone]


def quoted(columns: list[str]) -> list:
    return [F.col(f"`{c}`") for c in columns]


def schema_of(df: DataFrame, columns: list[str], made: dict[str, str]) -> str:
    """Schema text of ``columns`` of ``df`` followed by further ones."""
    kept = df.select(*quoted(columns)).schema
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{n}` {t}" for n, t in made.items()])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str):
    """(file system, path in it) of a URI, by pyarrow: local, HDFS and object stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def return_memory() -> None:
    """Hand what this process has freed back to the system; else allocators keep it for later use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def returning_memory(function: Callable) -> Callable:
    """A function over Arrow batches after whose last one the worker, which Spark keeps for further tasks, returns freed memory."""

    @wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            return_memory()

    return run


@contextmanager
def committed_output(uri: str) -> Iterator:
    """An output stream whose file appears under ``uri`` only once it is whole.

    Each attempt of a task writes a name of its own and renames it at the end, so a
    repeated or speculative attempt replaces the file by an equal one.
    """
    files, path = filesystem(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    context = TaskContext.get()
    attempt = f"{path}.attempt-{context.taskAttemptId() if context else 0}-{uuid.uuid4().hex}"
    stream = files.open_output_stream(attempt, compression=None)
    try:
        yield stream
    except BaseException:
        stream.close()
        files.delete_file(attempt)
        raise
    stream.close()
    files.move(attempt, path)


def hash_sample(rows: DataFrame, key, count: int) -> DataFrame:
    """At most ``count`` rows of ``rows``, those with the smallest ``key``, one a key; adds ``key``.

    Keys alone are ordered first, so what reaches the driver doesn't grow with the rows' width
    or number.
    """
    cutoff = rows.select(key.alias("key")).orderBy("key").limit(count).agg(F.max("key")).first()[0]
    if cutoff is None:
        return rows.limit(0).withColumn("key", F.lit(0).cast("bigint"))
    chosen = rows.withColumn("key", key).where(F.col("key") <= cutoff)
    return chosen.groupBy("key").agg(F.min(F.struct(*rows.columns)).alias("row")).select("row.*", "key")


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending cut points of a long column, by approximate quantiles.

    Only ``key`` is read; what comes back is one number for each shard.
    """
    cuts = df.stat.approxQuantile(key, [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    return sorted({int(c) for c in cuts})


def shard_of(key, bounds: list[int]):
    """Column: how many of ``bounds`` are at most ``key`` (null: 0). Ascending in ``key``."""
    if not bounds:
        return F.lit(0)
    if len(bounds) < 64:
        cuts = F.array(*[F.lit(b) for b in bounds])
        return F.coalesce(F.size(F.filter(cuts, lambda b: b <= key)), F.lit(0))
    return F.coalesce(_binary(F.from_json(F.lit(str(bounds)), "array<bigint>"), key, len(bounds)), F.lit(0))


def _binary(cuts, key, n: int):
    """Binary search in a sorted array column: the count of entries at most ``key``."""
    steps = F.array(*[F.lit(1 << b) for b in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= n) & (F.get(cuts, low + step - 1) <= key), low + step).otherwise(low))


def ordered_shards(df: DataFrame, key: str, parts: int, then: list[str]) -> DataFrame:
    """``df`` in shards of ascending ``key``: adds ``shard``, sorts each by ``key`` (null first) and ``then``.

    The shard of a row depends on its key alone, so a task that runs again makes the same shard.
    """
    bounds = range_bounds(df, key, parts)
    with_shard = df.withColumn("shard", shard_of(F.col(key), bounds))
    return with_shard.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(
        F.col("shard"), F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in then]
    )
