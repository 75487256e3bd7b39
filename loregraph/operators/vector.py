"""Vector operators: exact cosine search, chunk-to-node mapping, and a test encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loregraph.functions.columns import cosine
from loregraph.schema import KINDS


def cosine_search(embeddings: DataFrame, query: list[float], limit: int, min_score: float = 0.0) -> DataFrame:
    """The ``limit`` rows nearest to ``query`` with their ``score``; ties by id.

    Rows of a zero norm or another size score nothing.  The scan keeps ``limit`` rows a task.
    """
    if not any(query):
        return embeddings.limit(0).withColumn("score", F.lit(0.0))
    vector = F.array(*[F.lit(float(x)) for x in query])
    scored = embeddings.withColumn("score", cosine(F.col("vector").cast("array<double>"), vector))
    return scored.where(F.col("score") >= min_score).orderBy(F.col("score").desc(), "id").limit(limit)


def document_of(embedding_id):
    """The document part of an embedding id."""
    return F.when(F.contains(embedding_id, F.lit(":chunk-")), F.substring_index(embedding_id, ":chunk-", 1)).otherwise(F.substring_index(embedding_id, ":", 1))


def nodes_of_documents(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each ``document_id`` with its node: by the prefixes in order, or by the bare id."""
    rank = F.coalesce(*[F.when(F.substring_index("id", ":", 1) == p, F.lit(i)) for i, (_, p, *_) in enumerate(KINDS, 1)])
    suffix = F.expr("substring(id, instr(id, ':') + 1)")
    known = nodes.select("id", F.when(F.contains("id", F.lit(":")), suffix).alias("document_id"), rank.alias("rank")).where("rank IS NOT NULL")
    bare = nodes.select("id", F.col("id").alias("document_id"), F.lit(99).alias("rank"))
    found = documents.select("document_id").distinct().join(known.unionByName(bare), "document_id")
    return found.groupBy("document_id").agg(F.min_by("id", "rank").alias("node_id"))


def encode(chunks: DataFrame, encoder: Callable[[list[str]], list[list[float]]], column: str = "context_text") -> DataFrame:
    """``chunks`` with ``vector``, by a function of lists of texts, in Arrow batches."""
    import pyarrow as pa

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema if f.name != "vector"] + ["vector array<double>"])
    names = [c for c in chunks.columns if c != "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = encoder([t or "" for t in batch.column(column).to_pylist()]) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(vectors, pa.list_(pa.float64()))], [*names, "vector"])

    return chunks.select(*names).mapInArrow(run, schema)


def hashing_encoder(dimensions: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic encoder for tests and for indexes without a model: signed word hashes, normalised."""

    def encode_texts(texts: list[str]) -> list[list[float]]:
        import math
        import zlib

        out = []
        for text in texts:
            vector = [0.0] * dimensions
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                vector[h % dimensions] += 1.0 if h >> 31 else -1.0
            norm = math.sqrt(sum(v * v for v in vector)) or 1.0
            out.append([v / norm for v in vector])
        return out

    return encode_texts


def best_chunk_per_node(chunks: DataFrame) -> DataFrame:
    """The first chunk of each ``node_id`` by score, ties by id."""
    order = Window.partitionBy("node_id").orderBy(F.col("score").desc(), "id")
    return chunks.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
