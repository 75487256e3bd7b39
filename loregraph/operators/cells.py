"""Nearest vectors by cells: k-means over directions, vectors stored by cell, the nearest cells read.

Centroids come of spherical k-means on at most ``SAMPLE`` vectors, those of the smallest hashes;
every vector is put in the cell of its nearest centroid.  Beside the vectors stand codes: what a
vector differs by from its centroid, in steps of a seventh of its largest difference, so each
number is one of 15 and takes four bits.  A search reads the codes of the cells whose centroids
are nearest to the query (partitions of the table), and scores exactly the vectors of the
``RESCORED`` x limit best by code.

``search_exact`` gives what a scan of all vectors gives: a cell's vectors are within its radius,
the largest angle to its centroid, so none scores above the cosine of the query's angle to the
centroid less the radius.  Cells whose bound is under the ``limit``-th score so far are left out.

Vectors of a zero norm, null or of another size than most sampled ones have no direction: they
stand in cell -1, which no search reads, as they score nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from loregraph.functions.columns import cosine

#: Vectors that centroids are learned from; centroids at most; rounds of k-means.
SAMPLE = 20_000
MOST_CELLS = 4096
ROUNDS = 12
#: Vectors that a file of a cell is made for.
FILE = 500_000
#: Vectors that are scored exactly for each one wanted, and how many of them are looked up by value.
RESCORED = 4
PROBE = 1000
#: Steps of a code on either side of none.
STEPS = 7


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1)


def centroids_of(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids; the first ones are rows far from each other, so reruns agree."""
    data = unit_rows(sample)
    chosen = [0]
    near = data @ data[0]
    while len(chosen) < min(cells, len(data)):
        at = int(np.argmin(near))
        if near[at] > 1 - 1e-12:  # no other direction is left
            break
        chosen.append(at)
        near = np.maximum(near, data @ data[at])
    centers = data[chosen]
    for _ in range(ROUNDS):
        own = np.argmax(data @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, data)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 1e-12, sums / np.where(norms > 1e-12, norms, 1), centers)
    return centers


@dataclass
class CellIndex:
    """``rows`` (vectors with their ``cell``), ``codes(id, cell, code, step)``, and centroid, radius and count of each cell."""

    rows: DataFrame
    codes: DataFrame
    ids: np.ndarray
    centers: np.ndarray
    radii: np.ndarray
    counts: np.ndarray

    def _angles(self, query: list[float]) -> np.ndarray:
        unit = np.array(query, float) / np.linalg.norm(query)
        return np.arccos(np.clip(self.centers @ unit, -1, 1))

    def _nothing(self, query: list[float]) -> bool:
        return not len(self.ids) or len(query) != self.centers.shape[1] or not any(query)

    def nearest_cells(self, query: list[float], probes: int) -> list[int]:
        return self.ids[np.argsort(self._angles(query), kind="stable")[:probes]].tolist()

    def coded(self, cells: list[int]) -> int:
        """How many codes a search of these cells reads."""
        return int(self.counts[np.isin(self.ids, cells)].sum())

    def search(self, query: list[float], limit: int, probes: int = 8, min_score: float = 0.0) -> DataFrame:
        """About the ``limit`` nearest vectors of the ``probes`` nearest cells with their ``score``; ties by id."""
        if self._nothing(query):
            return best_of(self.rows.limit(0), query, limit, min_score)
        short = self.shortlist(query, limit * RESCORED, probes)
        if limit * RESCORED > PROBE:
            return best_of(self.rows.join(short, ["cell", "id"], "left_semi"), query, limit, min_score)
        few = short.collect()
        chosen = F.col("cell").isin(sorted({r["cell"] for r in few})) & F.col("id").isin([r["id"] for r in few])
        return best_of(self.rows.where(chosen), query, limit, min_score)

    def shortlist(self, query: list[float], count: int, probes: int) -> DataFrame:
        """(cell, id) of the ``count`` best by code among the nearest cells."""
        cells = self.nearest_cells(query, probes)
        unit = np.array(query, float) / np.linalg.norm(query)
        toward = np.zeros(int(self.ids.max()) + 1)
        toward[self.ids] = self.centers @ unit
        base = F.from_json(F.lit(json.dumps(toward.tolist())), "array<double>")
        dot = F.aggregate(F.zip_with("code", F.array(*[F.lit(float(x)) for x in unit]), lambda c, q: c * q), F.lit(0.0), lambda total, x: total + x)
        guess = F.get(base, F.col("cell")) + F.col("step") * dot
        near = self.codes.where(F.col("cell").isin(cells)).select("cell", "id", guess.alias("guess"))
        return near.orderBy(F.col("guess").desc(), "id").limit(count).select("cell", "id")

    def search_exact(self, query: list[float], limit: int, probes: int = 8, min_score: float = 0.0) -> DataFrame:
        """The ``limit`` nearest of all vectors: a search of ``probes`` cells, and of those that may still have a nearer one."""
        if self._nothing(query):
            return best_of(self.rows.limit(0), query, limit, min_score)
        first = self.nearest_cells(query, probes)
        scores = [r["score"] for r in best_of(self.rows.where(F.col("cell").isin(first)), query, limit, min_score).select("score").collect()]
        least = scores[-1] if len(scores) >= limit else min_score
        return best_of(self.rows.where(F.col("cell").isin(sorted({*first, *self.cells_over(query, least)}))), query, limit, min_score)

    def cells_over(self, query: list[float], least: float) -> list[int]:
        """Cells that can have a vector of at least this score."""
        bound = np.cos(np.maximum(0, self._angles(query) - self.radii))
        return self.ids[bound >= least - 1e-9].tolist()


def best_of(rows: DataFrame, query: list[float], limit: int, min_score: float) -> DataFrame:
    vector = F.array(*[F.lit(float(x)) for x in query]).cast("array<double>")
    scored = rows.drop("cell").withColumn("score", cosine(F.col("vector").cast("array<double>"), vector))
    return scored.where(F.col("score") >= min_score).orderBy(F.col("score").desc(), "id").limit(limit)


def with_cells(embeddings: DataFrame, centers: np.ndarray) -> DataFrame:
    """``embeddings`` with ``cell``, ``angle`` to its centroid, ``code`` and ``step``; the last two null in cell -1."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in embeddings.schema)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            cells, angles = np.full(len(vectors), -1), np.zeros(len(vectors))
            codes: list[list[int] | None] = [None] * len(vectors)
            steps: list[float | None] = [None] * len(vectors)
            fit = [i for i, v in enumerate(vectors) if v is not None and len(v) == centers.shape[1] and None not in v]
            if fit:
                data = np.array([vectors[i] for i in fit], float)
                real = np.isfinite(data).all(axis=1) & (np.linalg.norm(np.nan_to_num(data), axis=1) > 0)
                units = unit_rows(data[real])
                near = units @ centers.T
                at = np.array(fit)[real]
                cells[at] = near.argmax(axis=1)
                rest = units - centers[cells[at]]
                step = np.abs(rest).max(axis=1, keepdims=True, initial=0) / STEPS
                coded = np.round(rest / np.where(step > 0, step, 1)).astype(np.int8).tolist()
                for i, code, size in zip(at.tolist(), coded, step[:, 0].tolist(), strict=True):
                    codes[i], steps[i] = code, size
                angles[at] = np.arccos(np.clip(near.max(axis=1), -1, 1))
            made = [pa.array(cells, pa.int32()), pa.array(angles), pa.array(codes, pa.list_(pa.int8())), pa.array(steps, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "cell", "angle", "code", "step"])

    return embeddings.mapInArrow(assign, f"{fields}, cell int, angle double, code array<tinyint>, step double")


def write_cells(embeddings: DataFrame, root: str, cells: int | None = None) -> None:
    """Write ``embeddings(id, vector, ...)`` by cells to the new folder ``root``; some square root of their number, if none is given."""
    spark = embeddings.sparkSession
    plain = embeddings.withColumn("vector", F.col("vector").cast("array<double>"))
    count = embeddings.count()
    drawn = plain.where("size(vector) > 0").select(F.xxhash64("id").alias("h"), "vector").orderBy("h").limit(SAMPLE).collect()
    sizes = [len(r["vector"]) for r in drawn]
    size = max(set(sizes), key=sizes.count) if sizes else 0
    fit = [r["vector"] for r in drawn if len(r["vector"]) == size and None not in r["vector"]]
    sample = np.array(fit, float).reshape(len(fit), size)
    sample = sample[np.isfinite(sample).all(axis=1) & (np.abs(sample).sum(axis=1) > 0)]
    centers = centroids_of(sample, cells or max(1, min(MOST_CELLS, round(math.sqrt(count))))) if len(sample) else np.zeros((0, size))
    placed = with_cells(plain, centers) if len(centers) else plain.withColumns({"cell": F.lit(-1), "angle": F.lit(0.0), "code": F.array().cast("array<tinyint>"), "step": F.lit(0.0)})
    placed.write.parquet(f"{root}/placed")
    placed = spark.read.parquet(f"{root}/placed")
    stats = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("vectors"))
    # a large cell has several files
    parts = stats.select("cell", F.ceil(F.col("vectors") / FILE).cast("int").alias("parts"))
    dealt = placed.drop("angle").join(F.broadcast(parts), "cell").withColumn("_part", F.pmod(F.xxhash64("id"), F.col("parts")))  # MOST_CELLS rows at most
    for name, rows in (("vectors", dealt.drop("code", "step")), ("codes", dealt.select("id", "code", "step", "cell", "_part", "parts"))):
        rows.repartition("cell", "_part").drop("parts", "_part").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{root}/{name}")
    found = [(int(r["cell"]), centers[r["cell"]].tolist() if r["cell"] >= 0 else [], float(r["radius"]), int(r["vectors"])) for r in stats.collect()]
    spark.createDataFrame(found, "cell int, center array<double>, radius double, vectors bigint").coalesce(1).write.parquet(f"{root}/cells")


def open_cells(spark: SparkSession, root: str) -> CellIndex:
    """The stored index: a centroid for each cell comes to the driver."""
    cells = [r for r in spark.read.parquet(f"{root}/cells").orderBy("cell").collect() if r["cell"] >= 0]
    centers = np.array([r["center"] for r in cells], float).reshape(len(cells), len(cells[0]["center"]) if cells else 0)
    schema = spark.read.parquet(f"{root}/placed").drop("cell", "angle", "code", "step").schema.add("cell", IntegerType())
    rows = spark.read.schema(schema).parquet(f"{root}/vectors")
    codes = spark.read.schema(spark.read.parquet(f"{root}/placed").select("id", "code", "step", "cell").schema).parquet(f"{root}/codes")
    ids, radii, counts = (np.array([r[c] for r in cells]) for c in ("cell", "radius", "vectors"))
    return CellIndex(rows, codes, ids, centers, radii, counts)
