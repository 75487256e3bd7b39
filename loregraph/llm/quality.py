"""Quality classifier (operator 9): compression with dictionaries of good and of bad text.

One half of a sample of labelled rows gives two zstandard dictionaries, one trained on good
and one on bad text.  A text is cut into pieces of ``PIECE`` bytes, each compressed with
either dictionary.  The difference of the two sizes by the piece's length says which
dictionary knows it better.  The other half of the sample calibrates: a logistic
regression turns the mean and the extreme differences over all pieces, and the compressed
sizes themselves, into a probability.

The sample is at most ``sample`` rows of each label (a documented bound), chosen by a hash
of the id.  Labels, language, source and id are never inputs of a score.

Defined results: null is the empty text, scored by its (zero) sizes; rows with a null label
teach nothing; with fewer than ``LEAST`` rows of either label every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import quoted, returning_memory, schema_of, unused_name, without
from loregraph.llm.language_id import held_out
from loregraph.llm.shingles import texts_of

PIECE = 768
LEVEL = 3
DICTIONARY = 48 << 10
LEAST = 8
#: A text scored this high counts as good.
GOOD = 0.7


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def compressors(self):
        import zstandard

        made = []
        for data in (self.good, self.bad):
            dictionary = zstandard.ZstdCompressionDict(data)
            dictionary.precompute_compress(LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False))
        return made

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[1:] + self.weights[0], -30, 30)))


def features(text, good, bad) -> list[float]:
    """Of a text's bytes: differences of compressed size (mean, highest, lowest) and sizes (mean, lowest)."""
    size = len(text)
    if not size:
        return [0.0] * 6
    total_good = total_bad = 0
    high, low, least = -9.0, 9.0, 9.0
    for at in range(0, size, PIECE):
        piece = text[at : at + PIECE]
        g, b = len(good.compress(piece)), len(bad.compress(piece))
        total_good += g
        total_bad += b
        if len(piece) * 4 >= min(size, PIECE):
            d = (g - b) / len(piece)
            high = d if d > high else high
            low = d if d < low else low
            least = min(least, (g + b) / len(piece))
    return [(total_good - total_bad) / size, high, low, (total_good + total_bad) / size, least, 1 / (1 + size / 256)]


def train(texts: list[bytes], labels: list[int]) -> CompressionModel | None:
    """Dictionaries from every other text of each label, calibration by the rest."""
    import zstandard

    by = {q: [t for t, x in zip(texts, labels, strict=True) if x == q and t] for q in (0, 1)}
    if min(map(len, by.values())) < LEAST:
        return None
    made = []
    for q in (1, 0):
        pieces = [t[at : at + PIECE] for t in by[q][::2] for at in range(0, len(t), PIECE)]
        try:
            made.append(zstandard.train_dictionary(DICTIONARY, pieces, level=LEVEL).as_bytes())
        except zstandard.ZstdError:  # too little text to train on
            made.append(b"".join(pieces)[-DICTIONARY:])
    model = CompressionModel(made[0], made[1], np.zeros(6), np.ones(6), np.zeros(7))
    compressors = model.compressors()
    rest = [(t, q) for q in (0, 1) for t in by[q][1::2]]
    x = np.array([features(t, *compressors) for t, _ in rest])
    y = np.array([q for _, q in rest], float)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = logistic((x - model.mean) / model.scale, y)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Newton's method with a ridge; both labels weigh the same."""
    a = np.hstack([np.ones((len(x), 1)), x])
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + penalty @ w
        curve = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + penalty
        move = np.linalg.solve(curve, gradient)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


#: Characters of the stretch that is taken of a row of the sample.
STRETCH = 6144


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1200, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> CompressionModel | None:
    """Train on at most ``sample`` rows of each label that aren't held out."""
    key = F.xxhash64(F.lit("quality"), F.col(id_col))
    size = F.length(text)
    place = F.when(size > STRETCH, F.pmod(F.xxhash64(key), size - STRETCH) + 1).otherwise(1).cast("int")
    marks = labels.where(F.col(label).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min(label).alias("label"))
    # the sample is chosen among ids, by their hash; only its texts are then looked up
    order = F.xxhash64(F.lit("quality"), F.col("id"))
    picked = [marks.where(F.col("label") == q).orderBy(order, "id").limit(sample) for q in (0, 1)]
    rows = docs.select(F.col(id_col).alias("id"), F.substring(F.col(text), place, F.lit(STRETCH)).alias("text"), key.alias("key"))
    chosen = rows.join(F.broadcast(picked[0].unionByName(picked[1])), "id")
    rows = chosen.groupBy("key", F.col("label").cast("int").alias("label")).agg(F.min("text").alias("text")).orderBy("key").limit(2 * sample).collect()
    return train([(r["text"] or "").encode() for r in rows], [r["label"] for r in rows])


def score(docs: DataFrame, model: CompressionModel | None, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep`` columns (all by default) with the score and the label as ``names``, which replace columns of these names."""
    keep = without(keep if keep is not None else docs.columns, *names)
    rows = docs.select(*quoted(keep), F.col(text).alias(unused_name("text", *keep)))
    schema = schema_of(docs, keep, {names[0]: "double", names[1]: "int"})

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors() if model else None
        for batch in batches:
            if model and batch.num_rows:
                data, offsets = texts_of(batch.column(len(keep)))
                view = memoryview(data)
                scores = model.scores(np.array([features(view[offsets[i] : offsets[i + 1]], *compressors) for i in range(batch.num_rows)]))
            else:
                scores = np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores), pa.array((scores >= GOOD).astype(np.int32))], [*keep, *names])

    return rows.mapInArrow(returning_memory(predict), schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Whole table: learned from labels that aren't held out, every whole text scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
