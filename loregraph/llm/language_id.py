"""Language ID (operator 8): a byte convolutional network, trained and applied in numpy.

The network sees windows of ``WINDOW`` bytes.  Filters of several widths slide over the
bytes (each filter has a weight for every byte at every place of its width), their maxima
over the window pass a rectifier, and a dense layer with softmax gives the languages'
probabilities.  A text's probabilities are the mean over all its windows, so whole texts
count and memory depends on the window alone.  For speed two neighbouring bytes' weights
are summed in a table beforehand.

Training: a sample of at most ``sample`` rows of each language (a documented bound), chosen
by a hash of the id, with all windows of a stretch of each at a place that the hash chooses.  ``lang``,
``source`` and the id are never inputs.

Defined results: null text or text without a letter is ``und`` with score 1; rows with a
null label teach nothing; without any label all texts are ``und`` with score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loregraph.llm.common import quoted, returning_memory, schema_of, unused_name, without
from loregraph.llm.shingles import texts_of

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
UNKNOWN = "und"
#: Bytes A-Z count as a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def held_out(id_col: str):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@dataclass
class ByteCnn:
    languages: list[str]
    taps: list[np.ndarray]  # for each width: (width, 256, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def prepare(self) -> list[list[np.ndarray]]:
        """For each width the tables of byte pairs and of a last single byte."""
        made = []
        for tap in self.taps:
            parts = [(tap[k][:, None, :] + tap[k + 1][None, :, :]).reshape(65536, -1).astype(np.float32) for k in range(0, len(tap) - 1, 2)]
            if len(tap) % 2:
                parts.append(tap[-1].astype(np.float32))
            made.append(parts)
        return made

    def pooled(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Maxima of all filters over each row of ``windows`` (bytes)."""
        pairs = windows[:, :-1].astype(np.uint16) << 8 | windows[:, 1:]
        out = []
        for tap, parts in zip(self.taps, tables, strict=True):
            n = windows.shape[1] - len(tap) + 1
            total = None
            for k, table in enumerate(parts):
                index = pairs[:, 2 * k : 2 * k + n] if len(table) == 65536 else windows[:, 2 * k : 2 * k + n]
                got = table[index]
                total = got if total is None else np.add(total, got, out=total)
            out.append(total.max(axis=1))
        return np.maximum(np.concatenate(out, axis=1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray, tables) -> np.ndarray:
        return softmax(self.pooled(windows, tables) @ self.dense + self.offset)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(data: np.ndarray) -> np.ndarray:
    """Rows of ``WINDOW`` folded bytes that cover a text; the last one is filled up from the start."""
    count = max(1, -(-len(data) // WINDOW))
    return FOLD[np.resize(data, count * WINDOW)].reshape(count, WINDOW) if len(data) else np.zeros((1, WINDOW), np.uint8)


def train(texts: list[bytes], labels: list[str], epochs: int = 6, seed: int = 7, rate: float = 0.01) -> ByteCnn:
    """Fit the network by Adam on the windows of ``texts``."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    windows = [cut(np.frombuffer(t, np.uint8)) for t in texts]
    y = np.repeat([languages.index(x) for x in labels], [len(w) for w in windows])
    x = np.concatenate(windows)
    names = [*range(len(WIDTHS)), "bias", "dense", "offset"]
    pooled = FILTERS * len(WIDTHS)
    values = [rng.normal(0, 0.1, (w, 256, FILTERS)) for w in WIDTHS] + [np.zeros(pooled), rng.normal(0, 0.2, (pooled, len(languages))), np.zeros(len(languages))]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    share = np.bincount(y, minlength=len(languages)) / len(y)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            bytes_, target = x[rows], y[rows]
            tops, places = [], []
            for taps in values[: len(WIDTHS)]:
                n = WINDOW - len(taps) + 1
                total = sum(taps[k].astype(np.float32)[bytes_[:, k : k + n]] for k in range(len(taps)))
                places.append(total.argmax(axis=1))
                tops.append(np.take_along_axis(total, places[-1][:, None, :], 1)[:, 0])
            raw = np.concatenate(tops, axis=1) + values[-3]
            hidden = np.maximum(raw, 0)
            p = softmax(hidden @ values[-2] + values[-1])
            p[np.arange(len(rows)), target] -= 1
            p *= (1 / (len(languages) * share[target]))[:, None] / len(rows)  # rare languages count as much
            back = (p @ values[-2].T) * (raw > 0)
            grads = []
            for i, taps in enumerate(values[: len(WIDTHS)]):
                g = np.zeros_like(taps)
                own = back[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(len(taps)):
                    hit = np.take_along_axis(bytes_, places[i] + k, 1)
                    np.add.at(g[k], (hit.ravel(), np.tile(np.arange(FILTERS), len(rows))), own.ravel())
                grads.append(g)
            grads += [back.sum(0), hidden.T @ p, p.sum(0)]
            step += 1
            for v, g, m, s in zip(values, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    assert len(names) == len(values)
    return ByteCnn(languages, [v.astype(np.float32) for v in values[: len(WIDTHS)]], *(v.astype(np.float32) for v in values[-3:]))


#: Characters of the stretch that is taken of a row of the sample.
STRETCH = 2048


def fit(docs: DataFrame, sample: int = 3000, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> ByteCnn | None:
    """Train on at most ``sample`` rows of each language that aren't held out; None where there are none."""
    size = F.length(text)
    key = F.xxhash64(F.lit("language"), F.col(id_col))
    place = F.when(size > STRETCH, F.pmod(F.xxhash64(key), size - STRETCH) + 1).otherwise(1).cast("int")
    rows = docs.where(F.col(lang).isNotNull() & ~held_out(id_col) & F.col(text).rlike(r"\p{L}"))
    # ranked by the hash alone, first in slices, so that no task ranks a whole language
    keys = rows.select(F.col(lang).alias("lang"), key.alias("key")).distinct()
    for by in (("lang", F.pmod("key", F.lit(64))), ("lang",)):
        keys = keys.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("rank") <= sample).drop("rank")
    cutoffs = keys.groupBy("lang").agg(F.max("key").alias("most"))
    part = F.substring(F.col(text), place, F.lit(STRETCH))
    near = rows.select(F.col(lang).alias("lang"), key.alias("key"), part.alias("text")).join(F.broadcast(cutoffs), "lang").where("key <= most")
    chosen = near.groupBy("lang", "key").agg(F.min("text").alias("text")).where(F.col("text").rlike(r"\p{L}")).orderBy("key", "lang").collect()
    return train([r["text"].encode() for r in chosen], [r["lang"] for r in chosen]) if chosen else None


def identify(docs: DataFrame, model: ByteCnn | None, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns (all by default) with the language and its score as ``names``, which replace columns of these names."""
    keep = without(keep if keep is not None else docs.columns, *names)
    rows = docs.select(*quoted(keep), F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias(unused_name("text", *keep)))
    schema = schema_of(docs, keep, {names[0]: "string", names[1]: "double"})

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.prepare() if model else None
        for batch in batches:
            column = batch.column(len(keep))
            known = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool)
            languages = np.full(len(column), UNKNOWN, object)
            scores = np.where(known, 0.0, 1.0)
            if model and known.any():
                sums = window_sums(model, tables, *texts_of(column))
                best = sums.argmax(axis=1)
                languages[known] = np.array(model.languages, object)[best[known]]
                scores[known] = sums[np.arange(len(best)), best][known]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(languages, pa.string()), pa.array(np.clip(scores, 0, 1))], [*keep, *names])

    return rows.mapInArrow(returning_memory(predict), schema)


def window_sums(model: ByteCnn, tables, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities over all windows of each text; 128 windows are held at once."""
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    count = 0

    def flush() -> None:
        windows, own = np.concatenate(held), np.concatenate(owner)
        for at in range(0, len(windows), 128):
            np.add.at(out, own[at : at + 128], model.probabilities(windows[at : at + 128], tables))

    for i in range(len(offsets) - 1):
        windows = cut(data[offsets[i] : offsets[i + 1]])
        held.append(windows)
        owner.append(np.full(len(windows), i))
        count += len(windows)
        if count >= 1024:
            flush()
            held, owner, count = [], [], 0
    if held:
        flush()
    sizes = np.maximum(1, -(-np.diff(offsets) // WINDOW))
    return out / sizes[:, None]


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Whole table: trained on rows that aren't held out, applied to every whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs)
    found = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
