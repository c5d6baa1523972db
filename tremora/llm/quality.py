"""Quality classifier: a convolutional network over bytes, in NumPy.

A text is cut into overlapping chunks that cover all its bytes. Filters of ``WIDTH`` bytes slide
over each chunk; a filter's weights are one number per place and byte value, so a response is a
sum of table look-ups. Each filter is max-pooled within its chunk; the mean and the largest of
the chunks' values are combined by a logistic unit into the probability of label 1.

Training takes a bounded sample of labelled rows on the driver (about ``TRAIN_DOCS`` texts, of each at
most ``TRAIN_CHUNKS`` chunks of 256 bytes spread over it, cut in the tasks: texts do not reach the
driver); scoring takes every byte of every text, in the tasks. Only bytes of the text are inputs.

Defined cases: a null text counts as empty; an empty text is one chunk of padding and has a
score like any other. Labels that are null do not count, and repeated labels of a document count
each. With labels of one kind only, or none, the score is the smoothed share of label 1. Repeated
rows have the same score. Long texts are scored whole, a part at a time. Other columns are kept; a
column score is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.llm.common import append_columns

CHUNK, OVERLAP, WIDTH, FILTERS = 256, 32, 5, 12
TRAIN_DOCS, TRAIN_CHUNKS, STEPS, BATCH = 3000, 12, 750, 32
THRESHOLD = 0.3
SEED = 7


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def chunks_of(blob: np.ndarray, most: int | None = None) -> np.ndarray:
    """Rows of ``CHUNK`` bytes that cover ``blob``; the last one ends with its end.

    ``most`` takes evenly spread ones only (for training).
    """
    if len(blob) < CHUNK:
        return np.concatenate([blob, np.zeros(CHUNK - len(blob), np.uint8)])[None]
    starts = np.arange(0, len(blob) - CHUNK, CHUNK - OVERLAP)
    starts = np.append(starts, len(blob) - CHUNK)
    if most and len(starts) > most:
        starts = starts[np.linspace(0, len(starts) - 1, most).astype(int)]
    return np.lib.stride_tricks.sliding_window_view(blob, CHUNK)[starts]


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 * FILTERS: of the chunks' means, then of their maxima
    offset: float

    @classmethod
    def start(cls) -> Network:
        random = np.random.default_rng(SEED)
        filters = random.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        weights = random.normal(0, 0.3, 2 * FILTERS).astype(np.float32)
        return cls(filters, np.zeros(FILTERS, np.float32), weights, 0.0)

    def pooled(self, chunks: np.ndarray, places: bool = False):
        """Each filter's largest response in each chunk, and where it is if asked for."""
        found, where = [], []
        n = CHUNK - WIDTH + 1
        for at in range(0, len(chunks), 128):
            part = chunks[at : at + 128]
            response = self.filters[0][part[:, :n]]
            for j in range(1, WIDTH):
                response += self.filters[j][part[:, j : j + n]]
            if places:
                best = response.argmax(axis=1)
                where.append(best)
                found.append(np.take_along_axis(response, best[:, None], axis=1)[:, 0])
            else:
                found.append(response.max(axis=1))
        values = np.maximum(np.concatenate(found) + self.bias, 0)
        return (values, np.concatenate(where)) if places else values

    def combine(self, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of each document, whose chunks begin at ``starts``, and its probability."""
        counts = np.diff(np.append(starts, len(values)))[:, None]
        mean = np.add.reduceat(values, starts, axis=0) / counts
        features = np.concatenate([mean, np.maximum.reduceat(values, starts, axis=0)], axis=1)
        z = features.astype(np.float64) @ self.weights + self.offset
        return features, 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def scores(self, texts: list[bytes], at_once: int = 4096) -> np.ndarray:
        """Probabilities of whole texts. A long text's chunks are pooled a part at a time."""
        made, waiting, size = [], [], 0

        def flush():
            nonlocal waiting, size
            if waiting:
                starts = np.cumsum([0, *[len(c) for c in waiting[:-1]]])
                made.append(self.combine(self.pooled(np.concatenate(waiting)), starts)[1])
                waiting, size = [], 0

        for text in texts:
            chunks = chunks_of(np.frombuffer(text, np.uint8))
            if len(chunks) > at_once:
                flush()
                values = [self.pooled(chunks[i : i + at_once]) for i in range(0, len(chunks), at_once)]
                made.append(self.combine(np.concatenate(values), np.array([0]))[1])
                continue
            waiting.append(chunks)
            size += len(chunks)
            if size >= at_once:
                flush()
        flush()
        return np.concatenate(made) if made else np.zeros(0)


class Adam:
    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.step = arrays, rate, 0
        self.first = [np.zeros_like(a) for a in arrays]
        self.second = [np.zeros_like(a) for a in arrays]

    def apply(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        for a, g, m, v in zip(self.arrays, gradients, self.first, self.second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            rate = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
            a -= rate * m / (np.sqrt(v) + 1e-8)


def train(texts: list[bytes], labels: list[int], steps: int = STEPS) -> Network:
    return train_on([chunks_of(np.frombuffer(t, np.uint8), TRAIN_CHUNKS) for t in texts], labels, steps)


def train_on(chunks: list[np.ndarray], labels: list[int], steps: int = STEPS) -> Network:
    """Fit by Adam on the logistic loss; the gradient of a maximum goes to where it was met.

    ``chunks`` are those of each text. A small sample is passed through more often, up to the
    same number of steps.
    """
    network = Network.start()
    share = (sum(labels) + 1) / (len(labels) + 2)
    network.offset = float(np.log(share / (1 - share)))
    if len(set(labels)) < 2:
        network.weights[:] = 0
        return network
    y = np.array(labels, np.float64)
    offset = np.array([network.offset])
    adam = Adam([network.filters, network.bias, network.weights, offset], 0.01)
    random = np.random.default_rng(SEED)
    batches = max(1, len(y) // BATCH)
    for _ in range(-(-steps // batches)):
        order = random.permutation(len(y))
        for batch in np.array_split(order, batches):
            part = [chunks[i] for i in batch]
            counts = np.array([len(c) for c in part])
            starts = np.cumsum(counts) - counts
            data = np.concatenate(part)
            values, places = network.pooled(data, places=True)
            features, p = network.combine(values, starts)
            error = (p - y[batch]) / len(batch)
            by_doc = error[:, None] * network.weights
            owner = np.repeat(np.arange(len(batch)), counts)
            gradient = by_doc[owner, :FILTERS] / counts[owner, None]
            top = values == features[owner, FILTERS:]
            gradient = (gradient + by_doc[owner, FILTERS:] * top) * (values > 0)
            on_filters = np.zeros_like(network.filters)
            rows, which = np.arange(len(data))[:, None], np.arange(FILTERS)
            for j in range(WIDTH):
                np.add.at(on_filters[j], (data[rows, places + j], which), gradient)
            adam.apply([
                on_filters + 1e-5 * network.filters,
                gradient.sum(axis=0).astype(np.float32),
                (features * error[:, None]).sum(axis=0).astype(np.float32),
                np.array([error.sum()]),
            ])
            network.offset = float(offset[0])
    return network


def training_sample(docs: DataFrame, labels: DataFrame, usable: Column, most: int = TRAIN_DOCS):
    """Chunks and labels of about ``most`` labelled documents, chosen by a hash of their ids.

    Half of them of either label as far as there are enough. Only this sample reaches the driver.
    """
    known = labels.where(F.col("quality").isin(0, 1) & usable).select("doc_id", F.col("quality").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, min(1.0, most / 2 / n)).otherwise(share)
    chosen = F.broadcast(known.where(draw < share).limit(2 * most))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").limit(2 * most)

    def start():
        def work(batch: pa.RecordBatch):
            texts = batch.column("text").cast(pa.large_binary())
            cut = [chunks_of(np.frombuffer(t.as_py() or b"", np.uint8), TRAIN_CHUNKS) for t in texts]
            return {"chunks": pa.array([c.tobytes() for c in cut], pa.binary())}

        return work

    cut = append_columns(rows, start, [T.StructField("chunks", T.BinaryType())], drop=["text"])
    found = sorted((tuple(r) for r in cut.select("doc_id", "label", "chunks").collect()))
    weights = {label: max(1.0, n / (most / 2)) for label, n in counts.items()}
    return [np.frombuffer(c, np.uint8).reshape(-1, CHUNK) for _, _, c in found], [r[1] for r in found], weights


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Network:
    """Train on the sample, then move the offset back to the labels' true shares."""
    chunks, known, weights = training_sample(docs, labels, usable)
    network = train_on(chunks, known)
    if len(weights) == 2:
        network.offset += float(np.log(weights[1] / weights[0]))
    return network


def with_score(docs: DataFrame, network: Network) -> DataFrame:
    """Add score, the probability that a document has label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def start():
        def work(batch: pa.RecordBatch):
            texts = batch.column("text").cast(pa.large_binary())
            return {"score": pa.array(shared.value.scores([t.as_py() or b"" for t in texts]), pa.float64())}

        return work

    return append_columns(docs, start, [T.StructField("score", T.DoubleType())])
