"""Language identification with string kernels.

The kernel of two pieces of text is the number of n-grams of 1 to ``LONGEST`` bytes that occur in
both, over the geometric mean of the numbers that occur in either (blended spectrum, presence
only). N-grams are compared as they are, not by a hash. Landmark pieces give a Nyström map, on
which kernel ridge regression is solved once per language against the rest.

Presence says less the longer a text is: in some MB nearly every n-gram occurs. So a text is read
as consecutive pieces of equal size, at most ``PIECE`` bytes, that cover all of it, and its values
are the mean of theirs; in learning as in prediction. Pieces overlap by ``LONGEST - 1`` bytes, so
no n-gram is lost between them.

Scoring is one product per batch of pieces: the sparse matrix of presences (pieces by n-grams of
the landmarks) times the dense matrix of what each n-gram adds to each language's value, which is the
landmarks' presences times the Nyström map times the regression. Languages are taken in blocks of
columns, so that the dense matrix has a bounded size, in each worker and in the broadcast.

Learning takes a bounded sample of labelled texts on the driver: about ``TRAIN_PER_LANG`` of each
language, fewer if all together would be more than ``TRAIN_ALL``, but at least one; of a text longer
than ``TRAIN_PARTS`` parts of ``TRAIN_PART`` characters, so many parts spread over it, cut in the tasks.
Every language with a usable text is learned. ``LANDMARKS`` of the texts' pieces, over all languages,
serve as landmarks, or one of each language if there are more. Prediction reads every byte of every
text, in the tasks, and nothing but the text.

Defined cases: a text that is null or has no letters is ``und`` with score 0. Labels that are
null do not count. Without any labelled text all are ``und``. Ties go to the language first in
order. Repeated rows have the same result. Long texts are read whole. Other columns are kept; lang_pred
and score are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.llm.common import append_columns, small, text_batches

LONGEST, PIECE = 4, 4096
SYMBOL = 9  # bits of a byte in an n-gram: 1 to 256, 0 behind the end
MOST_CELLS = 1 << 21  # of the dense matrix of n-grams by a block of languages
MOST_BROADCAST = 100_000
TRAIN_PER_LANG, TRAIN_ALL, LANDMARKS = 400, 20_000, 96
TRAIN_PARTS, TRAIN_PART = 4, 2048
RIDGE = 1e-3
SHARPNESS = 6.0
LETTER = regex.compile(r"\p{L}")


def pieces(text: str) -> list[np.ndarray]:
    """The bytes of a text in lower case, in consecutive pieces of equal size."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    bounds = np.linspace(0, len(data), max(1, -(-len(data) // PIECE)) + 1).astype(int)
    return [data[lo : hi + LONGEST - 1] for lo, hi in zip(bounds, bounds[1:])]


def _distinct(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered


def grams(piece: np.ndarray) -> np.ndarray:
    """The distinct n-grams of a piece as numbers, in order. A longer one is a larger number."""
    symbols = np.zeros(len(piece) + LONGEST - 1, np.int64)
    symbols[: len(piece)] = piece.astype(np.int64) + 1
    value = symbols[: len(piece)].copy()
    for n in range(1, LONGEST):
        value = value << SYMBOL | symbols[n : n + len(piece)]
    value, found = _distinct(np.sort(value)), []
    for _ in range(LONGEST):
        found.append(value[value & (1 << SYMBOL) - 1 != 0])
        value = _distinct(value >> SYMBOL)
    return np.concatenate(found[::-1])


def presence_product(places: list[np.ndarray], dense: np.ndarray, at_once: int = 1 << 17) -> np.ndarray:
    """The matrix of ones at ``places`` (row by row) times ``dense``."""
    made = np.zeros((len(places), dense.shape[1]))
    sizes = np.array([len(p) for p in places])
    ends = np.cumsum(sizes)
    start = 0
    while start < len(places):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + at_once, side="right")))
        rows = start + np.flatnonzero(sizes[start:stop])
        if len(rows):
            taken = dense[np.concatenate([places[i] for i in rows])]
            made[rows] = np.add.reduceat(taken, np.cumsum(sizes[rows]) - sizes[rows], axis=0)
        start = stop
    return made


@dataclass
class Landmarks:
    grams: np.ndarray  # those of all landmarks, in order
    starts: np.ndarray  # of each n-gram's landmarks in owners, and the end
    owners: np.ndarray
    sizes: np.ndarray  # n-grams of each landmark

    @classmethod
    def of(cls, chosen: list[np.ndarray]) -> Landmarks:
        sizes = np.array([len(g) for g in chosen])
        every, at = np.unique(np.concatenate(chosen), return_inverse=True)
        owners = np.repeat(np.arange(len(chosen), dtype=np.int32), sizes)[np.argsort(at, kind="stable")]
        starts = np.append(0, np.cumsum(np.bincount(at, minlength=len(every))))
        return cls(every, starts, owners, sizes)

    def places(self, found: np.ndarray) -> np.ndarray:
        """Where the n-grams of a piece are among the landmarks'."""
        at = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
        return at[self.grams[at] == found]

    def kernel(self, found: np.ndarray) -> np.ndarray:
        at = self.places(found)
        first, many = self.starts[at], self.starts[at + 1] - self.starts[at]
        each = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        common = np.bincount(self.owners[each], minlength=len(self.sizes))
        return common / np.sqrt(self.sizes * max(1, len(found)))

    def dense(self, weights: np.ndarray) -> np.ndarray:
        """What each n-gram adds to the values: presences of the landmarks' n-grams, each landmark's
        over the root of its size, times ``weights``."""
        each = np.repeat(np.arange(len(self.grams)), np.diff(self.starts))
        made = np.zeros((len(self.grams), weights.shape[1]))
        scaled = weights / np.sqrt(self.sizes)[:, None]
        for column in range(weights.shape[1]):
            made[:, column] = np.bincount(each, scaled[self.owners, column], minlength=len(self.grams))
        return made


@dataclass
class Classifier:
    languages: list[str]
    landmarks: Landmarks | None
    weights: np.ndarray  # landmarks x languages: the Nyström map times the regression
    first: np.ndarray | None = None  # the dense matrix of the first block of languages

    def blocks(self):
        """Column ranges of the dense matrix, and the matrix of each."""
        width = max(1, MOST_CELLS // max(1, len(self.landmarks.grams)))
        for lo in range(0, len(self.languages), width):
            hi = min(lo + width, len(self.languages))
            yield lo, hi, self.first if not lo and self.first is not None else self.landmarks.dense(self.weights[:, lo:hi])

    def values(self, texts: list[str]) -> np.ndarray:
        """Mean values of the pieces of each text."""
        found = [[grams(p) for p in pieces(t)] for t in texts]
        places = [self.landmarks.places(g) for parts in found for g in parts]
        sizes = np.array([len(g) for parts in found for g in parts])
        many = np.array([len(parts) for parts in found])
        made = np.zeros((len(texts), len(self.languages)))
        for lo, hi, dense in self.blocks():
            product = presence_product(places, dense) / np.sqrt(np.maximum(1, sizes))[:, None]
            made[:, lo:hi] = np.add.reduceat(product, np.cumsum(many) - many, axis=0) / many[:, None]
        return made

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        named, scores = ["und"] * len(texts), np.zeros(len(texts))
        real = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if not real or not self.languages:
            return named, scores
        value = SHARPNESS * self.values([texts[i] for i in real])
        share = np.exp(value - value.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        for i, b, s in zip(real, best, share.max(axis=1)):
            named[i], scores[i] = self.languages[b], s
        return named, scores


def train(texts: list[str], labels: list[str]) -> Classifier:
    languages = sorted(set(labels))
    if not languages:
        return Classifier([], None, np.zeros((0, 0)))
    cut = [pieces(t) for t in texts]
    # Landmarks: the first pieces of each language's texts in turn, then the second ones.
    turn: dict[str, int] = {}
    order = []
    for n, i in sorted((n, i) for i, parts in enumerate(cut) for n in range(len(parts))):
        turn[labels[i]] = turn.get(labels[i], -1) + 1
        order.append((turn[labels[i]], labels[i], i, n))
    chosen = [grams(cut[i][n]) for _, _, i, n in sorted(order)[: max(LANDMARKS, len(languages))]]
    landmarks = Landmarks.of(chosen)
    roots, vectors = np.linalg.eigh(np.array([landmarks.kernel(g) for g in chosen]))
    good = roots > 1e-6 * roots.max()
    mapping = vectors[:, good] / np.sqrt(roots[good])
    # Rows weigh so that each language counts alike. Blocks of texts bound the memory.
    number = {x: n for n, x in enumerate(languages)}
    of = np.array([number[x] for x in labels])
    rows = np.bincount(of)
    left = RIDGE * np.eye(mapping.shape[1]) / len(languages)
    right = np.zeros((len(languages), mapping.shape[1]))
    for at in range(0, len(cut), 1000):
        part, block = of[at : at + 1000], cut[at : at + 1000]
        means = [np.mean([landmarks.kernel(grams(p)) for p in parts], axis=0) for parts in block]
        features = np.array(means) @ mapping
        weighted = features / rows[part][:, None]
        left += weighted.T @ features
        np.add.at(right, part, 2 * weighted)
        right -= weighted.sum(axis=0)
    weights = mapping @ np.linalg.solve(left, right.T)
    classifier = Classifier(languages, landmarks, weights)
    classifier.first = next(classifier.blocks())[2]
    return classifier


def fit(docs: DataFrame, usable: Column) -> Classifier:
    """Learn from about ``TRAIN_PER_LANG`` documents of each language, or as many fewer as
    ``TRAIN_ALL`` asks for, chosen by a hash of their ids; the one of the smallest hash always.
    Only this sample and the languages reach the driver."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & usable)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("lang")), F.lit(1 << 30)) / float(1 << 30)
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(draw).alias("least")).collect()
    each = max(1, min(TRAIN_PER_LANG, TRAIN_ALL // max(1, len(counts))))
    bounds = [(r["lang"], max(each / r["n"], r["least"])) for r in counts]
    shares = small(docs.sparkSession.createDataFrame(bounds, "lang string, most double"), MOST_BROADCAST)
    parts = F.ceil(F.length("text") / TRAIN_PART)
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(TRAIN_PARTS - 1)),
        lambda i: F.substring("text", (F.floor(i * (parts - 1) / (TRAIN_PARTS - 1)) * TRAIN_PART + 1).cast("int"), F.lit(TRAIN_PART)),
    )
    text = F.when(parts > TRAIN_PARTS, F.array_join(spread, "\n")).otherwise(F.col("text"))
    chosen = known.select("doc_id", "lang", text.alias("text")).join(shares, "lang").where(draw <= F.col("most"))
    rows = chosen.drop("most").limit(2 * each * max(1, len(counts))).collect()
    rows = sorted((r for r in rows if LETTER.search(r["text"])), key=lambda r: (str(r["doc_id"]), r["text"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def with_language(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """Add lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def start():
        def work(batch: pa.RecordBatch):
            texts, named, scores = batch.column("text"), [], []
            for lo, hi in text_batches(texts, 1 << 19):
                for at in range(lo, hi, 256):
                    part = texts.slice(at, min(256, hi - at)).to_pylist()
                    languages, values = shared.value.predict(part)
                    named += languages
                    scores.append(values)
            score = pa.array(np.concatenate(scores), pa.float64())
            return {"lang_pred": pa.array(named, pa.string()), "score": score}

        return work

    return append_columns(docs, start, fields)
