"""Periodic runs of words: recursive frequency splitting, then a lag scan.

A run is a stretch of words that repeats itself with a smallest period q, is at least
``max(min_words, 2 q)`` words long, and that no neighbouring word extends. Every word of it occurs
twice or more in it. So a word that is single within its segment (at first: the document) is in no
run, and splits the segment; what is left is counted anew, until nothing changes. Ordinary
prose falls apart in one or two rounds.

The surviving segments, all of a block of documents at once, are scanned by lag. Lags below 16
are compared word by word. A run of a lag from 2g to 4g holds a whole g-gram at a multiple of g,
and the same g-gram one lag later. Grams are named exactly by prefix doubling (g = 8, 16, ...), so
each aligned gram is paired with the equal ones between 2g and 4g words further, at most two pairs
a word for all lags of one g; each pair is extended both ways by the names of shorter grams. That
takes O(n log^2 n) steps for n surviving words, however they repeat.

Nothing is shuffled: a row's result depends on its text alone. A task works on blocks of about
BLOCK_WORDS words, or one longer text, at some 100 bytes a word that survives.

Defined cases: a null or empty text, or one of white space only, has no words, no runs and an empty
``collapsed``. Words are what stands between space, tab, line feed, vertical tab, form feed and
carriage return; they are compared byte by byte. Very long texts are processed whole. Repeated rows
each get the same result; there are no ties, because all runs are returned, by start, then period.
An empty table gives an empty table. Columns named ``runs``, ``collapsed`` or ``n_words`` are
replaced, all others pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.llm.common import append_columns

MIN_WORDS = 12
BLOCK_WORDS = 1 << 18
#: Lags up to here are compared directly; the shortest grams are half as long.
DIRECT = 15
#: Splitting only saves work. Texts made to lose one word a round are scanned after so many.
MOST_ROUNDS = 64

RUN = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
)

Edit = Callable[[object, list], list]


def split_segments(ids: np.ndarray, owner: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Stretches in which every word occurs twice or more, ``ids`` being words of documents ``owner``."""
    if not len(ids):
        return []
    names = int(ids.max()) + 1
    place, segment = np.arange(len(ids)), owner.astype(np.int64)
    done: list[np.ndarray] = []
    for round_ in range(MOST_ROUNDS + 1):
        if round_ < MOST_ROUNDS:
            _, name, counts = np.unique(segment * names + ids[place], return_inverse=True, return_counts=True)
            often = counts[name] >= 2
        else:
            often = np.ones(len(place), bool)
        whole = np.flatnonzero(np.diff(segment, prepend=-1, append=-1))
        untouched = np.add.reduceat(~often, whole[:-1]) == 0
        spans = np.column_stack([place[whole[:-1]], place[whole[1:] - 1] + 1])
        done.append(spans[untouched & (np.diff(spans, axis=1)[:, 0] >= min_words)])
        again = often & ~np.repeat(untouched, np.diff(whole))
        place, segment = place[again], segment[again]
        if not len(place):
            break
        starts = np.flatnonzero((np.diff(place, prepend=-2) != 1) | (np.diff(segment, prepend=-1) != 0))
        sizes = np.diff(starts, append=len(place))
        segment = np.repeat(np.arange(len(starts)), sizes)
        long = np.repeat(sizes >= min_words, sizes)
        place, segment = place[long], segment[long]
        if not len(place):
            break
    spans = np.concatenate(done)
    return [tuple(s) for s in spans[np.argsort(spans[:, 0])].tolist()]


def gram_names(words: np.ndarray) -> list[np.ndarray]:
    """Names of the grams of 1, 2, 4, ... words at each place, up to the longest that repeat.

    Equal grams, and only those, have equal names. A gram that would pass the end has a name of
    its own.
    """
    n = len(words)
    names = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    while True:
        size = 1 << (len(names) - 1)
        if 2 * size > n:
            return names
        last = names[-1]
        pairs = last[: n - 2 * size + 1] * (2 * n) + last[size : n - size + 1]
        _, found, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if counts.max() < 2:
            return names
        names.append(np.concatenate([found, n + np.arange(n - len(found))]))


def extended(names: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words match from places a and b on, and how many before them."""
    n = len(names[0])
    after, before = np.zeros_like(a), np.zeros_like(a)
    for level in range(len(names) - 1, -1, -1):
        size, name = 1 << level, names[level]
        i, j = a + after, b + after
        fits = j + size <= n
        same = fits & (name[np.where(fits, i, 0)] == name[np.where(fits, j, 0)])
        after += size * same
        i, j = a - before - size, b - before - size
        fits = i >= 0
        same = fits & (name[np.where(fits, i, 0)] == name[np.where(fits, j, 0)])
        before += size * same
    return after, before


def scan_lags(words: np.ndarray, min_words: int, longest: int, at_once: int = 1 << 20) -> np.ndarray:
    """All runs (start, end, period) of ``words``, no segment of which is longer than ``longest``."""
    found = [np.zeros((0, 3), np.int64)]

    def keep(start, end, lag):
        right = end - start >= np.maximum(min_words, 2 * lag)
        found.append(np.column_stack([start, end, lag])[right])

    for lag in range(1, min(DIRECT, longest // 2) + 1):
        same = np.zeros(len(words) - lag + 2, np.int8)
        same[1:-1] = words[:-lag] == words[lag:]
        edges = np.diff(same)
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + lag
        keep(start, end, np.full(len(start), lag))
    if longest // 2 > DIRECT:
        names = gram_names(words)
        n = len(words)
        for level in range(3, len(names)):
            size = 1 << level
            if 2 * size > longest // 2:
                break
            keys = names[level] * n + np.arange(n)
            order = np.sort(keys)
            aligned = np.arange(0, n, size)
            # Within a run of a period up to the gram's size, a longer lag finds that run again.
            covered = np.zeros(n, np.int64)
            known = np.concatenate(found)
            known = known[known[:, 2] <= size]
            np.maximum.at(covered, known[:, 0], known[:, 1])
            covered = np.maximum.accumulate(covered)[aligned]
            nearest = np.maximum(aligned + 2 * size, covered - size + 1)
            lo = np.searchsorted(order, names[level][aligned] * n + np.minimum(nearest, n))
            hi = np.searchsorted(order, names[level][aligned] * n + np.minimum(aligned + 4 * size, n))
            hi = np.maximum(hi, lo)
            ends = np.cumsum(hi - lo)
            first = 0
            while first < len(aligned):
                base = ends[first - 1] if first else 0
                stop = max(first + 1, int(np.searchsorted(ends, base + at_once, side="right")))
                counts = (hi - lo)[first:stop]
                a = np.repeat(aligned[first:stop], counts)
                offset = np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
                b = order[np.repeat(lo[first:stop], counts) + offset] % n
                after, before = extended(names, a, b)
                keep(a - before, b + after, b - a)
                found[-1] = np.unique(found[-1], axis=0)
                first = stop
    runs = np.concatenate(found)
    # A stretch found with a multiple of its period too: the smallest counts.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (np.diff(runs[:, :2], axis=0) != 0).any(axis=1)
    return runs[fresh]


def find_runs(ids: np.ndarray, owner: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Runs (start, end, period) in a block of documents, by places in ``ids``."""
    segments = split_segments(ids, owner, min_words)
    if not segments:
        return np.zeros((0, 3), np.int64)
    lengths = np.array([e - s for s, e in segments])
    starts = np.array([s for s, _ in segments])
    # One array of all segments, with a word of its own after each.
    at = np.cumsum(lengths + 1) - (lengths + 1)
    which = np.repeat(np.arange(len(segments)), lengths)
    inside = np.arange(lengths.sum()) + which
    words = np.empty(lengths.sum() + len(segments), np.int64)
    words[inside] = ids[np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[which]]
    words[at + lengths] = -1 - np.arange(len(segments))
    runs = scan_lags(words, min_words, int(lengths.max()))
    shift = (starts - at)[np.searchsorted(at, runs[:, 0], side="right") - 1]
    runs[:, 0] += shift
    runs[:, 1] += shift
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def block_results(texts: list[list[bytes]], min_words: int) -> tuple[list[list[dict]], list[bytes]]:
    """Runs and collapsed text of each word list."""
    sizes = np.array([len(t) for t in texts])
    flat = pa.array([w for t in texts for w in t], pa.binary())
    ids = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    base = np.cumsum(sizes) - sizes
    runs = find_runs(ids, np.repeat(np.arange(len(texts)), sizes), min_words)
    bounds = np.searchsorted(runs[:, 0], np.append(base, len(ids)))
    found, collapsed = [], []
    for i, words in enumerate(texts):
        own = runs[bounds[i] : bounds[i + 1]] - [base[i], base[i], 0]
        found.append([{"start": s, "length": e - s, "period": q} for s, e, q in own.tolist()])
        if len(own):
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, own[:, 0] + own[:, 2], 1)
            np.add.at(change, own[:, 1], -1)
            words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
        collapsed.append(b" ".join(words))
    return found, collapsed


def with_runs(df: DataFrame, min_words: int = MIN_WORDS, edit: Edit | None = None, key: str = "doc_id") -> DataFrame:
    """Add n_words, runs (start, length, period) and collapsed, the text without repeated periods.

    ``edit``, if given, gets the value of ``key`` and the words of a row and returns the words to
    be examined in their place.
    """

    def start():
        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            counts, runs, texts, waiting, size = [], [], [], [], 0

            def flush():
                nonlocal waiting, size
                found, collapsed = block_results(waiting, min_words)
                counts.extend(len(w) for w in waiting)
                runs.extend(found)
                texts.extend(collapsed)
                waiting, size = [], 0

            keys = batch.column(key) if edit else None
            for i, text in enumerate(batch.column("text").cast(pa.large_binary())):
                words = (text.as_py() or b"").split()
                if edit:
                    words = edit(keys[i].as_py(), words)
                if waiting and size + len(words) > BLOCK_WORDS:
                    flush()
                waiting.append(words)
                size += len(words)
            flush()
            struct = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
            return {
                "n_words": pa.array(counts, pa.int64()),
                "runs": pa.array(runs, struct),
                "collapsed": pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string()),
            }

        return work

    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", RUN),
        T.StructField("collapsed", T.StringType()),
    ]
    return append_columns(df, start, fields)


def planted(doc_id: object, words: list) -> list:
    """Words with the repetitions that the query is asked to plant in a tenth of the documents."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def digests(found: DataFrame) -> DataFrame:
    """Per row: number of runs, the longest one, and digests of all runs and of the kept words."""
    # array_max compares field by field: the greatest length, then the smallest start and period.
    order = F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    best = F.array_max(order)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[n].cast("string") for n in ("start", "length", "period")]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-best["s"]).alias("start"),
        best["length"].alias("length"),
        (-best["p"]).alias("period"),
        F.floor(best["length"] * 1000 / -best["p"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
