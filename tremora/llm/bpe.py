"""Byte-pair encoding and decoding over a memory-mapped word lexicon.

Frequent words of the corpus are compiled into a minimal acyclic transducer: words share
prefixes and suffixes, and the sum of the outputs along a word's path is its number, which
points to its token ids. The file lies in the shared folder, Spark copies it to each executor,
and all Python workers there map it. Words outside the lexicon, among them all of more than 64
bytes, are merged exactly, so the lexicon decides speed only, never ids.

Defined cases: a null text counts as empty and has no ids. Texts of any length are encoded whole,
one word of a whole text included (n log n steps). Repeated rows each get the same ids; there are no ties.
An empty table gives an empty table (and an empty lexicon). The operators keep all other columns; a
column that has the name of an output is replaced.
"""

from __future__ import annotations

import heapq
import io
import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.llm.common import append_columns, text_batches
from tremora.session import shared_folder, stored

#: How the byte-level vocabulary splits text before merging, and its white space.
SPACES = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPLIT = (
    r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def split_pattern() -> str:
    """Java pattern of the words of a text without special tokens.

    Every repetition is one of a plain class, which Java matches in a loop; a repeated group would
    recurse once per symbol.
    """
    odd = f"[^{SPACES}\\p{{L}}\\p{{N}}]"
    pattern = SPLIT.replace(r"(?!\S)", f"(?![^{SPACES}])").replace(r"[^\s\p{L}\p{N}]", odd)
    return pattern.replace(r"\s", f"[{SPACES}]")


def special_pattern(special: Iterable[str]) -> str:
    """Java pattern of special tokens, longer ones first."""
    return "|".join(f"\\Q{s}\\E" for s in sorted(special, key=len, reverse=True))


def _byte_letters() -> dict[str, int]:
    """Byte of each letter in vocabulary files: printable bytes stand for themselves, the
    others for code points from 256 up, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


WORDS = "__words"
PART = 2 << 20  # bytes of text that are encoded together
SIDE_BY_SIDE = 48  # bytes of the longest word that is merged in a matrix
LEXICON_BYTES = 64  # longer words are merged where they occur: a look-up takes a step per byte
BASE = 1 << 31
NO_PAIR = (1 << 31) - 1
SPREAD = 0x9E3779B97F4A7C15 - (1 << 64)  # of pairs over the slots of their table


class Vocabulary:
    """Token bytes, merges and special tokens, as plain arrays that can be broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.byte_ids = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges = []
        for merge in spec["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.append((vocab[left], vocab[right], vocab[left + right]))


class Merger:
    """Exact merges of single words."""

    def __init__(self, vocabulary: Vocabulary):
        self.byte_ids = vocabulary.byte_ids
        self.pairs = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(vocabulary.merges)}
        self.results = np.array([c for _, _, c in vocabulary.merges], np.int32)
        self._place(np.array([(a, b) for a, b in self.pairs], np.int64).reshape(-1, 2))
        every = np.asarray(self.byte_ids, np.int32)
        self.byte_pairs = self._ranks(np.repeat(every, 256), np.tile(every, 256))

    def _place(self, pairs: np.ndarray) -> None:
        """A table of the pairs' ranks: a pair stands at its hash or in the next free slot."""
        keys = pairs[:, 0] * BASE + pairs[:, 1]
        ranks = np.array([rank for rank, _ in self.pairs.values()], np.int32)
        self.mask = (4 << max(len(keys), 1).bit_length()) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.ranks = np.full(self.mask + 1, NO_PAIR, np.int32)
        left, slots = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = np.flatnonzero(self.keys[slots] < 0)
            taken, first = np.unique(slots[free], return_index=True)
            self.keys[taken], self.ranks[taken] = keys[left[free[first]]], ranks[left[free[first]]]
            rest = np.ones(len(left), bool)
            rest[free[first]] = False
            left, slots = left[rest], slots[rest] + 1 & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * SPREAD >> 20) & self.mask

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: the pair of the lowest rank, leftmost first, until none is left.

        A heap over a linked list keeps long words at n log n.
        """
        ids = [self.byte_ids[b] for b in word]
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := pairs.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if 0 <= a and b < n and (found := pairs.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (found[0], a, ids[a], ids[b], found[1]))
        return [i for i in ids if i >= 0]

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Ids of many words."""
        lengths = np.array([len(w) for w in words], np.int64)
        ids, starts, sizes = self.merge_pieces(np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths)
        return [ids[at : at + n].tolist() for at, n in zip(starts, sizes)]

    def merge_pieces(
        self, blob: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chunk: int = 8192
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many words (bytes ``starts`` .. of ``blob``), with each word's first and number.

        Short words are merged side by side, one pair in each at a time.
        """
        order = np.argsort(lengths, kind="stable")  # words of like lengths go together
        short = int(np.searchsorted(lengths[order], SIDE_BY_SIDE, side="right"))
        made, sizes = [np.zeros(0, np.int32)], np.zeros(len(order), np.int64)
        for at in range(0, short, chunk):
            rows = order[at : min(at + chunk, short)]
            ids, sizes[rows] = self._side_by_side(blob, starts[rows], lengths[rows])
            made.append(ids)
        for row in order[short:]:
            ids = self.merge(blob[starts[row] : starts[row] + lengths[row]].tobytes())
            made.append(np.array(ids, np.int32))
            sizes[row] = len(ids)
        firsts = np.zeros(len(order), np.int64)
        firsts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(made), firsts, sizes

    def _side_by_side(self, blob: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one word after the other, and each word's number of ids.

        A row of the matrices is a word, linked in both directions; the last column is the end of
        both. ``rank`` is that of a symbol and the one after it.
        """
        width = int(lengths.max()) if len(lengths) else 0
        if not width:
            return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
        columns = np.arange(width)
        inside = columns < lengths[:, None]
        data = blob[np.where(inside, starts[:, None] + columns, 0)]
        shape = (len(lengths), width + 1)
        ids = np.full(shape, -1, np.int32)
        ids[:, :-1] = np.where(inside, np.asarray(self.byte_ids, np.int32)[data], -1)
        rank = np.full(shape, NO_PAIR, np.int32)
        pairs = self.byte_pairs[data[:, :-1].astype(np.int64) * 256 + data[:, 1:]]
        rank[:, : width - 1] = np.where(inside[:, 1:], pairs, NO_PAIR)
        after, before = np.empty(shape, np.int16), np.empty(shape, np.int16)
        after[:] = np.minimum(np.arange(1, width + 2), width)
        before[:] = np.concatenate([[width], np.arange(width)])
        ids_, rank_, after_, before_ = (x.reshape(-1) for x in (ids, rank, after, before))
        live = np.arange(len(lengths))
        while len(live):
            row = live * (width + 1)
            best = (rank if len(live) == len(rank) else rank[live]).argmin(axis=1)
            at = row + best
            lowest = rank_[at]
            go = lowest < NO_PAIR
            live, row, at, lowest = live[go], row[go], at[go], lowest[go]
            gone = row + after_[at]
            right, left = row + after_[gone], row + before_[at]
            ids_[at], ids_[gone], rank_[gone] = self.results[lowest], -1, NO_PAIR
            after_[at], before_[right] = after_[gone], at - row
            rank_[at] = self._ranks(ids_[at], ids_[right])
            rank_[left] = self._ranks(ids_[left], ids_[at])
        kept = ids >= 0
        return ids[kept], kept.sum(axis=1)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 stands for no symbol, and no pair in the table has one."""
        key = left.astype(np.int64) * BASE + right
        slot = self._slots(key)
        found = self.keys[slot]
        rank = np.where(found == key, self.ranks[slot], NO_PAIR)
        other = np.flatnonzero((found != key) & (found >= 0))
        while len(other):
            slot[other] = slot[other] + 1 & self.mask
            found = self.keys[slot[other]]
            rank[other] = np.where(found == key[other], self.ranks[slot[other]], NO_PAIR)
            other = other[(found != key[other]) & (found >= 0)]
        return rank


# --- lexicon --------------------------------------------------------------------------


def compile_lexicon(words: Iterable[tuple[bytes, list[int]]]) -> np.ndarray:
    """The transducer of the given words and ids as one array of 32-bit integers.

    Words are added in order; a state is looked up among the finished ones as soon as no
    later word can change it, so equal suffixes are stored once.
    """
    words = sorted(dict(words).items())
    finished: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # final, ((byte, target), ...)

    def finish(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in finished:
            finished[key] = len(states)
            states.append(key)
        return finished[key]

    path: list[list] = [[False, []]]  # of the last word: final, finished arcs
    last = b""
    for word, _ in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        for depth in range(len(last), shared, -1):
            target = finish(path.pop())
            path[-1][1].append((last[depth - 1], target))
        path += [[False, []] for _ in word[shared:]]
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        target = finish(path.pop())
        path[-1][1].append((last[depth - 1], target))
    root = finish(path.pop())

    below = np.zeros(len(states), np.int64)  # words below a state; targets are finished first
    keys, targets, outputs = [], [], []
    for s, (final, arcs) in enumerate(states):
        below[s] = final
        for byte, target in arcs:
            keys.append(s * 256 + byte)
            targets.append(target)
            outputs.append(below[s])
            below[s] += below[target]
    final = np.array([f for f, _ in states], np.int32)
    starts = np.cumsum([0, *[len(ids) for _, ids in words]])
    flat = [i for _, ids in words for i in ids]
    head = [len(keys), len(states), len(words), len(flat), root]
    head.append(max([len(w) for w, _ in words], default=0))
    parts = [head, keys, targets, outputs, final, starts, flat]
    return np.concatenate([np.asarray(p, np.int32) for p in parts])


class Lexicon:
    """Look-up of many words at once in a compiled lexicon."""

    def __init__(self, data: np.ndarray):
        arcs, states, words, ids, self.root, self.longest = (int(x) for x in data[:6])
        at = 6
        parts = []
        for size in (arcs, arcs, arcs, states, words + 1, ids):
            parts.append(data[at : at + size])
            at += size
        self.keys, self.targets, self.outputs, self.final, self.starts, self.ids = parts

    def numbers(self, blob: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of each word (bytes ``starts`` .. of ``blob``), -1 for unknown ones."""
        number = np.zeros(len(starts), np.int64)
        state = np.full(len(starts), self.root, np.int64)
        if not len(self.keys):
            return np.full(len(starts), -1)
        live = np.flatnonzero((lengths <= self.longest) & (lengths > 0))
        for depth in range(self.longest):
            go = live[lengths[live] > depth]
            if not len(go):
                break
            key = state[go] * 256 + blob[starts[go] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[arc] == key
            state[go] = np.where(known, self.targets[arc], -1)
            number[go] += self.outputs[arc]
            live = np.concatenate([live[lengths[live] <= depth], go[known]])
        found = np.zeros(len(starts), bool)
        found[live] = self.final[state[live]] == 1
        return np.where(found, number, -1)


def with_words(df: DataFrame, vocabulary: Vocabulary, text: str, output: str) -> DataFrame:
    """Add the words of each text, in order; nothing is left out between them.

    Special tokens are words, and a text that has some is first split at them.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    words = lambda part: F.regexp_extract_all(part, F.lit(split_pattern()), F.lit(0))
    if not vocabulary.special:
        return df.withColumn(output, words(whole))
    pattern = special_pattern(vocabulary.special)
    special = F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))
    # Zipped, so that both arrays are made once and not anew for every part.
    pairs = F.arrays_zip(F.split(whole, pattern, -1).alias("part"), special.alias("special"))
    parts = F.transform(pairs, lambda p: F.concat(words(p["part"]), F.array_compact(F.array(p["special"]))))
    return df.withColumn(output, F.when(whole.rlike(pattern), F.flatten(parts)).otherwise(words(whole)))


def frequent_words(df: DataFrame, vocabulary: Vocabulary, text: str, most: int) -> list[str]:
    """At most ``most`` words, the most frequent ones of all texts; only these reach the driver.

    Counts are put into 8 classes per power of two; the classes taken are those that fit whole.
    """
    words = with_words(df.select(text), vocabulary, text, WORDS).select(F.explode(WORDS).alias("w"))
    words = words.where(F.octet_length("w") <= LEXICON_BYTES)
    counts = words.groupBy("w").count().where("count > 1")
    counts = stored(counts.select("w", F.floor(F.log2("count") * 8).alias("size")), "word-counts")
    taken, lowest = 0, None
    sizes = counts.groupBy("size").count().collect()  # a few hundred rows at most
    for row in sorted(sizes, reverse=True):
        taken += row["count"]
        if taken > most:
            break
        lowest = row["size"]
    if lowest is None:
        return []
    rows = counts.where(F.col("size") >= lowest).collect()
    return sorted(r["w"] for r in rows if r["w"] not in vocabulary.special)


def store_lexicon(spark: SparkSession, data: np.ndarray) -> str:
    """Write a compiled lexicon to the shared folder and hand it to all executors."""
    folder = shared_folder(spark, "lexicon")
    buffer = io.BytesIO()
    np.save(buffer, data)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}.npy")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return path.getName()


def build_lexicon(df: DataFrame, vocabulary: Vocabulary, text: str = "text", most: int = 32_768):
    """Count the words of ``df``, compile the frequent ones, and return the file's name."""
    merger = Merger(vocabulary)
    words = [w.encode() for w in frequent_words(df, vocabulary, text, most)]
    return store_lexicon(df.sparkSession, compile_lexicon((w, merger.merge(w)) for w in words))


# --- encoding and decoding ------------------------------------------------------------


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each piece, one piece after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.lexicon, self.merger = lexicon, Merger(vocabulary)
        self.special = {s.encode(): i for s, i in vocabulary.special.items()}
        self.ids = np.asarray(lexicon.ids, np.int32)

    def encode(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and each text's number of ids.

        Each distinct word is looked up once; its ids are then dealt to where it stands.
        """
        flat_words = words.flatten().cast(pa.large_string())
        coded = flat_words.dictionary_encode()
        distinct = coded.dictionary
        offsets = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1]
        data = distinct.buffers()[2]
        blob = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        starts, lengths = offsets[:-1], np.diff(offsets)
        number = self.lexicon.numbers(blob, starts, lengths)
        known = np.maximum(number, 0)
        at, size = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        if len(self.ids):
            at += self.lexicon.starts[known]
            size += self.lexicon.starts[known + 1] - at
        miss = np.flatnonzero(number < 0)
        merged, at[miss], size[miss] = self.merger.merge_pieces(blob, starts[miss], lengths[miss])
        at[miss] += len(self.ids)
        special = [(distinct.index(s.decode()).as_py(), i) for s, i in self.special.items()]
        special = [(word, i) for word, i in special if word >= 0]
        for k, (word, _) in enumerate(special):
            at[word], size[word] = len(self.ids) + len(merged) + k, 1
        ids = np.concatenate([self.ids, merged, np.array([i for _, i in special], np.int32)])
        own = ids[_ragged(at, size)].astype("<u4")
        ends = np.concatenate([[0], np.cumsum(size * 4)])
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(own)])
        dealt, totals = _joined(pieces.take(coded.indices))
        counts = np.diff(words.offsets.to_numpy())
        ends = np.cumsum([0, *counts])
        return np.frombuffer(dealt, "<u4"), (totals[ends[1:]] - totals[ends[:-1]]) // 4


def _joined(pieces: pa.LargeBinaryArray) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of all pieces, one after the other, and the positions at which they begin and end."""
    _, offsets, data = pieces.buffers()
    ends = np.frombuffer(offsets, np.int64)[: len(pieces) + 1] if len(pieces) else np.zeros(1, np.int64)
    return (data or pa.py_buffer(b"")).slice(0, int(ends[-1])), ends


def _encoding(vocabulary: Vocabulary, lexicon: str):
    """A function from an Arrow batch's texts and words to packed ids."""
    encoder = Encoder(vocabulary, Lexicon(np.load(SparkFiles.get(lexicon), mmap_mode="r")))

    def pack(texts: pa.Array, words: pa.ListArray) -> list[bytes]:
        made = []
        for lo, hi in text_batches(texts, PART):
            flat, sizes = encoder.encode(words.slice(lo, hi - lo))
            ends = np.cumsum(sizes)
            made += [flat[e - n : e].tobytes() for e, n in zip(ends, sizes)]
        return made

    return pack


def _decoding(vocabulary: Vocabulary):
    """A function from an array of packed ids to texts."""
    tokens = pa.array(vocabulary.tokens, pa.large_binary())

    def texts_of(packed: pa.Array) -> list[str]:
        made = []
        for lo, hi in text_batches(packed, PART):
            parts = [p or b"" for p in packed.slice(lo, hi - lo).to_pylist()]
            data, ends = _joined(tokens.take(pa.array(np.frombuffer(b"".join(parts), "<u4"))))
            ends = ends[np.cumsum([0, *[len(p) // 4 for p in parts]])].tolist()
            data = data.to_pybytes()
            made += [data[i:j].decode("utf-8", errors="replace") for i, j in zip(ends, ends[1:])]
        return made

    return texts_of


def encode(
    df: DataFrame,
    vocabulary: Vocabulary,
    lexicon: str,
    text: str = "text",
    output: str = "tokens",
) -> DataFrame:
    """Add the ids of each text as little-endian unsigned 32-bit integers (binary)."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def start():
        pack = _encoding(shared.value, lexicon)

        def work(batch: pa.RecordBatch):
            return {output: pa.array(pack(batch.column(text), batch.column(WORDS)), pa.binary())}

        return work

    split = with_words(df, vocabulary, text, WORDS)
    return append_columns(split, start, [T.StructField(output, T.BinaryType())], drop=[WORDS])


def decode(
    df: DataFrame, vocabulary: Vocabulary, tokens: str = "tokens", output: str = "decoded"
) -> DataFrame:
    """Add the text of packed ids; bytes that are no UTF-8 become replacement characters."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def start():
        texts_of = _decoding(shared.value)

        def work(batch: pa.RecordBatch):
            return {output: pa.array(texts_of(batch.column(tokens)), pa.string())}

        return work

    return append_columns(df, start, [T.StructField(output, T.StringType())])


def encode_and_decode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add tokens and, decoded from them, decoded, over a lexicon of the frame's own frequent
    words. One pass, so a task has one Python worker."""
    vocabulary = Vocabulary(path)
    lexicon = build_lexicon(df, vocabulary, text)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def start():
        pack, texts_of = _encoding(shared.value, lexicon), _decoding(shared.value)

        def work(batch: pa.RecordBatch):
            packed = pa.array(pack(batch.column(text), batch.column(WORDS)), pa.binary())
            return {"tokens": packed, "decoded": pa.array(texts_of(packed), pa.string())}

        return work

    fields = [T.StructField("tokens", T.BinaryType()), T.StructField("decoded", T.StringType())]
    return append_columns(with_words(df, vocabulary, text, WORDS), start, fields, drop=[WORDS])


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return coded.select(
        "doc_id",
        (F.length("tokens") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
