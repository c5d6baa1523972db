"""Near-duplicate documents: MinHash bands find candidates, odd sketches screen them, and the
full shingle sets decide.

Steps
1. One pass over the texts: shingle set, MinHash samples, their band keys, and an odd sketch
   (the samples folded into a parity bitmap; the bits in which two sketches differ estimate how
   many samples differ). Documents with equal sets form one class and go on as one.
2. In each bucket (classes that share a band key) every class is compared with the bucket's
   first one, the hub. A group of similar classes thereby becomes connected with as many
   comparisons as it has members.
3. Only in buckets that still hold more than one component the classes outside the largest one
   are compared with all classes of other components. A second odd sketch, of the full set,
   takes part: bits that differ cannot be more than shingles that differ, so too many of them
   rule a link out for certain. No pair of a bucket is left open: its two classes are in one
   component, have been compared, or cannot be linked.
4. A pair is a link if the full sets say so; components of the links are the groups.

Candidates whose sketches are far apart are not looked up: the screen lies ``MARGIN`` below the
similarity asked for, six standard deviations of the estimate. A pair exactly at the
similarity misses all bands with a probability below ``MISS``.

Defined cases: no words or a null text: empty set, linked with nothing. Fewer words than the
width: the whole sequence is the one shingle. Rows with equal ids are separate documents that
share an id. Rows without an id link like others; a component's id is its smallest id, null if
it has none, and rows without an id in such a component are all marked kept, as are all documents
that share the smallest id. ``keep_one`` keeps one document of each group also then.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.llm.common import DOC_KEY, append_columns, row_key, small, text_batches
from tremora.llm.graph import components
from tremora.session import stored

BANDS = 40
MISS = 1e-6
MARGIN = 0.2
BITS = 512
PARITY = 1024  # bits of the odd sketch of a full set
MOST_BROADCAST = 500_000

U = np.uint64
BASE, MASK = 0x9E3779B97F4A7C1B, (1 << 64) - 1
STEPS = (0xD1B54A32D192ED03, 0xAEF17502108EF2D9)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Hashed word shingles of many texts at once.

    Words are runs of bytes other than space and tab .. carriage return, A-Z in lower case. A
    word's hash comes from prefix sums of byte times power, so no loop runs over words.
    """

    def __init__(self, width: int):
        self.width = width
        self.powers = self.inverse = np.ones(1, U)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            back = pow(BASE, -1, 1 << 64)
            self.powers, self.inverse = (
                np.cumprod(np.append(U(1), np.full(n, base, U))) for base in (BASE, back)
            )

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where each text's words start (one more entry than texts)."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
        data = texts.buffers()[2]
        if data is None or offsets[-1] == offsets[0]:
            return np.zeros(0, U), np.zeros(len(texts) + 1, np.int64)
        blob = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        blob = np.where((blob >= 65) & (blob <= 90), blob + 32, blob).astype(np.uint8)
        word = (blob != 32) & ((blob < 9) | (blob > 13))
        first = np.zeros(len(blob) + 1, bool)
        first[offsets[:-1]] = True  # a text's first byte starts a word even without a space
        before = np.concatenate([[False], word[:-1]])
        starts = np.flatnonzero(word & (~before | first[:-1]))
        after = np.concatenate([word[1:], [False]])
        last = np.zeros(len(blob), bool)
        last[offsets[1:][offsets[1:] > 0] - 1] = True
        ends = np.flatnonzero(word & (~after | last)) + 1
        self._grow(len(blob) + 1)
        sums = np.append(U(0), np.cumsum((blob.astype(U) + U(1)) * self.powers[: len(blob)]))
        hashes = (sums[ends] - sums[starts]) * self.inverse[starts]
        return mix(hashes + (ends - starts).astype(U) * U(STEPS[0])), np.searchsorted(starts, offsets)

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        words, bounds = self.words(texts)
        steps = [U(pow(STEPS[1], i + 1, 1 << 64)) for i in range(self.width)]
        n = max(0, len(words) - self.width + 1)
        rolled = np.zeros(n, U)
        for i, step in enumerate(steps):
            rolled += words[i : i + n] * step
        rolled = mix(rolled)
        found = []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo >= self.width:
                found.append(np.unique(rolled[lo : hi - self.width + 1]))
            elif hi > lo:
                short = sum(int(w) * int(s) for w, s in zip(words[lo:hi], steps)) + int(hi - lo)
                found.append(mix(np.array([short & MASK], U)))
            else:
                found.append(np.zeros(0, U))
        return found


def band_rows(similarity: float, bands: int = BANDS, miss: float = MISS) -> int:
    """Most samples a band may have so that a pair at ``similarity`` is missed less often than
    ``miss``."""
    rows = 1
    while (1 - similarity ** (rows + 1)) ** bands <= miss:
        rows += 1
    return rows


def odd_sketch(values: np.ndarray, bits: int) -> np.ndarray:
    """Which of ``bits`` places are hit by an odd number of the (distinct, mixed) values."""
    place = (values % U(bits)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=bits).astype(np.uint8) & 1)


class Sketcher:
    """MinHash samples of a shingle set, as band keys and as an odd sketch."""

    def __init__(self, rows: int, bands: int = BANDS):
        self.rows, self.bands, self.samples = rows, bands, rows * bands
        random = np.random.default_rng(20240817)
        self.factors = random.integers(0, 1 << 31, self.samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.lanes = mix(np.arange(1, self.samples + 1, dtype=U) * U(BASE))
        self.band_lanes = mix(np.arange(1, bands + 1, dtype=U) * U(STEPS[0]))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low, high = shingles.astype(np.uint32), (shingles >> U(32)).astype(np.uint32)
        least = np.full(self.samples, 0xFFFFFFFF, np.uint32)
        step = max(1, (1 << 18) // self.samples)
        for at in range(0, len(low), step):
            lanes = np.multiply.outer(self.factors, low[at : at + step])
            lanes += high[at : at + step]
            np.minimum(least, lanes.min(axis=1), out=least)
        return least

    def sketch(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = self.minima(shingles).astype(U)
        keys = np.zeros(self.bands, U)
        for row in least.reshape(self.bands, self.rows).T:
            keys = mix(keys * U(STEPS[1]) + row)
        return mix(keys + self.band_lanes), odd_sketch(mix(least + self.lanes), BITS)


def _node(doc_id: int | None, shingles: np.ndarray) -> bytes:
    """Name of a document's class that sorts by id; ids that are missing come last."""
    mixed = mix(shingles)
    total = int(mixed.sum(dtype=U)), int(np.bitwise_xor.reduce(mix(mixed + U(len(mixed)))))
    head = b"\1" + bytes(8) if doc_id is None else b"\0" + ((doc_id + (1 << 63)) & MASK).to_bytes(8, "big")
    return head + b"".join(t.to_bytes(8, "big") for t in total)


def signatures(docs: DataFrame, width: int, rows: int) -> DataFrame:
    """Add n_shingles and, for sets that are not empty, node, bands, sketch and parity."""
    fields = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("node", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.ArrayType(T.LongType())),
        T.StructField("parity", T.ArrayType(T.LongType())),
    ]

    def start():
        shingler, sketcher = Shingler(width), Sketcher(rows)

        def work(batch: pa.RecordBatch):
            texts, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            sizes, nodes, bands, sketches, parities = [], [], [], [], []
            for lo, hi in text_batches(texts):
                for i, shingles in enumerate(shingler.sets(texts.slice(lo, hi - lo)), lo):
                    sizes.append(len(shingles))
                    if len(shingles):
                        keys, bits = sketcher.sketch(shingles)
                        nodes.append(_node(ids[i], shingles))
                        bands.append(keys.view(np.int64))
                        sketches.append(bits.view(np.int64))
                        parities.append(odd_sketch(shingles, PARITY).view(np.int64))
                    else:
                        for column in (nodes, bands, sketches, parities):
                            column.append(None)
            return {
                "n_shingles": pa.array(sizes, pa.int64()),
                "node": pa.array(nodes, pa.binary()),
                "bands": pa.array(bands, pa.list_(pa.int64())),
                "sketch": pa.array(sketches, pa.list_(pa.int64())),
                "parity": pa.array(parities, pa.list_(pa.int64())),
            }

        return work

    return append_columns(docs, start, fields, drop=["text"])


def full_sets(docs: DataFrame, width: int, nodes: DataFrame) -> DataFrame:
    """node and shingles of the classes in ``nodes`` (columns nid and node)."""
    fields = [
        T.StructField("node", T.BinaryType()),
        T.StructField("shingles", T.ArrayType(T.LongType())),
    ]

    def start():
        shingler = Shingler(width)

        def work(batch: pa.RecordBatch):
            texts, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            names, sets = [], []
            for lo, hi in text_batches(texts):
                for i, shingles in enumerate(shingler.sets(texts.slice(lo, hi - lo)), lo):
                    names.append(_node(ids[i], shingles) if len(shingles) else None)
                    sets.append(shingles.view(np.int64))
            return {"node": pa.array(names, pa.binary()), "shingles": pa.array(sets, pa.list_(pa.int64()))}

        return work

    ids = small(nodes.select(F.col("id").alias("doc_id")).distinct(), MOST_BROADCAST)
    texts = docs.select("doc_id", "text").join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    made = append_columns(texts, start, fields, drop=["text", "doc_id"])
    needed = small(nodes.select("node").distinct(), MOST_BROADCAST)
    return made.join(needed, "node", "left_semi").dropDuplicates(["node"])


def most_differing_bits(similarity: float, samples: int) -> int:
    """Bits in which the odd sketches of a pair ``MARGIN`` below ``similarity`` differ."""
    differing = 2 * samples * (1 - max(0.0, similarity - MARGIN))
    return math.ceil(BITS / 2 * (1 - math.exp(-2 * differing / BITS)))


def _links(docs, classes, pairs, width, percent, bits) -> DataFrame:
    """Those of the candidate ``pairs`` (nid_a, nid_b) that the full sets confirm, as nodes a, b."""
    side = classes.select("nid", "id", "node", "n_shingles", "sketch", "parity")
    a = side.select(*[F.col(c).alias(f"{c}_a") for c in side.columns])
    b = side.select(*[F.col(c).alias(f"{c}_b") for c in side.columns])

    def differ(name: str) -> Column:
        bits = F.zip_with(f"{name}_a", f"{name}_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        return F.aggregate(bits, F.lit(0), lambda total, x: total + x)

    sides = [F.col("n_shingles_a"), F.col("n_shingles_b")]
    sizes = sides[0] + sides[1]
    near = (
        pairs.join(a, "nid_a")
        .join(b, "nid_b")
        .where("node_a <> node_b")
        .where(F.least(*sides) * 100 >= F.greatest(*sides) * percent)
        .where(differ("sketch") <= bits)
        .where(differ("parity") * (100 + percent) <= sizes * (100 - percent))
        .select("id_a", "node_a", "id_b", "node_b")
    )
    near = stored(near, "near-pairs")
    nodes = near.selectExpr("id_a AS id", "node_a AS node").union(near.selectExpr("id_b", "node_b"))
    sets = stored(full_sets(docs, width, nodes.distinct()), "full-sets")
    common = F.size(F.array_intersect("shingles_a", "shingles_b")).cast("bigint")
    union = F.size("shingles_a") + F.size("shingles_b") - common
    return (
        near.join(sets.selectExpr("node AS node_b", "shingles AS shingles_b"), "node_b")
        .join(sets.selectExpr("node AS node_a", "shingles AS shingles_a"), "node_a")
        .where(common * 100 >= union * percent)
        .selectExpr("node_a AS a", "node_b AS b")
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of one document of each group, with their columns.

    It is the first by (doc_id, set id, row key), those without an id last. Rows equal in id and
    text are one document, and documents without words are in no group: all their rows stay.
    """
    groups = _grouped(docs, width, percent)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "set_id", DOC_KEY)
    first = groups.where("set_id IS NOT NULL").groupBy("root").agg(F.min(order).alias("first"))
    kept = first.select(f"first.{DOC_KEY}").union(groups.where("set_id IS NULL").select(DOC_KEY)).distinct()
    keyed = docs.withColumn(DOC_KEY, row_key("doc_id", "text"))
    return keyed.join(kept, DOC_KEY, "left_semi").drop(DOC_KEY)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and the row's key for each row of ``docs``.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their sets of
    ``width``-word shingles. kept marks the document of a component's smallest id.
    """
    return _grouped(docs, width, percent).select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        DOC_KEY,
    )


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, the row's key, set_id and root, which tells components
    apart; both are null without words."""
    rows = band_rows(percent / 100)
    bits = most_differing_bits(percent / 100, rows * BANDS)
    keyed = docs.select("doc_id", "text", row_key("doc_id", "text").alias(DOC_KEY))
    signed = stored(signatures(keyed, width, rows), "signatures")
    whole = signed.where("node IS NOT NULL").withColumn("set_id", F.expr("substring(node, 10, 16)"))
    classes = whole.groupBy("set_id").agg(
        F.min(F.struct("node", "doc_id", "n_shingles", "bands", "sketch", "parity")).alias("c")
    )
    classes = classes.select("set_id", "c.*").withColumnRenamed("doc_id", "id")
    # An id with several sets names none of them: those go by their sets.
    several = whole.groupBy("doc_id").agg(F.min("set_id").alias("one"), F.max("set_id").alias("other"))
    several = several.where("one <> other").select(F.col("doc_id").alias("several"))
    classes = classes.join(several, F.col("id") == F.col("several"), "left")
    nid = F.when(F.col("several").isNull(), F.col("id"))
    classes = stored(classes.withColumn("nid", F.coalesce(nid, F.xxhash64("set_id"))).drop("several"), "classes")

    buckets = stored(classes.select(F.explode("bands").alias("bucket"), "nid"), "buckets")
    hubs = buckets.groupBy("bucket").agg(F.min("nid").alias("hub"), F.count("*").alias("n"))
    hubs = stored(hubs.where("n > 1").drop("n"), "hubs")
    shared = stored(buckets.join(hubs, "bucket"), "shared-buckets")
    stars = shared.where("hub <> nid").selectExpr("hub AS nid_a", "nid AS nid_b").distinct()
    links = stored(_links(docs, classes, stars, width, percent, bits), "links")

    # Two sets of one 64-bit name (a chance of n^2 / 2^65) meet in no bucket as two: compare them.
    twins = classes.groupBy("nid").count().where("count > 1").selectExpr("nid AS nid_a", "nid AS nid_b")
    open_pairs = _open_pairs(classes, shared, components(links), percent).union(twins).distinct()
    more = _links(docs, classes, open_pairs, width, percent, bits)
    roots = components(links.union(more))

    grouped = classes.join(roots, "node", "left").select(
        "set_id", F.coalesce("root", "node").alias("root")
    )
    named = stored(grouped.select("set_id", "root", _id_of("root").alias("component_id")), "components")
    own = F.expr("substring(node, 10, 16)").alias("set_id")
    result = signed.select("doc_id", "n_shingles", DOC_KEY, own).join(named, "set_id", "left")
    found = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return result.withColumn("component_id", found)


def _id_of(node: str) -> Column:
    number = f"cast(conv(hex(substring({node}, 2, 8)), 16, 10) AS decimal(20, 0))"
    return F.expr(
        f"CASE WHEN substring({node}, 1, 1) = X'00' "
        f"THEN cast({number} - 9223372036854775808 AS bigint) END"
    )


def _open_pairs(classes, shared, roots, percent) -> DataFrame:
    """Pairs of a bucket whose classes are in different components and were not compared.

    Pairs whose full-set parities rule out a link are no rows of the join.
    """
    named = classes.select("nid", "node").join(roots, "node", "left")
    named = stored(named.select("nid", F.coalesce("root", "node").alias("root")), "class-roots")
    members = stored(shared.join(named, "nid"), "members")
    parts = members.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    parts = parts.groupBy("bucket").agg(
        F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("parts"), F.sum("n").alias("n")
    )
    parts = parts.where("parts > 1 AND n > 2").select("bucket", F.col("most.root").alias("most"))
    left = members.join(stored(parts, "open-buckets"), "bucket").where("nid <> hub")
    words = [F.get("parity", F.lit(i)).alias(f"p{i}") for i in range(PARITY // 64)]
    sized = classes.select("nid", F.col("n_shingles").alias("n"), *words)
    left = left.select("bucket", "nid", "root", "most").join(sized, "nid")
    left = stored(left, "open-members")
    outside = left.where("root <> most").drop("most")
    outside = outside.withColumnsRenamed({c: f"{c}_a" for c in outside.columns if c != "bucket"})
    differ = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"p{i}_a"))) for i in range(PARITY // 64)), F.lit(0))
    return (
        outside.join(left, "bucket")
        .where("root <> root_a AND (root = most OR nid_a < nid)")
        .where(differ * (100 + percent) <= (F.col("n_a") + F.col("n")) * (100 - percent))
        .selectExpr("nid_a", "nid AS nid_b")
        .distinct()
    )
