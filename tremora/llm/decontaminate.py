"""Benchmark decontamination over a positional inverted index.

The index holds a posting (document, position, term) for every occurrence in the training texts
of a term that the test texts use; terms that no test text has can never be asked for. A phrase
is found by intersecting posting lists after subtracting each term's offset in the phrase: first
the lists of its two rarest terms, then, only in documents that survive, the lists of the rest.
Proximity matches, where a window's words stand close together in any order, are found the same way.

Everything is DataFrame operations. The tables made from test texts are broadcast only if a
count proves them small; otherwise Spark shuffles. Spark's estimate does not see how many rows an
explode makes, so the words around places and the windows' words are not left to its choice.

Defined cases: a null text has no words; an item without words is never found; repeated items
with one id count once and an item without an id counts as the empty id; repeated rows have the
same result. Terms of equal rarity go by their place in the window. Long texts are indexed whole. With
either table empty nothing is found. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.llm.common import DOC_KEY, row_key, small
from tremora.session import stored

#: Fixed value: what separates words; everything but digits, a-z and characters beyond ASCII.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST_TERMS, MOST_DOCUMENTS = 2_000_000, 500_000
ANCHORS = 2
MOST_WINDOW = 62


def words_of(text: str) -> Column:
    """Words of a text with A-Z in lower case."""
    lower = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), BETWEEN_WORDS), "")


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """window_id, item and words of every window of ``size`` words; a shorter item is one window."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                         words_of("text").alias("words")).where("size(words) > 0")
    last = F.greatest(F.size("words") - size, F.lit(0))
    starts = F.explode(F.sequence(F.lit(1), last + 1)).alias("start")
    cut = words.select("item", "words", starts)
    cut = cut.select("item", F.expr(f"slice(words, start, {int(size)})").alias("words"))
    return stored(cut.withColumn("window_id", F.monotonically_increasing_id()), "windows")


@dataclass(frozen=True)
class PositionalIndex:
    postings: DataFrame  # DOC_KEY, pos, term_id
    terms: DataFrame  # term, term_id, n (occurrences in all texts)

    @classmethod
    def build(cls, docs: DataFrame, windows: DataFrame) -> PositionalIndex:
        """Index the texts of ``docs`` for the terms of ``windows``."""
        terms = windows.select(F.explode("words").alias("term")).distinct()
        terms = stored(terms.withColumn("term_id", F.monotonically_increasing_id()), "terms")
        tokens = docs.select(row_key("doc_id", "text").alias(DOC_KEY), F.posexplode(words_of("text")))
        found = tokens.join(small(terms, MOST_TERMS), F.col("col") == F.col("term"))
        postings = stored(found.select(DOC_KEY, "pos", "term_id"), "postings")
        counts = postings.groupBy("term_id").agg(F.count("*").alias("n"))
        counted = terms.join(counts, "term_id", "left").fillna(0, ["n"])
        return cls(postings, stored(counted, "term-counts"))

    def _terms_of(self, windows: DataFrame) -> DataFrame:
        """A row for each word of each window that has no term without occurrences."""
        each = windows.select("window_id", F.size("words").alias("n_terms"), F.posexplode("words"))
        each = each.withColumnsRenamed({"pos": "offset", "col": "term"}).join(small(self.terms, MOST_TERMS), "term")
        rank = Window.partitionBy("window_id").orderBy("n", "offset")
        least = F.min("n").over(Window.partitionBy("window_id"))
        ranked = each.withColumn("rank", F.row_number().over(rank)).withColumn("least", least)
        return stored(ranked.where("least > 0").drop("least", "term"), "window-terms")

    def phrases(self, windows: DataFrame) -> DataFrame:
        """DOC_KEY, start, window_id, n_terms of every exact occurrence of a window."""
        terms = self._terms_of(windows)
        anchors = terms.where(F.col("rank") <= ANCHORS)
        bit = F.expr("shiftleft(1L, offset)")
        candidates = stored(
            self.postings.join(small(anchors, MOST_TERMS), "term_id")
            .withColumn("start", F.col("pos") - F.col("offset"))
            .where("start >= 0")
            .groupBy(DOC_KEY, "start", "window_id")
            .agg(F.bit_or(bit).alias("met"), F.max("n_terms").alias("n_terms"))
            .where(F.bit_count("met") == F.least("n_terms", F.lit(ANCHORS)))
            .drop("met", "n_terms"),
            "candidates",
        )
        left = small(candidates.select(DOC_KEY).distinct(), MOST_DOCUMENTS)
        lists = self.postings.join(left, DOC_KEY, "left_semi")
        wanted = candidates.join(small(terms, MOST_TERMS), "window_id").select(
            DOC_KEY, "start", "window_id", "n_terms", "term_id", "offset",
            (F.col("start") + F.col("offset")).alias("pos"),
        )
        return (
            wanted.join(lists, [DOC_KEY, "pos", "term_id"])
            .groupBy(DOC_KEY, "start", "window_id")
            .agg(F.bit_or(bit).alias("met"), F.max("n_terms").alias("n_terms"))
            .where(F.bit_count("met") == F.col("n_terms"))
            .drop("met")
        )

    def proximity(self, windows: DataFrame, slop: int) -> DataFrame:
        """DOC_KEY, pos, window_id where all terms of a window lie within ``slop`` words of an
        occurrence (``pos``) of its rarest term, in any order. A window needs two different terms.

        Rarest terms first: places of a rarest term that have the second rarest in reach are found by
        a walk over both terms' postings in order. Only around these few places the other
        terms are looked up, in the ``2 slop + 1`` postings there.
        """
        ranked = self._terms_of(windows).groupBy("window_id", "term_id").agg(F.min("rank").alias("rank"))
        terms = ranked.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term_id"))).alias("t"))
        terms = terms.where("size(t) > 1").select(
            "window_id", F.col("t")[0]["term_id"].alias("first"), F.col("t")[1]["term_id"].alias("second"),
            F.transform("t", lambda x: x["term_id"]).alias("terms"),
        )
        terms = stored(terms, "window-pairs")
        # Windows of an item overlap, so many have their two rarest terms in common.
        pairs = terms.select("first", "second").distinct()
        roles = pairs.select("first", "second", F.explode(F.array(
            F.struct(F.col("first").alias("term_id"), F.lit(True).alias("anchor")),
            F.struct(F.col("second").alias("term_id"), F.lit(False).alias("anchor")),
        )).alias("r")).select("first", "second", "r.*")
        places = self.postings.join(small(roles, MOST_TERMS), "term_id").drop("term_id")
        along = Window.partitionBy(DOC_KEY, "first", "second")
        other = F.when(~F.col("anchor"), F.col("pos"))
        before = F.max(other).over(along.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
        behind = F.min(other).over(along.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1))
        reach = [F.coalesce(F.col("pos") - F.col("before") <= slop, F.lit(False)),
                 F.coalesce(F.col("behind") - F.col("pos") <= slop, F.lit(False))]
        close = places.withColumns({"before": before, "behind": behind}).where(F.col("anchor") & (reach[0] | reach[1]))
        close = stored(close.select(DOC_KEY, F.col("pos").alias("at"), "first", "second"), "near-pairs")

        spots = close.select(DOC_KEY, "at").distinct()
        left = small(close.select(DOC_KEY).distinct(), MOST_DOCUMENTS)
        lists = self.postings.join(left, DOC_KEY, "left_semi")
        around = spots.select(DOC_KEY, "at", F.explode(F.sequence(F.col("at") - slop, F.col("at") + slop)).alias("pos"))
        # Spark takes the exploded rows for as few as the spots, and would broadcast them.
        met = around.hint("merge").join(lists, [DOC_KEY, "pos"])
        met = met.groupBy(DOC_KEY, "at").agg(F.collect_set("term_id").alias("met"))
        found = close.join(small(terms, MOST_TERMS), ["first", "second"]).join(met, [DOC_KEY, "at"])
        whole = F.size(F.array_except("terms", "met")) == 0
        return found.where(whole).select(DOC_KEY, F.col("at").alias("pos"), "window_id")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, slop: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated and the row's key, for each row.

    A word is hit if it lies in an occurrence of a window of ``size`` words of an item; items
    are the sorted ids of the items with such windows. With ``slop``, n_near is added: the number
    of places around which, within ``slop`` words, all words of a window stand in any order.
    """
    if not 0 < size <= MOST_WINDOW:
        raise ValueError(f"a window has 1 to {MOST_WINDOW} words")
    windows = windows_of(items, size)
    index = PositionalIndex.build(docs, windows)
    found = stored(index.phrases(windows), "occurrences")
    places = found.select(DOC_KEY, F.explode(F.expr("sequence(start, start + n_terms - 1)")).alias("pos"))
    hit = places.distinct().groupBy(DOC_KEY).agg(F.count("*").alias("n_hit"))
    near = None
    if slop is not None:
        near = index.proximity(windows, slop).select(DOC_KEY, "pos").distinct()
        near = near.groupBy(DOC_KEY).agg(F.count("*").alias("n_near"))
    named = found.join(small(windows.select("window_id", "item"), MOST_TERMS), "window_id")
    listed = named.groupBy(DOC_KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    keyed = docs.select(
        "doc_id", row_key("doc_id", "text").alias(DOC_KEY),
        F.size(words_of("text")).cast("bigint").alias("n_words"),
    )
    joined = keyed.join(hit.join(listed, DOC_KEY), DOC_KEY, "left")
    more = []
    if near is not None:
        joined = joined.join(near, DOC_KEY, "left")
        more = [F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near")]
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_found).cast("bigint").alias("n_items"),
        items_found.alias("items"), (n_hit > 0).alias("contaminated"), DOC_KEY, *more,
    )


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` that have no hit, with their columns."""
    hit = contamination(docs, items, size).where("contaminated").select(DOC_KEY).distinct()
    keyed = docs.withColumn(DOC_KEY, row_key("doc_id", "text"))
    return keyed.join(hit, DOC_KEY, "left_anti").drop(DOC_KEY)
