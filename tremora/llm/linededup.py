"""Line deduplication: a suffix array over line ids finds repeated runs of lines.

Texts are sequences of line ids. Only lines that occur more than once can be part of a repeated
run, so the sequences are cut at all others. Distributed prefix doubling ranks the suffixes of
what is left: ranks of 2^k lines, paired with the ranks 2^k lines further on, give the order of
2^(k+1) lines; suffixes whose prefix is unique drop out. A rank is a label in sorted order,
given to each distinct pair after a range partition, so a very frequent line costs one row.

A run counts if it has ``min_words`` words. Doubling stops when the ranks tell apart all runs of
that many words: the suffixes that agree on them are an interval of the array with a common
prefix of at least that length. Of each interval the first member (by doc_id, row key and
line) stays; the lines of the prefix are deleted at all others. Prefixes are taken from every
line on and up to every line, the shortest that have enough words, which together cover each
maximal repeated run: a line goes if and only if it lies in a run of at least ``min_words``
words that also begins at an earlier place.

Everything is DataFrame operations. Classes are aggregated and stored before they are joined
back, so adaptive execution splits the rows of a frequent run.

Defined cases: a null text is one empty line and stays null; a text whose lines all go becomes
the empty text; rows equal in doc_id and text are one document; ids that are missing come first.
Other columns are kept; n_lines and n_removed replace columns of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremora.llm.common import DOC_KEY, row_key
from tremora.session import stored

MIN_WORDS = 10
SPACE = r"[\x09-\x0D\x20]+"


def _ranked(pairs: DataFrame, *keys: str) -> DataFrame:
    """The distinct repeated keys with labels ``rank`` that follow their order."""
    repeated = pairs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    ordered = repeated.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(ordered.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, key, i, words, rank and segment of every line that occurs more than once.

    Rows of one segment are neighbours in their text.
    """
    lines = docs.select(
        "doc_id", row_key("doc_id", "text").alias(DOC_KEY),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"),
    )
    lines = lines.select(
        "doc_id", DOC_KEY, "i", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"),
        F.size(F.array_remove(F.split("line", SPACE), "")).alias("words"),
    )
    lines = stored(lines, "lines")
    again = lines.join(_ranked(lines, "h1", "h2"), ["h1", "h2"]).drop("h1", "h2")
    place = Window.partitionBy(DOC_KEY).orderBy("i")
    again = again.dropDuplicates([DOC_KEY, "i"])
    return stored(again.withColumn("segment", F.col("i") - F.row_number().over(place)), "repeated")


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """doc_id, key, start and size of the shortest runs with ``min_words`` words that begin or
    that end at each line, inside its segment.

    The other end is looked up among running word counts: counts and wanted counts are sorted
    together, and each wanted one takes the last count before it.
    """
    keys = ["doc_id", DOC_KEY, "segment"]
    single = lines.where(F.col("words") >= min_words)
    single = single.select("doc_id", DOC_KEY, F.col("i").alias("start"), F.lit(1).alias("size"))
    whole = Window.partitionBy(DOC_KEY, "segment")
    rest = lines.withColumns({"total": F.sum("words").over(whole), "shortest": F.min("words").over(whole)})
    rest = rest.where((F.col("total") >= min_words) & (F.col("shortest") < min_words))
    rest = rest.withColumn("upto", F.sum("words").over(whole.orderBy("i")))
    before = F.col("upto") - F.col("words")

    def ends(count, wanted, down: bool) -> DataFrame:
        points = rest.select(*keys, "i", "words", F.explode(F.array(
            F.struct(count.alias("value"), F.col("i").alias("at")),
            F.struct(wanted.alias("value"), F.lit(None).cast("int").alias("at")),
        )).alias("p")).select(*keys, "i", "words", "p.*")
        query = F.col("at").isNull()
        order = [F.desc("value"), query, F.desc("at")] if down else [F.asc("value"), query, F.asc("at")]
        seen = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        points = points.withColumn("other", F.last("at", ignorenulls=True).over(seen))
        return points.where(query & F.col("other").isNotNull() & (F.col("words") < min_words))

    forward = ends(F.col("upto"), before + min_words, down=True)
    backward = ends(before, F.col("upto") - min_words, down=False)
    found = forward.selectExpr("doc_id", DOC_KEY, "i AS start", "other - i + 1 AS size").union(
        backward.selectExpr("doc_id", DOC_KEY, "other AS start", "i - other + 1 AS size")
    )
    return stored(single.union(found.distinct()), "runs")


def suffix_ranks(lines: DataFrame, longest: int) -> list[DataFrame]:
    """For k = 0, 1, ... while 2^k <= ``longest``: key, segment, i and the rank of the 2^k lines
    from i on, where those are repeated."""
    levels = [lines.select(DOC_KEY, "segment", "i", "rank")]
    step = 1
    while step * 2 <= longest:
        ahead = Window.partitionBy(DOC_KEY, "segment").orderBy("i").rangeBetween(step, step)
        pairs = levels[-1].withColumn("next", F.max("rank").over(ahead)).where("next IS NOT NULL")
        pairs = stored(pairs.withColumnRenamed("rank", "first"), "suffix-pairs")
        joined = pairs.join(_ranked(pairs, "first", "next"), ["first", "next"])
        levels.append(stored(joined.select(DOC_KEY, "segment", "i", "rank"), "suffix-ranks"))
        step *= 2
    return levels


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, key, start and size of the runs that have an earlier copy."""
    if min_words < 1:
        raise ValueError("a run has at least one word")
    lines = repeated_lines(docs)
    runs = shortest_runs(lines, min_words)
    longest = runs.agg(F.max("size")).first()[0] or 1
    found = None
    for k, level in enumerate(suffix_ranks(lines, longest)):
        # Two windows of 2^k lines, the first and the last, tell runs of that size apart.
        own = runs.where(f"size >= {1 << k} AND size < {2 << k}")
        own = own.withColumn("tail", F.expr(f"start + size - {1 << k}"))
        ranks = level.select(DOC_KEY, F.col("i").alias("start"), F.col("rank").alias("head_rank"))
        own = own.join(ranks, [DOC_KEY, "start"])
        if k:
            tails = level.select(DOC_KEY, F.col("i").alias("tail"), F.col("rank").alias("tail_rank"))
            own = own.join(tails, [DOC_KEY, "tail"])
        else:
            own = own.withColumn("tail_rank", F.col("head_rank"))
        own = own.select("doc_id", DOC_KEY, "start", "size", "head_rank", "tail_rank")
        found = own if found is None else found.union(own)
    found = stored(found, "intervals")
    interval = ["size", "head_rank", "tail_rank"]
    place = F.struct("doc_id", DOC_KEY, "start")
    firsts = found.groupBy(*interval).agg(F.min(place).alias("first"), F.count("*").alias("n"))
    firsts = stored(firsts.where("n > 1").drop("n"), "first-copies")
    return found.join(firsts, interval).where(place > F.col("first")).select("doc_id", DOC_KEY, "start", "size")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies cut out of text, and n_lines, n_removed."""
    copies = later_copies(docs, min_words)
    gone = copies.select(DOC_KEY, F.explode(F.expr("sequence(start, start + size - 1)")).alias("i"))
    gone = gone.groupBy(DOC_KEY).agg(F.collect_set("i").alias("__gone"))
    keyed = docs.drop("n_lines", "n_removed").withColumn(DOC_KEY, row_key("doc_id", "text"))
    joined = keyed.join(gone, DOC_KEY, "left").withColumn("__lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    rest = F.array_except(F.expr("sequence(0, size(__lines) - 1)"), F.col("__gone"))
    text = F.array_join(F.transform(rest, lambda i: F.get("__lines", i)), "\n")
    return joined.withColumns({
        "text": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(text),
        "n_lines": F.size("__lines").cast("bigint"),
        "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint"),
    }).select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
