"""Secret scans: credentials in texts, and weak candidates that complementary parts confirm.

Kinds that count by themselves (base): assign (a named secret is assigned a value), access (an
access identifier) and hex (a long hexadecimal string). Weak kinds: login (a named identifier is
assigned a value), key (a bare 40-character key) and endpoint (an address of a service). A weak
part is reported only if what completes it lies in its scope, within ``REACH`` code points:

    key       an access or a login
    login     an assign, a hex or a key
    endpoint  an access or a login, and an assign, a hex or a key

A weak part's scope is the stretch from ``REACH`` before it to ``REACH`` behind it. Scopes and the
parts that complete them are interval-joined, within a text by blocks of ``REACH`` code points: two
stretches meet where one of them begins within the other, so each pair is found once, in the block of
that beginning. Every pair is a link (part, complement, distance). Parts of one kind do not overlap and
have a least length, so a scope meets few of them, or as many as its own length holds: links grow
with the text, not with the square of its parts.

Matches are leftmost and do not overlap within a kind; those too short are dropped without
another try. A match's place is the length of the text's gaps and matches before it. All this is
DataFrame operations; only found parts are shuffled.

Defined cases: a null text is empty; rows equal in doc_id and text have the same result; a part
of one kind may overlap parts of others (distance 0), and ties in the order of spans go by kind as
listed. An empty table gives an empty table. Long texts are read whole; their parts lie in blocks, so no
task holds a text's pairs. Other columns are kept; spans and links replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.llm.common import DOC_KEY, row_key
from tremora.session import stored

REACH = 200
#: kind: pattern, the group that is measured, its least length. Base kinds come first.
KINDS = {
    "assign": (
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    # A run of at least 24 is what is left of all runs once the short ones are dropped.
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "login": (
        r"""\b(?i:client_id|access_key_id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", 1, 3,
    ),
    "key": (r"(?<![A-Za-z0-9+/=])(?![0-9a-f]{40})[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, 40),
    "endpoint": (r"""\b(?i:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s"'<>]+""", 0, 8),
}
BASE = ("assign", "access", "hex")
IDENTIFIERS, SECRETS = ("access", "login"), ("assign", "hex", "key")
#: What completes a weak part; an endpoint takes one of either sort, the others any.
COMPLEMENTS = {"key": IDENTIFIERS, "login": SECRETS, "endpoint": (*IDENTIFIERS, *SECRETS)}


def found_parts(docs: DataFrame) -> DataFrame:
    """key, kind, start and end of all matches that are long enough."""
    text = F.coalesce("text", F.lit(""))
    scanned = docs.select(row_key("doc_id", "text").alias(DOC_KEY), text.alias("text"))
    scanned = scanned.withColumns({
        kind: F.regexp_extract_all("text", F.lit(pattern), F.lit(0)) for kind, (pattern, _, _) in KINDS.items()
    })
    some = F.lit(False)
    for kind in KINDS:
        some = some | (F.size(kind) > 0)
    pieces = [
        F.when(F.size(kind) > 0, F.struct(
            F.lit(kind).alias("kind"),
            F.arrays_zip(F.col(kind).alias("match"), F.split("text", pattern).alias("gap")).alias("all"),
        ))
        for kind, (pattern, _, _) in KINDS.items()
    ]
    by_kind = scanned.where(some).select(DOC_KEY, F.explode(F.array_compact(F.array(*pieces))).alias("k"))
    each = by_kind.select(DOC_KEY, "k.kind", F.posexplode("k.all").alias("n", "m"))
    each = each.where("m.match IS NOT NULL").select(DOC_KEY, "kind", "n", "m.match", F.length("m.gap").alias("gap"))
    each = each.dropDuplicates([DOC_KEY, "kind", "n"])
    upto = Window.partitionBy(DOC_KEY, "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(upto)
    enough = F.lit(False)
    for kind, (pattern, group, least) in KINDS.items():
        measured = F.regexp_extract("match", pattern, group) if group else F.col("match")
        enough = F.when(F.col("kind") == kind, F.length(measured) >= least).otherwise(enough)
    start = end - F.length("match")
    placed = each.select(DOC_KEY, "kind", start.alias("start"), end.alias("end"), enough.alias("enough"))
    return placed.where("enough").drop("enough")


def scope_links(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Each weak part with each part in its scope that helps to complete it, and their distance."""
    helps = F.create_map(*[x for kind, kinds in COMPLEMENTS.items() for x in (F.lit(kind), F.array(*map(F.lit, kinds)))])
    weak = parts.where(F.col("kind").isin(*COMPLEMENTS)).withColumns(
        {"lo": F.col("start") - reach, "hi": F.col("end") + reach}
    )
    other = parts.where(F.col("kind").isin(*IDENTIFIERS, *SECRETS)).selectExpr(
        DOC_KEY, "kind AS with_kind", "start AS with_start", "end AS with_end"
    )

    def blocks(lo: str, hi: str):
        return F.explode(F.sequence(F.floor(F.col(lo) / reach), F.floor(F.col(hi) / reach)))

    def block(at: str):
        return F.floor(F.col(at) / reach)

    on = [DOC_KEY, "block"]
    begins_inside = weak.withColumn("block", blocks("lo", "hi")).join(other.withColumn("block", block("with_start")), on)
    begins_before = weak.withColumn("block", block("lo")).join(
        other.withColumn("block", blocks("with_start", "with_end")), on
    )
    pairs = begins_inside.where("with_start BETWEEN lo AND hi").unionByName(
        begins_before.where("with_start < lo AND with_end >= lo")
    )
    fits = F.array_contains(F.element_at(helps, F.col("kind")), F.col("with_kind"))
    apart = F.greatest(F.col("with_start") - F.col("end"), F.col("start") - F.col("with_end"), F.lit(0))
    return pairs.where(fits).select(
        DOC_KEY, "kind", "start", "end", "with_kind", "with_start", "with_end", apart.alias("distance")
    )


def linked_parts(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The base parts, and the weak ones whose complements are in their scopes."""
    place = [DOC_KEY, "kind", "start", "end"]
    seen = links.groupBy(*place).agg(
        F.bool_or(F.col("with_kind").isin(*IDENTIFIERS)).alias("identified"),
        F.bool_or(F.col("with_kind").isin(*SECRETS)).alias("secret"),
    )
    complete = (F.col("kind") != "endpoint") | (F.col("identified") & F.col("secret"))
    return parts.where(F.col("kind").isin(*BASE)).union(seen.where(complete).select(place))


def with_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Add spans: kind, start and end (exclusive, in code points), by start, then kind as listed;
    and links of the reported weak parts: kind, start, with_kind, with_start, distance."""
    kinds = list(KINDS)
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    parts = stored(found_parts(docs), "secret-parts")  # few, and read several times
    links = stored(scope_links(parts, reach), "secret-links")
    reported = linked_parts(parts, links)
    spans = reported.groupBy(DOC_KEY).agg(
        F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("found")
    )
    listed = F.transform(
        "found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )
    linked = links.join(reported.where(~F.col("kind").isin(*BASE)), [DOC_KEY, "kind", "start", "end"], "left_semi")
    linked = linked.groupBy(DOC_KEY).agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "with_start", "with_kind", "distance"))).alias("links")
    )
    spans = spans.join(linked, DOC_KEY, "left").select(F.col(DOC_KEY).alias("__key"), listed.alias("spans"), "links")
    keyed = docs.drop("spans", "links").withColumn(DOC_KEY, row_key("doc_id", "text"))
    joined = keyed.join(spans, F.col(DOC_KEY) == F.col("__key"), "left")
    return joined.withColumns({c: _or_empty(c, spans) for c in ("spans", "links")}).drop(DOC_KEY, "__key")


def _or_empty(column: str, like: DataFrame) -> Column:
    return F.coalesce(column, F.array().cast(like.schema[column].dataType))
