"""Chat formatting with Spark expressions only.

A conversation's rows are collected as structs, sorted, and merged: adjacent ones of the same role
become one turn that holds the array of their texts, cut out of the sorted array. The turns are then
joined to one string, with a mark between merged texts that keeps the rows apart, so the string can be
read back:

    <|turn|>role<|text|>first text<|more|>second text<|end|><|turn|>...

Control strings inside roles and texts are made harmless: % becomes %25, and the first character
of a control string becomes its code after a %. The way back is the same in reverse order.
Texts of the trained role are under the loss mask, marks are not.

Defined cases: null texts and roles are empty; rows are in order of turn, then role, then text,
nulls first; equal rows all count, in any order, as they are alike; rows without conv_id are one
conversation. Further columns are ignored, whatever their names. An empty table gives an empty result.
Long texts and conversations of any number of rows are formatted whole: a conversation is one row of
the result, so its rows meet in one task, but array steps take time in proportion to their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>"
#: Control strings of this template (all begin with the first one) and of others in use.
CONTROL = ["<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
CODES = {"<": "%3C", "[": "%5B"}
BLOCK = 256


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("%"), F.lit("%25"))
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(CODES[control[0]] + control[1:]))
    return text


def unescape(text: Column) -> Column:
    for plain, code in CODES.items():
        text = F.replace(text, F.lit(code), F.lit(plain))
    return F.replace(text, F.lit("%25"), F.lit("%"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merged_turns(rows: Column) -> Column:
    """Turns of an array of rows (turn, role, text, ...): role and texts of adjacent rows of a role."""

    def of_sorted(turns: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"])
        heads = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), first)

        def cut(starts: Column) -> Column:
            def turn(start: Column, k: Column) -> Column:
                stop = F.coalesce(F.get(starts, k + 1), F.size(turns))
                same = F.slice(turns, start + 1, stop - start)
                return F.struct(
                    F.get(turns, start)["role"].alias("role"),
                    F.transform(same, lambda row: row["text"]).alias("texts"),
                )

            return F.transform(starts, turn)

        return let(heads, cut)

    return let(F.array_sort(rows), of_sorted)


def running_sums(values: Column) -> Column:
    """Sum up to each element. Sums of blocks first, so that no long array is built step by step."""
    zero = F.array(F.lit(0).cast("bigint"))
    append = lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))

    def of_values(each: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(each) - 1, F.lit(0)), F.lit(BLOCK)),
            lambda start: F.slice(each, start + 1, F.lit(BLOCK)),
        )
        total = lambda block: F.aggregate(block, F.lit(0).cast("bigint"), lambda sum_, x: sum_ + x)

        def of_blocks(parts: Column) -> Column:
            bases = F.aggregate(F.transform(parts, total), zero, append)
            within = F.zip_with(
                parts, bases, lambda part, base: F.when(part.isNotNull(), F.aggregate(part, F.array(base), append))
            )
            sums = F.transform(F.filter(within, lambda x: x.isNotNull()), lambda x: F.slice(x, 2, F.lit(BLOCK)))
            return F.flatten(sums)

        return let(blocks, of_blocks)

    return let(values, of_values)


def format_conversations(rows: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, and loss_spans: start and end (exclusive) in code points of each text
    under the loss mask."""
    turns = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    collected = turns.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("rows"))

    def pieces_of(turn: Column, k: Column) -> Column:
        head = F.concat(F.when(k > 0, F.lit(END)).otherwise(F.lit("")), F.lit(TURN), escape(turn["role"]), F.lit(TEXT))

        def piece(text: Column, j: Column) -> Column:
            return F.struct(
                F.when(j == 0, head).otherwise(F.lit(MORE)).alias("mark"),
                escape(text).alias("body"),
                (turn["role"] == trained).alias("loss"),
            )

        return F.transform(turn["texts"], piece)

    def whole(pieces: Column) -> Column:
        size = lambda p: (F.length(p["mark"]) + F.length(p["body"])).cast("bigint")
        span = lambda p, end: F.struct(
            p["loss"].alias("loss"), (end - F.length(p["body"])).alias("start"), end.alias("end")
        )
        spans = F.filter(F.zip_with(pieces, running_sums(F.transform(pieces, size)), span), lambda s: s["loss"])
        text = F.array_join(F.transform(pieces, lambda p: F.concat(p["mark"], p["body"])), "")
        return F.struct(
            F.concat(text, F.lit(END)).alias("formatted"),
            F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss_spans"),
        )

    pieces = F.flatten(F.transform(merged_turns(F.col("rows")), pieces_of))
    return collected.select("conv_id", let(pieces, whole).alias("f")).select("conv_id", "f.formatted", "f.loss_spans")


def read_back(formatted: Column) -> Column:
    """Array of role and text of every row of a formatted conversation."""
    after_first = F.substring(formatted, F.lit(len(TURN) + 1), F.length(formatted))
    turns = F.split(after_first, _literal(TURN))

    def rows_of(turn: Column) -> Column:
        parts = F.split(turn, _literal(TEXT))
        body = F.get(parts, F.lit(1))
        body = F.substring(body, F.lit(1), F.length(body) - len(END))
        role = unescape(F.get(parts, F.lit(0)))
        return F.transform(
            F.split(body, _literal(MORE)), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))
        )

    return F.flatten(F.transform(turns, rows_of))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, in order."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), ""
    )


def _literal(text: str) -> str:
    return f"\\Q{text}\\E"


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what is read back from the formatted conversations."""
    read = formatted.withColumns({
        "rows": read_back(F.col("formatted")),
        "loss": loss_text(F.col("formatted"), F.col("loss_spans")),
    })
    lines = F.transform("rows", lambda r: F.concat(r["role"], F.lit("\n"), r["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("rows").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
