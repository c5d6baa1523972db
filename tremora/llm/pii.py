"""Personal data in texts: fixed rules for base spans, weak supervision for further ones.

Base spans (email, ip, card, phone) are what the rules say. Looser patterns give candidates, of
which base spans are some. Five labelers vote on each (for, against, no vote): the strict rule,
a checksum or range, a gazetteer of prefixes and domains, words of context before it, and whether
it stands alone. Votes are counted over all texts by pattern; on these few thousand counts
expectation-maximisation estimates each labeler's reliability and each pattern's probability,
which then train a logistic span classifier on votes and shape. Candidates it accepts, and which
touch no base span, are added with the kinds email_like, ip_like, card_like and phone_like.

The texts are read once, in the tasks; candidates are stored, and only pattern counts reach the
driver.

Defined cases: a null text is empty; without candidates nothing is added; repeated rows have the
same result; an empty table gives an empty table. Where two candidates tie for a place, both are
reported, by start, then kind, then end. Long texts are read whole, in linear time; numbers of an
address may have any count of leading zeros. A spelled-out address ("name (at) host (dot) org") keeps to
mail's own limits: 64 characters before the sign, 63 a label, six labels; base addresses have no
limit. Other columns are kept; spans and candidates replace columns of these names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.llm.common import append_columns
from tremora.session import stored

KINDS = ["email", "ip", "card", "phone"]
ADDED = [f"{k}_like" for k in KINDS]
LABELERS = 5
ACCEPT = 0.9

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPELLED_EMAIL = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}){1,5}"
)
BRACKET_PHONE = re.compile(r"\([0-9]{3}\)[\x20-]?[0-9]{3}[\x20-][0-9]{4}")
CUES = re.compile(
    r"\b(?:(?P<good>e-?mail|mail|contact|phone|tel|call|mobile|fax|card|visa|account|ip|host|address)"
    r"|(?P<bad>version|isbn|issn|page|order|serial|section|chapter|no|nr))\b[^A-Za-z]*$",
    re.IGNORECASE,
)
#: Gazetteer: issuer prefixes of cards, private networks, common endings of mail domains.
CARD_PREFIXES = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
NETWORKS = ("10.", "127.", "172.16.", "192.168.")
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and dotted domain. Each @ is looked at once, so long runs of
    letters cost no more than others."""
    free, at = 0, text.find("@")
    while at >= 0:
        following = at + 1
        local = LOCAL_BACK.match(text[free:at][::-1])
        if local and (domain := DOMAIN.match(text, at + 1)):
            yield at - local.end(), domain.end()
            following = domain.end()
        free = following
        at = text.find("@", following)


def quadruples(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Four numbers joined by dots, leftmost first."""
    for chain in DOTTED.finditer(text):
        if chain.group().count(".") < 3:
            continue
        at, numbers = chain.start(), chain.group().split(".")
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i : i + 4]
            end = at + sum(map(len, four)) + 3
            yield at, end, four
            at = end + 1


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, bool]]]:
    """Base spans (start, kind, end), and candidates (start, kind, end, whether base)."""
    base, loose = [], []

    def add(start: int, kind: int, end: int, good: bool) -> None:
        if good:
            base.append((start, kind, end))
        loose.append((start, kind, end, good))

    if "@" in text:
        for start, end in emails(text):
            add(start, 0, end, True)
    if "at)" in text or "at]" in text:
        loose += [(m.start(), 0, m.end(), False) for m in SPELLED_EMAIL.finditer(text)]
    for start, end, numbers in quadruples(text):
        add(start, 1, end, all(len(n.lstrip("0")) <= 3 and int(n.lstrip("0") or 0) <= 255 for n in numbers))
    for m in DIGITS.finditer(text):
        if m.end() - m.start() < 10:
            continue
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19:
            add(m.start(), 2, m.end(), len(digits) >= 14 and luhn(digits))
        elif 10 <= len(digits) <= 12 and len(digits) < m.end() - m.start():
            loose.append((m.start(), 3, m.end(), False))
    if "+" in text:
        for m in PHONE.finditer(text):
            add(m.start(), 3, m.end(), 10 <= sum(c.isdigit() for c in m.group()) <= 15)
    if "(" in text:
        loose += [(m.start(), 3, m.end(), False) for m in BRACKET_PHONE.finditer(text)]
    return sorted(base), loose


def votes(text: str, start: int, kind: int, end: int, good: bool) -> tuple[list[int], list[int]]:
    """The labelers' votes (1, 0, -1) on a candidate, and two features of its shape."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    if kind == 0:
        check = 1 if re.search(r"[A-Za-z]{2,}$", span) else -1
        listed = 1 if span.rsplit(".", 1)[-1].lower() in DOMAINS else 0
    elif kind == 1:
        check = 1 if good else -1
        listed = 1 if span.startswith(NETWORKS) else 0
    elif kind == 2:
        check = 1 if luhn(digits) else -1
        listed = 1 if digits.startswith(CARD_PREFIXES) else -1
    else:
        check = 1 if 10 <= len(digits) <= 15 else -1
        listed = -1 if len(set(digits)) < 3 else 0
    cue = CUES.search(text[max(0, start - 40) : start])
    context = 0 if not cue else 1 if cue.group("good") else -1
    alone = not (text[max(0, start - 1) : start] + text[end : end + 1]).strip(" \n\t.,;:!?()<>\"'")
    shape = [min(len(digits) // 3, 7), int(len(digits) < len(span))]
    return [1 if good else -1, check, listed, context, 1 if alone else -1], shape


def pack(kind: int, given: list[int], shape: list[int]) -> int:
    code = 0
    for v in given:
        code = code * 3 + v + 1
    return ((code * 8 + shape[0]) * 2 + shape[1]) * 4 + kind


def unpack(code: int) -> tuple[int, list[int], list[int]]:
    kind, code = code % 4, code // 4
    shape = [code // 2 % 8, code % 2]
    code, given = code // 16, []
    for _ in range(LABELERS):
        given.insert(0, code % 3 - 1)
        code //= 3
    return kind, given, shape


# --- label model ------------------------------------------------------------------------


def reliabilities(given: np.ndarray, counts: np.ndarray, rounds: int = 30):
    """Expectation-maximisation over vote patterns: probability of each vote given the truth
    (labeler x truth x vote), and of each pattern being real."""
    start = np.array([[0.6, 0.25, 0.15], [0.15, 0.25, 0.6]])  # votes -1, 0, 1 if false, if real
    table = np.repeat(start[None], given.shape[1], axis=0)
    prior = 0.5
    for _ in range(rounds):
        weight = np.log([1 - prior, prior])[None].repeat(len(given), axis=0)
        for labeler in range(given.shape[1]):
            weight = weight + np.log(table[labeler][:, given[:, labeler] + 1]).T
        real = 1 / (1 + np.exp(np.clip(weight[:, 0] - weight[:, 1], -60, 60)))
        prior = float(np.clip((counts * real).sum() / counts.sum(), 0.01, 0.99))
        for labeler in range(given.shape[1]):
            for vote in range(3):
                chosen = given[:, labeler] + 1 == vote
                for truth, p in enumerate((1 - real, real)):
                    # The start counts as ten candidates, so that no estimate becomes certain.
                    seen = (counts * p)[chosen].sum() + 10 * start[truth, vote]
                    table[labeler, truth, vote] = seen / ((counts * p).sum() + 10)
    return table, real


def _features(patterns: list[tuple[int, list[int], list[int]]]) -> np.ndarray:
    rows = np.zeros((len(patterns), 1 + 3 * LABELERS + 8 + 2))
    for row, (_, given, shape) in zip(rows, patterns):
        row[0] = 1
        for i, v in enumerate(given):
            row[1 + 3 * i + v + 1] = 1
        row[1 + 3 * LABELERS + shape[0]] = 1
        row[1 + 3 * LABELERS + 8 + shape[1]] = 1
    return rows


def accepted_codes(counts: dict[int, int]) -> list[int]:
    """Codes of candidates that the span classifier takes for real, kind by kind."""
    accepted = []
    for kind in range(len(KINDS)):
        codes = sorted(c for c in counts if c % 4 == kind)
        if not codes:
            continue
        patterns = [unpack(c) for c in codes]
        seen = np.array([counts[c] for c in codes], float)
        _, real = reliabilities(np.array([p[1] for p in patterns]), seen)
        x, weights = _features(patterns), np.zeros(1 + 3 * LABELERS + 10)
        share = seen / seen.sum()
        for _ in range(50):  # Newton steps on the penalised logistic loss
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            gradient = x.T @ (share * (p - real)) + 1e-3 * weights
            curve = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(weights))
            weights -= np.linalg.solve(curve, gradient)
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        accepted += [c for c, value in zip(codes, p) if value >= ACCEPT]
    return accepted


# --- operator ---------------------------------------------------------------------------

SPAN = T.StructType([
    T.StructField("start", T.LongType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("end", T.LongType()),
])
CANDIDATE = T.StructType([
    *SPAN.fields,
    T.StructField("code", T.IntegerType()),
    T.StructField("free", T.BooleanType()),
])


def with_candidates(docs: DataFrame) -> DataFrame:
    """Add spans (base) and candidates; text is left out."""
    fields = [T.StructField("spans", T.ArrayType(SPAN)), T.StructField("candidates", T.ArrayType(CANDIDATE))]

    def start():
        span = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())])
        candidate = pa.struct([*span, ("code", pa.int32()), ("free", pa.bool_())])

        def work(batch: pa.RecordBatch):
            spans, found = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base, loose = scan(text)
                spans.append([{"start": s, "rank": k, "end": e} for s, k, e in base])
                own, taken = [], _Taken(base)
                for s, k, e, good in loose:
                    own.append({
                        "start": s, "rank": k, "end": e, "code": pack(k, *votes(text, s, k, e, good)),
                        "free": not taken.meets(s, e),
                    })
                found.append(own)
            return {"spans": pa.array(spans, pa.list_(span)), "candidates": pa.array(found, pa.list_(candidate))}

        return work

    return append_columns(docs, start, fields, drop=["text"])


class _Taken:
    """Whether a span meets one of many others."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts = np.array([s for s, _, _ in spans])
        self.ends = np.maximum.accumulate(np.array([e for _, _, e in spans])) if spans else np.zeros(0)

    def meets(self, start: int, end: int) -> bool:
        before = np.searchsorted(self.starts, end)
        return bool(before and self.ends[before - 1] > start)


def with_personal_data(docs: DataFrame) -> DataFrame:
    """spans (kind, start, end, base) by start, then kind, and all columns but text."""
    found = stored(with_candidates(docs), "pii-candidates")
    counts = found.select(F.explode("candidates.code").alias("code")).groupBy("code").count().collect()
    codes = accepted_codes({r["code"]: r["count"] for r in counts})
    more = F.filter("candidates", lambda c: c["free"] & c["code"].isin(codes))
    rank = lambda c: (c["rank"] + len(KINDS)).cast("int").alias("rank")
    plain = F.transform(
        more, lambda c: F.struct(c["start"].alias("start"), rank(c), c["end"].alias("end"))
    )
    names = F.array(*map(F.lit, [*KINDS, *ADDED]))
    spans = F.transform(
        F.array_sort(F.concat("spans", plain)),
        lambda s: F.struct(
            F.get(names, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            (s["rank"] < len(KINDS)).alias("base"),
        ),
    )
    return found.withColumn("spans", spans).drop("candidates")
