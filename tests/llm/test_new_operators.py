"""Periodic runs, page differencing and hard negatives against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tremora.llm import negatives, pagediff, periodic
from tremora.llm.registry import op11_periodic, op12_pagediff, op13_negatives

# --- periodic runs --------------------------------------------------------------------


def runs_by_definition(words, min_words):
    """All (start, end, period), each lag looked at word by word, smaller lags first."""
    found = {}
    for lag in range(1, len(words) // 2 + 1):
        i = 0
        while i + lag < len(words):
            j = i
            while j + lag < len(words) and words[j] == words[j + lag]:
                j += 1
            if j > i and j + lag - i >= max(min_words, 2 * lag):
                found.setdefault((i, j + lag), lag)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


def make_periodic(random_, words):
    a = random_.randrange(len(words))
    p = 1 + random_.randrange(max(1, (len(words) - a) // 2))
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(len(words))]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_a_block(seed):
    random_ = random.Random(seed)
    for _ in range(120):
        documents = []
        for _ in range(random_.randrange(1, 5)):
            n = random_.choice([0, 1, 12, 40, 160])
            words = [random_.randrange(random_.choice([1, 2, 3, 40])) for _ in range(n)]
            documents.append(make_periodic(random_, words) if n and random_.random() < 0.6 else words)
        least = random_.choice([4, 12, 20])
        sizes = [len(d) for d in documents]
        flat = np.array([w for d in documents for w in d], np.int64)
        found = periodic.find_runs(flat, np.repeat(np.arange(len(sizes)), sizes), least)
        expected, base = [], 0
        for document in documents:
            expected += [(s + base, e + base, q) for s, e, q in runs_by_definition(document, least)]
            base += len(document)
        assert [tuple(r) for r in found.tolist()] == sorted(expected, key=lambda r: (r[0], r[2]))


def test_splitting_only_removes_words_that_are_in_no_run(monkeypatch):
    random_ = random.Random(9)
    words = np.array([random_.randrange(60) for _ in range(300)] + [1, 2, 3, 4] * 6 + list(range(100, 140)) * 3)
    owner = np.zeros(len(words), np.int64)
    segments = periodic.split_segments(words, owner)
    assert segments and sum(e - s for s, e in segments) < len(words)
    for s, e in segments:
        assert min(Counter(words[s:e].tolist()).values()) >= 2
    found = periodic.find_runs(words, owner)
    monkeypatch.setattr(periodic, "MOST_ROUNDS", 0)
    assert periodic.split_segments(words, owner) == [(0, len(words))]
    assert (periodic.find_runs(words, owner) == found).all() and len(found) >= 2


@pytest.mark.parametrize(
    "words,expected",
    [
        (np.zeros(300_000, np.int64), [[0, 300_000, 1]]),
        (np.arange(300_000) % 70_001, [[0, 300_000, 70_001]]),
        (np.tile(np.r_[np.zeros(996, np.int64), 1], 200), None),
    ],
)
def test_long_repetitive_texts(words, expected):
    found = periodic.find_runs(words, np.zeros(len(words), np.int64)).tolist()
    if expected:
        assert found == expected
    else:
        assert [0, len(words), 997] in found and len(found) == 201


def test_periodic_cases(spark):
    twice = "a b c d e f " * 2
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \t\n ", "x"), (4, twice, "x"), (4, twice, "x"), (None, twice, "x"),
        (5, "a b c d e " * 2, "x"), (6, "é " * 12, "x"), (7, "a b " * 12, "x"), (8, "w " * 100_000, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    found = periodic.with_runs(df)
    assert found.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    by_id = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"], r["n_words"]) for r in found.collect()}
    for i in (1, 2, 3):
        assert by_id[i] == ([], "", 0)
    assert by_id[4] == by_id[None] == ([(0, 12, 6)], "a b c d e f", 12)
    assert by_id[5] == ([], " ".join(rows[6][1].split()), 10)
    assert by_id[6] == ([(0, 12, 1)], "é", 12)
    assert by_id[7][0] == [(0, 12, 1)]
    assert by_id[8] == ([(0, 100_000, 1)], "w", 100_000)
    assert found.count() == len(rows)
    assert periodic.digests(periodic.with_runs(df.limit(0))).count() == 0


def test_periodic_query(spark, data_dir):
    documents = spark.read.parquet(f"{data_dir}/documents.parquet").orderBy("doc_id").collect()
    found = {r["doc_id"]: r for r in op11_periodic(spark, data_dir).collect()}
    assert len(found) == len(documents)
    planted = 0
    for row in documents:
        words = (row["text"] or "").encode().split()
        h = zlib.crc32(str(row["doc_id"]).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        if len(words) > 2500:
            continue
        runs = sorted(runs_by_definition(words, 12), key=lambda r: (r[0], r[2]))
        gone = {i for s, e, q in runs for i in range(s + q, e)}
        best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2])) if runs else None
        got = found[row["doc_id"]]
        assert got["n_runs"] == len(runs)
        if best:
            s, e, q = best
            assert tuple(got[2:6]) == (s, e - s, q, 1000 * (e - s) // q)
        else:
            assert tuple(got[2:6]) == (None,) * 4
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
        assert got["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert got["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()
    assert planted > 50


# --- page differencing ----------------------------------------------------------------


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def is_subsequence(part, whole):
    rest = iter(whole)
    return all(x in rest for x in part)


@pytest.mark.parametrize("table", [1, 30, 1 << 22])
def test_longest_common_subsequence(table):
    random_ = random.Random(table)
    for _ in range(400):
        k = random_.choice([2, 5, 40])
        a = np.array([random_.randrange(k) for _ in range(random_.randrange(30))], np.int64)
        b = np.array([random_.randrange(k) for _ in range(random_.randrange(30))], np.int64)
        marks = pagediff.lcs_marks(a, b, table)
        assert marks.sum() == lcs_length(a.tolist(), b.tolist())
        assert is_subsequence(a[marks].tolist(), b.tolist())


def text_of(page):
    return " ".join(line for line, kind in pagediff.blocks(page) if kind != pagediff.DROPPED)


@pytest.mark.parametrize(
    "page,expected",
    [
        ("<p>one<p>two <b>b</b>old<div>three</div>", "one two bold three"),
        ("<article><h1>A &amp; B&nbsp;C</h1>x<br>y<!-- no -->z</article>outside", "A & B C x yz"),
        ("<main class='with-sidebar'><p>t</p><aside>no</aside></main>", "t"),
        ("<article>a<section class='comments'><article>c</article></section>b</article>", "a b"),
        ("<article><header><h1>T</h1></header>x<footer>no</footer></article><header>no</header>", "T x"),
        ("<div class=cookieNotice>no</div><div id=ad-7>no</div><p class='no-ads'>yes<form>no<p>no</form>", "yes"),
        ("<p class=advert>no<div>yes</div>", "yes"),
        ("<script>if (a < b) x = '</p>'</script><style>p{}</style>yes<template>no</template>", "yes"),
        ("<ul><li class=menu>no<li>yes</ul><div hidden>no</div><div style='display: none'>no</div>", "yes"),
        ("<article>cut &am", "cut &am"),
        ("<article>cut<foot", "cut"),
        ("<p title='a > b'>yes</p><p title=\"open>kept</p>", "yes kept"),
        ("</div></p>yes", "yes"),
        ("", ""),
    ],
)
def test_markup(page, expected):
    assert text_of(page) == expected


def test_hostile_markup_takes_linear_time():
    for page in ("<a \"" * 100_000, "<" * 500_000, "<div class=" + "a" * 500_000, "<p " + "x " * 300_000 + "class", "<div>" * 50_000):
        pagediff.blocks(page)


def plain_pages(rows):
    """Text by page_id, for pages without main elements, by the definition."""
    parsed = {}
    for page_id, url, html in rows:
        host, path, query = pagediff.url_parts(url)
        parsed[page_id] = (host, path, query, [line for line, _ in pagediff.blocks(html or "")])
    found = {}
    for page_id, (host, path, _, lines) in parsed.items():
        places = {}
        for other_host, p, q, ls in parsed.values():
            if host is not None and other_host == host and ls:
                places[tuple(ls)] = min(places.get(tuple(ls), (p, q)), (p, q))
        order = sorted(places, key=lambda ls: places[ls])
        shared = []
        if tuple(lines) in places:
            at = order.index(tuple(lines))
            near = [order[i] for i in (at - 1, at + 1) if 0 <= i < len(order)]
            start = lambda ls: len(pagediff.commonprefix([places[ls][0], places[tuple(lines)][0]]))
            if near:
                other = max(near, key=start)  # the first of equals
                code = {x: i for i, x in enumerate({*lines, *other})}
                marks = pagediff.lcs_marks(np.array([code[x] for x in lines]), np.array([code[x] for x in other]))
                shared = marks.tolist()
        found[page_id] = " ".join(x for x, s in zip(lines, shared or [False] * len(lines)) if not s)
    return found


def test_differencing_decides_without_main_elements(spark):
    random_ = random.Random(2)
    rows = []
    for site in ("a.example", "b.example"):
        menu = [f"<li>{site} {k}</li>" for k in range(4)]
        for k in range(60):
            own = "".join(f"<p>{site} page {k} line {i}</p>" for i in range(random_.randrange(1, 4)))
            page = f"<div><ul>{''.join(menu)}</ul>{own}<div>imprint of {site}</div></div>"
            rows.append((len(rows), f"https://{site}/s{k % 7}/{k:03}", page))
    rows += [(1000 + k, f"https://a.example/copy/{k}", rows[5][2]) for k in range(30)]
    rows += [(2000, "https://alone.example/", "<p>all mine</p>"), (2001, None, "<p>no address</p>"), (2002, "x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    found = {r["page_id"]: r for r in pagediff.main_text(df).collect()}
    expected = plain_pages(rows)
    assert {i: r["text"] for i, r in found.items()} == expected
    assert found[0]["text"].startswith("a.example page 0") and "imprint" not in found[0]["text"]
    assert found[0]["n_shared"] == 5 and found[2000]["text"] == "all mine" and found[2002]["text"] == ""
    assert all(found[1000 + k]["text"] == found[5]["text"] for k in range(30))


def test_shared_passages_of_articles_stay(spark):
    page = "<nav>{0} menu</nav><article><p>quoted by both</p><p>own {0}</p></article><p>imprint</p>"
    rows = [(k, f"http://h.example/{k}", page.format(k), "kept") for k in range(4)]
    rows += [rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, `n_shared` string")
    found = pagediff.main_text(df)
    assert found.columns == ["page_id", "url", "text", "n_shared"]
    assert Counter(r["text"] for r in found.collect())["quoted by both own 0"] == 2
    assert {r["n_shared"] for r in found.collect()} == {2}
    assert pagediff.main_text(df.limit(0)).count() == 0


def test_page_query(spark, data_dir):
    import html
    import re

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{data_dir}/pages.parquet").collect()}
    found = op12_pagediff(spark, data_dir).collect()
    assert len(found) == len(pages)
    for row in found:
        article = re.search(r"<article>(.*?)</article>", pages[row["page_id"]]["html"], re.S)[1]
        plain = html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article)))
        assert row["text"] == " ".join(plain.split()) and row["n_chars"] == len(row["text"])


# --- hard negatives -------------------------------------------------------------------


@pytest.mark.parametrize("leaf", [1, 4, 32])
def test_strassen(leaf):
    random_ = np.random.default_rng(leaf)
    for m, k, n in ((1, 1, 1), (2, 3, 4), (33, 65, 50), (64, 64, 64), (0, 4, 5), (7, 0, 3), (70, 35, 9)):
        a, b = random_.integers(-(1 << 27), 1 << 27, (m, k)), random_.integers(-(1 << 27), 1 << 27, (k, n))
        assert (negatives.strassen(a, b, leaf) == a @ b).all()


@pytest.mark.parametrize("spread", [2, 1000])
def test_heaps_merge(spread):
    random_ = np.random.default_rng(spread)
    heaps, all_ = negatives.Heaps(9, 3), [[] for _ in range(9)]
    for _ in range(12):
        rows = np.sort(random_.choice(9, 5, replace=False))
        ids = np.sort(random_.integers(0, 500, 20))
        scores = random_.integers(0, spread, (5, 20))
        scores[random_.random((5, 20)) < 0.3] = negatives.NONE
        heaps.add(rows, scores, ids)
        for i, r in enumerate(rows):
            all_[r] += [(-s, i) for s, i in zip(scores[i].tolist(), ids.tolist()) if s != negatives.NONE]
    for r in range(9):
        kept = heaps.scores[r] != negatives.NONE
        assert list(zip((-heaps.scores[r][kept]).tolist(), heaps.ids[r][kept].tolist())) == sorted(all_[r])[:3]


def negatives_by_definition(rows):
    seen = {}
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        seen.setdefault((vec_id, label, tuple(math.floor(256 * x) for x in vector)), None)
    seen = list(seen)
    found = []
    for a in seen:
        if a[0] % 50:
            continue
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2]))
        ranked = sorted(((-score(r), r[0], r) for r in seen if r != a), key=lambda x: x[:2])
        for p, positive_id, _ in [x for x in ranked if x[2][1] == a[1]][:5]:
            fit = [x for x in ranked if x[2][1] != a[1] and -50 * p <= -100 * x[0] <= -95 * p]
            found += [(a[0], positive_id, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(fit[:3])]
    return Counter(found)


@pytest.mark.parametrize("group_bytes", [1, 200, 1 << 20])
def test_hard_negatives(spark, monkeypatch, group_bytes):
    from pyspark.sql import functions as F

    monkeypatch.setattr(negatives, "GROUP_BYTES", group_bytes)
    random_ = random.Random(4)
    rows = [(k, random_.randrange(3), [random_.gauss(0.05, 0.1) for _ in range(8)]) for k in range(260)]
    rows += [(300 + k, k % 3, rows[0][2]) for k in range(120)]  # one vector many times: ties
    rows += [(1, 2, None), (2, None, rows[2][2]), (400, 1, [float("nan")] * 8), (450, 1, [None] * 8), (None, 1, rows[3][2])]
    rows += [(500, 1, []), (501, 1, [0.2] * 3), rows[50], rows[50], (50, 2, rows[7][2]), (550, 1, [1e300] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("anchor", F.lit("x"))
    found = negatives.hard_negatives(df.repartition(5), F.col("vec_id") % 50 == 0)
    assert Counter(tuple(r) for r in found.collect()) == negatives_by_definition(rows[:-1])
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_negatives_query_has_rows(spark, data_dir):
    assert op13_negatives(spark, data_dir).count() > 0
