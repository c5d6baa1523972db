"""Near-duplicates, decontamination, line dedup and the pipeline against plain Python."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import pytest
from brute import contamination, dedup_lines, near_duplicates
from pyspark.sql import functions as F

import corpus_pipeline
from tremora.llm import bpe, decontaminate, graph, linededup, neardup
from tremora.llm.registry import tokenizer_path

TEXT = "doc_id long, text string"


@pytest.fixture(scope="module")
def documents(spark, data_dir):
    rows = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    return [tuple(r) for r in rows.orderBy("doc_id").limit(250).collect()]


def as_counter(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def copies(documents):
    random_ = random.Random(3)
    rows, base = list(documents), documents[0][1].split(" ")
    for k in range(40):  # a chain of edits, and copies ever further from the base
        words = list(base)
        for _ in range(k // 4):
            words[random_.randrange(len(words))] = f"x{random_.randrange(99)}"
        rows.append((100_000 + k, " ".join(words)))
    rows += [(100_100 + k, documents[5][1]) for k in range(30)]
    rows += [(200_000, None), (200_001, ""), (200_002, "a b"), (200_003, "A\tB"), (200_004, "  ")]
    rows += [(None, documents[5][1]), (None, "only null"), (7, "same id, other text"), (7, "same id, other text")]
    return rows


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, copies, width, percent):
    df = spark.createDataFrame(copies, TEXT).repartition(5)
    found = neardup.near_duplicates(df, width, percent).drop("__doc")
    assert as_counter(found) == Counter(near_duplicates(copies, width, percent))


def test_one_id_with_many_texts(spark):
    """A third of the rows under one id, all different: no class meets all others of its id."""
    words = [f"w{i}" for i in range(400)]
    random_ = random.Random(6)
    rows = [(7, " ".join(random_.choices(words, k=30))) for _ in range(120)]
    rows += [(100 + k, " ".join(random_.choices(words, k=30))) for k in range(120)]
    rows += [(300 + k, rows[k][1]) for k in range(0, 60, 3)] + [(7, rows[200][1]), (None, rows[1][1])]
    found = neardup.near_duplicates(spark.createDataFrame(rows, TEXT), 3, 85).drop("__doc")
    assert as_counter(found) == Counter(near_duplicates(rows, 3, 85))


def test_keep_one_keeps_columns_and_rows(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, "z"), (1, "a b c d e f", "x")]
    df = spark.createDataFrame(rows, TEXT + ", component_id string")
    assert as_counter(neardup.keep_one(df)) == Counter([rows[0], rows[2], rows[3]])
    assert neardup.keep_one(df.limit(0)).count() == 0


def test_keep_one_keeps_one_document_of_each_group(spark):
    one, other, third = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(None, one), (None, one.upper()), (None, other), (None, near), (None, near + " x"), (None, ""), (None, None)]
    rows += [(7, third), (7, third.upper()), (None, third), (9, third)]
    found = neardup.keep_one(spark.createDataFrame(rows, TEXT)).collect()
    kept = Counter((r.doc_id, " ".join((r.text or "").lower().split())) for r in found)
    assert kept[(None, one)] == kept[(None, other)] == kept[(7, third)] == 1
    assert kept[(None, near)] + kept[(None, near + " x")] == 1 and kept[(None, "")] == 2
    assert sum(kept.values()) == 6


def test_sketches_estimate_similarity():
    import numpy as np

    random_ = np.random.default_rng(1)
    sketcher = neardup.Sketcher(7)
    pool = random_.integers(0, 1 << 63, 2000).astype(np.uint64)
    for share in (0.95, 0.85, 0.5):
        a, b = pool[:1000], pool[int(1000 * (1 - share) / (1 + share)) :][:1000]
        differ = np.bitwise_count(sketcher.sketch(a)[1] ^ sketcher.sketch(b)[1]).sum()
        changed = -neardup.BITS / 2 * np.log(1 - 2 * differ / neardup.BITS)
        assert abs(1 - changed / (2 * sketcher.samples) - share) < 0.1


def test_bands_miss_nearly_nothing():
    for similarity in (0.5, 0.8, 0.85, 0.95):
        rows = neardup.band_rows(similarity)
        assert (1 - similarity**rows) ** neardup.BANDS <= neardup.MISS


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r.node: r.root for r in found}
    assert len(found) == len(roots) and {roots[i] for i in range(61)} == {0}
    assert {roots[i] for i in range(100, 140)} == {100} and roots[201] == 200 == roots[200]
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark, documents, data_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    items += [(900, "the"), (901, ""), (902, None), (None, "of the and"), (items[0][0], items[1][1])]
    rows = [*documents, (None, items[3][1]), (-1, "x " + items[4][1].upper()), (-2, None), (-3, items[2][1]), (-3, items[2][1])]
    found = decontaminate.contamination(
        spark.createDataFrame(rows, TEXT).repartition(5), spark.createDataFrame(items, "item_id long, text string")
    )
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect())
    assert got == Counter(contamination(rows, items, 10))


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], TEXT), spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.contamination(docs, items).collect()] == [0]
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    extra = docs.withColumns({"n_hit": F.lit("mine"), "items": F.lit(1)})
    assert decontaminate.without_contaminated(extra, items).columns == extra.columns


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "b x a y y y y y c"), (2, "a x b c"), (3, "c a")], TEXT)
    windows = decontaminate.windows_of(spark.createDataFrame([(1, "a b c")], "item_id long, text string"), 10)
    index = decontaminate.PositionalIndex.build(docs, windows)
    keys = docs.select("doc_id", decontaminate.row_key("doc_id", "text").alias("__doc"))
    near = {slop: {r.doc_id for r in index.proximity(windows, slop).join(keys, "__doc").collect()} for slop in (1, 3, 8)}
    assert near == {1: set(), 3: {2}, 8: {1, 2}}


def near_by_definition(rows, items, size, slop):
    """Places of a window's rarest term that have all its other terms within ``slop`` words, by doc_id."""
    texts = {i: (t or "").lower().split() for i, t in rows}
    counts = Counter(w for words in texts.values() for w in words)
    windows = set()
    for _, text in items:
        words = text.split()
        windows |= {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}
    found = {}
    for doc_id, words in texts.items():
        places = set()
        for window in windows:
            terms = sorted(set(window), key=lambda t: (counts[t], window.index(t)))
            if len(terms) < 2 or not all(counts[t] for t in terms):
                continue
            for at, word in enumerate(words):
                if word == terms[0] and set(terms) <= set(words[max(0, at - slop) : at + slop + 1]):
                    places.add(at)
        found[doc_id] = len(places)
    return found


@pytest.mark.parametrize("slop", [2, 5, 12])
def test_proximity_column(spark, slop):
    random_ = random.Random(slop)
    rows = [(i, " ".join(random_.choices("abcdefgh", k=random_.randint(0, 60)))) for i in range(60)] + [(99, None)]
    items = [(i, " ".join(random_.choices("abcdefghz", k=random_.randint(1, 9)))) for i in range(25)] + [(77, "a a a")]
    docs, tests = spark.createDataFrame(rows, TEXT), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, tests, 4, slop).select("doc_id", "n_near").collect()
    assert {r.doc_id: r.n_near for r in found} == near_by_definition(rows, items, 4, slop)


def broadcast(plan):
    """The lines of a plan that stand below its broadcasts."""
    lines = [(re.search(r"\w", x).start(), x) for x in plan.splitlines() if re.search(r"\w", x)]
    below = []
    for n, (depth, line) in enumerate(lines):
        if "BroadcastExchange" in line:
            below += [x for _, x in itertools.takewhile(lambda x, top=depth: x[0] > top, lines[n + 1 :])]
    return below


def test_exploded_rows_are_not_broadcast(spark, monkeypatch):
    frames, stored = [], decontaminate.stored
    monkeypatch.setattr(decontaminate, "stored", lambda df, purpose: frames.append(df) or stored(df, purpose))
    random_ = random.Random(3)
    rows = [(i, " ".join(random_.choices("abcdefgh", k=40))) for i in range(50)]
    docs = spark.createDataFrame(rows, TEXT)
    windows = decontaminate.windows_of(spark.createDataFrame([(1, "a b c d"), (2, "e a")], "item_id long, text string"), 3)
    index = decontaminate.PositionalIndex.build(docs, windows)
    frames.clear()
    frames += [index.phrases(windows), index.proximity(windows, 20)]
    assert frames[-1].count() > 0
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in frames]
    assert sum("Generate" in p for p in plans) >= 3 and any(broadcast(p) for p in plans)
    assert not [x for p in plans for x in broadcast(p) if "Generate" in x and ("sequence" in x or "posexplode" in x)]


@pytest.mark.parametrize("seed,min_words", [(1, 1), (2, 3), (3, 4), (4, 6), (5, 9)])
def test_line_dedup(spark, seed, min_words):
    random_ = random.Random(seed)
    lines = ["", "a", "b c", "d e f", "g  h", "i j k l m"]
    rows = [(i, "\n".join(random_.choices(lines, k=random_.randint(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, "only here")]
    found = linededup.dedup_lines(spark.createDataFrame(rows, TEXT).repartition(3), min_words).collect()
    expected = dedup_lines(rows, min_words)
    assert {r.doc_id: (r.text or "", r.n_removed) for r in found} == expected


def test_line_dedup_cases(spark):
    rows = [(None, "x y\nz", "q"), (1, "x y\nz", "r"), (1, "x y\nz", "r"), (2, "x y", "s"), (3, None, "t")]
    df = spark.createDataFrame(rows, TEXT + ", n_lines string")
    found = linededup.dedup_lines(df, 2)
    assert found.columns == ["doc_id", "text", "n_lines", "n_removed"]
    got = Counter((r.doc_id, r.text, r.n_removed) for r in found.collect())
    assert got == Counter([(None, "x y\nz", 0), (1, "", 2), (1, "", 2), (2, "", 1), (3, None, 0)])
    assert linededup.dedup_lines(df.limit(0), 2).count() == 0


def test_long_runs_and_long_texts(spark):
    long = "\n".join(f"w{i % 4000}" for i in range(5000))
    rows = [(1, long), (2, "new line\n" + long)]
    found = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, TEXT), 50).collect()}
    assert found[2].text == "new line" and found[2].n_removed == 5000
    assert found[1].n_removed == 1000  # its own second copies


def test_pipeline_stages(spark, data_dir):
    """Each stage against plain Python on its own input."""
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    docs = docs.where("doc_id < 500").cache()
    whole = docs
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        result = stage(spark, docs, data_dir)
        if name != "bpe":
            assert result.columns == columns
        got = {r.doc_id: r for r in result.collect()}
        if name == "quality":
            labels = spark.read.parquet(f"{data_dir}/labels.parquet").join(whole, "doc_id")
            known = {r.doc_id: r.quality for r in labels.select("doc_id", "quality").collect()}
            kept = [got.keys() >= {i} for i, q in known.items() if q == 1]
            assert sum(kept) >= 0.97 * len(kept)
            assert sum(i not in got for i, q in known.items() if q == 0) >= 0.8 * sum(q == 0 for q in known.values())
        elif name == "linededup":
            cut = dedup_lines(rows, linededup.MIN_WORDS)
            lines = {i: (t or "").count("\n") + 1 for i, t in rows}
            assert {i: r.text for i, r in got.items()} == {i: t for i, (t, n) in cut.items() if n < lines[i]}
        elif name == "neardup":
            assert got.keys() == {i for i, _, _, kept in near_duplicates(rows, 5, 80) if kept}
        elif name == "decontaminate":
            items = [tuple(r) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
            assert got.keys() == {i for i, _, hit, _ in contamination(rows, items, 10) if not hit}
        else:
            tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path())
            for i, t in rows:
                assert got[i].n_tokens == len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        docs = spark.createDataFrame(list(got.values()), result.schema)
    assert len(got) > 50


def test_bpe_against_the_library(spark, documents):
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path())
    random_ = random.Random(1)
    bits = ["a", " ", "\n", "\t", "'s", "<|endoftext|>", "é", "日", "1", "!", "\x1c", "\x85", "　", "<|", "👍🏽", "'LL", "\r"]
    texts = [t for _, t in documents[:60]]
    texts += ["".join(random_.choice(bits) for _ in range(random_.randint(0, 40))) for _ in range(800)]
    texts += ["x" * 30_000, "ab" * 20_000, " " * 5_000, "<|endoftext|>" * 3]
    texts += ["".join(map(chr, range(i, i + 300))) for i in range(1, 0xD000, 300)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], TEXT).withColumn("tokens", F.lit("mine"))
    found = {r.doc_id: r for r in bpe.encode_and_decode(df.repartition(4), tokenizer_path()).collect()}
    for i, (text, encoded) in enumerate(zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False))):
        ids = [int.from_bytes(found[i].tokens[j : j + 4], "little") for j in range(0, len(found[i].tokens), 4)]
        assert ids == encoded.ids, text[:50]
        assert found[i].decoded == text
    assert found[-1].tokens == b"" and found[-1].decoded == ""
    assert bpe.encode_and_decode(df.limit(0), tokenizer_path()).count() == 0


def test_bpe_of_long_runs_and_long_words(spark):
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path())
    word = "".join(random.Random(2).choices("abcdefgh", k=100_000))
    texts = ["👍!" * 100_000, "👍!<|endoftext|>" * 20_000 + " ", "é👍 " * 100_000, word, word, "日" * 300_000]
    df = spark.createDataFrame([*enumerate(texts)], TEXT).repartition(3)
    assert max(len(w.encode()) for w in bpe.frequent_words(df, bpe.Vocabulary(tokenizer_path()), "text", 100)) <= 64
    found = {r.doc_id: r for r in bpe.encode_and_decode(df, tokenizer_path()).collect()}
    for i, encoded in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        ids = [int.from_bytes(found[i].tokens[j : j + 4], "little") for j in range(0, len(found[i].tokens), 4)]
        assert ids == encoded.ids and found[i].decoded == texts[i]


def test_decoding_of_broken_bytes_and_lexicon(spark):
    vocabulary = bpe.Vocabulary(tokenizer_path())
    half = vocabulary.byte_ids[0xC3]
    df = spark.createDataFrame([(1, half.to_bytes(4, "little")), (2, None)], "doc_id long, tokens binary")
    assert {r.doc_id: r.decoded for r in bpe.decode(df, vocabulary).collect()} == {1: "�", 2: ""}
    merger = bpe.Merger(vocabulary)
    words = [w.encode() for w in ("walking", "talking", "walk", "talk", "é", " the")]
    data = bpe.compile_lexicon((w, merger.merge(w)) for w in words)
    lexicon = bpe.Lexicon(data)
    assert len(lexicon.final) < 25  # shared prefixes and suffixes
    import numpy as np

    asked = [*words, b"wal", b"walkin", b"x", b""]
    starts = np.cumsum([0, *map(len, asked)])[:-1]
    numbers = lexicon.numbers(np.frombuffer(b"".join(asked), np.uint8), starts, np.array(list(map(len, asked))))
    assert (numbers[:6] >= 0).all() and (numbers[6:] == -1).all() and len(set(numbers[:6])) == 6
    for word, n in zip(words, numbers):
        assert lexicon.ids[lexicon.starts[n] : lexicon.starts[n + 1]].tolist() == merger.merge(word)
    longer = [bytes(random.Random(i).choices(b" etaoin\xc3\xa9'0", k=i % 60 + 1)) for i in range(500)]
    assert merger.merge_all(longer) == [merger.merge(w) for w in longer]


def test_pieces_of_a_blob_are_merged_as_single_words(monkeypatch):
    """Words are merged where they lie; no word is taken out of the blob as a Python object."""
    import numpy as np

    merger = bpe.Merger(bpe.Vocabulary(tokenizer_path()))
    random_ = random.Random(4)
    words = [bytes(random_.choices(b" etaoinshr\xc3\xa9'0", k=random_.choice([0, 1, 2, 3, 7, 20, 48]))) for _ in range(3000)]
    words += [b"", b"a", b"aaaaaaa", bytes(range(256))[:48]]
    expected = [merger.merge(w) for w in words] + [merger.merge(b"ea" * 40)]
    words.append(b"ea" * 40)
    lengths = np.array([len(w) for w in words])
    blob = np.frombuffer(b"?".join(words), np.uint8)
    starts = np.cumsum(lengths + 1) - lengths - 1
    single = []
    merge = merger.merge
    monkeypatch.setattr(merger, "merge", lambda w: single.append(w) or merge(w))
    ids, firsts, sizes = merger.merge_pieces(blob, starts, lengths, chunk=100)
    assert [ids[at : at + n].tolist() for at, n in zip(firsts, sizes)] == expected
    assert single == [b"ea" * 40]
    none = np.zeros(0, np.int64)
    assert [len(x) for x in merger.merge_pieces(blob, none, none)] == [0, 0, 0]


def test_decoding_of_many_rows(spark):
    vocabulary = bpe.Vocabulary(tokenizer_path())
    lead, tail = (vocabulary.byte_ids[b].to_bytes(4, "little") for b in (0xC3, 0xA9))
    rows = [(0, lead), (1, tail), (2, b""), (3, None), (4, lead + tail), (5, (lead + tail) * 300_000), (6, lead)]
    df = spark.createDataFrame(rows, "doc_id long, tokens binary").coalesce(1)
    found = {r.doc_id: r.decoded for r in bpe.decode(df, vocabulary).collect()}
    assert found == {0: "\ufffd", 1: "\ufffd", 2: "", 3: "", 4: "é", 5: "é" * 300_000, 6: "\ufffd"}
