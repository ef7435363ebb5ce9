"""Whitening, periodic runs, chunk recipes and sorted suffixes against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteglass.llm import labelled, passages, queries, recipes, runs, warc, whitening

DOCS = "doc_id long, text string, lang string, n_words long, runs string, recipe int, key string, body binary"


# --- op11 ----------------------------------------------------------------------------------

@pytest.mark.parametrize("case", ["random", "clusters", "repeated", "diagonal", "low rank", "blocks", "one"])
def test_leading_components(case):
    r = np.random.default_rng(3)
    d = 1 if case == "one" else 40
    basis = np.linalg.qr(r.standard_normal((d, d)))[0]
    values = {
        "random": np.sort(r.random(d))[::-1] * 50, "clusters": 5 + 1e-9 * np.arange(d)[::-1], "repeated": np.repeat([9.0, 4.0, 1.0, 0.5], 10),
        "low rank": np.concatenate([[7.0, 3.0], np.zeros(max(0, d - 2))]), "one": np.array([2.0]),
    }
    if case == "diagonal":
        matrix = np.diag(np.arange(1.0, d + 1))
    elif case == "blocks":
        matrix = np.kron(np.eye(d // 2), np.array([[2.0, 1.0], [1.0, 2.0]]))
    else:
        matrix = (basis * values[case]) @ basis.T
        matrix = (matrix + matrix.T) / 2
    got, vectors = whitening.leading_components(matrix, 16)
    expected = np.linalg.eigvalsh(matrix)[::-1]
    n = 2 if case == "low rank" else min(16, d)
    assert len(got) == n
    np.testing.assert_allclose(got, expected[:n], rtol=0, atol=1e-13 * expected[0] * d)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(n), atol=1e-12)
    assert np.max(np.abs(matrix @ vectors - vectors * got)) < 1e-12 * expected[0] * d


def test_zero_matrix_has_no_component():
    assert len(whitening.leading_components(np.zeros((5, 5)), 16)[0]) == 0


def plain_whitening(vectors):
    sound = {i: v for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)}
    x = {i: np.floor(64 * np.array(v)).astype(int) + 1_000_000 for i, v in sound.items()}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, total = len(fit), fit.sum(0)
    values, basis = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, basis = values[::-1], basis[:, ::-1]
    out = {}
    for i, v in x.items():
        out[i] = n, sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, total)), (v - total / n) @ basis / np.sqrt(np.maximum(values, 1e-300)), values / values.sum()
    return out


def test_whitening_against_numpy(spark):
    r = np.random.default_rng(4)
    scale = np.linspace(3, 0.4, 20)
    rows = [(i, [float(np.float32(c)) for c in r.standard_normal(20) * scale]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(80)]  # a hot vector
    rows += [(300, None), (301, []), (302, [None] * 20), (303, [float("nan")] + [0.0] * 19), (304, [float("inf")] + [0.0] * 19), (None, rows[3][1]), (5, rows[5][1])]
    frame = spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, x string, id int, w double").repartition(5)
    got = defaultdict(dict)
    for row in whitening.whiten(frame).collect():
        got[row.vec_id].setdefault(row.component, []).append(row)
    assert sorted(got, key=str) == sorted([None, *range(150), *range(200, 280)], key=str) and len(got[5][1]) == 2
    expected = plain_whitening(rows)
    signs = np.sign([sum(got[i][c][0].whitened * expected[i][2][c - 1] for i in range(150)) for c in range(1, 17)])
    for i, (n, deviation, white, shares) in expected.items():
        assert sorted(got[i]) == list(range(1, 17))
        for c, (row, *_) in got[i].items():
            assert (row.n, row.deviation) == (n, deviation)
            assert abs(row.whitened - signs[c - 1] * white[c - 1]) < 1e-8 and abs(row.explained / shares[c - 1] - 1) < 1e-9
            assert row.identity_error < 1e-10


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    empty = spark.createDataFrame([], schema)
    assert whitening.whiten(empty).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], schema)
    assert whitening.whiten(same).collect() == []  # no variance
    # Another length than most: left out. Two dimensions on a line: one component.
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)] + [(50, [1.0])], schema)
    got = whitening.whiten(line).collect()
    assert sorted((r.vec_id, r.component) for r in got) == [(i, 1) for i in range(9)]
    assert abs(np.var([r.whitened for r in got]) - 1) < 1e-12


# --- op12 ----------------------------------------------------------------------------------

def plain_runs(words):
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            size = i - start + q
            smaller = any(all(words[start + k] == words[start + k + d] for k in range(size - d)) for d in range(1, q))
            if size >= max(6, 4 * q) and not smaller:
                found.append((start, size, q))
    return sorted(found, key=lambda f: (f[0], f[2]))


def test_runs_against_brute_force():
    r = random.Random(1)
    for _ in range(1500):
        n, k = r.randrange(0, 90), r.choice([1, 2, 2, 3, 5])
        words = [b"w%d" % r.randrange(k) for _ in range(n)]
        if r.random() < 0.6 and n > 10:
            a, p = r.randrange(n), r.randrange(1, 8)
            for i in range(a + p, n):
                words[i] = words[i - p]
            if r.random() < 0.5:
                words += [b"x%d" % r.randrange(30) for _ in range(r.randrange(20))] + words[:20] * r.randrange(6)
        assert runs.word_runs(words) == plain_runs(words)


def test_least_between():
    r = np.random.default_rng(2)
    for n in (1, 15, 16, 17, 100, 1000):
        values = r.integers(0, 50, n)
        table = runs.LeastBetween(values.astype(np.int32))
        a, b = r.integers(0, n, 300), r.integers(0, n, 300)
        low, high = np.minimum(a, b), np.maximum(a, b)
        assert table(low, high).tolist() == [values[x:y + 1].min() for x, y in zip(low, high)]


def test_common_extensions():
    r = random.Random(3)
    for _ in range(100):
        s = [r.randrange(3) for _ in range(r.randrange(1, 60))] + [9]
        tree = runs.SuffixTree(s)
        assert tree.order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        pairs = [(i, j) for i in range(len(s)) for j in range(len(s)) if i != j]
        if pairs:
            a, b = map(np.array, zip(*pairs))
            plain = [next(k for k in range(len(s) + 1) if max(i, j) + k >= len(s) or s[i + k] != s[j + k]) for i, j in pairs]
            assert tree.extension(a, b).tolist() == plain


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    out = [None, "", " \t\n", "a", "la " * 40, "A b C " * 9, "x y " * 3, "é ü　é ü " * 8, ("one two three. " * 7 + "\nbreak ") * 3]
    out += [" ".join(r.choice("abcdefgh") * r.randrange(1, 3) for _ in range(r.randrange(400))) for _ in range(60)]
    return out + ["long " + "tick tock " * 20_000]


def test_periodic_runs_of_texts(spark, texts):
    rows = [(i if i != 5 else None, t, "en", 1, "clash", 2, "k", b"b") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows + rows[:6], DOCS).repartition(4)
    got = defaultdict(list)
    for row in runs.periodic_runs(frame).collect():
        got[row.doc_id].append((row.n_words, [(x.start, x.length, x.period) for x in row.runs], row.collapsed))
    for i, text in enumerate(texts):
        words = re.findall("[^\x20\x09-\x0D]+", text or "")
        found = plain_runs(words) if len(words) < 1000 else [(1, 40_000, 2)]
        gone = {p for s, n, q in found for p in range(s + q, s + n)}
        want = len(words), found, " ".join(w for p, w in enumerate(words) if p not in gone)
        assert got[None if i == 5 else i] == [want] * (2 if i < 6 else 1), i
    assert runs.periodic_runs(spark.createDataFrame([], DOCS)).collect() == []


def test_periodic_runs_query(spark, folder):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    changed = 0
    for doc_id, text in docs:
        words = re.findall("[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            changed += 1
        if n > 800:
            continue
        found = plain_runs(words)
        gone = {p for s, size, q in found for p in range(s + q, s + size)}
        best = min(found, key=lambda f: (-f[1], f[0], f[2])) if found else (None,) * 3
        lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
        left = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert tuple(got[doc_id]) == (
            doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest(),
        )
    assert changed > 5


# --- op13 ----------------------------------------------------------------------------------

def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_cuts_follow_the_content():
    r = random.Random(6)
    body = bytes(r.randrange(97, 123) for _ in range(60_000))
    one, two = (next(iter(recipes.chunked_texts([t], 64))) for t in (body, b"Another beginning. " + body))
    assert b"".join(one[2]) == body and len(set(one[2]) & set(two[2])) > 0.9 * len(one[2])
    assert all(recipes.LEAST <= len(p) <= recipes.MOST for p in one[2][:-1])
    alone = list(recipes.chunked_texts([body[:3000], b"", body, body[:100]], 64))
    assert [len(b"".join(p)) for _, _, p in alone] == [3000, 0, 60_000, 100] and alone[2] == one
    runs_of_one = next(iter(recipes.chunked_texts([b"z" * 50_000], 64)))
    assert b"".join(runs_of_one[2]) == b"z" * 50_000 and len(runs_of_one[2]) >= 6


@pytest.mark.parametrize("bits", [64, 3])
def test_recipes_against_grouping(spark, bits):
    r = random.Random(7)
    base = [" ".join(r.choice(["Aa", "bB", "ccc", "Ünï", "d\n"]) for _ in range(r.randrange(1, 2000))) for _ in range(25)]
    long = "".join(r.choice("abcdef \n") for _ in range(300_000))
    texts = base + [t.upper() for t in base[:5]] + [t.swapcase() for t in base[:3]] + [None, "", "É", "é", long, long[:-1] + "!", long.upper(), "!" + long[1:]] + ["hot text " * 300] * 60
    rows = [(i if i not in (3, 40) else None, t, "en", 1, "clash", 2, "k", b"b") for i, t in enumerate(texts)]
    rows += rows[:4] + [(None, base[0], "en", 1, "", 2, "", b"")]
    got = Counter(map(tuple, recipes.exact_duplicates(spark.createDataFrame(rows, DOCS).repartition(6), bits).collect()))
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[lower(t)].append(i)
    want = Counter()
    for text, ids in groups.items():
        head = max((i for i in ids if i is not None), default=None)
        sha, stays = hashlib.sha256(text.encode()).hexdigest(), 1
        for i in ids:
            want[i, head, len(ids), i == head and stays > 0, sha] += 1
            stays -= i == head
    assert got == want


def test_recipes_of_no_rows(spark):
    assert recipes.exact_duplicates(spark.createDataFrame([], DOCS)).collect() == []


# --- bounded samples -----------------------------------------------------------------------

def test_sample_counts_rows_of_a_repeated_document_by_weight(spark):
    """A document that is a third of the table and among the picked ids, and an id with many texts."""
    rows = [(i, f"text {i}") for i in range(200)] + [(7, "text 7")] * 300 + [(8, f"other {j}") for j in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    every = F.lit(True)
    sample, sizes = labelled.labelled_sample(docs, labels, "quality", every, 1000, "t")
    got = sample.collect()
    assert sizes == {0: 100, 1: 100} and len(got) == 300 and sum(r.weight for r in got) == 600
    assert [r.weight for r in got if r.doc_id == 7] == [301.0]
    few, _ = labelled.labelled_sample(docs, labels, "quality", every, 110, "t")
    held = [r.label for r in few.collect()]
    assert held.count(0) == 110 and held.count(1) == 100
    small, _ = labelled.labelled_sample(docs, labels, "quality", every, 5, "t")
    want = sorted(spark.range(200).where("id % 2 = 1").orderBy(F.xxhash64("id")).limit(5).toPandas()["id"])
    assert sorted(r.doc_id for r in small.collect() if r.label == 1) == want
    assert labelled.labelled_sample(docs, labels.limit(0), "quality", every, 5, "t")[0].collect() == []


def test_dictionary_pages_are_few_and_distinct(spark):
    rows = [(i, f"u{i}", "x" * (i % 50)) for i in range(3000)] + [(5, "u5", "same")] * 1500 + [(None, None, None)] * 10
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.url) for r in warc.dictionary_pages(pages, 200).collect()]
    assert 60 <= len(got) <= 400 and len(got) == len(set(got))
    assert len(warc.dictionary_pages(pages.limit(40), 200).collect()) == len({r[:2] for r in rows[:40]})
    long = spark.createDataFrame([(1, "u", "long " * 20_000), (2, "v", "long " * 20_000)], "page_id long, url string, html string")
    assert warc.dictionary_pages(long).collect() == [] and warc.dictionary_pages(pages.limit(0)).collect() == []
    assert sorted(tuple(r) for r in warc.round_trip(long).select("page_id", "record_type", "refers_to").collect()) == [(1, "response", None), (2, "revisit", 1)]


# --- op6 ---------------------------------------------------------------------------------

def test_neighbours_share_the_most_words(spark):
    """Lengths from sorted neighbours against all pairs; only rows at edges of partitions or blocks may get the whole length."""
    r = random.Random(4)
    rows = [(np.array([r.randrange(3) for _ in range(r.randrange(2, 9))], np.uint32).tobytes(), r.randrange(40), i, r.randrange(2)) for i in range(600)]
    rows += [(rows[0][0], 40 + i % 150, 1000 + i, rows[0][3]) for i in range(300)]  # one passage of very many texts
    rows += [(rows[1][0], 7, 2000 + i, rows[1][3]) for i in range(100)]  # one text with equal suffixes
    frame = spark.createDataFrame(rows, "words binary, key long, pos int, side int").repartition(3)
    for block in (8, 20_000):
        got = {(x.key, x.pos, x.side): x.common for x in passages.neighbour_lengths(frame, 50, block).collect()}
        assert len(got) == len(rows)
        edges = 0
        for words, key, pos, side in rows:
            codes, best = np.frombuffer(words, np.uint32), 0
            for other, k, _, s in rows:
                if k != key and s == side:
                    o = np.frombuffer(other, np.uint32)[:len(codes)]
                    differ = np.flatnonzero(codes[:len(o)] != o)
                    best = max(best, differ[0] if len(differ) else len(o))
            want = best - 2 * side
            if got[(key, pos, side)] != max(-1, want):
                assert got[(key, pos, side)] == 52 - 2 * side
                edges += 1
        assert edges < (len(rows) if block == 8 else 150)


def test_sides_shared_with_different_texts(spark):
    """Windows whose two sides are in different texts are no passages; those of a third text with both are."""
    from .test_operators import plain_spans, sentence

    r = random.Random(12)
    left, core, right = sentence(r, 30), sentence(r, 25), sentence(r, 30)
    rows = [(i, " ".join(x)) for i, x in enumerate([
        [left, core, right], [left, core, sentence(r, 40)], [sentence(r, 40), core, right], [sentence(r, 20), left, core, right, sentence(r, 9)], [core, core, core],
    ])]
    rows += [(10 + i, " ".join([sentence(r, 15), core, sentence(r, 15)])) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(x.doc_id, x.start_word, x.end_word) for x in passages.repeated_passages(frame).collect()}
    assert got == plain_spans(rows) and {d for d, _, _ in got} == {0, 1, 2, 3}
