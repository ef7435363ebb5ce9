"""Operators of the llm subpackage against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from siteglass.llm import chat, decontamination, gam, graph, labelled, mixing, passages, rules, simhash, tokens, toxicity, warc
from siteglass.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, n_chars long, _words string, label int, key string, row double"
WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "ten", "sol", "var", "dex") for b in ("na", "ri", "to", "lum", "pe", "shi", "go", "ble")]


def sentence(r: random.Random, n: int) -> str:
    out = [r.choice(WORDS) + r.choice(WORDS) for _ in range(n)]
    return " ".join(w.capitalize() + "." if i % 11 == 0 else w for i, w in enumerate(out))


@pytest.fixture(scope="module")
def texts() -> list[str | None]:
    r = random.Random(5)
    base = [sentence(r, r.randrange(3, 260)) for _ in range(60)]
    near = [" ".join(w if j % 97 else w + "x" for j, w in enumerate(b.split())) for b in base[:10]]
    passage = sentence(r, 60)
    spread = [sentence(r, 40) + " " + passage + "\n" + sentence(r, 30) for _ in range(5)]
    odd = [None, "", "   \n\t", "a", "A b", "x " * 300, "1 2 3 4 5 6 7 8 9", "　wide　space café \U0001F600", "<|endoftext|> end <|endoftext|>", "!!! ### $$$ %%% &&& |||" * 30, sentence(r, 30_000)]
    return base + near + spread + odd + base[:6] + [sentence(r, 20) + " " + passage]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if i != 7 else None, t, ("en", "de", None)[i % 3], len(t or ""), "clash", 1, "k", 0.5) for i, t in enumerate(texts)]
    rows += rows[:3]  # repeated rows
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def text_of(texts, i):
    return texts[7 if i is None else i] or ""


# --- op2 ---------------------------------------------------------------------------------

def plain_fingerprint(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    made = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in made]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(n: int, linked) -> list[int]:
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_near_duplicates(docs, texts, nothing):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 3
    prints = [plain_fingerprint(t or "") for t in texts]
    roots = roots_of(len(texts), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 4)
    for r in rows:
        i = 7 if r.doc_id is None else r.doc_id
        named = min(k for k in range(len(texts)) if roots[k] == roots[i] and k != 7) if any(roots[k] == roots[i] and k != 7 for k in range(len(texts))) else None
        assert (int(r.fingerprint, 16), r.component_id) == (prints[i], named)
    assert simhash.near_duplicates(nothing).collect() == []


@pytest.mark.parametrize("m, chain, distance", [(7, 5, 4), (8, 5, 4), (6, 4, 3)])
def test_chains_find_every_pair(spark, m, chain, distance):
    r = random.Random(m)
    values = [r.getrandbits(64) for _ in range(40)]
    for v in values[:20]:
        for n in range(1, distance + 2):
            values.append(v ^ sum(1 << b for b in r.sample(range(64), n)))
    values = list({v - (1 << 64) if v >> 63 else v for v in values})
    got = {(x.a, x.b) for x in simhash.similar_fingerprints(spark.createDataFrame([(v,) for v in values], "fp long"), distance, m, chain).collect()}
    want = {(a, b) for a in values for b in values if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= distance}
    assert got == want and want


@pytest.mark.parametrize("distance", [4, 2, 1])
def test_crowded_keys_give_the_same_components(spark, distance):
    r = random.Random(distance)
    base, weak = r.getrandbits(64), r.sample(range(64), 9)
    values = {base ^ sum(1 << b for b in weak if r.random() < 0.4) for _ in range(150)}  # one dense group
    values |= {base ^ sum(1 << b for b in r.sample(range(64), n)) for n in range(1, 14) for _ in range(6)}  # and a thin hull
    values |= {r.getrandbits(64) for _ in range(30)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {x.node: x.root for x in graph.components(simhash.connecting_links(frame, distance, crowd=8)).collect()}
    roots = roots_of(len(values), lambda i, j: bin((values[i] ^ values[j]) & (1 << 64) - 1).count("1") <= distance)
    assert [got.get(v, v) for v in values] == [values[k] for k in roots]


def test_one_row_per_component_stays(docs, texts, nothing):
    left = simhash.without_near_duplicates(docs)
    assert left.columns == docs.columns
    prints = [plain_fingerprint(t or "") for t in texts]
    roots = roots_of(len(texts), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 4)
    ids = [r.doc_id for r in left.collect()]
    assert sorted(-1 if i is None else i for i in ids) == sorted(min((k for k in range(len(texts)) if roots[k] == c and k != 7), default=-1) for c in set(roots))
    assert simhash.without_near_duplicates(nothing).collect() == []


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300), (None, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), **dict.fromkeys(range(200, 209), 200)}


# --- op10 --------------------------------------------------------------------------------

def test_token_counts(docs, texts, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    for block in (tokens.BLOCK_BYTES, 3000):
        rows = tokens.count_tokens(docs, tokenizer_path(), block_bytes=block).collect()
        assert len(rows) == len(texts) + 3
        for r in rows:
            t = text_of(texts, r.doc_id)
            n = len(library.encode(t, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)
    assert tokens.count_tokens(nothing, tokenizer_path()).collect() == []


def test_pre_tokens_equal_the_library():
    split, r = tokens.pre_tokens_of(tokenizer_path()), random.Random(2)
    alphabet = list(" \t\n\r\x0b\x1c\x85\xa0　​'sdtrevmlABéñ漢字12²½.,!?#-_\U0001F600ก\U00018e9c\U00012653")
    strings = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 20))) for _ in range(3000)]
    counted = [split.count(s) for s in strings]
    pieces = dict(zip(known := sorted(set().union(*(c for c, _ in counted))), split.pieces(known)))
    assert [n + sum(f * pieces[t] for t, f in c.items()) for c, n in counted] == [len(e.ids) for e in split.tokenizer.encode_batch(strings, add_special_tokens=False)]


# --- op5 ---------------------------------------------------------------------------------

def base_stats(t: str) -> tuple:
    words = re.findall("[^\x20\x09-\x0D]+", t)
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_rule_statistics(docs, texts, spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    judged, learned = rules.judge(docs, labels)
    assert learned == []
    for r in judged.collect():
        want = base_stats(text_of(texts, r.doc_id))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept == (not want[-1])
    carried, _ = rules.judge(docs, labels, carry=True)
    assert carried.select("row.*").columns == docs.columns and carried.count() == len(texts) + 3
    assert rules.judge(nothing, labels)[0].collect() == []


def test_decision_list_is_learned(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        t = sentence(r, r.randrange(60, 120))
        kind = i % 3
        rows.append((i, t if kind == 0 else t.upper() if kind == 1 else " ".join(w + "***" for w in t.split())))
        if i % 2:
            labels += [(i, int(kind == 0)), (i, int(kind == 0))]
    labels += [(None, 0), (3, None)]
    judged, learned = rules.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert {t.feature for x in learned for t in x.terms} & {"upper", "symbols"} and all(x.precision >= 0.8 for x in learned)
    kept = {x.doc_id for x in judged.where("kept").collect()}
    assert kept == {i for i in range(0, 900, 3)}


# --- op3, op4 ----------------------------------------------------------------------------

def test_additive_model_tables_add_up():
    r = np.random.default_rng(3)
    x = r.normal(size=(4000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)  # an interaction
    model = gam.fit(x, y, np.ones(len(y)))
    assert ((model.scores(x) > 0.5) == y).mean() > 0.9
    b = model.bins(x[:5])
    by_hand = [model.bias + sum(t[b[k, i]] for i, t in enumerate(model.tables)) + sum(t[gam.coarse(b[k, i]), gam.coarse(b[k, j])] for i, j, t in model.pairs) for k in range(5)]
    assert np.allclose(model.margin(x[:5]), by_hand)


def test_trees_and_isotonic():
    r = np.random.default_rng(4)
    x = r.random((3000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.4)).astype(float)
    model = toxicity.fit_trees(x, y, np.ones(len(y)))
    assert ((model.scores(x) > 0.5) == y).mean() > 0.97
    at, value = toxicity.isotonic(np.array([0.0, 1, 1, 2, 3]), np.array([0.0, 1, 0, 0, 1]), np.ones(5))
    assert (np.diff(value) >= 0).all() and np.isclose(np.interp(3, at, value), 1) and np.isclose(np.interp(1.5, at, value), 1 / 3)
    assert toxicity.isotonic(np.array([]), np.array([]), np.array([])) is None


@pytest.mark.parametrize("score, target", [(gam.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_scores_of_odd_rows(spark, docs, texts, nothing, score, target):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(0)) == 1
    for labels in ([], [(1, 1), (2, 1)], [(1, 1), (2, 0), (2, None), (None, 1), (3, 0), (3, 0), (0, 1)]):
        rows = score(docs, spark.createDataFrame(labels, f"doc_id long, {target} int"), held).collect()
        assert len(rows) == len(texts) + 3
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert score(nothing, spark.createDataFrame([], f"doc_id long, {target} int"), held).collect() == []


@pytest.mark.parametrize("name, target, parts, rest, least", [("op3_quality_scores", "quality", 3, 1, 0.95), ("op4_toxicity_scores", "toxic", 5, 0, 0.85)])
def test_held_out_accuracy(spark, name, target, parts, rest, least):
    from siteglass.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r[target] for r in got) / len(got) >= least


def test_lexicon_terms():
    assert toxicity.terms_of("abcd") == {"=abcd", "abc", "abcd"}
    f = toxicity.Features(frozenset({"zor"}))
    x = dict(zip(toxicity.FEATURES, f("You are an 1d10t, ID10T idiot! zorbal")))
    assert x["insults"] > 0 and x["learned"] > 0 and x["second_person_near"] > 0 and x["obfuscated_hits"] > 0
    assert len(f("")) == len(toxicity.FEATURES) and len(labelled.quality_features("")) == len(labelled.QUALITY_FEATURES)


# --- op6 ---------------------------------------------------------------------------------

def plain_spans(rows) -> set:
    """Spans of rows (id, text): 50-word windows that another text has, joined."""
    where = defaultdict(set)
    for t in {t for _, t in rows}:
        w = t.split(" ") if False else re.findall("[^\x20\x09-\x0D]+", t)
        for j in range(len(w) - 49):
            where[tuple(w[j:j + 50])].add(t)
    copies = defaultdict(set)
    for i, t in rows:
        copies[t].add(i)
    out = set()
    for i, t in rows:
        w, spans = re.findall("[^\x20\x09-\x0D]+", t), []
        if len(copies[t]) > 1 and len(w) >= 50:
            out.add((i, 0, len(w)))
            continue
        for j in range(len(w) - 49):
            if len(where[tuple(w[j:j + 50])]) > 1:
                if spans and j <= spans[-1][1]:
                    spans[-1][1] = j + 50
                else:
                    spans.append([j, j + 50])
        out |= {(i, a, b) for a, b in spans}
    return out


def test_repeated_passages(docs, texts, nothing):
    got = {(r.doc_id, r.start_word, r.end_word) for r in passages.repeated_passages(docs).collect()}
    want = plain_spans([(None if i == 7 else i, t or "") for i, t in enumerate(texts)])
    assert got == want and len(want) > 10
    assert passages.repeated_passages(nothing).collect() == []


def test_passages_of_all_lengths(spark):
    r = random.Random(8)
    rows, shared = [], [sentence(r, n) for n in (48, 49, 50, 51, 55, 70, 120)]
    for i in range(60):
        rows.append((i, "\n".join([sentence(r, r.randrange(0, 30)), r.choice(shared), sentence(r, r.randrange(0, 30)), r.choice(shared)])))
    rows += [(100 + i, "tick tock " * 60 + str(i)) for i in range(3)]  # periodic texts
    got = {(r.doc_id, r.start_word, r.end_word) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == plain_spans(rows)


def test_passages_stay_once(docs, texts, nothing):
    left = passages.without_repeats(docs)
    assert left.schema == docs.schema
    rows = left.collect()
    again = {(r.doc_id, r.start_word) for r in passages.repeated_passages(left.dropDuplicates(["doc_id", "text"])).collect()}
    assert again == set()
    first = {r.doc_id: r for r in rows}
    passage = " ".join((texts[70] or "").split()[40:100])
    assert sum(passage in (r.text or "") for r in rows) == 1 and passage in first[70].text
    assert all(r.n_chars == len(r.text or "") for r in rows)
    assert {i for i in range(76, 80)} <= set(first)  # null, empty and short texts stay
    assert passages.without_repeats(nothing).collect() == []


def test_rolling_hash_and_minimisers():
    h = np.random.default_rng(1).integers(0, 2**63, 300, dtype=np.uint64)
    for n in (1, 2, 3, 10, 50, 64, 300, 301):
        r = passages.rolling(h, n)
        assert len(r) == max(0, 301 - n)
        assert all(passages.rolling(h[i:i + n], n)[0] == r[i] for i in range(0, len(r), 37))
    places, leads = passages.minimisers(h)
    assert all(p == s + int(np.argmin(leads[s:s + 41])) for s, p in enumerate(places)) and len(places) == 251


# --- op1 ---------------------------------------------------------------------------------

def test_templates_and_slots(spark):
    item = "If Anna buys 12 kg of apples for 30 dollars, how many dollars does she pay for 1 kg when the shop of Miller gives 12 apples away?"
    changed = item.replace("12", "47").replace("30", "85").replace("Anna", "Peter").replace("Miller", "Jones")
    broken = item.replace("12 kg", "47 kg").replace("30", "85").replace("12 apples", "9 apples")
    r = random.Random(1)
    rows = [(1, sentence(r, 40) + " " + item), (2, sentence(r, 30) + ". " + changed + " " + sentence(r, 20)), (3, sentence(r, 200)), (4, None), (5, ""), (None, item), (1, sentence(r, 40) + " " + item), (6, item.upper()), (7, broken)]
    rows.append(rows[0])
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, item_id string, pos int")
    bench = spark.createDataFrame([(0, item, 2), (0, item, 2), (1, None, 3), (2, "", 3), (3, sentence(r, 30), 1), (4, "short one", 0)], "item_id long, text string, doc_id long")
    got = decontamination.contamination(docs, bench).collect()
    kinds = {(x.doc_id, x.item_id): x.kind for x in got}
    assert kinds[(1, 0)] == "verbatim" and kinds[(None, 0)] == "verbatim" and kinds[(2, 0)] == "reparameterised"
    assert {d for d, _ in kinds} - {6, 7} == {1, 2, None}
    assert all(x.slot_consistency < 1 for x in got if x.doc_id == 7) and all(x.slot_consistency == 1 for x in got if x.doc_id in (1, 2))
    left = decontamination.without_contaminated(docs, bench)
    assert left.columns == docs.columns and {3, 4, 5} <= {x.doc_id for x in left.collect()} and not {1, 2} & {x.doc_id for x in left.collect()}
    assert decontamination.contamination(docs.limit(0), bench).count() == 0 and decontamination.contamination(docs, bench.limit(0)).count() == 0
    assert decontamination.without_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_contamination_against_plain_windows(spark, monkeypatch):
    """Shared eight-word windows of lower-case words, counted in Python; the shuffled join gives the same rows."""
    r = random.Random(11)
    items = [sentence(r, n).lower() for n in (8, 15, 30, 60)]
    rows = []
    for i in range(80):
        body = sentence(r, r.randrange(10, 60)).lower()
        if i % 4 == 0:
            words = r.choice(items).split()
            a = r.randrange(0, max(1, len(words) - 10))
            body += " " + " ".join(words[a:a + r.randrange(8, 40)])
        rows.append((i, body))
    cut = lambda t: re.findall(r"\w+", t)
    grams = lambda t: [tuple(cut(t)[j:j + 8]) for j in range(len(cut(t)) - 7)]
    want = {}
    for i, t in rows:
        for k, item in enumerate(items):
            own = set(grams(t))
            shared = "".join("x" if g in own else "-" for g in grams(item))
            n, longest = shared.count("x"), max(map(len, shared.split("-")))
            if n and (n / len(grams(item)) >= 0.3 or longest + 7 >= 13):
                want[(i, k)] = n
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(x.doc_id, x.item_id): x.n_windows for x in decontamination.contamination(docs, bench).collect()} == want and want
    assert any(n / len(grams(items[k])) < 0.3 for (_, k), n in want.items())
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert {(x.doc_id, x.item_id): x.n_windows for x in decontamination.contamination(docs, bench).collect()} == want


def test_short_items_and_items_of_numbers(spark):
    items = ["What is 12 * 7 + 9 - 3?", "Compute 14 + 7, 8 - 3, 9 * 2 and 5 + 6.", "What is the capital of France?", "lorem dolor"]
    r = random.Random(2)
    rows = [(i, f"{sentence(r, 30)} {t} {sentence(r, 30)}") for i, t in enumerate(items)] + [(10, items[2]), (11, sentence(r, 50)), (12, "12 * 7"), (13, "lorem")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontamination.contamination(docs, bench).collect()}
    assert set(got) == {(i, i) for i in range(4)} | {(10, 2)} and {x.kind for x in got.values()} == {"verbatim"}
    assert all(x.coverage == 1 and x.n_windows == x.item_windows for x in got.values())
    assert got[10, 2].end_token - got[10, 2].start_token == 6 and got[3, 3].end_token - got[3, 3].start_token == 2
    # Only windows rich in numbers are lost where the values change.
    item = "A box holds 3 red, 4 blue, 5 green, 6 white and 7 black balls of the same size and weight"
    changed = item.replace("3", "13").replace("4", "14").replace("5", "15").replace("6", "16").replace("7", "17")
    got = decontamination.contamination(spark.createDataFrame([(1, changed)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [x.kind for x in got] == ["reparameterised"] and got[0].coverage == 1


def test_repeated_phrases_and_long_items(spark):
    r = random.Random(4)
    word = lambda n: " ".join(sentence(r, n).lower().replace(".", "").split())
    item, long = word(17), word(300)  # 10 and 293 windows
    phrase, part = " ".join(item.split()[:8]), " ".join(long.split()[100:180])
    rows = [(1, f"{phrase} {word(5)} {phrase} {word(6)} {phrase}"), (2, f"{word(9)} {part} {word(9)}"), (3, " ".join(long.split()[:12])), (5, " ".join(long.split()[:13])), (4, f"{item} {item}")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, item), (1, long)], "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.n_windows, x.end_token - x.start_token) for x in decontamination.contamination(docs, bench).collect()}
    assert got == {(2, 1): (73, 80), (4, 0): (10, 17), (5, 1): (6, 13)}


def test_items_that_share_an_id_or_have_none(spark):
    r = random.Random(8)
    items = [sentence(r, 20) for _ in range(6)]
    docs = spark.createDataFrame([(i, f"{sentence(r, 20)} {t}") for i, t in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame([(7 if i < 5 else None, t) for i, t in enumerate(items)], "item_id long, text string")
    got = decontamination.contamination(docs, bench).collect()
    assert sorted((x.doc_id, x.item_id or 0, x.n_windows, x.item_windows) for x in got) == [(i, 7 if i < 5 else 0, 13, 13) for i in range(6)]
    assert len({x.item_key for x in got}) == 6 and decontamination.without_contaminated(docs, bench).count() == 0


def test_names_where_sentences_begin_and_case(spark):
    items = ["Tom has 12 apples. Sarah gives him 5 more.", "At the market of Boston the baker Miller sells bread to Anna and Peter near the old Harbour bridge", 'He said: "Robert counts the birds (Linda counts the trees) in the garden"']
    docs = spark.createDataFrame([
        (0, "Mary has 31 apples. Laura gives him 8 more."), (1, items[1].lower()), (2, items[1].upper()), (3, items[0].upper()),
        (4, items[2].replace("Robert", "Walter").replace("Linda", "Emma")), (5, "Tom likes pears. Sarah gives them 5 nuts."),
    ], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontamination.contamination(docs, bench).collect()}
    assert {k: x.kind for k, x in got.items()} == {(0, 0): "reparameterised", (1, 1): "verbatim", (2, 1): "verbatim", (3, 0): "verbatim", (4, 2): "reparameterised"}
    assert all(got[k].coverage == 1 for k in ((1, 1), (2, 1), (3, 0))) and got[0, 0].slot_consistency == 1


# --- op7 ---------------------------------------------------------------------------------

def test_rates_meet_targets(spark, docs, nothing):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(("das", "und", "schon", "nicht") if i % 4 == 0 else ("the", "and", "with", "this")) for _ in range(r.randrange(20, 80))), "clash", 2.0, "de" if i % 4 == 0 else "en") for i in range(400)]
    rows += [(None, None, None, None, None), (401, "", None, None, None), rows[0]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, rate string, _p double, lang string")
    plain = frame
    out = mixing.mixed(plain, plain.where("doc_id % 3 = 0").select("text", F.col("lang").alias("domain")), {"en": 1, "de": 1}).collect()
    assert len(out) == len(rows) and all(x.rate >= 0 and x.copies in (int(x.rate), int(x.rate) + 1) for x in out)
    total = sum(x.n_words for x in out)
    for d in ("p_en", "p_de"):
        assert abs(sum(x.rate * x.n_words * x[d] for x in out) / total - 0.5) < 1e-3
    assert sum((x.p_de > 0.5) == (x.lang == "de") for x in out if x.lang) >= 400
    empty = plain.limit(0)
    assert {x.rate for x in mixing.mixed(plain, empty.select("text", F.col("lang").alias("domain"))).collect()} == {1.0}
    assert mixing.mixed(empty, plain.select("text", F.col("lang").alias("domain"))).collect() == []


def test_rates_stay_nonnegative_where_targets_cannot_be_met(spark):
    rows = spark.createDataFrame([(float(10 + i), [0.9, 0.1] if i % 2 else [0.6, 0.4]) for i in range(50)], "n double, p array<double>")
    gradients, shares = mixing.fit_rates(rows, [0.0, 1.0])
    fitted = rows.select(mixing.rate(gradients, F.col("p")).alias("r"), "n", "p").collect()
    assert min(x.r for x in fitted) >= 0
    got = np.array([sum(x.r * x.n * x.p[k] for x in fitted) for k in (0, 1)]) / sum(x.n for x in fitted)
    assert np.allclose(got, shares)
    # Brute force: projected gradient on all rates at once, in the same metric, to the end.
    p, n = np.array([x.p for x in fitted]), np.array([x.n for x in fitted])
    rates = np.ones(len(n))
    for _ in range(20_000):
        rates = np.maximum(0, rates - 0.5 * (p @ ((rates * n) @ p / n.sum() - [0.0, 1.0])))
    best = np.square((rates * n) @ p / n.sum() - [0.0, 1.0]).sum()
    assert np.square(got - [0.0, 1.0]).sum() <= best + 1e-5
    assert min(x.r for x in fitted) == 0


# --- op8 ---------------------------------------------------------------------------------

@pytest.mark.parametrize("sizes", [(90, 6, 3, 1), (970, 10, 10, 10)])
def test_rates_meet_targets_of_rare_domains(spark, sizes):
    """Near-hard posteriors with a hot domain; the shares reached are on the columns, too."""
    rows = [(float(20 + j % 7), [0.997 if d == i else 0.001 for d in range(4)]) for i, size in enumerate(sizes) for j in range(size)]
    frame, targets = spark.createDataFrame(rows, "n double, p array<double>"), [0.5, 0.2, 0.2, 0.1]
    gradients, shares = mixing.fit_rates(frame, targets)
    fitted = frame.select("n", "p", mixing.rate(gradients, F.col("p")).alias("r")).collect()
    got = [sum(x.n * x.r * x.p[d] for x in fitted) / sum(x.n for x in fitted) for d in range(4)]
    assert np.allclose(got, targets, atol=2e-4) and np.allclose(got, shares) and min(x.r for x in fitted) >= 0
    assert len(mixing.fit_rates(frame, [1.0, 0.0, 0.0, 0.0])[1]) == 4


def test_archives_round_trip(spark, tmp_path):
    r = random.Random(6)
    html = ["", None, "x", "<p>café</p>", *[f"<html>{sentence(r, 50)}</html>" for _ in range(200)]]
    rows = [(i, f"http://e/{i}\n" if i % 5 else None, html[i % len(html)], "clash") for i in range(300)]
    rows += [rows[4], (None, "u", html[5], ""), (None, None, "only here", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(4)
    written = warc.write_archives(pages, f"file://{tmp_path}/a", limit=4000)
    assert written.count() > 4 and written.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read_archives(written).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    texts = {i: h or "" for i, _, h, _ in rows if i is not None}
    for x in got:
        if x.page_id is None:
            assert x.record_type == ("revisit" if x.refers_to is not None else "response")
            continue
        h = texts[x.page_id]
        again = first[h] != x.page_id
        assert (x.payload_bytes, x.payload_digest) == (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode())
        assert (x.record_type, x.refers_to) == (("revisit", first[h]) if again else ("response", None))
        assert x.payload is None if again else bytes(x.payload) == h.encode()
    assert warc.round_trip(pages.limit(0), f"file://{tmp_path}/b").collect() == []


# --- op9 ---------------------------------------------------------------------------------

def test_blocks_equal_plain_viterbi():
    r = np.random.default_rng(7)
    transitions = np.log(r.dirichlet(np.ones(chat.STATES), chat.STATES + 1))
    scores = np.log(r.random((90, chat.STATES)))
    whole = chat.viterbi(transitions, scores, chat.STATES)
    cuts = [0, 13, 14, 60, 90]
    value, back = None, []
    for a, b in zip(cuts, cuts[1:]):
        m = chat.best_paths(transitions, scores[a:b])
        if value is None:
            value = m[chat.STATES]
        else:
            ways = value[:, None] + m[:chat.STATES]
            back.append(ways.argmax(0))
            value = ways.max(0)
    ends = [int(value.argmax())]
    for step in reversed(back):
        ends.append(int(step[ends[-1]]))
    ends.reverse()
    path = []
    for (a, b), entry, last in zip(zip(cuts, cuts[1:]), [chat.STATES, *ends], ends):
        path += chat.viterbi(transitions, scores[a:b], entry, last)
    assert path == whole


def test_transcripts_are_recovered(spark, folder):
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    got = defaultdict(list)
    for x in chat.recover(turns).orderBy("conv_id", "turn", "part").collect():
        got[x.conv_id] += [x.role] * x.n_lines
    want = defaultdict(list)
    for x in turns.orderBy("conv_id", "turn").collect():
        want[x.conv_id] += [x.role] * len(x.text.split("\n"))
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    pairs = [(a, b) for k in want for a, b in zip(got[k], want[k])]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.85


def test_long_and_odd_conversations(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"line {i}?\nmore" if i % 2 == 0 else f"answer {i}. " * 9) for i in range(400)]
    rows += [(2, 0, None, None), (2, None, "user", ""), (None, 0, "user", "hi"), (None, 0, "user", "hi"), (3, 5, "robot", "beep"), rows[0]]
    turns = spark.createDataFrame([(*x, 1, "b") for x in rows], "conv_id long, turn long, role string, text string, part int, block string")
    got = chat.recover(turns).collect()
    lines = Counter()
    for x in got:
        lines[x.conv_id] += x.n_lines
    assert lines == {1: 600, 2: 2, None: 1, 3: 1}
    long = sorted((x for x in got if x.conv_id == 1), key=lambda x: (x.turn, x.part))
    assert {x.part for x in long} == set(range(7)) and len({x.turn for x in long}) >= 390
    assert chat.recover(turns.limit(0)).collect() == []


def test_blocks_hold_few_rows_of_any_transcript(spark):
    """Null ids, one turn number and null turns with many rows: every block has at most BLOCK pieces, in order."""
    rows = [(None, i % 3, "user", f"hello {i}") for i in range(500)] + [(1, None, "assistant", f"null turn {i}") for i in range(300)] + [(1, -5, "user", "low"), (1, 90, "user", "late"), (2, 10**9, "user", "a"), (2, 5, "user", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = chat.lines_of(turns).collect()
    assert max(Counter((x.conv_id, x.block) for x in pieces).values()) <= chat.BLOCK
    for c, n in ((None, 500), (1, 302), (2, 2)):
        mine = sorted((x for x in pieces if x.conv_id == c), key=lambda x: x.place)
        assert [x.place for x in mine] == list(range(n)) and all(x.block == x.place // chat.BLOCK for x in mine)
        order = [(x.turn is not None, x.turn or 0) for x in mine]
        assert order == sorted(order)
    lines = Counter()
    for x in chat.recover(turns).collect():
        lines[x.conv_id] += x.n_lines
    assert lines == {None: 500, 1: 302, 2: 2}


# --- pipeline ----------------------------------------------------------------------------

def test_stages_keep_the_columns_and_their_order(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "passage_dedup", "decontaminate", "mix"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [docs.count()]
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        current = corpus_pipeline.kept(stage(spark, current, folder), "test")
        counts.append(current.count())
        assert current.columns == docs.columns if name != "mix" else current.columns[:len(docs.columns)] == docs.columns
    assert counts[0] > counts[1] > counts[2] >= counts[3] > counts[4] == counts[5] > 0.5 * counts[0]
    assert current.select("doc_id").distinct().count() == counts[5]


def test_stages_take_empty_and_odd_tables(spark, docs, texts, folder):
    for frame, n in ((docs, len(texts) + 3), (docs.limit(0), 0)):
        frame = frame.select("doc_id", "text", "lang", F.lit("s").alias("source"), "n_chars")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, folder)
            assert out.columns[:5] == frame.columns and out.count() <= n
