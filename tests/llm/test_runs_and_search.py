"""Word runs, the automaton search and the exact inner products against plain versions, on odd inputs too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from fabsight.llm import inner_products, runs, scan
from tests.compare import connect, duck_rows, mismatch, spark_rows

DOCS = "doc_id long, text string, h long, words string, runs string, period int, item string, term string, score long, rank int"


def documents(spark, texts):
    """Repeated rows, a null id, other columns with the names of helper columns."""
    rows = [(i, t, 1, "w", "r", 2, "i", "t", 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[3:4], (None, "a a a a a a b", 1, "w", "r", 2, "i", "t", 3, 4)], DOCS)


# runs

def plain_runs(words, least=6, repeats=4):
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, repeats * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_digest(words):
    found = plain_runs(words)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    text = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return len(found), s, n, q, 1000 * n // q if found else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def word_texts(seed, n):
    draw, out = random.Random(seed), [None, "", " \t\n", "a", "a a a a a a", "a\x0ba\x0ca\ra a\ta", "x\x1cx x\x85x é é é é é é é", "a b a b a b a b " * 300]
    while len(out) < n:
        letters = "abcdefghijklmnop"[:draw.choice([1, 2, 2, 3, 16])]
        words = [draw.choice(letters) for _ in range(draw.choice([1, 5, 6, 7, 40, 300]))]
        if draw.random() < 0.5:
            a = draw.randrange(len(words))
            p = min(draw.randint(1, 9), len(words) - a)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
        out.append(draw.choice([" ", "  ", "\n", "\t "]).join(words))
    return out


@pytest.mark.parametrize("limits", [(200_000, 1 << 20), (50, 7)])
def test_word_runs(spark, monkeypatch, limits):
    monkeypatch.setattr(runs, "WORDS", limits[0])
    monkeypatch.setattr(runs, "CANDIDATES", limits[1])
    texts = word_texts(1, 160)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    letters = {}
    for at in range(0, len(texts), 37):  # the functions of a task, with the limits of this test
        found, collapsed = runs._runs_of([t if t is None else t.encode() for t in texts[at:at + 37]], 6, 4)
        for w, r, c in zip(words[at:], found.to_pylist(), collapsed):
            assert [(x["start"], x["length"], x["period"]) for x in r] == plain_runs(w)
            drop = {i for s, n, q in plain_runs(w) for i in range(s + q, s + n)}
            assert c.decode() == " ".join(x for i, x in enumerate(w) if i not in drop)
            letters.update(dict.fromkeys(w))
    assert letters
    got = Counter(map(tuple, runs.digests(runs.word_runs(runs.with_planted_repeats(documents(spark, texts)))).collect()))
    want = Counter((i, *plain_digest(planted(i, w))) for i, w in enumerate(words))
    want[(3, *plain_digest(planted(3, words[3])))] += 1
    want[(None, *plain_digest("a a a a a a b".split()))] += 1
    assert got == want
    assert runs.digests(runs.word_runs(documents(spark, texts).limit(0))).count() == 0


def test_grammar_extends_as_letters_do():
    draw = np.random.default_rng(2)
    for size in (1, 2, 3, 9):
        body = draw.integers(0, size, 400)
        body[100:300] = np.tile(body[100:108], 25)
        letters = np.concatenate([[size], body, [size + 1]])
        grammar = runs.Grammar(np.unique(letters, return_inverse=True)[1])
        assert len(grammar.levels) < 60
        a = draw.integers(1, 399, 500)
        b = np.minimum(a + draw.integers(1, 50, 500), 400)
        a = np.minimum(a, b - 1)
        for forward in (True, False):
            got = grammar.extend(a, b, forward)
            for x, y, n in zip(a, b, got):
                m = 0
                while (letters[x + m] == letters[y + m]) if forward else (letters[x - 1 - m] == letters[y - 1 - m]):
                    m += 1
                assert n == m


# automaton search

def plain_terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_ranking(items, docs, k):
    held = [(d, Counter(plain_terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    terms = defaultdict(set)
    for i, t in items:
        if i is not None:
            terms[i] |= set(plain_terms(t))
    out = {}
    for i, wanted in terms.items():
        scores = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0 and d is not None:
                scores.append((-score, d))
        for rank, (score, d) in enumerate(sorted(scores)[:k], 1):
            out[(i, rank)] = (d, -score)
    return out


ITEMS = "item_id long, text string, term string, doc string, rank int"


@pytest.mark.parametrize("limit", [500_000, 6])
def test_ranked_search(spark, monkeypatch, limit):
    monkeypatch.setattr(scan, "TERMS", limit)
    draw = random.Random(4)
    vocabulary = ["a", "ab", "abc", "b", "Bc", "é", "É", "中文", "x1", "1", "ñandú", "o😀", "the", "rare", "K", "K"]
    parts = [" ", ".", "--", "\n", "_", "'", "\x00", "\x7f", "\x80x\x85 "]
    texts = ["", None, "...", "the", "the the THE", "a_b", "x" * 50_000, "the " * 30_000, "é" * 9]
    texts += ["".join(draw.choice(vocabulary) + draw.choice(parts) for _ in range(draw.choice([1, 3, 20, 200]))) for _ in range(120)]
    texts += texts[20:40]  # ties
    docs = documents(spark, texts)
    items = [(i, draw.choice(parts).join(draw.choice(vocabulary) for _ in range(draw.randint(1, 6))), "t", "d", 1) for i in range(20)]
    items += [(20, "", "t", "d", 1), (21, None, "t", "d", 1), (22, "unknown", "t", "d", 1), items[4], (5, "rare the", "t", "d", 1), (None, "the", "t", "d", 1)]
    got = {(r.item_id, r.rank): (r.doc_id, r.score) for r in scan.ranked_search(spark.createDataFrame(items, ITEMS), docs, k=7).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got == plain_ranking([i[:2] for i in items], rows, 7)
    assert scan.ranked_search(spark.createDataFrame(items, ITEMS), docs.limit(0)).count() == 0
    assert scan.ranked_search(spark.createDataFrame([], ITEMS), docs).count() == 0


def test_a_task_keeps_the_best_of_all_batches():
    draw = np.random.default_rng(5)
    best, all_scores = scan.Best(6, 4), draw.integers(0, 5, (90, 6))
    ids = draw.permutation(90)
    for at in range(0, 90, 13):
        best.offer(all_scores[at:at + 13], ids[at:at + 13])
    for item in range(6):
        want = sorted((-s, d) for s, d in zip(all_scores[:, item], ids) if s > 0)[:4]
        mine = best.item == item
        assert list(zip(-best.score[mine], best.doc[mine])) == want


# inner products

VECTORS = "vec_id long, embedding array<double>, v string, block int, query long, score double"


def vector_rows(seed, n, d):
    draw = np.random.default_rng(seed)
    base = draw.standard_normal((n, d)) * np.exp(draw.standard_normal((n, 1))) * np.linspace(1.5, 0.05, d)
    base[n // 3:2 * n // 3] = base[n // 3]  # a third is one vector
    base[5:9] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    odd = [None, [], [0.0] * d, [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [None] + [1.0] * (d - 1), [1.0, 2.0], [1e300] * d, [-1e-9] * d, [5e6 / d] * d]
    rows += [(n + i, v) for i, v in enumerate(odd)] + [rows[50], (None, rows[50][1]), (-50, rows[4][1])]
    return [(*r, "x", 1, 2, 3.0) for r in rows]


def plain_top(rows, d, k, least):
    whole = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v):
            ints = [math.floor(256 * x) for x in v]
            if sum(x * x for x in ints) < 2 ** 62:
                whole[i] = ints
    out = {}
    for q in whole:
        if q % least == 0:
            scores = sorted((-sum(x * y for x, y in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
            out.update({(q, rank): (i, -s) for rank, (s, i) in enumerate(scores[:k], 1)})
    return out


@pytest.mark.parametrize("sizes", [(8_192, 262_144, 2_048, 1_024, 65_536), (40, 3, 4, 16, 10)])
def test_top_products(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK", "QUERIES", "HEAD", "STEP", "PAIRS"), sizes):
        monkeypatch.setattr(inner_products, name, size)
    rows = vector_rows(6, 300, 10)
    df = spark.createDataFrame(rows, VECTORS)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in inner_products.top_products(df, df.where("vec_id % 10 = 0")).collect()}
    assert got == plain_top(rows, 10, 5, 10)
    few = df.where("vec_id IN (1, 10, 20)")
    assert {(r.query_id, r.rank, r.vec_id) for r in inner_products.top_products(few, few.where("vec_id = 10")).select("query_id", "rank", "vec_id").collect()} == {
        (10, rank, i) for rank, (_, i) in enumerate(sorted((-plain_top(rows, 10, 999, 10)[(10, r)][1], plain_top(rows, 10, 999, 10)[(10, r)][0])
                                                           for r in range(1, 300) if plain_top(rows, 10, 999, 10).get((10, r), (0,))[0] in (1, 20)), 1)}
    assert inner_products.top_products(df.limit(0), df).count() == 0 and inner_products.top_products(df, df.limit(0)).count() == 0


def test_bounds_spare_products():
    """On vectors whose length lies in a few directions most pairs are never multiplied out, and nothing is lost."""
    draw = np.random.default_rng(7)
    vectors = np.floor(256 * draw.standard_normal((6000, 32)) * np.geomspace(2, 0.02, 32) * np.exp(0.7 * draw.standard_normal((6000, 1)))).astype(np.int64)
    block = inner_products.Block(vectors, [[i] for i in range(6000)], inner_products.Rotation(vectors))
    queries = vectors[::60]
    r, c, score = block.search(queries, np.full(100, -(2 ** 62)), 5)
    want = np.sort(queries @ vectors.T, axis=1)[:, :-6:-1]
    assert (score.reshape(100, 5) == want).all() and ((queries[r] * block.vectors[c]).sum(1) == score).all()
    assert block.multiplied < 0.05 * len(queries) * 6000 and block.bounded < 0.8 * len(queries) * 6000


@pytest.mark.parametrize("name", ["op11_word_runs", "op12_automaton_search", "op13_top_products"])
def test_against_sql(spark, sf, name):
    assert mismatch(spark_rows(entry.queries()[name](spark, sf)), duck_rows(connect(sf), entry.oracle_sql()[name])) is None
