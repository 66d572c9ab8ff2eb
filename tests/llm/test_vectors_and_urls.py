"""URL rules, the forest and the multi-index against brute force, and the registered queries and pipeline."""

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fabsight.llm.components import connected
from fabsight.llm.forest import forest_links
from fabsight.llm.multi_index import search, walk
from fabsight.llm.url_rules import judge_urls
from tests.compare import connect, duck_rows, mismatch, spark_rows

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/x", "block"), ("com", "", "block"), ("b.com", "/", "allow"), ("b.com", "/", "block"),
         ("a.b.com", "/p", "allow"), (None, "/", "block"), ("é.org", "/é", "block")]
URLS = ["http://example.net/en/", "HTTPS://WWW.Example.NET/en/xy?q", "http://example.net", "http://net/", "http://xnet/", "http://b.com", "http://b.com/", "x://a.b.com/pq#f",
        "http://a.b.com:80/p", "no scheme", "", None, "://", "http://?q", "http://.net/", "http://é.org/éa", "http://com", "http://a.com?x/y", "http://b.com/\n/x"]


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    *_, verdict, rule = max(fits)
    return host, path, rule, verdict


@pytest.mark.parametrize("parts", ["1", "5"])
def test_url_rules(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [(i, u, "h", "p") for i, u in enumerate(URLS)] + [(1, URLS[1], "h", "p"), (None, URLS[0], "h", "p")]
        pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string")
        rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
        got = sorted(map(tuple, judge_urls(pages, rules).collect()), key=str)
        assert got == sorted([(i, *plain_verdict(u, RULES)) for i, u, *_ in rows], key=str)
        assert {r.verdict for r in judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
        assert judge_urls(pages.limit(0), rules).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_url_rules_of_nested_hosts(spark):
    """Many open hosts at once, hosts and rules over several ranges, siblings that only begin alike."""
    rng = np.random.default_rng(8)
    host = lambda: ".".join(rng.choice(["a", "ab", "b", "a-", "é", ""], rng.integers(1, 6)))
    path = lambda: "".join(rng.choice(["/", "/x", "/xy", "/é", "\U0001f600"], rng.integers(0, 4)))
    rules = sorted({(host(), path()): str(rng.choice(["allow", "block"])) for _ in range(150)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [(i, f"http://{host()}{path()}") for i in range(1500)]
    known = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted(map(tuple, judge_urls(spark.createDataFrame(urls, "page_id long, url string"), known).collect()))
    assert got == [(i, *plain_verdict(u, rules)) for i, u in urls]
    assert len({r[3] for r in got}) > 40


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 160), (None, 3)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 150, 160: 150, 200: 150}


def vector_rows(seed, n=600, d=24):
    draw = np.random.default_rng(seed)
    base = draw.standard_normal((n, d))
    for i in range(0, n // 2, 3):
        base[i + 1] = base[i] + draw.standard_normal(d) * 0.28 * draw.random() * np.linalg.norm(base[i]) / np.sqrt(d)
        base[i + 2] = base[i] * 2 if i % 2 else base[i]
    base[n // 2:n // 2 + 80] = base[n // 2] + draw.standard_normal((80, d)) * 0.05
    rows = [(i, [float(x) for x in v], "x", 1.5) for i, v in enumerate(base.astype(np.float32))]
    odd = [None, [], [0.0] * d, [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [None] + [1.0] * (d - 1), [1.0, 2.0]]
    return rows + [(n + i, v, "x", 1.5) for i, v in enumerate(odd)] + [rows[4], (n + 100, rows[0][1], "x", 1.5)], d


SCHEMA = "vec_id long, embedding array<float>, v string, score double"


def usable(v, d):
    return v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block", [4096, 32])
def test_forest(spark, monkeypatch, block):
    from fabsight.llm import forest

    monkeypatch.setattr(forest, "BLOCK", block)
    monkeypatch.setattr(forest, "LEAF", 60)
    rows, d = vector_rows(1)
    fine = [(i, np.array(v, dtype=np.float64)) for i, v, *_ in rows if usable(v, d)]
    m = np.stack([v / np.linalg.norm(v) for _, v in fine])
    linked = m @ m.T >= 0.95
    got = {}
    for r in forest_links(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.vec_id, r)
    want = linked.sum(1) - 1
    found = np.array([got[i].n_links for i, _ in fine])
    assert (found <= want).all() and found.sum() >= 0.995 * want.sum()
    root = list(range(len(fine)))
    for a, b in zip(*np.nonzero(linked)):
        x, y = int(a), int(b)
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        low, high = sorted((x, y), key=lambda k: fine[k][0])
        root[high] = low
    right = 0
    for k, (i, _) in enumerate(fine):
        x = k
        while root[x] != x:
            x = root[x]
        right += got[i].component_id == fine[x][0]
    assert right >= 0.99 * len(fine)
    for i, v, *_ in rows:
        if not usable(v, d):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert forest_links(spark.createDataFrame([], SCHEMA)).count() == 0


def exact_search(rows, d, k, least=20):
    fine = {i: np.array(v, dtype=np.float64) for i, v, *_ in rows if usable(v, d)}
    ids = np.array(sorted(fine))
    m = np.stack([fine[i] for i in ids])
    out = {}
    for q in ids[ids % least == 0]:
        score = (m * fine[q]).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_search_of_everything_is_exact(spark):
    rows, d = vector_rows(2)
    df = spark.createDataFrame(rows, SCHEMA)
    want = exact_search(rows, d, 20)
    got = {}
    for r in search(df, df.where("vec_id % 20 = 0"), visit=1.0, centroids=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    for q, found in want.items():
        assert [x[0] for x in got[q]] == [x[0] for x in found]
        assert np.allclose([x[1] for x in got[q]], [x[1] for x in found], rtol=1e-12)
    few = df.where("vec_id < 6")
    assert search(few, few.where("vec_id = 0")).count() == 5
    assert search(df.limit(0), df).count() == 0 and search(df, df.limit(0)).count() == 0


def test_search_recall(spark, sf):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet")
    want = exact_search([tuple(r) for r in df.collect()], 64, 20)
    got = {}
    for r in search(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[q] & {v for v, _ in found}) / len(found) for q, found in want.items()])
    assert recall >= 0.9


def test_walk_is_in_order():
    draw = np.random.default_rng(3)
    left, right, sizes = draw.random(7), draw.random(5), draw.integers(0, 3, (7, 5))
    cells = walk(left, right, sizes, float(sizes.sum()))
    score = [left[a] + right[b] for a, b in cells]
    assert score == sorted(score, reverse=True) and sum(sizes[c] for c in cells) == sizes.sum()


@pytest.mark.parametrize("name", ["op2_chat_format", "op3_url_rules", "op6_line_dedup"])
def test_against_sql(spark, sf, name):
    assert mismatch(spark_rows(entry.queries()[name](spark, sf)), duck_rows(connect(sf), entry.oracle_sql()[name])) is None


def test_pipeline(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "passage_dedup", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.durable(stage(spark, docs, sf))
        assert docs.columns == columns
        after = docs.count()
        assert after <= before if name in ("toxicity", "near_dedup") else after == before
        before = after
        assert docs.where("n_chars <> length(text)").count() == 0
    assert corpus_pipeline.run(spark, sf).count() > 0
