"""Packing, chat formatting, BPE, line dedup, repeats, SimHash and toxicity against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fabsight.llm import chat, minhash, similar, toxicity
from fabsight.llm.bpe import SpeculativeBpe, digests, encode_documents
from fabsight.llm.lines import drop_boilerplate
from fabsight.llm.minhash import drop_near_copies
from fabsight.llm.packing import cuts, harmonic_pack
from fabsight.llm.repeats import drop_repeats, merged, repeat_digests
from fabsight.llm.simhash import covering_masks, fingerprint, keep_one, local_links, simhash_groups
from fabsight.llm.toxicity import drop_toxic

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "\n", "a", "A  b\n\n c", "éß 中文 😀", "it's   we'll 123 ²", "x" * 3000, "<|endoftext|> <|startoftext|>", "a,b. c,.", "\x1c\x85 "]
SCHEMA = "doc_id long, text string, source string, key long, part int, fp long, host string, row string, spans string, label string"


def odd_documents(spark, texts=ODD):
    """Null ids, repeated rows, other columns with the names of helper columns."""
    rows = [(i, t, ["s", None][i % 2], 1, 2, 3, "h", "r", "s", "l") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, "lost", "s", 1, 2, 3, "h", "r", "s", "l")], SCHEMA)


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# packing

def check_packing(rows, docs):
    library = Tokenizer.from_file(WORD)
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    want = Counter()
    for d, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want[(d, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))] += 1
        mine = sorted((r.start, r.length, r.ids_crc32) for r in pieces[d] if r.doc_tokens == len(ids))
        for start, length, crc in mine:
            assert zlib.crc32(np.array(ids[start:start + length], dtype="<u4").tobytes()) == crc
        assert sum(n for _, n, _ in mine) == len(ids) * sum(1 for e, t in docs if (e, t) == (d, text))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(places)


def test_cuts_are_reciprocals():
    for n in (0, 1, 2, 4095, 4096, 4097, 10_000, 123_457):
        assert sum(cuts(n)) == n
        assert all(4096 // (4096 // x) == x for x in cuts(n))


def test_packing(spark, sf):
    docs = documents(spark, sf)
    rows = harmonic_pack(docs, WORD).collect()
    sequences = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert sequences <= sum(r.length for r in rows) / 4096 * 1.02 + 1


def test_packing_odd(spark):
    docs = odd_documents(spark)
    check_packing(harmonic_pack(docs, WORD).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert harmonic_pack(docs.limit(0), WORD).count() == 0


# chat formatting

def test_chat_round_trip(spark):
    pieces = ["<|im_end|>", "<|im_start|>", "\n", "%25", "%0A", "%7C", "|", "%", "assistant", "<|im_end|>\n", "é😀", "a b", "<", "<|im_end|"]
    draw = random.Random(3)
    rows = [(c, t, draw.choice(["user", "assistant", "system", None, "us\ner", "<|im_end|>", "assistant\n"]),
             draw.choice([None, "", "".join(draw.choice(pieces) for _ in range(draw.randint(0, 8)))]), "x", "y")
            for c in range(120) for t in range(draw.randint(1, 6))]
    rows += [(None, None, "assistant", "lost", "x", "y"), (7, 0, "user", "again", "x", "y"), (7, 0, "user", "again", "x", "y"), (900, 0, "assistant", "w " * 50_000, "x", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, length string, span string")
    chats = {r.conv_id: r for r in chat.format_chats(df).collect()}
    mine = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    by = defaultdict(list)
    for c, t, role, text, *_ in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(chats) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        assert [(t.role, t.text) for t in chats[c].turns] == [x[1:] for x in turns]
        loss = "".join(text for _, role, text in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        assert mine[c].n_turns == len(turns) and mine[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert mine[c].loss_chars == len(loss) and mine[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert mine[c].formatted_chars == len(chats[c].formatted)
        assert chats[c].formatted.count("<|im_end|>") == chats[c].formatted.count("<|im_start|>") == len(turns)
    assert chat.format_chats(df.limit(0)).count() == 0


# byte-level BPE

def test_bpe_equals_library():
    bpe, library = SpeculativeBpe.of(BYTE), Tokenizer.from_file(BYTE)
    draw = random.Random(1)
    pieces = ["a", "b", "aa", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "中", "😀", "'s", "'ll", "'", "1", "23", "²", "!", "...", "<|endoftext|>", "<|endof", "the", "ing",
              " th", "x" * 90, "-" * 40, "\r\n", "_", "İ", "Σ", "\x00"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 40))) for _ in range(3000)] + ["ab" * 20_000, "z" * 70_000]
    ids = bpe.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [bpe.decode(x) for x in ids] == texts


def test_border_test_equals_merging():
    bpe, draw = SpeculativeBpe.of(BYTE), random.Random(4)
    tokens = [i for s, i in bpe.ids_of.items() if len(s) < 8]
    a, b = (np.array([draw.choice(tokens) for _ in range(20_000)]) for _ in range(2))
    exact = [bpe.merge(bpe.token_bytes[x] + bpe.token_bytes[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert bpe.compatible(a, b).tolist() == exact


def test_bpe_odd(spark):
    docs = odd_documents(spark)
    library = Tokenizer.from_file(BYTE)
    rows = digests(encode_documents(docs, BYTE)).collect()
    want = []
    for r in docs.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids, dtype="<u4")
        want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert encode_documents(docs.limit(0), BYTE).count() == 0


# lines

@pytest.mark.parametrize("most", [1 << 20, 0])
def test_lines_odd(spark, monkeypatch, most):
    monkeypatch.setattr("fabsight.llm.lines.BROADCAST_LINES", most)
    rows = [(i, f"menu\nown {i}\n\nmenu", "big" if i < 30 else None, "x") for i in range(60)] + [(99, None, "big", "x"), (98, "", "big", "x"), (97, "menu", "small", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, line string")
    got = sorted(map(tuple, drop_boilerplate(docs).collect()), key=str)
    cut = lambda t, s: t if t is None or s == "small" else "\n".join(x for x in t.split("\n") if x != "menu")
    assert got == sorted([(d, cut(t, s), s, x) for d, t, s, x in rows], key=str)
    assert drop_boilerplate(docs.limit(0)).count() == 0


# repeats

def removed(docs, least):
    counts = Counter()
    for _, t in docs:
        b = (t or "").encode()
        counts.update(b[i:i + least] for i in range(len(b) - least + 1))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        runs = merged([(i, i + least) for i in range(len(b) - least + 1) if counts[b[i:i + least]] > 1])
        kept, at = b"", 0
        for s, e in runs:
            kept, at = kept + b[at:s], e
        out.append((d, len(b), sum(e - s for s, e in runs), len(runs), hashlib.sha256(kept + b[at:]).hexdigest()))
    return sorted(out, key=str)


def patchwork(seed, n=150):
    draw = random.Random(seed)
    shared = ["".join(draw.choice("abcdé \n") for _ in range(draw.randint(30, 400))) for _ in range(20)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(draw.randint(0, 6)):
            p = draw.choice(shared)
            parts.append(draw.choice([p[draw.randint(0, 20):len(p) - draw.randint(0, 20)], p, draw.choice("xyz") * draw.randint(1, 500), "ab" * draw.randint(1, 200),
                                      "".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 300)))]))
        out.append((i, "".join(parts) if draw.random() > 0.05 else None))
    return out + [out[3], (None, "lost"), (900, out[5][1])]


@pytest.mark.parametrize("least", [64, 200])
def test_repeats(spark, least):
    rows = patchwork(least)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, k1 int")
    assert sorted(map(tuple, repeat_digests(docs, least).collect()), key=str) == removed(rows, least)
    assert repeat_digests(docs.limit(0)).count() == 0


def test_repeats_of_large_groups(spark, monkeypatch):
    """Groups beyond what a task sorts are counted by string, with the same result."""
    from fabsight.llm import repeats

    monkeypatch.setattr(repeats, "GROUP", 3)
    rows = patchwork(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, repeat_digests(docs, 64).collect()), key=str) == removed(rows, 64)


def test_drop_repeats_keeps_columns_and_characters(spark):
    rows = [(1, "é" * 300 + "tail", "a"), (2, "head" + "é" * 300, "b"), (3, None, "c"), (4, "alone", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    assert sorted(map(tuple, drop_repeats(docs).collect())) == [(1, "tail", "a"), (2, "head", "b"), (3, None, "c"), (4, "alone", "d")]


# SimHash

def plain_fingerprint(text, n):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_covering_masks_guarantee():
    draw = random.Random(5)
    for radius in (1, 2, 3):
        for positions in (list(range(64)), list(range(3, 40, 3))):
            masks = covering_masks(radius, positions, 9)
            for _ in range(500):
                differ = sum(1 << p for p in draw.sample(positions, radius))
                assert any(m & differ == 0 for m in masks)


def components(values, linked):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_large_buckets_are_covered_again(monkeypatch):
    from fabsight.llm import simhash

    monkeypatch.setattr(simhash, "BUCKET", 16)
    draw = random.Random(6)
    values = np.unique(np.array([sum(1 << draw.choice(range(20)) for _ in range(draw.randint(0, 6))) for _ in range(400)], dtype=np.uint64))
    edges = [tuple(e) for pairs in local_links(values, 2, list(range(20))) for e in pairs.tolist()]
    want = components(list(range(len(values))), lambda a, b: (int(values[a]) ^ int(values[b])).bit_count() <= 2)
    assert components(list(range(len(values))), lambda a, b: (a, b) in set(edges) or (b, a) in set(edges)) == want


def test_simhash_groups(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text").union(odd_documents(spark).where("doc_id IS NOT NULL").select(F.col("doc_id") + 100_000, "text"))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    fps = {t: plain_fingerprint(t, 3) for _, t in rows}
    groups = components(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for d, t in rows:
        g = groups[fps[t]]
        least[g] = min(least.get(g, d), d)
    got = sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash_groups(docs).collect())
    assert got == sorted((d, fps[t], least[groups[fps[t]]]) for d, t in rows)
    assert fingerprint("A b\x0bC d", 3) == plain_fingerprint("A b\x0bC d", 3)


def test_keep_one(spark):
    docs = odd_documents(spark)
    kept = keep_one(docs, 5, 3)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids[0] == 0 and not {1, 2, 3} & set(ids) and ids.count(5) == 1
    assert keep_one(docs.limit(0), 5, 3).count() == 0


def plain_staying(docs, words=5, similarity=0.8):
    """(id, text) that stay: by id, unless similar to one that stays; every pair is compared."""
    stay = []
    for _, i, text in sorted({(i is None, i or 0, t or "") for i, t in docs}):
        found = text.encode().lower().split()
        own = {tuple(found[k:k + words]) for k in range(max(1, len(found) - words + 1))} if found else set()
        if all(len(own & s) < similarity * len(own | s) - 1e-9 if own or s else False for *_, s in stay):
            stay.append((i, text, own))
    return sorted((i, t) for i, t, _ in stay)


def planted_copies(seed, groups=40, lengths=(60, 400)):
    """Texts with copies of which from 0.3 % to 6 % of the words are replaced: similarities from below 0.6 to 1, chains too."""
    draw = random.Random(seed)
    rows = []
    for g in range(groups):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(*lengths))]
        for k in range(6):
            new = list(words)
            for at in draw.sample(range(len(new)), max(1, round(len(new) * draw.uniform(0.003, 0.06)))):
                new[at] = f"x{draw.randrange(5000)}"
            rows.append((draw.randrange(10 ** 6), " ".join(new)))
            words = new if k % 2 else words
    return rows


def similarities(rows):
    """Jaccard similarities of different texts that share a shingle."""
    sets = {t: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows}
    return [len(a & b) / len(a | b) for n, a in enumerate(sets.values()) for b in list(sets.values())[:n] if a & b]


@pytest.mark.parametrize("block", [512, 3])
def test_near_copies_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rows = planted_copies(11)
    between = np.histogram(similarities(rows), [0.6, 0.8, 0.9, 1.0])[0]
    assert (between > 10).all()
    rows += [(i, t) for i, t in enumerate(ODD)] + [rows[3], (10 ** 7, rows[5][1]), (None, rows[7][1]), (None, "alone with no id")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key long")
    kept = drop_near_copies(docs, 5)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == plain_staying(rows)
    assert drop_near_copies(docs.limit(0), 5).count() == 0


def test_keep_one_looks_at_shingles(spark):
    """Fingerprints within the radius are no reason to drop a text that is not similar."""
    rows = planted_copies(12, groups=30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in keep_one(docs, 5, 6).collect()}
    sets = {t: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows}
    gone = [t for i, t in rows if i not in kept]
    assert gone
    for t in gone:
        assert any(len(sets[t] & sets[k]) >= 0.8 * len(sets[t] | sets[k]) for k in kept.values())


def test_near_copies_of_one_dense_group(spark):
    """A group of more than a block, of which many stay."""
    draw = random.Random(13)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if draw.random() > 0.03 else f"x{draw.randrange(99)}" for w in words)) for i in range(1300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in drop_near_copies(docs, 5).collect()) == plain_staying(rows)


def test_candidates_of_the_pipeline_come_from_fingerprints_too(spark):
    """Texts of one fingerprint without a common band; they are not similar, so both stay."""
    draw = random.Random(14)
    rows = [(i, " ".join(["x"] * 500 + [f"w{draw.randrange(10 ** 6)}" for _ in range(150)])) for i in range(2)] + [(2, "something else altogether stands here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {radius: {r.doc_id: r.component for r in minhash.candidate_groups(docs, 5, radius).collect()} for radius in (None, corpus_pipeline.RADIUS)}
    assert len(set(groups[None].values())) == 3
    assert groups[corpus_pipeline.RADIUS][0] == groups[corpus_pipeline.RADIUS][1] != groups[corpus_pipeline.RADIUS][2]
    near = rows + [(i + 10, f"{t} end") for i, t in planted_copies(15, groups=10)[:40]]
    docs = spark.createDataFrame(near, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted((r.doc_id, r.text) for r in stage(spark, docs, "").collect()) == plain_staying(near)


# toxicity

def plain_scores(docs, labels):
    """Everything anew, from texts and labels: terms, weights, all cosines, votes, calibration; (cosines, score) by text."""
    learn = {d: t for d, t in labels if d is not None and t is not None and zlib.crc32(str(d).encode()) % 3 != 1}
    texts = {(d, t or "") for d, t in docs if d in learn}
    copies = Counter((d, t or "") for d, t in docs)
    words = lambda t: Counter(toxicity.WORD.findall(t.lower()))

    def all_terms(t):
        out = Counter()
        for w, n in words(t).items():
            for x in {w, *(w[:k] + "-" for k in (4, 5, 6) if len(w) > k)}:
                out[x] += n
        return out

    seen = [Counter(), Counter()]
    for d, t in texts:
        seen[learn[d]].update(set(all_terms(t)))
    n = [sum(learn[d] == c for d, _ in texts) for c in (0, 1)]
    known = {}
    for x in set(seen[0]) | set(seen[1]):
        t, c, total = seen[1][x], seen[0][x], sum(n)
        g2 = sum(2 * o * np.log(o / e) for o, e in ((t, (t + c) * n[1] / total), (c, (t + c) * n[0] / total), (n[1] - t, (total - t - c) * n[1] / total),
                                                    (n[0] - c, (total - t - c) * n[0] / total)) if o > 0)
        beyond = max(g2 - toxicity.CHANCE, 0)
        speaks = beyond / (beyond + toxicity.HALF) * max(1 - (c / n[0]) / (t / n[1]), 0) if t else 0.0
        if speaks > 0 or not x.endswith("-"):
            known[x] = speaks
    frequency = Counter(x for _, t in docs for x in set(all_terms(t or "")) if x in known)
    weight = {x: (np.log((1 + len(docs)) / (1 + frequency[x])) + 1) * (toxicity.PLAIN + s) for x, s in known.items()}

    def vector(t):
        v = {x: (1 + np.log(k)) * weight[x] for x, k in all_terms(t).items() if x in known}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {x: y / norm for x, y in v.items()} if norm else {}

    examples = [(d, learn[d], vector(t), copies[(d, t)]) for d, t in sorted(texts)]
    rows = Counter(learn.values())
    stands = {c: sum(k for _, x, _, k in examples if x == c) for c in (0, 1)}
    vote = np.array([k * rows[c] / stands[c] for _, c, _, k in examples])
    vote *= len(examples) / vote.sum()
    toxic = np.array([c for _, c, _, _ in examples])
    prior = (vote * toxic).sum() / vote.sum()

    def votes(v, without=None):
        cosine = np.array([round(sum(y * e.get(x, 0.0) for x, y in v.items()), 12) for *_, e, _ in examples])
        if without is not None:
            cosine[without] = 0
        near = np.argsort(-cosine, kind="stable")[:toxicity.NEIGHBOURS]
        near = near[cosine[near] > 0]
        w = cosine[near] ** 2 * vote[near]
        return cosine[near], (w @ toxic[near] + toxicity.PRIOR_WEIGHT * prior) / (w.sum() + toxicity.PRIOR_WEIGHT)

    return [(t, *votes(vector(t or ""))) for _, t in docs]


def test_cosines_and_votes_equal_brute_force(spark):
    draw = random.Random(11)
    plain = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(260):
        words = draw.choices(plain, k=draw.randint(4, 40))
        if d % 5 == 0:
            words += draw.choices(["grobian", "grobianisch", "lout", "loutish"], k=draw.randint(1, 3))
        rows.append((d, " ".join(words)))
    rows += [(300, ""), (301, None), (302, "unheard"), rows[7], rows[10], rows[10], (12, "another text of w1 w2")]
    labels = [(d, int(d % 5 == 0)) for d in range(0, 260, 2)] + [(7, 0), (12, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, texts = toxicity.train(docs, spark.createDataFrame([(d, 0, t) for d, t in dict(labels).items()], "doc_id long, quality int, toxic int"))
    terms, m = model.value
    finder = toxicity.Finder(terms)
    for text, cosine, votes in plain_scores(rows, dict(labels).items()):
        near, found = m.nearest(*finder.find(text or ""))
        assert len(found) == len(cosine) and np.allclose(found, cosine, atol=1e-11)
        # of equal cosines at the border another example may be taken
        if len(cosine) and (len(cosine) < toxicity.NEIGHBOURS or np.diff(cosine)[-1] < -1e-9):
            ranked = np.sort(cosine)[::-1]
            if (np.abs(np.diff(ranked)) > 1e-9).all():
                assert m.votes(near, found) == pytest.approx(votes)
    assert m.skipped > 0


def test_terms_of_many_texts_equal_words_and_beginnings(monkeypatch):
    terms = ["straße", "ıi̇", "a_b", "7", "été", "été-", "lout", "lout-", "louti-", "loutis-", "x"]
    finder = toxicity.Finder(terms)
    draw = random.Random(3)
    odd = ["Straße", "İ", "a_b", "7", "ÉTÉ", "étés", "Lout", "loutish", "LOUTIS", "louts", "x", "－x", "x²", "«x»", "x\u00a0x", "日本", "\u0301x", "x\0x", "é\n\nx"]
    texts = ["", " \n", *odd, *("".join(draw.choice(odd) + draw.choice([" ", "\n", "–", "… ", "", "\u2028"]) for _ in range(draw.randint(1, 60))) for _ in range(200)), ""]
    at, index, counts = finder.find_all(texts)
    for i, t in enumerate(texts):
        words = Counter(toxicity.WORD.findall(t.lower()))
        plain = Counter()
        for w, n in words.items():
            for x in {w, *(w[:k] + "-" for k in (4, 5, 6) if len(w) > k)} & set(terms):
                plain[terms.index(x)] += n
        assert list(zip(index[at[i]:at[i + 1]].tolist(), counts[at[i]:at[i + 1]].tolist())) == sorted(plain.items()), t
        assert [x.tolist() for x in finder.find(t)] == [index[at[i]:at[i + 1]].tolist(), counts[at[i]:at[i + 1]].tolist()]
    monkeypatch.setattr(toxicity, "PART_ROWS", 7)
    monkeypatch.setattr(toxicity, "PART_CHARS", 50)
    assert [t for part in toxicity.parts(texts) for t in part] == texts


def test_common_terms_have_no_postings_and_texts_meet_examples_together(spark, monkeypatch):
    draw = random.Random(5)
    words = [f"c{i}" for i in range(30)] + [f"r{i}" for i in range(900)]
    rows = [(d, " ".join(draw.choices(words[:30], k=40) + draw.choices(words[30:], k=12) + ["vile"] * (d % 4 == 0))) for d in range(400)]
    rows += [(d + 400, rows[d][1]) for d in range(0, 100, 4)] + [(900, ""), (901, "unheard")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, 0, int(d % 4 == 0)) for d in range(425)], "doc_id long, quality int, toxic int")
    terms, m = toxicity.train(docs, labels)[0].value
    held = Counter(x for t in {(i, t) for i, t in rows if i in m.ids} for x in set(t[1].split()))
    common = {x for x in held if held[x] >= 0.05 * len(m.ids)}
    # most words of a text are common: their postings were most of the work
    assert common >= set(words[:30]) and len(m.post_example) == sum(n for x, n in held.items() if x not in common)
    found = toxicity.Finder(terms).find_all([t for _, t in rows])
    at, index, counts = found
    vectors = np.zeros((len(rows), len(terms)))
    vectors[np.repeat(np.arange(len(rows)), np.diff(at)), index] = m.vectors(*found)
    texts = dict(rows)
    which = [next(i for i, r in enumerate(rows) if r[0] == d) for d in m.ids]
    assert len(texts) == len(rows)
    cosines = np.round(vectors @ vectors[which].T, 12)
    together = m.nearest_all(*found)
    for i, (near, cosine) in enumerate(together):
        best = np.lexsort((np.arange(len(which)), -np.round(cosines[i], 10)))[:toxicity.NEIGHBOURS]
        best = best[cosines[i][best] > 0]
        assert near.tolist() == best.tolist() and np.allclose(cosine, cosines[i][best], atol=1e-11)
    # alone, or in other groups, the same to the last bit
    for group, postings in ((1, 1 << 20), (7, 1 << 20), (64, 100)):
        monkeypatch.setattr(toxicity, "GROUP_ROWS", group)
        monkeypatch.setattr(toxicity, "GROUP_POSTINGS", postings)
        assert all(a.tolist() == c.tolist() and b.tolist() == d.tolist() for (a, b), (c, d) in zip(together, m.nearest_all(*found), strict=True))


def test_a_repeated_label_row_is_one_example(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "EXAMPLES", 20)
    rows = [(d, f"text {d} {'vile' if d % 3 == 0 else 'kind'} word{d % 7}") for d in range(90)]
    rows += [rows[3]] * 500 + [(6, f"other {i} vile") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, 0, int(d % 3 == 0)) for d in range(90)], "doc_id long, quality int, toxic int")
    _, m = toxicity.train(docs, labels)[0].value
    assert 25 < len(m.ids) <= 40


def test_toxicity_held_out(spark, sf):
    folder = sf.replace("0.001", "0.1")
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n.get((1, 1), 0) / (n.get((1, 1), 0) + n.get((1, 0), 0)) > 0.85
    assert n.get((0, 1), 0) / (n.get((0, 1), 0) + n[(0, 0)]) < 0.01
    scores = toxicity.toxicity(docs, labels).select("score", F.size("evidence").alias("n"))
    assert scores.where("n = 15").count() > 0.99 * docs.count() and scores.select("score").distinct().count() > 0.85 * docs.count()


def test_toxicity_odd(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.toxicity(docs, none).collect()} == {(0.0, 0)}
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(12)] + [(3, 0, None), (3, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
