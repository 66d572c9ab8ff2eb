"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled rows (``EXAMPLES`` of each class) gives the examples, with all their words and those word beginnings
that mark the toxic ones.  A term weighs its inverse document frequency over all documents, more the more it speaks for the
label and ``PLAIN`` of that if it does not: no word is left out, but a language as such makes nobody a neighbour of the toxic.
Examples lie in a block-max inverted index: for every term and block of examples the largest weight is known, so blocks that
cannot reach the k-th best cosine are skipped and the k nearest are exact.  The terms that most examples share have no postings:
their weights are a matrix, which many documents meet at once.
"""

from __future__ import annotations

import functools
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from fabsight.llm.common import durable, session, text_or_empty

#: Labelled rows of each class that the fit sees at most; weight of a term that says nothing about the label.
EXAMPLES, PLAIN = 1000, 0.3
#: G-squared that chance reaches once in a thousand, and how much beyond it a term needs for half of its full weight.
CHANCE, HALF = 10.83, 20.0
NEIGHBOURS, BLOCK, PRIOR_WEIGHT, THRESHOLD = 15, 64, 0.5, 0.7
BEGINNINGS = (4, 5, 6)
WORD = re.compile(r"\w+")
#: A term is common if this share of the examples holds it; of very many the COMMON most frequent ones are.
COMMON, COMMON_SHARE = 512, 0.05
#: Texts whose terms are looked up together: rows, and characters beyond which a text is the last.
PART_ROWS, PART_CHARS = 1000, 1 << 22
#: Texts that meet the examples together: rows, and postings of their terms; also products that are summed together.
GROUP_ROWS, GROUP_POSTINGS = 64, 1 << 20


def beginnings(words) -> set[str]:
    """Word beginnings, marked by a trailing hyphen."""
    return {w[:k] + "-" for w in words for k in BEGINNINGS if len(w) > k}


def parts(texts: list[str]) -> Iterator[list[str]]:
    """Stretches of the texts that are looked at together."""
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if len(part) == PART_ROWS or chars >= PART_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + n[0] - 1, start[1] .. and so on."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _sums(at: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Sums of the weights by place 0 to n - 1, added in their order."""
    return np.bincount(at, weights=weights, minlength=n).astype(np.float64, copy=False)  # of nothing it would be integers


@functools.cache
def _letters() -> np.ndarray:
    """By code point, whether it belongs to words."""
    found = np.zeros(sys.maxunicode + 1, dtype=bool)
    for m in WORD.finditer("".join(map(chr, range(sys.maxunicode + 1)))):
        found[m.start():m.end()] = True
    return found


def _occurrences(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words (``WORD``, lower case) of the texts, and for every occurrence its word and its text."""
    texts = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(texts).encode("utf-32-le"), dtype=np.uint32)
    points = np.where(_letters()[points], points, np.uint32(32))
    points[np.cumsum([len(t) + 1 for t in texts[:-1]], dtype=np.int64) - 1] = 10
    raw = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
    inside = raw > 32
    # words begin and end in turn
    borders = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    offsets = np.cumsum([0, *(borders[1::2] - borders[::2])], dtype=np.int32)
    words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(raw[inside])).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), np.searchsorted(np.flatnonzero(raw == 10), borders[::2])


class Finder:
    """The known terms of texts: words, and beginnings of words that start like one of them."""

    def __init__(self, terms: list[str]):
        self.terms = pa.array(terms, pa.string())
        begun = [i for i, t in enumerate(terms) if t.endswith("-")]
        self.beginnings, self.begun_at = pa.array([terms[i][:-1] for i in begun], pa.string()), np.array(begun, dtype=np.int64)
        self.heads = pa.array(sorted({terms[i][:BEGINNINGS[0]] for i in begun}), pa.string())

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(word, term), in order of the words, of all terms that different words stand for."""
        at = pc.index_in(words, value_set=self.terms).fill_null(-1).to_numpy()
        pairs = [(np.flatnonzero(at >= 0), at[at >= 0])]
        like = np.flatnonzero(pc.is_in(pc.utf8_slice_codeunits(words, 0, BEGINNINGS[0]), value_set=self.heads).to_numpy(zero_copy_only=False))
        words = words.take(pa.array(like))
        long = pc.utf8_length(words).to_numpy()
        for k in BEGINNINGS:
            at = pc.index_in(pc.utf8_slice_codeunits(words, 0, k), value_set=self.beginnings).fill_null(-1).to_numpy()
            held = (at >= 0) & (long > k)
            pairs.append((like[held], self.begun_at[at[held]]))
        word, term = (np.concatenate(x) for x in zip(*pairs))
        order = np.argsort(word, kind="stable")
        return word[order], term[order]

    def find_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms of every text in order and their counts: those of text i are at[i] to at[i + 1]."""
        words, word, text = _occurrences(texts)
        own, term = self._known(words)
        n = np.bincount(own, minlength=len(words))
        each = n[word]
        found = np.repeat(text, each) * len(self.terms) + term[_ranges((np.cumsum(n) - n)[word], each)]
        found, counts = np.unique(found, return_counts=True)
        at = np.searchsorted(found, np.arange(len(texts) + 1) * len(self.terms))
        return at, found - np.repeat(np.arange(len(texts)) * len(self.terms), np.diff(at)), counts.astype(np.float64)

    def find(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms in order, and their counts."""
        return self.find_all([text])[1:]


@dataclass
class ExampleIndex:
    """Unit vectors of the examples as postings by term, and by term and block the largest weight.

    An entry is a term in a block: entries of term t are ``term_at[t]`` to ``term_at[t + 1]``, the postings of entry e are
    ``entry_at[e]`` to ``entry_at[e + 1]``.  Common terms have none, but a row of ``common``, ``common_at[t]`` (else -1), with a
    column for every example of the blocks.  ``same[x]`` is the first example with the same vector as x.
    """

    weights: np.ndarray  # by term
    ids: np.ndarray  # document of each example
    toxic: np.ndarray
    vote: np.ndarray  # rows of the class that an example stands for
    prior: float  # share of toxic rows
    term_at: np.ndarray
    entry_block: np.ndarray
    entry_max: np.ndarray
    entry_at: np.ndarray
    post_example: np.ndarray
    post_weight: np.ndarray
    common_at: np.ndarray
    common: np.ndarray
    common_rough: np.ndarray  # the same in single precision
    same: np.ndarray
    votes_at: np.ndarray  # votes of examples left out, and the share of toxic rows there: the calibration
    share_at: np.ndarray
    skipped: int = 0
    met: int = 0

    def vectors(self, at: np.ndarray, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights, of length 1 for each text with the terms at[i] to at[i + 1]."""
        w, text = (1.0 + np.log(counts)) * self.weights[index], np.repeat(np.arange(len(at) - 1), np.diff(at))
        return w / np.sqrt(_sums(text, w * w, len(at) - 1))[text]

    def _postings(self, shape: tuple[int, int], text: np.ndarray, entries: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What the entries of the texts add to their cosines (text, example), in order of the terms."""
        n = self.entry_at[entries + 1] - self.entry_at[entries]
        post = _ranges(self.entry_at[entries], n)
        at = np.repeat(text * shape[1], n) + self.post_example[post]
        return _sums(at, np.repeat(weight, n) * self.post_weight[post], shape[0] * shape[1]).reshape(shape)

    def _shared(self, text: np.ndarray, example: np.ndarray, at: np.ndarray, place: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What the common terms add to the cosines of pairs, in order of the terms; those of text i are at[i] to at[i + 1]."""
        pair, which = np.unique(text * len(self.ids) + self.same[example], return_inverse=True)
        text, example = pair // len(self.ids), pair % len(self.ids)
        n, cosine = np.diff(at)[text], np.zeros(len(pair))
        step = max(1, GROUP_POSTINGS // max(1, int(n.max(initial=0))))
        for a in range(0, len(pair), step):
            m = n[a:a + step]
            own = _ranges(at[text[a:a + step]], m)
            products = w[own] * self.common[place[own], np.repeat(example[a:a + step], m)]
            cosine[a:a + step] = _sums(np.repeat(np.arange(len(m)), m), products, len(m))
        return cosine[which]

    def _group(self, at: np.ndarray, index: np.ndarray, counts: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        texts, blocks = len(at) - 1, -(-len(self.ids) // BLOCK)
        w, text = self.vectors(at, index, counts), np.repeat(np.arange(texts), np.diff(at))
        common = self.common_at[index] >= 0
        place, shared_w, shared_at = self.common_at[index[common]], w[common], np.searchsorted(text[common], np.arange(texts + 1))
        dense = np.zeros((texts, len(self.common)), dtype=np.float32)
        dense[text[common], place] = shared_w
        # single precision tells who comes into question, by a wide margin; what is found is summed in double precision
        near = 1e-4
        rough = dense @ self.common_rough
        index, w, text = index[~common], w[~common], text[~common]
        n = self.term_at[index + 1] - self.term_at[index]
        entries, weight, text = _ranges(self.term_at[index], n), np.repeat(w, n), np.repeat(text, n)
        block = self.entry_block[entries]
        bounds = _sums(text * blocks + block, weight * self.entry_max[entries], texts * blocks).reshape(texts, blocks)
        bounds += rough.reshape(texts, blocks, BLOCK).max(axis=2)
        first = np.zeros(bounds.shape, dtype=bool)
        np.put_along_axis(first, np.argsort(-bounds, axis=1, kind="stable")[:, :-(-k // BLOCK)], True, axis=1)

        def least(score: np.ndarray) -> np.ndarray:
            """The k-th best score of every text: scores only grow."""
            return np.partition(score, -k, axis=1)[:, -k, None] if score.shape[1] > k else np.zeros((texts, 1))

        now = first[text, block]
        rare = self._postings(rough.shape, text[now], entries[now], weight[now])
        # a block that ties the k-th may hold a smaller example; one that is left out stays below what is found
        rest = ~first & (bounds > 0) & (bounds >= least(rough + rare) - 3 * near)
        now = rest[text, block]
        rare += self._postings(rough.shape, text[now], entries[now], weight[now])
        self.met, self.skipped = self.met + int((first | rest).sum()), self.skipped + int((~first & ~rest & (bounds > 0)).sum())
        score = rough + rare
        text, example = np.nonzero((score > 0) & (score >= least(score) - 2 * near))
        cosine = np.round(self._shared(text, example, shared_at, place, shared_w) + rare[text, example], 12)
        order = np.lexsort((example, -cosine, text))
        text, example, cosine = text[order], example[order], cosine[order]
        start = np.searchsorted(text, np.arange(texts + 1))
        return [(example[a:b], cosine[a:b]) for a, b in zip(start[:-1], np.minimum(start[1:], start[:-1] + k))]

    def nearest_all(self, at: np.ndarray, index: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` for texts with the terms at[i] to at[i + 1]."""
        texts, out = len(at) - 1, []
        if not len(index) or not len(self.ids):
            return [(np.zeros(0, dtype=np.int64), np.zeros(0))] * texts
        postings = np.concatenate([[0], np.cumsum(self.entry_at[self.term_at[index + 1]] - self.entry_at[self.term_at[index]])])[at]
        while len(out) < texts:
            a = len(out)
            b = max(a + 1, min(a + GROUP_ROWS, texts, int(np.searchsorted(postings, postings[a] + GROUP_POSTINGS, side="right")) - 1))
            out += self._group(at[a:b + 1] - at[a], index[at[a]:at[b]], counts[at[a]:at[b]], k)
        return out

    def nearest(self, index, counts, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Examples and exact cosines of the k nearest with a positive cosine, ties to the smaller example."""
        index = np.asarray(index, dtype=np.int64)
        return self.nearest_all(np.array([0, len(index)]), index, np.asarray(counts, dtype=np.float64), k)[0]

    def votes(self, examples: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic votes, weighted by closeness and by the rows an example stands for, drawn to the prior where these are few."""
        w = cosines ** 2 * self.vote[examples]
        return float((w @ self.toxic[examples] + PRIOR_WEIGHT * self.prior) / (w.sum() + PRIOR_WEIGHT))

    def score(self, examples: np.ndarray, cosines: np.ndarray) -> float:
        """Calibrated share of toxic rows at these votes; a little of the votes themselves keeps equal shares in order."""
        if not len(examples):
            return self.prior
        votes = self.votes(examples, cosines)
        return 0.98 * float(np.interp(votes, self.votes_at, self.share_at)) + 0.02 * votes if len(self.votes_at) else votes

    def calibrate(self, at: np.ndarray, index: np.ndarray, counts: np.ndarray) -> None:
        """Monotone share of toxic rows by the votes that every example gets from the others."""
        points = []
        for e, (near, cosine) in enumerate(self.nearest_all(at, index, counts, NEIGHBOURS + 1)):
            other = near != e
            near, cosine = near[other][:NEIGHBOURS], cosine[other][:NEIGHBOURS]
            if len(near):
                points.append((self.votes(near, cosine), self.toxic[e], self.vote[e]))
        # neighbouring blocks are pooled until their shares rise
        blocks: list[list[float]] = []  # rows, toxic rows, sum of rows x votes
        for v, t, n in sorted(points):
            blocks.append([n, n * t, n * v])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                last = blocks.pop()
                blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
        self.votes_at = np.array([v / n for n, _, v in blocks])
        self.share_at = np.array([(t + PRIOR_WEIGHT * self.prior) / (n + PRIOR_WEIGHT) for n, t, _ in blocks])


def training_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): one row per labelled document that may be learned from; toxic if any of its labels says so."""
    return (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
            .groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))


def _association(toxic: np.ndarray, clean: np.ndarray, rows: tuple[int, int]) -> np.ndarray:
    """How much terms speak for the label, 0 to 1, from the toxic and clean examples that hold them."""
    n1, n0 = rows
    n, both = n1 + n0, toxic + clean
    g2 = np.zeros(len(toxic))
    for seen, expected in ((toxic, both * n1 / n), (clean, both * n0 / n), (n1 - toxic, (n - both) * n1 / n), (n0 - clean, (n - both) * n0 / n)):
        g2 += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300)), 0.0)
    beyond = np.maximum(g2 - CHANCE, 0)
    # a term as common among clean examples says nothing, however many there are
    return beyond / (beyond + HALF) * np.maximum(1 - (clean / n0) / np.maximum(toxic / n1, 1e-300), 0)


def _terms(texts: list[str], toxic: np.ndarray) -> tuple[list[str], np.ndarray]:
    """All words of the examples and the beginnings that mark toxic ones, with their association."""
    by = (Counter(), Counter())
    for text, t in zip(texts, toxic):
        words = set(WORD.findall(text.lower()))
        by[int(t)].update(words | beginnings(words))
    names = sorted(by[0] | by[1])
    rows = int(toxic.sum()), int(len(toxic) - toxic.sum())
    speaks = np.zeros(len(names))
    if min(rows):
        speaks = _association(np.array([by[1][x] for x in names], dtype=float), np.array([by[0][x] for x in names], dtype=float), rows)
    kept = [i for i, x in enumerate(names) if speaks[i] > 0 or not x.endswith("-")]
    return [names[i] for i in kept], speaks[kept]


def _frequencies(texts: DataFrame, terms: list[str]) -> tuple[int, np.ndarray]:
    """All documents, and how many hold each term; a row a term and task is shuffled."""
    known = texts.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, n, holding = Finder(known.value), 0, np.zeros(len(known.value), dtype=np.int64)
        for b in batches:
            for part in parts(b.column(0).to_pylist()):
                holding += np.bincount(finder.find_all(part)[1], minlength=len(holding))
            n += b.num_rows
        seen = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *seen.tolist()], pa.int64()), pa.array([n, *holding[seen].tolist()], pa.int64())], names=["term", "n"])

    found = {r.term: r.n for r in texts.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(len(terms))], dtype=np.float64)


def fit(examples: list, rows: dict[int, int], texts: DataFrame) -> tuple[list[str], ExampleIndex]:
    """Terms and index of the examples (doc_id, toxic, text, rows); ``rows`` are the labelled rows of each class."""
    toxic = np.array([r.toxic for r in examples], dtype=np.float64)
    terms, speaks = _terms([r.text for r in examples], toxic)
    documents, holding = _frequencies(texts, terms)
    weights = (np.log((1.0 + documents) / (1.0 + holding)) + 1.0) * (PLAIN + speaks)
    finder = Finder(terms)
    found = [(i[a:b], c[a:b]) for part in parts([r.text for r in examples]) for at, i, c in [finder.find_all(part)] for a, b in zip(at[:-1], at[1:])]
    # examples of like terms share blocks: in order of their strongest terms
    strongest = [sorted(i, key=lambda t: (-speaks[t], holding[t] * -1.0, t))[:3] for i, _ in found]
    order = sorted(range(len(examples)), key=lambda e: (strongest[e], examples[e].doc_id, examples[e].text))
    examples, found, toxic = [examples[e] for e in order], [found[e] for e in order], toxic[order]
    index = ExampleIndex(weights, np.array([r.doc_id for r in examples], dtype=np.int64), toxic, np.zeros(len(examples)), 0.0,
                         *[np.zeros(0, dtype=np.int64)] * 10, np.zeros(0), np.zeros(0))
    # an example stands for its copies, and all examples of a class for the labelled rows of the class
    copies = np.array([r.rows for r in examples], dtype=np.float64)
    total = {c: max(1.0, copies[toxic == c].sum()) for c in (0, 1)}
    index.vote = np.array([n * rows.get(int(c), 0) / total[int(c)] for n, c in zip(copies, toxic)])
    if len(examples):
        index.vote *= len(examples) / max(index.vote.sum(), 1e-300)
        index.prior = float((index.vote * toxic).sum() / max(index.vote.sum(), 1e-300))
    at = np.cumsum([0, *(len(i) for i, _ in found)])
    term, counts = (np.concatenate([x[j] for x in found] or [np.zeros(0, dtype=np.int64)]) for j in (0, 1))
    known, weight, example = (term, counts), index.vectors(at, term, counts), np.repeat(np.arange(len(found)), np.diff(at))
    first: dict[tuple[bytes, bytes], int] = {}
    index.same = np.array([first.setdefault((term[a:b].tobytes(), weight[a:b].tobytes()), e) for e, (a, b) in enumerate(zip(at[:-1], at[1:]))], dtype=np.int64)
    holds = np.bincount(term, minlength=len(terms))
    common = np.argsort(-holds, kind="stable")[:COMMON]
    common = common[holds[common] >= max(1.0, COMMON_SHARE * len(examples))]
    index.common_at = np.full(len(terms), -1)
    index.common_at[common] = np.arange(len(common))
    index.common = np.zeros((len(common), -(-len(examples) // BLOCK) * BLOCK))
    shared = index.common_at[term] >= 0
    index.common[index.common_at[term[shared]], example[shared]] = weight[shared]
    index.common_rough = index.common.astype(np.float32)
    term, weight, example = term[~shared], weight[~shared], example[~shared]
    by_term = np.lexsort((example, term))
    term, index.post_example, index.post_weight = term[by_term], example[by_term].astype(np.int32), weight[by_term]
    block = index.post_example // BLOCK
    new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, dtype=np.int64)
    index.entry_block, index.entry_at = block[new], np.append(new, len(term))
    index.entry_max = np.maximum.reduceat(index.post_weight, new) if len(new) else np.zeros(0)
    index.term_at = np.searchsorted(term[new], np.arange(len(terms) + 1))
    if rows.get(0) and rows.get(1):
        index.calibrate(at, *known)
    return terms, index


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """(broadcast terms and index, texts of all documents): what scoring needs, from all documents and the labels.

    A sampled id is one example for each of its different texts, whose copies are its rows; of very many different texts of
    one id the ``EXAMPLES`` first by hash.  So at most 2 * EXAMPLES texts reach the driver.
    """
    spark = session(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    learned = durable(training_rows(labels))
    draw = learned.orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = durable(draw.where("toxic = 1").limit(EXAMPLES).union(draw.where("toxic = 0").limit(EXAMPLES)))
    rows = {r["toxic"]: r["count"] for r in learned.groupBy("toxic").count().collect()}
    held = durable(texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic", "text").agg(F.count(F.lit(1)).alias("rows")))
    first = held.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text")
    examples = [r for c in (1, 0) for r in first.where(F.col("toxic") == c).limit(EXAMPLES).collect()]
    return spark.sparkContext.broadcast(fit(examples, rows, texts)), texts


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for every document.

    ``evidence`` lists the nearest examples: doc_id, cosine, toxic.  A null text is an empty one; an empty text and one without
    any known term get the share of toxic rows.  Repeated rows are scored alike, row by row; a null id is scored too (and is
    never held out); without labels, or without toxic ones, every score is the prior (0 without labels).  Other columns are
    ignored, whatever their names; no rows give no rows.
    """
    model, texts = train(docs, labels, id_col, text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, m = model.value
        finder = Finder(terms)
        for b in batches:
            found = [x for part in parts(b.column(1).to_pylist()) for x in m.nearest_all(*finder.find_all(part))]
            near, cosine = (np.concatenate([x[i] for x in found] or [np.zeros(0, dtype=np.int64)]) for i in (0, 1))
            struct = pa.StructArray.from_arrays([pa.array(m.ids[near]), pa.array(cosine, pa.float64()), pa.array(m.toxic[near].astype(np.int32))],
                                                names=["doc_id", "cosine", "toxic"])
            evidence = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(e) for e, _ in found)]), pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(*x) for x in found], pa.float64()), evidence],
                                             names=["doc_id", "score", "evidence"])

    judged = texts.mapInArrow(judge, "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return judged.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with all their columns; cases (ties too) as in ``toxicity``."""
    model, _ = train(docs, labels, id_col, text_col)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, m = model.value
        finder = Finder(terms)
        for b in batches:
            texts = [t or "" for t in b.column(place).to_pylist()]
            clean = [m.score(*x) < threshold for part in parts(texts) for x in m.nearest_all(*finder.find_all(part))]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
