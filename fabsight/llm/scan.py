"""Ranked lexical search without an index: an Aho-Corasick automaton of all item terms reads every text.

A pattern is a term between two boundary characters, and a text is read with every other ASCII character turned into a
boundary, so that the automaton meets whole terms only; its outputs are term numbers, which point to the items that hold the
term.  The texts are read twice: once for the counts of the corpus, once to score them.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fabsight.llm.common import durable, session
from fabsight.plans.series import ordered_sums
from fabsight.session import spread

#: Different (item, term) rows of one automaton; more items are worked off in further rounds.  Documents of one score matrix.
TERMS, DOCS = 500_000, 256
#: A term: ASCII letters and digits, and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every byte as the automaton reads it: A-Z lower, other ASCII characters that are no term a boundary.
READ = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class Automaton:
    """Term counts of texts; built once in each task that uses it."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.matcher = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            # bytes as characters: one reading for every script
            self.matcher.add_word(f" {term.encode().decode('latin-1')} ", i)
        self.matcher.make_automaton()
        self.empty = not terms

    def read(self, text: bytes | None) -> tuple[int, Counter]:
        """All terms of a text, with repeats, and how often each term of the automaton is among them."""
        plain = (text or b"").translate(READ)
        n = len(plain.split())
        if not n or self.empty:
            return n, Counter()
        return n, Counter(map(itemgetter(1), self.matcher.iter(f" {plain.decode('latin-1')} ")))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term) without repeats."""
    lowered = F.translate(F.col(text_col), UPPER, LOWER)
    return items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def in_rounds(pairs: DataFrame) -> list[DataFrame]:
    """The pairs in rounds of about TERMS, an item in one round."""
    rounds = -(-pairs.count() // TERMS)
    if rounds <= 1:
        return [pairs] * rounds
    sized = ordered_sums(pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")), [], [F.col("item")], {"upto": F.col("n")})
    placed = durable(pairs.join(sized.select("item", F.expr(f"(upto - n) div {TERMS}").alias("round")), "item"))
    return [placed.where(F.col("round") == r).drop("round") for r in range(rounds)]


def _counts(docs: DataFrame, terms: list[str]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, documents that hold each of ``terms``; one row a term and task is shuffled."""

    def count(batches):
        automaton, n, total, holding = Automaton(terms), 0, 0, np.zeros(len(terms), dtype=np.int64)
        for b in batches:
            for text in b.column(1).to_pylist():
                size, found = automaton.read(text)
                n, total = n + (size > 0), total + size
                holding[list(found)] += 1
        seen = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *seen.tolist()], pa.int64()), pa.array([n, total, *holding[seen].tolist()], pa.int64())], names=["what", "n"])

    totals = {r.what: r.n for r in docs.mapInArrow(count, "what long, n long").groupBy("what").agg(F.sum("n").alias("n")).collect()}  # at most TERMS
    return totals.get(-1, 0), totals.get(-2, 0), np.array([totals.get(i, 0) for i in range(len(terms))], dtype=np.int64)


class Best:
    """The k best (score, doc) of each item among those offered: by falling score, ties to the smaller doc."""

    def __init__(self, items: int, k: int):
        self.k, self.items = k, items
        self.item, self.score, self.doc = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.least = np.ones(items, dtype=np.int64)  # scores below 1 never count

    def offer(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """``scores``: a row for each doc, a column for each item."""
        r, c = np.nonzero(scores >= self.least[None, :])
        item, score, doc = np.concatenate([self.item, c]), np.concatenate([self.score, scores[r, c]]), np.concatenate([self.doc, docs[r]])
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        full = place == self.k - 1
        self.least[item[full]] = score[full]
        self.item, self.score, self.doc = item[place < self.k], score[place < self.k], doc[place < self.k]


def _search(docs: DataFrame, pairs: list[tuple], k: int):
    """The items of ``pairs`` by number, and the k best documents of every item in each task: (item number, score, doc)."""
    ids = sorted({item for item, _ in pairs})
    terms = sorted({term for _, term in pairs})
    place, number = {t: i for i, t in enumerate(terms)}, {item: i for i, item in enumerate(ids)}
    n_docs, n_terms, holding = _counts(docs, terms)
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * holding.astype(np.float64) + 1))).astype(np.int64)
    by_term = sorted((place[term], number[item]) for item, term in pairs)
    owners = np.array([i for _, i in by_term], dtype=np.int64)
    begins = np.searchsorted(np.array([t for t, _ in by_term], dtype=np.int64), np.arange(len(terms) + 1))

    def score(batches):
        automaton, best = Automaton(terms), Best(len(ids), k)
        for b in batches:
            for at in range(0, b.num_rows, DOCS):
                part = b.slice(at, DOCS)
                rows, found, values = [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    n, counted = automaton.read(text)
                    if counted:
                        m = 50 + 50 * n * n_docs // n_terms
                        rows.extend(repeat(row, len(counted)))
                        found.extend(counted)
                        values.extend(1_000_000_000 * tf // (1000 * tf + 20 * m) for tf in counted.values())
                found = np.array(found, dtype=np.int64)
                gain = np.array(values, dtype=np.int64) * weights[found]
                first, degree = begins[found], begins[found + 1] - begins[found]
                item = owners[np.repeat(first - (np.cumsum(degree) - degree), degree) + np.arange(degree.sum())]
                cell = np.repeat(np.array(rows, dtype=np.int64), degree) * len(ids) + item
                # a gain is below 1e6 * 1e5; sums of 50 000 terms and more are exact in doubles
                total = np.bincount(cell, weights=np.repeat(gain, degree), minlength=part.num_rows * len(ids))
                best.offer(total.astype(np.int64).reshape(part.num_rows, len(ids)), part.column(0).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.score), pa.array(best.doc)], names=["item", "score", "doc"])

    return ids, docs.where("doc IS NOT NULL").mapInArrow(score, "item long, score long, doc long")


def ranked_search(items: DataFrame, docs: DataFrame, k: int = 50, item_col: str = "item_id", item_text: str = "text", doc_col: str = "doc_id",
                  doc_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0, ties to the smaller doc_id.

    Score: the sum over an item's terms, once each, of w * ((10^9 * tf) div (1000 * tf + 20 * m)) with
    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m = 50 + (50 * n * N) div L; N documents with a term, L terms in all, n terms of
    the document, df documents with the term, tf its count in the document.

    Rows of one item id are one item; null item ids, and items without a term that any document holds, give no rows.  Null and
    empty texts hold no term.  Repeated document rows are documents of their own; rows without an id count in the corpus and are
    not ranked.  Other columns are ignored; no documents or no items give no rows.

    What is broadcast is a round of items of at most ``TERMS`` (item, term) rows and one item more; a task keeps k rows of each
    item of the round.
    """
    spark = session(docs.sparkSession)
    texts = spread(docs.select(F.col(doc_col).cast("long").alias("doc"), F.col(doc_text).cast("binary").alias("text")))
    pairs = durable(item_terms(items, item_col, item_text))
    item_type = pairs.schema["item"].dataType.simpleString()
    out = None
    for part in in_rounds(pairs):
        ids, found = _search(texts, [tuple(r) for r in part.collect()], k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {item_type}")
        # the rows of many tasks are cut once on the way to the task of an item
        salted = Window.partitionBy("item", F.pmod("doc", F.lit(64))).orderBy(F.desc("score"), "doc")
        last = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
        for window in (salted, last):
            found = found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
        found = found.join(F.broadcast(names), "item").select(F.col("item_id").alias(item_col), "rank", F.col("doc").alias(doc_col), "score")
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], f"`{item_col}` {item_type}, rank int, `{doc_col}` long, score long") if out is None else out
