"""Periodic runs of words, by recompression.

The words of many documents stand in one sequence, a mark of its own between any two documents.  Rounds of block compression
(equal neighbours become one symbol) and pair compression (symbols are dealt to a left and a right half; a left one and the
right one after it become one symbol) rename the sequence until no symbol is there twice.  The rounds are a run-length
grammar; common extensions of two positions climb its levels and come down again.  Candidate periods stand on a grid whose
step grows with the period, so there are n log n of them in all.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fabsight.llm.common import session

#: Words that one grammar holds (a longer document has a grammar to itself), candidates that are made at a time.
WORDS, CANDIDATES = 200_000, 1 << 20
RUNS = "array<struct<start: long, length: long, period: long>>"


def _named(keys: np.ndarray) -> np.ndarray:
    return pd.factorize(keys)[0].astype(np.int64)


class Grammar:
    """Run-length grammar of ``letters`` (all integers from 0 to their greatest).  The first and the last letter must stand nowhere else.

    A level keeps its symbols, and about the step to the next level: which boundaries start a new symbol, the number of
    that symbol, and the boundary at which a symbol starts.  Boundary p lies before symbol p.
    """

    def __init__(self, letters: np.ndarray):
        self.levels, symbols, blocks, draw = [], letters.astype(np.int64), True, np.random.default_rng(1)
        while True:
            size = int(symbols.max()) + 1
            if size == len(symbols):
                break  # no symbol twice: all further comparisons end at once
            first = np.ones(len(symbols) + 1, dtype=bool)
            if blocks:
                first[1:-1] = symbols[1:] != symbols[:-1]
            else:
                left = draw.integers(0, 2, size).astype(bool)[symbols]
                joined, swapped = left[:-1] & ~left[1:], left[1:] & ~left[:-1]
                first[1:-1] = ~(joined if joined.sum() >= swapped.sum() else swapped)
            start = np.flatnonzero(first)
            lengths = np.diff(start)
            # pairs are named by both symbols, blocks by symbol and length
            tail = lengths if blocks else np.where(lengths == 2, symbols[np.minimum(start[:-1] + 1, len(symbols) - 1)] + 1, 0)
            self.levels.append((symbols, first, np.cumsum(first) - 1, start, blocks))
            symbols, blocks = _named(symbols[start[:-1]] * (int(tail.max()) + 1) + tail), not blocks
        self.top = symbols

    def extend(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """Symbols that match from the boundaries ``a`` and ``b`` on, to the right or to the left, for each pair."""
        x, y, begin = a.copy(), b.copy(), a
        height = np.full(len(a), len(self.levels))
        live = np.arange(len(a))
        for level, step in enumerate(self.levels):
            symbols, first, parent, _, _ = step
            p, q = x[live], y[live]
            inside = ~(first[p] & first[q])
            move = np.zeros(len(live), dtype=np.int64)
            move[inside], whole = self._match(step, p[inside], q[inside], forward)
            x[live], y[live] = (p + move, q + move) if forward else (p - move, q - move)
            stuck = np.zeros(len(live), dtype=bool)
            stuck[inside] = ~whole
            height[live[stuck]] = level
            live = live[~stuck]
            x[live], y[live] = parent[x[live]], parent[y[live]]
            if not len(live):
                break
        for level in range(len(self.levels) - 1, -1, -1):
            down = np.flatnonzero(height > level)
            if len(down):
                step = self.levels[level]
                p, q = step[3][x[down]], step[3][y[down]]
                move, _ = self._match(step, p, q, forward)
                x[down], y[down] = (p + move, q + move) if forward else (p - move, q - move)
        return np.abs(x - begin)

    @staticmethod
    def _match(step, p: np.ndarray, q: np.ndarray, forward: bool) -> tuple[np.ndarray, np.ndarray]:
        """Equal symbols up to the next boundary of the level above, and whether both sides reach it with them."""
        symbols, first, parent, start, blocks = step
        same = symbols[p] == symbols[q] if forward else symbols[p - 1] == symbols[q - 1]
        if not blocks:
            return same.astype(np.int64), same
        if forward:
            m, n = start[parent[p] + 1] - p, start[parent[q] + 1] - q
        else:
            m, n = p - start[parent[p - 1]], q - start[parent[q - 1]]
        return np.where(same, np.minimum(m, n), 0), same & (m == n)


def candidates(letters: np.ndarray, base: np.ndarray, sizes: np.ndarray, least: int, repeats: int):
    """(position, period) of the grid where both letters agree, in bounded pieces.

    A run of period q has at least max(least, repeats * q) - q positions that equal the one q further on; a grid of that
    step meets one of them.
    """
    periods = np.where(sizes >= least, sizes // repeats, 0)
    doc = np.repeat(np.arange(len(sizes)), periods)
    q = 1 + np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods)
    step = np.maximum(least, repeats * q) - q
    counts = -(-(sizes[doc] - q) // step)
    ends = np.cumsum(counts)
    at = 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, side="right")))
        c = counts[at:to]
        nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        period = np.repeat(q[at:to], c)
        position = np.repeat(base[doc[at:to]], c) + nth * np.repeat(step[at:to], c)
        agree = letters[position] == letters[position + period]
        yield position[agree], period[agree]
        at = to


def find_runs(letters: np.ndarray, base: np.ndarray, sizes: np.ndarray, least: int, repeats: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start, then period; positions are those of ``letters``."""
    grammar, found = None, [np.zeros((0, 3), dtype=np.int64)]
    for position, period in candidates(letters, base, sizes, least, repeats):
        if not len(position):
            continue
        grammar = grammar or Grammar(letters)
        ahead = grammar.extend(position, position + period, True)
        behind = grammar.extend(position, position + period, False)
        runs = np.stack([position - behind, position + period + ahead, period], axis=1)
        found.append(np.unique(runs[ahead + behind + period >= np.maximum(least, repeats * period)], axis=0))
    runs = np.unique(np.concatenate(found), axis=0)
    # a stretch shows at every multiple of its smallest period too
    smallest = np.ones(len(runs), dtype=bool)
    smallest[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[smallest]
    order = np.lexsort((runs[:, 2], runs[:, 0]))
    return runs[order, 0], runs[order, 1], runs[order, 2]


def _runs_of(texts: list[bytes | None], least: int, repeats: int) -> tuple[pa.Array, list[bytes]]:
    """The runs of every text, and its words without the repeated periods."""
    words = [(t or b"").split() for t in texts]  # of bytes, split() knows the six ASCII characters only
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    base = 1 + np.arange(len(words)) + np.cumsum(sizes) - sizes
    letters = np.empty(int(sizes.sum()) + len(words) + 1, dtype=np.int64)
    marks = np.concatenate([[0], base + sizes])
    is_word = np.ones(len(letters), dtype=bool)
    is_word[marks] = False
    flat = np.empty(int(sizes.sum()), dtype=object)
    flat[:] = [w for ws in words for w in ws]
    letters[is_word] = _named(flat)
    letters[marks] = len(flat) + np.arange(len(marks))
    start, end, period = find_runs(_named(letters), base, sizes, least, repeats)
    owner = np.searchsorted(base, start, side="right") - 1
    runs = pa.StructArray.from_arrays([pa.array(start - base[owner]), pa.array(end - start), pa.array(period)], names=["start", "length", "period"])
    bounds = np.searchsorted(owner, np.arange(len(words) + 1))
    change = np.zeros(len(letters) + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    kept = np.cumsum(change) == 0
    collapsed = [b" ".join(ws if bounds[i] == bounds[i + 1] else compress(ws, kept[base[i]:base[i] + sizes[i]])) for i, ws in enumerate(words)]
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs), collapsed


def word_runs(docs: DataFrame, least: int = 6, repeats: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs, collapsed): the periodic runs of each text, and its words without those that only repeat.

    Words are parted by space and the five ASCII characters 9 to 13.  A run is a stretch with smallest period q and at least
    max(least, repeats * q) words that cannot be extended; runs come by start, then period.  ``collapsed`` leaves out what
    stands after the first q words of any run; words are joined by a space.  Null and empty texts have no runs and collapse to
    "".  A row in is a row out: repeated rows and null ids stay; other columns are ignored; no rows give none.
    """
    spark = session(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def find(batches):
        for b in batches:
            texts, at = b.column(1).to_pylist(), 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (to == at or held < WORDS):
                    held += (len(texts[to]) if texts[to] else 0) // 6
                    to += 1
                runs, collapsed = _runs_of(texts[at:to], least, repeats)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), runs, pa.array(collapsed, pa.binary()).cast(pa.string())],
                                                 names=["id", "runs", "collapsed"])
                at = to

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return found.mapInArrow(find, f"id {id_type}, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)


def with_planted_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): from every tenth document by hash on, the words from one place on repeat with one period.

    With h the unsigned crc32 of the decimal id, g = h div 10 and n words: where h ends in 0, word i from a = g mod n on is
    word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8).  Other rows stay, null and wordless ones too.
    """
    words = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.crc32(F.col(id_col).cast("string").cast("binary")).alias("h")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")))
    placed = words.withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn(
        "p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("array_join(slice(concat(slice(words, 1, int(a)), flatten(array_repeat(slice(words, int(a) + 1, int(p)), int((n - a) div p + 1)))), 1, n), ' ')")
    return placed.select(F.col("id").alias(id_col), F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias(text_col))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the longest run, and digests of all runs and of the collapsed text, for each row of ``word_runs``."""
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("longest", longest).select(
        F.col(id_col), F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"), F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
