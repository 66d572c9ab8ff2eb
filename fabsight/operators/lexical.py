"""Lexical search over a stored index of postings.

Chunks are laid in blocks of consecutive places, neighbours in vocabulary together.  A row of the index is a block: its terms,
their postings in the block and the largest impact among them.  A task lays the chunks that it reads, so postings never move; only
the few chunks that fill no block in their task do.  A search first adds the largest impacts (nothing per chunk is read), scores the
most promising blocks of each query, and then only those other blocks whose sum of largest impacts reaches the k-th best score
found so far.  The queries come to the blocks, QUERIES at a time, and a task sends on the best chunks of each query alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from fabsight import constants as K
from fabsight.functions.text import tokenize_bigram, tokenize_whitespace
from fabsight.plans.series import PIECE, number_rows
from fabsight.session import durable, spread

TOKENIZERS = {"whitespace": tokenize_whitespace, "bigram": tokenize_bigram}
TIE_PLACES = 9  # scores equal to this many places are ties, ordered by chunk id
TOLERANCE = 10.0 ** -(TIE_PLACES - 1)
#: Chunks of a block, blocks that a task scores before it cuts its hits to the best, queries that meet the blocks in one pass, those of them
#: that are scored at once in a block, blocks of a query that are scored to find its bound, commonest terms that order the chunks.
BLOCK_CHUNKS, BLOCKS, QUERIES, SPAN, SEEDS, NAMING = 64, 32, 4_096, 512, 2, 3
#: So many times as many chunks are dealt to a task as for heavier work.
LAY_TIMES = 4
#: Blocks of a file (a block is 0.1 to 0.2 MB in memory), terms whose statistics go to every block, blocks whose postings are spelled out at a time.
FILE_ROWS, COMMON, SAID_BLOCKS = 128, 524_288, 64


def topk(scored: DataFrame, k: int, order: Sequence[Column] | None = None) -> DataFrame:
    """Best ``k`` per query, ties by chunk id; each task cuts its own groups before the shuffle."""
    order = order or [F.desc(F.round("score", TIE_PLACES)), F.asc("chunk_id")]
    rn = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return scored.withColumn("rank", rn).where(F.col("rank") <= k)


@dataclass(frozen=True)
class LexicalIndex:
    """The stored tables, and how texts became terms.

    blocks: block, the chunk ids by slot, terms, and per term its largest impact and, per hit, slot, count, chunk length and impact.
    terms: df and idf.
    """

    blocks: DataFrame
    terms: DataFrame
    tokenizer: str

    @property
    def postings(self) -> DataFrame:
        """term, block, the largest impact, and per hit its slot in the block, count, chunk length and impact."""
        row = F.explode(F.arrays_zip("terms", "tops", "slots", "tfs", "lengths", "impacts")).alias("p")
        return self.blocks.select("block", row).select(
            F.col("p.terms").alias("term"), "block", F.col("p.tops").alias("impact"), *[F.col(f"p.{c}").alias(c) for c in ("slots", "tfs", "lengths", "impacts")])

    @property
    def chunks(self) -> DataFrame:
        """chunk_id by its place, block * BLOCK_CHUNKS + slot."""
        return self.blocks.select("block", F.posexplode("ids").alias("_s", "chunk_id")).select("chunk_id", (F.col("block") * BLOCK_CHUNKS + F.col("_s")).alias("place"))

    def write(self, folder: str) -> None:
        """Store the index; a search of a later session reads it."""
        for name in ("blocks", "terms"):
            getattr(self, name).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS if name == "blocks" else 0).parquet(f"{folder}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, folder: str, tokenizer: str = "whitespace") -> "LexicalIndex":
        return cls(*[spark.read.parquet(f"{folder}/{name}") for name in ("blocks", "terms")], tokenizer)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Every value as its place among the different values in order."""
    known = values.unique().sort()
    return pc.index_in(values, known).to_numpy(zero_copy_only=False).astype(np.int64), known


def _sizes(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _said(texts: pa.Array) -> pa.Array:
    """The words of texts, as ``tokenize_whitespace`` has them; lists of words stay."""
    if not pa.types.is_string(texts.type):
        return texts
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    words, row = lists.flatten(), np.repeat(np.arange(len(lists)), _sizes(lists))
    some = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False).astype(bool)
    return _lists(words.filter(pa.array(some)), np.bincount(row[some], minlength=len(lists)))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts: how many, how many with words, and how many words."""
    total = np.zeros(3, dtype=np.int64)
    for b in batches:
        sizes = _sizes(_said(b.column(0)))
        total += len(sizes), np.count_nonzero(sizes), sizes.sum()
    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=["n", "some", "words"])


def _blocks(ids: pa.Array, length: np.ndarray, held: np.ndarray, codes: np.ndarray, known: pa.Array, tfs: np.ndarray, mean: float, size: int) -> list[pa.Array]:
    """The columns of the index from ``ids`` on, for chunks in order of place, ``size`` to a block, with ``held`` terms each."""
    place = np.repeat(np.arange(len(ids)), held)
    key = place // size * len(known) + codes
    order = np.lexsort((place, key))
    key, place, tf = key[order], place[order], tfs[order].astype(np.float64)
    long = length[place]
    impact = tf * (K.BM25_K1 + 1) / (tf + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * long / mean))
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    hits = np.diff(np.concatenate([begin, [len(key)]]))
    count = -(-len(ids) // size)
    per = np.bincount(key[begin] // len(known), minlength=count)
    chunks = np.minimum(size, len(ids) - size * np.arange(count))
    lists = [_lists(known.take(pa.array(key[begin] % len(known))), per), _lists(pa.array(np.maximum.reduceat(impact, begin)), per)]
    values = (place % size).astype(np.int32), tf.astype(np.int32), long.astype(np.int32), impact
    return [_lists(ids, chunks), *lists, *[_lists(_lists(pa.array(v), hits), per) for v in values]]


_POSTED = "terms array<string>, tops array<double>, slots array<array<int>>, tfs array<array<int>>, lengths array<array<int>>, impacts array<array<double>>"
_COLUMNS = ["ids", "terms", "tops", "slots", "tfs", "lengths", "impacts"]


def _lay(mean: float, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks (id, text or tokens) of a batch as full blocks, numbered in the task, and those that fill none as blocks of one chunk numbered -1."""
    def lay(batches):
        done = 0
        for b in batches:
            if not b.num_rows:
                continue
            said = _said(b.column(1))
            sizes, words = _sizes(said), said.flatten()
            ids, sizes = b.column(0).take(pa.array(np.flatnonzero(sizes))), sizes[sizes > 0]
            if not len(ids):
                continue
            codes, known = _coded(words)
            key, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(known) + codes, return_counts=True)
            row, code = key // len(known), key % len(known)
            held = np.bincount(row, minlength=len(sizes))
            begin = np.cumsum(held) - held
            order = np.lexsort((code, -tf, row))
            nth = np.arange(len(row)) - np.repeat(begin, held)
            name = np.full((NAMING, len(sizes)), -1)
            name[nth[nth < NAMING], row[nth < NAMING]] = code[order][nth < NAMING]
            at = np.lexsort(name[::-1])
            full = len(at) // size
            for part, width, first in ((at[:full * size], size, done), (at[full * size:], 1, None)):
                if not len(part):
                    continue
                each = np.repeat(begin[part] - (np.cumsum(held[part]) - held[part]), held[part]) + np.arange(held[part].sum())
                rows = _blocks(ids.take(pa.array(part)), sizes[part], held[part], code[each], known, tf[each], mean, width)
                named = name[:, part[::width]]
                names = _lists(known.take(pa.array(named.T[named.T >= 0])), (named >= 0).sum(axis=0))
                number = np.full(len(rows[0]), -1) if first is None else first + np.arange(len(rows[0]))
                yield pa.RecordBatch.from_arrays([pa.array(number), names, *rows], names=["_n", "_name", *_COLUMNS])
            done += full
    return lay


def _join_blocks(mean: float, size: int, first: int) -> Callable[[pa.Table], pa.Table]:
    """Blocks of one chunk with their places as blocks of ``size`` chunks, numbered from ``first``."""
    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("place").combine_chunks()
        flat = lambda c: table[c].chunk(0).flatten()
        held, lengths = _sizes(table["terms"].chunk(0)), flat("lengths").flatten().to_numpy()
        codes, known = _coded(flat("terms"))
        rows = _blocks(flat("ids"), lengths[np.cumsum(held) - held], held, codes, known, flat("tfs").flatten().to_numpy(), mean, size)
        return pa.table([pa.array([first + table["place"][0].as_py() // size], pa.int64()), *rows], names=["block", *_COLUMNS])
    return join


def bm25_index(chunks: DataFrame, tokenizer: str = "whitespace", content: str = "content") -> LexicalIndex:
    """The stored index of ``chunks`` (chunk_id, content).

    The chunks of a task follow each other by their commonest terms, which keeps languages and subjects together, so that the
    largest impacts of a block say much about its chunks.  Every block but the last is full.
    """
    size, kind = BLOCK_CHUNKS, chunks.schema["chunk_id"].dataType.simpleString()
    # white space is found where the texts are laid, which moves no lists of words
    given = F.col(content).cast("string") if tokenizer == "whitespace" else F.coalesce(TOKENIZERS[tokenizer](F.col(content)), F.array().cast("array<string>"))
    texts = spread(chunks, LAY_TIMES).select("chunk_id", given.alias("_t"))
    n, some, words = texts.select("_t").mapInArrow(_lengths, "n long, some long, words long").agg(*[F.sum(c) for c in ("n", "some", "words")]).first()
    n, mean = n or 0, words / some if some else 1.0
    laid = durable(texts.mapInArrow(_lay(mean, size), f"_n long, _name array<string>, ids array<{kind}>, {_POSTED}").withColumn(
        PIECE, F.spark_partition_id()), FILE_ROWS, "zstd")
    full, rest = laid.where("_n >= 0"), laid.where("_n < 0")
    counts = full.groupBy(PIECE).agg(F.count(F.lit(1)).alias("_c"))
    before = W.orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)  # a row per task
    shifts = durable(counts.select(PIECE, "_c", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_shift")))
    first = shifts.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("c")).first()["c"]
    placed = number_rows(rest, [], [F.asc("_name"), F.asc(F.col("ids")[0])], "place", _COLUMNS)
    joined = durable(placed.groupBy(F.expr(f"place div {size}")).applyInArrow(_join_blocks(mean, size, first), f"block long, ids array<{kind}>, {_POSTED}"), FILE_ROWS, "zstd")
    blocks = full.join(F.broadcast(shifts), PIECE).select((F.col("_n") + F.col("_shift")).alias("block"), *_COLUMNS).unionByName(joined)
    df = laid.select(F.explode(F.arrays_zip("terms", F.transform("slots", F.size).alias("n"))).alias("p")).groupBy(F.col("p.terms").alias("term")).agg(
        F.sum("p.n").alias("df"))
    raw = durable(df.withColumn("_idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    floor = raw.agg(F.avg("_idf").alias("a")).scalar() * K.BM25_EPSILON
    return LexicalIndex(blocks, raw.select("term", "df", F.when(F.col("_idf") < 0, floor).otherwise(F.col("_idf")).alias("idf")), tokenizer)


def chunk_postings(index: LexicalIndex) -> DataFrame:
    """Every posting, chunk by chunk: (chunk_id, length, terms, postings, df, idf, impact).

    ``postings`` is the MD5 of the terms with their counts in order, ``df`` and ``idf`` are sums over the terms, ``impact`` is the largest.
    A block holds all of its chunks' postings, so they are not moved.  The statistics of the commonest terms, COMMON at most, go to
    the blocks; only postings of the others meet theirs by term.
    """
    size = BLOCK_CHUNKS
    held = index.terms.groupBy("df").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("df", "descending")])  # a row per different count
    fits = int((np.cumsum(held["n"].to_numpy()) <= COMMON).sum())
    least = held["df"][fits - 1].as_py() if fits else None
    known = (index.terms.where(F.col("df") >= least) if fits else index.terms.limit(0)).select("term", "df", "idf").toArrow().combine_chunks()
    names = known["term"].combine_chunks() if known.num_rows else pa.array([], pa.string())
    stats = [np.append(known[c].to_numpy().astype(np.float64), 0.0) for c in ("df", "idf")]

    def parts(batches):
        """(block, ids, terms, slots, ..) of a few blocks: ids, base of each block, terms, which is common (or -1), and per hit its term and place in ids."""
        for whole in batches:
            for at in range(0, whole.num_rows, SAID_BLOCKS):
                b = whole.slice(at, SAID_BLOCKS)
                chunks, terms, lists = _sizes(b.column(1)), b.column(2).flatten(), b.column(3).flatten()
                term = np.repeat(np.arange(len(terms)), _sizes(lists))
                block = np.repeat(np.arange(b.num_rows), _sizes(b.column(2)))
                slot = lists.flatten().to_numpy()
                code = pc.fill_null(pc.index_in(terms, names), -1).to_numpy(zero_copy_only=False)
                yield b, terms, code, term, (np.cumsum(chunks) - chunks)[block][term] + slot, b.column(0).to_numpy()[block][term] * size + slot

    def say(batches):
        for b, terms, code, term, chunk, place in parts(batches):
            tf, length, impact = (b.column(i).flatten().flatten() for i in (4, 5, 6))
            said = pc.binary_join_element_wise(terms.take(pa.array(term)), tf.cast(pa.string()), ":")
            order = pc.sort_indices(pa.table({"c": chunk, "s": said}), sort_keys=[("c", "ascending"), ("s", "ascending")])
            at, count = order.to_numpy(), np.bincount(chunk)
            begin = np.cumsum(count) - count
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)), pa.int32()), said.take(order)), " ").cast(pa.binary())
            sums = [np.bincount(chunk, weights=x[code[term]]) for x in stats]
            yield pa.RecordBatch.from_arrays(
                [b.column(1).flatten(), pa.array(place[at[begin]]), length.take(order).take(pa.array(begin)), pa.array(count.astype(np.int64)),
                 pa.array([hashlib.md5(t.as_buffer()).hexdigest() for t in texts]), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]),
                 pa.array(np.maximum.reduceat(impact.to_numpy()[at], begin))], names=["chunk_id", "place", "length", "terms", "postings", "df", "idf", "impact"])

    def other(batches):
        for _, terms, code, term, _, place in parts(batches):
            at = np.flatnonzero(code[term] < 0)
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(term[at])), pa.array(place[at])], names=["term", "place"])

    kind = index.blocks.schema["ids"].dataType.elementType.simpleString()
    rows = index.blocks.select("block", "ids", "terms", "slots", "tfs", "lengths", "impacts").mapInArrow(
        say, f"chunk_id {kind}, place long, length int, terms long, postings string, df long, idf double, impact double")
    rest = index.terms.where(F.col("df") < least) if fits else index.terms
    met = index.blocks.select("block", "ids", "terms", "slots").mapInArrow(other, "term string, place long").join(rest, "term")
    sums = met.groupBy("place").agg(F.sum("df").alias("_df"), F.sum("idf").alias("_idf"))
    return rows.join(sums, "place", "left").select("chunk_id", "length", "terms", "postings", (F.col("df") + F.coalesce("_df", F.lit(0))).alias("df"),
                                                   (F.col("idf") + F.coalesce("_idf", F.lit(0.0))).alias("idf"), "impact")


def query_weights(queries: DataFrame, index: LexicalIndex, query: str = "query") -> DataFrame:
    """(query_id, term, weight): the known terms of each query, by how often it says them."""
    wanted = durable(queries.select("query_id", F.explode(TOKENIZERS[index.tokenizer](F.col(query))).alias("term")).groupBy("query_id", "term").agg(
        F.count(F.lit(1)).alias("qtf")))
    return wanted.join(index.terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))


class Asked:
    """At most about QUERIES queries as arrays: the different terms, and per query its terms and weights, in order."""

    def __init__(self, weights: DataFrame):
        table = weights.select("query_id", "term", "weight").toArrow().sort_by([("query_id", "ascending"), ("term", "ascending")]).combine_chunks()
        names, terms = table["query_id"].combine_chunks(), table["term"].combine_chunks()
        self.names, self.vocab = names.unique(), terms.unique()
        self.row = pc.index_in(names, self.names).to_numpy(zero_copy_only=False).astype(np.int64)
        self.code = pc.index_in(terms, self.vocab).to_numpy(zero_copy_only=False).astype(np.int64)
        self.weight = table["weight"].to_numpy()
        self.begin = np.flatnonzero(np.diff(self.row, prepend=-1))
        self.least = np.zeros(len(self.names))

    def bounds(self, batch: pa.RecordBatch):
        """Per block of a batch (block, terms, tops, ..): its row, which posting each wanted term has (or -1), and what no chunk exceeds."""
        terms, held = batch.column(1), _sizes(batch.column(1))
        code = pc.fill_null(pc.index_in(terms.flatten(), self.vocab), -1).to_numpy(zero_copy_only=False)
        tops, ends = batch.column(2).flatten().to_numpy(), np.cumsum(held)
        for i, (a, b) in enumerate(zip(ends - held, ends)):
            at = a + np.flatnonzero(code[a:b] >= 0)
            if not len(at):
                continue
            spot, top = np.full(len(self.vocab), -1), np.zeros(len(self.vocab))
            spot[code[at]], top[code[at]] = at, tops[at]
            yield i, spot, np.add.reduceat(np.maximum(self.weight, 0.0) * top[self.code], self.begin)


def _rounds(weights: DataFrame) -> list[Asked]:
    """The queries, QUERIES at a time."""
    count = weights.select("query_id").distinct().count()
    parts = -(-count // QUERIES)
    rounds = [Asked(weights.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p)) for p in range(parts)]
    return [r for r in rounds if len(r.names)]


def block_bounds(asked: Asked, index: LexicalIndex, kind: str, best: int | None = None) -> DataFrame:
    """(query_id, block, bound): no chunk of the block scores more; a block without terms of the query has no row.

    ``best``: only the so many most promising blocks per query of every batch.
    """
    def bounded(batches):
        for b in batches:
            found = [(i, bound) for i, _, bound in asked.bounds(b)]
            if not found:
                continue
            bound = np.stack([x for _, x in found], axis=1)
            keep = bound > 0
            if best and best < bound.shape[1]:
                keep &= bound >= np.partition(bound, -best, axis=1)[:, -best][:, None]
            q, at = np.nonzero(keep)
            block = b.column(0).take(pa.array(np.array([i for i, _ in found])[at]))
            yield pa.RecordBatch.from_arrays([asked.names.take(pa.array(q)), block, pa.array(bound[q, at])], names=["query_id", "block", "bound"])

    return index.blocks.select("block", "terms", "tops").mapInArrow(bounded, f"query_id {kind}, block long, bound double")


def score_blocks(asked: Asked, blocks: DataFrame, kind: str, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` best chunks of each query in ``blocks``, of those that reach its ``least`` score.

    A block whose bound does not reach the least score, or the k-th best that the task has found, is not scored for the query.
    """
    size, span, most, ids = BLOCK_CHUNKS, SPAN, BLOCKS, blocks.schema["ids"].dataType.elementType.simpleString()

    def scores(live, spot, starts, hits, slots, impacts):
        """The queries in ``live``, SPAN at a time, with their scores by slot."""
        for part in np.split(live, np.arange(span, len(live), span)):
            mine = np.zeros(len(asked.names), dtype=bool)
            mine[part] = True
            entry = np.flatnonzero(mine[asked.row] & (spot[asked.code] >= 0))
            at, row = spot[asked.code[entry]], np.searchsorted(part, asked.row[entry])
            n = hits[at]
            each = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield part, np.bincount(np.repeat(row * size, n) + slots[each], weights=np.repeat(asked.weight[entry], n) * impacts[each],
                                    minlength=len(part) * size).reshape(len(part), size)

    def scan(batches):
        least, kept, fresh = asked.least.copy(), [], 0
        for b in batches:
            lists = b.column(3)
            hits = _sizes(lists.flatten())
            starts, slots, impacts = np.cumsum(hits) - hits, lists.flatten().flatten().to_numpy(), b.column(4).flatten().flatten().to_numpy()
            chunks, held = b.column(5).flatten(), _sizes(b.column(5))
            base = np.cumsum(held) - held
            for i, spot, bound in asked.bounds(b):
                live = np.flatnonzero((bound > 0) & (bound >= least - TOLERANCE))
                for part, score in scores(live, spot, starts, hits, slots, impacts) if len(live) else ():
                    last = np.maximum(least[part], np.partition(score, -k, axis=1)[:, -k]) if k < size else least[part]
                    q, slot = np.nonzero((score > 0) & (score >= last[:, None] - TOLERANCE))
                    if len(q):
                        kept.append((part[q], chunks.take(pa.array(base[i] + slot)), score[q, slot]))
                fresh += len(live) > 0
                if fresh == most:
                    kept, fresh = _cut(kept, k, least), 0
        for q, chunk, score in _cut(kept, k, least):
            yield pa.RecordBatch.from_arrays([asked.names.take(pa.array(q)), chunk, pa.array(score)], names=["query_id", "chunk_id", "score"])

    return topk(blocks.select("block", "terms", "tops", "slots", "impacts", "ids").mapInArrow(scan, f"query_id {kind}, chunk_id {ids}, score double"), k)


def _cut(kept: list, k: int, least: np.ndarray) -> list:
    """Of hits (query, chunk id, score) in parts those, in one part, that can be among the ``k`` best of their query; ``least`` rises to the k-th best.

    Of equal scores only the ``k`` smallest ids can.
    """
    if not kept:
        return kept
    q, chunk, score = (join([x[c] for x in kept]) for c, join in enumerate((np.concatenate, pa.concat_arrays, np.concatenate)))

    def nth(same):
        begin = np.flatnonzero(np.concatenate([[True], ~same]))
        return np.arange(len(same) + 1) - np.repeat(begin, np.diff(np.concatenate([begin, [len(same) + 1]])))

    order = np.lexsort((_coded(chunk)[0], -score, q))
    a, s = q[order], score[order]
    order = order[nth((a[1:] == a[:-1]) & (s[1:] == s[:-1])) < k]
    a, s = q[order], score[order]
    last = nth(a[1:] == a[:-1]) == k - 1
    least[a[last]] = np.maximum(least[a[last]], s[last])
    order = order[s >= least[a] - TOLERANCE]
    return [(q[order], chunk.take(pa.array(order)), score[order])]


def reach(asked: Asked, index: LexicalIndex, kind: str, k: int) -> Asked:
    """``asked`` with, as least score of each query, the k-th best in the most promising blocks."""
    promising = W.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    seeds = durable(block_bounds(asked, index, kind, SEEDS).withColumn("_n", F.row_number().over(promising)).where(F.col("_n") <= SEEDS).select("block").distinct())
    found = score_blocks(asked, index.blocks.join(F.broadcast(seeds), "block", "left_semi"), kind, k).where(F.col("rank") == k).select("query_id", "score").toArrow()
    if found.num_rows:
        at = pc.index_in(found["query_id"].combine_chunks(), asked.names).to_numpy(zero_copy_only=False)
        asked.least[at] = found["score"].to_numpy()
    return asked


def surviving_blocks(weights: DataFrame, index: LexicalIndex, k: int) -> tuple[DataFrame, DataFrame]:
    """The (query_id, block) pairs whose bound reaches the query's k-th best score in its most promising blocks, and all pairs."""
    kind, spark = weights.schema["query_id"].dataType.simpleString(), weights.sparkSession
    kept, every = [], []
    for asked in _rounds(weights):
        every.append(block_bounds(reach(asked, index, kind, k), index, kind))
        least = spark.createDataFrame(pa.table({"query_id": asked.names, "_least": asked.least}))
        kept.append(every[-1].join(least, "query_id").where(F.col("bound") >= F.col("_least") - TOLERANCE).select("query_id", "block"))
    none = spark.createDataFrame([], f"query_id {kind}, block long, bound double")
    return reduce(DataFrame.union, kept, none.drop("bound")), reduce(DataFrame.union, every, none)


def bm25_search(queries: DataFrame, index: LexicalIndex, k: int, query: str = "query") -> DataFrame:
    """Top ``k`` chunks with positive score for every row of ``queries`` (query_id, query), the same as scoring all chunks.

    The hits are written, so that joins know how few they are and do not move what they meet.
    """
    weights = durable(query_weights(queries, index, query))
    kind, ids = weights.schema["query_id"].dataType.simpleString(), index.blocks.schema["ids"].dataType.elementType.simpleString()
    found = [score_blocks(reach(asked, index, kind, k), index.blocks, kind, k) for asked in _rounds(weights)]
    return durable(reduce(DataFrame.union, found, weights.sparkSession.createDataFrame([], f"query_id {kind}, chunk_id {ids}, score double, rank int")))
