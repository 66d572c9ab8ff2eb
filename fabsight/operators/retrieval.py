"""Document chunks, lexical and vector search for a table of queries, fusion, evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from fabsight import constants as K
from fabsight.functions.text import let, mentions_codes, strip, tokenize_whitespace, words
from fabsight.functions.vectors import minmax
from fabsight.operators.lexical import TIE_PLACES, LexicalIndex, bm25_search, topk
from fabsight.plans.metric import MetricIndex, metric_index, nearest, packed
from fabsight.session import durable, spread
from fabsight.sources.tables import purge_except, replace_partition


def _cut(tokens: Column, most: int) -> Column:
    """Consecutive groups of ``most`` tokens as text, inside the row (no shuffle)."""
    def groups(t):
        n = F.size(t)
        at = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / most).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(t, i * most + 1, F.lit(most)), " "))
    return let(tokens, groups)


#: Documents whose chunks, and chunks whose vectors, a task holds at a time; so many times as many documents are dealt to a task as for heavier work.
CUT_ROWS, VECTOR_ROWS, CUT_TIMES = 256, 1_024, 4


def _named(out: DataFrame, doc: str) -> DataFrame:
    return out.withColumn("chunk_id", F.concat_ws("#", F.col(doc).cast("string"), F.col("chunk_index").cast("string")))


def chunk_by_tokens(docs: DataFrame, max_tokens: int, doc: str = "doc_id", text: str = "text", normalized: bool = False) -> DataFrame:
    """Windows of ``max_tokens`` words of the normalized text, numbered; texts pass through Python once and are cut there."""
    if max_tokens <= 0:
        raise ValueError("max_tokens must be positive")
    docs = spread(docs, CUT_TIMES)
    others = [c for c in docs.columns if c != text]
    split = str.split if normalized else words

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CUT_ROWS):
                b = whole.slice(at, CUT_ROWS)
                row, number, content = [], [], []
                for i, value in enumerate(b.column(len(others))):
                    found = split(value.as_py()) if value.is_valid else []
                    pieces = [" ".join(found[j:j + max_tokens]) for j in range(0, len(found), max_tokens)]
                    row += [i] * len(pieces)
                    number += range(len(pieces))
                    content += pieces
                at_row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*[c.take(at_row) for c in b.columns[:len(others)]], pa.array(number, pa.int32()), pa.array(content, pa.string())],
                                                 names=[*others, "chunk_index", "content"])

    kinds = T.StructType([*[docs.schema[c] for c in others], T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType())])
    return _named(docs.select(*others, text).mapInArrow(cut, kinds), doc)


def chunk_by_heading(docs: DataFrame, max_tokens: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Split before every heading line, then by tokens inside a section."""
    marked = F.regexp_replace(F.col(text), "(^|\\n)(#{1,6} )", "$1\u0001$2")
    sections = F.split(marked, "\u0001")
    pieces = F.flatten(F.transform(sections, lambda s: _cut(tokenize_whitespace(s), max_tokens)))
    kept = F.filter(F.transform(pieces, strip), lambda x: x != "")
    return _named(docs.select("*", F.posexplode(kept).alias("chunk_index", "content")), doc).drop(text)


def build_chunk_rows(chunks: DataFrame, equipment_type: Column | None = None, alarm_code: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return chunks.select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), "chunk_index",
                         (equipment_type if equipment_type is not None else none).alias("equipment_type"),
                         (alarm_code if alarm_code is not None else none).alias("alarm_code"), "content")


def buckets(terms: pa.Array, dim: int) -> np.ndarray:
    """The bucket of each term as Spark's ``HashingTF`` has it: Murmur3 of the bytes, seed 42."""
    terms = terms.cast(pa.large_string()).cast(pa.large_binary())
    edge = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset:terms.offset + len(terms) + 1]
    data, begin, size = np.frombuffer(terms.buffers()[2] or b"", np.uint8).astype(np.uint32), edge[:-1], np.diff(edge)

    def mixed(k: np.ndarray) -> np.ndarray:
        k = k * np.uint32(0xCC9E2D51)
        return (k << 15 | k >> 17) * np.uint32(0x1B873593)

    h, at = np.full(len(terms), 42, np.uint32), np.arange(len(terms))
    for i in range(0, int(size.max(initial=0)) // 4 * 4, 4):
        at = at[size[at] >= i + 4]
        p = begin[at] + i
        x = h[at] ^ mixed(data[p] | data[p + 1] << 8 | data[p + 2] << 16 | data[p + 3] << 24)
        h[at] = (x << 13 | x >> 19) * np.uint32(5) + np.uint32(0xE6546B64)
    rest, k = size % 4, np.zeros(len(terms), np.uint32)
    for j in range(3):
        at = np.flatnonzero(rest > j)
        k[at] |= data[begin[at] + size[at] - rest[at] + j] << 8 * j
    h ^= mixed(k) ^ size.astype(np.uint32)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * np.uint32(by)
    return h.view(np.int32) % dim


def term_counts(texts: pa.Array, dim: int) -> np.ndarray:
    """Texts by buckets: how often each is said."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    said = lists.flatten().dictionary_encode()
    code, some = said.indices.to_numpy(), pc.greater(pc.binary_length(said.dictionary), 0).to_numpy(zero_copy_only=False)
    kept = some[code] if len(code) else np.zeros(0, dtype=bool)
    at = row[kept] * dim + buckets(said.dictionary, dim)[code[kept]]
    return np.bincount(at, minlength=len(lists) * dim).reshape(len(lists), dim)


def hashed_vectors(chunks: DataFrame, dim: int = 256) -> DataFrame:
    """Normalized hashed term weights, for chunks that come without vectors: ``HashingTF``, ``IDF`` and ``Normalizer`` in two passes.

    The first adds up in how many chunks a bucket is (a row per task reaches the driver), the second makes the vectors.
    """
    names = chunks.columns
    asked = chunks.select("*", F.lower("content").alias("_low"))

    def parts(batches):
        for b in batches:
            for at in range(0, b.num_rows, VECTOR_ROWS):
                yield b.slice(at, VECTOR_ROWS)

    def held(batches):
        rows, many = 0, np.zeros(dim, dtype=np.int64)
        for b in parts(batches):
            rows, many = rows + b.num_rows, many + (term_counts(b.column(0), dim) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([many], pa.list_(pa.int64()))], names=["n", "many"])

    tasks = asked.select("_low").mapInArrow(held, "n long, many array<long>").collect()
    weight = np.log((sum(r["n"] for r in tasks) + 1.0) / (np.sum([r["many"] for r in tasks] or [np.zeros(dim)], axis=0) + 1.0))

    def vectors(batches):
        for b in parts(batches):
            x = term_counts(b.column(len(names)), dim) * weight
            x /= np.maximum(np.sqrt((x ** 2).sum(axis=1, keepdims=True)), 1e-300)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], flat], names=[*names, "embedding"])

    return asked.mapInArrow(vectors, T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def ingest_corpus(existing: DataFrame, docs: DataFrame, manifest: DataFrame, max_tokens: int, dim: int = 256) -> DataFrame:
    """Chunks of the listed documents replace their old rows; chunks of unlisted documents go."""
    listed = docs.join(manifest, "doc_id")
    # written: the weights, the listed documents and the vectors each need the chunks
    rows = durable(build_chunk_rows(chunk_by_tokens(listed, max_tokens), F.col("equipment_type")))
    fresh = hashed_vectors(rows, dim)
    merged = replace_partition(existing.select(*fresh.columns), fresh)
    return purge_except(merged, manifest.select(F.col("doc_id").cast("string").alias("doc_id")))


# ---- vectors -----------------------------------------------------------------------------------

def dense_index(chunks: DataFrame, tag: str | None = None, vector: str = "embedding") -> MetricIndex:
    """Chunk vectors laid out for ``dense_search``; with ``tag``, by that column."""
    return metric_index(chunks, "chunk_id", vector, unit=True, group=tag)


def dense_search(queries: DataFrame, index: MetricIndex, k: int, tag: str | None = None, vector: str = "embedding") -> DataFrame:
    """Exact cosine top ``k`` per query; blocks that the triangle inequality rules out are not met.

    With ``tag``, chunks of the query's tag count, and a query for which no chunk has the tag falls back to all chunks.
    """
    asked = queries.withColumn("grp", F.lit(None).cast("string"))
    if tag:
        known = index.rows.select("grp").distinct()
        asked = queries.join(known, F.col(tag).cast("string") == F.col("grp"), "left")
    best = lambda found: topk(found.withColumnRenamed("id", "chunk_id"), k)
    return nearest(packed(asked, [F.col("query_id"), F.col("grp")], vector, True), index, k, finish=best)


def min_score_filter(hits: DataFrame, least: float = K.MIN_SCORE) -> DataFrame:
    return hits.where(F.col("score") >= least)


def minmax_per_query(hits: DataFrame, name: str = "norm") -> DataFrame:
    """0..1 per query, equal scores 1, present candidates at least 1e-6 (candidate lists are at most a pool long)."""
    w = W.partitionBy("query_id")
    return hits.withColumn(name, F.greatest(minmax(F.col("score"), F.min("score").over(w), F.max("score").over(w)), F.lit(1e-6)))


def convex_fuse(dense: DataFrame, sparse: DataFrame, alpha: float, k: int) -> DataFrame:
    """``alpha * dense + (1 - alpha) * sparse`` on normalized scores; a query with one empty side keeps the other."""
    if not 0.0 <= alpha <= 1.0:
        raise ValueError("alpha must be in [0, 1]")
    d = minmax_per_query(dense, "_d").select("query_id", "chunk_id", "_d", F.col("score").alias("_ds"))
    s = minmax_per_query(sparse, "_s").select("query_id", "chunk_id", "_s", F.col("score").alias("_ss"))
    both = d.join(s, ["query_id", "chunk_id"], "full_outer")
    w = W.partitionBy("query_id")
    has_d, has_s = F.max(F.col("_d").isNotNull()).over(w), F.max(F.col("_s").isNotNull()).over(w)
    mixed = F.lit(alpha) * F.coalesce("_d", F.lit(0.0)) + F.lit(1.0 - alpha) * F.coalesce("_s", F.lit(0.0))
    score = F.when(~has_s, F.col("_ds")).when(~has_d, F.col("_ss")).otherwise(mixed)
    fused = both.select("query_id", "chunk_id", score.alias("score"), F.col("_d").isNull().cast("int").alias("_side"),
                        F.coalesce("_ds", "_ss").alias("_own"))
    return topk(fused, k, [F.desc(F.round("score", TIE_PLACES)), F.asc("_side"), F.desc(F.round("_own", TIE_PLACES)), F.asc("chunk_id")]).drop("_side", "_own")


def explicit_code_filter(hits: DataFrame, query: str = "query", content: str = "content") -> DataFrame:
    return hits.where(mentions_codes(F.col(query), F.col(content)))


def hybrid_search(queries: DataFrame, chunks: DataFrame, vectors: MetricIndex, terms: LexicalIndex, k: int = K.TOP_K, pool: int = K.RERANK_POOL,
                  least: float = K.MIN_SCORE, alpha: float = K.FUSION_ALPHA, tag: str | None = None) -> DataFrame:
    """Vector and lexical candidates, threshold, fusion, explicit-code filter, cut to ``k``; ``tag`` as in ``dense_search``."""
    dense = min_score_filter(dense_search(queries.select("query_id", "embedding", *([tag] if tag else [])), vectors, pool, tag), least)
    sparse = bm25_search(queries, terms, pool)
    fused = convex_fuse(dense, sparse, alpha, pool).drop("rank")
    full = fused.join(chunks.select("chunk_id", "doc_id", "content"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
    return topk(explicit_code_filter(full), k).drop("query")


def dedup_citations(hits: DataFrame, key: str, order: str, text: str, most: int = K.EXCERPT_CHARS) -> DataFrame:
    """One citation per ``key``: the excerpt of its first hit, trimmed and cut to ``most`` characters."""
    excerpt = F.substring(F.trim(text), 1, most)
    return hits.groupBy(key).agg(F.min_by(excerpt, order).alias("excerpt"))


def rerank_by_score(hits: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Reorder candidates by supplied relevance; candidates without one keep their order behind the others."""
    joined = hits.join(scores.select("query_id", "chunk_id", F.col("score").alias("_new")), ["query_id", "chunk_id"], "left")
    order = [F.desc_nulls_last("_new"), F.asc("_old")]
    ranked = joined.withColumnRenamed("rank", "_old")
    rn = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return ranked.withColumn("rank", rn).where(F.col("rank") <= k).withColumn("score", F.coalesce("_new", "score")).drop("_new", "_old")


def passage_matches(passages: DataFrame, docs: DataFrame, words: int = 4) -> DataFrame:
    """(item_id, doc_id) where the document holds the passage verbatim.

    Of the inner word sequences of a passage (``words`` long, or all inner words of a shorter one) the one in fewest documents
    is looked up by hash (equi join); only those candidates are compared in full.  A passage needs at least three words, as its
    first and last may be parts of a document's words.
    """
    p = passages.withColumn("_t", tokenize_whitespace(F.col("text"))).withColumn("_n", F.least(F.lit(int(words)), F.size("_t") - 2))
    if not p.where("_n < 1").isEmpty():
        raise ValueError("a passage needs at least three words")

    def sequences(t, n, first, last):
        """Hashes of the ``n`` words from every position from ``first`` to ``last`` on."""
        return F.when(last >= first, F.transform(F.sequence(first, last), lambda i: F.xxhash64(n, F.array_join(F.slice(t, i, n), " "))))

    wanted = p.select("item_id", F.explode(F.array_distinct(sequences(F.col("_t"), F.col("_n"), F.lit(2), F.size("_t") - F.col("_n")))).alias("_h"))
    lengths = sorted(r["_n"] for r in p.select("_n").distinct().collect())  # at most ``words`` numbers
    every = lambda t: F.flatten(F.array(*[F.coalesce(sequences(t, F.lit(n), F.lit(1), F.size(t) - n + 1), F.array().cast("array<bigint>")) for n in lengths]))
    grams = docs.select("doc_id", F.explode(F.array_distinct(let(tokenize_whitespace(F.col("text")), every))).alias("_h"))
    found = durable(grams.join(wanted.select("_h").distinct(), "_h"))
    counts = found.groupBy("_h").agg(F.count(F.lit(1)).alias("_c"))
    rarest = wanted.join(counts, "_h", "left").groupBy("item_id").agg(F.min_by("_h", F.struct(F.coalesce("_c", F.lit(0)), "_h")).alias("_h"))
    cand = found.join(rarest, "_h").join(passages.select("item_id", F.col("text").alias("_passage")), "item_id")
    return cand.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "_passage")).select("item_id", "doc_id").distinct()


def retrieval_metrics(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Per case hit@k, recall@k and reciprocal rank; cases are those with expected documents."""
    if k < 1:
        raise ValueError("k must be at least 1")
    docs = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    found = expected.join(docs, ["query_id", "doc_id"], "left")
    return found.groupBy("query_id").agg(
        F.max(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")).alias("hit"),
        (F.count_if(F.col("rank") <= k) / F.count(F.lit(1))).alias("recall"),
        F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("rr"))


def macro_means(per_case: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return per_case.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("hit"), zero).alias("hit_at_k"),
                        F.coalesce(F.avg("recall"), zero).alias("recall_at_k"), F.coalesce(F.avg("rr"), zero).alias("mrr"))
