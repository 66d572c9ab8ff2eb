"""Chunking, lexical and vector search, fusion and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabsight.functions import text as X, vectors as V
from fabsight.operators import lexical as L, retrieval as R
from fabsight.registry import query
from fabsight.views import SQL_VIEWS

_B = r"\t\x{000B}\x{000C}\x{001C}-\x{001F} \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_S = r"\n\r" + _B


def TOK(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '[{_S}]+'), lambda x: x <> '')"




def _norm_sql(t: str) -> str:
    t = rf"regexp_replace({t}, '\r\n?', chr(10), 'g')"
    t = f"nfc_normalize({t})"
    t = rf"regexp_replace({t}, '[\x{{00AD}}\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}]', '', 'g')"
    t = rf"regexp_replace({t}, '[\x{{00}}-\x{{08}}\x{{0B}}-\x{{1F}}\x{{7F}}-\x{{9F}}]', '', 'g')"
    t = rf"regexp_replace({t}, '([A-Za-z])-\n([A-Za-z])', '\1\2', 'g')"
    t = rf"regexp_replace({t}, '[ \t]+', ' ', 'g')"
    t = rf"regexp_replace({t}, '[{_B}]+\n', chr(10), 'g')"
    t = rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace(regexp_replace({t}, '^[{_S}]+', ''), '[{_S}]+$', '')"


MAX_TOKENS = 128
SQL_VIEWS["norm_docs"] = f"SELECT doc_id, source, {_norm_sql('text')} AS text FROM documents"
SQL_VIEWS["chunks"] = f"""SELECT doc_id, CAST(doc_id AS VARCHAR) || '#' || CAST(i AS VARCHAR) AS chunk_id, i AS chunk_index,
 array_to_string(list_slice(t, i * {MAX_TOKENS} + 1, i * {MAX_TOKENS} + {MAX_TOKENS}), ' ') AS content FROM (
 SELECT doc_id, t, unnest(range((len(t) + {MAX_TOKENS - 1}) // {MAX_TOKENS})) AS i FROM (SELECT doc_id, {TOK('text')} AS t FROM norm_docs) a) b"""
SQL_VIEWS["posts"] = f"""SELECT chunk_id, term, count(*) AS tf, any_value(n) AS length FROM (SELECT chunk_id, unnest(t) AS term, len(t) AS n FROM
(SELECT chunk_id, {TOK('content')} AS t FROM chunks) a) b GROUP BY 1, 2"""
SQL_VIEWS["idfs"] = """SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM (
SELECT term, count(*) AS df, ln((SELECT count(*) FROM chunks) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posts GROUP BY 1) x"""
SQL_VIEWS["bm25"] = f"""SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
SELECT q.query_id, p.chunk_id, sum(q.qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / (SELECT sum(tf) / count(DISTINCT chunk_id) FROM posts)))) AS score
FROM (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOK('text')}) AS term FROM benchmark) a GROUP BY 1, 2) q
JOIN posts p ON q.term = p.term JOIN idfs i ON p.term = i.term GROUP BY 1, 2) s"""
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SQL_VIEWS["chunk_vecs"] = f"SELECT chunk_id, doc_id, content, list_transform(string_split('{','.join(LETTERS)}', ','), lambda l: CAST(len(lower(content)) - len(replace(lower(content), l, '')) AS DOUBLE)) AS v FROM chunks"
SQL_VIEWS["query_vecs"] = f"SELECT item_id AS query_id, text, list_transform(string_split('{','.join(LETTERS)}', ','), lambda l: CAST(len(lower(text)) - len(replace(lower(text), l, '')) AS DOUBLE)) AS v FROM benchmark"
SQL_VIEWS["dense"] = """SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
SELECT query_id, chunk_id, list_cosine_similarity(q.v, c.v) AS score FROM query_vecs q CROSS JOIN chunk_vecs c) x"""
SQL_VIEWS["fused"] = """SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, side, round(own, 9) DESC, chunk_id) AS rank FROM (
SELECT query_id, chunk_id, CASE WHEN max(CAST(sn IS NOT NULL AS INT)) OVER w = 0 THEN ds WHEN max(CAST(dn IS NOT NULL AS INT)) OVER w = 0 THEN ss
 ELSE 0.5 * coalesce(dn, 0) + 0.5 * coalesce(sn, 0) END AS score, CAST(dn IS NULL AS INT) AS side, coalesce(ds, ss) AS own
FROM (SELECT query_id, chunk_id, score AS ds, greatest(CASE WHEN max(score) OVER v <= min(score) OVER v THEN 1.0 ELSE (score - min(score) OVER v) / (max(score) OVER v - min(score) OVER v) END, 1e-6) AS dn
  FROM dense WHERE rank <= 10 AND score >= 0.2 WINDOW v AS (PARTITION BY query_id)) d
FULL JOIN (SELECT query_id, chunk_id, score AS ss, greatest(CASE WHEN max(score) OVER v <= min(score) OVER v THEN 1.0 ELSE (score - min(score) OVER v) / (max(score) OVER v - min(score) OVER v) END, 1e-6) AS sn
  FROM bm25 WHERE rank <= 10 AND score > 0 WINDOW v AS (PARTITION BY query_id)) s USING (query_id, chunk_id) WINDOW w AS (PARTITION BY query_id)) z"""
SQL_VIEWS["relevant"] = "SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


def chunks(v):
    """The stored chunk collection: written once per session, as an ingest job would leave it."""
    return v.stored("chunks", lambda: R.chunk_by_tokens(v.table("documents").select("doc_id", "text"), MAX_TOKENS), "zstd")


def lexical(v):
    """The stored postings of the chunks."""
    if "lexical" not in v._stored:
        v._stored["lexical"] = L.bm25_index(chunks(v))
    return v._stored["lexical"]


def letters(text):
    low = F.lower(text)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])


def chunk_vecs(v):
    return v.stored("chunk_vecs", lambda: chunks(v).withColumn("embedding", letters(F.col("content"))))


def dense(v):
    """The chunk vectors laid out by pivots."""
    if "dense" not in v._stored:
        v._stored["dense"] = R.dense_index(chunk_vecs(v))
    return v._stored["dense"]


def queries_(v):
    return v.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), letters(F.col("text")).alias("embedding"))


def relevant(v):
    return R.passage_matches(v.table("benchmark"), v.table("documents")).select(F.col("item_id").alias("query_id"), "doc_id")


@query("normalize_text", "SELECT doc_id, length(text) AS n, md5(text) AS h FROM norm_docs")
def normalize_text(v):
    t = v.table("documents").select("doc_id", X.normalize_text(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").alias("n"), F.md5(F.col("t").cast("binary")).alias("h"))


@query("nfc", "SELECT doc_id, md5(nfc_normalize(text)) AS h FROM documents")
def nfc(v):
    return v.table("documents").select("doc_id", F.md5(X.nfc("text").cast("binary")).alias("h"))


@query("tokenize_whitespace", f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, '|')) AS h FROM (SELECT doc_id, {TOK('text')} AS t FROM documents) x")
def tokenize_whitespace(v):
    t = v.table("documents").select("doc_id", X.tokenize_whitespace(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", "|").cast("binary")).alias("h"))


@query("tokenize_bigram", rf"""SELECT doc_id, len(t) AS n, md5(array_to_string(t, '|')) AS h FROM (SELECT doc_id, list_concat(list_transform(regexp_extract_all(text, '{X.CODE_TOKEN}'), lambda x: lower(x)),
 list_transform(range(1, length(r)), lambda i: substring(r, i, 2))) AS t FROM (SELECT doc_id, text, regexp_replace(regexp_replace(text, '{X.CODE_TOKEN}', ' ', 'g'), '[{_S}]+', '', 'g') AS r FROM documents) a) b""")
def tokenize_bigram(v):
    t = v.table("documents").select("doc_id", X.tokenize_bigram(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", "|").cast("binary")).alias("h"))


@query("chunk_by_tokens", "SELECT doc_id, chunk_index, md5(content) AS h FROM chunks")
def chunk_by_tokens(v):
    return chunks(v).select("doc_id", "chunk_index", F.md5(F.col("content").cast("binary")).alias("h"))


@query("chunk_by_heading", rf"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '(^|\n)(#{{1,6}} )', '\1' || chr(1) || '\2', 'g'), chr(1))) AS sec FROM documents),
n AS (SELECT doc_id, count(*) AS parts FROM (SELECT doc_id, unnest(range((len(t) + 63) // 64)) FROM (SELECT doc_id, {TOK('sec')} AS t FROM s) a) b GROUP BY 1)
SELECT doc_id, parts FROM n""")
def chunk_by_heading(v):
    out = R.chunk_by_heading(v.table("documents").select("doc_id", "text"), 64)
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"))


@query("build_chunk_rows", """SELECT chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, chunk_index, CASE doc_id % 3 WHEN 0 THEN 'P0' WHEN 1 THEN 'P1' END AS equipment_type,
CASE WHEN doc_id % 4 <> 0 THEN 'ERR-40' || (doc_id % 4) END AS alarm_code, content, length(content) AS n FROM chunks""")
def build_chunk_rows(v):
    # the manifest: a document is about a type of equipment and an alarm; every third names no type, every fourth no alarm
    doc = F.col("doc_id")
    kind = F.when(doc % 3 == 0, "P0").when(doc % 3 == 1, "P1")
    code = F.when(doc % 4 != 0, F.concat(F.lit("ERR-40"), (doc % 4).cast("string")))
    return R.build_chunk_rows(chunks(v), kind, code).withColumn("n", F.length("content"))


@query("ingest_corpus", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS parts, 256 AS dim FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1")
def ingest_corpus(v):
    docs = v.table("documents").select("doc_id", "text")
    manifest = v.table("labels").select("doc_id", F.lit("P0").alias("equipment_type")).distinct()
    # the stored collection: every document in coarser chunks, of which listed ones are replaced and others purged
    stored = R.hashed_vectors(v.stored("coarse_chunks", lambda: R.build_chunk_rows(R.chunk_by_tokens(docs, 512)), "zstd"))
    out = R.ingest_corpus(stored, docs, manifest, MAX_TOKENS)
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.max(F.size("embedding")).alias("dim"))


@query("dim_check", "SELECT count(*) FILTER (len(embedding) <> 64) AS violations, count(*) AS n FROM embeddings")
def dim_check(v):
    return v.table("embeddings").agg(V.dim_violations(F.col("embedding"), 64).alias("violations"), F.count(F.lit(1)).alias("n"))


@query("bm25_index", """SELECT p.chunk_id, any_value(p.length) AS length, count(*) AS terms, md5(string_agg(p.term || ':' || p.tf, ' ' ORDER BY p.term || ':' || p.tf)) AS postings,
CAST(sum(i.df) AS BIGINT) AS df, round(sum(i.idf), 6) AS idf,
round(max(p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.length / (SELECT sum(tf) / count(DISTINCT chunk_id) FROM posts)))), 8) AS impact
FROM posts p JOIN idfs i ON p.term = i.term GROUP BY 1""")
def bm25_index(v):
    """Every posting, chunk by chunk: its terms and counts, their statistics and the largest impact."""
    return L.chunk_postings(lexical(v)).withColumns({"idf": F.round("idf", 6), "impact": F.round("impact", 8)})


@query("bm25_search", "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bm25 WHERE rank <= 10 AND score > 0")
def bm25_search(v):
    return L.bm25_search(queries_(v), lexical(v), 10).withColumn("score", F.round("score", 6))


@query("bm25_topk", "SELECT query_id, chunk_id, rank FROM bm25 WHERE rank <= 3 AND score > 0")
def bm25_topk(v):
    return L.bm25_search(queries_(v), lexical(v), 3).select("query_id", "chunk_id", "rank")


SQL_VIEWS["centroids"] = """SELECT label AS query_id, CASE WHEN label % 3 = 0 THEN label + 100 ELSE label END AS tag, list(m ORDER BY i) AS v FROM (
SELECT label, i, avg(x) AS m FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) a GROUP BY 1, 2) b GROUP BY 1"""


def centroids(v):
    long = v.table("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    per = long.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = per.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"))  # one entry per dimension
    tag = F.when(F.col("label") % 3 == 0, F.col("label") + 100).otherwise(F.col("label"))
    return packed.select(F.col("label").alias("query_id"), tag.alias("tag"), F.transform("p", lambda r: r["m"]).alias("embedding"))


@query("dense_search", """WITH s AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(v, CAST(embedding AS DOUBLE[])) AS score, label = tag AS own FROM centroids CROSS JOIN embeddings),
f AS (SELECT *, max(CAST(own AS INT)) OVER (PARTITION BY query_id) = 1 AS tagged FROM s),
r AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM f WHERE own OR NOT tagged)
SELECT query_id, chunk_id, round(score, 8) AS score, rank FROM r WHERE rank <= 5""")
def dense_search(v):
    stored = v.table("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("tag"), "embedding")
    return R.dense_search(centroids(v), R.dense_index(stored, "tag"), 5, "tag").withColumn("score", F.round("score", 8))


@query("vector_topk", "SELECT query_id, chunk_id, round(score, 8) AS score, rank FROM dense WHERE rank <= 3")
def vector_topk(v):
    return R.dense_search(queries_(v), dense(v), 3).withColumn("score", F.round("score", 8))


@query("min_score_filter", "SELECT query_id, chunk_id, rank FROM dense WHERE rank <= 10 AND score >= 0.97")
def min_score_filter(v):
    return R.min_score_filter(R.dense_search(queries_(v), dense(v), 10), 0.97).select("query_id", "chunk_id", "rank")


@query("minmax_normalize", """SELECT query_id, chunk_id, round(greatest(CASE WHEN max(score) OVER w <= min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 1e-6), 6) AS norm
FROM bm25 WHERE rank <= 10 AND score > 0 WINDOW w AS (PARTITION BY query_id)""")
def minmax_normalize(v):
    return R.minmax_per_query(L.bm25_search(queries_(v), lexical(v), 10)).select("query_id", "chunk_id", F.round("norm", 6).alias("norm"))


@query("candidate_union", "SELECT query_id, chunk_id FROM dense WHERE rank <= 10 AND score >= 0.2 UNION SELECT query_id, chunk_id FROM bm25 WHERE rank <= 10 AND score > 0")
def candidate_union(v):
    d = R.min_score_filter(R.dense_search(queries_(v), dense(v), 10))
    return R.convex_fuse(d, L.bm25_search(queries_(v), lexical(v), 10), 0.5, 1000).select("query_id", "chunk_id")


@query("convex_fuse", "SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM fused WHERE rank <= 10")
def convex_fuse(v):
    d = R.min_score_filter(R.dense_search(queries_(v), dense(v), 10))
    return R.convex_fuse(d, L.bm25_search(queries_(v), lexical(v), 10), 0.5, 10).withColumn("score", F.round("score", 9))


@query("fused_topk", "SELECT query_id, chunk_id, rank FROM fused WHERE rank <= 3")
def fused_topk(v):
    d = R.min_score_filter(R.dense_search(queries_(v), dense(v), 10))
    return R.convex_fuse(d, L.bm25_search(queries_(v), lexical(v), 10), 0.5, 3).select("query_id", "chunk_id", "rank")


@query("hybrid_search", """WITH f AS (SELECT query_id, chunk_id, score FROM fused WHERE rank <= 10),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM f)
SELECT r.query_id, r.chunk_id, c.doc_id, r.rank FROM r JOIN chunks c USING (chunk_id) WHERE r.rank <= 3""")
def hybrid_search(v):
    return R.hybrid_search(queries_(v), chunk_vecs(v), dense(v), lexical(v), 3, 10).select("query_id", "chunk_id", "doc_id", "rank")


@query("explicit_code_filter", """SELECT b.query_id, c.chunk_id FROM bm25 b JOIN chunks c USING (chunk_id) WHERE b.rank <= 10 AND b.score > 0
AND (c.chunk_index % 3 = b.query_id % 3 OR b.query_id % 4 = 0)""")
def explicit_code_filter(v):
    # chunk i is about alarm ERR-40(i mod 3); most queries name one code, every fourth names none
    hits = L.bm25_search(queries_(v), lexical(v), 10).join(chunks(v).select("chunk_id", "chunk_index", "content"), "chunk_id")
    content = F.concat("content", F.lit(" ERR-40"), (F.col("chunk_index") % 3).cast("string"))
    code = F.when(F.col("query_id") % 4 == 0, "status").otherwise(F.concat(F.lit("about err-40"), (F.col("query_id") % 3).cast("string"), F.lit("?")))
    return R.explicit_code_filter(hits.withColumns({"query": code, "content": content})).select("query_id", "chunk_id")


@query("rerank_by_score", f"""WITH h AS (SELECT query_id, chunk_id, rank FROM dense WHERE rank <= 10),
s AS (SELECT h.query_id, h.chunk_id, count(*) AS score FROM h JOIN posts p USING (chunk_id)
  JOIN (SELECT DISTINCT item_id AS query_id, unnest({TOK('text')}) AS term FROM benchmark) q ON q.query_id = h.query_id AND q.term = p.term GROUP BY 1, 2),
r AS (SELECT h.query_id, h.chunk_id, s.score, row_number() OVER (PARTITION BY h.query_id ORDER BY s.score DESC NULLS LAST, h.rank) AS rank FROM h LEFT JOIN s USING (query_id, chunk_id))
SELECT query_id, chunk_id, rank FROM r WHERE rank <= 3""")
def rerank_by_score(v):
    c = chunk_vecs(v)
    hits = R.dense_search(queries_(v), dense(v), 10)
    words = queries_(v).select("query_id", F.array_distinct(X.tokenize_whitespace(F.col("query"))).alias("q"))
    shared = hits.join(c.select("chunk_id", X.tokenize_whitespace(F.col("content")).alias("t")), "chunk_id").join(words, "query_id")
    scores = shared.select("query_id", "chunk_id", F.size(F.array_intersect("q", "t")).cast("double").alias("score")).where("score > 0")
    return R.rerank_by_score(hits, scores, 3).select("query_id", "chunk_id", "rank")


@query("evaluate_retrieval", """WITH h AS (SELECT b.query_id, c.doc_id, min(b.rank) AS rank FROM bm25 b JOIN chunks c USING (chunk_id) WHERE b.rank <= 10 AND b.score > 0 GROUP BY 1, 2)
SELECT r.query_id, CAST(coalesce(max(CAST(h.rank <= 3 AS INT)), 0) AS DOUBLE) AS hit, round(count(*) FILTER (h.rank <= 3) / count(*), 8) AS recall, round(coalesce(1.0 / min(h.rank), 0), 8) AS rr
FROM relevant r LEFT JOIN h ON r.query_id = h.query_id AND r.doc_id = h.doc_id GROUP BY 1""")
def evaluate_retrieval(v):
    return per_case(v).withColumns({"recall": F.round("recall", 8), "rr": F.round("rr", 8)})


def per_case(v):
    hits = L.bm25_search(queries_(v), lexical(v), 10)
    withdoc = hits.withColumn("doc_id", F.split("chunk_id", "#")[0].cast("long"))
    return R.retrieval_metrics(withdoc, relevant(v), 3)


@query("retrieval_metrics", """WITH h AS (SELECT b.query_id, c.doc_id, min(b.rank) AS rank FROM bm25 b JOIN chunks c USING (chunk_id) WHERE b.rank <= 10 AND b.score > 0 GROUP BY 1, 2),
e AS (SELECT r.query_id, CAST(coalesce(max(CAST(h.rank <= 3 AS INT)), 0) AS DOUBLE) AS hit, count(*) FILTER (h.rank <= 3) / count(*) AS recall, coalesce(1.0 / min(h.rank), 0) AS rr
FROM relevant r LEFT JOIN h ON r.query_id = h.query_id AND r.doc_id = h.doc_id GROUP BY 1)
SELECT count(*) AS n, round(avg(hit), 8) AS hit_at_k, round(avg(recall), 8) AS recall_at_k, round(avg(rr), 8) AS mrr FROM e""")
def retrieval_metrics(v):
    out = R.macro_means(per_case(v))
    return out.withColumns({c: F.round(c, 8) for c in ("hit_at_k", "recall_at_k", "mrr")})


@query("cosine_similarity", """SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.v), 8) AS cosine FROM embeddings e JOIN centroids c ON e.label = c.query_id""")
def cosine_similarity(v):
    e = v.table("embeddings").join(centroids(v).select(F.col("query_id").alias("label"), F.col("embedding").alias("c")), "label")
    return e.select("vec_id", F.round(V.cosine_similarity(F.col("embedding"), F.col("c")), 8).alias("cosine"))


@query("l2_normalize", """SELECT vec_id, unnest(range(len(n))) AS dim, round(unnest(n), 6) AS x FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS n FROM embeddings) a""")
def l2_normalize(v):
    n = v.table("embeddings").select("vec_id", V.l2_normalize(F.col("embedding")).alias("n"))
    return n.select("vec_id", F.posexplode("n").alias("dim", "x")).withColumns({"dim": F.col("dim").cast("long"), "x": F.round("x", 6)})
