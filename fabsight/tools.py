"""Tool functions: the questions an assistant or analyst asks, as Python functions and SQL table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fabsight import constants as K
from fabsight.functions.text import COUNT_QUERY, SPACE, expand_count_query
from fabsight.operators import alarms as A, maintenance as M, retrieval as R, telemetry as T
from fabsight.operators.lexical import BLOCK_CHUNKS, TIE_PLACES, LexicalIndex
from fabsight.plans.metric import MetricIndex


def get_sensor_logs(telemetry: DataFrame, master: DataFrame, start, end, equipment: str | None = None, line: str | None = None,
                    *, limit: int) -> DataFrame:
    return T.sensor_logs_auto(telemetry, master, start, end, equipment, line, limit=limit)


def get_alarm_history(alarms: DataFrame, start, end, equipment: str | None = None, code: str | None = None) -> DataFrame:
    return A.alarm_history(T.optional_filters(alarms.where(T.closed_range("raised_at", start, end)), equipment_id=equipment, alarm_code=code))


def get_equipment_metadata(master: DataFrame, equipment: str | None = None, line: str | None = None) -> DataFrame:
    return T.optional_filters(master, equipment_id=equipment, line_name=None if equipment else line)


def get_repair_history(repairs: DataFrame, users: DataFrame, equipment: str | None = None, start=None, end=None, limit: int | None = None) -> DataFrame:
    """Repairs of a period with the name of who did them; with ``limit``, the newest so many of each equipment."""
    rows = T.optional_filters(repairs, equipment_id=equipment)
    for bound, inside in ((start, F.col("repaired_at") >= F.lit(start)), (end, F.col("repaired_at") <= F.lit(end))):
        rows = rows if bound is None else rows.where(inside)
    if limit is not None:
        rows = T.top_n_per_key(rows, ["equipment_id"], [F.desc("repaired_at"), F.desc("id")], limit)
    return M.repairs_with_user(rows, users)


def get_maintenance_summary(repairs: DataFrame, equipment: str | None = None, window: int | None = None) -> DataFrame:
    """Summary per equipment over its newest ``window`` repairs; an equipment asked for by name has a row also without repairs."""
    found = M.maintenance_summary(T.optional_filters(repairs, equipment_id=equipment), window)
    if equipment is None:
        return found
    asked = repairs.sparkSession.createDataFrame([(equipment,)], "equipment_id string")
    none = F.map_from_entries(F.array().cast("array<struct<key: string, value: bigint>>"))
    return asked.join(found, "equipment_id", "left").withColumns({
        "repair_count": F.coalesce("repair_count", F.lit(0)), "alarm_code_counts": F.coalesce("alarm_code_counts", none)})


def search_manuals(queries: DataFrame, chunks: DataFrame, vectors: MetricIndex, terms: LexicalIndex, k: int = K.TOP_K, tag: str | None = None,
                   relevance: DataFrame | None = None) -> DataFrame:
    """Chunks for every row of ``queries`` (query_id, query, embedding), best first.

    A question for the number of alarm codes is widened and gets more chunks.  With ``tag`` (a column of ``queries``, for
    vectors indexed by it) vector candidates are those of the query's tag.  ``relevance`` (query_id, chunk_id, score), if
    given, puts the pool in a new order before the cut.
    """
    text, most = expand_count_query(F.col("query"), F.lit(k))
    asked = queries.withColumns({"query": text, "_most": most})
    pool = max(k, K.RERANK_POOL)
    hits = R.hybrid_search(asked, chunks, vectors, terms, pool, pool, tag=tag)
    if relevance is not None:
        hits = R.rerank_by_score(hits, relevance, pool)
    return hits.join(asked.select("query_id", "_most"), "query_id").where(F.col("rank") <= F.col("_most")).drop("_most")


def register(spark: SparkSession, telemetry: DataFrame, alarms: DataFrame, master: DataFrame, repairs: DataFrame, users: DataFrame,
             manuals: DataFrame | None = None, index: LexicalIndex | None = None) -> None:
    """Temporary views and SQL table functions over them; arguments left NULL do not filter.

    ``manuals`` (chunk_id, doc_id, content, tag, embedding) and their lexical ``index`` (split by blanks) are what ``search_manuals``
    searches: the stored postings of the question's words, and one pass over the vectors for the question's embedding.
    A vector of zeros is near to nothing, on either side.
    """
    views = {"fs_telemetry": telemetry, "fs_alarms": alarms, "fs_master": master, "fs_repairs": repairs, "fs_users": users}
    if manuals is not None and index is not None:
        if index.tokenizer != "whitespace":
            raise ValueError("search_manuals splits questions by blanks")
        views |= {"fs_manuals": manuals, "fs_postings": index.postings, "fs_places": index.chunks, "fs_terms": index.terms}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    means = ", ".join(f"avg({c}) AS {c}" for c in K.CHANNELS)
    budget, interval = K.SENSOR_ROW_BUDGET, K.INTERVAL_SECONDS
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION get_sensor_logs(since TIMESTAMP, until TIMESTAMP, eq STRING, line STRING)
RETURNS TABLE(equipment_id STRING, at TIMESTAMP, {", ".join(f"{c} DOUBLE" for c in K.CHANNELS)}, alarm_code STRING)
RETURN WITH asked AS (SELECT since AS s, until AS u, eq AS e, line AS l),
machines AS (SELECT equipment_id FROM fs_master CROSS JOIN asked WHERE e IS NULL AND line_name = l),
size AS (SELECT s, u, e, l, unix_micros(u) - unix_micros(s) AS span, CASE WHEN e IS NOT NULL THEN 1 ELSE greatest(1, n) END AS n
 FROM asked CROSS JOIN (SELECT count(*) AS n FROM fs_master CROSS JOIN asked WHERE l IS NULL OR line_name = l) c),
plan AS (SELECT *, CASE WHEN span / {interval}e6 * n > {budget} THEN greatest(1, CAST(round(span / (greatest(2, {budget} div n) - 1)) AS BIGINT)) END AS width FROM size),
rows AS (SELECT t.*, width, CASE WHEN width IS NULL THEN timestamp ELSE timestamp_micros(unix_micros(s) + (unix_micros(timestamp) - unix_micros(s)) div width * width) END AS at
 FROM fs_telemetry t CROSS JOIN plan WHERE timestamp >= s AND timestamp <= u AND (e IS NULL OR t.equipment_id = e) AND (e IS NOT NULL OR l IS NULL OR t.equipment_id IN (SELECT equipment_id FROM machines))),
said AS (SELECT equipment_id, at, {means}, coalesce(min(alarm_code) FILTER (WHERE alarm_code LIKE 'ERR%'), min(alarm_code)) AS alarm_code, max(width) AS width FROM rows GROUP BY equipment_id, at)
SELECT equipment_id, at, {", ".join(K.CHANNELS)}, alarm_code FROM said ORDER BY CASE WHEN width IS NULL THEN -unix_micros(at) ELSE unix_micros(at) END, equipment_id LIMIT {budget}""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION get_alarm_history(eq STRING, since TIMESTAMP, until TIMESTAMP, code STRING)
RETURNS TABLE(alarm_code STRING, occurrences BIGINT, first_at TIMESTAMP, last_at TIMESTAMP)
RETURN SELECT alarm_code, count(*), min(raised_at), max(raised_at) FROM fs_alarms
WHERE raised_at >= since AND raised_at <= until AND (eq IS NULL OR equipment_id = eq) AND (code IS NULL OR alarm_code = code) GROUP BY alarm_code""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION get_equipment_metadata(eq STRING, line STRING)
RETURNS TABLE(equipment_id STRING, line_name STRING, process_type STRING, location STRING)
RETURN SELECT equipment_id, line_name, process_type, location FROM fs_master WHERE (eq IS NULL OR equipment_id = eq) AND (line IS NULL OR eq IS NOT NULL OR line_name = line)""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION get_repair_history(eq STRING, since TIMESTAMP, until TIMESTAMP, most INT)
RETURNS TABLE(id BIGINT, equipment_id STRING, repaired_at TIMESTAMP, alarm_code_before STRING, repaired_by_name STRING)
RETURN SELECT r.id, equipment_id, repaired_at, alarm_code_before, name FROM (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY repaired_at DESC, id DESC) AS rn FROM fs_repairs
 WHERE (eq IS NULL OR equipment_id = eq) AND (since IS NULL OR repaired_at >= since) AND (until IS NULL OR repaired_at <= until)) r LEFT JOIN fs_users u ON u.id = r.repaired_by
WHERE rn <= coalesce(most, 20)""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION get_maintenance_summary(eq STRING)
RETURNS TABLE(equipment_id STRING, repair_count BIGINT, last_repaired_at TIMESTAMP, alarm_code_counts MAP<STRING, BIGINT>)
RETURN WITH asked AS (SELECT eq AS e),
recent AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.equipment_id ORDER BY repaired_at DESC, id DESC) AS rn FROM fs_repairs r CROSS JOIN asked WHERE e IS NULL OR r.equipment_id = e) x WHERE rn <= {K.SUMMARY_REPAIRS}),
counted AS (SELECT equipment_id, alarm_code_before AS code, count(*) AS n, max(repaired_at) AS last FROM recent GROUP BY equipment_id, alarm_code_before),
said AS (SELECT equipment_id, sum(n) AS n, max(last) AS last, map_from_entries(array_sort(collect_list(CASE WHEN code IS NOT NULL THEN struct(code, n) END))) AS codes FROM counted GROUP BY equipment_id)
SELECT equipment_id, n, last, codes FROM said
UNION ALL SELECT e, 0, CAST(NULL AS TIMESTAMP), CAST(map() AS MAP<STRING, BIGINT>) FROM asked LEFT JOIN said ON said.equipment_id = e WHERE e IS NOT NULL AND said.equipment_id IS NULL""")
    if "fs_manuals" not in views:
        return
    scaled = "greatest(CASE WHEN max(score) OVER () <= min(score) OVER () THEN 1D ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END, 1e-6D)"
    dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (x, y) -> x + y)"
    best = f"ORDER BY round(score, {TIE_PLACES}) DESC, chunk_id LIMIT {K.RERANK_POOL}"
    codes = "array_distinct(transform(regexp_extract_all(q, '(?i)\\\\b(?:ERR|WRN)-\\\\d{3}\\\\b', 0), x -> upper(x)))"
    counting = COUNT_QUERY.replace("\\", "\\\\")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION search_manuals(question STRING, encoded ARRAY<DOUBLE>, k INT, kind STRING)
RETURNS TABLE(chunk_id STRING, doc_id STRING, rank INT, score DOUBLE)
RETURN WITH asked AS (SELECT CASE WHEN question RLIKE '{counting}' THEN concat(question, ' 적용 알람 코드 목록') ELSE question END AS q, encoded AS v, kind AS tag,
 CASE WHEN question RLIKE '{counting}' THEN greatest(coalesce(k, 0), 6) ELSE coalesce(k, {K.TOP_K}) END AS most),
words AS (SELECT term, count(*) AS qtf FROM (SELECT explode(split(q, '[{SPACE}]+')) AS term FROM asked) w WHERE term <> '' GROUP BY term),
hits AS (SELECT p.block, qtf * idf AS weight, explode(arrays_zip(slots, impacts)) AS h FROM fs_postings p JOIN words USING (term) JOIN fs_terms USING (term)),
sparse AS (SELECT p.chunk_id, score FROM (SELECT block * {BLOCK_CHUNKS} + h.slots AS place, sum(weight * h.impacts) AS score FROM hits GROUP BY 1) s JOIN fs_places p USING (place) WHERE score > 0 {best}),
tagged AS (SELECT count(*) AS n FROM fs_manuals m JOIN asked a ON m.tag = a.tag),
compared AS (SELECT m.chunk_id, try_divide({dot("m.embedding", "a.v")}, sqrt({dot("m.embedding", "m.embedding")}) * sqrt({dot("a.v", "a.v")})) AS score FROM fs_manuals m CROSS JOIN asked a CROSS JOIN tagged WHERE n = 0 OR m.tag = a.tag),
dense AS (SELECT * FROM (SELECT chunk_id, score FROM compared WHERE score IS NOT NULL {best}) d WHERE score >= {K.MIN_SCORE}),
both AS (SELECT chunk_id, ds, dn, ss, sn FROM (SELECT chunk_id, score AS ds, {scaled} AS dn FROM dense) d FULL JOIN (SELECT chunk_id, score AS ss, {scaled} AS sn FROM sparse) s USING (chunk_id)),
fused AS (SELECT chunk_id, CASE WHEN max(sn) OVER () IS NULL THEN ds WHEN max(dn) OVER () IS NULL THEN ss ELSE {K.FUSION_ALPHA}D * coalesce(dn, 0D) + {1 - K.FUSION_ALPHA}D * coalesce(sn, 0D) END AS score,
 CAST(dn IS NULL AS INT) AS side, coalesce(ds, ss) AS own FROM both),
pool AS (SELECT chunk_id, score FROM fused ORDER BY round(score, {TIE_PLACES}) DESC, side, round(own, {TIE_PLACES}) DESC, chunk_id LIMIT {K.RERANK_POOL}),
kept AS (SELECT p.chunk_id, m.doc_id, p.score, most FROM pool p JOIN fs_manuals m ON m.chunk_id = p.chunk_id CROSS JOIN asked WHERE size({codes}) = 0 OR exists({codes}, c -> contains(upper(m.content), c)))
SELECT chunk_id, doc_id, rank, score FROM (SELECT chunk_id, CAST(doc_id AS STRING) AS doc_id, CAST(row_number() OVER (ORDER BY round(score, {TIE_PLACES}) DESC, chunk_id) AS INT) AS rank, score, most FROM kept) r WHERE rank <= most""")
