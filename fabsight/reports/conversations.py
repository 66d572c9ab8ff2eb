"""Conversation, text-rule and answer-evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabsight import constants as K
from fabsight.functions import alarms as FA, dates as FD, text as X
from fabsight.operators import conversations as C, neighbors as NB, rules as R, telemetry as T
from fabsight.operators.incidents import LABELS, UNITS
from fabsight.registry import query
from fabsight.views import SQL_VIEWS


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("session_stats", "SELECT session_id, count(*) AS messages, max(message_id) AS last_message FROM sessions GROUP BY 1")
def session_stats(v):
    return C.session_stats(v.sessions)


@query("first_user_message", "SELECT session_id, arg_min(content, message_id) AS content FROM sessions WHERE role = 'user' GROUP BY 1")
def first_user_message(v):
    return C.first_user_message(v.sessions)


@query("last_n_messages", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY message_id DESC) AS rn FROM sessions)
SELECT session_id, string_agg(role || ':' || length(content), ',' ORDER BY message_id) AS history FROM r WHERE rn <= 3 GROUP BY 1""")
def last_n_messages(v):
    h = C.last_n_messages(v.sessions, 3)
    return h.select("session_id", F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string"))), ",").alias("history"))


_TITLE = r"""WITH f AS (SELECT session_id, arg_min(content, message_id) AS content FROM sessions WHERE role = 'user' GROUP BY 1),
t AS (SELECT session_id, trim(string_split(trim(regexp_replace(content, '\n\s*-{3,}[\s\S]*$', ''), E' \n\t'), chr(10))[1]) AS t FROM f)
SELECT session_id, CASE WHEN t = '' THEN '새 대화' WHEN length(t) <= 30 THEN t ELSE left(t, 30) || '…' END AS title FROM t"""


@query("derive_title", _TITLE)
def derive_title(v):
    return C.session_titles(v.sessions)


# every conversation text, tagged with the ids and phrases the rules look for
SQL_VIEWS["utterances"] = """SELECT conv_id, turn, text, 'EQP-' || lpad(CAST(conv_id % 40 AS VARCHAR), 3, '0') || ' ' || text || ' ERR-40' || (conv_id % 3)
 || CASE turn % 4 WHEN 0 THEN ' 최근 3일 데이터' WHEN 1 THEN ' 지난주 12시간' WHEN 2 THEN ' 2개월 수리 이력' ELSE '' END AS tagged,
 CASE (conv_id + turn) % 5 WHEN 0 THEN '안녕하세요' WHEN 1 THEN '안녕 센서 상태 알려줘' WHEN 2 THEN '고마워 정리해줘' WHEN 3 THEN '감사 아까 그거' ELSE text END AS said FROM conversations"""


def utterances(v):
    c = v.table("conversations")
    period = F.element_at(F.array(F.lit(" 최근 3일 데이터"), F.lit(" 지난주 12시간"), F.lit(" 2개월 수리 이력"), F.lit("")), (F.col("turn") % 4 + 1).cast("int"))
    said = (F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, "안녕하세요").when((F.col("conv_id") + F.col("turn")) % 5 == 1, "안녕 센서 상태 알려줘")
            .when((F.col("conv_id") + F.col("turn")) % 5 == 2, "고마워 정리해줘").when((F.col("conv_id") + F.col("turn")) % 5 == 3, "감사 아까 그거").otherwise(F.col("text")))
    tag = F.concat(F.lit("EQP-"), F.lpad((F.col("conv_id") % 40).cast("string"), 3, "0"), F.lit(" "), F.col("text"), F.lit(" ERR-40"),
                   (F.col("conv_id") % 3).cast("string"), period)
    return c.select("conv_id", "turn", "text", tag.alias("tagged"), said.alias("said"))


@query("extract_entities", r"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(tagged, 'EQP-[A-Z0-9]{3}'))), ',') AS equipment,
array_to_string(list_sort(list_distinct(regexp_extract_all(tagged, '(?:ERR|WRN)-\d{3}'))), ',') AS codes FROM utterances""")
def extract_entities(v):
    u, t = utterances(v), F.col("tagged")
    return u.select("conv_id", "turn", F.array_join(X.extract_entities(t, K.EQUIPMENT_PATTERN), ",").alias("equipment"),
                    F.array_join(X.extract_entities(t, K.ALARM_PATTERN), ",").alias("codes"))


@query("within_known_scope", "SELECT conv_id, turn, conv_id % 40 = 7 AND conv_id % 3 = 1 AS inside FROM utterances")
def within_known_scope(v):
    known = F.array(F.lit("EQP-007"), F.lit("ERR-401"))
    return utterances(v).select("conv_id", "turn", X.within_known_scope(F.col("tagged"), known).alias("inside"))


def _intent_sql(c: str) -> str:
    re2 = K.SMALLTALK_SIGNAL
    return (f"CASE WHEN trim({c}) = '' THEN 'diagnostic' WHEN regexp_matches({c}, '(?i){K.DIAGNOSTIC_SIGNAL}') THEN 'diagnostic' "
            f"WHEN regexp_matches({c}, '{K.FOLLOWUP_REFERENCE}') THEN 'diagnostic' WHEN regexp_matches({c}, '(?i){re2}') AND NOT "
            f"regexp_matches(regexp_replace({c}, '(?is)^.*?{re2}', ''), '{K.REQUEST_CLAUSE}') THEN 'direct' ELSE 'diagnostic' END")


@query("classify_intent", f"SELECT conv_id, turn, {_intent_sql('said')} AS intent FROM utterances")
def classify_intent(v):
    return utterances(v).select("conv_id", "turn", X.classify_intent(F.col("said")).alias("intent"))


@query("mentioned_days", """SELECT conv_id, turn, round(list_sum(d), 8) AS days, len(d) AS n FROM (SELECT conv_id, turn,
CASE turn % 4 WHEN 0 THEN [3.0] WHEN 1 THEN [0.5, 7.0] WHEN 2 THEN [60.0] ELSE [] END AS d FROM utterances) x""")
def mentioned_days(v):
    d = utterances(v).select("conv_id", "turn", X.mentioned_days(F.col("tagged")).alias("d"))
    total = F.when(F.size("d") > 0, F.round(F.aggregate("d", F.lit(0.0), lambda a, b: a + b), 8))
    return d.select("conv_id", "turn", total.alias("days"), F.size("d").alias("n"))


@query("within_data_window", "SELECT conv_id, turn, turn % 4 <> 1 AS inside FROM utterances")
def within_data_window(v):
    return utterances(v).select("conv_id", "turn", X.within_data_window(F.col("tagged"), F.lit(4.0)).alias("inside"))


@query("format_data_window", """SELECT equipment_id, strftime(min(raised_at), '%Y-%m-%dT%H:%M:%S') || '+00:00 ~ ' || strftime(max(raised_at), '%Y-%m-%dT%H:%M:%S') || '+00:00 (약 ' ||
CAST(round_even(date_diff('microsecond', min(raised_at), max(raised_at)) / 86400000000.0, 0) AS INT) || '일)' AS label FROM alarms GROUP BY 1""")
def format_data_window(v):
    w = v.alarms.groupBy("equipment_id").agg(F.min("raised_at").alias("a"), F.max("raised_at").alias("b"))
    return w.select("equipment_id", X.format_data_window(F.col("a"), F.col("b")).alias("label"))


_MSG = "CASE alarm_code " + " ".join(f"WHEN '{c}' THEN {sql_text(t)}" for c, t in K.ALARM_TEXTS["ko"].items()) + " ELSE alarm_code || ' 알람 발생' END"


@query("notification_message", f"SELECT alarm_id, equipment_id || ' ' || {_MSG} AS message FROM alarms")
def notification_message(v):
    return v.alarms.select("alarm_id", FA.alarm_message(F.col("equipment_id"), F.col("alarm_code")).alias("message"))


_CHECK = "CASE alarm_code " + " ".join(f"WHEN '{c}' THEN {sql_text('|'.join([*t, *K.CHECKLIST_TAIL['en']]))}" for c, t in K.CHECKLISTS["en"].items()) + f" ELSE {sql_text('|'.join(K.CHECKLIST_TAIL['en']))} END"


@query("checklist_items", f"SELECT log_id, CASE WHEN alarm_code IS NULL THEN '' ELSE {_CHECK} END AS items FROM telemetry")
def checklist_items(v):
    return v.telemetry.select("log_id", F.array_join(FA.checklist_items(F.col("alarm_code"), "en"), "|").alias("items"))


_CH = "CASE alarm_code " + " ".join(f"WHEN '{c}' THEN '{','.join(t)}'" for c, t in K.ALARM_CHANNELS.items()) + " ELSE '' END"


@query("alarm_metrics", f"SELECT alarm_id, {_CH} AS metrics FROM alarms")
def alarm_metrics(v):
    return v.alarms.select("alarm_id", F.array_join(FA.alarm_channels(F.col("alarm_code")), ",").alias("metrics"))


_BANDS = ", ".join(f"('{p}', '{c}', {b[2]!r}, {b[4]!r}, {b[3]!r})" for p in ("Deposition", K.DEFAULT_PROCESS) for c, b in K.PROFILES[p].items())


@query("metric_bands", f"""SELECT equipment_id, metric, CAST(half AS DOUBLE) AS half, CAST(usl AS DOUBLE) AS usl, CAST(lsl AS DOUBLE) AS lsl
FROM master JOIN (VALUES {_BANDS}) b(process, metric, half, usl, lsl) ON process = CASE WHEN equipment_no % 2 = 0 THEN 'Deposition' ELSE '{K.DEFAULT_PROCESS}' END""")
def metric_bands(v):
    """The bands of all four channels; an unlisted process has those of the default one."""
    process = F.when(F.col("process_type") == "P0", "Deposition").otherwise("unlisted")
    bands = v.master.select("equipment_id", R.metric_bands(process).alias("b"))
    each = F.array(*[F.struct(F.lit(c).alias("metric"), *[F.col(f"b.{c}.{f}").cast("double").alias(f) for f in ("half", "usl", "lsl")]) for c in K.CHANNELS])
    return bands.select("equipment_id", F.inline(each))


@query("scene_position", "SELECT equipment_id, CASE WHEN coalesce(position_x, position_y) IS NULL THEN NULL ELSE coalesce(position_x, 0) + 10 * coalesce(position_y, 0) END AS code FROM master")
def scene_position(v):
    pos = F.when(F.coalesce("position_x", "position_y").isNotNull(), F.struct(
        F.coalesce("position_x", F.lit(0.0)).alias("x"), F.coalesce("position_y", F.lit(0.0)).alias("y")))
    return v.master.select("equipment_id", pos.alias("p")).select("equipment_id", (F.col("p.x") + 10 * F.col("p.y")).alias("code"))


_CODES = tuple(K.ALARM_CHANNELS)
_POINT_CODE = "CASE o_orderkey % " + str(len(_CODES)) + " " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES)) + " END"
_VALUES = "{" + ", ".join(f"'{c}': t.{c}" for c in K.CHANNELS) + "}"
_WANTED = ", ".join(f"('{code}', '{m}')" for code, some in K.ALARM_CHANNELS.items() for m in (some or K.CHANNELS))
_DEV = f"""p AS (SELECT o_orderkey AS id, 'EQP-' || lpad(CAST(o_custkey % 20 AS VARCHAR), 3, '0') AS equipment_id, {_POINT_CODE} AS alarm_code,
  TIMESTAMP '2024-01-01 00:00:02.5' + to_seconds(CAST(o_orderkey * 3 AS BIGINT)) AS occurred_at FROM orders),
i AS (SELECT p.id, p.equipment_id, p.alarm_code, arg_min({_VALUES}, (abs(epoch_us(t."timestamp") - epoch_us(occurred_at)), epoch_us(t."timestamp"))) AS x
  FROM p JOIN telemetry t ON p.equipment_id = t.equipment_id AND t."timestamp" BETWEEN occurred_at - INTERVAL 5 MINUTES AND occurred_at + INTERVAL 5 MINUTES GROUP BY 1, 2, 3),
b AS (SELECT p.id, {", ".join(f"t.{c}" for c in K.CHANNELS)}, row_number() OVER (PARTITION BY p.id ORDER BY t."timestamp" DESC) AS rn FROM p JOIN telemetry t ON p.equipment_id = t.equipment_id
  AND t."timestamp" >= occurred_at - INTERVAL 30 MINUTES AND t."timestamp" < occurred_at WHERE t.alarm_code IS NULL),
m AS (SELECT id, {", ".join(f"median({c}) AS {c}" for c in K.CHANNELS)} FROM b WHERE rn <= 20 GROUP BY 1),
l AS ({" UNION ALL ".join(f"SELECT i.id, i.equipment_id, i.alarm_code, {n} AS o, '{c}' AS metric, x.{c} AS v, m.{c} AS base FROM i LEFT JOIN m ON i.id = m.id" for n, c in enumerate(K.CHANNELS))}),
d AS (SELECT l.id, l.equipment_id, l.o, l.metric, round(v, 3) + 0.0 AS incident, round(base, 3) + 0.0 AS baseline, round(v - base, 3) + 0.0 AS delta
  FROM l JOIN (VALUES {_WANTED}) w(code, metric) ON w.code = l.alarm_code AND w.metric = l.metric WHERE v IS NOT NULL)"""


def incident_points(v):
    """The incidents, whose codes take turns through all that are known."""
    from fabsight.reports.relational import points
    codes = F.array(*[F.lit(c) for c in _CODES])
    return points(v).withColumn("alarm_code", F.element_at(codes, (F.col("id") % len(_CODES) + 1).cast("int")))


def deviations(v):
    from fabsight.operators.incidents import sensor_deviation
    p = incident_points(v)
    return sensor_deviation(p, T.incident_nearest(p, v.telemetry), T.incident_baseline(p, v.telemetry, nested=True))


def _by_metric(values: dict) -> str:
    return "CASE metric " + " ".join(f"WHEN '{c}' THEN {sql_text(values[c])}" for c in K.CHANNELS) + " END"


@query("sensor_deviation", f"WITH {_DEV} SELECT id, metric, incident, baseline, delta FROM d")
def sensor_deviation(v):
    return deviations(v).select("id", "metric", "incident", "baseline", "delta")


@query("deviation_phrase", f"""WITH {_DEV} SELECT id, string_agg({_by_metric(LABELS)} || CASE WHEN delta IS NULL THEN ' 기준 비교 필요' WHEN delta > 0 THEN ' 상승' WHEN delta < 0 THEN ' 하강' ELSE ' 변화 없음' END, ' ' ORDER BY o) AS phrase
FROM d GROUP BY 1""")
def deviation_phrase(v):
    from fabsight.operators.incidents import deviation_phrase as phrase
    return phrase(deviations(v))


def _fmt(c: str) -> str:
    return rf"regexp_replace(regexp_replace(printf('%.3f', {c}), '0+$', ''), '\.$', '')"


def _plan(code: str) -> str:
    return "\n".join(f"{i}. {t}" for i, t in enumerate([*K.CHECKLISTS["ko"].get(code, []), *K.CHECKLIST_TAIL["ko"]], start=1))


_PLANS = "CASE alarm_code " + " ".join(f"WHEN '{c}' THEN {sql_text(_plan(c))}" for c in _CODES) + " END"


@query("work_log_draft_text", f"""WITH {_DEV}, t AS (SELECT id, string_agg({_by_metric(LABELS)} || CASE WHEN delta IS NULL THEN ': 발생 ' || {_fmt('incident')} || ' ' || {_by_metric(UNITS)} || ', 기준 부족'
ELSE ': 기준 ' || {_fmt('baseline')} || ' → 발생 ' || {_fmt('incident')} || ' ' || {_by_metric(UNITS)} || ' 변화 ' || CASE WHEN delta > 0 THEN '+' ELSE '' END || {_fmt('delta')} END, chr(10) ORDER BY o) AS changes FROM d GROUP BY 1)
SELECT p.id, md5('[알림 정보]' || chr(10) || '설비: ' || p.equipment_id || chr(10) || '알람: ' || alarm_code || chr(10) || '발생 시각: ' ||
strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' || chr(10) || '알림 내용: 점검' || chr(10) || chr(10) || '[이상 변화]' || chr(10) ||
coalesce(changes, '발생 시점 센서 로그 확인 필요') || chr(10) || chr(10) ||
'[판단 요약]' || chr(10) || p.equipment_id || ' ' || alarm_code || ' 대응 점검' || chr(10) || chr(10) || '[대응 계획]' || chr(10) || {_PLANS} || chr(10) || chr(10) ||
'[안전 확인]' || chr(10) || '- 작업 허가 범위와 설비 안전 상태 확인' || chr(10) || chr(10) || '[매뉴얼 근거]' || chr(10) || '검색 근거 없음') AS draft FROM p LEFT JOIN t ON p.id = t.id""")
def work_log_draft_text(v):
    from fabsight.operators.incidents import work_log_draft
    heads = incident_points(v).withColumn("message", F.lit("점검"))
    return work_log_draft(heads, deviations(v)).select("id", F.md5(F.col("draft").cast("binary")).alias("draft"))


@query("dedup_citations", """WITH r AS (SELECT conv_id, turn, left(trim(text), 240) AS excerpt, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
SELECT conv_id AS doc_id, excerpt FROM r WHERE rn = 1""")
def dedup_citations(v):
    from fabsight.operators.retrieval import dedup_citations as dedup
    return dedup(v.table("conversations").withColumnRenamed("conv_id", "doc_id"), "doc_id", "turn", "text")


@query("collect_citations", """SELECT conv_id, turn, 'MAN-ETCH-' || (conv_id % 9) || ',telemetry@2024-01-0' || (1 + turn % 5) AS cited FROM conversations""")
def collect_citations(v):
    c = v.table("conversations")
    tool = F.concat(F.lit("doc MAN-ETCH-"), (F.col("conv_id") % 9).cast("string"), F.lit(' {"timestamp": "2023-12-31"} '), F.col("text"),
                    F.lit(' {"timestamp": "2024-01-0'), (F.col("turn") % 5 + 1).cast("string"), F.lit('"}'))
    return c.select("conv_id", "turn", F.array_join(X.collect_citations(tool), ",").alias("cited"))


@query("format_value", f"SELECT log_id, {_fmt('gas_flow')} AS shown FROM telemetry")
def format_value(v):
    return v.telemetry.select("log_id", X.format_value(F.col("gas_flow")).alias("shown"))


@query("iso_time", "SELECT event_id, ts - INTERVAL 9 HOURS AS parsed, ts AS naive FROM events")
def iso_time(v):
    local = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return v.table("events").select("event_id", FD.iso_time(F.concat(local, F.lit("+09:00"))).alias("parsed"), FD.iso_time(local).alias("naive"))


@query("date_bin", "SELECT event_id, time_bucket(INTERVAL '7 minutes', ts, TIMESTAMP '2024-01-01 00:01:00') AS bucket FROM events")
def date_bin(v):
    return v.table("events").select("event_id", FD.date_bin(F.col("ts").cast("timestamp"), 420, F.lit("2024-01-01 00:01:00").cast("timestamp")).alias("bucket"))


@query("local_date", "SELECT event_id, CAST(ts + INTERVAL 9 HOURS AS DATE) AS local_date FROM events")
def local_date(v):
    return v.table("events").select("event_id", FD.local_date(F.col("ts").cast("timestamp")).alias("local_date"))


@query("truncate_observation", """SELECT conv_id, turn, CASE WHEN length(text) <= 100 THEN text ELSE left(text, 100) || chr(10) || '... (결과 과다로 ' || (length(text) - 100) || '자 생략, 조회 범위를 좁혀 재시도 권장)' END AS seen FROM conversations""")
def truncate_observation(v):
    return v.table("conversations").select("conv_id", "turn", X.truncate_observation(F.col("text"), 100).alias("seen"))


@query("expand_count_query", """SELECT conv_id, turn, turn % 2 = 0 AS expanded, CASE WHEN turn % 2 = 0 THEN 6 ELSE 3 END AS top_k FROM conversations""")
def expand_count_query(v):
    q = F.when(F.col("turn") % 2 == 0, F.concat(F.col("text"), F.lit(" 알람 코드는 몇 개"))).otherwise(F.col("text"))
    text, k = X.expand_count_query(q, F.lit(3))
    return v.table("conversations").select("conv_id", "turn", text.endswith(" 적용 알람 코드 목록").alias("expanded"), k.alias("top_k"))


@query("trace_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 AS grounded, 1 AS steps FROM events")
def trace_json_fields(v):
    k = F.get_json_object("props", "$.k").cast("long")
    trace = F.to_json(F.struct(F.array(F.lit("read")).alias("read_steps"), (k % 2 == 0).alias("grounded")))
    return v.table("events").select("event_id", X.trace_json_fields(trace).alias("t")).select("event_id", "t.grounded", F.size("t.read_steps").alias("steps"))


# ---- answers: conversations play two configurations over the same cases ---------------------------
SQL_VIEWS["answers"] = """SELECT CASE turn % 2 WHEN 0 THEN 'before' ELSE 'after' END AS config, conv_id AS id, turn // 2 AS rep, 'c' || (conv_id % 4) AS category,
 text AS answer, CASE WHEN turn % 5 = 0 THEN 'timeout' END AS error, length(text) / 100.0 AS latency, length(text) AS in_tok, length(text) // 4 AS out_tok,
 conv_id % 3 AS tool FROM conversations"""


def answers(v):
    c = v.table("conversations")
    n = F.length("text")
    arr = lambda *x: F.array(*[F.lit(i) for i in x])
    none = F.array().cast("array<string>")
    expect = F.struct(
        F.when(F.col("conv_id") % 2 == 0, arr("t0", "t1")).otherwise(none).alias("tools_called_any"),
        F.when(F.col("conv_id") % 5 == 0, arr("t1")).otherwise(none).alias("tools_called_all"),
        F.when(F.col("conv_id") % 7 == 0, arr("t2")).otherwise(none).alias("tools_forbidden"),
        F.when(F.col("conv_id") % 3 == 0, arr("the", "der")).otherwise(none).alias("answer_contains_any"),
        F.when(F.col("conv_id") % 4 == 0, arr("e", "n")).otherwise(none).alias("answer_contains_all"),
        F.when(F.col("conv_id") % 2 == 1, arr("d1")).otherwise(none).alias("citations_include"),
        F.when(F.col("conv_id") % 3 == 1, arr("que")).otherwise(none).alias("must_not_contain"),
        (F.col("conv_id") % 11 == 0).alias("no_tools"), (F.col("conv_id") % 6 == 0).alias("expect_honest_empty"))
    return c.select(
        F.when(F.col("turn") % 2 == 0, "before").otherwise("after").alias("config"), F.col("conv_id").alias("id"),
        F.floor(F.col("turn") / 2).alias("rep"), F.concat(F.lit("c"), (F.col("conv_id") % 4).cast("string")).alias("category"),
        F.col("text").alias("answer"), F.when(F.col("turn") % 5 == 0, "timeout").alias("error"), (n / 100.0).alias("latency"),
        n.alias("in_tok"), F.floor(n / 4).alias("out_tok"), F.array(F.concat(F.lit("t"), (F.col("conv_id") % 3).cast("string"))).alias("tools"),
        F.array(F.concat(F.lit("d"), (F.col("turn") % 2).cast("string"))).alias("citations"), expect.alias("expect"))


SQL_VIEWS["scored"] = """SELECT config, id, rep, category, CASE WHEN id % 11 = 0 THEN false ELSE (id % 2 <> 0 OR tool < 2) AND (id % 5 <> 0 OR tool = 1) AND (id % 7 <> 0 OR tool <> 2) END AS routing_ok,
 (id % 3 <> 0 OR contains(answer, 'the') OR contains(answer, 'der')) AND (id % 4 <> 0 OR (contains(answer, 'e') AND contains(answer, 'n'))) AS keyword_ok,
 id % 2 = 1 AS has_citation_label, id % 2 = 0 OR config = 'after' AS citation_ok, id % 3 = 1 AS has_mustnot, id % 3 = 1 AND contains(answer, 'que') AS hallucinated, id % 6 = 0 AS is_honest FROM answers"""


@query("answer_scoring", "SELECT config, id, rep, routing_ok, keyword_ok, citation_ok, hallucinated, NOT is_honest OR keyword_ok AS honest_ok FROM scored")
def answer_scoring(v):
    return C.answer_scoring(answers(v)).select("config", "id", "rep", "routing_ok", "keyword_ok", "citation_ok", "hallucinated", "honest_ok")


@query("conditional_rates", """SELECT config, category, count(*) AS n, round(avg(CAST(routing_ok AS INT)), 3) AS routing_acc, round(avg(CAST(citation_ok AS INT)) FILTER (has_citation_label), 3) AS citation_rate,
round(avg(CAST(hallucinated AS INT)) FILTER (has_mustnot), 3) AS hallucination_rate FROM scored GROUP BY GROUPING SETS ((config), (config, category))""")
def conditional_rates(v):
    return C.conditional_rates(C.answer_scoring(answers(v)), {
        "routing_acc": ("routing_ok", None), "citation_rate": ("citation_ok", "has_citation_label"), "hallucination_rate": ("hallucinated", "has_mustnot")})


@query("latency_cost_stats", """SELECT config, count(*) AS n, round(avg(latency), 8) AS mean, round(median(latency), 8) AS p50,
round(list_sort(list(latency))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1], 8) AS p95, round(avg((in_tok * 0.4 + out_tok * 1.6) / 1000000), 10) AS mean_cost FROM answers GROUP BY 1""")
def latency_cost_stats(v):
    out = C.latency_cost_stats(answers(v), 0.4, 1.6)
    return out.select("config", "n", F.round("mean", 8).alias("mean"), F.round("p50", 8).alias("p50"), F.round("p95", 8).alias("p95"), F.round("mean_cost", 10).alias("mean_cost"))


@query("pct_reduction", """SELECT round(b, 6) AS before, round(a, 6) AS after, round((b - a) / b * 100, 6) AS reduction_pct FROM (SELECT avg(latency) FILTER (config = 'before') AS b, avg(latency) FILTER (config = 'after') AS a FROM answers) x""")
def pct_reduction(v):
    out = C.pct_reduction(answers(v), "latency", "before", "after")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


SQL_VIEWS["verdicts"] = "SELECT conv_id AS id, turn, 'c' || (conv_id % 4) AS category, CASE length(text) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END AS w1, CASE (length(text) // 3) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END AS w2 FROM conversations"
SQL_VIEWS["pair_scores"] = """SELECT id, turn, category, (CASE w1 WHEN 'B' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0 END + CASE w2 WHEN 'A' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0 END) / 2 AS after_score,
 (w1 = 'tie' AND w2 = 'tie') OR (w1 = 'A' AND w2 = 'B') OR (w1 = 'B' AND w2 = 'A') AS consistent FROM verdicts"""


def pair_scores(v):
    w = lambda e: F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("tie")), (e % 3 + 1).cast("int"))
    rows = v.table("conversations").select(F.col("conv_id").alias("id"), "turn", F.concat(F.lit("c"), (F.col("conv_id") % 4).cast("string")).alias("category"),
                                           w(F.length("text")).alias("winner1"), w(F.floor(F.length("text") / 3)).alias("winner2"))
    return C.pairwise_scores(rows)


@query("pairwise_winrate", """SELECT category, count(*) AS n, round(avg(after_score), 8) AS win_rate, count(*) FILTER (after_score > 0.5) AS wins, count(*) FILTER (after_score = 0.5) AS ties,
count(*) FILTER (after_score < 0.5) AS losses, round(avg(CAST(consistent AS INT)), 8) AS consistency FROM pair_scores GROUP BY 1""")
def pairwise_winrate(v):
    out = C.pairwise_winrate(pair_scores(v), ["category"])
    return out.withColumns({c: F.round(c, 8) for c in ("win_rate", "consistency")})


@query("bootstrap_ci")
def bootstrap_ci(v):
    return C.bootstrap_ci(pair_scores(v), "after_score")


@query("rubric_means", "SELECT config, round(avg(in_tok), 2) AS accuracy, round(avg(out_tok), 2) AS grounding FROM answers GROUP BY 1")
def rubric_means(v):
    return C.rubric_means(answers(v).select("config", F.col("in_tok").alias("accuracy"), F.col("out_tok").alias("grounding")), ["accuracy", "grounding"])


_PICK = """picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config, id ORDER BY CAST(error IS NOT NULL AS INT), CAST(rep <> 0 AS INT), rep) AS rn FROM answers) x WHERE rn = 1)"""


@query("pick_answer_rep", f"WITH {_PICK} SELECT config, id, rep, error FROM picked")
def pick_answer_rep(v):
    return C.pick_answer_rep(answers(v)).select("config", "id", "rep", "error")


@query("judge_case_join", f"WITH {_PICK} SELECT b.id, length(b.answer) AS before_len, length(a.answer) AS after_len, b.category FROM picked b JOIN picked a ON a.id = b.id AND a.config = 'after' WHERE b.config = 'before'")
def judge_case_join(v):
    p = C.pick_answer_rep(answers(v))
    cases = answers(v).select("id", "category").distinct()
    out = C.judge_case_join(p.where("config = 'before'"), p.where("config = 'after'"), cases)
    return out.select("id", F.length("answer_before").alias("before_len"), F.length("answer_after").alias("after_len"), "category")


@query("judge_agreement", """WITH j AS (SELECT id, turn, CASE WHEN after_score > 0.5 THEN 'after' WHEN after_score < 0.5 THEN 'before' ELSE 'tie' END AS judge FROM pair_scores WHERE (id + turn) % 7 <> 0),
h AS (SELECT conv_id AS id, turn, 'c' || (conv_id % 4) AS category, CASE (conv_id + turn) % 4 WHEN 0 THEN 'after' WHEN 1 THEN 'before' WHEN 2 THEN 'tie' END AS pick FROM conversations)
SELECT category, count(*) AS n, round(avg(CASE pick WHEN 'after' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0 END), 8) AS win_rate, round(avg(CAST(judge = pick AS INT)), 8) AS agreement
FROM h LEFT JOIN j ON h.id = j.id AND h.turn = j.turn WHERE pick IS NOT NULL GROUP BY ROLLUP (category)""")
def judge_agreement(v):
    """People and judge on every turn; some picks are blank and some turns were not judged."""
    turn = F.col("conv_id") + F.col("turn")
    human = v.table("conversations").select(
        F.col("conv_id").alias("id"), "turn", F.concat(F.lit("c"), (F.col("conv_id") % 4).cast("string")).alias("category"),
        F.element_at(F.array(F.lit("after"), F.lit("before"), F.lit("tie"), F.lit(None)), (turn % 4 + 1).cast("int")).alias("pick"))
    out = C.judge_agreement(human, pair_scores(v).where((F.col("id") + F.col("turn")) % 7 != 0), ["id", "turn"])
    return out.withColumns({c: F.round(c, 8) for c in ("win_rate", "agreement")})


@query("classification_confusion", """SELECT l.quality AS label, CAST(d.n_chars > 1000 AS INT) AS predicted, count(*) AS n, l.quality = CAST(d.n_chars > 1000 AS INT) AS correct
FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1, 2, 4""")
def classification_confusion(v):
    rows = v.table("labels").join(v.table("documents").select("doc_id", "n_chars"), "doc_id").select(
        F.col("quality").alias("label"), (F.col("n_chars") > 1000).cast("long").alias("predicted"))
    return C.classification_confusion(rows.withColumn("label", F.col("label").cast("long")), "label", "predicted")


@query("stratified_round_robin", """SELECT id, category, turn FROM (SELECT doc_id AS id, lang AS category,
row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id), doc_id) AS turn FROM documents) x WHERE turn <= 40 ORDER BY turn, category LIMIT 40""")
def stratified_round_robin(v):
    cases = v.table("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"))
    return C.stratified_round_robin(cases, 40).select("id", "category", "turn")


@query("silhouette", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT label, count(*) AS n FROM e GROUP BY 1),
s AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS s FROM e a CROSS JOIN e b GROUP BY 1, 2, 3),
p AS (SELECT vec_id, max(CASE WHEN s.label = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN s.label <> other THEN s / n END) AS b FROM s JOIN n ON n.label = s.other GROUP BY 1)
SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM p""")
def silhouette(v):
    return NB.silhouette(v.table("embeddings"), "label").withColumn("silhouette", F.round("silhouette", 6))


@query("squared_silhouette", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT label, count(*) AS n FROM e GROUP BY 1),
s AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.v, b.v) ** 2) AS s FROM e a CROSS JOIN e b GROUP BY 1, 2, 3),
p AS (SELECT vec_id, max(CASE WHEN s.label = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN s.label <> other THEN s / n END) AS b FROM s JOIN n ON n.label = s.other GROUP BY 1)
SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM p""")
def squared_silhouette(v):
    return NB.squared_silhouette(v.table("embeddings"), "label").withColumn("silhouette", F.round("silhouette", 6))


@query("knn_outlier_score", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.vec_id, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v)) AS rn FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT vec_id, round(avg(d), 6) AS score FROM d WHERE rn <= 5 GROUP BY 1""")
def knn_outlier_score(v):
    e = v.table("embeddings")
    return NB.knn_outlier_score(e, e, 5, exclude_self=True).withColumn("score", F.round("score", 6))


@query("centroid_cosine_score", """WITH c AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label < 5) a GROUP BY 1) b)
SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), c.c), 8) AS score FROM embeddings, c""")
def centroid_cosine_score(v):
    e = v.table("embeddings")
    return NB.centroid_cosine_score(e, e.where("label < 5")).withColumn("score", F.round("score", 8))
