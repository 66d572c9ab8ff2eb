"""Sliding windows, features and score post-processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabsight import constants as K
from fabsight.operators import rules as R, scoring as S, telemetry as T, windows as Wn
from fabsight.plans.series import ewma, neighbours
from fabsight.registry import query
from fabsight.views import SQL_VIEWS, TEST_PROFILES

SQL_VIEWS["win_rows"] = """
SELECT t.*, k AS win, CAST(tick - k * 6 AS DOUBLE) AS off FROM (SELECT *, unnest(range(CAST(greatest(0, ceil((tick - 11) / 6.0)) AS BIGINT), tick // 6 + 1)) AS k,
""" + ", ".join(f"{c} - lag({c}) OVER (PARTITION BY equipment_id ORDER BY tick) AS d_{c}" for c in K.CHANNELS) + " FROM telemetry) t"
SQL_VIEWS["win_feats"] = "SELECT equipment_id, process_type, win, " + ", ".join(
    f"avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}, regr_slope({c}, off) AS slope_{c}, "
    f"stddev_pop(CASE WHEN off > 0 THEN d_{c} END) AS dstd_{c}" for c in K.CHANNELS) + ", " + ", ".join(
    f"covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b}) + 1e-12) AS corr_{a}__{b}" for a, b in Wn.PAIRS) + \
    " FROM win_rows GROUP BY ALL HAVING count(*) = 12"
# a plain per-window score that SQL can compute: mean gas flow relative to a fixed level
SQL_VIEWS["win_score"] = "SELECT equipment_id, process_type, win, mean_gas_flow / 0.04 AS raw FROM win_feats"


def features(v):
    return Wn.window_features(v.telemetry)


def win_score(v):
    t = v.telemetry.select("equipment_id", "process_type", "gas_flow", F.explode(Wn.window_numbers(F.col("tick"), 12, 6)).alias("win"))
    per = t.groupBy("equipment_id", "process_type", "win").agg(F.avg("gas_flow").alias("m"), F.count(F.lit(1)).alias("n")).where("n = 12")
    return per.select("equipment_id", "process_type", "win", (F.col("m") / 0.04).alias("raw"))


@query("sliding_windows", "SELECT equipment_id, win, CAST(off AS BIGINT) AS off, tick FROM win_rows WHERE (equipment_id, win) IN (SELECT equipment_id, win FROM win_feats)")
def sliding_windows(v):
    return Wn.sliding_windows(v.telemetry).select("equipment_id", "win", "off", "tick")


_R = {c: 4 if c.endswith("pressure") and not c.startswith("corr") else 6 for c in Wn.ALL_FEATURES}


@query("window_features", "SELECT equipment_id, win, " + ", ".join(f"round({c}, {_R[c]}) AS {c}" for c in Wn.ALL_FEATURES) + " FROM win_feats")
def window_features(v):
    return features(v).select("equipment_id", "win", *[F.round(c, _R[c]).alias(c) for c in Wn.ALL_FEATURES])


@query("window_overlaps_event", """SELECT e.event_id, count(*) AS windows FROM incidents e JOIN win_score w
ON e.equipment_id = w.equipment_id AND w.win * 6 <= e.end_tick AND w.win * 6 + 11 >= e.start_tick GROUP BY 1""")
def window_overlaps_event(v):
    first = F.greatest(F.lit(0), F.ceil((F.col("start_tick") - 11) / 6)).cast("long")
    spans = v.incidents.withColumn("win", F.explode(F.sequence(first, F.floor(F.col("end_tick") / 6).cast("long"))))
    hit = spans.join(win_score(v).select("equipment_id", "win"), ["equipment_id", "win"])
    return hit.where(Wn.window_overlaps_event(F.col("win"), 12, 6, F.col("start_tick"), F.col("end_tick"))).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("windows"))


@query("diff_lag", "SELECT log_id, " + ", ".join(f"{c} - lag({c}) OVER (PARTITION BY equipment_id ORDER BY tick) AS diff_{c}" for c in K.CHANNELS) + " FROM telemetry")
def diff_lag(v):
    return Wn.diffs(v.telemetry, ["equipment_id"], "tick").select("log_id", *[f"diff_{c}" for c in K.CHANNELS])


@query("sustained_k", """SELECT equipment_id, win, sum(CAST(raw > 1.01 AS INT)) OVER (PARTITION BY equipment_id ORDER BY win ROWS 1 PRECEDING) = 2 AS confirmed FROM win_score""")
def sustained_k(v):
    return S.sustained_k(win_score(v).withColumn("over", F.col("raw") > 1.01), "over").select("equipment_id", "win", "confirmed")


@query("transition_mask", """SELECT equipment_id, win, max(CAST(raw >= 1.5 AS INT)) OVER (PARTITION BY equipment_id ORDER BY win ROWS 3 PRECEDING) = 1 AS masked FROM win_score""")
def transition_mask(v):
    return S.transition_mask(win_score(v), "raw", 1.5, 3).select("equipment_id", "win", "masked")


_EWMA_SQL = """WITH RECURSIVE s AS MATERIALIZED (SELECT equipment_id, win, raw FROM win_score),
r AS (SELECT equipment_id, win, raw AS y FROM s WHERE win = 0
 UNION ALL SELECT s.equipment_id, s.win, 0.1 * s.raw + 0.9 * r.y FROM r JOIN s ON s.equipment_id = r.equipment_id AND s.win = r.win + 1)
SELECT equipment_id, win, round(y, 8) AS ewma FROM r"""


@query("ewma", _EWMA_SQL)
def ewma_query(v):
    return ewma(win_score(v), ["equipment_id"], "win", "raw", 0.1).select("equipment_id", "win", F.round("ewma", 8).alias("ewma"))


_MASKED = """WITH RECURSIVE m AS MATERIALIZED (SELECT equipment_id, win, raw,
  max(CAST(raw >= 1.5 AS INT)) OVER (PARTITION BY equipment_id ORDER BY win ROWS 3 PRECEDING) = 1 AS masked FROM win_score),
f AS MATERIALIZED (SELECT equipment_id, arg_min(raw, win) AS seed FROM m WHERE NOT masked GROUP BY 1),
r AS (SELECT m.equipment_id, m.win, coalesce(seed, 0.0) AS y, masked FROM m LEFT JOIN f ON m.equipment_id = f.equipment_id WHERE m.win = 0
 UNION ALL SELECT m.equipment_id, m.win, CASE WHEN m.masked THEN r.y ELSE 0.1 * least(m.raw, {clip}) + 0.9 * r.y END, m.masked
 FROM r JOIN m ON m.equipment_id = r.equipment_id AND m.win = r.win + 1)
SELECT equipment_id, win, round(y / {limit}, 8) AS {name} FROM r"""


@query("ewma_masked", _MASKED.format(clip="1e9", limit="1.0", name="ewma"))
def ewma_masked(v):
    m = S.transition_mask(win_score(v), "raw", 1.5, 3)
    return ewma(m, ["equipment_id"], "win", "raw", 0.1, mask="masked").select("equipment_id", "win", F.round("ewma", 8).alias("ewma"))


@query("accumulate_normalize", _MASKED.replace("coalesce(seed, 0.0)", "least(coalesce(seed, 0.0), 1.2)").format(clip="1.2", limit="1.25", name="score"))
def accumulate_normalize(v):
    m = S.transition_mask(win_score(v), "raw", 1.5, 3)
    return S.accumulate_normalize(m, "raw", F.lit(1.25), clip=1.2).select("equipment_id", "win", F.round("score", 8).alias("score"))


@query("steady_scores", "SELECT equipment_id, win FROM (SELECT *, count(*) OVER (PARTITION BY equipment_id) AS n FROM win_score) x WHERE win >= 50 OR n - 50 < 100")
def steady_scores(v):
    return S.steady_scores(win_score(v)).select("equipment_id", "win")


@query("recent_rows_per_equipment", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY tick DESC) AS rn FROM telemetry),
t AS (SELECT equipment_id, log_id, tick FROM r WHERE rn <= 300 AND gas_flow > 0)
SELECT equipment_id, log_id, row_number() OVER (PARTITION BY equipment_id ORDER BY tick) - 1 AS tick FROM t""")
def recent_rows(v):
    holes = v.telemetry.withColumn("gas_flow", F.when(F.col("gas_flow") > 0, F.col("gas_flow")))
    return T.recent_rows(holes, ["equipment_id"], "tick", K.LOOKBACK_ROWS).select("equipment_id", "log_id", "tick")


def _var_sql():
    d = ", ".join(f"{c} - lag({c}) OVER (PARTITION BY equipment_id ORDER BY tick) AS d_{c}" for c in K.CHANNELS)
    w = "OVER (PARTITION BY equipment_id ORDER BY tick ROWS 7 PRECEDING)"
    flags = ", ".join(
        f"coalesce(count(d_{c}) {w} >= 4 AND stddev_pop(d_{c}) {w} > {K.VARIANCE_FACTOR * TEST_PROFILES['P0'][c][1]!r}::DOUBLE, false) AS var_{c}" for c in K.CHANNELS)
    return f"WITH d AS (SELECT equipment_id, log_id, tick, {d} FROM telemetry) SELECT log_id, {flags} FROM d"


@query("variance_rule", _var_sql())
def variance_rule(v):
    out = R.variance_flags(v.telemetry, TEST_PROFILES, "P0")
    return out.select("log_id", *[F.coalesce(f"var_{c}", F.lit(False)).alias(f"var_{c}") for c in K.CHANNELS])


@query("rule_judge", """SELECT log_id, alarm_temperature, alarm_pressure, alarm_rf_power, alarm_gas_flow, alarm_code FROM (
WITH v AS (""" + _var_sql() + """)
SELECT log_id, CASE WHEN cooling THEN 'ERR-402' ELSE coalesce(c_temperature, CASE WHEN var_temperature THEN 'WRN-801' END) END AS alarm_temperature,
 CASE WHEN NOT cooling THEN coalesce(c_pressure, CASE WHEN var_pressure THEN 'WRN-801' END) END AS alarm_pressure,
 coalesce(c_rf_power, CASE WHEN var_rf_power THEN 'WRN-801' END) AS alarm_rf_power, coalesce(c_gas_flow, CASE WHEN var_gas_flow THEN 'WRN-801' END) AS alarm_gas_flow,
 coalesce(j.first_code, CASE WHEN var_temperature OR var_pressure OR var_rf_power OR var_gas_flow THEN 'WRN-801' END) AS alarm_code
FROM (SELECT b.*, t.alarm_code AS first_code FROM judged b JOIN telemetry t USING (log_id)) j JOIN v USING (log_id)) z""")
def rule_judge(v):
    base = v.telemetry.drop("alarm_code", *[f"alarm_{c}" for c in K.CHANNELS])
    return R.rule_judge(base, TEST_PROFILES, "P0").select("log_id", *[f"alarm_{c}" for c in K.CHANNELS], "alarm_code")


@query("cooling_fault", "SELECT log_id, alarm_temperature, alarm_pressure FROM telemetry WHERE alarm_code = 'ERR-402'")
def cooling_fault(v):
    return v.telemetry.where(F.col("alarm_code") == "ERR-402").select("log_id", "alarm_temperature", "alarm_pressure")


@query("rule_detections", "SELECT equipment_id, tick FROM detections")
def rule_detections(v):
    return v.detections


@query("representative_alarm", """SELECT log_id, CASE WHEN alarm_temperature = 'ERR-402' THEN 'ERR-402' WHEN alarm_temperature = 'ERR-401' THEN 'ERR-401'
 WHEN alarm_pressure = 'ERR-301' THEN 'ERR-301' WHEN alarm_rf_power = 'ERR-201' THEN 'ERR-201' WHEN alarm_gas_flow = 'WRN-501' THEN 'WRN-501'
 ELSE coalesce(alarm_temperature, alarm_pressure, alarm_rf_power, alarm_gas_flow) END AS code FROM telemetry""")
def representative_alarm(v):
    from fabsight.functions.alarms import best_code
    return v.telemetry.select("log_id", best_code([F.col(f"alarm_{c}") for c in K.CHANNELS]).alias("code"))


SQL_VIEWS["stepped"] = "SELECT equipment_id, log_id, tick, temperature, CASE (tick // 50) % 3 WHEN 0 THEN 'heat' WHEN 1 THEN 'etch' ELSE 'cool' END AS step FROM telemetry"
SQL_VIEWS["win_steps"] = """SELECT equipment_id, win, CASE WHEN min(step) = max(step) THEN min(step) ELSE 'transition' END AS step
FROM (SELECT equipment_id, step, unnest(range(CAST(greatest(0, ceil((tick - 11) / 6.0)) AS BIGINT), tick // 6 + 1)) AS win FROM stepped) x GROUP BY 1, 2 HAVING count(*) = 12"""
SQL_VIEWS["win_runs"] = """SELECT equipment_id, win, step, sum(c) OVER (PARTITION BY equipment_id ORDER BY win) - 1 AS run FROM (
SELECT *, CAST(step IS DISTINCT FROM lag(step) OVER (PARTITION BY equipment_id ORDER BY win) AS INT) AS c FROM win_steps) x"""


def stepped(v):
    step = F.element_at(F.array(F.lit("heat"), F.lit("etch"), F.lit("cool")), (F.floor(F.col("tick") / 50) % 3 + 1).cast("int"))
    return v.telemetry.withColumn("step", step)


def win_runs(v):
    return Wn.step_runs(Wn.window_step_label(stepped(v)))


@query("window_step_label", "SELECT equipment_id, win, step FROM win_steps")
def window_step_label(v):
    return Wn.window_step_label(stepped(v))


@query("step_runs", "SELECT equipment_id, win, step, CAST(run AS BIGINT) AS run FROM win_runs")
def step_runs(v):
    return win_runs(v).select("equipment_id", "win", "step", "run")


@query("step_run_ewma", """WITH RECURSIVE s AS MATERIALIZED (SELECT r.equipment_id, r.win, run, raw, r.win - min(r.win) OVER (PARTITION BY r.equipment_id, run) AS p
 FROM win_runs r JOIN win_score w ON r.equipment_id = w.equipment_id AND r.win = w.win),
r AS (SELECT equipment_id, win, run, p, raw AS y FROM s WHERE p = 0
 UNION ALL SELECT s.equipment_id, s.win, s.run, s.p, 0.1 * s.raw + 0.9 * r.y FROM r JOIN s ON s.equipment_id = r.equipment_id AND s.run = r.run AND s.p = r.p + 1)
SELECT equipment_id, win, round(y, 8) AS ewma, p >= 3 AS judged FROM r""")
def step_run_ewma(v):
    rows = Wn.position_in_run(win_runs(v).join(win_score(v).select("equipment_id", "win", "raw"), ["equipment_id", "win"]))
    return S.step_run_ewma(rows, "raw").select("equipment_id", "win", F.round("ewma", 8).alias("ewma"), "judged")


@query("sample_per_group", """SELECT equipment_id, log_id FROM (SELECT equipment_id, log_id,
row_number() OVER (PARTITION BY equipment_id ORDER BY md5('0:' || log_id), log_id) AS rn FROM telemetry) x WHERE rn <= 100""")
def sample_per_group(v):
    return Wn.sample_per_group(v.telemetry, ["equipment_id"], "log_id", 100).select("equipment_id", "log_id")


@query("limit_quantile", "SELECT process_type, round(quantile_cont(raw, 0.999), 8) AS \"limit\" FROM win_score GROUP BY 1")
def limit_quantile(v):
    return S.limit_quantile(win_score(v), ["process_type"], "raw").withColumn("limit", F.round("limit", 8))
