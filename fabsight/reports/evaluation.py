"""Detection evaluation and operating-point reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fabsight import constants as K
from fabsight.operators import detectors as D, evaluate as E
from fabsight.plans.series import exact_quantiles
from fabsight.registry import query
from fabsight.reports import models as G
from fabsight.reports.detection import windows
from fabsight.reports.series import win_score
from fabsight.session import durable
from fabsight.views import SQL_VIEWS

GRACE = {"acute": 3, "_default": 12}
SQL_VIEWS["matched"] = """SELECT e.event_id, e.equipment_id, e.kind, e.start_tick, e.end_tick, min(d.tick) AS first_tick,
 min(d.tick) IS NOT NULL AS detected, min(d.tick) - e.start_tick AS delay
FROM incidents e LEFT JOIN detections d ON e.equipment_id = d.equipment_id
 AND d.tick BETWEEN e.start_tick AND least(e.end_tick, e.start_tick + CASE WHEN kind = 'acute' THEN 3 ELSE 12 END)
GROUP BY 1, 2, 3, 4, 5"""
SQL_VIEWS["outside"] = """SELECT equipment_id, tick FROM detections d WHERE NOT EXISTS
(SELECT 1 FROM incidents e WHERE e.equipment_id = d.equipment_id AND d.tick BETWEEN e.start_tick AND e.end_tick)"""
SQL_VIEWS["labelled"] = """SELECT t.equipment_id, t.tick, CAST(EXISTS (SELECT 1 FROM incidents e WHERE e.equipment_id = t.equipment_id
AND t.tick BETWEEN e.start_tick AND e.end_tick) AS BIGINT) AS label, CAST(t.alarm_code IS NOT NULL AS DOUBLE) AS score FROM telemetry t"""
SQL_VIEWS["days"] = "SELECT sum(n) * 5 / 86400.0 AS d FROM (SELECT count(*) AS n FROM telemetry)"


def matched(v):
    return E.events_detections_range(v.incidents, v.detections, GRACE)


def n_ticks(v):
    return E.equipment_n_ticks(v.telemetry)


@query("events_detections_range", "SELECT event_id, first_tick, detected, delay FROM matched")
def events_detections_range(v):
    return matched(v).select("event_id", "first_tick", "detected", "delay")


@query("detections_outside_events", "SELECT equipment_id, tick FROM outside")
def detections_outside_events(v):
    return E.detections_outside_events(v.incidents, v.detections)


@query("point_labels", "SELECT equipment_id, tick, label FROM labelled")
def point_labels(v):
    return E.point_labels(v.telemetry.select("equipment_id", "tick"), v.incidents)


@query("rule_point_scores", "SELECT equipment_id, tick, label, score FROM labelled")
def rule_point_scores(v):
    scored = v.telemetry.select("equipment_id", "tick", F.col("alarm_code").isNotNull().cast("double").alias("score"))
    return E.point_labels(scored, v.incidents)


@query("equipment_n_ticks", "SELECT equipment_id, count(*) AS n_ticks FROM telemetry GROUP BY 1")
def equipment_n_ticks(v):
    return n_ticks(v)


@query("event_recall", "SELECT count(*) AS events_total, count(*) FILTER (detected) AS events_detected, round(avg(CAST(detected AS INT)), 8) AS event_recall FROM matched")
def event_recall(v):
    return E.event_recall(matched(v)).withColumn("event_recall", F.round("event_recall", 8))


@query("recall_by_kind", """SELECT kind, count(*) AS events_total, round(avg(CAST(detected AS INT)), 8) AS recall, round(avg(delay), 6) AS delay_mean FROM matched GROUP BY ROLLUP (kind)""")
def recall_by_kind(v):
    return E.recall_by_kind(matched(v)).withColumns({"recall": F.round("recall", 8), "delay_mean": F.round("delay_mean", 6)})


@query("delay_stats", "SELECT round(avg(delay), 6) AS delay_mean, quantile_cont(delay, 0.9) AS delay_p90 FROM matched")
def delay_stats(v):
    return E.delay_stats(matched(v)).withColumn("delay_mean", F.round("delay_mean", 6))


@query("bucket_dedup", "SELECT equipment_id, min(tick) AS tick FROM detections GROUP BY equipment_id, tick // 360")
def bucket_dedup(v):
    return E.bucket_dedup(v.detections, 360)


@query("false_alarms", "SELECT count(*) AS false_alarms, round(count(*) / (SELECT d FROM days), 6) AS per_equipment_day FROM outside")
def false_alarms(v):
    return E.false_alarms(v.incidents, v.detections, n_ticks(v)).withColumn("per_equipment_day", F.round("per_equipment_day", 6))


@query("false_alarms_dedup", """SELECT count(*) AS false_alarms, round(count(*) / (SELECT d FROM days), 6) AS per_equipment_day
FROM (SELECT DISTINCT equipment_id, tick // 360 FROM outside) x""")
def false_alarms_dedup(v):
    return E.false_alarms(v.incidents, v.detections, n_ticks(v), dedup_seconds=1800).withColumn("per_equipment_day", F.round("per_equipment_day", 6))


@query("detection_summary", """SELECT count(*) AS events_total, count(*) FILTER (detected) AS events_detected, round(avg(CAST(detected AS INT)), 8) AS event_recall,
 round(avg(delay), 6) AS detection_delay_mean_ticks, quantile_cont(delay, 0.9) AS detection_delay_p90_ticks,
 (SELECT count(*) FROM outside) AS false_alarms_total, round((SELECT count(*) FROM outside) / (SELECT d FROM days), 6) AS false_alarms_per_equipment_day,
 (SELECT count(*) FROM (SELECT DISTINCT equipment_id, tick // 360 FROM outside)) AS false_alarms_dedup_total,
 round((SELECT count(*) FROM (SELECT DISTINCT equipment_id, tick // 360 FROM outside)) / (SELECT d FROM days), 6) AS false_alarms_per_equipment_day_dedup,
 round(avg(CAST(detected AS INT)) FILTER (kind = 'acute'), 8) AS recall_acute, round(avg(delay) FILTER (kind = 'acute'), 6) AS delay_mean_acute_ticks,
 round(avg(CAST(detected AS INT)) FILTER (kind = 'drift'), 8) AS recall_drift, round(avg(delay) FILTER (kind = 'drift'), 6) AS delay_mean_drift_ticks FROM matched""")
def detection_summary(v):
    out = E.detection_summary(v.incidents, v.detections, n_ticks(v), GRACE, kinds=("acute", "drift"))
    places = {c: 8 if c.startswith("recall") or c == "event_recall" else 6 for c, t in out.dtypes if t == "double"}
    return out.withColumns({c: F.round(c, p) for c, p in places.items()})


_AP = """WITH s AS (SELECT score, count(*) AS n, sum(label) AS p FROM {src} GROUP BY 1),
c AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER (ORDER BY score DESC) AS cp FROM s)
SELECT round(sum(p * (cp / cn)) / sum(p), 8) AS average_precision FROM c"""


@query("average_precision", _AP.format(src="""(SELECT l.label, round(t.pressure / 1000, 3) AS score FROM labelled l JOIN telemetry t
ON l.equipment_id = t.equipment_id AND l.tick = t.tick)"""))
def average_precision(v):
    scored = E.point_labels(v.telemetry.select("equipment_id", "tick", F.round(F.col("pressure") / 1000, 3).alias("score")), v.incidents)
    return E.average_precision(scored).withColumn("average_precision", F.round("average_precision", 8))


@query("latest_window_score_asof", """SELECT t.equipment_id, t.tick, round(w.raw, 8) AS score FROM telemetry t
JOIN (SELECT equipment_id, max(win) AS m FROM win_score GROUP BY 1) x ON t.equipment_id = x.equipment_id
JOIN win_score w ON t.equipment_id = w.equipment_id AND w.win = least(greatest((t.tick - 11) // 6, 0), x.m)""")
def latest_window_score(v):
    scores = win_score(v).withColumnRenamed("raw", "score")
    return E.latest_window_score(v.telemetry.select("equipment_id", "tick"), scores).withColumn("score", F.round("score", 8))


QUANTILES = (0.5, 0.7, 0.8, 0.9, 0.95, 0.97, 0.98, 0.99, 0.995, 0.999)
#: False alarms that an operating point may have.
BUDGET = 60


def detector_scores(v):
    """Scores of four detectors over all readings: the rule by tick, given models by the last tick of a window."""
    w = windows(v)
    at = (F.col("win") * K.STRIDE + K.WINDOW - 1).alias("tick")
    scored = {"pca": D.pca_score(w, G.pca_states()), "var": D.var_score(w, G.var_states()), "iforest": D.forest_score(w, G.forest_model())}
    rule = v.telemetry.select("equipment_id", "process_type", "tick", F.col("alarm_code").isNotNull().cast("double").alias("score"))
    return {"rule": rule} | {n: d.select("equipment_id", "process_type", at, F.col("raw").alias("score")) for n, d in scored.items()}


def sweep(v):
    """Operating points of each detector: limits per process type at ten quantiles of its scores."""
    def build():
        scored = detector_scores(v)
        stored = durable(reduce(DataFrame.unionByName, [d.withColumn("place", F.lit(i)) for i, d in enumerate(scored.values())]))
        names = [f"q{n}" for n in range(len(QUANTILES))]
        limits = durable(exact_quantiles(stored, ["place", "process_type"], "score", dict(zip(names, QUANTILES))).select("place", "process_type", F.array(*names).alias("limits")))
        swept = E.threshold_sweep(v.incidents, stored, limits, len(QUANTILES), groups=["place"])
        return swept.select(
            F.array(*[F.lit(n) for n in scored])[F.col("place")].alias("detector"), F.array(*[F.lit(q) for q in QUANTILES])[F.col("point")].alias("q"),
            (F.col("point") + F.col("place") * len(QUANTILES)).alias("point"),
            F.round("recall", 8).alias("recall"), "delay_p90", F.round("delay_mean", 6).alias("delay_mean"), "false_alarms_dedup")
    return v.stored("sweep", build)


SQL_VIEWS["detector_scores"] = """SELECT 'rule' AS detector, 0 AS place, equipment_id, process_type, tick, CAST(alarm_code IS NOT NULL AS DOUBLE) AS score FROM telemetry
UNION ALL SELECT 'pca', 1, equipment_id, process_type, win * 6 + 11, greatest(t2, spe) FROM given_pca
UNION ALL SELECT 'var', 2, equipment_id, process_type, win * 6 + 11, raw FROM given_var
UNION ALL SELECT 'iforest', 3, equipment_id, process_type, win * 6 + 11, raw FROM given_forest"""
SQL_VIEWS["sweep_limits"] = f"""SELECT detector, place, process_type, unnest({list(QUANTILES)!r}) AS q, unnest(range({len(QUANTILES)})) AS i, unnest(l) AS lim FROM (
SELECT detector, place, process_type, quantile_cont(score, {list(QUANTILES)!r}) AS l FROM detector_scores GROUP BY ALL) x"""
SQL_VIEWS["sweep_fired"] = "SELECT detector, q, equipment_id, tick FROM detector_scores JOIN sweep_limits USING (detector, process_type) WHERE score > lim + 1e-9"
SQL_VIEWS["swept"] = """SELECT h.*, coalesce(f.n, 0) AS false_alarms_dedup FROM (
SELECT detector, q, any_value(point) AS point, round(avg(CAST(det AS INT)), 8) AS recall, quantile_cont(delay, 0.9) AS delay_p90, round(avg(delay), 6) AS delay_mean FROM (
 SELECT p.detector, p.q, any_value(p.point) AS point, e.event_id, min(f.tick) IS NOT NULL AS det, min(f.tick) - any_value(e.start_tick) AS delay
 FROM incidents e CROSS JOIN (SELECT DISTINCT detector, q, place * 10 + i AS point FROM sweep_limits) p
 LEFT JOIN sweep_fired f ON f.detector = p.detector AND f.q = p.q AND f.equipment_id = e.equipment_id AND f.tick BETWEEN e.start_tick AND e.end_tick GROUP BY p.detector, p.q, e.event_id) x
GROUP BY detector, q) h LEFT JOIN (SELECT detector, q, count(DISTINCT (equipment_id, tick // 360)) AS n FROM sweep_fired s WHERE NOT EXISTS
 (SELECT 1 FROM incidents e WHERE e.equipment_id = s.equipment_id AND s.tick BETWEEN e.start_tick AND e.end_tick) GROUP BY 1, 2) f ON f.detector = h.detector AND f.q = h.q"""
_POINT = f"""SELECT *, row_number() OVER (PARTITION BY detector ORDER BY CASE WHEN false_alarms_dedup <= {BUDGET} THEN 0 ELSE 1 END,
CASE WHEN false_alarms_dedup <= {BUDGET} THEN 0 ELSE false_alarms_dedup END, round(recall, 6) DESC, delay_p90 NULLS LAST, point) AS rn FROM swept"""


@query("threshold_sweep", "SELECT detector, q, recall, delay_p90, delay_mean, false_alarms_dedup FROM swept")
def threshold_sweep(v):
    return sweep(v).drop("point")


@query("best_by_multi_criteria", f"SELECT detector, q, recall, delay_p90, false_alarms_dedup FROM ({_POINT}) x WHERE rn = 1")
def best_by_multi_criteria(v):
    return E.operating_point(sweep(v), BUDGET, ["detector"]).select("detector", "q", "recall", "delay_p90", "false_alarms_dedup")


@query("grid_best", """SELECT detector, q, recall, false_alarms_dedup FROM swept
ORDER BY CASE WHEN recall >= 1 THEN 0 ELSE 1 END, false_alarms_dedup, delay_p90 NULLS LAST, delay_mean NULLS LAST, point LIMIT 1""")
def grid_best(v):
    return E.grid_best(sweep(v), keys=("false_alarms_dedup", "delay_p90", "delay_mean")).select("detector", "q", "recall", "false_alarms_dedup")


@query("sweep_best_realtime", "SELECT detector, q, delay_mean, false_alarms_dedup FROM swept ORDER BY delay_mean NULLS LAST, false_alarms_dedup, point LIMIT 1")
def sweep_best_realtime(v):
    return E.sweep_best_realtime(sweep(v), "delay_mean", "false_alarms_dedup").select("detector", "q", "delay_mean", "false_alarms_dedup")


@query("detector_ranking", f"""SELECT detector, q, recall, delay_p90, row_number() OVER (ORDER BY recall DESC NULLS LAST, delay_p90 NULLS LAST, detector) AS place
FROM ({_POINT}) x WHERE rn = 1""")
def detector_ranking(v):
    """Rule, components, autoregression and forest, each at its own operating point."""
    points = E.operating_point(sweep(v), BUDGET, ["detector"])
    return E.detector_ranking(points).select("detector", "q", "recall", "delay_p90", "place")


SQL_VIEWS["shadow"] = "SELECT * FROM alarms WHERE alarm_id % 5 < 2"
SQL_VIEWS["ruled"] = "SELECT * FROM alarms WHERE alarm_id % 5 >= 2"
NOW = "2024-02-01 00:00:00"
_OV = f"""EXISTS (SELECT 1 FROM {{b}} y WHERE y.equipment_id = x.equipment_id AND x.raised_at <= coalesce(y.cleared_at, TIMESTAMP '{NOW}')
AND y.raised_at <= coalesce(x.cleared_at, TIMESTAMP '{NOW}'))"""


def shadow(v):
    """Every alarm is of one of two detectors: two in five are the shadow detector's, the others the rule's."""
    return v.alarms.where("alarm_id % 5 < 2")


def ruled(v):
    return v.alarms.where("alarm_id % 5 >= 2")


def now():
    return F.lit(NOW).cast("timestamp")


@query("interval_overlap", f"SELECT alarm_id FROM shadow x WHERE {_OV.format(b='ruled')}")
def interval_overlap(v):
    return E.interval_overlap(shadow(v), ruled(v), now(), "left_semi").select("alarm_id")


@query("shadow_vs_rule", f"""SELECT count(*) AS shadow_events, count(*) FILTER (NOT {_OV.format(b='ruled')}) AS detector_only,
count(*) FILTER ({_OV.format(b='ruled')}) AS overlapping, (SELECT count(*) FROM ruled x WHERE NOT {_OV.format(b='shadow')}) AS rule_only FROM shadow x""")
def shadow_vs_rule(v):
    return E.shadow_vs_rule(shadow(v), ruled(v), now())


@query("shadow_report", f"""WITH s AS (SELECT * FROM shadow WHERE raised_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS),
r AS (SELECT * FROM ruled WHERE raised_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS)
SELECT count(*) AS shadow_events, count(*) FILTER (NOT {_OV.format(b='r')}) AS detector_only,
count(*) FILTER ({_OV.format(b='r')}) AS overlapping, (SELECT count(*) FROM r x WHERE NOT {_OV.format(b='s')}) AS rule_only FROM s x""")
def shadow_report(v):
    return E.shadow_report(shadow(v), ruled(v), now(), 7)


@query("fire_rate", "SELECT equipment_id, round(avg(CAST(raw > 1.21 AS INT)), 8) AS fire_rate, round(max(raw), 8) AS peak_ratio FROM win_score GROUP BY 1")
def fire_rate(v):
    out = E.fire_rate(win_score(v), F.col("raw") > 1.21, F.col("raw"), ["equipment_id"])
    return out.withColumns({"fire_rate": F.round("fire_rate", 8), "peak_ratio": F.round("peak_ratio", 8)})


@query("separation_ratio", """SELECT round(median(pressure) FILTER (label = 1) / median(pressure) FILTER (label = 0), 8) AS separation_ratio
FROM telemetry t JOIN labelled l ON t.equipment_id = l.equipment_id AND t.tick = l.tick""")
def separation_ratio(v):
    rows = E.point_labels(v.telemetry.select("equipment_id", "tick", "pressure"), v.incidents)
    return E.separation_ratio(rows, "pressure", F.col("label") == 1).withColumn("separation_ratio", F.round("separation_ratio", 8))


@query("seed_pooled_recall", """SELECT seed, count(*) AS total, count(*) FILTER (a) AS detected_a, count(*) FILTER (b) AS detected_b,
 round(count(*) FILTER (a) / count(*) FILTER (b), 8) AS ratio FROM (SELECT m.event_id % 4 AS seed, m.detected AS a,
 EXISTS (SELECT 1 FROM telemetry t WHERE t.equipment_id = m.equipment_id AND t.alarm_code LIKE 'ERR%' AND t.tick BETWEEN m.start_tick AND m.end_tick) AS b FROM matched m) x
GROUP BY ROLLUP (seed)""")
def seed_pooled_recall(v):
    a = matched(v).select("event_id", F.col("detected").alias("detected_a"))
    err = v.telemetry.where(F.col("alarm_code").startswith("ERR")).select("equipment_id", "tick")
    b = E.events_detections_range(v.incidents, err).select("event_id", F.col("detected").alias("detected_b"))
    both = a.join(b, "event_id").withColumn("seed", F.col("event_id") % 4)
    return E.pooled_recall(both).withColumn("ratio", F.round("ratio", 8))


@query("step_eval", """SELECT round(avg(CAST(detected AS INT)), 8) AS region_recall, count(*) AS region_events,
round((SELECT count(*) FROM outside) / (SELECT d FROM days), 6) AS false_alarms_per_day FROM matched WHERE (start_tick // 50) % 3 = 1""")
def step_eval(v):
    out = E.step_eval(v.detections, v.incidents, n_ticks(v), F.floor(F.col("start_tick") / 50) % 3 == 1, GRACE)
    return out.withColumns({"region_recall": F.round("region_recall", 8), "false_alarms_per_day": F.round("false_alarms_per_day", 6)})


@query("drift_snr", """WITH p AS (SELECT equipment_id, stddev_pop(pressure) FILTER (tick < 720) AS noise, regr_slope(pressure, tick) FILTER (tick >= 720) AS slope FROM telemetry GROUP BY 1)
SELECT equipment_id, h AS horizon, round(noise, 4) AS noise, round(slope, 6) AS slope, round(abs(slope) * h / noise, 6) AS snr FROM p, (SELECT unnest([60, 180, 720]) AS h)""")
def drift_snr(v):
    out = E.drift_snr(v.telemetry, 720, "pressure", (60, 180, 720))
    return out.withColumns({"noise": F.round("noise", 4), "slope": F.round("slope", 6), "snr": F.round("snr", 6)})
