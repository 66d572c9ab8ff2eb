"""Multivariate detectors, serving and sweeps."""

from __future__ import annotations

from math import gcd

from pyspark.sql import functions as F

from fabsight import constants as K
from fabsight.operators import detectors as D, evaluate as E, scoring as S, serving as Sv, windows as Wn
from fabsight.operators.protocol import WindowDetector
from fabsight.plans.series import ewma_last as fold_last
from fabsight.registry import query
from fabsight.reports import models as G
from fabsight.reports.series import stepped, win_score
from fabsight.views import SQL_VIEWS

SQL_VIEWS["train_rows"] = """SELECT t.*, unnest(range(CAST(greatest(0, ceil((pos - 11) / 6.0)) AS BIGINT), pos // 6 + 1)) AS win FROM (
SELECT t.equipment_id, t.process_type, """ + ", ".join(K.CHANNELS) + """, row_number() OVER (PARTITION BY t.equipment_id ORDER BY tick) - 1 AS pos
FROM telemetry t LEFT JOIN master m ON t.equipment_id = m.equipment_id WHERE alarm_code IS NULL AND (repaired_at IS NULL OR "timestamp" >= repaired_at)) t"""
SQL_VIEWS["train_wins"] = "SELECT equipment_id, process_type, win, avg(gas_flow) AS mean_gas_flow, stddev_pop(pressure) AS std_pressure FROM train_rows GROUP BY 1, 2, 3 HAVING count(*) = 12"


def train(v):
    return v.stored("train_windows", lambda: Sv.training_windows(v.telemetry, v.master))


def windows(v):
    return v.stored("all_windows", lambda: Wn.window_features(v.telemetry, tensor=True))


def fitted(v):
    if "fitted" not in v._stored:
        v._stored["fitted"] = Sv.fit_windows(train(v))
    return v._stored["fitted"]


@query("effective_since", "SELECT equipment_id, greatest(repaired_at, TIMESTAMP '2024-01-01 00:30:00') AS since FROM master")
def effective_since(v):
    return Sv.effective_since(v.master, F.lit("2024-01-01 00:30:00").cast("timestamp"))


@query("training_windows", "SELECT equipment_id, win, round(mean_gas_flow, 8) AS mean_gas_flow, round(std_pressure, 4) AS std_pressure FROM train_wins")
def training_windows(v):
    return train(v).select("equipment_id", "win", F.round("mean_gas_flow", 8).alias("mean_gas_flow"), F.round("std_pressure", 4).alias("std_pressure"))


@query("standardize_fit", "SELECT process_type, count(*) AS n, round(avg(mean_gas_flow), 8) AS m, round(stddev_pop(mean_gas_flow), 8) AS s FROM train_wins GROUP BY 1")
def standardize_fit(v):
    i = Wn.ALL_FEATURES.index("mean_gas_flow")
    return D.standardize_fit(train(v)).select("process_type", "n", F.round(F.col("mean")[i], 8).alias("m"), F.round(F.col("scale")[i], 8).alias("s"))


@query("covariance_gram", "SELECT process_type, round(corr(mean_gas_flow, std_pressure), 6) AS r, count(*) AS n FROM train_wins GROUP BY 1")
def covariance_gram(v):
    cols = ["mean_gas_flow", "std_pressure"]
    g = D.covariance_gram(train(v), D.scaler_of(train(v), cols), cols)
    wide = g.groupBy("process_type").agg(F.max(F.when(F.col("i") == 1, F.col("value"))).alias("xy"), F.max(F.when(F.col("i") == 8, F.col("value"))).alias("n"))
    return wide.select("process_type", F.round(F.col("xy") / F.col("n"), 6).alias("r"), F.col("n").cast("long").alias("n"))


_OVER = "count(*) - 1 - CAST(floor(0.999 * (count(*) - 1)) AS BIGINT)"


# what every correct fit must satisfy on its own training rows: squared norms add up, T2 averages to the
# number of components, and the limits leave out exactly the rows above the interpolated quantile
@query("pca_fit", f"SELECT process_type, count(*) AS n, CAST({len(Wn.ALL_FEATURES)} AS DOUBLE) AS mean_norm, CAST(1 AS DOUBLE) AS mean_t2, {_OVER} AS over_t2, {_OVER} AS over_spe FROM train_wins GROUP BY 1")
def pca_fit(v):
    states = D.pca_fit(train(v))
    stats = D.pca_statistics(train(v), states)
    k = D._by_process({s.process_type: (len(s.components), s.t2_limit, s.spe_limit) for s in states})
    marked = stats.withColumns({"_k": k[0], "_t": k[1], "_s": k[2]})
    return marked.groupBy("process_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("norm"), 6).alias("mean_norm"),
        F.round(F.sum(F.col("t2") / F.col("_k")) / (F.count(F.lit(1)) - 1), 6).alias("mean_t2"),
        F.count_if(F.col("t2") > F.col("_t")).alias("over_t2"), F.count_if(F.col("spe") > F.col("_s")).alias("over_spe"))


@query("pca_score", "SELECT equipment_id, win, round(greatest(t2, spe), 6) AS raw, round(t2, 6) AS t2, round(spe, 6) AS spe FROM given_pca")
def pca_score(v):
    """Score of a given model, and the part of it that a single statistic gives, for every window."""
    states = G.pca_states()
    both = D.pca_score(windows(v), states).select("equipment_id", "win", F.round("raw", 6).alias("raw"))
    one = D.pca_score(windows(v), states, "t2").select("equipment_id", "win", F.round("raw", 6).alias("t2"))
    two = D.pca_score(windows(v), states, "spe").select("equipment_id", "win", F.round("raw", 6).alias("spe"))
    return both.join(one, ["equipment_id", "win"]).join(two, ["equipment_id", "win"])


@query("pca_top_channel", "SELECT equipment_id, win, channel FROM given_pca")
def pca_top_channel(v):
    return D.pca_score(windows(v), G.pca_states()).select("equipment_id", "win", "channel")


@query("pca_state_io", "SELECT p.equipment_id, p.win, round(greatest(t2, spe), 6) AS pca, round(v.raw, 6) AS var FROM given_pca p JOIN given_var v ON p.equipment_id = v.equipment_id AND p.win = v.win")
def pca_state_io(v):
    """Scores of models that were written as a table and read again."""
    again = D.states_from_df(v.stored("given_states", lambda: D.states_to_df(v.spark, [*G.pca_states(), *G.var_states()])))
    a = D.pca_score(windows(v), [s for s in again if isinstance(s, D.PcaState)]).select("equipment_id", "win", F.round("raw", 6).alias("pca"))
    b = D.var_score(windows(v), [s for s in again if isinstance(s, D.VarState)]).select("equipment_id", "win", F.round("raw", 6).alias("var"))
    return a.join(b, ["equipment_id", "win"])


def _over(scores):
    return scores.groupBy("process_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("raw") > 1).alias("over_limit"))


@query("var_fit", f"SELECT process_type, count(*) AS n, {_OVER} AS over_limit FROM train_wins GROUP BY 1")
def var_fit(v):
    return _over(D.var_score(train(v), D.var_fit(train(v))))


@query("var_score", "SELECT equipment_id, win, round(raw, 6) AS raw FROM given_var")
def var_score(v):
    return D.var_score(windows(v), G.var_states()).select("equipment_id", "win", F.round("raw", 6).alias("raw"))


@query("var_top_channel", "SELECT equipment_id, win, channel FROM given_var")
def var_top_channel(v):
    return D.var_score(windows(v), G.var_states()).select("equipment_id", "win", "channel")


@query("conditional_recon_linear", f"SELECT process_type, count(*) AS n, {_OVER} AS over_limit FROM train_wins GROUP BY 1")
def conditional_recon_linear(v):
    return _over(D.recon_score(train(v), D.recon_fit(train(v))))


@query("isolation_forest", "SELECT equipment_id, win, round(raw, 6) AS raw FROM given_forest")
def isolation_forest(v):
    return D.forest_score(windows(v), G.forest_model()).select("equipment_id", "win", F.round("raw", 6).alias("raw"))


@query("isolation_forest_fit")
def isolation_forest_fit(v):
    """A forest grown on the training windows, scoring all windows (random trees: no SQL)."""
    return WindowDetector("iforest").fit(train(v)).transform(windows(v)).select("equipment_id", "win", F.round("raw", 6).alias("raw"))


@query("detector_protocol", f"SELECT process_type, count(*) AS n, {_OVER} AS over_limit FROM train_wins GROUP BY 1")
def detector_protocol(v):
    return _over(WindowDetector("var", lag=1).fit(train(v)).transform(train(v)))


@query("merged_score", """SELECT p.equipment_id, p.win, round(greatest(t2, spe, v.raw), 6) AS score, t2 > 1 OR spe > 1 OR v.raw > 1 AS fired,
CASE WHEN t2 > 1 OR spe > 1 THEN p.channel WHEN v.raw > 1 THEN v.channel END AS channel FROM given_pca p JOIN given_var v ON p.equipment_id = v.equipment_id AND p.win = v.win""")
def merged_score(v):
    pca = D.pca_score(windows(v), G.pca_states()).withColumns({"score": F.col("raw"), "fired": F.col("raw") > 1, "masked": F.lit(False)})
    var = D.var_score(windows(v), G.var_states()).select("equipment_id", "win", F.col("raw").alias("_vs"), (F.col("raw") > 1).alias("_vf"), F.col("channel").alias("_vc"))
    both = Sv.merged_score(pca.join(var, ["equipment_id", "win"]))
    return both.select("equipment_id", "win", F.round("score", 6).alias("score"), "fired", "channel")


@query("fit_process_models", "SELECT process_type, count(*) AS train_windows, true AS limited FROM train_wins GROUP BY 1 HAVING count(*) >= 200")
def fit_process_models(v):
    v._stored["fitted"] = Sv.fit_process_models(v.telemetry, v.master)
    return fitted(v).limits.select("process_type", "train_windows", ((F.col("ewma_limit") > 0) & (F.col("var_ewma_limit") > 0)).alias("limited"))


_ACC = """WITH RECURSIVE s AS MATERIALIZED (SELECT equipment_id, process_type, win, least(raw, 3.0) AS raw FROM win_score),
r AS (SELECT equipment_id, process_type, win, raw AS y FROM s WHERE win = 0
 UNION ALL SELECT s.equipment_id, s.process_type, s.win, 0.1 * s.raw + 0.9 * r.y FROM r JOIN s ON s.equipment_id = r.equipment_id AND s.win = r.win + 1),
n AS (SELECT equipment_id, count(*) AS n FROM s GROUP BY 1), steady AS (SELECT r.* FROM r JOIN n USING (equipment_id) WHERE n - 50 < 100 OR win >= 50)"""


@query("ewma_limit_by_parts", _ACC + " SELECT process_type, round(quantile_cont(y, 0.999), 8) AS ewma_limit FROM steady GROUP BY 1")
def ewma_limit_by_parts(v):
    return Sv.ewma_limit_by_parts(Sv.accumulated(win_score(v))).withColumn("ewma_limit", F.round("ewma_limit", 8))


@query("calibrate_equipment", _ACC + """, p AS (SELECT process_type, quantile_cont(y, 0.999) AS l FROM steady GROUP BY 1), o AS (SELECT equipment_id, process_type, quantile_cont(y, 0.999) AS own FROM steady GROUP BY 1, 2)
SELECT equipment_id, round(greatest(least(own, 1.5 * l), 0.5 * l), 8) AS ewma_limit, n AS train_windows FROM o JOIN p USING (process_type) JOIN n USING (equipment_id) WHERE n >= 200""")
def calibrate_equipment(v):
    scores = v.stored("win_score", lambda: win_score(v))
    acc = v.stored("win_acc", lambda: Sv.accumulated(scores))
    return Sv.calibrate_equipment(scores, acc, Sv.ewma_limit_by_parts(acc)).withColumn("ewma_limit", F.round("ewma_limit", 8))


@query("groups_left_out", f"""SELECT m.equipment_id, coalesce(n, 0) AS n_windows, CASE WHEN n IS NULL THEN 'no window' ELSE 'fewer than {K.MIN_CALIBRATION_WINDOWS}' END AS reason
FROM (SELECT DISTINCT equipment_id FROM master) m LEFT JOIN (SELECT equipment_id, count(*) AS n FROM train_wins GROUP BY 1) t ON m.equipment_id = t.equipment_id
WHERE coalesce(n, 0) < {K.MIN_CALIBRATION_WINDOWS}""")
def groups_left_out(v):
    """Equipment that gets no limit of its own, with what it has."""
    return Sv.left_out(v.master, train(v), "equipment_id", K.MIN_CALIBRATION_WINDOWS)


@query("equipment_limit_override", """SELECT equipment_id, CASE WHEN equipment_no % 3 = 0 THEN 1.5 ELSE CASE process_type WHEN 'P0' THEN 1.0 ELSE 2.0 END END::DOUBLE AS "limit" FROM master""")
def equipment_limit_override(v):
    own = v.master.where("equipment_no % 3 = 0").select("equipment_id", F.lit(1.5).alias("ewma_limit"))
    typ = v.master.select("process_type").distinct().withColumn("ewma_limit", F.when(F.col("process_type") == "P0", 1.0).otherwise(2.0))
    return S.limit_override(v.master, typ, own).select("equipment_id", "limit")


@query("model_by_process_type", "SELECT equipment_id, process_type FROM master WHERE process_type IN (SELECT process_type FROM train_wins)")
def model_by_process_type(v):
    models = D.states_to_df(v.spark, fitted(v).pca)
    return Sv.model_by_process_type(v.master, models).select("equipment_id", "process_type")


@query("stale_models", "SELECT equipment_id FROM master WHERE repaired_at < TIMESTAMP '2024-01-08 00:30:00' - INTERVAL 168 HOURS")
def stale_models(v):
    models = v.master.select("equipment_id", F.col("repaired_at").alias("fitted_at"))
    return Sv.stale_models(models, F.lit("2024-01-08 00:30:00").cast("timestamp")).select("equipment_id")


def series(v):
    return v.stored("score_series", lambda: Sv.score_series(windows(v), G.fitted(v.spark), threshold=G.JUMP))


@query("score_series", G.sql_series("given") + "SELECT equipment_id, win, fired, channel, round(score, 6) AS score FROM series")
def score_series(v):
    """Every window by given models; fitting is ``fit_process_models``."""
    return series(v).select("equipment_id", "win", "fired", "channel", F.round("score", 6).alias("score"))


@query("score_series_fitted")
def score_series_fitted(v):
    """Every window by the models fitted on its own table (``pca_fit`` and ``var_fit`` are compared on their own)."""
    return Sv.score_series(windows(v), fitted(v)).select("equipment_id", "win", "fired", "channel", F.round("score", 6).alias("score"))


def latest(v):
    return v.stored("score_latest", lambda: Sv.score_latest(v.telemetry, G.fitted(v.spark), lookback=K.LOOKBACK_ROWS, threshold=G.JUMP))


@query("score_latest", G.sql_series("late") + """SELECT equipment_id, arg_max(fired, win) AS fired, arg_max({'c': channel}, win).c AS channel, round(arg_max(score, win), 6) AS score FROM series GROUP BY 1""")
def score_latest(v):
    return latest(v).select("equipment_id", "fired", "channel", F.round("score", 6).alias("score"))


@query("anomaly_transitions", G.sql_series("late") + """, w AS (SELECT equipment_id, arg_max(fired, win) AS fired, arg_max({'c': channel}, win).c AS channel, arg_max(score, win) AS score FROM series GROUP BY 1),
o AS (SELECT DISTINCT equipment_id FROM alarms WHERE cleared_at IS NULL AND alarm_code = 'ERR-402')
SELECT w.equipment_id, CASE WHEN fired THEN 'raise' ELSE 'clear' END AS action, CASE WHEN w.equipment_id IN ('EQP-003', 'EQP-007') THEN 'alarm' ELSE 'shadow' END AS sink,
channel, round(score, 6) AS score FROM w LEFT JOIN o ON w.equipment_id = o.equipment_id WHERE fired <> (o.equipment_id IS NOT NULL)""")
def anomaly_transitions(v):
    open_ = v.alarms.where("alarm_code = 'ERR-402'")
    moves = Sv.anomaly_transitions(latest(v), open_, F.lit("2024-02-01").cast("timestamp"), ["EQP-003", "EQP-007"])
    return moves.select("equipment_id", "action", "sink", "channel", F.round("score", 6).alias("score"))


def swept_grid(v, bases_of):
    """Metrics of every point of the grid.

    The training rows are judged and closed up once.  Windows of one length are made once, for fitting and for scoring apart: at the
    greatest common divisor of the strides, of which every stride takes its own.
    """
    if "train_rows" not in v._stored:
        v._stored["train_rows"] = Sv.training_rows(v.telemetry, v.master)
    rows, fired = v._stored["train_rows"], None
    for w in sorted({w for w, _ in G.SHAPES}):
        strides = [s for x, s in G.SHAPES if x == w]
        step = gcd(*strides)
        fits = v.stored(f"grid_fit_{w}_{step}", lambda w=w, step=step: Wn.window_features(rows, "pos", w, step))
        scores = v.stored(f"grid_{w}_{step}", lambda w=w, step=step: Wn.window_features(v.telemetry, "tick", w, step))
        for s in strides:
            fit, scored = (t.where(F.col("win") % (s // step) == 0).withColumn("win", F.expr(f"win div {s // step}")) for t in (fits, scores))
            hits = D.grid_fired(fit, scored, bases_of(fit), G.SHARES, G.GRID_QUANTILES).select(
                F.lit(w).alias("window"), F.lit(s).alias("stride"), "share", F.col("quantile").alias("q"), "equipment_id", (F.col("win") * s + w - 1).alias("tick"))
            fired = hits if fired is None else fired.unionByName(hits)
    points = v.spark.createDataFrame(G.grid_points(), "point int, window int, stride int, variance double, quantile double")
    place = lambda c, values: F.array_position(F.array(*[F.lit(x) for x in values]), F.col(c)) - 1
    named = points.withColumns({"share": place("variance", G.SHARES).cast("int"), "q": place("quantile", G.GRID_QUANTILES).cast("int")})
    found = fired.join(F.broadcast(named.select("point", "window", "stride", "share", "q")), ["window", "stride", "share", "q"])
    return E.sweep_metrics(v.incidents, found, points).drop("point")


@query("grid_sweep", """SELECT window_ AS "window", stride, variance, quantile, recall, delay_mean, delay_p90, coalesce(f.n, 0) AS false_alarms_dedup FROM (
SELECT point, round(avg(CAST(delay IS NOT NULL AS INT)), 8) AS recall, quantile_cont(delay, 0.9) AS delay_p90, round(avg(delay), 6) AS delay_mean FROM (
 SELECT p.point, e.event_id, min(f.tick) - any_value(e.start_tick) AS delay FROM incidents e CROSS JOIN grid_params p
 LEFT JOIN grid_fired f ON f.point = p.point AND f.equipment_id = e.equipment_id AND f.tick BETWEEN e.start_tick AND e.end_tick GROUP BY 1, 2) x GROUP BY 1) h
JOIN grid_params USING (point) LEFT JOIN (SELECT point, count(DISTINCT (equipment_id, tick // 360)) AS n FROM grid_fired s WHERE NOT EXISTS
 (SELECT 1 FROM incidents e WHERE e.equipment_id = s.equipment_id AND s.tick BETWEEN e.start_tick AND e.end_tick) GROUP BY 1) f USING (point)""")
def grid_sweep(v):
    """Window, stride, kept variance and quantile over given components."""
    return swept_grid(v, lambda fit: G.pca_bases())


@query("grid_sweep_fitted")
def grid_sweep_fitted(v):
    """The same grid with components fitted on the training windows of each (window, stride)."""
    return swept_grid(v, D.pca_bases)


@query("step_aware_models", "SELECT step, count(*) AS n, count(*) - 1 - CAST(floor(0.999 * (count(*) - 1)) AS BIGINT) AS over_limit FROM win_steps WHERE step <> 'transition' GROUP BY 1")
def step_aware_models(v):
    """One model and limit per recipe step; windows crossing steps are not scored."""
    steps = Wn.window_step_label(stepped(v)).where("step <> 'transition'")
    own = v.stored("step_windows", lambda: windows(v).drop("process_type").join(steps, ["equipment_id", "win"]).withColumnRenamed("step", "process_type"))
    return _over(D.var_score(own, D.var_fit(own))).withColumnRenamed("process_type", "step")


@query("ewma_last", _ACC + " SELECT equipment_id, round(arg_max(y, win), 8) AS ewma_last FROM r GROUP BY 1")
def ewma_last(v):
    """The ordered fold as an aggregate of composable steps."""
    clipped = win_score(v).withColumn("raw", F.least("raw", F.lit(3.0)))
    return fold_last(clipped, ["equipment_id"], "win", "raw", K.EWMA_ALPHA).withColumn("ewma_last", F.round("ewma_last", 8))
