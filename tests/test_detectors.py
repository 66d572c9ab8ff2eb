"""Detectors on a small coupled series, and streaming jobs across restarts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabsight import constants as K
from fabsight.operators import detectors as D, serving as Sv, windows as Wn
from fabsight.streaming import jobs as J


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(0)
    rows = []
    for e in range(3):
        base = np.zeros(900)
        for i in range(1, 900):
            base[i] = 0.95 * base[i - 1] + rng.normal()
        noise = rng.normal(size=(900, 4)) * 0.1
        x = np.stack([base, 2 * base, -base, 0.5 * base], axis=1) + noise
        if e == 2:
            x[700:, 1] = rng.normal(size=200) * 4  # correlation breaks, level stays
        rows += [(f"e{e}", "P", i, *map(float, x[i])) for i in range(900)]
    return spark.createDataFrame(rows, "equipment_id string, process_type string, tick long, temperature double, pressure double, rf_power double, gas_flow double").cache()


@pytest.fixture(scope="module")
def tables(series):
    w = Wn.window_features(series, tensor=True).cache()
    return w.where("equipment_id <> 'e2'"), w.where("equipment_id = 'e2' AND win >= 117")


@pytest.mark.parametrize("fit,score", [(D.pca_fit, D.pca_score), (D.var_fit, D.var_score), (D.recon_fit, D.recon_score)])
def test_normal_stays_under_and_break_is_seen(tables, fit, score):
    train, broken = tables
    state = fit(train)
    over = score(train, state).agg(F.avg((F.col("raw") > 1).cast("double"))).first()[0]
    assert over <= 0.01
    rows = score(broken, state).collect()
    assert sum(r["raw"] > 1 for r in rows) > len(rows) * 0.9
    channels = [r["channel"] for r in rows]
    assert max(set(channels), key=channels.count) == "pressure"


def test_var_against_plain_least_squares(tables):
    train, _ = tables
    x = D.tensor(train.select("x").toPandas())
    d, y = D._design(x, 2)
    coef = np.linalg.lstsq(d.reshape(-1, 9), y.reshape(-1, 4), rcond=None)[0].T
    np.testing.assert_allclose(np.array(D.var_fit(train, 2)[0].coef), coef, rtol=1e-4, atol=1e-5)


def test_state_round_trip(spark, tables):
    train, _ = tables
    states = D.pca_fit(train) + D.var_fit(train)
    assert D.states_from_df(D.states_to_df(spark, states)) == states


def test_all_components_leave_no_residual(tables):
    train, _ = tables
    stats = D.pca_statistics(train, D.pca_fit(train, 1.0))
    assert stats.agg(F.max("spe")).first()[0] < 1e-6


def test_grid_equals_a_fit_per_point(tables):
    """Components kept of one spectrum and limits taken together fire as a model fitted for each share and quantile does."""
    train, broken = tables
    shares, quantiles = (0.6, 0.9, 0.999), (0.9, 0.99)
    fired = D.grid_fired(train, broken, D.pca_bases(train), shares, quantiles).collect()
    assert len(fired) > 10
    for i, share in enumerate(shares):
        for j, q in enumerate(quantiles):
            alone = D.pca_score(broken, D.pca_fit(train, share, q)).where("raw > 1 + 1e-9").collect()
            assert sorted(r["win"] for r in fired if (r["share"], r["quantile"]) == (i, j)) == sorted(r["win"] for r in alone)


def test_forest_ranks_far_points_first(tables):
    train, _ = tables
    far = train.limit(5).withColumns({c: F.lit(1e3) for c in Wn.CHANNEL_FEATURES})
    model = D.forest_fit(train, trees=20)
    # the most extreme training rows are cut off as early as anything beyond them, so compare with nearly all of them
    usual = D.forest_score(train, model, train).agg(F.percentile("raw", 0.99)).first()[0]
    assert D.forest_score(far, model, train).agg(F.min("raw")).first()[0] > usual


def feed(spark, path, rows):
    df = spark.createDataFrame(rows, "event_id long, equipment_id string, metric string, ts string, alarm_code string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def test_transitions_resume_after_restart(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = feed(spark, src, [(1, "e", "m", "2024-01-01 00:00:00", "A"), (2, "e", "m", "2024-01-01 00:00:05", "A")])
    run = lambda: J.run_available(J.stream_alarm_transitions(spark.readStream.schema(schema).parquet(src)), out, ck)
    assert [(r["action"], r["alarm_code"]) for r in run().collect()] == [("raise", "A")]
    feed(spark, src, [(3, "e", "m", "2024-01-01 00:00:10", "B"), (4, "e", "m", "2024-01-01 00:00:15", None)])
    got = [(r["action"], r["alarm_code"]) for r in run().orderBy("at", "action").collect()]
    assert got == [("raise", "A"), ("clear", "A"), ("raise", "B"), ("clear", "B")]
    assert run().count() == 4


def test_features_of_a_window_matrix(series):
    rows = Wn.window_features(series.where("equipment_id = 'e0'"), tensor=True).orderBy("win").toPandas()
    got = D.window_feature_matrix(D.tensor(rows))
    assert np.allclose(got, rows[list(Wn.ALL_FEATURES)].to_numpy(float), atol=1e-9)


def test_streamed_scores_equal_batch_scores_whatever_the_order(spark, series, tables, tmp_path):
    """Three batches: the second comes late, with rows that the first one skipped, and rows come twice."""
    fitted = Sv.fit_windows(tables[0].unionByName(tables[0].withColumn("win", F.col("win") + 1000)), least=1)
    limits = spark.createDataFrame([("P", 0.5, 0.4, 10)], "process_type string, ewma_limit double, var_ewma_limit double, train_windows long")
    fitted = Sv.Fitted(fitted.pca, fitted.var, limits, spark.createDataFrame([("e1", 0.3, 10)], "equipment_id string, ewma_limit double, train_windows long"))
    rows = series.where("tick < 899 OR equipment_id <> 'e2'")
    parts = ["tick < 300 AND NOT (tick > 40 AND tick % 50 = 7) OR tick BETWEEN 500 AND 640", "tick < 500 AND (tick % 50 = 7 OR tick >= 290)", "tick >= 640"]
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for part in parts:
        rows.where(part).coalesce(1).write.mode("append").parquet(src)
        got = J.run_available(J.stream_anomaly_score(spark.readStream.schema(rows.schema).parquet(src), fitted, threshold=2.0), out, ck)
    want = Sv.score_series(Wn.window_features(rows, tensor=True), fitted, threshold=2.0).select("equipment_id", "win", "score", "fired", "channel", "masked").toPandas()
    both = got.toPandas().merge(want, on=["equipment_id", "win"], suffixes=("", "_batch"))
    assert len(both) == len(want) == got.count() and want.fired.any() and want.masked.any()
    seeded = both.sort_values("win").groupby("equipment_id")["masked"].transform(lambda m: (~m).cummax())
    both = both[seeded.reindex(both.index)]
    assert np.allclose(both.score, both.score_batch, atol=1e-9)
    assert (both.fired == both.fired_batch).all() and (both.channel.fillna("") == both.channel_batch.fillna("")).all()


def test_late_alarm_is_not_notified_and_bucket_is_kept_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))

    def add(rows):
        df = spark.createDataFrame(rows, "alarm_id long, equipment_id string, metric string, alarm_code string, raised_at string").withColumn("raised_at", F.col("raised_at").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(src)
        return df.schema

    schema = add([(1, "e", "m", "A", "2024-01-01 10:00:00"), (2, "e", "m", "A", "2024-01-01 10:10:00"), (3, "e", "m", "A", "2024-01-01 14:00:00")])
    key = ["equipment_id", "metric", "alarm_code", "bucket_start"]

    def run():
        stream = J.stream_notification_dedup(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
        return J.run_available(stream, out, ck, J.insert_missing(out, key), "update")

    assert run().count() == 2
    add([(4, "e", "m", "A", "2024-01-01 10:31:00"), (5, "e", "m", "A", "2024-01-01 14:05:00"), (6, "e", "m", "B", "2024-01-01 13:00:00")])
    got = sorted((r["alarm_code"], str(r["bucket_start"])[11:16]) for r in run().collect())
    assert got == [("A", "10:00"), ("A", "14:00"), ("B", "13:00")]


def test_constants_hold_together():
    assert set(K.ACUTE_CODES) == set(K.DRIFT_CODES) == set(K.CHANNELS)
    assert set(K.ALARM_TEXTS["ko"]) == set(K.ALARM_TEXTS["en"]) == set(K.CHECKLISTS["ko"]) == set(K.CHECKLISTS["en"])


def test_window_features_by_piece_equal_sql_aggregates(spark, monkeypatch):
    """Missing values, gaps, a change of type and several pieces, against plain aggregates of exploded rows; one exchange."""
    monkeypatch.setattr(Wn, "PIECE_ROWS", 40)
    draw = np.random.default_rng(21)
    rows = []
    for e in ("a", "b"):
        for t in range(260):
            if e == "b" and t in (77, 78):
                continue
            x = [float(v) if draw.random() > (0.1 if e == "a" else 0) else None for v in draw.normal(size=4)]
            rows.append((e, "P0" if e == "a" or t < 150 else "P1", t, *(x if not 100 <= t < 112 or e == "b" else [None] * 4)))
    df = spark.createDataFrame(rows, "equipment_id string, process_type string, tick long, " + ", ".join(f"{c} double" for c in K.CHANNELS))
    for window, stride in ((12, 6), (5, 7), (50, 3)):
        got = Wn.window_features(df, "tick", window, stride, tensor=True)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
        wide = df.withColumns({f"_d{i}": F.expr(f"{c} - lag({c}) OVER (PARTITION BY equipment_id ORDER BY tick)") for i, c in enumerate(K.CHANNELS)})
        wide = wide.withColumn("win", F.explode(Wn.window_numbers(F.col("tick"), window, stride))).withColumn("off", (F.col("tick") - F.col("win") * stride).cast("double"))
        aggs = [F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list(F.struct("tick", F.array(*K.CHANNELS).alias("v")))).alias("_x")]
        for i, c in enumerate(K.CHANNELS):
            aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"),
                     F.regr_slope(F.col(c), F.col("off")).alias(f"slope_{c}"), F.stddev_pop(F.when(F.col("off") > 0, F.col(f"_d{i}"))).alias(f"dstd_{c}")]
        aggs += [(F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b) + F.lit(1e-12))).alias(f"corr_{a}__{b}") for a, b in Wn.PAIRS]
        want = wide.groupBy("equipment_id", "process_type", "win").agg(*aggs).where(F.col("_n") == window)
        want = want.withColumn("x", F.flatten(F.transform("_x", lambda r: r["v"])))
        key = ["equipment_id", "process_type", "win"]
        a, b = ({tuple(r[k] for k in key): r for r in d.select(*key, *Wn.ALL_FEATURES, "x").collect()} for d in (got, want))
        assert a.keys() == b.keys() and len(a) > 20
        for k, r in a.items():
            assert r["x"] == b[k]["x"]
            for c in Wn.ALL_FEATURES:
                assert (r[c] is None) == (b[k][c] is None), (k, c, r[c], b[k][c])
                assert r[c] is None or r[c] == pytest.approx(b[k][c], abs=1e-9), (k, c)
