"""Steps whose tasks must not grow with the input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabsight import session
from fabsight.operators import evaluate as E, neighbors as N
from fabsight.plans import asof, series
from fabsight.reports import retrieval, streams
from fabsight.views import Views


def test_spread_deals_a_file_of_one_row_group(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/one"
    spark.range(20_000).withColumn("text", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.parquet(path)
    monkeypatch.setattr(session, "TASK_BYTES", 50_000)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        # many splits, and one of them has all rows
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() > 16
        rows = [r["count"] for r in session.spread(df).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sum(rows) == 20_000 and max(rows) < 4_000


def test_spread_leaves_a_table_of_nearly_enough_files(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(session.TASK_ROWS * (cores + 2)).repartition(cores).write.parquet(f"{tmp_path}/many")
    df = spark.read.parquet(f"{tmp_path}/many")
    assert session.spread(df) is df


def test_explicit_code_filter_moves_no_texts(spark, sf):
    """The hits are known to be few and go to the chunks, which are more than a broadcast may be."""
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    v = Views(spark, sf)
    assert session.stored_bytes(retrieval.chunks(v)) > 65_536
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "65536")
    try:
        found = retrieval.explicit_code_filter(v)
        assert "hashpartitioning(chunk_id" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_label_sums_hold_a_tile(monkeypatch):
    seen, plain = [], N.distances
    monkeypatch.setattr(N, "TILE", (7, 11))
    monkeypatch.setattr(N, "distances", lambda x, y: seen.append((len(x), len(y))) or plain(x, y))
    draw = np.random.default_rng(3)
    x, y, at = draw.normal(size=(30, 5)), draw.normal(size=(40, 5)), draw.integers(0, 6, 40)
    got = N.label_sums(x, y, at, 7)
    assert max(a for a, _ in seen) <= 7 and max(b for _, b in seen) <= 11
    assert got == pytest.approx(plain(x, y) @ np.eye(7)[at])


@pytest.mark.parametrize("name", ["stream_rule_judge", "stream_anomaly_score"])
def test_streams_in_many_batches(spark, sf, monkeypatch, name):
    """The table in slices gives the rows of one batch."""
    run = getattr(streams, name)
    whole = run(Views(spark, sf)).collect()
    monkeypatch.setattr(streams, "BATCH_ROWS", 2_000)
    v, batches = Views(spark, sf), []
    plain = streams.J.run_available
    monkeypatch.setattr(streams.J, "run_available", lambda *a: batches.append(plain(*a)) or batches[-1])
    sliced = run(v).collect()
    assert batches[0].select("batch_id").distinct().count() > 2
    text = lambda rows: sorted(map(str, rows))
    assert len(whole) > 100 and text(sliced) == text(whole)


def test_threshold_sweep_of_groups_over_stretches(spark, monkeypatch):
    """Events reach over many stretches of ticks; all groups in one sweep give what each gives alone."""
    draw = random.Random(5)
    events = spark.createDataFrame([(i, f"e{i % 3}", "acute", at := draw.randrange(0, 900), at + draw.choice([-1, 0, 5, 40, 600])) for i in range(60)],
                                   "event_id long, equipment_id string, kind string, start_tick long, end_tick long")
    scores = spark.createDataFrame([(g, f"e{i % 4}", "P0", t, round(draw.random() * draw.choice([1, 3]), 1))
                                    for g in range(3) for i in range(4) for t in range(0, 1000, 7) if draw.random() < .2],
                                   "place int, equipment_id string, process_type string, tick long, score double")
    limits = spark.createDataFrame([(g, "P0", [0.2 + g, 1.5, 2.5, 9.0]) for g in range(3)], "place int, process_type string, limits array<double>")
    alone = {(g, *r) for g in range(3) for r in E.threshold_sweep(events, scores.where(F.col("place") == g).drop("place"), limits.where(F.col("place") == g).drop("place"), 4, 10).collect()}
    monkeypatch.setattr(E, "SWEEP_TICKS", 30)
    assert {tuple(r) for r in E.threshold_sweep(events, scores, limits, 4, 10, groups=["place"]).collect()} == alone and len(alone) == 12


def test_quantiles_rank_only_the_parts_that_hold_them(spark):
    draw = np.random.default_rng(8)
    rows = [(k, round(float(x), 2)) for k in ("a", "b") for x in draw.normal(size=700)] + [("a", None), ("c", None), ("d", 4.0)]
    probs = {"none": 0.0, "half": 0.5, "high": 0.999, "all": 1.0}
    got = {r[0]: list(r[1:]) for r in series.exact_quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", probs).collect()}
    for k in ("a", "b", "d"):
        assert got.pop(k) == pytest.approx(np.quantile([x for n, x in rows if n == k and x is not None], list(probs.values())))
    assert not got


@pytest.mark.parametrize("parts", [1, 40])
def test_last_rows_over_range_partitions(spark, parts, monkeypatch):
    """A left row takes up rows of its own and of several earlier partitions."""
    draw = random.Random(4)
    right = [(f"e{draw.choice([0, 0, 0, 1, 2])}", draw.randrange(200), i, float(i)) for i in range(300)]
    left = [(i, f"e{draw.randrange(4)}", draw.randrange(-5, 230)) for i in range(200)] + [(999, None, 50)]
    monkeypatch.setattr(asof, "range_partitions", lambda df: parts)
    got = asof.last_rows(spark.createDataFrame(left, "id long, k string, at long"), spark.createDataFrame([*right, (None, 3, 999, 1.0)], "k string, t long, log long, x double"),
                         ["k"], "at", "t", 20, "log").collect()
    want = {i: [(t, g, x) for e, t, g, x in sorted(right, key=lambda r: r[1:]) if e == k and t < at][-20:] for i, k, at in left}
    assert {r["id"]: [tuple(x) for x in r["rows"]] for r in got} == want and len(got) == 201


def test_deviation_of_nested_baselines_moves_no_reading_per_incident(spark, sf):
    from fabsight.operators import incidents as I, telemetry as T
    from fabsight.reports.conversations import incident_points
    v = Views(spark, sf)
    p, near = incident_points(v), T.incident_nearest(incident_points(v), v.telemetry)
    rows, nested = T.incident_baseline(p, v.telemetry), T.incident_baseline(p, v.telemetry, nested=True)
    one, two = (sorted(map(str, I.sensor_deviation(p, near, b).collect())) for b in (rows, nested))
    assert one == two and len(one) > 100
    assert nested.count() == p.count()


def test_grid_makes_windows_once_a_length(spark, sf, monkeypatch):
    """Windows of a stride are taken from those of the greatest common divisor; readings are judged and closed up once."""
    from fabsight.reports import detection as Q
    made, plain, closed = [], Q.Wn.window_features, Q.Wn.closed_up
    monkeypatch.setattr(Q.Wn, "window_features", lambda df, pos, w, s, **o: made.append((pos, w, s)) or plain(df, pos, w, s, **o))
    monkeypatch.setattr(Q.Wn, "closed_up", lambda *a, **o: made.append("closed") or closed(*a, **o))
    v = Views(spark, sf)
    rows = Q.grid_sweep(v).collect()
    assert sorted(made, key=str) == sorted([(p, w, 12) for p in ("pos", "tick") for w in (12, 24)] + ["closed"], key=str)
    assert len(rows) == 18
    own = plain(v.telemetry, "tick", 24, 24)
    taken = v._stored["grid_24_12"].where("win % 2 = 0").withColumn("win", F.expr("win div 2"))
    assert own.exceptAll(taken.select(*own.columns)).count() == 0 and own.count() == taken.count() > 100


def test_points_of_a_sweep_over_stretches(spark, monkeypatch):
    """Points that are not nested, over many stretches, against every event and detection; events are not copied per point."""
    draw = random.Random(6)
    events = [(i, f"e{i % 3}", "acute", at := draw.randrange(0, 900), at + draw.choice([0, 5, 40, 300])) for i in range(50)]
    fired = sorted({(p, f"e{draw.randrange(4)}", draw.randrange(0, 1000)) for p in (2, 5, 9) for _ in range(40 * (p < 9))})
    monkeypatch.setattr(E, "SWEEP_TICKS", 30)
    points = spark.createDataFrame([(2, "a"), (5, "b"), (9, "c")], "point int, name string")
    got = E.sweep_metrics(spark.createDataFrame(events, "event_id long, equipment_id string, kind string, start_tick long, end_tick long"),
                          spark.createDataFrame(fired, "point int, equipment_id string, tick long"), points, 10).collect()
    assert len(got) == 3
    for r in got:
        mine = [(e, t) for p, e, t in fired if p == r["point"]]
        delays = [min(d) for _, e, _, a, b in events if (d := [t - a for x, t in mine if x == e and a <= t <= b])]
        alarms = {(e, t // 10) for e, t in mine if not any(x == e and a <= t <= b for _, x, _, a, b in events)}
        assert (r["recall"], r["false_alarms_dedup"]) == (pytest.approx(len(delays) / 50), len(alarms))
        assert r["delay_mean"] == (pytest.approx(np.mean(delays), abs=1e-6) if delays else None)
        assert r["delay_p90"] == (pytest.approx(np.quantile(delays, 0.9)) if delays else None)
