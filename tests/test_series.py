"""Ordered operators against plain Python, with pieces small enough that every carry is exercised."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabsight.operators import scoring as S, windows as Wn
from fabsight.operators.alarms import alarm_transitions, confirm_two_ticks
from fabsight.plans import series as P
from fabsight.plans.asof import along, asof_backward


def frame(spark, values, key="a", name="x"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], f"k string, pos long, {name} double")


def values(df, col, order="pos"):
    return [r[col] for r in df.orderBy(order).collect()]


def ref_ewma(x, alpha, mask=None):
    mask = mask if mask is not None else [False] * len(x)
    free = [i for i, m in enumerate(mask) if not m]
    if not free:
        return [0.0] * len(x)
    acc, out = x[free[0]], []
    for v, m in zip(x, mask):
        acc = acc if m else alpha * v + (1 - alpha) * acc
        out.append(acc)
    return out


def test_ewma_known(spark):
    assert values(P.ewma(frame(spark, [1, 3, 1]), ["k"], "pos", "x", 0.5), "ewma") == [1, 2, 1.5]
    assert values(P.ewma(frame(spark, [4, 7]), ["k"], "pos", "x", 1.0), "ewma") == [4, 7]
    with pytest.raises(ValueError):
        P.ewma(frame(spark, [1]), ["k"], "pos", "x", 0.0)


@pytest.mark.parametrize("alpha,size", [(0.1, 7), (0.5, 3), (0.9, 2), (0.1, None)])
def test_ewma_pieces_and_mask(spark, alpha, size):
    rng = np.random.default_rng(3)
    x, mask = rng.random(400).tolist(), (rng.random(400) < 0.3).tolist()
    mask[:20] = [True] * 20
    rows = [("a", i, v, m) for i, (v, m) in enumerate(zip(x, mask))] + [("b", i, float(i), True) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, pos long, x double, m boolean")
    out = P.ewma(df, ["k"], "pos", "x", alpha, mask="m", size=size)
    np.testing.assert_allclose(values(out.where("k='a'"), "ewma"), ref_ewma(x, alpha, mask), rtol=1e-12)
    assert set(values(out.where("k='b'"), "ewma")) == {0.0}


def test_masked_ewma_literal(spark):
    df = spark.createDataFrame([("a", 0, 100.0, True), ("a", 1, 2.0, False), ("a", 2, 4.0, False)], "k string, pos long, x double, m boolean")
    assert values(P.ewma(df, ["k"], "pos", "x", 0.5, mask="m"), "ewma") == [2, 2, 3]


def test_number_rows_with_one_hot_key(spark):
    n = 5000
    df = spark.range(n).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))).alias("k"),
                               ((F.col("id") * 7919) % n).alias("o"))
    out = P.number_rows(df, ["k"], [F.asc("o")], "pos")
    got = out.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.max("pos").alias("m"), F.min("pos").alias("z")).collect()
    assert all(r["n"] == r["d"] == r["m"] + 1 and r["z"] == 0 for r in got)
    hot = [r["o"] for r in out.where("k='hot'").orderBy("pos").collect()]
    assert hot == sorted(hot)


def test_hot_key_is_spread_over_tasks(spark):
    """A key owning most rows ends up in several pieces of bounded size."""
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("pos"))
    sizes = [r["count"] for r in P.pieces(df, "pos", before=2, size=500).groupBy("k", P.PIECE).count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 502
    parts = P.ordered_sums(df, ["k"], [F.asc("pos")], {"c": F.lit(1)}).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1


@pytest.mark.parametrize("size,block", [(None, 1024), (7, 3)])
def test_ewma_last_is_the_last_ewma(spark, monkeypatch, size, block):
    monkeypatch.setattr(P, "BLOCK_PIECES", block)
    draw = np.random.default_rng(5)
    rows = [("a", i, float(x)) for i, x in enumerate(draw.random(500))] + [("b", 0, 2.5), ("c", 0, 1.0), ("c", 1, 3.0)]
    df = spark.createDataFrame(rows, "k string, pos long, x double")
    want = {}
    for k, _, x in rows:
        want[k] = 0.2 * x + 0.8 * want[k] if k in want else x
    got = {r.k: r.ewma_last for r in P.ewma_last(df, ["k"], "pos", "x", 0.2, size).collect()}
    assert got == pytest.approx(want, rel=1e-12)
    assert P.ewma_last(df.limit(0), ["k"], "pos", "x", 0.2).count() == 0


def test_running_sums_and_lookback(spark):
    df = frame(spark, range(50))
    out = P.running_sums(df, ["k"], "pos", {"s": F.col("x")}, size=7)
    assert values(out, "s") == np.cumsum(range(50)).tolist()
    back = P.neighbours(df, ["k"], "pos", {"m": lambda w: F.sum("x").over(w.rowsBetween(-3, 0))}, before=3, size=5)
    assert values(back, "m") == [sum(range(max(0, i - 3), i + 1)) for i in range(50)]
    ahead = P.neighbours(df, ["k"], "pos", {"m": lambda w: F.lead("x", 2).over(w)}, after=2, size=4)
    assert values(ahead, "m") == [i + 2.0 for i in range(48)] + [None, None]


@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 0.999, 1.0])
def test_exact_quantiles(spark, q):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=777), 1)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 5.0)], "k string, v double")
    got = {r["k"]: r["q"] for r in P.exact_quantiles(df, ["k"], "v", {"q": q}).collect()}
    assert got["a"] == pytest.approx(np.quantile(x, q)) and got["b"] == 5.0
    assert P.exact_quantiles(df.where("k='a'"), [], "v", {"q": q}).first()["q"] == pytest.approx(np.quantile(x, q))


def test_along_against_brute_force(spark):
    rng = np.random.default_rng(5)
    left = [("h" if rng.random() < 0.8 else "c", int(t), i) for i, t in enumerate(rng.integers(0, 60, 200))]
    right = [("h" if rng.random() < 0.8 else "d", int(t), i, int(v)) for i, (t, v) in enumerate(zip(rng.integers(0, 60, 150), rng.integers(0, 1000, 150)))]
    ldf, rdf = spark.createDataFrame(left, "k string, t long, id long"), spark.createDataFrame(right, "k string, rt long, rid long, v long")
    picks = {"b": ("last", F.struct("rt", "rid")), "f": ("first", F.struct("rt", "rid")), "m": ("max", F.col("v"))}
    for inclusive in (True, False):
        got = {r["id"]: r for r in along(ldf, rdf, ["k"], "t", "rt", picks, tie="rid", right_first=inclusive).collect()}
        assert len(got) == len(left)
        for k, t, i in left:
            mine = [r for r in right if r[0] == k]
            before = [r for r in mine if (r[1] <= t if inclusive else r[1] < t)]
            after = [r for r in mine if (r[1] > t if inclusive else r[1] >= t)]
            b = min(before, key=lambda r: (-r[1], r[2])) if before else None
            f = min(after, key=lambda r: (r[1], r[2])) if after else None
            assert (got[i]["b"] and tuple(got[i]["b"])) == (b and (b[1], b[2]))
            assert (got[i]["f"] and tuple(got[i]["f"])) == (f and (f[1], f[2]))
            assert got[i]["m"] == (max(r[3] for r in before) if before else None)


def test_asof_keeps_null_values(spark):
    left = spark.createDataFrame([("a", 5)], "k string, t long")
    right = spark.createDataFrame([("a", 1, "X"), ("a", 4, None)], "k string, rt long, c string")
    assert asof_backward(left, right, "k", "t", "rt", ["c"]).first()["c"] is None


def test_sustained_and_mask(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([False, True, True, False, True])], "equipment_id string, win long, over boolean")
    assert values(S.sustained_k(df, "over", 2), "confirmed", "win") == [False, False, True, False, False]
    assert values(S.sustained_k(df, "over", 1), "confirmed", "win") == [False, True, True, False, True]
    raw = frame(spark, [1, 2000, 1, 1, 1]).withColumnsRenamed({"k": "equipment_id", "pos": "win"})
    assert values(S.transition_mask(raw, "x", 1000, 2), "masked", "win") == [False, True, True, True, False]
    assert values(S.transition_mask(raw, "x", 0, 2), "masked", "win") == [False] * 5


def test_windows_and_features(spark):
    assert Wn.window_starts(30, 12, 6) == [0, 6, 12, 18] and Wn.window_starts(11, 12, 6) == []
    df = spark.createDataFrame([("e", "p", i, 2.0 * i, 5.0, float(i % 2), 1.0) for i in range(4)],
                               "equipment_id string, process_type string, tick long, temperature double, pressure double, rf_power double, gas_flow double")
    r = Wn.window_features(df, "tick", 4, 4).first()
    assert (r["mean_temperature"], r["min_temperature"], r["max_temperature"]) == (3, 0, 6)
    assert r["std_temperature"] == pytest.approx(5 ** 0.5) and r["slope_temperature"] == pytest.approx(2) and r["dstd_temperature"] == pytest.approx(0)
    assert r["corr_temperature__pressure"] == 0.0
    long = Wn.sliding_windows(df.select("equipment_id", "tick"), "tick", 3, 2)
    assert long.count() == 3
    with pytest.raises(ValueError):
        Wn.check_window(0, 1)


def test_transitions_and_confirmation(spark):
    rows = [("e", "m", i, f"2024-01-01 00:00:0{i}", c) for i, c in enumerate([None, "A", "A", "B", None])]
    df = spark.createDataFrame(rows, "equipment_id string, metric string, pos long, ts string, code string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [(r["code"], r["raised_at"].second, r["cleared_at"].second) for r in alarm_transitions(df, ["equipment_id", "metric"], "pos", "ts", "code").orderBy("raised_at").collect()]
    assert got == [("A", 1, 3), ("B", 3, 4)]
    c = spark.createDataFrame([("e", i, v) for i, v in enumerate([None, "A", "A", "B", "B"])], "k string, pos long, code string")
    assert values(confirm_two_ticks(c, ["k"], "pos", "code"), "confirmed") == [None, None, "A", None, "B"]
