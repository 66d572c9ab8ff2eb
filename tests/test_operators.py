"""Literal cases of the relational, text, evaluation and retrieval operators."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabsight import constants as K
from fabsight.functions import alarms as FA, dates as FD, text as X
from fabsight.operators import conversations as C, evaluate as E, lexical as L, maintenance as M, neighbors as NB, notifications as N, retrieval as R, rules, scoring, serving as Sv, telemetry as T
from fabsight.plans import metric as ME
from fabsight.sources import tables as S


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("r")).first()["r"]


def test_time(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, FD.date_bin(ts("2024-01-01 00:29:59"), 1800).cast("string")) == "2024-01-01 00:00:00"
    assert one(spark, FD.date_bin(ts("2024-01-01 00:30:00"), 1800).cast("string")) == "2024-01-01 00:30:00"
    assert str(one(spark, FD.local_date(ts("2024-01-01 20:00:00")))) == "2024-01-02"
    assert one(spark, FD.iso_time(F.lit("nonsense"))) is None
    with pytest.raises(ValueError):
        T.half_open_range("t", "2024-01-02", "2024-01-01")


def test_text(spark):
    raw = "A\r\nB​C  D \t\nco-\noperate é\n\n\n\nend\x07 "
    clean = one(spark, X.normalize_text(F.col("t")), t=raw)
    assert clean == "A\nBC D\ncooperate é\n\nend"
    assert one(spark, X.normalize_text(F.col("t")), t=clean) == clean
    assert one(spark, X.tokenize_bigram(F.col("t")), t="가나 ERR-402 다") == ["err-402", "가나", "나다"]
    title = lambda t, e: one(spark, X.derive_title(F.col("t"), F.lit(e)), t=t)
    assert title("EQP-A01: status?", "EQP-A01") == "status?" and title("EQP-A011 status?", "EQP-A01") == "EQP-A011 status?"
    assert title("x" * 40, "EQP-A01") == "x" * 30 + "…" and title("ask\n---\nscaffold", "") == "ask"
    assert title(" \n ", "EQP-A01") == "새 대화" and title("EQP-A01", "EQP-A01") == "새 대화"
    assert [one(spark, X.classify_intent(F.col("t")), t=t) for t in ("안녕하세요", "안녕 상태", "고마워 보여줘", "", "hi", "this")] == [
        "direct", "diagnostic", "diagnostic", "diagnostic", "direct", "diagnostic"]
    assert one(spark, X.mentioned_days(F.col("t")), t="2주 그리고 지난달 12시간") == pytest.approx([14, 0.5, 30])
    assert one(spark, X.within_data_window(F.col("t"), F.lit(3.0)), t="최근 5일") is False
    assert one(spark, X.within_data_window(F.col("t"), F.lit(0.0)), t="수리 5년") is True
    assert one(spark, X.format_value(F.lit(1.5))) == "1.5" and one(spark, X.format_value(F.lit(2.0))) == "2"
    assert one(spark, X.collect_citations(F.col("t")), t='MAN-X-1 MAN-X-1 "timestamp": "b" "timestamp": "c"') == ["MAN-X-1", "telemetry@c"]
    assert one(spark, FA.alarm_message(F.lit("E"), F.lit("ZZZ"), "en")) == "E ZZZ alarm raised"
    assert one(spark, FA.checklist_items(F.lit("ZZZ"), "en")) == K.CHECKLIST_TAIL["en"]
    assert one(spark, FA.checklist_items(F.lit(None).cast("string"))) == []


def test_rules_priority_and_cooling(spark):
    row = spark.createDataFrame([("e", "Etching", 0, 61.0, 39.0, 2.79, 606.0), ("f", None, 0, 60.0, 42.0, 2.79, 606.0)],
                                "equipment_id string, process_type string, tick long, temperature double, pressure double, rf_power double, gas_flow double")
    profiles = {k: {c: (*v[:5], 0.0) for c, v in p.items()} for k, p in K.PROFILES.items()}
    got = {r["equipment_id"]: r for r in rules.judge(row, profiles, "Etching").collect()}
    assert (got["e"]["alarm_code"], got["e"]["alarm_temperature"], got["e"]["alarm_pressure"]) == ("ERR-402", "ERR-402", None)
    assert got["f"]["alarm_code"] is None


def test_pages(spark):
    df = spark.range(23).select("id", F.timestamp_seconds(F.col("id")).alias("ts"))
    rows, info = N.offset_page(df, [F.asc("id")], 9, 10)
    assert rows.count() == 3 and info["page"] == 3 and not info["has_more"]
    page = N.keyset_page(df, "ts", "id", 5).collect()
    assert [r["id"] for r in page if not r["overflow"]] == [22, 21, 20, 19, 18] and any(r["overflow"] for r in page)
    assert N.line_scope(spark.createDataFrame([("L",)], "line_name string"), []).count() == 0


def test_representative_alarm_in_bucket(spark):
    rows = [("e", i, f"2024-01-01 00:00:0{i}", 1.0, 1.0, 1.0, 1.0, c) for i, c in enumerate([None, "WRN-501", None])]
    df = spark.createDataFrame(rows, "equipment_id string, log_id long, timestamp string, temperature double, pressure double, rf_power double, gas_flow double, alarm_code string")
    assert T.sensor_logs_bucketed(df.withColumn("timestamp", F.col("timestamp").cast("timestamp")), "2024-01-01", 60).first()["alarm_code"] == "WRN-501"


def test_keyed_writes_are_idempotent(spark, tmp_path):
    src = spark.createDataFrame([(1, None, "a"), (1, None, "a2"), (2, "x", "b")], "k long, m string, v string")
    path = str(tmp_path / "t")
    spark.createDataFrame([], src.schema).write.parquet(path)
    assert S.insert_if_absent(spark.read.parquet(path), src, ["k", "m"], path) == 2
    assert S.insert_if_absent(spark.read.parquet(path), src, ["k", "m"], path) == 0
    base = spark.createDataFrame([(1, "old"), (3, "keep")], "k long, v string")
    once = S.upsert_by_key(base, spark.createDataFrame([(1, "new")], "k long, v string"), ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "new"), (3, "keep")]
    assert S.purge_except(base.withColumnRenamed("k", "doc_id"), base.where("k=9").select(F.col("k").alias("doc_id"))).count() == 2


def test_detection_evaluation(spark):
    ev = spark.createDataFrame([(1, "e", "acute", 100, 200)], "event_id long, equipment_id string, kind string, start_tick long, end_tick long")
    det = spark.createDataFrame([("e", 170), ("e", 250), ("e", 600)], "equipment_id string, tick long")
    assert E.events_detections_range(ev, det, 60).first()["detected"] is False
    assert E.events_detections_range(ev, det, {"_default": 80}).first()["delay"] == 70
    n = spark.createDataFrame([("e", 17280)], "equipment_id string, n_ticks long")
    assert tuple(E.false_alarms(ev, det, n).first()) == (2, 2.0)
    b = spark.createDataFrame([("e", t) for t in (0, 5, 359, 360)], "equipment_id string, tick long")
    assert sorted(r["tick"] for r in E.bucket_dedup(b, 360).collect()) == [0, 360]
    ap = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "score double, label long")
    assert E.average_precision(ap).first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert E.average_precision(ap.withColumn("label", F.lit(1))).first()[0] is None


def test_operating_point(spark):
    pts = spark.createDataFrame([(0, .5, .9, None), (1, .8, 1.0, 50.0), (2, .9, 1.0, 40.0), (3, 2.0, 1.0, 1.0)],
                                "point int, false_alarms_dedup double, recall double, delay_p90 double")
    assert E.operating_point(pts, 1.0).first()["point"] == 2 and E.operating_point(pts, 0.1).first()["point"] == 0
    assert E.operating_point(pts.limit(0), 1.0).count() == 0


def test_threshold_sweep_against_each_threshold(spark):
    draw = random.Random(3)
    events = [(i, f"e{i % 3}", "acute", at := draw.randrange(0, 900), at + draw.choice([0, 5, 40, 300])) for i in range(40)]  # some overlap
    scores = [(f"e{i % 4}", f"P{i % 4 % 2}", t, round(draw.random() * draw.choice([1, 3]), 1)) for i in range(4) for t in range(0, 1000, 3)]
    limits = {"P0": [0.2, 0.9, 1.5, 2.5, 9.0], "P1": [0.1, 0.9, 0.9, 2.9, 8.0]}
    got = {r.point: r for r in E.threshold_sweep(
        spark.createDataFrame(events, "event_id long, equipment_id string, kind string, start_tick long, end_tick long"),
        spark.createDataFrame(scores, "equipment_id string, process_type string, tick long, score double"),
        spark.createDataFrame(list(limits.items()), "process_type string, limits array<double>"), 5, dedup_ticks=50).collect()}
    for i in range(5):
        fired = [(e, t) for e, p, t, s in scores if s > limits[p][i] + 1e-9]
        first = [min((t - a for e2, t in fired if e2 == e and a <= t <= b), default=None) for _, e, _, a, b in events]
        found = [d for d in first if d is not None]
        alarms = {(e, t // 50) for e, t in fired if not any(e == e2 and a <= t <= b for _, e2, _, a, b in events)}
        assert got[i].recall == pytest.approx(len(found) / 40) and got[i].false_alarms_dedup == len(alarms)
        assert got[i].delay_mean == (pytest.approx(sum(found) / len(found)) if found else None)
        assert got[i].delay_p90 == (pytest.approx(float(np.quantile(found, 0.9))) if found else None)


def test_shadow_against_rule(spark):
    def spans(rows):
        return spark.createDataFrame([(i, "e", a, b) for i, (a, b) in enumerate(rows)], "alarm_id long, equipment_id string, a long, b long").select(
            "alarm_id", "equipment_id", F.timestamp_seconds("a").alias("raised_at"), F.timestamp_seconds("b").alias("cleared_at"))
    r = E.shadow_vs_rule(spans([(1, 3), (10, 12)]), spans([(3, 4), (20, 21)]), F.timestamp_seconds(F.lit(100))).first()
    assert (r["detector_only"], r["overlapping"], r["rule_only"]) == (1, 1, 1)


def test_clamp(spark):
    assert [one(spark, scoring.clamp_limit(F.lit(o), F.lit(1.0))) for o in (3.0, 0.1, 1.0)] == [1.5, 0.5, 1.0]


def hits(spark, rows):
    return spark.createDataFrame([("q", c, float(s)) for c, s in rows], "query_id string, chunk_id string, score double")


def test_fusion(spark):
    d, s = hits(spark, [("a", .9), ("b", .1)]), hits(spark, [("b", 7), ("c", 3)])
    got = [(r["chunk_id"], r["score"]) for r in R.convex_fuse(d, s, 0.5, 3).orderBy("rank").collect()]
    assert [g[0] for g in got] == ["b", "a", "c"] and got[0][1] == pytest.approx(0.5 + 0.5e-6) and got[2][1] == pytest.approx(0.5e-6)
    assert [r["chunk_id"] for r in R.convex_fuse(d, s, 1.0, 3).orderBy("rank").collect()][0] == "a"
    assert [r["score"] for r in R.convex_fuse(d, hits(spark, []), 0.5, 3).orderBy("rank").collect()] == [.9, .1]
    with pytest.raises(ValueError):
        R.convex_fuse(d, s, 1.5, 3)
    assert {r["norm"] for r in R.minmax_per_query(hits(spark, [("a", 2), ("b", 2)])).collect()} == {1.0}


def plain_bm25(queries, chunks, k):
    counts = {c: Counter(t.split()) for c, t in chunks if t.split()}
    mean = sum(sum(c.values()) for c in counts.values()) / len(counts)
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log(len(chunks) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    out = {}
    for q, text in queries:
        score = {c: sum(n * (floor if idf[t] < 0 else idf[t]) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * sum(tf.values()) / mean))
                        for t, n in Counter(text.split()).items() if tf[t]) for c, tf in counts.items()}
        best = sorted((-round(s, 9), c) for c, s in score.items() if s > 0)[:k]
        out.update({(q, rank): (c, pytest.approx(-s, abs=2e-9)) for rank, (s, c) in enumerate(best, 1)})
    return out


@pytest.mark.parametrize("block", [64, 4])
def test_bm25_skips_blocks_and_finds_the_same(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(L, "BLOCK_CHUNKS", block)
    monkeypatch.setattr(L, "BLOCKS", 3)
    monkeypatch.setattr(L, "QUERIES", 4)
    monkeypatch.setattr(L, "SPAN", 5)
    draw = random.Random(8)
    # four subjects with words of their own, and a term that every chunk has
    texts = [" ".join(["every"] * draw.randint(1, 3) + [f"w{i % 4}x{draw.randint(0, 25)}" for _ in range(draw.randint(3, 20))]) for i in range(400)]
    chunks = [(f"c{i}", t) for i, t in enumerate([*texts, *texts[:9], "", "every " * 500, "one"])]
    queries = [(i, " ".join(draw.choices(texts[i].split(), k=6))) for i in range(11)] + [(50, "absent"), (51, ""), (52, "every"), (53, "one one")]
    stored = L.bm25_index(spark.createDataFrame(chunks, "chunk_id string, content string"))
    asked = spark.createDataFrame(queries, "query_id long, query string")
    want = plain_bm25(queries, chunks, 5)
    stored.write(str(tmp_path / "index"))
    for index in (stored, L.LexicalIndex.read(spark, str(tmp_path / "index"))):
        assert {(r.query_id, r.rank): (r.chunk_id, r.score) for r in L.bm25_search(asked, index, 5).collect()} == want
    # all postings are there, and every impact bounds what is under it
    assert stored.postings.select(F.sum(F.size("slots"))).first()[0] == sum(len(set(t.split())) for _, t in chunks)
    assert stored.postings.where("impact <> array_max(impacts)").count() == 0
    assert stored.postings.where("term = 'every'").count() == -(-411 // block)
    kept, all_pairs = L.surviving_blocks(L.query_weights(asked, stored), stored, 5)
    if block == 4:
        assert kept.count() < 0.5 * all_pairs.count()


def test_bm25_of_nothing(spark):
    none = spark.createDataFrame([], "chunk_id string, content string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert L.bm25_search(asked, L.bm25_index(none), 3).count() == 0
    assert L.bm25_search(asked.limit(0), L.bm25_index(spark.createDataFrame([("c", "a b")], "chunk_id string, content string")), 3).count() == 0


def test_bm25_moves_no_postings(spark, monkeypatch):
    """Tasks of several batches lay their chunks where they are; many equal texts tie by id; only the best chunks of a query move."""
    monkeypatch.setattr(L, "BLOCK_CHUNKS", 4)
    monkeypatch.setattr(L, "BLOCKS", 2)
    draw = random.Random(11)
    texts = [" ".join(["every"] * draw.randint(0, 2) + [f"w{i % 3}x{draw.randint(0, 30)}" for _ in range(draw.randint(1, 15))]) for i in range(240)]
    texts += [texts[5]] * 90
    chunks = [(f"c{i}", t) for i, t in enumerate(texts)]
    queries = [(i, texts[i]) for i in range(9)] + [(9, "every")]
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        index = L.bm25_index(spark.createDataFrame(chunks, "chunk_id string, content string"))
        found = L.bm25_search(spark.createDataFrame(queries, "query_id long, query string"), index, 5)
        assert {(r.query_id, r.rank): (r.chunk_id, r.score) for r in found.collect()} == plain_bm25(queries, chunks, 5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    assert sorted(r.place for r in index.chunks.collect()) == list(range(len(chunks)))
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#", found._jdf.queryExecution().executedPlan().toString())
    assert set(dealt) <= {"query_id"}


def unit_vectors(seed, n, d, clusters):
    """Vectors around a few centres, with repeats and a zero vector."""
    draw = np.random.default_rng(seed)
    rows = draw.standard_normal((clusters, d))[draw.integers(0, clusters, n)] + 0.05 * draw.standard_normal((n, d))
    rows[n // 2:n // 2 + 20] = rows[n // 2]
    rows[3] = 0
    return rows


@pytest.mark.parametrize("sizes", [(1_024, 4 << 20, 262_144), (16, 5_000, 7)])
def test_dense_search_against_all_pairs(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK", "SAMPLE_BYTES", "QUERIES"), sizes):
        monkeypatch.setattr(ME, name, size)
    rows = unit_vectors(1, 500, 6, 12)
    stored = spark.createDataFrame([(f"c{i:03}", [None, "x", "y", "z"][i % 4], v.tolist()) for i, v in enumerate(rows)], "chunk_id string, tag string, embedding array<double>")
    asked = spark.createDataFrame([(i, ["x", "none", None, "y"][i % 4], (rows[i] + 0.01).tolist()) for i in range(0, 90, 3)], "query_id long, tag string, embedding array<double>")
    units = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
    for tag in ("tag", None):
        got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in R.dense_search(asked, R.dense_index(stored, tag), 4, tag).collect()}
        want = {}
        for i in range(0, 90, 3):
            q = rows[i] + 0.01
            own = {"x": 1, "y": 2}.get(["x", "none", None, "y"][i % 4]) if tag else None
            cosines = [(-round(float(u @ q / np.linalg.norm(q)), 9), f"c{j:03}") for j, u in enumerate(units) if own is None or j % 4 == own]
            want.update({(i, rank): (c, pytest.approx(-s, abs=2e-9)) for rank, (s, c) in enumerate(sorted(cosines)[:4], 1)})
        assert got == want
    none = stored.limit(0)
    assert R.dense_search(asked, R.dense_index(none), 4).count() == 0 and R.dense_search(asked.limit(0), R.dense_index(stored), 4).count() == 0


def test_blocks_beyond_the_kth_distance_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(ME, "BLOCK", 32)
    rows = unit_vectors(2, 2_000, 8, 40)
    stored = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    index = ME.metric_index(stored, "vec_id", "embedding")
    asked = ME.packed(stored.where("vec_id % 50 = 0"), [F.col("vec_id").alias("query_id"), F.lit(None).cast("string").alias("grp")], "embedding", False)
    met, blocks = ME.routed_blocks(asked, index.layout, 5, True).count(), len(index.layout.keys)
    assert blocks > 40 and met < 0.2 * 40 * blocks


@pytest.mark.parametrize("block", [1_024, 8])
def test_knn_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ME, "BLOCK", block)
    line = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(30)], "vec_id long, embedding array<double>")
    whole = {r["vec_id"]: r["score"] for r in NB.knn_outlier_score(line, line, 2, exclude_self=True).collect()}
    assert whole[0] == pytest.approx(1.5) and whole[5] == pytest.approx(1.0)
    rows = unit_vectors(3, 200, 5, 6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    far = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(2))
    np.fill_diagonal(far, np.inf)
    want = dict(enumerate(np.sort(far, axis=1)[:, :3].mean(1)))
    assert {r["vec_id"]: r["score"] for r in NB.knn_outlier_score(df, df, 3, exclude_self=True).collect()} == pytest.approx(want, abs=1e-9)
    alone = df.limit(1)
    assert [r["score"] for r in NB.knn_outlier_score(alone, alone, 3, exclude_self=True).collect()] == [None]


def test_neighbours_move_no_vectors(spark, monkeypatch):
    """Queries come to the stored blocks in rounds; a task sends on the best rows of each query, and ties, whatever the number of blocks."""
    for name, size in (("BLOCK", 16), ("QUERIES", 100), ("FOUND", 500), ("TILE", 7)):
        monkeypatch.setattr(ME, name, size)
    draw = np.random.default_rng(14)
    rows = draw.standard_normal((600, 8)).astype(np.float32)
    rows[100:160] = rows[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    index, cores, seen = ME.metric_index(df, "vec_id", "embedding"), spark.sparkContext.defaultParallelism, []
    assert len(index.layout.keys) > 30 and index.rows.select(F.max(F.length("v"))).first()[0] == 4 * 8

    def finish(found):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        seen.append(found.collect())
        return found

    asked = ME.packed(df, [F.col("vec_id").alias("query_id"), F.lit(None).cast("string").alias("grp")], "embedding", False)
    got = {}
    for r in ME.nearest(asked, index, 3, True, finish).collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    assert len(seen) > 4 and max(map(len, seen)) <= 3 * cores * 140
    far = np.sqrt(((rows[:, None].astype(float) - rows[None]) ** 2).sum(2))
    for i in range(600):
        want = sorted((far[i, j], j) for j in range(600) if j != i)[:3]
        best = sorted(got[i])[:3]
        assert [j for _, j in best] == [j for _, j in want] and [d for d, _ in best] == pytest.approx([d for d, _ in want], abs=1e-9)


def test_left_out_groups_and_first_citations(spark):
    groups = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "equipment_id string")
    windows = spark.createDataFrame([("a",)] * 3 + [("b",)], "equipment_id string")
    assert {tuple(r) for r in Sv.left_out(groups, windows, "equipment_id", 2).collect()} == {("b", 1, "fewer than 2"), ("c", 0, "no window")}
    hits = spark.createDataFrame([(1, 2, "later"), (1, 0, "  first one "), (2, 5, "x" * 300), (3, 1, None)], "doc_id long, turn int, text string")
    assert {tuple(r) for r in R.dedup_citations(hits, "doc_id", "turn", "text").collect()} == {(1, "first one"), (2, "x" * 240), (3, None)}


def test_squared_silhouette(spark):
    rows = unit_vectors(4, 60, 3, 3)
    labels = [i % 3 if i else 9 for i in range(60)]
    df = spark.createDataFrame([(i, lab, v.tolist()) for i, (lab, v) in enumerate(zip(labels, rows))], "vec_id long, label int, embedding array<double>")
    far, labels, points = ((rows[:, None] - rows[None]) ** 2).sum(2), np.array(labels), []
    for i in range(60):
        mine = labels == labels[i]
        b = min(far[i, labels == o].mean() for o in set(labels) - {labels[i]})
        a = far[i, mine].sum() / max(mine.sum() - 1, 1)
        points.append((b - a) / max(a, b) if mine.sum() > 1 else 0.0)
    assert NB.squared_silhouette(df, "label").first()[0] == pytest.approx(np.mean(points))


def test_passages_and_metrics(spark):
    docs = spark.createDataFrame([(1, "zero one two three four five six seven"), (2, "one two three four")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three four five six")], "item_id long, text string")
    assert [tuple(r) for r in R.passage_matches(items, docs).select("item_id", "doc_id").collect()] == [(7, 1)]
    got = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate("zxw")], "query_id string, doc_id string, rank int")
    exp = spark.createDataFrame([("q", "x"), ("q", "y")], "query_id string, doc_id string")
    assert tuple(R.retrieval_metrics(got, exp, 3).select("hit", "recall", "rr").first()) == (1.0, 0.5, 0.5)
    assert tuple(R.macro_means(R.retrieval_metrics(got, exp.limit(0), 3)).first()) == (0, 0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        R.retrieval_metrics(got, exp, 0)


def test_pairwise_and_bootstrap(spark):
    v = spark.createDataFrame([("B", "A"), ("A", "B"), ("B", "B"), ("tie", "A")], "winner1 string, winner2 string")
    s = C.pairwise_scores(v)
    assert sorted(r["after_score"] for r in s.collect()) == [0.0, 0.5, 0.75, 1.0]
    ci = C.bootstrap_ci(s, "after_score", 500).first()
    assert ci["low"] <= ci["mean"] <= ci["high"] and ci["mean"] == pytest.approx(0.5625)
    assert C.bootstrap_ci(s, "after_score", 500).first() == ci


def test_partial_update_and_scoped_delete(spark):
    df = spark.createDataFrame([(1, "a", 1.0)], "id long, role string, balance double")
    patch = spark.createDataFrame([(1, "z", None, ["balance"])], "id long, role string, balance double, given array<string>")
    assert tuple(M.partial_update(df, patch, "id", ["role", "balance"]).first()) == (1, "a", None)


def test_shared_folder_is_required_beyond_one_machine():
    from fabsight.session import shared_folder
    assert shared_folder("local[4]", None, "/w") == "/w/checkpoints"
    assert shared_folder("spark://host:7077", "hdfs:///c", "/w") == "hdfs:///c"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(master, None, "/w")


def test_range_partitions_follow_the_input(spark):
    from fabsight import session
    assert session.partitions_for(2 * 10**12) == pytest.approx(2 * session.partitions_for(10**12), abs=1)
    small = spark.range(100)
    assert session.range_partitions(small) == session.shuffle_partitions(spark)
    assert session.range_partitions(spark.createDataFrame([(1,)], "a int")) == session.shuffle_partitions(spark)


@pytest.mark.parametrize("most", [0, 1, 40, 41, 99, 100, 500])
def test_audit_retention_keeps_the_newest(spark, most):
    draw = random.Random(most)
    rows = [(i, f"2024-01-{draw.choice([1, 2, 2, 2, 2, 5, 9]):02} {draw.randrange(24):02}:00:00") for i in range(100)] + [(100, "2023-11-01 00:00:00")]
    audit = spark.createDataFrame(rows, "id long, at string").select("id", F.col("at").cast("timestamp").alias("created_at"))
    want = [i for _, i in sorted(((at, i) for i, at in rows), reverse=True) if i < 100][:most]
    now = F.lit("2024-01-20").cast("timestamp")
    assert sorted(r.id for r in M.audit_retention(audit, now, 30, most).collect()) == sorted(want)


def test_carry_over_many_blocks(spark, monkeypatch):
    from fabsight.plans import series
    monkeypatch.setattr(series, "BLOCK_PIECES", 3)
    rows = [("a", i, float((i * 7919) % 13)) for i in range(200)] + [("b", i, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, p long, x double")
    got = {(r.k, r.p): r.y for r in series.ewma(df, ["k"], "p", "x", 0.2, "y", size=4).collect()}
    for key in "ab":
        y = None
        for k, p, x in rows:
            if k == key:
                y = x if y is None else 0.8 * y + 0.2 * x
                assert got[(k, p)] == pytest.approx(y)


def test_passages_of_different_length(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "xone two threex"), (3, "two three"), (4, None)], "doc_id long, text string")
    passages = spark.createDataFrame([(10, "one two three"), (11, "two three four five six"), (12, "not in here at all")], "item_id long, text string")
    assert sorted(map(tuple, R.passage_matches(passages, docs).collect())) == [(10, 1), (10, 2), (11, 1)]


def test_tree_samples_are_the_smallest_hashes_of_all_rows(spark):
    from fabsight.operators import detectors as D
    rows = [("P", i * 7919 + 1, float(i)) for i in range(500)]
    base = spark.createDataFrame(rows, "process_type string, _id long, x double")
    one, many = ({(r.tree, r["_id"]) for r in D.tree_samples(base.repartition(n), ["x"], 5, 16).collect()} for n in (1, 7))
    assert one == many and len(one) == 80 and len({i for _, i in one}) > 40


def test_chunk_rows_have_their_tags_and_text(spark, sf):
    """A row of every chunk, with its document's type and alarm where it has them, and the text itself."""
    from fabsight.reports import retrieval as Q
    from fabsight.views import Views
    v = Views(spark, sf)
    rows = Q.build_chunk_rows(v).collect()
    assert {(r["chunk_id"], r["content"]) for r in rows} == {(r["chunk_id"], r["content"]) for r in Q.chunks(v).collect()}
    for r in rows:
        doc = int(r["doc_id"])
        assert (r["equipment_type"], r["alarm_code"], r["n"]) == (["P0", "P1", None][doc % 3], f"ERR-40{doc % 4}" if doc % 4 else None, len(r["content"]))


def test_words_are_those_of_the_normalized_text(spark):
    """Chunks are cut in Python; their words are what the column expressions give."""
    draw = random.Random(11)
    signs = ["a", "B", "é", "é", "ㄱ", "가", "-", "-\n", "-\r\n", "\r", "\n", "\n\n\n\n", " ", "\t", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ",
             " ", " ", " ", " ", " ", " ", "　", "​", "‍", "﻿", "\xad", "\x00", "\x7f", "\x9f", "1", ".", "İ", "Σ"]
    texts = ["".join(draw.choices(signs, k=draw.randrange(0, 40))) for _ in range(1_500)] + [None, "", " \n "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    plain = df.select("doc_id", X.tokenize_whitespace(X.normalize_text(F.col("text"))).alias("t")).collect()
    want = {(r["doc_id"], i // 4, f"{r['doc_id']}#{i // 4}", " ".join(r["t"][i:i + 4])) for r in plain if r["t"] for i in range(0, len(r["t"]), 4)}
    cut = R.chunk_by_tokens(df, 4)
    assert "ArrowEvalPython" not in cut._jdf.queryExecution().executedPlan().toString() and cut.columns == ["doc_id", "chunk_index", "content", "chunk_id"]
    assert {(r["doc_id"], r["chunk_index"], r["chunk_id"], r["content"]) for r in cut.collect()} == want and len(want) > 2_000


def test_hashed_vectors_are_those_of_the_library(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array
    draw = random.Random(12)
    known = ["".join(draw.choices("abcÀéß가😀Ω1-", k=draw.randrange(1, 9))) for _ in range(300)]
    gaps = [" ", "  ", "\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2005", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\u200b", "\x00"]
    rows = [(i, draw.choice(["", " "]) + "".join(w + draw.choice(gaps) for w in draw.choices(known, k=draw.randrange(0, 30)))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, content string").repartition(3)
    tokens = df.withColumn("_t", X.tokenize_whitespace(F.lower("content")))
    stages = [HashingTF(numFeatures=16, inputCol="_t", outputCol="_tf"), IDF(inputCol="_tf", outputCol="_w"), Normalizer(inputCol="_w", outputCol="_v")]
    plain = Pipeline(stages=stages).fit(tokens).transform(tokens).select("id", vector_to_array("_v", "float32").alias("v")).collect()
    got = {r["id"]: r["embedding"] for r in R.hashed_vectors(df, 16).collect()}
    assert len(got) == 400 and all(got[r["id"]] == pytest.approx(r["v"], abs=1e-7) for r in plain)


def test_ingest_cuts_the_listed_documents_once(spark, monkeypatch):
    """Weights, listed documents and vectors take the chunks from where they are written."""
    cut, plain = [], R.chunk_by_tokens
    monkeypatch.setattr(R, "chunk_by_tokens", lambda *a, **o: cut.append(plain(*a, **o)) or cut[-1])
    docs = spark.createDataFrame([(i, "Das ist ein Text " * (i % 5)) for i in range(40)], "doc_id long, text string")
    stored = R.hashed_vectors(R.build_chunk_rows(plain(docs, 16)), 8)
    listed = docs.where("doc_id % 2 = 0").select("doc_id", F.lit("P1").alias("equipment_type"))
    out = R.ingest_corpus(stored, docs, listed, 4, 8)
    assert "Scan parquet" in out._jdf.queryExecution().executedPlan().toString() and len(cut) == 1
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.collect()
    assert sorted((r["doc_id"], r["chunk_index"]) for r in rows) == sorted((str(i), c) for i in range(0, 40, 2) for c in range(i % 5))
    assert all(r["equipment_type"] == "P1" and len(r["embedding"]) == 8 for r in rows)


@pytest.mark.parametrize("common", [0, 6, 1_000])
def test_postings_of_chunks_stay_in_their_blocks(spark, monkeypatch, common):
    """Terms sort by their text with the count; statistics of common terms come to the blocks, others meet theirs; no posting of a common term moves."""
    import hashlib
    monkeypatch.setattr(L, "COMMON", common)
    monkeypatch.setattr(L, "SAID_BLOCKS", 2)
    draw = random.Random(13)
    known = ["a", "a-b", "a:b", "é", "가", "z", "Z", "10", "1"]
    rows = [(f"c{i}", " ".join(draw.choices(known, weights=range(9, 0, -1), k=draw.randrange(0, 12)) + [f"own{i}"] * (i % 7 == 0))) for i in range(300)]
    index = L.bm25_index(spark.createDataFrame(rows, "chunk_id string, content string").repartition(3))
    out = L.chunk_postings(index)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in text.lower() and "collect_list" not in text
    counts = {c: Counter(t.split()) for c, t in rows if t.split()}
    df = Counter(w for t in counts.values() for w in t)
    idf = {r["term"]: r["idf"] for r in index.terms.collect()}
    mean = sum(sum(t.values()) for t in counts.values()) / len(counts)
    got = {r["chunk_id"]: r for r in out.collect()}
    assert set(got) == set(counts)
    for c, t in counts.items():
        r, n = got[c], sum(t.values())
        assert (r["length"], r["terms"], r["df"]) == (n, len(t), sum(df[w] for w in t))
        assert r["postings"] == hashlib.md5(" ".join(sorted(f"{w}:{k}" for w, k in t.items())).encode()).hexdigest()
        assert r["idf"] == pytest.approx(sum(idf[w] for w in t)) and r["impact"] == pytest.approx(max(k * 2.5 / (k + 1.5 * (.25 + .75 * n / mean)) for k in t.values()))
