"""SQL table functions against the Python functions of the same name."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fabsight import constants as K, tools
from fabsight.operators import lexical as L, retrieval as R

START = datetime(2024, 1, 1)
QUESTIONS = ["pump valve pressure", "why ERR-401 on the pump", "wrn-702 or err-401 gauge", "알람 코드는 몇 개 pump", "nothing of the kind", "seal"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    words = ["pump", "valve", "gauge", "seal", "ERR-401", "WRN-702", "coil", "pressure", "filter"]
    chunks = [(f"d{i // 3}#{i % 3}", f"d{i // 3}", " ".join(rng.choices(words, k=12)), "etch" if i % 4 else "coat") for i in range(60)]
    encoded = lambda text: [float(text.lower().count(c)) for c in "aeioulprsv"]
    manuals = spark.createDataFrame([(*c, encoded(c[2])) for c in chunks], "chunk_id string, doc_id string, content string, tag string, embedding array<double>")
    master = spark.createDataFrame([(f"EQP-{i:03}", "L1" if i % 2 else "L2", "etch", "hall") for i in range(8)], "equipment_id string, line_name string, process_type string, location string")
    logs = [(f"EQP-{i:03}", i * 10_000 + t, START + timedelta(seconds=5 * t), 20.0 + i + t % 7, 1.0 * t, 0.5, 0.25 * (t % 3), "ERR-401" if t % 50 == 3 else "WRN-702" if t % 40 == 3 else None)
            for i in range(8) for t in range(600)]
    telemetry = spark.createDataFrame(logs, "equipment_id string, log_id long, timestamp timestamp, temperature double, pressure double, rf_power double, gas_flow double, alarm_code string")
    repairs = spark.createDataFrame([(i, f"EQP-{i % 5:03}", START + timedelta(hours=i % 11), i % 4, [None, "ERR-401", "WRN-702"][i % 3]) for i in range(60)],
                                    "id long, equipment_id string, repaired_at timestamp, repaired_by long, alarm_code_before string")
    users = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, name string")
    alarms = spark.createDataFrame([(f"EQP-{i % 3:03}", ["ERR-401", "WRN-702"][i % 2], START + timedelta(hours=i)) for i in range(30)], "equipment_id string, alarm_code string, raised_at timestamp")
    tools.register(spark, telemetry, alarms, master, repairs, users, manuals, L.bm25_index(manuals))
    return dict(manuals=manuals, master=master, telemetry=telemetry, repairs=repairs, users=users, alarms=alarms, encoded=encoded)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("tag", [None, "coat", "unknown"])
def test_search_manuals(spark, tables, tag):
    manuals, encoded = tables["manuals"], tables["encoded"]
    asked = spark.createDataFrame([(i, q, tag, encoded(q)) for i, q in enumerate(QUESTIONS)], "query_id long, query string, tag string, embedding array<double>")
    got = tools.search_manuals(asked, manuals, R.dense_index(manuals, "tag"), L.bm25_index(manuals), 3, tag="tag").collect()
    assert len({r["query_id"] for r in got}) > 3
    for i, q in enumerate(QUESTIONS):
        kind = "NULL" if tag is None else f"'{tag}'"
        said = spark.sql(f"SELECT * FROM search_manuals('{q}', array({', '.join(map(str, encoded(q)))}), 3, {kind})").collect()
        mine = sorted((r["rank"], r["chunk_id"], r["doc_id"]) for r in got if r["query_id"] == i)
        assert sorted((r["rank"], r["chunk_id"], r["doc_id"]) for r in said) == mine
        assert len(mine) <= (6 if "몇" in q else 3)
        content = {r["chunk_id"]: r["content"] for r in manuals.collect()}
        codes = [c for c in ("ERR-401", "WRN-702") if c in q.upper()]
        assert all(not codes or any(c in content[m[1]] for c in codes) for m in mine)


def test_search_manuals_reorders_by_given_relevance(spark, tables):
    manuals, encoded = tables["manuals"], tables["encoded"]
    asked = spark.createDataFrame([(0, "pump valve", encoded("pump valve"))], "query_id long, query string, embedding array<double>")
    index, terms = R.dense_index(manuals), L.bm25_index(manuals)
    pool = tools.search_manuals(asked, manuals, index, terms, K.RERANK_POOL).orderBy("rank").collect()
    last = pool[-1]["chunk_id"]
    scores = spark.createDataFrame([(0, last, 9.0)], "query_id long, chunk_id string, score double")
    best = tools.search_manuals(asked, manuals, index, terms, 2, relevance=scores).orderBy("rank").collect()
    assert [r["chunk_id"] for r in best] == [last, pool[0]["chunk_id"]]


@pytest.mark.parametrize("minutes,equipment,line", [(4, None, "L1"), (45, None, "L1"), (45, None, None), (30, "EQP-002", None), (45, "EQP-002", "L1"), (45, "nowhere", None)])
def test_get_sensor_logs(spark, tables, minutes, equipment, line):
    end = START + timedelta(minutes=minutes)
    mine = tools.get_sensor_logs(tables["telemetry"], tables["master"], START, end, equipment, line if equipment is None else None, limit=K.SENSOR_ROW_BUDGET)
    at = "bucket" if "bucket" in mine.columns else "timestamp"
    text = lambda x: "NULL" if x is None else f"'{x}'"
    said = spark.sql(f"SELECT * FROM get_sensor_logs(TIMESTAMP '{START}', TIMESTAMP '{end}', {text(equipment)}, {text(line)})")
    rounded = [F.round(c, 6) for c in K.CHANNELS]
    assert rows(said, "equipment_id", "at", *rounded, "alarm_code") == rows(mine, "equipment_id", at, *rounded, "alarm_code")


def test_maintenance_and_alarms(spark, tables):
    entries = F.array_sort(F.map_entries("alarm_code_counts")).cast("string")
    for e in (None, "EQP-001", "nowhere"):
        arg = "NULL" if e is None else f"'{e}'"
        cols = ["equipment_id", "repair_count", "last_repaired_at", entries]
        assert rows(spark.sql(f"SELECT * FROM get_maintenance_summary({arg})"), *cols) == rows(tools.get_maintenance_summary(tables["repairs"], e, K.SUMMARY_REPAIRS), *cols)
        names = ["id", "equipment_id", "repaired_at", "alarm_code_before", "repaired_by_name"]
        since = START + timedelta(hours=2)
        assert rows(spark.sql(f"SELECT * FROM get_repair_history({arg}, TIMESTAMP '{since}', NULL, 4)"), *names) == rows(
            tools.get_repair_history(tables["repairs"], tables["users"], e, since, None, 4), *names)
        end = START + timedelta(hours=20)
        said = spark.sql(f"SELECT * FROM get_alarm_history({arg}, TIMESTAMP '{since}', TIMESTAMP '{end}', 'ERR-401')")
        assert rows(said, *said.columns) == rows(tools.get_alarm_history(tables["alarms"], since, end, e, "ERR-401"), *said.columns)
    assert spark.sql("SELECT * FROM get_maintenance_summary('nowhere')").first()["repair_count"] == 0
    assert rows(spark.sql("SELECT * FROM get_equipment_metadata(NULL, 'L1')"), "equipment_id") == rows(tools.get_equipment_metadata(tables["master"], None, "L1"), "equipment_id")


@pytest.mark.parametrize("zero_question", [False, True])
def test_search_manuals_with_vectors_of_zeros(spark, tables, zero_question):
    encoded = tables["encoded"]
    blank = [(f"z{i}#0", f"z{i}", "|" if i else "êèè êèè", "coat", [0.0] * 10) for i in range(2)]
    manuals = tables["manuals"].unionByName(spark.createDataFrame(blank, tables["manuals"].schema))
    terms = L.bm25_index(manuals)
    tools.register(spark, tables["telemetry"], tables["alarms"], tables["master"], tables["repairs"], tables["users"], manuals, terms)
    q = "pump valve êèè"
    v = [0.0] * 10 if zero_question else encoded(q)
    asked = spark.createDataFrame([(0, q, "coat", v)], "query_id long, query string, tag string, embedding array<double>")
    mine = rows(tools.search_manuals(asked, manuals, R.dense_index(manuals, "tag"), terms, 5, tag="tag"), "rank", "chunk_id", "doc_id")
    said = spark.sql(f"SELECT * FROM search_manuals('{q}', array({', '.join(f'{x}D' for x in v)}), 5, 'coat')")
    assert mine and rows(said, "rank", "chunk_id", "doc_id") == mine
