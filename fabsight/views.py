"""Domain views over the given tables, as DataFrames and as SQL with the same meaning.

The given tables hold no telemetry; line items in date order play the readings, the event stream plays
the alarm feed, suppliers the equipment master, orders the repair log, customers the users.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fabsight.constants import CHANNELS, INTERVAL_SECONDS
from fabsight.operators.alarms import alarm_transitions
from fabsight.operators.notifications import notification_groups
from fabsight.operators.rules import judge
from fabsight.functions.alarms import alarm_message, severity
from fabsight.plans.series import number_rows
from fabsight.session import durable, prepare
from fabsight.sources.tables import read_table

ORIGIN = "2024-01-01 00:00:00"

# process -> channel -> (mu0, sigma, band_half, lsl, usl, drift per tick of a 1000-tick cycle), for the line-item channels
TEST_PROFILES = {
    "P0": {
        "temperature": (25.5, 10.0, 23.6, -100.0, 74.0, 0.0012),
        "pressure": (53000.0, 21000.0, 50000.0, -200000.0, 160000.0, 0.0),
        "rf_power": (0.05, 0.0205, 0.06, -0.5, 0.6, 0.0),
        "gas_flow": (0.04, 0.0165, 0.05, -0.5, 0.6, 0.0),
    },
    "P1": {
        "temperature": (25.5, 10.0, 24.0, -100.0, 75.0, 0.0016),
        "pressure": (53000.0, 21000.0, 51000.0, -200000.0, 160000.0, 0.0),
        "rf_power": (0.05, 0.0205, 0.06, -0.5, 0.6, 0.0),
        "gas_flow": (0.04, 0.0165, 0.05, -0.5, 0.6, 0.0),
    },
}

READING_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax")


def equipment_name(number: Column) -> Column:
    text = number.cast("string")
    return F.concat(F.lit("EQP-"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))


def utc(column: str) -> Column:
    return F.col(column).cast("timestamp")


class Views:
    """Lazily built views of one data folder; ranked series are written once per session and reused."""

    _known: dict[tuple[str, str], "Views"] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._stored = spark, folder, {}

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> "Views":
        prepare(spark)
        key = (spark.sparkContext.applicationId, folder)
        if key not in cls._known:
            cls._known[key] = cls(spark, folder)
        return cls._known[key]

    def stored(self, name: str, build, codec: str | None = None) -> DataFrame:
        """Derived table written once per session to the checkpoint folder."""
        if name not in self._stored:
            self._stored[name] = durable(build(), codec=codec)
        return self._stored[name]

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    # ---- readings ------------------------------------------------------------------------------
    @cached_property
    def readings(self) -> DataFrame:
        raw = self.table("lineitem").select(
            (F.col("l_suppkey") % 20).alias("equipment_no"), "l_shipdate", "l_orderkey", "l_linenumber",
            "l_partkey", "l_quantity", "l_extendedprice",
            (F.col("l_discount") + 0.0).alias("l_discount"), (F.col("l_tax") + 0.0).alias("l_tax"))
        values = ["equipment_no", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
        ranked = number_rows(raw, ["equipment_no"], [F.col(c).asc() for c in READING_ORDER], "tick", values)
        return ranked.select(
            "equipment_no", "tick", F.col("l_quantity").alias("temperature"), F.col("l_extendedprice").alias("pressure"),
            F.col("l_discount").alias("rf_power"), F.col("l_tax").alias("gas_flow"))

    @property
    def telemetry(self) -> DataFrame:
        start = F.unix_micros(F.lit(ORIGIN).cast("timestamp"))
        base = self.readings.select(
            equipment_name(F.col("equipment_no")).alias("equipment_id"),
            (F.col("tick") * 1000 + F.col("equipment_no")).alias("log_id"), "tick",
            F.timestamp_micros(start + F.col("tick") * INTERVAL_SECONDS * 1_000_000).alias("timestamp"),
            F.when(F.col("equipment_no") % 2 == 0, "P0").otherwise("P1").alias("process_type"), *CHANNELS)
        return judge(base, TEST_PROFILES, "P0")

    @property
    def normal(self) -> DataFrame:
        return self.telemetry.where(F.col("alarm_code").isNull())

    # ---- master data ---------------------------------------------------------------------------
    @property
    def master(self) -> DataFrame:
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        return joined.select(
            equipment_name(F.col("s_suppkey")).alias("equipment_id"), F.col("s_suppkey").alias("equipment_no"),
            F.col("r_name").alias("line_name"),
            F.when(F.col("s_suppkey") % 2 == 0, "P0").otherwise("P1").alias("process_type"),
            F.col("n_name").alias("location"),
            F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("display_order"),
            F.when(F.col("s_suppkey") % 4 == 0, F.timestamp_micros(
                F.unix_micros(F.lit(ORIGIN).cast("timestamp")) + (F.col("s_suppkey") % 20) * 600_000_000)
            ).alias("alarm_cleared_at"),
            F.when(F.col("s_suppkey") % 5 == 0, F.timestamp_micros(
                F.unix_micros(F.lit(ORIGIN).cast("timestamp")) + (F.col("s_suppkey") % 20) * 300_000_000)
            ).alias("repaired_at"),
            F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal")).alias("position_x"),
            F.when(F.col("s_suppkey") % 6 == 0, F.col("s_acctbal") / 2).alias("position_y"))

    @property
    def users(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"),
            F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))

    @property
    def lines(self) -> DataFrame:
        return self.table("region").select(
            F.col("r_regionkey").alias("line_id"), F.col("r_name").alias("code"),
            F.when(F.col("r_regionkey") % 2 == 0, 10 - F.col("r_regionkey")).alias("display_order"),
            F.when(F.col("r_regionkey") == 3, "inactive").otherwise("active").alias("status"))

    @property
    def user_lines(self) -> DataFrame:
        """Each user has up to two lines; every 11th user has none."""
        nation = self.table("nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").cast("long"))
        users = self.users.where(F.col("id") % 11 != 0).join(nation, "nation")
        both = F.array_distinct(F.array(F.col("n_regionkey"), F.col("id") % 5))
        return users.select(F.col("id").alias("user_id"), F.explode(both).alias("line_id"))

    # ---- alarm feed ----------------------------------------------------------------------------
    @cached_property
    def feed(self) -> DataFrame:
        """Per (equipment, metric) code after every event, with its dense position."""
        e = self.table("events")
        code = (F.when((F.col("event_type") == "error") & (F.col("value") > 20), "ERR-402")
                .when(F.col("event_type") == "error", "ERR-401")
                .when(F.col("event_type") == "click", "WRN-701")
                .when(F.col("event_type") == "purchase", "WRN-501"))
        metric = F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), ((F.floor(F.col("user_id") / 20) % 4) + 1).cast("int"))
        raw = e.select(
            F.col("event_id"), equipment_name(F.col("user_id") % 20).alias("equipment_id"), metric.alias("metric"),
            utc("ts").alias("ts"), code.alias("alarm_code"))
        return number_rows(raw, ["equipment_id", "metric"], [F.col("ts").asc(), F.col("event_id").asc()], "pos")

    @property
    def alarms(self) -> DataFrame:
        spans = alarm_transitions(self.feed, ["equipment_id", "metric"], "pos", "ts", "alarm_code", carry=("event_id",))
        return spans.select(
            F.col("event_id").alias("alarm_id"), "equipment_id", "metric", "alarm_code",
            severity(F.col("alarm_code")).alias("severity"), "raised_at", "cleared_at")

    @property
    def notifications(self) -> DataFrame:
        groups = notification_groups(self.alarms.join(self.master.select("equipment_id", "line_name"), "equipment_id", "left"))
        return groups.select(
            F.col("source_alarm_id").alias("id"), "occurred_at", "equipment_id", "line_name", "metric", "alarm_code",
            alarm_message(F.col("equipment_id"), F.col("alarm_code"), "en").alias("message"), "bucket_start",
            "source_alarm_id")

    @property
    def reads(self) -> DataFrame:
        """User 1 read every third notification, user 2 every seventh."""
        n = self.notifications.select("id", "occurred_at")
        flags = F.array_compact(F.array(F.when(F.col("id") % 3 == 0, F.lit(1).cast("long")), F.when(F.col("id") % 7 == 0, F.lit(2).cast("long"))))
        return n.select(F.col("id").alias("notification_id"), F.explode(flags).alias("user_id"),
                        F.col("occurred_at").alias("read_at"))

    @property
    def repairs(self) -> DataFrame:
        o = self.table("orders")
        code = F.when(F.col("o_orderpriority") == "1-URGENT", "ERR-402").when(
            F.col("o_orderpriority") == "2-HIGH", "ERR-301").when(F.col("o_orderpriority") == "3-MEDIUM", "WRN-702")
        return o.select(
            F.col("o_orderkey").alias("id"), equipment_name(F.col("o_custkey") % 100).alias("equipment_id"),
            F.when(F.col("o_custkey") % 10 != 9, F.col("o_custkey")).otherwise(-F.col("o_custkey")).alias("repaired_by"),
            utc("o_orderdate").alias("repaired_at"), code.alias("alarm_code_before"))

    @property
    def work_logs(self) -> DataFrame:
        o = self.table("orders")
        kinds = F.array(*[F.lit(k) for k in ("emergency", "preventive", "repair", "inspection", "etc")])
        return o.select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"),
            F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("work_type"),
            equipment_name(F.col("o_custkey") % 100).alias("equipment_id"), utc("o_orderdate").alias("started_at"),
            F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open")
            .otherwise("progress").alias("status"),
            F.when(F.col("o_orderkey") % 13 == 0, utc("o_orderdate")).alias("deleted_at"),
            F.col("o_totalprice").alias("cost"))

    # ---- documents -----------------------------------------------------------------------------
    @property
    def sessions(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("session_id"), F.col("turn").alias("message_id"), "role",
            F.col("text").alias("content"))

    @property
    def incidents(self) -> DataFrame:
        """Labelled events on the tick axis of the readings."""
        seconds = F.unix_timestamp(utc("ts")) - F.unix_timestamp(F.lit(ORIGIN).cast("timestamp"))
        start = F.floor(seconds / 864)
        acute = F.col("event_type") == "error"
        return self.table("events").where(F.col("event_type").isin("error", "signup")).select(
            F.col("event_id"), equipment_name(F.col("user_id") % 20).alias("equipment_id"),
            F.when(acute, "acute").otherwise("drift").alias("kind"), start.alias("start_tick"),
            (start + F.when(acute, 4).otherwise(19)).alias("end_tick"))

    @property
    def detections(self) -> DataFrame:
        """Ticks with a rule alarm."""
        return self.telemetry.where(F.col("alarm_code").isNotNull()).select("equipment_id", "tick")


def _sql_judge() -> str:
    cols = []
    for ch in CHANNELS:
        def pick(i, ch=ch):
            a, b = TEST_PROFILES["P0"][ch][i], TEST_PROFILES["P1"][ch][i]
            return f"CAST({a!r} AS DOUBLE)" if a == b else f"CASE WHEN process_type='P0' THEN CAST({a!r} AS DOUBLE) ELSE CAST({b!r} AS DOUBLE) END"
        mu, half, lsl, usl, drift = pick(0), pick(2), pick(3), pick(4), pick(5)
        cols.append(f"({mu}) + ({drift}) * (tick % 1000) AS {ch}_center, ({half}) AS {ch}_half, ({lsl}) AS {ch}_lsl, ({usl}) AS {ch}_usl")
    return ", ".join(cols)


def _sql_single(ch: str, acute: str, drift: str) -> str:
    return (f"CASE WHEN {ch} < {ch}_center - {ch}_half OR {ch} > {ch}_center + {ch}_half THEN '{acute}' "
            f"WHEN {ch}_center + {ch}_half >= {ch}_usl - {ch}_half OR {ch}_center - {ch}_half <= {ch}_lsl + {ch}_half THEN '{drift}' END")


SQL_VIEWS = {
    "readings": """
SELECT l_suppkey % 20 AS equipment_no,
  row_number() OVER (PARTITION BY l_suppkey % 20 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity,
    l_extendedprice, l_discount + 0.0, l_tax + 0.0) - 1 AS tick,
  l_quantity AS temperature, l_extendedprice AS pressure, l_discount + 0.0 AS rf_power, l_tax + 0.0 AS gas_flow
FROM lineitem""",
    "banded": f"""
SELECT *, {_sql_judge()} FROM (
  SELECT 'EQP-' || lpad(CAST(equipment_no AS VARCHAR), 3, '0') AS equipment_id, tick * 1000 + equipment_no AS log_id, tick,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(tick * 5 AS BIGINT)) AS "timestamp",
    CASE WHEN equipment_no % 2 = 0 THEN 'P0' ELSE 'P1' END AS process_type, temperature, pressure, rf_power, gas_flow
  FROM readings) r""",
    "judged": f"""
SELECT *, temperature > temperature_center + temperature_half AND pressure < pressure_center - pressure_half AS cooling,
  {_sql_single('temperature', 'ERR-401', 'WRN-701')} AS c_temperature,
  {_sql_single('pressure', 'ERR-301', 'WRN-702')} AS c_pressure,
  {_sql_single('rf_power', 'ERR-201', 'WRN-703')} AS c_rf_power,
  {_sql_single('gas_flow', 'WRN-501', 'WRN-704')} AS c_gas_flow
FROM banded""",
    "telemetry": """
SELECT equipment_id, log_id, tick, "timestamp", process_type, temperature, pressure, rf_power, gas_flow,
  temperature_center, pressure_center, rf_power_center, gas_flow_center,
  CASE WHEN cooling THEN 'ERR-402' WHEN c_temperature LIKE 'ERR%' THEN c_temperature WHEN c_pressure LIKE 'ERR%' THEN c_pressure
    WHEN c_rf_power LIKE 'ERR%' THEN c_rf_power WHEN c_gas_flow = 'WRN-501' THEN c_gas_flow
    ELSE coalesce(c_temperature, c_pressure, c_rf_power, c_gas_flow) END AS alarm_code,
  CASE WHEN cooling THEN 'ERR-402' ELSE c_temperature END AS alarm_temperature,
  CASE WHEN NOT cooling THEN c_pressure END AS alarm_pressure, c_rf_power AS alarm_rf_power, c_gas_flow AS alarm_gas_flow
FROM judged""",
    "master": """
SELECT 'EQP-' || CASE WHEN s_suppkey < 100 THEN lpad(CAST(s_suppkey AS VARCHAR), 3, '0') ELSE CAST(s_suppkey AS VARCHAR) END AS equipment_id,
  s_suppkey AS equipment_no, r_name AS line_name, CASE WHEN s_suppkey % 2 = 0 THEN 'P0' ELSE 'P1' END AS process_type,
  n_name AS location, CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey END AS display_order,
  CASE WHEN s_suppkey % 4 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST((s_suppkey % 20) * 600 AS BIGINT)) END AS alarm_cleared_at,
  CASE WHEN s_suppkey % 5 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST((s_suppkey % 20) * 300 AS BIGINT)) END AS repaired_at,
  CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END AS position_x, CASE WHEN s_suppkey % 6 = 0 THEN s_acctbal / 2 END AS position_y
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "users": "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS role, c_acctbal AS balance, c_nationkey AS nation FROM customer",
    "lines": """
SELECT r_regionkey AS line_id, r_name AS code, CASE WHEN r_regionkey % 2 = 0 THEN 10 - r_regionkey END AS display_order,
  CASE WHEN r_regionkey = 3 THEN 'inactive' ELSE 'active' END AS status FROM region""",
    "user_lines": """
SELECT c_custkey AS user_id, n_regionkey AS line_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 11 <> 0
UNION SELECT c_custkey, c_custkey % 5 FROM customer WHERE c_custkey % 11 <> 0""",
    "feed": """
SELECT event_id, 'EQP-' || lpad(CAST(user_id % 20 AS VARCHAR), 3, '0') AS equipment_id,
  CASE (user_id // 20) % 4 WHEN 0 THEN 'temperature' WHEN 1 THEN 'pressure' WHEN 2 THEN 'rf_power' ELSE 'gas_flow' END AS metric,
  ts, CASE WHEN event_type = 'error' AND value > 20 THEN 'ERR-402' WHEN event_type = 'error' THEN 'ERR-401'
    WHEN event_type = 'click' THEN 'WRN-701' WHEN event_type = 'purchase' THEN 'WRN-501' END AS alarm_code
FROM events""",
    "alarms": """
SELECT event_id AS alarm_id, equipment_id, metric, alarm_code, CASE WHEN alarm_code = 'ERR-402' THEN 'critical' ELSE 'warning' END AS severity,
  ts AS raised_at, cleared_at
FROM (SELECT *, lead(ts) OVER (PARTITION BY equipment_id, metric ORDER BY ts, event_id) AS cleared_at
  FROM (SELECT *, lag(alarm_code) OVER (PARTITION BY equipment_id, metric ORDER BY ts, event_id) AS prev FROM feed) f
  WHERE alarm_code IS DISTINCT FROM prev) c
WHERE alarm_code IS NOT NULL""",
    "notifications": """
SELECT min(a.alarm_id) AS id, min(raised_at) AS occurred_at, a.equipment_id, line_name, metric, alarm_code,
  a.equipment_id || ' ' || CASE alarm_code WHEN 'ERR-402' THEN 'Cooling anomaly (temperature rise, pressure drop)'
    WHEN 'ERR-401' THEN 'Temperature exceeded critical threshold' WHEN 'WRN-701' THEN 'Temperature drift detected'
    WHEN 'WRN-501' THEN 'Gas flow out of warning band' END AS message,
  time_bucket(INTERVAL '30 minutes', raised_at) AS bucket_start, min(a.alarm_id) AS source_alarm_id
FROM alarms a LEFT JOIN master m ON a.equipment_id = m.equipment_id
GROUP BY a.equipment_id, line_name, metric, alarm_code, time_bucket(INTERVAL '30 minutes', raised_at)""",
    "reads": """
SELECT id AS notification_id, CAST(1 AS BIGINT) AS user_id, occurred_at AS read_at FROM notifications WHERE id % 3 = 0
UNION ALL SELECT id, 2, occurred_at FROM notifications WHERE id % 7 = 0""",
    "repairs": """
SELECT o_orderkey AS id, 'EQP-' || lpad(CAST(o_custkey % 100 AS VARCHAR), 3, '0') AS equipment_id,
  CASE WHEN o_custkey % 10 <> 9 THEN o_custkey ELSE -o_custkey END AS repaired_by, o_orderdate AS repaired_at,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'ERR-402' WHEN '2-HIGH' THEN 'ERR-301' WHEN '3-MEDIUM' THEN 'WRN-702' END AS alarm_code_before
FROM orders""",
    "work_logs": """
SELECT o_orderkey AS id, o_custkey AS owner,
  CASE o_orderkey % 5 WHEN 0 THEN 'emergency' WHEN 1 THEN 'preventive' WHEN 2 THEN 'repair' WHEN 3 THEN 'inspection' ELSE 'etc' END AS work_type,
  'EQP-' || lpad(CAST(o_custkey % 100 AS VARCHAR), 3, '0') AS equipment_id, o_orderdate AS started_at,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'progress' END AS status,
  CASE WHEN o_orderkey % 13 = 0 THEN o_orderdate END AS deleted_at, o_totalprice AS cost
FROM orders""",
    "sessions": "SELECT conv_id AS session_id, turn AS message_id, role, text AS content FROM conversations",
    "incidents": """
SELECT event_id, 'EQP-' || lpad(CAST(user_id % 20 AS VARCHAR), 3, '0') AS equipment_id,
  CASE WHEN event_type = 'error' THEN 'acute' ELSE 'drift' END AS kind,
  CAST(floor(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', date_trunc('second', ts)) / 864.0) AS BIGINT) AS start_tick,
  CAST(floor(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', date_trunc('second', ts)) / 864.0) AS BIGINT)
    + CASE WHEN event_type = 'error' THEN 4 ELSE 19 END AS end_tick
FROM events WHERE event_type IN ('error', 'signup')""",
    "detections": "SELECT equipment_id, tick FROM telemetry WHERE alarm_code IS NOT NULL",
}
