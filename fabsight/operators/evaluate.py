"""Detection evaluation against labelled events, operating points, precision curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fabsight import constants as K
from fabsight.plans.asof import along
from fabsight.plans.series import OWN, PIECE, exact_quantiles, ordered_sums, weighted_quantiles
from fabsight.session import durable

DAY = 86_400.0


def resolve_grace(kind: Column, grace: int | Mapping[str, int] | None) -> Column | None:
    if grace is None:
        return None
    if isinstance(grace, int):
        return F.lit(grace)
    out = F.lit(grace.get("_default")).cast("long")
    for name, ticks in grace.items():
        if name != "_default":
            out = F.when(kind == name, F.lit(ticks)).otherwise(out)
    return out


def events_detections_range(events: DataFrame, detections: DataFrame, grace=None) -> DataFrame:
    """First detection inside ``[start, min(end, start + grace)]`` of each event (NULL when missed).

    It is the first detection at or after the start, if that is not too late; nothing else is compared.
    """
    g = resolve_grace(F.col("kind"), grace)
    last = F.col("end_tick") if g is None else F.least(F.col("end_tick"), F.coalesce(F.col("start_tick") + g, F.col("end_tick")))
    found = along(events, detections, ["equipment_id"], "start_tick", "tick", {"_next": ("first", F.col("tick"))}, right_first=False)
    first = F.when(F.col("_next") <= last, F.col("_next"))
    return found.withColumn("first_tick", first).drop("_next").withColumns({
        "detected": F.col("first_tick").isNotNull(), "delay": F.col("first_tick") - F.col("start_tick")})


def _reach(ticks: DataFrame, events: DataFrame) -> DataFrame:
    """Furthest end among the events that started by each tick: the tick is inside an event iff that reaches it."""
    return along(ticks, events, ["equipment_id"], "tick", "start_tick", {"_reach": ("max", F.col("end_tick"))})


def detections_outside_events(events: DataFrame, detections: DataFrame) -> DataFrame:
    outside = F.col("_reach").isNull() | (F.col("_reach") < F.col("tick"))
    return _reach(detections, events).where(outside).drop("_reach")


def point_labels(ticks: DataFrame, events: DataFrame) -> DataFrame:
    """Label 1 on ticks inside any event of the equipment."""
    return _reach(ticks, events).withColumn("label", F.coalesce((F.col("_reach") >= F.col("tick")).cast("int"), F.lit(0))).drop("_reach")


def bucket_dedup(detections: DataFrame, bucket_ticks: int) -> DataFrame:
    if bucket_ticks <= 1:
        return detections
    return detections.groupBy("equipment_id", F.floor(F.col("tick") / bucket_ticks).alias("_b")).agg(
        F.min("tick").alias("tick")).select("equipment_id", "tick")


def event_recall(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count(F.lit(1)).alias("events_total"), F.count_if("detected").alias("events_detected"),
                       F.avg(F.col("detected").cast("double")).alias("event_recall"))


def recall_by_kind(matched: DataFrame) -> DataFrame:
    return matched.rollup("kind").agg(
        F.count(F.lit(1)).alias("events_total"), F.avg(F.col("detected").cast("double")).alias("recall"),
        F.avg("delay").alias("delay_mean"))


def delay_stats(matched: DataFrame) -> DataFrame:
    p90 = exact_quantiles(matched, [], "delay", {"delay_p90": 0.9})
    return matched.agg(F.avg("delay").alias("delay_mean")).withColumn("delay_p90", p90.scalar())


def equipment_n_ticks(df: DataFrame) -> DataFrame:
    return df.groupBy("equipment_id").agg(F.count(F.lit(1)).alias("n_ticks"))


def false_alarms(events: DataFrame, detections: DataFrame, n_ticks: DataFrame, tick_seconds: float = K.INTERVAL_SECONDS,
                 dedup_seconds: float | None = None) -> DataFrame:
    """Detections outside every event, total and per equipment-day over all observed equipment."""
    outside = detections_outside_events(events, detections)
    if dedup_seconds:
        outside = bucket_dedup(outside, max(1, round(dedup_seconds / tick_seconds)))
    days = n_ticks.agg((F.sum("n_ticks") * tick_seconds / DAY).alias("d")).scalar()
    return outside.agg(F.count(F.lit(1)).alias("false_alarms")).withColumn(
        "per_equipment_day", F.when(days > 0, F.col("false_alarms") / days))


def detection_summary(events: DataFrame, detections: DataFrame, n_ticks: DataFrame, grace=None,
                      tick_seconds: float = K.INTERVAL_SECONDS, dedup_seconds: float | None = 1800.0,
                      kinds: Sequence[str] = ()) -> DataFrame:
    """All metrics as one flat row: a few scalar aggregates put side by side."""
    matched = events_detections_range(events, detections, grace)
    per_kind = []
    for kind in kinds:
        mine = F.col("kind") == kind
        per_kind += [F.avg(F.when(mine, F.col("detected").cast("double"))).alias(f"recall_{kind}"),
                     F.avg(F.when(mine, F.col("delay"))).alias(f"delay_mean_{kind}_ticks")]
    head = matched.agg(
        F.count(F.lit(1)).alias("events_total"), F.count_if("detected").alias("events_detected"),
        F.avg(F.col("detected").cast("double")).alias("event_recall"), F.avg("delay").alias("detection_delay_mean_ticks"), *per_kind)
    p90 = exact_quantiles(matched, [], "delay", {"q": 0.9}).scalar()
    raw = false_alarms(events, detections, n_ticks, tick_seconds)
    out = head.withColumns({
        "detection_delay_p90_ticks": p90, "false_alarms_total": raw.select("false_alarms").scalar(),
        "false_alarms_per_equipment_day": raw.select("per_equipment_day").scalar()})
    if dedup_seconds:
        few = false_alarms(events, detections, n_ticks, tick_seconds, dedup_seconds)
        out = out.withColumns({"false_alarms_dedup_total": few.select("false_alarms").scalar(),
                               "false_alarms_per_equipment_day_dedup": few.select("per_equipment_day").scalar()})
    return out


def average_precision(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Step-wise area under precision-recall, equal scores as one point; NULL for a single class.

    Rows are reduced to one per distinct score before the only global order, a range-partitioned prefix sum.
    """
    points = scored.groupBy(F.col(score).alias("_s")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_p"))
    run = ordered_sums(points, [], [F.desc("_s")], {"_cn": F.col("_n"), "_cp": F.col("_p")})
    total = run.agg(F.sum("_p").alias("pos"), F.sum("_n").alias("n"), F.sum(F.col("_p") * F.col("_cp") / F.col("_cn")).alias("area"))
    return total.select(F.when((F.col("pos") > 0) & (F.col("pos") < F.col("n")), F.col("area") / F.col("pos")).alias("average_precision"))


def latest_window_score(ticks: DataFrame, scores: DataFrame, window: int = K.WINDOW, stride: int = K.STRIDE,
                        score: str = "score") -> DataFrame:
    """Score of the last completed window at each tick, by arithmetic on the stride; early ticks take the first one."""
    last = scores.groupBy("equipment_id").agg(F.max("win").alias("_max"))
    done = F.floor((F.col("tick") - (window - 1)) / stride).cast("long")
    keyed = ticks.join(last, "equipment_id").withColumn("win", F.least(F.greatest(done, F.lit(0)), F.col("_max"))).drop("_max")
    return keyed.join(scores.select("equipment_id", "win", score), ["equipment_id", "win"], "left").drop("win")


def operating_point(sweep: DataFrame, budget: float, groups: Sequence[str] = (), fa: str = "false_alarms_dedup",
                    recall: str = "recall", delay: str = "delay_p90") -> DataFrame:
    """Within the false-alarm budget the best rounded recall, then the least delay; else the fewest false alarms."""
    fits = F.coalesce(F.col(fa) <= budget, F.lit(False))
    order = F.struct(
        F.when(fits, 0).otherwise(1).alias("a"),
        F.when(fits, 0.0).otherwise(F.coalesce(F.col(fa), F.lit(float("inf")))).alias("b"),
        (-F.round(F.coalesce(F.col(recall), F.lit(0.0)), 6)).alias("c"),
        F.coalesce(F.col(delay), F.lit(float("inf"))).alias("d"), F.col("point").alias("e"))
    rest = [c for c in sweep.columns if c not in groups]
    return sweep.groupBy(*groups).agg(F.min_by(F.struct(*rest), order).alias("_b")).where("_b IS NOT NULL").select(*groups, "_b.*")


def grid_best(grid: DataFrame, recall: str = "recall", keys: Sequence[str] = ("false_alarms", "delay_p90", "delay_mean")) -> DataFrame:
    """Best grid row: full recall first, then false alarms, p90 and mean delay."""
    order = F.struct(F.when(F.col(recall) >= 1.0, 0).otherwise(1), *[F.coalesce(F.col(k).cast("double"), F.lit(float("inf"))) for k in keys], "point")
    return grid.agg(F.min_by(F.struct(*grid.columns), order).alias("_b")).select("_b.*")


def sweep_best_realtime(grid: DataFrame, delay: str = "delay_acute", fa: str = "false_alarms") -> DataFrame:
    order = F.struct(F.coalesce(F.col(delay), F.lit(float("inf"))), F.col(fa), F.col("point"))
    return grid.agg(F.min_by(F.struct(*grid.columns), order).alias("_b")).select("_b.*")


def detector_ranking(points: DataFrame, recall: str = "recall", delay: str = "delay_p90") -> DataFrame:
    # one row per detector
    rn = F.row_number().over(W.orderBy(F.desc_nulls_last(recall), F.asc_nulls_last(delay), F.asc("detector")))
    return points.withColumn("place", rn)


def interval_overlap(a: DataFrame, b: DataFrame, now: Column, how: str) -> DataFrame:
    """Rows of ``a`` (raised_at..cleared_at) that do (``left_semi``) or do not (``left_anti``) meet one of ``b``.

    An interval meets one of ``b`` iff, among those of ``b`` that start by its end, the latest end reaches its
    start: a running maximum along the time line.  Intervals open at the end run to ``now``.
    """
    ended = a.withColumn("_to", F.coalesce(F.col("cleared_at"), now))
    other = b.select("equipment_id", "raised_at", F.coalesce(F.col("cleared_at"), now).alias("_end"))
    met = along(ended, other, ["equipment_id"], "_to", "raised_at", {"_reach": ("max", F.col("_end"))})
    hit = F.coalesce(F.col("_reach") >= F.col("raised_at"), F.lit(False))
    return met.where(hit if how == "left_semi" else ~hit).select(*a.columns)


def shadow_vs_rule(shadow: DataFrame, rule: DataFrame, now: Column) -> DataFrame:
    def n(df):
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()
    one = shadow.agg(F.count(F.lit(1)).alias("shadow_events"))
    return one.withColumns({"detector_only": n(interval_overlap(shadow, rule, now, "left_anti")),
                            "overlapping": n(interval_overlap(shadow, rule, now, "left_semi")),
                            "rule_only": n(interval_overlap(rule, shadow, now, "left_anti"))})


def shadow_report(shadow: DataFrame, rule: DataFrame, now: Column, days: int = 7) -> DataFrame:
    since = now - F.make_dt_interval(F.lit(days))
    return shadow_vs_rule(shadow.where(F.col("raised_at") >= since), rule.where(F.col("raised_at") >= since), now)


def sweep_metrics(events: DataFrame, fired: DataFrame, points: DataFrame, dedup_ticks: int = 360) -> DataFrame:
    """Metrics of many thresholds or parameter sets at once.

    ``fired`` holds (point, equipment_id, tick).  The whole sweep is evaluated at once in stretches of ticks, see ``_swept``; events are
    not copied per point.
    """
    kinds = points.select(F.col("point").alias("place")).distinct()
    long, total = _swept(events, fired.select(F.col("point").alias("place"), "equipment_id", "tick", F.lit(1).alias("level")), kinds, 1, dedup_ticks, ["place"])
    sums, p90 = _sweep_sums(long, ["place"])
    out = points.join(sums.join(p90, "place", "left").withColumnRenamed("place", "point"), "point", "left").withColumn("_all", total)
    recall = F.when(F.col("_all") > 0, F.round(F.coalesce("_h", F.lit(0)) / F.col("_all"), 8))
    return out.select(*points.columns, recall.alias("recall"), F.round("delay_mean", 6).alias("delay_mean"), "delay_p90",
                      F.coalesce("false_alarms_dedup", F.lit(0)).alias("false_alarms_dedup"))


#: Ticks of a stretch of one equipment that meets its events in one task (rounded up to whole buckets).
SWEEP_TICKS = 65_536


def threshold_sweep(events: DataFrame, scored: DataFrame, limits: DataFrame, points: int, dedup_ticks: int = 360, margin: float = 1e-9,
                    groups: Sequence[str] = ()) -> DataFrame:
    """(groups, point, recall, delay_mean, delay_p90, false_alarms_dedup) of ``points`` thresholds in one sweep.

    ``scored`` has (groups, equipment_id, process_type, tick, score); ``limits`` the rising thresholds of a group and process type as an
    array.  A score counts by its level, the number of thresholds below it.
    """
    groups = list(groups)
    level = F.size(F.filter("_limits", lambda x: F.col("score") > x + margin))
    named = scored.join(limits.select(*groups, "process_type", F.col("limits").alias("_limits")), [*groups, "process_type"])
    kinds = limits.select(*groups).distinct() if groups else limits.sparkSession.range(1).select()
    long, total = _swept(events, named.select(*groups, "equipment_id", "tick", level.alias("level")).where("level > 0"), kinds, points, dedup_ticks, groups)
    at = [*groups, "point"]
    sums, p90 = _sweep_sums(long, at)
    every = kinds.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("_all", total).where("_all > 0")
    none = F.lit(0).cast("long")
    return every.join(sums, at, "left").join(p90, at, "left").select(
        *at, (F.coalesce("_h", none) / F.col("_all")).alias("recall"), "delay_mean", "delay_p90", F.coalesce("false_alarms_dedup", none).alias("false_alarms_dedup"))


def _sweep_sums(long: DataFrame, at: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of the counts of a sweep: events hit (_h), mean delay and alarms per ``at``, and the delay that 90 of 100 do not exceed."""
    sums = long.groupBy(*at).agg(F.sum("n").alias("_h"), (F.sum(F.col("delay") * F.col("n")) / F.sum(F.when(F.col("delay").isNotNull(), F.col("n")))).alias("delay_mean"),
                                 F.sum("alarms").alias("false_alarms_dedup"))
    return sums, weighted_quantiles(long, at, "delay", "n", {"delay_p90": 0.9})


def _swept(events: DataFrame, fired: DataFrame, kinds: DataFrame, points: int, dedup_ticks: int, groups: list[str]) -> tuple[DataFrame, Column]:
    """(groups, point, delay, n, alarms): events by their delay and buckets with a detection outside all events, and the number of events.

    ``fired`` has (groups, equipment_id, tick, level): a detection of the first ``level`` of ``points`` thresholds.  ``fired`` and events
    move once, to their stretch of ticks, for all groups and thresholds; a stretch also gets the next later tick of every level and the
    furthest end of the events before it.  Neither events nor detections are copied per threshold, and events of one span count together.
    """
    own = ["equipment_id", PIECE]
    size = -(-SWEEP_TICKS // dedup_ticks) * dedup_ticks
    stretch = lambda c: F.floor(F.col(c) / size).alias(PIECE)
    fired = durable(fired.select(*groups, "equipment_id", stretch("tick"), "tick", "level", F.lit(True).alias(OWN)))
    spans = durable(events.groupBy("equipment_id", stretch("start_tick"), "start_tick", "end_tick").agg(F.count(F.lit(1)).alias("n")))
    total = spans.agg(F.sum("n").alias("n")).scalar()
    # a row per stretch and group from here to ``moved``
    spots = fired.select(*own).distinct().union(spans.select(*own).distinct()).distinct()
    firsts = [F.min(F.when(F.col("level") > i, F.col("tick"))).alias(f"_n{i}") for i in range(points)]
    line = spots.crossJoin(kinds).unionByName(fired.groupBy(*groups, *own).agg(*firsts), allowMissingColumns=True)
    line = line.groupBy(*groups, *own).agg(*[F.min(f"_n{i}").alias(f"_n{i}") for i in range(points)])
    later = W.partitionBy(*groups, "equipment_id").orderBy(PIECE).rowsBetween(1, W.unboundedFollowing)
    nexts = line.select(*groups, *own, F.array(*[F.min(f"_n{i}").over(later) for i in range(points)]).alias("_a"))
    after = nexts.select(*groups, *own, F.posexplode("_a").alias("_i", "tick")).where("tick IS NOT NULL")
    moved = fired.unionByName(after.select(*groups, *own, "tick", (F.col("_i") + 1).alias("level"), F.lit(False).alias(OWN)))
    ends = spans.groupBy(*own).agg(F.max("end_tick").alias("_e")).unionByName(spots, allowMissingColumns=True).groupBy(*own).agg(F.max("_e").alias("_e"))
    earlier = W.partitionBy("equipment_id").orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)
    reach = ends.select(*own, (F.col(PIECE) * size).alias("start_tick"), F.max("_e").over(earlier).alias("end_tick"), F.lit(0).cast("long").alias("n")).where("end_tick IS NOT NULL")

    def meet(asked: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        return _sweep_stretch(asked, seen, groups, points, dedup_ticks)

    kind = "".join(f"`{g}` {fired.schema[g].dataType.simpleString()}, " for g in groups)
    met = spans.unionByName(reach).groupBy(*own).cogroup(moved.groupBy(*own)).applyInPandas(meet, f"{kind}point int, delay long, n long, alarms long")
    return durable(met.groupBy(*groups, "point", "delay").agg(F.sum("n").alias("n"), F.sum("alarms").alias("alarms"))), total


def _sweep_stretch(asked: pd.DataFrame, seen: pd.DataFrame, groups: Sequence[str], points: int, dedup_ticks: int) -> pd.DataFrame:
    """Counts of one stretch: per group and point the delays of its events, and the buckets with a detection outside all events."""
    asked = asked.sort_values("start_tick")
    start, end, n = (asked[c].to_numpy() for c in ("start_tick", "end_tick", "n"))
    furthest, out = np.maximum.accumulate(end), []
    for kind, part in seen.groupby(list(groups), dropna=False) if groups else [((), seen)]:
        part = part.sort_values("tick")
        tick, level, own = (part[c].to_numpy() for c in ("tick", "level", OWN))
        last = np.searchsorted(start, tick, side="right") - 1
        outside = own & ((last < 0) | (furthest[last] < tick)) if len(start) else own
        worst = pd.Series(level[outside]).groupby(tick[outside] // dedup_ticks).max().to_numpy()
        for i in range(points):
            known = tick[level > i]
            if not len(known):
                break
            place = np.searchsorted(known, start)
            first = known[np.minimum(place, len(known) - 1)]
            hit = (place < len(known)) & (first <= end) & (n > 0)
            delay, at = np.unique(first[hit] - start[hit], return_inverse=True)
            counts = np.bincount(at, weights=n[hit], minlength=len(delay)).astype(np.int64)
            alarms = int((worst > i).sum())
            out.append(pd.DataFrame({**dict(zip(groups, kind)), "point": i, "delay": pd.array([*delay, None], dtype="Int64"), "n": [*counts, 0],
                                     "alarms": [0] * len(delay) + [alarms]}))
    names = [*groups, "point", "delay", "n", "alarms"]
    return pd.concat(out)[names] if out else pd.DataFrame({c: [] for c in names})


def fire_rate(df: DataFrame, fired: Column, ratio: Column, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(fired.cast("double")).alias("fire_rate"), F.max(ratio).alias("peak_ratio"))


def separation_ratio(df: DataFrame, score: str, anomalous: Column) -> DataFrame:
    """Median score of anomalous over median score of normal windows."""
    flagged = df.select(F.col(score).alias("_v"), anomalous.alias("_a"))
    med = exact_quantiles(flagged, ["_a"], "_v", {"m": 0.5})
    return med.agg((F.max(F.when(F.col("_a"), F.col("m"))) / F.max(F.when(~F.col("_a"), F.col("m")))).alias("separation_ratio"))


def pooled_recall(matched: DataFrame, seed: str = "seed") -> DataFrame:
    """Detected and total per seed and pooled, for two detectors, and their ratio."""
    return matched.rollup(seed).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("detected_a").alias("detected_a"), F.count_if("detected_b").alias("detected_b"),
    ).withColumn("ratio", F.when(F.col("detected_b") > 0, F.col("detected_a") / F.col("detected_b")))


def drift_snr(df: DataFrame, onset: int, value: str, horizons: Sequence[int], keys: Sequence[str] = ("equipment_id",)) -> DataFrame:
    """Noise before the onset, slope after it, and drift-to-noise ratio at each horizon."""
    per = df.groupBy(*keys).agg(
        F.stddev_pop(F.when(F.col("tick") < onset, F.col(value))).alias("noise"),
        F.regr_slope(F.when(F.col("tick") >= onset, F.col(value)), F.col("tick").cast("double")).alias("slope"))
    return per.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn(
        "snr", F.abs(F.col("slope")) * F.col("horizon") / F.col("noise"))


def step_eval(detections: DataFrame, events: DataFrame, n_ticks: DataFrame, region: Column, grace=None,
              tick_seconds: float = K.INTERVAL_SECONDS) -> DataFrame:
    """False alarms per day over all events and recall of the events of one step region."""
    matched = events_detections_range(events, detections, grace).where(region)
    fa = false_alarms(events, detections, n_ticks, tick_seconds)
    return matched.agg(F.avg(F.col("detected").cast("double")).alias("region_recall"), F.count(F.lit(1)).alias("region_events")).withColumn(
        "false_alarms_per_day", fa.select("per_equipment_day").scalar())
