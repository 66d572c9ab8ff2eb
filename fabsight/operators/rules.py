"""Rule judgement of readings: acute and drift bands, variance, composite cooling fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fabsight import constants as K
from fabsight.functions.alarms import best_code
from fabsight.plans.series import neighbours

_FIELDS = ("mu0", "sigma", "half", "lsl", "usl", "drift")


def profile_value(profiles: dict, default: str, process: Column, channel: str, field: str) -> Column:
    """Constant of the row's process profile; unknown or missing processes use the default one."""
    i = _FIELDS.index(field)
    out = F.lit(profiles[default][channel][i])
    cond = None
    for name, channels in profiles.items():
        if name != default and channels[channel][i] != profiles[default][channel][i]:
            cond = (F.when(process == name, F.lit(channels[channel][i])) if cond is None
                    else cond.when(process == name, F.lit(channels[channel][i])))
    return out if cond is None else cond.otherwise(out)


def metric_bands(process: Column, profiles: dict | None = None, default: str = K.DEFAULT_PROCESS) -> Column:
    profiles = profiles or K.PROFILES
    return F.struct(*[F.struct(*[profile_value(profiles, default, process, ch, f).alias(f) for f in ("half", "usl", "lsl")]
                               ).alias(ch) for ch in K.CHANNELS])


def with_centers(df: DataFrame, profiles: dict, default: str) -> DataFrame:
    """Dynamic band centre of each channel (mu0 + drift over a 1000-tick cycle), unless the table has it."""
    p = F.col("process_type")
    cols = {f"{ch}_center": profile_value(profiles, default, p, ch, "mu0")
            + profile_value(profiles, default, p, ch, "drift") * F.pmod(F.col("tick"), F.lit(1000)) for ch in K.CHANNELS}
    return df.withColumns({c: e for c, e in cols.items() if c not in df.columns})


def channel_code(df_cols, profiles: dict, default: str, channel: str, variance: Column | None = None,
                 exempt: bool = False) -> Column:
    p, v, mid = F.col("process_type"), F.col(channel), F.col(f"{channel}_center")
    half, lsl, usl = (profile_value(profiles, default, p, channel, f) for f in ("half", "lsl", "usl"))
    low, high = mid - half, mid + half
    acute = F.lit(False) if exempt else (v < low) | (v > high)
    drift = (high >= usl - half) | (low <= lsl + half)
    code = F.when(acute, K.ACUTE_CODES[channel]).when(drift, K.DRIFT_CODES[channel])
    return code.when(variance, K.VARIANCE_CODE) if variance is not None else code


def cooling_fault(profiles: dict, default: str) -> Column:
    p = F.col("process_type")
    hot = F.col("temperature") > F.col("temperature_center") + profile_value(profiles, default, p, "temperature", "half")
    low = F.col("pressure") < F.col("pressure_center") - profile_value(profiles, default, p, "pressure", "half")
    return hot & low


def judge(df: DataFrame, profiles: dict, default: str, variance: dict[str, Column] | None = None,
          exempt: tuple[str, ...] = ()) -> DataFrame:
    """Add ``alarm_<channel>`` and the representative ``alarm_code`` to readings (a projection only)."""
    base = with_centers(df, profiles, default)
    codes = {ch: channel_code(base, profiles, default, ch, (variance or {}).get(ch), ch in exempt) for ch in K.CHANNELS}
    composite = cooling_fault(profiles, default)
    shown = dict(codes)
    shown["temperature"] = F.when(composite, K.COOLING_CODE).otherwise(codes["temperature"])
    shown["pressure"] = F.when(~composite, codes["pressure"])
    judged = base.withColumns({f"alarm_{ch}": c for ch, c in shown.items()})
    return judged.withColumn("alarm_code", best_code([F.col(f"alarm_{ch}") for ch in K.CHANNELS]))


def variance_flags(df: DataFrame, profiles: dict, default: str, key: str = "equipment_id", pos: str = "tick") -> DataFrame:
    """``var_<channel>``: spread of first differences over 9 readings beyond twice the expected noise."""
    n = K.VARIANCE_HISTORY
    lagged = neighbours(df, [key], pos, {
        f"_d_{ch}": (lambda w, ch=ch: F.col(ch) - F.lag(ch).over(w)) for ch in K.CHANNELS}, before=1)
    p = F.col("process_type")
    spread = neighbours(lagged, [key], pos, {
        **{f"_s_{ch}": (lambda w, ch=ch: F.stddev_pop(f"_d_{ch}").over(w.rowsBetween(-(n - 1), 0))) for ch in K.CHANNELS},
        "_n": lambda w: F.count("_d_temperature").over(w.rowsBetween(-(n - 1), 0))}, before=n - 1)
    flags = {f"var_{ch}": (F.col("_n") >= K.VARIANCE_MIN_SAMPLES - 1)
             & (F.col(f"_s_{ch}") > K.VARIANCE_FACTOR * profile_value(profiles, default, p, ch, "sigma")) for ch in K.CHANNELS}
    return spread.withColumns(flags).drop("_n", *[f"_d_{ch}" for ch in K.CHANNELS], *[f"_s_{ch}" for ch in K.CHANNELS])


def rule_judge(df: DataFrame, profiles: dict, default: str, exempt: tuple[str, ...] = (), key: str = "equipment_id",
               pos: str = "tick") -> DataFrame:
    """Full rule judgement including the variance rule over the last eight readings."""
    flagged = variance_flags(df, profiles, default, key, pos)
    return judge(flagged, profiles, default, {ch: F.col(f"var_{ch}") for ch in K.CHANNELS}, exempt).drop(
        *[f"var_{ch}" for ch in K.CHANNELS])
