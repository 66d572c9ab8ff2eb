"""Alarm code vocabulary as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from fabsight import constants as K


def lookup(table: dict) -> Column:
    """Literal map of a small fixed table."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def assess_status(code: Column) -> Column:
    return F.when(code.isNull(), "normal").when(code.isin(*K.CRITICAL_CODES), "critical").otherwise("warning")


def severity(code: Column) -> Column:
    return F.when(code.isin(*K.CRITICAL_CODES), "critical").otherwise("warning")


def severity_rank(code: Column) -> Column:
    """2 for ERR codes, 1 for any other code, 0 for none."""
    return F.when(code.isNull(), 0).when(code.startswith("ERR"), 2).otherwise(1)


def work_type_of_alarm(code: Column) -> Column:
    return (F.when(code.startswith("ERR-"), "emergency")
            .when(code.isin("WRN-701", "WRN-702", "WRN-703", "WRN-704"), "preventive")
            .when(code.startswith("WRN-"), "repair").otherwise("etc"))


def _locale(locale: str) -> str:
    return locale if locale in K.ALARM_TEXTS else K.DEFAULT_LOCALE


def alarm_message(equipment: Column, code: Column, locale: str = K.DEFAULT_LOCALE) -> Column:
    loc = _locale(locale)
    known = F.try_element_at(lookup(K.ALARM_TEXTS[loc]), code)
    return F.concat_ws(" ", equipment, F.coalesce(known, F.concat_ws(" ", code, F.lit(K.UNKNOWN_ALARM_SUFFIX[loc]))))


def _text_arrays(table: dict[str, list[str]]) -> Column:
    parts = []
    for code, items in table.items():
        parts += [F.lit(code), F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")]
    return F.create_map(*parts)


def checklist_items(code: Column, locale: str = K.DEFAULT_LOCALE) -> Column:
    loc = _locale(locale)
    empty = F.array().cast("array<string>")
    own = F.coalesce(F.try_element_at(_text_arrays(K.CHECKLISTS[loc]), code), empty)
    tail = F.array(*[F.lit(i) for i in K.CHECKLIST_TAIL[loc]])
    return F.when(code.isNull() | (code == ""), empty).otherwise(F.concat(own, tail))


def alarm_channels(code: Column) -> Column:
    return F.coalesce(F.try_element_at(_text_arrays(K.ALARM_CHANNELS), code), F.array().cast("array<string>"))


def best_code(codes: list[Column]) -> Column:
    """Code of the smallest priority number among the given columns, NULL when all are NULL."""
    rank = lookup(K.ALARM_PRIORITY)
    pairs = [F.when(c.isNotNull(), F.struct(F.coalesce(F.try_element_at(rank, c), F.lit(99)).alias("p"),
                                            F.lit(i).alias("i"), c.alias("code"))) for i, c in enumerate(codes)]
    # most readings have no code, and the array is not compiled
    return F.when(F.coalesce(*codes).isNotNull(), F.array_min(F.array_compact(F.array(*pairs)))["code"])
