"""Text functions as column expressions; Unicode composition is the one Arrow batch function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from fabsight import constants as K

# white space other than line feed, and all white space
BLANK = "\\t\\u000b\\u000c\\u001c-\\u001f \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACE = "\\n\\r" + BLANK
CODE_TOKEN = r"[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)+|[A-Za-z][A-Za-z0-9_]{2,}"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once; inside higher-order functions a plain expression is
    evaluated again for every element."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^[{SPACE}]+", ""), f"[{SPACE}]+$", "")


def normalize_text(text: Column) -> Column:
    """Line ends, composition, invisible and control characters, split Latin words, blanks and empty lines."""
    t = F.regexp_replace(text, "\\r\\n?", "\n")
    t = nfc(t)
    t = F.regexp_replace(t, "[\\u00ad\\u200b\\u200c\\u200d\\ufeff]", "")
    t = F.regexp_replace(t, "[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f]", "")
    t = F.regexp_replace(t, "([A-Za-z])-\\n([A-Za-z])", "$1$2")
    t = F.regexp_replace(t, "[ \\t]+", " ")
    t = F.regexp_replace(t, f"[{BLANK}]+(?=\\n|$)", "")
    t = F.regexp_replace(t, "\\n{3,}", "\n\n")
    return strip(t)


_INVISIBLE, _CONTROL = re.compile("[\u00ad\u200b\u200c\u200d\ufeff]"), re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f]")
_SPLIT_WORD = re.compile("([A-Za-z])-\n([A-Za-z])")


def words(text: str) -> list[str]:
    """The words of a normalized text, in Python: ``tokenize_whitespace(normalize_text(text))``.

    What ``normalize_text`` does to blanks and empty lines does not change words, and ``str.split`` knows the characters of SPACE.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFC", text))
    return _SPLIT_WORD.sub(r"\1\2", _CONTROL.sub("", text)).split()


def tokenize_whitespace(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda x: x != "")


def tokenize_bigram(text: Column) -> Column:
    """Code-like words kept whole in lower case, then two-character pieces of the remaining text."""
    codes = F.transform(F.regexp_extract_all(text, F.lit(CODE_TOKEN), F.lit(0)), F.lower)
    rest = F.regexp_replace(F.regexp_replace(text, CODE_TOKEN, " "), f"[{SPACE}]+", "")
    chars = F.regexp_extract_all(rest, F.lit("(?s)."), F.lit(0))
    grams = let(chars, lambda c: F.when(F.size(c) > 1, F.zip_with(
        F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda x, y: F.concat(x, y))
    ).otherwise(F.array().cast("array<string>")))
    return F.concat(codes, grams)


def extract_entities(text: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))))


def within_known_scope(text: Column, known: Column) -> Column:
    """Every equipment id and alarm code named in the text is in ``known``."""
    named = F.array_union(extract_entities(text, K.EQUIPMENT_PATTERN), extract_entities(text, K.ALARM_PATTERN))
    return F.size(F.array_except(named, known)) == 0


def classify_intent(text: Column) -> Column:
    """Data request or plain small talk; doubtful texts stay data requests."""
    t = strip(F.coalesce(text, F.lit("")))
    small = f"(?i){K.SMALLTALK_SIGNAL}"
    after = F.regexp_replace(t, f"(?is)^.*?{K.SMALLTALK_SIGNAL}", "")
    return (F.when(t == "", "diagnostic").when(t.rlike(f"(?i){K.DIAGNOSTIC_SIGNAL}"), "diagnostic")
            .when(t.rlike(K.FOLLOWUP_REFERENCE), "diagnostic")
            .when(t.rlike(small) & ~after.rlike(K.REQUEST_CLAUSE), "direct").otherwise("diagnostic"))


def mentioned_days(text: Column) -> Column:
    """Every period named in the text, in days: number with unit, then relative words."""
    units = F.create_map(*[F.lit(x) for kv in K.UNIT_DAYS.items() for x in kv])
    hits = F.regexp_extract_all(text, F.lit(K.PERIOD_PATTERN), F.lit(0))
    exact = F.transform(hits, lambda h: F.regexp_extract(h, K.PERIOD_PATTERN, 1).cast("double")
                        * F.element_at(units, F.regexp_extract(h, K.PERIOD_PATTERN, 2)))
    words = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(d).alias("d")) for w, d in K.RELATIVE_DAYS.items()])
    return F.concat(exact, F.transform(F.filter(words, lambda x: F.contains(text, x["w"])), lambda x: x["d"]))


def within_data_window(text: Column, span_days: Column, known: Column | None = None) -> Column:
    days = mentioned_days(text)
    free = text.rlike(K.MAINTENANCE_HINT) | (F.size(days) == 0)
    if known is not None:
        free = ~known | free
    span = F.coalesce(span_days, F.lit(0.0))
    return free | ((span > 0) & F.forall(days, lambda d: d <= span))


def format_data_window(first: Column, last: Column, known: Column | None = None) -> Column:
    span = (F.unix_micros(last) - F.unix_micros(first)) / 86_400_000_000.0
    size = F.when(span < 1, F.concat(F.lit("약 "), F.format_string("%.0f", F.bround(span * 24, 0)), F.lit("시간"))).otherwise(
        F.concat(F.lit("약 "), F.format_string("%.0f", F.bround(span, 0)), F.lit("일")))
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    text = F.concat(F.date_format(first, iso), F.lit("+00:00 ~ "), F.date_format(last, iso), F.lit("+00:00 ("), size, F.lit(")"))
    text = F.when(first.isNull() | last.isNull(), "적재된 센서 데이터 없음").otherwise(text)
    return text if known is None else F.when(~known, "보유 범위 확인 불가 (조회 실패)").otherwise(text)


def derive_title(content: Column, equipment: Column | None = None, default: str = "새 대화", most: int = 30) -> Column:
    """First line of the question without scaffolding and leading equipment id, cut to ``most`` characters."""
    text = strip(F.coalesce(content, F.lit("")))
    text = F.split(text, "\\n\\s*-{3,}", 2)[0]
    lines = F.filter(F.transform(F.split(text, "\\r\\n|\\r|\\n"), strip), lambda x: x != "")
    text = F.coalesce(F.get(lines, 0), F.lit(""))
    if equipment is not None:
        tail = F.substring(text, F.length(equipment) + 1, F.length(text))
        mine = F.lower(F.substring(text, F.lit(1), F.length(equipment))) == F.lower(equipment)
        ends = tail.rlike("^(\\s*[-–:·,]\\s*|\\s+|$)")
        text = F.when((equipment != "") & mine & ends, strip(F.regexp_replace(tail, "^(\\s*[-–:·,]\\s*|\\s+)", ""))).otherwise(text)
    return F.when(text == "", default).when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("…")))


def format_value(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", x), "0+$", ""), "\\.$", "")


def truncate_observation(text: Column, most: int) -> Column:
    omitted = (F.length(text) - most).cast("string")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(
        F.substring(text, 1, most), F.lit("\n... (결과 과다로 "), omitted, F.lit("자 생략, 조회 범위를 좁혀 재시도 권장)")))


COUNT_QUERY = "알람\\s*코드.*(몇\\s*개|개수|갯수|수량|목록)"


def expand_count_query(query: Column, top_k: Column) -> tuple[Column, Column]:
    hit = query.rlike(COUNT_QUERY)
    return (F.when(hit, F.concat(query, F.lit(" 적용 알람 코드 목록"))).otherwise(query),
            F.when(hit, F.greatest(F.coalesce(top_k, F.lit(0)), F.lit(6))).otherwise(top_k))


def collect_citations(text: Column) -> Column:
    """Distinct document ids named in tool output, in order, plus the newest data time when present."""
    docs = F.array_distinct(F.regexp_extract_all(text, F.lit("(MAN-[A-Z]+-\\d+)"), F.lit(1)))
    times = F.regexp_extract_all(text, F.lit('"timestamp":\\s*"([^"]+)"'), F.lit(1))
    newest = F.when(F.size(times) > 0, F.array(F.concat(F.lit("telemetry@"), F.array_max(times)))).otherwise(F.array().cast("array<string>"))
    return F.concat(docs, newest)


def explicit_codes(query: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(query, F.lit("(?i)\\b(?:ERR|WRN)-\\d{3}\\b"), F.lit(0)), F.upper))


def mentions_codes(query: Column, content: Column) -> Column:
    """True when the query names no code or the content holds one of the codes it names."""
    codes = explicit_codes(query)
    return (F.size(codes) == 0) | F.exists(codes, lambda c: F.contains(F.upper(content), c))


TRACE = "read_steps: array<string>, write_steps: array<string>, citations: array<struct<doc_id: string>>, grounded: boolean, suggestions: array<string>"


def trace_json_fields(trace: Column) -> Column:
    return F.from_json(trace, "struct<" + TRACE + ">")
