"""Column types: 12 base types, each with or without null; defaults, literals and temporal forms.

Temporal values are stored as canonical text, whose byte order is their order in time; instants (datetime, datetimez) are
stored in UTC and presented in the zone of the engine.
"""

from __future__ import annotations

import math
import re
from datetime import UTC, date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataError, SchemaError

BASES = ("string", "int", "float", "bool", "date", "time", "timez", "datetime", "datetimez", "year", "month", "day")
ALL_TYPES = tuple(t for b in BASES for t in (b, f"{b}|null"))
TEXT_LIKE = {"string", "date", "time", "timez"}
INSTANTS = {"datetime", "datetimez"}
TEMPORAL = {"date", "time", "timez", *INSTANTS}
NUMBERS = {"int", "float", "year", "month", "day"}
#: Types that only views of foreign DataFrames have; their literals are passed on to Spark.
FOREIGN = {"timestamp", "other"}

_SPARK = {"float": T.DoubleType(), "bool": T.BooleanType(), "int": T.LongType(), "year": T.LongType(), "month": T.LongType(), "day": T.LongType()}
_RANGES = {"month": (1, 12), "day": (1, 31)}


def base_of(kind: str) -> str:
    return kind.removesuffix("|null")


def nullable(kind: str) -> bool:
    return kind.endswith("|null")


def check_type(kind: str) -> None:
    if kind not in ALL_TYPES:
        raise SchemaError("InvalidColumnType", type=kind)


def spark_type(kind: str) -> T.DataType:
    return _SPARK.get(base_of(kind), T.StringType())


def from_spark(kind: T.DataType, can_be_null: bool = True) -> str:
    """Declared type that a DataFrame's column is read as."""
    if isinstance(kind, T.IntegralType):
        base = "int"
    elif isinstance(kind, (T.FractionalType,)):
        base = "float"
    elif isinstance(kind, T.StringType):
        base = "string"
    elif isinstance(kind, T.BooleanType):
        base = "bool"
    else:
        base = "timestamp" if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "other"
    return f"{base}|null" if can_be_null else base


def default_of(kind: str):
    """(has a default, default) of a column that a record lacks."""
    if nullable(kind):
        return True, None
    safe = {"string": "", "int": 0, "float": 0.0, "bool": False}
    return (True, safe[kind]) if kind in safe else (False, None)


# ------------------------------------------------------------------------------------------------ temporal text

_DATE = re.compile(r"(\d{4})-(\d{2})-(\d{2})", re.ASCII)
_TIME = re.compile(r"(\d{2}):(\d{2}):(\d{2})", re.ASCII)
_TIMEZ = re.compile(r"(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,3}))?", re.ASCII)
_INSTANT = re.compile(r"(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2})?", re.ASCII)
_INSTANTZ = re.compile(r"(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?)(Z|[+-]\d{2}:?\d{2})?", re.ASCII)


def _days(y: int, m: int) -> int:
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    return (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]


def _real_date(text: str) -> bool:
    m = _DATE.fullmatch(text)
    if not m:
        return False
    y, mo, d = map(int, m.groups())
    return 1 <= mo <= 12 and 1 <= d <= _days(y, mo)


def _real_time(text: str, pattern: re.Pattern) -> str | None:
    m = pattern.fullmatch(text)
    if not m or int(m[1]) > 23 or int(m[2]) > 59 or int(m[3]) > 59:
        return None
    return f"{m[1]}:{m[2]}:{m[3]}" + (f".{(m[4] or '').ljust(3, '0')}" if pattern is _TIMEZ else "")


def encode_temporal(base: str, text: str, zone: str) -> str | None:
    """Stored form, or None where the text is no value of the type."""
    if base == "date":
        return text if _real_date(text) else None
    if base in ("time", "timez"):
        return _real_time(text, _TIME if base == "time" else _TIMEZ)
    m = (_INSTANT if base == "datetime" else _INSTANTZ).fullmatch(text)
    if not m or not _real_date(m[1]):
        return None
    clock = _real_time(m[2], _TIMEZ)
    if clock is None:
        return None
    year = int(m[1][:4])
    # Python knows no year 0; its leap years repeat after 400
    local = datetime.strptime(f"{year or 400:04d}{m[1][4:]} {clock}", "%Y-%m-%d %H:%M:%S.%f")
    if m[3] in (None,):
        if zone == "UTC":
            utc = local
        else:
            aware = local.replace(tzinfo=ZoneInfo(zone), fold=0)
            utc = aware.astimezone(UTC).replace(tzinfo=None)
    elif m[3] == "Z":
        utc = local
    else:
        hours, minutes = int(m[3][1:3]), int(m[3][-2:])
        shift = timedelta(hours=hours, minutes=minutes)
        if minutes > 59 or shift > timedelta(hours=14):
            return None
        utc = local - shift if m[3][0] == "+" else local + shift
    back = utc.year - 400 if not year else utc.year
    if not 0 <= back <= 9999:
        return None
    out = f"{back:04d}{utc:-%m-%d %H:%M:%S}"
    return out + f".{utc.microsecond // 1000:03d}" if base == "datetimez" else out


def present(column: Column, kind: str, zone: str) -> Column:
    """What a reader sees of a stored column; text that is no instant is shown as it is."""
    base = base_of(kind)
    if base not in INSTANTS or zone == "UTC":
        return column
    shown = "yyyy-MM-dd HH:mm:ss" + (".SSS" if base == "datetimez" else "")
    local = F.from_utc_timestamp(F.try_to_timestamp(column), zone)
    return F.coalesce(F.date_format(local, shown), column)


def local_text(base: str, value: date | time | datetime, zone: str) -> str:
    """Text of a column of a temporal type, as a reader in the zone sees it, cut to the type's precision.

    A datetime without a zone is taken for one of the engine's; columns of dates and times take its parts as they stand.
    """
    if base == "date":
        return f"{value.year:04d}-{value.month:02d}-{value.day:02d}"
    clock = f"{value.hour:02d}:{value.minute:02d}:{value.second:02d}"
    millis = f".{value.microsecond // 1000:03d}"
    if base in ("time", "timez"):
        return clock + (millis if base == "timez" else "")
    if value.tzinfo is not None:
        value = value.astimezone(ZoneInfo(zone))
        clock = f"{value.hour:02d}:{value.minute:02d}:{value.second:02d}"
    return f"{value.year:04d}-{value.month:02d}-{value.day:02d} {clock}" + (millis if base == "datetimez" else "")


def local_value(base: str, text: str, zone: str, want: type) -> date | time | datetime:
    """A Python value of presented text; raises ValueError where it is none.

    As a datetime, a date is its midnight in the zone and a time stands on 1970-01-01 in UTC.
    """
    if base == "date":
        day = date.fromisoformat(text) if _real_date(text) else None
        if day is None:
            raise ValueError(text)
        return datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(zone)) if want is datetime else day
    if base in ("time", "timez"):
        if _real_time(text, _TIMEZ) is None:
            raise ValueError(text)
        clock = time.fromisoformat(text)
        return datetime.combine(date(1970, 1, 1), clock, UTC) if want is datetime else clock
    if encode_temporal("datetimez", text, "UTC") is None:
        raise ValueError(text)
    return datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(zone))


# ------------------------------------------------------------------------------------------------ literals


def literal(value, kind: str, column: str, zone: str = "UTC"):
    """The stored form of a value for a column of a type; raises DataError for any other type of value.

    Types are exact: only an int is taken for a float, a bool is no int and text is never a number.
    """
    base = base_of(kind)
    bad = DataError("TypeMismatch", column=column, type=kind, value=repr(value))
    if base == "timestamp":
        if isinstance(value, (str, date, datetime)):
            return value
        raise bad
    if base == "other":
        return value
    if base == "string":
        if not isinstance(value, str):
            raise bad
        try:
            value.encode("utf-8")
        except UnicodeEncodeError:
            raise DataError("InvalidUtf8", column=column) from None
        return value
    if base == "bool":
        if not isinstance(value, bool):
            raise bad
        return value
    if base in NUMBERS:
        if isinstance(value, bool) or not isinstance(value, (int, float) if base == "float" else int):
            raise bad
        if base == "float":
            value = float(value)
            if not math.isfinite(value):
                raise DataError("NonFiniteFloat", column=column)
            return value
        lo, hi = _RANGES.get(base, (-(2**63), 2**63 - 1))
        if not lo <= value <= hi:
            raise DataError("NumberOutOfRange", column=column, value=value)
        return value
    if not isinstance(value, str):
        raise bad
    stored = encode_temporal(base, value, zone)
    if stored is None:
        raise DataError("InvalidTemporal", column=column, type=kind, value=value)
    return stored


def valid(column: Column, kind: str) -> Column:
    """Whether a stored, non-null value is one of the type (for bulk loads; Spark's type is right already)."""
    base = base_of(kind)
    if base == "float":
        return ~F.isnan(column) & (F.abs(column) < F.lit(float("inf")))
    if base in _RANGES:
        return column.between(*_RANGES[base])
    if base == "date":
        return F.try_to_date(column, "yyyy-MM-dd").isNotNull() & column.rlike(r"\A\d{4}-\d{2}-\d{2}\z")
    if base == "time":
        return column.rlike(r"\A([01]\d|2[0-3]):[0-5]\d:[0-5]\d\z")
    if base == "timez":
        return column.rlike(r"\A([01]\d|2[0-3]):[0-5]\d:[0-5]\d\.\d{3}\z")
    if base in INSTANTS:
        tail = r"\.\d{3}" if base == "datetimez" else ""
        shape = r"\A\d{4}-\d{2}-\d{2} ([01]\d|2[0-3]):[0-5]\d:[0-5]\d" + tail + r"\z"
        return column.rlike(shape) & F.try_to_timestamp(column).isNotNull()
    return F.lit(True)


def encode_column(column: Column, kind: str, zone: str) -> Column:
    """Stored form of a column of presented values (bulk loads); null where an instant cannot be read."""
    base = base_of(kind)
    if base == "timez":
        fraction = F.rpad(F.regexp_extract(column, r"\.(\d{1,3})\z", 1), 3, "0")
        return F.when(column.rlike(r"\A\d{2}:\d{2}:\d{2}(\.\d{1,3})?\z"), F.concat(F.substring(column, 1, 8), F.lit("."), fraction)).otherwise(column)
    if base not in INSTANTS:
        return column
    shown = "yyyy-MM-dd HH:mm:ss" + (".SSS" if base == "datetimez" else "")
    column = F.regexp_replace(column, r"([+-]\d{2})(\d{2})\z", "$1:$2")  # an offset may lack its colon
    offset = column.rlike(r"(Z|[+-]\d{2}:\d{2})\z")
    plain = F.to_utc_timestamp(F.try_to_timestamp(column), zone)
    shifted = F.to_utc_timestamp(F.try_to_timestamp(column), F.expr("current_timezone()"))
    return F.when(column.isNull(), None).otherwise(F.coalesce(F.date_format(F.when(offset, shifted).otherwise(plain), shown), column))
