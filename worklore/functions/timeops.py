"""Event-time expressions.  Sessions run with the time zone pinned to UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_DATE_FIRST = r"^\d{4}-?\d{2}-?\d{2}"
_OFFSET = r"(?:Z|z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)$"


def _extended(value: Column) -> Column:
    """Rewrite the compact ISO form to the dashed one."""
    dashed = F.regexp_replace(value, r"^(\d{4})(\d{2})(\d{2})(?!\d)", "$1-$2-$3")
    return F.regexp_replace(dashed, r"^(\d{4}-\d{2}-\d{2}[T ])(\d{2})(\d{2})(\d{2})(?!\d)", "$1$2:$3:$4")


def event_time(value: Column) -> Column:
    """UTC timestamp of an ISO value that states its offset, else NULL."""
    has_offset = value.rlike(_DATE_FIRST) & F.substring(value, 11, 64).rlike(_OFFSET)
    return F.when(has_offset, F.try_to_timestamp(_extended(value)))


def time_status(value: Column) -> Column:
    parsed = F.when(value.rlike(_DATE_FIRST), F.try_to_timestamp(_extended(value)))
    return (
        F.when(value.isNull() | (value == ""), "missing")
        .when(parsed.isNull(), "invalid")
        .when(event_time(value).isNull(), "naive")
        .otherwise("known")
    )


def epoch_time(seconds: Column) -> Column:
    micros = seconds.cast("double") * 1e6
    return F.when(F.abs(micros) < 2.5e17, F.timestamp_micros(F.round(micros).cast("long")))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def local_day(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def day_start(day: str | Column, zone: str, plus_days: int = 0) -> Column:
    """UTC instant at which a local calendar day begins."""
    value = F.to_date(F.lit(day)) if isinstance(day, str) else day
    return F.to_utc_timestamp(F.date_add(value, plus_days).cast("timestamp"), zone)


def within_days(ts: Column, start: str, end: str | None, zone: str) -> Column:
    """Half-open UTC interval covering the local days start..end."""
    if end is not None and end < start:
        raise ValueError("end_date_before_start")
    return (ts >= day_start(start, zone)) & (ts < day_start(end or start, zone, 1))
