"""Timestamps and buckets as Column expressions, free of the session's time zone for timestamps without one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_s(ts: Column) -> Column:
    """Whole seconds since 1970-01-01 of the wall-clock fields of a timestamp (UTC for a session in UTC)."""
    return (F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def epoch_us(ts: Column) -> Column:
    return epoch_s(ts) * 1_000_000 + F.date_format(ts, "SSSSSS").cast("long")


def event_time(published: Column, created: Column) -> Column:
    """published_ts, or created_at where that is missing."""
    return F.coalesce(published, created)


def floor_to(x: Column, size: int, anchor: Column | int = 0) -> Column:
    """The start of the bucket of ``size`` that holds the integer ``x``, counted from ``anchor``."""
    base = F.lit(anchor) if isinstance(anchor, int) else anchor
    return (x - F.pmod(x - base, F.lit(size))).cast("long")


def minute_anchor(us: Column, minutes: int) -> Column:
    """A microsecond time floored to its minute, that minute to a multiple of ``minutes`` within the hour."""
    minute = F.pmod(F.floor(us / 60_000_000), F.lit(60))
    hour = us - F.pmod(us, F.lit(3_600_000_000))
    return (hour + (minute - F.pmod(minute, F.lit(minutes))) * 60_000_000).cast("long")


def parse_timestamp(text: Column) -> Column:
    """The first format that fits: ISO with or without zone, mail dates, compact stamps, epoch seconds; else null."""
    trimmed = F.trim(text)
    # Spark's parser doesn't read names of weekdays.
    mail = F.regexp_replace(trimmed, r"^[A-Za-z]{3,9},\s*", "")
    epoch = F.when(trimmed.rlike(r"^\d{9,11}(\.\d+)?$"), F.timestamp_seconds(trimmed.try_cast("double")))
    stamp = F.when(trimmed.rlike(r"^\d{14}$"), F.try_to_timestamp(trimmed, F.lit("yyyyMMddHHmmss")))
    compact = F.when(trimmed.rlike(r"^\d{8}T\d{6}"), F.try_to_timestamp(trimmed, F.lit("yyyyMMdd'T'HHmmssX")))
    named = [F.when(mail.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}"), F.try_to_timestamp(mail, F.lit(form))) for form in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z")]
    plain = F.when(~trimmed.rlike(r"^\d{8,}"), F.try_to_timestamp(trimmed))
    return F.coalesce(stamp, compact, epoch, *named, plain)


def session_name(local: Column) -> Column:
    """The market session of a New York wall-clock time: the cut-offs are minutes of the day."""
    m, day = F.hour(local) * 60 + F.minute(local), F.weekday(local)
    closed = (day == 5) | ((day == 6) & (m < 18 * 60))
    return (
        F.when(local.isNull(), None)
        .when(closed, "weekend")
        .when(m < 240, "overnight")
        .when(m < 570, "pre_open")
        .when(m < 660, "open")
        .when(m < 840, "lunch")
        .when(m < 990, "close")
        .when(m < 1200, "after_hours")
        .otherwise("overnight")
    )


#: All sessions in their order of the day.
SESSIONS = ["pre_open", "open", "lunch", "close", "after_hours", "overnight", "weekend"]
