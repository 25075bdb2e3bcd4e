"""Calendar functions of an injected instant; the catalogue's calendar is that of Europe/Madrid."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = ZoneInfo("Europe/Madrid")


def local_date(now: datetime) -> date:
    return (now if now.tzinfo else now.replace(tzinfo=timezone.utc)).astimezone(ZONE).date()


def retention_cutoff(now: datetime, days: int = 0) -> str:
    """The local date ``days`` before now; what ended earlier has expired."""
    if days < 0:
        raise ValueError("days must not be negative")
    return (local_date(now) - timedelta(days)).isoformat()


def horizon(now: datetime, days: int = 90) -> tuple[str, str]:
    """Today and the last day of the look-ahead, both included."""
    today = local_date(now)
    return today.isoformat(), (today + timedelta(days)).isoformat()


def inactive_cutoff(now: datetime, days: int = 7) -> str:
    """The instant ``days`` times 24 hours before now, as text that sorts like the stored ones."""
    at = (now if now.tzinfo else now.replace(tzinfo=timezone.utc)).astimezone(timezone.utc) - timedelta(hours=24 * days)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def quick_range(kind: str, today: date) -> tuple[str, str]:
    """First and last day of today, tomorrow, the next seven days or the weekend (Friday to Sunday, what is left of it)."""
    if kind == "today":
        days = (0, 0)
    elif kind == "tomorrow":
        days = (1, 1)
    elif kind == "next7":
        days = (0, 6)
    elif kind == "weekend":
        to_sunday = 6 - today.weekday()
        days = (max(0, to_sunday - 2), to_sunday)
    else:
        raise ValueError(f"unknown range: {kind}")
    return tuple((today + timedelta(d)).isoformat() for d in days)


# ---- the same of a column of instants or days ------------------------------------------------


def local_day(at: Column) -> Column:
    """The local date of an instant (a timestamp in a session in UTC)."""
    return F.to_date(F.from_utc_timestamp(at, ZONE.key))


def retention_day(at: Column, days: int = 0) -> Column:
    return F.date_format(F.date_sub(local_day(at), days), "yyyy-MM-dd")


def horizon_days(at: Column, days: int = 90) -> tuple[Column, Column]:
    today = local_day(at)
    return F.date_format(today, "yyyy-MM-dd"), F.date_format(F.date_add(today, days), "yyyy-MM-dd")


def inactive_instant(at: Column, days: int = 7) -> Column:
    return F.date_format(at - F.expr(f"INTERVAL {24 * days} HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def quick_days(kind: str, today: Column) -> tuple[Column, Column]:
    """``quick_range`` of a column of dates."""
    to_sunday = 6 - F.weekday(today)
    days = {"today": (F.lit(0), F.lit(0)), "tomorrow": (F.lit(1), F.lit(1)), "next7": (F.lit(0), F.lit(6)), "weekend": (F.greatest(F.lit(0), to_sunday - 2), to_sunday)}
    return tuple(F.date_format(F.date_add(today, d), "yyyy-MM-dd") for d in days[kind])
