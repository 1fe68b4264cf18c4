"""Time helpers: epoch milliseconds, relative times, periods."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, functions as F

# Seconds per unit of period and up-time text.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "y": 31536000}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_ms_to_ts(c, tz: str | None = None) -> Column:
    """Epoch milliseconds to a timestamp, shifted to wall-clock time of ``tz`` if given."""
    ts = F.timestamp_millis(_col(c).cast("bigint"))
    return F.from_utc_timestamp(ts, tz) if tz else ts


def to_epoch_ms(value, tz: str = "UTC") -> int | None:
    """ISO text, datetime or epoch milliseconds to epoch milliseconds."""
    if value is None or value == "":
        return None
    if isinstance(value, (int, float)):
        return int(value)
    moment = value if isinstance(value, datetime) else datetime.fromisoformat(value)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=ZoneInfo(tz))
    return int(moment.timestamp() * 1000)


def period_ms(period: str) -> int:
    """``'15m'``, ``'1h'``, ``'1d'``, ``'1w'`` to milliseconds."""
    count, unit = period[:-1], period[-1:]
    if unit not in ("m", "h", "d", "w") or not count.isdigit() or int(count) == 0:
        raise ValueError(f"invalid period: {period!r}")
    return int(count) * UNIT_SECONDS[unit] * 1000


def _amount(c: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(c, pattern, 1).try_cast("bigint"), F.lit(0))


def reltime_seconds(c) -> Column:
    """Length of an up-time text in seconds, calendar months not included.

    Understands ``1d12h3m23s``, ``10 weeks, 4 days``, ``01:20:35``,
    ``P1DT2H3M4S`` and ``{"junos:seconds": "9"}``; anything else is null.
    """
    c = F.trim(_col(c))
    clock = (
        _amount(c, r"^(\d+):\d+:\d+$") * 3600
        + _amount(c, r"^\d+:(\d+):\d+$") * 60
        + _amount(c, r"^\d+:\d+:(\d+)$")
    )
    day_part = F.regexp_extract(c, r"^P([^T]*)", 1)
    time_part = F.regexp_extract(c, r"T(.*)$", 1)
    iso = (
        _amount(day_part, r"(\d+)W") * 604800 + _amount(day_part, r"(\d+)D") * 86400
        + _amount(time_part, r"(\d+)H") * 3600 + _amount(time_part, r"(\d+)M") * 60
        + _amount(time_part, r"(\d+)S")
    )
    units = (
        _amount(c, r"(\d+)\s*y") * 31536000 + _amount(c, r"(\d+)\s*w") * 604800
        + _amount(c, r"(\d+)\s*d") * 86400 + _amount(c, r"(\d+)\s*h") * 3600
        + _amount(c, r"(\d+)\s*m") * 60 + _amount(c, r"(\d+)\s*s")
    )
    junos = F.get_json_object(c, "$['junos:seconds']").try_cast("bigint")
    return (
        F.when(c.startswith("{"), junos)
        .when(c.rlike(r"^\d+:\d+:\d+$"), clock)
        .when(c.rlike(r"^P(?=.)"), iso)
        .when(c.rlike(r"^(?:\d+\s*(?:y|w|d|h|m|s)[a-z]*[,\s]*)+$"), units)
    )


def reltime_to_epoch(c, base_ms) -> Column:
    """Moment in epoch milliseconds that lies the given up-time before ``base_ms``."""
    c, base = F.trim(_col(c)), _col(base_ms)
    day_part = F.regexp_extract(c, r"^P([^T]*)", 1)
    months = _amount(day_part, r"(\d+)Y") * 12 + _amount(day_part, r"(\d+)M")
    start = F.timestamp_millis(base.cast("bigint"))
    whole_months = F.unix_millis(start - F.make_ym_interval(F.lit(0), months.cast("int")))
    shifted = F.when(c.startswith("P") & (months > 0), whole_months).otherwise(base)
    return (shifted - reltime_seconds(c) * 1000).cast("bigint")
