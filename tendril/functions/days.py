"""Day arithmetic (D-1 .. D-5) on timestamp_ntz columns.

Three different "number of days" rules exist in the source and are kept
apart on purpose:

* ``whole_days(a, b)``: whole 24-hour days of ``a - b``, truncated toward
  zero (SQL ``EXTRACT(DAY FROM a - b)``).
* ``calendar_days(a, b)``: difference of calendar dates (``date - date``).
* ``floor_days(a, b)``: days of a Python timedelta, i.e. floored.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the open end of a validity interval.
END_OF_TIME = "9999-12-31 23:59:59"

_MICROS_PER_DAY = 86_400_000_000


def as_ts(value) -> Column:
    """A timestamp_ntz literal from a string, date or naive datetime.

    ``None`` means "now": the session's local time as timestamp_ntz, fixed
    for one query (one micro-batch in a stream)."""
    if value is None:
        return F.localtimestamp()
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, _dt.date):
        value = value.strftime("%Y-%m-%d 00:00:00")
    return F.lit(str(value)).cast("timestamp_ntz")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole_days(a, b) -> Column:
    """EXTRACT(DAY FROM a - b): whole 24h days, truncated toward zero (int)."""
    return F.extract(F.lit("DAY"), _col(a) - _col(b)).cast("int")


def calendar_days(a, b) -> Column:
    """Calendar-day difference date(a) - date(b) (int)."""
    return F.datediff(_col(a).cast("date"), _col(b).cast("date"))


def floor_days(a, b) -> Column:
    """Python ``(a - b).days``: floor of the day count (int).

    Computed on the timestamp_ntz interval itself, so no session time zone
    (and no daylight-saving hour) enters."""
    iv = _col(a) - _col(b)
    d = F.extract(F.lit("DAY"), iv).cast("int")
    partial = iv != F.make_dt_interval(days=d)
    return F.when((iv < F.make_dt_interval(days=F.lit(0))) & partial, d - 1).otherwise(d)


def add_days(ts, n) -> Column:
    """ts + n days (n may be a column or an int)."""
    n = F.lit(n) if not isinstance(n, Column) else n
    return _col(ts) + F.make_dt_interval(days=n.cast("int"))


def add_hours(ts, n) -> Column:
    n = F.lit(n) if not isinstance(n, Column) else n
    return _col(ts) + F.make_dt_interval(hours=n.cast("int"))


def format_date(c, with_time: bool = False, seconds: bool = False) -> Column:
    """D-6: ``dd.MM.yyyy`` or ``dd.MM.yyyy HH:mm(:ss)``."""
    fmt = "dd.MM.yyyy" + (" HH:mm" if with_time else "") + (":ss" if with_time and seconds else "")
    return F.date_format(_col(c), fmt)


def parse_form_datetime(c) -> Column:
    """D-7: parse ``yyyy-MM-dd HH:mm`` form input; bad input -> NULL."""
    return F.try_to_timestamp(_col(c), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")


def ntz_micros(c) -> Column:
    """Microseconds since 1970-01-01 00:00 of a timestamp_ntz, computed on the
    interval itself: monotone and independent of the session time zone (a
    cast to TIMESTAMP would map wall-clock times in a daylight-saving gap out
    of order)."""
    iv = _col(c) - as_ts("1970-01-01 00:00:00")
    whole = (
        F.extract(F.lit("DAY"), iv).cast("long") * F.lit(86_400_000_000)
        + F.extract(F.lit("HOUR"), iv).cast("long") * F.lit(3_600_000_000)
        + F.extract(F.lit("MINUTE"), iv).cast("long") * F.lit(60_000_000)
    )
    return whole + (F.extract(F.lit("SECOND"), iv) * F.lit(1_000_000)).cast("long")
