"""Column-level helpers (built-in expressions only, no UDFs)."""

from tendril.functions.days import (  # noqa: F401
    END_OF_TIME,
    add_days,
    as_ts,
    calendar_days,
    floor_days,
    whole_days,
)
