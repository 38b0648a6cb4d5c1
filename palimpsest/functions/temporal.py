"""Deadlines derived from wording, and UTC text output."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from palimpsest import constants as C
from palimpsest.functions.text import casefold

HOURS_PER_UNIT = {"hour": 1, "day": 24, "week": 7 * 24, "month": 30 * 24}


def plus_hours(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(hours=hours)


def event_valid_to(user_content: Column, temporal_scope: Column, captured_at: Column) -> Column:
    """End of validity named by the wording plus a week of grace, otherwise the review window."""
    wording = casefold(F.concat_ws(" ", user_content, F.coalesce(temporal_scope, F.lit(""))))
    amount = F.regexp_extract(wording, C.RELATIVE_DURATION, 1).try_cast("int")
    unit = F.regexp_extract(wording, C.RELATIVE_DURATION, 2)
    unit_hours = F.lit(0)
    for name, hours in HOURS_PER_UNIT.items():
        unit_hours = F.when(unit == name, F.lit(hours)).otherwise(unit_hours)
    grace = F.lit(24 * C.EVENT_GRACE_DAYS)
    hours = (F.when(wording.contains("tomorrow"), F.lit(24) + grace)
             .when(amount.isNotNull(), amount * unit_hours + grace)
             .otherwise(F.lit(24 * C.EVENT_REVIEW_DAYS)))
    return plus_hours(captured_at, hours)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
