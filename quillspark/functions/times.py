"""Time expressions. Slots are at 08:00 and 20:00 UTC (17:00 and 05:00 in Seoul), days those of Seoul."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT_HOURS, SLOT_START, SEOUL = 12, 8, 9


def hours(n: float) -> Column:
    return F.make_dt_interval(hours=F.lit(int(n)))


def latest_slot(ts: Column) -> Column:
    """The slot at or before ts."""
    at = F.unix_seconds(ts.cast("timestamp"))
    step = SLOT_HOURS * 3600
    return F.timestamp_seconds(at - F.pmod(at - SLOT_START * 3600, F.lit(step)))


def arrival_slot(ts: Column) -> Column:
    """The first slot at or after ts."""
    ts = ts.cast("timestamp")
    return F.when(latest_slot(ts) == ts, ts).otherwise(latest_slot(ts) + hours(SLOT_HOURS))


def due_slot(now: Column) -> Column:
    """The latest slot that is shown, an hour after it began."""
    return latest_slot(now - hours(1))


def slot_key(slot: Column) -> Column:
    return F.date_format(slot, "yyyy-MM-dd'T'HH:mm'Z'")


def seoul_date(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp") + hours(SEOUL), "yyyy-MM-dd")


def seoul_day(ts: Column) -> Column:
    """Start of the day in Seoul, in UTC."""
    return F.date_trunc("day", ts.cast("timestamp") + hours(SEOUL)) - hours(SEOUL)


def compact_time(text: Column) -> Column:
    """yyyyMMddHHmmss in UTC; null if it is none."""
    return F.when(text.rlike("^[0-9]{14}$"), F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")))


def format_compact(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def window_of(ts: Column, window: str) -> Column:
    """Start of the rate window: a minute, or a day in Seoul."""
    return F.date_trunc("minute", ts.cast("timestamp")) if window == "minute" else seoul_day(ts)


def relative_time(at: Column, now: Column) -> Column:
    """now, minutes, hours, then a date, with its year if it is another one; an error if it lies ahead."""
    seconds = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))
    local, today = at.cast("timestamp") + hours(SEOUL), now.cast("timestamp") + hours(SEOUL)
    date = F.when(F.year(local) == F.year(today), F.date_format(local, "M-d")).otherwise(F.date_format(local, "yyyy-M-d"))
    return (
        F.when(seconds < 0, F.raise_error(F.lit("the time lies ahead")))
        .when(seconds < 60, "now")
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" h")))
        .otherwise(date)
    )


# Minutes until the next try by number of failures; then hourly.
RETRY_MINUTES = (1, 5, 30, 60)


def next_attempt(failures: Column, failed_at: Column) -> Column:
    wait = F.element_at(F.array(*map(F.lit, RETRY_MINUTES)), F.least(F.greatest(failures, F.lit(1)), F.lit(len(RETRY_MINUTES))).cast("int"))
    return failed_at.cast("timestamp") + F.make_dt_interval(mins=wait)


def bin_label(start: Column, hours_long: int) -> Column:
    """A span of the coverage chart in Seoul: `2026. 9. 17. 06:00~12:00`, of a whole day `2026. 9. 17.`."""
    at = start.cast("timestamp") + hours(SEOUL)
    day = F.date_format(at, "yyyy. M. d.")
    if hours_long == 24:
        return day
    clock = lambda h: F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":00"))
    return F.concat(day, F.lit(" "), clock(F.hour(at)), F.lit("~"), clock(F.hour(at) + hours_long))


def story_window(first: Column, batch: Column) -> Column:
    """From a day before a story's first report to the batch."""
    return F.struct((first.cast("timestamp") - hours(24)).alias("start"), batch.cast("timestamp").alias("end"))
