"""Fiscal calendar and tolerant date parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

OPERATING_ZONE = "Asia/Kolkata"


def fiscal_year(d: Column) -> Column:
    """April-March year, named after the calendar year it ends in."""
    return F.year(F.add_months(d, 9))


def fiscal_quarter(d: Column) -> Column:
    return F.quarter(F.add_months(d, 9))


def lenient_date(text: Column) -> Column:
    """Date of an ISO date (or timestamp) text, NULL for anything else."""
    iso = text.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T].*)?\s*$")
    return F.when(iso, F.trim(text).try_cast("date"))


# Timestamp format of each feed.
FEED_FORMATS = {
    "ERP_WEB": "dd/MM/yyyy HH:mm",
    "PARTNER_API": "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "SFA_MOBILE": "yyyy-MM-dd HH:mm:ss",
    "TELEMATICS_A": "yyyy-MM-dd HH:mm:ss",
    "TELEMATICS_B": "dd-MMM-yyyy hh:mm a",
}
DEFAULT_FORMAT = "yyyy-MM-dd HH:mm:ss"
UTC_FEEDS = ("PARTNER_API",)


def _parsed(text: Column, fmt: str) -> Column:
    """Wall-clock time of a text, NULL if it does not fit.

    Read as if it were UTC and counted from the epoch, so that the session's zone, with
    its hours that do not exist, has no part in it.
    """
    instant = F.try_to_timestamp(F.concat(text, F.lit(" +00:00")), F.lit(fmt + " xxx"))
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def strict_timestamp(text: Column, fmt: str = DEFAULT_FORMAT) -> Column:
    """Parse or fail the query: a known feed must not go quietly bad, in any ANSI mode."""
    ts = _parsed(text, fmt)
    bad = F.raise_error(F.concat(F.lit(f"not a '{fmt}' timestamp: "), text)).cast("timestamp_ntz")
    return F.when(text.isNotNull() & ts.isNull(), bad).otherwise(ts)


def feed_timestamp(text: Column, feed: Column, shift_utc: bool = True) -> Column:
    """Timestamp whose format depends on the feed it came from.

    Known feeds fail on bad text, unknown ones give NULL. Feeds that write UTC are
    shifted to the operating zone unless ``shift_utc`` is off.
    """
    out = _parsed(text, DEFAULT_FORMAT)
    for name, fmt in FEED_FORMATS.items():
        ts = strict_timestamp(text, fmt)
        if shift_utc and name in UTC_FEEDS:
            ts = utc_to_operating_zone(ts)
        out = F.when(feed == name, ts).otherwise(out)
    return out


def utc_to_operating_zone(ts_ntz: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(OPERATING_ZONE), ts_ntz)


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")
