"""Time parsing/formatting and duration helpers.

All timestamps are Spark TIMESTAMP values in a UTC session (see
:mod:`feedloom.session`).
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col_

# The eight accepted published-time layouts, in trial order.
#   RFC3339, RFC3339Nano, RFC1123Z, RFC1123, RFC822Z, RFC822,
#   "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
_DAY = r"(Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
_RFC1123Z = r"^" + _DAY + r", (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) ([+-]\d{4})$"
_RFC1123 = r"^" + _DAY + r", (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) ([A-Z][A-Za-z]{2,4})$"
_RFC822Z = r"^(\d{2} [A-Za-z]{3}) (\d{2}) (\d{2}:\d{2}) ([+-]\d{4})$"
_RFC822 = r"^(\d{2} [A-Za-z]{3}) (\d{2}) (\d{2}:\d{2}) ([A-Z][A-Za-z]{2,4})$"
_PLAIN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"
# Comment timestamps of the bookmark service, minute precision, UTC.
COMMENT_TIME_PATTERN = "yyyy/MM/dd HH:mm"
_COMMENT_RE = r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}$"
EPOCH_RFC3339 = "1970-01-01T00:00:00Z"


def ts_lit(value) -> Column:
    """A TIMESTAMP literal from a datetime/ISO string (naive = UTC)."""
    if isinstance(value, str):
        value = _dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    if value.tzinfo is None:
        value = value.replace(tzinfo=_dt.timezone.utc)
    iso = value.astimezone(_dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    return F.lit(iso).cast("timestamp")


def _two_digit_year(yy: Column) -> Column:
    return F.when(yy.cast("int") >= 69, F.concat(F.lit("19"), yy)).otherwise(F.concat(F.lit("20"), yy))


def parse_feed_time(c) -> Column:
    """Parse a raw feed date with the eight layouts; null when none fits."""
    s = col_(c)
    g = lambda rx, i: F.regexp_extract(s, rx, i)
    rfc822 = lambda rx, zone: F.concat(
        F.initcap(g(rx, 1)), F.lit(" "), _two_digit_year(g(rx, 2)), F.lit(" "), g(rx, 3), zone)
    return (
        F.when(s.rlike(_ISO), s.try_cast("timestamp"))
        .when(s.rlike(_RFC1123Z), F.try_to_timestamp(
            F.concat(F.initcap(g(_RFC1123Z, 2)), F.lit(" "), g(_RFC1123Z, 3)),
            F.lit("dd MMM yyyy HH:mm:ss Z")))
        .when(s.rlike(_RFC1123), F.try_to_timestamp(F.initcap(g(_RFC1123, 2)),
                                                     F.lit("dd MMM yyyy HH:mm:ss")))
        .when(s.rlike(_RFC822Z), F.try_to_timestamp(
            rfc822(_RFC822Z, F.concat(F.lit(" "), g(_RFC822Z, 4))), F.lit("dd MMM yyyy HH:mm Z")))
        .when(s.rlike(_RFC822), F.try_to_timestamp(rfc822(_RFC822, F.lit("")),
                                                    F.lit("dd MMM yyyy HH:mm")))
        .when(s.rlike(_PLAIN), F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")))
        .when(s.rlike(_DATE), F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))
    )


def published_time(df: DataFrame) -> Column:
    """published -> updated -> raw published text -> raw updated text."""
    cols = set(df.columns)
    parts = [F.col(c) for c in ("published_at", "updated_at") if c in cols]
    parts += [parse_feed_time(F.col(c)) for c in ("published_raw", "updated_raw") if c in cols]
    return F.coalesce(*parts) if parts else F.lit(None).cast("timestamp")


def comment_time(c) -> Column:
    """Comment timestamp ``yyyy/MM/dd HH:mm`` (UTC); null when malformed."""
    s = col_(c)
    return F.when(s.rlike(_COMMENT_RE), F.try_to_timestamp(s, F.lit(COMMENT_TIME_PATTERN)))


def rfc3339(c) -> Column:
    """Format as RFC3339 seconds precision, 'Z' for UTC."""
    return F.date_format(col_(c), "yyyy-MM-dd'T'HH:mm:ssXXX")


def parse_rfc3339(c) -> Column:
    s = col_(c)
    return F.when(s.rlike(_ISO), s.try_cast("timestamp"))


def age_hours(published: Column, now: Column) -> Column:
    """Hours from published to now, microsecond precision (null if missing)."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / F.lit(3.6e9)


# --- Go-style durations -----------------------------------------------------

_UNITS_NS = {"ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000,
             "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
_DUR_PART = re.compile(r"([0-9]*(?:\.[0-9]*)?)(ns|us|µs|μs|ms|s|m|h)")


def parse_duration(value) -> int:
    """Duration in nanoseconds from ``'24h'``, ``'1h30m'``, a timedelta or seconds."""
    if value is None:
        return 0
    if isinstance(value, _dt.timedelta):
        return int(round(value.total_seconds() * 1e9))
    if isinstance(value, (int, float)):
        return int(round(value * 1e9))
    s = str(value).strip()
    if not s:
        raise ValueError("duration is blank")
    sign = 1
    if s[0] in "+-":
        sign = -1 if s[0] == "-" else 1
        s = s[1:]
    if s == "0":
        return 0
    pos, total = 0, 0.0
    while pos < len(s):
        m = _DUR_PART.match(s, pos)
        if not m or m.group(1) in ("", "."):
            raise ValueError(f"time: invalid duration {value!r}")
        total += float(m.group(1)) * _UNITS_NS[m.group(2)]
        pos = m.end()
    if pos == 0:
        raise ValueError(f"time: invalid duration {value!r}")
    return sign * int(round(total))


def duration_string(ns: int) -> str:
    """Render nanoseconds like Go's Duration.String (``24h0m0s``, ``1.5s``)."""
    if ns == 0:
        return "0s"
    neg = ns < 0
    u = -ns if neg else ns
    if u < 1_000_000_000:
        for unit, size in (("ms", 1_000_000), ("µs", 1_000), ("ns", 1)):
            if u >= size:
                out = _frac(u, size) + unit
                break
    else:
        h, rem = divmod(u, 3_600_000_000_000)
        m, rem = divmod(rem, 60_000_000_000)
        sec = _frac(rem, 1_000_000_000) + "s"
        out = (f"{h}h{m}m" if h else (f"{m}m" if m else "")) + sec
    return ("-" if neg else "") + out


def _frac(v: int, size: int) -> str:
    whole, rem = divmod(v, size)
    if not rem:
        return str(whole)
    digits = len(str(size)) - 1
    return f"{whole}." + f"{rem:0{digits}d}".rstrip("0")
