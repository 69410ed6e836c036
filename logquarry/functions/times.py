"""Timestamps: text to event time, canonical text, buckets. Session zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry import fixed_values as V
from logquarry.functions.patterns import whole_line

ISO = (r"^(\d{4}-\d{2}-\d{2})"
       r"(?:[T ](\d{2}(?::\d{2})?)(:\d{2}(?:\.\d+)?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?$")
LAST_SECOND = 253402300799          # 9999-12-31T23:59:59


def plain_time(ts: Column) -> Column:
    """Text to one of: `=` ISO text, `@` yyyy-Mon-d HH:mm:ss zone:, digits, other text.

    The input is named once and every step nests the one before, so the expression
    stays small when the optimizer copies it into a filter. The two marks are
    taken out of the input first, so no other text can carry one.
    """
    s = F.translate(F.trim(F.coalesce(ts, F.lit(""))), "=@,", "xx.")
    iso = F.regexp_replace(s, ISO, "=$1T$2$3$4")
    return F.regexp_replace(iso, whole_line(V.CLF_TIME), "@$3-$2-$1 $4:$5:$6$7:$8")


def read_time(p: Column, months: dict[str, int] | None = None) -> Column:
    names = {**{m: i + 1 for i, m in enumerate(V.MONTHS)}, **(months or {})}
    number_of = F.create_map(*[x for m, i in names.items() for x in (F.lit(m.lower()), F.lit(f"{i:02d}"))])
    month = F.try_element_at(number_of, F.lower(F.substring(p, 7, 3)))
    dated = F.concat(F.substring(p, 2, 5), month, F.rtrim(F.substring(p, 10, 64), F.lit(":")))
    number, millis = p.try_cast("long"), F.char_length(p) >= 13
    last = F.when(millis, F.lit(LAST_SECOND * 1000 + 999)).otherwise(F.lit(LAST_SECOND))
    return (F.when(p.startswith("="), F.rtrim(F.substring(p, 2, 64), F.lit("T")).try_cast("timestamp"))
            .when(p.startswith("@"), dated.try_cast("timestamp"))
            .when(p.rlike("^[0-9]+$") & (number <= last), F.timestamp_micros(
                number * F.when(millis, F.lit(1000)).otherwise(F.lit(1000000)))))


def event_time(ts: Column, months: dict[str, int] | None = None) -> Column:
    """Access-log time, epoch seconds or milliseconds, or ISO 8601; else NULL.

    With a zone the result is UTC, without one the time is kept as written. The
    text is matched before it is cast: a bare cast also takes `2023` or `10:00`.
    `months` adds month names (their first three letters), e.g. {"ago": 8}.
    """
    return read_time(plain_time(ts), months)


def iso_text(t: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss, plus six fraction digits only when there is a fraction."""
    full = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.coalesce(F.replace(full, F.lit(".000000"), F.lit("")), F.lit(""))


def norm_ts(ts: Column, months: dict[str, int] | None = None) -> Column:
    return iso_text(event_time(ts, months))


def dt_bound(text: str) -> Column | None:
    """End of a time range: canonical if it is a time, else the text as given.

    The whole expression is foldable, so it reaches the scan as a literal.
    """
    text = (text or "").strip()
    if not text:
        return None
    return F.coalesce(F.nullif(norm_ts(F.lit(text)), F.lit("")), F.lit(text))


GRANULARITY = {"min": 16, "hour": 13}


def bucket_label(ts_norm: Column, gran: str = "min") -> Column:
    return F.substring(ts_norm, 1, GRANULARITY["min" if gran == "min" else "hour"])


def bucket_range(label: str) -> tuple[str, str] | None:
    """Half-open [from, to) of a minute or hour label; None for anything else."""
    from datetime import datetime, timedelta
    for size, form, step in ((16, "%Y-%m-%dT%H:%M", timedelta(minutes=1)),
                             (13, "%Y-%m-%dT%H", timedelta(hours=1))):
        if len(label) == size:
            try:
                start = datetime.strptime(label, form)
            except ValueError:
                return None
            stamp = "%Y-%m-%dT%H:%M:%S"
            return start.strftime(stamp), (start + step).strftime(stamp)
    return None
