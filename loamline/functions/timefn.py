"""Age, recency, quarters and trends. "Now" is always a parameter."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000.0
EPOCH = "1970-01-01 00:00:00"
CREATED_KEYS, MODIFIED_KEYS = ("created", "created_at", "date"), ("modified", "updated", "updated_at")
#: Forms of dates in front matter, after those of ISO 8601.
FORMATS = ("MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy/M/d", "M/d/yyyy", "MMM d, yyyy HH:mm:ss", "d MMM yyyy HH:mm:ss Z")


def instant(as_of: str | datetime | Column) -> Column:
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=UTC)
    return F.timestamp_micros(F.lit(int(as_of.timestamp() * 1_000_000)))


def age_days(d: Column, as_of) -> Column:
    """Days since ``d``, with fraction; 0 for the future and for null."""
    return F.coalesce(F.greatest(F.lit(0.0), (F.unix_micros(instant(as_of)) - F.unix_micros(d.cast("timestamp"))) / F.lit(DAY_MICROS)), F.lit(0.0))


def recency(d: Column, half_life_days: Column | float, as_of) -> Column:
    half = half_life_days if isinstance(half_life_days, Column) else F.lit(float(half_life_days))
    return F.exp(-F.log(F.lit(2.0)) * age_days(d, as_of) / F.greatest(F.lit(1.0), half))


def quarter_label(d: Column) -> Column:
    return F.when(d.isNull(), "unknown").otherwise(F.concat(F.year(d).cast("string"), F.lit(" Q"), F.quarter(d).cast("string")))


def era_label(first: Column, last: Column) -> Column:
    a, b = quarter_label(first), quarter_label(last)
    return F.when(first.isNull(), "unknown").when(a == b, a).otherwise(F.concat(a, F.lit(" to "), b))


def trend(recent: Column, previous: Column, freshest: Column) -> Column:
    """From the dates up to 90 days old, those up to a year old before that, and the least age (null: no dates)."""
    return F.when(freshest.isNull(), "stable").when(recent >= F.greatest(F.lit(2.0), previous * 1.35), "rising").when(freshest <= 120, "active").when(freshest > 365, "dormant").otherwise("stable")


def parse_date(c: Column) -> Column:
    """A date as typed in front matter, in UTC; null where it isn't one."""
    t = F.regexp_replace(F.trim(c), r"\A[A-Z][a-z]{2}, ", "")
    iso = F.coalesce(F.try_to_timestamp(t), F.when(t.rlike(r"\A[0-9]{4}-[0-9]{2}\z"), F.try_to_timestamp(F.concat(t, F.lit("-01")))), F.when(t.rlike(r"\A[0-9]{4}\z"), F.try_to_timestamp(F.concat(t, F.lit("-01-01")))))
    return F.coalesce(iso, *[F.try_to_timestamp(t, F.lit(f)) for f in FORMATS])


def frontmatter_date(fm: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys that holds a date."""
    return F.coalesce(*[F.when(~fm[k]["is_list"], parse_date(fm[k]["values"][0])) for k in keys])


def iso(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
