"""Times of chat exports as epoch milliseconds in UTC; what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatloom.functions.text import trim

_NUMBER = r"\A[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"


def _millis(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Epoch milliseconds of a date and time; a day past the month's end rolls over."""
    first = F.make_date(year, month, F.lit(1))
    return F.unix_date(F.date_add(first, day - 1)).cast("long") * 86_400_000 + (hour.cast("long") * 3600 + minute * 60 + second) * 1000


def epoch_to_ms(x: Column) -> Column:
    """Seconds or milliseconds (as text or number) to milliseconds: below 1e12 they are seconds; null unless positive."""
    text = trim(x.cast("string"))
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    number = F.when((number > 0) & (number < 9e15), number)
    return F.when(number < 1e12, number * 1000).otherwise(number).cast("long")


def parse_iso_ms(x: Column) -> Column:
    """ISO dates and times, and the forms ``June 13, 2025 22:27[:37]`` and ``2025/06/13 22:27``; without a zone, UTC."""
    text = trim(x)
    iso = text.rlike(r"\A\d{4}-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?)?\z")
    zoned = F.regexp_replace(text, r"([+-]\d{2})(\d{2})\z", "$1:$2")
    stamp = F.when(text.rlike(r"\A\d{4}-\d{2}\z"), F.concat(text, F.lit("-01"))).when(text.rlike(r"\d{2}:\d{2}.*[+-]\d{4}\z"), zoned).otherwise(text)
    found = F.when(iso, F.unix_millis(stamp.try_cast("timestamp")))
    for pattern in ("yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d", "MMMM d, yyyy H:mm:ss", "MMMM d, yyyy H:mm", "MMMM d, yyyy", "MMM d, yyyy"):
        found = F.coalesce(found, F.unix_millis(F.try_to_timestamp(text, F.lit(pattern))))
    return found


def parse_ts(x: Column) -> Column:
    """A message's own time: a number, or text of digits, is milliseconds already; other text is a date."""
    text = trim(x)
    return F.when(text.rlike(_NUMBER), text.try_cast("double").try_cast("long")).otherwise(parse_iso_ms(text))


#: Month names, and the form of a spoken date.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SPOKEN = r"(?i)\A([a-z]+)\s+(\d{1,2}),\s+(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([ap])\.?m\.?\z"


def parse_spoken_ms(x: Column) -> Column:
    """``May 19, 2023 10:07[:30]pm`` or ``p.m.``: the first month that begins with the letters, 12-hour clock, UTC."""
    text = trim(x)
    part = lambda i: F.regexp_extract(text, SPOKEN, i)
    number = lambda i: F.coalesce(F.when(part(i) != "", part(i).try_cast("int")), F.lit(0))
    month = F.coalesce(*(F.when(F.lit(m).startswith(F.lower(part(1))), F.lit(i + 1)) for i, m in enumerate(MONTHS)))
    hour = number(4) % 12 + F.when(F.lower(part(7)) == "p", 12).otherwise(0)
    return F.when(text.rlike(SPOKEN) & month.isNotNull(), _millis(number(3), month, number(2), hour, number(5), number(6)))


def parse_send_date(x: Column) -> Column:
    """An epoch number, else a date, else a spoken date."""
    text = trim(x.cast("string"))
    return F.when(text.rlike(_NUMBER), epoch_to_ms(text)).otherwise(F.coalesce(parse_iso_ms(text), parse_spoken_ms(text)))


def header_ms(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """The time of a ``MM-DD HH:MM[:SS]`` header in a given year, or null where a part is out of range."""
    fits = month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & (second <= 59)
    return F.when(fits, _millis(year, F.when(fits, month).otherwise(1), day, hour, minute, second))


def stamp(ts_ms: Column) -> Column:
    return F.timestamp_millis(ts_ms)


def iso_week(ts_ms: Column) -> Column:
    """The ISO week, ``2026-W24``; ``unknown`` for null."""
    day = F.to_date(stamp(ts_ms))
    year = F.extract(F.lit("YEAROFWEEK"), day).cast("string")
    return F.coalesce(F.concat(F.lpad(year, 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0")), F.lit("unknown"))


def iso_text(ts_ms: Column) -> Column:
    """``2026-06-08T10:00:00.000Z``"""
    return F.date_format(stamp(ts_ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def plain_text(ts_ms: Column) -> Column:
    """``2026-06-08 10:00:00``, or ``[--:--]`` for null."""
    return F.coalesce(F.date_format(stamp(ts_ms), "yyyy-MM-dd HH:mm:ss"), F.lit("[--:--]"))
