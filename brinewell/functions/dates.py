"""Date functions as column expressions; unreadable texts give null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ntz(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def parse_datetime(text: Column) -> Column:
    """The first 26 characters read as 'T' seconds, 'T' fractions, space seconds or a date; an offset gives null."""
    t = F.substring(text, 1, 26)
    time = F.when(t.rlike("^\\d{4}-\\d{1,2}-\\d{1,2}T\\d{1,2}:\\d{1,2}:\\d{1,2}$"), _ntz(t, "y-M-d'T'H:m:s"))
    fine = F.when(t.rlike("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}\\.\\d{1,6}$"), t.try_cast("timestamp_ntz"))
    space = F.when(t.rlike("^\\d{4}-\\d{1,2}-\\d{1,2} \\d{1,2}:\\d{1,2}:\\d{1,2}$"), _ntz(t, "y-M-d H:m:s"))
    date = F.when(t.rlike("^\\d{4}-\\d{1,2}-\\d{1,2}$"), _ntz(t, "y-M-d"))
    return F.coalesce(time, fine, space, date)


def index_date(text: Column) -> Column:
    """The first 19 characters, 'T' as a space."""
    return F.replace(F.substring(text, 1, 19), F.lit("T"), F.lit(" "))


#: Date spellings in the order they are tried (fixed values): what is found, how it is read.
SCAN = (
    ("(\\d{4}-\\d{1,2}-\\d{1,2}\\s+\\d{1,2}:\\d{1,2}:\\d{1,2})", "y-M-d H:m:s"),
    ("(\\d{4}-\\d{1,2}-\\d{1,2}\\s+\\d{1,2}:\\d{1,2})", "y-M-d H:m"),
    ("(\\d{4}-\\d{1,2}-\\d{1,2})", "y-M-d"),
    ("(\\d{4}/\\d{1,2}/\\d{1,2}\\s+\\d{1,2}:\\d{1,2})", "y/M/d H:m"),
    ("(\\d{4}/\\d{1,2}/\\d{1,2})", "y/M/d"),
    ("(\\d{4}年\\d{1,2}月\\d{1,2}日\\s*\\d{1,2}:\\d{1,2})", "y年M月d日 H:m"),
    ("(\\d{4}年\\d{1,2}月\\d{1,2}日)", "y年M月d日"),
)
#: The crawler's shorter list (fixed values).
SCAN_CRAWL = (SCAN[1], SCAN[2], SCAN[5], SCAN[6])


def scan_date(text: Column, patterns: tuple[tuple[str, str], ...] = SCAN) -> Column:
    """The first date found in a text, in the order of the patterns; one that can't be read is passed over."""

    def one(find: str, read: str) -> Column:
        found = F.regexp_replace(F.regexp_extract(text, find, 1), "\\s+", " ")
        if "日 " in read:
            found = F.regexp_replace(found, "日 ?", "日 ")
        return _ntz(F.nullif(found, F.lit("")), read)

    return F.coalesce(*[one(f, r) for f, r in patterns])


def url_date(url: Column) -> Column:
    """The date of a /yyyy/mm/dd/ step in an address; null if there is none or no such day."""
    found = F.regexp_extract(url, "/(\\d{4}/\\d{2}/\\d{2})[/.]", 1)
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("yyyy/MM/dd")).cast("date")


def day(ts: Column) -> Column:
    """The day of a time as yyyy-MM-dd."""
    return F.date_format(ts, "yyyy-MM-dd")


def iso(ts: Column) -> Column:
    """ISO 8601 text of a time."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
