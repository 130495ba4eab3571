"""Feed date parsing (T7): RFC-2822 and ISO-8601 text to a UTC timestamp.

One regular expression takes an RFC-2822 date apart; numbers, month and zone
make the timestamp without a formatter.  Zones with another name than the
common ones, and ISO-8601, go to ``try_to_timestamp`` (NULL on failure).  Text
without an offset is taken in the session time zone (UTC).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Weekday, day, month, year of four or two digits, hours and minutes, seconds, zone.
RFC = rf"^(?:[A-Za-z]{{3}},[{WS}]*)?(\d{{1,2}})[{WS}]+([A-Za-z]{{3}})[{WS}]+(\d{{4}}|\d{{2}})[{WS}]+(\d{{1,2}}):([0-5]\d)(?::([0-5]\d))?(?:[{WS}]+([^{WS}|]+))?$"
#: For zone names beyond those below.
NAMED = [f"d MMM {year} {time} z" for year in ("yyyy", "yy") for time in ("H:mm:ss", "H:mm")]

# FIXED VALUES: minutes from UTC.  North American abbreviations are fixed
# offsets in feeds, whatever the season.
ZONE_MINUTES = {"GMT": 0, "UTC": 0, "UT": 0, "Z": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
                "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}


def parse_published(raw) -> Column:
    c = F.trim(F.col(raw) if isinstance(raw, str) else raw)
    # one pass over the text; what does not match has no bars
    parts = F.split(F.regexp_replace(c, RFC, "$1|$2|$3|$4|$5|$6|$7"), "\\|")
    return F.get(F.transform(F.array(parts), lambda p: _made(p, c)), F.lit(0))


def _made(p: Column, c: Column) -> Column:
    at = lambda i: F.get(p, F.lit(i))
    year = at(2).try_cast("int")
    numbers = [F.when(F.length(at(2)) == 2, year + 2000).otherwise(year), F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(at(1))).cast("int"),
               at(0).try_cast("int"), at(3).try_cast("int"), at(4).try_cast("int"), F.coalesce(F.nullif(at(5), F.lit("")).try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)"))]
    zone = at(6)
    signed = zone.rlike(r"^[+-]\d{2}:?\d{2}$")
    named = F.element_at(F.create_map(*[x for k, v in ZONE_MINUTES.items() for x in (F.lit(k), F.lit(v))]), F.upper(zone))
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.right(zone, F.lit(2)).try_cast("int")
    offset = F.when(signed, (hours * 60 + minutes) * F.when(zone.startswith("-"), -1).otherwise(1)).otherwise(named)
    at_utc = F.try_make_timestamp(*numbers, F.lit("UTC")) - F.make_dt_interval(F.lit(0), F.lit(0), offset)
    bare = F.regexp_replace(c, rf"^[A-Za-z]{{3}},[{WS}]*", "")
    return (F.when(F.size(p) < 7, F.try_to_timestamp(c))                   # ISO-8601
            .when(zone == "", F.try_make_timestamp(*numbers))
            .when(offset.isNotNull(), at_utc)
            .otherwise(F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in NAMED])))


def parse_entry_time(published, updated) -> Column:
    """published, else updated (the reference prefers the published field)."""
    p = F.col(published) if isinstance(published, str) else published
    u = F.col(updated) if isinstance(updated, str) else updated
    return F.coalesce(parse_published(F.nullif(p, F.lit(""))), parse_published(F.nullif(u, F.lit(""))))
