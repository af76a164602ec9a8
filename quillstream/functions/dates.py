"""Dates in Gregorian and ROC years, and the tariff clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions.text import to_halfwidth

AD = r"(?U)(\d{4})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})"
ROC = r"(?U)(?:中華)?(?:民國)?\s*(\d{2,3})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})"


def parse_date(c: Column, prefer_roc: bool = False) -> Column:
    """The first Gregorian date anywhere; else an ROC date if marked or preferred; an impossible date is null."""
    t = to_halfwidth(c)

    def built(p: str, add: int) -> Column:
        g = [F.regexp_extract(t, p, k).try_cast("int") for k in (1, 2, 3)]
        return F.try_to_timestamp(F.concat_ws("-", F.lpad((g[0] + add).cast("string"), 4, "0"), F.lpad(g[1].cast("string"), 2, "0"), F.lpad(g[2].cast("string"), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")

    marked = F.lit(True) if prefer_roc else t.rlike("民國")
    return F.when(t.rlike(AD), built(AD, 0)).when(marked & t.rlike(ROC), built(ROC, 1911))


def is_peak(ts: Column) -> Column:
    """UTC, Monday to Friday, hours [1,4) and [6,10)."""
    h = F.hour(ts)
    return (F.weekday(ts) < 5) & (((h >= 1) & (h < 4)) | ((h >= 6) & (h < 10)))


def in_service_window(ts: Column, start: Column, end: Column, zone: str = "Asia/Taipei") -> Column:
    """Local hour within [start, end), which may wrap midnight; open where either end is null."""
    h = F.hour(F.from_utc_timestamp(ts, zone))
    return F.when(start.isNull() | end.isNull(), True).when(start <= end, (h >= start) & (h < end)).otherwise((h >= start) | (h < end))


ISO = r"^(\d{4})-(\d{1,2})-(\d{1,2})([T ])(\d{1,2}):(\d{1,2}):(\d{1,2})(\.\d{1,6})?([+-]\d{2}:?\d{2})?$"
RFC822 = r"^(?:[A-Za-z]+, )?(\d{1,2}) ([A-Za-z]{3})[a-z]* (\d{4}) (\d{1,2}):(\d{1,2}):(\d{1,2}) ?([+-]\d{2}:?\d{2}|GMT|UTC|UT|Z)?$"
SLASH = r"^(\d{4})/(\d{1,2})/(\d{1,2}) (\d{1,2}):(\d{1,2})(?::(\d{1,2}))?$"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def _instant(year, month, day, hour, minute, second, fraction, zone) -> Column:
    """A timestamp of string parts; empty fraction and zone stand for none and UTC, impossible values give null."""
    two = lambda c: F.lpad(c, 2, "0")
    offset = F.when(zone == "", "+00:00").otherwise(F.regexp_replace(zone, r"^([+-]\d{2}):?(\d{2})$", "$1:$2"))
    text = F.concat(year, F.lit("-"), two(month), F.lit("-"), two(day), F.lit(" "), two(hour), F.lit(":"), two(minute), F.lit(":"), two(second), fraction, offset)
    return text.try_cast("timestamp")


def parse_datetime(c: Column) -> Column:
    """An ISO date with a time; without a zone it is UTC. A fraction needs both the letter T and a zone; anything else is null."""
    t = F.regexp_replace(F.trim(to_halfwidth(c)), "Z$", "+0000")
    g = lambda k: F.regexp_extract(t, ISO, k)
    allowed = t.rlike(ISO) & ((g(8) == "") | ((g(4) == "T") & (g(9) != "")))
    return F.when(allowed, _instant(g(1), g(2), g(3), g(5), g(6), g(7), g(8), g(9)))


def parse_slash_datetime(c: Column) -> Column:
    """Slashed date with a time, and a zoneless dashed one, at +08:00; a bare time of day is null; else as parse_datetime."""
    t = F.trim(c)
    g = lambda k: F.regexp_extract(t, SLASH, k)
    h = lambda k: F.regexp_extract(t, ISO, k)
    local, none = F.lit("+08:00"), F.lit("")
    dashed = t.rlike(ISO) & (h(4) == " ") & (h(8) == "") & (h(9) == "")
    return F.when(t.rlike(SLASH), _instant(g(1), g(2), g(3), g(4), g(5), F.when(g(6) == "", "00").otherwise(g(6)), none, local)).when(dashed, _instant(h(1), h(2), h(3), h(5), h(6), h(7), none, local)).otherwise(parse_datetime(t))


def parse_rfc822(c: Column) -> Column:
    """A feed's date: a missing space after the comma and repeated spaces are forgiven; without a zone it is UTC; else as parse_datetime."""
    t = F.trim(F.regexp_replace(F.regexp_replace(c, r",(?=\S)", ", "), r"\s+", " "))
    g = lambda k: F.regexp_extract(t, RFC822, k)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.initcap(g(2))).cast("string")
    zone = F.when(g(7).rlike("^[+-]"), g(7)).otherwise("")
    return F.when(t.rlike(RFC822), _instant(g(3), month, g(1), g(4), g(5), g(6), F.lit(""), zone)).otherwise(parse_datetime(t))


def parse_short_fraction(c: Column) -> Column:
    """ISO date and time whose fraction may have any length up to six; without a zone it is UTC."""
    t = F.regexp_replace(F.trim(c), "Z$", "+00:00")
    g = lambda k: F.regexp_extract(t, ISO, k)
    return F.when(t.rlike(ISO), _instant(g(1), g(2), g(3), g(5), g(6), g(7), g(8), g(9)))


def at_noon(day: Column, zone: str = "+08:00") -> Column:
    """Noon of a date in the zone, the stand-in for an unknown time."""
    return F.concat(day.cast("string"), F.lit(" 12:00:00" + zone)).try_cast("timestamp")
