"""Calendar questions: the half-open range of time a scope names, and predicates on events, as column expressions.

Times are timestamp_ntz, local to the asking user; `local` makes them from UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scopes that have a range of their own; any other means seven days from now, none this week.
SCOPES = (
    "today", "tomorrow", "this_week", "next_week", "this_month", "morning_today", "afternoon_today", "evening_today", "weekend", "soon_48h", "agenda", "pipeline_14d", "ytd_forward",
)
MEETING_PLACES = ("zoom", "meet.google", "teams")


def local(utc: Column, zone: Column) -> Column:
    """Wall-clock time in a zone of a UTC time."""
    return F.convert_timezone(F.lit("UTC"), zone, utc.cast("timestamp_ntz"))


def range_of(scope: Column, now: Column) -> Column:
    """Struct of starts and ends (not included) of a scope at a local time; weeks start on Monday, days are of wall-clock time."""
    day = now.cast("date")
    at = lambda d, hours=0: d.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hours))
    later = lambda n: at(F.date_add(day, n))
    monday, month = F.trunc(day, "week").cast("date"), F.trunc(day, "month").cast("date")
    saturday = F.date_add(day, F.pmod(5 - F.weekday(day), F.lit(7)).cast("int"))
    ahead = lambda hours: now + F.make_dt_interval(hours=F.lit(hours))
    ranges = {
        "today": (at(day), later(1)), "tomorrow": (later(1), later(2)), "this_week": (at(monday), at(F.date_add(monday, 7))), "next_week": (at(F.date_add(monday, 7)), at(F.date_add(monday, 14))),
        "this_month": (at(month), at(F.add_months(month, 1))), "morning_today": (at(day, 6), at(day, 12)), "afternoon_today": (at(day, 12), at(day, 18)), "evening_today": (at(day, 18), later(1)),
        "weekend": (at(saturday), at(F.date_add(saturday, 2))), "soon_48h": (now, ahead(48)), "agenda": (at(day), later(2)), "pipeline_14d": (at(day), later(14)), "ytd_forward": (at(F.trunc(day, "year").cast("date")), later(365)),
    }
    struct = lambda ends: F.struct(ends[0].alias("starts"), ends[1].alias("ends"))
    named = F.coalesce(F.nullif(scope, F.lit("")), F.lit("this_week"))
    out = F.when(F.lit(False), struct(ranges["today"]))
    for name, ends in ranges.items():
        out = out.when(named == name, struct(ends))
    return out.otherwise(struct((now, ahead(24 * 7))))


def passes(starts_at: Column, attendees: Column, location: Column, link: Column, *, all_day: Column, with_others: Column, virtual: Column, in_person: Column) -> Column:
    """Whether an event meets all marks set: without a time of day, two attendees or more, held online, held at a place and not online."""
    place, online = F.lower(F.coalesce(location, F.lit(""))), F.coalesce(link, F.lit("")) != ""
    meeting = online
    for name in MEETING_PLACES:
        meeting = meeting | F.contains(place, F.lit(name))
    asked = lambda mark: F.coalesce(mark, F.lit(False))
    return (
        (~asked(all_day) | starts_at.isNull()) & (~asked(with_others) | (F.coalesce(F.size(attendees), F.lit(0)) >= 2)) & (~asked(virtual) | meeting)
        & (~asked(in_person) | ((F.regexp_replace(place, r"\s+", "") != "") & ~online))
    )
