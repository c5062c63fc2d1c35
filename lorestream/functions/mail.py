"""Mail: threads cut into mails, and dates of several forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorestream.functions import text as T

# What parts the mails of a thread, tried in this order, and the forms of dates, tried in this order.
DELIMITERS = (
    r"(?id)\n-{3,}\s*(?:Original\s+Message|Forwarded\s+Message)\s*-{3,}\n",
    r"(?id)\n_{3,}\n",
    r"(?id)\nOn\s+.+?\s+wrote:\s*\n",
    r"(?id)\n\s*(?:From|Sender)\s*:\s*.+?\n\s*(?:Sent|Date)\s*:\s*.+?\n",
)
DAYS = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
DATES = (
    ("", "yyyy-M-d"), ("", "M/d/yyyy"), ("", "d/M/yyyy"), ("", "MMMM d, yyyy"), ("", "MMM d, yyyy"), ("", "d MMMM yyyy"), ("", "d MMM yyyy"), ("", "yyyy-M-d'T'H:m:s"),
    ("Mon|Tue|Wed|Thu|Fri|Sat|Sun", "d MMM yyyy H:m:s"), (DAYS, "MMMM d, yyyy"), ("", "M-d-yyyy"),
)


def segments(text: Column) -> Column:
    """The parts of a text by the first delimiter that parts it; parts of fewer than 20 characters go."""
    parts = F.array(text)
    for pattern in reversed(DELIMITERS):
        cut = F.split(text, pattern)
        parts = F.when(F.size(cut) > 1, cut).otherwise(parts)
    return F.filter(parts, lambda s: F.length(F.regexp_replace(s, r"^\s+|\s+$", "")) >= 20)


def mails(docs: DataFrame, key: str) -> DataFrame:
    """(key, nth, sender, receiver, subject, sent, date, is_email): the mails of each text of docs(key, text); the whole text where no part is one.

    Null and blank texts have none.
    """
    rows = docs.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select(key, "text")
    heads = F.filter(F.transform(segments(F.col("text")), T.email_headers), lambda h: h["is_email"])
    found = rows.select(key, F.posexplode(F.when(F.size(heads) > 0, heads).otherwise(F.array(T.email_headers(F.col("text"))))).alias("at", "m"))
    return found.select(key, (F.col("at") + 1).alias("nth"), "m.*").withColumn("date", normalised_date(F.col("sent")))


def normalised_date(text: Column) -> Column:
    """A date as yyyy-MM-dd; offsets and remarks in brackets are dropped, months come before days. What is no date stays, 50 characters at most.

    Four digits after a sign count as an offset, so month-day-year with hyphens is no date.
    """
    whole = F.trim(text)
    bare = F.trim(F.regexp_replace(F.regexp_replace(whole, r"\s*[+\-][0-9]{4}.*$", ""), r"\s*\(.*?\)\s*$", ""))
    tried = []
    for days, form in DATES:
        rest = F.when(bare.rlike(f"(?i)^(?:{days}),\\s*"), F.regexp_replace(bare, f"(?i)^(?:{days}),\\s*", "")) if days else bare
        tried.append(F.try_to_timestamp(F.initcap(rest) if "MMM" in form else rest, F.lit(form)))
    parsed = F.date_format(F.coalesce(*tried), "yyyy-MM-dd")
    raw = F.substring(F.trim(F.regexp_replace(whole, r"\s+", " ")), 1, 50)
    return F.when(F.coalesce(whole, F.lit("")) == "", "").otherwise(F.coalesce(parsed, raw))
