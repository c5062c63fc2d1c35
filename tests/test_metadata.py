import datetime
import re

import pytest
from pyspark.sql import functions as F

from lorestream.functions import mail, overlay
from lorestream.operators import evidence


def parsed(text):
    """By the same forms, one after the other."""
    bare = re.sub(r"\s*\(.*?\)\s*$", "", re.sub(r"\s*[+\-]\d{4}.*$", "", text.strip())).strip()
    for form in ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y", "%Y-%m-%dT%H:%M:%S", "%a, %d %b %Y %H:%M:%S", "%A, %B %d, %Y", "%m-%d-%Y"):
        try:
            return datetime.datetime.strptime(bare, form).strftime("%Y-%m-%d")
        except ValueError:
            pass
    return re.sub(r"\s+", " ", text).strip()[:50]


def test_dates(spark):
    dates = ["2024-1-5", "2024-02-30", "3/4/2024", "13/4/2024", "4/13/2024", "31/31/2024", "March 5, 2024", "mar 5, 2024", "5 MARCH 2024", "5 Mar 2024", "2024-03-05T1:02:03", "Tue, 5 Mar 2024 10:00:00 -0700 (PST)"]
    dates += ["tuesday, March 5, 2024", "Tue, March 5, 2024", "01-05-2024", "  next   week " + "x" * 60, "5 Mar 24", "2024/01/02", "March 5 2024", "2024-01-05 10:00"]
    got = spark.createDataFrame([(d,) for d in dates], "d string").select("d", mail.normalised_date(F.col("d"))).collect()
    assert dict(map(tuple, got)) == {d: parsed(d) for d in dates}
    assert [r[0] for r in spark.createDataFrame([(None,), ("",)], "d string").select(mail.normalised_date(F.col("d"))).collect()] == ["", ""]


def brute_segments(text):
    marks = [r"\n-{3,}\s*(?:Original\s+Message|Forwarded\s+Message)\s*-{3,}\n", r"\n_{3,}\n", r"\nOn\s+.+?\s+wrote:\s*\n", r"\n\s*(?:From|Sender)\s*:\s*.+?\n\s*(?:Sent|Date)\s*:\s*.+?\n"]
    for mark in marks:
        parts = re.split(mark, text, flags=re.I)
        if len(parts) > 1:
            return [p for p in parts if len(p.strip()) >= 20]
    return [text] if len(text.strip()) >= 20 else []


def test_segments(spark):
    a, b = "From: a@b.c\nTo: d\n\nhello there", "Sender: x@y.z\nSubject: s\n\nanother mail"
    texts = [f"{a}{m}{b}" for m in ("\n--- original  message ---\n", "\n_____\n", "\nOn Monday, Z wrote:\n\n", "\nFrom: q\nSent: now\n", "\n\n")]
    texts += [f"{a}\n___\n{b}\n--- Forwarded Message ---\n{b}", "tiny\n___\n" + b, "", "short"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mail.segments(F.col("t"))).collect()
    assert dict(map(tuple, got)) == {t: brute_segments(t) for t in texts}
    rows = mail.mails(spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id long, text string"), "id").collect()
    assert {r.id for r in rows} == {0, 1, 2, 3, 4, 5, 6, 8} and [r.sender for r in rows if r.id == 1] == ["a@b.c"]  # the other part names no receiver
    assert [(r.is_email, r.nth) for r in rows if r.id == 8] == [(False, 1)]


@pytest.mark.parametrize(
    ("content", "source", "want"),
    [
        (None, None, {"source_family": "unknown", "quality": 0.6, "quality_flags": ["short_chunk", "missing_source_file"], "source_type": "unknown", "topic_path": []}),
        ("see 12345 and 123456", "a/b/Report (3).DOCX", {"source_family": "Report", "section_id": None, "document_type": "unknown"}),
        ("Penal Code section 123.45 - 130", "x", {"section_id": "123.45-130", "jurisdiction": "california", "document_type": "statute", "source_type": "statute"}),
        ("to: a, b ;c\nsubject: The plan", "x.htm", {"email_recipients": ["a", "b", "c"], "source_type": "email", "topic_path": ["email", "pricing"], "email_sender": None}),
        ("Ann Lee met Ann Lee, ann@x.org and Bob Dee Ray.", "page.html", {"primary_entities": ["Ann Lee", "Bob Dee Ray", "ann@x.org"], "source_type": "webpage"}),
        ("2 for 1: the dashboard", "x", {"source_type": "product_doc", "topic_path": ["feature"]}),
    ],
)
def test_overlay(spark, content, source, want):
    row = spark.createDataFrame([(content, source)], "c string, s string").select(overlay.overlay(F.col("c"), F.col("s")).alias("o")).first().o
    assert {k: row[k] for k in want} == want


def test_profiles_and_given_names(spark):
    df = spark.createDataFrame([("no. 4567 of it", "s", ["  Zed ", "", "Zed"])], "c string, s string, g array<string>")
    of = lambda p: df.select(overlay.overlay(F.col("c"), F.col("s"), F.lit(p), F.col("g"), F.lit(True)).alias("o")).first().o
    assert of("legal_precision").section_id == "4567" and of("general").section_id is None and of("general").primary_entities == ["Zed"] and "extraction_error" in of("general").quality_flags


def test_sentences_keep_their_digits(spark):
    got = spark.range(1).select(evidence.sentences(F.lit("0 of it. 1 was 1. 2")).alias("s"), evidence.quoted(F.lit('say "0 fox 0" or " 11 "')).alias("q")).first()
    assert got.s == ["0 of it.", "1 was 1.", "2"] and got.q == ["0 fox 0", "11"]


def test_an_overlay_reads_a_text_once_for_all_its_fields(spark):
    rows = spark.createDataFrame([("a text", "f.txt")], "content string, source string").select(overlay.overlay(F.col("content"), F.col("source")).alias("o")).select("o.*")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(concat(") == 1
