"""The metadata overlay of a chunk: one struct of types, section, topics, flags, entities and fields, by tables of markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorestream.functions import text as T

# File endings, patterns and markers.
ENDINGS = r"(?i)\.(?:txt|md|markdown|pdf|docx?|html?|csv|xlsx?|json)$"
SECTION = r"(?i)\b(?:section\s*)?((?:[0-9]{3,5})(?:\.[0-9]+)?(?:\s*(?:-|to|through)\s*[0-9]{3,5}(?:\.[0-9]+)?)?)(?:[^0-9]|$)"
CODES = r"\b(?:family|evidence|civil|penal|probate)\s+code\b"
ADDRESSED = r"\bfrom:\s+.+\bto:\s+"
NAMES = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b"
ADDRESS = r"[\w.\-+%]+@[\w.\-]+\.[A-Za-z]{2,}"
DATE = r"(?i)\b(?:[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+[0-9]{1,2},?\s+[0-9]{2,4})\b"
TOPICS = {
    "pricing": ["pricing", "price", "billing", "subscription", "stripe", "plan"],
    "workflow": ["workflow", "onboarding", "launch", "setup", "portal"],
    "feature": ["feature", "agent", "analytics", "whatsapp", "dashboard", "rbac"],
    "policy": ["terms", "policy", "contract", "eligibility"],
}
FIELDS = {
    "definition": ["means", "defined", "definition"],
    "requirement": ["must", "shall", "required", "requirement"],
    "price": ["price", "pricing", "fee", "cost", "subscription"],
    "date": ["date", "dated", "when"],
    "email_sender": ["from:"],
    "email_recipient": ["to:"],
}
PENALTIES = {"short_chunk": 0.25, "replacement_characters": 0.2, "extraction_error": 0.4, "missing_source_file": 0.15}


def _any(low: Column, markers: list[str]) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(low, F.lit(m))
    return found


def _named(*pairs: tuple[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(condition, name) for name, condition in pairs)))


def family(source: Column) -> Column:
    """File name without folders, known ending, ' (n)' and chunk number; 220 characters at most, 'unknown' for none."""
    name = F.regexp_replace(F.regexp_replace(F.coalesce(source, F.lit("")), r"/+$", ""), r"^.*/", "")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, ENDINGS, ""), r"\s+\([0-9]+\)$", ""), r"(?i)[_\s-]+chunk[_\s-]*[0-9]+$", "")
    return F.when(bare == "", "unknown").otherwise(F.substring(bare, 1, 220))


def header(content: Column, name: str) -> Column:
    """The value of a header line, 500 characters at most; null without one."""
    return F.nullif(F.substring(F.trim(F.regexp_extract(content, rf"(?imd)^\s*{name}\s*:\s*(.+)$", 1)), 1, 500), F.lit(""))


def blob(content: Column, source: Column) -> Column:
    """What markers are looked for in: source and the first 4,000 characters, lower case."""
    return F.lower(F.concat(source, F.lit("\n"), F.substring(content, 1, 4000)))


def source_type(low: Column, source: Column) -> Column:
    name = F.lower(source)
    return (
        F.when(F.contains(low, F.lit("email")) | low.rlike(f"(?d){ADDRESSED}"), "email").when(F.contains(low, F.lit("code")) | low.rlike(r"\bsection\s+[0-9]"), "statute")
        .when(F.contains(name, F.lit(".pdf")), "pdf").when(name.rlike(r"\.html?$"), "webpage").otherwise("unknown")
    )


def document_type(low: Column) -> Column:
    has = lambda m: F.contains(low, F.lit(m))
    return (
        F.when(has("deposition"), "deposition").when(has("email") | low.rlike(f"(?d){ADDRESSED}"), "email").when(has("statute") | has("code"), "statute")
        .when(has("invoice"), "invoice").when(has("flight") & has("log"), "flight_log").otherwise("unknown")
    )


def quality_flags(content: Column, source: Column, failed: Column | None = None) -> Column:
    return _named(
        ("short_chunk", F.length(F.trim(content)) < 80), ("replacement_characters", F.contains(content, F.lit("�"))),
        ("extraction_error", F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))), ("missing_source_file", source == "unknown"),
    )


def quality_score(content: Column, flags: Column) -> Column:
    """1, less for each flag, a little more for long content; 0 to 1, to three places."""
    total = F.lit(1.0)
    for flag, penalty in PENALTIES.items():
        total = total - F.when(F.array_contains(flags, flag), penalty).otherwise(0.0)
    total = total + F.when(F.length(F.trim(content)) > 1000, 0.05).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3)


def primary_entities(content: Column, given: Column | None = None, most: int = 25) -> Column:
    """Given names, then capitalised names of two to four words and addresses in the first 3,000 characters; each once."""
    head = F.substring(content, 1, 3000)
    found = F.concat(F.regexp_extract_all(head, F.lit(NAMES), F.lit(0)), F.regexp_extract_all(head, F.lit(ADDRESS), F.lit(0)))
    known = F.array().cast("array<string>") if given is None else F.coalesce(F.filter(F.transform(given, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(known, found)), 1, most)


def overlay(content: Column, source: Column, profile: Column | None = None, given: Column | None = None, failed: Column | None = None) -> Column:
    """Struct of the overlay. profile: general, legal_precision or evidence_archive; null reads it off the text."""
    content, source = F.coalesce(content, F.lit("")), F.coalesce(F.nullif(source, F.lit("")), F.lit("unknown"))
    # What several fields ask for is computed once, in three steps: field by field the whole text would be read again for each use.
    return T._let(F.struct(content.alias("content"), source.alias("source")), lambda x: T._let(_seen(x["content"], x["source"]), lambda y: T._let(_read(x, y, profile, failed), lambda z: _told(x, y, z, given))))


def _seen(content: Column, source: Column) -> Column:
    sent = F.coalesce(header(content, "date"), F.nullif(F.regexp_extract(F.substring(content, 1, 1500), DATE, 0), F.lit("")))
    number = F.coalesce(F.nullif(F.regexp_extract(source, SECTION, 1), F.lit("")), F.nullif(F.regexp_extract(F.substring(content, 1, 1200), SECTION, 1), F.lit("")))
    to = F.filter(F.transform(F.split(F.coalesce(header(content, "to"), F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(
        blob(content, source).alias("low"), family(source).alias("fam"), header(content, "from").alias("sender"), header(content, "subject").alias("subject"),
        to.alias("to"), sent.alias("sent"), number.alias("number"),
    )


def _read(x: Column, y: Column, profile: Column | None, failed: Column | None) -> Column:
    low = y["low"]
    hint = F.when(F.contains(low, F.lit("family code")) | F.contains(low, F.lit("evidence code")), "legal_precision").otherwise("general")
    hint = hint if profile is None else F.coalesce(profile, hint)
    mail = y["sender"].isNotNull() | (F.size(y["to"]) > 0) | y["subject"].isNotNull()
    return F.struct(low.rlike(CODES).alias("code"), hint.alias("hint"), mail.alias("mail"), quality_flags(x["content"], x["source"], failed).alias("flags"), F.when(mail, "email").otherwise(source_type(low, x["source"])).alias("kind"))


def _told(x: Column, y: Column, z: Column, given: Column | None) -> Column:
    low, fam, code = y["low"], y["fam"], z["code"]
    section = F.when((z["hint"] == "legal_precision") | code & (z["hint"] != "evidence_archive"), F.replace(y["number"], F.lit(" "), F.lit("")))
    topics = _named(
        ("evidence_code", code & F.contains(low, F.lit("evidence code"))), ("family_code", code & F.contains(low, F.lit("family code"))), ("email", z["mail"]), *((t, _any(low, m)) for t, m in TOPICS.items())
    )
    fields = _named(*((f, _any(low, m)) for f, m in FIELDS.items()), ("file_lookup", fam != ""), ("section_lookup", F.coalesce(section, F.lit("")) != ""))
    return F.struct(
        T.document_id(fam).alias("document_id"), fam.alias("source_family"),
        F.when((z["kind"] == "unknown") & (F.size(topics) > 0), "product_doc").otherwise(z["kind"]).alias("source_type"),
        F.when(z["mail"], "email").when(code, "statute").otherwise(document_type(low)).alias("document_type"),
        section.alias("section_id"), F.when(code, "california").alias("jurisdiction"), topics.alias("topic_path"), z["flags"].alias("quality_flags"),
        primary_entities(x["content"], given).alias("primary_entities"), y["sender"].alias("email_sender"), y["to"].alias("email_recipients"), y["subject"].alias("email_subject"), y["sent"].alias("email_date"),
        F.array_sort(fields).alias("answerable_fields"), quality_score(x["content"], z["flags"]).alias("quality"),
    )
