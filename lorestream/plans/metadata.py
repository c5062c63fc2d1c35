"""Overlays of documents, threads of mails and dates, each over the given tables with fragments that make every rule speak."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestream.functions import mail
from lorestream.functions import overlay as O
from lorestream.plans.queries import _query, _read

# Beginnings of documents, by number.
HEADS = [
    "Under Family Code section 3044.5 the court shall decide. ", "From: Ann Lee <ann@x.org>\nTo: bob@y.org; Cy Dee\nSubject: Fees\nDate: 5 May 2024\n\n", "The deposition of Mary Ann Smith. ",
    "Invoice dated 3/4/2024, price $5. ", "Flight log: onboarding and analytics. ", "Broken � text. ", "Evidence Code 352 to 354 means this. ", "Terms: http code 404. ", "",
]
NAMES = ["/in/Family Notes (2).pdf", "/in/page 1234.HTML", "", "/in/rates_chunk_12.txt"]
_ASCII = "regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', ' ', 'g')"


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_PICK = "case doc_id % {0} " + "{1} end"
_DOCS = f"""d as (select doc_id, {_PICK.format(len(HEADS), ' '.join(f'when {i} then {_sql(h)}' for i, h in enumerate(HEADS)))} || case when doc_id % 5 = 0 then substr({_ASCII}, 1, 40) else {_ASCII} end as content,
  case when {_PICK.format(len(NAMES), ' '.join(f'when {i} then {_sql(n)}' for i, n in enumerate(NAMES)))} = '' then 'unknown' else {_PICK.format(len(NAMES), ' '.join(f'when {i} then {_sql(n)}' for i, n in enumerate(NAMES)))} end as source from documents)"""


def _has(markers: list[str]) -> str:
    return "(" + " or ".join(f"contains(low, '{m}')" for m in markers) + ")"


def _head(name: str) -> str:
    return f"nullif(substr(trim(regexp_extract(content, '(?im)^\\s*{name}\\s*:\\s*(.+)$', 1), ' '), 1, 500), '')"


_O = f"""with {_DOCS}, b as (select *, lower(source || chr(10) || substr(content, 1, 4000)) as low from d),
x as (select *, regexp_matches(low, '{O.CODES}') as code, {_head('from')} as sender, {_head('subject')} as subject, {_head('to')} as receiver,
  coalesce(nullif(regexp_extract(source, '{O.SECTION}', 1), ''), nullif(regexp_extract(substr(content, 1, 1200), '{O.SECTION}', 1), '')) as number,
  contains(low, 'family code') or contains(low, 'evidence code') as legal, length(trim(content, ' ')) as n, regexp_matches(low, '{O.ADDRESSED}') as addressed,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(source, '^.*/', ''), '{O.ENDINGS}', ''), '\\s+\\([0-9]+\\)$', ''), '(?i)[_\\s-]+chunk[_\\s-]*[0-9]+$', '') as source_family from b),
y as (select *, sender is not null or receiver is not null or subject is not null as mail, case when legal or code then replace(number, ' ', '') end as section_id,
  list_filter([case when n < 80 then 'short_chunk' end, case when contains(content, chr(65533)) then 'replacement_characters' end, case when source = 'unknown' then 'missing_source_file' end], lambda z: z is not null) as flags from x),
z as (select *, list_filter([case when code and contains(low, 'evidence code') then 'evidence_code' end, case when code and contains(low, 'family code') then 'family_code' end, case when mail then 'email' end,
  {", ".join(f"case when {_has(m)} then '{t}' end" for t, m in O.TOPICS.items())}], lambda t: t is not null) as topics, case when mail then 'email' when contains(low, 'email') or addressed then 'email' when contains(low, 'code') or regexp_matches(low, '\\bsection\\s+[0-9]') then 'statute'
  when contains(lower(source), '.pdf') then 'pdf' when regexp_matches(lower(source), '\\.html?$') then 'webpage' else 'unknown' end as kind from y),
o as (select doc_id, 'doc_' || substr(sha1(source_family), 1, 16) as document_id, source_family, case when kind = 'unknown' and len(topics) > 0 then 'product_doc' else kind end as source_type,
  case when mail then 'email' when code then 'statute' when contains(low, 'deposition') then 'deposition' when contains(low, 'email') or addressed then 'email' when contains(low, 'statute') or contains(low, 'code') then 'statute' when contains(low, 'invoice') then 'invoice'
  when contains(low, 'flight') and contains(low, 'log') then 'flight_log' else 'unknown' end as document_type, section_id, case when code then 'california' end as jurisdiction, array_to_string(topics, ',') as topics, array_to_string(flags, ',') as flags,
  regexp_extract_all(substr(content, 1, 3000), '{O.NAMES}') || regexp_extract_all(substr(content, 1, 3000), '{O.ADDRESS}') as names, sender, receiver, subject, coalesce({_head('date')}, nullif(regexp_extract(substr(content, 1, 1500), '{O.DATE}'), '')) as sent,
  array_to_string(list_sort(list_filter([{", ".join(f"case when {_has(m)} then '{f}' end" for f, m in O.FIELDS.items())}, 'file_lookup', case when coalesce(section_id, '') <> '' then 'section_lookup' end], lambda t: t is not null)), ',') as fields,
  round(greatest(0, least(1, 1.0::double - case when n < 80 then 0.25 else 0 end - case when contains(content, chr(65533)) then 0.2 else 0 end - case when source = 'unknown' then 0.15 else 0 end + case when n > 1000 then 0.05 else 0 end)), 3)::double as quality from z)"""


def _overlaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    ascii_ = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", " ")
    content = F.concat(pick(HEADS), F.when(F.col("doc_id") % 5 == 0, F.substring(ascii_, 1, 40)).otherwise(ascii_))
    docs = _read(spark, sf_dir, "documents").select("doc_id", content.alias("content"), pick(NAMES).alias("source"))
    return docs.select("doc_id", O.overlay(F.col("content"), F.col("source")).alias("o")).select("doc_id", "o.*")


@_query(f"""{_O} select doc_id, document_id, source_family, source_type, document_type, section_id, jurisdiction, topics, flags, md5(array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i)[1:25], '|')) as entities,
  sender, array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(receiver, ''), '[,;]'), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') as recipients, subject, sent, fields, quality from o""")
def metadata_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlay of each document, whose beginnings and file names make every rule speak."""
    join = lambda c, by=",": F.array_join(c, by)
    return _overlaid(spark, sf_dir).select(
        "doc_id", "document_id", "source_family", "source_type", "document_type", "section_id", "jurisdiction", join("topic_path").alias("topics"), join("quality_flags").alias("flags"),
        F.md5(join("primary_entities", "|")).alias("entities"), F.col("email_sender").alias("sender"), join("email_recipients", "|").alias("recipients"), F.col("email_subject").alias("subject"), F.col("email_date").alias("sent"), join("answerable_fields").alias("fields"), "quality",
    )


@_query(f"{_O} select 'source_type' as field, source_type as value, count(*) as n from o group by source_type union all select 'document_type', document_type, count(*) from o group by document_type union all select 'quality', cast(quality as varchar), count(*) from o group by quality")
def overlay_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by values of three overlay fields."""
    rows = _overlaid(spark, sf_dir).select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in ("source_type", "document_type", "quality")))).alias("f"))
    return rows.groupBy("f.field", "f.value").agg(F.count("*").alias("n"))


# Mails

_DAY = "(date '2024-01-05' + cast(conv_id % 300 as integer))"
_SENT = f"case (conv_id + turn) % 12 " + " ".join(
    f"when {i} then strftime({_DAY}, '{f}')" for i, f in enumerate(["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y", "%Y-%m-%dT10:30:00", "%a, %d %b %Y 09:05:00 +0200 (CET)", "%A, %B %d, %Y", "%m-%d-%Y"])
) + " else 'soon   after lunch' end"
_ISO = f"""case (conv_id + turn) % 12 when 10 then strftime({_DAY}, '%m-%d-%Y') when 11 then 'soon after lunch' when 2 then case when day({_DAY}) <= 12 then strftime({_DAY}, '%Y-%d-%m') else strftime({_DAY}, '%Y-%m-%d') end else strftime({_DAY}, '%Y-%m-%d') end"""


@_query(f"""with t as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn) as nth, {_ISO} as date, {_SENT} as sent from conversations)
select conv_id, nth, case when conv_id % 4 = 3 and nth > 1 then null else role || '@example.org' end as sender, 'list ' || conv_id as receiver, 'turn ' || turn as subject, case when conv_id % 4 = 3 and nth > 1 then null else trim(sent, ' ') end as sent,
  case when conv_id % 4 = 3 and nth > 1 then '' else date end as date from t""")
def mail_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as threads of mails, parted in four ways, taken apart again; dates in twelve forms."""
    c, t = F.col("conv_id"), F.col("turn")
    day = F.date_add(F.lit("2024-01-05").cast("date"), (c % 300).cast("int"))
    forms = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "MMMM dd, yyyy", "MMM dd, yyyy", "dd MMMM yyyy", "dd MMM yyyy", "yyyy-MM-dd'T10:30:00'", "EEE, dd MMM yyyy '09:05:00 +0200 (CET)'", "EEEE, MMMM dd, yyyy", "MM-dd-yyyy"]
    sent = F.lit("soon   after lunch")
    for i, form in enumerate(forms):
        sent = F.when((c + t) % 12 == i, F.date_format(day, form)).otherwise(sent)
    to = F.concat(F.lit("\nTo: list "), c.cast("string"), F.lit("\nSubject: turn "), t.cast("string"), F.lit("\n\n"), F.col("text"))
    one = F.concat(F.lit("From: "), F.col("role"), F.lit("@example.org\nDate: "), sent, to)
    turns = _read(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", one.alias("mail")).alias("m"))
    per = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("m")), lambda x: x["mail"]).alias("all"))
    between = F.when(c % 4 == 0, "\n----- Original Message -----\n").when(c % 4 == 1, "\n____\n").when(c % 4 == 2, "\nOn some day, X wrote: \n").otherwise("\n")
    texts = per.select("conv_id", F.array_join("all", "\u0001").alias("joined"), between.alias("between")).select("conv_id", F.replace("joined", F.lit("\u0001"), F.col("between")).alias("text"))
    return mail.mails(texts, "conv_id").select("conv_id", F.col("nth").cast("long").alias("nth"), "sender", "receiver", "subject", "sent", "date")


