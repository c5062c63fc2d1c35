"""Questions and answers by rules: complexity and its band, validation, small talk, extractive summaries, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorestream.functions import text as T

# Words and phrases that make a question complex, and those of small talk, unsafe texts and offers.
COMPARING = "compare contrast difference versus vs better worse more less similar different analyze evaluate".split()
ANALYTIC = "why how explain analyze evaluate assess determine investigate explore understand reason cause effect".split()
HOPS = ("and then", "after that", "following", "subsequently", "therefore", "as a result", "consequently", "in addition", "furthermore")
GREETINGS = ("hi", "hey", "hello", "yo", "sup", "greetings", "good morning", "good afternoon", "good evening", "how are you", "what's up", "whats up", "how's it going", "hows it going", "howdy", "hiya")
THANKS = ("thanks", "thank you", "ok", "okay", "got it", "yes", "no", "yeah", "yep", "nope", "sure", "alright", "cool", "great", "perfect", "awesome")
NOTHING = ("test", "testing", "hello world", "test test", ".", "..", "...", "?", "??")
ASKING = "who what where when why how which whose can could would should is are do does tell show explain describe find search".split()
UNSAFE = r"(?i)<script|javascript:|eval\(|exec\("
OFFERS = (
    "would you like to know more", "would you like me to", "would you like details", "would you like to hear", "shall i explain", "shall i provide", "want me to elaborate", "want to know more", "interested in",
    "let me know if you", "if you.*d like.*more", "feel free to ask", "happy to provide", "can provide more", "more information.*available", "if needed.*clarification", "if needed.*further", "could assist", "could help",
    "further clarification", "further details", "further information", "additional information", "additional details", "more details", "if you need", "if you require", "should you need", "should you require",
    "for more information", "to learn more", "for further",
)


def complexity(query: Column, entities: Column | None = None) -> Column:
    """0.1 to 0.95: length, named entities where counted, comparing and analytic words, steps, and marks of structure."""
    low = F.lower(query)
    words = F.array_distinct(T.words(low))
    among = lambda listed: F.size(F.array_intersect(words, F.array(*map(F.lit, listed))))
    hops = sum((F.contains(low, F.lit(h)).cast("int") for h in HOPS), F.lit(0))
    capped = lambda n, of: F.least(n / of, F.lit(1.0))
    score = 0.2 * capped(F.size(T.words(query)), 20) + 0.3 * capped(among(COMPARING) + among(ANALYTIC), 3) + 0.15 * capped(hops, 2) + 0.15 * capped(F.regexp_count(query, F.lit("[?,;]")), 3)
    score = score if entities is None else score + 0.2 * capped(entities, 3)
    return F.greatest(F.lit(0.1), F.least(score, F.lit(0.95)))


def band(score: Column) -> Column:
    return F.when(score < 0.3, "simple").when(score < 0.6, "moderate").otherwise("complex")


def verdict(query: Column, longest: int = 4000) -> Column:
    """Whether a text is taken as a question: ok, or missing, empty, too_long, unsafe, symbols, noise."""
    q = F.regexp_replace(query, r"^\s+|\s+$", "")
    letters = F.length(F.regexp_replace(F.lower(q), "[^a-z0-9]", ""))
    return (
        F.when(query.isNull(), "missing").when(q == "", "empty").when(F.length(q) > longest, "too_long").when(q.rlike(UNSAFE), "unsafe")
        .when(q.rlike(r"^[^\p{L}\p{N}_\s]+$"), "symbols").when(q.rlike(r"[^\p{L}\p{N}_\s]") & (letters <= 3), "noise").otherwise("ok")
    )


def small_talk(query: Column) -> Column:
    """greeting, acknowledgment or meaningless; null for anything that asks or says more."""
    low = F.regexp_replace(F.lower(query), r"^\s+|\s+$", "")
    words = F.regexp_extract_all(low, F.lit("[a-z0-9']+"), F.lit(0))
    compact = F.array_join(words, " ")
    bare = F.replace(compact, F.lit("'"), F.lit(""))
    among = lambda listed: compact.isin(*listed) | bare.isin(*listed)
    short = (F.size(words) == 1) & (F.length(words[0]) <= 2) & ~compact.isin(*GREETINGS, *THANKS)
    return (
        F.when(low == "", None).when(low.isin(*NOTHING) | short, "meaningless").when(F.arrays_overlap(words, F.array(*map(F.lit, ASKING))), None)
        .when(among(GREETINGS), "greeting").when(among(THANKS), "acknowledgment").when(among(NOTHING), "meaningless")
    )


def summary(answer: Column, sentences: int = 2, short: int = 150) -> Column:
    """A short answer as it is, else its first sentences that offer nothing; where all offer, the first."""
    bare = F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+|\s+$", "")
    cut = F.transform(F.split(bare, r"[.!?]+\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    facts = F.slice(F.filter(cut, lambda s: (s != "") & ~F.lower(s).rlike("|".join(OFFERS))), 1, sentences)
    chosen = F.when(F.size(facts) > 0, F.array_join(facts, ". ")).otherwise(cut[0])
    return F.when(F.length(bare) < short, bare).when(chosen.rlike(r"[.!?]$"), chosen).otherwise(F.concat(chosen, F.lit(".")))


def confidence(relevance: Column, verified: Column, cited: Column, documents: Column, answered: Column, caps: list[tuple[str, float, Column]] | None = None) -> Column:
    """Struct of confidence, uncapped and caps: mean relevance, mean verification (0.5 without any), citations against one or two expected, and whether there is an answer.

    Caps are (reason, limit, condition); of those that are met and lower the score the least holds.
    """
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    floor = F.when(documents > 0, 0.5).otherwise(0.0)
    support = F.least(cited / F.greatest(F.lit(1), F.least(F.lit(2), documents)), F.lit(1.0))
    whole = clamp(0.5 * clamp(F.coalesce(relevance, F.lit(0.0))) + 0.25 * clamp(F.coalesce(verified, floor)) + 0.15 * support + 0.1 * F.when(answered, 1.0).otherwise(0.0))
    met = F.filter(F.array(*(F.struct(F.lit(n).alias("reason"), F.lit(c).alias("cap"), F.coalesce(on, F.lit(False)).alias("on")) for n, c, on in caps or [("", 1.0, F.lit(False))])), lambda x: x["on"] & (x["cap"] < whole))
    least = F.array_min(F.transform(met, lambda x: x["cap"]))
    return F.struct(F.round(F.coalesce(least, whole), 6).alias("confidence"), F.round(whole, 6).alias("uncapped"), F.transform(met, lambda x: x["reason"]).alias("caps"))
