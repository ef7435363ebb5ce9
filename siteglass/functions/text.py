"""Text features as column expressions over plain text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .numbers import ratio
from .select import JS_SPACE, WORD_END, WORD_START, let, squeeze, words_of_squeezed

# --- fixed values: word lists and patterns. Patterns named *_MARKS and BYLINE are for lower-cased text,
# which is cheaper to match than a case-folding pattern. ------------------------------------------------
AI_OVERVIEW_KEYWORDS = (
    "how to", "what is", "best way", "steps to", "guide", "tutorial",
    "comparison", "vs", "versus", "benefits", "advantages", "pros and cons",
    "top", "best", "worst", "list", "review", "rating",
)
COMPARISON_WORDS = ("vs", "versus", "compared to", "difference between", "better than")
CONVERSATIONAL_WORDS = ("you", "your", "we", "our", "let's", "here's")
EXPERTISE_KEYWORDS = (
    "certified", "expert", "specialist", "professional", "years of experience", "degree", "qualification",
)
QUESTION_STARTS = ("how", "what", "why", "when", "where", "who", "which")
MONTHS_EN = "january february march april may june july august september october november december".split()
MONTHS_NO = "januar februar mars april mai juni juli august september oktober november desember".split()
FACT_MARKS = r"according to|study shows|research indicates|data from|statistics|survey|[0-9]+%"
STEP_MARKS = r"step [0-9]+|first,|second,|third,|next,|finally,"
VERSUS_MARKS = r"vs\.|versus|compared to|comparison"
REVIEW_MARKS = r"review|rating|score|pros and cons"
DIRECT_OPENINGS = r"^(?i)(to|in order to|the best way to|here's how|follow these steps|the answer is)"
DEFINITION_OPENING = rf"^[A-Z][^.!?]*{JS_SPACE}+(is|are|means|refers to)"
BYLINE = rf"{WORD_START}((by|av){JS_SPACE}+|(forfatter|author):?{JS_SPACE}*)[a-z]{{2}}"
CONTACT_MARKS = (
    r"contact|email|phone|address|@[a-z0-9_.\-]+\.[a-z0-9_]+"
    rf"|\+?[0-9]{{1,4}}[{JS_SPACE[1:-1]}\-]?\(?[0-9]{{3}}\)?[{JS_SPACE[1:-1]}\-]?[0-9]{{3}}[{JS_SPACE[1:-1]}\-]?[0-9]{{4}}"
)
_EN, _NO, _SP = "|".join(MONTHS_EN), "|".join(MONTHS_NO), JS_SPACE
PUBLISH_DATES = (
    rf"(?i)[0-9]{{1,2}}\.{_SP}?({_NO}){_SP}?[0-9]{{4}}",
    r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}",
    rf"(?i)({_EN}){_SP}+[0-9]{{1,2}},?{_SP}+[0-9]{{4}}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}",
)
_GAP = rf"[:{JS_SPACE[1:-1]}]*"
UPDATE_DATES = (
    rf"(?i)oppdatert{_GAP}[0-9]{{1,2}}\.{_SP}?({_NO}){_SP}?[0-9]{{4}}",
    rf"(?i)sist endret{_GAP}[0-9]{{1,2}}\.{_SP}?({_NO}){_SP}?[0-9]{{4}}",
    rf"(?i)updated{_GAP}({_EN}){_SP}+[0-9]{{1,2}},?{_SP}+[0-9]{{4}}",
    rf"(?i)last modified{_GAP}({_EN}){_SP}+[0-9]{{1,2}},?{_SP}+[0-9]{{4}}",
)
# ------------------------------------------------------------------------------


def words(*choices: str, fold: bool = True) -> str:
    """Pattern of whole words (ASCII word borders) out of a list."""
    return ("(?iu)" if fold else "") + WORD_START + "(" + "|".join(choices) + ")" + WORD_END


def has_word(lower_text: Column, choices: Sequence[str]) -> Column:
    """Does one of the (lower-case) words stand in the text? Plain substring tests run first; the pattern
    with its word borders only looks at texts that contain a candidate."""
    candidate = F.contains(lower_text, F.lit(choices[0]))
    for word in choices[1:]:
        candidate = candidate | F.contains(lower_text, F.lit(word))
    return candidate & lower_text.rlike(words(*choices, fold=False))


def matched_keywords(lower_text: Column, keywords: Sequence[str]) -> Column:
    """The keywords that occur, in list order.

    The text is bound first: a column named once inside a lambda is inlined there by the optimizer
    and would be computed again for every keyword.
    """
    listed = F.array(*[F.lit(k) for k in keywords])
    return let(lower_text, lambda t: F.filter(listed, lambda k: F.contains(t, k)))


def is_question(text: Column) -> Column:
    return text.rlike("^(?i)(" + "|".join(QUESTION_STARTS) + ")") | text.contains("?")


def direct_answer(first_paragraph: Column) -> Column:
    return F.coalesce(
        first_paragraph.rlike(DIRECT_OPENINGS)
        | first_paragraph.rlike(DEFINITION_OPENING)
        | ((F.length(first_paragraph) > 50) & first_paragraph.contains("answer")),
        F.lit(False),
    )


def content_format(lower_text: Column, list_items: Column) -> Column:
    return (
        F.when((list_items > 3) & lower_text.rlike(STEP_MARKS), F.lit("step-by-step guide"))
        .when(list_items > 5, F.lit("listicle"))
        .when(lower_text.rlike(VERSUS_MARKS), F.lit("comparison"))
        .when(lower_text.rlike(REVIEW_MARKS), F.lit("review"))
        .otherwise(F.lit("article"))
    )


def has_facts(lower_text: Column) -> Column:
    return lower_text.rlike(FACT_MARKS)


def _sentences(text: Column, longer_than: int) -> Column:
    return F.filter(
        F.transform(F.split(text, r"[.!?]+"), lambda s: F.regexp_replace(s, f"^{JS_SPACE}+|{JS_SPACE}+$", "")),
        lambda s: F.length(s) > longer_than,
    )


def readability(text: Column) -> Column:
    """85 / 75 / 65 / 45 by words per sentence (<15, <20, <25, more); empty text is 0."""

    def band(squeezed: Column) -> Column:
        sentences = F.size(F.filter(F.split(squeezed, r"[.!?]+"), lambda s: ~s.isin("", " ")))
        mean = words_of_squeezed(squeezed) / F.greatest(sentences, F.lit(1))
        return F.when(mean < 15, 85).when(mean < 20, 75).when(mean < 25, 65).otherwise(45)

    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(let(squeeze(text), band))


def question_answering(text: Column, paragraphs: Column) -> Column:
    marks = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    return F.when(
        marks == 0, F.when(F.length(text) > 500, F.lit(70.0)).otherwise(F.lit(40.0))
    ).otherwise(F.least(F.lit(100.0), paragraphs / marks * 80.0))


def overview_score(matched: Column) -> Column:
    """Share of the AI-overview keywords found, 0-100."""
    return F.least(F.lit(100.0), F.size(matched) / F.lit(float(len(AI_OVERVIEW_KEYWORDS))) * 100.0)


def answer_density(text: Column) -> Column:
    """Percent of sentences (over 10 characters, untrimmed sides excluded) that look like answers."""

    def answers(s: Column) -> Column:
        lower = F.lower(s)
        return (
            lower.contains("answer") | lower.contains("solution") | lower.contains("result")
            | s.rlike("^(?i)(to |the |this |here)")
        )

    return let(
        _sentences(text, 10), lambda s: ratio(F.size(F.filter(s, answers)), F.size(s), 100.0)
    )


def conversational_tone(text: Column) -> Column:
    """Conversational words per hundred blank-separated pieces."""
    pieces = F.size(F.split(text, f"{JS_SPACE}+"))
    hits = F.regexp_count(F.lower(text), F.lit(words(*CONVERSATIONAL_WORDS, fold=False)))
    return ratio(hits, pieces, 100.0)


def first_date(text: Column, patterns: Sequence[str]) -> Column:
    """First match of the first pattern that occurs at all. Every pattern ends in a year or holds one,
    so a text without four digits in a row is done after one cheap scan."""
    found = [let(F.regexp_extract(text, p, 0), lambda m: F.when(m != "", m)) for p in patterns]
    return F.when(text.rlike("[0-9]{4}"), F.coalesce(*found))


def has_contact(lower_text: Column) -> Column:
    return lower_text.rlike(CONTACT_MARKS)


def has_byline(lower_text: Column) -> Column:
    return lower_text.rlike(BYLINE)


def initials_label(name: Column) -> Column:
    """``direct_answer`` -> ``Direct Answer``."""
    upper_first = F.array_join(
        F.transform(F.split(name, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " "
    )
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("Unknown")).otherwise(upper_first)
