"""Normal forms of texts, each for one kind of comparison, put together from the same few steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.logic import bound

Step = Callable[[Column], Column]
SPACE = r"\s\p{Z}"
# Marks that the comparisons of keys, of sibling pages and of decorated names leave out.
KEY_MARKS = "「」『』《》【】（）()\\[\\]{}:：,，。.、;；\\-—·!！?？\"'“”‘’"
SIBLING_MARKS = "·・「」『』（）()、，。！？!?：:；;“”\"'’‘\\-—=+*#>\\[\\]"
TITLE_MARKS = "「」（）()·：:，,。！？?！\\-—0-9"
DECORATION = "《》「」『』\"'（）"
LIST_MARKS = "*+\\-：:"


def without(pattern: str) -> Step:
    """Deletes what a pattern matches."""
    return lambda text: F.regexp_replace(text, pattern, "")


def instead(pattern: str, other: str) -> Step:
    return lambda text: F.regexp_replace(text, pattern, other)


def trimmed(marks: str) -> Step:
    """Deletes marks at both ends."""
    return lambda text: F.regexp_replace(text, f"^[{marks}]+|[{marks}]+$", "")


def chain(*steps: Step) -> Step:
    """One step after the other; null is empty."""

    def run(text: Column) -> Column:
        text = F.coalesce(text, F.lit(""))
        for step in steps:
            text = step(text)
        return text

    return run


no_space = without(f"[{SPACE}]+")
no_templates = instead(r"\{\{[^{}]*\}\}", " ")
no_tags = without("<[^>]+>")
labels = instead(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
only_words = without("[^0-9A-Za-z一-鿿]")

#: What each is for: its steps.
NORMALISERS: dict[str, Step] = {
    "base": chain(without("[（(][^）)]*[）)]"), trimmed(SPACE), without("·.*$"), trimmed(SPACE)),
    "title": chain(without(f"[{SPACE}{TITLE_MARKS}]")),
    "key": chain(no_tags, without(f"[{SPACE}{KEY_MARKS}]")),
    "sibling": chain(no_templates, labels, without(f"[{SPACE}{SIBLING_MARKS}]")),
    "cover": chain(no_templates, without(r"[^\p{L}\p{N}_]+")),
    "citation": chain(without(r"[^\p{L}\p{N}]+")),
    "spaceless": chain(no_space),
    "listed": chain(no_space, without(f"^[{LIST_MARKS}]+")),
    "act": chain(no_space, without("^第[0-9一二三四五六七八九十百]+[幕章回]"), trimmed("「」『』")),
    "map": chain(no_tags, only_words),
    "map_loose": chain(no_tags, without("[（(][^（）()]*[）)]"), only_words),
    "shared_title": chain(without("[（(][^）)]*[）)]"), without("(?:·?其[一二三四五六七八九十]+|[上中下]篇?|[0-9]+)$"), without(f"[{SPACE}{KEY_MARKS}]"), F.lower),
    "bare": chain(without(f"[{SPACE}{DECORATION}]")),
    "voice": chain(trimmed(f"{SPACE}「」『』《》\"'"), no_space),
}


def normalised(text: Column, kind: str) -> Column:
    """A text in one of the normal forms."""
    return NORMALISERS[kind](text)


def content_hash(text: str, headings: list[str]) -> Column:
    """SHA-256 over the sections of these headings only, in this order; so a change elsewhere is none. Without any it is that of the whole text."""
    from corpusloom.functions.text import section

    parts = [section(text, heading) for heading in headings]
    some = F.coalesce(*parts).isNotNull()
    return F.sha2(F.when(some, F.concat_ws("\n", *parts)).otherwise(F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256)


# A finite grammar of questions for counts: what stands in place of the kind decides the answer.
QUESTIONS = (
    r"^how many (.*?) ?parts (?:are there|exist|do we have)$",
    r"^(?:list|name|count|show)(?: me)?(?: all)? (.*?) ?parts$",
    r"^(?:which|what) (.*?) ?parts (?:are there|exist)$",
)
COMPLEX = r"\b(?:except|other than|before|after|cheaper|dearer|not)\b"


def asked_kind(question: Column) -> Column:
    """What kind of parts a question asks for, null if it is not of this grammar; politeness, case and marks at its end don't count."""
    plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.trim(question), r"[\s?.!？。！]+$", ""), r"\s+", " ")))

    def named(plain: Column) -> Column:
        found = F.lit(None).cast("string")
        for pattern in reversed(QUESTIONS):
            found = F.when(plain.rlike(pattern), F.regexp_extract(plain, pattern, 1)).otherwise(found)
        return found

    found = bound(F.regexp_replace(plain, "^(?:please|tell me) ", ""), named)
    return bound(found, lambda x: F.when(~x.rlike(COMPLEX), x))


def request(question: Column, kinds: list[str] | Column) -> Column:
    """status and kinds of a question: counted (one kind, or all), ambiguous (several), missing (none named), unsupported; null for other questions.
    kinds: all that are known, as they are or as a column of arrays."""
    known = kinds if isinstance(kinds, Column) else F.array(*map(F.lit, kinds))

    def placed(x: Column) -> Column:
        kind, pieces = x["kind"], x["pieces"]
        status = (
            F.when(kind.isin("all", "all the"), "counted")
            .when(kind.isin("", "these", "those", "such"), "missing")
            .when(F.array_contains(known, kind), "counted")
            .when((F.size(pieces) > 1) & F.forall(pieces, lambda y: F.array_contains(known, y)), "ambiguous")
            .when(kind.isNotNull(), "unsupported")
        )
        return F.struct(status.alias("status"), kind.alias("kind"), pieces.alias("pieces"))

    def answer(x: Column) -> Column:
        named = F.when(x["kind"].isin("all", "all the"), known).when(x["status"].isin("counted", "ambiguous"), F.sort_array(F.array_distinct(x["pieces"])))
        return F.when(x["status"].isNotNull(), F.struct(x["status"].alias("status"), named.alias("kinds")))

    split = bound(asked_kind(question), lambda kind: F.struct(kind.alias("kind"), F.transform(F.split(kind, r" and |, | or |/"), lambda x: F.trim(x)).alias("pieces")))
    return bound(bound(split, placed), answer)
