"""Text expressions that stay inside whole-stage code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: decorative quotes and brackets that matching ignores.
MARKS = "「」『』”“''（）()【】《》"
# Fixed value: separators of lists of names.
NAME_SEPARATORS = r"[、,，;；/]"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip_marks(text: Column | str) -> Column:
    """The text without decorative marks."""
    return F.translate(col(text), MARKS, "")


def stripped(text: Column | str) -> Column:
    """The text without white space at its ends, line ends included."""
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def words(text: Column | str) -> Column:
    """White-space separated words; none for null or blank text."""
    return F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\s+"), lambda w: w != "")


def half_of_words_in(query: str, text: Column | str) -> Column:
    """Whether at least half of the query's words, rounded up, occur in the text once marks are gone; false for an empty query."""
    asked = [w.translate({ord(c): None for c in MARKS}) for w in query.split()]
    if not asked:
        return F.lit(False)
    body = strip_marks(F.coalesce(col(text), F.lit("")))
    hits = sum((F.when(body.contains(w), 1).otherwise(0) for w in asked[1:]), F.when(body.contains(asked[0]), 1).otherwise(0))
    return hits >= max(1, (len(asked) + 1) // 2)


def any_variant_in(variants: list[str], *texts: Column | str) -> Column:
    """Whether one of the variants occurs in one of the texts; blank variants are left out."""
    found = F.lit(False)
    for variant in filter(None, variants):
        for text in texts:
            found = found | F.coalesce(col(text).contains(variant), F.lit(False))
    return found


def contains_either_way(text: Column | str, title: Column | str) -> Column:
    """One contains the other; a blank one matches nothing."""
    a, b = col(text), col(title)
    return (F.length(a) > 0) & (F.length(b) > 0) & (a.contains(b) | b.contains(a))


def only_stop_characters(term: Column | str, stop: str) -> Column:
    """Every character of the trimmed term is a stop character or punctuation, or there is none."""
    return F.trim(col(term)).rlike(f"^[{re.escape(stop)}？?，。！!、 ]*$")


def cleaned_prompt(text: Column | str) -> Column:
    """Control characters become blanks; ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[\x00-\x1f\x7f]", " "))


def cleaned_query(text: Column | str, limit: int = 200) -> Column:
    """Bracketed parts and closing punctuation go as well; at most `limit` characters stay."""
    bare = F.regexp_replace(cleaned_prompt(text), r"[（(][^）)]*[）)]", "")
    return F.left(F.trim(F.regexp_replace(bare, r"[？！。，、；：\s]+$", "")), F.lit(limit))


def occurrences(text: Column | str, needle: str) -> Column:
    """How often the needle occurs, without overlap."""
    body = F.coalesce(col(text), F.lit(""))
    return ((F.length(body) - F.length(F.replace(body, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("long")


def overlapping_occurrences(text: Column | str, needle: str) -> Column:
    """How often the needle occurs, overlaps included."""
    return F.regexp_count(F.coalesce(col(text), F.lit("")), F.lit(f"(?={re.escape(needle)})")).cast("long")


def window_around(text: Column | str, needle: str, before: int, length: int) -> Column:
    """`length` characters from `before` characters ahead of the needle's first place, on one line; null if it does not occur."""
    at = F.instr(col(text), needle)
    return F.when(at > 0, F.regexp_replace(F.substring(col(text), F.greatest(F.lit(1), at - before), F.lit(length)), r"\n", " "))


def name_list(text: Column | str, longest: int = 12, dirty: str = "=") -> Column:
    """Distinct trimmed names of a delimited list; long ones and those with a dirty mark are dropped, and brackets around them."""
    parts = F.transform(F.split(F.coalesce(col(text), F.lit("")), NAME_SEPARATORS), lambda x: F.regexp_replace(F.trim(x), r"^[\[\]【】]+|[\[\]【】]+$", ""))
    return F.array_distinct(F.filter(parts, lambda x: (F.length(x) > 0) & (F.length(x) <= longest) & ~x.contains(dirty)))


def source_parts(value: Column | str) -> Column:
    """The components of a composite source such as `a+b`."""
    return F.transform(F.split(F.coalesce(col(value), F.lit("")), r"\+"), F.trim)


def first_value_per_key(pairs: Column, separator: str = "/") -> Column:
    """A map of `key<separator>value` strings in which the first value of a key wins."""
    keys = F.transform(pairs, lambda x: F.substring_index(x, separator, 1))
    values = F.transform(pairs, lambda x: F.substring(x, F.length(F.substring_index(x, separator, 1)) + 2, F.length(x)))
    distinct = F.array_distinct(keys)
    return F.map_from_arrays(distinct, F.transform(distinct, lambda k: F.element_at(values, F.array_position(keys, k).cast("int"))))


def without_repeated_lines(text: Column | str, noise: list[str] | None = None) -> Column:
    """Trimmed lines without URLs, blank lines, noise tokens and lines equal to the kept line before."""
    lines = F.transform(F.split(col(text), "\n"), lambda x: F.trim(F.regexp_replace(x, r"https?://\S+", "")))
    kept = F.filter(lines, lambda x: (x != "") & (~x.isin(*noise) if noise else F.lit(True)))
    return F.array_join(F.filter(kept, lambda x, i: (i == 0) | (x != F.get(kept, i - 1))), "\n")


def base_name(name: Column | str) -> Column:
    """The name without a bracketed variant and without what follows a middle dot."""
    bare = F.trim(F.regexp_replace(F.coalesce(col(name), F.lit("")), r"[（(][^）)]*[）)]", ""))
    return F.trim(F.substring_index(bare, "·", 1))


def squeezed(text: Column | str) -> Column:
    """Lower case without white space and punctuation: the key of title comparisons."""
    return F.lower(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[^\p{L}\p{N}]+", ""))


def without_markup(text: Column | str) -> Column:
    """Wiki text without comments, templates and link brackets; a link shows its label."""
    bare = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"\{\{[^{}]*\}\}", "")
    return stripped(F.regexp_replace(bare, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"))


def section(text: Column | str, heading: str) -> Column:
    """The trimmed body below `== heading ==` up to the next heading of this level, or null."""
    body = F.regexp_extract(col(text), rf"(?s)(?:^|\n)==\s*{re.escape(heading)}\s*==\s*\n(.*?)(?:\n==[^=]|$)", 1)
    return F.when(body != "", stripped(body))


def template_fields(text: Column | str) -> Column:
    """A map of the `|key = value` lines of a template; the first value of a key wins."""
    lines = F.transform(F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\n\s*\|"), lambda x: x.contains("=")), lambda x: F.regexp_replace(x, r"\}\}\s*$", ""))
    pairs = F.transform(lines, lambda x: F.concat(F.trim(F.substring_index(x, "=", 1)), F.lit("\u0001"), F.trim(F.regexp_replace(x, r"^[^=]*=", ""))))
    return first_value_per_key(pairs, "\u0001")


def speakers(text: Column | str) -> Column:
    """Names that start a dialogue line, in order, repeats included."""
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"(?m)^\s*\*?\s*([^\s：:（(*]{1,20})\s*(?:[（(][^）)\n]*[）)])?\s*[：:]"), F.lit(1))


def quoted_terms(text: Column | str, most: int = 5) -> Column:
    """The first quoted terms of a question."""
    return F.slice(F.regexp_extract_all(col(text), F.lit("[「『“\"]([^」』”\"]+)[」』”\"]"), F.lit(1)), 1, most)


def chinese_number(text: Column | str) -> Column:
    """The number of Arabic digits or of a Chinese numeral up to 999 (a zero may stand before lone ones); null for anything else."""
    digits = F.create_map(*[F.lit(x) for pair in zip("一二三四五六七八九", range(1, 10), strict=True) for x in pair])

    def part(group: int) -> Column:
        return F.regexp_extract(col(text), "^(?:([一二三四五六七八九])百)?零?(?:([一二三四五六七八九]?)十)?([一二三四五六七八九])?$", group)

    def worth(group: int) -> Column:
        return F.coalesce(F.try_element_at(digits, part(group)), F.lit(0))

    tens = F.when(col(text).contains("十"), F.when(part(2) == "", 1).otherwise(worth(2))).otherwise(0)
    value = worth(1) * 100 + tens * 10 + worth(3)
    return F.when(col(text).rlike(r"^\d{1,9}$"), col(text).try_cast("int")).when(value > 0, value)


def tokens_for_facts(text: Column | str, stop: list[str]) -> Column:
    """Lower-cased words, and overlapping pairs of CJK characters (a lone one stays single), without stop tokens."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(r"[a-z0-9_.]+|[一-鿿]+"), F.lit(0))
    pairs = F.transform(
        runs,
        lambda run: F.when(
            run.rlike(r"^[一-鿿]{2,}$"), F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        ).otherwise(F.array(run)),
    )
    return F.filter(F.flatten(pairs), lambda x: ~x.isin(*stop) if stop else F.lit(True))


def html_text(html: Column | str) -> Column:
    """Visible text: scripts, styles, comments and tags go, block ends break lines, common entities are resolved."""
    bare = F.regexp_replace(F.coalesce(col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|ul|ol|table|title|nav|header|footer)\s*>", "\n")
    bare = F.regexp_replace(bare, r"<[^>]*>", "")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(plain))
    return stripped(F.regexp_replace(F.regexp_replace(bare, r"[ \t\r\f]+", " "), r"\s*\n\s*", "\n"))
