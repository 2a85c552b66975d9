"""Text columns: keyword patterns, normal forms, ids, dates and markup."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = (r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)")
_SPECIAL = re.compile(r"([\\.^$|?*+()\[\]{}])")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def escaped(term: str) -> str:
    return _SPECIAL.sub(r"\\\1", term)


def whole_word(term: str) -> str:
    """A pattern for a term that stands between characters other than letters, digits and _ (of any script)."""
    return _EDGE[0] + escaped(term) + _EDGE[1]


def keyword_pattern(term: str, short: int = 5) -> str:
    """Short alphabetic terms match as words, others anywhere; in lower case."""
    low = term.lower()
    return whole_word(low) if low.isalpha() and len(low) <= short else escaped(low)


def token_pattern(term: str, short: int = 3) -> str:
    """Terms of up to ``short`` characters match as words, others anywhere."""
    return whole_word(term.lower()) if len(term) <= short else escaped(term.lower())


def any_of(patterns) -> str:
    """One pattern for all; one that never matches for none."""
    patterns = list(patterns)
    return "|".join(f"({p})" for p in patterns) if patterns else "[^\\s\\S]"


def holds(text: Column, term: str, pattern: Callable[[str], str]) -> Column:
    """Whether a term's pattern matches; a term to be found anywhere, or as a word, is looked for as plain characters first."""
    regex = pattern(term)
    for plain in (term, term.lower()):
        if regex == escaped(plain):
            return text.contains(plain)
        if regex == whole_word(plain):
            return text.contains(plain) & text.rlike(regex)
    return text.rlike(regex)


def first_match(text: Column, terms, pattern) -> Column:
    """The first term, in the order given, that occurs in the text; null if none does."""
    out = F.lit(None).cast("string")
    for term in reversed(list(terms)):
        out = F.when(holds(text, term, pattern), F.lit(term)).otherwise(out)
    return out


def scrubbed(text: Column | str, idioms) -> Column:
    """Each match of an idiom becomes one space, whatever its case."""
    idioms = list(idioms)
    return F.regexp_replace(col(text), "(?i)" + any_of(idioms), " ") if idioms else col(text)


def norm_title(c: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(col(c), r"\s+", " ")))


def norm_url(c: Column | str) -> Column:
    """Without scheme, fragment, query and trailing slashes, in lower case."""
    bare = F.regexp_replace(F.lower(F.trim(col(c))), r"^[a-z]+://", "")
    return F.regexp_replace(F.substring_index(F.substring_index(bare, "#", 1), "?", 1), r"/+$", "")


def name_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


def stable_id(*parts: Column | str) -> Column:
    """The same 16 hex digits for the same parts in every run; nulls count as empty."""
    return F.substring(F.sha1(F.concat_ws("||", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])), 1, 16)


def ingest_id(source: Column, url: Column | str, title: Column | str, company: Column | str) -> Column:
    both = F.concat(*[F.coalesce(col(x), F.lit("")) for x in (url, title, company)])
    return F.concat(source, F.lit("_"), F.substring(F.md5(both), 1, 12))


def id_namespace(job_id: Column | str) -> Column:
    """The first two parts of an id with their underscores, null for ids of fewer than three parts."""
    c = col(job_id)
    return F.when(F.size(F.split(c, "_")) >= 3, F.concat(F.substring_index(c, "_", 2), F.lit("_")))


def posted_date(value: Column | str, today: Column) -> Column:
    """A date from ISO text, epoch seconds or milliseconds, or "Posted 3 Days Ago", today and yesterday; else null."""
    text = F.trim(col(value).cast("string"))
    low, number = F.lower(text), F.try_to_number(F.when(text.rlike(r"^[0-9]{1,18}$"), text), F.lit("9" * 18)).cast("double")
    seconds = F.when(number > 1e11, number / 1000).otherwise(number)
    iso, ago = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.regexp_extract(low, r"(\d+)\+?\s*days?\s+ago", 1)
    return (
        F.when(number.isNotNull(), F.when((seconds > 1e8) & (seconds < 1e11), F.to_date(F.timestamp_seconds(seconds))))
        .when(iso != "", F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"))
        .when(low.contains("today") | low.contains("just posted"), today)
        .when(low.contains("yesterday"), F.date_sub(today, 1))
        .when(ago != "", F.date_sub(today, ago.try_cast("int")))
    )


def age_tag(first_seen: Column | str, posted: Column | str, today: Column, stale: int = 45) -> Column:
    """NEW on the day of the first sight, days since posting with ! from ``stale`` on, ? without a date."""
    days = F.datediff(today, col(posted).cast("date"))
    return F.when(col(first_seen).cast("date") == today, "NEW").when(days.isNull(), "?").otherwise(F.concat(days.cast("string"), F.lit("d"), F.when(days >= stale, "!").otherwise("")))


ELISION = "\n[... middle of posting elided ...]\n"


def clipped(c: Column | str, most: int = 12_000, tail: int = 3_000) -> Column:
    """Head and tail of a text that is longer than ``most`` characters, with a mark between them."""
    text, head = F.coalesce(col(c), F.lit("")), max(most - tail, most // 2)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(ELISION), F.right(text, F.lit(most - head))))


def html_text(c: Column | str) -> Column:
    """The text of markup: no scripts, styles and comments, block ends as line feeds, five entities read, spaces single."""
    out = F.regexp_replace(col(c), r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<br[^>]*>|</(p|div|li|ul|ol|h[1-6]|tr)>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r"[ \t\r]+", " ")
    return F.trim(F.regexp_replace(out, r" ?\n[ \n]*", "\n"))
