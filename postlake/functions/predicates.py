"""Gates on postings, as columns: relevance, exclusion, remote work, locality."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.text import any_of, bound, col, escaped, first_match, holds, keyword_pattern, name_key, scrubbed, token_pattern, whole_word
from postlake.profile import NON_US_REGIONS, REMOTE_BODY_PHRASES, REMOTE_LOCATION_TOKENS, REMOTE_NEGATIONS, US_MARKERS, Excludes, Vocabulary

#: Characters of a description in which domain and skill terms count together.
HEAD = 1200


def _any(text: Column, terms, pattern) -> Column:
    return reduce(or_, [holds(text, x, pattern) for x in terms], F.lit(False))


def _has(text: Column, terms) -> Column:
    return _any(text, terms, keyword_pattern)


def _contains(text: Column, terms) -> Column:
    return _any(text, [x.lower() for x in terms], escaped)


def _joined(title: Column, description: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))


def relevance_tier(title, description, vocabulary: Vocabulary) -> Column:
    """CORE, EXTRA or DOMAIN+SKILL, the first that holds; null for irrelevant and excluded postings.

    Text is lower-cased and scrubbed of boilerplate, except that title exclusions
    read the title as it is.  Domain and skill must both be in the title or the
    first HEAD characters of the description.
    """
    title, description = col(title), col(description)
    text = scrubbed(_joined(title, description), vocabulary.boilerplate)
    head = scrubbed(_joined(title, F.left(description, F.lit(HEAD))), vocabulary.boilerplate)
    tiered = {x.lower() for x in (*vocabulary.core, *vocabulary.domain, *vocabulary.skill)}
    extra = [x for x in vocabulary.extra if x.lower() not in tiered]
    plain = F.lower(F.coalesce(title, F.lit("")))
    both = lambda h: _has(h, vocabulary.domain) & _has(h, vocabulary.skill)
    tier = lambda t: F.when(_contains(t, vocabulary.exclude) | _contains(plain, vocabulary.exclude_title), None).when(_has(t, vocabulary.core), "CORE").when(_has(t, extra), "EXTRA").when(bound(head, both), "DOMAIN+SKILL")
    return bound(text, tier)


def is_relevant(title, description, vocabulary: Vocabulary) -> Column:
    return relevance_tier(title, description, vocabulary).isNotNull()


def core_anchor(title, description, vocabulary: Vocabulary) -> Column:
    """The first core term, in the order of the list, that the posting holds; boilerplate is not scrubbed."""
    return first_match(_joined(col(title), col(description)), vocabulary.core, keyword_pattern)


def is_technical(title, pattern: str) -> Column:
    return F.coalesce(col(title), F.lit("")).rlike("(?i)" + pattern)


def exclude_reason(title, description, excludes: Excludes, boilerplate=(), allow_defense: Column | bool = False) -> Column:
    """Why a posting is dropped, or null: role phrase, title token, defense terms, radar, non-clinical, in this order.

    One strong defense term suffices, of weak ones it takes two; watched employers
    are allowed them.  Without any defense term configured, radar is no reason.
    """
    title, both = F.lower(F.coalesce(col(title), F.lit(""))), _joined(col(title), col(description))
    lowered = lambda terms: [x.lower() for x in terms]
    open_ = ~F.lit(allow_defense) if isinstance(allow_defense, bool) else ~F.coalesce(allow_defense, F.lit(False))

    def defense(text: Column) -> Column:
        strong = first_match(text, lowered(excludes.strong), token_pattern)
        weak = F.array_compact(F.array(*[F.when(holds(text, x, token_pattern), x) for x in lowered(excludes.weak)])) if excludes.weak else F.array().cast("array<string>")
        radar = text.contains("radar") & text.rlike(any_of(token_pattern(x) for x in excludes.radar_context))
        several = bound(weak, lambda w: F.when(F.size(w) >= 2, F.array_join(F.slice(w, 1, 3), "+")))
        return F.concat(F.lit("defense: "), F.coalesce(strong, several, F.when(radar, "military radar")))

    def reason(low: Column) -> Column:
        phrase, token, other = (first_match(c, lowered(terms), whole_word) for c, terms in ((low, excludes.role_phrases), (title, excludes.title_tokens), (low, excludes.nonclinical)))
        found = [F.concat(F.lit("role: "), phrase), F.concat(F.lit("role-title: "), F.upper(token))]
        if excludes.strong or excludes.weak:
            found.append(F.when(open_, bound(scrubbed(low, boilerplate), defense)))
        return F.coalesce(*found, F.concat(F.lit("non-clinical: "), other))

    return bound(both, reason)


def _remote_pattern(term: str) -> str:
    return whole_word(term) if term == "wfh" else escaped(term)


def remote_signal(location, description, hint=None) -> Column:
    """What says that a posting is remote: a structured hint before all, then the location, then the body.

    A negation anywhere vetoes text but not a hint.
    """
    place, body = F.lower(F.coalesce(col(location), F.lit(""))), F.lower(F.coalesce(col(description), F.lit("")))
    no = F.concat(place, F.lit(" \n "), body).rlike(any_of(_remote_pattern(x) for x in REMOTE_NEGATIONS))
    at, said = first_match(place, REMOTE_LOCATION_TOKENS, _remote_pattern), first_match(body, REMOTE_BODY_PHRASES, _remote_pattern)
    text = F.when(no, None).when(at.isNotNull(), F.concat(F.lit("location:"), at)).when(said.isNotNull(), F.concat(F.lit("body:"), said))
    return text if hint is None else F.when(F.coalesce(col(hint), F.lit("")) != "", F.concat(F.lit("hint:"), col(hint))).otherwise(text)


def _region_pattern(term: str) -> str:
    return whole_word(term) if term.isalpha() and len(term) <= 3 else escaped(term)


def us_eligible(location) -> Column:
    """False only for a location that names a region elsewhere and no marker of the US."""
    place = F.lower(F.coalesce(col(location), F.lit("")))
    return (place == "") | place.rlike(any_of(map(_region_pattern, US_MARKERS))) | ~place.rlike(any_of(map(_region_pattern, NON_US_REGIONS)))


def locality_pattern(words, names) -> str:
    """Local words match as words, names anywhere; without either, nothing is local."""
    return any_of([whole_word(x.lower()) for x in words] + [escaped(x.lower()) for x in names])


def geo_mode(location, description, local: str) -> Column:
    """onsite if location or body is local, remote if a signal says so, else null."""
    both = F.lower(F.concat_ws(" ", F.coalesce(col(location), F.lit("")), F.coalesce(col(description), F.lit(""))))
    return F.when(both.rlike(local), "onsite").when(remote_signal(location, description).isNotNull(), "remote")


def geo_bucket(location, remote_eligible, mode, local: str) -> Column:
    """local by the location alone, remote by flag, mode or location, else relocation."""
    remote = F.coalesce(col(remote_eligible), F.lit(False)) | (F.coalesce(col(mode), F.lit("")) == "remote") | remote_signal(location, F.lit("")).isNotNull()
    return F.when(F.lower(F.coalesce(col(location), F.lit(""))).rlike(local), "local").when(remote, "remote").otherwise("relocation")


def company_tokens(name, suffixes=("inc", "llc", "corp", "corporation", "co", "ltd", "company", "the")) -> Column:
    return F.array_except(F.filter(F.split(F.lower(col(name)), "[^a-z0-9]+"), lambda x: x != ""), F.array(*map(F.lit, suffixes)))


def same_company(a: Column, b: Column) -> Column:
    """One token set within the other, both non-empty."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))


# Words before a clearance that must be held today, and what may stand between, as patterns.
CLEARANCE_VERBS = ("active", "current")
CLEARANCE_QUALIFIERS = ("us", r"u\.s\.", "government", "dod", r"top[-\s]?secret", r"ts/?\s?sci", "secret")


def needs_clearance(text, verbs: tuple[str, ...] = (), qualifiers: tuple[str, ...] = ()) -> Column:
    """Whether a text demands a clearance held today; to be eligible for one, or able to obtain it, is no such demand.

    Own verbs and qualifiers are plain words; a space in a qualifier may be a hyphen.
    """
    plain = lambda w: re.sub(r"([.\\+*?\[^\]$(){}=!<>|:#/&~-])", r"\\\1", w)
    first = "|".join(map(plain, verbs) if verbs else CLEARANCE_VERBS)
    between = "|".join((plain(q).replace(" ", r"[-\s]") for q in qualifiers) if qualifiers else CLEARANCE_QUALIFIERS)
    return F.coalesce(col(text), F.lit("")).rlike(rf"(?i)\b(?:{first})\s+(?:(?:{between})\s+)*(?:security\s+)?clearance")


def keep_job(title, description, location, *, technical: str, vocabulary: Vocabulary, excludes: Excludes | None, local: str | None, multi_division: Column | bool = False, watched: Column | bool = False, whole_board: Column | bool = False, boilerplate=()) -> Column:
    """Whether a posting of a company's board stays: all gates of its track together.

    The title is technical; where the employer has many divisions, the posting is
    relevant as well; nothing excludes it, defense terms of watched employers apart
    (``excludes`` None: the track has no such gate).  Boards fetched as a whole
    keep local postings, watched employers' remote ones too (``local`` None: no
    such gate); other boards were fetched by place.
    """
    flag = lambda x: x if isinstance(x, Column) else F.lit(x)
    kept = is_technical(title, technical) & (~flag(multi_division) | is_relevant(title, description, vocabulary))
    if excludes is not None:
        kept &= exclude_reason(title, description, excludes, boilerplate, allow_defense=flag(watched)).isNull()
    if local is not None:
        mode = geo_mode(location, description, local)
        near = F.when(flag(watched), mode.isNotNull()).otherwise(F.coalesce(mode == "onsite", F.lit(False)))
        kept &= ~flag(whole_board) | near
    return kept


# Words too common in employers' names to tell them apart, and what is no employer's name.
GENERIC_WORDS = ("medical", "center", "centre", "health", "healthcare", "regional", "group", "services", "systems", "system", "technology", "technologies", "imaging", "solutions", "associates", "partners", "care", "clinic", "hospital", "labs", "laboratories", "company", "corporation", "global", "national", "american", "international", "the", "and", "inc", "llc")
NO_NAME_START = r"(?i)^(fallback[\s-]?image|compan(y|ies)|directory|home|built in|search|menu|about|contact|careers?|jobs?|privacy|terms|cookie|login|register|company[\s_-]?types?|facility[\s_-]?types?|availability|operator|opt)\b"
NO_NAME_PART = r"(?i)\b(jobs|startups?|startup week|ecosystem|degrees?)\b"


def name_parts(name, generic=GENERIC_WORDS) -> Column:
    """What tells an employer's name: all of it joined, and its words of four and more characters that are not generic."""
    words = F.filter(F.split(F.lower(col(name)), "[^a-z0-9]+"), lambda w: (F.length(w) >= 4) & ~w.isin(*generic))
    return F.array_distinct(F.concat(F.array(name_key(name)), words))


def host_matches(url, name) -> Column:
    """Whether a part of the name with four and more characters is in the URL's host."""
    host = F.replace(F.regexp_extract(F.lower(col(url)), r"^(?:https?://)?([^/]*)", 1), F.lit("www."), F.lit(""))
    slug = F.regexp_replace(host, "[^a-z0-9]", "")
    return F.coalesce(F.exists(name_parts(name), lambda p: (F.length(p) >= 4) & slug.contains(p)), F.lit(False))


def slug_matches(slug, name) -> Column:
    """Whether a board's slug and a part of the name, both of three and more characters, hold one another."""
    s = name_key(F.coalesce(col(slug), F.lit("")))
    return F.coalesce((F.length(s) >= 3) & F.exists(name_parts(name), lambda p: (F.length(p) >= 3) & (s.contains(p) | p.contains(s))), F.lit(False))


def plausible_company(name) -> Column:
    """Whether a text may name an employer: 3 to 44 characters, a letter, no slug, no words of navigation or lists."""
    n = F.trim(F.coalesce(col(name), F.lit("")))
    return F.length(n).between(3, 44) & n.rlike("[A-Za-z]") & ~n.rlike(NO_NAME_START) & ~n.rlike("^[a-z0-9_]+$") & ~n.rlike(NO_NAME_PART)
