"""Column functions on texts: normal forms, parsing of dirty values, similarities, keyword classes, hashes."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Abbreviations used in normalised addresses, longest spelling to shortest.
ADDRESS_WORDS = {
    "north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw", "street": "st", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "road": "rd", "lane": "ln", "court": "ct", "circle": "cir", "place": "pl", "terrace": "ter", "parkway": "pkwy", "trail": "trl",
}
MISSING_WORDS = ("", "N/A", "NA", "NONE", "NULL")


def one_of(conditions: list[Column], default: bool = False) -> Column:
    """True if any condition holds; no condition gives ``default``."""
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(default)


def signature(c: Column) -> Column:
    """Upper-case letters and digits."""
    return F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]", "")


def squeeze(c: Column) -> Column:
    """Ends trimmed and runs of blanks made one."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def company_name(c: Column) -> Column:
    """Upper case without articles and punctuation."""
    bare = F.regexp_replace(F.upper(c), r"[^A-Z0-9 ]", " ")
    return squeeze(F.regexp_replace(bare, r"(^| )(THE|AN|A)( |$)", " "))


def legal_form(c: Column) -> Column:
    """The first legal form that occurs as a word: LLC, INC, CORP or LTD."""
    u = F.regexp_replace(F.upper(c), r"[.,]", "")
    forms = (("LLC", r"(^|\s)(LLC|L L C)(\s|$)"), ("INC", r"(^|\s)(INC|INCORPORATED)(\s|$)"), ("CORP", r"(^|\s)(CORP|CORPORATION)(\s|$)"), ("LTD", r"(^|\s)(LTD|LIMITED)(\s|$)"))
    return reduce(lambda w, f: w.when(u.rlike(f[1]), f[0]), forms[1:], F.when(u.rlike(forms[0][1]), forms[0][0]))


def first_match(c: Column, rules: list[tuple[str, list[str]]], default: str | None = None) -> Column:
    """The label of the first rule of which a fragment occurs in the text, whatever the case."""
    u = F.upper(c)
    out = None
    for label, words in rules:
        hit = one_of([u.contains(w.upper()) for w in words])
        out = F.when(hit, label) if out is None else out.when(hit, label)
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default)) if default is not None else out


def person_name(c: Column) -> Column:
    """Upper case without titles and punctuation."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.upper(c), r"[.,]", " "), r"(^| )(MR|MRS|MS|DR|PROF)( |$)", " "))


def phone(c: Column) -> Column:
    """Digits; ten get +1 in front, eleven that begin with 1 get +."""
    d = F.regexp_replace(c, r"[^0-9]", "")
    return F.when(F.length(d) == 10, F.concat(F.lit("+1"), d)).when((F.length(d) == 11) & d.startswith("1"), F.concat(F.lit("+"), d)).otherwise(d)


def address_words(c: Column) -> Column:
    """Lower-case address tokens with usual abbreviations and without ordinal endings."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"[.,]", ""), r"([0-9]+)(st|nd|rd|th)( |$)", "$1$3")
    short = F.create_map(*[F.lit(x) for kv in ADDRESS_WORDS.items() for x in kv])
    return F.transform(F.split(squeeze(bare), " "), lambda t: F.coalesce(F.try_element_at(short, t), t))


def address_text(c: Column) -> Column:
    return F.array_join(address_words(c), " ")


def short_address(c: Column, short: list[tuple[str, str]]) -> Column:
    """Upper case, letters, digits and # only, with whole words replaced by their short forms."""
    out = F.regexp_replace(F.upper(c), r"[^A-Z0-9# ]", " ")
    for word, form in short:
        out = F.regexp_replace(out, rf"\b{word}\b", form)
    return squeeze(out)


def house_number(c: Column) -> Column:
    """The number an address begins with; null if there is none."""
    return F.nullif(F.regexp_extract(F.trim(c), r"^([0-9]+)", 1), F.lit(""))


def address_keys(c: Column) -> Column:
    """Search keys from precise to loose: the whole address, then without directions."""
    words = address_words(c)
    core = F.filter(words, lambda t: ~t.isin("n", "s", "e", "w", "ne", "nw", "se", "sw"))
    return F.array_distinct(F.array(F.array_join(words, " "), F.array_join(core, " ")))


def _grams(text: Column) -> Column:
    """Distinct three-letter shingles of a text of at least three letters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substr(text, i, F.lit(3))))


def _jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def text_trigrams(c: Column) -> Column:
    """Shingles of the whole lower-case text, padded by two blanks before and one after."""
    return _grams(F.concat(F.lit("  "), F.lower(c), F.lit(" ")))


def word_trigrams(c: Column) -> Column:
    """Shingles of each lower-case word, every word padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: _grams(F.concat(F.lit("  "), w, F.lit(" "))))))


def text_similarity(a: Column, b: Column) -> Column:
    return _jaccard(text_trigrams(a), text_trigrams(b))


def word_similarity(a: Column, b: Column) -> Column:
    return _jaccard(word_trigrams(a), word_trigrams(b))


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the length of matching blocks over both lengths, 1 for two empty texts; null if one is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the size of the smaller set; null if one is empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), F.lit(0))


def scan_date(c: Column, first_year: int = 2020, last_year: int = 2030) -> Column:
    """The first MMDDYYYY anywhere in the text that is a date within the years."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - 7, F.lit(1)))
    at = F.transform(starts, lambda i: F.substr(c, i, F.lit(8)))
    dates = F.transform(F.filter(at, lambda s: s.rlike("^[0-9]{8}$")), lambda s: F.try_to_date(s, "MMddyyyy"))
    return F.try_element_at(F.filter(dates, lambda d: d.isNotNull() & F.year(d).between(first_year, last_year)), F.lit(1))


def any_date(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "MM/dd/yyyy", "MMddyyyy", "MMM d, yyyy")) -> Column:
    """The date by the first format that fits, or from ``/Date(milliseconds)/``."""
    ms = F.regexp_extract(c, r"^/Date\((-?[0-9]+)\)/$", 1)
    return F.coalesce(*[F.try_to_date(F.trim(c), f) for f in formats], F.to_date(F.timestamp_millis(F.nullif(ms, F.lit("")).cast("long"))))


def number(c: Column, limit: float = 1e8) -> Column:
    """A number out of a text with currency and thousands signs; null if it is none or at least ``limit``."""
    v = F.regexp_replace(c, r"[$,%\s]", "").try_cast("double")
    return F.when(F.abs(v) < limit, v)


def boolean(c: Column) -> Column:
    """Whether a text says yes; null stays null."""
    return F.lower(F.trim(c)).isin("true", "1", "yes", "t", "y")


def present(c: Column) -> Column:
    """Null for texts that stand for a missing value."""
    return F.when(~F.upper(F.trim(c)).isin(*MISSING_WORDS), c)


def first_present(*cs: Column) -> Column:
    return F.coalesce(*[present(c) for c in cs])


def record_hash(columns: dict[str, Column], bits: int = 256) -> Column:
    """Hash of the record as JSON with sorted keys; columns that vary from run to run must be left out."""
    return F.sha2(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"}), bits)


def surrogate_key(prefix: str, c: Column, digits: int = 12) -> Column:
    """Prefix and the first digits of the MD5 of the trimmed upper-case text."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.upper(F.trim(c)).cast("binary")), 1, digits))


def topics(c: Column, groups: dict[str, list[str]], least_length: int = 20) -> Column:
    """Labels of all groups of which a word occurs; empty for null or short texts."""
    low = F.lower(c)
    hits = F.array(*[F.when(one_of([low.contains(w) for w in words]), F.lit(label)) for label, words in groups.items()])
    return F.when(F.length(c) >= least_length, F.filter(hits, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def relevance(c: Column, exclude: list[str], strong: list[str], medium: list[str]) -> Column:
    """``none`` if an excluding word occurs, else ``high``, ``medium`` or ``low``."""
    u = F.upper(c)
    return F.when(one_of([u.contains(w) for w in exclude]), "none").when(one_of([u.contains(w) for w in strong]), "high").when(one_of([u.contains(w) for w in medium]), "medium").otherwise("low")


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def share_of_words(c: Column, vocabulary: list[str], first: int = 100) -> Column:
    """Share of the first words that are in the vocabulary; 0 without words."""
    head = F.slice(words(F.lower(c)), 1, first)
    known = F.filter(head, lambda w: w.isin(*vocabulary))
    return F.coalesce(F.size(known) / F.nullif(F.size(head), F.lit(0)), F.lit(0.0))


def mailing_line(*parts: Column) -> Column:
    """Parts that are present, joined by a comma and a blank."""
    return F.concat_ws(", ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def name_overlap_boost(a: Column, b: Column, floor: float = 0.85) -> Column:
    """Word Jaccard over words of three or more letters, raised to ``floor`` if one name contains the other."""
    la, lb = F.lower(a), F.lower(b)
    wa, wb = (F.array_distinct(F.filter(F.split(x, r"[^a-z0-9]+"), lambda w: F.length(w) >= 3)) for x in (la, lb))
    j = F.coalesce(_jaccard(wa, wb), F.lit(0.0))
    return F.when(la.contains(lb) | lb.contains(la), F.greatest(j, F.lit(floor))).otherwise(j)
