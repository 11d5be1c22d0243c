"""Text functions as Column expressions; word and space classes agree with Python's on every engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f]"  # with (?U): exactly Python's white space
# fixed values: sections of an appendix, and words that don't identify an entity
BOILERPLATE_SECTIONS = [
    "see also", "references", "notes", "citations", "sources", "bibliography", "further reading", "external links", "footnotes", "works cited", "primary sources", "general references",
    "explanatory notes",
]
NAME_STOPWORDS = ["the", "of", "a", "an", "and", "emperor", "empress", "king", "queen", "saint", "st", "pope", "general", "consul", "prefect", "divus"]
# fixed values: how titles of list pages begin, and the namespace of names that are addresses (RFC 4122)
SKIPPED_TITLE_PREFIXES = ["List of", "Timeline of", "Outline of", "Index of", "Bibliography of"]
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def strip(c: Column) -> Column:
    """Python's ``str.strip()``."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def collapse_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def tokenize(c: Column) -> Column:
    """Lower-cased words, duplicates and stop words kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"{WORD}+"), F.lit(0))


def normalize_name(c: Column) -> Column:
    return F.lower(collapse_spaces(F.regexp_replace(c, rf"(?U)[^\p{{L}}\p{{N}}_\s\x1c-\x1f]", " ")))


def name_tokens(c: Column, stopwords: list[str] = NAME_STOPWORDS) -> Column:
    words = F.filter(F.split(normalize_name(c), " "), lambda w: w != "")
    return F.array_distinct(F.array_except(words, F.array(*[F.lit(w) for w in stopwords])))


def is_boilerplate(title: Column) -> Column:
    """Whether a heading is made of appendix section names only, joined by "and", a comma or an ampersand."""
    parts = F.filter(F.transform(F.split(title, rf"(?U){SPACE}+and{SPACE}+|{SPACE}*[,&]{SPACE}*"), strip), lambda p: p != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda p: p.isin(BOILERPLATE_SECTIONS))


_HEADING = rf"(?Umd)^(=+){SPACE}*(.+?){SPACE}*=+{SPACE}*$"


def heading_title(section: Column) -> Column:
    """The lower-cased title of the level-2 heading that a section starts with; null if it starts with none."""
    found = F.regexp_extract(section, rf"(?Umd)\A(==)(?!=){SPACE}*(.+?){SPACE}*=+{SPACE}*$", 2)
    return F.when(found != "", F.lower(strip(found)))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[a-zA-Z/][^>\n]*>", "")


def clean_extract(c: Column) -> Column:
    """Narrative text of an article: the trailing appendix cut, heading marks, tags and surplus blank lines removed.

    The text is split before each level-2 heading; sections after the last one that is no appendix are dropped.
    """
    sections = F.split(c, r"(?md)(?=^==(?!=))")
    # 'false' marks narrative, and text before the first heading always is
    flags = F.transform(sections, lambda s: F.coalesce(is_boilerplate(heading_title(s)), F.lit(False)))
    dropped = F.coalesce(F.array_position(F.reverse(flags), F.lit(False)) - 1, F.size(flags))
    dropped = F.when(F.array_contains(flags, False), dropped).otherwise(F.size(flags))
    kept = F.array_join(F.slice(sections, F.lit(1), (F.size(sections) - dropped).cast("int")), "")
    plain = strip_tags(F.regexp_replace(kept, _HEADING, "$2"))
    return strip(F.regexp_replace(plain, r"\n{3,}", "\n\n"))


def overlap_tail(c: Column, overlap: int) -> Column:
    """The last ``overlap`` characters, from after their first blank; none at all for an overlap of 0."""
    if overlap <= 0:
        return F.when(c.isNotNull(), F.lit(""))
    tail = F.substring(c, -overlap, overlap)
    at = F.locate(" ", tail)
    return F.when(F.length(c) <= overlap, c).otherwise(F.when(at > 0, F.substring(tail, at + 1, F.lit(overlap))).otherwise(tail))


def snippet(c: Column, width: int = 200) -> Column:
    return F.concat(F.substring(collapse_spaces(c), 1, width), F.lit("..."))


def point_id(c: Column) -> Column:
    """The name-based UUID (version 5) of a chunk id in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(c, "utf-8")))
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8))), -1, 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def sanitize_name(c: Column) -> Column:
    """Quotes removed, ends stripped; a missing name is empty."""
    return strip(F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit("")))


def wanted_link(ns: Column, exists: Column, title: Column) -> Column:
    """Links to articles of the main space, without disambiguation and list pages."""
    listed = reduce(lambda a, b: a | b, [title.startswith(p) for p in SKIPPED_TITLE_PREFIXES])
    return (ns == 0) & exists & ~title.contains("(disambiguation)") & ~listed
