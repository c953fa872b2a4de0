"""Column helpers for text: words, matches, rounding, hashes, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, with the four ASCII separators.
WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


#: The same set, where most letters are ruled out by the first class: two comparisons instead of one a range.
_WS = rf"[[^!-~\x{{a1}}-\x{{167f}}]&&{WS[:-1]}]+"


#: Texts of Latin, Greek, Cyrillic and like letters whose white space is spaces and newlines alone.
_SIMPLE = r"\A[\n -~\x{a1}-\x{167f}]*+\z"


def words(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none.

    Simple texts are split at single spaces, without a pattern, which takes a fifth of the time.
    """
    text = F.coalesce(text, F.lit(""))
    line = F.when(F.contains(text, F.lit("\n")), F.replace(text, F.lit("\n"), F.lit(" "))).otherwise(text)
    simple = F.split(line, " ", -1)
    return F.array_remove(F.when(text.rlike(_SIMPLE), simple).otherwise(F.split(text, _WS, -1)), "")


#: Letters that equal an ASCII letter where case is ignored, besides those that lower() turns into one.
FOLDS = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}


def folded(text: Column, lower: Column | None = None) -> Column:
    """Lower case such that a pattern of ASCII letters finds in it what it finds in `text` if case is ignored.

    `lower` is the text's lower case if there is a column of it: few texts have a letter that differs.
    """
    plain = text
    for letter, other in FOLDS.items():
        plain = F.replace(plain, F.lit(letter), F.lit(other))
    return F.when(contains_any(text, list(FOLDS)), F.lower(plain)).otherwise(F.lower(text) if lower is None else lower)


def times(text: Column, part: str) -> Column:
    """How often `part`, in ASCII, comes in a text; matches of it don't overlap."""
    rest = F.octet_length(F.replace(text, F.lit(part), F.lit("")))
    return F.when(has(text, part), ((F.octet_length(text) - rest) / len(part)).cast("int")).otherwise(0)


def word_count(text: Column) -> Column:
    return F.size(words(text))


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Number of matches that don't overlap: `.` ends at newlines only, digits, spaces and case are Unicode's."""
    return F.regexp_count(text, F.lit(("(?diuU)" if ignore_case else "(?dU)") + pattern))


#: From the most to the least frequent. A search compares what it looks for wherever a text has its first letter.
_FREQUENT = " etaoinshrdlcumwfgypbvkjxqz"


def has(text: Column, part: str) -> Column:
    """Whether `part` is in a text: its end from the rarest letter on is looked for before the whole."""
    rarity = lambda i: _FREQUENT.find(part[i]) if part[i] in _FREQUENT else len(_FREQUENT)
    ends = [i for i in range(len(part)) if i == 0 or i <= len(part) - 3 or rarity(i) == len(_FREQUENT)]
    end, whole = part[max(ends, key=rarity) :], F.contains(text, F.lit(part))
    return whole if end == part else F.contains(text, F.lit(end)) & whole


def contains_any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | has(text, p)
    return out


def r1(x: Column) -> Column:
    """One decimal; halves go up."""
    return F.floor(x * 10 + 0.5) / 10


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def domain(url: Column) -> Column:
    """The authority of a URL with user and port as written; without a scheme the whole string."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.when(found != "", found).otherwise(url)
