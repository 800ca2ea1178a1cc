"""String tests as codegen-friendly Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CASED = r"\p{Lu}\p{Ll}\p{Lt}"
# A title-cased word has a capital, no capital after a cased letter and no small letter
# after anything uncased. Two linear scans, no nested repetition.
HAS_CAPITAL = r"[\p{Lu}\p{Lt}]"
BREAKS_TITLE = rf"[{CASED}][\p{{Lu}}\p{{Lt}}]|(?:^|[^{CASED}])\p{{Ll}}"

# White space of Unicode and the four separators that count as such, for a character class.
WHITE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
URL_LIKE = r"http|www|://"


def istitle(c: Column) -> Column:
    # a text that begins with one of a to z is no title; most words are settled by this alone
    return ((c < "a") | (c >= "{")) & c.rlike(HAS_CAPITAL) & ~c.rlike(BREAKS_TITLE)


def isupper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def islower(c: Column) -> Column:
    return (F.lower(c) == c) & (F.upper(c) != c)


def isspace(c: Column) -> Column:
    return c.rlike(f"^[{WHITE}]+$")


def isdigit(c: Column) -> Column:
    return c.rlike(r"^\p{Nd}+$")


def isalpha(c: Column) -> Column:
    return c.rlike(r"^\p{L}+$")


def count_char(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def count_class(c: Column, char_class: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{char_class}]", ""))


def is_url_token(c: Column) -> Column:
    """The loose test used for URL excerpts and URL profiling."""
    return c.contains("http") | c.contains("://") | c.contains("www.")


def first_index(text: Column, needle) -> Column:
    """0-based position of the first hit, -1 when absent."""
    return F.instr(text, F.lit(needle) if isinstance(needle, str) else needle) - 1


def last_index(text: Column, needle: str) -> Column:
    """0-based position of the last hit, -1 when absent; searches the reversed text."""
    back = F.instr(F.reverse(text), needle[::-1])
    return F.when(back == 0, F.lit(-1)).otherwise(
        F.length(text) - back - (len(needle) - 1)
    )


def fold_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def to_ascii(c: Column) -> Column:
    """Folded accents, and the letters that spell out as two."""
    out = fold_accents(c)
    for letter, spelled in SPELLED.items():
        out = F.replace(out, F.lit(letter), F.lit(spelled))
    return out


SPELLED = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O"}
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def title(c: Column) -> Column:
    """Capital after anything that is no letter, small letters elsewhere."""
    parts = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(
        F.transform(
            parts,
            lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))),
        ),
        "",
    )


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body uses it.

    Steps that use their input several times would otherwise grow exponentially when they
    are chained or when a filter is pushed below them.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
