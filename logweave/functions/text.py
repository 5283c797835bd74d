"""Text cleaning and similarity as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that stand for a missing value, in any case.
NULL_TOKENS = ["", "-", "--", "?", "n/a", "na", "none", "null", "unknown"]


def once(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def no_null_tokens(c: Column) -> Column:
    """The trimmed text, or null where it is a token for a missing value."""
    return once(F.trim(c), lambda t: F.when(~F.lower(t).isin(NULL_TOKENS), t))


def clean_number(c: Column) -> Column:
    """A finite number written with optional thousands commas, else null."""
    return once(F.regexp_replace(F.trim(c), ",", ""), _finite)


def _finite(plain: Column) -> Column:
    return F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))


def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition leaves of characters beyond ASCII when combining marks are gone: those that give one
    ASCII character, these characters, and those that give several with a letter or digit among them."""
    single, several = {}, {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x30000)):
        left = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not 0x300 <= ord(x) <= 0x36F)
        if len(left) == 1 and left.isascii() and left.isalnum():
            single[chr(code)] = left
        elif len(left) > 1 and any(x.isascii() and x.isalnum() for x in left):
            several[chr(code)] = "".join(x if x.isascii() else " " for x in left)
    return "".join(single), "".join(single.values()), several


MARKED, PLAIN, SEVERAL = _plain_letters()
#: Combining marks that text in decomposed form carries.
MARKS = "[\\u0300-\\u036F]+"


def _class_of(letters) -> str:
    """A character class of single code points, neighbours as ranges."""
    codes, parts = sorted(map(ord, letters)), []
    for c in codes:
        if parts and parts[-1][1] == c - 1:
            parts[-1][1] = c
        else:
            parts.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in parts) + "]"


_HAS_SEVERAL = _class_of(SEVERAL)


def _spelt_out(c: Column) -> Column:
    """Text with ligatures, fractions, units and the like as the letters they stand for. Most texts have none and stay whole."""
    known = F.str_to_map(F.lit("\x01".join(f"{a}\x02{b}" for a, b in SEVERAL.items())), F.lit("\x01"), F.lit("\x02"))
    letters = F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(known, x), x))
    return F.when(c.rlike(_HAS_SEVERAL), F.array_join(letters, "")).otherwise(c)


def slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits with single dashes between words; letters lose their marks, and what stands for
    several letters is spelt out, as compatibility decomposition has it."""
    plain = F.translate(F.regexp_replace(_spelt_out(c), MARKS, ""), MARKED, PLAIN)
    return F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def similarity(a: Column, b: Column) -> Column:
    """One less the edit distance as a share of the longer text; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def name_similarity(a: Column, b: Column) -> Column:
    """Similarity of the names' slugs: 0 if one is empty, 1 if equal; one within the other from 0.8 to 0.95 by the lengths."""
    x, y = slug(a), slug(b)
    ratio = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.8 + 0.15 * ratio).otherwise(similarity(x, y))


def edit_budget(s: Column) -> Column:
    """Edits that a slug of this length may have: none up to 3 letters, 1 up to 6, else 2."""
    return F.when(F.length(s) <= 3, 0).when(F.length(s) <= 6, 1).otherwise(2)
