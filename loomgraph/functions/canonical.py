"""Canonical forms of names: equality up to letter case, white space, punctuation and invisible characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and marks that show nothing: grapheme joiner, Hangul fillers, variation selectors, the blank braille pattern.
_BLANKS = r"\x{34F}\x{115F}\x{1160}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}"
#: White space, punctuation (with ASCII symbols), control, format and unassigned characters, and the blanks.
IGNORED = r"[\s\p{Z}\p{P}\p{C}$+<=>^`|~" + _BLANKS + "]+"
#: What leaves nothing to see.
UNSEEN = r"[\s\p{Z}\p{C}" + _BLANKS + "]+"


def canonical(c: Column) -> Column:
    """Null becomes ''. Upper before lower case makes forms of one letter agree (the two small sigmas); sharp s is ss."""
    return F.replace(F.lower(F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), IGNORED, ""))), F.lit("ß"), F.lit("ss"))


def is_blank(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), UNSEEN, "") == ""


def canonical_pair(x: Column, y: Column) -> Column:
    """Two canonical values in byte order, so it does not matter which column holds which."""
    return F.concat_ws("\u0001", F.least(x, y), F.greatest(x, y))


def pair_key(a: Column, b: Column) -> Column:
    """The two values' canonical forms in byte order."""
    return canonical_pair(canonical(a), canonical(b))
