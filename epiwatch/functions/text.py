"""String helpers that keep Python's Unicode whitespace semantics on the JVM.

Spark's default ``trim`` strips only the ASCII space and ``\\s`` is ASCII unless
``(?U)`` is set.  Python's ``str.strip``/``\\s`` also cover tabs, NBSP, the
Unicode space separators and the information separators U+001C..U+001F.  The
helpers use ``trim`` with that explicit character set (a plain character scan,
no regex) and test blankness as "trims to empty".
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character for which Python's str.isspace() is true.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000")
_REGEX_META = set(".^$*+?{}[]\\|()")


def utrim(col: Column | str) -> Column:
    """Strip leading/trailing Unicode whitespace (``str.strip()`` semantics)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(c, F.lit(PY_WHITESPACE))


def is_blank(col: Column | str) -> Column:
    """True when the text is empty or whitespace only (NULL stays NULL)."""
    return utrim(col) == F.lit("")


def blank_to_null(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(is_blank(c), F.lit(None).cast("string")).otherwise(c)


def replace_all(col: Column | str, pairs: Iterable[tuple[str, str]]) -> Column:
    """Apply regex replacements one after another (dictionary order)."""
    c = F.col(col) if isinstance(col, str) else col
    for pattern, replacement in pairs:
        if not (set(pattern) & _REGEX_META):   # literal pattern: plain substring replace
            c = F.replace(c, F.lit(pattern), F.lit(replacement))
        else:
            c = F.regexp_replace(c, pattern, replacement.replace("\\", "\\\\").replace("$", "\\$"))
    return c


def map_labels(col: Column | str, pairs: Iterable[tuple[str, str]]) -> Column:
    """Exact-match dictionary lookup; values without an entry are kept."""
    c = F.col(col) if isinstance(col, str) else col
    pairs = list(pairs)
    if not pairs:
        return c
    lookup = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    return F.coalesce(F.try_element_at(lookup, c), c)


def head_before(col: Column | str, sep: str = " (") -> Column:
    """Text before the first occurrence of ``sep`` (whole text when absent)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.substring_index(c, sep, 1)


def contains_ci(col: Column | str, needle: str | Column) -> Column:
    """Case-insensitive literal substring test; NULL text gives false.

    Both sides are upper-cased, as pandas ``str.contains(case=False,
    regex=False)`` does (this differs from lower-casing for e.g. 'ß')."""
    c = F.col(col) if isinstance(col, str) else col
    n = F.lit(needle) if isinstance(needle, str) else needle
    return F.coalesce(F.upper(c).contains(F.upper(n)), F.lit(False))
