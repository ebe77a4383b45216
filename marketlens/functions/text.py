"""String column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A run of letters/digits, or a run of anything else. Title-casing upper-cases the first
# character of every token, so a word starts after ANY non-alphanumeric character
# ("self-employed" -> "Self-Employed"), unlike Spark's initcap which only splits on spaces.
WORD_OR_GAP = r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"

# Characters removed by ``strip_ws`` (``trim`` alone removes only spaces).
WHITESPACE = " \t\n\r\f\v"


def title_case(c: Column | str) -> Column:
    """Lower-case the string, then upper-case the first character of each alphanumeric run."""
    c = F.col(c) if isinstance(c, str) else c
    tokens = F.regexp_extract_all(F.lower(c), F.lit(WORD_OR_GAP), 0)
    return F.array_join(F.transform(tokens, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def strip_ws(c: Column | str) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(c, F.lit(WHITESPACE))
