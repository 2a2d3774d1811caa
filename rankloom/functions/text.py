"""Text columns: normalisation, keys, slugs and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space and Unicode letters/digits, in a form that Java and RE2 both accept.
SPACE = r"[\s\x0B\x85\p{Z}]+"
NOT_WORD = r"[^\p{L}\p{N}]+"
NOT_TERM = r"[^\p{L}\p{N}_-]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(c) -> Column:
    """Strip Unicode white space from both ends."""
    return F.regexp_replace(_col(c), rf"^{SPACE}|{SPACE}$", "")


def normalize_query(c) -> Column:
    """Trimmed, lower-cased text with every run of white space as one blank."""
    return F.regexp_replace(F.lower(trim_space(c)), SPACE, " ")


def query_key(query, context) -> Column:
    """Reuse key of a query inside a context; equal for queries that normalise alike."""
    return F.sha2(normalize_query(F.concat(F.lit("ctx:"), _col(context), F.lit(":"), _col(query))), 256)


def exact_key(query) -> Column:
    """Key of the raw text."""
    return F.sha2(_col(query), 256)


def slugify(c) -> Column:
    """ASCII letters and digits in lower case, anything else as one hyphen, none at the ends."""
    hyphened = F.regexp_replace(_col(c), "[^A-Za-z0-9]+", "-")
    return F.lower(F.regexp_replace(hyphened, "^-+|-+$", ""))


def apply_prefix(query, prefix: str | None) -> Column:
    """Put a scope prefix in front of a query; an absent prefix leaves it as it is."""
    return F.concat_ws(" ", F.lit(prefix), _col(query)) if prefix else _col(query)


def tokens(c, separator: str = NOT_WORD) -> Column:
    """Lower-cased tokens of a text, empty ones dropped."""
    return F.array_remove(F.split(F.lower(_col(c)), separator), "")


def words(c) -> Column:
    """Lower-cased words between white space, empty ones dropped."""
    return tokens(c, SPACE)


def marked_version(c) -> Column:
    """Number of a trailing `` v{N}`` marker, null when there is none."""
    digits = F.regexp_extract(_col(c), r" v([0-9]+)$", 1)
    return F.when(digits != "", digits.cast("bigint"))
