"""Record keys: ``PREFIX-NUMBER`` codes and what they are made of. All are Column expressions but the NFKC variant."""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordkeep.functions.text import nfkc, nfkc_of

# The grammar of codes, which must be the same wherever codes are exchanged. Under (?U) white space and
# digits are those of Unicode; letters are ASCII ones.
CODE = r"(?U)^\s*([A-Za-z][A-Za-z0-9]*)[\s_-](\d+)\s*$"
#: A code that is in its normal form, as most are.
NORMAL = r"^[A-Z][A-Z0-9]*-(0|[1-9][0-9]*)\z"
EMBEDDED = r"(?U)(?<![A-Za-z0-9])([A-Za-z][A-Za-z0-9]*)\s*[-_ ]\s*(\d+)([A-Za-z]?)(?![A-Za-z0-9_-])"

#: All decimal digits but the ASCII ones, and these beside them.
_DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")
_ASCII = "".join(str(unicodedata.digit(c)) for c in _DIGITS)


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def without_zeros(digits: Column) -> Column:
    """Digits of any script as ASCII ones without leading zeros; kept as text, so no number is too long."""
    return F.regexp_replace(F.translate(digits, _DIGITS, _ASCII), r"^0+(?=[0-9])", "")


def normalize_code(c: Column) -> Column:
    """``PREFIX-NUMBER`` from one letter-led prefix, one separator and digits; null for anything else.

    What has that form already is taken as it is: a single short match instead of three and a translation.
    """
    prefix, digits = F.regexp_extract(c, CODE, 1), F.regexp_extract(c, CODE, 2)
    return F.when(F.rlike(c, F.lit(NORMAL)), c).when(prefix != "", F.concat(F.upper(prefix), F.lit("-"), without_zeros(digits)))


def normalize_code_query(c: Column) -> Column:
    """:func:`normalize_code` of a typed query, compatibility forms folded first."""
    return normalize_code(nfkc(c))


def code_of(query: str) -> str | None:
    """:func:`normalize_code_query` of one literal, on the driver."""
    found = re.fullmatch(CODE.removeprefix("(?U)^").removesuffix("$"), nfkc_of(query))
    digits = "".join(str(unicodedata.digit(c)) for c in found[2]) if found else ""
    return f"{found[1].upper()}-{digits.lstrip('0') or '0'}" if found else None


def embedded(text: Column) -> Column:
    """The part of a text that its first code is read from, '' if there is none; :func:`extract_code` finds the same in it."""
    return F.regexp_extract(text, EMBEDDED, 0)


def extract_code(text: Column) -> Column:
    """The first code inside a text, with an optional one-letter variant kept."""
    prefix, digits, variant = (F.regexp_extract(text, EMBEDDED, i) for i in (1, 2, 3))
    return F.when(prefix != "", F.concat(F.upper(prefix), F.lit("-"), without_zeros(digits), F.upper(variant)))


def code_prefix(code: Column) -> Column:
    """What stands before the last ``-``."""
    return F.regexp_extract(code, r"^(.*)-[^-]*$", 1)


def code_number(code: Column) -> Column:
    """The number behind the last ``-``, null if it is none."""
    return F.substring_index(code, "-", -1).try_cast("bigint")


def normalize_prefix(c: Column) -> Column:
    """A group name of letters and digits in upper case, else null."""
    return _blank_to_null(F.upper(F.regexp_extract(c, r"^\s*([A-Za-z][A-Za-z0-9]*)\s*$", 1)))


def canonical_code(display: Column) -> Column:
    """The code itself if it is already in canonical form, else null."""
    return F.when(normalize_code(display) == display, display)


def record_number(number: Column, code: Column) -> Column:
    """The declared number if it is a non-negative integer, else the code's, else the largest long."""
    declared = F.when(number >= 0, number.cast("bigint"))
    return F.coalesce(declared, F.regexp_extract(code, r"-([0-9]+)[A-Za-z]?$", 1).try_cast("bigint"), F.lit(2**63 - 1))
