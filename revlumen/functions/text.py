"""Text columns: personal-data redaction and the low-signal test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlumen.functions.keywords import MIN_LETTERS

# The redaction patterns and their replacement. The space class
# of the coordinate pattern lists the Unicode spaces that Java's \s leaves out.
EMAIL_PATTERN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE_PATTERN = r"(?:\+?\d{1,3}[ \-.]?)?\(?\d{3}\)?[ \-.]?\d{3}[ \-.]?\d{4}"
SPACES = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
COORDINATE_PATTERN = r"[-+]?\d{1,2}\.?\d*," + SPACES + r"*[-+]?\d{1,3}\.?\d*"
REDACTED = "[REDACTED]"


def redact_pii(text: Column) -> Column:
    """Replace e-mail addresses, then phone numbers, then coordinate pairs.

    Most texts hold neither "@" nor a digit, so two cheap tests on the input
    keep the patterns off them.
    """
    mail = F.when(text.contains("@"), F.regexp_replace(text, EMAIL_PATTERN, REDACTED)).otherwise(text)
    numbers = F.regexp_replace(
        F.regexp_replace(mail, PHONE_PATTERN, REDACTED), COORDINATE_PATTERN, REDACTED)
    return F.when(text.rlike("[0-9]"), numbers).otherwise(mail)


def is_low_signal(text: Column, min_letters: int = MIN_LETTERS) -> Column:
    """True when the whole text has fewer than ``min_letters`` ASCII letters.

    The possessive pattern stops at the letter that settles the question, so
    long texts are not counted to the end.
    """
    return ~text.rlike("(?:[a-zA-Z][^a-zA-Z]*+){%d}" % min_letters)


def is_blank(value: Column) -> Column:
    """True for a missing value and for one of white space only."""
    return F.coalesce(~value.rlike("[^" + SPACES[1:]), F.lit(True))


def sql_string(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def shortest_words(words) -> list[str]:
    """The words without those that contain another one, which never decide."""
    unique = list(dict.fromkeys(words))
    return [w for w in unique if not any(other != w and other in w for other in unique)]


def any_word(column: str, words) -> str:
    """SQL test for a column that contains one of ``words``."""
    tests = [f"contains({column}, {sql_string(w)})" for w in shortest_words(words)]
    return f"({' OR '.join(tests) or 'false'})"
