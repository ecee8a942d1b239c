"""Text expressions: blocks' keys, redaction, masking, estimates, error rates. All are Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIM = r"^\s+|\s+$"

# Fixed values of the neutral profile (RE2-safe: no look-around, no word boundary).
PHI_PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]", True),
    ("ip", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[IP]", False),
    ("card", r"[0-9]{16}", "[CARD]", True),
)
SECRET_PATTERNS = (
    (r"sk-[A-Za-z0-9_-]{8,}", "sk-***"),
    (r"(?i)bearer\s+[A-Za-z0-9._~+/=-]{8,}", "Bearer ***"),
    (r"(?i)([?&](?:key|token|api[_-]?key)=)[^&\s]+", "${1}***"),
    (r"(?i)((?:password|secret|token|api[_-]?key)\s*[:=]\s*)\"?[A-Za-z0-9._+/-]{6,}\"?", "${1}***"),
)


def trimmed(text: Column) -> Column:
    """Strip white space of every kind, not spaces only."""
    return F.regexp_replace(text, TRIM, "")


def short_hash(*parts: Column, length: int = 8) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", *parts)), 1, length)


def redacted(text: Column, patterns=PHI_PATTERNS) -> Column:
    """Patterns in order, each over the result of the one before."""
    return reduce(lambda t, p: F.regexp_replace(t, p[1], p[2]), patterns, text)


def blocking_findings(text: Column, patterns=PHI_PATTERNS, blocking_only: bool = False) -> Column:
    """Ordered keys of the patterns found in the raw text."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p, _, blocks in patterns if blocks or not blocking_only]))


def masked_secrets(text: Column, limit: int, patterns=SECRET_PATTERNS) -> Column:
    """Mask key-like values, then keep the first ``limit`` characters (the message length limit of a ledger row)."""
    return F.left(reduce(lambda t, p: F.regexp_replace(t, p[0], p[1].replace("${1}", "$1")), patterns, text), F.lit(limit))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 2)).cast("long")


def truncated(text: Column, budget: Column | int) -> Column:
    """Texts over the budget end in three dots within it."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    return F.when(F.length(text) > budget, F.concat(F.left(text, F.greatest(budget - 3, F.lit(0))), F.lit("..."))).otherwise(text)


def signature(text: Column) -> Column:
    """Lower case, white space and punctuation removed (the native subset of the compatibility signature)."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def terms(text: Column) -> Column:
    """Lower-cased maximal runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def char_error_rate(hypothesis: Column, reference: Column) -> Column:
    """min(1, distance / length); an empty reference gives 0 for an empty hypothesis and 1 otherwise."""
    distance = F.levenshtein(hypothesis, reference)
    return F.when(F.length(reference) == 0, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(
        F.least(F.lit(1.0), distance / F.greatest(F.length(reference), F.lit(1)))
    )


def bigrams(text: Column) -> Column:
    """Distinct character bigrams of the signature."""
    s = signature(text)
    return F.when(F.length(s) < 2, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2))))
    )


def ordered_union(*arrays: Column) -> Column:
    """Distinct values in order of first appearance."""
    return F.array_distinct(F.concat(*arrays))
