"""Column functions on text, JSON and vectors; built-in expressions only unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parent that exports name for a message at the head of a tree, and the header of a summary.
ROOT = "00000000-0000-4000-8000-000000000000"
OVERVIEW = r"(?i)^\s*\*\*conversation overview\*\*\s*\n+"


def strip(text: Column) -> Column:
    """Without white space of any script at either end (``trim`` removes plain spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_spaces(text: Column) -> Column:
    """Without spaces of any script at either end, as SQL's trim: line ends and tabs stay."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+\z", "")


def parse_ts(text: Column) -> Column:
    """ISO-8601 with Z or an offset as a timestamp; empty or malformed text is null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))


def content_sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def messages_digest(raws: Column) -> Column:
    """SHA-256 of the compact JSON array whose elements are the raw JSON texts."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", raws), F.lit("]")), 256)


def head_or_parent(parent: Column) -> Column:
    """Null for an empty parent and for the root sentinel."""
    return F.when(~parent.isin("", ROOT), parent)


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits, in order (the unstemmed configuration)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the words, each padded by two spaces before and one after."""
    padded = F.transform(tokens(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    cut = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(cut))


def preview(text: Column, n: int = 90) -> Column:
    """White space collapsed, the first ``n`` characters."""
    return F.substring(F.regexp_replace(text, r"\s+", " "), 1, n)


def clean_summary(text: Column) -> Column:
    """Without a leading bold 'conversation overview' line."""
    return F.regexp_replace(text, OVERVIEW, "")


def word_pattern(terms: list[str]) -> str | None:
    """Whole words, in either case, of any of the terms; a term must begin and end with a word character to match.

    None without terms: a pattern of nothing would match everywhere.
    """
    kept = [t for t in terms if t]
    if not kept:
        return None
    escaped = "|".join("".join(c if c.isalnum() or c == "_" else "\\" + c for c in t) for t in kept)
    return rf"(?iU)(?<!\w)(?=\w)(?:{escaped})(?<=\w)(?!\w)"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either vector is null or zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def l2_normalize(a: Column) -> Column:
    """The vector at length one; a zero vector is unchanged."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x / norm(a))).otherwise(a)
