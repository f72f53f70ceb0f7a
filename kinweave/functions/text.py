"""String and token columns. All of them are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# fixed values: characters deleted, and characters turned into spaces, by default
DELETED = r"[^ \-_A-Za-z0-9]+"
SPACED = r"[\-_]"


def clean(
    col: Column,
    lowercase: bool = True,
    replace_by_none: str | None = DELETED,
    replace_by_whitespace: str | None = SPACED,
    remove_brackets: bool = True,
) -> Column:
    """Lower-case, drop bracketed text and special characters, turn - and _ into one space, trim."""
    out = F.lower(col) if lowercase else col
    if remove_brackets:
        bare = F.regexp_replace(out, r"\[[^\n]*?\]|\([^\n]*?\)|\{[^\n]*?\}", "")
        # most values hold no bracket at all, and a plain search is much cheaper than the pattern
        open_ = F.contains(out, F.lit("(")) | F.contains(out, F.lit("[")) | F.contains(out, F.lit("{"))
        out = F.when(open_, bare).otherwise(out)
    if replace_by_none:
        out = F.regexp_replace(out, replace_by_none, "")
    if replace_by_whitespace == SPACED:
        out = F.translate(out, "-_", "  ")
    elif replace_by_whitespace:
        out = F.regexp_replace(out, replace_by_whitespace, " ")
    return F.trim(F.regexp_replace(out, r"\s\s+", " "))


def clean_strings(df: DataFrame, skip: tuple[str, ...] = ("latitude", "longitude")) -> DataFrame:
    """:func:`clean` on every string column but the skipped ones."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]
    return df.withColumns({n: clean(F.col(n)) for n in names})


def mask_value(col: Column) -> Column:
    """Every occurrence of the value's last three characters becomes XXX; an empty value becomes XXX."""
    text = col.cast("string")
    return F.when(F.length(text) == 0, F.lit("XXX")).otherwise(
        F.replace(text, F.right(text, F.lit(3)), F.lit("XXX"))
    )


def mask_tail(df: DataFrame, skip: tuple[str, ...] = ("cluster_id",)) -> DataFrame:
    return df.select(
        *[F.col(c) if c in skip else mask_value(F.col(c)).alias(c) for c in df.columns]
    )


def tokenize(col: Column, pattern: str = r"[ ,]") -> Column:
    """Non-empty pieces between separators (space and comma; the plain form splits on space only)."""
    return F.filter(F.split(col, pattern), lambda t: t != "")


def word_tokens(col: Column) -> Column:
    """Words and numbers, punctuation left out."""
    return F.regexp_extract_all(col, F.lit(r"[A-Za-z0-9]+"), 0)


def _is_digits(token: Column) -> Column:
    return token.rlike("^[0-9]+$")


def strip_digit_tokens(col: Column) -> Column:
    """The text without its all-digit tokens."""
    return F.array_join(F.filter(tokenize(col), lambda t: ~_is_digits(t)), " ")


def digit_tokens(col: Column) -> Column:
    """All-digit tokens in a fixed order: two texts with equal results hold the same numbers."""
    return F.sort_array(F.filter(tokenize(col), _is_digits))


def same_digit_multiset(a: Column, b: Column) -> Column:
    return digit_tokens(a) == digit_tokens(b)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets; two empty sets give null."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty strings are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a.isNull() | b.isNull(), None).otherwise(
        F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)
    )


def cluster_label(rec_id: Column) -> Column:
    """True cluster of a record id: its first two parts between hyphens."""
    return F.substring_index(rec_id, "-", 2)


def html_lines(df: DataFrame, html_col: str, n: int = 250, element: str | None = None) -> DataFrame:
    """First ``n`` non-empty text lines of a page (or of one element), one row per line.

    Works row by row: script and style bodies and comments go, block ends and ``<br>`` break lines.
    """
    body = F.col(html_col)
    if element:
        body = F.regexp_extract(body, rf"(?is)<{element}\b[^>]*>(.*?)</{element}>", 1)
    body = F.regexp_replace(body, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    body = F.regexp_replace(body, r"(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr|title)>", "\n")
    body = F.regexp_replace(body, r"<[^>]*>", "")
    lines = F.filter(F.transform(F.split(body, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    rest = [c for c in df.columns if c != html_col]
    return df.select(*rest, F.posexplode(F.slice(lines, 1, n)).alias("line_no", "line"))
