"""Column builders for text: normalisation, tokens, n-grams, budgets, paths and identifiers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s   -     　﻿]"
WORD = r"([\p{L}\p{N}]+)"
CJK = r"[\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nfkc(x: Column | str, ascii_only: bool = False) -> Column:
    """Compatibility composition. With ascii_only the input is known to be ASCII and Python is left out."""

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return col(x) if ascii_only else composed(col(x))


def trim_unicode(x: Column | str) -> Column:
    return F.regexp_replace(col(x), f"^{_SPACE}+|{_SPACE}+$", "")


def normalize_search_text(x: Column | str, composed: bool = True) -> Column:
    """Lower case, trimmed; NFKC first unless the text is composed already (then all stays in the JVM)."""
    text = F.coalesce(col(x), F.lit(""))
    return trim_unicode(F.lower(text if composed else nfkc(text)))


def words(x: Column | str) -> Column:
    """Maximal runs of letters and digits."""
    return F.regexp_extract_all(col(x), F.lit(WORD), F.lit(1))


def char_ngrams(x: Column | str, n: int) -> Column:
    """All character n-grams in order; none for a shorter text."""
    text = col(x)
    return F.when(
        F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    ).otherwise(F.array().cast("array<string>"))


def tokenize(x: Column | str, composed: bool = True) -> Column:
    """Words of the normalised text; CJK words of three characters or more also give their bigrams and trigrams."""
    text = F.coalesce(col(x), F.lit(""))
    text = F.lower(text if composed else nfkc(text))
    base = words(text)
    more = F.filter(base, lambda t: t.rlike(CJK) & (F.length(t) >= 3))
    grams = F.flatten(F.transform(more, lambda t: F.concat(char_ngrams(t, 2), char_ngrams(t, 3))))
    return F.when(text.rlike(CJK), F.concat(base, grams)).otherwise(base)


def source_tokens(x: Column | str) -> Column:
    """Distinct tokens of a text and of the text split at camel case."""
    text = F.coalesce(col(x), F.lit(""))
    split = F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.array_distinct(F.concat(tokenize(text), tokenize(split)))


def split_pipe(x: Column | str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), r"\|"), lambda v: F.trim(v)), lambda v: v != "")


def normalize_newlines(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"\r\n?", "\n")


def line_at(x: Column | str, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    return F.size(F.split(F.substring(col(x), F.lit(1), offset), "\n"))


def utf16_units(x: Column | str) -> Column:
    return (F.octet_length(F.encode(col(x), "UTF-16BE")) / 2).cast("long")


def ascii_count(x: Column | str) -> Column:
    return F.length(F.regexp_replace(col(x), r"[^\x00-\x7F]", "")).cast("long")


def tokens_of_counts(ascii_chars: Column, other_units: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(ascii_chars / 4.0 + other_units / 1.8)).cast("long")


def approximate_tokens(x: Column | str) -> Column:
    """max(1, ceil(ASCII / 4 + other UTF-16 units / 1.8))."""
    text = F.coalesce(col(x), F.lit(""))
    return tokens_of_counts(ascii_count(text), utf16_units(text) - ascii_count(text))


def truncate_to_tokens(x: Column | str, budget: int, suffix: str = "…") -> Column:
    """The longest prefix that fits the budget together with the suffix; the whole text where it fits."""

    def weight(text: str) -> int:
        a = sum(c < "\x80" for c in text)
        units = sum(1 + (c > "￿") for c in text)
        return max(1, -(-(a * 45 + (units - a) * 100) // 180))

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None or weight(text) <= budget:
                return text
            low, high = 0, len(text)
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if weight(text[:middle] + suffix) <= budget else (low, middle - 1)
            return text[:low].rstrip() + suffix if weight(suffix) <= budget else ""

        return texts.map(one)

    return cut(col(x))


def module_id(x: Column | str, depth: int) -> Column:
    """The first parts of a dotted id."""
    return F.array_join(F.slice(F.split(col(x), r"\."), 1, depth), ".")


def safe_name(x: Column | str) -> Column:
    return F.regexp_replace(col(x), "[^a-z0-9.-]", "-")


def slug(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(col(x), "[^A-Za-z0-9]+", "-")), "^-+|-+$", "")


def to_posix(x: Column | str) -> Column:
    return F.regexp_replace(F.replace(col(x), F.lit("\\"), F.lit("/")), "/+", "/")


def dirname(x: Column | str) -> Column:
    return F.when(col(x).contains("/"), F.regexp_replace(col(x), "/[^/]*$", "")).otherwise(F.lit("."))


def basename(x: Column | str) -> Column:
    return F.regexp_extract(col(x), "([^/]*)$", 1)


def extname(x: Column | str) -> Column:
    """The last extension of a name in lower case; none for names that only begin with a full stop."""
    return F.lower(F.regexp_extract(basename(x), r"^.+(\.[^.]*)$", 1))


def safe_relative_path(x: Column | str) -> Column:
    """Whether a path is relative and stays below its root."""
    return (col(x) != "") & ~col(x).rlike(r"^([/\\]|[A-Za-z]:)") & ~to_posix(x).rlike(r"(^|/)\.\.(/|$)")


def module_key(x: Column | str) -> Column:
    return F.when(col(x).endswith(".go"), F.concat(F.lit("go:"), dirname(x))).otherwise(F.concat(F.lit("file:"), col(x)))


def qualify(x: Column | str, repository: str) -> Column:
    return F.when(col(x).contains("/"), col(x)).otherwise(F.concat(F.lit(f"{repository}/"), col(x)))


def local_id(x: Column | str, repository: str) -> Column:
    return F.when(col(x).startswith(f"{repository}/"), F.substring(col(x), len(repository) + 2, 1 << 30)).otherwise(col(x))


def idf(n: Column, df: Column) -> Column:
    return F.ln(F.lit(1) + (n + 1) / (df + 1))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def stable_map(x: Column | str) -> Column:
    """A map with its keys in order."""
    return F.map_from_entries(F.array_sort(F.map_entries(col(x))))


def looks_volatile(x: Column | str) -> Column:
    """Paths with extensions, line numbers, hashes or dates: things that won't last."""
    patterns = (
        r"(?i)\b(?:[\w.-]+/)+[\w.-]+\.[a-z]{1,6}\b",
        r"(?i)\blines?\s+\d+",
        r":\d+\b",
        r"\b(?=[0-9a-f]*[0-9])[0-9a-f]{12,40}\b",
        r"\b\d{4}-\d{2}-\d{2}\b",
    )
    out = F.lit(False)
    for p in patterns:
        out = out | col(x).rlike(p)
    return out


def key_value(line: Column | str) -> Column:
    """(key, value) of a line key=value, split at the first sign; null if the line has no such key."""
    pattern = r"(?s)^([a-z][a-z0-9_-]*)=(.*)$"
    part = lambda n: F.regexp_extract(line, pattern, n)
    return F.when(col(line).rlike(pattern), F.struct(part(1).alias("key"), part(2).alias("value")))


def json_or(x: Column | str, schema: str, fallback: Column) -> Column:
    """The JSON text as the schema, or the fallback where it is null or broken."""
    return F.coalesce(F.when(F.try_parse_json(col(x)).isNotNull(), F.from_json(x, schema)), fallback)
