"""Label text functions as Column expressions: they stay in whole-stage codegen."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@dataclass(frozen=True)
class TokenizerConfig:
    """Options of the label tokenizer.  ``custom`` replaces it: a function from a text column to ``array<string>``."""

    unicode_nfkc: bool = True
    strip: bool = True
    collapse_whitespace: bool = True
    split_camel_case: bool = True
    lowercase: bool = False
    split_on_punct: bool = True
    keep_numbers: bool = True
    custom: Callable[[Column], Column] | None = None


@F.pandas_udf(StringType())
def _nfkc(texts):
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode NFKC.  Only texts with a character beyond ASCII leave the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)


def strip(text: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x1C-\x1F\x85]+|[\s\p{Z}\x1C-\x1F\x85]+$", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\p{Z}\x1C-\x1F\x85]+", " ")


def split_camel(text: Column) -> Column:
    """Blanks at the seams: acronym and word, small and capital letter, letter and digit, digit and letter."""
    for seam in (r"([A-Z]+)([A-Z][a-z])", r"([a-z0-9])([A-Z])", r"([A-Za-z])(\d)", r"(\d)([A-Za-z])"):
        text = F.regexp_replace(text, seam, "$1 $2")
    return text


def tokenizer(cfg: TokenizerConfig = TokenizerConfig()) -> Callable[[Column], Column]:
    """A function from a text column to its tokens; null gives an empty array."""
    if cfg.custom:
        return cfg.custom

    def tokens(text: Column) -> Column:
        for on, fn in ((cfg.unicode_nfkc, nfkc), (cfg.strip, strip), (cfg.collapse_whitespace, collapse), (cfg.split_camel_case, split_camel), (cfg.lowercase, F.lower)):
            if on:
                text = fn(text)
        parts = F.split(text, r"[^\p{L}\p{N}]+" if cfg.split_on_punct else r"[\s\p{Z}]+")
        found = F.filter(parts, lambda t: t != "")
        if not cfg.keep_numbers:
            found = F.filter(found, lambda t: ~t.rlike(r"^\p{Nd}+$"))
        return F.coalesce(found, F.array().cast("array<string>"))

    return tokens


def present(text: Column) -> Column:
    """Not null and not blank."""
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def case_style(text: Column) -> Column:
    """The first of nine styles that fits the stripped text."""
    t = strip(text)
    is_lower = (F.lower(t) == t) & (F.upper(t) != t)
    is_upper = (F.upper(t) == t) & (F.lower(t) != t) & t.rlike(r"^\p{L}+$")
    return (
        F.when(t.isNull() | (t == ""), "empty")
        .when(t.rlike(r"^[a-z][a-zA-Z0-9]*$") & t.rlike("[A-Z]"), "camelCase")
        .when(t.rlike(r"^[A-Z][a-zA-Z0-9]*$") & t.rlike("[a-z]"), "PascalCase")
        .when(t.rlike(r"^[A-Z0-9]+(?:_[A-Z0-9]+)+$"), "UPPER_CASE")
        .when(t.rlike(r"^[a-z0-9]+(?:_[a-z0-9]+)+$"), "snake_case")
        .when(t.rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)+$"), "kebab-case")
        .when(is_lower, "lowercase")
        .when(is_upper, "UPPERCASE")
        .otherwise("mixed")
    )


def is_short(text: Column, n_tokens: Column) -> Column:
    return (F.length(text) < 5) | (n_tokens < 2)


def is_long(text: Column, n_tokens: Column) -> Column:
    return (F.length(text) > 30) | (n_tokens > 8)


def short_construct(label: Column, most: int = 18) -> Column:
    """What follows the first colon, cut to ``most`` characters with an ellipsis."""
    t = F.regexp_replace(label, r"^[^:]*:", "")
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def human_bytes(n: Column) -> Column:
    """Bytes in the largest unit up to TB, with 0 to 2 decimals."""
    out = F.concat(F.format_string("%.0f", n.cast("double")), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        v = n / float(1024**power)
        text = F.when(v >= 100, F.format_string("%.0f", v)).when(v >= 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.2f", v))
        out = F.when(n >= 1024**power, F.concat(text, F.lit(f" {unit}"))).otherwise(out)
    return out
