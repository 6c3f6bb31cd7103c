"""Text functions as Column expressions: normalisation, tokens, prompts and keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of Unicode text, by code point, and the runs that are tokens.
WHITE = r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
TOKEN = r"[\p{L}\p{N}]+"
#: The same runs, with the commonest letters tried first.
_TOKEN = r"[[a-z][\p{L}\p{N}]]+"
#: Three ranges that hold all white space but the plain one (and more); a text without them needs no search for runs.
_ODD = r"[\t-\x1F\x{85}-\x{A0}\x{1680}-\x{3000}]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def folded(c: str | Column) -> Column:
    """Lower case, ё as е; null as empty."""
    return F.replace(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("ё"), F.lit("е"))


def normalize(c: str | Column) -> Column:
    """Lower case, ё as е, white space runs as one space, trimmed; null as empty."""
    lines = F.replace(folded(c), F.lit("\n"), F.lit(" "))
    return F.trim(let(lines, lambda x: F.when(F.contains(x, F.lit("  ")) | F.rlike(x, F.lit(_ODD)), F.regexp_replace(x, WHITE, " ")).otherwise(x)))


def prefix(c: str | Column, limit: int | None) -> Column:
    return col(c) if limit is None else F.substring(col(c), 1, limit)


def normal_prefix(c: str | Column, limit: int) -> Column:
    """The first ``limit`` characters of the normalised text.

    A first part of the text is normalised, and the whole only where that part comes out too short or has a sigma, whose
    lower case depends on what follows.
    """
    size = limit + limit // 8 + 64
    part = F.substring(col(c), 1, size)
    enough = lambda x: (F.char_length(F.coalesce(col(c), F.lit(""))) <= size) | ((F.char_length(x) >= limit) & ~F.contains(part, F.lit("Σ")))
    return prefix(let(normalize(part), lambda x: F.when(enough(x), x).otherwise(normalize(c))), limit)


def tokenize(c: str | Column) -> Column:
    return field_tokens(c)


def field_tokens(c: str | Column, limit: int | None = None) -> Column:
    """Tokens of the first ``limit`` characters of the normalised text; the cut may fall into a token.

    White space is in no token, so its runs only matter where a limit counts them.
    """
    return F.regexp_extract_all(folded(c) if limit is None else normal_prefix(c, limit), F.lit(_TOKEN), F.lit(0))


def distinct_tokens(c: str | Column, limit: int | None = None) -> Column:
    return F.array_distinct(field_tokens(c, limit))


def passage_prompt(title: str | Column, params: str | Column) -> Column:
    return F.concat(F.lit("passage: "), col(title), F.lit(". "), F.substring(F.coalesce(col(params), F.lit("")), 1, 600))


def query_prompt(query: str | Column, filters: str | Column) -> Column:
    return F.concat(F.lit("query: "), F.coalesce(col(query), F.lit("")), F.lit(". "), F.substring(F.coalesce(col(filters), F.lit("")), 1, 200))


def key_id(*columns: str | Column) -> Column:
    """SHA-256 of the columns as a compact JSON array; a null is ``null``."""
    parts = []
    for c in columns:
        one = F.to_json(F.array(col(c)))
        parts.append(F.when(col(c).isNull(), F.lit("null")).otherwise(F.substring(one, F.lit(2), F.length(one) - 2)))
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def log_positive(c: str | Column) -> Column:
    """log(1 + max(0, x)); null stays null."""
    x = col(c).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.log1p(F.greatest(F.lit(0.0), x)))


def ratio(a: Column, b: Column, floor: float) -> Column:
    """a over b, which counts as ``floor`` at least."""
    return a / F.greatest(b, F.lit(floor))
