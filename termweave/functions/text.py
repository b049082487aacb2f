"""Scalars on text (B-1 to B-4, B-19 to B-22): column expressions, but for the sequence ratio."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab

_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
#: A character that isn't white space.
_INK = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"
#: What full case folding does beyond lower case.
_FOLDS = (("ß", "ss"), ("ς", "σ"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))
STRENGTH = r"(?iu)\b\d+(?:\.\d+)?\s*(?:mg|mcg|µg|ug|g|ml|l|unit|units|iu|%)\b"


def casefold(c: Column) -> Column:
    out = F.lower(c)
    for a, b in _FOLDS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normalize_text(c: Column) -> Column:
    """White space collapsed and stripped, case folded; punctuation stays. Null stays null."""
    return casefold(F.trim(F.regexp_replace(c, _SPACE, " ")))


def is_blank(c: Column) -> Column:
    return F.coalesce(~c.rlike(_INK), F.lit(True))


def tokenize(c: Column) -> Column:
    """Runs of a-z and 0-9 of two characters or more, case folded; accents separate."""
    return F.filter(F.regexp_extract_all(casefold(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: F.length(x) >= 2)


def token_overlap(source: Column, target: Column) -> Column:
    """The share of the source's distinct tokens that the target has; 0 without tokens."""
    own = F.array_distinct(tokenize(source))
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, tokenize(target))) / F.size(own)).otherwise(F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def _ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    seen: dict[tuple[str, str], float] = {}
    for a, b in batches:
        out = []
        for pair in zip(a, b, strict=True):
            if None in pair:
                out.append(None)
                continue
            if pair not in seen:
                if len(seen) > 200_000:
                    seen.clear()
                seen[pair] = SequenceMatcher(None, *pair).ratio()
            out.append(seen[pair])
        yield pd.Series(out, dtype=float)


def lexical_similarity(source: Column, target: Column) -> Column:
    """The larger of sequence ratio and token overlap; 1 if normalized equal, 0 if either is empty. Not symmetric.

    The ratio runs in Python, only where it can matter: not for equal or empty pairs, nor where the overlap is whole.
    """
    a, b = normalize_text(source), normalize_text(target)
    overlap = token_overlap(source, target)
    known = (a == b) | (a == "") | (b == "") | (overlap >= 1)
    ratio = F.coalesce(_ratio(F.when(~known, a), F.when(~known, b)), F.lit(0.0))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.greatest(ratio, overlap))


def extract_strength(c: Column) -> Column:
    """The first strength, such as `50 MG`; null if there is none."""
    found = F.trim(F.regexp_extract(c, STRENGTH, 0))
    return F.when(found != "", found)


def lookup(values: dict[str, int], c: Column, default: Column | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(table[c], default) if default is not None else table[c]


def authority_rank(c: Column) -> Column:
    return lookup(vocab.AUTHORITY_RANK, c)


def outranks(a: Column, b: Column) -> Column:
    return authority_rank(a) < authority_rank(b)


def parse_status(c: Column) -> Column:
    """Status text to its name; unknown text is unknown."""
    name = F.replace(normalize_text(c), F.lit(" "), F.lit("_"))
    return F.when(name.isin(*vocab.STATUSES), name).otherwise(F.lit("unknown"))


def is_usable(status: Column) -> Column:
    return F.coalesce(status == "active", F.lit(False))


def to_number(c: Column, kind: str = "double") -> Column:
    """A number or null."""
    return c.cast("string").try_cast(kind)


def csv_safe(c: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a leading apostrophe."""
    return F.when(c.rlike(r"^[\s\x0b\x1c-\x1f\x85\p{Z}]*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def redact(message: Column, value: Column) -> Column:
    """The value out of the message, and 500 characters at most."""
    return F.substring(F.when(F.coalesce(value, F.lit("")) != "", F.replace(message, value, F.lit("<redacted>"))).otherwise(message), 1, 500)
