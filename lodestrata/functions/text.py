"""Text, size and label expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def file_tokens(n_bytes: Column) -> Column:
    """A quarter of the bytes, halves rounded up."""
    return F.floor(n_bytes / 4 + 0.5).cast("long")


def request_tokens(n_bytes: Column, n_questions: Column) -> Column:
    return F.least(F.lit(65536).cast("long"), (n_bytes + 512 + 32 * n_questions).cast("long"))


def nfkc(text: Column) -> Column:
    """Compatibility forms composed; texts that are ASCII stay as they are."""

    @F.pandas_udf("string")
    def composed(values: pd.Series) -> pd.Series:
        return values.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

    return composed(text)


def identifiers(text: Column) -> Column:
    """Distinct identifiers of the NFKC form, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(nfkc(text), F.lit(r"[_\p{L}\p{Nl}][_\p{L}\p{Nl}\p{Nd}\p{Mn}\p{Mc}\p{Pc}]*"), F.lit(0)))


def shannon_entropy(text: Column) -> Column:
    """Bits a character; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def quote_label(text: Column) -> Column:
    """As a JSON string, with control and bidirectional marks escaped."""
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    for code in (*range(0x7F, 0xA0), 0x061C, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A), 0x2028, 0x2029):
        quoted = F.replace(quoted, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return quoted


def human_size(n_bytes: Column) -> Column:
    """The unit is chosen after rounding to one decimal place."""
    def shown(power: int, unit: str) -> Column:
        return F.concat(F.format_string("%.1f", F.floor(n_bytes / 1024.0**power * 10 + 0.5) / 10), F.lit(f" {unit}"))

    def full(power: int) -> Column:
        return F.floor(n_bytes / 1024.0**power * 10 + 0.5) / 10 >= 1024

    return (
        F.when(n_bytes < 1024, F.concat(n_bytes.cast("string"), F.lit(" B")))
        .when(~full(1), shown(1, "KiB"))
        .when(~full(2), shown(2, "MiB"))
        .otherwise(shown(3, "GiB"))
    )


def fence_length(text: Column) -> Column:
    """One more than the longest run of backticks, three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)
    return F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1)


def redact(message: Column, secret: Column) -> Column:
    """Without control characters and the secret; 500 characters at most."""
    clean = F.regexp_replace(message, r"[\x00-\x1f\x7f-\x9f]", " ")
    return F.left(F.when(F.length(secret) > 0, F.replace(clean, secret, F.lit("[redacted]"))).otherwise(clean), F.lit(500))
