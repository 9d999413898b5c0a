"""Scalar functions of the engine as column expressions; all run inside code generation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what splits words, as Python's str.split() has it.
WHITE = r"[\s\x1c-\x1f\x85   -     　]+"


def hours_between(later: Column, earlier: Column) -> Column:
    """Hours from ``earlier`` to ``later``; null if either is."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)


def log1p_or_0(x: Column) -> Column:
    """log1p of a count, null and negatives as 0."""
    return F.log1p(F.greatest(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0)))


def duration_seconds(iso: Column) -> Column:
    """Seconds of PT[nH][nM][nS]; null for any other form. 'PT' alone is 0."""
    form = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?\z"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(iso, form, k), F.lit("")).cast("bigint"), F.lit(0))
    return F.when(iso.rlike(form), part(1) * 3600 + part(2) * 60 + part(3))


def is_short(iso: Column) -> Column:
    return F.coalesce(duration_seconds(iso) <= 60, F.lit(False))


def words(text: Column) -> Column:
    """The words of a text, split at any Unicode white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def has_question(text: Column) -> Column:
    return F.coalesce(text.contains("?"), F.lit(False))


def has_caps_run(text: Column) -> Column:
    """Any word of more than three characters with a cased letter and all of them upper."""
    return F.exists(words(text), lambda w: (F.length(w) > 3) & w.rlike(r"\p{IsUppercase}") & ~w.rlike(r"[\p{IsLowercase}\p{Lt}]"))


def non_ascii(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x00-\x7F]"), F.lit(False))


def author_hash(raw: Column, salt: str) -> Column:
    """First 20 hex digits of sha256(salt + raw); null for null and empty. The salt stays in a closure, out of plans and event logs."""
    @F.pandas_udf("string")
    def hashed(x: pd.Series) -> pd.Series:
        from hashlib import sha256

        return x.map(lambda r: sha256((salt + r).encode()).hexdigest()[:20] if r else None)

    return hashed(raw)


def quota_day(at: Column) -> Column:
    """The Pacific calendar day of an instant, as yyyy-MM-dd."""
    return F.date_format(F.from_utc_timestamp(at, "America/Los_Angeles"), "yyyy-MM-dd")


def estimated_units(comment_count: Column) -> Column:
    """Quota that collecting a video takes: a unit per 100 comments, at least one, and one for the probe."""
    return F.greatest(F.lit(1), F.ceil(F.coalesce(comment_count, F.lit(0)) / 100.0)).cast("bigint") + 1


def as_int(x: Column) -> Column:
    return x.try_cast("bigint")


def hash_text(text: Column) -> Column:
    return F.sha2(text, 256)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hash_draw(n: Column | int, *parts: Column | str) -> Column:
    """A draw from 0..n-1 that any engine with md5 can repeat."""
    key = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % (n if isinstance(n, Column) else F.lit(n))
