"""Hashes, shards, scores and delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def record_id(jurisdiction: Column, external_id: Column) -> Column:
    """The id of a record: SHA-256 of jurisdiction and external id."""
    return F.sha2(F.concat_ws(":", jurisdiction, external_id), 256)


def shard(word: Column, shards: int = 256) -> Column:
    """Two hex digits for a word: a polynomial of its characters in 32 bits, modulo the shards."""
    chars = F.filter(F.split(word, ""), lambda c: c != "")
    code = F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.lpad(F.hex(code % shards), 2, "0"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null for unequal lengths and zero vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot / length)


def posting_weight(body: Column, title: Column) -> Column:
    """Weight of a term in a document: logarithm of its count in the text, fifteen for each in the title."""
    return F.round(F.log1p(body.cast("double")) + 15 * title, 3)


def term_weight(df: Column, importance: float = 1.0) -> Column:
    """Weight of a query term by the number of its postings, of which at most 256 are kept."""
    return importance * F.greatest(F.lit(1.0), F.log1p(256 / F.greatest(F.lit(1), df)))


def fusion(lexical: Column, semantic: Column) -> Column:
    """Score of a row at the places ``lexical`` and ``semantic`` (from 0) of two rankings."""
    return 0.45 / (20 + lexical) + 0.55 / (20 + semantic)


def backoff_seconds(attempt: Column, base: int = 30, most: int = 3600) -> Column:
    """Delay before the next attempt: doubles with each, up to ``most``."""
    return F.least(F.lit(most).cast("double"), base * F.pow(F.lit(2.0), attempt - 1)).cast("long")


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
