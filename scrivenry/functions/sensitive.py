"""Sensitive strings: which kinds a text holds, what to do, and the text without them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kind, pattern and placeholder, in the order in which they apply.
DETECTORS = (
    ("credentials", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----|\b(?:sk|rk)-[A-Za-z0-9_-]{20,}|\bAIza[0-9A-Za-z_-]{20,}|\bAKIA[0-9A-Z]{16}\b", "[REDACTED_CREDENTIAL]"),
    ("financial_account", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b|\b(?:[0-9][ -]*?){13,19}\b", "[REDACTED_FINANCIAL_IDENTIFIER]"),
    ("government_id", r"(?i)\b(?:passport|national id|ssn|tin)\s*(?:number|no\.?|#)?\s*[:=-]\s*[A-Z0-9-]{5,24}\b", "[REDACTED_GOVERNMENT_ID]"),
)


def inspect(text: Column) -> Column:
    """struct(decision, kinds, sanitized): each detector looks at what the ones before it left."""
    kinds, rest = [], text
    for kind, pattern, placeholder in DETECTORS:
        kinds.append(F.when(rest.rlike(pattern), F.lit(kind)))
        rest = F.regexp_replace(rest, pattern, placeholder.replace("$", r"\$"))
    found = F.array_compact(F.array(*kinds))
    decision = F.when(F.array_contains(found, "credentials"), "block").when(F.size(found) > 0, "redact").otherwise("allow")
    return F.struct(decision.alias("decision"), found.alias("kinds"), rest.alias("sanitized"))
