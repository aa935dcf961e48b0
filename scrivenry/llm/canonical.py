"""Freely typed citations mapped to a canonical list.

Distinct values are normalised, candidates of the same jurisdiction come from an inverted index of
character trigrams (padded words, so that their order doesn't matter) and whole numbers, and are
scored by a weighted cosine against the forms of an entry: its citation, its title, and both. The
best entry is accepted if its score is above a threshold and the next entry is a margin away. An
exact check follows, which can only refuse the one accepted: a value that gives numbers must give
those of the authority, a title must agree word by word with slips allowed.

Defined results: null, blank and canonical values are no cases; a null jurisdiction, an unknown
jurisdiction and an empty canonical list give 0; repeated rows give one row; ties give 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivenry.sources import materialize

#: Ways of writing the kinds of citations, after folding; the right side is the kind.
KINDS = {
    "statutory rules": "sr", "statutory rule": "sr", "government notice": "gn", "government notices": "gn",
    "chapter": "c", "chap": "c", "ch": "c", "cap": "c", "regulation": "reg", "reglement": "reg", "verordnung": "reg", "r": "reg", "statute": "act",
    "sura ya": "c", "gnno": "gn", "srno": "sr", "actno": "act", "capno": "c", "sqno": "sq", "regno": "reg",
}
KIND_WORDS = frozenset({"sr", "sq", "gn", "c", "reg", "act"})
#: Words that name nothing.
FILLERS = frozenset("the of fo and v vs versus no nr num number case in see cf also applied followed cited per at a an by to laws re rev ed".split())
#: Words that begin a reference into an authority; what follows them is no part of its citation.
PINPOINTS = frozenset("at p pp page para paras paragraph s ss section sec art article unreported ff".split())
_DIGITLIKE = str.maketrans("OoQlI|SB", "00011158")
_TOKEN = re.compile(r"[^\W_]+")
_PART = re.compile(r"\d+|[^\W\d_]+")


def fold(text: str) -> str:
    """Compatibility form without accents."""
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text))
    return "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text


def tokens_of(text: str) -> list[str]:
    """Words and numbers of a citation: no case, accents, dots or leading zeros; letters read for digits are put right."""
    raw: list[str] = []
    for t in _TOKEN.findall(fold(text)):
        if re.fullmatch(r"[0-9OoQlI|SB]+", t) and (any(c.isdigit() for c in t) or re.fullmatch(r"[OlIS]{2,4}", t)):
            raw.append(t.translate(_DIGITLIKE))
        else:
            raw += _PART.findall(t.lower())
    out: list[str] = []
    single = False
    for t in raw:
        if t.isdigit():
            out.append(t.lstrip("0") or "0")
            single = False
        elif len(t) == 1 and single:
            out[-1] += t
        else:
            out.append(t)
            single = len(t) == 1
    line = f" {' '.join(out)} "
    for long, short in KINDS.items():
        if f" {long} " in line:
            line = line.replace(f" {long} ", f" {short} ")
    return line.split()


def grams(tokens: list[str]) -> list[str]:
    """Distinct features of what names something: padded trigrams of words, short words also as a bag of letters (for exchanged letters), beginnings for words cut short, numbers whole."""
    out = set()
    for t in tokens:
        if t.isdigit():
            out.add(f"#{t}")
        elif t not in FILLERS and t not in PINPOINTS:
            p = f"^{t}$"
            out.update(p[i : i + 3] for i in range(max(1, len(p) - 2)))
            if len(t) >= 3:
                out.add(f"<{t[:3]}")
            if 3 <= len(t) <= 5:
                out.add("=" + "".join(sorted(t)))
    return sorted(out)


def distance(a: str, b: str, most: int) -> int:
    """Changed, missing, added and exchanged letters between two words; ``most`` + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


def _slip(word: str, proper: str, shorten: bool) -> int | None:
    """How far ``word`` is from ``proper``; None if it is another word."""
    if word == proper:
        return 0
    if shorten and len(word) >= 3 and word[0] == proper[0] and len(word) < len(proper):
        rest = iter(proper)
        if proper.startswith(word) or all(c in rest for c in word):
            return 0
    most = 2 if len(proper) >= 6 else 1 if len(proper) >= 4 else 0
    d = distance(word, proper, most)
    return d if d <= most else None


class Reading:
    """What a value says, taken apart."""

    def __init__(self, text: str) -> None:
        self.tokens = tokens_of(text)
        cut = next((i for i, t in enumerate(self.tokens) if t in PINPOINTS and i > 0 and any(x.isdigit() for x in self.tokens[:i])), len(self.tokens))
        self.main = self.tokens[:cut]
        self.numbers = [int(t) for t in self.main if t.isdigit()]
        self.words = [t for t in self.main if not t.isdigit() and t not in FILLERS]


def agrees(value: Reading, citation: Reading, title: Reading, court: Reading, code: str | None, year: int) -> tuple[int, int] | None:
    """(1 if by citation, slips) if the value names the authority, else None."""
    own, words = citation.numbers, set(value.words)
    names = title.words
    if code:
        court_words = [w for w in court.words if w != code]
        said = code in words or (len(court_words) > 0 and all(any(_slip(w, c, False) is not None for w in words) for c in court_words))
        slips = 0
        if not said and (near := [w for w in words if len(w) == len(code) and sorted(w) == sorted(code) and distance(w, code, 1) == 1]):
            said, slips = True, len(near)
        if said:
            return (1, slips) if sorted(value.numbers[: len(own)]) == sorted(own) else None
    else:
        kind = next((w for w in citation.words if w in KIND_WORDS), None)
        # A kind is also named by the words that its letters stand for.
        initials = [a[0] + b[0] for a, b in zip(value.words, value.words[1:])]
        given = [w for w in [*value.main, *initials] if w in KIND_WORDS]
        typed = kind in given or (not given and not value.words)
        ordered = citation.numbers
        if typed and value.numbers:
            first = value.numbers[: len(own)]
            if sorted(first) == sorted(own) and (kind in given or first == ordered):
                # "Act 24/1973" is a citation, "Water Act 1973" a title: the title's words must then not be another's.
                spelt = {w for a, b in zip(value.words, value.words[1:]) if kind not in value.main and a[0] + b[0] == kind for w in (a, b)}
                rest = [w for w in value.words if w not in KIND_WORDS and w not in spelt]
                if not rest or _titled(rest, [w for w in names if w not in KIND_WORDS], True) is not None:
                    return (1, 0)
                return None
            if sorted(value.numbers[: len(own) + 1]) == sorted([*own, year]) and len(own) == 1:
                return (1, 0)
            if kind != "act" or value.numbers != [year]:
                if value.numbers != [year]:
                    return None
    if value.numbers and value.numbers != [year]:
        return None
    slips = _titled(value.words, names, code is None)
    return None if slips is None else (0, slips)


def _titled(words: list[str], names: list[str], shorten: bool) -> int | None:
    """Slips between the words of a value and a title, in order; None if they differ otherwise."""
    if len(words) != len(names) or not names:
        joined, proper = "".join(words), "".join(names)
        if words and abs(len(words) - len(names)) == 1 and (d := distance(joined, proper, 2)) <= 2:
            return d
        return None
    total = 0
    for w, n in zip(words, names):
        d = _slip(w, n, shorten)
        if d is None:
            return None
        total += d
    return total


def _prepare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        yield p.assign(grams=[grams(Reading(v).main) for v in p["value"]])


def _check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[str, Reading] = {}

    def read(text: str) -> Reading:
        if text not in seen:
            if len(seen) > 100_000:
                seen.clear()
            seen[text] = Reading(text)
        return seen[text]

    for p in parts:
        rows = []
        for vid, value, aid, score, citation, title, code, court, year in zip(*(p[c] for c in ("vid", "value", "authority_id", "score", "citation", "title", "court_code", "court", "issued_year"))):
            code = None if code is None else code.lower()
            got = agrees(read(value), read(citation), read(title or ""), read(court or ""), code, -1 if pd.isna(year) else int(year))
            if got:
                rows.append((vid, aid, score))
        yield pd.DataFrame(rows, columns=["vid", "authority_id", "score"])


def map_values(values: DataFrame, authorities: DataFrame, threshold: float = 0.35, near: float = 0.5, margin: float = 0.004, common: float = 20.0) -> DataFrame:
    """(jurisdiction, value, authority_id, score): the authority each distinct value names in its jurisdiction, or 0.

    ``values``: (jurisdiction, value). A feature weighs the square of its inverse document frequency
    in the jurisdiction. Candidates are found by the features that at most one entry in ``common``
    (or three) has, or by all of them for a value that has no such feature in common with an entry;
    those with at least ``near`` times the best of these sums are scored over all features. The best
    is accepted from ``threshold`` on, if no other entry comes within ``margin``.
    """
    listed = authorities.select("authority_id", F.col("jurisdiction_code").alias("jurisdiction"), "citation", "title", "court_code", "court", "issued_year").filter("authority_id is not null and citation is not null")
    distinct = values.select("jurisdiction", "value").distinct().withColumn("vid", F.xxhash64("jurisdiction", "value"))
    prepared = materialize(distinct.mapInPandas(_prepare, "jurisdiction string, value string, vid long, grams array<string>"), "values")
    # The forms in which an entry is named, so that a citation isn't measured against the words of a title. A form is (authority, number of the form).
    year, title = F.col("issued_year").cast("string"), F.coalesce("title", F.lit(""))
    named = [F.col("citation"), F.when(F.col("court").isNotNull(), F.concat_ws(" ", "citation", "court")), title, F.concat_ws(" ", title, year), F.concat_ws(" ", title, "citation")]
    forms = listed.select("jurisdiction", "authority_id", F.posexplode(F.array(*named)).alias("at", "value")).filter("value is not null")
    forms = forms.select("jurisdiction", "value", (F.col("authority_id") * 8 + F.col("at")).alias("vid"))
    forms = forms.mapInPandas(_prepare, "jurisdiction string, value string, vid long, grams array<string>")
    postings = materialize(forms.select("jurisdiction", F.col("vid").alias("form_id"), F.explode("grams").alias("gram")), "postings")
    entry = F.floor(F.col("form_id") / 8)
    total = postings.groupBy("jurisdiction").agg(F.countDistinct(entry).alias("total"))
    rarity = F.log1p(F.col("total") / F.col("df"))
    weight = postings.groupBy("jurisdiction", "gram").agg(F.countDistinct(entry).alias("df")).join(total, "jurisdiction")
    weight = materialize(weight.select("jurisdiction", "gram", (F.col("df") > F.greatest(F.lit(3), F.col("total") / common)).alias("is_common"), (rarity * rarity).alias("w")), "gram_weights")
    weighted = postings.join(weight, ["jurisdiction", "gram"])
    lengths = weighted.groupBy("form_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    weighted = materialize(weighted.join(lengths, "form_id").select("jurisdiction", "gram", "form_id", "is_common", "w", (F.col("w") / F.col("length")).alias("part")), "weighted_postings")
    asked = prepared.select("jurisdiction", "vid", F.explode("grams").alias("gram"))
    # A number that no entry has is as rare as can be; letters that none has are mostly slips.
    unseen = F.pow(F.log1p(F.when(F.startswith("gram", F.lit("#")), F.col("total")).otherwise(F.col("total") / 10)), 2)
    w = F.coalesce(F.col("w"), unseen)
    own_length = asked.join(weight, ["jurisdiction", "gram"], "left").join(F.broadcast(total), "jurisdiction").groupBy("vid").agg(F.sqrt(F.sum(w * w)).alias("own_length"))
    # All sums of a value come to one task (a value has at most so many as the canonical list has forms): its best is known there, and what is far from it goes no further.
    sums = lambda rows, postings: rows.join(postings, ["jurisdiction", "gram"]).select("vid", "form_id", (F.col("w") * F.col("part")).cast("float").alias("dot")).repartition("vid").groupBy("vid", "form_id").agg(F.sum("dot").alias("dot"))
    rare = sums(asked, weighted.filter("not is_common")).withColumn("best", F.max("dot").over(Window.partitionBy("vid")))
    kept = materialize(rare.filter(F.col("dot") >= near * F.col("best")).select("vid", "form_id", "dot"), "candidates")
    others = sums(asked.join(kept.select("vid").distinct(), "vid", "left_anti"), weighted)
    more = kept.select("vid", "form_id").join(asked.join(weight.filter("is_common").select("jurisdiction", "gram"), ["jurisdiction", "gram"]).select("vid", "gram"), "vid")
    more = more.join(weighted.filter("is_common").select("form_id", "gram", (F.col("w") * F.col("part")).alias("dot")), ["form_id", "gram"]).select("vid", "form_id", "dot")
    scored = kept.unionByName(more).unionByName(others).groupBy("vid", "form_id").agg(F.sum("dot").alias("dot")).join(own_length, "vid")
    scored = scored.groupBy("vid", F.floor(F.col("form_id") / 8).alias("authority_id")).agg(F.max(F.round(F.col("dot") / F.col("own_length"), 9)).alias("score"))
    at = Window.partitionBy("vid").orderBy(F.desc("score"), "authority_id")
    two = scored.withColumn("at", F.row_number().over(at)).filter("at <= 2").groupBy("vid").agg(
        F.max("score").alias("score"), F.max(F.when(F.col("at") == 1, F.col("authority_id"))).alias("authority_id"), F.max(F.when(F.col("at") == 2, F.col("score"))).alias("next")
    )
    accepted = materialize(two.filter((F.col("score") >= threshold) & (F.col("score") - F.coalesce("next", F.lit(0.0)) >= margin)), "accepted")
    asked_of = accepted.join(listed.drop("jurisdiction"), "authority_id").join(prepared.select("vid", "value"), "vid")
    checked = asked_of.select("vid", "value", "authority_id", "score", "citation", "title", "court_code", "court", "issued_year").mapInPandas(_check, "vid long, authority_id long, score double")
    return prepared.select("jurisdiction", "value", "vid").join(checked, "vid", "left").select("jurisdiction", "value", F.coalesce("authority_id", F.lit(0)).alias("authority_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def typed_citations(documents: DataFrame, entries: DataFrame, authorities: DataFrame) -> DataFrame:
    """(field, record_id, jurisdiction, value): the values that are cases, from the three fields."""
    fields = (
        documents.select(F.lit("documents.citation").alias("field"), F.col("doc_id").alias("record_id"), F.col("jurisdiction_code").alias("jurisdiction"), F.col("citation").alias("value")),
        entries.select(F.lit("citator_entries.target_citation").alias("field"), F.col("entry_id").alias("record_id"), "jurisdiction", F.col("target_citation").alias("value")),
        entries.select(F.lit("citator_entries.judgment_citation").alias("field"), F.col("entry_id").alias("record_id"), "jurisdiction", F.col("judgment_citation").alias("value")),
    )
    rows = fields[0].unionByName(fields[1]).unionByName(fields[2]).filter("record_id is not null and value rlike '\\\\S'")
    canonical = authorities.select(F.col("citation").alias("value")).filter("value is not null").distinct()
    return rows.join(canonical, "value", "left_anti").distinct()


def map_citations(documents: DataFrame, entries: DataFrame, authorities: DataFrame) -> DataFrame:
    """(field, record_id, value, authority_id, score) of every case; authority_id 0: it names none."""
    rows = typed_citations(documents, entries, authorities)
    mapped = map_values(rows.select("jurisdiction", "value"), authorities)
    found = rows.join(mapped.filter("authority_id > 0"), ["jurisdiction", "value"], "left")
    return found.select("field", "record_id", "value", F.coalesce("authority_id", F.lit(0)).alias("authority_id"), F.coalesce("score", F.lit(0.0)).alias("score"))
