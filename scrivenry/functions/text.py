"""Text functions as column expressions."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words left out of the index.
INDEX_STOP = (
    "the and for with from that this shall which under what does how are law legal tanzania tanzanian act section please was were have has any not may all such than their been being"
).split()
#: Words left out of a gateway query.
GATEWAY_STOP = "the and for with from that this shall which under what does how are law legal tanzania tanzanian act section please".split()
#: Words left out of a question.
QUESTION_STOP = (
    "a an the is are was were be been being do does did what which who when where why how can could would should may might must shall i we you they it this that these those "
    "of for to from in on at by with without and or but as about under please explain compare between their our your also law legal makes make cite exact relevant provisions provide "
    "answer question tanzania tanzanian act acts statute statutes section sections case cases leading identify applicable company worked working work years year months month "
    "immediately alleged given paid one two three four five six seven eight nine ten"
).split()
#: Words of a question that name a legal concept.
CONCEPTS = (
    "employment employee employer termination terminated dismissal dismissed misconduct disciplinary hearing notice unfair fairness procedural procedure substantive remedy remedies "
    "compensation reinstatement redundancy contract agreement breach confidentiality indemnity liability director directors fiduciary shareholder corporate negligence duty duties land "
    "property title lease tenant mortgage arbitration arbitral evidence admissibility civil criminal offence offense penal tax vat revenue banking competition insurance mining "
    "environmental probate succession estate privacy data protection divorce marriage injunction appeal jurisdiction limitation damages"
).split()
#: Forms of a term and the term that stands for them.
CANONICAL = {
    "employee": "employment", "employer": "employment", "terminated": "termination", "dismissal": "termination", "dismissed": "termination", "fairness": "unfair", "procedure": "procedural",
    "remedies": "remedy", "directors": "director", "duties": "duty", "arbitral": "arbitration", "offence": "criminal", "offense": "criminal",
}
#: Forms looked up for a term.
VARIANTS = {
    "employment": ("employment", "employee", "employer"),
    "termination": ("termination", "terminate", "terminated", "terminating", "dismissal", "dismissed"),
    "procedural": ("procedural", "procedure", "procedures"),
    "unfair": ("unfair", "fair"),
    "remedy": ("remedy", "remedies"),
}
#: Elements whose end ends a line.
BLOCK_TAGS = r"p|div|section|article|h\d|li|tr|table|br|subsection|section|provision|marginalnote|heading"
#: Patterns of citations, of references to evidence, and of titles in markup.
NEUTRAL_CITATION = r"\[\d{4}\]\s*[A-Z][A-Z0-9]{1,12}\s*\d{1,7}\b"
LABEL_GROUP, LABEL = r"\[[^\]\n]{1,200}\]|\([PF]\d+\b[^)\n]{0,198}\)", r"\b([PF]\d+)\b"
TITLE_TAGS = ("ShortTitle", "LongTitle", "TitleText", "title")
#: Words left out of the terms of a discovery query.
DISCOVERY_STOP = (
    "what when where which who whom whose why how does do did can could would should the and for from with without under into onto about that this these those are was were "
    "have has had being been than then them their there here law legal tanzania tanzanian please"
).split()
#: Patterns of a discovery query and the terms they add.
DISCOVERY_EXPANSIONS = (
    ("director|shareholder|company|companies|corporate|board", ("companies",)),
    ("employee|employer|employment|labou?r|termination|redundancy", ("employment", "labour")),
    ("privacy|personal data|data protection", ("personal", "data", "protection")),
    ("contract|breach|agreement", ("contract",)),
    ("land|property|lease|tenant|mortgage", ("land",)),
    ("arbitration|arbitral", ("arbitration",)),
    ("marriage|divorce|matrimonial", ("marriage",)),
    ("evidence|admissib", ("evidence",)),
    ("civil procedure|injunction|plaint|summons", ("civil", "procedure")),
    ("criminal|offence|offense|penal", ("penal",)),
    ("tax|vat|income tax|revenue", ("tax",)),
    ("bank|banking|financial institution", ("banking", "financial")),
    ("competition|antitrust", ("competition",)),
    ("insurance|insurer", ("insurance",)),
    ("mining|mineral", ("mining",)),
    ("environment|pollution", ("environmental",)),
    ("probate|succession|estate|administrator", ("probate", "estate")),
)
#: Patterns of a public question and the query each stands for; the first that fits counts.
TOPICS = (
    ("kufukuzwa|kufutwa kazi|kusitishwa kwa ajira|termination|dismissal", "unfair termination dismissal Employment Labour Relations Act"),
    ("mshahara|malipo ya kazi|wages|salary", "minimum wages remuneration Employment Labour Relations Act"),
    ("ajira|mwajiri|mfanyakazi|employment|employee", "Employment Labour Relations Act"),
    ("ardhi|kiwanja|hati miliki|land title|land dispute", "Land Act Village Land Act right occupancy"),
    ("mpangaji|pango|nyumba ya kupanga|tenant|lease", "land lease landlord tenant"),
    ("ndoa|talaka|matunzo ya mtoto|divorce|marriage|custody", "Law of Marriage Act divorce custody maintenance"),
    ("mirathi|wosia|urithi|probate|inheritance|will\\b", "Probate Administration Estates Act wills inheritance"),
    ("mkataba|mikataba|contract", "Law of Contract Act agreement breach"),
    ("kampuni|usajili wa biashara|company|incorporation", "Companies Act company registration"),
    ("taarifa binafsi|faragha|data protection|privacy", "Personal Data Protection Act"),
    ("jinai|kukamatwa|dhamana|criminal|arrest|bail", "Criminal Procedure Act arrest bail"),
)


def words(text: Column, least: int = 3) -> Column:
    """Lower-case runs of at least ``least`` letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[\p{{L}}\p{{N}}]{{{least},}}"), F.lit(0))


def _literal(values: list[str] | tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def index_words(text: Column) -> Column:
    """The words of a text that are indexed, repeats included."""
    stop = _literal(INDEX_STOP)
    return F.filter(words(text), lambda w: ~F.array_contains(stop, w))


def gateway_terms(text: Column) -> Column:
    """At most ten distinct words of a query, in order."""
    return F.slice(F.array_distinct(F.array_except(words(text), _literal(GATEWAY_STOP))), 1, 10)


def question_terms(text: Column) -> Column:
    """At most eight terms of a question: legal concepts first, then by place; forms of one term count once."""
    kept = F.filter(F.array_except(words(text), _literal(QUESTION_STOP)), lambda w: ~w.rlike("^[0-9]+$"))
    forms = F.create_map(*[F.lit(x) for pair in CANONICAL.items() for x in pair])
    concepts = _literal(CONCEPTS)
    ranked = F.transform(kept, lambda w, i: F.struct(F.when(F.array_contains(concepts, w), 0).otherwise(1).alias("rank"), i.alias("at"), F.coalesce(F.try_element_at(forms, w), w).alias("term")))
    # The first occurrence of a term decides its rank, also where a later form of it is no concept.
    terms = F.array_distinct(F.transform(ranked, lambda x: x["term"]))
    firsts = F.transform(terms, lambda t: F.get(F.filter(ranked, lambda x: x["term"] == t), F.lit(0)))
    return F.transform(F.slice(F.array_sort(firsts), 1, 8), lambda x: x["term"])


def query_plans(question: Column) -> Column:
    """Up to three queries of quoted terms: three required, two required, any of four; without terms the question."""
    terms = question_terms(question)
    quoted = lambda n, sep: F.array_join(F.transform(F.slice(terms, 1, n), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), sep)
    plans = F.array_distinct(F.array(quoted(3, " "), quoted(2, " "), quoted(4, " OR ")))
    bare = F.trim(question)
    return F.when(F.size(terms) > 0, plans).when(bare != "", F.array(bare)).otherwise(F.array().cast("array<string>"))


def squeezed(text: Column) -> Column:
    """White space made single, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def evidence_form(text: Column) -> Column:
    """The form in which quotes are looked for: lower case, white space single."""
    return squeezed(F.lower(text))


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def strip_markup(text: Column) -> Column:
    """Text without markup: block ends become line feeds, other tags spaces, entities characters (unknown ones spaces), empty lines go."""
    steps = [
        (r"(?i)<!DOCTYPE[\s\S]*?(?:\]>|>)", " "),
        (r"(?s)<!--.*?-->", " "),
        (r"(?is)<(script|style)\b[^>]*>.*?</\1>", " "),
        (rf"(?i)</(?:{BLOCK_TAGS})>\s*", "\n"),
        (r"<[^>]+>", " "),
    ]
    flat = reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)
    # Only texts with an entity are sent to Python.
    flat = F.coalesce(F.regexp_replace(_unescaped(F.when(F.contains(flat, F.lit("&")), flat)), r"&[A-Za-z][A-Za-z0-9]+;", " "), flat)
    lines = F.transform(F.split(flat, r"\r\n|[\n\r\u000b\f\u001c-\u001e\u0085\u2028\u2029]"), lambda x: F.trim(F.regexp_replace(x, r"(?U)[\s\u001c-\u001f]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def markup_title(raw: Column, fallback: Column) -> Column:
    """The first title element that isn't empty once its markup is stripped, at most 500 characters; else ``fallback``."""
    found = [F.nullif(F.substring(strip_markup(F.regexp_extract(raw, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)), 1, 500), F.lit("")) for tag in TITLE_TAGS]
    return F.coalesce(*found, fallback)


def discovery_terms(query: Column) -> Column:
    """At most ten terms: the first eight words of four letters and more, then those its topics add."""
    kept = F.filter(F.regexp_extract_all(F.lower(query), F.lit("[a-z][a-z0-9-]{2,}"), F.lit(0)), lambda w: ~F.array_contains(_literal(DISCOVERY_STOP), w) & (F.length(w) >= 4))
    none = F.array().cast("array<string>")
    added = [F.when(query.rlike(f"(?i){pattern}"), _literal(terms)).otherwise(none) for pattern, terms in DISCOVERY_EXPANSIONS]
    return F.slice(F.array_distinct(F.concat(F.slice(kept, 1, 8), *added)), 1, 10)


def topic_queries(query: Column) -> Column:
    """The query of the first topic that fits and the question, or the question alone."""
    topic = F.coalesce(*[F.when(query.rlike(f"(?i){pattern}"), F.lit(text)) for pattern, text in TOPICS])
    return F.when(topic.isNotNull() & (topic != query), F.array(topic, query)).otherwise(F.array(query))


def contained_score(text: Column, terms: Column) -> Column:
    """Four for each contained term of seven letters and more, two for each other."""
    low = F.lower(text)
    return F.aggregate(terms, F.lit(0).cast("long"), lambda s, t: s + F.when(F.contains(low, t), F.when(F.length(t) >= 7, 4).otherwise(2)).otherwise(0))


def composed_citation(chapter: Column, number: Column, published: Column) -> Column:
    """``Cap. n R.E. yyyy``, ``No. n``, or null."""
    edition = F.when(F.coalesce(published, F.lit("")) != "", F.concat(F.lit(" R.E. "), F.substring(published, 1, 4))).otherwise("")
    return F.when(F.coalesce(chapter, F.lit("")) != "", F.concat(F.lit("Cap. "), chapter, edition)).when(F.coalesce(number, F.lit("")) != "", F.concat(F.lit("No. "), number))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def title_language(title: Column) -> Column:
    """A language guessed from the first word of a title."""
    return F.when(F.lower(title).rlike(r"^(sheria|kanuni|katiba)\b"), "sw").otherwise("en")


def neutral_citations(text: Column) -> Column:
    """Citations of the form [year] COURT number, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NEUTRAL_CITATION), F.lit(0)))


def citation_candidates(query: Column, evidence: Column, most: int = 80) -> Column:
    """Neutral citations of a query, then the citations (array) of its evidence: of 3 to 250 characters, each once, the first ``most``."""
    found = F.concat(F.regexp_extract_all(query, F.lit(NEUTRAL_CITATION), F.lit(0)), F.transform(evidence, lambda c: F.trim(F.coalesce(c, F.lit("")))))
    return F.slice(F.array_distinct(F.filter(found, lambda c: F.length(c).between(3, 250))), 1, most)


def evidence_labels(text: Column) -> Column:
    """The labels P1, F2 and so on in brackets, each once, in order."""
    groups = F.regexp_extract_all(text, F.lit(LABEL_GROUP), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(LABEL), F.lit(1)))))


def citation_key(text: Column) -> Column:
    """A citation without case and white space."""
    return F.regexp_replace(F.lower(text), r"\s+", "")
